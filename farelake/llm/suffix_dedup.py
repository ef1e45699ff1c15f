"""Removal of byte strings that occur twice, by suffix groups.

A byte goes when a string of ``LENGTH`` bytes that covers it also starts anywhere else.

1. Anchors. Every window of ``LENGTH`` bytes has an anchor, the place of its least
   hash over ``GRAM`` bytes; equal windows have equal anchors at equal places.
   Neighbouring windows with one anchor form a context. Anchors that occur once
   in the corpus end here; so do texts that occur twice as a whole, which go
   entirely, and contexts that occur twice as a whole.
2. Pieces. Contexts that differ around a common anchor are cut at fixed distances
   from the anchor into pieces of at most ``STEP`` window starts. All windows of a piece
   share a core of bytes; pieces with equal cores are grouped.
3. Suffix array. In a group the core is one letter. The bytes left and right of it
   in each distinct piece, all groups of a batch one after the other, make a string whose
   suffix array is built by linear grouping construction (``suffix_groups``).
   A window is repeated when its suffix agrees over the whole window with a neighbour
   in the order.
4. Cut. Intervals of repeated windows are gathered for each text, and texts that
   have any are read once more and cut.

Pieces around an anchor that more than ``MANY`` different contexts share need no
suffix array. Equal pieces are found by an aggregation and go as a whole; of pieces
that differ around a shared core, one of each is cut into its windows, which a second
aggregation compares. No group of unbounded size meets in a task.

Defined results: a NULL text counts as empty; texts shorter than ``LENGTH`` keep all.
Rows equal in id and text are copies of each other like any rows with equal texts.
Other columns are not looked at. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from farelake.llm.common import keep_keys, table, text_key
from farelake.llm.shingles import _CODES, pieces, powers, scramble
from farelake.llm.suffix_groups import neighbour_overlaps, suffix_array
from farelake.session import durable

LENGTH = 200
GRAM = 64
STEP = 8
MANY = 1000
REMEMBERED_TEXTS = 1_000_000
# Places inside one stretch of hashing; a longer text is taken in overlapping stretches.
PLACE_BITS = 22
# Letters of one suffix array.
LETTERS = 60_000

_BYTE_CODES = scramble(_CODES + np.arange(256, dtype=np.uint64))  # upper and lower case differ


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Contexts of a piece of text: (document, first and last window start, anchor place, anchor hash, context hash)."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    n = len(data)
    running = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_CODES[data] * powers(n), out=running[1:])
    grams = scramble((running[gram:] - running[:-gram]) * powers(n - gram + 1, inverse=True))
    mask = np.uint64((1 << PLACE_BITS) - 1)
    least = (grams & ~mask) | np.arange(len(grams), dtype=np.uint64)
    window, width = length - gram + 1, 1
    while 2 * width <= window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < window:
        least = np.minimum(least[:len(least) - (window - width)], least[window - width:])
    place = (least & mask).astype(np.int64)
    start = np.arange(len(place))
    doc = np.searchsorted(offsets, start, side="right") - 1
    inside = start + length <= offsets[doc + 1]
    start, place, doc = start[inside], place[inside], doc[inside]
    if not len(start):
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])]))
    first, last = start[new], start[np.concatenate([new[1:] - 1, [len(start) - 1]])]
    at, doc = place[new], doc[new]
    context = (running[last + length] - running[first]) * powers(n, inverse=True)[first]
    context = scramble(context + scramble((at - first).astype(np.uint64) * np.uint64(1 << 20) + (last - first).astype(np.uint64)))
    return doc, first, last, at, grams[at], context


def _stretches(column: pa.Array, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Pieces of a column as (row, byte shift, bytes, offsets); very long texts in stretches that share length - 1 bytes."""
    most = 1 << PLACE_BITS
    for row, data, offsets in pieces(column):
        if len(data) <= most:
            yield row, 0, data, offsets
        else:  # a single text
            for shift in range(0, len(data) - length + 1, most - length + 1):
                part = data[shift:shift + most]
                yield row, shift, part, np.array([0, len(part)])


def _anchor_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[bytes] = set()
    names = ["anchor", "context", "text_key", "first", "last", "at"]
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            keys = batch.column("text_key").slice(start, 500).to_pylist()
            fresh = []
            for i, key in enumerate(keys):
                if key not in seen:
                    if len(seen) < REMEMBERED_TEXTS:
                        seen.add(key)
                    fresh.append(i)
            if not fresh:
                continue
            texts = batch.column("text").slice(start, 500).take(pa.array(fresh))
            key_column = pa.array([keys[i] for i in fresh], pa.binary())
            for row, shift, data, offsets in _stretches(texts, LENGTH):
                doc, first, last, at, gram, context = anchors(data, offsets)
                base = offsets[doc] - shift
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram.view(np.int64)), pa.array(context.view(np.int64)), key_column.take(pa.array(doc + row)),
                     pa.array((first - base).astype(np.int32)), pa.array((last - base).astype(np.int32)),
                     pa.array((at - base).astype(np.int32))], names)


def _piece_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of texts with the contexts asked for: rows (core, left, right, text_key, first, last, many)."""
    names = ["core", "left", "right", "text_key", "first", "last", "many"]
    for batch in batches:
        for row in range(batch.num_rows):
            text = batch.column("text")[row].as_py().encode()
            key = batch.column("text_key")[row].as_py()
            out = []
            for c in batch.column("contexts")[row].as_py():
                at = c["at"]
                # Window starts at - j; piece q has j from q * STEP to q * STEP + STEP - 1.
                near, far = at - c["last"], at - c["first"]
                for q in range(near // STEP, far // STEP + 1):
                    lo, hi = max(near, q * STEP), min(far, q * STEP + STEP - 1)
                    core_from, core_to = at - q * STEP, at - q * STEP - STEP + 1 + LENGTH
                    core = xxhash.xxh3_128_digest(text[core_from:core_to], seed=(c["anchor"] ^ (q * 2654435761 + STEP)) & (2 ** 64 - 1))
                    out.append((core, text[at - hi:core_from], text[core_to:at - lo + LENGTH], key, at - hi, at - lo, c["many"]))
            columns = list(zip(*out)) if out else [()] * 7
            kinds = [pa.binary()] * 4 + [pa.int32()] * 2 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)


def repeated_windows(groups: list[list[tuple[bytes, bytes]]]) -> list[list[list[int]]]:
    """For each group of distinct (left, right) around one core: for each, the window starts, as places in ``left``, that another has.

    Letters: 1 ends a piece, bytes are 2 to 257, and each group's core is a letter of its own.
    """
    text: list[int] = []
    starts = []
    for g, group in enumerate(groups):
        for left, right in group:
            starts.append(len(text))
            text += [x + 2 for x in left]
            text.append(258 + g)
            text += [x + 2 for x in right]
            text.append(1)
    longest = neighbour_overlaps(text, suffix_array(text))
    out, k = [], 0
    for group in groups:
        found = []
        for left, right in group:
            windows = len(left) + len(right) - (STEP - 1) + 1  # window starts in this piece
            # A window is the core's letter and STEP - 1 bytes beside it.
            found.append([x for x in range(windows) if longest[starts[k] + x] >= STEP])
            k += 1
        out.append(found)
    return out


def _array_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pieces sorted by (core, left, right): (text_key, first, last) of repeated windows."""
    def settle(waiting: list[list[tuple]]) -> pa.RecordBatch:
        out, distinct = [], []
        for rows in waiting:
            have: dict[tuple[bytes, bytes], list[tuple]] = {}
            for _, left, right, key, first, last in rows:
                have.setdefault((left, right), []).append((key, first, last))
            distinct.append(have)
            out += [x for same in have.values() if len(same) > 1 for x in same]  # equal pieces: all their windows
        groups = [g for g in distinct if len(g) > 1]
        while groups:
            now, letters = [], 0
            while groups and (not now or letters < LETTERS):
                now.append(groups.pop())
                letters += 2 * (STEP + 1) * len(now[-1])
            for have, found in zip(now, repeated_windows([list(g) for g in now])):
                for same, places in zip(have.values(), found):
                    if len(same) == 1:
                        key, first, _ = same[0]
                        out += [(key, first + x, first + x) for x in places]
        columns = list(zip(*out)) if out else [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int32(), pa.int32()))],
                                          ["text_key", "first", "last"])

    waiting: list[list[tuple]] = []
    held = 0
    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in ("core", "left", "right", "text_key", "first", "last")]):
            if waiting and waiting[-1][0][0] == row[0]:
                waiting[-1].append(row)
            else:
                if waiting and len(waiting[-1]) == 1:
                    waiting.pop()
                if held > 20_000:
                    yield settle(waiting)
                    waiting, held = [], 0
                waiting.append([row])
            held += 1
    if waiting and len(waiting[-1]) == 1:
        waiting.pop()
    yield settle(waiting)


def _cut(text: bytes, intervals: list[tuple[int, int]], length: int = LENGTH) -> tuple[int, int, bytes]:
    """(removed bytes, removed runs, the bytes left) when all windows starting within the intervals go."""
    left, removed, runs, at, end = [], 0, 0, 0, -1
    for first, last in sorted(intervals):
        to = last + length
        if first > end:
            left.append(text[at:first])
            runs += 1
            removed += to - first
            at = end = to
        elif to > end:
            removed += to - end
            at = end = to
    left.append(text[at:])
    return removed, runs, b"".join(left)


def _cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["text_key", "n_removed", "n_spans", "kept"]
    for batch in batches:
        out = []
        for key, text, cuts in zip(*[batch.column(c).to_pylist() for c in ("text_key", "text", "cuts")]):
            out.append((key, *_cut(text.encode(), [(c["first"], c["last"]) for c in cuts])))
        columns = list(zip(*out)) if out else [()] * 4
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)


def _repeated_of_many(cut: DataFrame) -> list[DataFrame]:
    """Repeated windows in pieces of anchors with many contexts, by aggregations: rows (text_key, first, last)."""
    whole = ["core", "left", "right"]
    distinct = durable(cut.groupBy(*whole).agg(
        F.count(F.lit(1)).alias("times"), F.min(F.struct("text_key", "first", "last")).alias("one")), "distinct-pieces")
    equal = cut.join(distinct.where("times > 1").select(*whole), whole, "left_semi").select("text_key", "first", "last")
    varied = distinct.groupBy("core").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("core")
    # A window is the core and STEP - 1 bytes beside it, the last of ``left`` and the first of ``right``.
    windows = distinct.join(varied, "core", "left_semi").select(
        "core", "left", "right", "times", "one.text_key", "one.first",
        F.explode(F.sequence(F.lit(0), F.col("one.last") - F.col("one.first"))).alias("i"))
    beside = F.octet_length("left") - F.col("i")
    windows = durable(windows.select(
        "core", F.substring("left", F.col("i") + 1, beside).alias("left"),
        F.substring("right", F.lit(1), F.lit(STEP - 1) - beside).alias("right"),
        "times", "text_key", (F.col("first") + F.col("i")).alias("start")), "windows-of-many")
    twice = windows.groupBy(*whole).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*whole)
    # Pieces that occur twice have gone as a whole already.
    single = windows.where("times = 1").join(twice, whole, "left_semi").select(
        "text_key", F.col("start").alias("first"), F.col("start").alias("last"))
    return [equal, single]


def repeated_intervals(texts: DataFrame) -> DataFrame:
    """Stored rows (text_key, first, last): windows that start there occur elsewhere. ``texts`` has (text_key, text)."""
    spark = texts.sparkSession
    found = durable(texts.where(F.octet_length("text") >= LENGTH).mapInArrow(
        _anchor_batches, "anchor long, context long, text_key binary, first int, last int, at int"), "anchors")
    shared = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    rows = durable(found.join(shared, "anchor"), "shared-anchors")
    # A text met in two tasks gives a row twice; it goes as a whole anyway.
    contexts = rows.groupBy("anchor", "context").agg(
        F.count(F.lit(1)).alias("times"), F.min(F.struct("text_key", "first", "last", "at")).alias("one"))
    contexts = durable(contexts, "contexts")
    whole = rows.join(contexts.where("times > 1").select("anchor", "context"), ["anchor", "context"]).select(
        "text_key", "first", "last")
    kinds = contexts.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    asked = durable(contexts.join(kinds, "anchor").select(
        "one.text_key", F.struct("anchor", "one.first", "one.last", "one.at", (F.col("kinds") > MANY).alias("many")).alias("c")),
        "asked-contexts")
    wanted = durable(asked.select("text_key").distinct(), "asked-texts")
    sources = keep_keys(texts, wanted, "text_key").groupBy("text_key").agg(F.first("text").alias("text"))
    cut = sources.join(asked.groupBy("text_key").agg(F.collect_list("c").alias("contexts")), "text_key").mapInArrow(
        _piece_batches, "core binary, left binary, right binary, text_key binary, first int, last int, many boolean")
    cut = durable(cut, "pieces")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_array = (cut.where("not many").repartition(parts, "core").sortWithinPartitions("core", "left", "right")
                .mapInArrow(_array_batches, "text_key binary, first int, last int"))
    found = whole.unionByName(by_array)
    if not kinds.where(F.col("kinds") > MANY).isEmpty():
        for part in _repeated_of_many(cut.where("many")):
            found = found.unionByName(part)
    return durable(found, "repeated")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document (doc_id, n_bytes, n_removed, n_spans, kept): ``kept`` are the bytes left, NULL where all of the text is."""
    texts = docs.select(text_key(text_col).alias("text_key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = durable(docs.select(F.col(id_col).alias("doc_id"), text_key(text_col).alias("text_key"),
                               F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_bytes")), "text-rows")
    copies = rows.groupBy("text_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("text_key")
    intervals = repeated_intervals(texts)
    cuts = intervals.join(copies, "text_key", "left_anti").groupBy("text_key").agg(
        F.collect_set(F.struct("first", "last")).alias("cuts"))
    cuts = durable(cuts, "cuts")
    hit = durable(cuts.select("text_key"), "cut-texts")
    short = durable(keep_keys(texts, hit, "text_key").join(cuts, "text_key").select("text_key", "text", "cuts").mapInArrow(
        _cut_batches, "text_key binary, n_removed long, n_spans long, kept binary"), "cut")
    gone = rows.join(copies, "text_key", "left_semi").where(F.col("n_bytes") >= LENGTH).select(
        "text_key", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"),
        F.unhex(F.lit("")).alias("kept")).distinct()
    changed = short.unionByName(gone)
    return rows.join(changed, "text_key", "left").select(
        "doc_id", "text_key", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"), "kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    whole = docs.select(text_key().alias("text_key"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("whole_sha256"))
    cut = remove_repeats(docs)
    # Texts that keep all their bytes need only their own digest.
    digests = durable(whole.distinct(), "whole-digests")
    return cut.join(digests, "text_key").select(
        "doc_id", "n_bytes", "n_removed", "n_spans",
        F.coalesce(F.sha2("kept", 256), F.col("whole_sha256")).alias("kept_sha256"))
