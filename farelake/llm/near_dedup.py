"""Near-duplicate documents: Jaccard join of word shingles by part-enumeration signatures.

1. Each document becomes its set of shingle hashes; equal sets share a set key.
   The same pass counts frequent signatures, with a fixed number of counters a
   task.
2. Signatures (``partenum``) are made once for each set key and task and
   shuffled; those of one set only are dropped. Signatures found frequent are
   shared for certain: their rows are dealt out by set.
3. Star step: in each bucket of a signature, every set is compared with one
   pivot, the set met most often in shared buckets. A sketch of counts bounds the
   difference from below and drops most pairs; the others are verified on
   the sets themselves. Verified pairs are links.
4. Rest: in buckets whose sets are not all in one component by now, the sets
   outside the largest component are compared with all others by their sketches,
   in blocks of bounded size; what may be similar is verified. Buckets of one
   pivot are taken together, so a pair is compared about once.
5. Components of all links, and of all documents with equal sets.

Sets linked already are not compared again; no pair that shares a signature in
two components is left out, so the components are those of the full join.

Defined results: a NULL or empty text and one of white space only has no
shingles, is linked with nothing and is its own component. Fewer words than a
shingle make one shingle of the whole sequence. A component's id is its smallest
doc_id; rows with equal doc_id and rows with a NULL id are judged by their own
text (NULL only where all ids of a component are NULL). Other columns are not
looked at. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from farelake.llm.common import keep_keys, packed, small_batches, table, text_key
from farelake.llm.components import components
from farelake.llm.partenum import signatures
from farelake.llm.shingles import document_sets
from farelake.session import durable

SHINGLE_WORDS = 5
PERCENT = 75
# Set keys that one task remembers, to sign equal sets once.
REMEMBERED_SETS = 1_000_000
# Members of the sets in one block, about as many bytes of sketches.
BLOCK_MEMBERS = 400_000
HOT_SIGNATURES = 1000
# Signatures that a task counts at once, whatever the size of its batches.
SIGNATURES_AT_ONCE = 1 << 20


def _set_key(members: np.ndarray) -> int:
    """A 64-bit key of a set: its hashes, mixed in sorted order."""
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(members.tobytes())).view(np.int64))


def sketch(members: np.ndarray) -> np.ndarray:
    """How many of the hashes fall into each of 2 ** k equal ranges, k so that there are about as many ranges as members.

    Two sets differ in at least as many members as the counts differ in sum; sketches of different length are
    compared after adding up neighbouring ranges of the longer.
    """
    bits = max(4, int(len(members) - 1).bit_length())
    counts = np.bincount((members >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.minimum(counts, 255).astype(np.uint8)


def _folded(counts: np.ndarray, length: int) -> np.ndarray:
    return counts.reshape(length, -1).sum(1, dtype=np.int32) if len(counts) > length else counts.astype(np.int32)


def _may_link(n_a, n_b, differ, percent: int):
    """False where sets of these sizes that differ in at least so many members can't be similar."""
    return ((100 + percent) * differ <= (100 - percent) * (n_a + n_b)) & (100 * n_a >= percent * n_b) & (100 * n_b >= percent * n_a)


def _likely_batches(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of pairs (a, b, n_a, n_b, x, y) with sketches x and y those that may be similar."""
    for batch in batches:
        n_a, n_b = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
        differ = np.zeros(batch.num_rows, np.int64)
        xs, ys = batch.column("x"), batch.column("y")
        for i in range(batch.num_rows):
            x, y = np.frombuffer(xs[i].as_buffer(), np.uint8), np.frombuffer(ys[i].as_buffer(), np.uint8)
            length = min(len(x), len(y))
            differ[i] = np.abs(_folded(x, length) - _folded(y, length)).sum()
        keep = pa.array(_may_link(n_a, n_b, differ, percent))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(keep)


def _counted(frequent: dict[int, int], signs: list[np.ndarray]) -> dict[int, int]:
    """The counters with those of ``signs`` that are met more than once."""
    if not signs:
        return frequent
    sign, met = np.unique(np.concatenate(signs), return_counts=True)
    for x, c in zip(sign[met > 1].view(np.int64).tolist(), met[met > 1].tolist()):
        frequent[x] = frequent.get(x, 0) + c
    if len(frequent) > 20 * HOT_SIGNATURES:  # all counters go down by the same, as in Misra-Gries
        less = sorted(frequent.values())[-10 * HOT_SIGNATURES]
        frequent = {x: c - less for x, c in frequent.items() if c > less}
    return frequent


def _key_batches(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Set size and key of each document; then the task's frequent signatures, in rows without a text key."""
    seen: set[int] = set()
    frequent: dict[int, int] = {}
    signs: list[np.ndarray] = []
    waiting = 0
    names = ["doc_id", "text_key", "n_shingles", "set_key", "sketch", "sign", "met"]
    for batch in batches:
        keys, counts, sketches = [], [], []
        for _, members in document_sets(batch.column("text"), size):
            key = _set_key(members) if len(members) else None
            keys.append(key)
            counts.append(len(members))
            sketches.append(None)
            if key is not None and key not in seen:
                if len(seen) < REMEMBERED_SETS:
                    seen.add(key)
                sketches[-1] = sketch(members).tobytes()
                signs.append(signatures(members, percent))
                waiting += len(signs[-1])
                if waiting >= SIGNATURES_AT_ONCE:
                    frequent = _counted(frequent, signs)
                    signs, waiting = [], 0
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_key"), pa.array(counts, pa.int64()), pa.array(keys, pa.int64()),
             pa.array(sketches, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names)
    frequent = _counted(frequent, signs)
    top = sorted(frequent.items(), key=lambda x: -x[1])[:HOT_SIGNATURES]
    n = len(top)
    yield pa.RecordBatch.from_arrays(
        [pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()),
         pa.nulls(n, pa.binary()), pa.array([x for x, _ in top], pa.int64()), pa.array([c for _, c in top], pa.int64())], names)


def _sign_batches(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """(sign, set_key) of the sets that the task meets, once each."""
    seen: set[int] = set()
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            keys, lists = [], []
            for _, members in document_sets(batch.column("text").slice(start, 500), size):
                key = _set_key(members) if len(members) else None
                if key is not None and key not in seen:
                    if len(seen) < REMEMBERED_SETS:
                        seen.add(key)
                    keys.append(key)
                    lists.append(signatures(members, percent))
            if keys:
                key = np.repeat(np.array(keys, np.int64), [len(x) for x in lists])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(lists).view(np.int64)), pa.array(key)], ["sign", "set_key"])


def _set_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            keys, lists = [], []
            for _, members in document_sets(batch.column("text").slice(start, 500), size):
                key = _set_key(members)
                if len(members) and key not in seen:
                    if len(seen) < REMEMBERED_SETS:
                        seen.add(key)
                    keys.append(key)
                    lists.append(members.view(np.int64))
            if keys:
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists)))],
                    ["set_key", "members"])


def _shared_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (sign, set_key, hot) sorted so: distinct rows of signatures that are hot or that two sets or more have.

    The last signature of a batch waits for the next batch; it is not hot, so its sets are few.
    """
    wait_s, wait_k = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def shared(sign: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
        new = np.ones(len(sign), bool)
        new[1:] = (sign[1:] != sign[:-1]) | (key[1:] != key[:-1])
        sign, key = sign[new], key[new]
        same = sign[1:] == sign[:-1]
        keep = np.zeros(len(sign), bool)
        keep[1:] |= same
        keep[:-1] |= same
        return pa.RecordBatch.from_arrays([pa.array(sign[keep]), pa.array(key[keep])], ["sign", "set_key"])

    for batch in batches:
        sign, key = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        hot = batch.column(2).to_numpy(zero_copy_only=False)
        if hot.any():
            yield pa.RecordBatch.from_arrays([pa.array(sign[hot]), pa.array(key[hot])], ["sign", "set_key"])
            sign, key = sign[~hot], key[~hot]
        sign, key = np.concatenate([wait_s, sign]), np.concatenate([wait_k, key])
        if not len(sign):
            continue
        cut = int(np.searchsorted(sign, sign[-1]))
        wait_s, wait_k = sign[cut:], key[cut:]
        if len(wait_k) > 1:  # a row and its repetitions need no more than one place
            new = np.concatenate([[True], wait_k[1:] != wait_k[:-1]])
            wait_s, wait_k = wait_s[new], wait_k[new]
        if cut:
            yield shared(sign[:cut], key[:cut])
    if len(wait_s):
        yield shared(wait_s, wait_k)


def _compare_block(group: pa.Table, percent: int) -> pa.Table:
    """Pairs of a set of side 0 and one of side 1 that are in different components and may be similar by their sketches."""
    side = group.column("side").to_numpy()
    key, comp, n = (group.column(c).to_numpy() for c in ("set_key", "component", "n"))
    counts = [np.frombuffer(x.as_buffer(), np.uint8) for x in group.column("sketch").combine_chunks()]
    length = min(map(len, counts))
    flat = np.stack([_folded(x, length) for x in counts])
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    others = flat[right].astype(np.int16) if flat.max(initial=0) < 30_000 else flat[right]
    for i in left:
        apart = comp[right] != comp[i]
        apart &= (100 * n[right] >= percent * n[i]) & (100 * n[i] >= percent * n[right])
        at = np.flatnonzero(apart)
        if len(at):
            differ = np.abs(others[at] - flat[i].astype(others.dtype)).sum(1, dtype=np.int64)
            hit = right[at[_may_link(n[i], n[right[at]], differ, percent)]]
            found_a.append(np.full(len(hit), key[i]))
            found_b.append(key[hit])
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text_col).alias("text_key"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def shared_signatures(texts: DataFrame, keyed: DataFrame, size: int, percent: int) -> DataFrame:
    """Stored rows (sign, set_key) of signatures with two sets or more, or hot ones."""
    spark = texts.sparkSession
    documents = keyed.where("text_key is not null").count()
    # At most HOT_SIGNATURES numbers. A signature of a thousandth of the documents is hot.
    met = F.sum("met")
    hot = [r[0] for r in keyed.where("sign is not null").groupBy("sign").agg(met.alias("met"))
           .where(F.col("met") * HOT_SIGNATURES >= documents + 20 * HOT_SIGNATURES)
           .orderBy(F.desc("met"), "sign").limit(HOT_SIGNATURES).select("sign").collect()]
    is_hot = F.col("sign").isin(hot) if hot else F.lit(False)
    rows = texts.select("text").mapInArrow(partial(_sign_batches, size=size, percent=percent), "sign long, set_key long")
    # A hot signature is shared for certain: its rows are dealt by set, and pass.
    dealt = rows.withColumn("turn", F.when(is_hot, F.xxhash64("set_key")).otherwise(F.col("sign"))).withColumn("hot", is_hot)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = dealt.repartition(parts, "turn").drop("turn").sortWithinPartitions("sign", "set_key").mapInArrow(
        _shared_batches, "sign long, set_key long")
    return durable(shared.distinct() if hot else shared, "shared-signs")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS,
                percent: int = PERCENT) -> DataFrame:
    """Per document (doc_id, text_key, n_shingles, set_key, component_id)."""
    small_batches(docs.sparkSession)
    texts = _texts(docs, id_col, text_col)
    keyed = durable(texts.mapInArrow(
        partial(_key_batches, size=size, percent=percent),
        "doc_id long, text_key binary, n_shingles long, set_key long, sketch binary, sign long, met long"), "set-keys")
    shared = shared_signatures(texts, keyed, size, percent)
    signed = keyed.where("text_key is not null").drop("sign", "met", "sketch")
    sketches = (keyed.where("sketch is not null").select("set_key", F.col("n_shingles").alias("n"), "sketch")
                .join(shared.select("set_key").distinct(), "set_key", "left_semi").dropDuplicates(["set_key"]))
    sketches = durable(sketches, "sketches")

    # Star step.
    buckets = shared.groupBy("sign").agg(F.count(F.lit(1)).alias("n"))
    weights = shared.join(buckets, "sign").groupBy("set_key").agg(F.sum("n").alias("weight"))
    pivots = durable(shared.join(weights, "set_key").groupBy("sign").agg(
        F.max(F.struct("weight", "set_key")).getField("set_key").alias("pivot")), "pivots")
    pairs = (shared.join(pivots, "sign").where(F.col("set_key") != F.col("pivot"))
             .select(F.col("set_key").alias("a"), F.col("pivot").alias("b")).distinct())
    left = sketches.select(F.col("set_key").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("x"))
    right = sketches.select(F.col("set_key").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("y"))
    likely = pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "x", "y").mapInArrow(
        partial(_likely_batches, percent=percent), "a long, b long")
    links = _verified(likely, docs, signed, text_col, size, percent)

    # What the stars leave open.
    stars = components(links)
    placed = (shared.join(pivots, "sign").where(F.col("set_key") != F.col("pivot"))
              .join(stars.withColumnRenamed("node", "set_key"), "set_key", "left")
              .select("sign", "pivot", "set_key", F.coalesce("component", "set_key").alias("component")))
    open_signs = (placed.groupBy("sign").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
                  .where(F.col("lo") != F.col("hi")).select("sign"))
    open_rows = durable(placed.join(open_signs, "sign").select("pivot", "set_key", "component").distinct(),
                        "open-sets")
    more = _verified(_open_pairs(open_rows, sketches, percent), docs, signed, text_col, size, percent)
    comps = components(links.unionByName(more))

    by_set = (signed.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("least"))
              .join(comps.withColumnRenamed("node", "set_key"), "set_key", "left")
              .withColumn("component", F.coalesce("component", "set_key")))
    least = by_set.groupBy("component").agg(F.min("least").alias("component_id"))
    named = by_set.join(least, "component").select("set_key", "component", "component_id")
    return (signed.join(named, "set_key", "left")
            .withColumn("component_id", F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))))


def _verified(pairs: DataFrame, docs: DataFrame, signed: DataFrame, text_col: str, size: int, percent: int) -> DataFrame:
    """Stored pairs (a, b) of set keys whose sets are similar; the sets are made anew from one text each."""
    pairs = durable(pairs.distinct(), "likely-pairs")
    wanted = pairs.select(F.col("a").alias("set_key")).unionByName(pairs.select(F.col("b").alias("set_key"))).distinct()
    keys = durable(signed.join(wanted, "set_key").groupBy("set_key").agg(F.min("text_key").alias("text_key"))
                   .select("text_key").distinct(), "wanted-texts")
    rows = docs.select(text_key(text_col).alias("text_key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sets = durable(keep_keys(rows, keys, "text_key").select("text").mapInArrow(
        partial(_set_batches, size=size), "set_key long, members array<long>").dropDuplicates(["set_key"]), "sets")
    left = sets.select(F.col("set_key").alias("a"), F.col("members").alias("x"))
    right = sets.select(F.col("set_key").alias("b"), F.col("members").alias("y"))
    both = pairs.join(left, "a").join(right, "b").withColumn("i", F.size(F.array_intersect("x", "y")))
    return durable(both.where(F.col("i") * 100 >= (F.size("x") + F.size("y") - F.col("i")) * percent).select("a", "b"),
                   "verified")


def _open_pairs(open_rows: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets of one pivot's buckets that are in different components and may be similar."""
    sized = open_rows.join(sketches.select("set_key", "n"), "set_key")
    by_comp = sized.groupBy("pivot", "component").agg(F.sum("n").alias("n"))
    main = by_comp.groupBy("pivot").agg(
        F.max(F.struct("n", "component")).getField("component").alias("main"), F.sum("n").alias("all_n"))
    outside_n = sized.join(main, "pivot").where(F.col("component") != F.col("main")).groupBy("pivot").agg(
        F.sum("n").alias("out_n"))
    blocks = lambda n: (F.col(n) / F.lit(BLOCK_MEMBERS)).cast("int") + 1
    plan = main.join(outside_n, "pivot").select("pivot", "main", blocks("out_n").alias("xs"), blocks("all_n").alias("ys"))
    sized = open_rows.join(plan, "pivot").withColumn("outside", F.col("component") != F.col("main"))
    turn = F.xxhash64("set_key")
    xs = sized.where("outside").select(
        "pivot", "set_key", "component", F.pmod(turn, F.col("xs")).cast("int").alias("xb"),
        F.explode(F.sequence(F.lit(0), F.col("ys") - 1)).alias("yb"), F.lit(0).alias("side"))
    ys = sized.select(
        "pivot", "set_key", "component", F.explode(F.sequence(F.lit(0), F.col("xs") - 1)).alias("xb"),
        F.pmod(turn, F.col("ys")).cast("int").alias("yb"), F.lit(1).alias("side"))
    members = xs.unionByName(ys).join(sketches, "set_key")
    return members.groupBy("pivot", "xb", "yb").applyInArrow(
        lambda group: _compare_block(group, percent), "a long, b long")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each group of near copies: the one with the smallest id (NULL last), then text key.

    Documents without shingles all stay. Of rows equal in id and text one stays.
    """
    groups = near_groups(docs, id_col, text_col, **options).where("set_key is not null")
    rows = durable(groups.groupBy(F.coalesce("component", "set_key").alias("component"), "doc_id", "text_key").agg(
        F.count(F.lit(1)).alias("n")), "near-rows")
    best = rows.groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("best"))
    marked = rows.join(best, "component").select(
        "n", _row_key(F.col("doc_id"), F.col("text_key")).alias("row_key"),
        (F.col("best.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("best.text_key") == F.col("text_key"))).alias("stays"))
    marked = durable(marked, "near-marks")
    losers = marked.where(~F.col("stays")).select("row_key")
    again = marked.where("stays and n > 1").select("row_key")
    keyed = docs.select(packed(docs).alias("row"), _row_key(F.col(id_col).cast("long"), text_key(text_col)).alias("row_key"))
    kept = keep_keys(keyed, losers, "row_key", drop=True)
    once = keep_keys(kept, again, "row_key", drop=True)
    more = keep_keys(kept, again, "row_key").groupBy("row_key").agg(F.first("row").alias("row"))
    return once.select("row.*").unionByName(more.select("row.*"))


def _row_key(doc_id: Column, key: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("null")), F.hex(key))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') as w from documents),
sets as materialized (
  select doc_id, case when len(w) = 0 then []::varchar[] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from words),
items as materialized (select doc_id, len(s) as n, unnest(s) as g from sets),
links as materialized (
  select x.doc_id as a, y.doc_id as b from items x join items y on x.g = y.g and x.doc_id <> y.doc_id
    and 100 * least(x.n, y.n) >= 75 * greatest(x.n, y.n)
  group by x.doc_id, y.doc_id, x.n, y.n having 100 * count(*) >= 75 * (x.n + y.n - count(*))),
reach as (
  select doc_id, doc_id as other from sets
  union
  select r.doc_id, l.b from reach r join links l on r.other = l.a)
select s.doc_id, len(s.s)::bigint as n_shingles, r.component_id
from sets s join (select doc_id, min(other) as component_id from reach group by doc_id) r on s.doc_id = r.doc_id
"""
