"""Benchmark decontamination: BM25 over test items, block-max WAND, overlap check.

The test items are the indexed side, the training corpus asks. An item's words
(runs of letters and digits, A-Z lower-cased) get BM25 weights, divided by the
score the item gives itself, so that 1 is a whole copy. Items longer than
``SEGMENT`` words are indexed by segments of even length. Postings stand in blocks of
``BLOCK`` segments, and each term keeps its largest weight in each block.

Every document is cut into passages of two segment lengths, each starting one
segment length after the one before, so a segment copied anywhere lies whole in
one passage. A passage for which no block's maxima reach the threshold together is
left out first. The others walk the postings by block-max WAND: a pivot where
the terms' largest weights reach the threshold, a leap over the block where its
maxima do not, a full score only where they do. All segments at or above the threshold are retrieved.

An item counts as found when question and answer are really there: a share of the
word trigrams of its question part and of its answer part (its last sentence, or
last quarter) must occur in the passages its segments were found in. A part of one or two
words is compared as a run of its length; an answer so short, together with the
question's last words.

The index goes to the tasks in slices of at most ``SLICE_BYTES`` of item text (or one
item that is longer); more items mean more passes over the corpus, not larger ones.

Defined results: NULL or empty texts and items match nothing. Repeated items count
once, different texts of one id are items of their own. Rows of documents equal in id and
text give a row each. Other columns are not looked at. With no items or no documents there are no rows.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from farelake.llm.common import item_slices, keep_keys, packed, small_batches, table, text_key
from farelake.llm.shingles import PUNCTUATION, _PLACE, pieces, scramble, word_hashes
from farelake.session import durable

SEGMENT = 64
BLOCK = 4
K1, B = 1.2, 0.75
THRESHOLD = 0.6
QUESTION_SHARE = 0.6
ANSWER_SHARE = 0.6
SLICE_BYTES = 6 << 20
# Words of a run compared by the overlap check.
RUN = 3
# Sums of block maxima held together for the passages of a document.
CELLS = 1 << 20
# A score that misses the threshold by rounding alone reaches it.
ROUNDING = 1e-9


def _runs(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the word runs of ``size``, in order; none when there are fewer words."""
    if not 0 < size <= len(words):
        return np.zeros(0, np.uint64)
    h = words[:len(words) - size + 1] * _PLACE[0]
    for k in range(1, size):
        h = h + words[k:len(words) - size + 1 + k] * _PLACE[k]
    return scramble(h)


def _part(words: np.ndarray) -> tuple[int, np.ndarray]:
    """(run size, distinct runs) of a part: of three words, or of its own length where it is shorter."""
    size = min(RUN, len(words))
    return size, np.unique(_runs(words, size))


def words_of(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return word_hashes(data, np.array([0, len(data)]), PUNCTUATION)[0]


def answer_words(text: str, n_words: int) -> int:
    """Number of words at the end that are the item's answer: its last sentence, else its last quarter."""
    body = text.rstrip().rstrip(".!?")
    cut = max(body.rfind(mark) for mark in (". ", "? ", "! ", "\n"))
    tail = len(words_of(body[cut + 1:])) if cut >= 0 else 0
    return tail if 0 < tail <= n_words // 2 else max(1, n_words // 4)


LEAK_ROWS = ("doc_id long, text_key binary, item_id long, score double, question_overlap double, answer_overlap double, "
             "first_word long, last_word long, passages long")


class Index:
    """Block-max BM25 index of item segments; weights are shares of a segment's score for itself.

    ``question`` and ``answer`` hold each segment's parts as (run size, runs),
    ``runs_of`` the number of runs of either part of each whole item.
    """

    def __init__(self, items: list[tuple[int, str]], df: dict[int, int], n_items: int, mean_words: float,
                 segment: int = SEGMENT, block: int = BLOCK):
        self.segment, self.block = segment, block
        self.item_ids, self.item_of, self.question, self.answer, self.runs_of = [], [], [], [], []
        postings: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for item_id, text in items:
            words = words_of(text)
            n = len(words)
            if not n:
                continue
            split = n - answer_words(text, n) if n > 1 else n
            # Segments of even length, none longer than ``segment``: no tail is left over.
            cuts = np.linspace(0, n, -(-n // segment) + 1).astype(int).tolist()
            totals = np.zeros(2, np.int64)
            for low, high in zip(cuts, cuts[1:]):
                part, at = words[low:high], len(self.item_of)
                terms, tf = np.unique(part, return_counts=True)
                idf = np.array([math.log(1 + (n_items - df.get(int(t), 1) + 0.5) / (df.get(int(t), 1) + 0.5)) for t in terms])
                weight = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(part) / mean_words))
                for term, w in zip(terms, weight / weight.sum()):
                    postings[int(term)].append((at, float(w)))
                turn = min(max(split - low, 0), len(part))
                # An answer of one or two words is looked for behind the question's last words.
                begin = max(0, min(turn, len(part) - RUN)) if turn < len(part) else turn
                self.item_of.append(len(self.item_ids))
                self.question.append(_part(part[:turn]))
                self.answer.append(_part(part[begin:]))
                totals += len(self.question[-1][1]), len(self.answer[-1][1])
            self.item_ids.append(item_id)
            self.runs_of.append(tuple(totals.tolist()))
        self.terms = np.array(sorted(postings), np.uint64)
        self.postings = [postings[int(t)] for t in self.terms]
        self.blocks = -(-len(self.item_of) // block)
        # Block maxima as flat arrays: term i has entries starts[i]:starts[i + 1], and its largest weight of all in most[i].
        starts, places, tops = [0], [], []
        for posting in self.postings:
            best: dict[int, float] = {}
            for at, w in posting:
                best[at // block] = max(w, best.get(at // block, 0.0))
            for b in sorted(best):
                places.append(b)
                tops.append(best[b])
            starts.append(len(places))
        self.starts, self.places, self.tops = np.array(starts), np.array(places, np.int64), np.array(tops)
        self.tops_of = [dict(zip(places[low:high], tops[low:high])) for low, high in zip(starts, starts[1:])]
        self.segments = [[at for at, _ in posting] for posting in self.postings]
        self.most = [max(w for _, w in posting) for posting in self.postings]

    def candidates(self, words: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
        """(passage number, its distinct indexed terms) where some block's maxima reach the threshold together.

        All other passages have no hit and are not walked. Passages are taken
        so many at a time that about ``CELLS`` sums of blocks, or those of one passage, are held.
        """
        if not len(self.terms):
            return
        at = np.searchsorted(self.terms, words)
        at[at == len(self.terms)] = 0
        hit = np.flatnonzero(self.terms[at] == words)
        if not len(hit):
            return
        term, place = at[hit], hit // self.segment
        v = len(self.terms)
        both = np.unique(np.concatenate([place * v + term, np.maximum(place - 1, 0) * v + term]))
        passage, term = both // v, both % v
        n = self.starts[term + 1] - self.starts[term]
        first = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
        bounds = np.append(first, len(term))
        # Runs of passages with about CELLS sums, or one passage.
        load = np.cumsum(np.maximum(np.add.reduceat(n, first), self.blocks)) // CELLS
        edges = np.append(np.flatnonzero(np.diff(load, prepend=-1)), len(first))
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
            span = slice(bounds[low], bounds[high])
            t, m = term[span], n[span]
            row = np.repeat(np.arange(high - low), np.diff(bounds[low:high + 1]))
            flat = np.repeat(self.starts[t] - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())
            bound = np.bincount(np.repeat(row, m) * self.blocks + self.places[flat], weights=self.tops[flat],
                                minlength=(high - low) * self.blocks).reshape(high - low, self.blocks)
            for k in (low + np.flatnonzero(bound.max(axis=1) >= threshold - ROUNDING)).tolist():
                yield int(passage[first[k]]), term[bounds[k]:bounds[k + 1]]

    def wand(self, terms: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """(segment, score) of all segments at or above the threshold, for distinct query terms.

        Cursors stand in the terms' postings. The pivot is the first segment that
        the terms up to it could lift to the threshold; where the maxima of its
        block cannot, all of them leap to the next block or to the next term's segment.
        """
        need = threshold - ROUNDING
        cursors = [[self.segments[t][0], 0, t] for t in terms.tolist()]  # segment, place in the postings, term
        found = []

        def leap(cursor: list, to: int) -> bool:
            own = self.segments[cursor[2]]
            cursor[1] = bisect_left(own, to, cursor[1])
            if cursor[1] < len(own):
                cursor[0] = own[cursor[1]]
                return True
            return False

        while cursors:
            cursors.sort()
            bound, last = 0.0, None
            for k, (_, _, t) in enumerate(cursors):
                bound += self.most[t]
                if bound >= need:
                    last = k
                    break
            if last is None:
                break
            pivot = cursors[last][0]
            while last + 1 < len(cursors) and cursors[last + 1][0] == pivot:
                last += 1
            block = pivot // self.block
            if sum(self.tops_of[t].get(block, 0.0) for _, _, t in cursors[:last + 1]) < need:
                to = (block + 1) * self.block
                if last + 1 < len(cursors):
                    to = min(to, cursors[last + 1][0])
                cursors = [c for k, c in enumerate(cursors) if k > last or leap(c, to)]
            elif cursors[0][0] == pivot:
                score = sum(self.postings[t][at][1] for _, at, t in cursors[:last + 1])
                if score >= need:
                    found.append((pivot, score))
                cursors = [c for k, c in enumerate(cursors) if k > last or leap(c, pivot + 1)]
            else:
                cursors = [c for c in cursors if c[0] >= pivot or leap(c, pivot)]
        return found

    def search(self, words: np.ndarray, threshold: float) -> Iterator[tuple[int, float, int]]:
        """(segment, score, passage number) of everything at or above the threshold."""
        for p, terms in self.candidates(words, threshold):
            for s, score in self.wand(terms, threshold):
                yield s, score, p


class _Found:
    """What a document holds of one item."""

    def __init__(self):
        self.score, self.low, self.high, self.passages, self.parts = 0.0, 1 << 62, 0, 0, {}

    def add(self, segment: int, score: float, low: int, high: int, runs: tuple[int, int]) -> None:
        self.score, self.low, self.high = max(self.score, score), min(self.low, low), max(self.high, high)
        self.passages += 1
        self.parts[segment] = max(self.parts.get(segment, (0, 0)), runs, key=sum)

    def shares(self, runs_of: tuple[int, int]) -> tuple[float, float]:
        """Shares of the item's question and answer runs that are there; an item of one word is all question."""
        have = [sum(p[k] for p in self.parts.values()) for k in (0, 1)]
        return tuple(h / n if n else 1.0 for h, n in zip(have, runs_of))


def found_in(words: np.ndarray, index: Index, threshold: float) -> dict[int, _Found]:
    """Item number -> what a document's words hold of the item, for all items with a retrieved segment."""
    found: dict[int, _Found] = {}
    held: tuple[int, dict[int, np.ndarray]] = (-1, {})
    for segment, score, passage in index.search(words, threshold):
        low, high = passage * index.segment, min(len(words), (passage + 2) * index.segment)
        if held[0] != passage:
            held = (passage, {})
        runs = []
        for size, part in (index.question[segment], index.answer[segment]):
            if size not in held[1]:
                held[1][size] = _runs(words[low:high], size)
            runs.append(int(np.isin(part, held[1][size]).sum()))
        found.setdefault(index.item_of[segment], _Found()).add(segment, score, low, high, tuple(runs))
    return found


def _leak_batches(batches: Iterator[pa.RecordBatch], index, threshold: float, question_share: float,
                  answer_share: float) -> Iterator[pa.RecordBatch]:
    index = index.value
    names = ["doc_id", "text_key", "item_id", "score", "question_overlap", "answer_overlap", "first_word", "last_word",
             "passages"]
    for batch in batches:
        ids, keys = batch.column("doc_id"), batch.column("text_key")
        rows = []
        for first, data, offsets in pieces(batch.column("text")):
            words, bounds = word_hashes(data, offsets, PUNCTUATION)
            for k in range(len(offsets) - 1):
                for item, f in found_in(words[bounds[k]:bounds[k + 1]], index, threshold).items():
                    question, answer = f.shares(index.runs_of[item])
                    if question >= question_share and answer >= answer_share:
                        rows.append((ids[first + k].as_py(), keys[first + k].as_py(), index.item_ids[item], f.score, question,
                                     answer, f.low, f.high, f.passages))
        columns = list(zip(*rows)) if rows else [()] * len(names)
        kinds = [pa.int64(), pa.binary(), pa.int64(), *[pa.float64()] * 3, *[pa.int64()] * 3]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
          item_text: str = "text", threshold: float = THRESHOLD, question_share: float = QUESTION_SHARE,
          answer_share: float = ANSWER_SHARE) -> DataFrame:
    """A row for each document and item found in it, with score, overlaps and the span of passages in words."""
    spark = docs.sparkSession
    small_batches(spark)
    tests = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    tests = durable(tests.where("text is not null").distinct(), "benchmark-items")
    n = tests.count()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text_col).alias("text_key"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    term_rows = tests.mapInArrow(_term_batches, "item_id long, term long, words long")
    counted = term_rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    mean = term_rows.select("item_id", "words").distinct().agg(F.avg(F.least("words", F.lit(SEGMENT)))).first()[0] or 1.0
    found = None
    for here in item_slices(tests, SLICE_BYTES):
        texts = [tuple(r) for r in here.orderBy("item_id", "text").collect()]  # one slice's texts
        terms = (here.mapInArrow(_term_batches, "item_id long, term long, words long").select("term").distinct()
                 .join(counted, "term").collect())
        df = {int(np.int64(r[0]).view(np.uint64)): r[1] for r in terms}
        index = spark.sparkContext.broadcast(Index(texts, df, n, float(mean)))
        part = rows.mapInArrow(
            partial(_leak_batches, index=index, threshold=threshold, question_share=question_share,
                    answer_share=answer_share),
            LEAK_ROWS)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], LEAK_ROWS) if found is None else found


def _term_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of each item."""
    for batch in batches:
        ids, terms, counts = [], [], []
        for item_id, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
            words = words_of(text or "")
            own = np.unique(words).view(np.int64).tolist()
            ids += [item_id] * len(own)
            terms += own
            counts += [len(words)] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, terms, counts)],
                                         ["item_id", "term", "words"])


def drop_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents in which an item was found."""
    found = durable(leaks(docs, items, id_col, text_col, **options).select("text_key").distinct(), "leaks")
    keyed = docs.select(packed(docs).alias("row"), text_key(text_col).alias("text_key"))
    return keep_keys(keyed, found, "text_key", drop=True).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_key").withColumn("score", F.round("score", 9))
