"""Ranked lexical search: every document scored for each item of a query set, by scans of the text.

There is no document index. All distinct terms of the items go into an
Aho-Corasick automaton that is broadcast; every term stands between two guards
(spaces), and so do the words of a scanned text, so only whole words match.
Terms are runs of ASCII letters and digits and of all characters beyond ASCII,
only A-Z lower-cased; this is done on the UTF-8 bytes, one table look-up a byte.

The first scan counts documents, their terms and each item term's document
frequency; a task adds up its own before anything is shuffled. The second scan
counts each document's term occurrences with the automaton, maps the outputs to
the items that hold the terms, and keeps the best ``k`` documents per item and task.
The final ranking sees ``k`` rows per item and task, first by slices of the tasks.

Items go to the tasks in slices of at most ``SLICE_BYTES`` bytes of text (an item that is
longer alone is a slice by itself; it is one text in any case). More items mean
more scans, not a larger automaton.

Defined results: NULL or empty texts and items have no terms and give no rows.
An item is a distinct pair of id and text; different texts of one id are ranked
each by itself. Each row of documents is a document, repeated ones too.
Equal scores go by ascending doc_id, NULL last. No items or no documents: no rows.
Other columns are not looked at.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from farelake.llm.common import item_slices, table
from farelake.session import durable

TOP = 10
# Length weight of BM25 in hundredths, and the scale of a term's share (fixed values).
LENGTH_PERCENT = 75
SHARE = 1_000_000_000
# Bytes of all items whose terms stand in one automaton; it has a node a byte at most.
SLICE_BYTES = 1 << 20
# Tasks' best rows are ranked in so many groups per item first.
RANK_GROUPS = 256

_GUARD = 32
_FOLD = bytes(_c + 32 if 65 <= _c < 91 else _c if 48 <= _c < 58 or 97 <= _c < 123 or _c >= 128 else _GUARD for _c in range(256))


def guarded(text: bytes) -> str:
    """The text's terms between single-byte guards; one character a byte."""
    return (b" " + text.translate(_FOLD) + b" ").decode("latin-1")


def terms_of(text: str) -> list[str]:
    return [t for t in guarded(text.encode()).split(" ") if t]


def count_terms(folded: str) -> int:
    """Number of terms between the guards."""
    inside = np.frombuffer(folded.encode("latin-1"), np.uint8) != _GUARD
    return int(np.count_nonzero(inside[1:] & ~inside[:-1]))


class Scanner:
    """An automaton over the terms of some items, and the items' postings."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.items = [i for i, _ in items]
        self.terms: dict[str, int] = {}
        holders: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for at, (_, text) in enumerate(items):
            for term, times in sorted(Counter(terms_of(text)).items()):
                holders[self.terms.setdefault(term, len(self.terms))].append((at, times))
        self.automaton = ahocorasick.Automaton()
        for term, k in self.terms.items():
            self.automaton.add_word(f" {term} ", k)
        if self.terms:
            self.automaton.make_automaton()
        sizes = [len(holders[k]) for k in range(len(self.terms))]
        self.bounds = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int64)
        flat = [p for k in range(len(self.terms)) for p in holders[k]]
        self.holder = np.array([p[0] for p in flat], np.int64)
        self.times = np.array([p[1] for p in flat], np.int64)

    def count(self, folded: str) -> Counter:
        """Occurrences of each term in a guarded text."""
        return Counter(map(itemgetter(1), self.automaton.iter(folded))) if self.terms else Counter()

    def scores(self, counts: Counter, m: int, weights: list[int]) -> np.ndarray:
        """The document's score for each item, whole numbers of 64 bits."""
        total = np.zeros(len(self.items), np.int64)
        if counts:
            term = np.fromiter(counts.keys(), np.int64, len(counts))
            parts = [weights[k] * (SHARE * tf // (1000 * tf + 8 * m)) for k, tf in counts.items()]
            n = self.bounds[term + 1] - self.bounds[term]
            flat = np.repeat(self.bounds[term] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            np.add.at(total, self.holder[flat], np.repeat(np.array(parts, np.int64), n) * self.times[flat])
        return total


def _texts(batch: pa.RecordBatch) -> Iterator[str]:
    column = batch.column("text")
    for k in range(len(column)):
        yield guarded(column[k].as_buffer().to_pybytes()) if column[k].is_valid else "  "


def _count_batches(batches: Iterator[pa.RecordBatch], scanner) -> Iterator[pa.RecordBatch]:
    """One row per term found in the task with its documents; term -1 counts documents, -2 their terms."""
    found: Counter = Counter()
    for batch in batches:
        for folded in _texts(batch):
            n = count_terms(folded)
            if n:
                found[-1] += 1
                found[-2] += n
                found.update(scanner.value.count(folded).keys())
    yield pa.RecordBatch.from_arrays([pa.array(list(found.keys()), pa.int64()), pa.array(list(found.values()), pa.int64())],
                                     ["term", "n"])


def _score_batches(batches: Iterator[pa.RecordBatch], scanner, weights, documents: int, words: int,
                   top: int) -> Iterator[pa.RecordBatch]:
    """The task's best rows of each item."""
    scanner, weights = scanner.value, weights.value
    best: list[list[tuple]] = [[] for _ in scanner.items]
    floor = np.zeros(len(scanner.items), np.int64)  # a document must reach this to enter
    for batch in batches:
        for doc_id, folded in zip(batch.column("doc_id").to_pylist(), _texts(batch)):
            counts = scanner.count(folded)
            if not counts:
                continue
            m = 100 - LENGTH_PERCENT + LENGTH_PERCENT * count_terms(folded) * documents // words
            total = scanner.scores(counts, m, weights)
            for at in np.flatnonzero((total >= floor) & (total > 0)).tolist():
                heap, entry = best[at], (int(total[at]), doc_id is not None, -(doc_id or 0))
                if len(heap) < top:
                    heapq.heappush(heap, entry)
                else:
                    heapq.heappushpop(heap, entry)
                if len(heap) == top:
                    floor[at] = heap[0][0]
    rows = [(at, -key if known else None, score) for at, heap in enumerate(best) for score, known, key in heap]
    columns = list(zip(*rows)) if rows else [(), (), ()]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item", "doc_id", "score"])


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text: str = "text", top: int = TOP, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """item_id, item_text, rank, doc_id and score of each item's ``top`` best documents."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    asked = items.select(F.col(f"`{item_col}`").cast("long").alias("item_id"), F.col(f"`{item_text}`").cast("string").alias("text"))
    asked = durable(asked.where("text is not null").distinct(), "search-items")
    found = spark.createDataFrame([], "item_id long, item_text string, rank int, doc_id long, score long")
    for part in item_slices(asked, slice_bytes):
        texts = [tuple(r) for r in part.orderBy("item_id", "text").collect()]  # one slice's texts
        scanner = Scanner(texts)
        if not scanner.terms:
            continue
        shared = spark.sparkContext.broadcast(scanner)
        counted = rows.select("text").mapInArrow(partial(_count_batches, scanner=shared), "term long, n long")
        df = dict(counted.groupBy("term").agg(F.sum("n")).collect())  # one row per term of the slice
        documents, words = df.pop(-1, 0), df.pop(-2, 0)
        if not documents:
            continue
        weights = [math.floor(1000 * math.log((2 * documents + 2) / (2 * df.get(k, 0) + 1))) for k in range(len(scanner.terms))]
        best = rows.mapInArrow(
            partial(_score_batches, scanner=shared, weights=spark.sparkContext.broadcast(weights), documents=documents,
                    words=words, top=top),
            "item long, doc_id long, score long")
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        best = best.withColumn("group", F.spark_partition_id() % RANK_GROUPS)
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy("item", "group").orderBy(*order))).where(F.col("rank") <= top)
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)
        names = spark.createDataFrame([(at, i, t) for at, (i, t) in enumerate(texts)], "item long, item_id long, item_text string")
        found = found.unionByName(best.join(names, "item").select("item_id", "item_text", "rank", "doc_id", "score"))
    return found


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("item_text")


SQL = r"""
with doc_terms as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from documents where text is not null),
tfs as (select doc_id, term, count(*) as tf from doc_terms group by all),
sizes as (select doc_id, sum(tf)::bigint as n from tfs group by doc_id),
whole as (select count(*) as n_docs, sum(n)::bigint as l from sizes),
dfs as (select term, count(*) as df from tfs group by term),
item_terms as (
  select item_id, term, count(*) as times from (
    select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from benchmark where text is not null)
  group by all),
scored as (
  select i.item_id, t.doc_id,
         sum(i.times * floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::bigint
             * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // l))))::bigint as score
  from item_terms i join dfs using (term) join tfs t using (term) join sizes z on z.doc_id = t.doc_id cross join whole
  group by all),
ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0)
select item_id, rank::integer as rank, doc_id, score from ranked where rank <= 10"""
