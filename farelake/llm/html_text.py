"""Main text of web pages: a recurrent labeller decides on every block of a page.

A page is cut into blocks (``html_blocks``); a bidirectional LSTM in numpy
(``block_lstm``) reads the blocks' tag paths, words and statistics in order and labels each
from the whole page; the blocks labelled as content are joined by one space.

The labeller is fitted on the driver from a bounded sample of pages: the ``SAMPLE``
pages of at most ``SAMPLE_BYTES`` whose content hashes are smallest. Their texts fill ``DRAWN``
pages of a layout grammar (``page_grammar``), whose labels are known, and those
sampled pages that mark up their article themselves are used as they are. No
other data tell it what content is. Scoring covers every block of every page,
of any number.

Defined results: a NULL or empty page, or one without content, gives an empty
text and 0. Every row gives a row. Without a sample (an empty table) the labeller learns from
made-up words. Other columns come along in ``row`` if asked for by ``carry``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from farelake.llm.block_lstm import Labeller, train
from farelake.llm.common import table
from farelake.llm.html_blocks import blocks_of
from farelake.llm.page_grammar import drawn_pages, marked_up

SAMPLE = 300
SAMPLE_BYTES = 1 << 15
DRAWN = 2000
THRESHOLD = 0.5
# Bytes of pages labelled together.
GROUP_BYTES = 4 << 20


def fit(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE, drawn: int = DRAWN, seed: int = 7) -> Labeller:
    """A labeller from a bounded sample of pages; the same one for the same rows."""
    html = F.col(f"`{html_col}`").cast("string")
    short = pages.select(html.alias("html")).where(F.octet_length("html") <= SAMPLE_BYTES).withColumn("place", F.xxhash64("html"))
    # The hashes are ranked alone; only then do the pages they name come to the driver, each once.
    last = short.select("place").distinct().orderBy("place").limit(sample).agg(F.max("place")).first()[0]
    chosen = (short.where(F.col("place") <= F.lit(last)).groupBy("place").agg(F.min("html").alias("html"))
              .orderBy("place").collect()) if last is not None else []  # at most 300 x 32 KB
    real = [b for b in (blocks_of(r.html) for r in chosen) if b]
    prose = [b.text for blocks in real for b in blocks]
    labelled = [(blocks, labels) for blocks, labels in ((b, marked_up(b)) for b in real) if labels is not None]
    return train(drawn_pages(prose, drawn, seed) + labelled, seed=seed)


def content(net: Labeller, pages: list[str], threshold: float = THRESHOLD) -> list[str]:
    """Main text of each page."""
    cut = [blocks_of(page) for page in pages]
    return [" ".join(b.text for b, s in zip(blocks, scores) if s >= threshold) for blocks, scores in zip(cut, net.pages(cut))]


def _batches(batches: Iterator[pa.RecordBatch], weights, threshold: float) -> Iterator[pa.RecordBatch]:
    net = Labeller()
    net.weights = weights.value
    for batch in batches:
        html, first = batch.column("html"), 0
        sizes = np.array([len(v.as_buffer()) if v.is_valid else 0 for v in html])
        while first < len(html):
            ahead = np.cumsum(sizes[first:])
            end = first + max(1, int(np.searchsorted(ahead, GROUP_BYTES, side="right")))
            texts = content(net, [v or "" for v in html.slice(first, end - first).to_pylist()], threshold)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").slice(first, end - first), pa.array([t.encode("utf-8", "replace") for t in texts], pa.binary()).cast(pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], ["row", "text", "n_chars"])
            first = end


def extract(pages: DataFrame, net: Labeller, html_col: str = "html", carry: tuple[str, ...] | None = None,
            threshold: float = THRESHOLD) -> DataFrame:
    """``row`` (the columns in ``carry``, default all but the html), text and n_chars of each page."""
    kept = [c for c in pages.columns if c != html_col] if carry is None else list(carry)
    row = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.struct(F.lit(None).cast("int").alias("none"))
    rows = pages.select(row.alias("row"), F.col(f"`{html_col}`").cast("string").alias("html"))
    schema = T.StructType([rows.schema["row"]]).add("text", T.StringType()).add("n_chars", T.LongType())
    weights = pages.sparkSession.sparkContext.broadcast(net.weights)  # fixed size, below 1 MB
    return rows.mapInArrow(partial(_batches, weights=weights, threshold=threshold), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, fit(pages), carry=("page_id", "url")).select("row.page_id", "row.url", "text", "n_chars")
