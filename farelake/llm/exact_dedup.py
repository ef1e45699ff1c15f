"""Exact deduplication with heavy hitters split off.

A document's digest is the SHA-256 of its text without white space. A frequent
items sketch of the Misra-Gries family, with a fixed number of counters, names
the digests that may be frequent. Their true counts are taken, and the verified
ones, at most one per thousandth of the rows, are broadcast with the row that
stays: rows of hot groups are settled where they are read and are never
shuffled by digest. All other digests go through an ordinary aggregation and
join.

Defined results: a NULL text counts as empty, all empty texts are one group. Of
a group the row with the most code points stays, then the smallest doc_id (NULL
last), then the smallest hash of the original text; of rows equal in all that
exactly one. Other columns of the input, whatever their names, are not looked
at; those named in ``carry`` are handed on. No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from farelake.llm.common import SPACES, table
from farelake.session import durable

# Counters of the sketch: every digest with more than a thousandth of the rows is among them.
COUNTERS = 8192
# A digest is hot from this share of all rows on, so there are at most so many hot ones.
HOT_SHARE = 1000
# Partial sketches are merged in so many groups before the last step.
SKETCH_GROUPS = 64


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Stored rows (doc_id, digest, n_points, raw, row_id) and the carried columns."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return durable(docs.select(
        F.col(id_col).alias("doc_id"), F.unhex(F.sha2(F.regexp_replace(text, SPACES + "+", ""), 256)).alias("digest"),
        F.length(text).alias("n_points"), F.xxhash64(text).alias("raw"),
        F.monotonically_increasing_id().alias("row_id"), *carry), "digests")


def frequent_digests(rows: DataFrame) -> DataFrame:
    """Hashes of digests that may be frequent, by a merged frequent-items sketch of fixed size."""
    hashed = rows.select(F.xxhash64("digest").alias("probe"),
                         (F.spark_partition_id() % SKETCH_GROUPS).alias("part"))
    parts = hashed.groupBy("part").agg(F.expr(f"approx_top_k_accumulate(probe, {COUNTERS})").alias("sketch"))
    # Grouped, since an ungrouped merge meets empty partitions, which this function does not take.
    merged = parts.groupBy((F.col("part") * 0).alias("all")).agg(
        F.expr(f"approx_top_k_combine(sketch, {COUNTERS})").alias("sketch"))
    found = merged.select(F.explode(F.expr(f"approx_top_k_estimate(sketch, {HOT_SHARE})")).alias("found"))
    return found.select(F.col("found.item").alias("probe"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document (doc_id, keep_id, group_size, kept, text_sha256) and the carried columns."""
    rows = digests(docs, id_col, text_col, carry)
    total = rows.count()
    size_and_best = (
        F.count(F.lit(1)).alias("group_size"),
        F.min(F.struct((-F.col("n_points")).alias("shorter"), F.col("doc_id").isNull().alias("no_id"), "doc_id",
                       "raw", "row_id")).alias("best"))
    hot = durable(
        rows.join(F.broadcast(frequent_digests(rows)), F.xxhash64("digest") == F.col("probe"), "left_semi")
        .groupBy("digest").agg(*size_and_best).where(F.col("group_size") * HOT_SHARE >= total), "hot-digests")
    split = rows.join(F.broadcast(hot), "digest", "left")
    settled = split.where(F.col("best").isNotNull())
    rest = split.where(F.col("best").isNull()).drop("group_size", "best")
    grouped = rest.groupBy("digest").agg(*size_and_best)
    both = settled.unionByName(rest.join(grouped, "digest"))
    return both.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
                       (F.col("row_id") == F.col("best.row_id")).alias("kept"),
                       F.lower(F.hex("digest")).alias("text_sha256"), *carry)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


SQL = r"""
with texts as (select doc_id, coalesce(text, '') as body from documents),
marked as (
  select doc_id, sha256(regexp_replace(body, '[\x20\x09-\x0D]', '', 'g')) as digest, length(body) as points from texts)
select doc_id,
  first_value(doc_id) over best as keep_id,
  count(*) over (partition by digest) as group_size,
  row_number() over best = 1 as kept,
  digest as text_sha256
from marked
window best as (partition by digest order by points desc, doc_id asc nulls last)
"""
