"""Small helpers shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The separators between words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]"
WORDS = r"[^\x20\x09-\x0D]+"

# Keys of at most this many rows (16 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_KEYS = 1_000_000

# Bytes of rows that a task hands to Python, or gets back, at once.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """From now on tasks and Python exchange Arrow batches of about ``BATCH_BYTES``, or of one row that is longer.

    Spark's own bound is 10,000 rows or 64 MB, so a task would hold a whole file split of texts at once, and its Python
    worker again. Set on the session, as results are computed after an operator has returned.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves remainder 0 on division by 5; a NULL id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(5)) == 0


def text_key(text: str = "text") -> Column:
    """16 bytes that identify a text; NULL counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def packed(rows: DataFrame) -> Column:
    """All columns of ``rows`` as one struct, so that helper columns cannot clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in rows.columns])


def keep_keys(rows: DataFrame, keys: DataFrame, key: str, drop: bool = False) -> DataFrame:
    """Rows whose ``key`` occurs (or does not occur: ``drop``) in ``keys``, a stored table of one row per key.

    The keys are counted first: up to ``BROADCAST_KEYS`` are broadcast, so that
    wide rows are filtered where they are read; more are met by a shuffle.
    """
    if keys.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    return rows.join(keys, key, "left_anti" if drop else "left_semi")


def item_slices(items: DataFrame, slice_bytes: int) -> list[DataFrame]:
    """Distinct rows (item_id, text), a stored table, in parts of at most ``slice_bytes``, or of one item where that is longer."""
    sized = items.select("item_id", "text", F.octet_length("text").alias("n"), F.xxhash64("item_id", "text").alias("place"))
    n = 1
    while True:
        part = F.pmod("place", F.lit(n))
        over = sized.groupBy(part).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"))
        if over.where((F.col("n") > slice_bytes) & (F.col("rows") > 1)).isEmpty():
            break
        n *= 2
    kept = sized.select("item_id", "text", F.pmod("place", F.lit(n)).alias("part"))
    parts = [r[0] for r in kept.select("part").distinct().orderBy("part").collect()]  # a number per pass
    return [kept.where(F.col("part") == p).select("item_id", "text") for p in parts]
