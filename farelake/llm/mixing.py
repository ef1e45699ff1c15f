"""Mixing sources to target weights.

Every document gets a hash-random key. Within its source the keys are sorted by
range: a bucket is the key's first hex digits, so buckets of a source are key
ranges of about equal size, also of a hot source. Bucket sums, summed up along
a source's buckets, plus the running sum inside a bucket give each document's
place in its source's token order: a prefix sum with no sort of a whole source
in one task. A source's budget takes whole epochs of the source and then cuts
the order at the exact rest; the document at the cut gives its first words.

Defined results: a NULL text has size 0 and takes nothing; NULL is a source of
its own, last in the order of weights. Equal rows are exchangeable. The keys
depend on id and text only, so reruns agree. Other columns are not looked at.
With no rows or no words nothing is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from farelake.llm.common import WORDS, packed, table
from farelake.session import durable

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2
ROWS_PER_BUCKET = 20_000


def mix_key(id_col: str = "doc_id", text_col: str = "text", seed: str = "mix-1") -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null")),
                             F.md5(F.coalesce(F.col(text_col), F.lit("")))))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
            most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size): weights in code point order, overfull sources capped.

    Sources are ordered by cap over weight. A source is capped when the level
    that the sources from it on would share lies at or above that ratio; the
    level of the first other source holds for all later ones. One row a source
    passes the windows.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    steps = F.lit(list(weights))
    s = (sizes.withColumn("weight", F.element_at(steps, (F.row_number().over(by_name) - 1) % len(weights) + 1))
         .withColumn("cap", F.col("source_size") * F.lit(float(most_epochs))))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    rest = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = (s.withColumn("nth", F.row_number().over(fill))
         .withColumn("left", F.sum("source_size").over(everything) * F.lit(share)
                     - (F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap")))
         .withColumn("weight_left", F.sum("weight").over(rest).cast("double"))
         .withColumn("open", F.col("cap") * F.col("weight_left") > F.col("left") * F.col("weight")))
    level = F.min(F.when(F.col("open"), F.struct("nth", "left", "weight_left"))).over(everything)
    s = s.withColumn("level", level)
    return s.select(
        "source", "source_size",
        F.when(F.col("level").isNull() | (F.col("nth") < F.col("level.nth")), F.col("cap"))
        .otherwise(F.col("level.left") * F.col("weight") / F.col("level.weight_left")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most_epochs: int = MOST_EPOCHS,
        carry: tuple[str, ...] | None = None) -> DataFrame:
    """Per document its size, its source's size and target, and the words taken from it.

    ``carry`` names input columns to hand on unchanged (all by default, as one
    column ``row``); with an empty tuple only narrow rows are stored and moved.
    """
    kept = [packed(docs).alias("row")] if carry is None else [F.struct(*carry).alias("row")] if carry else []
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        F.regexp_count(F.col(text_col), F.lit(WORDS)).cast("long").alias("size"),
        mix_key(id_col, text_col).alias("key"), *kept).withColumn("size", F.coalesce("size", F.lit(0)))
    narrow = durable(rows.drop("row"), "mix-sizes")
    digits = 1
    while narrow.count() > ROWS_PER_BUCKET * 16 ** digits and digits < 7:
        digits += 1
    bucket = F.substring("key", 1, digits)
    in_bucket = narrow.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
    plan = targets(in_bucket.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most_epochs)
    before = F.sum("words").over(Window.partitionBy("source").orderBy("bucket")) - F.col("words")
    ranges = durable(
        in_bucket.withColumn("before", before).alias("b").join(plan.alias("p"), F.expr("b.source <=> p.source"))
        .select("b.source", "bucket", "before", "source_size", "target"), "mix-ranges")
    within = Window.partitionBy("source", "bucket").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        (rows if kept else narrow).withColumn("bucket", bucket).withColumn("inside", F.sum("size").over(within) - F.col("size")).alias("d")
        .join(ranges.alias("r"), F.expr("d.source <=> r.source and d.bucket = r.bucket")))
    budget = F.floor(F.col("target") + F.lit(0.5))
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    reach = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before") - F.col("inside")))
    return placed.select("doc_id", F.col("d.source").alias("source"), "size", "source_size", "target",
                         (epochs * F.col("size") + reach).cast("long").alias("taken"),
                         *(["row"] if kept else []))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus, with the columns of ``docs``: each document as often as the mix takes it.

    Documents stay whole here: the one at a source's cut counts as taken when at least half of it is. Documents
    without words are not part of any budget and stay once.
    """
    mixed = mix(docs, **options)
    times = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.floor(F.col("taken") / F.col("size") + F.lit(0.5))).cast("int")
    return (mixed.select("row", times.alias("times")).where(F.col("times") > 0)
            .select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), carry=()).drop("source")


SQL = r"""
with sized as (
  select doc_id, source, case when text is null then 0 else len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) end as size,
    md5(concat_ws('|', 'mix-1', coalesce(cast(doc_id as varchar), 'null'), md5(coalesce(text, '')))) as key
  from documents),
sources as (
  select source, sum(size)::bigint as source_size,
    [3, 1, 2][((row_number() over (order by source is null, source)) - 1) % 3 + 1] as weight
  from sized group by source),
ordered as (
  select *, 2.0::double * source_size as cap,
    row_number() over (order by 2.0::double * source_size / weight, source is null, source) as nth from sources),
levels as (
  select *, 1.5::double * (sum(source_size) over ()) - ((sum(cap) over (order by nth)) - cap) as left_over,
    (sum(weight) over (order by nth rows between current row and unbounded following))::double as weight_left from ordered),
first_open as (
  select nth, left_over, weight_left from levels where cap * weight_left > left_over * weight order by nth limit 1),
planned as (
  select l.source, l.source_size, case when f.nth is null or l.nth < f.nth then l.cap
    else f.left_over * l.weight / f.weight_left end as target
  from levels l left join first_open f on true),
budgets as (
  select *, floor(target + 0.5)::bigint as budget,
    case when source_size > 0 then (floor(target + 0.5)::bigint) // source_size else 0 end as epochs from planned),
placed as (
  select d.*, sum(size) over (partition by source order by key, size rows unbounded preceding) - size as before from sized d)
select p.doc_id, p.size::bigint as size, b.source_size, b.target,
  (b.epochs * p.size + greatest(0, least(p.size, b.budget - b.epochs * b.source_size - p.before)))::bigint as taken
from placed p join budgets b on p.source is not distinct from b.source
"""
