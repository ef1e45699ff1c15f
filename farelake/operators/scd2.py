"""Versioned dimensions: one row per key and stretch of unchanged attributes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from farelake.functions.scalars import OPEN_END
from farelake.operators.keys import highest, number_rows
from farelake.operators.neighbours import CHUNK, add_chunk

START, END, CURRENT = "effective_start_date", "effective_end_date", "is_current"


def open_end() -> Column:
    return F.lit(OPEN_END).cast("timestamp_ntz")


def unversioned_changes(changes: DataFrame, key: str, changed_at: str) -> DataFrame:
    """Changes that no version can be made of, for the quarantine: the key or the time is NULL."""
    return changes.where(F.col(key).isNull() | F.col(changed_at).isNull())


def build_versions(changes: DataFrame, key: str, changed_at: str, sequence: Sequence[str],
                   tracked: Sequence[str], chunk: str = "month") -> DataFrame:
    """Versions from a feed of attribute values.

    Values with the same key and time are reduced to the last by ``sequence``.
    A new version starts when a tracked attribute differs from the value
    before it, NULL included. The last version's end is open. Changes without a key
    or time are left to ``unversioned_changes``.

    Rows are dealt out once, by key and time chunk, so no key's history is one
    task. Inside a chunk neighbours are windows; a table of one row per key
    and chunk says whether the chunk's first row is a change, and when the next change after the chunk is.
    """
    usable = changes.where(F.col(key).isNotNull() & F.col(changed_at).isNotNull())
    feed = add_chunk(usable.select(key, F.col(changed_at).cast("timestamp_ntz").alias(START), *sequence, *tracked), START, chunk)
    picked = F.max_by(F.struct(*tracked), F.struct(*sequence)).alias("_value")
    rows = _marked(feed.repartition(F.col(key), F.col(CHUNK)).groupBy(key, CHUNK, START).agg(picked), key)
    over = Window.partitionBy(key).orderBy(CHUNK)
    edges = rows.groupBy(key, CHUNK).agg(
        F.min_by("_value", START).alias("_first"), F.max_by("_value", START).alias("_last"), F.min(START).alias("_begin"),
        F.min(F.when(F.col("_changed"), F.col(START))).alias("_inner"))
    edges = edges.withColumn("_opens", F.lag("_last").over(over).isNull() | ~F.col("_first").eqNullSafe(F.lag("_last").over(over)))
    starts = F.when(F.col("_opens"), F.col("_begin")).otherwise(F.col("_inner"))
    edges = edges.select(key, CHUNK, "_opens", F.last(starts, ignorenulls=True).over(_later(key)).alias("_later"))
    kept = rows.join(edges, [key, CHUNK]).where(F.col("_changed") | ((F.col("_nth") == 1) & F.col("_opens")))
    return _stretches(kept, key, tracked)


def _marked(rows: DataFrame, key: str) -> DataFrame:
    """Rows of one ``_value`` per key and start, dealt out by key and chunk; those that differ from the one before in their chunk are marked."""
    inside = Window.partitionBy(key, CHUNK).orderBy(START)
    rows = rows.withColumns({"_before": F.lag("_value").over(inside), "_nth": F.row_number().over(inside)})
    return rows.withColumn("_changed", (F.col("_nth") > 1) & ~F.col("_value").eqNullSafe(F.col("_before")))


def _later(key: str):
    """The chunks of a key after a chunk, nearest last."""
    return Window.partitionBy(key).orderBy(F.desc(CHUNK)).rowsBetween(Window.unboundedPreceding, -1)


def _stretches(kept: DataFrame, key: str, tracked: Sequence[str]) -> DataFrame:
    """Versions from the rows that start one; ``_later`` is the first start after a row's chunk."""
    inside = Window.partitionBy(key, CHUNK).orderBy(START)
    after = F.coalesce(F.lead(START).over(inside), F.col("_later"))
    return (kept.select(key, CHUNK, START, "_value", after.alias("_after"))
            .select(key, *[F.col(f"_value.{c}").alias(c) for c in tracked], START, F.coalesce("_after", open_end()).alias(END),
                    F.col("_after").isNull().alias(CURRENT)))


def build_sparse_versions(log: DataFrame, key: str, changed_at: str, sequence: Sequence[str],
                          attributes: Mapping[str, str], chunk: str = "month") -> DataFrame:
    """Versions of all ``attributes`` (name -> type) from a log of changes of single attributes.

    A row of ``log`` sets one ``attribute`` to the text ``value``, NULL included; of several for
    one key, time and attribute the last by ``sequence`` holds. Every version
    carries each attribute's last value up to its start: inside a chunk by a window, from the chunks before
    by a table of one row per key and chunk. Attributes never set are NULL, so is a value that its
    type cannot hold. Rows without a key or time (``unversioned_changes``) and of other attributes make no version.

    What the chunks before leave is also the value before a chunk's first row, so whether that row is a change
    is known without a second table of all attributes; only the chunks' first changes are looked up once more.
    """
    usable = log.where(F.col(key).isNotNull() & F.col(changed_at).isNotNull() & F.col("attribute").isin(*attributes))
    feed = add_chunk(usable.select(key, F.col(changed_at).cast("timestamp_ntz").alias(START), *sequence, "attribute", "value"),
                     START, chunk)
    # A set attribute is a struct, so that setting it to NULL differs from leaving it alone.
    order = F.struct(*sequence)
    sets = [F.max_by(F.when(F.col("attribute") == a, F.struct("value")), F.when(F.col("attribute") == a, order)).alias(a)
            for a in attributes]
    rows = feed.repartition(F.col(key), F.col(CHUNK)).groupBy(key, CHUNK, START).agg(*sets)
    until = Window.partitionBy(key, CHUNK).orderBy(START).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(key).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    own = rows.select(key, CHUNK, START, F.struct(*[F.last(a, ignorenulls=True).over(until).alias(a) for a in attributes]).alias("_own"))
    ends = rows.groupBy(key, CHUNK).agg(*[F.max_by(a, F.when(F.col(a).isNotNull(), F.col(START))).alias(a) for a in attributes])
    carried = ends.select(key, CHUNK, F.struct(*[F.last(a, ignorenulls=True).over(before).alias(a) for a in attributes]).alias("_carried"),
                          (F.count(F.lit(1)).over(before) > 0).alias("_follows"))
    value = F.struct(*[F.coalesce(f"_own.{a}.value", F.when(F.col(f"_own.{a}").isNull(), F.col(f"_carried.{a}.value")))
                       .try_cast(kind).alias(a) for a, kind in attributes.items()])
    prior = F.struct(*[F.col(f"_carried.{a}.value").try_cast(kind).alias(a) for a, kind in attributes.items()])
    opens = ~F.col("_follows") | ~F.col("_value").eqNullSafe(prior)
    filled = own.join(carried, [key, CHUNK]).withColumn("_value", value).select(key, CHUNK, START, "_value", opens.alias("_opens"))
    starting = _marked(filled, key).where(F.col("_changed") | ((F.col("_nth") == 1) & F.col("_opens"))).select(key, CHUNK, START, "_value")
    edges = starting.groupBy(key, CHUNK).agg(F.min(START).alias("_begin")).select(
        key, CHUNK, F.last("_begin", ignorenulls=True).over(_later(key)).alias("_later"))
    return _stretches(starting.join(edges, [key, CHUNK]), key, list(attributes))


def merge_versions(dimension: DataFrame, log: DataFrame, touched: DataFrame, key: str, surrogate: str,
                   changed_at: str, sequence: Sequence[str], tracked: Sequence[str],
                   chunk: str = "month") -> DataFrame:
    """Bring a versioned dimension up to date after new or late changes.

    ``log`` is the whole change log, ``touched`` the keys with new entries.
    Those keys' histories are rebuilt from the log, so a late change splits
    the version it falls into; all other keys pass through. A version that
    keeps its key and start keeps its surrogate key, others get new ones.
    """
    keys = touched.select(key).distinct()
    columns = [surrogate, key, *tracked, START, END, CURRENT]
    untouched = dimension.select(columns).join(keys, key, "left_anti")
    rebuilt = build_versions(log.join(keys, key, "left_semi"), key, changed_at, sequence, tracked,
                             chunk)
    known = dimension.select(key, START, surrogate)
    fresh = with_version_id(rebuilt.join(known.drop(surrogate), [key, START], "left_anti"), key)
    numbered = number_rows(fresh, VERSION, surrogate, highest(dimension, surrogate))
    return (untouched.select(columns)
            .unionByName(rebuilt.join(known, [key, START]).select(columns))
            .unionByName(numbered.select(columns)))


VERSION = "version_id"


def with_version_id(versions: DataFrame, key: str) -> DataFrame:
    """Add a text that names a version: business key and start."""
    start = F.date_format(START, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return versions.withColumn(VERSION, F.concat(F.col(key).cast("string"), F.lit("@"), start))


def with_version_keys(versions: DataFrame, key: str, surrogate: str) -> DataFrame:
    """Number the versions of a first load."""
    return number_rows(with_version_id(versions, key), VERSION, surrogate).drop(VERSION)


def join_version(facts: DataFrame, versions: DataFrame, key: str, surrogate: str, at: Column, unknown: int,
                 chunk: str = "month", keep: Sequence[str] | None = None) -> DataFrame:
    """Add the surrogate key of the version valid at ``at`` (start included, end not), ``unknown`` without one."""
    return join_versions(facts, {surrogate: (versions, surrogate)}, key, at, unknown, chunk, keep)


def join_versions(facts: DataFrame, tables: Mapping[str, tuple[DataFrame, str]], key: str, at: Column, unknown: int,
                  chunk: str = "month", keep: Sequence[str] | None = None) -> DataFrame:
    """Add a column for each of ``tables`` (name -> versions, their surrogate key): that table's version valid at ``at``.

    Of the facts the columns ``keep`` are given back (all, if None); others are not shuffled.

    An as-of join in linear time: versions and facts of a key and time chunk
    are brought into one order, and each fact takes the last version before it.
    A chunk's first facts take the version carried over from the chunks
    before, which a table of one row per key and chunk holds. So neither a key with very many
    versions nor one with a third of all facts is one task or a set of pairs.
    Facts without a key or a time are not shuffled. Of versions that overlap the later one holds.
    """
    usable = F.col(key).isNotNull() & at.isNotNull()
    columns = list(facts.columns if keep is None else keep)
    packed = [c for c in columns if c != key] or columns  # the key is shuffled as such
    held = {name: f"_version_{i}" for i, name in enumerate(tables)}
    known = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [
        versions.where(F.col(key).isNotNull() & F.col(START).isNotNull()).select(
            F.col(key).alias("_key"), F.col(START).alias("_at"), F.struct(F.col(surrogate).alias("sk"), F.col(END).alias("to")).alias(held[name]))
        for name, (versions, surrogate) in tables.items()])
    asked = facts.where(usable).select(F.col(key).alias("_key"), at.cast("timestamp_ntz").alias("_at"), F.struct(*packed).alias("_fact"))
    both = add_chunk(known.unionByName(asked, allowMissingColumns=True), "_at", chunk)
    order = [F.col("_at"), F.col("_fact").isNotNull()]
    until = Window.partitionBy("_key", CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = both.withColumns({f"_own{v}": F.last(v, ignorenulls=True).over(until) for v in held.values()}).where(F.col("_fact").isNotNull())
    placed = placed.drop(*held.values())
    marks = add_chunk(known, "_at", chunk).unionByName(add_chunk(asked, "_at", chunk).select("_key", CHUNK), allowMissingColumns=True)
    before = Window.partitionBy("_key").orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    edges = (marks.groupBy("_key", CHUNK).agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), F.col("_at"))).alias(v) for v in held.values()])
             .select("_key", CHUNK, *[F.last(v, ignorenulls=True).over(before).alias(f"_carried{v}") for v in held.values()]))
    found = placed.join(edges, ["_key", CHUNK], "left").withColumns(
        {v: F.coalesce(f"_own{v}", f"_carried{v}") for v in held.values()})
    missing = F.lit(unknown).cast("bigint")
    sks = [F.coalesce(F.when(F.col("_at") < F.col(f"{v}.to"), F.col(f"{v}.sk")), missing).alias(name) for name, v in held.items()]
    back = [F.col(f"_fact.{c}") if c in packed else F.col("_key").cast(facts.schema[key].dataType).alias(key) for c in columns]
    return (found.select(*back, *sks)
            .unionByName(facts.where(~usable).select(*columns, *[missing.alias(name) for name in held])))
