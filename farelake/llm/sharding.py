"""Sharding: minimax contiguous partition of ordered atomic groups.

Equal texts form a group that is never split. Groups larger than an even share
stand first, so that each fills a shard of its own and the others stay even; the others
stand in the order of their text's digest. The smallest capacity with which a
greedy pass over the ordered groups needs no more than the allowed shards is found
by binary search, each probe checked greedily. The first shard is filled up to that
capacity and cut; the search is repeated for the groups and shards that are left.

The search looks at sums of digest ranges, a fixed number of which fit on
the driver at any scale. A range in which a cut may fall is opened into 16 finer ones, and
again, until each of them is one group: the greedy cuts of any capacity lie between those of
a capacity too small and of one that suffices, and only ranges between the two are opened.
So the capacity is the smallest for the groups, not for the ranges.

Slots number a shard's rows from 0 without gaps. Rows of a shard and range are dealt by a
hash of the id into cells of bounded size; cell counts give the offsets, and
rows are ordered inside a cell only.

Defined results: a NULL text has no bytes, and NULL and empty texts are one
group. Rows equal in id and text are exchangeable. Shards may stay empty when
there are fewer groups than shards. Other columns are not looked at. No rows
give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from farelake.llm.common import packed, table
from farelake.session import durable

SHARDS = 40
# Ranges are named by the first hex digits of the text's MD5: at first 16 ** 3 rows come to the driver.
UNIT_DIGITS = 3
ROW_OVERHEAD = 16
UNIT_PLAN = pa.schema([("unit", pa.string()), ("cells", pa.int64()), ("base", pa.int32()), ("cuts", pa.list_(pa.string()))])


def greedy_cuts(prefix: np.ndarray, start: int, shards: int, capacity: int) -> list[int]:
    """Places at which a greedy pass from ``start`` cuts; the last is short of the end where the capacity is too small."""
    cuts = [start]
    for _ in range(shards):
        cuts.append(int(np.searchsorted(prefix, prefix[cuts[-1]] + capacity, side="right")) - 1)
    return cuts[1:]


def smallest_capacity(prefix: np.ndarray, start: int, shards: int) -> int:
    """Least capacity that packs the units from ``start`` on, in order, into ``shards`` runs.

    ``prefix[i]`` is the size of the first i units.
    """
    total = int(prefix[-1] - prefix[start])
    low = max(-(-total // shards), int(np.diff(prefix[start:]).max(initial=0)))
    high = max(low, total)
    while low < high:
        middle = (low + high) // 2
        fits = greedy_cuts(prefix, start, shards, middle)[-1] == len(prefix) - 1
        low, high = (low, middle) if fits else (middle + 1, high)
    return low


def cut_units(sizes: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unit in order."""
    prefix = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    out, start = np.zeros(len(sizes), np.int32), 0
    for shard in range(shards):
        if start == len(sizes):
            break
        capacity = smallest_capacity(prefix, start, shards - shard)
        end = int(np.searchsorted(prefix, prefix[start] + capacity, side="right")) - 1
        out[start:end] = shard
        start = end
    return out


def hopeful_cuts(prefix: np.ndarray, single: np.ndarray, shards: int, capacity: int) -> list[int]:
    """Bytes before each cut if a range of several groups could be cut anywhere: no pass over the groups gets further."""
    at, cuts = 0, []
    for _ in range(shards):
        end = at + capacity
        i = int(np.searchsorted(prefix, end, side="right")) - 1
        at = int(prefix[i]) if i == len(single) or single[i] else end
        cuts.append(at)
    return cuts


def unsettled(sizes: np.ndarray, single: np.ndarray, shards: int) -> np.ndarray:
    """Ordered ranges of several groups that a greedy pass over the groups may cut at their smallest capacity."""
    prefix = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    total = int(prefix[-1])
    # At most 16 ranges a shard are larger than this; with them open, passes over ranges stay close to those over groups.
    large = ~single & (sizes * 16 * shards > total)
    if large.any() or not len(sizes):
        return large
    high = smallest_capacity(prefix, 0, shards)
    low, least = -(-total // shards), high
    while low < least:
        middle = (low + least) // 2
        low, least = (low, middle) if hopeful_cuts(prefix, single, shards, middle)[-1] >= total else (middle + 1, least)
    out = np.zeros(len(sizes), bool)
    for begin, end in zip(greedy_cuts(prefix, 0, shards, low), hopeful_cuts(prefix, single, shards, high)):
        out[int(np.searchsorted(prefix, prefix[begin], side="right")) - 1:int(np.searchsorted(prefix, end, side="left"))] = True
    return out & ~single


def _ranges(rows: DataFrame, depth: int) -> pd.DataFrame:
    """Sums of rows by the first digits of their digest; ``single`` marks ranges of one group."""
    out = rows.groupBy(F.substring("digest", 1, depth).alias("name")).agg(
        F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.min("digest").alias("digest"),
        (F.min("digest") == F.max("digest")).alias("single")).toPandas()
    return out.astype({"size": "int64", "n": "int64", "single": "bool"})


def _ordered(ranges: pd.DataFrame, total: int, shards: int) -> pd.DataFrame:
    """Groups larger than an even share first, then all ranges by digest."""
    ranges = ranges.assign(hot=ranges["single"] & (ranges["size"] * shards > total))
    return ranges.sort_values(["hot", "name"], ascending=[False, True], ignore_index=True)


def plan_shards(rows: DataFrame, units: pd.DataFrame, shards: int) -> pd.DataFrame:
    """Ordered ranges of groups with their shard, opened as far as the smallest capacity needs it.

    ``rows`` is a stored table of (digest, size). An opened range has 16 parts at most, and the open ones
    lie around the cuts, so the ranges on the driver stay few whatever the number of groups.
    """
    total = int(units["size"].sum())
    ranges = _ordered(units, total, shards)
    while True:
        opened = unsettled(ranges["size"].to_numpy(np.int64), ranges["single"].to_numpy(bool), shards)
        if not opened.any():
            return ranges.assign(shard=cut_units(ranges["size"].to_numpy(np.int64), shards))
        parts = [ranges[~opened]]
        for depth, names in ranges[opened].groupby(ranges["name"].str.len())["name"]:
            parts.append(_ranges(rows.where(F.substring("digest", 1, depth).isin(names.tolist())), depth + 1))
        ranges = _ordered(pd.concat(parts, ignore_index=True), total, shards)


def _unit_plan(ranges: pd.DataFrame, units: pd.DataFrame, cells: pd.Series) -> pd.DataFrame:
    """Per unit its number of cells, the shard it begins in, and the digests' beginnings at which the next shard begins."""
    cold = ranges[~ranges["hot"]]
    change = cold[cold["shard"] != cold["shard"].shift()]
    starts, numbers = change["name"].to_numpy(str), change["shard"].to_numpy(np.int32)
    base, cuts = [], []
    for name in units["name"]:
        at = int(np.searchsorted(starts, name, side="right")) - 1 if len(starts) else -1
        base.append(int(numbers[max(at, 0)]) if len(starts) else 0)
        cuts.append([str(s) for s in starts[max(at, 0) + 1:] if s.startswith(name)])
    return pd.DataFrame({"unit": units["name"], "cells": cells, "base": base, "cuts": cuts})


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text",
                    carry: tuple[str, ...] | None = ()) -> DataFrame:
    """Per document (doc_id, size, text_crc32, shard, slot); ``carry=None`` hands all input columns on as ``row``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = [(packed(docs) if carry is None else F.struct(*carry)).alias("row")] if carry is None or carry else []
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.md5(text).alias("digest"), *kept)
    narrow = durable(rows.drop("row"), "shard-rows")
    units = _ranges(narrow, UNIT_DIGITS)
    ranges = plan_shards(narrow, units, shards)
    cell_rows = max(256, int(units["n"].sum()) // 16 ** UNIT_DIGITS // 4)
    plan = _unit_plan(ranges, units, units["n"] // cell_rows + 1)
    # One row a unit, at most 16 ** UNIT_DIGITS; an Arrow table needs no Python on the executors, which lists of rows do.
    plan = F.broadcast(docs.sparkSession.createDataFrame(pa.Table.from_pylist(plan.to_dict("records"), UNIT_PLAN)))
    # Fewer groups than shards are larger than an even share.
    hot = [F.lit(v) for r in ranges[ranges["hot"]].itertuples() for v in (r.digest, int(r.shard))]
    own = F.try_element_at(F.create_map(*hot), F.col("digest")) if hot else F.lit(None).cast("int")

    def dealt(frame: DataFrame) -> DataFrame:
        cell = F.pmod(F.xxhash64("digest", "doc_id"), F.col("cells"))
        shard = F.coalesce(own, F.col("base") + F.size(F.filter("cuts", lambda c: c <= F.col("digest"))))
        return (frame.withColumn("unit", F.substring("digest", 1, UNIT_DIGITS)).join(plan, "unit")
                .withColumns({"cell": cell, "shard": shard.cast("int")}))

    place = ("shard", "unit", "cell")
    counts = dealt(narrow).groupBy(*place).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("shard").orderBy("unit", "cell")
    offsets = durable(counts.select(*place, (F.sum("n").over(order) - F.col("n")).alias("offset")), "shard-offsets")
    nth = F.row_number().over(Window.partitionBy(*place).orderBy("digest", F.col("doc_id").isNull(), "doc_id"))
    return (dealt(rows if kept else narrow).withColumn("nth", nth).join(offsets, list(place))
            .select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("nth") - 1).alias("slot"),
                    *(["row"] if kept else [])))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
