"""Previous or next row of the same key, without one task per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


CHUNK = "_chunk"


def add_chunk(df: DataFrame, order: str, chunk: str) -> DataFrame:
    """Add the time chunk of each row, as ``with_neighbour_chunked`` needs it."""
    return df.withColumn(CHUNK, F.date_trunc(chunk, F.col(order)).cast("timestamp_ntz"))


def _near(values: Sequence[str], side: str) -> Column:
    if side not in ("previous", "next"):
        raise ValueError(f"side must be 'previous' or 'next', not {side!r}")
    return (F.lag if side == "previous" else F.lead)(F.struct(*values))


def with_neighbour(df: DataFrame, key: str, order: str, values: Sequence[str], side: str, name: str) -> DataFrame:
    """Add ``name``: a struct of ``values`` from the row before or after by ``order``.

    A window per key; for tables in which no key has very many rows.
    """
    return df.withColumn(name, _near(values, side).over(Window.partitionBy(key).orderBy(order)))


def with_neighbour_chunked(df: DataFrame, key: str, order: str, values: Sequence[str], side: str,
                           name: str) -> DataFrame:
    """As ``with_neighbour``, for keys of any size.

    ``order`` is a timestamp, unique within the key, and ``df`` has its chunk
    (``add_chunk``). A key's chunks are windows of their own; the row that a
    chunk's edge needs from the next chunk comes from a table with one row per
    key and chunk. So a key with a third of all rows is spread over as many
    tasks as it has chunks. Rows stay partitioned by key and chunk, so a second
    call adds no shuffle of them.
    """
    picked = F.struct(*values)
    edge_row = (F.max_by if side == "previous" else F.min_by)(picked, F.col(order))
    carried = _near(["_edge"], side).over(Window.partitionBy(key).orderBy(CHUNK))
    edges = (df.groupBy(key, CHUNK).agg(edge_row.alias("_edge"))
             .select(key, CHUNK, carried.getField("_edge").alias("_carried")))
    return (df.withColumn("_near", _near(values, side).over(Window.partitionBy(key, CHUNK).orderBy(order)))
            .join(edges, [key, CHUNK], "left")
            .withColumn(name, F.coalesce("_near", "_carried"))
            .drop("_near", "_carried"))
