"""Differences between consecutive full snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arqueo.session import small_side


def neighbours(headers: DataFrame, series: str, order: list[Column], snapshot: str = "snapshot_id") -> DataFrame:
    """Each snapshot with the one before and the one after it in its series: columns snapshot, prev_id, next_id.

    headers has one row for a snapshot and no payload. Null series count as one series of their own.
    """
    w = Window.partitionBy(series).orderBy(*order)
    return headers.select(F.col(snapshot), F.lag(snapshot).over(w).alias("prev_id"), F.lead(snapshot).over(w).alias("next_id"))


def snapshot_changes(rows: DataFrame, pairs: DataFrame, row_hash: str = "row_hash") -> DataFrame:
    """Rows that were added, removed or changed between each snapshot and the next.

    rows: snapshot_id, row_id, row_hash (any type that tells whether two rows mean the same); pairs as from ``neighbours``. A row
    takes part twice, as the later side of one pair and the earlier side of the next; both are tagged, and one aggregation by
    pair and row_id compares the sides. Of a row_id that repeats in a snapshot, each side counts as the set of its hashes: the
    record is changed if the sets differ. A null row_id is a row_id like any other. An empty snapshot takes part, so all rows are
    added after it. Result: prev_snapshot_id, snapshot_id, row_id, change_kind; unchanged rows give none.
    """
    sides = F.filter(
        F.array(
            F.struct(F.col("prev_id").alias("a"), F.col("snapshot_id").alias("b"), F.lit(True).alias("later")),
            F.struct(F.col("snapshot_id").alias("a"), F.col("next_id").alias("b"), F.lit(False).alias("later")),
        ),
        lambda x: x["a"].isNotNull() & x["b"].isNotNull(),
    )
    rows = rows.select("snapshot_id", "row_id", row_hash)
    tagged = rows.join(small_side(pairs), "snapshot_id").select(F.explode(sides).alias("s"), "row_id", F.col(row_hash).alias("h"))
    by = tagged.groupBy(F.col("s.a").alias("prev_snapshot_id"), F.col("s.b").alias("snapshot_id"), "row_id").agg(
        F.sort_array(F.collect_set(F.when(~F.col("s.later"), F.col("h")))).alias("before"),
        F.sort_array(F.collect_set(F.when(F.col("s.later"), F.col("h")))).alias("after"),
    )
    kind = F.when(F.size("before") == 0, "added").when(F.size("after") == 0, "removed").when(F.col("before") != F.col("after"), "changed")
    return by.select("prev_snapshot_id", "snapshot_id", "row_id", kind.alias("change_kind")).filter(F.col("change_kind").isNotNull())
