"""Joins, windows and incremental steps that the queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def alias_agreement(df: DataFrame, name: str, columns: list[Column]) -> DataFrame:
    """Adds ``name``, the one value on which several spellings of a column agree, and ``name_state``: missing, ok or conflicting."""
    values = F.array_distinct(F.array_compact(F.array(*columns)))
    state = F.when(F.size(values) == 0, "missing").when(F.size(values) > 1, "conflicting").otherwise("ok")
    return df.withColumns({name: F.when(F.size(values) == 1, F.get(values, F.lit(0))), f"{name}_state": state})


def upsert(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Full outer join by key: values of ``new`` that aren't null replace those of ``old``; change says added, updated or kept.

    Both sides have one row for a key; a null key matches nothing.
    """
    x = old.select(key, *columns).alias("o").join(new.select(key, *columns).alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    changed = F.lit(False)
    for c in columns:
        changed = changed | (F.col(f"n.{c}").isNotNull() & ~F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")))
    change = F.when(F.col(f"o.{key}").isNull(), "added").when(changed, "updated").otherwise("kept")
    return x.select(F.coalesce(f"n.{key}", f"o.{key}").alias(key), *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in columns], change.alias("change"))


def interval_join(points: DataFrame, at: str, ranges: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """Points with each range start <= at < end that holds them, as an equi-join on bins of ``width`` (integers on both sides).

    A range is copied to the bins that it touches, so the width should be near the usual length of a range; no pair is lost or doubled.
    """
    bin_of = lambda c: F.call_function("div", F.col(c) - F.pmod(F.col(c), F.lit(width)), F.lit(width))
    p = points.withColumn("__bin", bin_of(at))
    r = ranges.filter(F.col(start) < F.col(end)).withColumn("__bin", F.explode(F.sequence(bin_of(start), bin_of(end))))
    return p.join(r, "__bin").filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("__bin")


def islands(df: DataFrame, by: list[str], order: list[str], same: str, at: str) -> DataFrame:
    """Runs of consecutive rows with one value: by, value, first and last time, number of rows."""
    w = Window.partitionBy(*by).orderBy(*order)
    step = F.when(F.col(same).eqNullSafe(F.lag(same).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    x = df.withColumn("__new", step).withColumn("__run", F.sum("__new").over(w))
    return x.groupBy(*by, "__run").agg(F.first(same).alias(same), F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count("*").alias("n_rows")).withColumnRenamed("__run", "run")


def latest(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The last row of each group, by one aggregation: columns of df."""
    rest = [c for c in df.columns if c not in by]
    x = df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return x.select(*by, *[F.col(f"__r.`{c}`").alias(c) for c in rest])


def chain_breaks(df: DataFrame, series: str, order: str, prev_hash: str, own_hash: str, body: Column, seed: str = "0" * 64) -> DataFrame:
    """Rows at which a hash chain breaks: previous isn't the hash of the row before, or the hash isn't that of previous and body."""
    before = F.coalesce(F.lag(own_hash).over(Window.partitionBy(series).orderBy(order)), F.lit(seed))
    x = df.withColumn("__before", before)
    link, digest = ~F.col(prev_hash).eqNullSafe(F.col("__before")), ~F.col(own_hash).eqNullSafe(F.sha2(F.concat(F.col(prev_hash), body), 256))
    return x.filter(link | digest).withColumns({"bad_link": link, "bad_hash": digest}).drop("__before")


def sealed(df: DataFrame, series: str, order: str, body: str, seed: str = "0" * 64, seeds: DataFrame | None = None) -> DataFrame:
    """df with prev_hash and own_hash: in each series a hash is that of the one before and the body (text), the first follows ``seed``,
    or the seed that ``seeds`` (series, seed) has for it.

    A chain is serial: a series is folded by one task, so a series should be no larger than a task holds; series are spread. Orders within a series differ.
    A null body counts as empty.
    """
    text = F.coalesce(F.col(body), F.lit(""))
    x = df.withColumn("__b", text)
    chains = x.groupBy(series).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col("__b").alias("b")))).alias("rows"))
    chains = chains.join(seeds.select(series, F.col("seed").alias("__s")), series, "left") if seeds is not None else chains.withColumn("__s", F.lit(None).cast("string"))
    chains = chains.withColumn("__s", F.coalesce("__s", F.lit(seed)))
    start = F.struct(F.col("__s").alias("h"), F.array().cast("array<string>").alias("hs"))
    hashes = F.aggregate("rows", start, lambda acc, r: F.struct(F.sha2(F.concat(acc["h"], r["b"]), 256).alias("h"), F.concat(acc["hs"], F.array(F.sha2(F.concat(acc["h"], r["b"]), 256))).alias("hs")), lambda acc: acc["hs"])
    links = chains.select(series, F.col("rows.o").alias("os"), hashes.alias("hs"), "__s")
    links = links.select(series, F.posexplode("os").alias("i", order), "hs", "__s")
    links = links.select(series, order, F.when(F.col("i") == 0, F.col("__s")).otherwise(F.get("hs", F.col("i") - 1)).alias("prev_hash"), F.get("hs", F.col("i")).alias("own_hash"))
    return x.drop("__b").join(links, [series, order])


def page(df: DataFrame, order: list[Column], number: int, size: int) -> tuple[DataFrame, int, int]:
    """(rows, number, pages) of a page of ``size`` rows; a number below the first or above the last page is that page. An empty table has one empty page."""
    pages = max(1, -(-df.count() // size))
    number = min(max(1, number), pages)
    return df.orderBy(*order).offset((number - 1) * size).limit(size), number, pages


def missing_only(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``new``, one for each key, whose key isn't in ``existing``: what an append that may run twice adds."""
    return new.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")
