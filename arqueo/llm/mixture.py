"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arqueo.session import small_side, written

#: Documents of one source and length go into so many cells, so that no cell is hot.
CELLS = 64
#: Lengths that a window task adds up.
BAND = 64
#: Rows of the driver's table of lengths when gaps are closed. While all gaps together are larger, each is closed by one document a round.
LADDER = 200_000


def source_name(c: Column) -> Column:
    """Letter case, blanks around and hyphens for underscores don't count."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s\-]+", "_")


def plan(available: DataFrame, targets: DataFrame, total_tokens: int | None = None, meet_all: bool = False) -> DataFrame:
    """One row for each target source: source, target_share, max_repeats, available_tokens, goal_tokens, copies.

    copies is the expected number of times that each document appears: goal over available tokens, at most max_repeats. The goals
    add up to ``total_tokens``, or without it to the tokens available in the target sources. A source that can't reach its goal
    gives all it has max_repeats times, and what it lacks isn't made up by others. With ``meet_all`` the total is the largest at
    which every source that has any text reaches its share: the least of available tokens times max_repeats over share, so that
    the scarcest source sets the size. An absent source has 0 copies. Shares are taken as they are, whatever their sum.
    """
    by = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    x = by.join(available, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("available_tokens", F.lit(0)).alias("available_tokens"))
    most = F.col("available_tokens") * F.col("max_repeats")
    if meet_all:
        total = F.min(F.when((F.col("target_share") > 0) & (most > 0), most / F.col("target_share")))
    else:
        total = F.sum("available_tokens").cast("double") if total_tokens is None else F.max(F.lit(float(total_tokens)))
    reach = x.agg(total.alias("total"))
    x = x.crossJoin(F.broadcast(reach))  # one row
    goal = F.coalesce(F.col("total") * F.col("target_share"), F.lit(0.0))
    copies = F.when(most > 0, F.least(goal / F.col("available_tokens"), F.col("max_repeats").cast("double"))).otherwise(0.0)
    return x.select("source", "target_share", "max_repeats", "available_tokens", goal.alias("goal_tokens"), copies.alias("copies"))


def select_copies(docs: DataFrame, doc_id: str, rates: DataFrame, seed: int = 7) -> DataFrame:
    """doc_id, source, n_tokens and repeats of the documents that systematic sampling selects.

    docs: doc_id, source, n_tokens; rates: source, copies, goal_tokens, max_repeats (one row each, as many as there are target sources). Within a source,
    documents stand in order of length (then by hash), so that any stretch of the sample is a like mixture of lengths; each adds
    ``copies`` to a prefix sum, one random offset in [0, 1) is added per source, and a document is emitted once for each integer
    that its stretch crosses: its copies rounded down or up, and so never more than max_repeats. Single copies then close the gap to the goal
    (``closed``). Documents without tokens add nothing and are left out, as are sources that no target names and null ids.

    The prefix sum has three levels: a count of documents before each band of lengths of a source, before each cell (length,
    hash bucket) in the band, and within the cell; none holds a source in one task. Documents are shuffled once.
    """
    docs = docs.select(doc_id, "source", "n_tokens")
    x = docs.filter((F.col("n_tokens") > 0) & F.col(doc_id).isNotNull()).join(F.broadcast(rates.filter("copies > 0").select("source", "copies", "goal_tokens", "max_repeats")), "source")
    h = F.xxhash64(F.col(doc_id), F.lit(seed))
    x = x.select(F.col(doc_id), "source", "n_tokens", "copies", "goal_tokens", "max_repeats", h.alias("__h"), F.pmod(h, F.lit(CELLS)).cast("int").alias("__cell"))
    cell = ["source", "n_tokens", "__cell"]
    counts = written(x.groupBy(*cell).agg(F.count("*").alias("__n")).withColumn("__band", F.floor(F.col("n_tokens") / BAND)), "cells")
    bands = counts.groupBy("source", "__band").agg(F.sum("__n").alias("__n"))
    bands = bands.select("source", "__band", (F.sum("__n").over(Window.partitionBy("source").orderBy("__band")) - F.col("__n")).alias("__below"))
    before = F.sum("__n").over(Window.partitionBy("source", "__band").orderBy("n_tokens", "__cell")) - F.col("__n")
    counts = counts.select(*cell, "__band", before.alias("__before")).join(bands, ["source", "__band"]).select(*cell, (F.col("__before") + F.col("__below")).alias("__before"))
    place = F.col("__before") + F.row_number().over(Window.partitionBy(*cell).orderBy("__h", doc_id))
    x = x.join(counts, cell).select(doc_id, "source", "n_tokens", "copies", "goal_tokens", "max_repeats", place.alias("__place"))
    offset = F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    repeats = F.floor(F.col("__place") * F.col("copies") + offset) - F.floor((F.col("__place") - 1) * F.col("copies") + offset)
    x = written(x.select(doc_id, "source", "n_tokens", "goal_tokens", "max_repeats", F.least(repeats, F.col("max_repeats")).cast("int").alias("repeats")), "chosen")
    return closed(x, doc_id).select(doc_id, "source", "n_tokens", "repeats").filter("repeats > 0")


def _gaps(x: DataFrame) -> dict[str, float]:
    """What each source lacks (or has too much); one row for each target source."""
    got = x.groupBy("source", "goal_tokens").agg(F.sum(F.col("n_tokens").cast("long") * F.col("repeats")).alias("got"))
    return {r["source"]: r["goal_tokens"] - r["got"] for r in got.collect()}


def closed(x: DataFrame, doc_id: str, ladder: int = LADDER) -> DataFrame:
    """x (doc_id, source, n_tokens, goal_tokens, max_repeats, repeats) with single copies more or less until none of them would
    bring any source nearer to its goal.

    Only a document shorter than twice the gap brings it nearer. So a table of the lengths below that, with the copies that can
    be added or taken away, has at most two rows a token of gap; the driver picks the changes from it one after the other, each
    the one that leaves the least gap. Where gaps are so wide that the table could exceed ``ladder`` rows, they are first narrowed,
    in rounds, by the one best document of each source.
    """
    spark = x.sparkSession
    gaps = _gaps(x)
    while sum(4 * abs(g) for g in gaps.values()) > ladder:
        table = spark.createDataFrame(list(gaps.items()), "source string, gap double")
        step = F.when((F.col("gap") > 0) & (F.col("repeats") < F.col("max_repeats")), 1).when((F.col("gap") < 0) & (F.col("repeats") > 0), -1)
        left = F.abs(F.col("gap") - step * F.col("n_tokens"))
        best = x.join(F.broadcast(table), "source").filter(left < F.abs("gap")).groupBy("source").agg(F.min(F.struct(left.alias("left"), F.col(doc_id).alias("id"), step.alias("step"))).alias("b"))
        found = [(r["b"]["id"], r["b"]["step"]) for r in best.collect()]
        if not found:
            break
        changes = spark.createDataFrame(found, f"{doc_id} {x.schema[doc_id].dataType.simpleString()}, change int")
        x = written(x.join(F.broadcast(changes), doc_id, "left").withColumn("repeats", F.col("repeats") + F.coalesce("change", F.lit(0))).drop("change"), "narrowed")
        gaps = _gaps(x)
    else:
        reach = spark.createDataFrame([(s, 2 * abs(g)) for s, g in gaps.items()], "source string, reach double")
        lengths = x.join(F.broadcast(reach), "source").filter(F.col("n_tokens") < F.col("reach")).groupBy("source", "n_tokens").agg(F.sum(F.col("max_repeats") - F.col("repeats")).alias("up"), F.sum("repeats").alias("down"))
        room: dict[str, dict[int, list[int]]] = {}
        for r in lengths.collect():
            room.setdefault(r["source"], {})[r["n_tokens"]] = [r["up"], r["down"]]
        plan = [(s, n, c) for s, lengths in room.items() for n, c in _picked(gaps[s], lengths).items()]
        if plan:
            return _changed(x, doc_id, plan)
    return x


def _picked(gap: float, room: dict[int, list[int]]) -> dict[int, int]:
    """length -> copies more (or less); room: length -> [copies that can be added, taken away]."""
    out: dict[int, int] = {}
    while True:
        sign = 1 if gap > 0 else -1
        least = min(((abs(gap - sign * n), n) for n, (up, down) in room.items() if (up if sign > 0 else down) > 0), default=None)
        if least is None or least[0] >= abs(gap):
            return {n: c for n, c in out.items() if c}
        n = least[1]
        gap -= sign * n
        out[n] = out.get(n, 0) + sign
        room[n][0] -= sign
        room[n][1] += sign


def _changed(x: DataFrame, doc_id: str, plan: list[tuple[str, int, int]]) -> DataFrame:
    """x with the changes that plan has for each source and length, given to its first documents with room, by hash."""
    spark = x.sparkSession
    most = max(abs(c) for _, _, c in plan)
    p = F.broadcast(spark.createDataFrame(plan, "source string, n_tokens int, change int"))
    space = F.when(F.col("change") > 0, F.col("max_repeats") - F.col("repeats")).otherwise(F.col("repeats"))
    w = Window.partitionBy("source", "n_tokens").orderBy(F.xxhash64(F.col(doc_id)), doc_id)
    # Each has room for one copy at least, so the first ``most`` are enough; Spark drops the others before the shuffle.
    first = x.join(p, ["source", "n_tokens"]).withColumn("space", space).filter("space > 0").withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most)
    given = F.greatest(F.lit(0), F.least(F.col("space"), F.abs("change") - F.col("before"))) * F.signum("change").cast("int")
    first = first.withColumn("before", F.sum("space").over(w) - F.col("space")).select(doc_id, given.cast("int").alias("given")).filter("given <> 0")
    return x.join(small_side(written(first, "changes")), doc_id, "left").withColumn("repeats", F.col("repeats") + F.coalesce("given", F.lit(0)))


def mixed(docs: DataFrame, doc_id: str, targets: DataFrame, total_tokens: int | None = None, meet_all: bool = False, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(selection, report) of docs (doc_id, source, n_tokens) for targets (source, target_share, max_repeats).

    The report has a row for each target source: what is available, the goal, selected tokens, actual and target share, and whether
    it falls short of its goal, being absent or exhausted at max_repeats.
    """
    docs = docs.filter(F.col(doc_id).isNotNull())  # what nothing can name isn't available
    available = docs.groupBy("source").agg(F.sum(F.col("n_tokens").cast("long")).alias("available_tokens"))
    rates = written(plan(available, targets, total_tokens, meet_all), "rates")
    selection = select_copies(docs, doc_id, rates, seed)
    got = selection.groupBy("source").agg(F.sum(F.col("n_tokens").cast("long") * F.col("repeats")).alias("tokens"), F.count("*").alias("n_docs"), F.max("repeats").alias("most_repeats"))
    x = rates.join(got, "source", "left")
    tokens = F.coalesce("tokens", F.lit(0))
    share = tokens / F.sum(tokens).over(Window.partitionBy(F.lit(0)))
    report = x.select(
        "source", "target_share", "max_repeats", "available_tokens", "goal_tokens", tokens.alias("tokens"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"),
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), F.coalesce(share, F.lit(0.0)).alias("actual_share"),
        (F.col("available_tokens") * F.col("max_repeats") < F.col("goal_tokens") * 0.999).alias("exhausted"), (F.col("available_tokens") == 0).alias("absent"),
    )
    return selection, report
