"""Splits that keep related records together."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arqueo.llm.components import connected_components
from arqueo.llm.segments import ROWS, Segments
from arqueo.session import empty, small_side, written

#: Components of at least this share of the records are assigned one by one; there are at most 1 / LARGE of them.
LARGE = 0.001


def edges_of(records: DataFrame, record: str, keys: dict[str, Column]) -> DataFrame:
    """Edges from each record to the keys that it has: columns a (``r:`` and the record), b (``name:`` and the key).

    A key that is null links nothing. Each record also has an edge to itself, so that one without keys is a component.
    """
    node = F.concat(F.lit("r:"), F.col(record))
    targets = F.array(node, *[F.concat(F.lit(f"{name}:"), c) for name, c in keys.items()])
    return records.filter(F.col(record).isNotNull()).select(node.alias("a"), F.explode(F.filter(targets, lambda x: x.isNotNull())).alias("b")).distinct()


class Store:
    """The persisted state in a folder: members (node, component), renames (component, root), splits (component, split, size, status)
    and totals (split, size), each in segments by step.

    A step adds rows and rewrites none: a node keeps the component that it was first put in, a rename leads from a merged component to the one it
    went into, and a component's last row of splits holds. totals are differences and are written last: a step without them is
    not there, so one that failed halfway is as if it had never begun, and one that runs again gives the same.
    """

    def __init__(self, spark: SparkSession, folder: str, rows: int = ROWS) -> None:
        self.spark = spark
        part = lambda name, schema: Segments(spark, f"{folder}/{name}", schema, rows)
        self.members, self.renames = part("members", "node string, component string"), part("renames", "component string, root string")
        self.splits, self.totals = part("splits", "component string, split string, size bigint, status string"), part("totals", "split string, size bigint")

    def next_step(self) -> int:
        return max([s.last for s in self.totals.segments()], default=-1) + 1

    def roots_of(self, components: DataFrame, before: int) -> DataFrame:
        """component and root of components (a distinct column component), by following renames; reads those of the components only."""
        x = written(components.select("component", F.col("component").alias("root"), F.lit(True).alias("moved")), "roots")
        while True:
            todo = x.filter("moved").select(F.col("root").alias("component")).distinct().withColumn("hash", F.xxhash64("component"))
            up = _last(self.renames.read(todo, before), "component", "root").select(F.col("component").alias("root"), F.col("root").alias("above"))
            x = written(x.join(up, "root", "left").select("component", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "roots")
            if x.filter("moved").limit(1).count() == 0:
                return x.select("component", "root")

    def components(self, step: int | None = None) -> DataFrame:
        """node and its present component, of all nodes: reads the whole table."""
        before = self.next_step() if step is None else step + 1
        m = self.members.read(before=before).select("node", "component")
        moved = self.renames.read(before=before).select("component").distinct()
        roots = self.roots_of(moved, before)
        return m.join(roots, "component", "left").select("node", F.coalesce("root", "component").alias("component"))

    def assignment(self, step: int | None = None) -> DataFrame:
        """record, component, split and status (kept, new, quarantined) of all records; new are those of components that the last step added."""
        step = self.next_step() - 1 if step is None else step
        last = _last(self.splits.read(before=step + 1), "component", "split", "status")
        status = F.when((F.col("status") == "new") & (F.col("step") < step), "kept").otherwise(F.col("status"))
        records = self.components(step).filter(F.col("node").startswith("r:")).select(F.substr("node", F.lit(3)).alias("record"), "component")
        return records.join(last.select("component", "split", status.alias("status")), "component").select("record", "component", "split", "status")


def _last(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """The columns of each key's row of the latest step."""
    return rows.groupBy(key).agg(F.max_by(F.struct("step", *columns), "step").alias("r")).select(key, "r.*")


def _hashed(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("hash", F.xxhash64(key))


@dataclass
class Merged:
    """What new edges do to the table: new members, old components with the root they belong to now, and all roots touched."""

    members: DataFrame
    old: DataFrame
    roots: DataFrame


def merge_components(edges: DataFrame, store: Store, step: int) -> Merged:
    """Looks up the nodes of the new edges, and no others. Old components enter the search as one node each, so their size doesn't
    matter; those that the new edges join get the smallest name among them. Nothing is written to the store here."""
    nodes = written(_hashed(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node"), "nodes")
    known = written(store.members.read(nodes, before=step).join(nodes.select("node"), "node", "left_semi").select("node", "component"), "known")
    if known.limit(1).count():
        present = written(known.join(store.roots_of(known.select("component").distinct(), step), "component").select("node", "root"), "present")
        a, b = (present.select(F.col("node").alias(k), F.col("root").alias(f"c{k}")) for k in "ab")
        edges = written(edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).distinct(), "lifted")
        roots = written(connected_components(edges), "roots")
        olds = present.select(F.col("root").alias("node")).distinct()
        old = written(roots.join(olds, "node", "left_semi").select(F.col("node").alias("component"), "root"), "old")
        # A component is named by one of its nodes, which is no new one.
        new = roots.join(olds, "node", "left_anti").select("node", F.col("root").alias("component")).join(known.select("node"), "node", "left_anti")
        return Merged(written(new, "new"), old, roots.select("root").distinct())
    roots = connected_components(edges)
    none = empty(store.spark, "component string, root string")
    return Merged(roots.select("node", F.col("root").alias("component")), none, roots.select("root").distinct())


def fill_deficits(components: DataFrame, have: DataFrame, targets: DataFrame, large: float = LARGE) -> DataFrame:
    """component and split for new components (component, size), so that the splits come near their shares.

    have: split, size of what is assigned already; targets: split, share (a handful of rows, read by the driver). Components
    of at least ``large`` of all records, at most 1 / large of them, are taken by size, each to the split that lacks most. The
    rest fills the remaining deficits by running totals: each split gets the stretch of components that it lacks.
    """
    spark = components.sparkSession
    shares = {r["split"]: float(r["share"]) for r in targets.filter("split IS NOT NULL AND share > 0").orderBy("split").collect()}
    if not shares:
        raise ValueError("no split has a positive share")
    done = {r["split"]: r["size"] for r in have.filter(F.col("split").isin(list(shares))).groupBy("split").agg(F.sum("size").alias("size")).collect()}
    total = sum(done.values()) + (components.agg(F.sum("size")).first()[0] or 0)
    lack = {s: total * p / sum(shares.values()) - done.get(s, 0) for s, p in shares.items()}
    bound = max(2, total * large)
    fixed = []
    for r in components.filter(F.col("size") >= bound).orderBy(F.desc("size"), "component").collect():
        split = max(lack, key=lambda s: (lack[s], s))
        lack[split] -= r["size"]
        fixed.append((r["component"], split))
    chosen = spark.createDataFrame(fixed, "component string, split string")
    rest = components.filter(F.col("size") < bound)
    # Running totals in two levels: within one of 256 slots by hash, and over the slots.
    rest = rest.withColumn("slot", F.pmod(F.xxhash64("component"), F.lit(256)))
    within = F.sum("size").over(Window.partitionBy("slot").orderBy("component"))
    slots = rest.groupBy("slot").agg(F.sum("size").alias("n"))
    slots = slots.select("slot", (F.sum("n").over(Window.orderBy("slot")) - F.col("n")).alias("before"))
    middle = F.col("before") + within - F.col("size") / 2
    need = {s: max(0.0, v) for s, v in lack.items()}
    left = sum(need.values())
    ends, at = [], 0.0
    for s, v in need.items():
        at += v / left if left else shares[s] / sum(shares.values())
        ends.append((s, at))
    rest_total = rest.agg(F.sum("size")).first()[0] or 0
    split = reduce(lambda c, e: c.when(middle < rest_total * e[1], e[0]), ends[:-1], F.when(F.lit(False), None)).otherwise(ends[-1][0])
    return chosen.union(rest.join(F.broadcast(slots), "slot").select("component", split.alias("split")))


def assign_splits(edges: DataFrame, targets: DataFrame, store: Store, today: DataFrame | None = None, step: int | None = None) -> DataFrame:
    """Assigns every record of edges (``edges_of``) to a split, adds that to the store and returns one row for each component that the
    edges touch: component, split, size (in records) and status (kept, new, quarantined). ``Store.assignment`` has the records.

    today: record, split as found elsewhere. Components that have one split in the store,
    or else, where the store doesn't know them, one split today, keep it. Components that merge several are quarantined: no
    split of theirs can stay, so the whole group gets one anew, which later calls keep, and the status says so. New and newly
    quarantined components fill the deficits. Splits that targets doesn't name count as none. Of the store, the rows of the edges' own nodes and
    components are read, and the totals; a call that adds to a large table costs no more than what it touches.
    step: the number of the call, by default the next; to run one again, its number.
    """
    step = store.next_step() if step is None else step
    merged = merge_components(edges, store, step)
    old = merged.old
    known = small_side(targets.select("split").distinct())
    before = _last(store.splits.read(_hashed(old, "component"), before=step), "component", "split", "size", "status")
    settled = written(old.join(before, "component").select("component", "root", "split", "size", "status"), "settled")
    fresh = merged.members.filter(F.col("node").startswith("r:")).select(F.substr("node", F.lit(3)).alias("record"), F.col("component").alias("root"))
    sizes = fresh.groupBy("root").agg(F.count("*").alias("added"))
    votes = settled.select("root", "split", (F.col("status") == "quarantined").alias("was"))
    if today is not None:
        now = today.select("record", "split").join(known, "split", "left_semi").join(fresh, "record").select("root", "split", F.lit(False).alias("was")).distinct()
        votes = votes.union(now.join(settled.select("root").distinct(), "root", "left_anti"))
    by = votes.groupBy("root").agg(F.max("split").alias("split"), F.count_distinct("split").alias("n_splits"), F.max("was").alias("was"))
    held = settled.groupBy("root").agg(F.sum("size").alias("held"))
    status = F.when((F.col("n_splits") > 1) | F.col("was"), "quarantined").when(F.col("n_splits") == 1, "kept").otherwise("new")
    x = merged.roots.join(sizes, "root", "left").join(held, "root", "left").join(by, "root", "left")
    size = F.coalesce("added", F.lit(0)) + F.coalesce("held", F.lit(0))
    x = written(x.select(F.col("root").alias("component"), size.alias("size"), F.when(F.col("n_splits") == 1, F.col("split")).alias("split"), status.alias("status")).filter("size > 0"), "sizes")
    left = settled.select("split", (-F.col("size")).alias("size"))
    have = store.totals.read(before=step).select("split", "size").union(left).union(x.filter("split IS NOT NULL").select("split", "size"))
    new = fill_deficits(x.filter("split IS NULL").select("component", "size"), have, targets)
    splits = x.join(new.withColumnRenamed("split", "filled"), "component", "left").select("component", F.coalesce("split", "filled").alias("split"), "size", "status")
    splits = written(_hashed(splits, "component"), "splits")
    store.members.write(step, written(_hashed(merged.members, "node"), "members"))
    store.renames.write(step, written(_hashed(old.filter("component <> root"), "component"), "renames"))
    store.splits.write(step, splits)
    store.totals.write(step, written(_hashed(splits.select("split", "size").union(left).groupBy("split").agg(F.sum("size").alias("size")), "split"), "totals"))
    return splits.select("component", "split", "size", "status")
