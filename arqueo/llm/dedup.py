"""New batches against everything accepted before, without reading that history again."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arqueo.functions.text import BLANK, composed, data, halfwidth
from arqueo.llm.segments import Segments
from arqueo.session import new_path, written


def digest(*parts: Column) -> Column:
    """128 bits that stand for the parts."""
    return F.unhex(F.md5(F.concat_ws("\x01", *parts)))


def band_keys(slots: list[Column], agree: int) -> Column:
    """The band keys of a record whose similarity is the number of slots in which two records agree.

    The signature has the hash of each slot's value, not minima over random permutations: a band takes ``agree`` slots, and all
    choices of them are bands, so that two records with ``agree`` equal slots meet in one for certain; with minwise rows they
    might not. A band that lacks a value has no key. Array of structs kind, key.
    """
    bands = [
        F.when(F.forall(F.array(*[slots[i] for i in c]), lambda x: x.isNotNull()), F.struct(F.lit("band").alias("kind"), digest(F.lit("-".join(map(str, c))), *[slots[i] for i in c]).alias("key")))
        for c in combinations(range(len(slots)), agree)
    ]
    return F.array_compact(F.array(*bands))


def features(df: DataFrame, record: Column, order: Column, exact: dict[str, Column], fallback: dict[str, Column], bare: Column, slots: list[Column], agree: int) -> DataFrame:
    """What the operator needs of each record: id, ord, sig (the slots' hashes) and keys (kind, key, later).

    exact: values that make records the same if equal; fallback: values by which a record with ``bare`` repeats any earlier
    one; slots and agree: readings of which ``agree`` must be equal. Null values never match. Records of equal order are
    taken by id; a null order comes last. Records without id are left out, as nothing could name them.
    """
    # ``later``: the record may be found to repeat another by this key; without it, it can only be repeated.
    key = lambda kind, c, later: F.when(c.isNotNull(), F.struct(F.lit(kind).alias("kind"), digest(F.lit(kind), c).alias("key"), later.alias("later")))
    keys = F.array_compact(F.array(*[key(k, c, F.lit(True)) for k, c in exact.items()], *[key(k, c, F.coalesce(bare, F.lit(False))) for k, c in fallback.items()]))
    bands = F.transform(band_keys(slots, agree), lambda b: F.struct(b["kind"].alias("kind"), b["key"].alias("key"), F.lit(True).alias("later")))
    x = df.select(record.alias("id"), F.struct(order.isNull().alias("none"), order.alias("at"), record.alias("id")).alias("ord"), F.array(*[F.when(s.isNotNull(), F.xxhash64(s)) for s in slots]).alias("sig"), F.concat(keys, bands).alias("keys"))
    return x.filter("id IS NOT NULL")


def _exploded(df: DataFrame) -> DataFrame:
    return df.select("id", "ord", "sig", F.explode("keys").alias("k")).select("id", "ord", "sig", "k.*").withColumn("hash", F.xxhash64("key"))


def _verified(agree: int) -> Column:
    """Bands are verified on the signatures; the other kinds are equal values."""
    same = F.size(F.filter(F.arrays_zip(F.col("sig").alias("x"), F.col("kept_sig").alias("y")), lambda p: p["x"] == p["y"]))
    return (F.col("kind") != "band") | (same >= agree)


def key_index(spark: SparkSession, folder: str) -> Segments:
    """The table of accepted keys: id, kind, key, sig."""
    return Segments(spark, folder, "id string, kind string, key binary, sig array<bigint>")


def dedup_batch(new: DataFrame, index: Segments, agree: int, step: int) -> tuple[DataFrame, DataFrame]:
    """Accepts what is new in a batch and adds its keys to the index.

    new: as from ``features``. index: as from ``key_index``; of it the buckets of the batch's own keys are read, in what the
    steps before ``step`` left. Steps are numbered in order of arrival. A step that runs again, after a failure or
    once more, sees the same history and replaces its own keys: it gives the same rows and finds no repeats of itself.
    Returns (accepted, repeats): accepted has id; repeats has id and kept_id, one row for each accepted record, of this batch or
    before, that the record repeats. A record that repeats only rejected records is accepted.

    Within the batch, order decides. In each round, a record is accepted that is the first undecided one under all of its keys,
    and then those under the same keys are rejected. Only minimums per key are computed, so a key that a third of the batch
    shares costs no more than its rows; rounds are as many as repeats form chains. An empty batch changes nothing.
    """
    keys = written(_exploded(new), "keys")
    everyone = keys
    kept = index.read(keys, before=step).select("key", F.col("id").alias("kept_id"), F.col("sig").alias("kept_sig"))
    hits = written(keys.filter("later").join(kept, "key").filter(_verified(agree)).select("id", "kept_id").distinct(), "hits")
    repeats = [hits]
    rest = keys = written(keys.join(hits.select("id").distinct(), "id", "left_anti"), "keys")
    accepted = []
    while True:
        low = rest.groupBy("key").agg(F.min("ord").alias("low"))
        waits = rest.join(low, "key").groupBy("id").agg(F.max(F.col("later") & (F.col("low") < F.col("ord"))).alias("waits"))
        state = written(waits, "state")
        won = state.filter("NOT waits").select("id")
        accepted.append(won)
        if state.filter("waits").limit(1).count() == 0:
            break
        left = rest.join(state.filter("waits").select("id"), "id", "left_semi")
        winners = rest.join(won, "id", "left_semi").groupBy("key").agg(F.min("ord").alias("first"))
        lost = left.filter("later").join(winners, "key").filter(F.col("first") < F.col("ord")).select("id").distinct()
        rest = written(left.join(lost, "id", "left_anti"), "rest")
        if rest.limit(1).count() == 0:
            break
    keyless = new.filter(F.size("keys") == 0).select("id")  # nothing to compare
    won = written(reduce(DataFrame.union, accepted).union(keyless), "accepted")
    own = written(keys.join(won, "id", "left_semi").select("id", "ord", "kind", "key", "sig", "hash"), "own")
    # A record that repeats older ones may repeat some of its own batch besides.
    inner = everyone.join(won, "id", "left_anti").filter("later").join(own.select("key", F.col("id").alias("kept_id"), F.col("ord").alias("kept_ord"), F.col("sig").alias("kept_sig")), "key")
    repeats.append(inner.filter((F.col("kept_ord") < F.col("ord")) & _verified(agree)).select("id", "kept_id").distinct())
    index.write(step, own.drop("ord"))
    return won, reduce(DataFrame.union, repeats)


def file_name(c: Column) -> Column:
    """A file name without letter case, Unicode form, blanks, underscores, extension and marks of copies (a number in brackets,
    copia, copy, copia de, v with a number)."""
    x = F.lower(composed(halfwidth(c)))
    x = F.regexp_replace(x, r"[\p{Cf}]+", "")
    x = F.regexp_replace(x, rf"^[{BLANK}_]+|[{BLANK}_]+$|(?:copia|copy)[{BLANK}_]+(?:de|of)[{BLANK}_]+", "")
    mark = rf"(?:[{BLANK}_\-]*\([0-9]+\)|[{BLANK}_\-]+(?:copia|copy|v[0-9]+))*"
    x = F.regexp_replace(x, rf"{mark}(\.[a-z]{{2,4}}){mark}$|{mark}$", "$1")
    return F.nullif(F.regexp_replace(x, rf"[{BLANK}_]+", ""), F.lit(""))


def content_digest(c: Column) -> Column:
    return F.nullif(F.regexp_replace(F.lower(data(c)), "^sha256:", ""), F.lit(""))


def in_steps(all_features: DataFrame, arrival: DataFrame, steps: int, agree: int, index: Segments | None = None) -> DataFrame:
    """Takes records in ``steps`` batches, one after the other in order of arrival, into an index (a new one if none is given);
    returns id, kept_id.

    arrival: the column at of the times at which batches arrived. Its quantiles part the steps, so that each has as many arriving
    batches; a step only sees its own records and what the earlier ones left. Order decides within a step as it does
    between steps, so the rows are the same for any number of steps.
    """
    spark = all_features.sparkSession
    cuts = arrival.select(F.percentile_approx("at", [i / steps for i in range(1, steps)], 10_000).alias("q")).first()["q"] or []
    cuts = sorted(set(cuts))
    index = index or key_index(spark, new_path(spark, "index"))
    out = None
    at = F.col("ord.at")
    for i, (lo, hi) in enumerate(zip([None, *cuts], [*cuts, None], strict=True)):
        part = all_features
        if lo is not None:
            part = part.filter((at >= F.lit(lo)) | (at.isNull() if hi is None else F.lit(False)))
        if hi is not None:
            part = part.filter(at < F.lit(hi))
        _, repeats = dedup_batch(part, index, agree, i)
        repeats = written(repeats, "repeats")
        out = repeats if out is None else out.union(repeats)
    return out
