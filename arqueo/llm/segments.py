"""Rows by hash in segments, one for each step of a growing table; a probe reads the buckets that its own hashes fall into."""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from arqueo.session import empty

#: Rows that a bucket should hold; a segment has as many buckets as that takes.
ROWS = 50_000
#: Most leading bits of a hash that part a segment.
MAX_BITS = 16
#: So many segments of like size are merged into one.
MERGE = 16


@dataclass(frozen=True)
class Segment:
    first: int
    last: int
    bits: int
    path: str


class Segments:
    """A table in a shared folder: the columns of ``schema``, hash (bigint) and step (int).

    A segment holds the rows of one step, or after merging of a stretch of steps, in folders by the leading bits of the hash;
    there are as many as its rows need, so they grow with the table. It is written aside and then renamed, so that it is there
    whole or not at all, and a step that runs again replaces its own rows. Rows of a step see what earlier steps left only.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, rows: int = ROWS, merge: int = MERGE) -> None:
        self.spark, self.folder, self.schema, self.rows, self.merge = spark, folder.rstrip("/"), f"{schema}, hash bigint, step int", rows, merge

    def _path(self, p: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(p)

    def _fs(self):
        return self._path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        fs, p = self._fs(), self._path(folder)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def segments(self) -> list[Segment]:
        """Those that count, in order: one that a wider one covers is a leftover of a merge."""
        found = [Segment(*map(int, n.split("-")), f"{self.folder}/{n}") for n in self._names(self.folder) if n[:1].isdigit()]
        out: list[Segment] = []
        for s in sorted(found, key=lambda s: (s.first, -s.last)):
            if not out or s.last > out[-1].last:
                out.append(s)
        return out

    def buckets(self, s: Segment) -> list[int]:
        return sorted(int(n.removeprefix("bucket=")) for n in self._names(s.path) if n.startswith("bucket="))

    def write(self, step: int, df: DataFrame) -> None:
        """Puts df (a written table, with hash) in as the rows of a step. A step that lies in a merged segment has been followed by others; it is there already."""
        own = [s for s in self.segments() if s.first <= step <= s.last]
        if own and own[0].first < own[0].last:
            return
        self._put(step, step, df.withColumn("step", F.lit(step)), [n.path for n in own])
        self._merged(step)

    def _put(self, first: int, last: int, df: DataFrame, replaced: list[str]) -> None:
        n = df.count()
        bits = min(MAX_BITS, max(0, math.ceil(math.log2(max(1, n) / self.rows))))
        fs, tmp = self._fs(), f"{self.folder}/_tmp-{uuid.uuid4().hex}"
        x = df.select(*StructType.fromDDL(self.schema).names, _bucket(bits).alias("bucket"))
        # Rebalancing splits a bucket that a hot key makes large.
        x.hint("rebalance", "bucket").sortWithinPartitions("bucket", "hash").write.partitionBy("bucket").parquet(tmp)
        target = f"{self.folder}/{first:08}-{last:08}-{bits:02}"
        for p in replaced:
            fs.delete(self._path(p), True)
        if not fs.rename(self._path(tmp), self._path(target)):
            raise OSError(f"can't rename {tmp}")

    def _merged(self, step: int) -> None:
        """The newest segments before the step are merged as soon as there are enough of them, none larger than all newer ones together.
        The step's own stays by itself, as it may have to run again."""
        tail: list[Segment] = []
        for s in reversed([s for s in self.segments() if s.last < step]):
            if tail and (1 << s.bits) > sum(1 << t.bits for t in tail):
                break
            tail.insert(0, s)
        if len(tail) >= self.merge:
            self._put(tail[0].first, tail[-1].last, self._scan([p for s in tail for p in self._folders(s, None, 0)]), [s.path for s in tail])

    def _folders(self, s: Segment, wanted: set[int] | None, top: int) -> list[str]:
        near = None if wanted is None else {w >> (top - s.bits) for w in wanted}
        return [f"{s.path}/bucket={b}" for b in self.buckets(s) if near is None or b in near]

    def _scan(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else empty(self.spark, self.schema)

    def read(self, hashes: DataFrame | None = None, before: int | None = None) -> DataFrame:
        """The rows of steps before ``before``, or of all; with ``hashes`` (column hash), of the buckets that hold any of them only.

        The driver learns which buckets are wanted, at most 2 to the power of MAX_BITS numbers, whatever hashes holds.
        """
        found = [s for s in self.segments() if before is None or s.first < before]
        top, wanted = max([s.bits for s in found], default=0), None
        if hashes is not None and top:
            wanted = {r[0] for r in hashes.select(_bucket(top).alias("b")).distinct().collect()}
        x = self._scan([p for s in found for p in self._folders(s, wanted, top)])
        return x if before is None else x.filter(F.col("step") < before)


def _bucket(bits: int) -> Column:
    return F.shiftrightunsigned("hash", 64 - bits).cast("int") if bits else F.lit(0)
