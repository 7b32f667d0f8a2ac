"""Strict CSV, JSON lines, policies, documents, and the sinks that can be written twice."""

from __future__ import annotations

import fnmatch
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arqueo.functions.unicode import nfc
from arqueo.operators.relational import sealed
from arqueo.session import drop_path, ship


def strict_csv(spark: SparkSession, path: str, columns: list[str], name: str = "file", max_bytes: int = 10_000_000, n_rows: int | None = None, filled: list[str] | None = None) -> DataFrame:
    """A CSV file whose header must hold exactly ``columns``, in any order, as strings. A byte order mark is ignored.

    Raises ValueError for repeated, missing or unknown headers, for a file of more than max_bytes, for one without rows, for other than ``n_rows`` rows, and for
    an empty value in a column of ``filled``.
    """
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
    if size > max_bytes:
        raise ValueError(f"{name}: {size} bytes are more than {max_bytes}")
    first = spark.read.text(path).limit(1).collect()
    header = [h.strip().strip('"') for h in first[0][0].lstrip("﻿").split(",")] if first else []
    if sorted(header) != sorted(columns):
        raise ValueError(f"{name}: columns {header} instead of {columns}")
    schema = T.StructType([T.StructField(h, T.StringType()) for h in header])
    x = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)
    empty = [F.count_if(F.col(c).isNull() | (F.trim(c) == "")) for c in filled or []]
    n, *gaps = x.agg(F.count("*"), *empty).first()
    if n == 0:
        raise ValueError(f"{name}: no rows")
    if n_rows is not None and n != n_rows:
        raise ValueError(f"{name}: {n} rows instead of {n_rows}")
    if any(gaps):
        raise ValueError(f"{name}: empty values in {filled}")
    return x.select(*columns)


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, bad lines) of a file of JSON lines; blank lines are skipped, and bad ones don't stop the read."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    x = lines.select("value", F.from_json("value", schema + ", _bad STRING", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return x.filter("r._bad IS NULL").select("r.*").drop("_bad"), x.filter("r._bad IS NOT NULL").select("value")


def document_files(spark: SparkSession, folder: str, pattern: str = "*.[pP][dD][fF]") -> DataFrame:
    """Files below a folder with the digest of their content: file_id (the name in NFC), path, sha256, length, magic (the first four bytes).

    Raises ValueError if there are none, names repeat, or a file has no bytes.
    """
    ship(spark)
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    listed = target.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(target, True)
    fits = re.compile(fnmatch.translate(pattern))
    while listed.hasNext():  # Spark leaves files of no bytes out
        f = listed.next()
        if f.getLen() == 0 and fits.match(f.getPath().getName()):
            raise ValueError(f"{f.getPath()} has no bytes")
    x = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    x = x.select(nfc(F.element_at(F.split("path", "/"), -1)).alias("file_id"), "path", F.sha2("content", 256).alias("sha256"), "length", F.substring("content", 1, 4).alias("magic"))
    n, names = x.agg(F.count("*"), F.count_distinct("file_id")).first()
    if n == 0 or n != names:
        raise ValueError(f"{n} files with {names} names in {folder}")
    return x


def put_missing(df: DataFrame, path: str, key: str) -> int:
    """Appends the rows whose key the table at path doesn't hold, one for each key; returns how many. A second call adds nothing."""
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    new = df.dropDuplicates([key])
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        new = new.join(spark.read.schema(df.schema).parquet(path).select(key), key, "left_anti").select(*df.columns)
    new = new.persist()
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    new.unpersist()
    return n


def put_blobs(blobs: DataFrame, path: str) -> int:
    """Puts contents (column content, binary) into the store at path under their digest, each once; returns how many are new.

    A content that is there already is read and must have its digest still, else ValueError.
    """
    spark = blobs.sparkSession
    x = blobs.select("content").filter("content IS NOT NULL").withColumn("sha256", F.sha2("content", 256)).dropDuplicates(["sha256"])
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        kept = spark.read.schema("content binary, sha256 string").parquet(path)
        spoilt = kept.join(x.select("sha256"), "sha256", "left_semi").filter(F.sha2("content", 256) != F.col("sha256")).limit(1).count()
        if spoilt:
            raise ValueError(f"a content in {path} hasn't its digest")
    return put_missing(x, path, "sha256")


def append_sealed(events: DataFrame, path: str, step: int, series: str, order: str, body: str) -> None:
    """Appends the events of a step to hash chains at path (``relational.sealed``), each chain going on from its last hash. A step that runs again replaces its own
    events, so steps must come in order."""
    spark = events.sparkSession
    own = f"{path.rstrip('/')}/step={step}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []
    before = [f"{path.rstrip('/')}/{n}" for n in names if n.startswith("step=") and int(n[5:]) < step]
    seeds = None
    if before:
        kept = spark.read.parquet(*before)
        seeds = kept.groupBy(series).agg(F.max_by("own_hash", order).alias("seed"))
    sealed(events, series, order, body, seeds=seeds).write.mode("overwrite").parquet(own)


def label_files(spark: SparkSession, path: str) -> DataFrame:
    """file_id, field and expected of label files, JSON objects of files by name, each with fields by name. Null labels stay: the field is not there."""
    x = spark.read.text(path, wholetext=True).select(F.from_json("value", "MAP<STRING, STRUCT<fields: MAP<STRING, STRING>>>").alias("m"))
    return x.select(F.explode("m").alias("file_id", "l")).select("file_id", F.explode("l.fields").alias("field", "expected"))


def export_gate(documents: DataFrame, decisions: DataFrame, code_hash: str, chain: DataFrame | None = None) -> DataFrame:
    """file_id and result of every document, if nothing speaks against exporting them, else ValueError with all reasons.

    documents: id, file_id; decisions: document_id, result, code_hash, one current row a document; chain: rows at which a hash chain breaks (``relational.chain_breaks``).
    Required: documents, file names that differ in NFC, a decision for each, all made by the code whose hash is given, and a whole chain.
    """
    ship(documents.sparkSession)
    d = documents.select(F.col("id").alias("document_id"), nfc(F.col("file_id")).alias("file_id"))
    x = d.join(decisions.select("document_id", "result", "code_hash"), "document_id", "left")
    n, ids, names, open_, other = x.agg(F.count("*"), F.count_distinct("document_id"), F.count_distinct("file_id"), F.count_if(F.col("result").isNull()), F.count_if(F.col("result").isNotNull() & ~F.col("code_hash").eqNullSafe(F.lit(code_hash)))).first()
    broken = 0 if chain is None else chain.limit(1).count()
    reasons = {"no documents": n == 0, "repeated decisions": ids < n, "repeated names": ids == n and names < n, f"{open_} undecided": open_ > 0, f"{other} decided by other code": other > 0, "broken chain": broken > 0}
    if any(reasons.values()):
        raise ValueError(", ".join(k for k, v in reasons.items() if v))
    return x.select("file_id", "result")


#: The file of an export that says which version holds.
POINTER = "CURRENT"


def export_jsonl(df: DataFrame, path: str, key: str, columns: list[str]) -> int:
    """Writes one JSON object a line in order of key, sorted keys, nulls included; returns the rows. ``exported`` reads them.

    Each export is a version of its own below path; when it is whole, a pointer is switched to it, in one rename, and the older versions go. A crash at any time
    leaves the last good export. Raises ValueError if there are no rows, a key is null or repeats, or any other column is null: nothing is written then.
    """
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.col(c).isNull()
    n, keys, nulls = df.agg(F.count("*"), F.count_distinct(key), F.count_if(bad)).first()
    if n == 0 or n != keys or nulls:
        raise ValueError(f"{n} rows, {keys} keys, {nulls} rows with nulls")
    spark, root, version = df.sparkSession, path.rstrip("/"), f"version-{uuid.uuid4().hex}"
    lines = df.select(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}).alias("value"), F.col(key).alias("__k"))
    lines.repartitionByRange("__k").sortWithinPartitions("__k").select("value").write.text(f"{root}/{version}")
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(fs_path(f"{root}/{POINTER}.{version}"), True)
    out.write(bytearray(version.encode()))
    out.close()
    options = spark._jvm.org.apache.hadoop.fs.Options.Rename
    over = spark.sparkContext._gateway.new_array(options, 1)
    over[0] = options.OVERWRITE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs_path(root).toUri() if "://" in root else fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(fs_path(f"{root}/{POINTER}.{version}")), fs.makeQualified(fs_path(f"{root}/{POINTER}")), over)
    for s in fs.listStatus(fs_path(root)):
        name = s.getPath().getName()
        if name not in (version, POINTER) and name.startswith(("version-", f"{POINTER}.")):
            drop_path(spark, f"{root}/{name}")
    return n


def exported(spark: SparkSession, path: str) -> DataFrame:
    """The lines of the last whole export at path."""
    root = path.rstrip("/")
    return spark.read.text(f"{root}/{spark.read.text(f'{root}/{POINTER}').first()[0]}")
