"""Tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
import runpy
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arqueo.session import ship

#: Folder of the public vocabularies, and the rank file in it.
FOLDER = "/opt/tokenizers"
RANKS = "byte_bpe_50k.tiktoken"


@cache
def _vocabulary(folder: str, ranks: str) -> tuple[str, bytes]:
    """Pattern and ranks, read by the driver."""
    with open(os.path.join(folder, ranks), "rb") as f:
        return runpy.run_path(os.path.join(folder, "__init__.py"))["PATTERN"], f.read()


@cache
def _encoding(pattern: str, ranks: bytes):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def encoding(folder: str = FOLDER, ranks: str = RANKS):
    """The tokenizer, on the driver."""
    return _encoding(*_vocabulary(folder, ranks))


def shared_encoding(spark: SparkSession, folder: str = FOLDER, ranks: str = RANKS):
    """A function that gives the tokenizer in a Python worker, built there once. The vocabulary (about a megabyte) is broadcast, so that
    only the driver needs its file."""
    ship(spark)
    sent = spark.sparkContext.broadcast(_vocabulary(folder, ranks))
    return lambda: _encoding(*sent.value)


def with_token_counts(df: DataFrame, text: str, into: str = "n_tokens", folder: str = FOLDER, ranks: str = RANKS) -> DataFrame:
    """df with the number of tokens of each text (null for null, 0 for the empty text). Arrow batches, no shuffle."""
    from pyspark.sql.functions import pandas_udf

    get = shared_encoding(df.sparkSession, folder, ranks)

    @pandas_udf("int")
    def count(s):
        import pandas as pd

        e = get()
        return pd.Series([None if t is None else len(e.encode_ordinary(t)) for t in s], dtype="Int32")

    return df.withColumn(into, count(F.col(text)))
