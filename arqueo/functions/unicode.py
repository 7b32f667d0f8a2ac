"""Unicode normal forms, which Spark has no function for: Arrow batches, of which text in ASCII is passed through."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _normal(form: str):
    import pandas as pd

    @F.pandas_udf("string")
    def normal(s: pd.Series) -> pd.Series:
        import unicodedata

        return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize(form, t))

    return normal


def nfc(c: Column) -> Column:
    return _normal("NFC")(c)


def nfkc(c: Column) -> Column:
    return _normal("NFKC")(c)


def cleaned(c: Column) -> Column:
    """NFKC without format characters and blanks around; null gives the empty text."""
    from arqueo.functions.text import trimmed

    return F.coalesce(trimmed(F.regexp_replace(nfkc(c), r"\p{Cf}", "")), F.lit(""))
