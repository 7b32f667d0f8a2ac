"""Paginated XML exports: pages of one snapshot, which is published whole or not at all."""

from __future__ import annotations

import math
import random
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from arqueo.session import ship

ROW = "STRUCT<id: STRING, fecha: STRING, proveedor: STRING, nif: STRING, pedido: STRING, importe: STRING, estado: STRING>"
PAGE = f"meta STRUCT<total: INT, paginas: INT>, asientos STRUCT<asiento: ARRAY<{ROW}>>"


def snapshot_rows(pages: DataFrame, snapshot: str = "snapshot_id", xml: str = "xml") -> tuple[DataFrame, DataFrame]:
    """(rows, incomplete) of pages (snapshot, page, xml as text).

    A snapshot is complete if every page parses and repeats the same total and number of pages, all pages are there once, and as
    many distinct ids come as the total says. Rows are given of complete ones only; incomplete has the others with the reason.
    """
    x = pages.select(F.col(snapshot).alias("snapshot_id"), "page", F.from_xml(F.col(xml), PAGE).alias("p"))
    x = x.select("snapshot_id", "page", "p.meta", F.coalesce("p.asientos.asiento", F.array().cast(f"ARRAY<{ROW}>")).alias("rows"))
    heads = x.groupBy("snapshot_id").agg(
        F.count("*").alias("n_pages"), F.count_distinct("page").alias("n_numbers"), F.count_if(F.col("meta.total").isNull()).alias("n_bad"), F.count_distinct("meta").alias("n_metas"),
        F.max("meta.total").alias("total"), F.max("meta.paginas").alias("pages"), F.sum(F.size("rows")).alias("n_rows"),
    )
    ids = x.select("snapshot_id", F.explode("rows.id").alias("id")).groupBy("snapshot_id").agg(F.count_distinct("id").alias("n_ids"))
    heads = heads.join(ids, "snapshot_id", "left")
    reason = (
        F.when(F.col("n_bad") > 0, "unreadable_page").when(F.col("n_metas") != 1, "changing_meta").when((F.col("n_pages") != F.col("pages")) | (F.col("n_numbers") != F.col("pages")), "missing_page")
        .when(F.col("n_rows") != F.col("total"), "wrong_total").when(F.coalesce("n_ids", F.lit(0)) != F.col("total"), "repeated_ids")
    )
    heads = heads.select("snapshot_id", reason.alias("reason"))
    good = heads.filter("reason IS NULL").select("snapshot_id")
    rows = x.join(good, "snapshot_id", "left_semi").select("snapshot_id", F.explode("rows").alias("r")).select("snapshot_id", "r.*")
    return rows, heads.filter("reason IS NOT NULL")


class Unavailable(Exception):
    """A source that can't be read now; nothing of the snapshot is published."""


#: Requests for one page, seconds between requests, and the longest wait that is worth it.
ATTEMPTS, SPACING, LONGEST = 5, 0.15, 30.0


def delay(attempt: int, retry_after: str | None, now: datetime | None = None) -> float:
    """Seconds to wait after a failed attempt (from 1): what the answer asks for, in seconds or as a date, or else twice as long each time, up to
    five seconds, and a little more by chance."""
    if retry_after:
        try:
            asked = float(retry_after)
        except ValueError:
            try:
                asked = (parsedate_to_datetime(retry_after) - (now or datetime.now(UTC))).total_seconds()
            except (ValueError, TypeError, OverflowError):
                asked = math.nan
        if math.isfinite(asked):
            return max(0.0, asked)
    return min(0.2 * 2 ** (attempt - 1), 5.0) + random.uniform(0, 0.05)


class Session:
    """A paginated source behind a login: one request at a time, spaced and repeated.

    send(url, data, headers) gives (status, headers, body) and raises OSError if there is no answer. An answer of 401 logs in again; 429, 500 and 502 to 504, like no
    answer, wait and try again; any other status, XML that doesn't parse, a wait of more than LONGEST seconds and a failed last attempt raise Unavailable.
    """

    def __init__(self, url: str, user: str, password: str, send: Callable | None = None, sleep: Callable[[float], None] = time.sleep) -> None:
        self.url, self.user, self.password, self.send, self.sleep = url.rstrip("/"), user, password, send or _send, sleep
        self.token: str | None = None
        self.last = -math.inf

    def request(self, path: str, login: bool = False) -> bytes:
        for attempt in range(1, ATTEMPTS + 1):
            if not login and self.token is None:
                self.token = ElementTree.fromstring(self.request("/login", login=True)).findtext(".//token")
            self.sleep(max(0.0, SPACING - (time.monotonic() - self.last)))
            self.last = time.monotonic()
            status, headers = 0, {}
            try:
                data = urllib.parse.urlencode({"usuario": self.user, "clave": self.password}).encode() if login else None
                status, headers, body = self.send(self.url + path, data, {} if login else {"X-ERP-Token": self.token or ""})
            except OSError:
                body = b""
            if status == 200:
                try:
                    ElementTree.fromstring(body)
                except ElementTree.ParseError as e:
                    raise Unavailable(f"no XML in {path}") from e
                return body
            if status == 401 and not login:
                self.token = None
            elif status not in (0, 429, 500, 502, 503, 504):
                raise Unavailable(f"status {status} of {path}")
            if attempt < ATTEMPTS:
                wait = delay(attempt, headers.get("Retry-After"))
                if wait > LONGEST:
                    raise Unavailable(f"{path} asks to wait {wait:.0f} s")
                self.sleep(wait)
        raise Unavailable(f"{path} failed {ATTEMPTS} times")

    def pages(self, path: str = "/asientos") -> Iterator[tuple[int, str]]:
        """(page, XML) of all pages that the first one tells of."""
        n, k = 1, 1
        while k <= n:
            body = self.request(f"{path}?pagina={k}")
            if k == 1:
                n = int(ElementTree.fromstring(body).findtext("meta/paginas") or 1)
            yield k, body.decode("utf-8")
            k += 1


def _send(url: str, data: bytes | None, headers: dict) -> tuple[int, dict, bytes]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, data, headers), timeout=30) as r:
            return r.status, dict(r.headers), r.read()
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers), e.read()


class _PageReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self):
        return [InputPartition(0)]  # the source bears one request at a time

    def read(self, partition):
        s = Session(self.options["url"], self.options.get("user", ""), self.options.get("password", ""))
        for page, xml in s.pages(self.options.get("pages", "/asientos")):
            yield self.options.get("snapshot_id", ""), page, xml


class Pages(DataSource):
    """Options url, user, password, pages (the path) and snapshot_id."""

    @classmethod
    def name(cls) -> str:
        return "xml_pages"

    def schema(self) -> str:
        return "snapshot_id string, page int, xml string"

    def reader(self, schema):
        return _PageReader(dict(self.options))


def read_pages(spark: SparkSession, url: str, snapshot_id: str, user: str = "", password: str = "") -> DataFrame:
    """The pages of a snapshot for ``snapshot_rows``. Write them before use: each read asks the source again."""
    ship(spark)
    spark.dataSource.register(Pages)
    return spark.read.format("xml_pages").options(url=url, snapshot_id=snapshot_id, user=user, password=password).load()
