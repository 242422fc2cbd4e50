"""Sources from their URLs: bounded, every hop of a redirect checked, failures as rows.

A body is read in chunks of 64 KiB until it is over its bound, so it has one chunk more than that at most. ``fetched()`` takes a
DataFrame of URLs; the data source ``bounded_sources`` takes a list of them as an option.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from urllib.error import HTTPError
from urllib.parse import urljoin
from urllib.request import HTTPRedirectHandler, OpenerDirector, Request, build_opener

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.urls import safe
from ..functions.workers import sent_by_value

sent_by_value(__name__)

#: Bytes of a chunk and of a body, and seconds that a server may take.
CHUNK, MOST, SECONDS = 65_536, 1_500_000, 30
HOPS, IN_FLIGHT = 10, 8
AGENT = "gradeloom"
FIELDS = "final_url string, content_type string, body binary, status string, error string"


class _Stay(HTTPRedirectHandler):
    """Redirects are errors, so that each of them is looked at."""

    def redirect_request(self, *_):
        return None


def get(url: str | None, most: int = MOST, allowed: Callable[[str], bool] = safe, opener: OpenerDirector | None = None) -> tuple:
    """final_url, content_type, body, status and error of a URL."""
    opener, at = opener or build_opener(_Stay), url
    try:
        for _ in range(HOPS):
            if not at or not allowed(at):
                raise ValueError("unsafe URL" if at == url else "redirected to an unsafe URL")
            try:
                with opener.open(Request(at, headers={"User-Agent": AGENT}), timeout=SECONDS) as f:
                    body = bytearray()
                    while len(body) <= most and (chunk := f.read(CHUNK)):
                        body += chunk
                    return at, (f.headers.get("content-type") or "").lower(), bytes(body), "ok", None
            except HTTPError as e:
                if e.code not in (301, 302, 303, 307, 308) or not e.headers.get("location"):
                    raise
                at = urljoin(at, e.headers["location"])
        raise ValueError(f"more than {HOPS} redirects")
    except Exception as e:  # noqa: BLE001 - any failure of a source is a row's error
        return at, None, None, "failed", f"{type(e).__name__}: {e}"


def fetched(rows: DataFrame, url: str = "url", tasks: int = 8, most: int = MOST, allowed: Callable[[str], bool] = safe) -> DataFrame:
    """rows with final_url, content_type, body, status and error; each task has a few requests under way."""
    names = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(IN_FLIGHT) as pool:
            for batch in batches:
                for k in range(0, len(batch), 2 * IN_FLIGHT):
                    b = batch.iloc[k : k + 2 * IN_FLIGHT]
                    got = list(pool.map(lambda u: get(u, most, allowed), b[url]))
                    yield b.assign(**{c: pd.Series([g[i] for g in got], index=b.index, dtype=object) for i, c in enumerate(("final_url", "content_type", "body", "status", "error"))})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.repartition(tasks, url).mapInPandas(run, f"{schema}, {FIELDS}").select(*names, "final_url", "content_type", "body", "status", "error")


class Urls(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class BoundedSources(DataSource):
    """Options: urls (a JSON list), most (bytes), per_partition (URLs)."""

    allowed = staticmethod(safe)

    @classmethod
    def name(cls) -> str:
        return "bounded_sources"

    def schema(self) -> str:
        return f"url string, {FIELDS}"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(json.loads(self.options["urls"]), int(self.options.get("most", MOST)), int(self.options.get("per_partition", 4)), self.allowed)


class _Reader(DataSourceReader):
    def __init__(self, urls: list[str], most: int, per_partition: int, allowed: Callable[[str], bool]):
        self.urls, self.most, self.n, self.allowed = urls, most, per_partition, allowed

    def partitions(self) -> list[InputPartition]:
        return [Urls(self.urls[k : k + self.n]) for k in range(0, len(self.urls), self.n)] or [Urls([])]

    def read(self, partition: Urls) -> Iterator[tuple]:
        for url in partition.urls:
            yield (url, *get(url, self.most, self.allowed))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BoundedSources)
