"""Remote services as Spark data sources: a partition is a page, a batch of ids or an address.

    spark.dataSource.register(Catalogue)
    spark.read.format("catalogue").option("url", ...).option("title", "Emma").option("author", "Austen").load()

Requests have a time-out; a service that says 429 is asked again after growing waits, and what fails otherwise is an error.
Partitions are read by executors, and a partition that is lost is read again. Many addresses or ids go by a table instead
(``download``, or ``lookups.looked_up``, which also keeps a pace).
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .models import ServiceError

# Seconds before a request is given up, waits after "too many requests", pages read of a search, ids in a batch.
TIMEOUT, BUSY_WAITS, PAGES, BATCH = 15, (10, 20, 40, 60), 3, 50


def fetch(url: str, timeout: float = TIMEOUT, waits: tuple[float, ...] = BUSY_WAITS, sleep: Callable[[float], None] = time.sleep) -> bytes:
    """The body at ``url``; ServiceError with the status where there is none."""
    for wait in (*waits, None):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "chronotopia"}), timeout=timeout) as got:
                return got.read()
        except urllib.error.HTTPError as e:
            if e.code != 429 or wait is None:
                raise ServiceError(e.code, url) from e
        except (urllib.error.URLError, TimeoutError) as e:
            raise ServiceError(0, f"{url}: {e}") from e
        sleep(wait)
    raise AssertionError("the last try returns or raises")


def with_query(url: str, **query: object) -> str:
    return url + ("&" if "?" in url else "?") + urllib.parse.urlencode(query)


class Part(InputPartition):
    """One request: its address, and what came before it."""

    def __init__(self, url: str, first: int = 0) -> None:
        super().__init__(url)
        self.url, self.first = url, first


class _Reader(DataSourceReader):
    def __init__(self, options: dict, kind: type) -> None:
        self.options, self.kind = dict(options), kind

    def partitions(self) -> list[Part]:
        return self.kind.parts(self.options)

    def get(self, url: str) -> bytes:
        waits = self.options.get("waits")
        return fetch(url, float(self.options.get("timeout", TIMEOUT)), tuple(map(float, waits.split(","))) if waits else BUSY_WAITS)

    def read(self, partition: Part) -> Iterator[tuple]:
        return self.kind.rows(self.get, partition)


class _Remote(DataSource):
    """Options of all: url, timeout (seconds), waits (seconds after 429, with commas)."""

    def reader(self, schema) -> DataSourceReader:
        if "url" not in self.options and "urls" not in self.options:
            raise ValueError("option url is missing")
        return _Reader(self.options, type(self))


class Catalogue(_Remote):
    """A search (options title, author) of at most ``pages`` pages, or the book ``id``. A page beyond the last has no rows."""

    @classmethod
    def name(cls) -> str:
        return "catalogue"

    def schema(self) -> str:
        return "page int, position int, id long, title string, authors array<struct<name:string,birth_year:int,death_year:int>>, languages array<string>, formats map<string,string>, download_count long, raw string"

    @staticmethod
    def parts(options: dict) -> list[Part]:
        url = options["url"]
        if "id" in options:
            return [Part(f"{url.rstrip('/')}/{options['id']}")]
        words = f"{options.get('title', '')} {options.get('author', '')}".strip()
        return [Part(with_query(url, search=words, page=k), k) for k in range(1, int(options.get("pages", PAGES)) + 1)]

    @staticmethod
    def rows(get: Callable[[str], bytes], part: Part) -> Iterator[tuple]:
        try:
            found = json.loads(get(part.url))
        except ServiceError as e:
            if e.status == 404 and part.first > 1:
                return
            raise
        for at, b in enumerate(found["results"] if part.first else [found]):
            authors = [(a.get("name"), a.get("birth_year"), a.get("death_year")) for a in b.get("authors") or []]
            yield (part.first, at, b.get("id"), b.get("title"), authors, b.get("languages") or [], b.get("formats") or {}, b.get("download_count"), json.dumps(b))


class Entities(_Remote):
    """Entities of the ids in option ``ids`` (with commas), asked in batches; an id that is not known has no row."""

    @classmethod
    def name(cls) -> str:
        return "entities"

    def schema(self) -> str:
        return "id string, label string, description string, sitelinks int, raw string"

    @staticmethod
    def parts(options: dict) -> list[Part]:
        ids = list(dict.fromkeys(x.strip() for x in options.get("ids", "").split(",") if x.strip()))
        size = min(int(options.get("batch", BATCH)), BATCH)
        return [Part(with_query(options["url"], ids="|".join(ids[k : k + size])), k) for k in range(0, len(ids), size)]

    @staticmethod
    def rows(get: Callable[[str], bytes], part: Part) -> Iterator[tuple]:
        for key, e in json.loads(get(part.url)).get("entities", {}).items():
            if "missing" not in e:
                said = lambda field: (e.get(field, {}).get("en") or {}).get("value")
                yield (key, said("labels"), said("descriptions"), len(e.get("sitelinks", {})), json.dumps(e))


class Texts(_Remote):
    """The text at each address of option ``urls`` (one a line)."""

    @classmethod
    def name(cls) -> str:
        return "texts"

    def schema(self) -> str:
        return "url string, text string"

    @staticmethod
    def parts(options: dict) -> list[Part]:
        return [Part(u) for u in options.get("urls", options.get("url", "")).split("\n") if u.strip()]

    @staticmethod
    def rows(get: Callable[[str], bytes], part: Part) -> Iterator[tuple]:
        yield (part.url, get(part.url).decode("utf-8-sig", "replace"))


def download(rows: DataFrame, url: str = "url", timeout: float = TIMEOUT, waits: tuple[float, ...] = BUSY_WAITS) -> DataFrame:
    """(url, text, status) of every distinct address of a table; what can't be had has a null text and the status (0: no answer)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for u in pdf["url"]:
                try:
                    yield pd.DataFrame([(u, fetch(u, timeout, waits).decode("utf-8-sig", "replace"), 200)], columns=["url", "text", "status"])
                except ServiceError as e:
                    yield pd.DataFrame([(u, None, e.status)], columns=["url", "text", "status"])

    asked = rows.select(F.col(url).alias("url")).filter("url IS NOT NULL").distinct()
    return asked.mapInPandas(run, "url string, text string, status int")


def register(spark) -> None:
    """Make the formats ``catalogue``, ``entities`` and ``texts`` known to a session."""
    for source in (Catalogue, Entities, Texts):
        spark.dataSource.register(source)
