"""Nested JSON record pages: date windows, a paged source with retries and a cache, and the scan."""

from __future__ import annotations

import datetime as dt
import importlib
import json
import time
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .parts import opened
from .shared import stored

_TEXTS = "ARRAY<STRUCT<lang: STRING, value: STRING>>"
RECORD = (
    f"id STRING, published STRING, lastModified STRING, vulnStatus STRING, cisaExploitAdd STRING, descriptions {_TEXTS}, "
    f"weaknesses ARRAY<STRUCT<type: STRING, description: {_TEXTS}>>, "
    "metrics STRUCT<cvssMetricV31: ARRAY<STRUCT<cvssData: STRUCT<baseScore: DOUBLE, baseSeverity: STRING>>>>"
)
PAGE = f"resultsPerPage INT, startIndex INT, totalResults INT, vulnerabilities ARRAY<STRUCT<cve: STRUCT<{RECORD}>>>"


def date_windows(spark: SparkSession, start: str, end: str, days: int) -> DataFrame:
    """Inclusive windows [first, last] of so many days, the last one cut at end: one row each."""
    if days < 1:
        raise ValueError("a window has a day at least")
    if start > end:
        raise ValueError("start is after end")
    firsts = F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.make_dt_interval(F.lit(days)).cast("interval day")))
    return spark.range(1).select(firsts.alias("first")).select("first", F.least(F.date_add("first", days - 1), F.lit(end).cast("date")).alias("last"))


class WindowFunction:
    """The same windows as a table function of SQL: date_windows(start, end, days)."""

    def eval(self, start: str, end: str, days: int) -> Iterator[tuple[dt.date, dt.date]]:
        first, last = dt.date.fromisoformat(start), dt.date.fromisoformat(end)
        while first <= last:
            yield first, min(first + dt.timedelta(days - 1), last)
            first += dt.timedelta(days)


def windows_by_function(spark: SparkSession, start: str, end: str, days: int) -> DataFrame:
    """date_windows through the registered table function."""
    spark.udtf.register("date_windows", F.udtf(WindowFunction, returnType="first date, last date"))
    return spark.sql("SELECT * FROM date_windows(:start, :end, :days)", {"start": start, "end": end, "days": days})


def fetch_page(get: Callable[[dict], tuple[int, Any]], params: dict, retries: int = 5, wait: float = 6.0, sleep: Callable[[float], None] = time.sleep) -> Any:
    """One page. 403, 429 and 5xx are tried again after wait * 2 ** attempt seconds; another status is an error."""
    for attempt in range(retries + 1):
        status, body = get(params)
        if status == 200:
            return body
        if status not in (403, 429) and status < 500:
            raise OSError(f"status {status}")
        if attempt < retries:
            sleep(wait * 2**attempt)
    raise OSError(f"no page after {retries} retries")


def cached_page(folder: str | None, window: str, start: int, fetch: Callable[[], Any], force: bool = False) -> Any:
    """A page from the folder's window=.../page_%07d.json, fetched and put there whole unless it is there (or with force)."""
    if folder is None:
        return fetch()
    system, at = opened(folder)
    place = f"{at.rstrip('/')}/window={window}"
    path = f"{place}/page_{start:07d}.json"
    if not force and system.get_file_info(path).type == fs.FileType.File:
        with system.open_input_stream(path) as file:
            return json.loads(file.read())
    page = fetch()
    system.create_dir(place, recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(part) as out:
        out.write(json.dumps(page, ensure_ascii=False).encode())
    system.move(part, path)
    return page


def _size(page: Any) -> int:
    return len(page.get("vulnerabilities", []))


def _fetched(get: Callable[[dict], tuple[int, Any]], folder: str, force: bool, retry: dict):
    """Rows (first, last, start) to what their pages say: how many records, how many there are in all, and where the next begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                params = {"first": row["first"], "last": row["last"], "startIndex": row["start"]}
                page = cached_page(folder, f"{row['first']}_{row['last']}", row["start"], lambda: fetch_page(get, params, **retry), force)  # noqa: B023
                step = page.get("resultsPerPage", _size(page)) or _size(page)
                yield pa.RecordBatch.from_pylist([row | {"records": _size(page), "total": page.get("totalResults", 0), "step": step}], schema=_PAGES)

    return run


_PAGES = pa.schema([("first", pa.string()), ("last", pa.string()), ("start", pa.int64()), ("records", pa.int64()), ("total", pa.int64()), ("step", pa.int64())])
_PAGES_DDL = "first string, last string, start long, records long, total long, step long"


def ingest(spark: SparkSession, get: Callable[[dict], tuple[int, Any]], folder: str | Path, windows: list[tuple[str, str]], snapshot: str, force: bool = False, tasks: int = 8, **retry) -> dict:
    """Fetches all pages of all windows, at most so many at a time, into their windows' folders; writes and returns the manifest.

    Tasks fetch each window's first page, then, as it says how many there are, all others. Pages that are in the folder aren't
    fetched again, so an ingest that failed goes on where it was. A window is complete if its pages hold all its records.
    """
    folder = str(folder)
    rows = spark.createDataFrame([(a, b, 0) for a, b in windows], "first string, last string, start long") if windows else spark.createDataFrame([], "first string, last string, start long")
    fetched = lambda pages: stored(pages.repartition(tasks).mapInArrow(_fetched(get, folder, force, retry), _PAGES_DDL))
    heads = fetched(rows)
    others = heads.where("records > 0 AND step > 0 AND step < total").select("first", "last", F.explode(F.sequence("step", F.col("total") - 1, "step")).alias("start"))
    pages = heads.unionByName(fetched(others))
    done = pages.groupBy("first", "last").agg(F.count(F.lit(1)).alias("pages"), F.max(F.when(F.col("start") == 0, F.col("total"))).alias("total"), F.sum("records").alias("records"))
    found = {(r["first"], r["last"]): r for r in done.collect()}  # a row for each window
    entries = [{"window": f"window={a}_{b}", "start": a, "end": b, "pages": (r := found[a, b])["pages"], "total_results": r["total"], "complete": r["records"] >= r["total"]} for a, b in windows]
    manifest = {
        "snapshot_date": snapshot,
        "start_date": windows[0][0] if windows else None,
        "fetched_at": dt.datetime.now(dt.timezone.utc).isoformat(timespec="seconds"),
        "windows": entries,
        "total_cves": sum(w["total_results"] for w in entries),
        "api_key_used": False,
    }
    system, at = opened(folder)
    system.create_dir(at, recursive=True)
    with system.open_output_stream(f"{at}/manifest.json.tmp") as out:
        out.write(json.dumps(manifest, ensure_ascii=False).encode())
    system.move(f"{at}/manifest.json.tmp", f"{at}/manifest.json")
    return manifest


class PagedSource(DataSource):
    """spark.read and spark.readStream .format("record_pages"): pages, fetched by tasks where they run.

    Options: windows (JSON list of [first, last]); client, the dotted path of a function get(params) -> (status, body);
    params (JSON), what each request has besides; pageSize, how many records a page has; tasks, how many fetch at a time; cache, a folder whose pages aren't fetched again;
    wait and retries, see fetch_page.

    How many pages a window has is asked when a read is planned, by a request for one record. As a stream its offsets are a
    window's place and a start index. A stream reads windows that its checkpoint doesn't have, so a restart fetches none of the
    pages before, and with a cache a batch that failed fetches only the pages it lacked; windows may be added at the end.
    """

    @classmethod
    def name(cls) -> str:
        return "record_pages"

    def schema(self) -> str:
        return "window STRING, start_index INT, body STRING"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _PagedReader(dict(self.options))

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _PagedStream(dict(self.options))


class _Pages:
    """What both readers share; options have lower-case names."""

    def __init__(self, options: dict[str, str]):
        self.windows = json.loads(options["windows"])
        self.client, self.folder, self.params = options["client"], options.get("cache"), json.loads(options.get("params", "{}"))
        self.size, self.tasks = int(options.get("pagesize", 2000)), int(options.get("tasks", 8))
        self.retry = {"wait": float(options.get("wait", 6)), "retries": int(options.get("retries", 5))}

    def get(self, **params) -> Any:
        module, _, function = self.client.rpartition(".")
        return fetch_page(getattr(importlib.import_module(module), function), self.params | params, **self.retry)

    def planned(self, start: tuple[int, int], end: tuple[int, int]) -> list[InputPartition]:
        """The pages from one window and start index to before another, dealt to so many tasks."""
        pages = []
        for place in range(start[0], min(end[0] + 1, len(self.windows))):
            first, last = self.windows[place]
            low, high = start[1] if place == start[0] else 0, end[1] if place == end[0] else None
            if high is None:
                high = self.get(first=first, last=last, startIndex=0, resultsPerPage=1).get("totalResults", 0)
            pages += [(first, last, k) for k in range(low, high, self.size)]
        return [InputPartition(pages[k :: self.tasks]) for k in range(min(self.tasks, len(pages)))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for first, last, start in partition.value:
            fetch = lambda: self.get(first=first, last=last, startIndex=start, resultsPerPage=self.size)  # noqa: E731, B023
            yield f"{first}_{last}", start, json.dumps(cached_page(self.folder, f"{first}_{last}", start, fetch), ensure_ascii=False)


class _PagedReader(_Pages, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return self.planned((0, 0), (len(self.windows), 0)) or [InputPartition([])]


class _PagedStream(_Pages, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"window": 0, "start": 0}

    def latestOffset(self) -> dict:
        return {"window": len(self.windows), "start": 0}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.planned((start["window"], start["start"]), (end["window"], end["start"]))


def scan_pages(spark: SparkSession, folder: str, windows: DataFrame | None = None) -> DataFrame:
    """The records of all pages, or of those of complete windows, with window, page and pos: their order."""
    pages = spark.read.schema(PAGE).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "page_*.json").json(folder)
    path = F.col("_metadata.file_path")
    rows = pages.select(F.regexp_extract(path, r"window=([^/]*)/", 1).alias("window"), F.element_at(F.split(path, "/"), -1).alias("page"), F.posexplode("vulnerabilities").alias("pos", "v"))
    if windows is not None:
        rows = rows.join(windows.where("complete").select("window"), "window", "left_semi")
    return rows.select("window", "page", "pos", "v.cve.*")


def with_order(rows: DataFrame, *columns: str) -> DataFrame:
    """ord: the place of each row by the columns, from 1, as one number."""
    from ..operators.sample import numbered  # which stores its steps as sources do

    return numbered(rows, *columns, name="ord").withColumn("ord", F.col("ord") + 1)
