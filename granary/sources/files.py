"""JSON lines and JSON documents, written whole or not at all, and digests of files."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable
from pathlib import Path
from typing import Any

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .parts import digests_of, opened


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A row for each line that isn't blank, with ord: ascending in the file's order."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("ord")).where(F.trim("value") != "")
    ddl = schema if isinstance(schema, str) else schema.simpleString()
    return lines.select(F.from_json("value", ddl).alias("row"), "ord").select("row.*", "ord")


def _replace(path: Path, lines: Iterable[str]) -> tuple[int, str]:
    digest, n = hashlib.sha256(), 0
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(path.name + ".tmp")
    with part.open("w", encoding="utf-8", newline="\n") as out:
        for line in lines:
            out.write(line)
            digest.update(line.encode())
            n += 1
        out.flush()
        os.fsync(out.fileno())
    os.replace(part, path)
    return n, digest.hexdigest()


def write_jsonl(rows: DataFrame, path: str | Path, order: list[str], columns: Iterable[str] | None = None) -> tuple[int, str]:
    """One file of JSON lines in that order, of all columns or these; returns how many lines it has and its SHA-256.

    One file in one order is what the format asks for, so rows are streamed through the driver, a partition at a time.
    """
    line = F.to_json(F.struct(*(columns or rows.columns)), {"ignoreNullFields": "false"}).alias("line")
    return _replace(Path(path), (r["line"] + "\n" for r in rows.orderBy(*order).select(line).toLocalIterator()))


def write_json(value: Any, path: str | Path) -> None:
    _replace(Path(path), [json.dumps(value, ensure_ascii=False, indent=2) + "\n"])


def write_text(text: str, path: str | Path) -> None:
    _replace(Path(path), [text])


def read_json(path: str | Path) -> Any:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def file_sha256(path: str | Path) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as file:
        while block := file.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()


def file_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Per file: name, sha256 and rows (lines that aren't blank). A task streams a file's bytes, however many there are."""
    system, at = opened(folder)
    names = sorted(i.base_name for i in system.get_file_info(fs.FileSelector(at)) if i.is_file)
    listed = spark.createDataFrame([(f"{folder.rstrip('/')}/{n}", n) for n in names], "path string, name string")
    return digests_of(listed.repartition(max(1, min(len(names), 1000)))).drop("path")
