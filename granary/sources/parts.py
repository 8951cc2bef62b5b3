"""JSON lines as parts that tasks write and a manifest publishes: no row passes the driver, and all or nothing is seen.

A task writes its lines to a file of its own under parts/, and says how many there are and what their digest is. Only the
commit makes a manifest of those that count, first beside, then in place of the one before. What a killed or repeated task
left is in no manifest, so no reader sees it; a failed write deletes what it can. A replaced manifest's parts go after the
new one is in place. Lines are in order within a part, and parts in the order of the manifest.

Paths may be local or of any file system that pyarrow knows.
"""

from __future__ import annotations

import hashlib
import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

MANIFEST, BLOCK, PART_ROWS = "manifest.json", 1 << 20, 1 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def streamed_digest(path: str, block: int = BLOCK) -> tuple[str, int]:
    """SHA-256 of a file and how many of its lines aren't blank, read a block at a time."""
    system, at = opened(path)
    digest, rows, blank = hashlib.sha256(), 0, True
    with system.open_input_stream(at) as file:
        while data := file.read(block):
            digest.update(data)
            first, *more = data.split(b"\n")
            blank = blank and not first.strip()
            for line in more:
                rows += not blank
                blank = not line.strip()
    return digest.hexdigest(), rows + (not blank)


def digests_of(files: DataFrame) -> DataFrame:
    """files (path, ...) with sha256 and rows, each read in a task; a lost file is an error."""
    schema = T.StructType([*files.schema.fields, T.StructField("sha256", T.StringType()), T.StructField("rows", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [streamed_digest(p) for p in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([d for d, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], [*batch.schema.names, "sha256", "rows"])

    return files.mapInArrow(run, schema)


@dataclass
class _Part(WriterCommitMessage):
    place: int
    name: str
    rows: int
    sha256: str


class PartsSink(DataSource):
    """df.write.format("jsonl_parts"): lines of one text column; options path, and run, a name of this write's parts."""

    @classmethod
    def name(cls) -> str:
        return "jsonl_parts"

    def schema(self) -> str:
        return "value STRING"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return _PartsWriter(self.options["path"].rstrip("/"), overwrite)


class _PartsWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.run = path, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        context = TaskContext.get()
        place = context.partitionId()
        system, at = opened(self.path)
        system.create_dir(f"{at}/parts", recursive=True)
        name = f"{self.run}-{place:06d}-{context.taskAttemptId()}.jsonl"
        digest, rows = hashlib.sha256(), 0
        with system.open_output_stream(f"{at}/parts/{name}") as out:
            for row in iterator:
                line = (row[0] + "\n").encode()
                out.write(line)
                digest.update(line)
                rows += 1
        return _Part(place, name, rows, digest.hexdigest())

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, at = opened(self.path)
        parts = [{"name": m.name, "rows": m.rows, "sha256": m.sha256} for m in sorted((m for m in messages if m), key=lambda m: m.place) if m.rows]
        before = read_manifest(self.path)
        if before and not self.overwrite:
            parts = before["parts"] + parts
        publish(self.path, parts)
        if before and self.overwrite:
            for part in before["parts"]:
                system.delete_file(f"{at}/parts/{part['name']}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, at = opened(self.path)
        for info in system.get_file_info(fs.FileSelector(f"{at}/parts", allow_not_found=True)):
            if info.base_name.startswith(self.run):
                system.delete_file(info.path)


def publish(path: str, parts: list[dict]) -> dict:
    """Puts a manifest of these parts in place: their number of rows, and the digest of their digests in order."""
    system, at = opened(path)
    whole = hashlib.sha256("".join(p["sha256"] for p in parts).encode()).hexdigest()
    manifest = {"parts": parts, "rows": sum(p["rows"] for p in parts), "sha256": whole}
    system.create_dir(at, recursive=True)
    with system.open_output_stream(f"{at}/{MANIFEST}.tmp") as out:
        out.write(json.dumps(manifest, indent=1).encode())
    system.move(f"{at}/{MANIFEST}.tmp", f"{at}/{MANIFEST}")
    return manifest


def read_manifest(path: str) -> dict | None:
    system, at = opened(path)
    if system.get_file_info(f"{at}/{MANIFEST}").type == fs.FileType.NotFound:
        return None
    with system.open_input_stream(f"{at}/{MANIFEST}") as file:
        return json.loads(file.read())


def write_parts(rows: DataFrame, path: str, order: list[str], columns: list[str] | None = None, overwrite: bool = True, part_rows: int = PART_ROWS) -> dict:
    """The rows as JSON lines in that order, in parts of about part_rows; returns the manifest.

    With overwrite, they take the place of what the folder held; else they come after it.
    """
    rows.sparkSession.dataSource.register(PartsSink)
    tasks = max(1, math.ceil(rows.count() / part_rows))
    line = F.to_json(F.struct(*(columns or rows.columns)), {"ignoreNullFields": "false"}).alias("value")
    ordered = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select(line)
    ordered.write.format("jsonl_parts").option("path", path).mode("overwrite" if overwrite else "append").save()
    return read_manifest(path)


def read_parts(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The rows of the parts that the manifest names, with part and line (ascending in it): together their order."""
    manifest = read_manifest(path)
    if manifest is None:
        raise FileNotFoundError(f"no manifest in {path}")
    ddl = schema if isinstance(schema, str) else schema.simpleString()
    names = [p["name"] for p in manifest["parts"]]
    if not names:
        return spark.createDataFrame([], schema).withColumns({"part": F.lit(0), "line": F.lit(0).cast("long")})
    places = spark.createDataFrame(list(zip(names, range(len(names)), strict=True)), "name string, part int")
    lines = spark.read.text([f"{path.rstrip('/')}/parts/{n}" for n in names]).select("value", F.element_at(F.split("_metadata.file_path", "/"), -1).alias("name"), F.monotonically_increasing_id().alias("line"))
    return lines.join(F.broadcast(places), "name").select(F.from_json("value", ddl).alias("row"), "part", "line").select("row.*", "part", "line")


def changed_parts(spark: SparkSession, path: str) -> DataFrame:
    """name and problem (missing, digest, rows) of the manifest's parts that aren't what it says; read in tasks."""
    manifest, (system, at) = read_manifest(path), opened(path)
    kept = {i.base_name for i in system.get_file_info(fs.FileSelector(f"{at}/parts", allow_not_found=True))}
    listed = spark.createDataFrame([(f"{path.rstrip('/')}/parts/{p['name']}", p["name"], p["sha256"], p["rows"]) for p in manifest["parts"]], "path string, name string, want string, want_rows long")
    here = listed.where(F.col("name").isin(*kept)) if kept else listed.limit(0)
    read = digests_of(here.repartition(max(1, min(len(kept), 1000)))).select("name", F.when(F.col("sha256") != F.col("want"), "digest").when(F.col("rows") != F.col("want_rows"), "rows").alias("problem"))
    lost = listed.where(~F.col("name").isin(*kept) if kept else F.lit(True)).select("name", F.lit("missing").alias("problem"))
    return read.where("problem IS NOT NULL").unionByName(lost)
