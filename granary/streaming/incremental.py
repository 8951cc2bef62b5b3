"""Pages as a stream: new files are normalized and upserted by id; late copies of a content are dropped by watermark."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.canonical import canonical, last_wins
from ..sources.pages import PAGE
from ..sources.shared import stored


def page_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the page files as they arrive, with file and pos for their order."""
    pages = spark.readStream.schema(PAGE).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "page_*.json").json(folder)
    return pages.select(F.col("_metadata.file_path").alias("file"), F.posexplode("vulnerabilities").alias("pos", "v")).select("file", "pos", "v.cve.*")


#: Buckets of ids that a target is kept in. A batch writes those that its ids are in.
BUCKETS = 64


def version_of(spark: SparkSession, target: str, number: int) -> dict[int, int] | None:
    """Where each bucket's rows are after a batch: bucket -> the version that wrote it; None if there is no such version."""
    try:
        listed = spark.read.schema("bucket int, v int").json(f"{target}/versions/v={number}").collect()  # a row for each bucket
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return {r["bucket"]: r["v"] for r in listed}


def current(spark: SparkSession, target: str, number: int) -> DataFrame:
    """The target's rows after a batch."""
    target = target.rstrip("/")
    where = version_of(spark, target, number)
    if where is None:
        raise FileNotFoundError(f"no version {number} in {target}")
    return _bucket_rows(spark, target, where)


def _bucket_rows(spark: SparkSession, target: str, where: dict[int, int]) -> DataFrame:
    return spark.read.parquet(*(f"{target}/v={v}/bucket={b}" for b, v in sorted(where.items())))


def upsert(spark: SparkSession, folder: str, target: str, checkpoint: str, placeholders: list[str], buckets: int = BUCKETS) -> StreamingQuery:
    """Keeps target at the last row of each id, in buckets by the id's hash; a batch reads and writes the buckets it has ids of.

    A batch writes its buckets under v=<its number>, then versions/v=<its number>, which says for every bucket which version
    holds it: this is its commit. What a batch costs follows the batch: of b ids at most b buckets are written anew, each a
    buckets-th of the table. Older versions stay readable by current(). Paths may be of any file system that Spark reads. A
    batch that is run again after a failure writes the same version, so an update happens once. A batch fails if the
    version before its own is missing.
    """
    target = target.rstrip("/")

    def merge(batch: DataFrame, number: int) -> None:
        before = version_of(spark, target, number - 1) if number else {}
        if before is None:
            raise FileNotFoundError(f"no version {number - 1} in {target}")
        new = last_wins(canonical(batch, placeholders, keep=("file", "pos")), "cve_id", "file", "pos")
        new = stored(new.withColumn("bucket", F.pmod(F.xxhash64("cve_id"), F.lit(buckets)).cast("int")))
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # so many at most
        held = {b: before[b] for b in touched if b in before}
        rows = new
        if held:
            old = _bucket_rows(spark, target, held).withColumn("bucket", F.pmod(F.xxhash64("cve_id"), F.lit(buckets)).cast("int"))
            rows = old.join(new.select("cve_id"), "cve_id", "left_anti").unionByName(new)
        if touched:
            rows.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/v={number}")
        after = before | dict.fromkeys(touched, number)
        spark.createDataFrame(sorted(after.items()), "bucket int, v int").coalesce(1).write.mode("overwrite").json(f"{target}/versions/v={number}")

    return page_stream(spark, folder).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_stream(rows: DataFrame, time: str, content: str, delay: str = "1 day") -> DataFrame:
    """A stream without rows whose content came before within the delay."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark([content])


def event_windows(events: DataFrame, size: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Counts and sums of events by tumbling window and type; works on a stream and on a table."""
    if events.isStreaming:
        events = events.withWatermark("ts", delay)
    out = events.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


#: How long after an event of a type a session goes on without another event; GAP for all other types.
GAPS = {"view": "6 hours", "click": "12 hours", "purchase": "1 day"}
GAP = "3 hours"


def sessions(events: DataFrame, gaps: dict[str, str] | None = None, gap: str = GAP, delay: str = "10 minutes") -> DataFrame:
    """Counts and sums of each user's events by session; works on a stream (in append mode) and on a table.

    A session goes on as long as the next event comes before, or when, the gap of an event before it ends, whose length
    its type sets; it ends with the last such gap. Events without a time are in none; a null user is one user.
    """
    if events.isStreaming:
        events = events.withWatermark("ts", delay)
    after = F.lit(gap)
    for kind, length in (GAPS if gaps is None else gaps).items():
        after = F.when(F.col("event_type") == kind, length).otherwise(after)
    out = events.groupBy(F.session_window("ts", after).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n", "total")
