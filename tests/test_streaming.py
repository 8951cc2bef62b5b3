"""Streams: the last row of each id over batches, contents once, and the same event windows as a table gives."""

import json
import random
import shutil
from datetime import datetime, timedelta

import pytest
from pyspark.errors import StreamingQueryException

from granary.streaming.incremental import current, distinct_stream, event_windows, sessions, upsert, version_of


def page(folder, name, rows):
    (folder / "window=w").mkdir(parents=True, exist_ok=True)
    body = {"resultsPerPage": 9, "startIndex": 0, "totalResults": 9, "vulnerabilities": [{"cve": {"id": i, "published": "2024-01-01", "descriptions": [{"lang": "en", "value": t}]}} for i, t in rows]}
    (folder / "window=w" / name).write_text(json.dumps(body))


def test_upsert(spark, tmp_path):
    target = str(tmp_path / "out")
    page(tmp_path / "in", "page_0000000.json", [(f"CVE-2024-{k:04d}", f"a{k}") for k in range(1, 60)])
    run = lambda: upsert(spark, str(tmp_path / "in"), target, str(tmp_path / "state"), [], buckets=16).awaitTermination()
    run()
    page(tmp_path / "in", "page_0000002.json", [("CVE-2024-0002", "c"), ("CVE-2024-0099", "d")])
    run()
    want = {f"CVE-2024-{k:04d}": f"a{k}" for k in range(1, 60)}
    texts = lambda v: {r.cve_id: r.description_en for r in current(spark, target, v).collect()}
    assert texts(0) == want and texts(1) == want | {"CVE-2024-0002": "c", "CVE-2024-0099": "d"}
    wrote = [p.name for p in (tmp_path / "out" / "v=1").iterdir() if p.name.startswith("bucket=")]
    assert 1 <= len(wrote) <= 2 < len(version_of(spark, target, 1))  # the other buckets stay where they were
    with pytest.raises(FileNotFoundError):
        current(spark, target, 7)
    shutil.rmtree(tmp_path / "out" / "versions" / "v=1")
    page(tmp_path / "in", "page_0000004.json", [("CVE-2024-0004", "e")])
    with pytest.raises(StreamingQueryException):  # never a version without the rows of the one before
        run()
    assert not (tmp_path / "out" / "v=2").exists()


def test_a_batch_run_again_updates_once(spark, tmp_path):
    """A batch that fails after its rows are written, before its commit, is run again and gives the same table."""
    target, state = str(tmp_path / "out"), str(tmp_path / "state")
    run = lambda: upsert(spark, str(tmp_path / "in"), target, state, [], buckets=4).awaitTermination()
    page(tmp_path / "in", "page_0000000.json", [("CVE-2024-0001", "a"), ("CVE-2024-0002", "b")])
    run()
    page(tmp_path / "in", "page_0000002.json", [("CVE-2024-0002", "c")])
    run()
    (tmp_path / "state" / "commits" / "1").unlink()
    for crc in (tmp_path / "state" / "commits").glob(".1.crc"):
        crc.unlink()
    shutil.rmtree(tmp_path / "out" / "versions" / "v=1")
    run()
    assert {r.cve_id: r.description_en for r in current(spark, target, 1).collect()} == {"CVE-2024-0001": "a", "CVE-2024-0002": "c"}


def through(rows, folder, name, mode, step):
    """What a stream of these files gives."""
    stream = rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    step(stream).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return rows.sparkSession.table(name).collect()


def test_distinct_stream_and_event_windows(spark, tmp_path):
    start = datetime(2024, 1, 1)
    events = [(start + timedelta(minutes=13 * k), "ab"[k % 2], float(k), f"c{k % 7}") for k in range(40)]
    rows = spark.createDataFrame([*events, events[3]], "ts timestamp, event_type string, value double, content string")
    for k in range(2):  # two files: two batches
        rows.where(f"(value >= 20) = ({k} = 1)").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = through(rows, str(tmp_path / "in"), "distinct_rows", "append", lambda s: distinct_stream(s, "ts", "content", "10 days"))
    assert sorted(r.content for r in got) == [f"c{k}" for k in range(7)]
    got = through(rows, str(tmp_path / "in"), "windows", "complete", lambda s: event_windows(s, delay="10 days"))
    assert sorted(map(tuple, got)) == sorted(map(tuple, event_windows(rows).collect()))


def test_sessions_on_a_table_and_a_stream(spark, tmp_path):
    start, minutes = datetime(2024, 1, 1), {"view": 30, "click": 90, "other": 10}
    draw = random.Random(6)
    events = [(start + timedelta(minutes=draw.randrange(3000)), draw.choice([1, 2, None]), draw.choice(["view", "click", "other", None]), float(k)) for k in range(160)]
    events += [(start + timedelta(minutes=4000), 9, "view", 1.0), (start + timedelta(minutes=4030), 9, "view", 1.0), (start + timedelta(minutes=4061), 9, "view", 1.0)]
    rows = spark.createDataFrame([*events, (None, 1, "view", 5.0)], "ts timestamp, user_id long, event_type string, value double")
    gaps, gap = {"view": "30 minutes", "click": "90 minutes"}, "10 minutes"
    want = set()
    for user in {u for _, u, _, _ in events}:
        held = []
        for ts, _, kind, value in sorted((e for e in events if e[1] == user), key=lambda e: e[0]):
            upto = ts + timedelta(minutes=minutes.get(kind, 10))
            if held and ts <= held[-1][1]:
                held[-1] = (held[-1][0], max(held[-1][1], upto), held[-1][2] + 1, held[-1][3] + value)
            else:
                held.append((ts, upto, 1, value))
        want |= {(user, *h) for h in held}
    assert {tuple(r) for r in sessions(rows, gaps, gap).collect()} == want
    for k in range(2):  # in the order of time, as two batches, and one event that closes all
        rows.where(f"ts is not null and (ts >= '2024-01-02') = ({k} = 1)").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([(start + timedelta(days=30), 1, "view", 0.0)], rows.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = through(rows, str(tmp_path / "in"), "session_rows", "append", lambda s: sessions(s, gaps, gap, "2 days"))
    assert {tuple(r) for r in got} == want
