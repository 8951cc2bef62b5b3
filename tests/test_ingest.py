"""Pages by tasks: as a table, as a stream that is restarted, and into a folder, with a client that fails at times."""

import json
from collections import Counter

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from granary.sources.files import read_json, read_jsonl
from granary.sources.pages import PagedSource, ingest, scan_pages
from tests import page_client

#: Windows whose last two digits say how many records they have, four a page.
WINDOWS = [["2024-01-09", "2024-01-10"], ["2024-02-03", "2024-02-05"], ["2024-03-00", "2024-03-01"], ["2024-04-12", "2024-04-13"]]
STARTS = {f"{a}_{b}": list(range(0, int(a[-2:]), 4)) for a, b in WINDOWS}


@pytest.fixture
def asked(tmp_path):
    folder = tmp_path / "client"
    folder.mkdir()
    return folder


def requests(folder):
    return Counter(p.name.split("#")[0] for p in folder.glob("*#*"))


def source(spark, asked, kind, windows=WINDOWS, **options):
    spark.dataSource.register(PagedSource)
    given = {"windows": json.dumps(windows), "client": "tests.page_client.get", "params": json.dumps({"folder": str(asked)}), "pageSize": "4", "tasks": "3", "wait": "0.01", **options}
    return getattr(spark, kind).format("record_pages").options(**given).load()


def test_paged_source(spark, asked):
    got = source(spark, asked, "read").collect()
    assert {(r.window, r.start_index): len(json.loads(r.body)["vulnerabilities"]) for r in got} == {(w, s): min(4, int(w[8:10]) - s) for w, starts in STARTS.items() for s in starts}
    assert requests(asked)["2024-01-09@4"] == 2  # once more after a 429


def test_a_restarted_stream_fetches_no_page_twice(spark, asked, tmp_path):
    state, cache = str(tmp_path / "state"), str(tmp_path / "cache")

    def run(windows):
        stream = source(spark, asked, "readStream", windows, cache=cache)
        query = stream.writeStream.format("parquet").option("checkpointLocation", state).start(str(tmp_path / "out"))
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    run(WINDOWS[:2])
    run(WINDOWS[:2])  # nothing new
    fine = lambda: {k: n for k, n in requests(asked).items() if not k.endswith("?")}
    assert fine() == {"2024-01-09@0": 1, "2024-01-09@4": 2, "2024-01-09@8": 1, "2024-02-03@0": 1}
    (asked / "broken.json").write_text('["2024-04-12@8"]')
    with pytest.raises(StreamingQueryException):
        run(WINDOWS)
    (asked / "broken.json").unlink()
    run(WINDOWS)
    after = fine()
    assert after["2024-01-09@0"] == after["2024-01-09@8"] == after["2024-02-03@0"] == 1
    assert after["2024-04-12@0"] == 1 and after["2024-04-12@4"] == 2  # from the cache after the failed batch
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.window, r.start_index) for r in rows) == sorted((w, s) for w, starts in STARTS.items() for s in starts)
    assert scan_pages(spark, cache).count() == 9 + 3 + 12


def test_ingest_by_tasks(spark, asked, tmp_path):
    folder, where = tmp_path / "pages", str(asked)

    def get(params):
        return page_client.get(params | {"folder": where})

    (asked / "broken.json").write_text('["2024-04-12@8"]')
    with pytest.raises(Exception, match="status 404"):
        ingest(spark, get, folder, [tuple(w) for w in WINDOWS], "2024-12-31", wait=0.01)
    assert not (folder / "manifest.json").exists()
    (asked / "broken.json").unlink()
    manifest = ingest(spark, get, folder, [tuple(w) for w in WINDOWS], "2024-12-31", wait=0.01)
    assert [(w["pages"], w["total_results"], w["complete"]) for w in manifest["windows"]] == [(3, 9, True), (1, 3, True), (1, 0, True), (3, 12, True)]
    assert read_json(folder / "manifest.json") == manifest and manifest["total_cves"] == 24
    assert max(n for k, n in requests(asked).items() if not k.endswith("@4") and k != "2024-04-12@8") == 1
    assert scan_pages(spark, str(folder)).count() == 24 and not list(folder.rglob("*.tmp"))
    before = sum(requests(asked).values())
    ingest(spark, get, folder, [tuple(w) for w in WINDOWS], "2024-12-31", wait=0.01)
    assert sum(requests(asked).values()) == before
    ingest(spark, get, folder, [tuple(WINDOWS[1])], "2024-12-31", force=True, wait=0.01)
    assert sum(requests(asked).values()) == before + 1
    assert ingest(spark, get, tmp_path / "none", [], "2024-12-31")["windows"] == []


def test_read_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1, "b": "x"}\n\n   \n{"a": 2}\n{"b": "é\\n"}\n')
    got = read_jsonl(spark, str(tmp_path / "a.jsonl"), "a int, b string").orderBy("ord").select("a", "b").collect()
    assert [tuple(r) for r in got] == [(1, "x"), (2, None), (None, "é\n")]
    assert read_jsonl(spark, str(tmp_path / "a.jsonl"), "a int, b string").where(F.col("ord") < 0).count() == 0
