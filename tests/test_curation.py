"""The curation operators on small rows with known results."""

import json
import random

import pytest
from pyspark.sql import functions as F

from granary import config
from granary.functions.text import normalized_nfkc
from granary.operators import canonical as can
from granary.operators import curate, export, sample
from granary.sources import files
from granary.sources.pages import date_windows, fetch_page, ingest, scan_pages


def record(number, labels=(), secondary=(), **more):
    weaknesses = [{"type": "Primary", "description": [{"lang": "en", "value": x} for x in labels]}] if labels else []
    weaknesses += [{"type": "Secondary", "description": [{"lang": "en", "value": x} for x in secondary]}] if secondary else []
    base = {"id": f"CVE-2024-{number:04d}", "published": "2024-02-03T04:05:06.000", "lastModified": "2024-02-04", "vulnStatus": "Analyzed", "descriptions": [{"lang": "en", "value": f" Text {number} "}]}
    return {"cve": base | ({"weaknesses": weaknesses} if weaknesses else {}) | more}


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pages")
    records = [
        record(1, ["CWE-79"], metrics={"cvssMetricV31": [{"cvssData": {"baseScore": 6.1, "baseSeverity": "MEDIUM"}}]}),
        record(2, ["CWE-79"], ["CWE-79"]),
        record(3, ["CWE-79"], ["CWE-9"]),
        record(4, ["NVD-CWE-noinfo"]),
        record(5),
        record(6, ["CWE-79"], vulnStatus="Rejected"),
        record(7, ["CWE-89"], cisaExploitAdd="2024-03-01"),
        record(8, ["CWE-89"], descriptions=[{"lang": "fr", "value": "bonjour"}]),
        {"cve": record(9)["cve"] | {"id": "CVE-24-1"}},
        record(1, ["CWE-22"]),
    ]

    def get(params):
        start = params["startIndex"]
        return 200, {"resultsPerPage": 4, "startIndex": start, "totalResults": len(records), "vulnerabilities": records[start : start + 4]}

    manifest = ingest(spark, get, folder, [("2024-01-01", "2024-04-28")], "2024-12-31")
    assert manifest["total_cves"] == 10 and manifest["windows"][0]["pages"] == 3
    return str(folder)


def test_canonical_rows(spark, pages):
    rows = can.canonical(scan_pages(spark, pages), ["NVD-CWE-noinfo"], keep=("window", "page", "pos"))
    last = {r.cve_id: r for r in can.last_wins(rows, "cve_id", "window", "page", "pos").collect()}
    assert len(last) == 8
    assert last["CVE-2024-0001"].cwe_id == "CWE-22"  # the later copy of the id
    assert last["CVE-2024-0002"].label_status == "single" and last["CVE-2024-0002"].cwe_all == ["CWE-79"]
    assert last["CVE-2024-0003"].label_status == "multi" and last["CVE-2024-0003"].cwe_id is None and last["CVE-2024-0003"].cwe_all == ["CWE-79", "CWE-9"]
    assert last["CVE-2024-0004"].label_status == "placeholder_only" and last["CVE-2024-0004"].placeholder_only
    assert last["CVE-2024-0005"].label_status == "none"
    assert last["CVE-2024-0006"].is_rejected and last["CVE-2024-0007"].is_kev and last["CVE-2024-0007"].kev_date_added == "2024-03-01"
    assert last["CVE-2024-0008"].description_en == "" and last["CVE-2024-0002"].description_en == "Text 2"
    first = {r.cve_id: r for r in rows.where("pos = 0 AND page = 'page_0000000.json'").collect()}
    assert first["CVE-2024-0001"].cvss_v31_base_score == 6.1


def test_validator(spark, pages):
    rows = can.last_wins(can.canonical(scan_pages(spark, pages), ["NVD-CWE-noinfo"], nfkc=False, keep=("window", "page", "pos")), "cve_id", "window", "page", "pos")
    lines = [r.line for r in rows.select(F.to_json(F.struct(*can.COLUMNS), {"ignoreNullFields": "false"}).alias("line")).collect()]
    wrong = json.loads(lines[0]) | {"label_status": "multi", "description_norm_hash": "0" * 64}
    short = {k: v for k, v in json.loads(lines[0]).items() if k != "is_kev"}
    texts = [*lines, json.dumps(wrong), json.dumps(short), "[1]", "{oops"]
    checked = can.validate(spark.createDataFrame(list(enumerate(texts)), "ord long, value string"))
    found = {r.ord: r.problems for r in checked.collect()}
    n = len(lines)
    assert all(found[i] == [] for i in range(n)), found
    assert set(found[n]) == {"inconsistent_label_status", "description_norm_hash_mismatch"}
    assert "missing_field:is_kev" in found[n + 1]
    assert found[n + 2] == ["record_not_object"] and found[n + 3] == ["invalid_json"]
    summary = can.validation_summary(checked)
    assert summary["rows"] == n + 4 and summary["invalid"] == 4 and summary["problems_by_type"]["missing_field"] == 1


def test_windows_and_retries(spark):
    rows = date_windows(spark, "2020-01-01", "2020-09-30", 119).collect()
    assert [(str(r[0]), str(r[1])) for r in rows] == [("2020-01-01", "2020-04-28"), ("2020-04-29", "2020-08-25"), ("2020-08-26", "2020-09-30")]
    with pytest.raises(ValueError):
        date_windows(spark, "2020-02-01", "2020-01-01", 1)
    answers, waits = iter([(429, None), (503, None), (200, {"ok": 1})]), []
    assert fetch_page(lambda p: next(answers), {}, wait=1, sleep=waits.append) == {"ok": 1} and waits == [1, 2]
    with pytest.raises(OSError):
        fetch_page(lambda p: (404, None), {})


def test_normal_form(spark):
    rows = spark.createDataFrame([("Ｆull  Width X ",), ("full width x",)], "t string")
    assert {r[0] for r in rows.select(normalized_nfkc("t")).collect()} == {"full width x"}


def test_splits_and_labels(spark):
    ranges, snapshot = config.DEFAULTS["splits"], "2026-09-17"
    dates = [("2024-12-31", "train"), ("2025-01-01", "val"), ("2026-01-01", "test"), ("2019-12-31", None), ("2026-09-18", None)]
    got = spark.createDataFrame(dates, "d string, s string").select("s", curate.split_of(F.col("d"), ranges, snapshot).alias("got")).collect()
    assert all(r.s == r.got for r in got)
    rows = spark.createDataFrame([("a",)] * 3 + [("b",)] * 2 + [("c",)], "cwe_id string")
    assert [(r.rank, r.cwe_id) for r in curate.select_labels(rows, 3, 2).orderBy("rank").collect()] == [(1, "a"), (2, "b")]


SMALL = [("train", "A", "2020-01-02", "h1", 1), ("train", "B", "2020-01-01", "h1", 2), ("train", "C", "2020-01-01", "h2", 3), ("val", "D", "2025-01-01", "h2", 4), ("val", "E", "2025-01-01", "h3", 5), ("test", "F", "2026-01-01", "h3", 6)]


def test_dedup_overlap_and_guard(spark):
    rows = spark.createDataFrame(SMALL, "split string, cve_id string, published string, description_norm_hash string, ord long")
    kept = curate.curated(rows, config.DEFAULTS["dedup"])
    assert {(r.split, r.cve_id) for r in kept.collect()} == {("train", "B"), ("test", "F")}
    train, val = rows.where("split = 'train'"), rows.where("split = 'val'")
    assert [(r.cve_id, r.other_id) for r in curate.overlap(train, val, "description_norm_hash").collect()] == [("C", "D")]
    with pytest.raises(ValueError):
        curate.overlap(train, val, "published")
    marked = rows.withColumn("text_hash", F.col("description_norm_hash"))
    result = curate.guard(marked)
    assert not result["ok"] and result["pairs"]["train_val"] == {"cve_id": 0, "text_hash": 1, "examples": [["C", "D", "h2"]]}
    with pytest.raises(curate.SplitInvariantError):
        curate.guarded(marked)
    assert curate.guard(marked.where("cve_id IN ('B', 'F')"))["ok"]
    found = curate.contamination(rows, kept)
    assert found["train_internal_exact_duplicates"] == 1 and found["train_val_exact_text_overlap"] == 1 and not any(found["post_build"].values())


def test_samples(spark):
    rows = spark.createDataFrame([(i, f"id{i}") for i in range(10)], "ord long, cve_id string")
    places = list(range(10))
    random.Random(11).shuffle(places)
    assert [r.ord for r in sample.subset(rows, 7, 11).orderBy("draw_rank").collect()] == places[:7]
    generator = random.Random(5)
    picked = generator.sample(range(10), 6)
    generator.shuffle(picked)
    assert [r.ord for r in sample.exact_sample(rows, 6, 5).orderBy("draw_rank").collect()] == picked
    many = spark.createDataFrame([(None, -1), *((k * k % 1009 + 1009 * k, k) for k in range(400))], "ord long, k int").repartition(5)
    ordered = sorted(((-1 if r.ord is None else r.ord), r.place) for r in sample.numbered(many).collect())
    assert [place for _, place in ordered] == list(range(401)) and sample.numbered(many.limit(0)).count() == 0
    assert [r.ord for r in sample.subset(rows, 4, None).orderBy("draw_rank").collect()] == [0, 1, 2, 3]
    assert sample.allocate({"x": 50, "y": 3, "z": 3}, 8) == {"x": 6, "y": 1, "z": 1}
    draws = random.Random(8)
    for _ in range(300):
        counts = {f"k{i}": draws.randint(0, 40) for i in range(draws.randint(1, 9))}
        most, kinds = sum(counts.values()), sum(n > 0 for n in counts.values())
        if not most:
            continue
        asked = draws.randint(kinds, most)
        got = sample.allocate(counts, asked)
        assert sum(got.values()) == asked and all(1 <= n <= counts[k] for k, n in got.items())
        # no place is better used by another class: moving one brings no class nearer to its share by more
        share = {k: asked * counts[k] / most for k in got}
        for a in got:
            for b in got:
                if got[a] > 1 and got[b] < counts[b]:
                    assert share[b] - got[b] <= share[a] - (got[a] - 1) + 1e-9
    with pytest.raises(ValueError):
        sample.allocate({"a": 1, "b": 1}, 1)
    one, many = (sample.natural(rows.repartition(n), 5, 1).select("cve_id", "draw_rank").orderBy("draw_rank").collect() for n in (1, 7))
    assert one == many
    assert [r.cve_id for r in sample.by_id_list(rows, ["id3", "id1"]).orderBy("pos").collect()] == ["id3", "id1"]
    with pytest.raises(ValueError):
        sample.by_id_list(rows, ["id3", "nope"])


def test_export_build_and_verify(spark, tmp_path):
    fields = "cve_id string, cwe_id string, published string, description_en string, description_norm_hash string, is_kev boolean, split string"
    rows = spark.createDataFrame([(f"C{i}", "CWE-79", "2020-01-01", f"text {i} " + "x" * i, f"h{i}", False, s) for i, s in enumerate(["train", "train", "val", "test"])], fields)
    manifest = export.build(rows, rows, ["CWE-79", "CWE-89"], tmp_path, config.load(overrides=["export.max_chars=7"]))
    assert manifest["counts"] == {"train": 2, "val": 1, "test": 1} and export.verify_files(spark, tmp_path, manifest) == []
    line = json.loads((tmp_path / "train.jsonl").read_text().splitlines()[1])
    assert line["completion"] == '{"cwe_id": "CWE-79"}' and line["truncated"] and line["description"] == "text 1 "
    assert line["prompt"].endswith("Description: text 1 ") and "- CWE-89: " in line["prompt"]
    export.rebuild_split(spark, export.export_rows(rows.where("split = 'val'"), ["CWE-79"], 8), "val", tmp_path)
    (tmp_path / "test.jsonl").write_text("{}\n")
    assert export.verify_files(spark, tmp_path, files.read_json(tmp_path / "manifest.json")) == ["test: digest differ"]
    same = rows.withColumn("description_en", F.lit("same"))
    with pytest.raises(curate.SplitInvariantError):
        export.build(same, same, ["CWE-79"], tmp_path / "other", config.load())
    assert not (tmp_path / "other").exists()


def test_completion_masks(spark):
    masks = [([-100, -100, 5, 9], None), ([5, 9], "no_masked_prefix"), ([-100, 5, -100, 9], "gap"), ([-100, 5], "no_end"), ([-100], "nothing_supervised"), ([], "empty")]
    rows = spark.createDataFrame(masks, "labels array<int>, want string")
    assert all(r.want == r.got for r in rows.select("want", export.mask_problem(F.col("labels"), 9).alias("got")).collect())


def test_config_overrides(tmp_path):
    got = config.load(overrides=["labels.top_k=3", "a.b.c=true", "snapshot_date=2025-01-01"])
    assert got["labels"]["top_k"] == 3 and got["a"]["b"]["c"] is True and got["snapshot_date"] == "2025-01-01"
    with pytest.raises(ValueError):
        config.load(overrides=["nonsense"])
