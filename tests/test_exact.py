"""Percentiles by counts, texts that hold items, budgets, reports and case folding against plain Python."""

import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.functions.text import casefolded, normalized_nfkc
from granary.operators import export, similarity, stats


@pytest.mark.parametrize("values", [1 << 20, 7])
def test_percentiles_by_counts(spark, values, monkeypatch):
    monkeypatch.setattr(stats, "VALUES", values)
    draw = random.Random(9)
    rows = [(draw.choice(["a", "b", None]), draw.choice([None, *range(40)])) for _ in range(400)] + [("one", 5), ("none", None)]
    table = spark.createDataFrame(rows, "g string, v int").repartition(5)
    ranks = [0.0, 0.5, 0.9, 0.95, 0.99, 1.0]
    got = {r.g: r for r in stats.exact_percentiles(table, F.col("v"), ranks, "g").collect()}
    held = {g: [v for h, v in rows if h == g and v is not None] for g in ("a", "b", None, "one")}
    assert got.keys() == held.keys()
    for g, v in held.items():
        assert np.allclose(got[g].p, np.quantile(v, ranks)) and got[g].max == max(v)
    whole = stats.exact_percentiles(table, F.col("v"), ranks).collect()
    assert len(whole) == 1 and np.allclose(whole[0].p, np.quantile([v for _, v in rows if v is not None], ranks))
    got = {r.g: tuple(r)[1:] for r in stats.percentiles(table, F.col("v"), "g").collect()}
    assert got["none"] == (0, 0, 0, 0) and got["one"] == (5, 5, 5, 5)
    assert [tuple(r) for r in stats.percentiles(table.limit(0), F.col("v")).collect()] == [(0, 0, 0, 0)]


@pytest.mark.parametrize("chars", [4_000_000, 12])
def test_containment(spark, chars, monkeypatch):
    monkeypatch.setattr(similarity, "AUTOMATON_CHARS", chars)
    draw = random.Random(1)
    text = lambda n: " ".join(draw.choice(["one", "two", "thrée", "x"]) for _ in range(n))
    docs = [(k, text(draw.randint(0, 30))) for k in range(60)] + [(None, "one two"), (7, text(9)), (100, None), (101, ""), (102, "no" * 50_000 + " needle ")]
    items = [(k, text(draw.randint(1, 5))) for k in range(20)] + [(50, ""), (51, None), (None, "needle"), (52, "one two"), (53, "one two"), (54, "x")]
    want = {(d, i) for d, t in docs for i, s in items if t is not None and s is not None and s in t}
    got = similarity.containment(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")).collect()
    # ids that are null aren't told apart in a set of an item's ids
    assert {(r.doc_id, r.item_id) for r in got} == {p for p in want if p[1] is not None} and len(got) == len({p for p in want if p[1] is not None})


def test_over_budget(spark):
    rows = spark.createDataFrame([(1, 10), (2, 11), (3, None)], "id int, tokens int")
    assert [r.id for r in export.over_budget(rows, "tokens", 16, 6).collect()] == [2]


def test_casefolded(spark):
    texts = ["Straße  ΣΑΣ　x ", None, "", "İI ﬁn"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", casefolded("t").alias("f")).collect()
    assert {r.i: r.f for r in got} == {i: None if t is None else " ".join(t.casefold().split()) for i, t in enumerate(texts)}


def test_dataset_report(spark):
    fields = "ord long, cve_id string, cwe_id string, published string, description_en string, description_norm_hash string, label_status string, is_kev boolean, is_rejected boolean, split string, eligible boolean"
    rows = [(i, f"C{i}", "CWE-79" if i % 3 else "CWE-89", f"20{20 + i % 5}-01-01", f"some words {i} " * (i + 1), f"h{i % 7}", "single", i % 4 == 0, i == 8, ["train", "train", "val", "test"][i % 4], i != 8) for i in range(12)]
    table = spark.createDataFrame(rows, fields)
    labels = spark.createDataFrame([(1, "CWE-79", 5), (2, "CWE-89", 3)], "rank int, cwe_id string, train_count long")
    kept = table.where("eligible")
    value, text = export.dataset_report(table, kept, kept, labels)
    assert list(value) == ["Records", "Years", "Coverage", "Excluded", "Characters", "Tokens", "Overlaps", "Population by class", "Exported by class", "Tiers"]
    assert value["Records"][0]["records"] == 12 and value["Records"][0]["rejected"] == 1 and value["Records"][0]["eligible"] == 11
    assert {r["year"]: r["total"] for r in value["Years"]} == {str(2020 + k): sum(i % 5 == k for i in range(12)) for k in range(5)}
    lengths = [len(r[4]) for r in rows if r[9] == "train" and r[10]]
    train = next(r for r in value["Characters"] if r["split"] == "train")
    assert train["p50"] == int(np.quantile(lengths, 0.5)) and train["max"] == max(lengths)
    assert {(r["split"], r["cwe_id"]): r["n"] for r in value["Population by class"]} == {k: sum((r[9], r[2]) == k and r[10] for r in rows) for k in {(r[9], r[2]) for r in rows if r[10]}}
    assert text.startswith("# Dataset report\n") and text.count("\n## ") == 10 and "| split |" in text


def test_normal_form_of_any_text(spark):
    draw = random.Random(2)
    pools = [range(32, 127), [*range(0, 32), 32, 127], range(0xA0, 0x250), [0xFF21, 0x3000, 0xFB01, 0x1E9E, 0x130, 0x2028, 0xA0, 0x1680, 65, 97, 32], range(0x1F600, 0x1F650)]
    texts = ["", None, " ", "\x1c a \x1f"] + ["".join(chr(draw.choice(pools[draw.choice([0, 0, k % 5])])) for _ in range(draw.randint(1, 40))) for k in range(400)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", normalized_nfkc("t").alias("f")).collect()
    assert {r.i: r.f for r in got} == {i: None if t is None else " ".join(unicodedata.normalize("NFKC", t).lower().split()) for i, t in enumerate(texts)}
