"""Nearest rows by the index against every pair's cosine."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.operators import nearest


def brute(asks, train, min_df=2):
    words = lambda t: re.findall(r"\b\w\w+\b", (t or "").lower())
    bags = [Counter(w + [" ".join(p) for p in zip(w, w[1:], strict=False)]) for w in map(words, [t for _, t in asks] + [t for _, _, t in train])]
    df = Counter(t for b in bags for t in b)
    unit = []
    for b in bags:
        v = {t: (1 + math.log(n)) * (math.log((1 + len(bags)) / (1 + df[t])) + 1) for t, n in b.items() if df[t] >= min_df}
        norm = math.sqrt(sum(x * x for x in v.values()))
        unit.append({t: x / norm for t, x in v.items()})
    out = Counter()
    for (query, _), a in zip(asks, unit, strict=False):
        sims = [(round(sum(x * d.get(t, 0) for t, x in a.items()), 9), -o, i) for (o, i, _), d in zip(train, unit[len(asks) :], strict=True)]
        best = max(sims)
        out[query, best[2], best[0]] += 1
    return out


@pytest.fixture(scope="module")
def sides():
    draw = np.random.default_rng(7)
    ranks = 1 / np.arange(1, 401)
    text = lambda n: " ".join(f"word{k}" for k in draw.choice(400, n, p=ranks / ranks.sum()))
    train = [(k, f"T{k}", text(int(draw.integers(1, 200)))) for k in range(220)]
    train += [(300, "T300", None), (301, "T301", ""), (302, "T302", train[5][2]), (303, "T303", "word0 word0"), (304, "T304", text(6000)), (-1, "T-1", "rare")]
    asks = [(f"Q{k}", text(int(draw.integers(1, 150)))) for k in range(40)]
    asks += [("Q50", train[5][2]), ("Q51", train[9][2] + " word1 other"), ("Q52", "word0"), ("Q53", None), ("Q54", "nothing shared"), ("Q50", train[7][2]), ("Q55", "word0 word1 word2")]
    return asks, train


@pytest.mark.parametrize(("rare", "skipped", "chance"), [(64, 0.3, 0.15), (0, 0.9, 1.0), (4, 0.0, 0.0)])
def test_nearest_rows(spark, sides, rare, skipped, chance, monkeypatch):
    monkeypatch.setattr(nearest, "RARE", rare)
    monkeypatch.setattr(nearest, "SKIPPED", skipped)
    monkeypatch.setattr(nearest, "CHANCE", chance)
    asks, train = sides
    got = nearest.nearest(spark.createDataFrame(asks, "cve_id string, text string").repartition(3), spark.createDataFrame(train, "ord long, cve_id string, text string").repartition(3))
    assert Counter((r.query_id, r.train_id, round(r.similarity, 9)) for r in got.collect()) == brute(asks, train)


def test_common_terms_do_not_join(spark):
    """Of texts that all hold the same hundred words, beside twenty of their own pair, only the own ones are joined."""
    common = " ".join(f"all{k}" for k in range(100))
    own = lambda k: " ".join(f"own{k}x{j}" for j in range(20))
    rows = [(k, False, f"{common} {own(k)}") for k in range(60)] + [(100 + k, True, f"{common} {own(k)}") for k in range(20)]
    table = spark.createDataFrame(rows, "row long, asks boolean, text string").select("row", "asks", nearest.term_ids(nearest.tokens(F.col("text"))).alias("terms"))
    weights = nearest.unit_weights(table, 2)
    asks = weights.where("asks").select(F.col("row").alias("asked"), "term", "df", F.col("weight").alias("ask_weight"))
    train = weights.where("NOT asks")
    terms = nearest.joined_terms(asks, train, nearest.least_reached(asks, train)).where("joined")
    held = weights.where("asks").groupBy("term").agg(F.max("df").alias("df"))
    joined = terms.join(held, "term").groupBy("df").count().collect()
    assert not [r for r in joined if r.df > 2]
    assert sum(r["count"] for r in joined if r.df == 2) >= 20 * 10
    got = nearest.similar_rows(weights).collect()
    assert {(r.asked, r.row) for r in got if r.similarity > 0.999} == {(100 + k, k) for k in range(20)}


def test_sides_without_rows(spark):
    asks, train = spark.createDataFrame([("q", "x y")], "cve_id string, text string"), spark.createDataFrame([(1, "t", "x y")], "ord long, cve_id string, text string")
    for a, b in ((asks.limit(0), train), (asks, train.limit(0))):
        with pytest.raises(ValueError, match="both sides"):
            nearest.nearest(a, b)
