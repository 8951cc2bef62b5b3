"""Queries that take every row and whole texts, against brute force on small tables."""

import pytest

import __spark_entry__

LONG = " ".join(f"word{i % 300}" for i in range(400))
TEXTS = {
    # 10, 20, 30 and 40 are in the train split, 61 and 66 in the test split
    10: ("en", f"{LONG} alpha beta gamma delta"),
    20: ("en", f"{LONG} other ends here now"),
    30: ("en", "short words about  nothing"),
    40: ("en", "the thirteenth\tthing | with a bar " * 4),
    61: ("en", f"{LONG} other ends here now"),
    62: ("de", "Über die Straße und über den Fluß, " * 70),
    63: ("zh", "中文 text\u2003with wide space"),
    64: (None, "no language is known of this one"),
    65: ("fr", None),
    66: ("en", "short words about nothing"),
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("whole"))
    rows = [(i, t, lang, f"src{i}", None if i in (61, 62) or t is None else len(t)) for i, (lang, t) in TEXTS.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in TEXTS], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return out


def test_nearest_rows_of_the_test_split(spark, folder):
    run = lambda name: __spark_entry__.queries()[name](spark, folder)
    got = {r.query_id: (r.train_id, r.similarity) for r in run("tfidf_nearest").collect()}
    assert got == {"CVE-2020-0000061": ("CVE-2020-0000020", 1.0), "CVE-2020-0000066": ("CVE-2020-0000030", 1.0)}
    assert max(r.n for r in run("audit_summary").collect()) == 2
    assert run("closest_pairs").count() == 2


def test_char5_jaccard_of_long_texts(spark, folder):
    grams = lambda t: {t[i : i + 5] for i in range(len(t) - 4)}
    fold = {i: " ".join(t.casefold().split()) for i, (_, t) in TEXTS.items() if t is not None}
    want = {i: round(len(grams(fold[i]) & grams(fold[i + 1])) / len(grams(fold[i]) | grams(fold[i + 1])), 9) for i in fold if i + 1 in fold}
    got = {r.doc_id: r.jaccard for r in __spark_entry__.queries()["char5_jaccard"](spark, folder).collect()}
    assert {i: v for i, v in got.items() if i in want} == want and 61 in want


def test_excerpts_of_all_languages(spark, folder):
    cut = lambda t, n: t if len(t) <= n else t[: n - 1] + "…"
    flat = {i: None if t is None else " ".join(t.split()) for i, (_, t) in TEXTS.items()}
    got = {r.doc_id: r for r in __spark_entry__.queries()["excerpts"](spark, folder).collect()}
    assert {i: r.excerpt for i, r in got.items()} == {i: t if t is None else cut(t, 80) for i, t in flat.items()}
    assert all((r.cell is None) == (r.redacted is None) == (TEXTS[i][1] is None) for i, r in got.items())
