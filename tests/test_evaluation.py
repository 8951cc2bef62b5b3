"""Verifier, metrics and comparison on small rows with known results."""

from random import Random

from pyspark.sql import functions as F

from granary.operators import compare, metrics, similarity
from granary.operators.verify import verified, verified_strict

ALLOWED = ["CWE-20", "CWE-416"]
GOLD = "CWE-416"
#: A value as JSON, the label it stands for, and its flag where it stands for none.
VALUES = [
    ('"CWE-416"', "CWE-416", None), ('"cwe_416"', "CWE-416", None), ("416", "CWE-416", None), ('"0416 "', "CWE-416", None), ('"CWE-20"', "CWE-20", None), ('"CWE-999"', "CWE-999", None),
    ('"CWE-20, CWE-416"', None, "multiple_cwe"), ('["CWE-416"]', None, "multiple_cwe"), ("[]", None, "multiple_cwe"), ("false", None, "bad_cwe_format"), ("null", None, "bad_cwe_format"), ("4.5", None, "bad_cwe_format"),
    (str(2**63), f"CWE-{2**63}", None), (str(-(10**50)), f"CWE--{10**50}", None), ("416.0", None, "bad_cwe_format"), ("1e30", None, "bad_cwe_format"),
    ('"use after free"', None, "bad_cwe_format"), ('{"id": 416}', None, "bad_cwe_format"), ('"CWE-416 (likely)"', None, "bad_cwe_format"),
]
#: Text around an object with the value, its flag, and whether it hides the object or its key.
WRAPPERS = [
    ('{"cwe_id": %s}', None, None), ('\u00a0 {"cwe_id":%s} \n', None, None), ('```\n{"cwe_id": %s}\n```', None, None), ('```JSON {"cwe_id": %s}```', None, None), ('<think>{"cwe_id": 20}</think>{"cwe_id": %s}', "think_block_present", None),
    ('Answer: {"cwe_id": %s}', None, None), ('{"CWE_ID": %s}', None, "missing_key"), ("[[%s]]", None, "not_json"), ('{"cwe_id": %s', None, "not_json"),
]


def expected(value, wrapper):
    """What the rules say of a value in a wrapper: the label and the flags in order."""
    (text, label, fault), (form, mark, hidden) = value, wrapper
    if form == '{"cwe_id": %s' and text.startswith("{"):
        return None, ["not_json"]  # what begins at the first brace ends at the value's
    if form.startswith("Answer") and text.startswith("{"):
        return None, ["not_json"]  # cut at the first closing brace
    found = [mark, hidden or fault]
    if not hidden and label and label not in ALLOWED:
        found.append("label_not_allowed")
    return None if hidden else label, [f for f in found if f]


def test_verifier_by_its_rules(spark):
    cases = [(form % text, *expected((text, label, fault), (form, mark, hidden))) for text, label, fault in VALUES for form, mark, hidden in WRAPPERS]
    cases += [("", None, ["not_json"]), (None, None, ["not_json"]), ("CWE-416", None, ["not_json"]), ("<think>no end", None, ["think_block_present", "not_json"])]
    rows = spark.createDataFrame([(i, raw, GOLD) for i, (raw, _, _) in enumerate(cases)], "ord long, raw string, gold string")
    allowed = F.array(*map(F.lit, ALLOWED))
    for run in (verified, verified_strict):
        got = {r.ord: r for r in run(rows, "raw", "gold", allowed).collect()}
        for i, (raw, pred, flags) in enumerate(cases):
            assert (got[i].pred, got[i].error_flags) == (pred, flags), raw
            assert got[i].exact_match == (pred == GOLD) and got[i].score == float(pred == GOLD)
    odd = spark.createDataFrame([(0, '{"cwe_id": 20, "cwe_id": 416}', GOLD), (1, '{"cwe_id": NaN}', GOLD)], "ord long, raw string, gold string")
    got = {r.ord: r for r in verified_strict(odd, "raw", "gold", allowed).collect()}
    assert got[0].pred == GOLD and got[1].error_flags == ["bad_cwe_format"]


def test_metrics_of_random_runs(spark):
    random = Random(4)
    labels = ["L1", "L2", "L3"]
    rows = []
    for _ in range(200):
        gold, pred = random.choice(labels), random.choice([*labels, "other", None])
        valid = pred in labels
        rows.append((gold, pred, valid, valid and pred == gold, [] if valid else ["not_json" if pred is None else "label_not_allowed"], random.random() < 0.3))
    table = spark.createDataFrame(rows, "gold string, pred string, valid_label boolean, exact_match boolean, error_flags array<string>, is_kev boolean")
    got = metrics.compute(table, labels)
    right, valid = sum(r[3] for r in rows), sum(r[2] for r in rows)
    assert abs(got["accuracy"] - right / 200) < 1e-12 and abs(got["invalid_rate"] - (1 - valid / 200)) < 1e-12 and abs(got["accuracy_on_valid"] - right / valid) < 1e-12
    f1 = [2 * sum(r[3] for r in rows if r[0] == x) / (sum(r[0] == x for r in rows) + sum(r[1] == x for r in rows)) for x in labels]
    assert abs(got["macro_f1"] - sum(f1) / 3) < 1e-12
    count = lambda g, p: sum(r[0] == g and (r[1] if r[2] else "INVALID") == p for r in rows)
    assert got["confusion_matrix"]["matrix"] == [[count(g, p) for p in [*labels, "INVALID"]] for g in [*labels, "INVALID"]]
    assert got["invalid_breakdown"]["not_json"] == sum(r[1] is None for r in rows)
    kev = [r for r in rows if r[5]]
    assert got["slices"]["kev"]["n"] == len(kev) and abs(got["slices"]["kev"]["accuracy"] - sum(r[3] for r in kev) / len(kev)) < 1e-12
    empty = metrics.compute(table.limit(0), labels)
    assert empty["n"] == 0 and empty["accuracy"] == 0.0 and empty["macro_f1"] == 0.0


def runs(spark):
    rows = [  # gold, base, tuned
        ("CWE-79", "CWE-89", "CWE-79"), ("CWE-79", "CWE-79", "CWE-79"), ("CWE-862", "CWE-200", "CWE-284"), ("CWE-89", "CWE-89", None), ("CWE-89", None, None),
    ]
    fields = "ord long, cve_id string, gold string, pred string, valid_json boolean, has_key boolean, valid_label boolean, exact_match boolean"
    side = lambda k: spark.createDataFrame([(i, f"C{i}", r[0], r[k], r[k] is not None, r[k] is not None, r[k] is not None, r[k] == r[0]) for i, r in enumerate(rows)], fields)
    return side(1), side(2)


def test_comparison(spark):
    base, tuned = runs(spark)
    joined = compare.join_runs(base, tuned).cache()
    assert {r.transition: r.n for r in compare.transition_counts(joined).collect()} == {"both_right": 1, "fixed_by_sft": 1, "broken_by_sft": 1, "both_wrong": 2}
    allowed = ["CWE-79", "CWE-89", "CWE-200", "CWE-284", "CWE-862"]
    got = {(r.model, r.outcome): r.n for r in compare.outcome_counts(joined, allowed).collect()}
    assert got["base", "nearby_cwe_confusion"] == 1 and got["base", "semantic_confusion"] == 1 and got["tuned", "nearby_cwe_confusion"] == 1 and got["tuned", "invalid_format"] == 2
    tail = spark.createDataFrame([("CWE-862",)], "cwe_id string")
    flags = {r.model: r for r in compare.error_flags(joined, tail).collect()}
    assert (flags["base"].gold_is_long_tail, flags["base"].overgeneralization, flags["base"].under_specific) == (1, 1, 0)
    assert (flags["tuned"].overgeneralization, flags["tuned"].under_specific) == (0, 1)
    assert [(r.gold, r.pred) for r in compare.top_confusions(joined).where("model = 'base'").orderBy("rank").collect()] == [("CWE-79", "CWE-89"), ("CWE-862", "CWE-200"), ("CWE-89", "INVALID")]
    top = compare.concentration(joined).where("model = 'base'").orderBy("rank").collect()
    assert top[0].pred == "CWE-89" and top[0].n == 2 and top[0].share == 0.4
    wrong = tuned.withColumn("gold", F.lit("CWE-1"))
    try:
        compare.join_runs(base, wrong)
        raise AssertionError("accepted runs that don't match")
    except ValueError:
        pass


def test_similarity(spark):
    train = spark.createDataFrame([(1, "T1", "sql injection in login form"), (2, "T2", "buffer overflow in parser code"), (3, "T3", "sql injection in login form")], "ord long, cve_id string, text string")
    asks = spark.createDataFrame([("Q1", "SQL injection in login form"), ("Q2", "zzz")], "cve_id string, text string")
    got = {r.query_id: (r.train_id, round(r.similarity, 6)) for r in similarity.nearest(asks, train).collect()}
    assert got == {"Q1": ("T1", 1.0), "Q2": ("T1", 0.0)}
    docs = spark.createDataFrame([(1, "say one two three four now"), (2, "one two"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "one two three four"), (8, "one two"), (9, None)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in similarity.containment(docs, items).collect()} == {(1, 7), (1, 8), (2, 8)}
