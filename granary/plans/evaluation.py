"""Queries of the evaluation side, by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import FAMILIES, INVALID_FLAGS, OUTCOMES, OVERGENERAL, SPECIFIC_CHILDREN, TRACKED_CONFUSIONS, TRANSITIONS
from ..operators import compare, metrics, similarity
from ..operators.verify import verified
from ..sources.shared import stored
from ..sources.tables import ALLOWED, PREDICTIONS_SQL, predictions, records
from .curation import _GRAMS, labels_of

Q, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def run(spark: SparkSession, sf_dir: str, model: str, split: str | None = None) -> DataFrame:
    return verified(predictions(spark, sf_dir, model, split), "raw_output", "gold", F.array(*map(F.lit, ALLOWED)))


def joined(spark: SparkSession, sf_dir: str, split: str | None = None) -> DataFrame:
    """Both runs side by side, of one split or all; the generated rows are from one table, so their integrity needs no check here."""
    base, tuned = (run(spark, sf_dir, m, split) for m in compare.MODELS)
    side = lambda df, m, *more: df.select("ord", *(F.col(c).alias(f"{m}_{c}") for c in compare.RESULT), *more)
    out = side(base, "base", "cve_id", "gold", "description", "is_kev").join(side(tuned, "tuned"), "ord")
    return out.withColumn("tokens", F.regexp_count("description", F.lit(r"\S+")))


def tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.long_tail(labels_of(records(spark, sf_dir)))


def _in(values) -> str:
    return "(" + ", ".join(f"'{x}'" for x in values) + ")"


_ALLOWED = _in(ALLOWED)
_VALUES = lambda values, name: f"(SELECT unnest([{', '.join(f"'{x}'" for x in values)}]) AS {name})"
_P = f"WITH {PREDICTIONS_SQL}"


def _family(c: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} IN {_in(v)} THEN '{k}'" for k, v in FAMILIES.items()) + " END"


def _model(m: str) -> str:
    """One run's rows with its outcome, families and flags."""
    under = " OR ".join(f"(pred = '{b}' AND gold IN {_in(n)})" for b, n in SPECIFIC_CHILDREN.items())
    return f"""SELECT '{m}' AS model, ord, cve_id, gold, pred, description, is_kev, exact_match,
    len(regexp_extract_all(description, '\\S+')) AS tokens,
    CASE WHEN NOT valid_json OR NOT has_key THEN 'invalid_format' WHEN pred IS NULL OR pred NOT IN {_ALLOWED} THEN 'unknown_cwe' WHEN exact_match THEN 'correct'
      WHEN {_family("pred")} = {_family("gold")} THEN 'nearby_cwe_confusion' ELSE 'semantic_confusion' END AS outcome,
    NOT exact_match AND coalesce(pred IN {_in(OVERGENERAL)}, false) AND {_family("pred")} IS DISTINCT FROM {_family("gold")} AS over,
    NOT exact_match AND coalesce({under}, false) AND {_family("pred")} IS NOT DISTINCT FROM {_family("gold")} AS under
    FROM {m}"""


_BOTH = (
    _P
    + f""", both_ AS ({_model("base")} UNION ALL {_model("tuned")}), misses AS (SELECT model, ord, cve_id, gold, coalesce(pred, 'INVALID') AS pred, outcome, description FROM both_ WHERE NOT exact_match),
 models AS {_VALUES(compare.MODELS, "model")},
 sel AS (SELECT * FROM (SELECT cwe_id, count(*) AS train_count, row_number() OVER (ORDER BY count(*) DESC, cwe_id) AS rank FROM rec WHERE eligible AND split = 'train' GROUP BY cwe_id) WHERE rank <= 15 AND train_count >= 3),
 tail_ AS (SELECT cwe_id FROM (SELECT cwe_id, row_number() OVER (ORDER BY train_count, cwe_id) AS k, count(*) OVER () AS n FROM sel) WHERE k <= greatest(1, n // 3))"""
)


@query(_P + " SELECT b.ord, pred, valid_json, has_key, valid_label, exact_match, exact_match::DOUBLE AS score, coalesce(f, '') AS flags FROM base b LEFT JOIN (SELECT ord, string_agg(flag, ',') AS f FROM base_flags GROUP BY ord) USING (ord)")
def verify_outputs(spark, sf_dir):
    return run(spark, sf_dir, "base").select("ord", "pred", "valid_json", "has_key", "valid_label", "exact_match", "score", F.array_join("error_flags", ",").alias("flags"))


@query(_P + f" SELECT f.flag, count(b.ord) AS n FROM {_VALUES(INVALID_FLAGS, 'flag')} f LEFT JOIN base_flags b USING (flag) GROUP BY f.flag")
def flag_histogram(spark, sf_dir):
    return metrics.flag_counts(run(spark, sf_dir, "base"))


@query(
    _P
    + """ SELECT count(*) AS n, avg(exact_match::INT) AS accuracy, avg((NOT valid_label)::INT) AS invalid_rate,
    coalesce(count(*) FILTER (exact_match) / nullif(count(*) FILTER (valid_label), 0), 0) AS accuracy_on_valid FROM base"""
)
def headline_metrics(spark, sf_dir):
    return metrics.headline(run(spark, sf_dir, "base"))


def _classes(m: str) -> str:
    return f"""{m}_classes AS (SELECT label, coalesce(hits / nullif(predicted, 0), 0) AS precision, coalesce(hits / nullif(support, 0), 0) AS recall, coalesce(2 * hits / nullif(predicted + support, 0), 0) AS f1, support
    FROM (SELECT label, (SELECT count(*) FROM {m} WHERE gold = label) AS support, (SELECT count(*) FROM {m} WHERE valid_label AND pred = label) AS predicted,
      (SELECT count(*) FROM {m} WHERE valid_label AND pred = label AND gold = label) AS hits FROM {_VALUES(ALLOWED, "label")}))"""


@query(f"{_P}, {_classes('base')} SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM base_classes")
def per_class_prf(spark, sf_dir):
    out = metrics.per_class(run(spark, sf_dir, "base"), ALLOWED)
    return out.select("label", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")), "support")


@query(f"{_P}, {_classes('base')} SELECT round(avg(f1), 9) AS macro_f1, round(sum(f1 * support) / sum(support), 9) AS weighted_f1 FROM base_classes")
def macro_weighted_f1(spark, sf_dir):
    out = metrics.averaged(metrics.per_class(run(spark, sf_dir, "base"), ALLOWED))
    return out.select(F.round("macro_f1", 9).alias("macro_f1"), F.round("weighted_f1", 9).alias("weighted_f1"))


_SIDES = _VALUES([*ALLOWED, "INVALID"], "{}")


@query(
    _P
    + f""" SELECT g.gold, p.pred, count(b.ord) AS n FROM {_SIDES.format("gold")} g CROSS JOIN {_SIDES.format("pred")} p
    LEFT JOIN (SELECT ord, gold, CASE WHEN valid_label THEN pred ELSE 'INVALID' END AS pred FROM base) b ON b.gold = g.gold AND b.pred = p.pred GROUP BY ALL"""
)
def confusion_long(spark, sf_dir):
    return metrics.confusion(run(spark, sf_dir, "base"), ALLOWED)


@query(
    _P
    + f" SELECT g.gold, "
    + ", ".join(f"count(*) FILTER (b.pred = '{x}') AS \"{x}\"" for x in [*ALLOWED, "INVALID"])
    + f" FROM {_SIDES.format('gold')} g LEFT JOIN (SELECT gold, CASE WHEN valid_label THEN pred ELSE 'INVALID' END AS pred FROM base) b USING (gold) GROUP BY g.gold"
)
def confusion_pivot(spark, sf_dir):
    return metrics.confusion_matrix(run(spark, sf_dir, "base"), ALLOWED)


@query(_P + " SELECT CASE WHEN is_kev THEN 'kev' ELSE 'non_kev' END AS slice, count(*) AS n, avg(exact_match::INT) AS accuracy FROM base GROUP BY 1")
def kev_slice(spark, sf_dir):
    return metrics.slices(run(spark, sf_dir, "base"))


_TRANSITION = "CASE WHEN b.exact_match AND t.exact_match THEN 'both_right' WHEN t.exact_match THEN 'fixed_by_sft' WHEN b.exact_match THEN 'broken_by_sft' ELSE 'both_wrong' END"


@query(_P + f" SELECT n.transition, count(x.ord) AS n FROM {_VALUES(TRANSITIONS, 'transition')} n LEFT JOIN (SELECT b.ord, {_TRANSITION} AS transition FROM base b JOIN tuned t USING (ord)) x USING (transition) GROUP BY 1")
def transitions(spark, sf_dir):
    return compare.transition_counts(joined(spark, sf_dir))


@query(_BOTH + f" SELECT m.model, o.outcome, count(x.ord) AS n FROM models m CROSS JOIN {_VALUES(OUTCOMES, 'outcome')} o LEFT JOIN both_ x ON x.model = m.model AND x.outcome = o.outcome GROUP BY ALL")
def error_types(spark, sf_dir):
    return compare.outcome_counts(joined(spark, sf_dir), ALLOWED)


@query(_BOTH + " SELECT model, count(*) FILTER (NOT exact_match AND gold IN (FROM tail_)) AS gold_is_long_tail, count(*) FILTER (over) AS overgeneralization, count(*) FILTER (under) AS under_specific FROM both_ GROUP BY model")
def taxonomy_flags(spark, sf_dir):
    return compare.error_flags(joined(spark, sf_dir), tail(spark, sf_dir))


_CONFUSIONS = "SELECT model, gold, pred, count(*) AS n, min(ord) AS first FROM misses GROUP BY ALL"


@query(_BOTH + f" SELECT model, rank, gold, pred, n FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY n DESC, first) AS rank FROM ({_CONFUSIONS})) WHERE rank <= 15")
def top_confusions(spark, sf_dir):
    return compare.top_confusions(joined(spark, sf_dir))


@query(_BOTH + f", pairs AS (SELECT * FROM (VALUES {', '.join(map(str, TRACKED_CONFUSIONS))}) v(gold, pred)) SELECT m.model, p.gold, p.pred, count(x.ord) AS n FROM models m CROSS JOIN pairs p LEFT JOIN misses x ON x.model = m.model AND x.gold = p.gold AND x.pred = p.pred GROUP BY ALL")
def tracked_pairs(spark, sf_dir):
    return compare.tracked_counts(joined(spark, sf_dir))


@query(_BOTH + f" SELECT model, gold, rank, pred, n FROM (SELECT *, row_number() OVER (PARTITION BY model, gold ORDER BY n DESC, first) AS rank FROM ({_CONFUSIONS})) WHERE rank <= 3")
def gold_sinks(spark, sf_dir):
    return compare.gold_sinks(joined(spark, sf_dir))


@query(_BOTH + " SELECT model, rank, pred, n, n / total AS share FROM (SELECT model, coalesce(pred, 'INVALID') AS pred, count(*) AS n, row_number() OVER (PARTITION BY model ORDER BY count(*) DESC, min(ord)) AS rank, sum(count(*)) OVER (PARTITION BY model) AS total FROM both_ GROUP BY model, coalesce(pred, 'INVALID')) WHERE rank <= 3")
def prediction_concentration(spark, sf_dir):
    return compare.concentration(joined(spark, sf_dir))


def _buckets(case: str, names: list[str]) -> str:
    return _BOTH + f" SELECT m.model, k.bucket, count(x.ord) AS n, count(*) FILTER (x.exact_match) AS correct, coalesce(count(*) FILTER (x.exact_match) / nullif(count(x.ord), 0), 0) AS accuracy FROM models m CROSS JOIN {_VALUES(names, 'bucket')} k LEFT JOIN (SELECT *, {case} AS bucket FROM both_) x ON x.model = m.model AND x.bucket = k.bucket GROUP BY ALL"


@query(_buckets("CASE WHEN length(description) < 250 THEN '<250' WHEN length(description) < 500 THEN '250-500' WHEN length(description) < 1000 THEN '500-1000' ELSE '>=1000' END", ["<250", "250-500", "500-1000", ">=1000"]))
def length_buckets(spark, sf_dir):
    return compare.by_length(joined(spark, sf_dir))


@query(_buckets("CASE WHEN tokens < 480 THEN '<480' ELSE '480-1536' END", ["<480", "480-1536"]))
def token_buckets(spark, sf_dir):
    return compare.by_tokens(joined(spark, sf_dir))


@query(_buckets("CASE WHEN is_kev THEN 'kev' ELSE 'non_kev' END", ["kev", "non_kev"]))
def kev_buckets(spark, sf_dir):
    return compare.by_kev(joined(spark, sf_dir))


@query(_buckets("CASE WHEN gold IN (FROM tail_) THEN 'tail' ELSE 'head' END", ["head", "tail"]))
def head_tail_accuracy(spark, sf_dir):
    return compare.head_and_tail(joined(spark, sf_dir), tail(spark, sf_dir))


@query(_P + f" SELECT label, count(b.ord) AS support, count(*) FILTER (exact_match) AS correct, coalesce(count(*) FILTER (exact_match) / nullif(count(b.ord), 0), 0) AS recall FROM {_VALUES(ALLOWED, 'label')} l LEFT JOIN base b ON b.gold = l.label GROUP BY label")
def class_recall(spark, sf_dir):
    return compare.class_recall(joined(spark, sf_dir), ALLOWED)


def _delta(spark, sf_dir):
    return compare.class_delta(*(metrics.per_class(run(spark, sf_dir, m), ALLOWED) for m in compare.MODELS))


_DELTA = f"{_P}, {_classes('base')}, {_classes('tuned')}, delta AS (SELECT label, t.support, t.precision - b.precision AS precision_delta, t.recall - b.recall AS recall_delta, t.f1 - b.f1 AS f1_delta FROM tuned_classes t JOIN base_classes b USING (label))"


@query(_DELTA + " SELECT label, support, round(precision_delta, 9) AS precision_delta, round(recall_delta, 9) AS recall_delta, round(f1_delta, 9) AS f1_delta FROM delta")
def per_class_delta(spark, sf_dir):
    return _delta(spark, sf_dir).select("label", "support", *(F.round(c, 9).alias(c) for c in ("precision_delta", "recall_delta", "f1_delta")))


@query(_DELTA + ", r AS (SELECT label, round(f1_delta, 9) AS change FROM delta) SELECT kind, rank, label, change FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY abs(change) DESC, label) AS rank FROM (SELECT *, CASE WHEN change > 0 THEN 'gain' WHEN change < 0 THEN 'regression' END AS kind FROM r) WHERE kind IS NOT NULL) WHERE rank <= 5")
def largest_changes(spark, sf_dir):
    return compare.largest_changes(_delta(spark, sf_dir).withColumn("f1_delta", F.round("f1_delta", 9)))


@query(
    _P
    + """, h AS (SELECT 'base' AS m, avg(exact_match::INT) AS accuracy, avg((NOT valid_label)::INT) AS invalid_rate FROM base UNION ALL SELECT 'tuned', avg(exact_match::INT), avg((NOT valid_label)::INT) FROM tuned)
    SELECT metric, round(b, 9) AS base, round(t, 9) AS tuned, round(t - b, 9) AS delta FROM (SELECT 'accuracy' AS metric, max(accuracy) FILTER (m = 'base') AS b, max(accuracy) FILTER (m = 'tuned') AS t FROM h UNION ALL SELECT 'invalid_rate', max(invalid_rate) FILTER (m = 'base'), max(invalid_rate) FILTER (m = 'tuned') FROM h)"""
)
def comparison_table(spark, sf_dir):
    base, tuned = (metrics.headline(run(spark, sf_dir, m)).select("accuracy", "invalid_rate") for m in compare.MODELS)
    return compare.comparison(base, tuned).select("metric", *(F.round(c, 9).alias(c) for c in ("base", "tuned", "delta")))


@query(
    _BOTH
    + f""", x AS (SELECT b.ord, b.cve_id, b.gold, {_TRANSITION} AS transition, mb.outcome AS base_outcome, mt.outcome AS tuned_outcome, mt.over AS overgeneralization, mt.under AS under_specific
      FROM base b JOIN tuned t USING (ord) JOIN both_ mb ON mb.model = 'base' AND mb.ord = b.ord JOIN both_ mt ON mt.model = 'tuned' AND mt.ord = b.ord)
    SELECT cve_id, gold, transition, base_outcome, tuned_outcome, gold IN (FROM tail_) AS gold_is_long_tail, overgeneralization, under_specific FROM x WHERE transition <> 'both_right'"""
)
def failures(spark, sf_dir):
    out = compare.failures(joined(spark, sf_dir), ALLOWED, tail(spark, sf_dir))
    return out.select("cve_id", "gold", "transition", "base_outcome", "tuned_outcome", "gold_is_long_tail", "overgeneralization", "under_specific")


@query(
    _BOTH
    + f""", top AS (SELECT gold, pred, rank AS "group" FROM (SELECT *, row_number() OVER (ORDER BY n DESC, first) AS rank FROM ({_CONFUSIONS}) WHERE model = 'base') WHERE rank <= 8),
    one AS (SELECT * FROM (SELECT m.ord, m.cve_id, "group", row_number() OVER (PARTITION BY "group" ORDER BY ord) AS place FROM misses m JOIN top USING (gold, pred) WHERE model = 'base') WHERE place <= 5),
    two AS (SELECT * FROM (SELECT ord, cve_id, 9 AS "group", row_number() OVER (ORDER BY ord) AS place FROM misses WHERE model = 'base' AND outcome IN ('invalid_format', 'unknown_cwe') AND cve_id NOT IN (SELECT cve_id FROM one)) WHERE place <= 5),
    three AS (SELECT * FROM (SELECT ord, cve_id, 10 AS "group", row_number() OVER (ORDER BY ord) AS place FROM misses WHERE model = 'base' AND gold IN (FROM tail_) AND cve_id NOT IN (SELECT cve_id FROM one UNION SELECT cve_id FROM two)) WHERE place <= 5)
    FROM one UNION ALL FROM two UNION ALL FROM three"""
)
def representatives(spark, sf_dir):
    return compare.representatives(joined(spark, sf_dir), ALLOWED, tail(spark, sf_dir)).select("ord", "cve_id", "group", "place")


@query(_P + f" SELECT ord, cve_id, gold FROM (SELECT b.ord, b.cve_id, b.gold, row_number() OVER (PARTITION BY b.gold ORDER BY b.ord) AS k FROM base b JOIN tuned t USING (ord) WHERE {_TRANSITION} = 'broken_by_sft') WHERE k = 1 ORDER BY ord LIMIT 4")
def distinct_gold_examples(spark, sf_dir):
    return compare.distinct_gold(joined(spark, sf_dir), "broken_by_sft", 4)


# Similarity: the test split's English rows ask, the whole train split answers, on whole texts.


def _texts(spark, sf_dir):
    rows = records(spark, sf_dir, labelled=False).where("length(description_en) > 0")
    return rows.select("ord", "cve_id", "cwe_id", "split", F.col("description_en").alias("text"))


def _nearest(spark, sf_dir):
    rows = _texts(spark, sf_dir)
    return similarity.nearest(rows.where("split = 'test'").select("cve_id", "text"), rows.where("split = 'train'").select("ord", "cve_id", "text"))


_NEAREST = (
    PREDICTIONS_SQL
    + r""", t AS (SELECT ord, cve_id, cwe_id, split, description_en AS text FROM rec WHERE length(description_en) > 0 AND split IN ('train', 'test')),
 w AS (SELECT ord, cve_id, split, regexp_extract_all(lower(text), '[\p{L}\p{N}_\p{M}]{2,}') AS a FROM t),
 bag AS (SELECT ord, cve_id, split, term, count(*) AS tf FROM (SELECT ord, cve_id, split, unnest(list_concat(a, list_transform(range(1, len(a)), lambda i: a[i] || ' ' || a[i + 1]))) AS term FROM w) GROUP BY ALL),
 idf AS (SELECT term, ln((1 + (SELECT count(*) FROM t)) / (1 + count(*))) + 1 AS idf FROM bag GROUP BY term HAVING count(*) >= 2),
 raw AS (SELECT ord, cve_id, split, term, (1 + ln(tf)) * idf AS raw FROM bag JOIN idf USING (term)),
 unit AS (SELECT raw.ord, raw.cve_id, split, term, raw / norm AS weight FROM raw JOIN (SELECT ord, sqrt(sum(raw * raw)) AS norm FROM raw GROUP BY ord) n ON n.ord = raw.ord),
 pair AS (SELECT q.cve_id AS query_id, d.ord, d.cve_id AS train_id, round(sum(q.weight * d.weight), 9) AS similarity FROM unit q JOIN unit d USING (term) WHERE q.split = 'test' AND d.split = 'train' GROUP BY ALL),
 near_ AS (SELECT t.cve_id AS query_id, coalesce(b.train_id, (SELECT arg_min(cve_id, ord) FROM t WHERE split = 'train')) AS train_id, coalesce(b.similarity, 0) AS similarity
   FROM t LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, ord) AS k FROM pair) WHERE k = 1) b ON b.query_id = t.cve_id WHERE t.split = 'test')"""
)


@query(f"WITH {_NEAREST} SELECT query_id, train_id, round(similarity, 6) AS similarity FROM near_")
def tfidf_nearest(spark, sf_dir):
    return _nearest(spark, sf_dir).select("query_id", "train_id", F.round("similarity", 6).alias("similarity"))


@query(
    f"""WITH {_NEAREST}, a AS (SELECT similarity, {_TRANSITION} AS transition, q.cwe_id = d.cwe_id AS same_label FROM near_ n JOIN t q ON q.cve_id = n.query_id JOIN t d ON d.cve_id = n.train_id JOIN base b ON b.cve_id = n.query_id JOIN tuned t ON t.cve_id = n.query_id)
    SELECT coalesce(transition, 'all') AS transition, count(*) AS n, round(quantile_cont(similarity, 0.5), 6) AS p50, round(quantile_cont(similarity, 0.9), 6) AS p90, round(quantile_cont(similarity, 0.95), 6) AS p95, round(max(similarity), 6) AS max,
    count(*) FILTER (similarity >= 0.8) AS high, count(*) FILTER (similarity >= 0.9) AS very_high, count(*) FILTER (similarity >= 0.8 AND same_label) AS high_same_label, count(*) FILTER (similarity >= 0.8 AND NOT same_label) AS high_other_label
    FROM a GROUP BY CUBE (transition)"""
)
def audit_summary(spark, sf_dir):
    texts = _texts(spark, sf_dir).select("cve_id", "cwe_id")
    moved = joined(spark, sf_dir, "test").select(F.col("cve_id").alias("query_id"), compare.transition().alias("transition"))
    label = lambda c: texts.select(F.col("cve_id").alias(f"{c}_id"), F.col("cwe_id").alias(f"{c}_label"))
    rows = _nearest(spark, sf_dir).join(moved, "query_id").join(label("query"), "query_id").join(label("train"), "train_id")
    out = similarity.audit_summary(rows.withColumn("same_label", F.col("query_label") == F.col("train_label")))
    return out.select("transition", "n", *(F.round(c, 6).alias(c) for c in ("p50", "p90", "p95", "max")), "high", "very_high", "high_same_label", "high_other_label")


_FOLD = r"replace(trim(regexp_replace(lower({0}), '\s+', ' ', 'g')), 'ß', 'ss')"
_EXCERPT = r"CASE WHEN length(trim(regexp_replace({0}, '\s+', ' ', 'g'))) <= 200 THEN trim(regexp_replace({0}, '\s+', ' ', 'g')) ELSE substr(trim(regexp_replace({0}, '\s+', ' ', 'g')), 1, 199) || '…' END"


@query(
    f"""WITH {_NEAREST}, top AS (SELECT n.query_id, n.similarity, q.text AS qt, d.text AS dt FROM near_ n JOIN t q ON q.cve_id = n.query_id JOIN t d ON d.cve_id = n.train_id ORDER BY n.similarity DESC, n.query_id LIMIT 20),
    f AS (SELECT *, {_FOLD.format("qt")} AS x, {_FOLD.format("dt")} AS y FROM top), g AS (SELECT *, {_GRAMS.format("x")} AS gx, {_GRAMS.format("y")} AS gy FROM f)
    SELECT query_id, similarity, len(list_intersect(gx, gy)) / (len(gx) + len(gy) - len(list_intersect(gx, gy))) AS char5_jaccard, {_EXCERPT.format("qt")} AS query_excerpt, {_EXCERPT.format("dt")} AS train_excerpt FROM g"""
)
def closest_pairs(spark, sf_dir):
    texts = _texts(spark, sf_dir)
    side = lambda c: texts.select(F.col("cve_id").alias(f"{c}_id"), F.col("text").alias(f"{c}_text"))
    top = stored(similarity.most_similar(_nearest(spark, sf_dir)))  # each has its texts, so texts of others needn't move
    return similarity.closest_pairs(side("train").join(F.broadcast(side("query").join(F.broadcast(top), "query_id")), "train_id"))


@query(_P + f", {_classes('base')} SELECT label, support, row_number() OVER (ORDER BY support DESC, label) AS place FROM base_classes")
def support_order(spark, sf_dir):
    return metrics.support_order(metrics.per_class(run(spark, sf_dir, "base"), ALLOWED))


@query(
    _BOTH
    + """, c AS (SELECT count(*) AS n, count(*) FILTER (gold IN (FROM tail_)) AS tail_n, avg(b.exact_match::INT) AS base, avg(t.exact_match::INT) AS tuned,
      coalesce(avg(b.exact_match::INT) FILTER (gold IN (FROM tail_)), 0) AS tail_base, coalesce(avg(t.exact_match::INT) FILTER (gold IN (FROM tail_)), 0) AS tail_tuned FROM base b JOIN (SELECT ord, exact_match FROM tuned) t USING (ord))
    SELECT n - tail_n AS head_n, round(round(base * n - tail_base * tail_n) / (n - tail_n), 9) AS base_accuracy, round(round(tuned * n - tail_tuned * tail_n) / (n - tail_n), 9) AS tuned_accuracy FROM c"""
)
def derived_head_accuracy(spark, sf_dir):
    out = compare.derived_head(joined(spark, sf_dir), tail(spark, sf_dir))
    return out.select("head_n", *(F.round(c, 9).alias(c) for c in ("base_accuracy", "tuned_accuracy")))


@query(_P + " SELECT b.ord, b.cve_id, b.gold, b.pred AS base_pred, t.pred AS tuned_pred FROM base b JOIN tuned t USING (ord)")
def strict_join(spark, sf_dir):
    return compare.join_runs(run(spark, sf_dir, "base"), run(spark, sf_dir, "tuned")).select("ord", "cve_id", "gold", "base_pred", "tuned_pred")
