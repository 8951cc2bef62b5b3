"""Two runs compared row by row, and the errors of one run in classes.

Joined rows have ord, cve_id, gold, description, is_kev, tokens and, for each model, <model>_pred, <model>_valid_json,
<model>_has_key, <model>_valid_label and <model>_exact_match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import FAMILIES, OUTCOMES, OVERGENERAL, SPECIFIC_CHILDREN, TRACKED_CONFUSIONS, TRANSITIONS
from ..functions.text import ratio
from .metrics import INVALID, table_of

MODELS = ("base", "tuned")
RESULT = ("pred", "valid_json", "has_key", "valid_label", "exact_match")


def join_runs(base: DataFrame, tuned: DataFrame) -> DataFrame:
    """Rows of both runs by place: an error unless ids are unique and the runs have the same ids and golds in order."""
    side = lambda df, m: df.select(F.col("ord"), F.col("cve_id").alias(f"{m}_id"), F.col("gold").alias(f"{m}_gold"), *(F.col(c).alias(f"{m}_{c}") for c in RESULT))
    both = side(base, "base").join(side(tuned, "tuned"), "ord", "full_outer")
    wrong = both.agg(
        F.count_if(~F.col("base_id").eqNullSafe(F.col("tuned_id"))).alias("ids"),
        F.count_if(~F.col("base_gold").eqNullSafe(F.col("tuned_gold"))).alias("golds"),
        (F.count(F.lit(1)) - F.count_distinct("base_id")).alias("repeated"),
    ).first()
    if any(wrong):
        raise ValueError(f"the runs don't match: {wrong.asDict()}")
    return both.withColumnsRenamed({"base_id": "cve_id", "base_gold": "gold"}).drop("tuned_id", "tuned_gold")


def family(label: Column) -> Column:
    """The first family that has the label, else null."""
    out = F.lit(None).cast("string")
    for name, members in reversed(FAMILIES.items()):
        out = F.when(label.isin(members), name).otherwise(out)
    return out


def outcome(model: str, allowed: list[str]) -> Column:
    """correct, or the class of the error."""
    c = lambda name: F.col(f"{model}_{name}")
    near = F.coalesce(family(c("pred")) == family(F.col("gold")), F.lit(False))
    return (
        F.when(~c("valid_json") | ~c("has_key"), "invalid_format")
        .when(c("pred").isNull() | ~c("pred").isin(allowed), "unknown_cwe")
        .when(c("exact_match"), "correct")
        .when(near, "nearby_cwe_confusion")
        .otherwise("semantic_confusion")
    )


def transition() -> Column:
    base, tuned = F.col("base_exact_match"), F.col("tuned_exact_match")
    return F.when(base & tuned, "both_right").when(tuned, "fixed_by_sft").when(base, "broken_by_sft").otherwise("both_wrong")


def long_tail(labels: DataFrame) -> DataFrame:
    """The third of the labels (one at least) with the fewest training rows, ties by name."""
    place = F.row_number().over(Window.orderBy("train_count", "cwe_id"))
    size = F.count(F.lit(1)).over(Window.partitionBy())
    return labels.withColumns({"_place": place, "_most": F.greatest(F.lit(1), F.floor(size / 3))}).where("_place <= _most").select("cwe_id")


def overgeneralizes(model: str) -> Column:
    pred = F.col(f"{model}_pred")
    return ~F.col(f"{model}_exact_match") & F.coalesce(pred.isin(OVERGENERAL), F.lit(False)) & ~family(pred).eqNullSafe(family(F.col("gold")))


def too_unspecific(model: str) -> Column:
    out = F.lit(False)
    for broad, narrow in SPECIFIC_CHILDREN.items():
        out |= (F.col(f"{model}_pred") == broad) & F.col("gold").isin(narrow)
    return ~F.col(f"{model}_exact_match") & F.coalesce(out, F.lit(False)) & family(F.col(f"{model}_pred")).eqNullSafe(family(F.col("gold")))


def by_model(joined: DataFrame, *columns: str, extra: dict | None = None) -> DataFrame:
    """A row for each model of each joined row: model, pred, exact_match, what extra computes from a model, and columns."""
    extra = extra or {}
    each = [F.struct(F.lit(m).alias("model"), F.col(f"{m}_pred").alias("pred"), F.col(f"{m}_exact_match").alias("exact_match"), *(f(m).alias(k) for k, f in extra.items())) for m in MODELS]
    return joined.select(*columns, F.explode(F.array(*each)).alias("m")).select(*columns, "m.*")


def transition_counts(joined: DataFrame) -> DataFrame:
    counts = joined.groupBy(transition().alias("transition")).agg(F.count(F.lit(1)).alias("n"))
    return table_of(joined, TRANSITIONS, "transition").join(counts, "transition", "left").na.fill(0, ["n"]).select("transition", "n")


def outcome_counts(joined: DataFrame, allowed: list[str]) -> DataFrame:
    """model, outcome, n for every outcome."""
    counts = by_model(joined, extra={"outcome": lambda m: outcome(m, allowed)}).groupBy("model", "outcome").agg(F.count(F.lit(1)).alias("n"))
    all_ = joined.sparkSession.createDataFrame([(m, o) for m in MODELS for o in OUTCOMES], "model string, outcome string")
    return F.broadcast(all_).join(counts, ["model", "outcome"], "left").na.fill(0, ["n"])


def error_flags(joined: DataFrame, tail: DataFrame) -> DataFrame:
    """model, gold_is_long_tail, overgeneralization, under_specific: counts among the errors."""
    marked = joined.join(F.broadcast(tail.select(F.col("cwe_id").alias("gold"), F.lit(True).alias("is_tail"))), "gold", "left").withColumn("is_tail", F.coalesce("is_tail", F.lit(False)))
    rows = by_model(marked, "is_tail", extra={"over": overgeneralizes, "under": too_unspecific})
    return rows.groupBy("model").agg(F.count_if(F.col("is_tail") & ~F.col("exact_match")).alias("gold_is_long_tail"), F.count_if("over").alias("overgeneralization"), F.count_if("under").alias("under_specific"))


def failures(joined: DataFrame, allowed: list[str], tail: DataFrame) -> DataFrame:
    """Rows that either model gets wrong, with transition, error types and flags, broken ones first, then by id."""
    marked = joined.join(F.broadcast(tail.select(F.col("cwe_id").alias("gold"), F.lit(True).alias("gold_is_long_tail"))), "gold", "left")
    found = marked.withColumns({"transition": transition(), "base_outcome": outcome("base", allowed), "tuned_outcome": outcome("tuned", allowed)})
    found = found.withColumns({"gold_is_long_tail": F.coalesce("gold_is_long_tail", F.lit(False)), "overgeneralization": overgeneralizes("tuned"), "under_specific": too_unspecific("tuned")})
    found = found.where("transition <> 'both_right'")
    return found.orderBy(F.when(F.col("transition") == "broken_by_sft", 0).otherwise(1), "cve_id")


def _misses(joined: DataFrame) -> DataFrame:
    return by_model(joined, "ord", "cve_id", "gold").where(~F.col("exact_match")).withColumn("pred", F.coalesce("pred", F.lit(INVALID)))


def top_confusions(joined: DataFrame, most: int = 15) -> DataFrame:
    """model, rank, gold, pred, n: the most frequent confusions, ties by first occurrence."""
    counts = _misses(joined).groupBy("model", "gold", "pred").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    place = F.row_number().over(Window.partitionBy("model").orderBy(F.desc("n"), "first"))
    return counts.withColumn("rank", place).where(F.col("rank") <= most).select("model", "rank", "gold", "pred", "n")


def tracked_counts(joined: DataFrame, pairs: list[tuple[str, str]] = TRACKED_CONFUSIONS) -> DataFrame:
    """model, gold, pred, n for each tracked confusion."""
    counts = _misses(joined).groupBy("model", "gold", "pred").agg(F.count(F.lit(1)).alias("n"))
    all_ = joined.sparkSession.createDataFrame([(m, g, p) for m in MODELS for g, p in pairs], "model string, gold string, pred string")
    return F.broadcast(all_).join(counts, ["model", "gold", "pred"], "left").na.fill(0, ["n"])


def gold_sinks(joined: DataFrame, most: int = 3) -> DataFrame:
    """model, gold, rank, pred, n: what each gold label is most often taken for."""
    counts = _misses(joined).groupBy("model", "gold", "pred").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    place = F.row_number().over(Window.partitionBy("model", "gold").orderBy(F.desc("n"), "first"))
    return counts.withColumn("rank", place).where(F.col("rank") <= most).select("model", "gold", "rank", "pred", "n")


def concentration(joined: DataFrame, most: int = 3) -> DataFrame:
    """model, rank, pred, n, share: the most predicted classes and their share of all rows."""
    rows = by_model(joined, "ord").withColumn("pred", F.coalesce("pred", F.lit(INVALID)))
    counts = rows.groupBy("model", "pred").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    each = Window.partitionBy("model")
    counts = counts.withColumns({"rank": F.row_number().over(each.orderBy(F.desc("n"), "first")), "total": F.sum("n").over(each)})
    return counts.where(F.col("rank") <= most).select("model", "rank", "pred", "n", ratio(F.col("n"), F.col("total")).alias("share"))


def _bucketed(joined: DataFrame, bucket: Column, names: list[str]) -> DataFrame:
    rows = by_model(joined.withColumn("bucket", bucket), "bucket").groupBy("model", "bucket").agg(F.count(F.lit(1)).alias("n"), F.count_if("exact_match").alias("correct"))
    all_ = joined.sparkSession.createDataFrame([(m, b) for m in MODELS for b in names], "model string, bucket string")
    out = F.broadcast(all_).join(rows, ["model", "bucket"], "left").na.fill(0, ["n", "correct"])
    return out.select("model", "bucket", "n", "correct", ratio(F.col("correct"), F.col("n")).alias("accuracy"))


def by_length(joined: DataFrame) -> DataFrame:
    n = F.length("description")
    return _bucketed(joined, F.when(n < 250, "<250").when(n < 500, "250-500").when(n < 1000, "500-1000").otherwise(">=1000"), ["<250", "250-500", "500-1000", ">=1000"])


def by_tokens(joined: DataFrame) -> DataFrame:
    return _bucketed(joined, F.when(F.col("tokens") < 480, "<480").otherwise("480-1536"), ["<480", "480-1536"])


def by_kev(joined: DataFrame) -> DataFrame:
    return _bucketed(joined, F.when(F.col("is_kev"), "kev").otherwise("non_kev"), ["kev", "non_kev"])


def head_and_tail(joined: DataFrame, tail: DataFrame) -> DataFrame:
    marked = joined.join(F.broadcast(tail.select(F.col("cwe_id").alias("gold"), F.lit("tail").alias("part"))), "gold", "left")
    return _bucketed(marked, F.coalesce("part", F.lit("head")), ["head", "tail"])


def derived_head(joined: DataFrame, tail: DataFrame) -> DataFrame:
    """head_n and each model's accuracy outside the tail, derived from the accuracies overall and in the tail."""
    marked = joined.join(F.broadcast(tail.select(F.col("cwe_id").alias("gold"), F.lit(True).alias("in_tail"))), "gold", "left")
    right = lambda m: F.col(f"{m}_exact_match").cast("int")
    sums = {m: (F.avg(right(m)).alias(f"{m}_all"), F.coalesce(F.avg(F.when(F.col("in_tail"), right(m))), F.lit(0.0)).alias(f"{m}_tail")) for m in MODELS}
    totals = marked.agg(F.count(F.lit(1)).alias("n"), F.count_if("in_tail").alias("tail_n"), *(c for pair in sums.values() for c in pair))
    correct = lambda m: F.bround(F.col(f"{m}_all") * F.col("n") - F.col(f"{m}_tail") * F.col("tail_n"))
    head = F.col("n") - F.col("tail_n")
    return totals.select(head.alias("head_n"), *(ratio(correct(m), head).alias(f"{m}_accuracy") for m in MODELS))


def class_recall(joined: DataFrame, labels: list[str], model: str = "base") -> DataFrame:
    rows = joined.groupBy(F.col("gold").alias("label")).agg(F.count(F.lit(1)).alias("support"), F.count_if(f"{model}_exact_match").alias("correct"))
    out = table_of(joined, labels).join(rows, "label", "left").na.fill(0, ["support", "correct"])
    return out.select("label", "support", "correct", ratio(F.col("correct"), F.col("support")).alias("recall"))


def class_delta(base: DataFrame, tuned: DataFrame) -> DataFrame:
    """label, support and tuned minus base for precision, recall and f1, of two per-class tables."""
    names = ("precision", "recall", "f1")
    other = base.select("label", *(F.col(c).alias(f"base_{c}") for c in names))
    return tuned.join(other, "label").select("label", "support", *((F.col(c) - F.col(f"base_{c}")).alias(f"{c}_delta") for c in names))


def largest_changes(delta: DataFrame, metric: str = "f1_delta", most: int = 5) -> DataFrame:
    """kind (gain, regression), rank, label, change."""
    d = F.col(metric)
    ranked = delta.withColumns({"kind": F.when(d > 0, "gain").when(d < 0, "regression"), "_size": F.abs(d)}).where("kind IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("_size"), "label"))
    return ranked.withColumn("rank", place).where(F.col("rank") <= most).select("kind", "rank", "label", d.alias("change"))


def comparison(base: DataFrame, tuned: DataFrame) -> DataFrame:
    """metric, base, tuned, delta from two one-row tables of the same numeric columns."""
    names = [c for c in base.columns if c in tuned.columns]
    long = lambda df, name: df.select(F.expr(f"stack({len(names)}, {', '.join(f"'{c}', cast({c} as double)" for c in names)}) as (metric, {name})"))
    return long(base, "base").join(long(tuned, "tuned"), "metric").withColumn("delta", F.col("tuned") - F.col("base"))


def representatives(joined: DataFrame, allowed: list[str], tail: DataFrame, confusions: int = 8, each: int = 5) -> DataFrame:
    """Failures of the base run to read: some of each frequent confusion, then invalid ones, then of long-tail labels.

    A row stands in the first group that takes it; a later group takes its own first rows among those left.
    """
    marked = joined.join(F.broadcast(tail.select(F.col("cwe_id").alias("gold"), F.lit(True).alias("is_tail"))), "gold", "left")
    misses = marked.where(~F.col("base_exact_match")).withColumns({"pred": F.coalesce("base_pred", F.lit(INVALID)), "error_type": outcome("base", allowed)})
    top = top_confusions(joined, confusions).where("model = 'base'").select("gold", "pred", F.col("rank").alias("group"))
    columns = ("ord", "cve_id", "gold", "pred", "error_type", "description")
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("ord"))
    first = misses.join(F.broadcast(top), ["gold", "pred"]).withColumn("place", place("group")).where(F.col("place") <= each).select(*columns, "group", "place")
    invalid = misses.where(F.col("error_type").isin("invalid_format", "unknown_cwe")).join(first.select("cve_id"), "cve_id", "left_anti")
    second = invalid.withColumn("place", F.row_number().over(Window.orderBy("ord"))).where(F.col("place") <= each).select(*columns, F.lit(confusions + 1).alias("group"), "place")
    rest = misses.where("is_tail").join(first.select("cve_id").union(second.select("cve_id")), "cve_id", "left_anti")
    third = rest.withColumn("place", F.row_number().over(Window.orderBy("ord"))).where(F.col("place") <= each).select(*columns, F.lit(confusions + 2).alias("group"), "place")
    return first.unionByName(second).unionByName(third)


def distinct_gold(joined: DataFrame, kind: str, most: int, besides: DataFrame | None = None) -> DataFrame:
    """The first rows of a transition, one for each gold label, without labels that besides has."""
    rows = joined.where(transition() == kind)
    if besides is not None:
        rows = rows.join(besides.select("gold").distinct(), "gold", "left_anti")
    one = rows.withColumn("_place", F.row_number().over(Window.partitionBy("gold").orderBy("ord"))).where("_place = 1")
    return one.orderBy("ord").limit(most).select("ord", "cve_id", "gold")
