"""Classification metrics over verified predictions: gold, pred, valid_label, exact_match, error_flags, is_kev."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import INVALID_FLAGS
from ..functions.text import ratio
from ..sources.shared import stored

INVALID = "INVALID"


def shown(valid: str = "valid_label") -> Column:
    """The predicted class: INVALID for what isn't a valid label."""
    return F.when(F.col(valid), F.col("pred")).otherwise(INVALID)


def table_of(df: DataFrame, labels: list[str], name: str = "label") -> DataFrame:
    """The labels, with their place, as a table to broadcast: they are a closed list."""
    return F.broadcast(df.sparkSession.createDataFrame(list(enumerate(labels)), f"place int, {name} string"))


def headline(rows: DataFrame, *by: str) -> DataFrame:
    """n, accuracy, invalid_rate, accuracy_on_valid; 0 where there is nothing to divide by."""
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if("exact_match").alias("correct"), F.count_if(~F.col("valid_label")).alias("invalid"))
    n = F.col("n")
    return out.select(*by, "n", ratio(F.col("correct"), n).alias("accuracy"), ratio(F.col("invalid"), n).alias("invalid_rate"), ratio(F.col("correct"), n - F.col("invalid")).alias("accuracy_on_valid"))


def per_class(rows: DataFrame, labels: list[str]) -> DataFrame:
    """label, precision, recall, f1, support for each selected label; a prediction counts whatever its gold label is."""
    sides = rows.select(
        F.explode(F.array(F.struct(F.col("gold").alias("label"), F.lit(1).alias("gold"), F.lit(0).alias("pred"), (F.col("gold") == shown()).cast("int").alias("hit")), F.struct(shown().alias("label"), F.lit(0).alias("gold"), F.lit(1).alias("pred"), F.lit(0).alias("hit")))).alias("s")
    ).select("s.*")
    counts = sides.groupBy("label").agg(F.sum("gold").alias("support"), F.sum("pred").alias("predicted"), F.sum("hit").alias("hits"))
    out = table_of(rows, labels).join(counts, "label", "left").na.fill(0, ["support", "predicted", "hits"])
    out = out.withColumns({"precision": ratio(F.col("hits"), F.col("predicted")), "recall": ratio(F.col("hits"), F.col("support")), "f1": ratio(2 * F.col("hits"), F.col("predicted") + F.col("support"))})
    return out.select("place", "label", "precision", "recall", "f1", "support")


def averaged(classes: DataFrame) -> DataFrame:
    """macro_f1 over all labels, those without rows too, and weighted_f1 by support."""
    weighted = ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support"))
    return classes.agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"), weighted.alias("weighted_f1"))


def confusion(rows: DataFrame, labels: list[str]) -> DataFrame:
    """gold, pred, n for every pair of labels and INVALID, zeros too; other golds are left out."""
    sides = [*labels, INVALID]
    cells = rows.sparkSession.createDataFrame([(g, p, 0) for g in sides for p in sides], "gold string, pred string, n long")
    # zeros are added rather than joined: a join's inferred filters would repeat the verifier's expressions many times
    counts = rows.groupBy("gold", shown().alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    counts = cells.union(counts).groupBy("gold", "pred").agg(F.sum("n").alias("n"))
    return counts.where(F.col("gold").isin(sides) & F.col("pred").isin(sides))


def confusion_matrix(rows: DataFrame, labels: list[str]) -> DataFrame:
    """The same, one row for each gold label and one column for each predicted one."""
    return confusion(rows, labels).groupBy("gold").pivot("pred", [*labels, INVALID]).agg(F.first("n"))


def flag_counts(rows: DataFrame) -> DataFrame:
    """flag, n for each of the invalid flags."""
    zeros = rows.sparkSession.createDataFrame([(f, 0) for f in INVALID_FLAGS], "flag string, one long")
    found = zeros.union(rows.select(F.explode("error_flags"), F.lit(1).cast("long"))).groupBy("flag").agg(F.sum("one").alias("n"))
    return found.where(F.col("flag").isin(INVALID_FLAGS))


def slices(rows: DataFrame) -> DataFrame:
    """slice (kev, non_kev), n, accuracy; both are there even if empty."""
    counts = rows.groupBy(F.when(F.col("is_kev"), "kev").otherwise("non_kev").alias("slice")).agg(F.count(F.lit(1)).alias("n"), F.count_if("exact_match").alias("correct"))
    out = table_of(rows, ["kev", "non_kev"], "slice").join(counts, "slice", "left").na.fill(0, ["n", "correct"])
    return out.select("slice", "n", ratio(F.col("correct"), F.col("n")).alias("accuracy"))


def compute(rows: DataFrame, labels: list[str]) -> dict[str, Any]:
    """All metrics as one document; the columns it takes are stored once and read several times."""
    rows = stored(rows.select("gold", "pred", "valid_label", "exact_match", "error_flags", "is_kev"))
    classes = per_class(rows, labels)
    listed = [*labels, INVALID]
    cells = {(r["gold"], r["pred"]): r["n"] for r in confusion(rows, labels).collect()}
    return {
        **headline(rows).first().asDict(),
        **averaged(classes).first().asDict(),
        "invalid_breakdown": {r["flag"]: r["n"] for r in flag_counts(rows).collect()},
        "per_class": {r["label"]: {k: r[k] for k in ("precision", "recall", "f1", "support")} for r in classes.orderBy("place").collect()},
        "confusion_matrix": {"labels": listed, "matrix": [[cells[g, p] for p in listed] for g in listed]},
        "slices": {r["slice"]: {"n": r["n"], "accuracy": r["accuracy"]} for r in slices(rows).collect()},
    }


def support_order(classes: DataFrame) -> DataFrame:
    """label, support and place: the classes by falling support, then by name. The classes are the closed label set."""
    return classes.select("label", "support", F.row_number().over(Window.orderBy(F.desc("support"), "label")).alias("place"))
