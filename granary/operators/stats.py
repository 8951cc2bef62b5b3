"""Funnels, rollups and distributions of canonical rows and splits."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ratio
from ..sources.shared import stored

#: Distinct values of a range that one task numbers.
VALUES = 1 << 20


def funnel(rows: DataFrame) -> DataFrame:
    """One row of conditional counts; the label statuses count rejected rows too."""
    status = lambda s: F.count_if(F.col("label_status") == s)
    return rows.agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if("is_rejected").alias("rejected"),
        F.count_if(F.coalesce(F.length("description_en"), F.lit(0)) == 0).alias("without_description"),
        status("none").alias("no_label"),
        status("placeholder_only").alias("placeholder_only"),
        status("multi").alias("multi_label"),
        status("single").alias("single_label"),
        F.count_if("eligible").alias("eligible"),
    )


def per_year(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.substring("published", 1, 4).alias("year")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("label_status") == "single").alias("single_label"))


def status_by_split(rows: DataFrame) -> DataFrame:
    return rows.where("split IS NOT NULL").groupBy("split", "label_status").agg(F.count(F.lit(1)).alias("n"))


def label_frequency(rows: DataFrame, most: int = 50) -> DataFrame:
    """The most frequent labels of eligible train rows."""
    counts = rows.where("eligible AND split = 'train'").groupBy("cwe_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "cwe_id").limit(most)


def coverage(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Per split: eligible rows, those with a selected label, and their share."""
    marked = rows.where("eligible AND split IS NOT NULL").join(F.broadcast(labels.select("cwe_id", F.lit(True).alias("selected"))), "cwe_id", "left")
    out = marked.groupBy("split").agg(F.count(F.lit(1)).alias("eligible"), F.count_if("selected").alias("in_selected"))
    return out.withColumn("fraction", ratio(F.col("in_selected"), F.col("eligible")))


def class_distribution(rows: DataFrame) -> DataFrame:
    return rows.groupBy("split", "cwe_id").agg(F.count(F.lit(1)).alias("n"))


def class_cube(rows: DataFrame) -> DataFrame:
    """The same with totals by split, by label and of all; null stands for all."""
    return rows.cube("split", "cwe_id").agg(F.count(F.lit(1)).alias("n"))


def ranked_values(rows: DataFrame, value: Column, *by: str) -> DataFrame:
    """by, value, n, upto and total: how many rows of a group have each value, and this or a lower one; nulls don't count.

    Counts are combined before the shuffle, so a group is as many rows as it has distinct values. Those are dealt by about
    even ranges of the value, counted and numbered range by range, so no task holds all of a group.
    """
    counts = stored(rows.select(*by, value.alias("value")).where("value IS NOT NULL").groupBy(*by, "value").agg(F.count(F.lit(1)).alias("n")))
    ranges = max(1, math.ceil(counts.count() / VALUES))
    dealt = stored(counts.repartitionByRange(ranges, "value").withColumn("range", F.spark_partition_id()))
    sums = dealt.groupBy(*by, "range").agg(F.sum("n").alias("held"))  # a row for each group and range
    before = F.sum("held").over(Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*by, "range", F.coalesce(before, F.lit(0)).alias("before"), F.sum("held").over(Window.partitionBy(*by)).alias("total"))
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"s.{c}")) for c in (*by, "range")]
    within = F.sum("n").over(Window.partitionBy(*(f"d.{c}" for c in (*by, "range"))).orderBy("value"))
    found = dealt.alias("d").join(sums.alias("s"), reduce(and_, same))
    return found.select(*(F.col(f"d.{c}") for c in by), "value", "n", (F.col("before") + within).alias("upto"), "total")


def exact_percentiles(rows: DataFrame, value: Column, ranks: list[float], *by: str) -> DataFrame:
    """by, p (an array, one for each rank) and max: percentiles interpolated between the two values around each rank.

    Only those values are combined for a group, whatever its number of rows and of values.
    """
    v = ranked_values(rows, value, *by)
    at = lambda place: F.max(F.when((F.col("upto") - F.col("n") <= place) & (place < F.col("upto")), F.col("value"))).cast("double")
    spots = [F.lit(float(r)) * (F.col("total") - 1) for r in ranks]
    sides = [(at(F.floor(s)).alias(f"low{i}"), at(F.ceil(s)).alias(f"high{i}"), F.first(s - F.floor(s)).alias(f"part{i}")) for i, s in enumerate(spots)]
    found = v.groupBy(*by).agg(*(c for side in sides for c in side), F.max("value").alias("max"))
    between = lambda i: F.when(F.col(f"part{i}") == 0, F.col(f"low{i}")).otherwise((1 - F.col(f"part{i}")) * F.col(f"low{i}") + F.col(f"part{i}") * F.col(f"high{i}"))
    return found.select(*by, F.array(*map(between, range(len(ranks)))).alias("p"), "max")


def percentiles(rows: DataFrame, value: Column, *by: str, ranks: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """Interpolated percentiles cut to whole numbers, and the maximum; 0 for no rows or no values."""
    names = [f"p{round(100 * r)}" for r in ranks]
    whole = [F.coalesce(F.col("p")[i].cast("int"), F.lit(0)).alias(n) for i, n in enumerate(names)]
    found = exact_percentiles(rows, value, list(ranks), *by).select(*by, *whole, F.coalesce(F.col("max").cast("int"), F.lit(0)).alias("max"))
    if not by:
        return found
    groups = rows.select(*by).distinct()  # a group without values has a row too
    same = reduce(and_, (F.col(f"g.{c}").eqNullSafe(F.col(f"f.{c}")) for c in by))
    return groups.alias("g").join(found.alias("f"), same, "left").select(*(F.col(f"g.{c}") for c in by), *(F.coalesce(c, F.lit(0)).alias(c) for c in (*names, "max")))


def token_summary(rows: DataFrame, tokens: str, *by: str, limits: tuple[int, ...] = (480, 1536)) -> DataFrame:
    over = [F.count_if(F.col(tokens) > n).alias(f"over_{n}") for n in limits]
    table = percentiles(rows, F.col(tokens), *by, ranks=(0.5, 0.95, 0.99))
    counts = rows.groupBy(*by).agg(*over)
    return table.join(counts, list(by)) if by else table.crossJoin(counts)  # one row each


def kev_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("split").agg(F.count_if("is_kev").alias("kev"), F.count(F.lit(1)).alias("n"))


def exclusions(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Per split what the label rules leave out: placeholder, several labels, one label that isn't selected."""
    marked = rows.where("split IS NOT NULL").join(F.broadcast(labels.select("cwe_id", F.lit(True).alias("selected"))), "cwe_id", "left")
    status = F.col("label_status")
    return marked.groupBy("split").agg(
        F.count_if(status == "placeholder_only").alias("placeholder_only"),
        F.count_if(status == "multi").alias("multi_label"),
        F.count_if((status == "single") & F.col("selected").isNull()).alias("single_outside_selected"),
    )


def internal_duplicates(rows: DataFrame, content: str = "description_norm_hash") -> DataFrame:
    """Rows beyond the first of each content, and of how many contents."""
    groups = rows.groupBy(content).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"), F.count(F.lit(1)).alias("duplicated_contents"))


def label_tiers(labels: DataFrame) -> DataFrame:
    """rank, cwe_id and tier of the selected labels: the last third by rank is the tail; of fewer than three all are."""
    total = F.count(F.lit(1)).over(Window.partitionBy())  # the labels are few by choice
    return labels.withColumn("k", total).select("rank", "cwe_id", F.when((F.col("k") < 3) | (F.col("rank") > F.col("k") - F.floor(F.col("k") / 3)), "tail").otherwise("head").alias("tier"))
