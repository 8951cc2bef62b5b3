"""Raw records to the canonical form, its validator, and keyed last-wins dedup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import once, strip, text_hash
from ..sources.shared import stored
from .verify import json_reader

ID = r"\ACVE-[0-9]{4}-[0-9]{4,}\z"
LABEL = r"\ACWE-[0-9]+\z"
STATUSES = ("single", "multi", "placeholder_only", "none")
COLUMNS = (
    "cve_id", "published", "last_modified", "vuln_status", "description_en", "description_norm_hash", "cwe_primary", "cwe_secondary", "cwe_all",
    "placeholder_only", "cwe_id", "label_status", "cvss_v31_base_score", "cvss_v31_severity", "is_kev", "kev_date_added", "is_rejected",
)


def _labels(weaknesses: Column, primary: bool) -> Column:
    """English label texts of the primary weaknesses, or of all others."""
    is_primary = lambda w: F.coalesce(w["type"] == "Primary", F.lit(False))
    some = F.filter(weaknesses, lambda w: is_primary(w) if primary else ~is_primary(w))
    english = F.transform(some, lambda w: F.transform(F.filter(F.coalesce(w["description"], F.array().cast("array<struct<lang:string,value:string>>")), lambda d: d["lang"] == "en"), lambda d: strip(F.coalesce(d["value"], F.lit("")))))
    return F.coalesce(F.flatten(english), F.array().cast("array<string>"))


def _unique(labels: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(labels, lambda v: v.rlike(LABEL))))


def canonical(records: DataFrame, placeholders: list[str], nfkc: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """The 17 canonical columns of each record with a well-formed id, and the columns to keep besides."""
    english = F.filter("descriptions", lambda d: d["lang"] == "en")
    described = records.where(F.col("id").rlike(ID)).withColumns(
        {
            "_text": strip(F.coalesce(F.try_element_at(english, F.lit(1))["value"], F.lit(""))),
            "_raw1": _labels(F.col("weaknesses"), True),
            "_raw2": _labels(F.col("weaknesses"), False),
        }
    )
    described = described.withColumns({"_p": _unique(F.col("_raw1")), "_s": _unique(F.col("_raw2"))}).withColumn("_all", F.array_sort(F.array_union("_p", "_s")))
    raw = F.concat("_raw1", "_raw2")
    described = described.withColumn("_only", (F.size(raw) > 0) & (F.size("_all") == 0) & F.forall(raw, lambda v: v.isin(placeholders)))
    n, first = F.size("_all"), F.try_element_at(F.col("metrics.cvssMetricV31"), F.lit(1))["cvssData"]
    return described.select(
        F.col("id").alias("cve_id"),
        F.substring("published", 1, 10).alias("published"),
        F.col("lastModified").alias("last_modified"),
        F.col("vulnStatus").alias("vuln_status"),
        F.col("_text").alias("description_en"),
        text_hash(F.col("_text"), nfkc).alias("description_norm_hash"),
        F.col("_p").alias("cwe_primary"),
        F.col("_s").alias("cwe_secondary"),
        F.col("_all").alias("cwe_all"),
        F.col("_only").alias("placeholder_only"),
        F.when(n == 1, F.element_at("_all", 1)).alias("cwe_id"),
        F.when(n == 1, "single").when(n > 1, "multi").when(F.col("_only"), "placeholder_only").otherwise("none").alias("label_status"),
        first["baseScore"].alias("cvss_v31_base_score"),
        first["baseSeverity"].alias("cvss_v31_severity"),
        F.col("cisaExploitAdd").isNotNull().alias("is_kev"),
        F.col("cisaExploitAdd").alias("kev_date_added"),
        (F.coalesce(F.col("vulnStatus") == "Rejected", F.lit(False)) | F.col("_text").startswith("** REJECT **")).alias("is_rejected"),
        *keep,
    )


def last_wins(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """For each key its last row in the order."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*(F.desc(c) for c in order)))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


_DATE = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
_TIME = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{3}([0-9]{3})?)?)?(Z|[+-][0-9]{2}:[0-9]{2})?)?\z"
_TEXTS = ("vuln_status", "description_en", "description_norm_hash", "label_status")
_FLAGS = ("placeholder_only", "is_kev", "is_rejected")


def validate(lines: DataFrame, line: str = "value", nfkc: bool = False) -> DataFrame:
    """The lines (JSON text) with cve_id and problems: the codes of what is wrong with the record, in a fixed order.

    A line is one JSON value and nothing after it. Of a key given twice the last value counts; NaN and the infinities are
    read as numbers.
    """
    lines = once(lines, _text=json_reader(0.5)(F.col(line)))
    lines = once(lines, _keys=F.json_object_keys("_text"), _fields=F.from_json("_text", ", ".join(f"{c} VARIANT" for c in COLUMNS)))
    lines = once(lines, _kinds=F.struct(*(F.coalesce(F.schema_of_variant(F.col(f"_fields.{c}")), F.lit("VOID")).alias(c) for c in COLUMNS)))
    kind = lambda name: F.col(f"_kinds.{name}")
    text = lambda name: F.when(kind(name) == "STRING", F.try_variant_get(F.col(f"_fields.{name}"), "$", "string"))
    flag = lambda name: F.when(kind(name) == "BOOLEAN", F.try_variant_get(F.col(f"_fields.{name}"), "$", "boolean"))
    is_number = lambda k: k.isin("BIGINT", "DOUBLE", "FLOAT") | k.startswith("DECIMAL")
    no = lambda c: ~F.coalesce(c, F.lit(False))

    def labels(name: str) -> tuple[Column, Column]:
        """The list, and whether it is one of texts only."""
        values = F.try_variant_get(F.col(f"_fields.{name}"), "$", "array<string>")
        return values, F.coalesce(kind(name).isin("ARRAY<STRING>", "ARRAY<VOID>") & F.forall(values, lambda x: x.isNotNull()), F.lit(False))

    keys = F.coalesce("_keys", F.array().cast("array<string>"))
    checks: list[tuple[Column, str]] = [(~F.array_contains(keys, c), f"missing_field:{c}") for c in COLUMNS]
    published, modified = text("published"), text("last_modified")
    checks += [
        (no(text("cve_id").rlike(ID)), "invalid_cve_id"),
        (no(published.rlike(_DATE) & published.try_cast("date").isNotNull()), "invalid_published"),
        (no(modified.rlike(_TIME) & modified.try_cast("timestamp").isNotNull()), "invalid_last_modified"),
    ]
    checks += [(kind(c) != "STRING", f"invalid_type:{c}") for c in _TEXTS]
    checks += [(kind(c) != "BOOLEAN", f"invalid_type:{c}") for c in _FLAGS]
    checks.append(((kind("cvss_v31_base_score") != "VOID") & ~is_number(kind("cvss_v31_base_score")), "invalid_type:cvss_v31_base_score"))
    checks += [(~kind(c).isin("VOID", "STRING"), f"invalid_type:{c}") for c in ("cvss_v31_severity", "kev_date_added")]
    for name in ("cwe_primary", "cwe_secondary", "cwe_all"):
        values, texts = labels(name)
        checks += [(~texts, f"invalid_type:{name}"), (texts & F.exists(values, lambda x: ~x.rlike(LABEL)), f"invalid_cwe:{name}")]
    all_, fine = labels("cwe_all")
    n = F.when(fine, F.size(all_)).otherwise(0)
    checks.append((fine & (F.to_json(all_) != F.to_json(F.array_sort(F.array_distinct(all_)))), "cwe_all_not_sorted_unique"))
    checks.append((no(text("cwe_id").eqNullSafe(F.when(n == 1, F.try_element_at(all_, F.lit(1))))) | ~kind("cwe_id").isin("VOID", "STRING"), "inconsistent_cwe_id"))
    status, only = text("label_status"), flag("placeholder_only")
    known = F.coalesce(status.isin(*STATUSES), F.lit(False))
    expected = F.when(n == 1, "single").when(n > 1, "multi").when(only, "placeholder_only").otherwise("none")
    both = known & fine & only.isNotNull()
    checks += [
        (~known, "invalid_label_status"),
        (both & (status != expected), "inconsistent_label_status"),
        (both & (n > 0) & only, "inconsistent_placeholder_only"),
        (F.coalesce(text("description_norm_hash") != text_hash(F.coalesce(text("description_en"), F.lit("")), nfkc), F.lit(False)) & text("description_en").isNotNull(), "description_norm_hash_mismatch"),
        (F.coalesce(flag("is_kev") != (kind("kev_date_added") != "VOID"), F.lit(False)), "inconsistent_is_kev"),
    ]
    found = F.filter(F.array(*(F.when(c, F.lit(code)) for c, code in checks)), lambda x: x.isNotNull())
    problems = F.when(F.col("_text").isNull(), F.array(F.lit("invalid_json"))).when(F.col("_keys").isNull(), F.array(F.lit("record_not_object"))).otherwise(found)
    return lines.withColumns({"cve_id": text("cve_id"), "problems": problems}).drop("_text", "_keys", "_fields", "_kinds")


def validation_summary(checked: DataFrame, order: str = "ord", examples: int = 20) -> dict:
    """rows, invalid, problems_by_type (by the part before a colon) and the first examples in order."""
    checked = stored(checked.select(order, "cve_id", "problems"))  # once, for three passes
    bad = checked.where(F.size("problems") > 0)
    counts = bad.select(F.explode("problems").alias("p")).groupBy(F.split_part("p", F.lit(":"), F.lit(1)).alias("type")).count().orderBy("type").collect()
    total = checked.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.size("problems") > 0).alias("invalid")).first()
    first = bad.orderBy(order).limit(examples).select(order, "cve_id", "problems").collect()
    return {"rows": total["rows"], "invalid": total["invalid"], "problems_by_type": {r["type"]: r["count"] for r in counts}, "examples": [r.asDict() for r in first]}


__all__ = ["COLUMNS", "canonical", "last_wins", "validate", "validation_summary"]
