"""The generated tables as the canonical relation and as predictions, so that every operator runs on them.

records(): documents with their labels, as canonical rows; predictions(): model outputs around each row's label, values in
wrappers. The SQL texts say the same in another engine's words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions.text import text_hash
from ..operators.curate import eligible, split_of

#: A label for each of the twenty sources.
LABELS = [
    "CWE-79", "CWE-89", "CWE-78", "CWE-22", "CWE-352", "CWE-434", "CWE-862", "CWE-200", "CWE-284", "CWE-416",
    "CWE-787", "CWE-120", "CWE-125", "CWE-20", "CWE-476", "CWE-287", "CWE-190", "CWE-502", "CWE-306", "CWE-863",
]
#: The closed label set of the predictions.
ALLOWED = LABELS[:15]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def label_at(place) -> F.Column:
    return F.element_at(F.array(*map(F.lit, LABELS)), (place % 20 + 1).cast("int"))


def records(spark: SparkSession, sf_dir: str, labelled: bool = True) -> DataFrame:
    """ord, the canonical columns that the tables can fill, lang, split and eligible.

    Without labels (for what reads none of is_kev, is_rejected and eligible) no text is shuffled to join them, unless a
    document has several rows of labels and so is several rows here.
    """
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    labels = read(spark, sf_dir, "labels")
    if labelled or not labels.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        rows = docs.join(labels, "doc_id", "left")
    else:
        rows = docs.withColumns({c: F.lit(None).cast("int") for c in ("quality", "toxic")})
    day = F.date_add(F.lit("2020-01-01").cast("date"), ((F.col("doc_id") * 37) % 2450).cast("int"))
    status = F.element_at(F.array(*map(F.lit, ["multi", "none", "placeholder_only"])), (F.col("doc_id") % 10 + 1).cast("int"))
    rows = rows.select(
        F.col("doc_id").alias("ord"),
        F.format_string("CVE-2020-%07d", "doc_id").alias("cve_id"),
        F.date_format(day, "yyyy-MM-dd").alias("published"),
        F.when(F.col("lang") == "en", F.col("text")).otherwise("").alias("description_en"),
        text_hash(F.col("text")).alias("description_norm_hash"),
        label_at(F.substring("source", 4, 9).cast("int")).alias("cwe_id"),
        F.when(F.col("doc_id") % 10 < 3, status).otherwise("single").alias("label_status"),
        (F.coalesce("quality", F.lit(0)) == 1).alias("is_kev"),
        (F.coalesce("toxic", F.lit(0)) == 1).alias("is_rejected"),
    )
    return rows.withColumns({"split": split_of(F.col("published"), DEFAULTS["splits"], DEFAULTS["snapshot_date"]), "eligible": eligible(F.col("is_rejected"), F.col("description_en"), F.col("label_status"))})


_LIST = ", ".join(f"'{x}'" for x in LABELS)
RECORDS_SQL = rf"""
rec0 AS (
  SELECT d.doc_id AS ord, printf('CVE-2020-%07d', d.doc_id) AS cve_id,
    strftime(DATE '2020-01-01' + CAST((d.doc_id * 37) % 2450 AS INTEGER), '%Y-%m-%d') AS published,
    CASE WHEN lang = 'en' THEN text ELSE '' END AS description_en,
    sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS description_norm_hash,
    ([{_LIST}])[CAST(substr(source, 4) AS INTEGER) % 20 + 1] AS cwe_id,
    CASE d.doc_id % 10 WHEN 0 THEN 'multi' WHEN 1 THEN 'none' WHEN 2 THEN 'placeholder_only' ELSE 'single' END AS label_status,
    coalesce(quality, 0) = 1 AS is_kev, coalesce(toxic, 0) = 1 AS is_rejected
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
), rec AS (
  SELECT *, CASE WHEN published BETWEEN '2020-01-01' AND '2024-12-31' THEN 'train' WHEN published BETWEEN '2025-01-01' AND '2025-12-31' THEN 'val'
      WHEN published BETWEEN '2026-01-01' AND '2026-09-17' THEN 'test' END AS split,
    NOT is_rejected AND length(description_en) > 0 AND label_status = 'single' AS eligible
  FROM rec0
)"""
#: The selected labels and the eligible rows that have one.
POPULATION_SQL = (
    RECORDS_SQL
    + """, sel AS (
  SELECT * FROM (SELECT cwe_id, count(*) AS train_count, row_number() OVER (ORDER BY count(*) DESC, cwe_id) AS rank
    FROM rec WHERE eligible AND split = 'train' GROUP BY cwe_id) WHERE rank <= 15 AND train_count >= 3
), pop AS (SELECT * FROM rec WHERE eligible AND split IS NOT NULL AND cwe_id IN (SELECT cwe_id FROM sel))"""
)


def _outputs(step: int, shift: int) -> F.Column:
    """The raw output of a row: one of 10 values in one of 6 wrappers, by the two digits of a number of the row."""
    g, x = F.col("gold"), F.col("ord") * step + shift
    other, digits = label_at(F.col("ord") + 7), F.substring("gold", 5, 9)
    say = lambda *parts: F.concat(*(p if isinstance(p, F.Column) else F.lit(p) for p in parts))
    pick = lambda place, of: F.element_at(F.array(*of), (place + 1).cast("int"))
    values = [say('"', g, '"'), digits, say('"', F.lower(F.replace(g, F.lit("-"), F.lit(" "))), '"'), say('"', other, '"'), F.lit('"CWE-77777"'), say('"', g, " and ", other, '"'), say('["', g, '"]'), F.lit("true"), F.lit(LONG), F.lit(f"{LONG}.0")]
    value = pick(F.floor(x / 6) % 10, values)
    under = lambda key: say(f'{{"{key}": ', value, "}")
    wrappers = [under("cwe_id"), say("```json\n", under("cwe_id"), "\n```"), say("<think>so</think> ", under("cwe_id")), say("The label is ", under("cwe_id"), "."), under("class"), value]
    return pick(x % 6, wrappers)


#: A whole number beyond 64 bits, and beyond what a decimal holds.
LONG = "1234567890" * 5
RUNS = {"base": (1, 0), "tuned": (7, 3)}


def predictions(spark: SparkSession, sf_dir: str, model: str, split: str | None = None) -> DataFrame:
    """ord, cve_id, gold, description, is_kev and raw_output of one run, on the rows of one split or on all."""
    rows = records(spark, sf_dir)
    rows = (rows if split is None else rows.where(F.col("split") == split)).select("ord", "cve_id", F.col("cwe_id").alias("gold"), F.col("description_en").alias("description"), "is_kev")
    return rows.withColumn("raw_output", _outputs(*RUNS[model]))


def _predictions_sql(model: str) -> str:
    step, shift = RUNS[model]
    allowed = ", ".join(f"'{x}'" for x in ALLOWED)
    return f"""
{model}0 AS (
  SELECT ord, cve_id, cwe_id AS gold, description_en AS description, is_kev, (ord * {step} + {shift}) % 6 AS wrapper, (ord * {step} + {shift}) // 6 % 10 AS form, ([{_LIST}])[(ord + 7) % 20 + 1] AS other FROM rec
), {model}1 AS (
  SELECT *, CASE WHEN wrapper > 3 THEN NULL WHEN form < 3 THEN gold WHEN form = 3 THEN other WHEN form = 4 THEN 'CWE-77777' WHEN form = 8 THEN 'CWE-{LONG}' END AS pred, wrapper <> 5 AS valid_json, wrapper < 4 AS has_key FROM {model}0
), {model} AS (
  SELECT *, coalesce(pred IN ({allowed}), false) AS valid_label, coalesce(pred IN ({allowed}) AND pred = gold, false) AS exact_match FROM {model}1
), {model}_flags AS (
  SELECT ord, unnest(list_filter([CASE wrapper WHEN 2 THEN 'think_block_present' WHEN 4 THEN 'missing_key' WHEN 5 THEN 'not_json' END,
    CASE WHEN has_key AND form IN (5, 6) THEN 'multiple_cwe' WHEN has_key AND form IN (7, 9) THEN 'bad_cwe_format' END,
    CASE WHEN pred IS NOT NULL AND NOT valid_label THEN 'label_not_allowed' END], lambda x: x IS NOT NULL)) AS flag FROM {model}
)"""


PREDICTIONS_SQL = RECORDS_SQL + "," + _predictions_sql("base") + "," + _predictions_sql("tuned")
