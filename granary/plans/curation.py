"""Queries of the curation side, by name, and their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions.text import char_grams, excerpt, folded, four_places, jaccard, once, redacted_excerpt, table_cell, text_hash, token_len
from ..operators import canonical as can
from ..operators import curate, digest, export, sample, similarity, stats
from ..sources import tables
from ..sources.pages import date_windows, windows_by_function
from ..sources.tables import POPULATION_SQL, RECORDS_SQL, read, records
from ..streaming.incremental import GAP, GAPS, sessions

Q, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def labels_of(rows: DataFrame) -> DataFrame:
    return curate.select_labels(rows.where("eligible AND split = 'train'"), DEFAULTS["labels"]["top_k"], DEFAULTS["labels"]["min_count"])


def population(rows: DataFrame) -> DataFrame:
    return curate.with_labels(rows.where("eligible AND split IS NOT NULL"), labels_of(rows))


CURATED_SQL = (
    POPULATION_SQL
    + """, first_train AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY description_norm_hash ORDER BY published, cve_id) AS k FROM pop WHERE split = 'train') WHERE k = 1
), kept AS (
  SELECT ord, cve_id, cwe_id, published, description_en, description_norm_hash, is_kev, split FROM first_train WHERE description_norm_hash NOT IN (SELECT description_norm_hash FROM pop WHERE split IN ('val', 'test'))
  UNION ALL SELECT ord, cve_id, cwe_id, published, description_en, description_norm_hash, is_kev, split FROM pop WHERE split = 'val' AND description_norm_hash NOT IN (SELECT description_norm_hash FROM pop WHERE split IN ('train', 'test'))
  UNION ALL SELECT ord, cve_id, cwe_id, published, description_en, description_norm_hash, is_kev, split FROM pop WHERE split = 'test'
)"""
)


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.curated(population(records(spark, sf_dir)), DEFAULTS["dedup"])


@query(f"WITH {CURATED_SQL} SELECT split, cwe_id, count(*) AS n FROM kept GROUP BY ALL")
def flagship_class_distribution(spark, sf_dir):
    return stats.class_distribution(kept(spark, sf_dir))


@query(f"WITH {CURATED_SQL} SELECT split, cwe_id, count(*) AS n FROM kept GROUP BY CUBE (split, cwe_id)")
def class_distribution_cube(spark, sf_dir):
    return stats.class_cube(kept(spark, sf_dir))


@query(r"SELECT doc_id, sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS content FROM documents")
def content_hash(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text_hash(F.col("text")).alias("content"))


@query(f"WITH {RECORDS_SQL} SELECT cve_id, published FROM (SELECT *, row_number() OVER (PARTITION BY description_norm_hash ORDER BY published, cve_id) AS k FROM rec) WHERE k = 1")
def exact_duplicates_first_wins(spark, sf_dir):
    return curate.first_wins(records(spark, sf_dir)).select("cve_id", "published")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def keyed_last_wins(spark, sf_dir):
    return can.last_wins(read(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query(f"WITH {RECORDS_SQL} SELECT coalesce(split, 'none') AS split, count(*) AS n, min(published) AS first, max(published) AS last FROM rec GROUP BY ALL")
def temporal_split_counts(spark, sf_dir):
    return records(spark, sf_dir).groupBy(F.coalesce("split", F.lit("none")).alias("split")).agg(F.count(F.lit(1)).alias("n"), F.min("published").alias("first"), F.max("published").alias("last"))


@query(f"WITH {POPULATION_SQL} SELECT rank, cwe_id, train_count FROM sel")
def label_topk_having(spark, sf_dir):
    return labels_of(records(spark, sf_dir))


@query(
    f"""WITH {POPULATION_SQL} SELECT split, count(*) AS eligible, count(*) FILTER (cwe_id IN (SELECT cwe_id FROM sel)) AS in_selected,
    count(*) FILTER (cwe_id IN (SELECT cwe_id FROM sel)) / count(*) AS fraction FROM rec WHERE eligible AND split IS NOT NULL GROUP BY split"""
)
def label_coverage(spark, sf_dir):
    rows = records(spark, sf_dir)
    return stats.coverage(rows, labels_of(rows))


@query(
    f"""WITH {RECORDS_SQL} SELECT count(*) AS records, count(*) FILTER (is_rejected) AS rejected, count(*) FILTER (length(description_en) = 0) AS without_description,
    count(*) FILTER (label_status = 'none') AS no_label, count(*) FILTER (label_status = 'placeholder_only') AS placeholder_only, count(*) FILTER (label_status = 'multi') AS multi_label,
    count(*) FILTER (label_status = 'single') AS single_label, count(*) FILTER (eligible) AS eligible FROM rec"""
)
def funnel_counts(spark, sf_dir):
    return stats.funnel(records(spark, sf_dir))


@query(f"WITH {RECORDS_SQL} SELECT substr(published, 1, 4) AS year, count(*) AS total, count(*) FILTER (label_status = 'single') AS single_label FROM rec GROUP BY 1")
def per_year_rollup(spark, sf_dir):
    return stats.per_year(records(spark, sf_dir))


@query(f"WITH {RECORDS_SQL} SELECT split, label_status, count(*) AS n FROM rec WHERE split IS NOT NULL GROUP BY ALL")
def status_by_split(spark, sf_dir):
    return stats.status_by_split(records(spark, sf_dir))


@query(f"WITH {RECORDS_SQL} SELECT cwe_id, count(*) AS n FROM rec WHERE eligible AND split = 'train' GROUP BY 1 ORDER BY n DESC, cwe_id LIMIT 50")
def label_frequency_top50(spark, sf_dir):
    return stats.label_frequency(records(spark, sf_dir))


_PERCENTILES = "CAST(trunc(quantile_cont(v, {})) AS INTEGER) AS p{}"


@query(
    "SELECT lang, "
    + ", ".join(_PERCENTILES.format(q, n) for q, n in ((0.5, 50), (0.9, 90), (0.99, 99)))
    + ", CAST(max(v) AS INTEGER) AS max FROM (SELECT lang, length(text) AS v FROM documents) GROUP BY lang"
)
def length_percentiles(spark, sf_dir):
    return stats.percentiles(read(spark, sf_dir, "documents"), F.length("text"), "lang")


@query(
    "SELECT lang, "
    + ", ".join(_PERCENTILES.format(q, n) for q, n in ((0.5, 50), (0.95, 95), (0.99, 99)))
    + r", CAST(max(v) AS INTEGER) AS max, count(*) FILTER (v > 480) AS over_480, count(*) FILTER (v > 1536) AS over_1536 FROM (SELECT lang, len(regexp_extract_all(text, '\S+')) AS v FROM documents) GROUP BY lang"
)
def token_summary(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("lang", F.regexp_count("text", F.lit(r"\S+")).alias("tokens"))
    return stats.token_summary(rows, "tokens", "lang")


@query(f"WITH {RECORDS_SQL} SELECT split, count(*) FILTER (is_kev) AS kev, count(*) AS n FROM rec WHERE split IS NOT NULL GROUP BY split")
def kev_counts(spark, sf_dir):
    return stats.kev_counts(records(spark, sf_dir).where("split IS NOT NULL"))


@query(
    f"""WITH {POPULATION_SQL} SELECT split, count(*) FILTER (label_status = 'placeholder_only') AS placeholder_only, count(*) FILTER (label_status = 'multi') AS multi_label,
    count(*) FILTER (label_status = 'single' AND cwe_id NOT IN (SELECT cwe_id FROM sel)) AS single_outside_selected FROM rec WHERE split IS NOT NULL GROUP BY split"""
)
def exclusion_counts(spark, sf_dir):
    rows = records(spark, sf_dir)
    return stats.exclusions(rows, labels_of(rows))


@query(f"WITH {RECORDS_SQL} SELECT coalesce(sum(n - 1), 0)::BIGINT AS duplicate_rows, count(*) AS duplicated_contents FROM (SELECT count(*) AS n FROM rec GROUP BY description_norm_hash HAVING n > 1)")
def internal_duplicates(spark, sf_dir):
    return stats.internal_duplicates(records(spark, sf_dir))


@query(
    f"""WITH {RECORDS_SQL} SELECT a.ord, a.cve_id, b.other_id FROM rec a JOIN (SELECT description_norm_hash, arg_max(cve_id, ord) AS other_id FROM rec WHERE split = 'test' GROUP BY 1) b
    USING (description_norm_hash) WHERE a.split = 'train'"""
)
def overlap_rows(spark, sf_dir):
    rows = records(spark, sf_dir)
    return curate.overlap(rows.where("split = 'train'"), rows.where("split = 'test'"), "description_norm_hash")


_GUARD = (
    RECORDS_SQL
    + """, firsts AS (SELECT split, 'cve_id' AS kind, cve_id AS key, arg_min(cve_id, ord) AS id FROM rec WHERE split IS NOT NULL GROUP BY ALL
  UNION ALL SELECT split, 'text_hash', description_norm_hash, arg_min(cve_id, ord) FROM rec WHERE split IS NOT NULL GROUP BY ALL),
 shared AS (SELECT a.split AS "left", b.split AS "right", a.kind, a.key, a.id AS left_id, b.id AS right_id FROM firsts a JOIN firsts b ON a.kind = b.kind AND a.key = b.key
  AND (a.split, b.split) IN (('train', 'val'), ('train', 'test'), ('val', 'test')))"""
)


@query(f"WITH {_GUARD} SELECT * FROM shared")
def guard_shared_keys(spark, sf_dir):
    rows = records(spark, sf_dir).where("split IS NOT NULL")
    return curate.shared_keys(rows.withColumn("text_hash", curate.hash_of(rows)))


@query(f'WITH {_GUARD} SELECT "left", "right", kind, count(*) AS n FROM shared GROUP BY ALL')
def overlap_distinct_keys(spark, sf_dir):
    rows = records(spark, sf_dir).where("split IS NOT NULL")
    return curate.shared_keys(rows.withColumn("text_hash", F.col("description_norm_hash"))).groupBy("left", "right", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {RECORDS_SQL} SELECT cve_id FROM rec WHERE split = 'train' AND description_norm_hash NOT IN (SELECT description_norm_hash FROM rec WHERE split IN ('val', 'test'))")
def leakage_drop_train(spark, sf_dir):
    rows = records(spark, sf_dir)
    return curate.without_overlap(rows.where("split = 'train'"), rows.where("split = 'val'"), rows.where("split = 'test'")).select("cve_id")


@query(f"WITH {RECORDS_SQL} SELECT cve_id FROM rec WHERE split = 'val' AND description_norm_hash NOT IN (SELECT description_norm_hash FROM rec WHERE split IN ('train', 'test'))")
def leakage_drop_val(spark, sf_dir):
    rows = records(spark, sf_dir)
    return curate.without_overlap(rows.where("split = 'val'"), rows.where("split = 'train'"), rows.where("split = 'test'")).select("cve_id")


@query(f"WITH {RECORDS_SQL} SELECT cve_id FROM rec WHERE split IN ('train', 'val') UNION SELECT cve_id FROM rec WHERE split = 'test'")
def split_union(spark, sf_dir):
    rows = records(spark, sf_dir)
    return rows.where("split IN ('train', 'val')").select("cve_id").union(rows.where("split = 'test'").select("cve_id")).distinct()


@query(f"WITH {RECORDS_SQL} SELECT description_norm_hash AS key FROM rec WHERE split = 'train' INTERSECT SELECT description_norm_hash FROM rec WHERE split = 'test'")
def split_intersect(spark, sf_dir):
    rows = records(spark, sf_dir).select("split", F.col("description_norm_hash").alias("key"))
    return rows.where("split = 'train'").select("key").intersect(rows.where("split = 'test'").select("key"))


@query(f"WITH {RECORDS_SQL} SELECT description_norm_hash AS key FROM rec WHERE split = 'test' EXCEPT SELECT description_norm_hash FROM rec WHERE split = 'train'")
def split_except(spark, sf_dir):
    rows = records(spark, sf_dir).select("split", F.col("description_norm_hash").alias("key"))
    return rows.where("split = 'test'").select("key").subtract(rows.where("split = 'train'").select("key"))


_PROMPT = export.PROMPT.format(label_lines=export.label_lines(tables.ALLOWED), description="\0").replace("'", "''").split("\0")


@query(
    f"""WITH {CURATED_SQL} SELECT cve_id, cwe_id, published, substr(description_en, 1, 1500) AS description, length(description_en) > 1500 AS truncated,
    '{_PROMPT[0]}' || substr(description_en, 1, 1500) || '{_PROMPT[1]}' AS prompt, '{{"cwe_id": "' || cwe_id || '"}}' AS completion, is_kev, split FROM kept"""
)
def export_rows(spark, sf_dir):
    return export.export_rows(kept(spark, sf_dir), tables.ALLOWED, DEFAULTS["export"]["max_chars"])


@query(f"WITH {POPULATION_SQL} SELECT sha256('{export.PROMPT.replace("'", "''")}' || chr(10) || string_agg(cwe_id, chr(10) ORDER BY rank)) AS sha256 FROM sel")
def prompt_digest(spark, sf_dir):
    return export.prompt_digest(spark, labels_of(records(spark, sf_dir)))


_DIGEST_COLUMNS = ("cve_id", "cwe_id", "description_norm_hash")


@query(f"WITH {CURATED_SQL}, {digest.tree_digest_sql('kept', 'split', _DIGEST_COLUMNS)} FROM tree")
def split_digests(spark, sf_dir):
    return digest.tree_digest(kept(spark, sf_dir), "split", *_DIGEST_COLUMNS)


@query(f"WITH {CURATED_SQL}, {digest.tree_digest_sql('kept', 'split', _DIGEST_COLUMNS)} SELECT sha256(string_agg(sha256, '' ORDER BY CASE split WHEN 'train' THEN 1 WHEN 'val' THEN 2 ELSE 3 END)) AS sha256 FROM tree")
def dataset_digest(spark, sf_dir):
    return export.dataset_hash(split_digests(spark, sf_dir))


@query(f"WITH {digest.tree_digest_sql('documents', 'lang', ('doc_id', 'text'))} FROM tree")
def document_digests(spark, sf_dir):
    return digest.tree_digest(read(spark, sf_dir, "documents"), "lang", "doc_id", "text")


@query(f"WITH {CURATED_SQL} SELECT cve_id, row_number() OVER (ORDER BY sha256('42:' || cve_id)) AS draw_rank FROM kept WHERE split = 'train' ORDER BY sha256('42:' || cve_id) LIMIT 100")
def natural_sample(spark, sf_dir):
    return sample.natural(kept(spark, sf_dir).where("split = 'train'"), 100, 42).select("cve_id", "draw_rank")


@query(f"WITH {CURATED_SQL} SELECT * FROM (SELECT cwe_id, cve_id, row_number() OVER (PARTITION BY cwe_id ORDER BY sha256('42:' || cve_id)) AS draw_rank FROM kept WHERE split = 'train') WHERE draw_rank <= 5")
def balanced_sample(spark, sf_dir):
    return sample.balanced(kept(spark, sf_dir).where("split = 'train'"), 5, None, 42).select("cwe_id", "cve_id", "draw_rank")


@query(
    f"""WITH {CURATED_SQL}, classes AS (SELECT cwe_id, count(*) AS n FROM kept WHERE split = 'train' GROUP BY 1),
    base AS (SELECT *, greatest(1, floor(share))::BIGINT AS p FROM (SELECT *, (60 * n)::DOUBLE / sum(n) OVER () AS share FROM classes)), m AS (SELECT 60 - sum(p) AS missing FROM base),
    more AS (SELECT cwe_id, row_number() OVER (ORDER BY share - p DESC, cwe_id DESC) AS r FROM base WHERE p < n),
    less AS (SELECT cwe_id, row_number() OVER (ORDER BY share - p + k, cwe_id DESC) AS r FROM (SELECT *, unnest(range(p - 1)) AS k FROM base)),
    places AS (SELECT cwe_id, p + (SELECT count(*) FROM more, m WHERE more.cwe_id = base.cwe_id AND r <= missing) - (SELECT count(*) FROM less, m WHERE less.cwe_id = base.cwe_id AND r <= -missing) AS places FROM base)
    SELECT cwe_id, cve_id, draw_rank FROM (SELECT cwe_id, cve_id, row_number() OVER (PARTITION BY cwe_id ORDER BY sha256('42:' || cve_id), cve_id) AS draw_rank FROM kept WHERE split = 'train') JOIN places USING (cwe_id) WHERE draw_rank <= places"""
)
def stratified_sample(spark, sf_dir):
    return sample.stratified(kept(spark, sf_dir).where("split = 'train'"), 60, 42).select("cwe_id", "cve_id", "draw_rank")


@query()
def exact_sample(spark, sf_dir):
    return sample.exact_sample(kept(spark, sf_dir).where("split = 'train'"), 100, 42).select("draw_rank", "cve_id")


@query("SELECT CAST(first AS DATE) AS first, least(CAST(first AS DATE) + 118, DATE '2026-09-17') AS last FROM generate_series(DATE '2020-01-01', DATE '2026-09-17', INTERVAL 119 DAY) t(first)")
def fetch_windows(spark, sf_dir):
    return date_windows(spark, DEFAULTS["start_date"], DEFAULTS["snapshot_date"], DEFAULTS["window_days"])


@query(
    r"""SELECT doc_id, CASE WHEN length(f) <= 80 THEN f ELSE substr(f, 1, 79) || '…' END AS excerpt, replace(CASE WHEN length(f) <= 80 THEN f ELSE rtrim(substr(f, 1, 79)) || '…' END, '|', '\|') AS cell,
    CASE WHEN length(text) <= 200 THEN c ELSE substr(c, 1, 199) || '…' END AS redacted
    FROM (SELECT doc_id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS f, regexp_replace(text, '(?i)th\w*', '[word omitted]', 'g') AS c FROM documents)"""
)
def excerpts(spark, sf_dir):
    t = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", excerpt(t, 80).alias("excerpt"), table_cell(t, 80).alias("cell"), redacted_excerpt(t, 200, r"(?i)th\w*").alias("redacted"))


@query("SELECT event_id, printf('%.4f', value) AS plain, printf('%+.4f', value) AS signed FROM events")
def number_formats(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", four_places(F.col("value")).alias("plain"), four_places(F.col("value"), True).alias("signed"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def props_json_extract(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    from ..streaming.incremental import event_windows as windows

    return windows(read(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


_GAP = "CASE event_type " + " ".join(f"WHEN '{k}' THEN INTERVAL '{v}'" for k, v in GAPS.items()) + f" ELSE INTERVAL '{GAP}' END"


@query(
    f"""WITH e AS (SELECT user_id, ts, ts + {_GAP} AS upto, value FROM events WHERE ts IS NOT NULL),
    b AS (SELECT *, coalesce(ts > max(upto) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INT AS begins FROM e),
    s AS (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS place FROM b)
    SELECT user_id, min(ts) AS session_start, max(upto) AS session_end, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, place"""
)
def session_windows(spark, sf_dir):
    return sessions(read(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query("SELECT doc_id, item_id FROM documents, benchmark WHERE contains(documents.text, benchmark.text)")
def benchmark_containment(spark, sf_dir):
    return similarity.containment(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_GRAMS = "CASE WHEN length({0}) < 5 THEN [] ELSE list_distinct(list_transform(range(1, length({0}) - 3), lambda i: substr({0}, i, 5))) END"


@query(
    rf"""WITH p AS (SELECT a.doc_id, replace(trim(regexp_replace(lower(a.text), '\s+', ' ', 'g')), 'ß', 'ss') AS x, replace(trim(regexp_replace(lower(b.text), '\s+', ' ', 'g')), 'ß', 'ss') AS y
      FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1),
    g AS (SELECT doc_id, {_GRAMS.format("x")} AS gx, {_GRAMS.format("y")} AS gy FROM p)
    SELECT doc_id, round(CASE WHEN len(gx) + len(gy) = 0 THEN 1.0 ELSE len(list_intersect(gx, gy)) / (len(gx) + len(gy) - len(list_intersect(gx, gy))) END, 9) AS jaccard FROM g"""
)
def char5_jaccard(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    pairs = docs.alias("a").join(docs.alias("b"), F.expr("b.doc_id = a.doc_id + 1"))
    pairs = pairs.select("a.doc_id", folded(F.col("a.text")).alias("x"), folded(F.col("b.text")).alias("y"))
    pairs = once(once(pairs, fx=F.col("x"), fy=F.col("y")), gx=char_grams(F.col("fx")), gy=char_grams(F.col("fy")))
    return pairs.select("doc_id", F.round(jaccard(F.col("gx"), F.col("gy")), 9).alias("jaccard"))


@query(
    """WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
    SELECT vec_id, round(list_dot_product(e, f) / sqrt(list_dot_product(e, e) * list_dot_product(f, f)), 6) AS cosine FROM q JOIN (SELECT vec_id - 1 AS vec_id, e AS f FROM q) USING (vec_id)"""
)
def dense_cosine(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings")
    pairs = rows.alias("a").join(rows.alias("b"), F.expr("b.vec_id = a.vec_id + 1"))
    return pairs.select("a.vec_id", F.round(similarity.dense_cosine(F.col("a.embedding"), F.col("b.embedding")), 6).alias("cosine"))


@query(f"WITH {POPULATION_SQL}, kinds AS (SELECT rank, cwe_id, count(*) OVER () AS k FROM sel) SELECT rank, cwe_id, CASE WHEN k < 3 OR rank > k - k // 3 THEN 'tail' ELSE 'head' END AS tier FROM kinds")
def label_tiers(spark, sf_dir):
    return stats.label_tiers(labels_of(records(spark, sf_dir)))


@query(
    f"""WITH {POPULATION_SQL}, keys AS (SELECT split, 'cve_id' AS kind, cve_id AS key FROM pop UNION ALL SELECT split, 'description_norm_hash', description_norm_hash FROM pop),
    pairs AS (SELECT unnest([{{'l': 'train', 'r': 'val'}}, {{'l': 'train', 'r': 'test'}}, {{'l': 'val', 'r': 'test'}}], recursive := true), unnest(['cve_id', 'description_norm_hash']) AS kind),
    six AS (SELECT DISTINCT p.l, p.r, k.kind FROM (SELECT DISTINCT l, r FROM pairs WHERE l IS NOT NULL) p, (SELECT DISTINCT kind FROM pairs WHERE kind IS NOT NULL) k)
    SELECT l AS "left", r AS "right", six.kind, count(a.key) FILTER (EXISTS (SELECT 1 FROM keys b WHERE b.split = r AND b.kind = a.kind AND b.key = a.key)) AS n
    FROM six LEFT JOIN keys a ON a.split = l AND a.kind = six.kind GROUP BY ALL"""
)
def contamination_counts(spark, sf_dir):
    return curate.contamination_counts(population(records(spark, sf_dir)))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[^ \t\n\r\f\v]+')) AS tokens FROM documents")
def token_lengths(spark, sf_dir):
    """By a tokenizer plugged in as a Python function of a batch of texts."""
    count = token_len(lambda texts: [len(re.findall(r"[^ \t\n\r\f\v]+", t)) for t in texts])
    return read(spark, sf_dir, "documents").select("doc_id", count(F.col("text")).alias("tokens"))


@query("SELECT doc_id, doc_id // 64 AS batch, doc_id % 64 AS place FROM documents")
def generation_batches(spark, sf_dir):
    return export.batched(read(spark, sf_dir, "documents").select("doc_id"), 64, "doc_id")


@query(SQL["fetch_windows"])
def fetch_windows_function(spark, sf_dir):
    """The windows by the table function."""
    return windows_by_function(spark, DEFAULTS["start_date"], DEFAULTS["snapshot_date"], DEFAULTS["window_days"])


# The raw side: pages' records made from the documents, their canonical form, and lines with faults for the validator.


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw record for each document; what it holds besides the text is set by its id."""
    i = F.col("doc_id")
    day = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), ((i * 37) % 2450).cast("int")), "yyyy-MM-dd")
    said = lambda *values: F.array(*(F.struct(F.lit("en").alias("lang"), v.alias("value")) for v in values))
    weak = lambda kind, *values: F.struct(F.lit(kind).alias("type"), said(*values).alias("description"))
    one, two = tables.label_at(i), tables.label_at(i + 3)
    shapes = [F.array(), F.array(weak("Primary", one)), F.array(weak("Primary", one), weak("Secondary", two)), F.array(weak("Primary", F.lit("NVD-CWE-noinfo"))), F.array(weak("Secondary", F.concat(F.lit(" "), one, F.lit(" ")), F.lit("junk"))), F.lit(None)]
    weaknesses = F.element_at(F.array(*(s.cast("array<struct<type:string,description:array<struct<lang:string,value:string>>>>") for s in shapes)), (i % 6 + 1).cast("int"))
    score = F.struct(F.array(F.struct(F.struct(((i % 100) / 10).alias("baseScore"), F.lit("HIGH").alias("baseSeverity")).alias("cvssData"))).alias("cvssMetricV31"))
    return read(spark, sf_dir, "documents").select(
        i,
        F.when(i % 17 == 0, F.concat(F.lit("CVE-20-"), i)).otherwise(F.format_string("CVE-2020-%07d", i)).alias("id"),
        F.concat(day, F.lit("T00:00:00.000")).alias("published"),
        F.concat(day, F.lit("T10:30:00.000")).alias("lastModified"),
        F.when(i % 13 == 0, "Rejected").otherwise("Analyzed").alias("vulnStatus"),
        F.when(i % 9 == 0, day).alias("cisaExploitAdd"),
        F.array(F.struct("lang", F.col("text").alias("value"))).alias("descriptions"),
        weaknesses.alias("weaknesses"),
        F.when(i % 2 == 0, score).alias("metrics"),
    )


_CANONICAL_SQL = rf"""
one AS (SELECT *, doc_id % 6 AS w, strftime(DATE '2020-01-01' + CAST((doc_id * 37) % 2450 AS INTEGER), '%Y-%m-%d') AS day,
  ([{tables._LIST}])[doc_id % 20 + 1] AS l1, ([{tables._LIST}])[(doc_id + 3) % 20 + 1] AS l2, CASE WHEN lang = 'en' THEN regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') ELSE '' END AS said
  FROM documents WHERE doc_id % 17 <> 0),
can AS (SELECT doc_id, printf('CVE-2020-%07d', doc_id) AS cve_id, day AS published, day || 'T10:30:00.000' AS last_modified, CASE WHEN doc_id % 13 = 0 THEN 'Rejected' ELSE 'Analyzed' END AS vuln_status,
  said AS description_en, sha256(trim(regexp_replace(lower(said), '\s+', ' ', 'g'))) AS description_norm_hash,
  CASE WHEN w IN (1, 2) THEN l1 ELSE '' END AS cwe_primary, CASE w WHEN 2 THEN l2 WHEN 4 THEN l1 ELSE '' END AS cwe_secondary,
  CASE WHEN w IN (1, 4) THEN l1 WHEN w = 2 THEN least(l1, l2) || ',' || greatest(l1, l2) ELSE '' END AS cwe_all, w = 3 AS placeholder_only, CASE WHEN w IN (1, 4) THEN l1 END AS cwe_id,
  CASE w WHEN 2 THEN 'multi' WHEN 1 THEN 'single' WHEN 4 THEN 'single' WHEN 3 THEN 'placeholder_only' ELSE 'none' END AS label_status,
  CASE WHEN doc_id % 2 = 0 THEN (doc_id % 100) / 10 END AS cvss_v31_base_score, CASE WHEN doc_id % 2 = 0 THEN 'HIGH' END AS cvss_v31_severity,
  doc_id % 9 = 0 AS is_kev, CASE WHEN doc_id % 9 = 0 THEN day END AS kev_date_added, doc_id % 13 = 0 OR starts_with(said, '** REJECT **') AS is_rejected FROM one)"""


@query(f"WITH {_CANONICAL_SQL} SELECT * FROM can")
def canonical_from_pages(spark, sf_dir):
    """The lists are joined by commas, for the comparison."""
    out = can.canonical(raw_records(spark, sf_dir), DEFAULTS["placeholders"], False, ("doc_id",))
    return out.withColumns({c: F.array_join(c, ",") for c in ("cwe_primary", "cwe_secondary", "cwe_all")})


def faulty_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and value: canonical records as JSON lines, each with the fault that its id sets, or none."""
    rows = can.canonical(raw_records(spark, sf_dir), DEFAULTS["placeholders"], False, ("doc_id",))
    rows = once(rows.select("doc_id", F.to_json(F.struct(*can.COLUMNS), {"ignoreNullFields": "false"}).alias("_json")), line=F.col("_json"))
    line = F.col("line")
    put = lambda pattern, new: F.regexp_replace(line, pattern, new)
    faults = [
        line, put('"vuln_status":"[A-Za-z]+"', '"vuln_status":5'), put('"is_kev":(true|false)', '"is_kev":"x"'), put(r'"cwe_all":\[[^\]]*\]', '"cwe_all":"no"'), put(r'"cwe_primary":\[[^\]]*\]', '"cwe_primary":["bad"]'),
        put('"published":"', '"published":"x'), F.concat(F.lit("{"), line), F.lit("[1]"), put('"is_rejected":(true|false)', '"rejected":true'), put('"label_status":"[a-z_]+"', '"label_status":"other"'),
        put('"description_norm_hash":"', '"description_norm_hash":"0'), put(r'"cwe_all":\[[^\]]*\]', '"cwe_all":["CWE-2","CWE-1"]'), put(r'"cwe_all":\[[^\]]*\]', '"cwe_all":["bad",null]'),
        F.concat(line, F.lit(" trailing")), F.concat(line, F.lit(" "), line), F.lit("[1] x"), F.lit('{"a": 1}{'), put('"is_kev":', '"is_kev":"first","is_kev":'), put('"cvss_v31_base_score":[^,}]*', '"cvss_v31_base_score":NaN'),
    ]
    return rows.select("doc_id", F.element_at(F.array(*faults), (F.col("doc_id") % len(faults) + 1).cast("int")).alias("value"))


@query(
    f"""WITH {_CANONICAL_SQL} SELECT doc_id, unnest(list_filter(CASE doc_id % 19
      WHEN 13 THEN ['invalid_json'] WHEN 14 THEN ['invalid_json'] WHEN 15 THEN ['invalid_json'] WHEN 16 THEN ['invalid_json'] WHEN 1 THEN ['invalid_type:vuln_status'] WHEN 2 THEN ['invalid_type:is_kev'] WHEN 3 THEN ['invalid_type:cwe_all', CASE WHEN cwe_id IS NOT NULL THEN 'inconsistent_cwe_id' END]
      WHEN 4 THEN ['invalid_cwe:cwe_primary'] WHEN 5 THEN ['invalid_published'] WHEN 6 THEN ['invalid_json'] WHEN 7 THEN ['record_not_object'] WHEN 8 THEN ['missing_field:is_rejected', 'invalid_type:is_rejected']
      WHEN 9 THEN ['invalid_label_status'] WHEN 10 THEN ['description_norm_hash_mismatch']
      WHEN 11 THEN ['cwe_all_not_sorted_unique', CASE WHEN cwe_id IS NOT NULL THEN 'inconsistent_cwe_id' END, CASE WHEN label_status <> 'multi' THEN 'inconsistent_label_status' END, CASE WHEN placeholder_only THEN 'inconsistent_placeholder_only' END]
      WHEN 12 THEN ['invalid_type:cwe_all', CASE WHEN cwe_id IS NOT NULL THEN 'inconsistent_cwe_id' END] ELSE [] END, lambda x: x IS NOT NULL)) AS problem FROM can"""
)
def validate_records(spark, sf_dir):
    return can.validate(faulty_lines(spark, sf_dir)).select("doc_id", F.explode("problems").alias("problem"))
