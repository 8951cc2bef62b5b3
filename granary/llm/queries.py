"""The registered queries of this subpackage and the SQL that some of them are held against."""

from __future__ import annotations

import re

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, ctw, mixing, near, passages, quality, sharding, url_filter, variants, warc, whiten


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# 1: chat formatting

#: Fixed by the contract: a conversation whose texts are the template's control strings.
PROBE_TEXT = "</s>[INST] ok [/INST]"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.createDataFrame([(-7, 0, "user", PROBE_TEXT), (-7, 1, "assistant", PROBE_TEXT)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    done = chat.format_chats(rows).withColumns({"turns": chat.read_turns(F.col("formatted")), "learnt": chat.read_loss(F.col("segments"))})
    newline = F.lit("\n")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], newline, t["text"], newline)), "")
    return done.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


OP1_SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *,
    length(text) + length(regexp_replace(text, '[^\\]', '', 'g'))
      + len(regexp_extract_all(text, '<<SYS>>|<</SYS>>|<s>|</s>|\[INST\]|\[/INST\]|\[ROLE\]|\[/ROLE\]|\[/TURN\]'))
      + CASE role WHEN 'system' THEN 18 WHEN 'user' THEN 16 WHEN 'assistant' THEN 10
        ELSE 21 + length(role) + length(regexp_replace(role, '[^\\]', '', 'g'))
          + len(regexp_extract_all(role, '<<SYS>>|<</SYS>>|<s>|</s>|\[INST\]|\[/INST\]|\[ROLE\]|\[/ROLE\]|\[/TURN\]')) END AS chars,
    row_number() OVER w AS k, lag(role, 1, 'start') OVER w AS before
  FROM rows_ WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars,
  bool_and((before, role) IN (('start', 'system'), ('start', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user')))
    AND arg_max(role, k) = 'assistant' AS valid
FROM sized GROUP BY conv_id
"""

# 2: byte-level BPE


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_texts(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, ids=False)


# 3: approximate nearest neighbours


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


# 4: mixing sources


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


# 5: substring dedup


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.classed(table(spark, sf_dir, "documents"))
    words = lambda ranges: F.aggregate(ranges, F.lit(0).cast("long"), lambda s, r: s + r["to"] - r["from"])
    return found.select("doc_id", "class_id", "n_links", words("removed").alias("removed_words"), words("repeated").alias("repeated_words"), "removed")


# 6: quality rules


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    base = [F.col(f"stats.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judged.select("doc_id", *base, "base_failed", "kept", "rule")


# 7: LM scoring


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(table(spark, sf_dir, "documents"))


# 8: URL filters

#: Host rules as the contract gives them.
HOST_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
#: Words that filter lists hold, each in SHAPES, where it is a whole token: as the first or a later part of a host's label, a
#: folder, a query's key or value. Exceptions let pass what one of them would block.
TERMS = "ad ads adserver adult affiliate banner bets betting bonus cash casino cheap click clickbait counter coupon dating deals doorway farm free loan lottery pills pixel poker popup promo replica slots spam sponsor sweepstakes track tracker tracking viagra warez win xxx".split()
SHAPES = ["||{}.", "||{}-", "-{}.", "/{}/", "?{}=", "&{}=", "={}|", "={}&"]
EXCEPTIONS = ["||ads-track.*/en/*.html|", "||ads-track.*page=2&", "/ads/policy|"]
BLOCKED = ["||blog.*utm_source=feed|", "||m.*/de/*#top|"]
URL_RULES = [
    *(url_filter.Rule(text, action) for text, action in HOST_RULES),
    *(url_filter.Rule(shape.format(term), "block", pattern=True) for term in TERMS for shape in SHAPES),
    *(url_filter.Rule(text, "block", pattern=True) for text in BLOCKED),
    *(url_filter.Rule(text, "allow", pattern=True) for text in EXCEPTIONS),
]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)



def _like(rule: str) -> str:
    """A rule's regular expression in the other engine's words; none of these rules has a ^."""
    body, head, end = rule, "", rule.endswith("|")
    if body.startswith("||"):
        body, head = body[2:], r"\A[^/]*://([^/?#]*\.)?"
    pieces = [re.sub(r"[.?]", lambda m: "\\" + m[0], p) for p in body.removesuffix("|").split("*")]
    return head + ".*".join(pieces) + (r"\z" if end else "")


def _patterns_sql() -> str:
    """The pattern that decides: the longest of the allowing ones that fit, else of the blocking ones, ties to the first."""
    case = lambda rules: " ".join(f"WHEN regexp_matches(low, '(?s){_like(r)}') THEN '{r}'" for r in sorted(rules, key=lambda r: -len(r)))
    return f"CASE {case(EXCEPTIONS)} {case([*(shape.format(term) for term in TERMS for shape in SHAPES), *BLOCKED])} END"


OP8_SQL = r"""
WITH parts AS (
  SELECT page_id, coalesce(url, '') AS url,
    translate(regexp_extract(coalesce(url, ''), '(?s)\A.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)\A.*?://[^/?#]*([^?#]*)', 1) AS path,
    translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM pages
), fits AS (
  SELECT *,
    CASE WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
      WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
      WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
      WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
      WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/') THEN 'org/' END AS rule,
    PATTERNS AS pattern
  FROM parts
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN pattern IN (EXCEPTIONS) OR pattern IS NULL THEN 'allow' ELSE 'block' END AS verdict,
  CASE WHEN rule IS NULL THEN pattern END AS pattern
FROM fits
""".replace("PATTERNS", _patterns_sql()).replace("EXCEPTIONS", ", ".join(f"'{r}'" for r in EXCEPTIONS))

# 9: not-modified revisits

#: Seconds between changes of a section's content.
VERSION = 400_000


def page_records(pages: DataFrame) -> DataFrame:
    """Each page as a full response and a revisit of its section (scheme, host and first folder of its url).

    So records share URLs, as captures of an archive do. Times are set by page_id, to ten minutes; a section's content, and
    with it its entity tag, modification date and digest, changes every VERSION seconds. Some records lack validators.
    """
    p = F.col("page_id")
    section = F.regexp_extract("url", r"(?s)\A[^/]*//[^/]*/[^/?#]*", 0)
    at = F.floor(p * 7919 % 2_000_000 / 600) * 600
    again = at + p * 53 % 300_000 - 20_000
    version = lambda ts: F.floor(ts / VERSION).cast("string")
    digest = lambda ts: F.md5(F.concat_ws(" ", section, version(ts)).cast("binary"))
    tag = lambda ts: F.concat(F.lit('"'), digest(ts), F.lit('"'))
    heads = lambda kind, ts: F.create_map(F.lit("Content-Type"), F.lit("text/html" if kind == "response" else "text/plain"), F.lit("Date"), F.concat(F.lit(kind), p.cast("string")), F.lit("ETag"), tag(ts))
    response = pages.select(
        (2 * p).alias("record_id"), section.alias("url"), at.alias("ts"), F.lit("response").alias("kind"),
        F.when(p % 4 != 0, tag(at)).alias("etag"), F.when(p % 8 != 4, version(at)).alias("last_modified"), F.when(p % 16 != 12, digest(at)).alias("digest"), heads("response", at).alias("headers"),
    )
    revisit = pages.select(
        (2 * p + 1).alias("record_id"), F.concat(section, F.lit("#again")).alias("url"), again.alias("ts"), F.lit("revisit").alias("kind"),
        F.when(p % 7 == 0, F.lit('"other"')).when(p % 11 != 0, F.concat(F.lit("W/"), tag(again))).alias("etag"), F.when(p % 9 != 0, version(again)).alias("last_modified"), digest(again).alias("digest"), heads("revisit", again).alias("headers"),
    )
    return response.unionByName(revisit)


def op9_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = warc.resolve_revisits(page_records(table(spark, sf_dir, "pages")))
    listed = F.array_join(F.transform("headers", lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return done.select("record_id", "url_key", "response_id", "outcome", listed.alias("headers"))


OP9_SQL = r"""
WITH p AS (
  SELECT page_id, regexp_extract(url, '(?s)\A[^/]*//[^/]*/[^/?#]*') AS section, CAST(floor(page_id * 7919 % 2000000 / 600) AS BIGINT) * 600 AS seen FROM pages
), k AS (
  SELECT *, seen + page_id * 53 % 300000 - 20000 AS again, regexp_extract(section, '(?s)\A[A-Za-z][A-Za-z0-9+.-]*://[^/?]*(.*)', 1) AS rest FROM p
), u AS (
  SELECT *, CASE WHEN regexp_matches(section, '(?s)\A[A-Za-z][A-Za-z0-9+.-]*://') THEN lower(regexp_extract(section, '(?s)\A([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1)) || CASE WHEN starts_with(rest, '/') THEN '' ELSE '/' END || rest ELSE section END AS url_key FROM k
), response AS (
  SELECT 2 * page_id AS id, url_key, seen AS ts, md5(concat_ws(' ', section, CAST(floor(seen / 400000) AS BIGINT))) AS digest, CAST(floor(seen / 400000) AS BIGINT)::VARCHAR AS modified, page_id FROM u
), revisit AS (
  SELECT 2 * page_id + 1 AS id, url_key, again AS ts, md5(concat_ws(' ', section, CAST(floor(again / 400000) AS BIGINT))) AS digest, CAST(floor(again / 400000) AS BIGINT)::VARCHAR AS modified, page_id FROM u
), found AS (
  SELECT v.*, r.id AS response_id, CASE
      WHEN r.id IS NULL THEN NULL
      WHEN r.page_id % 4 <> 0 AND (v.page_id % 7 = 0 OR v.page_id % 11 <> 0) THEN v.page_id % 7 <> 0 AND r.digest = v.digest
      WHEN r.page_id % 8 <> 4 AND v.page_id % 9 <> 0 THEN r.modified = v.modified
      WHEN r.page_id % 16 <> 12 THEN r.digest = v.digest END AS same,
    row_number() OVER (PARTITION BY v.id ORDER BY r.ts DESC NULLS LAST, r.id DESC) AS n
  FROM revisit v LEFT JOIN response r ON r.url_key = v.url_key AND r.ts < v.ts
)
SELECT id AS record_id, url_key, response_id,
  CASE WHEN response_id IS NULL THEN 'no_earlier_response' WHEN same IS NULL THEN 'no_validator' WHEN same THEN 'resolved' ELSE 'validator_mismatch' END AS outcome,
  'content-type=' || CASE WHEN same THEN 'text/html' ELSE 'text/plain' END || ';date=revisit' || page_id || ';etag="' || digest || '"' AS headers
FROM found WHERE n = 1
"""

# 10: n-gram Jaccard join


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents"))


# 11: embedding whitening


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whiten.whiten(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").cast("long"))


# 12: spelling variant grouping


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


# 13: sharding


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), 16, keep=("doc_id",))


QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_bpe": op2_bpe,
    "op3_ann": op3_ann,
    "op4_mixing": op4_mixing,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_quality": op6_quality,
    "op7_lm_score": op7_lm_score,
    "op8_url_filter": op8_url_filter,
    "op9_warc_revisit": op9_warc_revisit,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_whitening": op11_whitening,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_sharding": op13_sharding,
}
ORACLE_SQL = {
    "op1_chat_format": OP1_SQL,
    "op8_url_filter": OP8_SQL,
    "op9_warc_revisit": OP9_SQL,
}
