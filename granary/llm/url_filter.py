"""URL filters: pattern rules indexed by their rarest literal token; only the candidates' regular expressions run.

Native: DataFrame functions only. Each distinct URL is judged once. Its tokens (runs of 0-9 and a-z, once A-Z are
lower-cased) fetch the rules filed under them, and a rule is filed under that one of its complete literal tokens that
the fewest URLs hold. A rule without a complete token is filed under the empty token, which every URL has.

Rules come as a Python list, so their number is known: up to BROADCAST_RULES they are broadcast, more are joined by a
shuffle, where adaptive execution splits a hot token. Judgements of URLs that some rule fits are written, then go back
to the rows by URL: both sides of that join are plain exchanges, so a URL that many rows share, or none, can be split.

A null URL, or one without ://, has an empty host and path and meets no host rule; patterns see a null as empty.
Long URLs are read whole, and a pattern takes time in proportion to their length. Columns beyond page_id and url are not read. Repeated rows each get their own result; an empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lineage import stored

BROADCAST_RULES = 10_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A host rule (text is host and path, as in `example.org/en/`) or a pattern over the lower-cased URL.

    In a pattern * stands for anything, ^ for a separator or the end, | at either end for that end of the URL, and ||
    at the start for the start of the host or of a label in it.
    """

    text: str
    action: str
    pattern: bool = False

    @property
    def regex(self) -> str:
        if not self.pattern:
            host, slash, path = self.text.partition("/")
            return rf"(?s)\A(?:[^/]*\.)?{re.escape(host)}{re.escape(slash + path)}"
        body, head, end = self.text, "", self.text.endswith("|")
        if body.startswith("||"):
            body, head = body[2:], r"\A[^/]*://(?:[^/?#]*\.)?"
        elif body.startswith("|"):
            body, head = body[1:], r"\A"
        pieces = ["".join(r"(?:[^0-9a-z_.%-]|\z)" if c == "^" else re.escape(c) for c in piece) for piece in body.removesuffix("|").split("*")]
        if len(pieces) == 1:
            return "(?s)" + head + pieces[0] + (r"\z" if end else "")
        # where something stands between pieces the first place of each will do, so none is sought again: time in proportion
        first = head + pieces[0] if head else rf"\A(?>.*?{pieces[0]})"
        last = rf".*{pieces[-1]}\z" if end else f"(?>.*?{pieces[-1]})"
        return "(?s)" + first + "".join(f"(?>.*?{p})" for p in pieces[1:-1]) + last

    @property
    def tokens(self) -> list[str]:
        """Literal tokens that are whole in every URL that the rule fits."""
        text = self.text.translate(str.maketrans(_UPPER, _LOWER))
        if not self.pattern:
            host, slash, path = text.partition("/")
            found = re.findall("[0-9a-z]+", host)
            return found + [m[0] for m in re.finditer("[0-9a-z]+", slash + path) if m.end() < len(slash + path)]
        begin, end = text.startswith("|"), text.endswith("|")
        body = text.strip("|")
        whole = lambda at, edge: edge if not 0 <= at < len(body) else body[at] != "*"
        return [m[0] for m in re.finditer("[0-9a-z]+", body) if whole(m.start() - 1, begin) and whole(m.end(), end)]


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.array_append(F.regexp_extract_all(ascii_lower(text), F.lit("[0-9a-z]+"), F.lit(0)), F.lit("")))


def index_rules(spark: SparkSession, tokens: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rules with the token that each is filed under: the rarest of its own among the URLs' tokens, ties by name."""
    small = F.broadcast if len(rules) <= BROADCAST_RULES else lambda x: x
    rows = [(i, r.text, r.action, r.pattern, r.regex, r.tokens or [""]) for i, r in enumerate(rules)]
    table = spark.createDataFrame(rows, "id int, rule string, action string, pattern boolean, regex string, tokens array<string>")
    own = table.select("id", F.explode("tokens").alias("token"))
    counts = tokens.join(small(own.select("token").distinct()), "token", "left_semi").groupBy("token").count()
    rarest = own.join(small(counts), "token", "left").groupBy("id").agg(F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), "token")).alias("token"))
    return table.drop("tokens").join(small(rarest), "id")


def judge_urls(pages: DataFrame, rules: list[Rule], default: str = "allow") -> DataFrame:
    """Per row: page_id, host, path, rule, verdict and pattern.

    rule is the longest host rule that fits (ties: the earlier in the list), else null, and decides. Where no host
    rule fits, an allowing pattern outweighs a blocking one, and default holds where none fits; pattern is the longest
    of the deciding ones, else null.
    """
    spark = pages.sparkSession
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"))
    parts = rows.select("url").distinct().select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    tokens = parts.select("url", "host", "path", F.explode(_tokens("url")).alias("token"))
    index = index_rules(spark, tokens.select("token"), rules)
    if len(rules) <= BROADCAST_RULES:
        index = F.broadcast(index)
    subject = F.when(F.col("pattern"), ascii_lower(F.col("url"))).otherwise(F.concat("host", "path"))
    hits = tokens.join(index, "token").where(F.rlike(subject, F.col("regex")))  # most URLs fetch few rules, see the README
    rank = F.struct(F.length("rule").alias("length"), (-F.col("id")).alias("id"))
    allows = F.col("pattern") & (F.col("action") == "allow")
    best = lambda of: F.max_by(F.when(of, F.struct("rule", "action")), F.when(of, rank))
    judged = hits.groupBy("url").agg(
        best(~F.col("pattern")).alias("host_rule"),
        best(allows).alias("allowing"),
        best(F.col("pattern") & (F.col("action") != "allow")).alias("blocking"),
    )
    judged = stored(judged.where("host_rule IS NOT NULL OR allowing IS NOT NULL OR blocking IS NOT NULL"))
    pattern = F.coalesce("allowing", "blocking")
    out = rows.join(judged, "url", "left")
    return out.select(
        "page_id",
        host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path"),
        F.col("host_rule.rule").alias("rule"),
        F.coalesce("host_rule.action", pattern["action"], F.lit(default)).alias("verdict"),
        F.when(F.col("host_rule").isNull(), pattern["rule"]).alias("pattern"),
    )
