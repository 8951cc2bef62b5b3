"""Text expressions: normal forms, digests, excerpts, tokens and character grams."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Unicode white space with the four separators that Java's \\s leaves out.
WHITE = r"(?U)[\s\x1c-\x1f]+"


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns, computed once a row: what is built on them stays above and doesn't repeat their expressions."""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, rf"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def normalized(text: Column) -> Column:
    """Lower case, white space collapsed and stripped; for text that NFKC leaves as it is (see normalized_nfkc)."""
    return F.trim(F.regexp_replace(F.lower(text), WHITE, " "))


@F.pandas_udf(T.StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).lower().split()))


def normalized_nfkc(text: Column | str) -> Column:
    """NFKC, lower case, white space collapsed and stripped.

    Text of ASCII characters is in that form already and stays in the JVM; only other texts are sent to a worker.
    """
    text = F.col(text) if isinstance(text, str) else text
    plain = text.rlike(r"\A[\x00-\x7f]*\z")
    return F.coalesce(_composed(F.when(~plain, text)), normalized(text))


@F.pandas_udf(T.StringType())
def casefolded(texts: pd.Series) -> pd.Series:
    """Case-folded, white space collapsed and stripped."""
    return texts.map(lambda t: None if t is None else " ".join(t.casefold().split()))


def text_hash(text: Column, nfkc: bool = False) -> Column:
    return F.sha2(normalized_nfkc(text) if nfkc else normalized(text), 256)


def folded(text: Column) -> Column:
    """Case-folded as far as lower() and the German sharp s go; for all of Unicode see casefolded."""
    return F.replace(normalized(text), F.lit("ß"), F.lit("ss"))


def char_grams(folded_text: Column, n: int = 5) -> Column:
    """Distinct character n-grams; none for a shorter text."""
    return F.array_distinct(F.regexp_extract_all(folded_text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))  # in one pass over the text


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements; 1 for two empty sets."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def tokens(text: Column) -> Column:
    """Lower-cased runs of two word characters or more."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))


def excerpt(text: Column, limit: int) -> Column:
    """White space collapsed; cut to limit characters, the last an ellipsis."""
    flat = F.trim(F.regexp_replace(text, WHITE, " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.substring(flat, 1, limit - 1), F.lit("…")))


def table_cell(text: Column, limit: int) -> Column:
    """An excerpt for a Markdown table: trailing space before the ellipsis goes and bars are escaped."""
    flat = F.trim(F.regexp_replace(text, WHITE, " "))
    cut = F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, limit - 1)), F.lit("…")))
    return F.replace(cut, F.lit("|"), F.lit(r"\|"))


def redacted_excerpt(text: Column, limit: int = 200, pattern: str = r"(?i)improv\w*") -> Column:
    """With words of the pattern left out; whether to cut is decided on the text as it was."""
    cleaned = F.regexp_replace(text, pattern, "[word omitted]")
    return F.when(F.length(text) <= limit, cleaned).otherwise(F.concat(F.substring(cleaned, 1, limit - 1), F.lit("…")))


def four_places(value: Column, signed: bool = False) -> Column:
    return F.format_string("%+.4f" if signed else "%.4f", value.cast("double"))


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def token_len(count: Callable[[list[str]], list[int]]):
    """A function of a text column: the number of tokens by a tokenizer that takes a batch of texts; null of a null."""

    @F.pandas_udf(T.IntegerType())
    def run(texts: pd.Series) -> pd.Series:
        has = texts.notna()
        return pd.Series(count(texts[has].tolist()), texts.index[has], "Int32").reindex(texts.index)

    return run
