"""TF-IDF weights, the audit of nearest rows, character-gram overlap of the closest pairs, dense cosine and containment."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import char_grams, excerpt, folded, jaccard, ratio, tokens
from ..sources.shared import stored
from .nearest import nearest
from .stats import exact_percentiles

#: Of the items that one automaton holds, characters together.
AUTOMATON_CHARS = 4_000_000


def terms(text: Column) -> Column:
    """Tokens and pairs of neighbouring tokens."""
    words = tokens(text)
    pairs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b)))
    return F.concat(words, F.coalesce(pairs, F.array().cast("array<string>")))


def tfidf(rows: DataFrame, text: Column, min_df: int = 2, *keys: str) -> DataFrame:
    """keys, term, weight: sublinear term frequency, smoothed inverse document frequency, unit length."""
    bag = rows.select(*keys, F.explode(terms(text)).alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    df = bag.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df).crossJoin(F.broadcast(total))  # one row
    idf = df.select("term", (F.log((1 + F.col("total")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = bag.join(idf, "term").select(*keys, "term", ((1 + F.log("tf")) * F.col("idf")).alias("raw"))
    norm = raw.groupBy(*keys).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norm, list(keys)).select(*keys, "term", (F.col("raw") / F.col("norm")).alias("weight"))


def audit_summary(rows: DataFrame) -> DataFrame:
    """Of similarity, transition and same_label: n, percentiles, counts from 0.8 and 0.9 on; over all and by transition."""
    s = F.col("similarity")
    both = stored(rows.select(s, "same_label", F.explode(F.array(F.col("transition"), F.lit("all"))).alias("transition")))
    if both.isEmpty():  # of what is stored, so that the rows are made once
        raise ValueError("an audit needs rows")
    counts = both.groupBy("transition").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(s >= 0.8).alias("high"),
        F.count_if(s >= 0.9).alias("very_high"),
        F.count_if((s >= 0.8) & F.col("same_label")).alias("high_same_label"),
        F.count_if((s >= 0.8) & ~F.col("same_label")).alias("high_other_label"),
    )
    p = [F.col("p")[i].alias(n) for i, n in enumerate(("p50", "p90", "p95"))]
    found = exact_percentiles(both, s, [0.5, 0.9, 0.95], "transition").select("transition", *p, "max")
    return counts.join(found, "transition").select("transition", "n", "p50", "p90", "p95", "max", "high", "very_high", "high_same_label", "high_other_label")


def most_similar(rows: DataFrame, most: int = 20) -> DataFrame:
    """The rows of the highest similarity, ties to the lowest query_id."""
    return rows.orderBy(F.desc("similarity"), "query_id").limit(most)


def closest_pairs(rows: DataFrame, most: int = 20, limit: int = 200) -> DataFrame:
    """The most similar pairs (query_id, query_text, train_text, similarity), with their 5-gram overlap and excerpts."""
    top = most_similar(rows, most)
    top = top.withColumns({"_q": folded(F.col("query_text")), "_t": folded(F.col("train_text"))})  # once, not for each gram
    grams = lambda c: char_grams(F.col("_q" if c == "query_text" else "_t"))
    return top.select("query_id", "similarity", jaccard(grams("query_text"), grams("train_text")).alias("char5_jaccard"), excerpt(F.col("query_text"), limit).alias("query_excerpt"), excerpt(F.col("train_text"), limit).alias("train_excerpt"))


def dense_cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of one length; 0 where one is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return ratio(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def _held(found: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for place, text in enumerate(found.value):
            automaton.add_word(text, place)
        automaton.make_automaton()
        for batch in batches:
            ids, places = [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                here = {place for _, place in automaton.iter(text)} if text else set()
                ids += [row] * len(here)
                places += here
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(ids, pa.int64())), pa.array(places, pa.int32())], ["doc_id", "place"])

    return run


def containment(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id: documents that hold an item's whole text.

    Items of AUTOMATON_CHARS characters together are an automaton that every task builds from a broadcast list and runs once
    over each text, whatever the number of items and of their occurrences; more items are as many automatons as that takes,
    one after another. An empty item is in every text that isn't null; a null one in none.
    """
    texts = docs.where("text IS NOT NULL").select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    named = stored(items.where("text IS NOT NULL").groupBy("text").agg(F.collect_set("item_id").alias("item_ids")))
    running = F.sum(F.length("text")).over(Window.orderBy("text").rowsBetween(Window.unboundedPreceding, 0))  # of the items, not the documents
    grouped = stored(named.where("text <> ''").select("text", "item_ids", F.floor(running / AUTOMATON_CHARS).alias("automaton")))
    spark = docs.sparkSession
    out = texts.join(F.broadcast(named.where("text = ''").select("item_ids")), how="cross").select("doc_id", F.explode("item_ids").alias("item_id"))  # one row at most
    for (number,) in sorted(grouped.select("automaton").distinct().collect()):
        listed = [r.text for r in grouped.where(F.col("automaton") == number).select("text").collect()]
        found = texts.mapInArrow(_held(spark.sparkContext.broadcast(listed)), f"doc_id {kind}, place int").distinct()
        names = spark.createDataFrame(pa.table({"place": pa.array(range(len(listed)), pa.int32()), "text": listed}))
        ids = names.join(grouped, "text").select("place", F.explode("item_ids").alias("item_id"))
        out = out.unionByName(found.join(F.broadcast(ids), "place").select("doc_id", "item_id"))
    return out.distinct()


__all__ = ["audit_summary", "closest_pairs", "containment", "dense_cosine", "most_similar", "nearest", "terms", "tfidf"]
