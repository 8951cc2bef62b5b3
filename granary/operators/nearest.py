"""The nearest train row of each query row by TF-IDF cosine, exact: nearest() compares packed blocks (see cosine.py).

similar_rows() finds the same over a table of weights through an index with bounds; its tables hold a row for each term of
a text, so it suits weights that are a table anyway and texts whose nearest rows share rare terms. There rows become unit weights of terms once, in a stored table. Similarities are sums of products that are never negative, so
what a pair shares in terms of few texts (RARE at most) is a lower bound; the best such pair of a query, compared in full,
is the least that its nearest row must reach.

Train rows are in blocks by their number of terms, and for each term and block the greatest weight is known. Of a query's
terms the most common ones, as long as their products with the greatest weights stay below SKIPPED of that least, or
CHANCE below it, what rows share by chance, are skipped in a block: all together they can't lift a row that far. Only the other terms are joined with the block's rows,
and a block whose terms can't reach the least isn't looked at. Rows whose sum over the joined terms, and the bound of the
skipped ones, reach the least are compared in full. So a term that most texts hold joins only where a query has hardly
another one, and then it is a skewed join that adaptive execution splits.

Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import once, tokens
from ..sources.shared import stored
from .cosine import nearest_rows

RARE, SKIPPED, CHANCE, SLACK = 64, 0.3, 0.15, 1e-7


def term_ids(words: Column) -> Column:
    """Hashes of the tokens and of the pairs of neighbouring ones."""
    ids = F.transform(words, lambda w: F.xxhash64(w))
    few = F.size(words) < 2
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    return F.when(few, ids).otherwise(F.concat(ids, pairs))


def unit_weights(rows: DataFrame, min_df: int) -> DataFrame:
    """row, asks, term, df, weight and block of rows (row, asks, terms): sublinear term frequency, smoothed inverse
    document frequency, unit length; block is the logarithm of how many terms a row has."""
    bag = stored(rows.select("row", "asks", F.explode("terms").alias("term")).groupBy("row", "asks", "term").agg(F.count(F.lit(1)).alias("tf")))
    total = rows.count()
    df = bag.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df)
    raw = bag.join(df, "term").select("row", "asks", "term", "df", ((1 + F.log("tf")) * (F.log((1 + F.lit(total)) / (1 + F.col("df"))) + 1)).alias("raw"))
    raw = stored(raw)
    norm = raw.groupBy("row").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"), F.floor(F.log2(F.count(F.lit(1)))).cast("int").alias("block"))
    return stored(raw.join(norm, "row").select("row", "asks", "term", "df", (F.col("raw") / F.col("norm")).alias("weight"), "block"))


def least_reached(asks: DataFrame, train: DataFrame) -> DataFrame:
    """asked and least: the full similarity to the row that shares most with the query in rare terms."""
    rare = F.col("df") <= RARE
    few = asks.where(rare).select("asked", "term", "ask_weight").join(train.where(rare).select("row", "term", "weight"), "term")
    shared = few.groupBy("asked", "row").agg(F.sum(F.col("ask_weight") * F.col("weight")).alias("shared"))
    best = shared.groupBy("asked").agg(F.max_by("row", "shared").alias("row"))
    pairs = asks.select("asked", "term", "ask_weight").join(best, "asked").join(train.select("row", "term", "weight"), ["row", "term"])
    return pairs.groupBy("asked").agg(F.sum(F.col("ask_weight") * F.col("weight")).alias("least"))


def joined_terms(asks: DataFrame, train: DataFrame, least: DataFrame) -> DataFrame:
    """asked, block, term, ask_weight, least, joined and skipped of the blocks that may hold a query's nearest row: whether
    the term is joined, and the bound on what all those skipped add."""
    peaks = train.groupBy("term", "block").agg(F.max("weight").alias("peak"), F.count(F.lit(1)).alias("rows"))
    terms = asks.select("asked", "term", "ask_weight").join(peaks, "term").join(least, "asked", "left").withColumn("least", F.coalesce("least", F.lit(0.0)))
    terms = terms.withColumn("bound", F.col("ask_weight") * F.col("peak"))
    block = Window.partitionBy("asked", "block")
    common = block.orderBy(F.desc("rows"), "term").rowsBetween(Window.unboundedPreceding, 0)
    terms = terms.withColumns({"upto": F.sum("bound").over(common), "most": F.sum("bound").over(block)})
    limit = F.least(F.greatest(SKIPPED * F.col("least"), F.col("least") - CHANCE), F.col("least") - 2 * SLACK)
    terms = terms.where(F.col("most") >= F.col("least") - SLACK).withColumn("joined", F.col("upto") > limit)
    skipped = F.coalesce(F.max(F.when(~F.col("joined"), F.col("upto"))).over(block), F.lit(0.0))
    return terms.select("asked", "block", "term", "ask_weight", "least", "joined", skipped.alias("skipped"))


def similar_rows(weights: DataFrame) -> DataFrame:
    """asked, row and similarity: for each asking row those rows that may be its nearest, compared in full."""
    asks = weights.where("asks").select(F.col("row").alias("asked"), "term", "df", F.col("weight").alias("ask_weight"))
    train = weights.where("NOT asks").select("row", "term", "df", "weight", "block")
    terms = stored(joined_terms(asks, train, stored(least_reached(asks, train))))
    product = F.sum(F.col("ask_weight") * F.col("weight"))
    found = terms.where("joined").join(train.select("row", "term", "block", "weight"), ["term", "block"])
    sums = found.groupBy("asked", "row", "block").agg(product.alias("part"), F.first("least").alias("least"), F.first("skipped").alias("skipped"))
    left = stored(sums.where(F.col("part") + F.col("skipped") >= F.col("least") - SLACK).select("asked", "row", "block", "part"))
    rest = terms.where("NOT joined").select("asked", "block", "term", "ask_weight")
    more = left.select("asked", "row", "block").join(rest, ["asked", "block"]).join(train.select("row", "term", "weight"), ["row", "term"])
    more = more.groupBy("asked", "row").agg(product.alias("more"))
    return left.join(more, ["asked", "row"], "left").select("asked", "row", (F.col("part") + F.coalesce("more", F.lit(0.0))).alias("similarity"))


def nearest(queries: DataFrame, train: DataFrame, min_df: int = 2) -> DataFrame:
    """For each query row (cve_id, text) its train row (ord, cve_id, text) of the highest cosine, ties to the lowest ord.

    Cosines are compared to nine places. Without a shared term the similarity is 0 and the row the first one. An empty
    side is an error. A null text has no terms. Ids of queries are taken as they are: equal ones are rows each.
    """
    ask = queries.select(F.lit(True).alias("asks"), F.lit(None).cast("long").alias("ord"), "cve_id", "text")
    both = ask.unionByName(train.select(F.lit(False).alias("asks"), F.col("ord").cast("long"), "cve_id", "text"))
    first = train.agg(F.min_by("cve_id", F.col("ord").cast("long")).alias("first_id"), F.count(F.lit(1)).alias("n")).first()
    asking = queries.select(F.lit(1)).count()
    if not first["n"] or not asking:
        raise ValueError("nearest rows need rows on both sides")

    def with_terms(rows: DataFrame) -> DataFrame:
        return once(rows, words=F.coalesce(tokens(F.col("text")), F.array().cast("array<string>"))).select("asks", "ord", "cve_id", term_ids(F.col("words")).alias("terms"))

    out = nearest_rows(both, with_terms, first["n"] + asking, min_df, RARE)
    return out.select("query_id", F.coalesce("train_id", F.lit(first["first_id"])).alias("train_id"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"))
