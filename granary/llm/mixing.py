"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks, then seeded block selection.

The mix has as many words as the input. A source's target is its weight's share, at most REPEATS times its size; what
is over is reshared by weight (the water level of the weights, found by one window over the sources). Blocks of about
BLOCK words are then allocated to sources, and each source's to its shards, by the highest quotients weight / (2 s + 1).

A shard is a hash bucket of one source's documents of about SHARD words, or of a SHARDS-th of a source where that is
more, so a hot source has more shards, no task holds more than a shard, and a source's shards fit one task. A shard's documents stand in seeded order and are cut into m equal blocks; a quota of q takes
each block q div m times and the q mod m blocks from a seeded one on, once more. That is interval arithmetic on the
running word count: no row per block.

A run of blocks, not single ones here and there, so that few texts are cut. A text longer than a shard's share is cut like
others. A null text has no words and is taken 0 words of. A null source is a source, the last. The seeded order goes
by id and text, so rows of one id, or of none, are spread like others; repeated rows are documents of their own, and
stand side by side. An empty table gives no rows. Columns that aren't named by keep are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lineage import stored

#: Words of a block and, at the least, of a shard; shards of a source at most; how often a word is taken at most; weights
#: of the sources in order.
BLOCK, SHARD, SHARDS, REPEATS, WEIGHTS = 16, 1 << 18, 1 << 16, 3, (5, 2, 1)
#: Up to so many sources their table is broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 10_000

WORD = r"[^\x20\x09-\x0D]+"


def apportion(weights: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Seats by the highest quotients weight / (2 s + 1), at most most[i] for each; ties go to the earlier one."""
    weights, most = np.asarray(weights, float), np.asarray(most, np.int64)
    given = lambda divisor: np.minimum(np.floor(weights / divisor + 0.5), most).astype(np.int64)
    got = np.zeros(len(weights), np.int64)
    if not len(weights) or weights.max() <= 0 or seats <= 0:
        return got
    low, high = weights.sum() / (4.0 * seats + 4.0 * len(weights)), 4.0 * weights.max()
    for _ in range(200):  # the least divisor that gives no more than there are
        middle = (low + high) / 2
        low, high = (middle, high) if given(middle).sum() > seats else (low, middle)
    got = given(high)
    heap = [(-w / (2 * s + 1), i) for i, (w, s, m) in enumerate(zip(weights, got, most, strict=True)) if s < m and w > 0]
    heapq.heapify(heap)
    for _ in range(seats - int(got.sum())):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < most[i]:
            heapq.heappush(heap, (-weights[i] / (2 * got[i] + 1), i))
    return got


def _key(source: Column) -> Column:
    """A source as a string that is never null and tells null from any other."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """Per source of (source_key, size): source_size, target and how many shards it has."""
    sources = sizes.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    place = Window.orderBy(F.col("source_key") == "", "source_key")
    cycle = F.array(*map(F.lit, weights))
    out = sources.withColumn("place", F.row_number().over(place)).withColumn("weight", F.element_at(cycle, (F.col("place") - 1) % len(weights) + 1))
    most = repeats * F.col("source_size")
    out = out.withColumn("ratio", most / F.col("weight"))
    before = Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(all_) - F.coalesce(F.sum(most).over(before), F.lit(0))) / (F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    out = out.withColumn("level", level)
    out = out.withColumn("level", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "place", "level"))).over(all_)["level"])
    target = F.least(most.cast("double"), F.col("weight") * F.col("level"))
    return out.select("source_key", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"), "place")


def _seats(block: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        total = int(rows["source_size"].sum())
        return rows.assign(seats=apportion(rows["target"].to_numpy(), round(total / block), np.full(len(rows), 2**62)))

    return run


def _quotas(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("shard")
    return rows.assign(quota=apportion(rows["words"].to_numpy(), int(rows["seats"].iloc[0]), rows["most"].to_numpy()))


def mix(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), *, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, block: int = BLOCK, shard: int = SHARD, seed: int = 17, prefix: str = "") -> DataFrame:
    """Per row: the kept columns, size, source_size, target, taken, and parts: the ranges of its words to take.

    The names of the new columns get the prefix.
    """
    slim = lambda: docs.select(_key(F.col("source")).alias("source_key"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("mark"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sized = stored(slim())
    seats = targets(sized, weights, repeats).groupBy().applyInPandas(_seats(block), "source_key string, source_size long, target double, place int, seats long")
    sources = stored(seats.withColumn("shards", F.ceil(F.greatest(F.col("source_size"), F.lit(1)) / F.greatest(F.lit(shard), F.col("source_size") / SHARDS))))
    if sources.count() <= BROADCAST_SOURCES:
        sources = F.broadcast(sources)
    in_shard = F.pmod(F.xxhash64(F.lit(seed), "id", "mark"), F.col("shards")).alias("shard")
    words = sized.join(sources, "source_key").groupBy("source_key", "seats", in_shard).agg(F.sum("size").alias("words"))
    blocks = words.withColumn("blocks", F.ceil(F.col("words") / F.lit(block))).withColumn("most", repeats * F.col("blocks"))
    quotas = blocks.groupBy("source_key").applyInPandas(_quotas, T.StructType([*blocks.schema, T.StructField("quota", T.LongType())])).drop("seats", "most")

    columns = F.struct(*keep).alias("kept")
    if tuple(keep) == ("doc_id",):
        rows = sized.select(F.struct(F.col("id").alias("doc_id")).alias("kept"), "source_key", "id", "mark", "size")
    else:
        rows = docs.select(columns, _key(F.col("source")).alias("source_key"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("mark"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    placed = rows.join(sources, "source_key").select("kept", "source_key", "id", "mark", "size", "source_size", "target", in_shard)
    order = Window.partitionBy("source_key", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "id", "mark"), "id", "mark")
    placed = placed.withColumn("end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.join(quotas, ["source_key", "shard"], "left")
    m, q = F.greatest("blocks", F.lit(1)), F.coalesce("quota", F.lit(0))
    first = F.pmod(F.xxhash64(F.lit(seed + 2), "source_key", "shard"), m)
    last = first + q % m
    begin = F.col("end") - F.col("size")
    at = lambda b: F.expr("0L") + F.floor(b * F.col("words") / m)

    def overlap(a: Column, b: Column) -> Column:
        a, b = F.greatest(begin, a), F.least(F.col("end"), b)
        return F.struct((a - begin).alias("from"), F.greatest(b - a, F.lit(0)).cast("long").alias("words"))

    whole = F.transform(F.array_repeat(F.col("size"), F.floor(q / m).cast("int")), lambda s: F.struct(F.lit(0).cast("long").alias("from"), s.alias("words")))
    rest = F.array(overlap(at(first), at(F.least(last, m))), overlap(F.lit(0).cast("long"), at(F.greatest(last - m, F.lit(0)))))
    parts = F.filter(F.concat(whole, rest), lambda p: p["words"] > 0)
    out = placed.withColumn("parts", parts)
    taken = F.aggregate("parts", F.lit(0).cast("long"), lambda s, p: s + p["words"])
    new = {"size": F.col("size"), "source_size": F.col("source_size"), "target": F.col("target"), "taken": taken, "parts": F.col("parts")}
    return out.select("kept.*", *(c.alias(prefix + n) for n, c in new.items()))


def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: a row of docs for each part taken of it, with n_chars, where there is one, of the part."""
    prefix = "mix_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    parts = mix(docs, tuple(docs.columns), prefix=prefix, **options)
    part, size = F.col(f"{prefix}part"), F.col(f"{prefix}size")
    rows = parts.withColumn(f"{prefix}part", F.explode(f"{prefix}parts"))
    pieces = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    cut = F.array_join(F.slice(pieces, (part["from"] + 1).cast("int"), part["words"].cast("int")), "")
    text = F.when(part["words"] == size, F.col("text")).otherwise(cut)
    rows = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)
