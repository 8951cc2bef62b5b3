"""LM scoring by context-tree weighting over bytes, beside a smoothed unigram score.

The model predicts a byte by eight binary decisions. Each decision is a node of a binary tree over the byte's bits and
has a context tree over the DEPTH bytes before it (zero bytes stand before a text's start). Every node of a context
tree holds how often its bit was 0 and 1 in the training texts and their Krichevsky-Trofimov probability P_e; the
weighted probability is P_w = P_e at DEPTH, else half P_e plus half the product of the children's P_w. A bit's
probability in a context mixes the nodes on the path from the root, each by its share of P_w. Training counts are
fixed before scoring, so a text's score doesn't depend on other texts being scored. A-Z are lower-cased.

Dataflow: tasks count words and (context, byte) grams of their texts and one shuffle sums them; the tree is built
level by level from the grams by grouped sums (bottom up) and joins with the parent level (top down), so no task holds
the model. Texts are then scored against the HEAD most frequent words and grams, a broadcast of fixed size; what a
text holds besides goes, with a row number, through an exact join with all words or grams. Nothing is cut off.

A null or empty text has no words, one end, and score 0. A null id counts as an empty text for the fold. Repeated rows
each count and each get a result. Texts are learned and scored whole; one longer than a megabyte is held alone. Only doc_id and text are read. An empty table gives no rows; with no training text
all counts are 0. Words and grams are 64-bit keys; grams exactly, words by a hash (see arrays).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import Chunk, chunks, map_batches, per_row_sum
from .lineage import stored

DEPTH, HEAD, FOLDS, HELD_OUT = 4, 1 << 20, 7, 2
WORDS, GRAMS = 0, 1


class Table:
    """A hash table of arrays: 64-bit keys to doubles."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        size = 1 << self.bits
        self.keys, self.used, self.values = np.zeros(size, np.int64), np.zeros(size, bool), np.zeros(size)
        left = np.arange(len(keys))
        slot = self._slot(keys)
        while len(left):
            at = slot[left]
            free = ~self.used[at]
            first = np.unique(at[free], return_index=True)[1]
            put = left[free][first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            self.used[slot[put]] = True
            done = np.zeros(len(keys), bool)
            done[put] = True
            left = left[~done[left]]
            slot[left] = (slot[left] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values, 0 where there is none, and where there is one."""
        slot = self._slot(keys)
        hit = (self.keys[slot] == keys) & self.used[slot]
        values = np.where(hit, self.values[slot], 0.0)
        left = np.flatnonzero(~hit & self.used[slot])
        slot = slot[left]
        while len(left):
            slot = slot + 1 & (1 << self.bits) - 1
            same = (self.keys[slot] == keys[left]) & self.used[slot]
            values[left[same]], hit[left[same]] = self.values[slot[same]], True
            stay = ~same & self.used[slot]
            left, slot = left[stay], slot[stay]
        return values, hit


def grams(chunk: Chunk, depth: int = DEPTH) -> np.ndarray:
    """For each byte: itself in the low 8 bits, the bytes before it, nearest first, above; 0 before a text's start."""
    data = chunk.data.astype(np.int64)
    lengths = np.diff(chunk.offsets)
    place = np.arange(len(data)) - np.repeat(chunk.offsets[:-1], lengths)
    out = data.copy()
    for k in range(1, depth + 1):
        out[k:] |= np.where(place[k:] >= k, data[:-k], 0) << (8 * k)
    return out


def _sums(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, train, all_ = (np.concatenate([p[k] for p in parts]) for k in range(3))
    order = np.argsort(keys)
    keys, train, all_ = keys[order], train[order], all_[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return (keys[first], np.add.reduceat(train, first), np.add.reduceat(all_, first)) if len(first) else (keys, train, all_)


def _count(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {WORDS: [], GRAMS: []}

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, parts in held.items():
                if parts:
                    keys, train, all_ = _sums(parts)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys), pa.array(train), pa.array(all_)], ["kind", "key", "train", "seen"])
                    parts.clear()

        for batch in batches:
            for c in chunks(batch.column("text"), lower=True):
                learns = np.asarray(batch.column("learns").slice(c.first, c.n)).astype(bool)
                starts, ends = c.words()
                words = c.hashes(starts, ends).view(np.int64)[np.repeat(learns, c.counts(starts))]
                keys, counts = np.unique(words, return_counts=True)
                held[WORDS].append((keys, counts, counts))
                found = grams(c, depth)
                inside = np.repeat(learns, np.diff(c.offsets))
                for part, learnt in ((found[inside], 1), (found[~inside], 0)):
                    keys, counts = np.unique(part, return_counts=True)
                    held[GRAMS].append((keys, counts * learnt, counts))
                if len(held[WORDS]) >= 32:
                    yield from flush()
        yield from flush()

    return run


_LOG_GAMMA = (
    "(({x} + 7.5D) * ln({x} + 8D) - ({x} + 8D) + 0.9189385332046727D + 1D / (12D * ({x} + 8D)) - 1D / (360D * pow({x} + 8D, 3)) + 1D / (1260D * pow({x} + 8D, 5))"
    " - ln({x} * ({x} + 1D) * ({x} + 2D) * ({x} + 3D)) - ln(({x} + 4D) * ({x} + 5D) * ({x} + 6D) * ({x} + 7D)))"
)
#: ln of the Krichevsky-Trofimov probability of zeros and ones.
LOG_KT = f"({_LOG_GAMMA.format(x='(zeros + 0.5D)')} + {_LOG_GAMMA.format(x='(ones + 0.5D)')} - {_LOG_GAMMA.format(x='(zeros + ones + 1D)')} - ln(pi()))"


def gram_scores(counted: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Per gram: key, seen, and value, the log10 probability of its byte in its context."""
    place = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("place")
    bits = counted.select("key", "train", F.shiftright("key", 8).alias("context"), place)
    bits = bits.select(
        "key",
        "train",
        "context",
        F.expr("shiftleft(1L, place) | shiftright(key & 255, 8 - place)").alias("node"),
        (F.expr("shiftright(key & 255, 7 - place) & 1") == 1).alias("bit"),
    )
    zeros, ones = F.sum(F.when(F.col("bit"), 0).otherwise(F.col("train"))), F.sum(F.when(F.col("bit"), F.col("train")).otherwise(0))
    deepest = bits.groupBy("context", "node").agg(zeros.cast("double").alias("zeros"), ones.cast("double").alias("ones"))
    levels = [stored(deepest.withColumn("own", F.expr(LOG_KT)).withColumn("weighted", F.col("own")))]
    for d in range(depth - 1, -1, -1):
        shorter = F.col("context").bitwiseAND((1 << 8 * d) - 1).alias("context")
        up = levels[-1].groupBy(shorter, "node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("children"))
        up = up.withColumn("own", F.expr(LOG_KT))
        either = F.greatest("own", "children") + F.log1p(F.exp(-F.abs(F.col("own") - F.col("children"))))
        levels.append(stored(up.withColumn("weighted", either - F.log(F.lit(2.0))).drop("children")))
    above = None
    for d, level in enumerate(reversed(levels)):
        share = F.lit(1.0) if d == depth else F.exp(F.col("own") - F.col("weighted")) / 2
        one = (F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1.0)
        here = level.select("context", "node", share.alias("share"), one.alias("one"))
        if above is None:
            above = here.select("context", "node", (F.col("share") * F.col("one")).alias("sum"), (1 - F.col("share")).alias("rest"))
        else:
            parent = above.select(F.col("context").alias("parent"), F.col("node").alias("_node"), "sum", "rest")
            shorter = F.col("context").bitwiseAND((1 << 8 * (d - 1)) - 1)
            on = (shorter == F.col("parent")) & (F.col("node") == F.col("_node"))
            above = here.join(parent, on).select("context", "node", (F.col("sum") + F.col("rest") * F.col("share") * F.col("one")).alias("sum"), (F.col("rest") * (1 - F.col("share"))).alias("rest"))
    scored = bits.join(above, ["context", "node"]).groupBy("key").agg(F.sum(F.log10(F.when(F.col("bit"), F.col("sum")).otherwise(1 - F.col("sum")))).alias("value"))
    return scored.join(counted.select("key", "seen"), "key")


def _head(rows: DataFrame, by: str, value: str, most: int) -> Table:
    """The `most` rows of the highest `by`, ties by key; so many at most come to the driver."""
    table = rows.select("key", F.col(value).cast("double").alias("value"), by).orderBy(F.desc(by), "key").limit(most).select("key", "value").toArrow()
    return Table(table.column("key").to_numpy(), table.column("value").to_numpy())


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == HELD_OUT


def score(docs: DataFrame, depth: int = DEPTH, head: int = HEAD) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte (null: no byte)."""
    learns = (~held_out(F.col("doc_id"))).alias("learns")
    counted = map_batches(docs.select(learns, "text"), _count(depth), "kind int, key long, train long, seen long")
    counts = stored(counted.groupBy("kind", "key").agg(F.sum("train").alias("train"), F.sum("seen").alias("seen")))
    words, found = counts.where(F.col("kind") == WORDS), counts.where(F.col("kind") == GRAMS)
    texts = docs.where(~held_out(F.col("doc_id"))).count()
    sums = words.agg(F.coalesce(F.sum("train"), F.lit(0)), F.count(F.lit(1))).first()
    tokens, kinds = sums[0] + texts, sums[1] + (texts > 0)
    scores = stored(gram_scores(found, depth))
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((_head(words, "train", "train", head), _head(scores, "seen", "value", head)))
    below, end = np.log10(tokens + kinds + 1), np.log10((texts + 1) / (tokens + kinds + 1))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_words, known_grams = sent.value
        for batch in batches:
            for c in chunks(batch.column("text"), lower=True):
                starts, ends = c.words()
                counts = c.counts(starts)
                keys = c.hashes(starts, ends).view(np.int64)
                c_of, hit = known_words.find(keys)
                base = per_row_sum(np.where(hit, np.log10(c_of + 1) - below, 0.0), counts) + end
                lengths = np.diff(c.offsets)
                found = grams(c, depth)
                value, seen = known_grams.find(found)
                part = batch.slice(c.first, c.n)
                rest = [
                    pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(per_row_sum(~ok, n)))).astype(np.int32)), pa.array(k[~ok]))
                    for k, ok, n in ((keys, hit, counts), (found, seen, lengths))
                ]
                columns = [counts + 1, per_row_sum(hit & (c_of > 0), counts) + (texts > 0), base, per_row_sum(value, lengths), lengths]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), *map(pa.array, columns), *rest], ["doc_id", "row", "n_tokens", "n_known", "base", "score", "bytes", "words", "grams"])

    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    out = stored(map_batches(rows, run, f"doc_id {kind}, row long, n_tokens long, n_known long, base double, score double, bytes long, words array<long>, grams array<long>"))
    rare = out.select("row", F.explode("words").alias("key")).join(words.select("key", "train"), "key", "left")
    c_of = F.coalesce("train", F.lit(0))
    rare = rare.groupBy("row").agg(F.sum(F.log10(c_of + 1.0) - F.lit(float(below))).alias("rare_base"), F.sum((c_of > 0).cast("long")).alias("rare_known"))
    odd = out.select("row", F.explode("grams").alias("key")).join(scores.select("key", "value"), "key").groupBy("row").agg(F.sum("value").alias("odd_score"))
    whole = out.join(rare, "row", "left").join(odd, "row", "left")
    total = F.col("score") + F.coalesce("odd_score", F.lit(0.0))
    return whole.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        total.alias("score"),
        F.when(F.col("bytes") > 0, -total / F.log10(F.lit(2.0)) / F.col("bytes")).alias("bits_per_byte"),
    )
