"""Quality rules: decision lists learned by sequential covering, emitted as ordered Spark conditional expressions.

`text_stats` measures every whole text once. `learn` grows conjunctions of thresholds on statistics of labelled rows by
information gain, prunes each on rows held out from growing, keeps it if it is precise enough there, and goes on with
the rows it doesn't cover. `verdict` turns the list into one CASE expression, so the application is a projection.

Learning sees at most SAMPLE labelled rows (those of the lowest hash of their id); all else covers every row.

A null or empty text has no words; its shares are 0. Rows with a null id or a null label teach nothing; an id labelled
twice counts once, with its lower label, and one that several texts share counts once, with its lowest statistics.
Without labels the list is empty and only the base rule rejects. Columns that aren't named are not read by
`text_stats`, except those the caller asks to keep. Texts are measured whole; one longer than a megabyte is held alone.
Equal gains go to the first statistic and the lowest threshold. Repeated rows each get a result; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import SPACE, Chunk, chunks, map_batches, mix, per_row_sum, repeated, runs_within

#: The most labelled rows that a list is learned from.
SAMPLE = 20_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct")


def _bytes_in(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars.encode())] = True
    return table


_SYMBOL, _UPPER = _bytes_in("#*$%&|<>"), _bytes_in("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGIT, _MARK = _bytes_in("0123456789"), _bytes_in("!?")


def measure(chunk: Chunk) -> dict[str, np.ndarray]:
    """COUNTS of each row of a chunk."""
    data, offsets = chunk.data, chunk.offsets
    starts, ends = chunk.words()
    counts = chunk.counts(starts)
    rows = np.arange(chunk.n, dtype=np.uint64)
    by_bytes = lambda inside: np.diff(np.concatenate(([0], np.cumsum(inside, dtype=np.int64)))[offsets])

    words = chunk.hashes(starts, ends)
    triples, at, n_triples = runs_within(words, counts, 3)
    twice, _ = repeated(mix(triples ^ np.repeat(rows, n_triples)))
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[at[twice] + k] = True
    _, again = repeated(mix(words ^ np.repeat(rows, counts)))

    breaks = np.flatnonzero(data == 10)
    begin = np.sort(np.concatenate((offsets[:-1], breaks + 1)))
    end = np.sort(np.concatenate((breaks, offsets[1:])))
    n_lines = by_bytes(data == 10) + 1
    filled = np.searchsorted(starts, begin) < np.searchsorted(starts, end)
    lines = mix(chunk.hashes(begin, end) ^ np.repeat(rows, n_lines))
    _, later = repeated(lines)

    return {
        "n_words": counts,
        "word_chars": by_bytes(~SPACE[data] & ((data & 0xC0) != 0x80)),
        "n_symbols": by_bytes(_SYMBOL[data]),
        "n_dup_lines": per_row_sum(filled & later, n_lines),
        "n_repeat_words": per_row_sum(covered, counts),
        "n_lines": per_row_sum(filled, n_lines),
        "n_upper": by_bytes(_UPPER[data]),
        "n_digits": by_bytes(_DIGIT[data]),
        "n_marks": by_bytes(_MARK[data]),
        "n_distinct": per_row_sum(~again, counts),
    }


def text_stats(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), name: str = "stats") -> DataFrame:
    """The kept columns and a struct of COUNTS of the column text."""
    picked = docs.select(*keep) if "text" in keep else docs.select(*keep, "text")
    fields = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])
    schema = T.StructType([f for f in picked.schema.fields if f.name in keep] + [T.StructField(name, fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure(c) for c in chunks(batch.column("text"))]
            columns = [pa.array(np.concatenate([f[c] for f in found]) if found else [], pa.int64()) for c in COUNTS]
            stats = pa.StructArray.from_arrays(columns, list(COUNTS))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), stats], [*keep, name])

    return map_batches(picked, run, schema)


def features(stats: Column) -> dict[str, Column]:
    """What thresholds are set on."""
    share = lambda a, b: F.coalesce(F.try_divide(stats[a].cast("double"), stats[b]), F.lit(0.0))
    return {
        "n_words": stats["n_words"].cast("double"),
        "symbol_share": share("n_symbols", "word_chars"),
        "upper_share": share("n_upper", "word_chars"),
        "digit_share": share("n_digits", "word_chars"),
        "mark_share": share("n_marks", "n_words"),
        "word_length": share("word_chars", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "distinct_share": share("n_distinct", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, values: np.ndarray) -> np.ndarray:
        return values > self.threshold if self.above else values <= self.threshold

    def column(self, values: dict[str, Column]) -> Column:
        value = values[self.feature]
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)


@dataclass(frozen=True)
class DecisionRule:
    """A conjunction that rejects, with its precision on the rows held out from growing."""

    conditions: tuple[Condition, ...]
    precision: float
    support: int


def _covers(conditions: tuple[Condition, ...], data: dict[str, np.ndarray]) -> np.ndarray:
    inside = np.ones(len(next(iter(data.values()))), bool)
    for c in conditions:
        inside &= c.holds(data[c.feature])
    return inside


def _grow(data: dict[str, np.ndarray], bad: np.ndarray, most: int, cuts: int) -> tuple[Condition, ...]:
    """Adds the condition of the highest gain until no good row is left inside or nothing is gained."""
    found: tuple[Condition, ...] = ()
    inside = np.ones(len(bad), bool)
    while len(found) < most:
        p, n = int(bad[inside].sum()), int((~bad[inside]).sum())
        if not p or not n:
            break
        base, best = np.log2(p / (p + n)), (1e-9, None)
        for feature, values in data.items():
            here, is_bad = values[inside], bad[inside]
            order = np.argsort(here, kind="stable")
            ordered, bads = here[order], np.cumsum(is_bad[order])
            edges = np.flatnonzero(ordered[1:] > ordered[:-1])
            edges = edges[np.unique(np.linspace(0, len(edges) - 1, min(cuts, len(edges))).astype(int))] if len(edges) else edges
            for above in (False, True):
                ps = bads[-1] - bads[edges] if above else bads[edges]
                totals = len(here) - 1 - edges if above else edges + 1
                gains = np.where(ps > 0, ps * (np.log2(np.maximum(ps, 1) / totals) - base), -1.0)
                if len(gains) and gains.max() > best[0]:
                    k = int(gains.argmax())
                    best = (gains[k], Condition(feature, above, float((ordered[edges[k]] + ordered[edges[k] + 1]) / 2)))
        if best[1] is None:
            break
        found += (best[1],)
        inside &= best[1].holds(data[best[1].feature])
    return found


def learn(data: dict[str, np.ndarray], bad: np.ndarray, *, precision: float = 0.9, support: int = 5, most_rules: int = 24, most_conditions: int = 5, cuts: int = 256, seed: int = 11) -> list[DecisionRule]:
    """An ordered list of rules that reject. A third of the rows prunes, the rest grows."""
    rules: list[DecisionRule] = []
    if not len(bad):
        return rules
    prunes = np.random.default_rng(seed).permutation(len(bad)) % 3 == 0
    left = np.ones(len(bad), bool)
    while len(rules) < most_rules:
        grows, tests = left & ~prunes, left & prunes
        if bad[grows].sum() < support:
            break
        grown = _grow({f: v[grows] for f, v in data.items()}, bad[grows], most_conditions, cuts)
        held, is_bad = {f: v[tests] for f, v in data.items()}, bad[tests]
        best = (-1.0, ())
        for k in range(len(grown), 0, -1):
            inside = _covers(grown[:k], held)
            p, n = int(is_bad[inside].sum()), int((~is_bad[inside]).sum())
            worth = (p - n) / (p + n) if p + n else -1.0
            if worth >= best[0]:
                best = (worth, grown[:k])
        inside = _covers(best[1], held) if best[1] else np.zeros(len(is_bad), bool)
        p, total = int(is_bad[inside].sum()), int(inside.sum())
        if total < support or p < precision * total:
            break
        rules.append(DecisionRule(best[1], p / total, total))
        left &= ~_covers(best[1], data)
    return rules


def verdict(rules: list[DecisionRule], stats: Column) -> Column:
    """The number, from 1, of the first rule that rejects; 0 where none does."""
    values = features(stats)
    out = None
    for k, rule in enumerate(rules, 1):
        inside = F.lit(True)
        for c in rule.conditions:
            inside &= c.column(values)
        out = F.when(inside, k) if out is None else out.when(inside, k)
    return F.lit(0) if out is None else out.otherwise(0)


def learn_from(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[DecisionRule]:
    """A list learned from the labelled rows of docs; labels has doc_id and quality, 0 for bad."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    stats = text_stats(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), ("doc_id", "quality"))
    one = stats.groupBy("doc_id", "quality").agg(F.min("stats").alias("stats"))
    values = features(F.col("stats"))
    rows = one.orderBy("doc_id").select("quality", *(v.alias(k) for k, v in values.items())).toPandas()
    return learn({k: rows[k].to_numpy(float) for k in values}, rows["quality"].to_numpy() == 0)


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < 50) | (100 * stats["n_repeat_words"] > 50 * stats["n_words"])


def judge(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per row: doc_id, stats, base_failed, rule (of the learned list, 0: none) and kept."""
    rules = learn_from(docs, labels, sample)
    out = text_stats(docs).withColumns({"base_failed": base_failed(F.col("stats")), "rule": verdict(rules, F.col("stats"))})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    rules = learn_from(docs, labels, sample)
    name = "stats"
    while name in docs.columns:
        name += "_"
    stats = F.col(name)
    return text_stats(docs, tuple(docs.columns), name).where(~base_failed(stats) & (verdict(rules, stats) == 0)).drop(name)
