"""Connected components of a table of links, and streams of whole groups for Arrow functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import stored

#: Rows of a file that a round of `components` writes, at the least.
FILE_ROWS = 1 << 14


def label_pairs(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n members the least member of its component under the links a - b."""
    labels = np.arange(n)
    while True:
        least = np.minimum(labels[a], labels[b])
        new = labels.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if np.array_equal(new, labels):
            return labels
        labels = new


def components(links: DataFrame) -> DataFrame:
    """Per node of links (a, b): node and label, the least node of its component.

    Each round gives every node the least label among its neighbours and itself, then the label's own label, so the
    number of rounds grows with the logarithm of a component's width in practice. Rounds are written to the shared
    folder, in files of about FILE_ROWS rows or more, so that few links aren't as many files as a shuffle has partitions.
    Minima are combined before each shuffle; a node with very many links is a skewed join with one row on the other side,
    which adaptive execution splits.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct())
    files = max(1, -(-both.count() // FILE_ROWS))
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")).coalesce(files))
    while True:
        seen = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("seen"))
        near = labels.join(seen, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        far = labels.select(F.col("node").alias("at"), F.col("label").alias("further"))
        new = stored(near.join(far, F.col("label") == F.col("at"), "left").select("node", "old", F.least("label", "further").alias("label")).coalesce(files))
        labels = new.select("node", "label")
        if new.where("old <> label").isEmpty():
            return labels


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 4096) -> Iterator[pa.Table]:
    """Batches sorted by the keys, cut anew where the keys change, each with about so many rows or one larger group."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        same = np.ones(table.num_rows, bool)
        for k in keys:
            column = table.column(k)
            same &= np.asarray(pa.compute.equal(column, column[-1]).fill_null(False))
        last = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if last:
            yield table.slice(0, last)
        held = table.slice(last).to_batches()
        count = table.num_rows - last
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def group_bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where the groups of a sorted table begin, and its length."""
    change = np.zeros(table.num_rows, bool)
    change[0] = True
    for k in keys:
        column = table.column(k).combine_chunks()
        change[1:] |= ~np.asarray(pa.compute.equal(column.slice(1), column.slice(0, len(column) - 1)).fill_null(False))
    return np.append(np.flatnonzero(change), table.num_rows)
