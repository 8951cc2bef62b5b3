"""Spelling variants: each word's near words, at one inserted, deleted or replaced code point, and the form it leads to.

Two words are near if, for some edit position i of the longer one, w, of length c, the other has the prefix w[:i] and the
suffix w[i+1:], and is of length c (replaced) or c - 1 (deleted). In the forward order of words those with the prefix are
an interval, in the order of reversed words those with the suffix are; a wavelet tree over the places in both orders
reports what lies in both. Of a run of equal letters only the first one is deleted, so a pair is reported at one position.

A cell is the words of lengths c and c - 1 that agree before position a and after position b, with the edit positions
from a to b: at first all words, from 0 to c. A cell with more than CELL words or CELL_BYTES is cut at the middle
position, and a word goes to both halves, as its prefix is longer in one and its suffix in the other. So a table of any
size is cells that fit a task: at one position no cell has more words than there are letters, and one. No pair leaves a
task: a word's cells send how many near words they hold and the best of them.

Null texts have no words; a null id counts as empty in the hash; repeated rows count as often as they occur. Texts are
read whole, whatever their length, and so are words. Columns besides doc_id and text aren't read. An empty table gives no
rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER, map_batches
from .components import group_bounds, whole_groups
from .lineage import stored

#: Fixed by the contract: what is counted, and which runs lose a code point.
LEAST_LENGTH, LEAST_COUNT, EDITED = 5, 3, 97
RUN = re.compile(r"[A-Za-zÀ-ÿ]{%d,}" % LEAST_LENGTH)
#: Words, and bytes of words, of a cell; distinct words that a task counts before it sends them; queries at a time.
CELL, CELL_BYTES, HELD, QUERIES = 1 << 13, 1 << 24, 1 << 18, 1 << 16
_LOWER = LOWER.tobytes()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of texts, edited where the hash of id and run says so, with how often each occurs in about HELD words."""
    found: Counter[str] = Counter()

    def sent() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])

    for batch in batches:
        for i in range(batch.num_rows):
            text = batch.column("text")[i].as_py()
            if not text:
                continue
            begin = zlib.crc32(f"{batch.column('id')[i].as_py()}:".encode())
            # a run with fewer code points is no word, edited or not
            for run, n in Counter(RUN.findall(text.translate(_LOWER).decode(errors="replace"))).items():
                h = zlib.crc32(run.encode(), begin)
                if h % EDITED == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]
                    if len(run) < LEAST_LENGTH:
                        continue
                found[run] += n
            if len(found) > HELD:
                yield sent()
                found.clear()
    if found:
        yield sent()


def vocabulary(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """word and n, how often it occurs in all texts, of words that occur often enough."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("text").cast("binary").alias("text"))
    counts = map_batches(rows, _counted, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class WaveletTree:
    """A permutation by the bits of its values, the highest first: at each level zeros come before ones, in their order."""

    def __init__(self, values: np.ndarray):
        self.levels = max(1, int(len(values) - 1).bit_length())
        self.zeros: list[np.ndarray] = []
        for level in reversed(range(self.levels)):
            ones = (values >> level) & 1 == 1
            self.zeros.append(np.append(0, np.cumsum(~ones)))
            values = np.concatenate((values[~ones], values[ones]))

    def report(self, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each query the values from low to high (exclusive) at places from left to right (exclusive): query and value."""
        query, node = np.arange(len(left)), np.zeros(len(left), np.int64)
        for level, zeros in zip(reversed(range(self.levels)), self.zeros, strict=True):
            l0, r0 = zeros[left], zeros[right]
            sides = (l0, r0, 2 * node), (zeros[-1] + left - l0, zeros[-1] + right - r0, 2 * node + 1)
            found = []
            for l, r, v in sides:  # noqa: E741
                some = np.flatnonzero((l < r) & (v << level < high[query]) & ((v + 1) << level > low[query]))
                found.append((query[some], l[some], r[some], v[some]))
            query, left, right, node = (np.concatenate(c) for c in zip(*found, strict=True))
        return query, node


def _order(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of zero-padded letters in their order, and how many letters each has in common with the one before."""
    order = np.argsort(np.ascontiguousarray(letters).view(f"S{letters.shape[1]}").ravel(), kind="stable")
    ordered = letters[order]
    return order, np.append(-1, (ordered[1:] != ordered[:-1]).argmax(1))


def _interval(common: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each place in an order where the words that share its first letters begin and end."""
    begin = np.flatnonzero(common < length)
    run = np.cumsum(common < length) - 1
    return begin[run], np.append(begin[1:], len(common))[run]


def near_in_cell(words: list[bytes], c: int, a: int, b: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (word of length c, near word), as indices, whose edit position in the first lies from a to b.

    words are distinct, a byte a code point, of lengths c and c - 1.
    """
    size = len(words)
    if size < 2:
        return
    lengths = np.array([len(w) for w in words])
    letters = np.frombuffer(b"".join(w.ljust(c, b"\0") for w in words), np.uint8).reshape(size, c)
    reverse = np.frombuffer(b"".join(w[::-1].ljust(c, b"\0") for w in words), np.uint8).reshape(size, c)
    forward, before = _order(letters)
    backward, after = _order(reverse)
    place, behind = np.empty(size, np.int64), np.empty(size, np.int64)
    place[forward], behind[backward] = np.arange(size), np.arange(size)
    tree = WaveletTree(behind[forward])
    long = np.flatnonzero(lengths == c)
    held: list[tuple[np.ndarray, ...]] = []

    def answered() -> tuple[np.ndarray, np.ndarray]:
        asks, first, *bounds = (np.concatenate(x) for x in zip(*held, strict=True))
        query, value = tree.report(*bounds)
        hit, asked = backward[value], asks[query]
        good = (hit != asked) & ((lengths[hit] == c) | first[query])
        return asked[good], hit[good]

    for i in range(a, b):
        left, right = _interval(before, i)
        low, high = _interval(after, c - 1 - i)
        p, s = place[long], behind[long]
        some = (right[p] - left[p] > 1) & (high[s] - low[s] > 1)
        ask, p, s = long[some], p[some], s[some]
        if len(ask):
            first = letters[ask, i] != letters[ask, i - 1] if i else np.ones(len(ask), bool)
            held.append((ask, first, left[p], right[p], low[s], high[s]))
        if sum(len(h[0]) for h in held) >= QUERIES:
            yield answered()
            held.clear()
    if held:
        yield answered()


def _best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of whole cells: each word with a near one there, how many, and the one of largest n, of equal ones the least word."""
    for table in whole_groups(batches, ["cell"], 1024):
        bounds = group_bounds(table, ["cell"])
        for from_, to in zip(bounds[:-1], bounds[1:], strict=True):
            if to - from_ < 2:
                continue
            group = table.slice(from_, to - from_)
            names = np.array(group.column("word").to_pylist(), object)
            words = [w.encode("latin-1") for w in names]
            n = group.column("n").to_numpy()
            lengths, c = np.array([len(w) for w in words]), group.column("c")[0].as_py()
            rank = np.argsort(np.argsort(np.array(words), kind="stable"))
            by_worth = np.lexsort((-rank, n))  # by n, of equal ones the least word last
            worth = np.argsort(by_worth)
            count, best = np.zeros(len(words), np.int64), np.full(len(words), -1)
            for x, y in near_in_cell(words, *(group.column(k)[0].as_py() for k in "cab")):
                short = np.flatnonzero(lengths[y] < c)
                one, other = np.concatenate((x, y[short])), np.concatenate((y, x[short]))
                count += np.bincount(one, minlength=len(words))
                np.maximum.at(best, one, worth[other])
            some = np.flatnonzero(count)
            columns = [pa.array(names[some], pa.string()), pa.array(count[some]), pa.array(n[by_worth[best[some]]]), pa.array(names[by_worth[best[some]]], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["word", "n_near", "best_n", "best"])


def cells(words: DataFrame, cell: int | None = None) -> DataFrame:
    """word, n, c, a, b and cell: each word under its own length c and the next one, in cells of bounded size."""
    cell = cell or CELL

    def named(rows: DataFrame) -> DataFrame:
        outside = F.col("c") - F.col("b")
        return rows.withColumn("cell", F.xxhash64("c", "a", "b", F.substring("word", F.lit(1), F.col("a")), F.right("word", outside)))

    length = F.length("word")
    rows = words.select("word", "n", F.explode(F.array(length, length + 1)).alias("c"), F.lit(0).alias("a"))
    rows = stored(named(rows.withColumn("b", F.col("c"))))
    done = []
    while True:
        sizes = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("members"), F.first("c").alias("width"), F.max(F.col("b") - F.col("a")).alias("positions"))
        large = (F.col("members") > cell) | (F.col("members") * F.col("width") > CELL_BYTES)
        over = stored(sizes.where(large & (F.col("positions") > 1)).select("cell"))
        if over.isEmpty():
            return _all(done, rows)
        done.append(rows.join(over, "cell", "left_anti"))
        middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
        halves = F.explode(F.array(F.struct("a", middle.alias("b")), F.struct(middle.alias("a"), "b"))).alias("half")
        rows = stored(named(rows.join(over, "cell", "left_semi").select("word", "n", "c", halves).select("word", "n", "c", "half.a", "half.b")))


def _all(parts: list[DataFrame], last: DataFrame) -> DataFrame:
    for part in parts:
        last = last.unionByName(part)
    return last


def near_words(words: DataFrame, cell: int | None = None) -> DataFrame:
    """Per word of words (word, n) with a near one: word, n_near, best_n and best."""
    grouped = cells(words, cell).repartition("cell").sortWithinPartitions("cell")
    found = map_batches(grouped, _best, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("one")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("one.less")).alias("best_n"), "one.best")


def roots(forms: DataFrame) -> DataFrame:
    """Per word of forms (word, form), where words follow no circle: word and root, the last of its forms.

    Each round doubles how many forms a word has followed. Words are one row each, and so is what they meet in the join;
    those that share a form are a skewed join with one row on the other side, which adaptive execution splits.
    """
    going = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        further = going.select(F.col("word").alias("at"), F.col("root").alias("beyond"))
        moved = stored(going.join(further, F.col("root") == F.col("at"), "left").select("word", "root", "beyond"))
        if moved.where("beyond is not null").isEmpty():
            return moved.select("word", "root")
        going = moved.select("word", F.coalesce("beyond", "root").alias("root"))


def variants(docs: DataFrame, least: int = LEAST_COUNT, cell: int | None = None) -> DataFrame:
    """Per word: word, n, n_near (near words), form (the near word of largest n, the least of equal ones, if that n is
    twice the word's or more), form_n, and root, where following forms ends (the word itself if it has none)."""
    words = stored(vocabulary(docs, least))
    near = near_words(words, cell)
    leads = F.col("best_n") >= 2 * F.col("n")
    out = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(leads, F.col("best")).alias("form"), F.when(leads, F.col("best_n")).alias("form_n"))
    out = stored(out)
    return out.join(roots(out.where("form is not null")), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
