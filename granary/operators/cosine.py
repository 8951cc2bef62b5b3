"""The nearest train row of each query row by TF-IDF cosine: packed blocks of rows, compared block by block.

Terms are 64-bit hashes. A sample chooses which terms are the head (bounded, broadcast, numbered by how common they seem);
that decides where a term's numbers travel, not what they are. The terms of the head are counted over all rows. The postings
of all other terms are dealt once by ranges of hashes, as packed arrays; there their texts are counted, and back to the
rows go what a row's length takes from them and those postings whose term stands on both sides. ROWS rows of known
lengths become one packed block in order of terms.

Each block of queries meets each block of train rows. The DENSE most common terms are multiplied as matrices in single
precision, the others by their postings; whatever is within the error bound of a query's best is compared again in double
precision. So no pair of rows is written, stored or dealt: disk grows with the postings, time with the pairs.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import stored, stored_alone

#: Most terms of the head, rows that choose it, and of those rows the fewest that hold a term of it.
HEAD, SAMPLE, SEEN = 65_536, 4_096, 3
#: Postings dealt to a range of hashes (about), packed at a time, and products expanded at a time; rows of a block.
RANGE, PACKED, EXPANDED, ROWS = 1_000_000, 500_000, 200_000, 1_024
#: Terms multiplied as matrices, so many at a time; queries at a time; blocks of train rows and of queries that a task takes.
DENSE, SLAB, STRIPE, MEET, ASK = 2_048, 1_024, 256, 32, 4
#: Most that a sum of products, together 1 at most, is off in single precision.
OFF = (DENSE + 64) * 2.0**-24

#: Of an Arrow batch between Spark and a worker: about the most bytes, or one longer row.
BATCH_BYTES = 2 << 20

Batches = Iterator[pa.RecordBatch]


def bounded(spark: SparkSession) -> None:
    """Bounds Arrow batches for this session, unless the application was started with a bound."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.sparkContext.getConf().contains(key):
        spark.conf.set(key, BATCH_BYTES)


def release() -> None:
    """Gives memory that a task freed back to the system: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # the GNU library alone has it
        trim(0)


def packed(values: np.ndarray) -> np.ndarray:
    """The values as the narrowest unsigned integers that hold them."""
    return values.astype(np.min_scalar_type(int(values.max())) if len(values) else np.uint8)


def unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"u{len(data) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def idf(total: int, df: np.ndarray) -> np.ndarray:
    return np.log((1 + total) / (1 + df)) + 1


def head_of(some: DataFrame, share: float, rare: int) -> np.ndarray:
    """Hashes of terms that seem to be in more than `rare` texts, the most common first; some: that share of the rows."""
    seen = some.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").count()
    return np.array([r.term for r in seen.where(F.col("count") > max(SEEN - 1, rare * share)).orderBy(F.desc("count"), "term").limit(HEAD).collect()], np.int64)


def _counted(head: Broadcast) -> Callable[[Batches], Batches]:
    """Each row's terms, counted: of the head as numbers, else as hashes."""

    def run(batches: Batches) -> Batches:
        places = np.argsort(head.value)
        hashes = head.value[places]
        for batch in batches:
            out = []
            lists = batch.column("terms")
            values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                terms, tf = np.unique(values[a:b], return_counts=True)
                at = np.searchsorted(hashes, terms)
                held = np.zeros(len(terms), bool)
                inside = at < len(hashes)
                held[inside] = hashes[at[inside]] == terms[inside]
                out.append((places[at[held]].astype(np.uint16).tobytes(), packed(tf[held]).tobytes(), terms[~held].tobytes(), packed(tf[~held]).tobytes()))
            cols = [pa.array([o[k] for o in out], pa.binary()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "asks", "ord", "cve_id")), *cols], ["row", "asks", "ord", "cve_id", "head", "head_tf", "tail", "tail_tf"])

    return run


def _head_counts(batches: Batches) -> Batches:
    n = np.zeros(HEAD, np.int64)
    for batch in batches:
        for data in batch.column("head").to_pylist():
            n[np.frombuffer(data, np.uint16)] += 1
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["place", "n"])


def _ranges(ranges: int) -> Callable[[Batches], Batches]:
    """Postings of the terms outside the head, packed by ranges of hashes; sides: twice the row, and 1 for a query."""

    def piece(hashes: np.ndarray, sides: np.ndarray, tf: np.ndarray) -> pa.RecordBatch:
        at = ((hashes.view(np.uint64) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        hashes, tf, least = hashes[order], packed(tf[order]), int(sides.min())
        sides = packed(sides[order] - least)
        keys, first = np.unique(at[order], return_index=True)
        cut = lambda a: pa.array([a[i:j].tobytes() for i, j in zip(first, [*first[1:], len(a)], strict=True)], pa.binary())
        n = np.diff([*first, len(hashes)])
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n), pa.array(np.full(len(keys), least)), cut(hashes), cut(sides), cut(tf)], ["range", "n", "least", "hashes", "sides", "tf"])

    def run(batches: Batches) -> Batches:
        held, size = [], 0
        for batch in batches:
            for row, asks, tail, tf in zip(*(batch.column(c).to_pylist() for c in ("row", "asks", "tail", "tail_tf")), strict=True):
                n = len(tail) // 8
                held.append((np.frombuffer(tail, np.int64), np.full(n, 2 * row + asks), unpacked(tf, n)))
                size += n
                if size >= PACKED:
                    yield piece(*map(np.concatenate, zip(*held, strict=True)))
                    held, size = [], 0
        if size:
            yield piece(*map(np.concatenate, zip(*held, strict=True)))
        held.clear()
        release()

    return run


def _returned(total: int, min_df: int) -> Callable[[pa.Table], pa.Table]:
    """Of a range of hashes, by block of rows: squares for the rows' lengths, and the postings that stand on both sides.

    Terms are numbered through the range; their numbers are told apart from those of others by the range.
    """

    def run(table: pa.Table) -> pa.Table:
        found = table.to_pydict()
        n = found["n"]
        hashes = np.concatenate([np.frombuffer(x, np.int64) for x in found["hashes"]])
        sides = np.concatenate([unpacked(x, k) + least for x, k, least in zip(found["sides"], n, found["least"], strict=True)])
        tf = np.concatenate([unpacked(x, k) for x, k in zip(found["tf"], n, strict=True)])
        order = np.argsort(hashes)
        hashes, sides, tf = hashes[order], sides[order], tf[order]
        starts = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
        sizes = np.diff([*starts, len(hashes)])
        asks = np.add.reduceat(sides & 1, starts)
        term = np.repeat(np.arange(len(starts)), sizes)
        kept = sizes[term] >= min_df
        both = ((asks > 0) & (asks < sizes))[term][kept]
        term, row, tf = term[kept], sides[kept] >> 1, tf[kept]
        df = sizes[term]
        square = ((1 + np.log(tf)) * idf(total, df)) ** 2
        order = np.argsort(row, kind="stable")
        term, row, tf, df, square, both = (x[order] for x in (term, row, tf, df, square, both))
        blocks, first = np.unique(row // ROWS, return_index=True)
        out = []
        for block, a, b in zip(blocks.tolist(), first, [*first[1:], len(row)], strict=True):
            here, on = row[a:b] - block * ROWS, both[a:b]
            rows, at = np.unique(here, return_inverse=True)
            out.append((block, found["range"][0], len(rows), rows.astype(np.uint16).tobytes(), np.bincount(at, square[a:b]).tobytes(), int(on.sum()), *(packed(x[on]).tobytes() for x in (here, term[a:b], tf[a:b], df[a:b]))))
        release()
        return pa.Table.from_pylist([dict(zip(_RETURNED.names, o, strict=True)) for o in out], _RETURNED)

    return run


_RETURNED = pa.schema([("block", pa.int64()), ("range", pa.int64()), ("rows", pa.int64()), ("of", pa.binary()), ("squares", pa.binary()), ("n", pa.int64()), ("row", pa.binary()), ("term", pa.binary()), ("tf", pa.binary()), ("df", pa.binary())])
_BLOCK = pa.schema([("asks", pa.bool_()), ("named", pa.list_(pa.int64())), ("names", pa.list_(pa.string())), ("ids", pa.binary()), ("ords", pa.binary()), ("norms", pa.binary()), ("n", pa.int64()), ("tail_n", pa.int64()), ("terms", pa.binary()), ("rows", pa.binary()), ("tf", pa.binary()), ("tail_terms", pa.binary()), ("tail_df", pa.binary())])


def _assembled(weights: Broadcast) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A block of rows and what the ranges return to it: one packed block of its queries, one of its train rows.

    Postings stand in order of terms, those of the head first; a term outside it has its range and number as one number.
    """

    def run(table: pa.Table, returned: pa.Table) -> pa.Table:
        rows, back = table.sort_by("row").to_pydict(), returned.to_pydict()
        if not rows["row"]:
            return _BLOCK.empty_table()
        first = rows["row"][0] // ROWS * ROWS
        terms = [np.frombuffer(x, np.uint16).astype(np.int64) for x in rows["head"]]
        row = np.repeat(np.array(rows["row"]) - first, [len(x) for x in terms])
        tf = np.concatenate([unpacked(x, len(t)) for x, t in zip(rows["head_tf"], terms, strict=True)])
        terms = np.concatenate(terms)
        squares = np.bincount(row, ((1 + np.log(tf)) * weights.value[terms]) ** 2, ROWS).astype(float)  # of no rows: whole numbers
        for n, of, found in zip(back["rows"], back["of"], back["squares"], strict=True):
            squares[np.frombuffer(of, np.uint16)[:n]] += np.frombuffer(found, np.float64)
        tail = [np.concatenate([np.zeros(0, np.int64), *(unpacked(x, n) for x, n in zip(back[c], back["n"], strict=True))]) for c in ("row", "term", "tf", "df")]
        tail[1] += np.repeat(np.array(back["range"], np.int64) << 32, back["n"])
        on = weights.value[terms] > 0
        head = row[on], terms[on], tf[on]
        asks = np.array(rows["asks"])
        local = np.array(rows["row"]) - first
        out = []
        for side in (True, False):
            mine = np.flatnonzero(asks == side)
            if not len(mine):
                continue
            place = np.full(ROWS, -1)
            place[local[mine]] = np.arange(len(mine))
            h, t = (tuple(x[place[part[0]] >= 0] for x in part) for part in (head, tail))
            h, t = (tuple(x[np.lexsort((part[0], part[1]))] for x in part) for part in (h, t))
            pick = lambda c: [rows[c][k] for k in mine]  # noqa: E731, B023
            all_rows, all_tf = (packed(np.concatenate(x)).tobytes() for x in ((place[h[0]], place[t[0]]), (h[2], t[2])))
            ords = np.array([o or 0 for o in pick("ord")], np.int64)  # of queries none is asked for
            out.append((side, pick("row"), pick("cve_id"), np.array(pick("row"), np.int64).tobytes(), ords.tobytes(), np.sqrt(squares[local[mine]]).tobytes(), len(h[0]), len(t[0]), h[1].astype(np.uint16).tobytes(), all_rows, all_tf, t[1].tobytes(), packed(t[3]).tobytes()))
        return pa.Table.from_pylist([dict(zip(_BLOCK.names, o, strict=True)) for o in out], _BLOCK)

    return run


def row_blocks(texts: DataFrame, with_terms: Callable[[DataFrame], DataFrame], total: int, min_df: int, rare: int) -> tuple[DataFrame, Broadcast]:
    """Packed blocks of (row, asks, ord, cve_id, terms), and the weights of the head's terms."""
    spark = texts.sparkSession
    share = min(1.0, SAMPLE / total)
    chosen = F.pmod(F.xxhash64("cve_id"), F.lit(1_000_000)) < int(share * 1_000_000)  # a filter, so that it is met before joins and tokens
    head = spark.sparkContext.broadcast(head_of(with_terms(texts.where(chosen)), share, rare))
    rows = with_terms(texts).select(F.monotonically_increasing_id().alias("row"), "asks", "ord", "cve_id", "terms")
    counted = stored(rows.mapInArrow(_counted(head), "row long, asks boolean, ord long, cve_id string, head binary, head_tf binary, tail binary, tail_tf binary"))
    # without gaps, so that ROWS rows in a row are a block
    parts = counted.groupBy(F.shiftright("row", 33).alias("part")).count().orderBy("part").collect()
    starts = np.cumsum([0, *(p["count"] for p in parts)]).tolist()
    starts = spark.createDataFrame(pa.table({"part": pa.array([p.part for p in parts], pa.int64()), "start": pa.array(starts[:-1], pa.int64())}))
    counted = counted.join(F.broadcast(starts), F.shiftright("row", 33) == F.col("part")).withColumn("row", F.col("start") + F.col("row").bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "start")
    df = np.zeros(HEAD, np.int64)
    for r in counted.select("head").mapInArrow(_head_counts, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
        df[r.place] = r.n
    weights = spark.sparkContext.broadcast(np.where(df >= max(min_df, 1), idf(total, df), 0.0))
    postings = counted.agg(F.sum(F.length("tail"))).first()[0] // 8
    ranges = max(1, -(-postings // RANGE))
    dealt = counted.select("row", "asks", "tail", "tail_tf").mapInArrow(_ranges(ranges), "range long, n long, least long, hashes binary, sides binary, tf binary")
    kinds = "block long, range long, rows long, of binary, squares binary, n long, row binary, term binary, tf binary, df binary"
    back = dealt.groupBy("range").applyInArrow(_returned(total, min_df), kinds)
    mine = counted.select("row", "asks", "ord", "cve_id", "head", "head_tf", F.floor(F.col("row") / ROWS).alias("block"))
    kinds = "asks boolean, named array<long>, names array<string>, ids binary, ords binary, norms binary, n long, tail_n long, terms binary, rows binary, tf binary, tail_terms binary, tail_df binary"
    return mine.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_assembled(weights), kinds), weights


@dataclass
class Block:
    """Unit weights of a block of rows in order of terms, the first `dense` of them of the most common ones."""

    ids: np.ndarray
    ords: np.ndarray
    terms: np.ndarray
    rows: np.ndarray
    weights: np.ndarray
    dense: int
    starts: np.ndarray
    order: np.ndarray | None = None
    ends: np.ndarray | None = None

    @classmethod
    def read(cls, r: dict, head: np.ndarray, total: int) -> Block:
        n = r["n"] + r["tail_n"]
        terms = np.concatenate([np.frombuffer(r["terms"], np.uint16).astype(np.int64), np.frombuffer(r["tail_terms"], np.int64) + HEAD])
        rows = unpacked(r["rows"], n)
        weights = (1 + np.log(unpacked(r["tf"], n))) * np.concatenate([head[terms[: r["n"]]], idf(total, unpacked(r["tail_df"], r["tail_n"]))]) / np.frombuffer(r["norms"])[rows]
        dense = int(np.searchsorted(terms, DENSE))
        starts = np.flatnonzero(np.r_[True, terms[dense + 1 :] != terms[dense:-1]]) + dense if dense < n else np.zeros(0, np.int64)
        return cls(np.frombuffer(r["ids"], np.int64), np.frombuffer(r["ords"], np.int64), terms, rows, weights, dense, starts)

    def matrix(self, a: int) -> np.ndarray:
        """Of the terms a to a + SLAB."""
        i, j = np.searchsorted(self.terms[: self.dense], (a, a + SLAB))
        out = np.zeros((len(self.ids), SLAB), np.float32)
        out[self.rows[i:j], self.terms[i:j] - a] = self.weights[i:j]
        return out

    @cached_property
    def slabs(self) -> list[np.ndarray]:
        return [self.matrix(a) for a in range(0, DENSE, SLAB)]

    @cached_property
    def striped(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Postings beyond the dense ones by stripes of rows: their place in `starts`, row of the stripe and weight; where each stripe ends."""
        place = np.repeat(np.arange(len(self.starts)), np.diff(np.r_[self.starts, len(self.terms)]))
        stripe = (self.rows[self.dense :] // STRIPE).astype(np.uint16)
        order = np.argsort(stripe, kind="stable")
        ends = np.cumsum(np.bincount(stripe, minlength=-(-len(self.ids) // STRIPE)))
        return place[order], self.rows[self.dense :][order] % STRIPE, self.weights[self.dense :][order], ends

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rows' terms and weights, one row after another, and how many each has."""
        if self.order is None:
            self.order = np.argsort(self.rows.astype(np.uint16), kind="stable")
            self.ends = np.r_[0, np.cumsum(np.bincount(self.rows, minlength=len(self.ids)))]
        sizes = np.diff(self.ends)[rows]
        at = self.order[np.repeat(self.ends[rows] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())]
        return self.terms[at], self.weights[at], sizes


def products(q: Block, t: Block) -> np.ndarray:
    """All similarities of two blocks, within OFF and the rounding of a few numbers."""
    out = np.zeros((len(q.ids), len(t.ids)), np.float32)
    for a, left in zip(range(0, DENSE, SLAB), q.slabs, strict=True):
        right = t.matrix(a).T
        for k in range(0, len(out), STRIPE):
            out[k : k + STRIPE] += left[k : k + STRIPE] @ right
    right = None
    own, others = q.terms[q.starts], t.terms[t.starts]
    if not (len(own) and len(others)):
        return out
    # each posting of a query with all of its term's postings in t, the queries in stripes
    at = np.minimum(np.searchsorted(others, own), len(others) - 1)
    held = np.where(others[at] == own, np.diff(np.r_[t.starts, len(t.terms)])[at], 0)
    place, row, weight, ends = q.striped
    times = held[place]
    met = np.flatnonzero(times)
    times, row, weight, ends = times[met], row[met] * len(t.ids), weight[met], np.searchsorted(met, ends)
    upto = np.cumsum(times)
    shift = t.starts[at][place[met]] - (upto - times)
    a = 0
    for stripe, end in enumerate(ends.tolist()):
        part = out[stripe * STRIPE : (stripe + 1) * STRIPE]
        sums = np.zeros(part.size)
        while a < end:
            done = int(upto[a - 1]) if a else 0
            b = min(end, max(a + 1, int(np.searchsorted(upto, done + EXPANDED, "right"))))
            one = np.repeat(np.arange(a, b), times[a:b])
            to = shift[one] + np.arange(done, done + len(one))
            sums += np.bincount(row[one] + t.rows[to], weight[one] * t.weights[to], part.size)
            a = b
        part += sums.reshape(part.shape)
    return out


def _compared(head: Broadcast, total: int) -> Callable[[Batches], Batches]:
    """The best train row of each query, of the blocks that meet in a task."""

    def run(batches: Batches) -> Batches:
        best: dict[int, tuple[float, int, int]] = {}
        q, t, near = None, None, None
        for batch in batches:
            for pair in range(batch.num_rows):
                mine = batch.column("q")[pair]
                if mine.is_valid:
                    q = Block.read(mine.as_py(), head.value, total)
                    least = np.array([best.get(row, (0.0,))[0] for row in q.ids.tolist()])
                if q is None or q.ids[0] != batch.column("asking")[pair].as_py():
                    raise ValueError("a block of queries came without its rows")
                t = near = None
                t = Block.read(batch.column("t")[pair].as_py(), head.value, total)
                near = products(q, t)
                top = near.max(axis=1)
                for k in np.flatnonzero((top > 0) & (top >= least - 2 * OFF)).tolist():
                    row = int(q.ids[k])
                    rows = np.flatnonzero(near[k] >= max(float(top[k]), least[k]) - 2 * OFF)
                    terms, weights, _ = q.of(np.array([k]))
                    others, other_weights, sizes = t.of(rows)
                    at = np.minimum(np.searchsorted(terms, others), len(terms) - 1)
                    sums = np.bincount(np.repeat(np.arange(len(rows)), sizes), np.where(terms[at] == others, weights[at] * other_weights, 0.0), len(rows))
                    found = max(zip(np.round(sums, 9).tolist(), (-t.ords[rows]).tolist(), t.ids[rows].tolist(), strict=True), key=lambda x: x[:2])
                    best[row] = max(best.get(row, found), found, key=lambda x: x[:2])
                    least[k] = best[row][0]
        q = t = near = None
        release()
        out = [(row, *x) for row, x in best.items()]
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.int64(), pa.float64(), pa.int64(), pa.int64()))], ["asked", "similarity", "less", "row"])

    return run


def nearest_rows(texts: DataFrame, with_terms: Callable[[DataFrame], DataFrame], total: int, min_df: int, rare: int) -> DataFrame:
    """query_id (cve_id of a query row), train_id and similarity, to nine places; null where no term is shared.

    texts: total rows of asks, ord and cve_id, to which with_terms adds terms (hashes).
    """
    weights: list[Broadcast] = []
    bounded(texts.sparkSession)

    def made() -> DataFrame:
        blocks, head = row_blocks(texts, with_terms, total, min_df, rare)
        weights.append(head)
        return blocks

    blocks = stored_alone(texts.sparkSession, made)
    one = F.struct(*(c for c in blocks.columns if c not in ("asks", "named", "names")))
    asks, train = blocks.where("asks").select(F.col("named")[0].alias("asking"), one.alias("q")), blocks.where("NOT asks").select(one.alias("t"))
    n = asks.count()
    asks = asks.coalesce(max(n // ASK, min(n, blocks.sparkSession.sparkContext.defaultParallelism)))
    train = train.coalesce(max(1, train.count() // MEET)).withColumn("first", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0)
    # each block of queries meets all train blocks of a task before the next one does, so it travels with the first of them only
    meeting = asks.hint("shuffle_replicate_nl").crossJoin(train).select("asking", F.when(F.col("first"), F.col("q")).alias("q"), "t")
    found = meeting.mapInArrow(_compared(weights[0], total), "asked long, similarity double, less long, row long")
    best = found.groupBy("asked").agg(F.max_by(F.struct("row", "similarity"), F.struct("similarity", "less")).alias("best")).select("asked", "best.*")
    named = blocks.select("asks", F.explode(F.arrays_zip("named", "names")).alias("one")).select("asks", F.col("one.named").alias("id"), F.col("one.names").alias("name"))
    asked = named.where("asks").select(F.col("id").alias("asked"), F.col("name").alias("query_id"))
    answers = named.where("NOT asks").select(F.col("id").alias("row"), F.col("name").alias("train_id"))
    return asked.join(best, "asked", "left").join(answers, "row", "left").select("query_id", "train_id", "similarity")
