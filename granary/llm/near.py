"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of five-word shingles (a shorter text with a word is one shingle). Those with equal sets form a
class, and only classes are compared. Candidates are classes whose MinHash values agree in a whole band. A pair's
values are then compared ROUND at a time, and the pair is dropped once the posterior probability that its similarity
reaches the threshold, given the agreements so far and a uniform prior, is below TOLERANCE. What is left is verified
exactly on the shingles.

How groups stay small: a band's bucket, and a cluster of surviving candidates, is cut into blocks of BLOCK members,
and each pair of blocks is a group of its own, so no task holds more than two blocks; pairs are counted where they are
compared and never become rows. What leaves a group is one row per member: its links, and the least member it is
linked to. Bands, blocks and rounds decide only where a pair is compared; no partner is dropped.

A band misses a pair at similarity 0.8 with probability 1 - 0.8 ** 4, all 24 with 0.59 ** 24 = 3e-6.

A text without words (null, empty) links to nothing. A null id takes part but never names a class, so a class of null
ids alone has a null name. Texts are read whole, whatever their length; a pair takes both sets in one task. Names go to the
least id, then the least hash of the text. Repeated rows are copies of each other. Other columns are not read. An empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import chunks, map_batches, mix, repeated, shingles
from .components import components, group_bounds, label_pairs, whole_groups
from .lineage import free_prefix, stored

WIDTH, BANDS, ROWS, ROUND, TOLERANCE, BLOCK = 5, 24, 4, 16, 1e-6, 1024
HASHES = BANDS * ROWS
#: Pairs whose values a task compares at a time, with some 200 bytes each.
PAIRS = 1 << 17
#: Hash positions that mark which texts are needed again: the broadcast table of them has at most so many rows.
POSITIONS = 1 << 20

#: What names a row, in order: whether its id is null, its id, its text's hash.
NAME = ("none", "doc_id", "mark")

_FACTORS = mix(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)


def set_keys(found: np.ndarray, per_row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row's shingles: 16 bytes that name the set, its size, and which shingles are the first of their kind."""
    rows = np.arange(len(per_row), dtype=np.uint64)
    _, later = repeated(mix(found ^ np.repeat(mix(rows), per_row)))
    once = ~later
    bounds = np.concatenate(([0], np.cumsum(per_row)))

    def total(values: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values, out=sums[1:])
        return sums[bounds[1:]] - sums[bounds[:-1]]

    names = np.stack((total(np.where(once, mix(found), np.uint64(0))), total(np.where(once, mix(found ^ np.uint64(0x5851F42D4C957F2D)), np.uint64(0)))), 1)
    return names, total(once.astype(np.uint64)).astype(np.int64), once


def signatures(found: np.ndarray, per_row: np.ndarray) -> np.ndarray:
    """HASHES MinHash values of 32 bits for each row; 0 for a row without shingles."""
    out = np.zeros((len(per_row), HASHES), np.uint32)
    filled = np.flatnonzero(per_row)
    if len(filled):
        begin = (np.cumsum(per_row) - per_row)[filled]
        hashed = np.empty_like(found)
        for k in range(HASHES):
            np.multiply(found, _FACTORS[k], out=hashed)
            out[filled, k] = np.minimum.reduceat(hashed, begin) >> np.uint64(32)
    return out


def _fixed(values: np.ndarray) -> pa.Array:
    """Rows of an array as binary values."""
    n, width = values.shape[0], values.shape[1] * values.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), n, [None, pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _matrix(column: pa.ChunkedArray, dtype, width: int) -> np.ndarray:
    """Binary values of one length as rows of an array."""
    whole = column.combine_chunks()
    whole = whole.chunk(0) if isinstance(whole, pa.ChunkedArray) else whole
    return np.frombuffer(b"".join(whole.to_pylist()), dtype).reshape(-1, width)


def sign(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, mark (a hash of the text), node (the name of its set), shingles (how many) and its signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column("text")):
                found, per_row, _ = shingles(c, WIDTH)
                names, sizes, once = set_keys(found, per_row)
                kept = np.diff(np.concatenate(([0], np.cumsum(once)))[np.concatenate(([0], np.cumsum(per_row)))])
                part = batch.slice(c.first, c.n)
                columns = [part.column("doc_id"), part.column("mark"), _fixed(names), pa.array(sizes), _fixed(signatures(found[once], kept))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "node", "shingles", "signature"])

    slim = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    kind = slim.schema["doc_id"].dataType.simpleString()
    return map_batches(slim, run, f"doc_id {kind}, mark long, node binary, shingles long, signature binary")


def least_agreements(threshold: float, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """After how many values compared, the fewest agreements at which a pair stays."""
    out = []
    for n in range(ROUND, HASHES + 1, ROUND):
        below = [comb(n + 1, k) * threshold**k * (1 - threshold) ** (n + 1 - k) for k in range(n + 2)]
        posterior = np.cumsum(below)  # at m: the probability that the similarity reaches the threshold
        out.append((n, int(np.argmax(posterior[: n + 1] >= tolerance))))
    return out


def surviving(signs: np.ndarray, a: np.ndarray, b: np.ndarray, least: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows a, b that no round drops."""
    agreed, done = np.zeros(len(a), np.int64), 0
    for n, fewest in least:
        agreed += (signs[a, done:n] == signs[b, done:n]).sum(1)
        stay = agreed >= fewest
        a, b, agreed, done = a[stay], b[stay], agreed[stay], n
    return a, b


def _pairs(bounds: np.ndarray, side: np.ndarray, most: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs i < j of each group, about `most` at a time; of a group of two sides only those across."""
    size = np.diff(bounds)
    after = np.repeat(bounds[1:], size) - np.arange(bounds[-1]) - 1  # partners behind each member, in its group
    begin = 0
    while begin < len(after):
        total = np.cumsum(after[begin:])
        end = begin + max(1, int(np.searchsorted(total, most, side="right")))
        n = after[begin:end]
        a = np.repeat(np.arange(begin, end), n)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        across = (side[a] < 0) | (side[a] != side[b])
        yield a[across], b[across]
        begin = end


def in_blocks(members: DataFrame, key: str, size: str, order: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """Members of groups with a known size, once for each pair of blocks they belong to, by order in each.

    first and second are the pair's blocks; side is the member's block in a pair of two, -1 in a pair of one with itself.
    A member's block is set by its node.
    """
    n = F.ceil(F.col(size) / block).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(7)), n).cast("int")
    rows = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    rows = rows.withColumns({"first": F.least("own", "other"), "second": F.greatest("own", "other")})
    rows = rows.withColumn("side", F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own")))
    # a pair of two blocks gets both blocks' members: own meets other from either side
    return rows.repartition(key, "first", "second").sortWithinPartitions(key, "first", "second", *order)


def _candidate_links(threshold: float):
    least = least_agreements(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["key", "first", "second"]
        for table in whole_groups(batches, keys):
            signs = _matrix(table.column("signature"), np.uint32, HASHES)
            bounds, side = group_bounds(table, keys), table.column("side").to_numpy()
            labels = np.arange(table.num_rows)
            for a, b in _pairs(bounds, side):
                a, b = surviving(signs, a, b, least)
                if len(a):
                    labels = np.minimum(labels, label_pairs(np.concatenate((a, np.arange(len(labels)))), np.concatenate((b, labels)), len(labels)))
            at = np.flatnonzero(labels != np.arange(len(labels)))
            nodes = table.column("node")
            yield pa.RecordBatch.from_arrays([nodes.take(at).combine_chunks().cast(pa.binary()), nodes.take(labels[at]).combine_chunks().cast(pa.binary())], ["a", "b"])

    return run


def _verified(threshold: float):
    least = least_agreements(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["label", "first", "second"]
        for table in whole_groups(batches, keys, 512):
            signs = _matrix(table.column("signature"), np.uint32, HASHES)
            copies, side = table.column("copies").to_numpy(), table.column("side").to_numpy()
            bounds = group_bounds(table, keys)
            text = table.column("text").combine_chunks()
            parts = [shingles(c, WIDTH)[:2] for c in chunks(text)]
            found, per_row = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            ends = np.cumsum(per_row)
            links, labels = np.zeros(table.num_rows, np.int64), np.arange(table.num_rows)
            for low, high in zip(bounds[:-1], bounds[1:], strict=True):
                n = high - low
                own = found[ends[low] - per_row[low] : ends[high - 1]]
                member = np.repeat(np.arange(n), per_row[low:high])
                kinds, at = np.unique(own, return_inverse=True)
                cells = np.unique(member * len(kinds) + at)
                member, at = cells // len(kinds), cells % len(kinds)
                sizes = np.bincount(member, minlength=n)
                shared = np.bincount(at, minlength=len(kinds)) > 1
                place = np.cumsum(shared) - 1
                keep = shared[at]
                member, at = member[keep], place[at[keep]]
                order = np.argsort(at, kind="stable")
                member, at = member[order], at[order]
                common = np.zeros((n, n), np.float32)
                for begin in range(0, int(shared.sum()), 2048):
                    i, j = np.searchsorted(at, (begin, begin + 2048))
                    dense = np.zeros((n, 2048), np.float32)
                    dense[member[i:j], at[i:j] - begin] = 1
                    common += dense @ dense.T
                for a, b in _pairs(np.array([0, n]), side[low:high]):
                    a, b = surviving(signs[low:high], a, b, least)
                    both = common[a, b].astype(np.int64)
                    linked = both >= threshold * (sizes[a] + sizes[b] - both) - 1e-9
                    a, b = a[linked], b[linked]
                    np.add.at(links[low:high], a, copies[low + b])
                    np.add.at(links[low:high], b, copies[low + a])
                    if len(a):
                        labels[low:high] = low + np.minimum(labels[low:high] - low, label_pairs(np.concatenate((a, np.arange(n))), np.concatenate((b, labels[low:high] - low)), n))
            of = lambda name, at=None: (table.column(name) if at is None else table.column(name).take(pa.array(at))).combine_chunks()  # noqa: E731, B023
            columns = [of("node").cast(pa.binary()), pa.array(links), of("blocks"), *(of(c) for c in NAME), *(of(c, labels) for c in NAME)]
            yield pa.RecordBatch.from_arrays(columns, ["node", "links", "blocks", *NAME, *(f"to_{c}" for c in NAME)])

    return run


def needed_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (doc_id, mark, ...) with the text of a row of docs of that id and mark.

    Rows whose mark no wanted row shares by hash position are dropped before the shuffle; the positions are a broadcast
    table of at most POSITIONS rows.
    """
    position = lambda mark: F.pmod(F.col(mark), F.lit(POSITIONS))
    spots = F.broadcast(wanted.select(position("mark").alias("spot")).distinct())
    texts = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_mark"), "text").join(spots, position("_mark") == F.col("spot"), "left_semi")
    return wanted.join(texts, (F.col("mark") == F.col("_mark")) & F.col("doc_id").eqNullSafe(F.col("_id"))).drop("_id", "_mark")


def classes(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Per row: doc_id, mark, class (the least name that links lead to), n_links (rows of other documents it is linked
    to, copies included) and copies (rows with the same set of shingles).

    A name is a struct of NAME: whether the id is null, the id and the text's hash, so null ids come last.
    """
    rows = stored(sign(docs))
    kind = docs.schema["doc_id"].dataType.simpleString()
    name = F.struct(F.isnull("doc_id").alias("none"), "doc_id", "mark")
    nodes = stored(rows.where("shingles > 0").groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min(name).alias("one"), F.first("signature").alias("signature")))
    band = [F.xxhash64(F.lit(k), F.substring("signature", 4 * ROWS * k + 1, 4 * ROWS)) for k in range(BANDS)]
    bands = nodes.select(F.explode(F.array(*band)).alias("key"), "node")
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    together = stored(bands.join(shared, "key"))
    # in the order of nodes, so that a group's links lead to the same few least nodes in all bands
    candidates = in_blocks(together.join(nodes.select("node", "signature"), "node"), "key", "members", ("node",))
    links = map_batches(candidates, _candidate_links(threshold), "a binary, b binary")
    clusters = components(links)
    sizes = clusters.groupBy("label").agg(F.count(F.lit(1)).alias("members"))
    members = clusters.join(sizes, "label").join(nodes, "node").select("label", "members", "node", "copies", "signature", "one.*")
    texts = needed_texts(docs, members).dropDuplicates(["node"])
    grouped = in_blocks(texts.withColumn("blocks", F.ceil(F.col("members") / BLOCK)), "label", "members", NAME)
    both = ", ".join(f"{p}none boolean, {p}doc_id {kind}, {p}mark long" for p in ("", "to_"))
    verified = stored(map_batches(grouped, _verified(threshold), f"node binary, links long, blocks long, {both}"))
    verified = verified.select("node", "links", "blocks", F.struct(*NAME).alias("one"), F.struct(*(F.col(f"to_{c}").alias(c) for c in NAME)).alias("to"))
    found = verified.groupBy("node").agg(F.sum("links").alias("links"), F.first("one").alias("one"), F.min("to").alias("to"))
    split = verified.where("blocks > 1").select(F.col("one").alias("a"), F.col("to").alias("b"))
    if not split.isEmpty():
        over = components(split).select(F.col("node").alias("one"), F.col("label").alias("over"))
        found = found.join(over, "one", "left").withColumn("to", F.coalesce("over", "to"))
    out = nodes.select("node", "copies", "one").join(found.select("node", "links", "to"), "node", "left")
    out = stored(out.select("node", "copies", F.coalesce("to", "one").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    full = rows.where("shingles > 0").select("doc_id", "mark", "node").join(out, "node").select("doc_id", "mark", "class", "n_links", "copies")
    empty = rows.where("shingles = 0").select("doc_id", "mark", name.alias("class"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("copies"))
    return full.unionByName(empty)


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Per row: doc_id, class_id (the least id that links lead to), n_links (rows of other documents it is linked to,
    copies included) and copies (rows with the same set of shingles)."""
    return classes(docs, threshold).select("doc_id", F.col("class.doc_id").alias("class_id"), "n_links", "copies")


def without_near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """docs with one row of each group that links hold together: that of its least id, of equal ids the least text hash.

    A row is told by its id and its text, so a text that nothing resembles stays though its id also names another that
    goes. Rows with a null id come last in their group, and go like others. Texts without words stay. Of rows that repeat
    the kept one's id and text one stays. Rows whose mark shares no hash position with one that goes or repeats are not
    shuffled; the positions are a broadcast table of at most POSITIONS rows.
    """
    p = free_prefix(docs)
    own_id, own_mark, spot = f"{p}id", f"{p}mark", f"{p}spot"
    found = stored(classes(docs, threshold).where("n_links > 0").select(F.col("doc_id").alias(own_id), F.col("mark").alias(own_mark), "class"))
    stays = F.col(own_id).eqNullSafe(F.col("class.doc_id")) & (F.col(own_mark) == F.col("class.mark"))
    goes = found.where(~stays).select(own_id, own_mark).distinct()
    twice = found.where(stays).groupBy(own_id, own_mark).count().where("count > 1").select(own_id, own_mark)
    spots = F.broadcast(goes.union(twice).select(F.pmod(own_mark, F.lit(POSITIONS)).alias(spot)).distinct())
    mark = F.xxhash64(docs["text"])
    rest = docs.join(spots, F.pmod(mark, F.lit(POSITIONS)) == F.col(spot), "left_anti")
    maybe = docs.join(spots, F.pmod(mark, F.lit(POSITIONS)) == F.col(spot), "left_semi")
    same = (F.xxhash64(maybe["text"]) == F.col(own_mark)) & maybe["doc_id"].eqNullSafe(F.col(own_id))
    left = maybe.join(goes, same, "left_anti")
    again = left.join(twice, same, "left_semi").dropDuplicates(["doc_id", "text"])
    parts = (rest, left.join(twice, same, "left_anti"), again)
    return parts[0].select(*docs.columns).unionByName(parts[1].select(*docs.columns)).unionByName(parts[2].select(*docs.columns))
