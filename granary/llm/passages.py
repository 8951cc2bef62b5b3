"""Substring dedup by compact windows: passages of SPAN words or more that are nearly repeated in another document.

A text is its sequence of five-word shingles, and a passage LEAST of them in a row. A passage is a repeat if some stretch
of another document shares with it THRESHOLD or more of the shingles that either holds.

What must agree. Let a repeat leave a of its LEAST shingles unmatched and the other stretch b of its own; then
a + 0.8 b <= 9.2. Wherever the match breaks off and resumes (a word changed, put in or left out, or two parts swapped),
either side loses four shingles or more, so one break is possible and two are not, and at least 40 shingles stand in two
runs: every repeat shares a run of RUN = 20 shingles, 24 words, word for word. (Only where a passage holds one shingle
several times can a break cost less.)

Compact windows. Under one hash function, each node of the Cartesian tree over the shingles' hashes stands for all
subsequences in which it is the minimum; those of RUN shingles begin in one interval of starts. The intervals of HASHES
functions are joined on the starts: a joint window is where the minima of all functions stay. Its key is all that stands
between these minima. A shared run lies in both documents in joint windows of one key, with certainty, so each further
function takes away candidates and loses none, and no repeat is missed by chance.

Dataflow: (0) of equal texts the first takes part, and the others repeat it; (1) the keys are counted, and those seen twice mark bits of a bitmap of fixed size; (2) the texts are read
again for the windows whose keys may be repeated; (3) each occurrence is linked to its key's first one (of the shortest
document, then by id), linear in the windows however many documents share a passage; linked documents' texts are fetched
and all their passages verified; (4) a key isn't done while an occurrence in it lies in no passage that went, or its
documents are not yet of one class: there all occurrences are compared with each other, in blocks of a bounded size, on
the shingles around them, which hold every passage that the run belongs to. A comparison whose outcome is settled by
then is left out, and what leaves a block is a row for each link that settles something. What is first in the order
(words, id, text hash) stays, what repeats it goes, so of any group of repeats one is left.

A document is an id with a text, so rows that repeat both are one document; a null id is an id, and names a class only
where all are null. A text of fewer than SPAN words, null or empty, has no passage. Repeats inside one document are left alone. Up to SPAN - 1 words at
the edge of a passage that goes may stay though a third document has them too. Columns other than doc_id and text aren't
read. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import chunks, map_batches, mix, shingles
from .components import components, group_bounds, label_pairs, whole_groups
from .lineage import free_prefix, stored
from .near import _fixed, _matrix, in_blocks

WIDTH, SPAN, RUN, HASHES, THRESHOLD, REACH = 5, 50, 20, 2, 0.8, 63
LEAST = SPAN - WIDTH + 1
#: How far the counterpart of a passage's shingle can be moved, and the shingles around a run's centre that are compared.
MOVED = 11
AROUND = LEAST - 1 + MOVED
#: Windows of a key in a block; two blocks meet in a task, with 4 * (2 * AROUND + 1) bytes a window.
BLOCK = 8192
#: Pairs of windows compared at a time, with a few kB each.
PAIRS = 1 << 12
#: Bits of the bitmap of repeated keys, and hash positions that mark which texts are needed again.
BITS, POSITIONS = 1 << 26, 1 << 20
#: Texts with copies that are looked up in a broadcast table.
COPIES = 1 << 18

_FACTORS = mix(np.arange(101, 101 + HASHES, dtype=np.uint64)) | np.uint64(1)
_PLACE = np.uint64((1 << 31) - 1)


def _sliding(values: np.ndarray, width: int, least: bool, axis: int = 0) -> np.ndarray:
    """The least (or greatest) of each width values in a row."""
    pick = np.minimum if least else np.maximum
    values = np.moveaxis(values, axis, 0)
    done = 1
    while done < width:
        step = min(done, width - done)
        values = pick(values[:-step], values[step:])
        done += step
    return np.moveaxis(values, 0, axis)


def centres(found: np.ndarray, per_row: np.ndarray, factor: np.uint64) -> np.ndarray:
    """For each start of RUN shingles the place of their minimum, the leftmost of equal ones; -1 where a row ends before."""
    if len(found) < RUN:
        return np.empty(0, np.int64)
    order = ((found * factor) & ~_PLACE) | np.arange(len(found), dtype=np.uint64)
    starts = np.arange(len(found) - RUN + 1)
    return np.where(starts + RUN <= np.repeat(np.cumsum(per_row), per_row)[starts], (_sliding(order, RUN, True) & _PLACE).astype(np.int64), -1)


def joint_windows(found: np.ndarray, per_row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows with LEAST shingles or more: each joint window's key, row, first function's centre, least and last centre,
    and hashes of half of what a run around the centres lacks, to the left and to the right; -1 where the row ends before.

    A run of RUN that holds the centres reaches so far on one side at least, so of a repeat's windows one hash agrees.
    """
    at = np.stack([centres(found, per_row, f) for f in _FACTORS])
    if not at.shape[1]:
        return np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(6))
    change = np.ones(at.shape[1], bool)
    change[1:] = (at[:, 1:] != at[:, :-1]).any(0)
    at = at[:, change & (at[0] >= 0)]
    rows = np.searchsorted(np.cumsum(per_row), at[0], side="right")
    at, rows = at[:, per_row[rows] >= LEAST], rows[per_row[rows] >= LEAST]
    low, high = at.min(0), at.max(0)
    sums = np.zeros(len(found) + 1, np.uint64)
    np.cumsum(mix(found), out=sums[1:])
    keys = mix(mix(sums[high + 1] - sums[low]) + mix(found[low] + (high - low).astype(np.uint64)))
    begin, end = (np.cumsum(per_row) - per_row)[rows], np.cumsum(per_row)[rows]
    half = (RUN - (high - low)) // 2
    reach = lambda a, b, inside: np.where(inside, (mix(sums[np.where(inside, b, 0)] - sums[np.where(inside, a, 0)]) >> np.uint64(33)).astype(np.int64), -1)
    left, right = reach(low - half, high + 1, low - half >= begin), reach(low, high + 1 + half, high + half < end)
    return keys, rows, at[0] - begin, low - begin, high - begin, left, right


def same_around(found: np.ndarray, per_row: np.ndarray, rows: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """A hash of the shingles AROUND each centre, in order, and of where the row ends among them."""
    powers = np.full(len(found), 0x9E3779B97F4A7C15, np.uint64)
    inverse = np.full(len(found) + 1, pow(0x9E3779B97F4A7C15, -1, 1 << 64), np.uint64)
    powers[:1] = inverse[:1] = 1
    sums = np.zeros(len(found) + 1, np.uint64)
    np.cumsum(found * np.multiply.accumulate(powers), out=sums[1:])
    begin, end = (np.cumsum(per_row) - per_row)[rows], np.cumsum(per_row)[rows]
    low, high = np.maximum(begin, begin + centre - AROUND), np.minimum(end, begin + centre + AROUND + 1)
    return mix((sums[high] - sums[low]) * np.multiply.accumulate(inverse)[low] + mix(((begin + centre - low) * (4 * AROUND) + high - low).astype(np.uint64)))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c in chunks(batch.column("text")):
            found, per_row, _ = shingles(c, WIDTH)
            keys, counts = np.unique(joint_windows(found, per_row)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["key", "n"])


def repeated_bitmap(keys: DataFrame, bits: int = BITS) -> np.ndarray:
    """A bitmap of the low bits of the keys; at most bits / 64 rows come to the driver."""
    spot = F.pmod("key", F.lit(bits))
    words = keys.groupBy(F.shiftright(spot, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(key, {bits}) & 63 as int))")).alias("value"))
    table = words.toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[table.column("word").to_numpy()] = table.column("value").to_numpy()
    return out


def occurrences(docs: DataFrame) -> DataFrame:
    """The joint windows whose key other windows may have too: key, doc_id, mark, words, centres, low, high, left, right.

    low and high are the least and last of the functions' centres, counted from the first function's, left and right
    hashes of what is around them. Windows of one document that also agree in all AROUND their centres are one row with
    several centres, so a line that a text repeats is no hot group. A few keys are there only because the bitmap shares a
    bit; they have one occurrence and link nothing.
    """
    marked = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    counted = map_batches(docs.select("text"), _keys, "key long, n long")
    repeated = stored(counted.repartition("key").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key"))
    bitmap = docs.sparkSession.sparkContext.broadcast(repeated_bitmap(repeated))
    kind = marked.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for batch in batches:
            for c in chunks(batch.column("text")):
                part = batch.slice(c.first, c.n)
                found, per_row, _ = shingles(c, WIDTH)
                keys, *places = joint_windows(found, per_row)
                spot = (keys.view(np.int64) % BITS).astype(np.int64)
                hit = np.flatnonzero(bits[spot >> 6] >> (spot & 63) & 1)
                rows, centre = places[0][hit], places[1][hit]
                alike = mix(same_around(found, per_row, rows, centre) + mix(keys[hit] ^ mix(rows.astype(np.uint64))))
                order = np.argsort(alike, kind="stable")
                first = np.flatnonzero(np.r_[True, alike[order][1:] != alike[order][:-1]][: len(order)])
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)).astype(np.int32)), pa.array(centre[order].astype(np.int32)))
                one = order[first]
                rows, _, low, high, *hashes = (x[hit][one] for x in places)
                numbers = (low - centre[one], high - centre[one], *hashes)
                columns = [pa.array(keys[hit][one].view(np.int64)), *(part.column(x).take(pa.array(rows)) for x in ("doc_id", "mark")), pa.array((per_row[rows] + WIDTH - 1).astype(np.int32)), lists]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x.astype(np.int32)) for x in numbers)], ["key", "doc_id", "mark", "words", "centres", "low", "high", "left", "right"])

    return stored(map_batches(marked, run, f"key long, doc_id {kind}, mark long, words int, centres array<int>, low int, high int, left int, right int"))


def shared_windows(found: DataFrame) -> DataFrame:
    """The windows whose key has others, with the key's first one, to, and how many windows it has, n."""
    # written first, so that both sides of the join are plain exchanges, of which a hot key's can be split
    earliest = found.groupBy("key").agg(F.min(F.struct("words", "doc_id", "mark", F.element_at("centres", 1).alias("centre"), "left", "right")).alias("to"), F.count(F.lit(1)).alias("n"))
    earliest = stored(earliest.where("n > 1"))
    return stored(found.join(earliest, "key"))


def linked_documents(shared: DataFrame) -> DataFrame:
    """Per pair of a document and a key's first one: (doc_id, mark), (to_id, to_mark), to_words and the windows they share."""
    around = F.expr("(left = to.left and left >= 0) or (right = to.right and right >= 0)")
    pairs = shared.where(around & ~(F.col("doc_id").eqNullSafe(F.col("to.doc_id")) & (F.col("mark") == F.col("to.mark"))))
    windows = F.transform("centres", lambda c: F.struct(c.alias("centre"), F.col("to.centre").alias("to_centre")))
    return pairs.groupBy("doc_id", "mark", F.col("to.doc_id").alias("to_id"), F.col("to.mark").alias("to_mark")).agg(F.first("to.words").alias("to_words"), F.flatten(F.collect_list(windows)).alias("windows"))


def _nearest(values: np.ndarray, wanted: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """For each wanted value its place in values nearest to the expected one and within REACH, or -1; of two the first."""
    kinds, kind = np.unique(values, return_inverse=True)
    stride = len(values) + 1
    places = np.sort(kind * stride + np.arange(len(values)))
    k = np.minimum(np.searchsorted(kinds, wanted), len(kinds) - 1)
    after = np.searchsorted(places, k * stride + np.clip(expected, 0, len(values)))
    best = np.full(len(wanted), -1)
    far = np.full(len(wanted), REACH + 1)
    for spot in (np.maximum(after - 1, 0), np.minimum(after, len(places) - 1)):
        away = np.where((places[spot] // stride == k) & (kinds[k] == wanted), np.abs(places[spot] % stride - expected), REACH + 1)
        best, far = np.where(away < far, places[spot] % stride, best), np.minimum(away, far)
    return best


def verify(own: np.ndarray, other: np.ndarray, centre: np.ndarray, to_centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which shingles of own lie in a passage that other repeats, and which of other's are its counterparts.

    A shingle's counterpart is the equal one nearest to where the nearest shared window (centre, to_centre) puts it.
    """
    n, m = len(own), len(other)
    starts = n - LEAST + 1
    mine, theirs = np.zeros(n, bool), np.zeros(m, bool)
    if starts < 1 or not m or not len(centre):
        return mine, theirs
    order = np.argsort(centre, kind="stable")
    centre, shift = centre[order], (to_centre - centre)[order]
    places = np.arange(n)
    near = np.clip(np.searchsorted(centre, places), 0, len(centre) - 1)
    before = np.maximum(near - 1, 0)
    near = np.where(np.abs(centre[before] - places) <= np.abs(centre[near] - places), before, near)
    expected = places + shift[near]
    inside = (expected >= 0) & (expected < m)
    at = np.where(inside & (other[np.clip(expected, 0, m - 1)] == own), expected, -1)
    miss = np.flatnonzero(at < 0)
    if len(miss):  # words put in or left out move the counterpart
        at[miss] = _nearest(other, own[miss], expected[miss])
    good, low, high = _good(at[None], m)
    good = np.flatnonzero(good[0])
    for marks, begin, end in ((mine, good, good + LEAST), (theirs, low[0, good], high[0, good] + 1)):
        change = np.zeros(len(marks) + 1, np.int64)
        np.add.at(change, begin, 1)
        np.add.at(change, end, -1)
        marks |= np.cumsum(change[:-1]) > 0
    return mine, theirs


def _good(at: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of counterparts (below m, or -1): which LEAST in a row are a repeat, and the first and last counterpart."""
    matched = at >= 0
    sums = np.zeros((len(at), at.shape[1] + 1), np.int32)
    np.cumsum(matched, axis=1, out=sums[:, 1:])
    both = sums[:, LEAST:] - sums[:, :-LEAST]
    low = _sliding(np.where(matched, at, m), LEAST, True, 1)
    high = _sliding(at, LEAST, False, 1)
    either = LEAST + (high - low + 1) - both
    return (both >= THRESHOLD * either - 1e-9) & (both > 0), low, high


def _spans(marks: np.ndarray) -> list[dict]:
    """Runs of marked shingles as ranges of words: from, to (exclusive)."""
    edges = np.diff(np.concatenate(([0], marks.astype(np.int8), [0])))
    return [{"from": int(a), "to": int(b) + WIDTH - 1} for a, b in zip(np.flatnonzero(edges > 0), np.flatnonzero(edges < 0), strict=True)]


_SPAN = T.ArrayType(T.StructType([T.StructField("from", T.IntegerType()), T.StructField("to", T.IntegerType())]))
_ARROW_SPANS = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))


def _pair_schema(docs: DataFrame) -> T.StructType:
    kind, number = docs.schema["doc_id"].dataType, T.IntegerType()
    fields = {"doc_id": kind, "mark": T.LongType(), "spans": _SPAN, "to_id": kind, "to_mark": T.LongType(), "to_words": number, "to_spans": _SPAN}
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


def _node(doc_id: str, mark: str) -> Column:
    """A document's name as a key to join on: its id and its text's hash."""
    return F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit("/"), F.hex(mark))


def _texts(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """node and text of the documents whose text's hash is among marks, and of a few others.

    Rows whose mark no wanted one shares by hash position are dropped before the shuffle; the positions are a broadcast
    table of at most POSITIONS rows.
    """
    spots = F.broadcast(marks.select(F.pmod("mark", F.lit(POSITIONS)).alias("spot")).distinct())
    rows = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").join(spots, F.pmod("mark", F.lit(POSITIONS)) == F.col("spot"), "left_semi")
    return rows.groupBy(_node("doc_id", "mark").alias("node")).agg(F.first("text").alias("text"))


def verified_pairs(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs that verify, as repeats gives them. Equal texts repeat each other whole; for the others, both joins with
    the texts use one exchange of them."""
    schema = _pair_schema(docs)
    whole = F.array(F.struct(F.lit(0).alias("from"), F.col("to_words").alias("to")))
    copies = pairs.where("mark = to_mark").withColumns({"spans": whole, "to_spans": whole}).select(*schema.fieldNames())
    pairs = pairs.where("mark <> to_mark")
    texts = _texts(docs, pairs.select("mark").union(pairs.select("to_mark")))
    theirs = pairs.withColumn("node", _node("to_id", "to_mark")).join(texts.withColumnRenamed("text", "to_text"), "node").drop("node")
    with_texts = theirs.withColumn("node", _node("doc_id", "mark")).join(texts, "node").drop("node")

    def sequences(column: pa.Array) -> list[np.ndarray]:
        out = []
        for c in chunks(column):
            found, per_row, _ = shingles(c, WIDTH)
            out += np.split(found, np.cumsum(per_row)[:-1])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                batch = whole.slice(begin, 256)
                marks = []
                for own, other, windows in zip(sequences(batch.column("text")), sequences(batch.column("to_text")), batch.column("windows"), strict=True):
                    fields = windows.values
                    marks.append(verify(own, other, *(fields.field(c).to_numpy().astype(np.int64) for c in ("centre", "to_centre"))))
                hit = pa.array([i for i, (mine, _) in enumerate(marks) if mine.any()], pa.int64())
                spans = [pa.array([_spans(marks[i.as_py()][side]) for i in hit], _ARROW_SPANS) for side in (0, 1)]
                take = lambda c: batch.column(c).take(hit)  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([take("doc_id"), take("mark"), spans[0], take("to_id"), take("to_mark"), take("to_words"), spans[1]], schema.fieldNames())

    return stored(copies.unionByName(map_batches(with_texts, run, schema)))


def open_windows(shared: DataFrame, verified: DataFrame) -> DataFrame:
    """The windows that are still to be compared with others of their key: those of shared_windows but each key's first,
    with of (a number for the document), label (of its class so far) and covered (passages that go hold all centres).

    key is the key together with what is around it on one side, so a window comes once or twice; members counts a key's
    windows. Keys are left out whose windows are of one label, and all covered but those of their first document.
    """
    of, to = F.xxhash64("doc_id", "mark"), F.xxhash64("to_id", "to_mark")
    labels = components(verified.select(of.alias("a"), to.alias("b")))
    goes = verified.groupBy(of.alias("node")).agg(_joined(F.flatten(F.collect_set("spans"))).alias("goes"))
    known = labels.join(goes, "node", "left").withColumnRenamed("node", "of")
    first = F.col("doc_id").eqNullSafe(F.col("to.doc_id")) & (F.col("mark") == F.col("to.mark")) & (F.element_at("centres", 1) == F.col("to.centre"))
    rows = shared.where(~first & (F.col("n") > 2)).drop("to", "n").withColumn("of", of).join(known, "of", "left")
    covered = F.coalesce(F.expr(f"forall(centres, c -> exists(goes, s -> s.from <= c + low and s.to >= c + high + {WIDTH}))"), F.lit(False))
    rows = stored(rows.withColumns({"label": F.coalesce("label", "of"), "covered": covered}).drop("goes"))
    left = _unsettled(rows)
    sided = left.withColumn("side", F.explode(F.array(F.struct(F.lit(0).alias("at"), F.col("left").alias("hash")), F.struct(F.lit(1).alias("at"), F.col("right").alias("hash")))))
    sided = stored(sided.where("side.hash >= 0").withColumn("key", F.xxhash64("key", "side.at", "side.hash")).drop("side", "left", "right", "members"))
    return _unsettled(sided)


def _unsettled(rows: DataFrame) -> DataFrame:
    """rows with members, without those of keys that have nothing to settle."""
    name = F.struct("words", "doc_id", "mark")
    labels = (F.min("label").alias("one"), F.max("label").alias("another"))
    keys = rows.groupBy("key").agg(F.count(F.lit(1)).alias("members"), *labels, F.min(name).alias("first"), F.max(F.when(~F.col("covered"), name)).alias("last"))
    keys = stored(keys.where("one <> another or last > first").select("key", "members"))
    return rows.join(keys, "key")


def _with_around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's windows as rows, with the 32-bit hashes of the shingles AROUND each centre; 0 beyond its ends."""
    for batch in batches:
        for c in chunks(batch.column("text")):
            part = batch.slice(c.first, c.n)
            found, per_row, _ = shingles(c, WIDTH)
            end = np.cumsum(per_row)
            short = (found >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
            windows = part.column("windows")
            rows = np.repeat(np.arange(c.n), np.diff(windows.offsets.to_numpy()))
            fields = windows.flatten()
            for i in range(0, len(rows), 4096):
                own, some = rows[i : i + 4096], fields.slice(i, 4096)
                centre = some.field("centres").values.to_numpy()[some.field("centres").offsets.to_numpy()[:-1]]
                at = (end - per_row)[own][:, None] + centre[:, None] + np.arange(-AROUND, AROUND + 1)
                inside = (at >= (end - per_row)[own][:, None]) & (at < end[own][:, None])
                around = np.where(inside, short[np.clip(at, 0, max(len(short) - 1, 0))], np.uint32(0))
                columns = [*(part.column(x).take(pa.array(own)) for x in _OWN), *(some.field(x) for x in _WINDOW), _fixed(around)]
                yield pa.RecordBatch.from_arrays(columns, [*_OWN, *_WINDOW, "around"])


_OWN = ("doc_id", "mark", "words", "of", "label")
_WINDOW = ("key", "members", "centres", "low", "high", "covered")


def repeats_around(own: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs of rows of shingles around centres that match: which share a run of RUN and have a repeat that holds the
    centre (indices), and of the repeats together the first and last shingle of own and of other, counted from the centre."""
    near = slice(AROUND - RUN + 1, AROUND + RUN)
    same = (own[:, near] == other[:, near]) & (own[:, near] != 0)
    stop = np.zeros((len(own), 1), bool)
    left = np.concatenate((same[:, RUN - 1 :: -1], stop), 1).argmin(1)
    right = np.concatenate((same[:, RUN - 1 :], stop), 1).argmin(1)
    pairs = np.flatnonzero(left + right - 1 >= RUN)
    own, other = own[pairs], other[pairs]
    width = 2 * LEAST - 1
    mine = own[:, MOVED : MOVED + width]
    at = np.full(mine.shape, -1, np.int32)
    places = np.arange(width, dtype=np.int32)
    for moved in sorted(range(-MOVED, MOVED + 1), key=abs):
        theirs = other[:, MOVED + moved : MOVED + moved + width]
        at = np.where((at < 0) & (mine == theirs) & (mine != 0), places + (MOVED + moved), at)
    good, low, high = _good(at, other.shape[1])
    good &= (mine[:, :LEAST] != 0) & (mine[:, LEAST - 1 :] != 0)  # within the text
    hit = good.any(1)
    good, low, high = good[hit], low[hit], high[hit]
    first, last = good.argmax(1), good.shape[1] - 1 - good[:, ::-1].argmax(1)
    low, high = np.where(good, low, other.shape[1]).min(1), np.where(good, high, -1).max(1)
    return pairs[hit], first - LEAST + 1, last, low - AROUND, high - AROUND


def _open_pairs(bounds: np.ndarray, covered: np.ndarray, labels) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs a < b of each group whose b isn't covered or whose group has several labels, a few at first for each b, then
    ever more; what covered and labels() say by then decides which b go on."""
    group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    upto, width = bounds[:-1][group], 8
    while True:
        label = labels()
        several = np.minimum.reduceat(label, bounds[:-1]) < np.maximum.reduceat(label, bounds[:-1])
        active = np.flatnonzero((upto < np.arange(len(group))) & (~covered | several[group]))
        if not len(active):
            return
        for i in range(0, len(active), max(1, PAIRS // width)):
            b = active[i : i + max(1, PAIRS // width)]
            n = np.minimum(width, b - upto[b])
            a = np.repeat(upto[b] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            upto[b] += n
            yield a, np.repeat(b, n)
        width = min(4 * width, PAIRS)


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys = ["key", "first", "second"]
    for table in whole_groups(batches, keys, 8192):
        near = _matrix(table.column("around"), np.uint32, 2 * AROUND + 1)
        of, low, high, words, side = (table.column(c).to_numpy() for c in ("of", "low", "high", "words", "side"))
        covered = np.asarray(table.column("covered")).copy()
        kinds, label = np.unique(table.column("label").to_numpy(), return_inverse=True)
        n = table.num_rows
        begin, end = [np.full(n, 1 << 30), np.full(n, 1 << 30)], [np.full(n, -1), np.full(n, -1)]
        told = [np.zeros(n, bool), np.zeros(n, bool)]
        later, earlier = [], []
        for a, b in _open_pairs(group_bounds(table, keys), covered, lambda: label):  # noqa: B023
            stay = (of[a] != of[b]) & ((side[a] < 0) | (side[a] != side[b])) & (~covered[b] | (label[a] != label[b]))
            a, b = a[stay], b[stay]
            if not len(a):
                continue
            hit, *found = repeats_around(near[b], near[a])
            a, b = a[hit], b[hit]
            kept = []
            for k, (at, first, last) in enumerate(((b, *found[:2]), (a, *found[2:]))):
                np.minimum.at(begin[k], at, first)
                np.maximum.at(end[k], at, last)
                new = np.flatnonzero(~told[k][at])
                kept.append(new[np.unique(at[new], return_index=True)[1]])
                told[k][at] = True
            covered[b] |= (begin[0][b] <= low[b]) & (end[0][b] >= high[b])
            while (apart := np.flatnonzero(label[a] != label[b])).size:  # a link for each label that joins another
                apart = apart[np.unique(label[b[apart]], return_index=True)[1]]
                kept.append(apart)
                label = label_pairs(label[a[apart]], label[b[apart]], len(kinds))[label]
            kept = np.unique(np.concatenate(kept))
            later.append(b[kept])
            earlier.append(a[kept])
        if not later:
            continue
        later, earlier = np.concatenate(later), np.concatenate(earlier)
        centres_of = table.column("centres").combine_chunks()

        def spans(side: int, at: np.ndarray) -> pa.Array:
            lists = centres_of.take(pa.array(at))
            sizes = np.diff(lists.offsets.to_numpy())
            ends = [lists.flatten().to_numpy() + np.repeat(x[side][at] + more, sizes) for x, more in ((begin, 0), (end, WIDTH))]  # noqa: B023
            pairs = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in ends], ["from", "to"])
            return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pairs)

        take = lambda c, at: table.column(c).take(pa.array(at)).combine_chunks()  # noqa: E731, B023
        columns = [take("doc_id", later), take("mark", later), spans(0, later), take("doc_id", earlier), take("mark", earlier), pa.array(words[earlier]), spans(1, earlier)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "spans", "to_id", "to_mark", "to_words", "to_spans"])


def settled_pairs(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Of windows (as open_windows gives them), the links and passages that comparing all of each key adds, as repeats."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    listed = windows.groupBy("doc_id", "mark").agg(*(F.first(c).alias(c) for c in _OWN[2:]), F.collect_list(F.struct(*_WINDOW)).alias("windows"))
    listed = stored(listed)
    with_texts = listed.withColumn("node", _node("doc_id", "mark")).join(_texts(docs, listed), "node").select(*_OWN, "windows", "text")
    schema = f"doc_id {kind}, mark long, words int, of long, label long, key long, members long, centres array<int>, low int, high int, covered boolean, around binary"
    around = map_batches(with_texts, _with_around, schema).withColumn("node", F.xxhash64("of", F.element_at("centres", 1)))
    grouped = in_blocks(around, "key", "members", ("words", "doc_id", "mark", "node"), BLOCK)
    return stored(map_batches(grouped, _settle, _pair_schema(docs)))


def repeats(docs: DataFrame) -> DataFrame:
    """Links: doc_id, mark, spans (ranges of words that repeat the other document's), to_id, to_mark, to_words, to_spans.

    Links hold all repeats together and their spans are all that goes; pairs that add to neither may be left out.
    """
    copies, docs = _copies(docs)
    shared = shared_windows(occurrences(docs))
    first = verified_pairs(docs, stored(linked_documents(shared)))
    return first.unionByName(settled_pairs(docs, open_windows(shared, first))).unionByName(copies)


def _copies(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links of documents to the first one of equal text, as repeats gives them, and doc_id and text of all others.

    Only the COPIES texts that most rows have are looked up, in a broadcast table of so many rows; copies of other texts
    are among the others, whose windows find them.
    """
    marked = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    texts = marked.groupBy("mark").agg(F.min(F.struct("doc_id")).alias("one"), F.count(F.lit(1)).alias("n")).where("n > 1")
    texts = stored(texts.orderBy(F.desc("n"), "mark").limit(COPIES).select("mark", "one"))
    marked = marked.join(F.broadcast(texts), "mark", "left")
    copy = F.col("one").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("one.doc_id"))
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    found = marked.where(copy).select("doc_id", "mark", "one", words.alias("to_words")).where(F.col("to_words") >= SPAN).distinct()
    whole = F.array(F.struct(F.lit(0).alias("from"), F.col("to_words").alias("to")))
    columns = {"spans": whole, "to_id": F.col("one.doc_id"), "to_mark": F.col("mark"), "to_spans": whole}
    return stored(found.withColumns(columns).select(*_pair_schema(docs).fieldNames())), marked.where(~copy).select("doc_id", "text")


def _joined(spans, floor: str = "from"):
    """Overlapping or touching ranges as one, in order."""
    ordered = F.array_sort(spans)
    last = lambda done: F.element_at(done, -1)
    grow = lambda done, s: F.when(
        (F.size(done) > 0) & (s["from"] <= F.coalesce(F.try_element_at(done, F.lit(-1))["to"], F.lit(-1))),
        F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(done, F.lit(-1))["from"].alias("from"), F.greatest(F.try_element_at(done, F.lit(-1))["to"], s["to"]).alias("to")))),
    ).otherwise(F.concat(done, F.array(s)))
    return F.aggregate(ordered, F.array().cast("array<struct<from:int,to:int>>"), grow)


def passages(docs: DataFrame) -> DataFrame:
    """Per document with a repeat: doc_id, mark, class_id, n_links, removed and repeated.

    removed are the ranges of words that repeat an earlier document's, repeated those and the ranges that later ones
    repeat. class_id is the least id that repeats lead to, n_links the number of documents that repeats links it to.
    """
    found = repeats(docs)
    name = lambda doc_id, mark: F.struct(F.isnull(doc_id).alias("none"), F.col(doc_id).alias("doc_id"), F.col(mark).alias("mark"))
    links = found.select(name("doc_id", "mark").alias("a"), name("to_id", "to_mark").alias("b")).distinct()
    sides = found.select(name("doc_id", "mark").alias("node"), F.lit(True).alias("goes"), "spans").union(found.select(name("to_id", "to_mark"), F.lit(False), "to_spans"))
    # a document that very many repeat adds the same ranges again and again: distinct ones are few
    ranges = sides.select("node", "goes", F.explode("spans").alias("span")).distinct()
    lists = ranges.groupBy("node").agg(F.collect_list(F.when(F.col("goes"), F.col("span"))).alias("removed"), F.collect_list("span").alias("repeated"))
    counted = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    out = counted.join(components(links), "node").join(lists, "node")
    return out.select("node.doc_id", "node.mark", F.col("label.doc_id").alias("class_id"), "n_links", _joined("removed").alias("removed"), _joined("repeated").alias("repeated"))


def classed(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, class_id (its own without a repeat), n_links, removed and repeated."""
    found = stored(passages(docs))
    rows = docs.select("doc_id", F.xxhash64("text").alias("mark"))
    out = rows.alias("r").join(found.alias("f"), (F.col("r.mark") == F.col("f.mark")) & F.col("r.doc_id").eqNullSafe(F.col("f.doc_id")), "left")
    none = F.array().cast("array<struct<from:int,to:int>>")
    return out.select("r.doc_id", F.coalesce("class_id", "r.doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("removed", none).alias("removed"), F.coalesce("repeated", none).alias("repeated"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the removed ranges of words cut out of the texts, and their n_chars, where there is one, counted anew.

    A row whose text loses all its words goes. Only rows that may lose something are shuffled.
    """
    p = free_prefix(docs)
    own_id, own_mark, removed, spot = f"{p}id", f"{p}mark", f"{p}removed", f"{p}spot"
    found = stored(passages(docs).where(F.size("removed") > 0).select(F.col("doc_id").alias(own_id), F.col("mark").alias(own_mark), F.col("removed").alias(removed)))
    spots = F.broadcast(found.select(F.pmod(own_mark, F.lit(POSITIONS)).alias(spot)).distinct())
    mark = F.xxhash64(docs["text"])
    maybe = docs.join(spots, F.pmod(mark, F.lit(POSITIONS)) == F.col(spot), "left_semi")
    rest = docs.join(spots, F.pmod(F.coalesce(mark, F.lit(0)), F.lit(POSITIONS)) == F.col(spot), "left_anti")
    joined = maybe.join(found, (F.xxhash64(maybe["text"]) == F.col(own_mark)) & maybe["doc_id"].eqNullSafe(F.col(own_id)), "left")
    # a piece is a word with the white space before it; pieces outside every range stay
    pieces = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    size = F.size(pieces)
    begins = F.concat(F.array(F.lit(0)), F.transform(removed, lambda s: s["to"]))
    ends = F.concat(F.transform(removed, lambda s: s["from"]), F.array(size))
    kept = F.transform(F.arrays_zip(begins.alias("a"), ends.alias("b")), lambda s: F.array_join(F.slice(pieces, s["a"] + 1, F.greatest(s["b"] - s["a"], F.lit(0))), ""))
    text = F.when(F.col(removed).isNull(), F.col("text")).otherwise(F.array_join(kept, ""))
    cut = joined.withColumn("text", text).where(F.col(removed).isNull() | (F.length("text") > 0))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col(removed).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    cut = cut.select(*docs.columns)
    return rest.select(*docs.columns).unionByName(cut)
