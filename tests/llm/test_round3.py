"""Whitening, spelling variants and sharding against brute force on small tables with odd rows."""

import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from granary.llm import sharding, variants, whiten

# 11


def whole(c):
    return [math.floor(64 * v) + 1_000_000 for v in c]


def held_against(got, vectors, k=16):
    """The rows of whiten against a dense eigendecomposition of exact centred numbers."""
    rows = [(i, whole(v)) for i, v in vectors]
    distinct = sorted({tuple(x) for _, x in rows})
    n, sums = len(distinct), [sum(c) for c in zip(*distinct, strict=True)]
    off = np.array([[(n * v - s) / n for v, s in zip(x, sums, strict=True)] for x in distinct])
    cov = off.T @ off / n
    values = np.linalg.eigh(cov)[0][::-1]
    components = sorted({r.component for r in got})
    assert components == list(range(1, len(components) + 1)) and len(components) <= k
    assert Counter(r.vec_id for r in got) == Counter(i for i, _ in rows for _ in components)
    want = Counter((i, sum((n * v - s) ** 2 for v, s in zip(x, sums, strict=True))) for i, x in rows)
    assert Counter((r.vec_id, int(r.deviation)) for r in got) == Counter({key: m * len(components) for key, m in want.items()})
    assert {r.n for r in got} == {n}
    for r in got:
        assert abs(r.explained - values[r.component - 1] / np.trace(cov)) <= 1e-9 * r.explained
        assert r.identity_error <= 1e-6
    # the whitened rows are a linear image of the centred ones along eigenvectors, one sign a component
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r.whitened)
    table = {i: (np.array(x) - np.array(sums) / n) for i, x in rows if sum(j == i for j, _ in rows) == 1 and i is not None}
    for c in components:
        y = np.array([by_id[i][c][0] for i in table])
        x = np.array(list(table.values()))
        e = values[c - 1]
        direction = np.linalg.lstsq(x, y * math.sqrt(e), rcond=None)[0] if len(x) > x.shape[1] and values[-1] > 1e-12 * values[0] else None
        if direction is not None:
            assert abs(np.linalg.norm(direction) - 1) < 1e-8
            assert np.linalg.norm(cov @ direction - e * direction) < 1e-8 * values[0]
    return components


def test_whitening(spark):
    draw = np.random.default_rng(3)
    width = 24
    vectors = [(i, (draw.normal(size=width) * np.linspace(0.2, 3, width)).tolist()) for i in range(300)]
    vectors += [(500 + i, vectors[0][1]) for i in range(200)] + [(None, vectors[1][1]), (7, vectors[2][1]), (600, [0.0] * width)]
    bad = [(901, None), (902, [None] + [0.1] * (width - 1)), (903, [math.nan] * width), (904, [math.inf] + [0.0] * (width - 1)), (905, []), (906, [1.0, 2.0]), (907, [1e300] * width)]
    table = spark.createDataFrame(vectors + bad, "vec_id long, embedding array<double>").withColumn("x", F.lit("clash")).withColumn("n", F.lit(1)).repartition(5)
    got = whiten.whiten(table).collect()
    assert held_against(got, vectors) == list(range(1, 17))


def test_whitening_of_few_equal_and_far_vectors(spark):
    rows = lambda vs: spark.createDataFrame(vs, "vec_id long, embedding array<float>")
    assert whiten.whiten(rows([])).count() == 0
    assert whiten.whiten(rows([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    flat = [(i, [float(i % 3), float(i % 2), 5.0]) for i in range(12)]
    assert held_against(whiten.whiten(rows(flat)).collect(), flat) == [1, 2]
    axes = [(2 * j + s, [8.0 * (1 - 2 * s) if i == j else 0.0 for i in range(6)]) for j in range(6) for s in (0, 1)]
    assert held_against(whiten.whiten(rows(axes)).collect(), axes) == [1, 2, 3, 4, 5, 6]  # all eigenvalues equal
    far = [(i, [2.0**39 * (-1) ** i + i, float(i)]) for i in range(9)]
    assert held_against(whiten.whiten(rows(far)).collect(), [(i, [float(np.float32(c)) for c in v]) for i, v in far])[0] == 1


def test_lanczos_stops_early_and_restarts():
    draw = np.random.default_rng(5)
    turn = np.linalg.qr(draw.normal(size=(400, 400)))[0]
    values = np.sort(np.concatenate((100 / 1.5 ** np.arange(20), draw.uniform(0, 0.001, 380))))[::-1]
    matrix, asked = turn * values @ turn.T, []
    got, vectors = whiten.leading(lambda v: asked.append(v.shape[1]) or matrix @ v, 400, 16)
    assert np.allclose(got, values[:16], rtol=1e-12) and sum(asked) < 400
    assert np.abs(matrix @ vectors - vectors * got).max() < 1e-11
    low = turn[:, :5] * values[:5] @ turn[:, :5].T  # rank 5: every block after the first breaks down
    got, vectors = whiten.leading(lambda v: low @ v, 400, 8)
    assert np.allclose(got[:5], values[:5]) and np.abs(got[5:]).max() < 1e-10 and np.allclose(vectors.T @ vectors, np.eye(8), atol=1e-12)


# 12


def words_of(docs):
    counts = Counter()
    for i, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 3}


def variant_rows(words):
    """Every word's near words by a wildcard at each position, its form and root."""
    near = defaultdict(set)
    holes = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            holes[w[:i], w[i + 1 :]].add(w)
            if (short := w[:i] + w[i + 1 :]) in words:
                near[w].add(short)
                near[short].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        if best and words[best] >= 2 * n:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, n, len(near[w]), form.get(w), words.get(form.get(w)), root(w)) for w, n in words.items()}


@pytest.fixture(scope="module")
def spellings():
    draw = random.Random(4)
    letters = "abcdeé÷ÿÀ"
    stems = ["".join(draw.choice(letters) for _ in range(draw.randint(5, 9))) for _ in range(60)] + ["moooon", "aaaaaa", "aaaaa", "ab" * 4, "z" * 3000, "abcdefgh"]

    def changed(w):
        i, kind = draw.randrange(len(w)), draw.randrange(4)
        return [w, w[:i] + w[i + 1 :], w[:i] + draw.choice(letters) + w[i:], w[:i] + draw.choice(letters) + w[i + 1 :]][kind]

    texts = []
    for i in range(250):
        words = [changed(draw.choice(stems)) for _ in range(60)] + [changed(changed(draw.choice(stems[:9]))) for _ in range(60)]
        texts.append((i, draw.choice([" ", ", ", "\n", "5", "ł"]).join(w.upper() if draw.random() < 0.1 else w for w in words)))
    texts += [(None, texts[0][1]), (3, None), (4, ""), (5, "ab abc abcd"), texts[1], texts[1], (9, "word " * 30_000), (10, "z" * 3001 + " " + "z" * 2999)]
    return texts


@pytest.mark.parametrize("cell", [None, 12])
def test_spelling_variants(spark, spellings, cell):
    table = spark.createDataFrame(spellings, "doc_id long, text string").withColumns({"word": F.lit("clash"), "n": F.lit("clash"), "id": F.lit(1)}).repartition(4)
    got = variants.variants(table, cell=cell).collect()
    want = variant_rows(words_of(spellings))
    assert len(got) == len(want) and {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in got} == want
    assert any(r[5] != (r[3] or r[0]) for r in want)  # a form has a form itself


def test_variants_of_an_empty_table(spark):
    assert variants.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_cells_stay_bounded(spark):
    """A thousand words that agree but for a middle part are cut into small cells and keep all their pairs."""
    draw = random.Random(8)
    words = {"commonbeginning" + "".join(draw.choice("abc") for _ in range(7)) + "commonend" for _ in range(1000)}
    words |= {w[:18] + w[19:] for w in sorted(words)[:100]}
    words = {w: k % 11 + 3 for k, w in enumerate(sorted(words))}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    placed = variants.cells(table, 64).groupBy("cell").count().agg(F.max("count")).first()[0]
    assert placed <= 64
    got = {(r.word, r.n_near) for r in variants.near_words(table, 64).collect()}
    assert got == {(w, k) for w, _, k, *_ in variant_rows(words) if k}


def test_wavelet_tree_reports_rectangles():
    draw = np.random.default_rng(2)
    for size in (1, 2, 5, 33, 64):
        values = draw.permutation(size)
        tree = variants.WaveletTree(values)
        ends = draw.integers(0, size + 1, (50, 4))
        left, right, low, high = ends.min(1) * 0 + np.minimum(ends[:, 0], ends[:, 1]), np.maximum(ends[:, 0], ends[:, 1]), np.minimum(ends[:, 2], ends[:, 3]), np.maximum(ends[:, 2], ends[:, 3])
        query, value = tree.report(left, right, low, high)
        want = {(q, int(v)) for q in range(50) for v in values[left[q] : right[q]] if low[q] <= v < high[q]}
        assert set(zip(query.tolist(), value.tolist(), strict=True)) == want and len(query) == len(want)


# 13


def jump(key, shards):
    """The published function."""
    b, j = -1, 0
    while j < shards:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("shards", [1, 2, 16, 33, 1024])
def test_jump_hash_equals_the_published_function(spark, shards):
    draw = random.Random(6)
    keys = [0, 1, -1, 42, 256, 0xDEAD10CC, 2**63 - 1, -(2**63)] + [draw.getrandbits(64) - 2**63 for _ in range(300)]
    got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", sharding.jump_hash(F.col("k"), shards).alias("s")).collect()
    assert {r.k: r.s for r in got} == {k: jump(k % 2**64, shards) for k in keys}


def test_published_values():
    assert [jump(k, n) for k, n in ((1, 1), (42, 57), (0xDEAD10CC, 1), (0xDEAD10CC, 666), (256, 1024))] == [0, 43, 0, 361, 520]


@pytest.fixture(scope="module")
def sharded():
    texts = ["", None, "é😀", "a", "long " * 40_000] + [f"text {i % 40}" for i in range(400)]
    return [(i, t) for i, t in enumerate(texts)] + [(None, "x"), (None, "x"), (None, None), (7, "other")] + [(11, "hot")] * 300


@pytest.mark.parametrize("piece", [1 << 16, 8])
def test_sharding(spark, sharded, piece):
    table = spark.createDataFrame(sharded, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("shard", "slot", "key", "mark", "kept", "lies", "at")}).repartition(6)
    full = sharding.assign(table, 16, prefix="to_", piece=piece)
    assert full.columns[: len(table.columns)] == table.columns
    got = full.collect()
    size = lambda t: len((t or "").encode()) + 1
    key = lambda i: xxhash.xxh64_intdigest(struct.pack("<q", i), seed=42) if i is not None else 42
    want = Counter((i, t, size(t), zlib.crc32((t or "").encode()), "key", jump(key(i), 16), jump(key(i), 17)) for i, t in sharded)
    assert Counter((r.doc_id, r.text, r.to_size, r.to_text_crc32, r.to_law, r.to_shard, r.to_grown_shard) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.to_shard].append(r.to_slot)
        assert r.to_grown_shard in (r.to_shard, 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = sharding.assign(table.repartition(3), 16, prefix="to_", piece=1 << 16).collect()
    if piece == 1 << 16:  # a slot depends on the rows alone
        assert Counter((r.doc_id, r.text, r.to_shard, r.to_slot) for r in again) == Counter((r.doc_id, r.text, r.to_shard, r.to_slot) for r in got)


def test_sharding_is_native_and_takes_empty_tables(spark, sharded):
    table = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.assign(table).count() == 0
    plan = sharding.assign(spark.range(9).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
