"""Substring dedup against brute force over all pairs of documents, all passages and all stretches of the other text."""

import re
import time
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from granary.llm import passages
from granary.llm.arrays import chunks, shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LEAST = passages.LEAST


def prose(seed, n, vocabulary=10**6):
    return " ".join(f"w{i}" for i in np.random.default_rng(seed).integers(0, vocabulary, n))


def brute_force(documents):
    """Links of pairs of distinct (id, text), as indices, and for the later of a pair the passages that repeat the other.

    Shingles are compared as strings; a stretch of the other text shares with a passage the shingles that both hold.
    """
    numbers, sequences = {}, []
    for _, text in documents:
        words = WORD.findall(text or "")
        sequences.append(np.array([numbers.setdefault(tuple(words[k : k + 5]), len(numbers)) for k in range(len(words) - 4)], np.int64))
    holders = defaultdict(set)
    for i, s in enumerate(sequences):
        if len(s) >= LEAST:
            for x in set(s.tolist()):
                holders[x].add(i)
    shared = defaultdict(int)
    for group in holders.values():
        ordered = sorted(group)
        for k, i in enumerate(ordered):
            for j in ordered[k + 1 :]:
                shared[i, j] += 1
    order = lambda i: (len(sequences[i]), documents[i][0] is not None, documents[i][0] or 0)
    links, gone = set(), defaultdict(set)
    for (i, j), n in shared.items():
        if n < 37:
            continue
        first, later = sorted((i, j), key=order)
        own, other = sequences[later], sequences[first]
        sums = np.zeros((len(own) + 1, len(other) + 1), np.int32)
        sums[1:, 1:] = (own[:, None] == other[None]).cumsum(0).cumsum(1)
        hits = np.zeros(len(own) - LEAST + 1, bool)
        for length in range(37, min(57, len(other)) + 1):
            both = sums[LEAST:, length:] - sums[:-LEAST, length:] - sums[LEAST:, :-length] + sums[:-LEAST, :-length]
            hits |= (both >= 0.8 * (LEAST + length - both) - 1e-9).any(1)
        if hits.any():
            links.add((i, j))
            gone[later] |= set(np.flatnonzero(hits).tolist())
    return links, gone


def compare(spark, rows):
    """How many of the links brute force finds hold as classes, how many passages stay, and how much goes without reason."""
    got = {}
    for r in passages.classed(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)).collect():
        got.setdefault(r.doc_id, []).append(r)
    documents = sorted({(i, t) for i, t, _ in rows}, key=str)
    links, gone = brute_force(documents)
    by_id = defaultdict(list)
    for k, (i, _) in enumerate(documents):
        by_id[i].append(k)
    of = lambda k: got[documents[k][0]][0]
    held = sum(of(i).class_id == of(j).class_id for i, j in links)
    stays = spurious = 0
    linked = {k for pair in links for k in pair}
    for k, (i, _) in enumerate(documents):
        if len(by_id[i]) > 1:
            continue
        removed = set()
        for s in of(k).removed:
            removed |= set(range(s["from"], s["to"]))
        repeats = set()
        for p in gone[k]:
            words = range(p, p + 50)
            repeats |= set(words)
            stays += not any(w in removed for w in words)
        spurious += bool(removed - repeats) + (k not in linked and of(k).n_links > 0)
    return len(links), held, stays, spurious


def edited(random, words, share):
    out = []
    for w in words:
        x = random.random()
        if x < share / 3:
            continue
        out.append(f"e{random.integers(10**6)}" if x < 2 * share / 3 else w)
        if x > 1 - share / 3:
            out.append(f"i{random.integers(10**6)}")
    return out


def families(seed, size=14):
    """Texts that quote edited forms of a few passages amid other words, short texts that hold parts of them, copies."""
    random = np.random.default_rng(seed)
    rows = []
    for f in range(3):
        passage = prose((seed, f, 0), 60 + 25 * f).split()
        forms = [passage]
        for k in range(size):
            source = forms[random.integers(len(forms))]  # edits of edits: near each other, not always near the first
            forms.append(edited(random, source, 0.03))
            rows.append(" ".join([prose((seed, f, k, 1), random.integers(0, 60)), *forms[-1], prose((seed, f, k, 2), random.integers(0, 60))]))
        for k in range(4):
            cut = random.integers(0, len(passage) - 27)
            rows.append(" ".join([*passage[cut : cut + 27], prose((seed, f, k, 3), 24)]))
        rows.append(rows[-6])
    line = prose((seed, 9), 16)
    rows += [f"{prose((seed, 10, k), 30)} {line} {prose((seed, 11, k), 30)}" for k in range(12)]
    return [(i, t, "en") for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("block", [4, 1024])
def test_families_of_edited_passages(spark, seed, block, monkeypatch):
    monkeypatch.setattr(passages, "BLOCK", block)
    links, held, stays, spurious = compare(spark, families(seed))
    assert links > 40 and (held, stays, spurious) == (links, 0, 0)


def test_generated_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    links, held, stays, spurious = compare(spark, [(r.doc_id, r.text, r.lang) for r in docs.collect()])
    assert links > 10 and held >= 0.99 * links and stays == 0


def test_passages_near_each_other_but_not_the_keys_first(spark):
    """Shorter texts hold most shingles of B and C, which are near each other only."""
    rows = []
    for f in range(16):
        left, right = prose(900 + f, 28), prose(1900 + f, 28)
        words = f"{left} {prose(2900 + f, 8)} {right}".split()
        other = [*words]
        other[3 + 3 * f] = "replaced"
        a = [f"{left} {prose(3900 + f, 23)}", f"{prose(4900 + f, 23)} {right}"]
        rows += [(4 * f + k, t) for k, t in enumerate([*a, " ".join(words), " ".join(other) + " tail"])]
    got = {r.doc_id: r for r in passages.classed(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert [f for f in range(16) if not (got[4 * f + 3].removed and got[4 * f + 2].repeated)] == []
    assert not any(got[4 * f + k].n_links for f in range(16) for k in (0, 1))


def test_nulls_copies_long_texts_and_clashing_names(spark):
    texts = [prose(i, 120 + 13 * i) for i in range(8)]
    texts += [texts[0], texts[0], texts[3] + " " + prose(99, 70), texts[4] + " " + prose(99, 70), prose(99, 70), "", None, " \n\t ", "a b " * 3000, "a b " * 2500 + "c", "one two", prose(77, 20000)]
    rows = [(i, t, "x", "y", "z", 1) for i, t in enumerate(texts)] + [(0, texts[0], "x", "y", "z", 1), (None, texts[5], None, None, None, None), (None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, mark string, to string, n_chars long").repartition(3)
    got = {}
    for r in passages.classed(docs).collect():
        got.setdefault(r.doc_id, r)
    assert len(got) == len(texts) + 1 and passages.classed(docs).count() == len(rows)
    assert {got[i].class_id for i in (0, 8, 9)} == {0} and got[5].class_id == 5
    assert {got[i].class_id for i in (3, 4, 10, 11, 12)} == {3} and got[16].class_id == got[17].class_id == 16
    assert all(not got[i].removed and not got[i].repeated for i in (1, 2, 6, 13, 14, 15, 18, 19))
    left = passages.without_repeats(docs)
    assert left.columns == docs.columns
    runs = defaultdict(int)
    for text in {(r.doc_id, r.text) for r in left.collect()}:
        words = WORD.findall(text[1] or "")
        for run in {tuple(words[k : k + 50]) for k in range(len(words) - 49)}:
            runs[run] += 1
    assert max(runs.values()) == 1
    assert passages.classed(docs.limit(0)).count() == 0 and passages.without_repeats(docs.limit(0)).count() == 0


def test_verify_takes_time_in_proportion_on_repeated_shingles():
    own = np.tile(np.array([3, 5], np.uint64), 100_000)
    began = time.time()
    mine, theirs = passages.verify(own, own[:-7], np.array([50]), np.array([51]))
    assert mine.all() and theirs.all() and time.time() - began < 5


def test_joint_windows_hold_the_minima_of_all_functions():
    random = np.random.default_rng(1)
    for trial in range(12):
        per_row = random.integers(0, 120, 4)
        found = random.integers(0, 2**63, per_row.sum(), dtype=np.uint64)
        if trial % 3 == 0 and len(found):
            found = random.choice(found[:30], len(found))  # ties
        keys, rows, centre, low, high, left, right = passages.joint_windows(found, per_row)
        want, begin = [], 0
        for row, n in enumerate(per_row):
            last = None
            for start in range(begin, begin + n - passages.RUN + 1):
                values = [(found[start : start + passages.RUN] * f) >> np.uint64(31) for f in passages._FACTORS]
                at = [start - begin + int(v.argmin()) for v in values]
                if at != last and n >= LEAST:
                    want.append((row, at[0], min(at), max(at)))
                last = at
            begin += n
        assert want == list(zip(rows, centre, low, high, strict=True)) and len(keys) == len(want)
        half = (passages.RUN - (high - low)) // 2
        assert ((left >= 0) == (low >= half)).all() and ((right >= 0) == (high + half < per_row[rows])).all()


def test_every_repeat_shares_a_joint_window():
    """A word replaced, put in or left out of 50, or its halves swapped: the shared run's windows have a key in common."""
    for f in range(1000):
        words = prose(f, 50).split()
        at = 24 + f % 2
        other = [words[:at] + ["x"] + words[at + 1 :], words[:at] + ["x"] + words[at:], words[: at - 1] + words[at:] + ["x"], words[25:] + words[:25]][f % 4]
        if f % 4 == 3:
            words, other = [*words, *prose(-f % 97, 20).split()], [*other, *prose(f + 5000, 20).split()]
        keys = []
        for text in (words, other):
            found, per_row, _ = shingles(next(chunks(pa.array([" ".join(text)]))), passages.WIDTH)
            key, *_, left, right = passages.joint_windows(found, per_row)
            keys.append({*zip(key.tolist(), left.tolist(), strict=True)} | {*zip((key + np.uint64(1)).tolist(), right.tolist(), strict=True)})
        assert keys[0] & keys[1]
