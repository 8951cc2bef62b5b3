"""The llm operators against brute force on small tables with nulls, empty and long texts, ties, copies and clashing names."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from granary.llm import ann, bpe, chat, ctw, mixing, near, quality, url_filter
from granary.llm.arrays import chunks
from granary.llm.lineage import stored

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, stats string, key string, mark string"


def prose(seed, n, vocabulary=4000):
    return " ".join(f"w{i}" for i in np.random.default_rng(seed).integers(0, vocabulary, n))


@pytest.fixture(scope="module")
def docs(spark):
    passage = prose(99, 70)
    texts = [prose(i, 120 + 13 * i) for i in range(12)]
    texts += [texts[0], texts[0], texts[1] + " tail", texts[2].replace(" w", " w", 1), texts[3] + " " + passage, texts[4] + " " + passage, passage]
    texts += ["", None, "one two", "one two", " \n\t ", "a b " * 3000, "ß Ｗ 中文\n\ndup\ndup\n", prose(7, 20000)]
    rows = [(i, t, "en", None if i % 7 == 3 else f"s{i % 4}", None, "x", "y", "z") for i, t in enumerate(texts)]
    rows += [rows[0], (None, texts[5], None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


def pairs(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


# 1


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "\\", "<\\/s>", "\\\\<s>", "<<SYS>>\n<</SYS>>", "[ROLE]x[/ROLE]y[/TURN]\n", "", "<", "ends with <<", "é😀"]
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(texts)]
    rows += [(2, None, None, None), (2, 0, "tool</s>", "<s>"), (2, 0, "tool</s>", "<s>"), (None, 1, "assistant", "x"), (3, 0, "user", "q"), (3, 1, "assistant", "a")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    done = chat.format_chats(table).withColumns({"turns": chat.read_turns(F.col("formatted")), "learnt": chat.read_loss(F.col("segments"))})
    got = {r.conv_id: r for r in done.collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(r, t) for _, _, r, t in rows[:10]]
    assert got[1].learnt == "".join(texts[1::2]) and got[1].valid
    assert [(t.role, t.text) for t in got[2].turns] == [("tool</s>", "<s>"), ("tool</s>", "<s>"), ("", "")] and not got[2].valid and got[2].refused_turn == 0
    assert got[3].valid and got[None].refused_turn == 0
    assert chat.format_chats(table.limit(0)).count() == 0
    long = [(1, k, "user" if k % 2 == 0 else "assistant", f"</s>{k} " * 60_000) for k in range(4)]
    done = chat.format_chats(spark.createDataFrame(long, "conv_id long, turn long, role string, text string"))
    got = done.select(chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("segments")).alias("learnt")).first()
    assert [t.text for t in got.turns] == [t for *_, t in long] and got.learnt == long[1][3] + long[3][3]


def test_template_rejects_overlaps():
    with pytest.raises(ValueError):
        chat.Template(roles={"user": chat.Markers("<a>", "><a")})


# 2


def test_bpe_equals_the_library(spark, docs):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    vocabulary = bpe.load_vocabulary(path)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_texts(docs, path, public_tokenizers.PATTERN, ids=False).collect())
    want = Counter()
    for i, text in pairs(docs):
        ids = library.encode_ordinary(text)
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert got == want
    edited = bpe.EditableText(vocabulary, public_tokenizers.PATTERN, "it's  a test")
    edited.append("ing 're")
    edited.replace(2, 3, "x\n\n ")
    assert edited.ids() == library.encode_ordinary(edited.text)
    assert bpe.encode_texts(docs.limit(0), path, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(ValueError):
        bpe.encode_texts(docs.withColumn("ids", F.lit(1)), path, public_tokenizers.PATTERN, keep=("ids",))


@pytest.mark.parametrize("pattern", [public_tokenizers.PATTERN, r"[^\s\p{L}]+[\r\n]*|\p{L}+| +|\s+"])
def test_bpe_edits_by_any_pattern(pattern):
    vocabulary = bpe.Vocabulary(bpe.load_vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).ranks)
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=vocabulary.ranks, special_tokens={})
    random = np.random.default_rng(5)
    bits = ["it's", " ", "  ", "\n", "!!\n", "\r\n ", "naïve", "日本語", "2024", "\u3000", "…", "x" * 70, "unbelievable", "\x85", "é"]
    encoder, text = bpe.Encoder(vocabulary, pattern), ""
    encoder.known_chunks, encoder.known_pieces = bpe.Memory(10), bpe.Memory(10)  # what is forgotten is encoded anew
    edited = bpe.EditableText(vocabulary, pattern)
    for _ in range(120):
        begin = int(random.integers(0, len(text) + 1))
        end = min(len(text), begin + int(random.integers(0, 6)))
        new = "".join(random.choice(bits, int(random.integers(0, 4))))
        text = text[:begin] + new + text[end:]
        edited.replace(begin, end, new)
        assert edited.ids() == library.encode_ordinary(text)
    texts = [text, "", "".join(random.choice(bits, 300)), "é" * 3000, text]
    assert [np.frombuffer(d, "<u4").tolist() for d in encoder.encode_all(texts)] == [library.encode_ordinary(t) for t in texts]


# 3


def clusters(random, n, width=16, kinds=40):
    """Points in clusters within clusters."""
    outer = random.normal(size=(kinds, width)) * 4
    inner = outer[random.integers(0, kinds, 10 * kinds)] + random.normal(size=(10 * kinds, width))
    return inner[random.integers(0, 10 * kinds, n)] + random.normal(size=(n, width)) * 0.3


def recall_of(got, points, ids, k=10):
    hits = total = 0
    for query, group in got.groupby("query_id"):
        distance = np.sqrt(((points - points[list(ids).index(query)]) ** 2).sum(1))
        distance[list(ids).index(query)] = np.inf
        best = ids[np.lexsort((ids, distance))[:k]]
        hits, total = hits + len(set(best) & set(group.vec_id)), total + k
        assert list(group.sort_values("rank")["rank"]) == list(range(1, k + 1))
        place = {v: i for i, v in enumerate(ids)}
        assert np.allclose(group.score, [distance[place[v]] for v in group.vec_id], rtol=1e-12, atol=0)
    return hits / total


def test_ann(spark):
    random = np.random.default_rng(3)
    points = clusters(random, 6000)
    rows = [(i, [float(x) for x in p], 0) for i, p in enumerate(points)]
    rows += [(9000, None, 0), (9100, [0.0] * 16, 0), (9200, [None] + [1.0] * 15, 0), (9300, [float("nan")] * 16, 0), (9400, [1.0], 0), (9500, [], 0), (None, [1.0] * 16, 0), (9601, rows[101][1], 0), (200, rows[200][1], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cell int").repartition(3)
    got = ann.search(table, F.col("vec_id") % 100 == 0).toPandas()
    assert got.query_id.nunique() == 60 and recall_of(got, np.vstack([points, points[101]]), np.append(np.arange(6000), 9601)) >= 0.9
    few = ann.search(table.where("vec_id IN (0, 1, 2)"), F.col("vec_id") % 100 == 0).collect()
    assert [(r.query_id, r.rank) for r in few] == [(0, 1), (0, 2)]
    assert ann.search(table.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    two = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 2.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert sorted((r.query_id, r.rank, r.vec_id) for r in ann.search(two, F.col("vec_id") == 0).collect()) == [(0, 1, 1), (0, 1, 1), (0, 2, 0), (0, 2, 0)]


def test_ann_levels_and_hot_copies(spark, monkeypatch):
    """Small partitions: two levels are split, a third of the rows are one vector, and queries probe few partitions."""
    monkeypatch.setattr(ann, "PER_PARTITION", 100)
    random = np.random.default_rng(5)
    points = clusters(random, 8000)
    points[random.permutation(8000)[:2600]] = points[1]
    rows = stored(spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "vec_id long, embedding array<double>").repartition(4))
    placed = ann.partitioned(rows.select((F.col("vec_id") % 50 == 7).alias("asks"), "vec_id", F.xxhash64("embedding").alias("mark"), "embedding").unionByName(rows.select(F.lit(False).alias("asks"), "vec_id", F.xxhash64("embedding").alias("mark"), "embedding").where("vec_id % 50 = 7")), 8, 10, 4096, 0.97).toPandas()
    vectors, queries = placed[~placed.asks], placed[placed.asks]
    assert len(vectors) == 8000 and vectors.cell.nunique() > 24 and (vectors.cell > 64).any()
    sizes = vectors.groupby("cell").size()
    met = queries.cell.map(sizes).fillna(0).groupby(queries.vec_id).sum()
    assert met.median() < 0.5 * 8000
    got = ann.search(rows, F.col("vec_id") % 50 == 7, parts=8).toPandas()
    assert got.query_id.nunique() == 160 and recall_of(got[~got.query_id.isin(np.flatnonzero((points == points[1]).all(1)))], points, np.arange(8000)) >= 0.9


# 4


def test_apportionment_is_by_highest_quotients():
    random = np.random.default_rng(1)
    for _ in range(50):
        weights, seats = random.integers(0, 50, 6), int(random.integers(0, 60))
        most = random.integers(0, 30, 6)
        want = np.zeros(6, int)
        for _ in range(seats):
            quotients = np.where((want < most) & (weights > 0), weights / (2 * want + 1), -1)
            if quotients.max() < 0:
                break
            want[quotients.argmax()] += 1
        assert mixing.apportion(weights, seats, most).tolist() == want.tolist()


def test_mixing(spark, docs):
    clashing = docs.withColumns({"mix_parts": F.lit("clash"), "mix_size": F.lit(1), "shard": F.lit(2)})
    assert mixing.mixed_texts(clashing).columns == clashing.columns and mixing.mixed_texts(clashing).count() > 0
    got = mixing.mix(docs).toPandas()
    sizes = Counter()
    for r in docs.collect():
        sizes[r.source] += len(WORD.findall(r.text or ""))
    names = sorted(s for s in sizes if s is not None) + [None]
    weight, target = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, {}
    left, open_ = sum(sizes.values()), set(names)
    while True:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * level > 3 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
            open_.discard(s)
    target |= {s: weight[s] * level for s in open_}
    assert len(got) == docs.count() and (got.taken <= 3 * got["size"]).all()
    assert sorted(round(x, 6) for x in got.target.unique()) == sorted({round(x, 6) for x in target.values()})
    for value, group in got.groupby("target"):
        assert abs(group.taken.sum() - value) < 0.02 * value + 40
    again = mixing.mix(docs.repartition(5)).toPandas()
    assert sorted(got[["doc_id", "size", "taken"]].fillna(-1).itertuples(index=False)) == sorted(again[["doc_id", "size", "taken"]].fillna(-1).itertuples(index=False))
    split = mixing.mix(docs, shard=100).toPandas()
    for value, group in split.groupby("target"):
        assert abs(group.taken.sum() - value) < 0.02 * value + 300
    words = mixing.mixed_texts(docs).select(F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).first()[0]
    assert words == got.taken.sum() and mixing.mix(docs.limit(0)).count() == 0


# 6


def test_quality_counts_and_lists(spark, docs):
    got = Counter(tuple(r) for r in quality.text_stats(docs).select("doc_id", "stats.n_words", "stats.word_chars", "stats.n_symbols", "stats.n_dup_lines", "stats.n_repeat_words").collect())
    want = Counter()
    for i, text in pairs(docs):
        words = WORD.findall(text)
        triples = list(zip(words, words[1:], words[2:], strict=False))
        counts, covered, seen, again = Counter(triples), set(), set(), 0
        for k, t in enumerate(triples):
            covered |= {k, k + 1, k + 2} if counts[t] > 1 else set()
        for line in text.split("\n"):
            again += bool(WORD.search(line)) and line in seen
            seen.add(line)
        want[i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)] += 1
    assert got == want
    random = np.random.default_rng(0)
    data = {"a": random.random(3000), "b": random.random(3000), "c": random.random(3000)}
    bad = (data["a"] > 0.8) & (data["b"] < 0.5)
    rejected = np.zeros(3000, bool)
    for rule in quality.learn(data, bad):
        rejected |= quality._covers(rule.conditions, data)
    assert (rejected == bad).mean() > 0.98
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.judge(docs, none).where("kept = base_failed").count() == 0
    assert quality.keep_good(docs, none).columns == docs.columns and quality.judge(docs.limit(0), none).count() == 0


def test_quality_held_out(spark):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet")
    labels = read("labels")
    taught = labels.where("doc_id % 2 = 0")
    judged = quality.judge(read("documents"), taught).join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    assert ((judged["rule"] > 0) == (judged.quality == 0)).mean() > 0.95


# 7


def test_ctw_and_unigrams(spark, docs):
    texts = {i: re.sub("[A-Z]", lambda m: m[0].lower(), t) for i, t in pairs(docs) if i is not None and len(t) < 1200}
    some = docs.where(F.col("doc_id").isin(list(texts))).dropDuplicates(["doc_id"])
    got = {r.doc_id: r for r in ctw.score(some, depth=2, head=50).collect()}
    taught = [i for i in texts if zlib.crc32(str(i).encode()) % 7 != 2]
    words = Counter(w for i in taught for w in WORD.findall(texts[i]))
    n, v = sum(words.values()) + len(taught), len(words) + 2  # kinds: words, the end and one for all others
    from math import exp, lgamma, log, log10, pi

    counts = Counter()
    steps = lambda data: ((x, k, (1 << k) | (data[x] >> (8 - k)), data[x] >> (7 - k) & 1) for x in range(2, len(data)) for k in range(8))
    for i in taught:
        data = b"\0\0" + texts[i].encode()
        for x, _, node, bit in steps(data):
            for d in range(3):
                counts[data[x - d : x], node, bit] += 1
    pe = lambda c, s: lgamma(counts[c, s, 0] + 0.5) + lgamma(counts[c, s, 1] + 0.5) - lgamma(counts[c, s, 0] + counts[c, s, 1] + 1) - log(pi)
    weighted = {}
    for d in (2, 1, 0):
        below = Counter()
        for (c, s), w in weighted.items():
            if len(c) == d + 1:
                below[c[1:], s] += w
        for c, s in {(c, s) for c, s, _ in counts if len(c) == d}:
            own = pe(c, s)
            weighted[c, s] = own if d == 2 else log(0.5) + max(own, below[c, s]) + np.log1p(exp(-abs(own - below[c, s])))
    for i, text in texts.items():
        base = sum(log10((words[w] + 1) / (n + v)) for w in WORD.findall(text)) + log10((len(taught) + 1) / (n + v))
        data, score = b"\0\0" + text.encode(), 0.0
        for x, _, node, bit in steps(data):
            p, rest = 0.0, 1.0
            for d in range(3):
                c = data[x - d : x]
                share = 1.0 if d == 2 else exp(log(0.5) + pe(c, node) - weighted[c, node]) if (c, node) in weighted else 0.5
                p += rest * share * (counts[c, node, 1] + 0.5) / (counts[c, node, 0] + counts[c, node, 1] + 1)
                rest *= 1 - share
            score += log10(p if bit else 1 - p)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (i not in taught, len(WORD.findall(text)) + 1, n)
        assert r.n_known == sum(w in words for w in WORD.findall(text)) + 1
        assert abs(r.base_score - base) < 1e-6 * abs(base) + 1e-9 and abs(r.score - score) < 1e-6 * abs(score) + 1e-9
    assert ctw.score(docs.limit(0)).count() == 0 and ctw.score(docs).count() == docs.count()


# 8


def test_url_filter(spark):
    rules = [url_filter.Rule("org/", "allow"), url_filter.Rule("example.org/en/1", "block"), url_filter.Rule("||bad^", "block", True), url_filter.Rule("a*z|", "block", True), url_filter.Rule("good", "allow", True)]
    urls = {
        "http://x.org/": ("org/", "allow"), "http://x.org": (None, "allow"), "https://EXAMPLE.org/en/15?q": ("example.org/en/1", "block"), "http://notexample.org/en/1": ("org/", "allow"),
        "http://bad/": (None, "block"), "http://x.bad:80/": (None, "block"), "http://notbad/": (None, "allow"), "http://q.com/abz": (None, "block"), "http://q.com/abz-good/z": (None, "allow"), "plain": (None, "allow"), "": (None, "allow"),
    }
    rows = [(i, u, "h", "clash") for i, u in enumerate(urls)] + [(99, None, None, "clash"), (0, "http://x.org/", "h", "clash"), (None, "http://x.org/", None, None)]
    got = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string, verdict string"), rules).collect()
    assert len(got) == len(rows)
    by_id = {r.page_id: r for r in got}
    for i, (url, want) in enumerate(urls.items()):
        assert (by_id[i].rule, by_id[i].verdict) == want, url
    assert (by_id[99].host, by_id[99].path, by_id[99].verdict) == ("", "", "allow")
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string"), rules).count() == 0
    long = [(1, "http://bad/" + "x" * 300_000), (2, "http://fine.net/" + "bad/" * 100_000)]
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(spark.createDataFrame(long, "page_id long, url string"), rules).collect()}
    assert got == {1: "block", 2: "allow"}


def test_native_operators_match_their_sql(spark):
    """op1, op8 and op9, whose results SQL can express, on the smallest tables."""
    import duckdb

    from granary.llm import queries
    from tests.test_queries import plain

    folder = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    for t in ("conversations", "pages"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        rows = queries.QUERIES[name](spark, folder)
        found = duck.execute(sql)
        have = [d[0] for d in found.description]
        assert sorted(have) == sorted(rows.columns)
        assert sorted((tuple(plain(r[c]) for c in have) for r in rows.collect()), key=repr) == sorted((tuple(map(plain, r)) for r in found.fetchall()), key=repr), name


# 10


@pytest.mark.parametrize("block", [3, 1024])
def test_near_duplicates(spark, docs, block, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", block)
    monkeypatch.setattr(near.in_blocks, "__defaults__", ((), block))
    rows = pairs(docs)
    sets = []
    for _, text in rows:
        words = WORD.findall(text)
        sets.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    parent, links = list(range(len(rows))), Counter()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min((x for x in (least.get(root(i)), d) if x is not None), default=None)
    want = Counter((d, least[root(i)], links[i]) for i, (d, _) in enumerate(rows))
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in near.near_duplicates(docs).collect()) == want
    kept = near.without_near_duplicates(docs)
    assert kept.columns == docs.columns and near.near_duplicates(docs.limit(0)).count() == 0
    stay = [least[r] for r in {root(i) for i in range(len(rows))}]
    assert Counter(r.doc_id for r in kept.collect()) == Counter(stay)


def test_a_unique_text_stays_though_its_id_names_another(spark):
    a, b = prose(1, 80), prose(2, 80)
    rows = [(1, a), (2, a), (2, b), (None, a), (None, b + " x"), (None, prose(3, 90)), (1, a)]
    kept = near.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(1, a), (2, b), (None, prose(3, 90))])
    assert near.without_near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hashes_tell_thue_morse_strings_apart(spark):
    """Polynomial hashes modulo a power of two give both strings one value."""
    swap = str.maketrans("ab", "ba")
    text = "a"
    while len(text) < 4096:
        text += text.translate(swap)
        found = next(chunks(pa.array([text + "\n" + text.translate(swap) + "\n" + text])))
        a, b, c = found.hashes(*found.words())
        assert a == c != b
    stats = quality.text_stats(spark.createDataFrame([(1, text + "\n" + text.translate(swap))], "doc_id long, text string")).first().stats
    assert (stats.n_words, stats.n_dup_lines) == (2, 0)


def test_long_text_is_one_chunk():
    import pyarrow as pa

    parts = list(chunks(pa.array(["a " * 900_000, None, "b"])))
    assert [p.n for p in parts] == [1, 2] and len(parts[0].data) == 1_800_000


# 9


def test_warc_revisits(spark):
    from granary.llm import warc

    day = 86_400
    rows = [
        (1, "HTTP://A.org:80/x#f", 10, "response", '"t1"', None, None, {"Content-Type": "text/html", "Date": "d1"}),
        (2, "http://a.org/x", 20, "response", '"t2"', "m2", None, {"Content-Type": "text/plain", "ETag": "e2"}),
        (3, "http://a.org/x", 20, "response", '"t3"', "m2", None, None),
        (4, "http://a.org/x", 20, "revisit", 'W/"t1"', None, None, {"DATE": "d4", "Content-Type": "no"}),
        (5, "http://a.org/x", 5 * day, "revisit", '"t3"', None, None, {"Date": "d5"}),
        (6, "http://a.org/x", 5, "revisit", '"t1"', None, None, None),
        (7, "http://a.org/x", 3 * day, "revisit", None, "m2", None, None),
        (8, "http://a.org/x", 3 * day, "revisit", '"zz"', "m2", None, None),
        (9, "http://a.org/x", 3 * day, "revisit", None, None, "sha", None),
        (10, None, 30, "revisit", None, None, None, None),
        (11, "http://a.org/x", None, "revisit", '"t1"', None, None, None),
        (12, None, 1, "response", '"t1"', None, None, None),
        (5, "http://a.org/x", 5 * day, "revisit", '"t3"', None, None, {"Date": "d5"}),
    ]
    table = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>").withColumn("near", F.lit("clash"))
    out = warc.resolve_revisits(table).collect()
    got = {r.record_id: (r.response_id, r.outcome) for r in out}
    assert len(out) == 9 and got == {
        4: (1, "resolved"), 5: (3, "resolved"), 6: (None, "no_earlier_response"), 7: (3, "resolved"), 8: (3, "validator_mismatch"),
        9: (3, "no_validator"), 10: (None, "no_earlier_response"), 11: (None, "no_earlier_response"),
    }
    merged = {r.record_id: {h.key: h.value for h in r.headers} for r in out}
    assert merged[4] == {"content-type": "text/html", "date": "d4"} and merged[5] == {"date": "d5"}
    assert warc.resolve_revisits(table.limit(0)).count() == 0
    long = {f"X-{k}": "v" * 5000 for k in range(200)}
    many = [(k, "http://b.org/", k // 2, "response", f'"{k}"', None, None, long) for k in range(300)] + [(1000 + k, "http://b.org/", k, "revisit", f'"{2 * k - 1}"', None, None, {"Date": "now"}) for k in range(1, 150)]
    out = warc.resolve_revisits(spark.createDataFrame(many, table.drop("near").schema), bucket=40).collect()
    assert {(r.record_id, r.response_id, r.outcome, len(r.headers)) for r in out} == {(1000 + k, 2 * k - 1, "resolved", 201) for k in range(1, 150)}
