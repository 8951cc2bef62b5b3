"""The pipeline's stages one after another on a small table, each against what it must keep, drop and cut."""

import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tiktoken.load import load_tiktoken_bpe

import corpus_pipeline

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n):
    return " ".join(f"w{i}" for i in np.random.default_rng(seed).integers(0, 10**6, n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    passage, near = prose(500, 80), prose(501, 120).split()
    texts = [prose(i, 100 + 20 * i) for i in range(8)]
    texts += [" ".join(near), " ".join([*near[:60], "changed", *near[61:]]), f"{prose(20, 90)} {passage} {prose(21, 30)}", f"{prose(22, 95)} {passage}", "too short", "", None, "again and " * 400]
    rows = [(i, t, "en", [None, "s1", "s2", "s3"][i % 4], None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[0], (0, prose(30, 100), "en", "s1", 1), (None, texts[1], None, None, None), (None, prose(31, 100), None, None, None)]
    out = str(tmp_path_factory.mktemp("pipeline"))
    clashing = ["_mark", "_id", "_spot", "_removed", "key", "stats", "mark", "class", "node", "label", "kept", "mix_size", "mix_parts", "size", "words", "shard", "spans", "base_failed", "rule"]
    table = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in clashing})
    table.repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return out


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept, results = docs, []
    for _, stage in corpus_pipeline.STAGES:
        kept = corpus_pipeline.stored(stage(spark, kept, folder))
        results.append(kept)
    good, unique, cut, mixed, encoded = ([r.asDict() for r in r.collect()] for r in results)
    assert all(r.columns == docs.columns for r in results[:4])
    text_of = Counter((r.doc_id, r.text) for r in docs.collect())
    fails = lambda t: len(WORD.findall(t or "")) < 50 or t.startswith("again")
    assert Counter((r["doc_id"], r["text"]) for r in good) == Counter({k: n for k, n in text_of.items() if not fails(k[1])})
    # of copies and near copies the least id stays, of equal ids the text that nothing resembles too
    want = {k for k in text_of if not fails(k[1])} - {(9, next(t for i, t in text_of if i == 9)), (None, prose(1, 120))}
    assert Counter((r["doc_id"], r["text"]) for r in unique) == Counter(want)
    # the later one of a passage loses it, and no run of 50 words is left in two documents
    runs, passage = Counter(), WORD.findall(prose(500, 80))
    for r in cut:
        words = WORD.findall(r["text"])
        runs.update({tuple(words[k : k + 50]) for k in range(len(words) - 49)})
        assert (r["doc_id"], r["text"]) in want or r["n_chars"] == len(r["text"])
    assert max(runs.values()) == 1 and runs[tuple(passage[:50])] == 1 and len(cut) == len(unique)
    assert sum((r["doc_id"], r["text"]) not in want for r in cut) == 1
    assert all(r["n_chars"] == len(r["text"]) for r in mixed)
    size = sum(len(WORD.findall(r["text"])) for r in cut)
    assert abs(sum(len(WORD.findall(r["text"])) for r in mixed) - size) < 0.02 * size + 50
    for r in mixed:  # each row is a text or a part of one
        assert any(r["text"] in o["text"] and r["doc_id"] == o["doc_id"] for o in cut)
    ranks = load_tiktoken_bpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = lambda t: hashlib.sha256(np.array(library.encode_ordinary(t), "<u4").tobytes()).hexdigest()
    assert Counter((r["doc_id"], r["ids_sha256"]) for r in encoded) == Counter((r["doc_id"], ids(r["text"])) for r in mixed)


def test_run_and_empty_tables(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() > 0
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
