"""Nearest rows by packed blocks: several blocks and ranges, and what is written on the way."""

from collections import Counter
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__
from granary.operators import cosine, nearest, similarity
from granary.plans import evaluation

from .test_nearest import brute


def texts(n: int, seed: int) -> list[str]:
    draw = np.random.default_rng(seed)
    words = (draw.pareto(0.7, (n, 60)) * 3).astype(int) % 5000
    return [" ".join(f"word{k}" for k in row) for row in words]


def test_blocks_ranges_and_slabs(spark, monkeypatch):
    for name, value in {"ROWS": 64, "RANGE": 500, "PACKED": 300, "EXPANDED": 100, "DENSE": 32, "SLAB": 16, "STRIPE": 7, "MEET": 2, "SAMPLE": 50, "HEAD": 200}.items():
        monkeypatch.setattr(cosine, name, value)
    train = [(k, f"T{k}", t) for k, t in enumerate(texts(260, 1))] + [(900 - k, f"C{k}", t) for k, t in enumerate(texts(20, 1))] + [(901, "T901", None)]
    asks = [(f"Q{k}", t) for k, t in enumerate(texts(90, 2) + texts(10, 1))] + [("Q3", "nothing shared"), ("Q4", None)]
    got = nearest.nearest(spark.createDataFrame(asks, "cve_id string, text string").repartition(3), spark.createDataFrame(train, "ord long, cve_id string, text string").repartition(5))
    assert Counter((r.query_id, r.train_id, round(r.similarity, 9)) for r in got.collect()) == brute(asks, train)


def stored_rows(spark, monkeypatch, run) -> int:
    """Rows of all tables that a query stores."""
    kept = []
    for module in (cosine, nearest):
        monkeypatch.setattr(module, "stored", lambda df, write=module.stored: kept.append(write(df)) or kept[-1])
    monkeypatch.setattr(cosine, "stored_alone", lambda spark, make: cosine.stored(make()))
    run()
    return sum(t.count() for t in kept)


@pytest.mark.parametrize("name", ["tfidf_nearest", "audit_summary"])
def test_no_row_for_each_term_is_stored(spark, monkeypatch, name):
    """Terms travel packed: what is stored has a row a text and one a block, not one for each term of a text."""
    sf = "/root/testdata/sf0.001"
    documents = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert stored_rows(spark, monkeypatch, lambda: __spark_entry__.queries()[name](spark, sf)) <= 2 * documents


def test_texts_of_documents_with_several_labels(spark, tmp_path):
    """Each row of labels makes a row; a document without labels is one."""
    from granary.plans import evaluation

    spark.createDataFrame([(k, f"some text {k}", "en", "src1") for k in range(4)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    for labels, want in (([1, 2], [0, 1, 2, 3]), ([1, 1, 2], [0, 1, 1, 2, 3])):
        spark.createDataFrame([(k, 1, 0) for k in labels], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
        assert sorted(r.ord for r in evaluation._texts(spark, str(tmp_path)).collect()) == want


def test_closest_pairs_move_no_other_texts(spark):
    """Texts meet the twenty pairs by broadcasts, so no text is shuffled or sorted."""
    plan = __spark_entry__.queries()["closest_pairs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_an_audit_makes_its_rows_once(spark, tmp_path):
    """Whether there are rows is asked of the stored ones, so nearest rows are not sought twice."""

    def marked(batches):
        (tmp_path / uuid4().hex).touch()
        yield from batches

    rows = spark.createDataFrame([(k / 10, k % 2 == 0, "both_right") for k in range(10)], "similarity double, same_label boolean, transition string").repartition(2)
    similarity.audit_summary(rows.mapInArrow(marked, rows.schema)).collect()
    assert len(list(tmp_path.iterdir())) == 2  # a mark for each of two partitions
    with pytest.raises(ValueError, match="needs rows"):
        similarity.audit_summary(rows.where("similarity > 1"))


def test_an_audit_reads_outputs_of_its_queries_only(spark, monkeypatch):
    """Only the test split asks, so only its outputs are verified."""
    seen = []
    whole = evaluation.verified
    monkeypatch.setattr(evaluation, "verified", lambda rows, *a: seen.append(rows) or whole(rows, *a))
    sf = "/root/testdata/sf0.001"
    __spark_entry__.queries()["audit_summary"](spark, sf)
    want = evaluation.records(spark, sf).where("split = 'test'").count()
    assert [rows.count() for rows in seen] == [want, want]


def test_products_of_many_copies(monkeypatch):
    """Sums over postings stay in double precision, however many steps they take."""
    for name, value in {"DENSE": 32, "SLAB": 16, "STRIPE": 4, "EXPANDED": 1}.items():
        monkeypatch.setattr(cosine, name, value)
    n, terms = 9, 4_000
    unit = np.tile(np.arange(32, 32 + terms), (n, 1)).T.ravel()
    block = lambda: cosine.Block(np.arange(n), np.arange(n), unit, np.tile(np.arange(n), terms), np.full(n * terms, terms**-0.5), 0, np.arange(0, n * terms, n))
    assert np.abs(cosine.products(block(), block()) - 1).max() < 1e-6


def test_queries_travel_once_a_task(spark, monkeypatch):
    """Of the pairs of blocks in a task only a query block's first brings its rows; without them it is an error."""
    for name, value in {"ROWS": 32, "MEET": 2, "ASK": 2}.items():
        monkeypatch.setattr(cosine, name, value)
    pairs, sent = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def watched(*a, compared=cosine._compared):
        def counted(batches):
            for batch in batches:
                pairs.add(batch.num_rows)
                sent.add(batch.num_rows - batch.column("q").null_count)
                yield batch

        return lambda batches: compared(*a)(counted(batches))

    monkeypatch.setattr(cosine, "_compared", watched)
    train, asks = [(k, f"T{k}", t) for k, t in enumerate(texts(320, 3))], [(f"Q{k}", t) for k, t in enumerate(texts(64, 4))]
    got = nearest.nearest(spark.createDataFrame(asks, "cve_id string, text string").coalesce(1), spark.createDataFrame(train, "ord long, cve_id string, text string").coalesce(1))
    assert Counter((r.query_id, r.train_id, round(r.similarity, 9)) for r in got.collect()) == brute(asks, train)
    assert pairs.value == 2 * 10 and 2 <= sent.value < pairs.value
    lost = pa.RecordBatch.from_pydict({"asking": [0], "q": pa.nulls(1), "t": pa.nulls(1)})
    with pytest.raises(ValueError, match="without its rows"):
        next(watched(None, 1)(iter([lost])))
