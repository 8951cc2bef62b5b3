"""From canonical rows to leakage-free splits: eligibility, temporal split, labels, dedup, overlaps and the guard.

Rows have cve_id, published, cwe_id, label_status, is_rejected, description_en and description_norm_hash; published is
an ISO date in a string and is compared as such.
"""

from __future__ import annotations

from itertools import combinations
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import text_hash
from ..sources.shared import stored

SPLITS = ("train", "val", "test")


def eligible(rejected: Column, description: Column, status: Column, flags: dict[str, bool] | None = None) -> Column:
    """Not rejected, described and singly labelled, as far as the filter's flags ask for it."""
    flags = flags or {}
    out = F.lit(True)
    if flags.get("exclude_rejected", True):
        out &= ~rejected
    if flags.get("require_english_description", True):
        out &= F.coalesce(F.length(description) > 0, F.lit(False))
    if flags.get("single_label_only", True):
        out &= F.coalesce(status == "single", F.lit(False))
    return out


def split_of(published: Column, ranges: dict[str, list], snapshot: str) -> Column:
    """The first split whose inclusive range holds the date; null outside all."""
    out = None
    for name, (low, high) in ranges.items():
        inside = published.between(low, high or snapshot)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out


def select_labels(train: DataFrame, top_k: int, min_count: int) -> DataFrame:
    """rank, cwe_id, train_count: the top_k labels by count, then name; of these the ones with min_count rows."""
    counts = train.groupBy("cwe_id").agg(F.count(F.lit(1)).alias("train_count"))
    place = F.row_number().over(Window.orderBy(F.desc("train_count"), "cwe_id"))
    return counts.withColumn("rank", place).where((F.col("rank") <= top_k) & (F.col("train_count") >= min_count)).select("rank", "cwe_id", "train_count")


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows whose label is selected. The labels are few by choice: at most top_k."""
    return rows.join(F.broadcast(labels.select("cwe_id")), "cwe_id", "left_semi")


def first_wins(rows: DataFrame, *also: str, content: str = "description_norm_hash") -> DataFrame:
    """For each content (and columns also) the first row by published and id."""
    place = F.row_number().over(Window.partitionBy(*also, content).orderBy("published", "cve_id"))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """For each left row whose key the right has: ord, cve_id and other_id, the id of the right's last row of the key."""
    if key not in ("cve_id", "description_norm_hash"):
        raise ValueError(f"unknown overlap key {key!r}")
    last = right.groupBy(key).agg(F.max_by("cve_id", "ord").alias("other_id"))
    return left.join(last, key).select("ord", "cve_id", "other_id")


def without_overlap(rows: DataFrame, *others: DataFrame, key: str = "description_norm_hash") -> DataFrame:
    """Rows whose key no other table has."""
    taken = others[0].select(key)
    for other in others[1:]:
        taken = taken.union(other.select(key))
    return rows.join(taken.distinct(), key, "left_anti")


def curated(population: DataFrame, dedup: dict[str, bool]) -> DataFrame:
    """The populations of all splits (column split) without what the dedup settings drop, in one pass by content.

    Overlaps are taken against the populations as they are, the train rows' own copies included. Of a content, a window
    says which splits have it and which of its train rows is the first; a null content overlaps nothing.
    """
    w = Window.partitionBy("description_norm_hash")
    known = F.col("description_norm_hash").isNotNull()
    has = {s: F.max(F.coalesce(F.col("split") == s, F.lit(False))).over(w) & known for s in SPLITS}
    place = F.row_number().over(Window.partitionBy("description_norm_hash", "split").orderBy("published", "cve_id"))
    marked = population.withColumns({f"_{s}": c for s, c in has.items()} | {"_place": place})
    drops = {
        "drop_train_exact_duplicates": (F.col("split") == "train") & (F.col("_place") > 1),
        "drop_train_overlap_with_eval": (F.col("split") == "train") & (F.col("_val") | F.col("_test")),
        "drop_val_overlap_with_test": (F.col("split") == "val") & (F.col("_train") | F.col("_test")),
    }
    goes = F.lit(False)
    for name, condition in drops.items():
        goes |= condition & F.lit(bool(dedup.get(name)))
    return marked.where(F.col("split").isin(*SPLITS) & ~goes).select(*population.columns)


def hash_of(rows: DataFrame) -> Column:
    """The stored content hash, else that of the description; an error where a row has neither."""
    names = set(rows.columns)
    known = F.col("description_norm_hash") if "description_norm_hash" in names else F.lit(None).cast("string")
    text = "description_en" if "description_en" in names else "description" if "description" in names else None
    fallback = text_hash(F.col(text)) if text else F.lit(None).cast("string")
    value = F.coalesce(known, fallback)
    return F.when(value.isNull(), F.raise_error(F.lit("a row has neither a content hash nor a description"))).otherwise(value)


def shared_keys(rows: DataFrame) -> DataFrame:
    """left, right, kind, key, left_id, right_id: each id and content hash that two splits have, with their first ids.

    Rows have split, cve_id, text_hash and ord.
    """
    keys = rows.select("split", "cve_id", "ord", F.explode(F.array(F.struct(F.lit("cve_id").alias("kind"), F.col("cve_id").alias("key")), F.struct(F.lit("text_hash").alias("kind"), F.col("text_hash").alias("key")))).alias("k"))
    first = keys.select("split", "cve_id", "ord", "k.*").groupBy("kind", "key").pivot("split", list(SPLITS)).agg(F.min_by("cve_id", "ord"))
    pairs = F.explode(F.array(*(F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(a).alias("left_id"), F.col(b).alias("right_id")) for a, b in combinations(SPLITS, 2))))
    return first.select("kind", "key", pairs.alias("p")).where("p.left_id IS NOT NULL AND p.right_id IS NOT NULL").select("p.left", "p.right", "kind", "key", "p.left_id", "p.right_id")


def guard(rows: DataFrame, examples: int = 5) -> dict[str, Any]:
    """Per pair of splits the number of shared ids and contents, with a few shared contents; ok if there is none."""
    shared = stored(shared_keys(rows))
    counts = {(r["left"], r["right"], r["kind"]): r["count"] for r in shared.groupBy("left", "right", "kind").count().collect()}
    place = F.row_number().over(Window.partitionBy("left", "right").orderBy("key"))
    few = shared.where("kind = 'text_hash'").withColumn("_place", place).where(F.col("_place") <= examples).orderBy("key").collect()
    pairs = {}
    for a, b in combinations(SPLITS, 2):
        pairs[f"{a}_{b}"] = {
            "cve_id": counts.get((a, b, "cve_id"), 0),
            "text_hash": counts.get((a, b, "text_hash"), 0),
            "examples": [[r["left_id"], r["right_id"], r["key"][:12]] for r in few if (r["left"], r["right"]) == (a, b)],
        }
    return {"pairs": pairs, "ok": not counts}


class SplitInvariantError(RuntimeError):
    """Splits share an id or a content; result is the guard's."""

    def __init__(self, result: dict[str, Any]):
        super().__init__(f"splits overlap: {result['pairs']}")
        self.result = result


def guarded(rows: DataFrame) -> DataFrame:
    """The rows, if the guard finds nothing; call it before anything is written."""
    result = guard(rows)
    if not result["ok"]:
        raise SplitInvariantError(result)
    return rows


def contamination_counts(rows: DataFrame) -> DataFrame:
    """One row per pair of splits and kind of key: left, right, kind and n, the left rows whose key the right has.

    Both kinds are counted in one pass; rows have split, cve_id and description_norm_hash.
    """
    keys = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("key")) for k in ("cve_id", "description_norm_hash")))
    held = rows.select("split", F.inline(keys)).where("key IS NOT NULL").groupBy("kind", "key").agg(*(F.count_if(F.col("split") == s).alias(s) for s in SPLITS))
    sums = F.array(*(F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.when(F.col(b) > 0, F.col(a)).otherwise(0).alias("n")) for a, b in combinations(SPLITS, 2)))
    return held.select("kind", F.inline(sums)).groupBy("left", "right", "kind").agg(F.sum("n").alias("n"))


def contamination(population: DataFrame, exported: DataFrame) -> dict[str, Any]:
    """Overlaps of the populations by id and content, of the export by content, and the train rows' own copies.

    Counts are of left rows, as in overlap(); both tables have split, ord, cve_id and description_norm_hash.
    """
    name = lambda r: f"{r['left']}_{r['right']}_" + ("cve_id_overlap" if r["kind"] == "cve_id" else "exact_text_overlap")
    pairs = [(a, b, kind) for kind in ("cve_id", "description_norm_hash") for a, b in combinations(SPLITS, 2) if (a, b, kind) != ("val", "test", "cve_id")]
    label = {p: name(dict(zip(("left", "right", "kind"), p, strict=True))) for p in pairs}
    counted = lambda rows: {name(r): r["n"] for r in contamination_counts(rows).collect()}
    before, after = counted(population), counted(exported)
    out: dict[str, Any] = {label[p]: before.get(label[p], 0) for p in pairs}
    train = population.where("split = 'train'")
    own = train.agg((F.count(F.lit(1)) - F.count_distinct("description_norm_hash")).alias("n")).first()
    out["train_internal_exact_duplicates"] = own["n"]
    rows = overlap(train, population.where("split = 'test'"), "description_norm_hash").orderBy("ord").limit(20).collect()
    out["examples"] = {"train_test_exact_text_overlap": [[r["cve_id"], r["other_id"]] for r in rows]}
    out["post_build"] = {label[p]: after.get(label[p], 0) for p in pairs if p[2] != "cve_id"}
    return out
