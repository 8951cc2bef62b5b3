"""Digests of tables that don't depend on the order or the partitioning of rows, as trees of bounded groups.

A row's digest is that of its columns' texts; equal rows are one digest with their number. Leaves are ranges of digests: all
with the same first hex digits, as many digits as it takes for about LEAF rows a leaf. A leaf's digest is that of its sorted
rows, and each level above that of the at most FAN digests below in order, up to one for the group. So no group of the
plan holds more than a leaf, and what each level passes on is a FANth of the one below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAF, FAN, DEEPEST = 256, 16, 12


def row_digest(*columns: str) -> Column:
    """SHA-256 of the columns as texts, each with its length before it; null is told from empty."""
    texts = (F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in (F.col(c).cast("string") for c in columns))
    return F.sha2(F.concat(*texts), 256)


def tree_digest(rows: DataFrame, by: str, *columns: str) -> DataFrame:
    """by, rows and sha256: for each value of by the number of its rows and the digest of its tree over the columns."""
    counted = rows.select(F.col(by).alias("tree"), row_digest(*columns).alias("digest")).groupBy("tree", "digest").agg(F.count(F.lit(1)).alias("n"))
    sizes = counted.groupBy(F.col("tree").alias("of")).agg(F.count(F.lit(1)).alias("distinct"), F.sum("n").alias("rows"))
    # as many levels as powers of FAN that the distinct rows exceed, counted in whole numbers
    levels = sum((F.when(F.col("distinct") > F.lit(LEAF * FAN**k), 1).otherwise(0) for k in range(DEEPEST)), F.lit(0))
    sizes = sizes.withColumn("levels", levels)
    deepest = sizes.agg(F.max("levels")).first()[0]
    leaf = counted.join(sizes, F.col("tree").eqNullSafe(F.col("of"))).select("tree", F.substring("digest", F.lit(1), F.col("levels")).alias("prefix"), F.struct("digest", F.concat("digest", F.lit(":"), F.col("n").cast("string"), F.lit("\n")).alias("text")).alias("part"))
    joined = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["text"]), ""), 256)
    nodes = leaf.groupBy("tree", "prefix").agg(joined.alias("digest"))
    for level in range(deepest or 0, 0, -1):
        low = F.length("prefix") == level
        above = nodes.where(low).select("tree", F.substring("prefix", 1, level - 1).alias("prefix"), F.struct("prefix", F.concat(F.right("prefix", F.lit(1)), F.lit(":"), "digest", F.lit("\n")).alias("text")).alias("part"))
        nodes = above.groupBy("tree", "prefix").agg(joined.alias("digest")).unionByName(nodes.where(~low))
    return nodes.join(sizes, F.col("tree").eqNullSafe(F.col("of"))).select(F.col("tree").alias(by), "rows", F.col("digest").alias("sha256"))


def tree_digest_sql(rows: str, by: str, columns: tuple[str, ...], levels: int = 4) -> str:
    """The same tree as a chain of common table expressions that ends in tree (by, rows, sha256); for so many levels."""
    text = " || ".join(f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in columns)
    joined = "sha256(string_agg({0}, '' ORDER BY {1}))"
    out = f"""counted_ AS (SELECT {by} AS tree, sha256({text}) AS digest, count(*) AS n FROM {rows} GROUP BY ALL),
    sizes_ AS (SELECT tree, count(*) AS kinds, sum(n) AS n, {" + ".join(f"(count(*) > {LEAF * FAN**k})::INT" for k in range(levels))} AS levels FROM counted_ GROUP BY tree),
    leaf_ AS (SELECT c.tree, left(digest, levels) AS prefix, {joined.format("digest || ':' || c.n || chr(10)", "digest")} AS digest FROM counted_ c JOIN sizes_ s ON c.tree IS NOT DISTINCT FROM s.tree GROUP BY ALL)"""
    below = "leaf_"
    for k in range(levels, 0, -1):
        out += f""", level{k}_ AS (SELECT tree, left(prefix, {k - 1}) AS prefix, {joined.format("right(prefix, 1) || ':' || digest || chr(10)", "prefix")} AS digest FROM {below} WHERE length(prefix) = {k} GROUP BY ALL
    UNION ALL SELECT * FROM {below} WHERE length(prefix) <> {k})"""
        below = f"level{k}_"
    return f"{out}, tree AS (SELECT b.tree AS {by}, s.n AS rows, digest AS sha256 FROM {below} b JOIN sizes_ s ON b.tree IS NOT DISTINCT FROM s.tree)"
