"""Shards by jump consistent hashing: no table of the ring, and only what must move does when shards are appended.

A key's shard is where a sequence of jumps, drawn from a generator that the key's hash seeds, last landed below the number
of shards. Shard counts n and n + 1 share all jumps below n, so the shard with one more is either the same or the new one.
The generator is the published one, x * 2862933555777941757 + 1 modulo 2**64, in halves of 32 bits, as no product may
exceed Spark's signed numbers. All of it is expressions of built-in functions.

Slots number the rows of a shard without gaps. Rows are dealt to pieces of about PIECE rows by the hash of key and text; a
piece is ordered by that, key and text hash, and begins where the rows of those before it end. So a slot depends on rows
only, not on where they lie, but for copies of one row beyond 2 * PIECE: their piece is dealt further by where rows lie.

Nulls: a null key is a key like any other; a null text has no bytes (a size of 1) and the checksum of none. Empty and very
long texts are rows like others: only their sizes and checksums leave the scan, unless they are among the columns kept.
Equal rows are rows each, with slots of their own. The names of new columns get a prefix, so that columns with the same
names may stand beside them. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import stored

#: Fixed by the published method.
MULTIPLIER = 2862933555777941757
PIECE, STEPS = 1 << 16, 32


def _next(high: Column, low: Column) -> tuple[Column, Column]:
    """Both halves of x * MULTIPLIER + 1 modulo 2**64."""
    word = F.lit(0xFFFFFFFF)
    m1, m0 = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF
    upper, lower = F.lit(m0 >> 16), F.lit(m0 & 0xFFFF)
    across = low * upper  # below 2**48
    whole = low * lower + F.shiftleft(across.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    carried = F.shiftright(whole, 32) + F.shiftright(across, 16)
    crossed = (low * F.lit(m1)).bitwiseAND(word) + (high * lower).bitwiseAND(word) + F.shiftleft((high * upper).bitwiseAND(F.lit(0xFFFF)), 16)
    return (carried + crossed).bitwiseAND(word), whole.bitwiseAND(word)


def jumps(key: Column, shards: int) -> Column:
    """A struct of shard, where the 64-bit key's jumps last landed below the number of shards, and beyond, the next landing."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    number = "struct<shard:bigint,beyond:bigint,high:bigint,low:bigint>"
    start = F.struct(F.lit(-1).alias("shard"), F.lit(0).alias("beyond"), F.shiftrightunsigned(key, 32).alias("high"), key.bitwiseAND(F.lit(0xFFFFFFFF)).alias("low")).cast(number)

    def step(s: Column, _: Column) -> Column:
        high, low = _next(s["high"], s["low"])
        landed = F.floor((s["beyond"] + F.lit(1)).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(high, 1) + F.lit(1)).cast("double")))
        moved = F.struct(s["beyond"].alias("shard"), landed.alias("beyond"), high.alias("high"), low.alias("low")).cast(number)
        return F.when(s["beyond"] < shards, moved).otherwise(s)

    # a jump moves on by one at the least, so as many steps as shards are enough; few keys need more than the first STEPS
    steps = lambda s, n: F.aggregate(F.sequence(F.lit(1), F.lit(n)), s, step)
    done = steps(start, min(shards, STEPS))
    if shards > STEPS:
        rest = -(-(shards - STEPS) // STEPS)
        done = F.aggregate(F.sequence(F.lit(1), F.lit(rest)), done, lambda s, _: F.when(s["beyond"] < shards, steps(s, STEPS)).otherwise(s))
    return F.struct(done["shard"].cast("int").alias("shard"), done["beyond"].alias("beyond"))


def jump_hash(key: Column, shards: int) -> Column:
    """The shard, from 0, of a 64-bit key."""
    return jumps(key, shards)["shard"]


def assign(docs: DataFrame, shards: int = 16, *, key: str = "doc_id", keep: tuple[str, ...] | None = None, prefix: str = "", piece: int = PIECE) -> DataFrame:
    """The columns of docs to keep (all, if not given) and each row's size, text_crc32, law, shard, slot and grown_shard.

    size is the text's bytes and 1, text_crc32 its unsigned checksum, law always `key`: key and number of shards decide.
    grown_shard is the shard with one more, slot the row's place in its shard, from 0. Rows of one key share a shard.
    """
    keep = tuple(docs.columns) if keep is None else keep
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.struct(*keep).alias("kept"), F.col(key).alias("key"), F.xxhash64(text).alias("mark"),
        (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        jumps(F.xxhash64(key), shards).alias("at"), F.monotonically_increasing_id().alias("lies"),
    )
    rows = stored(rows)
    pieces = max(1, round(rows.count() / (shards * piece)))
    rows = rows.withColumn("piece", F.pmod(F.xxhash64("key", "mark", F.lit(13)), F.lit(pieces)))
    full = rows.groupBy("at.shard", "piece").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * piece)
    full = full.select(F.col("shard").alias("full_shard"), F.col("piece").alias("full_piece"), F.ceil(F.col("n") / piece).alias("salts"))
    dealt = rows.join(full, (F.col("at.shard") == F.col("full_shard")) & (F.col("piece") == F.col("full_piece")), "left")
    salt = F.coalesce(F.pmod(F.xxhash64("lies"), F.col("salts")), F.lit(0)).alias("salt")
    dealt = dealt.select(F.col("at.shard").alias("shard"), "piece", salt, "kept", "key", "mark", "size", "text_crc32", "at.beyond")
    group = ["shard", "piece", "salt"]
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("piece", "salt").rowsBetween(Window.unboundedPreceding, -1))
    begins = dealt.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).select(*group, F.coalesce(before, F.lit(0)).alias("begin"))
    place = F.row_number().over(Window.partitionBy(*group).orderBy("key", "mark")) - 1
    out = dealt.withColumn("place", place).join(begins, group)
    new = {
        "size": F.col("size"), "text_crc32": F.col("text_crc32"), "law": F.lit("key"), "shard": F.col("shard"), "slot": (F.col("begin") + F.col("place")).cast("long"),
        "grown_shard": F.when(F.col("beyond") == shards, F.lit(shards)).otherwise(F.col("shard")).cast("int"),
    }
    return out.select("kept.*", *(c.alias(prefix + n) for n, c in new.items()))
