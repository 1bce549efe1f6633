"""Sharding: a permutation-filled lookup table places every row in constant time (Eisenbud et al., 2016)."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 4099  # prime, about 128 slots for each of 32 shards
SHARDS = 32


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def fill(names: list[str], slots: int = SLOTS) -> list[int]:
    """Owner of every slot. Shards take turns; each claims the next free slot of its own preference order.

    The order of shard ``s`` is offset + j * skip (mod ``slots``); with a prime
    number of slots that visits every slot. Shares differ by one slot at most,
    and removing a shard moves few slots of the others.
    """
    if not names or len(set(names)) < len(names) or slots < len(names):
        raise ValueError("distinct shard names are needed, and a slot for each")
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    at = [_number(f"{n}|offset") % slots for n in names]
    skip = [_number(f"{n}|skip") % (slots - 1) + 1 for n in names]
    owner = [-1] * slots
    free = slots
    while free:
        for s in range(len(names)):
            while owner[at[s]] >= 0:
                at[s] = (at[s] + skip[s]) % slots
            owner[at[s]] = s
            free -= 1
            if not free:
                break
    return owner


def slot_of(key: Column | str, slots: int = SLOTS) -> Column:
    """Slot of a key's text: the first eight hex digits of its MD5, modulo the slots. Null counts as empty text."""
    key = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(slots)).cast("int")


def lookup(spark: SparkSession, names: list[str], slots: int = SLOTS) -> DataFrame:
    """The table ``(slot, shard)``; ``slots`` rows, a parameter and never a function of the data."""
    owners = ",".join(map(str, fill(names, slots)))
    return spark.range(1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("slot", "shard")).select(
        "slot", F.col("shard").cast("int").alias("shard"))


def place(df: DataFrame, key: str, names: list[str], slots: int = SLOTS) -> DataFrame:
    """All rows with ``slot`` and ``shard`` (position in ``names``); columns of those names are replaced.

    Equal keys go to one shard. Null and empty keys share a slot; repeated rows
    stay repeated; an empty input gives an empty result. The lookup table is
    broadcast: its size is the parameter ``slots``.
    """
    own = [F.col(f"`{c}`") for c in df.columns if c not in ("slot", "shard")]
    keyed = df.select(*own, slot_of(F.col(f"`{key}`"), slots).alias("__slot"))
    table = F.broadcast(lookup(df.sparkSession, names, slots).withColumnRenamed("shard", "__shard"))
    return keyed.join(table, keyed["__slot"] == table["slot"]).select(
        *own, F.col("__slot").alias("slot"), F.col("__shard").alias("shard"))


def write_shards(placed: DataFrame, path: str, files_each: int = 1) -> None:
    """One folder per shard with ``files_each`` files; rows are dealt by slot, so no shard needs one task."""
    shards = placed.select("shard").distinct().count()
    part = F.pmod(F.xxhash64("slot"), F.lit(files_each))
    placed.repartition(max(1, shards * files_each), "shard", part).write.partitionBy("shard").parquet(path)


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]
