"""Sharding with a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a table of prime size: a permutation given by an offset and
a step, both hashes of the shard's name. Shards take turns; in its turn a shard claims its best slot that is still free,
until all are claimed. Shares differ by one slot at most, and a shard that joins or leaves moves few keys. The table
has a fixed number of entries, so sending it to all tasks is safe at any size, and placing a key is one hash and one look.

Cases: a null key is placed like an empty one; equal keys get one shard; an empty input stays empty; other columns are
carried along, and a column that has a result's name is replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A prime over a hundred times the number of shards keeps the shares within one per cent.
SLOTS = 16381
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _hash(name: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:15], 16)


def lookup_table(shards=SHARDS, slots: int = SLOTS) -> list[int]:
    """The shard's number for each slot."""
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots or not is_prime(slots):
        raise ValueError("shards must be distinct, at least one, and no more than the prime number of slots")
    offset = [_hash(s, "offset") % slots for s in shards]
    step = [_hash(s, "step") % (slots - 1) + 1 if slots > 2 else 1 for s in shards]
    table, turn, free = [-1] * slots, [0] * len(shards), slots
    while free:
        for i in range(len(shards)):
            while table[slot := (offset[i] + turn[i] * step[i]) % slots] >= 0:
                turn[i] += 1
            table[slot] = i
            free -= 1
            if not free:
                break
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: 60 bits of its MD5, modulo the table's size."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long") % slots


def place(rows: DataFrame, key: str, shards=SHARDS, slots: int = SLOTS) -> DataFrame:
    """``rows`` with slot (long), shard (int) and shard_name. The table reaches all tasks as a broadcast of fixed size."""
    spark, table = rows.sparkSession, lookup_table(shards, slots)
    entries = spark.range(1).select(F.posexplode(F.split(F.lit(",".join(map(str, table))), ",")).alias("slot", "shard"))
    names = F.element_at(F.split(F.lit("\x1f".join(shards)), "\x1f"), F.col("shard") + 1)
    entries = entries.select(F.col("slot").cast("long"), F.col("shard").cast("int").alias("shard")).withColumn("shard_name", names)
    keep = [c for c in rows.columns if c not in ("slot", "shard", "shard_name")]
    return rows.select(*keep, slot_of(F.col(key), slots).alias("slot")).join(F.broadcast(entries), "slot").select(*keep, "slot", "shard", "shard_name")


def oracle(shards=SHARDS, slots: int = SLOTS) -> str:
    table = ",".join(map(str, lookup_table(shards, slots)))
    return f"""
WITH t AS (SELECT generate_subscripts(x, 1) - 1 AS slot, unnest(x) AS shard FROM (SELECT [{table}] AS x)),
d AS (SELECT doc_id, source, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT % {slots} AS slot FROM documents)
SELECT d.doc_id, d.source, CAST(d.slot AS BIGINT) AS slot, CAST(t.shard AS INTEGER) AS shard, 'shard-' || lpad(CAST(t.shard AS VARCHAR), 3, '0') AS shard_name
FROM d JOIN t ON d.slot = t.slot"""
