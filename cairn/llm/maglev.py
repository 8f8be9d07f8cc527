"""Sharding by a permutation-filled lookup table, in DataFrame functions only.

Every shard has its own order of preference over the slots of a table of prime size (an offset and a stride from its
name's MD5). Shards take turns, each claiming its next free slot, until the table is full; so all hold equally many
slots but for one, and when a shard comes or goes few other slots change hands. A key's slot is its MD5 modulo the table
size; the table (a fixed number of rows, whatever the data) is broadcast. Placing a row needs no shuffle.
"""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots (a prime, about a hundred to a shard) and shards.
SLOTS, SHARDS = 6421, 64


def number(text: str) -> int:
    """The first 15 hexadecimal digits of a text's MD5."""
    return int(md5(text.encode()).hexdigest()[:15], 16)


def table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The shard's position in `shards` for each slot."""
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards must be distinct, at least one and no more than slots")
    if any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("the table size must be prime")
    at = [number(s + "/offset") % slots for s in shards]
    stride = [number(s + "/stride") % (slots - 1) + 1 for s in shards]
    owner = [-1] * slots
    for turn in range(slots):
        i = turn % len(shards)
        while owner[at[i]] >= 0:
            at[i] = (at[i] + stride[i]) % slots
        owner[at[i]] = i
    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Null keys count as the empty string."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15)
    return F.conv(digits, 16, 10).cast("bigint") % slots


def names(count: int = SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(count)]


def place(rows: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """The rows with slot and shard (its position) after their own columns, any of which of those names they replace.

    Each row is placed by its key alone: repeated keys go together, null keys too, and an empty table stays empty.
    """
    owners = ",".join(map(str, table(shards, slots)))
    spark = rows.sparkSession
    lookup = spark.range(1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("slot", "shard"))
    lookup = lookup.select(F.col("slot").cast("bigint").alias("slot"), F.col("shard").cast("int").alias("shard"))
    placed = rows.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), slots))
    return placed.join(F.broadcast(lookup), "slot").select(*[c for c in rows.columns if c not in ("slot", "shard")], "slot", "shard")


def oracle(count: int = SHARDS, slots: int = SLOTS) -> str:
    """The turns as a recursive query over a list of owners, then a look-up per document."""
    num = lambda e: f"cast('0x' || substr(md5({e}), 1, 15) as bigint)"
    return f"""with recursive s as (select i, 'shard-' || lpad(cast(i as varchar), 5, '0') as name from range({count}) t(i)),
p as (select list({num("name || '/offset'")} % {slots} order by i) as o, list({num("name || '/stride'")} % {slots - 1} + 1 order by i) as d from s),
w(turn, slot, free) as (
  select -1, cast(-1 as bigint), list_transform(range({slots}), lambda x: true) union all
  select turn + 1, pick, list_concat(list_slice(free, 1, pick), [false], list_slice(free, pick + 2, {slots})) from (
    select turn, free, list_filter(list_transform(range({slots}), lambda k: (o[(turn + 1) % {count} + 1] + k * d[(turn + 1) % {count} + 1]) % {slots}), lambda x: free[x + 1])[1] as pick
    from w, p where turn + 1 < {slots}))
select doc_id, {num("coalesce(cast(doc_id as varchar), '')")} % {slots} as slot, cast(turn % {count} as integer) as shard
from documents join w on w.slot = {num("coalesce(cast(doc_id as varchar), '')")} % {slots}"""
