"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, with DataFrame functions only.

The ring has SLOTS points. Every shard owns `vnodes` of them; a row's key hashes to a point and asks first for the shard of
the next virtual node clockwise. A shard that is full passes the row on to the next other shard clockwise, and so on. All
rows of one point move together until a shard's room splits them, so the whole overflow is settled on a table of SLOTS
counts, in as many rounds as there are shards: in round r the rows that are still out ask for the r-th distinct shard
clockwise, in ring order. A shard's place numbers follow the same order, so they are gapless.

With slack 0 the rooms add up to the number of rows, which makes the counts of any two shards differ by one at most. With
slack e every shard has room for (1 + e) times the mean, rounded up, and a shard more or less moves few rows.

Defined cases: a null key hashes like any other value. Different rows of one key share its point and are ranked in parts. Equal rows are counted before they are dealt, and take places side by
side. Fewer rows than shards leave shards empty; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOTS = 16384
#: Parts in which the rows of one point are ranked, so that a key with very many different rows is no one task's.
SALTS = 64


def ring(shards: int, vnodes: int, seed: int, slots: int = SLOTS) -> list[list[int]]:
    """For each point of the ring, the shards in the order in which they come clockwise. Depends on the parameters alone."""
    if not 0 < shards * vnodes <= slots // 4:
        raise ValueError(f"{shards} shards of {vnodes} virtual nodes need more than {slots} points")
    owner: dict[int, int] = {}
    for shard in range(shards):
        for v in range(vnodes):
            at = int.from_bytes(hashlib.md5(f"{seed}:{shard}:{v}".encode()).digest()[:8], "big") % slots
            while at in owner:
                at = (at + 1) % slots
            owner[at] = shard
    order: list[list[int]] = [[] for _ in range(slots)]
    following: list[int] = []
    for at in range(2 * slots - 1, -1, -1):
        if at % slots in owner:
            mine = owner[at % slots]
            following = [mine, *(s for s in following if s != mine)]
        if at < slots:
            order[at] = following
    return order


def hashed(seed: int, *columns: Column) -> Column:
    """48 bits of an MD5 of the columns' texts as a number; a null is a text of its own."""
    texts = (F.coalesce(c.cast("string"), F.lit("\x01")) for c in columns)
    return F.conv(F.substring(F.md5(F.concat_ws("\x02", F.lit(str(seed)), *texts)), 1, 12), 16, 10).cast("long")


def _literal_array(values, kind: str) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def settle(counts: DataFrame, shards: int, vnodes: int, seed: int, slack: float, slots: int = SLOTS) -> DataFrame:
    """(point, shard, first, last, base): rows ranked first..last - 1 at a point go to the shard's places from base on.

    counts: (point, n), at most `slots` rows. All rounds are running sums over this one small sorted table.
    """
    order = ring(shards, vnodes, seed, slots)
    kinds = sorted({tuple(x) for x in order})
    place = {k: i for i, k in enumerate(kinds)}
    kind = F.element_at(_literal_array((place[tuple(x)] for x in order), "int"), F.col("point") + 1)
    ask = [F.element_at(_literal_array((k[r] for k in kinds), "int"), F.col("kind") + 1).alias(f"ask{r}") for r in range(shards)]
    whole = Window.orderBy("point").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    until = Window.orderBy("point").rowsBetween(Window.unboundedPreceding, -1)
    rows = counts.select("point", "n", kind.alias("kind")).select("*", *ask).select("*", F.sum("n").over(whole).alias("all"), F.col("n").alias("left"), F.lit(0).cast("long").alias("done"), *(F.lit(0).cast("long").alias(f"asked{s}") for s in range(shards)))

    def of_shard(r: int, names: str) -> Column:
        return reduce(lambda out, s: F.when(F.col(f"ask{r}") == s, F.col(f"{names}{s}")).otherwise(out), range(1, shards), F.col(f"{names}0"))

    even = F.floor(F.col("all") / shards) + (F.col("asker") < F.col("all") % shards).cast("long")
    room = even if slack == 0 else F.ceil(F.col("all") * F.lit(1 + slack) / shards)
    for r in range(shards):
        mine = [F.when(F.col(f"ask{r}") == s, F.col("left")).otherwise(0) for s in range(shards)]
        rows = rows.select("*", *(F.coalesce(F.sum(m).over(until), F.lit(0)).alias(f"run{s}") for s, m in enumerate(mine)), *(F.sum(m).over(whole).alias(f"sum{s}") for s, m in enumerate(mine)))
        rows = rows.select("*", F.col(f"ask{r}").alias("asker"), (of_shard(r, "asked") + of_shard(r, "run")).alias("ahead")).select("*", room.cast("long").alias("room"))
        got = F.greatest(F.lit(0), F.least(F.col("left"), F.col("room") - F.col("ahead"))).cast("long")
        rows = rows.select("*", got.alias("got"))
        part = F.struct(F.col("asker").alias("shard"), F.col("done").alias("first"), (F.col("done") + F.col("got")).alias("last"), F.col("ahead").alias("base")).alias(f"part{r}")
        kept = ["point", "kind", "all", "n", *(f"ask{q}" for q in range(shards)), *(f"part{q}" for q in range(r))]
        rows = rows.select(*kept, part, (F.col("left") - F.col("got")).alias("left"), (F.col("done") + F.col("got")).alias("done"), *((F.col(f"asked{s}") + F.col(f"sum{s}")).alias(f"asked{s}") for s in range(shards)))
    parts = F.filter(F.array(*(f"part{r}" for r in range(shards))), lambda p: p["last"] > p["first"])
    return rows.select("point", F.inline(parts))


def assign_shards(rows: DataFrame, key: str, shards: int = 8, vnodes: int = 64, seed: int = 7, slack: float = 0.0, slots: int = SLOTS, names: tuple[str, str] = ("shard", "slot")) -> DataFrame:
    """rows with the shard and the place in it of each.

    Give only the columns that are needed further on: equal rows are first counted, then all are dealt by ring point and
    ranked there. Both shuffles carry the given columns. The table of parts has at most slots * shards short rows.
    """
    if rows.columns and any(c.lower() in {n.lower() for n in names} for c in rows.columns):
        raise ValueError(f"rows already have a column named like one of {names}")
    own = [f"c{i}" for i in range(len(rows.columns))]
    plain = rows.toDF(*own)
    key = own[rows.columns.index(key)]
    point = (hashed(seed, F.col(key)) % slots).cast("int")
    salt = (hashed(seed + 2, *map(F.col, own)) % SALTS).cast("int")
    told = plain.groupBy(*own).agg(F.count(F.lit(1)).alias("m")).withColumn("point", point).withColumn("salt", salt)
    counts = told.groupBy("point", "salt").agg(F.sum("m").alias("n"))
    parts = settle(counts.groupBy("point").agg(F.sum("n").alias("n")), shards, vnodes, seed, slack, slots)
    # A point's rows are ranked in parts, each behind the rows of those before it.
    before = Window.partitionBy("point").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("point", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    in_part = Window.partitionBy("point", "salt").orderBy(hashed(seed + 1, F.col(key)), *own)
    ranked = told.select(*own, "point", "salt", "m", (F.sum("m").over(in_part.rowsBetween(Window.unboundedPreceding, 0)) - F.col("m")).alias("in_part"))
    ranked = ranked.join(begins, ["point", "salt"]).select(*own, "point", "m", (F.col("begin") + F.col("in_part")).alias("rank"))
    each = ranked.join(parts, "point").where((F.col("rank") < F.col("last")) & (F.col("rank") + F.col("m") > F.col("first")))
    low, high = F.greatest("rank", "first"), F.least(F.col("rank") + F.col("m"), F.col("last")) - 1
    dealt = each.select(*own, "shard", "base", "first", F.explode(F.sequence(low, high)).alias("at"))
    return dealt.select(*own, F.col("shard").cast("int"), (F.col("base") + F.col("at") - F.col("first")).alias("slot")).toDF(*rows.columns, *names)
