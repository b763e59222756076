"""Operator 9: shards by balanced label propagation.

Documents of equal text are linked. Every document starts in a shard by hash (a group that takes a good part of a
shard starts in as few neighbouring shards as hold it); in each round linked documents move, by a join with the votes
of their group, to the shard that holds most of the group, as far as that shard's quota allows: rows that leave a
shard make room in it. What a quota turns away tries again in a later round. At the end the law ``rows`` is made
exact: every document has a place in its shard (linked ones first), and places beyond a shard's share are mapped,
by arithmetic on 16 numbers, to the shares that are left, so counts differ by one at most.

A group is handled in nodes of (group, salt), so a group that holds a third of all rows is spread over many tasks,
and over as many shards as it needs. Null texts have size 1, the checksum of no bytes and no links. Repeated rows
each get a place of their own. Further columns aren't read. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, cut

SHARDS = 16
ROUNDS = 8
#: Rows of a node or of a place block at most, about.
BLOCK = 20_000
#: A group that holds this share of a shard's quota has filled the shard and goes on with its next one.
FILLED = 0.9
#: Nodes of a group at least, if it has as many rows.
SALTS = 64


def shards(docs: DataFrame, *, count: int = SHARDS, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard`` (null under this law)."""
    octets = F.coalesce(F.encode(text_col, "utf-8"), F.lit(b""))
    rows = docs.select(F.col(id_col), (F.octet_length(octets) + F.lit(1)).cast("long").alias("size"), F.crc32(octets).alias("text_crc32"), F.unhex(F.md5(F.encode(text_col, "utf-8"))).alias("text_key"))
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    total = rows.count()
    salts = max(SALTS, blocks(total, BLOCK))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)))
    placed = rows.join(propagate(rows, total, count, rounds, salts), ["text_key", "salt"], "left")
    return _exact(cut(placed), total, count).select(id_col, "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def propagate(rows: DataFrame, total: int, count: int, rounds: int, salts: int) -> DataFrame:
    """The shard of every node (text_key, salt) of a group of several rows."""
    nodes = rows.where("text_key is not null").groupBy("text_key", "salt").agg(F.count("*").alias("weight"))
    groups = nodes.groupBy("text_key").agg(F.sum("weight").alias("group")).where("group > 1")
    quota = -(-total // count)
    # a group too large for its fellows to move around it starts in as few neighbouring shards as hold it
    spans = F.ceil(F.col("group") / (FILLED * max(1, quota)))
    part = F.floor(F.col("salt") * spans / F.lit(salts)).cast("long")
    start = F.when(F.col("group") > quota // 64, F.xxhash64("text_key") % count + count + part).otherwise(F.xxhash64("text_key", "salt"))
    now = cut(nodes.join(groups, "text_key").withColumn("shard", F.pmod(start, F.lit(count)).cast("int")))
    for turn in range(rounds):
        load = {r["shard"]: r["n"] for r in now.groupBy("shard").agg(F.sum("weight").alias("n")).collect()}  # one number for each shard
        votes = now.groupBy("text_key", "shard").agg(F.sum("weight").alias("votes"))
        # most votes first, ties by a hash that differs from group to group; what a group has filled itself is passed over
        ranked = F.struct("votes", F.xxhash64("text_key", "shard").alias("tie"), "shard")
        best = votes.groupBy("text_key").agg(F.max(F.when(F.col("votes") < FILLED * quota, ranked)).alias("best"))
        own = votes.withColumnsRenamed({"votes": "own"}).select("text_key", "shard", "own")
        wants = now.join(best, "text_key").join(own, ["text_key", "shard"])
        moves = (F.col("best").isNotNull()) & (F.col("own") < FILLED * quota) & (F.col("best.shard") != F.col("shard")) & (F.struct(F.col("best.votes"), F.col("best.tie")) > F.struct("own", F.xxhash64("text_key", "shard")))
        wants = cut(wants.select("text_key", "salt", "weight", "group", "shard", F.when(moves, F.col("best.shard")).alias("target")))
        flows = {(r["shard"], r["target"]): r["n"] for r in wants.where("target is not null").groupBy("shard", "target").agg(F.sum("weight").alias("n")).collect()}  # count squared at most
        if not flows:
            break
        share = F.array(*(F.lit(x) for x in admitted_shares(flows, [load.get(s, 0) for s in range(count)], quota)))
        # small groups move whole; those that a quota may split are admitted node by node
        luck = F.pmod(F.when(F.col("group") <= quota // 64, F.xxhash64("text_key", F.lit(turn))).otherwise(F.xxhash64("text_key", "salt", F.lit(turn))), F.lit(1 << 30)) / F.lit(float(1 << 30))
        admitted = F.col("target").isNotNull() & (luck < F.coalesce(_at(share, F.col("target")), F.lit(0.0)))
        now = wants.select("text_key", "salt", "weight", "group", F.when(admitted, F.col("target")).otherwise(F.col("shard")).alias("shard"))
    return now.select("text_key", "salt", F.col("shard").alias("found"), (F.col("group") > quota // 64).alias("large"))


def admitted_shares(flows: dict[tuple[int, int], int], load: list[int], quota: int) -> list[float]:
    """Which share of those who want into each shard may move, so that none ends above the quota.

    Rows that leave a shard make room in it; shares only fall until the loads fit, so swaps between full shards pass.
    """
    share = [1.0] * len(load)
    into = [sum(n for (_, t), n in flows.items() if t == s) for s in range(len(load))]
    for _ in range(200):
        out = [sum(n * share[t] for (f, t), n in flows.items() if f == s) for s in range(len(load))]
        most = [min(share[s], max(0.0, (max(quota, load[s]) - load[s] + out[s]) / into[s])) if into[s] else 0.0 for s in range(len(load))]
        if max(abs(a - b) for a, b in zip(most, share, strict=True)) < 1e-6:
            break
        share = most
    return share


def _at(array: Column, k: Column) -> Column:
    return F.element_at(array, k + 1)


def _exact(rows: DataFrame, total: int, count: int) -> DataFrame:
    """``shard`` and ``slot`` such that shards' rows differ by one at most; linked rows (``found``) stay first."""
    width = blocks(total, BLOCK * count)
    linked = F.col("found").isNotNull()
    # blocks of about BLOCK rows: large groups' nodes, then other groups, each in one block, then rows without links
    own = F.pmod(F.xxhash64("text_key", "salt"), F.lit(width))
    block = F.when(F.col("large"), own).when(linked, width + F.pmod(F.xxhash64("text_key"), F.lit(width))).otherwise(2 * width + F.pmod(F.xxhash64("row"), F.lit(width)))
    rows = rows.withColumn("first", F.coalesce("found", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(count)).cast("int"))).withColumn("block", block)
    sizes = cut(rows.groupBy("first", "block").agg(F.count("*").alias("n")))
    before = F.sum("n").over(Window.partitionBy("first").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("first", "block", F.coalesce(before, F.lit(0)).alias("start"))
    held = {r["first"]: r["n"] for r in sizes.groupBy("first").agg(F.sum("n").alias("n")).collect()}  # one number for each shard
    have = [held.get(s, 0) for s in range(count)]
    share = [total // count + (s < total % count) for s in range(count)]
    over, short = [max(0, h - q) for h, q in zip(have, share, strict=True)], [max(0, q - h) for h, q in zip(have, share, strict=True)]
    above = [sum(over[:s]) for s in range(count)]
    ends = [sum(short[: s + 1]) for s in range(count)]

    def lits(values: list[int]) -> Column:
        return F.array(*(F.lit(v).cast("long") for v in values))

    inside = Window.partitionBy("first", "block").orderBy("text_key", "salt", "row")
    place = F.col("start") + F.row_number().over(inside) - 1
    rows = rows.join(starts, ["first", "block"]).withColumn("place", place)
    beyond = F.col("place") - _at(lits(share), F.col("first")) + _at(lits(above), F.col("first"))
    target = F.size(F.filter(lits(ends), lambda e: e <= F.col("beyond"))).cast("int")
    rows = rows.withColumn("beyond", F.when(F.col("place") >= _at(lits(share), F.col("first")), beyond)).withColumn("target", target)
    moved = F.col("beyond").isNotNull()
    slot = F.element_at(lits([min(h, q) for h, q in zip(have, share, strict=True)]), F.least(F.col("target") + 1, F.lit(count))) + F.col("beyond") - F.element_at(lits([e - s for e, s in zip(ends, short, strict=True)]), F.least(F.col("target") + 1, F.lit(count)))
    return rows.withColumn("shard", F.when(moved, F.col("target")).otherwise(F.col("first"))).withColumn("slot", F.when(moved, slot).otherwise(F.col("place")))
