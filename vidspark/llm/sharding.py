"""Sharding by balanced label propagation: linked documents move together, counts stay even."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import id_key, written

SHARDS = 8
ROUNDS = 4
#: Rows of a shard that one bucket has at most, about.
BUCKET_ROWS = 16_384
#: Followers of one node that want into a shard count as a crowd from this part of a shard on.
CROWD = 16


def _case(shard: Column, values: list[float]) -> Column:
    """values[shard]."""
    return F.get(F.array(*[F.lit(v) for v in values]), shard)


def _accepted(asked: list[list[list[int]]], room: list[int]) -> list[list[list[float]]]:
    """Part of each kind of askers (kind, from, to) that may move: what two shards swap evenly, and then what room takes; the first kind first."""
    n = len(room)
    moved = [[[0.0] * n for _ in range(n)] for _ in asked]
    for s in range(n):
        for t in range(n):
            even = min(sum(k[s][t] for k in asked), sum(k[t][s] for k in asked))
            for kind, out in zip(asked, moved, strict=True):
                out[s][t] = min(kind[s][t], even)
                even -= out[s][t]
    for t in range(n):
        left = float(room[t])
        for kind, out in zip(asked, moved, strict=True):
            rest = sum(kind[s][t] - out[s][t] for s in range(n))
            part = min(1.0, left / rest) if rest else 0.0
            left -= part * rest
            for s in range(n):
                out[s][t] += part * (kind[s][t] - out[s][t])
    return [[[out[s][t] / kind[s][t] if kind[s][t] else 0.0 for t in range(n)] for s in range(n)] for kind, out in zip(asked, moved, strict=True)]


def propagate(nodes: DataFrame, edges: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, total: int | None = None) -> DataFrame:
    """node, weight and shard of every node with a link, after ``rounds`` of balanced label propagation.

    nodes: node (long, one row each) and weight. edges: a, b. total: the weight of all nodes, if ``nodes`` has not
    all of those without a link. Each linked node begins in the shard its hash
    says. In a round a node looks where most of its neighbours are and asks to move there, if more are there
    than in its own shard. Minor nodes (with a neighbour of more links, or as many and a lesser id) and major ones
    ask in turn, so that the two ends of a link never swap. Two shards swap as many as both ask; beyond that a
    shard takes movers up to its share of all weight: small followings of one node first, crowds, which may be split, what
    room is left. Which of them move is drawn by hash, so a rerun draws the same.

    Neighbours are counted by partial sums of (node, shard), never listed; the driver sees sums by shard only.

    Repeated edges and edges from a node to itself count once and not at all; edges with a null end, and ends that are no node, are disregarded. No nodes
    or no edges give no rows. Other columns are not read.
    """
    if total is None:
        total = nodes.agg(F.sum("weight")).first()[0] or 0
    capacity = -(-total // shards)
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = written(both, "links")
    degree = written(both.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree")), "degrees")
    around = both.join(degree.select(F.col("node").alias("b"), "degree"), "b").groupBy(F.col("a").alias("node")).agg(F.max(F.struct("degree", F.bitwise_not(F.col("b")).alias("minus"))).alias("top"))
    kinds = degree.join(around, "node").select("node", F.when(F.col("top") > F.struct("degree", F.bitwise_not(F.col("node")).alias("minus")), F.bitwise_not(F.col("top.minus"))).alias("leader"))
    state = written(nodes.join(kinds, "node").withColumn("shard", F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int")), "labels")
    for turn in range(rounds):
        movers = state.filter(F.col("leader").isNotNull() if turn % 2 == 0 else F.col("leader").isNull())
        near = both.join(state.select(F.col("node").alias("b"), F.col("shard").alias("there")), "b").groupBy(F.col("a").alias("node"), "there").agg(F.count("*").alias("n"))
        best = near.groupBy("node").agg(F.max(F.struct("n", (-F.col("there")).alias("minus"))).alias("best"))
        own = near.select("node", F.col("there").alias("shard"), F.col("n").alias("own"))
        asks = movers.join(best, "node").join(own, ["node", "shard"], "left").filter(F.col("best.n") > F.coalesce("own", F.lit(0)))
        asks = written(asks.select("node", "weight", "shard", F.coalesce("leader", "node").alias("unit"), (-F.col("best.minus")).cast("int").alias("to")), "asks")
        units = asks.groupBy("to", "unit").agg(F.sum("weight").alias("asked"))
        crowds = written(units.filter(F.col("asked") > max(1, capacity // CROWD)), "crowds")
        asks = asks.join(crowds, ["to", "unit"], "left").withColumn("crowd", F.col("asked").isNotNull().cast("int"))
        load = [0] * shards
        for r in state.groupBy("shard").agg(F.sum("weight").alias("w")).collect():  # one row a shard
            load[r.shard] = r.w
        asked = [[[0] * shards for _ in range(shards)] for _ in range(2)]
        for r in asks.groupBy("crowd", "shard", "to").agg(F.sum("weight").alias("w")).collect():  # two for each pair of shards
            asked[r.crowd][r.shard][r.to] = r.w
        parts = _accepted(asked, [max(0, capacity - w) for w in load])
        drawn = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(1 << 30)) / float(1 << 30)
        taken = asks.filter(drawn < _case((F.col("crowd") * shards + F.col("shard")) * shards + F.col("to"), [p for kind in parts for row in kind for p in row]))
        state = written(state.join(taken.select("node", "to"), "node", "left").withColumn("shard", F.coalesce("to", "shard")).drop("to"), "labels")
    return state.select("node", "weight", "shard")


def level(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Final shard and slot of rows (shard or null, and an order key ``node``), counts at most one apart.

    Rows are numbered within shards by hash buckets of about BUCKET_ROWS, whose counts are summed up by Spark; the driver sees the
    shards' counts. Rows without shard, and those beyond a shard's share, then fill the other shards' open slots in order. Rows that are
    equal in node and doc_id are interchangeable; of a node with more of them than a bucket is to have (_copies), they go to the buckets by a number that was written with
    them (_number), so no bucket gets them all and a rerun deals them alike. Both columns may be missing: then equal rows share a bucket. Null shards are no shard, null nodes and ids values like others. No rows give no rows.
    """
    rows = rows.withColumn("_lane", F.coalesce("shard", F.lit(shards)))
    held = {r._lane: r["count"] for r in rows.groupBy("_lane").count().collect()}  # one row a shard, and one
    lanes = [held.get(lane, 0) for lane in range(shards + 1)]
    total = sum(lanes)
    hashed = F.xxhash64("node", "doc_id")
    if "_copies" in rows.columns:
        hashed = F.when(F.col("_copies") > BUCKET_ROWS, F.shiftright(hashed, 1) + F.col("_number")).otherwise(hashed)
    rows = rows.withColumn("_bucket", F.pmod(hashed, _case(F.col("_lane"), [max(1, -(-n // BUCKET_ROWS)) for n in lanes])))
    upto = F.sum("count").over(Window.partitionBy("_lane").orderBy("_bucket"))
    starts = rows.groupBy("_lane", "_bucket").count().select("_lane", "_bucket", (upto - F.col("count")).alias("_before"))
    share = [total // shards + (s < total % shards) for s in range(shards)]
    over = [max(0, lanes[s] - share[s]) for s in range(shards)]
    # Position in the pool of a lane's first row beyond its share, and the pool positions that each shard takes.
    pool = [lanes[shards] + sum(over[:s]) - share[s] for s in range(shards)] + [0]
    takes, at = [], 0
    for s in range(shards):
        open_slots = max(0, share[s] - lanes[s])
        takes.append((at, at + open_slots, s, min(lanes[s], share[s])))
        at += open_slots
    numbered = rows.join(starts, ["_lane", "_bucket"]).withColumn("_at", F.expr("_before + row_number() over (partition by _lane, _bucket order by node, doc_id) - 1"))
    stays = (F.col("_lane") < shards) & (F.col("_at") < _case(F.col("_lane"), [*share, 0]))
    numbered = numbered.withColumn("_pool", F.col("_at") + _case(F.col("_lane"), pool))
    to = F.coalesce(*[F.when(F.col("_pool") < end, F.lit(s)) for _, end, s, _ in takes])
    slot = F.coalesce(*[F.when(F.col("_pool") < end, F.col("_pool") - start + base) for start, end, _, base in takes])
    return numbered.withColumn("shard", F.when(stays, F.col("_lane")).otherwise(to).cast("int")).withColumn("slot", F.when(stays, F.col("_at")).otherwise(slot).cast("long")).drop("_lane", "_bucket", "_before", "_at", "_pool")


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each document; documents of equal texts are linked.

    The law is ``rows``: shards have equal counts or one apart. size is the UTF-8 bytes of the text plus 1. Slots of a
    shard count from 0 without gaps. Equal texts stay in one shard as far as its share allows.

    A null text has size 1 and the checksum of no bytes and is linked to none. Rows without doc_id or of one
    doc_id are placed each for itself; rows with the same id and text may share a node of that weight.
    An empty table gives no rows. Other columns are not read.
    """
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32(F.encode(text, "utf-8")), F.lit(0)).cast("long").alias("text_crc32"), F.md5(text).alias("_text")
    )
    rows = written(rows.withColumns({"node": F.xxhash64(id_key("doc_id"), "_text"), "_number": F.monotonically_increasing_id()}), "rows")
    groups = rows.filter(F.col("_text").isNotNull()).groupBy("_text").agg(F.count("*").alias("n"), F.min("node").alias("hub")).filter(F.col("n") > 1)
    groups = written(groups.select("_text", "hub"), "groups")
    linked = written(rows.select("node", "_text").join(groups, "_text").groupBy("node", "hub").agg(F.count("*").alias("weight")), "linked")
    edges = linked.filter(F.col("node") != F.col("hub")).select(F.col("node").alias("a"), F.col("hub").alias("b"))
    nodes = linked.groupBy("node").agg(F.sum("weight").alias("weight"))
    labels = propagate(nodes, edges, shards, rounds, rows.count()).select("node", "shard", F.col("weight").alias("_copies"))
    bare = rows.filter(F.col("_text").isNull()).groupBy("node").agg(F.count("*").alias("_copies")).filter(F.col("_copies") > 1)
    labels = labels.unionByName(bare.withColumn("shard", F.lit(None).cast("int")))
    placed = level(rows.join(labels, "node", "left"), shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
