"""Operator 3: shards by balanced label propagation, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadrille.llm.common import discard, materialise, numbered

SHARDS = 24
ROUNDS = 6


def admitted(asked: dict[tuple[int, int], int], room: list[int], steps: int = 200) -> list[float]:
    """Which share of the rows that want into each shard may move, so that none grows beyond its room: what leaves a shard
    makes room in it. asked is (from, to) -> rows. The shares fall from 1 to the largest that fit together."""
    shards = range(len(room))
    into = [sum(w for (_, to), w in asked.items() if to == t) for t in shards]
    share = [1.0] * len(room)
    for _ in range(steps):
        left = [sum(w * share[to] for (from_, to), w in asked.items() if from_ == t) for t in shards]
        new = [min(share[t], max(0.0, (room[t] + left[t]) / into[t])) if into[t] else 0.0 for t in shards]
        if max(a - b for a, b in zip(share, new, strict=True)) < 1e-4:
            return new
        share = new
    return share


def balanced_shards(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard): law `rows`, so shards' counts differ by one at most.

    Documents with equal texts are linked. Every document starts with the label that a hash of its id gives. Those of a
    group that share a label move as one; a group's part never exceeds a sixteenth of a shard, so a hot group is many.
    In each round a group's labels vote, weighted by rows; as many labels win as the group needs shards; parts with
    another label want to move to a winner (a group that fits one shard prefers shards that are not nearly full), and as many do as the winner's quota has room for, what moves out of it counted, which a hash decides.
    Documents without a link have no pull: they keep their label unless linked ones need the room. At last each label's
    first rows, linked ones before others, fill its shard's quota, and what is over fills the gaps elsewhere.

    A null text counts as empty, and all of these are one group. Null and repeated ids are rows like any other. No
    rows, no shards. Only totals of labels come to the driver.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = materialise(
        docs.select(F.col(id_col).alias("_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("_group")),
        "documents",
    )
    total = base.count()
    quota = max(1, -(-total // shards))
    part = max(1, quota // 16)
    groups = materialise(base.groupBy("_group").agg(F.count("*").alias("_rows")).where("_rows > 1"), "groups")
    salts = F.expr(f"{shards} * greatest(1, ceil(_rows / {part * shards}))")
    dealt = base.join(groups, "_group", "left").withColumn("_salt", F.when(F.col("_rows").isNotNull(), F.pmod(F.xxhash64("_id"), salts)))
    dealt = materialise(dealt.drop("_rows"), "dealt")
    state = materialise(dealt.where("_salt IS NOT NULL").groupBy("_group", "_salt").agg(F.count("*").alias("w")).withColumn("label", (F.col("_salt") % shards).cast("int")), "labels")
    for k in range(rounds):
        load = {r[0]: r[1] for r in state.groupBy("label").agg(F.sum("w")).collect()}
        full = F.array(*(F.lit(load.get(t, 0) >= 0.85 * quota) for t in range(shards)))
        votes = state.groupBy("_group", "label").agg(F.sum("w").alias("v"))
        of_group = Window.partitionBy("_group")
        needed = votes.withColumn("m", F.ceil(F.sum("v").over(of_group) * 10 / (9 * quota)))
        order = of_group.orderBy((F.col("m") == 1) & full[F.col("label")], F.desc("v"), F.xxhash64("_group", "label"))
        ranked = needed.withColumn("r", F.row_number().over(order)).where("r <= m")
        winners = materialise(ranked.select("_group", F.col("label").alias("to"), "r", F.least("m", F.lit(shards)).alias("m")), "winners")
        stays = winners.select("_group", F.col("to").alias("label"), F.lit(True).alias("stays"))
        wants = state.join(stays, ["_group", "label"], "left").join(winners.select("_group", "m").distinct(), "_group")
        wants = wants.withColumn("r", (F.pmod(F.xxhash64("_group", "_salt", F.lit(k)), F.col("m")) + 1).cast("int")).drop("m").join(winners.drop("m"), ["_group", "r"], "left")
        wants = materialise(wants.withColumn("to", F.when(F.col("stays").isNull(), F.col("to"))).select("_group", "_salt", "w", "label", "to"), "wants")
        asked = {(r[0], r[1]): r[2] for r in wants.where("to IS NOT NULL").groupBy("label", "to").agg(F.sum("w")).collect()}
        spare = max(0, min(quota // 24, quota - sum(load.values()) // shards))  # held back, as draws spread, where linked rows leave room
        share = admitted(asked, [quota - spare - load.get(t, 0) for t in range(shards)])
        drawn = F.pmod(F.xxhash64("_salt", "_group", F.lit(k + 1000)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        moves = F.col("to").isNotNull() & (drawn < F.array(*map(F.lit, share))[F.coalesce("to", F.lit(0))])
        moved = materialise(wants.select("_group", "_salt", "w", F.when(moves, F.col("to")).otherwise(F.col("label")).alias("label")), "labels")
        discard(state, winners, wants)
        state = moved
        if not asked:
            break
    labels = state.select("_group", "_salt", F.col("label").alias("_linked"))
    own = F.pmod(F.xxhash64("_id"), F.lit(shards)).cast("int")
    labelled = dealt.join(labels, ["_group", "_salt"], "left").select("_id", "size", "text_crc32", "_group", F.coalesce("_linked", own).alias("label"), F.col("_linked").isNull().cast("int").alias("loose"))
    labelled = materialise(labelled, "labelled")
    ranked = numbered(labelled, ["label", "loose"], [F.col("_group"), F.col("_id")], F.xxhash64("_group", "_id"), total, "at")
    n = {(r[0], r[1]): r[2] for r in labelled.groupBy("label", "loose").agg(F.count("*")).collect()}
    linked = [n.get((t, 0), 0) for t in range(shards)]
    have = [linked[t] + n.get((t, 1), 0) for t in range(shards)]
    quotas = [total // shards + (t < total % shards) for t in sorted(range(shards), key=lambda t: (-have[t], t))]
    fills = dict(zip(sorted(range(shards), key=lambda t: (-have[t], t)), sorted(quotas, reverse=True), strict=True))
    over, gaps, over_at, gap_at = [], [], 0, 0
    for t in range(shards):
        over.append(over_at)
        gaps.append(gap_at)
        over_at += max(0, have[t] - fills[t])
        gap_at += max(0, fills[t] - have[t])
    array = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs))
    at = ranked.withColumn("at", F.col("at") + F.when(F.col("loose") == 1, array(linked)[F.col("label")]).otherwise(0))
    fits = F.col("at") < array([fills[t] for t in range(shards)])[F.col("label")]
    spare = F.col("at") - array([fills[t] for t in range(shards)])[F.col("label")] + array(over)[F.col("label")]
    placed = at.withColumn("spare", F.when(~fits, spare)).withColumn("into", F.size(F.filter(array(gaps[1:]), lambda g: g <= F.col("spare"))))
    shard = F.when(F.col("spare").isNull(), F.col("label")).otherwise(F.col("into")).cast("int")
    slot = F.when(F.col("spare").isNull(), F.col("at")).otherwise(F.col("spare") - array(gaps)[F.col("into")] + array(have)[F.col("into")])
    return placed.select(F.col("_id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), shard.alias("shard"), slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every document."""
    return balanced_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
