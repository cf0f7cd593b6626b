"""Mixing sources to target weights as a Pfair schedule, in Spark expressions only.

A source of weight a/Q owes its block j the window from floor(j Q / a) to
ceil((j + 1) Q / a): release time and deadline. Earliest deadline first meets them all, so
after any number of slots a source is less than one block away from its target. All
windows repeat every Q slots, so one period is scheduled, a row of Q numbers, and block j
of a source takes the place of block j mod a in period j div a.

Many sources are scheduled as a tree: groups of them have a period each, and the place of a
block in its group's period is the number of the group's block one level above.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridtally.llm.common import shielded, written

#: Slots of a period: a source's share of its group is a whole multiple of 1 / PERIOD. A group
#: has as many sources as the root of it at most.
PERIOD = 1000
#: Characters of a block.
BLOCK = 50_000


def period_schedule(totals: DataFrame, *, power: float, period: int) -> DataFrame:
    """source_key, quota, turn (from 0), slot: one period, earliest deadline first.

    Quotas follow size ** power by largest remainders, one at least. There is a row for each
    source, at most ``period`` of them, and more raise an error.
    """
    sources = F.array_sort(F.collect_list(F.struct("source_key", F.pow("size", F.lit(power)).alias("mass"))))
    one = totals.agg(sources.alias("sources")).where(F.size("sources") > 0)
    one = one.withColumn(
        "sources",
        F.when(F.size("sources") <= period, F.col("sources")).otherwise(
            F.raise_error(F.lit(f"more than {period} sources"))
        ),
    )
    q = f"cast({period} as bigint)"
    one = one.selectExpr(
        "'' AS parent",
        "sources",
        "greatest(aggregate(sources, 0D, (a, s) -> a + s.mass), 1e-300D) AS mass",
    ).selectExpr(
        f"transform(sources, (s, i) -> struct(({q} - size(sources)) * s.mass / mass AS share, i AS i)) AS shares",
        "parent",
        "sources",
    )
    one = one.selectExpr(
        "parent",
        "sources",
        "transform(shares, s -> 1 + cast(floor(s.share) as bigint)) AS base",
        "transform(array_sort(transform(shares, s -> struct(floor(s.share) - s.share AS rest, s.i AS i))), r -> r.i) AS neediest",
    )
    one = one.selectExpr(
        "parent",
        "sources",
        "base",
        f"slice(neediest, 1, cast({q} - aggregate(base, 0L, (a, b) -> a + b) as int)) AS extra",
    ).selectExpr(
        "parent",
        "sources",
        "transform(base, (b, i) -> b + if(array_contains(extra, i), 1L, 0L)) AS quotas",
    )
    return earliest_deadline_first(one, period)


def grouped_schedule(groups: DataFrame, *, period: int) -> DataFrame:
    """parent, source_key, quota, turn, slot: a period of each group (parent, sources).

    Quotas are the true shares by largest remainders. What is below one slot gets one, at
    the cost of the largest, which has enough while a group has isqrt(period) members at most.
    """
    q = f"cast({period} as bigint)"
    shared = groups.selectExpr("parent", "sources", "aggregate(sources, 0D, (a, s) -> a + s.mass) AS mass").selectExpr(
        "parent", "sources", f"transform(sources, (s, i) -> struct({q} * s.mass / mass AS share, i AS i)) AS shares"
    )
    based = shared.selectExpr(
        "parent",
        "sources",
        "transform(shares, s -> greatest(1L, cast(floor(s.share) as bigint))) AS base",
        """transform(array_sort(transform(shares, s ->
            struct(if(s.share < 1, 0D, floor(s.share) - s.share) AS rest, s.i AS i))), r -> r.i) AS neediest""",
    ).selectExpr(
        "*",
        f"cast({q} - aggregate(base, 0L, (a, b) -> a + b) as int) AS left",
        "-array_max(transform(base, (b, i) -> struct(b AS b, -i AS i))).i AS largest",
    )
    quotas = """transform(base, (b, i) -> b
        + if(array_contains(slice(neediest, 1, greatest(left, 0)), i), 1L, 0L)
        + if(i = largest, least(left, 0), 0))"""
    return earliest_deadline_first(based.selectExpr("parent", "sources", f"{quotas} AS quotas"), period)


def earliest_deadline_first(groups: DataFrame, period: int) -> DataFrame:
    """parent, source_key, quota, turn and slot of groups (parent, sources, quotas)."""
    q = f"cast({period} as bigint)"
    due = f"""
        array_min(transform(quotas, (a, i) ->
            if(s.done[i] < a AND s.done[i] * {q} div a <= u div 2,
               struct(((s.done[i] + 1) * {q} + a - 1) div a AS deadline, i AS i), null))).i"""
    # The chosen source is needed twice, so each slot is two steps: choose, then count.
    turns = f"""
        aggregate(sequence(0, {2 * period - 1}),
            named_struct('done', transform(quotas, a -> 0L), 'next', -1, 'order', cast(array() as array<int>)),
            (s, u) -> if(u % 2 = 0,
                named_struct('done', s.done, 'next', {due}, 'order', s.order),
                named_struct(
                    'done', transform(s.done, (d, i) -> d + if(i = s.next, 1L, 0L)),
                    'next', -1,
                    'order', concat(s.order, array(s.next)))),
            s -> s.order)"""
    slots = groups.selectExpr("parent", "sources", "quotas", f"posexplode({turns}) AS (slot, i)")
    slots = slots.selectExpr("parent", "sources[i].source_key AS source_key", "quotas[i] AS quota", "slot")
    turn = F.row_number().over(W.partitionBy("source_key").orderBy("slot")) - 1
    return slots.select("parent", "source_key", "quota", turn.cast("long").alias("turn"), "slot")


def ranked(nodes: DataFrame) -> DataFrame:
    """Nodes (source_key, mass) with rank, from 0: larger powers of two of the mass first.

    Within a power the order is that of digests, in 256 parts, whose counts are added up
    first: 64 times 256 rows at most.
    """
    scale = F.coalesce(F.floor(F.log2("mass")), F.lit(0))
    dealt = nodes.withColumn("digest", F.md5("source_key")).select(
        "*", (-F.least(F.lit(40), F.greatest(F.lit(-23), scale))).alias("scale"), F.substring("digest", 1, 2).alias("part")
    )
    before = W.orderBy("scale", "part").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        dealt.groupBy("scale", "part")
        .agg(F.count("*").alias("n"))
        .select("scale", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    own = F.row_number().over(W.partitionBy("scale", "part").orderBy("digest", "source_key")) - 1
    return dealt.withColumn("own", own).join(starts, ["scale", "part"]).select(
        "source_key", "mass", (F.col("start") + F.col("own")).alias("rank")
    )


def tree_slots(totals: DataFrame, *, power: float, block: int, period: int) -> DataFrame:
    """source_key, block, weight and slot of all blocks, for any number of sources.

    Sources of like mass are grouped, then the groups, until one group is left. A source is
    less than one block away from its target for each level, a weight less than
    1 / period of its group's.
    """
    room = isqrt(period)
    mass = F.greatest(F.pow("size", F.lit(power)), F.lit(1e-9))
    nodes = written(totals.select("source_key", mass.alias("mass")), "mix-nodes")
    slots = totals.select(
        "source_key",
        F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"size div {block}"))).alias("block"),
    ).select("*", F.col("source_key").alias("node"), F.lit(1.0).alias("weight"), F.col("block").alias("slot"))
    while True:
        last = nodes.count() <= room
        parent = F.lit("") if last else F.expr(f"cast(rank div {room} as string)")
        groups = ranked(nodes).groupBy(parent.alias("parent")).agg(
            F.array_sort(F.collect_list(F.struct("source_key", "mass"))).alias("sources")
        )
        groups = written(groups, "mix-groups")
        schedule = written(grouped_schedule(groups, period=period), "mix-schedule").select(
            "parent", F.col("source_key").alias("node"), "quota", "turn", F.col("slot").alias("at")
        )
        quotas = schedule.select("node", "parent", "quota").distinct()
        slots = (
            slots.join(quotas, "node")
            .withColumn("turn", F.col("slot") % F.col("quota"))
            .join(schedule.select("node", "turn", "at"), ["node", "turn"])
            .select(
                "source_key",
                "block",
                F.col("parent").alias("node"),
                (F.col("weight") * F.col("quota") / F.lit(period)).alias("weight"),
                F.expr(f"slot div quota * {period} + at").alias("slot"),
            )
        )
        if last:
            return slots.drop("node")
        nodes = groups.selectExpr("parent AS source_key", "aggregate(sources, 0D, (a, s) -> a + s.mass) AS mass")


PLACE = "_place"


def with_places(
    docs: DataFrame, *, power: float = 0.5, block: int = BLOCK, period: int = PERIOD, seed: str = "mix"
) -> DataFrame:
    """All columns of ``docs``, and a last one, a struct of weight, block, slot and at."""
    columns = [c for c in docs.columns if c != PLACE and not c.startswith("_mix_")]
    digest = F.md5(F.concat_ws("-", F.lit(seed), F.col("doc_id").cast("string")))
    sized = (
        docs.select(*columns)
        .withColumn("_mix_key", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")))
        .withColumn("_mix_digest", digest)
        .withColumn("_mix_part", F.substring("_mix_digest", 1, 2))
        .withColumn("_mix_size", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    )
    parts = written(sized.groupBy("_mix_key", "_mix_part").agg(F.sum("_mix_size").alias("_mix_sum")), "mix-parts")
    before = W.partitionBy("_mix_key").orderBy("_mix_part").rowsBetween(W.unboundedPreceding, -1)
    starts = parts.select(
        "_mix_key", "_mix_part", F.coalesce(F.sum("_mix_sum").over(before), F.lit(0)).alias("_mix_start")
    )
    totals = parts.groupBy(F.col("_mix_key").alias("source_key")).agg(F.sum("_mix_sum").alias("size"))
    order = W.partitionBy("_mix_key", "_mix_part").orderBy("_mix_digest", "doc_id", "_mix_size")
    own = F.coalesce(F.sum("_mix_size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = (
        sized.withColumn("_mix_own", own)
        .join(starts, ["_mix_key", "_mix_part"])
        .withColumn("_mix_at", F.col("_mix_start") + F.col("_mix_own"))
        .withColumn("_mix_block", F.expr(f"_mix_at div {block}"))
    )
    room = isqrt(period)
    if room > 1 and totals.count() > room:
        slots = written(tree_slots(totals, power=power, block=block, period=period), "mix-slots")
        slots = slots.select(*[F.col(c).alias(f"_mix_{n}") for c, n in (("source_key", "key"), ("block", "block"), ("weight", "weight"), ("slot", "slot"))])
        place = F.struct(
            F.col("_mix_weight").alias("weight"),
            F.col("_mix_block").alias("block"),
            F.col("_mix_slot").alias("slot"),
            (F.col("_mix_at") % F.lit(block)).alias("at"),
        )
        return placed.join(slots, ["_mix_key", "_mix_block"]).select(*columns, place.alias(PLACE))
    schedule = written(period_schedule(totals, power=power, period=period), "mix-schedule")
    quotas = schedule.select(F.col("source_key").alias("_mix_key"), F.col("quota").alias("_mix_quota")).distinct()
    turns = schedule.select(
        F.col("source_key").alias("_mix_key"),
        F.col("turn").alias("_mix_turn"),
        F.col("slot").alias("_mix_slot"),
    )
    place = F.struct(
        (F.col("_mix_quota") / F.lit(period)).alias("weight"),
        F.col("_mix_block").alias("block"),
        F.expr(f"_mix_block div _mix_quota * {period} + _mix_slot").alias("slot"),
        (F.col("_mix_at") % F.lit(block)).alias("at"),
    )
    return (
        placed.join(quotas, "_mix_key")
        .withColumn("_mix_turn", F.col("_mix_block") % F.col("_mix_quota"))
        .join(turns, ["_mix_key", "_mix_turn"])
        .select(*columns, place.alias(PLACE))
    )


def pfair_mix(
    docs: DataFrame, *, power: float = 0.5, block: int = BLOCK, period: int = PERIOD, seed: str = "mix"
) -> DataFrame:
    """Every row of ``docs`` with the slot of its block; no row is left out or repeated.

    Adds weight (of the source), block (its number within the source), slot, and at (the
    characters of the source in the block before it): ordered by slot, at and doc_id, the
    rows are the mix, until a source runs out; its later slots stay empty. Columns of these
    names are replaced, and such that begin with _mix_ are left out. Target weights follow
    the sources' characters to the ``power``; up to isqrt(period) sources share one period,
    in which each has a slot at least, and more are scheduled as a tree of such groups. A
    period below 4 has no groups, and raises an error where there are more sources than slots.

    Rows of a source are shuffled by a digest of their doc_id and cut every ``block``
    characters; a longer text takes the slots of several blocks. A NULL or empty text has no
    characters and stays beside its neighbour. NULL is a source of its own. Repeated rows stand
    side by side; which of them is first makes no difference. An empty table gives an empty
    result.

    A source may hold most rows: it is numbered in 256 parts by digest, whose sums are
    added up first.
    """
    docs = docs.drop("weight", "block", "slot", "at")
    mixed = with_places(docs, power=power, block=block, period=period, seed=seed)
    return mixed.select(*[c for c in mixed.columns if c != PLACE], f"{PLACE}.*")


def in_mixed_order(docs: DataFrame) -> DataFrame:
    """The rows and columns of ``docs``, sorted into the order of the mix.

    Rows of equal place are in order of doc_id; repeated rows stand side by side. Names of
    other columns do not matter. An empty table gives an empty result.
    """
    place = F.col(PLACE)
    rows = shielded(docs, ["doc_id", "source", "text"])
    mixed = with_places(rows).orderBy(place["slot"], place["at"], "doc_id")
    return mixed.select(*rows.columns).toDF(*docs.columns)


#: The rows of pfair_mix over documents, as ``op9_pfair_mix`` selects them.
PFAIR_SQL = f"""
WITH RECURSIVE sized AS (
    SELECT doc_id, source, coalesce('=' || source, '') AS k,
           md5('mix-' || coalesce(cast(doc_id AS varchar), '')) AS digest,
           coalesce(length(text), 0) AS n
    FROM documents),
totals AS (SELECT k, sqrt(cast(sum(n) AS double)) AS mass FROM sized GROUP BY k),
shares AS (
    SELECT k, row_number() OVER (ORDER BY k) - 1 AS i,
           ({PERIOD} - count(*) OVER ()) * mass / greatest(sum(mass) OVER (), 1e-300) AS share
    FROM totals),
quotas AS (
    SELECT k, i, 1 + floor(share)::bigint
        + CASE WHEN row_number() OVER (ORDER BY floor(share) - share, i)
              <= {PERIOD} - sum(1 + floor(share)::bigint) OVER () THEN 1 ELSE 0 END AS a
    FROM shares),
lists AS (SELECT list(a ORDER BY i)::bigint[] AS quotas FROM quotas),
run(t, done, pick) AS (
    SELECT 0, list_transform(quotas, lambda a: 0::bigint), NULL::bigint FROM lists
    UNION ALL
    SELECT t + 1, list_transform(done, lambda d, i: d + CASE WHEN i = p THEN 1 ELSE 0 END), p
    FROM (
        SELECT t, done, (
            SELECT arg_min(i, ((done[i] + 1) * {PERIOD} + quotas[i] - 1) // quotas[i] * 10000 + i)
            FROM (SELECT unnest(range(1, len(quotas) + 1)) AS i)
            WHERE done[i] < quotas[i] AND done[i] * {PERIOD} // quotas[i] <= t) AS p
        FROM run, lists
        WHERE t < {PERIOD})),
turns AS (
    SELECT pick, t - 1 AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS turn
    FROM run WHERE t > 0),
placed AS (
    SELECT *, cast(coalesce(sum(n) OVER (
        PARTITION BY k ORDER BY digest, doc_id, n
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS pos
    FROM sized)
SELECT doc_id, source, a / {PERIOD}.0::double AS weight, pos // {BLOCK} AS block,
       (pos // {BLOCK}) // a * {PERIOD} + slot AS slot, pos % {BLOCK} AS at
FROM placed JOIN quotas USING (k)
JOIN turns ON pick = i + 1 AND turn = (pos // {BLOCK}) % a
"""
