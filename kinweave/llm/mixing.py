"""Mixing sources to target weights by Sainte-Laguë apportionment.

Each source's documents are put into a seeded order and cut into blocks of equal numbers of words.
Blocks are the seats of an election: they go to the sources one by one, each to the source of the
highest quotient target / (2 * seats + 1). The method is house-monotone, so the seats of any stretch
of the mix, a shard, are the difference of two apportionments and are never negative. A source draws
the blocks of its seats in the seeded order, from the start again once all are drawn.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import count_words, text_of

SEED = "mix"
#: Words in a block, at most; how many blocks the smallest target has, at least; rows, on average, in one stretch of a source's seeded order.
BLOCK, FINE, STRETCH = 64, 16, 4_000
MIXED = ("mix_size", "mix_source_size", "mix_target", "mix_taken", "mix_from")


def cyclic_weights(sources: list, cycle: tuple = (5, 2, 1)) -> list:
    """The weights of ``sources``, which are in order: those of ``cycle``, repeating."""
    return [cycle[i % len(cycle)] for i in range(len(sources))]


def water_fill(sizes: list[int], weights: list[int], share: tuple[int, int] = (3, 2), most: int = 2) -> list[float]:
    """Targets that share ``share`` of all sizes by weight; none is above ``most`` times its size, and the excess is shared again by weight."""
    total = sum(sizes) * share[0]
    open_ = sorted((i for i in range(len(sizes))), key=lambda i: most * sizes[i] / weights[i])
    capped = set()
    spare, weight = total, sum(weights)  # times share[1]
    for i in open_:
        if spare * weights[i] <= most * sizes[i] * weight * share[1]:
            break
        capped.add(i)
        spare -= most * sizes[i] * share[1]
        weight -= weights[i]
    return [float(most * n) if i in capped else spare * w / (weight * share[1]) for i, (n, w) in enumerate(zip(sizes, weights, strict=True))]


def sainte_lague(targets: list[float], seats: int) -> list[int]:
    """Seats of each target by highest quotients; ties go to the earlier one.

    Each party first gets the seats it has whatever the last quotient is, within one of its fair share;
    only the few that remain are dealt one by one, so that the work doesn't grow with the seats.
    """
    total = sum(targets)
    if not total or not seats:
        return [0] * len(targets)
    given = [max(0, math.floor(t * max(0, seats - len(targets)) / total) - 1) for t in targets]
    heap = [(-t / (2 * n + 1), i) for i, (t, n) in enumerate(zip(targets, given, strict=True)) if t > 0]
    heapq.heapify(heap)
    for _ in range(seats - sum(given)):
        _, i = heap[0]
        given[i] += 1
        heapq.heapreplace(heap, (-targets[i] / (2 * given[i] + 1), i))
    return given


def quotas(targets: list[float], shards: int, block: int = BLOCK) -> list[list[int]]:
    """For each of the shards, the blocks of each source; over all shards they are an apportionment of all blocks."""
    seats = round(sum(targets) / block)
    marks = [sainte_lague(targets, seats * k // shards) for k in range(shards + 1)]
    return [[b - a for a, b in zip(x, y, strict=True)] for x, y in zip(marks, marks[1:], strict=False)]


def block_size(targets: list[float], most: int = BLOCK) -> int:
    """Words in a block: ``most``, or fewer if a target would be less than :data:`FINE` blocks, so that small sources get their seats too."""
    smallest = min((t for t in targets if t > 0), default=0.0)
    return max(1, min(most, math.floor(smallest / FINE)))


def _order() -> Column:
    return F.md5(F.concat(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit(""))).cast("binary"))


def mix(docs: DataFrame, weights=cyclic_weights, block: int = BLOCK, shards: int = 24, stretch: int = STRETCH) -> DataFrame:
    """All rows of ``docs`` (doc_id, text, source and any others) with mix_size, mix_source_size, mix_target, mix_taken and mix_from.

    mix_size is the number of words of the text (null: 0); mix_target is the source's share of 150 %
    of all words, by the weights that ``weights`` gives the ordered list of sources, null last, and
    never above twice the source's size. Blocks have ``block`` words, or fewer where a source is small (see :func:`block_size`). mix_taken is the number of words that the mix takes from the
    row: with whole blocks drawn in the seeded order that is the whole row once or twice or not at
    all, but for the row in which a source's last block ends. mix_from is the shard of the first
    block drawn from it (null if none). Only totals of sources reach the driver; the list of sources
    is part of a mix's recipe, as their weights are.

    Rows of no words take nothing. A null doc_id is placed by its text; repeated rows
    are interchangeable. An empty table
    gives an empty result. Further columns are passed through, packed into one; those with the names of the results are replaced.
    """
    kept = [c for c in docs.columns if c not in MIXED]
    out = mix_measured(measured(docs), weights, block, shards, stretch)
    return out.select(*[F.col("record").getField(c).alias(c) for c in kept], *MIXED)


def measured(docs: DataFrame, pack: bool = True) -> DataFrame:
    """(record, doc_id, source, mix_size, mix_order, mix_mark): what :func:`mix_measured` takes, and the row itself if it is to come along."""
    record = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record")] if pack else []
    return docs.select(*record, "doc_id", "source", count_words(text_of()).alias("mix_size"), _order().alias("mix_order"), F.xxhash64("text").alias("mix_mark"))


def mix_measured(rows: DataFrame, weights=cyclic_weights, block: int = BLOCK, shards: int = 24, stretch: int = STRETCH) -> DataFrame:
    """:func:`mix` over rows that :func:`measured` has given, which a caller may have written, as they are read three times."""
    totals = rows.groupBy("source").agg(F.sum("mix_size").alias("size"), F.count("*").alias("n")).collect()
    totals.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in totals]
    targets = water_fill(sizes, weights([r["source"] for r in totals]))
    block = block_size(targets, block)
    by_shard = quotas(targets, shards, block)
    table = [(r["source"], r["size"], float(t), sum(q[i] for q in by_shard), [sum(q[i] for q in by_shard[: k + 1]) for k in range(shards)], -(-r["n"] // stretch)) for i, (r, t) in enumerate(zip(totals, targets, strict=True))]
    recipe = rows.sparkSession.createDataFrame(table, "mix_source string, mix_source_size long, mix_target double, mix_quota long, mix_ends array<long>, mix_stretches long")
    # A source's order is cut into stretches of bounded size, so that no task gets a whole source.
    rows = rows.join(F.broadcast(recipe), F.col("source").eqNullSafe(F.col("mix_source")))
    rows = rows.withColumn("mix_stretch", F.floor(F.conv(F.substring("mix_order", 1, 8), 16, 10).cast("long") * F.col("mix_stretches") / F.lit(float(2**32))))
    stretches = rows.groupBy("source", "mix_stretch").agg(F.sum("mix_size").alias("n"))
    before = Window.partitionBy("source").orderBy("mix_stretch")
    starts = stretches.select(F.col("source").alias("mix_source_at"), F.col("mix_stretch").alias("mix_stretch_at"), (F.sum("n").over(before) - F.col("n")).alias("mix_offset"))
    rows = rows.join(starts, F.col("source").eqNullSafe(F.col("mix_source_at")) & (F.col("mix_stretch") == F.col("mix_stretch_at")))
    within = Window.partitionBy("source", "mix_stretch").orderBy("mix_order", "doc_id", "mix_mark").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.col("mix_offset") + F.sum("mix_size").over(within) - F.col("mix_size")
    blocks = F.ceil(F.col("mix_source_size") / block)  # in one pass through the source
    passes = F.floor(F.col("mix_quota") / blocks)
    rest = F.least((F.col("mix_quota") - passes * blocks) * block, F.col("mix_source_size"))
    size = F.col("mix_size")
    taken = F.least(passes * size + F.greatest(F.lit(0), F.least(size, rest - F.col("mix_start"))), 2 * size)
    first = F.floor(F.col("mix_start") / block)
    return (
        rows.withColumn("mix_start", start)
        .withColumn("mix_taken", F.when(size == 0, 0).otherwise(taken).cast("long"))
        .withColumn("mix_from", F.when(F.col("mix_taken") > 0, F.size(F.filter("mix_ends", lambda end: end <= first))))
        .select(*[c for c in ("record", "doc_id") if c in rows.columns], *MIXED)
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as the mix takes it, none to two times; a row taken in part counts as half up."""
    copies = F.floor(F.col("mix_taken") / F.greatest("mix_size", F.lit(1)) + 0.5).cast("int")
    out = mix_measured(measured(docs), **options).withColumn("mix_copy", F.explode(F.array_repeat(F.lit(1), copies)))
    return out.select("record.*")
