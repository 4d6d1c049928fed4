"""Hard-negative mining by segment summary filtering.

Each vector is cut into segments, coarse ones and finer ones within them, of which its mean and its
deviation are stored. The inner product of two segments is the product of their means times their
length, plus or minus at most the product of their deviations (Cauchy and Schwarz). Anchors and rows
meet in blocks; there the coarse segments bound all scores, pairs that can't matter are dropped, the
finer segments bound what is left, and only what then is still open is scored exactly, in integers.
Two passes: each anchor's nearest rows of its own label, its positives; then, for each positive, the
highest rows of other labels within a band below its score.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_type, materialise

#: Segments of each level; rows and anchors of a block; anchors whose bounds are worked out at a time; pairs scored at a time.
LEVELS, ROWS, ANCHORS, STRIP, PAIRS = (4, 16), 4096, 1024, 128, 1 << 15
#: Bounds are kept in single precision and widened by this share of the vectors' lengths.
SLACK = 1e-5
_LONG = (-(2**63), 2**63 - 1)


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as a double; null if the vector or a component is null or not finite. Beyond 64 bits it stays at their end."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    sound = F.forall(doubles, lambda x: F.coalesce((x > float("-inf")) & (x < float("inf")) & ~F.isnan(x), F.lit(False)))
    return F.when(sound, F.transform(doubles, lambda x: F.floor(x * F.lit(float(scale))).cast("long")))


def _edges(width: int, segments: int) -> np.ndarray:
    return np.linspace(0, width, min(segments, width) + 1).astype(int)


def summaries(vectors: np.ndarray, levels: tuple[int, ...] = LEVELS) -> np.ndarray:
    """For each vector and level the segments' means, times the root of their length, and then their deviations, times the same."""
    parts = []
    for segments in levels:
        edges = _edges(vectors.shape[1], segments)
        sizes = np.diff(edges).astype(float)
        sums = np.add.reduceat(vectors, edges[:-1], axis=1) if len(sizes) else np.zeros((len(vectors), 0))
        means = sums / sizes
        deviations = np.sqrt(np.add.reduceat((vectors - np.repeat(means, np.diff(edges), axis=1)) ** 2, edges[:-1], axis=1)) if len(sizes) else sums
        parts += [means * np.sqrt(sizes), deviations]
    return np.hstack(parts)


def _summed(width: int):
    """Rows (vec_id, label, vector) with the vector as bytes and its summary."""

    def summed(batches):
        for batch in batches:
            vectors = [np.array(v, np.int64) for v in batch["vector"].to_pylist()]
            whole = np.zeros((len(vectors), width))
            for i, v in enumerate(vectors):
                whole[i, : len(v)] = v
            packed = []
            for v in vectors:  # the narrowest type that holds all components, told by its size
                size = next(t for t in (np.int16, np.int32, np.int64) if not len(v) or (v.min() >= np.iinfo(t).min and v.max() <= np.iinfo(t).max))
                packed.append(bytes([np.dtype(size).itemsize]) + v.astype(size).tobytes())
            marks = summaries(whole).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], batch["anchor"], pa.array(packed, pa.binary()), pa.array([m.tobytes() for m in marks], pa.binary())], ["vec_id", "label", "anchor", "vector", "summary"])

    return summed


class _Block:
    """Rows of one block in order of their ids, one for each id: of several, that of the smallest label, then vector."""

    def __init__(self, table: pa.Table, width: int):
        ids, labels, vectors = (table[c].to_pylist() for c in ("vec_id", "label", "vector"))
        order = sorted(range(len(ids)), key=lambda i: (ids[i], labels[i], vectors[i]))
        order = [i for n, i in enumerate(order) if not n or ids[i] != ids[order[n - 1]]]
        self.ids, self.labels = np.array([ids[i] for i in order], object), np.array([labels[i] for i in order], object)
        self.vectors = np.zeros((len(order), width), np.int64)
        for n, i in enumerate(order):
            v = np.frombuffer(vectors[i], f"i{vectors[i][0]}", offset=1)
            self.vectors[n, : len(v)] = v
        marks = table["summary"].to_pylist()
        marks = np.array([np.frombuffer(marks[i], np.float32) for i in order], np.float64).reshape(len(order), 2 * sum(min(x, width) for x in LEVELS))
        self.levels, at = [], 0
        for segments in LEVELS:
            n = min(segments, width)
            self.levels.append((marks[:, at : at + n], marks[:, at + n : at + 2 * n]))
            at += 2 * n
        means, deviations = self.levels[0]
        self.lengths = np.sqrt((means**2 + deviations**2).sum(1))
        self.order = order


def _codes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that are equal where the values are."""
    seen: dict = {}
    return tuple(np.array([seen.setdefault(v, len(seen)) for v in x], np.int64) for x in (a, b))


def _scores(a: _Block, b: _Block, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact integer scores of the pairs: in 64 bits where they must fit, else in Python's integers."""
    most = int(np.abs(a.vectors.astype(float)).max(initial=0)) * int(np.abs(b.vectors.astype(float)).max(initial=0)) * max(1, a.vectors.shape[1])
    fits = most < 2**62
    out = []
    for i in range(0, len(x), PAIRS):
        u, v = a.vectors[x[i : i + PAIRS]], b.vectors[y[i : i + PAIRS]]
        out.append(np.einsum("ij,ij->i", u, v) if fits else (u.astype(object) * v.astype(object)).sum(axis=1) if u.shape[1] else np.zeros(len(u), object))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _coarse(a: _Block, b: _Block, s: slice) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of a strip of anchors with all rows, by the coarsest segments."""
    (ma, da), (mb, db) = a.levels[0], b.levels[0]
    middle, reach = ma[s] @ mb.T, da[s] @ db.T + SLACK * np.outer(a.lengths[s], b.lengths) + 1
    return middle - reach, middle + reach


def _fine(a: _Block, b: _Block, x: np.ndarray, y: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for pairs, by the segments of a finer level."""
    (ma, da), (mb, db) = a.levels[level], b.levels[level]
    low, high = np.empty(len(x)), np.empty(len(x))
    for i in range(0, len(x), PAIRS):
        p, q = x[i : i + PAIRS], y[i : i + PAIRS]
        middle = np.einsum("ij,ij->i", ma[p], mb[q])
        reach = np.einsum("ij,ij->i", da[p], db[q]) + SLACK * a.lengths[p] * b.lengths[q] + 1
        low[i : i + PAIRS], high[i : i + PAIRS] = middle - reach, middle + reach
    return low, high


def _kth(values: np.ndarray, k: int) -> float:
    """The k-th highest value; below all if there are fewer."""
    return -math.inf if len(values) < k else float(np.partition(values, len(values) - k)[len(values) - k])


def _ranked(scores: np.ndarray, ids: np.ndarray, k: int) -> list[int]:
    """Places of the k highest scores, ties by smaller id; ``ids`` are in order."""
    if scores.dtype == object:
        return sorted(range(len(ids)), key=lambda i: (-scores[i], i))[:k]
    return np.argsort(-scores, kind="stable")[:k].tolist()


def _clip(score) -> int:
    return min(max(int(score), _LONG[0]), _LONG[1])


def _split(table: pa.Table, width: int) -> tuple[_Block, _Block, pa.Table]:
    anchors = table.filter(table["anchor"])
    return _Block(anchors, width), _Block(table.filter(pc.invert(table["anchor"])), width), anchors


def _positives(width: int, k: int):
    def found(table: pa.Table) -> pa.Table:
        """(anchor_id, vec_id, score): of this block the k nearest rows of each anchor's label."""
        a, b, _ = _split(table, width)
        mine, theirs = _codes(a.labels, b.labels)
        me, them = _codes(a.ids, b.ids)
        out = []
        for start in range(0, len(a.ids), STRIP):
            s = slice(start, start + STRIP)
            low, high = _coarse(a, b, s)
            open_ = (mine[s, None] == theirs) & (me[s, None] != them)
            for i in range(len(low)):
                y = np.flatnonzero(open_[i])
                y = y[high[i, y] >= _kth(low[i, y], k)]
                for level in range(1, len(LEVELS)):
                    x = np.full(len(y), start + i)
                    at_least, at_most = _fine(a, b, x, y, level)
                    y = y[at_most >= _kth(at_least, k)]
                scores = _scores(a, b, np.full(len(y), start + i), y)
                out += [(a.ids[start + i], b.ids[y[j]], _clip(scores[j])) for j in _ranked(scores, y, k)]
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table({"anchor_id": pa.array(cols[0], table.schema.field("vec_id").type), "vec_id": pa.array(cols[1], table.schema.field("vec_id").type), "score": pa.array(cols[2], pa.int64())})

    return found


def _negatives(width: int, k: int, least: Fraction, most: Fraction):
    def found(table: pa.Table) -> pa.Table:
        """(anchor_id, positive_id, positive_score, negative_id, score): of this block the k highest rows of other labels in each positive's band."""
        a, b, rows = _split(table, width)
        mine, theirs = _codes(a.labels, b.labels)
        given = rows["positives"].to_pylist()
        out = []
        for start in range(0, len(a.ids), STRIP):
            s = slice(start, start + STRIP)
            low, high = _coarse(a, b, s)
            others = mine[s, None] != theirs
            for i in range(len(low)):
                own = given[a.order[start + i]] or []
                bands = [(math.ceil(least * p["score"]), math.floor(most * p["score"])) for p in own]

                def left(at_least: np.ndarray, at_most: np.ndarray, bands: list = bands) -> np.ndarray:
                    """Pairs that any band may want: they may lie in it, and k certain ones are not surely above them."""
                    keep = np.zeros(len(at_least), bool)
                    for lo, hi in bands:
                        certain = at_least[(at_least >= lo) & (at_most <= hi)]
                        keep |= (at_most >= lo) & (at_least <= hi) & (at_most >= _kth(certain, k))
                    return keep

                y = np.flatnonzero(others[i])
                y = y[left(low[i, y], high[i, y])]
                for level in range(1, len(LEVELS)):
                    y = y[left(*_fine(a, b, np.full(len(y), start + i), y, level))]
                scores = _scores(a, b, np.full(len(y), start + i), y)
                for p, (lo, hi) in zip(own, bands, strict=True):
                    within = np.flatnonzero((scores >= lo) & (scores <= hi))
                    out += [(a.ids[start + i], p["vec_id"], p["score"], b.ids[y[within[j]]], _clip(scores[within[j]])) for j in _ranked(scores[within], within, k)]
        cols = list(zip(*out, strict=True)) or [()] * 5
        ids = table.schema.field("vec_id").type
        return pa.table(dict(zip(("anchor_id", "positive_id", "positive_score", "negative_id", "score"), (pa.array(c, t) for c, t in zip(cols, (ids, ids, pa.int64(), ids, pa.int64()), strict=True)), strict=True)))

    return found


def mine_hard_negatives(
    rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, least: Fraction = Fraction(3, 10), most: Fraction = Fraction(9, 10), block_rows: int = ROWS, block_anchors: int = ANCHORS
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``rows`` (vec_id, label, vector: array of long).

    Anchors are the rows that ``anchor`` holds for; scores are inner products, higher ones first, ties by smaller vec_id. An anchor's
    positives are its first ``positives`` other rows of its label, all if there are fewer; for each the first ``negatives`` rows of
    other labels are returned whose score is between ``least`` and ``most`` times the positive's.

    Rows with a null label, vector, component or vec_id take no part. Of rows of one vec_id one takes part, that of the smallest label, then
    vector. Vectors of unequal length are compared as if the shorter ended in zeros; empty ones score 0. A positive's score beyond 64 bits counts
    as their end, and so does a negative's where it is returned. An empty table gives an empty result; further columns are left out.
    """
    sound = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL AND forall(vector, x -> x IS NOT NULL)").select("vec_id", "label", F.coalesce(anchor, F.lit(False)).alias("anchor"), "vector")
    n, chosen, width = sound.agg(F.count("*"), F.coalesce(F.sum(F.col("anchor").cast("long")), F.lit(0)), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    ids, labels = id_type(rows, "vec_id"), id_type(rows, "label")
    stored = materialise(sound.mapInArrow(_summed(width), f"vec_id {ids}, label {labels}, anchor boolean, vector binary, summary binary"), "vectors")
    blocks, parts = max(1, -(-n // block_rows)), max(1, -(-chosen // block_anchors))
    wanted = stored.where("anchor")

    def met(anchors: DataFrame) -> DataFrame:
        """Each block of rows with each block of anchors."""
        b = stored.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks).cast("long"))).withColumn("part", F.explode(F.sequence(*[F.lit(x).cast("long") for x in (0, parts - 1)])))
        a = anchors.withColumn("part", F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(parts).cast("long"))).withColumn("block", F.explode(F.sequence(*[F.lit(x).cast("long") for x in (0, blocks - 1)])))
        return a.unionByName(b.withColumn("anchor", F.lit(False)), allowMissingColumns=True).groupBy("block", "part")

    near = met(wanted).applyInArrow(_positives(width, positives), f"anchor_id {ids}, vec_id {ids}, score long")
    first = Window.partitionBy("anchor_id").orderBy(F.col("score").desc(), "vec_id")
    near = near.withColumn("nr", F.row_number().over(first)).where(F.col("nr") <= positives)
    near = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("nr", "vec_id", "score"))).alias("positives"))
    near = materialise(near.withColumnRenamed("anchor_id", "vec_id"), "positives")
    hard = met(wanted.join(near, "vec_id")).applyInArrow(_negatives(width, negatives, least, most), f"anchor_id {ids}, positive_id {ids}, positive_score long, negative_id {ids}, score long")
    best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("score").desc(), "negative_id")
    ranked = hard.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", F.col("score").alias("negative_score"))
