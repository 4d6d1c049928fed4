"""Quality rules with an isolation forest over their statistics.

Each rule measures one thing of a whole text. Two base rules reject by themselves. For all others
isolation forests are grown over a bounded sample: random splits part an unusual text from the rest
after few steps, so that its mean path is short. How short is too short is calibrated on all
labelled rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, bounded, id_type, label_of, materialise, text_of

#: Labelled rows to learn from at most; trees; rows drawn for each tree.
SAMPLE, TREES, DRAWN, SEED = 20_000, 200, 32, 6
#: Of labelled good rows, at most this share may be called anomalous.
LOST = 0.001
WINDOW = 8

_words = re.compile(WORD).findall
_symbol = re.compile(r"[#*$%&|<>]").findall

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeat_words(words: list[str], window: int = WINDOW) -> int:
    """Words in windows of ``window`` words that are found twice or more in the text, the first one included.

    Windows get exact numbers by doubling: equal pairs of windows of half the length have equal numbers.
    """
    n = len(words)
    if n <= window:
        return 0
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    if len(seen) == n:
        return 0
    size = 1
    while size < window:
        pairs = ids[: len(ids) - size] * (int(ids.max()) + 1) + ids[size:]
        _, ids = np.unique(pairs, return_inverse=True)
        size *= 2
    counts = np.bincount(ids)
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(counts[ids] > 1)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int(np.count_nonzero(np.cumsum(edge)))


def measure(text: str) -> tuple:
    """The counts of :data:`COUNTS`: words, their characters, symbols, lines with a word that equal an earlier one, words in repeated windows."""
    words = _words(text)
    lines = [line for line in text.split("\n") if _words(line)] if "\n" in text else []
    return len(words), sum(map(len, words)), len(_symbol(text)), len(lines) - len(set(lines)), repeat_words(words)


def rule_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, the counts of :data:`COUNTS`), one row for each row of ``docs``; null texts have none of anything."""

    def run(batches):
        for batch in batches:
            found = np.array([measure(t) for t in batch["text"].to_pylist()], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c) for c in np.ascontiguousarray(found.T))], ["doc_id", *COUNTS])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, f"doc_id {id_type(docs)}, " + ", ".join(f"{c} long" for c in COUNTS))


#: The columns of :func:`features` that share a forest. In a single forest the three that hardly part good rows from bad ones dilute the paths of the two that do.
VIEWS = ((0, 1), (2,), (3,), (4,))


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    """The forests' view of all counts: mean length of a word; symbols, repeated lines and words in repeated windows by word, and words, on a log scale."""
    n = np.maximum(counts["n_words"], 1).astype(float)
    by_word = [np.log1p(10 * counts[c] / n) for c in ("n_symbols", "n_dup_lines", "n_repeat_words")]
    return np.column_stack((counts["word_chars"] / n, *by_word, np.log1p(counts["n_words"])))


def mean_path(n: float) -> float:
    """The mean depth of an unsuccessful search in a binary tree of n rows."""
    if n < 2:
        return 0.0
    return 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else 1.0


@dataclass
class IsolationForest:
    """Trees as arrays: feature (-1: leaf), threshold, left child (the right one follows it), and a leaf's path length."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    drawn: int

    @classmethod
    def grow(cls, x: np.ndarray, trees: int = TREES, drawn: int = DRAWN, seed: int = SEED) -> IsolationForest:
        rng = np.random.default_rng(seed)
        drawn = min(drawn, len(x))
        limit = int(np.ceil(np.log2(max(drawn, 2))))
        return cls([cls._tree(x[rng.choice(len(x), drawn, replace=False)], limit, rng) for _ in range(trees)], drawn)

    @staticmethod
    def _tree(x: np.ndarray, limit: int, rng: np.random.Generator) -> tuple:
        feature, threshold, left, length = [-1], [0.0], [0], [0.0]
        todo = [(0, x, 0)]
        while todo:
            at, rows, depth = todo.pop()
            low, high = rows.min(axis=0), rows.max(axis=0)
            open_ = np.flatnonzero(high > low)
            if depth >= limit or len(rows) < 2 or not len(open_):
                length[at] = depth + mean_path(len(rows))
                continue
            f = int(rng.choice(open_))
            feature[at], threshold[at], left[at] = f, float(rng.uniform(low[f], high[f])), len(feature)
            for values, start in ((feature, -1), (threshold, 0.0), (left, 0), (length, 0.0)):
                values += [start, start]
            side = rows[:, f] <= threshold[at]
            todo += [(left[at], rows[side], depth + 1), (left[at] + 1, rows[~side], depth + 1)]
        return np.array(feature), np.array(threshold), np.array(left), np.array(length)

    def anomaly(self, x: np.ndarray) -> np.ndarray:
        """0 to 1: 2 ** -(mean path / mean path of a tree); near 1 for what is parted early."""
        total = np.zeros(len(x))
        every = np.arange(len(x))
        for feature, threshold, left, length in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                step = left[at] + (x[every, np.maximum(f, 0)] > threshold[at])
                at = np.where(inner, step, at)
            total += length[at]
        return 2.0 ** (-total / len(self.trees) / max(mean_path(self.drawn), 1e-9))


#: Bins of an anomaly from 0 to 1 in which labelled rows are counted.
BINS = 1 << 16


def calibrate(marked: DataFrame, lost: float = LOST) -> list[float]:
    """For each view a threshold that calls at most the share ``lost`` / views of the good rows anomalous, and most of the others.

    ``marked`` has anomalies (array) and label, a row for each labelled text. All of them count; only bins reach the driver.
    """
    each = marked.select((F.col("label") == 1).alias("good"), F.posexplode("anomalies").alias("view", "a"))
    bins = each.groupBy("view", F.floor(F.col("a") * BINS).alias("bin"), "good").agg(F.count("*").alias("n"), F.min("a").alias("low"), F.max("a").alias("high")).collect()
    out = []
    for view in range(len(VIEWS)):
        own = sorted((r for r in bins if r["view"] == view), key=lambda r: -r["bin"])
        good = [r for r in own if r["good"]]
        if not good:
            out.append(1.0)
            continue
        may_go, above = int(lost / len(VIEWS) * sum(r["n"] for r in good)), 0
        for r in good:
            above += r["n"]
            if above > may_go:
                break
        allowed = r["high"]
        caught = [x["low"] for x in own if not x["good"] and x["low"] > allowed]
        # Between the highest good row that must stay and the lowest bad row caught there is room: take the middle.
        near = any(not x["good"] and x["low"] <= allowed < x["high"] for x in own)
        out.append(allowed if near or not caught else (allowed + min(caught)) / 2)
    return out


def judge(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, counts, base_failed, anomaly, kept), one row for each row of ``docs`` (doc_id, text).

    base_failed: under 20 words, or over 30 % of the words in repeated windows. kept is false for
    those, and for texts whose anomaly in one of :data:`VIEWS` is above its calibrated threshold.
    anomaly is the largest of the views', with paths stretched so that each threshold is at 0.5. The
    forests are grown on at most ``sample`` labelled rows of both kinds that pass the base rules; the
    thresholds are calibrated on all of those.

    Null texts count as empty and fail. Null labels count for nothing; without labelled rows only
    the base rules judge. A null doc_id is judged like any other, repeated rows alike; an empty
    table gives an empty result.
    """
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = materialise(rule_statistics(docs).withColumn("base_failed", base), "rules")
    labelled = lambda df: df.where("NOT base_failed").join(label_of(labels, "quality"), "doc_id")
    seen = bounded(labelled(rows), F.col("doc_id"), sample)
    if not any(r["label"] == 1 for r in seen):
        return rows.withColumns({"anomaly": F.lit(0.0), "kept": ~F.col("base_failed")})
    x = features({c: np.array([r[c] for r in seen], float) for c in COUNTS})
    forests = [IsolationForest.grow(x[:, view]) for view in VIEWS]

    def run(batches):
        for batch in batches:
            x = features({c: batch[c].to_numpy() for c in COUNTS})
            found = np.column_stack([f.anomaly(x[:, view]) for f, view in zip(forests, VIEWS, strict=True)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(found), pa.list_(pa.float64()))], [*batch.schema.names, "anomalies"])

    scored = materialise(rows.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", anomalies array<double>"), "anomalies")
    thresholds = calibrate(labelled(scored))
    usual, stretched = ~F.col("base_failed"), []
    for view, most in enumerate(thresholds):
        own = F.get("anomalies", F.lit(view))
        usual &= own <= most
        stretched.append(F.pow(own, F.lit(float(np.log(0.5) / np.log(min(most, 1 - 1e-9))))))
    return scored.withColumns({"anomaly": F.greatest(*stretched), "kept": usual}).drop("anomalies")
