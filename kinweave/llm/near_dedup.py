"""N-gram Jaccard join with Bayesian candidate pruning.

Equal texts are folded into classes first. Each class has a MinHash signature over its word
shingles; classes that agree in a whole band of it are candidates. Every band's bucket is led by its
smallest class, and classes meet in the groups of their leaders, so that a pair is looked at once, in
the group of the smallest leader that both have. There the signatures are compared step by step. With
m of n values equal, the similarity has, under a uniform prior, a Beta(m + 1, n - m + 1) posterior; a
pair whose posterior chance of reaching the threshold is below the tolerance is dropped at once.
What is left is verified on the shingles themselves. Large groups are cut into blocks that meet in
pairs, so that no task holds a whole group, and only counts and spanning forests leave a task, never
all pairs of a group.
"""

from __future__ import annotations

import math
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, id_type, materialise, text_of

#: Words of a shingle; the threshold; values of a signature and of a band; values compared in a step.
SHINGLE, THRESHOLD = 5, Fraction(4, 5)
HASHES, ROWS, STEP = 160, 5, 32
#: Posterior chance below which a pair is dropped.
TOLERANCE = 1e-9
#: Classes, and bytes of text, in one block of a group; pairs of two blocks that are compared at a time.
BLOCK_ROWS, BLOCK_BYTES, PAIRS = 1000, 4 << 20, 1 << 15

_words = re.compile(WORD).findall


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _WordHash(dict):
    """Word to 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_hashes = _WordHash()


def shingle_hashes(text: str, n: int = SHINGLE) -> np.ndarray:
    """A 64-bit hash of each shingle of n words; a text of fewer words, but one at least, is one shingle."""
    words = _words(text)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    width = min(n, len(words))
    if not width:
        return h
    out = np.zeros(len(h) - width + 1, np.uint64)
    for i in range(width):
        out = _mixed(out ^ h[i : len(h) - width + 1 + i]) + np.uint64(i)
    return _mixed(out ^ np.uint64(width))


def _family(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(0, 2**63, count, np.uint64), rng.integers(0, 2**63, count, np.uint64) * np.uint64(2) + np.uint64(1)


def signature(hashes: np.ndarray, flips: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """MinHash values (32 bits each) of a set of 64-bit hashes, which must not be empty."""
    least = np.full(len(flips), 2**32 - 1, np.uint32)
    for at in range(0, len(hashes), 2048):
        part = hashes[at : at + 2048, None] ^ flips
        part *= factors
        np.minimum(least, (part >> np.uint64(32)).astype(np.uint32).min(axis=0), out=least)
    return least


def _sign(batches):
    flips, factors = _family(HASHES)
    for batch in batches:
        found = []
        for text in batch["text"].to_pylist():
            h = shingle_hashes(text)
            found.append(signature(h, flips, factors).tobytes() if len(h) else None)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["key"], pa.array(found, pa.binary())], ["doc_id", "key", "sig"])


def _bands(batches):
    """(band: a hash of the band's number and values, cid) for each band of each class."""
    bands = HASHES // ROWS
    for batch in batches:
        sigs = np.frombuffer(b"".join(batch["sig"].to_pylist()), np.uint32).reshape(-1, bands, ROWS).astype(np.uint64)
        keys = np.broadcast_to(np.arange(bands, dtype=np.uint64), sigs.shape[:2]).copy()
        for i in range(ROWS):
            keys = _mixed(keys ^ sigs[:, :, i]) + np.uint64(i)
        cids = np.repeat(batch["cid"].to_numpy(zero_copy_only=False), bands)
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(cids)], ["band", "cid"])


def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """The fewest equal values of n with which a pair stays: the posterior chance of the threshold is at least the tolerance.

    The Beta(m + 1, n - m + 1) chance of at least t is that of at most m successes in n + 1 trials of chance t.
    """
    chance = 0.0
    for m in range(n + 1):
        chance += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if chance >= tolerance:
            return m
    return n + 1


def _shingle_set(text: str, n: int, seen: dict) -> frozenset:
    """The text's shingles as numbers that are exact among the texts that share ``seen``."""
    words = _words(text)
    width = min(n, len(words))
    return frozenset(seen.setdefault(s, len(seen)) for s in zip(*(words[i:] for i in range(width)), strict=False))


def _compared(sigs: np.ndarray, x: np.ndarray, y: np.ndarray, m: np.ndarray, steps: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """The pairs that are left after all steps; ``m`` has the equal values of the first one."""
    for n, least in steps[1:]:
        m = m + (sigs[x, n - STEP : n] == sigs[y, n - STEP : n]).sum(axis=1)
        keep = m >= least
        m, x, y = m[keep], x[keep], y[keep]
    return x.tolist(), y.tolist()


def _verifier(threshold: Fraction, tolerance: float, shingle: int):
    steps = [(n, least_matches(n, float(threshold), tolerance)) for n in range(STEP, HASHES + 1, STEP)]

    def verified(table: pa.Table) -> pa.Table:
        """The rows of one or two blocks of a leader's group to each class's links and its root in a spanning forest."""
        leader, left, right = (table[c][0].as_py() for c in ("leader", "left", "right"))
        cids, blocks, sizes = (table[c].to_numpy() for c in ("cid", "block", "docs"))
        order = np.lexsort((cids, blocks))  # rows come in no fixed order
        order = order[np.concatenate(([True], cids[order][1:] != cids[order][:-1]))]  # copies of a class's row
        table, cids, blocks, sizes = table.take(pa.array(order)), cids[order], blocks[order], sizes[order]
        sigs = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint32).reshape(len(cids), HASHES)
        first, second = np.flatnonzero(blocks == left), np.flatnonzero(blocks == right)
        matches = np.zeros((len(first), len(second)), np.uint8)
        for i in range(STEP):
            matches += sigs[first, i][:, None] == sigs[second, i][None, :]
        stays = matches >= steps[0][1]
        if left == right:
            stays = np.triu(stays, 1)
        x, y = np.nonzero(stays)
        lower = [frozenset(v for v in ls if v < leader) for ls in table["leaders"].to_pylist()]
        texts, seen, sets = table["text"], {}, {}
        num, den = threshold.numerator, threshold.denominator
        links, roots = np.zeros(len(cids), np.int64), list(range(len(cids)))

        def shingles(i: int) -> frozenset:
            if i not in sets:
                sets[i] = _shingle_set(texts[i].as_py(), shingle, seen)
            return sets[i]

        def root(i: int) -> int:
            while roots[i] != i:
                roots[i] = i = roots[roots[i]]
            return i

        for start in range(0, len(x), PAIRS):
            i_, j_ = x[start : start + PAIRS], y[start : start + PAIRS]
            for i, j in zip(*_compared(sigs, first[i_], second[j_], matches[i_, j_].astype(np.int64), steps), strict=True):
                if not lower[i].isdisjoint(lower[j]):
                    continue  # the pair is looked at in the group of a smaller leader
                a, b = shingles(i), shingles(j)
                both = len(a & b)
                if both * den >= num * (len(a) + len(b) - both):
                    links[i] += sizes[j]
                    links[j] += sizes[i]
                    p, q = sorted((root(i), root(j)), key=cids.__getitem__)
                    roots[q] = p
        at = [i for i in range(len(cids)) if links[i]]
        return pa.table({"cid": pa.array(cids[at], pa.int64()), "links": pa.array(links[at], pa.int64()), "root": pa.array([int(cids[root(i)]) for i in at], pa.int64())})

    return verified


def components(edges: DataFrame) -> DataFrame:
    """(cid, root) of all ends of ``edges`` (cid, root): the smallest end of each connected component.

    Alternates large-star and small-star steps, each written to the shared folder, until nothing changes.
    """
    pairs = materialise(edges.where("cid != root").select(F.greatest("cid", "root").alias("a"), F.least("cid", "root").alias("b")).distinct(), "edges")
    while True:
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select("b", "a"))
        near = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(near, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        small = materialise(small, "edges")
        # A star for each component: every end points to one root, which points to none.
        done = small.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").isEmpty() and small.join(small.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty()
        pairs = small
        if done:
            roots = pairs.select(F.col("b").alias("cid")).distinct().select("cid", F.col("cid").alias("root"))
            return pairs.select(F.col("a").alias("cid"), F.col("b").alias("root")).union(roots)


def text_key(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def jaccard_classes(docs: DataFrame, threshold: Fraction = THRESHOLD, tolerance: float = TOLERANCE, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, key, class_id, copies, n_links), one row for each row of ``docs`` (doc_id, text).

    Two rows are linked if the Jaccard similarity of their sets of five-word shingles is at least the
    threshold; a text of one to four words is one shingle. n_links counts a row's links, the other
    copies of its text among them; copies is the number of rows of its text; key is the SHA-256 of
    the text. class_id is the smallest doc_id of the connected component (null if it has none).

    Null texts count as empty. Texts without a word have no shingles and link to nothing but the
    copies of the very same text. Repeated rows are copies. An empty table gives an empty result.
    """
    rows = docs.select("doc_id", text_of().alias("text")).withColumn("key", text_key(F.col("text")))
    signed = materialise(rows.mapInArrow(_sign, f"doc_id {id_type(docs)}, key binary, sig binary"), "signed")
    grouped = signed.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig"), F.count("*").alias("docs"))
    classes = materialise(grouped.withColumn("cid", F.monotonically_increasing_id()), "classes")

    bands = classes.where("sig IS NOT NULL").select("cid", "sig").mapInArrow(_bands, "band long, cid long")
    shared = bands.groupBy("band").agg(F.min("cid").alias("leader"), F.max("cid").alias("last")).where("leader < last").drop("last")
    led = bands.join(shared, "band").groupBy("cid").agg(F.collect_set("leader").alias("leaders"))
    led = materialise(led.join(classes.select("cid", "key", "sig", "docs", F.col("doc_id").alias("own")), "cid"), "led")

    # One row of each text that has a leader comes along with its text, once for each leader and block to meet.
    texts = rows.join(led, (rows["key"] == led["key"]) & rows["doc_id"].eqNullSafe(led["own"]))
    texts = materialise(texts.select("cid", "leaders", "sig", "docs", "text", F.octet_length("text").alias("bytes")), "candidates")
    groups = texts.select(F.explode("leaders").alias("leader"), "bytes").groupBy("leader").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    cuts = groups.select("leader", F.greatest(F.ceil(F.col("n") / block_rows), F.ceil(F.col("bytes") / block_bytes)).alias("cuts"))
    met = texts.drop("bytes").withColumn("leader", F.explode("leaders")).join(cuts, "leader")
    met = met.withColumn("block", F.pmod(F.xxhash64("cid"), "cuts")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)))
    met = met.select("leader", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "block", "cid", "docs", "leaders", "sig", "text")
    found = met.groupBy("leader", "left", "right").applyInArrow(_verifier(threshold, tolerance, SHINGLE), "cid long, links long, root long")
    found = materialise(found, "links")

    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = components(found.select("cid", "root"))
    linked = classes.select("cid", "key", "docs", "doc_id").join(links, "cid", "left").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    ids = linked.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    linked = linked.join(ids, "root").select("key", "class_id", F.col("docs").alias("copies"), (F.col("docs") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return signed.select("doc_id", "key").join(linked, "key").select("doc_id", "key", "class_id", "copies", "n_links")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class of near copies: that of the smallest doc_id.

    Of repeated rows (same doc_id and text) one stays. Of classes without any doc_id one row of each text stays.
    """
    found = jaccard_classes(docs).where(F.col("doc_id").eqNullSafe(F.col("class_id")))
    stays = materialise(found.groupBy("key", F.col("class_id").alias("stay_id")).agg(F.count("*").alias("rows")), "stays")
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("key", text_key(F.coalesce(F.col("row.text"), F.lit(""))))
    met = (marked["key"] == stays["key"]) & F.col("row.doc_id").eqNullSafe(F.col("stay_id"))
    if stays.where("rows > 1").isEmpty():
        return marked.join(stays, met, "left_semi").select("row.*")
    # Repeated rows are equal in text and number; the first of each task is kept before they meet.
    kept = marked.join(stays.withColumnRenamed("key", "of"), (marked["key"] == F.col("of")) & F.col("row.doc_id").eqNullSafe(F.col("stay_id")))
    again = kept.where("rows > 1").groupBy("of", "stay_id").agg(F.first("row").alias("row"))
    return kept.where("rows = 1").select("row").union(again.select("row")).select("row.*")
