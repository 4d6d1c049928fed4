"""Quality classifier: a sparse ensemble of rules.

Statistics of each text are Spark columns. Boosted trees over a bounded sample of labelled rows give
candidate rules, the conjunctions along their paths; an L1-penalised logistic regression keeps few of
them with their weights; what is kept is compiled into one Spark column expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, bounded, count_words, is_held_out, label_of, materialise, text_of
from .trees import Node, fit_tree, predict

#: Labelled rows to learn from at most: those of the smallest hashes of their doc_id.
SAMPLE = 20_000
TREES, DEPTH, SEED = 40, 3, 2
ACCEPT = 0.3
#: Rows of the rules' matrix that are doubles at a time.
BLOCK = 256

#: One condition: feature, whether the value is at most the threshold, threshold.
Rule = tuple[tuple[int, bool, float], ...]


def statistics(text: Column) -> dict[str, Column]:
    """The statistics that rules may test; of empty texts q_distinct and q_lines, which count the empty word and line, are 1 and all others 0."""
    words = count_words(text)
    per_word = F.greatest(words, F.lit(1)).cast("double")
    chars = F.length(text)
    lines = F.split(text, "\n")

    def share(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)) / per_word

    return {
        "q_words": F.log1p(words.cast("double")),
        "q_word_chars": (chars - F.regexp_count(text, F.lit(f"[{SPACE}]"))) / per_word,
        "q_symbols": share(r"[#*$%&|<>@=_{}\[\]\\^~]"),
        "q_capitals": share(r"\p{Lu}{2,}"),
        "q_exclaims": share(r"[!?]{2,}"),
        "q_digits": share(r"[0-9]+"),
        "q_stops": share(r"[.!?](?=\s|$)"),
        "q_commas": share(r"[,;:](?=\s|$)"),
        "q_short": share(rf"(?<![^{SPACE}])[^{SPACE}]{{1,3}}(?![^{SPACE}])"),
        "q_distinct": F.size(F.array_distinct(F.split(text, f"[{SPACE}]+"))) / per_word,
        "q_lines": F.size(lines) / per_word,
        "q_same_lines": 1 - F.size(F.array_distinct(lines)) / F.size(lines),
    }


@dataclass
class RuleEnsemble:
    """A logistic model over rules: the weights of the rules that hold are added to the intercept."""

    names: list[str]
    intercept: float
    rules: list[tuple[Rule, float]]

    def score(self, at: str = "") -> str:
        """The chance of label 1 as SQL text, over statistics that are columns, or fields of ``at``."""

        def holds(rule: Rule) -> str:
            return " AND ".join(f"{at}{self.names[f]} {'<=' if low else '>'} {t!r}D" for f, low, t in rule)

        terms = [f"CASE WHEN {holds(rule)} THEN {w!r}D ELSE 0D END" for rule, w in self.rules]
        return f"1D / (1D + exp(-({' + '.join([f'{self.intercept!r}D', *terms])})))"


def paths(node: Node, before: Rule = ()) -> list[Rule]:
    """The conjunctions that lead to each node of a tree but its root; of conditions on one side of a column the tightest remains."""
    if node.feature < 0:
        return []
    out = []
    for low, child in ((True, node.left), (False, node.right)):
        rule = tuple(c for c in before if c[:2] != (node.feature, low)) + ((node.feature, low, node.threshold),)
        out += [tuple(sorted(rule)), *paths(child, rule)]
    return out


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, low, t in rule:
        out &= (x[:, f] <= t) == low
    return out


def boosted_rules(x: np.ndarray, y: np.ndarray, trees: int, depth: int, seed: int) -> list[Rule]:
    """Rules of trees that are fitted one after another to what those before leave unexplained."""
    rng = np.random.default_rng(seed)
    margin, rules = np.zeros(len(y)), {}
    for _ in range(trees):
        rows = rng.choice(len(y), min(len(y), max(200, len(y) // 3)), replace=False)
        left = y - 1 / (1 + np.exp(-margin))
        tree = fit_tree(x[rows], left[rows], depth, 5, rng, max(1, x.shape[1] // 2))
        margin += predict(tree, x)
        rules |= dict.fromkeys(paths(tree))
    return list(rules)


def _blocks(r: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Some rows after others, as doubles after a column of ones: the whole matrix stays at a byte a value."""
    for i in range(0, len(r), BLOCK):
        z = np.ones((len(r[i : i + BLOCK]), r.shape[1] + 1))
        z[:, 1:] = r[i : i + BLOCK]
        yield slice(i, i + BLOCK), z


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights of an L1-penalised logistic regression, by accelerated proximal steps."""
    n, k = r.shape
    gram = np.zeros((k + 1, k + 1))
    for _, z in _blocks(r):
        gram += z.T @ z
    step = 4 * n / (np.linalg.eigvalsh(gram)[-1] + 1e-9)
    w = v = np.zeros(k + 1)
    w[0] = v[0] = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    t = 1.0
    for _ in range(rounds):
        slope = np.zeros(k + 1)
        for at, z in _blocks(r):
            slope += (1 / (1 + np.exp(-(z @ v))) - y[at]) @ z
        u = v - step * (slope / n)
        u[1:] = np.sign(u[1:]) * np.maximum(np.abs(u[1:]) - step * penalty, 0)
        t_next = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, w, t = u + (t - 1) / t_next * (u - w), u, t_next
    return float(w[0]), w[1:]


def fit(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> RuleEnsemble:
    """The ensemble for a sample; the penalty is the one of the least loss on a fifth that is set aside."""
    if not len(y) or y.min() == y.max():  # nothing to tell apart: the smoothed share of label 1
        p = (y.sum() + 1) / (len(y) + 2)
        return RuleEnsemble(names, float(np.log(p / (1 - p))), [])
    rules = boosted_rules(x, y, trees, depth, seed)
    r = np.empty((len(y), len(rules)), bool)
    for i, rule in enumerate(rules):
        r[:, i] = _holds(rule, x)
    aside = np.arange(len(y)) % 5 == 0
    best = None
    for penalty in (0.01, 0.003, 0.001, 0.0003):
        b, w = lasso_logistic(r[~aside], y[~aside], penalty)
        m = np.concatenate([z @ np.append(b, w) for _, z in _blocks(r[aside])])
        loss = float(np.mean(np.logaddexp(0, m) - y[aside] * m)) if aside.any() else 0.0
        if best is None or loss < best[0] - 1e-4:
            best = (loss, penalty)
    b, w = lasso_logistic(r, y, best[1])
    return RuleEnsemble(names, b, [(rule, float(c)) for rule, c in zip(rules, w, strict=True) if c])


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each row of ``docs`` (doc_id, text).

    The model learns from at most ``sample`` labelled rows, none of them held out; only statistics of
    the text are inputs. Null texts count as empty, and empty texts are scored by their statistics
    like any others. Labels that are null, or of no document, count for nothing; of contradicting ones the
    majority counts. Without labels of both kinds every score is the smoothed share of label 1. A
    null doc_id is scored like any other; repeated rows are scored alike; an empty table gives an
    empty result.
    """
    stats = statistics(F.col("text"))
    rows = materialise(docs.select("doc_id", text_of().alias("text")).select("doc_id", *[c.cast("double").alias(k) for k, c in stats.items()]), "statistics")
    model = learn(rows, labels, sample)
    score = F.expr(model.score())
    return rows.select("doc_id", is_held_out().alias("held_out"), score.alias("score"), (score >= ACCEPT).cast("int").alias("predicted"))


def learn(rows: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> RuleEnsemble:
    """The ensemble learnt from the statistics of labelled rows that are not held out."""
    names = [c for c in rows.columns if c.startswith("q_")]
    seen = bounded(rows.where(~is_held_out()).join(label_of(labels, "quality"), "doc_id"), F.col("doc_id"), sample)
    x = np.array([[r[c] for c in names] for r in seen], float).reshape(len(seen), len(names))
    return fit(x, np.array([r["label"] for r in seen], float), names)


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts (score of at least 0.3), unchanged."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = F.coalesce(F.col("row.text"), F.lit(""))
    stats = [c.cast("double").alias(k) for k, c in statistics(text).items()]
    model = learn(packed.select(F.col("row.doc_id").alias("doc_id"), *stats), labels, sample)
    # A filter would move below the statistics and work each out again for every rule; one on what an outer explode gives stays above.
    kept = packed.select("row", *stats).select(F.expr(f"CASE WHEN {model.score()} >= {ACCEPT}D THEN array(row) END").alias("kept"))
    return kept.select(F.explode_outer("kept").alias("row")).where("row IS NOT NULL").select("row.*")
