"""Personal data by base patterns and a character-level bidirectional LSTM with a CRF on top.

The base patterns find the four kinds exactly. Beside them a small tagger reads characters: an LSTM in
each direction, and CRF transitions between its tags. It is trained here, in numpy, from labelled
spans. A text is read in overlapping windows around whatever could belong to a span; each window is
decoded on its own, and a text's decoded spans are reconciled over all its windows at once, by the
set of spans without overlap that has the highest total score.

A span of any kind holds a digit or an ``@`` (:data:`TRIGGER`), and what is decoded must too. So a
window without one can add nothing, and text far from all of them is not read by the tagger.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, id_type, is_held_out, text_of

KINDS = ("email", "ip", "card", "phone")
#: What every span holds.
TRIGGER = "[0-9@]"
#: Characters of a window, from one window to the next, and read beside a trigger.
WIDTH, STEP, BESIDE = 80, 24, 24
#: Windows to learn from at most; units of each direction; updates; windows of an update and of a batch when reading.
SAMPLE, UNITS, UPDATES, BATCH, READ = 4000, 16, 260, 64, 256
#: Mean posterior chance of its tags from which on a decoded span counts.
SURE = 0.6
SEED = 11

_trigger = re.compile(TRIGGER)
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_dotted = re.compile(r"[0-9]+(?:\.[0-9]+)*").finditer
_card = re.compile(r"[0-9](?:[ -]?[0-9])+").finditer
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]").finditer
_digits = re.compile(r"[0-9]").findall
_number = re.compile(r"[0-9]+").findall
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: list[str]) -> bool:
    """The check digit of a card's number fits."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _byte(digits: str) -> bool:
    """The number is 255 at most, however many zeros lead it."""
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def _emails(text: str):
    """Spans of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from each @ so that no run of characters is read twice."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _domain(text, at + 1) if start < at else None
        if found:
            free = found.end()
            yield start, free
        at = text.find("@", max(free, at + 1))


def _ips(text: str):
    """Four numbers with dots between; a longer chain of them is cut in fours from its start."""
    for chain in _dotted(text):
        parts, at = chain.group().split("."), chain.start()
        for i in range(0, len(parts) - 3, 4):
            size = sum(map(len, parts[i : i + 4])) + 3
            if all(map(_byte, parts[i : i + 4])):
                yield at, at + size
            at += size + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start: the matches of the base patterns, without those that fail their check."""
    found = [(0, *x) for x in _emails(text)] if "@" in text else []
    found += [(1, *x) for x in _ips(text)]
    for m in _card(text):
        digits = _digits(m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append((2, m.start(), m.end()))
    if "+" in text:
        found += [(3, m.start(), m.end()) for m in _phone(text) if 8 <= len(_digits(m.group())) <= 15]
    return found


def plausible(kind: int, span: str) -> bool:
    """What the tagger decodes must be able to be of its kind: an @ between letters, four numbers up to 255, digits in the kind's number, a card's with its check digit."""
    digits = _digits(span)
    if kind == 0:
        name, _, host = span.partition("@")
        return bool(re.search(r"[A-Za-z0-9]", name)) and bool(re.search(r"[A-Za-z0-9]", host))
    if kind == 1:
        parts = _number(span)
        return len(parts) == 4 and all(map(_byte, parts))
    if kind == 2:
        return 16 <= len(digits) <= 19 and luhn(digits)
    return 8 <= len(digits) <= 15


# Tags: 0 outside, then for each kind its first and its further characters.
TAGS = 1 + 2 * len(KINDS)
CODES = 130  # ASCII, any other character, beyond the text
_NEVER = -1e4


def _allowed() -> tuple[np.ndarray, np.ndarray]:
    """Scores of impossible transitions and starts: a further character only follows one of its kind."""
    pair, first = np.zeros((TAGS, TAGS)), np.zeros(TAGS)
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        first[inside] = _NEVER
        pair[:, inside] = _NEVER
        pair[[inside - 1, inside], inside] = 0
    return pair, first


def encode(text: str) -> np.ndarray:
    """Codes of the characters (uint8)."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.minimum(points, 128).astype(np.uint8)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


@dataclass
class Tagger:
    """Weights: for both directions what a character adds to the gates, what the state does, and the output; CRF scores."""

    chars: np.ndarray  # 2, CODES, 4 UNITS
    state: np.ndarray  # 2, UNITS, 4 UNITS
    out: np.ndarray  # 2 UNITS + 1, TAGS
    pair: np.ndarray  # TAGS, TAGS
    first: np.ndarray  # TAGS

    @staticmethod
    def fresh(rng: np.random.Generator, units: int = UNITS) -> Tagger:
        chars = rng.normal(0, 0.3, (2, CODES, 4 * units))
        chars[:, :, units : 2 * units] += 1  # gates that remember, at first
        return Tagger(chars, rng.normal(0, 0.25, (2, units, 4 * units)), rng.normal(0, 0.2, (2 * units + 1, TAGS)), np.zeros((TAGS, TAGS)), np.zeros(TAGS))

    def weights(self) -> list[np.ndarray]:
        return [self.chars, self.state, self.out, self.pair, self.first]

    def single(self) -> Tagger:
        """The weights in single precision, for reading."""
        return Tagger(*[w.astype(np.float32) for w in self.weights()])

    def run(self, codes: np.ndarray, keep: bool = False):
        """Emission scores (windows, places, TAGS) of ``codes`` (windows, places); with ``keep`` what the backward pass needs."""
        n, width = codes.shape
        units = self.state.shape[1]
        both = np.stack([codes, codes[:, ::-1]])
        h = np.zeros((2, n, units), self.state.dtype)
        cell, states, kept = h.copy(), np.empty((width, 2, n, units), self.state.dtype), []
        for t in range(width):
            z = np.matmul(h, self.state)
            z[0] += self.chars[0, both[0, :, t]]
            z[1] += self.chars[1, both[1, :, t]]
            gates = _sigmoid(z[..., : 3 * units])
            i, f, o = gates[..., :units], gates[..., units : 2 * units], gates[..., 2 * units :]
            g = np.tanh(z[..., 3 * units :])
            before, cell = cell, f * cell + i * g
            tanh = np.tanh(cell)
            if keep:
                kept.append((h, i, f, o, g, before, tanh))
            h = o * tanh
            states[t] = h
        joint = np.concatenate([states[:, 0], states[::-1, 1], np.ones((width, n, 1), states.dtype)], axis=2)
        return (joint @ self.out).transpose(1, 0, 2), (both, kept, joint)

    def chain(self, emit: np.ndarray):
        """Posterior chances (windows, places, TAGS) of the tags, log partition, and the forward and backward scores, by the CRF."""
        pair, first = (a + b for a, b in zip((self.pair, self.first), _allowed(), strict=True))
        n, width, _ = emit.shape
        ahead, back = np.empty_like(emit, dtype=np.float64), np.zeros(emit.shape)
        ahead[:, 0] = first + emit[:, 0]
        for t in range(1, width):
            ahead[:, t] = _logsum(ahead[:, t - 1, :, None] + pair, 1) + emit[:, t]
        for t in range(width - 2, -1, -1):
            back[:, t] = _logsum(pair + (emit[:, t + 1] + back[:, t + 1])[:, None, :], 2)
        total = _logsum(ahead[:, -1], 1)
        return np.exp(ahead + back - total[:, None, None]), total, ahead, back

    def best(self, emit: np.ndarray) -> np.ndarray:
        """The best tag sequence of each window (Viterbi)."""
        pair, first = (a + b for a, b in zip((self.pair, self.first), _allowed(), strict=True))
        n, width, _ = emit.shape
        score, came = first + emit[:, 0], np.zeros((n, width, TAGS), np.int8)
        for t in range(1, width):
            step = score[:, :, None] + pair
            came[:, t] = step.argmax(1)
            score = step.max(1) + emit[:, t]
        tags = np.empty((n, width), np.int8)
        tags[:, -1] = score.argmax(1)
        for t in range(width - 1, 0, -1):
            tags[:, t - 1] = came[np.arange(n), t, tags[:, t]]
        return tags

    def loss(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean negative log likelihood of ``tags`` and its gradients, one for each of :meth:`weights`."""
        emit, (both, kept, joint) = self.run(codes, keep=True)
        chance, total, ahead, back = self.chain(emit)
        n, width, _ = emit.shape
        rows = np.arange(n)[:, None]
        pair, first = (a + b for a, b in zip((self.pair, self.first), _allowed(), strict=True))
        true = emit[rows, np.arange(width), tags].sum(1) + first[tags[:, 0]] + pair[tags[:, :-1], tags[:, 1:]].sum(1)
        d_emit = chance.copy()
        d_emit[rows, np.arange(width), tags] -= 1
        d_emit /= n
        moves = ahead[:, :-1, :, None] + pair + (emit[:, 1:] + back[:, 1:])[:, :, None, :] - total[:, None, None, None]
        d_pair = np.exp(moves).sum((0, 1))
        np.add.at(d_pair, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), -1)
        d_joint = d_emit.transpose(1, 0, 2)
        d_out = np.einsum("tnu,tnk->uk", joint, d_joint)
        d_state = d_joint @ self.out[:-1].T
        units = self.state.shape[1]
        d_h = np.stack([d_state[:, :, :units], d_state[::-1, :, units:]], axis=1)  # places in each direction's own order
        g_state, d_gates = np.zeros_like(self.state), np.empty((width, 2, n, 4 * units))
        later, d_cell = np.zeros((2, n, units)), np.zeros((2, n, units))
        for t in range(width - 1, -1, -1):
            h, i, f, o, g, before, tanh = kept[t]
            dh = d_h[t] + later
            dc = d_cell + dh * o * (1 - tanh**2)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tanh * o * (1 - o), dc * i * (1 - g**2)], axis=2)
            d_gates[t] = dz
            g_state += np.matmul(h.transpose(0, 2, 1), dz)
            later, d_cell = np.matmul(dz, self.state.transpose(0, 2, 1)), dc * f
        places = [np.equal.outer(np.arange(CODES), both[way].T.ravel()).astype(float) for way in (0, 1)]
        g_chars = np.stack([places[way] @ d_gates[:, way].reshape(width * n, -1) for way in (0, 1)])
        d_first = d_emit[:, 0].sum(0)
        return float((total - true).mean()), [g_chars, g_state, d_out, d_pair / n, d_first]


def train(windows: list[tuple[str, bytes]], updates: int = UPDATES, seed: int = SEED, units: int = UNITS) -> Tagger:
    """A tagger fitted by Adam to ``windows`` (text of WIDTH characters at most, a tag for each character), of which there must be one at least."""
    rng = np.random.default_rng(seed)
    tagger = Tagger.fresh(rng, units)
    codes = np.full((len(windows), WIDTH), CODES - 1, np.uint8)
    tags = np.zeros((len(windows), WIDTH), np.int64)
    for i, (text, own) in enumerate(windows):
        codes[i, : len(text)], tags[i, : len(text)] = encode(text), np.frombuffer(own, np.uint8)
    first, second = [np.zeros_like(w) for w in tagger.weights()], [np.zeros_like(w) for w in tagger.weights()]
    for step in range(1, updates + 1):
        at = rng.integers(0, len(windows), BATCH)
        _, grads = tagger.loss(codes[at], tags[at])
        norm = np.sqrt(sum((g**2).sum() for g in grads))
        rate = 0.03 * (1 - 0.9 * step / updates)
        for w, g, a, b in zip(tagger.weights(), grads, first, second, strict=True):
            g = g * min(1, 5 / (norm + 1e-9))
            a += 0.1 * (g - a)
            b += 0.01 * (g**2 - b)
            w -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return tagger


def tags_of(start: int, end: int, spans: list[tuple[int, int, int]]) -> bytes:
    """The tags of the characters from ``start`` to ``end``; where spans of two kinds overlap, the one listed first has them."""
    tags = np.zeros(end - start, np.uint8)
    for kind, a, b in reversed(spans):
        x, y = max(a, start), min(b, end)
        if x < y:
            tags[x - start : y - start] = 2 + 2 * kind
            if a >= start:
                tags[a - start] = 1 + 2 * kind
    return tags.tobytes()


def windows_of(text: str) -> list[tuple[int, int]]:
    """(start, end) of the windows that read a text: all characters within BESIDE of a trigger, in steps of STEP."""
    found: list[tuple[int, int]] = []
    from_, to = -1, -1
    regions = []
    for m in _trigger.finditer(text):
        if from_ < 0 or m.start() - BESIDE > to:
            if from_ >= 0:
                regions.append((from_, to))
            from_ = max(0, m.start() - BESIDE)
        to = min(len(text), m.end() + BESIDE)
    if from_ >= 0:
        regions.append((from_, to))
    for a, b in regions:
        at = a
        while True:
            found.append((at, min(at + WIDTH, len(text))))
            if at + WIDTH >= b:
                break
            at += STEP
    return found


def respelt(text: str, spans: list[tuple[int, int, int]], way: int) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with its spans written as the base patterns don't read them, and their places in it; without overlaps."""
    out, placed, at = [], [], 0
    for kind, a, b in sorted(spans, key=lambda s: s[1:]):
        if a < at:
            continue
        span = text[a:b]
        if kind == 0:
            new = (span.replace("@", " @ "), span.replace("@", "@ "), span.replace("@", " @"))[way % 3]
        elif kind == 1:
            new = (span.replace(".", " . "), span.replace(".", ". "), span.replace(".", "-"))[way % 3]
        elif kind == 2:
            d = "".join(_digits(span))
            new = (" - ", ".", "/")[way % 3].join(d[i : i + 4] for i in range(0, len(d), 4))
        else:
            d = span.lstrip("+")
            new = ("00" + d, d, "(+" + d.replace(" ", ") ", 1) if " " in d else "00 " + d)[way % 3]
        out.append(text[at:a] + new)
        start = sum(map(len, out)) - len(new)
        placed.append((kind, start, start + len(new)))
        at = b
    return "".join(out) + text[at:], placed


def _labelled(batches):
    """(window, tags) around the triggers of texts, with the spans given, or the base patterns', as they are and respelt."""
    for batch in batches:
        texts = batch["text"].to_pylist()
        given = batch["spans"].to_pylist() if "spans" in batch.schema.names else [None] * len(texts)
        found, tags = [], []
        for text, own in zip(texts, given, strict=True):
            spans = base_spans(text) if own is None else [(KINDS.index(s["kind"]), s["start"], s["end"]) for s in own if s["kind"] in KINDS]
            way = int.from_bytes(hashlib.md5(text.encode("utf-8", "replace")).digest()[:2], "big")
            for t, s in [(text, spans)] + ([respelt(text, spans, way), respelt(text, spans, way + 1)] if spans and own is None else []):
                for a, b in windows_of(t):
                    found.append(t[a:b])
                    tags.append(tags_of(a, b, s))
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(tags, pa.binary())], ["window", "tags"])


def learn(docs: DataFrame, labelled: DataFrame | None = None, sample: int = SAMPLE, updates: int = UPDATES) -> Tagger | None:
    """A tagger from ``labelled`` (text, spans: array of kind, start, end), judged spans; without them from the spans of the base
    patterns in ``docs`` that are not held out, as they are and respelt.

    At most ``sample`` windows, those of the smallest hashes, are learnt from; half of them hold a span where there are enough.
    None where there is no window to learn from.
    """
    rows = docs.where(~is_held_out()).select(text_of().alias("text")).where(F.col("text").rlike(TRIGGER)) if labelled is None else labelled.where("text IS NOT NULL").select("text", "spans")
    windows = rows.mapInArrow(_labelled, "window string, tags binary")
    spans = F.length(F.replace(F.hex("tags"), F.lit("0"))) > 0
    halves = [bounded(windows.where(w), F.col("window"), sample // 2) for w in (spans, ~spans)]
    seen = [(r["window"], bytes(r["tags"])) for half in halves for r in half]
    return train(seen, updates) if seen else None


def reconcile(spans: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """Of (kind, start, end, score) the set without overlap of the highest total score, by start; of equal spans the higher score counts."""
    best: dict[tuple[int, int, int], float] = {}
    for k, a, b, s in spans:
        best[k, a, b] = max(s, best.get((k, a, b), 0.0))
    order = sorted(best, key=lambda x: (x[2], x[1], x[0]))
    ends, total, back = [x[2] for x in order], [0.0], []
    for i, x in enumerate(order):
        before = bisect.bisect_right(ends, x[1], 0, i)
        take = total[before] + best[x]
        back.append((take > total[i], before))
        total.append(max(take, total[i]))
    chosen, i = [], len(order)
    while i:
        taken, before = back[i - 1]
        if taken:
            chosen.append(order[i - 1])
        i = before if taken else i - 1
    return sorted(chosen, key=lambda x: x[1])


def decode(tagger: Tagger, texts: list[str], sure: float = SURE) -> list[list[tuple[int, int, int, float]]]:
    """For each text the spans (kind, start, end, score) decoded in any of its windows that are plausible and sure.

    A span cut by a window's edge inside the text is left to the next window, which overlaps it; one longer than a window is decoded in parts by none.
    """
    at = [(i, a, b) for i, text in enumerate(texts) for a, b in windows_of(text)]
    found: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
    coded: tuple[int, np.ndarray | None] = (-1, None)
    for start in range(0, len(at), READ):
        part = at[start : start + READ]
        codes = np.full((len(part), WIDTH), CODES - 1, np.uint8)
        for j, (i, a, b) in enumerate(part):
            if coded[0] != i:
                coded = (i, encode(texts[i]))
            codes[j, : b - a] = coded[1][a:b]
        emit, _ = tagger.run(codes)
        tags = tagger.best(emit)
        busy = np.flatnonzero(tags.any(axis=1))
        if not len(busy):
            continue
        chance = tagger.chain(emit[busy])[0]
        for j, own in zip(busy, chance, strict=True):
            i, a, b = part[j]
            row = tags[j, : b - a]
            for x in np.flatnonzero(row % 2 == 1):
                y = x + 1
                while y < len(row) and row[y] == row[x] + 1:
                    y += 1
                if (x == 0 and a > 0) or (y == len(row) and b < len(texts[i])):
                    continue
                kind, span = int(row[x]) // 2, texts[i][a + x : a + y]
                x, y = x + len(span) - len(span.lstrip()), y - len(span) + len(span.rstrip())
                score = float(own[np.arange(x, y), row[x:y]].mean()) if x < y else 0.0
                if score >= sure and plausible(kind, span):
                    found[i].append((kind, a + int(x), a + int(y), score))
    return found


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def _finder(tagger: Tagger | None):
    tagger = tagger and tagger.single()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def found(batches):
        for batch in batches:
            column = batch["text"]
            base: list[list] = [[] for _ in range(len(column))]
            added: list[list] = [[] for _ in range(len(column))]
            busy = np.flatnonzero(pc.match_substring_regex(column, TRIGGER).to_numpy(zero_copy_only=False))
            texts = column.take(pa.array(busy)).to_pylist()
            for i, text in zip(busy, texts, strict=True):
                base[i] = base_spans(text)
            for i, spans in zip(busy, decode(tagger, texts) if tagger else [[]] * len(texts), strict=True):
                taken = sorted((a, b) for _, a, b in base[i])
                starts = [a for a, _ in taken]
                reach = np.maximum.accumulate([b for _, b in taken]) if taken else []
                free = [s for s in spans if not (k := bisect.bisect_left(starts, s[2])) or reach[k - 1] <= s[1]]
                added[i] = reconcile(free)
            counts = [pa.array([sum(s[0] == k for s in own) for own in base], pa.int64()) for k in range(len(KINDS))]
            whole = [[{"kind": KINDS[k], "start": a, "end": b, "base": own} for k, a, b, own in sorted([(*s, True) for s in x] + [(*s, False) for s in y])] for x, y in zip(base, added, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *counts, pa.array([_joined(s) for s in base]), pa.array(whole, span), pa.array([_joined(x + y) for x, y in zip(base, added, strict=True)])],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base", "found", "spans"],
            )

    return found


def find_pii(docs: DataFrame, labelled: DataFrame | None = None, tagger: Tagger | None = None, sample: int = SAMPLE, updates: int = UPDATES) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base, found, spans), a row for each row of ``docs`` (doc_id, text).

    n_… count the spans of the base patterns; base lists them as kind:start:end (code points, end exclusive), by kind, then
    start; spans lists all of them, found has them with whether they are the base patterns'. The tagger only adds spans that
    overlap no base one. A null text counts as empty and has none; repeated rows get equal results; a null doc_id is passed
    on; further columns are not; an empty table gives an empty result. Without ``tagger``, one is learnt (:func:`learn`); where
    nothing can be learnt from, none is and only the base patterns count.
    """
    tagger = learn(docs, labelled, sample, updates) if tagger is None else tagger
    schema = f"doc_id {id_type(docs)}, n_email long, n_ip long, n_card long, n_phone long, base string, found array<struct<kind: string, start: long, end: long, base: boolean>>, spans string"
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(_finder(tagger), schema)


def mask_pii(text: str, spans: list) -> str:
    """The text with each span (kind, start, end) replaced by its kind in angle brackets; of overlapping ones the first counts."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= at:
            out.append(f"{text[at : s['start']]}<{s['kind']}>")
            at = s["end"]
    return "".join(out) + text[at:]
