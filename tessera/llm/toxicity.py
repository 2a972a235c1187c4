"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

Kernel.  Strings are compared by their common subsequences of ``P`` letters within ``SPAN`` places, each weighted
by ``DECAY`` to the power of the length it spans, so gaps and inserted characters cost
weight but do not hide an insult.  What is no letter is skipped; the start of a word counts as one more letter.
A string's norm is that of a string of its length whose subsequences all differ, so it depends on the length alone.

Training.  Sentences of labelled documents inherit the document's label.  The rows of the machine are the spans of
a sentence: each word and each two neighbouring words, as one string.  A toxic sentence is toxic by some of its spans, so the
spans that represent a toxic document are chosen anew after every fit (multiple-instance learning), and the clean sentences' spans that
score highest are added as hard negatives.  The machine is linear in the
Nystroem features ``k(x, Z) K_ZZ^(-1/2)`` of the landmarks ``Z``.  A logistic curve is calibrated on documents kept out of the fit.

Scoring.  As the kernel is an inner product over subsequences, the fitted sum over landmarks folds
into one weight per subsequence, exactly.  All letters of a batch of texts stand in one array; a subsequence's weight is looked up
once, and added to the word it lies in, or to the two that it joins, so the margins of all spans come from sums over words.  The document's score is the
calibrated probability of its highest margin.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fold, map_batches

P, DECAY, SPAN = 3, 0.6, 8
PIECE = 10  # letters after which a longer word goes on as a neighbouring word
SPACED = 3  # so many single letters one after another are one word
#: Bounds of the fit: labelled documents of each label, landmarks, clean spans as negatives.
SAMPLE_PER_LABEL = 1500
LANDMARKS = 96
NEGATIVES = 8000
ROUNDS = 4
#: One in so many sampled documents is kept for the calibration; one in so many pairs of words of clean documents is a possible negative.
HELD, PAIRS = 5, 4
#: The first suspects: spans whose lift is at least this share of the greatest.
LIFT = 0.15
#: Characters whose letters are scored together.
CHUNK = 1 << 18

#: a to z, places for other letters by their code point, and one for the start of a word.
_CODES, _START = 64, 63
#: In ``letters``: the end of a sentence, and the start of a further piece of a long word (not a letter of the kernel).
_END, _MORE = 64, 65
#: Added to k(x, x) before normalising, so that words of hardly any subsequences resemble nothing.
DAMPING = 0.05

_KNOWN = 0x3000
_LETTER = np.array([chr(c).isalpha() for c in range(_KNOWN)])
_SPACE = np.array([chr(c).isspace() for c in range(_KNOWN)])
_CODE = np.array([c - 97 if 97 <= c < 123 else 26 + c % (_CODES - 27) for c in range(_KNOWN)], np.int32)
_STOPS = np.array([c == 10 for c in range(_KNOWN)])
_MARKS = np.array([chr(c) in ".!?" for c in range(_KNOWN)])

#: Norm of a string by its length.
_NORM = np.sqrt(np.array([sum(max(0, n - d) * (d - 1) * DECAY ** (2 * (d + 1)) for d in range(2, SPAN)) for n in range(4 * PIECE + 8)]) + DAMPING)


@dataclass(frozen=True)
class Letters:
    """The letters of texts in one array, each word after its start mark."""

    codes: np.ndarray  # per place: letter or start
    word: np.ndarray  # per place: its word
    first: np.ndarray  # per word: its first place (the start mark, or the first letter of a further piece)
    more: np.ndarray  # per word: whether it goes on with a longer word
    linked: np.ndarray  # per word: whether the next word is of the same sentence
    text: np.ndarray  # per word: its text


def letters(texts: list[str]) -> Letters:
    """Words are split at white space; runs of ``SPACED`` single letters or more are one word, and longer words go on every ``PIECE`` letters."""
    lower = [t.lower() for t in texts]
    u = np.frombuffer("\n".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in lower])
    low = np.minimum(u, _KNOWN - 1)
    beyond = u >= _KNOWN
    is_letter, is_space = _LETTER[low] | beyond, _SPACE[low] & ~beyond
    after = np.append(is_space[1:], True)
    sentence = np.cumsum((_STOPS[low] & ~beyond) | (_MARKS[low] & ~beyond & after))
    at = np.flatnonzero(is_letter)
    if not len(at):
        none = np.zeros(0, np.int64)
        return Letters(none.astype(np.int32), none, none, none.astype(bool), none.astype(bool), none)
    code = np.where(beyond[at], 26 + u[at] % (_CODES - 27), _CODE[low[at]]).astype(np.int32)
    token = np.cumsum(is_space)[at]
    new = np.concatenate(([True], token[1:] != token[:-1]))
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(at)))
    text = np.searchsorted(ends, at[begin], "right")
    # runs of single letters
    one = size == 1
    follows = np.concatenate(([False], one[1:] & one[:-1] & (text[1:] == text[:-1])))
    run = np.cumsum(~follows)
    joined = follows & (np.bincount(run)[run] >= SPACED)
    begin, text = begin[~joined], text[~joined]
    # pieces of long words
    size = np.diff(np.append(begin, len(at)))
    parts = -(-size // PIECE)
    of = np.repeat(np.arange(len(begin)), parts)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin, text, more = begin[of] + nth * PIECE, text[of], nth > 0
    said = sentence[at[begin]]
    linked = np.append((text[1:] == text[:-1]) & (said[1:] == said[:-1]), False)
    linked[:-1] |= more[1:]
    # a start mark before each word that is none of these pieces
    marks = np.cumsum(~more)
    size = np.diff(np.append(begin, len(at)))
    word = np.repeat(np.arange(len(begin)), size)
    codes = np.full(len(at) + int(marks[-1]), _START, np.int32)
    codes[np.arange(len(at)) + marks[word]] = code
    first = begin + marks - ~more
    return Letters(codes, np.repeat(np.arange(len(first)), np.diff(np.append(first, len(codes)))), first, more, linked, text)


def span_margins(x: Letters, weights: np.ndarray) -> np.ndarray:
    """The highest kernel sum (without bias) over spans that begin at each word: the word itself, or with the next one."""
    n, words = len(x.codes), len(x.first)
    own, joint = np.zeros(words), np.zeros(words)
    high = x.codes * (_CODES * _CODES)
    middle = x.codes * _CODES
    pairs = [None] + [high[: max(0, n - d)] + middle[d:] for d in range(1, SPAN - 1)]
    for d in range(2, SPAN):
        if n <= d:
            break
        last = x.codes[d:]
        total = np.zeros(n - d, np.float32)
        for e in range(1, d):
            total += weights[pairs[e][: n - d] + last]
        total *= np.float32(DECAY ** (d + 1))
        here, step = x.word[: n - d], x.word[d:] - x.word[: n - d]
        own += np.bincount(here, np.where(step == 0, total, 0), words)
        joint += np.bincount(here, np.where(step == 1, total, 0), words)
    size = np.diff(np.append(x.first, n))
    out = own / _NORM[size]
    if words > 1:
        at = np.flatnonzero(x.linked[:-1])
        both = (own[at] + joint[at] + own[at + 1]) / _NORM[size[at] + size[at + 1]]
        out[at] = np.maximum(out[at], both)
    return out


def highest(texts: list[str | None], weights: np.ndarray) -> np.ndarray:
    """Each text's highest kernel sum over its spans; 0 for a text without any."""
    out = np.zeros(len(texts))
    held: list[int] = []
    size = 0

    def settle() -> None:
        x = letters([texts[i] for i in held])
        if len(x.first):
            s = span_margins(x, weights)
            cut = np.flatnonzero(np.concatenate(([True], x.text[1:] != x.text[:-1])))
            out[np.array(held)[x.text[cut]]] = np.maximum.reduceat(s, cut)

    for i, t in enumerate(texts):
        if t:
            held.append(i)
            size += len(t)
        if size >= CHUNK:
            settle()
            held, size = [], 0
    if held:
        settle()
    return out


def spelled(text: str | None) -> bytes:
    """A text's letters for the fit: codes, start marks, and marks where sentences end and long words go on."""
    x = letters([text or ""])
    out, codes = [], x.codes.astype(np.uint8).tobytes()
    edge = np.append(x.first, len(codes)).tolist()
    for w, (more, linked) in enumerate(zip(x.more.tolist(), x.linked.tolist())):
        out.append(bytes([_MORE] * more) + codes[edge[w] : edge[w + 1]] + bytes([_END] * (not linked)))
    return b"".join(out)


def spans(doc: bytes) -> set[bytes]:
    """The spans of the sentences of a spelled text: words, and two neighbouring ones."""
    out: set[bytes] = set()
    for sentence in doc.split(bytes([_END])):
        words: list[bytes] = []
        for k, part in enumerate(sentence.split(bytes([_START]))):
            for j, piece in enumerate(part.split(bytes([_MORE]))):
                if piece:
                    words.append(bytes([_START]) + piece if j == 0 and k else piece)
        out.update(words)
        out.update(a + b for a, b in zip(words, words[1:]))
    return out


def _triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    at = [(i, i + e, i + d) for i in range(n) for d in range(2, SPAN) for e in range(1, d) if i + d < n]
    at = np.array(at, np.int64).reshape(-1, P)
    return at, DECAY ** (at[:, 2] - at[:, 0] + 1.0)


def subsequences(strings: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, float]]:
    """For strings of one length at a time: their places, each subsequence's code, the weights, and the norm."""
    by_size: dict[int, list[int]] = {}
    for i, s in enumerate(strings):
        by_size.setdefault(len(s), []).append(i)
    for n, places in by_size.items():
        at, weight = _triples(n)
        if not len(at):
            continue
        for lo in range(0, len(places), 200):
            mine = places[lo : lo + 200]
            x = np.frombuffer(b"".join(strings[i] for i in mine), np.uint8).reshape(len(mine), n).astype(np.int64)
            yield np.array(mine), (x[:, at[:, 0]] * _CODES + x[:, at[:, 1]]) * _CODES + x[:, at[:, 2]], weight, float(_NORM[n])


class Landmarks:
    """Explicit normalised features of a few strings, on the subsequences that they have."""

    def __init__(self, strings: list[bytes]) -> None:
        rows = [(i, c, w / norm) for at, code, w, norm in subsequences(strings) for i, c in zip(at, code)]
        held = np.unique(np.concatenate([c for _, c, _ in rows])) if rows else np.zeros(0, np.int64)
        self.column = np.full(_CODES**P, len(held), np.int64)
        self.column[held] = np.arange(len(held))
        self.codes = held
        self.features = np.zeros((len(held) + 1, len(strings)))  # the last row is that of all other subsequences
        for i, c, w in rows:
            np.add.at(self.features[:, i], self.column[c], w)

    def against(self, strings: list[bytes]) -> np.ndarray:
        """Kernel of each string with each landmark."""
        out = np.zeros((len(strings), self.features.shape[1]))
        for at, code, weight, norm in subsequences(strings):
            out[at] = np.einsum("stl,t->sl", self.features[self.column[code]], weight) / norm
        return out

    def folded(self, alpha: np.ndarray) -> np.ndarray:
        """One weight per subsequence: that of the sum of the landmarks' features by ``alpha``."""
        out = np.zeros(_CODES**P, np.float32)
        out[self.codes] = self.features[:-1] @ alpha
        return out


@dataclass(frozen=True)
class ToxicityModel:
    weights: np.ndarray  # per subsequence code
    bias: float
    slope: float
    shift: float
    landmarks: list[bytes]
    alpha: np.ndarray  # of each landmark

    def margins(self, strings: list[bytes]) -> np.ndarray:
        out = np.zeros(len(strings))
        for at, code, weight, norm in subsequences(strings):
            out[at] = (self.weights[code] * weight).sum(axis=1) / norm
        return out + self.bias

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        return self.curve(highest(texts, self.weights) + self.bias)

    def curve(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40)))


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 20.0, steps: int = 40) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Newton steps on the active set."""
    a = np.concatenate((x, np.ones((len(x), 1))), axis=1)
    w = np.zeros(a.shape[1])
    ridge = np.eye(a.shape[1])
    ridge[-1, -1] = 1e-4
    for _ in range(steps):
        active = y * (a @ w) < 1
        s = a[active] * (c * weight[active])[:, None]
        new = np.linalg.solve(ridge + s.T @ a[active], s.T @ y[active])
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return w[:-1], float(w[-1])


def _calibrate(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic slope and shift by damped Newton steps, with smoothed targets."""
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -40, 40)))
        g = np.array([((p - t) * m).sum(), (p - t).sum()])
        v = p * (1 - p) + 1e-6
        h = np.array([[(v * m * m).sum() + 1e-3, (v * m).sum()], [(v * m).sum(), v.sum() + 1e-3]])
        d = np.linalg.solve(h, g)
        a, b = a - 0.7 * d[0], b - 0.7 * d[1]
    return float(a), float(b)


def train(docs: list[bytes], labels: list[int], landmarks: int = LANDMARKS) -> ToxicityModel:
    """``docs``: spelled texts.  One in ``HELD`` of each label serves the calibration alone."""
    flat = ToxicityModel(np.zeros(_CODES**P, np.float32), -1.0, 1.0, -4.0, [], np.zeros(0))
    y = np.array(labels)
    held = np.zeros(len(y), bool)
    for label in (0, 1):
        mine = np.flatnonzero(y == label)
        if len(mine) >= 5 * HELD:
            held[mine[::HELD]] = True
    bags = [spans(d) for d, out, label in zip(docs, held, labels) if not out and label]
    if not bags or not (y[~held] == 0).any():
        return flat
    bad, good = Counter(), Counter()
    for bag in bags:
        bad.update(bag)
    negatives: set[bytes] = set()
    n_good = 0
    for d, out, label in zip(docs, held, labels):
        if out or label:
            continue
        n_good += 1
        mine = spans(d)
        good.update(s for s in mine if s in bad or s.rfind(_START) <= 0)
        # of pairs of words a part, by their own bytes
        negatives.update(s for s in mine if s.rfind(_START) > 0 and sum(s) % PAIRS == 0)
    n_bad = len(bags)
    telling = lambda s: bad[s] / n_bad > 4 * (good[s] + 0.5) / n_good

    def lift(s: bytes) -> float:
        return np.log((bad[s] + 0.5) / (n_bad + 1) * (n_good + 1) / (good[s] + 0.5)) * np.sqrt(bad[s])

    ranked = sorted(bad, key=lambda s: (-lift(s), s))
    least = LIFT * lift(ranked[0]) if ranked else 0.0
    suspects = [s for s in ranked[: 8 * landmarks] if bad[s] >= 3 and telling(s) and len(s) > P and lift(s) >= least]
    suspects = suspects or [s for s in ranked[:8] if len(s) > P]
    sure = set(suspects)
    common = [s for s, _ in sorted(good.items(), key=lambda x: (-x[1], x[0])) if len(s) > P and s not in sure]
    if not suspects or not common:
        return flat
    half = landmarks * 2 // 3
    z = list(dict.fromkeys(suspects[:half] + common[: landmarks - min(half, len(suspects))]))
    phi = Landmarks(z)
    value, vector = np.linalg.eigh(phi.features.T @ phi.features)
    keep = value > 1e-8
    root = vector[:, keep] / np.sqrt(value[keep])

    rng = np.random.default_rng(42)
    pairs = sorted(s for s in negatives if len(s) > P and s not in bad)
    clean = common[: NEGATIVES // 2] + [pairs[i] for i in sorted(rng.choice(len(pairs), min(len(pairs), NEGATIVES // 2), replace=False).tolist())]
    used = set(clean)
    rest = [s for s in [*common, *pairs] if s not in used][: 20 * NEGATIVES]
    clean_k = phi.against(clean) @ root
    chosen = set(suspects)
    model = flat
    for step in range(ROUNDS):
        positive = sorted(chosen)
        # each also with one letter put in, at a third of the weight
        gapped = [s[: (k := int(rng.integers(1, len(s))))] + bytes([int(rng.integers(26))]) + s[k:] for s in positive]
        share = np.array([bad[s] for s in positive] + [bad[s] / 3 for s in positive], float)
        x = np.concatenate((phi.against(positive + gapped) @ root, clean_k))
        target = np.concatenate((np.ones(2 * len(positive)), -np.ones(len(clean_k))))
        weight = np.concatenate((share / share.sum(), np.full(len(clean_k), 1 / len(clean_k))))
        w, b = _svm(x, target, weight * len(x) / 2)
        alpha = root @ w
        model = ToxicityModel(phi.folded(alpha), b, 1.0, 0.0, z, alpha)
        if step + 1 == ROUNDS:
            break
        if rest:
            m = model.margins(rest)
            top = np.argsort(-m, kind="stable")[:2000].tolist()
            more, took = [rest[i] for i in top], set(top)
            rest = [s for i, s in enumerate(rest) if i not in took]
            clean_k = np.concatenate((clean_k, phi.against(more) @ root))
        # each toxic document is represented by its best span that clean documents lack, and other sure ones
        telltale = sorted(s for s in bad if len(s) > P and (not good[s] or s in sure))
        score = dict(zip(telltale, model.margins(telltale).tolist()))
        chosen = set()
        for bag in bags:
            have = [s for s in bag if s in score]
            if have:
                top = max(have, key=lambda s: (score[s], s))
                if score[top] > 0:
                    chosen.add(top)
                chosen.update(s for s in have if score[s] > 1)
        chosen = chosen or set(suspects)
    look = held if held.any() else ~held
    some = [spans(d) for d, out in zip(docs, look) if out]
    m = np.array([max(model.margins(list(bag)), default=model.bias) for bag in some])
    slope, shift = _calibrate(m, y[look])
    return ToxicityModel(model.weights, model.bias, slope, shift, z, model.alpha)


def _spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([spelled(t) for t in b.column(2).to_pylist()], pa.binary())], names=["h", "toxic", "letters"])


def fit(docs: DataFrame, labels: DataFrame, learn: Column, per_label: int = SAMPLE_PER_LABEL) -> ToxicityModel:
    """Learns from labelled rows where ``learn`` (over doc_id) holds, at most ``per_label`` documents of each label."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.where(learn).select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"), F.xxhash64("doc_id").alias("h"))
    drawn = known.where("toxic = 1").orderBy("h", "doc_id").limit(per_label).unionAll(known.where("toxic = 0").orderBy("h", "doc_id").limit(per_label))
    rows = docs.where("text is not null").join(F.broadcast(drawn), "doc_id")  # at most 2 x per_label ids
    rows = rows.select("h", "toxic", F.col("text").cast("string").alias("text")).dropDuplicates()  # a repeated row teaches once
    got = map_batches(rows, _spell, "h long, toxic int, letters binary").toArrow()
    found = sorted(zip(got.column("h").to_pylist(), got.column("toxic").to_pylist(), got.column("letters").to_pylist()))
    del got
    return train([x for _, _, x in found], [t for _, t, _ in found])


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` (ending in a text column) with the text replaced by score and predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            p = m.probabilities(b.column(b.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], names=[*b.schema.names[:-1], "score", "predicted"])

    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields[:-1])
    return map_batches(docs, run, f"{head}, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, held_out: int = 0, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted for every document.

    * learns only from labels outside fold ``held_out``; null labels and ids teach nothing, of repeated labels the
      greatest counts, and a repeated row teaches once (different texts of one id each teach).
    * null, empty and letterless texts get the score of a text without any insult.
    * with no labels of one of the kinds all scores are low; an empty table gives an empty result.
    * only doc_id and text are read of documents, doc_id and toxic of labels.
    """
    src = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    model = fit(src, labels.select("doc_id", "toxic"), fold("doc_id", folds) != held_out)
    return score(src.select("doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), "text"), model)
