"""Toxicity (operator 3): a linear-chain conditional random field over words.

Words are runs of ASCII letters, digits and non-ASCII characters, capitals of ASCII and Latin-1 lower-cased; a word's
features are the word itself and its first four to eight bytes. Labels are given per document, so words get
theirs first: in a toxic document a word is toxic when one of its features stands in toxic documents far
more often than in others. The CRF (states clean and toxic, one emission weight per chosen
feature, transitions) is fitted to those word labels on a sample of at most ``SAMPLE`` documents of
either class, near copies left out, by gradient ascent on the conditional likelihood.

Scoring reads whole texts in one scan without a shuffle. Only words with a chosen feature have an emission of their own; the
words between them share one transition matrix, whose powers are exact, so forward and backward run over
the chosen words alone. The probability that any word is toxic, from the same forward pass, and the expected number of toxic words, from
the marginals, are calibrated together on the sample's labels, at the classes' true shares, and give the document's score; words whose marginal is at least one half are the spans,
with character offsets into the text as it was given.

Null and empty texts have the score of a text without words. Without both classes in the labels every score is the share
of toxic rows (0 without any). Extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.decontaminate import NOT_WORD
from ledgerloom.llm.share import Shared
from ledgerloom.llm.text import C1, MASKS, U, eights, flat, mix, runs, slices, whole, word_hashes, words

SAMPLE = 2500  # labelled documents of either class that the model is fitted to, chosen by hash
SAMPLE_BYTES = 50_000  # longer texts are not fitted to (they are scored like all)
MIN_DOCS = 3  # toxic sample documents that a feature stands in, at least
MIN_ODDS = 3.0
MARGIN = 2.0  # beyond a correction for the number of features
PREFIXES = (4, 5, 6, 7, 8)
SEGMENT = 64


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``flat`` with the capitals of Latin-1 (two bytes in UTF-8, the second 0x20 below the small one) lower-cased too."""
    data, offsets = flat(column)
    after = data[1:]
    after[(data[:-1] == 0xC3) & (after >= 0x80) & (after <= 0x9E) & (after != 0x97)] += 0x20
    return data, offsets


def features(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One row per kind of feature: the word, then its prefixes (0 where the word is no longer)."""
    length, head = end - start, eights(data)[start] if len(start) else np.zeros(0, np.uint64)
    out = [word_hashes(data, start, end)]
    for k in PREFIXES:
        out.append(np.where(length > k, mix((head & MASKS[k]) + np.array([k], np.uint64) * C1), U(0)))
    return np.stack(out)


def _forward(M: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, float]:
    v = v @ M
    s = v.sum()
    return v / s, float(np.log(s))


class Crf:
    """``weight`` per feature; ``bias`` of the toxic state; log transitions clean-toxic, toxic-clean, toxic-toxic."""

    def __init__(self, names: np.ndarray):
        self.names = np.sort(names)
        self.weight = np.zeros(len(names))
        self.bias, self.to, self.back, self.stay = -6.0, 0.0, 0.0, 0.0
        self.beta = np.array([1.0, 0.0, 0.0])
        self.screen = np.zeros(1 << 16, bool)
        self.screen[(self.names >> U(48)).astype(np.int64)] = True

    def chosen(self, feats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, feature) wherever a word has a chosen feature, by word."""
        word, name = [], []
        for kind in feats:
            at = np.flatnonzero(self.screen[(kind >> U(48)).astype(np.int64)])
            k = np.searchsorted(self.names, kind[at])
            k[k == len(self.names)] = 0
            ok = self.names[k] == kind[at] if len(self.names) else np.zeros(len(at), bool)
            word.append(at[ok])
            name.append(k[ok])
        word, name = np.concatenate(word), np.concatenate(name)
        order = np.argsort(word, kind="stable")
        return word[order], name[order]

    def fit(self, lengths: np.ndarray, times: np.ndarray, row: np.ndarray, word: np.ndarray, name: np.ndarray, label: np.ndarray, steps: int = 200) -> None:
        """Segments of words: their lengths, how many are like them; (segment, word, feature) triples; the toxic (segment, word) cells as an array."""
        n, m = len(lengths), SEGMENT
        inside = np.arange(m) < lengths[:, None]
        y = label.astype(float) * inside
        each = times[:, None]
        gold = np.bincount(name, (y * each)[row, word], len(self.weight))
        pairs = inside[:, 1:]
        y0, y1 = y[:, :-1], y[:, 1:]
        want = np.array([(x * each).sum() for x in (y, (1 - y0) * y1 * pairs, y0 * (1 - y1) * pairs, y0 * y1 * pairs)])
        theta = np.concatenate([self.weight, [self.bias, self.to, self.back, self.stay]])
        first, second = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, steps + 1):
            w, (b, to, back, stay) = theta[:-4], theta[-4:]
            e = np.full((n, m), b)
            np.add.at(e, (row, word), w[name])
            et = np.exp(np.clip(e, -30, 30))
            A, B, C = np.exp(to), np.exp(back), np.exp(stay)
            fo, ft = np.empty((n, m)), np.empty((n, m))
            o, t = np.ones(n), et[:, 0]
            for k in range(m):
                if k:
                    o, t = np.where(inside[:, k], o + t * B, o), np.where(inside[:, k], (o * A + t * C) * et[:, k], t)
                s = o + t
                o, t = o / s, t / s
                fo[:, k], ft[:, k] = o, t
            marg, both = np.empty((n, m)), np.zeros(3)
            bo, bt = np.ones(n), np.ones(n)
            for k in range(m - 1, -1, -1):
                p = ft[:, k] * bt
                z = fo[:, k] * bo + p
                marg[:, k] = p / z
                if k:
                    on = inside[:, k]
                    po, pt = fo[:, k - 1], ft[:, k - 1]
                    ot, tt, to_ = po * A * et[:, k] * bt, pt * C * et[:, k] * bt, pt * B * bo
                    zz = po * bo + ot + tt + to_
                    both += [(x / zz * times)[on].sum() for x in (ot, to_, tt)]
                    nbo, nbt = bo + A * et[:, k] * bt, B * bo + C * et[:, k] * bt
                    s = nbo + nbt
                    bo, bt = np.where(on, nbo / s, bo), np.where(on, nbt / s, bt)
            marg *= inside * each
            grad = np.concatenate([gold - np.bincount(name, marg[row, word], len(w)), want - [marg.sum(), *both]]) - 0.05 * theta
            first = 0.9 * first + 0.1 * grad
            second = 0.99 * second + 0.01 * grad**2
            theta = theta + 0.15 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        self.weight = theta[:-4]
        self.bias, self.to, self.back, self.stay = theta[-4:]

    def powers(self) -> list[tuple[np.ndarray, float]]:
        """The matrix of a word without chosen features, to the powers of two: scaled, and the log of the scale."""
        t = np.exp(self.bias)
        out = [(np.array([[1.0, np.exp(self.to) * t], [np.exp(self.back), np.exp(self.stay) * t]]), 0.0)]
        for _ in range(40):
            square, log = out[-1][0] @ out[-1][0], 2 * out[-1][1]
            out.append((square / square.max(), log + float(np.log(square.max()))))
        return out

    def chain(self, n: int, at: np.ndarray, emission: np.ndarray, powers: list[tuple[np.ndarray, float]]) -> tuple[float, np.ndarray]:
        """log(Z / Z of the all-clean path) of n words and the marginals of the chosen ones (words ``at``)."""
        A, B, C = np.exp(self.to), np.exp(self.back), np.exp(self.stay)

        def ahead(v: np.ndarray, gap: int) -> tuple[np.ndarray, float]:
            log, k = 0.0, 0
            while gap:
                if gap & 1:
                    v, s = _forward(powers[k][0], v)
                    log += s + powers[k][1]
                gap >>= 1
                k += 1
            return v, log

        def behind(v: np.ndarray, gap: int) -> np.ndarray:
            k = 0
            while gap:
                if gap & 1:
                    v = powers[k][0] @ v
                    v = v / v.sum()
                gap >>= 1
                k += 1
            return v

        if not n:
            return 0.0, np.zeros(0)
        alphas, logz = [], 0.0
        # Before the first word: a clean state that has emitted nothing and moves freely.
        begin = np.array([1.0, 0.0])
        v, done = begin, 0
        for i, x in zip(at.tolist(), emission.tolist(), strict=True):
            v, s = ahead(v, i - done)
            logz += s
            t = np.exp(min(self.bias + x, 30.0))
            v, s = _forward(np.array([[1.0, A * t], [B, C * t]]), v)
            logz += s
            alphas.append(v)
            done = i + 1
        v, s = ahead(v, n - done)
        logz += s
        marg = np.zeros(len(at))
        back, done = np.ones(2), n
        for k in range(len(at) - 1, -1, -1):
            back = behind(back, done - int(at[k]) - 1)
            p = alphas[k] * back
            marg[k] = p[1] / p.sum()
            t = np.exp(min(self.bias + float(emission[k]), 30.0))
            back = np.array([[1.0, A * t], [B, C * t]]) @ back
            back = back / back.sum()
            done = int(at[k])
        return logz, marg

    def scores(self, facts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(facts @ self.beta, -500, 500)))

    def raw(self, piece: pa.Array) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray]], tuple]:
        """Per text the calibrated facts (log odds that any word is toxic, log of one plus the expected number, 1); the
        (row, words, marginals) of the chosen words; and the word positions."""
        data, offsets = lowered(piece)
        start, end, first = words(data, offsets, NOT_WORD)
        word, name = self.chosen(features(data, start, end))
        at, begin = np.unique(word, return_index=True)
        emission = np.add.reduceat(self.weight[name], begin) if len(at) else np.zeros(0)
        powers = self.powers()
        n = np.diff(first)
        calm = np.zeros(len(n))
        for size in np.unique(n):
            calm[n == size] = self.chain(int(size), np.zeros(0, int), np.zeros(0), powers)[0]
        cuts = np.searchsorted(at, first)
        expected = np.zeros(len(n))
        marked = []
        for r in np.flatnonzero(np.diff(cuts)):
            own = slice(cuts[r], cuts[r + 1])
            calm[r], marg = self.chain(int(n[r]), at[own] - first[r], emission[own], powers)
            expected[r] = marg.sum()
            marked.append((int(r), at[own], marg))
        # P(any) = 1 - 1 / (Z / Z0), so its log odds are log(Z / Z0 - 1).
        odds = np.where(calm < 30, np.log(np.maximum(np.expm1(np.minimum(calm, 30)), 1e-13)), calm)
        facts = np.stack([np.clip(odds, -15, 15), np.log1p(expected), np.ones(len(n))], 1)
        return facts, marked, (start, end, offsets, data)


class _Copies:
    """Tells near copies of earlier texts: any of four smallest-shingle values in common."""

    def __init__(self) -> None:
        self.seen: set[tuple[int, int]] = set()

    def new(self, hashes: np.ndarray) -> bool:
        own = runs(hashes, min(5, len(hashes)))
        mins = {(k, int(mix(own + U(k)).min())) for k in range(1, 5)} if len(own) else set()
        fresh = not mins & self.seen
        self.seen |= mins
        return fresh


def _pieces(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, its features, the words' bounds) for a few texts at a time."""
    for i in range(0, len(texts), 200):
        data, offsets = lowered(pa.array(texts[i : i + 200], pa.large_string()))
        start, end, first = words(data, offsets, NOT_WORD)
        yield i, features(data, start, end), first


def train(texts: list[str], toxic: np.ndarray, weight: np.ndarray) -> Crf:
    """A fitted and calibrated model from sampled texts, their labels, and how many rows each stands for."""
    copies, used = _Copies(), np.zeros(len(texts), bool)
    held: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
    for i, feats, first in _pieces(texts):
        for k, (lo, hi) in enumerate(zip(first[:-1], first[1:], strict=True)):
            used[i + k] = copies.new(feats[0, lo:hi])
            if used[i + k]:
                held[toxic[i + k]].append(np.unique(feats[:, lo:hi]))
    model = Crf(_choose(held[1], held[0]))
    segments = _Segments()
    for i, feats, first in _pieces(texts):
        word, name = model.chosen(feats)
        for k in np.flatnonzero(used[i : i + len(first) - 1]):
            own = (word >= first[k]) & (word < first[k + 1])
            segments.add(first[k + 1] - first[k], word[own] - first[k], name[own], bool(toxic[i + k]))
    if len(model.names):
        model.fit(*segments.arrays())
    facts = np.concatenate([model.raw(whole(pa.array(texts[i : i + 200], pa.large_string())))[0] for i in range(0, len(texts), 200)])
    model.beta = _calibrate(facts[used], toxic[used].astype(float), weight[used])
    return model


def _choose(toxic: list[np.ndarray], calm: list[np.ndarray]) -> np.ndarray:
    """The features that stand in toxic documents far more often than in others, beyond chance."""
    n = max(1, len(toxic)), max(1, len(calm))
    names, bad = np.unique(np.concatenate([np.zeros(0, np.uint64), *toxic]), return_counts=True)
    common = bad >= MIN_DOCS
    names, bad = names[common], bad[common]
    good = np.zeros(len(names))
    for own in calm:
        at = np.searchsorted(names, own)
        at[at == len(names)] = 0
        if len(names):
            good[at[names[at] == own]] += 1
    odds = np.log((bad + 0.5) / (n[0] + 1)) - np.log((good + 0.5) / (n[1] + 1))
    # Chance must not explain it: a Chernoff bound on the share of toxic documents among those with the feature,
    # against the number of features looked at.
    share, rate = np.clip(bad / (bad + good), 1e-9, 1 - 1e-9), n[0] / (n[0] + n[1])
    surprise = (bad + good) * (share * np.log(share / rate) + (1 - share) * np.log((1 - share) / (1 - rate)))
    ok = (names != 0) & (odds >= MIN_ODDS) & (surprise >= np.log(max(1, len(names))) + MARGIN)
    best = np.argsort(-surprise * ok, kind="stable")[: int(ok.sum())]
    return names[best]


class _Segments:
    """Texts cut into segments: those with a chosen word, and of the others, which differ in length alone, how many of each length."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, np.ndarray, np.ndarray, bool]] = []
        self.calm = np.zeros(SEGMENT + 1, np.int64)

    def add(self, n: int, word: np.ndarray, name: np.ndarray, toxic: bool) -> None:
        for lo in range(0, int(n), SEGMENT):
            length = min(SEGMENT, int(n) - lo)
            own = slice(*np.searchsorted(word, (lo, lo + SEGMENT)))
            if own.start < own.stop:
                self.rows.append((length, word[own] - lo, name[own], toxic))
            else:
                self.calm[length] += 1

    def arrays(self) -> tuple[np.ndarray, ...]:
        calm = np.flatnonzero(self.calm)
        lengths = np.concatenate([np.array([r[0] for r in self.rows], np.int64), calm])
        times = np.concatenate([np.ones(len(self.rows)), self.calm[calm]])
        row = np.repeat(np.arange(len(self.rows)), [len(r[1]) for r in self.rows])
        word = np.concatenate([np.zeros(0, int), *[r[1] for r in self.rows]])
        name = np.concatenate([np.zeros(0, int), *[r[2] for r in self.rows]])
        label = np.zeros((len(lengths), SEGMENT), bool)
        label[row, word] = np.array([r[3] for r in self.rows])[row]
        return lengths, times, row, word, name, label


def _calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with a little ridge; neither fact may lower the score."""
    weight = weight / weight.mean()
    beta = np.array([1.0, 0.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (weight * (y - p)) - 0.05 * beta
        H = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3)
        beta = beta + np.clip(np.linalg.solve(H, g), -1, 1)
        beta[:2] = np.maximum(beta[:2], 0.0)
    return beta


def fit(docs: DataFrame, labels: DataFrame, keep: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Crf | float:
    """The model from the labelled documents that ``keep`` (on ``doc_id``) lets through."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y is not null")
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    known = known if keep is None else known.where(keep)
    n = {r["y"]: r["count"] for r in known.where("y in (0, 1)").groupBy("y").count().collect()}
    if len(n) < 2:
        return float(n.get(1, 0) > 0)
    share = F.when(F.col("y") == 1, F.lit(min(1.0, SAMPLE / n[1]))).otherwise(F.lit(min(1.0, SAMPLE / n[0])))
    at = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = F.broadcast(known.where((at < share) & F.col("y").isin(0, 1)))  # at most about twice SAMPLE ids
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text")).where(F.octet_length("text") <= SAMPLE_BYTES)
    got = rows.join(sample, "doc_id").select("doc_id", "text", "y").toPandas().sort_values(["doc_id", "text"])
    y = got["y"].to_numpy()
    if not 0 < y.sum() < len(y):
        return float(y.sum() > 0)
    weight = np.where(y == 1, n[1] / (y == 1).sum(), n[0] / (y == 0).sum())
    return train(got["text"].tolist(), y, weight)


SPANS = T.ArrayType(T.StructType().add("start", T.LongType()).add("end", T.LongType()).add("probability", T.DoubleType()))


def score(docs: DataFrame, model: Crf | float, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``spans`` (start, end, probability of toxic words; offsets in characters)."""
    names = docs.columns
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col(f"`{text_col}`").cast("string").alias("_text"))
    kind = T.StructType(rows.schema.fields[:-1]).add("score", T.DoubleType()).add("spans", SPANS)
    shared = Shared(docs.sparkSession, model)
    done = rows.mapInArrow(lambda it: _score(it, shared.value), kind)
    return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names) if c not in ("score", "spans")], "score", "spans")


def _score(batches: Iterator[pa.RecordBatch], model: Crf | float) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))
    for batch in batches:
        for piece in slices(batch, "_text"):
            spans: list[list[dict]] = [[] for _ in range(piece.num_rows)]
            if isinstance(model, float):
                scores = np.full(piece.num_rows, model)
            else:
                facts, marked, (start, end, offsets, data) = model.raw(piece.column("_text"))
                scores = model.scores(facts)
                for r, at, marg in marked:
                    for w, p in zip(at[marg >= 0.5], marg[marg >= 0.5], strict=True):
                        head = data[offsets[r] : end[w]]
                        chars = (head & 0xC0) != 0x80
                        a = int(chars[: start[w] - offsets[r]].sum())
                        spans[r].append({"start": a, "end": a + int(chars[start[w] - offsets[r] :].sum()), "probability": float(p)})
            own = piece.columns[:-1]
            yield pa.RecordBatch.from_arrays([*own, pa.array(scores), pa.array(spans, kind)], [*piece.schema.names[:-1], "score", "spans"])
