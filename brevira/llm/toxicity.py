"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A text is cut into windows of ``WINDOW`` words, one from each word on. A window is the mean of the embeddings of its words
and of all their character 3- to 6-grams (with word edges), hashed into ``2**BITS`` rows; a linear softmax over that mean
gives its score. The evidence of a text is its highest window, so that a slur in a long text is not averaged away, and the mean of its
highest few, as one word alone may be chance.
Embeddings and softmax are learned together by Adagrad: n-grams that few documents of the sample hold are left out, the
others start from the log-odds of the documents that hold them, and in each round a toxic document is represented by its highest
window and a clean one by its highest and some others. A misspelling shares most of its n-grams with the word meant.
A final logistic fit, in which the rarer class weighs more, turns the evidence into a probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, release, span_hashes

BITS, DIM, WINDOW, ORDERS = 18, 8, 3, (3, 4, 5, 6)
#: Documents of the sample that an n-gram needs to be learned, smoothing of their log-odds, and the learning rate.
LEAST_DOCS, SMOOTH, RATE = 6, 0.5, 0.3
#: Share of a text's windows whose mean is evidence beside the highest, and the ridge of the last fit.
TOP_SHARE, RIDGE = 0.05, 1e-3
#: Bound of the training sample: labelled rows by class, in the order of a hash of their ids, and the largest text that
#: is learned from (all texts are scored, whole).
MAX_TOXIC, MAX_CLEAN, MAX_TRAIN_BYTES = 2500, 3500, 32768

_SHIFT = np.uint64(64 - BITS)
_MULT = np.random.default_rng(7).integers(1 << 20, 1 << 62, max(ORDERS), np.uint64) * np.uint64(2) + np.uint64(1)


def grams_of(text: str | None) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Of a lower-cased text: the edge before and after each word, and for each kind of n-gram (places, rows); an n-gram's place
    is its start, a whole word's the edge before it."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_word = ((c - np.uint32(97)) < 26) | ((c - np.uint32(48)) < 10) | ((c >= 0xC0) & ((c < 0x2000) | (c > 0x206F)) & ((c < 0x3000) | (c > 0x303F)))
    keep = is_word | np.concatenate(([True], is_word[:-1])) if len(c) else is_word
    x = np.where(is_word, c, 1)[keep].astype(np.uint64)
    x = np.concatenate((np.ones(1, np.uint64), x, np.ones(1, np.uint64)))
    edge = x == 1
    first, last = np.flatnonzero(edge[:-1] & ~edge[1:]), np.flatnonzero(~edge[:-1] & edge[1:]) + 1
    out = [(first, (span_hashes(x, first + 1, last) >> _SHIFT).astype(np.int64))]
    at, h = np.arange(max(0, len(x) - 1)), x[:-1] * _MULT[0]
    for order in range(2, max(ORDERS) + 1):
        m = np.searchsorted(at, len(x) - order + 1)
        at, h = at[:m], h[:m] + x[at[:m] + order - 1] * _MULT[order - 1]
        if order in ORDERS:
            g = h + np.uint64(order)
            out.append((at, (((g ^ (g >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> _SHIFT).astype(np.int64)))
        # an n-gram goes on unless it has come to the edge after its word
        more = np.flatnonzero(~edge[at + order - 1])
        at, h = at[more], h[more]
    return first, last, out


def features(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(n-gram rows in order, start of each word in them, its end, hash of each word) of a text. All n-grams lie in words."""
    first, _, found = grams_of(text)
    at, rows = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(at, kind="stable")
    at, rows = at[order], rows[order]
    starts = np.searchsorted(at, first)
    ends = np.append(starts[1:], len(rows))[: len(starts)]
    return rows, starts, ends, span_hashes(rows, starts, ends)


def stretches(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places from each start to its end, one stretch after the other."""
    n = ends - starts
    return np.arange(int(n.sum())) + np.repeat(starts - np.cumsum(n) + n, n)


def windows(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in n-gram rows, of the windows."""
    n = len(starts)
    if not n:
        return starts, ends
    first = np.arange(max(1, n - WINDOW + 1))
    return starts[first], ends[np.minimum(first + WINDOW, n) - 1]


@dataclass
class Model:
    table: np.ndarray  # of each n-gram row: its embedding's part of the logit
    bias: float
    slopes: tuple[float, float]
    shift: float
    none: tuple[float, float] = (0.0, 0.0)  # evidence that a text without words is given: a quiet clean text's

    def evidence(self, text: str | None) -> tuple[float, float]:
        """The highest window score and the mean of the highest ones."""
        first, last, found = grams_of(text)
        if not len(first):
            return self.none
        total, count = np.zeros(int(last[-1]) + 1), np.zeros(int(last[-1]) + 1, np.int64)
        for at, rows in found:  # sums up to each place
            total[at + 1] += self.table[rows]
            count[at + 1] += 1
        total, count = np.cumsum(total), np.cumsum(count)
        a, b = windows(first, last)
        return highest((total[b] - total[a]) / np.maximum(count[b] - count[a], 1) + self.bias)

    def score(self, text: str | None) -> float:
        x = self.evidence(text)
        z = self.slopes[0] * x[0] + self.slopes[1] * x[1] + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def highest(z: np.ndarray) -> tuple[float, float]:
    """The highest of a text's window scores, and the mean of its highest share (of three at least, or all)."""
    n = min(len(z), max(3, int(len(z) * TOP_SHARE)))
    return float(z.max()), float(np.partition(z, len(z) - n)[len(z) - n :].mean())


def logistic(x: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes and shift of a regularised logistic fit, in which the rarer class weighs more, by the root of the ratio."""
    share = np.clip(t.mean(), 1e-6, 1 - 1e-6)
    weight = np.where(t == 1, np.sqrt((1 - share) / share), 1.0)
    weight = (weight / weight.sum())[:, None]
    mid, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    u = np.concatenate(((x - mid) / spread, np.ones((len(x), 1))), axis=1)
    w, ridge = np.zeros(u.shape[1]), np.append(np.full(x.shape[1], RIDGE), 1e-6)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(u @ w, -40, 40)))
        h = (u * weight * (p * (1 - p) + 1e-9)[:, None]).T @ u + np.diag(ridge)
        d = np.linalg.solve(h, (u * weight).T @ (p - t) + ridge * w)
        w -= np.clip(d, -2, 2)
        if np.abs(d).sum() < 1e-9:
            break
    return w[:-1] / spread, float(w[-1] - (w[:-1] * mid / spread).sum())


def train(texts: list[str | None], labels: list[int], seed: int = 42, rounds: int = 8) -> Model:
    """Joint training; deterministic. No rows, or rows of one class only, give a constant score."""
    y = np.asarray(labels, np.int64)
    prior = (y.sum() + 1) / (len(y) + 2)
    if len(set(labels)) < 2:
        return Model(np.zeros(1 << BITS, np.float32), 0.0, (0.0, 0.0), float(np.log(prior / (1 - prior))))
    rng = np.random.default_rng(seed)
    # a text is held as its words' numbers, and each distinct word's n-gram rows are held once
    number: dict[int, int] = {}
    words, of_words, sizes = [], [], []
    of = np.zeros((2, 1 << BITS), np.int32)  # documents of each class by n-gram row
    for i, t in enumerate(texts):
        rows, s, e, h = features(t)
        of[y[i], np.unique(rows)] += 1
        own, at, which = np.unique(h, return_index=True, return_inverse=True)
        known = len(number)
        ids = np.array([number.setdefault(x, len(number)) for x in own.tolist()], np.int32)
        new = at[ids >= known]
        of_words.append(rows[stretches(s[new], e[new])].astype(np.int32))
        sizes.append((e - s)[new])
        words.append(ids[which])
    del number
    of_words, n_words = np.concatenate(of_words), np.array([len(w) for w in words])
    word_end = np.cumsum(np.concatenate(sizes))
    word_size = np.concatenate(sizes)
    words = np.concatenate(words)
    text_end = np.cumsum(n_words)
    # windows: their documents and their first and last words
    n_windows = np.where(n_words > 0, np.maximum(n_words - WINDOW + 1, 1), 0)
    owner = np.repeat(np.arange(len(y), dtype=np.int32), n_windows)
    window_end = np.cumsum(n_windows)
    start = stretches(text_end - n_words, text_end - n_words + n_windows).astype(np.int32)
    end = np.minimum(start + WINDOW, text_end[owner]).astype(np.int32)
    clean = np.flatnonzero(y[owner] == 0).astype(np.int32)
    n_of = np.bincount(y, minlength=2)

    # rows of few documents say nothing; the others start from the log-odds of their documents
    learned = of.sum(axis=0) >= LEAST_DOCS
    odds = np.log((of[1] + SMOOTH) / (n_of[1] + 2 * SMOOTH)) - np.log((of[0] + SMOOTH) / (n_of[0] + 2 * SMOOTH))
    del of
    emb = (rng.random((1 << BITS, DIM), np.float32) - 0.5) / DIM
    emb[:, 0] = odds
    emb[~learned] = 0
    out, bias = (rng.random((DIM, 2), np.float32) - 0.5) / 2, np.zeros(2, np.float32)
    out[0] = -0.5, 0.5
    seen_e, seen_o, seen_b = np.full(1 << BITS, 1e-2, np.float32), np.full((DIM, 2), 1e-2, np.float32), np.full(2, 1e-2, np.float32)

    def step(pick: np.ndarray, rate: float) -> None:
        nonlocal out, bias, seen_o, seen_b
        held = words[stretches(start[pick].astype(np.int64), end[pick].astype(np.int64))]
        ids = of_words[stretches(word_end[held] - word_size[held], word_end[held])]
        size = np.add.reduceat(word_size[held], np.cumsum(end[pick] - start[pick]) - (end[pick] - start[pick]))
        at = np.concatenate(([0], np.cumsum(size)[:-1]))
        mean = np.add.reduceat(emb[ids], at, axis=0) / size[:, None]
        z = mean @ out + bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(pick)), y[owner[pick]]] -= 1
        p /= 16
        back = (p @ out.T) / size[:, None]
        g = mean.T @ p
        seen_o += g * g
        out -= rate * g / np.sqrt(seen_o)
        g = p.sum(axis=0)
        seen_b += g * g
        bias -= rate * g / np.sqrt(seen_b)
        order = np.argsort(ids, kind="stable")
        u, first = np.unique(ids[order], return_index=True)
        g = np.add.reduceat(np.repeat(back, size, axis=0)[order], first, axis=0)
        u, g = u[learned[u]], g[learned[u]]
        seen_e[u] += (g * g).mean(axis=1)
        emb[u] -= rate * g / np.sqrt(seen_e[u])[:, None]

    def epoch(pick: np.ndarray, rate: float) -> None:
        for part in np.array_split(rng.permutation(pick), max(1, len(pick) // 256)):
            if len(part):
                step(part, rate)

    def logits() -> tuple[np.ndarray, np.ndarray]:
        t = emb @ (out[:, 1] - out[:, 0])
        total = np.concatenate(([0.0], np.cumsum(np.add.reduceat(t[of_words], word_end - word_size, dtype=np.float64)[words])))
        count = np.concatenate(([0], np.cumsum(word_size[words])))
        return t, (total[end] - total[start]) / (count[end] - count[start]) + bias[1] - bias[0]

    # a toxic document's windows mostly are clean: it is represented by its highest one
    own = [(i, int(b - n), int(b)) for i, (n, b) in enumerate(zip(n_windows, window_end, strict=True)) if n]
    for _ in range(rounds if own else 0):
        z = logits()[1]
        top = np.array([a + int(z[a:b].argmax()) for i, a, b in own if y[i]], np.int64)
        hard = np.concatenate([np.empty(0, np.int64), *(a + np.argpartition(-z[a:b], min(1, b - a - 1))[:2] for i, a, b in own if not y[i])])
        other = clean[rng.integers(0, max(1, len(clean)), len(hard))].astype(np.int64)
        epoch(np.concatenate((top, top, hard, other)), RATE)
    if not own:
        return Model(np.zeros(1 << BITS, np.float32), 0.0, (0.0, 0.0), float(np.log(prior / (1 - prior))))
    table, z = logits()
    x, t = np.array([highest(z[a:b]) for _, a, b in own]), y[[i for i, _, _ in own]].astype(float)
    slopes, shift = logistic(x, t)
    quiet = np.quantile(x[t == 0], 0.05, axis=0) if (t == 0).any() else (0.0, 0.0)
    return Model(table.astype(np.float32), float(bias[1] - bias[0]), tuple(map(float, slopes)), shift, tuple(map(float, quiet)))


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def training_rows(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, max_bytes: int = MAX_TRAIN_BYTES) -> list[tuple[str, int]]:
    """A bounded sample of labelled rows outside the held-out fifth: (text, label), in the order of a hash of the ids.

    A document labelled twice is toxic if one label says so; null labels and null ids count as unlabelled. Of several texts of
    one id within the bound the one of the least hash is learned from. Other columns of both tables are ignored.
    """
    y = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out())
    own = docs.select("doc_id", "text").where(F.octet_length("text").between(1, max_bytes))
    y = y.join(own.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("o", F.xxhash64("doc_id"))
    ids = [r for toxic, n in ((1, max_toxic), (0, max_clean)) for r in y.where(F.col("toxic") == toxic).orderBy("o", "doc_id").limit(n).select("doc_id", "toxic").collect()]
    if not ids:
        return []
    picked = docs.sparkSession.createDataFrame([(r.doc_id, r.toxic) for r in ids], "doc_id long, toxic int")
    rows = own.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).collect()
    return [(t, y) for _, t, y in sorted((r.doc_id, r.text, r.toxic) for r in rows)]


def fit(docs: DataFrame, labels: DataFrame, **bounds: int) -> Model:
    rows = training_rows(docs, labels, **bounds)
    model = train([t for t, _ in rows], [y for _, y in rows])
    del rows
    release()  # the driver goes on after the fit
    return model


def scored(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with a toxicity probability; null, empty and wordless texts get the model's score of no evidence."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = sent.value
        return lambda texts: ([m.score(t) for t in texts],)

    return add_columns(docs, [text_col], f"`{out_col}` double", make)


def judged(docs: DataFrame, model: Model) -> DataFrame:
    """The contract's columns: doc_id, held_out, score, predicted."""
    out = scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
