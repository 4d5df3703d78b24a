"""Secret scans: base patterns, and character Markov models of random strings and of ordinary identifiers.

Both models are order-1 character chains with start and end, trained from labelled samples with add-one
smoothing. A token of key characters is a secret if the log-likelihood ratio of the two models per character, and over
the whole token, is high enough. The samples are a parameter; by default they are drawn from a seeded generator:
keys over the usual alphabets against words, identifiers, paths and numbers.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import random
import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, free

#: The base patterns of the contract and the lengths that their matches need.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Average log-likelihood ratio per character, and of the token, from which a token counts as random.
PER_CHAR, WHOLE = 0.6, 14.0

#: Parts of a token between separators are judged too, from so many characters on.
PART = re.compile(r"[A-Za-z0-9+]+")
LEAST = 20

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


@dataclass
class Chain:
    logs: dict[str, dict[str, float]]

    @classmethod
    def fit(cls, samples: Iterable[str]) -> Chain:
        marks = ["^", *_ALPHABET, "$"]
        count = {a: dict.fromkeys(marks[1:], 1.0) for a in marks[:-1]}
        for s in samples:
            s = [c for c in s if c in _ALPHABET]
            for a, b in zip(["^", *s], [*s, "$"], strict=True):
                count[a][b] += 1
        return cls({a: {b: math.log(n / sum(row.values())) for b, n in row.items()} for a, row in count.items()})

    def log_likelihood(self, s: str) -> float:
        return sum(self.logs[a][b] for a, b in zip("^" + s, s + "$", strict=True))


@dataclass
class Models:
    random: Chain
    ordinary: Chain

    def ratio(self, token: str) -> float:
        return self.random.log_likelihood(token) - self.ordinary.log_likelihood(token)


def default_samples(seed: int = 11, n: int = 4000) -> list[tuple[str, int]]:
    """Labelled samples: 1 random string, 0 ordinary."""
    rng = random.Random(seed)
    upper, lower, digit = _ALPHABET[:26], _ALPHABET[26:52], _ALPHABET[52:62]
    syllables = [c + v + e for c in ("b", "c", "d", "f", "g", "h", "l", "m", "n", "p", "r", "s", "t", "st", "th", "sh", "ch", "tr", "pr", "qu", "k", "w", "v", "j", "br", "x", "z", "") for v in ("a", "e", "i", "o", "u", "ow", "ick", "y") for e in ("", "n", "r", "s", "t", "l", "nd", "ng", "tion", "ly")]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 5)))
    out = []
    for _ in range(n):
        letters = rng.choice([upper + lower + digit, upper + lower + digit + "+/", upper + lower + digit + "_-", digit + lower[:6], digit + upper[:6], upper + digit, lower + digit])
        out.append(("".join(rng.choice(letters) for _ in range(rng.randint(20, 64))) + "=" * rng.choice([0, 0, 0, 1, 2]), 1))
        words = [word() for _ in range(rng.randint(1, 6))]
        style = rng.randrange(12)
        s = ("_", "-", "/", "")[style % 4].join(words) if style < 4 else "".join(w.capitalize() for w in words) if style in (4, 9, 10, 11) else ("_" if rng.random() < 0.5 else "").join(words).upper() if style == 5 else "".join(words).upper() if style == 8 else "".join(rng.choice(digit) for _ in range(rng.randint(4, 30))) if style == 6 else rng.choice("=-_") * rng.randint(8, 60)
        out.append((s + rng.choice(["", "", "", str(rng.randint(0, 99))]), 0))
    return out


def train(samples: Iterable[tuple[str, int]]) -> Models:
    samples = list(samples)
    return Models(Chain.fit(s for s, y in samples if y), Chain.fit(s for s, y in samples if not y))


def _random(s: str, models: Models) -> bool:
    ratio = models.ratio(s)
    return ratio >= WHOLE and ratio >= PER_CHAR * len(s)


def _keys(token: str, models: Models) -> list[tuple[int, int]]:
    """Random stretches of a token: all of it, or else runs of its parts at separators, the longest first.

    A run starts and ends with a part that is random by itself, so that no word beside a key belongs to it; a part
    counts as such on its own share of the bar, as the whole run has to reach the whole bar.
    """
    if len(token) >= LEAST and _random(token, models):
        return [(0, len(token))]
    parts = [m.span() for m in PART.finditer(token)]
    if not parts or parts == [(0, len(token))]:
        return []
    out = []
    at = 0
    likely = [models.ratio(token[a:b]) >= PER_CHAR * (b - a) for a, b in parts]
    while at < len(parts):
        end = at
        if likely[at]:
            while end + 1 < len(parts) and likely[end + 1]:
                end += 1
            a, b = parts[at][0], parts[end][1]
            if b - a >= LEAST and _random(token[a:b], models):
                pad = len(token) - len(token[b:].lstrip("="))
                out.append((a, pad))
        at = end + 1
    return out


def scan(text: str | None, models: Models) -> list[tuple[str, int, int]]:
    """(kind, start, end) by code points, by start and then kind; base spans as the patterns give them, then
    random tokens, or parts of tokens, outside those."""
    text = text or ""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    base = sorted((a, b) for _, a, b in found)
    tops = list(itertools.accumulate((b for _, b in base), max))
    for m in TOKEN.finditer(text):
        at, end = m.span()
        for x, y in [*base[bisect.bisect_right(tops, at) :], (end, end)]:  # the stretches between base spans
            if at < min(x, end):
                found += [("markov", at + a, at + b) for a, b in _keys(text[at : min(x, end)], models)]
            at = max(at, y)
            if at >= end:
                break
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def scanned(docs: DataFrame, models: Models | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with _spans (array of kind, start, end). Null and empty texts have none; every row is judged alone, repeated ones
    too, in time that grows as its length; an empty table gives no rows; a column called _spans is replaced, others pass through."""
    sent = docs.sparkSession.sparkContext.broadcast(models or train(default_samples()))

    def make():
        m = sent.value
        return lambda texts: ([[{"kind": k, "start": a, "end": b} for k, a, b in scan(t, m)] for t in texts],)

    return add_columns(docs, [text_col], "_spans array<struct<kind:string,start:int,end:int>>", make)


def _names(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(found: DataFrame) -> DataFrame:
    """The contract's columns from :func:`scanned`'s output."""
    n = lambda kind: F.size(F.filter("_spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"), F.sha2(_names(F.filter("_spans", lambda x: x["kind"] != "markov")), 256).alias("base_sha256"), _names(F.col("_spans")).alias("spans"))


def redact(text: str | None, spans: list[tuple[str, int, int]], mark: str = "[secret]") -> str | None:
    """The text with every span, overlapping ones together, replaced by ``mark``."""
    if text is None or not spans:
        return text
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda x: (x[1], x[2])):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, models: Models | None = None) -> DataFrame:
    """``docs`` with the secrets in ``text`` masked; n_chars, where there is such a column, follows the new text. Null texts stay
    null; other columns pass through in their order, whatever their names."""
    names, clean = docs.columns, free("_clean", docs)
    sent = docs.sparkSession.sparkContext.broadcast(models or train(default_samples()))

    def make():
        m = sent.value
        return lambda texts: ([redact(t, scan(t, m)) for t in texts],)

    out = add_columns(docs, ["text"], f"{clean} string", make, drop=["text"]).withColumnRenamed(clean, "text").select(*[F.col(f"`{c}`") for c in names])
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
