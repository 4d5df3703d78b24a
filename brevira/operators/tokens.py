"""Word pruning by inverse document frequency."""

from __future__ import annotations

import functools
import math
import pickle
import re
import tempfile
from collections import Counter
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField

from ..functions import constants as K
from ..functions.text import strip, tokens
from .importance import _ASCII_WORD, _per_conversation, _split
from .lines import KEY

POLICIES = ("MODERATE", "AGGRESSIVE")


def idf(rows: DataFrame) -> DataFrame:
    """(conv_id, token, idf) over the rows of each conversation."""
    df = rows.select("conv_id", F.explode(F.array_distinct(tokens(F.col("content")))).alias("token")).groupBy("conv_id", "token").agg(F.count("*").alias("df"))
    n = rows.groupBy("conv_id").agg(F.count("*").alias("n"))
    return df.join(n, "conv_id").select("conv_id", "token", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def merged_idf(now: DataFrame, cached: DataFrame) -> DataFrame:
    """Current scores, and cached ones for tokens that are absent now."""
    old = cached.select("conv_id", "token", F.col("idf").alias("_old"))
    return now.join(old, ["conv_id", "token"], "full_outer").select("conv_id", "token", F.coalesce("idf", "_old").alias("idf"))


def kept_word(w) -> Column:
    return w.rlike("^(?:" + "|".join(f"(?:{p})" for p in K.KEPT_WORDS) + ")$")


def pruned(rows: DataFrame, keep_ratio: float | Column = 0.5, scores: DataFrame | None = None, needles: DataFrame | None = None) -> DataFrame:
    """Of each line the highest-scoring share of words stays, ties and protected words too, joined by single spaces.

    A word scores by its lowered form as it stands, punctuation included; unknown words score 1. Lines of which nothing
    would go stay as they are.
    """
    ratio = keep_ratio if isinstance(keep_ratio, Column) else F.lit(keep_ratio)
    if scores is not None:
        return pruned_by_words(rows, ratio, scores, needles)
    c, odd = F.col("content"), F.col("content").rlike(r"[^\x00-\x7F]")
    r = rows.select(*KEY, "content", F.when(odd, F.lower(c)).alias("lower"), F.when(odd, F.array_join(tokens(c), " ")).alias("tokens"), F.when(F.col("policy").isin(*POLICIES), F.coalesce(ratio.cast("double"), F.lit(0.0))).alias("ratio"), F.lit(None).cast("array<string>").alias("hard"))
    if needles is not None:
        null = F.lit(None).cast("string")
        hard = F.coalesce(F.transform("needles", lambda x: F.lower(x)), F.array().cast("array<string>")).alias("hard")
        r = r.unionByName(needles.select("conv_id", F.lit(-1).cast("long").alias("idx"), null.alias("content"), null.alias("lower"), null.alias("tokens"), F.lit(None).cast("double").alias("ratio"), hard))
    text = _per_conversation(r, _cut, StructField("text", StringType()))
    return rows.join(text, KEY, "left").withColumn("content", F.coalesce("text", "content")).drop("text")


class _Spool:
    """Rows to be read again, on disk beyond so many characters."""

    def __init__(self, most: int = 1 << 25):
        self.most, self.size, self.rows, self.file = most, 0, [], None

    def add(self, row: tuple, size: int) -> None:
        self.size += size
        self.rows.append(row)
        if self.size > self.most:
            self.file = self.file or tempfile.TemporaryFile()
            pickle.dump(self.rows, self.file)
            self.size, self.rows = 0, []

    def __iter__(self) -> Iterator[tuple]:
        if self.file is not None:
            end = self.file.tell()
            self.file.seek(0)
            while self.file.tell() < end:
                yield from pickle.load(self.file)
            self.file.close()
        yield from self.rows


# the engine's $ also stands before a last line end
_KEPT = re.compile("(?:" + "|".join(f"(?:{p})" for p in K.KEPT_WORDS) + r")(?=[\u0085\u2028\u2029]?\Z)", re.ASCII)


@functools.lru_cache(1 << 16)
def _kept(word: str) -> bool:
    return _KEPT.match(word) is not None


def _line(line: str, lower: str, ratio: float, idf: dict[str, float], hard: set[str]) -> str:
    words = _split(line)
    n = len(words)
    keep = max(1, int(n * ratio))
    if keep >= n:
        return line
    lowered = _split(lower)
    s = [idf.get(w, 1.0) for w in lowered]
    least = sorted(s)[n - keep]
    return " ".join(w for w, x, low in zip(words, s, lowered, strict=True) if x >= least or low in hard or _kept(w))


def _cut(key, rows: Iterable[tuple]) -> Iterator[tuple]:
    df, hard, own, n = Counter(), set(), _Spool(), 0
    for _, idx, text, lower, found, ratio, strings in rows:
        if strings is not None:
            hard.update(strings)
            continue
        n += 1
        if text is None:
            continue
        df.update(set(_ASCII_WORD.findall(text.lower()) if found is None else found.split(" ")))
        if ratio is not None:
            own.add((idx, text, lower, ratio), len(text))
    idf = {w: math.log((n + 1) / (k + 1)) + 1 for w, k in df.items()}
    for idx, text, lower, ratio in own:
        new = "\n".join(_line(x, y, ratio, idf, hard) for x, y in zip(text.split("\n"), (text.lower() if lower is None else lower).split("\n"), strict=True))
        if new != text:
            yield key, idx, new


def pruned_by_words(rows: DataFrame, ratio: Column, scores: DataFrame, needles: DataFrame | None = None) -> DataFrame:
    """:func:`pruned` with given scores, over a table of words."""
    own = rows.where(F.col("policy").isin(*POLICIES)).withColumn("_r", ratio)
    lines = own.select(*KEY, "_r", F.posexplode(F.split("content", "\n")).alias("pos", "line"))
    words = lines.where(strip(F.col("line")) != "").select(*KEY, "pos", "_r", F.posexplode(F.split(strip(F.col("line")), r"\s+")).alias("at", "word"))
    words = words.withColumn("token", F.lower("word")).join(scores.select("conv_id", "token", "idf"), ["conv_id", "token"], "left")
    words = words.withColumn("s", F.coalesce("idf", F.lit(1.0))).withColumn("k", kept_word(F.col("word")))
    if needles is not None:
        hard = needles.select("conv_id", F.explode("needles").alias("token")).withColumn("token", F.lower("token")).distinct().withColumn("_hard", F.lit(True))
        words = words.join(hard, ["conv_id", "token"], "left").withColumn("k", F.col("k") | F.coalesce("_hard", F.lit(False)))
    by = words.groupBy(*KEY, "pos", "_r").agg(F.array_sort(F.collect_list(F.struct("at", "word", "s", "k"))).alias("w"))
    n = F.size("w")
    keep = F.greatest(F.lit(1), F.floor(n * F.col("_r")).cast("int"))
    by = by.withColumn("_t", F.element_at(F.array_sort(F.transform("w", lambda x: x["s"])), n - keep + 1))
    by = by.withColumn("new", F.when(keep >= n, None).otherwise(F.array_join(F.transform(F.filter("w", lambda x: x["k"] | (x["s"] >= F.col("_t"))), lambda x: x["word"]), " "))).select(*KEY, "pos", "new")
    lines = lines.join(by, [*KEY, "pos"], "left").withColumn("line", F.coalesce("new", "line"))
    text = lines.groupBy(*KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return rows.join(text, KEY, "left").withColumn("content", F.coalesce("text", "content")).drop("text")
