"""Exact, cross-window, near and chunk deduplication."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType
from pyspark.sql.window import Window

from ..functions.text import content_hash, strip, tokens, word_count

LOCKED = ("PRESERVE", "LIGHT")
CHUNK_WORDS, CHUNK_ROW_WORDS = 200, 1000


def _note(name, what) -> F.Column:
    return F.concat(F.lit("["), F.coalesce(name, F.lit("content")), F.lit(" was read earlier in this session. Content unchanged."), what, F.lit("]"))


def exact(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, edges): later copies of a normalised text point to the first; preserved and light rows take no part."""
    h = F.when(~F.col("policy").isin(*LOCKED), content_hash(F.col("content")))
    rows = rows.withColumn("_h", h).withColumn("_first", F.when(F.col("_h").isNotNull(), F.min("idx").over(Window.partitionBy("conv_id", "_h"))))
    again = F.col("_first") < F.col("idx")
    edges = rows.where(again).select("conv_id", F.lit("dedup").alias("kind"), F.col("idx").alias("src"), F.col("_first").alias("dst"))
    note = _note(F.col("name"), F.concat(F.lit(" See message #"), F.col("_first").cast("string"), F.lit(".")))
    return rows.withColumn("content", F.when(again, note).otherwise(F.col("content"))).drop("_h", "_first"), edges


def cross_window(rows: DataFrame, seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, new hashes): texts that an earlier window of the session held become notes without an edge.

    ``seen``: session_id, window, hash, of other windows; here a conversation is a session. What this window
    holds for the first time is to be appended.
    """
    rows = rows.withColumn("_h", F.when(~F.col("policy").isin(*LOCKED), content_hash(F.col("content"))))
    old = seen.select(F.col("session_id").alias("conv_id"), F.col("hash").alias("_h")).distinct().withColumn("_old", F.lit(True))
    rows = rows.join(old, ["conv_id", "_h"], "left")
    new = rows.where(F.col("_h").isNotNull() & F.col("_old").isNull()).select(F.col("conv_id").alias("session_id"), F.col("_h").alias("hash")).distinct()
    return rows.withColumn("content", F.when(F.col("_old"), _note(F.col("name"), F.lit(" Seen in a previous window."))).otherwise(F.col("content"))).drop("_h", "_old"), new


def tfidf(rows: DataFrame, keys: list[str], corpus: list[str], stop: list[str] | None = None) -> DataFrame:
    """Sparse vectors: ``keys``, token, weight = count / length * (ln((N + 1) / (df + 1)) + 1), over each ``corpus`` group."""
    t = rows.select(*dict.fromkeys([*keys, *corpus]), F.explode(tokens(F.col("content"))).alias("token"))
    if stop:
        t = t.where(~F.col("token").isin(*stop))
    tf = t.groupBy(*dict.fromkeys([*corpus, *keys]), "token").agg(F.count("*").alias("n"))
    total = Window.partitionBy(*dict.fromkeys([*corpus, *keys]))
    df = Window.partitionBy(*corpus, "token")
    size = rows.groupBy(*corpus).agg(F.count("*").alias("_rows"))
    tf = tf.withColumn("_len", F.sum("n").over(total)).withColumn("_df", F.count("*").over(df)).join(size, corpus)
    idf = F.log((F.col("_rows") + 1) / (F.col("_df") + 1)) + 1
    return tf.withColumn("weight", F.col("n") / F.col("_len") * idf).drop("n", "_len", "_df", "_rows")


def near_by_cosine(rows: DataFrame, threshold: float = 0.80, groups: F.Column | None = None) -> DataFrame:
    """(conv_id, src, dst, similarity): each row points to the next later row of its type whose TF-IDF cosine reaches the
    threshold. ``groups``: condition on ``_m``, the number of rows of a type (2 or more always)."""
    own = rows.where(~F.col("policy").isin(*LOCKED)).withColumn("_m", F.count("*").over(Window.partitionBy("conv_id", "ctype")))
    own = own.where((F.col("_m") >= 2) & (groups if groups is not None else F.lit(True))).select("conv_id", "ctype", "idx", "content")
    v = tfidf(own, ["conv_id", "ctype", "idx"], ["conv_id", "ctype"])
    norm = v.groupBy("conv_id", "idx").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    v = v.join(norm, ["conv_id", "idx"]).withColumn("weight", F.col("weight") / F.col("norm")).drop("norm")
    a, b = v.alias("a"), v.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("conv_id", "ctype", "token")]
    pairs = a.join(b, [*same, F.col("a.idx") < F.col("b.idx")]).groupBy(F.col("a.conv_id").alias("conv_id"), F.col("a.idx").alias("src"), F.col("b.idx").alias("dst")).agg(F.sum(F.col("a.weight") * F.col("b.weight")).alias("similarity"))
    pairs = pairs.where(F.col("similarity") >= threshold)
    return pairs.groupBy("conv_id", "src").agg(F.min("dst").alias("dst"), F.min_by("similarity", "dst").alias("similarity"))


HASHES, BANDS, SHINGLE = 128, 16, 5


@F.pandas_udf(ArrayType(IntegerType()))
def _signature(texts: pd.Series) -> pd.Series:
    """MinHash values of the character 5-grams of each text, by array operations over a bounded run of them at a time."""
    rng = np.random.default_rng(42)
    a = rng.integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, HASHES, np.uint64)
    out = []
    for t in texts:
        c = np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        n = max(len(c) - SHINGLE + 1, 1)
        h = np.zeros(n, np.uint64)
        for j in range(min(SHINGLE, len(c))):
            h = h * np.uint64(0x9E3779B97F4A7C15) + c[j : j + n]
        h = np.unique((h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9))
        sig = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(h), 4096):
            np.minimum(sig, (h[i : i + 4096, None] * a + b).min(axis=0), out=sig)
        out.append((sig >> np.uint64(33)).astype(np.int32))
    return pd.Series(out, dtype=object)


def near_by_minhash(rows: DataFrame, threshold: float = 0.80, groups: F.Column | None = None) -> DataFrame:
    """As :func:`near_by_cosine`, by 128 MinHash values of lowered character 5-grams in 16 bands; similarity is the share of
    equal values."""
    own = rows.where(~F.col("policy").isin(*LOCKED)).withColumn("_m", F.count("*").over(Window.partitionBy("conv_id", "ctype")))
    own = own.where((F.col("_m") >= 2) & (groups if groups is not None else F.lit(True)))
    own = own.select("conv_id", "ctype", "idx", _signature(F.lower(strip(F.col("content")))).alias("sig"))
    width = HASHES // BANDS
    banded = own.select("conv_id", "ctype", "idx", "sig", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(F.slice("sig", i * width + 1, width)))).alias("band", "key"))
    a, b = banded.alias("a"), banded.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("conv_id", "ctype", "band", "key")]
    equal = F.size(F.filter(F.arrays_zip(F.col("a.sig").alias("x"), F.col("b.sig").alias("y")), lambda z: z["x"] == z["y"])) / F.lit(float(HASHES))
    pairs = a.join(b, [*same, F.col("a.idx") < F.col("b.idx")]).select(F.col("a.conv_id").alias("conv_id"), F.col("a.idx").alias("src"), F.col("b.idx").alias("dst"), equal.alias("similarity"))
    pairs = pairs.where(F.col("similarity") >= threshold)
    return pairs.groupBy("conv_id", "src").agg(F.min("dst").alias("dst"), F.min_by("similarity", "dst").alias("similarity"))


def near(rows: DataFrame, threshold: float = 0.80) -> DataFrame:
    """Types with five rows or more by MinHash, smaller ones by cosine."""
    return near_by_minhash(rows, threshold, F.col("_m") >= 5).unionByName(near_by_cosine(rows, threshold, F.col("_m") < 5))


def mark(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """The older row of an edge becomes a reference to the newer."""
    e = edges.select("conv_id", F.col("src").alias("idx"), F.col("dst").alias("_dst"))
    note = F.concat(F.lit("[Similar content is in message #"), F.col("_dst").cast("string"), F.lit(".]"))
    return rows.join(e, ["conv_id", "idx"], "left").withColumn("content", F.when(F.col("_dst").isNotNull(), note).otherwise(F.col("content"))).drop("_dst")


def packed(parts, joiner: str, most: int = CHUNK_WORDS) -> F.Column:
    """Greedy packing of text parts into chunks of at most ``most`` words, as a fold that starts anew on overflow."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("now"), F.lit(0).alias("n"))

    def step(acc, p):
        w = word_count(p)
        full = (acc["n"] + w > most) & acc["now"].isNotNull()
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]).alias("done"),
            F.when(full | acc["now"].isNull(), p).otherwise(F.concat(acc["now"], F.lit(joiner), p)).alias("now"),
            F.when(full, w).otherwise(acc["n"] + w).alias("n"),
        )

    return F.aggregate(parts, start, step, lambda acc: F.when(acc["now"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"]))))


def chunks(content, ctype) -> F.Column:
    paragraphs = packed(F.split(content, r"\n\s*\n"), "\n\n")
    code = F.filter(F.split(content, r"(?m)^(?=\s*(?:def |class |function |async |export ))"), lambda x: F.length(strip(x)) > 0)
    return F.when((ctype == "CODE_BLOCK") & (F.size(code) > 1), packed(code, "\n")).otherwise(paragraphs)


def chunked(rows: DataFrame, least_words: int = CHUNK_ROW_WORDS) -> DataFrame:
    """Repeated chunks of long rows become markers that name the row and the first 60 characters of their first copy."""
    long_ = ~F.col("policy").isin(*LOCKED) & (word_count(F.col("content")) >= least_words)
    own = rows.where(long_).select("conv_id", "idx", chunks(F.col("content"), F.col("ctype")).alias("_c")).where(F.size("_c") > 1)
    each = own.select("conv_id", "idx", F.posexplode("_c").alias("pos", "chunk")).withColumn("_h", content_hash(F.col("chunk")))
    w = Window.partitionBy("conv_id", "_h").orderBy("idx", "pos")
    each = each.withColumns({"_n": F.row_number().over(w), "_o": F.first("idx").over(w), "_l": strip(F.substring(F.first("chunk").over(w), 1, 60))})
    marker = F.concat(F.lit("[Duplicate chunk — see message "), F.col("_o").cast("string"), F.lit(": "), F.col("_l"), F.lit("]"))
    each = each.withColumn("chunk", F.when(F.col("_n") > 1, marker).otherwise(F.col("chunk")))
    new = each.groupBy("conv_id", "idx").agg(F.max("_n").alias("_most"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "chunk"))), lambda x: x["chunk"]), "\n\n").alias("_new")).where("_most > 1")
    return rows.join(new.select("conv_id", "idx", "_new"), ["conv_id", "idx"], "left").withColumn("content", F.coalesce("_new", "content")).drop("_new")


def dependents(edges: DataFrame) -> DataFrame:
    """(conv_id, idx, n): rows that others point to."""
    return edges.groupBy("conv_id", F.col("dst").alias("idx")).agg(F.count("*").alias("n"))
