"""N-gram Jaccard join with Bayesian candidate pruning.

1. Each text becomes the set of its five-word shingles, a MinHash signature of 160 values, and 32 band keys of
   5 values each. Texts with the same words are one node; nodes, not rows, are compared.
2. Nodes that share a band key are candidates (a pair at similarity 0.8 shares none with probability 3e-6).
   Candidates compare their signatures 32 values at a time and are dropped as soon as the posterior
   probability of a similarity of at least the threshold is below ``tolerance``. A bucket reports no pairs but
   a spanning forest of its surviving pairs: nodes already tied together need no further comparison.
3. Components of those edges are small and tight. Inside each, all pairs are verified exactly on the shingle
   sets, as products of 0/1 matrices, in blocks of at most ``BLOCK`` nodes; link counts are summed per node, pairs
   are never written.
4. Verified links give the classes.

Buckets and components beyond a block are dealt out as pairs of blocks, so no group of any size meets in one
task. Nothing is capped or sampled.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, bounded, free, grams, mix, release, stash, word_hashes
from .components import components

WORDS, THRESHOLD, TOLERANCE = 5, 0.8, 1e-5
BANDS, ROWS, STEP = 32, 5, 32
#: Nodes that one task compares with each other: in a bucket (signatures), in a component (shingle sets).
BUCKET_BLOCK, BLOCK = 4096, 256
#: Shingles of the texts of one block, about (8 bytes each); a text alone may have more.
BLOCK_SHINGLES = 2_000_000
#: Columns of the 0/1 matrices that are held at a time.
WIDTH = 8192

_rng = np.random.default_rng(20260801)
_A = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingles(text: str | None, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, sorted distinct shingle hashes); a text of fewer words, but not none, is one shingle."""
    h = word_hashes(text)[0]
    return h, np.unique(grams(h, min(k, len(h)))) if len(h) else np.empty(0, np.uint64)


def signature(sh: np.ndarray) -> np.ndarray:
    out = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(sh), 2048):
        np.minimum(out, (sh[i : i + 2048, None] * _A + _B).min(axis=0), out=out)
    return out


@cache
def least_matches(threshold: float, tolerance: float, n_max: int = BANDS * ROWS, step: int = STEP) -> dict[int, int]:
    """For n compared one-byte values: the fewest equal ones at which the pair is kept.

    Equal bytes occur with p = J + (1 - J) / 256; J is uniform beforehand, so the posterior of p is a Beta
    density on [1/256, 1], integrated on a grid.
    """
    j = (np.arange(20000) + 0.5) / 20000
    p = j + (1 - j) / 256
    out = {}
    for n in range(step, n_max + 1, step):
        for m in range(n + 1):
            log = m * np.log(p) + (n - m) * np.log1p(-p)
            w = np.exp(log - log.max())
            if w[j >= threshold].sum() / w.sum() >= tolerance:
                out[n] = m
                break
    return out


def _sketch(k: int):
    def sketch(texts):
        node, size, sig, bands = [], [], [], []
        for text in texts:
            h, sh = shingles(text, k)
            s = signature(sh)
            key = s.reshape(BANDS, ROWS)
            b = np.arange(BANDS, dtype=np.uint64)
            for r in range(ROWS):
                b = mix(b + key[:, r])
            node.append(hashlib.md5(h.tobytes()).digest())
            size.append(len(sh))
            sig.append((mix(s) >> np.uint64(56)).astype(np.uint8).tobytes())
            bands.append(b.view(np.int64) if len(sh) else np.empty(0, np.int64))
        return node, size, sig, bands

    return sketch


def _runs(batches, key_cols: list[str]):
    """Groups of rows with equal keys from batches sorted by them."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        pdf = pd.concat([*held, pdf], ignore_index=True) if held else pdf
        keys = pdf[key_cols]
        change = (keys != keys.shift()).any(axis=1).to_numpy()
        at = np.flatnonzero(change)
        for a, b in zip(at[:-1], at[1:], strict=True):
            yield pdf.iloc[a:b]
        held = [pdf.iloc[at[-1] :]]
    if held:
        yield held[0]


def _forest(sig: np.ndarray, side: np.ndarray | None, keep: dict[int, int]) -> list[tuple[int, int]]:
    """Edges that tie together all nodes that surviving pairs tie together; ``side``: only pairs across it count
    when both sides are present (pairs of blocks)."""
    n, comp, out = len(sig), np.arange(len(sig)), []
    for i in range(n - 1):
        open_ = i + 1 + np.flatnonzero(comp[i + 1 :] != comp[i])
        if side is not None:
            open_ = open_[side[open_] != side[i]]
        match = np.zeros(len(open_), np.int64)
        for a in range(0, sig.shape[1], STEP):
            if not len(open_):
                break
            match += (sig[open_, a : a + STEP] == sig[i, a : a + STEP]).sum(axis=1)
            ok = match >= keep[a + STEP]
            open_, match = open_[ok], match[ok]
        for j in open_:
            if comp[j] != comp[i]:
                comp[comp == comp[j]] = comp[i]
                out.append((i, int(j)))
        if out and len(out) == n - 1:
            break
    return out


def _candidates(batches, keep):
    nodes_a, nodes_b = [], []
    for g in _runs(batches, ["bkey", *PAIR]):
        if len(g) < 2:
            continue
        node, sig = g["node"].tolist(), np.frombuffer(b"".join(g["sig"]), np.uint8).reshape(len(g), -1)
        own = g["own"].to_numpy()
        for i, j in _forest(sig, own if own.min() != own.max() else None, keep):
            nodes_a.append(node[i])
            nodes_b.append(node[j])
        if len(nodes_a) >= 10_000:
            yield pd.DataFrame({"u": nodes_a, "v": nodes_b})
            nodes_a, nodes_b = [], []
    yield pd.DataFrame({"u": nodes_a, "v": nodes_b})


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    n = len(sets)
    _, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    shared = count[col] > 1
    row, col = row[shared], col[shared]
    out = np.zeros((n, n), np.float64)
    if len(col):
        col = np.unique(col, return_inverse=True)[1]
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        for a in range(0, int(col[-1]) + 1, WIDTH):
            lo, hi = np.searchsorted(col, [a, a + WIDTH])
            m = np.zeros((n, min(WIDTH, int(col[-1]) + 1 - a)), np.float32)
            m[row[lo:hi], col[lo:hi] - a] = 1
            out += m @ m.T
    return out


def _verify(batches, threshold: float):
    """Rows (node, links, u, v): link counts of a node within one pair of blocks, or a tree edge of verified links."""
    for g in _runs(batches, ["comp", *PAIR]):
        node, weight, own = g["node"].tolist(), g["n_texts"].to_numpy(np.int64), g["own"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in g["shingles"]]
        size = np.array([len(s) for s in sets], np.float64)
        both = _overlaps(sets)
        link = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
        np.fill_diagonal(link, False)
        if own.min() != own.max():
            link &= own[:, None] != own[None, :]
        links = (link * weight[None, :]).sum(axis=1)
        rows = [(node[i], int(links[i]), None, None) for i in np.flatnonzero(links)]
        left = np.ones(len(g), bool)
        for i in range(len(g)):
            todo = [i] if left[i] else []
            left[i] = False
            while todo:
                x = todo.pop()
                for y in np.flatnonzero(link[x] & left):
                    left[y] = False
                    todo.append(y)
                    rows.append((None, 0, node[x], node[int(y)]))
        if rows:
            yield pd.DataFrame(rows, columns=["node", "links", "u", "v"])
    release()


def _dealt(df: DataFrame, blocks: F.Column) -> DataFrame:
    """Rows dealt to the pairs of the ``blocks`` of their group: ``pair_a`` and ``pair_b`` name the pair, ``own`` the row's block."""
    df = df.withColumn("_n", blocks.cast("long")).withColumn("own", F.when(F.col("_n") > 1, F.pmod(F.xxhash64("node"), F.col("_n"))).otherwise(F.lit(0).cast("long")))
    df = df.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    return df.withColumn("pair_a", F.least("own", "_o")).withColumn("pair_b", F.greatest("own", "_o")).drop("_n", "_o")


PAIR = ["pair_a", "pair_b"]


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", k: int = WORDS, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, bucket_block: int = BUCKET_BLOCK, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One row per document: doc_id, thash (64-bit hash of its text), class_id (least doc_id of all that verified
    links and copies tie together), copy_id (least doc_id with the same words), n_copies (rows with the same
    words), n_links (other texts of similarity at least ``threshold``, each distinct text once), first_of_class (this is
    the row that stands for its class; of repeated equal rows all are marked).

    Texts without words, null ones too, are never linked nor grouped: class_id is their own doc_id. Null
    doc_ids sort before others. Extra columns are ignored.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("thash", F.xxhash64("text"))
    made = add_columns(src, ["text"], "node binary, size long, sig binary, bands array<long>", lambda: _sketch(k))
    sketched = stash(spark, made.drop("text"), "sketch")
    worded = sketched.where("size > 0")
    texts = worded.groupBy("node", "thash").agg(F.count("*").alias("n"), F.min("doc_id").alias("d"), F.max(F.col("doc_id").isNull()).alias("o"), F.max("size").alias("size"))
    nodes = stash(spark, texts.groupBy("node").agg(F.count("*").alias("n_texts"), F.max("size").alias("n_shingles"), F.sum("n").alias("n_copies"), F.min_by(F.struct("d", "thash", "o"), F.struct(~F.col("o"), "d", "thash")).alias("rep")), "nodes")
    reps = nodes.select("node", F.when(F.col("rep.o"), None).otherwise(F.col("rep.d")).alias("rep_id"), F.col("rep.thash").alias("rep_hash"), "n_texts", "n_copies", "n_shingles")

    # candidates: band keys met by several nodes
    bands = worded.select("node", F.explode("bands").alias("bkey")).distinct()
    crowded = bands.groupBy("bkey").agg(F.count("*").alias("n")).where("n > 1")
    met = bands.join(crowded, "bkey")
    sigs = worded.select("node", "sig").dropDuplicates(["node"])
    dealt = _dealt(met, F.ceil(F.col("n") / F.lit(bucket_block))).join(sigs, "node").select("bkey", *PAIR, "own", "node", "sig")
    keep = least_matches(threshold, tolerance)
    near = dealt.repartition("bkey", *PAIR).sortWithinPartitions("bkey", *PAIR).mapInPandas(lambda it: _candidates(it, keep), "u binary, v binary")
    tied = stash(spark, components(spark, near), "tied")

    # exact verification inside each component
    n_tied = tied.count()
    about = tied.join(reps.select("node", "rep_id", "rep_hash", "n_texts", "n_shingles"), "node")
    # a component's blocks hold about so many nodes and shingles at most, so that long texts don't meet in great numbers
    sizes = about.groupBy("comp").agg(F.greatest(F.ceil(F.count("*") / F.lit(block)), F.ceil(F.sum("n_shingles") / F.lit(block_shingles))).alias("blocks"))
    plan = about.drop("n_shingles").join(sizes, "comp")
    plan = bounded(stash(spark, plan, "plan"), n_tied)
    text = src.join(plan, src["doc_id"].eqNullSafe(plan["rep_id"]) & (src["thash"] == plan["rep_hash"])).select("comp", "node", "n_texts", "blocks", "text")
    made = add_columns(text, ["text"], "shingles binary", lambda: lambda texts: ([shingles(t, k)[1].tobytes() for t in texts],), drop=["text"])
    grouped = _dealt(made, F.col("blocks")).repartition("comp", *PAIR).sortWithinPartitions("comp", *PAIR, "node")

    def verify(batches):
        once = (x[~x.duplicated(["comp", *PAIR, "node"])] if len(x) else x for x in _adjacent(batches))
        return _verify(once, threshold)

    verified = stash(spark, grouped.select("comp", *PAIR, "own", "node", "n_texts", "shingles").mapInPandas(verify, "node binary, links long, u binary, v binary"), "verified")
    links = verified.where("links > 0").groupBy("node").agg(F.sum("links").alias("n_links"))
    classes = components(spark, verified.where("u is not null").select("u", "v"))
    named = reps.join(classes, "node", "left").join(links, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    first = named.groupBy("comp").agg(F.min_by(F.struct(F.col("rep_id").alias("i"), F.col("rep_hash").alias("h")), F.struct("rep_id", "rep_hash")).alias("first"))
    about = named.join(first, "comp").select("node", F.col("rep_id").alias("copy_id"), "n_copies", (F.coalesce("n_links", F.lit(0)) + F.col("n_texts") - 1).alias("n_links"), "first")
    out = sketched.select("doc_id", "thash", "node", "size").join(about, "node", "left")
    worded_row = F.col("size") > 0
    return out.select(
        "doc_id",
        "thash",
        F.when(worded_row, F.col("first.i")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(worded_row, F.col("copy_id")).otherwise(F.col("doc_id")).alias("copy_id"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        (~worded_row | (F.col("doc_id").eqNullSafe(F.col("first.i")) & (F.col("thash") == F.col("first.h")))).alias("first_of_class"),
    )


def _adjacent(batches):
    """Batches with the last row's group held back, so that repeated rows of a node never straddle two batches."""
    held = None
    for pdf in batches:
        pdf = pd.concat([held, pdf], ignore_index=True) if held is not None else pdf
        if not len(pdf):
            continue
        last = pdf.iloc[-1]
        same = (pdf["comp"] == last["comp"]) & (pdf["pair_a"] == last["pair_a"]) & (pdf["pair_b"] == last["pair_b"]) & (pdf["node"] == last["node"])
        held = pdf[same].iloc[:1]
        yield pdf[~same]
    if held is not None:
        yield held


def one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text and others) without the documents that stand behind another of their class.

    Of equal rows with equal doc_ids one is kept. Other columns pass through, whatever their names.
    """
    spark = docs.sparkSession
    found = stash(spark, found.select("doc_id", "thash", "first_of_class"), "found")
    gone = found.where("not first_of_class").distinct()
    n = gone.count()
    own_id, own_hash, row_hash = (free(x, docs) for x in ("_doc_id", "_thash", "_row_hash"))
    gone = bounded(gone.select(F.col("doc_id").alias(own_id), F.col("thash").alias(own_hash)), n)
    src = docs.withColumn(row_hash, F.xxhash64("text"))
    out = src.join(gone, src["doc_id"].eqNullSafe(F.col(own_id)) & (src[row_hash] == F.col(own_hash)), "left_anti")
    if found.where("first_of_class").groupBy("doc_id", "thash").count().where("count > 1").limit(1).count():
        out = out.dropDuplicates(["doc_id", row_hash])
    return out.drop(row_hash)
