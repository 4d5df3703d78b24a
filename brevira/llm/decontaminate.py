"""Benchmark decontamination by winnowing.

Every window of ``span`` consecutive words holds ``span - k + 1`` k-grams; winnowing keeps the least k-gram hash of
each such window, on the training side and on the test side, so two texts that share ``span`` words share a
kept fingerprint at the same place of both. Fingerprints are joined, each hit names a diagonal (document
position minus item position), and the words are compared along the whole diagonal: runs of ``span`` equal words
or more are hits. Items shorter than ``span`` are one window of their own length and are looked up by
the hash of all their words.

The test side is handled in blocks of at most ``BLOCK_BYTES`` of text, each broadcast (its size is bounded by
the block) and run against all documents; documents are never shuffled and never cut.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import folders, remove, shared_dir
from .common import add_columns, grams, stash, word_hashes

SPAN = 10
K = 4
#: Bytes of benchmark text that one broadcast block holds; larger benchmarks take several passes.
BLOCK_BYTES = 16 << 20
COLUMNS = "_n_words long, _hits array<struct<s:int,e:int>>, _items array<string>"


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the least hash (the rightmost of equal ones) of every window."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.empty(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(hashes[::-1], window)
    at = len(hashes) - 1 - (np.arange(n) + view.argmin(axis=1))
    return np.unique(at)


class Words:
    """Words of a text: hashes ``h``, and the words themselves with one space between (``plain``, each at ``at`` to ``to``)."""

    def __init__(self, text: str | None):
        self.h, starts, ends, low = word_hashes(text)
        if len(self.h):
            edge = np.zeros(len(low) + 1, np.int8)
            edge[starts], edge[ends] = 1, -1
            kept = np.cumsum(edge[:-1]).astype(bool)
            inner = ends[:-1]
            plain = low.copy()
            plain[inner], kept[inner] = 32, True
            place = np.concatenate(([0], np.cumsum(kept)))
            self.plain, self.at, self.to = plain[kept].tobytes(), place[starts], place[ends]

    def run(self, a: int, b: int) -> bytes:
        return self.plain[self.at[a] : self.to[b - 1]]


def near_runs(places: np.ndarray, gap: int) -> list[tuple[int, int]]:
    """First and last of each run of ascending places that are at most ``gap`` apart."""
    cut = np.flatnonzero(np.diff(places) > gap)
    return list(zip(places[np.append(0, cut + 1)].tolist(), places[np.append(cut, len(places) - 1)].tolist(), strict=True))


class Index:
    """Fingerprints of one block of items."""

    def __init__(self, items: list[tuple[str, str | None]], span: int = SPAN, k: int = K):
        self.span, self.k = span, min(k, span)
        self.ids, self.items, self.short = [], [], {}
        fp, owner, place = [], [], []
        for name, text in items:
            w = Words(text)
            h = w.h
            if not len(h):
                continue
            i = len(self.ids)
            self.ids.append(name)
            self.items.append(w)
            if len(h) < span:
                self.short.setdefault(len(h), {}).setdefault(int(grams(h, len(h))[0]), []).append(i)
                continue
            g = grams(h, self.k)
            at = winnow(g, span - self.k + 1)
            fp.append(g[at])
            owner.append(np.full(len(at), i))
            place.append(at)
        cat = lambda xs, t: np.concatenate(xs).astype(t) if xs else np.empty(0, t)
        fp, owner, place = cat(fp, np.uint64), cat(owner, np.int64), cat(place, np.int64)
        order = np.lexsort((place, owner, fp))
        self.fp, self.owner, self.place = fp[order], owner[order], place[order]
        self.short_keys = {m: np.array(sorted(x), np.uint64) for m, x in self.short.items()}

    def _diagonals(self, g: np.ndarray, at: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """For each item that shares fingerprints: ranges of document minus item positions that hold all of those that match.

        Where a fingerprint recurs closely (a word repeated over and over) its places count as runs, so that ranges
        are made from few ends and not from all pairs of places; what a range holds beside the matches is compared in vain.
        """
        out: dict[int, list[tuple[int, int]]] = {}
        lo, hi = np.searchsorted(self.fp, g, "left"), np.searchsorted(self.fp, g, "right")
        known = np.flatnonzero(hi > lo)
        known = known[np.argsort(g[known], kind="stable")]
        for some in np.split(known, np.flatnonzero(np.diff(g[known])) + 1) if len(known) else ():
            a, b = int(lo[some[0]]), int(hi[some[0]])
            mine = near_runs(at[some], self.span)
            owner = self.owner[a:b]
            ends = [0, *(np.flatnonzero(np.diff(owner)) + 1).tolist(), b - a]
            for x, y in zip(ends[:-1], ends[1:], strict=True):
                theirs = near_runs(self.place[a + x : a + y], self.span)
                out.setdefault(int(owner[x]), []).extend((p - t, q - s) for p, q in mine for s, t in theirs)
        return out

    def hits(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[int]]:
        """Number of words, hit word ranges and the items that hit."""
        doc = Words(text)
        h = doc.h
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        if len(h) >= self.span and len(self.fp):
            g = grams(h, self.k)
            at = winnow(g, self.span - self.k + 1)
            for item, ranges in self._diagonals(g[at], at).items():
                w, found = self.items[item], []
                own = w.h
                for first, last in merged([(a, b + 1) for a, b in ranges]):
                    for shift in range(first, last):
                        a, b = max(0, shift), min(len(h), shift + len(own))
                        if b - a < self.span:
                            continue
                        eq = np.diff((h[a:b] == own[a - shift : b - shift]).view(np.int8), prepend=np.int8(0), append=np.int8(0))
                        s, e = np.flatnonzero(eq == 1), np.flatnonzero(eq == -1)
                        long_ = e - s >= self.span
                        found += [(int(a + x), int(a + y)) for x, y in zip(s[long_], e[long_], strict=True) if doc.run(a + x, a + y) == w.run(a + x - shift, a + y - shift)]
                if found:
                    items.add(item)
                    spans += merged(found)
        for m, keys in self.short_keys.items():
            if len(h) >= m:
                g = grams(h, m)
                p = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
                for x in np.flatnonzero(keys[p] == g).tolist():
                    for item in self.short[m][int(g[x])]:
                        if doc.run(x, x + m) == self.items[item].run(0, m):
                            spans.append((x, x + m))
                            items.add(item)
        return len(h), merged(spans), items


def merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(map(tuple, spans)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def blocks_of(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, str | None]]]:
    """Items in blocks of bounded size, one block on the driver at a time; each is a folder of its own, so the benchmark is
    read once."""
    b = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("i"), F.col(text_col).alias("t")).where("t is not null")
    size = b.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    if size <= block_bytes:
        yield [(r.i, r.t) for r in b.distinct().collect()]
        return
    n = -(-int(size) * 2 // block_bytes)
    spark = benchmark.sparkSession
    path = f"{shared_dir(spark)}/benchmark-{uuid.uuid4().hex}"
    b.withColumn("part", F.pmod(F.xxhash64("i", "t"), F.lit(n))).repartition("part").write.partitionBy("part").parquet(path)
    folders(spark).append(path)
    for part in range(n):
        own = spark.read.schema("i string, t string, part long").parquet(path).where(F.col("part") == part).select("i", "t")
        items = [(r.i, r.t) for r in own.distinct().collect()]
        if items:
            yield items
    remove(spark, [path])


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = SPAN, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with _n_words, _hits (array of [start, end) word ranges) and _items (ids as strings).

    Null and wordless texts have no words and no hits; repeated rows are judged each; equal item ids count
    once; items without words match nothing; a null item id is called "null". An empty table gives no rows. Other columns
    pass through, except that the three output names replace columns of the same name. Of several blocks each is run by
    itself over what the one before it has written, so that a task holds the index of one block.
    """
    out, at = docs, 0
    for items in blocks_of(benchmark, item_col, item_text_col, block_bytes):
        if at:
            out = stash(docs.sparkSession, out, "contamination")
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def make(sent=sent, at=at):
            index = Index(sent.value, span, k)

            def judge(texts, *before):
                n, hits, ids = [], [], []
                for i, text in enumerate(texts):
                    words, spans, own = index.hits(text)
                    old, names = (before[0][i], before[1][i]) if at else ([], [])
                    n.append(words)
                    hits.append([{"s": a, "e": b} for a, b in merged([*spans, *((x["s"], x["e"]) for x in old)])])
                    ids.append(sorted({*names, *(index.ids[x] for x in own)}))
                return n, hits, ids

            return judge

        out = add_columns(out, [text_col, "_hits", "_items"] if at else [text_col], COLUMNS, make)
        at += 1
    return out


def report(found: DataFrame) -> DataFrame:
    """The digest columns of the contract, from :func:`contamination`'s output."""
    n_hit = F.aggregate("_hits", F.lit(0).cast("long"), lambda acc, x: acc + x["e"] - x["s"])
    return found.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def sha(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


#: DuckDB: windows of 10 words by a plain join; ``{docs}`` is the table judged.
SQL = r"""
WITH dw AS (SELECT rid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM {docs}) t),
bw AS (SELECT cast(item_id AS varchar) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bs AS (SELECT item_id, w, least(len(w), 10) AS m FROM bw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM bs) x),
lens AS (SELECT DISTINCT m FROM win),
dg AS (SELECT rid, m, i, array_to_string(w[i:i + m - 1], ' ') AS g FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, lens WHERE len(w) >= m) x),
hit AS (SELECT rid, item_id, i, dg.m AS m FROM dg JOIN win USING (m, g)),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + m)) AS p FROM hit) x GROUP BY rid),
its AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hit GROUP BY rid)
SELECT dw.doc_id AS doc_id, cast(len(w) AS bigint) AS n_words, cast(coalesce(n_hit, 0) AS bigint) AS n_hit, cast(coalesce(n_items, 0) AS bigint) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""
