"""Sharding by minimax contiguous partition.

Atomic groups (rows of equal text) stand in the order of their text's SHA-256. The smallest shard capacity
with which a greedy left-to-right filling needs no more than ``n`` shards is found by binary search, and the
order is cut there.

The driver never sees all groups: it works on totals of key-prefix bins, which bound the capacity from below
(bins may be cut anywhere) and from above (bins are whole), and only the bins in which a cut can still fall are
split by longer prefixes, until both bounds agree. Among partitions of that least capacity the one is cut whose shards
come closest to the mean of what is left, so that a group larger than the mean leaves no empty shards behind it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stash

#: Hex digits by which a bin is split; groups that are fetched one by one in the last round, at most.
DIGITS, EXACT = 3, 50_000
#: Parts into which the rows of one key prefix are dealt when slots are numbered.
SALT = 64
NO_TEXT = "0" * 64


@dataclass
class Items:
    """Consecutive pieces of the order: key prefix, size, number of groups, largest group."""

    prefix: list[str]
    size: np.ndarray
    groups: np.ndarray
    largest: int

    def __post_init__(self):
        self.at = np.concatenate(([0], np.cumsum(self.size, dtype=np.int64)))


def filled(at: np.ndarray, whole: np.ndarray, n: int, capacity: int) -> list[int]:
    """Ends of n shards filled from the left; pieces that aren't ``whole`` may be cut anywhere."""
    ends, s = [], 0
    for _ in range(n):
        reach = s + capacity
        i = int(np.searchsorted(at, reach, "right")) - 1
        s = int(at[-1]) if i >= len(at) - 1 else reach if not whole[i] else int(at[i])
        ends.append(s)
    return ends


def least_capacity(at: np.ndarray, whole: np.ndarray, n: int, low: int) -> int:
    """Binary search of the smallest capacity, from ``low`` up, with which n shards hold everything."""
    total = int(at[-1])
    low = max(low, -(-total // n))
    high = max(low, total)
    while low < high:
        mid = (low + high) // 2
        if filled(at, whole, n, mid)[-1] >= total:
            high = mid
        else:
            low = mid + 1
    return low


def levelled(at: np.ndarray, n: int, capacity: int) -> list[int]:
    """Ends of n shards within ``capacity``, each as near the mean of the rest as the order allows; else greedy ends."""
    total = int(at[-1])
    rest = [total]
    for _ in range(n - 1):  # from where on the shards behind still hold everything
        rest.append(int(at[np.searchsorted(at, rest[-1] - capacity, "left")]))
    ends, s = [], 0
    for k in range(n - 1):
        goal = s + (total - s) / (n - k)
        i = int(np.searchsorted(at, goal))
        near = min((int(x) for x in at[max(0, i - 1) : i + 1]), key=lambda x: abs(x - goal))
        most = int(at[np.searchsorted(at, s + capacity, "right") - 1])
        s = min(max(near, rest[n - 1 - k], s), most)
        ends.append(s)
    ends.append(total)
    return ends if max(np.diff([0, *ends]), default=0) <= capacity else filled(at, np.ones(len(at), bool), n, capacity)


def _bins(groups: DataFrame, digits: int) -> list[tuple[str, int, int, int]]:
    p = F.substring("key", 1, digits)
    return [tuple(r) for r in groups.groupBy(p.alias("p")).agg(F.sum("size"), F.count("*"), F.max("size")).orderBy("p").collect()]


def boundaries(groups: DataFrame, n: int, digits: int = DIGITS, exact: int = EXACT) -> tuple[int, list[str]]:
    """(least capacity, first key of each shard but the first); ``groups``: key (hex), size. "g" stands for no key."""
    found = _bins(groups, digits)
    if not found:
        return 0, ["g"] * (n - 1)
    items = Items([r[0] for r in found], np.array([r[1] for r in found], np.int64), np.array([r[2] for r in found]), max(r[3] for r in found))
    while True:
        whole = np.append(items.groups == 1, True)
        low = least_capacity(items.at, whole, n, items.largest)
        high = least_capacity(items.at, np.ones(len(whole), bool), n, items.largest)
        if low == high:
            break
        early, late = filled(items.at, np.ones(len(whole), bool), n, low), filled(items.at, whole, n, high)
        open_ = np.zeros(len(items.size), bool)
        for a, b in zip(early, late, strict=True):
            open_ |= (items.at[1:] > a) & (items.at[:-1] <= b)
        open_ &= items.groups > 1
        chosen = [p for p, o in zip(items.prefix, open_, strict=True) if o]
        # the shortest prefixes first, so that all that are split have one length
        length = min(map(len, chosen))
        chosen = [p for p in chosen if len(p) == length]
        own = groups.where(F.substring("key", 1, length).isin(chosen))
        many = sum(int(g) for p, g in zip(items.prefix, items.groups, strict=True) if p in set(chosen))
        split = _bins(own, 64 if many <= exact else length + digits)
        gone = set(chosen)
        rows = sorted([(p, int(s), int(g)) for p, s, g in zip(items.prefix, items.size, items.groups, strict=True) if p not in gone] + [r[:3] for r in split])
        items = Items([r[0] for r in rows], np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows]), items.largest)
    ends = levelled(items.at, n, high)
    starts = np.searchsorted(items.at, ends[:-1])
    return high, [items.prefix[i] if i < len(items.prefix) else "g" for i in starts]


def sharded(docs: DataFrame, n: int = 16, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32, law "bytes", shard, slot (gapless from 0), grown_shard (null).

    Null texts have size 1, CRC 0 and are one group, apart from the empty text's. Repeated rows each get a slot;
    null ids come first; an empty table gives no rows; extra columns are ignored.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    rows = stash(
        spark,
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            F.coalesce(F.sha2(text, 256), F.lit(NO_TEXT)).alias("key"),
        ),
        "rows",
    )
    groups = stash(spark, rows.groupBy("key").agg(F.sum("size").alias("size")), "groups")
    _, starts = boundaries(groups, n)
    shard = sum((F.col("key") >= F.lit(p)).cast("int") for p in starts) if starts else F.lit(0)
    placed = rows.withColumn("shard", shard.cast("int")).withColumn("_p", F.substring("key", 1, 2)).withColumn("_s", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)))
    part = ["shard", "_p", "_s"]
    # at most (256 + n) * SALT rows
    offsets = placed.groupBy(*part).agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.partitionBy("shard").orderBy("_p", "_s").rowsBetween(Window.unboundedPreceding, -1))).drop("_n")
    number = F.row_number().over(Window.partitionBy(*part).orderBy("key", "doc_id")) - 1
    out = placed.withColumn("_i", number).join(F.broadcast(offsets), part)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.coalesce("_before", F.lit(0)) + F.col("_i")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
