"""URL filters: a trie over reversed host labels and path segments, broadcast; the longest matching entry decides."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, stash

#: The contract's entries as (host, path, verdict).
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
#: Entries that one broadcast trie holds at most; it is built on the driver. More are judged in several passes.
MAX_RULES = 1_000_000


@dataclass
class _Node:
    hosts: dict[str, _Node] = field(default_factory=dict)
    paths: dict[str, _Node] = field(default_factory=dict)
    #: Entries that end inside the next path segment: (start of that segment, rule, verdict), longest start first.
    ends: list[tuple[str, str, str]] = field(default_factory=list)


class Trie:
    """Entries (host, path prefix, verdict). A host fits itself and its subdomains. Of several that fit the one with the
    most host labels decides, then the longest path; of equal entries the later one; "" fits any host."""

    def __init__(self, rules):
        self.root = _Node()
        for host, path, verdict in rules:
            node = self.root
            for label in reversed(host.lower().split(".")) if host else ():
                node = node.hosts.setdefault(label, _Node())
            *whole, start = path.split("/")
            for s in whole:
                node = node.paths.setdefault(s, _Node())
            node.ends = sorted([(start, host + path, verdict), *(x for x in node.ends if x[0] != start)], key=lambda x: -len(x[0]))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the entry that decides."""
        node, best = self.root, []
        nodes = [node]
        for label in reversed(host.split(".")) if host else ():
            node = node.hosts.get(label)
            if node is None:
                break
            nodes.append(node)
        segments = path.split("/")
        for top in reversed(nodes):
            at, best = top, None
            for s in segments:
                best = next(((rule, verdict) for start, rule, verdict in at.ends if s.startswith(start)), best)
                at = at.paths.get(s)
                if at is None:
                    break
            if best:
                return best
        return None


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): host from the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; the path from there to
    ``?``, ``#`` or the end. Null and texts without ``://`` give two empty strings."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    for stop in "?#":
        rest = rest.split(stop, 1)[0]
    host, slash, path = rest.partition("/")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), slash + path


def judged(pages: DataFrame, rules=None, url_col: str = "url", default: str = "allow", most: int = MAX_RULES) -> DataFrame:
    """``pages`` with host, path, rule (null where none fits) and verdict (``default`` where none fits).

    Every row is judged alone, repeated ones too; an empty table gives no rows; columns of those four names are replaced, other
    columns pass through. More than ``most`` rules are broadcast in several tries, one after the other over what was written
    before, and the longest entry of all decides.
    """
    rules = RULES if rules is None else list(rules)
    spark = pages.sparkSession
    pages = pages.drop("host", "path", "rule", "verdict")
    made = free("_made", pages)

    def judge(part):
        sent = spark.sparkContext.broadcast(Trie(part))

        @F.pandas_udf("host string, path string, rule string, verdict string, labels int, length int")
        def found(urls: pd.Series) -> pd.DataFrame:
            trie, rows = sent.value, []
            for u in urls:
                host, path = split_url(u)
                rule, verdict = trie.find(host, path) or (None, default)
                own, _, start = (rule or "").partition("/")
                rows.append((host, path, rule, verdict, -1 if rule is None else own.count(".") + bool(own), len(start)))
            return pd.DataFrame(rows, columns=["host", "path", "rule", "verdict", "labels", "length"])

        return found(url_col)

    out = pages.withColumn(made, judge(rules[:most]))
    for i in range(most, len(rules), most):
        other = free("_other", out)
        rank = lambda c: F.struct(f"{c}.labels", f"{c}.length")
        out = stash(spark, out, "judged").withColumn(other, judge(rules[i : i + most]))
        out = out.withColumn(made, F.when(rank(other) >= rank(made), F.col(other)).otherwise(F.col(made))).drop(other)
    return out.select(*[F.col(f"`{c}`") for c in pages.columns], *[F.col(f"{made}.{c}") for c in ("host", "path", "rule", "verdict")])


SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
p AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(substr(r, length(regexp_extract(r, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
m AS (SELECT page_id, host, path, CASE
  WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/7') THEN 'example.com/en/7'
  WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/en/') THEN 'com/en/'
  WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/de/8') THEN 'example.net/de/8'
  WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/de/') THEN 'net/de/'
  WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/es/') THEN 'org/es/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' ELSE 'allow' END AS verdict FROM m
"""
