"""Line cleanup, re-read collapse and observation masking."""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from ..functions import constants as K
from ..functions.text import content_hash, contains_any, entropy, strip

POLICIES = ("MODERATE", "AGGRESSIVE", "STACK")
MOST_LINES, RUN = 100, 3
KEY = ["conv_id", "idx"]


def in_line():
    return Window.partitionBy(*KEY).orderBy("pos")


def exploded(rows: DataFrame, *more: str) -> DataFrame:
    """(conv_id, idx, pos, line) of eligible rows, and the columns ``more``."""
    return rows.where(F.col("policy").isin(*POLICIES)).select(*KEY, *more, F.posexplode(F.split("content", "\n")).alias("pos", "line"))


def joined(lines: DataFrame) -> DataFrame:
    """(conv_id, idx, text): lines put together again in order."""
    return lines.groupBy(*KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"))


def blank_runs(lines: DataFrame) -> DataFrame:
    """Only the first of neighbouring blank lines stays."""
    blank = strip(F.col("line")) == ""
    return lines.withColumn("_b", blank).withColumn("_p", F.lag("_b").over(in_line())).where(~(F.col("_b") & F.coalesce("_p", F.lit(False)))).drop("_b", "_p")


def low_entropy(lines: DataFrame, threshold: float | Column = 1.8) -> DataFrame:
    """Lines below so many bits per character go, unless blank or with a path or a digit."""
    s = strip(F.col("line"))
    return lines.where((s == "") | s.rlike(K.PATH) | s.rlike(r"\d") | (F.round(entropy(s), 9) >= threshold))


def pattern(line) -> Column:
    return F.regexp_replace(F.regexp_replace(strip(line), r"\d+", "#"), r"""['"].*?['"]""", "STR")


def repeated(lines: DataFrame, run: int = RUN) -> DataFrame:
    """Of longer runs of lines of one pattern the first three and a marker with the number left out stay."""
    lines = lines.withColumn("_p", pattern(F.col("line")))
    lines = lines.withColumn("_i", F.sum(F.when(F.col("_p") == F.lag("_p").over(in_line()), 0).otherwise(1)).over(in_line()))
    own = Window.partitionBy(*KEY, "_i")
    lines = lines.withColumns({"_n": F.count("*").over(own), "_k": F.row_number().over(own.orderBy("pos"))})
    long_ = (F.col("_n") > run) & (F.col("_p") != "")
    lines = lines.where(~long_ | (F.col("_k") <= run + 1))
    marker = F.concat(F.lit("[... "), (F.col("_n") - run).cast("string"), F.lit(" similar lines omitted ...]"))
    return lines.withColumn("line", F.when(long_ & (F.col("_k") == run + 1), marker).otherwise(F.col("line"))).drop("_p", "_i", "_n", "_k")


def without_boilerplate(c) -> Column:
    for p in K.BOILERPLATE:
        c = F.regexp_replace(c, p, "")
    return c


def truncated(lines: DataFrame, most: int = MOST_LINES) -> DataFrame:
    """Of more than ``most`` lines the first and last half and a marker stay."""
    half = most // 2
    own = Window.partitionBy(*KEY)
    lines = lines.withColumns({"_k": F.row_number().over(in_line()), "_n": F.count("*").over(own)})
    lines = lines.where((F.col("_n") <= most) | (F.col("_k") <= half + 1) | (F.col("_k") > F.col("_n") - half))
    marker = F.concat(F.lit("[... "), (F.col("_n") - most).cast("string"), F.lit(f" lines omitted — showing first {half} and last {half} lines ...]"))
    return lines.withColumn("line", F.when((F.col("_n") > most) & (F.col("_k") == half + 1), marker).otherwise(F.col("line"))).drop("_k", "_n")


_STRIP, _DIGITS = " \t\n\x0b\f\r", re.compile(r"[0-9]+")
_QUOTED = re.compile("['\"][^\n\r\u0085\u2028\u2029]*?['\"]")
_PATH = re.compile(K.PATH, re.ASCII)


def _bits(s: str) -> float:
    n = len(s)
    return round(-sum(k / n * math.log2(k / n) for k in Counter(s).values()), 9)


def _without_blank_runs(lines: list[str]) -> list[str]:
    return [x for i, x in enumerate(lines) if x.strip(_STRIP) or not i or lines[i - 1].strip(_STRIP)]


def _informative(line: str, threshold: float) -> bool:
    s = line.strip(_STRIP)
    return not s or _DIGITS.search(s) is not None or _PATH.search(s) is not None or _bits(s) >= threshold


def _shape(line: str) -> str:
    return _QUOTED.sub("STR", _DIGITS.sub("#", line.strip(_STRIP)))


def first_pass(text: str, threshold: float, run: int = RUN) -> str:
    """:func:`blank_runs`, :func:`low_entropy` and :func:`repeated` on one text."""
    lines = [x for x in _without_blank_runs(text.split("\n")) if _informative(x, threshold)]
    out: list[str] = []
    for shape, own in itertools.groupby(lines, _shape):
        group = list(own)
        out += group if len(group) <= run or not shape else [*group[:run], f"[... {len(group) - run} similar lines omitted ...]"]
    return "\n".join(out)


def second_pass(text: str, most: int = MOST_LINES) -> str:
    """:func:`blank_runs` and :func:`truncated` on one text."""
    lines, half = _without_blank_runs(text.split("\n")), most // 2
    if len(lines) > most:
        lines = [*lines[:half], f"[... {len(lines) - most} lines omitted — showing first {half} and last {half} lines ...]", *lines[len(lines) - half :]]
    return "\n".join(lines)


@F.pandas_udf(StringType())
def _first(texts: pd.Series, thresholds: pd.Series) -> pd.Series:
    return pd.Series([first_pass(t, x) for t, x in zip(texts, thresholds, strict=True)], dtype=object)


@F.pandas_udf(StringType())
def _second(texts: pd.Series) -> pd.Series:
    return pd.Series([second_pass(t) for t in texts], dtype=object)


def cleaned(rows: DataFrame, threshold: float | Column = 1.8) -> DataFrame:
    """All line rules in their order; rows of other policies stay as they are.

    Every rule is local to a row, so rows are not shuffled: one pass in Arrow batches, the patterns of boilerplate inside the
    engine, and a second pass.
    """
    least = threshold if isinstance(threshold, Column) else F.lit(threshold)
    text = _second(without_boilerplate(_first("content", least.cast("double"))))
    return rows.withColumn("content", F.when(F.col("policy").isin(*POLICIES), text).otherwise(F.col("content")))


def cleaned_by_lines(rows: DataFrame, threshold: float = 1.8) -> DataFrame:
    """:func:`cleaned` as a chain of the single rules over exploded lines, to hold it against."""
    text = joined(repeated(low_entropy(blank_runs(exploded(rows)), threshold)))
    again = text.select(*KEY, F.posexplode(F.split(without_boilerplate(F.col("text")), "\n")).alias("pos", "line"))
    new = joined(truncated(blank_runs(again)))
    return rows.join(new, KEY, "left").withColumn("content", F.when(F.col("policy").isin(*POLICIES), F.coalesce("text", F.lit(""))).otherwise(F.col("content"))).drop("text")


def label(c) -> Column:
    """A path in the text, else its first line, at most 60 characters."""
    first = strip(F.substring_index(c, "\n", 1))
    return F.coalesce(F.nullif(F.regexp_extract(c, K.PATH, 0), F.lit("")), F.when(F.length(first) > 60, F.concat(F.substring(first, 1, 57), F.lit("..."))), F.nullif(first, F.lit("")), F.lit("content"))


def rereads(rows: DataFrame) -> DataFrame:
    """Tool results of over 200 characters that were read before become pointers."""
    eligible = F.col("policy").isin(*POLICIES) & F.col("ctype").isin("TOOL_RESULT_TEXT", "TOOL_RESULT_JSON", "CODE_BLOCK") & (F.length("content") > 200)
    rows = rows.withColumn("_h", F.when(eligible, content_hash(F.col("content"))))
    rows = rows.withColumn("_f", F.min("idx").over(Window.partitionBy("conv_id", "_h")))
    note = F.concat(F.lit("[Previously read: "), label(F.col("content")), F.lit(" — see message "), F.col("_f").cast("string"), F.lit("]"))
    return rows.withColumn("content", F.when(F.col("_h").isNotNull() & (F.col("_f") < F.col("idx")), note).otherwise(F.col("content"))).drop("_h", "_f")


def masked(rows: DataFrame, critical: DataFrame | None = None, least_results: int = 10, least_chars: int = 500, force: bool | Column = False) -> DataFrame:
    """Long tool results of conversations with many of them become a header, a key line and up to ten critical lines.

    ``critical``: conv_id, needles (array of strings).
    """
    c = F.col("content")
    result = F.col("ctype").isin("TOOL_RESULT_TEXT", "TOOL_RESULT_JSON")
    rows = rows.withColumn("_n", F.sum(result.cast("int")).over(Window.partitionBy("conv_id")))
    rows = rows.join(critical.select("conv_id", "needles"), "conv_id", "left") if critical is not None else rows.withColumn("needles", F.lit(None).cast("array<string>"))
    first = strip(F.substring_index(c, "\n", 1))
    key = F.coalesce(F.nullif(F.regexp_extract(c, K.PATH, 0), F.lit("")), F.substring(first, 1, 40))
    lines = F.split(strip(c), "\n")
    stripped = F.transform(lines, lambda x: strip(x))
    signs = F.transform(F.regexp_extract_all(c, F.lit(f"({K.DEFINITION})"), F.lit(1)), lambda x: strip(x))
    last = F.element_at(stripped, -1)
    summary = (
        F.when(F.size(signs) > 0, F.array_join(F.slice(signs, 1, 4), "; "))
        .when(F.size(lines) <= 3, F.substring(c, 1, 200))
        .otherwise(F.substring(F.concat(F.array_join(F.filter(F.slice(stripped, 1, 2), lambda x: x != ""), " | "), F.lit(" ... "), last), 1, 200))
    )
    head = F.concat(F.lit("[Tool: "), F.coalesce("name", F.lit("tool")), F.when(key != "", F.concat(F.lit('("'), key, F.lit('")'))).otherwise(""), F.lit(" — "), (F.size(F.split(c, "\n"))).cast("string"), F.lit(" lines]"))
    kept = F.slice(F.array_distinct(F.filter(stripped, lambda x: (x != "") & contains_any(x, F.coalesce("needles", F.array().cast("array<string>"))))), 1, 10)
    text = F.concat(head, F.lit("\nKey: "), summary, F.when(F.size(kept) > 0, F.concat(F.lit("\nPreserved: "), F.array_join(kept, " | "))).otherwise(""))
    on = result & ~F.col("protected") & (F.length(c) >= least_chars) & ((force if isinstance(force, Column) else F.lit(force)) | (F.col("_n") >= least_results))
    return rows.withColumn("content", F.when(on, text).otherwise(c)).drop("_n", "needles")
