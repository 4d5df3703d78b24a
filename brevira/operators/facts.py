"""Facts, the ledger, protected and critical strings, reasoning chains, arcs and corrections."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window

from ..functions import constants as K
from ..functions.text import all_matches, holds, matches_if, sentences, strip
from .classify import in_order

#: ``K.FILE_PATH`` with the same matches; words without a dot are passed in one look.
FILE_PATH = K.FILE_PATH.replace(r"""(?:^|\s|["'])""", r"""(?:^|[\s"'])(?=[\w\-/\\:]*+\.)""", 1)
EXTRACTABLE = ("TOOL_RESULT_TEXT", "TOOL_RESULT_JSON", "ERROR_TRACE", "CODE_BLOCK", "OLD_CONVERSATION", "ASSISTANT_REASONING")
#: Order numbers of a row's facts: those of its calls' arguments come first, ``PER_CALL`` for each call, then those of its text.
STRIDE, PER_CALL, TEXT_FACTS = 1_000_000_000_000, 1_000_000, 500_000_000_000


def _facts(category: str, confidence: float, contents) -> Column:
    """Array of (category, content, confidence)."""
    return F.transform(contents, lambda x: F.struct(F.lit(category).alias("category"), x.alias("content"), F.lit(confidence).alias("confidence")))


def text_facts(c, name, turn) -> Column:
    """All facts of a text, by category in a fixed order."""
    action = F.when(F.coalesce(name.isin(*K.EDIT_TOOLS), F.lit(False)), "modified").otherwise("read")
    label = lambda text, xs: F.transform(xs, lambda x: F.concat(F.lit(text), x))
    digit = c.rlike(r"\d")
    files = F.transform(matches_if(c.rlike(r"\.\w"), c, FILE_PATH),lambda p: F.concat(p, F.lit(" — "), action, F.lit(" at turn "), turn.cast("string")))
    hints = (holds(c, "class"), holds(c, "def"), holds(c, "function"), holds(c, "async"), holds(c, "("))
    code = F.filter(F.concat(*[matches_if(h, c, p) for h, p in zip(hints, K.CODE_ENTITIES, strict=True)]), lambda x: F.length(x) > 2)
    tracking = F.filter(all_matches(c, K.TRACKING), lambda x: x.rlike("[0-9]") & x.rlike("[A-Z]"))
    return F.concat(
        _facts("FILES", 1.0, files),
        _facts("ERRORS", 1.0, F.transform(matches_if(holds(c, "Error:", "Exception:", "FAIL:"), c, K.ERROR_LINE), lambda x: strip(x))),
        _facts("IDENTIFIERS", 0.8, label("Reference: ", matches_if(c.rlike(r":\d"), c, K.LINE_REF))),
        _facts("IDENTIFIERS", 0.7, label("URL: ", F.transform(matches_if(holds(c, "://"), c, K.URL), lambda x: F.regexp_replace(x, r"""[.,;)"']+$""", "")))),
        _facts("IDENTIFIERS", 0.7, label("Code entity: ", code)),
        _facts("IDENTIFIERS", 0.8, label("Date: ", matches_if(c.rlike(r"\d{4}"), c, K.DATE))),
        _facts("IDENTIFIERS", 0.8, label("Tracking: ", tracking)),
        _facts("IDENTIFIERS", 0.85, label("Statute: ", matches_if(digit, c, K.STATUTE))),
        _facts("IDENTIFIERS", 0.8, label("Amount: ", matches_if(holds(c, "$"), c, K.MONEY))),
        _facts("IDENTIFIERS", 0.7, label("Metric: ", matches_if(holds(c, "%"), c, K.PERCENT))),
        _facts("IDENTIFIERS", 0.7, label("Term: ", all_matches(c, K.TERM))),
    )


def decisions(c) -> Column:
    """Sentences that decide and do not hedge, at most 200 characters of each."""
    return _facts("DECISIONS", 0.85, F.transform(F.filter(sentences(c), lambda s: s.rlike(K.DECISION_SENTENCE) & ~s.rlike(K.HEDGE)), lambda s: F.substring(strip(s), 1, 200)))


_UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.I)
_ORDER = re.compile(r"\b[A-Z]{2,4}-\d{4,}\b")


def argument_facts(arguments: str | None, name: str | None, turn: int) -> list[dict]:
    """Paths, URLs, UUIDs and order ids anywhere in JSON call arguments; of other texts, the paths."""
    out: list[dict] = []
    add = lambda cat, content, conf: out.append({"category": cat, "content": content, "confidence": conf})
    path = re.compile(K.FILE_PATH)
    edit = (name or "") in K.EDIT_TOOLS

    def walk(v, key):
        if isinstance(v, dict):
            for k, x in v.items():
                walk(x, k)
        elif isinstance(v, list):
            for x in v:
                walk(x, key)
        elif isinstance(v, str):
            for m in path.finditer(v):
                add("FILES", f"{m[1]} — {'modified' if edit else 'referenced'} at turn {turn}", 1.0)
            for m in re.finditer(K.URL, v):
                add("IDENTIFIERS", f"URL: {m[1]}", 0.9)
            for m in _UUID.finditer(v):
                add("IDENTIFIERS", f"UUID: {m[0]}" + (f" ({key})" if key else ""), 0.9)
            for m in _ORDER.finditer(v):
                add("IDENTIFIERS", f"ID: {m[0]}" + (f" ({key})" if key else ""), 0.9)

    try:
        walk(json.loads(arguments or ""), None)
    except (ValueError, RecursionError):
        for m in path.finditer(arguments or ""):
            add("FILES", f"{m[1]} — {'modified' if edit else 'referenced'} at turn {turn}", 1.0)
    return out


_DDL = "array<struct<category:string,content:string,confidence:double>>"


_FACTS = ArrayType(StructType([StructField("category", StringType()), StructField("content", StringType()), StructField("confidence", DoubleType())]))


@F.pandas_udf(_FACTS)
def _argument_facts(args: pd.Series, names: pd.Series, turns: pd.Series) -> pd.Series:
    return pd.Series([argument_facts(a, n, int(t)) for a, n, t in zip(args, names, turns, strict=True)], dtype=object)


def extracted(rows: DataFrame, arguments: bool = True) -> DataFrame:
    """The ledger: conv_id, seq, category, content, turn, confidence; of equal contents the first stays.

    Order: intent, active context, then per row decisions, calls and text facts.
    """
    c = F.col("content")
    user = F.when(F.col("role") == "user", 1).otherwise(0)
    r = rows.where("not compressed").withColumn("_short", F.when(F.col("role").isin("user", "assistant"), F.substring(strip(c), 1, 300)))
    r = r.withColumn("turn", F.greatest(F.sum(user).over(in_order()), F.lit(1)).cast("int"))
    place = F.row_number().over(in_order())
    r = r.withColumn("_p", place)
    r = r.withColumn("_nu", F.when(F.col("role") == "user", F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("idx"))))
    r = r.withColumn("_nr", F.row_number().over(Window.partitionBy("conv_id", "role").orderBy(F.col("idx").desc())))
    short = F.col("_short")
    head = r.where(F.length(short) > 0)
    first = head.where("role = 'user' and _nu = 1").select("conv_id", F.lit(0).cast("long").alias("seq"), F.lit("INTENT").alias("category"), short.alias("content"), F.lit(1).alias("turn"), F.lit(0.9).alias("confidence"))
    last = head.where("_nr = 1").select("conv_id", F.when(F.col("role") == "user", 1).otherwise(2).cast("long").alias("seq"), F.lit("ACTIVE_CONTEXT").alias("category"), F.concat(F.when(F.col("role") == "user", "Current task: ").otherwise("Last response: "), short).alias("content"), "turn", F.when(F.col("role") == "user", 0.9).otherwise(0.8).alias("confidence"))
    none = F.array().cast(_DDL)
    calls = F.coalesce(F.col("tool_calls"), F.array().cast("array<struct<id:string,type:string,name:string,arguments:string>>"))
    used = _facts("IDENTIFIERS", 0.9, F.transform(F.filter(calls, lambda x: F.coalesce(x["name"], F.lit("")) != ""), lambda x: F.concat(F.lit("Tool used: "), x["name"])))
    own = F.concat(F.when(F.col("role") == "assistant", decisions(c)).otherwise(none), used, F.when(F.col("ctype").isin(*EXTRACTABLE), text_facts(c, F.col("name"), F.col("turn"))).otherwise(none))
    # of an outer explode the engine does not evaluate the array once more to leave out empty ones
    each = r.select("conv_id", "_p", "turn", F.posexplode_outer(own).alias("pos", "f")).where("pos is not null").select("conv_id", (F.col("_p").cast("long") * STRIDE + F.col("pos") + TEXT_FACTS).cast("long").alias("seq"), "f.category", "f.content", "turn", "f.confidence")
    out = first.unionByName(last).unionByName(each)
    if arguments:
        a = r.where(F.size(calls) > 0).select("conv_id", "_p", "turn", F.posexplode("tool_calls").alias("k", "t")).where(F.length("t.arguments") > 2)
        a = a.select("conv_id", "_p", "turn", "k", F.posexplode(_argument_facts("t.arguments", "t.name", "turn")).alias("pos", "f"))
        out = out.unionByName(a.select("conv_id", (F.col("_p").cast("long") * STRIDE + F.col("k").cast("long") * PER_CALL + F.col("pos")).cast("long").alias("seq"), "f.category", "f.content", "turn", "f.confidence"))
    w = Window.partitionBy("conv_id", F.sha2("content", 256)).orderBy("seq")
    return out.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def core(content) -> Column:
    return strip(F.substring_index(content, " — ", 1))


def protected_strings(facts: DataFrame) -> DataFrame:
    """(conv_id, needle): identifiers of all facts, of three characters or more, file names as well."""
    c = core(F.col("content"))
    for p in K.FACT_LABELS:
        c = F.when((F.col("category") == "IDENTIFIERS") & c.startswith(p), F.substr(c, F.lit(len(p) + 1))).otherwise(c)
    f = facts.select("conv_id", "category", c.alias("c"))
    name = F.substring_index(F.replace(F.col("c"), F.lit("\\"), F.lit("/")), "/", -1)
    both = F.array_compact(F.array(F.col("c"), F.when((F.col("category") == "FILES") & F.col("c").rlike(r"[/\\]"), name)))
    return f.select("conv_id", F.explode(both).alias("needle")).where(F.length("needle") >= 3).distinct()


def critical_strings(facts: DataFrame) -> DataFrame:
    """(conv_id, needle): paths with a folder and an extension, longer errors, and values of eight identifier kinds."""
    f = facts.select("conv_id", "category", core(F.col("content")).alias("c"))
    path = F.replace(F.col("c"), F.lit("\\"), F.lit("/"))
    name = F.substring_index(path, "/", -1)
    stem = F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), r"[.\-_]", "")
    good = path.contains("/") & name.contains(".") & (F.length(name) >= 3) & ~stem.rlike("^[0-9]+$")
    files = F.when((F.col("category") == "FILES") & good, F.array_compact(F.array(F.when(F.length("c") >= 8, F.col("c")), F.when(F.length(name) >= 5, name))))
    errors = F.when((F.col("category") == "ERRORS") & (F.length("c") >= 10), F.array(F.col("c")))
    value = strip(F.regexp_extract("c", r"^(?:" + "|".join(K.HIGH_VALUE) + r")([\s\S]*)$", 1))
    ids = F.when((F.col("category") == "IDENTIFIERS") & (F.length(value) >= 3), F.array(value))
    return f.select("conv_id", F.explode(F.coalesce(files, errors, ids)).alias("needle")).distinct()


def needles(strings: DataFrame) -> DataFrame:
    """(conv_id, needles): strings of a conversation as one array."""
    return strings.groupBy("conv_id").agg(F.array_sort(F.collect_set("needle")).alias("needles"))


SECTIONS = ("INTENT", "FILES", "DECISIONS", "ERRORS", "ACTIVE_CONTEXT")


def rendered(facts: DataFrame) -> DataFrame:
    """(conv_id, text, tokens): the ledger as text by sections; tokens are a quarter of its length."""
    order = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("category")), F.lit(0)), F.lit(len(SECTIONS) + 1))
    s = facts.withColumn("_o", order).groupBy("conv_id", "category", "_o").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "content"))), lambda x: F.concat(F.lit("- "), x["content"])), "\n").alias("body"))
    s = s.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "category", "body"))), lambda x: F.concat(F.lit("## "), x["category"], F.lit("\n"), x["body"])), "\n\n").alias("text"))
    return s.withColumn("tokens", F.floor(F.length("text") / 4).cast("long"))


def updated(facts: DataFrame, changes: DataFrame) -> DataFrame:
    """Facts of a category and content replaced (``changes``: conv_id, category, content, new_content)."""
    c = changes.select("conv_id", "category", "content", F.col("new_content").alias("_new"))
    return facts.join(c, ["conv_id", "category", "content"], "left").withColumn("content", F.coalesce("_new", "content")).drop("_new").select(*facts.columns)


def chains(rows: DataFrame) -> DataFrame:
    """Logical edges: a row with a marker of inference depends on the nearest earlier assistant row."""
    before = F.last(F.when(F.col("role") == "assistant", F.col("idx")), ignorenulls=True).over(in_order().rowsBetween(Window.unboundedPreceding, -1))
    r = rows.where("not compressed").select("conv_id", "idx", "role", F.col("content").rlike(K.CHAIN).alias("_chain")).withColumn("dst", before)
    return r.where(F.col("_chain") & F.col("dst").isNotNull()).select("conv_id", F.lit("logical").alias("kind"), F.col("idx").alias("src"), "dst")


def keywords(c) -> Column:
    stop = F.array(*map(F.lit, K.ARC_STOP_WORDS))
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"\b([a-z]\w{2,})\b"), F.lit(1))), stop)


def arcs(rows: DataFrame) -> DataFrame:
    """conv_id, question, deliberations, resolution (first later one sharing two keywords, or null), resolved."""
    c = F.col("content")
    r = rows.where(F.length("content") >= 10).withColumn("k", keywords(c))
    q = r.where((F.col("role") == "user") & (c.rlike(K.QUESTION) | c.rlike(r"(?i)\bshould (?:we|I)\b") | c.rlike(K.ARC_QUESTION)))
    q = q.select("conv_id", F.col("idx").alias("question"), "k").withColumn("next", F.lead("question").over(Window.partitionBy("conv_id").orderBy("question"))).where(F.size("k") >= 2)
    a = r.where("role = 'assistant'").select("conv_id", F.col("idx").alias("i"), F.col("k").alias("ak"), c.rlike(K.RESOLUTION).alias("res"), c.rlike(K.DELIBERATION).alias("del")).where("res or del")
    j = q.join(a, ["conv_id"], "left")
    after = F.col("i") > F.col("question")
    fit = after & F.col("res") & (F.size(F.array_intersect("k", "ak")) >= 2)
    weigh = after & ~F.col("res") & F.col("del") & (F.col("next").isNull() | (F.col("i") < F.col("next")))
    out = j.groupBy("conv_id", "question").agg(F.array_sort(F.collect_list(F.when(weigh, F.col("i")))).alias("deliberations"), F.min(F.when(fit, F.col("i"))).alias("resolution"))
    return out.withColumn("resolved", F.col("resolution").isNotNull())


def entities(c) -> Column:
    stop = list(K.ARC_STOP_WORDS)
    lower = lambda xs: F.transform(xs, lambda x: F.lower(x))
    calls = F.filter(lower(F.regexp_extract_all(c, F.lit(r"\b(\w+)\s*\("), F.lit(1))), lambda x: ~x.isin(*stop) & (F.length(x) > 2))
    return F.array_distinct(F.concat(lower(F.regexp_extract_all(c, F.lit(r"([\w./\\]+\.\w{1,8})"), F.lit(1))), lower(F.regexp_extract_all(c, F.lit(r"(\b[a-z]+(?:[A-Z][a-z]+)+\b)"), F.lit(1))), calls))


def supersessions(rows: DataFrame, reach: int = 20) -> DataFrame:
    """conv_id, superseded, superseding, reason: the earliest of the previous rows that shares an entity with a correcting
    assistant row. A band join on row numbers: both sides are dealt by blocks of ``reach`` rows."""
    c = F.col("content")
    r = rows.withColumn("n", F.row_number().over(in_order())).withColumn("e", entities(c))
    new = r.where((F.col("role") == "assistant") & (F.length("content") >= 20) & c.rlike(K.SUPERSESSION) & (F.size("e") > 0))
    low = F.lower(c)
    reason = F.when(low.rlike("actually|turns out|correction|not|but"), "correction").when(low.rlike("all|pass|now|updated"), "status_update").otherwise("refinement")
    block = F.floor(F.col("n") / reach)
    new = new.select("conv_id", F.col("idx").alias("superseding"), F.col("n").alias("n2"), F.col("e").alias("e2"), reason.alias("reason"), F.explode(F.array(block, block - 1)).alias("b"))
    old = r.where(F.col("role").isin("assistant", "tool") & (F.size("e") > 0)).select("conv_id", F.col("idx").alias("superseded"), "n", "e", block.alias("b"))
    j = new.join(old, ["conv_id", "b"]).where((F.col("n") < F.col("n2")) & (F.col("n") >= F.col("n2") - reach) & F.arrays_overlap("e", "e2"))
    return j.groupBy("conv_id", "superseding", "reason").agg(F.min("superseded").alias("superseded"))


def signals(arc_rows: DataFrame, corrections: DataFrame) -> DataFrame:
    """Counts per conversation: questions detected, resolved, unresolved, and corrections by reason."""
    a = arc_rows.groupBy("conv_id").agg(F.count("*").alias("questions"), F.sum(F.col("resolved").cast("long")).alias("resolved"))
    s = corrections.groupBy("conv_id").agg(*[F.sum((F.col("reason") == x).cast("long")).alias(x) for x in ("correction", "status_update", "refinement")])
    names = ["questions", "resolved", "correction", "status_update", "refinement"]
    out = a.join(s, "conv_id", "full_outer").select("conv_id", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names])
    return out.withColumn("unresolved", F.col("questions") - F.col("resolved"))
