"""Task scores, position factors, reorder, token budget, tool integrity, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import constants as K
from ..functions.text import contains_any, token_count, tokens
from .classify import conv, in_order



def whole():
    return conv().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def task_keywords(task) -> Column:
    return F.array_except(F.array_distinct(tokens(task)), F.array(*map(F.lit, K.TASK_STOP_WORDS)))


def scored(rows: DataFrame, tasks: DataFrame | None = None, drop_below: float = 0.05, needles: DataFrame | None = None) -> DataFrame:
    """Rows with relevance by share of the task's keywords, critical rows lifted to the threshold, position factors applied
    in conversations of more than ten rows, and rows below the threshold left out.

    ``tasks``: conv_id, task. Without a task, or with one of stop words only, a row scores 0.5. A conversation that would
    lose every row keeps all.
    """
    r = rows.join(tasks.select("conv_id", task_keywords(F.col("task")).alias("_k")), "conv_id", "left") if tasks is not None else rows.withColumn("_k", F.lit(None).cast("array<string>"))
    r = r.join(needles.select("conv_id", "needles"), "conv_id", "left") if needles is not None else r.withColumn("needles", F.lit(None).cast("array<string>"))
    asked = F.coalesce(F.size("_k"), F.lit(0)) > 0
    share = F.size(F.array_intersect(F.col("_k"), tokens(F.col("content")))) / F.size("_k")
    score = F.when(F.col("protected"), 1.0).when(asked, share).otherwise(0.5)
    critical = contains_any(F.col("content"), F.coalesce("needles", F.array().cast("array<string>"))) | (F.col("shield") == "PRESERVE")
    score = F.when(asked & ~F.col("protected") & (score < drop_below) & critical, F.lit(drop_below)).otherwise(score)
    r = r.withColumn("relevance", score).withColumns({"_n": F.count("*").over(conv()), "_p": F.row_number().over(in_order()) - 1})
    at = F.col("_p") / F.greatest(F.col("_n") - 1, F.lit(1))
    factor = F.when((F.col("_n") <= 10) | F.col("protected"), 1.0).when(at < 0.15, 1.1).when(at > 0.85, 1.15).otherwise(0.9)
    r = r.withColumn("relevance", F.col("relevance") * factor)
    r = r.withColumn("_keep", F.col("protected") | (F.round("relevance", 9) >= drop_below))
    r = r.withColumn("_some", F.max("_keep").over(whole()))
    return r.where(F.col("_keep") | ~F.col("_some")).drop("_k", "needles", "_n", "_p", "_keep", "_some")


def blocks(rows: DataFrame) -> DataFrame:
    """_block: number of the block of each row; a call and the results of it that follow at once are one."""
    ids = F.transform(F.coalesce("tool_calls", F.array().cast("array<struct<id:string,type:string,name:string,arguments:string>>")), lambda x: x["id"])
    r = rows.withColumn("_ids", ids)
    last = F.last(F.when(F.size("_ids") > 0, F.struct("idx", "_ids")), ignorenulls=True).over(in_order().rowsBetween(Window.unboundedPreceding, -1))
    r = r.withColumn("_call", last)
    # a result continues the block if everything since its call does; a repeated id starts anew
    fits = F.col("tool_call_id").isNotNull() & (F.size("_ids") == 0) & F.coalesce(F.array_contains("_call._ids", F.col("tool_call_id")), F.lit(False))
    r = r.withColumn("_fit", fits)
    run = Window.partitionBy("conv_id", "_call.idx").orderBy("idx")
    seen = F.row_number().over(Window.partitionBy("conv_id", "_call.idx", "tool_call_id").orderBy("idx"))
    r = r.withColumn("_fit", F.col("_fit") & (seen == 1))
    r = r.withColumn("_fit", F.col("_fit") & (F.sum(F.when(F.col("_fit"), 0).otherwise(1)).over(run) == 0))
    return r.withColumn("_block", F.sum(F.when(F.col("_fit"), 0).otherwise(1)).over(in_order())).drop("_ids", "_call", "_fit")


def valid(rows: DataFrame, order: list[str]) -> DataFrame:
    """(conv_id, ok): every result follows its call with nothing else in between, in the given order."""
    w = conv().orderBy(*order)
    ids = F.transform(F.coalesce("tool_calls", F.array().cast("array<struct<id:string,type:string,name:string,arguments:string>>")), lambda x: x["id"])
    r = rows.withColumn("_ids", ids).withColumn("_g", F.sum(F.when(F.size("_ids") > 0, 1).otherwise(0)).over(w))
    g = Window.partitionBy("conv_id", "_g").orderBy(*order)
    r = r.withColumn("_open", F.first("_ids").over(g)).withColumn("_k", F.row_number().over(g))
    again = F.row_number().over(Window.partitionBy("conv_id", "_g", "tool_call_id").orderBy(*order))
    n = F.size(F.array_distinct("_open"))
    result = F.col("tool_call_id").isNotNull() & (F.size("_ids") == 0)
    bad = F.when(result, (F.col("_g") == 0) | ~F.array_contains("_open", F.col("tool_call_id")) | (again > 1)).otherwise((F.size("_ids") == 0) & (F.col("_g") > 0) & (F.col("_k") - 2 < n))
    return r.withColumn("_bad", F.coalesce(bad, F.lit(False))).groupBy("conv_id").agg((~F.max("_bad")).alias("ok"))


def reordered(rows: DataFrame) -> DataFrame:
    """place: errors and system blocks first, recent ones and the query last, the rest between; source order in a
    conversation where that would part a result from its call."""
    b = blocks(rows)
    lead = F.first("ctype").over(Window.partitionBy("conv_id", "_block").orderBy("idx"))
    b = b.withColumn("_pri", F.when(lead.isin("ERROR_TRACE", "SYSTEM_PROMPT"), 0).when(lead.isin("RECENT_TURN", "USER_QUERY"), 2).otherwise(1))
    ok = valid(b, ["_pri", "_block", "idx"])
    b = b.join(ok, "conv_id").withColumn("_pri", F.when(F.col("ok"), F.col("_pri")).otherwise(0))
    return b.withColumn("place", F.row_number().over(conv().orderBy("_pri", "_block", "idx")) - 1).drop("_pri", "_block", "ok")


def head_tail(c, strings=None) -> Column:
    """Of more than ten lines the first and last tenth, three at least, and lines with ledger strings; gaps are marked."""
    lines = F.split(c, "\n")
    n = F.size(lines)
    keep = F.greatest(F.lit(3), F.floor(n / 10).cast("int"))
    empty = F.array().cast("array<string>")
    found = F.coalesce(strings, empty) if strings is not None else empty
    at = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i < keep) | (i >= n - keep) | contains_any(F.get(lines, i), found))
    parts = F.transform(at, lambda i, k: F.when((k > 0) & (i > F.get(at, k - 1) + 1), F.concat(F.lit("[... "), (i - F.get(at, k - 1) - 1).cast("string"), F.lit(" lines omitted ...]\n"), F.get(lines, i))).otherwise(F.get(lines, i)))
    return F.when(n <= 10, c).otherwise(F.array_join(parts, "\n"))


def effective(budget: int | Column, zone_tokens) -> Column:
    """What zones 1 and 2 leave of a budget, 100 at least."""
    own = budget if isinstance(budget, Column) else F.lit(budget)
    return F.greatest(F.lit(100).cast("long"), own - F.coalesce(zone_tokens, F.lit(0)))


def within(rows: DataFrame, budgets: DataFrame, edges: DataFrame | None = None, critical: DataFrame | None = None, protected: DataFrame | None = None) -> DataFrame:
    """Rows fitted to ``budgets`` (conv_id, budget): the least relevant droppable rows go while the total is over it.

    Processed order is (relevance, idx); a row is processed while the running total before it is over the budget. A row with
    a critical string is cut instead of dropped; references to a dropped origin get a cut copy of it. If the total is still
    over and more than one row is left, the largest row that is not protected loses its middle.
    """
    r = rows.join(budgets.select("conv_id", "budget"), "conv_id", "left")
    r = r.withColumn("tokens", token_count(F.col("content")))
    r = r.withColumn("_total", F.sum("tokens").over(conv()))
    for table_, name in ((critical, "_crit"), (protected, "_prot")):
        r = r.join(table_.select("conv_id", F.col("needles").alias(name)), "conv_id", "left") if table_ is not None else r.withColumn(name, F.lit(None).cast("array<string>"))
    empty = F.array().cast("array<string>")
    calls = rows.where(F.size("tool_calls") > 0).select("conv_id", "idx", F.explode("tool_calls.id").alias("id"))
    results = rows.where("tool_call_id is not null").select("conv_id", "idx", F.col("tool_call_id").alias("id"))
    pairs = calls.join(results.select("conv_id", "id").distinct(), ["conv_id", "id"], "left_semi").select("conv_id", "idx").unionByName(results.join(calls.select("conv_id", "id").distinct(), ["conv_id", "id"], "left_semi").select("conv_id", "idx")).distinct()
    r = r.join(pairs.withColumn("_pair", F.lit(True)), ["conv_id", "idx"], "left")
    droppable = ~F.col("protected") & F.col("_pair").isNull() & ~F.col("ctype").isin("CODE_BLOCK", "ERROR_TRACE")
    r = r.withColumn("_d", droppable & F.col("budget").isNotNull())
    cut = F.col("_d") & contains_any(F.col("content"), F.coalesce("_crit", empty))
    r = r.withColumn("_cut", F.when(cut, head_tail(F.col("content"), F.col("_prot"))))
    r = r.withColumn("_delta", F.when(F.col("_d"), F.col("tokens") - F.coalesce(token_count(F.col("_cut")), F.lit(0))).otherwise(0))
    order = Window.partitionBy("conv_id", "_d").orderBy("relevance", "idx")
    r = r.withColumn("_sum", F.sum("_delta").over(order))
    before = F.greatest(F.lit(0), F.coalesce(F.max("_sum").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    r = r.withColumn("_hit", F.col("_d") & (F.col("_total") > F.col("budget")) & (F.col("_total") - before > F.col("budget")))
    gone = F.col("_hit") & F.col("_cut").isNull()
    r = r.withColumn("content", F.when(F.col("_hit"), F.coalesce("_cut", "content")).otherwise(F.col("content")))
    r = r.withColumn("tokens", F.when(F.col("_hit") & F.col("_cut").isNotNull(), token_count(F.col("content"))).otherwise(F.col("tokens")))
    if edges is not None:
        origin = r.where(F.col("_hit")).select("conv_id", F.col("idx").alias("dst"), head_tail(F.col("content")).alias("_copy"))
        copies = edges.where("kind = 'dedup'").join(origin, ["conv_id", "dst"]).select("conv_id", F.col("src").alias("idx"), "_copy")
        r = r.join(copies, ["conv_id", "idx"], "left").withColumn("content", F.when(~gone, F.coalesce("_copy", "content")).otherwise(F.col("content"))).drop("_copy")
    r = r.where(~gone)
    r = r.withColumns({"_left": F.sum("tokens").over(conv()), "_rows": F.count("*").over(conv()), "_free": F.max(~F.col("protected")).over(conv())})
    can = (F.col("ctype") != "SYSTEM_PROMPT") & (~F.col("protected") | ~F.col("_free"))
    r = r.withColumn("_rank", F.when(can, F.row_number().over(Window.partitionBy("conv_id", can).orderBy(F.col("tokens").desc(), "idx"))))
    over = F.col("_left") - F.col("budget")
    r = r.withColumn("content", F.when((F.col("_rank") == 1) & (over > 0) & (F.col("_rows") > 1), without_middle(F.col("content"), over)).otherwise(F.col("content")))
    return r.select(*rows.columns)


def without_middle(c, over) -> Column:
    """A text less 3.5 characters for each token over the budget, from the middle, at line ends where they are near."""
    away = F.floor(over * F.lit(3.5)).cast("int")
    n = F.length(c)
    keep = n - away
    half = F.floor(keep / 2).cast("int")
    low = F.greatest(F.lit(0), half - 100)
    part = F.substr(c, low + 1, half + 100 - low)
    back = F.length(part) - F.instr(F.reverse(part), "\n")
    start = F.when((F.instr(part, "\n") > 0) & (low + back > 0), low + back).otherwise(half)
    end0 = n - (keep - start)
    low2 = F.greatest(F.lit(0), end0 - 100)
    fwd = F.instr(F.substr(c, low2 + 1, end0 + 100 - low2), "\n")
    end = F.when((fwd > 0) & (low2 + fwd - 1 > 0), low2 + fwd - 1).otherwise(end0)
    return F.when(away >= n, "[Content removed to fit budget.]").otherwise(F.concat(F.substr(c, F.lit(1), start), F.lit("\n[... "), (end - start).cast("string"), F.lit(" characters omitted to fit budget ...]\n"), F.substr(c, end + 1, n)))


def orphans(rows: DataFrame) -> DataFrame:
    """(conv_id, id, side): results without a call, and calls without a result."""
    calls = rows.where(F.size("tool_calls") > 0).select("conv_id", F.explode("tool_calls.id").alias("id")).distinct().withColumn("c", F.lit(True))
    results = rows.where("tool_call_id is not null").select("conv_id", F.col("tool_call_id").alias("id")).distinct().withColumn("r", F.lit(True))
    j = calls.join(results, ["conv_id", "id"], "full_outer")
    return j.where("c is null or r is null").select("conv_id", "id", F.when(F.col("c").isNull(), "result").otherwise("call").alias("side"))


def intact(rows: DataFrame) -> DataFrame:
    """Rows without orphan results; orphan call ids are taken out, an empty list of calls becomes null."""
    o = orphans(rows)
    r = rows.join(o.where("side = 'result'").select("conv_id", F.col("id").alias("tool_call_id")), ["conv_id", "tool_call_id"], "left_anti")
    lost = o.where("side = 'call'").groupBy("conv_id").agg(F.collect_set("id").alias("_lost"))
    r = r.join(lost, "conv_id", "left")
    left = F.filter("tool_calls", lambda t: ~F.coalesce(F.array_contains("_lost", t["id"]), F.lit(False)))
    return r.withColumn("tool_calls", F.when(F.size(left) > 0, left)).select(*rows.columns)


def report(before: DataFrame, after: DataFrame, price: float = 0.003) -> DataFrame:
    """Per conversation: rows and tokens in and out, saved, ratio (infinity if nothing is left, 1 if nothing was there), cost."""
    t = F.sum(token_count(F.col("content")))
    a = before.groupBy("conv_id").agg(F.count("*").alias("rows_in"), t.alias("tokens_in"))
    b = after.groupBy("conv_id").agg(F.count("*").alias("rows_out"), t.alias("tokens_out"))
    r = a.join(b, "conv_id", "left").na.fill(0, ["rows_out", "tokens_out"])
    r = r.withColumn("saved", F.col("tokens_in") - F.col("tokens_out"))
    ratio = F.when(F.col("tokens_out") > 0, F.col("tokens_in") / F.when(F.col("tokens_out") > 0, F.col("tokens_out"))).when(F.col("tokens_in") > 0, F.lit(float("inf"))).otherwise(1.0)
    return r.withColumn("ratio", ratio).withColumn("cost_saved", F.col("saved") / 1000 * F.lit(price))


def decisions(before: DataFrame, after: DataFrame, layer: str) -> DataFrame:
    """Rows of a layer's log: what it changed or dropped, with token counts."""
    a = before.select("conv_id", "idx", F.col("content").alias("c0"))
    b = after.select("conv_id", "idx", F.col("content").alias("c1"), F.lit(True).alias("_there"))
    j = a.join(b, ["conv_id", "idx"], "left").where("_there is null or c0 <> c1")
    return j.select("conv_id", F.lit(layer).alias("layer"), F.when(F.col("_there").isNull(), "dropped").otherwise("changed").alias("action"), "idx", token_count(F.col("c0")).alias("tokens_before"), F.coalesce(token_count(F.col("c1")), F.lit(0)).alias("tokens_after"))
