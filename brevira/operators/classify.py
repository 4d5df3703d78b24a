"""Zones, classification, policies, tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import constants as K
from ..functions.text import holds, token_count

#: What every match of each of ``K.ERROR_SIGNS`` holds, where that is a fixed string.
SIGN_PARTS = ("Traceback (most recent", "at ", "Error: ", "panic:", "Exception in thread", ' File "', "raise ", "throw new ", "panic!(", None, "at Object.<anonymous>")


def conv():
    return Window.partitionBy("conv_id")


def in_order():
    return conv().orderBy("idx")


def from_end():
    return conv().orderBy(F.col("idx").desc())


def zones(messages: DataFrame) -> DataFrame:
    """zone: 1 system, 2 already compressed, 3 the rest."""
    return messages.withColumn("zone", F.when(F.col("role") == "system", 1).when(F.col("compressed"), 2).otherwise(3))


def reassembled(rows: DataFrame) -> DataFrame:
    """Output position of each row: zone 1, then 2, then 3, each in source order."""
    return rows.withColumn("position", F.row_number().over(conv().orderBy("zone", "idx")) - 1)


def error_hits(c) -> Column:
    return sum((F.when(holds(c, x), F.regexp_count(c, F.lit(p))).otherwise(0) if x else F.regexp_count(c, F.lit(p)) for x, p in zip(SIGN_PARTS, K.ERROR_SIGNS, strict=True)), F.lit(0))


def is_json(c) -> Column:
    first = F.substring(F.ltrim(F.regexp_replace(c, r"^\s+", "")), 1, 1)
    return first.isin("{", "[") & F.try_parse_json(c).isNotNull()


def tool_type(content, name) -> Column:
    return (
        F.when(error_hits(content) >= 3, "ERROR_TRACE")
        .when(is_json(content), "TOOL_RESULT_JSON")
        .when(F.coalesce(name.isin(*K.CODE_TOOLS), F.lit(False)) | content.rlike(r"```[\s\S]*?```"), "CODE_BLOCK")
        .otherwise("TOOL_RESULT_TEXT")
    )


def classified(messages: DataFrame, recent_turns: int | Column = 2, overrides: dict[str, str] | None = None) -> DataFrame:
    """Zone-3 rows with ctype, policy, protected, tokens, relevance, importance and shield at their defaults.

    A row is recent if it stands after the ``recent_turns``-th user row from the end; with fewer user rows, after the
    first row; with none asked for, never. The last user row is the query.
    """
    rows = zones(messages).where("zone = 3")
    user = F.col("role") == "user"
    nth_user = F.sum(user.cast("int")).over(from_end())
    rows = rows.withColumn("_u", F.when(user, nth_user))
    whole = conv().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nth = F.max(F.when(F.col("_u") == recent_turns, F.col("idx"))).over(whole)
    turns = recent_turns if isinstance(recent_turns, Column) else F.lit(recent_turns)
    after = (turns > 0) & (F.col("idx") > F.coalesce(nth, F.min("idx").over(whole)))
    sub = tool_type(F.col("content"), F.col("name"))
    rows = rows.withColumn("_recent", after).withColumn("_sub", F.when(F.col("role") == "tool", sub))
    ctype = (
        F.when(F.col("_u") == 1, "USER_QUERY")
        .when(F.col("role") == "tool", F.when((F.col("_sub") == "TOOL_RESULT_TEXT") & F.col("_recent"), "RECENT_TURN").otherwise(F.col("_sub")))
        .when(F.col("_recent"), "RECENT_TURN")
        .when(F.col("role") == "assistant", "ASSISTANT_REASONING")
        .otherwise("OLD_CONVERSATION")
    )
    policy = F.element_at(F.create_map(*[F.lit(x) for kv in (K.POLICIES | (overrides or {})).items() for x in kv]), F.col("ctype"))
    return (
        rows.withColumn("ctype", ctype)
        .drop("_u", "_recent", "_sub")
        .withColumn("policy", policy)
        .withColumn("protected", F.col("ctype").isin(*K.PROTECTED))
        .withColumn("tokens", token_count(F.col("content")))
        .withColumns({"relevance": F.lit(0.5), "importance": F.lit(0.5), "shield": F.lit("MODERATE")})
    )


def unclassified(messages: DataFrame) -> DataFrame:
    """:func:`classified` where no rule can be applied: every zone-3 row is old conversation."""
    types = {"ctype": F.lit("OLD_CONVERSATION"), "policy": F.lit("MODERATE"), "protected": F.lit(False)}
    rest = {"tokens": token_count(F.col("content")), "relevance": F.lit(0.5), "importance": F.lit(0.5), "shield": F.lit("MODERATE")}
    return zones(messages).where("zone = 3").withColumns(types | rest)


def class_totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("conv_id", "ctype").agg(F.count("*").alias("n_rows"), F.sum("tokens").alias("n_tokens"), F.sum(F.col("protected").cast("long")).alias("n_protected"))


def tiers(rows: DataFrame) -> DataFrame:
    """Processing tier of each conversation by its number of zone-3 rows."""
    n = F.col("n_rows")
    return rows.groupBy("conv_id").agg(F.count("*").alias("n_rows")).withColumn("tier", F.when(n <= 50, "full").when(n <= 150, "standard").when(n <= 300, "fast").otherwise("ultra_fast"))


def bucket(rows: DataFrame) -> DataFrame:
    """Rows that layers may rewrite."""
    return rows.where(~F.col("protected"))
