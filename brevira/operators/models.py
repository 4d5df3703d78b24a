"""Layers that ask a language model: summaries, scores and facts. None of them runs unless a model is given.

A model is a callable from prompts and their token limits to answers, one or null for each prompt; it is called on
executors, with one Arrow batch of prompts at a time. Where it raises, its prompts are asked one by one, and those that fail have no
answer: their rows fall back to what the chain does without a model.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from ..functions import constants as K
from ..functions.text import all_matches, strip, token_count, tokens
from ..session import staged
from .budget import task_keywords
from .classify import in_order
from .facts import extracted

Model = Callable[[list[str], list[int]], list[str | None]]

SUMMARY = "Write a shorter version of the message below. Keep every path, line number, error, decision, open question, number and name as it is written; leave out small talk, repetition and steps that led nowhere.\n\nMESSAGE:\n"
SCORE = 'How useful is the MESSAGE for the TASK, from 0 to 10? Answer with JSON only: {"score": n}.\n\nTASK: '
FACTS = 'List what must not be lost from the conversation below, as JSON with the keys "files", "decisions", "errors", "identifiers", "conclusions" and "open_items", each a list of strings. Copy paths and errors as they are written and add nothing.\n\n'
# Sections of an answer and the categories of their facts.
SECTIONS = {"files": "FILES", "decisions": "DECISIONS", "errors": "ERRORS", "identifiers": "IDENTIFIERS", "conclusions": "OUTCOMES", "open_items": "OPEN_ITEMS"}
LEAST_CHARS, ROW_CHARS, SCORE_CHARS, PROMPT_CHARS = 200, 500, 2000, 48_000


@dataclass(frozen=True)
class Posted:
    """A model behind a chat endpoint; ``style`` is that of its requests and answers: openai or anthropic."""

    url: str
    name: str
    style: str = "openai"
    headers: dict = field(default_factory=dict)
    seconds: float = 60.0

    def __call__(self, prompts: list[str], limits: list[int]) -> list[str | None]:
        return [self.ask(p, n) for p, n in zip(prompts, limits, strict=True)]

    def ask(self, prompt: str, most: int) -> str:
        body = {"model": self.name, "max_tokens": most, "temperature": 0.0, "messages": [{"role": "user", "content": prompt}]}
        request = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json", **self.headers})
        with urllib.request.urlopen(request, timeout=self.seconds) as answer:
            got = json.load(answer)
        if self.style == "anthropic":
            return "".join(x.get("text", "") for x in got["content"] if x.get("type") == "text")
        return got["choices"][0]["message"]["content"]


def answers(model: Model, prompts: list[str | None], limits: list[int]) -> list[str | None]:
    """Answers to the prompts that are not null."""
    own = [i for i, p in enumerate(prompts) if p is not None]
    out: list[str | None] = [None] * len(prompts)

    def ask(at: list[int]) -> None:
        got = model([prompts[i] for i in at], [int(limits[i]) for i in at])
        if len(got) != len(at):
            raise ValueError("a model gives one answer for each prompt")
        for i, x in zip(at, got, strict=True):
            out[i] = x

    try:
        if own:
            ask(own)
    except Exception:  # noqa: BLE001 - whatever a client raises; each prompt has another try by itself
        for i in own:
            try:
                ask([i])
            except Exception:  # noqa: BLE001
                out[i] = None
    return out


def asked(prompt: Column, most: Column, model: Model) -> Column:
    """The model's answer to each prompt; null prompts are not sent."""

    @F.pandas_udf(StringType())
    def answer(prompts: pd.Series, limits: pd.Series) -> pd.Series:
        return pd.Series(answers(model, list(prompts), list(limits)), dtype=object)

    return answer.asNondeterministic()(prompt, most.cast("int"))


def faithful(summary: Column, c: Column) -> Column:
    """Whether a summary is longer than 20 characters, shorter than its text, and keeps 70% of its paths and all kinds of errors."""
    paths, kinds = F.array_distinct(all_matches(c, f"({K.SUMMARY_PATH})")), F.array_distinct(all_matches(c, K.SUMMARY_ERROR))
    lost = F.size(F.filter(paths, lambda p: ~F.contains(summary, p))) / F.nullif(F.size(paths), F.lit(0))
    good = (F.length(summary) > 20) & (F.length(summary) < F.length(c)) & (F.coalesce(lost, F.lit(0.0)) <= 0.3) & F.forall(kinds, lambda k: F.contains(summary, k))
    return F.coalesce(good, F.lit(False))


def summarised(rows: DataFrame, model: Model) -> DataFrame:
    """Rows of the two harder policies, of 200 characters or more, as faithful summaries; others as they are."""
    c = F.col("content")
    due = F.col("policy").isin("AGGRESSIVE", "MODERATE") & ~F.col("protected") & (F.length(c) >= LEAST_CHARS)
    most = F.greatest(F.lit(128), F.floor(token_count(c) * 3 / 10))
    r = rows.withColumn("_s", asked(F.when(due, F.concat(F.lit(SUMMARY), c)), most, model)).withColumn("_s", strip(F.col("_s")))
    return r.withColumn("content", F.when(faithful(F.col("_s"), c), F.col("_s")).otherwise(c)).drop("_s")


def scored(rows: DataFrame, tasks: DataFrame, model: Model, drop_below: float = 0.05) -> DataFrame:
    """Rows with a tenth of the model's score from 0 to 10 as relevance, without those below 0.3.

    Where there is no usable answer the share of the task's keywords counts (0.5 if either side has none), and rows below
    ``drop_below`` go. Protected rows score 1. Other rows of conversations without a task stay as they are.
    """
    c = F.col("content")
    r = rows.join(tasks.select("conv_id", F.col("task").alias("_task")), "conv_id", "left")
    open_ = ~F.col("protected") & F.col("_task").isNotNull()
    prompt = F.when(open_, F.concat(F.lit(SCORE), F.col("_task"), F.lit("\n\nMESSAGE:\n"), F.substring(c, 1, SCORE_CHARS)))
    r = r.withColumn("_a", asked(prompt, F.lit(100), model))
    r = r.withColumn("_j", F.regexp_extract("_a", r"\{[^}]+\}", 0))
    given = F.array_contains(F.json_object_keys("_j"), "score")
    number = F.when(given, F.expr("try_cast(get_json_object(_j, '$.score') as double)")).when(F.expr("try_parse_json(_j)").isNotNull(), 5.0)
    words, own = task_keywords(F.col("_task")), task_keywords(c)
    share = F.when((F.size(words) == 0) | (F.size(own) == 0), 0.5).otherwise(F.size(F.array_intersect(words, tokens(c))) / F.nullif(F.size(words), F.lit(0)))
    r = r.withColumn("_m", number / 10).withColumn("_s", F.when(F.col("protected"), 1.0).otherwise(F.coalesce("_m", share)))
    keep = ~open_ | F.when(F.col("_m").isNotNull(), F.col("_m") >= 0.3).otherwise(F.col("_s") >= drop_below)
    r = r.withColumn("relevance", F.when(open_ | F.col("protected"), F.col("_s")).otherwise(F.col("relevance")))
    return r.where(keep).select(*rows.columns)


def prompts(rows: DataFrame) -> DataFrame:
    """(conv_id, part, prompt): the first characters of each row that is not compressed yet, with its calls, in parts of bounded size."""
    calls = F.transform(F.coalesce("tool_calls", F.array().cast("array<struct<id:string,type:string,name:string,arguments:string>>")), lambda x: F.concat(F.lit("call "), F.coalesce(x["name"], F.lit("")), F.lit(" "), F.substring(F.coalesce(x["arguments"], F.lit("")), 1, ROW_CHARS)))
    head = F.concat(F.upper("role"), F.coalesce(F.concat(F.lit(" "), F.col("name")), F.lit("")), F.lit(": "), F.substring("content", 1, ROW_CHARS))
    r = rows.where("not compressed").select("conv_id", "idx", F.concat_ws("\n", head, calls).alias("line"))
    before = F.coalesce(F.sum(F.length("line")).over(in_order().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    r = r.withColumn("part", F.floor(before / PROMPT_CHARS))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "line"))), lambda x: x["line"]), "\n\n")
    return r.groupBy("conv_id", "part").agg(F.concat(F.lit(FACTS), text).alias("prompt"))


def grounded(category: Column, fact: Column, lowered: Column) -> Column:
    """Whether a lowered text bears a fact out: its path, its kind of error, three of its words in a row, or one long word."""
    path = F.lower(strip(F.substring_index(F.substring_index(fact, " —", 1), " --", 1)))
    kind = F.lower(strip(F.substring_index(fact, ":", 1)))
    words = F.split(F.lower(strip(fact)), r"\s+")
    triples = F.when(F.size(words) >= 3, F.transform(F.sequence(F.lit(1), F.size(words) - 2), lambda i: F.array_join(F.slice(words, i, 3), " "))).otherwise(F.array().cast("array<string>"))
    other = F.exists(F.concat(triples, words), lambda x: (F.length(x) >= 8) & F.contains(lowered, x))
    return F.when(category == "FILES", F.contains(lowered, path)).when(category == "ERRORS", F.contains(lowered, kind)).otherwise(other)


def of_category(category: str, contents: Column) -> Column:
    return F.transform(F.coalesce(contents, F.array().cast("array<string>")), lambda x: F.struct(F.lit(category).alias("category"), x.alias("content")))


def facts(rows: DataFrame, model: Model) -> DataFrame:
    """The ledger with the model's facts that some row bears out; a conversation with an unusable answer keeps the facts by rules.

    Intent and active context are by rules in either case.
    """
    own = extracted(rows)
    a = prompts(rows).withColumn("_a", asked(F.col("prompt"), F.lit(2048), model))
    plain = F.regexp_replace(strip(F.col("_a")), r"(?m)^\s*```.*$", "")
    # a sequence of items is small: an answer has at most 2,048 tokens, a conversation one answer for 48,000 characters
    a = a.withColumn("_j", plain).withColumn("_ok", F.coalesce(F.expr("try_parse_json(_j) is not null and _j rlike '^\\\\s*[{]'"), F.lit(False)))
    a = a.withColumn("_j", F.from_json("_j", ", ".join(f"{k} array<string>" for k in SECTIONS)))
    items = F.concat(*[of_category(c, F.col(f"_j.{k}")) for k, c in SECTIONS.items()])
    by = a.groupBy("conv_id").agg(F.min("_ok").alias("_ok"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", F.filter(items, lambda x: F.length(x["content"]) >= 3).alias("items")))), lambda x: x["items"])).alias("_items"))
    by = by.where("_ok").select("conv_id", F.transform("_items", lambda x, i: F.struct(i.cast("long").alias("at"), x["category"].alias("category"), x["content"].alias("content"))).alias("_items"))
    # answers are asked for once: this table is read by three branches below
    by = staged(by)
    low = rows.select("conv_id", F.lower("content").alias("_low")).join(by, "conv_id")
    found = low.select("conv_id", F.inline(F.filter("_items", lambda x: grounded(x["category"], x["content"], F.col("_low")))))
    first = found.groupBy("conv_id", "category", "content").agg(F.min("at").alias("at"))
    new = first.select("conv_id", (F.col("at") + 3).alias("seq"), "category", "content", F.lit(0).alias("turn"), F.lit(0.9).alias("confidence"))
    asked_of = by.select("conv_id")
    kept = own.join(asked_of, "conv_id", "left_anti").unionByName(own.where("category in ('INTENT', 'ACTIVE_CONTEXT')").join(asked_of, "conv_id", "left_semi"))
    w = Window.partitionBy("conv_id", F.sha2("content", 256)).orderBy("seq")
    return kept.unionByName(new).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
