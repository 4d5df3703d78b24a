"""Messages from and to six chat formats, transcripts and ledger files. Format records are JSON strings, one a row.

In: (conv_id, idx, body) to message rows; the body's place in its conversation is idx * SPREAD plus the part's place. Out:
(conv_id, idx, body).
"""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from ..session import staged
from .messages import CALLS, shaped

SPREAD = 100
_OPENAI = "role string, content string, name string, tool_call_id string, refusal string, tool_calls array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>"
_BLOCK = "type string, text string, id string, name string, input string, tool_use_id string, content string, toolCallId string, toolName string, args string, result string"


def _calls(c) -> Column:
    return F.transform(c, lambda x: F.struct(x["id"].alias("id"), F.coalesce(x["type"], F.lit("function")).alias("type"), x["function"]["name"].alias("name"), x["function"]["arguments"].alias("arguments"))).cast(CALLS)


def from_openai(records: DataFrame) -> DataFrame:
    """Null content becomes empty; the whole record is kept as metadata."""
    r = records.withColumn("m", F.from_json("body", _OPENAI))
    return shaped(r.select("conv_id", (F.col("idx") * SPREAD).alias("idx"), "m.role", F.coalesce("m.content", F.lit("")).alias("content"), "m.name", "m.tool_call_id", _calls(F.col("m.tool_calls")).alias("tool_calls"), F.col("body").alias("metadata")))


def to_openai(messages: DataFrame) -> DataFrame:
    """Content is null where it is empty and calls are there."""
    called = F.coalesce(F.size("tool_calls"), F.lit(0)) > 0
    content = F.when(~((F.col("content") == "") & called), F.col("content"))
    calls = F.when(called, F.transform("tool_calls", lambda x: F.struct(x["id"].alias("id"), x["type"].alias("type"), F.struct(x["name"].alias("name"), x["arguments"].alias("arguments")).alias("function"))))
    return messages.select("conv_id", "idx", F.to_json(F.struct("role", content.alias("content"), "name", "tool_call_id", calls.alias("tool_calls"))).alias("body"))


def _blocks(content) -> Column:
    """Content as an array of blocks: a plain string is one text block."""
    parsed = F.from_json(content, f"array<struct<{_ddl(_BLOCK)}>>")
    return F.when(_typed(content, parsed), parsed).otherwise(F.array(F.from_json(F.to_json(F.struct(F.lit("text").alias("type"), content.alias("text"))), f"struct<{_ddl(_BLOCK)}>")))


def _typed(content, parsed) -> Column:
    """Whether content is a list of typed blocks, not a text that happens to be a JSON array."""
    return F.coalesce(F.ltrim(content).startswith("[") & F.exists(parsed, lambda b: b["type"].isNotNull()), F.lit(False))


def _ddl(s: str) -> str:
    return ",".join(x.strip().replace(" ", ":", 1) for x in s.split(","))


def _text_of(blocks) -> Column:
    return F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")


def _block_rows(r: DataFrame, use: str, done: str, id_of, name_of, input_of, text_of) -> DataFrame:
    """One row for a record's text and calls, and one ``tool`` row for each result block."""
    r = r.withColumn("_b", _blocks(F.col("m.content")))
    calls = F.transform(F.filter("_b", lambda b: b["type"] == use), lambda b: F.struct(id_of(b).alias("id"), F.lit("function").alias("type"), name_of(b).alias("name"), F.coalesce(input_of(b), F.lit("{}")).alias("arguments"))).cast(CALLS)
    results = F.filter("_b", lambda b: b["type"] == done)
    only = (F.size(results) > 0) & (F.size(F.filter("_b", lambda b: b["type"] != done)) == 0)
    main = r.where(~only).select("conv_id", (F.col("idx") * SPREAD).alias("idx"), "m.role", _text_of(F.col("_b")).alias("content"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("tool_call_id"), F.when(F.size(calls) > 0, calls).alias("tool_calls"), F.col("body").alias("metadata"))
    tools = r.select("conv_id", "idx", F.posexplode(results).alias("k", "b"), "body").select("conv_id", (F.col("idx") * SPREAD + F.col("k") + 1).alias("idx"), F.lit("tool").alias("role"), text_of(F.col("b")).alias("content"), F.lit(None).cast("string").alias("name"), id_of(F.col("b")).alias("tool_call_id"), F.lit(None).cast(CALLS).alias("tool_calls"), F.col("body").alias("metadata"))
    return shaped(main.unionByName(tools))


def from_anthropic(records: DataFrame) -> DataFrame:
    """Text, tool_use and tool_result blocks; thinking is left out of the text and stays in the metadata."""
    r = records.withColumn("m", F.from_json("body", "role string, content string"))

    def inner(b):
        parsed = F.from_json(b["content"], "array<struct<type:string,text:string>>")
        return F.when(_typed(b["content"], parsed), _text_of(parsed)).otherwise(F.coalesce(b["content"], F.lit("")))

    return _block_rows(r, "tool_use", "tool_result", lambda b: F.coalesce(b["id"], b["tool_use_id"]), lambda b: b["name"], lambda b: b["input"], inner)


def to_anthropic(messages: DataFrame) -> DataFrame:
    """Results are nested in a user record after their call; the texts are those of the rows, compressed ones too."""
    result = F.to_json(F.array(F.struct(F.lit("tool_result").alias("type"), F.col("tool_call_id").alias("tool_use_id"), F.col("content"))))
    uses = F.transform("tool_calls", lambda x: F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), x["id"].alias("id"), x["name"].alias("name"), x["arguments"].alias("input")))
    text = F.array(F.struct(F.lit("text").alias("type"), F.col("content").alias("text"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("input")))
    blocks = F.when(F.coalesce(F.size("tool_calls"), F.lit(0)) > 0, F.to_json(F.when(F.col("content") == "", uses).otherwise(F.concat(text, uses))))
    role = F.when(F.col("role") == "tool", "user").otherwise(F.col("role"))
    content = F.when(F.col("role") == "tool", result).otherwise(F.coalesce(blocks, F.col("content")))
    return messages.select("conv_id", "idx", F.to_json(F.struct(role.alias("role"), content.alias("content"))).alias("body"))


def from_agent_sdk(records: DataFrame) -> DataFrame:
    """Typed records with a message inside; boundaries of earlier compaction are flagged compressed, result records go."""
    r = records.withColumn("o", F.from_json("body", "type string, subtype string, message string, content string"))
    r = r.where(F.coalesce(F.col("o.type"), F.lit("")) != "result")
    edge = F.coalesce(F.col("o.subtype") == "compact_boundary", F.lit(False))
    own = from_anthropic(r.where(~edge).select("conv_id", "idx", F.coalesce("o.message", F.to_json(F.struct(F.col("o.type").alias("role"), F.col("o.content").alias("content")))).alias("body")))
    marks = shaped(r.where(edge).select("conv_id", (F.col("idx") * SPREAD).alias("idx"), F.lit("system").alias("role"), F.coalesce("o.content", F.lit("")).alias("content"), F.lit(True).alias("compressed"), F.col("body").alias("metadata")))
    return own.unionByName(marks)


def to_agent_sdk(messages: DataFrame) -> DataFrame:
    inner = to_anthropic(messages.where("not (compressed and role = 'system')"))
    edge = messages.where("compressed and role = 'system'").select("conv_id", "idx", F.to_json(F.struct(F.lit("system").alias("type"), F.lit("compact_boundary").alias("subtype"), "content")).alias("body"))
    return inner.withColumn("body", F.to_json(F.struct(F.get_json_object("body", "$.role").alias("type"), F.col("body").alias("message")))).unionByName(edge)


@F.pandas_udf(StringType())
def _adk_id(body: pd.Series) -> pd.Series:
    import hashlib

    return body.map(lambda b: "adk_" + hashlib.sha256(json.dumps(json.loads(b), sort_keys=True).encode()).hexdigest()[:12] if b is not None else None)


def from_adk(records: DataFrame) -> DataFrame:
    """Events with function_calls and function_responses; a missing id is made from the event part's content."""
    ddl = "role string, text string, parts array<struct<text:string>>, function_calls array<string>, function_responses array<string>"
    r = records.withColumn("m", F.from_json("body", ddl))
    part = "id string, name string, args string, response string"
    text = F.coalesce("m.text", F.array_join(F.transform("m.parts", lambda p: p["text"]), "\n"), F.lit(""))
    role = F.when(F.col("m.role") == "model", "assistant").otherwise(F.col("m.role"))
    c = r.select("conv_id", "idx", F.posexplode("m.function_calls").alias("k", "raw")).withColumn("p", F.from_json("raw", part))
    c = c.withColumn("id", F.coalesce("p.id", _adk_id("raw"))).groupBy("conv_id", "idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "id", F.col("p.name").alias("name"), F.coalesce("p.args", F.lit("{}")).alias("args")))), lambda x: F.struct(x["id"].alias("id"), F.lit("function").alias("type"), x["name"].alias("name"), x["args"].alias("arguments"))).cast(CALLS).alias("tool_calls"))
    main = r.where("m.text is not null or m.parts is not null or size(m.function_calls) > 0").join(c, ["conv_id", "idx"], "left").select("conv_id", (F.col("idx") * SPREAD).alias("idx"), role.alias("role"), text.alias("content"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("tool_call_id"), "tool_calls", F.col("body").alias("metadata"))
    a = r.select("conv_id", "idx", F.posexplode("m.function_responses").alias("k", "raw"), "body").withColumn("p", F.from_json("raw", part))
    tools = a.select("conv_id", (F.col("idx") * SPREAD + F.col("k") + 1).alias("idx"), F.lit("tool").alias("role"), F.coalesce("p.response", F.lit("")).alias("content"), F.col("p.name").alias("name"), F.coalesce("p.id", _adk_id("raw")).alias("tool_call_id"), F.lit(None).cast(CALLS).alias("tool_calls"), F.col("body").alias("metadata"))
    return shaped(main.unionByName(tools))


def to_adk(messages: DataFrame) -> DataFrame:
    """One event a row; responses hold the rows' texts."""
    calls = F.when(F.size("tool_calls") > 0, F.transform("tool_calls", lambda x: F.struct(x["id"].alias("id"), x["name"].alias("name"), x["arguments"].alias("args"))))
    answer = F.when(F.col("role") == "tool", F.array(F.struct(F.col("tool_call_id").alias("id"), F.col("name"), F.col("content").alias("response"))))
    role = F.when(F.col("role") == "assistant", "model").otherwise(F.col("role"))
    return messages.select("conv_id", "idx", F.to_json(F.struct(role.alias("role"), F.when(F.col("role") != "tool", F.col("content")).alias("text"), calls.alias("function_calls"), answer.alias("function_responses"))).alias("body"))


def from_langchain(records: DataFrame) -> DataFrame:
    """Roles from message types; calls from additional_kwargs."""
    ddl = "type string, role string, content string, name string, tool_call_id string, additional_kwargs struct<tool_calls:array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>>"
    r = records.withColumn("m", F.from_json("body", ddl))
    kind = F.lower(F.regexp_replace(F.coalesce("m.type", "m.role", F.lit("")), "Message(Chunk)?$", ""))
    role = F.when(kind == "human", "user").when(kind == "ai", "assistant").otherwise(kind)
    return shaped(r.select("conv_id", (F.col("idx") * SPREAD).alias("idx"), role.alias("role"), F.coalesce("m.content", F.lit("")).alias("content"), "m.name", "m.tool_call_id", _calls(F.col("m.additional_kwargs.tool_calls")).alias("tool_calls"), F.col("body").alias("metadata")))


def to_langchain(messages: DataFrame) -> DataFrame:
    kind = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "ai").otherwise(F.col("role"))
    calls = F.when(F.size("tool_calls") > 0, F.struct(F.transform("tool_calls", lambda x: F.struct(x["id"].alias("id"), x["type"].alias("type"), F.struct(x["name"].alias("name"), x["arguments"].alias("arguments")).alias("function"))).alias("tool_calls")))
    return messages.select("conv_id", "idx", F.to_json(F.struct(kind.alias("type"), "content", "name", "tool_call_id", calls.alias("additional_kwargs"))).alias("body"))


def from_vercel(records: DataFrame) -> DataFrame:
    """String content, or text, tool-call and tool-result parts; image and file parts stay in the metadata."""
    r = records.withColumn("m", F.from_json("body", "role string, content string"))
    return _block_rows(r, "tool-call", "tool-result", lambda b: b["toolCallId"], lambda b: b["toolName"], lambda b: b["args"], lambda b: F.coalesce(b["result"], F.lit("")))


def to_vercel(messages: DataFrame) -> DataFrame:
    result = F.to_json(F.array(F.struct(F.lit("tool-result").alias("type"), F.col("tool_call_id").alias("toolCallId"), F.col("content").alias("result"))))
    uses = F.transform("tool_calls", lambda x: F.struct(F.lit("tool-call").alias("type"), F.lit(None).cast("string").alias("text"), x["id"].alias("toolCallId"), x["name"].alias("toolName"), x["arguments"].alias("args")))
    text = F.array(F.struct(F.lit("text").alias("type"), F.col("content").alias("text"), F.lit(None).cast("string").alias("toolCallId"), F.lit(None).cast("string").alias("toolName"), F.lit(None).cast("string").alias("args")))
    blocks = F.when(F.coalesce(F.size("tool_calls"), F.lit(0)) > 0, F.to_json(F.when(F.col("content") == "", uses).otherwise(F.concat(text, uses))))
    content = F.when(F.col("role") == "tool", result).otherwise(F.coalesce(blocks, F.col("content")))
    return messages.select("conv_id", "idx", F.to_json(F.struct("role", content.alias("content"))).alias("body"))


def detected(records: DataFrame, look: int = 5) -> DataFrame:
    """(conv_id, framework) from the first records of each conversation; openai where nothing shows."""
    w = Window.partitionBy("conv_id").orderBy("idx")
    r = records.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= look)
    b = F.col("body")
    has = lambda path: F.get_json_object(b, path).isNotNull()
    kind = (
        F.when(has("$.function_calls") | has("$.function_responses"), "adk")
        .when(has("$.additional_kwargs") | F.get_json_object(b, "$.type").isin("human", "ai"), "langchain")
        .when(has("$.subtype") | has("$.message"), "agent_sdk")
        .when(b.rlike(r'"type\\?"\s*:\s*\\?"tool-(?:call|result)\\?"'), "vercel")
        .when(b.rlike(r'"type\\?"\s*:\s*\\?"(?:tool_use|tool_result|thinking)\\?"'), "anthropic")
    )
    return r.withColumn("f", kind).groupBy("conv_id").agg(F.coalesce(F.min_by("f", F.when(F.col("f").isNotNull(), F.col("_k"))), F.lit("openai")).alias("framework"))


ADAPTERS = {"openai": (from_openai, to_openai), "anthropic": (from_anthropic, to_anthropic), "agent_sdk": (from_agent_sdk, to_agent_sdk), "adk": (from_adk, to_adk), "langchain": (from_langchain, to_langchain), "vercel": (from_vercel, to_vercel)}


def wrapped(records: DataFrame, framework: str, run) -> DataFrame:
    """Adapt in, apply ``run`` (messages to messages), adapt out."""
    into, out = ADAPTERS[framework]
    return out(run(into(records)))


def automatic(records: DataFrame, run) -> DataFrame:
    """:func:`wrapped` with the format of each conversation found by :func:`detected`; ``run`` sees all conversations at once."""
    kinds = staged(detected(records))
    own = lambda df, name: df.join(kinds.where(F.col("framework") == name).select("conv_id"), "conv_id", "left_semi")
    done = run(reduce(DataFrame.unionByName, [into(own(records, name)) for name, (into, _) in ADAPTERS.items()]))
    return reduce(DataFrame.unionByName, [out(own(done, name)) for name, (_, out) in ADAPTERS.items()])


def transcript(lines: DataFrame) -> DataFrame:
    """Messages from JSON lines (conv_id, idx, value); bad lines and unknown roles are skipped."""
    r = lines.withColumn("m", F.from_json("value", "role string, type string, message struct<role:string,content:string>, content string"))
    role = F.coalesce("m.message.role", "m.role", "m.type")
    content = F.coalesce("m.message.content", "m.content")
    blocks = F.from_json(content, "array<struct<type:string,text:string,content:string>>")
    text = F.when(_typed(content, blocks), F.array_join(F.transform(F.filter(blocks, lambda b: b["type"].isin("text", "tool_result")), lambda b: F.coalesce(b["text"], b["content"], F.lit(""))), "\n")).otherwise(content)
    return shaped(r.select("conv_id", "idx", role.alias("role"), F.coalesce(text, F.lit("")).alias("content")).where(F.col("role").isin("system", "user", "assistant", "tool")))


def save_ledger(facts: DataFrame, path: str) -> None:
    facts.write.mode("overwrite").json(path)


def load_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Facts from JSON files; a missing path gives none; malformed lines are skipped."""
    schema = "conv_id long, seq long, category string, content string, turn int, confidence double"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where("content is not null")
