"""The whole chain as one function from messages to messages, facts and a report."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import token_count
from ..operators import budget as B
from ..operators import classify as C
from ..operators import coalesce as S
from ..operators import dedup as D
from ..operators import facts as X
from ..operators import importance as I
from ..operators import lines as L
from ..operators import models as M
from ..operators import structure as J
from ..operators import tokens as T
from ..session import staged
from ..sources.adapters import transcript
from .config import Config, pressure, resolved, thresholds

COLUMNS = ["conv_id", "idx", "role", "content", "name", "tool_call_id", "tool_calls", "metadata", "compressed"]
FULL = ("full", "standard")
#: Settings of a row's conversation under its pressure.
SETTINGS = {"_turns": "recent_turns", "_keep": "keep_ratio", "_entropy": "entropy", "_engines": "engines", "_mask": "mask", "_tier": "forced_tier"}


@dataclass
class Result:
    messages: DataFrame
    facts: DataFrame
    report: DataFrame
    originals: DataFrame  # (conv_id, idx, original) of every row that was rewritten or dropped
    log: DataFrame  # (conv_id, layer, action, idx, tokens_before, tokens_after) of each layer's changes
    places: DataFrame  # (conv_id, idx, place): order of output, which differs from idx where the configuration reorders
    hashes: DataFrame | None = None  # (session_id, hash) of texts that this window holds for the first time
    skipped: dict[str, str] = field(default_factory=dict)  # layers that failed, whose input went on unchanged


def near_edges(work: DataFrame, exact: DataFrame, threshold: float) -> DataFrame:
    """Near duplicates among the rows that exact dedup has not made into notes."""
    return D.near(work.join(exact.select("conv_id", F.col("src").alias("idx")), ["conv_id", "idx"], "left_anti"), threshold)


def compress(messages: DataFrame, config: Config = Config(), tasks: DataFrame | None = None, windows: DataFrame | None = None, tier: str | None = None, flush: bool = False, model: M.Model | None = None, seen: DataFrame | None = None) -> Result:
    """Shrink every conversation of ``messages``.

    ``tasks``: conv_id, task. ``windows``: conv_id, window, usage, reserve; conversations without pressure pass unchanged,
    or with ``flush`` are shrunk by ``config`` as it is. Under pressure each has its own recent turns, budget, keep ratio, entropy,
    masking, tier and engines. ``model``: writes summaries where configuration or pressure asks for them, and facts and scores
    where ``config.model_facts`` and ``config.model_scores`` do. ``seen``: session_id, window, hash of the session's other windows.
    ``tier``: of all conversations (full, standard, fast, ultra_fast). Without it each has that of its size, and the
    slow layers run on the rows of full and standard ones only. Rewritten rows are flagged ``compressed`` in the output.
    Rows are written to the shared folder after each layer, so that no plan grows with the number of layers and a layer that
    fails is known at once: it is left out, warned of and listed in ``skipped``.
    """
    spark = messages.sparkSession
    skipped: dict[str, str] = {}
    log = [spark.createDataFrame([], "conv_id long, layer string, action string, idx long, tokens_before long, tokens_after long")]

    def layer(name: str, df: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """What ``step`` makes of ``df``, written; ``df`` itself if that fails."""
        try:
            out = staged(step(df))
        except (PySparkException, Py4JJavaError) as error:
            skipped[name] = str(error).partition("\n")[0]
            warnings.warn(f"layer {name} is left out: {skipped[name]}", stacklevel=3)
            return df
        log.append(B.decisions(df, out, name))
        return out

    idle = None
    if windows is not None:
        w = staged(thresholds(pressure(resolved(messages, windows)), config))
        if flush:
            w = w.withColumn("engines", F.when(F.col("skip"), F.array(*map(F.lit, K.ENGINES["CRITICAL"]))).otherwise(F.col("engines"))).withColumn("skip", F.lit(False))
        idle = messages.join(w.where("skip").select("conv_id"), "conv_id", "left_semi")
        messages = messages.join(w.where("not skip").select("conv_id"), "conv_id", "left_semi")
        budgets = w.where("not skip").select("conv_id", "budget")
        marked = messages.join(w.select("conv_id", *[F.col(v).alias(k) for k, v in SETTINGS.items()]), "conv_id")
        turns, keep, entropy, mask = (F.col(c) for c in ("_turns", "_keep", "_entropy", "_mask"))
    else:
        marked, turns, keep, entropy, mask = messages, config.recent_turns, config.keep_ratio, config.entropy, config.mask
        budgets = messages.select("conv_id").distinct().withColumn("budget", F.lit(config.token_budget).cast("long"))

    def gated(engine: str, step: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        """``step`` on the conversations whose pressure calls for its engine; on all where no windows are given."""
        on = F.array_contains("_engines", engine)
        return step if windows is None else lambda df: step(df.where(on)).unionByName(df.where(~on))

    def sized(rows: DataFrame) -> DataFrame:
        fixed_tier = tier or config.tier
        rows = rows.withColumn("tier", F.lit(fixed_tier)) if fixed_tier else rows.join(C.tiers(rows).select("conv_id", "tier"), "conv_id")
        return rows.withColumn("tier", F.coalesce("_tier", "tier")) if windows is not None else rows

    try:
        rows = staged(sized(C.classified(marked, turns, config.policies)))
    except (PySparkException, Py4JJavaError) as error:
        skipped["classifier"] = str(error).partition("\n")[0]
        warnings.warn(f"all rows count as old conversation: {skipped['classifier']}", stacklevel=2)
        rows = staged(sized(C.unclassified(marked)))
    facts = staged(M.facts(rows, model) if model is not None and config.model_facts else X.extracted(rows))
    critical, protected = staged(X.needles(X.critical_strings(facts))), staged(X.needles(X.protected_strings(facts)))
    logical = X.chains(rows)
    work, held = rows.where(~F.col("protected")), rows.where("protected")
    deep = F.col("tier").isin(*FULL)
    exact = spark.createDataFrame([], "conv_id long, kind string, src long, dst long")
    near, hashes = exact, None

    def without_copies(df: DataFrame) -> DataFrame:
        nonlocal exact
        df, edges = D.exact(df)
        exact = staged(edges)
        return df

    def without_seen(df: DataFrame) -> DataFrame:
        nonlocal hashes
        df, fresh = D.cross_window(df, seen)
        hashes = staged(fresh)
        return df

    def without_near(df: DataFrame) -> DataFrame:
        nonlocal near
        found = staged(near_edges(df.where(deep), exact, config.dedup_threshold))
        near = found.select("conv_id", F.lit("dedup").alias("kind"), "src", "dst")
        return D.chunked(D.mark(df, found))

    if seen is not None:
        work = layer("cross_window", work, without_seen)
    work = layer("near_dedup", layer("exact_dedup", work, without_copies), without_near)
    edges = staged(exact.unionByName(near).unionByName(logical))
    work = layer("coalesce", work, lambda x: S.coalesced(x, config.coalesce_chars))
    work = layer("verbatim", work, gated("verbatim", lambda x: L.cleaned(L.masked(L.rereads(x), critical, force=mask), entropy)))
    work = layer("pruner", work, gated("pruner", lambda x: T.pruned(x, keep, needles=critical)))
    work = layer("structural", work, gated("structural", lambda x: J.structured(x, config.json_limit, config.signatures)))
    if model is not None and (windows is not None or config.summarise):
        work = layer("summarizer", work, lambda x: M.summarised(x, model) if config.summarise else gated("summarizer", lambda y: M.summarised(y, model))(x))
    slow, fast = work.where(deep), work.where(~deep)
    slow = layer("importance", slow, gated("importance", I.scored))
    slow = layer("relevance", slow, gated("relevance", lambda x: I.relevance_pruned(x, edges, facts, protected)))
    slow = layer("discourse", slow, gated("discourse", lambda x: I.discourse(x, turns, critical)))
    rows = slow.unionByName(fast).unionByName(held).drop(*SETTINGS)
    by_model = model is not None and config.model_scores and tasks is not None
    rows = layer("scores", rows, lambda x: M.scored(x, tasks, model, config.drop_below) if by_model else B.scored(x, tasks, config.drop_below, critical))
    fixed = C.zones(messages).where("zone < 3")
    used = fixed.groupBy("conv_id").agg(F.sum(token_count(F.col("content"))).alias("_z"))
    left = F.when(F.col("budget").isNotNull(), B.effective(F.col("budget"), F.col("_z")))
    budgets = budgets.join(used, "conv_id", "left").withColumn("budget", left).drop("_z")
    rows = layer("budget", rows, lambda x: B.within(x, budgets, edges, critical, protected))
    rows = layer("integrity", rows, B.intact)
    places = B.reordered(rows) if config.reorder else rows.withColumn("place", F.col("idx"))
    places = fixed.select("conv_id", "idx", "zone", F.col("idx").alias("place")).unionByName(places.select("conv_id", "idx", "zone", "place"))
    out = rows.withColumn("compressed", F.lit(True)).select(*COLUMNS).unionByName(fixed.select(*COLUMNS))
    before = messages.select(*COLUMNS)
    if idle is not None:
        out, before = out.unionByName(idle.select(*COLUMNS)), before.unionByName(idle.select(*COLUMNS))
        places = places.unionByName(idle.select("conv_id", "idx", F.lit(1).alias("zone"), F.col("idx").alias("place")))
    places = places.select("conv_id", "idx", (F.row_number().over(C.conv().orderBy("zone", "place", "idx")) - 1).alias("place"))
    after = out.select("conv_id", "idx", F.col("content").alias("_new"))
    originals = before.join(after, ["conv_id", "idx"], "left").where("_new is null or _new <> content").select("conv_id", "idx", F.col("content").alias("original"))
    return Result(out, facts, B.report(before, out, config.price), originals, reduce(DataFrame.unionByName, log), places, hashes, skipped)


def expanded(messages: DataFrame, originals: DataFrame, wanted: DataFrame) -> DataFrame:
    """The original texts of the rows of ``wanted`` (conv_id, idx)."""
    return originals.join(wanted.select("conv_id", "idx"), ["conv_id", "idx"], "left_semi")


def notes_before_compaction(lines: DataFrame, config: Config = Config()) -> DataFrame:
    """(conv_id, text, tokens): what must outlive a compaction of each transcript (conv_id, idx, value), as text for its next prompt."""
    return X.rendered(X.extracted(C.classified(transcript(lines), config.recent_turns, config.policies)))
