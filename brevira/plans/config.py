"""Configuration, presets, model tables, context windows, pressure and adaptive thresholds."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import constants as K

# Input window and output reserve by model prefix.
MODELS = {
    "gpt-4o-mini": (128_000, 16_384),
    "gpt-4o": (128_000, 16_384),
    "gpt-4.1-nano": (1_047_576, 32_768),
    "gpt-4.1-mini": (1_047_576, 32_768),
    "gpt-4.1": (1_047_576, 32_768),
    "o3-mini": (200_000, 100_000),
    "o3": (200_000, 100_000),
    "o4-mini": (200_000, 100_000),
    "claude-opus-4-6": (1_000_000, 128_000),
    "claude-sonnet-4-6": (1_000_000, 64_000),
    "claude-opus-4-5": (200_000, 64_000),
    "claude-sonnet-4-5": (200_000, 64_000),
    "claude-sonnet-4": (200_000, 64_000),
    "claude-haiku-4-5": (200_000, 64_000),
    "gemini-2.5-pro": (1_048_576, 65_535),
    "gemini-2.5-flash-lite": (1_048_576, 65_535),
    "gemini-2.5-flash": (1_048_576, 65_535),
}
DEFAULT_WINDOW, DEFAULT_RESERVE = 200_000, 8_192

# Default budget and price per 1,000 tokens by exact model name.
BUDGETS = {"gpt-4o": 80_000, "gpt-4.1": 600_000, "claude-sonnet-4-6": 120_000, "claude-opus-4-6": 120_000, "gemini-2.5-pro": 600_000}
PRICES = {"gpt-4o": 0.0025, "gpt-4.1": 0.002, "claude-sonnet-4-6": 0.003, "claude-opus-4-6": 0.015, "gemini-2.5-pro": 0.00125}
DEFAULT_PRICE = 0.003


@dataclass(frozen=True)
class Config:
    recent_turns: int = 2
    token_budget: int | None = None
    dedup_threshold: float = 0.80
    entropy: float = 1.8
    keep_ratio: float = 0.5
    json_limit: int = 5
    signatures: bool = True
    drop_below: float = 0.05
    coalesce_chars: int = 100
    ledger: bool = True
    reorder: bool = False
    summarise: bool = False
    mask: bool = False
    model_facts: bool = False
    model_scores: bool = False
    price: float = DEFAULT_PRICE
    model: str | None = None
    tier: str | None = None
    policies: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.token_budget is not None and self.token_budget < 100:
            raise ValueError("token_budget must be at least 100")
        if not 0.1 <= self.keep_ratio <= 1:
            raise ValueError("keep_ratio must lie between 0.1 and 1")
        if not 0 <= self.dedup_threshold <= 1 or self.recent_turns < 0 or self.entropy < 0:
            raise ValueError("a threshold is out of range")
        if self.tier not in (None, "full", "standard", "fast", "ultra_fast"):
            raise ValueError(f"unknown tier {self.tier!r}")
        if self.model is not None:
            if self.token_budget is None and self.model in BUDGETS:
                object.__setattr__(self, "token_budget", BUDGETS[self.model])
            if self.price == DEFAULT_PRICE:
                object.__setattr__(self, "price", PRICES.get(self.model, DEFAULT_PRICE))


# Presets.
PRESETS = {
    "coding": {"recent_turns": 3, "entropy": 2.5, "keep_ratio": 0.7, "signatures": True, "dedup_threshold": 0.90, "drop_below": 0.03, "json_limit": 3, "policies": {"ERROR_TRACE": "PRESERVE", "CODE_BLOCK": "SIGNATURE"}},
    "research": {"recent_turns": 2, "entropy": 1.8, "keep_ratio": 0.5, "signatures": False, "json_limit": 3, "dedup_threshold": 0.80, "drop_below": 0.08},
    "support": {"recent_turns": 5, "entropy": 1.5, "keep_ratio": 0.4, "signatures": False, "summarise": True, "dedup_threshold": 0.75, "drop_below": 0.10, "json_limit": 2},
    "data": {"recent_turns": 3, "entropy": 2.0, "keep_ratio": 0.6, "signatures": False, "json_limit": 10, "dedup_threshold": 0.85, "drop_below": 0.05},
    "general": {"recent_turns": 2, "entropy": 1.8, "keep_ratio": 0.5, "dedup_threshold": 0.80, "drop_below": 0.05},
}


def preset(name: str, **overrides) -> Config:
    if name not in PRESETS:
        raise ValueError(f"unknown preset {name!r}; there are {', '.join(sorted(PRESETS))}")
    return Config(**(PRESETS[name] | overrides))


def reconfigured(config: Config, **changes) -> Config:
    unknown = set(changes) - set(asdict(config))
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return replace(config, **changes)


def model_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m, w, r) for m, (w, r) in MODELS.items()], "prefix string, model_window long, model_reserve long")


def looked_up(df: DataFrame, model_col: str = "model") -> DataFrame:
    """``df`` with window and reserve of each model by the longest prefix in any case; the defaults for unknown ones.

    The table has 17 rows, so it is broadcast.
    """
    m = F.broadcast(model_table(df.sparkSession))
    names = df.select(model_col).distinct()
    j = names.join(m, F.lower(F.col(model_col)).startswith(F.col("prefix")), "left")
    best = j.withColumn("_k", F.row_number().over(Window.partitionBy(model_col).orderBy(F.length("prefix").desc_nulls_last()))).where("_k = 1")
    best = best.select(F.col(model_col).alias("_m"), F.coalesce("model_window", F.lit(DEFAULT_WINDOW)).cast("long").alias("window"), F.coalesce("model_reserve", F.lit(DEFAULT_RESERVE)).cast("long").alias("reserve"))
    return df.join(best, df[model_col].eqNullSafe(best["_m"])).drop("_m")


def estimate(messages: DataFrame) -> DataFrame:
    """(conv_id, estimate): ten tokens for 35 characters of a conversation, and its user rows."""
    return messages.groupBy("conv_id").agg(F.expr("sum(length(content)) * 10 div 35").alias("estimate"), F.sum((F.col("role") == "user").cast("long")).alias("user_turns"))


def pressure(df: DataFrame) -> DataFrame:
    """capacity, available, usage_ratio and pressure from window, usage and reserve."""
    cap = F.greatest(F.lit(0), F.col("window") - F.col("reserve"))
    df = df.withColumn("capacity", cap).withColumn("available", F.greatest(F.lit(0), F.col("capacity") - F.col("usage")))
    ratio = F.when(F.col("capacity") == 0, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("usage") / F.nullif(F.col("capacity"), F.lit(0)))))
    left = 1 - F.col("usage_ratio")
    return df.withColumn("usage_ratio", ratio).withColumn("pressure", F.when(left > 0.60, "NONE").when(left > 0.40, "LOW").when(left > 0.25, "MEDIUM").when(left > 0.10, "HIGH").otherwise("CRITICAL"))


def thresholds(df: DataFrame, config: Config) -> DataFrame:
    """Adaptive settings by pressure: recent turns, budget, keep ratio, entropy, engines, masking, summaries; ``skip`` where
    there is no pressure. Halves are rounded to even."""

    def pick(i: int, default) -> Column:
        c = F.lit(None)
        for name, row in K.PRESSURE.items():
            c = F.when(F.col("pressure") == name, F.lit(row[i])).otherwise(c)
        return F.coalesce(c, F.lit(default))

    turns = F.when(F.col("user_turns") > 0, F.least(F.lit(config.recent_turns), F.greatest(F.lit(1), F.bround(F.col("user_turns") * pick(0, 0.3)).cast("int")))).otherwise(F.lit(config.recent_turns))
    budget = F.when(F.col("pressure") != "NONE", F.greatest(F.lit(100), F.floor(F.col("available") * pick(1, 1.0)).cast("long")))
    if config.token_budget is not None:
        budget = F.when(F.col("pressure") != "NONE", F.least(budget, F.lit(config.token_budget))).otherwise(F.lit(config.token_budget))
    engines = F.element_at(F.create_map(*[x for k, v in K.ENGINES.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))]), F.col("pressure"))
    hard = F.col("pressure").isin("HIGH", "CRITICAL")
    on = F.col("pressure") != "NONE"
    return df.withColumns(
        {
            "skip": ~on,
            "recent_turns": F.when(on, turns).otherwise(F.lit(config.recent_turns)),
            "budget": budget.cast("long"),
            "keep_ratio": F.when(on, F.greatest(F.lit(0.1), F.lit(config.keep_ratio) * pick(2, 1.0))).otherwise(F.lit(config.keep_ratio)),
            "entropy": F.when(on, F.greatest(F.lit(0.3), F.lit(config.entropy) * pick(3, 1.0))).otherwise(F.lit(config.entropy)),
            "engines": engines,
            "mask": hard | F.lit(config.mask),
            "summarise": (F.col("pressure") == "CRITICAL") | F.lit(config.summarise),
            "forced_tier": F.when(hard, "full"),
        }
    )


def resolved(messages: DataFrame, windows: DataFrame) -> DataFrame:
    """``windows`` (conv_id and window, usage, reserve, or model) with the usage raised to the messages' own estimate."""
    return windows.join(estimate(messages), "conv_id").withColumn("usage", F.greatest(F.coalesce("usage", F.lit(0)), "estimate"))
