"""Model quality and endpoint health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import col, lookup

# Prestige points by provider slug; other providers have 15.
PRESTIGE = {
    "openai": 50,
    "anthropic": 50,
    "google": 50,
    "x-ai": 50,
    "deepseek": 38,
    "qwen": 38,
    "meta-llama": 38,
    "mistralai": 38,
    "cohere": 38,
    "nvidia": 38,
    "alibaba": 38,
    "microsoft": 28,
    "01-ai": 28,
    "minimax": 28,
    "moonshot": 28,
    "z-ai": 28,
    "nousresearch": 28,
    "ai21": 28,
    "perplexity": 28,
    "liquid": 18,
    "cognitivecomputations": 18,
    "venice": 18,
    "inflection": 18,
}
# Fixed values: (limit, points) bands and penalised name parts.
RECENCY_DAYS = [(60, 20), (180, 16), (365, 12), (540, 9), (730, 6), (1095, 3)]
PRICE_BANDS = [(20.0, 15), (5.0, 12), (1.0, 9), (0.3, 6), (0.05, 4)]
CONTEXT_BANDS = [(1_000_000, 10), (400_000, 8), (200_000, 6), (128_000, 4), (100_000, 2)]
SMALL_OR_OLD = ["-1b-", "-1.2b-", "-1.5b-", "-2b-", "-3b-", "gemma-3n", "lfm-", "-base", "-distill", ":nitro", "-preview"]
UPTIME_GATE = 90.0


def _bands(value: Column, bands: list[tuple[float, int]], at_least: bool = True) -> Column:
    out = None
    for limit, points in bands:
        hit = value >= limit if at_least else value <= limit
        out = F.when(hit, points) if out is None else out.when(hit, points)
    return out


def quality_score(model: str, created: str, prompt: str, completion: str, context: str, params: str, now: int) -> Column:
    """0 to 100 from provider, age, price, context window, abilities and name."""
    slug = F.lower(F.element_at(F.split(F.col(model), "/"), 1))
    provider = F.when(F.contains(col(model), F.lit("/")), lookup(slug, PRESTIGE, F.lit(15))).otherwise(0)
    age = F.greatest(F.lit(0), F.floor((F.lit(now) - F.col(created)) / 86_400))
    recent = F.when(F.coalesce(F.col(created) > 0, F.lit(False)), F.coalesce(_bands(age, RECENCY_DAYS, False), F.lit(0))).otherwise(0)
    price = (F.coalesce(F.col(prompt), F.lit(0.0)) + F.coalesce(F.col(completion), F.lit(0.0))) * 1_000_000
    priced = F.coalesce(_bands(price, PRICE_BANDS), F.when(price > 0, 2).otherwise(0))
    window = F.coalesce(_bands(F.col(context), CONTEXT_BANDS), F.lit(0))
    has = lambda *names: F.coalesce(F.arrays_overlap(F.col(params), F.array(*[F.lit(n) for n in names])), F.lit(False))
    able = (
        F.when(has("tools"), 2).otherwise(0) + F.when(has("structured_outputs", "response_format"), 2).otherwise(0)
        + F.when(has("reasoning", "include_reasoning"), 1).otherwise(0)
    )
    small = F.when(F.lower(model).rlike("|".join(f"\\Q{p}\\E" for p in SMALL_OR_OLD)), -10).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), provider + recent + priced + window + able + small)).cast("int")


def percent(c: Column | str) -> Column:
    """Uptime as a percentage; fractions up to 1 are scaled, negative values count as unknown."""
    v = col(c).cast("double")
    return F.when(v < 0, None).when(v <= 1.0, v * 100.0).otherwise(v)


def endpoint_health(endpoints: DataFrame, model: str = "model") -> DataFrame:
    """Gate and health score per model over its endpoints (status, up_5m, up_30m, up_1d)."""
    rows = endpoints.groupBy(model).agg(
        F.coalesce(F.bool_or(F.coalesce("status", F.lit(1)) == 0), F.lit(False)).alias("ok"),
        *[F.max(percent(c)).alias(c) for c in ("up_5m", "up_30m", "up_1d")],
    )
    best, fresh = F.coalesce("up_30m", "up_1d", "up_5m"), F.coalesce("up_5m", "up_30m", "up_1d")
    gated = ~F.col("ok") | best.isNull() | (best < UPTIME_GATE)
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 0.50 * best + 0.30 * 100.0 + 0.20 * fresh))
    return rows.select(model, gated.alias("gated"), F.round(F.when(~gated, score), 6).alias("health"))
