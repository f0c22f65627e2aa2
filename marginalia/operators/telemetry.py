"""Telemetry roll-ups; each takes a batch or a streaming frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Price per 1000 tokens (prompt, completion) by model.
PRICES = (("gpt-3.5-turbo", 0.0015, 0.002), ("gpt-4", 0.03, 0.06), ("deepseek-chat", 0.001, 0.002), ("default", 0.001, 0.002))


def price_table(spark) -> DataFrame:
    """Four rows."""
    return spark.createDataFrame(PRICES, "model string, p_in double, p_out double")


def latency_rollup(events: DataFrame, kind: str = "event_type", latency: str = "value") -> DataFrame:
    return events.groupBy(kind).agg(F.count("*").alias("n"), F.round(F.sum(latency), 4).alias("total"), F.round(F.avg(latency), 4).alias("mean"))


def with_cost(events: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds cost to events(model, prompt_tokens, completion_tokens) by the price list, one row a model; unknown models have the price of 'default'. A stream or a batch; Spark picks the join by the list's size."""
    fallback = prices.filter("model = 'default'").agg(F.first("p_in").alias("d_in"), F.first("p_out").alias("d_out"))  # one row
    p, c = F.coalesce("prompt_tokens", F.lit(0)), F.coalesce("completion_tokens", F.lit(0))
    priced = events.join(prices.select("model", "p_in", "p_out"), "model", "left").crossJoin(F.broadcast(fallback))
    return priced.withColumn("cost", (p * F.coalesce("p_in", "d_in") + c * F.coalesce("p_out", "d_out")) / 1000).drop("p_in", "p_out", "d_in", "d_out")


def token_cost_rollup(events: DataFrame, prices: DataFrame, sessions: str = "session_id") -> DataFrame:
    """Totals by model of events(model, prompt_tokens, completion_tokens, session): tokens, cost by the price list ('default' for unknown models), mean tokens a session."""
    p, c = F.coalesce("prompt_tokens", F.lit(0)), F.coalesce("completion_tokens", F.lit(0))
    out = with_cost(events, prices).groupBy("model").agg(F.sum(p).alias("prompt_tokens"), F.sum(c).alias("completion_tokens"), F.round(F.sum("cost"), 4).alias("cost"), F.countDistinct(sessions).alias("n_sessions"))
    return out.withColumn("tokens_per_session", F.floor((F.col("prompt_tokens") + F.col("completion_tokens")) / F.greatest("n_sessions", F.lit(1))).cast("long"))


def telemetry_daily(events: DataFrame, ts: str = "ts", kind: str = "event_type") -> DataFrame:
    return events.groupBy(F.date_format(ts, "yyyyMMdd").alias("day"), kind).agg(F.count("*").alias("n"))


def load_summary(df: DataFrame, latency: str = "latency_ms", status: str = "status") -> DataFrame:
    return df.groupBy(status).agg(F.count("*").alias("n"), F.min(latency).alias("least"), F.round(F.avg(latency), 4).alias("mean"), F.max(latency).alias("most"))
