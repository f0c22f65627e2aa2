"""Conversation history: windows over sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def map_roles(role: Column) -> Column:
    """human or ai; other roles null."""
    return F.when(role.isin("user", "human"), "human").when(role.isin("assistant", "ai"), "ai")


def as_history(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) as id, session_id, role, content; roles that are neither human nor ai go."""
    return conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("session_id"), map_roles(F.col("role")).alias("role"), F.col("text").alias("content"), F.col("turn").alias("created_at")).filter("role is not null")


def last_n_messages(history: DataFrame, n: int = 10) -> DataFrame:
    """The last n messages of each session with pos, oldest first. The row limit is pushed below the shuffle."""
    late = Window.partitionBy("session_id").orderBy(F.col("created_at").desc(), F.col("id").desc())
    kept = history.withColumn("_n", F.row_number().over(late)).filter(F.col("_n") <= n)
    early = Window.partitionBy("session_id").orderBy(F.col("_n").desc())
    return kept.withColumn("pos", F.row_number().over(early).cast("long")).drop("_n")


def turn_context(history: DataFrame, turns: int = 3, width: int = 100) -> DataFrame:
    """For each human message: the labelled last `turns` messages before it, cut to `width` characters."""
    w = Window.partitionBy("session_id").orderBy("created_at", "id").rowsBetween(-turns, -1)
    label = F.concat(F.when(F.col("role") == "human", "用户").otherwise("AI"), F.lit("："), F.substring("content", 1, width))
    return history.withColumn("context", F.array_join(F.collect_list(label).over(w), "\n")).filter("role = 'human'").select("session_id", "id", "content", "context")


def session_stats(history: DataFrame) -> DataFrame:
    return history.groupBy("session_id").agg(F.count("*").alias("n_messages"), F.count_if(F.col("role") == "human").alias("n_human"), F.count_if(F.col("role") == "ai").alias("n_ai"))


def append_turns(turns: DataFrame) -> DataFrame:
    """turns(session_id, turn, question, answer) as two history rows each, human before ai."""
    pair = F.array(F.struct(F.lit("human").alias("role"), F.col("question").alias("content"), F.lit(0).alias("o")), F.struct(F.lit("ai").alias("role"), F.col("answer").alias("content"), F.lit(1).alias("o")))
    return turns.select("session_id", "turn", F.explode(pair).alias("m")).select("session_id", (F.col("turn") * 2 + F.col("m.o")).alias("pos"), "m.role", "m.content").filter("content is not null")
