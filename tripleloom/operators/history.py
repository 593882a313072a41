"""Chat history windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_turns(turns: DataFrame, session: str, turn: str, n: int) -> DataFrame:
    """The last n turns of each session."""
    order = Window.partitionBy(session).orderBy(F.desc(turn))
    return turns.withColumn("back", F.row_number().over(order)).filter(F.col("back") <= n).drop("back")


def append_turns(history: DataFrame, new: DataFrame, session: str, turn: str, cap: int) -> DataFrame:
    """History with new read turns, each session capped; sessions without new turns stay as they are."""
    touched = new.select(session).distinct()
    grown = history.join(touched, session, "left_semi").select(history.columns).unionByName(new.select(history.columns))
    return history.join(touched, session, "left_anti").select(history.columns).unionByName(last_turns(grown, session, turn, cap))


def prompt_window(turns: DataFrame, session: str, turn: str, role: str, text: str, n: int) -> DataFrame:
    """One row for each session: its last n turns as text, in order."""
    last = last_turns(turns, session, turn, n)
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), F.concat(F.col(role), F.lit(": "), F.col(text)).alias("line")))), lambda x: x["line"])
    return last.groupBy(session).agg(F.array_join(lines, "\n").alias("window"))
