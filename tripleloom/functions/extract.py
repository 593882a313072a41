"""Triples, entity names and keywords out of a language model's JSON answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import LLM_RESULT
from .text import present, tokens


def parsed(json: Column) -> Column:
    """The answer as a struct; fields of a malformed answer are null."""
    return F.from_json(json, LLM_RESULT)


def items(answers: DataFrame, json: str) -> DataFrame:
    """The answers' rows, one for each item, with its place."""
    rest = [c for c in answers.columns if c != json]
    return answers.select(*rest, F.posexplode(parsed(F.col(json))["kg_entity"]).alias("place", "item"))


def triples(answers: DataFrame, json: str = "answer") -> DataFrame:
    """Items with all three fields present, empty ones included: subject, relation, object."""
    i = F.col("item")
    full = i["subject"].isNotNull() & i["relation"].isNotNull() & i["object"].isNotNull()
    return items(answers, json).filter(full).select("*", "item.*").drop("item")


def entity_names(answers: DataFrame, key: str, json: str = "answer") -> DataFrame:
    """Distinct subjects and objects of an answer that are not empty."""
    both = items(answers, json).select(key, F.explode(F.array("item.subject", "item.object")).alias("name"))
    return both.filter(present(F.col("name"))).distinct()


def keywords(rows: DataFrame, key: str, text: str) -> DataFrame:
    """White-space tokens of each text, with their place."""
    return rows.select(key, F.posexplode(tokens(F.col(text))).alias("place", "token"))


def routed(answers: DataFrame, json: str = "answer", known: tuple[str, ...] = ("information", "other")) -> DataFrame:
    """The handler of each answer; ``error`` for a tool that is not known."""
    tool = parsed(F.col(json))["tool_name"]
    return answers.withColumn("handler", F.when(tool.isin(*known), tool).otherwise(F.lit("error")))
