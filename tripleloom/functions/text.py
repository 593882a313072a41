"""Text expressions: tokens, spelling, rendering."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def tokens(text: Column) -> Column:
    """White-space tokens in order."""
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


@F.pandas_udf(DoubleType())
def sequence_ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Matching-blocks ratio 2M / T of (candidate, stored); the order of the two matters."""
    for a, b in pairs:
        yield pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def triple_text(subject: Column, relation: Column, object_: Column) -> Column:
    return F.concat(F.lit("("), subject, F.lit(")-["), relation, F.lit("]->("), object_, F.lit(")"))


def past_mark(is_current: Column, mark: str = " [past]") -> Column:
    """A mark for facts that are not current; unknown counts as past."""
    return F.when(F.coalesce(is_current, F.lit(False)), F.lit("")).otherwise(F.lit(mark))


def sse_frame(text: Column) -> Column:
    """A server-sent event: each line with its field name, then an empty line."""
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.concat(F.lit("data: "), x, F.lit("\n")))
    return F.concat(F.array_join(lines, ""), F.lit("\n"))


def present(value: Column) -> Column:
    """Neither null nor empty."""
    return value.isNotNull() & (value != "")
