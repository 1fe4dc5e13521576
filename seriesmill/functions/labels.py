"""Label encodings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Label words that count as anomalous and as normal.
POSITIVE = ("1", "true", "yes", "y", "anomaly", "anomalous", "abnormal", "positive", "pos", "outlier")
NEGATIVE = ("0", "false", "no", "n", "normal", "negative", "neg", "nominal")


def normalized(label: Column, positive: tuple[str, ...] = POSITIVE, negative: tuple[str, ...] = NEGATIVE) -> Column:
    """Any label as 0 or 1: words by the lists, else numbers above 0, else 0; null is 0."""
    word = F.lower(F.trim(label.cast("string")))
    number = F.coalesce((label.try_cast("double") > 0).cast("int"), F.lit(0))
    return F.when(word.isin(*positive), 1).when(word.isin(*negative), 0).otherwise(number)
