"""Row filters and predicates (FLT*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fuzzy_prediction(p_yes: Column, lower: float = 0.1, upper: float = 0.5) -> Column:
    """lower <= p(pred) - p(other) <= upper, with p_no = 1 - p_yes; the
    difference is |2 p_yes - 1|."""
    margin = F.abs(F.lit(2.0) * p_yes - F.lit(1.0))
    return (margin >= F.lit(lower)) & (margin <= F.lit(upper))


def band_around_median(df: DataFrame, value: str, group: list[str]) -> DataFrame:
    """Label rows strictly within one population std below ('below') or above
    ('above') their group's median; other rows are dropped.

    Per-group statistics are one partial aggregate; they are joined back on
    the group key (one row per group)."""
    from litspark.operators.aggregates import exact_percentiles
    clean = df.where(~F.isnan(value))
    med = exact_percentiles(clean, value, group, [0.5]).select(*group, F.col("value").alias("median"))
    stats = clean.groupBy(*group).agg(F.stddev_pop(value).alias("std")).join(med, group)
    j = df.join(stats, group)  # one row per group: broadcast by AQE from its measured size
    band = (F.when((F.col(value) > F.col("median") - F.col("std")) & (F.col(value) < F.col("median")), "below")
            .when((F.col(value) > F.col("median")) & (F.col(value) < F.col("median") + F.col("std")), "above"))
    return j.withColumn("band", band).where(F.col("band").isNotNull())
