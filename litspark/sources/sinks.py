"""Sinks (SNK1-SNK5): partitioned, distributed writes; nothing passes the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litspark.functions.text import decade


def with_decades(df: DataFrame, year_col: str = "year") -> DataFrame:
    """Every row once under the decade 'all' and, if its year lies in one, once
    under its decade slice: one scan, each row doubled where it is read."""
    slices = F.array_compact(F.array(F.lit("all"), decade(year_col)))
    return df.withColumn("decade", F.explode(slices))


def quoted_line(*cols: str) -> Column:
    """A CSV record of the columns, all fields quoted."""
    return F.to_csv(F.struct(*cols), {"quoteAll": "true", "escape": '"'})


def set_name(names: list[str]) -> Column:
    """The folder of a row's output set: name=value parts."""
    return F.concat_ws("/", *[F.concat(F.lit(f"{n}="), F.col(n).cast("string")) for n in names])


def write_with_decades(df: DataFrame, path: str, year_col: str = "year", fmt: str = "parquet") -> None:
    """SNK1: the whole result plus one copy per decade slice, as one write
    partitioned by ``decade`` ('all' holds every row)."""
    with_decades(df, year_col).write.mode("overwrite").partitionBy("decade").format(fmt).save(path)


def write_quoted_csv(df: DataFrame, path: str) -> None:
    """SNK2: CSV with every field quoted and '"' as escape character."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_named_sets(df: DataFrame, path: str, names: list[str], fmt: str = "csv") -> None:
    """SNK3: one output set per name combination (e.g. subject, perspective,
    slice) in a single partitioned write."""
    w = df.write.mode("overwrite").partitionBy(*names)
    (w.option("header", True).csv(path) if fmt == "csv" else w.format(fmt).save(path))


def write_text_list(df: DataFrame, col: str, path: str) -> None:
    """SNK4: one element per line."""
    df.select(F.col(col).cast("string").alias("value")).write.mode("overwrite").text(path)


def removed_rows(df: DataFrame, keep: Column, drop_cols: list[str]) -> DataFrame:
    """SNK5: the rows a filter removes, without the large columns."""
    return df.where(~keep | keep.isNull()).drop(*drop_cols)
