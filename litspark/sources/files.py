"""File sources (SRC1-SRC8). Every reader returns a lazy DataFrame; projection
and filters written after it reach the scan."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_headerless(spark: SparkSession, path: str, names: list[str], types: str = "string", **opts) -> DataFrame:
    """SRC1: delimited file without a header, columns named by the caller."""
    schema = ", ".join(f"`{n}` {types}" for n in names)
    return spark.read.options(header=False, **opts).schema(schema).csv(path)


def read_csv_columns(spark: SparkSession, path: str, columns: list[str], schema: StructType | str | None = None,
                     encoding: str | None = None, **opts) -> DataFrame:
    """SRC2/SRC3: headered CSV projected to the needed columns; ``encoding``
    for files written in another charset. One beyond the standard set (such as
    windows-1252) needs ``spark.sql.legacy.javaCharsets=true``, which is the
    caller's to set."""
    r = spark.read.options(header=True, multiLine=True, escape='"', **opts)
    if encoding:
        r = r.option("encoding", encoding)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", False)
    return r.csv(path).select(*columns)


def read_whole_texts(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """SRC4: one row per file (path, text), or one row per line with ``lines``."""
    if lines:
        d = spark.read.text(path)
        return d.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    d = spark.read.text(path, wholetext=True)  # the keyword, not .option(): text() resets it
    return d.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_listed_texts(spark: SparkSession, path: str, listed: DataFrame, name_col: str = "file_name") -> DataFrame:
    """SRC5: texts of the files named in ``listed`` only (semi-join on the
    file's base name)."""
    t = read_whole_texts(spark, path).withColumn(name_col, F.element_at(F.split("path", "/"), -1))
    return t.join(listed.select(name_col), name_col, "left_semi")


#: File names that the folder reader takes.
JSON_FILES = "*.{json,json.gz}"


def list_files(spark: SparkSession, root: str, levels: int) -> DataFrame:
    """(path, folder, name) of the JSON files under ``root`` (one level) or its
    folders (two), listed without opening any."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", JSON_FILES).load(f"{root}/*" if levels == 2 else root)
    parts = F.split("path", "/")  # content isn't asked for, so it isn't read
    return files.select("path", F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("name"))


def _literal(path: str) -> str:
    """A path whose characters mean themselves, not patterns."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def read_json_folders(spark: SparkSession, root: str, schema: StructType | str, num_rand_files: int = 0,
                      start_week: int = -1, end_week: int = 0, nrows: int = 50, language: str = "en",
                      seed: int = 0, levels: int = 2) -> DataFrame:
    """SRC6: JSON lines under ``root/<year>-week<N>/<file>`` (two levels) or in
    ``root`` itself (one level, weeks don't matter). Folders outside [start_week,
    end_week] are skipped (end_week 0 = open), ``num_rand_files`` files per folder
    are chosen by the hash of their names (0 = all), the first ``nrows`` rows of
    each file are kept, ``lang`` is folded into ``language`` and rows of other
    languages are dropped.

    Files are chosen from a listing; no other file is opened. A file cut into
    splits keeps its order: by the split's place, then inside it. Without any file
    the frame is empty."""
    from litspark.operators.sampling import first_n_by_hash
    listed = list_files(spark, root, levels)
    if levels == 2:
        listed = listed.where(_weeks(F.col("folder"), start_week, end_week))
    if num_rand_files > 0:
        chosen = first_n_by_hash(listed, num_rand_files, "name", seed, ["folder"])
        paths = [_literal(r["path"]) for r in chosen.select("path").collect()]  # that many per folder
    else:
        folders = [r["f"] for r in listed.select(F.regexp_replace("path", "/[^/]*$", "").alias("f")).distinct().collect()]
        paths = [f"{_literal(f)}/{JSON_FILES}" for f in folders]
    if not paths:
        d = spark.createDataFrame([], schema)
        d = d.withColumn("_file", F.lit(""))
        order = F.lit(0)
    else:
        place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
        d = spark.read.schema(schema).json(paths).select("*", F.col("_metadata.file_path").alias("_file"), place.alias("_place"))
        order = F.col("_place")
    return first_rows(d, [F.col("_file")], order, nrows, language).drop("_file", "_place")


def week_of_folder(folder: Column) -> Column:
    return F.regexp_extract(folder, r"week(\d+)$", 1).try_cast("int")


def _weeks(folder: Column, start_week: int, end_week: int) -> Column:
    week = week_of_folder(folder)
    return (week >= F.lit(start_week)) & (week <= F.lit(end_week)) if end_week > 0 else week >= F.lit(start_week)


def first_rows(d: DataFrame, file: list[Column], order: Column, nrows: int, language: str) -> DataFrame:
    """The first rows of each file, of those the rows in one language."""
    from litspark.operators.windows import top_k
    names = [f"_f{k}" for k in range(len(file))]
    d = d.withColumns(dict(zip(names, file))).withColumn("_ord", order)
    d = top_k(d, names, F.col("_ord"), nrows, [F.col("_ord").asc()], descending=False, rank_name="_r")
    cols = d.columns
    if "lang" in cols:
        d = d.withColumn("language", F.coalesce("lang", "language") if "language" in cols else F.col("lang")).drop("lang")
    return d.where(F.col("language") == F.lit(language)).drop(*names, "_ord", "_r")


def select_json_rows(d: DataFrame, folder: Column, file: Column, order: Column, num_rand_files: int,
                     start_week: int, end_week: int, nrows: int, language: str, seed) -> DataFrame:
    """The row selection of SRC6 on any frame with folder, file and in-file order."""
    from litspark.operators.sampling import first_n_by_hash
    d = d.withColumn("_folder", folder).withColumn("_fname", file)
    d = d.where(_weeks(F.col("_folder"), start_week, end_week))
    if num_rand_files > 0:
        files = d.select("_folder", "_fname").distinct()
        chosen = first_n_by_hash(files, num_rand_files, "_fname", seed, ["_folder"])
        d = d.join(chosen, ["_folder", "_fname"], "left_semi")
    return first_rows(d, [F.col("_folder"), F.col("_fname")], order, nrows, language).drop("_folder", "_fname")


def csv_fields(df: DataFrame, col: str, schema: str) -> DataFrame:
    """The fields of CSV records (SRC1-SRC3 on a column of lines)."""
    return df.select(F.from_csv(col, schema, {"escape": '"'}).alias("r")).select("r.*")


def text_lines(df: DataFrame, key: str, col: str) -> DataFrame:
    """(key, line_no, line): a text as its list of lines (SRC4, SNK4)."""
    return df.select(key, F.posexplode(F.split(col, "\n", -1)).alias("line_no", "line"))


def read_embedding_text(spark: SparkSession, path: str) -> DataFrame:
    """SRC7: 'word v1 ... vn' lines -> (word, array<float>)."""
    return vector_lines(spark.read.text(path), "value")


def vector_lines(df: DataFrame, col: str) -> DataFrame:
    """(word, vector) of lines 'word v1 ... vn'; lines without a number go."""
    parts = F.split(F.trim(F.col(col)), " +")
    d = df.select(parts.alias("p")).where(F.size("p") > 1)
    return d.select(F.element_at("p", 1).alias("word"),
                    F.transform(F.slice("p", 2, F.size("p") - 1), lambda x: x.cast("float")).alias("vector"))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """SRC8: one term per line, commas read as spaces; ``multi`` marks terms of
    more than one whitespace-separated word."""
    return dictionary_lines(spark.read.text(path), "value")


def dictionary_lines(df: DataFrame, col: str) -> DataFrame:
    """(term, multi) of dictionary lines; empty lines go."""
    d = df.select(F.trim(F.regexp_replace(col, ",", " ")).alias("term"))
    d = d.where(F.length("term") > 0)
    return d.withColumn("multi", F.size(F.split("term", r"\s+")) > 1)

