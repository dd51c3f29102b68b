"""Registered queries: the row logic of sources and sinks over the tables. The
same functions stand behind the file readers and writers, whose round trips are
covered by tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from litspark.functions import text as tx
from litspark.sources import files as fs
from litspark.sources import sinks as sk
from litspark.plans.catalog import register
from litspark.sources.tables import Tables


@register("src5_listed_documents", """
SELECT doc_id, n_chars FROM documents SEMI JOIN labels USING (doc_id)""")
def src5(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.documents.join(t.labels.select("doc_id"), "doc_id", "left_semi").select("doc_id", "n_chars")


# Parameters of the folder reader (weeks 1-3, two files per folder, 20 rows per file).
SRC6 = dict(num_rand_files=2, start_week=1, end_week=3, nrows=20, language="en", seed=17)


def _events_as_json_folders(t: Tables):
    """Events seen as a folder tree: one folder per ISO week, one file per (day,
    event type), rows in time order; language derived from the JSON payload."""
    e = t.events
    k = F.get_json_object("props", "$.k").try_cast("int")
    return e.select("event_id", "ts", F.concat(F.lit("2024-week"), F.weekofyear("ts").cast("string")).alias("folder"),
                    F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("-"), F.col("event_type"), F.lit(".json")).alias("file"),
                    F.when(k % 2 == 0, "en").otherwise("fr").alias("lang"))


@register("src6_json_folder_rows", f"""
WITH e AS (SELECT event_id, ts, '2024-week' || CAST(weekofyear(ts) AS VARCHAR) AS folder,
                  strftime(ts, '%Y-%m-%d') || '-' || event_type || '.json' AS file,
                  CASE WHEN CAST(json_extract(props, '$.k') AS INTEGER) % 2 = 0 THEN 'en' ELSE 'fr' END AS lang
           FROM events),
w AS (SELECT * FROM e WHERE CAST(regexp_extract(folder, 'week(\\d+)$', 1) AS INTEGER) BETWEEN {SRC6['start_week']} AND {SRC6['end_week']}),
f AS (SELECT folder, file FROM (
        SELECT folder, file, row_number() OVER (PARTITION BY folder ORDER BY md5('{SRC6['seed']}:' || file), file) AS r
        FROM (SELECT DISTINCT folder, file FROM w)) WHERE r <= {SRC6['num_rand_files']}),
r AS (SELECT *, row_number() OVER (PARTITION BY folder, file ORDER BY ts, event_id) AS rn FROM w SEMI JOIN f USING (folder, file))
SELECT event_id, folder, lang AS language FROM r WHERE rn <= {SRC6['nrows']} AND lang = 'en'""")
def src6(spark, sf_dir):
    d = _events_as_json_folders(Tables(spark, sf_dir))
    # in-file order: event time in microseconds (ties by id are ranked by the final window)
    out = fs.select_json_rows(d.withColumn("folder_name", F.col("folder")), F.col("folder"), F.col("file"),
                              F.unix_micros(F.col("ts").cast("timestamp")), **SRC6)
    return out.select("event_id", F.col("folder_name").alias("folder"), "language")


@register("snk5_removed_rows_without_text", """
SELECT doc_id, lang, source, n_chars FROM documents WHERE NOT (n_chars >= 1000)""")
def snk5(spark, sf_dir):
    d = Tables(spark, sf_dir).documents
    return sk.removed_rows(d, F.col("n_chars") >= 1000, ["text"])


@register("src1_3_snk2_csv_records", "SELECT doc_id, lang, source, n_chars FROM documents")
def csv_records(spark, sf_dir):
    """Rows written as fully quoted CSV records and read again with a schema."""
    d = Tables(spark, sf_dir).documents
    lines = d.select(sk.quoted_line("doc_id", "lang", "source", "n_chars").alias("line"))
    return fs.csv_fields(lines, "line", "doc_id long, lang string, source string, n_chars long")


@register("src4_snk4_text_lines", """
SELECT doc_id, CAST(p - 1 AS INTEGER) AS line_no, l[p] AS line
FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))""")
def text_lines(spark, sf_dir):
    return fs.text_lines(Tables(spark, sf_dir).documents, "doc_id", "text")


@register("src7_vector_lines", """
SELECT 'w' || CAST(vec_id AS VARCHAR) AS word, CAST(dim - 1 AS INTEGER) AS dim, round(CAST(embedding[dim] AS DOUBLE), 6) AS value
FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS dim FROM embeddings)""")
def src7(spark, sf_dir):
    """The vector table as lines 'word v1 ... vn', parsed again."""
    e = Tables(spark, sf_dir).embeddings
    lines = e.select(F.concat_ws(" ", F.concat(F.lit("w"), F.col("vec_id").cast("string")), F.col("embedding").cast("array<string>")).alias("line"))
    v = fs.vector_lines(lines, "line").select("word", F.posexplode("vector").alias("dim", "value"))
    return v.select("word", "dim", F.round(F.col("value").cast("double"), 6).alias("value"))


@register("src8_dictionary_lines", """
SELECT term, len(string_split_regex(term, '\\s+')) > 1 AS multi FROM (
  SELECT trim(replace(unnest(string_split(text, chr(10))), ',', ' ')) AS term FROM benchmark) WHERE length(term) > 0""")
def src8(spark, sf_dir):
    lines = fs.text_lines(Tables(spark, sf_dir).benchmark, "item_id", "text")
    return fs.dictionary_lines(lines, "line")


@register("snk1_decade_copies", """
WITH a AS (SELECT doc_id, 1970 + doc_id % 47 AS year FROM documents)
SELECT doc_id, 'all' AS decade FROM a
UNION ALL SELECT doc_id, d.decade FROM a JOIN (VALUES """ + ", ".join(f"({lo}, {hi}, '{lo}_{hi}')" for lo, hi in tx.DECADES) + """) d(lo, hi, decade)
  ON year BETWEEN lo AND hi""")
def snk1(spark, sf_dir):
    d = Tables(spark, sf_dir).documents.select("doc_id", (F.lit(1970) + F.col("doc_id") % 47).cast("int").alias("year"))
    return sk.with_decades(d).select("doc_id", "decade")


@register("snk3_named_sets", """
SELECT 'lang=' || lang || '/source=' || source AS set_name, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1""")
def snk3(spark, sf_dir):
    d = Tables(spark, sf_dir).documents
    return d.groupBy(sk.set_name(["lang", "source"]).alias("set_name")).agg(F.count(F.lit(1)).alias("n"))


@register("snk3_named_set_rows", """
SELECT doc_id, 'lang=' || lang || '/source=' || source AS set_name FROM documents""")
def snk3_rows(spark, sf_dir):
    """The set that each row is written to."""
    d = Tables(spark, sf_dir).documents
    return d.select("doc_id", sk.set_name(["lang", "source"]).alias("set_name"))
