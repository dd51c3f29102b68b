"""Input tables and the derived views every query builds on.

The derived views re-express the driver's generic tables in the shape of the
literature pipeline (articles with subjects and years, per-perspective
prediction scores, sentence and token streams). They are lazy DataFrames: a
query that needs only two columns of ``articles`` reads only those from parquet.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litspark.functions import text as tx

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# Fixed values of the fixture mapping: prime multipliers of the synthetic
# per-perspective probabilities, and the two subject names.
PERSPECTIVES = {"cult": 7919, "relt": 104729, "demog": 1299709, "orgs": 15485863}
SOCIOLOGY = "Sociology"
MANAGEMENT = "Management & Organizational Behavior"
FILE_PREFIX = "journal-article-10.2307_"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _first_words(n: int = 8):
    """The first n words of a text, whatever white space parts them."""
    words = F.split(F.trim(F.col("text"), F.lit(" \t\n\r")), "[ \t\n\r]+", n + 1)
    return F.array_join(F.slice(words, 1, n), " ")


class Tables:
    """Lazy access to the input tables and derived views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            df = read_table(self.spark, self.sf_dir, name)
            self.__dict__[name] = df
            return df
        raise AttributeError(name)

    # --- derived views --------------------------------------------------
    @cached_property
    def articles(self) -> DataFrame:
        d = self.documents
        return d.select(
            "doc_id", "text",
            F.col("source").alias("journal_title"),
            F.when(F.col("lang") == "en", F.lit(SOCIOLOGY)).otherwise(F.lit(MANAGEMENT)).alias("primary_subject"),
            (F.lit(1970) + F.col("doc_id") % 47).cast("int").alias("publication_year"),
            F.concat(F.lit(FILE_PREFIX), F.col("doc_id").cast("string")).alias("file_name"),
        )

    @cached_property
    def scores(self) -> DataFrame:
        """Per-perspective predictions: label, p_yes, p_no."""
        cols = [F.col("doc_id")]
        for p, prime in PERSPECTIVES.items():
            p_yes = ((F.col("doc_id") * F.lit(prime)) % 1000).cast("double") / F.lit(1000.0)
            cols += [tx.label_from_prob(p_yes).alias(f"prediction_{p}"),
                     p_yes.alias(f"prediction_{p}_prob_yes"),
                     (F.lit(1.0) - p_yes).alias(f"prediction_{p}_prob_no")]
        return self.documents.select(*cols)

    @cached_property
    def coded(self) -> DataFrame:
        """Hand-coded style table: quality and toxic as two perspective scores,
        NULL for documents without a label."""
        l = self.labels.select("doc_id", F.col("quality").cast("double").alias("cultural_score"),
                               F.col("toxic").cast("double").alias("relational_score"))
        return self.documents.select("doc_id").join(l, "doc_id", "left")

    @cached_property
    def sents(self) -> DataFrame:
        return self.documents.select("doc_id", F.posexplode(tx.sentences("text")).alias("sent_pos", "sentence"))

    @cached_property
    def tokens(self) -> DataFrame:
        return self.sents.select("doc_id", "sent_pos",
                                 F.posexplode(tx.tokenize("sentence")).alias("tok_pos", "token"))

    @cached_property
    def citations(self) -> DataFrame:
        """ASA-style citation list: the hand-coded (labelled) documents plus the
        benchmark passages, each cited by its first eight words (a stand-in: the
        documents carry no titles)."""
        first = _first_words()
        heads = self.documents.select("doc_id", first.alias("head"))  # before the join: no text is shuffled
        docs = heads.join(self.labels.select("doc_id"), "doc_id", "left_semi").select(
            F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("cite_id"),
            (F.lit(1970) + F.col("doc_id") % 47).cast("string").alias("year"), "head")
        bench = self.benchmark.select(
            F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("cite_id"),
            (F.lit(1970) + F.col("item_id") % 47).cast("string").alias("year"), first.alias("head"))
        return docs.unionByName(bench).select(
            "cite_id", F.concat(F.lit("Doe, Jane.  "), F.col("year"), F.lit(".  "), F.col("head"),
                                F.lit(".  Journal, 1 (2):  3-4.")).alias("citation"))

    @cached_property
    def doc_titles(self) -> DataFrame:
        """Metadata titles, normalised. The documents carry none: their first
        eight words stand in."""
        return self.documents.select("doc_id", tx.normalize_title(_first_words()).alias("title"))
