"""Term dictionaries per perspective.

In a real run these are read from dictionary files (see ``files.read_dictionary``);
the fixed lists below are the test dictionaries: frequent words and word pairs
of the fixture corpus, chosen once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- fixed values (test dictionaries) ---
DICTIONARIES = {
    "cult": ["thatin", "orantion", "thble", "nicht", "eriner thanea"],
    "relt": ["ononst", "attion", "ertion", "mente", "attion to"],
    "demog": ["inoran", "hehely", "erble", "thing", "de la"],
    "orgs": ["oning", "ering", "retion", "antion", "thanedble the"],
}
# --- end fixed values ---


def all_terms() -> list[str]:
    return list(dict.fromkeys(t for terms in DICTIONARIES.values() for t in terms))


def multiword_terms() -> list[str]:
    """Terms of more than one whitespace token, longest first."""
    multi = [t for t in all_terms() if len(t.split()) > 1]
    return sorted(multi, key=lambda t: (-len(t.split()), -len(t), t))


def dictionary_table(spark: SparkSession) -> DataFrame:
    rows = [(p, t) for p, terms in DICTIONARIES.items() for t in terms]
    return spark.createDataFrame(rows, "perspective string, term string")
