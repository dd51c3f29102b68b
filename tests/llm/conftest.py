import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

LONG = "lorem ipsum dolor sit amet " * 3000
#: (doc_id, text): null, empty, blank, short, tied, repeated and very long texts.
EDGE = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "one  two"), (6, "a b c d e f g h i j k l m n o p"),
    (6, "a b c d e f g h i j k l m n o p"), (7, "a b c d e f g h i j k l m n o p q"), (8, LONG), (9, LONG + "end"),
    (10, "x" * 30000), (11, "écoute é 日本語 𝄞 ß. Ok!"), (12, "mail me at jane.doe@mail.example.com or +1 (555) 555-0134."),
    (None, "no id here but words enough for a shingle"), (13, "no id here but words enough for a shingle"),
]
EXTRA = "doc_id bigint, text string, n int, h string, kept string, row int, value double, label int, score double, node int, key int, sha string"


@pytest.fixture(scope="session")
def edge(spark):
    """The edge rows beside columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, 1, "h", "k", 2, 0.5, 7, 0.1, 3, 4, None) for i, t in EDGE], EXTRA)


@pytest.fixture(scope="session")
def none(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.createDataFrame([(1, "C d e f g h i j k l"), (2, "one, TWO"), (3, None), (4, ""), (None, "words enough for a shingle"),
                                  (5, "one two"), (6, "m n o p q r s t u v w")], "item_id bigint, text string")


def texts():
    return [(i, t or "") for i, t in EDGE]
