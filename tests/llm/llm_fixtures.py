import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def spark():
    from qalam.session import get_session
    s = get_session("local[4]", 8)
    from qalam.llm.common import prepare
    return prepare(s)


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns with clashing names."""
    long = "lorem ipsum dolor sit amet consectetur " * 4000
    rows = [(1, "alpha beta gamma delta epsilon zeta eta theta"), (1, "alpha beta gamma delta epsilon zeta eta theta"),
            (2, None), (3, ""), (None, "a row without an id but with words in it"), (4, long), (5, long), (6, "one"),
            (7, "\x00\t\n\x0b ünï \U0001f600 mail a@b.c.de 10.0.0.1"), (None, None)]
    return spark.createDataFrame([(i, t, None, None, None, "x", "y", 9) for i, t in rows],
                                 SCHEMA + ", _at string, fp string, _id int")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    from qalam.llm.common import table
    return table(spark, SF, "documents")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


class Sets:
    """Plain union-find, for brute-force components."""

    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def root(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
