import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
SMALL = "/root/testdata/sf0.001"
#: Names that the operators use themselves, as columns of their input.
EXTRA = ["row", "stats", "votes", "node", "n", "copies", "starts", "rank", "p", "token", "bar", "again", "gone"]


@pytest.fixture(scope="session")
def documents(spark):
    """(id, text) rows → a table of documents with further columns of clashing names."""
    def make(rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in EXTRA)
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), *[7] * len(EXTRA)) for i, t in rows], schema)

    return make


@pytest.fixture(scope="session")
def edge_rows():
    prose = " ".join(f"w{i % 97}x{i}" for i in range(300))
    return [(1, None), (2, ""), (3, " \t\n"), (4, prose), (5, prose), (6, prose + " more"), (7, "one two"), (8, "ONE two"),
            (9, "word " * 4000), (10, " ".join(f"l{i}" for i in range(30_000))), (11, prose.replace("w5x5 ", "w5x5 other ")),
            (12, "Ünïcode  \u00a0words\u2003here … 🙂 ok")]
