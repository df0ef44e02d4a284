import os
import sys

import pytest

from assayer.session import local_session

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def documents(spark):
    """The smallest given table and hand-made cases: null, empty, white space, copies, ties, one long text."""
    given = spark.read.parquet(f"{SF}/documents.parquet")
    passage = " ".join(f"word{i}" for i in range(60))
    rows = [
        (900001, None, "en", None), (900002, "", "en", "src1"), (900003, "   \n\t ", "en", None),
        (900004, "Same Text here, you see", "en", "src1"), (900005, "same text HERE, you see", "en", "src2"),
        (900006, "same text HERE, you see", None, "src2"), (900007, "É à ÀB <|endoftext|>  x's\n\n'S   　y \U0001f600", "fr", "srcX"),
        (900008, "a " * 40_000 + passage, "en", "src1"), (900009, passage + " and an end of its own", "en", "src1"),
        (900010, "mail a.b+c@x-y.example.com or c@d, 1.2.3.4.5.6.7.8 and 1.2.3.999 call +1 (068) 555-2748, card 4111 1111-1111 1111", "en", "srcX"),
        (900011, "4111111111111111 41111111111111112345678 " * 3 + "ünï 255.255.255.255 x@@y.z a@b.c@d.e", "en", "srcX"),
    ]
    made = spark.createDataFrame([(i, t, l, s, len(t or "")) for i, t, l, s in rows], DOCS)
    return given.unionByName(made).cache()


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
