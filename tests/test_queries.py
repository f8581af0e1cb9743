"""Every catalog query against its SQL on the smallest scale."""

import pytest
from duck import connect, same

import __spark_entry__
from cairnlake.plans.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    same(QUERIES[name](spark, FOLDER), duck, ORACLES[name])


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    found = __spark_entry__.queries()
    assert set(QUERIES) <= set(found) and set(__spark_entry__.oracle_sql()) <= set(found)


def test_content_hash(spark):
    import hashlib

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    for r in QUERIES["blake2b_content"](spark, FOLDER).collect():
        assert r["hash"] == hashlib.blake2b(docs[r["doc_id"]].encode(), digest_size=32).hexdigest()


def test_base64_of_whole_contents(spark):
    import base64

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert max(len(t.encode()) for t in docs.values()) >= 2000
    found = {r["doc_id"]: r["body"] for r in QUERIES["base64_content"](spark, FOLDER).collect()}
    assert found == {d: base64.b64encode(t.encode()).decode() for d, t in docs.items()}
