"""The verdict uses both counts and stands beside each span."""

from murmur.llm import secrets

from .conftest import SCHEMA


def test_verdicts_use_repositories_and_owners(spark):
    copied, own, spread = ("AKIA" + c * 16 for c in "ABC")
    texts = [(copied, "a")] * 4 + [(f"{copied} {own}", "a"), *((spread, s) for s in "abc")]
    docs = spark.createDataFrame([(i, t, "en", s, 0) for i, (t, s) in enumerate(texts)], SCHEMA)
    got = {x["doc_id"]: x for x in secrets.secrets(docs, example_repos=5).collect()}
    assert [tuple(c) for c in got[4]["candidates"]] == [(0, 20, "access", 5, 1, "example"), (21, 41, "access", 1, 1, "live")]
    assert [tuple(c) for c in got[5]["candidates"]] == [(0, 20, "access", 3, 3, "example")]
    assert (got[4]["n_live"], got[4]["n_example"]) == (1, 1) and got[0]["n_example"] == 1
