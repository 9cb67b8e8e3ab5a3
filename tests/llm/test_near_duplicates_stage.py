"""The stage keeps one row of each component, also where ids are null or repeated."""

from murmur.llm import simhash

from .conftest import SCHEMA, prose


def test_stage_keeps_one_row_of_each_component(spark):
    a, b, c, d, e = (prose(i, 80) for i in range(5))
    rows = [(3, a), (7, a), (7, b), (None, c), (None, c), (None, d), (None, a), (9, e), (9, e), (9, None), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    got = [(x["doc_id"], x["text"]) for x in simhash.stage(spark, docs, "").collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    assert sorted((x for x in got if x[1]), key=key) == sorted([(3, a), (7, b), (None, c), (None, d), (9, e)], key=key)
    assert [x[0] for x in got if not x[1]] == [9]  # null and empty texts are one component
