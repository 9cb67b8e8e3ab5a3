"""The sample that the classifier of op10 is fitted on stays within its bounds, whatever one id brings; the registered settings near their targets."""

import random

from murmur.llm import mixing
from murmur.llm.common import table

from .conftest import prose


def tables(spark, ids, copies):
    hot = [(0, prose(k % 7, 40)) for k in range(copies)]
    docs = spark.createDataFrame([(i, prose(i, 40)) for i in range(ids)] + hot + [(None, "x"), (3, None), (3, "")], "doc_id long, text string")
    rows = [(i, i % 2, 0) for i in range(ids)] + [(1, 0, 0), (1, 1, 1), (None, 1, 0), (2, None, 0)] * 3
    return docs, spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_one_row_of_an_id(spark):
    docs, labels = tables(spark, 50, 3000)
    got = mixing.labelled(docs, labels, 20_000, 1 << 28).collect()
    assert len(got) == 50
    assert sum(x["domain"] == "q0t0" for x in got) == 26  # the 25 even ids, and id 1: the first of its domains in order
    again = mixing.labelled(docs.repartition(7), labels.repartition(3), 20_000, 1 << 28).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_bounds_of_rows_and_bytes(spark):
    docs, labels = tables(spark, 400, 10)
    got = mixing.labelled(docs, labels, 100, 1 << 28).count()
    assert 50 <= got <= 150
    few = mixing.labelled(docs, labels, 20_000, 5_000).collect()
    assert few and 3_000 < sum(len(x["text"] or "") for x in few) <= 5_000
    assert mixing.labelled(docs, labels, 20_000, 0).where("text != ''").isEmpty()


def test_registered_settings_near_their_targets(spark):
    sf = "/root/testdata/sf0.001"
    rows, report = mixing.mix(table(spark, sf, "documents"), table(spark, sf, "labels"))
    whole = sum(goal for _, _, goal, _ in report)
    for domain, before, goal, after in report:
        assert abs(after - goal) <= 0.01 * whole, (domain, before, goal, after)
    assert rows.where("rate < 0 OR rate IS NULL").isEmpty()


def test_fits_with_one_domain_or_none(spark):
    docs = spark.createDataFrame([(i, prose(random.Random(i).random(), 5)) for i in range(20)], "doc_id long, text string")
    for labels in ([], [(1, 1, 0)]):
        rows, _ = mixing.mix(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), targets={"q1t0": 1.0})
        assert rows.count() == 20
