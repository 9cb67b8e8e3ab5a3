"""The ratios are neither written out in the plan, which Spark keeps and logs for each query, nor a column of the rows."""

from murmur.llm import quality

from .conftest import prose


def test_plan_is_short(spark):
    docs = spark.createDataFrame([(i, prose(i, 60 + i)) for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 20, 2)], "doc_id long, quality int, toxic int")
    out = quality.quality(docs, labels)
    plan = out._jdf.queryExecution()
    assert len(plan.toString()) < 1_000_000
    assert "_at#" not in plan.optimizedPlan().toString()
    kept = out.where("kept").select("doc_id")._jdf.queryExecution().optimizedPlan().toString()
    assert kept.count("split(trim(") == 1  # the filter that is pushed down holds the expression once
    assert out.count() == 20
