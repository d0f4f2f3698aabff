"""The sample that centres are fitted on: spread over tasks, bounded, without a sort of the table."""

import contextlib
import io

from mnemolake.operators import vector_index as vi


def test_sample_is_bounded_and_spread(spark):
    rows = spark.range(40_000).withColumnRenamed("id", "doc_id")
    some = vi._sample(rows, 40_000, 20_000, 7)
    assert 18_500 < some.count() <= 20_000 and some.rdd.getNumPartitions() == 10
    sizes = some.rdd.glom().map(len).collect()
    assert max(sizes) < 3_000
    assert vi._sample(rows, 40_000, 50_000, 7).count() == 40_000
    plan = io.StringIO()
    with contextlib.redirect_stdout(plan):
        some.explain()
    assert "TakeOrdered" not in plan.getvalue() and "Sort" not in plan.getvalue()
