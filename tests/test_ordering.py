"""Deep pages against a sorted list."""

import random

import pytest

from stockroom.operators import ordering


@pytest.mark.parametrize("heap", [20, 50, 10_000])
def test_pages_equal_a_sorted_list(spark, heap):
    r = random.Random(heap)
    rows = [(r.choice([None, *range(40)]), r.random() if r.random() < 0.9 else None, i) for i in range(3000)]
    rows += [(7, 0.5, i) for i in range(3000, 3200)]
    df = spark.createDataFrame(rows, "a int, b double, id int").repartition(6)
    key = lambda x: tuple((v is not None, v or 0) for v in x)
    want = sorted(rows, key=key)
    for page, size in ((1, 10), (37, 10), (160, 20), (161, 20), (3200, 1), (9, 400), (10**6, 20)):
        got = ordering.page(df, page, size, ["a", "b", "id"], heap=heap, ranges=16).collect()
        assert [tuple(x)[:3] for x in got] == want[(page - 1) * size:page * size]
        assert all(x["page"] == page and x["total_pages"] == -(-3200 // size) for x in got)


def test_a_deep_page_keeps_no_heap_of_all_rows(spark):
    df = spark.range(200_000).withColumnRenamed("id", "k")
    got = ordering.page(df, 9000, 20, ["k"], heap=2000)
    assert [x["k"] for x in got.collect()] == list(range(179_980, 180_000))
    plan = got._jdf.queryExecution().executedPlan().toString()
    limit = int(plan.split("TakeOrderedAndProject(limit=")[1].split(",")[0])
    assert limit <= 2000


def test_ties_beyond_a_heap(spark):
    df = spark.createDataFrame([(1, "x")] * 500, "k int, t string")
    assert len(ordering.page(df, 4, 100, ["k"], heap=10).collect()) == 100
    assert ordering.page(df.limit(0), 4, 100, ["k"], heap=10).collect() == []


def test_a_page_behind_many_ties_is_cut_by_few_comparisons(spark):
    df = spark.range(30_000).selectExpr("greatest(id, 20000L) AS k", "1 AS one")
    got = ordering.page(df, 2003, 10, ["k", "one"], heap=500)
    assert [x["k"] for x in got.collect()] == list(range(20_020, 20_030))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert int(plan.split("TakeOrderedAndProject(limit=")[1].split(",")[0]) <= 500
    assert "filter(" not in got._jdf.queryExecution().optimizedPlan().toString()  # no walk over a list of cuts in each row
