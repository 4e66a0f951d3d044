"""Joins of objects: crowded terms are dealt to several tasks, with the rows of a plain join."""

import pytest
from pyspark.sql import functions as F

from tessera.plans import catalogue, sparql


def test_a_crowded_term_of_a_small_file_is_dealt_to_several_tasks(spark, tmp_path):
    nation = lambda c, n: spark.range(n).coalesce(1).select(F.col("id").alias(c), F.lit(7).alias(f"{c[0]}_nationkey"), *[F.lit("x").alias(f"{c[0]}_{k}") for k in ("name", "mktsegment")], F.lit(1.0).alias(f"{c[0]}_acctbal"))
    nation("c_custkey", 10_000).write.parquet(f"{tmp_path}/customer.parquet")
    nation("s_suppkey", 2_000).write.parquet(f"{tmp_path}/supplier.parquet")
    df = catalogue.queries()["join_oo"](spark, str(tmp_path))
    made = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(made) == 20_000_000 and max(made) <= 12_000_000


@pytest.mark.parametrize("turned", [False, True])
def test_dealt_rows_are_those_of_a_plain_join(spark, monkeypatch, turned):
    monkeypatch.setattr(sparql, "TASK_PAIRS", 5)
    a = spark.createDataFrame([(i, None if i % 9 == 0 else f"n{min(i % 5, 3)}", f"m{i % 2}") for i in range(60)] + [(1, "n1", "m1")] * 3, "a int, x string, u string")
    b = spark.createDataFrame([(i, None if i % 7 == 0 else f"n{i % 6}", f"m{i % 2}") for i in range(23)], "b int, y string, v string")
    left, right, keys = (b, a, [("y", "x"), ("v", "u")]) if turned else (a, b, [("x", "y"), ("u", "v")])
    for k in (keys[:1], keys):
        got = sparql.dealt_join(left, right, [(F.col(p), F.col(q)) for p, q in k])
        want = left.join(right, [F.col(p) == F.col(q) for p, q in k])
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect())) != []
    assert sparql.dealt_join(left.limit(0), right, [(F.col(p), F.col(q)) for p, q in keys]).count() == 0
