"""Spatial joins of many rows in small files, levels of cells, and points at once against points one by one."""

import itertools
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import geo
from tessera.plans import catalogue

ROWS = 40_000  # of each side; a few hundred KB of parquet


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("many"))
    keys = spark.range(ROWS).coalesce(1)
    keys.select(F.col("id").alias("s_suppkey"), F.lit("s").alias("s_name"), F.lit(1).alias("s_nationkey"), F.lit(1.0).alias("s_acctbal")).filter("s_suppkey % 50 = 0 or s_suppkey < 20000").write.parquet(f"{folder}/supplier.parquet")
    keys.select(F.col("id").alias("c_custkey"), F.lit("c").alias("c_name"), F.lit(1).alias("c_nationkey"), F.lit(1.0).alias("c_acctbal"), F.lit("m").alias("c_mktsegment")).write.parquet(f"{folder}/customer.parquet")
    return folder


@pytest.mark.parametrize("name", ["geo_join", "geo_filter_join", "geo_filter_distance_join"])
def test_many_rows_of_small_files_do_not_pass_the_driver(spark, many, name):
    df = catalogue.queries()[name](spark, many)
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    # a point comes again with every 3,600 keys
    have = [0] * 3600
    for k in range(ROWS):
        have[k % 3600] += 1
    assert df.count() == sum(have[k % 3600] for k in range(ROWS) if k % 50 == 0 or k < 20_000)


def test_points_that_meet_points_are_one_row_each(spark):
    p = spark.range(3000).select(F.col("id").alias("a"), geo.st_point(F.col("id") % 60, F.col("id") / 60).alias("x"))
    pairs = geo.spatial_join(p, p.toDF("b", "y"), "x", "y", "sfEquals")
    assert pairs.count() == 3000
    levels = re.findall(r"explode\(sequence\(greatest\(_[lr]_own#\d+, (\d+)\), greatest\(_[lr]_own#\d+, (\d+)\)", pairs._jdf.queryExecution().executedPlan().toString())
    assert levels and set(levels) == {("0", "0")}


def test_points_at_once_are_as_points_one_by_one(spark):
    texts = ["POINT(1 1)", "POINT(1 1)", "POINT(1.0000000000001 1)", "POINT(1 2)", "POINT(-0.0 0)", "POINT(0 0)", "POINT(3.1 -4.7)", "MULTIPOINT((1 1))", "LINESTRING(0 0, 2 2)", "POLYGON((0 0, 3 0, 3 3, 0 3, 0 0))"]
    wkb = [*(geo.to_wkb(geo.parse_wkt(t)) for t in texts), bytes.fromhex("00000000013FF00000000000003FF0000000000000"), None]
    rows = [(x, y) for x, y in itertools.product(wkb, wkb)]
    df = spark.createDataFrame(rows, "x binary, y binary").coalesce(1)
    got = df.select("x", "y", *[geo.relation(n, F.col("x"), F.col("y")).alias(n) for n in geo.RELATIONS], geo.planar_distance(F.col("x"), F.col("y")).alias("d"), geo.bounds(F.col("x")).alias("b")).collect()
    assert len(got) == len(rows)
    for r in got:
        x, y = (geo.from_wkb(bytes(v)) if v is not None else None for v in (r["x"], r["y"]))
        assert tuple(r["b"] or ()) in ((None,) * 4, ()) if x is None else tuple(r["b"]) == geo.box(x)
        for n, fn in geo.RELATIONS.items():
            assert r[n] == (fn(x, y) if x and y else None), (n, x, y)
        assert r["d"] == (geo.distance(x, y) if x and y else None)
