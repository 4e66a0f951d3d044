"""Core engine: registered queries against their SQL, errors, terms, geometry, store, sources and sinks."""

import json
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera import schema as S
from tessera.engine import Engine
from tessera.functions import geo, sinks, terms
from tessera.operators import lookups, validate
from tessera.operators.store import Store, lineage
from tessera.plans import catalogue, sparql
from tessera.sources import rdf
from tessera.streaming import ingest

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def cell(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, sf, duck, name):
    df = catalogue.queries()[name](spark, sf)
    cur = duck.execute(catalogue.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(tuple(map(cell, r)) for r in cur.fetchall())
    assert sorted(tuple(cell(r[c]) for c in cols) for r in df.collect()) == want


TTL = """@prefix ex: <http://ex.org/> . @prefix geo: <http://www.opengis.net/ont/geosparql#> .
ex:a a ex:Place ; ex:name "A \\"q\\"\\n"@en, "plain" ; ex:size 42, "42.5", "5d", " 5 ", "1e400", "NaN" ;
  ex:at [ geo:asWKT "<http://www.opengis.net/def/crs/OGC/1.3/CRS84> POINT(1 2)"^^geo:wktLiteral ] ; ex:list (1 2) .
_:x ex:knows ex:a . # comment
"""


@pytest.fixture(scope="module")
def triples(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("rdf")
    (folder / "a.ttl").write_text(TTL)
    return terms.split_terms(rdf.read_turtle(spark, str(folder))).cache()


def test_turtle_to_typed_columns(triples):
    rows = triples.collect()
    by = {}
    for r in rows:
        by.setdefault(r["predicate"].rsplit("/", 1)[-1].rsplit("#", 1)[-1], []).append(r)
    assert {r["object_string"] for r in by["name"]} == {'A "q"\n', "plain"}
    assert sorted(r["object_float"] for r in by["size"] if r["object_float"] is not None and not math.isnan(r["object_float"])) == [42.0, 42.5]
    assert {r["object_string"] for r in by["size"]} == {None, "5d", " 5 ", "1e400"}
    assert geo.from_wkb(bytes(by["asWKT"][0]["object_geometry"])) == ("POINT", (1.0, 2.0))
    assert by["at"][0]["object_string"].startswith("_:") and len(by["first"]) == 2
    assert all(sum(r[c] is not None for c in S.COLUMNS[2:6]) == 1 for r in rows)


def test_ntriples_round_trip(spark, triples, tmp_path):
    sinks.write_ntriples(triples, str(tmp_path / "nt"))
    back = terms.split_terms(rdf.read_ntriples(spark, str(tmp_path / "nt")))
    show = lambda df: sorted(map(str, df.select("subject", "predicate", "object_iri", F.when(~F.isnan("object_float"), F.col("object_float")), "object_string", geo.st_astext(F.col("object_geometry"))).collect()))
    assert show(back) == show(triples)


def test_render_double_equals_repr(spark):
    values = [0.0, -0.0, 1.0, 12345678.5, 1e7, 1e15, 123456789012345.0, 1e16, 1e20, 1.5e300, 0.001, 0.0001, 0.00012345, 1e-5, 2.5e-7, 1e-300, -42.25, math.inf, -math.inf, math.nan, 9999999.0, 0.1]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    assert [r[0] for r in df.select(terms.render_double(F.col("v"))).collect()] == [repr(v) for v in values]


def test_numeric_gate(spark):
    cases = {"1": 1.0, "-.5": -0.5, "1E7": 1e7, " 5": None, "5d": None, "1e400": None, "inf": math.inf, "-Infinity": -math.inf, "1_0": None, "": None, "+3.": 3.0}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r[0]: r[1] for r in df.select("t", terms.numeric(F.col("t"))).collect()} == cases == {k: terms.gate(k) for k in cases}


@pytest.mark.parametrize(
    ("text", "error", "phrase"),
    [
        ("SELECT", S.InvalidSparql, "nothing to project"), ("ASK { ?s ?p ?o }", S.UnsupportedSparql, "only SELECT"), ("SELECT ?s WHERE { ?s ?p ?o } ORDER BY ?s", S.UnsupportedSparql, "ORDER BY"), ("SELECT ?s WHERE { ?s ?p ?o } OFFSET 3", S.UnsupportedSparql, "OFFSET"),
        ("SELECT (1 AS ?x) WHERE { ?s ?p ?o }", S.UnsupportedSparql, "projection"), ("SELECT ?s WHERE { }", S.UnsupportedSparql, "triple pattern"), ("SELECT ?z WHERE { ?s ?p ?o }", S.UnsupportedSparql, "not bound"), ("SELECT ?s WHERE { ?s <urn:a>/<urn:b> ?o }", S.UnsupportedSparql, "property paths"),
        ("SELECT ?s WHERE { ?s ?p ?o OPTIONAL { ?s ?p ?o } }", S.UnsupportedSparql, "OPTIONAL"), ("SELECT ?s WHERE { { ?s ?p ?o } UNION { ?s ?p ?o } }", S.UnsupportedSparql, "UNION"), ("SELECT ?s WHERE { ?s x:y ?o }", S.InvalidSparql, "unknown prefix"), ("SELECT ?s WHERE { _:b ?p ?s }", S.InvalidSparql, "unknown prefix"),
        ("SELECT ?s WHERE { ?s ?p ?o FILTER(?z = 1) }", S.UnsupportedSparql, "not bound"), ("SELECT ?s WHERE { ?s ?p ?o FILTER(regex(?o, \"a\")) }", S.UnsupportedSparql, 'function "regex"'), ("SELECT ?s WHERE { ?s ?p ?o FILTER(?s > 3) }", S.UnsupportedSparql, "number"), ("SELECT ?s WHERE { ?s ?p ?o FILTER(?o) }", S.UnsupportedSparql, "shape"),
        (f"SELECT ?s WHERE {{ ?s ?p ?o FILTER(<{S.GEOF}sfWithin>(?s, ?o)) }}", S.UnsupportedSparql, "object"), (f"SELECT ?s WHERE {{ ?s ?p ?o FILTER(<{S.GEOF}distance>(?o) < 1) }}", S.UnsupportedSparql, "distance"), (f"SELECT ?s WHERE {{ ?s ?p ?o FILTER(<{S.GEOF}buffer>(?o)) }}", S.UnsupportedSparql, "not supported"),
    ],
)
def test_rejections(triples, text, error, phrase):
    with pytest.raises(error, match="(?i)" + phrase.replace("(", r"\(")):
        sparql.run(text, triples)


def test_predicate_filter_prunes_partitions(spark, triples, tmp_path):
    store = Store(spark, str(tmp_path / "t"))
    store.write(triples, {"modules": "[]"}, "v1")
    plan = sparql.run("SELECT ?s WHERE { ?s <http://ex.org/name> ?n }", store.as_of())._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(predicate_part" in plan


def test_snapshots(spark, triples, tmp_path):
    store = Store(spark, str(tmp_path / "t"))
    with pytest.raises(S.NothingBuilt):
        store.as_of()
    ids = lambda df: {r["triple_hash"] for r in df.collect()}
    half = triples.filter("predicate like '%size%'")
    one = store.write(triples, None, "v1")
    assert store.write(triples)["snapshot_id"] == one["snapshot_id"] and len(store.log()) == 1
    two = store.write(half)
    three = store.write(triples, None, "v3")
    assert ids(store.as_of()) == ids(triples) == ids(store.as_of(one["snapshot_id"])) and ids(store.as_of(two["snapshot_id"])) == ids(half)
    assert {r["change_type"] for r in store.diff(two["snapshot_id"]).collect()} == {"removed"} and store.diff(one["snapshot_id"]).count() == triples.count()
    assert [r["tags"] for r in store.snapshots().collect()] == ["main, v3", "", "v1"]
    with pytest.raises(S.TesseraError):
        store.diff("0")
    with pytest.raises(S.TesseraError):
        store.delete_snapshots([one["snapshot_id"], two["snapshot_id"], three["snapshot_id"]])
    store.delete_snapshots([three["snapshot_id"]])
    assert ids(store.as_of()) == ids(half)
    assert lineage([1, 2], [1]) == "ahead" and lineage([1], [1, 2]) == "behind" and lineage([1, 3], [1, 2]) == "diverged"


def test_squash(spark, triples, tmp_path):
    store = Store(spark, str(tmp_path / "t"))
    one = store.write(triples.limit(3))
    two, three = store.write(triples.limit(5)), store.write(triples)
    done = store.squash([two["snapshot_id"], three["snapshot_id"]], "s")
    assert done["parent"] == one["snapshot_id"] and store.as_of().count() == triples.count()


def test_engine_and_sinks(spark, triples, tmp_path):
    e = Engine(spark, triples=triples)
    assert e.sql("SELECT count(*) AS n FROM triples").first()["n"] == triples.count()
    doc = json.loads(sinks.sparql_json_document(e.sparql("SELECT ?s ?n WHERE { ?s <http://ex.org/name> ?n }")))
    assert {b["n"]["value"] for b in doc["results"]["bindings"]} == {'A "q"\n', "plain"}
    assert json.loads(sinks.feature_collection(e.geometries("0,0,3,3")))["features"][0]["geometry"] == {"type": "Point", "coordinates": [1.0, 2.0]}
    assert json.loads(sinks.extent_feature(e.extent()))["bbox"] == [1.0, 2.0, 1.0, 2.0]
    assert json.loads(sinks.extent_feature(lookups.extent(triples.limit(0))))["geometry"] is None
    assert sinks.format_table(e.classes()).splitlines()[0].startswith("class")
    assert sinks.to_csv(e.classes()) == "class,instances\nhttp://ex.org/Place,1\n"
    assert sinks.drop_empty_columns(spark.createDataFrame([("a", "", None)], "x string, y string, z string")).columns == ["x"]
    assert e.register_imports([("a", str(tmp_path / "none"))]) == [] and e.warnings
    assert lookups.view_names([("t", "x"), ("t", "y"), ("triples", "z")]) == ["t_x", "t_y", "triples_2"]
    with pytest.raises(S.OldTableLayout):
        Engine(spark, triples=triples.drop("object_geometry"))
    assert lookups.column_stats(triples).filter("column = 'subject'").first()["nulls"] == 0


def test_blank_node_names_do_not_depend_on_labels(spark):
    def rows(a, b):
        return [("iri", "urn:s", "urn:p", "bnode", a, None, None), ("bnode", a, "urn:q", "bnode", b, None, None), ("bnode", b, "urn:r", "literal", "x", None, None)]

    named = [sorted(map(tuple, validate.stable_blank_nodes(spark.createDataFrame(r, S.TERMS)).collect()), key=str) for r in (rows("_:1", "_:2"), rows("_:z", "_:b"))]
    assert named[0] == named[1] and validate.BLANK in str(named[0])


def test_closure_of_a_cycle(spark):
    got = {tuple(r) for r in validate.closure(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "child string, parent string")).collect()}
    assert got == {(x, y) for x in "abcd" for y in "abc"}


RELATED = [
    ("POINT(1 1)", "POLYGON((0 0, 2 0, 2 2, 0 2, 0 0))", {"sfIntersects", "sfWithin"}), ("POINT(0 0)", "POLYGON((0 0, 2 0, 2 2, 0 2, 0 0))", {"sfIntersects", "sfTouches"}), ("LINESTRING(-1 1, 3 1)", "POLYGON((0 0, 2 0, 2 2, 0 2, 0 0))", {"sfIntersects", "sfCrosses"}),
    ("POLYGON((0 0, 2 0, 2 2, 0 2, 0 0))", "POLYGON((1 1, 3 1, 3 3, 1 3, 1 1))", {"sfIntersects", "sfOverlaps"}), ("POLYGON((0 0, 2 0, 2 2, 0 2, 0 0))", "POLYGON((2 0, 4 0, 4 2, 2 2, 2 0))", {"sfIntersects", "sfTouches"}), ("POLYGON((0 0, 2 0, 2 2, 0 2, 0 0))", "POLYGON((2 2, 0 2, 0 0, 2 0, 2 2))", {"sfEquals", "sfIntersects", "sfWithin", "sfContains"}),
    ("POLYGON((0 0, 4 0, 4 4, 0 4, 0 0))", "POLYGON((1 1, 2 1, 2 2, 1 2, 1 1))", {"sfIntersects", "sfContains"}), ("POINT(5 5)", "LINESTRING(0 0, 1 1)", {"sfDisjoint"}), ("LINESTRING(0 0, 2 2)", "LINESTRING(0 2, 2 0)", {"sfIntersects", "sfCrosses"}), ("POINT(1.5 1.5)", "POLYGON((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))", {"sfDisjoint"}),
]


@pytest.mark.parametrize(("a", "b", "true"), RELATED)
def test_relations(a, b, true):
    x, y = geo.parse_wkt(a), geo.parse_wkt(b)
    assert {n for n, f in geo.RELATIONS.items() if f(x, y)} == true


def test_wkt_and_wkb_round_trip():
    for w in ("POINT (1 2.5)", "LINESTRING (0 0, 1 1)", "POLYGON ((0 0, 1 0, 1 1, 0 0))", "MULTIPOINT ((0 0), (1 1))", "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)))", "GEOMETRYCOLLECTION (POINT (1 2), LINESTRING (0 0, 1 1))", "POINT EMPTY"):
        assert geo.to_wkt(geo.from_wkb(geo.to_wkb(geo.parse_wkt(w)))) == w
    for bad in ("POINT(1)", "POLYGON", "CIRCLE(0 0)", "POINT(1 2) x"):
        with pytest.raises(geo.InvalidGeometry):
            geo.parse_wkt(bad)
    assert geo.parse_bbox("1,2,3,4") == (1, 2, 3, 4)
    for bad in ("1,2,3", "a,b,c,d", "3,0,1,1"):
        with pytest.raises(S.TesseraError):
            geo.parse_bbox(bad)


def test_stream_appends_new_triples(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.nt").write_text('<urn:a> <urn:p> "1" .\n<urn:a> <urn:p> "x"@en .\n')
    for _ in range(2):
        ingest.stream_ntriples(spark, str(source), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    assert Store(spark, str(tmp_path / "t")).as_of().count() == 2
    (source / "b.nt").write_text('<urn:a> <urn:p> "1" .\n<urn:b> <urn:p> _:z .\n')
    ingest.stream_ntriples(spark, str(source), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    assert Store(spark, str(tmp_path / "t")).as_of().count() == 3
