"""JSON-LD and RDF/XML sources, set operations of geometry, modules, HTTP answers and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from tessera import cli, server
from tessera import schema as S
from tessera.engine import Engine
from tessera.functions import geo, sinks, terms
from tessera.functions.overlay import OPERATIONS, overlay
from tessera.operators import modules
from tessera.sources import linked
from tessera.sources.rdf import InvalidRdf

JSONLD = """{"@context": {"@vocab": "http://ex.org/", "ex": "http://ex.org/", "name": {"@language": "en"}, "made": {"@type": "xsd:date"}, "xsd": "http://www.w3.org/2001/XMLSchema#",
  "knows": {"@type": "@id"}, "items": {"@container": "@list"}, "label": {"@container": "@language"}, "isPartOf": {"@reverse": "ex:part"}, "id": "@id", "hidden": null},
 "@graph": [{"id": "ex:a", "@type": "Place", "name": "A",
   "size": [4, 1.5, true, null], "made": "2020-01-01", "knows": ["ex:b", "_:x"],
   "items": ["p", "q"], "label": {"de": "Haus"}, "isPartOf": {"id": "ex:whole"}, "hidden": "no", "at": {"ex:wkt": "w"}}]}"""

RDFXML = """<?xml version="1.0"?>
<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:ex="http://ex.org/" xml:base="http://ex.org/doc">
  <ex:Place rdf:about="#a" ex:code="7">
    <ex:name xml:lang="en">A &amp; B</ex:name>
    <ex:size rdf:datatype="http://www.w3.org/2001/XMLSchema#integer">4</ex:size>
    <ex:knows rdf:resource="http://ex.org/b"/>
    <ex:at rdf:parseType="Resource"><ex:wkt>w</ex:wkt></ex:at>
    <ex:part><rdf:Description rdf:nodeID="n"/></ex:part>
    <ex:items rdf:parseType="Collection"><rdf:Description rdf:about="#p"/></ex:items>
  </ex:Place>
</rdf:RDF>"""
EX = "http://ex.org/"


def test_jsonld():
    rows = linked.parse_jsonld(JSONLD)
    got = {(r[2], r[3], *r[4:]) for r in rows}
    lit = lambda p, v, t=None, tag=None: (EX + "a", EX + p, "literal", v, t, tag)
    assert {lit("name", "A", None, "en"), lit("size", "4", S.XSD + "integer"), lit("size", "1.5", S.XSD + "double"), lit("size", "true", S.XSD + "boolean"), lit("made", "2020-01-01", S.XSD + "date"), lit("label", "Haus", None, "de")} <= got
    assert {(EX + "a", S.RDF_TYPE, "iri", EX + "Place", None, None), (EX + "a", EX + "knows", "iri", EX + "b", None, None), (EX + "a", EX + "knows", "bnode", "_:x", None, None), (EX + "whole", EX + "part", "iri", EX + "a", None, None)} <= got
    assert [r[5] for r in rows if r[3] == S.RDF + "first"] == ["q", "p"] and not any("hidden" in r[3] for r in rows)
    assert next(r[0] for r in rows if r[3] == EX + "size") == 4
    assert linked.parse_jsonld("") == [] == linked.parse_jsonld("{}")
    assert linked.parse_jsonld('{"@context": "urn:c", "n": "v", "@id": "urn:x"}', "", {"urn:c": {"@context": {"n": "urn:n"}}})[0][2:6] == ("urn:x", "urn:n", "literal", "v")
    for bad in ('{"@context": "urn:far"}', '{"a": }', '{"a": 1} x', "3", '{"a": "\n'):
        with pytest.raises(InvalidRdf):
            linked.parse_jsonld(bad)


def test_rdfxml():
    rows = linked.parse_rdfxml(RDFXML)
    me = EX + "doc#a"
    got = {tuple(r[2:]) for r in rows}
    assert {(me, S.RDF_TYPE, "iri", EX + "Place", None, None), (me, EX + "code", "literal", "7", None, None), (me, EX + "name", "literal", "A & B", None, "en"), (me, EX + "size", "literal", "4", S.XSD + "integer", None), (me, EX + "knows", "iri", EX + "b", None, None), (me, EX + "part", "bnode", "_:nn", None, None)} <= got
    assert next(r for r in rows if r[3] == EX + "wkt")[1] == "bnode" and next(r[5] for r in rows if r[3] == S.RDF + "first") == EX + "doc#p"
    assert next(r[0] for r in rows if r[3] == EX + "name") == 4
    with pytest.raises(InvalidRdf):
        linked.parse_rdfxml("<a>")


def test_any_kind():
    for text, kind in ((JSONLD, None), (RDFXML, None), ("<urn:a> <urn:b> 3 .", None), (RDFXML, "application/rdf+xml; charset=utf-8"), (JSONLD, "jsonld")):
        assert linked.parse_any(text, kind)
    with pytest.raises(InvalidRdf, match="turtle.*"):
        linked.parse_any("no rdf at all")


PLANE = [("POINT(1 1)", "POINT(2 2)"), ("LINESTRING(-1 1, 3 1)", "POLYGON((0 0, 2 0, 2 2, 0 2, 0 0))"), ("POLYGON((0 0, 4 0, 4 4, 0 4, 0 0))", "POLYGON((1 1, 2 1, 2 2, 1 2, 1 1))"), ("POLYGON((0 0, 2 0, 2 2, 0 2, 0 0))", "POLYGON((1 1, 3 1, 3 3, 1 3, 1 1))"), ("POLYGON((0 0, 2 0, 2 2, 0 2, 0 0))", "POLYGON((2 2, 4 2, 4 4, 2 4, 2 2))"), ("POLYGON((0 0, 2 0, 2 2, 0 2, 0 0))", "POLYGON((0 0, 2 0, 2 2, 0 2, 0 0))"), ("LINESTRING(0 0, 2 2)", "LINESTRING(1 1, 3 3)"), ("POLYGON EMPTY", "POINT(1 1)")]


@pytest.mark.parametrize(("a", "b"), PLANE)
@pytest.mark.parametrize("name", list(OPERATIONS))
def test_set_operations_hold_at_points(a, b, name):
    x, y = geo.parse_wkt(a), geo.parse_wkt(b)
    got = geo.parts(overlay(name, x, y))
    dim = max(geo.dimension(x), geo.dimension(y))
    for i in range(-5, 20):
        for j in range(-5, 20):
            p = (i / 4 + 0.11, j / 4 + 0.07) if dim == 2 else (i / 4, j / 4)
            if name in ("difference", "symDifference") and dim < 2 and (geo.where(p, geo.parts(x)) == 0 or geo.where(p, geo.parts(y)) == 0):
                continue  # results are closed
            assert (geo.where(p, got) >= 0) == OPERATIONS[name](geo.where(p, geo.parts(x)) >= 0, geo.where(p, geo.parts(y)) >= 0), p


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("mixed")
    (folder / "a.jsonld").write_text(JSONLD)
    (folder / "b.rdf").write_text(RDFXML)
    (folder / "c.ttl").write_text('<http://ex.org/t> a <http://ex.org/Task> ; <http://ex.org/at> "POINT(1 2)"^^<http://www.opengis.net/ont/geosparql#wktLiteral> ; <http://ex.org/n> 1, 2 ; <http://ex.org/in> [ <http://ex.org/q> "x\\"y" ] .')
    (folder / "d.ttl").write_text("")
    path = str(folder / "table")
    said = cli.run(spark, [path, "build", str(folder), "--tag", "v1"])
    assert "added" in said
    return path


def test_command_line(spark, table, tmp_path):
    assert "http://ex.org/Place" in cli.run(spark, [table, "get", "classes"])
    assert cli.run(spark, [table, "query", "SELECT ?s WHERE { ?s a <http://ex.org/Task> }", "--csv"]) == "s\nhttp://ex.org/t\n"
    assert "POINT (1 2)" in cli.run(spark, [table, "query", "--sql", "SELECT st_astext(object_geometry) AS g FROM triples WHERE object_geometry IS NOT NULL"])
    assert "triples" in cli.run(spark, [table, "stats"]) and "added" in cli.run(spark, [table, "diff", "latest"])
    assert cli.run(spark, [table, "export", str(tmp_path / "nt")])
    for bad in (["get", "nothing"], ["wipe"], ["diff", "x"]):
        with pytest.raises(S.TesseraError):
            cli.run(spark, [table, *bad])


def test_http(spark, table, tmp_path):
    e = Engine(spark, table)
    ask = lambda method, target, headers=None, body=b"", **k: server.answer(e, method, target, headers, body, **k)
    q = "SELECT ?s WHERE { ?s a <http://ex.org/Task> }"
    status, kind, out = ask("POST", "/sparql", {"content-type": "application/sparql-query"}, q.encode())
    assert (status, kind) == (200, server.RESULTS) and json.loads(out)["results"]["bindings"] == [{"s": {"type": "uri", "value": "http://ex.org/t"}}]
    assert ask("GET", "/sparql?query=SELECT%20%3Fs%20WHERE%20%7B%3Fs%20%3Fp%203%7D", {"accept": "application/*"})[0] == 200
    for want, method, target, headers in ((406, "GET", "/sparql?query=x", {"accept": "text/html"}), (415, "POST", "/sparql", {"content-type": "text/plain"}), (405, "PUT", "/sparql", {}), (400, "GET", "/sparql", {}), (400, "GET", "/sparql?query=ASK%20%7B%7D", {}), (404, "GET", "/none", {}), (400, "GET", "/blobs/XY", {}), (404, "GET", "/blobs/" + "a" * 64, {}), (400, "GET", "/geometries?limit=x", {}), (400, "GET", "/geometries?bbox=1,2", {})):
        assert ask(method, target, headers)[0] == want
    (tmp_path / ("b" * 64)).write_bytes(b"blob")
    assert ask("GET", "/blobs/urn:sha256:" + "b" * 64, blobs=str(tmp_path))[2] == b"blob"
    assert json.loads(ask("POST", "/api/sql", {}, b'{"query": "SELECT 1 AS x"}')[2]) == {"columns": ["x"], "rows": [["1"]], "message": ""}
    assert ask("POST", "/api/sql", {}, b'{"query": "SELEKT"}')[0] == 400 and ask("POST", "/api/sql", {}, b"[]")[0] == 400
    assert json.loads(ask("GET", "/api/stats")[2])["counts"]["triples"] > 20
    assert len(json.loads(ask("GET", "/geometries?limit=5")[2])["features"]) == 1 and json.loads(ask("GET", "/geometries/extent")[2])["bbox"] == [1.0, 2.0, 1.0, 2.0]


def test_modules(spark, table):
    t = Engine(spark, table).triples
    rows = modules.instances(t, [EX + "Task"], EX).collect()
    node = json.loads(rows[0]["instance"])
    assert len(rows) == 1 and node["@id"] == EX + "t" and node["@type"] == [EX + "Task"] and node["n"] == ["1.0", "2.0"] and node["in"] == [{"q": ['x"y']}]
    frame = modules.instances(t, [EX + "Task"], EX)
    made = modules.materialise(frame, lambda n: iter([{"@id": n["@id"] + "/out", "sum": sum(map(float, n["n"])), "of": {"k": 1}}]), {"@vocab": EX})
    got = terms.split_terms(modules.merged(made, made)).filter(F.col("predicate") == EX + "sum").collect()
    assert [(r["subject"], r["object_float"]) for r in got] == [(EX + "t/out", 3.0)]
    with pytest.raises(modules.TaskFailed, match="broken"):
        modules.nodes_terms([{"@type": "ReadError", "rdfs:comment": "broken"}], {})
    assert modules.tasks(t, [EX + "Task"]).collect()[0]["classes"] == [EX + "Task"]


def test_printed_results_are_whole(spark):
    df = spark.range(1500).selectExpr("id", "cast(null as string) as empty")
    assert len(sinks.format_table(df).split("\n")) == 1501
    assert len(sinks.to_csv(df).splitlines()) == 1501 and sinks.to_csv(df).endswith("\n")
