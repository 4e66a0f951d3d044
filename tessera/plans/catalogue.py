"""Registered queries of the core engine and the DuckDB SQL that checks them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schema as S
from tessera.functions import geo, sinks, terms
from tessera.operators import lookups, modules, validate
from tessera.plans import checks, sparql
from tessera.sources import linked, rdf, tabular
from tessera.sources.tabular import BASE, C, P

PREFIX = f"PREFIX p: <{P}> PREFIX c: <{C}> PREFIX e: <{BASE}> PREFIX rdf: <{S.RDF}> PREFIX rdfs: <{S.RDFS}> PREFIX geof: <{S.GEOF}> PREFIX geo: <{S.GEO}> PREFIX uom: <{S.UOM}> "
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _sparql(name: str, tables: tuple[str, ...], text: str, oracle: str | None, **options) -> None:
    """A SPARQL query over tables as triples; the oracle reads `triples`."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return sparql.run(PREFIX + text, tabular.triples(spark, sf_dir, *tables, **options))

    QUERIES[name] = run
    if oracle:
        ORACLES[name] = f"WITH {tabular.sql(*tables, **options)} {oracle}"


def _frame(name: str, tables: tuple[str, ...], fn: Callable[[DataFrame], DataFrame], oracle: str | None, hashes: bool = False, **options) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(tabular.triples(spark, sf_dir, *tables, hashes=hashes, **options))

    QUERIES[name] = run
    if oracle:
        ORACLES[name] = f"WITH {tabular.sql(*tables, **options)} {oracle}"


def _bgp(select: str, *patterns: str, where: str = "") -> str:
    """SELECT over aliased scans t0, t1, ... with their conditions."""
    last = max(int(i) for i in re.findall(r"\bt([0-9]+)\.", " ".join([select, *patterns, where])))
    scans = " CROSS JOIN ".join(f"triples t{i}" for i in range(last + 1))
    return f"SELECT {select} FROM {scans} WHERE " + " AND ".join([*patterns, *([where] if where else [])])


def _p(i: int, predicate: str) -> str:
    return f"t{i}.predicate = '{predicate if ':' in predicate else P + predicate}'"


# patterns
_sparql("bgp_single", ("nation",), "SELECT ?s ?n WHERE { ?s p:n_name ?n }", _bgp("t0.subject AS s, t0.otext AS n", _p(0, "n_name")))
_sparql("bgp_const_subject", ("nation",), "SELECT ?p ?o WHERE { <https://example.org/nation/3> ?p ?o }", _bgp("t0.predicate AS p, t0.otext AS o", f"t0.subject = '{BASE}nation/3'"))
_sparql("bgp_const_iri_object", ("nation",), "SELECT ?s WHERE { ?s p:n_regionkey <https://example.org/region/1> }", _bgp("t0.subject AS s", _p(0, "n_regionkey"), f"t0.object_iri = '{BASE}region/1'"))
_sparql("bgp_const_literal", ("customer",), 'SELECT ?s WHERE { ?s p:c_mktsegment "BUILDING" }', _bgp("t0.subject AS s", _p(0, "c_mktsegment"), "t0.object_string = 'BUILDING'"))
_sparql("bgp_const_number", ("part",), "SELECT ?s WHERE { ?s p:p_size 15 }", _bgp("t0.subject AS s", _p(0, "p_size"), "t0.object_float = 15"))
_sparql("join_ss", ("nation",), "SELECT ?s ?n ?r WHERE { ?s p:n_name ?n ; p:n_regionkey ?r }", _bgp("t0.subject AS s, t0.otext AS n, t1.otext AS r", _p(0, "n_name"), _p(1, "n_regionkey"), "t0.subject = t1.subject"))
_sparql("join_so", ("nation", "region"), "SELECT ?n ?r WHERE { ?s p:n_regionkey ?x . ?x p:r_name ?r . ?s p:n_name ?n }", _bgp("t2.otext AS n, t1.otext AS r", _p(0, "n_regionkey"), _p(1, "r_name"), _p(2, "n_name"), "t0.otext = t1.subject", "t0.subject = t2.subject"))
_sparql("join_oo", ("customer", "supplier"), "SELECT ?c ?s WHERE { ?c p:c_nationkey ?n . ?s p:s_nationkey ?n }", _bgp("t0.subject AS c, t1.subject AS s", _p(0, "c_nationkey"), _p(1, "s_nationkey"), "t0.otext = t1.otext"))
_sparql("join_chain3", ("orders", "customer", "nation"), "SELECT ?o ?name WHERE { ?o p:o_custkey ?c . ?c p:c_nationkey ?n . ?n p:n_name ?name }", _bgp("t0.subject AS o, t2.otext AS name", _p(0, "o_custkey"), _p(1, "c_nationkey"), _p(2, "n_name"), "t0.otext = t1.subject", "t1.otext = t2.subject"))
_STAR = "SELECT ?c ?name ?nation ?region ?bal WHERE { ?c p:c_name ?name ; p:c_acctbal ?bal ; p:c_nationkey ?n . ?n p:n_name ?nation ; p:n_regionkey ?r . ?r p:r_name ?region FILTER(?bal > 5000) }"
_sparql(
    "join_star4", ("customer", "nation", "region"), _STAR,
    _bgp("t0.subject AS c, t0.otext AS name, t3.otext AS nation, t5.otext AS region, t1.otext AS bal", _p(0, "c_name"), _p(1, "c_acctbal"), _p(2, "c_nationkey"), _p(3, "n_name"), _p(4, "n_regionkey"), _p(5, "r_name"), "t0.subject = t1.subject", "t0.subject = t2.subject", "t2.otext = t3.subject", "t3.subject = t4.subject", "t4.otext = t5.subject", "t1.object_float > 5000"),
)
_sparql("cartesian_small", ("region",), "SELECT ?a ?b WHERE { ?x p:r_name ?a . ?y p:r_name ?b }", _bgp("t0.otext AS a, t1.otext AS b", _p(0, "r_name"), _p(1, "r_name")))
_sparql("self_pattern", ("region",), "SELECT ?x WHERE { ?x ?p ?x }", _bgp("t0.subject AS x", "t0.subject = t0.otext"), vocabulary=True)
# filters
_sparql("filter_eq", ("part",), 'SELECT ?s WHERE { ?s p:p_size ?v FILTER(?v = "15") }', _bgp("t0.subject AS s", _p(0, "p_size"), "t0.object_float = 15"))
_sparql("filter_ne_iri", ("nation",), "SELECT ?s ?p WHERE { ?s ?p ?o FILTER(?o != <https://example.org/region/1>) }", _bgp("t0.subject AS s, t0.predicate AS p", f"t0.object_iri <> '{BASE}region/1'"))
_sparql("filter_range", ("customer",), "SELECT ?s ?v WHERE { ?s p:c_acctbal ?v FILTER(?v >= 1000 && ?v < 2000.5) }", _bgp("t0.subject AS s, t0.otext AS v", _p(0, "c_acctbal"), "t0.object_float >= 1000 AND t0.object_float < 2000.5"))
_sparql("filter_and_or_not", ("customer",), 'SELECT ?s WHERE { ?s p:c_mktsegment ?m ; p:c_acctbal ?v FILTER(!(?m = "BUILDING") && (?v < 0 || ?v > 9000)) }', _bgp("t0.subject AS s", _p(0, "c_mktsegment"), _p(1, "c_acctbal"), "t0.subject = t1.subject", "NOT (t0.object_string = 'BUILDING') AND (t1.object_float < 0 OR t1.object_float > 9000)"))
_sparql("filter_cross_pattern", ("region",), "SELECT ?a ?b WHERE { ?x p:r_name ?a . ?y p:r_name ?b FILTER(?a < ?b) }", _bgp("t0.otext AS a, t1.otext AS b", _p(0, "r_name"), _p(1, "r_name"), "t0.object_string < t1.object_string"))
_sparql("filter_var_var_compat", ("part",), "SELECT ?s WHERE { ?s p:p_brand ?a . ?s p:p_type ?b FILTER(?a < ?b) }", _bgp("t0.subject AS s", _p(0, "p_brand"), _p(1, "p_type"), "t0.subject = t1.subject", "t0.object_string < t1.object_string"))
_sparql("select_star", ("nation",), "SELECT * WHERE { ?s p:n_name ?n . ?s p:n_regionkey ?r }", _bgp("t0.subject AS s, t0.otext AS n, t1.otext AS r", _p(0, "n_name"), _p(1, "n_regionkey"), "t0.subject = t1.subject"))
_sparql("distinct", ("nation",), "SELECT DISTINCT ?r WHERE { ?s p:n_regionkey ?r }", _bgp("DISTINCT t0.otext AS r", _p(0, "n_regionkey")))
_frame("limit_count", ("nation",), lambda t: sparql.run(PREFIX + "SELECT ?s WHERE { ?s p:n_name ?n } LIMIT 7", t).agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM (SELECT 1 FROM triples WHERE predicate = '" + P + "n_name' LIMIT 7)")
_sparql("double_text", ("lineitem",), "SELECT ?s ?v WHERE { ?s p:l_extendedprice ?v FILTER(?v > 50000) }", _bgp("t0.subject AS s, t0.otext AS v", _p(0, "l_extendedprice"), "t0.object_float > 50000"))
# lookups
_V = ("nation", "customer")
_TYPE = f"predicate = '{S.RDF_TYPE}'"
_in = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"
_frame("classes", _V, lookups.classes, f"SELECT otext AS class, count(DISTINCT subject) AS instances FROM triples WHERE {_TYPE} GROUP BY 1", vocabulary=True)
_frame("datatypes", _V, lookups.datatypes, f"SELECT t.subject AS datatype, min(l.otext) AS label, min(m.otext) AS comment FROM triples t LEFT JOIN triples l ON l.subject = t.subject AND l.predicate = '{S.RDFS}label' LEFT JOIN triples m ON m.subject = t.subject AND m.predicate = '{S.RDFS}comment' WHERE t.{_TYPE} AND t.otext = '{S.RDFS}Datatype' GROUP BY 1", vocabulary=True)
_frame("instances", _V, lookups.instances, f"SELECT DISTINCT subject AS instance, otext AS class FROM triples WHERE {_TYPE} AND subject NOT IN (SELECT subject FROM triples WHERE {_TYPE} AND otext IN {_in(S.VOCABULARY_CLASSES)})", vocabulary=True)
_frame("properties", _V, lookups.properties, f"SELECT DISTINCT subject AS property, otext AS type FROM triples WHERE {_TYPE} AND otext IN {_in(S.PROPERTY_CLASSES)}", vocabulary=True)
_frame(
    "shapes", _V, lookups.shapes,
    f'SELECT t.subject AS shape, min(l.otext) AS "rdfs:label", min(m.otext) AS "rdfs:comment", t.otext AS "rdf:type", g.otext AS "sh:targetClass" FROM triples t LEFT JOIN triples l ON l.subject = t.subject AND l.predicate = \'{S.RDFS}label\' LEFT JOIN triples m ON m.subject = t.subject AND m.predicate = \'{S.RDFS}comment\' LEFT JOIN triples g ON g.subject = t.subject AND g.predicate = \'{S.SH}targetClass\' WHERE t.{_TYPE} AND t.otext IN {_in(S.SHAPE_CLASSES)} GROUP BY 1, 4, 5', vocabulary=True,
)
_frame("describe", _V, lambda t: lookups.describe(t, BASE + "customer/7"), f"SELECT predicate, otext AS object FROM triples WHERE subject = '{BASE}customer/7'")
_frame("counts", _V, lookups.counts, "SELECT count(*) AS triples, count(DISTINCT subject) AS subjects, count(DISTINCT predicate) AS predicates, count(DISTINCT otext) AS objects FROM triples")
_frame("predicate_counts", ("customer", "orders"), lookups.by_predicate, "SELECT predicate, count(*) AS n FROM triples GROUP BY 1")
_frame("top_subjects", ("nation", "region"), lookups.busiest_subjects, "SELECT subject, count(*) AS n FROM triples GROUP BY 1 ORDER BY n DESC, subject LIMIT 50")
_sparql("types_in_use", _V, "SELECT DISTINCT ?t WHERE { ?s a ?t }", f"SELECT DISTINCT otext AS t FROM triples WHERE {_TYPE}", vocabulary=True)
_sparql("typed_labels", _V, "SELECT ?s ?t ?l WHERE { ?s a ?t ; rdfs:label ?l }", f"SELECT a.subject AS s, a.otext AS t, b.otext AS l FROM triples a JOIN triples b ON a.subject = b.subject WHERE a.{_TYPE} AND b.predicate = '{S.RDFS}label'", vocabulary=True)
_HASH = "sha256('subject=' || subject || chr(10) || 'predicate=' || predicate || chr(10) || 'object=' || otext)"
_frame("triple_hash", ("customer",), lambda t: t.select("subject", "predicate", "triple_hash"), f"SELECT subject, predicate, {_HASH} AS triple_hash FROM triples", hashes=True)


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Term split of customers' literals: the numeric gate decides the column."""
    df = spark.read.parquet(f"{sf_dir}/customer.parquet")
    lit = lambda c, n: df.select(F.lit("iri").alias("s_kind"), F.concat(F.lit(BASE + "customer/"), F.col("c_custkey").cast("string")).alias("s"), F.lit(P + n).alias("p"), F.lit("literal").alias("o_kind"), c.alias("o"), F.lit(None).cast("string").alias("o_datatype"), F.lit(None).cast("string").alias("o_lang"))
    rows = lit(F.col("c_custkey").cast("string"), "key").union(lit(F.col("c_name"), "name")).union(lit(F.concat(F.lit(" "), F.col("c_custkey").cast("string")), "padded"))
    return terms.split_terms(rows).select("subject", "predicate", "object_float", "object_string", "triple_hash")


QUERIES["object_split"] = _objects
ORACLES["object_split"] = (
    f"WITH u AS (SELECT '{BASE}customer/' || c_custkey AS subject, p AS predicate, CASE WHEN p = '{P}key' THEN CAST(c_custkey AS VARCHAR) WHEN p = '{P}name' THEN c_name ELSE ' ' || c_custkey END AS o FROM customer CROSS JOIN (VALUES ('{P}key'), ('{P}name'), ('{P}padded')) v(p)) "
    f"SELECT subject, predicate, CASE WHEN predicate = '{P}key' THEN CAST(o AS DOUBLE) END AS object_float, CASE WHEN predicate <> '{P}key' THEN o END AS object_string, sha256('subject=' || subject || chr(10) || 'predicate=' || predicate || chr(10) || 'object=' || o) AS triple_hash FROM u"
)


# sources: every nation as a document of its own
_FORMS = {
    "turtle": f'<{BASE}nation/%d> <{P}n_name> "%s" ; <{P}n_regionkey> <{BASE}region/%d> .',
    "jsonld": f'{{"@context": {{"@vocab": "{P}"}}, "@id": "{BASE}nation/%d", "n_name": "%s", "n_regionkey": {{"@id": "{BASE}region/%d"}}}}',
    "xml": f'<r:RDF xmlns:r="{S.RDF}" xmlns:p="{P}"><r:Description r:about="{BASE}nation/%d"><p:n_name>%s</p:n_name><p:n_regionkey r:resource="{BASE}region/%d"/></r:Description></r:RDF>',
}
_NATIONS = f"SELECT '{BASE}nation/' || n_nationkey AS subject, '{P}n_name' AS predicate, CAST(NULL AS VARCHAR) AS object_iri, n_name AS object_string FROM nation UNION ALL SELECT '{BASE}nation/' || n_nationkey, '{P}n_regionkey', '{BASE}region/' || n_regionkey, NULL FROM nation"


def _source(kind: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = F.format_string(_FORMS[kind], "n_nationkey", "n_name", "n_regionkey")
        files = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("string").alias("path"), F.encode(text, "utf-8").alias("content"))
        return terms.split_terms(rdf.parse_files(files, lambda name, doc: linked.parse_any(doc, kind))).select("subject", "predicate", "object_iri", "object_string")

    return run


for _kind in _FORMS:
    QUERIES[f"source_{_kind}"], ORACLES[f"source_{_kind}"] = _source(_kind), _NATIONS


def _instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = modules.instances(tabular.triples(spark, sf_dir, "nation", vocabulary=True), [C + "Nation"], P)
    return made.select("subject", F.get_json_object("instance", "$.n_name[0]").alias("name"))


QUERIES["module_instances"] = _instances
ORACLES["module_instances"] = f"SELECT '{BASE}nation/' || n_nationkey AS subject, n_name AS name FROM nation"


# builds: the first has orders with an even or a threefold key, the second those with a threefold or a fivefold one
def _builds(t: DataFrame) -> tuple[DataFrame, DataFrame]:
    key = F.regexp_extract("subject", "([0-9]+)$", 1).cast("long")
    return t.filter((key % 2 == 0) | (key % 3 == 0)), t.filter((key % 3 == 0) | (key % 5 == 0))


_KEY = "CAST(regexp_extract(subject, '([0-9]+)$', 1) AS BIGINT)"
_frame("build_diff", ("orders",), lambda t: lookups.snapshot_diff(*_builds(t)).groupBy("change_type").agg(F.count("*").alias("n"), F.min("triple_hash").alias("first")), f"SELECT change_type, count(*) AS n, min(h) AS first FROM (SELECT {_HASH} AS h, CASE WHEN {_KEY} % 5 = 0 AND {_KEY} % 2 <> 0 AND {_KEY} % 3 <> 0 THEN 'added' WHEN {_KEY} % 2 = 0 AND {_KEY} % 3 <> 0 AND {_KEY} % 5 <> 0 THEN 'removed' END AS change_type FROM triples) WHERE change_type IS NOT NULL GROUP BY 1", hashes=True)
_frame("snapshot_diff", ("orders",), lambda t: lookups.snapshot_diff(*_builds(t)).select("change_type", "subject", "predicate", "triple_hash"), f"SELECT * FROM (SELECT CASE WHEN {_KEY} % 5 = 0 AND {_KEY} % 2 <> 0 AND {_KEY} % 3 <> 0 THEN 'added' WHEN {_KEY} % 2 = 0 AND {_KEY} % 3 <> 0 AND {_KEY} % 5 <> 0 THEN 'removed' END AS change_type, subject, predicate, {_HASH} AS triple_hash FROM triples) WHERE change_type IS NOT NULL", hashes=True)


def _merged(t: DataFrame) -> DataFrame:
    """Merge on read: rows of both builds, less the later build's deletes."""
    one, two = _builds(t)
    gone = one.join(two.select("triple_hash"), "triple_hash", "left_anti").select("triple_hash")
    rows = one.unionByName(two.join(one.select("triple_hash"), "triple_hash", "left_anti").select(one.columns))
    return rows.join(gone, "triple_hash", "left_anti").select("subject", "predicate", "triple_hash")


_frame("mor_read", ("orders",), _merged, f"SELECT subject, predicate, {_HASH} AS triple_hash FROM triples WHERE {_KEY} % 3 = 0 OR {_KEY} % 5 = 0", hashes=True)


# imports
def _imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["subject", "predicate", "object_iri", "object_float", "object_string"]
    names = lookups.view_names([("nation", "a"), ("supplier", "a")])
    return lookups.stacked_imports({n: tabular.triples(spark, sf_dir, t).select(cols) for n, t in zip(names, ("nation", "supplier"), strict=True)})


_IMPORTS = f"WITH {tabular.sql('nation', 'supplier')}, imports AS (SELECT CASE WHEN subject LIKE '%/nation/%' THEN 'nation' ELSE 'supplier' END AS view, subject, predicate, object_iri, object_float, object_string FROM triples) "
QUERIES["imports_union"], ORACLES["imports_union"] = _imports, _IMPORTS + "SELECT * FROM imports"
QUERIES["imports_counts"] = lambda spark, sf_dir: _imports(spark, sf_dir).groupBy("view").agg(F.count("*").alias("triples"))
ORACLES["imports_counts"] = _IMPORTS + "SELECT view, count(*) AS triples FROM imports GROUP BY 1"


# geometry
_POINT = "t0.lon IS NOT NULL"
_sparql("geo_within", ("supplier", "customer"), 'SELECT ?s WHERE { ?s p:at ?g FILTER(geof:sfWithin(?g, "POLYGON((-60 -40, 60 -40, 60 40, -60 40, -60 -40))"^^geo:wktLiteral)) }', _bgp("t0.subject AS s", _POINT, "t0.lon > -60 AND t0.lon < 60 AND t0.lat > -40 AND t0.lat < 40"), points=True)
_sparql("geo_distance_deg", ("supplier",), 'SELECT ?s WHERE { ?s p:at ?g FILTER(geof:distance(?g, "POINT(0 0)"^^geo:wktLiteral, uom:degree) < 90) }', _bgp("t0.subject AS s", _POINT, "sqrt(t0.lon * t0.lon + t0.lat * t0.lat) < 90"), points=True)
_sparql("geo_distance_metre", ("supplier",), 'SELECT ?s WHERE { ?s p:at ?g FILTER(geof:distance(?g, "POINT(10 20)"^^geo:wktLiteral, uom:metre) < 8000000) }', _bgp("t0.subject AS s", _POINT, f"2 * {geo.EARTH_RADIUS} * asin(sqrt(pow(sin(radians(t0.lat - 20) / 2), 2) + cos(radians(t0.lat)) * cos(radians(20)) * pow(sin(radians(t0.lon - 10) / 2), 2))) < 8000000"), points=True)
_frame("geo_extent", ("supplier", "customer"), lookups.extent, 'SELECT min(lon) AS xmin, min(lat) AS ymin, max(lon) AS xmax, max(lat) AS ymax, count(*) AS "count" FROM triples WHERE lon IS NOT NULL', points=True)
_frame("geo_page", ("customer",), lambda t: lookups.geometries(t, "-90,-45,90,45", 20, 5).select("subject", "predicate"), "SELECT subject, predicate FROM triples WHERE lon BETWEEN -90 AND 90 AND lat BETWEEN -45 AND 45 ORDER BY subject, predicate LIMIT 20 OFFSET 5", points=True)


def _near(t: DataFrame) -> DataFrame:
    pts = t.filter(F.col("predicate") == P + "at").select("subject", "object_geometry")
    a = pts.filter(F.col("subject").contains("/supplier/")).select(F.col("subject").alias("a"), F.col("object_geometry").alias("ga"))
    b = pts.filter(F.col("subject").contains("/customer/")).select(F.col("subject").alias("b"), F.col("object_geometry").alias("gb"))
    return geo.spatial_join(a, b, "ga", "gb", "sfEquals").select("a", "b")


_frame("geo_join", ("supplier", "customer"), _near, "SELECT a.subject AS a, b.subject AS b FROM triples a JOIN triples b ON a.lon = b.lon AND a.lat = b.lat WHERE a.subject LIKE '%/supplier/%' AND b.subject LIKE '%/customer/%'", points=True)

_BOX = '"POLYGON((-90 -45, 0 -45, 0 45, -90 45, -90 -45))"^^geo:wktLiteral'
_sparql("geo_set_operations", ("supplier",), f'SELECT ?s WHERE {{ ?s p:at ?g FILTER(geof:sfWithin(?g, geof:difference({_BOX}, "POLYGON((-50 -90, 90 -90, 90 90, -50 90, -50 -90))"^^geo:wktLiteral)) || geof:sfIntersects(geof:intersection(?g, {_BOX}), "POLYGON((-20 -90, 90 -90, 90 90, -20 90, -20 -90))"^^geo:wktLiteral)) }}', _bgp("t0.subject AS s", _POINT, "t0.lat BETWEEN -45 AND 45 AND (t0.lon > -90 AND t0.lon < -50 OR t0.lon BETWEEN -20 AND 0)"), points=True)


# sinks
_N = f"CASE WHEN object_iri IS NOT NULL THEN '<' || object_iri || '>' WHEN object_float IS NOT NULL THEN '\"' || CAST(object_float AS VARCHAR) || '\"^^<{S.XSD}double>' ELSE '\"' || object_string || '\"' END"
_frame("export_ntriples", ("nation", "supplier"), lambda t: t.select(terms.ntriples_line().alias("line")), f"SELECT '<' || subject || '> <' || predicate || '> ' || {_N} || ' .' AS line FROM triples")
_frame("sparql_json_types", ("nation",), lambda t: sinks.sparql_json(t.select("subject", terms.object_text().alias("o"))), """SELECT '{"subject":{"type":"uri","value":"' || subject || '"},"o":{"type":"' || CASE WHEN object_iri IS NULL THEN 'literal' ELSE 'uri' END || '","value":"' || otext || '"}}' AS binding FROM triples""")
_frame("render_text", ("part",), lambda t: terms.render_text(t.select("subject", "object_float", "object_string")), "SELECT subject, coalesce(CAST(object_float AS VARCHAR), '') AS object_float, coalesce(object_string, '') AS object_string FROM triples")
# checks
_frame("subclass_closure", ("region",), validate.subclass_closure, f"SELECT * FROM (WITH RECURSIVE c(child, ancestor) AS (SELECT subject, object_iri FROM triples WHERE predicate = '{S.RDFS}subClassOf' UNION SELECT c.child, t.object_iri FROM c JOIN triples t ON t.subject = c.ancestor AND t.predicate = '{S.RDFS}subClassOf') SELECT * FROM c)", vocabulary=True)
_frame("untyped_subjects", ("region",), lambda t: validate.untyped_subjects(t, C), f"SELECT DISTINCT subject FROM triples WHERE subject LIKE '{C}%' AND subject NOT IN (SELECT subject FROM triples WHERE {_TYPE})", vocabulary=True)
_frame("types_without_class", ("region", "nation", "customer"), lambda t: validate.types_without_class(t, C), f"SELECT type FROM (VALUES ('{C}Region')) v(type)", vocabulary=True)


def _window(spark: SparkSession, sf_dir: str) -> DataFrame:
    tabular.triples(spark, sf_dir, "orders").createOrReplaceTempView("triples")
    return spark.sql("SELECT predicate, n, CAST(rank() OVER (ORDER BY n DESC) AS BIGINT) AS r FROM (SELECT predicate, count(DISTINCT object_string) AS n FROM triples GROUP BY predicate)")


QUERIES["window_passthrough"] = _window
ORACLES["window_passthrough"] = f"WITH {tabular.sql('orders')} SELECT predicate, n, CAST(rank() OVER (ORDER BY n DESC) AS BIGINT) AS r FROM (SELECT predicate, count(DISTINCT object_string) AS n FROM triples GROUP BY predicate)"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["join_star4"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return {**QUERIES, **checks.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**ORACLES, **checks.ORACLES}
