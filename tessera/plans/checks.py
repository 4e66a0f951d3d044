"""More registered queries: stored tables, builds, checks, sinks and geometry, each over whole tables and with the SQL that it must equal."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schema as S
from tessera import shared
from tessera.engine import Engine
from tessera.functions import geo, sinks, terms
from tessera.operators import build, lookups, modules, publish, validate
from tessera.operators.store import Store, find_tables, lineage
from tessera.plans import samples, sparql
from tessera.sources import linked, rdf, tabular
from tessera.sources.tabular import BASE, C, P
from tessera.streaming import ingest

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
PREFIX = f"PREFIX p: <{P}> PREFIX c: <{C}> PREFIX rdfs: <{S.RDFS}> PREFIX geof: <{S.GEOF}> PREFIX geo: <{S.GEO}> PREFIX uom: <{S.UOM}> "


def _query(oracle: str | None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


def _rows(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# ---- stored tables: the first and the third build have what has an even or a threefold key, the second what has a threefold or a fivefold one

_TABLES = ("supplier", "nation")
_BUILDS: dict[tuple, str] = {}
_HASH = "sha256('subject=' || subject || chr(10) || 'predicate=' || predicate || chr(10) || 'object=' || otext)"
_KEY = "CAST(regexp_extract(subject, '([0-9]+)$', 1) AS BIGINT)"
_WITH = f"WITH {tabular.sql(*_TABLES)}, k AS (SELECT subject, predicate, {_HASH} AS triple_hash, {_KEY} % 2 = 0 OR {_KEY} % 3 = 0 AS a, {_KEY} % 3 = 0 OR {_KEY} % 5 = 0 AS b FROM triples) "


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = tabular.triples(spark, sf_dir, *_TABLES, hashes=True)
    key = F.regexp_extract("subject", "([0-9]+)$", 1).cast("long")
    return t.filter((key % 2 == 0) | (key % 3 == 0)), t.filter((key % 3 == 0) | (key % 5 == 0))


def _built(spark: SparkSession, sf_dir: str) -> Store:
    """A table of three builds in the shared folder, made once for a session and input."""
    name = (spark.sparkContext.applicationId, sf_dir)
    if name not in _BUILDS:
        path = f"{shared.folder(spark)}/builds-{uuid.uuid4().hex}/inner/table"
        store, (a, b) = Store(spark, path), _parts(spark, sf_dir)
        store.write(a, {"build": "1", "modules": '["m"]'}, "v1")
        store.write(b, {"build": "2"}, "v2")
        store.write(a, {"build": "3"}, "v3")
        _BUILDS[name] = path
    return Store(spark, _BUILDS[name])


def _copied(spark: SparkSession, sf_dir: str) -> Store:
    """A copy that a query may change."""
    store = _built(spark, sf_dir)
    target = f"{shared.folder(spark)}/copy-{uuid.uuid4().hex}"
    publish.copy_table(spark, store.path, target)
    return Store(spark, target)


_KEYS = ("subject", "predicate", "triple_hash")


@_query(_WITH + "SELECT subject, predicate, triple_hash FROM k WHERE a")
def store_current(spark, sf_dir):
    """What is there after a delete and the same rows again."""
    return _built(spark, sf_dir).as_of().select(*_KEYS)


@_query(_WITH + "SELECT subject, predicate, triple_hash FROM k WHERE b")
def store_time_travel(spark, sf_dir):
    store = _built(spark, sf_dir)
    return store.as_of(store.refs()["v2"]).select(*_KEYS)


@_query(_WITH + "SELECT CASE WHEN a THEN 'added' ELSE 'removed' END AS change_type, subject, predicate, triple_hash FROM k WHERE a <> b")
def store_diff(spark, sf_dir):
    return _built(spark, sf_dir).diff("latest").select("change_type", *_KEYS)


@_query(_WITH + "SELECT 'added' AS change_type, subject, predicate, triple_hash FROM k WHERE a")
def store_first_diff(spark, sf_dir):
    store = _built(spark, sf_dir)
    return store.diff(store.refs()["v1"]).select("change_type", *_KEYS)


@_query("SELECT * FROM (VALUES (1::BIGINT, 'append', 'v1'), (2, 'overwrite', 'v2'), (3, 'overwrite', 'main, v3')) v(sequence_number, operation, tags)")
def store_snapshots(spark, sf_dir):
    return _built(spark, sf_dir).snapshots().select("sequence_number", "operation", "tags")


@_query("""SELECT * FROM (VALUES ('build', '3'), ('modules', '["m"]')) v(key, value)""")
def store_properties(spark, sf_dir):
    return _built(spark, sf_dir).properties()


@_query("SELECT * FROM (VALUES ('m', true, false)) v(module, stale, current)")
def store_modules_and_staleness(spark, sf_dir):
    store = _built(spark, sf_dir)
    return spark.createDataFrame([(m, store.is_stale("v2"), store.is_stale("v3")) for m in store.modules()], "module string, stale boolean, current boolean")


@_query(_WITH + "SELECT triple_hash, predicate FROM k WHERE a")
def store_existing(spark, sf_dir):
    return _built(spark, sf_dir).existing()


@_query(_WITH + "SELECT count(*) AS triples, 2::BIGINT AS snapshots, 'v1' AS first_tag, 'main, v2, v3' AS last_tags FROM k WHERE a")
def store_squashed(spark, sf_dir):
    store = _copied(spark, sf_dir)
    store.squash([store.refs()["v2"], store.refs()["v3"]])
    listing = store.snapshots()
    tags = listing.agg(F.count("*").alias("snapshots"), F.min_by("tags", "sequence_number").alias("first_tag"), F.max_by("tags", "sequence_number").alias("last_tags"))
    return store.as_of().agg(F.count("*").alias("triples")).crossJoin(tags)


@_query(_WITH + "SELECT subject, predicate, triple_hash FROM k WHERE b")
def store_rolled_back(spark, sf_dir):
    """The first and the last snapshot are deleted: the second is there as it was."""
    store = _copied(spark, sf_dir)
    store.delete_snapshots([store.refs()["v1"], store.refs()["v3"]])
    return store.as_of().select(*_KEYS)


@_query(_WITH + "SELECT subject, predicate, triple_hash FROM k WHERE a OR b")
def store_appended(spark, sf_dir):
    """A micro-batch on top: what is there already changes nothing."""
    store, (_, b) = _copied(spark, sf_dir), _parts(spark, sf_dir)
    kind = F.when(F.col("object_iri").isNotNull(), "iri").otherwise("literal")
    batch = b.select(F.lit("iri").alias("s_kind"), F.col("subject").alias("s"), F.col("predicate").alias("p"), kind.alias("o_kind"), terms.object_text().alias("o"), F.lit(None).cast("string").alias("o_datatype"), F.lit(None).cast("string").alias("o_lang"))
    ingest.append_batch(store, batch.unionByName(batch))
    return store.as_of().select(*_KEYS)


@_query(_WITH + f"SELECT k.subject AS s, t.otext AS n FROM k JOIN triples t USING (subject, predicate) WHERE k.b AND k.predicate = '{P}s_name'")
def store_sparql(spark, sf_dir):
    store = _built(spark, sf_dir)
    return sparql.run(PREFIX + "SELECT ?s ?n WHERE { ?s p:s_name ?n }", store.as_of(store.refs()["v2"]))


@_query(_WITH + "SELECT triple_hash FROM k WHERE b ORDER BY triple_hash LIMIT 100")
def sample_time_travel(spark, sf_dir):
    engine = Engine(spark, _built(spark, sf_dir).path)
    engine.register_snapshots()
    return engine.sql(engine.sample_queries()["Snapshot 2 (overwrite)"]).select("triple_hash")


@_query("SELECT 'inner/table' AS found")
def table_discovery(spark, sf_dir):
    root = _built(spark, sf_dir).path.removesuffix("/inner/table")
    return spark.createDataFrame([("/".join(t.split("/")[-2:]),) for t in find_tables(spark, root)], "found string")


@_query(_WITH + "SELECT 'same' AS state, true AS again, count(*) AS triples FROM k WHERE a")
def published_copy(spark, sf_dir):
    a, b = _built(spark, sf_dir), _copied(spark, sf_dir)
    state = lineage([e["snapshot_id"] for e in b.log()], [e["snapshot_id"] for e in a.log()])
    return b.as_of().agg(F.count("*").alias("triples")).select(F.lit(state).alias("state"), F.lit(publish.copy_table(spark, a.path, b.path) == 0).alias("again"), "triples")


# ---- builds and checks


def _documents(spark: SparkSession, sf_dir: str, text) -> DataFrame:
    """One document a nation."""
    return _rows(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("path"), F.encode(text, "utf-8").alias("content"))


@_query(f"SELECT 'n' || n_nationkey AS path, CASE WHEN n_nationkey % 2 = 0 THEN 2 ELSE 1 END AS line, CASE WHEN n_nationkey % 2 = 0 THEN 'zz:name' ELSE '{BASE}nation/' || n_nationkey END AS term FROM nation WHERE n_nationkey % 3 <> 0")
def jsonld_checks(spark, sf_dir):
    """Even keys use a prefix that is not declared, odd ones are local nodes without a type, threefold ones are fine."""
    text = F.when(F.col("n_nationkey") % 3 == 0, F.format_string('{"@context": {"zz": "urn:z:"}, "@id": "nation/%d", "@type": "zz:N", "zz:name": "x"}', "n_nationkey"))
    text = text.when(F.col("n_nationkey") % 2 == 0, F.format_string('{"@id": "nation/%d", "@type": "http://x/N",\n "zz:name": "x"}', "n_nationkey")).otherwise(F.format_string('{"@id": "nation/%d", "http://x/n": "x"}', "n_nationkey"))
    return linked.checked_jsonld(_documents(spark, sf_dir, text), BASE).select("path", "line", "term")


_TURTLE = "@prefix p: <" + P + "> . @prefix x: <" + S.XSD + '> . <nation/%d> p:n_name "a \\"%s\\" \\\\ b\\n"@en ;\n p:near [ p:n_regionkey <region/%d> ; p:list ( 1 2.5 ) ] , _:other .\n_:other p:label "%d"^^x:integer .'


@_query(f"SELECT '{BASE}nation/' || n_nationkey AS subject, 'a \"' || n_name || '\" \\ b' || chr(10) AS name, '{BASE}region/' || n_regionkey AS region, CAST(n_nationkey AS DOUBLE) AS label, 3.5 AS listed, 2::BIGINT AS linked FROM nation".replace("3.5 AS", "CAST(3.5 AS DOUBLE) AS"))
def turtle_of_many_kinds(spark, sf_dir):
    """Escapes, language tags, a base, nested and labelled blank nodes, a list."""
    text = F.format_string(_TURTLE, "n_nationkey", "n_name", "n_regionkey", "n_nationkey")
    t = terms.split_terms(rdf.parse_files(_documents(spark, sf_dir, text), lambda name, doc: linked.parse_any(doc, "turtle", BASE)))
    top = t.filter(F.col("predicate") == P + "n_name").select("subject", F.col("object_string").alias("name"))
    near = t.filter(F.col("predicate") == P + "near").select("subject", F.col("object_string").alias("b"))
    region = t.filter(F.col("predicate") == P + "n_regionkey").select(F.col("subject").alias("b"), F.col("object_iri").alias("region"))
    label = t.filter(F.col("predicate") == P + "label").select(F.col("subject").alias("b"), F.col("object_float").alias("label"))
    cells = t.filter(F.col("predicate") == P + "list").select(F.col("subject").alias("b"), F.col("object_string").alias("cell"))
    first = t.filter(F.col("predicate") == S.RDF + "first").select(F.col("subject").alias("cell"), "object_float")
    rest = t.filter((F.col("predicate") == S.RDF + "rest") & F.col("object_string").isNotNull()).select(F.col("subject").alias("cell"), F.col("object_string").alias("next"))
    both = cells.join(rest, "cell").join(first, "cell").join(first.toDF("next", "second"), "next").select("b", (F.col("object_float") + F.col("second")).alias("listed"))
    linked_ = near.groupBy("subject").agg(F.count("*").alias("linked"))
    return top.join(near.join(region, "b").join(both, "b"), "subject").join(near.join(label, "b").select("subject", "label"), "subject").join(linked_, "subject").select("subject", "name", "region", "label", "listed", "linked")


def _nation_terms(spark: SparkSession, sf_dir: str, label) -> DataFrame:
    """Each nation points to a blank node that has its name; the node's label is the caller's."""
    n = _rows(spark, sf_dir, "nation")
    node = F.concat(F.lit("_:"), label)
    line = lambda sk, s, p, ok, o: F.struct(F.lit(sk).alias("s_kind"), s.alias("s"), F.lit(p).alias("p"), F.lit(ok).alias("o_kind"), o.alias("o"), F.lit(None).cast("string").alias("o_datatype"), F.lit(None).cast("string").alias("o_lang"))
    iri = F.concat(F.lit(BASE + "nation/"), F.col("n_nationkey").cast("string"))
    return n.select(F.explode(F.array(line("iri", iri, P + "at", "bnode", node), line("bnode", node, P + "name", "literal", F.col("n_name")))).alias("t")).select("t.*")


@_query(f"SELECT '{BASE}nation/' || n_nationkey AS nation, true AS same, true AS own FROM nation")
def bnodes_keep_their_names(spark, sf_dir):
    """Names do not depend on labels, and different nodes have different ones."""
    one, two = (validate.stable_blank_nodes(_nation_terms(spark, sf_dir, label)) for label in (F.col("n_nationkey").cast("string"), F.concat(F.lit("x"), (100 - F.col("n_nationkey")).cast("string"))))
    name = lambda t, c: t.filter("o_kind = 'bnode'").select(F.col("s").alias("nation"), F.col("o").alias(c))
    shared_by = name(one, "a").groupBy("a").agg(F.count("*").alias("n"))
    return name(one, "a").join(name(two, "b"), "nation").join(shared_by, "a").select("nation", (F.col("a") == F.col("b")).alias("same"), (F.col("n") == 1).alias("own"))


@_query(f"SELECT DISTINCT iri FROM (SELECT '{BASE}nation/' || n_nationkey AS iri FROM nation UNION ALL SELECT * FROM (VALUES ('{P}at'), ('{P}name')) v(iri))")
def vocabulary_of_terms(spark, sf_dir):
    return validate.vocabulary_terms(_nation_terms(spark, sf_dir, F.col("n_nationkey").cast("string")))


@_query(
    "SELECT 'n' || n_nationkey AS path, CAST(n_regionkey AS INT) AS line, t AS term, 'n' || n_nationkey || ':' || n_regionkey || ': undefined term ' || t AS message FROM (SELECT *, CASE n_nationkey % 4 WHEN 1 THEN 'p:n_nmae' WHEN 2 THEN 'xsd:strnig' WHEN 3 THEN 'old:gone' END AS t FROM nation) WHERE t IS NOT NULL"
)
def undefined_terms_of_files(spark, sf_dir):
    """Known names, a misspelt one, one of XML Schema, and one that a replaced vocabulary has not."""
    key = F.col("n_nationkey") % 4
    iri = F.when(key == 0, P + "n_name").when(key == 1, P + "n_nmae").when(key == 2, S.XSD + "strnig").otherwise("http://old/gone")
    n = _rows(spark, sf_dir, "nation")
    used = n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("path"), F.col("n_regionkey").cast("int").alias("line"), F.explode(F.array(iri, F.lit(S.XSD + "string"), F.lit("http://old/kept"), F.lit("urn:free"))).alias("iri"))
    known = spark.createDataFrame([(P + "n_name",), ("http://new/kept",)], "iri string")
    return validate.undefined_terms(used, known, {"p": P, "old": "http://old/"}, replacements={"http://old/": "http://new/"})


_PIN = f"'{BASE}nation/' || n_nationkey"


@_query(
    f"SELECT {_PIN} AS s, '{S.RDF_TYPE}' AS p, '{S.OWL}Ontology' AS o FROM nation UNION ALL SELECT {_PIN}, '{S.OWL}versionIRI', 'urn:sha256:' || sha256(n_name) FROM nation UNION ALL SELECT {_PIN}, '{build.DCTERMS}format', 'text/turtle' FROM nation WHERE n_nationkey % 2 = 0 "
    f"UNION ALL SELECT {_PIN}, '{build.DCTERMS}modified', '2024-01-01T00:00:00Z' FROM nation"
)
def provenance_of_pins(spark, sf_dir):
    n = _rows(spark, sf_dir, "nation")
    pins = n.select(F.concat(F.lit(BASE + "nation/"), F.col("n_nationkey").cast("string")).alias("ontology"), F.sha2("n_name", 256).alias("version"), F.when(F.col("n_nationkey") % 2 == 0, "text/turtle").alias("format"), F.lit("2024-01-01T00:00:00Z").alias("modified"))
    return build.provenance(pins).filter(F.col("p") != S.RDFS + "comment").select("s", "p", "o")


@_query(
    f"SELECT '{BASE}nation/' || n_nationkey AS s, CASE WHEN n_nationkey % 2 = 0 THEN '{S.OWL}imports' ELSE '{P}name' END AS p, CASE WHEN n_nationkey % 2 = 0 THEN 'urn:region:' || n_regionkey ELSE n_name END AS o FROM nation WHERE n_nationkey % 2 = 1 OR n_regionkey > 1 "
    f"UNION ALL SELECT DISTINCT 'urn:region:' || n_regionkey, '{P}name', 'region' FROM nation WHERE n_nationkey % 2 = 0 AND n_regionkey > 1"
)
def ontology_imports(spark, sf_dir):
    """Even nations import their region: regions 0 and 1 are artifacts, whose statements go, the others bring a triple of their own."""
    n = _rows(spark, sf_dir, "nation")
    even = F.col("n_nationkey") % 2 == 0
    graph = n.select(
        F.lit("iri").alias("s_kind"), F.concat(F.lit(BASE + "nation/"), F.col("n_nationkey").cast("string")).alias("s"), F.when(even, S.OWL + "imports").otherwise(P + "name").alias("p"), F.when(even, "iri").otherwise("literal").alias("o_kind"),
        F.when(even, F.concat(F.lit("urn:region:"), F.col("n_regionkey").cast("string"))).otherwise(F.col("n_name")).alias("o"), F.lit(None).cast("string").alias("o_datatype"), F.lit(None).cast("string").alias("o_lang"),
    )
    fetch = lambda iri: spark.createDataFrame([("iri", iri, P + "name", "literal", "region", None, None)], S.TERMS)
    return build.with_ontologies(graph, fetch, lambda iri: iri.rsplit(":", 1)[1] in "01").select("s", "p", "o")


@_query(f"SELECT '{BASE}nation/' || n_nationkey || '/size' AS s, '{P}length' AS p, CAST(length(n_name) AS VARCHAR) AS o FROM nation")
def module_output(spark, sf_dir):
    """A task makes a node of each instance."""
    made = modules.instances(tabular.triples(spark, sf_dir, "nation", vocabulary=True), [C + "Nation"], P)

    def task(instance):
        yield {"@id": instance["@id"] + "/size", "length": len(instance["n_name"][0])}

    return modules.materialise(made, task, {"@vocab": P}).select("s", "p", "o")


@_query(f"SELECT '{BASE}nation/' || n_nationkey AS subject, n_name AS deepest FROM nation")
def nested_instances(spark, sf_dir):
    """Blank nodes five levels deep."""
    n = _rows(spark, sf_dir, "nation")
    iri, node = F.concat(F.lit(BASE + "nation/"), F.col("n_nationkey").cast("string")), lambda i: F.concat(F.lit(f"_:{i}x"), F.col("n_nationkey").cast("string"))
    line = lambda s, p, iri=None, text=None: F.struct(s.alias("subject"), F.lit(p).alias("predicate"), (iri if iri is not None else F.lit(None).cast("string")).alias("object_iri"), F.lit(None).cast("double").alias("object_float"), (text if text is not None else F.lit(None).cast("string")).alias("object_string"), F.lit(None).cast("binary").alias("object_geometry"))
    lines = [line(iri, S.RDF_TYPE, iri=F.lit(C + "Nation")), line(iri, P + "in", text=node(1)), *(line(node(i), P + "in", text=node(i + 1)) for i in range(1, 5)), line(node(5), P + "name", text=F.col("n_name"))]
    made = modules.instances(n.select(F.explode(F.array(*lines)).alias("t")).select("t.*"), [C + "Nation"], P)
    return made.select("subject", F.get_json_object("instance", "$.in[0].in[0].in[0].in[0].in[0].name[0]").alias("deepest"))


@_query("SELECT CAST(event_id AS BIGINT) AS event_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events")
def properties_of_events(spark, sf_dir):
    return _rows(spark, sf_dir, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))


@_query("SELECT CAST(s_suppkey AS VARCHAR) AS ontology, CAST(s_nationkey AS VARCHAR) AS version, CASE WHEN s_suppkey % 2 = 0 THEN 'ttl' ELSE '' END AS format, CASE WHEN s_suppkey IN (SELECT c_nationkey FROM customer) THEN 'yes' ELSE 'no' END AS imported FROM supplier UNION ALL SELECT DISTINCT CAST(c_nationkey AS VARCHAR), '', '', 'yes' FROM customer WHERE c_nationkey NOT IN (SELECT s_suppkey FROM supplier)")
def ontologies_of_tables(spark, sf_dir):
    pins = _rows(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("ontology"), F.col("s_nationkey").cast("string").alias("version"), F.when(F.col("s_suppkey") % 2 == 0, "ttl").alias("format"))
    return lookups.ontologies(pins, _rows(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("ontology")))


@_query("SELECT o_orderkey AS snapshot_id, o_custkey AS sequence_number, coalesce(t.tags, '') AS tags FROM orders LEFT JOIN (SELECT l_orderkey, string_agg(t, ', ' ORDER BY t) AS tags FROM (SELECT l_orderkey, l_returnflag || l_linenumber AS t FROM lineitem WHERE l_linenumber < 4) GROUP BY 1) t ON t.l_orderkey = o_orderkey")
def snapshot_tags_of_tables(spark, sf_dir):
    snaps = _rows(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("snapshot_id"), F.col("o_custkey").alias("sequence_number"))
    tags = _rows(spark, sf_dir, "lineitem").filter("l_linenumber < 4").select(F.col("l_orderkey").alias("snapshot_id"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("tag"))
    return lookups.snapshot_listing(snaps, tags)


# ---- queries as text


_WRONG = {
    "ASK { ?s ?p ?o }": "UnsupportedSparql", "SELECT ?s WHERE { ?s ?p ?o } ORDER BY ?s": "UnsupportedSparql", "SELECT ?s WHERE { OPTIONAL { ?s ?p ?o } }": "UnsupportedSparql", "SELECT ?s WHERE { }": "UnsupportedSparql",
    "SELECT ?s WHERE { ?s ?p ?o FILTER(?x = 1) }": "UnsupportedSparql", "SELECT ?s WHERE { ?s ?p ?o FILTER(regex(?o, 'x')) }": "UnsupportedSparql", "SELECT ?s WHERE { ?s ?p ?o FILTER(?o + 1 = 2) }": "UnsupportedSparql", "SELECT ?x WHERE { ?s ?p ?o }": "UnsupportedSparql",
    "SELECT ?s WHERE { ?s ?p ?o FILTER(geof:buffer(?o)) }": "UnsupportedSparql", "SELECT ?s WHERE { ?s ?p ?o FILTER(geof:sfWithin(?o)) }": "UnsupportedSparql", "SELECT ?s WHERE { ?s ?p ?o FILTER(geof:distance(?o, ?o, uom:mile) < 1) }": "UnsupportedSparql",
    "SELECT ?s WHERE { ?s nope:x ?o }": "InvalidSparql", "SELECT ?s WHERE { ?s ?p ?o": "InvalidSparql", "SELECT WHERE { ?s ?p ?o }": "InvalidSparql",
}


@_query("SELECT * FROM (VALUES " + ", ".join("('" + q.replace("'", "''") + f"', '{kind}')" for q, kind in _WRONG.items()) + ") v(query, error)")
def rejected_queries(spark, sf_dir):
    """What kind of error each query outside of the language is, over a whole table."""
    t, out = tabular.triples(spark, sf_dir, "nation"), []
    for text in _WRONG:
        try:
            sparql.run(PREFIX + text, t)
            out.append((text, "none"))
        except Exception as e:  # noqa: BLE001 the kind of the error is the result
            out.append((text, type(e).__name__))
    return spark.createDataFrame(out, "query string, error string")


def _view(spark: SparkSession, sf_dir: str, *tables: str, **options) -> Engine:
    return Engine(spark, triples=tabular.triples(spark, sf_dir, *tables, hashes=True, **options))


@_query(f"WITH {tabular.sql('customer', 'nation')} SELECT t0.subject AS c, t1.otext AS bal, t3.otext AS nation FROM triples t0, triples t1, triples t2, triples t3 WHERE t0.predicate = '{P}c_name' AND t1.predicate = '{P}c_acctbal' AND t2.predicate = '{P}c_nationkey' AND t3.predicate = '{P}n_name' AND t0.subject = t1.subject AND t0.subject = t2.subject AND t2.otext = t3.subject AND t1.object_float > 5000")
def translated_query(spark, sf_dir):
    """The SQL that is shown for a query, run as it stands."""
    engine = _view(spark, sf_dir, "customer", "nation")
    return engine.sql(engine.translated(PREFIX + "SELECT ?c ?bal ?nation WHERE { ?c p:c_name ?n ; p:c_acctbal ?bal ; p:c_nationkey ?k . ?k p:n_name ?nation FILTER(?bal > 5000) }"))


@_query(f"WITH {tabular.sql('nation', vocabulary=True)} SELECT 'Properties' AS sample, subject AS a, otext AS b FROM triples WHERE predicate = '{S.RDF_TYPE}' AND otext IN ({', '.join(repr(c) for c in S.PROPERTY_CLASSES)}) UNION ALL SELECT 'Subclasses', subject, otext FROM triples WHERE predicate = '{S.RDFS}subClassOf' UNION ALL SELECT DISTINCT 'Predicates', predicate, '' FROM triples UNION ALL SELECT DISTINCT 'Classes', subject, '' FROM triples WHERE predicate = '{S.RDF_TYPE}' AND otext = '{S.RDFS}Class'")
def starter_queries(spark, sf_dir):
    t = tabular.triples(spark, sf_dir, "nation", vocabulary=True)
    out = None
    for name in ("Properties", "Subclasses", "Predicates", "Classes"):
        df = sparql.run(samples.starter(name), t)
        one = df.select(F.lit(name).alias("sample"), F.col(df.columns[0]).alias("a"), (F.col(df.columns[1]) if len(df.columns) > 1 else F.lit("")).alias("b"))
        out = one if out is None else out.union(one)
    return out


@_query(f"WITH {tabular.sql('nation')} SELECT 'around' AS kind, predicate AS a, otext AS b FROM triples WHERE subject = '{BASE}nation/3' UNION ALL SELECT 'with', subject, predicate FROM triples WHERE object_string = (SELECT n_name FROM nation WHERE n_nationkey = 3)")
def node_queries(spark, sf_dir):
    t = tabular.triples(spark, sf_dir, "nation")
    name = t.filter(f"subject = '{BASE}nation/3' AND predicate = '{P}n_name'").first()["object_string"]
    one, two = (sparql.run(samples.node_query(*args), t) for args in (("iri", BASE + "nation/3"), ("literal", name)))
    return one.toDF("a", "b").select(F.lit("around").alias("kind"), "a", "b").union(two.toDF("a", "b").select(F.lit("with").alias("kind"), "a", "b"))


# ---- sinks


@_query(f"WITH {tabular.sql('nation')} SELECT '<' || subject || '> <' || predicate || '> ' || CASE WHEN object_iri IS NOT NULL THEN '<' || object_iri || '>' ELSE '\"' || object_string || '\"' END || ' <urn:g> .' AS line FROM triples")
def export_nquads(spark, sf_dir):
    return tabular.triples(spark, sf_dir, "nation").select(terms.nquads_line("urn:g").alias("line"))


@_query("SELECT '_:n' || n_nationkey || ' <urn:p> \"a\\\"' || n_name || '\\\\\\n\\t\" .' AS line FROM nation UNION ALL SELECT '<urn:x> <urn:p> _:n' || n_nationkey || ' .' FROM nation UNION ALL SELECT '<urn:x> <urn:p> \"POINT (' || n_nationkey || ' 1)\"^^<" + S.WKT_LITERAL + ">' || ' .' FROM nation")
def export_odd_terms(spark, sf_dir):
    """Blank nodes, characters that are escaped, geometries."""
    n, key = _rows(spark, sf_dir, "nation"), F.col("n_nationkey")
    node, null = F.concat(F.lit("_:n"), key.cast("string")), F.lit(None).cast("string")
    row = lambda s, text, wkb: n.select(s.alias("subject"), F.lit("urn:p").alias("predicate"), null.alias("object_iri"), null.cast("double").alias("object_float"), text.alias("object_string"), wkb.alias("object_geometry"))
    none = null.cast("binary")
    return row(node, F.concat(F.lit('a"'), F.col("n_name"), F.lit("\\\n\t")), none).union(row(F.lit("urn:x"), node, none)).union(row(F.lit("urn:x"), null, geo.st_point(key, F.lit(1)))).select(terms.ntriples_line().alias("line"))


@_query("""SELECT '{"o":{"type":"bnode","value":"n' || n_nationkey || '"}}' AS binding FROM nation UNION ALL SELECT '{"o":{"type":"literal","value":"POINT (' || n_nationkey || ' 1)","datatype":\"""" + S.WKT_LITERAL + """\"}}' FROM nation UNION ALL SELECT '{"o":{"type":"uri","value":"urn:n' || n_nationkey || '"}}' FROM nation""")
def sparql_json_odd_terms(spark, sf_dir):
    key = F.col("n_nationkey").cast("string")
    return sinks.sparql_json(_rows(spark, sf_dir, "nation").select(F.explode(F.array(F.concat(F.lit("_:n"), key), F.concat(F.lit("POINT ("), key, F.lit(" 1)")), F.concat(F.lit("urn:n"), key))).alias("o")))


@_query("""SELECT '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || n_nationkey || '.0,1.0]},"properties":{"name":"' || n_name || '"}}' AS feature FROM nation WHERE n_nationkey % 2 = 0""")
def map_features(spark, sf_dir):
    at = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("POINT("), F.col("n_nationkey").cast("string"), F.lit(" 1)"))).otherwise("nowhere")
    return sinks.map_features(_rows(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), at.alias("at")))


@_query("SELECT CASE WHEN length(p_name) > 8 THEN substr(p_name, 1, 7) || '…' ELSE p_name END AS p_name, CAST(p_size AS VARCHAR) AS p_size FROM part")
def shortened_cells(spark, sf_dir):
    return sinks.shortened(_rows(spark, sf_dir, "part").select("p_name", "p_size"), 8)


@_query(f"WITH {tabular.sql('nation')} SELECT subject, predicate, object_iri, object_string FROM triples")
def nonempty_columns(spark, sf_dir):
    return sinks.drop_empty_columns(tabular.triples(spark, sf_dir, "nation"))


@_query(f"WITH {tabular.sql('nation')} SELECT DISTINCT n AS node, CASE WHEN n LIKE 'http%' THEN 'iri' ELSE 'literal' END AS kind FROM (SELECT subject AS n FROM triples UNION ALL SELECT otext FROM triples)")
def graph_nodes(spark, sf_dir):
    return sinks.graph_view(tabular.triples(spark, sf_dir, "nation"))[0]


@_query(f"WITH {tabular.sql('nation')} SELECT c AS \"column\", n AS \"values\", (SELECT count(*) FROM triples) - n AS nulls, lo AS smallest, hi AS largest FROM (SELECT 'subject' AS c, count(subject) AS n, min(subject) AS lo, max(subject) AS hi FROM triples UNION ALL SELECT 'predicate', count(predicate), min(predicate), max(predicate) FROM triples UNION ALL SELECT 'object_iri', count(object_iri), min(object_iri), max(object_iri) FROM triples UNION ALL SELECT 'object_string', count(object_string), min(object_string), max(object_string) FROM triples)")
def column_statistics(spark, sf_dir):
    return lookups.column_stats(tabular.triples(spark, sf_dir, "nation").drop("object_float"))


# ---- geometry: boxes with whole corners, for which each relation has a closed form

_BOX = "(n_nationkey * 7) % 10 AS x0, (n_nationkey * 3) % 8 AS y0, (n_nationkey * 7) % 10 + 1 + n_nationkey % 4 AS x1, (n_nationkey * 3) % 8 + 1 + n_nationkey % 3 AS y1"
_PAIRS = f"WITH g AS (SELECT n_nationkey AS k, {_BOX} FROM nation), q AS (SELECT a.k AS a, b.k AS b, a.x0 AS ax0, a.y0 AS ay0, a.x1 AS ax1, a.y1 AS ay1, b.x0 AS bx0, b.y0 AS by0, b.x1 AS bx1, b.y1 AS by1 FROM g a, g b), r AS (SELECT *, ax0 <= bx1 AND bx0 <= ax1 AND ay0 <= by1 AND by0 <= ay1 AS meet, ax0 < bx1 AND bx0 < ax1 AND ay0 < by1 AND by0 < ay1 AS inner_, ax0 >= bx0 AND ax1 <= bx1 AND ay0 >= by0 AND ay1 <= by1 AS inside, bx0 >= ax0 AND bx1 <= ax1 AND by0 >= ay0 AND by1 <= ay1 AS around FROM q) "


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey").cast("long")
    x, y = k * 7 % 10, k * 3 % 8
    return _rows(spark, sf_dir, "nation").select(k.alias("k"), x.alias("x0"), y.alias("y0"), (x + 1 + k % 4).alias("x1"), (y + 1 + k % 3).alias("y1")).withColumn("g", geo.st_makeenvelope(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))


def _box_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _boxes(spark, sf_dir).select("k", "g")
    return g.toDF("a", "x").crossJoin(g.toDF("b", "y"))


@_query(_PAIRS + 'SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, inside AND around AS "sfEquals", NOT meet AS "sfDisjoint", meet AS "sfIntersects", meet AND NOT inner_ AS "sfTouches", false AS "sfCrosses", inside AS "sfWithin", around AS "sfContains", inner_ AND NOT inside AND NOT around AS "sfOverlaps" FROM r')
def geo_box_relations(spark, sf_dir):
    return _box_pairs(spark, sf_dir).select("a", "b", *[geo.relation(n, F.col("x"), F.col("y")).alias(n) for n in geo.RELATIONS])


@_query(f"WITH g AS (SELECT n_nationkey AS k, {_BOX} FROM nation), q AS (SELECT a.*, b.k AS i, b.x0 + 0.5 AS px, b.y0 AS py FROM g a, g b), r AS (SELECT *, px BETWEEN x0 AND x1 AND py BETWEEN y0 AND y1 AS meet, px > x0 AND px < x1 AND py > y0 AND py < y1 AS inner_ FROM q) SELECT CAST(i AS BIGINT) AS p, CAST(k AS BIGINT) AS b, meet AS \"sfIntersects\", NOT meet AS \"sfDisjoint\", meet AND NOT inner_ AS \"sfTouches\", inner_ AS \"sfWithin\", sqrt(pow(greatest(x0 - px, px - x1, 0), 2) + pow(greatest(y0 - py, py - y1, 0), 2)) AS away FROM r")
def geo_point_relations(spark, sf_dir):
    g = _boxes(spark, sf_dir)
    points = g.select(F.col("k").alias("p"), geo.st_point(F.col("x0") + 0.5, F.col("y0")).alias("x"))
    pairs = points.crossJoin(g.select(F.col("k").alias("b"), F.col("g").alias("y")))
    return pairs.select("p", "b", *[geo.relation(n, F.col("x"), F.col("y")).alias(n) for n in ("sfIntersects", "sfDisjoint", "sfTouches", "sfWithin")], geo.planar_distance(F.col("x"), F.col("y")).alias("away"))


@_query(f"WITH g AS (SELECT n_nationkey AS k, {_BOX} FROM nation) SELECT CAST(a.k AS BIGINT) AS a, CAST(b.k AS BIGINT) AS b, b.y0 > a.y0 AND b.y0 < a.y1 AND a.x0 > b.x0 - 20 AS crosses FROM g a, g b")
def geo_lines_cross_boxes(spark, sf_dir):
    """A level line far across both sides crosses a box that it goes through the inside of."""
    g = _boxes(spark, sf_dir)
    line = geo.st_geomfromtext(F.format_string("LINESTRING(-100 %d, 100 %d)", "y0", "y0"))
    pairs = g.select(F.col("k").alias("a"), F.col("g").alias("y")).crossJoin(g.select(F.col("k").alias("b"), line.alias("x")))
    return pairs.select("a", "b", geo.relation("sfCrosses", F.col("x"), F.col("y")).alias("crosses"))


@_query(_PAIRS + "SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, CAST(greatest(ax0, bx0) AS DOUBLE) AS ix0, CAST(greatest(ay0, by0) AS DOUBLE) AS iy0, CAST(least(ax1, bx1) AS DOUBLE) AS ix1, CAST(least(ay1, by1) AS DOUBLE) AS iy1, CAST(least(ax0, bx0) AS DOUBLE) AS ux0, CAST(greatest(ay1, by1) AS DOUBLE) AS uy1, inside AS gone, inside AND around AS same, true AS parted FROM r WHERE inner_")
def geo_box_overlays(spark, sf_dir):
    """Set operations of boxes whose insides meet: what is common is a box, the union spans both, and the difference is off the other box's inside."""
    pairs = _box_pairs(spark, sf_dir)
    meet = pairs.filter(geo.relation("sfIntersects", F.col("x"), F.col("y")) & ~geo.relation("sfTouches", F.col("x"), F.col("y")))
    made = meet.select("a", "b", "y", *[geo.combine(n, F.col("x"), F.col("y")).alias(n) for n in geo.SET_OPERATIONS])
    b = made.select("*", geo.bounds(F.col("intersection")).alias("i"), geo.bounds(F.col("union")).alias("u"), geo.bounds(F.col("difference")).alias("d"), geo.bounds(F.col("symDifference")).alias("s"))
    parted = F.col("d.xmin").isNull() | ~geo.relation("sfIntersects", F.col("difference"), F.col("y")) | geo.relation("sfTouches", F.col("difference"), F.col("y"))
    return b.select("a", "b", F.col("i.xmin").alias("ix0"), F.col("i.ymin").alias("iy0"), F.col("i.xmax").alias("ix1"), F.col("i.ymax").alias("iy1"), F.col("u.xmin").alias("ux0"), F.col("u.ymax").alias("uy1"), F.col("d.xmin").isNull().alias("gone"), F.col("s.xmin").isNull().alias("same"), parted.alias("parted"))


@_query(f"SELECT CAST(n_nationkey AS BIGINT) AS k, true AS envelope, true AS hull, 'MULTIPOINT' AS ends, CAST(x0 AS DOUBLE) AS bx0, CAST(y1 AS DOUBLE) AS by1 FROM (SELECT n_nationkey, {_BOX} FROM nation)")
def geo_box_constructors(spark, sf_dir):
    """Of a box: the envelope of its diagonal and the hull of its corners and middle are the box, and the diagonal's boundary are two points."""
    g = _boxes(spark, sf_dir)
    line = geo.st_geomfromtext(F.format_string("LINESTRING(%d %d, %d %d)", "x0", "y0", "x1", "y1"))
    dots = geo.st_geomfromtext(F.format_string("MULTIPOINT((%d %d), (%d %d), (%d %d), (%d %d), (%s %s))", "x0", "y0", "x1", "y1", "x0", "y1", "x1", "y0", (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2))
    made = g.select("k", "g", geo.construct("envelope", line).alias("e"), geo.construct("convexHull", dots).alias("h"), geo.construct("boundary", line).alias("d"))
    box = geo.bounds(F.col("d"))
    return made.select("k", geo.relation("sfEquals", F.col("e"), F.col("g")).alias("envelope"), geo.relation("sfEquals", F.col("h"), F.col("g")).alias("hull"), geo.st_geometrytype(F.col("d")).alias("ends"), box["xmin"].alias("bx0"), box["ymax"].alias("by1"))


@_query("SELECT CAST(s_suppkey AS BIGINT) AS k, 'POINT (' || CAST(s_suppkey AS VARCHAR) || ' ' || CAST(s_nationkey AS VARCHAR) || ')' AS text, '0101000000' AS head FROM supplier")
def wkt_to_wkb(spark, sf_dir):
    """Little-endian WKB of WKT texts with a reference system."""
    s = _rows(spark, sf_dir, "supplier")
    wkb = terms.split_terms(s.select(F.lit("iri").alias("s_kind"), F.col("s_suppkey").cast("string").alias("s"), F.lit("p").alias("p"), F.lit("literal").alias("o_kind"), F.format_string("<http://www.opengis.net/def/crs/OGC/1.3/CRS84> POINT(%d %d)", "s_suppkey", "s_nationkey").alias("o"), F.lit(S.WKT_LITERAL).alias("o_datatype"), F.lit(None).cast("string").alias("o_lang")))
    return wkb.select(F.col("subject").cast("long").alias("k"), geo.st_astext(F.col("object_geometry")).alias("text"), F.substring(F.hex("object_geometry"), 1, 10).alias("head"))


_POINTS = f"WITH {tabular.sql('supplier', 'customer', points=True)} SELECT a.subject AS a, b.subject AS b FROM triples a JOIN triples b ON "
_FIND = "SELECT ?a ?b WHERE { ?a p:s_name ?n ; p:at ?g . ?b p:c_name ?m ; p:at ?h FILTER(%s) }"


@_query(_POINTS + "a.lon = b.lon AND a.lat = b.lat WHERE a.subject LIKE '%/supplier/%' AND b.subject LIKE '%/customer/%'")
def geo_filter_join(spark, sf_dir):
    return sparql.run(PREFIX + _FIND % "geof:sfEquals(?g, ?h)", tabular.triples(spark, sf_dir, "supplier", "customer", points=True))


@_query(_POINTS + "sqrt(pow(a.lon - b.lon, 2) + pow(a.lat - b.lat, 2)) < 1.5 WHERE a.subject LIKE '%/supplier/%' AND b.subject LIKE '%/customer/%'")
def geo_filter_distance_join(spark, sf_dir):
    return sparql.run(PREFIX + _FIND % "geof:distance(?g, ?h, uom:degree) < 1.5", tabular.triples(spark, sf_dir, "supplier", "customer", points=True))


@_query(f"WITH {tabular.sql('supplier', points=True)} SELECT subject FROM triples WHERE lat = -68.0 AND lon BETWEEN -180 AND 180")
def geo_line_page(spark, sf_dir):
    """A page whose box is a line."""
    return lookups.geometries(tabular.triples(spark, sf_dir, "supplier", points=True), "-180,-68,180,-68").select("subject")


def ready() -> list[str]:
    """Names of the queries without an oracle."""
    return sorted(set(QUERIES) - set(ORACLES))


assert not ready(), json.dumps(ready())
