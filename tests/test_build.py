"""Store, builds, pins and copies: writers at the same time, failures in the middle, moved lines."""

import pytest

from tessera import schema as S
from tessera.engine import Engine
from tessera.functions import terms
from tessera.operators import build, lookups, publish
from tessera.operators.store import Store, find_tables, parse_ids
from tessera.schema import TesseraError
from tessera.sources import linked, rdf
from tessera.streaming import ingest

TTL = "@prefix e: <http://e.org/> .\ne:a e:at [ e:x 1 ; e:y 2 ] ; e:name \"A\" .\ne:b e:at [ e:x 3 ] ; e:near e:a .\n"


@pytest.fixture
def source(tmp_path):
    folder = tmp_path / "src"
    folder.mkdir()
    (folder / "a.ttl").write_text(TTL)
    return folder


def test_a_rebuild_of_moved_lines_changes_nothing(spark, source, tmp_path):
    table = str(tmp_path / "t")
    one = build.build(spark, str(source), table, tag="c1")
    (source / "a.ttl").unlink()
    lines = TTL.splitlines()
    (source / "z.ttl").write_text("\n# moved\n".join([lines[0], lines[2], lines[1]]) + "\n")
    two = build.build(spark, str(source), table, tag="c2")
    assert two["snapshot_id"] == one["snapshot_id"] and one["added"] == 7 and len(Store(spark, table).log()) == 1
    assert not Store(spark, table).is_stale("c2")


def test_of_two_writers_one_is_told(spark, source, tmp_path):
    store = Store(spark, str(tmp_path / "t"))
    t = terms.split_terms(rdf.read_turtle(spark, str(source)))
    store.write(t)
    late = Store(spark, store.path)
    log = late.log()
    store.write(t.filter("subject = 'http://e.org/a'"))
    late.log = lambda: log  # it has not seen the other's commit
    with pytest.raises(TesseraError, match="another writer"):
        late._commit(t.limit(1), None, None, None)
    late._names = lambda folder, suffix: Store(spark, store.path)._names(folder, suffix)[:1]
    with pytest.raises(TesseraError, match="another writer"):
        late._set_refs({"main": 1})
    assert len(store.log()) == 2 and store.as_of().count() == 2


def test_a_failed_squash_changes_nothing(spark, source, tmp_path):
    store = Store(spark, str(tmp_path / "t"))
    t = terms.split_terms(rdf.read_turtle(spark, str(source)))
    ids = [store.write(x, None, tag)["snapshot_id"] for x, tag in ((t.filter("subject = 'http://e.org/a'"), "v1"), (t, "v2"), (t.filter("subject = 'http://e.org/b'"), "v3"))]
    before, refs = store.as_of().count(), store.refs()

    def fail(name, text):
        raise OSError("disk is full")

    broken = Store(spark, store.path)
    broken._create = fail
    with pytest.raises(OSError):
        broken.squash(ids[1:])
    assert store.refs() == refs and store.as_of().count() == before
    done = store.squash(ids)  # the first one too
    assert [r["tags"] for r in store.snapshots().collect()] == ["main, v1, v2, v3"] and store.current()["snapshot_id"] == done["snapshot_id"]
    assert store.as_of().count() == before and store.diff("latest").count() == before
    again = store.write(t)
    assert store.as_of().count() == t.count() and again["parent"] == done["snapshot_id"]


def test_any_snapshot_can_be_deleted_but_not_all(spark, source, tmp_path):
    store = Store(spark, str(tmp_path / "t"))
    t = terms.split_terms(rdf.read_turtle(spark, str(source)))
    ids = [store.write(x)["snapshot_id"] for x in (t.filter("subject = 'http://e.org/a'"), t)]
    store.delete_snapshots(ids[:1])
    assert store.as_of().count() == t.count() and store.snapshots().count() == 1
    for bad in (ids[:1], ids[1:]):
        with pytest.raises(TesseraError):
            store.delete_snapshots(bad)
    with pytest.raises(TesseraError):
        store.as_of(ids[0])
    assert parse_ids(["3,1", "3", " 2 "]) == [3, 1, 2]
    with pytest.raises(TesseraError):
        parse_ids(["x"])


def test_copies_follow_and_are_never_overwritten(spark, source, tmp_path):
    a, b = Store(spark, str(tmp_path / "x" / "a")), str(tmp_path / "y" / "b")
    t = terms.split_terms(rdf.read_turtle(spark, str(source)))
    a.write(t.filter("subject = 'http://e.org/a'"))
    assert publish.copy_table(spark, a.path, b) > 0 and Store(spark, b).as_of().count() == 2
    a.write(t)
    assert publish.copy_table(spark, a.path, b) > 0 and Store(spark, b).as_of().count() == t.count() and publish.copy_table(spark, a.path, b) == 0
    Store(spark, b).write(t.limit(1))
    with pytest.raises(TesseraError, match="nothing was copied"):
        publish.copy_table(spark, a.path, b)
    assert [p.rsplit("/", 1)[1] for p in find_tables(spark, str(tmp_path))] == ["a", "b"] and find_tables(spark, str(tmp_path / "none")) == []


def test_files_grow_with_rows_and_unchanged_builds_leave_none(spark, tmp_path, monkeypatch):
    from tessera.operators import store as module

    monkeypatch.setattr(module, "FILE_ROWS", 100)
    t = spark.range(1000).selectExpr("concat('urn:s', id) as subject", "concat('http://example.org/p', id % 3) as predicate", "cast(null as string) as object_iri", "cast(id as double) as object_float", "cast(null as string) as object_string", "cast(null as binary) as object_geometry", "sha2(cast(id as string), 256) as triple_hash")
    store = Store(spark, str(tmp_path / "t"))
    store.write(t)
    store.write(t)
    files = list((tmp_path / "t" / "data").rglob("*.parquet"))
    assert 8 <= len(files) <= 24 and len(list((tmp_path / "t" / "data").iterdir())) == 1


def test_streamed_rows_of_one_hash_stay_apart(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"))
    rows = [("iri", "urn:s", "urn:p", "iri", "urn:x", None, None), ("iri", "urn:s", "urn:p", "literal", "urn:x", None, None), ("iri", "urn:s", "urn:p", "iri", "urn:x", None, None)]
    ingest.append_batch(store, spark.createDataFrame(rows, S.TERMS))
    assert store.as_of().count() == 2


def test_pins_are_kept_by_content(spark, tmp_path):
    asked = []

    def fetch(address):
        asked.append(address)
        if "gone" in address:
            raise OSError("no route")
        return b"<urn:a> <urn:b> <urn:c> .", "text/turtle"

    pins = build.Pins(str(tmp_path / "pins"), fetch, {"http://gone/": (b"<urn:g> <urn:b> 1 .", "text/turtle")})
    assert pins.terms(spark, "http://v/").count() == 1 and pins.terms(spark, "http://v/").count() == 1 and asked == ["http://v/"]
    assert pins.terms(spark, "http://gone/").first()["s"] == "urn:g"
    with pytest.raises(TesseraError):
        pins.get("http://gone/other")
    again = build.Pins(str(tmp_path / "pins"), fetch)
    digest = again.entries["http://v/"]["sha256"]
    (tmp_path / "pins" / digest).write_bytes(b"damaged")
    assert again.get("http://v/")[0].startswith(b"<urn:a>")
    (tmp_path / "pins" / digest).unlink()
    again.fetch = lambda a: (b"<urn:other> <urn:b> <urn:c> .", "text/turtle")
    with pytest.raises(TesseraError, match="has changed"):
        again.get("http://v/")
    assert again.listing(spark).count() == 2


def test_a_build_reports_all_violations(spark, source, tmp_path):
    (source / "b.jsonld").write_text('{"@id": "local",\n "zz:name": "x"}')
    known = spark.createDataFrame([("http://e.org/at",)], "iri string")
    with pytest.raises(build.Invalid) as e:
        build.build(spark, str(source), str(tmp_path / "t"), vocabulary=known, namespaces={"e": "http://e.org/"})
    text = str(e.value)
    assert "undefined term e:name" in text and "undefined term e:x" in text and "e:at" not in text and "undefined prefix zz" in text and "has no type" in text
    with pytest.raises(S.NothingBuilt):
        Store(spark, str(tmp_path / "t")).as_of()


def test_fingerprints_and_engine_extras(spark, source, tmp_path):
    (source / "b.ttl").write_text("")
    files = [str(source / "b.ttl"), str(source / "a.ttl")]
    assert build.fingerprint(files) == build.fingerprint(files[::-1]) != build.fingerprint(files[1:] * 2)
    build.build(spark, str(source), str(tmp_path / "t"))
    engine = Engine(spark, str(tmp_path / "t"))
    assert "FROM triples t0" in engine.translated("SELECT ?s WHERE { ?s <http://e.org/name> ?n }") and "Scan parquet" in engine.explained("SELECT ?s WHERE { ?s ?p ?o }")
    assert set(engine.register_imports([("x", str(tmp_path / "none"))])) == set() and engine.register_imports([("x", str(tmp_path / "none"))]) == [] and len(engine.warnings) == 1
    assert engine.modules() == [] and len(engine.sample_queries()) >= 12
    assert lookups.resolve_subject("tel:12", "b/") == "tel:12" and lookups.resolve_subject("name", "b/") == "b/name"


def test_boxes_of_all_sizes_join(spark):
    from tessera.functions import geo

    rows = [(0, "POLYGON((-180 -90, 180 -90, 180 90, -180 90, -180 -90))"), (1, "POINT(1 1)"), (2, "POINT(1 1)"), (3, "POLYGON((0 0, 0.001 0, 0.001 0.001, 0 0.001, 0 0))"), (4, "POLYGON((-1 -1, 50 -1, 50 2, -1 2, -1 -1))"), (5, "POLYGON((100 10, 101 10, 101 11, 100 11, 100 10))"), (6, None), (7, "POINT EMPTY")]
    g = spark.createDataFrame([(i, geo.to_wkb(geo.parse_wkt(w)) if w and "EMPTY" not in w else None) for i, w in rows], "i int, g binary")
    got = sorted((r["a"], r["b"]) for r in geo.spatial_join(g.toDF("a", "x"), g.toDF("b", "y"), "x", "y", "sfIntersects").select("a", "b").collect())
    parsed = {i: geo.parse_wkt(w) for i, w in rows if w and "EMPTY" not in w}
    assert got == sorted((i, j) for i, x in parsed.items() for j, y in parsed.items() if geo.intersects(x, y))


def test_spatial_filters_of_two_patterns_make_no_nested_loop(spark):
    from tessera.plans import sparql
    from tessera.sources import tabular

    t = tabular.triples(spark, "/root/testdata/sf0.001", "supplier", points=True)
    text = f"PREFIX p: <{tabular.P}> PREFIX geof: <{S.GEOF}> SELECT ?a ?b WHERE {{ ?a p:at ?g . ?b p:at ?h FILTER(geof:sfIntersects(?g, ?h) && ?a != ?b) }}"
    plan = sparql.run(text, t)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_jsonld_problems_know_contexts():
    ok = '{"@context": ["http://remote/", {"a": "urn:a:"}], "@id": "x", "@type": "q:T", "z:name": 1}'
    assert linked.problems(ok) == []
    bad = '{"@context": {"a": "urn:a:"}, "@graph": [{"@id": "x", "a:n": {"@id": "_:b", "b:m": 2}}, {"@id": "only"}]}'
    assert [(t, m) for _, t, m in linked.problems(bad)] == [("x", "a local node has no type"), ("b:m", "undefined prefix b"), ("_:b", "a local node has no type")] and linked.problems("") == []
