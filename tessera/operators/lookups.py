"""Ready-made lookups and statistics on a triples frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import schema as S
from tessera.functions import geo, terms
from tessera.schema import TesseraError


def _with(triples: DataFrame, predicate: str) -> DataFrame:
    out = triples.filter(F.col("predicate") == predicate)
    return out.filter(F.col(S.PARTITION) == predicate[: S.PARTITION_CHARS]) if S.PARTITION in triples.columns else out


def _types(triples: DataFrame, name: str) -> DataFrame:
    return _with(triples, S.RDF_TYPE).select("subject", terms.object_text().alias(name))


def _text(triples: DataFrame, predicate: str, name: str) -> DataFrame:
    return _with(triples, predicate).select("subject", terms.object_text().alias(name))


def classes(triples: DataFrame) -> DataFrame:
    """Classes by their number of distinct instances."""
    out = _types(triples, "class").groupBy("class").agg(F.count_distinct("subject").alias("instances"))
    return out.orderBy(F.desc("instances"), "class")


def datatypes(triples: DataFrame) -> DataFrame:
    rows = _types(triples, "t").filter(F.col("t") == S.RDFS + "Datatype").select("subject").distinct()
    for predicate, name in ((S.RDFS + "label", "label"), (S.RDFS + "comment", "comment")):
        rows = rows.join(_text(triples, predicate, name).groupBy("subject").agg(F.min(name).alias(name)), "subject", "left")
    return rows.withColumnRenamed("subject", "datatype").orderBy("datatype")


def instances(triples: DataFrame) -> DataFrame:
    """Instances and classes, without what belongs to the vocabulary itself."""
    typed = _types(triples, "class")
    vocabulary = typed.filter(F.col("class").isin(*S.VOCABULARY_CLASSES)).select("subject").distinct()
    return typed.join(vocabulary, "subject", "left_anti").select(F.col("subject").alias("instance"), "class").distinct().orderBy("instance", "class")


def properties(triples: DataFrame) -> DataFrame:
    typed = _types(triples, "type").filter(F.col("type").isin(*S.PROPERTY_CLASSES))
    return typed.select(F.col("subject").alias("property"), "type").distinct().orderBy("property", "type")


def shapes(triples: DataFrame) -> DataFrame:
    """Shapes with label and comment; one row for each target class, null where there is none."""
    rows = _types(triples, "rdf:type").filter(F.col("`rdf:type`").isin(*S.SHAPE_CLASSES)).distinct()
    for predicate, name in ((S.RDFS + "label", "rdfs:label"), (S.RDFS + "comment", "rdfs:comment")):
        rows = rows.join(_text(triples, predicate, name).groupBy("subject").agg(F.min(f"`{name}`").alias(name)), "subject", "left")
    rows = rows.join(_text(triples, S.SH + "targetClass", "sh:targetClass").distinct(), "subject", "left")
    return rows.select(F.col("subject").alias("shape"), "`rdfs:label`", "`rdfs:comment`", "`rdf:type`", "`sh:targetClass`").orderBy("shape", F.col("`rdf:type`").asc_nulls_last(), F.col("`sh:targetClass`").asc_nulls_last())


def describe(triples: DataFrame, subject: str) -> DataFrame:
    return triples.filter(F.col("subject") == subject).select("predicate", terms.object_text().alias("object")).orderBy("predicate", F.col("object").asc_nulls_last())


# Schemes whose IRIs have no authority.
BARE_SCHEMES = ("urn", "mailto", "tel", "data", "doi", "tag", "did", "info", "news", "geo")


def resolve_subject(subject: str, base: str) -> str:
    """A subject as a user writes it: <iri>, a blank node, an absolute IRI, or a name relative to the base."""
    if subject.startswith("<") and subject.endswith(">"):
        return subject[1:-1]
    if subject.startswith("_:") or "://" in subject or subject.split(":", 1)[0].lower() in BARE_SCHEMES and ":" in subject:
        return subject
    return base + subject


def counts(triples: DataFrame) -> DataFrame:
    """Triples and distinct subjects, predicates and objects; geometries are not counted as objects."""
    return triples.agg(F.count("*").alias("triples"), F.count_distinct("subject").alias("subjects"), F.count_distinct("predicate").alias("predicates"), F.count_distinct(terms.object_text()).alias("objects"))


def by_predicate(triples: DataFrame) -> DataFrame:
    return triples.groupBy("predicate").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "predicate")


def busiest_subjects(triples: DataFrame, k: int = 50) -> DataFrame:
    return triples.groupBy("subject").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "subject").limit(k)


def head(triples: DataFrame, n: int = 20) -> DataFrame:
    return triples.limit(n)


def column_stats(triples: DataFrame) -> DataFrame:
    """(column, values, nulls, smallest, largest) of every column but the geometry's bytes, in one pass."""
    names = [c for c in triples.columns if c != "object_geometry"]
    one = triples.agg(*[F.struct(F.lit(c).alias("column"), F.count(c).alias("values"), F.count_if(F.col(c).isNull()).alias("nulls"), F.min(c).cast("string").alias("smallest"), F.max(c).cast("string").alias("largest")).alias(c) for c in names])
    return one.select(F.inline(F.array(*names)))


def geometries(triples: DataFrame, bbox: str | None = None, limit: int = 1000, offset: int = 0) -> DataFrame:
    """(subject, predicate, geometry GeoJSON) of a page of geometries, in the order of subject and predicate."""
    limit = min(limit, 1000) if limit > 0 else 1000
    rows = triples.filter(F.col("object_geometry").isNotNull()).select("subject", "predicate", "object_geometry")
    if bbox:
        x0, y0, x1, y1 = geo.parse_bbox(bbox)
        rows = rows.withColumn("b", geo.bounds(F.col("object_geometry"))).filter((F.col("b.xmin") <= x1) & (F.col("b.xmax") >= x0) & (F.col("b.ymin") <= y1) & (F.col("b.ymax") >= y0))
        if x0 < x1 and y0 < y1:
            page = ("POLYGON", [[(x0, y0), (x0, y1), (x1, y1), (x1, y0), (x0, y0)]])
        else:
            page = ("POINT", (x0, y0)) if x0 == x1 and y0 == y1 else ("LINESTRING", [(x0, y0), (x1, y1)])
        rows = rows.filter(geo.relation("sfIntersects", F.col("object_geometry"), F.lit(geo.to_wkb(page))))
    page = rows.orderBy("subject", "predicate").offset(max(0, offset)).limit(limit)
    return page.select("subject", "predicate", geo.st_asgeojson(F.col("object_geometry")).alias("geometry"))


def extent(triples: DataFrame) -> DataFrame:
    b = triples.filter(F.col("object_geometry").isNotNull()).select(geo.bounds(F.col("object_geometry")).alias("b"))
    return b.agg(F.min("b.xmin").alias("xmin"), F.min("b.ymin").alias("ymin"), F.max("b.xmax").alias("xmax"), F.max("b.ymax").alias("ymax"), F.count("*").alias("count"))


def snapshot_diff(old: DataFrame, new: DataFrame, ordered: bool = True) -> DataFrame:
    """Added and removed triples by hash, in the order of change and hash if asked; each side is shuffled once."""
    cols = [c for c in S.COLUMNS if c in new.columns]
    a, b = (df.select(F.col("triple_hash").alias(f"{p}h"), F.struct(cols).alias(p)) for df, p in ((old, "o"), (new, "n")))
    found = a.join(b, F.col("oh") == F.col("nh"), "full_outer").filter(F.col("oh").isNull() | F.col("nh").isNull())
    out = found.select(F.when(F.col("oh").isNull(), "added").otherwise("removed").alias("change_type"), F.coalesce("n", "o").alias("t")).select("change_type", *[F.col(f"t.{c}").alias(c) for c in cols])
    return out.orderBy("change_type", "triple_hash") if ordered else out


def stacked_imports(views: dict[str, DataFrame]) -> DataFrame:
    """All imported tables with a leading label; columns that a table lacks are null."""
    out = None
    for name, df in views.items():
        one = df.select(F.lit(name).alias("view"), "*")
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise TesseraError("there are no imports")
    return out


def view_names(tables: list[tuple[str, str]]) -> list[str]:
    """View names of (artifact, table path): the artifact's, qualified if it has several tables, numbered if taken."""
    import re

    clean = lambda v: re.sub(r"[^a-z0-9_]+", "_", v.lower()).strip("_") or "import"
    many = {a for a, _ in tables if sum(b == a for b, _ in tables) > 1}
    taken, out = {"triples", "imports"}, []
    for a, path in tables:
        name = base = clean(f"{a}_{path}" if a in many else a)
        n = 2
        while name in taken:
            name, n = f"{base}_{n}", n + 1
        taken.add(name)
        out.append(name)
    return out


def ontologies(pins: DataFrame, imports: DataFrame) -> DataFrame:
    """Pinned and imported ontologies, sorted: (ontology, version, format, imported)."""
    both = pins.join(imports.select(F.col("ontology"), F.lit("yes").alias("imported")).distinct(), "ontology", "full_outer")
    return both.select("ontology", F.coalesce("version", F.lit("")).alias("version"), F.coalesce("format", F.lit("")).alias("format"), F.coalesce("imported", F.lit("no")).alias("imported")).orderBy("ontology")


def snapshot_listing(snapshots: DataFrame, tags: DataFrame) -> DataFrame:
    """Snapshots, newest first, with their tags joined in order."""
    joined = tags.groupBy("snapshot_id").agg(F.expr("listagg(tag, ', ') WITHIN GROUP (ORDER BY tag)").alias("tags"))
    return snapshots.join(joined, "snapshot_id", "left").withColumn("tags", F.coalesce("tags", F.lit(""))).orderBy(F.desc("sequence_number"))


def explode_properties(rows: DataFrame, column: str) -> DataFrame:
    """Key and value of a JSON object's entries."""
    return rows.select(F.explode(F.from_json(F.col(column), "map<string,string>")).alias("key", "value")).orderBy("key")
