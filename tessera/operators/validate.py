"""Checks on terms and classes, transitive closures, and stable blank-node names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import schema as S
from tessera.shared import cut


#: What names of blank nodes begin with, before the digest of what they are linked to.
BLANK = "_:b"

# The datatypes of XML Schema that need no definition.
XSD_TYPES = (
    "anyAtomicType", "anySimpleType", "anyURI", "base64Binary", "boolean", "byte", "date", "dateTime", "dateTimeStamp", "dayTimeDuration", "decimal", "double", "duration", "ENTITIES", "ENTITY", "float",
    "gDay", "gMonth", "gMonthDay", "gYear", "gYearMonth", "hexBinary", "ID", "IDREF", "IDREFS", "int", "integer", "language", "long", "Name", "NCName", "negativeInteger", "NMTOKEN", "NMTOKENS", "nonNegativeInteger",
    "nonPositiveInteger", "normalizedString", "NOTATION", "positiveInteger", "QName", "short", "string", "time", "token", "unsignedByte", "unsignedInt", "unsignedLong", "unsignedShort", "untypedAtomic", "yearMonthDuration",
)


def closure(edges: DataFrame) -> DataFrame:
    """All pairs (child, ancestor) of a relation (child, parent); cycles are fine. Only the pairs of the last round are joined again, with all that are known: paths double each round."""
    known = cut(edges.select(F.col("child"), F.col("parent").alias("ancestor")).distinct())
    fresh = known
    while True:
        step = lambda a, b: a.toDF("child", "_mid").join(b.toDF("_mid", "ancestor"), "_mid").select("child", "ancestor")
        longer = step(fresh, known).union(step(known, fresh)).distinct()
        old = known.toDF("_child", "_ancestor")
        fresh = cut(longer.join(old, (F.col("child") == F.col("_child")) & (F.col("ancestor") == F.col("_ancestor")), "left_anti"))
        if fresh.isEmpty():
            return known
        known = cut(known.union(fresh))


def subclass_closure(triples: DataFrame) -> DataFrame:
    edges = triples.filter((F.col("predicate") == S.RDFS + "subClassOf") & F.col("object_iri").isNotNull())
    return closure(edges.select(F.col("subject").alias("child"), F.col("object_iri").alias("parent")))


def untyped_subjects(triples: DataFrame, base: str) -> DataFrame:
    """Local subjects without a type."""
    local = triples.filter(F.col("subject").startswith(base)).select("subject").distinct()
    return local.join(triples.filter(F.col("predicate") == S.RDF_TYPE).select("subject"), "subject", "left_anti")


def types_without_class(triples: DataFrame, base: str) -> DataFrame:
    """Local types that do not reach rdfs:Class or owl:Class, by type or over subClassOf."""
    used = triples.filter((F.col("predicate") == S.RDF_TYPE) & F.col("object_iri").startswith(base)).select(F.col("object_iri").alias("type")).distinct()
    classes = (S.RDFS + "Class", S.OWL + "Class")
    direct = triples.filter((F.col("predicate") == S.RDF_TYPE) & F.col("object_iri").isin(*classes)).select(F.col("subject").alias("type"))
    over = subclass_closure(triples).filter(F.col("ancestor").isin(*classes)).select(F.col("child").alias("type"))
    return used.join(direct.union(over).distinct(), "type", "left_anti")


def vocabulary_terms(terms: DataFrame) -> DataFrame:
    """Distinct IRIs of a terms frame: subjects, predicates, objects and datatypes."""
    pick = lambda c, cond: terms.filter(cond).select(F.col(c).alias("iri"))
    some = pick("s", F.col("s_kind") == "iri").union(pick("p", F.lit(True))).union(pick("o", F.col("o_kind") == "iri")).union(pick("o_datatype", F.col("o_datatype").isNotNull()))
    return some.distinct()


def undefined_terms(used: DataFrame, vocabulary: DataFrame, namespaces: dict[str, str], base: str = "", replacements: dict[str, str] | None = None) -> DataFrame:
    """(path, line, term, message): used terms (path, line, iri) of known namespaces that no vocabulary defines.

    A term belongs to the longest namespace that it starts with; terms of the base
    or of no known namespace are fine. XML Schema's are checked against its built-in
    types. A replacement names the namespace under which a vocabulary defines another's terms.
    """
    best, looked_up = F.lit(None).cast("string"), F.col("iri")
    for prefix, iri in sorted({**namespaces, **({"xsd": S.XSD} if S.XSD not in namespaces.values() else {})}.items(), key=lambda kv: len(kv[1])):
        rest = F.substring(F.col("iri"), len(iri) + 1, 1 << 20)
        mine = F.col("iri").startswith(iri)
        best = F.when(mine, F.concat(F.lit(f"{prefix}:"), rest)).otherwise(best)
        if iri in (replacements or {}):
            looked_up = F.when(mine, F.concat(F.lit(replacements[iri]), rest)).otherwise(looked_up)
    named = used.withColumn("term", best).filter(F.col("term").isNotNull())
    named = named.filter(~F.col("iri").startswith(base)) if base else named
    named = named.filter(~F.col("iri").isin([S.XSD + t for t in XSD_TYPES])).withColumn("_asked", looked_up)
    missing = named.join(vocabulary.select(F.col("iri").alias("_asked")).distinct(), "_asked", "left_anti")
    return missing.select("path", "line", "term", F.concat_ws("", "path", F.lit(":"), F.col("line").cast("string"), F.lit(": undefined term "), "term").alias("message")).orderBy("path", "line", "term")


def stable_blank_nodes(terms: DataFrame, prefix: str = BLANK) -> DataFrame:
    """Terms whose blank nodes are named by what they are linked to, the same for any labels.

    Signatures are refined from both sides until the number of classes stands
    still: one join and one aggregation a round, over the terms with a blank node.
    Equal signatures are numbered in the order of the original labels.
    """
    linked_terms = cut(terms.filter("s_kind = 'bnode' or o_kind = 'bnode'"))
    nodes = linked_terms.filter("s_kind = 'bnode'").select(F.col("s").alias("b")).union(linked_terms.filter("o_kind = 'bnode'").select(F.col("o").alias("b"))).distinct()
    sig = cut(nodes.select("b", F.lit("blank").alias("sig")))
    classes = -1
    while True:
        s_sig, o_sig = sig.toDF("s_b", "s_sig"), sig.toDF("o_b", "o_sig")
        linked = linked_terms.join(s_sig, (F.col("s_kind") == "bnode") & (F.col("s") == F.col("s_b")), "left").join(o_sig, (F.col("o_kind") == "bnode") & (F.col("o") == F.col("o_b")), "left")
        subject, obj = F.coalesce("s_sig", "s"), F.coalesce("o_sig", F.concat_ws("|", "o_kind", "o", F.coalesce("o_datatype", F.lit("")), F.coalesce("o_lang", F.lit(""))))
        out = linked.filter("s_kind = 'bnode'").select(F.col("s").alias("b"), F.concat_ws("|", F.lit("out"), "p", obj).alias("line"))
        into = linked.filter("o_kind = 'bnode'").select(F.col("o").alias("b"), F.concat_ws("|", F.lit("in"), "p", subject).alias("line"))
        # multisets of line hashes: sums need no list of a node's lines
        line = F.sha2("line", 256)
        digest = lambda at: F.sum(F.conv(F.substring(line, at, 12), 16, 10).cast("decimal(38,0)"))
        new = out.union(into).groupBy("b").agg(F.concat_ws(":", F.count("*"), digest(1), digest(13), digest(25)).alias("n"))
        sig = cut(sig.join(new, "b").select("b", F.sha2(F.concat_ws("#", "sig", "n"), 256).alias("sig")))
        now = sig.select("sig").distinct().count()
        if now == classes:
            break
        classes = now
    ranked = sig.selectExpr("b", "sig", "row_number() over (partition by sig order by b) as k", "count(*) over (partition by sig) as n")
    named = ranked.select("b", F.concat(F.lit(prefix), F.substring("sig", 1, 24), F.when(F.col("n") > 1, F.format_string("_%04d", F.col("k"))).otherwise("")).alias("name"))
    s_name, o_name = named.toDF("s_b", "s_name"), named.toDF("o_b", "o_name")
    done = terms.join(s_name, (F.col("s_kind") == "bnode") & (F.col("s") == F.col("s_b")), "left").join(o_name, (F.col("o_kind") == "bnode") & (F.col("o") == F.col("o_b")), "left")
    return done.withColumn("s", F.coalesce("s_name", "s")).withColumn("o", F.coalesce("o_name", "o")).select(S.TERMS.fieldNames())
