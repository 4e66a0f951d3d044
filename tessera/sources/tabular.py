"""Star-schema tables as triples: one mapping for Spark plans and for the SQL that checks them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schema as S
from tessera.functions import geo, terms

BASE = "https://example.org/"
P = BASE + "p/"
C = BASE + "c/"

#: table: (class, key expression, columns: name -> kind); kinds: number, text, time, or the table that a key points to
TABLES = {
    "region": ("Region", "r_regionkey", {"r_name": "text"}),
    "nation": ("Nation", "n_nationkey", {"n_name": "text", "n_regionkey": "region"}),
    "customer": ("Customer", "c_custkey", {"c_name": "text", "c_nationkey": "nation", "c_acctbal": "number", "c_mktsegment": "text"}),
    "supplier": ("Supplier", "s_suppkey", {"s_name": "text", "s_nationkey": "nation", "s_acctbal": "number"}),
    "part": ("Part", "p_partkey", {"p_name": "text", "p_brand": "text", "p_type": "text", "p_size": "number", "p_retailprice": "number"}),
    "orders": ("Order", "o_orderkey", {"o_custkey": "customer", "o_orderstatus": "text", "o_totalprice": "number", "o_orderdate": "time", "o_orderpriority": "text"}),
    "lineitem": ("Lineitem", "l_orderkey-l_linenumber", {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier", "l_quantity": "number", "l_extendedprice": "number", "l_shipdate": "time"}),
}

VOCABULARY = [
    (C + "Customer", S.RDF_TYPE, "iri", S.RDFS + "Class"), (C + "Customer", S.RDFS + "label", "text", "Customer"), (C + "Customer", S.RDFS + "subClassOf", "iri", C + "Party"), (C + "Supplier", S.RDFS + "subClassOf", "iri", C + "Party"),
    (C + "Party", S.RDF_TYPE, "iri", S.RDFS + "Class"), (C + "Party", S.RDFS + "subClassOf", "iri", S.RDFS + "Class"), (C + "Nation", S.RDF_TYPE, "iri", S.OWL + "Class"),
    (S.RDFS + "Class", S.RDF_TYPE, "iri", S.RDFS + "Class"), (C + "Shop", S.RDFS + "subClassOf", "iri", C + "Supplier"), (C + "Kiosk", S.RDFS + "subClassOf", "iri", C + "Shop"), (C + "Egg", S.RDFS + "subClassOf", "iri", C + "Hen"), (C + "Hen", S.RDFS + "subClassOf", "iri", C + "Egg"),
    (BASE + "t/money", S.RDF_TYPE, "iri", S.RDFS + "Datatype"), (BASE + "t/money", S.RDFS + "label", "text", "Money"), (BASE + "t/money", S.RDFS + "label", "text", "Amount"), (BASE + "t/code", S.RDF_TYPE, "iri", S.RDFS + "Datatype"), (BASE + "t/code", S.RDFS + "comment", "text", "A short code"),
    (P + "n_name", S.RDF_TYPE, "iri", S.OWL + "DatatypeProperty"), (P + "n_regionkey", S.RDF_TYPE, "iri", S.OWL + "ObjectProperty"), (P + "c_name", S.RDF_TYPE, "iri", S.RDF + "Property"),
    (BASE + "s/nation", S.RDF_TYPE, "iri", S.SH + "NodeShape"), (BASE + "s/nation", S.RDFS + "label", "text", "Nation shape"), (BASE + "s/nation", S.SH + "targetClass", "iri", C + "Nation"), (BASE + "s/nation", S.SH + "targetClass", "iri", C + "Country"), (BASE + "s/name", S.RDF_TYPE, "iri", S.SH + "PropertyShape"),
]


def _key(table: str, sql: bool) -> str:
    parts = TABLES[table][1].split("-")
    return " || '-' || ".join(f"cast({p} as {'varchar' if sql else 'string'})" for p in parts)


def triples(spark: SparkSession, sf_dir: str, *tables: str, vocabulary: bool = False, points: bool = False, hashes: bool = False) -> DataFrame:
    """Triples of some tables. Each predicate is a branch with a constant, so that unasked ones are pruned from a plan."""
    out = []
    for t in tables:
        name, _, columns = TABLES[t]
        df = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        subject = F.concat(F.lit(f"{BASE}{t}/"), F.expr(_key(t, False)))
        null = F.lit(None).cast("string")

        def branch(predicate, iri=None, number=None, text=None, wkb=None, df=df, subject=subject, null=null):
            return df.select(subject.alias("subject"), F.lit(predicate).alias("predicate"), (iri if iri is not None else null).alias("object_iri"), (number if number is not None else null).cast("double").alias("object_float"), (text if text is not None else null).alias("object_string"), (wkb if wkb is not None else null.cast("binary")).alias("object_geometry"))

        out.append(branch(S.RDF_TYPE, iri=F.lit(C + name)))
        for c, kind in columns.items():
            col = F.col(c)
            if kind == "number":
                out.append(branch(P + c, number=col))
            elif kind == "text":
                out.append(branch(P + c, text=col))
            elif kind == "time":
                out.append(branch(P + c, text=F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss")))
            else:
                out.append(branch(P + c, iri=F.concat(F.lit(f"{BASE}{kind}/"), col.cast("string"))))
        if points and t in ("supplier", "customer"):
            k = F.col(TABLES[t][1])
            out.append(branch(P + "at", wkb=geo.st_point(k * 37 % 3600 / 10 - 180, k * 17 % 1700 / 10 - 85)))
    if vocabulary:
        rows = [(s, p, o if k == "iri" else None, None, o if k == "text" else None, None) for s, p, k, o in VOCABULARY]
        out.append(spark.createDataFrame(rows, "subject string, predicate string, object_iri string, object_float double, object_string string, object_geometry binary"))
    df = reduce(DataFrame.unionByName, out)
    return df.withColumn("triple_hash", terms.triple_hash(F.col("subject"), F.col("predicate"), terms.object_text())) if hashes else df


def sql(*tables: str, vocabulary: bool = False, points: bool = False) -> str:
    """`triples AS (...)` of the same mapping; geometry as two numbers lon and lat. otext is the comparison text."""
    out = []
    for t in tables:
        name, key, columns = TABLES[t]
        subject = f"'{BASE}{t}/' || {_key(t, True)}"

        def branch(predicate, iri="NULL", number="NULL", text="NULL", lon="NULL", lat="NULL", subject=subject, t=t):
            return f"SELECT {subject} AS subject, '{predicate}' AS predicate, CAST({iri} AS VARCHAR) AS object_iri, CAST({number} AS DOUBLE) AS object_float, CAST({text} AS VARCHAR) AS object_string, CAST({lon} AS DOUBLE) AS lon, CAST({lat} AS DOUBLE) AS lat FROM {t}"

        out.append(branch(S.RDF_TYPE, iri=f"'{C}{name}'"))
        for c, kind in columns.items():
            if kind == "number":
                out.append(branch(P + c, number=c))
            elif kind == "text":
                out.append(branch(P + c, text=c))
            elif kind == "time":
                out.append(branch(P + c, text=f"strftime({c}, '%Y-%m-%dT%H:%M:%S')"))
            else:
                out.append(branch(P + c, iri=f"'{BASE}{kind}/' || CAST({c} AS VARCHAR)"))
        if points and t in ("supplier", "customer"):
            out.append(branch(P + "at", lon=f"({key} * 37 % 3600) / 10.0 - 180", lat=f"({key} * 17 % 1700) / 10.0 - 85"))
    if vocabulary:
        quote = lambda v: "'" + v.replace("'", "''") + "'"
        rows = ", ".join(f"({quote(s)}, {quote(p)}, {quote(o) if k == 'iri' else 'NULL'}, CAST(NULL AS DOUBLE), {quote(o) if k == 'text' else 'NULL'}, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE))" for s, p, k, o in VOCABULARY)
        out.append(f"SELECT * FROM (VALUES {rows}) v(subject, predicate, object_iri, object_float, object_string, lon, lat)")
    body = " UNION ALL ".join(out)
    return f"triples AS (SELECT *, COALESCE(object_iri, CAST(object_float AS VARCHAR), object_string) AS otext FROM ({body}) u)"
