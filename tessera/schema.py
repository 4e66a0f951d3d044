"""The triples table: its schema, namespaces, and the errors that users see."""

from __future__ import annotations

from pyspark.sql import types as T

TRIPLES = T.StructType(
    [
        T.StructField("subject", T.StringType(), False), T.StructField("predicate", T.StringType(), False), T.StructField("object_iri", T.StringType()), T.StructField("object_float", T.DoubleType()),
        T.StructField("object_string", T.StringType()), T.StructField("object_geometry", T.BinaryType()), T.StructField("triple_hash", T.StringType(), False),
    ]
)
COLUMNS = TRIPLES.fieldNames()
#: Terms before they are split into typed columns; datatype and language live here only.
TERMS = T.StructType([T.StructField(n, T.StringType()) for n in ("s_kind", "s", "p", "o_kind", "o", "o_datatype", "o_lang")])
PARTITION = "predicate_part"
PARTITION_CHARS = 20

# Namespaces of the vocabularies that queries and checks know.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
SH = "http://www.w3.org/ns/shacl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
GEO = "http://www.opengis.net/ont/geosparql#"
GEOF = "http://www.opengis.net/def/function/geosparql/"
UOM = "http://www.opengis.net/def/uom/OGC/1.0/"
WKT_LITERAL = GEO + "wktLiteral"
RDF_TYPE = RDF + "type"

PROPERTY_CLASSES = (RDF + "Property", OWL + "ObjectProperty", OWL + "DatatypeProperty", OWL + "AnnotationProperty")
VOCABULARY_CLASSES = (RDFS + "Class", OWL + "Class", RDFS + "Datatype", OWL + "Ontology", *PROPERTY_CLASSES, SH + "NodeShape", SH + "PropertyShape")
SHAPE_CLASSES = (SH + "NodeShape", SH + "PropertyShape")


class TesseraError(ValueError):
    """Base of what users can get wrong."""


class InvalidSparql(TesseraError):
    """The text is no query of the language."""


class UnsupportedSparql(TesseraError):
    """The query is outside of the supported subset."""


class OldTableLayout(TesseraError):
    """The table has one object column and must be built again."""


class NothingBuilt(TesseraError):
    """There is no table yet."""


def verify_layout(df) -> None:
    """Stop before any query if the table lacks the typed object columns."""
    missing = [c for c in COLUMNS if c not in df.columns and c != "triple_hash"]
    if missing:
        raise OldTableLayout(f"the triples table has an old layout without {', '.join(missing)}: build it again")
