"""Ready-made queries that a user can start from."""

from __future__ import annotations

from tessera import schema as S
from tessera.functions.terms import gate

_PREFIXES = f"PREFIX rdf: <{S.RDF}> PREFIX rdfs: <{S.RDFS}> PREFIX owl: <{S.OWL}> PREFIX geo: <{S.GEO}> PREFIX dcterms: <http://purl.org/dc/terms/> "

# The names of the samples and what they ask for.
STARTERS = {
    "All triples": "SELECT ?subject ?predicate ?object WHERE { ?subject ?predicate ?object } LIMIT 20",
    "Classes": "SELECT DISTINCT ?class WHERE { ?class rdf:type rdfs:Class }",
    "Types in use": "SELECT DISTINCT ?type WHERE { ?subject rdf:type ?type }",
    "Properties": "SELECT ?property ?type WHERE { ?property rdf:type ?type FILTER(?type = rdf:Property || ?type = owl:ObjectProperty || ?type = owl:DatatypeProperty || ?type = owl:AnnotationProperty) }",
    "Predicates": "SELECT DISTINCT ?predicate WHERE { ?subject ?predicate ?object }",
    "Subclasses": "SELECT ?class ?parent WHERE { ?class rdfs:subClassOf ?parent }",
    "Labels": "SELECT ?subject ?label WHERE { ?subject rdfs:label ?label } LIMIT 50",
    "Typed labels": "SELECT ?subject ?type ?label WHERE { ?subject rdf:type ?type ; rdfs:label ?label } LIMIT 50",
    "Instances only": "SELECT ?subject ?type WHERE { ?subject rdf:type ?type FILTER(?type != rdfs:Class) } LIMIT 50",
    "Geometries": "SELECT ?feature ?wkt WHERE { ?feature geo:hasGeometry ?geometry . ?geometry geo:asWKT ?wkt } LIMIT 500",
    "Ontology versions": "SELECT ?ontology ?versionIRI ?format ?modified WHERE { ?ontology rdf:type owl:Ontology ; owl:versionIRI ?versionIRI ; dcterms:format ?format ; dcterms:modified ?modified }",
}
NODE_LIMIT = 500

#: name -> SQL over the view `triples`
SQL_STARTERS = {
    "Columns": "DESCRIBE triples",
    "Triples by predicate": "SELECT predicate, count(*) AS n FROM triples GROUP BY predicate ORDER BY n DESC, predicate",
    "Busiest subjects": "SELECT subject, count(*) AS n FROM triples GROUP BY subject ORDER BY n DESC, subject LIMIT 50",
    "Typed resources": f"SELECT subject, object_iri AS type FROM triples WHERE predicate = '{S.RDF_TYPE}' ORDER BY subject, type LIMIT 50",
    "Geometries": "SELECT subject, predicate, st_astext(object_geometry) AS wkt FROM triples WHERE object_geometry IS NOT NULL ORDER BY subject, predicate LIMIT 50",
}


def starter(name: str) -> str:
    """A starter query with the prefixes that it needs."""
    return _PREFIXES + STARTERS[name]


def node_query(kind: str, value: str, datatype: str | None = None) -> str:
    """What is known around a node of a result: an IRI's predicates and objects, or the subjects and predicates that have a literal."""
    if kind in ("iri", "uri"):
        return f"SELECT ?predicate ?object WHERE {{ <{value}> ?predicate ?object }} LIMIT {NODE_LIMIT}"
    if datatype is None and gate(value) is not None:
        literal = value if value[0] not in "+" and "n" not in value.lower() else f'"{value}"'
    else:
        escaped = value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")
        literal = f'"{escaped}"' + (f"^^<{datatype}>" if datatype else "")
    return f"SELECT ?subject ?predicate WHERE {{ ?subject ?predicate {literal} }} LIMIT {NODE_LIMIT}"
