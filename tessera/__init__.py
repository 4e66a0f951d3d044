"""Tessera: a PySpark-native engine for typed, versioned RDF triples."""
