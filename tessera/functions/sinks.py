"""Results to the outside: N-Triples, SPARQL JSON, GeoJSON, aligned text and CSV."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import geo, terms


def write_ntriples(triples: DataFrame, path: str) -> None:
    """One line a triple, written by all tasks; nothing passes the driver."""
    triples.select(terms.ntriples_line().alias("value")).write.text(path)


def write_nquads(triples: DataFrame, path: str, graph: str | None = None) -> None:
    """One statement a line, in the named graph if there is one; written by all tasks."""
    triples.select(terms.nquads_line(graph).alias("value")).write.text(path)


def sparql_json(df: DataFrame) -> DataFrame:
    """(binding): each row as a SPARQL JSON binding; nulls are unbound."""
    cells = [terms.sparql_json_term(F.col(f"`{c}`").cast("string")).alias(c) for c in df.columns]
    return df.select(F.to_json(F.struct(*cells)).alias("binding"))


def sparql_json_document(df: DataFrame, limit: int = 1000) -> str:
    """The whole answer of an interactive query; limit is the report's size."""
    rows = [json.loads(r["binding"]) for r in sparql_json(df.limit(limit)).collect()]
    return json.dumps({"head": {"vars": df.columns}, "results": {"bindings": rows}})


def feature_collection(page: DataFrame) -> str:
    """A page of (subject, predicate, geometry) as GeoJSON."""
    features = [{"type": "Feature", "id": r["subject"], "geometry": json.loads(r["geometry"]), "properties": {"subject": r["subject"], "predicate": r["predicate"]}} for r in page.collect()]
    return json.dumps({"type": "FeatureCollection", "features": features})


def map_features(df: DataFrame) -> DataFrame:
    """(feature): a GeoJSON feature for each cell of a result that is a WKT or GeoJSON geometry; the row's other cells are its properties."""
    text = {c: F.col(f"`{c}`").cast("string") for c in df.columns}
    geometry = lambda c: F.when(c.rlike(geo.WKT_LOOK), geo.text_to_geojson(c)).when(c.rlike(r'^\s*\{.*"type"\s*:\s*"(Point|LineString|Polygon|MultiPoint|MultiLineString|MultiPolygon)"'), c)
    others = lambda mine: F.to_json(F.struct(*[text[c].alias(c) for c in df.columns if c != mine])) if len(df.columns) > 1 else F.lit("{}")
    cells = F.array(*[F.struct(geometry(text[c]).alias("g"), others(c).alias("p")) for c in df.columns])
    return df.select(F.explode(cells).alias("f")).filter("f.g is not null").select(F.concat(F.lit('{"type":"Feature","geometry":'), F.col("f.g"), F.lit(',"properties":'), F.col("f.p"), F.lit("}")).alias("feature"))


def shortened(df: DataFrame, width: int = 80) -> DataFrame:
    """Cells as text for a narrow screen: white space in one line, and an ellipsis where a cell is cut."""
    line = lambda c: F.regexp_replace(F.col(f"`{c}`"), r"\s+", " ")
    return terms.render_text(df).select([F.when(F.length(line(c)) > width, F.concat(F.substring(line(c), 1, width - 1), F.lit("…"))).otherwise(line(c)).alias(c) for c in df.columns])


def extent_feature(extent: DataFrame) -> str:
    r = extent.first()
    if not r["count"]:
        return json.dumps({"type": "Feature", "geometry": None, "properties": {"count": "0"}})
    x0, y0, x1, y1 = r["xmin"], r["ymin"], r["xmax"], r["ymax"]
    ring = [[x0, y0], [x0, y1], [x1, y1], [x1, y0], [x0, y0]]
    return json.dumps({"type": "Feature", "bbox": [x0, y0, x1, y1], "geometry": {"type": "Polygon", "coordinates": [ring]}, "properties": {"count": str(r["count"])}})


def table_lines(df: DataFrame) -> Iterator[str]:
    """Aligned text of all rows, a line each; the widths come first, then the rows pass one by one."""
    text = terms.render_text(df)
    longest = text.agg(*[F.max(F.coalesce(F.length(F.col(f"`{c}`").cast("string")), F.lit(4))).alias(f"w{i}") for i, c in enumerate(text.columns)]).first()
    width = [max(len(c), w or 0) for c, w in zip(df.columns, longest, strict=True)]
    for r in chain([df.columns], text.toLocalIterator()):
        yield "  ".join(str(v).ljust(w) for v, w in zip(r, width, strict=True)).rstrip()


def format_table(df: DataFrame) -> str:
    """Aligned text of all rows."""
    return "\n".join(table_lines(df))


def csv_lines(df: DataFrame) -> Iterator[str]:
    """All rows as CSV, a record each, with its line end."""
    for r in chain([df.columns], terms.render_text(df).toLocalIterator()):
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerow(list(r))
        yield out.getvalue()


def to_csv(df: DataFrame) -> str:
    return "".join(csv_lines(df))


def sql_response(df: DataFrame, cap: int = 1000) -> dict:
    """Rows of a query up to the cap, with a message that gives the true count."""
    rows = [list(r) for r in terms.render_text(df).limit(cap + 1).collect()]
    message = f"showing {cap} of {df.count()} rows" if len(rows) > cap else ""
    return {"columns": df.columns, "rows": rows[:cap], "message": message}


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Without the columns that are null or empty in every row; one pass."""
    text = lambda c: F.col(f"`{c}`").cast("string")
    used = df.agg(*[F.coalesce(F.bool_or(text(c) != ""), F.lit(False)).alias(f"k{i}") for i, c in enumerate(df.columns)]).first()
    return df.select([F.col(f"`{c}`") for i, c in enumerate(df.columns) if used[i]])


def triple_columns(columns: list[str]) -> tuple[str, str, str] | None:
    """Which columns of a result are subject, predicate and object: by their usual names, else the first three; None if there are fewer."""
    low = {c.lower(): c for c in reversed(columns)}
    pick = [next((low[n] for n in names if n in low), None) for names in (("subject", "s"), ("predicate", "p"), ("object", "o"))]
    if all(pick):
        return tuple(pick)
    return tuple(columns[:3]) if len(columns) >= 3 else None


def graph_view(triples: DataFrame, cap: int = 2000) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a result of triples for a picture; cap is the report's size."""
    rows = triples.select("subject", "predicate", terms.object_text().alias("object")).filter("object is not null").limit(cap)
    edges = rows.dropDuplicates(["subject", "object", "predicate"])
    kind = lambda c: F.when(c.startswith("_:"), "blank").when(c.rlike(r"^([A-Za-z][A-Za-z0-9+.-]*://|urn:)"), "iri").otherwise("literal")
    nodes = rows.select(F.col("subject").alias("node")).union(rows.select("object")).distinct()
    return nodes.withColumn("kind", kind(F.col("node"))), edges
