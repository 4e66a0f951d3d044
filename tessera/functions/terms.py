"""Column expressions on RDF terms: numeric gate, typed split, text forms, hashes. All stay inside code generation."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import schema as S

DECIMAL = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
INFINITE = r"^[+-]?([iI][nN][fF]([iI][nN][iI][tT][yY])?)$"
NAN = r"^[nN][aA][nN]$"


def gate(text: str) -> float | None:
    """The number that a lexical form stands for, None if it is no number. Queries' constants and stored objects use one rule."""
    if re.match(DECIMAL, text):
        x = float(text)
        return x if math.isfinite(x) else None
    if re.match(INFINITE, text):
        return -math.inf if text[0] == "-" else math.inf
    return math.nan if re.match(NAN, text) else None


def numeric(c: Column) -> Column:
    """gate() as a column: decimal forms with a finite value, infinities and nan; anything else is null."""
    x = c.try_cast("double")
    finite = F.when(F.abs(x) < F.lit(math.inf), x)
    endless = F.when(c.startswith("-"), F.lit(-math.inf)).otherwise(F.lit(math.inf))
    return F.when(c.rlike(DECIMAL), finite).when(c.rlike(INFINITE), endless).when(c.rlike(NAN), F.lit(math.nan))


def render_double(c: Column) -> Column:
    """Shortest text of a double, with a point or an exponent: 1.0, 12345678.5, 0.0001, 1e+20, inf, nan."""
    plain = c.cast("string")
    size = F.abs(c)
    digits = F.regexp_replace(plain.try_cast("decimal(38,18)").cast("string"), r"(\.[0-9]*?[1-9]|\.0)0+$", "$1")
    small = F.regexp_replace(plain.try_cast("decimal(38,26)").cast("string"), r"(\.[0-9]*?[1-9]|\.0)0+$", "$1")
    mantissa = F.regexp_replace(F.regexp_extract(plain, r"^(-?[0-9.]+)E", 1), r"\.0$", "")
    power = F.regexp_extract(plain, r"E(-?[0-9]+)$", 1).try_cast("int")
    science = F.concat(mantissa, F.lit("e"), F.when(power < 0, F.lit("-")).otherwise(F.lit("+")), F.lpad(F.abs(power).cast("string"), 2, "0"))
    science = F.when(F.abs(power) > 99, F.concat(mantissa, F.lit("e"), F.when(power < 0, F.lit("-")).otherwise(F.lit("+")), F.abs(power).cast("string"))).otherwise(science)
    return (
        F.when(F.isnan(c), F.lit("nan")).when(c == F.lit(math.inf), F.lit("inf")).when(c == F.lit(-math.inf), F.lit("-inf")).when((c == 0) | (size >= 1e-3) & (size < 1e7), plain)
        .when((size >= 1e7) & (size < 1e16), digits).when((size >= 1e-4) & (size < 1e-3), small).when(c.isNotNull(), science)
    )


#: render_double as the text of a SQL function, for queries that are shown to a user.
DOUBLE_TEXT = r"""
CREATE OR REPLACE TEMPORARY FUNCTION double_text(x DOUBLE) RETURNS STRING RETURN
CASE WHEN x IS NULL THEN NULL WHEN isnan(x) THEN 'nan' WHEN x = double('inf') THEN 'inf' WHEN x = double('-inf') THEN '-inf'
WHEN x = 0 OR abs(x) >= 1e-3 AND abs(x) < 1e7 THEN string(x)
WHEN abs(x) >= 1e7 AND abs(x) < 1e16 THEN regexp_replace(string(try_cast(string(x) AS decimal(38,18))), '([.][0-9]*?[1-9]|[.]0)0+$', '$1')
WHEN abs(x) >= 1e-4 AND abs(x) < 1e-3 THEN regexp_replace(string(try_cast(string(x) AS decimal(38,26))), '([.][0-9]*?[1-9]|[.]0)0+$', '$1')
ELSE regexp_replace(regexp_extract(string(x), '^(-?[0-9.]+)E', 1), '[.]0$', '') || 'e' || if(startswith(regexp_extract(string(x), 'E(-?[0-9]+)$', 1), '-'), '-', '+')
  || lpad(replace(regexp_extract(string(x), 'E(-?[0-9]+)$', 1), '-', ''), greatest(2, length(replace(regexp_extract(string(x), 'E(-?[0-9]+)$', 1), '-', ''))), '0') END
"""


def triple_hash(s: Column, p: Column, o: Column) -> Column:
    """Identity of a triple by its texts; datatype, language and term kind do not take part."""
    return F.sha2(F.concat(F.lit("subject="), s, F.lit("\npredicate="), p, F.lit("\nobject="), o), 256)


def object_text(prefix: str = "") -> Column:
    """Comparison text of an object: IRI, number or string; a geometry has none."""
    c = lambda n: F.col(prefix + n)
    return F.coalesce(c("object_iri"), render_double(c("object_float")), c("object_string"))


def object_display(prefix: str = "") -> Column:
    """Text of an object for results: as for comparison, and geometries as WKT."""
    from tessera.functions import geo

    return F.coalesce(object_text(prefix), geo.st_astext(F.col(prefix + "object_geometry")))


def split_terms(terms: DataFrame) -> DataFrame:
    """Terms to triples: IRI, geometry, number or string column by kind, datatype and lexical form."""
    from tessera.functions import geo

    literal, o = F.col("o_kind") == "literal", F.col("o")
    wkt = literal & (F.col("o_datatype") == S.WKT_LITERAL)
    wkt = F.coalesce(wkt, F.lit(False))
    number = F.when(literal & ~wkt, numeric(o))
    typed = terms.select(
        F.col("s").alias("subject"), F.col("p").alias("predicate"), F.when(F.col("o_kind") == "iri", o).alias("object_iri"), number.alias("object_float"),
        F.when((F.col("o_kind") == "bnode") | literal & ~wkt & number.isNull(), o).alias("object_string"), F.when(wkt, o).alias("_wkt"), triple_hash(F.col("s"), F.col("p"), o).alias("triple_hash"),
    )
    return typed.withColumn("object_geometry", F.when(F.col("_wkt").isNotNull(), geo.st_geomfromtext(F.col("_wkt")))).select(S.COLUMNS)


def escape(c: Column) -> Column:
    """A literal's characters as N-Triples writes them."""
    for plain, written in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(plain), F.lit(written))
    return c


def ntriples_line() -> Column:
    """A triple's N-Triples line; the object is restored in the order IRI, geometry, number, blank node, string."""
    from tessera.functions import geo

    node = lambda c: F.when(c.startswith("_:"), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    quoted = lambda c: F.concat(F.lit('"'), escape(c), F.lit('"'))
    s = F.col("object_string")
    o = (
        F.when(F.col("object_iri").isNotNull(), F.concat(F.lit("<"), F.col("object_iri"), F.lit(">")))
        .when(F.col("object_geometry").isNotNull(), F.concat(quoted(geo.st_astext(F.col("object_geometry"))), F.lit(f"^^<{S.WKT_LITERAL}>")))
        .when(F.col("object_float").isNotNull(), F.concat(quoted(render_double(F.col("object_float"))), F.lit(f"^^<{S.XSD}double>")))
        .when(s.startswith("_:"), s).otherwise(quoted(s))
    )
    return F.concat_ws(" ", node(F.col("subject")), F.concat(F.lit("<"), F.col("predicate"), F.lit(">")), o, F.lit("."))


def nquads_line(graph: str | None = None) -> Column:
    """A triple's N-Quads line; without a graph it is in the default one."""
    line = ntriples_line()
    return line if graph is None else F.concat(F.substring(line, F.lit(1), F.length(line) - 1), F.lit(f"<{graph}> ."))


def sparql_json_term(c: Column) -> Column:
    """A result cell as a SPARQL JSON term: blank node, IRI, WKT literal or literal, by its text."""
    wkt = c.rlike(r"(?i)^(POINT|LINESTRING|POLYGON|MULTIPOINT|MULTILINESTRING|MULTIPOLYGON|GEOMETRYCOLLECTION)\s*(Z|M|ZM)?\s*(\(|EMPTY)")
    kind = F.when(c.startswith("_:"), "bnode").when(c.rlike(r"^([A-Za-z][A-Za-z0-9+.-]*://|urn:)\S*$"), "uri").otherwise("literal")
    value = F.when(c.startswith("_:"), F.substring(c, 3, 1 << 30)).otherwise(c)
    return F.when(c.isNotNull(), F.struct(kind.alias("type"), value.alias("value"), F.when(wkt, F.lit(S.WKT_LITERAL)).alias("datatype")))


def render_text(df: DataFrame) -> DataFrame:
    """Every column as text, null as the empty text."""
    text = lambda n, t: render_double(F.col(n)) if t in ("double", "float") else F.col(n).cast("string")
    return df.select([F.coalesce(text(f"`{n}`", t), F.lit("")).alias(n) for n, t in df.dtypes])
