"""RDF files as term frames: N-Triples and Turtle, with path and line of every triple.

Files are read by Spark's binary source and parsed in parallel, one file a row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schema as S
from tessera.schema import TesseraError

TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)|(?P<iri><[^<>"{}|^`\x00-\x20]*>)|(?P<str>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<num>[+-]?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)|(?P<bnode>_:[\w](?:[\w.-]*[\w-])?)
    |(?P<pname>(?:[A-Za-z](?:[\w.-]*[\w-])?)?:(?:(?:[\w:-]|%[0-9A-Fa-f]{2}|\\.)(?:(?:[\w.:-]|%[0-9A-Fa-f]{2}|\\.)*(?:[\w:-]|%[0-9A-Fa-f]{2}|\\.))?)?)|(?P<word>[A-Za-z]+)|(?P<op>\^\^|[.;,()\[\]])""",
    re.X | re.S,
)


class InvalidRdf(TesseraError):
    """A file that cannot be parsed."""


class _Turtle:
    """One document; triples come as (line, s_kind, s, p, o_kind, o, datatype, language)."""

    def __init__(self, text: str, base: str):
        self.base, self.prefixes, self.out, self.fresh = base, {}, [], 0
        self.tokens, at, line = [], 0, 1
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise InvalidRdf(f"line {line}: cannot be parsed near {text[at : at + 20]!r}")
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup, m.group(), line))
            line += m.group().count("\n")
            at = m.end()
        self.tokens.append(("end", "", line))
        self.at = 0

    def peek(self):
        return self.tokens[self.at]

    def next(self):
        t = self.tokens[self.at]
        self.at += 1
        return t

    def expect(self, value: str) -> None:
        kind, v, line = self.next()
        if v != value:
            raise InvalidRdf(f"line {line}: expected {value!r}, found {v!r}")

    def blank(self):
        self.fresh += 1
        return "bnode", f"_:gen{self.fresh}", None, None

    def parse(self):
        while self.peek()[0] != "end":
            kind, v, line = self.peek()
            word = v.lower().lstrip("@")
            if word in ("prefix", "base") and kind in ("at", "word"):
                self.next()
                if word == "prefix":
                    name = self.next()[1][:-1]
                    self.prefixes[name] = self.iri(self.next())
                else:
                    self.base = self.iri(self.next())
                if kind == "at":
                    self.expect(".")
                continue
            if v == "[":
                subject = self.node()
                if self.peek()[1] != ".":
                    self.predicates(subject)
            else:
                subject = self.node()
                if subject[0] == "literal":
                    raise InvalidRdf(f"line {line}: a literal cannot be a subject")
                self.predicates(subject)
            self.expect(".")
        return self.out

    def iri(self, token) -> str:
        kind, v, line = token
        if kind == "iri":
            value = re.sub(r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})", lambda m: chr(int(m[1] or m[2], 16)), v[1:-1])
            return value if not self.base or re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", value) else self.base + value
        if kind == "pname":
            prefix, _, local = v.partition(":")
            if prefix not in self.prefixes:
                raise InvalidRdf(f"line {line}: undeclared prefix {prefix!r}")
            return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)
        raise InvalidRdf(f"line {line}: an IRI is expected, found {v!r}")

    def node(self):
        from tessera.plans.sparql import unquote

        kind, v, line = token = self.next()
        if kind in ("iri", "pname"):
            return "iri", self.iri(token), None, None
        if kind == "bnode":
            return "bnode", v, None, None
        if kind == "str":
            if self.peek()[0] == "at":
                return "literal", unquote(v), None, self.next()[1][1:]
            if self.peek()[1] == "^^":
                self.next()
                return "literal", unquote(v), self.iri(self.next()), None
            return "literal", unquote(v), None, None
        if kind == "num":
            return "literal", v, S.XSD + ("double" if "e" in v.lower() else "decimal" if "." in v else "integer"), None
        if kind == "word" and v in ("true", "false"):
            return "literal", v, S.XSD + "boolean", None
        if v == "[":
            me = self.blank()
            if self.peek()[1] != "]":
                self.predicates(me)
            self.expect("]")
            return me
        if v == "(":
            items = []
            while self.peek()[1] != ")":
                items.append(self.node())
            self.next()
            rest = ("iri", S.RDF + "nil", None, None)
            for item in reversed(items):
                cell = self.blank()
                self.emit(line, cell, S.RDF + "first", item)
                self.emit(line, cell, S.RDF + "rest", rest)
                rest = cell
            return rest
        raise InvalidRdf(f"line {line}: unexpected {v!r}")

    def emit(self, line, s, p, o):
        self.out.append((line, s[0], s[1], p, o[0], o[1], o[2], o[3]))

    def predicates(self, subject):
        while True:
            kind, v, line = self.peek()
            if kind == "word" and v == "a":
                self.next()
                p = S.RDF_TYPE
            else:
                p = self.iri(self.next())
            while True:
                line = self.peek()[2]
                self.emit(line, subject, p, self.node())
                if self.peek()[1] != ",":
                    break
                self.next()
            if self.peek()[1] != ";":
                return
            while self.peek()[1] == ";":
                self.next()
            if self.peek()[1] in (".", "]"):
                return


def parse_turtle(text: str, base: str = "") -> list[tuple]:
    """Triples of a Turtle or N-Triples document; relative IRIs are kept without a base."""
    return _Turtle(text, base).parse()


SCHEMA = "path string, line int, s_kind string, s string, p string, o_kind string, o string, o_datatype string, o_lang string"


def read_files(spark: SparkSession, path: str, suffixes: str, parse: Callable[[str, str], list[tuple]]) -> DataFrame:
    """Terms of the files below a path whose names end in one of the suffixes; parse takes name and text.

    Blank nodes are kept apart by file, with labels that a repeated task gives again.
    Hidden files and folders below the path are skipped, as Spark lists none. An empty file has no terms; a file that cannot be parsed raises with its name.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return parse_files(files.filter(F.col("path").rlike(rf"\.({suffixes})$")), parse)


def parse_files(files: DataFrame, parse: Callable[[str, str], list[tuple]]) -> DataFrame:
    """Terms of documents in a frame of (path, content as UTF-8 bytes), one document a row; null content is empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows = parse(name, bytes(content or b"").decode("utf-8-sig"))
                except (TesseraError, UnicodeDecodeError, RecursionError) as e:
                    raise InvalidRdf(f"{name}: {e}") from e
                out = pd.DataFrame(rows, columns=["line", "s_kind", "s", "p", "o_kind", "o", "o_datatype", "o_lang"], dtype=object)
                out.insert(0, "path", name)
                tag = hashlib.sha256(name.encode()).hexdigest()[:12]
                for kind, c in (("s_kind", "s"), ("o_kind", "o")):
                    mine = out[kind] == "bnode"
                    out.loc[mine, c] = "_:f" + tag + "_" + out.loc[mine, c].str[2:]
                out["line"] = out["line"].astype("int32")
                yield out

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def read_turtle(spark: SparkSession, path: str, base: str = "") -> DataFrame:
    """Terms of all .ttl, .turtle and .nt files below a path."""
    return read_files(spark, path, "ttl|turtle|nt", lambda name, text: parse_turtle(text, base))


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """Terms of an N-Triples file or folder, line by line inside the JVM: files are split among tasks."""
    return ntriples_terms(spark.read.text(path))


def ntriples_terms(lines: DataFrame) -> DataFrame:
    """Terms of N-Triples lines in a column named value; a line that is none raises."""
    node = r"<([^>]*)>|(_:\S+)"
    pattern = rf'^\s*(?:{node})\s+<([^>]*)>\s+(?:{node}|"((?:[^"\\]|\\.)*)"(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+))?)\s*\.\s*(?:#.*)?$'
    lines = lines.filter(~F.col("value").rlike(r"^\s*(#.*)?$"))
    part = lambda n: F.nullif(F.regexp_extract("value", pattern, n), F.lit(""))
    literal = F.regexp_extract("value", pattern, 6)
    for written, plain in (("\\\\", "\x00"), ('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\x00", "\\")):
        literal = F.replace(literal, F.lit(written), F.lit(plain))
    is_iri, is_node = part(4).isNotNull(), part(5).isNotNull()
    bad = F.raise_error(F.concat(F.lit("not an N-Triples line: "), F.col("value")))
    return lines.select(
        F.when(~F.col("value").rlike(pattern), bad).when(part(1).isNotNull(), "iri").otherwise("bnode").alias("s_kind"), F.coalesce(part(1), part(2)).alias("s"), part(3).alias("p"),
        F.when(is_iri, "iri").when(is_node, "bnode").otherwise("literal").alias("o_kind"), F.when(is_iri, part(4)).when(is_node, part(5)).otherwise(literal).alias("o"), part(7).alias("o_datatype"), part(8).alias("o_lang"),
    )
