"""JSON-LD and RDF/XML files as term frames, and one reader for all formats.

Contexts that a file names by address are looked up in a mapping that the caller
gives; nothing is fetched.
"""

from __future__ import annotations

import json
import re
from json.decoder import scanstring
from urllib.parse import urljoin
from xml.etree import ElementTree
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schema as S
from tessera.sources.rdf import InvalidRdf, parse_turtle, read_files

ABSOLUTE = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")
SPACE = re.compile(r"\s*")
SCALAR = re.compile(r"true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")


class Node(dict):
    """A JSON object that knows the line of each key."""

    lines: dict[str, int]


class _Json:
    """JSON with the lines of keys."""

    def __init__(self, text: str):
        self.text, self.at, self.line = text, 0, 1

    def skip(self) -> str:
        end = SPACE.match(self.text, self.at).end()
        self.line += self.text.count("\n", self.at, end)
        self.at = end
        return self.text[end : end + 1]

    def take(self, wanted: str) -> str:
        c = self.skip()
        if not c or c not in wanted:
            raise InvalidRdf(f"line {self.line}: expected one of {wanted!r}, found {c!r}")
        self.at += 1
        return c

    def string(self) -> str:
        self.take('"')
        try:
            value, self.at = scanstring(self.text, self.at, True)
        except ValueError as e:
            raise InvalidRdf(f"line {self.line}: {e}") from e
        return value

    def value(self):
        c = self.skip()
        if c == '"':
            return self.string()
        if c in ("{", "["):
            self.at += 1
            out, close = (Node(), "}") if c == "{" else ([], "]")
            if c == "{":
                out.lines = {}
            if self.skip() == close:
                self.at += 1
                return out
            while True:
                if c == "{":
                    key = self.string()
                    out.lines[key] = self.line
                    self.take(":")
                    out[key] = self.value()
                else:
                    out.append(self.value())
                if self.take("," + close) == close:
                    return out
        m = SCALAR.match(self.text, self.at)
        if not m:
            raise InvalidRdf(f"line {self.line}: no JSON value at {self.text[self.at : self.at + 10]!r}")
        self.at = m.end()
        return json.loads(m.group())

    def document(self):
        out = self.value()
        if self.skip():
            raise InvalidRdf(f"line {self.line}: text after the document")
        return out


def _list(v) -> list:
    return v if isinstance(v, list) else [v]


class _Context:
    def __init__(self, base: str = "", vocab: str = "", language: str | None = None, terms: dict | None = None):
        self.base, self.vocab, self.language, self.terms = base, vocab, language, terms or {}

    def extend(self, given, known: dict, line: int, seen: tuple = ()) -> _Context:
        out = _Context(self.base, self.vocab, self.language, dict(self.terms))
        for one in _list(given):
            if one is None:
                out = _Context(self.base)
            elif isinstance(one, str):
                if one not in known or one in seen:
                    raise InvalidRdf(f"line {line}: context {one} is not at hand" if one not in known else f"line {line}: context {one} includes itself")
                remote = known[one]
                out = out.extend(remote.get("@context", remote), known, line, (*seen, one))
            else:
                for k, v in one.items():
                    if k == "@base":
                        out.base = urljoin(out.base, v) if v else ""
                    elif k == "@language":
                        out.language = v
                    elif not k.startswith("@"):
                        out.terms[k] = v if isinstance(v, dict) else {"@id": v}
                if "@vocab" in one:
                    out.vocab = out.iri(one["@vocab"], line, True) if one["@vocab"] else ""
        return out

    def iri(self, name: str, line: int, vocab: bool, depth: int = 0) -> str:
        """An IRI, keyword or blank node; "" for a name without a meaning in this context."""
        if name.startswith("@") or name.startswith("_:"):
            return name
        if depth > 30:
            raise InvalidRdf(f"line {line}: term {name!r} is defined by itself")
        if vocab and name in self.terms:
            target = self.terms[name].get("@id", name if ":" in name else None)
            if "@reverse" in self.terms[name]:
                target = self.terms[name]["@reverse"]
            if target is None:
                return self.vocab + name if self.vocab and "@id" not in self.terms[name] else ""
            return target if target == name else self.iri(target, line, True, depth + 1)
        prefix, colon, local = name.partition(":")
        if colon and not local.startswith("//") and prefix in self.terms:
            return self.iri(prefix, line, True, depth + 1) + local
        if ABSOLUTE.match(name):
            return name
        if vocab:
            return self.vocab + name if self.vocab else ""
        return urljoin(self.base, name) if self.base else name


class _JsonLd:
    def __init__(self, contexts: dict):
        self.known, self.out, self.fresh = contexts, [], 0

    def blank(self):
        self.fresh += 1
        return "bnode", f"_:gen{self.fresh}"

    def emit(self, line, s, p, o) -> None:
        self.out.append((line, s[0], s[1], p, *o, *(None,) * (4 - len(o))))

    def ref(self, name: str):
        return ("bnode" if name.startswith("_:") else "iri"), name

    def node(self, v: Node, ctx: _Context):
        """Emit a node's triples and return the node."""
        lines = getattr(v, "lines", {})
        if "@context" in v:
            ctx = ctx.extend(v["@context"], self.known, lines.get("@context", 0))
        keys = {k: ctx.iri(k, lines.get(k, 0), True) for k in v if k != "@context"}
        by = {m: k for k, m in keys.items() if m.startswith("@")}
        name = v.get(by["@id"]) if "@id" in by else None
        me = self.ref(ctx.iri(name, lines.get(by["@id"], 0), False)) if name is not None else self.blank()
        for k, p in keys.items():
            line = lines.get(k, 0)
            if p == "@type":
                for t in _list(v[k]):
                    t = ctx.iri(t, line, True) or ctx.iri(t, line, False)
                    self.emit(line, me, S.RDF_TYPE, self.ref(t))
            elif p in ("@graph", "@included"):
                for n in _list(v[k]):
                    self.node(n, ctx)
            elif p == "@reverse":
                for q, subjects in v[k].items():
                    for n in _list(subjects):
                        self.emit(line, self.node(n, ctx), ctx.iri(q, line, True), me)
            elif ABSOLUTE.match(p):
                rule = ctx.terms.get(k, {})
                for value in self.spread(v[k], rule):
                    if "@reverse" in rule:
                        self.emit(line, self.node(value, ctx) if isinstance(value, dict) else self.ref(ctx.iri(value, line, False)), p, me)
                    elif (o := self.object(value, rule, ctx, line)) is not None:
                        self.emit(line, me, p, o)
        return me

    def spread(self, v, rule: dict) -> list:
        """The single values of a property by its container."""
        kinds = _list(rule.get("@container"))
        if "@list" in kinds:
            return [v] if isinstance(v, dict) and "@list" in v else [{"@list": _list(v)}]
        if "@language" in kinds and isinstance(v, dict):
            return [{"@value": x, "@language": None if tag == "@none" else tag} for tag, xs in v.items() for x in _list(xs) if x is not None]
        if "@index" in kinds and isinstance(v, dict):
            return [x for xs in v.values() for x in _list(xs)]
        return [x for one in _list(v) for x in (_list(one["@set"]) if isinstance(one, dict) and "@set" in one else [one])]

    def object(self, v, rule: dict, ctx: _Context, line: int):
        if v is None:
            return None
        if isinstance(v, list):
            raise InvalidRdf(f"line {line}: a list in a list")
        kind = rule.get("@type")
        if isinstance(v, dict):
            keys = {ctx.iri(k, line, True): k for k in v if k != "@context"}
            if "@value" in keys:
                t, tag = v.get(keys.get("@type")), v.get(keys.get("@language"))
                return self.literal(v[keys["@value"]], ctx.iri(t, line, True) if t else None, tag)
            if "@list" in keys:
                rest = ("iri", S.RDF + "nil")
                for x in reversed(_list(v[keys["@list"]])):
                    if (o := self.object(x, rule, ctx, line)) is not None:
                        cell = self.blank()
                        self.emit(line, cell, S.RDF + "first", o)
                        self.emit(line, cell, S.RDF + "rest", rest)
                        rest = cell
                return rest
            return self.node(v, ctx)
        if isinstance(v, str) and kind in ("@id", "@vocab"):
            return self.ref((ctx.iri(v, line, True) if kind == "@vocab" else "") or ctx.iri(v, line, False))
        datatype = ctx.iri(kind, line, True) if kind and not kind.startswith("@") else None
        return self.literal(v, datatype, rule.get("@language", ctx.language) if isinstance(v, str) and not datatype else None)

    def literal(self, v, datatype, tag):
        if v is None:
            return None
        if isinstance(v, bool):
            return "literal", "true" if v else "false", datatype or S.XSD + "boolean", None
        if isinstance(v, int):
            return "literal", str(v), datatype or S.XSD + "integer", None
        if isinstance(v, float):
            return "literal", repr(v), datatype or S.XSD + "double", None
        if not isinstance(v, str):
            return "literal", json.dumps(v, sort_keys=True), datatype or S.RDF + "JSON", None
        return "literal", v, datatype, tag


def parse_jsonld(text: str, base: str = "", contexts: dict[str, dict] | None = None) -> list[tuple]:
    """Triples of a JSON-LD document, named graphs merged; keys without a meaning are left out."""
    reader = _JsonLd(contexts or {})
    for one in _list(_Json(text).document()) if text.strip() else []:
        if not isinstance(one, dict):
            raise InvalidRdf("a JSON-LD document is an object or a list of objects")
        reader.node(one, _Context(base))
    return reader.out


def _tree(text: str):
    """The document's root element and the line of each element; names are {namespace}local."""
    parser, builder, lines = expat.ParserCreate(namespace_separator="}"), ElementTree.TreeBuilder(), {}
    full = lambda n: "{" + n if "}" in n else n

    def start(name, attributes):
        lines[builder.start(full(name), {full(k): v for k, v in attributes.items()})] = parser.CurrentLineNumber

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, lambda n: builder.end(full(n)), builder.data
    try:
        parser.Parse(text.encode(), True)
    except expat.ExpatError as e:
        raise InvalidRdf(str(e)) from e
    return builder.close(), lines


class _RdfXml:
    XML = "{http://www.w3.org/XML/1998/namespace}"
    R = "{" + S.RDF + "}"

    def __init__(self, text: str, base: str):
        root, self.lines = _tree(text)
        self.out, self.fresh = [], 0
        if root.tag == self.R + "RDF":
            base, tag = self.scope(root, base, None)
            for e in root:
                self.node(e, base, tag)
        else:
            self.node(root, base, None)

    def scope(self, e, base, tag):
        return urljoin(base, e.get(self.XML + "base", "")), e.get(self.XML + "lang", tag) or None

    def name(self, tag: str) -> str:
        return tag[1:].replace("}", "", 1) if tag.startswith("{") else tag

    def emit(self, e, s, p, o) -> None:
        self.out.append((self.lines[e], s[0], s[1], p, *o, *(None,) * (4 - len(o))))

    def blank(self):
        self.fresh += 1
        return "bnode", f"_:gen{self.fresh}"

    def node(self, e, base, tag):
        base, tag = self.scope(e, base, tag)
        about, ident, label = (e.get(self.R + n) for n in ("about", "ID", "nodeID"))
        me = ("iri", urljoin(base, about)) if about is not None else ("iri", urljoin(base, "#" + ident)) if ident else ("bnode", "_:n" + label) if label else self.blank()
        if e.tag != self.R + "Description":
            self.emit(e, me, S.RDF_TYPE, ("iri", self.name(e.tag)))
        self.attributes(e, me, base, tag)
        self.properties(e, me, base, tag)
        return me

    def attributes(self, e, me, base, tag) -> bool:
        """Properties that are written as attributes."""
        syntax = {self.R + n for n in ("about", "ID", "nodeID", "resource", "datatype", "parseType")}
        rest = [(k, v) for k, v in e.attrib.items() if k not in syntax and not k.startswith(self.XML) and k.startswith("{")]
        for k, v in rest:
            self.emit(e, me, self.name(k), ("iri", urljoin(base, v)) if k == self.R + "type" else ("literal", v, None, tag))
        return bool(rest)

    def properties(self, e, me, base, tag) -> None:
        count = 0
        for p in e:
            inner, lang = self.scope(p, base, tag)
            predicate = self.name(p.tag)
            if p.tag == self.R + "li":
                count += 1
                predicate = f"{S.RDF}_{count}"
            self.emit(p, me, predicate, self.object(p, inner, lang))

    def object(self, p, base, tag):
        how, children = p.get(self.R + "parseType"), list(p)
        if how == "Resource":
            o = self.blank()
            self.properties(p, o, base, tag)
            return o
        if how == "Collection":
            rest = ("iri", S.RDF + "nil")
            for item in reversed([self.node(c, base, tag) for c in children]):
                cell = self.blank()
                self.emit(p, cell, S.RDF + "first", item)
                self.emit(p, cell, S.RDF + "rest", rest)
                rest = cell
            return rest
        if how is not None:
            return "literal", (p.text or "") + "".join(ElementTree.tostring(c, encoding="unicode") for c in children), S.RDF + "XMLLiteral", None
        if len(children) > 1:
            raise InvalidRdf(f"line {self.lines[p]}: a property holds one node")
        if children:
            return self.node(children[0], base, tag)
        if (target := p.get(self.R + "resource")) is not None:
            o = ("iri", urljoin(base, target))
        elif label := p.get(self.R + "nodeID"):
            o = ("bnode", "_:n" + label)
        elif any(k.startswith("{") and not k.startswith(self.XML) and k not in (self.R + "datatype", self.R + "ID") for k in p.attrib):
            o = self.blank()
        else:
            datatype = p.get(self.R + "datatype")
            return "literal", p.text or "", urljoin(base, datatype) if datatype else None, None if datatype else tag
        self.attributes(p, o, base, tag)
        return o


def parse_rdfxml(text: str, base: str = "") -> list[tuple]:
    """Triples of an RDF/XML document."""
    return _RdfXml(text, base).out if text.strip() else []


SUFFIXES = {"ttl": "turtle", "turtle": "turtle", "nt": "turtle", "jsonld": "jsonld", "json": "jsonld", "rdf": "xml", "owl": "xml", "xml": "xml"}
MEDIA = {"text/turtle": "turtle", "application/n-triples": "turtle", "application/ld+json": "jsonld", "application/json": "jsonld", "application/rdf+xml": "xml", "application/xml": "xml"}


def parse_any(text: str, kind: str | None = None, base: str = "", contexts: dict[str, dict] | None = None) -> list[tuple]:
    """Triples of a document of the given kind or media type; else the look of it decides, then each format is tried."""
    parsers = {"turtle": lambda: parse_turtle(text, base), "jsonld": lambda: parse_jsonld(text, base, contexts), "xml": lambda: parse_rdfxml(text, base)}
    kind = MEDIA.get((kind or "").split(";")[0].strip().lower(), kind)
    if kind in parsers:
        return parsers[kind]()
    head = text.lstrip("﻿ \t\r\n")[:200]
    first = "jsonld" if head[:1] in ("{", "[") else "xml" if re.match(r"<(\?xml|!--|!DOCTYPE|[\w]+:RDF)", head) else "turtle"
    errors = []
    for name in sorted(parsers, key=lambda n: n != first):
        try:
            return parsers[name]()
        except InvalidRdf as e:
            errors.append(f"{name}: {e}")
    raise InvalidRdf("; ".join(errors))


def read_rdf(spark: SparkSession, path: str, base: str = "", contexts: dict[str, dict] | None = None) -> DataFrame:
    """Terms of all RDF files below a path, each parsed by its suffix."""
    return read_files(spark, path, "|".join(SUFFIXES), lambda name, text: parse_any(text, SUFFIXES[name.rsplit(".", 1)[-1]], base, contexts))


def used_terms(spark: SparkSession, path: str, base: str = "", contexts: dict[str, dict] | None = None) -> DataFrame:
    """(path, line, iri): the predicates, types and datatypes that the files below a path use, each where it stands."""
    rows = read_rdf(spark, path, base, contexts)
    pick = lambda c, cond: rows.filter(cond).select("path", "line", F.col(c).alias("iri"))
    return pick("p", F.lit(True)).union(pick("o", (F.col("p") == S.RDF_TYPE) & (F.col("o_kind") == "iri"))).union(pick("o_datatype", F.col("o_datatype").isNotNull())).distinct()


def problems(text: str, base: str = "") -> list[tuple[int, str, str]]:
    """(line, term, message) of a JSON-LD document's names with a prefix that no context declares, and of local nodes with properties but without a type."""
    out: list[tuple[int, str, str]] = []
    line = lambda term: text.count("\n", 0, max(0, text.find(json.dumps(term, ensure_ascii=False)))) + 1

    def declared(context, known: frozenset[str]) -> frozenset[str] | None:
        """Prefixes that hold below a context; None if one of them is given by address, so that nothing can be said."""
        for one in context if isinstance(context, list) else [context]:
            if isinstance(one, str):
                return None
            if isinstance(one, dict):
                known = known | frozenset(one)
        return known

    def walk(node, known: frozenset[str] | None) -> None:
        if isinstance(node, list):
            for item in node:
                walk(item, known)
        if not isinstance(node, dict):
            return
        if "@context" in node and known is not None:
            known = declared(node["@context"], known)
        types = node.get("@type", [])
        for term in [k for k in node if not k.startswith("@")] + [t for t in (types if isinstance(types, list) else [types]) if isinstance(t, str)]:
            prefix, colon, rest = term.partition(":")
            if colon and not rest.startswith("//") and prefix != "_" and known is not None and prefix not in known:
                out.append((line(term), term, f"undefined prefix {prefix}"))
        name = node.get("@id")
        if isinstance(name, str) and "@type" not in node and any(k not in ("@id", "@context") for k in node) and ("://" not in name or base and name.startswith(base)):
            out.append((line(name), name if "://" in name else base + name, "a local node has no type"))
        for key, value in node.items():
            if key != "@context":
                walk(value, known)

    walk(json.loads(text) if text.strip() else None, frozenset())
    return out


def jsonld_problems(spark: SparkSession, path: str, base: str = "") -> DataFrame:
    """(path, line, term, message) of the JSON-LD files below a path, each in a task of its own."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(F.col("path").rlike(r"\.(json|jsonld)$"))
    return checked_jsonld(files, base)


def checked_jsonld(files: DataFrame, base: str = "") -> DataFrame:
    """(path, line, term, message) of documents in a frame of (path, content as UTF-8 bytes)."""

    def run(batches):
        for pdf in batches:
            rows = [(name, n, term, f"{name}:{n}: {message}: {term}") for name, content in zip(pdf["path"], pdf["content"], strict=True) for n, term, message in problems(bytes(content or b"").decode("utf-8-sig"), base)]
            yield pd.DataFrame(rows, columns=["path", "line", "term", "message"])

    return files.select("path", "content").mapInPandas(run, "path string, line int, term string, message string")
