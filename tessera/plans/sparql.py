"""SPARQL SELECT subset: parser, checks, and translation to DataFrame plans.

Supported: PREFIX, SELECT [DISTINCT] vars or *, a basic graph pattern with
filters, LIMIT. Everything else raises with the part that is not supported.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import schema as S
from tessera.functions import geo, terms
from tessera.schema import InvalidSparql, UnsupportedSparql

TOKEN = re.compile(
    r"""\s+|\#[^\n]*|(?P<iri><[^<>"{}|^`\\\x00-\x20]*>)|(?P<var>[?$][A-Za-z_0-9][\w]*)|(?P<str>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<num>(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)|(?P<pname>(?:[A-Za-z_][\w.-]*)?:(?:[\w:%-]|\.(?=[\w:%-]))*|_:[\w-]+)
    |(?P<word>[A-Za-z]+)|(?P<op>\^\^|&&|\|\||!=|<=|>=|[{}().;,=<>!*/|^+?\[\]-])""",
    re.X | re.S,
)


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Iri:
    value: str


@dataclass(frozen=True)
class Literal:
    value: str
    datatype: str | None = None
    lang: str | None = None


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Not:
    inner: object


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass
class Query:
    variables: list[str] | None  # None: *
    distinct: bool
    triples: list[tuple]
    filters: list
    limit: int | None
    order: list[str] = field(default_factory=list)  # variables by discovery


ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def unquote(text: str) -> str:
    body = text[3:-3] if text[:3] in ('"""', "'''") else text[1:-1]

    def one(m):
        if m[1] in ESCAPES:
            return ESCAPES[m[1]]
        if m[1][0] in "uU":
            return chr(int(m[1][1:], 16))
        raise InvalidSparql(f"invalid literal {text}")

    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", one, body, flags=re.S)


class Parser:
    FORMS = ("ASK", "CONSTRUCT", "DESCRIBE", "INSERT", "DELETE")
    REJECTED = ("OPTIONAL", "UNION", "MINUS", "GRAPH", "BIND", "VALUES", "SERVICE", "SELECT")

    def __init__(self, text: str):
        self.tokens, at = [], 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise InvalidSparql(f"the query cannot be parsed near {text[at : at + 20]!r}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.tokens.append(("end", ""))
        self.at, self.prefixes, self.fresh = 0, {}, 0
        self.triples: list[tuple] = []
        self.filters: list = []

    def peek(self, *values: str) -> bool:
        kind, v = self.tokens[self.at]
        return v.upper() in values if kind == "word" else v in values and kind != "str"

    def next(self):
        t = self.tokens[self.at]
        self.at += 1
        return t

    def expect(self, value: str) -> None:
        if not self.peek(value):
            raise InvalidSparql(f"the query cannot be parsed: expected {value!r}, found {self.tokens[self.at][1]!r}")
        self.at += 1

    def query(self) -> Query:
        while self.peek("PREFIX", "BASE"):
            word = self.next()[1].upper()
            if word == "PREFIX":
                kind, name = self.next()
                if kind != "pname" or not name.endswith(":"):
                    raise InvalidSparql("the query cannot be parsed: a prefix ends with a colon")
                self.prefixes[name[:-1]] = self._iri_token()
            else:
                self._iri_token()
        if self.peek(*self.FORMS):
            raise UnsupportedSparql("only SELECT queries are supported")
        self.expect("SELECT")
        distinct = False
        if self.peek("DISTINCT", "REDUCED"):
            distinct = self.next()[1].upper() == "DISTINCT"
        names: list[str] | None = []
        if self.peek("*"):
            self.next()
            names = None
        else:
            while self.tokens[self.at][0] == "var":
                names.append(self.next()[1][1:])
            if self.peek("("):
                raise UnsupportedSparql("projection expressions, GROUP BY, HAVING, ORDER BY and OFFSET are not supported")
            if not names:
                raise InvalidSparql("nothing to project")
        if self.peek("FROM"):
            raise UnsupportedSparql("dataset clauses are not supported")
        if self.peek("WHERE"):
            self.next()
        self.group()
        limit = None
        while self.tokens[self.at][0] != "end":
            if self.peek("LIMIT"):
                self.next()
                kind, v = self.next()
                if kind != "num" or not v.isdigit():
                    raise InvalidSparql("LIMIT takes a whole number")
                limit = int(v)
            elif self.peek("OFFSET"):
                self.next()
                if self.next()[1] != "0":
                    raise UnsupportedSparql("projection expressions, GROUP BY, HAVING, ORDER BY and OFFSET are not supported")
            elif self.peek("GROUP", "HAVING", "ORDER"):
                raise UnsupportedSparql("projection expressions, GROUP BY, HAVING, ORDER BY and OFFSET are not supported")
            else:
                raise InvalidSparql(f"the query cannot be parsed near {self.tokens[self.at][1]!r}")
        if not self.triples:
            raise UnsupportedSparql("a query needs one triple pattern at least")
        return Query(names, distinct, self.triples, self.filters, limit)

    def _iri_token(self) -> str:
        kind, v = self.next()
        if kind != "iri":
            raise InvalidSparql("the query cannot be parsed: an IRI is expected")
        return v[1:-1]

    def group(self) -> None:
        self.expect("{")
        while not self.peek("}"):
            if self.peek("{"):
                self.group()
                if self.peek("UNION"):
                    raise UnsupportedSparql("UNION is not supported")
            elif self.peek("FILTER"):
                self.next()
                self.filters.append(self.condition())
            elif self.peek(*self.REJECTED):
                raise UnsupportedSparql(f"{self.next()[1].upper()} is not supported")
            elif self.peek("."):
                self.next()
            elif self.tokens[self.at][0] == "end":
                raise InvalidSparql("the query cannot be parsed: a group is not closed")
            else:
                self.same_subject()
        self.expect("}")

    def same_subject(self) -> None:
        subject = self.node()
        while True:
            predicate = self.verb()
            while True:
                self.triples.append((subject, predicate, self.node()))
                if not self.peek(","):
                    break
                self.next()
            if not self.peek(";"):
                break
            while self.peek(";"):
                self.next()
            if self.peek(".", "}"):
                break
        if not self.peek(".", "}", "FILTER", "{", *self.REJECTED):
            raise InvalidSparql(f"the query cannot be parsed near {self.tokens[self.at][1]!r}")

    def verb(self):
        if self.peek("^", "!", "("):
            raise UnsupportedSparql("property paths are not supported")
        if self.tokens[self.at] == ("word", "a"):
            self.next()
            verb: object = Iri(S.RDF_TYPE)
        else:
            verb = self.node()
        if self.peek("/", "|", "*", "+", "?"):
            raise UnsupportedSparql("property paths are not supported")
        return verb

    def node(self):
        kind, v = self.next()
        if kind == "var":
            return Var(v[1:])
        if kind == "iri":
            return Iri(v[1:-1])
        if kind == "pname":
            prefix, _, local = v.partition(":")
            if prefix not in self.prefixes:
                raise InvalidSparql(f"unknown prefix {prefix!r}")
            return Iri(self.prefixes[prefix] + local)
        if kind == "num":
            return Literal(v, S.XSD + ("integer" if v.isdigit() else "decimal"))
        if v in ("-", "+") and kind == "op" and self.tokens[self.at][0] == "num":
            return Literal(("-" if v == "-" else "") + self.next()[1], S.XSD + "decimal")
        if kind == "word" and v in ("true", "false"):
            return Literal(v, S.XSD + "boolean")
        if kind == "str":
            value = unquote(v)
            if self.tokens[self.at][0] == "lang":
                return Literal(value, None, self.next()[1][1:])
            if self.peek("^^"):
                self.next()
                datatype = self.node()
                if not isinstance(datatype, Iri):
                    raise InvalidSparql("a literal's datatype is an IRI")
                return Literal(value, datatype.value)
            return Literal(value)
        raise InvalidSparql(f"unsupported term {v!r}")

    def condition(self):
        if not self.peek("("):
            if self.peek("EXISTS", "NOT"):
                raise UnsupportedSparql("this FILTER shape is not supported")
            return self.call()
        self.expect("(")
        e = self.either()
        self.expect(")")
        return e

    def either(self):
        e = self.both()
        while self.peek("||"):
            self.next()
            e = Binary("||", e, self.both())
        return e

    def both(self):
        e = self.comparison()
        while self.peek("&&"):
            self.next()
            e = Binary("&&", e, self.comparison())
        return e

    def comparison(self):
        e = self.unary()
        if self.peek("=", "!=", "<", ">", "<=", ">="):
            return Binary(self.next()[1], e, self.unary())
        if self.peek("IN", "NOT", "+", "-", "*", "/"):
            raise UnsupportedSparql(f"FILTER operator {self.tokens[self.at][1]} is not supported")
        return e

    def unary(self):
        if self.peek("!"):
            self.next()
            return Not(self.unary())
        if self.peek("("):
            return self.condition()
        kind, v = self.tokens[self.at]
        if kind == "word" and v not in ("true", "false") or kind in ("iri", "pname") and self.tokens[self.at + 1] == ("op", "("):
            return self.call()
        return self.node()

    def call(self):
        kind, v = self.next()
        name = v if kind == "word" else None
        if name is None:
            self.at -= 1
            node = self.node()
            if not isinstance(node, Iri):
                raise UnsupportedSparql("this FILTER shape is not supported")
            name = node.value
        self.expect("(")
        args = []
        while not self.peek(")"):
            args.append(self.either())
            if self.peek(","):
                self.next()
        self.expect(")")
        return Call(name, tuple(args))


def parse(text: str) -> Query:
    return Parser(text).query()


# ---- translation ------------------------------------------------------------------------------------------------


@dataclass
class Binding:
    alias: str
    column: str

    def compare(self) -> Column:
        return terms.object_text(f"{self.alias}_") if self.column == "object" else F.col(f"{self.alias}_{self.column}")

    def show(self) -> Column:
        return terms.object_display(f"{self.alias}_") if self.column == "object" else F.col(f"{self.alias}_{self.column}")


def _constant(alias: str, position: str, node) -> Column:
    c = lambda n: F.col(f"{alias}_{n}")
    if position != "object":
        test = c(position) == F.lit(node.value)
        return test & (c(S.PARTITION) == F.lit(node.value[: S.PARTITION_CHARS])) if position == "predicate" else test
    if isinstance(node, Iri):
        return c("object_iri") == F.lit(node.value)
    number = terms.gate(node.value)
    return c("object_float") == F.lit(number) if number is not None else c("object_string") == F.lit(node.value)


def _conjuncts(e) -> list:
    """The conditions that an expression joins by and."""
    return _conjuncts(e.left) + _conjuncts(e.right) if isinstance(e, Binary) and e.op == "&&" else [e]


TASK_PAIRS = 4_000_000  # rows that one task makes in a join of objects, about


def dealt_join(left: DataFrame, right: DataFrame, keys: list[tuple[Column, Column]]) -> DataFrame:
    """Equi-join on terms that many rows of both sides may have, as objects do: a term with more pairs than a task should make is dealt to several.

    Pairs are counted by term first. Of a crowded term, the rows of the larger side are dealt by their hash, and those of the other side go
    with each part. However small the files are, a task makes a few times TASK_PAIRS rows at most, unless rows are equal in all columns.
    """
    names = [f"_k{j}" for j in range(len(keys))]
    counted = lambda df, side, n: df.groupBy(*[k[side].alias(name) for k, name in zip(keys, names, strict=True)]).agg(F.count("*").alias(n))
    pairs = F.col("_n").cast("double") * F.col("_m")
    both = counted(left, 0, "_n").join(counted(right, 1, "_m"), names)
    found = both.agg(F.sum(pairs).alias("pairs"), F.sum("_n").alias("n"), F.sum("_m").alias("m"), F.collect_list(F.when(pairs > TASK_PAIRS, F.struct(*names, F.ceil(pairs / TASK_PAIRS).cast("int").alias("_parts")))).alias("crowded")).first()
    on = [x == y for x, y in keys]
    if not found["crowded"]:
        return left.join(right, on, "inner")
    schema = ", ".join(f"{n} string" for n in names)
    parts = F.broadcast(left.sparkSession.createDataFrame([tuple(r) for r in found["crowded"]], f"{schema}, _parts int"))
    tasks = min(10_000, math.ceil(found["pairs"] / TASK_PAIRS))

    def dealt(df: DataFrame, side: int, part: str) -> DataFrame:
        few = (found["n"] < found["m"]) == (side == 0)
        more = F.coalesce("_parts", F.lit(1))
        number = F.explode(F.sequence(F.lit(0), more - 1)) if few else F.pmod(F.xxhash64(*df.columns), more).cast("int")
        out = df.join(parts, [k[side] == F.col(n) for k, n in zip(keys, names, strict=True)], "left").withColumn(part, number).drop("_parts", *names)
        return out.repartition(tasks, *[k[side] for k in keys], part)

    pairs_of = dealt(left, 0, "_left").join(dealt(right, 1, "_right").hint("merge"), [*on, F.col("_left") == F.col("_right")], "inner")
    return pairs_of.drop("_left", "_right")


class Translation:
    """A query over a triples frame. Patterns are joined most constants first and connected wherever they can be."""

    def __init__(self, query: Query, triples: DataFrame, compat: bool = True):
        self.query, self.compat = query, compat
        S.verify_layout(triples)
        self.partitioned = S.PARTITION in triples.columns
        self.bindings: dict[str, Binding] = {}
        equal: list[tuple[set[str], Column]] = []
        self.terms: list[tuple[Binding, Binding]] = []  # that are equal, in the same order
        self.patterns: dict[str, DataFrame] = {}
        fixed: dict[str, int] = {}
        for n, triple in enumerate(query.triples):
            alias, tests = f"t{n}", []
            fixed[alias] = 0
            for position, node in zip(("subject", "predicate", "object"), triple, strict=True):
                if isinstance(node, Var):
                    mine = Binding(alias, position)
                    first = self.bindings.setdefault(node.name, mine)
                    if first is not mine:
                        equal.append(({first.alias, alias}, first.compare() == mine.compare()))
                        self.terms.append((first, mine))
                else:
                    fixed[alias] += 2 if position == "subject" else 1
                    tests.append(self._test(alias, position, node))
            renamed = triples.select([F.col(c).alias(f"{alias}_{c}") for c in triples.columns if c != "triple_hash"])
            for t in tests:
                renamed = renamed.filter(t)
            self.patterns[alias] = renamed
        conjuncts = [c for f in query.filters for c in _conjuncts(f)]
        self.filters = [self.filter(f) for f in conjuncts]
        self.spatial = {i: s for i, f in enumerate(conjuncts) if (s := self._spatial(f))}
        self.frame = self._joined(equal, fixed)

    def _test(self, alias: str, position: str, node) -> Column:
        if position == "predicate" and not self.partitioned:
            return F.col(f"{alias}_predicate") == F.lit(node.value)
        return _constant(alias, position, node)

    def _joined(self, equal, fixed) -> DataFrame:
        todo = sorted(self.patterns, key=lambda a: (-fixed[a], int(a[1:])))
        used = set()
        frame, done, rest = self._linked(todo[0], todo[1:], equal, used)
        while rest:
            near = [(a, i) for i, (x, y, *_) in self.spatial.items() if ("f", i) not in used for a, other in ((x, y), (y, x)) if a in rest and other in done]
            nxt = near[0][0] if near else rest[0]
            rest.remove(nxt)
            if near:
                # boxes must meet for the condition to hold: an equi-join on grid cells finds them, after all that narrows the other side
                i = near[0][1]
                used.add(("f", i))
                x, y, name, margin = self.spatial[i]
                geometry = lambda a: f"{a}_object_geometry"
                other, more, rest = self._linked(nxt, rest, equal, used)
                frame = geo.spatial_join(frame, other, geometry(y if nxt == x else x), geometry(nxt), name, margin, self.filters[i][1])
                done |= more
            else:
                frame = frame.crossJoin(self.patterns[nxt])
                done.add(nxt)
            frame, done, rest = self._linked(None, rest, equal, used, self._apply(frame, done, equal, used), done)
        return frame

    def _linked(self, first: str | None, rest: list[str], equal, used, frame: DataFrame | None = None, done: set[str] = frozenset()) -> tuple[DataFrame, set[str], list[str]]:
        """A pattern, or a frame of those done, with all others that equal terms link to it; and the patterns that are left."""
        rest = list(rest)
        if first is not None:
            done = {first}
            frame = self._apply(self.patterns[first], done, equal, used)
        while linked := [a for a in rest if any(a in s and (s - {a}) & done for s, _ in equal)]:
            nxt = linked[0]
            rest.remove(nxt)
            done = done | {nxt}
            on = [(i, c) for i, (s, c) in enumerate(equal) if i not in used and s <= done and nxt in s and len(s) > 1]
            used |= {i for i, _ in on}
            # sides of a spatial join may be any number of rows in small files: none is sent through the driver
            side = self.patterns[nxt].hint("merge") if self.spatial else self.patterns[nxt]
            met = [self.terms[i] for i, _ in on]
            if all(b.column == "object" for pair in met for b in pair):
                frame = dealt_join(frame, side, [(x, y) if b.alias == nxt else (y, x) for a, b in met for x, y in [(a.compare(), b.compare())]])
            else:
                frame = frame.join(side, [c for _, c in on], "inner")
            frame = self._apply(frame, done, equal, used)
        return frame, done, rest

    def _apply(self, frame, done, equal, used):
        for i, (s, c) in enumerate(equal):
            if i not in used and s <= done:
                used.add(i)
                frame = frame.filter(c)
        for i, (s, c) in enumerate(self.filters):
            if ("f", i) not in used and s <= done:
                used.add(("f", i))
                frame = frame.filter(c)
        return frame

    def _spatial(self, e) -> tuple[str, str, str, float] | None:
        """(alias, alias, relation, margin) of a condition on two patterns' geometries that holds only where their boxes meet within the margin."""
        name, margin = "", 0.0
        if isinstance(e, Binary) and e.op in ("<", "<=") and isinstance(e.left, Call) and isinstance(e.right, Literal) and (number := terms.gate(e.right.value)) is not None:
            unit = e.left.args[2].value if len(e.left.args) == 3 and isinstance(e.left.args[2], Iri) else S.UOM + "degree"
            if e.left.name.lower() == (S.GEOF + "distance").lower() and unit == S.UOM + "degree" and 0 <= number < 360:
                e, name, margin = Call(S.GEOF + "sfIntersects", e.left.args[:2]), "distance", number
        if not isinstance(e, Call) or len(e.args) != 2 or not all(isinstance(a, Var) for a in e.args):
            return None
        name = name or next((n for n in geo.RELATIONS if e.name.lower() == (S.GEOF + n).lower() and n != "sfDisjoint"), "")
        a, b = (self.bound(v) for v in e.args)
        return (a.alias, b.alias, name, margin) if name and a.alias != b.alias else None

    # filters: (aliases, column)

    def filter(self, e) -> tuple[set[str], Column]:
        if isinstance(e, Binary) and e.op in ("&&", "||"):
            (a, x), (b, y) = self.filter(e.left), self.filter(e.right)
            return a | b, x & y if e.op == "&&" else x | y
        if isinstance(e, Not):
            a, x = self.filter(e.inner)
            return a, ~x
        if isinstance(e, Binary):
            a, x = self.operand(e.left, e.right)
            b, y = self.operand(e.right, e.left)
            test = {"=": x == y, "!=": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[e.op]
            return a | b, test
        if isinstance(e, Call):
            used, value, boolean = self.call(e)
            if not boolean:
                raise UnsupportedSparql(f"{e.name} returns a value and cannot be a condition")
            return used, value
        raise UnsupportedSparql("this FILTER shape is not supported")

    def bound(self, v: Var) -> Binding:
        if v.name not in self.bindings:
            raise UnsupportedSparql(f"FILTER variable ?{v.name} is not bound")
        return self.bindings[v.name]

    def operand(self, e, other) -> tuple[set[str], Column]:
        if isinstance(e, Var):
            b = self.bound(e)
            if isinstance(other, Literal):
                number = terms.gate(other.value) is not None
            else:
                number = isinstance(other, Call)
            if b.column != "object":
                if number:
                    raise UnsupportedSparql(f"?{e.name} is an IRI and cannot be compared with a number")
                return {b.alias}, F.col(f"{b.alias}_{b.column}")
            if not self.compat and isinstance(other, Var):
                return {b.alias}, b.compare()
            return {b.alias}, F.col(f"{b.alias}_object_" + ("float" if number else "iri" if isinstance(other, Iri) else "string"))
        if isinstance(e, Literal):
            number = terms.gate(e.value)
            return set(), F.lit(number if number is not None else e.value)
        if isinstance(e, Iri):
            return set(), F.lit(e.value)
        if isinstance(e, Call):
            used, value, boolean = self.call(e)
            if boolean:
                raise UnsupportedSparql(f"{e.name} is a condition and cannot be compared")
            return used, value
        raise UnsupportedSparql("this FILTER operand is not supported")

    # geometry

    def call(self, e: Call) -> tuple[set[str], Column, bool]:
        if not e.name.lower().startswith(S.GEOF):
            raise UnsupportedSparql(f'SPARQL function "{e.name.lower()}" is not supported yet')
        name = e.name[len(S.GEOF) :].lower()
        for known in geo.RELATIONS:
            if name == known.lower():
                used, args = self.geometries(e, 2)
                return used, geo.relation(known, *args), True
        if name == "distance":
            if len(e.args) not in (2, 3):
                raise UnsupportedSparql("geof:distance takes two geometries and a unit")
            unit = S.UOM + "degree"
            if len(e.args) == 3:
                if not isinstance(e.args[2], Iri):
                    raise UnsupportedSparql("the unit of geof:distance is an IRI")
                unit = e.args[2].value
            used, args = self.geometries(Call(e.name, e.args[:2]), 2)
            if unit == S.UOM + "degree":
                return used, geo.planar_distance(*args), False
            if unit in (S.UOM + "metre", S.UOM + "meter"):
                return used, geo.sphere_distance(*args), False
            raise UnsupportedSparql(f"unknown unit {unit}")
        raise UnsupportedSparql(f"GeoSPARQL function {e.name} is not supported")

    def geometries(self, e: Call, n: int) -> tuple[set[str], list[Column]]:
        if len(e.args) != n:
            raise UnsupportedSparql(f"{e.name} takes {n} geometries")
        used, out = set(), []
        for a in e.args:
            u, c = self.geometry(a)
            used |= u
            out.append(c)
        return used, out

    def geometry(self, a) -> tuple[set[str], Column]:
        if isinstance(a, Var):
            b = self.bound(a)
            if b.column != "object":
                raise UnsupportedSparql(f"?{a.name} is not the object of a pattern and has no geometry")
            return {b.alias}, F.col(f"{b.alias}_object_geometry")
        if isinstance(a, Literal):
            if a.datatype not in (None, S.WKT_LITERAL, S.XSD + "string"):
                raise UnsupportedSparql(f"a geometry literal is a wktLiteral, not {a.datatype}")
            if not geo.strip_crs(a.value).strip():
                raise UnsupportedSparql("the geometry literal is empty")
            return set(), F.lit(geo.to_wkb(geo.parse_wkt(a.value)))
        if isinstance(a, Call) and a.name.lower().startswith(S.GEOF):
            for name in geo.CONSTRUCTORS:
                if a.name[len(S.GEOF) :].lower() == name.lower():
                    used, args = self.geometries(a, 1)
                    return used, geo.construct(name, args[0])
            for name in geo.SET_OPERATIONS:
                if a.name[len(S.GEOF) :].lower() == name.lower():
                    used, args = self.geometries(a, 2)
                    return used, geo.combine(name, *args)
        raise UnsupportedSparql("this geometry argument is not supported")

    def result(self, default_limit: int = 0) -> DataFrame:
        names = self.query.variables if self.query.variables is not None else list(self.bindings)
        if not names:
            raise UnsupportedSparql("nothing to project")
        missing = [n for n in names if n not in self.bindings]
        if missing:
            raise UnsupportedSparql(f"projected variable ?{missing[0]} is not bound")
        out = self.frame.select([self.bindings[n].show().alias(n) for n in names])
        out = out.distinct() if self.query.distinct else out
        limit = self.query.limit if self.query.limit is not None else default_limit or None
        return out if limit is None else out.limit(limit)


def run(text: str, triples: DataFrame, default_limit: int = 0, compat: bool = True) -> DataFrame:
    """The rows of a query over a triples frame."""
    return Translation(parse(text), triples, compat).result(default_limit)


# ---- visible translation ------------------------------------------------------------------------------------------


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def to_sql(text: str, default_limit: int = 0) -> str:
    """A query as Spark SQL over the view `triples`, as a user may read and run it: each pattern is an aliased scan, shared variables are equal.

    `double_text` and the st_ functions are those that an engine registers.
    """
    query = parse(text)
    Translation(query, _no_triples(S.TRIPLES)).result()  # the same errors as when it runs
    alias_of: dict[str, tuple[str, str]] = {}
    tests: list[str] = []
    compare = lambda b: f"coalesce({b[0]}.object_iri, double_text({b[0]}.object_float), {b[0]}.object_string)" if b[1] == "object" else f"{b[0]}.{b[1]}"
    show = lambda b: compare(b)[:-1] + f", st_astext({b[0]}.object_geometry))" if b[1] == "object" else compare(b)
    for n, triple in enumerate(query.triples):
        for position, node in zip(("subject", "predicate", "object"), triple, strict=True):
            at = (f"t{n}", position)
            if isinstance(node, Var):
                first = alias_of.setdefault(node.name, at)
                if first != at:
                    tests.append(f"{compare(first)} = {compare(at)}")
            elif position != "object":
                tests.append(f"t{n}.{position} = {_quoted(node.value)}")
            elif isinstance(node, Iri):
                tests.append(f"t{n}.object_iri = {_quoted(node.value)}")
            else:
                number = terms.gate(node.value)
                tests.append(f"t{n}.object_float = double({_quoted(str(number))})" if number is not None else f"t{n}.object_string = {_quoted(node.value)}")

    def value(e, other) -> str:
        if isinstance(e, Var):
            b = alias_of[e.name]
            if b[1] != "object":
                return f"{b[0]}.{b[1]}"
            number = isinstance(other, Call) or isinstance(other, Literal) and terms.gate(other.value) is not None
            return f"{b[0]}.object_" + ("float" if number else "iri" if isinstance(other, Iri) else "string")
        if isinstance(e, Literal):
            number = terms.gate(e.value)
            return f"double({_quoted(str(number))})" if number is not None else _quoted(e.value)
        return _quoted(e.value) if isinstance(e, Iri) else call(e)

    def geometry(e) -> str:
        if isinstance(e, Var):
            return f"{alias_of[e.name][0]}.object_geometry"
        return f"st_geomfromtext({_quoted(e.value)})" if isinstance(e, Literal) else call(e)

    def call(e: Call) -> str:
        name = e.name[len(S.GEOF) :].lower().removeprefix("sf")
        if name == "distance":
            name = "distance_sphere" if len(e.args) == 3 and e.args[2].value in (S.UOM + "metre", S.UOM + "meter") else name
        return f"st_{name}({', '.join(geometry(a) for a in e.args[:2])})"

    def condition(e) -> str:
        if isinstance(e, Not):
            return f"NOT ({condition(e.inner)})"
        if isinstance(e, Binary) and e.op in ("&&", "||"):
            return f"({condition(e.left)} {'AND' if e.op == '&&' else 'OR'} {condition(e.right)})"
        if isinstance(e, Binary):
            return f"{value(e.left, e.right)} {'<>' if e.op == '!=' else e.op} {value(e.right, e.left)}"
        return call(e)

    tests += [condition(f) for f in query.filters]
    names = query.variables if query.variables is not None else list(alias_of)
    columns = ", ".join(f"{show(alias_of[n])} AS `{n}`" for n in names)
    out = f"SELECT {'DISTINCT ' if query.distinct else ''}{columns}\nFROM {', '.join(f'triples t{n}' for n in range(len(query.triples)))}"
    out += "\nWHERE " + "\n  AND ".join(tests) if tests else ""
    limit = query.limit if query.limit is not None else default_limit or None
    return out if limit is None else f"{out}\nLIMIT {limit}"


def _no_triples(schema) -> DataFrame:
    from pyspark.sql import SparkSession

    return SparkSession.active().createDataFrame([], schema)
