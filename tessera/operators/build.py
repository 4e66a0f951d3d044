"""The build: read, merge ontologies, run checks, name blank nodes, and commit, in one go.

Pins are documents that a project depends on, kept by content under their SHA-256
in a folder, with a lock file that says which address has which digest. Everything
here that walks files runs on the driver: projects' sources are few and small; the
triples themselves stay frames.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from pathlib import Path
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schema as S
from tessera.functions import terms as T
from tessera.operators import modules, validate
from tessera.operators.store import Store
from tessera.schema import TesseraError
from tessera.sources import linked

ACCEPT = "text/turtle, application/n-triples;q=0.9, application/ld+json;q=0.8, application/rdf+xml;q=0.7, */*;q=0.1"
DCTERMS = "http://purl.org/dc/terms/"


class Invalid(TesseraError):
    """The sources have violations; all of them are in the message."""


def fingerprint(paths: list[str]) -> str:
    """SHA-256 over the files' bytes, one after the other in the order of their paths."""
    digest = hashlib.sha256()
    for p in sorted(paths):
        with open(p, "rb") as f:
            while part := f.read(1 << 20):
                digest.update(part)
    return digest.hexdigest()


def fetched(address: str, timeout: float = 30.0) -> tuple[bytes, str]:
    """A document and its media type, asked for in the order of formats that are read best."""
    with urlopen(Request(address, headers={"Accept": ACCEPT}), timeout=timeout) as answer:  # noqa: S310 addresses come from the project's own sources
        return answer.read(), answer.headers.get_content_type()


class Pins:
    """Documents kept by content: <folder>/<sha256>, and <folder>/lock.json with what each address stood for."""

    def __init__(self, folder: str, fetch: Callable[[str], tuple[bytes, str]] = fetched, bundled: dict[str, tuple[bytes, str]] | None = None):
        self.folder, self.fetch, self.bundled = Path(folder), fetch, bundled or {}
        lock = self.folder / "lock.json"
        self.entries: dict[str, dict] = json.loads(lock.read_text()) if lock.is_file() else {}

    def get(self, address: str) -> tuple[bytes, str]:
        """The pinned document; one that is new, missing or damaged is fetched, and a bundled one stands in for what cannot be read."""
        entry = self.entries.get(address)
        if entry:
            file = self.folder / entry["sha256"]
            if file.is_file() and hashlib.sha256(data := file.read_bytes()).hexdigest() == entry["sha256"]:
                return data, entry["format"]
        try:
            data, kind = self.fetch(address)
        except OSError as e:
            if address not in self.bundled:
                raise TesseraError(f"{address} cannot be read: {e}") from e
            data, kind = self.bundled[address]
        digest = hashlib.sha256(data).hexdigest()
        if entry and entry["sha256"] != digest:
            raise TesseraError(f"{address} has changed since it was pinned as {entry['sha256']}")
        self.folder.mkdir(parents=True, exist_ok=True)
        (self.folder / digest).write_bytes(data)
        self.entries[address] = {"sha256": digest, "format": kind, "modified": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())}
        (self.folder / "lock.json").write_text(json.dumps(self.entries, indent=1, sort_keys=True))
        return data, kind

    def terms(self, spark: SparkSession, address: str) -> DataFrame:
        data, kind = self.get(address)
        return spark.createDataFrame([r[1:] for r in linked.parse_any(data.decode("utf-8-sig"), kind, address)], S.TERMS)

    def listing(self, spark: SparkSession) -> DataFrame:
        """(ontology, version, format) of what is pinned."""
        return spark.createDataFrame([(a, e["sha256"], e["format"]) for a, e in sorted(self.entries.items())], "ontology string, version string, format string")


def provenance(pins: DataFrame) -> DataFrame:
    """Terms that state each pinned document (ontology, version, format, modified): its type, version, and where known its format and date."""
    def line(p, kind, o, datatype=None):
        return F.struct(F.lit("iri").alias("s_kind"), F.col("ontology").alias("s"), F.lit(p).alias("p"), F.lit(kind).alias("o_kind"), o.alias("o"), F.lit(datatype).cast("string").alias("o_datatype"), F.lit(None).cast("string").alias("o_lang"))

    lines = [
        line(S.RDF_TYPE, "iri", F.lit(S.OWL + "Ontology")), line(S.OWL + "versionIRI", "iri", F.concat(F.lit("urn:sha256:"), F.col("version"))), line(DCTERMS + "format", "literal", F.col("format")),
        line(DCTERMS + "modified", "literal", F.col("modified"), S.XSD + "dateTime"), line(S.RDFS + "comment", "literal", F.concat(F.lit("The copy of "), F.col("ontology"), F.lit(" as of "), F.col("modified"), F.lit(" that this project is checked against."))),
    ]
    return pins.select(F.explode(F.array(*lines)).alias("t")).select("t.*").filter("o is not null and o <> ''").select(S.TERMS.fieldNames())


def imports_of(graph: DataFrame) -> DataFrame:
    """(ontology, imported): the import statements of a terms frame."""
    return graph.filter((F.col("p") == S.OWL + "imports") & (F.col("o_kind") == "iri")).select(F.col("s").alias("ontology"), F.col("o").alias("imported"))


def without_imports(graph: DataFrame, imported: list[str]) -> DataFrame:
    """The terms less the import statements of some addresses, whatever they are about."""
    return graph.filter(~((F.col("p") == S.OWL + "imports") & (F.col("o_kind") == "iri") & F.col("o").isin(imported)))


def with_ontologies(graph: DataFrame, fetch: Callable[[str], DataFrame], is_artifact: Callable[[str], bool] = lambda iri: False) -> DataFrame:
    """The terms with those of the imported ontologies; an import of an artifact is no ontology, and its statement goes."""
    wanted = sorted({r["imported"] for r in imports_of(graph).distinct().collect()})
    artifacts = [i for i in wanted if is_artifact(i)]
    graph = without_imports(graph, artifacts) if artifacts else graph
    return modules.merged(graph, *(fetch(i) for i in wanted if i not in artifacts))


def build(
    spark: SparkSession, source: str, table: str, base: str = "", tag: str | None = None, vocabulary: DataFrame | None = None, namespaces: dict[str, str] | None = None, fetch: Callable[[str], DataFrame] | None = None,
    extra: DataFrame | None = None, properties: dict[str, str] | None = None, prefix: str = validate.BLANK,
) -> dict:
    """Read the sources below a folder, merge, check and commit; the commit's entry.

    vocabulary (iri) and namespaces ask for a check of terms; fetch reads imported ontologies; extra are more terms, as of modules or
    provenance. Blank nodes are named by what they are linked to, so moved lines change nothing.
    """
    graph = linked.read_rdf(spark, source, base)
    if namespaces is not None:
        used = linked.used_terms(spark, source, base)
        bad = validate.undefined_terms(used, vocabulary if vocabulary is not None else used.select("iri").limit(0), namespaces, base)
        messages = [r["message"] for r in bad.collect()]
        messages += [r["message"] for r in linked.jsonld_problems(spark, source, base).collect()]
        if messages:
            raise Invalid("\n".join(messages))
    if fetch is not None:
        graph = with_ontologies(graph, fetch)
    if extra is not None:
        graph = modules.merged(graph, extra)
    return Store(spark, table).write(T.split_terms(validate.stable_blank_nodes(graph, prefix)).dropDuplicates(["triple_hash", "object_iri"]), properties, tag)
