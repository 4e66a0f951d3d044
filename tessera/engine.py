"""The engine: queries, lookups, snapshots and exports on one table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schema as S
from tessera.functions import geo, sinks, terms
from tessera.operators import lookups
from tessera.operators.store import Store
from tessera.plans import samples, sparql


class Engine:
    """Engine(spark, path) over a snapshot store, or Engine(spark, triples=frame) over any frame of triples."""

    def __init__(self, spark: SparkSession, path: str | None = None, triples: DataFrame | None = None):
        self.spark, self.store = spark, Store(spark, path) if path else None
        self._triples = triples
        self.warnings: list[str] = []
        self._unreadable: set[str] = set()
        geo.register(spark)
        spark.sql(terms.DOUBLE_TEXT)
        self.refresh()

    def refresh(self) -> None:
        """Look at the newest snapshot."""
        if self.store is not None:
            self._triples = self.store.as_of()
        S.verify_layout(self._triples)
        self._triples.createOrReplaceTempView("triples")

    @property
    def triples(self) -> DataFrame:
        return self._triples

    def sparql(self, text: str, limit: int = 0) -> DataFrame:
        return sparql.run(text, self._triples, limit)

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text)

    def translated(self, text: str, limit: int = 0) -> str:
        """The SQL that a query stands for."""
        return sparql.to_sql(text, limit)

    def explained(self, text: str) -> str:
        """The physical plan of a query."""
        return self.sparql(text)._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def register_snapshots(self) -> list[str]:
        """Views triples_at_<id> of all snapshots, for queries on the table as it was."""
        names = [f"triples_at_{e['snapshot_id']}" for e in self.store.live()]
        for name in names:
            self.store.as_of(int(name.rsplit("_", 1)[1])).createOrReplaceTempView(name)
        return names

    def sample_queries(self) -> dict[str, str]:
        """Starter queries by name: SPARQL, SQL, and SQL on each snapshot."""
        more = dict(self.store.sample_queries()) if self.store is not None else {}
        return {**{n: samples.starter(n) for n in samples.STARTERS}, **{f"SQL: {n}": q for n, q in samples.SQL_STARTERS.items()}, **more}

    def modules(self) -> list[str]:
        return self.store.modules()

    def ontologies(self, pins: DataFrame) -> DataFrame:
        """Pinned documents (ontology, version, format) and the ontologies that the triples import."""
        imported = self._triples.filter((F.col("predicate") == S.OWL + "imports") & F.col("object_iri").isNotNull()).select(F.col("object_iri").alias("ontology"))
        return lookups.ontologies(pins, imported)

    def register_imports(self, paths: list[tuple[str, str]]) -> list[str]:
        """Views over imported tables (artifact, path); one that cannot be read is left out with a warning."""
        names, frames = lookups.view_names(paths), {}
        for name, (_, path) in zip(names, paths, strict=True):
            if path in self._unreadable:
                continue  # it was tried, and warned about
            try:
                df = self.spark.read.parquet(path)
                df.createOrReplaceTempView(name)
                frames[name] = df
            except Exception as e:  # noqa: BLE001 any reader's error: the main query must go on
                self._unreadable.add(path)
                self.warnings.append(f"import {name} is left out: {str(e).splitlines()[0]}")
        if frames:
            lookups.stacked_imports(frames).createOrReplaceTempView("imports")
        return list(frames)

    def classes(self) -> DataFrame:
        return lookups.classes(self._triples)

    def datatypes(self) -> DataFrame:
        return lookups.datatypes(self._triples)

    def instances(self) -> DataFrame:
        return lookups.instances(self._triples)

    def properties(self) -> DataFrame:
        return lookups.properties(self._triples)

    def shapes(self) -> DataFrame:
        return lookups.shapes(self._triples)

    def describe(self, subject: str, base: str = "") -> DataFrame:
        return lookups.describe(self._triples, lookups.resolve_subject(subject, base))

    def stats(self) -> dict:
        return {"counts": lookups.counts(self._triples).first().asDict(), "predicates": lookups.by_predicate(self._triples), "columns": lookups.column_stats(self._triples)}

    def geometries(self, bbox: str | None = None, limit: int = 1000, offset: int = 0) -> DataFrame:
        return lookups.geometries(self._triples, bbox, limit, offset)

    def extent(self) -> DataFrame:
        return lookups.extent(self._triples)

    def snapshots(self) -> DataFrame:
        return self.store.snapshots()

    def diff(self, snapshot: str | int = "latest") -> DataFrame:
        return self.store.diff(snapshot)

    def as_of(self, snapshot_id: int) -> DataFrame:
        return self.store.as_of(snapshot_id).orderBy("triple_hash")

    def export_ntriples(self, path: str) -> None:
        sinks.write_ntriples(self._triples, path)
