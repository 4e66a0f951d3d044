"""Structured Streaming ingest of N-Triples lines (an extension: the batch build is the main path)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.functions import terms
from tessera.operators.store import Store
from tessera.sources import rdf


def append_batch(store: Store, batch: DataFrame) -> None:
    """Add a micro-batch's triples to the table; triples that are there already change nothing. Only new rows are written.

    A hash does not tell an IRI from an equal text, so a batch is made distinct on all columns.
    """
    store.append(terms.split_terms(batch).distinct())


def stream_ntriples(spark: SparkSession, source: str, table: str, checkpoint: str):
    """Start a query that appends the N-Triples files arriving in a folder; one commit a micro-batch."""
    lines = spark.readStream.text(source)
    store = Store(spark, table)

    def each(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            append_batch(store, rdf.ntriples_terms(batch))

    return lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
