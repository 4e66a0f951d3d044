"""Conflict-constrained best-fit packing of documents into training sequences.

Units are UTF-8 bytes plus one end mark a document. A document longer than the
capacity is cut into pieces of capacity; pieces are packed by decreasing size.
Two pieces of one bin may have neither the same source nor the same duplicate
cluster (equal texts, or a given column). Open bins are ordered by what is left
of them and carry a bitmap of sources and a bitmap of clusters. A piece starts
at the first bin that is large enough and goes from successor to successor until
the tightest compatible one is found; if there is none, it opens a bin.

Pieces are dealt out by a hash to packing shards of a bounded number of pieces,
each packed by itself: a source with a third of all rows, one very long document
and repeated rows are spread evenly (equal rows are counted, and their copies
numbered), and the loss is a part of the last open bins of each shard.

Null sources and null clusters conflict with nothing; null and empty texts are
one end mark long. Repeated rows are packed each for itself. Pieces of equal
length are taken by id and piece. Columns other than the named ones are not read,
whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored

CAPACITY = 32_768
SHARD_ROWS = 8_192  # pieces
COPIES = 1 << 16  # of one row that a task numbers
SCAN = 64  # bins of the first look; each further look is twice as long


def best_fit(size: np.ndarray, source: np.ndarray, cluster: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece. source, cluster: small codes, -1 for none."""
    n = len(size)
    # only clusters with several pieces can conflict
    count = np.bincount(cluster[cluster >= 0], minlength=1)
    several = np.flatnonzero(count > 1)
    code = np.full(len(count), -1, np.int64)
    code[several] = np.arange(len(several))
    cluster = np.where(cluster >= 0, code[np.maximum(cluster, 0)], -1)
    words = [int(c.max(initial=-1)) // 64 + 1 for c in (source, cluster)]
    maps = [np.zeros((n, max(1, w)), np.uint64) for w in words]
    codes = (source, cluster)
    left, order = np.zeros(n, np.int64), np.zeros(n, np.int64)  # what is left, ascending, and the bins in this order
    opened, used = 0, 0
    bins, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.lexsort((np.arange(n), -size)):
        need = size[i]
        at = int(np.searchsorted(left[:used], need))
        found, step = -1, SCAN
        tests = [(m, c[i] >> 6, np.uint64(1 << (int(c[i]) & 63))) for m, c in zip(maps, codes, strict=True) if c[i] >= 0]
        while at < used:
            some = order[at : min(at + step, used)]
            clash = np.zeros(len(some), bool)
            for m, word, bit in tests:
                clash |= (m[some, word] & bit) != 0
            hit = int(clash.argmin())
            if not clash[hit]:
                found = at + hit
                break
            at += len(some)
            step *= 2
        if found < 0:
            b, rest = opened, capacity
            opened += 1
        else:
            b, rest = int(order[found]), int(left[found])
            left[found : used - 1] = left[found + 1 : used]
            order[found : used - 1] = order[found + 1 : used]
            used -= 1
        bins[i], offset[i] = b, capacity - rest
        for m, word, bit in tests:
            m[b, word] |= bit
        rest -= need
        if rest > 0:
            to = int(np.searchsorted(left[:used], rest))
            left[to + 1 : used + 1] = left[to:used]
            order[to + 1 : used + 1] = order[to:used]
            left[to], order[to] = rest, b
            used += 1
    return bins, offset


def pack_documents(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """(bin_id, position, id, piece, start, length, bin_offset, source): every byte of every document in one bin."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(
        F.col(id_col).alias("id"), (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("units"), F.col(source_col).cast("string").alias("source"),
        (F.col(cluster_col).cast("string") if cluster_col else F.md5(F.col(text_col).cast("binary"))).alias("cluster"),
    )
    # equal rows are one until they are dealt out
    counted = stored(rows.groupBy("id", "units", "source", "cluster").agg(F.count(F.lit(1)).alias("n")), "packing-rows")
    total, most = counted.agg(F.coalesce(F.sum(F.expr(f"n * ((units + {capacity - 1}L) div {capacity}L)")), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    shards = max(1, -(-total // shard_rows))
    copies = counted.withColumn("run", F.explode(F.expr(f"sequence(0L, (n - 1) div {COPIES}L)")))
    if most > COPIES:
        copies = copies.repartition("id", "cluster", "run")
    copies = copies.withColumn("copy", F.explode(F.expr(f"sequence(run * {COPIES}L, least(n, (run + 1) * {COPIES}L) - 1)")))
    pieces = copies.select("id", "units", "source", "cluster", "copy", F.posexplode(F.expr(f"sequence(0L, units - 1, {capacity}L)")).alias("piece", "start")).withColumn("length", F.least(F.lit(capacity), F.col("units") - F.col("start")))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("id", "piece", "cluster", "copy"), F.lit(shards)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "piece", "length", "cluster", "copy"], kind="stable", ignore_index=True)
        bins, offset = best_fit(pdf["length"].to_numpy(), pd.factorize(pdf["source"])[0], pd.factorize(pdf["cluster"])[0], capacity)
        out = pd.DataFrame({"bin_id": bins + int(pdf["shard"].iloc[0]) * (1 << 32), "id": pdf["id"], "piece": pdf["piece"], "start": pdf["start"], "length": pdf["length"], "bin_offset": offset, "source": pdf["source"]})
        out = out.sort_values(["bin_id", "bin_offset"], ignore_index=True)
        out.insert(1, "position", out.groupby("bin_id").cumcount())
        return out

    schema = f"bin_id long, position long, id {kind}, piece int, start long, length long, bin_offset long, source string"
    return dealt.groupBy("shard").applyInPandas(run, schema).withColumnRenamed("id", id_col)


def packed_texts(bins: DataFrame, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bin_id, length, payload): each bin's pieces on end, every document closed by byte 0; ids must be unique."""
    raw = bins.join(df.select(id_col, F.concat(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), F.lit(b"\0")).alias("_raw")), id_col)
    piece = F.expr("substring(_raw, cast(start + 1 as int), cast(length as int))")
    return raw.groupBy("bin_id").agg(F.sum("length").alias("length"), F.sort_array(F.collect_list(F.struct("position", piece.alias("raw")))).alias("_parts")).select("bin_id", "length", F.expr("aggregate(transform(_parts, p -> p.raw), cast('' as binary), (a, b) -> concat(a, b))").alias("payload"))


def bins_of(rows: Iterator) -> dict:
    """Rows by bin, for tests and small results."""
    out: dict = {}
    for r in rows:
        out.setdefault(r["bin_id"], []).append(r)
    return out
