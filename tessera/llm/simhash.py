"""SimHash near-duplicate groups by anchor-point covering.

Fingerprints are 64-bit majority votes over XXH64 values of word shingles. Two
fingerprints link at THRESHOLD or fewer differing bits; groups are the connected
components, named by their smallest id.

Links are searched between distinct fingerprints only. The anchors are the words
of the perfect binary Golay code of length 23 (4096 words, every 23-bit vector
within COVERING = 3 of exactly one). It is laid over two disjoint 23-bit blocks
of the fingerprint. If two fingerprints differ in at most 3 bits, they differ in
at most 1 bit on one of the blocks. So on each block a fingerprint lives at the
one anchor within 3 of it and is replicated to every anchor within 3 + 1 of it
(5.3 on the average), and whoever is within 1 of it on this block has its home
among them. At an anchor, residents are compared with all that came there.

Anchors that hold many are split by the anchors of the other block, with its
whole threshold of 3, so no task compares an unbounded set. Within a set only the
links of a spanning forest leave the task. Components are found by alternating
minimum labels over links and written tables, never on the driver.

A null or wordless text has fingerprint zero and links like any other. Repeated
rows and repeated ids are kept; rows with a null id get a group of their own
fingerprint's smallest id. Long texts count as a whole, a bit that half of the
shingles have is 0. Columns other than id and text are not read, whatever their
names. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import drop_stored, map_batches, stored

THRESHOLD = 3
COVERING = 3
GOLAY = 0xC75  # generator x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
BLOCKS = (0, 23)  # first bits of the two blocks
SET_ROWS = 4_096  # residents and visitors compared in one piece
HOT_ROWS = 512  # rows of a key that one task may look up, and
HOT_KEYS = 2_000  # one in so many of all rows
SALTS = 32  # tasks that a hot key's rows are dealt to
WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def _golay_words() -> np.ndarray:
    words = np.zeros(1 << 12, np.int64)
    for i in range(12):
        half = 1 << i
        words[half : 2 * half] = words[:half] ^ (GOLAY << i)
    return words


def _flips(weight: int) -> np.ndarray:
    """All 23-bit vectors of a weight."""
    out = np.zeros(1, np.int64)
    top = np.full(1, -1)
    for _ in range(weight):
        bit = np.arange(23)
        pick = bit[None, :] > top[:, None]
        row, b = np.nonzero(pick)
        out, top = out[row] | (np.int64(1) << b), b
    return out


class Anchors:
    """The code's words, the home anchor of each 23-bit vector, and the anchors around it."""

    _tables: tuple | None = None

    @classmethod
    def tables(cls) -> tuple[np.ndarray, np.ndarray]:
        if cls._tables is None:
            words = _golay_words()
            home = np.zeros(1 << 23, np.int16)
            for w in range(COVERING + 1):
                for flip in _flips(w):
                    home[words ^ flip] = np.arange(len(words))
            cls._tables = words, home
        return cls._tables


def home_anchor(block: np.ndarray) -> np.ndarray:
    """The one anchor within COVERING of each 23-bit vector."""
    return Anchors.tables()[1][block].astype(np.int64)


def anchors_within(block: np.ndarray, extra: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) of all anchors within COVERING + extra of each 23-bit vector: the homes of the vectors within extra of it."""
    flips = np.concatenate([_flips(w) for w in range(extra + 1)])
    homes = np.sort(home_anchor(block[:, None] ^ flips[None, :]), axis=1)
    first = np.ones(homes.shape, bool)
    first[:, 1:] = homes[:, 1:] != homes[:, :-1]
    row, column = np.nonzero(first)
    return row, homes[row, column]


def block_of(fp: np.ndarray, first: int) -> np.ndarray:
    return ((fp >> np.uint64(first)) & np.uint64((1 << 23) - 1)).astype(np.int64)


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's word shingles."""
    return int(fingerprints([text], words, seed)[0])


def fingerprints(texts: list[str | None], words: int = 3, seed: int = 42) -> np.ndarray:
    """uint64 SimHashes. A bit is 1 if more than half of the shingles' hashes have it."""
    out = np.zeros(len(texts), np.uint64)
    digest = xxhash.xxh64_digest
    for i, text in enumerate(texts):
        if not text:
            continue
        w = WORD.findall(text.translate(UPPER) if not text.isascii() else text.lower())
        if not w:
            continue
        shingles = [" ".join(w)] if len(w) < words else map(" ".join, zip(*(w[j:] for j in range(words)), strict=False))
        raw = np.frombuffer(b"".join([digest(s, seed) for s in shingles]), np.uint8).reshape(-1, 8)
        total = np.zeros(64, np.int64)
        for at in range(0, len(raw), 1 << 16):
            total += _bit_sums(raw[at : at + (1 << 16)])
        out[i] = np.packbits((2 * total > len(raw)).astype(np.uint8)).view(">u8")[0]
    return out


SPREAD = ((np.arange(256)[:, None] >> np.arange(7, -1, -1)[None, :]) & 1).astype(np.int64)


def _bit_sums(raw: np.ndarray) -> np.ndarray:
    """How many rows of 8 bytes have each of the 64 bits."""
    if len(raw) < 64:
        return np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
    return np.concatenate([np.bincount(raw[:, j], minlength=256) @ SPREAD for j in range(8)])


def fingerprint_column(df: DataFrame, id_col: str, text_col: str, words: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp long): the signed 64-bit fingerprint of every row."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fp = fingerprints(batch.column(1).to_pylist(), words, seed)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    return map_batches(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, fp long")


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, root) of a spanning forest of stars that joins what the given edges join."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = np.minimum(new, new[new])
        new = new[label] if len(new) else new
        if (new == label).all():
            break
        label = new
    node = np.flatnonzero(label != np.arange(n))
    return node, label[node]


def links_of(home: np.ndarray, came: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges that join the fingerprints of a set which link between residents and all that came; residents are among the latter."""
    every, index = np.unique(np.concatenate([home, came]), return_inverse=True)
    h = np.unique(index[: len(home)])
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = max(1, 4_000_000 // max(1, len(every)))
    for at in range(0, len(h), step):
        part = h[at : at + step]
        row, column = np.nonzero(np.bitwise_count(every[part][:, None] ^ every[None, :]) <= threshold)
        row = part[row]
        different = row != column
        x, y = _forest(len(every), row[different], column[different])
        a.append(x)
        b.append(y)
    x, y = _forest(len(every), np.concatenate(a), np.concatenate(b))
    return every[x], every[y]


def _split(home: np.ndarray, came: np.ndarray, first: int, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Compare a large set by the anchors of another block: residents at their home there, visitors at every anchor within the covering
    radius plus the threshold. One anchor at a time, so memory grows with the set and not with the replicas."""
    if len(home) * len(came) <= SET_ROWS * SET_ROWS:
        yield links_of(home, came, threshold)
        return
    words = Anchors.tables()[0].astype(np.uint32)
    mine, block = home_anchor(block_of(home, first)), block_of(came, first).astype(np.uint32)
    by = np.argsort(mine, kind="stable")
    edges = np.searchsorted(mine[by], np.arange(len(words) + 1))
    for a in np.flatnonzero(np.diff(edges)):
        near = np.bitwise_count(block ^ words[a]) <= COVERING + threshold
        yield links_of(home[by[edges[a] : edges[a + 1]]], came[near], threshold)


def anchor_links(fps: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a long, b long): links that join all distinct fingerprints of a frame (fp long) which differ in at most threshold bits."""
    within = threshold // len(BLOCKS)

    def deal(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fp = np.asarray(batch.column(0)).view(np.uint64)
        out_k, out_f, out_h = [], [], []
        for n, first in enumerate(BLOCKS):
            block = block_of(fp, first)
            row, anchor = anchors_within(block, within)
            out_k.append(anchor + n * 4096)
            out_f.append(fp[row])
            out_h.append(anchor == home_anchor(block)[row])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_k).astype(np.int32)), pa.array(np.concatenate(out_f).view(np.int64)), pa.array(np.concatenate(out_h))], ["anchor", "fp", "home"])

    def compare(anchor: int, fp: np.ndarray, home: np.ndarray) -> pd.DataFrame:
        found = list(_split(fp[home], fp, BLOCKS[1 - anchor // 4096], threshold))
        return pd.DataFrame({"a": np.concatenate([x for x, _ in found]).view(np.int64), "b": np.concatenate([y for _, y in found]).view(np.int64)})

    def compare_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The anchors of a partition, one after the other as they come sorted."""
        now, parts = -1, []

        def done() -> Iterator[pd.DataFrame]:
            if parts:
                yield compare(now, np.concatenate([f for f, _ in parts]), np.concatenate([h for _, h in parts]))

        for pdf in batches:
            anchor, fp, home = pdf["anchor"].to_numpy(), pdf["fp"].to_numpy().view(np.uint64), pdf["home"].to_numpy()
            starts = np.flatnonzero(np.diff(anchor, prepend=-1))
            for i, j in zip(starts, [*starts[1:], len(anchor)], strict=True):
                if anchor[i] != now:
                    yield from done()
                    now, parts = int(anchor[i]), []
                parts.append((fp[i:j], home[i:j]))
        yield from done()

    dealt = map_batches(fps.select("fp"), deal, "anchor int, fp long, home boolean")
    met = dealt.repartition("anchor").sortWithinPartitions("anchor")
    return met.mapInPandas(compare_all, "a long, b long").distinct()


def hot_join(rows: DataFrame, key: str, names: DataFrame, name: str, how: str = "inner") -> DataFrame:
    """rows (written, so that they are read twice cheaply) joined with a table in which each name is once.

    A key with more than HOT_ROWS rows and more than one in HOT_KEYS of all is hot; there are at most HOT_KEYS of these. Hot rows are
    dealt to SALTS tasks by all their columns, and the names they look up are copied to each.
    """
    least = max(HOT_ROWS, rows.count() // HOT_KEYS)
    hot = [r[0] for r in rows.groupBy(key).count().filter(F.col("count") > least).select(key).collect()]
    if not hot:
        return rows.join(names, F.col(key) == F.col(name), how)
    salt = lambda c, salted: F.when(F.col(c).isin(hot), salted)
    dealt = rows.withColumn("_salt", F.coalesce(salt(key, F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")), F.lit(0)))
    copies = names.withColumn("_copy", F.explode(F.coalesce(salt(name, F.sequence(F.lit(0), F.lit(SALTS - 1))), F.array(F.lit(0)))))
    return dealt.join(copies, (F.col(key) == F.col(name)) & (F.col("_salt") == F.col("_copy")), how).drop("_salt", "_copy")


def components(vertices: DataFrame, links: DataFrame) -> DataFrame:
    """(fp, least): for each vertex of (fp, least) the smallest value within its component.

    Each round sends every vertex the least label among its neighbours, then
    looks up the label of its label. Rounds are written tables; the loop ends
    when no label changes, after about the logarithm of the longest chain. The
    members of a large group share a label and a neighbour: such keys are dealt
    to several tasks.
    """
    both = stored(links.union(links.select("b", "a")).toDF("a", "b"), "links")
    # labels are fingerprints (a vertex name) during the rounds; unlinked vertices are their own
    labels = stored(both.select("a").distinct().select(F.col("a").alias("v"), F.col("a").alias("l")), "labels")
    while True:
        heard = hot_join(both, "b", labels.select(F.col("v").alias("n"), "l"), "n").groupBy("a").agg(F.min("l").alias("m"))
        near = stored(labels.join(heard, F.col("v") == F.col("a"), "left").select("v", F.least("l", F.coalesce("m", "l")).alias("l"), F.col("l").alias("was")), "near")
        up = near.select(F.col("v").alias("p"), F.col("l").alias("pl"))
        new = stored(hot_join(near, "l", up, "p", "left").select("v", F.least("l", F.coalesce("pl", "l")).alias("l"), "was"), "labels")
        changed = new.filter("l <> was").limit(1).count()
        drop_stored(labels)
        drop_stored(near)
        labels = new.select("v", "l")
        if not changed:
            break
    drop_stored(both)
    named = stored(vertices.join(labels, F.col("fp") == F.col("v"), "left").select("fp", "least", F.coalesce("l", "fp").alias("root")), "roots")
    least = named.groupBy("root").agg(F.min("least").alias("lowest"))
    return hot_join(named.select("fp", "root"), "root", least.withColumnRenamed("root", "_root"), "_root").select("fp", F.col("lowest").alias("least"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, threshold: int = THRESHOLD) -> DataFrame:
    """(id, fp long, least): every row with its fingerprint and the smallest id of its component."""
    rows = stored(fingerprint_column(df, id_col, text_col, words), "fingerprints")
    vertices = rows.groupBy("fp").agg(F.min("id").alias("least"))
    links = anchor_links(vertices, threshold)
    groups = components(vertices, links)
    # one fingerprint may have many rows: the lookup is a join whose large side Spark can split
    return rows.join(groups, "fp").select(F.col("id").alias(id_col), "fp", "least")


def hex_fingerprint(column: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))
