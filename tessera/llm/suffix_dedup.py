"""Removal of repeated byte strings across documents by suffix arrays.

A byte goes if a string of LENGTH bytes that covers it also starts in a document
with a smaller id; strings never cross documents, and are judged on the input.

Comparing every shard's suffix array with every other's does not scale, so shards
are made of text that can match at all. Every LENGTH-byte string contains an
anchor: a GRAM-byte string whose hash is least among those of the string, so equal
strings have equal anchors at equal places.

1. Documents are packed into blocks of bounded bytes, written to the shared folder.
2. A block sends its distinct anchor hashes, dealt by hash. Hashes that two blocks
   have go back to them; with those that two documents of one block have, these are
   the shared anchors; a string whose anchor is not shared is in one document only.
3. Around each shared anchor a block cuts the context that the LENGTH-byte strings
   with this anchor span. Equal contexts of a block are sent once, with their least
   and greatest ids.
4. Where an anchor has one context, all its strings belong to the least id. Where it
   has several, the contexts of a task form shards; each gets a suffix array by
   Larsson-Sadakane refinement and common prefixes by Kasai's method, and the shards'
   sorted strings are merged by binary search. The least id of each string goes
   back to the blocks.
5. Each block marks the bytes and cuts them.

A passage that a third of all rows share is one row a block, not one a document.
Null and empty texts have no bytes. Rows of equal id do not remove from each other;
rows without an id neither remove nor lose. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import release, slices, stored, utf8

LENGTH = 50
GRAM = 24
SPAN = LENGTH - GRAM + 1  # grams of a string
BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 12 << 20  # text whose anchors meet in one bucket, about
SHARD_BYTES = 1 << 20  # context bytes of one suffix array
NO_ID = np.int64(2**63 - 1)


# ---- suffix arrays ----------------------------------------------------------------------------------------------


def _words(text: np.ndarray) -> np.ndarray:
    """The 8 bytes at each place, the first one highest; zeros past the end."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    return np.ndarray((len(text),), "<u8", padded, 0, (1,)).byteswap()


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The suffix array of a text, by Larsson-Sadakane refinement.

    Ranks by 8 bytes are doubled in reach; each round sorts only the groups that
    are not single yet, by the rank of the place h further on. Group and that rank
    are one number, so each sort is of plain numbers and need not be stable.
    """
    n = len(text)
    words = _words(text)
    order = np.argsort(words)
    words = words[order]
    first = np.ones(n + 1, bool)
    first[1:-1] = words[1:] != words[:-1]
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(first[:-1], np.arange(n, dtype=np.int32), np.int32(0)))
    open_ = np.arange(n)
    step = 8
    while len(open_ := open_[~(first[open_] & first[open_ + 1])]):  # places whose group has several
        at = order[open_]
        follow = at + step
        tail = np.where(follow < n, rank[np.minimum(follow, n - 1)], n - 1 - follow)  # past the end: the shorter one first
        key = (rank[at].astype(np.int64) << 32) + (tail + step)
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[open_] = at
        new_first = np.ones(len(open_), bool)
        new_first[1:] = key[1:] != key[:-1]
        first[open_] = new_first
        rank[at] = np.maximum.accumulate(np.where(new_first, open_, 0))
        step *= 2
    return order


LANE = 64  # places that Kasai's method goes through one after the other


def common_prefixes(text: np.ndarray, order: np.ndarray, cap: int = LENGTH) -> np.ndarray:
    """Kasai's method: the common prefix (at most cap) of each suffix of the order with the one before it.

    The text is cut into lanes; all lanes go one place a step, each keeping its
    prefix less one from step to step, and compare 8 bytes at once.
    """
    n = len(order)
    lcp = np.zeros(n, np.int64)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    words = _words(text).byteswap()  # the first byte lowest
    lanes = np.arange(0, n, LANE)
    h = np.zeros(len(lanes), np.int64)
    for step in range(min(LANE, n)):
        place = lanes + step
        place = place[place < n]
        r = rank[place]
        before = order[np.maximum(r - 1, 0)]
        now = np.where(r > 0, np.maximum(h[: len(place)] - 1, 0), 0)
        room = np.minimum(cap, n - np.maximum(place, before))
        grow = np.flatnonzero((r > 0) & (now < room))
        while len(grow):
            differ = words[place[grow] + now[grow]] ^ words[before[grow] + now[grow]]
            now[grow] += np.bitwise_count(~differ & (differ - np.uint64(1))) >> 3  # bytes below the lowest bit that differs
            grow = grow[(differ == 0) & (now[grow] < room[grow])]
        now = np.minimum(now, room)
        lcp[r] = np.where(r > 0, now, 0)
        h[: len(place)] = now
    return lcp


@dataclass
class Shard:
    """Sorted distinct strings of a shard of contexts, with their least ids."""

    keys: np.ndarray  # the strings
    least: np.ndarray
    order: np.ndarray  # places, sorted
    string: np.ndarray  # of each place in the order


def shard_strings(text: np.ndarray, start: np.ndarray, size: np.ndarray, least: np.ndarray) -> Shard:
    """Suffix array of contexts: text[start:start+size] each, whose least id is given. Consecutive, at least LENGTH bytes each."""
    count = size - LENGTH + 1
    places = np.repeat(start, count) + _within(count)
    owner = np.full(len(text), NO_ID)
    owner[places] = np.repeat(least, count)
    order = suffix_order(text)
    string = np.cumsum(common_prefixes(text, order) < LENGTH)
    starts = np.zeros(len(text), bool)
    starts[places] = True  # strings do not run from one context into the next
    starts = starts[order]
    order, string = order[starts], string[starts]
    _, first, string = np.unique(string, return_index=True, return_inverse=True)
    rows = np.lib.stride_tricks.as_strided(text, (len(text) - LENGTH + 1, LENGTH), (1, 1))
    keys = np.ascontiguousarray(rows[order[first]]).view(f"S{LENGTH}").ravel()
    return Shard(keys, np.minimum.reduceat(owner[order], first), order, string)


def merge_shards(shards: list[Shard]) -> None:
    """Give equal strings of different shards their common least id: each shard's sorted strings are found in the others' by binary search."""
    for i, a in enumerate(shards):
        for b in shards[:i]:
            small, large = (a, b) if len(a.keys) < len(b.keys) else (b, a)
            if not len(small.keys):
                continue
            at = np.minimum(np.searchsorted(large.keys, small.keys), len(large.keys) - 1)
            hit = np.flatnonzero(large.keys[at] == small.keys)
            both = np.minimum(small.least[hit], large.least[at[hit]])
            small.least[hit], large.least[at[hit]] = both, both


def _within(count: np.ndarray) -> np.ndarray:
    """0, 1, ... count - 1 for each count."""
    total = int(count.sum())
    return np.arange(total) - np.repeat(np.cumsum(count) - count, count)


# ---- blocks and anchors -----------------------------------------------------------------------------------------


@dataclass
class Block:
    ids: np.ndarray
    sound: np.ndarray  # has an id
    size: np.ndarray
    text: np.ndarray
    rest: bytes  # the rows' other columns, as an Arrow stream

    @property
    def start(self) -> np.ndarray:
        return np.cumsum(self.size) - self.size


def _packed(ids: list, raw: list[bytes], rest: bytes = b"") -> bytes:
    sound = np.array([i is not None for i in ids], np.uint8)
    head = np.array([0 if i is None else i for i in ids], "<i8").tobytes() + sound.tobytes() + np.array([len(r) for r in raw], "<i8").tobytes()
    return len(ids).to_bytes(8, "little") + len(rest).to_bytes(8, "little") + zstandard.ZstdCompressor(level=3).compress(rest + head + b"".join(raw))


def _unpacked(data: bytes) -> Block:
    n, other = int.from_bytes(data[:8], "little"), int.from_bytes(data[8:16], "little")
    whole = zstandard.ZstdDecompressor().decompress(data[16:])
    body = np.frombuffer(whole, np.uint8, offset=other)
    return Block(body[: 8 * n].copy().view("<i8"), body[8 * n : 9 * n].astype(bool), body[9 * n : 17 * n].copy().view("<i8"), body[17 * n :], whole[:other])


def blocks_of(df: DataFrame, id_col: str, text_col: str, others: list[str]) -> DataFrame:
    """(block, data, bytes): rows packed into blocks of bounded bytes, in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, BLOCK_BYTES):
                rest = b""
                if part.num_columns > 2:
                    columns = part.select(list(range(2, part.num_columns)))
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, columns.schema) as writer:
                        writer.write_batch(columns)
                    rest = sink.getvalue().to_pybytes()
                data = _packed(part.column(0).to_pylist(), [utf8(t) for t in part.column(1).to_pylist()], rest)
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([data], pa.binary()), pa.array([len(data)], pa.int64())], ["block", "data", "bytes"])
                number += 1
                release()

    chosen = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(others)))
    return stored(chosen.mapInArrow(run, "block long, data binary, bytes long"), "blocks")


def _slide(x: np.ndarray, span: int, best) -> np.ndarray:
    """best over x[i:i+span] for each i; the result is span - 1 shorter."""
    done = 1
    while done < span:
        step = min(done, span - done)
        x = best(x[:-step], x[step:])
        done += step
    return x


@dataclass
class Anchors:
    place: np.ndarray
    hash: np.ndarray
    rank: np.ndarray  # what a string takes the least of
    least: np.ndarray  # of the string that starts at each place; 0 where none may start


CHUNK = 1 << 16  # bytes whose grams are hashed together: what a core's cache holds


def _chunks(block: Block) -> Iterator[tuple[int, int]]:
    """Runs of whole documents of about CHUNK bytes: (from, to) in the text."""
    end = np.cumsum(block.size)
    at = 0
    while at < len(block.text):
        i = int(np.searchsorted(end, at + CHUNK, "right"))
        to = int(end[i - 1]) if i and end[i - 1] > at else int(end[min(i, len(end) - 1)])
        yield at, to
        at = to


def anchors(block: Block) -> Anchors:
    """The block's anchors, by place."""
    n = len(block.text)
    strings = np.zeros(n + 1, np.int8)  # where a string may start: in long documents with an id, LENGTH before the end at least
    long = np.flatnonzero((block.size >= LENGTH) & block.sound)
    start = block.start
    strings[start[long]] += 1
    np.add.at(strings, start[long] + block.size[long] - LENGTH + 1, -1)
    strings = np.cumsum(strings, dtype=np.int8, out=strings)[:-1].view(bool)
    least = np.zeros(n, np.uint32)
    places, hashes, ranks = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)]
    for a, b in _chunks(block):
        if b - a < LENGTH:
            continue
        eight = np.ndarray((b - a - 7,), "<u8", np.ascontiguousarray(block.text[a:b]), 0, (1,)).copy()
        h = eight[:-16] * np.uint64(0x9E3779B97F4A7C15) ^ (eight[8:-8] + np.uint64(0x165667B19E3779F9)) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
        h = (h ^ eight[16:]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        r = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1)
        low = _slide(r, SPAN, np.minimum)
        low = np.where(strings[a : a + len(low)], low, np.uint32(0))
        # a gram is an anchor if it is the least of some string that holds it
        most = _slide(np.concatenate([np.zeros(SPAN - 1, np.uint32), low, np.zeros(SPAN - 1, np.uint32)]), SPAN, np.maximum)
        place = np.flatnonzero(most == r)
        least[a : a + len(low)] = low
        places.append(place + a)
        hashes.append(h[place])
        ranks.append(r[place])
    return Anchors(np.concatenate(places), np.concatenate(hashes), np.concatenate(ranks), least)


def _owner(block: Block, place: np.ndarray) -> np.ndarray:
    """The document of each place; empty documents own none."""
    end = np.cumsum(block.size)
    return np.searchsorted(end, place, "right")


def _by_bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def _distinct(h: np.ndarray) -> np.ndarray:
    """The different numbers, sorted: numpy's unique() hashes them one by one."""
    h = np.sort(h)
    return h[np.append(True, h[1:] != h[:-1])] if len(h) else h


def shared_anchors(block: Block, found: Anchors, replies: list[tuple[int, bytes]], bits: int) -> np.ndarray:
    """Which anchors two documents of different ids have: of the block, or of another one by its replies."""
    shared = np.zeros(len(found.hash), bool)
    if not len(shared):
        return shared
    by = np.argsort(found.hash)
    h, ids = found.hash[by], block.ids[_owner(block, found.place)][by]
    same = h[1:] == h[:-1]
    group = np.concatenate([[0], np.cumsum(~same)])
    several = np.zeros(group[-1] + 1, bool)
    several[group[1:][same & (ids[1:] != ids[:-1])]] = True
    hit = several[group]
    if replies:
        full = np.sort(np.concatenate([(np.uint64(b) << np.uint64(32)) | np.frombuffer(d, "<u4") for b, d in replies]))
        mine = (_by_bucket(h, bits).astype(np.uint64) << np.uint64(32)) | _short(h, bits)  # in the order of h
        hit |= full[np.minimum(np.searchsorted(full, mine), len(full) - 1)] == mine
    shared[by] = hit
    return shared


def anchor_rows(blocks: DataFrame, bits: int) -> DataFrame:
    """(bucket, block, hashes): the distinct anchor hashes of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = _distinct(anchors(_unpacked(data)).hash)
                release()
                if not len(h):
                    continue
                bucket = _by_bucket(h, bits)
                names, first = np.unique(bucket, return_index=True)
                parts = np.split(h, first[1:])
                cut = [_short(p, bits).tobytes() for p in parts]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([number] * len(names), pa.int64()), pa.array(cut, pa.binary())], ["bucket", "block", "hashes"])

    return blocks.mapInArrow(run, "bucket long, block long, hashes binary")


def _short(h: np.ndarray, bits: int) -> np.ndarray:
    """The 32 bits after the bucket's: they tell hashes of a bucket apart; a clash only makes a context more."""
    return ((h << np.uint64(bits)) >> np.uint64(32)).astype("<u4")


def shared_rows(rows: DataFrame, buckets: int) -> DataFrame:
    """(block, bucket, hashes): hashes that two blocks or more have, for each of these blocks."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        release()
        parts = [np.frombuffer(d, "<u4") for d in pdf["hashes"]]
        size = np.array([len(p) for p in parts])
        h, row = np.concatenate(parts), np.repeat(np.arange(len(parts)), size)
        by = np.argsort(h, kind="stable")
        hs = h[by]
        same = np.zeros(len(hs), bool)
        same[1:] = hs[1:] == hs[:-1]
        same[:-1] |= same[1:]
        keep = np.sort(by[same])
        got = np.split(h[keep], np.searchsorted(row[keep], np.arange(1, len(parts))))
        out = [g.tobytes() for g in got]
        return pd.DataFrame({"block": pdf["block"], "bucket": pdf["bucket"], "hashes": out})[[len(o) > 0 for o in out]]

    return rows.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(run, "block long, bucket long, hashes binary")


LEADS = [bytes((i,)) for i in range(256)]


@dataclass
class Contexts:
    """The contexts of a block: where they are and which are equal."""

    start: np.ndarray
    size: np.ndarray
    doc: np.ndarray
    key: np.ndarray  # anchor hash
    lead: np.ndarray  # bytes before the anchor


def contexts(block: Block, replies: list[tuple[int, bytes]], bits: int) -> Contexts:
    """The strings whose anchor is shared: for each such anchor the run of strings of which it is the least gram."""
    found = anchors(block)
    shared = shared_anchors(block, found, replies, bits)
    place, rank = found.place[shared], found.rank[shared]
    least = np.concatenate([np.zeros(SPAN - 1, np.uint32), found.least, np.zeros(1, np.uint32)])  # no rank is 0
    near, far = np.full(len(place), SPAN, np.uint8), np.zeros(len(place), np.uint8)
    for back in range(SPAN):
        ok = least[place + (SPAN - 1 - back)] == rank
        near = np.minimum(near, np.where(ok, np.uint8(back), np.uint8(SPAN)))
        far = np.where(ok, np.uint8(back), far)
    low, high = place - far, place - near
    return Contexts(low, high - low + LENGTH, _owner(block, place), found.hash[shared], place - low)


def context_groups(block: Block, c: Contexts) -> tuple[np.ndarray, np.ndarray]:
    """(group, first): the number of each context's class of equal contexts, and one context of each class."""
    text = block.text.tobytes()
    known: dict[bytes, int] = {}
    # the anchor is where the lead says, so its hash need not be compared
    names = (text[a:b] + LEADS[lead] for a, b, lead in zip(c.start.tolist(), (c.start + c.size).tolist(), c.lead.tolist(), strict=True))
    group = np.fromiter((known.setdefault(name, len(known)) for name in names), np.int64, len(c.start))
    fresh = np.ones(len(group), bool)
    fresh[1:] = group[1:] > np.maximum.accumulate(group)[:-1]
    return group, np.flatnonzero(fresh)


ENTRY = np.dtype([("key", "<u8"), ("name", "<u4"), ("least", "<i8"), ("most", "<i8"), ("lead", "u1"), ("size", "u1")])
RUN = np.dtype([("name", "<u4"), ("from", "u1"), ("to", "u1"), ("least", "<i8")])


def _squeezed(entry: np.ndarray) -> bytes:
    """Entries column by column, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(entry[f].tobytes() for f in ENTRY.names))


def _entries(data: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, at = len(raw) // ENTRY.itemsize, 0
    entry = np.zeros(n, ENTRY)
    for f in ENTRY.names:
        kind = ENTRY[f]
        entry[f] = np.frombuffer(raw, kind, n, at)
        at += n * kind.itemsize
    return entry


def context_rows(blocks: DataFrame, bits: int) -> DataFrame:
    """(bucket, block, entries, bytes): the distinct contexts of each block with their least and greatest ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data, replies in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                release()
                block = _unpacked(data)
                c = contexts(block, [(r["bucket"], r["hashes"]) for r in replies or []], bits)
                group, first = context_groups(block, c)
                if not len(first):
                    continue
                ids = block.ids[c.doc]
                entry = np.zeros(len(first), ENTRY)
                entry["key"], entry["name"], entry["lead"], entry["size"] = c.key[first], np.arange(len(first)), c.lead[first], c.size[first]
                entry["least"], entry["most"] = NO_ID, -NO_ID
                np.minimum.at(entry["least"], group, ids)
                np.maximum.at(entry["most"], group, ids)
                bucket = _by_bucket(entry["key"], bits)
                by = np.argsort(bucket, kind="stable")
                names, at = np.unique(bucket[by], return_index=True)
                out_e, out_b = [], []
                for rows in np.split(by, at[1:]):
                    size = c.size[first[rows]]
                    where = np.repeat(c.start[first[rows]], size) + _within(size)
                    out_e.append(_squeezed(entry[rows]))
                    out_b.append(zstandard.ZstdCompressor(level=3).compress(block.text[where].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([number] * len(names), pa.int64()), pa.array(out_e, pa.binary()), pa.array(out_b, pa.binary())], ["bucket", "block", "entries", "bytes"])

    return blocks.mapInArrow(run, "bucket long, block long, entries binary, bytes binary")


@dataclass
class Runs:
    """Of each class of equal contexts the runs of its strings that one least id has: those from edge[class] to edge[class + 1]."""

    group: np.ndarray  # the class of each context
    edge: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    least: np.ndarray


def least_runs(keys: np.ndarray, lead: np.ndarray, texts: list[bytes], least: np.ndarray) -> Runs:
    """The runs of the strings of given contexts and their least ids over all of them."""
    # equal contexts first: one each, with the least id of all
    known: dict[bytes, int] = {}
    same = np.fromiter((known.setdefault(t + LEADS[x], len(known)) for t, x in zip(texts, lead.tolist(), strict=True)), np.int64, len(texts))
    low = np.full(len(known), NO_ID)
    np.minimum.at(low, same, least)
    one = np.zeros(len(known), np.int64)
    one[same] = np.arange(len(texts))
    size = np.fromiter(map(len, texts), np.int64, len(texts))[one]
    by = np.argsort(keys[one])
    alone = np.ones(len(known), bool)  # the anchor has no other context
    again = keys[one][by][1:] == keys[one][by][:-1]
    alone[by[1:][again]] = alone[by[:-1][again]] = False
    single, several = np.flatnonzero(alone), np.flatnonzero(~alone)
    out = [(single, np.zeros(len(single), np.int64), size[single] - LENGTH, low[single])]
    # the contexts of an anchor may be in several shards
    shards, parts, at, total = [], [], 0, np.append(0, np.cumsum(size[several]))
    while at < len(several):
        take = max(at + 1, int(np.searchsorted(total, total[at] + SHARD_BYTES, "right")) - 1)
        part = several[at:take]
        raw = np.frombuffer(b"".join([texts[i] for i in one[part].tolist()]), np.uint8)
        shards.append(shard_strings(raw, total[at:take] - total[at], size[part], low[part]))
        parts.append((part, total[at:take] - total[at]))
        at = take
    merge_shards(shards)
    for shard, (part, start) in zip(shards, parts, strict=True):
        found = np.full(int(size[part].sum()), NO_ID)
        found[shard.order] = shard.least[shard.string]
        count = size[part] - LENGTH + 1
        inner = _within(count)
        ids, owner = found[np.repeat(start, count) + inner], np.repeat(part, count)
        first = np.append(True, (ids[1:] != ids[:-1]) | (owner[1:] != owner[:-1]))
        begin = np.flatnonzero(first)
        out.append((owner[begin], inner[begin], inner[np.append(begin[1:], len(ids)) - 1], ids[begin]))
    group, begin, end, ids = (np.concatenate(x) for x in zip(*out, strict=True))
    by = np.argsort(group, kind="stable")
    return Runs(same, np.searchsorted(group[by], np.arange(len(known) + 1)), begin[by], end[by], ids[by])


def least_ids(keys: np.ndarray, lead: np.ndarray, texts: list[bytes], least: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """For each context the runs (from, to, id) of its strings and their least ids over all given contexts."""
    r = least_runs(keys, lead, texts, least)
    runs = list(zip(r.begin.tolist(), r.end.tolist(), r.least.tolist(), strict=True))
    return [runs[r.edge[g] : r.edge[g + 1]] for g in r.group.tolist()]


def answer_rows(rows: DataFrame, buckets: int) -> DataFrame:
    """(block, runs): for the contexts of each block, the runs of strings that a smaller id has."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        release()
        entries = [_entries(e) for e in pdf["entries"]]
        texts: list[bytes] = []
        for e, data in zip(entries, pdf["bytes"], strict=True):
            raw = zstandard.ZstdDecompressor().decompress(data)
            end = np.cumsum(e["size"].astype(np.int64))
            texts += [raw[b - s : b] for b, s in zip(end.tolist(), e["size"].tolist(), strict=True)]
        entry = np.concatenate(entries)
        found = least_runs(entry["key"], entry["lead"], texts, entry["least"])
        first = found.edge[found.group]
        count = found.edge[found.group + 1] - first
        line = np.repeat(first, count) + _within(count)
        of = np.repeat(np.arange(len(entry)), count)
        smaller = found.least[line] < entry["most"][of]
        line, of = line[smaller], of[smaller]
        answer = np.zeros(len(line), RUN)
        answer["name"], answer["from"], answer["to"], answer["least"] = entry["name"][of], found.begin[line], found.end[line], found.least[line]
        cut = np.searchsorted(of, np.cumsum([len(e) for e in entries]))
        out = [x.tobytes() for x in np.split(answer, cut[:-1])]
        return pd.DataFrame({"block": pdf["block"], "runs": out})[[len(o) > 0 for o in out]]

    return rows.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(run, "block long, runs binary")


def removed_mask(block: Block, replies: list[tuple[int, bytes]], answers: list[bytes], bits: int) -> np.ndarray:
    """Which bytes of the block go."""
    mark = np.zeros(len(block.text) + 1, np.int32)
    if answers:
        c = contexts(block, replies, bits)
        group, first = context_groups(block, c)
        runs = np.concatenate([np.frombuffer(a, RUN) for a in answers])
        # contexts by class, so that each answer meets all its places
        by = np.argsort(group, kind="stable")
        edge = np.searchsorted(group[by], np.arange(len(first) + 1))
        name = runs["name"].astype(np.int64)
        count = edge[name + 1] - edge[name]
        member = by[np.repeat(edge[name], count) + _within(count)]
        line = np.repeat(np.arange(len(runs)), count)
        later = block.ids[c.doc[member]] > runs["least"][line]
        member, line = member[later], line[later]
        np.add.at(mark, c.start[member] + runs["from"][line], 1)
        np.add.at(mark, c.start[member] + runs["to"][line] + LENGTH, -1)
    return np.cumsum(mark[:-1]) > 0


def _marked_blocks(df: DataFrame, id_col: str, text_col: str, others: list[str]) -> tuple[DataFrame, int]:
    """(block, data, replies, answers) of all blocks, and the bits of a bucket's name."""
    blocks = blocks_of(df, id_col, text_col, others)
    packed = blocks.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first()["n"]
    buckets = 1 << max(3, int(-(-3 * packed // BUCKET_BYTES)).bit_length())
    bits = buckets.bit_length() - 1
    shared = shared_rows(anchor_rows(blocks, bits), buckets)
    replies = stored(shared.groupBy("block").agg(F.collect_list(F.struct("bucket", "hashes")).alias("replies")), "replies")
    asked = blocks.join(replies, "block", "left").select("block", "data", "replies")
    # not written: in one plan the blocks are dealt out once, for the contexts and for the cut
    answers = answer_rows(context_rows(asked, bits), buckets).groupBy("block").agg(F.collect_list("runs").alias("answers"))
    return asked.join(answers, "block", "left").select("block", "data", "replies", "answers"), bits


def _cut(df: DataFrame, id_col: str, text_col: str, emit, schema, others: list[str] | None = None) -> DataFrame:
    marked, bits = _marked_blocks(df, id_col, text_col, others or [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, replies, answers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                release()
                block = _unpacked(data)
                gone = removed_mask(block, [(r["bucket"], r["hashes"]) for r in replies or []], answers or [], bits)
                yield emit(block, gone)
                del block, gone
                release()

    return marked.mapInArrow(run, schema)


def _each(block: Block, gone: np.ndarray) -> Iterator[tuple[int | None, np.ndarray, np.ndarray]]:
    for i, ok, a, s in zip(block.ids.tolist(), block.sound.tolist(), block.start.tolist(), block.size.tolist(), strict=True):
        yield i if ok else None, block.text[a : a + s], gone[a : a + s]


def removal_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""

    def emit(block: Block, gone: np.ndarray) -> pa.RecordBatch:
        out: list[list] = [[], [], [], [], []]
        for i, text, cut in _each(block, gone):
            removed = int(cut.sum())
            kept = text[~cut] if removed else text
            spans = int(cut[:1].sum() + (cut[1:] & ~cut[:-1]).sum()) if removed else 0
            for column, value in zip(out, (i, len(text), removed, spans, hashlib.sha256(kept.tobytes()).hexdigest()), strict=True):
                column.append(value)
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.string())], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _cut(df, id_col, text_col, emit, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("id", id_col)


def _kept(block: Block, gone: np.ndarray) -> list[str]:
    return [text[~cut].tobytes().decode("utf-8", "ignore") for _, text, cut in _each(block, gone)]


def kept_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) of every row without the removed bytes; bytes of a character that is cut in two go with it."""

    def emit(block: Block, gone: np.ndarray) -> pa.RecordBatch:
        ids = pa.array([i for i, _, _ in _each(block, gone)], pa.int64())
        return pa.RecordBatch.from_arrays([ids, pa.array(_kept(block, gone), pa.string())], ["id", "text"])

    return _cut(df, id_col, text_col, emit, "id long, text string").withColumnRenamed("id", id_col)


def cut_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with the removed bytes cut out of its text column; null texts become empty, all other columns stay."""
    others = [c for c in df.columns if c not in (id_col, text_col)]
    schema = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(others))).schema

    def emit(block: Block, gone: np.ndarray) -> pa.RecordBatch:
        ids = pa.array([i for i, _, _ in _each(block, gone)], pa.int64())
        rest = pa.ipc.open_stream(block.rest).read_next_batch() if block.rest else None
        return pa.RecordBatch.from_arrays([ids, pa.array(_kept(block, gone), pa.string()), *(rest.columns if rest is not None else [])], ["id", "text", *(f"c{i}" for i in range(len(others)))])

    back = {"id": id_col, "text": text_col, **{f"c{i}": c for i, c in enumerate(others)}}
    cut = _cut(df, id_col, text_col, emit, schema, others)
    return cut.toDF(*(back[c] for c in cut.columns)).select(df.columns)
