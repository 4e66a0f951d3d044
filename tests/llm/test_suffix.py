"""Removal of repeated strings against brute force; suffix arrays and common prefixes against plain sorting."""

import hashlib
import random
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm import queries
from tessera.llm import suffix_dedup as S


def brute(docs):
    """n_bytes, n_removed, n_spans, kept digest of each (id, bytes), by a table of all strings."""
    least = {}
    for i, raw in docs:
        if i is None:
            continue
        for p in range(len(raw) - 49):
            s = raw[p : p + 50]
            least[s] = min(least.get(s, i), i)
    out = []
    for i, raw in docs:
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 49) if i is not None else ():
            if least[raw[p : p + 50]] < i:
                gone[p : p + 50] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out.append((i, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_equals_brute_force(spark, sf):
    docs = [(r["doc_id"], (r["text"] or "").encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(docs)
    assert sum(r[2] for r in want) > 0
    assert sorted(map(tuple, queries.op7_suffix(spark, sf).collect()), key=str) == want


def _planted(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeö ") for _ in range(rng.randint(1, 7)))
    shared = ["".join(word() for _ in range(rng.randint(5, 40))) for _ in range(12)] + ["a" * 130, "ab" * 60, "x" * 49, "y" * 50, "z" * 51]
    docs = []
    for i in range(120):
        parts = [rng.choice(shared) if rng.random() < 0.4 else "".join(word() for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 6))]
        docs.append((rng.choice([i, i, 1000 - i, i // 2]), "".join(parts)))
    return [*docs, (None, shared[0]), (7, None), (8, ""), (9, "same " * 40), (9, "same " * 40), (3, "same " * 40)]


def test_planted_strings_in_small_blocks_and_shards(spark):
    docs = _planted(4)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).withColumn("block", F.lit(1)).withColumn("id", F.lit("x"))
    assert sorted(map(tuple, S.removal_digest(df).collect()), key=str) == brute([(i, (t or "").encode()) for i, t in docs])
    assert S.removal_digest(df.limit(0)).count() == 0
    texts = S.kept_texts(df).collect()
    assert len(texts) == len(docs)


def test_shards_merge_to_the_same_answer():
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(50, 84))) for _ in range(60)]
    texts += [t[:30] + "c" * 40 for t in texts[:20]] + [("c" * 84)] * 3
    raw = [t.encode() for t in texts]
    keys, lead, least = np.zeros(len(raw), np.uint64), np.zeros(len(raw), np.uint8), np.arange(len(raw))[::-1].copy()
    one = S.least_ids(keys, lead, raw, least)
    old, S.SHARD_BYTES = S.SHARD_BYTES, 300
    try:
        assert S.least_ids(keys, lead, raw, least) == one
    finally:
        S.SHARD_BYTES = old
    table = {}
    for r, i in zip(raw, least.tolist(), strict=True):
        for p in range(len(r) - 49):
            table[r[p : p + 50]] = min(table.get(r[p : p + 50], i), i)
    for r, runs in zip(raw, one, strict=True):
        assert [i for a, b, i in runs for _ in range(a, b + 1)] == [table[r[p : p + 50]] for p in range(len(r) - 49)]


def test_suffix_order_and_common_prefixes():
    rng = np.random.default_rng(3)
    for text in (np.concatenate([rng.integers(97, 99, 400), np.full(200, 97), np.zeros(50), np.full(300, 97)]).astype(np.uint8), rng.integers(0, 4, 900).astype(np.uint8), np.zeros(70, np.uint8)):
        raw = text.tobytes()
        order = S.suffix_order(text)
        assert order.tolist() == sorted(range(len(raw)), key=lambda p: raw[p:])
        lcp = S.common_prefixes(text, order)
        for a, b, h in zip(order.tolist(), order.tolist()[1:], lcp.tolist()[1:], strict=False):
            x, y = raw[a : a + 50], raw[b : b + 50]
            assert h == next((i for i in range(min(len(x), len(y))) if x[i] != y[i]), min(len(x), len(y)))


def test_the_least_gram_may_come_again_in_a_string():
    """Contexts are of one class if their bytes and the place of their anchor are the same, in a periodic text too."""
    raw = [("abcd" * 40).encode(), b"q" * 60 + ("abcd" * 30).encode(), bytes(range(60, 120)) * 3]
    block = S._unpacked(S._packed([5, 3, 9], raw))
    c = S.contexts(block, [], 5)
    text = block.text.tobytes()
    names = [(text[a : a + s], x) for a, s, x in zip(c.start.tolist(), c.size.tolist(), c.lead.tolist(), strict=True)]
    group, first = S.context_groups(block, c)
    assert len(first) == len(set(names)) and [names[first[g]] for g in group.tolist()] == names


def _cpu(fn, times=3):
    took = []
    for _ in range(times):
        start = time.process_time()
        fn()
        took.append(time.process_time() - start)
    return min(took)


class _Caught:
    """Takes the function that a stage would run."""

    def mapInArrow(self, run, schema):
        self.run = run
        return self


def test_work_on_a_block_is_about_a_sort_of_its_places():
    """CPU time in units of one merge sort of the places, which moves with the machine."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(5000)]
    docs = [" ".join(rng.choice(words) for _ in range(400)).encode() for _ in range(800)]
    docs += [docs[i] + docs[i + 1][:700] for i in range(400)]
    data = S._packed(list(range(len(docs))), docs)
    text = S._unpacked(data).text
    part, share = text[: 1 << 20], (1 << 20) / len(text)
    batch = pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([data], pa.binary())], ["block", "data"])
    places = np.random.default_rng(1).permutation(len(part))
    unit = _cpu(lambda: np.argsort(places, kind="stable"))
    assert _cpu(lambda: list(S.anchor_rows(_Caught(), 5).run(iter([batch])))) * share < 0.23 * unit
    assert _cpu(lambda: S.suffix_order(part)) < 1.4 * unit
