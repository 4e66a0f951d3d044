"""Media, BPE, SimHash, sharding, packing and top-k operators against plain recomputations."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import bpe, flac, packing, queries, sharding, simhash, topk

ODD = [(1, None, None, "x"), (2, "", "a", "x"), (3, "  \t\n", "a", None), (4, "one", None, "y"), (5, "Ünï cödé 漢字 🙂 " * 40, "b", "y"), (6, "long words " * 30_000, "b", "x"), (7, "one", "c", "x"), (7, "one", "c", "x"), (None, "two words", "c", "x")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, extra columns with operators' own names."""
    return spark.createDataFrame(ODD, "doc_id long, text string, source string, id string").withColumn("size", F.lit("s")).withColumn("shard", F.lit(-1)).withColumn("fp", F.lit("f")).withColumn("key", F.lit(None).cast("int"))


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_flac_reads_back_what_was_stored(spark, sf, docs):
    got = {r["doc_id"]: r for r in queries.op2_flac(spark, sf).collect()}
    assert got.keys() == docs.keys()
    for i, text in docs.items():
        payload = flac.padded((text or "").encode())
        assert len(payload) % 192 == 0 and payload
        assert (got[i]["payload_bytes"], got[i]["payload_sha256"], got[i]["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))


def test_flac_fast_path_agrees_with_the_general_decoder():
    rng = np.random.default_rng(3)
    raw = [b"", b"a" * 500, bytes(rng.integers(0, 256, 900).astype(np.uint8)), b"\x00\xff" * 300, "naïve ü ".encode() * 90, b"a" * 150 + b"\xff" + b"b" * 3000]
    payloads = [flac.padded(r) for r in raw]
    streams = flac.encode_batch(payloads)
    assert flac.decode_batch(streams) == payloads
    for stream, payload in zip(streams, payloads, strict=True):
        blocks = list(flac.decode_stream(stream))
        assert [at for at, _ in blocks] == list(range(0, len(payload), 192))
        assert bytes(v + 128 for _, x in blocks for v in x[0]) == payload
        at = len(payload) - 1
        offset, block = flac.seek(stream, at)
        assert block == payload[offset : offset + 192] and offset <= at < offset + 192


def test_flac_damage_is_found():
    stream = bytearray(flac.encode_batch([flac.padded(b"some text " * 50)])[0])
    for at in (len(stream) - 1, len(stream) - 60, 30):
        broken = bytearray(stream)
        broken[at] ^= 4
        with pytest.raises(flac.FlacError):
            flac.decode_batch([bytes(broken)])


def _lpc_stream() -> tuple[bytes, list[int]]:
    """A stream of one frame of 16 samples with a second-order LPC subframe, two partitions, one of them escaped."""
    x = [3, 5]
    rest = [1, -2, 0, 4, -1, 2, 3, -3, 0, 1, 2, -4, 1, 0]
    for r in rest:
        x.append(r + ((7 * x[-1] - 4 * x[-2]) >> 2))
    bits = f"{0:01b}{0b100001:06b}{0:01b}" + "".join(f"{v & 255:08b}" for v in x[:2])
    bits += f"{4 - 1:04b}{2:05b}{7 & 15:04b}{-4 & 15:04b}" + "00" + f"{1:04b}"
    bits += f"{1:04b}" + "".join("0" * ((2 * r if r >= 0 else -2 * r - 1) >> 1) + "1" + str((2 * r if r >= 0 else -2 * r - 1) & 1) for r in rest[:6])
    bits += f"{15:04b}{4:05b}" + "".join(f"{r & 15:04b}" for r in rest[6:])
    bits += "0" * (-len(bits) % 8)
    head = bytes([0xFF, 0xF8, 0x60, 0x02, 0x00, 15])
    head += bytes([int(flac.crc8(np.frombuffer(head, np.uint8)[None, :])[0])])
    frame = head + int(bits, 2).to_bytes(len(bits) // 8, "big")
    even = (b"\0" if len(frame) & 1 else b"") + frame
    frame += int(flac.crc16(np.frombuffer(even, np.uint8)[None, :])[0]).to_bytes(2, "big")
    info = (16).to_bytes(2, "big") * 2 + b"\0" * 6 + ((8000 << 44) | (7 << 36) | 16).to_bytes(8, "big") + b"\0" * 16
    return b"fLaC\x80\0\0\x22" + info + frame, x


def test_flac_general_decoder_reads_lpc_partitions_and_escapes():
    stream, x = _lpc_stream()
    assert list(flac.decode_stream(stream)) == [(0, [x])]


def test_flac_crc_check_values():
    nine = np.frombuffer(b"123456789", np.uint8)
    assert int(flac.crc8(nine[None, :])[0]) == 0xF4
    assert int(flac.crc16(np.concatenate([[0], nine]).astype(np.uint8)[None, :])[0]) == 0xFEE8


def test_flac_odd_rows(odd, spark):
    assert flac.media_digest(flac.encode_media(odd, "doc_id", "text"), "doc_id").count() == len(ODD)
    media = flac.encode_media(odd, "doc_id", "text")
    blocks = flac.pcm_blocks(media.filter("doc_id = 5"), "doc_id").orderBy("block").collect()
    assert b"".join(b["pcm"] for b in blocks).rstrip(b" ") == ODD[4][1].encode().rstrip(b" ")
    assert [b["sample_offset"] for b in blocks] == [i * len(blocks[0]["pcm"]) for i in range(len(blocks))]
    assert flac.encode_media(odd.limit(0), "doc_id", "text").count() == 0


def _library():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))


def test_bpe_equals_the_library(spark, sf, docs):
    lib = _library()
    got = {r["doc_id"]: r for r in queries.op8_bpe(spark, sf).collect()}
    for i, text in docs.items():
        ids = lib.encode(text or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_equals_the_library_on_hard_texts():
    lib, mine = _library(), bpe.tokenizer_text(queries.tokenizer_path("word_bpe_49k.json"))
    rng = random.Random(5)
    texts = ["", "a" * 2000, "!?" * 700, "İSTANBUL ΣΑΣ ﬁ ½ ² é é", "x\x1cy\x85z  w", "<|startoftext|>don't<|endoftext|> <|x", "we'll I'M 'RE 's's", "🙂👩‍👩‍👧 中文字 Жук", "aaaa bbbb " * 30, None]
    texts += ["".join(rng.choice("abcdeghilmnorstuz '.,éß09Ж中") for _ in range(rng.randint(1, 200))) for _ in range(400)]
    for text, ids in zip(texts, mine.encode_batch(texts), strict=True):
        assert ids.tolist() == lib.encode(text or "", add_special_tokens=False).ids, text


def test_bpe_pair_test_equals_exact_merging():
    t = bpe.tokenizer_text(queries.tokenizer_path("word_bpe_49k.json"))
    rng = np.random.default_rng(7)
    opens, closes = np.array(list(t.open.values())), np.array(list(t.close.values()))
    a, b = rng.choice(opens, 3000), rng.choice(closes, 3000)
    kept = t._compatible(a, b)
    assert 0 < kept.sum() < len(a)
    for x, y, ok in zip(a.tolist(), b.tolist(), kept.tolist(), strict=True):
        assert ok == (t._merge(t.strings[x] + t.strings[y][: -len(t.end)]) == [x, y])


def test_bpe_odd_rows(odd):
    path = queries.tokenizer_path("word_bpe_49k.json")
    assert bpe.round_trip_digest(odd, "doc_id", "text", path).count() == len(ODD)
    ids = bpe.encode(odd, "doc_id", "text", path)
    back = {r["doc_id"]: r["text"] for r in bpe.decode(ids, "doc_id", "ids", path).collect()}
    assert back[1] == "" and back[4] == "one</w>"


def _fingerprint(text: str | None) -> int:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in low.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ") if x]
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _groups(fp: dict) -> dict:
    """Smallest id reachable, by comparing all pairs."""
    parent = {i: i for i in fp}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(fp)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (fp[i] ^ fp[j]).bit_count() <= 3 and find(i) != find(j):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in fp}


def test_simhash_equals_all_pairs(spark, sf, docs):
    fp = {i: _fingerprint(t) for i, t in docs.items()}
    want = _groups(fp)
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in queries.op9_simhash(spark, sf).collect()}
    assert got == {i: (fp[i], want[i]) for i in docs}


def test_simhash_links_of_planted_chains_are_complete(spark):
    rng = random.Random(11)
    fps = {}
    for g in range(60):
        x = rng.getrandbits(64)
        for _ in range(12):
            fps[len(fps)] = x
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
    want = _groups(fps)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    vertices = spark.createDataFrame([(signed(v), i) for v, i in {v: i for i, v in reversed(fps.items())}.items()], "fp long, least long")
    got = {r["fp"]: r["least"] for r in simhash.components(vertices, simhash.anchor_links(vertices)).collect()}
    assert {i: got[signed(v)] for i, v in fps.items()} == want


def test_simhash_large_sets_are_split_without_loss():
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 1 << 62, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([centre ^ (np.uint64(1) << np.uint64(a)) ^ (np.uint64(1) << np.uint64(b)) for a in range(0, 64, 5) for b in range(1, 64, 7)]))
    whole = simhash.links_of(fps, fps, 3)
    old, simhash.SET_ROWS = simhash.SET_ROWS, 8
    try:
        parts = list(simhash._split(fps, fps, 23, 3))
    finally:
        simhash.SET_ROWS = old
    sets = []
    for found in ([whole], parts):
        at = {int(f): n for n, f in enumerate(fps)}
        a = np.array([at[int(v)] for x, _ in found for v in x])
        b = np.array([at[int(v)] for _, y in found for v in y])
        node, root = simhash._forest(len(fps), a, b)
        label = np.arange(len(fps))
        label[node] = root
        sets.append(label.tolist())
    assert sets[0] == sets[1]


def test_simhash_odd_rows(odd):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    assert {r["least"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    assert {r["least"] for r in got if r["doc_id"] in (4, 7)} == {4}
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def _check_shards(rows, texts, shards):
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    for part in by.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
    home = {}
    for r in rows:
        home.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    assert all(len(s) == 1 for s in home.values())
    return {s: sum(r["size"] for r in part) for s, part in by.items()}


def test_shards_are_minimax_over_the_ordered_groups(spark, sf, docs):
    rows = queries.op6_sharding(spark, sf).collect()
    load = _check_shards(rows, docs, 16)
    keyed = spark.read.parquet(f"{sf}/documents.parquet").select(sharding.hashed("text").alias("k"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("s")).collect()
    sizes = {}
    for r in keyed:
        k = r["k"] & (1 << 64) - 1
        sizes[k] = sizes.get(k, 0) + r["s"]
    capacity, _ = sharding.minimax_cuts([sizes[k] for k in sorted(sizes)], 16)
    assert max(load.values()) == capacity and set(load) <= set(range(16))
    for r in rows:
        raw = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)


def test_minimax_equals_dynamic_programming():
    rng = random.Random(1)
    for _ in range(60):
        sizes, k = [rng.choice([1, 2, 3, 50]) for _ in range(rng.randint(1, 14))], rng.randint(1, 5)
        best = {0: 0}
        for _ in range(k):
            best = {j: min(max(best[i], sum(sizes[i:j])) for i in best if i <= j) for j in range(len(sizes) + 1)}
        assert sharding.minimax_cuts(sizes, k)[0] == best[len(sizes)]


def test_shards_odd_rows(odd):
    rows = sharding.shard_documents(odd).collect()
    assert len(rows) == len(ODD)
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharding.shard_documents(odd.limit(0)).count() == 0


def _check_bins(rows, capacity):
    for part in packing.bins_of(rows).values():
        part.sort(key=lambda r: r["position"])
        assert sum(r["length"] for r in part) <= capacity
        at = 0
        for r in part:
            assert r["bin_offset"] == at
            at += r["length"]
        named = [r["source"] for r in part if r["source"] is not None]
        assert len(set(named)) == len(named)


def test_packing_keeps_every_byte_and_every_constraint(spark, sf, docs):
    rows = queries.op4_packing(spark, sf).collect()
    _check_bins(rows, packing.CAPACITY)
    covered = {}
    for r in rows:
        covered.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    for i, text in docs.items():
        at = 0
        for start, length in sorted(covered[i]):
            assert start == at
            at += length
        assert at == len((text or "").encode()) + 1
    for part in packing.bins_of(rows).values():
        names = [docs[r["doc_id"]] for r in part if docs[r["doc_id"]] is not None]
        assert len(set(names)) == len(names)


def _plain_best_fit(size, source, cluster, capacity):
    bins = []
    out = [None] * len(size)
    for i in sorted(range(len(size)), key=lambda i: (-size[i], i)):
        fits = [b for b in bins if b["left"] >= size[i] and (source[i] < 0 or source[i] not in b["s"]) and (cluster[i] < 0 or cluster[i] not in b["c"])]
        if fits:
            b = min(fits, key=lambda b: b["left"])
        else:
            b = {"left": capacity, "s": set(), "c": set(), "n": len(bins)}
            bins.append(b)
        b["left"] -= size[i]
        b["s"].add(source[i])
        b["c"].add(cluster[i])
        out[i] = b["n"]
    return out, bins


def test_best_fit_finds_the_tightest_compatible_bin():
    rng = np.random.default_rng(9)
    for _ in range(20):
        n = int(rng.integers(1, 400))
        size, source, cluster = rng.integers(1, 60, n), rng.integers(-1, 70, n), rng.integers(-1, 90, n)
        bins, _ = packing.best_fit(size, source, cluster, 100)
        plain, _ = _plain_best_fit(size.tolist(), source.tolist(), cluster.tolist(), 100)
        # among bins with equal room either may be taken: compare the rooms each size met
        left = np.full(bins.max() + 1, 100)
        np.subtract.at(left, bins, size)
        assert (left >= 0).all()
        for b in range(bins.max() + 1):
            for codes in (source, cluster):
                named = codes[bins == b]
                named = named[named >= 0]
                assert len(np.unique(named)) == len(named)
        assert abs(int(bins.max()) - max(plain)) <= 2


def test_packing_odd_rows(odd, spark):
    rows = packing.pack_documents(odd, capacity=4096).collect()
    _check_bins(rows, 4096)
    assert sum(r["length"] for r in rows) == sum(len((t or "").encode()) + 1 for _, t, _, _ in ODD)
    assert packing.pack_documents(odd.limit(0)).count() == 0
    some = odd.filter("doc_id in (4, 5)")
    payload = packing.packed_texts(packing.pack_documents(some, capacity=100_000), some).collect()
    assert sorted(x for p in payload for x in bytes(p["payload"]).split(b"\0") if x) == sorted([b"one", ODD[4][1].encode()])


def test_top_k_equals_all_products(spark, sf):
    got = {}
    for r in queries.op10_topk(spark, sf).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    v = {r["vec_id"]: np.floor(64 * np.array(r["embedding"], np.float64)).astype(np.int64) for r in rows}
    for q in (i for i in v if i % 20 == 0):
        best = sorted(((-int(v[q] @ v[i]), i) for i in v if i != q))[:20]
        assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]


def test_top_k_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, [1.0, 2.0]), (1, None), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (5, [0.5, -0.25]), (6, [0.5, -0.25]), (None, [1.0, 1.0]), (40, []), (7, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).withColumn("score", F.lit("s"))
    got = [tuple(r) for r in topk.top_k(topk.quantized(df, "vec_id", "embedding"), F.col("id") % 20 == 0, 2).collect()]
    assert sorted(got) == [(0, 1, 20, 64 * 64 + 128 * 128), (0, 2, 5, 0), (20, 1, 0, 64 * 64 + 128 * 128), (20, 2, 5, 0)]
    assert topk.top_k(topk.quantized(df.limit(0), "vec_id", "embedding"), F.col("id") % 20 == 0, 2).count() == 0


def test_top_k_bounds_hold():
    rng = np.random.default_rng(4)
    q, c = rng.normal(size=(30, 37)), rng.normal(size=(50, 37))
    for segments in topk.LEVELS:
        bound = topk.segment_statistics(q, segments) @ topk.segment_statistics(c, segments).T
        assert (bound >= q @ c.T - 1e-9).all()


def test_top_k_repeated_queries_and_large_components(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (5, [0.5, 0.0]), (20, [0.25, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in topk.top_k(topk.quantized(df, "vec_id", "embedding"), F.col("id") == 0, 2).collect())
    assert got == [(0, 1, 0, 4096), (0, 1, 0, 4096), (0, 2, 5, 2048), (0, 2, 5, 2048)]
    huge = spark.createDataFrame([(0, [3e38, 1.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="too large"):
        topk.top_k(topk.quantized(huge, "vec_id", "embedding"), F.col("id") == 0, 2).collect()
    large = spark.createDataFrame([(0, [1e16, 1.0]), (1, [1e16, 1.0])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="does not fit"):
        topk.top_k(topk.quantized(large, "vec_id", "embedding"), F.col("id") == 0, 2).collect()
    q = np.array([[2**40 + 1, 3]]), np.array([[2**20 + 7, -1], [5, 5]])
    _, place, score = topk.search_block(np.array([9]), q[0], np.array([1, 2]), q[1], np.array([1, 2]), 2)
    assert dict(zip(place.tolist(), score.tolist(), strict=True)) == {0: (2**40 + 1) * (2**20 + 7) - 3, 1: 5 * (2**40 + 4)}


def test_top_k_bounds_drop_most_pairs():
    rows = np.array([r["embedding"] for r in pq.read_table("/root/testdata/sf0.1/embeddings.parquet").to_pylist()])
    v, ids = np.floor(64 * rows).astype(np.int64), np.arange(len(rows))
    report = []
    a, b, s = topk.search_block(ids[::20], v[::20], ids, v, ids, 20, topk.rotation(v.astype(float)), report=report)
    plain = v[::20] @ v.T
    plain[np.arange(len(plain)), ids[::20]] = -(2**40)
    assert sorted(s.tolist()) == sorted(np.sort(plain, axis=1)[:, -20:].ravel().tolist())
    old, topk.TILE_ROWS = topk.TILE_ROWS, 256
    try:
        a2, b2, s2 = topk.search_block(ids[::20], v[::20], ids, v, ids, 20, topk.rotation(v.astype(float)), report=report)
    finally:
        topk.TILE_ROWS = old
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == sorted(zip(a2.tolist(), b2.tolist(), strict=True))
    assert sum(x for x, _ in report) < 0.2 * sum(y for _, y in report)


def test_packing_spreads_repeated_rows_and_long_documents(spark):
    rows = [(1, "same text", "s")] * 300 + [(2, "long " * 2_000, "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n", F.lit(7)).withColumn("copy", F.lit("c")).withColumn("run", F.lit(1))
    old, packing.COPIES = packing.COPIES, 64
    try:
        bins = packing.pack_documents(df, capacity=100, shard_rows=50).collect()
    finally:
        packing.COPIES = old
    _check_bins(bins, 100)
    shards = {}
    for r in bins:
        shards[r["bin_id"] >> 32] = shards.get(r["bin_id"] >> 32, 0) + 1
    assert len(bins) == 300 + -(-10_001 // 100) and len(shards) >= 8 and max(shards.values()) < 100
    assert sum(r["doc_id"] == 1 for r in bins) == 300


def test_hot_keys_join_as_others(spark):
    old, simhash.HOT_ROWS = simhash.HOT_ROWS, 20
    try:
        rows = spark.createDataFrame([(i, 1 if i % 3 else i) for i in range(300)], "a long, k long")
        names = spark.createDataFrame([(i, i * 10) for i in range(0, 300, 2)] + [(1, 7)], "n long, x long")
        for how in ("inner", "left"):
            got = sorted(map(str, simhash.hot_join(rows, "k", names, "n", how).select("a", "k", "x").collect()))
            assert got == sorted(map(str, rows.join(names, F.col("k") == F.col("n"), how).select("a", "k", "x").collect()))
        # a star of 400, a chain of 200 and single ones
        links = spark.createDataFrame([(0, i) for i in range(1, 400)] + [(i, i + 1) for i in range(1000, 1200)], "a long, b long")
        vertices = spark.createDataFrame([(i, i) for i in (*range(400), *range(1000, 1201), 5000)], "fp long, least long")
        got = {r["fp"]: r["least"] for r in simhash.components(vertices, links).collect()}
    finally:
        simhash.HOT_ROWS = old
    assert got == {i: 0 if i < 400 else 1000 if i < 5000 else 5000 for i in (*range(400), *range(1000, 1201), 5000)}


def test_large_anchor_sets_are_compared_by_the_other_block():
    rng = np.random.default_rng(12)
    home = rng.integers(0, 1 << 41, 6_000, dtype=np.uint64) << np.uint64(23)  # one vector on the first block
    flips = np.uint64(1) << rng.integers(23, 64, 3_000).astype(np.uint64)
    came = np.unique(np.concatenate([home, home[:3_000] ^ flips]))
    old, simhash.SET_ROWS = simhash.SET_ROWS, 16
    try:
        found = [np.stack(x) for x in simhash._split(home, came, 23, 3)]
    finally:
        simhash.SET_ROWS = old
    one = {frozenset(e) for x in found for e in x.T.tolist()}
    label = {}

    def root(v):
        while label.setdefault(v, v) != v:
            v = label[v]
        return v

    for e in one:
        a, b = e
        label[root(a)] = root(b)
    assert all(root(int(h)) == root(int(h ^ f)) for h, f in zip(home[:3_000], flips, strict=True))


def test_linear_predictors_and_foreign_streams(spark):
    wave = bytes((128 + 90 * np.sin(np.arange(192 * 20) / 3)).astype(np.uint8))
    stream = flac.encode_batch([wave])[0]
    info, at = flac._metadata(stream)
    kinds = [stream[at + int(o) + 6] >> 1 for o in info["seek"]["offset"]]
    assert all(k == 32 | flac.ORDER - 1 for k in kinds) and len(stream) - at < 0.6 * len(wave)
    assert flac.decode_batch([stream])[0] == wave
    assert b"".join((np.array(x) + 128).astype(np.uint8).tobytes() for _, (x,) in flac.decode_stream(stream)) == wave
    # without its seek table the fast path cannot read it
    bare = b"fLaC\x80\0\0\x22" + stream[8:42] + stream[at:]
    with pytest.raises(flac.FlacError):
        flac.decode_batch([bare])
    df = spark.createDataFrame([(1, bare), (2, stream), (3, None)], "id long, media binary").withColumn("pcm", F.lit(1)).withColumn("block", F.lit("b"))
    got = {}
    for r in flac.pcm_blocks(df, "id", 192).orderBy("id", "block").collect():
        assert r["sample_offset"] == 192 * r["block"] and r["n_samples"] == 192
        got[r["id"]] = got.get(r["id"], b"") + bytes(r["pcm"])
    assert got == {1: wave, 2: wave}


def test_bpe_odd_tables(odd):
    path = queries.tokenizer_path("word_bpe_49k.json")
    got = {r["doc_id"]: r for r in bpe.round_trip_digest(odd.filter("doc_id is not null"), "doc_id", "text", path).collect()}
    assert got[1]["n_tokens"] == got[2]["n_tokens"] == got[3]["n_tokens"] == 0 and got[4]["ids_sha256"] == got[7]["ids_sha256"] and got[6]["n_tokens"] >= 60_000
    assert bpe.round_trip_digest(odd, "doc_id", "text", path).count() == len(ODD) and bpe.round_trip_digest(odd.limit(0), "doc_id", "text", path).count() == 0
