"""The pipeline: each stage's decisions on its own input, and clean documents kept."""

import random
import re

from pyspark.sql import functions as F

import corpus_pipeline as P
from tessera.llm import langid, packing, pii, suffix_dedup


def test_stages_and_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in P.STAGES[:-1]:
        before = docs
        docs = P.stored(stage(spark, docs, sf), f"test-{name}")
        assert docs.columns == P.COLUMNS
        now = [r["doc_id"] for r in docs.collect()]
        assert len(set(now)) == len(now) and set(now) <= ids
        if name in ("repeated_strings", "personal_data"):
            assert before.count() == len(now)
        if name == "language":
            assert len(now) == len(ids)
        ids = set(now)
    bins = P.STAGES[-1][1](spark, docs, sf).collect()
    assert {r["doc_id"] for r in bins} == ids
    assert sum(r["length"] for r in bins) == sum(len(r["text"].encode()) + 1 for r in docs.collect())
    assert all(sum(r["length"] for r in part) <= packing.CAPACITY for part in packing.bins_of(bins).values())
    whole = P.run(spark, sf).collect()
    assert sorted(map(str, whole)) == sorted(map(str, bins))


def test_language_stage_rejects_what_has_no_language(spark):
    rng = random.Random(1)
    say = lambda words: " ".join(rng.choice(words) for _ in range(60))
    en, de = "the of and with this there water house under".split(), "der die und nicht unter haus wasser über straße".split()
    rows = [(i, say(en if i % 2 else de), "en" if i % 2 else "de", "s", 1) for i in range(60)] + [(100, "1234 !!! 99", None, "s", 1), (101, None, "en", "s", 1), (102, "", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in P.language(spark, df, "").collect()} == set(range(60))


def test_later_stages_take_effect(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = [" ".join(word() for _ in range(120)) for _ in range(6)]
    passage = " ".join(word() for _ in range(60))
    rows = [(1, texts[0]), (2, texts[0]), (3, texts[0] + " " + word()), (4, texts[1] + " " + passage), (5, passage + " " + texts[2]), (6, texts[3] + " write to ann.lee@example.com now"), (7, None), (8, "")]
    df = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = P.near_duplicates(spark, df, "")
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids >= {1, 4, 5, 6, 7} and not ids & {2, 8}
    cut = {r["doc_id"]: r for r in P.repeated_strings(spark, kept, "").collect()}
    assert passage in cut[4]["text"] and passage not in cut[5]["text"] and texts[2] in cut[5]["text"]
    assert cut[5]["n_chars"] == len(cut[5]["text"]) and cut[7]["text"] == "" and cut[1]["source"] == "s"
    clean = {r["doc_id"]: r["text"] for r in P.personal_data(spark, kept, "").collect()}
    assert "<EMAIL>" in clean[6] and "ann.lee" not in clean[6] and clean[1] == texts[0]


def test_cut_rows_keeps_other_columns(spark):
    rows = [(1, "a" * 60, 1.5, [1, 2]), (2, "b" + "a" * 60, None, None), (None, "a" * 60, 2.5, []), (3, None, 0.0, [3])]
    df = spark.createDataFrame(rows, "id long, text string, c0 double, block array<int>").withColumn("data", F.lit("x"))
    got = {r["id"]: r for r in suffix_dedup.cut_rows(df, "id", "text").collect()}
    assert got[1]["text"] == "a" * 60 and got[2]["text"] == "b" and got[None]["text"] == "a" * 60 and got[3]["text"] == ""
    assert got[1]["c0"] == 1.5 and got[1]["block"] == [1, 2] and got[2]["c0"] is None and got[3]["data"] == "x"


def test_redaction_of_a_clean_corpus_changes_little(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter(~F.col("text").rlike("[0-9@]"))
    model = pii.train(spark.read.parquet(f"{sf}/documents.parquet"), "text")
    same = pii.redact(docs, model, "text").select("doc_id", F.col("text").alias("new")).join(docs, "doc_id").filter("new = text").count()
    assert same == docs.count()


def brute_groups(texts):
    """Groups of near copies, by all pairs."""
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, root = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            a, b = sets[i], sets[j]
            if i < j and (a == b or 5 * len(a & b) >= 4 * len(a | b)):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in texts}


def brute_cut(texts):
    """Bytes of 50-byte strings that a smaller id has too go, by a dictionary of all strings."""
    raw, first = {i: (t or "").encode() for i, t in texts.items()}, {}
    for i in sorted(raw):
        for at in range(len(raw[i]) - 49):
            first.setdefault(raw[i][at : at + 50], i)
    out = {}
    for i, r in raw.items():
        gone = [False] * len(r)
        for at in range(len(r) - 49):
            if first[r[at : at + 50]] < i:
                gone[at : at + 50] = [True] * 50
        out[i] = bytes(b for b, g in zip(r, gone, strict=True) if not g).decode("utf-8", "ignore")
    return out


def test_run_equals_a_brute_force_version(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 120")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = langid.train(docs.filter(~langid.held_out()), "text", "lang", "doc_id")
    share = langid.language_share(model, list(texts.values()))
    texts = {i: t for (i, t), s in zip(texts.items(), share, strict=True) if s >= P.MIN_SHARE and s > 0}
    groups = brute_groups(texts)
    texts = brute_cut({i: t for i, t in texts.items() if groups[i] == i})
    whole = P.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in whole} == set(texts)
    redacted = pii.train(spark.createDataFrame([(t,) for t in texts.values()], "text string"), "text")
    expected = {i: len(pii.redact_text(t, cs).encode()) + 1 for (i, t), cs in zip(texts.items(), pii.find_batch(redacted, list(texts.values())), strict=True)}
    got = {}
    for r in whole:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == expected


def test_stages_take_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "the house of the water and the tree " * 12, "en", "s", 5), (3, "the house of the water and the tree " * 12, "en", "s", 5), (None, "the house and the river of the town " * 9, None, None, None), (4, "the same ann.lee@example.com " * 2_000, "en", "t", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("id", F.lit("x")).withColumn("score", F.lit(1)).withColumn("least", F.lit(2))
    for name, stage in P.STAGES:
        out = stage(spark, df, "")
        kept = sorted((r["doc_id"] or 0 for r in out.select("doc_id").collect()))
        assert set(kept) <= {0, 1, 2, 3, 4} and (name == "language" or {0, 3, 4} <= set(kept)), name
        if name in ("repeated_strings", "personal_data"):
            assert kept == [0, 1, 2, 3, 3, 4]
        assert stage(spark, df.limit(0), "").count() == 0
        if name != "packed":
            assert out.columns == P.COLUMNS
