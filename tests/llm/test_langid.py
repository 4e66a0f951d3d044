"""Language identification: held-out accuracy, spans of mixed text, odd rows."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import langid, queries


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op3_langid(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.95


def test_viterbi_equals_plain_dynamic_programming():
    rng = np.random.default_rng(0)
    sizes = [5, 0, 1, 12, 3]
    text = np.repeat(np.arange(5), sizes)
    score = rng.normal(size=(len(text), 3)).astype(np.float32) * 3
    label = langid.viterbi(score, text, 5, 2.0)
    for t in range(5):
        s = score[text == t].astype(float)
        if not len(s):
            continue
        best = s[0].copy()
        for row in s[1:]:
            best = np.array([max(best[j] - (2.0 if j != i else 0) for j in range(3)) for i in range(3)]) + row
        mine = label[text == t]
        total = sum(s[i, mine[i]] for i in range(len(s))) - 2.0 * (mine[1:] != mine[:-1]).sum()
        assert abs(total - best.max()) < 1e-4


def _toy(spark):
    rows = [(i, "the quick brown fox and the lazy dog with them " * 3, "en") for i in range(20)] + [(i + 50, "der schnelle braune Fuchs und der faule Hund mit ihnen " * 3, "de") for i in range(20)] + [(i + 90, "быстрая коричневая лиса и ленивая собака " * 3, "ru") for i in range(20)]
    return langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "text", "lang", "doc_id")


def test_spans_of_mixed_text(spark):
    model = _toy(spark)
    text = "the quick brown fox and the lazy dog with them der schnelle braune Fuchs und der faule Hund mit ihnen быстрая собака"
    got = [(r["start"], r["stop"], r["lang"]) for r in langid.spans(spark.createDataFrame([(1, text)], "doc_id long, text string"), model, "doc_id", "text").collect()]
    assert [g[2] for g in got] == ["en", "de", "ru"]
    assert text[got[0][0] : got[0][1]] == "the quick brown fox and the lazy dog with them"
    assert text[got[2][0] : got[2][1]] == "быстрая собака"


def test_odd_rows(spark):
    model = _toy(spark)
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "the dog"), (4, "the dog"), (None, "der Hund und ihnen"), (6, "漢字"), (7, "the lazy dog " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("xx")).withColumn("score", F.lit(1)).withColumn("id", F.lit(2))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(df, model, "doc_id", "text").collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0)
    assert got[4][0] == "en" and got[None][0] == "de" and got[7][0] == "en"
    assert got[6][0] in ("en", "de", "ru")
    assert langid.predict(df.limit(0), model, "doc_id", "text").count() == 0
    nothing = langid.train(df.limit(0), "text", "lang", "doc_id")
    assert {r["lang_pred"] for r in langid.predict(df, nothing, "doc_id", "text").collect()} == {"und"}


def test_spans_of_kept_languages_decide(spark):
    en, de = "the of and with this there water house under".split(), "der die und nicht unter haus wasser über straße".split()
    rng = random.Random(3)
    say = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, say(en if i % 2 else de, 60), "en" if i % 2 else "de") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, text string, lang string")
    model = langid.train(df, "text", "lang", "id")
    texts = [say(en, 50), say(de, 50), say(en, 40) + " " + say(de, 40), "123 ...", None]
    share = langid.language_share(model, texts, ("en",))
    assert share[0] > 0.9 and share[1] < 0.1 and 0.3 < share[2] < 0.7 and share[3] == share[4] == 0
    asked = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("score", F.lit("s"))
    assert {r["id"] for r in langid.keep(asked, model, "text", ("en",), 0.6).collect()} == {0}
    assert {r["id"] for r in langid.keep(asked, model, "text", None, 0.6).collect()} == {0, 1, 2}
