"""Near copies: the pipeline's stage against all pairs compared, and links that few fingerprint bits miss."""

import random
import re

import corpus_pipeline as P
from tessera.llm import near_copies, simhash


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def kept_by_all_pairs(rows):
    """Ids that are the smallest of their component, every pair compared."""
    sets = [(i, shingles(t)) for i, t in sorted(rows)]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i for i in root if find(i) == i}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_stage_takes_all_near_copies_and_no_others(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, license_line = [], " ".join(word() for _ in range(30))
    for base in range(6):
        text = [word() for _ in range(rng.choice([40, 150, 300]))]
        rows.append((len(rows), " ".join(text)))
        for changes in (0, 1, 2, 3, 5, 8, 12):
            copy = list(text)
            for _ in range(changes):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy)))
        rows.append((len(rows), license_line + " " + word()))
    rows += [(len(rows), "one two"), (len(rows) + 1, "One  TWO"), (len(rows) + 2, "two one"), (len(rows) + 3, None), (len(rows) + 4, "")]
    kept = {r["doc_id"] for r in P.near_duplicates(spark, frame(spark, rows), "").collect()}
    assert kept == kept_by_all_pairs(rows)
    # pairs of 0.8 and more that differ in more than the fingerprints' three bits
    assert any(bin(simhash.fingerprint(rows[0][1]) ^ simhash.fingerprint(rows[j][1])).count("1") > 3 and j not in kept for j in range(1, 9))


def test_stage_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert {r["doc_id"] for r in P.near_duplicates(spark, docs, "").collect()} == kept_by_all_pairs(rows)
    assert near_copies.near_copies(docs.limit(0)).count() == 0
