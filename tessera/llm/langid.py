"""Language identification of mixed-language text by script ranges, word scores and Viterbi.

Learning: hashed character n-grams (one to four letters, with word ends) are
counted for each language over labelled texts, and become smoothed
log-probabilities. The scripts that a language's words use are learned too.

Prediction: a word is a run of letters. Its script range narrows the languages to
those that were learned in this script; each candidate scores the mean
log-probability of the word's n-grams times its length. Viterbi over the words
with a penalty for each switch labels every word, so a text splits into spans of
one language. A text's language is the one with the most letters; the score is
the share of its letters, weighed with how sure the words' scores are.

Null texts and texts without a letter are ``und`` with score 0. Words in scripts
that no language was learned in score all languages alike. Without any usable
training row every text is ``und``; an empty table gives no rows. Ties go to the
language that is first by name. Repeated rows are predicted each for itself, long
texts as a whole. Columns other than the named ones are not read, or stay as they
are (``keep``), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import below, map_batches

UND = "und"
TABLE_BITS = 16  # n-gram hash buckets
SAMPLE_ROWS = 4_000  # labelled rows that the model is fitted on, about, those with the least hash of id and text
FIT_TASKS = 4  # that count them: each returns one table of fixed size for each language
SWITCH = 12.0  # cost of a change of language between two words
SMOOTH = 0.5
SCORED_CHARS = 1 << 20  # characters whose n-grams are looked up together; one longer text is looked up alone
GRAMS = (1, 2, 3, 4)

# First code points of script ranges, in order, and the script that starts there.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"), (0x0B80, "tamil"), (0x0C00, "other"), (0x0E00, "thai"),
    (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1380, "other"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"), (0x3190, "han"),
    (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "other"),
)
NAMES = sorted({s for _, s in SCRIPTS})


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Whether each code point of the first plane is a letter, and its script's number."""
    code = np.arange(1 << 16)
    letter = np.array([chr(c).isalpha() for c in code])
    start = np.array([s for s, _ in SCRIPTS])
    name = np.array([NAMES.index(s) for _, s in SCRIPTS])
    return letter, name[np.searchsorted(start, code, "right") - 1].astype(np.int8)


LETTER, SCRIPT = _tables()


def _codes(texts: list[str]) -> np.ndarray:
    """Lower-case code points of all texts, each closed by a space; letters beyond the first plane become one of their own."""
    joined = " ".join(texts) + " "
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    high = code > 0xFFFF
    if high.any():
        points = np.unique(code[high])
        letters = points[np.array([chr(c).isalpha() for c in points])]
        code = np.where(np.isin(code, letters), 0x4E00, np.where(high, 0x20, code)).astype(np.uint32)
    return code


@dataclass
class Words:
    """The letter runs of a batch of texts."""

    grams: list[np.ndarray]  # bucket of the n-gram that ends at each letter, by n
    place: np.ndarray  # where the letters stand
    start: np.ndarray  # of each word, among the letters
    size: np.ndarray
    text: np.ndarray  # of each word
    script: np.ndarray


def words_of(texts: list[str | None]) -> Words:
    low = [(t or "").lower() for t in texts]
    code = _codes(low)
    size = np.array([len(t) + 1 for t in low])
    letter = LETTER[code]
    place = np.flatnonzero(letter)
    first = np.ones(len(place), bool)
    first[1:] = place[1:] != place[:-1] + 1
    start = np.flatnonzero(first)
    length = np.diff(np.append(start, len(place)))
    text = np.searchsorted(np.cumsum(size), place[start], "right")
    # n-grams end at a letter and may begin before the word: the end mark of the word before it is a space
    prepared = np.where(letter, code, 32).astype(np.uint32)
    padded = np.concatenate([np.full(4, 32, np.uint32), prepared, np.full(1, 32, np.uint32)])
    at = place + 4
    c0, c1, c2, c3, after = (padded[at - j] for j in (0, 1, 2, 3, -1))
    within = np.arange(len(place)) - np.repeat(start, length)  # letters before this one in its word
    c2 = np.where(within >= 1, c2, 32)
    c3 = np.where(within >= 2, c3, 32)
    closing = (after == 32).astype(np.uint32)
    mul, shift = np.uint32(0x9E3779B1), np.uint32(32 - TABLE_BITS)
    h1 = (c0 * np.uint32(2) + closing) * mul
    h2 = (c0 + c1 * np.uint32(0x85EBCA6B) + closing * np.uint32(77)) * mul
    h3 = (h2 ^ (c2 * np.uint32(0xC2B2AE35))) * mul + np.uint32(3)
    h4 = (h3 ^ (c3 * np.uint32(0x27D4EB2F))) * mul + np.uint32(5)
    return Words([h >> shift for h in (h1, h2, h3, h4)], place, start, length, text, SCRIPT[code[place[start]]] if len(start) else np.zeros(0, np.int8))


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # (n, bucket, language) log-probabilities
    allowed: np.ndarray  # (script, language)
    switch: float = SWITCH

    def word_scores(self, w: Words) -> np.ndarray:
        """(word, language) scores; languages that were not learned in a word's script are far below the others."""
        k = len(self.languages)
        if not len(w.start):
            return np.zeros((0, k), np.float32)
        total = np.zeros((len(w.place), k), np.float32)
        for table, gram in zip(self.table, w.grams, strict=True):
            total += table[gram]
        score = np.add.reduceat(total, w.start, axis=0) / np.float32(len(self.table))
        allowed = self.allowed[w.script]
        known = allowed.any(axis=1)
        score[~known] = 0
        score[known[:, None] & ~allowed] = -1e4
        return score


def viterbi(score: np.ndarray, text: np.ndarray, n_texts: int, switch: float) -> np.ndarray:
    """The language of each word: the best path of each text, with a penalty for each switch. All texts go step by step side by side."""
    n, k = score.shape
    label = np.zeros(n, np.int16)
    if not n or k == 1:
        return label
    count = np.bincount(text, minlength=n_texts)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    by = np.argsort(-count, kind="stable")
    by = by[count[by] > 0]
    first, count = first[by], count[by]
    best = score[first].astype(np.float64)
    came = np.zeros((n, k), np.int16)
    own = np.arange(k, dtype=np.int16)[None, :]
    live = len(by)
    final = np.zeros((len(by), k))
    for step in range(1, int(count[0])):
        now = int(np.searchsorted(-count, -step, "left"))  # texts with more than step words
        if now < live:
            final[now:live] = best[now:live]
            best, live = best[:now], now
        top = best.argmax(axis=1)
        reach = best[np.arange(now), top] - switch
        stay = best >= reach[:, None]
        came[first[:now] + step] = np.where(stay, own, top[:, None])
        best = np.where(stay, best, reach[:, None]) + score[first[:now] + step]
    final[:live] = best
    at = final.argmax(axis=1).astype(np.int16)
    for step in range(int(count[0]) - 1, -1, -1):
        now = int(np.searchsorted(-count, -step, "left"))
        row = first[:now] + step
        label[row] = at[:now]
        at[:now] = came[row, at[:now]] if step else at[:now]
    return label


def fit(counts: np.ndarray, scripts: np.ndarray, languages: list[str], switch: float = SWITCH) -> Model:
    """A model from n-gram counts (n, bucket, language) and letters of each script (script, language)."""
    total = counts.sum(axis=1, keepdims=True)
    table = np.log((counts + SMOOTH) / (total + SMOOTH * counts.shape[1])).astype(np.float32)
    # a script belongs to a language if more than a trace of its words use it
    share = scripts / np.maximum(scripts.sum(axis=0, keepdims=True), 1)
    return Model(languages, table, share > 0.02, switch)


def train(labelled: DataFrame, text_col: str, lang_col: str, id_col: str, sample_rows: int = SAMPLE_ROWS, switch: float = SWITCH) -> Model:
    """Fit on about sample_rows labelled rows, those with the least hash of id and text; counts are made on the executors."""
    labelled = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = below(labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(id_col, text_col).alias("h")), "h", sample_rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), object)
            for lang in sorted(set(langs)):
                w = words_of([t for t, one in zip(texts, langs, strict=True) if one == lang])
                mine = sums.setdefault(lang, [np.zeros((len(GRAMS), 1 << TABLE_BITS), np.int64), np.zeros(len(NAMES), np.int64)])
                for n, gram in enumerate(w.grams):
                    mine[0][n] += np.bincount(gram, minlength=1 << TABLE_BITS)
                mine[1] += np.bincount(w.script, w.size, len(NAMES)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([g.astype("<i8").tobytes() for g, _ in sums.values()], pa.binary()), pa.array([s.astype("<i8").tobytes() for _, s in sums.values()], pa.binary())], ["lang", "grams", "scripts"])

    # all tasks scan and filter, and a few count what is left
    found = rows.select("text", "lang").repartition(FIT_TASKS).mapInArrow(count, "lang string, grams binary, scripts binary").collect()
    languages = sorted({r["lang"] for r in found})
    counts = np.zeros((len(GRAMS), 1 << TABLE_BITS, len(languages)))
    scripts = np.zeros((len(NAMES), len(languages)))
    for r in found:
        k = languages.index(r["lang"])
        counts[:, :, k] += np.frombuffer(r["grams"], "<i8").reshape(len(GRAMS), -1)
        scripts[:, k] += np.frombuffer(r["scripts"], "<i8")
    return fit(counts, scripts, languages, switch)


def scored_words(model: Model, texts: list[str | None]) -> tuple[np.ndarray, Words]:
    """(word, language) scores and the words of a batch, of which only the first letters are kept.

    N-grams are looked up for about SCORED_CHARS characters at a time, so memory grows with the words, not the letters.
    """
    ends = np.cumsum([len(t or "") + 1 for t in texts])
    run = ends // SCORED_CHARS
    cuts = np.concatenate([[0], np.flatnonzero(run[1:] != run[:-1]) + 1, [len(texts)]])
    scores, parts, chars = [], [], 0
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        w = words_of(texts[a:b])
        scores.append(model.word_scores(w))
        parts.append((w.place[w.start] + chars, w.size, w.text + a, w.script))
        chars += sum(len((t or "").lower()) + 1 for t in texts[a:b])
    place, size, text, script = (np.concatenate(x) for x in zip(*parts, strict=True))
    return np.concatenate(scores), Words([], place, np.arange(len(place)), size, text, script)


def _sureness(score: np.ndarray, label: np.ndarray) -> np.ndarray:
    """How sure each word's label is: its probability among the languages."""
    if not len(score):
        return np.zeros(0)
    p = np.exp(score - score.max(axis=1, keepdims=True))
    return p[np.arange(len(p)), label] / p.sum(axis=1)


def predict_batch(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray, Words, np.ndarray]:
    """Language and score of each text; the words and their labels."""
    n, k = len(texts), len(model.languages)
    if not k:
        w = words_of(texts)
        return [UND] * n, np.zeros(n), w, np.zeros(len(w.start), np.int16)
    score, w = scored_words(model, texts)
    label = viterbi(score, w.text, n, model.switch)
    letters = np.zeros((n, k))
    np.add.at(letters, (w.text, label), w.size)
    total = letters.sum(axis=1)
    sure = np.bincount(w.text, _sureness(score, label) * w.size, n) / np.maximum(total, 1)
    best = letters.argmax(axis=1)
    share = letters[np.arange(n), best] / np.maximum(total, 1)
    names = [model.languages[b] if t else UND for b, t in zip(best, total, strict=True)]
    return names, np.clip(share * sure, 0, 1), w, label


def language_share(model: Model, texts: list[str | None], languages: tuple[str, ...] | None = None) -> np.ndarray:
    """The share of each text's letters that stand in spans of the languages, weighed with how sure the words are; 0 without a letter."""
    n = len(texts)
    if not model.languages:
        return np.zeros(n)
    score, w = scored_words(model, texts)
    label = viterbi(score, w.text, n, model.switch)
    asked = np.array([languages is None or x in languages for x in model.languages])
    return np.bincount(w.text, _sureness(score, label) * w.size * asked[label], n) / np.maximum(np.bincount(w.text, w.size, n), 1)


def predict(df: DataFrame, model: Model, id_col: str, text_col: str) -> DataFrame:
    """(id, lang_pred, score) of every row."""
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    shipped = spark.sparkContext.broadcast(model)  # a table of fixed size for each language

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        names, score, _, _ = predict_batch(shipped.value, batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["id", "lang_pred", "score"])

    return map_batches(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def keep(df: DataFrame, model: Model, text_col: str, languages: tuple[str, ...] | None, min_share: float) -> DataFrame:
    """The rows of df of whose letters at least a share stands in spans of the given languages (None: of any learned one), each span
    weighed with how sure its words' scores are; rows and columns stay as they are."""
    shipped = df.sparkSession.sparkContext.broadcast(model)
    place = df.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        share = language_share(shipped.value, batch.column(place).to_pylist(), languages)
        yield batch.filter(pa.array((share >= min_share) & (share > 0), pa.bool_()))

    return map_batches(df, run, df.schema)


def spans(df: DataFrame, model: Model, id_col: str, text_col: str) -> DataFrame:
    """(id, start, stop, lang): the spans of one language of each text, in code points of the lower-cased text."""
    kind = df.schema[id_col].dataType.simpleString()
    shipped = df.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = batch.column(1).to_pylist()
        _, _, w, label = predict_batch(shipped.value, texts)
        base = np.concatenate([[0], np.cumsum([len((t or "").lower()) + 1 for t in texts])])
        if len(label) and shipped.value.languages:
            change = np.flatnonzero(np.concatenate([[True], (w.text[1:] != w.text[:-1]) | (label[1:] != label[:-1])]))
            last = np.append(change[1:], len(label)) - 1
            text = w.text[change]
            start = w.place[w.start[change]] - base[text]
            stop = w.place[w.start[last]] + w.size[last] - base[text]
            lang = [shipped.value.languages[i] for i in label[change]]
        else:
            text = start = stop = np.zeros(0, np.int64)
            lang = []
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text)), pa.array(start, pa.int64()), pa.array(stop, pa.int64()), pa.array(lang, pa.string())], ["id", "start", "stop", "lang"])

    return map_batches(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, start long, stop long, lang string").withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id"):
    """Whether a row is held out of learning: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
