"""BPE encoding and decoding by speculation and verification.

For a tokenizer file with word-end BPE (the kind that lower-cases, drops white
space and closes each word with a suffix). A word's tokens are proposed greedily,
longest match first. A proposal is the BPE result if and only if every adjacent
pair of its tokens is compatible: merging the two tokens' joint string would give
just these two. Pairs are tested in numpy for all words of a batch: the boundary
between two tokens is replayed from the outermost merges inwards, and a pair
fails where a merge across the boundary would have come before one of the merges
that built its sides. Only words with a failing pair are merged exactly.

Null and empty texts have no tokens. Special-token strings in a text are special
tokens, as the file says. All of every text is encoded, however long; of merges
that tie the leftmost is made. Repeated rows are encoded each for itself. Columns
other than id and text are not read, whatever their names. An empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_batches

NEVER = 1 << 40
CLOSE = "\n"  # stands for the word end; byte letters have no control characters
WIDE = 256  # letters up to which failing words are merged side by side


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letters, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            letters[b] = chr(b)
        else:
            letters[b] = chr(extra)
            extra += 1
    return letters


class WordBPE:
    """A word-end BPE tokenizer read from its file."""

    def __init__(self, path: str, keep_words: int = 200_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.strings = [""] * size
        for s, i in [*self.vocab.items(), *self.special.items()]:
            self.strings[i] = s
        self.strings_np = np.array(self.strings, dtype=object)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        self.rank = {m: r for r, m in enumerate(merges)}
        # how each token is built: its merge's rank and two parts; letters have none
        self.made_rank = np.full(size, -1, np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        pair_key, pair_rank = [], []
        for r, (a, b) in enumerate(merges):
            x, y, z = self.vocab[a], self.vocab[b], self.vocab[a + b]
            pair_key.append(x * size + y)
            pair_rank.append(r)
            if self.made_rank[z] < 0:
                self.made_rank[z], self.left[z], self.right[z] = r, x, y
        self.rank_token = np.array([self.vocab[a + b] for a, b in merges], np.int64)
        self._hash_pairs(np.array(pair_key, np.int64), np.array(pair_rank, np.int64))
        self.size = size
        # the file's own pre-tokenizer pattern, applied to text with single spaces
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"[^\s", r"[^\p{White_Space}"))
        self.letters = byte_letters()
        self.translate = {b: c for b, c in enumerate(self.letters)}
        self.letter_id, self.letter_end_id = np.full(512, -1, np.int64), np.full(512, -1, np.int64)
        for c in self.letters:
            self.letter_id[ord(c)], self.letter_end_id[ord(c)] = self.vocab[c], self.vocab[c + self.end]
        self.open = {s: i for s, i in self.vocab.items() if not s.endswith(self.end)}
        self.close = {s[: -len(self.end)]: i for s, i in self.vocab.items() if s.endswith(self.end) and s != self.end}
        self.keep_words = keep_words
        self.known: dict[str | int, bytes] = {}
        self._drop_unreachable()
        self.match = ahocorasick.Automaton()
        for t, i in self.open.items():
            self.match.add_word(t, (len(t), i))
        for t, i in self.close.items():
            self.match.add_word(t + CLOSE, (len(t) + 1, i))
        self.match.make_automaton()

    def _hash_pairs(self, key: np.ndarray, rank: np.ndarray) -> None:
        """A hash table of the merges, with open addressing, that numpy can probe for many pairs at once."""
        self.bits = max(4, int(len(key) * 6).bit_length())
        self.slot_key, self.slot_rank = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NEVER, np.int64)
        at, self.probes, rest = self._slot(key), 0, np.arange(len(key))
        while len(rest):
            free = self.slot_key[at[rest]] < 0
            _, first = np.unique(at[rest], return_index=True)
            put = np.intersect1d(first, np.flatnonzero(free))
            self.slot_key[at[rest[put]]], self.slot_rank[at[rest[put]]] = key[rest[put]], rank[rest[put]]
            rest = np.delete(rest, put)
            at[rest] = (at[rest] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _drop_unreachable(self) -> None:
        """A token is proposed only if exact merging of its string gives it; a token's own two parts must be compatible but for its merge."""
        made = np.flatnonzero(self.made_rank >= 0)
        bad = ~self._compatible(self.left[made], self.right[made], self.made_rank[made])
        for i in made[bad]:
            s = self.strings[i]
            if s.endswith(self.end):
                if self._merge(s[: -len(self.end)]) != [i]:
                    self.close.pop(s[: -len(self.end)], None)
            elif self._merge(s, "") != [i]:
                self.open.pop(s, None)

    def _rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, NEVER if there is none."""
        key = a * self.size + b
        at = self._slot(key)
        out = np.where(self.slot_key[at] == key, self.slot_rank[at], NEVER)
        open_ = np.flatnonzero((self.slot_key[at] != key) & (self.slot_key[at] >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            found = self.slot_key[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.slot_rank[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def _compatible(self, first: np.ndarray, second: np.ndarray, allowed: np.ndarray | None = None) -> np.ndarray:
        """Whether exact merging keeps each pair of tokens apart. allowed: the rank of one merge that may join them.

        The pair's history is undone from its last merge to its first. At each
        point the tokens on the two sides of the boundary stand next to each
        other until the next merge, whose rank is the limit: a merge of the two
        with a lower rank would have been done before. At equal rank the left
        one of the places goes first, which is the merge inside the left token.
        """
        n = len(first)
        ok = np.ones(n, bool)
        live = np.arange(n)
        a, b = first.copy(), second.copy()
        limit = np.full(n, NEVER) if allowed is None else allowed.copy()
        while len(live):
            joint = self._rank_of(a, b)
            fails = joint < limit
            ok[live[fails]] = False
            ra, rb = self.made_rank[a], self.made_rank[b]
            go = ~fails & ((ra >= 0) | (rb >= 0))
            live, a, b, ra, rb = live[go], a[go], b[go], ra[go], rb[go]
            # undo the later merge; of two with equal rank the right one was done last
            undo_left = ra > rb
            # a pair that would merge at the very rank of the undone merge loses only to a place on its left
            limit = np.where(undo_left, ra, rb + 1)
            a = np.where(undo_left, self.right[a], a)
            b = np.where(undo_left, b, self.left[b])
        return ok

    def _merge(self, word: str, end: str | None = None) -> list[int]:
        """Exact BPE of one word in byte letters: a heap of merges over a linked list of parts."""
        end = self.end if end is None else end
        parts: list[str | None] = [*word[:-1], word[-1] + end]
        n, rank = len(parts), self.rank
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank.get((parts[i], parts[i + 1]))) is not None]
        heapify(heap)
        while heap:
            _, i, x, y = heappop(heap)
            j = after[i]
            if parts[i] != x or j < 0 or parts[j] != y:
                continue  # one of the two is gone
            parts[i], parts[j] = x + y, None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := rank.get((parts[a], parts[b]))) is not None:
                    heappush(heap, (r, a, parts[a], parts[b]))
        return [self.vocab[p] for p in parts if p is not None]

    def _merge_many(self, words: list[str]) -> list[np.ndarray]:
        """Exact BPE of words side by side: each step does the first-ranked merge of every word."""
        out: list = [None] * len(words)
        size = np.array([len(w) for w in words])
        width = np.int64(1) << np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64)
        for w in np.unique(width):
            rows = np.flatnonzero(width == w)
            if w > WIDE:
                for i in rows:
                    out[i] = np.array(self._merge(words[i]), np.int64)
                continue
            token = np.full((len(rows), w + 1), -1, np.int64)
            for n in np.unique(size[rows]):  # letters by code point, the last one closes the word
                same = np.flatnonzero(size[rows] == n)
                code = np.frombuffer("".join(words[rows[i]] for i in same).encode("utf-32-le"), np.uint32).reshape(len(same), n)
                token[same, :n] = self.letter_id[code]
                token[same, n - 1] = self.letter_end_id[code[:, -1]]
            rank = np.full((len(rows), w + 1), NEVER, np.int64)
            pair = token[:, 1:] >= 0
            rank[:, :-1][pair] = self._rank_of(token[:, :-1][pair], token[:, 1:][pair])
            column = np.arange(w)[None, :]
            while len(rows):
                at = rank.argmin(axis=1)
                best = rank[np.arange(len(rows)), at]
                done = np.flatnonzero(best == NEVER)
                for i in done:
                    out[rows[i]] = token[i][token[i] >= 0]
                keep = best < NEVER
                rows, token, rank, at, best = rows[keep], token[keep], rank[keep], at[keep], best[keep]
                if not len(rows):
                    break
                line = np.arange(len(rows))
                shift = column > at[:, None]
                token[:, :-1] = np.where(shift, token[:, 1:], token[:, :-1])
                rank[:, :-1] = np.where(shift, rank[:, 1:], rank[:, :-1])
                token[line, at] = self.rank_token[best]
                rank[line, at] = NEVER
                some = np.flatnonzero(token[line, at + 1] >= 0)
                rank[some, at[some]] = self._rank_of(token[some, at[some]], token[some, at[some] + 1])
                some = np.flatnonzero(at > 0)
                rank[some, at[some] - 1] = self._rank_of(token[some, at[some] - 1], token[some, at[some]])
        return out

    def propose(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Longest match first over words in byte letters: ids, each one's word, and which words are not covered."""
        text = CLOSE.join(words) + CLOSE
        found = list(self.match.iter_long(text))
        last = np.fromiter((f[0] for f in found), np.int64, len(found))
        size = np.fromiter((f[1][0] for f in found), np.int64, len(found))
        ids = np.fromiter((f[1][1] for f in found), np.int64, len(found))
        close = np.cumsum([len(w) + 1 for w in words]) - 1  # where each word's end mark stands
        word = np.searchsorted(close, last)
        covered = np.bincount(word, size, len(words))
        return ids, word, covered != np.diff(close, prepend=-1)

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word (a pre-token): proposals, pair tests, exact merging of the words that fail."""
        if not words:
            return []
        mapped = [w if w.isascii() and w.isalnum() else w.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.translate) for w in words]
        ids, word, failed = self.propose(mapped)
        inner = np.flatnonzero(word[1:] == word[:-1])
        key, back = np.unique(ids[inner] * self.size + ids[inner + 1], return_inverse=True)
        fine = self._compatible(key // self.size, key % self.size)[back]
        failed[word[inner[~fine]]] = True
        out = np.split(ids, np.searchsorted(word, np.arange(1, len(words))))
        again = np.flatnonzero(failed)
        for i, exact in zip(again, self._merge_many([mapped[i] for i in again]), strict=True):
            out[i] = exact
        return out

    def normalize(self, text: str) -> str:
        """NFC, each run of white space as one space, lower case of each character by itself."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:
                text = text.replace("Σ", "σ")
        return text.lower()

    def pretokens(self, text: str) -> list:
        """Words of a text in order; special tokens are ints."""
        if self.split_special is None or "<|" not in text:
            return self.words.findall(self.normalize(text))
        out: list = []
        for i, piece in enumerate(self.split_special.split(text)):
            if i % 2:
                out.append(self.special[piece])
            elif piece:
                out += self.words.findall(self.normalize(piece))
        return out

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """uint32 ids of each text."""
        split = [self.pretokens(t) if t else [] for t in texts]
        known = self.known
        if len(known) > self.keep_words:
            known.clear()  # only a memory of results; nothing is lost
        for i in self.special.values():
            known[i] = np.uint32(i).tobytes()
        new = list(set().union(*split).difference(known))
        known.update((w, i.astype("<u4").tobytes()) for w, i in zip(new, self.encode_words(new), strict=True))
        return [np.frombuffer(b"".join(map(known.__getitem__, words)), "<u4") for words in split]

    def decode(self, ids: np.ndarray) -> str:
        """The tokens' strings joined by spaces: the file names no decoder."""
        return " ".join(self.strings_np[ids])


def tokenizer_text(spec_path: str, keep_words: int = 200_000) -> WordBPE:
    """The tokenizer of a path, read once in each Python worker."""
    key = (spec_path, keep_words)
    if key not in _OPEN:
        _OPEN[key] = WordBPE(spec_path, keep_words)
    return _OPEN[key]


_OPEN: dict[tuple[str, int], WordBPE] = {}


def encode(df: DataFrame, id_col: str, text_col: str, spec_path: str) -> DataFrame:
    """(id, ids array<int>) of every row."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = tokenizer_text(spec_path).encode_batch(batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32()))], ["id", "ids"])

    return map_batches(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, id_col: str, ids_col: str, spec_path: str) -> DataFrame:
    """(id, text) of every row of ids; null ids give an empty text."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        t = tokenizer_text(spec_path)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.decode(np.array(i or [], np.int64)) for i in batch.column(1).to_pylist()], pa.string())], ["id", "text"])

    return map_batches(df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")), run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def round_trip_digest(df: DataFrame, id_col: str, text_col: str, spec_path: str) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): ids and their decoding, as digests."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        t = tokenizer_text(spec_path)
        ids = t.encode_batch(batch.column(1).to_pylist())
        sha = lambda b: hashlib.sha256(b).hexdigest()
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(i) for i in ids], pa.int64()), pa.array([sha(i.astype("<u4").tobytes()) for i in ids]), pa.array([sha(t.decode(i).encode("utf-8")) for i in ids])],
            ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return map_batches(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
