"""Personal data by candidate gradient boosting.

Generators of high recall propose spans that may overlap: the four base patterns
as they match before their checks, and loose forms (numbers in groups, written-out
at and dot, identity numbers, key-like tokens, values after a naming word). Each
candidate becomes a row of format features (lengths, character classes, check
digits, separators) and context features (the words and signs around it). Boosted
regression trees on the logistic loss score it. For each kind a threshold is
calibrated on rows the trees have not seen: the least one that reaches the asked
precision. These rows are all raw base matches of the whole corpus that are unlike
those fitted on, counted by kind and step of the score, and held-out examples.
Spans above it are selected greedily by score, without overlaps; base
spans always stay and come first.

The trees learn from a bounded sample of the corpus, taken by hash (raw base
matches, labelled by their own checks) and from examples written by format grammars with a fixed seed.

A null text counts as empty; rows that repeat are each searched. All scans are
linear in the text, also for long runs of one character, and spans may be of any
length. Columns other than id and text are not read, or stay as they are
(``redact``), whatever their names. With an empty table the grammar's examples
alone are learned.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import below, drop_stored, map_batches, stored

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "id", "secret")
SAMPLE_ROWS = 4_000  # different texts with digits or @ that the trees are fitted on, about; those with the least hash
EXAMPLES = 16_000  # base matches of these texts that are fitted on, about; those with the least hash
PRECISION = 0.98
STEPS = 4_096  # of the scores that thresholds are chosen from
CONTEXT = 24  # characters on each side that features look at

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9][0-9.]*")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SIGN = re.compile(r"[0-9@=:]|[ \[({]at[ \])}]", re.I)  # every generator needs one of these

LOOSE = (
    ("email", re.compile(r"(?<![A-Za-z0-9_.-])[A-Za-z0-9_.-]++ ?(?:\[at\]|\(at\)|\{at\}| at ) ?[A-Za-z0-9-]++(?: ?(?:\[dot\]|\(dot\)|\{dot\}| dot |\.) ?[A-Za-z0-9-]{2,}+)+", re.I)),
    ("phone", re.compile(r"(?<![0-9A-Za-z.+])\(?[0-9]{2,4}\)?(?:[ ./-]{1,2}[0-9]{2,4}){2,4}(?![0-9A-Za-z])")),
    ("phone", re.compile(r"(?<![0-9A-Za-z.+])0[0-9]{8,11}(?![0-9A-Za-z])")),
    ("card", re.compile(r"(?<![0-9A-Za-z])[0-9]{4}(?:[ .·-]{1,2}[0-9]{4}){3}(?![0-9A-Za-z])")),
    ("id", re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")),
    ("id", re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])")),
    ("secret", re.compile(r"(?<![0-9A-Za-z_/+-])[A-Za-z0-9_/+-]{16,}+")),
    ("secret", re.compile(r"(?<=[=:])[^\s=:,;]{6,}+")),
)

# Words that name what follows them, by kind.
NAMING = {
    "email": ("mail", "email", "e-mail", "contact", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "kreditkarte", "carte", "tarjeta", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "cell"),
    "id": ("ssn", "iban", "passport", "id", "social", "account"),
    "secret": ("password", "passwd", "token", "key", "secret", "pwd", "apikey", "api_key"),
}
OTHER_NAMES = ("version", "page", "year", "isbn", "chapter", "section", "article", "total", "price", "date", "no", "license")


@dataclass(frozen=True)
class Candidate:
    kind: str
    start: int
    end: int
    base: bool = False  # passed the base checks
    raw: bool = False  # matched a base pattern


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_matches(text: str) -> list[Candidate]:
    """Leftmost non-overlapping matches of the base patterns, with whether each passes its check."""
    out: list[Candidate] = []
    free, before, at = 0, 0, text.find("@")
    while at >= 0:
        lo = max(free, before)
        start = lo + len(text[lo:at].rstrip(LOCAL))
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append(Candidate("email", start, m.end(), True, True))
            free = m.end()
        before = at + 1
        at = text.find("@", max(at + 1, free))
    for run in DOTTED.finditer(text):
        if run.group().count(".") >= 3:
            for m in IP.finditer(text, run.start(), run.end()):
                out.append(Candidate("ip", *m.span(), all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")), True))
    for m in CARD.finditer(text):
        digits = _only_digits(m.group())
        if len(digits) >= 9:
            out.append(Candidate("card", *m.span(), 14 <= len(digits) <= 19 and luhn(digits), True))
    for m in PHONE.finditer(text):
        out.append(Candidate("phone", *m.span(), 10 <= len(_only_digits(m.group())) <= 15, True))
    return out


def candidates(text: str) -> list[Candidate]:
    """Base matches and loose forms; spans may overlap."""
    if not text or not SIGN.search(text):
        return []
    out = base_matches(text)
    seen = {(c.kind, c.start, c.end) for c in out}
    for kind, pattern in LOOSE:
        for m in pattern.finditer(text):
            s = m.group()
            if kind == "secret" and not (any(c.isdigit() for c in s) and any(c.isalpha() for c in s)):
                continue
            if (kind, *m.span()) not in seen:
                seen.add((kind, *m.span()))
                out.append(Candidate(kind, *m.span()))
    return out


def features(text: str, c: Candidate) -> list[float]:
    s = text[c.start : c.end]
    digits = _only_digits(s)
    letters = sum(ch.isalpha() for ch in s)
    upper = sum(ch.isupper() for ch in s)
    left, right = text[max(0, c.start - CONTEXT) : c.start], text[c.end : c.end + CONTEXT]
    words = re.findall(r"[\w-]+", left.lower())[-3:]
    groups = re.findall(r"[0-9]+", s)
    parts = [int(g[:6]) for g in groups[:8]]
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(s, s[1:], strict=False))
    naming = [any(w in NAMING[k] for w in words) for k in KINDS]
    return [
        KINDS.index(c.kind), len(s), len(digits), letters, len(s) - len(digits) - letters, upper / max(1, letters), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        max(parts, default=0), luhn(digits) if digits else 0, s.count("."), s.count("-"), s.count(" "), s.count("@") + 2 * (" at " in s or "at]" in s or "at)" in s), s.startswith("+"), "(" in s, turns, len(set(s)) / max(1, len(s)),
        *naming, naming[KINDS.index(c.kind)], any(w in OTHER_NAMES for w in words), left[-1:] in "=:", left[-1:].isspace() or not left, right[:1].isspace() or not right, right[:1] in ".,;)", 19 <= parts[0] // 100 <= 20 if parts else 0,
    ]


@dataclass
class Booster:
    """Boosted trees of a fixed depth on binned features."""

    cuts: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # feature, bin, leaf value
    start: float = 0.0
    threshold: dict[str, float] = field(default_factory=dict)

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)], axis=1) if len(x) else np.zeros((0, len(self.cuts)), np.int64)

    @staticmethod
    def _leaf(tree, b: np.ndarray, depth: int) -> np.ndarray:
        node = np.zeros(len(b), np.int64)
        for _ in range(depth):
            node = 2 * node + 1 + (b[np.arange(len(b)), tree[0][node]] > tree[1][node])
        return node - ((1 << depth) - 1)

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, damp: float = 1.0) -> Booster:
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
        b = self._bins(x)
        p0 = np.clip(y.mean(), 0.01, 0.99)
        self.start = float(np.log(p0 / (1 - p0)))
        score = np.full(len(y), self.start)
        inner = (1 << depth) - 1
        self.depth = depth
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            feature, cut = np.zeros(inner, np.int64), np.full(inner, bins, np.int64)
            node = np.zeros(len(y), np.int64)
            for d in range(depth):
                for n in range((1 << d) - 1, (2 << d) - 1):
                    rows = np.flatnonzero(node == n)
                    best = 1e-9
                    gs, hs = g[rows].sum(), h[rows].sum()
                    for j in range(x.shape[1]) if len(rows) > 1 else ():
                        cg = np.cumsum(np.bincount(b[rows, j], g[rows], bins + 1))[:-1]
                        ch = np.cumsum(np.bincount(b[rows, j], h[rows], bins + 1))[:-1]
                        gain = cg**2 / (ch + damp) + (gs - cg) ** 2 / (hs - ch + damp) - gs**2 / (hs + damp)
                        at = int(gain.argmax())
                        if gain[at] > best:
                            best, feature[n], cut[n] = gain[at], j, at
                    node[rows] = 2 * n + 1 + (b[rows, feature[n]] > cut[n])
            leaf = node - inner
            value = rate * np.bincount(leaf, g, 1 << depth) / (np.bincount(leaf, h, 1 << depth) + damp)
            score += value[leaf]
            self.trees.append((feature, cut, value))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = self._bins(x)
        score = np.full(len(x), self.start)
        for tree in self.trees:
            score += tree[2][self._leaf(tree, b, self.depth)]
        return 1 / (1 + np.exp(-score))

    def steps(self, x: np.ndarray) -> np.ndarray:
        """The step of each row's score, from 0 to STEPS."""
        return (self.predict(x) * STEPS).astype(np.int64)

    def calibrate(self, kind: np.ndarray, step: np.ndarray, good: np.ndarray, total: np.ndarray, precision: float) -> Booster:
        """For each kind the least step with rows from which on they reach the precision; 0.5 at least. good and total are rows (or their weight) of a kind and step."""
        for n, k in enumerate(KINDS):
            mine = kind == n
            g, t = (np.bincount(step[mine], w[mine], STEPS + 1) for w in (good, total))
            above = [np.cumsum(v[::-1])[::-1] for v in (g, t)]
            fine = np.flatnonzero((t > 0) & (above[0] >= precision * above[1]))
            self.threshold[k] = max(0.5, float(fine[0] / STEPS)) if len(fine) else 2.0
        return self


def digest(row: np.ndarray) -> bytes:
    """Names a row of features."""
    return hashlib.md5(row.tobytes()).digest()


def _examples(n: int = 3_000, seed: int = 7) -> tuple[list[list[float]], list[int]]:
    """Rows and labels written by format grammars: personal data in loose forms, and what looks like it."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("etaoinshrdlucmfw") for _ in range(r.randint(2, 9)))
    sep = lambda: r.choice([" ", "-", "."])

    def card() -> str:
        body = r.choice("3456") + d(r.choice([13, 14]))
        return body + next(c for c in "0123456789" if luhn(body + c))

    def grouped(s: str, g: str) -> str:
        return g.join(s[i : i + 4] for i in range(0, len(s), 4))

    def key(k: int) -> str:
        return "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(k))

    def mixed(k: int) -> str:
        return "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(k))

    good = [
        lambda: ("email", f"{word()}{r.choice([' at ', ' [at] ', '(at)'])}{word()}{r.choice([' dot ', '.', ' [dot] '])}com"), lambda: ("email", f"{word()}.{d(2)}@{word()}.org"), lambda: ("phone", f"({d(3)}) {d(3)}-{d(4)}"), lambda: ("phone", sep().join([d(3), d(3), d(4)])), lambda: ("phone", "0" + d(10)), lambda: ("phone", f"+{d(2)} {d(3)} {d(6)}"),
        lambda: ("card", grouped(card(), sep())), lambda: ("card", card()), lambda: ("id", f"{d(3)}-{d(2)}-{d(4)}"), lambda: ("id", grouped("DE" + d(20), " ")), lambda: ("secret", "AKIA" + key(16)), lambda: ("secret", mixed(r.choice([20, 32, 40]))), lambda: ("secret", "".join(r.choice("0123456789abcdef") for _ in range(r.choice([16, 18, 32, 40])))), lambda: ("ip", ".".join(str(r.randint(1, 255)) for _ in range(4))),
    ]
    bad = [
        lambda: ("phone", f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}"), lambda: ("phone", f"{r.randint(10, 28)}.{r.randint(10, 12)}.{r.randint(1900, 2030)}"), lambda: ("card", d(r.choice([9, 10, 12, 21, 24]))), lambda: ("card", "9" * 16), lambda: ("phone", " ".join(d(2) for _ in range(4))), lambda: ("ip", ".".join(str(r.randint(200, 999)) for _ in range(4))), lambda: ("secret", word() + "-" + word() + "-" + word() + d(1)), lambda: ("secret", word() * 3 + d(2)),
        lambda: ("email", f"{word()} at {word()}. {word()}"), lambda: ("phone", f"{d(2)}-{d(3)}-{d(2)}"), lambda: ("phone", "+" + d(4) + " " + d(2)), lambda: ("id", "AB12 " + " ".join(key(4) for _ in range(3))), lambda: ("secret", "https-" + word() + "/" + word() + "/" + d(3)),
    ]
    rows, labels = [], []
    for i in range(n):
        label = i % 2
        kind, span = r.choice(good if label else bad)()
        lead = r.choice([word(), word(), word(), r.choice(NAMING[kind] if label else OTHER_NAMES)])
        joint = "=" if kind == "secret" and label and r.random() < 0.4 else " "
        text = f"{word()} {word()} {lead}{joint}{span}{r.choice([' ', ', ', '. '])}{word()}"
        at = text.index(span, len(lead))
        rows.append(features(text, Candidate(kind, at, at + len(span))))
        labels.append(label)
    return rows, labels


def train(df: DataFrame, text_col: str, sample_rows: int = SAMPLE_ROWS, precision: float = PRECISION, rounds: int = 60) -> Booster:
    """Fit the trees on about sample_rows different texts with digits or @ and on the grammar's examples, and calibrate the thresholds on all texts.

    Texts and matches to fit on are taken by hash thresholds: the model depends on the rows, not on files, tasks or their order.
    In the calibration all matches of the corpus together weigh as much as those of the sample that are not fitted on.
    """
    rows = df.filter(F.col(text_col).rlike("[0-9@]")).select(F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    texts = below(rows, "h", sample_rows).groupBy("h").agg(F.min("text").alias("text")).select("text")

    def label(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x, y = [], []
        for text in batch.column(0).to_pylist():
            for c in base_matches(text):
                x.append([float(v) for v in features(text, c)])
                y.append(int(c.base))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.int32())], ["x", "y"])

    matches = stored(map_batches(texts, label, "x array<double>, y int"), "matches")
    found = below(matches.withColumn("h", F.xxhash64("x", "y")).distinct(), "h", EXAMPLES).orderBy("h", "x", "y").toPandas()
    drop_stored(matches)
    gx, gy = _examples()
    x = np.array([*gx, *map(list, found["x"])], np.float64)
    y = np.array([*gy, *found["y"]], np.float64)
    # a third is kept for calibration, by the row's own digest: the split does not depend on the order of rows
    named = [digest(r) for r in x]
    third = np.array([d[0] % 3 == 0 for d in named])
    model = Booster().fit(x[~third], y[~third], rounds)
    every = tally(df, model, text_col, {d for d, t in zip(named, third, strict=True) if not t}).toPandas()
    weight = third[len(gx) :].sum() / max(1, every["total"].sum())
    own = np.flatnonzero(third[: len(gx)])
    joined = lambda mine, of: np.concatenate([mine, of.to_numpy()])
    return model.calibrate(joined(x[own, 0].astype(np.int64), every["kind"]), joined(model.steps(x[own]), every["step"]), joined(y[own], every["good"] * weight), joined(np.ones(len(own)), every["total"] * weight), precision)


def tally(df: DataFrame, model: Booster, text_col: str, fitted: set[bytes]) -> DataFrame:
    """(kind, step, good, total): raw base matches of all rows by kind and step of the score, and how many pass their check; without those whose features are fitted on."""
    shipped = df.sparkSession.sparkContext.broadcast((model, fitted))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        trees, seen = shipped.value
        found = [(features(t, c), c.base) for t in batch.column(0).to_pylist() for c in base_matches(t)]
        x = np.array([f for f, _ in found], np.float64).reshape(len(found), -1)
        new = np.array([digest(r) not in seen for r in x], bool)
        if new.any():
            key = x[new, 0].astype(np.int64) * (STEPS + 1) + trees.steps(x[new])
            keys, at = np.unique(key, return_inverse=True)
            good = np.bincount(at, np.array([b for _, b in found], np.int64)[new]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (keys // (STEPS + 1), keys % (STEPS + 1), good, np.bincount(at))], ["kind", "step", "good", "total"])

    parts = map_batches(df.filter(F.col(text_col).rlike("[0-9@]")).select(F.col(text_col).alias("text")), run, "kind long, step long, good long, total long")
    return parts.groupBy("kind", "step").agg(F.sum("good").alias("good"), F.sum("total").alias("total"))


def select(text: str, found: list[Candidate], score: np.ndarray, threshold: dict[str, float]) -> list[Candidate]:
    """Base spans, and the best-scored others above their kind's threshold that overlap nothing selected before."""
    base = [c for c in found if c.base]
    out = list(base)
    # what is taken, as disjoint intervals in order
    starts: list[int] = []
    ends: list[int] = []
    for c in sorted(base, key=lambda c: (c.start, c.end)):
        if ends and c.start < ends[-1]:
            ends[-1] = max(ends[-1], c.end)
        else:
            starts.append(c.start)
            ends.append(c.end)
    for p, c in sorted(zip(score.tolist(), found, strict=True), key=lambda t: (-t[0], t[1].start, -t[1].end, t[1].kind)):
        if c.base or p < threshold[c.kind]:
            continue
        at = bisect_left(starts, c.end)
        if at and ends[at - 1] > c.start:
            continue
        starts.insert(at, c.start)
        ends.insert(at, c.end)
        out.append(c)
    return sorted(out, key=lambda c: (c.start, KINDS.index(c.kind), c.end))


def find_batch(model: Booster, texts: list[str | None]) -> list[list[Candidate]]:
    """Selected spans of each text."""
    found = [candidates(t) if t else [] for t in texts]
    x = [features(t, c) for t, cs in zip(texts, found, strict=True) for c in cs]
    score = model.predict(np.array(x, np.float64)) if x else np.zeros(0)
    out, at = [], 0
    for t, cs in zip(texts, found, strict=True):
        out.append(select(t, cs, score[at : at + len(cs)], model.threshold) if cs else [])
        at += len(cs)
    return out


def _joined(spans: list[Candidate]) -> str:
    return ",".join(f"{c.kind}:{c.start}:{c.end}" for c in spans)


def find(df: DataFrame, model: Booster, id_col: str, text_col: str) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row."""
    kind = df.schema[id_col].dataType.simpleString()
    shipped = df.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = find_batch(shipped.value, batch.column(1).to_pylist())
        base = [[c for c in cs if c.base] for cs in found]
        counts = [pa.array([sum(c.kind == k for c in cs) for cs in base], pa.int64()) for k in BASE]
        sha = pa.array([hashlib.sha256(_joined(cs).encode()).hexdigest() for cs in base])
        yield pa.RecordBatch.from_arrays([batch.column(0), *counts, sha, pa.array([_joined(cs) for cs in found], pa.string())], ["id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    schema = f"id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return map_batches(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, schema).withColumnRenamed("id", id_col)


def redact_text(text: str, spans: list[Candidate]) -> str:
    """The text with each span as its kind in brackets; overlapping base spans become one."""
    out, at = [], 0
    for c in spans:
        if c.start >= at:
            out += [text[at : c.start], f"<{c.kind.upper()}>"]
        at = max(at, c.end)
    return "".join(out) + text[at:]


def redact(df: DataFrame, model: Booster, text_col: str) -> DataFrame:
    """df with the selected spans of its text column replaced; all other columns and rows as they are."""
    shipped = df.sparkSession.sparkContext.broadcast(model)
    place = df.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = batch.column(place).to_pylist()
        new = [redact_text(t, cs) if cs else t for t, cs in zip(texts, find_batch(shipped.value, texts), strict=True)]
        yield batch.set_column(place, batch.schema.field(place), pa.array(new, batch.schema.field(place).type))

    return map_batches(df, run, df.schema)
