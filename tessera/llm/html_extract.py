"""Main text of web pages by equivalence-class template deduction.

Pages of one host share a template, and those of one section (first folder) a further one. A page is a sequence of tokens: the
opening and the end of each block element, named by its path of block elements, and each word, named by word and path, by the word
before it in its block, by whether it ends the block, and by how many like it came before on the page. Tokens that occur equally often on every page of a host or section (equal occurrence vectors) form an
equivalence class. A class of two tokens or more on at least half of the pages (words: TEXT_SHARE of them), and on MIN_PAGES different
ones, is part of the template. On a page it is valid if its tokens stand in the template's order and its span nests with the other classes' spans.

What stands between the template's tags are slots. Over all pages of the host or section the text of each slot is counted by what the
elements around it are: inside an article or main element, marked as menu, header, footer, sidebar, notice, advert, form, comments or
hidden (by tag, role, class or id; inside an article by tag and role only, and by whole names of adverts, widgets and comments), or neither. That
names the slot, once for all pages, as content or not. A page's text is what stands in its content slots, without blocks whose words
are all fixed text of the template. Elements that the template has not are named by themselves, and a page whose host and section have
too few pages is a template of its own. Where templates are withheld no slot is named, and all text is returned (``main_text``).

Three scans, each of them only parses:

1. Candidates. A slice of the table sends a token of a host if it is on half (words: TEXT_SHARE) of the slice's pages of this host. A
   token on that share of all pages is sent by some slice, and the pages that others may have beside are bounded, so nothing is lost,
   and what is left for a host is at most about twice the tokens of a page.
2. Vectors. A vector is named by the sum of count * hash(page) over the pages (two 32-bit halves), the pages and the occurrences with it;
   sums are made map-side, so a host's size is no matter. Equal pages have equal hashes: they change no class, and different pages are
   counted by 64-bit masks. The slots' text is counted too.
3. Extraction.

Candidates and templates are joined to the pages by host and section, by broadcast only if their checked size is small, else salted.

Null html gives an empty text; a page without a host is its own host's member ("" as host). Repeated pages and ids are extracted each for
itself. Unclosed, cut-off and mis-nested markup is read as far as it goes, in linear time, and very long pages whole. Columns other
than the three named ones are not read, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import drop_stored, map_batches, stored

MIN_PAGES = 3  # different pages that a class of tags must be on
TEXT_PAGES = 4  # and one of words
TEXT_SHARE = 0.9  # and the share of a host's or section's pages for words: a line that many of its articles share is no template
BROADCAST_TOKENS = 500_000  # tokens, over all hosts and sections, that are broadcast at most
SALTS = 32

# Element names by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg textarea title select object canvas math audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul button".split()
)
CHROME = frozenset("nav footer aside form head menu dialog button fieldset".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
CHROME_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay subscribe newsletter paywall sidebar rail menu nav navbar navigation navi breadcrumb breadcrumbs topbar toolbar masthead header footer copyright legal comment comments commentlist respond reply replies discussion disqus share sharing social related recommended recommendations widget widgets login signin signup search pagination pager skip toc tags hidden".split()
)
DISCUSSION = frozenset("comment comments commentlist respond reply replies discussion disqus".split())
READERS = frozenset("comment comments commentlist disqus".split())  # inside an article, where a discussion may be its own
# inside an article only whole names count, of what is never a part of its text
WIDGETS = frozenset("ad ads advert adverts advertisement adsbygoogle share-bar share-buttons social-share sharing related related-posts related-articles related-links newsletter newsletter-signup sidebar breadcrumb breadcrumbs pagination cookie-notice".split())
STATES = frozenset("no not has have with without is hide".split())  # "no-comments": a word on the layout, not a name of the element
NONE, MAIN, WEAK, TALK, STRONG = range(5)  # how an element is marked: as an article, as chrome by a layout word or form, as a discussion, by tag, role or hidden
CLOSED_BY_BLOCK = frozenset(("p",))
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}

TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>")
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
PART = re.compile(r"[a-z]+")
INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
RAW_END = {name: re.compile(f"</{name}\\b[^>]*>", re.I) for name in RAW}
ALL = (1 << 64) - 1

IN_MAIN, PLAIN, OUT = range(3)  # what the elements around a block are


@dataclass(slots=True)
class Block:
    text: str
    path: int  # of its elements
    after: int  # the tag token before it
    scope: int  # the innermost marked element around it
    kind: int = PLAIN


@dataclass(slots=True)
class Page:
    tags: list[int] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)


def _named_chrome(value: str, inside_main: bool) -> int:
    """The mark that the names of a class or id give."""
    mark = NONE
    for name in value.split():
        if inside_main and name in WIDGETS:
            return WEAK
        parts = PART.findall(name)
        if not parts or len(parts) > 1 and parts[0] in STATES:
            continue
        if inside_main:
            mark = max(mark, NONE if READERS.isdisjoint(parts) else TALK)
        elif not CHROME_NAMES.isdisjoint(parts):
            mark = max(mark, WEAK if DISCUSSION.isdisjoint(parts) else TALK)
    return mark


def _chrome(name: str, attributes: list[tuple[str, str]], inside_main: bool) -> int:
    mark = NONE
    if name in CHROME:
        mark = WEAK if name in ("form", "fieldset") else STRONG
    if name == "header" and not inside_main:
        mark = STRONG
    for key, value in attributes:
        if key == "role":
            if value.strip() in CHROME_ROLES:
                return STRONG
        elif key == "hidden" or key == "aria-hidden" and value == "true":
            return STRONG
        elif key == "style":
            if INVISIBLE.search(value):
                return STRONG
        elif key in ("class", "id") and name not in ("article", "main", "body", "html"):
            mark = max(mark, _named_chrome(value, inside_main))
    return mark


def parse(html: str | None) -> Page:
    """Tag tokens and text blocks of a page, and what the elements around each block are."""
    page = Page()
    if not html:
        return page
    tags, blocks = page.tags, page.blocks
    # marked elements: the one around, mark, first and last block, whether a main element is inside
    scopes: list[list] = [[0, NONE, 0, 0, False]]
    stack: list[tuple[str, int, int, bool]] = [("", 0, 0, False)]  # open block elements: name, hash of the path, scope, in an article or main element
    open_names: dict[str, int] = {}
    pieces: list[str] = []
    at, n = 0, len(html)

    def leave(i: int) -> None:
        for j in range(len(stack) - 1, i - 1, -1):
            name, path, scope, _ = stack[j]
            tags.append(~path & ALL)
            open_names[name] -= 1
            if scope != stack[j - 1][2]:
                scopes[scope][3] = len(blocks)
        del stack[i:]

    def flush() -> None:
        if not pieces:
            return
        raw = "".join(pieces)
        pieces.clear()
        text = " ".join((entities.unescape(raw) if "&" in raw else raw).split())
        if text:
            blocks.append(Block(text, stack[-1][1], len(tags) - 1, stack[-1][2]))

    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            pieces.append(html[at:])
            break
        if lt > at:
            pieces.append(html[at:lt])
        nxt = html[lt + 1 : lt + 2]
        if nxt == "!" or nxt == "?":
            # "<!-->" and "<!--->" are whole comments
            end = html.find("-->", lt + 2) + 3 if html.startswith("<!--", lt) else html.find(">", lt) + 1
            if end <= lt:
                break  # cut off
            at = end
            continue
        m = TAG.match(html, lt) or LOOSE_TAG.match(html, lt)
        if not m:
            if nxt.isalpha() or nxt == "/":
                if html.find(">", lt) < 0:
                    break  # a tag that is cut off
                at = html.find(">", lt) + 1
            else:
                pieces.append("<")
                at = lt + 1
            continue
        close, name, rest = m[1], m[2].lower(), m[3]
        at = m.end()
        if name in RAW:
            if not close and not rest.endswith("/"):
                end = RAW_END[name].search(html, at)
                at = end.end() if end else n
            continue
        if name not in BLOCK:
            if name in ("br", "img", "wbr", "input"):
                pieces.append(" ")
            continue
        flush()
        if close:
            if open_names.get(name):
                i = len(stack) - 1
                while stack[i][0] != name:
                    i -= 1
                leave(i)
            continue
        if stack[-1][0] in CLOSED_BY_BLOCK:
            leave(len(stack) - 1)
        if stack[-1][0] in CLOSES.get(name, ()):
            leave(len(stack) - 1)
        _, path, scope, main = stack[-1]
        attributes = [(a[1].lower(), (a[2] or a[3] or a[4] or "").lower()) for a in ATTRIBUTE.finditer(rest)] if rest else []
        names = " ".join(sorted(v for k, v in attributes if k in ("class", "id", "role"))) if attributes else ""
        path = xxhash.xxh64_intdigest(f"{name} {names}", path & (1 << 63) - 1)
        tags.append(path)
        if name in VOID or rest.endswith("/"):
            tags.append(~path & ALL)
            continue
        is_main = name in ("article", "main") or ("role", "main") in attributes
        mark = _chrome(name, attributes, main or is_main) or (MAIN if is_main else NONE)
        if mark != NONE:
            scopes.append([scope, mark, len(blocks), 0, False])
            scope = len(scopes) - 1
        if is_main and name != "article":
            outer = scopes[scope][0] if mark != NONE else scope
            while outer and not scopes[outer][4]:
                scopes[outer][4] = True
                outer = scopes[outer][0]
        stack.append((name, path, scope, main or is_main))
        open_names[name] = open_names.get(name, 0) + 1
    flush()
    leave(1)
    _resolve(blocks, scopes)
    return page


def _resolve(blocks: list[Block], scopes: list[list]) -> None:
    """Tell what is around each block. A weak mark is void if its element holds a main element, or most of the page's text."""
    if len(scopes) == 1:
        return
    ends = [0]
    for b in blocks:
        ends.append(ends[-1] + len(b.text))
    kinds = [PLAIN]
    for outer, mark, a, b, holds in scopes[1:]:
        kind = kinds[outer]
        if kind == OUT:
            pass
        elif mark == MAIN:
            kind = IN_MAIN
        elif not (mark in (WEAK, TALK) and holds or mark == WEAK and 2 * (ends[b] - ends[a]) > ends[-1]):
            kind = OUT
        kinds.append(kind)
    for block in blocks:
        block.kind = kinds[block.scope]


K1, K2, K3, K4 = (np.uint64(k) for k in (0x9E3779B97F4A7C15, 0x5851F42D4C957F2D, 0x14057B7EF767814F, 0xD1342543DE82EF95))


def _runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def _mixed(token: np.ndarray, group: np.ndarray) -> np.ndarray:
    """A key of token and group number."""
    key = (token ^ (group.astype(np.uint64) + np.uint64(1)) * K4) * K1
    return key ^ key >> np.uint64(32)


_POWERS = [pow(int(K2), i, 1 << 64) for i in range(64)]


def _hashed(words: pa.Array) -> np.ndarray:
    """64-bit hashes of the strings of an array: polynomials of their bytes, mixed."""
    offset = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, words.offset * 4).astype(np.int64) if len(words) else np.zeros(1, np.int64)
    size = np.diff(offset)
    raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offset[0] : offset[-1]].astype(np.uint64) + np.uint64(1)
    most = int(size.max(initial=1))
    power = np.array(_POWERS[:most], np.uint64) if most <= len(_POWERS) else np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(most - 1, K2)]))
    at = np.arange(len(raw)) - np.repeat(offset[:-1] - offset[0], size)
    total = np.zeros(len(size), np.uint64)
    full = size > 0
    if len(raw):
        total[full] = np.add.reduceat(raw * power[at], (offset[:-1] - offset[0])[full])
    total = (total ^ size.astype(np.uint64) * K4) * K1
    return total ^ total >> np.uint64(29)


def _word(text: str) -> int:
    """The same for one word."""
    raw = text.encode()
    if len(raw) > len(_POWERS):
        return int(_hashed(pa.array([text]))[0])
    total = sum((b + 1) * p for b, p in zip(raw, _POWERS, strict=False))
    total = ((total & ALL) ^ (len(raw) * int(K4) & ALL)) * int(K1) & ALL
    return total ^ total >> 29


def _ends(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether all of each group of consecutive values hold."""
    return np.logical_and.reduceat(x, np.cumsum(size) - size) if len(size) else np.zeros(0, bool)


class Tokens:
    """The tokens of some pages, one page after the other: tags, and the words of the blocks. No two words of a page are equal tokens."""

    def __init__(self, pages: list[Page]):
        blocks = [b for p in pages for b in p.blocks]
        n_tags, n_blocks = np.array([len(p.tags) for p in pages], np.int64), np.array([len(p.blocks) for p in pages], np.int64)
        self.tags = np.array([t for p in pages for t in p.tags], np.uint64)
        self.tag_page = np.repeat(np.arange(len(pages)), n_tags)
        self.block_page = np.repeat(np.arange(len(pages)), n_blocks)
        before = np.cumsum(n_tags) - n_tags  # tags before each page
        self.after = np.array([b.after for b in blocks], np.int64) + before[self.block_page]  # the tag before each block; before the page's first if there is none
        self.kind, self.chars = np.array([b.kind for b in blocks], np.int64), np.array([len(b.text) for b in blocks], np.int64)
        self.lone = np.array([b.after < 0 for b in blocks], bool)
        split = pc.split_pattern(pa.array([b.text for b in blocks], pa.string()), " ")
        self.size = np.diff(split.offsets.to_numpy()).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        known = _hashed(coded.dictionary)
        self.words = self._named(known[coded.indices.to_numpy()] if len(known) else known, np.array([b.path for b in blocks], np.uint64))
        self.word_page = np.repeat(self.block_page, self.size)
        # places in the order of all tags and words
        words = np.cumsum(self.size) - self.size
        upto = np.append(words, len(self.words))  # words before each block, and all
        self.tag_place = np.arange(len(self.tags)) + upto[np.searchsorted(self.after, np.arange(len(self.tags)), "left")]
        self.word_place = np.repeat(self.after + 1, self.size) + np.arange(len(self.words))
        self.whole = n_tags + np.bincount(self.word_page, minlength=len(pages))  # tokens of each page
        self.first = np.cumsum(self.whole) - self.whole

    def _named(self, word: np.ndarray, path: np.ndarray) -> np.ndarray:
        if not len(word):
            return word
        last = np.cumsum(self.size) - 1
        before = np.concatenate([np.zeros(1, np.uint64), word[:-1]])
        before[last - self.size + 1] = 0
        token = (word ^ np.repeat(path, self.size) ^ before * K2) * K1
        token[last] ^= K3  # the word ends its block
        # the second, third, ... of equal ones of a page are tokens of their own
        key = _mixed(token, np.repeat(self.block_page, self.size))
        by = np.argsort(key)
        new = _runs(key[by])
        size = np.diff(np.append(new, len(token)))
        again = np.flatnonzero(np.repeat(size > 1, size))
        some = by[again]
        some = some[np.lexsort((some, np.repeat(np.arange(len(new)), size)[again]))]  # each run in the page's order
        nth = np.zeros(len(token), np.uint64)
        nth[some] = again - np.repeat(new, size)[again]
        return token ^ nth * K4


def edge_tokens(block: Block) -> tuple[int, int]:
    """The tokens of a block's first and last word, as they are where they first occur on a page."""
    first, _, rest = block.text.partition(" ")
    if not rest:
        one = ((_word(first) ^ block.path) * int(K1) & ALL) ^ int(K3)
        return one, one
    rest = rest.rsplit(" ", 2)
    before = rest[-2] if len(rest) > 1 else first
    return (_word(first) ^ block.path) * int(K1) & ALL, ((_word(rest[-1]) ^ block.path ^ _word(before) * int(K2) & ALL) * int(K1) & ALL) ^ int(K3)


def content_key(page: Page) -> int:
    """The same for pages of the same texts in the same order, also under different urls: odd, a page's weight in occurrence vectors."""
    return xxhash.xxh64_intdigest("\n".join(b.text for b in page.blocks), 3) | 1


def host_column(url: str):
    """Host of a url in lower case, "" if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def section_column(url: str):
    """Host and first folder of a url, null if it has no folder; no host has a slash."""
    folder = F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^/?#]+/)", 1)
    return F.when(folder != "", F.concat(host_column(url), folder))


# ---- first scan: candidates ---------------------------------------------------------------------------------------


def _masks(key: int) -> tuple[int, int]:
    """Two bits that a page sets, in two masks."""
    return 1 << (key >> 8 & 63), 1 << (key >> 16 & 63)


def _signed(x) -> pa.Array:
    return pa.array(np.asarray(x, np.uint64).view(np.int64))


def candidates(pages: DataFrame) -> DataFrame:
    """(level, tokens array<long>): tags that may be on half, and words that may be on TEXT_SHARE, of the pages of each host or section with MIN_PAGES different pages.

    gain is a token's pages less those that a slice which does not send it may have; room and word_room are the sums of the latter.
    """

    def count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        host, section, html = (c.to_pylist() for c in batch.columns)
        pages = [parse(h) for h in html]
        t = Tokens(pages)
        key = _mixed(t.tags, t.tag_page)
        _, once = np.unique(key, return_index=True)
        token, page = np.concatenate([t.tags[once], t.words]), np.concatenate([t.tag_page[once], t.word_page])
        bits = [_masks(content_key(p)) for p in pages]
        for level in (host, section):
            names: dict[str, int] = {}
            code = np.array([names.setdefault(x, len(names)) if x is not None else -1 for x in level], np.int64)
            n = len(names)
            if not n:
                continue
            own = np.bincount(code[code >= 0], minlength=n)
            masks = [[0] * n, [0] * n]
            for c, two in zip(code.tolist(), bits, strict=True):
                if c >= 0:
                    masks[0][c] |= two[0]
                    masks[1][c] |= two[1]
            mine = np.flatnonzero(code[page] >= 0)
            mixed = _mixed(token[mine], code[page[mine]])
            by = np.argsort(mixed)
            new = _runs(mixed[by])
            on, some = np.diff(np.append(new, len(mine))), mine[by[new]]
            at = code[page[some]]
            is_word = some >= len(once)
            least = np.stack([(own + 1) // 2, np.ceil(TEXT_SHARE * own).astype(np.int64)])  # pages that make a share, of tags and of words
            need = least[is_word.astype(int), at]
            sent = on >= need
            some, at, is_word, gain = token[some[sent]], at[sent], is_word[sent], on[sent] - need[sent] + 1
            none = pa.nulls(len(some), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(names)).take(pa.array(np.concatenate([np.arange(n), at]))), pa.concat_arrays([pa.nulls(n, pa.int64()), _signed(some)]), pa.concat_arrays([pa.nulls(n, pa.bool_()), pa.array(is_word)]),
                    pa.array(np.concatenate([least[0] - 1, gain])), *(pa.concat_arrays([x, none]) for x in (pa.array(least[1] - 1), pa.array(own), _signed(masks[0]), _signed(masks[1]))),
                ], ["level", "token", "word", "gain", "word_room", "pages", "one", "two"],
            )

    found = map_batches(pages.select("host", "section", "html"), count, "level string, token long, word boolean, gain long, word_room long, pages long, one long, two long")
    sums = [F.sum(c).alias(c) for c in ("gain", "word_room", "pages")]
    summed = stored(found.groupBy("level", "token").agg(F.max("word").alias("word"), F.bit_or("one").alias("one"), F.bit_or("two").alias("two"), *sums), "local-shares")
    levels = summed.filter(F.col("token").isNull() & (_different() >= MIN_PAGES)).select("level", "pages", F.col("gain").alias("room"), "word_room")
    enough = F.when(F.col("word"), F.col("gain") + F.col("word_room") >= TEXT_SHARE * F.col("pages")).otherwise(2 * (F.col("gain") + F.col("room")) >= F.col("pages"))
    kept = summed.filter(F.col("token").isNotNull()).select("level", "token", "word", "gain").join(levels, "level").filter(enough)
    out = stored(kept.groupBy("level").agg(F.sort_array(F.collect_list("token")).alias("tokens")), "candidates")
    drop_stored(summed)
    return out


def _different():
    """How many different pages there are at least, by two masks."""
    return F.greatest(F.bit_count("one"), F.bit_count("two"))


def joined(rows: DataFrame, levels: DataFrame, size: int, column: str) -> DataFrame:
    """rows with the column of their host (``host_<column>``) and of their section; levels are broadcast if their checked size is small."""
    for level in ("host", "section"):
        named = levels.select(F.col("level").alias(level), F.col(column).alias(f"{level}_{column}"))
        if size <= BROADCAST_TOKENS:
            rows = rows.join(F.broadcast(named), level, "left")
        else:
            salted = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            rows = rows.withColumn("salt", F.pmod(F.xxhash64("id", "url", "html"), F.lit(SALTS)).cast("int")).join(salted, [level, "salt"], "left").drop("salt")
    return rows


# ---- second scan: vectors and slots -------------------------------------------------------------------------------


def _lists(column: pa.Array) -> list[np.ndarray | None]:
    """Views of a list column's rows."""
    flat, offset = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:b] if ok else None for a, b, ok in zip(offset[:-1], offset[1:], column.is_valid().to_pylist(), strict=True)]


def _added(t: Tokens, code: np.ndarray, names: list[str], lists: list[np.ndarray], weight: np.ndarray, one: np.ndarray, two: np.ndarray) -> pa.RecordBatch:
    """STATISTICS over some pages: code is the number of each page's host or section (-1: none), lists has the candidates of each."""
    token, owner = np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    mixed = _mixed(token, owner)
    by = np.argsort(mixed)
    token, owner, mixed = token[by], owner[by], mixed[by]
    n = len(token)

    def hits(tokens: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(candidate, token) numbers of those that are candidates."""
        key = _mixed(tokens, code[page])
        at = np.minimum(np.searchsorted(mixed, key), n - 1)
        known = np.flatnonzero((mixed[at] == key) & (code[page] >= 0))
        return at[known], known

    (tag_at, tag), (word_at, word) = hits(t.tags, t.tag_page), hits(t.words, t.word_page)
    at = np.concatenate([tag_at, word_at])
    page, place = np.concatenate([t.tag_page[tag], t.word_page[word]]), np.concatenate([t.tag_place[tag], t.word_place[word]])
    vector, masks = np.zeros(n, np.uint64), [np.zeros(n, np.uint64), np.zeros(n, np.uint64)]
    np.add.at(vector, at, weight[page])
    _, first = np.unique(at * len(code) + page, return_index=True)  # each page once; a token's first place on it
    for mask, bits in zip(masks, (one, two), strict=True):
        np.bitwise_or.at(mask, at[first], bits[page[first]])
    share = (place - t.first[page])[first] / np.maximum(1, t.whole[page[first]])
    is_word = np.zeros(n, bool)
    is_word[word_at] = True
    # text by the nearest candidate tag before it, and all text but blocks of candidates, by kind
    chars, text = np.zeros((n, 3), np.int64), np.zeros((len(names), 3), np.int64)
    fixed = np.zeros(len(t.words), bool)
    fixed[word] = True
    near = np.searchsorted(tag, t.after, "right") - 1
    there = np.flatnonzero((near >= 0) & ~t.lone)
    there = there[t.tag_page[tag[near[there]]] == t.block_page[there]] if len(tag) else there[:0]
    np.add.at(chars, (tag_at[near[there]], t.kind[there]), t.chars[there])
    free = np.flatnonzero(~_ends(fixed, t.size) & (code[t.block_page] >= 0))
    np.add.at(text, (code[t.block_page[free]], t.kind[free]), t.chars[free])
    whole = np.bincount(code[code >= 0], minlength=len(names))
    k = len(names)
    ahead = lambda x, y: pa.concat_arrays([pa.array(x, y.type), y])
    none = [0] * k
    return pa.RecordBatch.from_arrays(
        [
            pa.array(names).take(pa.array(np.concatenate([np.arange(k), owner]))), ahead([None] * k, _signed(token)), ahead([None] * k, pa.array(is_word)), ahead([None] * k, _signed(vector)),
            ahead(whole, pa.array(np.bincount(at[first], minlength=n))), ahead(none, pa.array(np.bincount(at, minlength=n))), ahead([0.0] * k, pa.array(np.bincount(at[first], share, n))),
            *(ahead(none, _signed(m)) for m in masks), *(ahead(text[:, i], pa.array(chars[:, i])) for i in range(3)),
        ], [c.split()[0] for c in STATISTICS.split(", ")],
    )


STATISTICS = "level string, token long, word boolean, vector long, pages long, total long, place double, one long, two long, main long, plain long, other long"


def statistics(rows: DataFrame) -> DataFrame:
    """STATISTICS of (host, section, html, host_tokens, section_tokens): the candidates' occurrence vectors and slots; the row without a token is the level's own."""

    def count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        asked = [_lists(batch.column(3)), _lists(batch.column(4))]
        rows = [i for i, (a, b) in enumerate(zip(*asked, strict=True)) if a is not None or b is not None]
        if not rows:
            return
        html = batch.column(2).to_pylist()
        pages = [parse(html[i]) for i in rows]
        t = Tokens(pages)
        weight = np.array([content_key(p) for p in pages], np.uint64)
        one, two = (np.array(m, np.uint64) for m in zip(*(_masks(int(w)) for w in weight), strict=True))
        for column, lists in enumerate(asked):
            name = batch.column(column).to_pylist()
            names: dict[str, tuple[int, np.ndarray]] = {}
            code = np.array([names.setdefault(name[i], (len(names), lists[i].view(np.uint64)))[0] if lists[i] is not None else -1 for i in rows], np.int64)
            if names:
                yield _added(t, code, list(names), [x for _, x in names.values()], weight, one, two)

    found = map_batches(rows.select("host", "section", "html", "host_tokens", "section_tokens"), count, STATISTICS)
    # vectors are sums modulo 2**64: halves are added apart, so that nothing overflows
    low, high = F.col("vector").bitwiseAND((1 << 32) - 1), F.shiftrightunsigned("vector", 32)
    sums = [F.sum(c).alias(c) for c in ("pages", "total", "place", "main", "plain", "other")]
    added = found.groupBy("level", "token").agg(F.max("word").alias("word"), F.sum(low).alias("low"), F.sum(high).alias("high"), F.bit_or("one").alias("one"), F.bit_or("two").alias("two"), *sums)
    return stored(added.selectExpr("*", "low & 4294967295L as low32", "(high + shiftright(low, 32)) & 4294967295L as high32").drop("low", "high"), "vectors")


TEMPLATE = "struct<has_main boolean, classes array<struct<whole boolean, tokens array<struct<place double, token long, word boolean, once boolean, content boolean>>>>>"


def templates(stats: DataFrame) -> DataFrame:
    """(level, template, n): the classes of each host and section, and of each tag's slot whether it is content; n counts the tokens.

    has_main says that most of the text that is no fixed text stands in article or main elements: then these are the content.
    """
    levels = stats.filter("token is null").select("level", F.col("pages").alias("level_pages"), F.expr("main > 0 and main >= plain").alias("has_main"))
    large = stats.filter("token is not null").filter(_different() >= F.when(F.col("word"), TEXT_PAGES).otherwise(MIN_PAGES)).join(levels, "level").filter(F.col("pages") >= F.when(F.col("word"), TEXT_SHARE).otherwise(0.5) * F.col("level_pages"))
    inside = F.when(F.col("has_main"), F.col("main")).otherwise(F.col("main") + F.col("plain"))
    written = F.col("main") + F.col("plain") + F.col("other")
    token = F.struct((F.col("place") / F.col("pages")).alias("place"), "token", "word", (F.col("total") == F.col("pages")).alias("once"), F.when(written > 0, 2 * inside > written).alias("content"))
    classes = large.groupBy("level", "has_main", "low32", "high32", "pages", "total").agg(F.first(F.col("pages") == F.col("level_pages")).alias("whole"), F.sort_array(F.collect_list(token)).alias("tokens")).filter("size(tokens) >= 2")
    # half of the pages have each token: a host has no more tokens here than two pages have on the average
    return classes.groupBy("level", "has_main").agg(F.collect_list(F.struct("whole", "tokens")).alias("classes"), F.sum(F.size("tokens")).alias("n")).select("level", F.struct("has_main", "classes").alias("template"), "n")


# ---- third scan: extraction ---------------------------------------------------------------------------------------


class Template:
    """A host's or section's template, made ready for its pages."""

    def __init__(self, row: dict):
        self.has_main = row["has_main"]
        rows = [(c, t) for c, one in enumerate(row["classes"]) for t in one["tokens"]]
        token = np.array([t["token"] for _, t in rows], np.int64).view(np.uint64)
        by = np.argsort(token)
        self.token = token[by]
        self.cls = np.array([c for c, _ in rows])[by]
        self.rank = np.arange(len(rows))[by]  # the template's order within a class
        self.once = np.array([t["once"] for _, t in rows], bool)[by]
        self.whole = np.array([c["whole"] for c in row["classes"]], bool)
        self.content = {int(t["token"]) & ALL: t["content"] for _, t in rows if not t["word"]}
        self.words = {int(t["token"]) & ALL for _, t in rows if t["word"]}

    def has_edges(self, block: Block) -> bool:
        """Whether the words at a block's ends are in the template: no other block can be fixed."""
        return all(x in self.words for x in edge_tokens(block))

    def fixed(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Of each word of a page, whether it is in a valid class, and whether that is on all pages."""
        out, whole = np.zeros(len(t.words), bool), np.zeros(len(t.words), bool)
        token, place = np.concatenate([t.tags, t.words]), np.concatenate([t.tag_place, t.word_place])
        at = np.minimum(np.searchsorted(self.token, token), len(self.token) - 1)
        known = np.flatnonzero(self.token[at] == token)
        cls = self.cls[at[known]]
        spans: list[tuple[int, int]] = []
        by = np.argsort(cls, kind="stable")
        edges = np.flatnonzero(np.diff(cls[by], prepend=-1, append=-1))
        groups = [known[by[a:b]] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        # classes with many tokens first: they are the frame that others must nest in
        for group in sorted(groups, key=lambda g: -len(g)):
            once = self.once[at[group]]
            if once.any():
                single = group[once][np.argsort(place[group[once]], kind="stable")]
                group = np.concatenate([single[_increasing(self.rank[at[single]])], group[~once]])
            if len(np.unique(at[group])) < 2:
                continue
            a, b = int(place[group].min()), int(place[group].max())
            if any(c < a <= d < b or a < c <= b < d for c, d in spans):
                continue  # it crosses another class
            spans.append((a, b))
            words = group[group >= len(t.tags)] - len(t.tags)
            out[words] = True
            whole[words] = self.whole[self.cls[at[group[0]]]]
        return out, whole


def _increasing(rank: np.ndarray) -> np.ndarray:
    """Places of a longest increasing run of ranks."""
    if (rank[1:] > rank[:-1]).all():
        return np.arange(len(rank))
    tops: list[int] = []
    ends: list[int] = []
    back = []
    for i, r in enumerate(rank.tolist()):
        k = bisect_left(tops, r)
        tops[k : k + 1] = [r]
        ends[k : k + 1] = [i]
        back.append(ends[k - 1] if k else -1)
    out, i = [], ends[-1]
    while i >= 0:
        out.append(i)
        i = back[i]
    return np.array(out[::-1])


def own_template(page: Page) -> bool:
    """What a page tells of itself where no host's template can: whether its article or main elements hold most of its text."""
    size = [0, 0, 0]
    for b in page.blocks:
        size[b.kind] += len(b.text)
    return size[IN_MAIN] > 0 and size[IN_MAIN] >= size[PLAIN]


def main_text(page: Page, found: list[Template] | None) -> str:
    """Blocks of the content slots in page order, one a line. found: the host's and the section's template; None: the page is a template of its own; []: there is none, and no slot is named."""
    if found is not None and not found:
        return "\n".join(b.text for b in page.blocks)
    has_main = found[-1].has_main if found else own_template(page)
    named = [b.kind == IN_MAIN if has_main else b.kind != OUT for b in page.blocks]
    if not found or not page.blocks:
        return "\n".join(b.text for b, ok in zip(page.blocks, named, strict=True) if ok)
    # the slot of a block: that of the nearest tag of the template before it; if an element that is not in the template opens between, its own name
    label: dict[int, bool | None] = {}
    for template in found:
        label |= template.content
    for i, b in enumerate(page.blocks):
        content = label.get(page.tags[b.after]) if b.after >= 0 else None
        if content is not None:
            named[i] = content
    asked = [x for x in found if x.words and any(ok and x.has_edges(b) for b, ok in zip(page.blocks, named, strict=True))]
    if not asked:
        return "\n".join(b.text for b, ok in zip(page.blocks, named, strict=True) if ok)
    t = Tokens([page])
    marks = [x.fixed(t) for x in asked]
    gone, sure = (_ends(np.logical_or.reduce([m[i] for m in marks]), t.size) for i in (0, 1))
    chars = t.chars * np.array(named)
    if 2 * chars[gone].sum() > chars.sum():
        gone &= sure  # most of a page's text is no template of some pages, but what near copies of one page share
    return "\n".join(b.text for b, ok, cut in zip(page.blocks, named, gone.tolist(), strict=True) if ok and not cut)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page."""
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_column(url_col).alias("host"), section_column(url_col).alias("section"))
    asked = candidates(rows)
    size = asked.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("n")).first()["n"]
    vectors = statistics(joined(rows, asked, size, "tokens"))
    shapes = stored(templates(vectors), "templates")
    drop_stored(asked)
    drop_stored(vectors)
    size = shapes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        host, section = batch.column(3).to_pylist(), batch.column(4).to_pylist()
        ready: dict[str, Template | None] = {}
        for level, names in ((5, host), (6, section)):
            column = batch.column(level)
            for i, name in enumerate(names):
                if name is not None and name not in ready:
                    row = column[i].as_py()
                    ready[name] = Template(row) if row is not None else None
        text = []
        for html, h, s in zip(batch.column(2).to_pylist(), host, section, strict=True):
            page = parse(html)
            found = [x for x in (ready.get(h), ready.get(s) if s is not None else None) if x is not None]
            text.append(main_text(page, found or None))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["id", "url", "text", "n_chars"])

    out = joined(rows, shapes, size, "template").select("id", "url", "html", "host", "section", "host_template", "section_template")
    return map_batches(out, run, f"id {kind}, url string, text string, n_chars long").withColumnRenamed("id", id_col)
