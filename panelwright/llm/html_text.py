"""Main text of web pages: structure first, then a suffix array over each host's pages.

A page is cut into text blocks, and structure tells what is no part of an article: scripts, menus,
adverts, comments and the like. Then a host's pages are concatenated as streams of words, and a
suffix array over them finds long runs of words repeated on many distinct pages. Such runs are
template text and are removed; unique runs stay.

Articles that pages mark as such are streams of their own. Quotations, headlines and passages that some
articles share are content, so there only a whole block goes, and only if one unbroken run that half of
the host's distinct articles repeat covers it; headings stay. On pages that mark no article a few pages
suffice, and runs go wherever they stand. Pages that are equal count once, and so do articles that are
nearly equal, so copies of a page do not make it a template. A host's streams are cut into parts of a
bounded number of pages and bytes, so a host with a third of all pages is no single task.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm import tokens
from panelwright.scratch import pin

#: Words of a repeated run, at least.
RUN_WORDS = 6
#: Distinct pages of a host on which template text stands: at least this many, and this share, in
#: unmarked text.
PAGES, SHARE = 3, 0.02
#: The same for marked articles; the share is that of a part of the host's articles.
ARTICLES, ARTICLE_SHARE = 5, 0.5
#: Pages of a host whose streams are sorted together, about, and bytes of their text.
PART_PAGES, PART_BYTES = 500, 16_000_000
#: A page keeps its text if templates cover more of it than this; articles are nearly equal if common
#: runs cover more of both.
COVERED = 0.8
#: Template runs (8 bytes each) up to this number are sent to every task; more are joined by host.
SENT_RUNS = 2_000_000

# Elements and labels that HTML and its authors give to what is no article text.
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "canvas", "object", "math", "xmp", "title"}
DROPPED = {
    "nav", "footer", "aside", "form", "button", "select", "textarea", "dialog", "menu", "head", "label", "fieldset",
    "video", "audio", "map", "datalist",
}
DROPPED_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu"}
DROPPED_LABELS = set(
    "ad ads adsbygoogle adv advert adverts advertisement advertising alert alerts disclaimer sponsor sponsored sponsors promo promotion banner cookie "
    "cookies consent gdpr notice notices sidebar widget widgets menu menus nav navbar navigation breadcrumb "
    "breadcrumbs footer comment comments commentlist disqus respond replies share sharing social related "
    "recommended recommendations newsletter subscribe subscription signup login popup modal overlay pagination "
    "pager toolbar hidden".split()
)
#: Of these, the ones that also take an element out of running text.
ADVERT_LABELS = {"ad", "ads", "adsbygoogle", "adv", "advert", "adverts", "advertisement", "advertising", "sponsored", "hidden"}
OUTER_LABELS = {"header", "masthead", "topbar"}
ARTICLE_LABELS = {"article", "articlebody", "entry", "post", "story", "content", "main"}
VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins",
    "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time",
    "tt", "u", "var",
}
SPACING = {"br", "wbr", "img"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements whose end tags are optional.
OPTIONAL = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|</[^>]*>",
    re.S,
)
_LABEL = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_CLOSERS = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}
_PARTS = re.compile(r"[^a-z0-9]+")

OUTSIDE, LOOSE, CLASSED, MAIN, ARTICLE = range(5)


def _judge(name: str, attributes: str, inside: bool, running: bool = False) -> tuple[bool, int]:
    """Whether an element is dropped, and the kind of article container that it is.

    ``running`` tells that the element stands in running text, where fewer labels count.
    """
    drop, kind = name in DROPPED or (name == "header" and not inside), LOOSE
    if name == "article":
        kind = ARTICLE
    elif name == "main":
        kind = MAIN
    for label, value in _LABEL.findall(attributes) if attributes.strip() else ():
        label, value = label.lower(), value.strip("\"'").lower()
        words = set(_PARTS.split(value))
        if label == "hidden" or (label == "aria-hidden" and value == "true"):
            drop = True
        elif label == "style":
            drop |= "display:none" in value.replace(" ", "")
        elif label == "role":
            drop |= bool(words & DROPPED_ROLES) and name not in ("html", "body")
            kind = max(kind, MAIN if "main" in words else LOOSE)
        elif name not in ("html", "body", "main"):
            if label in ("class", "id"):
                drop |= bool(words & (ADVERT_LABELS if running else DROPPED_LABELS)) or (not inside and bool(words & OUTER_LABELS))
            if words & ARTICLE_LABELS and name not in INLINE:
                kind = max(kind, CLASSED)
    return drop, kind


def page_blocks(page: str) -> list[tuple[int, str, bool]]:
    """(kind, text, is a heading) of every text block in page order.

    Kinds tell the innermost article container. Text inside of dropped inline elements is in no block.
    """
    blocks: list[tuple[int, str, bool]] = []
    words: list[str] = []
    # open elements with the state outside of them, and how many of each name there are
    stack: list[tuple[str, bool, int, bool]] = []
    opened: dict[str, int] = {}
    kind, drop, mute, muted_at, heading = LOOSE, False, False, 0, False

    def flush() -> None:
        if words:
            text = " ".join("".join(words).split())
            if text:
                blocks.append((OUTSIDE if drop else kind, text, heading))
            words.clear()

    def push(name: str) -> None:
        stack.append((name, drop, kind, mute))
        opened[name] = opened.get(name, 0) + 1

    def close(depth: int) -> tuple[bool, int, bool]:
        for name, *_ in stack[depth:]:
            opened[name] -= 1
        _, *outside = stack[depth]
        del stack[depth:]
        return tuple(outside)

    at = 0
    while True:
        found = _TOKEN.search(page, at)
        text = page[at : found.start()] if found else page[at:]
        if text and not mute:
            words.append(html.unescape(text) if "&" in text else text)
        if not found:
            break
        at = found.end()
        name = found[2]
        if name is None:
            continue
        name = name.lower()
        if found[1]:
            if name not in INLINE:
                flush()
                heading &= name not in HEADINGS
                if mute and all(inner != name for inner, *_ in stack[muted_at + 1 :]):
                    drop, kind, mute = close(muted_at)  # a block that ends takes what is open inside along
            if opened.get(name):
                depth = len(stack) - 1
                while stack[depth][0] != name:
                    depth -= 1
                drop, kind, mute = close(depth)
            continue
        if name in RAW:
            closer = None if found[3].endswith("/") else _CLOSERS[name].search(page, at)
            if closer:
                at = closer.end()
            elif name in ("script", "style") and not found[3].endswith("/"):
                at = len(page)
            words.append(" ")
            continue
        if name in VOID:
            if name in SPACING:
                words.append(" ")
            else:
                flush()
            continue
        if name in INLINE:
            if mute:
                push(name)
            elif found[3] and not drop and _judge(name, found[3], kind > LOOSE, not "".join(words).isspace() and bool(words))[0]:
                muted_at = len(stack)
                push(name)
                mute = True
                words.append(" ")
            continue
        flush()
        if stack and (stack[-1][0] == "p" or name in OPTIONAL):
            # a paragraph ends where a block begins, others where one of their name does
            depth = len(stack)
            while depth and stack[depth - 1][0] in OPTIONAL:
                depth -= 1
            for at_depth in range(depth, len(stack)):
                if stack[at_depth][0] in ("p", name):
                    drop, kind, mute = close(at_depth)
                    break
        heading = name in HEADINGS or (heading and name not in OPTIONAL)
        if name in OPTIONAL and not found[3].strip() and not mute:
            continue  # plain ones change nothing
        dropped, own = _judge(name, found[3], kind > LOOSE)
        push(name)
        drop, kind = drop or dropped, max(kind, own)
    flush()
    return blocks


def split_page(page: str | None) -> tuple[str, str, bool, list[int]]:
    """Text of the article's blocks, text outside, whether the page marks its article, and its headings' lines."""
    blocks = page_blocks(page) if page else []
    sizes = [sum(len(t) for k, t, _ in blocks if k == kind) for kind in range(5)]
    best = LOOSE
    for kind in (ARTICLE, MAIN, CLASSED):
        if sum(sizes[kind:]) * 4 >= sum(sizes[LOOSE:]) and sum(sizes[kind:]):
            best = kind
            break
    own = [(t, h) for k, t, h in blocks if k >= best]
    other = "\n".join(t for k, t, _ in blocks if k < best)
    return "\n".join(t for t, _ in own), other, best > LOOSE, [n for n, (_, h) in enumerate(own) if h]


_PARSED = (
    "row long, page_id long, url string, host string, own string, other string, marked boolean, heads array<int>"
)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tokens.chunks(batch, "html", 8 * tokens.CHUNK_BYTES):
            own, other, marked, heads = zip(*map(split_page, part.column("html").to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), part.column("page_id"), part.column("url"), part.column("host"),
                 pa.array(own), pa.array(other), pa.array(marked), pa.array(heads, pa.list_(pa.int32()))],
                ["row", "page_id", "url", "host", "own", "other", "marked", "heads"],
            )


def repeated_runs(stream: np.ndarray, page: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of a token stream by rank of their first ``width`` tokens: (start, rank), sorted.

    Ranks are doubled: the rank of 2k tokens is that of a pair of ranks of k. Suffixes whose first
    tokens reach into another page are left out. Neighbours of equal rank share a run.
    """
    _, rank = np.unique(stream, return_inverse=True)
    have, done = rank.astype(np.int64), 1
    while done < width:
        step = min(done, width - done)
        n = len(have) - step
        key = have[:n] * (int(have.max(initial=0)) + 1) + have[step : step + n]
        have = np.unique(key, return_inverse=True)[1].astype(np.int64)
        done += step
    start = np.arange(len(have))
    start = start[page[start] == page[start + width - 1]] if len(start) else start
    order = np.argsort(have[start], kind="stable")
    return start[order], have[start[order]]


def _pages_of(key: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers for equal keys, and the distinct pages of each number."""
    _, number = np.unique(key, return_inverse=True)
    width = int(page.max(initial=0)) + 1
    return number, np.bincount(np.unique(number * width + page) // width, minlength=int(number.max(initial=-1)) + 1)


def repeated_spans(
    stream: np.ndarray, page: np.ndarray, unit: np.ndarray, first: np.ndarray, size: np.ndarray, least: int, width: int
) -> np.ndarray:
    """Whether each span of a token stream stands on at least ``least`` distinct units of pages.

    Spans are given by their first tokens and sizes; they lie inside a page, and those of less than
    ``width`` tokens do not count. Prefix doubling goes on from ``width`` tokens while any run is on enough
    pages, which orders the suffixes that matter as far as enough of them agree. A span of any size is the
    pair of its first and its last tokens under the largest doubled length within it.
    """
    n = len(stream)
    found = np.zeros(len(first), bool)
    start, rank = repeated_runs(stream, page, width) if n >= width else (np.empty(0, np.int64), np.empty(0, np.int64))
    of = unit[page]
    last = np.searchsorted(page, page, "right")  # where each position's page ends

    def often(at: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        number, pages = _pages_of(key, of[at])
        good = pages[number] >= least
        ranks = np.full(n, -1, np.int64)
        ranks[at[good]] = number[good]
        return at[good], ranks

    def pairs(level: np.ndarray, at: np.ndarray, shift: int, length: int) -> tuple[np.ndarray, np.ndarray]:
        at = at[at + length <= last[at]]
        at = at[level[at + shift] >= 0]
        return often(at, level[at] * n + level[at + shift])

    levels = [often(start, rank)]
    while len(levels[-1][0]):
        at, level = levels[-1]
        reach = width << (len(levels) - 1)
        levels.append(pairs(level, at, reach, 2 * reach))
    for length in np.unique(size[size >= width]).tolist():
        k = (length // width).bit_length() - 1
        if k < len(levels):
            at, level = levels[k]
            own = size == length
            found[own] = np.isin(first[own], pairs(level, at, length - (width << k), length)[0])
    return found


def _host_key(host: str, kind: int) -> np.uint64:
    raw = np.frombuffer(f"{kind}{host}".encode(), np.uint8)
    return tokens.span_hash(raw, np.array([0]), np.array([len(raw)]))[0]


OPEN, MARKED = 0, 1
_PACKED = "host string, kind int, part long, keys binary, ends binary, texts binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams of a batch that go to the same part, compressed together."""
    names = [c.split()[0] for c in _PACKED.split(", ")]
    for batch in batches:
        host, kind, part, keys = (batch.column(c).to_pylist() for c in ("host", "kind", "part", "key"))
        raw, off = tokens.utf8(batch.column("stream"))
        groups: dict[tuple, list[int]] = {}
        for k, name in enumerate(zip(host, kind, part, strict=True)):
            groups.setdefault(name, []).append(k)
        rows = []
        for name, own in groups.items():
            texts = b"".join(raw[off[k] : off[k + 1]].tobytes() for k in own)
            ends = np.cumsum([off[k + 1] - off[k] for k in own]).astype(np.int64)
            rows.append((*name, np.array([keys[k] for k in own], np.int64).tobytes(), ends.tobytes(),
                         pa.compress(texts, "zstd", asbytes=True)))
        if rows:
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names)


def _covered(start: np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie in runs that begin at ``start``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + RUN_WORDS, -1)
    return np.cumsum(edge[:-1]) > 0


def near_equal(page: np.ndarray, start: np.ndarray, run: np.ndarray, pages: np.ndarray) -> np.ndarray:
    """For each page the first page that it nearly equals; ``pages`` tells on how many a run stands."""
    unit = np.arange(int(page[-1]) + 1)
    words = np.bincount(page)

    def common(start: np.ndarray) -> np.ndarray:
        return np.bincount(page, _covered(start, len(page)), len(unit))

    rest = common(start[pages[run] > 1]) > COVERED * words
    own = page[start]
    mark = np.zeros(len(pages), bool)
    for leader in np.flatnonzero(rest).tolist():
        if not rest[leader]:
            continue
        keep = rest[own]
        start, run, own = start[keep], run[keep], own[keep]
        its = run[own == leader]
        mark[its] = True
        alike = rest & (common(start[mark[run]]) > COVERED * np.maximum(words, words[leader]))
        mark[its] = False
        alike[leader] = True
        unit[alike] = leader
        rest &= ~alike
    return unit


class _lines:
    """Lines of texts: their hashes, their first words and how many words they have."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, words: tokens.Words):
        feeds = np.flatnonzero(raw == 10)
        texts = off[:-1][np.diff(off) > 0]
        start = np.sort(np.concatenate([texts, feeds + 1]))
        end = np.sort(np.concatenate([off[1:][np.diff(off) > 0], feeds]))
        self.doc = np.searchsorted(off, start, "right") - 1
        self.hash = tokens.span_hash(raw, start, end)
        self.first = np.searchsorted(words.start, start)
        self.words = np.searchsorted(words.start, end) - self.first


def _count_runs(table: pa.Table) -> pa.Table:
    """(host, kind, run, pages) of one part: runs of words and the distinct pages they stand on."""
    host, kind = table.column("host")[0].as_py(), table.column("kind")[0].as_py()
    texts: dict[int, bytes] = {}
    for keys, ends, packed in zip(*(table.column(c).to_pylist() for c in ("keys", "ends", "texts")), strict=True):
        ends = np.frombuffer(ends, np.int64).tolist()
        data = pa.decompress(packed, ends[-1], "zstd", asbytes=True)
        for key, a, b in zip(np.frombuffer(keys, np.int64).tolist(), [0, *ends], ends, strict=False):
            texts.setdefault(key, data[a:b])
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts.values()])])
    raw = tokens.LOWER[np.frombuffer(b"".join(texts.values()), np.uint8)]
    words = tokens.split(raw, off)
    stream, page = tokens.word_hash(words), words.doc
    runs, pages = np.empty(0, np.uint64), np.empty(0, np.int64)
    start, rank = repeated_runs(stream, page, RUN_WORDS) if len(stream) >= RUN_WORDS else (runs, pages)
    if len(start):
        # suffixes of one rank lie together, and within it in the order of their pages
        head = np.concatenate([[True], rank[1:] != rank[:-1]])
        fresh = head | np.concatenate([[True], page[start[1:]] != page[start[:-1]]])
        run = np.cumsum(head) - 1
        pages = np.bincount(run, fresh).astype(np.int64)
        if kind == MARKED:
            unit = near_equal(page, start, run, pages)
            least = max(ARTICLES, int(np.ceil(ARTICLE_SHARE * len(np.unique(unit)))))
            lines = _lines(raw, off, words)
            whole = repeated_spans(stream, page, unit, lines.first, lines.words, least, RUN_WORDS)
            runs = np.unique(tokens.mix(lines.hash[whole] ^ _host_key(host, MARKED), 21))
            pages = np.full(len(runs), least)
        else:
            windows, _ = tokens.window_hash(stream, np.array([0, len(stream)]), RUN_WORDS)
            runs = tokens.mix(windows[start[head]] ^ _host_key(host, kind), 21)
    return pa.table(
        {
            "host": pa.array([host] * len(runs), pa.string()),
            "kind": pa.array(np.full(len(runs), kind, np.int32)),
            "run": pa.array(tokens.signed(runs)),
            "pages": pa.array(pages),
        }
    )


class Templates(NamedTuple):
    """Sorted template runs: windows of words on unmarked pages, and whole blocks of marked articles."""

    open: np.ndarray
    marked: np.ndarray

    @classmethod
    def of(cls, table: pa.Table) -> Templates:
        runs, kind = table.column("run").to_numpy().view(np.uint64), table.column("kind").to_numpy()
        return cls(np.sort(runs[kind == OPEN]), np.sort(runs[kind == MARKED]))


def _known(runs: np.ndarray, known: np.ndarray) -> np.ndarray:
    slot = np.minimum(np.searchsorted(known, runs), len(known) - 1)
    return known[slot] == runs


def _cleaned(own: pa.Array, hosts: list[str | None], marked: np.ndarray, heads: list[list[int]], known: Templates) -> list[str]:
    """Texts without what lies in template runs of their host.

    A page that templates cover for the most part stays: it is no template but one of many copies.
    """
    texts = own.to_pylist()
    usable = np.array([x is not None for x in hosts], bool)
    for kind, runs in ((MARKED, known.marked), (OPEN, known.open)):
        some = np.flatnonzero(usable & (marked == (kind == MARKED)))
        if not len(some) or not len(runs):
            continue
        raw, off = tokens.utf8(own.take(pa.array(some)))
        words = tokens.split(tokens.LOWER[raw], off)
        keys = {x: _host_key(x, kind) for x in {hosts[k] for k in some}}
        key = np.array([keys[hosts[k]] for k in some], np.uint64)
        lines = _lines(words.raw, off, words)
        if kind == MARKED:
            gone = _known(tokens.mix(lines.hash ^ key[lines.doc], 21), runs)
            for d in np.unique(lines.doc[gone]).tolist():
                here = np.flatnonzero(lines.doc == d)
                out = gone[here]
                out[[n for n in heads[some[d]] if n < len(out)]] = False
                if lines.words[here][out].sum() <= COVERED * lines.words[here].sum():
                    kept = [x for x, leave in zip(texts[some[d]].split("\n"), out.tolist(), strict=True) if not leave]
                    texts[some[d]] = "\n".join(kept)
            continue
        hashes = tokens.word_hash(words)
        windows, ptr = tokens.window_hash(hashes, words.ptr, RUN_WORDS)
        place = np.repeat(np.arange(len(some)), np.diff(ptr))
        start = np.arange(len(windows)) - ptr[place] + words.ptr[place]
        covered = _covered(start[_known(tokens.mix(windows ^ key[place], 21), runs)], len(hashes))
        for d in np.unique(words.doc[covered]).tolist():
            if covered[words.ptr[d] : words.ptr[d + 1]].mean() > COVERED:
                continue
            kept = []
            for line in np.flatnonzero(lines.doc == d).tolist():
                its = range(lines.first[line], lines.first[line] + lines.words[line])
                # pieces as the word finder sees them; blanks in a block are single
                left = [raw[words.start[w] : words.end[w]].tobytes().decode() for w in its if not covered[w]]
                if left:
                    kept.append(" ".join(left))
            texts[some[d]] = "\n".join(kept)
    return texts


_OUT = "page_id long, url string, text string"


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), one row for every page.

    ``text`` holds the blocks of the article in page order, one on each line, with white space inside
    a block as one blank and character references decoded. Blocks lie in the page's article or main
    element, or else in one labelled as such, or else anywhere outside of dropped elements. Of a marked
    article whole blocks go that half of the host's distinct articles (five at least) repeat, but no
    headings; of other pages the runs of words that the host's pages repeat. A null or empty page has an empty text. Pages without a host in their url are cut by structure alone. Ids
    and urls pass through as they are, null or repeated; other columns are not read. An empty table
    gives an empty result.
    """
    host = F.nullif(F.lower(F.regexp_extract(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1)), F.lit(""))
    rows = pages.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        host.alias("host"),
        "html",
    )
    parsed = pin(rows.mapInArrow(_parse, _PARSED), "pages", compression="zstd")
    # where a page does not mark its article, its whole text may be template
    open_text = F.when(F.col("marked"), F.col("other")).otherwise(F.concat_ws("\n", "other", "own"))
    # equal text around different articles stands on as many pages
    page, article = F.xxhash64("own", "other"), F.xxhash64("own")
    both = F.array(
        F.struct(F.lit(OPEN).alias("kind"), page.alias("key"), open_text.alias("stream")),
        F.struct(F.lit(MARKED).alias("kind"), article.alias("key"), F.when(F.col("marked"), F.col("own")).alias("stream")),
    )
    # text outside of articles matters only where a host has pages that mark none
    kinds = F.when(F.col("marked"), MARKED).otherwise(OPEN).alias("kind")
    wanted = pin(parsed.where("host IS NOT NULL").select("host", kinds).distinct(), "hosts")
    streams = parsed.where("host IS NOT NULL").select("host", F.inline(both)).where("stream != ''")
    streams = streams.join(wanted, ["host", "kind"], "left_semi")
    distinct = streams.groupBy("host", "kind", "key").agg(F.max(F.octet_length("stream")).alias("bytes"))
    sizes = distinct.groupBy("host", "kind").agg(F.count("*").alias("host_pages"), F.sum("bytes").alias("bytes"))
    sizes = pin(sizes, "sizes")
    parts = F.ceil(F.greatest(F.col("host_pages") / PART_PAGES, F.col("bytes") / PART_BYTES)).cast("long")
    counted = (
        streams.join(sizes, ["host", "kind"])
        .select("host", "kind", F.pmod("key", parts).alias("part"), "key", "stream")
        .mapInArrow(_pack, _PACKED)
        .groupBy("host", "kind", "part")
        .applyInArrow(_count_runs, "host string, kind int, run long, pages long")
    )
    enough = F.when(F.col("kind") == MARKED, F.lit(1)).otherwise(
        F.greatest(F.lit(PAGES), F.ceil(F.col("host_pages") * SHARE))
    )
    templates = pin(
        counted.groupBy("host", "kind", "run")
        .agg(F.sum("pages").alias("pages"))
        .join(sizes, ["host", "kind"])
        .where(F.col("pages") >= enough)
        .select("host", "kind", "run"),
        "templates",
    )
    found = templates.count()
    result = (_sent if found <= SENT_RUNS else _joined)(parsed, templates)
    return result.withColumn("n_chars", F.char_length("text").cast("long"))


def _emit(table: pa.RecordBatch | pa.Table, known: Templates) -> pa.RecordBatch:
    own = table.column("own")
    own = own.combine_chunks() if isinstance(own, pa.ChunkedArray) else own
    marked = np.array(table.column("marked").to_pylist(), bool)
    texts = _cleaned(own, table.column("host").to_pylist(), marked, table.column("heads").to_pylist(), known)
    columns = [table.column(c) for c in ("page_id", "url")]
    columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
    return pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], ["page_id", "url", "text"])


def _sent(parsed: DataFrame, templates: DataFrame) -> DataFrame:
    """Every task gets all template runs, whose number was checked."""
    sent = parsed.sparkSession.sparkContext.broadcast(Templates.of(templates.select("run", "kind").toArrow()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.chunks(batch, "own", 4 * tokens.CHUNK_BYTES):
                yield _emit(part, sent.value)

    return parsed.mapInArrow(run, _OUT)


def _joined(parsed: DataFrame, templates: DataFrame) -> DataFrame:
    """Pages meet the template runs of their host, a bounded part of a host at a time."""
    sizes = parsed.groupBy("host").agg(F.count("*").alias("n"))
    parts = F.ceil(F.col("n") / PART_PAGES).cast("long")
    own = sizes.withColumnRenamed("host", "of")
    placed = parsed.join(own, F.col("host").eqNullSafe(F.col("of")))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("row"), parts)).drop("of", "n")
    spread = templates.join(sizes, "host").select(
        "host", "kind", "run", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part")
    )

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"page_id": pa.array([], pa.int64()), "url": pa.array([], pa.string()), "text": pa.array([], pa.string())})
        return pa.Table.from_batches([_emit(left, Templates.of(right))])

    return placed.groupBy("host", "part").cogroup(spread.groupBy("host", "part")).applyInArrow(run, _OUT)
