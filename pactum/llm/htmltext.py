"""The main text of web pages, with boilerplate found by a suffix array over the pages of a host.

The token streams of a host's pages, outside their articles, are concatenated and their suffixes sorted by
their first tokens; a substring that stands on two distinct pages or more is boilerplate.  Runs of tokens
that such substrings cover are removed and unique runs are kept.  Every partition sorts the suffixes of its
own pages; Spark merges equal runs of all partitions, so the whole host counts, however large it is and
however its pages are dealt.

Markup decides what repeats cannot tell.  Of a page with an article (else a main element) that is the text:
copies of an article repeat too, and adverts beside it need not.  Elements that are menu, header, footer,
sidebar, form or hidden by their name or role go, and so do reader comments, which are unique and yet no
article.  Within an article repeats decide on small blocks of containers with a class of their own, such as
notices and adverts: one that stands, whole, in two distinct articles of the host is boilerplate.  Its
paragraphs stay, whatever other pages repeat.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactum.llm.storage import written
from pactum.llm.urlfilter import host_and_path
from pactum.llm.words import Powers, mix, returning_memory, slices, utf8, word_hashes

_U = np.uint64
_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_STOP = re.compile(r"""[>"']""")
_ATTR = re.compile(r"""([a-zA-Z-]+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+""")
_END_TAG = re.compile(r"</([a-zA-Z][a-zA-Z0-9:-]*)")
#: Elements whose content is text up to their end tag.
_RAW = {n: re.compile(rf"</{n}(?=[\s/>])", re.I) for n in ("script", "style", "title", "textarea", "iframe", "xmp", "noembed", "noframes")}
#: Elements that show no text of the page; without an end tag they are ignored.
_SILENT = {"noscript", "template", "svg", "math", "object", "select", "option", "optgroup", "datalist", "button", "canvas", "audio", "video"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
_MENUS = {"nav", "footer", "aside", "form", "dialog", "menu"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
_CONTAINERS = {"div", "section", "article", "ol", "ul", "li", "details", "table"}
#: Whole names of classes and ids that hold reader comments.
_COMMENTS = re.compile(r"(comments?|comment[-_]?(list|section|area|thread|body|block)s?|disqus([-_]thread)?|replies|respond)", re.I)
_ARTICLE, _MAIN = 2, 1
#: Within an article, marked blocks of more than this share of its text are not held to be boilerplate; main is the text if its articles hold less.
SMALL_SHARE, LEAST_ARTICLE = 0.25, 0.5
#: Bytes of html that are worked on in one step.
BYTES_AT_ONCE = 500_000
#: What tells a short block from the start of a longer one.
_SHORT = _U(0x5851F42D4C957F2D)


@dataclass(slots=True)
class Block:
    """A run of visible text of a page: the element that holds it, whether markup drops it, and whether an article or main element holds it."""

    text: str
    mark: str
    dropped: bool
    part: int


class _Tags:
    """Where the tags of a page end; each byte is looked at a bounded number of times."""

    def __init__(self, page: str) -> None:
        self.page, self.last = page, {c: page.rfind(c) for c in "\"'>"}
        self.quotes = True
        self.end_of: dict[str, int] = {}
        for m in _END_TAG.finditer(page):
            self.end_of[m[1].lower()] = m.start()

    def end(self, at: int) -> int:
        """The position after the > of the tag whose name ends at ``at``, or -1.  Quoted values may hold a >."""
        if self.last[">"] < at:
            return -1
        start = at
        while self.quotes:
            stop = _STOP.search(self.page, at)
            if stop is None:
                # Quotes are not balanced: from here on they mean nothing.
                self.quotes = False
                break
            at = stop.end()
            if stop[0] == ">":
                return at
            if stop.start() < self.last[stop[0]] and self._after_equals(stop.start()):
                at = self.page.find(stop[0], at) + 1
        return self.page.find(">", start) + 1

    def _after_equals(self, at: int) -> bool:
        at -= 1
        while at >= 0 and self.page[at].isspace():
            at -= 1
        return at >= 0 and self.page[at] == "="


def _dropped(name: str, attrs: dict[str, str], part: int) -> bool:
    """Whether an element is menu, header, footer, sidebar, form, hidden or reader comments by its markup."""
    if name in ("html", "body", "main"):
        return False
    if name in _MENUS or (name == "header" and part != _ARTICLE):
        return True
    if not attrs:
        return False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return True
    if attrs.get("role", "").lower() in _ROLES:
        return True
    return name in _CONTAINERS and any(_COMMENTS.fullmatch(x) for x in f"{attrs.get('class', '')} {attrs.get('id', '')}".split())


def blocks_of(page: str) -> list[Block]:
    """The blocks of visible text in page order: references decoded, white space squeezed, empty ones left out."""
    out: list[Block] = []
    # Of each open element: name, mark, dropped, part; and where the open elements of a name and the open blocks are.
    stack: list[tuple[str, str, bool, int]] = [("", "", False, 0)]
    places: dict[str, list[int]] = {}
    blocks: list[int] = []
    held: list[str] = []
    tags, missing = _Tags(page), set()

    def close_block() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                _, mark, dropped, part = stack[-1]
                out.append(Block(text, mark, dropped, part))

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            name = stack.pop()[0]
            places[name].pop()
            if name not in _INLINE:
                blocks.pop()

    at = done = 0
    while True:
        at = page.find("<", at)
        if at < 0:
            break
        following = page[at + 1 : at + 2]
        if following in "!?" and following:
            comment = page.startswith("<!--", at)
            end = page.find("-->" if comment else ">", at + (4 if comment else 2))
            held.append(page[done:at])
            at = done = len(page) if end < 0 else end + (3 if comment else 1)
            continue
        closing = following == "/"
        found = _NAME.match(page, at + 1 + closing)
        if found is None:
            at += 1
            continue
        end = tags.end(found.end())
        if end < 0:
            # No tag ends after this place: what follows is text.
            break
        held.append(page[done:at])
        given = page[found.end() : end - 1]
        at = done = end
        name = found[0].lower()
        if name == "br":
            held.append(" ")
            continue
        block = name not in _INLINE
        if block:
            close_block()
        if closing:
            own = places.get(name)
            if own and (block or not blocks or blocks[-1] < own[-1]):
                pop_to(own[-1])
            continue
        if name in _RAW:
            stop = None if name in missing else _RAW[name].search(page, at)
            if stop is None:
                missing.add(name)
                if name in ("script", "style"):
                    at = done = len(page)
                continue
            at = page.find(">", stop.end()) + 1 or len(page)
            done = at
            continue
        if name in _VOID or given.endswith("/") or (name in _SILENT and tags.end_of.get(name, -1) < at):
            continue
        if block and blocks and stack[blocks[-1]][0] == "p":
            # A block inside an open paragraph ends it.
            pop_to(blocks[-1])
        _, mark, dropped, part = stack[-1]
        attrs = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(given)} if given.strip() else {}
        if block or attrs:
            dropped = dropped or name in _SILENT or _dropped(name, attrs, part)
        if block:
            mark = "\x01" + ".".join([name, *attrs.get("class", "").split()])
        if name == "article" or attrs.get("role") == "article":
            part = part if dropped else _ARTICLE
        elif part == 0 and (name == "main" or attrs.get("role") == "main" or attrs.get("itemprop") == "articleBody"):
            part = _MAIN
        places.setdefault(name, []).append(len(stack))
        if block:
            blocks.append(len(stack))
        stack.append((name, mark, dropped, part))
    held.append(page[done:])
    close_block()
    return out


class Page:
    """The blocks of a page and which of them an article (else a main element) protects.

    ``open`` blocks are held against other pages: those outside the protected part, and within it the
    ``marked`` ones, small blocks of containers with a class.  ``article`` is the protected text.
    """

    def __init__(self, source: str) -> None:
        self.blocks = blocks_of(source)
        sizes = [0, 0, 0]
        for b in self.blocks:
            if not b.dropped:
                sizes[b.part] += len(b.text)
        self.part = max((p for p in (_MAIN, _ARTICLE) if sizes[p]), default=0)
        if self.part == _ARTICLE and sizes[_ARTICLE] < LEAST_ARTICLE * (sizes[_ARTICLE] + sizes[_MAIN]):
            # Teasers within the main text.
            self.part = _MAIN
        inside = [self.part > 0 and not b.dropped and b.part >= self.part for b in self.blocks]
        whole = sum(len(b.text) for b, i in zip(self.blocks, inside, strict=True) if i)
        self.marked = [i and "." in b.mark and b.mark[1:].partition(".")[0] in _CONTAINERS and len(b.text) <= SMALL_SHARE * whole for b, i in zip(self.blocks, inside, strict=True)]
        self.open = [m or not i for m, i in zip(self.marked, inside, strict=True)]
        self.article = "\n".join(b.text for b, i, m in zip(self.blocks, inside, self.marked, strict=True) if i and not m)

    def text(self, covered: Iterator[np.ndarray]) -> str:
        """The main text, given which tokens of each block in turn that is not protected go."""
        kept = []
        for b, is_open, marked in zip(self.blocks, self.open, self.marked, strict=True):
            own = next(covered) if is_open else None
            if marked:
                if not own.all():
                    kept.append(b.text)
                continue
            if b.dropped or (is_open and self.part):
                continue
            if own is None or not own.any():
                kept.append(b.text)
            elif not own[1:].all():
                # The first token is the block's mark.
                kept.append(" ".join(w for w, c in zip(b.text.split(" "), own[1:].tolist(), strict=True) if not c))
        return " ".join(kept)


@dataclass
class Windows:
    """All substrings of some pages outside their protected blocks: key, page, first token and tokens of each.

    A page's stream is the mark of each block's element and its words; it is cut where protected blocks stand.
    A substring has ``min_tokens`` tokens; a block of fewer is one of its own as well.  A marked block within
    an article is a stretch of its own.
    """

    key: np.ndarray
    page: np.ndarray
    first: np.ndarray
    width: np.ndarray
    blocks: np.ndarray
    marked: np.ndarray

    @staticmethod
    def of(pages: list[Page], hosts: np.ndarray, min_tokens: int, powers: Powers) -> Windows:
        raw, page, stretch, loose = [], [], [], []
        cuts = 0
        for k, p in enumerate(pages):
            cuts += 1
            for b, is_open, marked in zip(p.blocks, p.open, p.marked, strict=True):
                cuts += marked
                if is_open:
                    loose.append(marked)
                    raw.append(f"{b.mark} {b.text}".encode("utf-8", "replace"))
                    page.append(k)
                    stretch.append(cuts)
                cuts += marked or not is_open
        offsets = np.cumsum([0, *map(len, raw)])
        hashes, at = word_hashes(np.frombuffer(b"".join(raw), dtype=np.uint8), offsets, powers)
        n, at = np.diff(at), at[:-1]
        page, stretch = np.array(page, dtype=np.int64), np.repeat(np.array(stretch, dtype=np.int64), n)
        first = np.arange(max(len(hashes) - min_tokens + 1, 0))
        first = first[stretch[first] == stretch[first + min_tokens - 1]] if len(first) else first
        whole = np.zeros(len(first), dtype=np.uint64)
        for k in range(min_tokens):
            whole = mix(whole + hashes[first + k])
        short = np.flatnonzero((n > 0) & (n < min_tokens))
        part = np.full(len(short), _SHORT)
        for k in range(int(n[short].max(initial=0))):
            live = n[short] > k
            part[live] = mix(part[live] + hashes[at[short[live]] + k])
        of = np.concatenate([np.repeat(page, n)[first], page[short]])
        key = mix(np.concatenate([whole, part]) + hosts[of])
        loose = np.array(loose, dtype=bool)
        marked = np.concatenate([np.repeat(loose, n)[first], loose[short]])
        # Repeats within articles and outside them are told apart.
        key[marked] = mix(key[marked])
        return Windows(key, of, np.concatenate([first, at[short]]), np.concatenate([np.full(len(first), min_tokens), n[short]]), n, marked)

    def contents(self, pages: list[Page], contents: np.ndarray) -> np.ndarray:
        """What tells distinct pages from copies, for each substring: the whole page's hash, within an article its protected text's."""
        own = np.zeros(len(pages), dtype=np.int64)
        for k in np.unique(self.page[self.marked]).tolist():
            own[k] = int.from_bytes(hashlib.blake2b(pages[k].article.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)
        return np.where(self.marked, own[self.page], contents[self.page])

    def covered(self, hit: np.ndarray) -> Iterator[np.ndarray]:
        """Of each block in turn, which tokens the substrings that ``hit`` tells cover."""
        marks = np.zeros(int(self.blocks.sum()) + 1, dtype=np.int64)
        np.add.at(marks, self.first[hit], 1)
        np.add.at(marks, self.first[hit] + self.width[hit], -1)
        return iter(np.split(np.cumsum(marks[:-1]) > 0, np.cumsum(self.blocks)[:-1]))


def _parsed(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, list[Page], np.ndarray]]:
    """(start, stop, pages, hosts) of slices of a batch with a column ``host``."""
    html_ = batch.column(column)
    hosts = batch.column(batch.schema.get_field_index("host")).to_numpy().view(np.uint64)
    for start, stop in slices(utf8(html_)[1], BYTES_AT_ONCE):
        yield start, stop, [Page(x) for x in html_.slice(start, stop - start).to_pylist()], hosts[start:stop]


def _runs(min_tokens: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, low, high) of the runs of equal prefixes in the suffix array of the pages at hand, low and high being contents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            contents = batch.column(1).to_numpy()
            for start, stop, pages, hosts in _parsed(batch, 2):
                found = Windows.of(pages, hosts, min_tokens, powers)
                key, content = found.key.view(np.int64), found.contents(pages, contents[start:stop])
                if not len(key):
                    continue
                suffixes = np.argsort(key, kind="stable")
                key, content = key[suffixes], content[suffixes]
                runs = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                low, high = (f.reduceat(content, runs) for f in (np.minimum, np.maximum))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key[runs], low, high)], names=["key", "low", "high"])

    return run


def extract_main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_tokens: int = 8, max_broadcast: int = 1_000_000, repeats: bool = True
) -> DataFrame:
    """(id, url, text, n_chars) of every page's whole html.

    Within an article (else within the main element, or if articles hold less than half of its text) the text of
    all blocks, whatever it says, in page order, joined by a space; references are decoded and white space
    squeezed.  A container there that has a class, stands right around its text and holds a quarter of the
    whole at most goes if it stands in two distinct articles of the host.  On a page with neither, of all
    blocks the tokens that no substring of ``min_tokens`` or more covers that stands on two pages of the host
    with different html; a shorter block goes if it stands on two.  Menus, headers, footers, sidebars, forms,
    hidden elements, scripts, styles and reader comments go wherever they stand.  So a page has the same text
    however large its host is, once two of its pages share what they share.

    A page that is null, empty or has no such text has an empty text.  Rows may repeat: equal pages of a host
    are one page and have equal texts.  A null URL has the empty host.  Other columns play no part, whatever
    they are called.  An empty table gives an empty result.  Parsing takes time in proportion to a page's
    length, whatever it holds.  ``repeats``: False keeps what the suffix array would remove.

    Of up to ``max_broadcast`` repeated substrings the 64-bit keys are broadcast.  Beyond that, keys are joined
    to the pages that hold them.
    """
    host, _ = host_and_path(F.col(url_col).cast("string"))
    page = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.xxhash64(host).alias("host"), F.xxhash64(page).alias("content"), page.alias("html"))
    kind = dict(rows.dtypes)["page_id"]
    found = rows.select("host", "content", "html").mapInArrow(_runs(min_tokens), "key long, low long, high long")
    found = found.groupBy("key").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    # A key of one content only is on one page.
    known = written(found.where("low <> high").select("key"), "repeats")
    few = known.limit(max_broadcast + 1).count() <= max_broadcast
    if few:
        keys = np.sort(known.toArrow()["key"].to_numpy().view(np.uint64)) if repeats else np.zeros(0, np.uint64)
        shared = pages.sparkSession.sparkContext.broadcast(keys)
        held = rows.select("page_id", "url", "host", F.lit(None).cast("array<long>").alias("keys"), "html")
    else:
        each = rows.select("host", "content", "html").mapInArrow(_keys_of(min_tokens), "host long, content long, key long")
        each = each.distinct().join(known, "key", "left_semi").groupBy("host", "content").agg(F.collect_list("key").alias("keys"))
        held = rows.join(each, ["host", "content"], "left").select("page_id", "url", "host", "keys", "html")
        shared = None

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for start, stop, found, hosts in _parsed(batch, 4):
                windows = Windows.of(found, hosts, min_tokens, powers)
                if shared is not None:
                    hit = _among(shared.value, windows.key)
                else:
                    hit = np.zeros(len(windows.key), dtype=bool)
                    for k in range(len(found)):
                        own = np.flatnonzero(windows.page == k)
                        hit[own] = np.isin(windows.key[own].view(np.int64), batch.column(3)[start + k].as_py() or [])
                covered = windows.covered(hit)
                texts = [p.text(covered) for p in found]
                cols = [batch.column(i).slice(start, stop - start) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return held.mapInArrow(returning_memory(extract), f"page_id {kind}, url string, text string, n_chars long")


def _among(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys are among the known, sorted ones."""
    if not len(known):
        return np.zeros(len(keys), dtype=bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def _keys_of(min_tokens: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(host, content, key) of every page's substrings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for start, stop, pages, hosts in _parsed(batch, 2):
                found = Windows.of(pages, hosts, min_tokens, powers)
                cols = [batch.column(k).slice(start, stop - start).take(pa.array(found.page)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(found.key.view(np.int64))], names=["host", "content", "key"])

    return run
