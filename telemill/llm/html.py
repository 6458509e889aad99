"""Main text of web pages by paths that the pages of a host agree on."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.llm.common import steps, written

#: Share of a host's votes a path needs to be used on its pages.
LEAST_SHARE = 0.1
#: Characters of a path that are spelled out.
LONGEST_PATH = 1000

# Element classes of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small"
    " span strike strong sub sup time tt u var wbr".split()
)
_CONTAINERS = frozenset("article main section div td body".split())
_DROPPED = frozenset(
    "head nav footer aside form script style title textarea noscript iframe template svg canvas object embed audio video"
    " select button dialog menu map datalist xmp noembed noframes".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
# Words in class and id names that mark what is not the article.
_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promoted menu"
    " nav navbar navigation topnav subnav sidebar sidebars rail footer masthead topbar cookie cookies consent gdpr notice"
    " notices banner popup modal overlay comment comments disqus respond replies share sharing social related recommended"
    " recommendations newsletter subscribe subscription signup breadcrumb breadcrumbs pagination pager widget widgets"
    " toolbar login search".split()
)
_HEADERS = frozenset(("header", "heading-bar", "pageheader", "siteheader"))
#: Words in class and id names of a header that is the article's own.
_OWN = frozenset("article entry post story".split())
_REMARKS = frozenset(("comment", "comments", "reply"))
# Words beside a mark that do not make a name another thing: ``site-footer``, but not ``has-sidebar`` or ``social-policy``.
_NEUTRAL = frozenset(
    "site page main top bottom left right primary secondary global list box area section container wrapper wrap inner bar"
    " block item items link links button buttons form post posts entry article articles story stories body".split()
)
#: A start tag closes open elements of these kinds.
_CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",), "thead": ("p",), "tbody": ("tr", "td", "th"),
}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'<]*+(?:\"[^\"<]*+\"|'[^'<]*+')?+)*+)[^>]*+>", re.S
)
_NAMED = re.compile(r"""\b(class|id|role|hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_DIGITS = re.compile(r"\d+")
_HOST = re.compile(r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")


@lru_cache(1 << 14)
def _marked(name: str, marks: frozenset) -> bool:
    """Whether a whole class or id names one of the marks: alone, or among neutral words and other marks."""
    words = {w.lower() for w in _WORDS.findall(name)}
    return bool(words & marks) and words <= marks | _MARKS | _NEUTRAL


def host_of(url: str | None) -> str:
    """The host of a URL in lower case; empty if there is none."""
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


class Page:
    """The blocks of text of one page and the elements around them.

    ``parent``, ``tag``, ``path`` and ``dropped`` describe elements by number, 0 being the page; ``blocks``
    are (element, text, characters inside links) in page order. An element that its class or id names as
    something else than the article (``named``) is dropped when the page is known as a whole.
    """

    def __init__(self, source: str):
        self.parent, self.tag, self.path, self.dropped, self.article = [-1], [""], [""], [False], [False]
        self.named, self.holds = [False], [False]
        self.blocks: list[tuple[int, str, int]] = []
        self._stack, self._text, self._linked, self._link = [0], [], 0, 0
        self._read(source)
        self._flush()
        self._drop_named()

    def _drop_named(self) -> None:
        """Drops what is named as something else, unless it holds the main element, articles or most of the text.

        Text is weighed inside main elements and articles, if they have any. Articles inside an article count
        by their text only.
        """
        if not any(self.named):
            return
        size = len(self.parent)
        core = list(self.holds)
        within, articles = list(self.holds), [False] * size
        for x in range(1, size):
            up = self.parent[x]
            core[x] = core[x] or core[up]
            articles[x] = articles[up] or self.holds[x] and self.tag[x] != "main"
        total, inner = [0] * size, [0] * size
        for element, text, _ in self.blocks:
            total[element] += len(text)
            inner[element] += len(text) if core[element] else 0
        for x in range(size - 1, 0, -1):
            up = self.parent[x]
            total[up] += total[x]
            inner[up] += inner[x]
            within[up] = within[up] or within[x]
        weight = inner if inner[0] else total
        for x in range(1, size):
            up = self.parent[x]
            wrapper = within[x] and not articles[up] or 2 * weight[x] > weight[0]
            self.dropped[x] = self.dropped[x] or self.dropped[up] or self.named[x] and not wrapper
        self.blocks = [b for b in self.blocks if not self.dropped[b[0]]]

    def _flush(self) -> None:
        if self._text:
            text = " ".join(entities.unescape("".join(self._text)).split())
            if text and not self.dropped[self._stack[-1]]:
                self.blocks.append((self._stack[-1], text, self._linked))
            self._text, self._linked = [], 0

    def _read(self, source: str) -> None:
        at, size = 0, len(source)
        while at < size:
            token = _TOKEN.search(source, at)
            end = token.start() if token else size
            if end > at:
                # Text inside dropped elements is never needed.
                if not self.dropped[self._stack[-1]]:
                    self._text.append(source[at:end])
                    if self._link:
                        self._linked += end - at
            if not token:
                return
            at = token.end()
            name = token[2]
            if not name:
                continue
            name = name.lower()
            if token[1]:
                self._end(name)
                continue
            closed = self._start(name, token[3])
            if closed and name in _RAW:
                stop = re.compile(rf"</{name}\b[^>]*>", re.I).search(source, at)
                at = stop.end() if stop else size
                self._end(name)

    def _pop(self, names: tuple[str, ...], until: frozenset = frozenset(("table", "ul", "ol", "dl", "select"))) -> None:
        for depth in range(len(self._stack) - 1, 0, -1):
            tag = self.tag[self._stack[depth]]
            if tag in names:
                del self._stack[depth:]
                return
            if tag in until:
                return

    def _start(self, name: str, attributes: str) -> bool:
        """Opens an element; whether it has content."""
        if name in _INLINE:
            if name == "br":
                self._text.append(" ") if self._text else None
            elif name == "a":
                self._link = 1
            if name in _VOID or "hidden" not in attributes and "none" not in attributes:
                return False
        self._flush()
        self._link = 0
        if name in _VOID:
            return False
        if name in _CLOSES:
            self._pop(_CLOSES[name])
        elif name not in _INLINE:
            # Every other block ends an open paragraph.
            self._pop(("p",), frozenset(("table", "ul", "ol", "dl", "div", "section", "article", "main", "blockquote", "td", "th", "li")))
        top = self._stack[-1]
        named = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _NAMED.finditer(attributes)} if attributes.strip() else {}
        names = f"{named.get('class', '')} {named.get('id', '')}".split()
        classes = ".".join(sorted({_DIGITS.sub("#", c) for c in named.get("class", "").lower().split()}))
        number = len(self.parent)
        main = name in ("article", "main") or named.get("role", "").lower() in ("main", "article")
        inside = self.article[top]
        own = any(w.lower() in _OWN for n in names for w in _WORDS.findall(n))
        dropped = (
            self.dropped[top]
            or name in _DROPPED
            or "hidden" in named
            or _HIDDEN.search(named.get("style", "")) is not None
            or named.get("role", "").lower() in _ROLES
            or (not inside and not main and not own and name == "header")
        )
        if main:
            # A reader's comment may be an article of its own.
            other = inside and any(_marked(n, _REMARKS) for n in names)
        else:
            other = name not in ("html", "body") and any(
                _marked(n, _MARKS) or not inside and not own and _marked(n, _HEADERS) for n in names
            )
        self.named.append(other)
        # Comments are articles that hold no article.
        self.holds.append(main and not dropped and not any(_marked(n, _REMARKS) for n in names))
        self.parent.append(top)
        self.tag.append(name)
        path = f"{self.path[top]}/{name}{'.' + classes if classes else ''}"
        # A very deep path is named by its digest.
        self.path.append(path if len(path) <= LONGEST_PATH else f"#{xxhash.xxh3_128_hexdigest(path)}")
        self.dropped.append(dropped)
        self.article.append(inside or main)
        self._stack.append(number)
        return True

    def _end(self, name: str) -> None:
        if name in _INLINE:
            if name == "a":
                self._link = 0
            if not any(self.tag[x] == name for x in self._stack):
                return
        self._flush()
        self._link = 0
        for depth in range(len(self._stack) - 1, 0, -1):
            if self.tag[self._stack[depth]] == name:
                del self._stack[depth:]
                return

    def best(self) -> int:
        """The container whose blocks look most like an article; 0 if there is none."""
        size = len(self.parent)
        total, score = [0] * size, [0.0] * size
        for element, text, linked in self.blocks:
            total[element] += len(text)
            score[element] += max(0.0, len(text) - 2.0 * linked)
        # Elements come after those around them; each container passes half its score on.
        for x in range(size - 1, 0, -1):
            up = self.parent[x]
            total[up] += total[x]
            score[up] += score[x] / 2 if self.tag[x] in _CONTAINERS else score[x]
        found = [x for x in range(1, size) if total[x] and self.tag[x] in _CONTAINERS]
        if not found:
            return 0
        best = max(found, key=lambda x: (score[x], -x))
        # The heading often stands beside the container of the paragraphs, within the article.
        x = self.parent[best]
        while x > 0:
            if self.tag[x] in _CONTAINERS and self.tag[x] != "body" and (
                total[x] <= 1.25 * total[best] or self.tag[x] in ("article", "main") and total[x] <= 2 * total[best]
            ):
                best = x
            x = self.parent[x]
        return best

    def below(self, chosen: set[int]) -> list[str]:
        """The blocks within the chosen elements, in page order."""
        inside = [False] * len(self.parent)
        for x in range(len(inside)):
            inside[x] = x in chosen or x > 0 and inside[self.parent[x]]
        return [text for element, text, _ in self.blocks if inside[element]]

    def text(self, paths: tuple[str, ...]) -> str:
        """The blocks below the elements of the first path that has any; else those of the best container."""
        for path in paths:
            chosen = {i for i, p in enumerate(self.path) if p == path and not self.dropped[i]}
            if chosen and (found := self.below(chosen)):
                return "\n\n".join(found)
        return "\n\n".join(self.below({self.best()}))


def votes(df: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host, path, votes``: in how many pages of a host a path leads to the best container."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, 1):
            counts: dict[tuple[str, str], int] = {}
            for url, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                page = Page(source or "")
                if best := page.best():
                    key = (host_of(url), page.path[best])
                    counts[key] = counts.get(key, 0) + 1
            arrays = [pa.array([k[i] for k in counts], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(list(counts.values()), pa.int64())], ["host", "path", "votes"])

    slim = df.select(F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    # Each step sends one row per host and path, so a hot host is small before it is shuffled.
    return slim.mapInArrow(run, "host string, path string, votes long").groupBy("host", "path").agg(F.sum("votes").alias("votes"))


def consensus(counted: DataFrame, least_share: float = LEAST_SHARE) -> DataFrame:
    """``host, paths``: the paths with at least ``least_share`` of a host's votes, most votes first."""
    sums = counted.groupBy("host").agg(F.sum("votes").alias("total"))
    kept = counted.join(sums, "host").where(F.col("votes") >= F.col("total") * least_share)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("rank"), "path")))
    return kept.groupBy("host").agg(ordered.alias("found")).select("host", F.col("found.path").alias("paths"))


def extract(
    df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_share: float = LEAST_SHARE
) -> DataFrame:
    """``id, url, text`` for every page: the article's blocks in page order, joined by a blank line.

    First each page's containers are scored by the text in their blocks, less what stands in links, and the
    page votes for the path of its best one: tags and classes from the root, digits generalised. Votes are
    counted per host. Then every page is read again and the blocks below the host's winning path are taken;
    a page that has none of the host's paths falls back to its own best container. Menus, headers, footers,
    sidebars, notices, adverts, forms, comments, scripts and styles are left out in both steps. A class or id
    counts as a whole, and never for an element that holds the main element, articles or most of the text.

    A null page is empty, pages without a host vote together, repeated rows stay, an empty table gives no
    row. The table of winning paths has one short row per host and is written before it is joined, so Spark
    knows its size: it is broadcast if small, else pages are shuffled by host and a hot host is split.
    """
    winners = written(consensus(votes(df, url_col, html_col), least_share)).withColumnRenamed("host", "_host")
    host = F.lower(F.coalesce(F.nullif(F.regexp_extract("url", _HOST.pattern, 1), F.lit("")), F.lit("")))
    pages = df.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")
    )
    joined = pages.join(winners, host == F.col("_host"), "left").select("id", "url", "html", "paths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, 2):
            paths = [tuple(p or ()) for p in batch.column(3).to_pylist()]
            texts = [Page(s or "").text(p) for s, p in zip(batch.column(2).to_pylist(), paths)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["id", "url", "text"])

    return joined.mapInArrow(run, "id long, url string, text string")
