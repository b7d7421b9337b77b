"""Main text of web pages by consensus of each host's pages.

A page is scanned once into a light tree.  Each container is scored by how much of the page's article text it holds and
how little else; the best few vote for their generalised path of tags and classes (digits become #).  Spark sums the
votes of each host, and every page is then extracted from the container on its host's leading path that it has, or
from its own best where it has none.

Defined results: null html is empty and gives empty text; a null or odd url has the host "", whose pages vote
together; unclosed, misnested and cut-off tags are taken as browsers would roughly take them; a quote that is never closed
ends at the next sign >; character references are decoded in each piece of text by itself; formulas keep their text, drawings
are dropped; very long pages, names and attributes are read whole; repeated rows vote and come back as often
as they occur; equal votes go to the path that sorts first; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.shared import join_skewed, prepare, stored, wanted

#: Paths that a page votes for and that a host keeps.
VOTES, KEPT = 3, 3
#: Elements that a path spells out; what lies deeper has a digest of its path.
SPELT = 64
#: Up to so many bytes of winning paths are broadcast; more go through a join.
BROADCAST_BYTES = 16 << 20

# Tag classes of HTML and words that name page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
MATHS = frozenset("math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot munder mover munderover mtable mtr mtd mspace mstyle mpadded mphantom menclose merror semantics".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()) | MATHS
CONTAINERS = frozenset("html body main article section div td center".split())
DROPPED = frozenset("nav footer aside form button select input dialog menu object canvas audio video head noscript template svg annotation annotation-xml".split()) | RAW - {"xmp"}
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising adbox adslot banner breadcrumb breadcrumbs captcha comment comments commentlist consent cookie cookies copyright "
    "disclaimer discussion disqus dropdown feedback footer gdpr login masthead menu menubar modal nav navbar navigation newsletter notice notices overlay pager pagination "
    "popup promo promoted recommended related replies respond responses rss search share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription "
    "tags toc toolbar topbar trackback trackbacks widget widgets".split()
)
#: Words that stand beside those in the names of furniture.
COMPANIONS = frozenset(
    "area articles aside bar block bottom box button buttons card center col column container content form group header holder icon icons inner item items left link links list main "
    "module outer panel policy post posts primary reader right row secondary section sections site slot stories sub the thread title top unit user view wrap wrapper".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
HINTS = frozenset("article articlebody body content entry main post story text".split())
#: An open p is closed by these; each of the others by its own kind.
ENDS_P = frozenset("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
ENDS_OWN = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("thead", "tbody", "tfoot"), "tbody": ("thead", "tbody", "tfoot")}
BARRIER = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "thead": ("table",), "tbody": ("table",), "option": ("select",)}
#: End tags reach no further up than to these, those of tables apart.
SCOPE, TABULAR = ("td", "th", "caption"), frozenset("table thead tbody tfoot tr td th caption".split())
#: What ends a drawing that was left open.
ENDS_SVG = ENDS_P | frozenset("b big body br code dd dt em embed head i img li meta nobr ruby s small span strike strong sub sup tt u var".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)?\s*(=)?\s*")
_BARE = re.compile(r"[^\s>]*")
_HOST = re.compile(r"^[a-zA-Z][\w+.-]*://(?:[^/@?#]*@)?([^/:?#]+)")
_WORDS = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_DIGITS = re.compile(r"\d+")


class Page:
    """Elements in page order (parent, tag, path, whether furniture) and pieces of text with their elements.

    The source is read once from front to back; the places of open elements are kept by tag, so no tag costs more
    than what it closes.
    """

    def __init__(self, source: str) -> None:
        self.source = source
        self.parent, self.tag, self.path = [-1], ["#"], [""]
        self.out, self.hint, self.link = [False], [False], [False]
        self.article, self.held, self.depth = [False], [False], [0]  # whether in an article; in that or the main part
        self.suspects: list[int] = []
        self.pieces: list[tuple[int, str]] = []  # (element, decoded text); a blank where a block starts or ends
        self.stack = [0]
        self.open: dict[str, list[int]] = {}  # places in the stack by tag
        self.blocks = [0]  # places of elements that aren't inline
        self.never: set[str] = set()  # signs that don't come again
        at, n = 0, len(source)
        while at < n:
            start = source.find("<", at)
            if start < 0:
                start = n
            if start > at:
                self._text(source[at:start])
            if start == n:
                break
            at = self._tag(start, n)
        self._judge()

    def _text(self, text: str, decode: bool = True) -> None:
        self.pieces.append((self.stack[-1], html.unescape(text) if decode and "&" in text else text))

    def _find(self, sign: str, at: int) -> int:
        """Where the sign comes next, -1 if never: then it is looked for no more."""
        if sign in self.never:
            return -1
        found = self.source.find(sign, at)
        if found < 0:
            self.never.add(sign)
        return found

    def _tag(self, start: int, n: int) -> int:
        """Take what the sign < at ``start`` begins; where the page goes on."""
        source = self.source
        if source.startswith("<!--", start):
            if source.startswith((">", "->"), start + 4):
                return source.index(">", start) + 1
            end = self._find("-->", start + 4)
            return n if end < 0 else end + 3
        closing = source.startswith("/", start + 1)
        m = _NAME.match(source, start + 1 + closing)
        if not m:
            if closing or source.startswith(("!", "?"), start + 1):  # a declaration or a faulty comment
                end = self._find(">", start)
                return n if end < 0 else end + 1
            self._text("<", False)
            return start + 1
        tag = m[0].lower()
        found, at, whole = self._attributes(m.end(), n)
        if not whole:
            return n  # an unfinished tag at the end of the page is dropped
        if closing:
            self._close(tag)
            return at
        self._imply(tag)
        node = self._open(tag, found)
        if tag not in INLINE:
            self.pieces.append((node, " "))
        if tag in RAW:
            end = _END[tag].search(source, at)
            if tag == "xmp":  # old, but shown as it stands
                self.pieces.append((node, source[at : end.start() if end else n]))
            self.pieces.append((self.stack[-1], " "))
            return end.end() if end else n
        if tag not in VOID and not (source[at - 2] == "/" and tag in ("svg", "math")):
            self._push(node, tag)
        return at

    def _attributes(self, at: int, n: int) -> tuple[dict[str, str], int, bool]:
        """Attributes from ``at`` on, where the tag ends, and whether it does end."""
        source, found = self.source, {}
        while at < n:
            if source[at] == ">":
                return found, at + 1, True
            m = _ATTR.match(source, at)
            at, value = m.end(), ""
            if m[2] and m[1]:
                quote = source[at : at + 1]
                if quote in ("'", '"'):
                    end = self._find(quote, at + 1)
                    if end < 0:  # never closed: the tag ends where the next sign > is
                        end = self._find(">", at)
                        return found, end + 1, end >= 0
                    value, at = source[at + 1 : end], end + 1
                else:
                    v = _BARE.match(source, at)
                    value, at = v[0], v.end()
            if m[1]:
                found.setdefault(m[1].lower(), value)
        return found, at, False

    def _push(self, node: int, tag: str) -> None:
        place = len(self.stack)
        self.stack.append(node)
        self.open.setdefault(tag, []).append(place)
        if tag not in INLINE:
            self.blocks.append(place)

    def _pop(self, place: int) -> None:
        """Close the element at a place of the stack, and all within it."""
        for k in range(len(self.stack) - 1, place - 1, -1):
            self.open[self.tag[self.stack[k]]].pop()
            if self.blocks[-1] == k:
                self.blocks.pop()
        del self.stack[place:]

    def _last(self, tags: tuple[str, ...]) -> int:
        """The highest place of an open element with one of the tags, 0 if there is none."""
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=0)

    def _close(self, tag: str) -> None:
        place = self._last((tag,))
        if place and (tag in TABULAR or place > self._last(SCOPE)):
            self._pop(place)
        if tag not in INLINE:
            self.pieces.append((self.stack[-1], " "))

    def _imply(self, tag: str) -> None:
        if tag in ENDS_SVG and (drawing := self._last(("svg",))) and not self._last(("foreignobject", "desc")) > drawing:
            self._pop(drawing)
        if tag in ENDS_P:
            if (place := self.blocks[-1]) and self.tag[self.stack[place]] == "p":
                self._pop(place)
        elif tag in ENDS_OWN:
            place = self._last(ENDS_OWN[tag])
            if place > self._last(BARRIER[tag]):
                while tag == "tr" and (below := self._last(("tr",))) > self._last(("table",)) and below < place:
                    place = below
                self._pop(place)

    def _open(self, tag: str, found: dict[str, str]) -> int:
        parent = self.stack[-1]
        classes = html.unescape(found.get("class", ""))
        names = f"{classes} {found.get('id', '')} {found.get('itemprop', '')}"
        tokens = [_WORDS.findall(_CAMEL.sub(" ", t).lower()) for t in names.split()]
        own = found.get("role", "").lower()
        hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
        # The page itself and its article are never furniture, whatever their classes say.
        holds = tag in ("html", "body", "main", "article")
        node = len(self.tag)
        self.parent.append(parent)
        self.tag.append(tag)
        step = "/" + ".".join([tag, *sorted({_DIGITS.sub("#", c) for c in classes.lower().split()})])
        self.depth.append(self.depth[parent] + 1)
        path = self.path[parent] + step
        self.path.append(path if self.depth[-1] <= SPELT else "/#" + hashlib.blake2b(path.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest())
        self.article.append(self.article[parent] or tag == "article")
        self.held.append(self.held[parent] or tag in ("article", "main") or own in ("article", "main"))
        drop = tag in DROPPED or (tag == "header" and not self.article[parent]) or own in ROLES or hidden
        if not (drop or holds):
            named = [t for t in tokens if not FURNITURE.isdisjoint(t)]
            # Within an article a name must mean furniture as a whole; else links decide.
            drop = bool(named) and (not self.held[parent] or any(all(w in FURNITURE or w in COMPANIONS or len(w) == 1 or w.isdigit() for w in t) for t in named))
            if named and not drop:
                self.suspects.append(node)
        self.out.append(self.out[parent] or (drop and not holds))
        self.hint.append(tag in ("main", "article") or own in ("main", "article") or any(not HINTS.isdisjoint(t) for t in tokens))
        self.link.append(self.link[parent] or tag == "a")
        return node

    def _judge(self) -> None:
        """Suspects of which links are half of the text or more are furniture too."""
        if not self.suspects:
            return
        text, links = [0] * len(self.tag), [0] * len(self.tag)
        for node, piece in self.pieces:
            size = len(piece.strip())
            text[node] += size
            links[node] += size * self.link[node]
        for k in range(len(self.tag) - 1, 0, -1):
            text[self.parent[k]] += text[k]
            links[self.parent[k]] += links[k]
        for k in self.suspects:
            self.out[k] = self.out[k] or 2 * links[k] >= max(text[k], 1)
        for k in range(1, len(self.tag)):
            self.out[k] = self.out[k] or self.out[self.parent[k]]

    def best(self) -> list[tuple[float, int]]:
        """Containers and their scores, best first: share of the page's article text, squared, times purity."""
        n = len(self.tag)
        good, whole = [0.0] * n, [0.0] * n
        for node, text in self.pieces:
            size = len(text.strip())
            if size:
                whole[node] += size
                if not self.out[node] and not self.link[node]:
                    good[node] += size
        for k in range(n - 1, 0, -1):
            good[self.parent[k]] += good[k]
            whole[self.parent[k]] += whole[k]
        if not good[0]:
            return []
        found = [((good[k] / good[0]) ** 2 * good[k] / max(whole[k], 1) * (1.25 if self.hint[k] else 1.0), k) for k in range(n) if (not k or self.tag[k] in CONTAINERS) and not self.out[k] and good[k]]
        return sorted(found, key=lambda x: (-round(x[0], 6), -x[1]))

    def text(self, top: int) -> str:
        """Text of an element without its furniture: blocks joined by one blank."""
        inside = [False] * len(self.tag)
        inside[top] = True
        for k in range(top + 1, len(self.tag)):
            inside[k] = inside[self.parent[k]] and not self.out[k]
        return " ".join("".join(t for node, t in self.pieces if inside[node]).split())


_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}


def host_of(url: str | None) -> str:
    """Host of a url in lower case, without www."""
    m = _HOST.match(url or "")
    return m[1].lower().removeprefix("www.") if m else ""


def votes(pages: DataFrame) -> DataFrame:
    """host, path and score of each page's best containers."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths, scores = [], [], []
            for url, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = Page(source or "")
                seen: dict[str, float] = {}
                for score, node in page.best()[: 4 * VOTES]:
                    seen.setdefault(page.path[node], score)
                for path, score in list(seen.items())[:VOTES]:
                    hosts.append(host_of(url))
                    paths.append(path)
                    scores.append(round(score * 1000))
            yield pa.RecordBatch.from_pydict({"host": pa.array(hosts, pa.string()), "path": pa.array(paths, pa.string()), "score": pa.array(scores, pa.int64())})

    return pages.mapInArrow(vote, "host string, path string, score long")


def consensus(pages: DataFrame) -> DataFrame:
    """host and its leading paths, best first, as a written table."""
    sums = votes(pages).groupBy("host", "path").agg(F.sum("score").alias("score"))
    ranked = sums.withColumn("rank", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("score"), "path"))).where(F.col("rank") <= KEPT)
    return stored(ranked.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("rank", "path"))).alias("p")).select("host", F.col("p.path").alias("paths")), "host-paths")


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    prepare(pages.sparkSession)
    rows = wanted(pages, id_col, url_col, html_col).select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    paths = consensus(rows.select("url", "html"))

    def run(batches: Iterator[pa.RecordBatch], table: dict[str, list[str]] | None = None) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            own = batch.column("paths").to_pylist() if table is None else None
            for i, (url, source) in enumerate(zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True)):
                page = Page(source or "")
                best = page.best()
                leading = (own[i] if table is None else table.get(host_of(url))) or []
                chosen = next((k for path in leading for _, k in best if page.path[k] == path), best[0][1] if best else None)
                texts.append(page.text(chosen) if chosen is not None else "")
            yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    schema = "page_id long, url string, text string, n_chars long"
    size = paths.agg(F.sum(F.length("host") + F.expr("aggregate(paths, 0, (a, p) -> a + length(p))") + 64)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        sent = rows.sparkSession.sparkContext.broadcast({r.host: r.paths for r in paths.collect()})
        return rows.mapInArrow(lambda b: run(b, sent.value), schema)
    host = F.udf(host_of, "string")
    return join_skewed(rows.withColumn("host", host("url")), paths, ["host"]).mapInArrow(run, schema)
