"""Main text of web pages with a site style tree.

Pages of one host are merged by element path (tag, class and id from the root down), before anything but scripts,
menus and other certain elements (`DROPPED`, `ROLES`, hidden ones) is left out.  For each path the tree has how many
pages hold it, how its child tag sequences vary (presentation), and on how many pages each of its text blocks stands
(content).  Importance follows entropy: a path whose presentation varies, or whose content differs from page to page,
is worth 1; one that looks and reads the same everywhere is worth 0.  A branch's composite importance mixes its own
with its children's, by the number of its presentation styles.  A branch stays if its composite importance is at least
what its place and name ask for (`Page.needs`):

* `LEAST` for containers in the page's main part (its main and article elements), or anywhere if it has none;
* `OUTSIDE` for what is outside that part: it stays only if make-up and words both change from page to page;
* `NAMED` if a class or id token says boilerplate, and nothing is enough if it says that others wrote or link there
  (`OTHERS`: reader comments, related pages), for those differ from page to page and no tree can see them.

Only whole tokens of class and id count, and a name never condemns what holds the page's main or article.  The first
headline of a header outside the main part stays if the page keeps no other and the tree finds that it changes from
page to page.  Hosts with fewer than `PAGES` pages have no tree: there outside and name alone decide, and a header's
headline stays unless the header is the page's own.

The counts are made by (host and path, value), so a host with a third of all pages is spread over its values.  The
importances go to the pages as one broadcast if they have been counted and number at most `BROADCAST_PATHS`; beyond
that pages meet them by (host, salt), a host with many pages having many salts.

Defined results: null or empty html gives an empty text; a page all of whose text would go by importance keeps what
structure and names keep, one all of whose text would go by names keeps what no element, role or style condemns;
repeated pages are extracted each; very long pages take time and memory in proportion; ties cannot arise, importance
being compared with fixed needs; other columns, whatever their names, are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.runtime import Scratch, columns

PAGES, DECAY = 5, 0.9
LEAST, NAMED, OUTSIDE, NEVER, HEADLINE = 0.15, 0.95, 0.93, 2.0, 0.5
#: Articles are the page's main part if they hold one part in TEASER of its text at least.
TEASER = 4
BROADCAST_PATHS = 200_000
#: Pages of a host that one task holds where importances are not broadcast.
HOST_PAGES = 2_000

#: Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe textarea title xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup "
    "hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset("nav footer aside form menu dialog button select input option label fieldset head script style noscript template iframe svg math object canvas textarea title audio video".split())
#: Containers that importance may remove; paragraphs, headings and the like go only with their container.
CONTAINERS = frozenset("div section ul ol dl table aside header footer nav center figure details".split())
#: What a start tag of the key closes first.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr"}, "tbody": {"thead", "tbody"}, "tfoot": {"tbody"}}
STOPS_CLOSE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
#: Class and id tokens that mark boilerplate, without case, _ as -, and adBox as ad-box.
BOILERPLATE = frozenset(
    "ad ads ad-box advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies cookie-notice cookie-banner consent gdpr notice "
    "notices popup modal overlay sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar share sharing social social-links "
    "newsletter subscribe subscription signup login search widget widgets pagination pager skip skip-link site-header site-footer".split()
)
#: Those of blocks that others wrote or that lead to other pages.
OTHERS = frozenset(
    "comment comments comment-list comments-area comments-section disqus disqus-thread respond replies related related-posts related-articles recommended recommendations".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar alertdialog".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(/?)>|<[!?][^>]*>", re.DOTALL)
_UNCLOSED = re.compile(r"<!--.*\Z", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HIDDEN = re.compile(r"display\s*:\s*none", re.IGNORECASE)
_DIGITS = re.compile(r"\d+")
_CAMEL = re.compile(r"([a-z])([A-Z])")
_RAW_ENDS = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.IGNORECASE) for name in RAW}
_HEADLINES = ("h1", "h2")


def named(names: str) -> int:
    """2 if a token is of OTHERS, 1 if one is of BOILERPLATE, else 0."""
    tokens = _CAMEL.sub(r"\1-\2", names).lower().replace("_", "-").split()
    return 2 if not OTHERS.isdisjoint(tokens) else 1 if not BOILERPLATE.isdisjoint(tokens) else 0


class Page:
    """Elements in page order, and blocks of text in the element that holds them.  Time and memory are linear in the page."""

    def __init__(self, source: str, use_names: bool = True):
        # Of each element: parent, tag, path (a number that stands for it), certain to go, what its name says, its kind of main part, children's tags.
        self.parent, self.tag, self.path, self.hard, self.named, self.kind = [-1], [""], [0], [False], [0], [""]
        self.children: list[list[str]] = [[]]
        # Blocks: the element that holds one, and its pieces with the element of each.
        self.blocks: list[tuple[int, list[int], list[str]]] = []
        self.stack, self.holders, self.open = [0], [0], Counter()  # open elements, the block around each, open tags
        self.of: list[int] = []
        self.buffer: list[str] = []
        self.use_names = use_names
        at, size, last = 0, len(source), source.rfind(">")
        while at < size:
            m = _TOKEN.search(source, at) if at <= last else _UNCLOSED.search(source, at)
            if m is None:
                self._text(source[at:])
                break
            if m.start() > at:
                self._text(source[at : m.start()])
            at = m.end()
            name = m.group(2) if m.re is _TOKEN else None
            if name is None:
                continue
            name = name.lower()
            if m.group(1):
                self._end(name)
                continue
            self._start(name, m.group(3), bool(m.group(4)))
            if name in RAW and not m.group(4):
                close = _RAW_ENDS[name].search(source, at)
                at = close.end() if close else size
                self._pop_to(len(self.stack) - 2)
        self._flush()
        self._weigh()

    def _text(self, raw: str) -> None:
        node = self.stack[-1]
        if not self.hard[node]:  # an inline element that goes does not part the block around it
            self.of.append(node)
            self.buffer.append(entities.unescape(raw) if "&" in raw else raw)

    def _flush(self) -> None:
        if self.buffer:
            if any(not x.isspace() for x in self.buffer):
                self.blocks.append((self.holders[-1], self.of, self.buffer))
            self.of, self.buffer = [], []

    def _pop_to(self, depth: int) -> None:
        gone = [self.tag[x] for x in self.stack[depth + 1 :]]
        if not BLOCKS.isdisjoint(gone):
            self._flush()
        self.open.subtract(gone)
        del self.stack[depth + 1 :], self.holders[depth + 1 :]

    def _start(self, name: str, raw: str, closed: bool) -> None:
        if name in BLOCKS:
            self._flush()
            if self.open["p"]:
                for k in range(len(self.stack) - 1, 0, -1):  # an open paragraph ends where a block begins
                    tag = self.tag[self.stack[k]]
                    if tag == "p":
                        self._pop_to(k - 1)
                        break
                    if tag in BLOCKS:
                        break
        if name in CLOSES and any(self.open[tag] for tag in CLOSES[name]):
            for k in range(len(self.stack) - 1, 0, -1):
                tag = self.tag[self.stack[k]]
                if tag in STOPS_CLOSE[name]:
                    break
                if tag in CLOSES[name]:
                    self._pop_to(k - 1)
                    break
        up = self.stack[-1]
        self.children[up].append(name)
        if name == "br" and not self.hard[up]:
            self.of.append(up)
            self.buffer.append(" ")
        if name in VOID:
            return
        names, role, hidden = "", "", False
        if raw and not raw.isspace():
            for key, a, b, c in _ATTRIBUTE.findall(raw):
                key = key.lower()
                if key in ("class", "id"):
                    names += " " + (a or b or c)
                elif key == "role":
                    role = (a or b or c).strip().lower()
                elif key == "hidden" or (key == "style" and _HIDDEN.search(a or b or c)):
                    hidden = True
        self.kind.append("main" if "main" in (name, role) else "article" if "article" in (name, role) else "")
        self.hard.append(self.hard[up] or name in DROPPED or role in ROLES or hidden)
        self.named.append(named(names) if names and self.use_names and name not in ("html", "body", "article", "main") else 0)
        self.parent.append(up)
        self.path.append(step(self.path[up], name, names))
        self.tag.append(name)
        self.children.append([])
        if not closed or name in ("p", "div", "span"):
            self.stack.append(len(self.tag) - 1)
            self.holders.append(len(self.tag) - 1 if name in BLOCKS else self.holders[-1])
            self.open[name] += 1

    def _end(self, name: str) -> None:
        if name in BLOCKS:
            self._flush()
        if not self.open[name]:
            return
        for k in range(len(self.stack) - 1, 0, -1):
            tag = self.tag[self.stack[k]]
            if tag == name:
                self._pop_to(k - 1)
                return
            if name not in BLOCKS and name not in DROPPED and tag in BLOCKS:
                return

    def _weigh(self) -> None:
        """Once the page is read: what is condemned by name, what is in the main part, and what is in a header outside it."""
        n = len(self.tag)
        weight = [0] * n
        for _, of, pieces in self.blocks:
            for node, piece in zip(of, pieces, strict=True):
                weight[node] += len(piece.strip())
        mains, articles = [False] * n, [False] * n  # holds a main, an article with text
        for node in range(n - 1, 0, -1):
            up = self.parent[node]
            if self.hard[node]:
                continue
            if weight[node]:
                mains[node] |= self.kind[node] == "main"
                articles[node] |= self.kind[node] == "article"
            weight[up] += weight[node]
            mains[up] |= mains[node]
            articles[up] |= articles[node] and self.named[node] < 2
        some_main = mains[0]
        # A name does not condemn what holds the page's main, or its articles; if it tells of others, only what holds its main.
        self.bad = [bool(w) and not mains[x] and not (w == 1 and articles[x] and not some_main) for x, w in enumerate(self.named)]
        self.inside, under, self.headed = [False] * n, [False] * n, [False] * n
        for node in range(1, n):
            up = self.parent[node]
            under[node] = under[up] or self.bad[node]
            self.inside[node] = (self.inside[up] or (bool(self.kind[node]) and not under[node])) and not self.hard[node]
            self.headed[node] = not self.inside[node] and (self.headed[up] or self.tag[node] == "header")
        # Articles that hold little of the text that names leave are teasers; then the page has no main part.
        own = own_inside = 0
        for holder, of, pieces in self.blocks:
            if not under[holder]:
                size = sum(len(x.strip()) for x in pieces)
                own += size
                own_inside += size if self.inside[holder] else 0
        self.whole = own_inside > 0 and (some_main or TEASER * own_inside >= own)
        self.holds_main = [False] * n
        for node in range(n - 1, 0, -1):
            if self.inside[node] or self.holds_main[node]:
                self.holds_main[self.parent[node]] = True

    def needs(self, node: int, whole: bool, names: bool, known: bool) -> float:
        """The importance that this element must have to stay; 0 if it may not go by itself."""
        if names and self.bad[node]:
            return NAMED if self.named[node] == 1 and known and self.tag[node] in BLOCKS else NEVER
        if whole and self.holds_main[self.parent[node]] and not self.inside[node] and not self.holds_main[node]:
            return OUTSIDE if known else NEVER
        if self.headed[node] and self.tag[node] == "header" and not known:
            return NEVER
        return LEAST if self.tag[node] in CONTAINERS and known else 0.0

    def text(self, tree: Tree | None = None) -> str:
        """Blocks that stay; without a tree structure and names alone decide."""
        if not self.blocks:
            return ""
        n = len(self.tag)
        importance = self._importance(tree) if tree is not None else [1.0] * n
        for use_tree, names in ((True, True), (False, True), (False, False)):
            if use_tree and tree is None:
                continue
            gone = [False] * n
            for node in range(1, n):
                gone[node] = gone[self.parent[node]] or (use_tree and importance[node] < self.needs(node, self.whole, names, True)) or (not use_tree and self.needs(node, self.whole and names, names, False) == NEVER)
            # Text that lies bare in an element that only holds the main part is outside it.
            bare = self.whole and names
            kept = [(k, x) for k, (holder, of, pieces) in enumerate(self.blocks) if not (bare and not self.inside[holder] and self.holds_main[holder]) and (x := self._words(of, pieces, gone))]
            if kept:
                return "\n".join(x for _, x in sorted(kept + self._headline(kept, tree)))
        return ""

    def _words(self, of: list[int], pieces: list[str], gone: list[bool]) -> str:
        return " ".join("".join(x for node, x in zip(of, pieces, strict=True) if not gone[node]).split())

    def _headline(self, kept: list[tuple[int, str]], tree: Tree | None) -> list[tuple[int, str]]:
        """The first headline of a header outside the main part, if nothing kept is one."""
        if any(self.tag[self.blocks[k][0]] in _HEADLINES for k, _ in kept):
            return []
        have = {k for k, _ in kept}
        for k, (holder, of, pieces) in enumerate(self.blocks):
            if k in have or self.tag[holder] != "h1" or not self.headed[holder]:
                continue
            up = holder
            while self.tag[up] != "header":
                up = self.parent[up]
            if tree is not None:
                stays = tree.content(self.path[holder]) >= HEADLINE
            else:
                stays = self.tag[self.parent[up]] not in ("", "body", "html")
            return [(k, self._words(of, pieces, [False] * len(self.tag)))] if stays else []
        return []

    def _importance(self, tree: Tree) -> list[float]:
        n = len(self.tag)
        total, parts = [0.0] * n, [0] * n
        for holder, _, _ in self.blocks:
            total[holder] += tree.content(self.path[holder])
            parts[holder] += 1
        importance = [1.0] * n
        for node in range(n - 1, 0, -1):
            if parts[node]:
                own, styles = tree.presentation(self.path[node])
                keep = DECAY**styles
                importance[node] = (1 - keep) * own + keep * total[node] / parts[node]
                up = self.parent[node]
                total[up] += importance[node]
                parts[up] += 1
        return importance


_STEPS: dict[tuple[int, str, str], int] = {}


def step(up: int, name: str, names: str) -> int:
    """The path of a child: its parent's, tag, and class and id tokens with every number as 0."""
    key = (up, name, names)
    found = _STEPS.get(key)
    if found is None:
        if len(_STEPS) > 200_000:
            _STEPS.clear()
        found = _STEPS[key] = stable_id(f"{up}/{name}{_DIGITS.sub('0', '.'.join(sorted(names.split()))) if names else ''}")
    return found


def stable_id(text: str) -> int:
    """A signed 64-bit number for a text, the same in every process."""
    import xxhash

    x = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    return x - (1 << 64) if x >> 63 else x


class Tree:
    """Importances of one host's paths; what it has not seen on PAGES pages is worth 1."""

    def __init__(self, host: int, known: dict[int, tuple[float, int]]):
        self.host, self.known = host, known

    def content(self, path: int) -> float:
        return self.known.get(path_key(self.host, path, 2), _NEW)[0]

    def presentation(self, path: int) -> tuple[float, int]:
        return self.known.get(path_key(self.host, path, 1), _NEW)


class Blind(Tree):
    """A tree that has learnt nothing: every path is worth 1.  It shows what the tree decides."""

    def __init__(self):
        super().__init__(0, {})


_NEW = (1.0, 1)
_M64 = (1 << 64) - 1


def path_key(host: int, path: int, kind: int) -> int:
    """A number for a host's path; kind 1 is the path's presentation, 2 its content."""
    x = ((path ^ (host * 0x9E3779B97F4A7C15)) * 0xBF58476D1CE4E5B9 + kind) & _M64
    return x - (1 << 64) if x >> 63 else x


STATISTICS = "host long, path long, kind int, value long, n long"


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages by path (kind 0, under either kind's number), child tag sequence (1) and block (2), summed for each batch."""
    for batch in batches:
        tally: Counter = Counter()
        for host, source in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
            page = Page(source.as_py() or "")
            own = set()
            for node in range(1, len(page.tag)):
                if not page.hard[node]:
                    style = path_key(host, page.path[node], 1)
                    own.add((host, style, 0, 0))
                    own.add((host, style, 1, stable_id(" ".join(page.children[node]))))
            for holder, _, pieces in page.blocks:
                content = path_key(host, page.path[holder], 2)
                own.add((host, content, 0, 0))
                own.add((host, content, 2, stable_id(" ".join("".join(pieces).split()))))
            own.add((host, 0, 0, 0))
            tally.update(own)
        found = [*zip(*tally, strict=True), tuple(tally.values())] if tally else ([],) * 5
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["host", "path", "kind", "value", "n"])


def importances(pages: DataFrame) -> DataFrame:
    """pages(host, html) -> host, path, importance, styles: of paths that PAGES pages hold at least; path 0 is the host itself."""
    counts = pages.mapInArrow(_statistics, STATISTICS).groupBy("host", "path", "kind", "value").agg(F.sum("n").alias("n"))
    n, log = F.col("n"), F.log(F.col("n").cast("double"))
    path = counts.groupBy("host", "path").agg(
        F.max(F.when(F.col("kind") == 0, n)).alias("pages"),
        F.sum(F.when(F.col("kind") == 1, n)).alias("styled"),
        F.sum(F.when(F.col("kind") == 1, n * log)).alias("style_log"),
        F.count(F.when(F.col("kind") == 1, 1)).alias("styles"),
        F.avg(F.when(F.col("kind") == 2, log)).alias("content_log"),
    )
    base = F.log(F.col("pages").cast("double"))
    presentation = (F.log(F.col("styled").cast("double")) - F.col("style_log") / F.col("styled")) / base
    content = 1 - F.col("content_log") / base
    return path.filter(F.col("pages") >= PAGES).select(
        "host", "path", F.coalesce(content, presentation, F.lit(1.0)).alias("importance"), F.greatest("styles", F.lit(1)).cast("int").alias("styles")
    )


def _extracted(hosts: list[int], sources: pa.Array, known: dict, use_tree: bool, names: bool) -> list[str]:
    out = []
    for host, source in zip(hosts, sources, strict=True):
        tree = Tree(host, known) if path_key(host, 0, 0) in known else None
        out.append(Page(source.as_py() or "", names).text(tree if use_tree or tree is None else Blind()))
    return out


def _known(paths: pa.Table) -> dict[int, tuple[float, int]]:
    """Importances by path; that a host has a tree stands under its own key."""
    rows = [paths[c].to_pylist() for c in ("host", "path", "importance", "styles")]
    return {path if path else path_key(host, 0, 0): (importance, styles) for host, path, importance, styles in zip(*rows, strict=True)}


def _texts(known, use_tree: bool, names: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _extracted(batch.column("host").to_pylist(), batch.column("html"), known.value, use_tree, names)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def _met(use_tree: bool, names: bool):
    def run(key, pages, paths):
        out = _extracted(pages["host"].to_pylist(), pages["html"], _known(paths), use_tree, names)
        return pa.table([pages["page_id"], pages["url"], pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, use_tree: bool = True, names: bool = True) -> DataFrame:
    """pages(page_id, url, html, ...) -> page_id, url, text, n_chars.

    `use_tree` and `names` serve to show what either decides: without the first every path of a host that has a tree is
    worth 1, without the second no class or id is looked at.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark)
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
    plain = columns(pages, "page_id", "url", "html").select("page_id", "url", F.xxhash64(host).alias("host"), F.col("html").cast("string").alias("html"))
    paths = scratch.keep(importances(plain.select("host", "html")))
    types = {f.name: f.dataType.simpleString() for f in plain.schema}
    schema = f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long"
    if paths.count() <= BROADCAST_PATHS:
        known = spark.sparkContext.broadcast(_known(paths.toArrow()))
        return plain.mapInArrow(_texts(known, use_tree, names), schema)
    salts = scratch.keep(plain.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / HOST_PAGES).cast("int").alias("salts")))
    spread = paths.join(salts, "host").select("*", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    dealt = plain.join(salts, "host").withColumn("salt", F.pmod(F.xxhash64("page_id", "html"), F.col("salts")).cast("int")).drop("salts")
    return dealt.groupBy("host", "salt").cogroup(spread.drop("salts").groupBy("host", "salt")).applyInArrow(_met(use_tree, names), schema)
