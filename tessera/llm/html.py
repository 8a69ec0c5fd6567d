"""Main text of web pages by consensus of the pages of a host.

1. Every page scores its containers: words outside links count for each container around them,
   words of boilerplate and links against it; ``article``, ``main`` and elements named like content
   count more. Ties go to the innermost container. Boilerplate is told run by run by tag, role and name.
   Ids of headings, paragraphs and the like say nothing; a name of which only a part is suspect (or a
   section's id) must be borne out by the host's pages or by links.
2. In Spark, each page votes for the generalised path of its best container (tags with classes and
   ids, digits dropped) and names its suspect parts. A host's winning paths have at least ``MIN_VOTES`` of its
   votes; a suspect part on ``TEMPLATE_SHARE`` of its pages belongs to its template.
3. Each page is extracted again below its host's first winning path that yields text there; a page
   that has none of them keeps its own best container.

A block is what stands between block-level tags or line breaks. References are decoded, white
space becomes one space, empty blocks go, the others are joined by one newline.

Defined cases: null or empty html gives the empty text; a page without container or tags is its
plain text; a null url is the host ``''``; repeated rows are rows of their own; an empty table gives
no rows; other columns are not read. Markup that is cut off or not closed is read as far as it goes; a tag
that the page ends in is dropped. Time grows with the page's length, whatever is nested or left open; a page is held by one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tessera.llm import common

#: A path wins on a host with this share of the host's votes.
MIN_VOTES = 0.1
#: So many hosts at most are sent to every task; more are joined by a shuffle.
BROADCAST_HOSTS = 20_000
#: A suspect part is one of the host's template if this share of its pages have it, and so many pages there are.
TEMPLATE_SHARE, TEMPLATE_PAGES = 0.5, 3
#: A longer path is written as its hash.
PATH_CHARS = 512

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+(?:"[^"]*+"|'[^']*+')|[^>])*+)>""")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTR = re.compile(r"""([^\s=/>"']++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_RAW = {x: re.compile(rf"</{x}(?=[\s/>]|\Z)", re.I) for x in ("script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option optgroup p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES_P = _BLOCK - {"br", "body", "html", "head", "option", "optgroup", "button", "caption", "legend", "tbody", "td", "tfoot", "th", "thead", "tr"}
#: An opening tag ends an open element of these, up to the nearest of the last.
_SIBLINGS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
_CONTAINER = frozenset("article body div main section td center".split())
_DROP = frozenset("head nav footer aside form button select menu svg math canvas object audio video map dialog search fieldset option frameset".split())
_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
#: Names of parts that are never the article, alone or as a part of a name.
_STRONG = (
    r"advert\w*|adsense|adslot|adbox|adunit|sponsor\w*|promos?|promotions?|promoted|cookies?\w*|gdpr|popups?|newsletters?|subscribe|subscriptions?|sign-?up|"
    r"comments?\w*|disqus\w*|sidebars?|navbars?|navigation|breadcrumbs?|footers?|masthead|topbar|pagination|pager|widgets?|skip-?link"
)
#: Names that say so alone; as a part of a name they need the host's pages or links to agree.
_WEAK = r"ads?|adv|banners?|consent|notices?|notifications?|alerts?|modal|overlay|respond|repl(?:y|ies)|discussion|rail|menus?|nav|foot|share|sharing|social|related|recommend\w*|toolbar|copyright|login|search|paywall|pop-up|side-bar"
_PAIRED = (
    r"(?:related|recommended|popular|trending|latest|more)[_-]?(?:posts?|articles?|links?|stories|story|news|content|items?|reads?|reading|videos?)|search[_-]?(?:form|box|bar|field|wrapper|container|input)|"
    r"ads?[_-]?(?:slots?|box|units?|banners?|container|wrapper|wrap|label|block|space|area|zone|top|bottom|left|right|side|\d+)|(?:google|text|banner|top|side|inline|article)[_-]?ads?|"
    r"(?:share|sharing|social)[_-]?(?:buttons?|links?|icons?|bar|tools?|media|box|list|count)|(?:site|page|top|main|global|mobile|primary|secondary|footer|header)[_-]?(?:nav|menu|banner|notice|alert|search|header)|"
    r"(?:nav|menu)[_-]?(?:bar|list|items?|links?|main|top|wrapper|container)|login[_-]?(?:form|box|link)|reply[_-]?(?:form|link|list)|alert[_-]?(?:box|bar)|notice[_-]?(?:box|bar)"
)
_ALONE = re.compile(rf"(?:{_STRONG}|{_WEAK}|{_PAIRED})", re.I)
_STRONG_PART, _WEAK_PART = (re.compile(rf"(?:^|[_-])(?:{x})(?:$|[_-])", re.I) for x in (_STRONG, _WEAK))
#: Names of a state or a layout, not of a part: has-sidebar, comments-open.
_STATE = re.compile(r"(?:has|no|with|without|is|show|hide)[_-].*|.*[_-](?:with|without|has)[_-].*|.*[_-](?:open|closed|enabled|disabled|layout)", re.I)
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_IS_WHOLE = re.compile(r"(?:article|content|main|post|entry|story|text|body|page|prose)(?:[_-]?(?:body|content|text|main|inner|wrapper|container))?", re.I)
#: Elements whose id names a part of the page; elsewhere an id is the name of a heading or a place in the text.
_ID_COUNTS = frozenset("div ul ol table aside form span iframe center".split())
#: What speaks against an element: its tag or role; its names; names that others must bear out.
TAG, NAME, SUSPECT = 1, 2, 3


def _attrs(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(raw):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def _named(tag: str, classes: list[str], own: str) -> tuple[int, bool]:
    """What class and id names say against an element (0 for nothing), and whether they speak for it."""
    if tag in ("html", "body", "main"):
        return 0, True
    classes = [_HUMP.sub("-", x) for x in classes if not _STATE.fullmatch(x)]
    own = "" if _STATE.fullmatch(own) else _HUMP.sub("-", own)
    good = any(_IS_WHOLE.fullmatch(x) for x in (*classes, own)) or tag == "article"
    names, slug = list(classes), []
    if own:
        (names if tag in _ID_COUNTS and "section" not in classes else slug).append(own)
    if any(_ALONE.fullmatch(x) for x in names) or (not good and any(_STRONG_PART.search(x) for x in names)):
        return NAME, good
    if not good and any(_WEAK_PART.search(x) for x in names):
        return SUSPECT, good
    if slug and tag in ("section", "div") and (_ALONE.fullmatch(own) or _STRONG_PART.search(own)):
        return SUSPECT, good
    return 0, good


class Page:
    """The elements and blocks of one page.

    ``elements``: (parent, path, container, bonus). ``blocks``: (element, text, whether it is
    boilerplate, its characters in links), settled by :meth:`settle`.
    """

    def __init__(self, html: str, templates: frozenset[str] = frozenset()) -> None:
        self.elements: list[tuple[int, str, bool, bool]] = [(-1, "", True, False)]
        #: What speaks against text: (cause around it, kind, path, articles before it); 0 is none.
        self.causes: list[tuple[int, int, str, int]] = [(0, 0, "", 0)]
        self._ended: dict[int, int] = {}
        self._articles = 0
        self._runs: list[tuple[int, list[tuple[str, int, bool]]]] = []
        self._run: list[tuple[str, int, bool]] = []
        self._read(html)
        self.settle(templates)

    def _flush(self, at: int) -> None:
        if self._run:
            self._runs.append((at, self._run))
            self._run = []

    def _read(self, html: str) -> None:
        stack: list[tuple[str, int, int, bool, bool, bool]] = []  # tag, element, cause, in a link, in an article, in code
        blocks: list[int] = []  # places of block elements in the stack
        open_: dict[str, int] = {}
        at, cause, link, story, code, pos, n, plain = 0, 0, False, False, False, 0, len(html), False

        def pop(to: int) -> None:
            nonlocal at, cause, link, story, code
            for tag, _, own, *_ in stack[to:]:
                open_[tag] -= 1
                if own:
                    self._ended[own] = self._articles
            del stack[to:]
            while blocks and blocks[-1] >= to:
                blocks.pop()
            _, at, cause, link, story, code = stack[-1] if stack else ("", 0, 0, False, False, False)

        while pos < n:
            lt = html.find("<", pos)
            text = html[pos:] if lt < 0 else html[pos:lt]
            if text:
                self._run.append((text, cause, link))
            if lt < 0:
                break
            if html.startswith("<!--", lt):
                end = lt + 4 if html.startswith(">", lt + 4) else html.find("-->", lt + 4)
                pos = n if end < 0 else end + (1 if end == lt + 4 and html[end] == ">" else 3)
                continue
            if html.startswith(("<!", "<?"), lt):
                end = html.find(">", lt)
                pos = n if end < 0 else end + 1
                continue
            m = None if plain else _TAG.match(html, lt)
            if m is None:
                m = _PLAIN_TAG.match(html, lt)
                if m is None and html[lt + 1 : lt + 3].lstrip("/")[:1].isalpha():
                    break  # a tag that the page ends in
                if m is None:
                    self._run.append(("<", cause, link))
                    pos = lt + 1
                    continue
                plain = True  # a quote is open to the end: from here on a tag ends at the next >
            pos = m.end()
            tag = m[2].lower()
            block = tag in _BLOCK
            if m[1]:
                if not open_.get(tag):
                    if tag == "p":
                        self._flush(at)
                    continue
                places = blocks if block else range(len(stack))
                i = next(i for i in reversed(places) if stack[i][0] == tag)
                if block or (blocks and blocks[-1] >= i):
                    self._flush(at)
                pop(i)
                continue
            if block:
                self._flush(at)
            if tag in _CLOSES_P or tag in _SIBLINGS:
                ends, until = _SIBLINGS.get(tag, (("p",), ("div", "article", "section", "td", "li", "blockquote", "body")))
                if any(open_.get(x) for x in ends):
                    for i in reversed(blocks.copy() if tag == "tr" else blocks):
                        if stack[i][0] in ends:
                            pop(i)
                            if tag != "tr":
                                break
                        elif stack[i][0] in until:
                            break
            if tag in _RAW:
                end = _RAW[tag].search(html, pos)
                close = html.find(">", end.end()) if end else -1
                pos = n if close < 0 else close + 1
                continue
            if tag in _VOID:
                continue
            attrs = _attrs(m[3]) if m[3].strip(" /\n\t\r\f") else {}
            classes = attrs.get("class", "").split()
            against, good = _named(tag, classes, attrs.get("id", "").strip()) if classes or attrs.get("id") else (0, tag in ("article", "main"))
            if tag == "body":
                good = False
            hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()
            header = tag == "header" or any(x.lower() in ("header", "headers") for x in classes)
            if hidden or tag in _DROP or attrs.get("role", "").lower() in _ROLES or (header and not story):
                against = TAG
            elif code:
                against = 0  # names within code are those of its highlighting
            if block:
                step = tag + "".join("." + x for x in sorted({re.sub(r"\d+", "", x) for x in classes})) + ("#" + re.sub(r"\d+", "", attrs["id"]) if attrs.get("id") else "")
                path = f"{self.elements[at][1]}>{step}"
                if len(path) > PATH_CHARS:  # as good as the path itself, and bounded
                    path = f"#{xxhash.xxh64_hexdigest(path)}"
                self.elements.append((at, path, tag in _CONTAINER, good))
                at = len(self.elements) - 1
            if against:
                self.causes.append((cause, against, self.elements[at][1] if block else "", self._articles))
                cause = len(self.causes) - 1
            elif tag in ("article", "main"):
                self._articles += 1
            link, story, code = link or tag == "a", story or tag in ("article", "main"), code or tag in ("pre", "code")
            if block:
                blocks.append(len(stack))
            stack.append((tag, at, cause, link, story, code))
            open_[tag] = open_.get(tag, 0) + 1
        self._flush(at)
        pop(0)

    def settle(self, templates: frozenset[str]) -> None:
        """Decide what is boilerplate, and make the blocks.

        A name does not count against an element that holds all of the page's articles, and no name counts
        if nothing would be left. What is suspect goes if the host's pages share it or if most of it is links.
        """
        size, linked = [0] * len(self.causes), [0] * len(self.causes)
        for _, run in self._runs:
            for text, cause, link in run:
                if cause:
                    size[cause] += (own := len(text.strip()))
                    linked[cause] += own * link
        for i in range(len(self.causes) - 1, 0, -1):
            size[self.causes[i][0]] += size[i]
            linked[self.causes[i][0]] += linked[i]

        def gone(names: bool) -> list[bool]:
            out = [False]
            for i, (up, kind, path, before) in enumerate(self.causes[1:], 1):
                inside = self._ended.get(i, self._articles) - before
                around = self._articles > 0 and inside == self._articles
                own = kind == TAG or (names and not around and (kind == NAME or path in templates or 2 * linked[i] > size[i]))
                out.append(own or out[up])
            return out

        for names in (True, False):
            dropped = gone(names)
            self.blocks: list[tuple[int, str, bool, int]] = []
            for at, run in self._runs:
                for bad in (False, True):
                    raw = "".join(text for text, cause, _ in run if dropped[cause] == bad)
                    if text := " ".join((unescape(raw) if "&" in raw else raw).split()):
                        in_links = sum(len(x) for x, cause, link in run if link and dropped[cause] == bad)
                        self.blocks.append((at, text, bad, min(in_links, len(text))))
            if any(not bad for _, _, bad, _ in self.blocks):
                break

    def suspects(self) -> set[str]:
        """The paths that the host's pages may bear out."""
        return {path for _, kind, path, _ in self.causes if kind == SUSPECT and path}

    def best(self) -> tuple[int, float]:
        """The container with the highest score."""
        score = [0.0] * len(self.elements)
        for at, text, bad, linked in self.blocks:
            score[at] += -len(text) if bad else len(text) - 2 * linked
        for i in range(len(score) - 1, 0, -1):
            score[self.elements[i][0]] += score[i]
        top, most = 0, float("-inf")
        for i, (_, _, container, good) in enumerate(self.elements):
            if container and (value := score[i] * (1.5 if good and score[i] > 0 else 1)) >= most:
                top, most = i, value
        return top, most

    def text(self, roots: set[int]) -> str:
        """The kept blocks below the given elements, in page order."""
        inside = [False] * len(self.elements)
        for i, (parent, *_) in enumerate(self.elements):
            inside[i] = i in roots or (parent >= 0 and inside[parent])
        return "\n".join(text for at, text, bad, _ in self.blocks if inside[at] and not bad)

    def extract(self, paths: list[str]) -> tuple[str, str]:
        """The text below the first path that has some, and that path; else of the best container."""
        for path in paths:
            roots = {i for i, x in enumerate(self.elements) if x[1] == path}
            if roots and (text := self.text(roots)):
                return text, path
        top, _ = self.best()
        return self.text({top}), self.elements[top][1]


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, kind, path, votes, score: of pages (path empty), of best containers, of suspect parts."""
    for batch in batches:
        tally: dict[tuple[str, str, str], list[float]] = {}

        def add(host: str, kind: str, path: str, score: float = 0.0, tally=tally) -> None:
            entry = tally.setdefault((host, kind, path), [0, 0.0])
            entry[0] += 1
            entry[1] += score

        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            page = Page(html)
            add(host, "page", "")
            top, score = page.best()
            if page.blocks and score > 0:
                add(host, "best", page.elements[top][1], score)
            for path in page.suspects():
                add(host, "suspect", path)
        yield pa.RecordBatch.from_arrays(
            [*(pa.array([k[i] for k in tally], pa.string()) for i in range(3)), pa.array([int(v[0]) for v in tally.values()], pa.int64()), pa.array([float(v[1]) for v in tally.values()], pa.float64())],
            names=["host", "kind", "path", "votes", "score"],
        )


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("html", "paths", "templates"))
        found = [Page(html, frozenset(templates or ())).extract(paths or []) for html, paths, templates in zip(*columns, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string())],
            names=["page_id", "url", "text", "path"],
        )


def consensus(pages: DataFrame) -> DataFrame:
    """host, paths (the winning ones, most votes first), templates (suspect parts that its pages share). ``pages`` has host and html."""
    tally = pages.select("host", "html").mapInArrow(common.small(_votes, "html"), "host string, kind string, path string, votes long, score double")
    tally = tally.groupBy("host", "kind", "path").agg(F.sum("votes").alias("votes"), F.sum("score").alias("score"))
    kind, of_all = W.partitionBy("host", "kind"), W.partitionBy("host")
    tally = tally.withColumn("all", F.sum("votes").over(kind)).withColumn("pages", F.max(F.when(F.col("kind") == "page", F.col("votes"))).over(of_all))
    wins = (F.col("kind") == "best") & (F.col("votes") >= MIN_VOTES * F.col("all"))
    shared = (F.col("kind") == "suspect") & (F.col("pages") >= TEMPLATE_PAGES) & (F.col("votes") >= TEMPLATE_SHARE * F.col("pages"))
    entry = F.struct((-F.col("votes")).alias("v"), (-F.round("score", 3)).alias("s"), "path")
    lists = tally.where(wins | shared).groupBy("host").agg(F.sort_array(F.collect_list(F.when(wins, entry))).alias("o"), F.sort_array(F.collect_list(F.when(shared, F.col("path")))).alias("templates"))
    return lists.select("host", F.col("o.path").alias("paths"), "templates")


def extract_pages(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text and the path that it was taken from."""
    scratch = common.Scratch(pages.sparkSession, "html")
    host = F.lower(F.regexp_extract(common.as_text(url), r"^[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col(page).alias("page_id"), F.col(url).alias("url"), host.alias("host"), common.as_text(html).alias("html"))
    paths = scratch.put(consensus(rows), "paths")
    few = paths.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    joined = rows.join(F.broadcast(paths) if few else paths, "host", "left").select("page_id", "url", "html", "paths", "templates")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return joined.mapInArrow(common.small(_extract, "html"), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, path string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(common.documents(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
