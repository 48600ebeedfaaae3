"""Main text of HTML pages by tag-path ratios.

Every text node has a path of tags from the root (class and id names count as part of a tag). Over a
page, text length and punctuation are added up by path and divided by the path's nodes; both ratios
are smoothed along the order in which paths appear and fused into one score; paths that score at
least the standard deviation of all scores are content. All paths take part, those of menus and
footers too. The content's region is found from the root down: as long as one child holds ``MOST`` of
the content text, the search goes on there; an ``article`` ends it. Where no child holds that much, the
``article`` or ``main`` below with most content text is the region, if there is one. A region below the
page's body is taken whole, so its headings, lists and short paragraphs stay, with nodes elsewhere
whose path is both content and met in the region, and the headings right before; of a region
that is all of the page, content paths and the headings above them are taken.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are
never taken: they are known by their element, by a role, or by a class or id that names them as a
whole (``site-footer``, ``cookieNotice``; not ``share-price-report``). A form around an ``article``,
``main`` or ``h1``, or around all text of the page, is a wrapper and no form.

Character references are decoded; white space inside a block becomes one space; blocks are trimmed
and joined in page order by two newlines. Nothing else is dropped or cut.

Defined results: a null or empty page, and one without text, give an empty text. Pages that end in
the middle of a tag, comment or script end there. Unclosed and stray end tags are mended as browsers
do for paragraphs, lists and tables. Repeated rows, null ids and urls stay as they are. An empty
table gives an empty result. Extra columns stay; ``text`` and ``n_chars`` give way to the results.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field
from statistics import pstdev

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read_table
from .tokens import slices

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|</?[A-Za-z][^>]*(?:>|\Z)",
    re.S,
)
_LABEL = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe xmp noembed template".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: An opening tag of the key ends the nearest open element of the value, unless a scope is met first.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
SCOPES = frozenset("html body article main section div nav aside table ul ol dl form header footer select td th blockquote".split())
#: A block's opening tag ends an open paragraph.
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements, and words of class, id or role, that hold no main text.
BOILER = frozenset("nav header footer aside form menu dialog button select input label fieldset canvas svg object audio video map math".split())
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer "
    "sidebar aside complementary contentinfo cookie cookies consent gdpr notice alert popup modal overlay dialog comment comments commentlist disqus replies reply form search login signup "
    "subscribe newsletter share sharing social related recommended widget toolbar pagination pager skip".split()
)
#: Words after which the word before decides what a class or id names.
VAGUE = frozenset("left right top bottom main inner outer container wrapper wrap box block list items item links link section area region bar panel group row column col slot unit buttons button icons content body".split())
#: Words that mark a compound by coming first.
MARKS = frozenset("related recommended sponsored cookie advert gdpr".split())
#: Blocks of running text: no region lies below them.
LEAVES = frozenset("p li dt dd td th pre blockquote figcaption caption h1 h2 h3 h4 h5 h6".split())
#: Share of the content text that a child must hold for the region to lie in it.
MOST = 0.8
PUNCTUATION = re.compile(r"[.,;:!?…。、，；：！？¿¡]")


@dataclass
class Region:
    """An element that isn't inline, in page order; its descendants are those up to ``last``."""

    name: str
    parent: int
    last: int = 0
    weight: int = 0
    form: bool = False


@dataclass
class Node:
    name: str
    path: int
    boiler: bool
    forms: tuple[int, ...]
    region: int
    heading: bool


@dataclass
class Block:
    path: int
    boiler: bool
    forms: tuple[int, ...]
    region: int
    heading: bool
    parts: list[str] = field(default_factory=list)

    def text(self) -> str:
        return " ".join("".join(self.parts).split())


def _names_boilerplate(token: str) -> bool:
    """Whether a class or id names something that holds no main text."""
    parts = [x.lower() for x in _PART.findall(token)]
    if len(parts) > 1 and parts[0] in MARKS:
        return True
    while len(parts) > 1 and parts[-1] in VAGUE:
        parts.pop()
    return bool(parts) and parts[-1] in BOILER_WORDS


def _boilerplate(name: str, attrs: str) -> bool:
    if name in BOILER:
        return True
    if name in ("html", "body", "main") or "=" not in attrs:
        return False
    return any(_names_boilerplate(x) for m in _LABEL.finditer(attrs) for x in (m[2] or m[3] or m[4] or "").split())


def _label(name: str, attrs: str) -> str:
    if "=" not in attrs:
        return name
    return name + "".join(f".{m[2] or m[3] or m[4] or ''}" for m in _LABEL.finditer(attrs) if m[1].lower() != "role")


def blocks(page: str) -> tuple[list[Block], list[Region]]:
    """The page's blocks of text and its regions, in page order."""
    paths: dict[tuple[int, str], int] = {}
    regions = [Region("", -1)]
    stack = [Node("", 0, False, (), 0, False)]
    out: list[Block] = []
    current: Block | None = None
    at, end = 0, len(page)

    def text(raw: str) -> None:
        nonlocal current
        node = stack[-1]
        if not raw:
            return
        if current is None:
            if raw.isspace():
                return
            current = Block(node.path, node.boiler, node.forms, node.region, node.heading)
            out.append(current)
        current.parts.append(entities.unescape(raw) if "&" in raw else raw)

    def close(k: int) -> None:
        nonlocal current
        for n in stack[k:]:
            if n.name not in INLINE:
                current = None
                regions[n.region].last = len(regions) - 1
        del stack[k:]

    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if (name := m["name"]) is None:
            continue
        name = name.lower()
        if m["end"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    close(k)
                    break
                if name in INLINE and stack[k].name not in INLINE:
                    break  # a stray inline end tag
            continue
        attrs = m["attrs"]
        if name in RAW:
            if not attrs.rstrip().endswith("/"):
                closing = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                at = closing.end() if closing else end
            continue
        if name in VOID:
            if name == "br":
                text(" ")
            elif name == "hr":
                current = None
            continue
        ends = CLOSES.get(name, ())
        for k in range(len(stack) - 1, 0, -1):
            n = stack[k].name
            if n in ends or (n == "p" and name in ENDS_PARAGRAPH):
                close(k)
                if n == "p" or name not in ("tr", "thead", "tbody", "tfoot"):
                    break
            elif n in SCOPES:
                break
        if name not in INLINE:
            current = None
        parent = stack[-1]
        step = (parent.path, _label(name, attrs))
        path = paths.setdefault(step, len(paths) + 1)
        region, forms = parent.region, parent.forms
        if name not in INLINE:
            regions.append(Region(name, region, form=name == "form"))
            region = len(regions) - 1
        if name == "form":
            forms = (*forms, region) if len(forms) < 8 else forms
        stack.append(Node(name, path, parent.boiler or (name != "form" and _boilerplate(name, attrs)), forms, region, name in HEADINGS or parent.heading))
    close(1)
    regions[0].last = len(regions) - 1
    return out, regions


def _settle_forms(found: list[Block], regions: list[Region]) -> None:
    """Blocks of real forms become boilerplate."""
    inside: dict[int, int] = {}
    for b in found:
        for f in b.forms:
            inside[f] = inside.get(f, 0) + 1
    if not inside:
        return
    seen, holds = 0, [0]
    for r in regions:
        seen += r.name in ("article", "main", "h1")
        holds.append(seen)
    plain = sum(not b.boiler for b in found)
    held = {f: sum(not b.boiler and f in b.forms for b in found) for f in inside}
    real = {f for f in inside if held[f] < plain and holds[regions[f].last + 1] == holds[f + 1]}
    for b in found:
        b.boiler = b.boiler or not real.isdisjoint(b.forms)


def content_paths(found: list[Block]) -> set[int]:
    """Paths whose smoothed and fused ratios reach the page's threshold."""
    totals: dict[int, list[int]] = {}
    for b in found:
        words = b.text()
        t = totals.setdefault(b.path, [0, 0, 0])
        t[0] += len(words)
        t[1] += len(PUNCTUATION.findall(words))
        t[2] += 1
    order = list(totals)
    length = [totals[p][0] / totals[p][2] for p in order]
    marks = [totals[p][1] / totals[p][2] for p in order]

    def smooth(v: list[float]) -> list[float]:
        return [(v[max(i - 1, 0)] + 2 * x + v[min(i + 1, len(v) - 1)]) / 4 for i, x in enumerate(v)]

    fused = [x * (1 + y) for x, y in zip(smooth(length), smooth(marks), strict=True)]
    least = min(pstdev(fused), max(fused)) if fused else 0
    return {p for p, x in zip(order, fused, strict=True) if x >= least}


def content_region(found: list[Block], regions: list[Region], chosen: set[int]) -> int:
    """The element that holds the content."""
    for b in found:
        if b.path in chosen and not b.boiler:
            regions[b.region].weight += len(b.text())
    best: list[tuple[int, int]] = [(0, 0)] * len(regions)  # weight and number of the heaviest child
    for k in range(len(regions) - 1, 0, -1):
        r = regions[k]
        regions[r.parent].weight += r.weight
        if r.name not in LEAVES and r.weight:
            best[r.parent] = max(best[r.parent], (r.weight, -k))
    at = 0
    while regions[at].name != "article" and best[at][0] >= MOST * regions[at].weight > 0:
        at = -best[at][1]
    if regions[at].name not in ("article", "main"):
        marked = [(r.weight, -k) for k, r in enumerate(regions) if at < k <= regions[at].last and r.name in ("article", "main") and r.weight]
        at = -max(marked)[1] if marked else at
    return at


def main_text(page: str | None) -> str:
    """The page's main text; empty if there is none."""
    found, regions = blocks(page or "")
    found = [b for b in found if b.text()]
    _settle_forms(found, regions)
    chosen = content_paths(found)
    plain = [b for b in found if not b.boiler]
    if not plain:
        return ""
    if not any(b.path in chosen for b in plain):
        chosen = content_paths(plain)
    at = content_region(plain, regions, chosen)
    if regions[at].name in ("", "html", "body"):
        keep = [b.path in chosen for b in plain]
    else:
        inside = [at <= b.region <= regions[at].last for b in plain]
        met = {b.path for b, x in zip(plain, inside, strict=True) if x and b.path in chosen}
        keep = [x or b.path in met for b, x in zip(plain, inside, strict=True)]
        if regions[at].name == "article":
            return "\n\n".join(b.text() for b, k in zip(plain, keep, strict=True) if k)
    for i in range(len(plain) - 2, -1, -1):
        keep[i] = keep[i] or (plain[i].heading and keep[i + 1])
    return "\n\n".join(b.text() for b, k in zip(plain, keep, strict=True) if k)


def extract(df: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``df`` without its page column, with the main text and its code points (``n_chars``)."""
    kept = [c for c in df.columns if c not in (html_col, text_col, "n_chars")]
    schema = df.select(*[F.col(f"`{c}`") for c in kept], F.lit("").alias(text_col), F.lit(0).cast("long").alias("n_chars")).schema
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{html_col}`"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, 128):
                texts = [main_text(page) for page in part.column(len(kept)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(kept))), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=schema.names)

    return source.mapInArrow(run, schema)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
