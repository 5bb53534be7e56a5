"""Operator 11: the main text of web pages by ratios of tag paths.

A page is cut into blocks of text, each below the path of tags (with their classes)
from the root. For each path of a page, text length and punctuation are aggregated
over its blocks; both ratios are smoothed along the page and fused, and paths whose
fused value passes a share of the standard deviation are content paths. The smallest
element around the content paths is the article; its blocks stay, but for lists of
links. Elements that are no article by their name, role or class (menus, forms,
comments and the like) are left out before ratios are made.

A page is a unit of its own: no shuffle, and a batch holds a bounded number of bytes.
"""

import html
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded, lean, limit_batches

_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style textarea title noscript iframe noembed noframes xmp template svg math object select canvas audio video".split())
#: Tags within a block: their text belongs to the block, and they are no part of a path.
_INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
_SECTION = set("article main section div td th table tbody thead tfoot tr center body html fieldset li ul ol dl dd".split())
_NO_ARTICLE = set("nav footer aside form menu dialog button head".split())
_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Words of class or id that name no part of an article.
_NO_ARTICLE_WORDS = set(
    """ad ads adv advert adverts advertisement advertisements adsense adslot adbox sponsor sponsored sponsors promo promoted promotion banner menu menus nav navbar
    navigation breadcrumb breadcrumbs crumbs sidebar sidebars aside rail footer foot colophon masthead topbar comment comments commentlist discussion disqus respond reply
    replies feedback cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay newsletter subscribe subscription signup login
    share sharing social related recommended recommendations widget widgets toolbar pagination pager paginator skip copyright disclaimer search searchbox paywall""".split()
)
#: As above, but only outside an article element.
_PAGE_HEADER_WORDS = {"header", "head", "top", "logo", "branding"}
_CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"},
}
#: An implied end looks no further up than these.
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
_TAG = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s=/\"'>]++)\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、؟،।]")
_HEADINGS = {"h1", "h2"}


@dataclass
class Element:
    tag: str
    path: str
    up: "Element | None"
    dropped: bool = False
    in_article: bool = False
    words: tuple = ()
    children: list = field(default_factory=list)


@dataclass
class Part:
    """A block of text below its element; how many letters and digits it has, and how many of them in links."""

    above: Element
    text: str
    letters: int = 0
    linked: int = 0


def _dropped(tag: str, attrs: dict, words: tuple, up: Element) -> bool:
    if tag in _NO_ARTICLE or attrs.get("role", "").strip().lower() in _ROLES or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I):
        return True
    if tag == "header":
        return not up.in_article
    if tag in ("html", "body", "article", "main") and not {"comment", "comments", "ad", "advert", "sponsored"} & set(words):
        return False
    for k, word in enumerate(words):  # "with-sidebar" says something of a page's layout
        if k and words[k - 1] in ("has", "with", "no", "without", "main", "pre", "non"):
            continue
        if word in _NO_ARTICLE_WORDS or word in _PAGE_HEADER_WORDS and not up.in_article and tag not in ("h1", "h2", "h3", "p"):
            return True
    return False


def _attributes(text: str) -> dict:
    out: dict = {}
    for name, double, single, bare in _ATTR.findall(text):
        out.setdefault(name.lower(), html.unescape(double or single or bare))
    return out


def _letters(text: str) -> int:
    return sum(map(str.isalnum, text))


def blocks(page: str) -> list[Part]:
    """The blocks of a page in their order, those of left-out elements not among them."""
    root = Element("", "", None)
    top, out, text, linked, in_link, breaks = root, [], [], 0, False, 0

    def close() -> None:
        nonlocal text, linked, breaks
        if text:
            whole = " ".join("".join(text).split())
            if whole and not top.dropped:
                out.append(Part(top, whole, _letters(whole), linked))
        text, linked, breaks = [], 0, 0

    def add(raw: str) -> None:
        nonlocal linked, breaks
        if raw and not top.dropped:
            known = html.unescape(raw)
            text.append(known)
            if not known.isspace():
                breaks = 0
                linked += _letters(known) if in_link else 0

    at, end = 0, len(page)
    while at < end:
        open_at = page.find("<", at)
        if open_at < 0:
            add(page[at:])
            break
        add(page[at:open_at])
        match = _TAG.match(page, open_at)
        if not match:
            add("<")
            at = open_at + 1
            continue
        at = match.end()
        name = match["name"]
        if name is None:
            if match["cdata"]:
                add(match["cdata"])
            continue
        name = name.lower()
        if match["end"]:
            if name == "a":
                in_link = False
            elif name == "br":
                text.append(" ")
            elif name == "p" or name not in _INLINE:
                above = top
                while above is not root and above.tag != name:
                    above = above.up
                if above is not root:
                    close()
                    top, in_link = above.up, False
            continue
        if name == "br":
            breaks += 1
            if breaks > 1:
                close()
            else:
                text.append(" ")
            continue
        if name == "a":
            in_link = True
        if name in _INLINE:
            continue
        if name in _VOID:
            if name == "hr":
                close()
            elif name in ("img", "input"):
                text.append(" ")
            continue
        if name in _RAW:
            if name in ("title", "textarea", "select", "noscript", "iframe", "template"):
                close()
            last = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*+(?:>|\Z)", re.I).search(page, at)
            at = last.end() if last else end
            continue
        close()
        if name in _CLOSED_BY:
            above, found = top, None
            while above is not root and above.tag not in _SCOPE.get(name, ()):
                if above.tag in _CLOSED_BY[name]:
                    found = above
                above = above.up
            top = found.up if found else top
        if name == "body":
            while top.tag == "head":
                top = top.up
        above = top
        while above is not root and above.tag not in _SECTION and above.tag not in ("blockquote", "header") and above.tag not in _NO_ARTICLE:
            if above.tag == "p":  # a block ends an open paragraph
                top, in_link = above.up, False
                break
            above = above.up
        attrs = _attributes(match["attrs"])
        words = tuple(w.lower() for w in _WORDS.findall(f"{attrs.get('class', '')} {attrs.get('id', '')}"))
        # numbers of some length count blocks of one kind, short ones tell kinds apart
        names = re.sub(r"\d{3,}", "", f"{attrs.get('class', '')} {attrs.get('id', '')}").lower().split()
        element = Element(name, f"{top.path}/{name}{''.join('.' + n for n in names)}", top, words=words)
        element.dropped = top.dropped or _dropped(name, attrs, words, top)
        element.in_article = top.in_article or name in ("article", "main")
        top = element
    close()
    return out


def fused_ratios(parts: list[Part]) -> dict[str, float]:
    """For each path: text a block times punctuation a block, both smoothed along the page."""
    paths = [p.above.path for p in parts]
    places: dict[str, int] = {}
    of = np.array([places.setdefault(p, len(places)) for p in paths])
    count = np.bincount(of)
    own = np.array([len(p.text) - p.linked for p in parts], float)
    marks = np.array([len(_PUNCTUATION.findall(p.text)) for p in parts], float)
    fused = np.ones(len(count))
    for values in (own, marks):
        row = (np.bincount(of, values) / count)[of]
        padded = np.pad(row, 1, mode="edge")
        smooth = 0.25 * padded[:-2] + 0.5 * row + 0.25 * padded[2:]
        fused *= np.bincount(of, smooth) / count
    return dict(zip(places, fused.tolist()))


def _lineage(e: Element) -> list[Element]:
    out = []
    while e is not None:
        out.append(e)
        e = e.up
    return out[::-1]


def main_parts(parts: list[Part], share: float = 0.5) -> list[Part]:
    """Blocks of the article: those around the content paths."""
    if not parts:
        return []
    fused = fused_ratios(parts)
    bar = share * float(np.std([fused[p.above.path] for p in parts]))
    content = [p for p in parts if fused[p.above.path] > 0 and fused[p.above.path] >= bar]
    weight = lambda p: (len(p.text) - p.linked)
    named = {}
    for p in parts:  # elements that a page itself calls its article
        found = [e for e in _lineage(p.above) if e.tag == "article"] or [e for e in _lineage(p.above) if e.tag == "main"]
        if found:
            named.setdefault(id(found[0]), (found[0], []))[1].append(p)
    if named:
        mass = {k: sum(weight(p) for p in own) for k, (_, own) in named.items()}
        most = max(mass.values())
        chosen = [p for k, (_, those) in named.items() if 2 * mass[k] >= most for p in those]
        own = {id(p) for p in chosen}
        outside = sum(weight(p) for p in content if id(p) not in own)
        if outside <= 4 * max(most, 1):
            return _without_links(chosen, fused, bar)
    if not content:
        return [p for p in parts if 2 * p.linked <= p.letters]
    common = _lineage(content[0].above)
    for p in content:
        own = _lineage(p.above)
        common = [a for a, b in zip(common, own) if a is b]
    centre = common[-1]
    while centre.tag not in _SECTION and centre.up is not None and centre.tag != "":
        centre = centre.up
    while True:  # one kind of section that holds most of the text, among others that are sections too
        depth, groups = len(_lineage(centre)), {}
        for p in content:
            own = _lineage(p.above)
            child = own[depth] if len(own) > depth else None
            groups.setdefault(child.path if child else "", []).append((child, p))
        if len(groups) < 2 or any(child is None or child.tag not in _SECTION for g in groups.values() for child, _ in g):
            break
        masses = {k: sum(weight(p) for _, p in g) for k, g in groups.items()}
        best = max(masses, key=masses.get)
        kids = {id(c): c for c, _ in groups[best]}
        if masses[best] < 0.6 * sum(masses.values()) or len(kids) > 1:
            break
        centre = next(iter(kids.values()))
        content = [p for _, p in groups[best]]
    inside = [k for k, p in enumerate(parts) if any(e is centre for e in _lineage(p.above))]
    first = inside[0]
    while first and parts[first - 1].above.tag in _HEADINGS:  # the title may stand before the article's element
        first -= 1
    return _without_links([parts[k] for k in sorted({*range(first, inside[0]), *inside})], fused, bar)


def _without_links(parts: list[Part], fused: dict[str, float], bar: float) -> list[Part]:
    """Without blocks of lists and divisions that are all links, on paths that aren't content."""
    return [p for p in parts if not (p.linked >= 0.9 * p.letters and p.above.tag in ("li", "div", "td", "ul", "nav", "section") and fused[p.above.path] <= bar)]


def main_text(page: str | None) -> str:
    return "\n".join(p.text for p in main_parts(blocks(page or "")))


def html_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for each row of pages: the article's blocks in page order, joined by line breaks.

    A null or empty page, or one without text, gives an empty text; repeated pages give
    repeated rows. Broken markup (open elements, open quotes, a page that ends anywhere)
    is read as browsers do, nearly. White space inside a block becomes one space, a
    single <br> too; two in a row end a block. Nothing else of the article is left out
    or shortened, however long.
    """
    limit_batches(pages.sparkSession)
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))

    def run(batches):
        for batch in batches:
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(lean(bounded(run, rows=512, size=4 << 20)), "page_id long, url string, text string, n_chars long")
