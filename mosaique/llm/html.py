"""Main text of web pages by consensus of their host.

1. Each page is parsed into elements and blocks of text; every container is scored by the text of its own
   blocks, less their link text. The best container is widened to the article or main around it, or else as far
   as the containers above it add text that isn't mostly links. Its generalised path (tags and classes, digits
   folded, from the body down) is the page's vote.
2. Spark sums the votes per (host, path), after each task has summed its own, and keeps the winner per host.
3. Each page is extracted again from the element at its host's winning path; a page without such an element
   uses its own best container.

Menus, forms, scripts, styles, notices, adverts, shares and reader comments are left out by tag, role, class and id. While
a container is looked for, a name says so by its last word that isn't one for place or shape (`cookie-banner`, not
`social-science`); inside the chosen container, as inside every article and main, only by all of its words (`related-articles`,
not `price-share`). Headings stay there, and so does a header with a heading that is the container's own: it has no
menu, is not mostly links, is not named as the site's, and no heading of its rank follows outside it.
A form that holds an article, main or most of the page's text is not left out. Tags are read as browsers read them:
quotes count only behind an equals sign, and an unfinished tag ends the page. Character references are decoded once;
white space inside a block becomes one space; blocks are joined in page order by one space. Time and memory grow
with the length of a page, however deep or broken it is.

Cases: null or empty html gives the empty text, html without any element is plain text, a null or odd url
belongs to the host "", repeated rows each get a row, an empty table gives an empty result, other columns
are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from mosaique.llm.common import BROADCAST_ROWS, join_sized
from mosaique.session import materialize

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: The rest of a start tag. Possessive, so that a broken tag is read once.
_REST = re.compile(r"""((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')|["'=])*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?""")
_COMMENT_END = re.compile(r"--!?>")
_ASKED = ("class", "id", "role", "hidden", "aria-hidden", "style")
_ANY_ASKED = re.compile("class|id|role|hidden|style", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Numbers and sizes (300x250) in names say nothing.
_NUMBERS = re.compile(r"[0-9]+(?:x[0-9]+)*")
_WORDS = re.compile(r"[^a-z]+")
#: Elements whose content is no markup; it is skipped up to their end tag.
RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in ("script", "style", "textarea", "title", "iframe", "xmp", "noembed", "noframes")}
_DIGITS = re.compile(r"\d+")
_SPACE = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article aside body center div details fieldset figure footer form header html main nav section table tbody td tr ul ol dl".split())
LEFT_OUT = frozenset("nav footer aside button dialog menu label input head noscript template object select option datalist canvas audio video desc metadata annotation annotation-xml".split())
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar alertdialog".split())
#: A class or id with one of these words marks what isn't the article.
LEFT_OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox banner banners breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright "
    "disqus footer gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion "
    "related remark replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription tagcloud toolbar topbar widget widgets".split()
)
#: Words for the place or shape of an element. Inside an article every word of a name must be one of these or one of the above.
PLACE_WORDS = frozenset(
    "area areas articles bar bars block blocks body bottom box boxes button buttons center col column container content count desktop facebook fb first fixed form full global group icon icons inline inner item "
    "items label last left link links list main message messages mobile module outer panel placeholder post posts primary reader readers right row secondary section site slot sticky stories text thread top unit "
    "user users wide wrap wrapper zone".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 header hgroup".split())
RANKS = {f"h{k}": k for k in range(1, 7)}
#: Words that, beside it, make a header one of the site.
SITE_WORDS = frozenset("site page global main top web app blog fixed sticky mobile desktop".split())
#: Words that mark a section of reader comments also as the id of an element that isn't a div.
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies reply respond".split())
#: Words that say nothing of a paragraph: it may quote, or be a remark of the author.
PARAGRAPH_WORDS = frozenset("comment comments notice remark reply header".split())
#: An open element that the start of one of these ends.
CLOSED_BY = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
STOPS = frozenset("table ul ol dl div section article body main".split())
CLOSES_P = BLOCKS - {"br", "body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option"}


@dataclass(slots=True)
class Element:
    tag: str
    parent: int
    #: Its part of the path, empty unless it is a container; a hash of the whole path; and the nearest container, itself included.
    step: str
    key: int
    holder: int
    #: Left out by its own tag and names, as they are judged outside and inside an article; and itself or something above it, outside.
    outer: bool
    inner: bool
    left_out: bool
    in_article: bool
    #: A header that stays only if its heading is the container's.
    header: bool = False
    score: float = 0.0


@dataclass(slots=True)
class Page:
    elements: list[Element] = field(default_factory=list)
    #: (element, raw text, inside a link) or (element, None, False) where a block ends
    parts: list[tuple[int, str | None, bool]] = field(default_factory=list)


def path_of(page: Page, at: int) -> str:
    """The generalised path of an element: the steps of the containers from the body down."""
    steps = []
    while at > 0:
        steps.append(page.elements[at].step)
        at = page.elements[at].parent
    return "".join(reversed(steps))


def _path_key(path: str) -> int:
    key = 0
    for step in path.split(">")[1:]:
        key = hash((key, ">" + step))
    return key


def _marked(tag: str, name: str, value: str) -> tuple[bool, bool, bool]:
    """Whether a class or id says that the element isn't part of an article, as read outside and inside one; and whether it is a plain header."""
    outer = inner = header = False
    for word in value.split():
        parts = [p for p in _WORDS.split(_CAMEL.sub("-", _NUMBERS.sub("-", word)).lower()) if p]
        listed = LEFT_OUT_WORDS.intersection(parts)
        if not listed or tag == "p" and listed <= PARAGRAPH_WORDS:
            continue
        if "header" in listed:
            if len(parts) == 1:
                header = True
                continue
            if SITE_WORDS.isdisjoint(parts):
                listed -= {"header"}
                parts = [p for p in parts if p != "header"]
        last = next((p for p in reversed(parts) if p not in PLACE_WORDS), "")
        outer |= last in LEFT_OUT_WORDS
        whole = bool(listed) and LEFT_OUT_WORDS.issuperset(p for p in parts if p not in PLACE_WORDS)
        inner |= whole and (name == "class" or tag == "div" or not listed.isdisjoint(COMMENT_WORDS))
    return outer, inner, header


def _is_left_out(tag: str, attributes: str) -> tuple[bool, bool, bool, str]:
    """Whether the element isn't part of an article, as read outside and inside one, whether it is a header, and its classes for the path."""
    if tag in LEFT_OUT:
        return True, True, False, ""
    classes, outer, inner, header = "", False, False, tag == "header"
    if attributes and _ANY_ASKED.search(attributes):
        seen: set[str] = set()
        for name, *values in _ATTRIBUTE.findall(attributes):
            name = name.lower()
            if name not in _ASKED or name in seen:
                continue
            seen.add(name)
            value = "".join(values)
            low = value.strip().lower()
            hidden = False
            if name == "role":
                hidden = low in LEFT_OUT_ROLES
            elif name == "hidden" or name == "aria-hidden" and low == "true":
                hidden = True
            elif name == "style":
                hidden = "display:none" in low.replace(" ", "")
            else:
                if name == "class":
                    classes = "".join(f".{c}" for c in sorted({_DIGITS.sub("#", c).replace(">", "_") for c in value.lower().split()}))
                if tag not in ("body", "html", "article", "main"):
                    out, within, plain = _marked(tag, name, value)
                    outer |= out
                    header |= plain
                    inner |= within and (tag not in HEADINGS or tag == "header")
            outer |= hidden
            inner |= hidden
    return outer, inner, header, classes


def _tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("start", tag, attributes) and ("end", tag, "") in order; each character is looked at a bounded number of times."""
    at, n = 0, len(html)
    while at < n:
        less = html.find("<", at)
        if less != at:
            yield "text", html[at : less if less >= 0 else n], ""
            if less < 0:
                return
        follows = html[less + 1 : less + 2]
        name = _NAME.match(html, less + 1) or (_NAME.match(html, less + 2) if follows == "/" else None)
        if name and follows != "/":
            rest = _REST.match(html, name.end())
            if not rest:
                return
            tag, at = name[0].lower(), rest.end()
            yield "start", tag, rest[1]
            if tag in RAW:
                end = RAW[tag].search(html, at)
                if not end:
                    return
                at = end.start()
        elif name or follows and follows in "/!?":
            if html.startswith("<!--", less):
                short = next((x for x in (">", "->") if html.startswith(x, less + 4)), None)
                end = None if short else _COMMENT_END.search(html, less + 4)
                at = less + 4 + len(short) if short else end.end() if end else n
                continue
            end = html.find(">", less)
            if end < 0:
                return
            at = end + 1
            if name:
                yield "end", name[0].lower(), ""
        else:
            yield "text", "<", ""
            at = less + 1


def parse(html: str) -> Page:
    page = Page([Element("#root", -1, "", 0, 0, False, False, False, False)])
    elements, parts, stack, links = page.elements, page.parts, [0], 0
    forms: list[int] = []
    headers = False
    open_: Counter = Counter()

    def close_to(k: int) -> None:
        nonlocal links
        while len(stack) > k:
            gone = elements[stack.pop()]
            open_[gone.tag] -= 1
            links -= gone.tag == "a"
            if gone.tag in BLOCKS:
                parts.append((stack[-1], None, False))

    for kind, tag, attributes in _tokens(html):
        if kind == "text":
            parts.append((stack[-1], tag, links > 0))
            continue
        if kind == "end":
            if open_[tag] > 0:
                for k in range(len(stack) - 1, 0, -1):
                    if elements[stack[k]].tag == tag:
                        close_to(k)
                        break
            continue
        if tag in RAW:
            continue
        if tag in CLOSED_BY or open_["p"] > 0 and tag in CLOSES_P:
            ends = CLOSED_BY.get(tag, frozenset())
            if open_["p"] > 0 or any(open_[x] > 0 for x in ends):
                for k in range(len(stack) - 1, 0, -1):
                    open_tag = elements[stack[k]].tag
                    if open_tag in ends or open_tag == "p" and tag in CLOSES_P:
                        close_to(k)
                        break
                    if open_tag in STOPS:
                        break
        if tag in VOID:
            if tag in BLOCKS:
                parts.append((stack[-1], None, False))
            continue
        above = elements[stack[-1]]
        outer, inner, header, classes = _is_left_out(tag, attributes)
        if above.in_article:
            # Headers and headings of an article are its own.
            inner, header = inner and tag != "header", False
            outer = inner
        headers |= header
        me, step = len(elements), f">{tag}{classes}" if tag in CONTAINERS and tag not in ("html", "tbody") else ""
        if tag in BLOCKS:
            parts.append((stack[-1], None, False))
        elements.append(Element(tag, stack[-1], step, hash((above.key, step)) if step else above.key, me if tag in CONTAINERS else above.holder, outer, inner, above.left_out or outer, above.in_article or tag in ("article", "main"), header))
        if tag == "form" and not elements[-1].left_out:
            forms.append(me)
        if not attributes.endswith("/") or tag not in ("a", "b", "i", "span"):
            stack.append(me)
            open_[tag] += 1
            links += tag == "a"
    close_to(1)
    if headers:
        _judge_headers(page)
    if forms:
        _leave_out_forms(page, forms)
    return page


def _inherit(elements: list[Element], first: int = 1) -> None:
    for e in elements[first:]:
        e.left_out = e.outer or elements[e.parent].left_out


def _judge_headers(page: Page) -> None:
    """Leave out headers, but for those whose heading is the one of the container around them."""
    elements = page.elements
    n = len(elements)
    text, links = _totals(page)
    menu = [False] * n
    #: How many headings of each rank each element holds, as six numbers of 32 bits in one.
    ranks = [0] * n
    for k in range(n - 1, 0, -1):
        e = elements[k]
        menu[k] |= e.tag in ("nav", "menu", "form")
        if e.tag in RANKS and not e.left_out:
            ranks[k] += 1 << 32 * (RANKS[e.tag] - 1)
        menu[e.parent] |= menu[k]
        ranks[e.parent] += ranks[k]
    for k, e in enumerate(elements):
        if not e.header:
            continue
        around = elements[e.parent]
        rank = next((r for r in range(6) if ranks[k] >> 32 * r & 0xFFFFFFFF), None)
        higher = (1 << 32 * ((rank or 0) + 1)) - 1
        stays = rank is not None and around.holder > 0 and elements[around.holder].tag not in ("body", "html")
        if not stays or menu[k] or 2 * links[k] > text[k] + links[k] or ranks[around.holder] & higher != ranks[k] & higher:
            e.outer = e.inner = True
    _inherit(elements)


def _leave_out_forms(page: Page, forms: list[int]) -> None:
    """Leave out forms, but for those that hold an article or main, or most of the page's text."""
    elements, kept = page.elements, set()
    for k, e in enumerate(elements):
        if e.tag in ("article", "main") and not e.left_out:
            up = e.parent
            while up > 0 and up not in kept:
                kept.add(up)
                up = elements[up].parent
    text, links = _totals(page)
    for k in forms:
        elements[k].outer = elements[k].inner = k not in kept and 2 * (text[k] + links[k]) <= text[0] + links[0]
    _inherit(elements, min(forms))


def _totals(page: Page) -> tuple[list[int], list[int]]:
    """The length of the text under each element, without what is left out: (outside links, inside links)."""
    text, links = [0] * len(page.elements), [0] * len(page.elements)
    for at, part, link in page.parts:
        if part and not page.elements[at].left_out:
            (links if link else text)[at] += len(part.strip())
    for k in range(len(page.elements) - 1, 0, -1):
        up = page.elements[k].parent
        text[up] += text[k]
        links[up] += links[k]
    return text, links


def _climbed(page: Page, at: int) -> int:
    """The nearest article or main around a container; without one, the last container above that adds text, not mostly links."""
    elements, k = page.elements, at
    while k > 0:
        if elements[k].tag in ("article", "main"):
            return k
        k = elements[k].parent
    (text, links), k = _totals(page), at
    while k > 0:
        k = elements[elements[k].parent].holder
        more, linked = text[k] - text[at], links[k] - links[at]
        if linked and linked >= more:
            break
        if more:
            at = k
    return at


def best_container(page: Page) -> int:
    """The container with the highest score, its own blocks in full, those one and two levels down less; and up to the whole article."""
    elements = page.elements
    gained: Counter = Counter()
    for at, text, link in page.parts:
        if text and not elements[at].left_out:
            n = len(text.strip())
            gained[at] += -n if link else n
    for at, n in gained.items():
        share, holder = 1.0, elements[at].holder
        if elements[holder].tag in ("article", "main"):
            share = 1.25
        for _ in range(3):
            elements[holder].score += share * n
            if holder <= 0:
                break
            holder, share = elements[elements[holder].parent].holder, share / 2
    best = max((k for k, e in enumerate(elements) if e.score > 0 and not e.left_out), key=lambda k: (elements[k].score, -k), default=0)
    return _climbed(page, best)


def text_of(page: Page, roots: set[int]) -> str:
    """The text under the given elements, without what is left out: as inside an article, unless the element is the whole page."""
    elements, inside, whole = page.elements, [False] * len(page.elements), [False] * len(page.elements)
    for k, e in enumerate(elements):
        if k in roots:
            inside[k], whole[k] = True, k == 0 or e.tag in ("body", "html")
        elif k:
            whole[k] = whole[e.parent]
            inside[k] = inside[e.parent] and not (e.left_out if whole[k] else e.inner)
    blocks: list[str] = []
    run: list[str] = []
    for at, text, _ in page.parts:
        if text is None:
            if run:
                blocks.append("".join(run))
                run = []
        elif inside[at]:
            run.append(text)
    blocks.append("".join(run))
    clean = (_SPACE.sub(" ", unescape(b)).strip() for b in blocks)
    return " ".join(b for b in clean if b)


def vote(html: str) -> str:
    page = parse(html)
    return path_of(page, best_container(page))


def extract(html: str, path: str | None) -> str:
    """The text of the elements at `path`, or else of the page's best container."""
    page = parse(html)
    key = _path_key(path) if path else 0
    # `html` and `tbody` are containers without a step of their own: they share the path above them.
    roots = {k for k, e in enumerate(page.elements) if k and e.key == key and e.step and not e.left_out and path_of(page, k) == path} if path else set()
    text = text_of(page, roots) if roots else ""
    return text or text_of(page, {best_container(page)})


def host_of(url: str = "url") -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def flush() -> pa.RecordBatch:
        rows = [(h, p, n) for (h, p), n in counts.items()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["host", "path", "n"])

    for batch in batches:
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts[host, vote(html)] += 1
        if len(counts) > 50_000:
            yield flush()
            counts.clear()
    yield flush()


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, path, votes: the winning path of each host (most votes, then the path that sorts first)."""
    rows = pages.select(host_of(url_col).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html")).filter("html <> ''")
    votes = rows.mapInArrow(_votes, "host string, path string, n long").groupBy("host", "path").agg(F.sum("n").alias("votes"))
    votes = votes.filter("path <> ''")
    best = votes.groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("order"), "path")).alias("best"))
    return best.select("host", "best.path", (-F.col("best.order")).alias("votes"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, host, path (the host's), text, n_chars of every page."""
    winners = materialize(host_paths(pages, url_col, html_col).select(F.col("host").alias("_host"), F.col("path").alias("_path"), "votes"), "host_paths")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), host_of(url_col).alias("_host"))
    n_hosts = winners.count()
    if n_hosts <= BROADCAST_ROWS:
        joined = join_sized(rows, winners, ["_host"], "left", n_hosts)
    else:
        # The hosts with the most votes go to the pages; only pages of the other, smaller hosts are shuffled.
        hot = materialize(winners.orderBy(F.desc("votes"), "_host").limit(BROADCAST_ROWS), "hot_hosts")
        of_hot = rows.join(hot.hint("broadcast"), "_host")
        others = rows.join(hot.select("_host").hint("broadcast"), "_host", "left_anti").join(winners.hint("merge"), "_host", "left")
        joined = of_hot.unionByName(others)
    joined = joined.select("page_id", "url", "_host", "_path", "html")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [extract(h, p) if h else "" for h, p in zip(batch.column(4).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "host", "path", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in joined.schema}
    return joined.mapInArrow(texts, f"page_id {kinds['page_id']}, url {kinds['url']}, host string, path string, text string, n_chars long")
