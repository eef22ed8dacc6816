"""Main text of web pages, by removal of the subtrees that a site repeats.

Every element subtree is hashed twice: by its content, and by its slot, the tags and names on the way
to it. Spark counts on how many different pages of a host each hash occurs. A subtree goes

- when its content recurs: a block that holds others on some pages, any block on a large share;
- when its slot recurs on some pages beside their main block, the deepest one with more than half of a page's
  words, and seldom holds or lies in it. So menus and adverts go whose words differ from page to page.

Names and kinds of elements (nav, footer, class words) only lower the number of pages a slot needs, and
decide alone on hosts of too few pages to count; they never take the main block. A passage that
many articles of a host share is not a template: text blocks inside a main block go for no repetition.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import stored

MIN_PAGES = 5  # also the number of a host's pages from which its counts decide
NAMED_PAGES = 2  # for a slot whose kind or names speak of a template
MIN_SHARE = 0.3  # of a host's pages, for what is not a container
MIN_WORDS = 3  # of a container that is counted without regard to its share

# Elements of HTML by kind.
VOID = frozenset([
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track",
    "wbr",
])
RAW = frozenset(["script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"])
# Elements that hold no text of an article at all, and elements that seldom do.
SILENT = frozenset(
    [
    "head", "title", "script", "style", "noscript", "template", "iframe", "object", "embed", "svg", "math",
    "canvas", "audio", "video", "form", "button", "select", "option", "input", "textarea", "label", "datalist",
    "fieldset", "noembed", "noframes",
]
)
BESIDE = frozenset(["nav", "footer", "aside", "dialog", "menu"])
BLOCKS = frozenset(
    [
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir",
    "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5",
    "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option",
    "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr",
    "ul",
]
)
TEXT_BLOCKS = frozenset(
    [
    "p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "td", "th", "dd", "dt", "figcaption",
    "caption", "ul", "ol", "dl", "table", "tbody", "thead", "tr", "figure",
]
)
# Blocks that hold others. Single text blocks may be alike by chance or be cited.
CONTAINERS = BLOCKS - TEXT_BLOCKS | {"ul", "ol", "dl", "table"}
# A start tag that closes an open element of the named kind, up to the named boundaries.
CLOSES_P = BLOCKS - {"body", "html", "caption", "dd", "dt", "li", "td", "th", "tr", "tbody", "thead", "tfoot", "optgroup", "option", "legend", "summary", "title"}
CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dd": (frozenset(["dd", "dt"]), frozenset(["dl"])),
    "dt": (frozenset(["dd", "dt"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
DROPPED_ROLES = frozenset(
    [
    "navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog",
    "menu", "menubar", "toolbar",
]
)
# Words in class and id names that mark what is not the article.
DROPPED_WORDS = frozenset(
    [
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored",
    "sponsors", "promo", "promoted", "promotion", "banner", "banners", "nav", "navbar", "navigation", "menu",
    "menus", "breadcrumb", "breadcrumbs", "sidebar", "sidebars", "footer", "masthead", "cookie", "cookies",
    "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe",
    "subscription", "signup", "login", "comment", "comments", "commentlist", "disqus", "respond", "reply",
    "replies", "share", "sharing", "social", "related", "recommended", "recommendations", "pagination",
    "pager", "widget", "widgets", "toolbar", "skip",
]
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*|[^>]*)(?:>|$)", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")


@dataclass
class Element:
    tag: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list[Element | str] = field(default_factory=list)
    hash: int = 0  # of the content
    slot: int = 0  # of the way to it
    words: int = 0
    article: bool = False  # inside an article or main element
    place: int = 0  # in its page: 0 beside the main block, 1 on the way to it, 2 inside it

    def named(self) -> bool:
        """Whether the element's kind, role or names speak of something beside an article."""
        if self.tag in BESIDE or (self.tag == "header" and not self.article):
            return True
        if self.tag in ("#page", "html", "body", "main") or self.tag not in CONTAINERS:
            return False
        if self.attributes.get("role", "").lower() in DROPPED_ROLES or self.attributes.get("itemprop") == "comment":
            return True
        for name in f"{self.attributes.get('class', '')} {self.attributes.get('id', '')}".split():
            words = _WORDS.findall(_CAMEL.sub(" ", name).lower())
            if len(words) <= 2 and not DROPPED_WORDS.isdisjoint(words):
                return True
        return False


def parse(page: str | None) -> Element:
    """The element tree of a page; unclosed and misnested tags are mended as browsers do, roughly."""
    root = Element("#page")
    open_ = [root]
    page = page or ""
    at = 0

    def close(kinds: frozenset[str], stop: frozenset[str]) -> None:
        for i in range(len(open_) - 1, 0, -1):
            if open_[i].tag in stop:
                return
            if open_[i].tag in kinds:
                del open_[i:]
                return

    while at < len(page):
        found = _TOKEN.search(page, at)
        begin = found.start() if found else len(page)
        if begin > at:
            open_[-1].children.append(page[at:begin])
        if not found:
            break
        at = found.end()
        if found[2] is None:
            continue
        tag = found[2].lower()
        if found[1]:
            if tag == "p" and not any(e.tag == "p" for e in open_):
                open_[-1].children.append(Element("p"))
            else:
                stop = frozenset() if tag in BLOCKS else frozenset(BLOCKS)
                close(frozenset([tag]), stop)
            continue
        if tag in CLOSES_P:
            close(frozenset(["p"]), frozenset(["td", "th", "li", "div", "section", "article", "blockquote", "body"]))
        if tag in CLOSES:
            close(*CLOSES[tag])
        if tag[:1] == "h" and tag[1:].isdigit() and open_[-1].tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            open_.pop()
        attributes = {m[0].lower(): html.unescape(m[1] or m[2] or m[3]) for m in _ATTRIBUTE.findall(found[3])}
        article = open_[-1].article or open_[-1].tag in ("article", "main")
        element = Element(tag, attributes, article=article)
        open_[-1].children.append(element)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID:
            open_.append(element)
    return root


def hash_subtrees(root: Element) -> list[Element]:
    """Hash every element from tag, names, text and children; returns them, children first."""
    order, stack = [], [root]
    while stack:
        element = stack.pop()
        order.append(element)
        stack.extend(c for c in element.children if isinstance(c, Element))
    order.reverse()
    for element in order:
        state = xxhash.xxh3_64(element.tag.encode())
        state.update(element.attributes.get("class", "").encode())
        for child in element.children:
            if isinstance(child, Element):
                state.update(child.hash.to_bytes(8, "little"))
                element.words += child.words
            else:
                state.update(_SPACE.sub(" ", child).strip().encode())
                element.words += len(child.split())
        element.hash = state.intdigest()
    return order


def may_recur(element: Element) -> bool:
    """Whether recurring content may drop the element: not the page's frame, not an article's own text."""
    if element.tag not in BLOCKS or element.tag in ("html", "body", "article", "main"):
        return False
    return not element.article or element.tag in BLOCKS - TEXT_BLOCKS


def is_container(element: Element, page_words: int) -> bool:
    """Whether recurring on some pages is enough, as the element is no text of its own and not most of the page."""
    return (
        not element.article and element.tag in CONTAINERS and element.words >= MIN_WORDS
        and 2 * element.words <= page_words
    )


def signed(number: int) -> int:
    return number - (1 << 64) if number >= 1 << 63 else number


def place_elements(root: Element) -> list[Element]:
    """Hashes contents and slots and finds each element's place; returns the elements, children first.

    The main block is reached from the page by going, as long as there is one, to the child block that
    holds others and more than half of the words outside silent elements.
    """
    order = hash_subtrees(root)
    heard = {}
    for element in order:
        own = sum(len(c.split()) for c in element.children if isinstance(c, str))
        inner = sum(heard[id(c)] for c in element.children if isinstance(c, Element))
        heard[id(element)] = 0 if element.tag in SILENT else own + inner
    main = root
    while main is not None:
        main.place = 1
        last, main = main, next(
            (
                c for c in main.children
                if isinstance(c, Element) and c.tag in CONTAINERS and heard[id(root)] < 2 * heard[id(c)]
            ),
            None,
        )
    for element in reversed(order):
        for child in element.children:
            if isinstance(child, Element):
                if element is last or element.place == 2:
                    child.place = 2
                names = f"{child.tag}.{child.attributes.get('class', '')}#{child.attributes.get('id', '')}"
                # An id or class may be numbered by page.
                named = re.sub(r"[0-9]+", "0", names).encode()
                child.slot = signed(xxhash.xxh3_64_intdigest(element.slot.to_bytes(8, "little", signed=True) + named))
    return order


def slots_of(root: Element) -> dict[int, tuple[bool, bool]]:
    """Slots that are counted on a page: whether one is beside the main block, whether it is named.

    They are the blocks on the way to the main block, the outermost ones beside it, and named ones in it.
    """
    found: dict[int, tuple[bool, bool]] = {}
    stack = [c for c in root.children if isinstance(c, Element)]
    while stack:
        element = stack.pop()
        if element.tag in SILENT:
            continue
        if element.tag in BLOCKS and element.tag not in ("html", "body"):
            named = element.named()
            if element.place == 0 or element.place == 1 or named:
                beside, known = found.get(element.slot, (True, False))
                found[element.slot] = (beside and element.place == 0, known or named)
            if element.place == 0:
                continue
        stack.extend(c for c in element.children if isinstance(c, Element))
    return found


def _scopes(root: Element) -> list[Element]:
    """The outermost article and main elements that are not named, if they hold half of what they and the
    text beside them hold; else the page."""
    found, inside, outside, stack = [], 0, 0, [root]
    while stack:
        element = stack.pop()
        if element.tag in SILENT or (element.place != 1 and element.named()):
            continue
        if element.tag in ("article", "main"):
            found.append(element)
            inside += element.words
        else:
            outside += sum(len(c.split()) for c in element.children if isinstance(c, str))
            stack.extend(c for c in reversed(element.children) if isinstance(c, Element))
    return found if found and inside >= outside else [root]


def main_text(page: str | None, template: frozenset[int] | None = None) -> str:
    """Blocks of the main text in page order, one to a line.

    ``template`` has the contents and slots to drop; without one, as for a host of few pages, kinds and
    names decide, and of a page that marks its article only that is read.
    """
    root = parse(page)
    place_elements(root)
    lines: list[str] = []
    run: list[str] = []

    def end_block() -> None:
        line = " ".join(html.unescape("".join(run)).split())
        run.clear()
        if line:
            lines.append(line)

    def goes(element: Element) -> bool:
        if element.tag in SILENT:
            return True
        if template is None:
            return element.place != 1 and element.named()
        return element.slot in template or (signed(element.hash) in template and may_recur(element))

    stack: list[Element | str | None] = list(reversed(_scopes(root))) if template is None else [root]
    while stack:
        item = stack.pop()
        if item is None:
            end_block()
        elif isinstance(item, str):
            run.append(item)
        elif item.tag == "br":
            run.append("\n")
        elif goes(item):
            if item.tag in BLOCKS:
                end_block()
        else:
            if item.tag in BLOCKS:
                end_block()
                stack.append(None)
            stack.extend(reversed(item.children))
    end_block()
    return "\n".join(lines)


def host_of(url: Column) -> Column:
    """Lower-case host of a URL; empty without one."""
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


# What a counted hash is: the page itself, a content, that of a container, a slot in or around a main block,
# a slot beside one, and such slots when named.
PAGE, CONTENT, CONTAINER, SLOT, BESIDE_SLOT, NAMED_SLOT, NAMED_BESIDE_SLOT = range(7)


def counted_hashes(page: str | None) -> dict[int, int]:
    """The distinct hashes of a page that are counted, and what each is."""
    root = parse(page)
    order = place_elements(root)
    found = {signed(e.hash): CONTAINER if is_container(e, root.words) else CONTENT for e in order if may_recur(e)}
    for slot, (beside, named) in slots_of(root).items():
        found[slot] = (NAMED_BESIDE_SLOT if beside else NAMED_SLOT) if named else BESIDE_SLOT if beside else SLOT
    found[0] = PAGE
    return found


def subtree_hashes(pages: DataFrame) -> DataFrame:
    """``(site, hash, page, kind)`` of each different page's counted hashes."""

    def hashes(batches):
        for batch in batches:
            own = [counted_hashes(source) for source in batch.column("html").to_pylist()]
            owner = pa.array([i for i, found in enumerate(own) for _ in found], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("site").take(owner), pa.array([h for found in own for h in found], pa.int64()),
                    batch.column("page").take(owner), pa.array([k for found in own for k in found.values()], pa.int8()),
                ],
                names=["site", "hash", "page", "kind"],
            )

    rows = pages.select("site", "page", "html").mapInArrow(hashes, "site bigint, hash bigint, page bigint, kind tinyint")
    return rows.distinct()


def page_templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """``(page, template)`` of the pages of hosts with ``min_pages`` different pages or more: those of a page's
    own hashes that are a part of its host's template, and 0.

    A content is one when at least ``min_pages`` different pages have it as a container, or at least as many
    and ``min_share`` of the host's pages have it. A slot is one when it is beside the main block on more than
    half of the pages that have it, on ``min_pages`` at least, or when ``NAMED_PAGES`` have it beside or
    inside their main block with a telling kind or name. Templates are rows that are joined to the hashes of pages, so
    neither their number nor a host's size is bounded.
    """
    own = stored(subtree_hashes(pages))

    def of(*kinds: int) -> Column:
        return F.count_if(F.col("kind").isin(*kinds))

    counted = own.groupBy("site", "hash").agg(
        F.count("*").alias("_pages"), of(CONTENT, CONTAINER).alias("_contents"), of(CONTAINER).alias("_containers"),
        of(BESIDE_SLOT, NAMED_BESIDE_SLOT).alias("_beside"), of(NAMED_SLOT, NAMED_BESIDE_SLOT).alias("_named"),
        of(SLOT).alias("_mains"),
    )
    counted = counted.where((F.col("_pages") >= NAMED_PAGES) | (F.col("hash") == 0))
    whole = counted.where((F.col("hash") == 0) & (F.col("_pages") >= min_pages))
    whole = whole.select("site", F.col("_pages").alias("_all"))
    content = (F.col("_containers") >= min_pages) | (
        (F.col("_contents") >= min_pages) & (F.col("_pages") >= F.col("_all") * min_share)
    )
    slot = (F.col("_beside") * 2 > F.col("_pages")) & (F.col("_beside") >= min_pages)
    slot = slot | ((F.col("_named") >= NAMED_PAGES) & (F.col("_mains") * 2 < F.col("_pages")))
    repeated = counted.join(whole, "site").where((F.col("hash") == 0) | content | slot)
    found = own.select("site", "hash", "page").join(repeated.select("site", "hash"), ["site", "hash"])
    return found.groupBy("page").agg(F.collect_list("hash").alias("template"))


def extract_main_text(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html",
    min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE,
) -> DataFrame:
    """``(page_id, url, text, n_chars)``, a row for each row of ``pages``.

    A page that is NULL, empty or without text of its own gives an empty text; a page without a host
    is only compared with other such pages. Repeated rows give repeated rows and count as one page; other
    columns are ignored. Pages travel to their templates compressed.
    """
    rows = pages.select(
        F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"),
        host_of(F.col(url)).alias("host"), F.coalesce(F.col(page).cast("string"), F.lit("")).alias("html"),
    )
    # Pages of a host that are alike have the same hashes and count once.
    rows = rows.withColumns({"site": F.xxhash64("host"), "page": F.xxhash64("host", "html")})

    def pressed(batches):
        press = zstandard.ZstdCompressor(level=6).compress
        for batch in batches:
            sources = [press(source.encode("utf-8", "surrogatepass")) for source in batch.column("html").to_pylist()]
            at = batch.schema.get_field_index("html")
            yield batch.set_column(at, "html", pa.array(sources, pa.binary()))

    packed = rows.select("page_id", "url", "page", "html").mapInArrow(
        pressed, "page_id bigint, url string, page bigint, html binary"
    )
    joined = packed.join(page_templates(rows, min_pages, min_share), "page", "left")

    def extract(batches):
        unpress = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            texts = [
                main_text(unpress(source).decode("utf-8", "surrogatepass"), None if template is None else frozenset(template) - {0})
                for source, template in zip(
                    batch.column("html").to_pylist(), batch.column("template").to_pylist(), strict=True
                )
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    ready = joined.select("page_id", "url", "html", "template")
    return ready.mapInArrow(extract, "page_id bigint, url string, text string, n_chars bigint")
