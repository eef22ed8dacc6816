"""HTML pages to ordered block nodes, without a tree parser.

A page is cut before every tag of a block or image, and a fold over the pieces keeps the open elements. A
node is a heading, paragraph or list item with all that is inside it, so a list item keeps the text around and
in a paragraph of its own, which is a node as well. A closing tag ends its element and those open in it; a
paragraph or heading also ends at the next one, a paragraph at a list item too, a list item at the next one of its
list, unless something opened in it is still open. A list item in no list that is not closed by its own tag ends
at the first paragraph or heading in it.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.text import bind, blank_to_null, epub_path, squash

MARK = "\x01"
NODES = ("h1", "h2", "h3", "h4", "p", "li")
TITLES = ("h1", "h2", "h3", "h4", "h5", "h6")
SKIPPED = r"(?is)<(?:!--.*?-->|script\b.*?</script>|style\b.*?</style>)"
# Tags before which a page is cut.
BOUNDS = (
    r"(?i)</?(?:h[1-6]|p|li|img|article|aside|blockquote|body|dd|div|dl|dt|figure|footer|form|header|html|main|nav|ol"
    r"|section|table|tbody|td|th|tr|ul)(?:\s[^>]*)?/?>"
)
REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
# Characters by name, as the public standard of HTML lists them.
NAMED = json.dumps({f"&{name}": character for name, character in html5.items() if name.endswith(";")})


def decode(c: Column) -> Column:
    """Every character reference decoded once: named, decimal and hexadecimal ones.

    A code that is no character becomes the replacement character; unknown names stay as they are.
    """
    names = F.from_json(F.lit(NAMED), "map<string,string>")

    def character(reference: Column) -> Column:
        digits = F.regexp_extract(reference, "^&#[xX]?([0-9a-fA-F]+);$", 1)
        base = F.when(F.lower(F.substring(reference, 3, 1)) == "x", F.conv(digits, 16, 10)).otherwise(digits)
        return bind(
            base.cast("bigint"),
            lambda n: F.when(
                (n > 0) & (n < 0x110000) & ~n.between(0xD800, 0xDFFF),
                F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"),
            ).otherwise("\ufffd"),
        )

    def decoded(part: Column) -> Column:
        return (
            F.when(~F.rlike(part, F.lit(f"^{REFERENCE}$")), part)
            .when(F.substring(part, 2, 1) == "#", character(part))
            .otherwise(F.coalesce(F.try_element_at(names, part), part))
        )

    def joined(c: Column) -> Column:
        parts = F.regexp_extract_all(c, F.lit(REFERENCE + "|[^&]+|&"), F.lit(0))
        return F.when(F.contains(c, F.lit("&")), F.array_join(F.transform(parts, decoded), "")).otherwise(c)

    return bind(c, joined)


def attribute(tag: Column, name: str) -> Column:
    """Value of a quoted attribute of a start tag; NULL without one."""
    quoted = F.regexp_extract(tag, rf"""(?i)\s{name}\s*=\s*("[^"]*"|'[^']*')""", 1)
    value = bind(quoted, lambda q: blank_to_null(F.substr(q, F.lit(2), F.length(q) - 2)))
    # Most tags have no attributes.
    return F.when(F.contains(tag, F.lit("=")), value)


SPAN = "struct<at:int,end:int>"
FAR = 1 << 30


def _spans(pieces: Column) -> Column:
    """First and last piece of every node and image, in the order in which they begin."""
    tags = F.transform(
        pieces,
        lambda p: F.struct(
            F.lower(F.regexp_extract(p, "^</?([a-zA-Z0-9]+)", 1)).alias("tag"),
            F.startswith(p, F.lit("</")).alias("closes"),
            (F.contains(p, F.lit("/>")) & F.rlike(p, F.lit("^<[^>]*/>"))).alias("empty"),
        ),
    )
    state = F.struct(
        F.lit(0).alias("at"),
        F.array().cast("array<struct<tag:string,at:int,first:int>>").alias("open"),
        F.array().cast(f"array<{SPAN}>").alias("out"),
    )

    def place(open_: Column, *names: str) -> Column:
        """How deep the innermost element of a kind is, from 1; far for none."""
        kind = F.transform(open_, lambda e: e["tag"].isin(*names))
        return F.coalesce(F.nullif(F.array_position(kind, F.lit(True)), F.lit(0)), F.lit(FAR)).cast("int")

    def step(acc: Column, piece: Column) -> Column:
        open_, tag = acc["open"], piece["tag"]
        top = F.get(open_, F.lit(0))["tag"]
        own = F.array_position(F.transform(open_, lambda e: e["tag"]), tag).cast("int")
        item = F.when((tag == "li") & (place(open_, "li") < place(open_, "ul", "ol")), place(open_, "li"))
        ends_p = (top == "p") & tag.isin("p", "li", *TITLES)
        instead = F.when(ends_p | (top.isin(*TITLES) & tag.isin(*TITLES)), 1).otherwise(0)
        closed = F.when(tag.isin("", "img"), 0).when(piece["closes"], own).otherwise(F.coalesce(item, instead))

        def moved(n: Column) -> Column:
            ended = F.filter(F.slice(open_, 1, n), lambda e: e["tag"].isin(*NODES))
            by_tag = piece["closes"] & (tag == "li")
            spans = F.transform(
                ended,
                lambda e: F.struct(
                    e["at"].alias("at"), F.when(by_tag, acc["at"]).otherwise(F.coalesce(e["first"], acc["at"])).alias("end")
                ),
            )
            image = F.struct(acc["at"].alias("at"), (acc["at"] + 1).alias("end"))
            rest = F.when(n > 0, F.slice(open_, n + 1, FAR)).otherwise(open_)
            loose = (F.size(open_) > 0) & ~piece["closes"] & tag.isin("p", *TITLES)
            loose = loose & (place(open_, "li") < place(open_, "ul", "ol"))
            loose = loose & (place(open_, "ul", "ol") == FAR)
            rest = F.when(
                loose,
                F.transform(
                    rest,
                    lambda e: F.struct(
                        e["tag"].alias("tag"), e["at"].alias("at"),
                        F.coalesce(e["first"], F.when(e["tag"] == "li", acc["at"])).alias("first"),
                    ),
                ),
            ).otherwise(rest)
            new = F.struct(tag.alias("tag"), acc["at"].alias("at"), F.lit(None).cast("int").alias("first"))
            opens = ~piece["closes"] & ~piece["empty"] & ~tag.isin("", "img")
            return F.struct(
                (acc["at"] + 1).alias("at"),
                F.when(opens, F.array_prepend(rest, new)).otherwise(rest).alias("open"),
                F.when((tag == "img") & ~piece["closes"], F.array_append(acc["out"], image))
                .when(n > 0, F.concat(acc["out"], spans)).otherwise(acc["out"]).alias("out"),
            )

        return bind(F.coalesce(closed, F.lit(0)), moved)

    def finished(acc: Column) -> Column:
        left = F.filter(acc["open"], lambda e: e["tag"].isin(*NODES))
        return F.array_sort(
            F.concat(acc["out"], F.transform(left, lambda e: F.struct(e["at"].alias("at"), F.coalesce(e["first"], acc["at"]).alias("end"))))
        )

    return F.aggregate(tags, state, step, finished)


def node_array(html: Column) -> Column:
    """Ordered nodes h1-h4, p, li and img of a page as an array of structs."""
    pieces = F.split(F.regexp_replace(F.regexp_replace(html, SKIPPED, " "), BOUNDS, f"{MARK}$0"), MARK)

    def node(pieces: Column, span: Column) -> Column:
        first = F.get(pieces, span["at"])

        def of(start: Column, body: Column) -> Column:
            tagged = F.contains(body, F.lit("<"))
            inner = F.when(tagged, F.regexp_extract(body, r"(?i)<[a-z][^>]*\sid\s*=[^>]*>", 0))
            classes = bind(
                attribute(start, "class"),
                lambda c: F.when(c.isNull(), F.array().cast("array<string>")).otherwise(
                    F.filter(F.split(squash(c), " "), lambda x: x != "")
                ),
            )
            return F.struct(
                F.lower(F.regexp_extract(start, "^<([a-zA-Z0-9]+)", 1)).alias("tag"),
                classes.alias("classes"),
                F.coalesce(attribute(start, "id"), bind(inner, lambda tag: attribute(tag, "id"))).alias("id"),
                attribute(start, "src").alias("src"),
                squash(decode(F.when(tagged, F.regexp_replace(body, "<[^>]*>", " ")).otherwise(body))).alias("text"),
            )

        def body(start: Column) -> Column:
            own = F.substring(first, F.length(start) + 1, F.length(first))
            more = F.array_join(F.slice(pieces, span["at"] + 2, span["end"] - span["at"] - 1), "")
            return F.when(F.rlike(start, F.lit("(?i)^<img")), "").otherwise(F.concat(own, more))

        # The start tag and the body are read by every field: they are made once.
        start = F.regexp_extract(first, "^<[^>]*>", 0)
        return bind(start, lambda s: bind(body(s), lambda b: of(s, b)))

    return bind(pieces, lambda cut: F.transform(_spans(cut), lambda span: node(cut, span)))


def html_nodes(pages: DataFrame, doc: str = "page_id", html: str = "html") -> DataFrame:
    """One row per node. A page is one input row, so exploding it needs no shuffle."""
    rows = pages.select(doc, F.posexplode(node_array(F.col(html))).alias("seq", "n"))
    return rows.select(doc, "seq", "n.*")


def _toc_navs(html: Column) -> Column:
    """The marked table-of-contents navs of a page, else its document-toc navs, else all."""
    navs = F.regexp_extract_all(F.regexp_replace(html, SKIPPED, " "), F.lit(r"(?is)<nav\b[^>]*>.*?</nav>"), F.lit(0))

    def marked(pattern: str) -> Column:
        return F.filter(navs, lambda n: F.rlike(n, F.lit(pattern)))

    first = marked(r"""(?i)^<nav\b[^>]*\sepub:type\s*=\s*["']toc["']""")
    second = marked(r"""(?i)^<nav\b[^>]*\srole\s*=\s*["']doc-toc["']""")
    return F.array_join(F.when(F.size(first) > 0, first).when(F.size(second) > 0, second).otherwise(navs), " ")


def walk_toc(pieces: Column) -> Column:
    """Entries ``(depth, label, href)`` of a walk over opening and closing tags.

    Pieces are ``struct<delta, is_item, label, href>`` in document order; ``delta`` opens or closes
    a level. An entry without label or link drops out with the entries below it. The walk keeps
    the open depth and the shallowest unusable entry.
    """
    state = F.struct(
        F.lit(-1).alias("depth"), F.lit(999).alias("bad"),
        F.array().cast("array<struct<depth:int,label:string,href:string>>").alias("out"),
    )

    def step(acc: Column, p: Column) -> Column:
        depth = acc["depth"] + p["delta"]
        usable = (p["label"] != "") & (p["href"] != "")
        under_bad = depth > acc["bad"]
        entry = F.struct(depth.alias("depth"), p["label"].alias("label"), p["href"].alias("href"))
        bad = (
            F.when(~p["is_item"], F.when(depth < acc["bad"], 999).otherwise(acc["bad"]))
            .when(under_bad, acc["bad"]).when(usable, 999).otherwise(depth)
        )
        out = F.when(p["is_item"] & usable & ~under_bad, F.array_append(acc["out"], entry)).otherwise(acc["out"])
        return F.struct(depth.alias("depth"), bad.cast("int").alias("bad"), out.alias("out"))

    return F.aggregate(pieces, state, step, lambda acc: acc["out"])


def _piece(delta: Column, is_item: Column, label: Column, href: Column) -> Column:
    return F.struct(
        delta.cast("int").alias("delta"), is_item.alias("is_item"), label.alias("label"), href.alias("href")
    )


def _toc_rows(pages: DataFrame, doc: str, pieces: Column) -> DataFrame:
    rows = pages.select(doc, F.posexplode(walk_toc(pieces)).alias("seq", "e"))
    return rows.select(doc, "seq", "e.depth", "e.label", "e.href")


def toc_from_html(pages: DataFrame, doc: str = "page_id", html: str = "html", base: Column | None = None) -> DataFrame:
    """Table-of-contents rows of the nested lists in a page's ``nav``."""
    marked = F.regexp_replace(_toc_navs(F.col(html)), r"(?i)<(/?(?:ol|ul|li))\b[^>]*>", f"{MARK}$1>")

    def piece(p: Column) -> Column:
        tag = F.lower(F.regexp_extract(p, "^/?[a-zA-Z]+", 0))
        href = attribute(F.regexp_extract(p, r"(?is)<a\b[^>]*>", 0), "href")
        label = F.regexp_extract(p, r"(?is)^li>\s*<a\b[^>]*?>(.*?)</a>", 1)
        return _piece(
            F.when(tag.isin("ol", "ul"), 1).when(tag.isin("/ol", "/ul"), -1).otherwise(0),
            tag == "li",
            squash(decode(F.regexp_replace(label, "<[^>]*>", " "))),
            epub_path(F.coalesce(href, F.lit("")), base),
        )

    return _toc_rows(pages, doc, F.transform(F.split(marked, MARK), piece))


def toc_from_ncx(files: DataFrame, doc: str = "doc", xml: str = "xml", base: Column | None = None) -> DataFrame:
    """Table-of-contents rows of a navigation control file; none when its tags do not balance."""
    point = r"(?:[a-zA-Z]+:)?navPoint"
    marked = F.regexp_replace(F.regexp_replace(xml, SKIPPED, " "), rf"<(/?){point}\b[^>]*>", f"{MARK}$1>")
    opens = F.regexp_count(F.col(xml), F.lit(rf"<{point}\b"))
    closes = F.regexp_count(F.col(xml), F.lit(rf"</{point}\b"))

    def piece(p: Column) -> Column:
        label = F.regexp_extract(p, r"(?s)<(?:[a-zA-Z]+:)?text\b[^>]*>(.*?)</", 1)
        src = attribute(F.regexp_extract(p, r"(?s)<(?:[a-zA-Z]+:)?content\b[^>]*>", 0), "src")
        opening = F.startswith(p, F.lit(">"))
        return _piece(
            F.when(opening, 1).otherwise(-1), opening, squash(decode(label)), epub_path(F.coalesce(src, F.lit("")), base)
        )

    pieces = F.slice(F.split(marked, MARK), 2, 1000000000)
    return _toc_rows(files.where(opens == closes), doc, F.transform(pieces, piece))
