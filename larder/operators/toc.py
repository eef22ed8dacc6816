"""Tables of contents: flattening, chapter maps, sections in source order.

A book's table of contents and reading order are one document each, so they are arrays of one
row (``toc``: ``array<struct<label, href, depth, has_children>>`` in pre-order; ``spine``:
``array<string>``). Dishes are rows and only meet them in joins.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.text import (
    bind,
    blank_to_null,
    epub_path,
    file_stem,
    is_ignored_chapter_label,
    looks_like_chapter_label,
    squash,
    strip,
    strip_chars,
    text,
    word_count,
)
from larder.operators.ordering import ranked

ENTRIES = "array<struct<label:string,href:string,depth:int,has_children:boolean>>"
MARKERS = "array<struct<start:int,depth:int,place:int,label:string>>"


# A token of JSON: a mark, a string, or a number or name.
_TOKEN = re.compile(r'[ \t\n\r]*(?:([\[\]{},:])|("(?:[^"\\]|\\.)*")|([^\s"\[\]{},:]+))', re.S)
# What may come next in a text of JSON: a value, a value or the end of a list, a key or the end of an
# object, a key, the colon behind it, what follows a value, nothing more.
VALUE, ITEM, MEMBER, KEY, COLON, AFTER, DONE = range(7)


def read_json(source: str) -> object:
    """The value of a JSON text of any depth, by a stack of open lists and objects; ValueError for other text."""
    at, state, result, key = 0, VALUE, None, None
    open_: list[list | dict] = []

    def put(value: object) -> None:
        nonlocal result
        if not open_:
            result = value
        elif isinstance(open_[-1], list):
            open_[-1].append(value)
        else:
            open_[-1][key] = value

    while True:
        found = _TOKEN.match(source, at)
        if found is None:
            if state == DONE and not source[at:].strip(" \t\n\r"):
                return result
            raise ValueError("no JSON")
        at = found.end()
        mark, quoted, other = found.groups()
        if state in (VALUE, ITEM) and mark in ("[", "{"):
            inner: list | dict = [] if mark == "[" else {}
            put(inner)
            open_.append(inner)
            state = ITEM if mark == "[" else MEMBER
        elif state in (VALUE, ITEM) and mark is None:
            put(json.loads(quoted or other))
            state = AFTER if open_ else DONE
        elif state in (MEMBER, KEY) and quoted:
            key, state = json.loads(quoted), COLON
        elif state == COLON and mark == ":":
            state = VALUE
        elif state == AFTER and mark == ",":
            state = VALUE if isinstance(open_[-1], list) else KEY
        elif (mark == "]" and state in (ITEM, AFTER) and isinstance(open_[-1], list)) or (
            mark == "}" and state in (MEMBER, AFTER) and isinstance(open_[-1], dict)
        ):
            open_.pop()
            state = AFTER if open_ else DONE
        else:
            raise ValueError("no JSON")


def _walked(payload: str | None) -> list[dict]:
    """Entries of one stored table of contents in pre-order, whatever its depth."""

    def written(value: object) -> str | None:
        if value is None or isinstance(value, str):
            return value and value.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
        try:
            return json.dumps(value)
        except RecursionError:  # no label or link is nested like that
            return None

    try:
        top = read_json(payload or "")
    except ValueError:
        return []
    found: list[dict] = []
    for root in top if isinstance(top, list) else []:
        own, stack = [], [(root, 0)]
        while stack:
            node, depth = stack.pop()
            label, href = (written(node.get(k)) for k in ("label", "href")) if isinstance(node, dict) else (None, None)
            if label is None or href is None:
                own = []
                break
            children = node.get("children")
            children = children if isinstance(children, list) else []
            own.append({"label": label, "href": href, "depth": depth, "has_children": bool(children)})
            stack.extend((child, depth + 1) for child in reversed(children))
        found.extend(own)
    return found


def toc_entries(payload: Column) -> Column:
    """Pre-order entries of stored TOC JSON, at any depth; empty for anything but a list of objects.

    An entry with an invalid descendant is dropped whole. A tree has no bound on its depth, which
    no expression of fixed size can walk, so one Arrow function reads it.
    """
    return F.udf(_walked, ENTRIES, useArrow=True)(payload)


def toc_flatten(books: DataFrame, json_col: str = "table_of_contents") -> DataFrame:
    rows = books.select("cookbook_id", F.posexplode(toc_entries(F.col(json_col))).alias("seq", "e"))
    return rows.select("cookbook_id", "seq", "e.depth", "e.label", "e.href", "e.has_children")


def toc_labels(toc: Column) -> Column:
    return F.filter(F.transform(toc, lambda e: squash(text(e["label"]))), lambda x: x != "")


# --- chapter map -----------------------------------------------------------------------------


def _placed(toc: Column, spine: Column) -> Column:
    """Entries with their place in the reading order; NULL for documents outside it."""

    def place(e: Column) -> Column:
        at = F.array_position(spine, e["href"]).cast("int")
        return F.struct(
            e["label"].alias("label"), e["href"].alias("href"), e["depth"].cast("int").alias("depth"),
            e["has_children"].alias("has_children"), F.when(at > 0, at - 1).alias("at"),
        )

    return F.transform(toc, place)


def _next_at(entries: Column, e: Column, i: Column) -> Column:
    """Place of the first later entry that is no deeper and has one."""
    later = F.filter(
        F.slice(entries, i + 2, 1000000000), lambda x: x["at"].isNotNull() & (x["depth"] <= e["depth"])
    )
    return F.get(later, F.lit(0))["at"]


def next_sibling(books: DataFrame) -> DataFrame:
    """Per entry: its place in the reading order and that of the entry that ends it."""

    def ends(entries: Column) -> Column:
        return F.transform(
            entries, lambda e, i: F.struct(e["label"].alias("label"), e["at"].alias("at"), _next_at(entries, e, i).alias("next_at"))
        )

    found = bind(_placed(F.col("toc"), F.col("spine")), ends)
    return books.select("cookbook_id", F.posexplode(found).alias("seq", "e")).select("cookbook_id", "seq", "e.*")


def _markers(entries: Column, spine: Column, relevant: Column, grouped: bool) -> Column:
    """Entries that begin a chapter."""

    def begins(e: Column, i: Column) -> Column:
        is_recipe = F.array_contains(relevant, e["href"])
        named = looks_like_chapter_label(e["label"])
        # A next place of zero counts as none, as the end of the reading order.
        ending = F.coalesce(F.nullif(_next_at(entries, e, i), F.lit(0)), F.size(spine))
        leaf_ok = ~(
            ((e["depth"] > 0) & ~named)
            | ((e["depth"] == 0) & (ending - e["at"] <= 1) & ~named & ~is_recipe)
        )
        if grouped:
            leaf_ok = leaf_ok & ~is_recipe
        return ~is_ignored_chapter_label(e["label"]) & e["at"].isNotNull() & (e["has_children"] | leaf_ok)

    marked = F.transform(
        entries,
        lambda e, i: F.when(
            begins(e, i),
            F.struct(e["at"].alias("start"), e["depth"].alias("depth"), i.cast("int").alias("place"), e["label"].alias("label")),
        ),
    )
    return F.array_sort(F.array_compact(marked)).cast(MARKERS)


def collapse_markers(markers: Column, prefer_deep: bool) -> Column:
    """One marker per start: the deepest in the grouped pass, else the shallowest; ties by place."""
    starts = F.array_distinct(F.transform(markers, lambda m: m["start"]))

    def chosen(start: Column) -> Column:
        same = F.filter(markers, lambda m: m["start"] == start)
        depth = F.transform(same, lambda m: m["depth"])
        wanted = F.array_max(depth) if prefer_deep else F.array_min(depth)
        return F.get(F.filter(same, lambda m: m["depth"] == wanted), F.lit(0))

    return F.transform(starts, chosen)


def spine_asof(markers: Column, spine: Column) -> Column:
    """Each document of the reading order with the last marker at or before it."""

    def label(i: Column) -> Column:
        before = F.filter(markers, lambda m: m["start"] <= i)
        return F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.transform(before, lambda m: m["label"])), -1)

    return F.transform(spine, lambda path, i: F.struct(path.alias("path"), label(i).alias("label")))


def _mapping(entries: Column, spine: Column, relevant: Column, grouped: bool) -> Column:
    one_each = bind(_markers(entries, spine, relevant, grouped), lambda m: collapse_markers(m, grouped))
    return F.filter(
        bind(one_each, lambda m: spine_asof(m, spine)),
        lambda p: p["label"].isNotNull() & F.array_contains(relevant, p["path"]),
    )


def chapter_map_of(toc: Column, spine: Column, recipe_paths: Column) -> Column:
    """``array<struct<path, label>>``: the chapter of each relevant document.

    The grouped pass ignores leaves that are recipe files. It stands when it covers half the
    recipe paths, else the plain pass does. Without recipe paths every document is relevant.
    """

    def build(entries: Column) -> Column:
        plain_relevant = F.when(F.size(recipe_paths) > 0, recipe_paths).otherwise(spine)
        plain = _mapping(entries, spine, plain_relevant, False)
        needed = F.greatest(F.lit(1), F.floor(F.size(recipe_paths) / 2).cast("int"))
        return bind(
            _mapping(entries, spine, recipe_paths, True),
            lambda g: F.when((F.size(recipe_paths) > 0) & (F.size(g) >= needed), g).otherwise(plain),
        )

    return bind(_placed(toc, spine), build)


def chapter_map(books: DataFrame) -> DataFrame:
    """Rows ``(cookbook_id, path, label)`` of every book."""
    found = chapter_map_of(F.col("toc"), F.col("spine"), F.col("recipe_paths"))
    return books.select("cookbook_id", F.explode(found).alias("c")).select("cookbook_id", "c.path", "c.label")


def toc_score(toc: Column, spine: Column, recipe_paths: Column) -> Column:
    """Score triple by which the best table of contents of a book is chosen."""

    def score(mapped: Column) -> Column:
        paths = F.array_distinct(F.transform(mapped, lambda c: c["path"]))
        hits = F.size(F.array_intersect(paths, recipe_paths))
        with_recipes = F.size(recipe_paths) > 0
        return F.struct(
            F.when(with_recipes, hits).otherwise(F.size(toc)).alias("s1"),
            F.when(with_recipes, F.size(toc)).otherwise(F.size(paths)).alias("s2"),
            F.when(with_recipes, F.size(paths)).otherwise(0).alias("s3"),
        )

    return bind(chapter_map_of(toc, spine, recipe_paths), score)


def facet_catalog_stats(books: DataFrame) -> DataFrame:
    return books.withColumn("score", toc_score(F.col("toc"), F.col("spine"), F.col("recipe_paths")))


def best_toc(candidates: DataFrame) -> DataFrame:
    """The candidate with the largest score per book; the first of equals. ``candidate`` is its number."""
    scored = facet_catalog_stats(candidates)
    best = scored.where(F.size("toc") > 0).groupBy("cookbook_id").agg(
        F.max_by(F.struct("candidate", "toc", "score"), F.struct("score", -F.col("candidate"))).alias("best")
    )
    return best.select("cookbook_id", "best.candidate", "best.toc", "best.score")


# --- dishes in the source's order -----------------------------------------------------------


def chapter_label(dishes: DataFrame, chapters: DataFrame) -> DataFrame:
    """Chapter of each recipe: mapped path, own chapter title, excerpt prefix, file name, ``Recipes``.

    ``dishes`` has title, chapter_title, anchor, format and excerpt.
    """
    path = epub_path(F.col("anchor"))
    title = squash(F.col("title"))
    named = F.nullif(strip(text(F.col("chapter_title"))), F.lit(""))
    shown = squash(text(F.col("excerpt")))
    at = F.instr(F.lower(shown), F.lower(title))
    prefix = strip_chars(F.substr(shown, F.lit(1), at - 1), " ,:-")
    before = F.when(
        (F.lower("format") != "epub") & (shown != "") & (title != "") & (at > 1) & (prefix != "") & (word_count(prefix) <= 8),
        prefix,
    )
    number = F.regexp_extract(file_stem(path), r"(?i)chapter[_ -]?(\d+)$", 1)
    keyed = dishes.withColumn("_path", path)
    mapped = chapters.select("cookbook_id", F.col("path").alias("_path"), F.col("label").alias("_mapped"))
    return (
        keyed.join(mapped, ["cookbook_id", "_path"], "left")
        .withColumn(
            "label",
            F.coalesce(
                "_mapped",
                F.when(F.lower(named) != F.lower(title), named),
                before,
                F.concat(F.lit("Chapter "), blank_to_null(number)),
                F.lit("Recipes"),
            ),
        )
        .drop("_path", "_mapped")
    )


def _subtrees(books: DataFrame) -> DataFrame:
    """One row per (entry, document under it), with the entry's place in post-order."""

    def spans(toc: Column) -> Column:
        def span(e: Column, i: Column) -> Column:
            ends = F.transform(toc, lambda x, j: F.when((j > i) & (x["depth"] <= e["depth"]), j))
            end = F.coalesce(F.array_min(F.array_compact(ends)), F.size(toc))
            return F.struct(
                i.alias("seq"), e["depth"].alias("depth"), e["label"].alias("label"), end.alias("end"),
                F.transform(F.slice(toc, i + 1, end - i), lambda x: epub_path(x["href"])).alias("paths"),
            )

        return F.transform(toc, span)

    rows = books.select("cookbook_id", F.explode(bind(F.col("toc"), spans)).alias("n"))
    # Post-order: a node comes after its subtree, deeper nodes first where they end together.
    order = F.struct(F.col("n.end").alias("end"), (-F.col("n.depth")).alias("up"), F.col("n.seq").alias("seq"))
    return rows.select(
        "cookbook_id", "n.seq", "n.depth", "n.label", order.alias("post"), F.explode(F.array_distinct("n.paths")).alias("path")
    )


def section_from_toc(dishes: DataFrame, books: DataFrame) -> DataFrame:
    """Section of every recipe from the shape of the source's table of contents.

    The sections are the entries of the first depth below the root at which some entry holds
    more than one recipe file (else the first such depth). A recipe goes to the first entry, in
    post-order, that holds its file. ``post`` orders the sections; dishes outside all of them
    follow as their own sections, with ``post`` NULL. Books without such a depth give no rows.
    """
    known = dishes.where(F.lower("format") == "epub").withColumn("path", epub_path(F.col("anchor"))).where(F.col("path") != "")
    paths = known.select("cookbook_id", "path").distinct()
    held = _subtrees(books).join(paths, ["cookbook_id", "path"])
    per_entry = held.groupBy("cookbook_id", "seq", "depth").agg(F.count("*").alias("files"))
    depths = per_entry.where(F.col("files") > 1).groupBy("cookbook_id").agg(
        F.coalesce(F.min(F.when(F.col("depth") > 0, F.col("depth"))), F.min("depth")).alias("depth")
    )
    owner = (
        held.join(depths, ["cookbook_id", "depth"])
        .groupBy("cookbook_id", "path")
        .agg(F.min_by(F.struct("post", "label"), "post").alias("owner"))
        .select("cookbook_id", "path", "owner.post", F.col("owner.label").alias("section"))
    )
    # The label of a leftover recipe comes from the recipe alone.
    alone = chapter_label(dishes, owner.select("cookbook_id", "path", F.col("section").alias("label")).limit(0))
    return (
        alone.withColumn("path", F.when(F.lower("format") == "epub", epub_path(F.col("anchor"))))
        .join(depths.select("cookbook_id"), "cookbook_id", "left_semi")
        .join(owner, ["cookbook_id", "path"], "left")
        .select("cookbook_id", "recipe_id", "position", F.coalesce("section", "label").alias("section"), "post")
    )


def order_sections(sections: DataFrame, labels: DataFrame) -> DataFrame:
    """Place the k-th section of a name at the k-th label of that name; the rest keep their order.

    ``sections`` is ``(cookbook_id, section_no, title)``, ``labels`` ``(cookbook_id, seq, label)``.
    ``toc_seq`` is NULL for sections without a label.
    """
    mine = ranked(sections, [F.asc("section_no")], ["cookbook_id", "title"], name="nth")
    theirs = ranked(labels.withColumnRenamed("label", "title"), [F.asc("seq")], ["cookbook_id", "title"], name="nth")
    placed = mine.join(
        theirs.select("cookbook_id", "title", "nth", F.col("seq").alias("toc_seq")), ["cookbook_id", "title", "nth"], "left"
    )
    order = [F.asc_nulls_last("toc_seq"), F.asc("section_no")]
    return ranked(placed.drop("nth"), order, ["cookbook_id"])
