"""Paragraph profiles: documents whose paragraph classes name the parts of a recipe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.metadata import metadata_line
from larder.functions.text import bind, blank_to_null, excerpt, strip
from larder.operators.documents import dedupe_squashed, deduped_metadata, no_texts, split_at
from larder.sources.html import node_array

# The known profiles in the order they are tried.
PROFILES = (
    {
        "title": ("rt",),
        "ingredient": ("ri", "ris"),
        "method": ("rd-top", "rd", "rds"),
        "text": ("rt", "rst", "rhn", "rh", "rsh", "ri", "ris", "rih-top", "rd-top", "rd", "rds", "bh", "btni"),
        "category": ("ct",),
    },
    {
        "title": ("C287",),
        "ingredient": ("C300",),
        "method": ("C306",),
        "text": ("C287", "C290", "C297", "C299", "C300", "C306"),
    },
    {
        "title": ("recipe-title", "recipe-title1"),
        "ingredient": ("ingredients",),
        "method": ("method", "method1"),
        "text": (
            "caption", "ingredients", "ingredients-head", "method", "method-head", "method1", "recipe-intro",
            "recipe-title", "serves", "serves1",
        ),
        "category": ("recipe-head-translation",),
        "intro": ("recipe-intro",),
        "metadata": ("serves", "serves1"),
        "signature": ("recipe-intro", "recipe-head-translation", "serves1"),
    },
    {
        "title": ("recipe-title", "recipe-title_new"),
        "ingredient": ("ingredients",),
        "method": ("method", "method1"),
        "text": (
            "ingredients", "intro", "intro_new", "method", "method1", "recipe-title", "recipe-title_new", "serves",
            "serves-subhead",
        ),
        "intro": ("intro", "intro_new"),
        "metadata": ("serves",),
        "supplemental": ("serves-subhead",),
        "signature": ("intro", "serves-subhead"),
    },
    {
        "title": ("rt",),
        "ingredient": ("ril", "rilf"),
        "method": ("rp", "rpf"),
        "text": ("rhn", "ril", "rilf", "rp", "rpf", "rt-alt", "ry"),
        "category": ("ct",),
        "intro": ("rhn",),
        "metadata": ("ry",),
        "supplemental": ("rilh", "rilhf"),
        "signature": ("rilf", "rpf", "ry"),
        "drop_images_after_category": True,
    },
    {
        "title": ("rec_head",),
        "ingredient": ("ingredient_list",),
        "method": ("method",),
        "text": ("ingredient_list", "mc_intro", "mc_intro1", "mc_intro2", "mc_intro3", "method"),
        "intro": ("mc_intro", "mc_intro1", "mc_intro2", "mc_intro3"),
        "supplemental": ("ing_head", "ing_head1"),
        "signature": ("ingredient_list", "method", "rec_head"),
        "ignored_image": ("inline_image_2",),
        "defer_images_after_method": True,
        "discard_leading_images": True,
        "min_titles": 1,
    },
    {
        "title": ("rec_head", "rec_headbk"),
        "ingredient": ("ingred",),
        "method": ("method",),
        "text": ("ingred", "method", "rec_intro"),
        "intro": ("rec_intro",),
        "metadata": ("prep_time", "prep_time1", "serves"),
        "signature": ("ingred", "method", "rec_head"),
        "min_titles": 1,
    },
    {
        "title": ("recipe_header",),
        "ingredient": ("ingred",),
        "method": ("indented",),
        "text": ("center", "ingred", "indented", "serving_size", "serving_size1"),
        "fallback_title": ("image_caption",),
        "plain_text_method": True,
        "min_titles": 1,
    },
)


CLASS_KINDS = (
    "title", "ingredient", "method", "text", "category", "intro", "metadata", "supplemental", "fallback_title", "ignored_image",
)
FLAGS = ("drop_images_after_category", "defer_images_after_method", "discard_leading_images")


def _profile(number: Column) -> Column:
    """The class lists and flags of a profile, as a struct looked up by its number."""

    def classes(profile: dict, kind: str) -> Column:
        return F.array(*[F.lit(c) for c in profile.get(kind, ())]).cast("array<string>").alias(kind)

    known = F.array(*[
        F.struct(*[classes(p, k) for k in CLASS_KINDS], *[F.lit(bool(p.get(f))).alias(f) for f in FLAGS]) for p in PROFILES
    ])
    return F.get(known, number)


def _has(node: Column, classes: tuple[str, ...]) -> Column:
    if not classes:
        return F.lit(False)
    return F.arrays_overlap(node["classes"], F.array(*[F.lit(c) for c in classes]))


def _matches(nodes: Column, used: Column, profile: dict) -> Column:
    """Whether a profile fits; ``used`` are the different classes of all nodes, which most profiles do not meet."""

    def some(*kinds: str) -> Column:
        classes = sum((profile.get(k, ()) for k in kinds), ())
        return F.arrays_overlap(used, F.array(*[F.lit(c) for c in classes])) if classes else F.lit(False)

    titles = profile["title"] + profile.get("fallback_title", ())
    method = some("method")
    if profile.get("plain_text_method"):
        method = method | F.exists(nodes, lambda n: F.size(n["classes"]) == 0)
    enough = F.size(F.filter(nodes, lambda n: _has(n, titles))) >= profile.get("min_titles", 2)
    signature = some("signature") if profile.get("signature") else F.lit(True)
    return some("title", "fallback_title") & some("ingredient") & method & signature & enough


def profile_of(nodes: Column) -> Column:
    """Number of the first profile that fits the text nodes of a document; NULL without one."""
    shown = F.filter(nodes, lambda n: n["tag"] != "img")

    def first_fit(a: Column, used: Column) -> Column:
        return F.coalesce(*[F.when(_matches(a, used, p), F.lit(i)) for i, p in enumerate(PROFILES)])

    return bind(
        shown, lambda a: bind(F.array_distinct(F.flatten(F.transform(a, lambda n: n["classes"]))), lambda used: first_fit(a, used))
    )


def profile_match(pages: DataFrame, doc: str = "page_id", html: str = "html") -> DataFrame:
    return pages.select(doc, profile_of(node_array(F.col(html))).alias("profile"))


def _sections(nodes: Column, profile: Column) -> Column:
    """Runs of nodes, one per recipe; each begins at a title."""

    def cls(node: Column, kind: str) -> Column:
        return F.arrays_overlap(node["classes"], profile[kind])

    kept = F.filter(
        nodes,
        lambda n: F.when(n["tag"] == "img", n["src"].isNotNull() & ~cls(n, "ignored_image")).otherwise(n["text"] != ""),
    )

    def is_title(n: Column) -> Column:
        return (n["tag"] != "img") & cls(n, "title") & ~cls(n, "category")

    def is_fallback(n: Column) -> Column:
        return (n["tag"] != "img") & cls(n, "fallback_title") & ~cls(n, "category") & ~cls(n, "title")

    def split(a: Column) -> Column:
        # Classes are compared once a node: 2 for a title, 1 for what can stand for the first one.
        marks = F.transform(a, lambda n: F.when(is_title(n), 2).when(is_fallback(n), 1).otherwise(0))
        return bind(marks, lambda marks: bind(first_of(marks), lambda f: split_from(a, marks, f)))

    def first_of(marks: Column) -> Column:
        return F.array_min(F.array_compact(F.transform(marks, lambda m, i: F.when(m > 0, i))))

    def split_from(a: Column, marks: Column, first: Column) -> Column:
        def starts_at(i: Column) -> Column:
            return (F.get(marks, i) == 2) | ((F.get(marks, i) == 1) & (i == first))

        runs = split_at(a, lambda n, i: starts_at(i))
        starts = F.array_compact(F.transform(marks, lambda m, i: F.when(starts_at(i), i)))
        lead = F.when(first > 0, F.slice(a, 1, first)).otherwise(F.slice(a, 1, 0))

        # Categories are few: a run looks for the last one before it among them, not among all nodes before it.
        categories = F.array_compact(F.transform(
            a, lambda n, i: F.when((n["tag"] != "img") & cls(n, "category"), F.struct(i.alias("at"), n["text"].alias("text")))
        ))

        def built(starts: Column, categories: Column, run: Column, k: Column) -> Column:
            category = F.try_element_at(F.filter(categories, lambda c: c["at"] < F.get(starts, k)), F.lit(-1))["text"]
            opening = F.when(k == 0, lead).otherwise(F.slice(a, 1, 0))
            return bind(category, lambda named: _section(run, k, named, opening, profile))

        return bind(
            starts, lambda s: bind(categories, lambda c: F.transform(runs, lambda run, k: built(s, c, run, k)))
        )

    return bind(kept, split)


def _section(run: Column, k: Column, category: Column, lead: Column, profile: Column) -> Column:
    def cls(node: Column, kind: str) -> Column:
        return F.arrays_overlap(node["classes"], profile[kind])

    def is_text(n: Column) -> Column:
        return n["tag"] != "img"

    def bare_or_text(n: Column) -> Column:
        return (F.size(n["classes"]) == 0) | cls(n, "text")

    def texts(nodes: Column) -> Column:
        return F.transform(nodes, lambda n: n["text"])

    def sources(nodes: Column) -> Column:
        return F.transform(F.filter(nodes, lambda n: n["tag"] == "img"), lambda n: n["src"])

    # The role of every node after the title, under the supplemental heading that is open there.
    role = F.struct(F.lit("").alias("role"), F.lit(0).alias("under"), F.lit("").alias("text"), F.lit(None).cast("string").alias("src"))
    start = F.struct(
        F.lit(0).alias("open"), F.lit(0).alias("headings"), F.lit(False).alias("cooking"),
        F.slice(F.array(role), 1, 0).alias("out"),
    )

    def step(acc: Column, n: Column) -> Column:
        kind = (
            F.when(~is_text(n), F.when(profile["defer_images_after_method"] & acc["cooking"], "late_image").otherwise("image"))
            .when(cls(n, "category"), "skip")
            .when(cls(n, "intro"), "intro")
            .when(cls(n, "metadata"), "metadata")
            .when(cls(n, "supplemental"), "supplemental")
            .when(cls(n, "ingredient") & (acc["open"] > 0), "ingredient")
            .when(cls(n, "method"), "method")
            .when(bare_or_text(n) & cls(n, "ingredient"), "ingredient")
            .when(bare_or_text(n), "line")
            .otherwise("skip")
        )

        def moved(r: Column) -> Column:
            headings = acc["headings"] + F.when(r == "supplemental", 1).otherwise(0)
            is_open = (
                F.when(r == "supplemental", headings).when(r.isin("metadata", "method"), 0).otherwise(acc["open"])
            )
            entry = F.struct(r.alias("role"), is_open.alias("under"), n["text"].alias("text"), n["src"].alias("src"))
            return F.struct(
                is_open.cast("int").alias("open"), headings.cast("int").alias("headings"),
                (acc["cooking"] | (r == "method")).alias("cooking"), F.array_append(acc["out"], entry).alias("out"),
            )

        return bind(kind, moved)

    def finish(out: Column) -> Column:
        def of(*roles: str) -> Column:
            return F.transform(F.filter(out, lambda e: e["role"].isin(*roles)), lambda e: e["text"])

        def images(r: str) -> Column:
            return F.transform(F.filter(out, lambda e: e["role"] == r), lambda e: e["src"])

        title = F.get(run, F.lit(0))
        leading = F.filter(lead, lambda n: is_text(n) & ~cls(n, "category") & bare_or_text(n))
        lines = F.concat(
            F.array_compact(F.array(category, title["text"])), texts(leading),
            of("intro", "metadata", "supplemental", "ingredient", "method", "line"),
        )
        kept_lead = ~profile["discard_leading_images"] & (~profile["drop_images_after_category"] | category.isNull())
        meta = F.array_compact(F.transform(of("metadata"), metadata_line))
        heads = F.filter(out, lambda e: e["role"] == "supplemental")
        supplemental = F.transform(
            heads,
            lambda h: F.struct(
                strip(h["text"]).alias("heading"),
                dedupe_squashed(
                    F.transform(
                        F.filter(out, lambda e: (e["role"] == "ingredient") & (e["under"] == h["under"])), lambda e: e["text"]
                    )
                ).alias("lines"),
            ),
        )
        return bind(dedupe_squashed(lines), lambda deduped: F.struct(
            (k + 1).alias("section_no"),
            title["text"].alias("chapter_title"),
            F.coalesce(blank_to_null(title["id"]), (k + 1).cast("string")).alias("fragment"),
            F.array_join(deduped, "\n").alias("text"),
            excerpt(deduped).alias("excerpt"),
            F.concat(F.when(kept_lead, sources(lead)).otherwise(no_texts()), images("image"), images("late_image")).alias("images"),
            deduped_metadata(meta, dedupe_squashed(of("intro"))).alias("metadata"),
            F.filter(supplemental, lambda s: (s["heading"] != "") & (F.size(s["lines"]) > 0)).alias("supplemental_sections"),
            dedupe_squashed(of("ingredient")).alias("ingredient_lines"),
            dedupe_squashed(of("method")).alias("method_lines"),
        ))

    rest = F.slice(run, 2, 1000000000)
    return bind(F.aggregate(rest, start, step, lambda acc: acc["out"]), finish)


def profile_sections(pages: DataFrame, doc: str = "page_id", html: str = "html") -> DataFrame:
    """Recipe sections of the documents that follow a profile.

    Titles begin sections; classes route the paragraphs. Lines before the first title join the
    first section.
    """
    # Nodes and profile are bound, so a page is parsed once however many branches read it.
    found = bind(node_array(F.col(html)), lambda nodes: bind(profile_of(nodes), lambda n: _routed(nodes, n)))
    rows = pages.select(doc, found.alias("f")).select(doc, "f.profile", F.explode("f.sections").alias("s"))
    return _named_sections(rows, doc, [doc])


def node_profile_sections(parsed: DataFrame, doc: str, keep: list[str]) -> DataFrame:
    """``profile_sections`` of pages read before, with their ``nodes`` and ``profile``."""
    rows = parsed.select(*keep, _routed(F.col("nodes"), F.col("profile")).alias("f"))
    return _named_sections(rows.select(*keep, "f.profile", F.explode("f.sections").alias("s")), doc, keep)


def _routed(nodes: Column, number: Column) -> Column:
    built = bind(_profile(number), lambda profile: _sections(nodes, profile))
    return F.struct(number.alias("profile"), F.when(number.isNotNull(), built).alias("sections"))


def _named_sections(rows: DataFrame, doc: str, keep: list[str]) -> DataFrame:
    key = F.concat(F.col(doc).cast("string"), F.lit("#"))
    return rows.select(
        *keep,
        "profile",
        F.concat(key, F.col("s.section_no").cast("string")).alias("section_key"),
        F.concat(key, "s.fragment").alias("anchor"),
        "s.*",
    ).drop("fragment")
