"""E-books to drafts as one job: every document finds the reader it needs.

Navigation files are skipped. A document is parsed once; paragraph classes that fit a profile choose that
profile's sections, all others are cut at their headings. Sections of a book meet in one table in reading order,
caption pages give their images to the section before, generic sections get their fields, and candidates that
rules alone can read become drafts. Texts stay in their documents' rows until sections are stored once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.text import bind, text
from larder.operators.catalogue import append_new_anchors
from larder.operators.documents import (
    HEADINGS,
    candidate_sections,
    caption_attach,
    deterministic_drafts,
    generic_sections,
    nav_html_skip,
    node_sections,
    section_fields,
)
from larder.operators.profiles import node_profile_sections, profile_of
from larder.session import cut_lineage
from larder.sources.html import node_array

BOOK, PLACE, NAME = "cookbook_id", "doc_no", "doc"
KEEP = [BOOK, PLACE, NAME]
IDS = [PLACE, "section_no"]


def parsed_documents(docs: DataFrame, html: str = "html") -> DataFrame:
    """``(cookbook_id, doc_no, doc, nodes, profile, headed)`` of the documents that are not for navigation.

    ``headed`` tells whether a page has a heading; one without is a single section.
    """
    found = bind(
        node_array(F.coalesce(F.col(html), F.lit(""))),
        lambda nodes: F.struct(
            nodes.alias("nodes"), profile_of(nodes).alias("profile"),
            F.exists(nodes, lambda n: n["tag"].isin(*HEADINGS)).alias("headed"),
        ),
    )
    return nav_html_skip(docs, NAME).select(*KEEP, found.alias("f")).select(*KEEP, "f.nodes", "f.profile", "f.headed")


def book_sections(docs: DataFrame, html: str = "html") -> DataFrame:
    """All sections of books whose documents are ``(cookbook_id, doc_no, doc, html)``.

    ``doc_no`` is the place in reading order. Only a page whose one section has no heading can be a caption
    page. ``profile`` is NULL for generic sections, which have no fields yet.
    """
    # Nodes are dear and read by both kinds of sections.
    parsed = cut_lineage(parsed_documents(docs, html))
    kept = [*KEEP, "headed"]
    generic = generic_sections(node_sections(parsed.where("profile is null"), kept), NAME, kept)
    generic = generic.withColumn("has_heading", F.col("has_heading") | F.col("headed")).drop("headed")
    named = node_profile_sections(parsed.where("profile is not null"), NAME, KEEP).withColumn("has_heading", F.lit(True))
    sections = cut_lineage(generic.unionByName(named, allowMissingColumns=True))
    return caption_attach(sections, [BOOK], [F.asc(PLACE), F.asc("section_no")], IDS)


def filled_sections(sections: DataFrame) -> DataFrame:
    """Candidates with their fields: profile sections have theirs, generic ones are read line by line."""
    # Both kinds are read from what the judging of candidates leaves.
    wanted = cut_lineage(candidate_sections(sections.where(text(F.col("text")) != "")))
    fields = ("metadata", "ingredient_lines", "method_lines")
    generic = section_fields(wanted.where("profile is null").drop(*fields))
    return generic.unionByName(wanted.where("profile is not null"))


def book_drafts(docs: DataFrame, html: str = "html") -> DataFrame:
    """Drafts of whole books, numbered in reading order, with ids that a rerun gives again."""
    drafts = cut_lineage(deterministic_drafts(filled_sections(book_sections(docs, html))))
    return append_new_anchors(drafts, drafts.limit(0), [F.asc(PLACE), F.asc("section_no")], IDS)
