"""Text helpers. Every function takes and returns a Column.

Patterns avoid look-around and back-references, and spell Unicode white space and word
boundaries out, so that one pattern means the same in Java, Python and RE2.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space, as Python's str.split() and \s see it.
WS = (
    r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
# The same class for Java alone: most characters are told from white space by one comparison.
ANY_WS = r"[\x00- \x{7f}-\x{10ffff}&&" + WS + "]"
NOT_WS = "[^" + WS.removeprefix("[")
# Runs of white space other than one blank, for Java alone: what is left to replace where each run is to be one blank.
WS_RUN = ANY_WS + "{2,}|" + ANY_WS.replace("[\\x00- ", "[\\x00-\\x{1f}")
WS_CHARS = "".join(map(chr, (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)))
# Unicode word boundaries as consuming groups (safe for search, not for replacement).
WORD_START = r"(?:^|[^\p{L}\p{N}_])"
WORD_END = r"(?:$|[^\p{L}\p{N}_])"

# Suffixes that download libraries leave in titles.
LIBRARY_NAME = r"(?:z[\s-]*library(?:\.sk)?|1lib(?:\.sk)?|z[\s-]*lib(?:\.sk|rary)?)"
LIBRARY_BRACKET = r"(?i)[\(\[][^)\]]*" + LIBRARY_NAME + r"[^)\]]*[\)\]]"
LIBRARY_TAIL = r"(?i)\s*[-–—,]?\s*" + LIBRARY_NAME + r".*$"


def bind(c: Column, body) -> Column:
    """``body(c)`` with ``c`` evaluated once, however often the body uses it."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def text(c: Column) -> Column:
    """NULL reads as the empty string."""
    return F.coalesce(c, F.lit(""))


def blank_to_null(c: Column) -> Column:
    """NULL for the empty string. ``c`` is evaluated once, which ``nullif`` inside ``bind`` does not promise."""
    return F.get(F.array_remove(F.array(c), F.lit("")), F.lit(0))


def squash(c: Column) -> Column:
    """Collapse white space to single blanks and trim."""
    return F.trim(F.regexp_replace(c, WS_RUN, " "))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def strip_chars(c: Column, chars: str) -> Column:
    return F.btrim(c, F.lit(chars))


def casefold(c: Column) -> Column:
    return bind(
        F.lower(c), lambda low: F.when(F.contains(low, F.lit("ß")), F.replace(low, F.lit("ß"), F.lit("ss"))).otherwise(low)
    )


def words(c: Column) -> Column:
    """White-space separated words; none for blank text."""
    return F.filter(F.split(squash(c), " "), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def first_words(c: Column, n: int) -> Column:
    """The first ``n`` words; of a long text, no more than these is read."""
    return squash(F.regexp_extract(c, f"^{WS}*(?:{NOT_WS}+{WS}*){{0,{n}}}", 0))


def text_lines(c: Column) -> Column:
    """Stripped, non-empty lines of a text."""
    return F.filter(F.transform(F.split(c, "[\r\n]"), strip), lambda x: x != "")


def title_case(c: Column) -> Column:
    """Upper-case the first letter of every run of letters (``O'Neil``, ``Lemon-Herb``)."""
    runs = F.regexp_extract_all(c, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


def strip_library_suffixes(c: Column) -> Column:
    return squash(F.regexp_replace(F.regexp_replace(c, LIBRARY_BRACKET, ""), LIBRARY_TAIL, ""))


def clean_metadata(c: Column) -> Column:
    return strip_chars(strip_library_suffixes(strip(text(c))), " -_,;:/")


def file_name(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/]*)/*$", 1)


def file_stem(c: Column) -> Column:
    return F.regexp_replace(file_name(c), r"(.)\.[^.]+$", "$1")


def file_extension(c: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(c), r".\.([^.]+)$", 1))


def display_title_from_file(c: Column, default: str = "Untitled Cookbook") -> Column:
    stem = strip_library_suffixes(F.translate(file_stem(c), "_-", "  "))
    return F.coalesce(blank_to_null(title_case(stem)), F.lit(default))


# Endings that each source adds to its file names, and whether the title is
# then put in title case.
SOURCE_FILE_ENDINGS = {
    "nytimes": (r"(?i)\s+recipe$", False),
    "jamie-oliver": (r"(?i)\s+\|\s+jamie oliver recipes$", True),
    "bbc-goodfood": (r"(?i)\s+\|\s+good food$", True),
    "waitrose-recipes": (r"(?i)\s+recipe\s+\|\s+waitrose\s*&\s*partners$", True),
}


def source_file_title(c: Column, cookbook_title: Column, source: str) -> Column:
    """Title of a recipe file that shows none, per source."""
    ending, titled = SOURCE_FILE_ENDINGS[source]
    stem = strip(F.translate(file_stem(c), "_-", "  "))
    base = squash(F.regexp_replace(F.coalesce(blank_to_null(stem), cookbook_title), ending, ""))
    return title_case(base) if titled else base


def derive_cuisine(subjects: Column) -> Column:
    cleaned = F.filter(F.transform(subjects, clean_metadata), lambda s: s != "")
    return title_case(text(F.get(cleaned, F.lit(0))))


def published_at(c: Column) -> Column:
    """Partial date (year, year-month or full) found in free text, else empty."""
    found = F.regexp_extract(
        F.replace(clean_metadata(c), F.lit("D:"), F.lit("")),
        r"(?:19|20)\d{2}(?:[-/]?\d{2})?(?:[-/]?\d{2})?",
        0,
    )
    full = F.regexp_replace(F.translate(found, "/", "-"), r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    return F.regexp_replace(full, r"^(\d{4})(\d{2})$", "$1-$2")


def sort_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", " "))


def title_token(c: Column) -> Column:
    """Form in which two titles are compared for equality."""
    return F.trim(F.regexp_replace(casefold(text(c)), "[^a-z0-9]+", " "))


def excerpt(line_array: Column) -> Column:
    return strip(F.substring(F.array_join(F.slice(line_array, 1, 4), " "), 1, 420))


def inferred_title(line_array: Column) -> Column:
    return bind(
        strip(text(F.get(line_array, F.lit(0)))),
        lambda first: F.when((first != "") & (word_count(first) <= 16), F.substring(first, 1, 160)),
    )


def json_object_text(c: Column) -> Column:
    """The text from the first ``{`` to the last ``}``, or the whole text without one."""
    trimmed = strip(c)
    return F.coalesce(blank_to_null(F.regexp_extract(trimmed, r"(?s)\{.*\}", 0)), trimmed)


def safe_file_name(c: Column) -> Column:
    kept = strip_chars(F.regexp_replace(strip(c), "[^A-Za-z0-9._-]+", "-"), "-")
    return F.coalesce(blank_to_null(kept), F.lit("untitled"))


def epub_path(href: Column, relative_to: Column | None = None) -> Column:
    """Resolve a document link: no fragment or query, relative to a base, normalised."""

    def bare(c: Column) -> Column:
        return strip(F.regexp_extract(strip(text(c)), r"^[^#?]*", 0))

    path = bare(href)
    joined = F.regexp_replace(path, "^/+", "")
    if relative_to is not None:
        base = bare(relative_to)
        folder = F.regexp_extract(base, r"^(.*)/[^/]*$", 1)
        joined = (
            F.when(path == "", base)
            .when(F.startswith(path, F.lit("/")) | (folder == ""), joined)
            .otherwise(F.concat(folder, F.lit("/"), path))
        )
    parts = F.filter(F.split(joined, "/"), lambda s: ~s.isin("", "."))
    resolved = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(
            (s == "..") & (F.size(acc) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), acc), -1) != ".."),
            F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
        ).otherwise(F.array_append(acc, s)),
    )
    # A leading run of dots and slashes is dropped, so paths never leave the book.
    clean = F.regexp_replace(F.array_join(resolved, "/"), r"^[./]+", "")
    return F.when(F.contains(text(href), F.lit("://")) | (strip(text(href)) == ""), "").otherwise(clean)


# Labels of a table of contents that never name a chapter.
IGNORED_CHAPTER_LABELS = (
    "about the author",
    "about the book",
    "acknowledgements",
    "also by the author",
    "also by nigella lawson",
    "contents",
    "copyright",
    "cover",
    "dedication",
    "ecopyright",
    "for reference",
    "glossary",
    "guidance notes",
    "image",
    "images",
    "index",
    "introduction",
    "list of recipes",
    "list of tables",
    "note to readers",
    "recipes",
    "stockists",
    "thanks",
    "title",
    "title page",
)
CHAPTER_LABEL = r"(?i)^(?:chapter" + WORD_END + r"|\d+[.:)]\s|\d+\s+-\s)"


def is_ignored_chapter_label(c: Column) -> Column:
    return F.rtrim(F.lower(strip(c)), F.lit(":")).isin(*IGNORED_CHAPTER_LABELS)


def looks_like_chapter_label(c: Column) -> Column:
    return bind(
        c,
        lambda label: F.rlike(label, F.lit("[A-Za-z]"))
        & (F.rlike(label, F.lit(CHAPTER_LABEL)) | ~F.rlike(label, F.lit("[a-z]"))),
    )
