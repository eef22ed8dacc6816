"""Ingredient text: normalising, canonical names, line parsing. Columns in, Columns out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions.text import (
    ANY_WS,
    WORD_END,
    WORD_START,
    WS,
    bind,
    blank_to_null,
    casefold,
    squash,
    strip,
    strip_chars,
    text,
)

# Canonical names.
CANONICAL_ALIASES = {
    "cheddar cheese": "cheddar",
    "feta cheese": "feta",
    "goats cheese": "goat cheese",
    "goat s cheese": "goat cheese",
    "gruyere cheese": "gruyere",
    "halloumi cheese": "halloumi",
    "linguine pasta": "linguine",
    "mozzarella cheese": "mozzarella",
    "orzo pasta": "orzo",
    "parmesan cheese": "parmesan",
    "pecorino cheese": "pecorino",
    "penne pasta": "penne",
    "ricotta cheese": "ricotta",
    "rigatoni pasta": "rigatoni",
    "spaghetti pasta": "spaghetti",
    "tagliatelle pasta": "tagliatelle",
}
PASTA_SHAPES = (
    "cavatappi", "conchiglie", "farfalle", "fusilli", "linguine", "macaroni", "orzo",
    "paccheri", "pappardelle", "penne", "rigatoni", "spaghetti", "tagliatelle",
)
CHEESES_WITHOUT_SUFFIX = (
    "cheddar", "feta", "gruyere", "halloumi", "mozzarella", "parmesan", "pecorino", "ricotta",
)

# How quantities and units are written.
FRACTIONS = "[¼½¾⅓⅔⅛]"
LEADING_QUANTITY = (
    r"(?i)^\s*(?:about\s+)?(?:(?:\d+\s*[./-]?\s*\d*)|(?:\d+\s*x\s*\d+)|" + FRACTIONS + r"+)\s*"
)
LEADING_UNIT = (
    r"(?i)^((?:g|kg|ml|l|oz|lb|lbs|tbsp|tsp|teaspoon(?:s)?|tablespoon(?:s)?|clove(?:s)?|"
    r"sprig(?:s)?|bunch(?:es)?|handful(?:s)?|medium|small|large))" + WORD_END
)
# Per source: bracket handling, quantity, unit and trailing rules of a line's name.
SOURCE_NAME_RULES = {
    "nytimes": (
        (r"\([^)]*\)", ""),
        (
            r"(?i)^\s*(?:\d+(?:\s+\d+/\d+)?(?:/\d+)?|[¼½¾⅓⅔⅛]|a|an)"
            r"(?:\s*(?:to|-)\s*(?:\d+(?:/\d+)?|[¼½¾⅓⅔⅛]))?\s*",
            "",
        ),
        (
            r"(?i)^(?:cup|cups|tablespoon|tablespoons|tbsp|teaspoon|teaspoons|tsp|ounce|ounces|oz|"
            r"pound|pounds|lb|lbs|gram|grams|g|kilogram|kilograms|kg|milliliter|milliliters|ml|"
            r"liter|liters|l|quart|quarts|pint|pints|can|cans|clove|cloves|bunch|bunches|small|"
            r"medium|large)(?:$|([^\p{L}\p{N}_]))\s*",
            "$1",
        ),
        (r"^\s+", ""),
        (r"(?i)^(?:of\s+)", ""),
    ),
    "jamie-oliver": (
        (r"\([^)]*\)", ""),
        (r"(?i)^optional:\s*", ""),
        (
            r"(?i)^\s*(?:\d+(?:\s+\d+/\d+)?(?:/\d+)?|\d+\s*x\s*\d+|[¼½¾⅓⅔⅛]|a|an|one|two|three|four|five)\s*",
            "",
        ),
        (
            r"(?i)^(?:x\s*\d+\s+([\p{L}\p{N}_])|(?:g|kg|ml|l|tbsp|tsp|teaspoon(?:s)?|tablespoon(?:s)?|"
            r"sachet|sachets|large|medium|small)(?:$|([^\p{L}\p{N}_]))\s*)",
            "$1$2",
        ),
    ),
    "bbc-goodfood": (
        (r"^\s*(?:\d+(?:\s*/\s*\d+)?|[¼½¾⅓⅔⅛]|pinch|few|small|medium|large)\s*", ""),
        (
            r"^(?:g|kg|ml|l|tbsp|tsp|tablespoon(?:s)?|teaspoon(?:s)?|plain)(?:$|([^\p{L}\p{N}_]))\s*",
            "$1",
        ),
    ),
    "waitrose-recipes": (
        (r"(?i)^\s*(?:\d+(?:[./]\d+)?|[¼½¾⅓⅔⅛]|handful)\s*", ""),
        (r"(?i)^(?:g|kg|ml|l|tbsp|tsp|pack|jar|bag)(?:$|([^\p{L}\p{N}_]))\s*", "$1"),
    ),
}


def _without_asides(c: Column, instead: str) -> Column:
    """Brackets replaced, with the white space before them; a text without any is not searched."""
    return bind(
        c, lambda v: F.when(F.contains(v, F.lit("(")), F.regexp_replace(v, ANY_WS + r"*\([^)]*\)", instead)).otherwise(v)
    )


def normalize_ingredient(c: Column) -> Column:
    value = bind(
        casefold(text(c)),
        lambda v: F.when(F.startswith(v, F.lit("optional:")), F.regexp_replace(v, f"^optional:{ANY_WS}*", "")).otherwise(v),
    )
    value = F.regexp_replace(_without_asides(value, " "), f"^(?:a|an|the){ANY_WS}+", "")
    return F.trim(F.regexp_replace(value, "[^a-z0-9]+", " "))


def _canonical_lookup() -> Column:
    names = {f"{shape} pasta": shape for shape in PASTA_SHAPES}
    names |= {f"{cheese} cheese": cheese for cheese in CHEESES_WITHOUT_SUFFIX}
    names |= CANONICAL_ALIASES
    return F.create_map(*(F.lit(v) for pair in names.items() for v in pair))


def canonical_of_normalized(c: Column) -> Column:
    """Canonical name of text that is normalised already."""
    return bind(c, lambda n: F.coalesce(F.element_at(_canonical_lookup(), n), n))


def canonical_ingredient(c: Column) -> Column:
    return canonical_of_normalized(normalize_ingredient(c))


def ingredient_payload(
    raw: Column,
    normalized_name: Column,
    quantity: Column | None = None,
    unit: Column | None = None,
    item: Column | None = None,
    preparation: Column | None = None,
    optional: Column | None = None,
) -> Column:
    """The stored form of an ingredient line, with its defaults filled in."""
    none = F.lit(None).cast("string")
    item = none if item is None else item
    source = F.coalesce(blank_to_null(normalized_name), blank_to_null(item), strip(text(raw)))
    name = F.coalesce(blank_to_null(normalize_ingredient(source)), F.lit("ingredient"))

    def optional_text(c: Column | None) -> Column:
        return none if c is None else blank_to_null(strip(c))

    return bind(name, lambda normalized: F.struct(
        strip(text(raw)).alias("raw"),
        normalized.alias("normalized_name"),
        F.coalesce(blank_to_null(canonical_ingredient(normalized)), normalized).alias("canonical_name"),
        optional_text(quantity).alias("quantity"),
        optional_text(unit).alias("unit"),
        optional_text(item).alias("item"),
        optional_text(preparation).alias("preparation"),
        (F.lit(False) if optional is None else F.coalesce(optional, F.lit(False))).alias("optional"),
    ))


def index_name(canonical: Column, normalized: Column, raw: Column) -> Column:
    """Name under which an ingredient line is indexed; empty when nothing is left."""
    second = blank_to_null(normalize_ingredient(normalized))
    return F.coalesce(
        blank_to_null(normalize_ingredient(canonical)),
        canonical_ingredient(F.coalesce(second, normalize_ingredient(raw))),
    )


def extracted_name(c: Column) -> Column:
    value = _without_asides(casefold(c), " ")
    value = strip(
        F.regexp_replace(value, r"(^|[^\p{L}\p{N}_])(?:for|plus)(?:[^\p{L}\p{N}_].*)?$", "$1")
    )
    value = F.regexp_replace(value, f"^(?:a|an|the){ANY_WS}+", "")
    return F.coalesce(blank_to_null(normalize_ingredient(value)), F.lit("ingredient"))


def parse_ingredient_line(raw: Column) -> Column:
    """Quantity, unit, item and preparation of one written line, as the stored struct."""
    return bind(squash(raw), _parsed)


def _parsed(cleaned: Column) -> Column:
    preparation = strip(F.regexp_replace(cleaned, "^[^,]*,?", ""))
    optional = F.contains(casefold(cleaned), F.lit("optional"))

    def with_item(quantity: Column, unit: Column, item: Column) -> Column:
        name = extracted_name(F.coalesce(blank_to_null(item), cleaned))
        return ingredient_payload(cleaned, name, quantity, unit, item, preparation, optional)

    def with_unit(quantity: Column, remainder: Column, unit: Column) -> Column:
        rest = F.regexp_replace(F.substr(remainder, F.length(unit) + 1), f"^{WS}+", "")
        item = strip_chars(_without_asides(rest, ""), " .;:-")
        return bind(F.regexp_replace(item, f"(?i)^of{WS}+", ""), lambda i: with_item(quantity, unit, i))

    def with_quantity(base: Column, quantity: Column) -> Column:
        return bind(
            F.substr(base, F.length(quantity) + 1),
            lambda rest: bind(F.regexp_extract(rest, LEADING_UNIT, 1), lambda unit: with_unit(quantity, rest, unit)),
        )

    return bind(
        F.regexp_extract(cleaned, "^[^,]*", 0),
        lambda base: bind(F.regexp_extract(base, LEADING_QUANTITY, 0), lambda q: with_quantity(base, q)),
    )


def source_ingredient_name(raw: Column, source: str) -> Column:
    """Name of a line under the rules of one source; falls back to the line itself."""
    value = strip(F.translate(raw, "\u00a0", " "))
    for pattern, replacement in SOURCE_NAME_RULES[source]:
        value = F.regexp_replace(value, pattern, replacement)
    return normalize_ingredient(F.regexp_extract(value, "^[^,]*", 0))


def shopping_label(raw: Column, key: Column) -> Column:
    """Keep the written line where it says more than the key (decimals, commas, choices)."""
    return bind(strip(text(raw)), lambda line: _label_of(line, key))


def _label_of(line: Column, key: Column) -> Column:
    same = squash(casefold(line)) == squash(casefold(key))
    telling = (
        F.rlike(line, F.lit(r"\d+\.\d+"))
        | F.contains(line, F.lit(","))
        | F.rlike(line, F.lit(f"(?i){WORD_START}or{WORD_END}"))
        | F.contains(line, F.lit("/"))
    )
    return F.when((line != "") & ~same & telling, line).otherwise(key)
