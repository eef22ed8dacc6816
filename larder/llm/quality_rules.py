"""Quality rules as a ledger of failure bits.

Each rule is evaluated once for a document and leaves one bit beside the measurements it rests on.
Policies are named masks over the bits, so a new version of a policy, or the effect of leaving a
rule out, is read from the ledger without touching a text again. Built-in expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.text import bind
from larder.llm.common import SPACES, WORD, text_of, words_of

WINDOW = 8
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Name and bit of each rule; bits never change their meaning, new rules take new bits.
RULES = ("few_words", "repeated_words", "many_symbols", "repeated_lines", "odd_word_length", "capitals")
# Versions of the policy; a document is kept when it fails none of the named rules.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "many_symbols", "repeated_lines"),
    "v2": RULES,
}
POLICY = "v2"


def mask_of(rules: tuple[str, ...]) -> int:
    return sum(1 << RULES.index(rule) for rule in rules)


def repeated_words(words: Column) -> Column:
    """Words that lie in an 8-word window found twice or more, the first occurrence included."""

    def keys(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - (WINDOW - 1))
        every = F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
        return F.when(F.size(w) >= WINDOW, every).otherwise(F.array().cast("array<bigint>"))

    def covered(k: Column) -> Column:
        ordered = F.sort_array(F.transform(k, lambda x, i: F.struct(x.alias("key"), i.alias("at"))))

        def places(o: Column) -> Column:
            twice = F.filter(
                o,
                lambda e, j: e["key"].eqNullSafe(F.get(o, j - 1)["key"]) | e["key"].eqNullSafe(F.get(o, j + 1)["key"]),
            )
            return F.sort_array(F.transform(twice, lambda e: e["at"]))

        def length(p: Column) -> Column:
            steps = F.transform(
                p, lambda at, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - at, F.lit(WINDOW)))
            )
            return F.aggregate(steps, F.lit(0).cast("bigint"), lambda total, step: total + step)

        return bind(bind(ordered, places), length)

    return bind(
        bind(words, keys),
        lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0).cast("bigint")).otherwise(covered(k)),
    )


def _without(c: Column, characters: str) -> Column:
    return F.length(F.translate(c, characters, "")).cast("bigint")


def measurements(text: Column) -> dict[str, Column]:
    """What the rules look at, as columns over a text."""
    words = words_of(text)
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.rlike(line, F.lit(WORD)))
    both = bind(
        words, lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), repeated_words(w).alias("n_repeat_words"))
    )
    line_counts = bind(
        lines,
        lambda x: F.struct(
            F.size(x).cast("bigint").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        ),
    )
    length = F.length(text).cast("bigint")
    return {
        "words": both,
        "lines": line_counts,
        "word_chars": _without(text, SPACES),
        "n_symbols": length - _without(text, SYMBOLS),
        "n_capitals": length - _without(text, CAPITALS),
    }


def _failures() -> Column:
    """The failure bits over measured columns."""
    failed = {
        "few_words": F.col("n_words") < 20,
        "repeated_words": F.col("n_repeat_words") * 100 > F.col("n_words") * 30,
        "many_symbols": F.col("n_symbols") * 100 > F.col("n_words") * 10,
        "repeated_lines": F.col("n_dup_lines") * 100 > F.col("n_lines") * 50,
        "odd_word_length": (F.col("word_chars") < F.col("n_words") * 2) | (F.col("word_chars") > F.col("n_words") * 20),
        "capitals": F.col("n_capitals") * 100 > F.col("word_chars") * 50,
    }
    bits = F.lit(0)
    for i, rule in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(failed[rule], F.lit(1 << i)).otherwise(F.lit(0)))
    return bits


_MEASURED = ("n_words", "word_chars", "n_symbols", "n_capitals", "n_lines", "n_dup_lines", "n_repeat_words")


def ledger(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """Measurements and ``failed_rules`` of every row of ``docs``.

    With ``keep`` the given columns stay under a struct ``row``, else only the id stays as
    ``doc_id``. A NULL text is empty, and an empty text fails ``few_words`` alone. Ids may be NULL
    or repeated; columns of ``docs`` named as the results do not matter.
    """
    held = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row") if keep else F.col(doc_id).alias("doc_id")
    named = "row" if keep else "doc_id"
    read = docs.select(held, text_of(text).alias("_text"))
    parts = measurements(F.col("_text"))
    measured = read.select(named, *[column.alias(name) for name, column in parts.items()])
    flat = measured.select(
        named, F.col("words.n_words").alias("n_words"), "word_chars", "n_symbols", "n_capitals",
        F.col("lines.n_lines").alias("n_lines"), F.col("lines.n_dup_lines").alias("n_dup_lines"),
        F.col("words.n_repeat_words").alias("n_repeat_words"),
    )
    return flat.withColumn("failed_rules", _failures())


def passes(policy: str = POLICY, failed: str = "failed_rules") -> Column:
    return F.col(failed).bitwiseAND(F.lit(mask_of(POLICIES[policy]))) == 0


def ablations(entries: DataFrame, policy: str = POLICY) -> DataFrame:
    """For each rule of a policy: rows that fail it, that only it rejects, and that stay without it.

    The ledger is reduced to one count for each combination of bits before rules are looked at.
    """
    mask = mask_of(POLICIES[policy])
    combined = entries.groupBy("failed_rules").agg(F.count("*").alias("_rows"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES.index(r)).alias("bit")) for r in POLICIES[policy]])
    spread = combined.select("failed_rules", "_rows", F.explode(rules).alias("_r")).select("failed_rules", "_rows", "_r.*")
    bits = F.col("failed_rules").bitwiseAND(F.lit(mask))

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("_rows")).otherwise(F.lit(0)))

    return spread.groupBy("rule").agg(
        total(bits.bitwiseAND(F.col("bit")) != 0).alias("failing"),
        total(bits == F.col("bit")).alias("rejected_by_it_alone"),
        total(bits.bitwiseAND(F.bitwise_not("bit")) == 0).alias("kept_without_it"),
    )


def keep_good(docs: DataFrame, policy: str = POLICY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that a policy keeps, with their columns as given.

    NULL and empty texts have too few words and go under the given policies; NULL ids change nothing, each of repeated
    rows is judged alike, and no rows give none.
    """
    return ledger(docs, doc_id, text, keep=True).where(passes(policy)).select("row.*")
