"""Best-fit packing of documents into sequences of several permitted lengths.

Pieces of equal length are alike, so the packing is planned on the histogram of lengths, which has
no more entries than the largest permitted length, however many documents there are. Lengths are
placed from the longest down. A piece goes to the open bin it fits best; when none has room, a bin
is opened in the size with the least cost for each word it can expect to hold, given what is left
to place. At the end each bin takes the smallest permitted length for its contents. The plan works
on groups of like bins, and says which bins the i-th piece of a length fills.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import id_text, md5_fraction, stored, text_of, word_count

LENGTHS = (512, 1024, 2048, 4096)
PARTS = 1024


@dataclass(frozen=True)
class Costs:
    """Cost of a bin: its words, a share that grows with their square, and a fixed part."""

    square: float = 1.0 / 16384
    fixed: float = 16.0

    def of(self, length: int) -> float:
        return length + self.square * length * length + self.fixed


@dataclass
class Group:
    """Bins of like contents: how many, the opened size, and runs ``(length, copies)``."""

    bins: int
    size: int
    runs: list[tuple[int, int]] = field(default_factory=list)
    used: int = 0

    def room(self) -> int:
        return self.size - self.used

    def add(self, length: int, copies: int) -> None:
        self.used += length * copies
        if self.runs and self.runs[-1][0] == length:
            copies += self.runs.pop()[1]
        self.runs.append((length, copies))


class Plan:
    """Groups of bins for a histogram of lengths."""

    def __init__(self, histogram: dict[int, int], lengths: tuple[int, ...] = LENGTHS, costs: Costs = Costs()):
        self._sizes = sorted(lengths)
        self._costs = costs
        self._open: dict[int, list[Group]] = {}  # by room left
        self._rooms: list[int] = []
        self._left = sum(n * c for n, c in histogram.items())
        for length in sorted((n for n in histogram if n > 0), reverse=True):
            self._left -= length * histogram[length]
            self._place(length, histogram[length])
        self.groups = [g for room in sorted(self._open) for g in self._open[room]]

    def _keep(self, group: Group) -> None:
        room = group.room()
        if room not in self._open:
            self._open[room] = []
            insort(self._rooms, room)
        self._open[room].append(group)

    def _take(self, length: int) -> Group | None:
        """The open group with the least room for ``length``."""
        at = bisect_left(self._rooms, length)
        if at == len(self._rooms):
            return None
        room = self._rooms[at]
        group = self._open[room].pop()
        if not self._open[room]:
            del self._open[room]
            self._rooms.pop(at)
        return group

    def _place(self, length: int, count: int) -> None:
        while count:
            group = self._take(length)
            if group is None:
                size = self._best_size(length, count)
                self._keep(Group(-(-count // (size // length)), size))
                continue
            # A bin stays the best fit for this length until it has no room for another.
            copies = min(group.room() // length, -(-count // group.bins))
            filled = min(group.bins, count // copies)
            if filled < group.bins:
                rest = Group(group.bins - filled, group.size, list(group.runs), group.used)
                self._keep(rest)
            group.bins = filled
            group.add(length, copies)
            self._keep(group)
            count -= filled * copies

    def _best_size(self, length: int, count: int) -> int:
        supply = count * length + self._left

        def cost(size: int) -> float:
            bins = -(-count // (size // length))
            return self._costs.of(size) / min(size, supply / bins)

        return min((s for s in self._sizes if s >= length), key=lambda s: (cost(s), s))

    def final_size(self, group: Group) -> int:
        return self._sizes[bisect_left(self._sizes, group.used)]

    def slots(self) -> list[tuple[int, int, int, int, int, int, int]]:
        """``(length, first, last, first_bin, bins, sequence_length, offset)``: the pieces ranked
        first..last of a length fill the bins in turn, again and again, from an offset on."""
        found, seen, bin_ = [], {}, 0
        for group in self.groups:
            offset = 0
            for length, copies in group.runs:
                first = seen.get(length, 0)
                last = first + copies * group.bins - 1
                found.append((length, first, last, bin_, group.bins, self.final_size(group), offset))
                seen[length] = last + 1
                offset += length * copies
            bin_ += group.bins
        return found


_SLOTS = "_length int, _first bigint, _last bigint, _bin bigint, _bins bigint, sequence_length int, _offset int"


def pack(
    docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, costs: Costs = Costs(), doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(doc_id, piece, word_from, word_to, n_words, sequence, sequence_length, sequence_offset)``.

    A document longer than the largest length is cut into pieces of that length and a rest; words
    count from 0. Every word of every row lands in one sequence, repeated rows and rows without an
    id included. A NULL or empty text gives one row with NULLs and 0 words. No rows, no sequences.
    Other columns are ignored.
    """
    most = max(lengths)
    sized = docs.select(
        F.col(doc_id).alias("doc_id"), word_count(text_of(text)).alias("_words"),
        F.floor(md5_fraction(id_text(doc_id)) * PARTS).cast("int").alias("_part"),
    )
    pieces = F.when(F.col("_words") > 0, F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_words") - 1) / F.lit(most))))
    cut = sized.select("doc_id", "_words", "_part", F.explode_outer(pieces).alias("piece"))
    cut = stored(
        cut.withColumn("word_from", F.col("piece") * most)
        .withColumn("word_to", F.least("_words", F.col("word_from") + most))
        .withColumn("_length", F.coalesce(F.col("word_to") - F.col("word_from"), F.lit(0)).cast("int"))
        .drop("_words")
    )
    # At most one row for each length up to the largest.
    histogram = {r["_length"]: r["count"] for r in cut.where("_length > 0").groupBy("_length").count().collect()}
    slots = docs.sparkSession.createDataFrame(Plan(histogram, lengths, costs).slots(), _SLOTS)
    full = cut.where("_length > 0")
    counts = full.groupBy("_length", "_part").agg(F.count("*").alias("_rows"))
    ahead = Window.partitionBy("_length").orderBy("_part")
    before = counts.select("_length", "_part", (F.sum("_rows").over(ahead) - F.col("_rows")).alias("_before"))
    within = Window.partitionBy("_length", "_part").orderBy("doc_id", "piece")
    ranked = full.withColumn("_place", F.row_number().over(within)).join(before, ["_length", "_part"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_place") - 1)
    placed = ranked.join(slots, "_length").where("_rank between _first and _last")
    at = F.col("_rank") - F.col("_first")
    packed = placed.select(
        "doc_id", "piece", "word_from", "word_to", F.col("_length").cast("bigint").alias("n_words"),
        (F.col("_bin") + at % F.col("_bins")).alias("sequence"), "sequence_length",
        (F.col("_offset") + F.floor(at / F.col("_bins")) * F.col("_length")).alias("sequence_offset"),
    )
    none = cut.where("_length = 0").select(
        "doc_id", "piece", "word_from", "word_to", F.lit(0).cast("bigint").alias("n_words"),
        F.lit(None).cast("bigint").alias("sequence"), F.lit(None).cast("int").alias("sequence_length"),
        F.lit(None).cast("bigint").alias("sequence_offset"),
    )
    return packed.unionByName(none)
