"""Vector codes, the metric join and fill-in-middle against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from larder.llm import metric_join, piece_table, resident_lloyd

EMBEDDED = "vec_id bigint, embedding array<float>, label int"


def vectors_like(spark, rows):
    extra = "7 as row, 'x' as code, 1 as node, 2 as cell, true as guest, 3 as n_links, 'y' as part, 5 as entry, 1.5 as error"
    return spark.createDataFrame(rows, EMBEDDED).selectExpr("*", *extra.split(", "))


@pytest.fixture(scope="module")
def embedded(spark):
    """Vectors of the smallest data, near and exact copies, repeated rows, NULLs and odd values."""
    base = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    rng = np.random.default_rng(5)
    rows = list(base)
    for k in range(60):
        near = np.array(base[k % 7][1]) + rng.normal(0, 0.006, 64)
        rows.append((10_000 + k, near.astype(np.float32).tolist(), base[k % 7][2]))
    rows += [(20_000 + k, base[0][1], base[0][2]) for k in range(5)] + [base[3], base[3]]
    rows.append((20_010, [4 * x for x in base[0][1]], base[0][2]))
    rows.append((20_011, base[0][1], None))
    rows.append((20_012, base[0][1], None))
    rows.append((20_013, None, 1))
    rows.append((20_014, [None, *base[0][1][1:]], base[0][2]))
    rows.append((20_015, [float("nan"), *base[0][1][1:]], base[0][2]))
    rows.append((20_016, [float("inf"), *base[0][1][1:]], base[0][2]))
    rows.append((20_017, [0.0] * 64, base[0][2]))
    rows.append((20_018, [], base[0][2]))
    rows.append((None, base[0][1], base[0][2]))
    return rows


def whole(vector):
    return bool(vector) and all(x is not None and math.isfinite(x) for x in vector)


def lloyd(rows, parts=16, entries=64, rounds=2):
    kept = [r for r in rows if whole(r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = [[[math.floor(256 * x) for x in r[1][p * width : (p + 1) * width]] for p in range(parts)] for r in kept]
    books = [[cut[i][p] for i in range(min(entries, len(cut)))] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry, strict=True)), e) for e, entry in enumerate(book))

    for _ in range(rounds):
        changed = []
        for p in range(parts):
            members = defaultdict(list)
            for row in cut:
                members[nearest(row[p], books[p])[1]].append(row[p])
            changed.append([
                [sum(c) // len(members[e]) for c in zip(*members[e], strict=True)] if e in members else old
                for e, old in enumerate(books[p])
            ])
        books = changed
    found = [[nearest(row[p], books[p]) for p in range(parts)] for row in cut]
    codes = [("".join(f"{e:02x}" for _, e in row), sum(d for d, _ in row)) for row in found]
    text = ",".join(str(x) for book in books for entry in book for x in entry)
    return Counter((r[0], r[2], *c) for r, c in zip(kept, codes, strict=True)), hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("shape", [(16, 64, 2), (8, 5, 3), (4, 256, 1), (16, 64, 0)])
def test_vector_codes_equal_brute_force(spark, embedded, shape):
    codes, books = resident_lloyd.vector_codes(vectors_like(spark, embedded), parts=shape[0], entries=shape[1], rounds=shape[2])
    want, digest = lloyd(embedded, *shape)
    assert Counter(tuple(r) for r in codes.select("vec_id", "label", "code", "error").collect()) == want
    assert resident_lloyd.codebooks_digest(books) == digest


def test_label_errors_add_up(spark, embedded):
    codes, _ = resident_lloyd.vector_codes(vectors_like(spark, embedded))
    rows = resident_lloyd.with_label_error(codes).collect()
    sums = defaultdict(int)
    for r in rows:
        sums[r.label] += r.error
    assert None in sums and all(r.label_error == sums[r.label] for r in rows)


def test_vector_codes_of_large_components_and_few_rows(spark):
    rows = [(i, [random.Random(i).uniform(-2e5, 2e5) for _ in range(64)], 1) for i in range(90)]
    rows = [(i, np.array(v, np.float32).tolist(), lab) for i, v, lab in rows]
    codes, books = resident_lloyd.vector_codes(vectors_like(spark, rows))
    want, digest = lloyd(rows)
    assert Counter(tuple(r) for r in codes.select("vec_id", "label", "code", "error").collect()) == want
    assert resident_lloyd.codebooks_digest(books) == digest
    for few in ([], [(1, None, 1)], [(1, [], 1)]):
        codes, books = resident_lloyd.vector_codes(vectors_like(spark, few))
        assert resident_lloyd.with_label_error(codes).count() == 0 and books.size == 0
    codes, books = resident_lloyd.vector_codes(vectors_like(spark, rows[:1] * 3))
    assert {(r.code, r.error) for r in codes.collect()} == {("00" * 16, 0)} and books.shape == (16, 3, 4)
    # Another length than that of the least id goes.
    codes, _ = resident_lloyd.vector_codes(vectors_like(spark, [*rows[:3], (99, [1.0] * 32, 1), (98, [1.0] * 3, 1)]))
    assert sorted(r.vec_id for r in codes.collect()) == [0, 1, 2]


def test_only_members_that_change_entry_are_dealt_anew(spark, embedded, monkeypatch):
    dealt = []
    deal = resident_lloyd._dealt
    monkeypatch.setattr(resident_lloyd, "_dealt", lambda df: dealt.append(df.count()) or deal(df))
    resident_lloyd.vector_codes(vectors_like(spark, embedded))
    kept = sum(whole(r[1]) for r in embedded)
    assert dealt[0] == 16 * kept and 0 < dealt[1] < dealt[0] / 2


def test_nearest_takes_the_lowest_of_equal_entries():
    parts = np.array([[0, 0], [5, 5]])
    book = np.array([[9, 9], [1, 0], [0, 1], [1, 0]])
    assert resident_lloyd.nearest(parts, book)[0].tolist() == [1, 0]
    big = book * (1 << 25)
    assert resident_lloyd.nearest(parts, big)[0].tolist() == [1, 1]


def linked(rows, cosine=0.98):
    units = {}
    for i, (_, vector, label) in enumerate(rows):
        if label is not None and whole(vector) and any(vector):
            v = np.array(vector, np.float64)
            units[i] = v / np.linalg.norm(v)
    near, parent = Counter(), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in units:
        for b in units:
            if a < b and rows[a][2] == rows[b][2] and len(units[a]) == len(units[b]) and units[a] @ units[b] >= cosine:
                near[a] += 1
                near[b] += 1
                parent[find(a)] = find(b)
    least = {}
    for i, row in enumerate(rows):
        if row[0] is not None:
            least[find(i)] = min(row[0], least.get(find(i), row[0]))
    component = [least.get(find(i)) for i in range(len(rows))]
    return Counter((r[0], near[i], c, r[0] is None or r[0] == c) for i, (r, c) in enumerate(zip(rows, component, strict=True)))


def joined(spark, rows, **more):
    return Counter(tuple(r) for r in metric_join.near_vectors(vectors_like(spark, rows), **more).collect())


def test_metric_join_equals_brute_force(spark, embedded):
    assert joined(spark, embedded) == linked(embedded)


@pytest.mark.parametrize("cosine", [0.35, 0.98])
def test_metric_join_over_many_cells_and_blocks(spark, embedded, monkeypatch, cosine):
    """Cells of few nodes and blocks of fewer, so that all kinds of blocks arise."""
    monkeypatch.setattr(metric_join, "CELL_NODES", 8)
    monkeypatch.setattr(metric_join, "BLOCK_NODES", 7)
    rows = [(i, v, 1 if lab is not None and lab < 5 else lab) for i, v, lab in embedded if v is None or len(v) != 32]
    assert joined(spark, rows, cosine=cosine) == linked(rows, cosine)


def test_metric_join_of_odd_input(spark):
    assert joined(spark, []) == Counter()
    rows = [(1, None, 1), (None, None, None), (2, [1.0, 0.0], 1), (3, [1e-30, 0.0], 1), (4, [1.0, 0.0, 0.0], 1), (5, [2.0, 0.0], 1), (6, [-0.0, 1.0], 1), (7, [0.0, 1.0], 1)]
    assert joined(spark, rows) == linked(rows)


def test_guests_reach_every_cell_with_a_partner():
    """Random pairs at the threshold: one of the two is a guest where the other is at home."""
    rng = np.random.default_rng(11)
    pivots = metric_join.directions(rng.normal(size=(40, 6)))
    left = metric_join.directions(rng.normal(size=(4000, 6)))
    side = rng.normal(size=left.shape)
    side = metric_join.directions(side - (side * left).sum(axis=1, keepdims=True) * left)
    right = 0.98 * left + math.sqrt(1 - 0.98**2) * side
    (home_l, guest_l), (home_r, guest_r) = (metric_join.cells_of(x, pivots, math.sqrt(1 - 0.98**2)) for x in (left, right))
    at = np.arange(len(left))
    met = (home_l == home_r) | guest_l[at, home_r] | guest_r[at, home_l]
    assert met.all() and (home_l != home_r).sum() > 500 and guest_l.mean() < 0.3


UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def middle_filled(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    spelt = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(spelt[i : i + 8], 16) for i in range(0, 32, 8)]
    sha = hashlib.sha256(text.encode()).hexdigest()
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, n, "plain", None, None, text, sha, sha
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 80 else "psm"
    out = f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, form, len(p), len(m), out, hashlib.sha256(out.encode()).hexdigest(), sha


def pieced(df):
    made = piece_table.fill_in_middle(df)
    kept = made.withColumnRenamed("output", "o").selectExpr("*", "o as output")
    columns = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "o", "output_sha256", "restored_sha256", "restored"]
    return [tuple(r) for r in piece_table.restore(kept).select(*columns).collect()]


def test_fill_in_middle_equals_brute_force(docs, rows):
    got = pieced(docs)
    assert Counter(r[:-1] for r in got) == Counter(middle_filled(d, t) for d, t, _ in rows)
    texts = Counter(t or "" for _, t, _ in rows)
    assert Counter(r[-1] for r in got) == texts
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_fill_in_middle_of_odd_and_very_long_texts(spark, nothing):
    rng = random.Random(3)
    pieces = ["<", "<P", "S>", "<S", "é", "\U0001f600", " ", "\n", "\t\t", "word", "M>", ">"]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(40))) for _ in range(600)]
    texts += ["a <P> b", "<S>", "x<M>", " ", "\n\n", "x" * 10_000_000, "word " * 2_000_000, None, ""]
    given = [(i, t) for i, t in enumerate(texts)]
    given += [(i + 10_000, t) for i, t in enumerate(texts[-4:-2])]
    got = pieced(spark.createDataFrame(given, "doc_id bigint, text string"))
    assert Counter(r[:-1] for r in got) == Counter(middle_filled(d, t) for d, t in given)
    assert all(r[-1] == (dict(given)[r[0]] or "") for r in got)
    assert pieced(nothing) == []


def test_cutting_and_arranging_descriptors():
    whole_text = [piece_table.Piece(0, 0, 4), piece_table.Piece(1, 2, 8)]
    for a in range(11):
        for b in range(a, 11):
            parts = piece_table.cut(whole_text, [a, b])
            spelt = [b"".join(piece_table.spelled(x, b"abcd", b"..efghij")) for x in parts]
            assert spelt == [b"abcdefghij"[:a], b"abcdefghij"[a:b], b"abcdefghij"[b:]]
