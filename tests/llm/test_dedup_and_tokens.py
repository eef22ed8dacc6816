"""Near duplicates and token counts against brute force."""

import random
import re
from collections import Counter, defaultdict

import pytest

from larder.llm import minhash, token_lengths
from larder.llm.components import components
from larder.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def shingles(text):
    words = WORD.findall(lowered(text))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_force(rows):
    sets = {i: shingles(t) for i, (_, t) in enumerate(rows)}
    owner, parent = defaultdict(list), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, s in sets.items():
        for shingle in s:
            owner[shingle].append(i)
    shared = Counter()
    for group in owner.values():
        shared.update((a, b) for k, a in enumerate(group) for b in group[k + 1 :])
    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n) and None not in (rows[a][0], rows[b][0]):
            parent[find(a)] = find(b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return Counter(
        (doc, len(sets[i]), least.get(find(i)), doc is None or doc == least[find(i)]) for i, (doc, _) in enumerate(rows)
    )


def check(df, rows):
    got = Counter(tuple(r) for r in minhash.near_duplicates(df).collect())
    assert got == brute_force(rows)


def test_near_duplicates_equal_brute_force(docs, rows):
    check(docs, [(d, t) for d, t, _ in rows])


@pytest.mark.parametrize("small, block", [(32, 400), (2, 30), (10**6, 1)])
def test_hot_group_needs_several_hubs(spark, monkeypatch, small, block):
    """Hundreds of near copies that are not all alike, chains, and a passage that all share."""
    draw = random.Random(5)
    base = [f"w{draw.randrange(900)}" for _ in range(90)]
    passage = [f"p{i}" for i in range(40)]
    data = []
    for i in range(240):
        words = list(base)
        for _ in range(draw.randrange(6)):
            words[draw.randrange(90)] = f"x{draw.randrange(10**6)}"
        data.append((i, " ".join(words)))
    for i in range(240, 400):
        data.append((i, " ".join(passage + [f"y{draw.randrange(10**6)}" for _ in range(40)])))
    for i in range(30):
        data.append((1000 + i, " ".join(f"c{k}" for k in range(6 * i, 6 * i + 100))))
    monkeypatch.setattr(minhash, "PAIRS_PER_ROW", 1)
    monkeypatch.setattr(minhash, "SMALL_GROUP", small)
    monkeypatch.setattr(minhash, "BLOCK_NODES", block)
    check(spark.createDataFrame(data, "doc_id bigint, text string"), data)


def test_no_rows_and_only_edges(spark, nothing):
    assert minhash.near_duplicates(nothing).count() == 0
    rows = [(1, None), (2, ""), (3, "a b"), (4, "A  b"), (5, "a b c"), (None, "a b"), (3, "a b")]
    check(spark.createDataFrame(rows, "doc_id bigint, text string"), rows)


def test_keep_one_keeps_columns_and_clean_documents(spark, docs, rows, nothing):
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    alone = [(d, t or "") for d, t, _ in rows if d is None or not shingles(t)]
    got = Counter((r.doc_id, r.text or "") for r in kept.select("doc_id", "text").collect())
    want = {d for (d, n, _, k) in brute_force([(d, t) for d, t, _ in rows]) if k and n and d is not None}
    assert got - Counter(alone) == Counter({(d, t): 1 for d, t in dict((d, (d, t)) for d, t, _ in reversed(rows) if d in want).values()})
    assert Counter(alone) - got == Counter()
    assert minhash.keep_one(nothing).count() == 0


def test_keep_one_judges_texts_not_ids(spark):
    texts = [" ".join(f"{c}{i}" for i in range(60)) for c in "abc"]
    data = [(3, texts[0]), (5, texts[0]), (5, texts[1]), (5, texts[1]), (7, texts[2]), (7, texts[2] + " more"), (9, texts[2])]
    data += [(8, ""), (8, ""), (None, texts[0])]
    df = spark.createDataFrame(data, "doc_id bigint, text string").selectExpr("*", "1 as _id", "'x' as _text")
    got = Counter((r.doc_id, (r.text or "")[:2], r._id, r._text) for r in minhash.keep_one(df).collect())
    assert got == Counter({(3, "a0", 1, "x"): 1, (5, "b0", 1, "x"): 1, (7, "c0", 1, "x"): 1, (8, "", 1, "x"): 2, (None, "a0", 1, "x"): 1})


def test_very_long_texts(spark):
    """Texts of 10 MB: a near copy meets its original, an exact one as well."""
    words = [f"w{i * i % 1_000_003}" for i in range(1_300_000)]
    long = " ".join(words)
    data = [(1, long), (2, " ".join(words[:-20_000])), (3, long), (4, " ".join(words[:400_000])), (5, "x" * 10_000_000)]
    got = {r.doc_id: (r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(data, "doc_id bigint, text string")).collect()}
    assert got == {1: (1, True), 2: (1, False), 3: (1, False), 4: (4, True), 5: (5, True)}


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 9), (5, 5)] + [(i, i + 1) for i in range(20, 60)] + [(100, i) for i in range(101, 160)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 5: 5, **{i: 20 for i in range(20, 61)}, **{i: 100 for i in range(100, 160)}}
    assert got == want


def test_token_counts_are_the_librarys(spark, docs, rows, nothing):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    texts = [
        (1, "a  b\n\n c <|endoftext|> d<|endoftext|>e"), (2, " lead and trail "), (3, "  x  y \x1c z  \t"),
        (4, "don't we'll 12 34 " * 3), (5, "x" * 5000), (6, "你好 " * 50), (7, "a " * 3 + " " * 40 + "b"),
    ]
    want = Counter()
    for doc, text in [(d, t) for d, t, _ in rows] + texts:
        n = len(whole.encode(text or "", add_special_tokens=False))
        want[(doc, len((text or "").encode()), n, n > 512)] += 1
    df = docs.select("doc_id", "text").union(spark.createDataFrame(texts, "doc_id bigint, text string"))
    assert Counter(tuple(r) for r in token_lengths.token_counts(df, tokenizer_path()).collect()) == want
    assert token_lengths.token_counts(nothing, tokenizer_path()).count() == 0


def test_token_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(token_lengths, "MOST_KEPT", 5)
    lengths = token_lengths.Lengths(tokenizer_path(), batch_bytes=16)
    texts = ["one two three four five six seven", None, "eight nine " + "z" * 100, "one two"]
    whole = [len(lengths._tokenizer.encode(t or "")) for t in texts]
    assert [n for t in texts for n in lengths.of([t])] == whole
    assert len(lengths._known) <= 7
    assert list(token_lengths.balanced(["aa", "bb", "ccccc", "d"], 4)) == [["aa", "bb"], ["ccccc"], ["d"]]
