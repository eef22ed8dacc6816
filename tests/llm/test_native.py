"""Rule ledger, shard tree and mixing against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from larder.llm import mixing, quality_rules, shard_tree

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measured(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    covered = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines),
        "n_capitals": sum("A" <= c <= "Z" for c in text),
    }


def test_ledger_measures(spark, docs, rows, nothing):
    loops = [(1, "a b c d e f g h i a b c d e f g h"), (2, "x " * 30), (3, "l one\nl one\n \nl one"), (4, "t u v w x y z a " * 2 + "q " * 9)]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(loops, "doc_id bigint, text string"))
    got = quality_rules.ledger(df).collect()
    want = Counter((d, *sorted(measured(t).items())) for d, t in [(d, t) for d, t, _ in rows] + loops)
    assert Counter((r.doc_id, *sorted((k, r[k]) for k in measured(""))) for r in got) == want
    for r in got:
        base = r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words
        assert bool(r.failed_rules & quality_rules.mask_of(quality_rules.POLICIES["base"])) == base
    assert quality_rules.ledger(nothing).count() == 0
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_ablations_from_bits(docs):
    entries = quality_rules.ledger(docs)
    bits = [r.failed_rules for r in entries.collect()]
    for policy, rules in quality_rules.POLICIES.items():
        mask = quality_rules.mask_of(rules)
        for r in quality_rules.ablations(entries, policy).collect():
            bit = 1 << quality_rules.RULES.index(r.rule)
            assert r.failing == sum(b & bit != 0 for b in bits)
            assert r.rejected_by_it_alone == sum(b & mask == bit for b in bits)
            assert r.kept_without_it == sum(b & mask & ~bit == 0 for b in bits)


def fraction(text):
    return (int(hashlib.md5(text.encode()).hexdigest()[:13], 16) + 0.5) / 2**52


def descend(key, tree):
    path, level = "", [(f"/{x.region}", f"/{x.region}/{x.rack}", f"/{x.region}/{x.rack}/{x.shard}", x.weight) for x in tree]
    for depth in range(3):
        weights = defaultdict(float)
        for x in level:
            weights[x[depth]] += x[3]
        path = min(weights, key=lambda n: -math.log(fraction(key + n)) / weights[n])
        level = [x for x in level if x[depth] == path]
    return int(path.split("/")[-1])


def test_shards(docs, rows, nothing):
    tree = shard_tree.regular_tree(16)
    more = shard_tree.grown(tree)
    got = shard_tree.assign_shards(docs, tree, more).collect()
    want = Counter()
    for d, t, _ in rows:
        key, raw = "" if d is None else str(d), (t or "").encode()
        want[(d, len(raw) + 1, zlib.crc32(raw), "key", descend(key, tree), descend(key, more))] += 1
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shard_tree.assign_shards(nothing, tree).count() == 0


def test_weight_changes_stay_in_their_subtree(spark):
    tree = shard_tree.regular_tree(16)
    heavier = [shard_tree.Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 5 else 1.0) for x in tree]
    keys = spark.range(4000).selectExpr("id as doc_id", "'' as text")
    moved = [r for r in shard_tree.assign_shards(keys, tree, heavier).collect() if r.shard != r.grown_shard]
    assert moved
    for r in moved:  # into the region, rack or shard whose weight grew, and nowhere else
        if r.shard // 8 == 0:
            assert r.grown_shard // 4 == 1
            assert r.grown_shard == 5 or r.shard // 4 != 1
        else:
            assert r.grown_shard // 8 == 0


def water_level(sizes, recipe):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: recipe.weights[i % len(recipe.weights)] for i, s in enumerate(order)}
    target, left = dict.fromkeys(order, 0.0), recipe.ratio * sum(sizes.values())
    full = set()
    while left > 1e-9 and len(full) < len(order):
        share = left / sum(weight[s] for s in order if s not in full)
        left = 0.0
        for s in [s for s in order if s not in full]:
            target[s] += share * weight[s]
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                full.add(s)
    return target


@pytest.mark.parametrize("block", [7, 4096])
def test_mix(docs, rows, block):
    recipe = mixing.Recipe(block_words=block)
    stream, shares = mixing.mix(docs, recipe)
    sizes, by_source = Counter(), Counter()
    for d, t, s in rows:
        sizes[(d, len(WORD.findall(t or "")))] += 1
        by_source[s] += len(WORD.findall(t or ""))
    want = water_level(by_source, recipe)
    got = shares.collect()
    assert Counter((r.doc_id, r.size) for r in got) == sizes
    source_of = {d: s for d, _, s in rows}
    taken = Counter()
    for r in got:
        assert r.source_size == by_source[source_of[r.doc_id]]
        assert r.target == pytest.approx(want[source_of[r.doc_id]])
        assert 0 <= r.taken <= 2 * r.size
        taken[source_of[r.doc_id]] += r.taken
    for s, n in taken.items():
        assert abs(n - want[s]) <= 0.5
    pieces = stream.collect()
    assert sum(p.word_to - p.word_from for p in pieces) == sum(taken.values())
    slots = defaultdict(lambda: [0, set()])
    for p in pieces:
        slots[p.slot][0] += p.word_to - p.word_from
        slots[p.slot][1].add((p.source, p.block))
    assert all(n <= block and len(names) == 1 for n, names in slots.values())
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs, recipe)[1].collect()), key=str)


def test_every_stretch_of_the_schedule_is_balanced(spark):
    quotas = {1: 6000, 2: 3000, 3: 990, 4: 10}
    targets = spark.createDataFrame([(k, v * 8) for k, v in quotas.items()], "_no int, _quota bigint")
    rows = mixing.schedule(targets, mixing.Recipe(block_words=8)).collect()
    assert Counter(r._no for r in rows) == quotas and len({r.slot for r in rows}) == 10000
    for begin in range(0, 9500, 500):
        part = Counter(r._no for r in rows if begin <= r.slot < begin + 500)
        assert abs(part[1] - 300) <= 4 and abs(part[2] - 150) <= 4


def test_mix_edges(spark, nothing):
    assert mixing.mix(nothing)[1].count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id bigint, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mixing.mix(blank)[1].collect()] == [(0, 0.0, 0)] * 2
    assert mixing.mixed_documents(blank).count() == 0


def test_mixed_documents(docs):
    recipe = mixing.Recipe(block_words=50)
    mixed = mixing.mixed_documents(docs, recipe)
    assert mixed.columns == docs.columns
    words = sum(len(WORD.findall(r.text)) for r in mixed.collect())
    assert words == sum(r.taken for r in mixing.mix(docs, recipe)[1].collect())
