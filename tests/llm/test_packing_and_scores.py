"""Packing, quality scores, language-model scores and the pipeline against brute force."""

import math
import re
import tracemalloc
import zlib
from bisect import insort
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from larder.llm import bloom_lm, minhash, mixing, packing, quality_knn, quality_rules
from larder.llm.common import slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def piece_by_piece(lengths, sizes, costs):
    """Best fit on single pieces, longest first; a run of equal pieces stays with its bin."""
    left, bins = sum(lengths), []  # open bins as [room, order, size]
    for length in sorted(set(lengths), reverse=True):
        count = lengths.count(length)
        left -= length * count
        fresh = 0
        for i in range(count):
            fitting = [b for b in bins if b[0] >= length]
            if fitting:
                best = min(fitting)
                bins.remove(best)
                insort(bins, [best[0] - length, best[1], best[2]])
                continue
            rest = count - i

            def cost(s, rest=rest, length=length):
                return costs.of(s) / min(s, (rest * length + left) / -(-rest // (s // length)))

            size = min((s for s in sizes if s >= length), key=lambda s: (cost(s), s))
            insort(bins, [size - length, len(bins) + fresh, size])
    return bins


@pytest.mark.parametrize("sizes", [(8, 16, 40), (10,)])
def test_plan_is_best_fit(sizes):
    draw = np.random.default_rng(3)
    for _ in range(30):
        lengths = [int(x) for x in draw.integers(1, max(sizes) + 1, draw.integers(1, 120))]
        plan = packing.Plan(dict(Counter(lengths)), sizes)
        assert sum(g.bins * sum(n * c for n, c in g.runs) for g in plan.groups) == sum(lengths)
        placed = Counter()
        for g in plan.groups:
            assert sum(n * c for n, c in g.runs) == g.used <= g.size
            for n, c in g.runs:
                placed[n] += c * g.bins
        assert placed == Counter(lengths)
        got = sum(plan.final_size(g) * g.bins for g in plan.groups)
        want = sum(min(s for s in sizes if s >= b[2] - b[0]) for b in piece_by_piece(lengths, sizes, packing.Costs()))
        assert got <= want * 1.1


def test_pack_places_every_word_once(docs, rows, nothing):
    for sizes in ((64, 128, 300), packing.LENGTHS):
        got = packing.pack(docs, sizes).collect()
        counts = Counter((d, len(WORD.findall(t or ""))) for d, t, _ in rows)
        pieces, bins = Counter(), defaultdict(list)
        for r in got:
            if r.n_words:
                assert r.word_to - r.word_from == r.n_words and r.word_from == r.piece * max(sizes)
                pieces[(r.doc_id, r.word_from, r.word_to)] += 1
                bins[r.sequence].append((r.sequence_offset, r.n_words, r.sequence_length))
        want = Counter()
        for (d, n), k in counts.items():
            for a in range(0, n, max(sizes)):
                want[(d, a, min(n, a + max(sizes)))] += k
        assert pieces == want
        assert sum(r.n_words == 0 for r in got) == sum(k for (_, n), k in counts.items() if not n)
        for held in bins.values():
            at = 0
            for offset, n, _ in sorted(held):
                assert offset == at
                at += n
            (size,) = {x[2] for x in held}
            assert size == min(s for s in sizes if s >= at)
    assert packing.pack(nothing).count() == 0


def test_quality_scores(spark, docs, nothing):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    base = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in quality_knn.quality_scores(base, labels).collect()}
    right = 0
    held = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    for r in held:
        assert got[r.doc_id].held_out
        right += got[r.doc_id].predicted == r.quality
    assert right >= 0.93 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    # Labels of the held-out fold change nothing.
    turned = labels.selectExpr("doc_id", "case when pmod(crc32(cast(doc_id as string)), 5) = 0 then 1 - quality else quality end as quality")
    again = {r.doc_id: r.score for r in quality_knn.quality_scores(base, turned).collect()}
    assert all(abs(again[d] - r.score) < 1e-6 for d, r in got.items())
    odd = spark.createDataFrame([(None, 1), (5, None), (6, 7), (10**9, 0)], "doc_id bigint, quality int")
    assert {r.score for r in quality_knn.quality_scores(docs, odd).collect()} == {0.5}
    assert quality_knn.quality_scores(docs, labels).count() == docs.count()
    assert quality_knn.quality_scores(nothing, labels).count() == 0
    assert quality_knn.keep_predicted(docs, labels).columns == docs.columns


def test_sample_is_drawn_from_documents_still_here(spark):
    labels = spark.range(4000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    # Few documents of class 0 are left, and nearly all of class 1.
    left = spark.range(4000).where("id % 2 = 1 or id % 100 = 0").selectExpr("id as doc_id", "concat('text ', id) as text")
    sample = quality_knn.training_sample(left, labels, per_class=20)
    assert Counter(r.label for r in sample.collect()) == {0: 20, 1: 20}
    words = {0: "zzz ### 1 2", 1: "a plain sentence of common words"}
    left = left.selectExpr("doc_id", f"concat(if(doc_id % 2 = 0, '{words[0]}', '{words[1]}'), ' ', doc_id % 7) as text")
    kept = quality_knn.keep_predicted(left, labels).collect()
    assert Counter(r.doc_id % 2 for r in kept) == {1: 2000}


def test_votes_are_the_exact_nearest():
    draw = np.random.default_rng(1)
    vectors = np.abs(draw.standard_normal((60, quality_knn.TERMS))).astype(np.float32)
    labels = draw.integers(0, 2, 60)
    space = quality_knn.Space(vectors, labels, 8)
    query = np.abs(draw.standard_normal((9, quality_knn.TERMS))).astype(np.float32)
    for q, score in zip(space.project(query), space.score(query, 5), strict=True):
        cosine = space.latent @ q
        near = np.argsort(-cosine)[:5]
        weight = np.maximum(cosine[near], 0) ** quality_knn.SHARPNESS + 1e-9
        assert score == pytest.approx((weight * labels[near]).sum() / weight.sum(), abs=1e-5)


def brute_scores(rows):
    """Base score, and the model with exact levels in place of the filter."""
    train = [t for d, t in rows if d is not None and zlib.crc32(str(d).encode()) % 10]
    single, pair, followers = Counter(), Counter(), Counter()
    for text in train:
        tokens = [*words_of(text), None]
        single.update(tokens)
        pair.update(zip([None, *tokens], tokens))
    followers.update(before for before, _ in pair)
    n, v = sum(single.values()), len(single)
    out = []
    for d, text in rows:
        tokens = [*words_of(text), None]
        base = model = 0.0
        for before, token in zip([None, *tokens], tokens):
            chance = (single[token] + 0.1) / (n + 0.1 * (v + 1))
            base += math.log10(chance)
            left = 0.75 * followers[before] / single[before] if single[before] else 1.0
            share, c = 0.0, pair[(before, token)]
            if c:
                level = bloom_lm.level_of(np.array([c]))
                share = (bloom_lm.count_of(level)[0] - 0.75) / single[before]
            model += math.log10(max(left, 1e-9) * chance) + math.log10(1 + share / (left * chance))
        out.append((d, len(tokens), sum(single[t] > 0 for t in tokens), n, base, model))
    return out


@pytest.mark.parametrize("most_words, piece_bytes", [(10**6, 1 << 24), (30, 1 << 24), (10**6, 1), (30, 20000)])
def test_log_scores(docs, rows, most_words, piece_bytes, monkeypatch):
    got = bloom_lm.log_scores(docs, most_words=most_words, piece_bytes=piece_bytes, segment_bytes=100_000).collect()
    want = brute_scores([(d, t) for d, t, _ in rows])

    def order(r):
        return (r[0] is None, r[0] or 0, r[1], r[4])

    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score, r.held_out) for r in got), key=order)
    worse = 0
    for g, w in zip(got, sorted(want, key=order), strict=True):
        assert g[:4] == w[:4]
        assert g[6] == (zlib.crc32(str(g[0] if g[0] is not None else "").encode()) % 10 == 0)
        assert g[4] == pytest.approx(w[4], rel=1e-9)
        assert g[5] >= w[5] - 1e-6 * abs(w[5])  # the filter errs upwards only
        worse += abs(g[5] - w[5]) > 0.02 * abs(w[5])
    assert worse <= 0.05 * len(got)


def test_word_counts_do_not_depend_on_the_vocabulary_held(docs):
    def scores(most_words):
        got = bloom_lm.log_scores(docs, most_words=most_words, segment_bytes=100_000).collect()
        return sorted((r.doc_id or 0, r.n_tokens, r.n_known, r.base_score, r.score) for r in got)

    for g, w in zip(scores(30), scores(10**6), strict=True):
        assert g == pytest.approx(w, rel=1e-9)


def test_log_scores_without_rows(spark, nothing):
    assert bloom_lm.log_scores(nothing).count() == 0
    held = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id bigint, text string")
    got = bloom_lm.log_scores(held).collect()
    assert sorted(r.n_tokens for r in got) == [1, 3] and {r.train_tokens for r in got} == {0}


def test_filter_has_no_false_negatives():
    hashes = bloom_lm.mixed(np.arange(60000, dtype=np.uint64))
    keys, counts = hashes & bloom_lm._KEY_MASK, np.arange(60000) % 50 + 1

    def piece(n):
        bits = bloom_lm.filter_bits(keys[:n], counts[:n])
        return bloom_lm.Piece(1, 0, np.array([0, len(bits)]), bits)

    mine, levels = piece(60000).levels(hashes)
    assert len(mine) == 60000 and (levels >= bloom_lm.level_of(counts)).all()
    assert (levels > bloom_lm.level_of(counts)).mean() < 0.01
    assert (piece(9000).levels(hashes[9000:])[1] > 0).mean() < 0.01


def test_pipeline_equals_its_operators(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "quality_classifier", "near_dedup", "mixing", "packing"]
    ok = {r.doc_id for r in quality_rules.ledger(docs).where(quality_rules.passes()).collect()}
    left = docs.where(docs.doc_id.isin(list(ok)))
    ok = {r.doc_id for r in quality_knn.quality_scores(left, labels).collect() if r.predicted}
    left = docs.where(docs.doc_id.isin(list(ok)))
    ok = {r.doc_id for r in minhash.near_duplicates(left).collect() if r.kept}
    left = docs.where(docs.doc_id.isin(list(ok)))
    taken = {r.doc_id: r.taken for r in mixing.mix(left)[1].collect() if r.taken}
    got = Counter()
    for r in pipeline.run(spark, sf_dir).collect():
        got[r.doc_id] += r.n_words
    assert got == Counter(taken)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs.limit(0), sf_dir)
        assert docs.count() == 0


def test_slices_are_cut_without_making_all_texts():
    for kind, values in ((pa.string(), ["aé\U0001f35e", None, "x" * 10, ""]), (pa.binary(), [b"abc", None, b"x" * 10, b""])):
        batch = pa.RecordBatch.from_arrays([pa.array(values, kind)], ["text"])
        assert [s.column(0).to_pylist() for s in slices([batch], "text", 4)] == [values[:2], values[2:3], values[3:]]
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 1000] * 5000)], ["text"])
    tracemalloc.start()
    assert sum(s.num_rows for s in slices([batch], "text", 100_000)) == 5000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1_000_000
