"""The registered queries of the training-text operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import (
    bloom_lm,
    html_template,
    metric_join,
    minhash,
    mixing,
    packing,
    piece_table,
    quality_knn,
    quality_rules,
    resident_lloyd,
    shard_tree,
    token_lengths,
    transport_stream,
)

TOKENIZER = "byte_bpe_50k.json"
SHARDS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_minhash(spark, d):
    return minhash.near_duplicates(table(spark, d, "documents"))


def op2_best_fit_packing(spark, d):
    return packing.pack(table(spark, d, "documents"))


def op3_knn_quality(spark, d):
    return quality_knn.quality_scores(table(spark, d, "documents"), table(spark, d, "labels"))


def op4_shard_tree(spark, d):
    tree = shard_tree.regular_tree(SHARDS)
    return shard_tree.assign_shards(table(spark, d, "documents"), tree, shard_tree.grown(tree))


def op5_rule_ledger(spark, d):
    entries = quality_rules.ledger(table(spark, d, "documents"))
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality_rules.passes("base")).alias("base_failed"), quality_rules.passes().alias("kept"), "failed_rules",
    )


def op6_mixing(spark, d):
    return mixing.mix(table(spark, d, "documents"))[1]


def op7_template_removal(spark, d):
    return html_template.extract_main_text(table(spark, d, "pages"))


def op8_bloom_lm(spark, d):
    return bloom_lm.log_scores(table(spark, d, "documents"))


def op9_transport_stream(spark, d):
    media = transport_stream.write_streams(table(spark, d, "documents"))
    read = transport_stream.read_streams(media)
    payload = F.col("stream.payload")
    return read.select(
        "doc_id", "n_bytes",
        F.octet_length(payload).cast("bigint").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        transport_stream.feature_text(F.col("stream")).alias("feature"),
    )


def op10_token_counts(spark, d):
    return token_lengths.token_counts(table(spark, d, "documents"), tokenizer_path())


def op11_resident_lloyd(spark, d):
    codes, codebooks = resident_lloyd.vector_codes(table(spark, d, "embeddings"))
    return resident_lloyd.with_label_error(codes).select(
        "vec_id", "code", "error", "label_error",
        F.lit(resident_lloyd.codebooks_digest(codebooks)).alias("codebooks_sha256"),
    )


def op12_metric_join(spark, d):
    return metric_join.near_vectors(table(spark, d, "embeddings"))


def op13_piece_table(spark, d):
    made = piece_table.fill_in_middle(table(spark, d, "documents"))
    return piece_table.restore(made).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash,
        op2_best_fit_packing,
        op3_knn_quality,
        op4_shard_tree,
        op5_rule_ledger,
        op6_mixing,
        op7_template_removal,
        op8_bloom_lm,
        op9_transport_stream,
        op10_token_counts,
        op11_resident_lloyd,
        op12_metric_join,
        op13_piece_table,
    )
}

def _lloyd_sql() -> str:
    """Two rounds and the last assignment, over one row for each vector and part."""
    whole = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    steps = [
        f"""kept AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label,
            list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings WHERE {whole})""",
        "parts AS (SELECT r, p, v[p * (len(v) // 16) + 1:(p + 1) * (len(v) // 16)] AS v FROM kept, range(16) AS t(p))",
        "book0 AS (SELECT p, r - 1 AS e, v FROM parts WHERE r <= 64)",
    ]
    for k in range(3):
        steps.append(
            f"""near{k} AS (SELECT x.r, x.p, min({{'d': list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': b.e}}) AS n
            FROM parts x JOIN book{k} b ON x.p = b.p GROUP BY x.r, x.p)"""
        )
        if k < 2:
            steps.append(
                f"""means{k} AS (SELECT p, e, list(m ORDER BY j) AS v FROM (
                SELECT x.p, n.n.e AS e, j, CAST((sum(x.v[j]) - ((sum(x.v[j]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m
                FROM parts x JOIN near{k} n ON x.r = n.r AND x.p = n.p, unnest(range(1, len(x.v) + 1)) AS u(j) GROUP BY x.p, n.n.e, j) GROUP BY p, e)"""
            )
            steps.append(f"book{k + 1} AS (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN means{k} m ON b.p = m.p AND b.e = m.e)")
    steps.append("codes AS (SELECT r, string_agg(lpad(lower(hex(n.e)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(n.d) AS BIGINT) AS error FROM near2 GROUP BY r)")
    steps.append("told AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS s FROM book2)")
    return f"""WITH {", ".join(steps)}
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, s AS codebooks_sha256
    FROM kept JOIN codes USING (r), told"""


_WORDS = r"regexp_extract_all({x}, '[^\x20\x09-\x0D]+')"

SQL = {
    # All pairs that share a shingle, exactly; then everything reachable over links.
    "op1_minhash": f"""WITH RECURSIVE
    words AS (SELECT doc_id, {_WORDS.format(x="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
    sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
    shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS k FROM sets),
    common AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM shingles a JOIN shingles b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM common WHERE 100 * c >= 75 * (na + nb - c)),
    reach AS (SELECT doc_id, doc_id AS seen FROM sets UNION SELECT links.b, reach.seen FROM reach JOIN links ON links.a = reach.doc_id)
    SELECT doc_id, any_value(n) AS n_shingles, min(seen) AS component_id, min(seen) = doc_id AS kept
    FROM reach JOIN (SELECT doc_id, len(s) AS n FROM sets) USING (doc_id) GROUP BY doc_id""",
    "op5_rule_ledger": f"""WITH
    read AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    parts AS (SELECT *, {_WORDS.format(x="t")} AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM read),
    windows AS (SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(w[i:i + 7], ' ')) AS c FROM parts, unnest(range(1, len(w) - 6)) AS u(i)),
    covered AS (SELECT r, count(DISTINCT i + d) AS n FROM windows, range(8) AS v(d) WHERE c > 1 GROUP BY r),
    measured AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_capitals,
        len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM parts LEFT JOIN covered USING (r)),
    failed AS (SELECT *, CAST(n_words < 20 AS INT) + 2 * CAST(n_repeat_words * 100 > n_words * 30 AS INT) + 4 * CAST(n_symbols * 100 > n_words * 10 AS INT)
        + 8 * CAST(n_dup_lines * 100 > n_lines * 50 AS INT) + 16 * CAST(word_chars < n_words * 2 OR word_chars > n_words * 20 AS INT)
        + 32 * CAST(n_capitals * 100 > word_chars * 50 AS INT) AS failed_rules FROM measured)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_rules & 3 <> 0 AS base_failed, failed_rules = 0 AS kept, failed_rules FROM failed""",
    "op6_mixing": f"""WITH
    sized AS (SELECT doc_id, source, len({_WORDS.format(x="coalesce(text, '')")}) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
    sources AS (SELECT *, [3, 1, 2][(no - 1) % 3 + 1] AS weight FROM (
        SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM sized GROUP BY source)),
    levels AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - (sum(source_size * 2) OVER w - source_size * 2))
        / (sum(weight) OVER () - sum(weight) OVER w + weight) AS level FROM sources WINDOW w AS (ORDER BY source_size * 2 / weight, no)),
    targets AS (SELECT no, source, source_size, least(CAST(source_size * 2 AS DOUBLE), greatest(max(level) OVER (), 0.0) * weight) AS target FROM levels),
    placed AS (SELECT p.*, source_size, target, no, CAST(round(target) AS BIGINT) AS quota FROM (
        SELECT row_number() OVER () AS r, *, sum(size) OVER (PARTITION BY source ORDER BY key, size ROWS UNBOUNDED PRECEDING) - size AS start FROM sized) p
        JOIN targets t ON p.source IS NOT DISTINCT FROM t.source),
    spans AS (SELECT r, no, start + e * source_size AS a, least(start + e * source_size + size, quota) AS b FROM placed, range(2) AS t(e)),
    needed AS (SELECT no, CAST(ceil(round(target) / 4096) AS BIGINT) AS blocks FROM targets WHERE round(target) > 0),
    stretches AS (SELECT no, blocks, sum(blocks) OVER (ORDER BY no) - blocks AS first, sum(blocks) OVER () AS slots FROM needed),
    points AS (SELECT n, (n * 0.6180339887498949::DOUBLE) % 1 AS x FROM range((SELECT CAST(coalesce(sum(blocks), 0) AS BIGINT) FROM needed)) AS t(n)),
    drawn AS (SELECT no, n, row_number() OVER (PARTITION BY no ORDER BY n) - 1 AS rank FROM points, stretches
        WHERE x >= first / CAST(slots AS DOUBLE) AND x < (first + blocks) / CAST(slots AS DOUBLE)),
    schedule AS (SELECT s.no, s.rank, coalesce(n, slots + first + s.rank) AS slot FROM (
        SELECT no, first, slots, unnest(range(blocks)) AS rank FROM stretches) s LEFT JOIN drawn d ON s.no = d.no AND s.rank = d.rank),
    pieces AS (SELECT r, no, b - a AS words, unnest(range(CAST(a // 4096 AS BIGINT), CAST((b - 1) // 4096 + 1 AS BIGINT))) AS rank FROM spans WHERE b > a),
    firsts AS (SELECT r, min(slot) AS first_slot FROM pieces JOIN schedule USING (no, rank) GROUP BY r)
    SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
        CAST((SELECT coalesce(sum(b - a), 0) FROM spans WHERE spans.r = placed.r AND b > a) AS BIGINT) AS taken, CAST(first_slot AS BIGINT) AS first_slot
    FROM placed LEFT JOIN firsts USING (r)""",
    "op11_resident_lloyd": _lloyd_sql(),
    "op12_metric_join": """WITH RECURSIVE
    read AS (SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    whole AS (SELECT * FROM read WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
    links AS (SELECT a.r AS a, b.r AS b FROM whole a JOIN whole b ON a.label = b.label AND a.r <> b.r AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
    reach AS (SELECT r, r AS seen FROM read UNION SELECT links.b, reach.seen FROM reach JOIN links ON links.a = reach.r),
    least AS (SELECT reach.r, min(o.vec_id) AS component_id FROM reach JOIN read o ON o.r = reach.seen GROUP BY reach.r)
    SELECT vec_id, coalesce(n, 0) AS n_links, component_id, coalesce(vec_id = component_id, true) AS kept
    FROM read JOIN least USING (r) LEFT JOIN (SELECT a AS r, count(*) AS n FROM links GROUP BY a) USING (r)""",
    "op13_piece_table": r"""WITH
    units AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
    drawn AS (SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM units),
    formed AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
        least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM drawn),
    cuts AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM formed),
    made AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS o FROM cuts),
    back AS (SELECT *, string_split(replace(replace(o, '<P>', '<M>'), '<S>', '<M>'), '<M>') AS x FROM made)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
        sha256(o) AS output_sha256, sha256(CASE form WHEN 'plain' THEN o WHEN 'psm' THEN x[2] || x[4] || x[3] ELSE x[3] || x[4] || x[2] END) AS restored_sha256 FROM back""",
}
