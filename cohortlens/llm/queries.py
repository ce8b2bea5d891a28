"""The registered queries of this subpackage and the comparison SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlens.llm import (archives, covertree, decontaminate, feistel, html_blocks, mixing, phrases, resampling, simhash, suffix_tree, token_codec,
                            token_counts, toxicity)
from cohortlens.llm.common import table

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
LIMIT = 2048


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, ranks = token_codec.tokenize_to_files(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)
    return token_codec.with_crc32(token_codec.read_files(files, ranks))


def op2_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op3_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.label_documents(table(spark, sf_dir, "documents"))


def op4_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.link_vectors(table(spark, sf_dir, "embeddings"))


def op5_hypergeometric_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op6_toxic_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_documents(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", toxicity.held_out("doc_id", 5).alias("held_out"), "score", "predicted")


def op7_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feistel.documents_to_shards(table(spark, sf_dir, "documents"))


def op8_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score_texts(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, tokenizer_path(), limit=LIMIT).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op10_benchmark_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark")).drop("text")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resampling.resample(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


def op12_phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine_phrases(table(spark, sf_dir, "documents").select("text", "lang")).drop("left", "right")


def op13_revisit_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.archive_round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_token_codec, op2_html_blocks, op3_simhash_ball, op4_cover_tree, op5_hypergeometric_mix, op6_toxic_neighbours, op7_feistel_shards,
    op8_suffix_tree, op9_token_counts, op10_benchmark_windows, op11_importance_resampling, op12_phrase_index, op13_revisit_archives, pipeline)}

_OP4 = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  AND list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)) >= 0.95),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(b, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(b, vec_id)) AS kept
FROM embeddings LEFT JOIN low ON low.a = vec_id LEFT JOIN n ON n.a = vec_id
"""

_WORDS10 = r"""list_filter(string_split(regexp_replace(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '')"""

_OP10 = f"""
WITH d AS (SELECT doc_id, {_WORDS10.format(t="text")} AS w FROM documents),
i AS (SELECT item_id, {_WORDS10.format(t="text")} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 9], ' ') AS win, least(len(w), 10) AS n FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
placed AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, k, placed.n, item_id FROM placed JOIN win USING (win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _op7(shards: int = 8, seed: int = 42) -> str:
    """The network in DuckDB SQL: ``side`` from the row count, one column per round, walking by recursion."""
    cols, p = "x // a AS l0, x % a AS r0", feistel.PRIME
    steps = []
    for i, (k, c) in enumerate(feistel.round_keys(seed)):
        t = f"((r{i} + {k}) % {p})"
        steps.append(f"SELECT *, r{i} AS l{i + 1}, (l{i} + (({t} * {t}) % {p} * (({t} + {c}) % {p})) % {p}) % a AS r{i + 1}")
    sql = f"SELECT doc_id, a, n, {cols} FROM {{source}}"
    for s in steps:
        sql = f"{s} FROM ({sql})"
    last = len(steps)
    once = f"SELECT doc_id, a, n, l{last} * a + r{last} AS x FROM ({sql})"
    rows = "SELECT doc_id, row_number() OVER (ORDER BY doc_id NULLS FIRST) - 1 AS x, count(*) OVER () AS n FROM documents"
    sized = f"SELECT doc_id, x, n, CASE WHEN n <= 1 THEN 1 ELSE floor(sqrt((n - 1)::DOUBLE))::BIGINT + 1 END AS a FROM ({rows})"
    crc = feistel.crc32_sql("encode(coalesce(text, ''))", "byte_table")
    return f"""
WITH RECURSIVE start AS ({sized}),
walk AS (({once.format(source="start")}) UNION ALL ({once.format(source="(SELECT * FROM walk WHERE x >= n)")}))
SELECT doc_id, (octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS size, {crc}::BIGINT AS text_crc32,
  'rows' AS law, (x % {shards})::INTEGER AS shard, (x // {shards})::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM walk JOIN documents USING (doc_id), (SELECT {feistel.crc32_table_sql()} AS byte_table) WHERE x < n
"""


def _op11(buckets: int = 10_000, percent: int = 10, least_words: int = 20) -> str:
    """Words are hashed once each; gains per bucket, noise from the id, and one ranking of all scores."""
    crc = feistel.crc32_sql("encode(word)", "byte_table")
    return f"""
WITH d AS (SELECT doc_id, {_WORDS10.format(t="text")} AS w FROM documents),
dw AS (SELECT doc_id, unnest(w) AS word FROM d),
bw AS (SELECT unnest(w) AS word FROM (SELECT {_WORDS10.format(t="text")} AS w FROM benchmark)),
hashed AS (SELECT word, {crc} % {buckets} AS bucket FROM (SELECT word FROM dw UNION SELECT word FROM bw), (SELECT {feistel.crc32_table_sql()} AS byte_table)),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM bw JOIN hashed USING (word) GROUP BY bucket),
total AS (SELECT (SELECT count(*) FROM dw)::DOUBLE AS s_all, (SELECT count(*) FROM bw)::DOUBLE AS t_all),
gain AS (
  SELECT b.range AS bucket, floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * (s_all + {buckets}) / ((coalesce(s.n, 0) + 1.0::DOUBLE) * (t_all + {buckets}))))::BIGINT AS gain
  FROM range({buckets}) b CROSS JOIN total LEFT JOIN s ON s.bucket = b.range LEFT JOIN t ON t.bucket = b.range),
weight AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM dw JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN weight USING (doc_id)),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n
  FROM scored WHERE n_features >= {least_words})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {percent} * n // 100 THEN rank END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""


def _op12(longest: int = 4, least: int = 30, contained: int = 80, top: int = 2000) -> str:
    """All runs of words by unnesting, with the parts of every cut and the runs inside every candidate."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    runs = "\nUNION ALL ".join(
        f"SELECT lang, {k} AS size, array_to_string(w[i:i + {k - 1}], ' ') AS phrase FROM (SELECT lang, w, unnest(range(1, len(w) - {k} + 2)) AS i FROM piece WHERE len(w) >= {k})"
        for k in range(1, longest + 1))
    return rf"""
WITH piece AS (
  SELECT lang, list_filter(string_split(replace(p, chr(9), ' '), ' '), lambda x: x <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({lower}, '[.,;:!?
-]')) AS p FROM documents)),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM piece GROUP BY lang),
gram AS (SELECT lang, size, phrase, count(*)::BIGINT AS f FROM ({runs}) GROUP BY ALL HAVING count(*) >= {least}),
split AS (SELECT lang, size, phrase, f, string_split(phrase, ' ') AS w FROM gram WHERE size > 1),
inside AS (
  SELECT lang, array_to_string(w[i:j], ' ') AS phrase, max(f) AS longer
  FROM (SELECT lang, size, w, f, i, unnest(range(i + 1, size + 1)) AS j FROM (SELECT *, unnest(range(1, size)) AS i FROM split)) WHERE j - i + 1 < size GROUP BY ALL),
cut AS (
  SELECT lang, phrase, f, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, size)) AS k FROM split)),
scored AS (
  SELECT c.lang, c.phrase, c.f AS a, k, h.f AS l, t.f AS r, ((2000000::HUGEINT * c.f) // (h.f + t.f))::BIGINT AS score
  FROM cut c JOIN gram h ON h.lang = c.lang AND h.phrase = head JOIN gram t ON t.lang = c.lang AND t.phrase = rest),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank
  FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase WHERE coalesce(longer, 0) * 100 < a * {contained})
SELECT lang, rank::BIGINT AS rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= {top}
"""


def _op13() -> str:
    """Base32 by shifting five bytes at a time; the largest page id of a payload is its response."""
    part = "('0x' || substr(h, {at}, 10))::BIGINT"
    letters = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({part.format(at=1 + 10 * p)} >> {35 - 5 * i}) & 31)::INTEGER + 1, 1)"
                          for p in range(4) for i in range(8))
    return f"""
WITH page AS (SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS original FROM pages)
SELECT page_id, payload_bytes, {letters} AS payload_digest, CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> original THEN original END AS refers_to
FROM (SELECT page_id, original, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS h FROM page)
"""


ORACLE = {"op4_cover_tree": _OP4, "op7_feistel_shards": _op7(), "op10_benchmark_windows": _OP10,
          "op11_importance_resampling": _op11(), "op12_phrase_index": _op12(), "op13_revisit_archives": _op13()}
