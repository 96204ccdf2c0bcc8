"""Queries of the operators of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import fingerprint, lexical, line_dedup, ngram_join, packing, pieces, quality, secrets, sharding, spelling, substring_index, suffix_dedup, topk
from quillspark.session import ship
from quillspark.sources import table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return table(spark, sf_dir, "documents")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(documents(spark, sf_dir), words=4, percent=85)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), table(spark, sf_dir, "labels")).drop("key_a", "key_b")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_index.dedup_substrings(documents(spark, sf_dir))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_deleted", "n_runs", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segmentations, and digests of their ids and of what they decode to."""
    model = tokenizer_file("piece_bpe_32k.model")
    return pieces.decode_pieces(pieces.sample_segmentations(documents(spark, sf_dir), model), model, digest_only=True)


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(documents(spark, sf_dir))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_suffixes(documents(spark, sf_dir))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word of the corpus, the frequent word at distance one that it may be a variant of, and where such forms lead."""
    return spelling.spelling_variants(documents(spark, sf_dir))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that rank highest for each benchmark item."""
    return lexical.ranked_search(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of each document: what the patterns find, and what a random field fitted to that adds; not the secrets themselves."""
    return secrets.scan_secrets(documents(spark, sf_dir)).drop("secrets")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_sharding": op3_sharding,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_packing": op5_packing,
    "op6_line_dedup": op6_line_dedup,
    "op7_piece_sampling": op7_piece_sampling,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_document_fingerprints": op9_document_fingerprints,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_ranked_search": op12_ranked_search,
    "op13_secret_scan": op13_secret_scan,
}

ORACLE: dict[str, str] = {
    "op1_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w
  FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS s FROM w),
c AS (SELECT s, min(doc_id) AS rep, len(s) AS n FROM s GROUP BY s),
x AS (SELECT rep, n, unnest(s) AS g FROM c),
p AS (SELECT a.rep AS a, b.rep AS b, count(*) AS shared, any_value(a.n) AS na, any_value(b.n) AS nb FROM x a JOIN x b ON a.g = b.g AND a.rep < b.rep GROUP BY a.rep, b.rep),
l AS (SELECT a, b FROM p WHERE 100 * shared >= 85 * (na + nb - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT rep AS a, rep AS b FROM c UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
k AS (SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE k.least END AS component_id
FROM s JOIN c ON c.s = s.s JOIN k ON k.a = c.rep""",
    "op4_substring_dedup": r"""
WITH t AS (
  SELECT doc_id, w, len(w) AS n FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL)),
s AS (SELECT doc_id, w, unnest(range(1, n - 48)) AS p FROM t WHERE n >= 50),
h AS (SELECT doc_id, p, sha256(array_to_string(w[p:p + 49], ' ')) AS k FROM s),
f AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY k) AS least FROM h),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS i FROM f WHERE least < doc_id),
g AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM t),
kept AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.i) AS text FROM x LEFT JOIN gone ON gone.doc_id = x.doc_id AND gone.i = x.i WHERE gone.i IS NULL GROUP BY x.doc_id)
SELECT t.doc_id, CAST(t.n AS BIGINT) AS n_words, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM t LEFT JOIN g ON g.doc_id = t.doc_id LEFT JOIN kept ON kept.doc_id = t.doc_id""",
    "op8_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op12_ranked_search": r"""
WITH t AS (
  SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
s AS (SELECT count(*) AS n_docs, sum(len(w)) AS n_terms FROM t WHERE len(w) > 0),
i AS (
  SELECT item_id, item, term, count(*) AS times
  FROM (SELECT item_id, text AS item, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL))
  GROUP BY ALL),
p AS (
  SELECT doc_id, row, n, term, count(*) AS tf FROM (SELECT doc_id, row, len(w) AS n, unnest(w) AS term FROM t)
  WHERE term IN (SELECT term FROM i) GROUP BY ALL),
d AS (SELECT term, count(*) AS df FROM p GROUP BY term),
w AS (SELECT item_id, item, term, times * CAST(floor(1000 * ln((2.0 * n_docs + 2) / (2.0 * df + 1))) AS BIGINT) AS w FROM i JOIN d USING (term), s),
r AS (
  SELECT item_id, item, doc_id, row, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM w JOIN p USING (term), s GROUP BY ALL),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id, item ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10""",
    "op6_line_dedup": """
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
w AS (SELECT doc_id, n, lead(doc_id, 2) OVER o AS last_id, [line, lead(line, 1) OVER o, lead(line, 2) OVER o] AS lines
  FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY n)),
r AS (SELECT doc_id, n, row_number() OVER (PARTITION BY lines ORDER BY doc_id, n) AS k FROM w WHERE last_id IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, n + s AS n FROM r, (VALUES (0), (1), (2)) t(s) WHERE k > 1),
marked AS (SELECT l.doc_id, l.n, l.line, g.n IS NOT NULL AS gone,
    coalesce(lag(g.n IS NOT NULL) OVER (PARTITION BY l.doc_id ORDER BY l.n), false) AS gone_before
  FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.n = l.n)
SELECT d.doc_id, count(m.n) AS n_lines, count(m.n) FILTER (WHERE gone) AS n_deleted,
  count(m.n) FILTER (WHERE gone AND NOT gone_before) AS n_runs,
  sha256(coalesce(string_agg(m.line, chr(10) ORDER BY m.n) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM documents d LEFT JOIN marked m ON m.doc_id = d.doc_id GROUP BY d.doc_id""",
}
