"""The queries op1 to op13 and pipeline, each over its whole table, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontamination, fill_in_middle, language_model, near_duplicates, packing, pii, prefix_trie, quality, rules, sharding, simhash, substring_dedup, toxicity
from quire.llm.shared import fold, save, table


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # the patterns run once: the saved candidates, without texts, serve training and scoring
    given = save(pii.candidates(docs).select("doc_id", pii.held_out(F.col("text")).alias("__held"), "__spans"), "spans")
    found = pii.find_spans(docs, pii.train_trees(docs, given=given), given)
    count = [F.expr(f"cast(size(filter(base, s -> s.kind = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(pii.KINDS)]
    return found.select("doc_id", *count, F.sha2(F.expr(pii.joined("base")), 256).alias("base_sha256"), F.expr(pii.joined("spans")).alias("spans"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted", "n_windows", "worst_start")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    model = quality.train_quality(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest, "contaminated")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.kd_shards(table(spark, sf_dir, "documents"), 24)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))


def tokenizer_files() -> dict[str, str]:
    import public_tokenizers

    return {"vocabulary": public_tokenizers.path("byte_bpe_50k.json"), "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), **tokenizer_files())


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.host_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_duplicates(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = fill_in_middle.restored(fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents")))
    digests = (F.sha2(F.col(c).cast("binary"), 256).alias(f"{n}_sha256") for c, n in (("output", "output"), ("restored", "restored")))
    return turned.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join, op2_pii, op3_toxicity, op4_quality, op5_decontamination, op6_sharding, op7_lm_scoring, op8_packing, op9_quality_rules, op10_substring_dedup,
        op11_prefix_trie, op12_simhash_near_dedup, op13_fill_in_middle, pipeline,
    )
}

_SPACE_WORD = r"[^\x20\x09-\x0D]+"
_ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP1 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, '{_SPACE_WORD}') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM w
), n AS (SELECT doc_id, len(s) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS h FROM s),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)
), r(x, y) AS (
  SELECT doc_id, doc_id FROM n UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x
)
SELECT n.doc_id, n.n AS n_shingles, min(r.y) AS component_id FROM n JOIN r ON r.x = n.doc_id GROUP BY 1, 2
"""

_OP5_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_OP5 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, '{_OP5_WORD}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_ASCII_LOWER.format("text")}, '{_OP5_WORD}') AS w FROM benchmark WHERE item_id IS NOT NULL),
sized AS (SELECT item, w, least(13, len(w)) AS k FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS h FROM (SELECT item, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM sized)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS h FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks)),
hit AS (SELECT DISTINCT doc_id, i, dw.k, item FROM dw JOIN bw ON dw.h = bw.h AND dw.k = bw.k),
places AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM (SELECT doc_id, i, unnest(range(0, k)) AS j FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_OP9 = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_SPACE_WORD}') AS w FROM documents
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '{_SPACE_WORD}') GROUP BY 1
), win AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, h) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT doc_id, i, unnest([0, 1, 2]) AS j FROM twice) GROUP BY 1),
c AS (
  SELECT d.doc_id, source, len(w) AS n_words, CAST(list_sum([length(x) FOR x IN w]) AS BIGINT) AS chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)
), j AS (
  SELECT *, coalesce(chars, 0) AS word_chars, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c
), h AS (
  SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed OR 100 * n_symbols > 10 * word_chars) AS x FROM j GROUP BY 1
), m AS (SELECT sum(x) / sum(n) AS p, sum(n) AS n, count(*) AS k, sum(x * x / n) AS sq, sum(n * n) AS nn FROM h),
q AS (SELECT p, least(0.999, greatest(1e-4, (sq - n * p * p - (k - 1) * p * (1 - p)) / greatest(n - nn / n - (k - 1), 1e-9) / (p * (1 - p)))) AS rho FROM m),
r AS (SELECT source, (x + p * (1 / rho - 1)) / (n + 1 / rho - 1) AS rate FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate <= 0.6 AS kept
FROM j JOIN r ON j.source IS NOT DISTINCT FROM r.source
"""

#: crc32 of a decimal by the table of its 256 bytes, made from the polynomial.
_OP11 = """
WITH RECURSIVE steps(b, k, v) AS (
  SELECT b, 0, b FROM range(256) t(b) UNION ALL SELECT b, k + 1, xor(v >> 1, 3988292384 * (v & 1)) FROM steps WHERE k < 8
), crc AS (SELECT list(v ORDER BY b) AS t FROM steps WHERE k = 8),
o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), t AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY pos) AS l FROM o GROUP BY 1),
h AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, l,
    xor(list_reduce(list_prepend(4294967295, [ord(x) FOR x IN string_split(CAST(conv_id AS VARCHAR), '')]), lambda c, x: xor(c >> 8, crc.t[(xor(c, x) & 255) + 1])), 4294967295) % 9 AS h
  FROM t, crc
), r AS (
  SELECT h.conv_id, CASE WHEN h.conv_id = h.base THEN h.l ELSE coalesce(b.l, [])[1:h.h] || h.l[h.h + 1:] END AS l FROM h LEFT JOIN t b ON b.conv_id = h.base
), p AS (SELECT conv_id, d, l[1:d] AS k, d = len(l) AS last FROM (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS d FROM r)),
n AS (
  SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(octet_length(encode(any_value(k)[d].t)), 0) AS size,
    sha256(coalesce(string_agg(CASE WHEN last THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM p GROUP BY 1, 2
), kids AS (SELECT k[1:d - 1] AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (k)),
up AS (SELECT k[1:e] AS k, sum((n_convs - 1) * size) AS saved, sum(CAST(n_children = 0 AS BIGINT)) AS leaves FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM f) GROUP BY 1)
SELECT f.conv_id, f.d AS depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(up.leaves AS BIGINT) AS n_leaves, CAST(up.saved AS BIGINT) AS saved_tokens, f.ends_sha256, CAST(f.size AS BIGINT) AS length
FROM f JOIN up USING (k) LEFT JOIN f q ON q.k = f.k[1:f.d - 1] AND q.d = f.d - 1
"""

_OP13 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
    [CAST('0x' || sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), ''))[i:i + 7] AS BIGINT) FOR i IN [1, 9, 17, 25]] AS h FROM documents
), r AS (
  SELECT *, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d
), s AS (
  SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid, coalesce(array_to_string(u[b + 1:], ''), '') AS suf FROM r
)
SELECT doc_id, CAST(len(u) AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM s
"""

ORACLES = {"op1_ngram_jaccard_join": _OP1, "op5_decontamination": _OP5, "op9_quality_rules": _OP9, "op11_prefix_trie": _OP11, "op13_fill_in_middle": _OP13}
