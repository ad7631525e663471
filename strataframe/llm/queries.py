"""The registered queries of the training-data operators."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, divergence, embeddings, language, lines, negatives, packing, sharding, simhash, substrings, toxicity, wavelet
from .common import crc_fold, kept, new_folder

#: The folder of the public tokenizers' files on every machine; empty: where their package says there.
VOCABULARIES = ""
#: The id that ends a document.
END = 2
#: A line is boilerplate on over this share of its host's pages, and on so many pages at least.
LINE_RATIO, LINE_PAGES = 0.1, 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """What the operators call a vocabulary file; tasks look up its path on their own machine."""
    return os.path.join(VOCABULARIES, name) if VOCABULARIES else name


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from two folds of three."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (crc_fold("doc_id", 3) == 1).alias("held_out"))
    net = language.fit(docs.where(~F.col("held_out")))
    return language.identify(docs.drop("lang"), net).select("doc_id", "held_out", "lang_pred", "score")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written as wavelet files and read back."""
    path = new_folder(spark, "tokens")
    wavelet.write_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), path, END)
    return wavelet.read_tokens(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 ids."""
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), END, 1024)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and benchmark items that share a passage."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated 13-word passages."""
    out = substrings.drop_repeated_passages(table(spark, sf_dir, "documents"), window=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and near-duplicate groups of all documents."""
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return out.select(F.col("key").alias("doc_id"), F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of all embeddings at a cosine of 0.95."""
    out = embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))
    return out.select(F.col("key").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from three folds of four."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (crc_fold("doc_id", 4) == 2).alias("held_out"))
    net = toxicity.fit(docs.where(~F.col("held_out")), table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, net, spans="offending")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.col("offending.sentence").alias("offending"))


def _host(url: str):
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without the boilerplate lines of their hosts."""
    pages = table(spark, sf_dir, "pages").select("page_id", _host("url").alias("host"), lines.page_lines(F.col("html")).alias("text"))
    out = lines.drop_boilerplate_lines(kept(pages, "pages"), host="host", max_ratio=LINE_RATIO, least=LINE_PAGES, removed="n_removed")
    return out.select("page_id", "host", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of all documents under a tree of 40, and under the tree with one more."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = sharding.shard(docs, "doc_id", sharding.uniform_tree(40))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the words of the sources of each language differ, over all documents."""
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of all documents and the bytes that they decode to."""
    import public_tokenizers

    name = vocabulary("byte_bpe_50k.tiktoken")
    ids = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), name, public_tokenizers.PATTERN)
    return bpe.decode(ids, name).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector and each of its nearest vectors of one label, among all embeddings."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = table(spark, sf_dir, "embeddings").where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select("vec_id", label.alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("vector"))
    out = negatives.mine(rows, anchor=F.col("vec_id") % 50 == 0, key="vec_id", positives=5, negatives=3, low=50, high=95)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def queries() -> dict:
    return {f.__name__: f for f in (op1_language_id, op2_token_files, op3_best_fit_packing, op4_decontamination, op5_substring_dedup, op6_simhash_dedup, op7_embedding_dedup, op8_toxicity, op9_line_dedup, op10_sharding, op11_source_divergence, op12_tree_bpe, op13_hard_negatives)}


_BLOCKS = lines.BLOCKS

_OP9 = rf"""
WITH cleaned AS (
  SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)) AS host,
         regexp_replace(regexp_replace(html, '[\r\n]+', ' ', 'g'), '(?i)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g') AS seen
  FROM pages),
split AS (
  SELECT page_id, host, string_split(regexp_replace(regexp_replace(seen, '(?i)</?(?:{_BLOCKS})(?:[\s/][^>]*)?>', chr(10), 'g'), '<[^>]*>', ' ', 'g'), chr(10)) AS lines
  FROM cleaned),
pages_of AS (SELECT host, count(*) AS pages FROM split GROUP BY host),
own AS (SELECT DISTINCT page_id, host, trim(line, ' ') AS line FROM (SELECT page_id, host, unnest(lines) AS line FROM split) WHERE trim(line, ' ') <> ''),
hot AS (SELECT o.host, o.line FROM own o JOIN pages_of p ON o.host IS NOT DISTINCT FROM p.host GROUP BY o.host, o.line, p.pages HAVING count(*) >= {LINE_PAGES} AND count(*) > {LINE_RATIO} * p.pages),
bad AS (SELECT host, list(line) AS bad FROM hot GROUP BY host),
kept AS (SELECT s.page_id, s.host, s.lines, list_filter(s.lines, lambda x: NOT coalesce(list_contains(b.bad, trim(x, ' ')), false)) AS kept FROM split s LEFT JOIN bad b ON s.host IS NOT DISTINCT FROM b.host)
SELECT page_id, host, coalesce(len(lines) - len(kept), 0)::BIGINT AS n_removed, sha256(array_to_string(kept, chr(10))) AS kept_sha256 FROM kept
"""


_OP5 = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []::VARCHAR[]) AS words FROM documents),
p AS (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS pos FROM w WHERE len(words) >= 13),
g AS (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY array_to_string(list_slice(words, pos, pos + 12), ' ')) AS first FROM p),
covered AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 13)) AS pos FROM g WHERE first < doc_id),
gone AS (SELECT doc_id, list(pos) AS gone FROM covered GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(array_to_string(list_filter(words, lambda x, i: NOT coalesce(list_contains(gone, i), false)), ' ')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)
"""

_OP7 = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
parts AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE a = v.vec_id) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN parts USING (vec_id)
"""


_OP11 = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 10),
n AS (SELECT lang, source, term, count(*) AS c FROM t JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT lang, source, coalesce(v, 0) AS v, coalesce(m, 0) AS m FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN v USING (lang) LEFT JOIN (SELECT lang, source, sum(c) AS m FROM n GROUP BY ALL) USING (lang, source)),
p AS (SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c, 0) + 2)) // (m + 2 * v)::HUGEINT AS p FROM g JOIN k USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
s AS (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
pairs AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0)::BIGINT AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(c) + 2)) // (sum(sum(c)) OVER (PARTITION BY lang) + 2 * count(*) OVER (PARTITION BY lang))::HUGEINT AS q FROM n GROUP BY lang, term),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= 10
"""

_OP13 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, o.vec_id AS id, a.label = o.label AS same, list_dot_product(a.e, o.e)::BIGINT AS score FROM v a JOIN v o ON a.vec_id % 50 = 0 AND a.vec_id <> o.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_substring_dedup": _OP5, "op7_embedding_dedup": _OP7, "op9_line_dedup": _OP9, "op11_source_divergence": _OP11, "op13_hard_negatives": _OP13}
