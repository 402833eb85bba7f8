"""The operators as queries over their tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import byte_bpe, chat_format, fingerprints, language_id, license_scan, line_dedup, mixing, ngram_join, prefix_trie, quality_rules, substring_dedup, url_filter, whitening


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and the learned decision list's verdict on every document."""
    out = quality_rules.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), tag="op1")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


#: The rules of op2.
URL_RULES = [
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, the longest fitting rule and its verdict for every page's url."""
    out = url_filter.judge_urls(read(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-Match fingerprints of every document and of its edited text."""
    return fingerprints.edited_fingerprints(read(spark, sf_dir, "documents"), tag="op3")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best covered license template of every document, and all that are covered."""
    out = license_scan.scan_licenses(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "license", "coverage", "first_word", "after_word", "licenses")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken from every document so that sources meet their targets."""
    out = mixing.mix(read(spark, sf_dir, "documents"), tag="op5")
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def remainder():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language mixture of every document, learned from two thirds of the labelled ones.

    A row without doc_id has no remainder: it is not held out, and not learned from either.
    """
    docs = read(spark, sf_dir, "documents")
    model = language_id.learn(docs.where(remainder() != 1))
    out = language_id.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(remainder() == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "languages", "shares")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes of every document."""
    import public_tokenizers

    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe.encode(
        read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, ["doc_id"], byte_bpe.digests, "n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose 4-word shingle sets have a Jaccard similarity of 0.85 or more."""
    return ngram_join.jaccard_groups(read(spark, sf_dir, "documents"), words=4, percent=85, tag="op8")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation rendered from every participant's perspective, turn by turn with masks."""
    return chat_format.perspectives(read(spark, sf_dir, "conversations"), tag="op9")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated sentence spans."""
    out = substring_dedup.dedup_spans(read(spark, sf_dir, "documents"), tag="op10")
    return out.select("doc_id", "text", "n_removed")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight whitened components of every usable vector; deviation is null where it is no long, deviation_exact never."""
    out = whitening.whiten(read(spark, sf_dir, "embeddings"), components=8, tag="op11")
    exact = F.col("deviation")
    return out.select("vec_id", "component", "n", exact.try_cast("long").alias("deviation"), "whitened", "explained", "identity_error", exact.alias("deviation_exact"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations."""
    out = prefix_trie.conversation_trie(read(spark, sf_dir, "conversations"), tag="op12")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that ten documents or more hold."""
    out = line_dedup.drop_common_lines(read(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1, tag="op13")
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_quality_rules, op2_url_filter, op3_fingerprints, op4_license_scan, op5_mixing, op6_language_id, op7_byte_bpe, op8_ngram_join, op9_chat_format, op10_substring_dedup, op11_whitening, op12_prefix_trie, op13_line_dedup)
    return {f.__name__: f for f in ops} | {"pipeline": pipeline}


OP2_SQL = r"""
WITH u AS (
  SELECT page_id, strpos(coalesce(url, ''), '://') AS p, coalesce(url, '') AS url FROM pages
), h AS (
  SELECT page_id, CASE WHEN p = 0 THEN '' ELSE regexp_extract(substr(url, p + 3), '^[^/?#]*') END AS raw,
         CASE WHEN p = 0 THEN '' ELSE substr(url, p + 3) END AS rest FROM u
), s AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h
), rules(rhost, rpath, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), m AS (
  SELECT page_id, rhost || rpath AS rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS n
  FROM s JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT s.page_id, s.host, s.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM s LEFT JOIN m ON s.page_id = m.page_id AND m.n = 1
"""

OP9_SQL = r"""
WITH base AS (
  SELECT conv_id, coalesce(turn, -1) AS turn, replace(replace(coalesce(role, 'unknown'), '<|', '<\|'), chr(10), ' ') AS role, replace(coalesce(text, ''), '<|', '<\|') AS text FROM conversations
), who AS (
  SELECT DISTINCT conv_id, role AS perspective FROM base WHERE role <> 'system'
), r AS (
  SELECT b.conv_id, perspective, turn, role, text,
         CASE WHEN role = perspective THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user' END AS speaks_as
  FROM base b JOIN who w ON b.conv_id IS NOT DISTINCT FROM w.conv_id
), g AS (
  SELECT *, '<|start|>' || speaks_as || CASE WHEN speaks_as = 'user' THEN ' name=' || role ELSE '' END || chr(10) AS head FROM r
), s AS (
  SELECT *, head || text || '<|end|>' || chr(10) AS segment FROM g
), o AS (
  SELECT *, sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto FROM s
)
SELECT conv_id, perspective, turn, role, speaks_as, segment,
       CAST(upto - length(segment) AS BIGINT) AS start, CAST(upto AS BIGINT) AS after,
       CASE WHEN role = perspective THEN CAST(upto - length(segment) + length(head) AS BIGINT) END AS mask_start,
       CASE WHEN role = perspective THEN CAST(upto - 1 AS BIGINT) END AS mask_after,
       CASE WHEN role = perspective THEN 1 ELSE 0 END AS mask
FROM o
"""


OP12_SQL = r"""
WITH t AS (
  SELECT conv_id AS c, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
), held AS (
  SELECT c, count(*) AS m FROM t GROUP BY c
), crc AS (  -- bit by bit over the decimal digits
  SELECT c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
    lambda r, b: list_reduce(list_prepend(xor(r, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT) AS crc FROM held
), h AS (
  SELECT crc.c, crc % 4 AS h, crc.c - crc.c % 20 AS b, least(crc % 4, coalesce(held.m, 0)) AS taken FROM crc LEFT JOIN held ON held.c = crc.c - crc.c % 20
), r AS (
  SELECT h.c, t.pos, t.role, t.text FROM h JOIN t ON t.c = h.b AND t.pos <= h.h
  UNION ALL SELECT t.c, t.pos - h.h + h.taken, t.role, t.text FROM t JOIN h ON t.c = h.c WHERE t.pos > h.h
), p AS (
  SELECT c, pos AS depth, list({'role': role, 'text': text}) OVER (PARTITION BY c ORDER BY pos) AS path, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM r
  UNION ALL SELECT c, 0, NULL, 0 FROM h
), m AS (
  SELECT c, depth, words, min(c) OVER (PARTITION BY depth, path) AS node, max(depth) OVER (PARTITION BY c) AS len FROM p
), n AS (
  SELECT node AS conv_id, depth, count(*) AS n_convs, (count(*) - 1) * max(words) AS saved,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE len = depth), '')) AS ends_sha256
  FROM m GROUP BY node, depth
), k AS (
  SELECT n.*, m.node AS parent_conv_id FROM n LEFT JOIN m ON m.c = n.conv_id AND m.depth = n.depth - 1
), kids AS (
  SELECT parent_conv_id, depth - 1 AS depth, count(*) AS n_children FROM k WHERE depth > 0 GROUP BY ALL
), w AS (
  SELECT k.*, coalesce(kids.n_children, 0) AS n_children FROM k LEFT JOIN kids ON kids.parent_conv_id = k.conv_id AND kids.depth = k.depth
), s AS (
  SELECT m.node, m.depth, count(*) FILTER (WHERE w.n_children = 0) AS n_leaves, sum(w.saved) AS saved_tokens
  FROM w JOIN m ON m.c = w.conv_id AND m.depth <= w.depth GROUP BY m.node, m.depth
)
SELECT w.conv_id, w.depth, w.parent_conv_id, w.n_convs, w.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, w.ends_sha256
FROM w JOIN s ON s.node = w.conv_id AND s.depth = w.depth
"""

OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT r, i, lines[i] AS line,
         translate(trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM d, unnest(range(1, len(lines) + 1)) AS u(i)
), common AS (
  SELECT key FROM l WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10
), k AS (
  SELECT r, count(*) AS n_lines, count(c.key) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE c.key IS NULL), '') AS kept
  FROM l LEFT JOIN common c ON l.key = c.key GROUP BY r
)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_dropped AS BIGINT) AS n_dropped, sha256(kept) AS kept_sha256
FROM d JOIN k ON d.r = k.r
"""


def oracle_sql() -> dict[str, str]:
    """The others learn, align, encode, iterate or decompose; tests hold them against brute force instead."""
    return {"op2_url_filter": OP2_SQL, "op9_chat_format": OP9_SQL, "op12_prefix_trie": OP12_SQL, "op13_line_dedup": OP13_SQL}
