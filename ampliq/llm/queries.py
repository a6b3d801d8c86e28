"""One query per operator, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .conversation_repair import damaged, edits, summary
from .conversation_trie import prefix_trie, rebuilt
from .exact_dedup import dedup
from .html_text import extract
from .licenses import scan
from .mixing import mix
from .ngram_join import join
from .quality import classify
from .quality_rules import judge
from .registry import ORACLES, QUERIES, query  # noqa: F401
from .sentence_pieces import encode
from .token_counts import count_tokens
from .topk_search import top_k
from .warc import page_records, read_archives, write_archives


#: The unsigned CRC-32 of a short ASCII text, bit by bit.
CRC32_SQL = """xor(list_reduce([unicode(x) for x in string_split({0}, '')],
  lambda c, b: xor(c >> 8, list_reduce(range(8), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b) & 255)), 4294967295), 4294967295)"""


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    return count_tokens(table(spark, sf_dir, "documents"))


@query("op7_exact_dedup", """
WITH n AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS bare FROM documents),
d AS (SELECT doc_id, length(t) AS points, sha256(bare) AS digest FROM n)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY digest ORDER BY points DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY digest) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY digest ORDER BY points DESC, doc_id) AS kept,
       digest AS text_sha256
FROM d""")
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every document."""
    return dedup(table(spark, sf_dir, "documents"))


@query("op2_topk_search", """
WITH v AS (
  SELECT vec_id, [floor(64 * x::DOUBLE)::BIGINT for x in embedding] AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         list_sum([z[1] * z[2] for z in list_zip(a.q, b.q)])::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""")
def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest integer inner products of every vector whose vec_id is divisible by 20 with all others."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query("op5_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
FROM m""")
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes every page as a WARC record, reads the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    path = write_archives(page_records(table(spark, sf_dir, "pages")))
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op6_quality")
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_mixing")
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every draw of a document of the temperature mixture in which no source is passed over more than twice."""
    return mix(table(spark, sf_dir, "documents"), max_repeats=2.0)


@query("op8_sentence_pieces")
def op8_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, round_trip of every document."""
    return encode(table(spark, sf_dir, "documents"))


@query("op3_ngram_join")
def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id, n_links, n_copies of every document, at Jaccard 0.8 of five-word shingles."""
    return join(table(spark, sf_dir, "documents"))


@query("op9_html_text")
def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return extract(table(spark, sf_dir, "pages"))


@query("op1_licenses")
def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of every document that is a licence template, at a Dice coefficient of 0.9."""
    return scan(table(spark, sf_dir, "documents"), least=0.9)


@query("op13_quality_rules")
def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, five counts, base_failed and the learned list's verdict of every document."""
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _step(state: str, keep: str | None, role: str) -> str:
    """SQL of what a row makes of one state: (cost, audit, text) of the way that deletes, keeps or renames it."""
    asked = f"{{'c': {state}.c + 3 + late, 'a': {state}.a || 'R', 't': list_append({state}.t, '{role}:' || text)}}"
    kept = f"{{'c': {state}.c + late, 'a': {state}.a || 'K', 't': list_append({state}.t, role || ':' || text)}}"
    return f"CASE WHEN must_go THEN [] ELSE [{asked}] || CASE WHEN substr(role, 1, 1) = '{keep}' THEN [{kept}] ELSE [] END END"


_GONE = "{'c': 1000000000, 'a': '', 't': []::VARCHAR[]}"
_DEL = "[{{'c': {0}.c + 4, 'a': {0}.a || 'D', 't': {0}.t}}]"
_NEW = "[{{'c': {0}.c + 3, 'a': {0}.a || 'I', 't': list_append({0}.t, '{1}:')}}]"
_SYSTEM = ("CASE WHEN NOT must_go AND substr(role, 1, 1) = 's' THEN [{'c': s0.c + late, 'a': s0.a || 'K', 't': list_append(s0.t, role || ':' || text)}] ELSE [] END")

#: Every state's best (cost, audit, turns) after each row, row by row.
REPAIR_SQL = f"""
WITH RECURSIVE o AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {CRC32_SQL.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS harm FROM conversations),
d AS (
  SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
         CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
  FROM o, (VALUES (1), (2)) c(copy) WHERE harm <> 0 AND (copy = 1 OR harm = 3)),
f AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
         lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) || substr(role, 1, 1) AS pair FROM d),
r AS (
  SELECT *, fault IN ('blank', 'duplicate') AS must_go, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS late FROM (
    SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
                   WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM f)),
w AS (
  SELECT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': '', 't': []::VARCHAR[]}} AS s0, {_GONE} AS s1,
         {{'c': 3, 'a': 'I', 't': ['user:']}} AS s2, {{'c': 6, 'a': 'II', 't': ['user:', 'assistant:']}} AS s3 FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, s0, s1, s2, list_sort([s3] || {_NEW.format("s2", "assistant")})[1] AS s3 FROM (
    SELECT conv_id, i, s0, s1, s3, list_sort([s2] || {_NEW.format("s0", "user")} || {_NEW.format("s1", "user")} || {_NEW.format("s3", "user")})[1] AS s2 FROM (
      SELECT w.conv_id, r.i, {_DEL.format("s0")}[1] AS s0, list_sort({_DEL.format("s1")} || {_SYSTEM})[1] AS s1,
             list_sort({_DEL.format("s2")} || {_step("s0", "u", "user")} || {_step("s1", "u", "user")} || {_step("s3", "u", "user")})[1] AS s2,
             list_sort({_DEL.format("s3")} || {_step("s2", "a", "assistant")})[1] AS s3
      FROM w JOIN r ON w.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = w.i + 1))),
b AS (SELECT conv_id, list_sort([s0, s3])[1] AS s FROM w QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
n AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, s.c::BIGINT AS cost, s.a AS audit, sha256(array_to_string(s.t, chr(10))) AS repaired_sha256
FROM b LEFT JOIN n ON b.conv_id IS NOT DISTINCT FROM n.conv_id"""


@query("op11_conversation_repair", REPAIR_SQL)
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cost and edits of every damaged conversation, and the digest of the repaired one."""
    return summary(edits(damaged(table(spark, sf_dir, "conversations")), marked=True))


TRIE_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, length(coalesce(text, '')) AS points,
         md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, digest) - 1 AS p FROM t),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS head, {CRC32_SQL.format("conv_id::VARCHAR")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT c.conv_id, p, digest, points FROM c JOIN own ON own.conv_id = c.head WHERE p < h
  UNION ALL SELECT c.conv_id, p, digest, points FROM c JOIN own ON own.conv_id = c.conv_id WHERE p >= h),
m AS (
  SELECT conv_id, row_number() OVER w AS depth, string_agg(digest, '') OVER w AS path, points FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY p)
  UNION ALL SELECT conv_id, 0, '', 0 FROM c),
n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(points) AS points FROM m GROUP BY path, depth),
e AS (SELECT path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM (
        SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY depth DESC) = 1) GROUP BY path),
k AS (SELECT left(path, 32 * (depth - 1)::INT) AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
b AS (
  SELECT top, sum((n.n_convs - 1) * n.points)::BIGINT AS saved_tokens, count(*) FILTER (k.path IS NULL) AS n_leaves
  FROM (SELECT DISTINCT a.path AS top, z.path AS path FROM m a JOIN m z ON a.conv_id = z.conv_id AND z.depth >= a.depth) s
  JOIN n ON n.path = s.path LEFT JOIN k ON k.path = s.path GROUP BY top)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, b.n_leaves, b.saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM n JOIN b ON b.top = n.path LEFT JOIN k ON k.path = n.path LEFT JOIN e ON e.path = n.path
LEFT JOIN n u ON n.depth > 0 AND u.path = left(n.path, 32 * (n.depth - 1)::INT)"""


@query("op12_conversation_trie", TRIE_SQL)
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of conversations that share their heads by hundreds."""
    return prefix_trie(rebuilt(table(spark, sf_dir, "conversations")))
