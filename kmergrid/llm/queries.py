"""One query per operator, bound to the driver's tables with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmergrid.llm import (chat, decontaminate, fingerprint, langid, minhash, mixing, pii, prefix_trie, resampling, sharding, tokens,
                          toxicity, warc)
from kmergrid.llm.common import held_out, table
from kmergrid.session import materialize, scratch_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def folder(spark: SparkSession, label: str) -> str:
    """A new folder in the shared place of the cluster."""
    return f"{scratch_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


@query
def op1_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs, apart = table(spark, sf, "documents"), held_out(F.col("doc_id"), 5, 0)
    found = toxicity.score(docs, table(spark, sf, "labels"), ~apart)
    return found.select("doc_id", apart.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
                        F.size("passages").alias("n_passages"))


@query
def op2_token_file(spark: SparkSession, sf: str) -> DataFrame:
    out = folder(spark, "sequences")
    tokens.write_sequences(table(spark, sf, "documents"), out, vocabulary())
    return tokens.read_documents(spark, out)


@query
def op3_pii(spark: SparkSession, sf: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf, "documents")))


@query
def op4_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op5_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.taken(table(spark, sf, "documents"))


@query
def op6_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.shard(table(spark, sf, "documents")).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "source")


ORACLE_SQL["op6_sharding"] = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
rows_ AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS s, octet_length(encode(coalesce(text, ''))) + 16 AS size,
    xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT),
                    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS text_crc32,
    ('0x' || substr(md5('shard:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM documents, crc),
ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY s ORDER BY u, doc_id) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY s) AS fraction FROM rows_),
placed AS (SELECT *, row_number() OVER (ORDER BY fraction, s, doc_id) - 1 AS p, count(*) OVER () AS n FROM ranked)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, (p * 40 // n)::INTEGER AS shard,
  (p - ((p * 40 // n) * n + 39) // 40)::BIGINT AS slot, NULL::INTEGER AS grown_shard, source
FROM placed
"""


@query
def op7_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf, "documents"))


ORACLE_SQL["op7_minhash"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
FROM documents d JOIN least l ON l.a = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""


@query
def op8_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    added = spark.createDataFrame([(-7, i, role, "</s>[INST] ok [/INST]") for i, role in enumerate(("user", "assistant"))],
                                  "conv_id long, turn long, role string, text string")
    given = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return chat.read_back(materialize(chat.format_conversations(given, vocabulary()), "chat"), vocabulary())


ORACLE_SQL["op8_chat_format"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(role) + length(text) + 12 + CASE WHEN role = 'assistant' THEN 4 ELSE 7 END
    + len(regexp_extract_all(role || chr(10) || text, '<\\*/?s>|\[\\*(?:/?INST|TEXT)\]')) AS chars
  FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(chars))::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""


@query
def op9_language(spark: SparkSession, sf: str) -> DataFrame:
    docs, apart = table(spark, sf, "documents"), held_out(F.col("doc_id"), 4, 2)
    found = langid.identify(docs, langid.learn(docs.where(~apart)))
    return found.select("doc_id", apart.alias("held_out"), "lang_pred", "score")


@query
def op10_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf, "documents"))


@query
def op11_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.conversations(table(spark, sf, "conversations"))))


@query
def op12_resampling(spark: SparkSession, sf: str) -> DataFrame:
    found = resampling.resample(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


@query
def op13_warc(spark: SparkSession, sf: str) -> DataFrame:
    out = folder(spark, "archives")
    warc.write_archives(table(spark, sf, "pages"), out)
    return warc.catalog(spark, out)


#: the steps of a byte's CRC-32 as a list of 256 numbers, and the checksum of a text's UTF-8 bytes by that list
_CRC_TABLE = """SELECT list_transform(range(256), lambda i: list_reduce(range(8),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t"""


def _crc(text: str) -> str:
    return f"""xor(list_reduce(list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"""


ORACLE_SQL["op11_prefix_trie"] = f"""
WITH crc AS ({_CRC_TABLE}),
turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations),
heads AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_crc("conv_id::VARCHAR")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM conversations), crc),
built AS (
  SELECT c.conv_id, t.pos, t.role, t.text FROM heads c JOIN turns t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL SELECT c.conv_id, 1000000 + t.pos, t.role, t.text FROM heads c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h),
placed AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS d, md5(length(role) || ':' || role || text) AS m, length(text) AS chars FROM built),
prefixes AS (
  SELECT conv_id, d, string_agg(m, '') OVER (PARTITION BY conv_id ORDER BY d) AS p, chars FROM placed
  UNION ALL SELECT conv_id, 0, '', 0 FROM heads),
ends AS (SELECT p, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM
  (SELECT conv_id, p FROM (SELECT *, max(d) OVER (PARTITION BY conv_id) AS last FROM prefixes) WHERE d = last) GROUP BY p),
nodes AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n, any_value(chars) AS chars FROM prefixes GROUP BY p, d),
kids AS (SELECT left(p, 32 * (d - 1)) AS p, count(*) AS k FROM nodes WHERE d > 0 GROUP BY ALL),
below AS (
  SELECT a.p, count(*) FILTER (k.k IS NULL) AS leaves, sum((b.n - 1) * b.chars)::BIGINT AS saved
  FROM nodes b, range(0, b.d + 1) r(u) JOIN nodes a ON a.p = left(b.p, 32 * r.u::INTEGER) LEFT JOIN kids k ON k.p = b.p GROUP BY a.p)
SELECT x.conv_id, x.d::BIGINT AS depth, u.conv_id AS parent_conv_id, x.n AS n_convs, coalesce(k.k, 0)::BIGINT AS n_children, b.leaves AS n_leaves,
  b.saved AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes x LEFT JOIN nodes u ON x.d > 0 AND u.p = left(x.p, 32 * (x.d - 1)) AND u.d = x.d - 1
JOIN below b ON b.p = x.p LEFT JOIN kids k ON k.p = x.p LEFT JOIN ends e ON e.p = x.p
"""

ORACLE_SQL["op12_resampling"] = rf"""
WITH crc AS ({_CRC_TABLE}),
texts AS (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, NULL, text FROM benchmark),
words AS (SELECT side, id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM texts),
vocabulary AS (SELECT w, ({_crc("w")} % 10000)::INTEGER AS bucket FROM (SELECT DISTINCT w FROM words), crc),
hashed AS (SELECT side, id, bucket FROM words JOIN vocabulary USING (w)),
sums AS (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM hashed GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM sums),
weights AS (SELECT id, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM hashed JOIN gains USING (bucket) WHERE side = 0 GROUP BY id),
scored AS (
  SELECT doc_id, coalesce(n, 0) AS n, coalesce(weight, 0) AS weight, coalesce(weight, 0)
    + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || doc_id)[:8])::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM documents LEFT JOIN weights ON id = doc_id),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS able FROM scored WHERE n >= 20)
SELECT doc_id, n::BIGINT AS n_features, weight, score, CASE WHEN rank <= 10 * able // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""

ORACLE_SQL["op13_warc"] = """
WITH sums AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS bytes, sha1(coalesce(html, '')) AS sha, coalesce(html, '') AS html FROM pages),
firsts AS (SELECT html AS same, min(page_id) AS least FROM sums GROUP BY html)
SELECT page_id, bytes::BIGINT AS payload_bytes,
  list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(sha, 5 * (i // 4)::INTEGER + 1, 5))::BIGINT >> (5 * (3 - i % 4))::INTEGER) & 31) + 1)::INTEGER, 1)), lambda a, b: a || b) AS payload_digest,
  CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> least THEN least END AS refers_to
FROM sums JOIN firsts ON html = same
"""
