"""The dealt operators as registered queries."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from weir.llm import (
    byte_bpe, maxscore, merkle, order_minhash, packing, pages, quotations, retrieval_packing, simhash, structure, suffixes,
    token_counts, toxicity)
from weir.llm.common import read
from weir.registry import query

WORD_VOCABULARY = "word_bpe_49k.json"
BYTE_VOCABULARY = "byte_bpe_50k.tiktoken"
SEQUENCE = 2048
WINDOW, WINDOW_END = 4096, 2
SIMHASH_SHINGLE, SIMHASH_BITS = 4, 4
REPEAT_BYTES = 100


@query("op1_simhash")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf, "documents"), shingle=SIMHASH_SHINGLE, max_bits=SIMHASH_BITS)


@query("op2_toxicity")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    return toxicity.graded(docs, toxicity.train(docs, read(spark, sf, "labels")))


@query("op3_quotation_linking")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return quotations.conversations(read(spark, sf, "conversations"))


@query("op4_packing")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf, "documents"), public_tokenizers.path(WORD_VOCABULARY), SEQUENCE)


_TOP_SQL = """
WITH e AS (
    SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
    FROM e q JOIN e c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query("op5_maxscore", _TOP_SQL)
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return maxscore.nearest(read(spark, sf, "embeddings"), every=50, k=5, scale=256)


#: covered bytes in hexadecimal, two letters a byte: a blob has no substring function
_REPEATS_SQL = """
WITH d AS (
    SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
starts AS (
    SELECT doc_id, s, substr(h, 2 * s + 1, 200) AS w
    FROM (SELECT doc_id, h, unnest(range(0, greatest(n - 99, 0))) AS s FROM d)),
later AS (
    SELECT doc_id, s FROM (
        SELECT doc_id, s, row_number() OVER (PARTITION BY w ORDER BY doc_id, s) AS k FROM starts) WHERE k > 1),
marked AS (
    SELECT doc_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 100 THEN 0 ELSE 1 END AS fresh FROM later),
numbered AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM marked),
runs AS (
    SELECT doc_id, run, min(s) AS a, max(s) + 100 AS b, lag(max(s) + 100, 1, 0) OVER (PARTITION BY doc_id ORDER BY run) AS before
    FROM numbered GROUP BY doc_id, run),
pieces AS (
    SELECT r.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last,
           string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY run) AS kept
    FROM runs r JOIN d ON d.doc_id = r.doc_id GROUP BY r.doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN pieces p ON p.doc_id = d.doc_id
"""


@query("op6_suffix_dedup", _REPEATS_SQL)
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return suffixes.removal_report(read(spark, sf, "documents"), length=REPEAT_BYTES)


@query("op7_order_minhash")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return order_minhash.edit_report(read(spark, sf, "documents"))


@query("op8_html_extraction")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return pages.extract(read(spark, sf, "pages"))


@query("op9_token_counts")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.token_counts(
        read(spark, sf, "documents"), public_tokenizers.path(WORD_VOCABULARY), limit=SEQUENCE)


@query("op10_byte_bpe")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return byte_bpe.encode_texts(
        read(spark, sf, "documents"), public_tokenizers.path(BYTE_VOCABULARY), public_tokenizers.PATTERN, digests=True)


#: crc32 of the decimal id, bit by bit: a digit is mixed in, then eight shifts (-1)
_MANIFEST_SQL = """
WITH RECURSIVE fields AS (
    SELECT doc_id, source, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS small,
           coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
           list_reduce([4294967295] || flatten([[CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]
                                                FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]),
               lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS crc
    FROM documents),
hashed AS (
    SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
           sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
           sha256(head || coalesce(strlen(small) || ':' || small, '-')) AS changed,
           doc_id IS NOT NULL AND xor(crc, 4294967295) % 5 = 0 AS hit FROM fields),
leaves AS (
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
           count(*) OVER (PARTITION BY tree) AS n FROM hashed),
lower_levels(tree, level, idx, n, digest) AS (
    SELECT tree, 0, idx, n, leaf FROM leaves
    UNION ALL
    SELECT tree, level + 1, idx // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx))
    FROM lower_levels WHERE n > 1 GROUP BY tree, level, idx // 16, n),
subroots AS (SELECT tree, digest, count(*) OVER () AS n FROM lower_levels WHERE n = 1),
upper_levels(level, idx, n, digest) AS (
    SELECT 0, tree, n, digest FROM subroots
    UNION ALL
    SELECT level + 1, idx // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx))
    FROM upper_levels WHERE n > 1 GROUP BY level, idx // 16, n),
lower_runs AS (SELECT tree, level, idx // 16 AS up, list(digest ORDER BY idx) AS kids FROM lower_levels WHERE n > 1 GROUP BY ALL),
upper_runs AS (SELECT level, idx // 16 AS up, list(digest ORDER BY idx) AS kids FROM upper_levels WHERE n > 1 GROUP BY ALL),
climb(doc_id, leaf, tree, level, idx, n, folded, proof) AS (
    SELECT doc_id, leaf, tree, 0, idx, n, CASE WHEN hit THEN changed ELSE leaf END, '' FROM leaves
    UNION ALL
    SELECT c.doc_id, c.leaf, c.tree, c.level + 1, r.up, (c.n + 15) // 16,
           sha256(array_to_string(kids[:c.idx % 16] || [c.folded] || kids[c.idx % 16 + 2:], '')),
           c.proof || array_to_string(kids[:c.idx % 16] || kids[c.idx % 16 + 2:], '')
    FROM climb c JOIN lower_runs r ON r.tree = c.tree AND r.level = c.level AND r.up = c.idx // 16),
higher(doc_id, leaf, tree, level, idx, n, folded, proof) AS (
    SELECT c.doc_id, c.leaf, c.tree, 0, c.tree, s.n, c.folded, c.proof FROM climb c JOIN subroots s ON s.tree = c.tree WHERE c.n = 1
    UNION ALL
    SELECT c.doc_id, c.leaf, c.tree, c.level + 1, r.up, (c.n + 15) // 16,
           sha256(array_to_string(kids[:c.idx % 16] || [c.folded] || kids[c.idx % 16 + 2:], '')),
           c.proof || array_to_string(kids[:c.idx % 16] || kids[c.idx % 16 + 2:], '')
    FROM higher c JOIN upper_runs r ON r.level = c.level AND r.up = c.idx // 16)
SELECT h.doc_id, h.leaf, s.digest AS subroot, r.digest AS root, sha256(h.proof) AS proof_sha256, h.folded AS folded_root,
       h.folded = r.digest AS verified
FROM higher h JOIN subroots s ON s.tree = h.tree JOIN upper_levels r ON r.n = 1 WHERE h.n = 1
"""


@query("op13_merkle_manifest", _MANIFEST_SQL)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return merkle.manifest(read(spark, sf, "documents"), ["doc_id", "source", "lang", "n_chars", "text"])


#: c: cost vectors from the last row back, by state (nothing, system, user, assistant); w: the walk forward, a letter a round
_REPAIR_SQL = """
WITH RECURSIVE coded AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
kinds AS (
    SELECT *, xor(list_reduce([4294967295] || flatten([[CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split(key, '')]),
        lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295) % 20 AS kind
    FROM coded),
after AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
           CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
           unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM kinds),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) - 1 AS i,
           count(*) OVER (PARTITION BY conv_id) AS n, left(role, 1) AS a,
           rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM after),
faults AS (
    SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                   WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
           lag(a) OVER (PARTITION BY conv_id ORDER BY i) || a AS pair FROM placed),
r AS (SELECT conv_id, i, n, role, text, a, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS x FROM faults),
c(conv_id, i, v) AS (
    SELECT DISTINCT conv_id, n, [0, 6, 3, 0] FROM r
    UNION ALL
    SELECT conv_id, i, [least(b[1], 3 + b[3], 6 + b[4]), least(b[2], 3 + b[3], 6 + b[4]), least(b[3], 3 + b[4]), least(b[4], 3 + b[3])] FROM (
        SELECT r.conv_id, r.i, CASE WHEN gone THEN [4 + v[1], 4 + v[2], 4 + v[3], 4 + v[4]] ELSE [
            least(4 + v[1], x + 3 + v[3], CASE a WHEN 's' THEN x + v[2] WHEN 'u' THEN x + v[3] ELSE 1000000000 END),
            least(4 + v[2], x + 3 + v[3], CASE a WHEN 'u' THEN x + v[3] ELSE 1000000000 END),
            least(4 + v[3], x + 3 + v[4], CASE a WHEN 'a' THEN x + v[4] ELSE 1000000000 END),
            least(4 + v[4], x + 3 + v[3], CASE a WHEN 'u' THEN x + v[3] ELSE 1000000000 END)] END AS b
        FROM c JOIN r ON r.conv_id IS NOT DISTINCT FROM c.conv_id AND r.i = c.i - 1)),
steps AS (
    SELECT c.conv_id, c.i, c.v, d.v AS later, r.role, r.text, r.a, r.gone, r.x
    FROM c LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM c.conv_id AND r.i = c.i
    LEFT JOIN c d ON d.conv_id IS NOT DISTINCT FROM c.conv_id AND d.i = c.i + 1),
w(conv_id, i, s, audit, said) AS (
    SELECT conv_id, CAST(0 AS BIGINT), 1, '', CAST([] AS VARCHAR[]) FROM c WHERE i = 0
    UNION ALL
    SELECT conv_id, i + CAST(letter <> 'I' AS BIGINT), CASE letter WHEN 'D' THEN s WHEN 'K' THEN CASE a WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END
               ELSE CASE s WHEN 3 THEN 4 ELSE 3 END END,
           audit || letter, CASE letter WHEN 'D' THEN said WHEN 'K' THEN said || [role || ':' || text]
               ELSE said || [CASE s WHEN 3 THEN 'assistant' ELSE 'user' END || ':' || CASE letter WHEN 'I' THEN '' ELSE text END] END
    FROM (
        SELECT w.*, t.role, t.text, t.a, CASE
            WHEN t.later IS NOT NULL AND 4 + t.later[s] = v[s] THEN 'D'
            WHEN 3 + v[CASE s WHEN 3 THEN 4 ELSE 3 END] = v[s] THEN 'I'
            WHEN t.later IS NULL THEN NULL
            WHEN (s = 1 AND a = 's' AND x + t.later[2] = v[s]) OR (s IN (1, 2, 4) AND a = 'u' AND x + t.later[3] = v[s])
                OR (s = 3 AND a = 'a' AND x + t.later[4] = v[s]) THEN 'K'
            ELSE 'R' END AS letter
        FROM w JOIN steps t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.i = w.i) WHERE letter IS NOT NULL),
ends AS (
    SELECT conv_id, arg_max(audit, len(audit)) AS audit, sha256(array_to_string(arg_max(said, len(audit)), chr(10))) AS repaired
    FROM w GROUP BY conv_id),
counts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
           count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
           count(*) FILTER (i > 0 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id)
SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(c.v[1], 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit,
       coalesce(repaired, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM k.conv_id
LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM k.conv_id LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM k.conv_id AND c.i = 0
"""

@query("op12_structure_repair", _REPAIR_SQL)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return structure.repaired(read(spark, sf, "conversations"))


@query("op11_retrieval_packing")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval_packing.pack_neighbours(
        read(spark, sf, "documents"), public_tokenizers.path(WORD_VOCABULARY), WINDOW, WINDOW_END)
