"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import bpe, chat, cws, fim, minhash, patience, simhash, suffix, tiling, tokenfiles, toxicity, variants, warc

PLANTED = r"\### Assistant: </turn> ok"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted and read back."""
    own = spark.createDataFrame([(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.chat_digests(chat.format_turns(turns)).drop("n_tokens", "loss_tokens")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted-sampling fingerprints of all documents, of their edited texts, and the likenesses."""
    return cws.edit_likeness(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints and near-duplicate components of all documents."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents by prefix dynamic programming, and the text they decode to."""
    return bpe.digests(bpe.round_trip(table(spark, sf_dir, "documents")))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the benchmark item they cover most and whether they are contaminated."""
    return tiling.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")).drop("rest")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC bundles and read back."""
    return warc.write_and_read(table(spark, sf_dir, "pages")).drop("url")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 50-word passages that a smaller document has."""
    kept = suffix.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents by a classifier trained on their labels."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the license notice or text they contain."""
    return patience.scan(table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents written as indexed binary shards and read back through the index."""
    return tokenfiles.write_and_read(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their middle lines moved to the end, and the texts rebuilt from that."""
    return fim.digests(fim.restore(fim.transform(table(spark, sf_dir, "documents"))))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents with the more frequent words that they are variants of."""
    return variants.group(table(spark, sf_dir, "documents"))


def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose five-word shingles have a likeness of 0.85 or more."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def _escaped_length(x: str) -> str:
    marks = " + ".join(f"(length({x}) - length(replace({x}, '{c}', ''))) // {len(c)}" for c in chat.CONTROL)
    return f"(2 * length({x}) - length(replace({x}, '\\', '')) + {marks})"


_OP1 = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PLANTED}' UNION ALL SELECT -7, 1, 'assistant', '{PLANTED}')
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, md5(role || chr(10) || text))) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, md5(role || chr(10) || text))) AS loss_sha256,
  CAST(sum(CASE role WHEN 'user' THEN 10 WHEN 'assistant' THEN 15 WHEN 'system' THEN 12 ELSE 17 + {_escaped_length("role")} END
    + {_escaped_length("text")} + 8) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""

QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_format,
        op2_fingerprints,
        op3_simhash,
        op4_bpe,
        op5_decontamination,
        op6_warc,
        op7_substring_dedup,
        op8_toxicity,
        op9_license_scan,
        op10_token_files,
        op11_fill_in_middle,
        op12_spelling_variants,
        op13_minhash_near_dedup,
    )
}
_OP6 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest FROM p),
k AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS keeper FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM k"""

_OP7 = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS words FROM documents),
n AS (SELECT doc_id, words, len(words) AS n FROM w),
g AS (SELECT doc_id, unnest(range(1, n - 48)) AS i, words FROM n WHERE n >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS m FROM g),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY m) AS least FROM h),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM f WHERE doc_id > least),
p AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, n + 1)) AS p FROM n WHERE n > 0),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n_kept FROM p ANTI JOIN c USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(n - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM n LEFT JOIN k USING (doc_id)"""

_OP11 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units, [CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT) FOR i IN range(4)] AS h FROM d),
n AS (SELECT *, len(units) AS n, h[1] % (len(units) + 1) AS a, h[2] % (len(units) + 1) AS b FROM u),
p AS (SELECT *, array_to_string(units[1:least(a, b)], '') AS pre, array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS mid, array_to_string(units[greatest(a, b) + 1:], '') AS suf,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM n)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p"""

#: CRC-32 byte by byte over the distinct runs of each document; near words by their patterns with one character left out.
_OP12 = r"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS crc),
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
g AS (SELECT doc_id, run, count(*) AS n FROM r GROUP BY ALL),
b AS (SELECT run, n, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)] ELSE [195, ord(c) - 64] END)) AS bytes FROM g),
h AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda c, x: xor(c >> 8, crc[(xor(c, CAST(x AS BIGINT)) & 255) + 1]))) AS h FROM b CROSS JOIN t),
d AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM d WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
k AS (SELECT word, n, i, substr(word, 1, i - 1) || ' ' || substr(word, i + 1) AS swap, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT a.word, b.word AS near, b.n FROM k a JOIN k b ON a.swap = b.swap AND a.word <> b.word
  UNION SELECT k.word, w.word, w.n FROM k JOIN w ON k.cut = w.word
  UNION SELECT w.word, k.word, k.n FROM k JOIN w ON k.cut = w.word),
m AS (SELECT word, count(*) AS n_near, max(n) AS best FROM p GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best >= 2 * w.n THEN best END AS form_n, CASE WHEN best >= 2 * w.n THEN (SELECT min(near) FROM p WHERE p.word = w.word AND p.n = best) END AS form FROM w LEFT JOIN m USING (word)),
c AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT c.word, c.next, f.form FROM c JOIN f ON c.next = f.word)
SELECT f.word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM f JOIN c USING (word) WHERE c.next IS NULL"""

_OP13 = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(words[i:i + 4], ' ')) AS m FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, least(len(words), 1)) + 1)) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM s x JOIN s y ON x.m = y.m AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM b JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * b.n >= 85 * (p.n + q.n - b.n)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT c.doc_id, e.b FROM c JOIN e ON c.other = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, d.component_id, d.doc_id = d.component_id AS kept
FROM (SELECT doc_id, min(other) AS component_id FROM c GROUP BY doc_id) d LEFT JOIN n USING (doc_id)"""

ORACLES = {"op1_chat_format": _OP1, "op6_warc": _OP6, "op7_substring_dedup": _OP7, "op11_fill_in_middle": _OP11, "op12_spelling_variants": _OP12, "op13_minhash_near_dedup": _OP13}
