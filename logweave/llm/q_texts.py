"""Queries of the operators that work on texts and conversations (1, 3, 4, 5, 6, 7, 9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm.chat import format_conversations, read_loss, read_turns
from logweave.llm.common import table
from logweave.llm.fingerprint import with_edits
from logweave.llm.linedup import line_shares
from logweave.llm.ngramjoin import jaccard_components
from logweave.llm.pii import DEMO_KEY, pseudonym_report
from logweave.llm.quality import assess
from logweave.llm.registry import register
from logweave.llm.sharding import curve_shards


@register("op1_fingerprints")
def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all documents, of their edited texts, and how near these and the next documents are."""
    return with_edits(table(spark, sf_dir, "documents"))


QUALITY_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
lw AS (SELECT doc_id, line, pos, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
  length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS c FROM l),
lf AS (SELECT *, n > 0 AND (
    (len(regexp_extract_all(line, '[#*$%&|<>»›•→]+')) >= 3 AND len(regexp_extract_all(line, '[#*$%&|<>»›•→]+')) * 100 >= n * 30)
    OR (len(regexp_extract_all(line, '[!?]{2,}')) >= 3 AND len(regexp_extract_all(line, '[!?]{2,}')) * 100 >= n * 30)
    OR (n >= 40 AND NOT regexp_matches(line, '[.,;:!?…。！？]'))
    OR (n <= 30 AND regexp_matches(line, 'accept (all )?cookies|use of cookies|cookie policy|enable javascript|javascript is disabled|lorem ipsum|terms of (use|service)|privacy policy|all rights reserved|sign (in|up) (to|for)|subscribe to our|click here|share this|skip to (main )?content|powered by|back to top|(licensed|released) under (the|cc)|copyright (\(c\)|©)', 'i'))) AS bad
  FROM lw),
ld AS (SELECT doc_id, sum(n) AS n_words, sum(c) AS word_chars, sum(CASE WHEN bad THEN c ELSE 0 END) AS lost,
  count(*) FILTER (WHERE n > 0) - count(DISTINCT line) FILTER (WHERE n > 0) AS n_dup_lines FROM lf GROUP BY doc_id),
w AS (SELECT doc_id, unnest(x) AS word, generate_subscripts(x, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS x FROM d)),
win AS (SELECT doc_id, pos, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS s,
  count(*) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS k FROM w),
twice AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win WHERE k = 8) WHERE c > 1),
rep AS (SELECT doc_id, sum(least(8, coalesce(nxt - pos, 8))) AS n_repeat_words
  FROM (SELECT doc_id, pos, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM twice) GROUP BY doc_id)
SELECT d.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, n_dup_lines,
  CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
  n_words < 20 OR 100 * coalesce(n_repeat_words, 0) > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * coalesce(n_repeat_words, 0) > 30 * n_words) AND lost * 100 <= word_chars * 50 AS kept
FROM d JOIN ld USING (doc_id) LEFT JOIN rep USING (doc_id)
"""


@register("op3_quality_rules", QUALITY_SQL)
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all documents, and whether they are kept after their lines are cleaned."""
    return assess(table(spark, sf_dir, "documents")).drop("lost_chars", "n_removed_lines", "clean_text")


LINES_SQL = r"""
WITH l AS (SELECT source, text, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
t AS (SELECT DISTINCT source, text, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line FROM l),
p AS (SELECT source, line, count(*) AS pages FROM t WHERE line <> '' GROUP BY ALL),
h AS (SELECT source, count(DISTINCT text) AS host_pages FROM documents GROUP BY source),
bad AS (SELECT p.source, list(line) AS bad FROM p JOIN h ON p.source IS NOT DISTINCT FROM h.source
  WHERE pages >= 5 AND pages >= host_pages * 0.1 GROUP BY p.source),
k AS (SELECT doc_id, string_split(text, chr(10)) AS lines, text,
  list_filter(string_split(text, chr(10)), lambda s: NOT list_contains(coalesce(bad, []), regexp_replace(s, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'))) AS kept
  FROM documents d LEFT JOIN bad ON d.source IS NOT DISTINCT FROM bad.source)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN array_to_string(kept, chr(10)) END AS text,
  coalesce(len(lines), 0) AS n_lines, coalesce(len(lines) - len(kept), 0) AS n_dropped FROM k
"""


@register("op9_line_dedup", LINES_SQL)
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the boilerplate lines of their source, taken as the host."""
    return line_shares(table(spark, sf_dir, "documents"), F.col("source"))


SHARDS = 16


@register("op4_hilbert_shards")
def op4_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of equal row counts along a curve over language, source and length."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select("doc_id", "lang", "source", "n_chars", (F.octet_length(text) + 1).cast("long").alias("size"),
                        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    placed = curve_shards(sized, ["lang", "source", "n_chars"], SHARDS, ["doc_id", "size", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "curve")


CHAT_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '### ', '#\## '), '</turn>', '<\/turn>') AS escaped FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
  CAST(sum(length('### ' || role || ': ' || escaped || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars,
  string_agg(role, ' ' ORDER BY turn, role, text) AS roles FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars,
  regexp_full_match(roles, '(system )?user assistant( user assistant)*') AS valid FROM g
"""
PROBE = "\\### Assistant: </turn> ok"


@register("op6_chat_format", CHAT_SQL)
def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe -7, formatted, then read back from segments and text."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], rows.schema)
    out = format_conversations(rows.unionByName(probe))
    turns, loss = read_turns(F.col("formatted")), read_loss(F.col("segments"))
    read = out.select("conv_id", turns.alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"), "valid")
    plain = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(plain, 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       "formatted_chars", "valid")


@register("op7_pii_pseudonyms")
def op7_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their valid personal data replaced by keyed pseudonyms."""
    return pseudonym_report(table(spark, sf_dir, "documents"), DEMO_KEY)


@register("op5_ngram_jaccard")
def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose sets of 3-word shingles overlap by 90 percent."""
    return jaccard_components(table(spark, sf_dir, "documents"), n=3, percent=90)
