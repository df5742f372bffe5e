"""One registered query for each operator; the digest columns of the contracts are derived here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (chat_format, lexical_rmq, line_bitmaps, multi_index, pii_boosting, ppm_language, sentence_spans,
               systematic_mix, template_decontam, token_align, token_combinations, url_regression, zstd_secrets)

from .common import ship_package


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _joined(spans: str | Column) -> Column:
    """kind:start:end of an array of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


#: The turns of conversation -7.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
        F.lit(CONTROL_TEXT).alias("text"))
    done = chat_format.format_conversations(
        turns.unionByName(control).withColumn("parts", chat_format.text_parts("text")))
    lines = F.transform(chat_format.read_back(F.col("formatted")),
                        lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    done = (done.withColumn("_lines", lines)
            .withColumn("_loss", chat_format.masked_text(F.col("formatted"), F.col("turns"))))
    return done.select(
        "conv_id", F.size("_lines").cast("long").alias("n_turns"),
        F.sha2(F.array_join("_lines", "").cast("binary"), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("attachments").cast("long").alias("n_attachments"), "placeholder_tokens")


OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(23 + length(role) + length(regexp_replace(role, '[^\\<\[]', '', 'g'))
           + length(text) + length(regexp_replace(text, '[^\\<\[]', '', 'g')))::BIGINT AS formatted_chars,
       0::BIGINT AS n_attachments, 0::BIGINT AS placeholder_tokens
FROM t GROUP BY conv_id
"""


def op2_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = ppm_language.identify(docs.select("doc_id", "text"), ppm_language.fit(docs))
    return found.select("doc_id", F.coalesce(ppm_language.remainder() == 1, F.lit(False)).alias("held_out"),
                        "lang_pred", "score", "bits_per_byte")


def op3_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_spans.dedup_spans(_table(spark, sf_dir, "documents"))


def op4_zstd_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = zstd_secrets.find(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] != "novel")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in zstd_secrets.KINDS],
                        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def op5_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return systematic_mix.mix(docs).select("doc_id", "size", "source_size", "target", "copies", "taken")


OP5_SQL = systematic_mix.MIX_SQL + """
SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM m
"""


def op6_token_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_combinations.jaccard_components(_table(spark, sf_dir, "documents"), k=3, percent=90)


#: The links of whole texts by a plain join on shingles, then what each distinct set can reach.
OP6_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))
    END AS s FROM words),
classes AS (SELECT min(doc_id) AS rep, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
tokens AS MATERIALIZED (SELECT rep, n, hash(t) AS t FROM (SELECT rep, n, unnest(s) AS t FROM classes)),
links AS MATERIALIZED (
  SELECT a.rep AS a, b.rep AS b FROM tokens a JOIN tokens b USING (t)
  WHERE a.rep <> b.rep AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (SELECT rep AS a, rep AS b FROM classes UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
roots AS (SELECT a AS rep, min(b) AS root FROM reach GROUP BY a)
SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, coalesce(r.root, d.doc_id) AS component_id
FROM sets d LEFT JOIN classes c ON d.s = c.s LEFT JOIN roots r ON c.rep = r.rep
"""


def op7_url_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_regression.judge(_table(spark, sf_dir, "pages").select("page_id", "url"))


def op8_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_boosting.detect(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.concat(*pii_boosting.BASE)
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in pii_boosting.BASE],
                        base.alias("base"), "spans").select(
        "doc_id", *[f"n_{k}" for k in pii_boosting.BASE],
        F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def op9_template_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = template_decontam.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "words", "slots", "changed")


def op10_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = multi_index.encode(_table(spark, sf_dir, "embeddings"))
    return multi_index.search(codes, codes.filter("id % 100 = 0"))


#: The table's vectors have 64 dimensions, so a code is their signs; every query is compared with every row.
OP10_SQL = r"""
WITH c AS (
  SELECT DISTINCT vec_id AS id, array_to_string(list_transform(range(1, 65), lambda i:
    CASE WHEN coalesce(embedding[i], 0) > 0 AND NOT isnan(embedding[i]) THEN '1' ELSE '0' END), '')::BIT AS code
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
d AS (SELECT q.id AS query_id, c.id AS neighbor_id, bit_count(xor(q.code, c.code))::BIGINT AS distance
      FROM c q JOIN c ON q.id <> c.id WHERE q.id % 100 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank, neighbor_id, distance
FROM d QUALIFY rank <= 10
"""


def op11_lexical_rmq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_rmq.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=50)


OP11_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, unnest(t) AS term, len(t) AS n FROM (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents)),
total AS (SELECT count(DISTINCT row) AS nd, count(*) AS l FROM d),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
tf AS (SELECT row, doc_id, n, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
      FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total),
s AS (SELECT item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // l))))::BIGINT AS score
      FROM q JOIN tf USING (term) JOIN w USING (term), total GROUP BY item_id, row, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 50
"""


def op12_line_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_bitmaps.apply(docs, line_bitmaps.keep_bitmaps(docs, least_docs=10, keep_first=False))
    return kept.select("doc_id", "n_lines", "n_dropped",
                       F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH l AS (SELECT doc_id, row, d, unnest(x) AS line, unnest(range(len(x))) AS pos FROM (
  SELECT doc_id, row_number() OVER () AS row, {'id': doc_id, 'text': md5(coalesce(text, ''))} AS d, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
common AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT d) >= 10),
m AS (SELECT k.*, c.key IS NULL AS kept FROM k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT kept) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (kept), '')) AS kept_sha256
FROM m GROUP BY doc_id, row
"""


def op13_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, _ = token_align.align(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return texts.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                        F.col("groups").alias("groups_sha256"))


def queries() -> dict:
    return {
        "op1_chat_format": op1_chat_format,
        "op2_ppm_language": op2_ppm_language,
        "op3_sentence_spans": op3_sentence_spans,
        "op4_zstd_secrets": op4_zstd_secrets,
        "op5_systematic_mix": op5_systematic_mix,
        "op6_token_combinations": op6_token_combinations,
        "op7_url_regression": op7_url_regression,
        "op8_pii_boosting": op8_pii_boosting,
        "op9_template_decontam": op9_template_decontam,
        "op10_multi_index": op10_multi_index,
        "op11_lexical_rmq": op11_lexical_rmq,
        "op12_line_bitmaps": op12_line_bitmaps,
        "op13_token_align": op13_token_align,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_format": OP1_SQL,
        "op5_systematic_mix": OP5_SQL,
        "op6_token_combinations": OP6_SQL,
        "op10_multi_index": OP10_SQL,
        "op11_lexical_rmq": OP11_SQL,
        "op12_line_bitmaps": OP12_SQL,
    }
