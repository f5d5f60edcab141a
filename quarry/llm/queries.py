"""The registered queries of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bit_sliced, bpe, exact_dedup, fill_middle, html_wrappers, late_sessions, licenses, mixing, ngram_join, quality, substring, token_counts, toxicity


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer files are installed; none is copied into this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held_out = lambda c: F.crc32(F.coalesce(F.col(c).cast("string"), F.lit(""))) % 3 == 1
    model = toxicity.train(docs.select("doc_id", "text"), _read(spark, sf_dir, "labels").where(~held_out("doc_id")))
    score = toxicity.score(docs, model)
    return score.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = quality.ledger(_read(spark, sf_dir, "documents"))
    base_failed = ~quality.passes("base")
    return table.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), (~base_failed & quality.passes("v1")).alias("kept"), "failures",
    )


OP2_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
wins AS (SELECT row, i, list_aggregate(ws[i:i + 4], 'string_agg', ' ') AS win
         FROM (SELECT row, ws, unnest(range(1, len(ws) - 3)) AS i FROM d)),
hit AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, win) AS c FROM wins) WHERE c > 1),
cover AS (SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest(range(i, i + 5)) AS p FROM hit) GROUP BY 1),
ln AS (SELECT row, unnest(string_split(t, chr(10))) AS line FROM d),
lines AS (SELECT row, sum(c) AS n_lines, sum(c - 1) AS dup FROM
          (SELECT row, line, count(*) AS c FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1, 2) GROUP BY 1),
m AS (SELECT d.doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             length(t) - length(regexp_replace(t, '[A-ZÀ-ÖØ-Þ]', '', 'g')) AS n_upper,
             coalesce(n_lines, 0) AS n_lines, coalesce(dup, 0) AS n_dup_lines, coalesce(cover.n, 0) AS n_repeat_words
      FROM d LEFT JOIN lines USING (row) LEFT JOIN cover USING (row)),
f AS (SELECT *, CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
             + CASE WHEN 100 * n_symbols > 25 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_upper > 50 * word_chars THEN 8 ELSE 0 END
             + CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 60 * n_lines THEN 16 ELSE 0 END
             + CASE WHEN word_chars > 40 * n_words THEN 32 ELSE 0 END AS failures FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       failures & 3 <> 0 AS base_failed, failures & 15 = 0 AS kept, CAST(failures AS INTEGER) AS failures
FROM f
"""

#: The phrases that the contract of ``op3_license_scan`` names.
OP3_PHRASES = [("mit", "under the mit license"), *[p for p in licenses.PHRASES if p[0] != "mit"]]


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents"), phrases=OP3_PHRASES)


def _op3_sql() -> str:
    rows = [(i, label, text, share, phrase) for i, (label, text, share, phrase) in enumerate(licenses.templates())]
    values = ", ".join(f"({i}, '{label}', {text!r}, {sorted(set(text))!r}, {share}, {str(phrase).lower()})" for i, label, text, share, phrase in rows)
    return rf"""
WITH t(id, label, seq, tokens, share, phrase) AS (VALUES {values}),
d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT row, k, ws[32 * k + 1:32 * k + 64] AS block FROM (SELECT row, ws, unnest(range(0, (len(ws) + 31) // 32)) AS k FROM d)),
m AS (SELECT row, k, block, t.*, len(list_intersect(tokens, block)) AS common FROM b, t
      WHERE list_has_any(tokens, block) AND len(list_intersect(tokens, block)) >= ceil(share * len(tokens) - 1e-9)),
p AS (SELECT row, label, phrase, common / len(tokens) AS score,
             CASE WHEN phrase THEN list_transform(list_filter(range(0, 32), lambda s: block[s + 1:s + len(seq)] = seq), lambda s: s + 32 * k) END AS places FROM m),
g AS (SELECT row, coalesce(sum(len(places)), 0) AS n, min(list_min(places)) AS f, max(list_max(places)) AS l, max(score) AS score,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE phrase) AS base, string_agg(DISTINCT label, ',' ORDER BY label) AS every
      FROM p WHERE NOT phrase OR len(places) > 0 GROUP BY 1)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, f::BIGINT AS first_word, l::BIGINT AS last_word,
       coalesce(base, '') AS base_labels, coalesce(every, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN g USING (row)
"""


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings")
    return bit_sliced.top_k(rows.where("vec_id % 100 = 0"), rows)


OP4_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS q FROM embeddings
           WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q::DOUBLE[], b.q::DOUBLE[])::BIGINT AS score
      FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(_read(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
             md5(coalesce(doc_id::VARCHAR, '') || '|' || CASE WHEN source IS NULL THEN '' ELSE 's' || source END || '|' || md5(coalesce(text, ''))) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight,
             (3 * source_size)::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE AS budget FROM s),
l AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, weight * (SELECT arg_min(level, cap / weight) FROM l WHERE cap >= level * weight)) AS target FROM l),
r AS (SELECT d.*, t.source_size, t.target, row_number() OVER o AS nth, sum(size) OVER o - size AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source WINDOW o AS (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, floor(target)::BIGINT AS goal, before + unnest([0, 1, 2]) * source_size AS s0 FROM r),
g AS (SELECT *, s0 AS a, CASE WHEN s0 < goal AND goal < s0 + size THEN goal ELSE s0 + size END AS b FROM p
      UNION ALL SELECT *, goal, s0 + size FROM p WHERE s0 < goal AND goal < s0 + size),
f AS (SELECT *, b - a AS words, CASE WHEN target > 0 THEN b / target ELSE 1e300 END AS finish FROM g),
h AS (SELECT *, sum(words) OVER (ORDER BY finish, source NULLS LAST, a, key ROWS UNBOUNDED PRECEDING) - words AS ahead FROM f)
SELECT doc_id, size::BIGINT AS size, source_size, target, sum(greatest(0, least(words, (SELECT sum(size) FROM d) - ahead)))::BIGINT AS taken
FROM h GROUP BY source, nth, doc_id, size, source_size, target
"""


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(_read(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.document_counts(_read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrappers.extract(_read(spark, sf_dir, "pages"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(_read(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256)::BIGINT AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
FROM d
"""


def op12_late_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return late_sessions.versions(late_sessions.conversation_events(_read(spark, sf_dir, "conversations")))


#: crc32 of an ASCII string, bit by bit: DuckDB has no function for it.
_SQL_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda x: ascii(x)::BIGINT)),
        lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 1, 2, 3, 4, 5, 6, 7]),
                                 lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)), 4294967295)"""
#: The sessions of a user after each of its batches, from all events so far, and for each what it replaces and what replaces it.
OP12_SQL = f"""
WITH t AS (SELECT conv_id, turn, {_SQL_CRC.format("conv_id::VARCHAR")} AS c, {_SQL_CRC.format("conv_id::VARCHAR || ':' || turn::VARCHAR")} AS h
           FROM conversations WHERE turn IS NOT NULL AND conv_id IS NOT NULL),
e AS MATERIALIZED (SELECT *, floor(s / 3600)::BIGINT + CASE WHEN (h // 600) % 3 = 0 THEN (h // 600) % 4 ELSE 0 END AS batch FROM
      (SELECT 2 * floor(conv_id / 8)::BIGINT + c % 2 AS "user", (c // 2) % 7200 + 300 * turn + h % 600 AS s, h FROM t)),
b AS (SELECT DISTINCT "user", batch AS b FROM e),
so AS (SELECT e.*, b.b FROM e JOIN b ON e."user" = b."user" AND e.batch <= b.b),
m AS (SELECT *, CASE WHEN s - lag(s) OVER w <= 420 THEN 0 ELSE 1 END AS cut,
             CASE WHEN batch < b AND NOT coalesce(s - max(CASE WHEN batch < b THEN s END) OVER (PARTITION BY "user", b ORDER BY s, batch, h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 420, false)
                  THEN 1 ELSE 0 END AS old FROM so WINDOW w AS (PARTITION BY "user", b ORDER BY s, batch, h)),
g AS (SELECT *, sum(cut) OVER (PARTITION BY "user", b ORDER BY s, batch, h ROWS UNBOUNDED PRECEDING) AS session FROM m),
v AS MATERIALIZED (SELECT "user", b AS batch, min(s) AS start_s, max(s) AS end_s, count(*) AS n_events, count(*) FILTER (WHERE batch = b) AS n_new,
             sum(old) AS n_retracted, sum(h) AS h_sum FROM g GROUP BY "user", b, session HAVING count(*) FILTER (WHERE batch = b) > 0),
r AS (SELECT v."user", v.batch, v.start_s, min(x.batch) AS retracted_batch, arg_min(x.start_s, x.batch) AS retracted_start_s
      FROM v JOIN v x ON v."user" = x."user" AND x.batch > v.batch AND x.start_s <= v.start_s AND v.start_s <= x.end_s GROUP BY 1, 2, 3)
SELECT v."user", v.batch, v.start_s, v.end_s, n_events::BIGINT AS n_events, n_new::BIGINT AS n_new, n_retracted::BIGINT AS n_retracted, h_sum::BIGINT AS h_sum,
       retracted_batch, retracted_start_s FROM v LEFT JOIN r ON v."user" = r."user" AND v.batch = r.batch AND v.start_s = r.start_s
"""


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.transform(_read(spark, sf_dir, "documents"))


OP13_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS k,
             sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT *, len(k) AS n, ('0x' || x[1:8])::BIGINT % (len(k) + 1) AS a, ('0x' || x[9:16])::BIGINT % (len(k) + 1) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || x[17:24])::BIGINT % 100 >= 90 THEN 'plain'
                  WHEN ('0x' || x[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, array_to_string(k[1:least(a, b)], '') AS prefix, array_to_string(k[least(a, b) + 1:greatest(a, b)], '') AS middle,
             array_to_string(k[greatest(a, b) + 1:n], '') AS suffix FROM h)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_quality_rules": op2_quality_rules,
    "op3_license_scan": op3_license_scan,
    "op4_top_k": op4_top_k,
    "op5_mixing": op5_mixing,
    "op6_ngram_join": op6_ngram_join,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_bpe": op9_bpe,
    "op10_html_text": op10_html_text,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_late_sessions": op12_late_sessions,
    "op13_fill_middle": op13_fill_middle,
}
ORACLE_SQL: dict[str, str] = {
    "op2_quality_rules": OP2_SQL,
    "op3_license_scan": _op3_sql(),
    "op4_top_k": OP4_SQL,
    "op5_mixing": OP5_SQL,
    "op11_exact_dedup": OP11_SQL,
    "op12_late_sessions": OP12_SQL,
    "op13_fill_middle": OP13_SQL,
}
