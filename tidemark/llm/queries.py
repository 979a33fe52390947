"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def query(name: str, sql: str | None = None):
    def keep(plan):
        QUERIES[name] = plan
        if sql is not None:
            SQL[name] = sql
        return plan

    return keep


@query("op1_token_files")
def op1_token_files(spark, sf_dir):
    from tidemark.llm.token_files import read_token_files, write_token_files

    manifest = write_token_files(table(spark, sf_dir, "documents"), BYTE_BPE, end_id=0)
    return read_token_files(manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op2_language")
def op2_language(spark, sf_dir):
    from tidemark.llm.language import fit, held_out, predict

    docs = table(spark, sf_dir, "documents")
    found = predict(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query("op3_decontamination")
def op3_decontamination(spark, sf_dir):
    from tidemark.llm.decontamination import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op4_quality")
def op4_quality(spark, sf_dir):
    from tidemark.llm.quality import quality

    found = quality(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                        "probability")


@query("op5_ngram_join")
def op5_ngram_join(spark, sf_dir):
    from tidemark.llm.ngram_join import linked_groups

    return linked_groups(table(spark, sf_dir, "documents"), 4, 85).select("doc_id", "n_shingles", "component_id")


@query("op6_html_text")
def op6_html_text(spark, sf_dir):
    from tidemark.llm.html_text import extract

    return extract(table(spark, sf_dir, "pages"))


@query("op7_substrings")
def op7_substrings(spark, sf_dir):
    from tidemark.llm.substrings import remove_repeated

    found = remove_repeated(table(spark, sf_dir, "documents"), 13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op8_token_counts")
def op8_token_counts(spark, sf_dir):
    from tidemark.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), PIECE_BPE, 4096)


@query("op9_shards")
def op9_shards(spark, sf_dir):
    from tidemark.llm.sharding import shard_by_bytes

    rows = shard_by_bytes(table(spark, sf_dir, "documents"), 24)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))


@query("op10_packing")
def op10_packing(spark, sf_dir):
    from tidemark.llm.packing import pack

    pieces = pack(table(spark, sf_dir, "documents"), BYTE_BPE, length=1024)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


_AUDIT_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
worded AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM texts),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
failing AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS c,
    regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > least, false) AS e
  FROM worded LEFT JOIN marks USING (doc_id)),
rows AS (SELECT part, good, toxic, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END,
    CASE WHEN c THEN 'C' ELSE '' END, CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS fails, count(*) AS n
  FROM failing GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT concat(p.l, q.l, r.l, s.l, t.l) AS filter_order FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.l, q.l, r.l, s.l, t.l])) = 5),
steps AS (
  SELECT part, filter_order, k::INTEGER AS step, filter_order[k] AS name, n, good, toxic, fails,
    contains(fails, filter_order[k]) AS hit,
    len(list_filter(range(1, k), lambda j: contains(fails, filter_order[j]))) > 0 AS gone
  FROM rows, orders, (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
counted AS (
  SELECT part, filter_order, step, name, coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (NOT gone AND hit), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (gone AND hit), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (fails = name), 0)::BIGINT AS unique_fails,
    coalesce(sum(n) FILTER (NOT gone AND hit AND good), 0)::BIGINT AS good_lost,
    coalesce(sum(n) FILTER (NOT gone AND hit AND toxic), 0)::BIGINT AS toxic_lost
  FROM steps GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, name))::BIGINT AS shapley FROM counted
"""


@query("op12_filter_audit", _AUDIT_SQL)
def op12_filter_audit(spark, sf_dir):
    from tidemark.llm.filter_audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _codes_sql(rounds: int = 4) -> str:
    """Lloyd's rounds one after the other; whole numbers below 2^53, so doubles are exact."""
    steps = [r"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS MATERIALIZED (
  SELECT vec_id, p, list_slice(v, p * len(v) // 4 + 1, (p + 1) * len(v) // 4) AS x FROM kept, (SELECT unnest([0, 1, 2, 3]) AS p)),
book0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM cut QUALIFY e < 256),"""]
    for k in range(rounds + 1):
        steps.append(f"""
assigned{k} AS MATERIALIZED (
  SELECT vec_id, p, x, min(struct_pack(d := list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c), e := e)) AS near
  FROM cut JOIN book{k} USING (p) GROUP BY vec_id, p, x),""")
        if k < rounds:
            steps.append(f"""
flat{k} AS (SELECT p, near.e AS e, unnest(x) AS y, generate_subscripts(x, 1) AS place FROM assigned{k}),
means{k} AS (
  SELECT p, e, list(m ORDER BY place) AS c FROM (SELECT p, e, place, floor(sum(y) / count(*)) AS m FROM flat{k} GROUP BY ALL) GROUP BY p, e),
book{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN means{k} m USING (p, e)),""")
    steps.append(f"""
coded AS (
  SELECT vec_id, string_agg(format('{{:02x}}', near.e), '' ORDER BY p) AS code, sum(near.d)::BIGINT AS error FROM assigned{rounds} GROUP BY vec_id),
sha AS (
  SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id), sha
""")
    return "".join(steps)


@query("op13_vector_codes", _codes_sql())
def op13_vector_codes(spark, sf_dir):
    from tidemark.llm.vector_codes import encode

    return encode(table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


_EMBEDDING_SQL = r"""
WITH RECURSIVE usable AS MATERIALIZED (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
units AS MATERIALIZED (SELECT vec_id, label, v, sqrt(list_inner_product(v, v)) AS norm FROM usable),
links AS MATERIALIZED (
  SELECT p.vec_id AS a, q.vec_id AS b FROM units p JOIN units q ON p.label = q.label AND p.vec_id <> q.vec_id AND len(p.v) = len(q.v)
  WHERE list_inner_product(p.v, q.v) / (p.norm * q.norm) >= 0.98),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(b, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(b, vec_id)) AS kept
FROM embeddings LEFT JOIN degree ON vec_id = degree.a LEFT JOIN least ON vec_id = least.a
"""


@query("op11_embedding_groups", _EMBEDDING_SQL)
def op11_embedding_groups(spark, sf_dir):
    from tidemark.llm.embedding_groups import linked_vectors

    return linked_vectors(table(spark, sf_dir, "embeddings"))
