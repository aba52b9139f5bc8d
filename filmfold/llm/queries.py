"""Registered queries of the text operators, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from filmfold.llm import (
    bpe, conversations, exact_dedup, htmltext, line_dedup, manifest, merkle, mixing, ngram_join, packing, pii, token_files, toxicity,
)
from filmfold.llm.common import table
from filmfold.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(mixing.sized(table(spark, sf_dir, "documents"))).select(
        "doc_id", "size", "source_size", "target", "taken")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return htmltext.extract(pages, htmltext.train(pages))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return toxicity.held_out(scored).select("doc_id", "held_out", "score", "predicted")


def op5_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edited_pairs(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text without lines that another line, in an earlier place, repeats."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.without_repeated_lines(docs)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.train(docs))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_documents(table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.checksums(token_files.read(spark, path))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.checksums(packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damaged(table(spark, sf_dir, "conversations")))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_bpe": op1_bpe,
    "op2_mixing": op2_mixing,
    "op3_html": op3_html,
    "op4_toxicity": op4_toxicity,
    "op5_merkle": op5_merkle,
    "op6_line_dedup": op6_line_dedup,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_pii": op8_pii,
    "op9_ngram_join": op9_ngram_join,
    "op10_token_files": op10_token_files,
    "op11_packing": op11_packing,
    "op12_conversations": op12_conversations,
    "op13_manifest": op13_manifest,
}

ORACLE: dict[str, str] = {
    "op2_mixing": r"""
        WITH docs AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                   CASE WHEN length(text) > 0 THEN
                       1 - 0.5::DOUBLE * (length(text) - length(translate(text, '#$%&*+<=>@\^_`{|}~', ''))) / length(text)
                   ELSE 1.0::DOUBLE END AS quality,
                   (CAST('0x' || substr(md5('mix:' || coalesce(doc_id, -1)), 1, 13) AS BIGINT) + 0.5::DOUBLE)
                       / 4503599627370496.0::DOUBLE AS u
            FROM documents),
        sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
        weighted AS (
            SELECT *, [5.0::DOUBLE, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight,
                   source_size * 2.0::DOUBLE AS most
            FROM sources),
        running AS (
            SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS total, sum(weight) OVER () AS weights,
                   coalesce(sum(most) OVER before, 0) AS used, coalesce(sum(weight) OVER before, 0) AS gone
            FROM weighted WINDOW before AS (
                ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        levels AS (SELECT *, (total - used) / (weights - gone) AS level FROM running),
        targets AS (
            SELECT source, source_size, CASE WHEN most / weight <= level THEN most
                   ELSE max(CASE WHEN most / weight > level THEN level END) OVER () * weight END AS target
            FROM levels),
        placed AS (
            SELECT d.doc_id, d.source, d.size, t.source_size, t.target, -ln(d.u) / d.quality AS key,
                   CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS epochs
            FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
        summed AS (
            SELECT *, target - epochs * source_size AS rest,
                   CAST(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id) AS DOUBLE) AS upto
            FROM placed),
        cuts AS (
            SELECT source, max(upto) AS cut FROM summed
            WHERE upto <= rest OR (upto - size < rest AND upto - rest < rest - (upto - size)) GROUP BY source)
        SELECT s.doc_id, s.size, s.source_size, s.target,
               (s.epochs + CASE WHEN s.upto <= c.cut THEN 1 ELSE 0 END) * s.size AS taken
        FROM summed s LEFT JOIN cuts c ON s.source IS NOT DISTINCT FROM c.source""",
    "op7_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op13_manifest": r"""
        WITH RECURSIVE table_of(i, k, c) AS (
            SELECT i, 0, i FROM range(256) r(i) UNION ALL
            SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM table_of WHERE k < 8),
        sums(doc_id, k, c) AS (
            SELECT DISTINCT doc_id, 0, 4294967295 FROM documents WHERE doc_id IS NOT NULL UNION ALL
            SELECT s.doc_id, s.k + 1, xor(t.c, s.c >> 8) FROM sums s JOIN table_of t
            ON t.k = 8 AND t.i = xor(s.c & 255, ascii(substr(CAST(s.doc_id AS VARCHAR), s.k + 1, 1)))
            WHERE s.k < length(CAST(s.doc_id AS VARCHAR))),
        hit AS (SELECT doc_id FROM sums WHERE k = length(CAST(doc_id AS VARCHAR)) AND xor(c, 4294967295) % 3 = 0),
        rows AS (
            SELECT d.doc_id, lang, coalesce(strlen(CAST(d.doc_id AS VARCHAR)) || ':' || d.doc_id, '-')
                   || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
                   || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
                   text, CASE WHEN h.doc_id IS NULL THEN text
                   ELSE translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS other
            FROM documents d LEFT JOIN hit h USING (doc_id)),
        leaves AS (
            SELECT doc_id, coalesce('=' || lang, '') AS grp, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                   sha256(head || coalesce(strlen(other) || ':' || other, '-')) AS changed FROM rows),
        placed AS (
            SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
                   count(*) OVER (PARTITION BY grp) AS n FROM leaves),
        tree(grp, level, pos, n, digest) AS (
            SELECT grp, 0, pos, n, leaf FROM placed UNION ALL
            SELECT grp, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos))
            FROM tree WHERE n > 1 GROUP BY grp, level, pos // 8, n),
        subroots AS (
            SELECT grp, digest, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
        top(level, pos, n, digest) AS (
            SELECT 0, pos, n, digest FROM subroots UNION ALL
            SELECT level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos))
            FROM top WHERE n > 1 GROUP BY level, pos // 8, n),
        heights AS (SELECT grp, max(level) AS height FROM tree GROUP BY grp),
        nodes AS (SELECT grp, level, pos, digest FROM tree WHERE n > 1 UNION ALL
                  SELECT h.grp, h.height + t.level, t.pos, t.digest FROM top t, heights h WHERE t.n > 1),
        sides AS (
            SELECT *, coalesce(string_agg(digest, '') OVER (PARTITION BY grp, level, pos // 8 ORDER BY pos
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS on_left,
                   coalesce(string_agg(digest, '') OVER (PARTITION BY grp, level, pos // 8 ORDER BY pos
                       ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS on_right
            FROM nodes),
        folded(doc_id, grp, leaf, level, place, pos, digest, proof) AS (
            SELECT doc_id, grp, leaf, 0, pos, pos, changed, '' FROM placed UNION ALL
            SELECT f.doc_id, f.grp, f.leaf, f.level + 1, f.place,
                   CASE WHEN f.level + 1 = h.height THEN r.pos ELSE f.pos // 8 END,
                   sha256(s.on_left || f.digest || s.on_right), f.proof || s.on_left || s.on_right
            FROM folded f JOIN heights h USING (grp) JOIN subroots r USING (grp)
            JOIN sides s ON s.grp = f.grp AND s.level = f.level
                AND s.pos = CASE WHEN f.level = 0 AND h.height = 0 THEN r.pos ELSE f.pos END),
        last AS (SELECT *, row_number() OVER (PARTITION BY grp, place ORDER BY level DESC) AS nth FROM folded)
        SELECT l.doc_id, l.leaf, r.digest AS subroot, t.digest AS root, sha256(l.proof) AS proof_sha256,
               l.digest AS folded_root, l.digest = t.digest AS verified
        FROM last l JOIN subroots r USING (grp) JOIN top t ON t.n = 1 WHERE l.nth = 1""",
}
