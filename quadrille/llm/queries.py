"""Registered queries of the training-data operators, one opN_<name> each, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import dart, decontam, exact, htmltext, kneser, lbl, linechunks, mixing, pii, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(_table(spark, sf_dir, "documents")).drop("locator")


def op2_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart.near_duplicates(_table(spark, sf_dir, "documents")).drop("locator")


def op3_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


def op4_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lbl.score(_table(spark, sf_dir, "documents"))


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(_table(spark, sf_dir, "pages")).drop("url")


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    sizes = docs.select("doc_id", "source", mixing.word_count(docs["text"]).alias("words"))
    sizes = mixing.staged(sizes, "mix-sizes")
    out = mixing.systematic_mix(sizes, size=sizes["words"])
    return out.select("row.doc_id", "size", "source_size", "target", "taken")


def op7_lstm_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(_table(spark, sf_dir, "pages"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linechunks.dedup_lines(_table(spark, sf_dir, "documents"), units=linechunks.window_lines)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_exact_dedup, op2_dart_minhash, op3_skip_chain_pii, op4_log_bilinear, op5_warc_revisits, op6_source_mix, op7_lstm_main_text, op8_decontamination, op9_kneser_ney_quality, op10_line_chunks)}


_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
                   count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
                   doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
                   sha256(coalesce(text, '')) AS text_sha256
            FROM documents""",
        "op5_warc_revisits": """
            WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
            f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first_id FROM p)
            SELECT page_id, n AS payload_bytes, d AS payload_digest,
                   CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to
            FROM f""",
        "op6_source_mix": r"""
            WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+'))::BIGINT AS size FROM documents),
            s AS (SELECT coalesce(source, '') AS sk, source IS NULL AS nul, count(*) AS n, sum(size)::BIGINT AS source_size FROM d GROUP BY ALL),
            w AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY nul, sk) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM s),
            r AS (SELECT *, source_size * 2.0::DOUBLE AS cap, row_number() OVER (ORDER BY source_size * 2.0::DOUBLE / weight, nul, sk) AS k FROM w),
            l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                         / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM r),
            o AS (SELECT min(k) FILTER (WHERE cap / weight > lev) AS k0, arg_min(lev, k) FILTER (WHERE cap / weight > lev) AS lev0 FROM l),
            t AS (SELECT l.*, CASE WHEN k0 IS NULL OR k < k0 THEN cap ELSE weight * lev0 END AS target FROM l, o),
            m AS (SELECT d.doc_id, d.size, t.*, floor(sqrt(d.size::DOUBLE))::BIGINT AS cls,
                         substr(md5('mix/' || coalesce(d.doc_id::VARCHAR, '')), 1, 8) AS hash
                  FROM d JOIN t ON coalesce(d.source, '') = t.sk AND (d.source IS NULL) = t.nul),
            a AS (SELECT *, row_number() OVER (PARTITION BY nul, sk ORDER BY cls, hash, size, doc_id::VARCHAR) AS i,
                         ('0x' || substr(md5('mix/offset/' || nul::INT || '/' || sk), 1, 8))::UBIGINT / 4294967296.0::DOUBLE AS u,
                         CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS step FROM m)
            SELECT doc_id, size, source_size, target, (least(floor(u + i * step) - floor(u + (i - 1) * step), 2) * size)::BIGINT AS taken FROM a""",
        "op8_decontamination": rf"""
            WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
            b AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS ws FROM benchmark),
            wins AS (SELECT DISTINCT item, ws[i : i + 12] AS win, least(len(ws), 13) AS n
                     FROM b, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS t(i) WHERE len(ws) > 0),
            sizes AS (SELECT DISTINCT n FROM wins),
            spots AS (SELECT doc_id, i, n, ws[i : i + n - 1] AS win FROM d, sizes, unnest(range(1, len(ws) - n + 2)) AS t(i)),
            hits AS (SELECT doc_id, i, s.n, item FROM spots s JOIN wins w ON s.n = w.n AND s.win = w.win),
            covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) AS t(p) GROUP BY doc_id),
            its AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id)
            SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
                   sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
            FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN its USING (doc_id)""",
    }
