"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.llm.common import table
from lectern.llm.decontam import decontaminate
from lectern.llm.html_text import extract_text
from lectern.llm.langid import language_id
from lectern.llm.line_templates import dedup_lines
from lectern.llm.media import media_columns
from lectern.llm.packing import pack
from lectern.llm.quality import quality_scores
from lectern.llm.sharding import shard
from lectern.llm.simhash import simhash_groups
from lectern.llm.substring import repeated_passages


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents")).drop("text_key")


def op2_site_template_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op3_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_line_template_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


def op5_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


def op6_iso_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"))


def op7_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op9_output_code_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_paragraph_minhash,
        op2_site_template_removal,
        op3_fourier_quality,
        op4_line_template_dedup,
        op5_winnowing_decontamination,
        op6_iso_media,
        op7_jump_sharding,
        op8_simhash_near_dedup,
        op9_output_code_language,
        op10_best_fit_packing,
    )
    return {f.__name__: f for f in found}


OP5_SQL = r"""
WITH doc AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item, least(8, len(w)) AS span, array_to_string(list_slice(w, s, s + least(8, len(w)) - 1), ' ') AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS s FROM item WHERE len(w) > 0)),
texts AS (SELECT DISTINCT text, w FROM doc),
dwin AS (
  SELECT text, s, span, array_to_string(list_slice(w, s, s + span - 1), ' ') AS win
  FROM (SELECT text, w, span, unnest(range(1, len(w) - span + 2)) AS s
        FROM texts CROSS JOIN (SELECT DISTINCT span FROM win) WHERE len(w) >= span)),
hit AS (SELECT DISTINCT d.text, d.s, d.span, i.item FROM dwin d JOIN win i ON d.win = i.win AND d.span = i.span),
words AS (SELECT text, count(*) AS n_hit FROM (SELECT DISTINCT text, unnest(range(s, s + span)) AS p FROM hit) GROUP BY text),
ids AS (SELECT text, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hit GROUP BY text)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(i.n_items, 0) >= 2 AS contaminated
FROM doc d LEFT JOIN words n ON d.text = n.text LEFT JOIN ids i ON d.text = i.text
"""


OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text, md5(text) AS tk, string_split(text, chr(10)) AS ls FROM documents),
u AS (SELECT DISTINCT tk, ls FROM d WHERE text IS NOT NULL),
ln AS (SELECT tk, line - 1 AS line, ls[line] AS raw FROM (SELECT tk, ls, unnest(range(1, len(ls) + 1)) AS line FROM u)),
sp AS (SELECT tk, line, list_filter(string_split_regex(raw, '[ \t\r\x0B\f]+'), lambda x: x <> '') AS t FROM ln),
mk AS (SELECT tk, line, len(t) AS n, list_transform(t, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS t FROM sp WHERE len(t) > 0),
wh AS (SELECT tk, line, n, t, array_to_string(t, ' ') AS m, CAST('0x' || substr(md5(array_to_string(t, ' ')), 1, 15) AS BIGINT) AS h FROM mk),
tok AS (SELECT tk, line, n, t[1] AS a, t[2] AS b, p, t[p] AS w FROM (SELECT tk, line, n, t, unnest(range(1, n + 1)) AS p FROM wh WHERE n > 4) WHERE t[p] <> '<*>'),
frq AS (SELECT n, a, b, p, w FROM tok GROUP BY n, a, b, p, w HAVING count(DISTINCT tk) >= 10),
pat AS (
  SELECT tk, line, n, a, b, string_agg(p || ' ' || w, chr(10) ORDER BY p) AS c, count(*) AS k
  FROM (SELECT tok.* FROM tok JOIN frq ON tok.n = frq.n AND tok.a = frq.a AND tok.b = frq.b AND tok.p = frq.p AND tok.w = frq.w) GROUP BY tk, line, n, a, b),
occ AS (
  SELECT 'w' || m AS key, tk, line, h FROM wh
  UNION ALL
  SELECT 'p' || pat.n || chr(10) || pat.a || ' ' || pat.b || chr(10) || pat.c, pat.tk, pat.line, wh.h
  FROM pat JOIN wh ON pat.tk = wh.tk AND pat.line = wh.line WHERE pat.k >= 4 AND pat.k * 10 >= 6 * pat.n AND pat.k < pat.n),
cand AS (SELECT key FROM occ GROUP BY key HAVING count(DISTINCT tk) >= 10),
own AS (SELECT key, tk, min(h) AS h FROM occ SEMI JOIN cand USING (key) GROUP BY key, tk),
hs AS (SELECT DISTINCT tk, h FROM wh),
ord AS (SELECT unnest([0, 1152921504606846975, 384307168202282325, 768614336404564650]) AS c),
sg AS (
  SELECT own.key, own.tk, ord.c, coalesce(min(xor(hs.h, ord.c)), -1) AS s
  FROM own CROSS JOIN ord LEFT JOIN hs ON hs.tk = own.tk AND hs.h <> own.h GROUP BY own.key, own.tk, ord.c),
wt AS (SELECT key, tk, c, 27720 // count(*) OVER (PARTITION BY key, c, s) AS w FROM sg),
dw AS (SELECT key, tk, list_sort(list(w))[2] AS w FROM wt GROUP BY key, tk),
rec AS (SELECT key FROM dw GROUP BY key HAVING sum(w) >= 263340),
gone AS (SELECT DISTINCT tk, line FROM occ SEMI JOIN rec USING (key)),
kept AS (SELECT tk, string_agg(raw, chr(10) ORDER BY line) AS text FROM ln ANTI JOIN gone USING (tk, line) GROUP BY tk),
num AS (SELECT tk, count(*) AS n FROM gone GROUP BY tk)
SELECT doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, coalesce(num.n, 0) AS n_dropped, CASE WHEN d.text IS NOT NULL THEN coalesce(kept.text, '') END AS text
FROM d LEFT JOIN kept USING (tk) LEFT JOIN num USING (tk)
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_line_template_dedup": OP4_SQL, "op5_winnowing_decontamination": OP5_SQL}
