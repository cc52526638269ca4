"""The queries of this subpackage and, where SQL can express one, its DuckDB form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontamination, html, language, media, ngram_join, quality, substring, token_files, warc
from .common import table


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.op5(table(spark, sf_dir, "pages"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.op6(table(spark, sf_dir, "pages"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op7(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.op8(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.op10(table(spark, sf_dir, "documents"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.op2(table(spark, sf_dir, "documents"))


def op3_language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.op3(table(spark, sf_dir, "documents"))


def op4_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.op4(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontamination, op2_token_files, op3_language_profiles, op4_bpe_chunks, op5_main_text, op6_warc, op7_quality, op8_substring_dedup, op9_jaccard_join, op10_media_columns)}


_WORDS = r"""list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"""

#: Removed words of windows of 20 that start earlier, told by their text.
OP8_SQL = f"""WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS words FROM documents),
  windows AS (SELECT doc_id, s, array_to_string(words[s:s + 19], ' ') AS t FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS s FROM w WHERE len(words) >= 20)),
  later AS (SELECT doc_id, s FROM windows QUALIFY row_number() OVER (PARTITION BY t ORDER BY doc_id, s) > 1),
  gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM later),
  single AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM w),
  kept AS (SELECT s.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY s.p) AS t FROM single s ANTI JOIN gone g ON g.doc_id = s.doc_id AND g.p = s.p GROUP BY 1)
  SELECT w.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept k ON k.doc_id = w.doc_id"""

#: Links by counting shared shingles, components by the closure of links.
OP9_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS words FROM documents),
  sh AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
  n AS (SELECT doc_id, count(*) AS c FROM sh GROUP BY 1),
  both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
  link AS (SELECT x, y FROM both_ b JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * b.c >= 85 * (p.c + q.c - b.c)),
  reach(x, y) AS (SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y)
  SELECT d.doc_id, coalesce(n.c, 0) AS n_shingles, least(d.doc_id, coalesce(m.y, d.doc_id)) AS component_id
  FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT x, min(y) AS y FROM reach GROUP BY 1) m ON m.x = d.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op8_substring_dedup": OP8_SQL, "op9_jaccard_join": OP9_SQL}
