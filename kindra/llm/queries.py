"""The thin queries over whole tables, each through its operator, and the SQL of those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindra.llm.common import table
from kindra.llm.decontaminate import decontaminate
from kindra.llm.language_id import fit_languages, identify_languages
from kindra.llm.line_dedup import dedup_lines
from kindra.llm.packing import pack
from kindra.llm.quality_model import fit_quality, score_quality
from kindra.llm.quality_rules import fit_line_field, quality_rules
from kindra.llm.simhash import near_duplicates
from kindra.llm.substring_dedup import remove_repeats
from kindra.llm.token_counts import count_tokens
from kindra.llm.url_filter import filter_urls

#: Folder of the public vocabulary files; without the variable their package tells it.
TOKENIZER_DIR_VARIABLE = "KINDRA_TOKENIZERS"


def tokenizer_path(name: str) -> str:
    if folder := os.environ.get(TOKENIZER_DIR_VARIABLE):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"), keep_text=False).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    field = fit_line_field(documents, table(spark, sf_dir, "labels"))
    return quality_rules(documents, field, ["doc_id"])


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return identify_languages(documents, fit_languages(documents))


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return score_quality(documents, fit_quality(documents, table(spark, sf_dir, "labels")))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), keep_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_line_dedup, op2_packing, op3_simhash, op4_quality_rules, op5_language_id, op6_quality_model, op7_substring_dedup, op8_token_counts, op9_decontamination, op10_url_filter)
}

_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op1_line_dedup": f"""
WITH doc AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, -9223372036854775807) AS own, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (
  SELECT rid, doc_id, own, i, line, {_LOWER.format(f"trim(line, {_BLANK})")} AS key
  FROM (SELECT rid, doc_id, own, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM doc)),
gone AS (SELECT key, max(own) AS keeper FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT own) >= 3),
marked AS (SELECT l.*, g.key IS NOT NULL AND g.keeper <> l.own AS dropped FROM lines l LEFT JOIN gone g ON l.key = g.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY rid, doc_id""",
    "op7_substring_dedup": """
WITH doc AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x09-\x0D ]+'), lambda w: w <> '') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS key FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM doc WHERE len(w) >= 13)),
least AS (SELECT key, min(doc_id) AS first FROM win GROUP BY key HAVING count(*) > 1),
lost AS (SELECT w.doc_id, list_distinct(flatten(list(range(w.i, w.i + 13)))) AS gone FROM win w JOIN least l ON w.key = l.key AND l.first < w.doc_id GROUP BY w.doc_id),
kept AS (SELECT d.doc_id, d.w, coalesce(l.gone, []) AS gone FROM doc d LEFT JOIN lost l USING (doc_id)),
flat AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM kept),
stay AS (SELECT f.doc_id, string_agg(f.word, ' ' ORDER BY f.i) AS text FROM flat f LEFT JOIN (SELECT doc_id, unnest(gone) AS i FROM lost) g ON f.doc_id = g.doc_id AND f.i = g.i WHERE g.i IS NULL GROUP BY f.doc_id)
SELECT k.doc_id, CAST(len(k.w) AS BIGINT) AS n_words, CAST(len(k.gone) AS BIGINT) AS n_removed, sha256(coalesce(s.text, '')) AS kept_sha256
FROM kept k LEFT JOIN stay s USING (doc_id)""",
    "op9_decontamination": f"""
WITH doc AS (SELECT doc_id, list_filter(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w FROM documents),
item AS (SELECT item_id, list_filter(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
cut AS (SELECT item_id, w, least(len(w), 10) AS n FROM item WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS key FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM cut)),
sizes AS (SELECT DISTINCT n FROM win),
place AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS key FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, sizes WHERE len(w) >= n)),
hit AS (SELECT p.doc_id, p.i, p.n, w.item_id FROM place p JOIN win w ON p.n = w.n AND p.key = w.key),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(words.n_hit, 0) AS n_hit, coalesce(items.n_items, 0) AS n_items,
       sha256(coalesce(items.ids, '')) AS items_sha256, coalesce(words.n_hit, 0) > 0 AS contaminated
FROM doc d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
}
