"""The queries opN_<name>: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import quality_rules, sentencepieces
from .decontaminate import decontaminate
from .language_id import language_id
from .license_scan import TEMPLATES, license_scan
from .quality_sql import quality_sql
from .simhash_dedup import simhash_near_dedup
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_array_dedup
from .token_counts import token_counts
from .token_store import token_store


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"), threshold=0.8).select("doc_id", "license_id", "containment")


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_near_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), distance=4, shingle=4)


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), width=20, with_text=False)


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), width=50, with_text=False)


def op7_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"), digests=True, with_ids=False)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), carry=("doc_id",))
    return judged.select("row.doc_id", *quality_rules.COUNTS, "kept")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_license_scan, op2_simhash_dedup, op3_token_store, op4_decontamination, op5_substring_dedup,
        op6_suffix_array_dedup, op7_sentencepiece_codec, op8_quality_rules, op9_token_counts, op10_language_id,
    )
    return {f.__name__: f for f in found}


LICENSE_SQL = """
with templates(license_id, text) as (values {templates}),
shingles as (select license_id, unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) as s
    from (select license_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') as w from templates)),
sized as (select *, count(*) over (partition by license_id) as n from shingles),
held as (select distinct doc_id, s from (select doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) as s
    from (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') as w from documents)))
select doc_id, license_id, count(*) / any_value(n) as containment from held join sized using (s) group by all having count(*) >= 0.8 * any_value(n)
"""

WINDOW_SQL = """
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
words as (select doc_id, unnest(range(1, len(w) + 1)) as p, unnest(w) as word from d),
windows as (select doc_id, i, array_to_string(w[i:i + 19], ' ') as k from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from d)),
again as (select doc_id, i from windows qualify row_number() over (partition by k order by doc_id, i) > 1),
gone as (select distinct doc_id, i + j as p from again, range(0, 20) t(j)),
kept as (select doc_id, count(*) as n_kept, string_agg(word, ' ' order by p) as t from words anti join gone using (doc_id, p) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n_kept, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join kept using (doc_id)
"""

BYTES_SQL = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
windows as (select doc_id, i, substr(h, 2 * i + 1, 100) as k from (select doc_id, h, unnest(range(0, length(h) // 2 - 49)) as i from d)),
again as (select doc_id, i from windows qualify min(doc_id) over (partition by k) < doc_id),
edges as (select doc_id, i, coalesce(i - lag(i) over (partition by doc_id order by i) > 50, true) as opens from again),
runs as (select doc_id, run, min(i) as a, max(i) + 50 as z from (select doc_id, i, sum(opens::int) over (partition by doc_id order by i) as run from edges) group by all),
sums as (select doc_id, sum(z - a) as n_removed, count(*) as n_spans, list(a order by a) as a, list(z order by a) as z from runs group by doc_id)
select doc_id, cast(length(h) // 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, cast(coalesce(n_spans, 0) as bigint) as n_spans,
    sha256(unhex(case when n_spans is null then h else array_to_string(list_transform(range(0, n_spans + 1), lambda r: substr(h, case when r = 0 then 1 else 2 * z[r] + 1 end, case when r = n_spans then length(h) else 2 * a[r + 1] - case when r = 0 then 0 else 2 * z[r] end end)), '') end)) as kept_sha256
from d left join sums using (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    """Where SQL says the same, over the same whole tables."""
    quoted = ", ".join("('" + n.replace("'", "''") + "', '" + t.replace("'", "''") + "')" for n, t in TEMPLATES.items())
    return {"op1_license_scan": LICENSE_SQL.format(templates=quoted), "op5_substring_dedup": WINDOW_SQL, "op6_suffix_array_dedup": BYTES_SQL, "op8_quality_rules": quality_sql()}
