"""A corpus pipeline: five stages over the table ``documents``, each one operator of lodestone.llm.

Every stage takes what its predecessor kept, written as Parquet and read again; all but the last
return the columns of ``documents``. Rows that repeat a doc_id are told apart by their texts: equal rows stay or go together,
others each by their own. Near-duplicate removal lets rows with a null doc_id pass, since they are no document's copy by name; a null text
has no words, so the first stage rejects it, and a later one that meets one keeps it null. A long text passes every stage whole. An
empty table gives an empty table with the columns of ``documents``, and the last stage no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.llm import sentencepieces
from lodestone.llm.decontaminate import decontaminate
from lodestone.llm.quality_rules import judge
from lodestone.llm.simhash_dedup import simhash_near_dedup
from lodestone.llm.suffix_dedup import suffix_array_dedup
from lodestone.session import made, materialize, remove, table


_scratch: list[str] = []


def _stage(f: Callable) -> Callable:
    """A stage's own tables go when the next stage begins: by then its result has been written."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        inputs = docs.inputFiles()
        done = [p for p in _scratch if p in made(spark) and not any(p.rsplit("/", 1)[-1] in i for i in inputs)]
        remove(spark, done)
        before = set(made(spark))
        out = f(spark, docs, sf_dir)
        _scratch[:] = [p for p in made(spark) if p not in before]
        return out

    return run_stage


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return judge(docs).where("kept").select("row.*")


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays."""
    found = simhash_near_dedup(docs.select("doc_id", "text"), distance=4, shingle=4, mark=True)
    others = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).distinct()
    return docs.join(others, (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_mark")), "left_anti").select(docs.columns)


@_stage
def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that an earlier document has are cut out; n_chars follows the text. Null texts stay null."""
    row = F.struct(*[F.col(c).isNull().alias(c) if c == "text" else F.col(c) for c in docs.columns])  # of the text only whether it is null
    found = suffix_array_dedup(docs, width=50, carry=row)
    new = {"text": F.when(~F.col("row.text"), F.col("kept_text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return found.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


@_stage
def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    key = F.xxhash64("doc_id", "text")  # names a row, and rows equal to it
    leaks = decontaminate(docs.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_key")).distinct()
    return docs.join(leaks, key == F.col("_key"), "left_anti").select(docs.columns)


@_stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each text, with what decoding them gives."""
    return sentencepieces.encode(docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"), digests=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_strings),
    ("benchmark decontamination", benchmark_leaks),
    ("SentencePiece encoding and decoding", tokens),
]

#: SQL cannot express the stages; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table; each one's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        last, docs = docs, materialize(stage(spark, docs, sf_dir))
        remove(spark, [p for p in made(spark) if any(p.rsplit("/", 1)[-1] in i for i in last.inputFiles())])
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
