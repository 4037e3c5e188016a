"""The pipeline over documents: language, repeated lines, near duplicates, benchmark passages, packing.

Each stage works on all rows that the stage before it kept, written as Parquet and read again. A stage
deletes the tables that the stage before it, or an earlier run, has left in the shared folder: use the
result of one run before the next begins.

In all stages: texts of any length are worked on as a whole; a null doc_id is a doc_id; rows that repeat each
other stay or go together; an empty table gives no rows; columns that documents has besides its own are kept,
up to packing, whatever their names, but for those that begin with two underscores.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from lumenkg.llm import decontaminate, langid, linededup, neardup, packing
from lumenkg.llm.common import drop_since, made, stored, table
from lumenkg.llm.queries import vocabulary
from lumenkg.session import ship

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

_last: list[str] = []


def _begin(spark: SparkSession, docs: DataFrame) -> int:
    """Delete what the stage before has left, as its result is written by now; the place in made() from which on tables are this stage's."""
    ship(spark)
    own = made()
    rest = [p for p in own if p not in _last]
    own[:] = rest + [p for p in own if p in _last]
    drop_since(spark, len(rest), docs)
    return len(own)


def _staged(stage: Stage) -> Stage:
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        mark = _begin(spark, docs)
        kept = [p for p in _last if p in made()]  # docs itself
        out = stage(spark, docs, sf_dir)
        _last[:] = kept + made()[mark:]
        return out

    return run


@_staged
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some known language; those without a letter, and those that are mostly noise, go. A null or empty text has no letter; without any labelled row all go."""
    return langid.accepted(docs)


@_staged
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that come within one word of an earlier line; a document of such lines only goes. A null or empty text has no lines and stays; of equal lines the one with the smallest doc_id, then place, stays."""
    return linededup.deduplicated(docs)


@_staged
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles are similar by 0.8 or more: the one with the smallest doc_id. A text without words is near nothing and stays."""
    return neardup.deduplicated(docs, k=5, percent=80)


@_staged
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of benchmark items; one that is mostly such passages goes. A null or empty text has none and stays; an empty benchmark takes nothing out."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"), n=10)


@_staged
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents in sequences of 2048 tokens. A null or empty text is the end token alone."""
    return packing.packed(docs, vocabulary(), capacity=2048, end_id=0)


STAGES: list[tuple[str, Stage]] = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("decontaminated", decontaminated), ("packed", packed)]

#: SQL can express neither the first stage (a trained model) nor the last (a tokenizer); tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        _last.append(made()[-1])
    return STAGES[-1][1](spark, docs, sf_dir)
