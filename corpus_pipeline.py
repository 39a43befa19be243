"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and gives a DataFrame, which is written as Parquet to the shared folder and
read again as the next one's ``docs``.  All stages but the last give the columns of ``docs``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import read_table, written
from tessera.llm.langid import UNDETERMINED, fold_of, identify, train_languages
from tessera.llm.mixing import mix_sources
from tessera.llm.nearcopies import one_of_each_group
from tessera.llm.packing import pack
from tessera.llm.quality import score_quality, train_quality

#: A language is accepted if it is likelier than all others together.
LEAST_LANGUAGE_SCORE = 0.5
#: A document is good from this probability of label 1 on.
LEAST_QUALITY_SCORE = 0.3


def fresh(docs: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, with as many underscores before them as it takes to be none of the columns of ``docs``."""
    taken = {c.lower() for c in docs.columns}
    lead = "_"
    while any(lead + n in taken for n in names):
        lead += "_"
    return tuple(lead + n for n in names)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the corpus names, by a model of their text alone.

    Null and empty text, text without a letter, and text that no language is likelier than not for, goes; so does all
    if no row has both text and language.  Each row is judged on its own, so ties and repeated rows share their fate.
    Columns pass through whatever they are called; an empty table stays empty.
    """
    model = train_languages(docs.where(fold_of(F.col("doc_id"), 4) != 2))
    name, score = names = fresh(docs, "language", "language_score")
    found = identify(docs, model, names)
    return found.where((F.col(name) != UNDETERMINED) & (F.col(score) >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text scores as label 1.

    Null text is empty and scored as such.  Each row is judged on its own, so ties and repeated rows share their fate;
    without labels of both kinds all rows have one score.  Columns pass through whatever they are called; an empty
    table stays empty.
    """
    labels = read_table(spark, sf_dir, "labels").where(fold_of(F.col("doc_id"), 5) != 0)
    (name,) = fresh(docs, "quality_score")
    scored = score_quality(docs, train_quality(docs, labels), name)
    return scored.where(F.col(name) >= LEAST_QUALITY_SCORE).select(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of the smallest doc_id, null last, then by its text's hash.

    Near copies share 0.8 of their five-word shingles, or are linked by documents that do; null, empty and wordless texts
    are one group.  Rows are told apart by their place in the files, so a null or repeated doc_id drops nothing that
    is nobody's copy.  Columns pass through whatever they are called; an empty table stays empty.
    """
    return one_of_each_group(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    Null, empty and wordless texts have no size and are not taken.  A null source is a source of its own, the last.
    Rows of one doc_id and source, or without an id, are taken each on its own.  Columns pass through whatever they are called; an
    empty table stays empty.
    """
    mixed = mix_sources(docs, nested="doc").where("copies > 0")
    return mixed.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' pieces in sequences of 2048 tokens.

    Null or empty text is a piece of the end id alone; a null doc_id is carried; repeated rows are packed each on its own.
    Other columns are left out; an empty table gives an empty result.
    """
    return pack(docs.select("doc_id", "text"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("quality", quality),
    ("deduplicate", deduplicate),
    ("mix", mix),
    ("pack", sequences),
]

#: Fitted models and tokens have no SQL; tests hold each stage against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of all pieces after all stages."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
