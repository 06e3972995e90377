"""What the corpus pipeline's stages do with the operators: each takes documents and returns documents.

Defined results, for all stages: null and empty texts are documents like any other, that the quality rules and the
language stage reject; null ids are kept apart from each other where a stage doesn't compare texts; repeated rows are
documents of their own until near-deduplication, which keeps one of them; an empty table gives an empty table with the
same columns; other columns, whatever their names, pass by. Stages with Python workers lower the session's limit for what
goes to a worker at once (`common.small_batches`), which never changes a result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import op6_langid as langid
from . import shingles
from .common import small_batches
from .op1_packing import pack
from .op4_quality import filter_documents
from .op7_simhash import deduplicate
from .op10_pii import protect

#: A document goes if its language has less than this share of the posterior.
LEAST_SCORE = 0.3
#: And if no language fits it better than the background by so many nats an n-gram.
LEAST_FIT = 2.0


def quality(docs: DataFrame) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts have no words and go; repeated rows all stay or all go."""
    return filter_documents(docs)


def language(docs: DataFrame) -> DataFrame:
    """Documents in a language that can be told; learns from the column lang of the documents themselves.

    Null texts, texts without a letter and texts that no learned language fits go; between equal languages the first in
    order is taken, which doesn't matter here; without any lang only texts without a letter go."""
    small_batches(docs.sparkSession)
    doc_id, text = F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    model = langid.learn(docs.select(doc_id, "lang", text))
    if not model[0]:
        return docs.where(F.col("text").cast("string").rlike(r"\p{L}"))  # nothing to tell languages by: only what has no letter goes
    # a text goes to the workers once: in the row only if it is no string there
    apart = [c for c in docs.columns if c == "text" and dict(docs.dtypes)[c] == "string"]
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in apart)).alias("rest_of_row")
    told = langid.predict(docs.select(rest, text), model).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE) & (F.col("fit") >= LEAST_FIT))
    return told.select(*("text" if c in apart else F.col("rest_of_row")[c].alias(c) for c in docs.columns))


def near_dedup(docs: DataFrame) -> DataFrame:
    """One document of each group of near-duplicates by operator 7 (three words, three bits): the one with the smallest id,
    a null id only if there is no other, and of equal ids the one with the smallest hash of all columns."""
    return deduplicate(docs)


def similar_dedup(docs: DataFrame) -> DataFrame:
    """One document of each group of five-word similarity 0.8, by operator 7's balls, verified, and by prefixes where they
    don't reach: the one with the smallest id, a null id only if there is no other, and of equal ids the one with the
    smallest hash of all columns. Null and empty texts are equal texts."""
    small_batches(docs.sparkSession)
    return shingles.deduplicate(docs)


def pseudonyms(docs: DataFrame, key: str) -> DataFrame:
    """All documents, repeated rows included, with pseudonyms for what identifies people; n_chars follows the text. A null
    text stays null, with n_chars null; equal values get equal pseudonyms in all documents."""
    out = protect(docs, key, counts=False)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def packing(docs: DataFrame) -> DataFrame:
    """The pieces of all documents, with their ids and places in sequences. A null text is an empty one, which is the end
    id alone; repeated rows are packed each; documents of a class fill its bins in the order in which they come."""
    small_batches(docs.sparkSession)
    return pack(docs)
