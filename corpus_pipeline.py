"""The corpus pipeline: quality classifier, exact dedup, n-gram Jaccard join, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the docs of the
next one.  All but the last return the columns of documents.

In every stage a null text counts as empty, texts are read whole whatever their length, rows and not doc_ids are decided on
(so rows that repeat a doc_id, or have none, each count), an empty table gives an empty one, and columns beside doc_id, text
and n_chars pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sluiceway.llm import exact_dedup, jaccard_join, packing, pii, quality
from sluiceway.llm.common import materialize, prepare, release, table

#: Words that a packing task remembers: the stages before leave it less memory than a query of its own has.
CACHE_WORDS = 100_000


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, fitted on labels, scores 0.5 or more.  Equal texts, also in rows that repeat a
    doc_id, get the same score and the same decision; an empty or null text is scored like any other."""
    return quality.keep_good(docs, table(prepare(spark), sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts (but for the case of A-Z) the one with the largest doc_id; null and empty texts are
    equal, a null doc_id is the smallest, and of rows equal in both any one stays."""
    return exact_dedup.keep_first(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 or more on five-word shingles the row with the least doc_id;
    of rows that repeat it the one with the least digest.  Texts without words are linked with none and all stay."""
    prepare(spark)
    return jaccard_join.keep_one(docs, words=5, num=80, den=100)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the kind in brackets in place of each span found; n_chars follows.  Null texts stay null."""
    prepare(spark)
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as pieces of token sequences; a null or empty text is its end id alone, a long one is cut at windows."""
    import public_tokenizers

    prepare(spark)
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return packing.pack(docs, f.read(), words=CACHE_WORDS)


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", without_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("personal data", without_personal_data),
    ("packing", packed),
]

#: Classifier, field and tokenizer aren't SQL; the test compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if name != STAGES[0][0]:
            release(before)  # written by the stage before
    return STAGES[-1][1](spark, docs, sf_dir)
