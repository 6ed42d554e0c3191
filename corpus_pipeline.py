"""The corpus pipeline: quality classifier, quality rules, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
All but the last return the columns of docs, whatever other columns they have and however these are named.

Defined cases: no rows give no rows. Rows without a doc_id stay in every stage that does not reject their text. A null
text counts as empty: the classifier has no opinion of it, and the rules reject it, as they do every text of few words.
Of rows whose texts are equal or nearly so the one with the least doc_id stays, of several with that doc_id the first
read; each row is judged by its own text, so a repeated doc_id takes no other row along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import bpe, ngram_join, packing, quality_classifier, quality_rules, suffix_dedup
from tributary.llm.common import discard, scratch, table, written

#: Near duplicates: five words and a similarity of 0.8 or more.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
#: A passage of over 50 words has 101 bytes at least.
PASSAGE_BYTES = 100


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that the classifier rejects go."""
    return quality_classifier.classified(docs)


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that break a rule, or whose host is rejected, go."""
    return quality_rules.kept_rows(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of each group of near duplicates the row with the least doc_id stays."""
    return ngram_join.first_of_components(docs, SHINGLE_WORDS, SIMILAR_PERCENT)


def remove_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: passages that a document with a smaller doc_id has go from the text."""
    cut = suffix_dedup.remove_repeats(docs, PASSAGE_BYTES)
    changes = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return cut.withColumns(changes).select(*(F.col(f"`{c}`") for c in docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: pieces of documents, packed into sequences."""
    return packing.pack(docs, bpe.vocabulary_path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", classify_quality),
    ("quality rules", apply_rules),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("suffix-array dedup", remove_passages),
    ("packing", pack_sequences),
]
#: Fitted weights decide in the first stage, which SQL cannot express; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark):  # a stage's own tables go when its result is written
            done = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"), keep=True)
        discard(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
