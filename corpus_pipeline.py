"""The corpus pipeline: five stages over documents, each on all that the one before it kept.

Every stage but the last returns the columns of documents (any more than the known ones, whatever their names, as they
were), with the text, n_chars and lang that it leaves. run() writes what a stage returns as Parquet into the shared folder
and reads it again for the next. A stage of no rows gives no rows. Null, empty and wordless texts, null and repeated
doc_ids have a defined result in each stage, stated there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brooklet.llm import bpe, decontamination, language, ngram_join, substring
from brooklet.llm.common import broadcast_if_small, stored, table

#: Languages that stay; None: every language that the labelled rows teach.
LANGUAGES: list[str] | None = None
#: Near duplicates: five-word shingles, a Jaccard similarity of 0.8.
SHINGLE, NUM, DEN = 5, 80, 100
#: Words of the shortest repeated passage that substring dedup removes.
WINDOW = 50


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sets lang to the language of the text; drops documents without a letter, in no learned language or not in LANGUAGES.

    Profiles are fitted on the labelled rows of docs. Null and empty texts go; equal texts get equal results; without a
    labelled row nothing is learned, and every document goes.
    """
    return language.filtered(docs, language.fitted(docs.select("doc_id", "text", "lang")), languages=LANGUAGES)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates one document stays: that with the smallest doc_id.

    Rows of one doc_id whose texts lie in different components are judged each by its own; of those in one component the
    row with the least text stays. Of a component whose rows all lack a doc_id the row with the least text stays; beside rows with one
    they go. Documents without words are no duplicates of anything but rows of the same doc_id and text; without a
    doc_id either they stay as they are. Only what goes is joined with the documents: ids of the few, by a broadcast
    behind a count.
    """
    nodes, labels = ngram_join.labelled(docs, SHINGLE, NUM, DEN)
    judged = ngram_join.components_of(nodes, labels).where("doc_id is not null")
    by_id = judged.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("doc_id") == F.col("component_id")).alias("first"))
    special = stored(by_id.where("n > 1 or first = 0"), "special")  # ids that go, and ids of several rows
    repeated, count = special.where("n > 1").select("doc_id"), special.count()
    several = not repeated.isEmpty()
    nameless = not nodes.where("doc_id is null").isEmpty()
    out = docs.join(broadcast_if_small(special.select("doc_id"), count), "doc_id", "left_anti").select(docs.columns)
    if not several and not nameless:
        return out
    chosen = docs.where("doc_id is null") if nameless else docs.limit(0)
    if several:
        chosen = chosen.unionByName(docs.join(broadcast_if_small(repeated, count), "doc_id", "left_semi").select(docs.columns))
    own = labels.select(F.col("node").alias("_node"), F.col("root").alias("_root"), F.col("component_id").alias("_least"))
    rows = ngram_join.with_nodes(chosen, SHINGLE).join(own, "_node", "left").where("_node is null or doc_id <=> _least")
    wordless = rows.where("_node is null and doc_id is null")
    columns = [c for c in docs.columns if c not in ("doc_id", "text")]
    same = ("doc_id", "_root", F.when(F.col("_root").isNull(), F.col("text")).alias("_own"))
    first = rows.where("_node is not null or doc_id is not null").groupBy(*same).agg(F.min(F.struct("text", *columns)).alias("_row")).select("doc_id", "_row.*")
    out = out.where("doc_id is not null") if nameless else out
    return out.unionByName(first.select(docs.columns)).unionByName(wordless.select(docs.columns))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of WINDOW words or more that occur earlier (by doc_id, null first, then place, then text); documents of which nothing is left go, null and wordless texts stay."""
    return substring.replaced(docs, WINDOW)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of a benchmark item, each row by its own text; null and empty texts hold none."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of ids and decoded text; a null text counts as empty."""
    return bpe.encode_documents(docs)


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("substring dedup", drop_repeated_passages),
    ("benchmark decontamination", decontaminate),
    ("BPE encoding and decoding", encode),
]

#: No SQL: rank-order profiles, spaced seeds and byte-pair merges cannot be expressed in it; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
