"""A corpus from raw documents to packed sequences: quality, exact copies, near copies, repeated passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laminar.llm import exact_dedup, ngram_join, packing, quality, repeats
from laminar.llm.common import as_in, discard_since, plain, scratch, stash, table

#: SQL can express neither the classifier nor the packing.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches 0.3; the rules are learnt from all labelled documents (within quality.fit's bound)."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return quality.passing(docs, model, 0.3)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (white space aside): the longest, then the smallest doc_id; rows that repeat it go too."""
    own = plain(docs, "doc_id", "text").withColumn("same", F.unhex(F.sha2(exact_dedup.normalised(F.col("text")).cast("binary"), 256)))
    kept = exact_dedup.dedup(docs).filter("kept").select(F.col("doc_id").alias("kept_id"), F.unhex("text_sha256").alias("kept_same")).distinct()
    met = own.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("same") == F.col("kept_same")), "left_semi")
    return as_in(met.dropDuplicates(["doc_id", "same"]), docs, "doc_id", "text")


#: Where the numbers begin that stand for null doc_ids in a class; any doc_id below comes before them.
NO_ID = 1 << 62


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each class linked at five-word Jaccard 0.8 or more. Documents without an id come after all others, in
    the order of a hash of their text; rows that share the kept doc_id stay together."""
    number = F.coalesce("doc_id", NO_ID + F.pmod(F.xxhash64("text"), F.lit(NO_ID)))
    own = plain(docs, "doc_id", "text").withColumn("number", number)
    classes = ngram_join.link(own.select(F.col("number").alias("doc_id"), "text"), width=5, num=4, den=5)
    lost = classes.filter("doc_id <> component_id").select(F.col("doc_id").alias("number")).distinct()
    return as_in(own.join(lost, "number", "left_anti"), docs, "doc_id", "text")


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 bytes or more that a document with a smaller doc_id holds; what has no text left goes."""
    known = ("doc_id", "text", "n_chars")
    cut = repeats.remove_repeats(plain(docs, *known)).filter((F.col("_lost") == 0) | (F.trim("text") != ""))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return as_in(cut, docs, *known)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and offset."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("suffix_dedup", cut_passages),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's result written to the shared folder before the next reads it; what a stage wrote besides goes then."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        mark = len(scratch(spark))
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stash(docs, name)
            discard_since(spark, mark, docs)
    return docs
