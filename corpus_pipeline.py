"""A training-corpus pipeline over documents: toxicity, near-duplicates, benchmark decontamination, packing.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes to
the shared folder and reads again as the docs of the next stage. All stages but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontam, packing, simhash, toxicity
from quern.llm.common import Scratch, free_names
from quern.llm.queries import table, tokenizer_path, toxicity_model


def columns_of(docs: DataFrame) -> list[F.Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose toxicity score is 0.7 or more.

    Null and empty texts stay, texts of any length are scanned whole, repeated rows stay or go together, ids may be null,
    an empty table gives an empty one, and all columns of docs keep their values whatever their names.
    """
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    names = free_names(docs.columns, toxicity.COLUMNS)
    return toxicity.score(docs, model, names=names).where(F.col(f"`{names[1]}`") == 0).select(*columns_of(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the smallest id, of each group of near copies (five-word shingles, similarity 0.8); of
    rows that repeat an id and its text one stays. Rows with a null id stay.

    Null texts count as empty ones, and all empty ones are copies of each other; texts of any length are compared whole;
    ties go to the smaller id; an empty table gives an empty one; columns of docs keep their values whatever their names.
    """
    digest, _id, _kept = free_names(docs.columns, ("digest", "id", "kept"))
    kept = simhash.distinct_documents(docs).select(F.col("doc_id").alias(_id), F.col("digest").alias(_kept))
    known = F.when(F.col("doc_id").isNotNull(), simhash.text_digest())
    rows = docs.withColumn(digest, known)
    whole = rows.join(kept, F.col("doc_id").eqNullSafe(F.col(_id)) & F.col(digest).eqNullSafe(F.col(_kept)), "left_semi")
    repeated = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if not repeated.isEmpty():
        once = whole.where("doc_id is not null").dropDuplicates(["doc_id", digest])
        whole = once.unionByName(whole.where("doc_id is null"))
    return whole.select(*columns_of(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents of which benchmark windows cover at least one word in twenty.

    Null and empty texts stay, texts of any length are searched whole, repeated rows stay or go together, ids may be null,
    an empty table gives an empty one, and all columns of docs keep their values whatever their names.
    """
    n_words, spans, items = names = free_names(docs.columns, decontam.COLUMNS)
    found = decontam.matches(docs, table(spark, sf_dir, "benchmark"), names=names)
    return found.where(~decontam.contaminated(F.col(f"`{spans}`"), F.col(f"`{n_words}`"))).select(*columns_of(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 2048 tokens; a row per piece.

    A null or empty text is the end id alone, long texts are cut into pieces, repeated rows are packed each, a null id is
    carried, an empty table gives no piece, and other columns are not read.
    """
    return packing.packed(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: The stages learn, hash, index and tokenise, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
        scratch.drop(but_last=1)
    return docs
