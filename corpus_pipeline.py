"""Corpus cleaning as five stages over ``documents``, each on what its predecessor kept.

quality -> lines -> near duplicates -> benchmark passages -> token ids. Stages write Parquet in the folder that
executors share and the next one reads it again, so a lost executor costs one stage's tasks at most.

All stages take an empty table and columns beside those of ``documents``, whatever they are called. Null counts as an
empty text where a text is judged and stays null. Rows without doc_id are judged for quality and tokenised, and have no
part in what compares documents: no stage but the first drops them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from framelake.llm import bpe, decontam, linedup, minhash, quality
from framelake.llm.queries import ACCEPT, quality_model, vocabulary
from framelake.llm.store import Scratch
from framelake.session import ship

#: Words beyond which a run of lines that stands verbatim in an earlier document goes.
PASSAGE = 50


def _free(docs: DataFrame, name: str) -> str:
    """``name``, longer until no column is called so."""
    while name in docs.columns:
        name += "_"
    return name


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` whose doc_id isn't among ``ids`` (one column); rows without doc_id stay."""
    gone = ids.toDF(_free(docs, "__id"))
    return docs.join(gone.hint("merge"), docs["doc_id"] == gone[gone.columns[0]], "left_anti")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Repeated rows have the same score; a text without features (null,
    empty, one byte) has the score of the sample, which is that of most documents."""
    name = _free(docs, "__score")
    scored = quality.score(docs, quality_model(ship(spark), sf_dir), to=name)
    return scored.where(F.col(name) >= ACCEPT).drop(name)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines and verbatim runs of over ``PASSAGE`` words removed; a document that lost lines and has
    no words left goes. Rows that share a doc_id are cleaned as one document, null texts stay; ``n_chars`` follows."""
    lines, removed = "n_lines", "n_removed"
    own = {c: _free(docs, f"__{c}") for c in (lines, removed) if c in docs.columns}  # columns of those names are the caller's
    out = linedup.dedup_lines(docs.withColumnsRenamed(own), passage=PASSAGE)
    out = out.where(~((F.col(removed) > 0) & (F.trim(F.col("text")) == ""))).drop(lines, removed)
    out = out.withColumnsRenamed({v: k for k, v in own.items()})
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group of near duplicates, once: of rows that share its doc_id the one
    whose text has the least hash stays. Texts without words are duplicates of nothing but of their own doc_id."""
    kept = _without(docs, minhash.near_duplicates(docs).where("not kept").select("doc_id"))
    nth = _free(docs, "__nth")
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    once = kept.where("doc_id is not null").withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1).drop(nth)
    return once.unionByName(docs.where("doc_id is null"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages: those with any word inside an occurrence of a window go, with all rows of
    their doc_id. Null and empty texts have none."""
    items = ship(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    leaks = decontam.find_items(docs, items, slop=None).where("size(spans) > 0").select("doc_id").distinct()
    return _without(docs, leaks)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the text that decoding them gives: one row by row, null as an empty text."""
    spec = bpe.load_spec(ship(spark), vocabulary())
    out = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), spec, decoded="text")
    return out.select("doc_id", "lang", "source", "text", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", dedup_lines),
    ("minhash near-dedup", dedup_documents),
    ("benchmark decontamination", decontaminate),
    ("bpe encoding and decoding", tokenize),
]

#: The stages aren't expressible in SQL together; a test holds all five against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage makes of ``documents``."""
    scratch = Scratch(ship(spark))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            scratch.drop(f"stage-{k - 1}")
    return docs
