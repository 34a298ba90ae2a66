"""A corpus pipeline: language ID, n-gram Jaccard join, mixing to target weights, packing.

STAGES lists the stages; each takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kham.llm import jaccard_join, language_id, mixing, packing
from kham.llm.common import Workspace, id_crc, sized, small_batches

#: A document is rejected if it has no letter or if the best two languages are this close.
LEAD = 0.02
#: Where a domain, language or source has no weight of its own it weighs 1; no source is repeated here.
MIX_WEIGHTS = {"lang": {"en": 4, "fr": 2, "de": 2, "es": 2}}
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language (`und`: null, empty or without a letter) or with an ambiguous one.

    The others keep the columns of documents; each row is judged by its own whole text. Empty tables stay empty.
    """
    small_batches(spark)
    train = F.pmod(id_crc("doc_id"), F.lit(3)) != 1
    langs, model = language_id.learn(docs, train)
    rest = tuple(c for c in COLUMNS if c not in ("doc_id", "text"))
    told = language_id.identify(docs, langs, model, lead=LEAD, keep=("text", *rest))
    return told.where((F.col("lang_pred") != "und") & ~F.col("ambiguous")).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that five-word shingles link at a similarity of 0.8: the least id, null last.

    Rows are told apart by id and text, so of a repeated id only the texts go that have a copy. Rows that repeat both are
    one. Documents without words are in no group and all stay. Empty tables stay empty.
    """
    small_batches(spark)
    ws = Workspace(spark, "neardup")
    groups = jaccard_join.jaccard_components(docs, width=5, threshold=80, per_text=True).where("n_shingles > 0")
    rows = ws.stage(groups.groupBy("label", "doc_id", "text_hash").agg(F.count("*").alias("again")))
    first = rows.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "text_hash")).alias("f"), F.sum("again").alias("n"))
    first = ws.stage(first.where("n > 1").select("label", F.col("f.doc_id").alias("keep_id"), F.col("f.text_hash").alias("keep_hash")))
    in_group = rows.join(sized(first), "label")
    is_kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("text_hash") == F.col("keep_hash"))
    out = ws.stage(in_group.where(~is_kept).select(F.col("doc_id").alias("out_id"), "text_hash"))
    again = ws.stage(in_group.where(is_kept & (F.col("again") > 1)).select(F.col("doc_id").alias("out_id"), "text_hash"))
    docs = docs.select(*COLUMNS)
    same = F.col("doc_id").eqNullSafe(F.col("out_id")) & (F.xxhash64("text") == F.col("text_hash"))
    kept = docs.join(sized(out), same, "left_anti")
    if again.limit(1).count():
        once = kept.join(sized(again), same, "left_semi").dropDuplicates(["doc_id", "text"])
        kept = kept.join(sized(again), same, "left_anti").unionByName(once)
    return kept


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents of which each leaf's budget takes a part; nothing is repeated (one epoch).

    The budget is four fifths of all tokens. A document that the budget cuts stays whole. Documents without words take no
    budget and go. Rows that share id, language and source (null or not) stay if the budget takes any of them.
    """
    ws = Workspace(spark, "mixstage")
    taken = mixing.mix_sources(docs, mixing.source_domain(docs["source"]), MIX_WEIGHTS, budget=F.expr("total * 4 div 5"), max_epochs=1, name="mixstage")
    taken = ws.stage(taken.select(F.col("doc_id").alias("in_id"), F.col("lang").alias("in_lang"), F.col("source").alias("in_source")).distinct())
    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    same = F.col("doc_id").eqNullSafe(F.col("in_id")) & (of("lang") == F.col("in_lang")) & (of("source") == F.col("in_source"))
    return docs.select(*COLUMNS).where(F.regexp_like("text", F.lit(mixing.WORDS))).join(sized(taken), same, "left_semi")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a training sequence; null texts are empty, repeated rows are packed each."""
    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_stage), ("near_duplicates", near_duplicate_stage), ("mixing", mixing_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = ws.stage(docs)
    return docs


#: Packing by a tokeniser and a learned classifier are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
