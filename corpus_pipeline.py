"""The corpus pipeline: documents -> toxicity -> near-duplicates -> personal data -> mixing -> BPE.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of documents. run() writes each
stage's rows as Parquet into the shared folder and reads them back as the next one's docs.

Cases: rows with a null doc_id and such with a doc_id that others have too are rows like all others; no stage joins by doc_id what
it returns. Null and empty texts have no toxicity, no personal data and no near-duplicates but rows that equal them in all columns, and
no words: the mix takes none of them, so they end there. Repeated rows count once from the second stage on. Texts are
read whole. An empty table, or labels of one class only, reject nothing; other columns than those of documents are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm import bpe, minhash, mixing, pii, toxicity
from gradeloom.llm.shared import SPACE, dropped, scratch, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Least similarity of near-duplicates; the 85 of op7_minhash is that query's own. 24 bands of 6 miss a pair at 0.8 with p about 0.0007.
PERCENT = 80


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among docs, doesn't reject."""
    docs = docs.select(COLUMNS)
    with scratch():
        model, _ = toxicity.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where("score < 0.5").select(COLUMNS)


def keyed(docs: DataFrame) -> DataFrame:
    """docs with a number for each row, written, so that it stays the same: doc_id may be null or repeated."""
    return stored(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "keyed")


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group, a null one after all others; of repeated rows one.
    Texts without words are in no group: of such rows, those that are equal in all columns count as one.
    """
    docs = keyed(docs)
    groups = minhash.near_duplicates(docs.select(F.col("row").alias("doc_id"), "text"), PERCENT)
    groups = groups.select(F.col("doc_id").alias("row"), F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("group"))
    some = F.coalesce(F.col("text").rlike(f"[^{SPACE}]"), F.lit(False))
    ids = docs.select("row", "doc_id", F.when(~some, F.to_json(F.struct(*COLUMNS))).alias("same"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))["row"]
    kept = ids.join(groups.hint("merge"), "row").groupBy("group", "same").agg(first.alias("row")).select("row")
    return docs.join(stored(kept, "kept").hint("merge"), "row", "left_semi").select(COLUMNS)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with spans replaced by their kinds; n_chars follows."""
    return pii.redact(docs.select(COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each whole copy that the mix takes, in the order in which training sees them."""
    docs = keyed(docs)
    taken = mixing.schedule(mixing.mix(docs, whole=True, keep=("row",)), ("row",))
    docs = docs.join(stored(taken, "taken").hint("merge"), "row")
    return mixing.in_order(docs, "row", "copy").select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every row as digests, with the lengths."""
    return bpe.digest(docs, keep=("doc_id", "lang", "source", "n_chars"))


STAGES = [
    ("toxicity", remove_toxic),
    ("minhash", remove_near_duplicates),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: A classifier, a sketch and a tokenizer are not expressible in SQL; the tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch() as keep:
            docs = stored(stage(spark, docs, sf_dir), name)
            keep(docs)
        if before is not None:
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
