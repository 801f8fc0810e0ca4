"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir), works on all that the one before kept, and returns a DataFrame.

1. language: documents that language identification rejects go; a missing language is filled in.
2. exact: of equal texts the document with the smallest id stays.
3. near: of near duplicates (five-word shingles, weighted Jaccard similarity of 0.8) the one with the smallest id stays.
4. mix: sources are brought to target weights; a document stays as often as the mix takes it.
5. tokens: texts become token ids; decoding is checked by a hash.

`run` writes each stage's result as Parquet in the shared folder and reads it again as the next one's documents. The
order of rows and of ties is fixed by ids, so reruns agree. Defined results: null and empty texts have no language and
go in the first stage, as do texts that no language is near; rows that repeat a text leave one (of equal ids one that a
hash of the row picks); a text of any length is handled as a whole; an empty table gives an empty result with the same
columns; all stages but the last pass on every column of documents, whatever its name, and a null in any other column
stays (a null source is a source of its own in the mix, a null language is filled in).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, exact_dedup, language_id, minhash, mixing
from lectern.llm.common import exists, remove_folder, shared_dir, table
from lectern.llm.entry import token_digests, tokenizer_file


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.train(docs)
    out = language_id.identify(docs, model, {f"c{i}": F.col(c) for i, c in enumerate(docs.columns)})
    lang = {c: F.coalesce(f"c{i}", "lang_pred") if c == "lang" else F.col(f"c{i}") for i, c in enumerate(docs.columns)}
    return out.where(~F.col("rejected")).select(*[x.alias(c) for c, x in lang.items()])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs, keep="smallest")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_duplicates(docs, words=5, threshold=0.8)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, weights=(1, 2, 3), cap=3)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keep = {c: F.col(c) for c in ("doc_id", "lang", "source")}
    out = bpe.round_trip(docs, tokenizer_file(), keep)
    return out.select(*keep, "n_tokens", *token_digests(), "ids")


STAGES = [("language", language), ("exact", exact), ("near", near), ("mix", mix), ("tokens", tokens)]

#: Language identification, near duplicates and BPE can't be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages over documents. Where a folder is given, stages that it holds whole are taken from it, so that a run that failed goes on where it stopped; else a stage's rows go when the next one has written its own."""
    docs, before = table(spark, sf_dir, "documents"), None
    own = folder or f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        path = f"{own}/{name}"
        if not (folder and exists(spark, f"{path}/_SUCCESS")):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        if before and not folder:
            remove_folder(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
