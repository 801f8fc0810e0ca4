"""The test tables seen as sections, chunks, questions and catalog, for the queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.sources import catalog as cat

#: An invented catalog.
CATALOG = {
    "authors": {
        "ada": {
            "display_name": "Ada Merrow",
            "life_process_context": "Nell was her sister; the letters were edited by a friend.",
            "literature": [
                {"title": "The Lantern Keeper", "gutenberg_id": 1, "aliases": ["Lantern Keeper"]},
                {"title": "Harbour of Broken Glass", "gutenberg_id": 2, "aliases": ["Glass Harbour", "Broken Glass"]},
                {"title": "New Tales, Complete", "gutenberg_id": 3},
            ],
            "life_process": [{"title": "Collected Letters, Volume 1 (1853-1866)", "gutenberg_id": 4}, {"title": "Notes on a Life", "gutenberg_id": 5}],
            "retrieval_aliases": [
                {"mode": "life_process", "role": "entity", "name": "sister", "triggers": ["sister", "nell"], "terms": ["Nell", "her sister"]},
                {"mode": "life_process", "role": "topic", "name": "loss", "triggers": ["death", "died", "loss"], "terms": ["died", "grave"]},
                {"role": "entity", "name": "keeper", "triggers": ["keeper of the light"], "terms": ["keeper", "Nell"]},
            ],
            "event_windows": [{"when": ["sister", "loss"], "only_works": ["Notes on a Life"]}],
        }
    }
}
#: Beginnings of questions; each is put before the text of a turn. None has an apostrophe.
STARTS = [
    "What works are available? ",
    "What happens in chapter 17 of The Lantern Keeper? ",
    "How is the glass harbour like the Lantern Keeper? ",
    "Did Nell write of the death of her SISTER? ",
    "which books do you have ",
    "In chapter xvii of Broken Glass, who is the keeper of the light? ",
    "Tell me of the last chapter and of chapter civil. ",
    "",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as sections: source is the work, lang the mode, doc_id the order; ten sources are listed in a catalog."""
    n = F.regexp_extract("source", r"^src(\d)$", 1)
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("seq"), F.lit("ada").alias("author_key"), F.col("lang").alias("mode"), F.col("source").alias("work_title"),
        F.concat(F.lit("CHAPTER "), (F.col("doc_id") % 9 + 1).cast("string")).alias("section_title"), "text", F.when(n != "", 9 - n.try_cast("int")).alias("priority"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as questions, whole, each with a beginning of our own."""
    start = F.get(F.array(*map(F.lit, STARTS)), ((F.col("conv_id") + F.col("turn")) % len(STARTS)).cast("int"))
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), F.concat(start, "text").alias("question"), F.lit("ada").alias("author_key"),
        F.when(F.col("conv_id") % 2 == 0, "literature").otherwise("life_process").alias("mode"),
    )


def works(spark: SparkSession) -> DataFrame:
    return cat.works(spark, CATALOG)


def _work_of(source: Column) -> tuple[Column, Column, Column]:
    """(mode, title, priority) of a source's work: src0 to src4 are the catalog's, any other source, and none, is a work of its own."""
    listed = [(m, w["title"]) for m in cat.MODES for w in CATALOG["authors"]["ada"][m]]
    nth = F.coalesce(F.array_position(F.array(*[F.lit(f"src{i}") for i in range(len(listed))]), source) - 1, F.lit(-1)).cast("int")
    mode = F.when(F.crc32(F.coalesce(source, F.lit("")).cast("binary")) % 2 == 0, "literature").otherwise("life_process")
    of = lambda i: F.get(F.array(*[F.lit(x[i]) for x in listed]), nth)
    title = F.coalesce(of(1), F.concat(F.lit("Texts of "), source), F.lit("Texts without a source"))
    return F.coalesce(of(0), mode), title, F.when(nth >= 0, nth).otherwise(len(listed))


def source_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as sections of their sources' works."""
    mode, title, priority = _work_of(F.col("source"))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("seq"), F.lit("ada").alias("author_key"), F.lit("Ada Merrow").alias("author_display"), mode.alias("mode"), title.alias("work_title"),
        F.concat(F.lit("CHAPTER "), T.to_roman(F.col("doc_id") % 19 + 1)).alias("section_title"), F.col("doc_id").cast("int").alias("section_index"), "text", F.lit("ref").alias("source_ref"), priority.alias("priority"),
    )


def source_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog's works and those of all other sources."""
    mode, title, priority = _work_of(F.col("source"))
    found = table(spark, sf_dir, "documents").select("source").distinct().select(mode.alias("mode"), title.alias("work_title"), priority.alias("priority"))
    rest = found.join(cat.dim(works(spark).select("mode", "work_title")), ["mode", "work_title"], "left_anti")
    none = F.lit(None).cast("int"), F.array().cast("array<string>")
    return works(spark).unionByName(rest.select(F.lit("ada").alias("author_key"), F.lit("Ada Merrow").alias("author_display"), "mode", "work_title", none[0].alias("source_id"), none[1].alias("aliases"), "priority"))


def alias_groups(spark: SparkSession) -> DataFrame:
    return cat.alias_groups(spark, CATALOG)


def windows(spark: SparkSession) -> DataFrame:
    return cat.event_windows(spark, CATALOG)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as chunks, with texts of documents: label is the work."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("page_content"))
    title = F.when(F.col("vec_id") % 5 == 0, "CHAPTER I").when(F.col("vec_id") % 5 == 1, "Chapter 2.").otherwise(F.concat(F.lit("Part "), (F.col("vec_id") % 5).cast("string")))
    return v.join(d, "vec_id", "left").select(
        F.lit("ada").alias("author_key"), F.when(F.col("label") % 2 == 0, "literature").otherwise("life_process").alias("mode"), F.concat(F.lit("w"), F.col("label").cast("string")).alias("work_title"),
        title.alias("section_title"), F.lit(1).alias("section_index"), (F.row_number().over(W.partitionBy("label", F.col("vec_id") % 5).orderBy("vec_id")) - 1).alias("chunk_index"), F.coalesce("page_content", F.lit("")).alias("page_content"),
        F.concat(F.lit("ref"), F.col("vec_id").cast("string")).alias("source_ref"), "embedding", "vec_id",
    )


def understood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions whose vectors are those of some embeddings, with all that routing may find out."""
    q = F.floor(F.col("vec_id") / 20)
    work = lambda c: F.concat(F.lit("w"), (2 * (c % 5)).cast("string"))
    texts = "array<string>"
    one = F.when((q % 3 == 1) & (q % 2 == 1), F.array(work(q))).when(q % 3 == 1, F.array(work(q), work(q + 1)))
    return table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(
        F.col("vec_id").alias("qid"), F.lit("ada").alias("author_key"), F.col("embedding").alias("qvec"),
        F.when(q % 3 == 0, "oeuvre").when(q % 3 == 1, "specific_work").otherwise("life_process").alias("scope"), one.alias("work_titles"), F.array_join(one, " + ").alias("work_title"),
        F.when((q % 3 == 1) & (q % 2 == 1), F.when(q % 4 == 1, "II").otherwise("IX")).alias("chapter"),
        F.when(q % 3 == 2, F.when(q % 2 == 0, F.array(F.lit("w1"), F.lit("w3"))).otherwise(F.array(F.lit("w99")))).alias("only_works"),
        F.when(q % 2 == 0, F.array(F.lit("the "), F.lit("der "))).otherwise(F.lit(None).cast(texts)).alias("entity_terms"),
        F.when(q % 4 == 0, F.array(F.array(F.lit("of ")), F.array(F.lit("in "), F.lit("zz")))).alias("topic_groups"),
        F.when(q % 2 == 1, F.array(F.lit("Th"), F.lit("ou"))).otherwise(F.array().cast(texts)).alias("variants"),
    )
