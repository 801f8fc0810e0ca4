"""From cleaned works to numbered sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.text import HEADING, heading_identity, strip

WHOLE = "Full text"


def sections_of(text: Column) -> Column:
    """Array of (title, text): a heading and what follows it up to the next; text before the first heading is left out."""
    titles = F.regexp_extract_all(text, F.lit(HEADING), F.lit(0))
    bodies = F.slice(F.split(text, HEADING, -1), 2, F.greatest(F.size(titles), F.lit(1)))
    found = F.zip_with(titles, bodies, lambda t, b: F.struct(strip(t).alias("section_title"), strip(b).alias("text")))
    whole = F.array(F.struct(F.lit(WHOLE).alias("section_title"), text.alias("text")))
    return F.when(F.size(titles) > 0, F.filter(found, lambda s: s["text"] != "")).otherwise(whole)


def split_works(works: DataFrame, text_col: str = "text") -> DataFrame:
    """A row per section of each work: the work's other columns, pos, section_title, text."""
    rest = [c for c in works.columns if c != text_col]
    # outer: an inner explode would have the array computed again in a filter below it
    out = works.select(*rest, F.posexplode_outer(sections_of(F.col(text_col))).alias("pos", "s"))
    return out.where("pos IS NOT NULL").select(*rest, "pos", "s.section_title", "s.text")


def mark_stubs(sections: DataFrame, work: list[str], max_chars: int = 400, ratio: int = 5) -> DataFrame:
    """sections with is_stub: short, and another section of the work with the same identity is over `ratio` times as long."""
    w = W.partitionBy(*work, heading_identity(F.col("section_title")))
    size = F.length("text")
    return sections.withColumn("is_stub", (F.count(F.lit(1)).over(w) > 1) & (size < max_chars) & (size * ratio < F.max(size).over(w)))


def drop_stubs(sections: DataFrame, work: list[str], max_chars: int = 400, ratio: int = 5) -> DataFrame:
    return mark_stubs(sections, work, max_chars, ratio).where(~F.col("is_stub")).drop("is_stub")


def number_sections(sections: DataFrame, work: list[str], order: str = "pos", ref: Column | None = None) -> DataFrame:
    """sections with section_index from 1 within the work, and source_ref if given."""
    out = sections.withColumn("section_index", F.row_number().over(W.partitionBy(*work).orderBy(order)))
    return out if ref is None else out.withColumn("source_ref", ref)
