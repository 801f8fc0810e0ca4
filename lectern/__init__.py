"""A Spark engine for building, de-duplicating, searching and answering from a curated text corpus."""
