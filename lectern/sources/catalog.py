"""The catalog: authors, their works, alias groups and event windows, as small tables.

A catalog is a mapping {"authors": {key: {"display_name", "life_process_context", "literature": [...],
"life_process": [...], "retrieval_aliases": [...], "event_windows": [...]}}} in a dict, a JSON file or, where a YAML
reader is installed, a YAML file. Works are {"title", "gutenberg_id", "aliases"}; their order is their priority.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODES = ("literature", "life_process")
#: Rows up to which a table of the catalog is broadcast; a larger one is joined as Spark sees fit.
BROADCAST_ROWS = 20_000

WORKS = "author_key string, author_display string, mode string, work_title string, source_id int, aliases array<string>, priority int"
GROUPS = "author_key string, pos int, mode string, role string, name string, triggers array<string>, terms array<string>"
WINDOWS = "author_key string, pos int, when array<string>, only_works array<string>"


def load(source: dict | str) -> dict:
    if isinstance(source, dict):
        return source
    with open(source, encoding="utf-8") as f:
        if source.endswith(".json"):
            return json.load(f)
        try:
            import yaml
        except ImportError as e:
            raise ImportError("a YAML catalog needs a YAML reader; JSON needs none") from e
        return yaml.safe_load(f)


def iter_works(catalog: dict, mode: str) -> Iterator[tuple[str, str, str, int]]:
    """(author_key, display name, title, id) of a mode's works in the catalog's order."""
    for key, author in (catalog.get("authors") or {}).items():
        for work in author.get(mode) or []:
            yield key, author.get("display_name", key), work["title"], work.get("gutenberg_id")


def works(spark: SparkSession, catalog: dict) -> DataFrame:
    aliases = {(k, m, w["title"]): list(w.get("aliases") or []) for k, a in (catalog.get("authors") or {}).items() for m in MODES for w in a.get(m) or []}
    rows = [(key, display, mode, title, number, aliases[key, mode, title]) for mode in MODES for key, display, title, number in iter_works(catalog, mode)]
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], WORKS)


def alias_groups(spark: SparkSession, catalog: dict) -> DataFrame:
    rows = [(k, i, g.get("mode"), g.get("role", "entity"), g.get("name"), [str(t) for t in g.get("triggers") or []], list(g.get("terms") or [])) for k, a in (catalog.get("authors") or {}).items() for i, g in enumerate(a.get("retrieval_aliases") or [])]
    return spark.createDataFrame(rows, GROUPS)


def event_windows(spark: SparkSession, catalog: dict) -> DataFrame:
    rows = [(k, i, list(w.get("when") or []), list(w.get("only_works") or [])) for k, a in (catalog.get("authors") or {}).items() for i, w in enumerate(a.get("event_windows") or [])]
    return spark.createDataFrame(rows, WINDOWS)


def dim(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has no more than so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
