"""A collection of chunks that grows: immutable batches, and a manifest that says which of them count.

A batch is written to a folder of its own, and then counts from the moment a manifest with the next number names it; manifests
are moved into place whole, and never over one that is there, so of two writers one has to try again upon the other's.
A reader takes the newest manifest once and reads its batches, whatever is written meanwhile. A batch has a name: to append
one that the collection has already changes nothing, so a failed job is simply run again.

A chunk has a key (KEY by default); of rows with one key those of the latest batch count, so a batch replaces what it repeats.
A batch may also say keys that are to go. `compact` writes what counts as one batch; `vacuum` deletes folders that no
recent manifest names.
"""

from __future__ import annotations

import json
import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What names a chunk.
KEY = ("author_key", "mode", "work_title", "section_title", "section_index", "chunk_index")
TRIES = 20


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, path: str) -> list[int]:
    at, fs = _files(spark, f"{path}/manifest")
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """{"version", "batches": [{"name", "folder", "gone"}]} of the newest (or a given) version; version 0 has no batches."""
    found = _versions(spark, path)
    version = (found[-1] if found else 0) if version is None else version
    if not version:
        return {"version": 0, "batches": []}
    at, fs = _files(spark, f"{path}/manifest/{version:020d}.json")
    stream = fs.open(at)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _commit(spark: SparkSession, path: str, now: dict) -> bool:
    """Puts a manifest into place; False where its number is taken."""
    target, fs = _files(spark, f"{path}/manifest/{now['version']:020d}.json")
    draft, _ = _files(spark, f"{path}/manifest/.{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(now).encode()))
    out.close()
    if not fs.exists(target) and fs.rename(draft, target):
        return True
    fs.delete(draft, False)
    return False


def _change(spark: SparkSession, path: str, change) -> int:
    """Commits change(batches) upon the newest manifest, again upon a newer one where another writer was first. None: nothing to do."""
    for _ in range(TRIES):
        now = manifest(spark, path)
        batches = change(now["batches"])
        if batches is None:
            return now["version"]
        if _commit(spark, path, {"version": now["version"] + 1, "batches": batches}):
            return now["version"] + 1
    raise OSError(f"{path}: other writers were first {TRIES} times")


def append(chunks: DataFrame, path: str, name: str, gone: DataFrame | None = None, key: tuple[str, ...] = KEY, by: tuple[str, ...] = ("author_key", "mode")) -> int:
    """Adds the batch `name`, which replaces older rows with its keys, and those with the keys of `gone`. The version that has it."""
    spark = chunks.sparkSession
    has = lambda batches: any(name == b["name"] or name in b.get("names", []) for b in batches)
    now = manifest(spark, path)
    if has(now["batches"]):
        return now["version"]
    folder = f"data/{uuid.uuid4().hex}"
    chunks.write.partitionBy(*by).parquet(f"{path}/{folder}")
    if gone is not None:
        gone.select(*key).write.parquet(f"{path}/{folder}-gone")
    new = {"name": name, "folder": folder, "gone": f"{folder}-gone" if gone is not None else None}
    return _change(spark, path, lambda batches: None if has(batches) else [*batches, new])


def read(spark: SparkSession, path: str, version: int | None = None, key: tuple[str, ...] = KEY) -> DataFrame:
    """The chunks that count, of the newest (or a given) version."""
    return _counted(spark, path, manifest(spark, path, version)["batches"], key)


def _counted(spark: SparkSession, path: str, batches: list[dict], key: tuple[str, ...]) -> DataFrame:
    if not batches:
        raise FileNotFoundError(f"no collection at {path}: append a batch first")
    parts = [spark.read.parquet(f"{path}/{b['folder']}") for b in batches]
    gone = [spark.read.parquet(f"{path}/{b['gone']}").withColumn("__nth", F.lit(i)) for i, b in enumerate(batches) if b["gone"]]
    if len(parts) == 1 and not gone:
        return parts[0]
    join = lambda rows: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    rows = join([p.withColumn("__nth", F.lit(i)) for i, p in enumerate(parts)])
    # keys alone are read and shuffled for it
    newest = join([rows.select(*key, "__nth"), *[g.select(*key, "__nth") for g in gone]]).groupBy(*key).agg(F.max("__nth").alias("__last"))
    # a key that a batch says is to go, and does not have itself, is left without a row
    on = [F.col(f"r.{c}").eqNullSafe(F.col(f"n.{c}")) for c in key]
    return rows.alias("r").join(newest.alias("n"), [*on, F.col("r.__nth") == F.col("n.__last")], "left_semi").drop("__nth")


def compact(spark: SparkSession, path: str, key: tuple[str, ...] = KEY, by: tuple[str, ...] = ("author_key", "mode")) -> int:
    """Writes what counts as one batch, which takes the place of those it was made of; batches appended meanwhile stay behind it. Names stay known."""
    old = manifest(spark, path)["batches"]
    folder = f"data/{uuid.uuid4().hex}"
    _counted(spark, path, old, key).write.partitionBy(*by).parquet(f"{path}/{folder}")
    one = {"name": f"compacted-{folder[5:]}", "names": sorted({n for b in old for n in [b["name"], *b.get("names", [])]}), "folder": folder, "gone": None}
    # where another one has compacted meanwhile there is nothing to do
    replaced = lambda batches: [one, *batches[len(old) :]] if batches[: len(old)] == old else None
    return _change(spark, path, replaced)


def vacuum(spark: SparkSession, path: str, keep: int = 1, older: float = 86_400) -> list[str]:
    """Deletes the folders that none of the last `keep` manifests names and that are `older` seconds old (a batch being written is younger), and manifests before those. The folders that went."""
    versions, before = _versions(spark, path), 1000 * (time.time() - older)
    held = {f for v in versions[-keep:] for b in manifest(spark, path, v)["batches"] for f in (b["folder"], b["gone"]) if f}
    at, fs = _files(spark, f"{path}/data")
    there = [(f"data/{s.getPath().getName()}", s.getModificationTime()) for s in fs.listStatus(at)] if fs.exists(at) else []
    went = sorted(f for f, t in there if f not in held and t <= before)
    for folder in went:
        fs.delete(_files(spark, f"{path}/{folder}")[0], True)
    for v in versions[:-keep]:
        fs.delete(_files(spark, f"{path}/manifest/{v:020d}.json")[0], False)
    return went
