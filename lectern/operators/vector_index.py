"""Nearest neighbours by an index: inverted lists over k-means cells, with product codes of what the cells leave over.

`build` fits a model on a sample of at most SAMPLE vectors (by a hash of the row), in one task, and then codes every vector:
its cell and, for the difference to the cell's centre, one byte for each of `parts` stretches of dimensions. Rows are
written by cell, so a search reads the cells that it probes and no others; a cell of many vectors (one vector may be a third
of all) is cut into splits of some SPLIT_ROWS.

`search` gives each question its nearest cells. Blocks of questions meet the splits of their cells in a grid of groups,
where distances are added up from tables by code, reading no vector; the best candidates of all cells are then compared by
their vectors, exactly. How many cells and candidates that takes is measured when the model is fitted: the least numbers
with which sampled questions find `target` of their neighbours in the sample. `search.nearest` stays the exact way.

Rows without id or vector, or with another number of dimensions than most of the sample, are not indexed. Of equal
distances the smaller id comes first.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.routing import best_per
from lectern.operators.search import squared_distance
from lectern.sources.catalog import dim

SAMPLE, MOST_CELLS, SPLIT_ROWS = 32_768, 1024, 20_000
#: Questions of a block; a block's vectors are held in a task.
QUESTIONS = 2_000
#: Questions and rounds with which a model is measured and fitted.
TRIALS, ROUNDS = 200, 12


@dataclass(frozen=True)
class Model:
    centres: np.ndarray  # cells x dims
    books: np.ndarray  # parts x codes x dims of a part
    splits: list[int]  # of each cell
    probes: int
    candidates: int

    @property
    def dims(self) -> int:
        return self.centres.shape[1]

    def cells_of(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n nearest cells of each vector, nearest first."""
        d = _distances(x, self.centres)
        return np.argsort(d, axis=1, kind="stable")[:, :n]

    def _parts(self, x: np.ndarray) -> np.ndarray:
        parts, _, width = self.books.shape
        return np.pad(x, ((0, 0), (0, parts * width - x.shape[1]))).reshape(len(x), parts, width)

    def codes_of(self, rest: np.ndarray) -> np.ndarray:
        """One byte for each part of what is left of a vector beyond its cell's centre."""
        return np.stack([_distances(p, b).argmin(1) for p, b in zip(self._parts(rest).transpose(1, 0, 2), self.books, strict=True)], axis=1).astype(np.uint8)

    def table_of(self, rest: np.ndarray) -> np.ndarray:
        """For each row of rest: squared distances of its parts to all codes (parts x codes)."""
        return ((self._parts(rest)[:, :, None, :] - self.books[None]) ** 2).sum(3)


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)[:, None] + (c**2).sum(1)[None, :] - 2 * x @ c.T


def _means(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means over the different rows of x; fewer centres where there are fewer of them."""
    unique = np.unique(x, axis=0)
    c = unique[np.random.default_rng(seed).permutation(len(unique))[:k]].copy()
    for _ in range(ROUNDS):
        own = _distances(x, c).argmin(1)
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c, np.float64)
        np.add.at(total, own, x)
        c[n > 0] = (total[n > 0] / n[n > 0, None]).astype(c.dtype)
    return c


def fit(x: np.ndarray, rows: int, cells: int, parts: int, codes: int, k: int, target: float, split_rows: int = SPLIT_ROWS) -> Model:
    """A model for `rows` vectors from the sample x of them."""
    centres = _means(x, cells, 1)
    own = _distances(x, centres).argmin(1)
    plain = Model(centres, np.zeros((parts, 1, -(-x.shape[1] // parts)), np.float32), [], 0, 0)
    books = [_means(np.ascontiguousarray(p), codes, 2) for p in plain._parts(x - centres[own]).transpose(1, 0, 2)]
    width = max(len(b) for b in books)
    # a part with fewer different values repeats its last one
    books = np.stack([np.concatenate([b, np.repeat(b[-1:], width - len(b), axis=0)]) for b in books])
    per_row = rows / len(x)
    splits = [max(1, -(-int(n * per_row) // split_rows)) for n in np.bincount(own, minlength=len(centres))]
    model = Model(centres, books, splits, len(centres), len(x))
    return Model(centres, books, splits, *_measured(model, x, own, k, target))


def _measured(model: Model, x: np.ndarray, own: np.ndarray, k: int, target: float) -> tuple[int, int]:
    """(probes, candidates): the least with which questions of the sample find `target` of their k nearest of it, each step losing half of what may be lost."""
    asked = np.linspace(0, len(x) - 1, min(TRIALS, len(x))).astype(int)
    near = np.argsort(_distances(x[asked], x), axis=1, kind="stable")[:, :k]
    each = 1 - (1 - target) / 2
    order = model.cells_of(x[asked], len(model.centres))
    place = np.argsort(order, axis=1)
    probes = int(np.quantile(np.take_along_axis(place, own[near], 1), each, method="higher")) + 1
    codes, ranks = model.codes_of(x - model.centres[own]), []
    for i, q in enumerate(x[asked]):
        seen = np.flatnonzero(place[i][own] < probes)
        tables = model.table_of(q - model.centres[order[i, :probes]])
        at = place[i][own[seen]]
        d = tables[at[:, None], np.arange(codes.shape[1]), codes[seen]].sum(1)
        rank = np.empty(len(seen), np.int64)
        rank[np.argsort(d, kind="stable")] = np.arange(len(seen))
        ranks.append(rank[np.isin(seen, near[i])])
    return probes, max(4 * k, int(np.quantile(np.concatenate(ranks), each, method="higher")) + 1)


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dims)


def _clean(vectors: DataFrame, dims: int | None = None) -> DataFrame:
    """(vec_id, embedding) of the rows that can be indexed."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    v = v.where("vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL OR isnan(x))")
    return v if dims is None else v.where(F.size("embedding") == dims)


def build(vectors: DataFrame, path: str, cells: int | None = None, parts: int = 16, codes: int = 256, k: int = 8, target: float = 0.95) -> None:
    """Writes an index of vectors (vec_id, embedding) below path. cells: by default the root of their number, MOST_CELLS at most."""
    spark, v = vectors.sparkSession, _clean(vectors)
    shape = v.groupBy(F.size("embedding").alias("dims")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dims").first()
    if shape is None or not shape["dims"]:
        none = (json.dumps({"dims": 0}), b"", b"")
        spark.createDataFrame([none], "model string, centres binary, books binary").write.mode("overwrite").parquet(f"{path}/model")
        return
    dims, n = shape["dims"], shape["n"]
    split_rows = SPLIT_ROWS
    cells = cells or max(1, min(MOST_CELLS, round(n**0.5)))
    v = _clean(vectors, dims)

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts_ = [_vectors(b.column(0), dims) for b in batches]
        m = fit(np.concatenate(parts_)[:SAMPLE], n, cells, parts, codes, k, target, split_rows)
        shape_ = json.dumps({"dims": dims, "books": m.books.shape, "splits": m.splits, "probes": m.probes, "candidates": m.candidates})
        yield pa.record_batch([pa.array([shape_]), pa.array([m.centres.astype("<f4").tobytes()], pa.binary()), pa.array([m.books.astype("<f4").tobytes()], pa.binary())], names=["model", "centres", "books"])

    nth = F.xxhash64(F.lit("index"), "vec_id", "embedding")
    few = v.where(nth <= min(2**63 - 1, int(2**64 * min(1.0, 0.95 * SAMPLE / n)) - 2**63)) if n > SAMPLE else v
    # bounded: one task holds it
    few.select("embedding").repartition(1).mapInArrow(fitted, "model string, centres binary, books binary").write.mode("overwrite").parquet(f"{path}/model")
    model = open_model(spark, path)
    shared = spark.sparkContext.broadcast(model)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        splits = np.array(m.splits)
        for b in batches:
            x = _vectors(b.column(1), dims)
            own = m.cells_of(x, 1)[:, 0] if len(x) else np.zeros(0, np.int64)
            code = m.codes_of(x - m.centres[own]) if len(x) else np.zeros((0, parts), np.uint8)
            split = b.column(2).to_numpy() % splits[own]
            yield pa.record_batch([b.column(0), pa.array(own.astype(np.int32)), pa.array(split.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary()), b.column(1)], names=["vec_id", "cell", "split", "code", "embedding"])

    rows = v.select("vec_id", "embedding", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(2**31)).alias("h"))
    rows = rows.mapInArrow(coded, "vec_id long, cell int, split int, code binary, embedding array<float>")
    rows.repartition("cell", "split").sortWithinPartitions("cell", "split", "vec_id").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")


def open_model(spark: SparkSession, path: str) -> Model | None:
    """The model of an index; None for one of no vectors."""
    row = spark.read.parquet(f"{path}/model").first()
    shape = json.loads(row["model"])
    if not shape["dims"]:
        return None
    centres = np.frombuffer(row["centres"], "<f4").reshape(-1, shape["dims"])
    return Model(centres, np.frombuffer(row["books"], "<f4").reshape(shape["books"]), shape["splits"], shape["probes"], shape["candidates"])


def _probed(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, probes = shared.value
        for b in batches:
            cells = m.cells_of(_vectors(b.column(2), m.dims), probes) if b.num_rows else np.zeros((0, 0), int)
            for i, own in enumerate(cells):
                at = [(c, s) for c in own.tolist() for s in range(m.splits[c])]
                here = pa.array([i] * len(at), pa.int64())
                yield pa.record_batch([*(b.column(k).take(here) for k in range(3)), pa.array([c for c, _ in at], pa.int32()), pa.array([s for _, s in at], pa.int32())], names=["qid", "block", "qvec", "cell", "split"])

    return run


def _scored(shared, candidates: int):
    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        m = shared.value[0]
        out: list[tuple] = []
        if rows.num_rows and asked.num_rows:
            cell, split = rows.column("cell")[0].as_py(), rows.column("split")[0].as_py()
            ids = rows.column("vec_id").to_numpy()
            codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
            rest = _vectors(asked.column("qvec").combine_chunks(), m.dims) - m.centres[cell]
            at = np.arange(codes.shape[1])
            for qid, r in zip(asked.column("qid").to_pylist(), rest, strict=True):
                d = m.table_of(r[None])[0][at, codes].sum(1)
                best = np.argpartition(d, candidates - 1)[:candidates] if len(d) > candidates else np.arange(len(d))
                out.append((np.full(len(best), qid), ids[best], np.full(len(best), cell), np.full(len(best), split), d[best]))
        kinds = (np.int64, np.int64, np.int32, np.int32, np.float64)
        return pa.table([pa.array(np.concatenate([np.zeros(0, k), *(o[i] for o in out)]).astype(k)) for i, k in enumerate(kinds)], names=["qid", "vec_id", "cell", "split", "about"])

    return run


def search(spark: SparkSession, path: str, questions: DataFrame, k: int, probes: int | None = None, candidates: int | None = None) -> DataFrame:
    """(qid, vec_id, distance, rank): about the k nearest vectors of each question (qid, qvec). probes and candidates: by default those measured for the index."""
    model = open_model(spark, path)
    if model is None:
        return questions.where("false").selectExpr("qid", "0L AS vec_id", "0D AS distance", "0 AS rank")
    asked = questions.select("qid", F.col("qvec").cast("array<float>").alias("qvec")).where(F.size("qvec") == model.dims)
    probes, candidates = min(probes or model.probes, len(model.centres)), max(k, candidates or model.candidates)
    blocks = max(1, -(-asked.count() // QUESTIONS))
    shared = spark.sparkContext.broadcast((model, probes))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int")).select("qid", "block", "qvec")
    wanted = asked.mapInArrow(_probed(shared), "qid long, block int, qvec array<float>, cell int, split int")
    # a row a cell and block at most: the cells that are read at all
    met = wanted.select(F.col("cell").alias("c"), F.col("block").alias("b")).distinct()
    cells = sorted(r["c"] for r in met.select("c").distinct().collect())
    rows = spark.read.parquet(f"{path}/rows").where(F.col("cell").isin(cells))
    codes = rows.join(dim(met), F.col("cell") == F.col("c")).select("cell", "split", F.col("b").alias("block"), "vec_id", "code")
    found = codes.groupBy("cell", "split", "block").cogroup(wanted.groupBy("cell", "split", "block"))
    found = found.applyInArrow(_scored(shared, candidates), "qid long, vec_id long, cell int, split int, about double")
    few = best_per(found, ["qid"], ["about", "vec_id"], candidates).select("qid", "vec_id", "cell", "split")
    exact = rows.select("cell", "split", "vec_id", "embedding").join(few, ["cell", "split", "vec_id"]).join(asked.select("qid", "qvec"), "qid")
    exact = exact.select("qid", "vec_id", squared_distance(F.col("embedding"), F.col("qvec")).alias("distance"))
    return best_per(exact, ["qid"], [F.round("distance", 12), "vec_id"], k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(qid, neighbours, found, recall) of each question of exact (qid, vec_id)."""
    hit = exact.select("qid", "vec_id").join(found.select("qid", "vec_id").distinct().withColumn("hit", F.lit(1)), ["qid", "vec_id"], "left")
    out = hit.groupBy("qid").agg(F.count(F.lit(1)).alias("neighbours"), F.count("hit").alias("found"))
    return out.withColumn("recall", F.col("found") / F.col("neighbours"))
