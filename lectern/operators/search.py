"""Searching chunks: filters, nearest neighbours, extra channels, fusion and the relevance gate.

Any number of questions is answered in one plan: blocks of questions meet blocks of chunks in a grid of groups, where
distances are a matrix product, metadata and terms are looked up once a block, and only the best k rows a question and
channel are passed on. Distances are squared Euclidean. Ties fall by work, section and chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lectern.operators.dedup import packed, settle, settle_packed, unpacked
from lectern.operators.routing import best_per, chapter_variants
from lectern.sources.catalog import dim

# Depths, limits and distances.
TOP_K, TOP_K_WORK, TOP_K_CHAPTER, ALIAS_K, KEYWORD_K, MERGED, NEIGHBOUR_HITS, KEY_CHARS = 5, 8, 12, 8, 6, 12, 2, 60
MAX_DISTANCE, MAX_DISTANCE_SCOPED = 1.3, 2.0
# End of fixed values.
CHUNK_ORDER = ("work_title", "section_title", "section_index", "chunk_index")
#: Questions and chunks or vectors of a block, about.
QUESTIONS_AT_ONCE, ROWS_AT_ONCE = 2_000, 4_000
#: The same, at most, where lists are searched by products of single precision.
WIDE_QUESTIONS, WIDE_ROWS = 32_000, 64_000


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, d: s + d)


def grid(questions: DataFrame, rows: DataFrame, by: list[str], blocks: tuple[int, int]) -> tuple[GroupedData, GroupedData]:
    """Both sides dealt to blocks (of questions by qid, of rows at random) and grouped so that every block of one meets every block of the other, within equal values of `by`.

    Either side is sent as often as the other has blocks; nothing passes through the driver, and a group holds two blocks.
    """
    asked, held = blocks
    each = lambda n: F.explode(F.array(*[F.lit(i) for i in range(n)])) if n <= 100 else F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = questions.withColumn("qb", F.pmod(F.xxhash64("qid"), F.lit(asked)).cast("int")).withColumn("rb", each(held))
    right = rows.withColumn("rb", F.pmod(F.xxhash64(*rows.columns), F.lit(held)).cast("int")).withColumn("qb", each(asked))
    return left.groupBy(*by, "qb", "rb"), right.groupBy(*by, "qb", "rb")


def blocks_of(questions: DataFrame, rows: DataFrame) -> tuple[int, int]:
    return max(1, -(-questions.count() // QUESTIONS_AT_ONCE)), max(1, -(-rows.count() // ROWS_AT_ONCE))


def wide_blocks_of(questions: DataFrame, rows: DataFrame) -> tuple[int, int]:
    """Blocks as large as a task can hold, since either side is sent as often as the other has blocks; smaller ones of rows where those were fewer than twice the cores."""
    asked = max(1, -(-questions.count() // WIDE_QUESTIONS))
    return asked, _held(rows, asked)


def _held(rows: DataFrame, asked: int) -> int:
    n = rows.count()
    few = min(-(-n // ROWS_AT_ONCE), -(-2 * rows.sparkSession.sparkContext.defaultParallelism // asked))
    return max(1, -(-n // WIDE_ROWS), few)


def _matrix(column: pa.ChunkedArray, n: int, single: bool = False) -> np.ndarray:
    """Vectors as rows of double precision, or, if allowed, of single precision where they come so."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(flat.dtype if single and flat.dtype == np.float32 else np.float64, copy=False).reshape(n, -1)


def _rough(q: np.ndarray, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first question, rounded squared distances to all rows of x) of stretches of questions."""
    norms = (x**2).sum(1)
    for lo in range(0, len(q), 256):
        part = q[lo : lo + 256]
        yield lo, np.maximum((part**2).sum(1)[:, None] + norms[None, :] - 2 * part @ x.T, 0)


def _block_best(k: int, by: list[str], digits: int):
    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if asked.num_rows and rows.num_rows:
            own, qids = rows.column("vec_id").to_numpy(), asked.column("qid").to_numpy()
            x, q = _matrix(rows.column("embedding"), len(own)), _matrix(asked.column("qvec"), len(qids))
            for lo, d in _rough(q, x):
                # what is as near as the k-th but for rounding of the product is compared exactly
                edge = np.partition(d, k - 1, axis=1)[:, k - 1] + 1e-9 + 10.0**-digits if d.shape[1] > k else np.full(len(d), np.inf)
                for i in range(len(d)):
                    some = np.flatnonzero(d[i] <= edge[i])
                    exact = ((x[some] - q[lo + i]) ** 2).sum(1)
                    first = np.lexsort((own[some], np.round(exact, digits)))[:k]
                    out.append((np.full(len(first), qids[lo + i]), own[some[first]], exact[first]))
        found = [pa.array(np.concatenate([o[j] for o in out])) for j in range(3)]
        of = [asked.column(c).take(pa.array(np.zeros(len(found[0]), np.int64))) for c in by]  # one value a group
        return pa.table([*found, *of], names=["qid", "vec_id", "distance", *by])

    return run


def nearest(questions: DataFrame, vectors: DataFrame, k: int, by: list[str] = (), digits: int = 12) -> DataFrame:
    """(qid, vec_id, distance, by..., rank): the k nearest vectors (vec_id, embedding) of each question (qid, qvec), exactly, by matrix products of blocks.

    by: columns of both that must be equal, and not null. Distances equal in so many digits are ranked by vec_id.
    """
    by = list(by)
    held = " AND ".join(f"{c} IS NOT NULL" for c in ["vec_id", "embedding", *by])
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", *by).where(held)
    q = questions.select("qid", "qvec", *by)
    left, right = grid(q, v, by, blocks_of(q, v))
    found = left.cogroup(right).applyInArrow(_block_best(k, by, digits), ", ".join(["qid long", "vec_id long", "distance double", *(f"{c} {q.schema[c].dataType.simpleString()}" for c in by)]))
    return best_per(found, ["qid"], [F.round("distance", digits), "vec_id"], k)


def depth() -> Column:
    """How many hits a question gets, by its scope and chapter."""
    return F.when((F.col("scope") == "specific_work") & F.col("chapter").isNotNull(), TOP_K_CHAPTER).when(F.col("scope") == "specific_work", TOP_K_WORK).otherwise(TOP_K)


def contains_any(text: Column, terms: Column) -> Column:
    """One of the terms stands in the text, letter for letter; false for no terms."""
    return F.coalesce(F.exists(terms, lambda t: F.contains(text, t)), F.lit(False))


def in_scope() -> Column:
    """Chunk and question agree in author, mode and, for specific works, title."""
    mode = F.when(F.col("scope") == "life_process", "life_process").otherwise("literature")
    return (F.col("c.mode") == mode) & ((F.col("scope") != "specific_work") | F.array_contains("work_titles", F.col("c.work_title")))


def in_window() -> Column:
    return F.col("only_works").isNull() | F.array_contains("only_works", F.col("c.work_title"))


def in_chapter() -> Column:
    return F.col("chapter").isNull() | F.array_contains(chapter_variants(F.col("chapter")), F.col("c.section_title"))


def relax(understood: DataFrame, chunks: DataFrame) -> DataFrame:
    """Questions without a chunk in their window or chapter lose that restriction. Reads no texts and no vectors."""
    meta = chunks.select("author_key", "mode", "work_title", "section_title").distinct().alias("c")
    q = understood.where("only_works IS NOT NULL OR chapter IS NOT NULL")
    met = dim(q).join(meta, (q["author_key"] == F.col("c.author_key")) & in_scope() & in_window() & in_chapter(), "left_semi").select("qid").withColumn("met", F.lit(True))
    out = understood.join(met, "qid", "left")
    return out.withColumns({"only_works": F.when(F.col("met"), F.col("only_works")), "chapter": F.when(F.col("met"), F.col("chapter"))}).drop("met")


def term_finder(terms: set[str]) -> Callable[[str], list[str]]:
    """A function that lists those of the terms that stand in a text; one pass over the text where an Aho-Corasick automaton is installed."""
    plain = {t for t in terms if t}
    if not plain:
        return lambda text: []
    try:
        import ahocorasick
    except ImportError:
        return lambda text: [t for t in plain if t in text]
    automaton = ahocorasick.Automaton()
    for t in plain:
        automaton.add_word(t, t)
    automaton.make_automaton()
    return lambda text: list({t for _, t in automaton.iter(text)})


def with_terms(rows: DataFrame, terms: DataFrame, text_col: str = "text", block_chars: int = 2_000_000) -> DataFrame:
    """Those rows whose text holds one of the terms (a column `term`), letter for letter. Terms are taken in blocks of bounded size, each in one pass over the texts."""
    at = rows.columns.index(text_col)

    def holds(block: set[str]) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find = term_finder(block)
            for batch in batches:
                yield batch.filter(pa.array([bool(find(t)) if t else False for t in batch.column(at).to_pylist()], pa.bool_()))

        return run

    found, block, size = None, set(), 0
    for r in terms.where("term <> ''").distinct().toLocalIterator():
        block.add(r["term"])
        size += len(r["term"])
        if size >= block_chars:
            part = rows.mapInArrow(holds(block), rows.schema)
            found, block, size = part if found is None else found.union(part), set(), 0
    part = rows.mapInArrow(holds(block), rows.schema) if block or found is None else None
    out = part if found is None else found if part is None else found.union(part)
    return out if found is None else out.distinct()


#: What names a chunk.
CHUNK_KEY = ("author_key", "mode", "work_title", "section_title", "section_index", "chunk_index")
HIT = "qid long, channel int, title_pos int, tier int, k int, distance double"


#: Questions whose rough distances to a block are held at once, chunks whose k-th tells which others can be nearer, and pairs compared exactly at once.
TILE, HEAD, PAIRS = 256, 8192, 1 << 14


class _List(NamedTuple):
    """A list that a question is answered from; title_pos is the place of its work among those named, 0 if it is of all."""

    channel: int
    title_pos: int
    work: str | None
    terms: list[str] | None
    topics: tuple[tuple[str, ...], ...]
    k: int


def _lists(r: dict, held: dict[str, np.ndarray]) -> Iterator[_List]:
    """The lists of a question that may hold a chunk of the block; held: the chunks that hold a term."""
    titles = r["work_titles"] or []
    if r["scope"] == "specific_work" and len(titles) > 1:
        for i, t in enumerate(titles):
            if t not in titles[:i]:
                yield _List(4, i + 1, t, None, (), max(2, -(-r["top_k"] // len(titles))))
    else:
        yield _List(4, 0, None, None, (), r["top_k"])
    if terms := [t for t in r["entity_terms"] or [] if t in held]:
        yield _List(1, 0, None, terms, tuple(tuple(g) for g in r["topic_groups"] or []), ALIAS_K)
    if terms := [t for t in r["variants"] or [] if t in held]:
        yield _List(2, 0, None, terms, (), KEYWORD_K)


class _Chunks:
    """Chunks of a block: what names them, their vectors, and who holds which term."""

    def __init__(self, rows: pa.Table, terms: set[str]):
        keys = [rows.column(c).to_pylist() for c in CHUNK_KEY]
        self.n, self.place, self.works = rows.num_rows, _ranks(keys[2:]), np.array(keys[2], object)
        kinds = {x: i for i, x in enumerate(dict.fromkeys(zip(keys[2], keys[3], strict=True)))}
        self.kinds, self.kind = list(kinds), np.array([kinds[x] for x in zip(keys[2], keys[3], strict=True)])
        held: dict[str, list[int]] = {}
        if any(terms):
            find = term_finder(terms)
            for i, t in enumerate(rows.column("page_content").to_pylist()):
                for found in find(t or ""):
                    held.setdefault(found, []).append(i)
        self.held = {t: np.array(x, np.int32) for t, x in held.items()}
        self.x = _matrix(rows.column("embedding"), self.n, single=True)
        norms = np.einsum("ij,ij->i", self.x, self.x, dtype=np.float64)
        self.longest, self.norms, self.single = norms.max(), norms.astype(np.float32), self.x.astype(np.float32, copy=False)
        self.fits: dict[tuple, np.ndarray | None] = {}
        self.tiers: dict[tuple, np.ndarray] = {}

    def fitting(self, works: tuple | None, window: tuple | None, chapters: tuple | None, work: str | None) -> np.ndarray | None:
        """Which chunks fit the named works, window and chapters, and are of one work; None: all."""
        key = (works, window, chapters, work)
        if key not in self.fits:
            of = [(works is None or w in works) and (window is None or w in window) and (chapters is None or s in chapters) and (work is None or w == work) for w, s in self.kinds]
            self.fits[key] = None if all(of) else np.array(of, bool)[self.kind]
        return self.fits[key]

    def having(self, terms: list[str] | tuple[str, ...]) -> np.ndarray:
        out = np.zeros(self.n, bool)
        for t in terms:
            if t in self.held:
                out[self.held[t]] = True
        return out

    def tier(self, topics: tuple[tuple[str, ...], ...]) -> np.ndarray:
        """Chunks with a term of each of the first topics come before others."""
        if topics not in self.tiers:
            tier, going = np.zeros(self.n, np.int64), np.ones(self.n, bool)
            for g in topics:
                going &= self.having(g)
                tier -= going
            self.tiers[topics] = tier
        return self.tiers[topics]

    def best(self, asked: list[dict], q: np.ndarray) -> tuple[np.ndarray, ...]:
        """(question, channel, title_pos, tier, k, distance, chunk) of the best chunks of each list of these questions.

        Products of single precision leave out what is farther than a list's k-th by more than they can be wrong. The rest is
        compared exactly, and rounded, so that what comes out does not depend on the block.
        """
        with np.errstate(over="ignore", invalid="ignore"):
            slack = np.float32(8 * (q.shape[1] + 8) * 2.0**-24 * (self.longest + np.einsum("ij,ij->i", q, q, dtype=np.float64).max()))
            usual = slack < 1e30
            # vectors that are no numbers, or too large, are all compared
            rough = self.norms[None, :] - (2 * q.astype(np.float32, copy=False)) @ self.single.T if usual else np.zeros((len(q), self.n), np.float32)
        lists: list[tuple[int, int, int, int]] = []
        found: list[tuple[np.ndarray | int, np.ndarray, np.ndarray | int]] = []
        plain: dict[int, list[tuple[int, int]]] = {}
        some_of = lambda x: None if x is None else tuple(x)

        def near(j: int, some: np.ndarray, k: int) -> np.ndarray:
            if len(some) <= k or not usual:
                return some
            d = rough[j, some]
            return some[d <= np.partition(d, k - 1)[k - 1] + slack]

        for j, r in enumerate(asked):
            works = some_of(r["work_titles"] or []) if r["scope"] == "specific_work" else None
            for x in _lists(r, self.held):
                mask = self.fitting(works, some_of(r["only_works"]), some_of(r["chapters"]), x.work)
                at = len(lists)
                lists.append((j, x.channel, x.title_pos, x.k))
                if x.terms is None and mask is None:
                    plain.setdefault(x.k, []).append((at, j))
                    continue
                which = mask if x.terms is None else self.having(x.terms) if mask is None else self.having(x.terms) & mask
                some = np.flatnonzero(which)
                if not x.topics:
                    found.append((np.full(len(own := near(j, some, x.k)), at), own, np.zeros(len(own), np.int64)))
                    continue
                tier = self.tier(x.topics)[some]
                for t in np.unique(tier):
                    found.append((np.full(len(own := near(j, some[tier == t], x.k)), at), own, np.full(len(own), t)))
        for k, who in plain.items():
            at, j = np.array(who).T
            d = rough[j]
            # what is as near as the k-th of some chunks may be among the k nearest of all
            edge = np.partition(d[:, :HEAD], k - 1, axis=1)[:, k - 1 : k] if min(HEAD, self.n) > k and usual else np.full((len(d), 1), np.inf)
            row, own = np.divmod(np.flatnonzero(d <= edge + slack) if usual else np.arange(d.size), self.n)
            found.append((at[row], own, np.zeros(len(row), np.int64)))
        at, own, tier = (np.concatenate([np.zeros(0, np.int64), *(f[i] for f in found)]) for i in range(3))
        j, channel, pos, k = np.array(lists).T
        row, d = j[at], np.zeros(len(at))
        for lo in range(0, len(at), PAIRS):
            d[lo : lo + PAIRS] = np.round(((self.x[own[lo : lo + PAIRS]].astype(np.float64) - q[row[lo : lo + PAIRS]]) ** 2).sum(1), 12)
        order = np.lexsort((self.place[own], d, tier, at))
        order = order[np.arange(len(at)) - np.searchsorted(at[order], at[order]) < k[at[order]]]
        at = at[order]
        return j[at], channel[at], pos[at], tier[order], k[at], d[order], own[order]


def _ranks(columns: list[list]) -> np.ndarray:
    """The place of each row in the order of these columns, nulls first; equal rows share theirs."""
    coded = []
    for c in columns:
        order = {v: i for i, v in enumerate(sorted({x for x in c if x is not None}))}
        coded.append([-1 if x is None else order[x] for x in c])
    _, rank = np.unique(np.array(coded).T, axis=0, return_inverse=True)
    return rank.reshape(-1)


def _block_channels(asked_rows: pa.Table, rows: pa.Table) -> pa.Table:
    """The best chunks of a block by question, channel and title; only what names them, and the distance."""
    out: list[tuple] = [tuple(np.zeros(0, np.float64 if i == 5 else np.int64) for i in range(7))]
    if asked_rows.num_rows and rows.num_rows:
        asked = asked_rows.drop_columns(["qvec"]).to_pylist()
        chunks = _Chunks(rows, {t for r in asked for t in [*(r["entity_terms"] or []), *(r["variants"] or []), *(t for g in r["topic_groups"] or [] for t in g)]})
        q = _matrix(asked_rows.column("qvec"), len(asked), single=True)
        for lo in range(0, len(asked), TILE):
            j, *best = chunks.best(asked[lo : lo + TILE], q[lo : lo + TILE])
            out.append((j + lo, *best))
    at = [np.concatenate([o[i] for o in out]) for i in range(7)]
    named = [rows.column(c).take(pa.array(at[6])) for c in CHUNK_KEY]
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
    head = [asked_rows.column("qid").take(pa.array(at[0])), *(pa.array(c).cast(t) for c, t in zip(at[1:6], kinds, strict=True))]
    return pa.table([*head, *named], names=["qid", "channel", "title_pos", "tier", "k", "distance", *CHUNK_KEY])


def _channels(questions: DataFrame, chunks: DataFrame, shown: DataFrame | None = None) -> DataFrame:
    """Best hits by channel: 1 alias, 2 keyword, 4 normal; with pos, the place within the channel. shown: what of the chunks joins them (CHUNK_KEY and more), all but vectors by default.

    Block by block of questions, the chunks of their author and mode are sent once, compressed, to groups that each pass on their
    best by name; what a block has sent is gone before the next. Texts are joined to what is left of all.
    """
    name = [F.col(c).cast("long") if c.endswith("index") else F.col(c) for c in CHUNK_KEY]
    vectors = chunks.where("embedding IS NOT NULL").select(*[x.alias(c) for x, c in zip(name, CHUNK_KEY, strict=True)], "page_content", "embedding")
    schema = HIT + "".join(f", {c} {'long' if c.endswith('index') else 'string'}" for c in CHUNK_KEY)
    columns = ["qid", "author_key", "scope", "work_titles", "only_works", "top_k", "qvec", "entity_terms", "topic_groups", "variants"]
    chapters = F.when(F.col("chapter").isNotNull(), chapter_variants(F.col("chapter"))).alias("chapters")
    mode = F.when(F.col("scope") == "life_process", "life_process").otherwise("literature").alias("mode")
    asked = questions.select(*columns, mode, chapters)
    by, at = ["author_key", "mode"], to_arrow_schema(vectors.schema)
    rounds, held = max(1, -(-asked.count() // WIDE_QUESTIONS)), _held(vectors, 1)
    pos = F.row_number().over(W.partitionBy("qid", "channel").orderBy("rank", "title_pos"))

    def run(some: pa.Table, streams: pa.Table) -> pa.Table:
        return _block_channels(some, pa.Table.from_batches(unpacked(streams.column("packed")), at if not streams.num_rows else None))

    found = None
    for i in range(rounds):
        some = asked.where(F.pmod(F.xxhash64("qid"), F.lit(rounds)) == i)
        left, right = grid(some, packed(vectors, by), by, (1, held))
        best = best_per(left.cogroup(right).applyInArrow(run, schema), ["qid", "channel", "title_pos"], ["tier", "distance", *CHUNK_ORDER], max(TOP_K_CHAPTER, ALIAS_K)).where("rank <= k")
        best = settle_packed(best.withColumn("pos", pos).select("qid", "channel", "pos", "distance", *[F.col(c).alias(f"h_{c}") for c in CHUNK_KEY]))
        found = best if found is None else found.union(best)
    out = (chunks.drop("embedding") if shown is None else shown).join(dim(found), [F.col(f"h_{c}").eqNullSafe(F.col(c)) for c in CHUNK_KEY])
    return out.drop(*[f"h_{c}" for c in CHUNK_KEY])


def heads(chunks: DataFrame) -> DataFrame:
    """What search must know of the chunks besides vectors and terms: their names, and the start of page_content."""
    return chunks.select(*CHUNK_KEY, F.substring("page_content", 1, KEY_CHARS).alias("page_content"))


def with_texts(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits among `heads` with page_content and source_ref of the chunks. Chunks that share name and start all join; a place then has several rows."""
    key = lambda text: F.struct(*CHUNK_KEY, text).alias("key")
    texts = chunks.select(key(F.substring("page_content", 1, KEY_CHARS).alias("page_content")), "page_content", "source_ref")
    return hits.select(key(F.col("page_content")), *[c for c in hits.columns if c != "page_content"]).join(texts, "key").drop("key")


def neighbours(hits: DataFrame, chunks: DataFrame, first: int = NEIGHBOUR_HITS) -> DataFrame:
    """The chunks before and after each question's first hits of channels 1 and 2, in the same section, with the hit's distance; channel 3."""
    top = best_per(hits.where("channel < 3"), ["qid"], ["channel", "pos"], first)
    near = top.select("qid", "distance", F.col("rank").alias("hit"), *[F.col(c).alias(f"h_{c}") for c in ("author_key", "mode", "work_title", "section_title", "section_index")], F.explode(F.array(F.col("chunk_index") - 1, F.col("chunk_index") + 1)).alias("h_chunk_index"))
    on = [F.col(f"h_{c}").eqNullSafe(F.col(c)) for c in CHUNK_KEY]
    out = chunks.drop("embedding").join(dim(near), on).drop(*[f"h_{c}" for c in CHUNK_KEY])
    return out.withColumn("channel", F.lit(3)).withColumn("pos", F.row_number().over(W.partitionBy("qid").orderBy("hit", "chunk_index"))).drop("hit")


def fuse(hits: DataFrame, limit: Column) -> DataFrame:
    """hits in order of channel and pos, each chunk once, at its first place; `limit` rows a question; with rank."""
    key = W.partitionBy("qid", "work_title", "section_title", "chunk_index", F.substring("page_content", 1, KEY_CHARS)).orderBy("channel", "pos")
    once = hits.withColumn("nth", F.row_number().over(key)).where("nth = 1").drop("nth")
    return once.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("channel", "pos"))).where(F.col("rank") <= limit)


def retrieve(understood: DataFrame, chunks: DataFrame, shown: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(questions after relaxation, ranked hits of them). understood needs qvec; hits have qid, rank, via_alias, distance and the chunk's columns, or those of shown (`heads`)."""
    q = settle_packed(relax(understood.where("scope <> 'meta'"), chunks).withColumn("top_k", depth()))
    found = _channels(q, chunks, shown)
    found = found if shown is None else settle_packed(found)
    found = found.unionByName(neighbours(found, chunks if shown is None else shown))
    # the normal list alone is not cut; with extras the whole is
    extra = found.groupBy("qid").agg(F.max(F.when(F.col("channel") < 4, 1).otherwise(0)).alias("extra"))
    found = found.join(extra, "qid").join(dim(q.select("qid", "top_k")), "qid")
    hits = fuse(found, F.when(F.col("extra") == 1, F.greatest("top_k", F.lit(MERGED))).otherwise(F.lit(2**31 - 1)))
    return q, hits.withColumn("via_alias", F.col("channel") < 4).drop("channel", "pos", "extra", "top_k")


def relevant(distance: Column, named_work: Column, via_alias: Column) -> Column:
    """Near enough: scoped hits may be farther than others."""
    return distance <= F.when(named_work | via_alias, MAX_DISTANCE_SCOPED).otherwise(MAX_DISTANCE)


def gate(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits that pass the gate, place from 1; questions about a chapter keep all theirs, in reading order."""
    q = dim(questions.select("qid", "scope", "chapter"))
    rows = hits.join(q, "qid").where(F.col("chapter").isNotNull() | relevant(F.col("distance"), F.col("scope") == "specific_work", F.col("via_alias")))
    order = W.partitionBy("qid").orderBy(F.when(F.col("chapter").isNotNull(), F.col("chunk_index")), "rank")
    return rows.withColumn("place", F.row_number().over(order)).drop("scope", "chapter")


def grep(chunks: DataFrame, phrase: str, text_col: str = "page_content", order: tuple[str, ...] = CHUNK_ORDER, first: int = 25, before: int = 50, width: int = 160) -> DataFrame:
    """The first chunks that hold the phrase, with what stands around it."""
    at = F.greatest(F.instr(text_col, F.lit(phrase)) - 1 - before, F.lit(0))
    return chunks.where(F.col(text_col).contains(phrase)).orderBy(*order).limit(first).withColumn("context", F.substring(F.col(text_col), at + 1, F.lit(width)))
