"""How filters interact: what each removes, finds removed already, or alone would catch, in every order of applying them.

A document's failures are a mask of one bit a filter. Per part and label the corpus is aggregated once, to the 2^n
signed parity sums of the masks (the Walsh-Hadamard transform of their counts: sum s adds 1 for each document that fails
an even number of the filters in s, else -1). The transform is its own inverse but for a division by 2^n, which is exact
in whole numbers; that gives the count of every mask, and all orders are evaluated on these 2^n cells. A filter's
Shapley value over all n! orders has a closed form: in a document with k failures each of them comes first in n!/k orders.

Masks and sums are column expressions and the sums combine before they are shuffled: a hot part sends one row a task.
Repeats are found by content hash (SHA-256 and length): the smallest id of each text, again combined before the shuffle;
it meets the rows by (id, hash), so no group of copies is a hot key. One scan reads the texts.

Defined results: a null text is empty, a null part is the empty string; a null id is smaller than no other and repeats
none; rows that repeat id and text are one another's equals, none repeats the other; several label rows of an id count as
one that has what any of them has; a document without a label has neither. A text is read as a whole, so the longest one
bounds memory. An empty table has no part and gives no row. Columns other than id, text and part are not read.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import WORD, settle, whole_text

#: Names of the filters, in the order of their bits.
NAMES = "ABCDE"
#: The kinds of documents that are counted: all, those labelled good, those labelled toxic.
KINDS = ("all", "good", "toxic")


def text_failures(text: Column) -> list[Column]:
    """Conditions of A to D: few words, few different words, many capitals, symbols."""
    words = F.regexp_extract_all(text, F.lit(WORD), 0)
    n = F.size(words)
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return [n < 200, 100 * F.size(F.array_distinct(words)) < 50 * n, 100 * capitals > 3 * F.length(text), text.rlike("[#$%&*|]")]


def masks(docs: DataFrame, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, part, and mask, bit i set where the document fails filter i."""
    text = whole_text(text_col)
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    bits = F.lit(0)
    for i, fails in enumerate(text_failures(F.col("text"))):
        bits = bits + F.when(fails, 1 << i).otherwise(0)
    # short rows, read twice
    own = settle(own.select("id", "part", bits.alias("own"), F.unhex(F.sha2("text", 256)).alias("sha"), F.length("text").alias("chars")))
    firsts = own.where("id IS NOT NULL").groupBy("sha", "chars").agg(F.min("id").alias("id")).withColumn("is_first", F.lit(1))
    repeats = F.when(F.col("id").isNotNull() & F.col("is_first").isNull(), 16).otherwise(0)
    return own.join(firsts, ["id", "sha", "chars"], "left").select("id", "part", (F.col("own") + repeats).alias("mask"))


def labelled(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """rows with good and toxic, by their id."""
    flag = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    own = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    return rows.join(own, "id", "left").fillna(0, ["good", "toxic"])


def _sign(x: Column) -> Column:
    """1 where an even number of bits is set, else -1."""
    return 1 - 2 * F.bit_count(x).bitwiseAND(F.lit(1))


def _over(n: int, term: Callable[[Column], Column]) -> Column:
    """The sum of term(m) over the masks 0 .. 2^n - 1."""
    return F.aggregate(F.sequence(F.lit(0), F.lit((1 << n) - 1)), F.lit(0).cast("long"), lambda total, m: total + term(m))


def parity_sums(rows: DataFrame, keys: Sequence[str], n: int = len(NAMES)) -> DataFrame:
    """The 2^n signed parity sums of mask for each combination of keys, as the array w."""
    found = rows.groupBy(*keys).agg(*[F.sum(_sign(F.col("mask").bitwiseAND(F.lit(s)))).alias(f"w{s}") for s in range(1 << n)])
    return found.select(*keys, F.array(*[f"w{s}" for s in range(1 << n)]).alias("w"))


def cells(sums: DataFrame, n: int = len(NAMES)) -> DataFrame:
    """Per part, the exact count of each mask among all, good and toxic documents, by inverting the sums of `parity_sums`."""
    kinds = {"all": F.lit(True), "good": F.col("good") == 1, "toxic": F.col("toxic") == 1}
    # the transform is linear: what is counted together is added first and inverted once
    added = sums.groupBy("part").agg(*[F.sum(F.when(kinds[k], F.get("w", F.lit(s))).otherwise(0)).alias(f"{k}{s}") for k in KINDS for s in range(1 << n)])
    added = added.select("part", *[F.array(*[f"{k}{s}" for s in range(1 << n)]).alias(k) for k in KINDS])
    inverse = lambda w: F.transform(
        F.sequence(F.lit(0), F.lit((1 << n) - 1)), lambda m: F.shiftright(_over(n, lambda s: _sign(s.bitwiseAND(m)) * F.get(w, s)), n)
    )
    return added.select("part", *[inverse(F.col(k)).alias(k) for k in KINDS])


def orders(counted: DataFrame, names: str = NAMES) -> DataFrame:
    """One row per part of `cells`, order of the filters and step, with what that step does."""
    n, every = len(names), factorial(len(names))
    # n * n! places, whatever the corpus
    places = [
        {"filter_order": "".join(names[i] for i in order), "step": step + 1, "bit": 1 << i, "before": sum(1 << j for j in order[:step])}
        for order in permutations(range(n)) for step, i in enumerate(order)
    ]
    place = F.from_json(F.lit(json.dumps(places)), "array<struct<filter_order string, step int, bit int, before int>>")
    at = counted.select("part", *KINDS, F.explode_outer(place).alias("p")).select("part", *KINDS, "p.*")
    fails, gone = (lambda m: m.bitwiseAND(F.col("bit")) != 0), (lambda m: m.bitwiseAND(F.col("before")) != 0)
    count = lambda kind, wanted: _over(n, lambda m: F.when(wanted(m), F.get(kind, m)).otherwise(0))
    removed = lambda m: fails(m) & ~gone(m)
    share = F.array(*[F.lit(0), *[F.lit(every // k) for k in range(1, n + 1)]])
    return at.select(
        "part", "filter_order", "step",
        count("all", lambda m: ~fails(m) & ~gone(m)).alias("kept"), count("all", removed).alias("removed"),
        count("all", lambda m: fails(m) & gone(m)).alias("redundant"), F.get("all", F.col("bit")).alias("unique_fails"),
        count("good", removed).alias("good_lost"), count("toxic", removed).alias("toxic_lost"),
        _over(n, lambda m: F.when(fails(m), F.get("all", m) * F.get(share, F.bit_count(m))).otherwise(0)).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The whole audit of the five filters over docs, with what labels (id, quality, toxic) say of them."""
    rows = labelled(masks(docs, part_col, id_col, text_col), labels, id_col)
    return orders(cells(settle(parity_sums(rows, ["part", "good", "toxic"]))))
