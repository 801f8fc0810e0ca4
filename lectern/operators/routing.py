"""What a question is about, by rules: scope, works, chapter, names, phrases.

Questions are rows (qid, question, author_key, mode); works, alias groups and event windows are small tables of the
catalog (lectern.sources.catalog), broadcast where their size has been checked.
"""

from __future__ import annotations

import difflib
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.text import roman_value, router_form, to_roman, words
from lectern.operators.dedup import settle
from lectern.sources.catalog import dim

# Words and patterns of the routing rules.
AVAILABILITY = "available have offer cover discuss access include got".split()
CORPUS_NOUNS = "works work texts text books book corpus material materials sources source titles title stories".split()
META_STARTS = "what which list".split()
TITLE_STOPWORDS = "the a an of and in on to for with by adventures new old complete part".split()
QUESTION_WORDS = "who what when where why how which whom whose tell give describe explain summarize summarise list name show is are was were do does did can could would should will has have had".split()
NOT_A_NAME = "chapter act scene".split()
LAST_CHAPTER = r"\bchapter the last\b|\b(last|final) chapter\b"
CHAPTER = r"\bchapter\s+(\d{1,3}|[ivxlc]{1,8})\b"
TOKEN = r"[A-Za-z][A-Za-z'’\-]*"
QUOTED = r"[\"“]([^\"”]{3,60})[\"”]"
POSSESSIVE = r"['’]s?$"
MIN_HITS, MIN_FRACTION, MIN_RATIO, MIN_WORD, MAX_PHRASES, MIN_PHRASE = 2, 0.66, 0.85, 3, 3, 3
# End of fixed values.


def is_meta(question: Column) -> Column:
    """Asks what the corpus holds: a starter, a word of availability and a noun for works."""
    norm = router_form(question)
    tokens = words(norm)
    return norm.rlike("^(" + "|".join(META_STARTS) + ")") & F.arrays_overlap(tokens, F.array(*map(F.lit, AVAILABILITY))) & F.arrays_overlap(tokens, F.array(*map(F.lit, CORPUS_NOUNS)))


def names_phrase(norm_question: Column, norm_phrase: Column) -> Column:
    """The phrase stands in the question as whole words (both in router form)."""
    return (norm_phrase != "") & F.concat(F.lit(" "), norm_question, F.lit(" ")).contains(F.concat(F.lit(" "), norm_phrase, F.lit(" ")))


def asked_words(questions: DataFrame) -> DataFrame:
    """(qid, author_key, word): the different words of the questions, in router form."""
    q = questions.select("qid", "author_key", F.explode_outer(F.array_distinct(words(router_form(F.col("question"))))).alias("word"))
    return q.where("word IS NOT NULL")


def met_by_anchor(asked: DataFrame, phrases: DataFrame) -> DataFrame:
    """asked (qid, author_key, word) and phrases (author, anchors, ...) that may stand in a question: those that share their rarest anchor.

    A question that holds a phrase holds all its anchors, so it is enough to meet by one of them, the one that the fewest
    questions have. A phrase with an anchor that no question has meets none; one without anchors meets all questions of its author.
    """
    phrases = settle(phrases.withColumn("p", F.monotonically_increasing_id()))
    each = phrases.select("p", "author", F.explode_outer(F.array_distinct("anchors")).alias("anchor")).where("anchor IS NOT NULL")
    often = asked.join(each.select(F.col("author").alias("author_key"), F.col("anchor").alias("word")).distinct(), ["author_key", "word"]).groupBy("author_key", "word").agg(F.count(F.lit(1)).alias("n"))
    counted = each.join(often, (F.col("author") == F.col("author_key")) & (F.col("anchor") == F.col("word")), "left").groupBy("p").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "anchor")).alias("least"))
    least = counted.where("least.n > 0").select(F.col("p").alias("q"), F.col("least.anchor").alias("anchor"))
    held = phrases.join(least, F.col("p") == F.col("q")).drop("q")
    found = asked.join(held, (F.col("author_key") == F.col("author")) & (F.col("word") == F.col("anchor"))).drop("word", "anchor")
    bare = phrases.where(F.size("anchors") == 0)
    if not bare.isEmpty():
        found = found.unionByName(asked.select("qid", "author_key").distinct().join(bare, F.col("author_key") == F.col("author")))
    return found.drop("p", "anchors", "author")


def named_works(questions: DataFrame, works: DataFrame) -> DataFrame:
    """(qid, titles): all works of the author's literature whose title or alias the question names, in catalog order."""
    lit = works.where("mode = 'literature'").select(F.col("author_key").alias("author"), "work_title", "priority", F.explode(F.concat(F.array("work_title"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("phrase"))
    lit = lit.withColumn("phrase", router_form(F.col("phrase"))).where("phrase <> ''").withColumn("anchors", words(F.col("phrase"))).distinct()
    near = met_by_anchor(asked_words(questions), lit)
    hits = near.join(questions.select("qid", router_form(F.col("question")).alias("norm")), "qid").where(names_phrase(F.col("norm"), F.col("phrase")))
    titles = F.transform(F.sort_array(F.collect_set(F.struct("priority", "work_title"))), lambda x: x["work_title"])
    return hits.groupBy("qid").agg(titles.alias("titles"))


def content_words(norm_title: Column) -> Column:
    return F.filter(words(norm_title), lambda w: ~w.isin(TITLE_STOPWORDS) & ~w.rlike("^[0-9]+$"))


@lru_cache(1 << 16)
def alike(asked: str, word: str) -> bool:
    """Equal, or so like that one is taken for a slip of the other (Ratcliff and Obershelp's ratio, after its cheap upper bounds)."""
    short, both = min(len(asked), len(word)), len(asked) + len(word)
    if asked == word or short < MIN_WORD or 2 * short < MIN_RATIO * both:
        return asked == word
    match = difflib.SequenceMatcher(None, asked, word)
    return match.quick_ratio() >= MIN_RATIO and match.ratio() >= MIN_RATIO


@F.pandas_udf(T.BooleanType())
def are_alike(asked: pd.Series, known: pd.Series) -> pd.Series:
    return pd.Series([alike(a, k) for a, k in zip(asked, known, strict=True)], dtype=bool)


def _slips(a: Column, b: Column) -> Column:
    """Letters of two words of these lengths that may be left over, both together, where their ratio is to be MIN_RATIO."""
    return F.floor((a + b) * (1 - MIN_RATIO) + 1e-9).cast("int")


def alike_words(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(word, known): all pairs of a word of asked (word) and one of known (known) that are `alike`.

    Words whose ratio is MIN_RATIO have a common subsequence of all but s letters of both together, s as `_slips` says by
    their lengths. Each letter left out spoils at most one of s + 1 stretches that the known word is cut into, so one
    stretch stands in the other word, moved by s places at most: pairs meet by that stretch, and no other pairs are compared.
    """
    asked = settle(asked.select("word", F.length("word").alias("la")).where(F.col("la") > 0).distinct())
    known = known.select("known", F.length("known").alias("lk")).where(F.col("lk") > 0).distinct()
    same = asked.join(known, F.col("word") == F.col("known")).select("word", "known")
    # lengths whose ratio can be reached at all; a row a pair of lengths and stretch
    reach = (2 - MIN_RATIO) / MIN_RATIO
    lengths = asked.select("la").where(F.col("la") >= MIN_WORD).distinct()
    lengths = lengths.select("la", F.explode(F.sequence(F.greatest(F.lit(MIN_WORD), F.ceil(F.col("la") / reach - 1e-9).cast("int")), F.floor(F.col("la") * reach + 1e-9).cast("int"))).alias("lk"))
    lengths = lengths.join(known.select("lk").distinct(), "lk", "left_semi").withColumn("s", _slips(F.col("la"), F.col("lk")))
    edge = lambda i: F.floor(i * F.col("lk") / (F.col("s") + 1)).cast("int")
    cuts = lengths.select("la", "lk", "s", F.explode(F.sequence(F.lit(0), F.col("s"))).alias("nth"))
    cuts = settle(cuts.select("la", "lk", "s", "nth", edge(F.col("nth")).alias("at"), (edge(F.col("nth") + 1) - edge(F.col("nth"))).alias("size")))
    held = known.join(cuts, "lk").select("known", "la", "lk", "nth", F.substring("known", F.col("at") + 1, F.col("size")).alias("stretch"))
    moves = F.sequence(F.greatest(F.lit(0), F.col("at") - F.col("s")), F.least(F.col("la") - F.col("size"), F.col("at") + F.col("s")))
    # a stretch that cannot stand at any place makes an empty row
    moves = F.when(F.col("la") - F.col("size") >= F.greatest(F.lit(0), F.col("at") - F.col("s")), moves)
    mine = asked.join(cuts, "la").select("word", "la", "lk", "nth", "size", F.explode_outer(moves).alias("m")).where("m IS NOT NULL")
    mine = mine.select("word", "la", "lk", "nth", F.substring("word", F.col("m") + 1, F.col("size")).alias("stretch")).distinct()
    near = mine.join(held, ["la", "lk", "nth", "stretch"]).where("word <> known").select("word", "known").distinct()
    return same.union(near.where(are_alike("word", "known")))


def likely_work(questions: DataFrame, works: DataFrame) -> DataFrame:
    """(qid, title, fraction): for questions that name no work, the one work most of whose content words they have, slips counted.

    A work that needs h of its n words is found by one of its n - h + 1 rarest, so what is joined is not questions and works
    that share a common word.
    """
    lit = works.where("mode = 'literature'").select(F.col("author_key").alias("author"), "work_title", "priority", content_words(router_form(F.col("work_title"))).alias("tw")).where(F.size("tw") >= MIN_HITS).distinct()
    titled_ = lit.select("author", "work_title", "priority", F.size("tw").alias("n"), F.posexplode("tw").alias("pos", "known"))
    asked = asked_words(questions)
    pairs = alike_words(asked, titled_)
    met = settle(asked.join(pairs, "word").select("qid", "author_key", "known").distinct())
    often = met.groupBy(F.col("author_key").alias("a"), F.col("known").alias("k")).agg(F.count(F.lit(1)).alias("often"))
    counted = titled_.join(often, (F.col("author") == F.col("a")) & (F.col("known") == F.col("k")), "left").drop("a", "k")
    needed = F.greatest(F.lit(MIN_HITS), F.ceil(F.col("n") * MIN_FRACTION - 1e-9).cast("int"))
    work = ["author", "work_title", "priority"]
    rank = F.row_number().over(W.partitionBy(*work).orderBy(F.coalesce("often", F.lit(0)), "pos"))
    rare = counted.withColumn("rank", rank).where((F.col("rank") <= F.col("n") - needed + 1) & F.col("often").isNotNull()).select(*work, "known")
    few = met.join(rare, (F.col("author_key") == F.col("author")) & (met["known"] == rare["known"])).select("qid", *work).distinct()
    hits = few.join(titled_, work).join(met.select("qid", "known"), ["qid", "known"]).groupBy("qid", *work, "n").agg(F.count_distinct("pos").alias("hits"))
    rows = hits.withColumn("fraction", F.col("hits") / F.col("n")).where((F.col("hits") >= MIN_HITS) & (F.col("fraction") >= MIN_FRACTION))
    best = rows.groupBy("qid").agg(F.min(F.struct((-F.col("fraction")).alias("f"), "priority", "work_title")).alias("b"))
    return best.select("qid", F.col("b.work_title").alias("title"), (-F.col("b.f")).alias("fraction"))


def best_title(titles: Column) -> Column:
    """The first of the works that a question names, or null."""
    return F.get(titles, 0)


def parse_chapter(question: Column) -> Column:
    """'THE LAST', a numeral from I to CXCIX, or null; letters must be a well-formed numeral."""
    q = F.lower(question)
    token = F.upper(F.regexp_extract(q, CHAPTER, 1))
    n = F.when(token.rlike("^[0-9]+$"), token.try_cast("int")).otherwise(roman_value(token))
    label = F.when(n.between(1, 199), to_roman(n))
    return F.when(q.rlike(LAST_CHAPTER), "THE LAST").when(token.rlike("^[0-9]+$") | (label == token), label)


def chapter_variants(label: Column) -> Column:
    """Spellings that a chapter's heading may have."""
    bases = F.when(label == "THE LAST", F.array(F.lit("THE LAST"), F.lit("the Last"), F.lit("the last"))).otherwise(F.array(label, roman_value(label).cast("string")))

    def headed(prefix: str) -> Column:
        return F.transform(bases, lambda b: F.array(F.concat(F.lit(prefix), b), F.concat(F.lit(prefix), b, F.lit("."))))

    return F.flatten(F.concat(headed("CHAPTER "), headed("Chapter ")))


def route(questions: DataFrame, works: DataFrame) -> DataFrame:
    """questions with scope (meta, life_process, specific_work, oeuvre), work_title, work_titles (of specific works), chapter."""
    plain = questions.where(~is_meta(F.col("question")) & (F.col("mode") != "life_process"))
    # read many times below; a router form is its own router form
    plain = settle(plain.select("qid", "author_key", router_form(F.col("question")).alias("question")))
    named = settle(named_works(plain, works))
    likely = likely_work(settle(plain.join(named, "qid", "left_anti")), works)
    q = questions.join(named, "qid", "left").join(likely.select("qid", "title"), "qid", "left")
    titles = F.coalesce("titles", F.when(F.col("title").isNotNull(), F.array("title")))
    scope = F.when(is_meta(F.col("question")), "meta").when(F.col("mode") == "life_process", "life_process").when(titles.isNotNull(), "specific_work").otherwise("oeuvre")
    q = q.withColumn("scope", scope).withColumn("work_titles", titles).drop("titles", "title")
    return q.withColumn("work_title", F.array_join("work_titles", " + ")).withColumn("chapter", F.when(F.size("work_titles") == 1, parse_chapter(F.col("question"))))


def has_trigger(lowered: Column, triggers: Column) -> Column:
    return F.exists(triggers, lambda t: F.regexp_like(lowered, F.concat(F.lit(r"\b\Q"), F.lower(t), F.lit(r"\E\b"))))


def triggered_groups(routed: DataFrame, alias_groups: DataFrame) -> DataFrame:
    """(qid, pos, role, name, terms) of the author's alias groups for the question's mode that have a trigger in it."""
    # inside of a trigger and at its ends runs of letters and digits end where they do in the question
    g = alias_groups.select(F.col("author_key").alias("author"), F.col("mode").alias("g_mode"), "pos", "role", "name", "terms", F.explode("triggers").alias("trigger"))
    g = g.withColumn("anchors", F.regexp_extract_all(F.lower("trigger"), F.lit("([a-z0-9]+)"), F.lit(1)))
    lowered = routed.select("qid", "author_key", F.lower("question").alias("lowered"))
    asked = lowered.select("qid", "author_key", F.explode_outer(F.array_distinct(F.regexp_extract_all("lowered", F.lit("([a-z0-9]+)"), F.lit(1)))).alias("word"))
    # a question without letters may still hold a trigger without them
    near = met_by_anchor(asked.withColumn("word", F.coalesce("word", F.lit(""))), g)
    mode = F.when(F.col("scope") == "life_process", "life_process").otherwise("literature")
    hits = near.drop("author_key").join(routed.select("qid", mode.alias("q_mode"), F.lower("question").alias("lowered")), "qid")
    hits = hits.where((F.col("g_mode").isNull() | (F.col("g_mode") == F.col("q_mode"))) & has_trigger(F.col("lowered"), F.array("trigger")))
    return hits.select("qid", "pos", "role", "name", "terms").distinct()


def alias_terms(fired: DataFrame) -> DataFrame:
    """(qid, entity_terms, topic_groups): terms of fired entity groups, once each; a term list for each fired topic group. Only where an entity group fired."""
    ordered = lambda when: F.transform(F.sort_array(F.collect_list(F.when(when, F.struct("pos", "terms")))), lambda x: x["terms"])
    topic = F.coalesce(F.col("role") == "topic", F.lit(False))
    out = fired.groupBy("qid").agg(F.array_distinct(F.flatten(ordered(~topic))).alias("entity_terms"), F.filter(ordered(topic), lambda t: F.size(t) > 0).alias("topic_groups"))
    return out.where(F.size("entity_terms") > 0)


def event_window(routed: DataFrame, fired: DataFrame, windows: DataFrame) -> DataFrame:
    """(qid, only_works) of the first window all of whose groups fired; questions of life_process only."""
    names = routed.where("scope = 'life_process'").select("qid", "author_key").join(fired.groupBy("qid").agg(F.collect_set("name").alias("names")), "qid")
    w = dim(windows.where((F.size("when") > 0) & (F.size("only_works") > 0)).select(F.col("author_key").alias("w_author"), "pos", "when", "only_works"))
    hits = names.join(w, F.col("author_key") == F.col("w_author")).where(F.size(F.array_except("when", "names")) == 0)
    return hits.groupBy("qid").agg(F.min_by("only_works", "pos").alias("only_works"))


def ignore_words(works: DataFrame) -> DataFrame:
    """(author_key, ignore): words of the author's name and of titles and aliases, which name nothing in particular."""
    of_name = F.regexp_extract_all(F.lower("author_display"), F.lit("([a-z']+)"), F.lit(1))
    phrases = F.concat(F.array("work_title"), F.coalesce("aliases", F.array().cast("array<string>")))
    found = F.flatten(F.transform(phrases, lambda p: F.regexp_extract_all(F.lower(p), F.lit("([a-z']+)"), F.lit(1))))
    of_works = F.transform(found, lambda w: F.regexp_replace(w, POSSESSIVE, ""))
    return works.select("author_key", F.explode_outer(F.concat(of_name, of_works)).alias("w")).where("w IS NOT NULL").groupBy("author_key").agg(F.sort_array(F.collect_set("w")).alias("ignore"))


def _plain(word: str) -> str:
    return re.sub(POSSESSIVE, "", word.lower(), flags=re.I)


def key_phrases(question: str, ignore: set[str]) -> list[str]:
    """Literal names to look for: runs of capitalised words one blank apart, and short quotations; those of most words first."""
    runs: list[list[str]] = []
    end = None
    for m in re.finditer(TOKEN, question):
        t = m.group()
        if len(t) < 2 or not t[0].isupper() or t.isupper():
            end = None
            continue
        if end is not None and question[end : m.start()] == " ":
            runs[-1].append(t)
        else:
            runs.append([t])
        end = m.end()
    found = []
    for run in runs:
        lo, hi = 0, len(run)
        # a question's first word has its capital from grammar
        if _plain(run[0]) in QUESTION_WORDS and question.lstrip().startswith(run[0]):
            lo = 1
        while lo < hi and _plain(run[lo]) in ignore:
            lo += 1
        while lo < hi and _plain(run[hi - 1]) in ignore:
            hi -= 1
        if lo < hi and _plain(run[lo]) not in NOT_A_NAME:
            found.append(re.sub(POSSESSIVE, "", " ".join(run[lo:hi]), flags=re.I))
    quotes = (m.group(1).strip() for m in re.finditer(QUOTED, question))
    found += [q for q in quotes if not all(_plain(w) in ignore for w in q.split())]
    once = {p.lower(): p for p in reversed(found) if len(p) >= MIN_PHRASE}
    kept = sorted(once.values(), key=found.index)
    return sorted(kept, key=lambda p: -len(p.split()))[:MAX_PHRASES]


@F.pandas_udf(T.ArrayType(T.StringType()))
def key_phrases_of(question: pd.Series, ignore: pd.Series) -> pd.Series:
    return pd.Series([key_phrases(q or "", set() if w is None else set(w)) for q, w in zip(question, ignore, strict=True)])


@F.pandas_udf(T.ArrayType(T.StringType()))
def titled(phrases: pd.Series) -> pd.Series:
    """Each phrase with initials after anything but a letter, as initcap() does not put them."""
    return phrases.map(lambda ps: [p.title() for p in ps])


def phrase_variants(phrases: Column | str) -> Column:
    """Each phrase as it is, in small letters, with initials, in capitals; each with straight and curly apostrophes."""
    phrases = F.coalesce(F.col(phrases) if isinstance(phrases, str) else phrases, F.array().cast("array<string>"))
    spelled = lambda f: F.array(f, F.replace(f, F.lit("'"), F.lit("’")))
    forms = F.zip_with(phrases, titled(phrases), lambda p, t: F.flatten(F.transform(F.array(p, F.lower(p), t, F.upper(p)), spelled)))
    return F.array_distinct(F.flatten(forms))


def understand(questions: DataFrame, works: DataFrame, alias_groups: DataFrame, windows: DataFrame) -> DataFrame:
    """`route` with entity_terms, topic_groups, only_works, phrases and variants."""
    routed = route(questions, works)
    fired = triggered_groups(routed, alias_groups)
    q = routed.join(alias_terms(fired), "qid", "left").join(event_window(routed, fired, windows), "qid", "left").join(dim(ignore_words(works)), "author_key", "left")
    q = q.withColumn("phrases", key_phrases_of("question", F.coalesce("ignore", F.array().cast("array<string>")))).drop("ignore")
    return q.withColumn("variants", phrase_variants("phrases"))


def best_per(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group; each task passes on k rows a group."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
