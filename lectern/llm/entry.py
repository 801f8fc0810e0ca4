"""The queries of this subpackage over the test tables, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, exact_dedup, filter_audit, language_id, line_dedup, minhash, mixing, packing, phrases, quality, substring_dedup, suffix_dedup, warc_zip
from lectern.llm.common import remove_folder, settle, table


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicate_classes(table(spark, sf_dir, "documents"), words=5, threshold=0.8)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(~held_out(F.col("doc_id"))))
    out = language_id.identify(docs, model, {"doc_id": F.col("doc_id"), "held_out": held_out(F.col("doc_id"))})
    return out.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_table(table(spark, sf_dir, "documents"), weight_of_size=mixing.bits)


def op4_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc_zip.new_folder(spark)
    archives = warc_zip.write_archives(table(spark, sf_dir, "pages"), folder, min_bytes=0)
    # a short row a record: kept, so that the archives can go
    out = settle(warc_zip.read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    remove_folder(spark, folder)
    return out


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeated_bytes(table(spark, sf_dir, "documents"), window=100)
    return out.select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), min_chars=20, min_docs=3)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_digests() -> list[Column]:
    """ids_sha256, of the ids joined by blanks, and decoded_sha256."""
    return [F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")]


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_file())
    return out.select("doc_id", "n_tokens", *token_digests())


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeated_words(table(spark, sf_dir, "documents"), window=20)
    return out.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances allowed are learned from documents labelled good, but for the third of ids that tests hold out."""
    docs = table(spark, sf_dir, "documents")
    measured = settle(quality.measure(docs, quality.learn(docs)))
    good = table(spark, sf_dir, "labels").where((F.col("quality") == 1) & ~held_out(F.col("doc_id"))).select("doc_id").distinct()
    return quality.verdicts(measured, quality.learn_limits(measured.join(good, "doc_id", "left_semi")))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="largest")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file(), size=2048, end_id=0)


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"), at_least=10, inside=50, best=2000)


SQL = {
    "op3_mix_sources": r"""
WITH counted AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         (CAST('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents),
sized AS (SELECT *, CAST(round(ln(length(bin(size))) / ln(1.1::DOUBLE)) AS INTEGER) AS level FROM counted),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, 3 * source_size AS cap,
         CAST(sum(source_size) OVER () AS BIGINT) AS total FROM sums),
filled AS (
  SELECT *, CAST(total - coalesce(sum(cap) OVER w, 0) AS DOUBLE) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS DOUBLE) AS c
  FROM weighed WINDOW w AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT arg_min(c, CAST(cap AS DOUBLE) / weight) AS c FROM filled WHERE c * weight <= cap),
targets AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), level.c * weight) AS target FROM filled, level),
parts AS (
  SELECT s.source, s.level, t.source_size, t.target, s.part_size, 3 * s.part_size AS cap, pow(1.1::DOUBLE, s.level) * s.part_size AS w
  FROM (SELECT source, level, CAST(sum(size) AS BIGINT) AS part_size FROM sized GROUP BY source, level) s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
filled_parts AS (
  SELECT *, (target - coalesce(sum(cap) OVER o, 0)) / nullif(sum(w) OVER (PARTITION BY source) - coalesce(sum(w) OVER o, 0), 0) AS c, count(*) OVER (PARTITION BY source) AS levels
  FROM parts WINDOW o AS (PARTITION BY source ORDER BY cap / nullif(w, 0) NULLS FIRST, level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
shares AS (
  SELECT *, least(CAST(cap AS DOUBLE), w * coalesce(arg_min(c, cap / nullif(w, 0)) FILTER (w > 0 AND c * w <= cap) OVER (PARTITION BY source), 'inf'::DOUBLE)) AS share FROM filled_parts),
wanted AS (SELECT *, coalesce(CASE WHEN levels = 1 THEN target ELSE share END / nullif(part_size, 0), 0) AS e FROM shares),
rates AS (SELECT *, floor(e) AS whole, target - sum(floor(e) * part_size) OVER (PARTITION BY source) AS rest FROM wanted),
ranked AS (
  SELECT d.doc_id, d.size, r.source_size, r.target, r.whole, r.e - r.whole AS p, r.rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source, d.size > 0 AND r.e > r.whole ORDER BY (u / (1 - u)) / ((r.e - r.whole) / (1 - (r.e - r.whole))), d.doc_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source AND d.level = r.level),
taken AS (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE CAST(whole AS BIGINT) + CASE WHEN p > 0 AND before + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END END AS copies FROM ranked)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM taken""",
    "op4_warc_zip": """
WITH bodies AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
firsts AS (SELECT body, min(page_id) AS first FROM bodies GROUP BY body)
SELECT b.page_id, CAST(strlen(b.body) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + CAST((CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN b.page_id = f.first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN b.page_id <> f.first THEN f.first END AS refers_to
FROM bodies b JOIN firsts f ON b.body = f.body""",
    "op5_suffix_dedup": """
WITH docs AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
sized AS (SELECT doc_id, b, octet_length(b) AS n FROM docs),
windows AS (SELECT doc_id, unnest(range(1, n - 98)) AS i, b FROM sized WHERE n >= 100),
repeats AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, row_number() OVER (PARTITION BY array_slice(b, i, i + 99) ORDER BY doc_id, i) AS nth FROM windows)
  WHERE nth > 1),
-- where covered runs start and end
marked AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM repeats),
spans AS (
  SELECT doc_id, min(i) AS lo, max(i) + 100 AS hi FROM (
    SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked)
  GROUP BY doc_id, run),
cuts AS (SELECT doc_id, lo, hi, lag(hi, 1, 1) OVER (PARTITION BY doc_id ORDER BY lo) AS after, lead(lo) OVER (PARTITION BY doc_id ORDER BY lo) IS NULL AS last FROM spans),
kept AS (
  SELECT c.doc_id, CAST(sum(hi - lo) AS BIGINT) AS n_removed, count(*) AS n_spans,
         string_agg(hex(array_slice(b, after, lo - 1)) || CASE WHEN last THEN hex(array_slice(b, hi, n)) ELSE '' END, '' ORDER BY lo) AS left_hex
  FROM cuts c JOIN sized USING (doc_id) GROUP BY c.doc_id)
SELECT s.doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       CASE WHEN k.doc_id IS NULL THEN sha256(b) ELSE sha256(unhex(left_hex)) END AS kept_sha256
FROM sized s LEFT JOIN kept k ON s.doc_id = k.doc_id""",
    "op8_substring_dedup": r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM docs WHERE len(w) >= 20),
repeats AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) AS nth FROM windows)
  WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS pos FROM repeats),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM docs),
kept AS (
  SELECT w.doc_id, string_agg(word, ' ' ORDER BY pos) AS body, count(*) AS n FROM words w ANTI JOIN gone g ON w.doc_id = g.doc_id AND w.pos = g.pos GROUP BY w.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.body, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id""",
    "op6_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
common AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.doc_id, k.pos, k.line, c.last IS NOT NULL AND c.last <> k.doc_id AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op10_exact_dedup": """
WITH groups AS (SELECT coalesce(text, '') AS body, max(doc_id) AS keep_id, count(*) AS group_size FROM documents GROUP BY 1)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(g.body) AS text_sha256
FROM documents d JOIN groups g ON coalesce(d.text, '') = g.body""",
    "op11_filter_audit": r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
firsts AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
marks AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
failed AS (
  SELECT part, [f.letter FOR f IN [
           {'letter': 'A', 'fails': len(w) < 200}, {'letter': 'B', 'fails': 100 * len(list_distinct(w)) < 50 * len(w)},
           {'letter': 'C', 'fails': 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t)},
           {'letter': 'D', 'fails': regexp_matches(t, '[#$%&*|]')}, {'letter': 'E', 'fails': coalesce(doc_id > first, false)}] IF f.fails] AS fails,
         coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM (SELECT d.*, first, regexp_extract_all(d.t, '[^\x20\x09-\x0D]+') AS w FROM d JOIN firsts ON d.t = firsts.t) x LEFT JOIN marks USING (doc_id)),
sets AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, fails),
orders(o) AS (SELECT '' UNION ALL SELECT o || l FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l) WHERE NOT contains(o, l)),
steps AS (SELECT o AS filter_order, step, substr(o, step, 1) AS f, string_split(left(o, step - 1), '') AS before FROM orders, (SELECT unnest(range(1, 6)) AS step) WHERE length(o) = 5),
ways AS (SELECT f, fails, count(*) AS firsts FROM (
  SELECT s.filter_order, s.f, x.fails FROM (SELECT DISTINCT fails FROM sets) x, steps s
  WHERE list_contains(x.fails, s.f) AND NOT list_has_any(x.fails, s.before)) GROUP BY f, fails)
SELECT part, filter_order, CAST(step AS INT) AS step,
       CAST(coalesce(sum(n) FILTER (NOT list_contains(s.fails, f) AND NOT list_has_any(s.fails, before)), 0) AS BIGINT) AS kept,
       CAST(coalesce(sum(n) FILTER (list_contains(s.fails, f) AND NOT list_has_any(s.fails, before)), 0) AS BIGINT) AS removed,
       CAST(coalesce(sum(n) FILTER (list_contains(s.fails, f) AND list_has_any(s.fails, before)), 0) AS BIGINT) AS redundant,
       CAST(coalesce(sum(n) FILTER (s.fails = [f]), 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(sum(good) FILTER (list_contains(s.fails, f) AND NOT list_has_any(s.fails, before)), 0) AS BIGINT) AS good_lost,
       CAST(coalesce(sum(toxic) FILTER (list_contains(s.fails, f) AND NOT list_has_any(s.fails, before)), 0) AS BIGINT) AS toxic_lost,
       CAST(coalesce(sum(n * w.firsts), 0) AS BIGINT) AS shapley
FROM sets s CROSS JOIN steps LEFT JOIN ways w USING (f, fails)
GROUP BY part, filter_order, step""",
    "op13_phrases": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (SELECT lang, size, unnest([w[i:i + size - 1] FOR i IN range(1, len(w) - size + 2)]) AS g FROM split, (SELECT unnest([1, 2, 3]) AS size)),
counts AS (SELECT lang, g, CAST(count(*) AS HUGEINT) AS f FROM grams GROUP BY lang, g),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM split GROUP BY lang),
cuts AS (
  SELECT c.lang, c.g, c.f AS a, k, l.f AS l, r.f AS r, (1000000 * c.f * c.f) // (l.f * r.f) AS score
  FROM (SELECT *, unnest(range(1, len(g))) AS k FROM counts WHERE len(g) > 1 AND f >= 10) c
  JOIN counts l ON l.lang = c.lang AND l.g = c.g[1:k] JOIN counts r ON r.lang = c.lang AND r.g = c.g[k + 1:]),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
longer AS (
  SELECT lang, g, max(f) AS f FROM (
    SELECT lang, g[1:2] AS g, f FROM counts WHERE len(g) = 3 AND f >= 10 UNION ALL SELECT lang, g[2:3], f FROM counts WHERE len(g) = 3 AND f >= 10) GROUP BY lang, g),
kept AS (
  SELECT s.*, array_to_string(s.g, ' ') AS phrase FROM scored s LEFT JOIN longer x ON x.lang = s.lang AND x.g = s.g WHERE x.f IS NULL OR 100 * x.f < 50 * s.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept QUALIFY rank <= 2000)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN totals USING (lang)""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash_dedup": op1_minhash_dedup,
        "op2_language_id": op2_language_id,
        "op3_mix_sources": op3_mix_sources,
        "op4_warc_zip": op4_warc_zip,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_line_dedup": op6_line_dedup,
        "op7_bpe": op7_bpe,
        "op8_substring_dedup": op8_substring_dedup,
        "op9_quality_rules": op9_quality_rules,
        "op10_exact_dedup": op10_exact_dedup,
        "op11_filter_audit": op11_filter_audit,
        "op12_packing": op12_packing,
        "op13_phrases": op13_phrases,
    }


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
