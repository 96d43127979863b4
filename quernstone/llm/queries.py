"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bayes, decontam, html, language, packing, periodic, pii, quality_model, simhash, substring, suffix, tokens


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), words=3, bits=3)


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(_table(spark, sf_dir, "pages"))


def op3_suffix_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix.quality_rules(_table(spark, sf_dir, "documents"))
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_words")
    return done.select(*columns, (F.col("longest_repeat") > 100).alias("long_repeat"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring.substring_dedup(_table(spark, sf_dir, "documents"), size=13)
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    taught = labels.filter(quality_model.fold("doc_id", 5) != 0).select("doc_id", F.col("quality").alias("label"))
    scored = quality_model.score(docs, quality_model.learn(docs, taught))
    return scored.select("doc_id", (quality_model.fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"), pii.session_key(spark), counts=True)
    return done.select("doc_id", "text", *[F.coalesce(F.try_element_at("pii_counts", F.lit(k)), F.lit(0)).cast("bigint").alias(f"n_{k}") for k in pii.KINDS])


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.read_tokens(tokens.write_tokens(_table(spark, sf_dir, "documents")))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language.learn(docs.filter(quality_model.fold("doc_id", 3) != 1))
    return language.predict(docs, model).select("doc_id", (quality_model.fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = decontam.benchmark_hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), size=10)
    return done.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(tokens.token_counts(_table(spark, sf_dir, "documents")))


def planted_runs(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) in which a tenth of the texts repeats a stretch from one word on: where h, the CRC-32 of the doc_id as text, is a
    multiple of 10, and g is h / 10 rounded down, each word from a = g % n on is word a + (i - a) % p, with p = 1 + (n - a) / (3 + g % 8)
    rounded down."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    split = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), (h % 10 == 0).alias("chosen"), F.when(h % 10 == 0, F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")).alias("ws"))
    placed = split.withColumn("n", F.size("ws")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    placed = placed.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    rest = F.col("n") - F.col("a")
    again = F.flatten(F.array_repeat(F.slice("ws", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int")))
    changed = F.array_join(F.concat(F.slice("ws", F.lit(1), F.col("a")), F.slice(again, F.lit(1), rest)), " ")
    return placed.select("doc_id", F.when(F.col("chosen") & (F.col("n") > 0), changed).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = periodic.periodic_runs(planted_runs(_table(spark, sf_dir, "documents")))
    return done.withColumn("collapsed_sha256", F.sha2("collapsed", 256)).drop("collapsed")


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(_table(spark, sf_dir, "documents"))


def op13_bayes_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bayes.near_duplicates(_table(spark, sf_dir, "documents"), words=4)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_simhash, op2_main_text, op3_suffix_quality, op4_substring_dedup, op5_quality_classifier, op6_pseudonyms, op7_token_files, op8_language, op9_decontamination, op10_packing, op11_periodic_runs, op12_tokenizer_alignment, op13_bayes_dedup)
    return {f.__name__: f for f in ops}


def _covered(name: str, n: int) -> str:
    """Words of each text in windows of n words that it holds twice or more."""
    return f"""{name}w AS (SELECT id, t.i AS i, array_to_string(ws[t.i : t.i + {n - 1}], ' ') AS k FROM w, unnest(range(1, len(ws) - {n - 2})) AS t(i)),
{name}k AS (SELECT id, k FROM {name}w GROUP BY id, k HAVING count(*) > 1),
{name} AS (SELECT id, count(DISTINCT i + d.j) AS n FROM {name}w JOIN {name}k USING (id, k), range({n}) AS d(j) GROUP BY id)"""


_OP3_SQL = rf"""
WITH w AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
{_covered("three", 3)},
{_covered("ten", 10)},
{_covered("much", 101)},
b AS (SELECT w.id, doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(three.n, 0)::BIGINT AS n_repeat_words, coalesce(ten.n, 0)::BIGINT AS covered_words, much.n IS NOT NULL AS long_repeat
      FROM w JOIN l USING (id) LEFT JOIN three USING (id) LEFT JOIN ten USING (id) LEFT JOIN much USING (id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT * EXCLUDE (id), NOT base_failed AND covered_words <= 0.3::DOUBLE * n_words AND NOT long_repeat AS kept FROM f
"""

_OP4_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, t.i AS i, array_to_string(ws[t.i : t.i + 12], ' ') AS k FROM w, unnest(range(1, len(ws) - 11)) AS t(i)),
least_doc AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
hit AS (SELECT win.doc_id, win.i FROM win JOIN least_doc USING (k) WHERE win.doc_id > m),
gone AS (SELECT DISTINCT doc_id, i + d.j AS p FROM hit, range(13) AS d(j)),
each AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS s FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_OP9_SQL = f"""
WITH it AS (SELECT item_id::VARCHAR AS item_id, {_WORDS} AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(ws), 10) AS m, array_to_string(ws[t.i : t.i + least(len(ws), 10) - 1], ' ') AS k
        FROM it, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS t(i) WHERE len(ws) > 0),
w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
dw AS (SELECT doc_id, t.i AS i, s.m AS m, array_to_string(ws[t.i : t.i + s.m - 1], ' ') AS k
       FROM w, (SELECT DISTINCT m FROM win) AS s, unnest(range(1, len(ws) - s.m + 2)) AS t(i)),
hit AS (SELECT dw.doc_id, dw.i, dw.m, win.item_id FROM dw JOIN win ON dw.k = win.k AND dw.m = win.m),
pos AS (SELECT doc_id, count(DISTINCT i + d.j) AS n_hit FROM hit, range(10) AS d(j) WHERE d.j < m GROUP BY doc_id),
own AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN pos USING (doc_id) LEFT JOIN own USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_suffix_quality": _OP3_SQL, "op4_substring_dedup": _OP4_SQL, "op9_decontamination": _OP9_SQL}
