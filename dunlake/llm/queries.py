"""One named query per operator, with production parameters over whole tables, and its SQL where SQL can express it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dunlake.llm.chat import format_conversations, read_back
from dunlake.llm.classifier import resample
from dunlake.llm.codes import ENTRIES, PARTS, ROUNDS, SCALE, compress
from dunlake.llm.common import table
from dunlake.llm.encoding import decode, encode
from dunlake.llm.lines import dedup_lines
from dunlake.llm.neighbours import nearest_neighbours
from dunlake.llm.packing import pack
from dunlake.llm.quality import quality_rules
from dunlake.llm.runs import GRAM, SHORTEST, periodic_runs, with_planted_runs
from dunlake.llm.setjoin import jaccard_components
from dunlake.llm.substrings import dedup_spans
from dunlake.llm.urls import filter_urls, rules_table
from dunlake.llm.vectors import near_vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

VOCABULARY = "byte_bpe_50k.json"

# The rules that the URL query applies, as host, path and verdict.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def vocabulary(name: str = VOCABULARY) -> str:
    """Path of a public vocabulary file on each machine."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


def query(name: str, sql: str | None = None):
    def register(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


@query("op1_jaccard_join")
def op1_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_components(table(spark, folder, "documents"))


@query("op2_vector_join")
def op2_vector_join(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(table(spark, folder, "embeddings"))


@query("op3_line_dedup")
def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = dedup_lines(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", "n_spans", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


@query("op4_bpe")
def op4_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = vocabulary()
    there_and_back = decode(encode(table(spark, folder, "documents"), path), path)
    return there_and_back.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))


@query("op5_packing")
def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), vocabulary())


@query("op6_suffix_dedup")
def op6_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return dedup_spans(table(spark, folder, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op7_chat")
def op7_chat(spark: SparkSession, folder: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    planted = spark.createDataFrame(
        [(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_conversations(turns.unionByName(planted)))


@query("op8_quality_rules")
def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules(table(spark, folder, "documents"), table(spark, folder, "labels"))


def _url_sql() -> str:
    fits = sorted(URL_RULES, key=lambda r: (-len(r[0]) - len(r[1]), -len(r[0]), r[0]))
    when = lambda value: " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{value(h, p, v)}'" for h, p, v in fits
    )
    return f"""
    WITH parts AS (
      SELECT page_id,
        coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
      FROM pages)
    SELECT page_id, host, path, CASE {when(lambda h, p, v: h + p)} END AS rule,
      CASE {when(lambda h, p, v: v)} ELSE 'allow' END AS verdict
    FROM parts"""


@query("op9_url_filter", _url_sql())
def op9_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return filter_urls(table(spark, folder, "pages"), rules_table(spark, URL_RULES))


@query("op10_quality_classifier")
def op10_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return resample(table(spark, folder, "documents"), table(spark, folder, "labels"))


def _codes_sql() -> str:
    """Codebooks written out round by round; the last digits base 256 of a distance hold the entry, so the least is the nearest."""
    tables = [
        f"""kept AS (
      SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)""",
        f"""pieces AS MATERIALIZED (
      SELECT vec_id, label, part, v[part * (len(v) // {PARTS}) + 1 : (part + 1) * (len(v) // {PARTS})] AS v
      FROM kept, unnest(range({PARTS})) AS t(part))""",
        f"""book0 AS MATERIALIZED (
      SELECT part, rank AS entry, v AS c FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS rank FROM pieces)
      WHERE rank < {ENTRIES})""",
    ]
    for k in range(ROUNDS + 1):
        tables.append(
            f"""near{k} AS MATERIALIZED (
      SELECT vec_id, part, any_value(label) AS label, any_value(v) AS v,
        min(list_sum(list_transform(v, lambda x, i: (x - c[i]) * (x - c[i]))) * {ENTRIES} + entry) AS best
      FROM pieces JOIN book{k} USING (part) GROUP BY vec_id, part)"""
        )
        if k < ROUNDS:
            tables.append(
                f"""mean{k} AS (
      SELECT part, entry, list(CAST(floor(total / n) AS BIGINT) ORDER BY place) AS c FROM (
        SELECT part, CAST(best AS BIGINT) % {ENTRIES} AS entry, place, CAST(sum(x) AS DOUBLE) AS total, count(*) AS n
        FROM (SELECT part, best, unnest(v) AS x, unnest(range(len(v))) AS place FROM near{k}) GROUP BY ALL) GROUP BY part, entry),
    book{k + 1} AS MATERIALIZED (
      SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN mean{k} m ON m.part = b.part AND m.entry = b.entry)"""
            )
    return f"""WITH {", ".join(tables)},
    digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{ROUNDS}),
    coded AS (
      SELECT vec_id, any_value(label) AS label, string_agg(lpad(lower(to_hex(CAST(best AS BIGINT) % {ENTRIES})), 2, '0'), '' ORDER BY part) AS code,
        CAST(sum(CAST(best AS BIGINT) // {ENTRIES}) AS BIGINT) AS error
      FROM near{ROUNDS} GROUP BY vec_id)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, digest"""


@query("op11_vector_codes", _codes_sql())
def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return compress(table(spark, folder, "embeddings"))


def _runs_sql() -> str:
    """Words equal to those q further on, by joined grams; runs of a multiple of a period lie in the run of that period."""
    step = "lambda acc, e: xor(xor(acc, e) >> 1, 3988292384 * (xor(acc, e) & 1))"
    return f"""
    WITH given AS (
      SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
        xor(list_reduce([CAST(4294967295 AS UBIGINT)] || flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
          lambda c: [CAST(ascii(c) AS UBIGINT), 0, 0, 0, 0, 0, 0, 0])), {step}), 4294967295) AS h
      FROM documents),
    sized AS (SELECT *, len(words) AS n, CAST(h // 10 AS BIGINT) AS g, CASE WHEN len(words) > 0 THEN CAST(h // 10 AS BIGINT) % len(words) END AS a FROM given),
    planted AS MATERIALIZED (
      SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
        THEN list_transform(range(n), lambda i: words[1 + CASE WHEN i >= a THEN a + (i - a) % (1 + (n - a) // (3 + g % 8)) ELSE i END]) ELSE words END AS words
      FROM sized),
    said AS MATERIALIZED (SELECT doc_id, i, words[i + 1] AS word, CASE WHEN i + {GRAM} <= n THEN array_to_string(words[i + 1 : i + {GRAM}], ' ') END AS gram
      FROM (SELECT *, unnest(range(n)) AS i FROM planted)),
    again AS (SELECT l.doc_id, l.i, r.i - l.i AS q FROM said l JOIN said r ON l.doc_id = r.doc_id AND l.gram = r.gram AND l.i < r.i),
    islands AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM again),
    stretches AS MATERIALIZED (
      SELECT doc_id, min(i) AS start, count(*) + {GRAM - 1} + q AS length, q AS period FROM islands
      GROUP BY doc_id, q, island HAVING count(*) + {GRAM - 1} + q >= greatest({SHORTEST}, 2 * q)),
    runs AS MATERIALIZED (
      SELECT * FROM stretches s WHERE NOT EXISTS (
        SELECT 1 FROM stretches o WHERE o.doc_id = s.doc_id AND o.period < s.period AND o.start <= s.start AND o.start + o.length >= s.start + s.length)),
    kept AS (
      SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS collapsed FROM said w
      WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.doc_id = w.doc_id AND w.i >= r.start + r.period AND w.i < r.start + r.length) GROUP BY doc_id),
    summed AS (
      SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed,
        max(struct_pack(length := length, start := -start, period := -period)) AS best FROM runs GROUP BY doc_id)
    SELECT p.doc_id, coalesce(n_runs, 0) AS n_runs, -best.start AS start, best.length AS length, -best.period AS period,
      (1000 * best.length) // -best.period AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
    FROM planted p LEFT JOIN summed s ON s.doc_id = p.doc_id LEFT JOIN kept k ON k.doc_id = p.doc_id"""


@query("op12_periodic_runs", _runs_sql())
def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs(with_planted_runs(table(spark, folder, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    chosen = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), listed.alias("listed"), "collapsed")
    length, start, period = F.col("best.l"), -F.col("best.s"), -F.col("best.p")
    return chosen.select(
        "doc_id",
        "n_runs",
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(F.lit(1000) * length / period).alias("exponent_milli"),
        F.sha2(F.encode("listed", "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )


@query("op13_nearest_neighbours")
def op13_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return nearest_neighbours(table(spark, folder, "embeddings"))
