"""Registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covermill.llm import bpe, chat_format, decontaminate, html_content, language_id, line_dedup, periodic_runs, quality_rules, simhash, token_counts, token_files, tokenizer_alignment, url_filters
from covermill.llm.shipping import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.write_token_files(_table(spark, sf_dir, "documents"), token_files.new_folder(spark, "tokens"))
    return token_files.read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    docs = docs.withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    samples = language_id.learn(docs.where(~F.col("held_out")))
    return language_id.with_language(docs.select("doc_id", "text", "held_out"), samples).select("doc_id", "held_out", "lang_pred", "score")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = decontaminate.leaked_pairs(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return pairs.select("doc_id", "item_id", "n_item_words", "n_covered", "coverage", F.size("tiles").cast("long").alias("n_tiles"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = bpe.round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_html_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return html_content.with_main_text(pages, html_content.learn(pages)).select("page_id", "url", "text", "n_chars")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP6_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), shared AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.last AS dropped FROM keyed k LEFT JOIN shared s USING (key)
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN dropped THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

PROBE = "</s>[INST] ok [/INST]"


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    done = chat_format.format_conversations(rows.unionByName(probe))
    turns, learned = chat_format.read_turns()
    read = done.select("conv_id", turns.alias("turns"), learned.alias("learned"), F.length("formatted").cast("long").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        "formatted_chars",
    )


_ESCAPED = f"regexp_replace({{}}, '{chat_format.control_pattern()}', '\\1\\\\\\2\\3', 'g')"
OP7_SQL = f"""
WITH rows AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'
), turns AS (
  SELECT *, '{chat_format.TURN_OPEN}' || {_ESCAPED.format("role")} || chr(10) || {_ESCAPED.format("text")} || '{chat_format.TURN_CLOSE}' || chr(10) AS piece FROM rows
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, piece)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, piece) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(piece)) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = token_counts.with_token_counts(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = quality_rules.with_quality(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return docs.select(*base, "n_subwords", "n_byte_tokens", "n_symbol_tokens", "token_entropy", "script")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def _planted(docs: DataFrame) -> DataFrame:
    """Every tenth document by the hash of its id ends in repeats of some of its words."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.coalesce(h % 10 == 0, F.lit(False)).alias("planted"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    docs = docs.withColumn("words", F.when(F.col("planted"), words)).withColumn("n", F.size("words"))
    docs = docs.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    p = 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))
    docs = docs.withColumn("p", p).withColumn("times", F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int"))
    tail = F.flatten(F.array_repeat(F.slice("words", (F.col("a") + 1).cast("int"), F.col("p").cast("int")), F.col("times")))
    text = F.array_join(F.slice(F.concat(F.slice("words", F.lit(1), F.col("a").cast("int")), tail), F.lit(1), F.col("n")), " ")
    return docs.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.with_runs(_planted(_table(spark, sf_dir, "documents").select("doc_id", "text")), into="found")
    runs = F.col("found.runs")
    longest = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform(runs, lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    docs = docs.select("doc_id", F.size(runs).cast("long").alias("n_runs"), longest.alias("longest"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("found.collapsed", 256).alias("collapsed_sha256"))
    return docs.select(
        "doc_id",
        "n_runs",
        (-F.col("longest.start")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.period")).alias("period"),
        F.expr("1000 * longest.length div -longest.period").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )


#: The rules of the query; the url that starts with one is labelled.
URL_RULES = [
    url_filters.Rule("block", "net", "/"),
    url_filters.Rule("allow", "example.net", "/en/"),
    url_filters.Rule("block", "example.com", "/de/"),
    url_filters.Rule("allow", "org", "/fr/"),
]


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = url_filters.with_verdicts(_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return pages.select("page_id", "host", "path", "rule", "verdict", "template")


def _op12_sql() -> str:
    """The tree of templates level by level, as many levels as there can be."""
    u = url_filters

    def fits(r: url_filters.Rule) -> str:
        return f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"

    ordered = sorted(URL_RULES, key=lambda r: -len(r.text))
    rule = " ".join(f"WHEN {fits(r)} THEN '{r.text}'" for r in ordered)
    decided = " ".join(f"WHEN {fits(r)} THEN '{r.verdict}'" for r in ordered)

    def chi(columns: list[str], limit: float) -> str:
        total = {c: f"CAST(sum({c}) OVER w AS DOUBLE)" for c in columns}
        n = " + ".join(f"CAST({c} AS DOUBLE)" for c in columns)
        r = " + ".join(f"({total[c]} - {c})" for c in columns)
        terms = " + ".join(f"CASE WHEN {total[c]} > 0 THEN pow({c} * ({r}) - ({total[c]} - {c}) * ({n}), 2) / {total[c]} ELSE 0 END" for c in columns)
        return f"({terms}) > {limit} * (({n}) * ({r}))"

    levels = []
    for k in range(u.DEPTH):
        levels.append(f"""
branches{k} AS MATERIALIZED (
  SELECT host, template, tokens[{k + 1}] AS token, sum(blocked) AS blocked, sum(allowed) AS allowed, sum(unlabelled) AS unlabelled,
         sum(CASE WHEN len(tokens) = {k + 1} THEN blocked + allowed + unlabelled ELSE 0 END) AS ends,
         sum(CASE WHEN len(tokens) > {k + 1} THEN blocked + allowed + unlabelled ELSE 0 END) AS goes_on
  FROM tree{k} WHERE len(tokens) > {k} GROUP BY ALL
), named{k} AS MATERIALIZED (
  SELECT host, template, token,
         CASE WHEN count(*) OVER w = 1
                OR (ends + goes_on >= {u.MIN_PAGES} AND sum(ends + goes_on) OVER w - (ends + goes_on) >= {u.MIN_PAGES}
                    AND ({chi(["blocked", "allowed", "unlabelled"], u.LABELS_DIFFER)} OR {chi(["ends", "goes_on"], u.WAYS_DIFFER)}))
              THEN token ELSE '*' END AS name
  FROM branches{k} WINDOW w AS (PARTITION BY host, template)
), tree{k + 1} AS MATERIALIZED (
  SELECT t.host, t.tokens, t.blocked, t.allowed, t.unlabelled, CASE WHEN n.name IS NULL THEN t.template ELSE t.template || '/' || n.name END AS template
  FROM tree{k} t LEFT JOIN named{k} n ON t.host = n.host AND t.template = n.template AND len(t.tokens) > {k} AND t.tokens[{k + 1}] = n.token
),""")
    return f"""
WITH parts AS (
  SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), cut AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM parts
), split AS (
  SELECT page_id, host, path, CASE {rule} END AS rule, CASE {decided} END AS decided, string_split(regexp_replace(path, '[0-9]+', '{{n}}', 'g'), '/')[2:] AS all_tokens FROM cut
), rows AS MATERIALIZED (
  SELECT *, CASE WHEN len(all_tokens) > {u.DEPTH} THEN list_append(all_tokens[1:{u.DEPTH - 1}], array_to_string(all_tokens[{u.DEPTH}:], '/')) ELSE all_tokens END AS tokens FROM split
), tree0 AS MATERIALIZED (
  SELECT host, tokens, count(*) FILTER (WHERE decided = 'block') AS blocked, count(*) FILTER (WHERE decided = 'allow') AS allowed,
         count(*) FILTER (WHERE decided IS NULL) AS unlabelled, '' AS template
  FROM rows GROUP BY host, tokens
), {"".join(levels)} rejected AS (
  SELECT host, template FROM tree{u.DEPTH} GROUP BY ALL
  HAVING 100 * (sum(blocked) + {u.SMOOTHING}) >= {u.REJECTED_PERCENT} * (sum(blocked) + sum(allowed) + 2 * {u.SMOOTHING})
), shapes AS (
  SELECT t.host, t.tokens, t.template FROM tree{u.DEPTH} t JOIN rejected r ON t.host = r.host AND t.template = r.template
)
SELECT p.page_id, p.host, p.path, p.rule, coalesce(p.decided, CASE WHEN s.template IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       CASE WHEN p.decided IS NULL THEN s.template END AS template
FROM rows p LEFT JOIN shapes s ON p.host = s.host AND p.tokens = s.tokens
"""


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tokenizer_alignment.with_alignment(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
    docs = docs.select("doc_id", "n_a", "n_b", "n_groups", digest.alias("groups_sha256"), "links")
    return tokenizer_alignment.with_link_counts(docs).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: _shipped(f) for f in (op1_token_files, op2_language_id, op3_decontaminate, op4_bpe, op5_html_content, op6_line_dedup, op7_chat_format, op8_token_counts, op9_quality_rules, op10_simhash, op11_periodic_runs, op12_url_filters, op13_tokenizer_alignment, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op6_line_dedup": OP6_SQL, "op7_chat_format": OP7_SQL, "op12_url_filters": _op12_sql()}
