"""Queries of the subpackage and their SQL texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skywharf.llm import chat, decontaminate, html_text, language_model, licenses, mixing, ngram_join, periodic_runs, piece_codec, prefix_trie, quality_rules, secret_scan, shards

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under a name, with its SQL text."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _license_sql() -> str:
    """Rules and base phrases as SQL rows, and the detections they give, for DuckDB."""
    rules = ", ".join(f"({k}, '{r.label}', '{r.keyword}', '{r.pattern}', CAST({r.confidence} AS DOUBLE))" for k, r in enumerate(licenses.RULES))
    base = ", ".join(f"('{phrase}', '{label}')" for phrase, label in licenses.BASE)
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH rules(rank, label, keyword, pattern, confidence) AS (VALUES {rules}), base(phrase, label) AS (VALUES {base}),
d AS (SELECT doc_id, {words} AS w FROM documents),
p AS (SELECT doc_id, i, w[i + 1] AS word, array_to_string(w[i + 1 : i + {licenses.REACH}], ' ') || ' ' AS context FROM (SELECT doc_id, w, unnest(range(len(w))) AS i FROM d)),
b AS (SELECT p.doc_id, p.i, base.label FROM p JOIN base ON starts_with(p.context, base.phrase || ' ')),
found AS (
  SELECT p.doc_id, p.i AS first, p.i + len(regexp_extract_all(regexp_extract(p.context, r.pattern), ' ')) AS last, r.rank, r.label, r.confidence
  FROM p JOIN rules r ON p.word = r.keyword WHERE regexp_matches(p.context, r.pattern)
),
kept AS (
  SELECT * FROM found f WHERE NOT EXISTS (
    SELECT 1 FROM found e WHERE e.doc_id = f.doc_id AND e.first <= f.first AND e.last >= f.last AND e.rank < f.rank)
),
named AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM kept UNION SELECT doc_id, label FROM b) GROUP BY doc_id),
scored AS (SELECT doc_id, max(confidence) AS score FROM kept GROUP BY doc_id),
based AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
       CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN based USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN scored USING (doc_id)
"""


@query("op1_licenses", sql=_license_sql())
def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op2_chat_preferences", sql=r"""
WITH told AS (SELECT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
last AS (SELECT conv_id, max(turn) AS last, max({'t': turn, 'x': text}).x AS answer FROM told WHERE role = 'assistant' GROUP BY conv_id),
rows AS (
  SELECT t.*, l.last, o.conv_id IS NOT NULL AS has_other, o.answer AS other FROM told t LEFT JOIN last l USING (conv_id) LEFT JOIN last o ON o.conv_id = xor(t.conv_id, 1)
  WHERE l.last IS NULL OR turn IS NULL OR turn <= l.last
), turns AS (
  SELECT conv_id AS pair_id, 'chosen' AS side, turn, role, text FROM rows UNION ALL
  SELECT conv_id, 'rejected', turn, role, CASE WHEN turn = last AND role = 'assistant' THEN other ELSE text END FROM rows
  WHERE NOT coalesce(turn = last AND role = 'assistant', false) OR has_other
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k,
         '<|im_start|>' || coalesce(role, 'unknown') || chr(10) AS head, replace(coalesce(text, ''), '<|im_', '< |im_') || '<|im_end|>' AS body
  FROM turns
), sizes AS (
  SELECT pair_id, count(*) FILTER (side = 'chosen') AS c, count(*) FILTER (side = 'rejected') AS r FROM placed GROUP BY pair_id
), apart AS (
  SELECT c.pair_id, min(c.k) AS k FROM placed c JOIN placed r ON c.pair_id = r.pair_id AND c.k = r.k AND c.side = 'chosen' AND r.side = 'rejected'
  WHERE c.role IS DISTINCT FROM r.role OR c.text IS DISTINCT FROM r.text GROUP BY c.pair_id
), shared AS (SELECT pair_id, coalesce(k - 1, least(c, r)) AS shared FROM sizes LEFT JOIN apart USING (pair_id)),
rest AS (
  SELECT p.*, shared, sum(length(head) + length(body) + 1) OVER (PARTITION BY p.pair_id, side, k > shared ORDER BY k) - length(body) - 1 AS start FROM placed p JOIN shared USING (pair_id)
)
SELECT pair_id, coalesce(string_agg(head || body || chr(10), '' ORDER BY k) FILTER (side = 'chosen' AND k <= shared), '') AS prompt, CAST(max(shared) AS INTEGER) AS prompt_turns,
       coalesce(string_agg(head || body || chr(10), '' ORDER BY k) FILTER (side = 'chosen' AND k > shared), '') AS chosen,
       coalesce(string_agg(start || ':' || (start + length(body)), ',' ORDER BY k) FILTER (side = 'chosen' AND k > shared AND role = 'assistant'), '') AS chosen_mask,
       CAST(count(*) FILTER (side = 'chosen' AND k > shared) AS INTEGER) AS chosen_turns,
       coalesce(string_agg(head || body || chr(10), '' ORDER BY k) FILTER (side = 'rejected' AND k > shared), '') AS rejected,
       coalesce(string_agg(start || ':' || (start + length(body)), ',' ORDER BY k) FILTER (side = 'rejected' AND k > shared AND role = 'assistant'), '') AS rejected_mask,
       CAST(count(*) FILTER (side = 'rejected' AND k > shared) AS INTEGER) AS rejected_turns
FROM rest GROUP BY pair_id
""")
def op2_chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = chat.format_pairs(chat.contrast(table(spark, sf_dir, "conversations")))

    def joined(name):
        return F.array_join(F.transform(name, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias(name)

    return pairs.select("pair_id", "prompt", "prompt_turns", "chosen", joined("chosen_mask"), "chosen_turns", "rejected", joined("rejected_mask"), "rejected_turns")


@query("op3_quality_rules", sql=r"""
WITH t AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), runs AS (
  SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM t WHERE len(w) >= 5)
), again AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest(range(i, i + 5)) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM runs) WHERE c > 1
  ) GROUP BY doc_id
), counted AS (
  SELECT doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
         length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS capitals,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, coalesce(n, 0) AS n_repeat_words
  FROM t LEFT JOIN again USING (doc_id)
), measured AS (
  SELECT doc_id, lang, source, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_repeat_words,
         CASE WHEN n_words > 0 THEN 1000 * n_symbols // n_words ELSE 0 END AS symbol_rate,
         CASE WHEN len(lines) > 0 THEN 1000 * (len(lines) - len(list_distinct(lines))) // len(lines) ELSE 0 END AS dup_line_rate,
         CASE WHEN word_chars > 0 THEN 1000 * capitals // word_chars ELSE 0 END AS capital_rate,
         CASE WHEN n_words > 0 THEN 100 * word_chars // n_words ELSE 0 END AS word_length
  FROM counted
), long AS (
  SELECT lang, source, 'symbol_rate' AS metric, 300 AS slack, symbol_rate AS v FROM measured UNION ALL
  SELECT lang, source, 'dup_line_rate', 300, dup_line_rate FROM measured UNION ALL
  SELECT lang, source, 'capital_rate', 300, capital_rate FROM measured UNION ALL
  SELECT lang, source, 'word_length', 150, word_length FROM measured
), tops AS (
  SELECT lang, source, metric, slack, CASE WHEN v < 64 THEN v ELSE ((v >> (length(bin(v)) - 6)) + 1) * (1 << (length(bin(v)) - 6)) - 1 END AS top FROM long
), own AS (
  SELECT lang, source, metric, slack, count(*) AS n, quantile_disc(top, 0.25) AS q25, quantile_disc(top, 0.75) AS q75 FROM tops GROUP BY ALL
), by_lang AS (
  SELECT lang, metric, count(*) AS n, quantile_disc(top, 0.25) AS q25, quantile_disc(top, 0.75) AS q75 FROM tops GROUP BY ALL
), every AS (
  SELECT metric, quantile_disc(top, 0.25) AS q25, quantile_disc(top, 0.75) AS q75 FROM tops GROUP BY ALL
), fences AS (
  SELECT o.lang, o.source, o.metric, o.slack, CASE WHEN o.n >= 200 THEN o.q25 WHEN l.n >= 200 THEN l.q25 ELSE e.q25 END AS q25,
         CASE WHEN o.n >= 200 THEN o.q75 WHEN l.n >= 200 THEN l.q75 ELSE e.q75 END AS q75
  FROM own o JOIN by_lang l ON o.lang IS NOT DISTINCT FROM l.lang AND o.metric = l.metric JOIN every e ON o.metric = e.metric
), wide AS (
  SELECT lang, source, max(q75 + 3 * (q75 - q25) + slack) FILTER (metric = 'symbol_rate') AS s, max(q75 + 3 * (q75 - q25) + slack) FILTER (metric = 'dup_line_rate') AS d,
         max(q75 + 3 * (q75 - q25) + slack) FILTER (metric = 'capital_rate') AS c, max(q75 + 3 * (q75 - q25) + slack) FILTER (metric = 'word_length') AS h,
         max(q25 - 3 * (q75 - q25) - slack) FILTER (metric = 'word_length') AS l
  FROM fences GROUP BY lang, source
)
SELECT m.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND symbol_rate <= s AND dup_line_rate <= d AND capital_rate <= c AND word_length BETWEEN l AND h AS kept
FROM measured m JOIN wide f ON m.lang IS NOT DISTINCT FROM f.lang AND m.source IS NOT DISTINCT FROM f.source
""")
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op4_secrets")
def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    base = [rule.kind for rule in secret_scan.BASE]

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    digest = F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(base))), 256)
    return found.select("doc_id", *map(count, base), digest.alias("base_sha256"), joined(F.col("spans")).alias("spans"))


@query("op5_html_text")
def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query("op6_ngram_join")
def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op7_language_model")
def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_key")


@query("op8_mixing", sql=r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix' || coalesce(':' || doc_id, '')) AS o
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
  FROM sized GROUP BY source
), ordered AS (
  SELECT *, row_number() OVER (ORDER BY 2.0 * source_size / w, source NULLS LAST) AS k,
         sum(source_size) OVER () AS total FROM sources
), filled AS (
  SELECT *, coalesce(sum(2 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
         sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS above FROM ordered
), level AS (
  SELECT max(CAST(1.5 * total - below AS DOUBLE) / above) AS level FROM filled
), plan AS (
  SELECT source, source_size, CASE WHEN w * level > 2 * source_size THEN CAST(2 * source_size AS DOUBLE) ELSE w * level END AS target
  FROM sources, level
), parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM plan
), walked AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS part,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.o, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size AS start
  FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN size > 0 THEN size * least(whole + CASE WHEN 2 * start + size <= 2 * part THEN 1 ELSE 0 END, 2) ELSE 0 END AS BIGINT) AS taken
FROM walked
""")
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("row.doc_id", "size", "source_size", "target", "taken")


@query("op9_decontamination", sql=r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), hit AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (n, g)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
""")
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("item_ids", lambda x: x.cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"), "contaminated",
    )


@query("op10_sharding")
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign(table(spark, sf_dir, "documents"))


@query("op11_piece_codec")
def op11_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        return piece_codec.digests(table(spark, sf_dir, "documents"), file.read())


@query("op12_prefix_trie")
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths, conversations = prefix_trie.grafted(prefix_trie.ordered(table(spark, sf_dir, "conversations")))
    return prefix_trie.trie(paths, conversations).drop("digest")


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.runs(table(spark, sf_dir, "documents"), periodic_runs.repeated_tail)
    longest = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))), 1)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[x].cast("string") for x in ("start", "length", "period"))), F.lit("\n"))), "")
    top = found.withColumn("top", F.when(F.size("runs") > 0, longest))
    return top.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.s").alias("start"), (-F.col("top.l")).alias("length"), F.col("top.p").alias("period"),
        F.floor(-1000 * F.col("top.l") / F.col("top.p")).cast("long").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
