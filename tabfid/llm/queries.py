"""Registered queries of the subpackage: thin digests over the operators, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabfid.llm import chat_format, cotraining, decontaminate, hard_negatives, minhash, mixing, pieces, quality_rules, secrets, sharding, spelling, substring_dedup, url_filter
from tabfid.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def deco(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn
    return deco


_RATES = {"symbol_rate": "1000 * n_symbols // greatest(n_words, 1)", "dup_line_rate": "1000 * n_dup_lines // greatest(n_lines, 1)",
          "repeat_rate": "1000 * n_repeat_words // greatest(n_words, 1)", "word_length": "100 * word_chars // greatest(n_words, 1)"}


_TWO = ", ".join(f"'{k}'" for k, (t, _) in quality_rules.RATES.items() if t)


def _level_sql(keys: str) -> str:
    """Rows, rows with a positive rate, quartiles and quantile of the positive rates of one level, from bucket edges."""
    lead = f"{keys}, " if keys else ""
    share = "CASE rate " + " ".join(f"WHEN '{k}' THEN {v}" for k, (_, v) in quality_rules.RATES.items()) + " END"
    return (f"SELECT {lead}rate, max(total) AS n, max(total - zero) AS pos, " + ", ".join(
        f"min(CASE WHEN 4 * i >= {q} * total THEN b END) AS q{q}" for q in (1, 2, 3))
        + f", coalesce(min(CASE WHEN b > 0 AND 100 * (i - zero) >= {share} * (total - zero) THEN b END), 0) AS w "
        f"FROM (SELECT {lead}rate, b, count(*) OVER (PARTITION BY {lead}rate ORDER BY b) AS i, count(*) OVER (PARTITION BY {lead}rate) AS total, "
        f"count(*) FILTER (b = 0) OVER (PARTITION BY {lead}rate) AS zero FROM v) GROUP BY ALL")


def _mix_sql(t: str, wide: str) -> str:
    """Numbers of level ``t`` blended with those of the wider one."""
    k = quality_rules.BLEND
    return ", ".join(f"({t}.{n} * {t}.{c} + {wide}.{c} * {k}) // ({t}.{n} + {k}) AS {c}"
                     for c, n in (("q1", "n"), ("q2", "n"), ("q3", "n"), ("w", "pos")))


@query(f"""
WITH d AS (SELECT doc_id, coalesce('=' || lang, 'null') AS l, coalesce('=' || source, 'null') AS s, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, t) AS c FROM (SELECT doc_id, k, array_to_string(w[k:k + 7], ' ') AS t
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS k FROM d))),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + 8)) AS p FROM g WHERE c > 1) GROUP BY doc_id),
x AS (SELECT doc_id, l, s, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(c.n, 0) AS n_repeat_words,
             list_filter(string_split(text, chr(10)), lambda y: regexp_matches(y, '[^\\x20\\x09-\\x0D]')) AS lines
      FROM d LEFT JOIN c USING (doc_id)),
q AS (SELECT * EXCLUDE (lines), len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines FROM x),
r AS (UNPIVOT (SELECT doc_id, l, s, {", ".join(f"CAST({v} AS BIGINT) AS {k}" for k, v in _RATES.items())} FROM q)
      ON {", ".join(_RATES)} INTO NAME rate VALUE val),
v AS (SELECT *, (val >> greatest(length(bin(val)) - 6, 0)) << greatest(length(bin(val)) - 6, 0) AS b FROM r),
g1 AS ({_level_sql("l, s")}), g2 AS ({_level_sql("l")}),
g3 AS (SELECT rate, q1, q2, q3, pos * w // (pos + {quality_rules.FEW}) AS w FROM ({_level_sql("")})),
m2 AS (SELECT l, rate, {_mix_sql("g2", "g3")} FROM g2 JOIN g3 USING (rate)),
m1 AS (SELECT g1.l, s, rate, {_mix_sql("g1", "m2")} FROM g1 JOIN m2 USING (l, rate)),
f AS (SELECT l, s, rate, q1, q3, greatest({quality_rules.FENCE} * (q3 - q1), CASE WHEN rate IN ({_TWO}) THEN q2 // 4 ELSE w END) AS wide FROM m1),
j AS (SELECT r.*, CASE WHEN rate IN ({_TWO}) THEN q1 - wide ELSE 0 END AS low, q3 + wide AS high,
             CASE rate {" ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(quality_rules.RATES))} END AS place
      FROM r JOIN f USING (l, s, rate)),
o AS (SELECT doc_id, arg_min(rate, place) FILTER (val < low OR val > high) AS failed_rule FROM j GROUP BY doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, failed_rule,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND failed_rule IS NULL AS kept
FROM q JOIN o USING (doc_id)
""")
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals, base rules and the verdict of the adaptive cutoffs for every document."""
    return quality_rules.quality_report(table(spark, sf_dir, "documents"))


@query()
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every whole text and of the text decoded from them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    d = pieces.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), ids="ids", back="decoded")
    return d.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                    F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                    F.sha2("decoded", 256).alias("decoded_sha256"))


@query()
def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text: counts of the base kinds, their digest and all spans."""
    d = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    def of(*kinds: str):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return d.select("doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in secrets.KINDS],
                    F.sha2(secrets.span_text(of(*secrets.KINDS[:3])), 256).alias("base_sha256"),
                    secrets.span_text(F.col("spans")).alias("spans"))


@query()
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards of near equal bytes, tokens and rows; equal texts stay together."""
    d = sharding.shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), 8)
    return d.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard"), "tokens")


#: The contract's url rules.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query("""
WITH h AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), u AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM h
), r(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (
  SELECT u.*, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h) + length(p) DESC, length(h) DESC) AS n
  FROM u LEFT JOIN r ON (u.host = h OR ends_with(u.host, '.' || h)) AND starts_with(u.path, p)
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE n = 1
""")
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, winning rule and verdict of every page's url."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def _sql_escape(c: str) -> str:
    out = f"replace({c}, '\\', '\\\\')"
    for s in chat_format.CONTROLS:
        out = f"replace({out}, '{s}', '{s[0]}\\{s[1:]}')"
    return out


@query(f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), t AS (
  SELECT *, {len(chat_format.OPEN) + len(chat_format.CLOSE) + 2} + length(replace({_sql_escape("role")}, chr(10), '\\' || chr(10)))
         + length({_sql_escape("text")}) AS n FROM c
), e AS (
  SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto,
         lead(1) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS NULL AS is_last FROM t
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (role = 'assistant' OR is_last) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""")
def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations, read back from their formatted examples."""
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)],
                                 "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    ex = chat_format.examples(turns.unionByName(more))
    read = F.when(F.col("is_last"), chat_format.parsed_turns(F.col("text")))
    back = ex.select("conv_id", "example", F.length("text").cast("long").alias("chars"), read.alias("turns"),
                     chat_format.loss_text(F.col("text"), F.col("loss_start"), F.col("loss_end")).alias("reply"))
    one = back.groupBy("conv_id").agg(
        F.sum("chars").alias("formatted_chars"), F.max("turns").alias("turns"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "reply"))), lambda x: x["reply"]), "").alias("loss"))
    said_turns = F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    return one.select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                      F.sha2(F.array_join(said_turns, ""), 256).alias("turns_sha256"),
                      F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                      "formatted_chars")


_PLAIN = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"


@query(f"""
WITH d AS (SELECT doc_id, {_PLAIN} AS w FROM documents),
i AS (SELECT item_id, {_PLAIN} AS w FROM benchmark),
g AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS k FROM i WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, size, k, array_to_string(w[k:k + size - 1], ' ') AS gram
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, (SELECT DISTINCT size FROM g))
), h AS (SELECT doc_id, size, k, item_id FROM dw JOIN g USING (size, gram)),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + size)) AS p FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n, string_agg(t, ',' ORDER BY t) AS s
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS t FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(m.n, 0) AS BIGINT) AS n_items, sha256(coalesce(m.s, '')) AS items_sha256, c.n IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
""")
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every whole document."""
    d = decontaminate.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return d.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query(f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s AS a JOIN s AS b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n AS nx ON nx.doc_id = x JOIN n AS ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
m AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM m LEFT JOIN n USING (doc_id)
""")
def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size, component and verdict of every document."""
    d = minhash.linked_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_shingles", "component_id", "kept")


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


@query(f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, k, array_to_string(w[k:k + 49], ' ') AS t
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS k FROM d)),
f AS (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY t) < doc_id AS gone FROM g),
x AS (SELECT DISTINCT doc_id, unnest(range(k, k + 50)) AS p FROM f WHERE gone),
o AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
s AS (SELECT doc_id, count(x.p) AS n, string_agg(word, ' ' ORDER BY p) FILTER (x.p IS NULL) AS t
      FROM o LEFT JOIN x USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN s USING (doc_id)
""")
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that windows of 50 words of smaller documents cover."""
    d = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query()
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of good quality and of toxicity for every document; kept: good and not toxic."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    models = cotraining.train(docs, table(spark, sf_dir, "labels"), {"quality": False, "toxic": True})
    d = cotraining.score(docs, models)
    return d.select("doc_id", "quality", "toxic", (F.col("toxic") >= 0.5).alias("is_toxic"),
                    ((F.col("quality") >= 0.5) & (F.col("toxic") < 0.5)).alias("kept"))


def weight_schedule(docs: DataFrame) -> DataFrame:
    """Schedules of the sources of ``docs`` by code point, null last; their integrals are 3, 1, 2, repeating.

    Sources of weight 3 are heavy early on, those of weight 1 late, those of weight 2 all along.
    """
    kinds = [(0, 0.0, 4.0), (0, 0.5, 3.0), (0, 1.0, 2.0), (1, 0.0, 0.0), (1, 0.5, 1.0), (1, 1.0, 2.0), (2, 0.0, 2.0), (2, 1.0, 2.0)]
    knots = docs.sparkSession.createDataFrame(kinds, "kind int, at double, weight double")
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return docs.select("source").distinct().withColumn("kind", rank % 3).join(F.broadcast(knots), "kind").select("source", "at", "weight")


@query("""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
                  md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s),
r AS (SELECT *, CAST(sum(2 * source_size) OVER o - 2 * source_size AS BIGINT) AS before,
             CAST(sum(weight) OVER () - sum(weight) OVER o + weight AS BIGINT) AS open_weight, CAST(sum(source_size) OVER () AS BIGINT) AS total
      FROM w WINDOW o AS (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, 2 * (2 * source_size * open_weight + before * weight) <= 3 * total * weight AS full_ FROM r),
l AS (SELECT 1.5::DOUBLE * max(total) - coalesce(sum(2 * source_size) FILTER (full_), 0) AS rest, coalesce(sum(weight) FILTER (NOT full_), 0) AS open_w FROM f),
t AS (SELECT source, source_size, weight, CASE WHEN full_ THEN CAST(2 * source_size AS DOUBLE) ELSE CAST(weight * rest AS DOUBLE) / CAST(open_w AS DOUBLE) END AS target FROM f, l),
q AS (SELECT d.*, source_size, target, weight, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT doc_id, size, source_size, target, weight, CASE WHEN size = 0 THEN 0 WHEN (start + source_size) * 2 + size <= target * 2 THEN 2
             WHEN start * 2 + size <= target * 2 THEN 1 ELSE 0 END AS copies,
             (start + CAST(size AS DOUBLE) / 2) / target * weight AS y FROM q)
SELECT doc_id, size, source_size, target, copies * size AS taken,
       CASE WHEN copies > 0 THEN round(CASE weight WHEN 3 THEN 2 * y / (4 + sqrt(16 - 4 * y)) WHEN 1 THEN 2 * y / sqrt(4 * y) ELSE y / 2 END, 6) END AS first_position
FROM c
""")
def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of every document, with the place of its first copy in the curriculum."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    d = mixing.assign(docs, weight_schedule(docs))
    return d.select("doc_id", "size", "source_size", "target", "taken", F.round(F.get("positions", F.lit(0)), 6).alias("first_position"))


@query("""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
      FROM e AS a JOIN e AS b ON a.vec_id % 100 = 0 AND (b.vec_id IS NULL OR a.vec_id <> b.vec_id)),
p AS (SELECT * FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank,
             s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
      FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.alike AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
""")
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to ten hard negatives for each of the five positives of every anchor; part of the labels is shifted first."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", shifted))


@query("""
WITH RECURSIVE bits(i, c, k) AS (SELECT i, CAST(i AS BIGINT), 0 FROM range(256) AS t(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n
      FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS w FROM documents) GROUP BY 1, 2 HAVING length(w) >= 6),
h AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
             lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1])), 4294967295) AS h
      FROM (SELECT w, n, hex(encode(d || ':' || w)) AS x FROM r), crc),
o AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, CAST(h % length(w) AS INTEGER)) || substr(w, CAST(h % length(w) AS INTEGER) + 2) ELSE w END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM o WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
p AS (SELECT word, n, i, substr(word, 1, i) || chr(0) || substr(word, i + 2) AS k, substr(word, 1, i) || substr(word, i + 2) AS less
      FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM v)),
e AS (SELECT a.word, b.word AS near, b.n FROM p AS a JOIN p AS b USING (k) WHERE a.word <> b.word
      UNION SELECT p.word, v.word, v.n FROM p JOIN v ON p.less = v.word
      UNION SELECT v.word, p.word, p.n FROM p JOIN v ON p.less = v.word),
b AS (SELECT word, count(*) AS n_near, arg_min(near, (-n, near)) AS best, max(n) AS best_n FROM e GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * v.n THEN best END AS form, CASE WHEN best_n >= 5 * v.n THEN best_n END AS form_n
      FROM v LEFT JOIN b USING (word)),
g AS (SELECT word, word AS at FROM f UNION ALL SELECT g.word, f.form FROM g JOIN f ON g.at = f.word WHERE f.form IS NOT NULL),
l AS (SELECT g.word, g.at AS root FROM g JOIN f ON g.at = f.word WHERE f.form IS NULL)
SELECT f.word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM f JOIN l USING (word)
""")
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, root and number of near words of every word that is frequent enough."""
    words = spelling.word_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return spelling.variants(words)
