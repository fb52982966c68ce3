"""Quality rules: fixed base rules plus cutoffs that adapt to each language and source.

Signals of a text (all integers): ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
``n_repeat_words``.  Four rates are made of them (``RATES``, per mille or hundredths).  Each
rate is summed up per language and source in a mergeable quantile sketch: counts by
log-linear bucket, so that sketches of any two parts of the input merge by adding counts and
the result does not depend on the order of the rows.  A bucket is 1/32 of its value wide.
The cutoffs are fences around the quartiles that the sketch gives; the documents are then
joined with the cutoffs of their group and judged.

A fence lies ``FENCE`` quartile distances beyond the quartile.  Rates that are 0 in most texts have no such
distance; there the fence lies at least as far as a quantile of the positive values (its place is a
parameter of the rate, its value comes from the sketch), less if only some ``FEW`` texts are positive.
Where the rate has two fences, they lie at least a quarter of the median out.  Numbers of small groups are
blended with those of their language by the counts behind them, those of languages with the whole
table's (``BLEND`` counts weigh as much as the wider level), so no size switches the rule.  Everything is
DataFrame functions.

Edge cases: a null text counts as empty (no words, so it fails the base rules); a null
language or source is a value of its own; repeated rows are judged alike; columns of the
input that have the name of a result column are not read, and the filter keeps them as
they are.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabfid.llm.common import fresh, let, shared_table, window_hashes, words

SIGNALS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
WINDOW = 8
SYMBOLS = "#*$%&|<>"

#: rate -> (lower fence too, per cent of the positive values that the least distance of the fence is above).
RATES = {
    "symbol_rate": (False, 10),      # symbols per 1,000 words
    "dup_line_rate": (False, 75),    # repeated lines per 1,000 lines
    "repeat_rate": (False, 30),      # words in repeated windows per 1,000 words
    "word_length": (True, 0),        # hundredths of a character per word
}
#: Fences lie so many quartile distances beyond the quartiles.
FENCE = 3
#: Counts at which a group's own numbers weigh as much as those of the wider level.
BLEND = 200
#: Positive texts of the whole table at which the least distance is half of their quantile.
FEW = 20
#: Cutoff tables of up to so many groups (about 100 bytes each) are broadcast.
BROADCAST_GROUPS = 50_000
#: Beyond that, a group's documents are dealt to so many tasks.
SALTS = 64


def _covered(hashes: Column) -> Column:
    """Number of words inside windows that occur twice or more, from the windows' hashes in order."""
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    repeated = let(ordered, lambda s: F.sort_array(F.transform(
        F.filter(s, lambda e, i: (F.get(s, i - 1)["h"] == e["h"]) | (F.get(s, i + 1)["h"] == e["h"])),
        lambda e: e["p"])))
    return let(repeated, lambda p: F.aggregate(
        F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))),
        F.lit(0), lambda a, x: a + x))


def signals(docs: DataFrame, text: str = "text", out: str = "signals") -> DataFrame:
    """``docs`` with a struct column ``out``: the five signals and ``n_lines``, all long.

    Equal windows are found by 64-bit hashes within one text.
    """
    w, win, lines = fresh(docs, "words", "windows", "lines")
    body = F.coalesce(F.col(text), F.lit(""))
    step = docs.withColumns({w: words(F.col(text)),
                             lines: F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    step = step.withColumn(win, window_hashes(F.col(w), WINDOW))
    step = step.withColumn(out, F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(body, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct(win)) == F.size(win), F.lit(0)).otherwise(_covered(F.col(win)))
         .cast("long").alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
    ))
    return step.select(*docs.columns, out)


def _rates(s: Column) -> dict[str, Column]:
    n = F.greatest(s["n_words"], F.lit(1))
    return {
        "symbol_rate": F.floor(s["n_symbols"] * 1000 / n),
        "dup_line_rate": F.floor(s["n_dup_lines"] * 1000 / F.greatest(s["n_lines"], F.lit(1))),
        "repeat_rate": F.floor(s["n_repeat_words"] * 1000 / n),
        "word_length": F.floor(s["word_chars"] * 100 / n),
    }


def _key(c: str) -> Column:
    """A null is a group of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))


def sketches(rows: DataFrame, lang: str, source: str, sig: str) -> DataFrame:
    """Mergeable sketches: (lang_key, source_key, rate, bucket, n), one row for each filled bucket."""
    rate = F.explode(F.array(*[F.struct(F.lit(k).alias("rate"), v.alias("v")) for k, v in _rates(F.col(sig)).items()]))
    long = rows.select(_key(lang).alias("lang_key"), _key(source).alias("source_key"), rate.alias("r"))
    low_bits = "greatest(length(bin(r.v)) - 6, 0)"
    bucket = F.expr(f"shiftleft(shiftright(r.v, {low_bits}), {low_bits})")
    return long.groupBy("lang_key", "source_key", F.col("r.rate").alias("rate"), bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"))


def _level(sk: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rate, n, pos, q1, q2, q3, w) from merged sketches: rows, rows with a positive rate, quartiles, quantile of
    the positive ones.  A window partition holds one sketch."""
    merged = sk.groupBy(*keys, "rate", "bucket").agg(F.sum("n").alias("n"))
    by = Window.partitionBy(*keys, "rate")
    zero = F.coalesce(F.sum(F.when(F.col("bucket") == 0, F.col("n"))).over(by), F.lit(0))
    run = merged.select("*", F.sum("n").over(by.orderBy("bucket")).alias("upto"), F.sum("n").over(by).alias("total"), zero.alias("zero"))
    share = F.create_map(*[F.lit(x) for k, v in RATES.items() for x in (k, v[1])])[F.col("rate")]
    pos, above = F.col("total") - F.col("zero"), F.col("upto") - F.col("zero")
    return run.groupBy(*keys, "rate").agg(
        F.max("total").alias("n"), F.max(pos).alias("pos"),
        *[F.min(F.when(F.col("upto") * 4 >= F.col("total") * i, F.col("bucket"))).alias(f"q{i}") for i in (1, 2, 3)],
        F.coalesce(F.min(F.when((F.col("bucket") > 0) & (above * 100 >= pos * share), F.col("bucket"))), F.lit(0)).alias("w"))


def thresholds(sk: DataFrame, blend: int = BLEND) -> DataFrame:
    """One row for each language and source: the fences of each rate as structs."""
    def named(df: DataFrame, prefix: str) -> DataFrame:
        return df.select(*[c if c in ("lang_key", "source_key", "rate") else F.col(c).alias(f"{prefix}_{c}") for c in df.columns])

    def mixed(prefix: str, c: str, wide: Column) -> Column:
        n = F.col(f"{prefix}_pos" if c == "w" else f"{prefix}_n")
        return F.floor((n * F.col(f"{prefix}_{c}") + wide * blend) / (n + blend))

    j = named(_level(sk, ["lang_key", "source_key"]), "g").join(named(_level(sk, ["lang_key"]), "l"), ["lang_key", "rate"])
    j = j.join(F.broadcast(named(_level(sk, []), "a")), "rate")  # one row per rate
    whole = {c: F.col(f"a_{c}") for c in ("q1", "q2", "q3")} | {"w": F.floor(F.col("a_pos") * F.col("a_w") / (F.col("a_pos") + FEW))}
    j = j.withColumns({c: mixed("l", c, v) for c, v in whole.items()})
    j = j.withColumns({c: mixed("g", c, F.col(c)) for c in whole})
    two = F.create_map(*[F.lit(x) for k, v in RATES.items() for x in (k, v[0])])[F.col("rate")]
    wide = F.greatest((F.col("q3") - F.col("q1")) * FENCE, F.when(two, F.floor(F.col("q2") / 4)).otherwise(F.col("w")))
    fence = F.struct(F.when(two, F.col("q1") - wide).otherwise(F.lit(0)).alias("low"), (F.col("q3") + wide).alias("high"))
    return j.groupBy("lang_key", "source_key").agg(F.map_from_entries(F.sort_array(F.collect_list(
        F.struct("rate", fence.alias("f"))))).alias("fences"))


def judge(rows: DataFrame, cuts: DataFrame, lang: str, source: str, sig: str, out: str = "verdict",
          broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """``rows`` joined with the cutoffs of their group: adds struct ``out`` with ``base_failed``, ``failed_rule``
    (the first rate beyond its fence, or null) and ``kept``.

    Up to ``broadcast_groups`` groups (counted first) the cutoffs are broadcast; beyond, each
    group's rows are dealt to ``SALTS`` tasks, so that a hot source is no single task.
    """
    lk, gk, salt, fen = fresh(rows, "lang_key", "source_key", "salt", "fences")
    cuts = shared_table(cuts, "cutoffs")
    left = rows.withColumns({lk: _key(lang), gk: _key(source)})
    right = cuts.toDF(lk, gk, fen)
    if cuts.count() <= broadcast_groups:
        j = left.join(F.broadcast(right), [lk, gk])
    else:
        left = left.withColumn(salt, F.pmod(F.xxhash64(*[F.col(f"{sig}.{s}") for s in SIGNALS], F.monotonically_increasing_id()),
                                            F.lit(SALTS)).cast("int"))
        right = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        j = left.join(right, [lk, gk, salt])
    s = F.col(sig)
    base = (s["n_words"] < 20) | (s["n_repeat_words"] * 100 > s["n_words"] * 30)
    rule = F.coalesce(*[F.when(~v.between(F.col(fen)[k]["low"], F.col(fen)[k]["high"]), F.lit(k))
                        for k, v in _rates(s).items()])
    # one test of both: "not base and no rule" would be split, and its first part moved below the
    # signals, which would be computed once more for it
    kept = F.size(F.filter(F.array(base, rule.isNotNull()), lambda failed: failed)) == 0
    j = j.withColumn(out, F.struct(base.alias("base_failed"), rule.alias("failed_rule"), kept.alias("kept")))
    return j.select(*rows.columns, out)


def quality_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
                   source: str = "source", blend: int = BLEND, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """One row per document: ``doc_id``, the signals, ``base_failed``, ``failed_rule``, ``kept``.

    The texts are read once; their signals go to a narrow table that both the sketches and the
    join read.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("lang"),
                       F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
    slim = shared_table(signals(slim, "text", "s").drop("text"), "signals")
    cuts = thresholds(sketches(slim, "lang", "source", "s"), blend)
    j = judge(slim, cuts, "lang", "source", "s", "v", broadcast_groups)
    return j.select("doc_id", *[F.col(f"s.{c}").alias(c) for c in SIGNALS], "v.base_failed", "v.failed_rule", "v.kept")


def quality_filter(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
                   blend: int = BLEND, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``.

    The signals are computed once and written beside the rows; the sketches and the verdict read them back.
    """
    s, v = fresh(docs, "signals", "verdict")
    marked = shared_table(signals(docs, text, s), "marked")
    cuts = thresholds(sketches(marked, lang, source, s), blend)
    return judge(marked, cuts, lang, source, s, v, broadcast_groups).filter(F.col(v)["kept"]).select(*docs.columns)
