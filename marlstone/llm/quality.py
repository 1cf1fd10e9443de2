"""Quality rules with risk-controlled thresholds, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Each rule rejects above a cutoff of its grid.
RULES: dict[str, list[float]] = {
    "symbols": [0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3, 0.5, 0.8],
    "dup_lines": [0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8],
    "repeats": [0.02, 0.04, 0.06, 0.08, 0.1, 0.15, 0.2, 0.3, 0.4],
    "long_words": [6.5, 7.0, 7.5, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0],
    "short_words": [-4.5, -4.2, -4.0, -3.7, -3.4, -3.1, -2.8, -2.4, -2.0],
}
#: At most this share of a stratum's good documents may be rejected, all rules together, with this chance of error.
RISK, ERROR = 0.05, 0.05
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Strata up to which their cutoffs go to every task; rows are shuffled by stratum only beyond.
BROADCAST_STRATA = 10_000
_BLANK = r"[\x20\x09-\x0D]+"


def measures(docs: DataFrame, *keep: str) -> DataFrame:
    """The base measures of every whole text of ``docs``, and n_lines, beside the columns ``keep``.  Windows of one text
    are equal where their 64-bit hashes are."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(*keep, text.alias("t"))
    rows = rows.select(
        *keep,
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).alias("n_symbols"),
        F.array_remove(F.split("t", _BLANK), "").alias("w"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    h = F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    rows = rows.select(
        *keep, "n_symbols",
        F.size("w").alias("n_words"), F.length(F.array_join("w", "")).alias("word_chars"),
        F.size("lines").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.when(F.size("w") > 3, h).otherwise(F.array().cast("array<bigint>")).alias("h"),
    )
    # windows in order of their hash: equal ones are neighbours
    s = F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    rows = rows.withColumn("s", s).drop("h")
    twice = F.zip_with(F.slice("s", 1, F.size("s") - 1), F.slice("s", 2, F.size("s") - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    rows = rows.withColumn("at", F.when(F.col("s").isNotNull(), F.array_distinct(F.flatten(F.filter(twice, lambda x: x.isNotNull()))))).drop("s")
    covered = F.size(F.array_distinct(F.flatten(F.transform("at", lambda i: F.array(i, i + 1, i + 2)))))
    rows = rows.withColumn("n_repeat_words", F.when(F.col("at").isNotNull(), covered).otherwise(0))
    return rows.select(*keep, *(F.col(c).cast("long").alias(c) for c in (*MEASURES, "n_lines")))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _signals() -> dict[str, Column]:
    per_word = lambda c: F.col(c) / F.greatest("n_words", F.lit(1))
    return {"symbols": per_word("n_symbols"), "dup_lines": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)), "repeats": per_word("n_repeat_words"), "long_words": per_word("word_chars"), "short_words": -per_word("word_chars")}


def _within(k: Column, n: Column, p: float, log_level: Column) -> Column:
    """Whether the chance of k or fewer successes in n trials of chance p is at most the level: then the exact
    (Clopper-Pearson) upper bound on the rate is p or less.  In logarithms, so that no n underflows."""
    odds = F.log(F.lit(p / (1 - p)))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i) + odds
        top = F.greatest(acc["sum"], term)
        return F.struct(term.alias("term"), (top + F.log(F.exp(acc["sum"] - top) + F.exp(term - top))).alias("sum"))

    first = n * F.log(F.lit(1 - p))
    total = F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("bigint"), k)).otherwise(F.array().cast("array<bigint>")), F.struct(first.alias("term"), first.alias("sum")), step, lambda acc: acc["sum"])
    return F.when(k < n * p, total <= log_level).otherwise(False)


def cutoffs(rows: DataFrame, labels: DataFrame, stratum: str) -> DataFrame:
    """(stratum, limits): for each stratum a map from rule to the chosen cutoff.

    The labelled rows of ``rows`` that pass the base rules are the holdout.  A cutoff is admissible when the exact
    binomial bound on the share of good documents (quality 1) that it rejects is at most RISK divided by the number
    of rules, at ERROR divided by all the tests made (strata, rules and cutoffs).  Of the admissible ones that with
    the most rejected bad documents less ten times the good ones is taken, if that is positive; else the rule is off.
    """
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality"))
    held = rows.filter(~F.col("base_failed")).join(known, "doc_id").select(F.col(stratum).alias("stratum"), "quality", *(c.alias(r) for r, c in _signals().items()))
    levels = F.array(*(F.struct(F.lit(r).alias("rule"), sum(((F.col(r) > g).cast("int") for g in grid), F.lit(0)).alias("level")) for r, grid in RULES.items()))
    counts = held.select("stratum", "quality", F.inline(levels)).groupBy("stratum", "rule", "level").agg(F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("bad"))
    total = held.groupBy("stratum").agg(F.sum("quality").cast("bigint").alias("n"))
    tests = total.agg((F.count("*") * sum(map(len, RULES.values()))).alias("tests"))
    over = counts.filter("level > 0").select("stratum", "rule", F.explode(F.sequence(F.lit(1), F.col("level"))).alias("cut"), "good", "bad")
    over = over.groupBy("stratum", "rule", "cut").agg(F.sum("good").cast("bigint").alias("k"), F.sum("bad").alias("bad"))
    over = over.alias("o").join(total.alias("t"), F.expr("o.stratum <=> t.stratum")).select("o.*", "t.n").join(F.broadcast(tests))  # one row
    over = over.filter(_within(F.col("k"), F.col("n"), RISK / len(RULES), F.log(F.lit(ERROR) / F.col("tests"))))
    gain = F.col("bad") - 10 * F.col("k")
    best = over.filter(gain > 0).groupBy("stratum", "rule").agg(F.max(F.struct(gain.alias("gain"), "cut")).alias("best"))
    grid = F.create_map(*(x for r, g in RULES.items() for x in (F.lit(r), F.array(*map(F.lit, g)))))
    best = best.select("stratum", "rule", F.get(grid[F.col("rule")], F.col("best.cut") - 1).alias("limit"))
    return best.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "limit"))).alias("limits"))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, the base measures, base_failed and kept for every row of ``docs`` (doc_id, text and the stratum).

    kept is false if a base rule fails, else if a rule's measure is over its stratum's cutoff.  A stratum without
    enough labelled documents has no cutoffs and keeps all that the base rules pass; a null stratum is one of its own.
    A null or empty text has no words and fails; labels with nulls are left out, and a doc_id labelled both ways is
    bad; repeated rows stay, each judged alone; without labels only the base rules count.
    """
    rows = C.stored(measures(docs, "doc_id", stratum).withColumn("base_failed", base_failed()), "measures")
    limits = C.stored(cutoffs(rows, labels, stratum), "cutoffs")
    if limits.count() <= BROADCAST_STRATA:
        limits = F.broadcast(limits)
    joined = rows.alias("r").join(limits.alias("l"), F.expr(f"r.{stratum} <=> l.stratum"), "left").select("r.*", "l.limits")
    over = F.lit(False)
    for r, c in _signals().items():
        over = over | F.coalesce(c > F.col("limits")[r], F.lit(False))
    return joined.select("doc_id", *MEASURES, "base_failed", (~F.col("base_failed") & ~over).alias("kept"))
