"""Benchmark decontamination: a prefix-filtered set join, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

WINDOW = 10
SHINGLE = 3
#: Shingles of the benchmark up to which their table (16 bytes a row) goes to every task; beyond, both sides are shuffled.
BROADCAST_ROWS = 1_000_000
_CUTS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """With A-Z lower-cased, the runs of other than ASCII signs."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(C.ascii_lower(text))
    return F.array_remove(F.split(low, _CUTS), "")


def _key(w: Column, i: Column, k: int) -> Column:
    return F.xxhash64(F.lit(k), *(F.get(w, i + j) for j in range(k)))


def _keys(w: Column, n: Column, k: int) -> Column:
    """Of all shingles of k words."""
    return F.transform(F.sequence(F.lit(0), n - k), lambda i: _key(w, i, k))


def windows(bench: DataFrame) -> DataFrame:
    """A row per different window of the items: text, words, len, wid (a number of its own)."""
    items = bench.select(words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    rows = items.select(F.explode(_windows(F.col("w"))).alias("words"))
    rows = rows.groupBy(F.array_join("words", " ").alias("text")).agg(F.first("words").alias("words"))
    # numbers hold once the table is stored
    return rows.select("text", "words", F.size("words").alias("len"), F.monotonically_increasing_id().alias("wid"))


def _windows(w: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - WINDOW + 1, F.lit(1))), lambda i: F.slice(w, i, WINDOW))


def _row_key() -> Column:
    """A 128-bit hash of doc_id and text: rows with null or repeated doc_ids are told apart, equal ones share all results."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))))


AT = "array<struct<start:int,len:int>>"


def _candidates(docs: DataFrame, wins: DataFrame) -> DataFrame | None:
    """(key, at): for each row that holds a window's rarest shingle the places where a window could start, each once
    whatever the number of windows.  None without windows.

    Shingles of SHINGLE words are ordered by rarity in the corpus, and each window keeps only its rarest: a text that
    contains the window contains that one, so for containment one is prefix enough.  Its places in the documents, less
    its place in the window, give where the window would start; starts before the text or ends past it are dropped (the
    length and positional bounds).  Items of fewer than SHINGLE words are one shingle of their own.
    """
    sizes = sorted({r[0] for r in wins.select(F.least("len", F.lit(SHINGLE))).distinct().collect()})  # of 1, 2, 3
    if not sizes:
        return None
    k_of = F.least("len", F.lit(SHINGLE))
    keys = F.lit(None)
    for k in sizes:
        keys = F.when(k_of == k, _keys(F.col("words"), F.col("len"), k)).otherwise(keys)
    wins_at = C.stored(wins.select("wid", "len", F.posexplode(keys).alias("off", "tok")), "shingles")
    toks = C.stored(wins_at.select("tok").distinct(), "tokens")
    if toks.count() <= BROADCAST_ROWS:
        toks = F.broadcast(toks)
    base = docs.select(_row_key().alias("key"), words(F.col("text")).alias("w"))
    # the shingles of every size from one split of the text
    every = [F.when(F.size("w") >= k, F.transform(_keys(F.col("w"), F.size("w"), k), lambda h, i: F.struct(i.alias("pos"), h.alias("tok")))).otherwise(F.array().cast("array<struct<pos:int,tok:bigint>>")) for k in sizes]
    rows = base.select("key", F.size("w").alias("n"), F.explode(F.concat(*every) if len(every) > 1 else every[0]).alias("s"))
    places = C.stored(rows.select("key", "n", "s.pos", "s.tok").join(toks, "tok", "left_semi"), "places")
    rarity = places.groupBy("tok").agg(F.count("*").alias("rarity"))
    # windows with a shingle that no document has can't occur
    ranked = wins_at.join(rarity, "tok", "left").groupBy("wid", "len").agg(F.min(F.struct(F.coalesce("rarity", F.lit(0)).alias("rarity"), "tok", "off")).alias("p"))
    # windows that share shingle, place and length are one candidate
    prefix = ranked.filter("p.rarity > 0").select("len", "p.tok", "p.off").distinct()
    start = F.col("pos") - F.col("off")
    cands = places.join(prefix, "tok").filter((start >= 0) & (start + F.col("len") <= F.col("n")))
    return cands.groupBy("key").agg(F.collect_set(F.struct(start.cast("int").alias("start"), "len")).alias("at"))


def _checked(docs: DataFrame, cands: DataFrame | None, how: str = "left") -> DataFrame:
    """doc_id, key, n_words and the candidates' words in the text, which decide."""
    rows = docs.withColumn("key", _row_key())
    rows = rows.withColumn("at", F.lit(None).cast(AT)) if cands is None else rows.join(cands, "key", how)
    rows = rows.select("doc_id", "key", words(F.col("text")).alias("w"), "at")
    texts = F.transform("at", lambda c: F.struct(c["start"].alias("start"), c["len"].alias("len"), F.array_join(F.slice("w", c["start"] + 1, c["len"]), " ").alias("text")))
    return rows.select("doc_id", "key", F.size("w").alias("n_words"), texts.alias("found"))


def _hits(checked: DataFrame, wins: DataFrame) -> DataFrame:
    """(key, start, len, wid) of the candidates whose words are a window's."""
    found = checked.filter("found is not null").select("key", F.inline("found")).distinct()
    return found.join(wins.select("text", "wid"), "text").select("key", "start", "len", "wid")


def report(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of ``docs`` (doc_id, text) against the
    windows of ``bench`` (item_id, text).

    Candidates carry places alone, at most one for each start and window length of a text; the words there are compared
    with the windows by an equi-join, and items join last.  A null text has no words; an item without words has no
    window; an item with a null id hits but is not counted among the items; rows with equal or null doc_ids are judged
    each on its own text; with an empty benchmark nothing is hit.
    """
    docs, bench = C.pick(docs, "doc_id", "text"), C.pick(bench, "item_id", "text")
    wins = C.stored(windows(bench), "windows")
    checked = C.stored(_checked(docs, _candidates(docs, wins)), "checked")
    hits = C.stored(_hits(checked, wins), "hits")
    places = hits.groupBy("key").agg(F.collect_set(F.struct("start", "len")).alias("at"))
    covered = F.array_distinct(F.flatten(F.transform("at", lambda c: F.sequence(c["start"], c["start"] + c["len"] - 1))))
    places = places.select("key", F.size(covered).alias("n_hit"))
    items = bench.filter("item_id is not null").select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    items = items.select("item_id", F.explode(_windows(F.col("w"))).alias("words")).select("item_id", F.array_join("words", " ").alias("text"))
    items = items.join(wins.select("text", "wid"), "text").select("wid", "item_id").distinct()
    named = hits.select("key", "wid").distinct().join(items, "wid").groupBy("key").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    rows = checked.select("doc_id", "key", "n_words").join(places, "key", "left").join(named, "key", "left")
    names = F.coalesce("items", F.array().cast("array<string>"))
    return rows.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(names), ",").cast("binary"), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
    )


def clean(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark, with their columns."""
    wins = C.stored(windows(C.pick(bench, "item_id", "text")), "windows")
    cands = _candidates(C.pick(docs, "doc_id", "text"), wins)
    if cands is None:
        return docs
    # only rows with candidates are compared
    hits = C.stored(_hits(_checked(C.pick(docs, "doc_id", "text"), cands, "inner"), wins).select("key").distinct(), "hits")
    row = "_".join(["row", *docs.columns])  # a name that no column has
    return docs.withColumn(row, _row_key()).join(hits.withColumnRenamed("key", row), row, "left_anti").select(*docs.columns)
