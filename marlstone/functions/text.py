"""Text: glob patterns, tokens and BM25."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

K1, B = 1.5, 0.75
#: Rows of queries and terms up to which they go to every task of a batch, so that no other word leaves its task.
BROADCAST_TERMS = 100_000
#: Products of a row's terms and the queries with them that a task holds at once.
SCORES = 1_000_000
_CUT = r"[^\p{L}\p{N}-]+"


def glob_regex(pattern: str, fold: bool = False) -> str:
    """An anchored regular expression for a glob: * is any run, ? any sign."""
    body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)
    return f"(?s{'i' if fold else ''})^{body}$"


def glob(c: Column, pattern: str, fold: bool = False) -> Column:
    return c.rlike(glob_regex(pattern, fold))


def contains(c: Column, word: Column | str) -> Column:
    return F.contains(c, F.lit(word) if isinstance(word, str) else word)


def tokens(c: Column) -> Column:
    """Lower-case words: runs of letters, digits and hyphens."""
    return F.array_remove(F.split(F.lower(c), _CUT), "")


def query_terms(q: str) -> list[str]:
    import regex

    return [t for t in regex.split(r"[^\p{L}\p{N}-]+", q.lower()) if t]


def _tf(w: Column, term: str) -> Column:
    return F.size(w) - F.size(F.array_remove(w, term))


def _may_hold(c: Column, terms: list[str]) -> Column:
    """Whether a text has any of the terms as a part: no other needs its words."""
    low, out = F.lower(c), F.lit(False)
    for t in terms:
        out = out | F.contains(low, F.lit(t))
    return out


def with_bm25(docs: DataFrame, corpus: DataFrame, text: Column, query: str, score: str, matching: bool = False) -> DataFrame:
    """``docs`` with a column of BM25: k1 1.5, b 0.75 and the Robertson weight ln((N - df + 0.5) / (df + 0.5)), null where
    no term of ``query`` is; only the others with ``matching``.

    The statistics are those of ``corpus``, one row.  Scores are made where the rows are, without a join on a key, and
    only texts that hold a term as a part are split into words.
    """
    terms = sorted(set(query_terms(query)))
    weight = {t: query_terms(query).count(t) for t in terms}
    if not terms:
        rows = docs.withColumn(score, F.lit(None).cast("double"))
        return rows.limit(0) if matching else rows
    w = tokens(text)
    stats = corpus.select(w.alias("w")).agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("avgdl"), *(F.sum(F.array_contains("w", t).cast("int")).alias(f"df{i}") for i, t in enumerate(terms)))
    s = "_".join(["bm25", *docs.columns])[:500]  # a name that no column has
    rows = docs.filter(_may_hold(text, terms)) if matching else docs
    rows = rows.join(F.broadcast(stats.select(F.struct("*").alias(s))))  # one row
    found = F.when(_may_hold(text, terms), F.struct(F.size(w).alias("dl"), *(_tf(w, t).alias(f"tf{i}") for i, t in enumerate(terms))))
    rows = rows.withColumn(s, F.when(found.isNotNull(), F.struct(found.alias("own"), F.col(s).alias("all"))))
    parts, some = [], F.lit(False)
    for i, t in enumerate(terms):
        tf, df = F.col(f"{s}.own.tf{i}"), F.col(f"{s}.all.df{i}")
        idf = F.log((F.col(f"{s}.all.n") - df + 0.5) / (df + 0.5))
        parts.append(F.when(tf > 0, weight[t] * idf * (K1 + 1) * tf / (tf + K1 * (1 - B + B * F.col(f"{s}.own.dl") / F.col(f"{s}.all.avgdl")))).otherwise(0.0))
        some = some | (tf > 0)
    rows = rows.withColumn(score, F.when(some, sum(parts[1:], parts[0]))).drop(s)
    return rows.filter(F.col(score).isNotNull()) if matching else rows


def bm25(docs: DataFrame, text: str, key: str, query: str, score: str = "score") -> DataFrame:
    """(key, score) of the documents that hold a term of ``query``."""
    narrow = docs.select(key, F.col(text).alias("__t"))
    return with_bm25(narrow, narrow, F.col("__t"), query, score, matching=True).select(key, score)


def _places(words: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, number of the term, how often) of the terms in lists of words, in order."""
    at = pc.index_in(words.flatten(), terms)
    lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(words), dtype=np.int64), lengths)
    there = at.is_valid().to_numpy(zero_copy_only=False)
    both, tf = np.unique(row[there] * max(len(terms), 1) + at.drop_null().to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
    return both // max(len(terms), 1), both % max(len(terms), 1), tf


def counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(number, dl, token, tf) of each row's different words, from (number, words)."""
    for b in batches:
        words = b.column(1)
        terms = pc.unique(words.flatten())
        row, term, tf = _places(words, terms)
        dl = pc.fill_null(pc.list_value_length(words), 0).cast(pa.int32()).take(pa.array(row))
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), dl, terms.take(pa.array(term)), pa.array(tf.astype(np.int64))], [b.schema.names[0], "dl", "token", "tf"])


def _counted(terms: list[str]):
    """Rows of a task with each term; under -1 all rows, under -2 all words, under -3 rows with a text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, df, n, total, said = pa.array(terms, pa.string()), np.zeros(len(terms), np.int64), 0, 0, 0
        for b in batches:
            df += np.bincount(_places(b.column(0), known)[1], minlength=len(terms))
            n, total, said = n + b.num_rows, total + (pc.sum(pc.list_value_length(b.column(0))).as_py() or 0), said + b.num_rows - b.column(0).null_count
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"t": np.concatenate([at, [-1, -2, -3]]).astype(np.int64), "c": np.concatenate([df[at], [n, total, said]]).astype(np.int64)})

    return count


def _scored(terms: list[str], asked: list[tuple[int, int, float]], avgdl: float):
    """(place of the row in its batch's keys, query, score) of every row and query that share a term: ``asked`` has
    (term, query, weight).  A row's scores are made where the row is, ``SCORES`` at a time."""
    known = pa.array(terms, pa.string())
    asked = sorted(asked)
    of, query, weight = (np.array(c) for c in zip(*asked)) if asked else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    first = np.searchsorted(of, np.arange(len(terms) + 1))
    many = int(query.max()) + 1 if len(query) else 1

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dl = b.column(1).to_numpy(zero_copy_only=False).astype(float)
            row, term, tf = _places(b.column(0), known)
            part = (K1 + 1) * tf / (tf + K1 * (1 - B + B * dl[row] / avgdl))
            times = first[term + 1] - first[term]
            ends = np.cumsum(times)
            a = 0
            while a < len(row):
                # whole rows, and those of SCORES products at most or one row
                z = max(int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SCORES, "right")), a + 1)
                z = int(np.searchsorted(row, row[z], "left")) if z < len(row) else z
                z = int(np.searchsorted(row, row[a], "right")) if z <= a else z
                n = times[a:z]
                at = np.repeat(first[term[a:z]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                pair, place = np.unique(np.repeat(row[a:z], n) * many + query[at], return_inverse=True)
                total = np.bincount(place, np.repeat(part[a:z], n) * weight[at], len(pair))
                keys = b.column(2).take(pa.array(pair // many))
                yield pa.RecordBatch.from_arrays([pa.array(pair % many), keys, pa.array(total)], ["q", "key", "score"])
                a = z

    return score


def bm25_batch(docs: DataFrame, text: str, key: str, queries: DataFrame, query_key: str, query_text: str) -> DataFrame:
    """(query_key, key, score) for a table of queries.

    Up to ``BROADCAST_TERMS`` rows of queries and terms go to every task, which scores its rows one by one: nothing is
    shuffled and no task holds more than a batch.  With more of them, or where a key has several rows, postings are joined
    on the term and a document's weights are summed with map-side combining.
    """
    asked = queries.select(query_key, F.explode(tokens(F.col(query_text))).alias("term")).groupBy(query_key, "term").agg(F.count("*").alias("qtf"))
    if asked.limit(BROADCAST_TERMS + 1).count() > BROADCAST_TERMS or not docs.groupBy(key).count().filter("count > 1").isEmpty():
        return _bm25_joined(docs, text, key, asked, query_key)
    found = asked.collect()  # counted
    terms = sorted({r.term for r in found})
    number = {t: i for i, t in enumerate(terms)}
    names = queries.select(query_key).schema
    keys: dict = {}
    words = docs.select(tokens(F.col(text)).alias("w"), F.col(key).alias("key")).select("w", F.size("w").alias("dl"), "key")
    counts = {r.t: r.c for r in words.select("w").mapInArrow(_counted(terms), "t long, c long").groupBy("t").agg(F.sum("c").alias("c")).collect()}
    n, avgdl = counts.get(-1, 0), counts.get(-2, 0) / max(counts.get(-3, 0), 1)
    places = [(number[r.term], keys.setdefault(r[0], len(keys)), r.qtf * math.log((n - df + 0.5) / (df + 0.5))) for r in found if (df := counts.get(number[r.term], 0))]
    scores = words.filter("w is not null").mapInArrow(_scored(terms, places, avgdl), StructType([StructField("q", LongType()), StructField("key", docs.schema[key].dataType), StructField("score", DoubleType())]))
    own = docs.sparkSession.createDataFrame([(i, k) for k, i in keys.items()], StructType([StructField("q", LongType()), StructField("k", names[0].dataType)]))
    return scores.join(F.broadcast(own), "q").select(F.col("k").alias(query_key), F.col("key").alias(key), "score")  # counted


def _bm25_joined(docs: DataFrame, text: str, key: str, asked: DataFrame, query_key: str) -> DataFrame:
    words = docs.select(key, tokens(F.col(text)).alias("w"))
    stats = words.agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("avgdl"))
    few = asked.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    near = F.broadcast if few else lambda df: df  # counted
    vocabulary = near(asked.select("term").distinct())
    post = words.select(key, F.size("w").alias("dl"), F.explode("w").alias("term")).join(vocabulary, "term", "left_semi").groupBy(key, "dl", "term").agg(F.count("*").alias("tf"))
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    idf = asked.join(df, "term").join(F.broadcast(stats)).withColumn("idf", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = F.col("qtf") * F.col("idf") * (K1 + 1) * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return post.join(near(idf), "term").groupBy(query_key, key).agg(F.sum(part).alias("score"))
