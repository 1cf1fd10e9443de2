"""Queries of the operators that have no clause of their own, of datasets, sources and streams, with SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import api
from ..functions import jsonfn
from ..functions import tensor as T
from ..functions import text as X
from ..operators import rows, search, sequences, stats
from ..operators.indexes import Indexes
from ..sources import io
from ..sources.dataset import Dataset
from ..sources.paths import work_path
from ..sources.tables import Database
from ..streaming import events as streams
from . import sqlcompat
from .tql_queries import _COS, _E, _HEX, _M, _MT, _Q, _QT, _WORDS, ORDER, Folder, _j, bm25_sql, flattened

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):
    """Registers a function of (session, tables) under its name, with its SQL where there is one."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark, Folder(spark, sf_dir))
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in cols})


# sources and sinks


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_round_trip(spark, t):
    path = work_path(spark, "csv")
    io.to_csv(t["nation"], path)
    return io.from_csv(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@query("SELECT vec_id, label FROM embeddings WHERE label = 4")
def parquet_round_trip(spark, t):
    path = work_path(spark, "parquet")
    t["embeddings"].write.parquet(path)
    return io.from_parquet(spark, path).filter("label = 4").select("vec_id", "label")


@query("SELECT s_suppkey AS id, 'img/' || s_name AS image, s_nationkey AS height, CASE WHEN n > 0 THEN n END AS boxes FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_quantity > 40 GROUP BY l_suppkey) ON s_suppkey = l_suppkey")
def coco_import(spark, t):
    """Suppliers as images and line items as their boxes, through a COCO file."""
    images = t["supplier"].select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("file_name"), F.col("s_nationkey").alias("height"), F.lit(1).alias("width"))
    marks = t["lineitem"].filter("l_quantity > 40").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("image_id"), F.array(F.lit(0.0), F.lit(0.0), "l_quantity", F.lit(1.0)).alias("bbox"), F.lit(1).alias("category_id"))
    path = work_path(spark, "coco") + "/marks.json"
    io.to_coco(path, images=images, annotations=marks, categories=spark.range(1).select(F.lit(1).alias("id"), F.lit("line").alias("name")))
    return io.from_coco(spark, "img", path).select("id", "image", F.col("height").cast("int").alias("height"), F.when(F.col("bbox").isNotNull(), F.size("bbox").cast("long")).alias("boxes"))


@query("SELECT count(*) AS n FROM lineitem")
def count_from_footers(spark, t):
    """The count alone, which the reader takes from the files' footers."""
    return io.count_rows(spark, f"{t.path}/lineitem.parquet")


# rows


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders) WHERE r >= 100 AND r < 250")
def row_slice(spark, t):
    return rows.row_slice(rows.with_row_id(t["orders"], ORDER["orders"]), 100, 250).select("o_orderkey")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 7")
def row_slice_negative(spark, t):
    return rows.row_slice(rows.with_row_id(t["orders"], ORDER["orders"]), -7).select("o_orderkey")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders) JOIN (VALUES (5), (0), (77), (5)) AS v(i) ON r = i")
def row_list(spark, t):
    return rows.row_list(rows.with_row_id(t["orders"], ORDER["orders"]), [5, 0, 77, 5]).select("o_orderkey")


@query("SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def first_per_key(spark, t):
    return rows.first_per_key(t["events"], ["user_id"], ["event_id"]).select("user_id", "event_id")


@query("SELECT CAST(500 AS BIGINT) AS n, true AS within, true AS heavier")
def sample_by_weight(spark, t):
    """500 draws with replacement, the urgent orders ten times as likely: their share is checked against chance."""
    w = rows.weight([(F.col("o_orderpriority") == "1-URGENT", 10.0), (F.lit(True), 1.0)])
    got = rows.sample_by(t["orders"], w, 500)
    share = F.avg((F.col("o_orderpriority") == "1-URGENT").cast("int"))
    base = t["orders"].agg(F.avg((F.col("o_orderpriority") == "1-URGENT").cast("int")).alias("p"))
    one = got.agg(F.count("*").alias("n"), share.alias("s")).join(F.broadcast(base))  # one row each
    expect = 10 * F.col("p") / (1 + 9 * F.col("p"))
    return one.select("n", (F.abs(F.col("s") - expect) < 0.1).alias("within"), (F.col("s") > F.col("p")).alias("heavier"))


@query("SELECT CAST(100 AS BIGINT) AS n, CAST(100 AS BIGINT) AS different, CAST(0 AS BIGINT) AS weightless")
def sample_without_replacement(spark, t):
    got = rows.sample_by(t["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"), F.when(F.col("l_quantity") > 10, F.col("l_quantity")).otherwise(0), 100, replace=False)
    return got.agg(F.count("*").alias("n"), F.countDistinct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity").alias("different"), F.coalesce(F.sum((F.col("l_quantity") <= 10).cast("long")), F.lit(0)).alias("weightless"))


@query("SELECT CAST(count(*) * 5 // 100 AS BIGINT) AS n FROM orders")
def sample_percent(spark, t):
    return rows.sample_by(t["orders"], F.lit(1.0), percent=5.0, replace=False).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS total FROM orders")
def order_by_random(spark, t):
    """A shuffle keeps every row once."""
    got = api.query("SELECT o_orderkey FROM orders ORDER BY RANDOM()", spark, tables=t, order=ORDER)
    return got.agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("total"))


@query("SELECT label, 'c' || label AS name FROM embeddings UNION ALL SELECT (label + 1) % 64, 'c' || (label + 1) % 64 FROM embeddings")
def class_label_union(spark, t):
    """The second side's numbers follow their names: its names stand in another order."""
    own, names = t["embeddings"].select("label"), [f"c{i}" for i in range(64)]
    a = rows.class_label(own, "label", names)
    b = rows.class_label(own, "label", names[1:] + names[:1])
    both = rows.union_labels(a, b, "label")
    return both.select("label", rows.label_name("label", rows.class_names(both.schema["label"])).alias("name"))


@query("SELECT o_custkey AS k, o_orderstatus AS s FROM orders UNION ALL SELECT c_custkey, c_mktsegment FROM customer")
def union_by_name(spark, t):
    a = t["orders"].select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("s"))
    b = t["customer"].select(F.col("c_mktsegment").alias("s"), F.col("c_custkey").alias("k"))
    return rows.set_operation(a, b, "union", keep_all=True)


@query("SELECT c_custkey, coalesce(o_orderkey, 0) AS o_orderkey, coalesce(o_orderstatus, '') AS o_orderstatus FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000")
def null_compat(spark, t):
    joined = t["customer"].join(t["orders"].filter("o_totalprice > 300000"), F.expr("c_custkey = o_custkey"), "left").select("c_custkey", "o_orderkey", "o_orderstatus")
    return rows.sparse_defaults(joined, {"o_orderkey": 0, "o_orderstatus": ""})


# sequences


@query(f"SELECT user_id, event_id, {_j('list(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)')} AS value FROM events")
def expand_partitioned(spark, t):
    return flattened(sequences.expand(t["events"].select("user_id", "event_id", "value"), ["event_id"], 3, partition=["user_id"]))


@query("SELECT conv_id, turn, role FROM conversations")
def group_then_split(spark, t):
    """Sequences and back: every row returns."""
    rows_ = t["conversations"].select("conv_id", "turn", "role")
    seq = sequences.group_to_sequence(rows_, ["conv_id"], ["turn"], ["turn", "role"], keep_keys=True)
    return sequences.ungroup_split(seq, ["turn", "role"])


@query(f"SELECT vec_id, CAST(label AS BIGINT) AS label, {_j(f'{_E}[1:label]')} AS embedding FROM embeddings UNION ALL SELECT vec_id, label, {_j(f'{_E}[label + 1:label + 2]')} FROM embeddings")
def ungroup_by_column(spark, t):
    df = t["embeddings"].withColumn("sizes", F.array("label", F.lit(2)))
    return flattened(sequences.ungroup_lengths(df, ["embedding"], "sizes").select("vec_id", F.col("label").cast("long").alias("label"), "embedding"))


# arrays and vectors


@query(f"SELECT vec_id, array_to_string(list_transform(range(0, 5), lambda b: len(list_filter({_E}, lambda x: x >= -0.5 AND x <= 0.5 AND least(CAST(floor((x + 0.5) / 0.2) AS BIGINT), 4) = b)) * 1000), ',') AS h FROM embeddings")
def arr_histogram(spark, t):
    return flattened(t["embeddings"].select("vec_id", T.histogram(F.col("embedding"), -0.5, 0.5, 5).alias("h")))


@query("SELECT user_id, array_to_string(list_transform(range(0, 4), lambda b: len(list_filter(v, lambda x: x = b)) * 1000), ',') AS c FROM (SELECT user_id, list(CAST(event_id % 4 AS INTEGER)) AS v FROM events GROUP BY user_id)")
def arr_bincount(spark, t):
    seqs = t["events"].groupBy("user_id").agg(F.collect_list((F.col("event_id") % 4).cast("int")).alias("v"))
    return flattened(seqs.select("user_id", T.bincount(F.col("v"), 4).alias("c")))


@query(f"SELECT vec_id, {_j(f'list_transform(range(1, 33), lambda i: ({_E}[i] + {_E}[i + 32]) / 2)')} AS m FROM embeddings")
def arr_mean_rows(spark, t):
    m = F.array(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32))
    return flattened(t["embeddings"].select("vec_id", T.mean_rows(m).alias("m")))


@query(f"SELECT vec_id, CAST(len(list_filter(range(1, 65), lambda i: ({_E}[i] > 0) <> (CAST([{', '.join(map(str, _Q))}] AS DOUBLE[])[i] > 0))) AS BIGINT) AS d FROM embeddings")
def vec_sign_bits(spark, t):
    d = T.bits_apart(T.sign_bits(F.col("embedding"), 64), T.sign_bits(T.vector(_Q), 64))
    return t["embeddings"].select("vec_id", d.cast("long").alias("d"))


@query(f"SELECT vec_id, round({_COS}, 6) AS score FROM embeddings ORDER BY {_COS} DESC LIMIT 15")
def vec_clustered_search(spark, t):
    """A search of all clusters is exact; recall with fewer is measured in the tests."""
    index = search.ClusteredIndex.build(t["embeddings"], "vec_id", "embedding", work_path(spark, "clusters"), clusters=8)
    return rounded(index.search(_Q, 15, search.SearchConfig(8, 1.0)), "score")


@query(f"SELECT vec_id, round({_COS}, 6) AS score FROM embeddings ORDER BY {_COS} DESC LIMIT 5")
def vec_quantised_search(spark, t):
    index = search.ClusteredIndex.build(t["embeddings"], "vec_id", "embedding", work_path(spark, "clusters"), clusters=8, quantised=True)
    return rounded(index.search(_Q, 5, search.SearchConfig(8, 50.0), exact=True), "score")


@query("SELECT vec_id, round(score, 6) AS score FROM (SELECT vec_id, " + " + ".join(f"greatest({', '.join(f'list_cosine_similarity({_E}[{a}:{a + 3}], CAST({r} AS DOUBLE[]))' for a in range(1, 65, 4))})" for r in _M) + " AS score FROM embeddings) ORDER BY score DESC LIMIT 10")
def vec_pooled_search(spark, t):
    """Matrices ranked by MAXSIM, all of them: candidates by their mean rows would make it inexact on large tables."""
    m = t["embeddings"].select("vec_id", F.array(*(F.slice("embedding", a, 4) for a in range(1, 65, 4))).alias("m"))
    return rounded(search.pooled_top_k(m, "m", _M, 10, "vec_id", search.SearchConfig(10, 1e5), exact=True), "score")


@query(f"SELECT label, vec_id, round(s, 6) AS score, CAST(r AS BIGINT) AS rank FROM (SELECT label, vec_id, s, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS r FROM (SELECT *, {_COS} AS s FROM embeddings)) WHERE r <= 3")
def vec_topk_per_label(spark, t):
    got = search.top_k_per(t["embeddings"], "label", T.cosine_to(F.col("embedding"), _Q), 3, "vec_id")
    return rounded(got.select("label", "vec_id", "score", F.col("rank").cast("long").alias("rank")), "score")


@query("SELECT b.vec_id AS vec_id, CAST(a.embedding AS DOUBLE[]) < CAST(b.embedding AS DOUBLE[]) AS greater FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vec_ordering(spark, t):
    """Arrays compare element by element: each vector with the one before it."""
    e = t["embeddings"]
    return e.alias("a").join(e.alias("b"), F.expr("b.vec_id = a.vec_id + 1")).select("b.vec_id", (F.col("a.embedding") < F.col("b.embedding")).alias("greater"))


# text


@query(f"SELECT item_id, doc_id, round(sum(qtf * ln((n - df + 0.5) / (df + 0.5)) * 2.5 * tf / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 4) AS score FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), {_HEX})) AS term FROM benchmark) q0 JOIN LATERAL (SELECT 1 AS qtf) ON true JOIN (SELECT doc_id, term, dl, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM (SELECT doc_id, regexp_extract_all(lower(text), {_HEX}) AS w FROM documents)) GROUP BY ALL) USING (term) JOIN (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), {_HEX})) AS term FROM documents) GROUP BY term) USING (term), (SELECT count(*) AS n, avg(len(regexp_extract_all(lower(text), {_HEX}))) AS avgdl FROM documents) GROUP BY item_id, doc_id")
def bm25_batch(spark, t):
    return rounded(X.bm25_batch(t["documents"], "text", "doc_id", t["benchmark"], "item_id", "text"), "score", digits=4)


_HYBRID = f"""
WITH v AS (SELECT doc_id, {_COS} AS score FROM documents JOIN embeddings ON doc_id = vec_id ORDER BY score DESC LIMIT 10),
x AS (SELECT doc_id, score FROM ({bm25_sql(_WORDS)}) ORDER BY score DESC, doc_id LIMIT 10),
v2 AS (SELECT doc_id, 0.3 * exp(least(score, 700)) / (SELECT sum(exp(least(score, 700))) FROM v) AS s FROM v),
x2 AS (SELECT doc_id, 0.7 * exp(least(score, 700)) / (SELECT sum(exp(least(score, 700))) FROM x) AS s FROM x)
SELECT coalesce(v2.doc_id, x2.doc_id) AS doc_id, round(coalesce(v2.s, 0) + coalesce(x2.s, 0), 6) AS score
FROM v2 FULL JOIN x2 ON v2.doc_id = x2.doc_id ORDER BY coalesce(v2.s, 0) + coalesce(x2.s, 0) DESC, 1 LIMIT 10"""


@query(_HYBRID)
def hybrid_topk(spark, t):
    vectors = t["documents"].select("doc_id").join(t["embeddings"], F.expr("doc_id = vec_id")).select("doc_id", "embedding")
    return rounded(search.hybrid(search.cosine_top_k(vectors, "embedding", _Q, 10, "doc_id"), search.bm25_top_k(t["documents"], "text", _WORDS, 10, "doc_id"), 10, "doc_id", 0.3, 0.7), "score")


@query(f"SELECT vec_id, round({_COS}, 6) AS score FROM embeddings ORDER BY {_COS} DESC LIMIT 12")
def similarity_vectors(spark, t):
    t["embeddings"].createOrReplaceTempView("embeddings")
    return rounded(sqlcompat.run(spark, f"SELECT vec_id, embedding <#> {_QT} AS score FROM embeddings ORDER BY score LIMIT 12"), "score")


_MATRIX = "ARRAY[" + ", ".join(f"embedding[{a}:{a + 4}]" for a in range(0, 64, 4)) + "]"


@query("SELECT vec_id, round(score, 6) AS score FROM (SELECT vec_id, " + " + ".join(f"greatest({', '.join(f'list_cosine_similarity({_E}[{a}:{a + 3}], CAST({r} AS DOUBLE[]))' for a in range(1, 65, 4))})" for r in _M) + " AS score FROM embeddings) WHERE score > 1")
def similarity_matrices(spark, t):
    return rounded(api.query(f"SELECT vec_id, {_MATRIX} <#> {_MT} AS score FROM embeddings WHERE {_MATRIX} <#> {_MT} > 1", spark, tables=t, order=ORDER), "score")


@query(f"SELECT doc_id, round(score, 6) AS score FROM ({bm25_sql(_WORDS)}) ORDER BY score DESC LIMIT 12")
def similarity_texts(spark, t):
    t["documents"].createOrReplaceTempView("documents")
    return rounded(sqlcompat.run(spark, f"SELECT doc_id, text <#> '{_WORDS}' AS score FROM documents ORDER BY text <#> '{_WORDS}' LIMIT 12"), "score")


@query(_HYBRID)
def similarity_records(spark, t):
    both = t["documents"].select("doc_id", "text").join(t["embeddings"], F.expr("doc_id = vec_id"), "left")
    q = f"SELECT doc_id, (embedding, text) <#> ({_QT}, '{_WORDS}', 0.3, 0.7)::hybrid_record_weighted AS score FROM both ORDER BY score LIMIT 10"
    return rounded(api.query(q, spark, tables={"both": both}, order={"both": ["doc_id"]}), "score")


def _indexed(spark, df: DataFrame, name: str, **kinds: str) -> Indexes:
    d = Dataset.create(spark, work_path(spark, name), df.schema)
    d.append(df)
    d.commit(name)
    for column, kind in kinds.items():
        Indexes(d).create(column, kind)
    return Indexes(d)


@query(f"SELECT doc_id, round(score, 6) AS score FROM ({bm25_sql(_WORDS)})")
def index_bm25(spark, t):
    """Scores from stored postings, of which the query's terms alone are read."""
    ix = _indexed(spark, t["documents"].select("doc_id", "text"), "postings", text="bm25")
    return rounded(ix.d.df().join(ix.bm25_scores("text", _WORDS), rows.ROW_ID).select("doc_id", "score"), "score")


@query("SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 30 AND p_brand = 'Brand#2' AND p_type IN ('ECONOMY', 'PROMO')")
def index_intersection(spark, t):
    """Row numbers from two indexes meet before a row is read; the rest is checked on what is left."""
    ix = _indexed(spark, t["part"], "parts", p_size="inverted", p_brand="exact_text")
    return ix.find(("p_size", "between", 10, 30), ("p_brand", "=", "Brand#2")).filter("p_type in ('ECONOMY', 'PROMO')").select("p_partkey")


@query("SELECT event_id FROM events WHERE CAST(props ->> 'k' AS BIGINT) = 69")
def index_json(spark, t):
    return _indexed(spark, t["events"].select("event_id", "props"), "events", props="json").json_equals("props", "k", 69).select("event_id")


@query("SELECT o_orderkey, o_totalprice FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 10.0 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_custkey % 11 <> 0 UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey % 11 = 0) WHERE o_totalprice < 5000")
def index_after_writes(spark, t):
    """Updated, deleted and inserted again: as many rows as before, and the index is not trusted until it is built again."""
    ix = _indexed(spark, t["orders"].select("o_orderkey", "o_custkey", "o_totalprice"), "orders", o_totalprice="inverted")
    ix.d.update("o_orderkey % 7 = 0", {"o_totalprice": 10.0})
    ix.d.delete("o_custkey % 11 = 0")
    ix.d.append(t["orders"].filter("o_custkey % 11 = 0").select("o_orderkey", "o_custkey", "o_totalprice"))
    ix.d.commit("changes")
    stale = ix.compare("o_totalprice", "<", 5000).filter("o_orderkey % 2 = 0").select("o_orderkey", "o_totalprice")
    ix.refresh()
    return stale.union(ix.compare("o_totalprice", "<", 5000).filter("o_orderkey % 2 <> 0").select("o_orderkey", "o_totalprice"))


@query(f"SELECT doc_id FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), {_HEX}))) AS w FROM documents) WHERE w = 'inenan'")
def text_inverted_index(spark, t):
    d = Dataset.create(spark, work_path(spark, "indexed"), t["documents"].select("doc_id", "text").schema)
    d.append(t["documents"].select("doc_id", "text"))
    d.commit("documents")
    Indexes(d).create("text", "inverted")
    return Indexes(d).contains("text", "Inenan").select("doc_id")


@query("SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 12 AND p_retailprice >= 950")
def numeric_index(spark, t):
    d = Dataset.create(spark, work_path(spark, "indexed"), t["part"].schema)
    d.append(t["part"])
    d.commit("parts")
    Indexes(d).create("p_size")
    return Indexes(d).compare("p_size", "between", 10, 12).filter("p_retailprice >= 950").select("p_partkey")


# JSON


@query("SELECT event_id FROM events WHERE (props ->> 'k') = '69'")
def json_containment(spark, t):
    return t["events"].filter(jsonfn.holds(F.col("props"), '{"k": 69}')).select("event_id")


@query("SELECT event_id, coalesce((props ->> 'k') = '7', false) AS same, false AS other FROM events")
def json_field_eq(spark, t):
    return t["events"].select("event_id", jsonfn.field_eq(F.col("props"), "k", "7").alias("same"), jsonfn.field_eq(F.col("props"), "absent", "7").alias("other"))


# user functions, prepared queries


@query(f"SELECT vec_id, round({_E}[1] * 2 + {_E}[2], 6) AS v FROM embeddings")
def udf_binary(spark, t):
    api.register_function(lambda a, b: a * 2 + b, name="twice_and")
    try:
        return rounded(api.query("SELECT vec_id, TWICE_AND(embedding[0]::float64, embedding[1]::float64) AS v FROM embeddings", spark, tables=t, order=ORDER), "v")
    finally:
        api.unregister_function("twice_and")


@query("SELECT b.k AS k, count(*) AS n FROM orders, (VALUES (1), (2), (3)) AS b(k) WHERE o_custkey % 5 = k GROUP BY b.k")
def prepared_batch(spark, t):
    """A prepared query run for three rows of values."""
    run = api.prepare_query("SELECT ? AS k, count(*) AS n FROM orders WHERE o_custkey % 5 = ?", spark=spark, tables=t, order=ORDER)
    parts = [df.select(F.col("k").cast("int").alias("k"), "n") for df in run.run_batch([[1, 1], [2, 2], [3, 3]])]
    return parts[0].union(parts[1]).union(parts[2])


# datasets and statements


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice, o_orderstatus FROM orders WHERE o_custkey % 10 <> 3 UNION ALL SELECT o_orderkey, o_custkey, o_totalprice, 'new' FROM orders WHERE o_orderkey < 50")
def dataset_update_delete(spark, t):
    orders = t["orders"].select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    d = Dataset.create(spark, work_path(spark, "orders"), orders.schema)
    d.append(orders)
    d.commit("orders")
    d.update("o_orderstatus = 'F'", {"o_totalprice": F.col("o_totalprice") * 2})
    d.delete("o_custkey % 10 = 3")
    d.append(orders.filter("o_orderkey < 50").withColumn("o_orderstatus", F.lit("new")))
    d.commit("changes")
    return d.df().drop(rows.ROW_ID)


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT n_regionkey + 100, n_name FROM nation")
def dataset_branch_merge(spark, t):
    d = Dataset.create(spark, work_path(spark, "regions"), "k int, name string")
    d.append(t["region"].select(F.col("r_regionkey").cast("int").alias("k"), F.col("r_name").alias("name")))
    d.commit("regions")
    b = d.create_branch("more")
    b.append(t["nation"].select((F.col("n_regionkey") + 100).cast("int").alias("k"), F.col("n_name").alias("name")))
    b.commit("nations")
    d.merge("more")
    d.commit("merged")
    return d.df().select(F.col("k").alias("r_regionkey"), F.col("name").alias("r_name"))


@query("SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT r_regionkey + 100, CASE WHEN r_regionkey = 1 THEN 'changed' ELSE r_name END FROM region WHERE r_regionkey <> 3")
def dataset_merge_after_deletes(spark, t):
    """The branch deletes old rows, which stay here, and changes and deletes some of those that it added."""
    d = Dataset.create(spark, work_path(spark, "nations"), "k long, name string")
    d.append(t["nation"].select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name")))
    d.commit("nations")
    b = d.create_branch("more")
    b.delete("k % 3 = 0")
    b.append(t["region"].select((F.col("r_regionkey") + 100).cast("long").alias("k"), F.col("r_name").alias("name")))
    b.update("k = 101", {"name": "changed"})
    b.delete("k = 103")
    b.commit("regions")
    d.merge("more")
    d.commit("merged")
    return d.df().drop(rows.ROW_ID)


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 10")
def dataset_time_travel(spark, t):
    nations = t["nation"].select("n_nationkey", "n_name")
    d = Dataset.create(spark, work_path(spark, "nations"), nations.schema)
    d.append(nations.filter("n_nationkey < 10"))
    d.commit("first")
    d.tag("ten")
    d.append(nations.filter("n_nationkey >= 10"))
    d.commit("all")
    return Dataset.open(spark, d.uri, version="ten").df().drop(rows.ROW_ID)


@query("SELECT n_nationkey AS id, n_name AS title, CASE WHEN n_nationkey < 10 THEN 0 ELSE n_regionkey END AS region FROM nation")
def dataset_schema_change(spark, t):
    """Columns added, renamed and dropped between two appends."""
    d = Dataset.create(spark, work_path(spark, "nations"), "id int, name string, gone int")
    n = t["nation"].select(F.col("n_nationkey").cast("int").alias("id"), F.col("n_name").alias("name"), F.lit(1).alias("gone"), F.col("n_regionkey").cast("int").alias("region"))
    d.append(n.filter("id < 10").drop("region"))
    d.commit("old")
    d.add_column("region", "int", 0)
    d.rename_column("name", "title")
    d.drop_column("gone")
    d.append(n.filter("id >= 10").select("id", F.col("name").alias("title"), "region"))
    d.commit("new")
    return d.df().drop(rows.ROW_ID)


@query("SELECT CAST(c_custkey AS BIGINT) AS id, CASE WHEN c_acctbal < 0 THEN 'owes' ELSE c_mktsegment END AS seg, c_acctbal AS bal FROM customer WHERE c_nationkey <> 3 UNION ALL SELECT -1, 'o''ne, two', 1.5")
def sql_statements(spark, t):
    """CREATE, INSERT, UPDATE, DELETE and a rolled back transaction."""
    t["customer"].createOrReplaceTempView("customer_rows")
    db = Database(spark, work_path(spark, "db"))
    db.execute("CREATE TABLE cust (id int8, seg varchar(20), bal float8, nation int4 DEFAULT 0) USING tensors")
    db.execute("INSERT INTO cust SELECT c_custkey, c_mktsegment, c_acctbal, c_nationkey FROM customer_rows")
    db.execute("INSERT INTO cust (id, seg, bal) VALUES (-1, 'o''ne, two', 1.5)")
    db.execute("UPDATE cust SET seg = 'owes' WHERE bal < 0")
    db.execute("DELETE FROM cust WHERE nation = 3")
    db.execute("BEGIN")
    db.execute("TRUNCATE cust")
    db.execute("ROLLBACK")
    return db.execute("SELECT id, seg, bal FROM cust")


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY o_orderstatus")
def sql_create_table_as(spark, t):
    t["orders"].createOrReplaceTempView("orders_rows")
    db = Database(spark, work_path(spark, "db"))
    db.execute("CREATE TABLE totals USING tensors AS SELECT o_orderstatus AS status, count(*) AS n FROM orders_rows GROUP BY o_orderstatus")
    return db.execute("SELECT status, n FROM totals")


@query("SELECT c AS column_name, round(nulls, 6) AS null_frac, round(CASE WHEN d > 0.1 * n THEN -d / n ELSE d END, 6) AS n_distinct FROM (SELECT 'o_custkey' AS c, 0.0 AS nulls, CAST(count(DISTINCT o_custkey) AS DOUBLE) AS d, count(*) AS n FROM orders UNION ALL SELECT 'o_orderstatus', 0.0, count(DISTINCT o_orderstatus), count(*) FROM orders UNION ALL SELECT 'o_orderkey', 0.0, count(DISTINCT o_orderkey), count(*) FROM orders)")
def column_statistics(spark, t):
    s = stats.column_stats(t["orders"], ["o_custkey", "o_orderstatus", "o_orderkey"])
    return rounded(s.select(F.col("column").alias("column_name"), "null_frac", "n_distinct"), "null_frac", "n_distinct")


@query("SELECT p_type AS value, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, value LIMIT 3")
def most_common_values(spark, t):
    return stats.most_common(t["part"], "p_type", 3)


# streams, an extension


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_tumbling(spark, t):
    return rounded(streams.tumbling(t["events"], "ts", "1 hour", ["event_type"]), "total", digits=4)


_SESSIONS = "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '2 hours' THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS started, max(ts) + INTERVAL '2 hours' AS ended, count(*) AS n FROM s GROUP BY user_id, k"


@query(_SESSIONS)
def event_sessions(spark, t):
    return streams.sessions(t["events"], "ts", "2 hours", "user_id")


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_stream(spark, t):
    """The same windows as a stream: events arrive from a folder until none are left, the last state is kept."""
    source, out = work_path(spark, "arriving"), work_path(spark, "windows")
    t["events"].repartition(4).write.parquet(source)
    e = streams.read_stream(spark, source, t["events"].schema, per_trigger=1)
    write = lambda df, _: df.write.mode("overwrite").parquet(out)
    streams.tumbling(e, "ts", "1 day", []).writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", work_path(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return rounded(spark.read.parquet(out), "total", digits=4)
