"""Queries of the tensor query language, each with SQL of the same meaning for DuckDB.

Array results leave as texts: their elements in thousandths, rounded and comma-joined, by ``joined`` here and ``_J`` in SQL.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .. import api
from ..session import TABLES

#: The columns that give each table's rows their order.
ORDER = {"region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], "events": ["event_id"], "documents": ["doc_id"], "embeddings": ["vec_id"], "pages": ["page_id"], "benchmark": ["item_id"], "labels": ["doc_id"], "conversations": ["conv_id", "turn"]}


class Folder(Mapping):
    """The tables of a folder, read when asked for."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.read = spark, path, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise KeyError(name)
        if name not in self.read:
            self.read[name] = self.spark.read.parquet(f"{self.path}/{name}.parquet")
        return self.read[name]

    def __iter__(self) -> Iterator[str]:
        return iter(TABLES)

    def __len__(self) -> int:
        return len(TABLES)

    def __contains__(self, name: object) -> bool:
        return name in TABLES


def joined(c: Column, kind: ArrayType) -> Column:
    """An array as a text; one of arrays with its rows parted by semicolons."""
    if isinstance(kind.elementType, ArrayType):
        return F.array_join(F.transform(c, lambda r: joined(r, kind.elementType)), ";")
    if isinstance(kind.elementType, StringType):
        return F.array_join(c, ",", "null")
    return F.array_join(F.transform(c, lambda v: F.round(v.cast("double") * 1000).cast("bigint").cast("string")), ",", "null")


def flattened(df: DataFrame) -> DataFrame:
    """Array columns as texts."""
    return df.select(*(joined(F.col(f"`{f.name}`"), f.dataType).alias(f.name) if isinstance(f.dataType, ArrayType) else F.col(f"`{f.name}`") for f in df.schema))


def tql(text: str, **where) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return flattened(api.query(text.replace("{dir}", sf_dir), spark, tables=Folder(spark, sf_dir), order=ORDER, **where))

    return run


_Q = [round(math.sin(i + 1), 3) for i in range(64)]
_QT = f"ARRAY[{', '.join(map(str, _Q))}]"
_E = "CAST(embedding AS DOUBLE[])"
_QS = f"CAST([{', '.join(map(str, _Q))}] AS DOUBLE[])"
_DOT = f"list_sum(list_transform(range(1, 65), lambda i: {_E}[i] * {_QS}[i]))"
_LEN = f"sqrt(list_sum(list_transform({_E}, lambda x: x * x)))"
_COS = f"{_DOT} / ({_LEN} * sqrt(list_sum(list_transform({_QS}, lambda x: x * x))))"
_HEX = r"'[\p{L}\p{N}-]+'"
#: Rows of four for the matrix functions: the first 16 numbers of the query vector.
_M = [_Q[i : i + 4] for i in (0, 4, 8)]
_MT = "ARRAY[" + ", ".join(f"ARRAY[{', '.join(map(str, r))}]" for r in _M) + "]"


def _j(x: str) -> str:
    return f"array_to_string(list_transform({x}, lambda v: coalesce(CAST(CAST(round(CAST(v AS DOUBLE) * 1000) AS BIGINT) AS VARCHAR), 'null')), ',')"


def bm25_sql(query: str) -> str:
    """(doc_id, score) of documents that hold a word of ``query``."""
    terms = " UNION ALL ".join(f"SELECT '{t}' AS term" for t in query.lower().split())
    return f"""
WITH toks AS (SELECT doc_id, regexp_extract_all(lower(text), {_HEX}) AS w FROM documents),
stats AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM toks),
asked AS (SELECT term, count(*) AS qtf FROM ({terms}) GROUP BY term),
tf AS (SELECT doc_id, len(w) AS dl, term, qtf, len(list_filter(w, lambda x: x = term)) AS tf FROM toks, asked),
df AS (SELECT term, count(*) AS df FROM tf WHERE tf > 0 GROUP BY term)
SELECT doc_id, sum(qtf * ln((n - df + 0.5) / (df + 0.5)) * 2.5 * tf / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
FROM tf JOIN df USING (term), stats WHERE tf > 0 GROUP BY doc_id"""


_WORDS = "ringing thion inenan"

#: name: (query, SQL)
TQL: dict[str, tuple[str, str]] = {
    # sources, projection
    "tql_scan_path": ('SELECT n_name, n_nationkey FROM "{dir}/nation.parquet" WHERE n_regionkey = 2', "SELECT n_name, n_nationkey FROM nation WHERE n_regionkey = 2"),
    "tql_scan_mem": ('SELECT r_name FROM "mem://region"', "SELECT r_name FROM region"),
    "tql_star": ("SELECT * FROM supplier WHERE s_acctbal > 0", "SELECT * FROM supplier WHERE s_acctbal > 0"),
    "tql_qualified_star": ("SELECT n.*, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey", "SELECT n.*, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey"),
    "tql_virtual_column": ("SELECT o_orderkey, o_totalprice * 0.5 AS half FROM orders ORDER BY half DESC, o_orderkey LIMIT 20", "SELECT o_orderkey, o_totalprice * 0.5 AS half FROM orders ORDER BY half DESC, o_orderkey LIMIT 20"),
    "tql_distinct": ("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem"),
    "distinct_on": ("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1"),
    "row_number_offset": ("SELECT o_orderkey, ROW_NUMBER() AS rn FROM orders", "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS rn FROM orders"),
    "tql_top": ("SELECT TOP 5 p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey", "SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 5"),
    "tql_cast": ("SELECT o_orderkey, CAST(o_totalprice AS float64) / 2 AS half, o_custkey::text AS t FROM orders", "SELECT o_orderkey, o_totalprice / 2 AS half, CAST(o_custkey AS VARCHAR) AS t FROM orders"),
    # predicates
    "tql_comparisons": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 49 AND l_discount < 0.03 OR NOT l_quantity != 1 AND l_tax <= 0.01", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity >= 49 AND l_discount < 0.03) OR (l_quantity = 1 AND l_tax <= 0.01)"),
    "tql_between": ("SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 100000 AND 101000", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 100000 AND 101000"),
    "tql_in_list": ("SELECT p_partkey FROM part WHERE p_size IN (1, 7, 49) AND p_type NOT IN ('PROMO', 'SMALL')", "SELECT p_partkey FROM part WHERE p_size IN (1, 7, 49) AND p_type NOT IN ('PROMO', 'SMALL')"),
    "tql_in_subquery": ("SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)"),
    "tql_not_in_subquery": ("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)"),
    "tql_exists": ("SELECT r_name FROM region WHERE EXISTS (SELECT n_name FROM nation WHERE n_nationkey > 20)", "SELECT r_name FROM region WHERE EXISTS (SELECT n_name FROM nation WHERE n_nationkey > 20)"),
    "tql_is_null": ("SELECT c_custkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderkey IS NULL", "SELECT c_custkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderkey IS NULL"),
    "tql_is_not_null": ("SELECT count(*) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderkey IS NOT NULL", "SELECT count(*) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderkey IS NOT NULL"),
    "tql_like_glob": ("SELECT p_partkey FROM part WHERE p_name LIKE '*ring' AND p_brand LIKE 'Brand#?'", "SELECT p_partkey FROM part WHERE p_name GLOB '*ring' AND p_brand GLOB 'Brand#?'"),
    "tql_not_like": ("SELECT p_partkey FROM part WHERE p_name NOT LIKE '*e*'", "SELECT p_partkey FROM part WHERE NOT p_name GLOB '*e*'"),
    "tql_ilike": ("SELECT p_partkey FROM part WHERE p_name ILIKE 'RED*'", "SELECT p_partkey FROM part WHERE lower(p_name) GLOB 'red*'"),
    "tql_contains": ("SELECT doc_id FROM documents WHERE CONTAINS(text, 'ringing')", "SELECT doc_id FROM documents WHERE contains(text, 'ringing')"),
    "tql_equals": ("SELECT p_partkey FROM part WHERE EQUALS(p_type, 'PROMO')", "SELECT p_partkey FROM part WHERE p_type = 'PROMO'"),
    "tql_any_all": ("SELECT vec_id, ANY(embedding > 0.3) AS some, ALL(embedding < 0.35) AS every, ALL_STRICT(embedding[0:0] > 0) AS none FROM embeddings", f"SELECT vec_id, list_max({_E}) > 0.3 AS some, list_max({_E}) < 0.35 AS every, false AS none FROM embeddings"),
    "tql_any_filter": ("SELECT vec_id FROM embeddings WHERE ANY(embedding > 0.3)", f"SELECT vec_id FROM embeddings WHERE list_max({_E}) > 0.3"),
    "tql_logical": ("SELECT vec_id, SUM(LOGICAL_AND(embedding > 0, embedding < 0.1)::int) AS n, SUM(LOGICAL_NOT(embedding > 0)::int) AS m, SUM(LOGICAL_OR(embedding > 0.2, embedding < -0.2)::int) AS o FROM embeddings", f"SELECT vec_id, CAST(len(list_filter({_E}, lambda x: x > 0 AND x < 0.1)) AS DOUBLE) AS n, CAST(len(list_filter({_E}, lambda x: NOT x > 0)) AS DOUBLE) AS m, CAST(len(list_filter({_E}, lambda x: x > 0.2 OR x < -0.2)) AS DOUBLE) AS o FROM embeddings"),
    "tql_isclose": ("SELECT vec_id FROM embeddings WHERE ISCLOSE(embedding[0], embedding[0] + label * 0.00001)", "SELECT vec_id FROM embeddings WHERE label * 0.00001 <= 0.00000001 + 0.00001 * abs(embedding[1] + label * 0.00001)"),
    # joins
    "tql_join_inner": ("SELECT n.n_name, r.r_name FROM nation AS n INNER JOIN region AS r ON n.n_regionkey = r.r_regionkey", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "tql_join_left": ("SELECT d.doc_id, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id", "SELECT d.doc_id, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"),
    "tql_join_right": ("SELECT l.doc_id, d.item_id FROM benchmark d RIGHT JOIN labels l ON d.item_id = l.doc_id", "SELECT l.doc_id, d.item_id FROM benchmark d RIGHT JOIN labels l ON d.item_id = l.doc_id"),
    "tql_join_full": ("SELECT a.item_id, b.doc_id FROM benchmark a FULL OUTER JOIN labels b ON a.item_id = b.doc_id", "SELECT a.item_id, b.doc_id FROM benchmark a FULL OUTER JOIN labels b ON a.item_id = b.doc_id"),
    "tql_join_using": ("SELECT doc_id, lang, toxic FROM documents JOIN labels USING (doc_id)", "SELECT doc_id, lang, toxic FROM documents JOIN labels USING (doc_id)"),
    "tql_join_natural": ("SELECT doc_id, toxic FROM labels NATURAL JOIN (SELECT doc_id, lang FROM documents WHERE lang = 'en') d", "SELECT doc_id, toxic FROM labels JOIN documents USING (doc_id) WHERE lang = 'en'"),
    "tql_join_cross": ("SELECT a.r_name AS x, b.r_name AS y FROM region a CROSS JOIN region b", "SELECT a.r_name AS x, b.r_name AS y FROM region a CROSS JOIN region b"),
    "tql_join_comma": ("SELECT s_name, n_name FROM supplier, nation WHERE s_nationkey = n_nationkey", "SELECT s_name, n_name FROM supplier, nation WHERE s_nationkey = n_nationkey"),
    "tql_join_multiway": ("SELECT r_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name", "SELECT r_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"),
    "tql_join_paths": ('SELECT a.vec_id, b.lang FROM "{dir}/embeddings.parquet" a JOIN "{dir}/documents.parquet" b ON a.vec_id = b.doc_id', "SELECT vec_id, lang FROM embeddings JOIN documents ON vec_id = doc_id"),
    # groups
    "group_to_sequence": ("SELECT conv_id, role FROM conversations GROUP BY conv_id", "SELECT array_to_string(list(conv_id * 1000 ORDER BY turn), ',') AS conv_id, array_to_string(list(role ORDER BY turn), ',') AS role FROM conversations GROUP BY conversations.conv_id"),
    "group_across_space": ("SELECT label, embedding[0:2] AS e FROM embeddings GROUP BY label ACROSS SPACE", f"SELECT array_to_string(list(label * 1000 ORDER BY vec_id), ',') AS label, {_j(f'flatten(list({_E}[1:2] ORDER BY vec_id))')} AS e FROM embeddings GROUP BY embeddings.label"),
    "group_array_aggregates": ("SELECT label, AVG(embedding) AS mean, MAX(embedding) AS hi, count(*) AS n FROM embeddings GROUP BY label HAVING count(*) > 45", f"SELECT label, avg(x) AS mean, max(x) AS hi, count(DISTINCT vec_id) AS n FROM (SELECT vec_id, label, unnest({_E}) AS x FROM embeddings) GROUP BY label HAVING count(DISTINCT vec_id) > 45"),
    "group_having": ("SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey HAVING count(*) > 14", "SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey HAVING count(*) > 14"),
    "tql_aggregates": ("SELECT count(*) AS n, count(DISTINCT o_custkey) AS c, min(o_totalprice) AS lo, max(o_totalprice) AS hi, avg(o_totalprice) AS mean, stddev(o_totalprice) AS sd FROM orders", "SELECT count(*) AS n, count(DISTINCT o_custkey) AS c, min(o_totalprice) AS lo, max(o_totalprice) AS hi, avg(o_totalprice) AS mean, stddev(o_totalprice) AS sd FROM orders"),
    "ungroup_split": ("SELECT vec_id, embedding FROM embeddings UNGROUP BY SPLIT", "SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS embedding FROM embeddings"),
    "ungroup_ranges": ("SELECT vec_id, embedding FROM embeddings UNGROUP BY 5", f"SELECT vec_id, {_j(f'{_E}[a:z]')} AS embedding FROM embeddings, (VALUES (1, 13), (14, 26), (27, 39), (40, 52), (53, 64)) AS t(a, z)"),
    "ungroup_lengths": ("SELECT vec_id, embedding FROM embeddings UNGROUP BY ARRAY[3, 0, 7]", f"SELECT vec_id, {_j(f'{_E}[a:z]')} AS embedding FROM embeddings, (VALUES (1, 3), (4, 3), (4, 10)) AS t(a, z)"),
    # reducers within a cell
    "arr_reduce": ("SELECT vec_id, SUM(embedding) AS s, AVG(embedding) AS m, AMIN(embedding) AS lo, AMAX(embedding) AS hi, PROD(embedding[0:2]) AS p, STD(embedding) AS sd, MEDIAN(embedding) AS med FROM embeddings", f"SELECT vec_id, list_sum({_E}) AS s, list_avg({_E}) AS m, list_min({_E}) AS lo, list_max({_E}) AS hi, {_E}[1] * {_E}[2] AS p, list_stddev_pop({_E}) AS sd, list_median({_E}) AS med FROM embeddings"),
    "arr_reduce_axis": ("SELECT vec_id, AVG(ARRAY[embedding[0:32], embedding[32:64]], axis=0) AS down, SUM(ARRAY[embedding[0:32], embedding[32:64]], axis=1) AS rowwise FROM embeddings", f"SELECT vec_id, {_j(f'list_transform(range(1, 33), lambda i: ({_E}[i] + {_E}[i + 32]) / 2)')} AS down, {_j(f'[list_sum({_E}[1:32]), list_sum({_E}[33:64])]')} AS rowwise FROM embeddings"),
    # frames
    "expand_overlap": ("SELECT o_orderkey, o_totalprice FROM orders EXPAND BY 2 1", f"SELECT o_orderkey, {_j('list(o_totalprice) OVER (ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)')} AS o_totalprice FROM orders"),
    "expand_tiles": ("SELECT o_orderkey, o_totalprice FROM orders EXPAND BY 2 1 OVERLAP FALSE", f"SELECT {_j('list(o_orderkey ORDER BY o_orderkey)')} AS o_orderkey, {_j('list(o_totalprice ORDER BY o_orderkey)')} AS o_totalprice FROM (SELECT o_orderkey, o_totalprice, (row_number() OVER (ORDER BY o_orderkey) - 1) // 4 AS g FROM orders) GROUP BY g"),
    # order, limits
    "tql_order": ("SELECT c_custkey, c_mktsegment FROM customer ORDER BY c_mktsegment DESC, c_acctbal ASC, c_custkey LIMIT 30 OFFSET 5", "SELECT c_custkey, c_mktsegment FROM customer ORDER BY c_mktsegment DESC, c_acctbal, c_custkey LIMIT 30 OFFSET 5"),
    "tql_limit_subquery": ("SELECT p_partkey FROM part ORDER BY p_partkey LIMIT (SELECT count(*) FROM nation)", "SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 25"),
    "max_weight": ("SELECT o_orderkey, MAX_WEIGHT(o_orderstatus = 'F': 5, o_totalprice > 100000: 2, true: 1) AS w, SUM_WEIGHT(o_orderstatus = 'F': 5, o_totalprice > 100000: 2) AS s FROM orders", "SELECT o_orderkey, greatest(CASE WHEN o_orderstatus = 'F' THEN 5.0 ELSE 0 END, CASE WHEN o_totalprice > 100000 THEN 2.0 ELSE 0 END, 1.0)::DOUBLE AS w, (CASE WHEN o_orderstatus = 'F' THEN 5.0 ELSE 0 END + CASE WHEN o_totalprice > 100000 THEN 2.0 ELSE 0 END)::DOUBLE AS s FROM orders"),
    # sets and subqueries
    "tql_union": ("SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey AS k FROM region ORDER BY k LIMIT 4", "SELECT k FROM (SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region) ORDER BY k LIMIT 4"),
    "tql_union_all": ("SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey AS k FROM region", "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region"),
    "tql_intersect": ("(SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 49) INTERSECT (SELECT l_partkey AS k FROM lineitem WHERE l_discount > 0.09)", "SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 49 INTERSECT SELECT l_partkey FROM lineitem WHERE l_discount > 0.09"),
    "tql_intersect_all": ("(SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 45) INTERSECT ALL (SELECT l_partkey AS k FROM lineitem WHERE l_discount > 0.09)", "SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 45 INTERSECT ALL SELECT l_partkey FROM lineitem WHERE l_discount > 0.09"),
    "tql_except": ("SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 40", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 40"),
    "tql_except_all": ("SELECT l_partkey AS k FROM lineitem EXCEPT ALL SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 10", "SELECT l_partkey AS k FROM lineitem EXCEPT ALL SELECT l_partkey FROM lineitem WHERE l_quantity > 10"),
    "tql_subquery": ("SELECT lang, max(n) AS longest FROM (SELECT lang, length(text) AS n FROM documents) t GROUP BY lang", "SELECT lang, max(length(text)) AS longest FROM documents GROUP BY lang"),
    "tql_cte": ("WITH busy AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT c_name, n FROM customer JOIN busy ON c_custkey = o_custkey WHERE n > 12", "SELECT c_name, n FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey WHERE n > 12"),
    "tql_scalar_subquery": ("SELECT p_partkey FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)", "SELECT p_partkey FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)"),
    # vectors
    "vec_cosine_topk": (f"SELECT vec_id, ROUND(COSINE_SIMILARITY(embedding, {_QT}), 6) AS score FROM embeddings ORDER BY COSINE_SIMILARITY(embedding, {_QT}) DESC LIMIT 10", f"SELECT vec_id, round({_COS}, 6) AS score FROM embeddings ORDER BY score DESC LIMIT 10"),
    "vec_filtered_topk": (f"SELECT vec_id, label, ROUND(COSINE_SIMILARITY(embedding, {_QT}), 6) AS score FROM embeddings WHERE label IN (1, 3, 5) ORDER BY score DESC, vec_id LIMIT 10", f"SELECT vec_id, label, round({_COS}, 6) AS score FROM embeddings WHERE label IN (1, 3, 5) ORDER BY score DESC, vec_id LIMIT 10"),
    "vec_cosine_all": (f"SELECT vec_id, COSINE_SIMILARITY(embedding, {_QT}) AS score FROM embeddings", f"SELECT vec_id, {_COS} AS score FROM embeddings"),
    "vec_norms": ("SELECT vec_id, L1_NORM(embedding) AS l1, L2_NORM(embedding) AS l2, LINF_NORM(embedding) AS linf FROM embeddings", f"SELECT vec_id, list_sum(list_transform({_E}, lambda x: abs(x))) AS l1, {_LEN} AS l2, list_max(list_transform({_E}, lambda x: abs(x))) AS linf FROM embeddings"),
    "vec_dot": (f"SELECT vec_id, DOT(embedding, {_QT}) AS d, INNER_PRODUCT(embedding, embedding) AS own FROM embeddings", f"SELECT vec_id, {_DOT} AS d, list_sum(list_transform({_E}, lambda x: x * x)) AS own FROM embeddings"),
    "vec_hamming": ("SELECT vec_id, HAMMING_DISTANCE(embedding > 0, embedding > 0.05) AS d FROM embeddings", f"SELECT vec_id, len(list_filter({_E}, lambda x: x > 0 AND x <= 0.05)) AS d FROM embeddings"),
    "vec_maxsim": (f"SELECT vec_id, MAXSIM(ARRAY[{', '.join(f'embedding[{a}:{a + 4}]' for a in range(0, 64, 4))}], {_MT}) AS score FROM embeddings", "SELECT vec_id, " + " + ".join(f"greatest({', '.join(f'list_cosine_similarity({_E}[{a}:{a + 3}], CAST({r} AS DOUBLE[]))' for a in range(1, 65, 4))})" for r in _M) + " AS score FROM embeddings"),
    # arrays
    "arr_index": ("SELECT vec_id, embedding[0] AS a, embedding[-1] AS z, embedding[label] AS nth FROM embeddings", "SELECT vec_id, embedding[1] AS a, embedding[64] AS z, embedding[label + 1] AS nth FROM embeddings"),
    "arr_slice": ("SELECT vec_id, embedding[2:6] AS mid, embedding[:3] AS head, embedding[-2:] AS tail, embedding[::16] AS each, ARRAY[embedding[0:2], embedding[2:4]][:, 0] AS first FROM embeddings", f"SELECT vec_id, {_j(f'{_E}[3:6]')} AS mid, {_j(f'{_E}[1:3]')} AS head, {_j(f'{_E}[63:64]')} AS tail, {_j(f'[{_E}[1], {_E}[17], {_E}[33], {_E}[49]]')} AS each, {_j(f'[{_E}[1], {_E}[3]]')} AS first FROM embeddings"),
    "arr_shape": ("SELECT vec_id, SHAPE(embedding) AS s, SHAPE(ARRAY[embedding[0:2], embedding[2:4]]) AS m FROM embeddings", "SELECT vec_id, '64000' AS s, '2000,2000' AS m FROM embeddings"),
    "arr_data": ("SELECT vec_id, DOT(embedding, DATA(embedding, 3)) AS d FROM embeddings", f"SELECT vec_id, (SELECT list_sum(list_transform(range(1, 65), lambda i: {_E}[i] * q.e[i])) FROM (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings ORDER BY vec_id LIMIT 1 OFFSET 3) q) AS d FROM embeddings"),
    "arr_nonzero": ("SELECT vec_id, NONZERO((embedding > 0.1)::int) AS at FROM embeddings", f"SELECT vec_id, array_to_string(list_transform(list_filter(range(0, 64), lambda i: {_E}[i + 1] > 0.1), lambda i: i * 1000), ',') AS at FROM embeddings"),
    "arr_elementwise": ("SELECT vec_id, embedding[0:3] + embedding[3:6] AS a, embedding[0:3] * 2 - 1 AS s, -embedding[0:2] / 4 AS n, ABS(embedding[0:3]) AS b, SQRT(ABS(embedding[0:3])) AS q FROM embeddings", f"SELECT vec_id, {_j(f'[{_E}[1] + {_E}[4], {_E}[2] + {_E}[5], {_E}[3] + {_E}[6]]')} AS a, {_j(f'list_transform({_E}[1:3], lambda x: x * 2 - 1)')} AS s, {_j(f'list_transform({_E}[1:2], lambda x: -x / 4)')} AS n, {_j(f'list_transform({_E}[1:3], lambda x: abs(x))')} AS b, {_j(f'list_transform({_E}[1:3], lambda x: sqrt(abs(x)))')} AS q FROM embeddings"),
    "arr_rearrange": ("SELECT vec_id, FLAT(ARRAY[embedding[0:32], embedding[32:64]]) AS f, TRANSPOSE(ARRAY[embedding[0:32], embedding[32:64]]) AS t, ARANGE(0, label) AS r FROM embeddings", f"SELECT vec_id, {_j(_E)} AS f, {" || ';' || ".join(_j(f'[{_E}[{i}], {_E}[{i + 32}]]') for i in range(1, 33))} AS t, array_to_string(list_transform(range(0, label), lambda i: i * 1000), ',') AS r FROM embeddings"),
    # JSON
    "json_path": ("SELECT event_id, CAST(props['k'] AS int64) AS k FROM events WHERE props['k'] = '69'", "SELECT event_id, CAST(props ->> 'k' AS BIGINT) AS k FROM events WHERE (props ->> 'k') = '69'"),
    "json_missing": ("SELECT event_id, props['nothing'] AS v, KEYS(props) AS ks FROM events", "SELECT event_id, props ->> 'nothing' AS v, array_to_string(json_keys(props), ',') AS ks FROM events"),
    # text search
    "tql_limit_percent": ("SELECT p_partkey, p_size FROM part LIMIT 100 PERCENT", "SELECT p_partkey, p_size FROM part"),
    "bm25_topk": (f"SELECT doc_id, ROUND(BM25_SIMILARITY(text, '{_WORDS}'), 6) AS score FROM documents ORDER BY BM25_SIMILARITY(text, '{_WORDS}') DESC LIMIT 10", f"SELECT doc_id, round(score, 6) AS score FROM ({bm25_sql(_WORDS)}) ORDER BY score DESC LIMIT 10"),
    # scalars
    "tql_scalars": ("SELECT p_partkey, p_name || '!' AS s, LPAD(p_type, 9, '.') AS l, SUBSTRING(p_name, 1, 3) AS sub, p_size % 7 AS r, p_size ^ 2 AS sq, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS c FROM part", "SELECT p_partkey, p_name || '!' AS s, lpad(p_type, 9, '.') AS l, substring(p_name, 1, 3) AS sub, p_size % 7 AS r, CAST(p_size * p_size AS DOUBLE) AS sq, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS c FROM part"),
    "tql_dates": ("SELECT o_orderkey, EXTRACT(year FROM o_orderdate)::int8 AS y FROM orders WHERE o_orderdate >= DATE '2001-01-01' AND o_orderdate < DATE '2001-01-01' + INTERVAL '3' month", "SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y FROM orders WHERE o_orderdate >= DATE '2001-01-01' AND o_orderdate < DATE '2001-04-01'"),
}

#: Columns of doubles that are rounded to six digits on both sides, as sums depend on the order of rows.
ROUNDED = {"group_array_aggregates": "mean hi", "group_having": "total", "tql_aggregates": "mean sd", "ungroup_split": "embedding", "arr_reduce": "s m lo hi p sd med", "vec_cosine_all": "score", "vec_norms": "l1 l2 linf", "vec_dot": "d own", "vec_maxsim": "score", "arr_index": "a z nth", "arr_data": "d"}


def _rounded(name: str, f: Callable) -> Callable:
    cols = ROUNDED.get(name, "").split()
    return (lambda spark, sf_dir: f(spark, sf_dir).withColumns({c: F.round(F.col(c).cast("double"), 6) for c in cols})) if cols else f


QUERIES = {name: _rounded(name, tql(text)) for name, (text, _) in TQL.items()}
ORACLE = {name: f"SELECT * REPLACE ({', '.join(f'round(CAST({c} AS DOUBLE), 6) AS {c}' for c in ROUNDED[name].split())}) FROM ({sql})" if name in ROUNDED else sql for name, (_, sql) in TQL.items()}
