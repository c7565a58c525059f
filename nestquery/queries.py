"""A query for each operator and function of the dialect over the test tables, and the same in DuckDB's SQL."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nestquery import sinks
from nestquery.engine import Engine, prepare
from nestquery.errors import NestQueryError
from nestquery.plans.compiler import ROOT
from nestquery.settings import DuplicateKeys, JsonLimits, Limits, Settings
from nestquery.sources import from_json, from_json_column, parse_json

Query = Callable[[SparkSession, str], DataFrame]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@dataclass(frozen=True)
class Case:
    sql: str
    #: None: SQL cannot express it.
    oracle: str | None
    #: What ``$r`` is.
    root: Callable[[Callable[[str], DataFrame]], DataFrame] | None = None
    named: Mapping[str, Callable[[Callable[[str], DataFrame]], DataFrame]] | None = None
    params: Any = None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
        engine = Engine(spark)
        for name in TABLES:
            if f" {name}" in self.sql:
                engine.register(name, table(name))
        for name, make in (self.named or {}).items():
            engine.register(name, make(table))
        if self.root is not None:
            engine.root(self.root(table))
        return engine.query(self.sql, self.params)


def _words(table: Callable[[str], DataFrame]) -> DataFrame:
    return table("part").select("p_partkey", F.split("p_name", " ").alias("words"), F.array("p_brand").alias("brand"))


def _nested(table: Callable[[str], DataFrame]) -> DataFrame:
    return table("customer").select(F.col("c_custkey").alias("id"), F.struct(F.col("c_name").alias("name"), F.struct(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")).alias("place")).alias("person"))


def _props(table: Callable[[str], DataFrame]) -> DataFrame:
    return table("events").select("event_id", F.from_json("props", "k BIGINT").alias("props"))


def _gaps(table: Callable[[str], DataFrame]) -> DataFrame:
    """Customers with NULLs."""
    return table("customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("seg"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("bal"))


_W = "string_split(p_name, ' ')"
_GAPS = "(SELECT c_custkey, NULLIF(c_mktsegment, 'BUILDING') AS seg, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS bal FROM customer)"

CASES: dict[str, Case] = {}


def _mixed(table: Callable[[str], DataFrame]) -> DataFrame:
    """Orders with an array of a number, a string and a boolean."""
    items = F.pmod("o_orderkey", F.lit(10)), F.col("o_orderstatus"), F.col("o_totalprice") > 150000
    return table("orders").select("o_orderkey", F.array(*[i.cast("variant") for i in items]).alias("tags"))


def _add(name: str, sql: str, oracle: str | None, **more: Any) -> None:
    CASES[name] = Case(sql, oracle, **more)


def _same(name: str, sql: str, **more: Any) -> None:
    """The dialect's text is SQL as it is."""
    _add(name, sql, sql, **more)


# scans and projection
_add("scan_root", "SELECT r_regionkey, r_name FROM $r", "SELECT r_regionkey, r_name FROM region", root=lambda t: t("region"))
_same("scan_named", "SELECT n.n_nationkey AS k, n_name AS n FROM nation n")
_add("scan_nested_path", "SELECT k, COUNT(*) AS n FROM $r.all.props GROUP BY k", "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1", root=lambda t: _props(t).groupBy("event_id").agg(F.struct(F.collect_list("props").alias("props")).alias("all")))
_add("scan_json_text", "SELECT event_id, props.k AS k FROM $r WHERE props.k > 50", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 50", root=_props)
_add("scan_json_column", "SELECT k, COUNT(*) AS n FROM $r WHERE k > 10 GROUP BY k", "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 10 GROUP BY 1", root=lambda t: from_json_column(t("events"), "props"))
_add("scan_bare_name", "SELECT k FROM props WHERE k > 90", "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 90", root=_props)
_same("subquery_from", "SELECT seg, n FROM (SELECT c_mktsegment AS seg, COUNT(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY c_mktsegment) WHERE n > 1")
_same("select_star", "SELECT * FROM nation")
_same("select_columns", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
_add("select_nested", "SELECT id, person.place AS place, person.name AS name FROM $r", "SELECT c_custkey AS id, {'nation': c_nationkey, 'segment': c_mktsegment} AS place, c_name AS name FROM customer", root=_nested)
_same("select_alias", "SELECT s_suppkey AS k, s_name AS label FROM supplier")
_add("select_dotted_alias", "SELECT c_custkey AS id, c_name AS who.name, c_acctbal AS who.money FROM customer", "SELECT c_custkey AS id, {'name': c_name, 'money': c_acctbal} AS who FROM customer")
_same("select_unaliased", "SELECT n_name, n_regionkey FROM nation")
_add("select_literal", "SELECT r_name AS r, 7 AS n, 1.5 AS d, 'it''s' AS s, TRUE AS b FROM region", "SELECT r_name AS r, 7::BIGINT AS n, 1.5::DOUBLE AS d, 'it''s' AS s, TRUE AS b FROM region")
_add("select_computed", "SELECT p_partkey AS k, CONCAT(UPPER(p_brand), '/', CAST(p_size AS STRING)) AS label FROM part", "SELECT p_partkey AS k, upper(p_brand) || '/' || p_size AS label FROM part")
_add("select_missing", "SELECT r_name AS r, nothing.here AS n FROM region WHERE nothing IS NULL", "SELECT r_name AS r, NULL AS n FROM region")
_same("case_simple", "SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS s FROM orders")
_same("case_searched", "SELECT c_custkey AS k, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'some' ELSE 'much' END AS band FROM customer")
_same("case_over_agg", "SELECT c_mktsegment AS seg, CASE WHEN COUNT(*) > 100 THEN 'large' ELSE 'small' END AS size FROM customer GROUP BY c_mktsegment")
_VALUE = "CASE WHEN o_orderstatus = 'F' THEN o_orderkey ELSE o_orderstatus END"
_add("case_mixed", f"SELECT k, CAST(v AS STRING) AS s FROM (SELECT o_orderkey AS k, {_VALUE} AS v FROM orders) WHERE v > 100", "SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN o_orderkey::VARCHAR ELSE o_orderstatus END AS s FROM orders WHERE o_orderstatus <> 'F' OR o_orderkey > 100")
_add("coalesce_mixed", "SELECT k, CAST(v AS STRING) AS s FROM (SELECT o_orderkey AS k, COALESCE(NULLIF(o_orderstatus, 'F'), o_orderkey) AS v FROM orders) WHERE v = 'O' OR v < 100", "SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN o_orderkey::VARCHAR ELSE o_orderstatus END AS s FROM orders WHERE o_orderstatus = 'O' OR (o_orderstatus = 'F' AND o_orderkey < 100)")
_add("distinct_mixed", f"SELECT CAST(v AS STRING) AS s FROM (SELECT DISTINCT {_VALUE.replace('THEN o_orderkey', 'THEN LENGTH(o_orderpriority)')} AS v FROM orders)", "SELECT DISTINCT CASE WHEN o_orderstatus = 'F' THEN length(o_orderpriority)::VARCHAR ELSE o_orderstatus END AS s FROM orders")
# predicates
for _n, _op in (("eq", "="), ("gt", ">"), ("lt", "<"), ("ge", ">="), ("le", "<=")):
    _same(f"where_{_n}", f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity {_op} 25")
_add("where_ne", "SELECT c_custkey FROM $r WHERE seg != 'MACHINERY'", f"SELECT c_custkey FROM {_GAPS} WHERE seg <> 'MACHINERY'", root=_gaps)
_add("where_ne_types", "SELECT c_custkey FROM $r WHERE seg != 5", f"SELECT c_custkey FROM {_GAPS} WHERE seg IS NOT NULL", root=_gaps)
_add("where_cross_type", "SELECT c_custkey FROM $r WHERE bal < 'a'", f"SELECT c_custkey FROM {_GAPS} WHERE bal IS NOT NULL", root=_gaps)
_same("where_col_col", "SELECT l_orderkey, l_tax, l_discount FROM lineitem WHERE l_tax > l_discount")
_same("where_fn_lhs", "SELECT p_partkey FROM part WHERE LENGTH(UPPER(p_name)) > 12")
_add("where_rhs_fn", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TO_DATE('1996-01-01T00:00:00')", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'")
_same("where_and_or", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_returnflag = 'R' OR l_quantity > 45) AND l_discount < 0.05 OR l_tax = 0.08")
_add("where_like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%E%r_'", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%e%r_'")
_add("where_like_dynamic", "SELECT c_custkey FROM customer WHERE c_name LIKE CONCAT('%', '7')", "SELECT c_custkey FROM customer WHERE c_name ILIKE '%7'")
_add("where_not_like", "SELECT c_custkey FROM $r WHERE seg NOT LIKE 'm%'", f"SELECT c_custkey FROM {_GAPS} WHERE seg NOT ILIKE 'm%'", root=_gaps)
_same("where_in", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
_add("where_not_in", "SELECT c_custkey FROM $r WHERE seg NOT IN ('MACHINERY', NULL)", f"SELECT c_custkey FROM {_GAPS} WHERE seg NOT IN ('MACHINERY')", root=_gaps)
_add("where_in_empty", "SELECT c_custkey FROM $r WHERE seg NOT IN (:none)", f"SELECT c_custkey FROM {_GAPS} WHERE seg IS NOT NULL", root=_gaps, params={"none": []})
_same("where_between", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000")
_add("where_not_between", "SELECT c_custkey FROM $r WHERE bal NOT BETWEEN 1000 AND 5000", f"SELECT c_custkey FROM {_GAPS} WHERE bal NOT BETWEEN 1000 AND 5000", root=_gaps)
_add("where_not_between_null", "SELECT c_custkey FROM $r WHERE bal NOT BETWEEN 1000 AND NULL", f"SELECT c_custkey FROM {_GAPS} WHERE FALSE", root=_gaps)
_add("where_is_null", "SELECT c_custkey FROM $r WHERE seg IS NULL", f"SELECT c_custkey FROM {_GAPS} WHERE seg IS NULL", root=_gaps)
_add("where_is_not_null", "SELECT c_custkey FROM $r WHERE bal IS NOT NULL", f"SELECT c_custkey FROM {_GAPS} WHERE bal IS NOT NULL", root=_gaps)
# arrays
for _n, _cond, _ora in (
    ("contains_scalar", "words CONTAINS 'red'", f"list_contains({_W}, 'red')"),
    ("contains_all", "words @> ARRAY['red', 'ring']", f"list_has_all({_W}, ['red', 'ring'])"),
    ("contained_by", "words <@ ARRAY['red', 'ring', 'small', 'blue', 'bolt']", f"list_has_all(['red', 'ring', 'small', 'blue', 'bolt'], {_W})"),
    ("overlap", "words && ARRAY['red', 'bolt']", f"list_has_any({_W}, ['red', 'bolt'])"),
    ("eq", "words = ARRAY['red', 'ring']", f"{_W} = ['red', 'ring']"),
    ("ne", "words != ARRAY['red', 'ring']", f"{_W} <> ['red', 'ring']"),
    ("col_col", "words && brand", f"list_has_any({_W}, [p_brand])"),
):
    _add(f"array_{_n}", f"SELECT p_partkey FROM $r WHERE {_cond}", f"SELECT p_partkey FROM part WHERE {_ora}", root=_words)
# joins
_same("join_inner", "SELECT o.o_orderkey AS k, c.c_name AS name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
_same("join_left", "SELECT c.c_custkey AS c, o.o_orderkey AS o FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey")
_same("join_right", "SELECT o.o_orderkey AS o, c.c_custkey AS c FROM orders o RIGHT JOIN customer c ON o.o_custkey = c.c_custkey")
_same("join_reversed", "SELECT o.o_orderkey AS k, c.c_name AS name FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey")
_same("join_multi_key", "SELECT c.c_custkey AS c, s.s_suppkey AS s FROM customer c JOIN supplier s ON c.c_custkey = s.s_suppkey AND c.c_nationkey = s.s_nationkey")
_same("join_chain", "SELECT r.r_name AS region, COUNT(*) AS n, ROUND(SUM(o.o_totalprice), 2) AS total FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name")
_add("join_nested_key", "SELECT u.id AS id, n.n_name AS nation FROM users u JOIN nation n ON u.person.place.nation = n.n_nationkey", "SELECT c_custkey AS id, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey", named={"users": _nested})
_same("join_self", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
_add("join_null_key", "SELECT a.k AS k, b.n AS n FROM a JOIN b ON a.x = b.x", "SELECT s_suppkey AS k, n_name AS n FROM supplier JOIN nation ON NULLIF(s_nationkey, 3) IS NOT DISTINCT FROM NULLIF(n_nationkey, 3)",
     named={"a": lambda t: t("supplier").select(F.col("s_suppkey").alias("k"), F.nullif("s_nationkey", F.lit(3)).alias("x")), "b": lambda t: t("nation").select(F.col("n_name").alias("n"), F.nullif("n_nationkey", F.lit(3)).alias("x"))})
_add("join_mixed_numeric", "SELECT s.s_name AS s, n.label AS n FROM supplier s JOIN names n ON s.s_nationkey = n.k", "SELECT s_name AS s, n_name AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey", named={"names": lambda t: t("nation").select(F.col("n_name").alias("label"), F.col("n_nationkey").cast("double").alias("k"))})
_same("join_left_anti_idiom", "SELECT c.c_custkey AS c FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_orderkey IS NULL")
_add("join_select_star", "SELECT * FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey", "SELECT {'n_nationkey': n_nationkey, 'n_name': n_name, 'n_regionkey': n_regionkey} AS n, {'r_regionkey': r_regionkey, 'r_name': r_name} AS r FROM nation JOIN region ON n_regionkey = r_regionkey")
# aggregation
_same("group_by", "SELECT l_returnflag AS f, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag")
_same("group_by_multi", "SELECT l_returnflag AS f, l_linestatus AS s, COUNT(*) AS n, MAX(l_quantity) AS q FROM lineitem GROUP BY l_returnflag, l_linestatus")
_same("group_by_expr", "SELECT YEAR(o_orderdate) AS y, MONTH(o_orderdate) AS m, COUNT(*) AS n FROM orders GROUP BY YEAR(o_orderdate), MONTH(o_orderdate)")
_add("group_by_null_key", "SELECT seg, COUNT(*) AS n FROM $r GROUP BY seg", f"SELECT seg, count(*) AS n FROM {_GAPS} GROUP BY seg", root=_gaps)
_same("agg_count_star", "SELECT o_orderstatus AS s, COUNT(*) AS n FROM orders GROUP BY o_orderstatus")
_add("agg_count_col", "SELECT seg, COUNT(bal) AS n FROM $r GROUP BY seg", f"SELECT seg, count(bal) AS n FROM {_GAPS} GROUP BY seg", root=_gaps)
_same("agg_sum", "SELECT l_linestatus AS s, ROUND(SUM(l_extendedprice), 2) AS total FROM lineitem GROUP BY l_linestatus")
_add("agg_sum_nothing", "SELECT l_returnflag AS f, SUM(NULLIF(l_tax, l_tax)) AS s FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag AS f, 0.0::DOUBLE AS s FROM lineitem GROUP BY 1")
_same("agg_avg", "SELECT l_returnflag AS f, ROUND(AVG(l_quantity), 4) AS a FROM lineitem GROUP BY l_returnflag")
_same("agg_min", "SELECT p_brand AS b, MIN(p_name) AS first, MIN(p_retailprice) AS least FROM part GROUP BY p_brand")
_same("agg_max", "SELECT p_brand AS b, MAX(p_name) AS last, MAX(p_size) AS most FROM part GROUP BY p_brand")
_same("agg_over_expr", "SELECT c_mktsegment AS s, ROUND(AVG(NULLIF(ABS(c_acctbal), 0)), 8) AS a FROM customer GROUP BY c_mktsegment")
_same("scalar_over_agg", "SELECT c_nationkey AS n, UPPER(MAX(c_name)) AS top, ROUND(AVG(c_acctbal), 8) AS a FROM customer GROUP BY c_nationkey")
_add("agg_case", "SELECT o_orderstatus AS s, SUM(CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END) AS n FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus AS s, sum(CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END)::DOUBLE AS n FROM orders GROUP BY 1")
_same("having_alias", "SELECT c_nationkey AS n, COUNT(*) AS cnt FROM customer GROUP BY c_nationkey HAVING cnt > 55")
_same("having_expr", "SELECT c_nationkey AS n FROM customer GROUP BY c_nationkey HAVING COUNT(*) >= 60 OR MIN(c_acctbal) BETWEEN -990 AND -900")
_same("order_by_agg", "SELECT p_brand AS b, COUNT(*) AS n FROM part GROUP BY p_brand ORDER BY COUNT(*) DESC, p_brand LIMIT 7")
_add("group_star_unique", "SELECT * FROM supplier GROUP BY s_suppkey", "SELECT * FROM supplier")
_add("group_first_unique", "SELECT s_suppkey AS k, s_name AS some FROM supplier GROUP BY s_suppkey", "SELECT s_suppkey AS k, s_name AS some FROM supplier")
_add("group_first_value", "SELECT n_regionkey AS r, n_name AS some FROM nation GROUP BY n_regionkey", None)
_add("group_star", "SELECT * FROM nation GROUP BY n_regionkey", None)
_same("agg_global", "SELECT COUNT(*) AS n, MIN(l_quantity) AS a, MAX(l_quantity) AS b FROM lineitem")
# arrays of several types
for _n, _where, _sql in (
    ("contains", "tags CONTAINS 'F' OR tags CONTAINS 3", "s = 'F' OR n = 3"), ("contains_false", "tags CONTAINS FALSE", "NOT b"), ("all", "tags @> ARRAY['F', TRUE]", "s = 'F' AND b"), ("within", "tags <@ ARRAY[1, 2, 3, 'F', TRUE]", "n IN (1, 2, 3) AND s = 'F' AND b"),
    ("overlap", "tags && ARRAY['O', 7]", "s = 'O' OR n = 7"), ("eq", "tags = ARRAY[3, 'F', FALSE]", "n = 3 AND s = 'F' AND NOT b"), ("ne", "tags != ARRAY[3, 'F', FALSE]", "n <> 3 OR s <> 'F' OR b"),
):
    _add(f"array_mixed_{_n}", f"SELECT o_orderkey FROM $r WHERE {_where}", f"SELECT o_orderkey FROM (SELECT o_orderkey, o_orderkey % 10 AS n, o_orderstatus AS s, o_totalprice > 150000 AS b FROM orders) WHERE {_sql}", root=_mixed)
# windows
for _n, _f in (("row_number", "ROW_NUMBER()"), ("rank", "RANK()"), ("dense_rank", "DENSE_RANK()"), ("ntile", "NTILE(4)"), ("lag", "LAG(o_totalprice)"), ("lag_offset", "LAG(o_totalprice, 2)"), ("lead", "LEAD(o_totalprice)"), ("lead_offset", "LEAD(o_totalprice, 3)")):
    _same(f"win_{_n}", f"SELECT o_orderkey AS k, {_f} OVER (PARTITION BY o_custkey ORDER BY {'o_orderstatus' if 'RANK' in _f else 'o_orderdate, o_orderkey'}) AS w FROM orders")
for _n, _f in (("sum", "ROUND(SUM(o_totalprice) OVER (PARTITION BY o_custkey), 2)"), ("avg", "ROUND(AVG(o_totalprice) OVER (PARTITION BY o_custkey), 8)"), ("min", "MIN(o_orderdate) OVER (PARTITION BY o_custkey)"), ("max", "MAX(o_totalprice) OVER (PARTITION BY o_custkey)"), ("count_star", "COUNT(*) OVER (PARTITION BY o_custkey)"), ("over_empty", "COUNT(*) OVER ()")):
    _same(f"win_{_n}", f"SELECT o_orderkey AS k, {_f} AS w FROM orders")
_add("win_agg_ordered", "SELECT event_id AS k, ROUND(SUM(value) OVER (PARTITION BY user_id ORDER BY ts), 4) AS s FROM events", "SELECT event_id AS k, round(sum(value) OVER (PARTITION BY user_id), 4) AS s FROM events")
_add("win_count_col", "SELECT c_custkey, COUNT(bal) OVER (PARTITION BY seg) AS n FROM $r", f"SELECT c_custkey, count(bal) OVER (PARTITION BY seg) AS n FROM {_GAPS}", root=_gaps)
_add("win_rank_noorder", "SELECT n_nationkey AS k, RANK() OVER (PARTITION BY n_regionkey) AS r FROM nation", "SELECT n_nationkey AS k, 1::BIGINT AS r FROM nation")
_same("win_nested_scalar", "SELECT c_custkey AS k, ROUND(ABS(AVG(c_acctbal) OVER (PARTITION BY c_nationkey)), 8) AS a FROM customer")
_same("win_in_case", "SELECT c_custkey AS k, CASE WHEN ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 3 THEN 'top' ELSE 'rest' END AS g FROM customer")
_same("win_over_group", "SELECT c_nationkey AS n, COUNT(*) AS cnt, RANK() OVER (ORDER BY COUNT(*) DESC) AS r FROM customer GROUP BY c_nationkey")
_same("win_multi_spec", "SELECT o_orderkey AS k, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS a, DENSE_RANK() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS b FROM orders")
_same("win_order_by", "SELECT c_custkey AS k FROM customer ORDER BY ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY c_custkey), c_custkey LIMIT 40")
# order, limit, distinct
_same("order_by", "SELECT n_name FROM nation ORDER BY n_name")
_same("order_by_multi", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderstatus DESC, o_totalprice, o_orderkey LIMIT 100")
_same("order_by_expr", "SELECT p_partkey FROM part ORDER BY LENGTH(p_name) DESC, p_partkey LIMIT 50")
_add("order_by_nulls", "SELECT c_custkey FROM $r ORDER BY bal, c_custkey LIMIT 50", f"SELECT c_custkey FROM {_GAPS} ORDER BY bal NULLS FIRST, c_custkey LIMIT 50", root=_gaps)
_same("order_by_alias", "SELECT s_suppkey AS k, ROUND(s_acctbal, 0) AS bal FROM supplier ORDER BY bal DESC, k LIMIT 20")
_same("order_by_case", "SELECT o_orderkey FROM orders ORDER BY CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'O' THEN 2 ELSE 3 END, o_orderkey LIMIT 60")
#: The same over the whole table: a full sort, not a top-k.
SORTS = tuple(f"{_n}_all" for _n in ("order_by_multi", "order_by_expr", "order_by_nulls", "order_by_alias", "order_by_case", "order_by_agg", "win_order_by"))
for _n in SORTS:
    _c = CASES[_n.removesuffix("_all")]
    CASES[_n] = replace(_c, sql=_c.sql.rpartition(" LIMIT ")[0], oracle=_c.oracle.rpartition(" LIMIT ")[0])
_same("limit", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25")
_same("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 100")
_same("top_n", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_partkey, l_suppkey, l_linenumber LIMIT 50")
_same("top_n_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 10")
_same("distinct", "SELECT DISTINCT o_orderpriority FROM orders")
_same("distinct_multi", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem ORDER BY l_returnflag, l_linestatus")
_add("distinct_after_limit", "SELECT DISTINCT o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 20", "SELECT DISTINCT o_orderstatus FROM (SELECT o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 20)")
# functions: dialect expression, DuckDB expression (None: the same), table and its key
for _n, _f, _o, _t in (
    ("lower", "LOWER(p_brand)", None, "part"), ("upper", "UPPER(p_name)", None, "part"), ("upper_locale", "UPPER(p_name, 'tr-TR')", "upper(replace(p_name, 'i', 'İ'))", "part"),
    ("concat", "CONCAT(p_brand, '-', p_type)", "p_brand || '-' || p_type", "part"), ("substring", "SUBSTRING(p_name, 2, 4)", None, "part"), ("substring_neg", "SUBSTRING(p_name, 0, 3)", "p_name[1:2]", "part"),
    ("trim", "TRIM(CONCAT('  ', p_name, '   '))", "p_name", "part"), ("length", "LENGTH(p_name)", None, "part"), ("replace", "REPLACE(p_name, 'e', 'EE')", None, "part"), ("left", "LEFT(p_name, 4)", None, "part"), ("right", "RIGHT(p_name, 4)", None, "part"),
    ("lpad", "LPAD(p_brand, 12, '*')", None, "part"), ("rpad", "RPAD(p_brand, 5, '*')", None, "part"), ("reverse", "REVERSE(p_name)", None, "part"), ("position", "POSITION('e', p_name)", "instr(p_name, 'e')", "part"),
    ("abs", "ABS(c_acctbal)", None, "customer"), ("round", "ROUND(c_acctbal)", "round(c_acctbal) + 0.0", "customer"), ("round_digits", "ROUND(c_acctbal, -2)", "round(c_acctbal, -2) + 0.0", "customer"), ("ceil", "CEIL(c_acctbal)", "ceil(c_acctbal)::BIGINT", "customer"), ("floor", "FLOOR(c_acctbal)", "floor(c_acctbal)::BIGINT", "customer"),
    ("mod", "MOD(c_custkey, 7)", "c_custkey % 7", "customer"), ("mod_zero", "MOD(c_custkey, 0)", "NULL::BIGINT", "customer"), ("power", "POWER(p_size, 2)", "power(p_size, 2)", "part"), ("sqrt", "ROUND(SQRT(c_acctbal), 6)", "CASE WHEN c_acctbal >= 0 THEN round(sqrt(c_acctbal), 6) END", "customer"), ("sign", "SIGN(c_acctbal)", "sign(c_acctbal)::BIGINT", "customer"),
    ("year", "YEAR(o_orderdate)", None, "orders"), ("month", "MONTH(o_orderdate)", None, "orders"), ("day", "DAY(o_orderdate)", None, "orders"), ("hour", "HOUR(ts)", None, "events"), ("minute", "MINUTE(ts)", None, "events"), ("second", "SECOND(ts)", None, "events"), ("year_bad", "YEAR(event_type)", "NULL::BIGINT", "events"),
    ("date_add_day", "DATE_ADD(o_orderdate, 30, 'DAY')", "o_orderdate + INTERVAL 30 DAY", "orders"), ("date_add_month", "DATE_ADD(o_orderdate, 1, 'MONTHS')", "o_orderdate + INTERVAL 1 MONTH", "orders"), ("date_add_hour", "DATE_ADD(ts, 5, 'HOUR')", "ts + INTERVAL 5 HOUR", "events"),
    ("date_diff_day", "DATE_DIFF(TO_DATE('1999-01-01'), o_orderdate, 'DAY')", "date_sub('day', o_orderdate, TIMESTAMP '1999-01-01')", "orders"), ("date_diff_month", "DATE_DIFF(TO_DATE('1999-01-01'), o_orderdate, 'MONTH')", "date_sub('month', o_orderdate, TIMESTAMP '1999-01-01')", "orders"),
    ("to_date", "TO_DATE(CAST(o_orderdate AS STRING))", "o_orderdate", "orders"), ("to_date_pattern", "TO_DATE('31/12/2020', 'dd/MM/yyyy')", "DATE '2020-12-31'", "region"),
    ("nullif", "NULLIF(o_orderstatus, 'F')", None, "orders"), ("coalesce", "COALESCE(NULLIF(o_orderstatus, 'F'), o_orderpriority)", None, "orders"), ("nested", "LPAD(UPPER(TRIM(SUBSTRING(COALESCE(NULLIF(p_name, ''), '?'), 1, 6))), 8, '.')", "lpad(upper(trim(p_name[1:6])), 8, '.')", "part"),
    ("now", "YEAR(NOW()) > 2000", None, "region"),
):
    _key = {"part": "p_partkey", "customer": "c_custkey", "orders": "o_orderkey", "events": "event_id", "region": "r_regionkey"}[_t]
    if _n == "now":
        _add("fn_now", "SELECT r_regionkey AS k, CASE WHEN YEAR(NOW()) > 2000 THEN 'new' ELSE 'old' END AS v FROM region", "SELECT r_regionkey AS k, 'new' AS v FROM region")
    else:
        _add(f"fn_{_n}", f"SELECT {_key} AS k, {_f} AS v FROM {_t}", f"SELECT {_key} AS k, {_o or _f} AS v FROM {_t}")
for _n, _f, _o, _t, _key in (
    ("string", "CAST(p_size AS STRING)", "p_size::VARCHAR", "part", "p_partkey"), ("number", "CAST(SUBSTRING(p_brand, 7) AS NUMBER)", "p_brand[7:]::DOUBLE", "part", "p_partkey"), ("decimal", "CAST(c_acctbal AS DECIMAL)", "c_acctbal", "customer", "c_custkey"),
    ("integer", "CAST(c_acctbal AS INTEGER)", "trunc(c_acctbal)::BIGINT", "customer", "c_custkey"), ("boolean", "CAST(p_size AS BOOLEAN)", "p_size <> 0", "part", "p_partkey"), ("date", "CAST(o_orderdate AS DATE)", "o_orderdate::DATE", "orders", "o_orderkey"), ("datetime", "CAST(CAST(o_orderdate AS DATE) AS DATETIME)", "o_orderdate::DATE::TIMESTAMP", "orders", "o_orderkey"),
):
    _add(f"cast_{_n}", f"SELECT {_key} AS k, {_f} AS v FROM {_t}", f"SELECT {_key} AS k, {_o} AS v FROM {_t}")
# parameters
_add("param_named", "SELECT o_orderkey FROM (SELECT o_orderkey, o_totalprice AS p FROM orders WHERE o_orderstatus = :s) WHERE p > :least", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000", params={"s": "F", "least": 100000})
_add("param_positional", "SELECT c_custkey FROM customer WHERE c_mktsegment = ? AND c_acctbal < ?", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal < 99.5", params=["BUILDING", 99.5])
_add("param_in_list", "SELECT c_custkey FROM customer WHERE c_nationkey IN (:n)", "SELECT c_custkey FROM customer WHERE c_nationkey IN (1, 2, 3)", params={"n": [1, 2, 3]})
_add("param_array", "SELECT p_partkey FROM $r WHERE words && :w", f"SELECT p_partkey FROM part WHERE list_has_any({_W}, ['red', 'bolt'])", root=_words, params={"w": ["red", "bolt"]})
_add("param_limit", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT :n OFFSET :skip", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 9 OFFSET 4", params={"n": 9, "skip": 4})
# the shapes of the published benchmark
_same("kitchen_sink", "SELECT c_nationkey AS n, COUNT(*) AS cnt, ROUND(AVG(c_acctbal), 8) AS a FROM customer WHERE c_acctbal > 0 AND c_mktsegment != 'BUILDING' GROUP BY c_nationkey HAVING cnt > 10 ORDER BY cnt DESC, n LIMIT 20")
FLAGSHIP = "SELECT l_returnflag, COUNT(*) AS cnt, ROUND(AVG(l_quantity), 2) AS avg_qty, MAX(l_extendedprice) AS top FROM lineitem WHERE l_discount BETWEEN 0.02 AND 0.08 GROUP BY l_returnflag HAVING cnt > 10 ORDER BY cnt DESC LIMIT 10"
# the same shapes on larger tables
_same("select_star_large", "SELECT * FROM lineitem")
_add("where_like_large", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE CONCAT(l_returnflag, '-', l_linestatus) LIKE '%n-_'", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag || '-' || l_linestatus ILIKE '%n-_'")
_same("subquery_from_large", "SELECT flag, n FROM (SELECT l_returnflag AS flag, l_linestatus AS line, COUNT(*) AS n FROM lineitem WHERE l_quantity > 10 GROUP BY l_returnflag, l_linestatus) WHERE n > 1")
_add("fn_nested_large", "SELECT l_orderkey AS k, l_linenumber AS n, LPAD(TRIM(COALESCE(NULLIF(l_returnflag, 'N'), 'none')), 6, '*') AS s FROM lineitem", "SELECT l_orderkey AS k, l_linenumber AS n, lpad(trim(coalesce(NULLIF(l_returnflag, 'N'), 'none')), 6, '*') AS s FROM lineitem")
_same("kitchen_sink_large", "SELECT l_suppkey AS n, COUNT(*) AS cnt, ROUND(AVG(l_quantity), 8) AS a FROM lineitem WHERE l_quantity > 5 AND l_returnflag != 'A' GROUP BY l_suppkey HAVING cnt > 10 ORDER BY cnt DESC, n LIMIT 20")
_same("flagship", FLAGSHIP)


def scan_single_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare("SELECT a, b.c AS c FROM $r").run(spark, '{"a": 1, "b": {"c": "x"}}')


def prepared_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = prepare("SELECT o_orderstatus AS s, COUNT(*) AS n FROM $r WHERE o_totalprice > :least GROUP BY o_orderstatus")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return p.run(spark, orders, {"least": 1000}).unionByName(p.run(spark, orders, {"least": 200000}))


def engine_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, Settings(cached_results=4)).register("customer", spark.read.parquet(f"{sf_dir}/customer.parquet"))
    sql = "SELECT c_mktsegment AS s, COUNT(*) AS n FROM customer GROUP BY c_mktsegment"
    engine.query(sql)
    return engine.query(sql)


def engine_cached_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark).register("nation", spark.read.parquet(f"{sf_dir}/nation.parquet"), persist=True)
    return engine.query("SELECT n_regionkey AS r, COUNT(*) AS n FROM nation GROUP BY n_regionkey")


def sink_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.as_json(prepare("SELECT n_nationkey AS k, n_name AS n.name, NULLIF(n_regionkey, 1) AS n.region FROM $r").run(spark, spark.read.parquet(f"{sf_dir}/nation.parquet")))


def mixed_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of values of several types, in the order of their types."""
    df = from_json(spark, '[{"v": 2}, {"v": "b"}, {"v": true}, {"v": null}, {"v": 1.5}, {"v": "a"}, {}]')
    return prepare("SELECT CAST(v AS STRING) AS s FROM $r WHERE v != 'b' ORDER BY v").run(spark, {ROOT: df})


def json_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects that name a key twice, the last or the first value counting."""
    twice = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.format_string('{"k": %d, "v": %d, "v": %d}', "n_nationkey", "n_regionkey", F.col("n_nationkey") + 100).alias("text"))
    last, first = (from_json_column(twice, "text", JsonLimits(duplicate_keys=d)) for d in (DuplicateKeys.LAST_WINS, DuplicateKeys.FIRST_WINS))
    return Engine(spark).register("a", last).register("b", first).query("SELECT a.k AS k, a.v AS last, b.v AS first FROM a JOIN b ON a.k = b.k")


def own_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of another form than JSON, read by a codec of the caller's own."""
    lines = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat_ws("=", "c_name", "c_nationkey").alias("text"))
    rows = from_json_column(lines, "text", codec=lambda s: {"name": s.split("=")[0], "nation": int(s.split("=")[1])})
    return prepare("SELECT nation, COUNT(*) AS n FROM $r GROUP BY nation").run(spark, rows)


def own_result_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second run of a query takes what the first put into the caller's cache."""
    class Kept(dict):
        def put(self, sql: str, result: DataFrame) -> None:
            self[sql] = result.withColumn("kept", F.lit(True))

    engine = Engine(spark, Settings(result_cache=Kept())).register("supplier", spark.read.parquet(f"{sf_dir}/supplier.parquet"))
    sql = "SELECT s_nationkey AS k, COUNT(*) AS n FROM supplier GROUP BY s_nationkey"
    engine.query(sql)
    return engine.query(sql)


def host_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters of Python's own types, by name from an object."""
    params = {"day": datetime.date(1996, 1, 1), "most": Decimal("200000.5"), "some": ["F", "O"], "no": None}
    sql = "SELECT o_orderkey AS k FROM $r WHERE CAST(o_orderdate AS DATE) >= :day AND o_totalprice < :most AND o_orderstatus IN (:some) AND o_orderstatus != COALESCE(:no, 'P')"
    return prepare(sql).run(spark, spark.read.parquet(f"{sf_dir}/orders.parquet"), params)


def mapped_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result as objects of a class, a missing field by its default, and those as rows again."""
    got = sinks.to_objects(prepare("SELECT r_regionkey AS key, r_name AS name, r_name AS place.inner FROM $r").run(spark, spark.read.parquet(f"{sf_dir}/region.parquet")), Region)
    return spark.createDataFrame([(r.key, r.name, r.place.inner, r.note) for r in got], "key int, name string, place string, note string")


def sink_pretty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an indented JSON text."""
    text = sinks.to_json(prepare("SELECT r_regionkey AS k, r_name AS n FROM $r").run(spark, spark.read.parquet(f"{sf_dir}/region.parquet")), pretty=True)
    return spark.createDataFrame([(line.rstrip(","),) for line in text.split("\n")], "line string")


def rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which queries and texts are refused, each before any row is read."""
    df = spark.read.parquet(f"{sf_dir}/nation.parquet")
    tight = Settings(limits=Limits(sql_length=60, subquery_depth=1, in_list=2, rows=3, parameters=1, like_wildcards=2))
    tries: dict[str, tuple[str, Settings]] = {
        "join_ordering": ("SELECT a.x FROM a JOIN b ON a.x > b.y", Settings()), "same_source_twice": ("SELECT x.a FROM x JOIN x ON x.a = x.a", Settings()), "window_in_where": ("SELECT n_name FROM $r WHERE RANK() OVER (ORDER BY n_name) > 1", Settings()),
        "rank_without_over": ("SELECT RANK() FROM $r", Settings()), "array_ordering": ("SELECT n_name FROM $r WHERE n_name < ARRAY[1]", Settings()), "unknown_column": ("SELECT nothing FROM $r", Settings(strict_columns=True)), "long_query": ("SELECT n_name, n_name AS a, n_name AS b, n_name AS c, n_name AS d FROM $r", tight),
        "long_in_list": ("SELECT n_name FROM $r WHERE n_nationkey IN (1, 2, 3)", tight), "many_wildcards": ("SELECT n_name FROM $r WHERE n_name LIKE '%a%b%'", tight), "too_many_rows": ("SELECT n_name FROM $r", tight), "fine": ("SELECT n_name FROM $r WHERE n_nationkey IN (1, 2)", tight),
    }
    out = []
    for name, (sql, settings) in tries.items():
        try:
            sinks.rows(prepare(sql, settings).run(spark, df), settings)
            out.append((name, False))
        except NestQueryError:
            out.append((name, True))
    for name, text in (("repeated_key", '[{"a": 1, "a": 2}]'), ("trailing_comma", "[1,]"), ("deep_json", "[" * 70 + "]" * 70), ("good_json", '[{"a": 1}]')):
        try:
            parse_json(text)
            out.append((name, False))
        except NestQueryError:
            out.append((name, True))
    return spark.createDataFrame(out, "name string, refused boolean")


@dataclass(frozen=True)
class Place:
    inner: str


@dataclass(frozen=True)
class Region:
    key: int
    name: str
    place: Place
    note: str = "none"


_FURTHER: dict[str, Query] = {"json_duplicates": json_duplicates, "own_codec": own_codec, "own_result_cache": own_result_cache, "host_types": host_types, "mapped_objects": mapped_objects, "sink_pretty": sink_pretty, "rejections": rejections}
QUERIES: dict[str, Query] = {**CASES, **_FURTHER, "scan_single_object": scan_single_object, "prepared_reuse": prepared_reuse, "engine_cache": engine_cache, "engine_cached_scan": engine_cached_scan, "sink_json": sink_json, "mixed_types": mixed_types}
ORACLE: dict[str, str] = {k: v.oracle for k, v in CASES.items() if v.oracle} | {
    "scan_single_object": "SELECT 1::BIGINT AS a, 'x' AS c",
    "prepared_reuse": "SELECT o_orderstatus AS s, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY 1 UNION ALL SELECT o_orderstatus, count(*) FROM orders WHERE o_totalprice > 200000 GROUP BY 1",
    "engine_cache": "SELECT c_mktsegment AS s, count(*) AS n FROM customer GROUP BY 1",
    "engine_cached_scan": "SELECT n_regionkey AS r, count(*) AS n FROM nation GROUP BY 1",
    "sink_json": """SELECT '{"k":' || n_nationkey || ',"n":{"name":"' || n_name || '","region":' || coalesce(NULLIF(n_regionkey, 1)::VARCHAR, 'null') || '}}' AS value FROM nation""",
    "json_duplicates": "SELECT n_nationkey::BIGINT AS k, n_nationkey::BIGINT + 100 AS last, n_regionkey::BIGINT AS first FROM nation",
    "own_codec": "SELECT c_nationkey::BIGINT AS nation, count(*) AS n FROM customer GROUP BY 1",
    "own_result_cache": "SELECT s_nationkey AS k, count(*) AS n, TRUE AS kept FROM supplier GROUP BY 1",
    "host_types": "SELECT o_orderkey AS k FROM orders WHERE o_orderdate::DATE >= DATE '1996-01-01' AND o_totalprice < 200000.5 AND o_orderstatus IN ('F', 'O')",
    "mapped_objects": "SELECT r_regionkey AS key, r_name AS name, r_name AS place, 'none' AS note FROM region",
    "sink_pretty": """SELECT unnest(['[', ']']) AS line UNION ALL SELECT unnest(['  {', '    "k": ' || r_regionkey, '    "n": "' || r_name || '"', '  }']) FROM region""",
    "rejections": "SELECT unnest(['join_ordering', 'same_source_twice', 'window_in_where', 'rank_without_over', 'array_ordering', 'unknown_column', 'long_query', 'long_in_list', 'many_wildcards', 'too_many_rows', 'repeated_key', 'trailing_comma', 'deep_json']) AS name, TRUE AS refused UNION ALL SELECT unnest(['fine', 'good_json']), FALSE",
    "mixed_types": "SELECT * FROM (VALUES ('true'), ('1.5'), ('2'), ('a')) AS t(s)",
}
