"""What the dialect defines beside plain SQL, on small rows."""

import datetime as dt
import io
import json
from dataclasses import dataclass
from enum import Enum

import pytest
from pyspark.sql import functions as F

from nestquery import catalogue, cli, sinks
from nestquery.engine import Engine, Sources, prepare, query, query_json
from nestquery.errors import BindError, ExecutionError, MappingError, ParseError
from nestquery.plans.lexer import scan
from nestquery.plans.parser import parse
from nestquery.settings import DuplicateKeys, JsonLimits, Limits, MissingFields, Settings
from nestquery.sources import from_json, from_json_column, parse_json
from nestquery.streaming import stream

PEOPLE = [
    {"id": 1, "name": " Ann ", "team": "x", "pay": 100, "tags": ["a", "b"], "home": {"city": "Oslo"}, "hired": "2020-01-31"},
    {"id": 2, "name": "Bob", "team": "y", "pay": 50.5, "tags": [], "home": {"city": "Rome"}, "hired": "2021-06-01T10:20:30"},
    {"id": 3, "name": None, "team": None, "pay": None, "tags": ["b", None]},
    {"id": 4, "name": "Ann", "team": "x", "pay": 70, "tags": ["c"], "hired": "soon"},
]


def run(spark, sql, data=PEOPLE, params=None, settings=Settings()):
    return sinks.rows(query(spark, sql, data, params, settings), settings)


def column(spark, sql, **more):
    return [next(iter(r.values())) for r in run(spark, sql, **more)]


@pytest.mark.parametrize("where, ids", [
    ("pay = 100.0", [1]), ("pay != 100", [2, 4]), ("name != 5", [1, 2, 4]), ("name = 5", []), ("pay < 'a'", [1, 2, 4]), ("pay > 'a'", []), ("pay < NULL", []),
    ("team IN ('x', NULL)", [1, 4]), ("team NOT IN ('x', NULL)", [2]), ("pay NOT BETWEEN 60 AND NULL", []), ("pay NOT BETWEEN 60 AND 80", [1, 2]),
    ("name LIKE 'a%'", [4]), ("name NOT LIKE 'a%'", [1, 2]), ("pay LIKE '1%'", []), ("nothing IS NULL", [1, 2, 3, 4]), ("home.city IS NULL", [3, 4]), ("home.street.no IS NOT NULL", []),
    ("tags CONTAINS 'b'", [1, 3]), ("tags CONTAINS NULL", []), ("name CONTAINS 'b'", []), ("tags @> ARRAY[]", [1, 2, 3, 4]), ("tags @> ARRAY['b']", [1, 3]), ("tags <@ ARRAY['a', 'b']", [1, 2]), ("tags && ARRAY['c', 'b']", [1, 3, 4]), ("tags && ARRAY[]", []),
    ("tags = ARRAY['a', 'b']", [1]), ("tags = ARRAY['b', 'a']", []), ("tags != ARRAY['a', 'b']", [2, 3, 4]), ("tags = ARRAY[]", [2]), ("tags @> ARRAY[1]", []),
    ("(id = 1 OR id = 2) AND team = 'y'", [2]), ("hired > TO_DATE('2000-01-01')", []), ("YEAR(hired) = 2021", [2]),
])
def test_predicates(spark, where, ids):
    assert sorted(column(spark, f"SELECT id FROM $r WHERE {where}")) == ids


@pytest.mark.parametrize("expr, value", [
    ("SUBSTRING('hello', 0, 3)", "he"), ("SUBSTRING('hello', -2, 4)", "h"), ("SUBSTRING('hello', 2)", "ello"), ("SUBSTRING('hello', 2, 0)", ""), ("TRIM(' \t x ')", "x"), ("LENGTH(12345)", 5), ("CONCAT('a', NULL)", None), ("CONCAT(1, TRUE)", "1true"),
    ("LPAD('7', 3, '0')", "007"), ("RPAD('abc', 2, '*')", "ab"), ("POSITION('z', 'abc')", 0), ("LEFT('abc', 2)", "ab"), ("REVERSE('abc')", "cba"), ("UPPER('iı', 'tr-TR')", "İI"), ("LOWER('Iİ', 'tr')", "ıi"), ("REPLACE('a.a', '.', '-')", "a-a"),
    ("ROUND(2.5)", 3), ("ROUND(1234.5, -2)", 1200), ("MOD(-7, 3)", -1), ("MOD(7, 0)", None), ("POWER(10, 400)", None), ("SQRT(-1)", None), ("SIGN(-3.2)", -1), ("ABS('x')", None), ("CEIL(1.2)", 2), ("FLOOR(-1.2)", -2),
    ("CAST('3.7' AS INTEGER)", 3), ("CAST('yes' AS BOOLEAN)", False), ("CAST('TRUE' AS BOOLEAN)", True), ("CAST(0.0 AS BOOLEAN)", False), ("CAST(TRUE AS NUMBER)", 1), ("CAST(TO_DATE('1970-01-02') AS NUMBER)", 1), ("CAST(TO_DATE('2024-01-01T00:00:00') AS STRING)", "2024-01-01T00:00"), ("CAST(TO_DATE('2024-01-01T00:00:05') AS STRING)", "2024-01-01T00:00:05"),
    ("DATE_ADD(TO_DATE('2024-01-31'), 1, 'MONTH')", dt.date(2024, 2, 29)), ("DATE_ADD(TO_DATE('2024-01-31'), 1, 'HOURS')", dt.datetime(2024, 1, 31, 1)), ("DATE_DIFF(TO_DATE('2024-02-29'), TO_DATE('2024-01-31'), 'MONTH')", 0), ("TO_DATE('05.03.2024', 'dd.MM.yyyy')", dt.date(2024, 3, 5)), ("HOUR(TO_DATE('2024-01-01'))", 0), ("YEAR('no date')", None),
    ("NULLIF(1, 1.0)", None), ("NULLIF(1, '1')", 1), ("COALESCE(NULL, 'x')", "x"), ("COALESCE(NULL, NULL)", None), ("CASE NULL WHEN NULL THEN 1 ELSE 2 END", 2), ("CASE WHEN 1 = 2 THEN 1 END", None), ("CASE WHEN TRUE = TRUE THEN 1 ELSE 'x' END", 1),
])
def test_scalars(spark, expr, value):
    assert column(spark, f"SELECT {expr} AS v FROM $r", data=[{"one": 1}]) == [value]


def test_casts_that_fail(spark):
    for expr in ("CAST('x' AS NUMBER)", "CAST('x' AS DATE)", "TO_DATE('x')"):
        with pytest.raises(Exception, match="CAST_INVALID_INPUT|malformed|MALFORMED"):
            run(spark, f"SELECT {expr} AS v FROM $r")


def test_joins(spark):
    left = spark.createDataFrame([(1, "a"), (None, "n"), (5, "z")], "k long, l string")
    right = spark.createDataFrame([(1.0, "A"), (None, "N")], "k double, r string")
    both = {"x": left, "y": right}
    assert sorted(run(spark, "SELECT x.l AS l, y.r AS r FROM x JOIN y ON y.k = x.k", both), key=str) == [{"l": "a", "r": "A"}, {"l": "n", "r": "N"}]
    assert len(run(spark, "SELECT l, r FROM x LEFT JOIN y ON x.k = y.k", both)) == 3
    assert run(spark, "SELECT x.l, r FROM x JOIN y ON x.k = y.k WHERE r = 'A'", both) == [{"x.l": "a", "r": "A"}]
    assert list(run(spark, "SELECT * FROM x JOIN y ON x.k = y.k", both)[0]) == ["x", "y"]
    assert len(run(spark, "SELECT l FROM x JOIN y ON x.l = y.k", both)) == 0
    with pytest.raises(ExecutionError, match="several sources"):
        run(spark, "SELECT k AS k FROM x JOIN y ON x.k = y.k", both)


def test_groups_windows_and_order(spark):
    assert run(spark, "SELECT team, SUM(pay) AS s, COUNT(pay) AS n FROM $r GROUP BY team HAVING n >= 0 ORDER BY team") == [{"team": None, "s": 0.0, "n": 0}, {"team": "x", "s": 170.0, "n": 2}, {"team": "y", "s": 50.5, "n": 1}]
    assert column(spark, "SELECT CASE WHEN COUNT(*) > 1 THEN 'many' ELSE 'one' END AS c FROM $r GROUP BY team ORDER BY COUNT(*) DESC, team") == ["many", "one", "one"]
    assert run(spark, "SELECT id, SUM(pay) OVER (PARTITION BY team ORDER BY id) AS s, SUM(pay) OVER () AS t FROM $r ORDER BY id")[0] == {"id": 1, "s": 170.0, "t": 220.5}
    assert column(spark, "SELECT RANK() OVER (PARTITION BY team) AS r FROM $r") == [1, 1, 1, 1]
    assert column(spark, "SELECT id FROM $r ORDER BY pay DESC") == [1, 4, 2, 3]
    assert column(spark, "SELECT DISTINCT team FROM $r ORDER BY id LIMIT 1 OFFSET 1") == ["y"]
    assert column(spark, "SELECT DISTINCT team FROM $r ORDER BY pay DESC") == ["x", "y", None]
    assert run(spark, "SELECT COUNT(*) AS n FROM $r", []) == [{"n": 0}]
    assert run(spark, "SELECT UPPER(team) AS t, COUNT(*) AS n FROM $r WHERE team = 'x' GROUP BY t") == [{"t": "X", "n": 2}]
    assert run(spark, "SELECT t, RANK() OVER (ORDER BY n DESC) AS r FROM (SELECT team AS t, COUNT(*) AS n FROM $r GROUP BY team) ORDER BY r, t LIMIT 1") == [{"t": "x", "r": 1}]


def test_golden_fixture(spark):
    """1,200 generated users; the figures are those that the formulas give."""
    users = [{"id": i + 1, "land": ["US", "UK", "DE", "JP", "FR", "BR", "IN", "CA"][i % 8], "tier": ["bronze", "silver", "gold", "platinum"][i * 3 % 4], "salary": 40000 + i * 211 % 80000, "score": i * 31 % 100, "active": i % 5 != 0} for i in range(1200)]
    text = query_json(spark, "SELECT land, COUNT(*) AS n, ROUND(AVG(score), 2) AS mean, MIN(salary) AS low, MAX(salary) AS high FROM $r WHERE active = TRUE GROUP BY land HAVING n >= 50 ORDER BY land LIMIT 2", users)
    assert text == '[{"land":"BR","n":120,"mean":50,"low":40391,"high":119727},{"land":"CA","n":120,"mean":50,"low":40149,"high":118461}]'
    assert query_json(spark, "SELECT DISTINCT tier FROM $r ORDER BY tier DESC LIMIT 3 OFFSET 1", users) == '[{"tier":"silver"}]'


def test_mixed_types_keep_their_own(spark):
    rows = [{"v": 2}, {"v": "b"}, {"v": True}, {"v": None}, {"v": 1.5}, {"v": [1]}, {"v": "2"}]
    assert column(spark, "SELECT v FROM $r WHERE v = 2", data=rows) == [2]
    assert column(spark, "SELECT v FROM $r WHERE v >= 2 ORDER BY v", data=rows) == [2, "2", "b"]
    assert column(spark, "SELECT v FROM $r ORDER BY v DESC LIMIT 3", data=rows) == ["b", "2", 2]
    assert sorted(column(spark, "SELECT COUNT(*) AS n FROM $r GROUP BY v", data=rows)) == [1, 1, 1, 1, 1, 2]


def test_scans(spark):
    assert run(spark, "SELECT * FROM $r", "7") == [] and run(spark, "SELECT * FROM $r", "[1, [2]]") == []
    assert run(spark, "SELECT a FROM $R.x.rows WHERE a > 1", '{"x": {"rows": [{"a": 1}, {"a": 2}]}}') == [{"a": 2}]
    assert run(spark, "SELECT a FROM rows", '{"rows": [{"a": 1}]}') == [{"a": 1}]
    assert run(spark, "SELECT home FROM $r WHERE id = 1") == [{"home": {"city": "Oslo"}}]
    assert run(spark, "SELECT name AS who.name, id AS who.id FROM $r WHERE id = 2") == [{"who": {"name": "Bob", "id": 2}}]
    big = run(spark, "SELECT n FROM $r", '[{"n": 12345678901234567890123}]')
    assert big == [{"n": 12345678901234567890123}]


def test_json_limits():
    for bad in ('{"a": 1,}', '{"a": 1, "a": 2}', "[NaN]", "[1] x", ""):
        with pytest.raises(ExecutionError):
            parse_json(bad)
    assert parse_json('{"a": 1, "a": 2}', JsonLimits(duplicate_keys=DuplicateKeys.LAST_WINS)) == {"a": 2}
    assert parse_json('{"a": 1, "a": 2}', JsonLimits(duplicate_keys=DuplicateKeys.FIRST_WINS)) == {"a": 1}
    for text, limits in (("[[[1]]]", JsonLimits(depth=2)), ('["abc"]', JsonLimits(string=2)), ("[1234]", JsonLimits(number=3)), ('{"abc": 1}', JsonLimits(key=2)), ("[1, 2]", JsonLimits(array=1)), ("[1]", JsonLimits(length=2))):
        with pytest.raises(ExecutionError):
            parse_json(text, limits)
    assert parse_json('["[[[["]', JsonLimits(depth=1)) == ["[[[["]


@pytest.mark.parametrize("sql", [
    "", "SELECT", "SELECT a FROM $r WHERE", "SELECT a b FROM $r", "SELECT a FROM $r OFFSET 2", "SELECT a FROM $r LIMIT -1", "SELECT NOPE(a) FROM $r", "SELECT LEFT(a) FROM $r", "SELECT RANK() FROM $r", "SELECT a FROM $r WHERE b < ARRAY[1]",
    "SELECT a FROM x JOIN y ON x.a > y.a", "SELECT a FROM x JOIN x ON x.a = x.a", "SELECT a FROM $r WHERE COUNT(*) > 1", "SELECT a FROM $r WHERE RANK() OVER (ORDER BY a) > 1", "SELECT a FROM $r WHERE b IN (c)", "SELECT a FROM $r WHERE b = UPPER(c)", "SELECT a FROM $r WHERE b = :x AND c = ?", "SELECT a FROM $r; SELECT", "SELECT a FROM $r WHERE a # 1", "SELECT SUM(*) FROM $r",
])
def test_parse_errors(sql):
    with pytest.raises(ParseError):
        parse(sql)


def test_error_place_and_limits():
    with pytest.raises(ParseError) as x:
        parse("SELECT a\nFROM $r\nWHERE a ~ 1")
    assert (x.value.line, x.value.column) == (3, 9)
    for sql, limits in (("SELECT a FROM $r", Limits(sql_length=5)), ("SELECT a FROM (SELECT a FROM (SELECT a FROM $r))", Limits(subquery_depth=1)), ("SELECT a FROM $r WHERE a IN (1, 2, 3)", Limits(in_list=2)), ("SELECT a FROM $r WHERE a = ? AND b = ?", Limits(parameters=1)), ("SELECT a FROM $r WHERE a LIKE '%a%b%'", Limits(like_wildcards=2))):
        with pytest.raises(ParseError):
            parse(sql, limits)
    assert [t.kind for t in scan("SELECT x # 'a'")] == ["keyword", "word", "bad", "string"]


def test_parameters(spark):
    sql = "SELECT id FROM (SELECT id, team FROM $r WHERE pay > :p) WHERE team IN (:t) ORDER BY id LIMIT :n"
    assert column(spark, sql, params={"p": 60, "t": ["x", "y"], "n": 5, "unused": 1}) == [1, 4]
    assert column(spark, "SELECT id FROM $r WHERE tags && :t", params={"t": ["c"]}) == [4]
    assert column(spark, "SELECT id FROM $r WHERE tags @> ARRAY[?, ?]", params=["a", "b"]) == [1]
    for params in (None, {}, {"p": 1, "t": ["x"], "n": -1}, {"p": [1, 2], "t": ["x"], "n": 1}, {"p": object(), "t": ["x"], "n": 1}, [1, 2, 3]):
        with pytest.raises(BindError):
            prepare(sql).run(spark, PEOPLE, params)


def test_engine_cache_and_limits(spark):
    engine = Engine(spark, Settings(cached_results=1)).root(PEOPLE)
    a = engine.query("SELECT id FROM $r")
    assert engine.query("SELECT id FROM $r") is a
    engine.query("SELECT NOW() AS t FROM $r")
    engine.query("SELECT id FROM $r WHERE id = ?", [1])
    assert engine.cached == ["SELECT id FROM $r"]
    engine.query("SELECT team FROM $r")
    assert engine.cached == ["SELECT team FROM $r"]
    with pytest.raises(ExecutionError, match="more than 3 rows"):
        run(spark, "SELECT id FROM $r", settings=Settings(limits=Limits(rows=3)))
    with pytest.raises(ExecutionError, match="no column"):
        run(spark, "SELECT nope FROM $r", settings=Settings(strict_columns=True))
    with pytest.raises(ExecutionError, match="^the query failed$"):
        run(spark, "SELECT nope FROM $r", settings=Settings(strict_columns=True, redact_errors=True))


class Team(Enum):
    X = "x"
    Y = "y"


@dataclass
class Home:
    city: str


@dataclass
class Person:
    id: int
    team: Team | None
    tags: list[str]
    home: Home | None = None


def test_mapping(spark):
    df = query(spark, "SELECT id, team, tags, home FROM $r ORDER BY id", PEOPLE)
    people = sinks.to_objects(df, Person)
    assert people[0] == Person(1, Team.X, ["a", "b"], Home("Oslo")) and people[2].team is None
    with pytest.raises(MappingError):
        sinks.to_object(df, Person)
    with pytest.raises(MappingError):
        sinks.convert({"id": "x", "team": "x", "tags": []}, Person)
    with pytest.raises(MappingError):
        sinks.convert({"team": "x", "tags": []}, Person, Settings(missing_fields=MissingFields.FAIL))
    assert sinks.convert({"tags": None}, Person).id == 0
    assert sinks.convert("2024-01-02", dt.date) == dt.date(2024, 1, 2)


def test_command_line(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps(PEOPLE))
    out, err = io.StringIO(), io.StringIO()
    at = str(tmp_path / "p.json")
    call = lambda *a, stdin="": cli.main(list(a), io.StringIO(stdin), out, err, spark)
    assert call("-q", "SELECT id FROM $r WHERE team = :t ORDER BY id", "-f", at, "--param", "t=y") == 0
    assert call("-q", "SELECT a.id AS i FROM a JOIN b ON a.id = b.id WHERE b.id = :n", "--data", f"a={at}", "--data", f"b={at}", "--param", "n=3", "-o", str(tmp_path / "o.json"), "--pretty") == 0
    assert call("-q", "SELECT a FROM $r", stdin='{"a": 1}') == 0
    assert out.getvalue().splitlines() == ['[{"id":2}]', '[{"a":1}]'] and json.loads((tmp_path / "o.json").read_text()) == [{"i": 3}]
    assert call("-q", "SELECT", "-f", at) == 1 and call("-q", "SELECT a FROM $r", "-f", "/nowhere.json") == 1
    assert call("--pretty") == 2 and call("-q", "x", "--param", "y") == 2 and call("-q", "x", "-f", at, "--data", f"a={at}") == 2 and call("-v") == 0


def test_files(spark, tmp_path):
    df = query(spark, "SELECT id, name, home FROM $r", PEOPLE)
    sinks.write_json(df, str(tmp_path / "out.jsonl"))
    from nestquery.sources import read_file

    back = read_file(spark, str(tmp_path / "out.jsonl"))
    assert sorted(r.id for r in back.collect()) == [1, 2, 3, 4] and back.filter(F.col("home").isNull()).count() == 2
    assert json.loads(query_json(spark, "SELECT id, name FROM $r WHERE id = 3", back)) == [{"id": 3, "name": None}]


def test_stream(spark, tmp_path):
    source = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id long, k string")
    source.write.parquet(str(tmp_path / "in"))
    frames = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    q = stream("SELECT k, COUNT(*) AS n FROM $r WHERE id < :most GROUP BY k", frames, {"most": 3}).writeStream.outputMode("complete").format("memory").queryName("counted").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("counted").collect())) == [("a", 1), ("b", 1)]
    for sql in ("SELECT id FROM $r ORDER BY id", "SELECT id FROM $r LIMIT 1", "SELECT RANK() OVER (ORDER BY id) AS r FROM $r"):
        with pytest.raises(ExecutionError):
            stream(sql, frames)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, tmp_path):
    """Filters and columns reach the scan, and nothing runs in Python."""
    path = str(tmp_path / "t")
    spark.range(100).select("id", (F.col("id") % 7).alias("k"), F.lit("x").alias("wide")).write.parquet(path)
    df = spark.read.parquet(path)
    p = plan(query(spark, "SELECT a.id AS id FROM a JOIN b ON a.k = b.k WHERE a.id > 5 AND b.id < 9", {"a": df, "b": df}))
    assert "GreaterThan(id,5)" in p and "LessThan(id,9)" in p and "wide" not in p and "Python" not in p
    assert "TakeOrderedAndProject" in plan(query(spark, "SELECT id FROM $r ORDER BY k DESC, id LIMIT 5", df))
    p = plan(query(spark, "SELECT id, SUM(k) OVER () AS s FROM $r", df))
    assert "Window" not in p and "wide" not in p
    assert "monotonically" not in plan(query(spark, "SELECT DISTINCT k AS kind FROM $r ORDER BY kind DESC", df))
    assert "monotonically" in plan(query(spark, "SELECT DISTINCT k FROM $r ORDER BY id", df))
    assert from_json(spark, "[]").count() == 0


def test_distinct_in_order(spark):
    assert column(spark, "SELECT DISTINCT team AS a.b FROM $r ORDER BY team DESC") == [{"b": "y"}, {"b": "x"}, {"b": None}]
    assert column(spark, "SELECT DISTINCT UPPER(team) AS t FROM $r ORDER BY t") == [None, "X", "Y"]


def test_catalogue():
    names = {f.name: f for f in catalogue.functions()}
    assert {"LPAD", "SUM", "NTILE", "CAST"} <= set(names) and (names["LPAD"].least, names["LPAD"].most, names["CONCAT"].most) == (3, 3, None)
    assert {"SELECT", "CONTAINS"} <= set(catalogue.keywords())
    assert [t.text for t in catalogue.tokenize("SELECT a ~ 'x")] == ["SELECT", "a", "~", "'", "x"]
    for f in catalogue.functions():  # all are known to the parser
        args = ", ".join(["a"] * f.least)
        parse(f"SELECT {f.name}({args}){' OVER (ORDER BY a)' if f.kind == 'window' else ''} AS x FROM $r" if f.name != "CAST" else "SELECT CAST(a AS STRING) AS x FROM $r")


MIXED = [{"id": 1, "tags": [1, "a", True]}, {"id": 2, "tags": [5]}, {"id": 3, "tags": ["x"]}, {"id": 4, "tags": "x"}, {"id": 5, "tags": None}, {"id": 6, "tags": [None, "x"]}, {"id": 7, "tags": []}]


@pytest.mark.parametrize("where, ids", [
    ("tags CONTAINS 'a'", [1]), ("tags CONTAINS 1", [1]), ("tags CONTAINS TRUE", [1]), ("tags CONTAINS 'x'", [3, 6]), ("tags @> ARRAY['a', 1]", [1]), ("tags <@ ARRAY['x', 5]", [2, 3, 7]), ("tags && ARRAY[5, 'a']", [1, 2]), ("tags = ARRAY[1, 'a', TRUE]", [1]), ("tags = ARRAY['x']", [3]), ("tags != ARRAY['x']", [1, 2, 6, 7]), ("tags IS NULL", [5]),
])
def test_arrays_of_several_types(spark, where, ids):
    assert sorted(column(spark, f"SELECT id FROM $r WHERE {where}", data=MIXED)) == ids


@pytest.mark.parametrize("where", ["tags CONTAINS 'a'", "tags @> ARRAY['a', 1]", "tags <@ ARRAY['x', 5]", "tags && ARRAY[5, 'a']", "tags = ARRAY[1, 'a', TRUE]"])
def test_elements_of_several_types_are_read_once(spark, where):
    """Not once for each element that they are compared with, and not in each step of a comparison."""
    df = spark.range(9).select("id", F.array(F.col("id").cast("variant"), F.lit("a").cast("variant")).alias("tags"))
    p = plan(query(spark, f"SELECT id FROM $r WHERE {where}", df))
    assert p.count("SchemaOfVariant.schemaOfVariant") == 1 and p.count("DoubleType") == 1 and "exists" not in p


@pytest.mark.parametrize("where, ids", [
    ("a <@ b", [1, 2, 5]), ("b @> a", [1, 2, 5]), ("a && b", [1, 2, 3, 6]), ("a = b", [1, 5]), ("a != b", [2, 3, 4, 6, 7, 8]), ("a @> ARRAY['1', NULL]", []), ("a @> ARRAY[]", [1, 2, 3, 4, 5, 6, 7, 8]), ("a <@ ARRAY[0, 1, '1', NULL]", [1, 4, 5]), ("b CONTAINS 0.0", [1, 6]),
])
def test_sets_of_several_types(spark, where, ids):
    pairs = ["1, -0.0D, '1' | 1D, 0, '1'", "2, 2, 'x' | 'x', 2, 3", "1, parse_json('null') | parse_json('null'), 1.0BD", "1 | '1'", " | ", "parse_json('[1]'), 0 | parse_json('[1]'), 0", "NULL | NULL", "DATE'2024-01-02' | '2024-01-02', TIMESTAMP_NTZ'2024-01-02 00:00:00'"]
    array = lambda x: f"CAST(array({', '.join(f'CAST({i} AS VARIANT)' for i in x.strip().split(', ') if i)}) AS array<variant>)"
    rows = [f"SELECT {k} AS id, {array(a)} AS a, {array(b)} AS b" for k, (a, b) in enumerate((p.split(" | ") if p.strip() != "|" else ("", "") for p in pairs), 1)]
    df = spark.sql(" UNION ALL ".join(rows))
    assert sorted(r.id for r in query(spark, f"SELECT id FROM $r WHERE {where}", df).collect()) == ids


def test_sets_of_binary(spark):
    df = spark.sql("SELECT 1 AS id, array(CAST(X'01' AS VARIANT)) AS a, array(CAST(X'01' AS VARIANT)) AS b UNION ALL SELECT 2, array(CAST(X'01' AS VARIANT)), array(CAST(X'02' AS VARIANT))")
    for where in ("a && b", "a @> b", "a <@ b", "a = b"):
        assert [r.id for r in query(spark, f"SELECT id FROM $r WHERE {where}", df).collect()] == [1]


@pytest.mark.parametrize("where, ids", [
    ("d @> ARRAY[0.0]", [1, 2]), ("d && n", [1, 2]), ("n <@ d", [1, 3]), ("d = ARRAY[0, 1.5]", [1]), ("n != d", [1, 2, 3]), ("n = n", [1, 3]), ("n <@ n", [1, 3]), ("n @> ARRAY[0]", [1, 2]), ("n <@ ARRAY['0']", [3]), ("n CONTAINS NULL", []),
])
def test_sets_of_one_type(spark, where, ids):
    df = spark.sql("SELECT 1 AS id, array(-0.0D, 1.5D) AS d, array(0) AS n UNION ALL SELECT 2, array(0D, NULL), array(0, NULL) UNION ALL SELECT 3, array(double('NaN')), CAST(array() AS array<int>) UNION ALL SELECT 4, NULL, NULL")
    assert sorted(r.id for r in query(spark, f"SELECT id FROM $r WHERE {where}", df).collect()) == ids


def test_nested_values_as_null(spark):
    assert sorted(column(spark, "SELECT id FROM $r WHERE tags IS NOT NULL", data=MIXED)) == [1, 2, 3, 4, 6, 7]
    loose = query(spark, "SELECT id FROM $r WHERE tags IS NOT NULL", MIXED, settings=Settings(nested_is_null=True))
    assert sorted(r.id for r in loose.collect()) == [4]


def test_distinct_of_several_types(spark):
    rows = [{"v": 1}, {"v": "1"}, {"v": 1}, {"v": [1]}, {"v": [2]}, {"v": [1]}, {"v": None}, {"v": 1.0}]
    for sql in ("SELECT DISTINCT v FROM $r", "SELECT DISTINCT v FROM $r ORDER BY v LIMIT 20", "SELECT DISTINCT v FROM $r ORDER BY v"):
        assert sorted(map(repr, column(spark, sql, data=rows))) == sorted(map(repr, [1, "1", [1], [2], None]))
    assert column(spark, "SELECT DISTINCT v FROM $r WHERE v = 1 OR v = '1' ORDER BY v DESC", data=rows) == ["1", 1]


def test_results_of_case_keep_their_type(spark):
    rows = [{"v": 1}, {"v": 2}, {"v": 3}, {"v": None}]
    assert column(spark, "SELECT CASE v WHEN 1 THEN 10 WHEN 2 THEN 'two' WHEN 3 THEN TO_DATE('2024-01-02') END AS c FROM $r ORDER BY v", data=rows) == [None, 10, "two", "2024-01-02"]
    assert column(spark, "SELECT COALESCE(v, 'none') AS c FROM $r ORDER BY v", data=rows) == ["none", 1, 2, 3]
    assert column(spark, "SELECT c FROM (SELECT CASE WHEN v = 1 THEN TO_DATE('2024-01-02') ELSE 'x' END AS c FROM $r) WHERE c > TO_DATE('2024-01-01')", data=rows) == ["2024-01-02"]


def test_names_that_differ_in_case(spark):
    rows = '[{"a": 1, "A": 2, "b": {"c": 3, "C": 4}}]'
    assert run(spark, "SELECT A, a, b.C AS x FROM $r WHERE a = 1 AND A = 2", rows) == [{"A": 2, "a": 1, "x": 4}]
    assert run(spark, "SELECT * FROM $r", rows) == [{"a": 1, "A": 2, "b": {"c": 3, "C": 4}}]


def test_named_sources_are_told_apart(spark):
    assert run(spark, "SELECT note FROM $r", {"note": "[draft] hello"}) == [{"note": "[draft] hello"}]
    assert run(spark, "SELECT x.a AS a FROM x", Sources(x='[{"a": 1}]')) == [{"a": 1}]
    assert run(spark, "SELECT x.a AS a FROM x", Sources(x=[{"a": 1}])) == [{"a": 1}]


def test_json_files_of_any_size(spark, tmp_path):
    """Strictness, repeated keys and values of several types don't depend on the size of a file."""
    some = ['{"id": 1, "v": 1}', '{"id": 2, "v": "1"}', '{"id": 3, "v": null}']
    for extra in (0, 11_000):
        text = "[" + ",".join(some + [f'{{"id": {i + 10}, "v": "{"x" * 1000}"}}' for i in range(extra)]) + "]"
        path = tmp_path / f"rows{extra}.json"
        path.write_text(text)
        out = io.StringIO()
        assert cli.main(["-q", "SELECT id, v FROM $r WHERE v = 1", "-f", str(path)], stdout=out, spark=spark) == 0
        assert json.loads(out.getvalue()) == [{"id": 1, "v": 1}]
        path.write_text(text[:-1] + ',{"id": 5, "id": 6}]')
        err = io.StringIO()
        assert cli.main(["-q", "SELECT id FROM $r", "-f", str(path)], stdout=io.StringIO(), stderr=err, spark=spark) == 1
        assert "twice" in err.getvalue()


def test_json_column(spark):
    rows = [('{"k": 1}',), (None,), ('[{"k": "a"}, {"j": [1, "x"]}]',), ("7",)]
    df = from_json_column(spark.createDataFrame(rows, "props string"), "props")
    assert column(spark, "SELECT k FROM $r WHERE k = 'a' OR k = 1 ORDER BY k", data=df) == [1, "a"]
    assert column(spark, "SELECT j FROM $r WHERE j CONTAINS 'x'", data=df) == [[1, "x"]]
    assert from_json_column(spark.createDataFrame([(None,)], "props string"), "props").count() == 0
    with pytest.raises(ExecutionError):
        from_json_column(spark.createDataFrame([("{x",)], "props string"), "props")


def test_codec_and_cache_of_ones_own(spark):
    class Kept(dict):
        def put(self, sql, result):
            self[sql] = result

    kept = Kept()
    engine = Engine(spark, Settings(codec=lambda s: [{"v": s}], result_cache=kept)).root("some text")
    first = engine.query("SELECT v FROM $r")
    assert [r.v for r in first.collect()] == ["some text"] and list(kept) == ["SELECT v FROM $r"]
    assert engine.query("SELECT v FROM $r") is first
    engine.query("SELECT v FROM $r WHERE v = :x", {"x": "y"})
    assert len(kept) == 1
    engine.root("other")
    assert len(kept) == 0


def test_further_units_of_time(spark):
    sql = "SELECT DATE_DIFF(TO_DATE('2024-01-02T00:00:01'), TO_DATE('2024-01-02T00:00:00'), 'MILLIS') AS a, DATE_ADD(TO_DATE('2024-01-02'), 2, 'DECADES') AS b, DATE_DIFF(TO_DATE('1990-01-02'), TO_DATE('2024-01-01'), 'DECADES') AS c, DATE_DIFF(TO_DATE('2024-01-02T13:00:00'), TO_DATE('2024-01-02T00:00:00'), 'HALF_DAYS') AS d FROM $r"
    assert run(spark, sql, [{"x": 1}]) == [{"a": 1000, "b": dt.date(2044, 1, 2), "c": -3, "d": 1}]
