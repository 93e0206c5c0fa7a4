"""What a tenant's own SQL may do, and what is refused before it runs."""

import pytest
from pyspark.errors import AnalysisException, ParseException

from footfall.plans.site_sql import MAX_LENGTH, site_sql


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("tenant")
    spark.range(8).selectExpr("if(id % 2 = 0, 'a', 'b') AS site_id", "id", "id % 3 AS kind").write.parquet(f"{base}/events")
    spark.range(8).selectExpr("if(id % 4 < 2, 'a', 'b') AS site_id", "id").write.parquet(f"{base}/sessions")
    spark.sql("CREATE OR REPLACE GLOBAL TEMP VIEW foreign_view AS SELECT 'other' AS site_id, 1 AS id")
    spark.range(3).selectExpr("id", "'other' AS secret_column").write.mode("overwrite").option("path", f"{base}/foreign").saveAsTable("foreign_t")
    spark.udf.register("my_udf", lambda x: "ran")

    def tables(session):
        return {"events": session.read.parquet(f"{base}/events"), "sessions": session.read.parquet(f"{base}/sessions")}

    yield lambda text, **more: site_sql(spark, text, "a", tables, **more)
    spark.sql("DROP TABLE foreign_t")


ALLOWED = [
    ("SELECT count(*) FROM events", [(4,)]),
    ("SELECT count(*) FROM EVENTS e, sessions s", [(16,)]),
    ("SELECT count(*) FROM `events` JOIN sessions USING (id)", [(2,)]),
    ("WITH c AS (SELECT id FROM events WHERE id > 2), d AS (SELECT max(id) AS m FROM c) SELECT m FROM d", [(6,)]),
    ("WITH events AS (SELECT id FROM sessions) SELECT count(*) FROM events", [(4,)]),
    ("SELECT id FROM events UNION SELECT id FROM sessions EXCEPT SELECT 5 INTERSECT SELECT id FROM events WHERE id = 2", [(0,), (1,), (2,), (4,), (5,), (6,)]),
    ("SELECT max(r) FROM (SELECT row_number() OVER (PARTITION BY kind ORDER BY id) AS r, ntile(2) OVER (ORDER BY id), percent_rank() OVER (ORDER BY id) FROM events)", [(2,)]),
    ("SELECT sum(x) FROM (SELECT sum(id) OVER (ORDER BY id RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS x FROM events)", [(18,)]),
    ("SELECT id FROM events e WHERE EXISTS (SELECT 1 FROM sessions s WHERE s.id = e.id) AND id IN (SELECT max(id) FROM sessions WHERE id < 5)", [(4,)]),
    ("SELECT (SELECT max(id) FROM sessions) AS m, explode(array(1, 2)) AS x", [(5, 1), (5, 2)]),
    ("SELECT v FROM events LATERAL VIEW explode(array(id, id)) t AS v WHERE id = 6", [(6,), (6,)]),
    ("SELECT c FROM events, LATERAL (SELECT count(*) AS c FROM sessions s WHERE s.id < events.id) WHERE id = 6", [(4,)]),
    ("SELECT x FROM explode(array(3)) AS t(x)", [(3,)]),
    ("SELECT * FROM VALUES (1, 'it; reflect(x)') AS t(a, b)", [(1, "it; reflect(x)")]),
    ("SELECT get_json_object('{\"a\":1}', '$.a'), typeof(1), if(true, 1, 2), extract(YEAR FROM DATE'2024-05-01')", [("1", "int", 1, 2024)]),
    ("SELECT transform(array(1, 2), x -> x + 1), filter(array(1), x -> x > 5)", [([2, 3], [])]),
    ("SELECT * FROM (SELECT kind, id FROM events) PIVOT (count(id) FOR kind IN (0, 1, 2))", [(2, 1, 1)]),
    ("SELECT kind, count(*) FROM events GROUP BY ROLLUP (kind) HAVING count(*) = 4 ORDER BY 1 LIMIT 3 OFFSET 0", [(None, 4)]),
    ("SELECT count(*) -- reflect('x')\n FROM events /* foreign_t */;", [(4,)]),
]


@pytest.mark.parametrize("text, rows", ALLOWED)
def test_reads(run, text, rows):
    assert sorted(map(repr, map(tuple, run(text).collect()))) == sorted(map(repr, rows))


REFUSED = [
    "SELECT * FROM foreign_t", "SELECT * FROM default.foreign_t", "SELECT * FROM spark_catalog.default.foreign_t", "SELECT * FROM `foreign_t`",
    "SELECT * FROM IDENTIFIER('default.foreign_t')", "SELECT * FROM IDENTIFIER('default.' || 'foreign_t')", "SELECT * FROM IDENTIFIER('events')",
    "SELECT id FROM events UNION ALL SELECT id FROM IDENTIFIER('foreign_t')", "SELECT (SELECT max(id) FROM foreign_t)",
    "WITH events AS (SELECT * FROM foreign_t) SELECT * FROM events", "SELECT * FROM events, foreign_t", "SELECT nope FROM foreign_t",
    "SELECT * FROM events WHERE id IN (SELECT id FROM foreign_t)", "SELECT * FROM global_temp.foreign_view", "SELECT * FROM events e JOIN (SELECT * FROM (TABLE foreign_t)) USING (id)",
    "SELECT reflect('java.lang.System', 'getProperty', 'user.dir')", "SELECT java_method('java.lang.System', 'lineSeparator')",
    "SELECT try_reflect('java.lang.System', 'getProperty', 'user.dir')", "SELECT REFLECT /* x */ ('java.lang.System', 'lineSeparator')",
    "SELECT `reflect`('java.lang.System', 'lineSeparator')", "SELECT IDENTIFIER('reflect')('java.lang.System', 'lineSeparator')",
    "SELECT system.builtin.reflect('java.lang.System', 'lineSeparator')", "SELECT id FROM events WHERE length(reflect('java.lang.System', 'lineSeparator')) > 0",
    "SELECT max(id) OVER (ORDER BY reflect('java.lang.System', 'lineSeparator')) FROM events", "SELECT transform(array(1), x -> reflect('java.lang.System', 'lineSeparator'))",
    "SELECT input_file_name() FROM events", "SELECT current_user()", "SELECT version()", "SELECT my_udf(1)", "SELECT raise_error('x')",
    "SELECT * FROM parquet.`/tmp`", "SELECT * FROM information_schema.tables", "SELECT xpath_string('<a/>', 'a')",
    "SELECT * FROM range(1000000000000)",
]


@pytest.mark.parametrize("text", REFUSED)
def test_refused(run, text):
    with pytest.raises((PermissionError, AnalysisException)) as told:
        run(text)
    assert "secret_column" not in str(told.value)
    if "my_udf" not in text and "information_schema" not in text and "parquet." not in text and "spark_catalog" not in text:
        assert isinstance(told.value, PermissionError)


@pytest.mark.parametrize("text", ["DROP TABLE foreign_t", "SELECT 1; SELECT 2", "INSERT INTO events SELECT 1", "SET x = 1", "EXPLAIN ANALYZE SELECT 1", "",
                                  "SELECT 1) AS x, (SELECT * FROM foreign_t", "SHOW TABLES", "/* c */ CREATE TABLE t AS SELECT 1"])
def test_only_one_query(run, text):
    with pytest.raises((ParseException, PermissionError, AnalysisException)):
        run(text).collect()


def test_values_are_bound_and_the_plan_can_be_shown(run):
    assert run("SELECT count(*) FROM events WHERE kind = {{k}}", variables={"k": "0 OR 1 = 1"}).columns == ["count(1)"]
    assert run("SELECT {{k}} AS k", variables={"k": "') FROM foreign_t --"}).first().k == "') FROM foreign_t --"
    assert "events" in run("SELECT count(*) FROM events", explain=True).first().plan
    with pytest.raises(ValueError):
        run("SELECT 1 --" + "x" * MAX_LENGTH)
    assert run("SELECT * FROM events", row_cap=3).count() == 3
