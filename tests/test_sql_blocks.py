import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakework.operators.relational import run_statements, split_statements

BLOCK = """BEGIN
  DECLARE n INT DEFAULT 0;
  -- a comment; with a semicolon and END
  lbl: WHILE n < 3 DO SET n = n + CASE WHEN n > 1 THEN 1 ELSE 1 END; END WHILE lbl;
  IF n = 3 THEN SELECT 'a;b' AS x; ELSE SELECT if(n = 1, 'c', 'END') AS x; END IF;
END"""


def test_blocks_stay_whole():
    script = f"SELECT 1; {BLOCK}; SELECT 2;;\n-- only a comment;\n"
    assert list(split_statements(script)) == ["SELECT 1", BLOCK, "SELECT 2"]
    assert list(split_statements(f"{BLOCK};{BLOCK}")) == [BLOCK, BLOCK]
    assert list(split_statements(f"outer_name: {BLOCK}; SELECT 1")) == [f"outer_name: {BLOCK}", "SELECT 1"]


@pytest.mark.parametrize(
    "inner",
    [
        "LOOP SET x = 1; LEAVE a; END LOOP;", "REPEAT SET x = 1; UNTIL x > 2 END REPEAT;", "FOR r AS SELECT 1 AS v DO SELECT r.v; END FOR;",
        "CASE WHEN x = 1 THEN SELECT 1; ELSE SELECT 2; END CASE;", "CASE x WHEN 1 THEN SELECT 1; END CASE;", "BEGIN BEGIN SELECT 1; END; END;",
        "DECLARE EXIT HANDLER FOR SQLEXCEPTION BEGIN SELECT 'x;'; END;", "IF a THEN IF b THEN SELECT 1; END IF; ELSEIF c THEN SELECT 2; END IF;",
        "SELECT CASE WHEN a THEN repeat('x', 2) ELSE if(b, 1, 2) END, CASE b WHEN 1 THEN CASE WHEN c THEN 1 END END;", "SELECT `end`, \"BEGIN\", 'END;' /* END; */ -- END\n;",
        "IF (x > 1) THEN SET y = (SELECT count(CASE WHEN z THEN 1 END) FROM t); END IF;", "SELECT \"it's\"; SELECT 'say \\'END;\\' ';",
    ],
)
def test_every_kind_of_block(inner):
    block = f"BEGIN {inner} {inner} END"
    assert list(split_statements(f"SELECT 0; {block}; SELECT 9")) == ["SELECT 0", block, "SELECT 9"]


def test_words_of_blocks_mean_nothing_outside():
    assert list(split_statements("SELECT CASE WHEN a THEN 1 END; SELECT if(a, 1, 2); SELECT begin FROM t; SELECT 1 AS loop")) == [
        "SELECT CASE WHEN a THEN 1 END", "SELECT if(a, 1, 2)", "SELECT begin FROM t", "SELECT 1 AS loop",
    ]
    assert list(split_statements("")) == list(split_statements(" ; ;; -- x\n ;")) == []
    assert list(split_statements("BEGIN SELECT 1; SELECT 2")) == ["BEGIN SELECT 1; SELECT 2"]  # Spark tells what is missing


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["SELECT 1", "SELECT ';'", "SELECT `a;b`", BLOCK, "SELECT 2 -- c;d\n", "SELECT /* ; */ 3", 'SELECT "x;y"']), max_size=8))
def test_scripts_come_apart_as_they_were_put_together(parts):
    assert list(split_statements(";\n".join(parts))) == [p.strip() for p in parts]


def test_blocks_run(spark):
    assert [r["x"] for r in run_statements(spark, [f"SELECT 0; {BLOCK};"]).collect()] == ["a;b"]
    failing = "BEGIN DECLARE EXIT HANDLER FOR SQLEXCEPTION BEGIN SELECT 'caught' AS x; END; SELECT raise_error('no'); END"
    assert [r["x"] for r in run_statements(spark, [failing]).collect()] == ["caught"]
    spark.sql("CREATE OR REPLACE TEMPORARY VIEW block_rows AS SELECT CAST(NULL AS INT) AS v UNION ALL SELECT 1 UNION ALL SELECT 1")
    summed = "BEGIN DECLARE total INT DEFAULT 0; FOR r AS SELECT v FROM block_rows DO SET total = total + coalesce(r.v, 10); END FOR; SELECT total AS x; END"
    assert [r["x"] for r in run_statements(spark, [summed]).collect()] == [12]
    spark.sql("CREATE OR REPLACE TEMPORARY VIEW block_rows AS SELECT 1 AS v WHERE false")
    assert [r["x"] for r in run_statements(spark, [summed]).collect()] == [0]
