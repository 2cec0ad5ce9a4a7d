"""Table functions: rows, odd arguments, errors before any row is read."""

import pytest

from webloom.plans import table_functions


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    table_functions.register(spark)


def test_chunks(spark):
    spark.createDataFrame([(1, " ".join(map(str, range(12)))), (2, "a  b"), (3, " "), (4, None)], "id int, t string").createOrReplaceTempView("tf")
    rows = [tuple(r) for r in spark.sql("select id, c.* from tf, lateral web_chunks(t, 5, 4) c order by 1, 2").collect()]
    assert rows == [(1, 0, "0 1 2 3 4"), (1, 1, "4 5 6 7 8"), (1, 2, "8 9 10 11"), (2, 0, "a  b")]


def test_select_and_links(spark):
    html = "<article><p>One <b>two</b><p>Three</article><a href=/x>go</a>"
    assert [tuple(r) for r in spark.sql(f"select * from web_select('{html}', 'article > p')").collect()] == [(0, "p", "One two"), (1, "p", "Three")]
    assert spark.sql("select * from web_select(null, 'p')").count() == 0
    assert [r.url for r in spark.sql(f"select * from web_links('https://a.org/b', '{html}')").collect()] == ["https://a.org/x"]


@pytest.mark.parametrize("call", ["web_chunks(1)", "web_chunks('a', 0)", "web_chunks('a', 'b')", "web_select('a', ' ')", "web_links(1, 'a')"])
def test_wrong_arguments_fail_at_analysis(spark, call):
    with pytest.raises(Exception, match="must be"):
        spark.sql(f"select * from {call}")
