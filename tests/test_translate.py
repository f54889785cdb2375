import pytest
from docmill.functions.values import QueryError
from docmill.plans.sql import translated

from .engine_helpers import bag, filled

STATEMENTS = [
    "SELECT * FROM users",
    "SELECT name, age + 1 AS next FROM users WHERE age >= 20 AND city IN ('Oslo', 'Rome') ORDER BY next DESC LIMIT 2",
    "SELECT u.name n FROM users AS u WHERE u.age IS NOT NULL AND u.name LIKE 'A%' OR u.city IS NULL",
    "SELECT city, COUNT(*) AS n, SUM(age) AS s FROM users WHERE age BETWEEN 1 AND 100 GROUP BY city HAVING COUNT(*) > 1 ORDER BY n",
    "SELECT COUNT(*) AS n, MAX(total) AS m FROM orders",
    "SELECT u.name, o.total FROM users u JOIN orders o ON o.user_key = u._key WHERE o.total > 5 ORDER BY o.total LIMIT 5 OFFSET 1",
    "SELECT u._key AS k, o.total AS t FROM users u LEFT JOIN orders o ON o.user_key = u._key",
    "SELECT _key FROM users WHERE NOT (age < 25) AND age NOT IN (30) AND age <> 1",
    "SELECT upper(name) || '!' AS loud FROM users WHERE name = 'Ann'",
]


@pytest.fixture(scope="module")
def e(spark):
    return filled(spark)


@pytest.mark.parametrize("sql", STATEMENTS)
def test_translation_gives_the_rows_of_sql(e, sql):
    own, standard = e.query(translated(sql)), e.sql(sql)
    assert own.columns == standard.columns
    assert bag(map(tuple, own.collect())) == bag(map(tuple, standard.collect()))


@pytest.mark.parametrize("sql", ["SELECT", "SELECT a FROM", "DELETE FROM t", "SELECT a FROM t WHERE ?", "SELECT a FROM t extra words here"])
def test_what_cant_be_translated(sql):
    with pytest.raises(QueryError):
        translated(sql)


def test_text():
    assert translated("SELECT a FROM t WHERE b = :x LIMIT 3") == "FOR t IN t\nFILTER (t.b == @x)\nLIMIT 3\nRETURN {a: t.a}"
