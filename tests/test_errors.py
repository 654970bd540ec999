import pytest

from graphs import company, rivers
from loomgraph.errors import BindingError, QueryError, UnsupportedError


@pytest.mark.parametrize(
    ("query", "error", "says"),
    [
        ("MATCH (a:Persn) RETURN a", BindingError, "Person"),
        ("MATCH (a:Person)-[:KNOWN]->(b) RETURN a", BindingError, "KNOWS"),
        ("MATCH (a:Person) RETURN a.nme", BindingError, "name"),
        ("MATCH (a:Person) RETURN b.name", BindingError, "b"),
        ("MATCH (a:Person) WHERE c.x = 1 RETURN a", BindingError, "c"),
        ("MATCH (a:Person) RETURN uper(a.name) AS x", UnsupportedError, "toupper"),
        ("MATCH (a:Person) RETURN left(a.name) AS x", QueryError, "arguments"),
        ("MATCH (a:Person:Company) RETURN a", UnsupportedError, "several labels"),
        ("MATCH (a:Company)-[:KNOWS]->(b) RETURN a", BindingError, "KNOWS"),
        ("MATCH (a:Person) RETURN a.name LIMIT -1", QueryError, "LIMIT"),
        ("MATCH (a:Person) RETURN a.name LIMIT $n", BindingError, "n"),
        ("MATCH (a:Person) WITH a.name RETURN 1 AS x", QueryError, "alias"),
        ("MATCH (a:Person) WITH a.name AS n RETURN a.age", BindingError, "a"),
        ("MATCH (a:Person) RETURN a.age + count(*) AS x", BindingError, "grouped"),
        ("MATCH (a:Person) WHERE count(a) > 1 RETURN a", QueryError, "aggregate"),
        ("MATCH (a:Person)-[:KNOWS]->(b) WHERE is_terminator(b.age > 3) RETURN a", QueryError, "variable-length"),
        ("MATCH (a:Person)-[:KNOWS*]->(b) WHERE is_terminator(b.age > a.age) RETURN a", QueryError, "target"),
        ("MATCH (a:Person)-[:KNOWS*]->(b) WHERE NOT is_terminator(b.age > 3) RETURN a", QueryError, "alone"),
        ("RETURN 1 AS x UNION RETURN 2 AS y", QueryError, "UNION"),
        ("UNWIND 3 AS x RETURN x", QueryError, "list"),
        ("RETURN duration('3 days') AS d", QueryError, "ISO"),
    ],
)
def test_errors_say_what_is_wrong(spark, query, error, says):
    with pytest.raises(error) as e:
        company(spark).cypher(query)
    assert says.lower() in str(e.value).lower()


def test_place_is_shown(spark):
    with pytest.raises(BindingError) as e:
        rivers(spark).cypher("MATCH (a:River)\nRETURN a.lenght AS x")
    assert "line 2" in str(e.value)
    assert "did you mean length" in str(e.value)
