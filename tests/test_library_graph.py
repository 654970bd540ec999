"""Longer queries over a lending library: chained WITH, sibling aliases, time windows, citations as paths."""

import datetime as dt

import pytest

from graphs import rows
from loomgraph.sources.graph import PropertyGraph

DAY = dt.datetime(2025, 1, 1)


@pytest.fixture(scope="module")
def g(spark):
    day = lambda n: DAY + dt.timedelta(days=n)
    g = PropertyGraph(spark)
    g.add_nodes("Reader", spark.createDataFrame([(1, "Ada", 12), (2, "Ben", 40), (3, "Cy", 30), (4, "Dot", 8)], "id int, name string, age int"), "id")
    g.add_nodes("Book", spark.createDataFrame([(10, "Tides", 300), (11, "Moss", 120), (12, "Kites", 80), (13, "Ore", 500)], "id int, title string, pages int"), "id")
    loans = [(1, 10, 5, day(1)), (1, 11, 20, day(3)), (2, 10, 9, day(2)), (2, 13, 30, day(2)), (3, 11, 2, day(10)), (3, 10, 1, day(11)), (4, 12, 3, day(1)), (1, 12, 4, day(20))]
    g.add_edges("Reader", "BORROWED", "Book", spark.createDataFrame(loans, "r int, b int, days int, at timestamp"), "r", "b")
    return g.add_edges("Book", "CITES", "Book", spark.createDataFrame([(10, 11, 3), (11, 13, 1), (13, 10, 2), (10, 12, 5)], "a int, b int, w int"), "a", "b")


def test_books_in_common(g):
    q = """
MATCH (a:Reader)-[x:BORROWED]->(b:Book)<-[y:BORROWED]-(c:Reader) WHERE a.id < c.id
WITH a, c, count(b) AS common, sum(x.days + y.days) AS days, common * 100 AS score WHERE common > 1
RETURN a.name AS a, c.name AS c, common, days, score"""
    assert rows(g.cypher(q)) == [("Ada", "Cy", 2, 28, 200)]


def test_back_before_a_day(g):
    q = "MATCH (r:Reader)-[x:BORROWED]->(b:Book) WHERE x.at + duration({days: 6}) < datetime('2025-01-10T00:00:00') RETURN r.name AS r, b.title AS b"
    assert rows(g.cypher(q)) == [("Ada", "Tides"), ("Ben", "Ore"), ("Ben", "Tides"), ("Dot", "Kites")]


def test_lent_again_within_a_day(g):
    q = "MATCH (a:Reader)-[x:BORROWED]->(b:Book)<-[y:BORROWED]-(c:Reader) WHERE a.id < c.id AND abs(x.at - y.at) <= duration('P1D') RETURN a.name AS a, c.name AS c, b.title AS b"
    assert rows(g.cypher(q)) == [("Ada", "Ben", "Tides")]


def test_books_that_cite_in_a_circle(g):
    q = "MATCH p = (a:Book)-[:CITES*2..3]->(a) RETURN [n IN nodes(p) | n.id] AS ids, length(p) AS n"
    assert rows(g.cypher(q)) == [([10, 11, 13, 10], 3), ([11, 13, 10, 11], 3), ([13, 10, 11, 13], 3)]


def test_weights_along_citations(g):
    q = "MATCH p = (a:Book {id: 10})-[:CITES*1..3]->(b:Book) WHERE ALL(r IN relationships(p) WHERE r.w > 0) RETURN b.title AS b, length(p) AS n, reduce(t = 0, r IN relationships(p) | t + r.w) AS w"
    assert rows(g.cypher(q)) == [("Kites", 1, 5), ("Moss", 1, 3), ("Ore", 2, 4)]


def test_unwound_citations(g):
    q = "MATCH (a:Book {id: 11})-[t:CITES*1..2]->(b) UNWIND t AS r RETURN b.id AS b, r.src AS src, r.w AS w"
    assert rows(g.cypher(q)) == [(10, 11, 1), (10, 13, 2), (13, 11, 1)]


def test_conditional_sums(g):
    q = """
MATCH (r:Reader)-[x:BORROWED]->(b:Book)
WITH r, sum(CASE WHEN b.pages > 200 THEN x.days ELSE 0 END) AS thick, sum(x.days) AS total
RETURN r.name AS r, thick, total, total - thick AS thin ORDER BY r"""
    assert rows(g.cypher(q)) == [("Ada", 5, 29, 24), ("Ben", 39, 39, 0), ("Cy", 1, 3, 2), ("Dot", 0, 3, 3)]


def test_optional_readers(g):
    q = "MATCH (b:Book) OPTIONAL MATCH (b)<-[:BORROWED]-(r:Reader) WHERE r.age > 10 WITH b, count(DISTINCT r) AS n, collect(DISTINCT r.name) AS names RETURN b.title AS b, n, size(names) AS k"
    assert rows(g.cypher(q)) == [("Kites", 1, 1), ("Moss", 2, 2), ("Ore", 1, 1), ("Tides", 3, 3)]


def test_optional_with_the_readers_age(g):
    q = "MATCH (r:Reader) OPTIONAL MATCH (r)-[:BORROWED]->(b:Book) WHERE b.pages > r.age * 10 RETURN r.name AS r, b.title AS b"
    assert rows(g.cypher(q)) == [("Ada", "Tides"), ("Ben", "Ore"), ("Cy", None), ("Dot", None)]
    # rows that come from joins, and a search that starts from them
    q = "MATCH (r:Reader)-[:BORROWED]->(b:Book) WITH r, b WHERE b.pages < 100 OPTIONAL MATCH (b)<-[:CITES*1..2]-(c:Book) WHERE c.pages > r.age * 20 RETURN r.name AS r, c.title AS c"
    assert rows(g.cypher(q)) == [("Ada", "Ore"), ("Ada", "Tides"), ("Dot", "Ore"), ("Dot", "Tides")]


def test_lists_of_maps(g):
    q = "MATCH (r:Reader)-[x:BORROWED]->(b) WITH r, collect({book: b.id, days: x.days}) AS l WHERE any(i IN l WHERE i.days > 15) AND none(i IN l WHERE i.book = 13) RETURN r.name AS r"
    assert rows(g.cypher(q)) == [("Ada",)]


def test_text_compares_with_dates(spark):
    h = PropertyGraph(spark)
    h.add_nodes("Member", spark.createDataFrame([(1, "2024-11-30"), (2, "2025-02-01")], "id int, joined string"), "id")
    assert rows(h.cypher("MATCH (m:Member) WHERE m.joined > date('2025-01-01') RETURN m.id")) == [(2,)]
