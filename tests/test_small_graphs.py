import pytest
from pyspark.sql import functions as F

from graphs import column, company, links, locks, rivers, rows, shop, store
from loomgraph.errors import BindingError
from loomgraph.operators.frames import edge_frame
from loomgraph.operators.paths import distances


def test_single_hops(spark):
    g = rivers(spark)
    assert column(g.cypher("MATCH (a {node_id: 'Bode'})-[:FLOWS]->(b) RETURN b.node_id")) == ["Cher"]
    assert column(g.cypher("MATCH (a {node_id: 'Cher'})<-[:FLOWS]-(b) RETURN b.node_id")) == ["Bode", "Dill"]
    assert column(g.cypher("MATCH (a)-[:FLOWS|CANAL]->(b {node_id: 'Bode'}) RETURN a.node_id")) == ["Aller", "Enns"]
    assert column(g.cypher("MATCH (a {node_id: 'Enns'})-->(b) RETURN b.node_id")) == ["Bode"]
    assert column(g.cypher("MATCH (a {node_id: 'Enns'})--(b) RETURN b.node_id")) == ["Bode", "Cher", "Fils"]


def test_tolls(spark):
    roads = [("P", "Q", "ROAD", 4), ("Q", "R", "ROAD", 9), ("P", "S", "ROAD", 2), ("S", "Q", "ROAD", 1), ("R", "T", "ROAD", 3), ("T", "S", "ROAD", 7)]
    g = store(spark, [(n, "Town") for n in "PQRST"], roads, edge_schema="src string, dst string, relationship_type string, toll int")
    q = "MATCH p = (a {node_id: 'P'})-[r:ROAD*1..3]->(b) RETURN b.node_id AS b, length(p) AS n, reduce(s = 0, x IN relationships(p) | s + x.toll) AS total"
    assert rows(g.cypher(q)) == [("Q", 1, 4), ("Q", 2, 3), ("R", 2, 13), ("R", 3, 12), ("S", 1, 2), ("T", 3, 16)]
    assert rows(g.cypher("MATCH (a {node_id: 'P'})-[r:ROAD*1..3]->(b) RETURN b.node_id AS b, size(r) AS n", vlp_mode="reachability")) == [("Q", 1), ("R", 1), ("S", 1), ("T", 1)]
    assert rows(g.cypher("MATCH p = (a {node_id: 'P'})-[r:ROAD*1..3]->(b) WHERE ALL(x IN relationships(p) WHERE x.toll >= 4) RETURN b.node_id")) == [("Q",), ("R",)]
    assert rows(g.cypher("MATCH (a {node_id: 'P'})-[r:ROAD*2 {toll: 9}]->(b) RETURN b.node_id")) == []
    assert rows(g.cypher("MATCH (a)-[r:ROAD]->(b) WHERE r.toll IN [1, 7, null] RETURN a.node_id AS a, r.toll AS t")) == [("S", 1), ("T", 7)]


def test_terminator_and_edge_predicate(spark):
    g = locks(spark)
    reach = lambda w: column(g.cypher(f"MATCH p = (a {{node_id: 'K1'}})-[:WAY*1..5]->(b) {w} RETURN DISTINCT b.node_id"))
    assert reach("") == ["K2", "K3", "K4", "K5", "K6", "K7"]
    assert reach("WHERE ALL(r IN relationships(p) WHERE NOT r.from_gate)") == ["K2", "K3"]
    assert reach("WHERE ALL(r IN relationships(p) WHERE NOT r.from_gate) AND b.gate = true") == ["K3"]
    assert reach("WHERE is_terminator(b.gate = true)") == ["K2", "K3"]
    assert reach("WHERE is_terminator(b.node_id = 'K6')") == ["K2", "K3", "K4", "K5", "K6"]


def test_self_loops(spark):
    g = links(spark, ["u v", "u u"])
    assert column(g.cypher("MATCH (a {node_id: 'u'})-[:WAY]-(b) RETURN b.node_id")) == ["u", "v"]
    assert column(g.cypher("MATCH (a {node_id: 'u'})-[:WAY*1..3]-(b) RETURN b.node_id")) == ["v"]
    assert column(g.cypher("MATCH (a)-[:WAY]->(a) RETURN a.node_id")) == ["u"]


def test_circles(spark):
    g = links(spark, ["A B", "B C", "C A", "C D"])
    assert column(g.cypher("MATCH (a)-[:WAY*2..4]->(a) RETURN a.node_id")) == ["A", "B", "C"]
    assert column(g.cypher("MATCH (a)-[:WAY]->(b)-[:WAY]->(c)-[:WAY]->(a) RETURN a.node_id")) == ["A", "B", "C"]
    assert column(g.cypher("MATCH (a)-[:WAY*4..4]->(a) RETURN a.node_id")) == []


def test_zero_length_once(spark):
    g = links(spark, ["A B", "B C"])
    assert rows(g.cypher("MATCH (a {node_id: 'A'})-[:WAY*0..2]->(b) RETURN b.node_id")) == [("A",), ("B",), ("C",)]


def test_paths_of_several_parts(spark):
    g = links(spark, ["A B", "B C", "C D", "D E"])
    got = g.cypher("MATCH p = (a {node_id: 'A'})-[:WAY]->(b)-[:WAY*1..2]->(c)-[:WAY]->(d) RETURN nodes(p) AS n, length(p) AS l, [r IN relationships(p) | r.dst] AS r")
    assert rows(got) == [(["A", "B", "C", "D", "E"], 4, ["B", "C", "D", "E"]), (["A", "B", "C", "D"], 3, ["B", "C", "D"])]
    assert rows(g.cypher("MATCH p = (x {node_id: 'D'})<-[:WAY*1..2]-(y) RETURN nodes(p)")) == [(["D", "C", "B"],), (["D", "C"],)]


def test_two_searches_in_one_pattern(spark):
    g = links(spark, ["A B", "B C", "C D"])
    assert rows(g.cypher("MATCH (a {node_id: 'A'})-[:WAY*1..2]->(b)-[:WAY*1..2]->(c) RETURN b.node_id AS b, c.node_id AS c")) == [("B", "C"), ("B", "D"), ("C", "D")]


def test_unreachable(spark):
    g = links(spark, ["a b", "b c", "c d", "b e", "e d", "d a", "x y"])
    q = "MATCH p = (a {node_id: 'a'})-[:WAY*1..5]->(b {node_id: '%s'}) RETURN length(p) AS n"
    for mode in ("off", "auto", "on"):
        assert column(g.cypher(q % "d", bidirectional=mode)) == [3, 3]
        assert column(g.cypher(q % "y", bidirectional=mode)) == []


@pytest.mark.parametrize("shift", [1, 4, 9])
def test_search_from_both_ends_agrees(spark, shift):
    """Three ways out of each of 23 places: paths of all modes equal a plain search."""
    to = {i: {(7 * i + shift) % 23, (5 * i + 1) % 23, (i + shift) % 23} - {i} for i in range(23)}
    g = store(spark, [(f"p{i}", "Place") for i in to], [(f"p{i}", f"p{j}", "WAY") for i, js in to.items() for j in js])

    def walk(path, least, most, near):
        if path[-1] == 11 and least < len(path) <= most + 1:
            yield [f"p{i}" for i in path]
        if len(path) <= most:
            for j in near[path[-1]]:
                if j not in path:
                    yield from walk([*path, j], least, most, near)

    # both directions of a way that exists twice are two relationships
    both = {i: [*js, *(j for j in to if i in to[j])] for i, js in to.items()}
    for arrow, least, most, near in (("-[:WAY*1..4]->", 1, 4, to), ("-[:WAY*2..3]-", 2, 3, both)):
        want = sorted(((p,) for p in walk([0], least, most, near)), key=repr)
        for mode in ("off", "auto"):
            got = g.cypher(f"MATCH p = (a {{node_id: 'p0'}}){arrow}(b {{node_id: 'p11'}}) RETURN nodes(p) AS n", bidirectional=mode)
            assert rows(got) == want


def test_ladder_counts(spark):
    """From the top of a ladder's left to the bottom of its right there is one way for each rung, of the same length."""
    n = 5
    ways = [(f"{side}{i}", f"{side}{i + 1}", "WAY") for side in "lr" for i in range(n - 1)] + [(f"l{i}", f"r{i}", "WAY") for i in range(n)]
    g = store(spark, [(f"{side}{i}", "Step") for side in "lr" for i in range(n)], ways)
    q = "MATCH p = (a {node_id: 'l0'})-[:WAY*1..6]->(b {node_id: 'r4'}) RETURN length(p) AS len, count(*) AS n"
    assert [rows(g.cypher(q, bidirectional=m)) for m in ("off", "auto", "on")] == [[(5, 5)]] * 3


def test_pruned_reachability(spark):
    """With both ends fixed a search for reachable nodes comes from the back first; the result is the same."""
    g = rivers(spark)
    q = "MATCH p = (a {node_id: 'Gera'})-[:FLOWS|CANAL*1..6]->(b {node_id: 'Bode'}) RETURN b.node_id AS b, length(p) AS n"
    for vlp_mode in ("reachability", "procedural"):
        assert [rows(g.cypher(q, vlp_mode=vlp_mode, bidirectional=m)) for m in ("off", "auto", "on")] == [[("Bode", 4)]] * 3
    assert "from both ends" in g.plan(q, vlp_mode="procedural") and "from both ends" not in g.plan(q, vlp_mode="procedural", bidirectional="off")
    near = distances(spark.createDataFrame([("Bode",)], "k string"), edge_frame(g, list(g.edges.values())).select(F.col("f.id").alias("f"), F.col("t.id").alias("t")), 2)
    assert rows(near) == [("Aller", 1), ("Bode", 0), ("Cher", 2), ("Enns", 1), ("Fils", 2)]


def test_tables_with_overlapping_ids(spark):
    g = company(spark)
    assert rows(g.cypher("MATCH (a:Person)-[w:WORKS_AT]->(c:Company) RETURN a.name AS a, c.name AS c, w.role AS r")) == [("Ann", "Acme", "dev"), ("Ben", "Acme", "ops"), ("Cid", "Beta", None)]
    assert rows(g.cypher("MATCH (a:Person {name: 'Ann'})-[r]->(x) RETURN type(r) AS t, x.name AS x")) == [("KNOWS", "Ben"), ("WORKS_AT", "Acme")]
    assert rows(g.cypher("MATCH (n) RETURN labels(n)[0] AS l, count(*) AS n")) == [("Company", 2), ("Person", 3)]
    # mixed labels in one search: keys are label and id
    assert rows(g.cypher("MATCH (a:Person {name: 'Ann'})-[:KNOWS|WORKS_AT*1..3]->(x:Company) RETURN x.name AS x")) == [("Acme",), ("Acme",), ("Beta",)]
    assert rows(g.cypher("MATCH (a:Person)-[:WORKS_AT]->(c)<-[:WORKS_AT]-(b:Person) WHERE a <> b RETURN a.name AS a, b.name AS b")) == [("Ann", "Ben"), ("Ben", "Ann")]
    assert g.cypher("MATCH (a:Person {id: 1}) RETURN a").first()[0].asDict() == {"active": True, "age": 30, "id": 1, "name": "Ann"}
    assert g.cypher("MATCH (:Person {id: 1})-[r:KNOWS]->() RETURN r").first()[0].asDict() == {"dst": 2, "since": 2019, "src": 1, "strength": 0.5}
    assert g.cypher("MATCH (c:Company {id: 2})<-[:WORKS_AT]-(p) RETURN collect(p) AS l").first()[0][0]["name"] == "Cid"


def test_optional_keeps_rows(spark):
    g = rivers(spark)
    q = "MATCH (a:River) OPTIONAL MATCH (a)-[:FLOWS]->(b)-[:CANAL]->(c) WHERE c.length < a.length RETURN a.node_id AS a, c.node_id AS c"
    assert rows(g.cypher(q)) == [("Aller", None), ("Bode", None), ("Cher", "Bode"), ("Dill", None), ("Enns", None), ("Fils", "Bode"), ("Gera", None)]
    q = "MATCH (a:River {node_id: 'Enns'}) OPTIONAL MATCH (a)-[:FLOWS*1..2]->(b) RETURN a.node_id AS a, b.node_id AS b, b IS NULL AS none"
    assert rows(g.cypher(q)) == [("Enns", None, True)]
    q = "MATCH (a:River {node_id: 'Enns'}) OPTIONAL MATCH (a)-[:FLOWS]->(b) OPTIONAL MATCH (b)-[:FLOWS]->(c) RETURN a.node_id AS a, c.node_id AS c"
    assert rows(g.cypher(q)) == [("Enns", None)]


def test_exists_forms(spark):
    g = rivers(spark)
    assert column(g.cypher("MATCH (a:River) WHERE (a)-[:CANAL]->(:River {node_id: 'Bode'}) RETURN a.node_id")) == ["Enns"]
    assert column(g.cypher("MATCH (a:River) WHERE NOT (a)-[:FLOWS]-() RETURN a.node_id")) == ["Gera"]
    assert column(g.cypher("MATCH (a:River), (b:River) WHERE a.node_id = 'Cher' AND (a)-[:FLOWS]->(b) RETURN b.node_id")) == ["Enns"]
    assert column(g.cypher("MATCH (a:River) WHERE EXISTS { (a)-[:FLOWS*2]->(b) WHERE b.length < a.length } RETURN a.node_id")) == ["Bode", "Dill"]
    assert column(g.cypher("MATCH (a:River) WHERE NOT EXISTS { (a)-[:FLOWS]->(b) WHERE b.length > a.length } RETURN a.node_id")) == ["Cher", "Enns", "Fils", "Gera"]
    assert column(g.cypher("MATCH (a:River) RETURN CASE WHEN EXISTS { (a)-[:FLOWS]->() } THEN 1 ELSE 0 END AS x")) == [0, 0, 1, 1, 1, 1, 1]


def test_integrity_elision_gives_the_same(spark):
    for flag in (False, True):
        g = rivers(spark, assume_referential_integrity=flag)
        assert column(g.cypher("MATCH (a:River)-[:FLOWS]->(b:River) RETURN b.node_id")) == ["Bode", "Cher", "Cher", "Enns", "Enns"]
        assert rows(g.cypher("MATCH (a:River)-[:FLOWS]->(b:River) RETURN count(b) AS n")) == [(5,)]
        assert column(g.cypher("MATCH (a:River {node_id: 'Aller'})-[:FLOWS*1..2]->(b:River) RETURN b.node_id")) == ["Bode", "Cher"]


def test_discovery_views_and_plans(spark):
    g = rivers(spark, discover_edge_combinations=True)
    assert set(g.edges) == {("River", "FLOWS", "River"), ("River", "CANAL", "River")}
    assert "Join" in g.explain("MATCH (a)-[:FLOWS]->(b) RETURN a.node_id")
    assert g.plan("MATCH (a) RETURN a").split("\n") == ["scan a:River", "project a"]
    q = "MATCH (a)-[:FLOWS]->(b) WHERE b.length > 20 OPTIONAL MATCH (b)-[:CANAL*1..2]->(c) WITH a, count(c) AS n ORDER BY n LIMIT 3 RETURN a.node_id, n UNION MATCH (a) RETURN a.node_id, 0 AS n"
    assert g.plan(q).split("\n") == ["scan a:River", "hop a -> b by FLOWS", "filter by b", "left join with:", "store the rows so far", "search b to c, 1 to 2 edges of CANAL", "aggregate a, n, sorted, some rows", "project node_id, n", "scan a:River", "project node_id, n", "union, distinct"]
    names = g.create_views("v_")
    assert spark.table(names[0]).count() == 7
    g.drop_views(names)


def test_foreign_keys_as_edges(spark):
    """The row's key is the edge: null keys and keys of nothing have no hop, and the edge has the same fields as from a table."""
    g = shop(spark)
    assert rows(g.cypher("MATCH (c:Customer)-[b:BUYS]->(s:Sale) RETURN c.name AS c, s.id AS s, b.customer AS x")) == [("Ada", 100, 1), ("Ada", 101, 1), ("Ben", 102, 2), ("Ben", 105, 2)]
    assert rows(g.cypher("MATCH (s:Sale)<-[:BUYS]-(c:Customer) WHERE c.budget < s.amount RETURN s.id AS s, c.name AS c")) == [(101, "Ada"), (105, "Ben")]
    assert rows(g.cypher("MATCH (s:Sale)-[:AT]->(t:Till)-[:IN]->(h:Hall) RETURN s.id AS s, h.name AS h")) == [(100, "north"), (101, "south"), (102, "south"), (103, "north")]
    assert rows(g.cypher("MATCH (h:Hall)<-[:IN]-(t:Till)<-[:AT]-(s:Sale)<-[:BUYS]-(c:Customer) RETURN h.name AS h, size(collect(DISTINCT c.name)) AS n")) == [("north", 1), ("south", 2)]
    assert rows(g.cypher("MATCH (c:Customer)-[:BUYS]->(s:Sale) MATCH (s)-[:AT]->(t) RETURN c.name AS c, t.id AS t")) == [("Ada", 1), ("Ada", 2), ("Ben", 2)]
    assert rows(g.cypher("MATCH (c:Customer) OPTIONAL MATCH (c)-[:BUYS]->(s:Sale) WHERE s.amount > c.budget RETURN c.name AS c, s.id AS s")) == [("Ada", 101), ("Ben", 105), ("Cy", None)]
    assert rows(g.cypher("MATCH (c:Customer) WHERE NOT (c)-[:BUYS]->(:Sale) RETURN c.name")) == [("Cy",)]
    assert rows(g.cypher("MATCH (c:Customer)-[:BUYS]->(s:Sale) WITH c, sum(s.amount) AS total WHERE total > c.budget RETURN c.name AS c, total")) == [("Ada", 70), ("Ben", 135)]
    assert rows(g.cypher("MATCH (a:Sale)-[:AT]->(t:Till)<-[:AT]-(b:Sale) WHERE a.id < b.id RETURN a.id AS a, b.id AS b, t.id AS t")) == [(100, 103, 1), (101, 102, 2)]
    circle = "MATCH (c:Customer)-[:BUYS]->(s:Sale)-[:AT]->(t:Till)<-[:AT]-(u:Sale)<-[:BUYS]-(c) RETURN c.name AS c, s.id AS s, u.id AS u"
    assert rows(g.cypher(circle)) == [("Ada", 100, 100), ("Ada", 101, 101), ("Ben", 102, 102)]
    assert rows(g.cypher("MATCH p = (c:Customer {id: 2})-[:BUYS|AT*1..2]->(x) RETURN labels(x)[0] AS l, length(p) AS n")) == [("Sale", 1), ("Sale", 1), ("Till", 2)]
    # one join for a hop, none for the edge
    assert g.plan("MATCH (c:Customer)-[:BUYS]->(s:Sale) RETURN c.name, s.amount").split("\n") == ["scan s:Sale", "hop s <- c by BUYS, in the row", "project name, amount"]
    assert g.explain("MATCH (c:Customer)-[:BUYS]->(s:Sale) RETURN c.name, s.amount", mode="simple").count("Join") == 1
    with pytest.raises(BindingError):
        g.add_edges("Customer", "BUYS", "Sale", src="customer", dst="till", of="target")


def test_order_of_hops(spark):
    """Many-to-one hops come before hops that multiply rows, and circles are closed by a filter."""
    g = shop(spark)
    steps = g.plan("MATCH (h:Hall)<-[:IN]-(t:Till)<-[:AT]-(s:Sale)<-[:BUYS]-(c:Customer) RETURN count(*) AS n").split("\n")
    assert steps[0] == "scan s:Sale" and len(steps) == 5
    assert all("in the row" in x for x in steps[1:4])


def test_searches_collect_only_what_is_asked_for(spark):
    g = rivers(spark)
    with_rels = lambda q: "with relationships" in g.plan(q)
    assert not with_rels("MATCH (a)-[:FLOWS*1..3]->(b) RETURN count(*) AS n")
    assert not with_rels("MATCH p = (a)-[:FLOWS*1..3]->(b) RETURN length(p) AS n, nodes(p) AS l")
    assert not with_rels("MATCH p = (a)-[:FLOWS*1..3]->(b) WHERE ALL(r IN relationships(p) WHERE r.src <> 'Bode') RETURN a.node_id")
    assert with_rels("MATCH p = (a)-[:FLOWS*1..3]->(b) RETURN [r IN relationships(p) | r.src] AS l")
    assert with_rels("MATCH (a)-[r:FLOWS*1..3]->(b) WITH r AS s RETURN size(s) AS n")


def test_nulls_sort_last_ascending_first_descending(spark):
    g = company(spark)
    assert [r[0] for r in g.cypher("MATCH (:Person)-[w:WORKS_AT]->() RETURN w.role AS r ORDER BY r").collect()] == ["dev", "ops", None]
    assert [r[0] for r in g.cypher("MATCH (:Person)-[w:WORKS_AT]->() RETURN w.role AS r ORDER BY r DESC").collect()] == [None, "ops", "dev"]
    assert [r[0] for r in g.cypher("MATCH (p:Person) RETURN p.name AS x ORDER BY p.age DESC LIMIT toInteger('2')").collect()] == ["Cid", "Ben"]


def test_yaml(spark):
    from loomgraph.sources.graph import from_yaml

    g = company(spark)
    text = """
schema:
  nodes:
    - {name: Person, tableName: catalog.demo.people, idProperty: {name: id, type: int}}
    - {name: Company, tableName: catalog.demo.firms, idProperty: {name: id, type: int}}
  edges:
    - {name: WORKS_AT, sourceNode: Person, sinkNode: Company, tableName: catalog.demo.works, sourceIdProperty: {name: person_id}, sinkIdProperty: {name: company_id}}
"""
    tables = {"people": g.nodes["Person"].df, "firms": g.nodes["Company"].df, "works": g.edges["Person", "WORKS_AT", "Company"].df}
    assert column(from_yaml(spark, text, tables).cypher("MATCH (:Company {name: 'Acme'})<-[:WORKS_AT]-(p) RETURN p.name")) == ["Ann", "Ben"]


def test_random_is_in_range(spark):
    g = company(spark)
    assert all(0 <= r[0] < 1 for r in g.cypher("MATCH (n) RETURN rand() AS x").collect())


def test_stream(spark, tmp_path):
    from loomgraph.errors import UnsupportedError
    from loomgraph.sources.graph import PropertyGraph
    from loomgraph.streaming import start, streaming_query

    g = company(spark)
    works = g.edges["Person", "WORKS_AT", "Company"].df
    works.write.parquet(str(tmp_path / "works"))
    live = spark.readStream.schema(works.schema).parquet(str(tmp_path / "works"))
    h = PropertyGraph(spark)
    h.add_nodes("Person", g.nodes["Person"].df, "id").add_nodes("Company", g.nodes["Company"].df, "id")
    h.add_edges("Person", "WORKS_AT", "Company", live, "person_id", "company_id")
    df = streaming_query(h, "MATCH (p:Person)-[:WORKS_AT]->(c:Company) RETURN p.name AS p, c.name AS c")
    q = start(df, "working", str(tmp_path / "check"))
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("working")) == [("Ann", "Acme"), ("Ben", "Acme"), ("Cid", "Beta")]
    with pytest.raises(UnsupportedError):
        streaming_query(h, "MATCH (p:Person)-[:WORKS_AT*1..2]->(c) RETURN p.name")
