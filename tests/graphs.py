"""Small literal graphs of the test suite."""

from loomgraph.sources.graph import PropertyGraph, triple_store


def store(spark, nodes, edges, node_schema="node_id string, node_type string", edge_schema="src string, dst string, relationship_type string", **options):
    return triple_store(spark.createDataFrame(nodes, node_schema), spark.createDataFrame(edges, edge_schema), **options)


def rivers(spark, **options):
    """Five rivers that flow into others, and two canals, one of which closes a circle."""
    length = {"Aller": 20, "Bode": 35, "Cher": 50, "Dill": 15, "Enns": 12, "Fils": 45, "Gera": 10}
    flows = [("Dill", "Cher"), ("Cher", "Enns"), ("Bode", "Cher"), ("Aller", "Bode"), ("Fils", "Enns")]
    canals = [("Gera", "Dill"), ("Enns", "Bode")]
    edges = [(a, b, "FLOWS") for a, b in flows] + [(a, b, "CANAL") for a, b in canals]
    return store(spark, [(n, "River", k) for n, k in length.items()], edges, "node_id string, node_type string, length int", **options)


def links(spark, pairs, kind="WAY", label="Spot", **options):
    edges = [(*e.split(), kind) for e in pairs]
    return store(spark, sorted({(n, label) for a, b, _ in edges for n in (a, b)}), edges, **options)


def locks(spark):
    """Seven basins of a canal; basins 3 and 6 have a gate."""
    gate = {"K3", "K6"}
    ways = ["K1 K2", "K2 K3", "K3 K4", "K4 K5", "K3 K6", "K6 K7"]
    edges = [(*w.split(), "WAY", w.split()[0] in gate) for w in ways]
    return store(spark, [(f"K{i}", "Basin", f"K{i}" in gate) for i in range(1, 8)], edges, "node_id string, node_type string, gate boolean", "src string, dst string, relationship_type string, from_gate boolean")


def shop(spark):
    """Foreign keys as edges: each sale names its customer and its till, each till its hall; some name none."""
    g = PropertyGraph(spark)
    g.add_nodes("Customer", spark.createDataFrame([(1, "Ada", 30), (2, "Ben", 90), (3, "Cy", 10)], "id int, name string, budget int"), "id")
    g.add_nodes("Hall", spark.createDataFrame([(7, "north"), (8, "south")], "id int, name string"), "id")
    g.add_nodes("Till", spark.createDataFrame([(1, 7), (2, 8), (3, None), (4, 9)], "id int, hall int"), "id")
    g.add_nodes("Sale", spark.createDataFrame([(100, 1, 1, 20), (101, 1, 2, 50), (102, 2, 2, 40), (103, None, 1, 5), (104, 9, 3, 7), (105, 2, None, 95)], "id int, customer int, till int, amount int"), "id")
    g.add_edges("Customer", "BUYS", "Sale", src="customer", dst="id", of="target")
    g.add_edges("Sale", "AT", "Till", src="id", dst="till", of="source")
    return g.add_edges("Till", "IN", "Hall", src="id", dst="hall", of="source")


def company(spark):
    people = spark.createDataFrame([(1, "Ann", 30, True), (2, "Ben", 40, False), (3, "Cid", 50, None)], "id int, name string, age int, active boolean")
    firms = spark.createDataFrame([(1, "Acme", 100), (2, "Beta", 5)], "id int, name string, employees int")
    knows = spark.createDataFrame([(1, 2, 2019, 0.5), (2, 3, 2020, 0.9)], "src int, dst int, since int, strength double")
    works = spark.createDataFrame([(1, 1, "dev", 3), (2, 1, "ops", 4), (3, 2, None, 1)], "person_id int, company_id int, role string, years int")
    g = PropertyGraph(spark)
    g.add_nodes("Person", people, "id").add_nodes("Company", firms, "id")
    g.add_edges("Person", "KNOWS", "Person", knows, "src", "dst").add_edges("Person", "WORKS_AT", "Company", works, "person_id", "company_id")
    return g


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def column(df):
    return sorted(r[0] for r in df.collect())
