"""Registered graph queries and the SQL that gives the same rows.

Each entry is a query text over the graph of sources/benchmark_tables.py and SQL over the tables themselves.
Some take options of ``PropertyGraph.cypher`` or parameters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.sources.benchmark_tables import benchmark_graph, ring_graph, schema_graph, triples_graph

_NEXT = "SELECT a.conv_id*1000+a.turn AS s, b.conv_id*1000+b.turn AS d, a.role AS said_by FROM conversations a JOIN conversations b ON a.conv_id=b.conv_id AND b.turn=a.turn+1"


def _paths(least: int, most: int, seed: str = "TRUE", edge: str = "TRUE", stop: str = "FALSE") -> str:
    """CTE p(s, n, depth) of node-simple NEXT paths (the chain has no cycles)."""
    return f"""WITH RECURSIVE e AS ({_NEXT}), t AS (SELECT conv_id*1000+turn AS id, conv_id, turn, role, text FROM conversations),
w AS (SELECT id AS s, id AS n, 0 AS depth FROM t WHERE {seed}
UNION ALL SELECT w.s, e.d, w.depth+1 FROM w JOIN e ON e.s=w.n AND {edge} JOIN t x ON x.id=w.n WHERE w.depth<{most} AND NOT (w.depth>0 AND ({stop}))),
p AS (SELECT * FROM w WHERE depth BETWEEN {least} AND {most})"""


def _ring(most: int, stop: str, then: str, both: bool = False) -> str:
    """SQL over w(s, n, depth, path, total): node-simple paths of the ring graph. stop: edges that aren't taken."""
    e = "SELECT n_nationkey AS s, (n_nationkey+1)%25 AS d, n_nationkey%4 AS w FROM nation UNION ALL SELECT n_nationkey, (n_nationkey*3+1)%25, n_nationkey%4 FROM nation"
    if both:
        e = f"SELECT * FROM ({e}) UNION ALL SELECT d, s, w FROM ({e}) WHERE s<>d"
    return f"""WITH RECURSIVE e AS ({e}), w AS (SELECT n_nationkey AS s, n_nationkey AS n, 0 AS depth, [n_nationkey] AS path, 0 AS total FROM nation
UNION ALL SELECT w.s, e.d, depth+1, list_append(path,e.d), total+e.w FROM w JOIN e ON e.s=w.n WHERE depth<{most} AND NOT list_contains(path,e.d) AND NOT ({stop})) {then}"""


#: name: (query, SQL) or (query, SQL, options). Options: graph, parameters, flat (fields of the result), views (SQL over
#: the graph's views instead of a query), and those of PropertyGraph.cypher.
ENTRIES: dict[str, tuple] = {
    "q_flagship_top_customers": (
        "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.totalprice > 100000 RETURN c.name AS name, count(o) AS n ORDER BY n DESC, name LIMIT 10",
        "SELECT c_name AS name, count(*) AS n FROM customer JOIN orders ON c_custkey=o_custkey WHERE o_totalprice>100000 GROUP BY c_custkey, c_name ORDER BY n DESC, name LIMIT 10"),
    "a1_scan_filter": ("MATCH (c:Customer) WHERE c.acctbal > 5000 AND c.mktsegment = 'BUILDING' RETURN c.custkey AS id, c.name AS name", "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_acctbal>5000 AND c_mktsegment='BUILDING'"),
    "b2_unlabelled_scan": ("MATCH (n) WHERE n:Region OR n:Nation RETURN labels(n)[0] AS label, n.name AS name", "SELECT 'Region' AS label, r_name AS name FROM region UNION ALL SELECT 'Nation', n_name FROM nation"),
    "b4_multi_type_hop": ("MATCH (o:Order)-[r:CONTAINS|SUPPLIED_BY]->(x) RETURN type(r) AS kind, count(*) AS n, sum(r.quantity) AS q", "SELECT kind, count(*) AS n, sum(l_quantity) AS q FROM (SELECT 'CONTAINS' AS kind, l_orderkey, l_quantity FROM lineitem UNION ALL SELECT 'SUPPLIED_BY', l_orderkey, l_quantity FROM lineitem) GROUP BY kind"),
    "b5_untyped_hop": ("MATCH (c:Customer)-[r]->(x) RETURN type(r) AS kind, count(*) AS n", "SELECT 'PLACED' AS kind, count(*) AS n FROM orders JOIN customer ON o_custkey=c_custkey UNION ALL SELECT 'IN_NATION', count(*) FROM customer JOIN nation ON c_nationkey=n_nationkey UNION ALL SELECT 'DID', count(*) FROM events JOIN customer ON user_id=c_custkey"),
    "c1_directed_hop": ("MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.orderstatus = 'F' RETURN c.custkey AS c, o.orderkey AS o", "SELECT o_custkey AS c, o_orderkey AS o FROM orders JOIN customer ON c_custkey=o_custkey WHERE o_orderstatus='F'"),
    "c2_backward_hop": ("MATCH (o:Order)<-[:PLACED]-(c:Customer) WHERE c.acctbal < 0 RETURN o.orderkey AS o, c.name AS name", "SELECT o_orderkey AS o, c_name AS name FROM orders JOIN customer ON c_custkey=o_custkey WHERE c_acctbal<0"),
    "c3_undirected_hop": ("MATCH (a:Turn)-[:NEXT]-(b:Turn) WHERE a.role = 'user' RETURN b.role AS role, count(*) AS n", f"WITH e AS ({_NEXT}), u AS (SELECT s,d FROM e UNION ALL SELECT d,s FROM e), t AS (SELECT conv_id*1000+turn AS id, role FROM conversations) SELECT y.role AS role, count(*) AS n FROM u JOIN t x ON x.id=u.s JOIN t y ON y.id=u.d WHERE x.role='user' GROUP BY y.role"),
    "c5_three_hops": ("MATCH (o:Order)<-[:PLACED]-(c:Customer)-[:IN_NATION]->(n:Nation)-[:IN_REGION]->(r:Region) RETURN r.name AS region, count(o) AS orders, round(sum(o.totalprice), 2) AS total", "SELECT r_name AS region, count(*) AS orders, round(sum(o_totalprice),2) AS total FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON n_nationkey=c_nationkey JOIN region ON r_regionkey=n_regionkey GROUP BY r_name"),
    "c6_comma_shared": ("MATCH (c:Customer)-[:IN_NATION]->(n:Nation), (s:Supplier)-[:IN_NATION]->(n) RETURN n.name AS nation, count(*) AS pairs", "SELECT n_name AS nation, count(*) AS pairs FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN supplier ON s_nationkey=n_nationkey GROUP BY n_name"),
    "c6_closing_cycle": ("MATCH (c:Customer)-[:IN_NATION]->(n:Nation)<-[:IN_NATION]-(s:Supplier)<-[:SUPPLIED_BY]-(o:Order)<-[:PLACED]-(c) RETURN count(*) AS n", "SELECT count(*) AS n FROM customer JOIN orders ON o_custkey=c_custkey JOIN lineitem ON l_orderkey=o_orderkey JOIN supplier ON s_suppkey=l_suppkey AND s_nationkey=c_nationkey JOIN nation ON n_nationkey=c_nationkey"),
    "c7_disconnected": ("MATCH (a:Region), (b:Region) WHERE a.regionkey < b.regionkey RETURN a.name AS a, b.name AS b", "SELECT a.r_name AS a, b.r_name AS b FROM region a, region b WHERE a.r_regionkey<b.r_regionkey"),
    "c8_two_matches": ("MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.totalprice > 200000 MATCH (c)-[:IN_NATION]->(n:Nation) RETURN n.name AS nation, count(DISTINCT c) AS customers, count(o) AS orders", "SELECT n_name AS nation, count(DISTINCT c_custkey) AS customers, count(*) AS orders FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON n_nationkey=c_nationkey WHERE o_totalprice>200000 GROUP BY n_name"),
    "c9_optional_where": ("MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.totalprice > 250000 RETURN c.custkey AS c, count(o) AS n", "SELECT c_custkey AS c, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey=c_custkey AND o_totalprice>250000 GROUP BY c_custkey"),
    "c9_optional_outer_where": ("MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.totalprice > c.acctbal * 30 RETURN c.custkey AS c, o.orderkey AS o", "SELECT c_custkey AS c, o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey=c_custkey AND o_totalprice>c_acctbal*30"),
    "c14_exists": ("MATCH (c:Customer) WHERE EXISTS { (c)-[:PLACED]->(o:Order) WHERE o.totalprice > 300000 } RETURN c.custkey AS c", "SELECT c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_totalprice>300000)"),
    "c14_exists_multi_hop": ("MATCH (c:Customer) WHERE EXISTS { (c)-[:PLACED]->(:Order)-[:CONTAINS]->(p:Part) WHERE p.size > 48 } RETURN count(c) AS n", "SELECT count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey=o_orderkey JOIN part ON p_partkey=l_partkey WHERE o_custkey=c_custkey AND p_size>48)"),
    "c14_exists_correlated": ("MATCH (c:Customer) WHERE EXISTS { (c)-[:PLACED]->(o:Order) WHERE o.totalprice < c.acctbal * 2 } RETURN c.custkey AS c", "SELECT c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_totalprice<c_acctbal*2)"),
    "c15_pattern_predicate": ("MATCH (c:Customer) WHERE (c)-[:PLACED]->() RETURN count(*) AS n", "SELECT count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)"),
    "c16_not_exists": ("MATCH (c:Customer) WHERE NOT EXISTS { (c)-[:PLACED]->(o:Order) WHERE o.totalprice > 200000 } RETURN c.name AS name", "SELECT c_name AS name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_totalprice>200000)"),
    "c17_exists_under_or": ("MATCH (c:Customer) WHERE c.acctbal > 9500 OR EXISTS { (c)-[:PLACED]->(o:Order) WHERE o.totalprice > 350000 } RETURN c.custkey AS c", "SELECT c_custkey AS c FROM customer WHERE c_acctbal>9500 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_totalprice>350000)"),
    "c17_exists_in_return": ("MATCH (n:Nation) RETURN n.name AS name, EXISTS { (s:Supplier)-[:IN_NATION]->(n) } AS has_supplier", "SELECT n_name AS name, EXISTS (SELECT 1 FROM supplier WHERE s_nationkey=n_nationkey) AS has_supplier FROM nation"),
    "c18_exists_subquery": ("MATCH (p:Part) WHERE EXISTS { MATCH (p)<-[r:CONTAINS]-(o:Order) WHERE r.quantity > 45 RETURN o } RETURN count(*) AS n", "SELECT count(*) AS n FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey=p_partkey AND l_quantity>45)"),
    "c19_inline_props": ("MATCH (c:Customer {mktsegment: 'MACHINERY'})-[:IN_NATION]->(n:Nation {name: $nation}) RETURN c.custkey AS c", "SELECT c_custkey AS c FROM customer JOIN nation ON n_nationkey=c_nationkey WHERE c_mktsegment='MACHINERY' AND n_name=(SELECT min(n_name) FROM nation)", {"lazy": {"nation": ("nation", "min(n_name)")}}),
    "d3_vlp": ("MATCH (a:Turn)-[:NEXT*1..3]->(b:Turn) RETURN a.turn_id AS a, b.turn_id AS b", _paths(1, 3) + " SELECT s AS a, n AS b FROM p"),
    "d4_vlp_zero": ("MATCH (a:Turn)-[:NEXT*0..2]->(b:Turn) RETURN a.turn_id AS a, b.turn_id AS b", _paths(0, 2) + " SELECT s AS a, n AS b FROM p"),
    "d1_vlp_exact": ("MATCH (a:Turn)-[:NEXT*2]->(b:Turn) RETURN count(*) AS n", _paths(2, 2) + " SELECT count(*) AS n FROM p"),
    "d1_vlp_deep": ("MATCH (a:Turn)-[:NEXT*..6]->(b:Turn) WHERE a.turn = 0 RETURN b.turn AS turn, count(*) AS n", _paths(1, 6, "turn=0") + " SELECT t.turn AS turn, count(*) AS n FROM p JOIN t ON t.id=p.n GROUP BY t.turn"),
    "d2_vlp_unbounded": ("MATCH (a:Turn {turn: 0})-[:NEXT*]->(b:Turn) RETURN count(*) AS n", _paths(1, 10, "turn=0") + " SELECT count(*) AS n FROM p"),
    "d7_path_functions": ("MATCH p = (a:Turn)-[r:NEXT*1..3]->(b:Turn) RETURN a.turn_id AS a, b.turn_id AS b, length(p) AS len, size(nodes(p)) AS nodes, size(relationships(p)) AS rels, array_sum AS total", "", {}),
    "d9_vlp_backward": ("MATCH (a:Turn)<-[:NEXT*1..2]-(b:Turn) WHERE a.role = 'assistant' RETURN a.turn_id AS a, b.turn_id AS b", _paths(1, 2) + " SELECT n AS a, s AS b FROM p JOIN t ON t.id=p.n WHERE t.role='assistant'"),
    "d9_vlp_undirected": ("MATCH (a:Turn)-[:NEXT*1..2]-(b:Turn) RETURN count(*) AS n", _paths(1, 2) + " SELECT 2*count(*) AS n FROM p"),
    "d11_vlp_two_tables": ("MATCH (c:Customer)-[:PLACED|CONTAINS*2..2]->(p:Part) RETURN c.custkey AS c, count(*) AS n", "SELECT o_custkey AS c, count(*) AS n FROM orders JOIN lineitem ON l_orderkey=o_orderkey GROUP BY o_custkey"),
    "d12_vlp_source_filter": ("MATCH (a:Turn)-[:NEXT*1..4]->(b:Turn) WHERE a.role = 'user' AND a.turn > 0 RETURN a.turn_id AS a, b.turn_id AS b", _paths(1, 4, "role='user' AND turn>0") + " SELECT s AS a, n AS b FROM p"),
    "d13_vlp_sink_filter": ("MATCH (a:Turn)-[:NEXT*1..3]->(b:Turn) WHERE b.role = 'user' RETURN a.turn_id AS a, b.turn_id AS b", _paths(1, 3) + " SELECT s AS a, n AS b FROM p JOIN t ON t.id=p.n WHERE t.role='user'"),
    "d14_vlp_all_edges": ("MATCH p = (a:Event)-[:THEN*1..3]->(b:Event) WHERE ALL(r IN relationships(p) WHERE r.dst % 3 <> 0) RETURN a.event_id AS a, b.event_id AS b",
        "WITH RECURSIVE e AS (SELECT * FROM (SELECT event_id AS s, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events) WHERE d IS NOT NULL), w AS (SELECT event_id AS s, event_id AS n, 0 AS depth FROM events UNION ALL SELECT w.s, e.d, depth+1 FROM w JOIN e ON e.s=w.n WHERE depth<3 AND e.d%3<>0) SELECT s AS a, n AS b FROM w WHERE depth>0"),
    "d15_terminator": ("MATCH (a:Turn)-[:NEXT*1..5]->(b:Turn) WHERE a.turn = 0 AND is_terminator(b.turn = 2) RETURN a.turn_id AS a, b.turn_id AS b", _paths(1, 5, "turn=0", stop="x.turn=2") + " SELECT s AS a, n AS b FROM p"),
    "d17_circular": ("MATCH (a:Place)-[:LEADS|STEPS*2..4]->(a) RETURN a.nationkey AS a, count(*) AS n", _ring(3, "FALSE", "SELECT w.s AS a, count(*) AS n FROM w JOIN e ON e.s=w.n AND e.d=w.s WHERE depth BETWEEN 1 AND 3 GROUP BY 1"), {"graph": "ring"}),
    "d19_vlp_continuation": ("MATCH (c:Customer)-[:DID]->(e:Event)-[:THEN*1..2]->(f:Event) RETURN c.custkey AS c, count(f) AS n",
        "WITH e AS (SELECT user_id, event_id, lead(event_id) OVER w AS d1, lead(event_id,2) OVER w AS d2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id AS c, count(d1)+count(d2) AS n FROM e JOIN customer ON c_custkey=user_id GROUP BY user_id HAVING count(d1)>0"),
    "d20_bidirectional": ("MATCH p = (a:Turn {turn_id: 3000})-[:NEXT*1..6]->(b:Turn {turn_id: 3003}) RETURN length(p) AS len", _paths(1, 6, "conv_id=3 AND turn=0") + " SELECT depth AS len FROM p WHERE n=3003"),
    "d23_reachability": ("MATCH (a:Turn {turn: 0})-[:NEXT*1..4]->(b:Turn) RETURN a.conv_id AS conv, count(b) AS n", _paths(1, 4, "turn=0") + " SELECT s//1000 AS conv, count(DISTINCT n) AS n FROM p GROUP BY s", {"vlp_mode": "reachability"}),
    "d28_seeded_vlp": ("MATCH (a:Turn) WHERE a.role = 'user' AND a.turn < 2 MATCH (a)-[:NEXT*1..2]->(b:Turn) RETURN a.turn_id AS a, count(b) AS n", _paths(1, 2, "role='user' AND turn<2") + " SELECT s AS a, count(*) AS n FROM p GROUP BY s"),
    "e3_entity": ("MATCH (r:Region) WITH r RETURN r.regionkey AS k, size(keys(r)) AS n", "SELECT r_regionkey AS k, CAST(2 AS INTEGER) AS n FROM region"),
    "e4_star": ("MATCH (r:Region) WITH r.name AS name, r.regionkey AS k RETURN *", "SELECT r_name AS name, r_regionkey AS k FROM region"),
    "e6_with_where": ("MATCH (o:Order) WITH o.orderkey AS k, o.totalprice * 2 AS double_price WHERE double_price > 700000 RETURN k, double_price", "SELECT o_orderkey AS k, o_totalprice*2 AS double_price FROM orders WHERE o_totalprice*2>700000"),
    "e7_having": ("MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, count(o) AS n, sum(o.totalprice) AS total WHERE n >= 15 RETURN c.name AS name, n, round(total, 2) AS total", "SELECT c_name AS name, count(*) AS n, round(sum(o_totalprice),2) AS total FROM customer JOIN orders ON o_custkey=c_custkey GROUP BY c_custkey, c_name HAVING count(*)>=15"),
    "e8_distinct": ("MATCH (o:Order) RETURN DISTINCT o.orderstatus AS status, o.orderpriority AS priority", "SELECT DISTINCT o_orderstatus AS status, o_orderpriority AS priority FROM orders"),
    "e9_order_skip_limit": ("MATCH (c:Customer) RETURN c.custkey AS c, c.acctbal AS bal ORDER BY bal DESC, c SKIP 5 LIMIT 10", "SELECT c_custkey AS c, c_acctbal AS bal FROM customer ORDER BY bal DESC, c LIMIT 10 OFFSET 5"),
    "p1_arithmetic": ("MATCH (p:Part) RETURN p.partkey AS k, p.size + 3 AS a, p.size - 3 AS s, p.size * 2 AS m, p.size / 4 AS d, p.size % 7 AS r, 2 ^ 3 AS e, -p.size AS n", "SELECT p_partkey AS k, CAST(p_size+3 AS BIGINT) AS a, CAST(p_size-3 AS BIGINT) AS s, CAST(p_size*2 AS BIGINT) AS m, p_size/4.0::DOUBLE AS d, CAST(p_size%7 AS INTEGER) AS r, 8.0::DOUBLE AS e, CAST(-p_size AS INTEGER) AS n FROM part"),
    "p2_concat": ("MATCH (n:Nation) RETURN n.name + '/' + n.nationkey AS x", "SELECT n_name||'/'||n_nationkey AS x FROM nation"),
    "p5_time_difference": ("MATCH (o:Order) WHERE o.orderdate - datetime('1992-01-01T00:00:00') > duration('P365D') RETURN o.orderkey AS k, (o.orderdate - datetime('1992-01-01T00:00:00')) / 86400 AS days", "SELECT o_orderkey AS k, CAST(date_diff('second', TIMESTAMP '1992-01-01', o_orderdate) AS DOUBLE)/86400 AS days FROM orders WHERE date_diff('second', TIMESTAMP '1992-01-01', o_orderdate)>365*86400"),
    "p6_date_duration": ("MATCH (o:Order) RETURN o.orderkey AS k, toString(date(o.orderdate + duration({months: 1, days: 3}))) AS later", "SELECT o_orderkey AS k, CAST(CAST(o_orderdate + INTERVAL 1 MONTH + INTERVAL 3 DAY AS DATE) AS VARCHAR) AS later FROM orders"),
    "p10_logic": ("MATCH (c:Customer) WHERE (c.acctbal > 8000 XOR c.mktsegment = 'BUILDING') AND NOT (c.custkey % 2 = 0 OR c.nationkey = 3) RETURN c.custkey AS c", "SELECT c_custkey AS c FROM customer WHERE ((c_acctbal>8000) <> (c_mktsegment='BUILDING')) AND NOT (c_custkey%2=0 OR c_nationkey=3)"),
    "p13_chain": ("MATCH (p:Part) WHERE 10 < p.size <= 12 RETURN p.partkey AS p", "SELECT p_partkey AS p FROM part WHERE p_size>10 AND p_size<=12"),
    "p14_regex": ("MATCH (p:Part) WHERE p.brand =~ 'Brand#[12].*' RETURN count(*) AS n", "SELECT count(*) AS n FROM part WHERE regexp_full_match(p_brand,'Brand#[12].*')"),
    "p15_in": ("MATCH (o:Order) WHERE o.orderstatus IN ['F', 'P'] AND o.orderkey IN $keys RETURN o.orderkey AS k", "SELECT o_orderkey AS k FROM orders WHERE o_orderstatus IN ('F','P') AND o_orderkey IN (1,2,3,4,5,6,7,32,33,34,35,64,65,66,67,100)", {"parameters": {"keys": [1, 2, 3, 4, 5, 6, 7, 32, 33, 34, 35, 64, 65, 66, 67, 100]}}),
    "p18_null": ("MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.totalprice > 280000 WITH c, o WHERE o IS NULL RETURN count(c) AS n", "SELECT count(*) AS n FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice>280000) ON o_custkey=c_custkey WHERE o_orderkey IS NULL"),
    "p19_text_predicates": ("MATCH (p:Part) WHERE p.name STARTS WITH 'Part' OR p.type ENDS WITH 'BRASS' OR p.type CONTAINS 'STEEL' RETURN count(*) AS n", "SELECT count(*) AS n FROM part WHERE starts_with(p_name,'Part') OR ends_with(p_type,'BRASS') OR contains(p_type,'STEEL')"),
    "p20_case": ("MATCH (o:Order) RETURN CASE o.orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS state, CASE WHEN o.totalprice > 200000 THEN 'big' WHEN o.totalprice > 50000 THEN 'mid' END AS size, count(*) AS n", "SELECT CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS state, CASE WHEN o_totalprice>200000 THEN 'big' WHEN o_totalprice>50000 THEN 'mid' END AS size, count(*) AS n FROM orders GROUP BY 1,2"),
    "g3_quantifiers": ("UNWIND range(1, 6) AS i WITH i, range(1, i) AS l RETURN i, ALL(x IN l WHERE x < 4) AS a, ANY(x IN l WHERE x = 3) AS b, NONE(x IN l WHERE x = 5) AS c, SINGLE(x IN l WHERE x % 3 = 0) AS d", "SELECT i::BIGINT AS i, i<4 AS a, i>=3 AS b, i<5 AS c, i BETWEEN 3 AND 5 AS d FROM range(1,7) t(i)"),
    "g7_comprehension": ("UNWIND range(0, 5) AS i WITH i, [x IN range(0, i) WHERE x % 2 = 0 | x * 10] AS l RETURN i, size(l) AS n, reduce(s = 0, x IN l | s + x) AS total", "SELECT i::BIGINT AS i, CAST(i//2+1 AS INTEGER) AS n, CAST(10*(i//2)*(i//2+1) AS BIGINT) AS total FROM range(0,6) t(i)"),
    "g9_reduce_collect": ("MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c.custkey AS c, collect(o.orderkey) AS keys RETURN c, size(keys) AS n, reduce(s = 0, k IN keys | s + k) AS total", "SELECT o_custkey AS c, CAST(count(*) AS INTEGER) AS n, CAST(sum(o_orderkey) AS BIGINT) AS total FROM orders GROUP BY o_custkey"),
    "g10_unwind_collect": ("MATCH (n:Nation)-[:IN_REGION]->(r:Region) WITH r, collect(n.name) AS names UNWIND names AS name RETURN r.name AS region, name", "SELECT r_name AS region, n_name AS name FROM nation JOIN region ON n_regionkey=r_regionkey"),
    "g10_unwind_relationships": ("MATCH p = (a:Turn)-[:NEXT*1..2]->(b:Turn) WHERE a.turn = 0 UNWIND relationships(p) AS r RETURN r.said_by AS said_by, count(*) AS n", _paths(1, 2, "turn=0") + ", x AS (SELECT p.s, p.depth, k FROM p, range(0,2) g(k) WHERE k<p.depth) SELECT c.role AS said_by, count(*) AS n FROM x JOIN conversations c ON c.conv_id*1000+c.turn=x.s+x.k GROUP BY c.role"),
    "g12_two_unwinds": ("UNWIND [1, 2, 3] AS x UNWIND ['a', 'b'] AS y RETURN x, y", "SELECT x::INTEGER AS x, y FROM (VALUES (1),(2),(3)) a(x), (VALUES ('a'),('b')) b(y)"),
    "g14_pattern_comprehension": ("MATCH (r:Region) RETURN r.name AS region, size([(r)<-[:IN_REGION]-(n:Nation) WHERE n.nationkey > 5 | n.name]) AS n", "SELECT r_name AS region, CAST(count(n_nationkey) AS INTEGER) AS n FROM region LEFT JOIN nation ON n_regionkey=r_regionkey AND n_nationkey>5 GROUP BY r_name"),
    "g24_index_slice": ("UNWIND range(1, 4) AS i WITH i, range(10, 10 + i) AS l RETURN i, l[0] AS first, l[-1] AS last, size(l[1..3]) AS mid", "SELECT i::BIGINT AS i, 10::BIGINT AS first, (10+i)::BIGINT AS last, CAST(least(i,2) AS INTEGER) AS mid FROM range(1,5) t(i)"),
    "h1_aggregates": ("MATCH (o:Order) RETURN o.orderstatus AS s, count(*) AS n, count(DISTINCT o.custkey) AS c, round(sum(o.totalprice), 2) AS total, round(avg(o.totalprice), 4) AS mean, min(o.totalprice) AS lo, max(o.totalprice) AS hi", "SELECT o_orderstatus AS s, count(*) AS n, count(DISTINCT o_custkey) AS c, round(sum(o_totalprice),2) AS total, round(avg(o_totalprice),4) AS mean, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY 1"),
    "h8_deviation": ("MATCH (c:Customer) RETURN c.mktsegment AS seg, round(stdev(c.acctbal), 4) AS s, round(stdevp(c.acctbal), 4) AS p", "SELECT c_mktsegment AS seg, round(stddev_samp(c_acctbal),4) AS s, round(stddev_pop(c_acctbal),4) AS p FROM customer GROUP BY 1"),
    "h13_ordered_collect": ("MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c.custkey AS c, collect(o.orderkey ORDER BY o.totalprice DESC, o.orderkey) AS l RETURN c, l[0] AS top, l[-1] AS low", "SELECT o_custkey AS c, first(o_orderkey ORDER BY o_totalprice DESC, o_orderkey) AS top, last(o_orderkey ORDER BY o_totalprice DESC, o_orderkey) AS low FROM orders GROUP BY 1"),
    "h14_percentiles": ("MATCH (o:Order) RETURN o.orderpriority AS p, round(percentileCont(o.totalprice, 0.9), 4) AS c, percentileDisc(o.totalprice, 0.5) AS d", "SELECT o_orderpriority AS p, round(quantile_cont(o_totalprice,0.9),4) AS c, quantile_disc(o_totalprice,0.5) AS d FROM orders GROUP BY 1"),
    "h16_entity_group": ("MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, max(o.totalprice) AS top RETURN c.name AS name, c.mktsegment AS seg, top", "SELECT c_name AS name, c_mktsegment AS seg, max(o_totalprice) AS top FROM customer JOIN orders ON o_custkey=c_custkey GROUP BY c_custkey, c_name, c_mktsegment"),
    "h17_nested_aggregates": ("MATCH (s:Supplier) RETURN s.nationkey AS n, count(s) * 2 + 1 AS x, coalesce(max(s.acctbal), 0) > 5000 AS rich", "SELECT s_nationkey AS n, count(*)*2+1 AS x, max(s_acctbal)>5000 AS rich FROM supplier GROUP BY 1"),
    "h18_sibling_alias": ("MATCH (s:Supplier) WITH s.nationkey AS n, count(s) AS k, k * 10 AS tens RETURN n, k, tens", "SELECT s_nationkey AS n, count(*) AS k, count(*)*10 AS tens FROM supplier GROUP BY 1"),
    "a5_boundary": ("MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, count(o) AS n ORDER BY n DESC, c.custkey LIMIT 5 MATCH (c)-[:IN_NATION]->(x:Nation) RETURN c.name AS name, n, x.name AS nation", "SELECT c_name AS name, n, n_name AS nation FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 5) JOIN customer ON c_custkey=o_custkey JOIN nation ON n_nationkey=c_nationkey"),
    "i1_union_all": ("MATCH (c:Customer) WHERE c.acctbal > 9000 RETURN c.name AS name UNION ALL MATCH (s:Supplier) WHERE s.acctbal > 9000 RETURN s.name AS name", "SELECT c_name AS name FROM customer WHERE c_acctbal>9000 UNION ALL SELECT s_name FROM supplier WHERE s_acctbal>9000"),
    "i2_union": ("MATCH (c:Customer) RETURN c.nationkey AS n UNION MATCH (s:Supplier) RETURN s.nationkey AS n", "SELECT c_nationkey AS n FROM customer UNION SELECT s_nationkey FROM supplier"),
    "f_strings": ("MATCH (p:Part) RETURN p.partkey AS k, toUpper(p.name) AS u, toLower(p.name) AS l, left(p.name, 3) AS a, right(p.name, 3) AS b, trim('  x ') AS t, ltrim('  x') AS lt, rtrim('x ') AS rt, startsWith(p.type, 'S') AS s, endsWith(p.type, 'L') AS e, contains(p.type, 'AN') AS c, size(p.name) AS n, toString(p.size) AS z", "SELECT p_partkey AS k, upper(p_name) AS u, lower(p_name) AS l, left(p_name,3) AS a, right(p_name,3) AS b, 'x' AS t, 'x' AS lt, 'x' AS rt, starts_with(p_type,'S') AS s, ends_with(p_type,'L') AS e, contains(p_type,'AN') AS c, CAST(length(p_name) AS INTEGER) AS n, CAST(p_size AS VARCHAR) AS z FROM part"),
    "f_math": ("MATCH (p:Part) RETURN p.partkey AS k, abs(p.size - 25) AS a, ceil(p.retailprice) AS c, floor(p.retailprice) AS f, round(p.retailprice, 1) AS r, round(sqrt(p.size), 6) AS q, sign(p.size - 25) AS s, round(log(p.size + 1), 6) AS ln, round(log10(p.size + 1), 6) AS lg, round(exp(p.size / 50), 6) AS e, round(sin(p.size) + cos(p.size) + tan(0.5), 6) AS t, round(asin(0.5) + acos(0.5) + atan(p.size) + atan2(p.size, 2), 6) AS at, round(degrees(pi()) + radians(180) + e(), 6) AS d", "SELECT p_partkey AS k, CAST(abs(p_size-25) AS BIGINT) AS a, CAST(ceil(p_retailprice) AS BIGINT) AS c, CAST(floor(p_retailprice) AS BIGINT) AS f, round(p_retailprice,1) AS r, round(sqrt(p_size),6) AS q, CAST(sign(p_size-25) AS DOUBLE) AS s, round(ln(p_size+1),6) AS ln, round(log10(p_size+1),6) AS lg, round(exp(p_size/50.0),6) AS e, round(sin(p_size)+cos(p_size)+tan(0.5),6) AS t, round(asin(0.5)+acos(0.5)+atan(p_size)+atan2(p_size,2),6) AS at, round(degrees(pi())+radians(180)+exp(1),6) AS d FROM part"),
    "f_conversions": ("UNWIND ['12', '3.5', 'x', 'true'] AS v RETURN v, toInteger(v) AS i, toFloat(v) AS f, toBoolean(v) AS b, coalesce(toInteger(v), -1) AS c", "SELECT * FROM (VALUES ('12',12::BIGINT,12.0::DOUBLE,NULL::BOOLEAN,12::BIGINT),('3.5',NULL,3.5,NULL,-1),('x',NULL,NULL,NULL,-1),('true',NULL,NULL,TRUE,-1)) t(v,i,f,b,c)"),
    "f_dates": ("MATCH (o:Order) RETURN o.orderkey AS k, year(o.orderdate) AS y, month(o.orderdate) AS m, day(o.orderdate) AS d, hour(o.orderdate) AS h, minute(o.orderdate) AS mi, second(o.orderdate) AS s, week(o.orderdate) AS w, dayOfWeek(o.orderdate) AS dow, quarter(o.orderdate) AS q, duration.between(date({year: 1992, month: 1, day: 1}), date(o.orderdate)) AS days, toString(date(date.truncate('month', o.orderdate))) AS mon", "SELECT o_orderkey AS k, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d, CAST(hour(o_orderdate) AS INTEGER) AS h, CAST(minute(o_orderdate) AS INTEGER) AS mi, CAST(second(o_orderdate) AS INTEGER) AS s, CAST(weekofyear(o_orderdate) AS INTEGER) AS w, CAST(dayofweek(o_orderdate)+1 AS INTEGER) AS dow, CAST(quarter(o_orderdate) AS INTEGER) AS q, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS days, CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS mon FROM orders"),
    "f_times": ("RETURN toString(date({year: 2024, month: 2, day: 29})) AS d, time({hour: 7, minute: 5, second: 9}) AS t, toString(datetime({year: 2024, month: 1, day: 2, hour: 3, minute: 4, second: 5})) AS dt, localtime(localdatetime('2024-01-02T03:04:05')) AS lt, size(range(5, 1)) AS none, size(range(1, 10, 3)) AS some", "SELECT '2024-02-29' AS d, '07:05:09' AS t, '2024-01-02 03:04:05' AS dt, '03:04:05' AS lt, 0::INTEGER AS none, 4::INTEGER AS some"),
}
ENTRIES["d7_path_functions"] = (
    "MATCH p = (a:Turn)-[r:NEXT*1..3]->(b:Turn) RETURN a.turn_id AS a, b.turn_id AS b, length(p) AS len, size(nodes(p)) AS nodes, size(relationships(p)) AS rels, reduce(s = 0, x IN [n IN nodes(p) | n.turn_id] | s + x) AS total",
    _paths(1, 3) + " SELECT s AS a, n AS b, CAST(depth AS INTEGER) AS len, CAST(depth+1 AS INTEGER) AS nodes, CAST(depth AS INTEGER) AS rels, CAST((s+n)*(depth+1)/2 AS BIGINT) AS total FROM p")
# a graph with circles, branches and a self-loop
_ANY = "MATCH p = (a:Place%s)-[:LEADS|STEPS*%s]->(b:Place%s) "
ENTRIES |= {
    "c3_undirected_self_loop": ("MATCH (a:Place)-[:LEADS]-(b:Place) RETURN a.nationkey AS a, b.nationkey AS b", "WITH e AS (SELECT n_nationkey AS s, (n_nationkey*3+1)%25 AS d FROM nation) SELECT s AS a, d AS b FROM e UNION ALL SELECT d, s FROM e WHERE s<>d", {"graph": "ring"}),
    "d6_cycle_check": (_ANY % ("", "1..5", "") + "RETURN a.nationkey AS a, b.nationkey AS b, count(*) AS n", _ring(5, "FALSE", "SELECT s AS a, n AS b, count(*) AS n FROM w WHERE depth>0 GROUP BY 1,2"), {"graph": "ring"}),
    "d9_undirected_branches": ("MATCH (a:Place)-[:LEADS|STEPS*1..3]-(b:Place) RETURN a.nationkey AS a, count(*) AS n", _ring(3, "FALSE", "SELECT s AS a, count(*) AS n FROM w WHERE depth>0 GROUP BY 1", both=True), {"graph": "ring"}),
    "d14_edge_weights": (_ANY % ("", "1..4", "") + "WHERE ALL(r IN relationships(p) WHERE r.w < 3) RETURN a.nationkey AS a, count(*) AS n", _ring(4, "e.w>=3", "SELECT s AS a, count(*) AS n FROM w WHERE depth>0 GROUP BY 1"), {"graph": "ring"}),
    "d15_terminator_branches": (_ANY % ("", "1..4", "") + "WHERE is_terminator(b.regionkey = 2) RETURN a.nationkey AS a, b.nationkey AS b, count(*) AS n", _ring(4, "depth>0 AND w.n IN (SELECT n_nationkey FROM nation WHERE n_regionkey=2)", "SELECT s AS a, n AS b, count(*) AS n FROM w WHERE depth>0 GROUP BY 1,2"), {"graph": "ring"}),
    **{f"d20_meeting_{mode}": (_ANY % (" {nationkey: 0}", "1..6", " {nationkey: 7}") + "RETURN length(p) AS len, count(*) AS n", _ring(6, "FALSE", "SELECT depth AS len, count(*) AS n FROM w WHERE s=0 AND n=7 GROUP BY 1"), {"graph": "ring", "bidirectional": mode}) for mode in ("auto", "on", "off", "recursive", "unrolling")},
    "d23_first_discovery": (_ANY % ("", "1..4", "") + "RETURN a.nationkey AS a, b.nationkey AS b, length(p) AS depth, size(relationships(p)) AS edges", _ring(4, "FALSE", "SELECT s AS a, n AS b, CAST(min(depth) AS INTEGER) AS depth, 1::INTEGER AS edges FROM w WHERE depth>0 GROUP BY 1,2"), {"graph": "ring", "vlp_mode": "reachability"}),
    "d25_procedural": (_ANY % ("", "2..3", "") + "RETURN a.nationkey AS a, b.nationkey AS b, length(p) AS depth", _ring(3, "FALSE", "SELECT s AS a, n AS b, CAST(min(depth) AS INTEGER) AS depth FROM w WHERE depth>0 GROUP BY 1,2 HAVING min(depth)>=2"), {"graph": "ring", "vlp_mode": "procedural"}),
    "d26_procedural_both_ends": (_ANY % (" {nationkey: 0}", "1..5", "") + "WHERE b.regionkey = 1 RETURN b.nationkey AS b, length(p) AS depth", _ring(5, "FALSE", "SELECT n AS b, CAST(min(depth) AS INTEGER) AS depth FROM w JOIN nation ON n_nationkey=n AND n_regionkey=1 WHERE s=0 AND depth>0 GROUP BY 1"), {"graph": "ring", "vlp_mode": "procedural", "bidirectional": "on"}),
    "d30_return_path": ("MATCH p = (a:Place)-[:LEADS|STEPS*1..3]->(b:Place) RETURN p", _ring(3, "FALSE", "SELECT array_to_string(path,'>') AS p FROM w WHERE depth>0"), {"graph": "ring", "flat": ["array_join(transform(p, x -> string(x)), '>') AS p"]}),
    "f26_rels": (_ANY % ("", "1..2", "") + "RETURN a.nationkey AS a, b.nationkey AS b, size(rels(p)) AS n, reduce(t = 0, r IN rels(p) | t + r.w) AS total", _ring(2, "FALSE", "SELECT s AS a, n AS b, CAST(depth AS INTEGER) AS n, CAST(total AS BIGINT) AS total FROM w WHERE depth>0"), {"graph": "ring"}),
}
# one table of nodes and one of edges
_EDGES = "SELECT 'C'||c_custkey AS src, 'N'||c_nationkey AS dst, 'LIVES_IN' AS t FROM customer UNION ALL SELECT 'S'||s_suppkey, 'N'||s_nationkey, 'WORKS_IN' FROM supplier UNION ALL SELECT 'N'||n_nationkey, 'R'||n_regionkey, 'PART_OF' FROM nation"
ENTRIES |= {
    "b3_triple_hop": ("MATCH (c:Customer)-[:LIVES_IN]->(n:Nation) RETURN n.name AS nation, count(c) AS n", "SELECT n_name AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey=n_nationkey GROUP BY 1", {"graph": "triples"}),
    "b4_triple_types": ("MATCH (x)-[r:LIVES_IN|WORKS_IN]->(n) RETURN type(r) AS kind, n.name AS nation, count(*) AS n", "SELECT kind, n_name AS nation, count(*) AS n FROM (SELECT 'LIVES_IN' AS kind, c_nationkey AS k FROM customer UNION ALL SELECT 'WORKS_IN', s_nationkey FROM supplier) JOIN nation ON k=n_nationkey GROUP BY 1,2", {"graph": "triples"}),
    "b5_triple_untyped": ("MATCH (a)-[r]-(b:Nation) RETURN type(r) AS kind, labels(a)[0] AS label, count(*) AS n", "SELECT 'LIVES_IN' AS kind, 'Customer' AS label, count(*) AS n FROM customer JOIN nation ON c_nationkey=n_nationkey UNION ALL SELECT 'WORKS_IN', 'Supplier', count(*) FROM supplier JOIN nation ON s_nationkey=n_nationkey UNION ALL SELECT 'PART_OF', 'Region', count(*) FROM nation JOIN region ON n_regionkey=r_regionkey", {"graph": "triples"}),
    "b10_discovered": ("MATCH (a)-[r]->(b) RETURN labels(a)[0] AS a, type(r) AS r, labels(b)[0] AS b, count(*) AS n", "SELECT 'Customer' AS a, 'LIVES_IN' AS r, 'Nation' AS b, count(*) AS n FROM customer JOIN nation ON c_nationkey=n_nationkey UNION ALL SELECT 'Supplier', 'WORKS_IN', 'Nation', count(*) FROM supplier JOIN nation ON s_nationkey=n_nationkey UNION ALL SELECT 'Nation', 'PART_OF', 'Region', count(*) FROM nation JOIN region ON n_regionkey=r_regionkey", {"graph": "discovered"}),
    "d10_triple_paths": ("MATCH p = (c:Customer)-[:LIVES_IN|PART_OF*1..2]->(x) RETURN x.node_id AS x, length(p) AS len, count(*) AS n", "SELECT 'N'||c_nationkey AS x, 1::INTEGER AS len, count(*) AS n FROM customer JOIN nation ON c_nationkey=n_nationkey GROUP BY 1 UNION ALL SELECT 'R'||n_regionkey, 2::INTEGER, count(*) FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey GROUP BY 1", {"graph": "triples"}),
    "d9_triple_undirected_paths": ("MATCH (a:Region)-[:PART_OF|WORKS_IN*2..2]-(s:Supplier) RETURN a.name AS region, count(s) AS n", "SELECT r_name AS region, count(*) AS n FROM region JOIN nation ON n_regionkey=r_regionkey JOIN supplier ON s_nationkey=n_nationkey GROUP BY 1", {"graph": "triples"}),
    "c13_integrity": ("MATCH (o:Order)-[:CONTAINS]->(p:Part) RETURN count(p) AS n", "SELECT count(*) AS n FROM lineitem JOIN orders ON l_orderkey=o_orderkey", {"graph": "integrity"}),
    "b13_yaml_schema": ("MATCH (n:Nation)-[:PART_OF]->(r:Region) WHERE r.r_name <> 'ASIA' RETURN r.r_name AS region, n.n_name AS nation", "SELECT r_name AS region, n_name AS nation FROM nation JOIN region ON n_regionkey=r_regionkey WHERE r_name<>'ASIA'", {"graph": "schema"}),
    "b9_views": ("", "SELECT r_name AS name, count(*) AS n FROM region JOIN nation ON n_regionkey=r_regionkey GROUP BY 1", {"views": "SELECT r.name AS name, count(*) AS n FROM own_Region r JOIN own_Nation_IN_REGION_Region e ON e.regionkey = r.regionkey GROUP BY 1"}),
    # whole entities as results, by their fields
    "e3_return_node": ("MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN n, r", "SELECT n_nationkey AS k, n_name AS name, n_regionkey AS r, r_name AS region FROM nation JOIN region ON n_regionkey=r_regionkey", {"flat": ["n.nationkey AS k", "n.name AS name", "n.regionkey AS r", "r.name AS region"]}),
    "e3_return_edge": ("MATCH (o:Order)-[r:CONTAINS]->(p:Part) RETURN r", "SELECT l_orderkey AS src, l_partkey AS dst, l_quantity AS q, l_linenumber AS line FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN part ON l_partkey=p_partkey", {"flat": ["r.src AS src", "r.dst AS dst", "r.quantity AS q", "r.linenumber AS line"]}),
    "e3_entity_after_with": ("MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, count(o) AS n WHERE n > 12 RETURN c, n", "SELECT c_custkey AS k, c_name AS name, c_mktsegment AS seg, c_acctbal AS bal, count(*) AS n FROM customer JOIN orders ON o_custkey=c_custkey GROUP BY 1,2,3,4 HAVING count(*)>12", {"flat": ["c.custkey AS k", "c.name AS name", "c.mktsegment AS seg", "c.acctbal AS bal", "n"]}),
    "h12_collect_entity": ("MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN r.name AS region, collect(n) AS l", "SELECT r_name AS region, CAST(count(*) AS INTEGER) AS k, CAST(sum(n_nationkey) AS BIGINT) AS total FROM nation JOIN region ON n_regionkey=r_regionkey GROUP BY 1", {"flat": ["region", "size(l) AS k", "aggregate(l, 0L, (a, x) -> a + x.nationkey) AS total"]}),
    "h7_first_last": ("MATCH (o:Order) RETURN o.orderstatus AS s, first(o.orderstatus) AS f, last(o.orderstatus) AS l", "SELECT o_orderstatus AS s, o_orderstatus AS f, o_orderstatus AS l FROM orders GROUP BY 1"),
    "h11_collect_distinct": ("MATCH (o:Order) RETURN o.orderstatus AS s, size(collect(DISTINCT o.orderpriority)) AS n", "SELECT o_orderstatus AS s, CAST(count(DISTINCT o_orderpriority) AS INTEGER) AS n FROM orders GROUP BY 1"),
    "p3_list_plus": ("UNWIND range(1, 4) AS i WITH i, [10, 20] + [i] AS l RETURN i, size(l) AS n, l[0] + l[2] AS x", "SELECT i::BIGINT AS i, 3::INTEGER AS n, (10+i)::BIGINT AS x FROM range(1,5) t(i)"),
    "p17_in_list_expression": ("MATCH (o:Order) WITH o.orderkey AS k, o.custkey AS c WHERE c IN [x IN range(1, 200) WHERE x % 7 = 0] RETURN k, c", "SELECT o_orderkey AS k, o_custkey AS c FROM orders WHERE o_custkey BETWEEN 1 AND 200 AND o_custkey%7=0"),
    "g2_map_literal": ("UNWIND range(1, 3) AS i WITH i, {k: i, v: 'x'} AS m RETURN m.k AS k, m.v AS v", "SELECT i::BIGINT AS k, 'x' AS v FROM range(1,4) t(i)"),
    "g11_unwind_empty": ("UNWIND range(1, 4) AS i WITH i, [x IN range(1, i) WHERE x > 2] AS l UNWIND l AS x RETURN i, x", "SELECT i::BIGINT AS i, x::BIGINT AS x FROM range(1,5) t(i), range(3,5) u(x) WHERE x<=i"),
    "g11_unwind_null": ("MATCH (n:Nation) OPTIONAL MATCH (n)-[:IN_REGION]->(r:Region) WHERE r.regionkey > 2 WITH n, CASE WHEN r IS NULL THEN null ELSE [r.regionkey, 9] END AS l UNWIND l AS x RETURN n.nationkey AS n, x", "SELECT n_nationkey AS n, x FROM (SELECT n_nationkey, n_regionkey AS x FROM nation WHERE n_regionkey>2 UNION ALL SELECT n_nationkey, 9 FROM nation WHERE n_regionkey>2)"),
    "f_aliases": ("MATCH (p:Part) RETURN p.partkey AS k, +p.size AS u, toDouble(p.size) AS d, toLong(p.size) AS l, ceiling(p.retailprice) AS c, round(ln(p.size), 6) AS ln, toString(timestamp('2024-01-02T03:04:05')) AS t, rand() < 1 AS a, random() >= 0 AS b", "SELECT p_partkey AS k, p_size AS u, p_size::DOUBLE AS d, p_size::BIGINT AS l, CAST(ceil(p_retailprice) AS BIGINT) AS c, round(ln(p_size),6) AS ln, '2024-01-02 03:04:05' AS t, TRUE AS a, TRUE AS b FROM part"),
}

_GRAPHS = {
    "tables": benchmark_graph, "ring": ring_graph, "triples": triples_graph, "schema": schema_graph,
    "discovered": lambda spark, sf_dir: triples_graph(spark, sf_dir, discover_edge_combinations=True), "integrity": lambda spark, sf_dir: benchmark_graph(spark, sf_dir, assume_referential_integrity=True),
}


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    text, options = ENTRIES[name][0], dict(ENTRIES[name][2]) if len(ENTRIES[name]) > 2 else {}
    lazy, parameters, graph, flat, views = options.pop("lazy", {}), options.pop("parameters", {}), _GRAPHS[options.pop("graph", "tables")], options.pop("flat", ["*"]), options.pop("views", None)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if views is not None:
            graph(spark, sf_dir).create_views("own_")
            return spark.sql(views)
        looked_up = {k: spark.read.parquet(f"{sf_dir}/{t}.parquet").selectExpr(e).first()[0] for k, (t, e) in lazy.items()}
        return graph(spark, sf_dir).cypher(text, {**parameters, **looked_up}, **options).selectExpr(*flat)

    run.__name__ = name
    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _query(name) for name in ENTRIES}
ORACLE_SQL: dict[str, str] = {name: entry[1] for name, entry in ENTRIES.items()}
