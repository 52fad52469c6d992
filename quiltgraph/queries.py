"""The registered queries over the star-schema graph, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltgraph.session import GraphSession
from quiltgraph.sources.tables import star_graph

#: name: (query, SQL or None). Lists are returned in a fixed order; floats are rounded.
QUERIES: dict[str, tuple[str, str | None]] = {
    "flagship": (
        "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE c.mktsegment = 'HOUSEHOLD' RETURN c.name AS name, count(*) AS n, round(sum(o.totalprice)) AS total ORDER BY total DESC, name LIMIT 10",
        "SELECT c_name AS name, count(*) AS n, round(sum(o_totalprice)) AS total FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'HOUSEHOLD' GROUP BY c_custkey, c_name ORDER BY total DESC, name LIMIT 10",
    ),
    "scan_filter": (
        "MATCH (p:Part) WHERE p.size >= 45 AND p.retailprice > 900 RETURN p.partkey AS k, p.name AS name",
        "SELECT p_partkey AS k, p_name AS name FROM part WHERE p_size >= 45 AND p_retailprice > 900",
    ),
    "index_lookup": ("MATCH (c:Customer {custkey: 7}) RETURN c.name AS name, c.acctbal AS b", "SELECT c_name AS name, c_acctbal AS b FROM customer WHERE c_custkey = 7"),
    "id_lookup": (
        "MATCH (c:Customer) WHERE c.custkey < 5 WITH id(c) AS i MATCH (x) WHERE id(x) = i RETURN count(x) AS n",
        "SELECT count(*) AS n FROM customer WHERE c_custkey < 5",
    ),
    "unlabelled_scan": (
        "MATCH (n) WHERE n.name IS NOT NULL UNWIND labels(n) AS l RETURN l, count(*) AS n",
        "SELECT 'Region' AS l, count(*) AS n FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Customer', count(*) FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Part', count(*) FROM part",
    ),
    "multi_label_scan": (
        "MATCH (d:Document:Labeled) RETURN d.lang AS lang, count(*) AS n, sum(d.toxic) AS toxic",
        "SELECT lang, count(*) AS n, CAST(sum(toxic) AS BIGINT) AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY lang",
    ),
    "label_test": (
        "MATCH (d:Document) RETURN d:Labeled AS labelled, count(*) AS n",
        "SELECT l.doc_id IS NOT NULL AS labelled, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1",
    ),
    "expand_out": (
        "MATCH (o:Order)-[c:CONTAINS]->(p:Part) WHERE p.size > 40 RETURN p.brand AS brand, count(*) AS n, sum(c.quantity) AS qty",
        "SELECT p_brand AS brand, count(*) AS n, sum(l_quantity) AS qty FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 40 GROUP BY 1",
    ),
    "expand_in": (
        "MATCH (n:Nation)<-[:IN_NATION]-(s:Supplier) RETURN n.name AS nation, count(s) AS n",
        "SELECT n_name AS nation, count(*) AS n FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1",
    ),
    "expand_undirected": (
        "MATCH (c:Customer)--(x) WHERE c.custkey < 100 RETURN c.custkey AS k, count(x) AS n",
        "SELECT c_custkey AS k, count(*) AS n FROM (SELECT c_custkey FROM customer UNION ALL SELECT o_custkey FROM orders) WHERE c_custkey < 100 GROUP BY 1",
    ),
    "expand_multi_type": (
        "MATCH (o:Order)-[r:CONTAINS|SUPPLIED_BY]->(x) RETURN type(r) AS t, count(*) AS n, sum(r.quantity) AS q",
        "SELECT t, count(*) AS n, sum(l_quantity) AS q FROM lineitem, (VALUES ('CONTAINS'), ('SUPPLIED_BY')) v(t) GROUP BY t",
    ),
    "two_hop_uniqueness": (
        "MATCH (a:Part)<-[:CONTAINS]-(o:Order)-[:CONTAINS]->(b:Part) WHERE a.partkey < 200 RETURN count(*) AS n",
        "WITH l AS (SELECT *, row_number() OVER () AS i FROM lineitem) SELECT count(*) AS n FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.i <> b.i WHERE a.l_partkey < 200",
    ),
    "parallel_edges": (
        "MATCH (o:Order)-[r:CONTAINS]->(p:Part) WITH o, p, count(r) AS n WHERE n > 1 RETURN o.orderkey AS o, p.partkey AS p, n",
        "SELECT l_orderkey AS o, l_partkey AS p, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    ),
    "cyclic_pattern": (
        "MATCH (c:Customer)-[:IN_NATION]->(n:Nation)<-[:IN_NATION]-(s:Supplier)<-[:SUPPLIED_BY]-(o:Order)<-[:PLACED]-(c) RETURN n.name AS nation, count(*) AS n",
        "SELECT n_name AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey JOIN lineitem ON l_suppkey = s_suppkey JOIN orders ON o_orderkey = l_orderkey AND o_custkey = c_custkey GROUP BY 1",
    ),
    "comma_cross": (
        "MATCH (r:Region), (n:Nation) WHERE n.nationkey % 5 <> r.regionkey RETURN r.name AS r, count(n) AS n",
        "SELECT r_name AS r, count(*) AS n FROM region JOIN nation ON n_nationkey % 5 <> r_regionkey GROUP BY 1",
    ),
    "shared_variable_match": (
        "MATCH (n:Nation)-[:IN_REGION]->(r:Region) MATCH (c:Customer)-[:IN_NATION]->(n) RETURN r.name AS region, count(c) AS n",
        "SELECT r_name AS region, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    ),
    "optional_match": (
        "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) RETURN c.custkey AS k, count(o) AS n",
        "SELECT c_custkey AS k, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    ),
    "optional_match_where": (
        "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.totalprice > c.acctbal * 40 RETURN c.custkey AS k, count(o) AS n",
        "SELECT c_custkey AS k, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 40 GROUP BY 1",
    ),
    "exists_pattern": (
        "MATCH (c:Customer) WHERE (c)-[:PLACED]->(:Order {status: 'F'}) RETURN count(*) AS n",
        "SELECT count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')",
    ),
    "not_pattern": (
        "MATCH (p:Part) WHERE NOT (p)<-[:CONTAINS]-(:Order {status: 'P'}) RETURN count(*) AS n",
        "SELECT count(*) AS n FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_partkey = p_partkey AND o_orderstatus = 'P')",
    ),
    "exists_subquery": (
        "MATCH (c:Customer) WHERE EXISTS { MATCH (c)-[:PLACED]->(o:Order) WITH o WHERE o.totalprice > 200000 RETURN o } RETURN c.mktsegment AS s, count(*) AS n",
        "SELECT c_mktsegment AS s, count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) GROUP BY 1",
    ),
    "exists_in_expression": (
        "MATCH (c:Customer) RETURN EXISTS { (c)-[:PLACED]->(o:Order) WHERE o.totalprice > 200000 } OR c.acctbal < 0 AS flag, count(*) AS n",
        "SELECT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) OR c_acctbal < 0 AS flag, count(*) AS n FROM customer GROUP BY 1",
    ),
    "pattern_comprehension": (
        "MATCH (n:Nation) RETURN n.name AS nation, [(n)<-[:IN_NATION]-(s:Supplier) WHERE s.acctbal > 5000 | s.suppkey] AS rich",
        "SELECT n_name AS nation, coalesce(list(s_suppkey ORDER BY s_suppkey) FILTER (s_suppkey IS NOT NULL), []) AS rich FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000 GROUP BY 1",
    ),
    "var_length_1_3": (
        "MATCH (a:Event)-[:NEXT*1..3]->(b:Event) RETURN count(*) AS n",
        "WITH w AS (SELECT row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS after FROM events) SELECT CAST(sum(least(after, 3)) AS BIGINT) AS n FROM w",
    ),
    "var_length_zero": (
        "MATCH (e:Event {event_type: 'purchase'})-[:NEXT*0..2]->(x:Event) RETURN e.event_id AS e, count(x) AS n",
        "WITH w AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS after FROM events) SELECT event_id AS e, 1 + least(after, 2) AS n FROM w WHERE event_type = 'purchase'",
    ),
    "var_length_exact": (
        "MATCH (a:Turn)-[:NEXT*2]->(b:Turn) RETURN a.role AS r1, b.role AS r2, count(*) AS n",
        "WITH w AS (SELECT role AS r1, lead(role, 2) OVER (PARTITION BY conv_id ORDER BY turn) AS r2 FROM conversations) SELECT r1, r2, count(*) AS n FROM w WHERE r2 IS NOT NULL GROUP BY 1, 2",
    ),
    "var_length_filtered": (
        "MATCH (a:Order {orderkey: 3})-[r:CONTAINS*1..1 {returnflag: 'R'}]->(p:Part) RETURN p.partkey AS p, size(r) AS hops",
        "SELECT l_partkey AS p, CAST(1 AS BIGINT) AS hops FROM lineitem WHERE l_orderkey = 3 AND l_returnflag = 'R'",
    ),
    "path_length": (
        "MATCH p = (a:Turn {turn: 0})-[:NEXT*]->(b:Turn) RETURN length(p) AS l, count(*) AS n",
        "SELECT r AS l, count(*) AS n FROM (SELECT row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS r FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE turn = 0)) WHERE r > 0 GROUP BY 1",
    ),
    "path_nodes": (
        "MATCH p = (a:Turn {turn: 0})-[:NEXT*2]->(b:Turn) RETURN a.conv_id AS c, [n IN nodes(p) | n.turn] AS turns, [r IN relationships(p) | type(r)] AS types",
        "SELECT conv_id AS c, [turn, t1, t2] AS turns, ['NEXT', 'NEXT'] AS types FROM (SELECT conv_id, turn, lead(turn, 1) OVER w AS t1, lead(turn, 2) OVER w AS t2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE turn = 0 AND t2 IS NOT NULL",
    ),
    "shortest_path": (
        "MATCH (a:Turn {turn: 0}), (b:Turn {turn: 3}), p = shortestPath((a)-[:NEXT*..10]->(b)) WHERE a.conv_id = b.conv_id RETURN a.conv_id AS c, length(p) AS l",
        "SELECT a.conv_id AS c, (SELECT count(*) FROM conversations x WHERE x.conv_id = a.conv_id AND x.turn > 0 AND x.turn <= 3) AS l FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id WHERE a.turn = 0 AND b.turn = 3",
    ),
    "shortest_path_none": (
        "MATCH (a:Turn {turn: 1}), (b:Turn {turn: 0}), p = shortestPath((a)-[:NEXT*..10]->(b)) WHERE a.conv_id = b.conv_id RETURN p IS NULL AS missing, count(*) AS n",
        "SELECT true AS missing, count(*) AS n FROM conversations a JOIN conversations b USING (conv_id) WHERE a.turn = 1 AND b.turn = 0",
    ),
    "all_shortest_paths": (
        "MATCH (o:Order)-[:CONTAINS]->(p:Part) WHERE o.orderkey < 50 WITH DISTINCT o, p MATCH q = allShortestPaths((o)-[:CONTAINS*..3]->(p)) RETURN o.orderkey AS o, p.partkey AS p, count(q) AS n",
        "SELECT l_orderkey AS o, l_partkey AS p, count(*) AS n FROM lineitem WHERE l_orderkey < 50 GROUP BY 1, 2",
    ),
    "agg_count_sum_avg": (
        "MATCH (o:Order) RETURN o.status AS s, count(*) AS n, round(sum(o.totalprice)) AS total, round(avg(o.totalprice)) AS mean, min(o.totalprice) AS low, max(o.totalprice) AS high",
        "SELECT o_orderstatus AS s, count(*) AS n, round(sum(o_totalprice)) AS total, round(avg(o_totalprice)) AS mean, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY 1",
    ),
    "agg_distinct": (
        "MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.mktsegment AS s, count(DISTINCT c) AS customers, count(DISTINCT o.priority) AS priorities, sum(DISTINCT o.orderkey % 10) AS digits",
        "SELECT c_mktsegment AS s, count(DISTINCT c_custkey) AS customers, count(DISTINCT o_orderpriority) AS priorities, CAST(sum(DISTINCT o_orderkey % 10) AS BIGINT) AS digits FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    ),
    "agg_collect": (
        "MATCH (r:Region)<-[:IN_REGION]-(n:Nation) WITH r, n ORDER BY n.name RETURN r.name AS region, collect(n.name) AS nations",
        "SELECT r_name AS region, list(n_name ORDER BY n_name) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1",
    ),
    "agg_percentile": (
        "MATCH (p:Part) RETURN p.brand AS b, percentileCont(p.size, 0.3) AS c, percentileDisc(p.size, 0.5) AS d",
        "SELECT p_brand AS b, quantile_cont(CAST(p_size AS DOUBLE), 0.3) AS c, CAST(list_sort(list(p_size))[1 + CAST(floor(0.5 * (count(*) - 1) + 0.5) AS INTEGER)] AS DOUBLE) AS d FROM part GROUP BY 1",
    ),
    "agg_stdev": (
        "MATCH (p:Part) RETURN p.size AS s, round(stDev(p.retailprice) * 100) AS sd, round(stDevP(p.retailprice) * 100) AS sp",
        "SELECT CAST(p_size AS BIGINT) AS s, round(coalesce(stddev_samp(p_retailprice), 0) * 100) AS sd, round(coalesce(stddev_pop(p_retailprice), 0) * 100) AS sp FROM part GROUP BY 1",
    ),
    "agg_mixed_expr": (
        "MATCH (o:Order) WITH o.status AS s, o.totalprice AS p RETURN s, count(*) * 2 + 1 AS n, s + '!' AS t, round(max(p) - min(p)) AS spread",
        "SELECT o_orderstatus AS s, count(*) * 2 + 1 AS n, o_orderstatus || '!' AS t, round(max(o_totalprice) - min(o_totalprice)) AS spread FROM orders GROUP BY 1",
    ),
    "agg_empty": ("MATCH (p:Part) WHERE p.size < 0 RETURN count(*) AS n, sum(p.size) AS s, avg(p.size) AS a, size(collect(p.size)) AS c", "SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS s, CAST(NULL AS DOUBLE) AS a, CAST(0 AS BIGINT) AS c"),
    "group_by_node": (
        "MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, count(o) AS n WHERE n > 12 RETURN c.custkey AS k, c.name AS name, n",
        "SELECT c_custkey AS k, c_name AS name, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2 HAVING count(*) > 12",
    ),
    "with_having": (
        "MATCH (p:Part) WITH p.brand AS b, count(*) AS n, avg(p.size) AS m WHERE n > 5 AND m > 20 RETURN b, n ORDER BY b",
        "SELECT p_brand AS b, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 5 AND avg(p_size) > 20 ORDER BY 1",
    ),
    "with_limit_where": (
        "MATCH (c:Customer) WITH c ORDER BY c.acctbal DESC, c.custkey LIMIT 20 WHERE c.mktsegment <> 'BUILDING' RETURN c.custkey AS k",
        "SELECT c_custkey AS k FROM (SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20) WHERE c_mktsegment <> 'BUILDING'",
    ),
    "distinct": ("MATCH (u:User)-[:EMITTED]->(e:Event) RETURN DISTINCT e.event_type AS t, u.user_id % 3 AS m", "SELECT DISTINCT event_type AS t, user_id % 3 AS m FROM events"),
    "order_nulls": (
        "MATCH (d:Document) RETURN d.doc_id AS d, d.quality AS q ORDER BY q DESC, d LIMIT 25",
        "SELECT doc_id AS d, CAST(quality AS BIGINT) AS q FROM documents LEFT JOIN labels USING (doc_id) ORDER BY q DESC NULLS FIRST, d LIMIT 25",
    ),
    "skip_limit": (
        "MATCH (p:Part) RETURN p.partkey AS k, p.retailprice AS r ORDER BY r DESC, k SKIP 10 LIMIT 15",
        "SELECT p_partkey AS k, p_retailprice AS r FROM part ORDER BY r DESC, k LIMIT 15 OFFSET 10",
    ),
    "union": (
        "MATCH (c:Customer) RETURN c.mktsegment AS x UNION MATCH (o:Order) RETURN o.priority AS x",
        "SELECT c_mktsegment AS x FROM customer UNION SELECT o_orderpriority FROM orders",
    ),
    "union_all": (
        "MATCH (n:Nation) RETURN n.name AS x UNION ALL MATCH (r:Region) RETURN r.name AS x",
        "SELECT n_name AS x FROM nation UNION ALL SELECT r_name FROM region",
    ),
    "unwind_list": (
        "UNWIND [10, 20, 30] AS s MATCH (p:Part) WHERE p.size > s RETURN s, count(*) AS n",
        "SELECT CAST(s AS BIGINT) AS s, count(*) AS n FROM (VALUES (10), (20), (30)) v(s) JOIN part ON p_size > s GROUP BY 1",
    ),
    "unwind_collect": (
        "MATCH (n:Nation)-[:IN_REGION]->(r:Region) WITH r, collect(n) AS ns UNWIND ns AS m MATCH (m)<-[:IN_NATION]-(s:Supplier) RETURN r.name AS region, count(s) AS n",
        "SELECT r_name AS region, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1",
    ),
    "unwind_empty": ("MATCH (r:Region) UNWIND [x IN [r.regionkey] WHERE x > 2] AS y RETURN y", "SELECT CAST(r_regionkey AS BIGINT) AS y FROM region WHERE r_regionkey > 2"),
    "case_when": (
        "MATCH (p:Part) RETURN CASE WHEN p.size < 10 THEN 'small' WHEN p.size < 30 THEN 'middle' ELSE 'large' END AS c, CASE p.size % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS e, count(*) AS n",
        "SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS c, CASE p_size % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS e, count(*) AS n FROM part GROUP BY 1, 2",
    ),
    "list_ops": (
        "MATCH (r:Region) WITH r.regionkey AS k, [r.regionkey, 7, 9] + 11 AS l RETURN k, l[0] AS a, l[-1] AS b, l[9] AS c, l[1..3] AS d, head(l) AS h, last(l) AS z, tail(l) AS t, size(l) AS n, reverse(l) AS v",
        "SELECT k, k AS a, CAST(11 AS BIGINT) AS b, CAST(NULL AS BIGINT) AS c, [CAST(7 AS BIGINT), 9] AS d, k AS h, CAST(11 AS BIGINT) AS z, [CAST(7 AS BIGINT), 9, 11] AS t, CAST(4 AS BIGINT) AS n, [CAST(11 AS BIGINT), 9, 7, k] AS v FROM (SELECT CAST(r_regionkey AS BIGINT) AS k FROM region)",
    ),
    "list_comprehension": (
        "MATCH (n:Nation) RETURN n.nationkey AS k, [x IN range(0, n.nationkey) WHERE x % 5 = 2 | x * 10] AS l",
        "SELECT CAST(n_nationkey AS BIGINT) AS k, list_transform(list_filter(range(0, n_nationkey + 1), lambda x: x % 5 = 2), lambda x: x * 10) AS l FROM nation",
    ),
    "quantifiers": (
        "MATCH (n:Nation) WITH n.nationkey AS k, range(1, n.nationkey) AS l RETURN k, any(x IN l WHERE x > 20) AS a, all(x IN l WHERE x < 10) AS b, none(x IN l WHERE x = 5) AS c, single(x IN l WHERE x % 11 = 0) AS d",
        "SELECT CAST(k AS BIGINT) AS k, k > 20 AS a, k < 10 AS b, k < 5 AS c, k >= 11 AND k < 22 AS d FROM (SELECT n_nationkey AS k FROM nation)",
    ),
    "in_three_valued": (
        "MATCH (d:Document) RETURN d.quality IN [1, null] AS i, null IN [] AS e, d.quality = d.toxic AS q, count(*) AS n",
        "SELECT CASE WHEN quality = 1 THEN true END AS i, false AS e, quality = toxic AS q, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2, 3",
    ),
    "string_functions": (
        "MATCH (n:Nation) RETURN n.name AS name, toLower(n.name) AS l, toUpper(n.name) AS u, substring(n.name, 1, 3) AS s, left(n.name, 2) AS a, right(n.name, 2) AS z, replace(n.name, 'A', '_') AS r, size(n.name) AS k, split(n.name, 'A') AS p, trim('  ' + n.name + ' ') AS t, reverse(n.name) AS v",
        "SELECT n_name AS name, lower(n_name) AS l, upper(n_name) AS u, substr(n_name, 2, 3) AS s, left(n_name, 2) AS a, right(n_name, 2) AS z, replace(n_name, 'A', '_') AS r, length(n_name) AS k, string_split(n_name, 'A') AS p, n_name AS t, reverse(n_name) AS v FROM nation",
    ),
    "string_predicates": (
        "MATCH (p:Part) WHERE p.name CONTAINS 'a' AND NOT p.type STARTS WITH 'S' OR p.brand ENDS WITH '3' RETURN count(*) AS n",
        "SELECT count(*) AS n FROM part WHERE contains(p_name, 'a') AND NOT starts_with(p_type, 'S') OR ends_with(p_brand, '3')",
    ),
    "regex_full_match": ("MATCH (c:Customer) WHERE c.name =~ '.*[02468]' RETURN count(*) AS n", "SELECT count(*) AS n FROM customer WHERE regexp_full_match(c_name, '.*[02468]')"),
    "math_functions": (
        "MATCH (p:Part) WITH p.size - 25 AS x, p.partkey AS k RETURN k, abs(x) AS a, sign(x) AS s, ceil(x / 2.0) AS c, floor(x / 2.0) AS f, round(x / 2.0) AS r, round(sqrt(abs(x)) * 1000) AS q, x ^ 2 AS p",
        "SELECT p_partkey AS k, abs(x) AS a, CAST(sign(x) AS BIGINT) AS s, CAST(ceil(x / 2.0) AS DOUBLE) + 0.0 AS c, CAST(floor(x / 2.0) AS DOUBLE) AS f, round(x / 2.0) + 0.0 AS r, round(sqrt(abs(x)) * 1000) AS q, CAST(x AS DOUBLE) ** 2 AS p FROM (SELECT p_partkey, CAST(p_size - 25 AS BIGINT) AS x FROM part) t(p_partkey, x)",
    ),
    "int_division_null": (
        "MATCH (n:Nation) WITH n.nationkey - 5 AS x RETURN x, 7 / x AS d, 7 % x AS m, -x / 2 AS h, 1.5 / x AS f",
        "SELECT x, CASE WHEN x <> 0 THEN CAST(trunc(7.0 / x) AS BIGINT) END AS d, CASE WHEN x <> 0 THEN 7 % x END AS m, CAST(trunc(-x / 2.0) AS BIGINT) AS h, CASE WHEN x <> 0 THEN 1.5 / CAST(x AS DOUBLE) END AS f FROM (SELECT CAST(n_nationkey - 5 AS BIGINT) AS x FROM nation)",
    ),
    "type_conversion": (
        "UNWIND ['12', '3.7', 'x', ' 3', '-4', '1e3'] AS s RETURN s, toInteger(s) AS i, toFloat(s) AS f, toBoolean(s) AS b, toString(1.5) AS t, toInteger(2.9) AS j, toBoolean('TRUE') AS k",
        "SELECT * FROM (VALUES ('12', 12::BIGINT, 12.0::DOUBLE, NULL::BOOLEAN, '1.5', 2::BIGINT, true), ('3.7', 3, 3.7, NULL, '1.5', 2, true), ('x', NULL, NULL, NULL, '1.5', 2, true), (' 3', NULL, NULL, NULL, '1.5', 2, true), ('-4', -4, -4.0, NULL, '1.5', 2, true), ('1e3', 1000, 1000.0, NULL, '1.5', 2, true)) v(s, i, f, b, t, j, k)",
    ),
    "coalesce_null": (
        "MATCH (d:Document) RETURN coalesce(d.quality, -1) AS q, d.toxic IS NULL AS missing, count(*) AS n",
        "SELECT coalesce(CAST(quality AS BIGINT), -1) AS q, toxic IS NULL AS missing, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2",
    ),
    "range_fn": ("UNWIND range(10, 1, -3) AS x RETURN x, size(range(x, 0)) AS e, size(range(0, x)) AS n", "SELECT x, CAST(0 AS BIGINT) AS e, x + 1 AS n FROM (VALUES (10::BIGINT), (7), (4), (1)) v(x)"),
    "map_projection": (
        "MATCH (r:Region) WITH {name: r.name, key: r.regionkey, nested: {twice: r.regionkey * 2}} AS m RETURN m.name AS a, m['key'] AS b, m.nested.twice AS c, m.none AS d, keys(m) AS k",
        "SELECT r_name AS a, CAST(r_regionkey AS BIGINT) AS b, CAST(r_regionkey * 2 AS BIGINT) AS c, NULL::VARCHAR AS d, ['key', 'name', 'nested'] AS k FROM region",
    ),
    "temporal_accessors": (
        "MATCH (e:Event) WITH e.ts AS t RETURN t.year AS y, t.month AS m, t.quarter AS q, t.dayOfWeek AS w, t.week AS k, t.hour % 12 AS h, count(*) AS n",
        "SELECT year(ts) AS y, month(ts) AS m, quarter(ts) AS q, isodow(ts) AS w, weekofyear(ts) AS k, hour(ts) % 12 AS h, count(*) AS n FROM events GROUP BY ALL",
    ),
    "temporal_truncate": (
        "MATCH (o:Order) WITH date.truncate('quarter', o.orderdate) AS q, date.truncate('decade', o.orderdate) AS d RETURN q, d, count(*) AS n",
        "SELECT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS q, make_date(year(o_orderdate) - year(o_orderdate) % 10, 1, 1) AS d, count(*) AS n FROM orders GROUP BY 1, 2",
    ),
    "duration_between": (
        "MATCH (o:Order) WITH duration.inDays(o.orderdate, localdatetime('1999-01-01T00:00')) AS d RETURN d.days / 100 AS h, count(*) AS n",
        "SELECT CAST(epoch(TIMESTAMP '1999-01-01' - o_orderdate) // 86400 AS BIGINT) // 100 AS h, count(*) AS n FROM orders GROUP BY 1",
    ),
    "date_arith": (
        "MATCH (o:Order) WITH date(o.orderdate) + duration({months: 1, days: 2}) AS d RETURN d.year AS y, d.month AS m, count(*) AS n",
        "SELECT year(d) AS y, month(d) AS m, count(*) AS n FROM (SELECT CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) + 2 AS d FROM orders) GROUP BY 1, 2",
    ),
    "fts_contains": (
        "MATCH (d:Document) WHERE toLower(d.text) CONTAINS toLower('LICENSE') RETURN d.lang AS l, count(*) AS n",
        "SELECT lang AS l, count(*) AS n FROM documents WHERE contains(lower(text), 'license') GROUP BY 1",
    ),
    "fts_bm25_search": (
        "CALL fts.search('Document', 'text', 'license') YIELD node, score RETURN node.doc_id AS d, round(score * 10000) AS s",
        """WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
        f AS (SELECT doc_id, len(w) AS dl, len(list_filter(w, lambda x: x = 'license')) AS tf FROM w),
        t AS (SELECT count(*) AS n, avg(dl) AS m, count(*) FILTER (tf > 0) AS df FROM f)
        SELECT doc_id AS d, round(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / m)) * 10000) AS s FROM f, t WHERE tf > 0""",
    ),
    "fts_phrase_search": (
        "CALL fts.search('Document', 'text', '\"mit license\" OR licens* NOT apache') YIELD node RETURN count(node) AS n",
        "SELECT count(*) AS n FROM (SELECT ' ' || regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g') || ' ' AS t FROM documents) WHERE contains(t, ' mit license ') OR contains(t, ' licens') AND NOT contains(t, ' apache ')",
    ),
    "db_counts": (
        "CALL db.counts() YIELD kind, name, count WHERE kind = 'type' RETURN name, count",
        "SELECT 'IN_REGION' AS name, (SELECT count(*) FROM nation) AS count UNION ALL SELECT 'IN_NATION', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) UNION ALL SELECT 'PLACED', (SELECT count(*) FROM orders) UNION ALL SELECT 'CONTAINS', (SELECT count(*) FROM lineitem) UNION ALL SELECT 'SUPPLIED_BY', (SELECT count(*) FROM lineitem) UNION ALL SELECT 'EMITTED', (SELECT count(*) FROM events) UNION ALL SELECT 'NEXT', (SELECT count(*) - count(DISTINCT user_id) FROM events) + (SELECT count(*) - count(DISTINCT conv_id) FROM conversations)",
    ),
    "co_purchase_recommendation": (
        "MATCH (p:Part {partkey: 5})<-[:CONTAINS]-(o:Order)-[:CONTAINS]->(q:Part) WHERE q <> p RETURN q.partkey AS q, count(DISTINCT o) AS n ORDER BY n DESC, q LIMIT 20",
        "SELECT b.l_partkey AS q, count(DISTINCT a.l_orderkey) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE a.l_partkey = 5 AND b.l_partkey <> 5 GROUP BY 1 ORDER BY n DESC, q LIMIT 20",
    ),
    "triadic_closure": (
        "MATCH (c:Customer)-[:PLACED]->(:Order)-[:SUPPLIED_BY]->(s:Supplier) WHERE NOT EXISTS { (c)-[:IN_NATION]->(n:Nation)<-[:IN_NATION]-(s) } RETURN count(DISTINCT c) AS customers, count(*) AS n",
        "SELECT count(DISTINCT c_custkey) AS customers, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey <> c_nationkey",
    ),
    "start_end_node": (
        "MATCH ()-[r:IN_REGION]->() RETURN startNode(r).name AS a, endNode(r).name AS b",
        "SELECT n_name AS a, r_name AS b FROM nation JOIN region ON n_regionkey = r_regionkey",
    ),
    "graph_functions": (
        "MATCH (d:Document)  RETURN labels(d) AS l, size(keys(d)) AS k, count(*) AS n",
        "SELECT CASE WHEN l.doc_id IS NULL THEN ['Document'] ELSE ['Document', 'Labeled'] END AS l, CAST(CASE WHEN l.doc_id IS NULL THEN 5 ELSE 7 END AS BIGINT) AS k, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1, 2",
    ),
    "exists_limit": (
        "MATCH (c:Customer) WHERE EXISTS { MATCH (c)-[:PLACED]->(o:Order) WITH o ORDER BY o.totalprice DESC, o.orderkey SKIP 1 LIMIT 2 WHERE o.status = 'F' RETURN o } RETURN count(*) AS n",
        "SELECT count(DISTINCT o_custkey) AS n FROM (SELECT o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS i FROM orders) WHERE i IN (2, 3) AND o_orderstatus = 'F'",
    ),
    "exists_skip": (
        "MATCH (c:Customer) WHERE EXISTS { MATCH (c)-[:PLACED]->(o:Order) RETURN o SKIP 11 } RETURN count(*) AS n",
        "SELECT count(*) AS n FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 11)",
    ),
    "exists_count_zero": (
        "MATCH (p:Part) WHERE EXISTS { MATCH (p)<-[:CONTAINS]-(o:Order {status: 'P'}) WITH count(o) AS n WHERE n = 0 RETURN n } RETURN count(*) AS n",
        "SELECT count(*) AS n FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_partkey = p_partkey AND o_orderstatus = 'P')",
    ),
    "exists_aggregate": (
        "MATCH (c:Customer) RETURN EXISTS { MATCH (c)-[:PLACED]->(o:Order) WITH sum(o.totalprice) AS total, count(o) AS k WHERE total > 200000 * k RETURN k } AS dear, count(*) AS n",
        "SELECT coalesce(t > 200000 * k, false) AS dear, count(*) AS n FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS t, count(*) AS k FROM orders GROUP BY 1) ON o_custkey = c_custkey GROUP BY 1",
    ),
    "collect_mixed_order": (
        "MATCH (c:Customer)-[:IN_NATION]->(n:Nation) WHERE c.custkey < 300 WITH n, c ORDER BY c.mktsegment DESC, c.custkey RETURN n.name AS nation, collect(c.custkey) AS l",
        "SELECT n_name AS nation, list(c_custkey ORDER BY c_mktsegment DESC, c_custkey) AS l FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey < 300 GROUP BY 1",
    ),
    "collect_null_order": (
        "MATCH (d:Document) WHERE d.doc_id < 300 WITH d ORDER BY d.quality, d.doc_id RETURN d.lang AS lang, collect(d.doc_id) AS l",
        "SELECT lang, list(doc_id ORDER BY quality NULLS LAST, doc_id) AS l FROM documents LEFT JOIN labels USING (doc_id) WHERE doc_id < 300 GROUP BY 1",
    ),
    "agg_percentile_distinct": (
        "MATCH (:Order)-[c:CONTAINS]->(:Part) RETURN c.returnflag AS f, percentileCont(DISTINCT c.quantity, 0.3) AS p, round(stDev(DISTINCT c.quantity) * 1000) AS s",
        "SELECT l_returnflag AS f, quantile_cont(q, 0.3) AS p, round(stddev_samp(q) * 1000) AS s FROM (SELECT DISTINCT l_returnflag, l_quantity AS q FROM lineitem) GROUP BY 1",
    ),
    "rounding": (
        "UNWIND [0.49999999999999994, 0.5, -2.5, 4503599627370497.0, 2.4] AS x RETURN x, round(x) AS r, floor(x) AS f, ceil(x) AS c",
        "SELECT * FROM (VALUES (0.49999999999999994::DOUBLE, 0::DOUBLE, 0::DOUBLE, 1::DOUBLE), (0.5, 1, 0, 1), (-2.5, -3, -3, -2), (4503599627370497.0, 4503599627370497.0, 4503599627370497.0, 4503599627370497.0), (2.4, 2, 2, 3)) v(x, r, f, c)",
    ),
    "bound_relationship": (
        "MATCH (n:Nation)-[r:IN_REGION]->(g:Region {regionkey: 1}) WITH r MATCH (a)-[r]->(b) RETURN a.name AS a, b.name AS b, type(r) AS t",
        "SELECT n_name AS a, r_name AS b, 'IN_REGION' AS t FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey = 1",
    ),
    "bound_relationship_list": (
        "MATCH (a:Turn {turn: 0, conv_id: 3})-[rs:NEXT*2]->() WITH rs MATCH (x)-[rs*]->(y) RETURN x.turn AS x, y.turn AS y, size(rs) AS n",
        "SELECT CAST(0 AS BIGINT) AS x, CAST(2 AS BIGINT) AS y, CAST(2 AS BIGINT) AS n FROM conversations WHERE conv_id = 3 AND turn = 2",
    ),
    "return_star": (
        "MATCH (n:Nation)-[:IN_REGION]->(r:Region) WITH n.name AS nation, r.name AS region WITH * WHERE nation < 'G' RETURN *",
        "SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name < 'G'",
    ),
    "null_bound_match": (
        "MATCH (n:Nation) OPTIONAL MATCH (n)<-[:IN_NATION]-(s:Supplier) WHERE s.acctbal > 9000 WITH n, s MATCH (s)<-[:SUPPLIED_BY]-(o:Order) RETURN n.name AS nation, count(o) AS orders",
        "SELECT n_name AS nation, count(*) AS orders FROM nation JOIN supplier ON s_nationkey = n_nationkey JOIN lineitem ON l_suppkey = s_suppkey WHERE s_acctbal > 9000 GROUP BY 1",
    ),
    "properties_map": (
        "MATCH (r:Region) WITH properties(r) AS m RETURN m.name AS name, m.regionkey AS k, exists(m.name) AS has",
        "SELECT r_name AS name, CAST(r_regionkey AS BIGINT) AS k, true AS has FROM region",
    ),
    "log_functions": (
        "MATCH (p:Part) WHERE p.partkey < 50 RETURN p.partkey AS k, round(exp(p.size / 10.0) * 1000) AS e, round(log(p.retailprice) * 1000) AS l, round(log10(p.retailprice) * 1000) AS g, round((pi() + e()) * 1000) AS c",
        "SELECT p_partkey AS k, round(exp(p_size / 10.0) * 1000) AS e, round(ln(p_retailprice) * 1000) AS l, round(log10(p_retailprice) * 1000) AS g, 5860::DOUBLE AS c FROM part WHERE p_partkey < 50",
    ),
    "from_epoch": (
        "UNWIND [0, 1700000000, -1] AS s WITH datetime.fromepoch(s, 0) AS d, datetime.fromepochmillis(s * 1000) AS m RETURN d.year AS y, d.month AS mo, d.second AS s, d = m AS same",
        "SELECT * FROM (VALUES (1970::BIGINT, 1::BIGINT, 0::BIGINT, true), (2023, 11, 20, true), (1969, 12, 59, true)) v(y, mo, s, same)",
    ),
    "duration_between": (
        "MATCH (o:Order) WHERE o.orderkey < 200 WITH o.orderkey AS k, duration.between(date('1992-01-01'), date(o.orderdate)) AS d RETURN k, d.years AS y, d.monthsOfYear AS m, d.days AS days",
        "SELECT k, CAST(m // 12 AS BIGINT) AS y, CAST(m % 12 AS BIGINT) AS m, CAST(date_diff('day', DATE '1992-01-01' + to_months(CAST(m AS INTEGER)), d) AS BIGINT) AS days FROM (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, datesub('month', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS m FROM orders WHERE o_orderkey < 200)",
    ),
    "iso_text": (
        "MATCH (o:Order) WHERE o.orderkey < 200 RETURN o.orderkey AS k, toString(date(o.orderdate)) AS d, toString(date(toString(date(o.orderdate))) + duration('P1M')) AS later",
        "SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH, '%Y-%m-%d') AS later FROM orders WHERE o_orderkey < 200",
    ),
    "time_zones": (
        "UNWIND [1, 7] AS m WITH datetime({year: 2024, month: m, day: 1, hour: 12, timezone: 'Europe/Paris'}) AS d RETURN d.month AS m, d.offset AS o, d.epochSeconds AS s",
        "SELECT * FROM (VALUES (1::BIGINT, '+01:00', 1704106800::BIGINT), (7, '+02:00', 1719828000)) v(m, o, s)",
    ),
    "duration_arithmetic": (
        "UNWIND [1, 2, 3] AS k WITH k, duration({days: 1, hours: 12}) * k + duration('PT30M') AS d RETURN k, d.days AS days, d.minutes AS minutes",
        "SELECT * FROM (VALUES (1::BIGINT, 1::BIGINT, 750::BIGINT), (2, 2, 1470), (3, 3, 2190)) v(k, days, minutes)",
    ),
}

#: name: (updates in order, a query on the updated graph, SQL).
UPDATES: dict[str, tuple[list[str], str, str]] = {
    "merge_labels_view": (
        ["UNWIND [1, 2, 900001] AS k MERGE (s:Supplier {suppkey: k}) ON CREATE SET s:New ON MATCH SET s:Known"],
        "MATCH (s:Supplier) WHERE s:New OR s:Known RETURN s.suppkey AS k, labels(s) AS l",
        "SELECT * FROM (VALUES (1::BIGINT, ['Known', 'Supplier']), (2, ['Known', 'Supplier']), (900001, ['New', 'Supplier'])) v(k, l)",
    ),
    "plain_delete_view": (
        ["CREATE (:Supplier {suppkey: 900002}), (:Supplier {suppkey: 900003})", "MATCH (s:Supplier) WHERE s.suppkey = 900002 DELETE s"],
        "MATCH (s:Supplier) RETURN count(*) AS n, max(s.suppkey) AS k",
        "SELECT count(*) + 1 AS n, CAST(900003 AS BIGINT) AS k FROM supplier",
    ),
    "merge_upsert_view": (
        ["UNWIND [1, 2, 2, 900001] AS k MERGE (s:Supplier {suppkey: k}) ON CREATE SET s.name = 'new', s.acctbal = 0.0 ON MATCH SET s.name = 'seen'"],
        "MATCH (s:Supplier) WHERE s.name IN ['new', 'seen'] RETURN s.suppkey AS k, s.name AS name",
        "SELECT * FROM (VALUES (1::BIGINT, 'seen'), (2, 'seen'), (900001, 'new')) v(k, name)",
    ),
    "merge_edge_view": (
        ["MATCH (c:Customer)-[:PLACED]->(:Order)-[:SUPPLIED_BY]->(s:Supplier) WHERE c.custkey < 20 MERGE (c)-[k:KNOWS]->(s) ON CREATE SET k.since = 2024"],
        "MATCH (c:Customer)-[k:KNOWS]->(s:Supplier) RETURN c.custkey AS c, count(s) AS n, min(k.since) AS since",
        "SELECT o_custkey AS c, count(DISTINCT l_suppkey) AS n, CAST(2024 AS BIGINT) AS since FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey < 20 GROUP BY 1",
    ),
    "detach_delete_view": (
        ["MATCH (o:Order {status: 'P'}) DETACH DELETE o"],
        "MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN o.status AS s, count(*) AS n",
        "SELECT o_orderstatus AS s, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1",
    ),
    "delete_edge_view": (
        ["MATCH (:Order)-[r:CONTAINS {returnflag: 'R'}]->(:Part) DELETE r"],
        "MATCH (:Order)-[r:CONTAINS]->(p:Part) RETURN p.size AS s, count(r) AS n",
        "SELECT CAST(p_size AS BIGINT) AS s, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag <> 'R' GROUP BY 1",
    ),
    "create_set_remove_view": (
        [
            "MATCH (n:Nation) WHERE n.nationkey < 10 CREATE (n)-[:HAS {w: n.nationkey * 2}]->(k:Office {code: n.name, size: n.nationkey})",
            "MATCH (k:Office) WHERE k.size > 4 SET k.size = k.size + 100, k:Big",
            "MATCH (k:Big) WHERE k.size > 107 REMOVE k.code SET k += {note: 'moved'}",
        ],
        "MATCH (n:Nation)-[h:HAS]->(k:Office) RETURN n.nationkey AS n, h.w AS w, k.size AS s, k.code AS c, k.note AS note, k:Big AS big",
        "SELECT k AS n, k * 2 AS w, CASE WHEN k > 4 THEN k + 100 ELSE k END AS s, CASE WHEN k > 7 THEN NULL ELSE n_name END AS c, CASE WHEN k > 7 THEN 'moved' END AS note, k > 4 AS big FROM (SELECT CAST(n_nationkey AS BIGINT) AS k, n_name FROM nation WHERE n_nationkey < 10)",
    ),
}


def _query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: GraphSession(spark, star_graph(spark, folder)).query(text)


def _updated(updates: list[str], text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        session = GraphSession(spark, star_graph(spark, folder))
        with session.begin() as transaction:
            for u in updates:
                transaction.query(u)
        return session.query(text)

    return run


def traverse(spark: SparkSession, folder: str) -> DataFrame:
    """Reachable nodes by least depth, through the typed interface."""
    graph = star_graph(spark, folder)
    start = spark.range(1).select(graph.global_id("Turn", F.lit(0))).head()[0]
    return GraphSession(spark, graph).traverse(start, "NEXT").groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


TRAVERSE_SQL = "SELECT CAST(turn AS INTEGER) AS depth, count(*) AS n FROM conversations WHERE conv_id = 0 AND turn > 0 GROUP BY 1"


def equal_edge_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Edges over rows that repeat: each is an edge of its own."""
    graph = star_graph(spark, folder)
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").select("l_orderkey", "l_returnflag").join(spark.read.parquet(f"{folder}/orders.parquet").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    graph.edge("BOUGHT", lines.select("o_custkey", "l_orderkey"), ("Customer", "o_custkey"), ("Order", "l_orderkey"))
    text = "MATCH (c:Customer)-[r:BOUGHT]->(o:Order)<-[q:BOUGHT]-(d:Customer) WHERE o.orderkey < 300 RETURN o.orderkey AS o, count(*) AS pairs, count(DISTINCT r) AS edges"
    return GraphSession(spark, graph).query(text)


EQUAL_EDGE_ROWS_SQL = "SELECT l_orderkey AS o, count(*) * (count(*) - 1) AS pairs, count(*) AS edges FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_orderkey < 300 GROUP BY 1 HAVING count(*) > 1"


def point_reads(spark: SparkSession, folder: str) -> DataFrame:
    """The typed reads of one node: its row, its neighbours, and an edge by its id."""
    graph = star_graph(spark, folder)
    session, node = GraphSession(spark, graph), graph.id_of("Customer", 7)
    near = session.neighbors(node, "PLACED").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("edge").alias("edges"))
    return session.get_node(node).select("name").crossJoin(near)  # a row each


POINT_READS_SQL = "SELECT c_name AS name, count(o_orderkey) AS n, count(o_orderkey) AS edges FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_custkey = 7 GROUP BY 1"


def explain(spark: SparkSession, folder: str) -> DataFrame:
    return GraphSession(spark, star_graph(spark, folder)).query("EXPLAIN MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.totalprice > 5 RETURN c.name AS n, count(*) AS k ORDER BY k")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: _query(text) for name, (text, _) in QUERIES.items()}
    out |= {name: _updated(updates, text) for name, (updates, text, _) in UPDATES.items()}
    return out | {"traverse": traverse, "equal_edge_rows": equal_edge_rows, "point_reads": point_reads, "explain": explain}


def oracle_sql() -> dict[str, str]:
    out = {name: sql for name, (_, sql) in QUERIES.items() if sql}
    return out | {name: sql for name, (_, _, sql) in UPDATES.items()} | {"traverse": TRAVERSE_SQL, "equal_edge_rows": EQUAL_EDGE_ROWS_SQL, "point_reads": POINT_READS_SQL}
