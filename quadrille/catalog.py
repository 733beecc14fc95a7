"""SPARQL queries over the driver's tables, with the same results as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import terms as T
from .dataset import QuadDataset, map_tables
from .engine import query, update
from .plans.compiler import plain

HEAD = "PREFIX : <http://example.org/tpch#> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#> PREFIX c: <http://example.org/tpch/customer/> "
C = "'http://example.org/tpch/customer/'"
N = "'http://example.org/tpch/nation/'"
R = "'http://example.org/tpch/region/'"
O = "'http://example.org/tpch/orders/'"
P = "'http://example.org/tpch/part/'"
S = "'http://example.org/tpch/supplier/'"

#: name: (SPARQL, SQL)
SPARQL: dict[str, tuple[str, str]] = {
    "pricing_summary": (
        """SELECT ?flag ?status (SUM(?qty) AS ?sum_qty) (SUM(?price * (1 - ?disc)) AS ?revenue) (AVG(?qty) AS ?avg_qty) (COUNT(*) AS ?n)
           WHERE { ?l a :Lineitem ; :l_returnflag ?flag ; :l_linestatus ?status ; :l_quantity ?qty ; :l_extendedprice ?price ; :l_discount ?disc ; :l_shipdate ?d
                   FILTER(?d <= "1998-09-02T00:00:00"^^xsd:dateTime) } GROUP BY ?flag ?status""",
        """SELECT l_returnflag AS flag, l_linestatus AS status, sum(l_quantity) AS sum_qty, sum(l_extendedprice * (1 - l_discount)) AS revenue, avg(l_quantity) AS avg_qty, count(*) AS n
           FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""",
    ),
    "bgp_star_lineitem": (
        "SELECT ?flag ?qty ?tax WHERE { ?l :l_returnflag ?flag ; :l_quantity ?qty ; :l_tax ?tax ; :l_linenumber 1 }",
        "SELECT l_returnflag AS flag, l_quantity AS qty, l_tax AS tax FROM lineitem WHERE l_linenumber = 1",
    ),
    "bgp_chain_nation_region": (
        "SELECT ?n ?nn ?rn WHERE { ?n :n_name ?nn ; :nation.region ?r . ?r :r_name ?rn }",
        f"SELECT {N} || n_nationkey AS n, n_name AS nn, r_name AS rn FROM nation JOIN region ON n_regionkey = r_regionkey",
    ),
    "chain_revenue_by_region": (
        """SELECT ?rn (SUM(?p) AS ?total) (COUNT(?o) AS ?n) WHERE { ?o :o_totalprice ?p ; :orders.customer ?c . ?c :customer.nation ?n1 . ?n1 :nation.region ?r . ?r :r_name ?rn } GROUP BY ?rn""",
        "SELECT r_name AS rn, sum(o_totalprice) AS total, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    ),
    "lineitem_supplier_join": (
        """SELECT ?sn (COUNT(*) AS ?n) (SUM(?q) AS ?qty) WHERE { ?l :lineitem.supplier ?s ; :l_quantity ?q ; :lineitem.orders ?o . ?o :o_orderstatus "F" . ?s :s_name ?sn } GROUP BY ?sn""",
        "SELECT s_name AS sn, count(*) AS n, sum(l_quantity) AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey WHERE o_orderstatus = 'F' GROUP BY 1",
    ),
    "filter_constant_subject": ("SELECT ?n ?b WHERE { c:5 :c_name ?n ; :c_acctbal ?b }", "SELECT c_name AS n, c_acctbal AS b FROM customer WHERE c_custkey = 5"),
    "filter_compare_types": (
        """SELECT ?o ?p WHERE { ?o :o_totalprice ?p ; :o_orderdate ?d ; :o_orderpriority ?x FILTER(?p > 100000 && ?d >= "1997-01-01T00:00:00"^^xsd:dateTime && ?x != "5-LOW") }""",
        f"SELECT {O} || o_orderkey AS o, o_totalprice AS p FROM orders WHERE o_totalprice > 100000 AND o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderpriority <> '5-LOW'",
    ),
    "filter_error_is_false": (
        "SELECT ?c WHERE { ?c :c_name ?n ; :c_mktsegment ?m FILTER(xsd:integer(?m) > 0 || STRLEN(?n) > 17) }",
        f"SELECT {C} || c_custkey AS c FROM customer WHERE coalesce(TRY_CAST(c_mktsegment AS BIGINT) > 0, false) OR length(c_name) > 17",
    ),
    "filter_in": ("""SELECT ?c ?m WHERE { ?c :c_mktsegment ?m FILTER(?m IN ("BUILDING", "MACHINERY")) }""", f"SELECT {C} || c_custkey AS c, c_mktsegment AS m FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')"),
    "filter_not_in": ("SELECT ?p WHERE { ?p :p_size ?s FILTER(?s NOT IN (1, 2, 3, 4, 5)) }", f"SELECT {P} || p_partkey AS p FROM part WHERE p_size NOT IN (1, 2, 3, 4, 5)"),
    "optional_orders_for_customer": (
        "SELECT ?c ?o WHERE { ?c a :Customer OPTIONAL { ?o :orders.customer ?c } }",
        f"SELECT {C} || c_custkey AS c, {O} || o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey",
    ),
    "optional_with_filter": (
        "SELECT ?c ?o ?p WHERE { ?c :c_acctbal ?b OPTIONAL { ?o :orders.customer ?c ; :o_totalprice ?p FILTER(?p > ?b * 40) } }",
        f"SELECT {C} || c_custkey AS c, {O} || o_orderkey AS o, o_totalprice AS p FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 40",
    ),
    "optional_nested": (
        "SELECT ?n ?s ?b WHERE { ?n a :Nation OPTIONAL { ?s :supplier.nation ?n OPTIONAL { ?s :s_acctbal ?b FILTER(?b > 5000) } } }",
        f"SELECT {N} || n_nationkey AS n, {S} || s_suppkey AS s, CASE WHEN s_acctbal > 5000 THEN s_acctbal END AS b FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey",
    ),
    "union_missing_vars": (
        "SELECT ?x ?cn ?sn WHERE { { ?x :c_name ?cn FILTER(STRENDS(?cn, \"7\")) } UNION { ?x :s_name ?sn } }",
        f"SELECT {C} || c_custkey AS x, c_name AS cn, NULL::VARCHAR AS sn FROM customer WHERE c_name LIKE '%7' UNION ALL SELECT {S} || s_suppkey, NULL, s_name FROM supplier",
    ),
    "minus_customers_with_orders": (
        "SELECT ?c WHERE { ?c a :Customer MINUS { ?o :orders.customer ?c ; :o_orderstatus \"P\" } }",
        f"SELECT {C} || c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    ),
    "minus_disjoint_vars": ("SELECT ?r WHERE { ?r a :Region MINUS { ?x :n_name ?y } }", f"SELECT {R} || r_regionkey AS r FROM region"),
    "minus_maybe_unbound": (
        "SELECT ?n ?s WHERE { ?n a :Nation OPTIONAL { ?s :supplier.nation ?n FILTER(?n != <http://example.org/tpch/nation/3>) } MINUS { ?s :s_acctbal ?b FILTER(?b > 3000) } }",
        f"SELECT {N} || n_nationkey AS n, {S} || s_suppkey AS s FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND n_nationkey <> 3 WHERE s_suppkey IS NULL OR s_acctbal <= 3000",
    ),
    "exists_semi": ("SELECT ?c WHERE { ?c a :Customer FILTER EXISTS { ?o :orders.customer ?c ; :o_totalprice ?p FILTER(?p > 200000) } }", f"SELECT {C} || c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)"),
    "not_exists_anti": ("SELECT ?p WHERE { ?p a :Part FILTER NOT EXISTS { ?l :lineitem.part ?p ; :l_quantity ?q FILTER(?q > 45) } }", f"SELECT {P} || p_partkey AS p FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)"),
    "exists_correlated_filter": (
        "SELECT ?c WHERE { ?c :c_acctbal ?b FILTER EXISTS { ?o :orders.customer ?c ; :o_totalprice ?p FILTER(?p > ?b * 30) } }",
        f"SELECT {C} || c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 30)",
    ),
    "exists_in_bind": (
        "SELECT ?c ?has WHERE { ?c a :Customer BIND(EXISTS { ?o :orders.customer ?c ; :o_orderstatus \"P\" } AS ?has) }",
        f"SELECT {C} || c_custkey AS c, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS has FROM customer",
    ),
    "join_unbound_compatible": (
        "SELECT ?r ?n ?nn WHERE { { SELECT ?r ?n WHERE { ?r a :Region OPTIONAL { ?n :nation.region ?r FILTER(?r = <http://example.org/tpch/region/1>) } } } { ?n :n_name ?nn } }",
        f"SELECT {R} || r_regionkey AS r, {N} || m.n_nationkey AS n, m.n_name AS nn FROM region LEFT JOIN nation x ON x.n_regionkey = r_regionkey AND r_regionkey = 1 JOIN nation m ON m.n_nationkey = x.n_nationkey OR x.n_nationkey IS NULL",
    ),
    "theta_join_price_bands": (
        "SELECT ?a ?b WHERE { ?a :s_acctbal ?x . ?b :s_acctbal ?y FILTER(?x < ?y && ?y < ?x + 200) }",
        f"SELECT {S} || a.s_suppkey AS a, {S} || b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_acctbal < b.s_acctbal AND b.s_acctbal < a.s_acctbal + 200",
    ),
    "cartesian_product": ("SELECT ?r ?s WHERE { ?r :r_name ?x . ?s :n_name ?y FILTER(STRLEN(?y) > 7) }", f"SELECT {R} || r_regionkey AS r, {N} || n_nationkey AS s FROM region, nation WHERE length(n_name) > 7"),
    "semijoin_syntax": ("SELECT ?n WHERE { ?n :n_name ?x SEMIJOIN { ?s :supplier.nation ?n } }", f"SELECT {N} || n_nationkey AS n FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)"),
    "antijoin_syntax": ("SELECT ?n WHERE { ?n :n_name ?x ANTIJOIN { ?s :supplier.nation ?n ; :s_acctbal ?b FILTER(?b > 7000) } }", f"SELECT {N} || n_nationkey AS n FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 7000)"),
    "exists_union_correlated": (
        "SELECT ?c WHERE { ?c :c_acctbal ?b ; :c_nationkey ?k FILTER EXISTS { { ?s :s_nationkey ?k ; :s_acctbal ?t FILTER(?t < ?b) } UNION { ?o :orders.customer ?c ; :o_totalprice ?p FILTER(?p < ?b * 20) } } }",
        f"SELECT {C} || c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_acctbal < c_acctbal) OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice < c_acctbal * 20)",
    ),
    "exists_bind_correlated": (
        "SELECT ?c WHERE { ?c :c_acctbal ?b ; :c_nationkey ?k FILTER EXISTS { ?s :s_nationkey ?k ; :s_acctbal ?t BIND(?t - ?b AS ?d) FILTER(?d > 3000) } }",
        f"SELECT {C} || c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_acctbal - c_acctbal > 3000)",
    ),
    "not_exists_optional_correlated": (
        "SELECT ?s ?none WHERE { ?s :s_acctbal ?b ; :s_nationkey ?k BIND(NOT EXISTS { ?n :n_nationkey ?k OPTIONAL { ?c :c_nationkey ?k ; :c_acctbal ?t FILTER(?t > ?b) } FILTER(BOUND(?c)) } AS ?none) }",
        f"SELECT {S} || s_suppkey AS s, NOT EXISTS (SELECT 1 FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_nationkey = s_nationkey AND c_acctbal > s_acctbal) AS none FROM supplier",
    ),
    "lateral_aggregate": (
        "SELECT ?c ?n ?t WHERE { ?c :c_mktsegment \"BUILDING\" LATERAL { SELECT (COUNT(?o) AS ?n) (MAX(?p) AS ?t) WHERE { ?o :orders.customer ?c ; :o_totalprice ?p ; :o_orderstatus \"P\" } } }",
        f"SELECT {C} || c_custkey AS c, count(o_orderkey) AS n, max(o_totalprice) AS t FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' WHERE c_mktsegment = 'BUILDING' GROUP BY c_custkey",
    ),
    "lateral_group_by": (
        "SELECT ?c ?f ?n WHERE { ?c :c_mktsegment \"BUILDING\" LATERAL { SELECT ?f (COUNT(*) AS ?n) WHERE { ?o :orders.customer ?c ; :o_orderstatus ?f } GROUP BY ?f } }",
        f"SELECT {C} || c_custkey AS c, o_orderstatus AS f, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY ALL",
    ),
    "lateral_filter": (
        "SELECT ?c ?o WHERE { ?c :c_acctbal ?b LATERAL { ?o :orders.customer ?c ; :o_totalprice ?p FILTER(?p < ?b * 20) } }",
        f"SELECT {C} || c_custkey AS c, {O} || o_orderkey AS o FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice < c_acctbal * 20",
    ),
    "path_star_mapped": ("SELECT ?x ?y WHERE { ?x (^:orders.customer/:orders.customer)* ?y }", f"SELECT {C} || c_custkey AS x, {C} || c_custkey AS y FROM customer"),
    "lateral_topk": (
        "SELECT ?c ?k WHERE { ?c :c_mktsegment \"BUILDING\" LATERAL { SELECT ?c ?k WHERE { ?o :orders.customer ?c ; :o_totalprice ?k } ORDER BY DESC(?k) LIMIT 2 } }",
        f"SELECT {C} || c_custkey AS c, o_totalprice AS k FROM customer JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS i FROM orders) ON o_custkey = c_custkey WHERE i <= 2 AND c_mktsegment = 'BUILDING'",
    ),
    "values_undef": (
        "SELECT ?n ?nn ?k WHERE { ?n :n_name ?nn VALUES (?nn ?k) { (\"FRANCE\" 1) (\"NATION_3\" 2) (UNDEF 3) } }",
        f"SELECT {N} || n_nationkey AS n, n_name AS nn, v.k::BIGINT AS k FROM nation JOIN (VALUES ('FRANCE', 1), ('NATION_3', 2), (NULL, 3)) v(x, k) ON v.x = n_name OR v.x IS NULL",
    ),
    "trailing_values": (
        "SELECT ?c ?m WHERE { ?c :c_mktsegment ?m } VALUES ?m { \"BUILDING\" \"AUTOMOBILE\" }",
        f"SELECT {C} || c_custkey AS c, c_mktsegment AS m FROM customer WHERE c_mktsegment IN ('BUILDING', 'AUTOMOBILE')",
    ),
    "bind_extend": ("SELECT ?p ?t WHERE { ?p :p_retailprice ?r ; :p_size ?s BIND(?r * ?s AS ?t) FILTER(?t > 20000) }", f"SELECT {P} || p_partkey AS p, p_retailprice * p_size AS t FROM part WHERE p_retailprice * p_size > 20000"),
    "let_assign": ("SELECT ?p ?t WHERE { ?p :p_size ?s LET (?t := ?s + 1) }", f"SELECT {P} || p_partkey AS p, p_size::BIGINT + 1 AS t FROM part"),
    "subselect_topk": (
        "SELECT ?n ?p WHERE { { SELECT ?c ?p WHERE { ?o :orders.customer ?c ; :o_totalprice ?p } ORDER BY DESC(?p) ?o LIMIT 10 } ?c :c_name ?n }",
        "SELECT c_name AS n, p FROM (SELECT o_custkey, o_totalprice AS p FROM orders ORDER BY o_totalprice DESC, 'x' || o_orderkey LIMIT 10) JOIN customer ON c_custkey = o_custkey",
    ),
    "distinct_projection": ("SELECT DISTINCT ?b ?s WHERE { ?p :p_brand ?b ; :p_size ?s }", "SELECT DISTINCT p_brand AS b, p_size::BIGINT AS s FROM part"),
    "reduced_projection": ("SELECT REDUCED ?m WHERE { ?c :c_mktsegment ?m }", "SELECT c_mktsegment AS m FROM customer"),
    "order_limit_offset": ("SELECT ?p ?n WHERE { ?p :p_retailprice ?r ; :p_name ?n } ORDER BY DESC(?r) ?p LIMIT 20 OFFSET 5", f"SELECT {P} || p_partkey AS p, p_name AS n FROM part ORDER BY p_retailprice DESC, {P} || p_partkey LIMIT 20 OFFSET 5"),
    "select_star": ("SELECT * WHERE { ?r :r_name ?rn ; :r_regionkey ?k }", f"SELECT {R} || r_regionkey AS r, r_name AS rn, r_regionkey::BIGINT AS k FROM region"),
    "blank_node_pattern": ("SELECT ?rn WHERE { [] :nation.region ?r . ?r :r_name ?rn }", "SELECT r_name AS rn FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "agg_all": (
        "SELECT ?m (COUNT(?b) AS ?n) (SUM(?b) AS ?s) (AVG(?b) AS ?a) (MIN(?b) AS ?lo) (MAX(?b) AS ?hi) (SAMPLE(?m) AS ?x) WHERE { ?c :c_mktsegment ?m ; :c_acctbal ?b } GROUP BY ?m",
        "SELECT c_mktsegment AS m, count(*) AS n, sum(c_acctbal) AS s, avg(c_acctbal) AS a, min(c_acctbal) AS lo, max(c_acctbal) AS hi, c_mktsegment AS x FROM customer GROUP BY c_mktsegment",
    ),
    "agg_distinct": (
        "SELECT ?b (COUNT(DISTINCT ?s) AS ?n) (SUM(DISTINCT ?s) AS ?t) (COUNT(DISTINCT *) AS ?k) WHERE { ?p :p_brand ?b ; :p_size ?s } GROUP BY ?b",
        "SELECT p_brand AS b, count(DISTINCT p_size) AS n, sum(DISTINCT p_size)::BIGINT AS t, count(*) AS k FROM part GROUP BY 1",
    ),
    "having": ("SELECT ?c (COUNT(*) AS ?n) WHERE { ?o :orders.customer ?c } GROUP BY ?c HAVING(COUNT(*) > 12)", f"SELECT {C} || o_custkey AS c, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12"),
    "group_by_expression": ("SELECT ?y (SUM(?p) AS ?t) WHERE { ?o :o_orderdate ?d ; :o_totalprice ?p } GROUP BY (YEAR(?d) AS ?y)", "SELECT year(o_orderdate)::BIGINT AS y, sum(o_totalprice) AS t FROM orders GROUP BY 1"),
    "implicit_group_empty": ("SELECT (COUNT(*) AS ?n) (SUM(?p) AS ?s) (MIN(?p) AS ?m) WHERE { ?o :o_totalprice ?p FILTER(?p < 0) }", "SELECT 0::BIGINT AS n, 0.0::DOUBLE AS s, NULL::DOUBLE AS m"),
    "group_concat_sorted": ("SELECT ?r (GROUP_CONCAT(?n; SEPARATOR=\"|\") AS ?ns) WHERE { ?x :nation.region ?r ; :n_name ?n } GROUP BY ?r", f"SELECT {R} || n_regionkey AS r, string_agg(n_name, '|' ORDER BY n_name) AS ns FROM nation GROUP BY n_regionkey"),
    "count_optional_unbound": ("SELECT ?c (COUNT(?o) AS ?n) WHERE { ?c a :Customer OPTIONAL { ?o :orders.customer ?c } } GROUP BY ?c", f"SELECT {C} || c_custkey AS c, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey"),
    "path_sequence": ("SELECT ?c ?rn WHERE { ?c :customer.nation/:nation.region/:r_name ?rn }", f"SELECT {C} || c_custkey AS c, r_name AS rn FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "path_inverse": ("SELECT ?r ?s WHERE { ?r ^:nation.region/^:supplier.nation ?s }", f"SELECT {R} || n_regionkey AS r, {S} || s_suppkey AS s FROM nation JOIN supplier ON s_nationkey = n_nationkey"),
    "path_alternative": ("SELECT ?x ?n WHERE { ?x :customer.nation|:supplier.nation ?n }", f"SELECT {C} || c_custkey AS x, {N} || c_nationkey AS n FROM customer UNION ALL SELECT {S} || s_suppkey, {N} || s_nationkey FROM supplier"),
    "fn_string": (
        """SELECT ?p (STRLEN(?n) AS ?l) (UCASE(?n) AS ?u) (LCASE(?n) AS ?w) (SUBSTR(?n, 2, 4) AS ?s) (STRBEFORE(?n, "a") AS ?b) (STRAFTER(?n, "a") AS ?a) (CONCAT(?n, "-", ?t) AS ?c) (CONTAINS(?n, "e") AS ?x) (STRSTARTS(?t, "S") AS ?y) (STRENDS(?t, "L") AS ?z)
           WHERE { ?p :p_name ?n ; :p_type ?t }""",
        f"""SELECT {P} || p_partkey AS p, length(p_name) AS l, upper(p_name) AS u, lower(p_name) AS w, substr(p_name, 2, 4) AS s, CASE WHEN instr(p_name, 'a') > 0 THEN substr(p_name, 1, instr(p_name, 'a') - 1) ELSE '' END AS b,
           CASE WHEN instr(p_name, 'a') > 0 THEN substr(p_name, instr(p_name, 'a') + 1) ELSE '' END AS a, p_name || '-' || p_type AS c, contains(p_name, 'e') AS x, starts_with(p_type, 'S') AS y, ends_with(p_type, 'L') AS z FROM part""",
    ),
    "fn_regex_replace": (
        """SELECT ?c (REPLACE(?n, "[0-9]+", "#") AS ?r) (REGEX(?n, "customer.*9$", "i") AS ?m) (ENCODE_FOR_URI(?n) AS ?e) WHERE { ?c :c_name ?n }""",
        f"SELECT {C} || c_custkey AS c, regexp_replace(c_name, '[0-9]+', '#', 'g') AS r, regexp_matches(c_name, 'customer.*9$', 'i') AS m, url_encode(c_name) AS e FROM customer",
    ),
    "fn_numeric": (
        "SELECT ?c (ABS(?b) AS ?a) (ROUND(?b) AS ?r) (CEIL(?b) AS ?u) (FLOOR(?b) AS ?d) (-?b AS ?n) (?b / 3 AS ?q) WHERE { ?c :c_acctbal ?b }",
        f"SELECT {C} || c_custkey AS c, abs(c_acctbal) AS a, floor(c_acctbal + 0.5) AS r, ceil(c_acctbal) AS u, floor(c_acctbal) AS d, -c_acctbal AS n, c_acctbal / 3 AS q FROM customer",
    ),
    "fn_integer_division": ("SELECT ?p (xsd:double(?s / 7) AS ?q) (?s * 2 - 1 AS ?t) (?s / 0 AS ?z) WHERE { ?p :p_size ?s }", f"SELECT {P} || p_partkey AS p, (p_size::DECIMAL(20,0) / 7)::DOUBLE AS q, p_size::BIGINT * 2 - 1 AS t, NULL::DOUBLE AS z FROM part"),
    "fn_date": (
        "SELECT ?o (YEAR(?d) AS ?y) (MONTH(?d) AS ?m) (DAY(?d) AS ?dd) (HOURS(?d) AS ?h) (MINUTES(?d) AS ?mi) (TZ(?d) AS ?tz) WHERE { ?o :o_orderdate ?d }",
        f"SELECT {O} || o_orderkey AS o, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS dd, hour(o_orderdate) AS h, minute(o_orderdate) AS mi, '' AS tz FROM orders",
    ),
    "fn_hash": ("SELECT ?n (MD5(?x) AS ?a) (SHA1(?x) AS ?b) (SHA256(?x) AS ?c) WHERE { ?n :n_name ?x }", f"SELECT {N} || n_nationkey AS n, md5(n_name) AS a, sha1(n_name) AS b, sha256(n_name) AS c FROM nation"),
    "fn_terms": (
        "SELECT ?c (STR(?c) AS ?s) (DATATYPE(?b) AS ?d) (LANG(?n) AS ?l) (isIRI(?c) AS ?i) (isLiteral(?b) AS ?lit) (isNumeric(?n) AS ?num) (isBlank(?c) AS ?bl) (sameTerm(?n, ?n) AS ?st) (BOUND(?zz) AS ?bd) WHERE { ?c :c_acctbal ?b ; :c_name ?n }",
        f"SELECT {C} || c_custkey AS c, {C} || c_custkey AS s, 'http://www.w3.org/2001/XMLSchema#double' AS d, '' AS l, true AS i, true AS lit, false AS num, false AS bl, true AS st, false AS bd FROM customer",
    ),
    "fn_conditional": (
        "SELECT ?c (IF(?b > 0, \"plus\", \"minus\") AS ?s) (COALESCE(?nope, ?n) AS ?x) WHERE { ?c :c_acctbal ?b ; :c_name ?n }",
        f"SELECT {C} || c_custkey AS c, CASE WHEN c_acctbal > 0 THEN 'plus' ELSE 'minus' END AS s, c_name AS x FROM customer",
    ),
    "fn_cast": (
        "SELECT ?p (xsd:string(?s) AS ?a) (xsd:double(?s) AS ?b) (xsd:integer(\"12x\") AS ?c) (xsd:boolean(?s) AS ?d) (xsd:integer(xsd:string(?s)) AS ?e) WHERE { ?p :p_size ?s }",
        f"SELECT {P} || p_partkey AS p, p_size::VARCHAR AS a, p_size::DOUBLE AS b, NULL::BIGINT AS c, p_size <> 0 AS d, p_size::BIGINT AS e FROM part",
    ),
    "fn_iri_constructors": (
        "SELECT ?n (IRI(CONCAT(\"http://x/\", STR(?k))) AS ?i) WHERE { ?n :n_nationkey ?k }",
        f"SELECT {N} || n_nationkey AS n, 'http://x/' || n_nationkey AS i FROM nation",
    ),
    "event_users_by_type": (
        "SELECT ?t (COUNT(*) AS ?n) (COUNT(DISTINCT ?u) AS ?users) (MAX(?v) AS ?top) WHERE { ?e :event_type ?t ; :user_id ?u ; :value ?v } GROUP BY ?t",
        "SELECT event_type AS t, count(*) AS n, count(DISTINCT user_id) AS users, max(value) AS top FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL GROUP BY 1",
    ),
    "ask_exists": ("ASK { ?c :c_acctbal ?b FILTER(?b > 9000) }", "SELECT count(*) > 0 AS ask FROM customer WHERE c_acctbal > 9000"),
}


def _sparql(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(map_tables(spark, sf_dir), HEAD + text)


def flat(df: DataFrame) -> DataFrame:
    """Triples with the object's kind and lexical form, for comparison with SQL."""
    return df.select("s", "p", F.col("o.k").cast("int").alias("k"), F.col("o.v").alias("v"))


def _small(spark: SparkSession, sf_dir: str) -> QuadDataset:
    """nation, region, customer and supplier as quads; customers in a named graph of their market segment."""
    d = map_tables(spark, sf_dir)
    triples = query(
        d,
        HEAD + """CONSTRUCT { ?n :n_name ?nn ; :region ?r . ?r :r_name ?rn . ?s :s_name ?sn ; :nation ?n }
        WHERE { ?n :n_name ?nn ; :nation.region ?r . ?r :r_name ?rn OPTIONAL { ?s :supplier.nation ?n ; :s_name ?sn } }""",
    )
    from .engine import construct
    from .plans.compiler import Compiler, Context
    from .plans.parser import parse_query

    q = parse_query(HEAD + 'CONSTRUCT { GRAPH ?g { ?c :c_name ?n ; :nation ?x } } WHERE { ?c :c_name ?n ; :customer.nation ?x ; :c_mktsegment ?m BIND(IRI(CONCAT("http://g/", ?m)) AS ?g) }')
    named = construct(Compiler(d).pattern(q.where, Context()), q.template)
    quads = triples.select(F.lit(None).cast("string").alias("g"), "s", "p", "o").union(named.select("g", "s", "p", "o"))
    return QuadDataset(quads, {"": "http://example.org/tpch#"})


def construct_triples(spark, sf_dir):
    return flat(query(map_tables(spark, sf_dir), HEAD + "CONSTRUCT { ?n :in ?r . ?n :label ?x } WHERE { ?n :n_name ?x ; :nation.region ?r }"))


def describe_customer(spark, sf_dir):
    return flat(query(map_tables(spark, sf_dir), HEAD + "DESCRIBE c:3"))


def graph_var_by_segment(spark, sf_dir):
    return query(_small(spark, sf_dir), "SELECT ?g (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?c :c_name ?x } } GROUP BY ?g")


def graph_constant(spark, sf_dir):
    return plain(query(_small(spark, sf_dir), "SELECT ?c ?n WHERE { GRAPH <http://g/BUILDING> { ?c :nation ?n } }"))


def from_graphs(spark, sf_dir):
    return query(_small(spark, sf_dir), "SELECT ?c FROM <http://g/BUILDING> FROM <http://g/MACHINERY> WHERE { ?c :c_name ?n }")


def quads_join_default_named(spark, sf_dir):
    return plain(query(_small(spark, sf_dir), "SELECT ?c ?nn WHERE { GRAPH ?g { ?c :nation ?n } ?n :n_name ?nn . ?n :region/:r_name \"ASIA\" }"))


def path_negated(spark, sf_dir):
    out = query(_small(spark, sf_dir), "SELECT ?s ?o WHERE { ?s !(:n_name|:r_name|:s_name) ?o }")
    return out.select("s", F.col("o.v").alias("o"))


def path_optional(spark, sf_dir):
    out = query(_small(spark, sf_dir), "SELECT ?x WHERE { <http://example.org/tpch/nation/1> :region? ?x }")
    return out.select(F.col("x.v").alias("x"))


def part_edges(spark, sf_dir) -> QuadDataset:
    """part -> part // 2, over all parts."""
    base = "http://example.org/tpch/part/"
    df = spark.read.parquet(f"{sf_dir}/part.parquet").filter("p_partkey > 0")
    o = F.struct(F.lit(T.IRI_KIND).cast("tinyint").alias("k"), F.concat(F.lit(base), F.expr("p_partkey div 2").cast("string")).alias("v"), F.lit(None).cast("string").alias("dt"), F.lit(None).cast("string").alias("lang"))
    return QuadDataset(df.select(F.lit(None).cast("string").alias("g"), F.concat(F.lit(base), F.col("p_partkey").cast("string")).alias("s"), F.lit("http://e/up").alias("p"), o.alias("o")))


def path_plus(spark, sf_dir):
    return query(part_edges(spark, sf_dir), "SELECT ?x ?y WHERE { ?x <http://e/up>+ ?y }").select(F.col("x.v").alias("x"), F.col("y.v").alias("y"))


def path_star_from_constant(spark, sf_dir):
    return query(part_edges(spark, sf_dir), "SELECT ?y WHERE { <http://example.org/tpch/part/77> <http://e/up>* ?y }").select(F.col("y.v").alias("y"))


def path_star_to_constant(spark, sf_dir):
    return query(part_edges(spark, sf_dir), "SELECT ?x WHERE { ?x <http://e/up>* <http://example.org/tpch/part/5> }").select(F.col("x.v").alias("x"))


def path_range_1_3(spark, sf_dir):
    return query(part_edges(spark, sf_dir), "SELECT ?x ?y WHERE { ?x <http://e/up>{1,3} ?y }").select(F.col("x.v").alias("x"), F.col("y.v").alias("y"))


def union_distinct_default(spark, sf_dir):
    return query(_small(spark, sf_dir).union_default(), "SELECT (COUNT(*) AS ?n) WHERE { ?s ?p ?o }")


def insert_delete_data(spark, sf_dir):
    d = update(_small(spark, sf_dir), 'INSERT DATA { <http://x/1> :n_name "NEW" } ; DELETE DATA { <http://example.org/tpch/nation/1> :region <http://example.org/tpch/region/1> }')
    return flat(d.default_graph())


def delete_where(spark, sf_dir):
    return flat(update(_small(spark, sf_dir), "DELETE WHERE { ?s :s_name ?n }").default_graph())


def modify_rename(spark, sf_dir):
    d = update(_small(spark, sf_dir), "DELETE { ?n :region ?r } INSERT { ?n :inRegion ?rn } WHERE { ?n :region ?r . ?r :r_name ?rn }")
    return flat(d.default_graph())


def copy_move_graph(spark, sf_dir):
    d = update(_small(spark, sf_dir), "COPY <http://g/BUILDING> TO <http://g/b2> ; MOVE <http://g/MACHINERY> TO DEFAULT ; DROP GRAPH <http://g/FURNITURE> ; ADD <http://g/b2> TO <http://g/AUTOMOBILE>")
    return d.quads.select(F.coalesce("g", F.lit("default")).alias("g"), "s", "p").groupBy("g", "p").agg(F.count(F.lit(1)).alias("n"))


TPCH = "@prefix : <http://example.org/tpch#> . @prefix sh: <http://www.w3.org/ns/shacl#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> . "


def _mapped(spark: SparkSession, sf_dir: str, *tables: str) -> QuadDataset:
    """Tables materialised as quads."""
    from .dataset import TPCH as LAYOUT

    return map_tables(spark, sf_dir, {t: LAYOUT[t] for t in tables}).as_quads()


def _shacl(tables: tuple[str, ...], shape: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from .shacl import validate

        out = validate(_mapped(spark, sf_dir, *tables), TPCH + shape)
        short = F.regexp_extract("component", "#(.*)ConstraintComponent$", 1)
        return out.select(F.col("focus.v").alias("focus"), F.col("value.v").alias("value"), short.alias("component"))

    return run


def shacl_summary(spark, sf_dir):
    from .shacl import summary, validate

    shape = ":S a sh:NodeShape ; sh:targetClass :Customer ; sh:property [ sh:path :c_mktsegment ; sh:in ( \"BUILDING\" \"MACHINERY\" ) ; sh:severity sh:Warning ] , [ sh:path :c_acctbal ; sh:minInclusive 0.0 ] ."
    return summary(validate(_mapped(spark, sf_dir, "customer"), TPCH + shape))


#: name: (tables, shape, SQL for focus, value, component)
SHACL: dict[str, tuple[tuple[str, ...], str, str]] = {
    "shacl_min_count": (("customer", "orders"), ":S sh:targetClass :Customer ; sh:property [ sh:path [ sh:inversePath :orders.customer ] ; sh:minCount 5 ] .", f"SELECT {C} || c_custkey AS focus, NULL::VARCHAR AS value, 'MinCount' AS component FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey HAVING count(o_orderkey) < 5"),
    "shacl_max_count": (("customer", "orders"), ":S sh:targetClass :Customer ; sh:property [ sh:path [ sh:inversePath :orders.customer ] ; sh:maxCount 12 ] .", f"SELECT {C} || o_custkey AS focus, NULL::VARCHAR AS value, 'MaxCount' AS component FROM orders GROUP BY o_custkey HAVING count(*) > 12"),
    "shacl_datatype": (("part",), ":S sh:targetClass :Part ; sh:property [ sh:path :p_size ; sh:datatype xsd:double ] .", f"SELECT {P} || p_partkey AS focus, p_size::VARCHAR AS value, 'Datatype' AS component FROM part"),
    "shacl_range": (("part",), ":S sh:targetClass :Part ; sh:property [ sh:path :p_size ; sh:minInclusive 10 ; sh:maxExclusive 40 ] .", f"SELECT {P} || p_partkey AS focus, p_size::VARCHAR AS value, CASE WHEN p_size < 10 THEN 'MinInclusive' ELSE 'MaxExclusive' END AS component FROM part WHERE p_size < 10 OR p_size >= 40"),
    "shacl_in": (("customer",), ":S sh:targetClass :Customer ; sh:property [ sh:path :c_mktsegment ; sh:in ( \"BUILDING\" \"MACHINERY\" ) ] .", f"SELECT {C} || c_custkey AS focus, c_mktsegment AS value, 'In' AS component FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')"),
    "shacl_pattern_length": (("customer",), ":S sh:targetClass :Customer ; sh:property [ sh:path :c_name ; sh:pattern \"[0-8]$\" ; sh:maxLength 17 ] .", f"SELECT {C} || c_custkey AS focus, c_name AS value, 'Pattern' AS component FROM customer WHERE NOT regexp_matches(c_name, '[0-8]$') UNION ALL SELECT {C} || c_custkey, c_name, 'MaxLength' FROM customer WHERE length(c_name) > 17"),
    "shacl_class_node_kind": (("nation", "region"), ":S sh:targetSubjectsOf :nation.region ; sh:property [ sh:path :nation.region ; sh:class :Nation ; sh:nodeKind sh:IRI ] .", f"SELECT {N} || n_nationkey AS focus, {R} || n_regionkey AS value, 'Class' AS component FROM nation"),
    "shacl_less_than": (("part",), ":S sh:targetClass :Part ; sh:property [ sh:path :p_partkey ; sh:lessThan :p_size ] .", f"SELECT {P} || p_partkey AS focus, p_partkey::VARCHAR AS value, 'LessThan' AS component FROM part WHERE p_partkey >= p_size"),
    "shacl_equals_disjoint": (("part",), ":S sh:targetClass :Part ; sh:property [ sh:path :p_partkey ; sh:disjoint :p_size ] .", f"SELECT {P} || p_partkey AS focus, p_partkey::VARCHAR AS value, 'Disjoint' AS component FROM part WHERE p_partkey = p_size"),
    "shacl_logic": (("part",), ":S sh:targetClass :Part ; sh:or ( [ sh:property [ sh:path :p_size ; sh:minInclusive 25 ] ] [ sh:property [ sh:path :p_retailprice ; sh:maxInclusive 1000 ] ] ) ; sh:not [ sh:property [ sh:path :p_size ; sh:maxInclusive 3 ] ] .", f"SELECT {P} || p_partkey AS focus, {P} || p_partkey AS value, 'Or' AS component FROM part WHERE NOT (p_size >= 25 OR p_retailprice <= 1000) UNION ALL SELECT {P} || p_partkey, {P} || p_partkey, 'Not' FROM part WHERE p_size <= 3"),
    "shacl_qualified": (("nation", "supplier"), ":S sh:targetClass :Nation ; sh:property [ sh:path [ sh:inversePath :supplier.nation ] ; sh:qualifiedValueShape [ sh:property [ sh:path :s_acctbal ; sh:minInclusive 5000.0 ] ] ; sh:qualifiedMinCount 1 ] .", f"SELECT {N} || n_nationkey AS focus, NULL::VARCHAR AS value, 'QualifiedMinCount' AS component FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal >= 5000)"),
    "shacl_closed": (("region",), ":S sh:targetClass :Region ; sh:closed true ; sh:ignoredProperties ( <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> ) ; sh:property [ sh:path :r_name ] .", f"SELECT {R} || r_regionkey AS focus, r_regionkey::VARCHAR AS value, 'Closed' AS component FROM region"),
    "shacl_sparql": (("customer",), ":S sh:targetClass :Customer ; sh:sparql [ sh:select \"SELECT $this ?value WHERE { $this <http://example.org/tpch#c_acctbal> ?value FILTER(?value < 0) }\" ] .", f"SELECT {C} || c_custkey AS focus, c_acctbal::VARCHAR AS value, 'SPARQL' AS component FROM customer WHERE c_acctbal < 0"),
    "shacl_has_value_path": (("customer", "nation"), ":S sh:targetClass :Customer ; sh:property [ sh:path ( :customer.nation :n_regionkey ) ; sh:hasValue 1 ] .", f"SELECT {C} || c_custkey AS focus, NULL::VARCHAR AS value, 'HasValue' AS component FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 1"),
}

# graph algebra and schema


def _parts(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Base, additions and deletions made of nations: names of all, of keys above 20 twice in other forms, of even keys."""
    d = _mapped(spark, sf_dir, "nation")
    names = d.default_graph().filter(F.col("p") == "http://example.org/tpch#n_name")
    key = F.regexp_extract("s", "([0-9]+)$", 1).cast("int")
    return names, names.filter(key > 20).withColumn("s", F.concat("s", F.lit("-new"))).union(names.filter(key < 3)), names.filter(key % 2 == 0)


def delta_apply(spark, sf_dir):
    from .operators.graphs import Delta

    return flat(Delta(*_parts(spark, sf_dir)).graph())


def delta_missing_preconditions(spark, sf_dir):
    base, add, _ = _parts(spark, sf_dir)
    return flat(add.join(base, ["s", "p", "o"], "left_anti"))


def disjoint_union_count(spark, sf_dir):
    from .operators.graphs import disjoint_union

    base, add, gone = _parts(spark, sf_dir)
    return disjoint_union(base, add, gone).agg(F.count(F.lit(1)).alias("n"))


def uuid_normalise(spark, sf_dir):
    from .sources.ids import uuid_column

    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    raw = F.concat(F.when(F.col("c_custkey") % 3 == 0, "#_").otherwise("_"), F.when(F.col("c_custkey") % 2 == 0, F.upper(F.md5("c_name"))).when(F.col("c_custkey") % 5 == 0, "none").otherwise(F.md5("c_name")))
    return c.select("c_custkey", uuid_column(raw).alias("iri"))


PROFILE = """@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix cims: <http://iec.ch/TC57/1999/rdf-schema-extensions-19990926#> .
@prefix uml: <http://iec.ch/TC57/NonStandard/UML#> . @prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> . @prefix : <http://example.org/tpch#> . @prefix d: <http://d/> .
<http://onto/1> a owl:Ontology ; owl:versionIRI <http://onto/1/1.0> .
:Customer a rdfs:Class ; cims:stereotype uml:concrete ; rdfs:subClassOf :Party . :Supplier a rdfs:Class ; rdfs:subClassOf :Party . :Party a rdfs:Class ; rdfs:subClassOf :Thing . :Thing a rdfs:Class .
:Nation a rdfs:Class ; cims:stereotype uml:concrete , "Description" . d:String a rdfs:Class ; cims:stereotype "Primitive" . d:Float a rdfs:Class ; cims:stereotype "Primitive" . d:Money a rdfs:Class ; cims:stereotype "CIMDatatype" .
d:Money.value a rdf:Property ; rdfs:domain d:Money ; cims:dataType d:Float . :c_name a rdf:Property ; rdfs:domain :Customer ; cims:dataType d:String . :c_acctbal a rdf:Property ; rdfs:domain :Customer ; cims:dataType d:Money .
:customer.nation a rdf:Property ; rdfs:domain :Customer ; rdfs:range :Nation . :unused a rdf:Property ; rdfs:domain :Customer ; rdfs:range :Nation ; cims:AssociationUsed "No" . :n_name a rdf:Property ; rdfs:domain :Nation ; rdfs:range <http://www.w3.org/2001/XMLSchema#string> ; cims:multiplicity cims:M:0..1 .
"""


def registry_typed_properties(spark, sf_dir):
    from .profiles import typed_properties
    from .sources.text import turtle

    return typed_properties(turtle(spark, PROFILE).default_graph())


def registry_class_flags(spark, sf_dir):
    from .profiles import class_facts
    from .sources.text import turtle

    return class_facts(turtle(spark, PROFILE).default_graph())


def index_superclass_closure(spark, sf_dir):
    from .schema_index import SchemaIndex
    from .sources.text import turtle

    out = SchemaIndex.of({"http://onto/1/1.0": turtle(spark, PROFILE).default_graph()}).superclasses()
    return out.select(F.col("class").alias("c"), F.col("super").alias("d"))


def classify_customer_graphs(spark, sf_dir):
    """Market-segment graphs of customers classified against the profile."""
    from .schema_index import SchemaIndex, classify_graphs, sample_terms
    from .sources.text import turtle

    index = SchemaIndex.of({"http://onto/1/1.0": turtle(spark, PROFILE).default_graph()})
    return classify_graphs(sample_terms(_small(spark, sf_dir)), index)


def typed_instances(spark, sf_dir):
    """Balances stored as text get their datatype from the profile."""
    from .profiles import type_quads, typed_properties
    from .sources.text import turtle

    d = _mapped(spark, sf_dir, "customer").quads
    o = F.col("o")
    untyped = d.select("g", "s", "p", F.struct(o["k"].alias("k"), o["v"].alias("v"), F.when(o["k"] == 3, T.STRING).alias("dt"), o["lang"].alias("lang")).alias("o"))
    out = type_quads(untyped, typed_properties(turtle(spark, PROFILE).default_graph()))
    return out.groupBy("p", F.col("o.dt").alias("dt")).agg(F.count(F.lit(1)).alias("n"))


_TRIPLES = f"""
    SELECT {N} || n_nationkey AS s, 'http://example.org/tpch#n_name' AS p, 3 AS k, n_name AS v FROM nation
    UNION SELECT {N} || n_nationkey, 'http://example.org/tpch#region', 1, {R} || n_regionkey FROM nation
    UNION SELECT {R} || r_regionkey, 'http://example.org/tpch#r_name', 3, r_name FROM region JOIN nation ON n_regionkey = r_regionkey
    UNION SELECT {S} || s_suppkey, 'http://example.org/tpch#s_name', 3, s_name FROM supplier
    UNION SELECT {S} || s_suppkey, 'http://example.org/tpch#nation', 1, {N} || s_nationkey FROM supplier"""
_EDGES = f"WITH RECURSIVE e AS (SELECT p_partkey AS a, p_partkey // 2 AS b FROM part WHERE p_partkey > 0), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)"
_PRE = "'http://example.org/tpch#'"

FUNCTIONS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "construct_triples": (construct_triples, f"SELECT {N} || n_nationkey AS s, {_PRE} || 'in' AS p, 1 AS k, {R} || n_regionkey AS v FROM nation UNION SELECT {N} || n_nationkey, {_PRE} || 'label', 3, n_name FROM nation"),
    "describe_customer": (
        describe_customer,
        f"""SELECT {C} || 3 AS s, p, k, v FROM (SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' AS p, 1 AS k, {_PRE} || 'Customer' AS v UNION ALL SELECT {_PRE} || 'c_custkey', 3, '3'
            UNION ALL SELECT {_PRE} || 'c_name', 3, c_name FROM customer WHERE c_custkey = 3 UNION ALL SELECT {_PRE} || 'c_nationkey', 3, c_nationkey::VARCHAR FROM customer WHERE c_custkey = 3
            UNION ALL SELECT {_PRE} || 'c_acctbal', 3, c_acctbal::VARCHAR FROM customer WHERE c_custkey = 3 UNION ALL SELECT {_PRE} || 'c_mktsegment', 3, c_mktsegment FROM customer WHERE c_custkey = 3
            UNION ALL SELECT {_PRE} || 'customer.nation', 1, {N} || c_nationkey FROM customer WHERE c_custkey = 3)""",
    ),
    "graph_var_by_segment": (graph_var_by_segment, "SELECT 'http://g/' || c_mktsegment AS g, count(*) AS n FROM customer GROUP BY 1"),
    "graph_constant": (graph_constant, f"SELECT {C} || c_custkey AS c, {N} || c_nationkey AS n FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "from_graphs": (from_graphs, f"SELECT {C} || c_custkey AS c FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')"),
    "quads_join_default_named": (quads_join_default_named, f"SELECT {C} || c_custkey AS c, n_name AS nn FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'"),
    "path_negated": (path_negated, f"SELECT s, v AS o FROM ({_TRIPLES}) WHERE p IN ({_PRE} || 'region', {_PRE} || 'nation')"),
    "path_optional": (path_optional, f"SELECT {N} || 1 AS x UNION SELECT {R} || n_regionkey FROM nation WHERE n_nationkey = 1"),
    "path_plus": (path_plus, f"{_EDGES} SELECT {P} || a AS x, {P} || b AS y FROM r"),
    "path_star_from_constant": (path_star_from_constant, f"{_EDGES} SELECT {P} || b AS y FROM r WHERE a = 77 UNION SELECT {P} || 77"),
    "path_star_to_constant": (path_star_to_constant, f"{_EDGES} SELECT {P} || a AS x FROM r WHERE b = 5 UNION SELECT {P} || 5"),
    "path_range_1_3": (path_range_1_3, f"WITH e AS (SELECT p_partkey AS a, p_partkey // 2 AS b FROM part WHERE p_partkey > 0), t AS (SELECT e.a, f.b FROM e JOIN e f ON e.b = f.a), u AS (SELECT t.a, f.b FROM t JOIN e f ON t.b = f.a) SELECT {P} || a AS x, {P} || b AS y FROM (SELECT * FROM e UNION ALL SELECT * FROM t UNION ALL SELECT * FROM u)"),
    "union_distinct_default": (union_distinct_default, f"SELECT (SELECT count(*) FROM ({_TRIPLES})) + 2 * (SELECT count(*) FROM customer) AS n"),
    "insert_delete_data": (insert_delete_data, f"SELECT * FROM ({_TRIPLES}) WHERE NOT (s = {N} || 1 AND p = {_PRE} || 'region' AND v = {R} || 1) UNION SELECT 'http://x/1', {_PRE} || 'n_name', 3, 'NEW'"),
    "delete_where": (delete_where, f"SELECT * FROM ({_TRIPLES}) WHERE p <> {_PRE} || 's_name'"),
    "modify_rename": (modify_rename, f"SELECT * FROM ({_TRIPLES}) WHERE p <> {_PRE} || 'region' UNION SELECT {N} || n_nationkey, {_PRE} || 'inRegion', 3, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "copy_move_graph": (
        copy_move_graph,
        f"""WITH c AS (SELECT 'http://g/' || c_mktsegment AS g, count(*) AS n FROM customer GROUP BY 1), b AS (SELECT n FROM c WHERE g = 'http://g/BUILDING'),
            x AS (SELECT g, n + CASE WHEN g = 'http://g/AUTOMOBILE' THEN (SELECT n FROM b) ELSE 0 END AS n FROM c WHERE g NOT IN ('http://g/MACHINERY', 'http://g/FURNITURE') UNION ALL SELECT 'http://g/b2', n FROM b UNION ALL SELECT 'default', n FROM c WHERE g = 'http://g/MACHINERY')
            SELECT g, {_PRE} || p AS p, n FROM x, (VALUES ('c_name'), ('nation')) v(p)""",
    ),
}


_TP, _D = "'http://example.org/tpch#'", "'http://d/'"
_BASE = f"SELECT {N} || n_nationkey AS s, {_TP} || 'n_name' AS p, 3 AS k, n_name AS v FROM nation"
_ADD = f"SELECT {N} || n_nationkey || '-new' AS s, {_TP} || 'n_name' AS p, 3 AS k, n_name AS v FROM nation WHERE n_nationkey > 20 UNION ALL SELECT {N} || n_nationkey, {_TP} || 'n_name', 3, n_name FROM nation WHERE n_nationkey < 3"
FUNCTIONS |= {
    "delta_apply": (delta_apply, f"({_BASE} WHERE n_nationkey % 2 <> 0) UNION {_ADD.replace('UNION ALL', 'UNION')}"),
    "delta_missing_preconditions": (delta_missing_preconditions, f"SELECT * FROM ({_ADD}) EXCEPT SELECT * FROM ({_BASE})"),
    "disjoint_union_count": (disjoint_union_count, f"SELECT (SELECT count(*) FROM nation) + (SELECT count(*) FROM ({_ADD})) + (SELECT count(*) FROM nation WHERE n_nationkey % 2 = 0) AS n"),
    "uuid_normalise": (uuid_normalise, "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 OR c_custkey % 5 <> 0 THEN 'urn:uuid:' || regexp_replace(md5(c_name), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') END AS iri FROM customer"),
    "registry_typed_properties": (registry_typed_properties, f"""SELECT * FROM (VALUES ({_TP} || 'Customer', {_TP} || 'c_name', NULL, '{T.STRING}', NULL), ({_TP} || 'Customer', {_TP} || 'c_acctbal', {_D} || 'Money', '{T.FLOAT}', NULL), ({_D} || 'Money', {_D} || 'Money.value', NULL, '{T.FLOAT}', NULL),
        ({_TP} || 'Customer', {_TP} || 'customer.nation', NULL, NULL, {_TP} || 'Nation'), ({_TP} || 'Nation', {_TP} || 'n_name', NULL, '{T.STRING}', NULL)) v(rdf_type, property, cim_datatype, primitive_type, reference_type)"""),
    "registry_class_flags": (registry_class_flags, f"""SELECT * FROM (VALUES ({_TP} || 'Customer', {_TP} || 'Party', true, false, false, false, false), ({_TP} || 'Supplier', {_TP} || 'Party', false, false, false, false, false), ({_TP} || 'Party', {_TP} || 'Thing', false, false, false, false, false),
        ({_TP} || 'Thing', NULL, false, false, false, false, false), ({_TP} || 'Nation', NULL, true, true, false, false, false), ({_D} || 'String', NULL, false, false, false, false, true), ({_D} || 'Float', NULL, false, false, false, false, true), ({_D} || 'Money', NULL, false, false, false, true, false))
        v(class_uri, super_class, is_concrete, is_description, is_enum, is_cim_datatype, is_primitive)"""),
    "index_superclass_closure": (index_superclass_closure, f"WITH RECURSIVE e AS (SELECT * FROM (VALUES ({_TP} || 'Customer', {_TP} || 'Party'), ({_TP} || 'Supplier', {_TP} || 'Party'), ({_TP} || 'Party', {_TP} || 'Thing')) v(c, d)), r AS (SELECT * FROM e UNION SELECT r.c, e.d FROM r JOIN e ON r.d = e.c) SELECT * FROM r"),
    "classify_customer_graphs": (classify_customer_graphs, "SELECT DISTINCT 'http://g/' || c_mktsegment AS g, 'http://onto/1/1.0' AS profile, 1::BIGINT AS total, 1::BIGINT AS discriminating FROM customer"),
    "typed_instances": (typed_instances, f"SELECT p, dt, n FROM (SELECT count(*) AS n FROM customer), (VALUES ({_TP} || 'c_name', '{T.STRING}'), ({_TP} || 'c_acctbal', '{T.FLOAT}'), ({_TP} || 'c_mktsegment', '{T.STRING}'), ({_TP} || 'c_custkey', '{T.STRING}'), ({_TP} || 'c_nationkey', '{T.STRING}'), ({_TP} || 'customer.nation', NULL), ('{T.RDF_TYPE}', NULL)) v(p, dt)"),
    "shacl_summary": (shacl_summary, "SELECT count(*) FILTER (WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') OR c_acctbal < 0) = 0 AS conforms, count(*) FILTER (WHERE c_acctbal < 0) AS violations, count(*) FILTER (WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')) AS warnings, 0::BIGINT AS infos FROM customer"),
    **{name: (_shacl(tables, shape), sql) for name, (tables, shape, sql) in SHACL.items()},
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _sparql(text) for name, (text, _) in SPARQL.items()} | {name: f for name, (f, _) in FUNCTIONS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in (SPARQL | FUNCTIONS).items()}
