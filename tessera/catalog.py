"""SPARQL queries over the driver's tables (as mapped RDF), each with the DuckDB SQL it must equal.

Double sums and means are rounded on both sides, because the order of summation differs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import catalog_functions
from tessera import terms as R
from tessera.sources.dataset import Dataset
from tessera.sources.mapped import NS, tables

PREFIX = f"PREFIX : <{NS}>\nPREFIX xsd: <{R.XSD}>\nPREFIX cdt: <{R.CDT}>\nPREFIX rdf: <{R.RDF}>\n"

#: name: (SPARQL, DuckDB SQL, columns rounded to 2 places on the Spark side).
QUERIES: dict[str, tuple[str, str, tuple[str, ...]]] = {}


def add(name: str, sparql: str, sql: str, *rounded: str) -> None:
    QUERIES[name] = (sparql, sql, rounded)


add("bgp_star_group", """SELECT ?flag ?status (SUM(?qty) AS ?sum_qty) (COUNT(*) AS ?n) WHERE {
  ?l :l_returnflag ?flag ; :l_linestatus ?status ; :l_quantity ?qty ; :l_shipdate ?d .
  FILTER(?d <= "1998-09-02T00:00:00Z"^^xsd:dateTime) } GROUP BY ?flag ?status""",
    "SELECT l_returnflag AS flag, l_linestatus AS status, round(sum(l_quantity), 2) AS sum_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL", "sum_qty")
add("bgp_chain_join", """SELECT ?seg (SUM(?price * (1 - ?disc)) AS ?revenue) (COUNT(*) AS ?n) WHERE {
  ?c a :Customer ; :c_mktsegment ?seg . ?o :customer ?c ; :o_orderstatus ?st . ?l :order ?o ; :l_extendedprice ?price ; :l_discount ?disc . FILTER(?st = "F") } GROUP BY ?seg""",
    "SELECT c_mktsegment AS seg, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY ALL", "revenue")
add("filter_logic", """SELECT ?o ?p ?s WHERE { ?o :o_totalprice ?p ; :o_orderstatus ?s . FILTER((?p > 100000 && ?s IN ("O", "F")) || !(?p >= 2000)) }""",
    "SELECT 'http://example.org/orders/' || o_orderkey AS o, o_totalprice AS p, o_orderstatus AS s FROM orders WHERE (o_totalprice > 100000 AND o_orderstatus IN ('O', 'F')) OR NOT (o_totalprice >= 2000)")
add("optional_left", """SELECT ?c ?bal ?o WHERE { ?c :c_acctbal ?bal OPTIONAL { ?o :customer ?c ; :o_totalprice ?p FILTER(?p > 200000 && ?bal > 0) } }""",
    "SELECT 'http://example.org/customer/' || c_custkey AS c, c_acctbal AS bal, 'http://example.org/orders/' || o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000 AND c_acctbal > 0")
add("optional_unbound_join", """SELECT ?d ?q ?r WHERE { ?d :lang "de" OPTIONAL { ?l :labelled ?d ; :quality ?q } ?x :r_regionkey ?q ; :r_name ?r }""",
    "SELECT 'http://example.org/documents/' || d.doc_id AS d, r_regionkey::BIGINT AS q, r_name AS r FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id JOIN region ON l.quality IS NULL OR r_regionkey = l.quality WHERE lang = 'de'")
add("union_bag", """SELECT ?n ?m WHERE { { ?x :n_name ?n } UNION { ?y :r_name ?m } }""",
    "SELECT n_name AS n, NULL::VARCHAR AS m FROM nation UNION ALL SELECT NULL, r_name FROM region")
add("minus_anti", """SELECT ?c WHERE { ?c a :Customer MINUS { ?o :customer ?c ; :o_orderstatus "O" } }""",
    "SELECT 'http://example.org/customer/' || c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')")
add("exists_semi", """SELECT ?c ?n WHERE { ?c :c_name ?n FILTER EXISTS { ?o :customer ?c ; :o_totalprice ?p FILTER(?p > 300000) } }""",
    "SELECT 'http://example.org/customer/' || c_custkey AS c, c_name AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
add("not_exists_anti", """SELECT ?c ?bal WHERE { ?c :c_acctbal ?bal FILTER NOT EXISTS { ?o :customer ?c ; :o_totalprice ?p FILTER(?p > ?bal * 40) } }""",
    "SELECT 'http://example.org/customer/' || c_custkey AS c, c_acctbal AS bal FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 40)")
add("exists_in_expr", """SELECT ?c ?has WHERE { ?c a :Customer BIND(EXISTS { ?o :customer ?c } AS ?has) }""",
    "SELECT 'http://example.org/customer/' || c_custkey AS c, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has FROM customer")
add("values_inline", """SELECT ?n ?s ?k WHERE { VALUES (?s ?k) { ("O" "open") ("F" UNDEF) } ?o :o_orderstatus ?s ; :o_orderpriority ?n }""",
    "SELECT o_orderpriority AS n, o_orderstatus AS s, k FROM orders JOIN (VALUES ('O', 'open'), ('F', NULL)) v(s, k) ON o_orderstatus = s")
add("values_undef_join", """SELECT ?s ?n WHERE { VALUES (?s ?n) { ("O" UNDEF) (UNDEF "1-URGENT") } ?o :o_orderstatus ?s ; :o_orderpriority ?n }""",
    "SELECT o_orderstatus AS s, o_orderpriority AS n FROM orders JOIN (VALUES ('O', NULL), (NULL, '1-URGENT')) v(s, n) ON (v.s IS NULL OR v.s = o_orderstatus) AND (v.n IS NULL OR v.n = o_orderpriority)")
add("bind_arith", """SELECT ?k ?a ?b ?m WHERE { ?p :p_size ?k ; :p_retailprice ?r BIND(?k * 2 + 1 AS ?a) BIND(?r / 4 AS ?b) BIND(-?k AS ?m) }""",
    "SELECT p_size::BIGINT AS k, p_size::BIGINT * 2 + 1 AS a, p_retailprice / 4 AS b, -p_size::BIGINT AS m FROM part")
add("subselect_topk", """SELECT ?n ?b WHERE { { SELECT ?c ?b WHERE { ?c :c_acctbal ?b } ORDER BY DESC(?b) ?c LIMIT 10 } ?c :c_name ?n }""",
    "SELECT c_name AS n, c_acctbal AS b FROM customer ORDER BY c_acctbal DESC, 'http://example.org/customer/' || c_custkey LIMIT 10")
add("distinct", "SELECT DISTINCT ?p ?s WHERE { ?o :o_orderpriority ?p ; :o_orderstatus ?s }", "SELECT DISTINCT o_orderpriority AS p, o_orderstatus AS s FROM orders")
add("reduced", "SELECT REDUCED ?t WHERE { ?e :event_type ?t }", "SELECT DISTINCT event_type AS t FROM events")
add("order_slice", "SELECT ?k ?p WHERE { ?o :o_orderkey ?k ; :o_totalprice ?p } ORDER BY DESC(?p) ?k LIMIT 20 OFFSET 5", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY p DESC, k LIMIT 20 OFFSET 5")
add("agg_all", """SELECT ?s (COUNT(?p) AS ?n) (SUM(?p) AS ?total) (AVG(?p) AS ?mean) (MIN(?p) AS ?low) (MAX(?p) AS ?high) (SAMPLE(?s) AS ?any) WHERE { ?o :o_orderstatus ?s ; :o_totalprice ?p } GROUP BY ?s""",
    "SELECT o_orderstatus AS s, count(o_totalprice) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 2) AS mean, min(o_totalprice) AS low, max(o_totalprice) AS high, o_orderstatus AS \"any\" FROM orders GROUP BY o_orderstatus", "total", "mean")
add("agg_distinct", "SELECT (COUNT(DISTINCT ?p) AS ?n) (SUM(DISTINCT ?k) AS ?t) WHERE { ?x :p_brand ?p ; :p_size ?k }", "SELECT count(DISTINCT p_brand) AS n, sum(DISTINCT p_size)::BIGINT AS t FROM part")
add("agg_group_concat", """SELECT ?r (GROUP_CONCAT(?n ; SEPARATOR=", ") AS ?names) WHERE { ?x :n_name ?n ; :region ?y . ?y :r_name ?r } GROUP BY ?r""",
    "SELECT r_name AS r, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY r_name")
add("agg_having", "SELECT ?c (COUNT(*) AS ?n) WHERE { ?o :customer ?c } GROUP BY ?c HAVING(COUNT(*) > 15)", "SELECT 'http://example.org/customer/' || o_custkey AS c, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15")
add("agg_empty", """SELECT (COUNT(*) AS ?n) (SUM(?p) AS ?t) WHERE { ?o :o_totalprice ?p FILTER(?p < 0) }""", "SELECT count(*) AS n, coalesce(sum(o_totalprice), 0) AS t FROM orders WHERE o_totalprice < 0")
add("agg_empty_group", "SELECT ?s (COUNT(*) AS ?n) WHERE { ?o :o_totalprice ?p ; :o_orderstatus ?s FILTER(?p < 0) } GROUP BY ?s", "SELECT o_orderstatus AS s, count(*) AS n FROM orders WHERE o_totalprice < 0 GROUP BY s")
add("group_by_expr", "SELECT ?y (COUNT(*) AS ?n) WHERE { ?o :o_orderdate ?d } GROUP BY (YEAR(?d) AS ?y)", "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY y")
add("rank_ext", "SELECT ?s ?k (RANK(DESC(?p) ASC(?k)) AS ?r) WHERE { ?o :o_orderstatus ?s ; :o_orderkey ?k ; :o_totalprice ?p } GROUP BY ?s",
    "SELECT o_orderstatus AS s, o_orderkey AS k, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) - 1 AS r FROM orders")
add("fn_string", """SELECT ?n (STRLEN(?n) AS ?len) (UCASE(?n) AS ?up) (LCASE(?n) AS ?lo) (SUBSTR(?n, 2, 3) AS ?sub) (CONTAINS(?n, "A") AS ?has) (STRSTARTS(?n, "A") AS ?st) (STRENDS(?n, "A") AS ?en)
  (STRBEFORE(?n, "_") AS ?before) (STRAFTER(?n, "_") AS ?after) (CONCAT(?n, "-", ?n) AS ?cc) (ENCODE_FOR_URI(?n) AS ?uri) (REPLACE(?n, "[AEIOU]", "*") AS ?rep) WHERE { ?x :n_name ?n }""",
    """SELECT n_name AS n, length(n_name) AS len, upper(n_name) AS up, lower(n_name) AS lo, substr(n_name, 2, 3) AS sub, contains(n_name, 'A') AS has, starts_with(n_name, 'A') AS st, ends_with(n_name, 'A') AS en,
  CASE WHEN contains(n_name, '_') THEN split_part(n_name, '_', 1) ELSE '' END AS before, CASE WHEN contains(n_name, '_') THEN substr(n_name, instr(n_name, '_') + 1) ELSE '' END AS after, n_name || '-' || n_name AS cc, url_encode(n_name) AS uri, regexp_replace(n_name, '[AEIOU]', '*', 'g') AS rep FROM nation""")
add("fn_math", "SELECT ?b (ABS(?b) AS ?a) (CEIL(?b) AS ?c) (FLOOR(?b) AS ?f) (ROUND(?b) AS ?r) WHERE { ?x :c_acctbal ?b }", "SELECT c_acctbal AS b, abs(c_acctbal) AS a, ceil(c_acctbal) AS c, floor(c_acctbal) AS f, floor(c_acctbal + 0.5::DOUBLE) AS r FROM customer")
add("fn_date", "SELECT ?k (YEAR(?d) AS ?y) (MONTH(?d) AS ?m) (DAY(?d) AS ?dd) (HOURS(?d) AS ?h) (MINUTES(?d) AS ?mi) (TZ(?d) AS ?tz) WHERE { ?e :event_id ?k ; :ts ?d }", "SELECT event_id AS k, year(ts) AS y, month(ts) AS m, day(ts) AS dd, hour(ts) AS h, minute(ts) AS mi, 'Z' AS tz FROM events")
add("fn_hash", "SELECT ?n (MD5(?n) AS ?a) (SHA1(?n) AS ?b) (SHA256(?n) AS ?c) WHERE { ?x :n_name ?n }", "SELECT n_name AS n, md5(n_name) AS a, sha1(n_name) AS b, sha256(n_name) AS c FROM nation")
add("fn_cond", """SELECT ?k (IF(?p > 100000, "big", "small") AS ?size) (COALESCE(?nothing, ?s) AS ?first) (BOUND(?nothing) AS ?b) WHERE { ?o :o_orderkey ?k ; :o_totalprice ?p ; :o_orderstatus ?s }""",
    "SELECT o_orderkey AS k, CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS size, o_orderstatus AS first, false AS b FROM orders")
add("fn_regex", """SELECT ?n WHERE { ?x :c_name ?n FILTER(REGEX(?n, "^customer.*[05]$", "i")) }""", "SELECT c_name AS n FROM customer WHERE regexp_matches(c_name, '(?i)^customer.*[05]$')")
add("fn_cast", "SELECT ?k (xsd:string(?k) AS ?s) (xsd:integer(?p) AS ?i) (xsd:double(?k) AS ?d) (xsd:boolean(?k) AS ?b) WHERE { ?o :p_size ?k ; :p_retailprice ?p }", "SELECT p_size::BIGINT AS k, p_size::VARCHAR AS s, trunc(p_retailprice)::BIGINT AS i, p_size::DOUBLE AS d, p_size <> 0 AS b FROM part")
add("fn_term", """SELECT ?n (STR(?n) AS ?s) (isIRI(?n) AS ?i) (isLiteral(?k) AS ?l) (isNumeric(?k) AS ?num) (isBlank(?n) AS ?bl) (DATATYPE(?k) AS ?dt) (LANG(?m) AS ?lang) (sameTerm(?k, ?k) AS ?same) (STRDT(?m, xsd:token) AS ?sd) WHERE { ?n :n_nationkey ?k ; :n_name ?m }""",
    "SELECT 'http://example.org/nation/' || n_nationkey AS n, 'http://example.org/nation/' || n_nationkey AS s, true AS i, true AS l, true AS num, false AS bl, 'http://www.w3.org/2001/XMLSchema#integer' AS dt, '' AS lang, true AS same, n_name AS sd FROM nation")
add("path_seq", "SELECT ?c ?r WHERE { ?c :customer_nation/:region/:r_name ?r }", "SELECT 'http://example.org/customer/' || c_custkey AS c, r_name AS r FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
add("path_alt", "SELECT ?x ?n WHERE { ?x (:n_name|:r_name) ?n }", "SELECT 'http://example.org/nation/' || n_nationkey AS x, n_name AS n FROM nation UNION ALL SELECT 'http://example.org/region/' || r_regionkey, r_name FROM region")
add("path_inv", "SELECT ?r ?n WHERE { ?r ^:region ?n }", "SELECT 'http://example.org/region/' || n_regionkey AS r, 'http://example.org/nation/' || n_nationkey AS n FROM nation")
add("path_nps", "SELECT ?o WHERE { <http://example.org/nation/3> !(rdf:type|:n_name|^:customer_nation) ?o }", "SELECT unnest(['3', n_regionkey::VARCHAR, 'http://example.org/region/' || n_regionkey]) AS o FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'http://example.org/supplier/' || s_suppkey FROM supplier WHERE s_nationkey = 3")
add("path_opt", "SELECT DISTINCT ?x WHERE { <http://example.org/nation/3> :region? ?x }", "SELECT 'http://example.org/nation/3' AS x UNION SELECT 'http://example.org/region/' || n_regionkey FROM nation WHERE n_nationkey = 3")
add("path_plus", "SELECT ?a ?b WHERE { ?a (:customer_nation|:region|:customer)+ ?b }", """WITH step AS (SELECT 'http://example.org/customer/' || c_custkey AS a, 'http://example.org/nation/' || c_nationkey AS b FROM customer UNION SELECT 'http://example.org/nation/' || n_nationkey, 'http://example.org/region/' || n_regionkey FROM nation UNION SELECT 'http://example.org/orders/' || o_orderkey, 'http://example.org/customer/' || o_custkey FROM orders),
  two AS (SELECT s.a, t.b FROM step s JOIN step t ON s.b = t.a), three AS (SELECT s.a, t.b FROM two s JOIN step t ON s.b = t.a) SELECT * FROM step UNION SELECT * FROM two UNION SELECT * FROM three""")
add("path_star", "SELECT ?x WHERE { <http://example.org/customer/7> (:customer_nation|:region)* ?x }", "SELECT 'http://example.org/customer/7' AS x UNION SELECT 'http://example.org/nation/' || c_nationkey FROM customer WHERE c_custkey = 7 UNION SELECT 'http://example.org/region/' || n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey = 7")
add("path_star_object", "SELECT ?x WHERE { ?x (:region|:supplier_nation)* <http://example.org/region/1> }", "SELECT 'http://example.org/region/1' AS x UNION SELECT 'http://example.org/nation/' || n_nationkey FROM nation WHERE n_regionkey = 1 UNION SELECT 'http://example.org/supplier/' || s_suppkey FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 1")
add("graph_var", "SELECT ?g ?n WHERE { GRAPH ?g { { ?x :n_name ?n } UNION { ?x :r_name ?n } } }", "SELECT 'http://example.org/graph/nation' AS g, n_name AS n FROM nation UNION ALL SELECT 'http://example.org/graph/region', r_name FROM region")
add("graph_iri", "SELECT ?n WHERE { GRAPH <http://example.org/graph/nation> { ?x :n_name ?n } }", "SELECT n_name AS n FROM nation")
add("ask", "ASK { ?o :o_totalprice ?p FILTER(?p > 100000) }", "SELECT count(*) > 0 AS result FROM orders WHERE o_totalprice > 100000")
add("unbound_predicate", "SELECT ?p ?o WHERE { <http://example.org/region/2> ?p ?o }", "SELECT unnest(['http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'http://example.org/r_regionkey', 'http://example.org/r_name']) AS p, unnest(['http://example.org/Region', r_regionkey::VARCHAR, r_name]) AS o FROM region WHERE r_regionkey = 2")
add("order_mixed_kinds", "SELECT ?v WHERE { { ?x :n_nationkey ?v } UNION { ?x :r_name ?v } UNION { ?v a :Region } } ORDER BY ?v", "SELECT n_nationkey::VARCHAR AS v FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT 'http://example.org/region/' || r_regionkey FROM region")
add("mixed_compare", "SELECT ?v WHERE { { ?x :n_nationkey ?v } UNION { ?x :r_name ?v } FILTER(?v > 5 || ?v = \"ASIA\") }", "SELECT n_nationkey::VARCHAR AS v FROM nation WHERE n_nationkey > 5 UNION ALL SELECT r_name FROM region WHERE r_name = 'ASIA'")
add("mixed_sum", "SELECT (SUM(?v) AS ?s) (MAX(?v) AS ?m) WHERE { { ?x :n_nationkey ?v } UNION { ?x :p_retailprice ?v FILTER(?v < 0) } }", "SELECT sum(n_nationkey)::VARCHAR AS s, max(n_nationkey)::VARCHAR AS m FROM nation")
add("cdt_list", "SELECT ?k (cdt:size(?e) AS ?n) WHERE { ?v :vec_id ?k ; :embedding ?e }", "SELECT vec_id AS k, len(embedding)::VARCHAR AS n FROM embeddings")
add("cdt_map", """SELECT ?n (cdt:get(?m, "key") AS ?key) (cdt:size(cdt:put(?m, "z", 1)) AS ?size) (cdt:containsKey(?m, "name") AS ?has) WHERE { ?x :n_name ?n ; :n_nationkey ?k BIND(cdt:Map("name", ?n, "key", ?k) AS ?m) }""", "SELECT n_name AS n, n_nationkey::VARCHAR AS key, '3' AS size, 'true' AS has FROM nation")
add("cdt_functions", """SELECT ?k (cdt:head(?l) AS ?h) (cdt:get(cdt:reverse(?l), 1) AS ?last) (cdt:size(cdt:concat(?l, ?l)) AS ?two) (cdt:contains(?l, ?k) AS ?c) (cdt:get(cdt:subseq(?l, 2), 1) AS ?second) WHERE { ?x :n_nationkey ?k BIND(cdt:sequence(?k, ?k + 3) AS ?l) }""",
    "SELECT n_nationkey::BIGINT AS k, n_nationkey::VARCHAR AS h, (n_nationkey + 3)::VARCHAR AS last, '8' AS two, 'true' AS c, (n_nationkey + 1)::VARCHAR AS second FROM nation")
add("unfold", "SELECT ?k ?i ?x WHERE { ?v :n_nationkey ?k BIND(cdt:List(?k, \"a\", ?k + 1) AS ?l) UNFOLD(?l AS ?x, ?i) }", "SELECT n_nationkey::BIGINT AS k, unnest(['1', '2', '3']) AS i, unnest([n_nationkey::VARCHAR, 'a', (n_nationkey + 1)::VARCHAR]) AS x FROM nation")
add("fold", "SELECT ?r (FOLD(?k ORDER BY DESC(?k)) AS ?l) WHERE { ?n :n_nationkey ?k ; :n_regionkey ?r } GROUP BY ?r", "SELECT n_regionkey::BIGINT AS r, '[' || string_agg(n_nationkey::VARCHAR, ', ' ORDER BY n_nationkey DESC) || ']' AS l FROM nation GROUP BY n_regionkey")
add("star_expr", "SELECT ?n (OBJECT(?t) AS ?o) (isTRIPLE(?t) AS ?is) WHERE { ?x :n_name ?n BIND(<< ?x :named ?n >> AS ?t) }", "SELECT n_name AS n, n_name AS o, true AS \"is\" FROM nation")
add("hint", "SELECT ?n WHERE { { ?x :r_name ?n HINT broadcast } }", "SELECT r_name AS n FROM region")
add("select_star", "SELECT * WHERE { ?x :r_name ?n ; :r_regionkey ?k }", "SELECT 'http://example.org/region/' || r_regionkey AS x, r_name AS n, r_regionkey::BIGINT AS k FROM region")
QUERIES.update(catalog_functions.QUERIES)
add("service_local", f"SELECT ?c ?r WHERE {{ ?c :customer_nation ?n SERVICE <{NS}endpoint> {{ ?n :region/:r_name ?r }} }}", "SELECT 'http://example.org/customer/' || c_custkey AS c, r_name AS r FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")


def dataset(spark: SparkSession, folder: str) -> Dataset:
    data = Dataset(spark, mapping=tables(spark, folder), star=False)
    return Dataset(spark, mapping=data.mapping, star=False, endpoints={f"{NS}endpoint": data})


def run(name: str) -> Callable[[SparkSession, str], DataFrame]:
    sparql, _, rounded = QUERIES[name]

    def query(spark: SparkSession, folder: str) -> DataFrame:
        df = dataset(spark, folder).select(PREFIX + sparql)
        return df.withColumns({c: F.round(c, 2) for c in rounded}) if rounded else df

    return query


def nation_graph(spark: SparkSession, folder: str) -> DataFrame:
    """The nation and region tables as materialised quads."""
    data = dataset(spark, folder)
    from tessera.sources.dataset import table_quads

    keep = [t for t in data.mapping.tables if t.name in ("nation", "region")]
    return table_quads(keep[0], data.mapping).unionByName(table_quads(keep[1], data.mapping))


def construct_nt(spark: SparkSession, folder: str) -> DataFrame:
    """CONSTRUCT as N-Triples text."""
    g = dataset(spark, folder).construct(PREFIX + "CONSTRUCT { ?r :member ?n } WHERE { ?x :region ?r ; :n_name ?n }")
    return g.select(R.nt_column(F.col("s")).alias("s"), F.col("p"), R.nt_column(F.col("o")).alias("o"))


def describe_nt(spark: SparkSession, folder: str) -> DataFrame:
    """DESCRIBE over materialised quads."""
    g = Dataset(spark, nation_graph(spark, folder)).construct(PREFIX + "DESCRIBE ?r WHERE { ?r a :Region }")
    return g.select(R.nt_column(F.col("s")).alias("s"), F.col("p"), R.nt_column(F.col("o")).alias("o"))


def update_delete_insert(spark: SparkSession, folder: str) -> DataFrame:
    """Updates over materialised quads, then a SELECT."""
    data = Dataset(spark, nation_graph(spark, folder), star=False)
    data = data.update(PREFIX + "DELETE { ?n :n_name ?m } INSERT { ?n :label ?u . GRAPH :names { ?n :label ?m } } WHERE { ?n :n_name ?m BIND(LCASE(?m) AS ?u) FILTER(STRSTARTS(?m, \"A\") || CONTAINS(?m, \"1\")) } ; COPY :names TO :copy")
    return data.select(PREFIX + "SELECT ?g ?n ?v WHERE { { GRAPH ?g { ?n :label ?v } } UNION { ?n :label ?v } UNION { ?n :n_name ?v } }")


def quads_bgp(spark: SparkSession, folder: str) -> DataFrame:
    """A join of quad scans."""
    return Dataset(spark, nation_graph(spark, folder), star=False).select(PREFIX + "SELECT ?n ?r WHERE { ?x :n_name ?n ; :region ?y . ?y :r_name ?r }")


def ntriples_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Quads written as N-Triples lines and parsed again."""
    from tessera.sources.readers import lines
    from tessera.sources.writers import ntriples_lines

    back = lines(ntriples_lines(nation_graph(spark, folder)), F.lit(""))
    return back.select(R.nt_column(F.col("s")).alias("s"), "p", R.nt_column(F.col("o")).alias("o"))


_NATION_NT = """SELECT * FROM (
  SELECT '<http://example.org/nation/' || n_nationkey || '>' AS s, unnest(['http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'http://example.org/n_nationkey', 'http://example.org/n_name', 'http://example.org/n_regionkey', 'http://example.org/region']) AS p,
    unnest(['<http://example.org/Nation>', '"' || n_nationkey || '"^^<http://www.w3.org/2001/XMLSchema#integer>', '"' || n_name || '"', '"' || n_regionkey || '"^^<http://www.w3.org/2001/XMLSchema#integer>', '<http://example.org/region/' || n_regionkey || '>']) AS o FROM nation
  UNION ALL SELECT '<http://example.org/region/' || r_regionkey || '>', unnest(['http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'http://example.org/r_regionkey', 'http://example.org/r_name']),
    unnest(['<http://example.org/Region>', '"' || r_regionkey || '"^^<http://www.w3.org/2001/XMLSchema#integer>', '"' || r_name || '"']) FROM region)"""

FUNCTIONS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "construct_nt": (construct_nt, "SELECT '<http://example.org/region/' || n_regionkey || '>' AS s, 'http://example.org/member' AS p, '\"' || n_name || '\"' AS o FROM nation"),
    "describe_nt": (describe_nt, f"SELECT * FROM ({_NATION_NT}) WHERE s LIKE '%/region/%'"),
    "quads_bgp": (quads_bgp, "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON r_regionkey = n_regionkey"),
    "update_delete_insert": (update_delete_insert, """WITH hit AS (SELECT *, 'http://example.org/nation/' || n_nationkey AS n FROM nation WHERE starts_with(n_name, 'A') OR contains(n_name, '1'))
  SELECT g, n, n_name AS v FROM hit, (VALUES ('http://example.org/names'), ('http://example.org/copy')) x(g) UNION ALL SELECT NULL, n, lower(n_name) FROM hit
  UNION ALL SELECT NULL, 'http://example.org/nation/' || n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT n_nationkey FROM hit)"""),
    "ntriples_roundtrip": (ntriples_roundtrip, _NATION_NT),
}


def functions() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]]:
    from tessera.catalog_data import FUNCTIONS as more

    return {**FUNCTIONS, **more}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**{n: run(n) for n in QUERIES}, **{n: f for n, (f, _) in functions().items()}}


def oracles() -> dict[str, str]:
    return {**{n: sql for n, (_, sql, _) in QUERIES.items()}, **{n: sql for n, (_, sql) in functions().items()}}
