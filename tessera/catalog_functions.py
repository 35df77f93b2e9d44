"""More SPARQL queries over the mapped tables with their DuckDB SQL: graphs, paths, functions, aggregates, lists and maps."""

from __future__ import annotations

from tessera.sources.mapped import NS

NATION, REGION = f"<{NS}graph/nation>", f"<{NS}graph/region>"
_X = "'http://example.org/"
_NATION_PO = f"""SELECT {_X}nation/' || n_nationkey AS x, unnest(['http://www.w3.org/1999/02/22-rdf-syntax-ns#type', {_X}n_nationkey', {_X}n_name', {_X}n_regionkey', {_X}region']) AS p,
  unnest([{_X}Nation', n_nationkey::VARCHAR, n_name, n_regionkey::VARCHAR, {_X}region/' || n_regionkey]) AS o FROM nation"""
_REGION_PO = f"""SELECT {_X}region/' || r_regionkey AS x, unnest(['http://www.w3.org/1999/02/22-rdf-syntax-ns#type', {_X}r_regionkey', {_X}r_name']) AS p,
  unnest([{_X}Region', r_regionkey::VARCHAR, r_name]) AS o FROM region"""

#: name: (SPARQL, DuckDB SQL, columns rounded to 2 places on the Spark side).
QUERIES: dict[str, tuple[str, str, tuple[str, ...]]] = {
    "graph_iri_free": (f"SELECT * WHERE {{ GRAPH {NATION} {{ ?x ?p ?o }} }}", _NATION_PO, ()),
    "graph_var_free": (
        f"SELECT ?g ?x ?p ?o FROM NAMED {NATION} FROM NAMED {REGION} WHERE {{ GRAPH ?g {{ ?x ?p ?o }} }}",
        f"SELECT {_X}graph/nation' AS g, * FROM ({_NATION_PO}) UNION ALL SELECT {_X}graph/region', * FROM ({_REGION_PO})",
        (),
    ),
    "graph_var_all": (
        "SELECT ?g (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?x a ?t } } GROUP BY ?g",
        " UNION ALL ".join(
            f"SELECT {_X}graph/{t}' AS g, count(*) AS n FROM {t}"
            for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
        ),
        (),
    ),
    "from_iri": (f"SELECT ?n FROM {NATION} WHERE {{ {{ ?x :n_name ?n }} UNION {{ ?x :r_name ?n }} }}", "SELECT n_name AS n FROM nation", ()),
    "from_two_free": (f"SELECT ?x ?p ?o FROM {NATION} FROM {REGION} WHERE {{ ?x ?p ?o }}", f"SELECT * FROM ({_NATION_PO}) UNION ALL SELECT * FROM ({_REGION_PO})", ()),
    "from_named": (
        f"SELECT ?g ?n FROM NAMED {REGION} WHERE {{ GRAPH ?g {{ {{ ?x :n_name ?n }} UNION {{ ?x :r_name ?n }} }} }}",
        f"SELECT {_X}graph/region' AS g, r_name AS n FROM region",
        (),
    ),
    "path_both_bound": (
        f"ASK {{ <{NS}customer/7> (:customer_nation|:region)+ ?r . ?r :r_regionkey ?k FILTER(?k < 5) . <{NS}nation/3> (:region/^:region)+ <{NS}nation/3> }}",
        "SELECT count(*) > 0 AS result FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey = 7",
        (),
    ),
    "path_nested_plus": (
        f"SELECT ?x WHERE {{ <{NS}nation/3> (:region/^:region)+ ?x }}",
        f"SELECT {_X}nation/' || n_nationkey AS x FROM nation WHERE n_regionkey = (SELECT n_regionkey FROM nation WHERE n_nationkey = 3)",
        (),
    ),
    "optional_filter_only": (
        "SELECT ?k ?j WHERE { ?r :r_regionkey ?k OPTIONAL { ?n :n_nationkey ?j FILTER(?j < ?k) } }",
        "SELECT r_regionkey::BIGINT AS k, n_nationkey::BIGINT AS j FROM region LEFT JOIN nation ON n_nationkey < r_regionkey",
        (),
    ),
    "fn_sha2": ("SELECT ?k (STRLEN(SHA384(?n)) AS ?a) (STRLEN(SHA512(?n)) AS ?b) WHERE { ?x :n_nationkey ?k ; :n_name ?n }", "SELECT n_nationkey::BIGINT AS k, 96::BIGINT AS a, 128::BIGINT AS b FROM nation", ()),
    "fn_lang": (
        'SELECT ?n (STRLANG(?n, "en-GB") AS ?s) (LANG(STRLANG(?n, "en-GB")) AS ?l) (LANGMATCHES(LANG(STRLANG(?n, "en-GB")), "en") AS ?m) (LANGMATCHES("fr", "en") AS ?f) (LANGMATCHES("fr", "*") AS ?any) WHERE { ?x :n_name ?n }',
        "SELECT n_name AS n, n_name AS s, 'en-GB' AS l, true AS m, false AS f, true AS \"any\" FROM nation",
        (),
    ),
    "fn_iri": ('SELECT ?n (IRI(CONCAT("http://x/", ?n)) AS ?i) (isIRI(URI(CONCAT("http://x/", ?n))) AS ?is) WHERE { ?x :n_name ?n }', "SELECT n_name AS n, 'http://x/' || n_name AS i, true AS \"is\" FROM nation", ()),
    "fn_time": ("SELECT ?k (xsd:integer(SECONDS(?d)) AS ?s) (STR(TIMEZONE(?d)) AS ?tz) WHERE { ?e :ts ?d ; :event_id ?k }", "SELECT event_id AS k, second(ts)::BIGINT AS s, 'PT0S' AS tz FROM events", ()),
    "fn_triple": (
        "SELECT ?k (SUBJECT(?t) AS ?s) (PREDICATE(?t) AS ?p) (OBJECT(?t) AS ?o) (isTRIPLE(?t) AS ?i) WHERE { ?x :n_name ?n ; :n_nationkey ?k BIND(TRIPLE(?x, :named, ?n) AS ?t) }",
        f"SELECT n_nationkey::BIGINT AS k, {_X}nation/' || n_nationkey AS s, {_X}named' AS p, n_name AS o, true AS i FROM nation",
        (),
    ),
    "fn_cast_more": (
        'SELECT ?k (xsd:double(xsd:decimal(?k)) AS ?d) (xsd:double(xsd:float(?k)) AS ?f) (YEAR(xsd:dateTime("2020-01-02T03:04:05Z")) AS ?t) (xsd:decimal("1.5") < xsd:decimal(?k) AS ?lt) WHERE { ?x :n_nationkey ?k }',
        "SELECT n_nationkey::BIGINT AS k, n_nationkey::DOUBLE AS d, n_nationkey::DOUBLE AS f, 2020 AS t, 1.5 < n_nationkey AS lt FROM nation",
        (),
    ),
    "fn_fresh": (
        "SELECT ?k (RAND() >= 0 && RAND() < 1 AS ?r) (isBlank(BNODE()) AS ?b) (STRLEN(STR(UUID())) AS ?u) (STRLEN(STRUUID()) AS ?su) (NOW() = NOW() AS ?now) WHERE { ?x :n_nationkey ?k }",
        "SELECT n_nationkey::BIGINT AS k, true AS r, true AS b, 45::BIGINT AS u, 36::BIGINT AS su, true AS now FROM nation",
        (),
    ),
    "agg_distinct_more": (
        'SELECT ?r (xsd:double(AVG(DISTINCT ?k)) AS ?a) (GROUP_CONCAT(DISTINCT ?s ; SEPARATOR="|") AS ?g) WHERE { ?n :n_nationkey ?k ; :n_regionkey ?r BIND(IF(?k > 12, "late", "early") AS ?s) } GROUP BY ?r',
        "SELECT n_regionkey::BIGINT AS r, avg(DISTINCT n_nationkey)::DOUBLE AS a, string_agg(DISTINCT s, '|' ORDER BY s) AS g FROM (SELECT *, CASE WHEN n_nationkey > 12 THEN 'late' ELSE 'early' END AS s FROM nation) GROUP BY n_regionkey",
        (),
    ),
    "fold_map": (
        "SELECT ?r (FOLD(?k, ?n) AS ?m) WHERE { ?x :n_nationkey ?k ; :n_regionkey ?r ; :n_name ?n } GROUP BY ?r",
        "SELECT n_regionkey::BIGINT AS r, '{' || string_agg(n_nationkey || ': \"' || n_name || '\"', ', ' ORDER BY n_nationkey) || '}' AS m FROM nation GROUP BY n_regionkey",
        (),
    ),
    "unfold_map": (
        'SELECT ?k ?key ?v WHERE { ?x :r_regionkey ?k BIND(cdt:Map("a", ?k, "b", 7) AS ?m) UNFOLD(?m AS ?key, ?v) }',
        "SELECT r_regionkey::BIGINT AS k, unnest(['a', 'b']) AS key, unnest([r_regionkey::VARCHAR, '7']) AS v FROM region",
        (),
    ),
    "cdt_lists": (
        'SELECT ?k (cdt:get(cdt:tail(?l), 1) AS ?a) (cdt:containsTerm(?l, ?k) AS ?b) (cdt:size(cdt:zip(?l, ?l)) AS ?c) (cdt:get(cdt:split("a,b,c", ","), 2) AS ?e) (cdt:listGet(?l, 3) AS ?f) WHERE { ?x :n_nationkey ?k BIND(cdt:sequence(?k, ?k + 3) AS ?l) }',
        "SELECT n_nationkey::BIGINT AS k, (n_nationkey + 1)::VARCHAR AS a, 'true' AS b, '4' AS c, 'b' AS e, (n_nationkey + 2)::VARCHAR AS f FROM nation",
        (),
    ),
    "cdt_maps": (
        'SELECT ?k (cdt:size(cdt:remove(?m, "a")) AS ?a) (cdt:size(cdt:keys(?m)) AS ?b) (cdt:mapGet(?m, "b") AS ?c) (cdt:size(cdt:merge(?m, cdt:Map("c", 1))) AS ?e) WHERE { ?x :n_nationkey ?k BIND(cdt:Map("a", ?k, "b", ?k + 1) AS ?m) }',
        "SELECT n_nationkey::BIGINT AS k, '1' AS a, '2' AS b, (n_nationkey + 1)::VARCHAR AS c, '3' AS e FROM nation",
        (),
    ),
    "cdt_compare": (
        'SELECT ?k (cdt:List(?k, 1) = cdt:List(?k, 1) AS ?eq) (cdt:List(?k) < cdt:List(?k, 1) AS ?lt) (cdt:Map("a", ?k) = cdt:Map("a", 3) AS ?me) WHERE { ?x :n_nationkey ?k }',
        "SELECT n_nationkey::BIGINT AS k, true AS eq, true AS lt, n_nationkey = 3 AS me FROM nation",
        (),
    ),
    "cdt_literal": (
        'SELECT ?k (cdt:get("[1, \'b\', 3]"^^cdt:List, 2) AS ?a) (cdt:get("{1: 2, \'three\': 4}"^^cdt:Map, "three") AS ?b) (cdt:size("[]"^^cdt:List) AS ?c) WHERE { ?x :r_regionkey ?k }',
        "SELECT r_regionkey::BIGINT AS k, 'b' AS a, '4' AS b, '0' AS c FROM region",
        (),
    ),
}
