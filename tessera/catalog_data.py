"""Registered jobs on materialised graphs: formats, updates, collections, quoted triples, extensions, user frames and streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import terms as R
from tessera.catalog import _NATION_NT, PREFIX, dataset, nation_graph
from tessera.functions.registry import Registry
from tessera.shared import checkpoint_dir
from tessera.sources import readers, results, writers
from tessera.sources.dataset import Dataset
from tessera.sources.mapped import NS

Job = Callable[[SparkSession, str], DataFrame]
_X = "'http://example.org/"


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{checkpoint_dir(spark)}/tessera-{uuid.uuid4().hex}"


def shown(quads: DataFrame, *more: str) -> DataFrame:
    """Quads as text."""
    return quads.select(R.nt_column(F.col("s")).alias("s"), "p", R.nt_column(F.col("o")).alias("o"), *more)


def written_and_read(form: str) -> Job:
    """A small graph as one document of a format, written, read and parsed by Spark."""

    def job(spark: SparkSession, folder: str) -> DataFrame:
        text = writers.serialise(writers.driver_quads(nation_graph(spark, folder)), form, {"": NS})
        path = scratch(spark)
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
        return shown(readers.read(spark, path, form, NS))

    return job


def nquads_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """N-Quads files written and read in parallel."""
    path = scratch(spark)
    writers.write(nation_graph(spark, folder).withColumn("g", F.when(F.col("p").endswith("name"), F.lit(NS + "names"))), path)
    return shown(readers.read(spark, path, "nquads"), "g")


def canonical_form(spark: SparkSession, folder: str) -> DataFrame:
    """The canonical document's lines of a graph whose blank nodes are told apart by what they say."""
    triples = dataset(spark, folder).construct(PREFIX + "CONSTRUCT { _:n :name ?r } WHERE { ?x :r_name ?r }")
    lines = writers.serialise(writers.driver_quads(triples), "canonical").splitlines()
    return spark.createDataFrame([(x,) for x in lines], "line string").select(F.regexp_replace("line", "^_:\\S+", "_:b").alias("line"))


def results_as(form: str) -> Job:
    """Solutions as a result document, parsed again."""

    def job(spark: SparkSession, folder: str) -> DataFrame:
        rows = dataset(spark, folder).terms(PREFIX + "SELECT ?x ?n ?k WHERE { ?x :r_name ?n ; :r_regionkey ?k }")
        _, back = results.parse(results.write(["x", "n", "k"], rows, form), form)
        return spark.createDataFrame([tuple(r[v].value for v in ("x", "n", "k")) for r in back], "x string, n string, k string")

    return job


def result_lines(make: Callable[[DataFrame], DataFrame]) -> Job:
    def job(spark: SparkSession, folder: str) -> DataFrame:
        from tessera.operators.forms import term_frame

        return make(term_frame(dataset(spark, folder), PREFIX + "SELECT ?x ?n WHERE { ?x :r_name ?n }"))

    return job


def after(update: str, query: str) -> Job:
    """A query after updates of the nation and region graph."""

    def job(spark: SparkSession, folder: str) -> DataFrame:
        return Dataset(spark, nation_graph(spark, folder)).update(PREFIX + update).select(PREFIX + query)

    return job


def load(spark: SparkSession, folder: str) -> DataFrame:
    """Files loaded into a graph by LOAD."""
    path = scratch(spark)
    writers.write(nation_graph(spark, folder).drop("g"), path + ".nt")
    url = path + ".nt" if "://" in path else f"file://{path}.nt"
    data = Dataset.of(spark, []).update(f"LOAD <{url}> INTO GRAPH <{NS}loaded> ; LOAD SILENT <file:///nowhere.nt>")
    return data.select(PREFIX + "SELECT ?n WHERE { GRAPH :loaded { ?x :n_name ?n } }")


def collections(spark: SparkSession, folder: str) -> Dataset:
    """An RDF collection of its nations' names, in order of their keys, under each region."""
    n = spark.read.parquet(f"{folder}/nation.parquet").select("n_regionkey", "n_nationkey", "n_name")
    last = n.groupBy(F.col("n_regionkey").alias("r")).agg(F.sort_array(F.collect_list("n_nationkey")).alias("ks"))
    cells = n.join(last, F.col("r") == F.col("n_regionkey")).withColumn("next", F.get("ks", F.array_position("ks", F.col("n_nationkey")).cast("int")))
    cell = lambda k: R.struct(R.BLANK, F.concat(F.lit("c"), k.cast("string")))
    nil = R.struct(R.IRI_, F.lit(R.RDF + "nil"))
    quads = [
        cells.select(cell(F.col("n_nationkey")).alias("s"), F.lit(R.RDF + "first").alias("p"), R.struct(R.LITERAL, F.col("n_name"), F.lit(R.STRING)).alias("o")),
        cells.select(cell(F.col("n_nationkey")).alias("s"), F.lit(R.RDF + "rest").alias("p"), F.when(F.col("next").isNull(), nil).otherwise(cell(F.col("next"))).alias("o")),
        last.select(R.struct(R.IRI_, F.concat(F.lit(NS + "region/"), F.col("r").cast("string"))).alias("s"), F.lit(NS + "nations").alias("p"), cell(F.get("ks", 0)).alias("o")),
    ]
    return Dataset.of_graphs(spark, {None: quads[0].unionByName(quads[1]).unionByName(quads[2])})


def list_members(spark: SparkSession, folder: str) -> DataFrame:
    """Each member of each collection with its place."""
    data = collections(spark, folder)
    heads = data.match(p=R.Iri(NS + "nations")).select(F.col("s")["v"].alias("x"), F.col("o").alias("list"))
    return data.list_cells().join(heads, "list").select("x", F.col("place").alias("i"), F.col("member")["v"].alias("n"))


def list_from_head(spark: SparkSession, folder: str) -> DataFrame:
    """Each collection as a list literal."""
    data = collections(spark, folder)
    heads = data.match(p=R.Iri(NS + "nations")).select(F.col("s")["v"].alias("x"), F.col("o").alias("list"))
    return data.list_literals().join(heads, "list").select("x", F.col("literal")["v"].alias("l"))


def graph_access(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of a graph's nodes, of matches and whether some exist."""
    data = Dataset(spark, nation_graph(spark, folder))
    kind = R.Iri(R.RDF + "type")
    row = (data.graph_nodes().count(), data.count(None, kind), data.count(None, kind, R.Iri(NS + "Region")), data.holds(R.Iri(NS + "region/1")), data.holds(R.Iri(NS + "region/99")))
    return spark.createDataFrame([row], "nodes long, typed long, regions long, has boolean, hasnt boolean")


def blank_labels_in_lists(spark: SparkSession, folder: str) -> DataFrame:
    """A blank node named in a list literal of a file is the one its triples describe."""
    path = scratch(spark)
    names = [r.r_name for r in dataset(spark, folder).select(PREFIX + "SELECT ?r_name WHERE { ?x :r_name ?r_name }").collect()]
    text = "".join(f'_:b{i} <{NS}name> "{n}" .\n' for i, n in enumerate(names)) + f'<{NS}s> <{NS}all> "[{", ".join(f"_:b{i}" for i in range(len(names)))}]"^^<{R.CDT}List> .\n'
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    data = Dataset(spark, readers.read(spark, path, "ntriples"))
    return data.select(PREFIX + "SELECT ?n WHERE { ?s :all ?l UNFOLD(?l AS ?b) ?b :name ?n }")


def extensions(spark: SparkSession, folder: str) -> DataFrame:
    """A function, a form, an aggregate and a datatype of the user's own."""
    text = lambda c: R.struct(R.LITERAL, c, F.lit(R.STRING))
    own = Registry(
        functions={NS + "twice": lambda t: text(F.concat(t["v"], t["v"]))},
        forms={NS + "known": lambda t: text(F.when(t.isNull(), "no").otherwise("yes"))},
        aggregates={NS + "longest": lambda t: F.max_by(t, F.length(t["v"]) * 1000 - F.ascii(F.substring(t["v"], -1, 1)))},
    )
    data = Dataset(spark, nation_graph(spark, folder), registry=own)
    return data.select(PREFIX + "SELECT (COUNT(*) AS ?n) (MAX(:twice(?name)) AS ?t) (MIN(:known(?nothing)) AS ?k) (STRLEN(STR(:longest(?name))) AS ?l) WHERE { ?x :n_name ?name }")


def user_frame(spark: SparkSession, folder: str) -> DataFrame:
    """A frame of the user's own as a source of solutions, joined with a pattern."""
    own = spark.read.parquet(f"{folder}/nation.parquet").where("n_nationkey < 7").select(F.col("n_name").alias("n"), (F.col("n_nationkey") * 10).alias("ten"))
    data = Dataset(spark, mapping=dataset(spark, folder).mapping, star=False, endpoints={NS + "mine": own})
    return data.select(PREFIX + "SELECT ?k ?n ?ten WHERE { SERVICE :mine {} ?x :n_name ?n ; :n_nationkey ?k }")


def stream_of_triples(spark: SparkSession, folder: str) -> DataFrame:
    """N-Triples files as a stream, its quads appended to a table."""
    from tessera.streaming import quad_stream

    path = scratch(spark)
    writers.write(nation_graph(spark, folder).drop("g"), path + "-in")
    run = quad_stream(spark, path + "-in").writeStream.format("parquet").option("checkpointLocation", path + "-log").trigger(availableNow=True).start(path + "-out")
    run.awaitTermination()
    return shown(spark.read.parquet(path + "-out"))


_REGIONS = f"SELECT {_X}region/' || r_regionkey AS x, r_name AS n, r_regionkey::VARCHAR AS k FROM region"
_NAMES = "SELECT n_name AS n FROM nation"
_GRAPHS = "SELECT ?g ?n WHERE { { GRAPH ?g { ?x :n_name ?n } } UNION { ?x :n_name ?n } }"

FUNCTIONS: dict[str, tuple[Job, str]] = {
    "turtle_roundtrip": (written_and_read("turtle"), _NATION_NT),
    "trig_roundtrip": (written_and_read("trig"), _NATION_NT),
    "rdfxml_roundtrip": (written_and_read("rdfxml"), _NATION_NT),
    "nquads_roundtrip": (nquads_roundtrip, f"SELECT *, CASE WHEN ends_with(p, 'name') THEN {_X}names' END AS g FROM ({_NATION_NT})"),
    "canonical_form": (canonical_form, f"SELECT '_:b <http://example.org/name> \"' || r_name || '\" .' AS line FROM region"),
    "results_json": (results_as("srj"), _REGIONS),
    "results_xml": (results_as("srx"), _REGIONS),
    "results_csv": (results_as("csv"), _REGIONS),
    "results_tsv": (results_as("tsv"), _REGIONS),
    "result_tsv_lines": (result_lines(results.tsv_lines), "SELECT '<http://example.org/region/' || r_regionkey || '>' || chr(9) || '\"' || r_name || '\"' AS value FROM region"),
    "result_json_lines": (
        result_lines(results.json_lines),
        """SELECT '{"x":{"type":"uri","value":"http://example.org/region/' || r_regionkey || '"},"n":{"type":"literal","value":"' || r_name || '"}}' AS value FROM region""",
    ),
    "update_insert_delete_data": (
        after('INSERT DATA { :new :n_name "NEW" . GRAPH :g { :new :n_name "NAMED" } } ; DELETE DATA { <http://example.org/nation/3> :n_name "NATION_3" }', _GRAPHS),
        f"SELECT NULL::VARCHAR AS g, n_name AS n FROM nation WHERE NOT (n_nationkey = 3 AND n_name = 'NATION_3') UNION ALL SELECT NULL, 'NEW' UNION ALL SELECT {_X}g', 'NAMED'",
    ),
    "update_delete_where": (after("DELETE WHERE { ?x :n_regionkey 1 ; :n_name ?n }", "SELECT ?n WHERE { ?x :n_name ?n }"), "SELECT n_name AS n FROM nation WHERE n_regionkey <> 1"),
    "update_clear_drop": (
        after("ADD DEFAULT TO :g ; ADD DEFAULT TO :h ; CLEAR DEFAULT ; DROP GRAPH :h ; CREATE GRAPH :e", _GRAPHS),
        f"SELECT {_X}g' AS g, n_name AS n FROM nation",
    ),
    "update_add_move": (after("ADD DEFAULT TO :g ; MOVE :g TO :h", _GRAPHS), f"SELECT NULL::VARCHAR AS g, n_name AS n FROM nation UNION ALL SELECT {_X}h', n_name FROM nation"),
    "update_with_using": (
        after("COPY DEFAULT TO :g ; WITH :g DELETE { ?x :n_name ?n } INSERT { ?x :n_name ?u } WHERE { ?x :n_name ?n BIND(LCASE(?n) AS ?u) }", _GRAPHS),
        f"SELECT NULL::VARCHAR AS g, n_name AS n FROM nation UNION ALL SELECT {_X}g', lower(n_name) FROM nation",
    ),
    "update_load": (load, _NAMES),
    "quoted_triples": (
        after("INSERT { << ?x :n_name ?n >> :since ?k } WHERE { ?x :n_name ?n ; :n_nationkey ?k }", "SELECT ?x ?n ?k WHERE { << ?x :n_name ?n >> :since ?k }"),
        f"SELECT {_X}nation/' || n_nationkey AS x, n_name AS n, n_nationkey::VARCHAR AS k FROM nation",
    ),
    "list_members": (list_members, f"SELECT {_X}region/' || n_regionkey AS x, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i, n_name AS n FROM nation"),
    "list_from_head": (list_from_head, f"SELECT {_X}region/' || n_regionkey AS x, '[' || string_agg('\"' || n_name || '\"', ', ' ORDER BY n_nationkey) || ']' AS l FROM nation GROUP BY n_regionkey"),
    "graph_access": (
        graph_access,
        "SELECT (SELECT count(*) FROM (SELECT n_name FROM nation UNION SELECT r_name FROM region)) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) + 2 "
        "+ (SELECT count(*) FROM (SELECT n_nationkey FROM nation UNION SELECT n_regionkey FROM nation UNION SELECT r_regionkey FROM region)) AS nodes, "
        "(SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS typed, (SELECT count(*) FROM region) AS regions, true AS has, false AS hasnt",
    ),
    "blank_labels_in_lists": (blank_labels_in_lists, "SELECT r_name AS n FROM region"),
    "extensions": (extensions, "SELECT count(*) AS n, max(n_name || n_name) AS t, 'no' AS k, max(length(n_name)) AS l FROM nation"),
    "user_frame": (user_frame, "SELECT n_nationkey::BIGINT AS k, n_name AS n, n_nationkey::BIGINT * 10 AS ten FROM nation WHERE n_nationkey < 7"),
    "stream_of_triples": (stream_of_triples, _NATION_NT),
}
