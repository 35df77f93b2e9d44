"""Command line: run a query over RDF files, or transcode them.

python -m tessera query [-f FORMAT] QUERY FILE...      (QUERY: text or @file; FORMAT: text, srj, srx, csv, tsv, html)
python -m tessera update UPDATE FILE...                (prints the new quads as N-Quads)
python -m tessera parse [-o FORMAT] FILE...            (FORMAT: ntriples, nquads, turtle, trig, rdfxml, canonical)
python -m tessera explain QUERY FILE...                (prints the algebra and the physical plan)
"""

from __future__ import annotations

import argparse
import sys
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tessera.operators.forms import parsed
from tessera.plans import unparse
from tessera.sources import results, writers
from tessera.sources.dataset import Dataset
from tessera.sources.readers import read


def main(argv: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="tessera", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=["query", "update", "parse", "explain"])
    parser.add_argument("-f", "--format", default="text")
    parser.add_argument("-o", "--output", default="nquads")
    parser.add_argument("arguments", nargs="+")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    text, files = ("", args.arguments) if args.command == "parse" else (args.arguments[0], args.arguments[1:])
    text = Path(text[1:]).read_text() if text.startswith("@") else text
    data = Dataset(spark, reduce(DataFrame.unionByName, [read(spark, f) for f in files])) if files else Dataset.of(spark, [])
    if args.command == "parse":
        print(writers.serialise(writers.driver_quads(data.quads), args.output), end="")
    elif args.command == "update":
        print(writers.serialise(writers.driver_quads(data.update(text).quads), "nquads"), end="")
    else:
        q = parsed(data, text)
        if args.command == "explain":
            print(unparse.query(q))
            (data.construct if q.form in ("CONSTRUCT", "DESCRIBE") else data.select)(q).explain("formatted")
        elif q.form == "ASK":
            print(results.write_boolean(data.ask(q), args.format), end="")
        elif q.form == "SELECT":
            from tessera.operators.forms import term_frame, terms

            print(results.write(term_frame(data, q).columns, terms(data, q), args.format), end="")
        else:
            print(writers.serialise(writers.driver_quads(data.construct(q)), "ntriples"), end="")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
