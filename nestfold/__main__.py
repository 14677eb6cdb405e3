"""python -m nestfold FOLDER "SELECT ..." [--explain | --schema TABLE]: query the files of a folder."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from nestfold.session import Engine


def main() -> None:
    parser = argparse.ArgumentParser(prog="nestfold", description=__doc__)
    parser.add_argument("folder")
    parser.add_argument("statement", nargs="?")
    parser.add_argument("--explain", action="store_true")
    parser.add_argument("--schema")
    options = parser.parse_args()
    engine = Engine(SparkSession.builder.appName("nestfold").getOrCreate(), options.folder)
    if options.schema:
        print(engine.schema(options.schema))
    elif options.explain:
        print(engine.explain(options.statement))
    else:
        for row in engine.sql(options.statement).toJSON().toLocalIterator():
            print(row)


if __name__ == "__main__":
    main()
