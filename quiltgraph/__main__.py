"""python -m quiltgraph FOLDER -q QUERY [-j]: one query, or lines from a prompt, over the tables of a folder."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from quiltgraph.errors import QueryError
from quiltgraph.session import GraphSession
from quiltgraph.sources.tables import star_graph


def show(session: GraphSession, text: str, as_json: bool) -> None:
    df = session.query(text)
    if as_json:
        for line in df.toJSON().toLocalIterator():
            print(line)
    elif df.columns:
        df.show(1000, truncate=False)


def main() -> int:
    parser = argparse.ArgumentParser(prog="quiltgraph", description=__doc__)
    parser.add_argument("folder")
    parser.add_argument("-q", "--query")
    parser.add_argument("-j", "--json", action="store_true", help="a JSON object per row")
    args = parser.parse_args()
    spark = SparkSession.builder.appName("quiltgraph").getOrCreate()
    session = GraphSession(spark, star_graph(spark, args.folder))
    for text in [args.query] if args.query else iter(lambda: sys.stdin.readline(), ""):
        try:
            if text.strip():
                show(session, text, args.json)
        except QueryError as e:
            print(e, file=sys.stderr)
            if args.query:
                return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
