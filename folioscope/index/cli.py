"""``python -m folioscope.index.cli COMMAND PATH``: look at and tend stored indexes.

Commands: ``versions``, ``sizes``, ``formats``, ``check``, ``migrate``, ``prune N``.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .maintain import Store, check


def main(arguments: list[str] | None = None) -> int:
    """Print one JSON line; 1 where a check finds problems."""
    parser = argparse.ArgumentParser(prog="folioscope-index", description=__doc__)
    parser.add_argument("command", choices=("versions", "sizes", "formats", "check", "migrate", "prune"))
    parser.add_argument("path")
    parser.add_argument("keep", nargs="?", type=int, default=1)
    asked = parser.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    store = Store(spark, asked.path, [])
    problems = 0
    if asked.command == "check":
        found = {r["problem"]: r["rows"] for r in check(store.open()).collect()}
        problems = int(bool(found))
        print(json.dumps(found))
    elif asked.command == "migrate":
        print(json.dumps(store.migrate()))
    elif asked.command == "prune":
        print(json.dumps(store.prune(asked.keep)))
    else:
        print(json.dumps({"versions": store.versions, "sizes": store.sizes, "formats": store.formats}[asked.command]()))
    return problems


if __name__ == "__main__":
    raise SystemExit(main())
