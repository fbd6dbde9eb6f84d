"""python -m symgraph PATH [--repository NAME] [--out FOLDER] [--call TOOL NAME=VALUE ...]: indexes a folder, prints its
counts, stores the index, and answers a tool call from it; PATH may also be a stored index (--stored)."""

from __future__ import annotations

import argparse
import json
import sys
import time


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="python -m symgraph", description=__doc__)
    p.add_argument("path")
    p.add_argument("--repository", default="repo")
    p.add_argument("--out", help="folder that the index is written to")
    p.add_argument("--stored", action="store_true", help="path is a stored index")
    p.add_argument("--call", nargs="+", metavar=("TOOL", "NAME=VALUE"), help="a tool and its arguments")
    a = p.parse_args(argv)
    from pyspark.errors import AnalysisException

    from symgraph.plans.service import Index, Tools
    from symgraph.session import build

    spark, began = build(), time.time()
    try:
        index = Index.load(spark, a.path) if a.stored else Index.of_path(spark, a.path, a.repository)
    except AnalysisException as e:
        print(f"not found: {a.path} ({e.getCondition()})", file=sys.stderr)
        return 1
    for row in index.counts().orderBy("repository").collect():
        print(json.dumps(row.asDict() | {"seconds": round(time.time() - began, 2)}))
    if a.out:
        index.save(a.out)
    if a.call:
        answer = Tools(spark, index).handle({"id": 1, "method": "tools/call", "params": {"name": a.call[0], "arguments": dict(x.split("=", 1) for x in a.call[1:])}})
        print(answer["result"]["content"][0]["text"] if "result" in answer else json.dumps(answer["error"]))
        return int("error" in answer)
    return 0


if __name__ == "__main__":
    sys.exit(main())
