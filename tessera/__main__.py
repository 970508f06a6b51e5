"""Search a store from a shell: python -m tessera ROOT QUERY [TOP_K] [--mode text|semantic]
[--full-text PAPER_ID]. Results are one JSON object a line."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from tessera.operators.papers import as_json
from tessera.plans.engine import Engine, clamped


def answers(spark: SparkSession, arguments: list[str]) -> list[str]:
    """The lines that the arguments ask for; at most 100 hits, or the chunks of one paper."""
    parser = argparse.ArgumentParser(prog="tessera", description=__doc__)
    parser.add_argument("root")
    parser.add_argument("query", nargs="?", default="")
    parser.add_argument("top_k", nargs="?", default="5")
    parser.add_argument("--mode", choices=("text", "semantic"), default="text")
    parser.add_argument("--full-text", metavar="PAPER_ID")
    asked = parser.parse_args(arguments)
    engine = Engine(spark, asked.root)
    if asked.full_text is not None:
        rows = engine.full_text(asked.full_text).select("chunk_index", "section", "text")
    elif asked.mode == "text":
        rows = engine.search_text(asked.query, clamped(asked.top_k)).orderBy("position")
    else:
        return [json.dumps(r.asDict(), ensure_ascii=False) for r in engine.search(asked.query, clamped(asked.top_k))]
    return [r.value for r in as_json(rows).collect()]


def main() -> None:
    import sys

    print("\n".join(answers(SparkSession.builder.appName("tessera").getOrCreate(), sys.argv[1:])))


if __name__ == "__main__":
    main()
