"""``python -m chronofold.tools``: the offline jobs."""

from __future__ import annotations

import argparse

from .functions.text import ALLOWED
from .plans import offline
from .session import local
from .sources import files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="chronofold.tools", description="Offline jobs on dimensions and results.")
    sub = p.add_subparsers(dest="job", required=True)
    merge = sub.add_parser("merge", help="merge result files; entities not collected yet go to a second file")
    merge.add_argument("results", nargs="+")
    merge.add_argument("-o", "--output", required=True)
    merge.add_argument("--collected", default="collected.jsonl")
    build = sub.add_parser("build-items", help="the items of all editions, the newest facts of each")
    build.add_argument("pattern", help="the editions' files, as */list.json")
    build.add_argument("-o", "--output", required=True)
    build.add_argument("--order", required=True, help="names of the editions' folders, oldest first, comma-separated")
    names = sub.add_parser("compare-names", help="names that only one of two files has")
    names.add_argument("left")
    names.add_argument("right")
    chars = sub.add_parser("characters", help="characters of a file's names, by category")
    chars.add_argument("entities")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = local()
    if a.job == "merge":
        stem = a.output.removesuffix(".json")
        offline.write_merged(spark, a.results, a.collected, a.output, f"{stem}_new.json")
    elif a.job == "build-items":
        files.write_json(files.items_json(offline.build_items(spark, a.pattern, a.order.split(","))), a.output)
    elif a.job == "compare-names":
        offline.compare_names(spark, a.left, a.right).orderBy("side", "name").show(1000, False)
    else:
        offline.character_report(files.read_entities(spark, a.entities), ALLOWED).orderBy("category", "char").show(10_000, False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
