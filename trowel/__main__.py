"""python -m trowel FOLDER: surveys a source tree.

Exit codes: 0 done, with or without findings; 1 no modules; 2 bad paths.
"""

from __future__ import annotations

import argparse
import os
import sys


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="trowel", description="Survey a tree of Python source and its history.")
    parser.add_argument("path")
    parser.add_argument("--json", help="write all findings to this file")
    parser.add_argument("--tables", help="write all findings as Parquet below this folder")
    parser.add_argument("--html", help="write a map to this file")
    parser.add_argument("--mermaid", help="write a flowchart to this file")
    parser.add_argument("--drawio", help="write a draw.io file")
    parser.add_argument("--frontier", action="store_true", help="print every module's findings with text and line instead of the summary")
    parser.add_argument("--no-history", action="store_true", help="leave git alone")
    parser.add_argument("--max-files", type=int, default=5000)
    args = parser.parse_args(argv)

    from trowel.plans.survey import Survey
    from trowel.session import build_session
    from trowel.sinks import render
    from trowel.sources.tree import project_root

    if not os.path.exists(args.path):
        print(f"no such path: {args.path}", file=sys.stderr)
        return 2
    root = args.path if os.path.isdir(args.path) else project_root(args.path)
    outputs = {"json": args.json, "html": args.html, "mermaid": args.mermaid, "drawio": args.drawio}
    bad = render.unwritable(p for p in outputs.values() if p)
    if bad:
        print("cannot write " + ", ".join(bad), file=sys.stderr)
        return 2
    survey = Survey.of_tree(build_session(), root, not args.no_history, args.max_files)
    if not survey.listing.files:
        print("no Python modules", file=sys.stderr)
        return 1
    print(render.frontier_text(survey) if args.frontier else render.summary(survey))
    if args.json:
        render.write_json(survey, args.json)
    if args.tables:
        render.write_tables(survey, args.tables)
    for name, make in (("html", lambda s: render.html_map(s, os.path.basename(os.path.abspath(root)))), ("mermaid", render.mermaid), ("drawio", render.drawio)):
        if outputs[name]:
            with open(outputs[name], "w", encoding="utf-8") as f:
                f.write(make(survey))
    return 0


if __name__ == "__main__":
    sys.exit(main())
