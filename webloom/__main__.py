"""validate, compile, extract and version from the command line; exit codes 0, 1 (found wrong), 2 (misused)."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from webloom.operators.runtime import extract_html
from webloom.plans.compiler import diagnose
from webloom.plans.diagnostics import ExecutionError
from webloom.plans.program import VERSION
from webloom.sources.charset import decode_page


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser("webloom", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("validate", "compile", "extract"):
        c = commands.add_parser(name)
        c.add_argument("program")
        c.add_argument("--output", "-o")
        if name == "extract":
            c.add_argument("--html", required=True)
            c.add_argument("--content-type")
    commands.add_parser("version")
    try:
        args = parser.parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    if args.command == "version":
        print(VERSION)
        return 0
    path = Path(args.program)
    try:
        program, found = diagnose(path.read_bytes(), path.name, lambda p: (path.parent / p).read_bytes())
    except OSError as e:
        print(e, file=sys.stderr)
        return 1
    for d in found:
        print(f"{d.span.file}:{d.span.start[1]}:{d.span.start[2]}: {d.severity}: {d.code}: {d.message}", file=sys.stderr)
    if program is None:
        return 1
    if args.command == "validate":
        return 0
    if args.command == "compile":
        out = program.ir_json()
    else:
        try:
            out = json.dumps(extract_html(program, decode_page(Path(args.html).read_bytes(), args.content_type)), ensure_ascii=False, indent=2)
        except (ExecutionError, OSError) as e:
            print(e, file=sys.stderr)
            return 1
    if args.output:
        Path(args.output).write_text(out + "\n")
    else:
        print(out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
