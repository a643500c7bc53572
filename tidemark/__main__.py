"""Command line: ``python -m tidemark [--lang en|id] count FILE`` and ``... grep [-n] [-c] PATTERN FILE``.

Exit codes: 0 done or found, 1 nothing found, 2 wrong use, no file or a binary one. ``grep`` looks for the pattern as it is,
with case; ``-n`` puts the line number before each line, ``-c`` prints the number of lines only.
"""

from __future__ import annotations

import os
import sys

# The labels of the report in both languages.
LABELS = {"en": ("File", "Lines", "Size", "bytes"), "id": ("File", "Baris", "Ukuran", "byte")}
USAGE = "usage: tidemark [--lang en|id] count FILE | grep [-n] [-c] PATTERN FILE"


def main(args: list[str], spark=None, out=None) -> int:
    """Run one command and return its exit code."""
    out = out or sys.stdout
    say = lambda x: print(x, file=out)
    lang = "en"
    while args[:1] == ["--lang"] and len(args) > 1:
        lang, args = args[1] if args[1] in LABELS else "en", args[2:]
    if not args or args[0] not in ("count", "grep"):
        say(USAGE)
        return 2
    flags, rest = set(), []
    for i, a in enumerate(args[1:]):
        if args[0] == "grep" and not rest and a in ("-n", "-c", "-nc", "-cn"):
            flags |= set(a[1:])
        elif a != "--" or i:
            rest.append(a)
    if len(rest) != (1 if args[0] == "count" else 2):
        say(USAGE)
        return 2
    path = rest[-1]
    if not os.path.isfile(path):
        say(f"not a file: {path!r}")
        return 2

    from pyspark.sql import functions as F

    from .functions.scalars import size_of_bytes
    from .operators.search import grep_lines
    from .runtime import session
    from .sources.lines import open_log

    spark = spark or session("tidemark", "local[*]", spark__ui__showConsoleProgress="false", spark__log__level="ERROR")
    size = os.path.getsize(path)
    try:
        lines = open_log(spark, os.path.abspath(path)) if size else None
    except ValueError as e:
        say(str(e))
        return 2
    if args[0] == "count":
        n = lines.count() if lines is not None else 0
        file, rows, bulk, unit = LABELS[lang]
        for x in (f"{file}: {path}", f"{rows}: {n}", f"{bulk}: {size_of_bytes(size)} ({size} {unit})"):
            say(x)
        return 0
    found = grep_lines(lines, rest[0]) if lines is not None and rest[0] else None
    if "c" in flags:
        n = found.count() if found is not None else 0
        say(str(n))
        return 0 if n else 1
    some = False
    # an iterator, one partition at a time: the result is printed, not held
    for r in found.orderBy("line").select(F.col("line"), "text").toLocalIterator() if found is not None else ():
        some = True
        say(f"{r['line']}:{r['text']}" if "n" in flags else r["text"])
    return 0 if some else 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
