"""The command line: a script from a file, from -c, or from standard input, over files of the current folder."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .engine import Engine
from .errors import ScriptError
from .plans.script import count
from .sources.readers import STANDARDS


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="marlstone", add_help=False, description=__doc__)
    flag = lambda *names, **more: p.add_argument(*names, action="store_true", **more)
    p.add_argument("script", nargs="?", help="a file with the script")
    p.add_argument("--help", action="help")
    flag("-A", "--api", help="step through rows as a library caller does")
    flag("-b", "--char-as-byte", help="string functions count bytes")
    p.add_argument("-c", "--command", help="the script itself; standard input is then the table __STDIN")
    flag("-C", "--cartesian", help="join by nested loops")
    flag("-d", "--dry-run", help="plan, but do not run")
    p.add_argument("-D", "--declare", action="append", default=[], metavar="NAME=VALUE", help="a variable")
    flag("-h", "--no-header", help="print no header")
    flag("-H", "--add-header", help="print a header where the layout has none")
    flag("-L", "--summarize", help="loose groups: show each group's first row")
    flag("-o", "--overwrite", help="INTO may replace files")
    flag("-O", "--override", help="go on after what is not supported")
    flag("-p", "--print", help="show plans")
    p.add_argument("-P", "--pipe-factor", type=int, default=4, help="no effect here")
    flag("-q", "--quiet", help="say nothing about rows written")
    p.add_argument("-s", "--in-delim", help="delimiter of input")
    p.add_argument("-S", "--out-delim", help="delimiter of output")
    p.add_argument("-R", "--rec-term", default="\n", help="end of output lines")
    flag("-t", "--thread", help="no effect here")
    flag("-v", "--verbose", help="say what is done")
    flag("-W", "--crlf", help="end output lines with CR LF")
    p.add_argument("--in-std", default="RFC4180", help="quoting of input: " + ", ".join(STANDARDS))
    p.add_argument("--out-std", default="RFC4180", help="quoting of output")
    flag("--parse-only", help="only parse")
    p.add_argument("--schema-path", help="where schema files are")
    p.add_argument("--schema", help="the schema of tables without one")
    flag("--stable", help="no effect here: order is kept")
    flag("--strict", help="exact file names, no doubled columns")
    flag("--debug", help="show errors in full")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=None, stdin=None) -> int:
    args = arguments().parse_args(argv)
    out = out or sys.stdout
    stdin = stdin or sys.stdin.buffer
    if args.command is not None:
        sql = args.command
    elif args.script:
        with open(args.script, encoding="utf-8") as f:
            sql = f.read()
    else:
        sql = stdin.read().decode()
    spark = spark or SparkSession.builder.appName("marlstone").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    unescape = lambda s: s.encode().decode("unicode_escape") if s else s
    try:
        engine = Engine(
            spark, ".", stdin, verbose=args.verbose, dry_run=args.dry_run, overwrite=args.overwrite, override_warnings=args.override, no_header=args.no_header,
            add_header=args.add_header, print_plan=args.print, in_delim=unescape(args.in_delim), out_delim=unescape(args.out_delim), record_terminator=unescape(args.rec_term),
            crlf_output=args.crlf, char_as_byte=args.char_as_byte, force_cartesian=args.cartesian, schema_path=args.schema_path, schema=args.schema, strict=args.strict,
            loose_groups=args.summarize, in_std=args.in_std, out_std=args.out_std, allow_stdin=args.command is not None or bool(args.script), parse_only=args.parse_only,
        )
        for declaration in args.declare:
            engine.import_variable(declaration)
        n = engine.prepare(sql)
        if args.verbose:
            print(f"{n} statements", file=sys.stderr)
        while got := engine.run(1):
            event = got[0]
            if event.kind == "select":
                if args.api:
                    for row in engine.rows():
                        out.write("\t".join("" if v is None else str(v) for v in row) + "\n")
                else:
                    for line in engine.text(event):
                        out.write(line)
            elif event.kind == "write" and not args.quiet:
                print(f"({event.rows} rows affected)", file=sys.stderr)
        engine.close()
        return 0
    except ScriptError as e:
        if args.debug:
            raise
        print(e, file=sys.stderr)
        return 1
    except Exception as e:  # a failure inside Spark
        if args.debug:
            raise
        print(str(e).strip().splitlines()[0], file=sys.stderr)
        return 1


__all__ = ["count", "main"]
