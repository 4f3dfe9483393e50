"""Console: ``python -m lorekeep.serve.cli [--db PATH] [--script FILE | --lines | --tcp PORT]``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from ..session import Session
from .lines import LineServer, serve_tcp
from .render import block, store_dump

HELP = ":help  :store  :clear  :flush  :quit"


def run_text(session: Session, text: str, sink=sys.stdout) -> bool:
    try:
        for r in session.run(text):
            print(block(r), file=sink)
        return True
    except ValueError as e:
        print(e, file=sink)
        return False


def run_script(session: Session, path: str, sink=sys.stdout) -> bool:
    """A program file, read by Spark, so that it may lie in any store."""
    text = session.spark.read.text(path, wholetext=True).first()
    return run_text(session, text["value"] if text else "", sink)


def command(session: Session, text: str, sink=sys.stdout) -> Session | None:
    """The session that goes on, or None at the end."""
    word = text.strip().lower()
    if word in (":quit", ":exit"):
        return None
    if word == ":clear":
        return Session(session.spark)
    if word == ":store":
        print(store_dump(session), file=sink)
    elif word == ":flush":
        sink.flush()  # a plan is on disk once it has run
    else:
        print(HELP, file=sink)
    return session


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lorekeep")
    p.add_argument("--db")
    p.add_argument("--script")
    p.add_argument("--lines", action="store_true", help="one program a line on standard input")
    p.add_argument("--tcp", type=int, metavar="PORT", help="the same over TCP")
    p.add_argument("--host", default="127.0.0.1")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("lorekeep").getOrCreate()
    session = Session(spark, a.db)
    if a.lines:
        LineServer(session).serve(sys.stdin, sys.stdout)
        return 0
    if a.tcp:
        serve_tcp(session, a.host, a.tcp).serve_forever()
    if a.script:
        return int(not run_script(session, a.script))
    for text in sys.stdin:
        if text.lstrip().startswith(":"):
            if (session := command(session, text)) is None:
                break
        elif text.strip():
            run_text(session, text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
