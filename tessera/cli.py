"""Command line: python -m tessera.cli TABLE VERB ..."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterator

from tessera.engine import Engine
from tessera.functions import sinks
from tessera.operators import build, lookups, publish
from tessera.operators.store import Store, find_tables, parse_ids
from tessera.schema import TesseraError

LOOKUPS = ("classes", "datatypes", "instances", "properties", "shapes", "snapshots")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera")
    p.add_argument("table")
    verbs = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, *names: str, **options):
        v = verbs.add_parser(name)
        for n in names:
            v.add_argument(n)
        for n, o in options.items():
            v.add_argument(f"--{n}", **o)

    verb("build", "source", base={"default": ""}, tag={"default": None})
    verb("query", "text", limit={"type": int, "default": 100}, sql={"action": "store_true"}, csv={"action": "store_true"})
    verb("get", "what")
    verb("describe", "subject", base={"default": ""})
    verb("stats")
    verb("properties")
    verb("diff", "snapshot")
    verb("export", "out")
    verb("geometries", bbox={"default": None}, limit={"type": int, "default": 1000}, offset={"type": int, "default": 0})
    verb("clean", ids={"nargs": "+", "required": True}, squash={"action": "store_true"})
    verb("translate", "text")
    verb("samples")
    verb("modules")
    verb("stale", "tag")
    verb("copy", "target")
    verb("tables")
    verb("wipe", yes={"action": "store_true"})
    verb("serve", port={"type": int, "default": 8080})
    return p


def lines(df) -> Iterator[str]:
    """A table's lines, joined by line ends."""
    for i, line in enumerate(sinks.table_lines(df)):
        yield "\n" * (i > 0) + line


def run(spark, argv: list[str]) -> str:
    """What a command prints, whole."""
    return "".join(answer(spark, argv))


def answer(spark, argv: list[str]) -> str | Iterator[str]:
    """What a command prints: a text, or the pieces of a result that may be large."""
    a = parser().parse_args(argv)
    store = Store(spark, a.table)
    if a.verb == "build":
        entry = build.build(spark, a.source, a.table, a.base, a.tag)
        return f"snapshot {entry['snapshot_id']}: {entry['added']} added, {entry['deleted']} deleted"
    if a.verb == "wipe":
        if not a.yes:
            raise TesseraError("wipe removes the whole table: say --yes")
        if not store.log():
            raise TesseraError(f"{a.table} is no table")
        store.wipe()
        return "gone"
    if a.verb == "clean":
        ids = parse_ids(a.ids)
        done = store.squash(ids) if a.squash else store.delete_snapshots(ids)
        return f"snapshot {done['snapshot_id']}" if done else "deleted"
    if a.verb == "tables":
        return "\n".join(find_tables(spark, a.table))
    if a.verb == "copy":
        return f"{publish.copy_table(spark, a.table, a.target)} files copied"
    if a.verb == "stale":
        return "stale" if store.is_stale(a.tag) else "up to date"
    if a.verb == "modules":
        return "\n".join(store.modules())
    engine = Engine(spark, a.table)
    if a.verb == "translate":
        return engine.translated(a.text)
    if a.verb == "samples":
        return "\n".join(f"{name}: {text}" for name, text in engine.sample_queries().items())
    if a.verb == "query":
        df = engine.sql(a.text) if a.sql else engine.sparql(a.text, a.limit)
        return sinks.csv_lines(df) if a.csv else lines(df)
    if a.verb == "get":
        if a.what not in LOOKUPS:
            raise TesseraError(f"get takes one of {', '.join(LOOKUPS)}")
        return lines(sinks.drop_empty_columns(getattr(engine, a.what)()))
    if a.verb == "describe":
        return lines(engine.describe(a.subject, a.base))
    if a.verb == "stats":
        return lines(lookups.counts(engine.triples))
    if a.verb == "properties":
        return lines(store.properties())
    if a.verb == "diff":
        return lines(engine.diff(a.snapshot).drop("object_geometry"))
    if a.verb == "geometries":
        return sinks.feature_collection(engine.geometries(a.bbox, a.limit, a.offset))
    if a.verb == "serve":
        from tessera.server import serve

        serve(engine, a.port)
    engine.export_ntriples(a.out)
    return a.out


def main() -> None:
    from pyspark.sql import SparkSession

    try:
        for piece in answer(SparkSession.builder.appName("tessera").getOrCreate(), sys.argv[1:]):
            sys.stdout.write(piece)
        print()
    except TesseraError as e:
        sys.exit(f"error: {e}")


if __name__ == "__main__":
    main()
