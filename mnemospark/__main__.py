"""Command line: ``python -m mnemospark STORE COMMAND ...``.

Exit codes: 0 done; 1 an error, a failed check or nothing found; 2 no such command.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.engine import MemoryEngine
from mnemospark.functions.formatting import mermaid, tree, within_bytes
from mnemospark.sources.files import git_changes
from mnemospark.sources.journal import read_questions
from mnemospark.sources.registry import Registry

OUTPUT_BYTES = 24_000


def rows(df: DataFrame, most: int = 200) -> list[dict]:
    """The first rows, as JSON has them; commands print pages, not tables."""
    return [json.loads(r) for r in df.limit(most).toJSON().collect()]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="mnemospark")
    p.add_argument("store")
    c = p.add_subparsers(dest="command", required=True)

    def add(name: str, *words: str, **flags) -> None:
        one = c.add_parser(name)
        for w in words:
            one.add_argument(w)
        for flag, kind in flags.items():
            key = f"--{flag.replace('_', '-')}"
            one.add_argument(key, action="store_true") if kind is bool else one.add_argument(key, type=kind)

    add("search", "query", limit=int, offset=int, layer=str)
    add("index", "query")
    add("why", "target", limit=int, anchor_only=bool)
    add("get", "id")
    add("graph", "id", depth=int, direction=str, mermaid=bool)
    add("related", "id")
    for name in ("constraints", "conflicts", "clusters", "doctor", "capabilities", "merge", "init", "stats", "size", "migrate"):
        add(name)
    add("vacuum", keep=int)
    add("imports", prefix=str)
    add("register", "name", "path", registry=str, commit=str)
    add("list", registry=str)
    add("forget", "path", registry=str)
    add("session", "title", summary=str)
    add("coverage", "root", mode=str, base=str)
    add("map", prefix=str, text=bool)
    add("changes", "root", mode=str, base=str)
    add("write", "layer", "title", "body", "source_ref", importance=float)
    add("link", "src", "type", "dst")
    add("summarize", "title", "body", members=str)
    add("ingest", "folder", force=bool, named=str)
    add("embed", force=bool)
    add("prune", days=float, apply=bool)
    add("eval", "questions")
    return p


def run(engine: MemoryEngine, a: argparse.Namespace) -> dict | str:
    if a.command == "search":
        o = {"limit": a.limit or 10, "offset": a.offset or 0, "layers": (a.layer,) if a.layer else ()}
        found = engine.search(a.query, **o).orderBy("position")
        return {"results": rows(found), "branches": rows(engine.report(a.query, **o))}
    if a.command == "index":
        return {"results": rows(engine.index(a.query).orderBy("position"))}
    if a.command == "why":
        return {"results": rows(engine.why(a.target, a.anchor_only, limit=a.limit or 10).orderBy("position"))}
    if a.command == "get":
        node, edges = engine.get(a.id)
        found = rows(node)
        if not found:
            raise LookupError(f"no node {a.id}")
        return {"node": found[0], "edges": rows(edges)}
    if a.command == "graph" and a.mermaid:
        edges = engine.table("edge").where((F.col("src") == a.id) | (F.col("dst") == a.id)).select("src", "type", "dst").limit(200)
        return mermaid([tuple(r) for r in edges.collect()])
    if a.command in ("register", "list", "forget"):
        known = Registry(a.registry or f"{Path.home()}/.mnemospark/registry.json")
        if a.command == "register":
            known.register(a.name, a.path, engine.root, a.commit or "")
        elif a.command == "forget" and not known.forget(a.path):
            raise LookupError(f"no project at {a.path}")
        return {"projects": rows(known.listed(engine.spark))}
    if a.command == "session":
        node = engine.open_session(a.title)
        engine.close_session(a.summary or "")
        return {"session": node}
    if a.command == "coverage":
        return {"coverage": rows(engine.coverage(git_changes(a.root, a.mode or "working", a.base or "")))}
    if a.command == "imports":
        return {"imports": rows(engine.imports(a.prefix or ""))}
    if a.command == "vacuum":
        return {"folders": engine.vacuum(a.keep or 2)}
    if a.command == "migrate":
        return {"migrated": engine.migrate()}
    if a.command == "graph":
        return {"neighbors": rows(engine.neighbors(a.id, a.depth or 2, direction=a.direction or "both").orderBy("hops", "id"))}
    if a.command == "conflicts":
        declared, suspected = engine.conflicts()
        return {"declared": rows(declared), "suspected": rows(suspected)}
    if a.command == "map":
        found = rows(engine.map(a.prefix or ""), 5_000)
        return tree(found) if a.text else {"symbols": found}
    if a.command == "changes":
        return {"changes": rows(engine.changes(git_changes(a.root, a.mode or "working", a.base or "")))}
    if a.command == "write":
        return {"written": rows(engine.write([(a.layer, a.title, a.body, a.source_ref, a.importance or 5.0)]))}
    if a.command == "link":
        engine.link(a.src, a.type, a.dst)
        return {"linked": [a.src, a.type, a.dst]}
    if a.command == "summarize":
        return {"id": engine.summarize((a.members or "").split(","), a.title, a.body)}
    if a.command == "ingest":
        return {k: rows(v) if isinstance(v, DataFrame) else v for k, v in engine.ingest(a.folder, a.force, a.named).items()}
    if a.command == "embed":
        return {"embedded": engine.embed(a.force)}
    if a.command == "prune":
        return {"pruned": rows(engine.prune(a.days or 0, dry_run=not a.apply))}
    if a.command == "eval":
        asked = read_questions(engine.spark, a.questions)
        return {"configurations": rows(engine.evaluate(asked)), "missed": rows(engine.missed(asked))}
    if a.command == "init":
        return {"version": engine.init()}
    if a.command == "merge":
        engine.merge()
        return {"version": engine.version}
    if a.command == "related":
        return {"related": rows(engine.related(a.id))}
    return {a.command: rows(getattr(engine, a.command)())}


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        a = parser().parse_args(arguments)
    except SystemExit as e:
        return int(e.code or 0)
    spark = spark or SparkSession.builder.appName("mnemospark").getOrCreate()
    try:
        out = run(MemoryEngine(spark, a.store), a)
    except (ValueError, LookupError, OSError) as e:
        print(e, file=sys.stderr)
        return 1
    print(out if isinstance(out, str) else json.dumps(within_bytes(out, OUTPUT_BYTES), ensure_ascii=False))
    checks = out.get("doctor", []) if isinstance(out, dict) else []
    return int(any(c["status"] == "fail" for c in checks))


if __name__ == "__main__":
    sys.exit(main())
