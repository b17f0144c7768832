"""The engine end to end, on hand-written memories and a small repository."""

from __future__ import annotations

import pytest

from mnemospark.engine import MemoryEngine
from mnemospark.operators import chunking
from mnemospark.sources.files import ignore_pattern, read_files
from mnemospark.sources.journal import malformed, read_journal, read_questions

NOW = 1_735_603_200_000
ROWS = [
    ("semantic", "Retry declined cards twice", "We retry a declined card twice, instead of backing off.", "src/pay.py#L1-L3", 8.0),
    ("semantic", "Retry declined cards twice only", "Payments: retry limits.", "docs/pay.md#L1-L2", 6.0),
    ("episodic", "Outage in March", "The gateway was down; cards were declined.", "session:1", 5.0),
    ("procedural", "Rotate keys", "Rotate the signing keys monthly. token = 'abcdefgh1234'", "docs/ops.md#L4", 4.0),
]


@pytest.fixture
def engine(spark, tmp_path):
    e = MemoryEngine(spark, f"file://{tmp_path}/store", now=NOW)
    e.write(ROWS)
    return e


def ids(engine):
    return {r.title: r.id for r in engine.table("memory").collect()}


def test_write_redacts_and_refreshes(engine):
    assert engine.version == 1
    bodies = [r.body for r in engine.table("memory").collect()]
    assert any("[REDACTED:assigned-secret]" in b for b in bodies)
    engine.write(ROWS[:1])
    again = {r.title: r.access_count for r in engine.table("memory").collect()}
    assert len(again) == 4 and again["Retry declined cards twice"] == 1 and engine.version == 2
    with pytest.raises(ValueError):
        engine.write([("semantic", "x", "y", "", 1.0)])


def test_search_finds_at_once_and_says_why_not(engine):
    got = engine.search("retry declined card", max_distance=2.0).orderBy("position").collect()
    assert got[0].title.startswith("Retry declined cards twice") and set(got[0].ranks) >= {"bm25", "recency"}
    report = {r.branch: (r.n, r.reason) for r in engine.report("zebra").collect()}
    assert report["bm25"][0] == 0 and report["bm25"][1]


def test_pages_are_slices(engine):
    whole = [r.id for r in engine.search("card keys gateway", limit=10).orderBy("position").collect()]
    first = [r.id for r in engine.search("card keys gateway", limit=2).orderBy("position").collect()]
    assert whole[: len(first)] == first


def test_links_neighbours_and_conflicts(engine):
    by = ids(engine)
    a, b, c = by["Retry declined cards twice"], by["Outage in March"], by["Rotate keys"]
    engine.link(a, "RESOLVES", b)
    engine.link(b, "CONSTRAINS", c)
    engine.link(a, "RESOLVES", b)
    assert engine.table("edge").count() == 2
    assert {r.id: r.hops for r in engine.neighbors(a, 2).collect()} == {b: 1, c: 2}
    with pytest.raises(ValueError):
        engine.link(a, "RESOLVES", "nobody")
    with pytest.raises(ValueError):
        engine.link(a, "ABOUT", b)
    assert engine.version == 4  # refused writes change nothing
    declared, suspected = engine.conflicts()
    assert declared.count() == 0 and suspected.count() == 1
    graph = {r.id: r.ranks for r in engine.search("retry declined card").collect()}
    assert b in graph


def test_summary_prune_and_delete(engine):
    by = ids(engine)
    node = engine.summarize(list(by.values())[:2], "Cards", "What we know about cards.")
    assert engine.table("edge").where(f"src = '{node}'").count() == 2
    with pytest.raises(ValueError):
        engine.prune(0)
    left = MemoryEngine(engine.spark, engine.root, now=NOW + 40 * 86_400_000)
    gone = [r.id for r in left.prune(30).collect()]
    assert set(gone) <= {by["Outage in March"]}
    left.prune(30, dry_run=False)
    assert left.table("postings").join(left.table("memory"), "id", "left_anti").count() == 0


def test_journal_is_merged_once(engine, spark):
    rows = [("node", "episodic", "Queued", "A queued note.", "session:2", 2.0)]
    engine.queue(spark.createDataFrame(rows, "kind string, layer string, title string, body string, source_ref string, importance double"))
    engine.merge()
    engine.merge()
    assert engine.table("memory").where("title = 'Queued'").first().access_count in (0, None)


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"kind": "node", "title": "x"}\nnot json\n')
    assert read_journal(spark, str(tmp_path / "a.jsonl")).count() == 1 and malformed(spark, str(tmp_path / "a.jsonl")).count() == 1
    for text in ('[{"id": "1", "ask": "why?"}]', '{"questions": [{"id": "1", "ask": "why?"}]}'):
        (tmp_path / "q.json").write_text(text)
        assert read_questions(spark, str(tmp_path / "q.json")).first().ask == "why?"


@pytest.mark.parametrize("line, path, hit", [("*.tmp", "a/b.tmp", True), ("/docs", "x/docs/a", False), ("docs/**", "docs/a/b", True), ("a?c", "abc", True), ("build/", "build/x", True)])
def test_ignore_patterns(line, path, hit):
    import re

    assert bool(re.search(ignore_pattern(line)[0], path)) == hit


REPO = {
    "src/pay.py": "import util\n\nclass Payment:\n    def retry(self, card):\n        return helper(card)\n\ndef local():\n    p = Payment()\n    return p.retry(1)\n",
    "src/util.py": "def helper(card):\n    return card\n",
    "README.md": "# Title\n\n" + "Intro text. " * 120 + "\n## Part\n\n" + "More text. " * 30 + "\n",
    "image.png": "\0\0",
    "node_modules/x.js": "x",
    "notes.svg": "<svg/>",
    "package-lock.json": "{}",
    "blob.txt": "a\0b",
    ".hidden/x.md": "x",
    ".github/x.md": "Workflow notes",
    ".memignore": "*.skip\n",
    "a.skip": "x",
}


def test_ingest_is_incremental_and_resolves_calls(spark, tmp_path):
    root = tmp_path / "repo"
    for name, text in REPO.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    why = {r.path: r.reason for r in read_files(spark, str(root)).collect()}
    assert why["src/pay.py"] is None and why["README.md"] is None and why[".github/x.md"] is None
    assert why["image.png"] == "binary" and why["node_modules/x.js"] == "skipped folder" and why["notes.svg"] == "only when named"
    assert why["package-lock.json"] == "secret or bookkeeping" and why["blob.txt"] == "not text" and why[".hidden/x.md"] == "dot folder"
    assert why["a.skip"] == "ignored"
    engine = MemoryEngine(spark, f"file://{tmp_path}/store", now=NOW)
    report = engine.ingest(str(root))
    assert report["files"] >= 4 and report["symbols"] >= 4 and report["calls_resolved"] >= 2 and report["chunks"] > 3 and report["chunks_deleted"] == 0
    calls = {(r.src.rpartition(":")[2], r.name, r.confidence) for r in engine.table("calls").collect()}
    assert ("Payment.retry", "helper", "unique") in calls and ("local", "retry", "type") in calls
    assert {r.name for r in engine.table("symbol").collect()} >= {"Payment", "retry", "local", "helper"}
    before = engine.version
    assert engine.ingest(str(root))["files"] == 0 and engine.version == before
    (root / "src/util.py").unlink()
    engine.ingest(str(root))
    assert engine.table("symbol").where("name = 'helper'").count() == 0


def repo_of(root, files):
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return str(root)


def state(engine):
    """All rows but for times and counters."""
    out = {}
    for name in ("memory", "postings", "symbol", "about", "calls", "inherits", "imports", "pending", "file"):
        df = engine.table(name).drop("created_at", "last_seen_at", "access_count", "stamp")
        out[name] = sorted(map(str, df.collect()))
    return out


def test_removed_callee_reopens_its_calls_and_they_resolve_again(spark, tmp_path):
    root = tmp_path / "repo"
    repo_of(root, {"a.py": "def caller():\n    return helper(1)\n\ndef other():\n    return elsewhere()\n", "b.py": "def helper(x):\n    return x\n", "c.py": "import os\n"})
    engine = MemoryEngine(spark, f"file://{tmp_path}/store", now=NOW)
    engine.ingest(str(root))
    assert {(r.src, r.dst) for r in engine.table("calls").collect()} == {("Symbol:a.py:caller", "Symbol:b.py:helper")}
    assert {(r.name, r.reason) for r in engine.table("pending").collect()} == {("elsewhere", "external")}
    (root / "b.py").write_text("def renamed(x):\n    return x\n")
    engine.ingest(str(root))
    assert engine.table("calls").count() == 0
    assert {r.name for r in engine.table("pending").collect()} == {"elsewhere", "helper"}  # of files that weren't read again, too
    (root / "c.py").write_text("def helper(x):\n    return x\n\ndef elsewhere():\n    return 1\n")
    engine.ingest(str(root))
    assert {(r.src, r.dst) for r in engine.table("calls").collect()} == {("Symbol:a.py:caller", "Symbol:c.py:helper"), ("Symbol:a.py:other", "Symbol:c.py:elsewhere")}
    assert engine.table("pending").count() == 0
    assert engine.table("about").join(engine.table("symbol").withColumnRenamed("id", "symbol_id"), "symbol_id", "left_anti").count() == 0


def test_ingest_in_steps_equals_ingest_at_once(spark, tmp_path):
    files = {
        "pay.py": "import util\n\nclass Base:\n    def run(self):\n        return helper(1)\n\nclass Payment(Base):\n    def go(self):\n        return self.run()\n",
        "util.py": "def helper(x):\n    return x\n",
        "notes.md": "# Notes\n\n" + "Some words here. " * 80,
    }
    root = tmp_path / "repo"
    steps = MemoryEngine(spark, f"file://{tmp_path}/steps", now=NOW)
    for i in range(1, 4):
        repo_of(root, dict(list(files.items())[:i]))
        before = steps.version
        steps.ingest(str(root))
        assert steps.version == before + 1  # one write an ingest
    once = MemoryEngine(spark, f"file://{tmp_path}/once", now=NOW)
    once.ingest(str(root))
    assert state(steps) == state(once)
    assert {(r.src, r.dst) for r in once.table("inherits").collect()} == {("Symbol:pay.py:Payment", "Symbol:pay.py:Base")}
    once.ingest(str(root), force=True)
    assert state(once) == state(steps)


def test_a_named_file_is_read_whatever_the_policy(spark, tmp_path):
    root = tmp_path / "repo"
    repo_of(root, {"a.py": "def one():\n    return 1\n", "node_modules/x.py": "def two():\n    return one()\n", "x.bin": "a\0b"})
    engine = MemoryEngine(spark, f"file://{tmp_path}/store", now=NOW)
    engine.ingest(str(root))
    engine.ingest(str(root), named="node_modules/x.py")
    assert {r.name for r in engine.table("symbol").collect()} == {"one", "two"} and engine.table("calls").count() == 1
    assert engine.ingest(str(root), named="x.bin")["files"] == 0
    with pytest.raises(FileNotFoundError):
        engine.ingest(str(root), named="none.py")
    assert engine.size().first().bytes > 0 and {r.layer: r.n for r in engine.stats().collect()}["edges"] >= 3
    got = {r.file_path: r.covered for r in engine.coverage(["a.py", "zzz.py"]).collect()}
    assert got == {"a.py": True, "zzz.py": False}
    assert {r.name: r.status for r in engine.doctor().collect()}["keyword index"] == "ok"


def test_an_older_layout_is_migrated(engine, monkeypatch):
    import mnemospark.engine as module

    assert not engine.migrate()
    before = {(r.id, r.term) for r in engine.table("postings").collect()}
    monkeypatch.setattr(module, "LAYOUT", "3")
    assert engine.migrate() and not engine.migrate()
    assert {(r.id, r.term) for r in engine.table("postings").collect()} == before and engine.table("memory").count() == 4


def test_questions_put_in_two_ways(engine, spark):
    rows = [("1", "declined card", "retry card", ["src/pay.py"], ["docs/ops.md"]), ("2", "zebra", None, ["nowhere"], None)]
    questions = spark.createDataFrame(rows, "id string, ask string, also string, expect array<string>, reject array<string>")
    got = {r.configuration: (r.n, r.hits) for r in engine.evaluate(questions).collect()}
    assert got["all"] == (3, 2)
    lost = engine.missed(questions).collect()
    assert [(r.id, r.q) for r in lost] == [("2", "zebra")]


def test_versions_share_tables_and_the_second_writer_fails(engine):
    from py4j.protocol import Py4JJavaError

    by = ids(engine)
    a, b = list(by.values())[:2]
    before = engine._manifest()[1]
    engine.link(a, "RESOLVES", b)
    after = engine._manifest()[1]
    assert {k for k in after if before.get(k) != after[k]} == {"edge"}
    other = MemoryEngine(engine.spark, engine.root, now=NOW)
    with pytest.raises(Py4JJavaError), other.transaction():
        other.commit({"edge": other.table("edge")})
        engine.link(b, "CONSTRAINS", a)  # is first
    assert engine.table("edge").count() == 2
    with pytest.raises(ZeroDivisionError), engine.transaction():
        engine.write([("semantic", "x", "y", "z", 1.0)])
        assert engine.table("memory").count() == 5
        1 / 0  # noqa: B018
    assert engine.table("memory").count() == 4
    assert engine.vacuum(keep=1) > 0 and engine.search("declined card").count() > 0 and engine.vacuum(keep=1) == 0
    totals = engine.table("totals").first()
    postings = engine.table("postings")
    assert totals.doc_count == postings.select("id").distinct().count() and totals.total_length == sum(r.tf for r in postings.collect())


def test_chunks_cover_the_text():
    text = "\n".join(f"line {i} " + "x" * (i % 90) for i in range(400))
    covered = set()
    for p in chunking.windows(text):
        at = text.find(p.text)
        covered |= set(range(at, at + len(p.text)))
    assert all(i in covered or text[i] == "\n" for i in range(len(text)))
    md = chunking.markdown("# A\ntext\n```\n# no\n```\n## B\nmore\n# C\nend")
    assert [p.headings for p in md] == [["A"], ["A", "B"], ["C"]]


def test_other_languages_have_imports_and_containers():
    assert chunking.imports_of("a.ts", "import x from './b'\nconst y = require('c')\n") == [("./b", 1), ("c", 2)]
    assert chunking.imports_of("a.cs", "using A.B;\n") == [("A.B", 1)] and chunking.container_of("a.cs", "namespace A.B.C\n{}") == "A.B.C"
    found = chunking.declarations("x.rb", "class Order\n  def pay\n  end\nend\n")
    assert [(n, s, e) for n, _, s, e in found] == [("Order", 1, 4), ("pay", 2, 3)]
    vue = "<template/>\n<script>\nfunction go() {\n}\n</script>\n"
    assert [(n, s, e) for n, _, s, e in chunking.declarations("x.vue", vue)] == [("go", 3, 4)]


def test_braced_languages_have_declarations():
    found = chunking.declarations("x.ts", "export class Order {\n  get() {}\n}\nfunction pay(a) {\n  return a\n}\n")
    assert [(n, s, e) for n, _, s, e in found] == [("Order", 1, 3), ("pay", 4, 6), ("Order.get", 2, 2)]


TYPESCRIPT = """import { Base } from './base'
// helper(1) in a comment
export class Payment extends Base implements Payable, Logged {
  constructor(private store: Store) {}
  async retry(card: Card): Promise<void> {
    const p = new Payment("x()")
    if (card.valid()) { helper(card) }
    return p.settle(this.store)
  }
}
function helper(card: Card) {
  return card
}
"""
JAVA = """package shop.pay;
import shop.core.Ledger;
public class Order extends Base implements Payable {
    private Ledger ledger;
    public void pay(Card card) throws IOException {
        Ledger book = new Ledger();
        book.enter(card);
        audit();
    }
}
"""
GO = """package main
type Order struct {
	id int
}
func (o *Order) Pay(book Ledger) error {
	l := &Ledger{}
	l.Enter(o.id)
	return audit(book)
}
func audit(book Ledger) error {
	return nil
}
"""


def test_calls_and_heritage_of_languages_with_braces():
    def of(name, source):
        rows = chunking.relations(name, source)
        return {(n, r, t, c) for k, n, r, t, c, _ in rows if k == "call"}, {(n, r) for k, n, r, *_ in rows if k == "inherits"}

    calls, bases = of("a.ts", TYPESCRIPT)
    assert bases == {("Base", "Payment"), ("Payable", "Payment"), ("Logged", "Payment")}
    assert calls == {("Payment", None, None, True), ("valid", "card", "Card", False), ("helper", None, None, False), ("settle", "p", "Payment", False)}
    assert {n for n, *_ in chunking.declarations("a.ts", TYPESCRIPT)} == {"Payment", "helper", "Payment.retry"}
    calls, bases = of("Order.java", JAVA)
    assert bases == {("Base", "Order"), ("Payable", "Order")}
    assert calls == {("Ledger", None, None, True), ("enter", "book", "Ledger", False), ("audit", None, None, False)}
    assert {n for n, *_ in chunking.declarations("Order.java", JAVA)} == {"Order", "Order.pay"}
    calls, _ = of("main.go", GO)
    assert calls == {("Enter", "l", "Ledger", False), ("audit", None, None, False)}
    assert {n for n, *_ in chunking.declarations("main.go", GO)} == {"Order", "Order.Pay", "audit"}


def test_sessions_and_related(engine):
    node = engine.open_session("Work on cards")
    engine.write([("procedural", "Check limits", "Check retry limits first.", "docs/x.md#L1", 3.0)])
    engine.close_session("Done.")
    edges = engine.table("edge").where(f"dst = '{node}'").collect()
    assert {e.type for e in edges} == {"OCCURRED_IN", "DERIVED_FROM"}
    assert engine.related(ids(engine)["Check limits"]).count() <= 3
    assert engine.capabilities().where("status = 'ok'").count() > 3


def test_command_line(engine, spark, capsys):
    from mnemospark.__main__ import main

    assert main([engine.root, "search", "declined card"], spark) == 0
    assert "Retry declined cards" in capsys.readouterr().out
    assert main([engine.root, "get", "nobody"], spark) == 1
    assert main([engine.root, "link", "a", "NOTHING", "b"], spark) == 1
    assert main([engine.root, "fly"], spark) == 2
    assert main([engine.root, "doctor"], spark) == 0
    book = f"{engine.root.removeprefix('file://')}/registry.json"
    assert main([engine.root, "register", "one", "/nowhere", "--registry", book], spark) == 0
    assert main([engine.root, "list", "--registry", book], spark) == 0 and "/nowhere" in capsys.readouterr().out
    assert main([engine.root, "forget", "/elsewhere", "--registry", book], spark) == 1


def test_registry(spark, tmp_path):
    from mnemospark.sources.registry import Registry

    r = Registry(str(tmp_path / "r" / "registry.json"))
    r.register("one", str(tmp_path), "s")
    r.register("two", "/nowhere", "s")
    assert {x.name: x.state for x in r.listed(spark).collect()} == {"one": "unknown", "two": "unknown"}
    assert r.forget("/nowhere") and not r.forget("/nowhere") and len(r.entries()) == 1


def test_budget_cuts_the_longest_list():
    from mnemospark.functions.formatting import mermaid, within_bytes

    out = within_bytes({"a": list(range(100)), "b": [1]}, 120)
    assert out["omitted"]["a"] > 0 and out["b"] == [1]
    assert mermaid([("x[1]", "CALLS", "y")]).splitlines()[1] == '  n0["x1"] -->|CALLS| n1["y"]'
