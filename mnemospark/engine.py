"""The engine: memory tables in versioned snapshots, and every operation on them.

A version is a manifest that names the folder of each table.  A write puts the
changed tables into new folders, then creates the next manifest, which names the
folders of all others as before.  Manifests are written once and never touched
again: a failed write leaves the current version as it was, readers keep what
they opened, and of two writers that began from one version the second fails.
Everything inside a ``transaction`` is one such write.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemospark.functions import scalars as sc
from mnemospark.functions.embedding import HashEmbedder, Provider, embed_column
from mnemospark.functions.redaction import redact
from mnemospark.operators import chunking, code, evaluation, graph, index, mutations, retrieval
from mnemospark.operators.retrieval import Options, Tables
from mnemospark.sources.files import folder_bytes, read_files, read_named, skip_report
from mnemospark.sources.journal import append_journal, read_journal
from mnemospark.storage import delete, stored
from mnemospark.streaming.journal import drain

_SITE = "src string, file_path string, name string, receiver string, receiver_type string, construction boolean, line long"

TABLES = {
    "memory": "id string, layer string, title string, body string, source_ref string, file_path string, importance double, "
    "confidence double, created_at long, last_seen_at long, access_count long, superseded_at long",
    "vector": "id string, embedding array<float>, model string, dims long, provider string",
    "postings": "id string, term string, tf long, doc_len long",
    "totals": "doc_count long, total_length long, average double",
    "edge": "src string, type string, dst string, weight double, created_at long, evidence_ref string",
    "symbol": "id string, name string, file_path string, kind string, start_line long, end_line long",
    "about": "memory_id string, symbol_id string",
    "calls": f"{_SITE}, dst string, confidence string",
    "inherits": "src string, dst string, confidence string",
    "imports": "src_path string, dst_path string, module string",
    "pending": f"{_SITE}, reason string",
    "file": "path string, stamp string, container string",
}

#: Layout of the tables; a store of another one is migrated.
LAYOUT = "2"


class MemoryEngine:
    """All operations of the engine on one store folder."""

    def __init__(self, spark: SparkSession, root: str, embedder: Provider | None = None, now: int | None = None):
        self.spark, self.root, self.embedder, self._now = spark, root.rstrip("/"), embedder or HashEmbedder(), now
        self.session: str | None = None
        self._open: tuple[int, dict[str, str], dict[str, DataFrame]] | None = None

    # ------------------------------------------------------------ snapshots

    @property
    def now(self) -> int:
        return self._now if self._now is not None else int(time.time() * 1000)

    def _path(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _manifest(self) -> tuple[int, dict[str, str]]:
        """(write counter, folder of each table) of the current version."""
        p, fs = self._path(f"{self.root}/versions")
        names = sorted((x.getPath().getName() for x in fs.listStatus(p)), reverse=True) if fs.exists(p) else []
        for name in names:  # a manifest that its writer didn't finish doesn't count
            if name.isdigit():
                text = self._text(f"{self.root}/versions/{name}")
                if text.endswith("}\n"):
                    return int(name), json.loads(text)
        return 0, {}

    def _text(self, path: str) -> str:
        p, fs = self._path(path)
        source = fs.open(p)
        try:
            return bytes(source.readAllBytes()).decode()
        finally:
            source.close()

    @property
    def version(self) -> int:
        """The write counter: 0 before the first write."""
        return self._manifest()[0]

    def table(self, name: str) -> DataFrame:
        """A table of the current version; inside a transaction, as it stands there."""
        _, folders, changed = self._open or (*self._manifest(), {})
        if name in changed:
            return changed[name]
        schema = TABLES[name]
        return self.spark.read.schema(schema).parquet(f"{self.root}/{folders[name]}") if name in folders else self.spark.createDataFrame([], schema)

    def views(self) -> None:
        """Register every table as a temporary view, for plain SQL."""
        for name in TABLES:
            self.table(name).createOrReplaceTempView(name)

    @contextmanager
    def transaction(self) -> Iterator[None]:
        """All commits inside are one write; nothing is written if one of them fails.
        A transaction inside a transaction is part of it."""
        if self._open is not None:
            yield
            return
        self._open = (*self._manifest(), {})
        try:
            yield
            n, folders, changed = self._open
            if changed:
                self._write(n, folders, changed)
        finally:
            self._open = None

    def commit(self, changed: dict[str, DataFrame]) -> None:
        """Put tables into the transaction that is open, or write them as one of their own."""
        with self.transaction():
            self._open[2].update(changed)

    def _write(self, n: int, folders: dict[str, str], changed: dict[str, DataFrame]) -> None:
        now = dict(folders) | {"_layout": LAYOUT}
        for name, df in changed.items():
            target = self.spark.createDataFrame([], TABLES[name]).schema
            shaped = df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in target])
            if name == "postings":
                shaped = shaped.repartitionByRange("term").sortWithinPartitions("term", "id")
            now[name] = f"tables/{name}-{uuid.uuid4().hex}"
            shaped.write.parquet(f"{self.root}/{now[name]}")
            if name == "postings":  # the numbers that every search needs, with the postings they are of
                now["totals"] = f"tables/totals-{uuid.uuid4().hex}"
                index.index_stats(self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{now[name]}")).coalesce(1).write.parquet(f"{self.root}/{now['totals']}")
        p, fs = self._path(f"{self.root}/versions/{n + 1:012d}")
        out = fs.create(p, False)  # fails if another writer was first
        out.write(bytearray((json.dumps(now, sort_keys=True) + "\n").encode()))
        out.close()

    def init(self) -> int:
        """Write the first version, of empty tables, if there is none."""
        if not self.version:
            self.commit({name: self.table(name) for name in TABLES if name != "totals"})
        return self.version

    def size(self) -> DataFrame:
        """(files, bytes) of the store's folder."""
        return folder_bytes(self.spark, self.root)

    def migrate(self) -> bool:
        """Bring a store of an older layout up to this one; whether there was anything to do.
        What is derived is made again: the index from the memories, code tables by the
        next ingest, which reads all files as none is known any more."""
        n, folders = self._manifest()
        if not n or folders.get("_layout") == LAYOUT:
            return False
        memory, derived = self.table("memory"), ("symbol", "about", "calls", "inherits", "imports", "pending", "file")
        fresh = {name: self.spark.createDataFrame([], TABLES[name]) for name in derived}
        self.commit({"memory": memory, "postings": index.build_postings(memory), **fresh})
        return True

    def vacuum(self, keep: int = 2) -> int:
        """Delete the manifests before the last ones and the folders that none names any
        more; how many folders went.  No write may be under way."""
        versions, fs = self._path(f"{self.root}/versions")
        tables, _ = self._path(f"{self.root}/tables")
        if not fs.exists(versions):
            return 0
        names = sorted(x.getPath().getName() for x in fs.listStatus(versions) if x.getPath().getName().isdigit())
        used: set[str] = set()
        for name in names[-max(1, keep) :]:
            text = self._text(f"{self.root}/versions/{name}")
            used |= set(json.loads(text).values()) if text.endswith("}\n") else set()
        for name in names[: -max(1, keep)]:
            delete(self.spark, f"{self.root}/versions/{name}")
        gone = [f"tables/{x.getPath().getName()}" for x in fs.listStatus(tables)]
        gone = [x for x in gone if x not in used]
        for x in gone:
            delete(self.spark, f"{self.root}/{x}")
        return len(gone)

    def tables(self) -> Tables:
        t = {n: self.table(n) for n in ("memory", "postings", "edge", "symbol", "about", "calls")}
        counted = self.version or self._open
        return Tables(vector=self.table("vector"), totals=self.table("totals") if counted else None, **t)

    # ------------------------------------------------------------ reads

    def _call_edges(self) -> DataFrame:
        return self.table("calls").select("src", "dst", "name", "line", "confidence")

    def _embedded(self, queries: DataFrame) -> DataFrame:
        return queries.join(embed_column(queries, "query_id", "q", self.embedder).drop("dims"), "query_id")

    def _queries(self, texts: Iterable[str]) -> DataFrame:
        return self._embedded(self.spark.createDataFrame(list(enumerate(texts)), "query_id long, q string"))

    def _options(self, **kw) -> Options:
        return Options(now=self.now, **kw)

    def search(self, *texts: str, **options) -> DataFrame:
        return retrieval.search(self.tables(), self._queries(texts), self._options(**options))

    def report(self, *texts: str, **options) -> DataFrame:
        o, q = self._options(**options), self._queries(texts)
        names, t = ("bm25", "semantic", "recency", "entity", "graph"), self.tables()
        return retrieval.fusion_report(retrieval.branches_of(t, q, o), q, names, retrieval.health(t, q, o))

    def index(self, *texts: str, **options) -> DataFrame:
        return retrieval.index_tier(self.tables(), self._queries(texts), self._options(limit=30, **options))

    def why(self, target: str, anchor_only: bool = False, **options) -> DataFrame:
        return retrieval.why(self.tables(), target, self._options(**options), sc.is_path(target), anchor_only, self._embedded)

    def get(self, node: str) -> tuple[DataFrame, DataFrame]:
        return self.table("memory").where(F.col("id") == node), self.table("edge").where((F.col("src") == node) | (F.col("dst") == node))

    def neighbors(self, node: str, depth: int = 2, **kw) -> DataFrame:
        roots = self.spark.createDataFrame([(node,)], "root string")
        return graph.neighbors(self.table("edge"), roots, depth, **kw)

    def related(self, node: str) -> DataFrame:
        """Up to three memories near one."""
        v = self.table("vector")
        return retrieval.related(v, self.table("memory"), v.where(F.col("id") == node).withColumnRenamed("id", "query_id"))

    def capabilities(self) -> DataFrame:
        """(name, provider, status, reason): what this installation can do."""
        hashed = self.embedder.provider == "hash"
        rows = [
            ("graph", "joins", "ok", None),
            ("keyword", "postings", "ok", None),
            ("vector search", "exact scan", "ok", None),
            ("embeddings", self.embedder.provider, "degraded" if hashed else "ok", "hashed terms carry no meaning" if hashed else None),
            ("tokenizer", "latin, cyrillic, greek, cjk bigrams", "ok", None),
            ("code: python", "ast", "ok", None),
            ("code: braces and end blocks", "patterns", "degraded", "declarations and imports only"),
            ("code: others", None, "unavailable", "no reader; files are cut into windows"),
        ]
        return self.spark.createDataFrame(rows, "name string, provider string, status string, reason string")

    def constraints(self, most: int = 10) -> DataFrame:
        return retrieval.constraints(self.table("memory"), most)

    def conflicts(self) -> tuple[DataFrame, DataFrame]:
        m, e = self.table("memory"), self.table("edge")
        return graph.declared_conflicts(e, m), graph.suspected_conflicts(m, e)

    def clusters(self) -> DataFrame:
        m, e = self.table("memory"), self.table("edge")
        return graph.cluster_report(graph.clusters(e, m), m, e)

    def map(self, prefix: str = "") -> DataFrame:
        return graph.symbol_map(self.table("symbol"), self._call_edges(), self.table("about"), self.table("memory"), prefix, self.table("inherits"))

    def imports(self, prefix: str = "") -> DataFrame:
        return graph.import_map(self.table("imports"), prefix)

    def changes(self, paths: Iterable[str]) -> DataFrame:
        files = self.spark.createDataFrame([(p,) for p in paths], "file_path string")
        return graph.changes(self.table("memory"), self.table("edge"), self.table("symbol"), self._call_edges(), self.table("about"), files)

    def doctor(self) -> DataFrame:
        more = {n: self.table(n) for n in ("postings", "symbol", "calls", "pending")}
        return evaluation.doctor(*[self.table(n) for n in ("memory", "edge", "about", "vector")], more, (self.embedder.model, self.embedder.provider))

    def stats(self) -> DataFrame:
        kinds = [self.table(n) for n in ("edge", "about", "calls", "inherits", "imports")]
        return evaluation.stats(self.table("memory"), kinds, self.table("vector"))

    def coverage(self, paths: Iterable[str]) -> DataFrame:
        """Which changed files have anything recorded, and how much of it is contested."""
        files = self.spark.createDataFrame([(p,) for p in paths], "file_path string")
        return graph.coverage(self.changes([r.file_path for r in files.collect()]), files)

    def evaluate(self, questions: DataFrame) -> DataFrame:
        """Recall of five configurations: all branches, and each of four left out.  A
        question that is put in two ways (ask, also) is asked twice."""
        asked = evaluation.phrasings(questions)
        q = self._embedded(asked.select("query_id", "q"))
        out = None
        for without in ("", "bm25", "semantic", "entity", "graph"):
            hits = retrieval.search(self.tables(), q, self._options(limit=5, disable=frozenset({without} - {""})))
            judged = evaluation.judge(hits, asked)
            row = evaluation.recall(judged).select(F.lit(f"without {without}" if without else "all").alias("configuration"), "*")
            out = row if out is None else out.unionByName(row)
        return out

    def missed(self, questions: DataFrame) -> DataFrame:
        """(id, q, got) of what all branches together don't answer."""
        asked = evaluation.phrasings(questions)
        hits = retrieval.search(self.tables(), self._embedded(asked.select("query_id", "q")), self._options(limit=5))
        return evaluation.missed(hits, asked).join(asked.select("query_id", "id", "q"), "query_id").select("id", "q", "got")

    # ------------------------------------------------------------ writes

    def _indexed(self, memory: DataFrame, changed: DataFrame) -> dict[str, DataFrame]:
        """The tables that follow from new or changed memory rows."""
        ids = changed.select("id").distinct()
        fresh = memory.join(ids, "id", "left_semi")
        text = fresh.select("id", F.concat_ws("\n", "title", "body").alias("text"))
        vectors = embed_column(text, "id", "text", self.embedder)
        ref = r"#L([0-9]+)-L([0-9]+)$"
        line = lambda i: F.regexp_extract("source_ref", ref, i).try_cast("long")
        chunks = fresh.where("layer = 'artifact'").select(F.col("id").alias("memory_id"), "file_path", line(1).alias("first"), line(2).alias("last"))
        anchors = code.span_anchors(fresh.where("layer <> 'artifact'"), self.table("symbol")).unionByName(code.chunk_anchors(chunks, self.table("symbol")))
        return {
            "memory": memory,
            "postings": mutations.flush_postings(self.table("postings").join(ids, "id", "left_anti"), index.build_postings(fresh)),
            "vector": self.table("vector").join(ids, "id", "left_anti").unionByName(vectors),
            "about": mutations.insert_absent(self.table("about"), anchors, ["memory_id", "symbol_id"]),
        }

    def write(self, rows: Iterable[tuple[str, str, str, str, float]]) -> DataFrame:
        """Rows of (layer, title, body, source_ref, importance); a source_ref is required."""
        rows = list(rows)
        for layer, _, _, ref, _ in rows:
            if layer not in sc.LAYERS or not ref:
                raise ValueError("each row needs a known layer and a source_ref")
        new = self.spark.createDataFrame(rows, "layer string, title string, body string, source_ref string, importance double")
        with self.transaction():
            out = self._put(new)
            if self.session:
                here = out.where(~F.col("source_ref").startswith("session://")).select(F.col("id").alias("src"), F.lit("OCCURRED_IN").alias("type"), F.lit(self.session).alias("dst"))
                self._link(here)
        return out

    def _link(self, new: DataFrame) -> DataFrame:
        """Edges (src, type, dst) into the open transaction; what was refused."""
        given = {"weight": F.lit(1.0), "created_at": F.lit(self.now), "evidence_ref": F.lit(None).cast("string")}
        new = new.withColumns({k: v for k, v in given.items() if k not in new.columns})
        edges, rejected = mutations.add_edges(self.table("edge"), new, self.table("memory"))
        self.commit({"edge": edges})
        return rejected

    def open_session(self, title: str) -> str:
        """Writes from now on are linked to this session's node."""
        self.session = None
        self.session = self.write([("episodic", title, title, f"session://{self.now}", 3.0)]).first().id
        return self.session

    def close_session(self, summary: str = "") -> None:
        node, self.session = self.session, None
        if node and summary:
            done = self.write([("episodic", "Session summary", summary, f"session://{self.now}/end", 4.0)]).first().id
            self.link(done, "DERIVED_FROM", node)

    def _put(self, new: DataFrame, more: dict[str, DataFrame] | None = None) -> DataFrame:
        clean = new.withColumns({"title": redact(F.col("title")), "body": redact(F.col("body"))})
        path = F.regexp_replace("source_ref", "#.*$", "")
        clean = clean.withColumns({
            "id": sc.node_id(F.col("layer"), F.col("source_ref"), F.col("body")),
            "file_path": F.when(F.col("source_ref").contains("://") | F.col("source_ref").startswith("session:"), None).otherwise(path),
            "confidence": F.lit(1.0),
        })
        merged = mutations.upsert_nodes(self.table("memory"), clean, self.now)
        changed = self._indexed(merged.drop("outcome"), clean)
        self.commit(changed | (more or {}))
        return clean.select("id", "layer", "title", "source_ref")

    def link(self, src: str, kind: str, dst: str, weight: float = 1.0, evidence: str | None = None) -> None:
        new = self.spark.createDataFrame([(src, kind, dst, weight, self.now, evidence)], TABLES["edge"])
        edges, rejected = mutations.add_edges(self.table("edge"), new, self.table("memory"))
        bad = rejected.first()
        if bad:
            raise ValueError(f"{src} {kind} {dst}: {bad.reason}")
        self.commit({"edge": edges})

    def summarize(self, members: list[str], title: str, body: str, importance: float = 6.0) -> str:
        if not body.strip():
            raise ValueError("a summary needs text")
        ref = f"cluster://{len(members)}-members"
        with self.transaction():
            node = self.write([("semantic", title, body, ref, importance)]).first().id
            self._link(self.spark.createDataFrame([(node, "DERIVED_FROM", m) for m in members], "src string, type string, dst string"))
        return node

    def queue(self, rows: DataFrame) -> None:
        """Put writes into the journal, to be merged later."""
        append_journal(rows, f"{self.root}/journal")

    def merge(self) -> None:
        """Fold queued nodes, then edges, into the store; each journal file once."""

        def apply(batch: DataFrame, _: int) -> None:
            good = batch.where("_bad is null").persist()
            nodes = good.where("kind = 'node'").select("layer", "title", "body", "source_ref", "importance")
            edges = good.where("kind = 'edge'").select("src", "type", "dst", "weight")
            with self.transaction():
                if not nodes.isEmpty():
                    self._put(nodes)
                if not edges.isEmpty():
                    self._link(edges)
            good.unpersist()

        drain(self.spark, f"{self.root}/journal", f"{self.root}/journal-state", apply)

    def journal(self) -> DataFrame:
        return read_journal(self.spark, f"{self.root}/journal")

    def prune(self, older_than_days: float, dry_run: bool = True, layers: tuple[str, ...] = ("episodic",)) -> DataFrame:
        if older_than_days <= 0:
            raise ValueError("the window must be longer than nothing")
        m, e, a = self.table("memory"), self.table("edge"), self.table("about")
        before = self.now - int(older_than_days * sc.DAY_MS)
        gone = mutations.prunable(m, e, a, before, layers)
        if not dry_run:
            gone = stored(gone, "pruned")  # the folders of the version before stay, but are not looked at again
            left, postings, _ = mutations.delete_nodes(m, self.table("postings"), gone.select("id"), e, a)
            self.commit({"memory": left, "postings": postings, "vector": self.table("vector").join(gone.select("id"), "id", "left_anti")})
        return gone.orderBy("weight", "created_at", "id")

    def embed(self, force: bool = False) -> int:
        """Embed what has no vector of this provider's space; how many rows that was."""
        v = self.table("vector")
        same = v.where((F.col("model") == self.embedder.model) & (F.col("dims") == self.embedder.dimensions) & (F.col("provider") == self.embedder.provider))
        todo = self.table("memory") if force else self.table("memory").join(same.select("id"), "id", "left_anti")
        text = todo.select("id", F.concat_ws("\n", "title", "body").alias("text"))
        n = todo.count()
        if n:
            self.commit({"vector": v.join(todo.select("id"), "id", "left_anti").unionByName(embed_column(text, "id", "text", self.embedder))})
        return n

    # ------------------------------------------------------------ ingest

    def ingest(self, folder: str, force: bool = False, named: str | None = None) -> dict[str, DataFrame | int]:
        """Read a repository: chunks, declarations and relations of changed files; vanished ones reclaimed.

        named: read just this file, whatever the walk's policy says of it.
        """
        found = read_named(self.spark, folder, named) if named else read_files(self.spark, folder)
        files = found.where("reason is null")
        known = self.table("file")
        changed = files if force else files.join(known.select("path", "stamp"), ["path", "stamp"], "left_anti")
        vanished = known.limit(0) if named else known.join(files.select("path"), "path", "left_anti")
        n = changed.count()
        out: dict[str, DataFrame | int] = {"files": n, "skipped": skip_report(found), "vanished": vanished.count()}
        if not n and not out["vanished"]:
            return out
        touched = changed.select(F.col("path").alias("file_path")).union(vanished.select("path"))
        pieces = chunking.chunk_files(changed)
        parts = F.count("*").over(Window.partitionBy("path"))
        nodes = pieces.withColumn("parts", parts).select(
            F.lit("artifact").alias("layer"),
            sc.title_for(F.col("path"), F.col("heading_path"), F.col("ordinal") + 1, F.col("parts")).alias("title"),
            F.col("text").alias("body"),
            F.concat("path", F.lit("#L"), "start_line", F.lit("-L"), "end_line").alias("source_ref"),
            F.lit(3.0).alias("importance"),
        )
        symbols = stored(chunking.symbols_of(chunking.declaration_rows(changed)), "symbols")
        symbol = mutations.replace_relations(self.table("symbol"), symbols, touched)
        relations = stored(chunking.relation_rows(changed), "relations")
        boxes = chunking.container_rows(changed)
        all_files = known.join(changed.select("path"), "path", "left_anti").join(vanished.select("path"), "path", "left_anti")
        all_files = all_files.select("path", "container").unionByName(boxes)
        modules = relations.where("kind = 'import'").select(F.col("path").alias("from_path"), F.col("name").alias("module"))
        imported = stored(code.resolve_imports(modules, all_files).withColumnsRenamed({"from_path": "src_path", "path": "dst_path"}), "imported")
        imports = mutations.replace_relations(self.table("imports"), imported, touched.withColumnRenamed("file_path", "src_path"), "src_path")
        imports = imports.join(vanished.select(F.col("path").alias("dst_path")), "dst_path", "left_anti")
        # calls into symbols that are gone open again; they and what was left open are tried once more
        gone = self.table("symbol").join(touched, "file_path", "left_semi").join(symbols.select("id"), "id", "left_anti").select("id")
        _, calls, about, opened = mutations.delete_symbols(symbol, self.table("calls"), self.table("about"), gone)
        calls, opened, waiting = (x.join(touched, "file_path", "left_anti") for x in (calls, opened, self.table("pending")))
        sites = self._sites(relations, symbol)
        again = opened.unionByName(waiting)
        tried = again.join(symbols.select("name").distinct(), "name", "left_semi").unionByName(opened).drop("reason").distinct()
        fresh, left = self._resolved(sites.where("kind = 'call'").drop("kind").unionByName(tried), symbol, imports, modules, all_files)
        keys = [c for c in tried.columns if c != "construction"]
        same = [again[c].eqNullSafe(tried[c]) for c in keys]
        untried = again.join(tried, same, "left_anti")
        # bases of classes are found like constructions
        bases = sites.where("kind = 'inherits'").drop("kind").withColumn("construction", F.lit(True))
        based, _ = self._resolved(bases, symbol, imports, modules, all_files)
        own = self.table("symbol").join(touched, "file_path", "left_semi").select(F.col("id").alias("src"))
        inherits = self.table("inherits").join(own, "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti")
        inherits = inherits.select("src", "dst", "confidence").unionByName(based.select("src", "dst", "confidence").distinct())
        state = known.join(touched.withColumnRenamed("file_path", "path"), "path", "left_anti").unionByName(changed.select("path", "stamp").join(boxes, "path", "left"))
        # chunks that their file no longer gives go, or are superseded where something is linked to them
        ids = nodes.withColumns({"title": redact(F.col("title")), "body": redact(F.col("body"))}).select(sc.node_id(F.col("layer"), F.col("source_ref"), F.col("body")).alias("id"))
        old = retrieval.live(self.table("memory"), ("artifact",)).join(touched, "file_path", "left_semi").join(ids, "id", "left_anti").select("id")
        old = stored(old, "old")
        # (of a vanished file, its declarations still count as such links)
        lost = self.table("symbol").join(vanished.select(F.col("path").alias("file_path")), "file_path", "left_semi")
        links = about.unionByName(self.table("about").join(lost.select(F.col("id").alias("symbol_id")), "symbol_id", "left_semi"))
        kept, postings, refused = mutations.delete_nodes(self.table("memory"), self.table("postings"), old, self.table("edge"), links)
        refused = stored(refused, "refused")
        memory = stored(mutations.supersede(kept, refused, self.now), "memory")
        columns = [f.split()[0] for f in TABLES["calls"].split(", ")]
        kinds = dict(map(tuple, relations.groupBy("kind").count().collect()))
        out |= {
            "symbols": symbols.count(), "call_sites": kinds.get("call", 0), "bases": kinds.get("inherits", 0), "imports": imported.count(),
            "calls_resolved": fresh.count(), "bases_resolved": based.count(), "calls_open": left.count(), "calls_reopened": opened.count(),
            "chunks": nodes.count(), "chunks_superseded": refused.count(), "chunks_deleted": old.count() - refused.count(),
        }
        with self.transaction():
            self.commit({"memory": memory, "postings": postings, "symbol": stored(symbol, "symbol"), "about": about, "file": state, "imports": imports,
                         "calls": calls.select(*columns).unionByName(fresh.select(*columns)), "pending": untried.unionByName(left), "inherits": inherits})
            self._put(nodes)
        return out

    def _sites(self, relations: DataFrame, symbol: DataFrame) -> DataFrame:
        """Calls and bases with the declaration that they stand in."""
        sites = relations.where("kind in ('call', 'inherits')").withColumn("site_id", F.xxhash64("path", "line", "kind", "name", "receiver"))
        around = code.enclosing(sites.select("site_id", F.col("path").alias("file_path"), F.col("line").cast("long").alias("line")), symbol)
        return sites.join(around, "site_id").select(
            "kind", F.col("symbol_id").alias("src"), F.col("path").alias("file_path"), "name", "receiver", "receiver_type", "construction", F.col("line").cast("long").alias("line")
        ).distinct()

    @staticmethod
    def _resolved(sites: DataFrame, symbol: DataFrame, imports: DataFrame, modules: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(resolved with dst and confidence, left open with the reason)."""
        sites = stored(sites.withColumn("call_id", F.xxhash64("src", "line", "name", "receiver")).dropDuplicates(["call_id"]), "sites")
        links = imports.select(F.col("src_path").alias("from_path"), F.col("dst_path").alias("path"))
        found = code.resolve_calls(sites, symbol, links, code.visible_containers(files, modules), files)
        found = stored(found.drop("src"), "resolved").join(sites, "call_id").drop("call_id")
        return found.where("dst is not null").drop("reason"), found.where("dst is null").drop("dst", "confidence")
