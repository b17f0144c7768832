"""Plans whose rows must not grow faster than their input."""

from __future__ import annotations

import tracemalloc


import numpy as np
import pyarrow as pa

from mnemospark.functions import vectors
from mnemospark.operators import code, graph, index, mutations, retrieval
from mnemospark.plans import catalogue
from mnemospark.plans.views import view
from mnemospark.storage import stored


def most_rows(df):
    """The rows of df, and the largest number that any step of its last plan put out."""

    def walk(plan):
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        metric = plan.metrics().get("numOutputRows")
        own = metric.get().value() if metric.isDefined() else 0
        below = [plan.plan()] if name.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
        return max([own, *map(walk, below)])

    rows = df.collect()
    return rows, walk(df._jdf.queryExecution().executedPlan())


def test_calls_of_a_common_name_are_not_joined_to_all_its_declarations(spark):
    n = 1500  # all of one name; ten files to a pack, and ten to a container
    symbol = spark.range(n).selectExpr("concat('Symbol:f', id, ':Own', id, '.m') as id", "'m' as name", "concat('f', id) as file_path", "if(id % 2 = 0, 'method', 'class') as kind", "id as k")
    calls = symbol.selectExpr("k as call_id", "concat('Symbol:x', k) as src", "concat('g', k) as file_path", "name", "cast(null as string) as receiver",
        "if(k % 3 = 0, concat('Own', k), null) as receiver_type", "k % 4 = 0 as construction", "k")
    uses = calls.where("k % 3 = 1").selectExpr("file_path as from_path", "concat('p', k div 2) as pack")
    packs = symbol.selectExpr("concat('p', k) as pack", "file_path as path")
    links = uses.join(packs, "pack").select("from_path", "path")
    boxes = symbol.selectExpr("file_path as path", "concat('c', k div 4) as container")
    seen = calls.where("k % 3 = 2").selectExpr("file_path as path", "concat('c', k div 8) as container")
    rows, most = most_rows(code.resolve_calls(calls.drop("k"), symbol.drop("k"), uses, seen, boxes, packs))
    assert most <= 4 * n
    assert sorted(map(tuple, rows)) == sorted(map(tuple, code.resolve_calls(calls.drop("k"), symbol.drop("k"), links, seen, boxes).collect()), key=lambda r: r[0])
    by = {r.call_id: r for r in rows}
    for k in range(n):
        make, like = k % 4 == 0, (lambda i, make=k % 4 == 0: (i % 2 == 1) == make)
        want = {0: [k] if like(k) else [], 1: [k // 2] if like(k // 2) else [], 2: [i for i in range(k // 8 * 4, k // 8 * 4 + 4) if like(i)]}[k % 3]
        rule = ("type", "import", "import")[k % 3]
        assert (by[k].dst, by[k].confidence) == ((f"Symbol:f{want[0]}:Own{want[0]}.m", rule) if len(want) == 1 else (None, None)), (k, make)
        assert by[k].reason == (None if len(want) == 1 else "ambiguous")


def test_overlapping_packs_and_repeated_declarations(spark):
    row = lambda f, n="m": (f"Symbol:{f}:{n}", n, f, "function")
    symbol = spark.createDataFrame([row("a"), row("b"), row("c", "twice"), row("c", "twice"), row("d", "twice")], "id string, name string, file_path string, kind string")
    calls = spark.createDataFrame(
        [(1, "s", "x", "m", None, None, False), (2, "s", "y", "m", None, None, None), (3, "s", "x", "twice", None, None, False), (4, "s", "x", "none", None, None, True), (5, "s", "z", None, None, None, False)],
        "call_id long, src string, file_path string, name string, receiver string, receiver_type string, construction boolean",
    )
    uses = spark.createDataFrame([("x", "p"), ("x", "q"), ("y", "p"), ("y", "r"), ("x", "s")], "from_path string, pack string")
    packs = spark.createDataFrame([("p", "a"), ("q", "a"), ("r", "b"), ("s", "c")], "pack string, path string")
    links = uses.join(packs, "pack").select("from_path", "path")
    want = [(1, "Symbol:a:m", "import", None), (2, None, None, "ambiguous"), (3, None, None, "ambiguous"), (4, None, None, "external"), (5, None, None, "external")]
    for found in (code.resolve_calls(calls, symbol, uses, packs=packs), code.resolve_calls(calls, symbol, links)):
        assert sorted(map(tuple, found.select("call_id", "dst", "confidence", "reason").orderBy("call_id").collect())) == want


def test_nearest_makes_no_pair_rows_and_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "TASK_QUERIES", 30)  # several groups of queries and parts of vectors
    monkeypatch.setattr(retrieval, "PART_VECTORS", 100)
    put = np.random.default_rng(5)
    base = put.normal(size=(40, 8)).astype("float32")
    rows = [(f"v{k:04d}", (base[k % 40] if k % 3 else put.normal(size=8).astype("float32")).tolist(), "m" if k % 10 else "n", "p") for k in range(600)]
    rows += [("zero", [0.0] * 8, "m", "p"), ("none", None, "m", "p"), ("wide", [1.0] * 9, "m", "p"), ("lost", [1.0] * 8, None, "p")]
    v = spark.createDataFrame(rows, "id string, embedding array<float>, model string, provider string")
    q = v.where("id like '%5' or id in ('zero', 'none', 'wide', 'lost')").withColumnRenamed("id", "query_id")
    found, most = most_rows(retrieval.nearest(v, q, 7))
    assert most < v.count() * q.count() / 5
    want = []
    for a, x, m, p in (r for r in rows if r[0].endswith("5") or not r[0].startswith("v")):
        sims = []
        for b, y, n, _ in rows:
            if m is None or n != m:
                continue
            if x is None or y is None or len(x) != len(y):
                sims.append((1, 0, b, None))
                continue
            x64, y64 = np.float64(x), np.float64(y)
            below = np.sqrt(x64 @ x64) * np.sqrt(y64 @ y64)
            sim = 0.0 if below == 0 else float(x64 @ y64 / below)
            sims.append((0, -round(sim, 9), b, sim))
        want += [(a, b, k, None if s is None else round(s, 8)) for k, (*_, b, s) in enumerate(sorted(sims, key=lambda r: r[:3])[:7], 1)]
    got = [(r.query_id, r.id, r["rank"], None if r.sim is None else round(r.sim, 8)) for r in found]
    assert sorted(got, key=lambda r: (r[0], r[2])) == sorted(want, key=lambda r: (r[0], r[2]))


def test_imports_meet_containers_and_endings_summed_up(spark):
    n = 600  # of one container but for the last file
    files = spark.range(n).selectExpr("concat('src/f', id, '.py') as path", f"if(id = {n - 1}, 'q.one', 'p.all') as container")
    imports = spark.range(n).selectExpr("concat('src/g', id) as from_path", "case id % 4 when 0 then 'p.all.T' when 1 then 'q.one.T' when 2 then concat('./f', id) else concat('src/f', id, '.py') end as module")
    rows, most = most_rows(code.resolve_imports(imports, files))
    assert most <= 5 * n
    want = [(f"src/g{k}", f"./f{k}" if k % 4 == 2 else f"src/f{k}.py", f"src/f{k}.py") for k in range(n) if k % 4 > 1]
    want += [(f"src/g{k}", "q.one.T", f"src/f{n - 1}.py") for k in range(n) if k % 4 == 1]
    assert sorted(map(tuple, rows)) == sorted(want)
    one = spark.createDataFrame([("a/x", "./b"), ("a/x", "./c.js"), ("a/x", "d/e")], "from_path string, module string")
    here = spark.createDataFrame([("a/b.py", None), ("a/b.ts", None), ("a/b", None), ("a/c.ts", None), ("d/e/index.ts", None)], "path string, container string")
    assert sorted(r.path for r in code.resolve_imports(one, here).collect()) == ["a/b", "a/c.ts", "d/e/index.ts"]


def test_keyword_scores_keep_pairs_inside_tasks(spark):
    put = np.random.default_rng(3)
    texts = [" ".join(f"w{k}" for k in put.integers(0, 30, 12)) for _ in range(400)]
    memory = spark.createDataFrame([(f"d{k:03d}", "t", texts[k % 350]) for k in range(400)], "id string, title string, body string")
    asked = spark.createDataFrame([(k, " ".join(f"w{j}" for j in put.integers(0, 30, 6))) for k in range(60)] + [(99, "nothing")], "query_id long, q string")
    postings, terms = stored(index.build_postings(memory), "postings"), index.query_terms(asked)
    every, best = index.matches(postings, terms), index.matches(postings, terms, most=9)
    rows, most = most_rows(best)
    assert most < every.count() / 2
    cut = lambda df, f: sorted((r.query_id, r["rank"], r.id, round(r.score, 7), r.overlap) for r in f(df, 9).collect())
    assert cut(best, index.bm25) == cut(every, index.bm25)
    assert cut(best, index.overlap) == cut(every, index.overlap)
    assert not index.matches(postings, terms.limit(0), most=9).collect()


def test_clusters_do_not_hang_on_the_order_of_rows(spark):
    # a grid: many moves of equal gain
    edge = spark.range(64).selectExpr("id as k", "explode(array(1, 8)) as step").where("k + step < 64 and (step = 8 or k % 8 < 7)")
    edge = edge.selectExpr("concat('n', k) as src", "concat('n', k + step) as dst", "1.0D as weight")
    memory = spark.range(64).selectExpr("concat('n', id) as id", "cast(null as long) as superseded_at", "'semantic' as layer")
    put = lambda n, by: sorted(map(tuple, graph.clusters(edge.repartition(n).sortWithinPartitions(by), memory, rounds=2).collect()))
    assert put(1, "src") == put(3, "dst")


def test_a_search_without_postings_makes_none_and_equals_one_with_them(spark, monkeypatch):
    put = np.random.default_rng(4)
    texts = [" ".join(f"w{k}" for k in put.integers(0, 30, 12)) + " Straße getUser_names thèses" for _ in range(300)] + ["", " -- "]
    memory = spark.createDataFrame([(f"d{k:03d}", "t" if k < 300 else "", x) for k, x in enumerate(texts)], "id string, title string, body string")
    asked = spark.createDataFrame([(k, " ".join(f"w{j}" for j in put.integers(0, 30, 6)) + " user theses") for k in range(40)] + [(99, "nothing")], "query_id long, q string")
    terms = stored(index.query_terms(asked), "terms")
    want = index.matches(stored(index.build_postings(memory), "postings"), terms)
    cut = lambda df, f: sorted((r.query_id, r["rank"], r.id, round(r.score, 7), r.overlap) for r in f(df, 9).collect())
    wanted = [cut(want, f) for f in (index.bm25, index.overlap)]
    monkeypatch.setattr(index, "build_postings", lambda memory: 1 / 0)
    rows, most = most_rows(index.scan(memory, terms, 9))
    assert most < want.count() / 2
    assert [cut(spark.createDataFrame(rows), f) for f in (index.bm25, index.overlap)] == wanted


def test_equal_documents_do_not_pile_up_behind_the_best():
    key = np.full((3, 1000), 2, np.int64)
    key[1, 500:] = 7
    i, j = vectors._leading(key, key > 0, 5)
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == [(r, c) for r, at in ((0, 0), (1, 500), (2, 0)) for c in range(at, at + 5)]
    kept = vectors.Leaders(1, 2)
    for names in (["m", "n"], ["k", "z"], ["y", "x"]):  # of equal keys the least ids stay, whatever their order
        kept.merge(np.zeros(2, np.int64), np.full(2, 4, np.int64), np.array(names, object), np.ones(2))
    assert kept.found.tolist() == ["k", "m"]


def test_suspected_conflicts_are_judged_where_they_meet_and_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(graph, "TASK_MEMBERS", 7)  # large classes are dealt over tasks
    put = np.random.default_rng(6)
    titles = [" ".join(sorted({f"w{k}" for k in put.integers(0, 14, 6)})) for _ in range(120)] + ["many copies of this"] * 60
    memory = spark.createDataFrame([(f"d{k:03d}", "semantic", x, None) for k, x in enumerate(titles)], "id string, layer string, title string, superseded_at long")
    told = [(f"d{k:03d}", f"d{k + 1:03d}", "SUPERSEDES") for k in range(100, 170, 2)] + [(f"d{k + 1:03d}", f"d{k:03d}", "CONTRADICTS") for k in range(60)] + [("d150", "d151", "RESOLVES")]
    edge = spark.createDataFrame(told, "src string, dst string, type string")
    sets = [{w for w in x.split() if w != "of" and w != "this"} for x in titles]
    known = {tuple(sorted(t[:2])) for t in told if t[2] != "RESOLVES"}
    want = []
    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            like = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            if like >= 0.6 and (f"d{i:03d}", f"d{j:03d}") not in known:
                want.append((f"d{i:03d}", f"d{j:03d}", round(like, 9)))
    found = graph.suspected_conflicts(memory, edge)
    assert sorted((r.a, r.b, round(r.similarity, 9)) for r in found.collect()) == want
    exchanges = []

    def walk(plan):
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        below = [plan.plan()] if name.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
        if name == "ShuffleExchangeExec":
            exchanges.append(plan.metrics().get("shuffleRecordsWritten").get().value())
        for x in below:
            walk(x)

    walk(found._jdf.queryExecution().executedPlan())
    assert max(exchanges, default=0) < len(want) / 2


def test_a_flush_does_not_shuffle_the_postings(spark):
    postings = stored(spark.range(2000).selectExpr("concat('d', id % 100) as id", "concat('t', id) as term", "1L as tf", "20L as doc_len"), "postings")
    changed = postings.where("id in ('d3', 'd70')").selectExpr("id", "term", "2L as tf", "doc_len")
    out = mutations.flush_postings(postings, changed)
    assert "SortMergeJoin" not in (plan := out._jdf.queryExecution().executedPlan().toString()) and "Exchange hashpartitioning" not in plan
    rows = out.collect()
    assert len(rows) == 2000 and {r.id for r in rows if r.tf == 2} == {"d3", "d70"}
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        hinted = mutations.flush_postings(postings, changed)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in hinted and "SortMergeJoin" not in hinted
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)


def test_texts_are_not_shuffled_to_meet_their_labels(spark, tmp_path):
    n = 300
    documents = spark.range(n).selectExpr("id as doc_id", "concat('word', id % 7, ' other', id % 3) as text", "'src1' as source")
    labels = spark.range(0, n, 3).selectExpr("id as doc_id", "cast(id % 2 as int) as quality", "0 as toxic")
    for name, of in (("once", labels), ("twice", labels.union(labels.where("doc_id < 30")))):
        documents.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        of.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    memory = view(spark, f"{tmp_path}/once", "memory")
    assert "Join" not in plan(index._texts(memory))  # texts alone meet no labels
    q = spark.createDataFrame([(1, "word3 other1"), (2, "word5")], "query_id long, q string")
    found = retrieval.search(catalogue.tables(spark, f"{tmp_path}/once"), q, retrieval.Options(limit=4))
    lines = plan(found).splitlines()
    semi, outer = (next(k for k, x in enumerate(lines) if f"Join {kind}" in x) for kind in ("LeftSemi", "LeftOuter"))
    assert outer < semi  # the winners are picked below the join with the labels
    rows = found.collect()
    assert len({(r.query_id, r.id) for r in rows}) == len(rows) > 4
    assert memory.count() == n and memory.where("importance = 7").count() == n // 6
    assert view(spark, f"{tmp_path}/twice", "memory").count() == n + 10  # a document labelled twice is two rows, as in SQL


def test_scoring_holds_a_small_block_of_pairs():
    put = np.random.default_rng(1)
    docs, n, words, per = 2500, 200, 300, 40
    ts = pa.array([sorted(put.choice(words, 60, replace=False).tolist()) for _ in range(docs)], pa.list_(pa.int32()))
    columns = [pa.nulls(docs, pa.int64()), pa.array([f"d{k:05d}" for k in range(docs)]), pa.array([60] * docs), ts, pa.array([[1] * 60] * docs)]
    batch = pa.RecordBatch.from_arrays(columns, ["query_id", "id", "doc_len", "ts", "tfs"])
    queries = np.concatenate([np.sort(put.choice(n, per, replace=False)) for _ in range(words)])
    tracemalloc.start()
    rows = sum(x.num_rows for x in vectors.best_documents([batch], queries, np.arange(0, words * per + 1, per), np.ones(words), list(range(n)), 60.0, 180))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows >= n * 180 and peak < 40e6
