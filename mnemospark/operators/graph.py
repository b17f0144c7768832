"""Graph operators over typed memory edges and code relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions.scalars import EDGE_TYPES
from mnemospark.functions.text import term_rows
from mnemospark.operators.retrieval import about_path, anchored_order, live
from mnemospark.storage import stored

MOST_DEPTH = 4


def _directed(edge: DataFrame, direction: str) -> DataFrame:
    out = edge.select(F.col("src").alias("at"), F.col("dst").alias("to"), "type", "weight", F.lit("out").alias("direction"))
    back = edge.select(F.col("dst").alias("at"), F.col("src").alias("to"), "type", "weight", F.lit("in").alias("direction"))
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction]


def neighbors(
    edge: DataFrame, roots: DataFrame, depth: int = 2, direction: str = "both", types: tuple[str, ...] = (), most: int = 50
) -> DataFrame:
    """Breadth-first reach of each root: (root, id, hops, score, via), best first.

    The score halves with each hop and takes the weight of the edge that found
    the node first (by type, then ends); via lists every step seen on the way.
    """
    if depth < 1:
        raise ValueError("depth must be at least 1")
    step = _directed(edge.where(F.col("type").isin(*types)) if types else edge, direction).distinct()
    order = F.array(*map(F.lit, EDGE_TYPES))
    seen = roots.select("root", F.col("root").alias("id"))
    frontier, found, steps = seen, None, None
    for hop in range(1, min(depth, MOST_DEPTH) + 1):
        taken = frontier.withColumnRenamed("id", "at").join(step, "at").where("to <> root")
        steps = taken if steps is None else steps.unionByName(taken)
        first = Window.partitionBy("root", "to").orderBy(F.array_position(order, F.col("type")), "at", "direction")
        fresh = (
            taken.join(seen.withColumnRenamed("id", "to"), ["root", "to"], "left_anti")
            .withColumn("k", F.row_number().over(first))
            .where("k = 1")
            .select(
                "root",
                F.col("to").alias("id"),
                F.lit(hop).alias("hops"),
                (F.when(F.coalesce("weight", F.lit(0.0)) == 0, 1.0).otherwise(F.col("weight")) * 0.5 ** (hop - 1)).alias("score"),
            )
        )
        found = fresh if found is None else found.unionByName(fresh)
        frontier = fresh.select("root", "id")
        seen = seen.unionByName(frontier)
    via = steps.groupBy("root", F.col("to").alias("id")).agg(
        F.array_sort(F.collect_set(F.struct(F.col("at").alias("from"), "type", "direction"))).alias("via")
    )
    rank = F.row_number().over(Window.partitionBy("root").orderBy("hops", F.desc("score"), "id"))
    return found.withColumn("k", rank).where(F.col("k") <= most).drop("k").join(via, ["root", "id"])


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of (src, dst); component: the least id.

    Labels spread along edges and along themselves (pointer jumping), so the
    rounds grow with the logarithm of the longest path.  Tables with a row a node are
    merged and never broadcast, so nothing of a round goes to the driver.
    """
    both = stored(edges.select("src", "dst").union(edges.select("dst", "src")).where("src <> dst").distinct(), "both")
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    label = stored(nodes.select("id", F.col("id").alias("component")), "labels")
    while True:
        near = both.join(label.hint("merge"), both["dst"] == label["id"]).groupBy("src").agg(F.min("component").alias("m"))
        least = label.join(near.hint("merge"), label["id"] == near["src"], "left").select("id", "component", F.least("component", "m").alias("m"))
        # the root of a tree takes the least label that its tree has met
        roots = least.groupBy("component").agg(F.min("m").alias("best"))
        hooked = least.join(roots.hint("merge"), "component").select("id", F.col("component").alias("old"), F.least("m", "best").alias("component"))
        jump = hooked.select(F.col("id").alias("component"), F.col("component").alias("next"))
        new = hooked.join(jump.hint("merge"), "component", "left").select("id", "old", F.coalesce("next", "component").alias("component"))
        new = stored(new, "labels")
        label = new.select("id", "component")
        if new.where("old <> component").isEmpty():
            return label


def clusters(edge: DataFrame, memory: DataFrame, rounds: int = 10, least: int = 2) -> DataFrame:
    """(id, cluster): communities by synchronous local moving on modularity.

    Each round every node looks at its neighbours' communities and takes the one
    of largest gain; odd and even rounds move towards smaller and larger labels
    in turn, so pairs don't swap for ever.  No component is gathered anywhere.
    """
    alive = live(memory).select("id")
    pairs = edge.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.coalesce("weight", F.lit(1.0)).alias("w"))
    pairs = pairs.groupBy("a", "b").agg(F.max("w").alias("w"))
    pairs = pairs.join(alive.withColumnRenamed("id", "a").hint("merge"), "a", "left_semi").join(alive.withColumnRenamed("id", "b").hint("merge"), "b", "left_semi")
    both = stored(pairs.select(F.col("a").alias("id"), F.col("b").alias("to"), "w").union(pairs.select("b", "a", "w")), "pairs")
    degree = stored(both.groupBy("id").agg(F.sum("w").alias("k")), "degree")
    total = degree.agg(F.sum("k")).first()[0] or 1.0
    label = degree.select("id", "k", F.col("id").alias("cluster"))
    for turn in range(rounds):
        size = label.groupBy("cluster").agg(F.sum("k").alias("mass"))
        near = both.join(label.select(F.col("id").alias("to"), "cluster").hint("merge"), "to").groupBy("id", "cluster").agg(F.sum("w").alias("links"))
        mine = label.select("id", "k", F.col("cluster").alias("own"))
        options = near.join(mine.hint("merge"), "id").join(size.hint("merge"), "cluster")
        inside = F.col("cluster") == F.col("own")
        gain = F.col("links") - F.col("k") * (F.col("mass") - F.when(inside, F.col("k")).otherwise(0.0)) / total
        best = options.groupBy("id").agg(F.max_by(F.struct("cluster", gain.alias("gain")), F.struct(F.round(gain, 9), inside.cast("int"), "cluster")).alias("best"))
        stay = options.where(inside).select("id", gain.alias("kept"))
        way = F.col("best.cluster") < F.col("own") if turn % 2 == 0 else F.col("best.cluster") > F.col("own")
        better = (F.col("best.gain") > F.coalesce("kept", F.lit(0.0)) + 1e-9) & way
        moved = mine.join(best.hint("merge"), "id", "left").join(stay.hint("merge"), "id", "left")
        new = stored(moved.select("id", "k", F.when(better, F.col("best.cluster")).otherwise(F.col("own")).alias("cluster"), F.coalesce(better, F.lit(False)).alias("moved")), "labels")
        label = new.select("id", "k", "cluster")
        if turn % 2 and new.where("moved").isEmpty():
            break
    size = label.groupBy("cluster").agg(F.count("*").alias("n"), F.min("id").alias("least")).where(F.col("n") >= least)
    return label.join(size.hint("merge"), "cluster").select("id", F.col("least").alias("cluster"), "n")


def cluster_report(labels: DataFrame, memory: DataFrame, edge: DataFrame) -> DataFrame:
    """Size, five representatives, common title terms and summary of each cluster."""
    m = labels.join(memory, "id")
    order = Window.partitionBy("cluster").orderBy(F.desc("importance"), F.desc("created_at"), "id")
    reps = m.withColumn("k", F.row_number().over(order)).where("k <= 5").groupBy("cluster").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("k", "id"))), lambda x: x["id"]).alias("representatives")
    )
    words = term_rows(m.select("id", "title"), "id", "title").where("length(term) > 3").join(labels, "id")
    words = words.groupBy("cluster", "term").agg(F.count("*").alias("df")).where("df > 1")
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("df"), "term"))
    terms = words.withColumn("k", rank).where("k <= 6").groupBy("cluster").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("k", "term"))), lambda x: x["term"]).alias("terms")
    )
    author = edge.where("type = 'DERIVED_FROM'").join(labels.select(F.col("id").alias("dst"), "cluster"), "dst")
    author = author.groupBy("cluster", "src").agg(F.countDistinct("dst").alias("covers")).where("covers >= 2")
    author = author.groupBy("cluster").agg(F.max_by("src", F.struct("covers", "src")).alias("summary"))
    base = labels.groupBy("cluster").agg(F.first("n").alias("n"))
    return base.join(reps, "cluster", "left").join(terms, "cluster", "left").join(author, "cluster", "left")


def declared_conflicts(edge: DataFrame, memory: DataFrame) -> DataFrame:
    alive = live(memory).select("id")
    e = edge.where("type = 'CONTRADICTS'").select("src", "dst").distinct()
    return e.join(alive.withColumnRenamed("id", "src"), "src", "left_semi").join(alive.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")


def suspected_conflicts(memory: DataFrame, edge: DataFrame, least: float = 0.6) -> DataFrame:
    """Live semantic pairs of like titles (Jaccard of term sets) that no edge explains.

    Titles meet only on their rarest terms: a pair of the wanted similarity must
    share one of the first n - ceil(least * n) + 1 terms in order of frequency, so
    common words join nothing.  Titles of equal terms meet as one; only pairs that
    are reported are spelled out by member.
    """
    titles = live(memory, ("semantic",)).select("id", "title")
    own = term_rows(titles, "id", "title").groupBy("id").agg(F.array_sort(F.collect_list("term")).alias("terms"))
    own = stored(own.withColumn("kind", F.sha2(F.array_join("terms", "\n"), 256)), "title_terms")
    member = own.select("kind", "id")
    terms = own.groupBy("kind").agg(F.first("terms").alias("terms")).select(F.col("kind").alias("id"), F.explode("terms").alias("term"))
    terms = stored(terms, "kinds")
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("df", "term"))
    ranked = terms.join(df, "term").withColumn("k", place).withColumn("n", F.count("*").over(Window.partitionBy("id")))
    ranked = ranked.where(F.col("k") <= F.col("n") - F.ceil(F.lit(least) * F.col("n")) + 1)
    first = ranked.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "term"))), lambda x: x["term"]).alias("first"))
    sets = stored(terms.groupBy("id").agg(F.array_sort(F.collect_list("term")).alias("terms")).join(first, "id"), "sets")
    keys = sets.select("id", "terms", "first", F.explode("first").alias("term"))
    a = keys.select(F.col("id").alias("ka"), F.col("terms").alias("ta"), F.col("first").alias("fa"), "term")
    b = keys.select(F.col("id").alias("kb"), F.col("terms").alias("tb"), F.col("first").alias("fb"), "term")
    # pairs are judged where they meet, on the first term that they share, and only those that are alike leave the task
    shared = F.size(F.array_intersect("ta", "tb"))
    both = a.join(b, "term").where("ka < kb").where(F.get(F.array_intersect("fa", "fb"), F.lit(0)) == F.col("term"))
    alike = both.withColumn("similarity", shared / (F.size("ta") + F.size("tb") - shared)).where(F.col("similarity") >= least).select("ka", "kb", "similarity")
    size = member.groupBy("kind").count()
    alike = alike.unionByName(size.where("count > 1").select(F.col("kind").alias("ka"), F.col("kind").alias("kb"), F.lit(1.0).alias("similarity")))
    return _spelled_out(stored(alike, "alike"), member, size, edge.where("type in ('CONTRADICTS', 'SUPERSEDES')"))


#: Members of a class that one task meets with others.
TASK_MEMBERS = 1_024


def _spelled_out(alike: DataFrame, member: DataFrame, size: DataFrame, known: DataFrame) -> DataFrame:
    """(a, b, similarity): the members of alike classes (ka, kb, similarity) that no known edge joins.

    What an edge explains is noted beside the members before they meet, so pairs are
    made once and not shuffled; a large class is dealt over tasks.
    """
    ends = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    told = known.select(F.explode(F.array(ends("src", "dst"), ends("dst", "src"))).alias("e")).select("e.x", "e.y").distinct()
    told = told.join(member.select(F.col("id").alias("x"), F.col("kind").alias("kx")), "x").join(member.select(F.col("id").alias("y"), F.col("kind").alias("ky")), "y")
    told = told.withColumns({"ka": F.least("kx", "ky"), "kb": F.greatest("kx", "ky")}).join(alike.select("ka", "kb"), ["ka", "kb"], "left_semi")
    told = told.groupBy("x").agg(F.collect_set("y").alias("told"))
    parts = F.ceil(F.col("count") / TASK_MEMBERS).cast("int").alias("parts")
    left = alike.join(size.select(F.col("kind").alias("kb"), parts), "kb")
    left = left.join(member.select(F.col("kind").alias("ka"), F.col("id").alias("x")).join(told, "x", "left"), "ka")
    left = left.withColumn("part", F.pmod(F.xxhash64("x"), F.col("parts")).cast("int"))
    right = member.join(size.select("kind", parts), "kind").select(F.col("kind").alias("kb"), F.col("id").alias("y"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    pairs = left.join(right, ["kb", "part"]).where("ka <> kb or x < y").where("told is null or not array_contains(told, y)")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")


def orphans(memory: DataFrame, edge: DataFrame, about: DataFrame) -> DataFrame:
    """Live memories, artifacts aside, that nothing is linked to."""
    ends = edge.select(F.col("src").alias("id")).union(edge.select("dst")).union(about.select("memory_id"))
    return live(memory).where("layer <> 'artifact'").join(ends, "id", "left_anti").select("id", "layer")


def symbol_map(symbol: DataFrame, calls: DataFrame, about: DataFrame, memory: DataFrame, prefix: str = "", inherits: DataFrame | None = None) -> DataFrame:
    """Files and symbols under a prefix with what they call, who calls them, what they
    inherit and their memories."""
    inside = symbol.where(F.col("file_path").startswith(prefix))
    names = symbol.select("id", "name")
    to = calls.join(names.withColumnRenamed("id", "dst").withColumnRenamed("name", "n"), "dst").groupBy(F.col("src").alias("id"))
    by = calls.join(names.withColumnRenamed("id", "src").withColumnRenamed("name", "n"), "src").groupBy(F.col("dst").alias("id"))
    mem = about.join(live(memory).select(F.col("id").alias("memory_id")), "memory_id").groupBy(F.col("symbol_id").alias("id"))
    out = inside.join(to.agg(F.collect_set("n").alias("calls")), "id", "left")
    out = out.join(by.agg(F.collect_set("n").alias("called_by")), "id", "left")
    out = out.join(mem.agg(F.collect_set("memory_id").alias("memories")), "id", "left")
    lists = ["calls", "called_by", "memories"]
    if inherits is not None:
        base = inherits.join(names.withColumnRenamed("id", "dst").withColumnRenamed("name", "n"), "dst").groupBy(F.col("src").alias("id"))
        out, lists = out.join(base.agg(F.collect_set("n").alias("inherits")), "id", "left"), [*lists, "inherits"]
    empty = F.array().cast("array<string>")
    return out.select("file_path", "id", "name", "kind", *[F.array_sort(F.coalesce(c, empty)).alias(c) for c in lists])


def import_map(imports: DataFrame, prefix: str = "") -> DataFrame:
    """(src_path, dst_path, module): imports with either end under a prefix."""
    return imports.where(F.col("src_path").startswith(prefix) | F.col("dst_path").startswith(prefix)).select("src_path", "dst_path", "module").distinct()


def map_counts(symbol: DataFrame, calls: DataFrame, prefix: str) -> DataFrame:
    """Files, symbols, calls in view and calls that cross the prefix."""
    inside = F.col("file_path").startswith(prefix)
    ends = symbol.select("id", inside.alias("inside"))
    both = calls.join(ends.select(F.col("id").alias("src"), F.col("inside").alias("a")), "src").join(ends.select(F.col("id").alias("dst"), F.col("inside").alias("b")), "dst")
    edges = both.agg(F.coalesce(F.sum((F.col("a") | F.col("b")).cast("long")), F.lit(0)).alias("calls"), F.coalesce(F.sum((F.col("a") != F.col("b")).cast("long")), F.lit(0)).alias("crossing"))
    seen = symbol.where(inside).agg(F.countDistinct("file_path").alias("files"), F.countDistinct("id").alias("symbols"))
    return seen.crossJoin(edges)  # one row each


def call_impact(symbol: DataFrame, calls: DataFrame, files: DataFrame) -> DataFrame:
    """(file_path, caller): symbols outside of a file that call into it."""
    owned = symbol.join(files, "file_path").select("file_path", F.col("id").alias("dst"))
    own = symbol.select(F.col("id").alias("src"), F.col("file_path").alias("from_file"))
    return owned.join(calls, "dst").join(own, "src").where("from_file <> file_path").select("file_path", F.col("src").alias("caller")).distinct()


def changes(memory: DataFrame, edge: DataFrame, symbol: DataFrame, calls: DataFrame, about: DataFrame, files: DataFrame, per_file: int = 5) -> DataFrame:
    """What is recorded about changed files, and about what calls into them.

    Artifacts are shown only where a file has nothing better; a memory is
    contested if a live CONTRADICTS edge touches it.
    """
    m = live(memory).join(files, "file_path")
    judged = m.withColumn("better", F.max((F.col("layer") != "artifact").cast("int")).over(Window.partitionBy("file_path")))
    visible = judged.where((F.col("layer") != "artifact") | (F.col("better") == 0))
    conflict = declared_conflicts(edge, memory)
    touched = conflict.select(F.col("src").alias("id")).union(conflict.select("dst")).distinct().withColumn("contested", F.lit(True))
    order = Window.partitionBy("file_path").orderBy(*anchored_order())
    own = visible.withColumn("k", F.row_number().over(order)).withColumn("seen", F.count("*").over(Window.partitionBy("file_path")))
    own = own.where(F.col("k") <= per_file).select("file_path", "id", "layer", "k", (F.col("seen") - F.least("seen", F.lit(per_file))).alias("omitted"), F.lit("anchored").alias("via"))
    reached = call_impact(symbol, calls, files).join(about.select(F.col("symbol_id").alias("caller"), F.col("memory_id").alias("id")), "caller")
    reached = reached.select("file_path", "id").distinct().join(live(memory).where("layer <> 'artifact'").select("id", "layer", "importance"), "id")
    reached = reached.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_file)
    reached = reached.select("file_path", "id", "layer", "k", F.lit(0).cast("long").alias("omitted"), F.lit("calls").alias("via"))
    out = own.unionByName(reached).join(touched, "id", "left")
    return out.select("file_path", "via", "k", "id", "layer", "omitted", F.coalesce("contested", F.lit(False)).alias("contested"))


def coverage(changed: DataFrame, files: DataFrame) -> DataFrame:
    """(file_path, covered, contested): whether anything is recorded about each changed
    file (rows of ``changes``), and how many anchored memories shown for it are contested."""
    anchored = (F.col("via") == "anchored") & F.col("contested")
    per = changed.groupBy("file_path").agg(F.count_if(anchored).alias("contested"))
    out = files.select("file_path").distinct().join(per.withColumn("covered", F.lit(True)), "file_path", "left")
    return out.select("file_path", F.coalesce("covered", F.lit(False)).alias("covered"), F.coalesce("contested", F.lit(0)).alias("contested"))


def viewer_omitted(memory: DataFrame, symbol: DataFrame, shown: DataFrame) -> DataFrame:
    """(kind, omitted): what a viewer's budget left out, by kind."""
    m = live(memory).select("id", F.when(F.col("layer") == "artifact", "chunks").otherwise("recorded memories").alias("kind"))
    every = m.unionByName(symbol.select("id", F.lit("declarations").alias("kind")))
    left = every.join(shown.select("id", F.lit(1).alias("seen")), "id", "left")
    return left.groupBy("kind").agg(F.count_if(F.col("seen").isNull()).alias("omitted"))


def viewer_nodes(memory: DataFrame, symbol: DataFrame, calls: DataFrame, about: DataFrame, budget: int = 3000) -> DataFrame:
    """Nodes of the viewer under a budget: judged memories, then symbols by degree, then artifacts."""
    ends = calls.select(F.col("src").alias("id")).union(calls.select("dst")).union(about.select("symbol_id"))
    degree = ends.groupBy("id").agg(F.count("*").alias("degree"))
    sym = symbol.join(degree, "id", "left").select("id", F.lit("symbol").alias("kind"), F.lit(1).alias("tier"), F.coalesce("degree", F.lit(0)).cast("double").alias("w"))
    mem = live(memory).select("id", F.lit("memory").alias("kind"), F.when(F.col("layer") == "artifact", 2).otherwise(0).alias("tier"), F.col("importance").alias("w"))
    return sym.unionByName(mem).orderBy("tier", F.desc("w"), "id").limit(budget)


def anchored(memory: DataFrame, path: str) -> DataFrame:
    return about_path(memory, path).orderBy(*anchored_order())
