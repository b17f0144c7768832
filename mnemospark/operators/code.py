"""Code graph: anchoring of spans, import resolution and the call cascade, set-based."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from mnemospark.functions.scalars import container_prefixes, parent_name
from mnemospark.storage import stored

#: Endings tried for an imported path, in this order.
IMPORT_ENDINGS = (
    "", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", ".go", ".rb", ".php", ".dart",
    ".kt", ".scala", ".rs", ".swift", ".lua", ".sh", ".ex", ".exs", ".h", ".hpp", ".cs",
    "/index.ts", "/index.js", "/__init__.py", "/mod.rs",
)
#: Kinds of declarations that can be constructed, and that can be called.
TYPE_KIND = "(?i)class|record|struct|interface|enum|type|trait|object|contract|module"
CALLABLE_KIND = "(?i)function|method|constructor|def|macro|command|predicate|init"
RULES = ("type", "file", "receiver", "import", "namespace", "unique")


def span_anchors(memory: DataFrame, symbol: DataFrame) -> DataFrame:
    """(memory_id, symbol_id): declarations that overlap a memory's source span."""
    ref = r"^(.*)#L([0-9]+)(?:-L?([0-9]+))?$"
    spans = memory.where(F.col("source_ref").rlike(ref)).select(
        F.col("id").alias("memory_id"),
        F.regexp_extract("source_ref", ref, 1).alias("file_path"),
        F.regexp_extract("source_ref", ref, 2).cast("long").alias("s"),
        F.regexp_extract("source_ref", ref, 3).alias("last"),
    )
    spans = spans.withColumn("e", F.when(F.col("last") == "", F.col("s")).otherwise(F.col("last").cast("long")))
    near = spans.join(symbol.select("file_path", F.col("id").alias("symbol_id"), "start_line", "end_line"), "file_path")
    return near.where("start_line <= e and end_line >= s").select("memory_id", "symbol_id").distinct()


def chunk_anchors(chunks: DataFrame, symbol: DataFrame) -> DataFrame:
    """(memory_id, symbol_id): declarations that begin inside a chunk's lines.

    chunks: memory_id, file_path, first, last; a declaration that goes on in the next
    chunk belongs to the one that it begins in.
    """
    s = symbol.select("file_path", F.col("id").alias("symbol_id"), "start_line")
    return chunks.join(s, "file_path").where("start_line between first and last").select("memory_id", "symbol_id").distinct()


def enclosing(sites: DataFrame, symbol: DataFrame) -> DataFrame:
    """(site_id, symbol_id): the smallest declaration around each line of a file."""
    s = symbol.select("file_path", F.col("id").alias("symbol_id"), "start_line", "end_line")
    around = sites.select("site_id", "file_path", "line").join(s, "file_path").where("line between start_line and end_line")
    best = F.min_by("symbol_id", F.struct(F.col("end_line") - F.col("start_line"), "start_line", "symbol_id"))
    return around.groupBy("site_id").agg(best.alias("symbol_id"))


def _normal(path: Column) -> Column:
    """Path with "." and ".." steps taken and leading slashes off."""
    steps = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    taken = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda out, s: F.when(
            (s == "..") & (F.size(out) > 0) & (F.coalesce(F.try_element_at(out, F.lit(-1)), F.lit("..")) != ".."),
            F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))),
        ).otherwise(F.concat(out, F.array(s))),
    )
    return F.array_join(taken, "/")


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(from_path, module, path): the file that each import means, if it is known.

    files: path and container.  The written path and its endings are tried in
    order, then a unique file name, then a unique container among the prefixes.
    """
    clean = F.regexp_replace(F.trim("module"), r"""^["'<]|[">']$""", "")
    base = imports.select("from_path", "module", clean.alias("clean")).where("clean <> ''").distinct()
    written = F.get(F.split(F.regexp_replace("clean", "^package:", ""), r"\?"), F.lit(0))
    folder = F.regexp_replace("from_path", r"(^|/)[^/]*$", "")
    joined = _normal(F.concat(folder, F.lit("/"), written))
    w = base.withColumn("w", written).withColumn(
        "bases", F.when(F.col("w").startswith("."), F.array(joined)).otherwise(F.array(F.regexp_replace("w", r"^(\./|/+)", ""), joined))
    )
    bare = F.transform("bases", lambda b: F.array(b, F.regexp_replace(b, r"\.(js|mjs|cjs|jsx)$", "")))
    w = w.where(F.col("w").rlike("[/.]")).withColumn("bases", F.array_distinct(F.flatten(bare)))
    tries = w.select("from_path", "module", F.posexplode("bases").alias("i", "base"))
    # a file knows the few endings that it has, so no import is spelled out with all of them
    ends = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(e).alias("e")) for j, e in enumerate(IMPORT_ENDINGS)])
    cuts = F.transform(F.filter(ends, lambda x: F.endswith("path", x["e"])), lambda x: F.struct(x["j"].alias("j"), F.left("path", F.length("path") - F.length(x["e"])).alias("base")))
    by_path = tries.join(files.select("path").distinct().select("path", F.inline(cuts)), "base")
    names = files.select("path", F.element_at(F.split("path", "/"), -1).alias("name")).groupBy("name")
    names = names.agg(F.min("path").alias("path"), F.count("*").alias("n")).where("n = 1").drop("n")
    by_name = tries.select("from_path", "module", "i", F.lit(len(IMPORT_ENDINGS)).alias("j"), F.element_at(F.split("base", "/"), -1).alias("name"))
    by_name = by_name.where("name <> ''").join(names, "name").select("path", "from_path", "module", "i", "j")
    found = by_path.select("path", "from_path", "module", "i", "j").unionByName(by_name)
    direct = stored(found.groupBy("from_path", "module").agg(F.min_by("path", F.struct("i", "j")).alias("path")), "direct")
    rest = base.join(direct, ["from_path", "module"], "left_anti")
    dotted = F.array_join(F.filter(F.split(F.replace("clean", F.lit("\\"), F.lit(".")), r"\."), lambda x: x != ""), ".")
    prefixes = rest.select("from_path", "module", F.explode(container_prefixes(dotted)).alias("container"))
    # the files of a container are summed up before the imports meet it
    boxes = files.groupBy("container").agg(F.min("path").alias("lo"), F.max("path").alias("hi"))
    boxed = prefixes.join(boxes, "container").groupBy("from_path", "module").agg(F.min("lo").alias("path"), F.max("hi").alias("hi")).where("path = hi")
    return direct.unionByName(boxed.select("from_path", "module", "path"))


def visible_containers(files: DataFrame, imports: DataFrame) -> DataFrame:
    """(path, container): a file's own container and prefixes of what it imports."""
    own = files.where("coalesce(container, '') <> ''").select("path", "container")
    used = imports.select(F.col("from_path").alias("path"), F.explode(container_prefixes(F.col("module"))).alias("container"))
    return own.unionByName(used).distinct()


def receiver_types(bindings: DataFrame) -> DataFrame:
    """(file_path, name, type): names that a file binds to just one type."""
    return bindings.groupBy("file_path", "name").agg(F.countDistinct("type").alias("n"), F.min("type").alias("type")).where("n = 1").drop("n")


def _summed(by: GroupedData) -> DataFrame:
    """What is known of a set of candidates: its least and greatest, and how often one is declared."""
    return by.agg(F.min("dst").alias("lo"), F.max("dst").alias("hi"), F.max("n").alias("n"))


def _merged(by: GroupedData) -> DataFrame:
    """Sets put together; they may overlap, since no candidate counts twice."""
    return by.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("n").alias("n"))


def _alone(sets: DataFrame, keys: tuple[str, ...], rule: str) -> DataFrame:
    """The only candidate of each set that has just one."""
    return sets.where("lo = hi and n = 1").select(*keys, F.col("lo").alias(f"d_{rule}"))


def _through(spots: DataFrame, by_file: DataFrame, uses: DataFrame, packs: DataFrame | None) -> DataFrame:
    """Candidates in the packs (or files) that a spot's file uses, summed up by pack before the spots meet them."""
    by_pack = by_file.withColumnRenamed("dst_file", "pack")
    if packs is not None:
        packed = by_file.join(packs.select("pack", F.col("path").alias("dst_file")), "dst_file")
        by_pack = _merged(packed.groupBy("name", "construction", "pack"))
    met = spots.join(uses.select("file_path", "pack").distinct(), "file_path").join(by_pack, ["name", "construction", "pack"])
    return _merged(met.groupBy("file_path", "name", "construction"))


def resolve_calls(
    calls: DataFrame, symbol: DataFrame, imported: DataFrame | None = None, visible: DataFrame | None = None,
    files: DataFrame | None = None, packs: DataFrame | None = None,
) -> DataFrame:
    """(call_id, dst, confidence, reason) of each call site.

    calls: call_id, src, file_path, name, receiver, receiver_type, construction.
    imported: from_path and path, or, where files are imported many at a time, from_path
    and pack, with the files of each pack in packs (pack, path).
    The first rule that admits exactly one candidate decides.  Candidates are summed up
    by what the rule compares before the calls meet them: no call is joined to all
    declarations of its name.  Recursion makes no edge.
    """
    s = symbol.select(
        F.col("id").alias("dst"), "name", F.col("file_path").alias("dst_file"),
        F.coalesce(F.col("kind").rlike(CALLABLE_KIND), F.lit(False)).alias("can_call"), F.coalesce(F.col("kind").rlike(TYPE_KIND), F.lit(False)).alias("can_make"),
        parent_name(F.substring("id", F.length("file_path") + 9, F.length("id"))).alias("owner"),
    ).where("dst is not null and name is not null")
    # where no declaration of a name is of the wanted kind, all of them are candidates
    some = s.groupBy("name").agg(F.max("can_call").alias("any_call"), F.max("can_make").alias("any_make"))
    ways = F.array(
        F.struct(F.lit(False).alias("construction"), (F.col("can_call") | ~F.col("any_call")).alias("fits")),
        F.struct(F.lit(True).alias("construction"), (F.col("can_make") | ~F.col("any_make")).alias("fits")),
    )
    each = s.join(some, "name").select("name", "dst", "dst_file", "owner", F.inline(ways)).where("fits")
    each = stored(each.groupBy("name", "construction", "dst_file", "owner", "dst").agg(F.count("*").alias("n")), "candidates")
    spot = ("file_path", "name", "construction")
    by_file = _summed(each.groupBy("name", "construction", "dst_file"))
    by_owner = _alone(_summed(each.groupBy("name", "construction", "owner")), ("name", "construction", "owner"), "owner")
    by_name = _summed(each.groupBy("name", "construction")).select("name", "construction", F.expr("if(lo = hi and n = 1, lo, null)").alias("d_unique"), F.lit(True).alias("known"))
    c = calls.withColumn("construction", F.coalesce("construction", F.lit(False)))
    spots = c.select(*spot).distinct()
    beside = {"file": by_file.withColumnRenamed("dst_file", "file_path")}
    if imported is not None:
        beside["import"] = _through(spots, by_file, imported.select(F.col("from_path").alias("file_path"), F.col("path" if packs is None else "pack").alias("pack")), packs)
    if visible is not None and files is not None:
        boxes = files.select(F.col("container").alias("pack"), "path")
        beside["namespace"] = _through(spots, by_file, visible.select(F.col("path").alias("file_path"), F.col("container").alias("pack")), boxes)
    for rule, sets in beside.items():
        c = c.join(_alone(sets, spot, rule), list(spot), "left")
    for rule, given in (("type", "receiver_type"), ("receiver", "receiver")):
        c = c.join(by_owner.withColumnsRenamed({"owner": given, "d_owner": f"d_{rule}"}), ["name", "construction", given], "left")
    c = c.join(by_name, ["name", "construction"], "left")
    decided = F.coalesce(
        *[
            F.when(F.col(f"d_{r}").isNotNull(), F.struct(F.col(f"d_{r}").alias("dst"), F.lit("import" if r == "namespace" else r).alias("confidence")))
            for r in RULES
            if f"d_{r}" in c.columns
        ]
    )
    out = c.withColumn("d", decided)
    reason = F.when(F.col("d").isNotNull(), None).when(F.col("known").isNull(), "external").otherwise("ambiguous")
    return out.select("call_id", "src", F.col("d.dst").alias("dst"), F.col("d.confidence").alias("confidence"), reason.alias("reason")).where(
        "dst is null or dst <> src"
    )


def relation_report(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy(F.coalesce("confidence", "reason").alias("outcome")).agg(F.count("*").alias("n"))


def reach_percent(resolved: DataFrame) -> DataFrame:
    """Resolved calls per hundred that could have been; 100 when there are none."""
    ok, lost = F.count_if(F.col("dst").isNotNull()), F.count_if(F.col("reason") == "ambiguous")
    return resolved.agg(F.when(ok + lost == 0, 100.0).otherwise(100.0 * ok / (ok + lost)).alias("reach"))
