"""More of the catalogue: scans, mutations, scalar functions and reports."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from mnemospark.functions import scalars as sc
from mnemospark.functions.text import fold, term_rows
from mnemospark.operators import code, evaluation, graph, index, mutations, retrieval
from mnemospark.plans.catalogue import _ALL, _LIVE, OPTIONS, _page, docs, query, r6, tables
from mnemospark.plans.oracle import POSTINGS, SEARCH, _fold, branches, decay, oracle, terms, top
from mnemospark.plans.views import NOW, view
from mnemospark.shipping import ship
from mnemospark.sources import files as src
from mnemospark.storage import stored

# ---------------------------------------------------------------- scans and predicates


@query("live_nodes", oracle("memory", "select id, layer from memory where superseded_at is null"))
def live_nodes(spark, d):
    return retrieval.live(view(spark, d, "memory")).select("id", "layer")


@query("layer_filter", oracle("memory", "select id from memory where superseded_at is null and layer in ('semantic', 'procedural')"))
def layer_filter(spark, d):
    return retrieval.live(view(spark, d, "memory"), ("semantic", "procedural")).select("id")


@query("node_summaries", oracle("memory query", "select m.id, layer, importance, created_at, coalesce(superseded_at, 0) as superseded_at from memory m where doc_id in (select query_id from query)"))
def node_summaries(spark, d):
    m, wanted = view(spark, d, "memory"), view(spark, d, "query").select(F.col("query_id").alias("doc_id"))
    m = m.withColumn("superseded_at", F.coalesce("superseded_at", F.lit(0)))
    return m.select("id", "layer", "importance", "created_at", "superseded_at", "doc_id").join(wanted, "doc_id", "left_semi").drop("doc_id")


@query("path_anchor", oracle("memory", "select id from memory where superseded_at is null and (file_path = 'src5/doc_5.md' or file_path like '%/src5/doc_5.md' or starts_with(source_ref, 'src5/doc_5.md#') or contains(source_ref, '/src5/doc_5.md'))"))
def path_anchor(spark, d):
    return retrieval.about_path(view(spark, d, "memory"), "src5\\doc_5.md").select("id")


@query("prefix_files", oracle("symbol", "select id, name from symbol where starts_with(file_path, 'src7/')"))
def prefix_files(spark, d):
    return view(spark, d, "symbol").where(F.col("file_path").startswith("src7/")).select("id", "name")


@query("symbols_named", oracle("symbol", "select s.id, s.name from symbol s where lower(s.name) in (select lower(name) from symbol where doc_id % 50 = 0)"))
def symbols_named(spark, d):
    s = view(spark, d, "symbol")
    wanted = s.where("doc_id % 50 = 0").select(F.lower("name").alias("n")).distinct()
    return s.withColumn("n", F.lower("name")).join(wanted, "n", "left_semi").select("id", "name")


@query("stale_flags", oracle("memory", f"select id, ({NOW} - created_at) > {180 * sc.DAY_MS} as stale from memory"))
def stale_flags(spark, d):
    return view(spark, d, "memory").select("id", ((F.lit(NOW) - F.col("created_at")) > 180 * sc.DAY_MS).alias("stale"))


@query("edges_either_end", oracle("edge", "select distinct src, type, dst from edge where src in (select src from edge where type = 'RESOLVES') or dst in (select src from edge where type = 'RESOLVES')"))
def edges_either_end(spark, d):
    e = view(spark, d, "edge")
    s = e.where("type = 'RESOLVES'").select("src").distinct()
    out = e.join(s, "src", "left_semi").select("src", "type", "dst")
    back = e.join(s.withColumnRenamed("src", "dst"), "dst", "left_semi").select("src", "type", "dst")
    return out.union(back).distinct()


@query("visible_reasoning", oracle("memory", _LIVE, """select id, grp, layer from (select id, split_part(source_ref, '/', 1) as grp, layer,
    max((layer <> 'artifact')::int) over (partition by split_part(source_ref, '/', 1)) as better from alive) x where layer <> 'artifact' or better = 0"""))  # fmt: skip
def visible_reasoning(spark, d):
    m = retrieval.live(view(spark, d, "memory")).withColumn("grp", F.split_part("source_ref", F.lit("/"), F.lit(1)))
    better = F.max((F.col("layer") != "artifact").cast("int")).over(Window.partitionBy("grp"))
    return m.withColumn("better", better).where("layer <> 'artifact' or better = 0").select("id", "grp", "layer")


_SKIP = """select path, case when regexp_matches(path, '(^|/)(node_modules|vendor|dist)/') then 'skipped folder'
 when regexp_matches(path, '[.](svg|csv)$') then 'only when named' when regexp_matches(path, '[.](png|pdf)$') then 'binary'
 when regexp_matches(path, '[.](lock|log)$') then 'secret or bookkeeping' when doc_id % 13 = 0 then 'not text' when n > 5000 then 'too large' end as reason
from (select source || (case doc_id % 5 when 0 then '/vendor' when 1 then '/dist' else '' end) || '/doc_' || doc_id ||
 (case doc_id % 7 when 0 then '.md' when 1 then '.svg' when 2 then '.png' when 3 then '.lock' when 4 then '.csv' else '.py' end) as path, octet_length(encode(text)) + (doc_id % 13 = 0)::int as n, doc_id from documents) f"""


def _policy(spark, d):
    folder = F.when(F.col("doc_id") % 5 == 0, "/vendor").when(F.col("doc_id") % 5 == 1, "/dist").otherwise("")
    ending = F.lit(".py")
    for k, e in enumerate((".md", ".svg", ".png", ".lock", ".csv")):
        ending = F.when(F.col("doc_id") % 7 == k, e).otherwise(ending)
    text = F.encode("text", "UTF-8")  # of every 13th, with a zero byte inside
    raw = F.when(F.col("doc_id") % 13 == 0, F.concat(F.substring(text, 1, F.lit(7)), F.lit(b"\0"), F.substring(text, 8, F.lit(1 << 30)))).otherwise(text)
    rows = docs(spark, d).select(F.concat("source", folder, F.lit("/doc_"), "doc_id", ending).alias("path"), raw.alias("raw"))
    size = F.octet_length("raw")
    return rows.select("path", size.alias("length"), src.skip_reason(F.col("path"), size, F.col("raw"), [], 5000).alias("reason"))


@query("walk_policy", _SKIP)
def walk_policy(spark, d):
    return _policy(spark, d).select("path", "reason")


@query("skip_report", f"with f as ({_SKIP}) select reason, count(*) as n from f where reason is not null group by reason")
def skip_report(spark, d):
    return src.skip_report(_policy(spark, d)).select("reason", "n")


_RULES = ["# rules", "", "src4/", "doc_?7.md", "src5/**", "!src5/doc_*5.md", "/src6/doc_6*.md", "*.tmp", "!doc_67.md"]


@query("ignore_rules", """select doc_id, case when n = 'doc_67.md' then false when doc_id % 11 = 0 then true when source = 'src6' and starts_with(n, 'doc_6') and ends_with(n, '.md') then true
 when source = 'src5' and ends_with(n, '5.md') then false when source = 'src5' then true when length(n) = 9 and ends_with(n, '7.md') then true else source = 'src4' end as ignored
 from (select doc_id, source, 'doc_' || doc_id || case when doc_id % 11 = 0 then '.tmp' else '.md' end as n from documents) x""")
def ignore_rules(spark, d):
    path = F.concat("source", F.lit("/doc_"), "doc_id", F.when(F.col("doc_id") % 11 == 0, ".tmp").otherwise(".md"))
    return docs(spark, d).select("doc_id", src.ignored(path, _RULES).alias("ignored"))


# ---------------------------------------------------------------- scalar functions


_MARKED = r"marked as (select distinct unnest(regexp_extract_all(text, '[\p{L}]+')) as word from documents)"


@query("folded_terms", oracle("", _MARKED, "w_text as (select word as id, word as text from marked)", terms("w_terms", "w_text"), "select id, term, count(*) as tf from w_terms group by id, term"))
def folded_terms(spark, d):
    words = docs(spark, d).select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("id")).distinct()
    return term_rows(words.withColumn("text", F.col("id")), "id", "text").select("id", "term", "tf")


_UNSPACED = "select doc_id as id, translate(cast(doc_id as string), '0123456789', '記憶層設計決定支付失') as text from documents"


@query("unspaced_terms", f"""select id, term, count(*) as tf from (select id, substr(text, i, 2) as term from (select id, text, unnest(range(1, greatest(length(text), 2))) as i from ({_UNSPACED}) x) y) z group by 1, 2""")
def unspaced_terms(spark, d):
    rows = spark.sql(_UNSPACED.replace("from documents", "from {t}"), t=docs(spark, d))
    return term_rows(rows, "id", "text").select("id", "term", "tf")


@query("container_imports", oracle("symbol", """f as (select distinct file_path as path, 'pkg.c' || (doc_id % 601) as container from symbol), i as (select file_path as from_path, 'pkg.c' || (doc_id * 3 % 601) || '.Type' || (doc_id % 2) as module from symbol)""",
    "select from_path, module, min(path) as path from i join f on starts_with(module, container || '.') group by 1, 2 having count(distinct path) = 1"))
def container_imports(spark, d):
    s = stored(view(spark, d, "symbol"), "symbol")
    files = s.select(F.col("file_path").alias("path"), F.concat(F.lit("pkg.c"), F.col("doc_id") % 601).alias("container")).distinct()
    module = F.concat(F.lit("pkg.c"), F.col("doc_id") * 3 % 601, F.lit(".Type"), F.col("doc_id") % 2)
    return code.resolve_imports(s.select(F.col("file_path").alias("from_path"), module.alias("module")), files)


@query("recency_scores", oracle("memory", f"select id, round(0.5::double * (case when importance = 0 then 1 else importance end) * ({decay()}), 6) as score from memory"))
def recency_scores(spark, d):
    m = view(spark, d, "memory")
    return m.select("id", r6(sc.recency_score(sc.d(0.5), F.col("importance"), sc.decay(F.col("layer"), F.col("created_at"), NOW))).alias("score"))


@query("l2_normalized", oracle("vector", "select id, round(embedding[1] / sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 6) as first from vector"))
def l2_normalized(spark, d):
    return view(spark, d, "vector").select("id", r6(F.get(sc.l2_normalized(F.col("embedding")), F.lit(0))).alias("first"))


@query("pair_keys", oracle("edge", "select src, dst, least(src, dst) || '|' || greatest(src, dst) as pair from edge"))
def pair_keys(spark, d):
    return view(spark, d, "edge").select("src", "dst", sc.pair_key(F.col("src"), F.col("dst")).alias("pair"))


@query("layer_ranks", oracle("memory", "select id, case layer when 'semantic' then 0 when 'procedural' then 1 when 'episodic' then 2 else 3 end as rank, case layer when 'semantic' then 10 when 'procedural' then 7 when 'artifact' then 3 else 2 end as weight from memory"))
def layer_ranks(spark, d):
    return view(spark, d, "memory").select("id", sc.layer_rank(F.col("layer")).alias("rank"), sc.layer_weight(F.col("layer")).alias("weight"))


@query("line_counts", "select doc_id, length(text) - length(replace(text, chr(10), '')) + 1 as lines, cast(ceil(length(text) / 4.0) as bigint) as tokens from documents")
def line_counts(spark, d):
    return docs(spark, d).select("doc_id", sc.line_count(F.col("text")).cast("long").alias("lines"), sc.token_cost(F.col("text")).cast("long").alias("tokens"))


@query("quoted_labels", oracle("memory", r"""select id, left(trim(regexp_replace(regexp_replace(title, '[\[\]{}()"''`<>|]', '', 'g'), '\s+', ' ', 'g')), 60) as label from memory"""))
def quoted_labels(spark, d):
    return view(spark, d, "memory").select("id", sc.quoted_label(F.col("title")).alias("label"))


#: Names of one to five dotted parts.
_DOTTED = "array_to_string(list_slice(['p' || lang, source, 'x' || (doc_id % 3), 'y', 'd' || doc_id], 1, doc_id % 5 + 1), '.')"


def _dotted(spark, d):
    parts = F.array(F.concat(F.lit("p"), "lang"), "source", F.concat(F.lit("x"), (F.col("doc_id") % 3).cast("string")), F.lit("y"), F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    return docs(spark, d).select("doc_id", F.array_join(F.slice(parts, F.lit(1), (F.col("doc_id") % 5 + 1).cast("int")), ".").alias("name"))


@query("container_prefixes", f"""select doc_id, array_to_string(list_transform(range(n, greatest(n - 4, 0), -1), lambda k: array_to_string(p[1:k], '.')), '|') as prefixes
 from (select doc_id, string_split(name, '.') as p, len(string_split(name, '.')) as n from (select doc_id, {_DOTTED} as name from documents) x) y""")
def container_prefixes(spark, d):
    return _dotted(spark, d).select("doc_id", F.array_join(sc.container_prefixes(F.col("name")), "|").alias("prefixes"))


@query("owner_names", f"select doc_id, case when contains(name, '.') then left(name, length(name) - instr(reverse(name), '.')) else '' end as owner from (select doc_id, {_DOTTED} as name from documents) x")
def owner_names(spark, d):
    return _dotted(spark, d).select("doc_id", sc.parent_name(F.col("name")).alias("owner"))


@query("wilson_interval", oracle("memory", """g as (select layer, count(*)::double as n, count(superseded_at)::double as k, 1.959963984540054::double as z from memory group by layer)""",
    """select layer, round(greatest(0, (k / n + z * z / (2 * n) - z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) as low,
    round(least(1, (k / n + z * z / (2 * n) + z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) as high from g"""))  # fmt: skip
def wilson_interval(spark, d):
    g = view(spark, d, "memory").groupBy("layer").agg(F.count("*").cast("double").alias("n"), F.count("superseded_at").cast("double").alias("k"))
    low, high = sc.wilson(F.col("k"), F.col("n"))
    return g.select("layer", r6(low).alias("low"), r6(high).alias("high"))


# ---------------------------------------------------------------- mutations


@query("supersede_nodes", oracle("memory", f"select id, case when superseded_at is null and doc_id % 6 = 0 then {NOW} else coalesce(superseded_at, 0) end as superseded_at from memory"))
def supersede_nodes(spark, d):
    m = view(spark, d, "memory")
    return mutations.supersede(m, m.where("doc_id % 6 = 0"), NOW).select("id", F.coalesce("superseded_at", F.lit(0)).alias("superseded_at"))


@query("posting_flush", oracle("memory", POSTINGS, "select id, term, case when cast(substr(id, 5) as bigint) % 9 = 0 then 2 * tf else tf end as tf from postings"))
def posting_flush(spark, d):
    p = stored(index.build_postings(view(spark, d, "memory")), "postings")
    changed = p.where("cast(substr(id, 5) as bigint) % 9 = 0").withColumn("tf", F.col("tf") * 2)
    return mutations.flush_postings(p, changed).select("id", "term", "tf")


@query("set_embedding", oracle("memory vector", "select m.id, v.id is not null as embedded from memory m left join vector v on v.id = m.id"))
def set_embedding(spark, d):
    m = mutations.set_embeddings(view(spark, d, "memory"), view(spark, d, "vector"), 64)
    return m.select("id", F.col("embedding").isNotNull().alias("embedded"))


@query("insert_absent", oracle("symbol", "select id, name from symbol union select 'new:' || id, name from symbol where doc_id % 8 = 0"))
def insert_absent(spark, d):
    s = view(spark, d, "symbol").select("id", "name")
    new = view(spark, d, "symbol").where("doc_id % 8 = 0").select(F.explode(F.array("id", F.concat(F.lit("new:"), "id"))).alias("id"), "name")
    return mutations.insert_absent(s, new, ["id"])


@query("replace_relations", oracle("symbol", "select id, file_path, kind from symbol where doc_id % 5 <> 0 union all select id, file_path, 'fresh' from symbol where doc_id % 5 = 0"))
def replace_relations(spark, d):
    s = view(spark, d, "symbol").select("id", "file_path", "kind", "doc_id")
    changed = s.where("doc_id % 5 = 0")
    return mutations.replace_relations(s, changed.withColumn("kind", F.lit("fresh")), changed).select("id", "file_path", "kind")


@query("journal_replay", oracle("memory", """select 'mem_' || left(sha256(layer || ' ' || source_ref || ' ' || trim(regexp_replace(body, '[ \t]+', ' ', 'g'), ' ' || chr(10) || chr(9) || chr(13))), 24) as id, layer from memory"""))
def journal_replay(spark, d):
    m = view(spark, d, "memory").withColumn("kind", F.lit("node"))
    return mutations.journal_nodes(m.union(m)).select("id", "layer")  # queued twice, written once


@query("file_stamps_unseen", "select doc_id from documents where doc_id % 4 = 1")
def file_stamps_unseen(spark, d):
    now = docs(spark, d).select("doc_id", F.concat(F.lit("3:"), F.sha2("text", 256)).alias("stamp"))
    return mutations.stale(now, now.where("doc_id % 4 <> 1"), ["doc_id", "stamp"]).select("doc_id")


# ---------------------------------------------------------------- graph and code


@query("symbol_degree", oracle("symbol calls", "select id, count(*) as degree from (select src as id from calls union all select dst from calls) e group by id"))
def symbol_degree(spark, d):
    c = view(spark, d, "calls")
    return c.select(F.col("src").alias("id")).union(c.select("dst")).groupBy("id").agg(F.count("*").alias("degree"))


@query("memories_of_symbols", oracle("memory symbol about", _LIVE, "select s.id as symbol_id, count(a.id) as memories from symbol s left join about b on b.symbol_id = s.id left join alive a on a.id = b.memory_id group by s.id"))
def memories_of_symbols(spark, d):
    mine = view(spark, d, "about").join(retrieval.live(view(spark, d, "memory")).select(F.col("id").alias("memory_id")), "memory_id")
    s = view(spark, d, "symbol").select(F.col("id").alias("symbol_id"))
    return s.join(mine, "symbol_id", "left").groupBy("symbol_id").agg(F.count("memory_id").alias("memories"))


@query("posting_codec", oracle("memory", POSTINGS, "select term, string_agg(id || ':' || tf || ':' || doc_len, ' ' order by id || ':' || tf || ':' || doc_len) as encoded, count(*) as decoded from postings group by term"))
def posting_codec(spark, d):
    """Encoded postings, and how many rows come back from them."""
    coded = stored(index.encode_postings(index.build_postings(view(spark, d, "memory"))), "encoded")
    return coded.join(index.decode_postings(coded).groupBy("term").agg(F.count("*").alias("decoded")), "term")


@query("content_hashes", "select doc_id, sha256(text) as hash, left(sha256(text), 16) as short from documents")
def content_hashes(spark, d):
    return docs(spark, d).select("doc_id", sc.content_hash(F.col("text")).alias("hash"), sc.short_hash(F.col("text")).alias("short"))


_WRITTEN = """select doc_id, case doc_id % 6 when 0 then ' a.b::' || lang || '?' when 1 then source || '<T, U>' when 2 then 'x.' || doc_id when 3 then '$' || source || '-by-id'
 when 4 then left(text, 20) else source || '.' || lang || '!' end as written from documents"""


@query("clean_identifiers", f"""select doc_id, case when regexp_full_match(last, '[A-Za-z_$][A-Za-z0-9_$-]{{0,126}}[?!]?') then last end as name
 from (select doc_id, string_split_regex(regexp_replace(trim(written), '(?s)<.*$', ''), '[.:]')[-1] as last from ({_WRITTEN}) x) y""")
def clean_identifiers(spark, d):
    return spark.sql(_WRITTEN.replace("from documents", "from {t}"), t=docs(spark, d)).select("doc_id", sc.clean_identifier(F.col("written")).alias("name"))


@query("missed_questions", oracle(_ALL, *SEARCH, branches(), _page(10, 0), "refs as (select c.query_id, c.position, m.source_ref as r from cut c join memory m on m.id = c.id)",
    "lost as (select q.query_id from query q left join refs on refs.query_id = q.query_id and refs.position <= 5 group by q.query_id having coalesce(max(contains(r, 'src1/')::int), 0) = 0)",
    "select l.query_id, coalesce(string_agg(r, '|' order by position) filter (position <= 3), '') as got from lost l left join refs on refs.query_id = l.query_id group by 1"))
def missed_questions(spark, d):
    q = view(spark, d, "query")
    hits = stored(retrieval.search(tables(spark, d), q, retrieval.Options(limit=10, now=NOW)).select("query_id", "position", "source_ref"), "hits")
    asked = q.select("query_id", F.array(F.lit("src1/")).alias("expect"), F.array().cast("array<string>").alias("reject"))
    return evaluation.missed(hits, asked).select("query_id", F.array_join("got", "|").alias("got"))


@query("receiver_types", oracle("symbol", "select file_path, name, min(kind) as type from (select split_part(file_path, '/', 1) as file_path, left(name, 2) as name, kind from symbol) x group by 1, 2 having count(distinct kind) = 1"))
def receiver_types(spark, d):
    b = view(spark, d, "symbol").select(F.split_part("file_path", F.lit("/"), F.lit(1)).alias("file_path"), F.left("name", F.lit(2)).alias("name"), F.col("kind").alias("type"))
    return code.receiver_types(b)


@query("visible_containers", "select distinct source as path, 'pkg.' || source as container from documents union select source, 'x.' || lang from documents union select source, 'x' from documents")
def visible_containers(spark, d):
    t = docs(spark, d)
    f = t.select(F.col("source").alias("path"), F.concat(F.lit("pkg."), "source").alias("container")).distinct()
    used = t.select(F.col("source").alias("from_path"), F.concat(F.lit("x."), "lang").alias("module")).distinct()
    return code.visible_containers(f, used)


@query("unique_basenames", oracle("symbol", "select name, min(file_path) as path from (select distinct split_part(file_path, '/', 2) as name, file_path from symbol) x group by name having count(*) = 1"))
def unique_basenames(spark, d):
    f = view(spark, d, "symbol").select(F.element_at(F.split("file_path", "/"), -1).alias("name"), F.col("file_path").alias("path")).distinct()
    return f.groupBy("name").agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n = 1").drop("n")


@query("summary_candidates", oracle("edge", """select near, count(distinct id) as covers from (select src as near, dst as id from edge union select dst, src from edge) x group by near having count(distinct id) >= 2"""))
def summary_candidates(spark, d):
    e = view(spark, d, "edge")
    both = e.select(F.col("src").alias("near"), F.col("dst").alias("id")).union(e.select("dst", "src"))
    return both.groupBy("near").agg(F.countDistinct("id").alias("covers")).where("covers >= 2")


@query("cluster_invariants")
def cluster_invariants(spark, d):
    """Clusters that reach over a component's border: there must be none."""
    m, e = view(spark, d, "memory"), view(spark, d, "edge")
    c = graph.components(e.select("src", "dst"))
    return graph.clusters(e, m).join(c.hint("merge"), "id").groupBy("cluster").agg(F.countDistinct("component").alias("components")).where("components > 1")


@query("top_representatives", oracle("memory", _LIVE, f"select source, id, rank from {top('(select *, split_part(file_path, chr(47), 1) as source from alive) z', 5, 'importance desc, created_at desc, id', '*', 'source')} x"))
def top_representatives(spark, d):
    m = retrieval.live(view(spark, d, "memory")).withColumn("source", F.split_part("file_path", F.lit("/"), F.lit(1)))
    found = index.top(m, 5, F.desc("importance"), F.desc("created_at"), "id", by="source")
    return found.select("source", "id", F.col("rank").cast("long").alias("rank"))


# ---------------------------------------------------------------- retrieval variants


_RELATED = """q as (select * from vector where cast(substr(id, 5) as bigint) % 50 = 0),
ok as (select id from memory where superseded_at is null and layer in ('semantic', 'episodic', 'procedural')),
sims as (select q.id as query_id, v.id, list_cosine_similarity(cast(v.embedding as double[]), cast(q.embedding as double[])) as sim from q join vector v on v.id <> q.id where v.id in (select id from ok)),"""


@query("related_memories", oracle("memory vector", _RELATED.rstrip(",\n"), f"six as {top('sims', 6, 'round(sim, 9) desc, id', 'query_id, id, sim')}", f"select query_id, id, round(sim, 6) as sim from {top('(select query_id, id, sim from six where sim >= 0.05::double) z', 3, 'round(sim, 9) desc, id')} x"))
def related_memories(spark, d):
    v = view(spark, d, "vector")
    q = v.where("cast(substr(id, 5) as bigint) % 50 = 0").withColumnRenamed("id", "query_id")
    return retrieval.related(v, view(spark, d, "memory"), q, least=0.05).select("query_id", "id", r6("sim").alias("sim"))


@query("search_without_graph", oracle(_ALL, *SEARCH, branches(), "select branch, count(*) as n from ranked where branch in ('bm25', 'recency') group by branch"))
def search_without_graph(spark, d):
    o = retrieval.Options(limit=10, now=NOW, disable=frozenset({"graph", "entity"}))
    found = retrieval.branches_of(tables(spark, d), view(spark, d, "query"), o)
    return found.groupBy("branch").agg(F.count("*").alias("n"))


@query("search_semantic_layer", oracle(_ALL, *SEARCH, branches(5, ("semantic",)), _page(5, 0), "select c.query_id, c.position, c.id, m.layer from cut c join memory m on m.id = c.id"))
def search_semantic_layer(spark, d):
    o = retrieval.Options(limit=5, now=NOW, layers=("semantic",))
    return retrieval.search(tables(spark, d), view(spark, d, "query"), o).select("query_id", F.col("position").cast("long").alias("position"), "id", "layer")


@query("evaluation_judged", oracle(_ALL, *SEARCH, branches(), _page(10, 0), "refs as (select c.query_id, m.source_ref as r from cut c join memory m on m.id = c.id where c.position <= 5)",
    "select q.query_id, coalesce(max((contains(r, 'src1/') or contains(r, 'src2/'))::int), 0) as hit, coalesce(max(contains(r, 'src9/')::int), 0) as rejected from query q left join refs on refs.query_id = q.query_id group by q.query_id"))
def evaluation_judged(spark, d):
    q = view(spark, d, "query")
    hits = retrieval.search(tables(spark, d), q, retrieval.Options(limit=10, now=NOW))
    asked = q.select("query_id", F.array(F.lit("src1/"), F.lit("src2/")).alias("expect"), F.array(F.lit("src9/")).alias("reject"))
    return evaluation.judge(hits, asked)


@query("folded_words", oracle("", _MARKED, f"select word, {_fold('word')} as folded from marked"))
def folded_words(spark, d):
    words = docs(spark, d).select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("word")).distinct()
    ship(spark)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fold(w) for w in b.column(0).to_pylist()])], ["word", "folded"])

    return words.mapInArrow(run, "word string, folded string")
