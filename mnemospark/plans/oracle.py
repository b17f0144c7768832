"""DuckDB text for the query catalogue: common table expressions, put together by name."""

from __future__ import annotations

from mnemospark.functions.text import FOLDED_LETTERS, STOP_WORDS
from mnemospark.plans.views import NOW, VIEWS

_STOP = ", ".join(f"'{w}'" for w in sorted(STOP_WORDS))


def _fold(x: str) -> str:
    for a, b in FOLDED_LETTERS.items():
        x = f"replace({x}, '{a}', '{b}')"
    return f"strip_accents({x})"


def stem(w: str) -> str:
    one = f"case when length({w}) > 3 and {w} like '%s' and {w} not like '%us' then left({w}, length({w}) - 1) else {w} end"
    bare = (
        f"case when length({one}) > 5 and ({one}) like '%ing' then left({one}, length({one}) - 3) "
        f"when length({one}) > 4 and ({one}) like '%ed' then left({one}, length({one}) - 2) else {one} end"
    )
    return (
        f"case when length({w}) > 4 and {w} like '%ies' then left({w}, length({w}) - 3) || 'y' "
        f"when length({w}) > 4 and {w} like '%sses' then left({w}, length({w}) - 2) "
        f"when length({w}) > 3 and {w} like '%ss' then {w} else {bare} end"
    )


def split(w: str) -> str:
    spaced = rf"regexp_replace({w}, '([\p{{Ll}}\p{{N}}])(\p{{Lu}})', '\1 \2', 'g')"
    return rf"list_filter(string_split_regex(lower(replace({spaced}, '_', ' ')), '\s+'), lambda x: x <> '')"


def terms(name: str, source: str, key: str = "id") -> str:
    """CTEs name_w and name: the terms (with repeats) of source(key, text)."""
    return rf"""
{name}_r as (select {key}, unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+')) as raw from {source}),
{name}_w as (select {key}, raw, {_fold('raw')} as bare, regexp_matches(raw, '^[\x00-\x7f]*$') as english from {name}_r),
{name}_p as (select *, {split('bare')} as parts from {name}_w),
{name} as (
  select {key}, lower(bare) as term from {name}_p where len(parts) > 1
  union all
  select {key}, case when english then {stem('part')} else part end from (select {key}, english, unnest(parts) as part from {name}_p) x
  where length(part) > 1 and not (english and part in ({_STOP}))
  union all
  select {key}, lower(raw) from {name}_p where not english and length(lower(raw)) > 1 and lower(raw) <> lower(bare)
)"""


POSTINGS = (
    "m_text as (select id, concat_ws(chr(10), title, body) as text from memory), "
    + terms("m_terms", "m_text")
    + """, m_len as (select id, count(*) as doc_len from m_terms group by id),
postings as (select t.id, term, count(*) as tf, max(doc_len) as doc_len from m_terms t join m_len l on l.id = t.id group by t.id, term)"""
)
QTERMS = (
    "q_text as (select query_id as id, q as text from query), "
    + terms("q_terms", "q_text")
    + ", qterm as (select distinct id as query_id, term from q_terms)"
)
MATCHED = """
stat as (select count(*) as n, avg(doc_len) as a from m_len),
dfs as (select term, count(*) as df from postings group by term),
matched as (
  select query_id, p.id, count(*) as overlap,
    sum(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * (tf * 2.2::double) / (tf + 1.2::double * (0.25::double + 0.75::double * doc_len / a))) as score
  from postings p join qterm q on q.term = p.term join dfs d on d.term = p.term cross join stat group by query_id, p.id
)"""


def decay(alias: str = "") -> str:
    age = f"greatest(0::double, ({NOW} - {alias}created_at) / 86400000::double)"
    half = f"case {alias}layer when 'procedural' then 180::double when 'artifact' then 365::double when 'episodic' then 30::double else 90::double end"
    return f"case when {alias}layer = 'semantic' then 1::double else pow(0.5::double, {age} / {half}) end"


def top(source: str, most: int, order: str, columns: str = "*", by: str = "query_id") -> str:
    return f"(select * from (select {columns}, row_number() over (partition by {by} order by {order}) as rank from {source}) r where rank <= {most})"


SEMANTIC = """vq as (select q.query_id, v.embedding as qv from query q join vector v on v.id = 'doc_' || lpad(cast(q.query_id as varchar), 8, '0')),
vs as (select query_id, v.id, list_cosine_similarity(cast(v.embedding as double[]), cast(qv as double[])) as sim from vq, vector v where v.id in (select id from eligible))"""


def branches(limit: int = 10, layers: tuple[str, ...] = (), semantic: bool = False) -> str:
    """CTEs of the branches and ``ranked``, their union."""
    layer = f" and layer in ({', '.join(repr(x) for x in layers)})" if layers else ""
    near = f"{SEMANTIC},\nb2 as {top('vs', 3 * limit, 'round(sim, 9) desc, id')},\n" if semantic else ""
    also = "union all select query_id, 'semantic', id, rank from b2 where 1 - sim <= 0.75::double" if semantic else ""
    recent = f"(overlap / n_terms::double) * (case when importance = 0 then 1 else importance end) * ({decay('e.')})"
    seeds = max(3, -(-limit // 2))
    return f"""
eligible as (select id, layer, importance, created_at from memory where superseded_at is null{layer}),
{near}b1 as {top('matched', 6 * limit, 'round(score, 9) desc, id')},
b1e as {top('(select b1.query_id, b1.id, b1.rank as r from b1 join eligible e on e.id = b1.id) z', 3 * limit, 'r', 'query_id, id')},
o1 as {top('matched', 6 * limit, 'overlap desc, id', 'query_id, id, overlap')},
nt as (select query_id, count(*) as n_terms from qterm group by query_id),
rec as (select o1.query_id, o1.id, {recent} as recent from o1 join eligible e on e.id = o1.id join nt on nt.query_id = o1.query_id),
b3 as {top('rec', 3 * limit, 'round(recent, 9) desc, id', 'query_id, id')},
named as (select distinct query_id, s.id as symbol_id from symbol s join qterm q on lower(s.name) = q.term),
mem as (select a.symbol_id, e.* from about a join eligible e on e.id = a.memory_id),
dir as {top('(select distinct query_id, m.id, importance, created_at from named n join mem m on m.symbol_id = n.symbol_id) z', 2 * limit, 'importance desc, created_at desc, id')},
steps as (select src, dst from calls union all select dst, src from calls),
beside as (select distinct query_id, dst as symbol_id from named n join steps s on s.src = n.symbol_id
  except select query_id, symbol_id from named),
rea as {top('(select distinct query_id, m.id, importance, created_at from beside n join mem m on m.symbol_id = n.symbol_id) z', limit, 'importance desc, created_at desc, id')},
b4 as {top("(select query_id, id, 0 as hop, rank as r from dir union all select query_id, id, 1, rank from rea where (query_id, id) not in (select query_id, id from dir)) z", 3 * limit, 'hop, r', 'query_id, id')},
ranked4 as (
  select query_id, 'bm25' as branch, id, rank from b1e union all select query_id, 'recency', id, rank from b3
  union all select query_id, 'entity', id, rank from b4 {also}
),
seeds as (select distinct query_id, id from ranked4 where rank <= {seeds}),
ways as (select src, dst from (select distinct src, type, dst from edge) e union all select dst, src from (select distinct src, type, dst from edge) e),
reach as (select s.query_id, w.dst as id, count(*) as reach from seeds s join ways w on w.src = s.id
  where (s.query_id, w.dst) not in (select query_id, id from seeds) group by 1, 2),
b5 as {top('(select r.* from reach r join eligible e on e.id = r.id) z', 2 * limit, 'reach desc, id', 'query_id, id')},
ranked as (select * from ranked4 union all select query_id, 'graph', id, rank from b5),
fused as (select query_id, id, sum(1::double / (60 + rank)) as score, count(*) as n_branches from ranked group by query_id, id)"""


SEARCH = [POSTINGS, QTERMS, MATCHED]


def oracle(views: str, *parts: str) -> str:
    """views: names of VIEWS; parts: CTE texts, then the final select."""
    ctes = [f"{v} as ({VIEWS[v]})" for v in views.split()]
    return "with recursive " + ",\n".join([*ctes, *parts[:-1]]) + "\n" + parts[-1]
