"""Each training-data operator against a brute-force version, and on odd input."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemospark.llm import (
    brown_lm,
    decontamination,
    html_extraction,
    language_id,
    licenses,
    mixing,
    near_dedup,
    quality_rules,
    substrings,
    toxicity,
)

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    rng = random.Random(5)
    passage = sentence(rng, 60, 5000)
    long = sentence(rng, 30_000, 2000)
    rows = [
        (1, None, "en", "a", 0),
        (2, "", None, "a", None),
        (3, " \t\n", "en", None, 3),
        (None, passage + " tail", "en", "b", 9),
        (4, passage, "en", "b", 9),
        (5, "head " + passage + " end", "fr", "b", 9),
        (6, passage, "en", None, 9),
        (7, long, "en", "c", 9),
        (8, "x", "de", "", 1),
        (9, "the the the the", "en", "a", 15),
        (9, "the the the the", "en", "a", 15),
        (10, "ünïcode 日本語 \U0001f600 Straße", None, None, None),
    ]
    for i in range(11, 25):
        rows.append((i, sentence(rng, 80, 300), rng.choice(["en", "fr"]), rng.choice("abc"), 1))
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)
    # names that the operators use inside
    for name in ("spans", "n_words", "key", "id", "_row", "kept", "size", "bucket", "digest", "set", "n", "word", "host"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---------------------------------------------------------------- 1 mixing


def water_fill(sizes: dict[str, int]) -> dict[str, float]:
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    left, total, out = set(names), float(sum(sizes.values())), {}
    while left:
        share = total / sum(weight[s] for s in left)
        over = [s for s in left if share * weight[s] > 3 * sizes[s]]
        if not over:
            return out | {s: share * weight[s] for s in left}
        for s in over:
            out[s] = 3.0 * sizes[s]
            total -= out[s]
            left.remove(s)
    return out


def test_mix_meets_targets(odd):
    got = mixing.mix(odd).toPandas()
    rows = odd_rows()
    sizes = Counter()
    for _, text, _, source, _ in rows:
        sizes[source] += len(WORDS.findall(text or ""))
    want = water_fill(dict(sizes))
    assert len(got) == len(rows)
    for source, part in got.groupby("source", dropna=False):
        key = None if source != source or source is None else source
        assert part["source_size"].iloc[0] == sizes[key]
        assert part["target"].iloc[0] == pytest.approx(want[key])
        assert abs(part["taken"].sum() - want[key]) <= 1
    assert (got["taken"] <= 3 * got["size"]).all()
    again = mixing.mix(odd.repartition(2)).toPandas()
    keys = ["doc_id", "size", "taken"]
    assert sorted(map(str, got[keys].values.tolist())) == sorted(map(str, again[keys].values.tolist()))


def test_mix_takes_whole_epochs_first(spark):
    docs = spark.createDataFrame([(i, "a b c d", "x" if i < 2 else "y") for i in range(40)], "doc_id long, text string, source string")
    got = mixing.mix(docs).toPandas()
    small = got[got["source"] == "x"]
    assert (small["epochs"] == 3).all() and (small["taken"] == 12).all()


def test_mix_takes_in_the_order_of_keys(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_A_BUCKET", 7)
    rng = random.Random(6)
    rows = [(i, sentence(rng, rng.randrange(0, 40)) + "." * rng.randrange(0, 60), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(300)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by_source: dict = {}
    for r in got:
        by_source.setdefault(r.source, []).append(r)
    for docs in by_source.values():
        total = sum(r.size for r in docs)
        epochs, left = divmod(round(docs[0].target), total)
        for r in sorted(docs, key=lambda r: (r.key, r.doc_id, r.size)):
            part = min(r.size, left)
            assert r.taken == epochs * r.size + part and r.source_size == total
            left -= part


def test_mix_of_nothing(empty):
    assert mixing.mix(empty).count() == 0


# ---------------------------------------------------------------- 2 pages


PAGES = [
    ("<html><body><nav><a>menu</a></nav><article><h1>Title</h1><p>One&amp;two <b>bo</b>ld.<p>Three</article><footer>f</footer>", "Title One&two bold. Three"),
    ("<div class='cookie-notice'>We use</div><main><p>Text<br>here</p><section id='comments'>bad</section></main>", "Text here"),
    ("<p>a<script>if (a<b) '</p>'</script> b<style>p{}</style></p><form>f</form><aside>x</aside>", "a b"),
    ("<p>un <!-- hidden --> closed", "un closed"),
    ("<div class='wrap with-sidebar'><div class='siteMenu'>m</div><p data-class='menu'>kept</p><p hidden>no</p></div>", "kept"),
    ("<article class='social'><p>x</p><article class='comment'>no</article></article>", "x"),
    ("1 < 2 & 3", "1 < 2 & 3"),
    ("", ""),
    (None, ""),
    ("<script>never ends", ""),
    ('<p>a <a title="oops>x</a> b</p>', "a x b"),
    ("<p don't>a <a title='x>y'>b</a></p><p>c", "a b c"),
    ('<p>a <a title="', "a"),
]


@pytest.mark.parametrize("html, want", PAGES)
def test_main_text(html, want):
    assert html_extraction.main_text(html) == want


def test_style_tree_cuts_what_repeats(spark):
    rng = random.Random(1)
    rows = [(i, "http://h.example/x", f"<div class='top'>Same old banner text</div><div class='body'><p>{sentence(rng, 30)}</p></div>") for i in range(12)]
    rows += [(100, None, None), (101, "http://other.example/", "<p>alone</p>"), (101, "http://other.example/", "<p>alone</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in html_extraction.extract(pages).collect()}
    for i, _, html in rows[:12]:
        assert got[i].text == re.search("<p>(.*)</p>", html)[1]
        assert got[i].n_chars == len(got[i].text)
    assert got[100].text == "" and got[100].n_chars == 0 and got[101].text == "alone"
    assert html_extraction.extract(pages.limit(0)).count() == 0


def test_importance_decides_inside_and_outside_of_articles(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for i in range(12):
        one, two, card = (sentence(rng, 20) for _ in range(3))
        inside = f"<article><div class='box'>Same old box</div><p>{one}</p><p>Same old words</p><p>{two}</p></article>"
        teaser = f"<div class='story'><p>{one}</p></div><article class='card'><p>{card}</p></article><div class='top'>Same old words</div>"
        rows += [(i, "http://in.example/x", inside), (100 + i, "http://out.example/x", teaser)]
        want |= {i: f"{one} {two}", 100 + i: f"{one} {card}"}
    # one page of many repeated parts and a part of its own: the parent is repeated on the whole, not the part
    for i in range(12):
        own = sentence(rng, 20)
        rest = "".join(f"<div class='k{j}'>Same {j}</div>" for j in range(30))
        rows.append((200 + i, "http://many.example/x", f"<div class='all'>{rest}<p>{own}</p></div>"))
        want[200 + i] = own
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_extraction.extract(pages).collect()} == want


def brute_low(pages):
    """Low branches and contents of each host, from the definitions of the style tree."""
    hosts: dict[str, list] = {}
    for host, html in pages:
        hosts.setdefault(host, []).append(html)
    out = {}
    for host, htmls in hosts.items():
        m = len(htmls) + html_extraction.UNSEEN
        nodes: dict[tuple[str, str], Counter] = {}
        for html in htmls:
            styles = Counter()
            seen = {(b.path, "content", b.digest) for b in html_extraction.blocks_of(html, styles)}
            for path, kind, value in seen | {(path, "style", children) for path, children in styles}:
                nodes.setdefault((path, kind), Counter())[value] += 1
        importance = {}
        for (path, kind), n in nodes.items():
            total = sum(n.values())
            if kind == "style":
                value = -sum(c / total * math.log(c / total) for c in n.values()) / math.log(m)
            else:
                value = 1 - sum(map(math.log, n.values())) / len(n) / math.log(m)
            importance[path, kind] = (max(0.0, value), total)

        def of(branch, kind, importance=importance):
            below = [v for (p, k), v in importance.items() if k == kind and (p == branch or p.startswith(branch + "/"))]
            return sum(v * n for v, n in below) / sum(n for _, n in below) if below else None

        def raised(path):
            return 2.0 if re.search(r"(^|/)(article|main)(\.|/|$)", path) else 1.0

        steps = [p.split("/") for p, _ in nodes if p]
        branches = {"/".join(x[:d]) for x in steps for d in range(1, len(x) + 1)}
        text = {b for b in branches if of(b, "content") is not None}
        important = {b for b in text if (0.1 * (of(b, "style") or 0.0) + 0.9 * of(b, "content")) * raised(b) >= 0.2}
        low = {b for b in text if not any(x == b or x.startswith(b + "/") for x in important)}
        for (path, kind), n in nodes.items():
            if kind == "content":
                low |= {f"{path}\n{v}" for v, c in n.items() if 0.9 * (1 - math.log(c) / math.log(m)) * raised(path) < 0.2}
        if low:
            out[host] = low
    return out


def tree_pages():
    rng = random.Random(4)
    rows = []
    for host, size in (("a.example", 14), ("b.example", 6), ("c.example", 3), ("d.example", 1)):
        for i in range(size):
            article = ("article", "div", "main")[i % 3 if host == "a.example" else 1]
            same = "".join(f"<li class='l{j}'>Entry {j}</li>" for j in range(rng.randrange(3, 6)))
            own = "".join(f"<p>{sentence(rng, 12)}</p>" for _ in range(rng.randrange(1, 4)))
            html = f"<div class='t'><ul>{same}</ul></div><{article}>{own}<p>All rights with us</p></{article}><div>{rng.choice('xyz')}</div>"
            rows.append((len(rows), f"https://{host}/p{i}", html))
    return rows


def test_low_branches_equal_brute_force(spark):
    rows = tree_pages()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.host: set(r.low) for r in html_extraction.low_branches(pages).collect()}
    want = brute_low([(url.split("/")[2], html) for _, url, html in rows])
    assert got == want and "a.example" in want and "d.example" not in want
    # the tree changes texts of pages with a declared article and of pages without
    texts = {r.page_id: r.text for r in html_extraction.extract(pages).collect()}
    changed = {i for i, _, html in rows if texts[i] != html_extraction.main_text(html)}
    assert changed >= {i for i, *_ in rows[:14]} and all(w in texts[0] for w in re.findall("w[0-9]+", rows[0][2]))


def test_extraction_of_odd_and_deep_pages(spark):
    deep = "<div>" * 20_000 + "deep <b>text</b>" + "</div>" * 20_000
    rows = [(1, None, "<p>x</p>", "c"), (1, None, "<p>x</p>", "c"), (None, "", None, None), (2, "no url", deep, None), (3, "http://h/", "\U0001f600&amp;", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string").withColumn("text", F.lit("clash")).withColumn("low", F.lit(1))
    got = Counter((r.page_id, r.url, r.text, r.n_chars) for r in html_extraction.extract(pages).collect())
    assert got == Counter([(1, None, "x", 1), (1, None, "x", 1), (None, "", "", 0), (2, "no url", "deep text", 9), (3, "http://h/", "\U0001f600&", 2)])


# ---------------------------------------------------------------- 3 benchmark

TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text):
    return TOKEN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_hits(text, items):
    words, hit, found = fold(text), set(), set()
    for item, body in items:
        w = fold(body)
        for s in range(max(1, len(w) - 9)) if w else ():
            window = w[s : s + 10]
            for p in range(len(words) - len(window) + 1):
                if words[p : p + len(window)] == window:
                    hit |= set(range(p, p + len(window)))
                    found.add(str(item))
    return words, hit, sorted(found)


ITEMS = [(1, None), (2, ""), (3, "The the THE the"), (4, " ".join(f"q{i}" for i in range(25))), (40, "a b a b a b a b a b a b"), (None, "zz"), (5, "ünïcode 日本語")]


def test_spans_equal_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, t) for i, t, *_ in odd_rows() if t is None or len(t) < 3000]
    for i in range(30, 60):
        body = [rng.choice("ab") for _ in range(40)] + [f"q{j}" for j in range(rng.randrange(10), 25)]
        rows.append((i, ", ".join(body)))
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontamination.find_spans(docs, items).collect()
    want = Counter()
    for i, t in rows:
        words, hit, found = brute_hits(t, [x for x in ITEMS if x[0] is not None])
        want[(i, len(words), len(hit), tuple(found))] += 1
    assert Counter((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), tuple(r["items"])) for r in got) == want


def test_benchmark_in_blocks_gives_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "q0 " + " ".join(f"q{i}" for i in range(25)) + " the the the the")], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    one = decontamination.find_spans(docs, items).select("spans", "items").collect()
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 10)
    assert decontamination.find_spans(docs, items).select("spans", "items").collect() == one


def test_cut_removes_the_passage():
    text = "Before, q0 q1; q2 after."
    assert decontamination.without(text, [(1, 4)]) == "Before,  after."


def test_decontamination_of_odd_and_empty(odd, empty, spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontamination.find_spans(odd, items).count() == len(odd_rows())
    assert decontamination.find_spans(odd, items.limit(0)).where("size(spans) > 0").count() == 0
    assert decontamination.find_spans(empty, items).count() == 0


# ---------------------------------------------------------------- 4 quality


def brute_quality(text):
    words = WORDS.findall(text or "")
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {p for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again)


def test_quality_measures(odd):
    got = quality_rules.quality_rules(odd).collect()
    assert len(got) == len(odd_rows())
    by_text = {r.text: r for r in got}
    for _, text, *_ in odd_rows():
        r = by_text[text]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(text)
        assert r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words)
        assert not (r.kept and r.base_failed)


def test_quality_keeps_prose_and_drops_junk(spark):
    rng = random.Random(3)
    prose = " ".join(rng.choice(["the", "of", "river", "stone", "runs", "slowly", "and", "old"]) + str(i % 2 and "s" or "") for i in range(120))
    varied = " ".join(f"{rng.choice(['the', 'of', 'a'])} {''.join(rng.choice('abcdeilnorst') for _ in range(6))}" for _ in range(60))
    rows = [(1, varied), (2, re.sub(" ", "### ", varied)), (3, varied.upper().replace(" ", "!! ")), (4, "same line of words here\n" * 30), (5, prose[:30])]
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: False}


def test_a_filter_on_the_verdict_copies_no_measure(odd):
    judged = quality_rules.quality_rules(odd)
    kept = judged.where("kept and n_words > 3")
    plain, plan = (x._jdf.queryExecution().optimizedPlan().toString() for x in (judged, kept))
    assert plan.count("xxhash64") == plain.count("xxhash64") and kept.groupBy("base_failed").count().count() <= 1


def test_quality_stage_returns_the_same_columns(odd, empty, spark):
    left = quality_rules.filter_quality(spark, odd, "")
    assert left.columns == odd.columns and left.count() == 0  # no stop words in any
    assert quality_rules.filter_quality(spark, empty, "").count() == 0


# ---------------------------------------------------------------- 5 language


def test_language_of_held_out_texts(spark):
    rng = random.Random(4)
    parts = {"en": "the th ing er ion ly", "de": "der sch ung ß ich ein", "fr": "le eau é que oi ent"}
    make = lambda k: " ".join("".join(rng.choice(parts[k].split()) for _ in range(3)) for _ in range(40))
    rows = [(i, make(k), k) for i in range(120) for k in [rng.choice(list(parts))]]
    docs = spark.createDataFrame([*rows, (500, None, "en"), (501, "123 !?", "de"), (502, make("de"), None)], "doc_id long, text string, lang string")
    docs = docs.withColumn("held_out", F.col("doc_id") >= 80)
    model = language_id.fit(docs.where("not held_out and lang is not null"))
    got = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    right = [got[i].lang_pred == k for i, _, k in rows if i >= 80]
    assert sum(right) / len(right) > 0.97
    assert got[500].lang_pred == got[501].lang_pred == "und" and got[500].score == 0
    assert got[502].lang_pred == "de" and all(0 <= r.score <= 1 for r in got.values())


def test_rejection_is_measured_on_texts_the_centroids_have_not_seen(spark, odd):
    rng = np.random.default_rng(5)
    x = rng.random((400, 30)) ** 4
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    least = language_id.least_cosine(x)
    fresh = rng.random((2_000, 30)) ** 4
    fresh /= np.linalg.norm(fresh, axis=1, keepdims=True)
    share = ((fresh @ language_id.spherical_centroids(x).T).max(1) < least).mean()
    assert share < 0.02 and language_id.least_cosine(x[:3]) == -1.0
    # the odd table is identified by a fitted model, very long text and clashing columns among it
    texts = [(i, sentence(random.Random(i), 30), ("en", "fr")[i % 2]) for i in range(40)]
    model = language_id.fit(spark.createDataFrame(texts, "doc_id long, text string, lang string"))
    got = language_id.identify(odd.withColumn("held_out", F.lit(True)), model).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {"und"} and len({r.score for r in got if r.doc_id == 9}) == 1


def test_language_without_training(odd, empty):
    model = language_id.fit(empty)
    got = language_id.identify(odd.withColumn("held_out", F.lit(True)), model).collect()
    assert {r.lang_pred for r in got} == {"und"} and len(got) == len(odd_rows())


# ---------------------------------------------------------------- 6 near-dedup


def brute_sets(rows):
    out = {}
    for i, text in rows:
        w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def brute_components(sets):
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def near_rows():
    rng = random.Random(6)
    rows, n = [], 0
    for _ in range(12):
        base = sentence(rng, rng.choice([3, 40, 120]), 3000).split()
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(9999)}"
            rows.append((n, " ".join(copy) if rng.random() < 0.8 else " ".join(base).upper()))
            n += 1
    return [*rows, (900, None), (901, ""), (902, "Ab"), (903, "aB"), (904, "a b c d"), (905, "a  b\tc D")]


def test_components_equal_brute_force(spark):
    rows = near_rows()
    got = {r.doc_id: r for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = brute_sets(rows)
    want = brute_components(sets)
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_buckets_of_many_unlinked_documents_are_exhausted(spark, monkeypatch):
    rng = random.Random(7)
    base = sentence(rng, 100, 9999).split()
    rows = []
    for i in range(60):
        copy = list(base)
        for _ in range(4):
            copy[rng.randrange(100)] = f"e{rng.randrange(99999)}"
        rows.append((i, " ".join(copy)))
    monkeypatch.setattr(near_dedup, "MOST_TURNS", 1)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(brute_sets(rows))


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    grams = rng.integers(0, 1 << 62, 1000).astype(np.uint64)
    other = np.concatenate([grams[:900], rng.integers(0, 1 << 62, 100).astype(np.uint64)])
    a, b = (near_dedup.odd_sketches(near_dedup.minhashes(g, np.array([0]), 1024), 4096) for g in (grams, other))
    estimate = near_dedup.estimate(np.bitwise_count(a ^ b).sum(), 1024, 4096)
    assert abs(float(estimate) - 900 / 1100) < 0.06


def test_near_dedup_of_odd_and_empty(odd, empty, spark):
    got = near_dedup.near_duplicates(odd).collect()
    assert len(got) == len(odd_rows())
    of = {r.doc_id: r for r in got}
    assert of[None].component_id is None and of[None].kept
    assert of[4].component_id == of[6].component_id == 4 and not of[6].kept
    assert of[1].n_shingles == of[2].n_shingles == of[3].n_shingles == 0
    assert near_dedup.near_duplicates(empty).count() == 0
    left = near_dedup.near_dedup_stage(spark, odd, "")
    assert left.columns == odd.columns


# ---------------------------------------------------------------- 7 toxicity


def test_kernel_equals_its_definition():
    def phi(s):
        codes, out = toxicity.Codes(), Counter()
        for i in range(len(s)):
            for j in range(i + 1, min(len(s), i + toxicity.SPAN)):
                for k in range(j + 1, min(len(s), i + toxicity.SPAN)):
                    out[(codes[s[i]], codes[s[j]], codes[s[k]])] += toxicity.DECAY ** (k - i + 1)
        norm = math.sqrt(sum(v * v for v in out.values()))
        return {u: v / norm for u, v in out.items()}

    strings = ["idiot", "idxiot", "banana", "nab", "worthless"]
    kernel = toxicity.Kernel()
    got = kernel.against(strings, kernel.columns(strings))
    for i, a in enumerate(map(phi, strings)):
        for j, b in enumerate(map(phi, strings)):
            assert got[i, j] == pytest.approx(sum(v * b.get(u, 0) for u, v in a.items()), abs=1e-5)


def test_toxicity_finds_masked_insults(spark):
    rng = random.Random(8)
    insults = ["moron", "idiot", "scumbag", "worthless"]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        words = sentence_of_syllables(rng, 40).split()
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(insults))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    clean = sentence_of_syllables(rng, 40)
    rows += [(1000, clean + " you id-iot and wor.thless mo_ron"), (1001, clean), (1002, None), (1003, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    train = spark.createDataFrame(labels, "doc_id long, toxic int").where("doc_id < 300")
    model = toxicity.fit(docs, train)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs.withColumn("held_out", F.col("doc_id") >= 300), model).collect()}
    held = [(got[i].predicted, t) for i, t in labels if i >= 300]
    assert sum(p == t for p, t in held) / len(held) > 0.95
    assert got[1000].predicted == 1 and got[1001].predicted == 0 and got[1003].predicted == 0
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())


@pytest.mark.parametrize("every", [4, 10])
def test_toxicity_learns_from_few_labels(spark, every):
    rng = random.Random(18)
    insults = ["moron", "idiot", "scumbag", "worthless"]
    rows, labels = [], []
    for i in range(200):
        words = sentence_of_syllables(rng, 40).split()
        toxic = i % every == 0
        if toxic:  # the training part has no insult in more than 12 documents
            words += rng.sample(insults, 2)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    limit = 80 if every == 4 else 120
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int").where(f"doc_id < {limit}"))
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(docs.withColumn("held_out", F.col("doc_id") >= limit), model).collect()}
    held = [(got[i], t) for i, t in labels if i >= limit]
    assert sum(p == t for p, t in held) / len(held) > 0.95
    assert sum(p for p, t in held if t) / sum(t for _, t in held) > 0.8


def sentence_of_syllables(rng, n):
    return " ".join("".join(rng.choice(["the", "an", "er", "lo", "mi", "ta", "res", "cun"]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_one_inserted_letter_in_two_scripts_is_found(spark):
    rng = random.Random(28)
    insults = {"en": ["moron", "idiot", "scumbag", "worthless"], "ru": ["\u0434\u0443\u0440\u0430\u043a", "\u0431\u043e\u043b\u0432\u0430\u043d"]}
    greek = "".join(map(chr, range(0x3B1, 0x3C9)))
    cyrillic = "".join(map(chr, range(0x430, 0x450)))
    rows, labels, masked = [], [], set()
    for i in range(900):
        toxic, lang = i % 3 == 0, ("en", "ru")[i // 3 % 2]
        words = sentence_of_syllables(rng, 30).split()
        if lang == "ru":
            letters = rng.choice([greek, cyrillic])
            words = ["".join(rng.choice(letters) for _ in range(rng.randrange(3, 9))) for _ in range(30)]
        if toxic:
            insult = rng.choice(insults[lang])
            if i >= 600:  # held out: the insult stands once, with a letter put in
                at = rng.randrange(1, len(insult))
                insult = insult[:at] + rng.choice("bfgjkpqvwxz") + insult[at:]
                masked.add(i)
            words.insert(rng.randrange(30), insult)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int").where("doc_id < 600"))
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(docs.withColumn("held_out", F.col("doc_id") >= 600), model).collect()}
    assert sum(got[i] for i in masked) >= 0.9 * len(masked)
    assert sum(got[i] for i, t in labels if i >= 600 and not t) <= 4


def test_long_units_are_learned_and_the_odd_table_is_scored(spark, odd):
    rng = random.Random(38)
    long = "x".join("abcdefgh") * 4  # longer than a piece
    rows = [(i, sentence_of_syllables(rng, 30) + (f" {long}" if i % 4 == 0 else "")) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int").where("doc_id < 120")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(docs.withColumn("held_out", F.lit(True)), model).collect()}
    assert all(got[i] == (i % 4 == 0) for i in range(120, 200))
    scored = toxicity.score_toxicity(odd.withColumn("held_out", F.lit(False)), model).collect()
    assert len(scored) == len(odd_rows()) and all(0 <= r.score <= 1 for r in scored)
    assert len({r.score for r in scored if r.doc_id in (1, 2, 3)}) == 1 and len({r.score for r in scored if r.doc_id == 9}) == 1


def test_toxicity_without_labels(odd, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit(odd, none) is None
    got = toxicity.score_toxicity(odd.withColumn("held_out", F.lit(False)), None).collect()
    assert len(got) == len(odd_rows()) and {r.score for r in got} == {0.0}


# ---------------------------------------------------------------- 8 language model


def test_base_score_equals_its_definition(odd):
    docs = odd.withColumn("held_out", F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False)))
    model, counts = brown_lm.train(docs.where("not held_out"))
    got = brown_lm.score(docs, model, counts).collect()
    rows = odd_rows()
    count = Counter(t for i, text, *_ in rows if i is None or i % 3 for t in brown_lm.tokens(text))
    n, v = sum(count.values()), len(count)
    want = Counter()
    for i, text, *_ in rows:
        found = brown_lm.tokens(text)
        base = sum(math.log10((count[t] + 0.1) / (n + 0.1 * (v + 1))) for t in found)
        want[(i, len(found), sum(count[t] > 0 for t in found), round(base, 6))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.train_tokens == n and r.score < 0 for r in got)


def test_scores_equal_their_definition(odd, monkeypatch):
    """Brute force over the classes of the table of words, whatever of it is broadcast."""
    docs = odd.withColumn("held_out", F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False)))
    for frequent in (5, 100_000):
        monkeypatch.setattr(brown_lm, "FREQUENT", frequent)
        model, words = brown_lm.train(docs.where("not held_out"))
        table = {bytes(r.word): (r.c, r.klass) for r in words.collect()}
        mass, types = Counter(), Counter()
        for c, k in table.values():
            mass[k] += c
            types[k] += 1
        klass = lambda t: table[t][1] if t in table else 0
        pair, after = Counter(), Counter()
        rows = odd_rows()
        for i, text, *_ in rows:
            if i is None or i % 3:
                found = [klass(t) for t in (brown_lm.END, *brown_lm.tokens(text))]
                pair.update(zip(found, found[1:], strict=False))
                after.update(found[1:])
        before = Counter()
        for (a, _), c in pair.items():
            before[a] += c
        n, k = sum(after.values()), brown_lm.CLASSES
        want = Counter()
        for i, text, *_ in rows:
            total, last = 0.0, 1
            for t in brown_lm.tokens(text):
                c, at = table.get(t, (0, 0))
                total += math.log10((pair[last, at] + 5 * (after[at] + 1) / (n + k)) / (before[last] + 5))
                total += math.log10((c + 0.1) / (mass[at] + 0.1 * (types[at] + 1)) if at else 1 / (types[0] + 1))
                last = at
            want[i, round(total, 5)] += 1
        assert Counter((r.doc_id, round(r.score, 5)) for r in brown_lm.score(docs, model, words).collect()) == want
        assert all(at for c, at in table.values() if c > 1) and not any(at for c, at in table.values() if c == 1)


def test_words_choose_the_likeliest_class():
    rng = np.random.default_rng(3)
    n = brown_lm.CLASSES
    before, behind = np.zeros((2, n, n))
    before[:6, :6], behind[:6, :6] = rng.integers(0, 50, (2, 6, 6))
    cells = rng.integers(0, 4, (40, 12))
    cells[0] = 0
    cells[0, 3] = cells[0, 8] = 1  # one occurrence
    besides = [bytes(k % 6 + (k >= 6) * n for k in range(12) for _ in range(row[k])) for row in cells]
    got = brown_lm.WordClasses(before, behind).choose(brown_lm.Contexts.of([b"%d" % i for i in range(40)], besides))

    def gain(row, k):
        out = 0.0
        for a in range(6):
            share = [(before[a].sum() + 1) / (before.sum() + n), (behind[:, a].sum() + 1) / (behind.sum() + n)]
            out += row[a] * math.log((before[a, k] + 5 * share[0]) / (before[:, k].sum() + 5))
            out += row[6 + a] * math.log((behind[k, a] + 5 * share[1]) / (behind[k].sum() + 5))
        return out

    assert got[0] == brown_lm.RARE
    for row, k in zip(cells[1:], got[1:], strict=True):
        assert k == (brown_lm.RARE if row.sum() < 4 else max(range(2, n), key=lambda x: gain(row, x)))


def test_classes_follow_contexts_and_help(spark):
    rng = random.Random(9)
    rows = []
    for i in range(300):
        kinds = [("a", "b"), ("x", "y")][i % 2]
        rows.append((i, " ".join(f"{kinds[j % 2]}{rng.randrange(40)}" for j in range(60))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", F.col("doc_id") % 5 == 0)
    model, counts = brown_lm.train(docs.where("not held_out"))
    sums = brown_lm.score(docs, model, counts).where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert sums[1] > sums[0] + 0.2 * abs(sums[0]) * 0.5


def test_language_model_without_training(odd, empty):
    model, counts = brown_lm.train(empty.select("doc_id", "text"))
    got = brown_lm.score(odd.withColumn("held_out", F.lit(True)), model, counts).collect()
    assert len(got) == len(odd_rows()) and {r.train_tokens for r in got} == {0} and {r.n_known for r in got} == {0}


# ---------------------------------------------------------------- 9 substrings


def brute_removed(rows, least=20):
    first, out = {}, {}
    for i, text in sorted(((i, t) for i, t in rows if i is not None), key=lambda r: r[0]):
        words, gone = WORDS.findall(text or ""), set()
        for s in range(len(words) - least + 1):
            w = tuple(words[s : s + least])
            if first.setdefault(w, (i, s)) != (i, s):
                gone |= set(range(s, s + least))
        out[i] = (words, gone)
    return out


def substring_rows():
    rng = random.Random(10)
    passage = sentence(rng, 70, 9999)
    rows = [(i, t) for i, t, *_ in odd_rows() if i != 9]
    for i in range(40, 70):
        a = rng.randrange(0, 40)
        piece = " ".join(passage.split()[a : a + rng.randrange(15, 30)])
        rows.append((i, f"{sentence(rng, rng.randrange(0, 30), 9999)} {piece} {sentence(rng, rng.randrange(0, 30), 9999)}"))
    return [*rows, (80, "a b " * 60), (81, "a " * 50), (82, "b a " * 30)]


@pytest.mark.parametrize(("shard", "copies", "stretch"), [(1000, 200, 4096), (1, 1, 16)])
def test_removed_words_equal_brute_force(spark, monkeypatch, shard, copies, stretch):
    monkeypatch.setattr(substrings, "SHARD", shard)  # 1: every anchor of several contexts is split into windows
    monkeypatch.setattr(substrings, "COPIES", copies)
    monkeypatch.setattr(substrings, "STRETCH", stretch)
    rows = substring_rows()
    got = substrings.with_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_removed(rows)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.spans is None
            continue
        words, gone = want[r.doc_id]
        spans = None if r.spans is None else [s.asDict() for s in r.spans]
        assert set(np.flatnonzero(substrings._removed(len(words), r.text, spans)).tolist()) == gone, r.doc_id


def test_texts_of_one_doc_id_lose_their_own_words(spark):
    rng = random.Random(12)
    passage, other = sentence(rng, 30, 9999), sentence(rng, 90, 9999)
    rows = [(1, passage), (2, other), (2, f"{sentence(rng, 9, 9999)} {passage}"), (2, other), (3, "")]
    left = substrings.substring_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(r.text.strip() for r in left) == sorted([passage, other, other, "", " ".join(rows[2][1].split()[:9])])


def test_streamed_spans_equal_brute_force():
    rng = random.Random(13)
    for _ in range(60):
        texts = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(1, 20))] for _ in range(3)]
        words = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(25)]
        automaton = substrings.Automaton()
        for t in texts:
            automaton.restart()
            for w in t:
                automaton.add(w)
        known = {tuple(t[i : i + 4]) for t in texts for i in range(len(t) - 3)}
        want = {p for i in range(len(words) - 3) if tuple(words[i : i + 4]) in known for p in range(i, i + 4)}
        spans = list(substrings.spans_of(automaton.matching(words), 4))
        assert {p for s, e in spans for p in range(s, e)} == want and all(e < s for (_, e), (s, _) in zip(spans, spans[1:]))


def test_automaton_gives_matching_statistics():
    rng = random.Random(11)
    for _ in range(50):
        texts = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(1, 15))] for _ in range(4)]
        automaton, seen = substrings.Automaton(), []
        for t in texts:
            automaton.restart()
            seen.append([])
            for w in t:
                seen[-1].append(w)
                here = seen[-1]
                ended = [(s, e) for s in seen for e in range(1, len(s) + 1) if not (s is here and e == len(here))]
                want = max(
                    (n for s, e in ended for n in range(1, min(e, len(here)) + 1) if s[e - n : e] == here[len(here) - n :]), default=0
                )
                assert automaton.add(w) == want


def test_substring_stage(odd, empty, spark):
    left = substrings.substring_stage(spark, odd, "")
    assert left.columns == odd.columns
    texts = {r.doc_id: r.text for r in left.select("doc_id", "text").collect()}
    assert texts[5] == "head end" and 6 not in texts and texts[4] == odd_rows()[4][1]
    assert substrings.substring_stage(spark, empty, "").count() == 0


# ---------------------------------------------------------------- 10 licences


def test_licenses(odd, spark):
    mit = next(t for name, t in licenses.KNOWN if name == "MIT")
    rows = [
        (1, "Copyright (c) 2020 Someone\n\n" + mit.upper()),
        (2, mit.replace(",", " ;").replace("sublicense", "sublicence")),
        (3, mit + " and more"),
        (4, "Some text.\nReleased under the MIT Licence\nLicensed under CC BY-NC 4.0."),
        (5, None),
        (6, ""),
    ]
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].license_id for i in range(1, 7)] == ["MIT", "MIT", None, None, None, None]
    assert got[4].notice_ids == "CC-BY-NC-4.0,MIT" and got[5].digest is None
    assert got[6].digest == hashlib.sha256(b"").hexdigest()
    assert licenses.license_scan(odd).count() == len(odd_rows())
    with pytest.raises(ValueError):
        licenses.known_digests((("x", "y"),) * (licenses.MOST_KNOWN + 1))


def test_licenses_of_nothing_and_of_many_known_texts(empty, spark):
    assert licenses.license_scan(empty).count() == 0
    known = tuple((f"L{i}", f"License number {i} holds here") for i in range(3_000))
    rows = [(i, f"LICENCE number {i}\nholds, here") for i in range(0, 3_000, 100)] + [(-1, "a line\nlicense Number 7 holds here\nlicense number 7 holds")]
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string"), known).collect()}
    assert all(got[i].license_id == f"L{i}" and got[i].notice_ids == "" for i in range(0, 3_000, 100))
    assert got[-1].license_id is None and got[-1].notice_ids == "L7"


def test_full_license_texts_are_known(spark):
    import pathlib

    folder = pathlib.Path("/usr/share/common-licenses")
    named = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0"}
    texts = [(name, (folder / file).read_text()) for file, name in named.items() if (folder / file).exists()]
    if not texts:
        pytest.skip("no licence texts on this machine")
    rows = [(name, t) for name, t in texts] + [(name, t.replace("\n", "  ").upper()) for name, t in texts if "opyright (" not in t]
    rows += [("none", t + " or so") for _, t in texts]
    got = licenses.license_scan(spark.createDataFrame(rows, "name string, text string")).collect()
    assert all(r.license_id == (None if r.name == "none" else r.name) for r in got)


# ---------------------------------------------------------------- splits


def test_held_out_is_by_crc32_of_the_id_as_text(spark):
    from mnemospark.llm.common import held_out

    ids = spark.range(200).withColumnRenamed("id", "doc_id").withColumn("h", held_out("doc_id", 4, 2))
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in ids.collect())
