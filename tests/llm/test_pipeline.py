"""The pipeline against a brute-force version on a small corpus."""

from __future__ import annotations

import random

import corpus_pipeline
from mnemospark.llm import mixing, quality_rules, substrings
from tests.llm.test_operators import SCHEMA, brute_components, brute_hits, brute_removed, brute_sets, odd_rows


def corpus():
    rng = random.Random(12)
    syllable = lambda: "".join(rng.choice("abcdeilnorst") for _ in range(rng.randrange(3, 8)))
    prose = lambda n: " ".join(rng.choice(["the", "of", "a", syllable(), syllable()]) for _ in range(n))
    passage, leak = prose(40), prose(20)
    rows = [(i, prose(80)) for i in range(20)]
    rows += [(20, rows[3][1]), (21, rows[4][1] + " end")]
    rows += [(22, f"{prose(60)} {passage} {prose(20)}"), (23, f"{prose(60)} {passage} {prose(20)}")]
    rows += [(24, f"{prose(60)} {leak} {prose(10)}"), (25, "### " * 80), (26, None), (27, "too short")]
    docs = [(i, t, "en", f"s{i % 3}", 1) for i, t in rows]
    return docs, [(1, leak)]


def test_pipeline_equals_brute_force(spark, tmp_path):
    docs, items = corpus()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    frame = spark.createDataFrame([(d[0], d[1]) for d in docs], "doc_id long, text string")
    kept = {r.doc_id for r in quality_rules.quality_rules(frame).where("kept").collect()}
    assert kept == set(range(25))
    rows = [(d[0], d[1]) for d in docs if d[0] in kept]
    root = brute_components(brute_sets(rows))
    rows = [(i, t) for i, t in rows if root[i] == i]
    assert {i for i, _ in rows} == set(range(25)) - {20, 21}
    cut = []
    for i, (words, gone) in brute_removed(rows).items():
        cut.append((i, " ".join(w for p, w in enumerate(words) if p not in gone)))
    clean = []
    for i, t in cut:
        words, hit, _ = brute_hits(t, items)
        clean.append((i, len(words) - len(hit)))
    assert {i: r["size"] for i, r in got.items()} == dict(clean)
    assert got[23]["size"] == 80 and got[24]["size"] == 70
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.STAGES[-1][1] is mixing.mix_stage
    assert substrings.THRESHOLD == 20


def test_pipeline_of_odd_and_of_no_documents(spark, tmp_path):
    for name, rows in (("odd", odd_rows()), ("none", [])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, None), (None, "x"), (2, "")] if rows else [], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, folder)
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        got = corpus_pipeline.run(spark, folder).collect()
        ids = [r.doc_id for r in got]
        assert set(ids) <= {r[0] for r in rows} and (rows or not ids) and not {1, 2, 3} & set(ids)
