"""Classifier, language identification, vector search and the pipeline."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from paylens.llm import language as G
from paylens.llm import quality as Q
from paylens.llm import vector_search as V
from paylens.llm.common import table
from tests.conftest import SF001, SF01
from tests.llm import brute, cases


def test_ordinal_fit_orders_thresholds_and_recovers_grades():
    rng = np.random.default_rng(3)
    rows, grades = [], []
    for i in range(600):
        g = i % 3
        own = {0: [1], 1: [2], 2: [3]}[g]
        rows.append(np.array(sorted(set(own + rng.integers(10, 200, 20).tolist())), np.int32))
        grades.append(g)
    m = Q.fit_rows(rows[:400], np.array(grades[:400]), 3)
    assert m.thresholds[0] < m.thresholds[1]
    keep = set(m.weights)
    tails = [m.tails(m.score(set(r.tolist()) & keep)) for r in rows[400:]]
    assert all(a >= b for a, b in tails)  # tail probabilities never cross
    assert np.mean([sum(x >= 0.5 for x in t) == g for t, g in zip(tails, grades[400:])]) > 0.9
    assert Q.fit_rows([], np.array([], int), 3).tails(0.0)[-1] > 0.99


def test_held_out_accuracy(spark):
    """Fit on half of the rated documents; judge the other half."""
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    m = Q.fit(Q.graded(docs, labels.where(half)), 3)
    rated = Q.graded(docs, labels.where(~half))
    got = rated.withColumn("p", Q.assessment(F.col("text"), m)["p_top"]).groupBy("grade").agg(
        F.avg((F.col("p") >= Q.ACCEPT).cast("int")).alias("accepted")).collect()
    share = {r.grade: r.accepted for r in got}
    assert share[2] > 0.97 and share[0] < 0.03 and share[1] < 0.3


def test_quality_edges(spark):
    rows = cases.awkward()
    docs = cases.docs(spark, rows)
    labels = spark.createDataFrame([(5, 1, 0), (6, None, 0), (11, 0, 0), (None, 1, 0), (999, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    out = Q.op1_quality(docs, labels)
    assert out.columns == ["doc_id", "expected_grade", "p_top", "accepted"]
    assert out.count() == len(rows)
    assert Q.op1_quality(docs, labels.limit(0)).where("accepted").count() == len(rows)
    assert Q.op1_quality(docs.limit(0), labels).count() == 0
    kept = Q.accepted(docs, labels)
    assert kept.columns == docs.columns


def test_languages(spark):
    docs, pages = table(spark, SF01, "documents"), table(spark, SF01, "pages")
    got = G.op5_language(pages, docs).collect()
    assert len(got) == pages.count()
    said = [r for r in got if r.declared]
    assert np.mean([r.lang == r.declared for r in said]) > 0.95
    assert all(0 < r.posterior <= 1 for r in got)


def test_evidence_beyond_the_text(spark):
    """A page without text follows its host; with a declaration, the declaration."""
    docs = table(spark, SF01, "documents")
    some = {r.lang: r.text for r in docs.where("n_chars > 500").groupBy("lang").agg(F.first("text").alias("text")).collect()}
    rows = [(i, f"https://fr.site.example/{i}", f"<html lang='fr'><p>{some['fr']}</p></html>") for i in range(30)]
    rows += [(100 + i, f"https://de.other.example/{i}", f"<html lang='de'><p>{some['de']}</p></html>") for i in range(30)]
    rows += [(200, "https://fr.site.example/x", "<p>1</p>"), (201, "https://new.site.example/", "<html><p></p>"),
             (202, None, None), (203, "not a url", "<html lang=de>"), (None, "https://de.other.example/q", ""),
             (204, "https://de.other.example/z", "<script>var a='the of and';</script>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in G.op5_language(pages, docs).collect()}
    assert len(got) == len(rows)
    assert got[200].lang == "fr" and got[201].lang == "fr" and got[203].lang == "de"
    assert got[None].lang == "de" and got[204].lang == "de" and got[202].lang is not None
    assert G.op5_language(pages.limit(0), docs).count() == 0
    blank = G.op5_language(pages, docs.limit(0)).collect()
    assert len(blank) == len(rows) and all(r.lang is None for r in blank)


@pytest.mark.parametrize("lead", ["", " " * 200_000, "<!-- " + "x" * 200_000 + " -->", "<html class='a'>" + "<p>b</p>" * 25_000])
def test_declared_language_anywhere_in_the_page(spark, lead):
    assert G.declared_language(lead + "<HTML class=x\n lang='FR-ca'><p>1</p>") == "fr"
    rows = [(1, None, lead + "<html lang=fr><p>1</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert G.op5_language(pages, table(spark, SF001, "documents")).first().declared == "fr"


def test_declared_language_is_linear():
    assert G.declared_language("<html " * 100_000) == ""
    assert G.declared_language("<html" + " lang" * 100_000 + " " * 300_000) == ""
    assert G.declared_language("<html" + " lang=1" * 100_000 + "<html lang=de>") == "de"
    assert G.declared_language(None) == G.declared_language("<html lang=>") == G.declared_language("<htmlx lang=de>") == ""


def test_visible_text_is_one_forward_scan():
    assert G.visible_text("a<!-- x<b> -->b<SCRIPT>c<p></script >d<p class='x'>e &amp; f") .split() == ["a", "b", "d", "e", "&", "f"]
    assert G.visible_text("a<style>b") .split() == ["a"] and G.visible_text("a<!--b").split() == ["a"]
    assert G.visible_text("a < b").split() == ["a", "<", "b"] and G.visible_text(None) == ""
    for piece in ("<script>", "<!--", "<", "<style><script>", "<p", "</script>"):
        G.visible_text(piece * 300_000)  # quadratic time would not end


def test_other_attributes_are_no_declaration():
    assert G.declared_language("<html data-lang='de' hreflang=es>") == ""
    assert G.declared_language("<html data-lang='de' xml:lang=\"fr\">") == "fr"


def test_languages_without_their_declaration(spark):
    """The declaration is evidence; taken away, text, address and host still give the language it named."""
    docs, pages = table(spark, SF01, "documents"), table(spark, SF01, "pages")
    said = {r.page_id: r.declared for r in G.op5_language(pages, docs).collect() if r.declared}
    bare = pages.withColumn("html", F.regexp_replace("html", r"<html[^>]*>", "<html>"))
    got = {r.page_id: r for r in G.op5_language(bare, docs).collect()}
    assert not any(r.declared for r in got.values()) and len(said) > 100
    assert np.mean([got[i].lang == lang for i, lang in said.items()]) > 0.9


def _vectors():
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)]  # ties
    rows += [(2000, None), (2050, []), (2100, [1.0] * 7 + [None]), (2150, [float("nan")] * 8), (2200, [float("inf")] * 8),
             (2250, [1.0, 2.0]), (2251, [3.0, 4.0]), (None, [1.0] * 8), (2300, [0.0] * 8), (2350, [50.0] * 8)]
    return rows


@pytest.mark.parametrize("block,bits", [(4096, 8), (32, 3)])
def test_vector_search(spark, monkeypatch, block, bits):
    monkeypatch.setattr(V, "BLOCK", block)
    monkeypatch.setattr(V, "READ", 16)
    df = spark.createDataFrame(_vectors(), "vec_id long, embedding array<double>")
    got = V.top_k(df, F.col("id") % 50 == 0, 5, bits=bits).collect()
    want = [(q, r, i, s) for q, r, i, s in brute.neighbours(_vectors())]
    assert sorted(map(tuple, got)) == sorted(want)
    assert V.op9_vector_search(df.limit(0)).count() == 0


def test_vector_search_large_components_and_repeated_ids(spark):
    """Scores beyond 53 and 64 bits, negative ones, and rows that share the query's id."""
    rows = [(0, [1.0, 0.0]), (1, [1e7, 5.0]), (2, [2e7, -5.0]), (3, [2e7 + 1 / 256, 1.0]), (4, [-1e9, 0.0]), (50, [3e8, 2e8]),
            (50, [1.0, 1.0]), (50, [1.0, 1.0]), (100, [-1e12, 1e12]), (5, [1e14, 1.0]), (6, [1e14, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, V.op9_vector_search(df).collect()))
    big = 2**63 - 1
    want = sorted((q, r, i, max(-big - 1, min(big, s))) for q, r, i, s in brute.neighbours(rows))
    assert got == want
    assert [(r[2], r[3]) for r in got if r[0] == 0][2:] == [(50, 19660800000000), (3, 1310720000256), (2, 1310720000000)]


def test_pipeline(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_dup", "decontaminate", "pii", "mix"]
    docs = table(spark, SF01, "documents")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = {r.doc_id: r for r in kept.collect()}
        kept = spark.createDataFrame(stage(spark, kept, SF01).collect(), docs.schema)
        after = {r.doc_id: r for r in kept.collect()}
        assert kept.columns == docs.columns and set(after) <= set(before)
        texts = [(i, r.text) for i, r in before.items()]
        if name == "near_dup":
            assert set(after) == {i for i, _, _, keep in brute.classes(texts, 5) if keep}
        if name == "decontaminate":
            items = [tuple(r) for r in table(spark, SF01, "benchmark").select("item_id", "text").collect()]
            assert set(after) == set(before) - {d for d, *_ in brute.contained(texts, items)}
        if name == "pii":
            assert set(after) == set(before)
            assert not any(brute.pii(r.text) for r in after.values())
            assert all(after[i].text == t for i, t in texts if not brute.pii(t))
            assert all(r.n_chars == len(r.text) for r in after.values())
    mixed = corpus_pipeline.STAGES[4][1](spark, kept, SF01).collect()
    assert {i for r in mixed for i in r.doc_ids} <= set(after)


def test_pipeline_stages_on_awkward_rows(spark):
    rows = [r for r in cases.awkward()]
    docs = cases.docs(spark, rows)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF01)
        assert out.count() >= 0
        if name != "mix":
            assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), SF01).count() == 0


def test_one_row_of_each_near_duplicate_class_is_left(spark):
    """Repeated rows, one id with several texts and rows without id, told apart by their place in the list."""
    rows = cases.awkward()
    base, other = " ".join(cases.words(120, 1)), " ".join(cases.words(80, 99, 10**6))
    rows += [(5, base)] * 3 + [(None, base), (None, other), (None, other.upper()), (None, other), (None, " "), (2, ""),
                               (300, other + " more"), (301, "two texts"), (301, "of one id"), (301, None), (302, "of one id")]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i, _, c, _ in brute.classes([(i, t) for i, (_, t) in enumerate(rows)], 5):
        parent[find(i)] = find(c)
    by_id = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            parent[find(i)] = find(by_id.setdefault(d, i))
    classes = {}
    for i, row in enumerate(rows):
        classes.setdefault(find(i), []).append(row)
    got = corpus_pipeline.near_dup(spark, cases.docs(spark, rows), SF01).collect()
    smallest = [min((d for d, _ in c if d is not None), default=None) for c in classes.values()]
    assert sorted(map(repr, smallest)) == sorted(repr(r.doc_id) for r in got)
    assert all((r.doc_id, r.text) in rows for r in got)
