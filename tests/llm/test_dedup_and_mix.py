"""Near duplicates, repeated passages, decontamination and mixing against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from paylens.llm import decontaminate as D
from paylens.llm import hashing as H
from paylens.llm import mixing as M
from paylens.llm import near_dup as N
from paylens.llm import substring_dedup as S
from paylens.llm.components import components, merged
from tests.conftest import SF001
from tests.llm import brute, cases


def _sorted(rows):
    return sorted((tuple(r) for r in rows), key=repr)


# -- hashing and sketches ---------------------------------------------------------

def test_word_hashes_do_not_depend_on_place_or_chunk(monkeypatch):
    texts = [b"a bb a  ccc\n" + b"x" * 100 + b" a " + "é東".encode() + b" bb", b"", b" \t", b"q" * 3000 + b" a bb"]
    h = H.WordHash()
    whole = [h.of(t) for t in texts]
    assert [len(w) for w in whole] == [len(t.split()) for t in texts]
    assert whole[0][0] == whole[0][2] == whole[3][1] and whole[0][1] == whole[0][-1]
    monkeypatch.setattr(H, "CHUNK", 16)
    small = H.WordHash()
    assert all((small.of(t) == w).all() for t, w in zip(texts, whole))


def test_sketches_are_filled_and_estimate_similarity():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 50, 2000):
        x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        s = N.sketch(x)
        assert len(s) == N.T and (s != np.uint64(2**64 - 1)).all()
        assert (s == N.sketch(x[::-1].copy())).all()
    base = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    agree = []
    for k in range(40):
        other = np.concatenate([base[: 1000 - 10 * k], rng.integers(0, 2**63, 10 * k, dtype=np.uint64)])
        j = (1000 - 10 * k) / (1000 + 10 * k)
        agree.append(abs(np.mean(N.sketch(base) == N.sketch(other)) - j))
    assert np.mean(agree) < 0.04 and max(agree) < 0.15


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 103), (103, 101), (200, 200), (301, 300), (300, 301)]
    c = components(spark.createDataFrame(edges, "a long, b long"))
    got = {r.node: r.root for r in c.collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 103: 100, 300: 300, 301: 300}
    m = merged(c, spark.createDataFrame([(30, 101), (500, 301), (600, 601)], "a long, b long"))
    got = {r.node: r.root for r in m.collect()}
    assert got[103] == 0 and got[500] == got[301] == 300 and got[601] == got[600] == 600
    none = components(spark.createDataFrame([], "a long, b long"))
    assert none.count() == 0


# -- near duplicates ----------------------------------------------------------------

@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, width):
    rows = cases.awkward()
    got = N.near_duplicates(cases.docs(spark, rows), width=width, percent=80)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert _sorted(got.collect()) == _sorted(brute.classes([(i, t) for i, t, *_ in rows], width))


def test_a_dense_group_around_the_threshold(spark):
    """Copies on both sides of the threshold, most of them not alike among themselves."""
    base = cases.words(150, 9, 10**6)
    rows = [(j, " ".join(cases.edited(base, 0.02 + 0.01 * (j % 8), j))) for j in range(300)]
    got = N.op10_near_dup(cases.docs(spark, rows))
    assert _sorted(got.collect()) == _sorted(brute.classes(rows))


def test_a_common_passage_is_no_duplicate(spark):
    passage = cases.words(80, 11, 10**6)
    rows = [(j, " ".join(passage + cases.words(60, 1000 + j, 10**6))) for j in range(200)]
    got = N.op10_near_dup(cases.docs(spark, rows)).collect()
    assert all(r.kept for r in got)


# -- repeated passages --------------------------------------------------------------

def test_substring_dedup(spark):
    rows = cases.awkward()
    got = S.op8_substring_dedup(cases.docs(spark, rows))
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert _sorted(got.collect()) == _sorted(brute.substring([(i, t) for i, t, *_ in rows]))


def test_paths_are_confirmed_by_their_source(spark):
    passage = cases.words(40, 21, 10**6)
    rows = [(1, " ".join(cases.words(30, 22, 10**6) + passage)), (2, " ".join(passage + cases.words(20, 23, 10**6))),
            (3, " ".join(cases.words(10, 24, 10**6) + passage[5:]))]
    _, _, spans = S.repeated_spans(cases.docs(spark, rows))
    got = {(r.doc_id, r.start): r for r in spans.collect()}
    assert all(r.confirmed and r.src_doc == 1 for r in got.values())
    # document 3 joins the passage five words in: two paths of document 2, one of document 3
    assert {(r.doc_id, r.start, r.stop) for r in got.values()} == {(2, 0, 17), (2, 5, 40), (3, 10, 45)}
    assert got[(3, 10)].src_start == 35


# -- decontamination ----------------------------------------------------------------

def test_contained_items(spark):
    r = cases.words(60, 31, 10**6)
    items = [(1, " ".join(r[:40])), (2, " ".join(r[20:60])), (3, "just three words"), (4, None), (5, ""), (1, " ".join(r[:20])),
             (None, " ".join(r[10:30])), (7, " ".join(cases.words(35, 32, 10**6)))]
    filler = cases.words(20_000, 33, 10**6)
    docs = [(1, " ".join(filler[:9000] + r + filler[9000:])), (2, " ".join(r[:33])), (3, " ".join(r[:30] + ["x"] + r[31:40])),
            (4, "Just THREE words!"), (5, None), (6, ""), (None, " ".join(r)), (7, " ".join(filler)), (2, " ".join(r[:33])),
            (8, " ".join(r[:20][::-1]))]
    items_df = spark.createDataFrame(items, "item_id long, text string")
    got = D.op7_decontaminate(cases.docs(spark, docs), items_df).select("doc_id", "item_id", "n_shared", "n_item")
    want = {}
    for d, i, s, n in brute.contained(docs, items):
        want[(d, i)] = max(want.get((d, i), (0, 0)), (s, n))
    assert _sorted(got.collect()) == _sorted((*k, *v) for k, v in want.items())
    assert D.op7_decontaminate(cases.docs(spark, docs), items_df.limit(0)).count() == 0
    assert D.op7_decontaminate(cases.docs(spark, docs).limit(0), items_df).count() == 0


def test_containment_without_broadcast(spark, monkeypatch):
    from paylens.llm.common import table
    docs, bench = table(spark, SF001, "documents"), table(spark, SF001, "benchmark")
    want = _sorted(D.op7_decontaminate(docs, bench).collect())
    monkeypatch.setattr(D, "MAX_BROADCAST_ROWS", -1)
    assert want and _sorted(D.op7_decontaminate(docs, bench).collect()) == want


# -- mixing ---------------------------------------------------------------------------

def _mix_rows():
    rows = [(i, " ".join(cases.words(20 + i % 90, i)), f"s{i % 4}") for i in range(600)]
    rows += [(700 + i, " ".join(cases.words(500, i)), "zz") for i in range(200)]  # a source above its share
    return rows + [(900, None, "s1"), (901, " ", "s2"), (None, "no id here", "s3"), (902, "null source " * 300, None),
                   (5, "again", "s1"), (5, "again", "s1"), (903, "", "empty")]


def test_mix_targets_and_bounds(spark):
    rows = _mix_rows()
    got = M.op3_mix_sources(cases.docs(spark, rows))
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    out = got.collect()
    assert len(out) == len(rows) and _sorted(out) == _sorted(got.collect())  # every row once; reruns agree
    want = brute.sources([(i, s, t) for i, t, s in rows])
    by_size = {size: target for size, target in want.values()}
    assert all(abs(r.target - by_size[r.source_size]) < 1e-6 * max(1.0, r.target) for r in out)
    assert all(0 <= r.taken <= 3 * r.size for r in out)
    taken = {}
    for r in out:
        taken[r.source_size] = taken.get(r.source_size, 0) + r.taken
    for size, target in want.values():
        assert abs(taken[size] - target) <= max(0.05 * target, 2 * M.BLOCK_LEN)


def test_mix_blocks(spark):
    rows = _mix_rows()
    docs = cases.docs(spark, rows)
    out = M.mix(docs, block_len=64, shard_blocks=50).collect()
    assert all(0 < r.n_words <= 64 and len(r.text.split()) == r.n_words for r in out)
    assert len({(r.shard, r.slot) for r in out}) == len(out)
    # every block's words are consecutive words of its documents
    text = {}
    for i, t, s in rows:
        text.setdefault(i, set()).update((t or "").split())
    assert all(set(r.text.split()) <= set().union(*[text[i] for i in r.doc_ids]) for r in out)
    counts = {}
    for r in out:
        counts[(r.source, r.block)] = counts.get((r.source, r.block), 0) + 1
    assert max(counts.values()) <= 3
    assert M.mix(docs.limit(0)).count() == 0 and M.op3_mix_sources(docs.limit(0)).count() == 0


def test_permutation_is_a_bijection(spark):
    from pyspark.sql import functions as F
    for n in (1, 2, 7, 64, 1000):
        got = spark.range(n).select(M.permuted(F.col("id"), F.lit(n), F.lit("s")).alias("p")).collect()
        assert sorted(r.p for r in got) == list(range(n))
        if n == 1000:
            assert sum(r.p == i for i, r in enumerate(got)) < 20


def test_pairs_of_a_family_grow_with_its_rows(spark, monkeypatch):
    """Copies of one text with 5% of the words edited: no join makes pairs in proportion to the square."""
    counted = {}
    plain = N.written

    def counting(df, name, release=False):
        out = plain(df, name, release)
        counted[name] = counted.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(N, "written", counting)
    base, made = cases.words(150, 1), []
    for n in (150, 300, 600):
        counted.clear()
        rows = [(i, " ".join(cases.edited(base, 0.05, i))) for i in range(n)]
        got = {r.doc_id: r.component_id for r in N.near_duplicates(cases.docs(spark, rows), 2, 80).collect()}
        made.append(counted["central-pairs"] + counted["pairs"] + counted["links"])
        if n < 600:
            assert got == {i: c for i, _, c, _ in brute.classes(rows, 2)}
    assert made[2] < 30 * 600 and made[2] < 8 * made[0]


def test_shard_counts_follow_the_shares(spark):
    """Full shards, the sources' draws in sum, and in every shard about a source's share of them."""
    rows = [(i, " ".join(cases.words(100, i)), f"s{min(2, i % 7)}") for i in range(1400)]
    p = M.packed(cases.docs(spark, rows), block_len=10)
    parts = M.pieces(p, 10)
    drawn = M.draws(parts, shard_blocks=500).cache()
    counts = {(r.shard, r.src): r.n_blocks for r in M.shard_counts(drawn).collect()}
    want = {r.src: r.n_draws for r in parts.select("src", "n_draws").distinct().collect()}
    total = sum(want.values())
    shards = {s for s, _ in counts}
    assert shards == set(range(-(-total // 500)))
    for src, n in want.items():
        assert sum(v for (_, c), v in counts.items() if c == src) == n
    for s in shards:
        size = sum(v for (t, _), v in counts.items() if t == s)
        assert size == min(500, total - 500 * s)
        for src, n in want.items():  # six standard deviations of a multinomial count
            share = n / total
            assert abs(counts.get((s, src), 0) - size * share) <= 6 * (size * share * (1 - share)) ** 0.5 + 1
    spread = [(counts.get((s, src), 0) - 500 * n / total) ** 2 / (500 * n / total) for s in shards if s < max(shards) for src, n in want.items()]
    assert 0.2 < sum(spread) / len(spread) < 2  # neither constant nor more uneven than draws
    again = M.shard_counts(M.draws(parts.repartition(3), shard_blocks=500)).collect()
    assert {(r.shard, r.src): r.n_blocks for r in again} == counts
