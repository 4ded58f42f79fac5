from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chronolex.llm import bpe, lookalike, packing, quota, termcounts


# ---------------------------------------------------------------- byte-level BPE


@pytest.fixture(scope="module")
def both():
    t = Tokenizer.from_file(bpe.DEFAULT_TOKENIZER)
    t.encode_special_tokens = True
    return bpe.PairIndexEncoder(bpe.read_tokenizer()), t


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=60) | st.text("abct he\n'’<|endoftext>12é界", max_size=60), max_size=5))
def test_encoding_equals_the_library(both, texts):
    mine, library = both
    assert mine.encode(texts) == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_encode_rows(spark):
    rows = [(1, "a tale", "x"), (1, "a tale", "y"), (2, None, None), (3, "", "z"), (None, "<|endoftext|>", "z"), (4, "word " * 50_000, "long")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in bpe.encode_corpus(df).collect()}
    assert got[2] == [] and got[3] == [] and len(got[None]) > 1 and 50256 not in got[None] and len(got[4]) >= 50_000
    assert bpe.encode_corpus(df).count() == 6 and bpe.encode_corpus(df.where("doc_id = 9")).count() == 0
    counts = {r.doc_id: r.tokens for r in bpe.count_tokens(df).collect()}
    assert counts == {k: len(v) for k, v in got.items()}


# ---------------------------------------------------------------- packing


@given(st.lists(st.integers(1, 100), max_size=60))
def test_best_fit(sizes):
    place = packing.best_fit_decreasing(sizes, 100)
    load = Counter()
    for s, c in zip(sizes, place):
        load[c] += s
    assert all(v <= 100 for v in load.values())
    assert len(load) <= max(1, -(-sum(sizes) * 11 // 900) + 1)


def test_packing(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 50)
    r = np.random.default_rng(0)
    rows = [(i, "big" if i % 3 else None if i % 5 else "rare", int(r.integers(0, 300)) if i % 50 else 2500) for i in range(1500)]
    items = spark.createDataFrame(rows, "key long, source string, tokens int")
    got = packing.pack_items(items, capacity=1000, window_containers=8).collect()
    assert sum(g.tokens for g in got) == sum(t for *_, t in rows)
    load, pieces = Counter(), Counter()
    for g in got:
        load[g.window, g.slot] += g.tokens
        pieces[g.key] += 1
    assert max(load.values()) <= 1000 and {k for k, n in pieces.items() if n > 1} == {i for i, _, t in rows if t > 1000}
    assert {r.key for r in packing.divided(packing.pack_items(items, capacity=1000)).collect()} == {i for i, _, t in rows if t > 1000}
    assert sum(load.values()) / (1000 * len(load)) > 0.9
    share = sum(t for _, s, t in rows if s == "big" and t <= 1000) / sum(t for *_, t in rows if t <= 1000)
    by_window, big = Counter(), Counter()
    for g in got:
        if g.window >= 0:
            by_window[g.window] += g.tokens
            big[g.window] += g.tokens * (g.source == "big")
    assert all(abs(big[w] / by_window[w] - share) < 0.15 for w in list(by_window)[:-1])
    assert packing.pack_items(items.where("false")).count() == 0


def test_mixture_follows_its_targets(spark):
    r = np.random.default_rng(4)
    rows = [(i, "ab"[i % 5 == 0] if i % 11 else "c", int(r.integers(20, 300))) for i in range(6000)]
    shares = {"a": 0.5, "b": 0.5, "missing": 0.3}
    got = packing.pack_items(spark.createDataFrame(rows, "key long, source string, tokens int"), capacity=1000, window_containers=20, shares=shares)
    mixed = packing.mixture(got, shares).collect()
    last_b = max(m.window for m in mixed if m.source == "b")
    last = max(m.window for m in mixed)
    assert 5 < last_b < last  # b runs dry first, a and c fill the rest
    assert all(abs(m.deviation) < 0.03 for m in mixed if m.source in "ab" and m.window < last_b)
    drift = Counter()  # what a window lacks is made up later: deficits are carried
    for m in mixed:
        if m.window < last_b and m.source in "ab":
            drift[m.source] += m.deviation
    assert all(abs(x) < 0.03 for x in drift.values())
    assert {m.window for m in mixed if m.source == "c"} == set(range(last + 1)) and all(m.target is None for m in mixed if m.source == "c")
    load = Counter()
    for g in got.collect():
        load[g.window, g.slot] += g.tokens
    assert sum(load.values()) == sum(t for *_, t in rows) and sum(load.values()) > 0.97 * 1000 * len(load)


@pytest.mark.parametrize("change", [{"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"pre_tokenizer": None}])
def test_other_tokenizers_are_refused(change):
    with pytest.raises(ValueError):
        bpe.pattern_of({"model": {"type": "BPE"}, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False}, "normalizer": None} | change)


# ---------------------------------------------------------------- look-alikes


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("copy", "сору", True), ("é", "é", True), ("Ａ．", "A.", True), ("x​y", "xy", True), ("a b", "a b", True), ("ﬁn", "fin", True), ("Ⅳ", "IV", True), ("す゛", "す゛", True), ("が", "が", True), ("no‑break", "no-break", True),
        ("a", "A", False), ("é", "e", False), ("1", "l", False), ("a\nb", "a b", False), ("a.", "a…", False), ("“a”", '"a"', False), ("ſo", "so", False), ("a b", "ab", False),
    ],
)
def test_skeleton(spark, a, b, same):
    table = lookalike.Prototypes(lookalike.public_prototypes())
    assert (lookalike.skeleton(a, table) == lookalike.skeleton(b, table)) is same


@pytest.mark.parametrize("pair", "ᎪA ᏔW ᏚS ꓢS ꓮA ⲞO ⲟo 𝐀A 𝑥x ıi ᴏo ᴠv ℂC 𝟗9 ヘへ 口ロ ІI ӀI 𝐦m".split())
def test_other_scripts(spark, pair):
    table = lookalike.Prototypes(lookalike.public_prototypes())
    a, b = pair
    assert lookalike.skeleton(f"x{a}y", table) == lookalike.skeleton(f"x{b}y", table)


@pytest.mark.parametrize("pair", "Il O0 1l |l m,rn œ,oe æ,ae ſs ſf –- ’' …,... éè ñn Бб ÌI ıl θ0 З3 б6".split())
def test_real_differences(spark, pair):
    table = lookalike.Prototypes(lookalike.public_prototypes())
    a, b = pair.split(",") if "," in pair else pair
    assert lookalike.skeleton(f"x{a}y", table) != lookalike.skeleton(f"x{b}y", table)


@given(st.text(max_size=40))
def test_skeleton_is_stable(spark, s):
    table = lookalike.Prototypes(lookalike.public_prototypes())
    assert lookalike.skeleton(lookalike.skeleton(s, table), table) == lookalike.skeleton(s, table)


def test_look_alike_pairs(spark):
    rows = [(1, "copy"), (2, "сору"), (3, "copy"), (4, "Copy"), (5, None), (6, ""), (7, " ​"), (8, " "), (9, "z" * 100_000)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, look string")
    assert sorted(map(tuple, lookalike.look_alike_pairs(df).collect())) == [(1, 2), (2, 3)]
    assert sorted(map(tuple, lookalike.look_alike_membership(df).collect())) == [(1, 1, 2), (2, 1, 2), (3, 1, 2)]
    assert lookalike.look_alike_pairs(df.where("false")).count() == 0


# ---------------------------------------------------------------- term counts


@settings(deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=12), min_size=1, max_size=6), st.integers(1, 4))
def test_intervals_equal_brute_force(texts, max_n):
    tokens, records = np.array([t for x in texts for t in x], np.int64), np.repeat(np.arange(len(texts)), [len(x) for x in texts])
    occ, rec = Counter(), {}
    for i, x in enumerate(texts):
        for n in range(1, max_n + 1):
            for a in range(len(x) - n + 1):
                occ[tuple(x[a : a + n])] += 1
                rec.setdefault(tuple(x[a : a + n]), set()).add(i)
    got = {}
    for n, at, o, r in termcounts.count_block(tokens, records, max_n):
        for p, x, y in zip(at, o, r):
            got[tuple(tokens[p : p + n].tolist())] = (x, y)
    assert got == {k: (v, len(rec[k])) for k, v in occ.items()}


@settings(deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=30), min_size=1, max_size=6))
def test_suffixes_are_sorted_whole(texts):
    tokens, records = np.array([t for x in texts for t in x], np.int64), np.repeat(np.arange(len(texts)), [len(x) for x in texts])
    suffix = [tuple(x[i:]) for x in texts for i in range(len(x))]
    order, lcp = termcounts.suffix_array(tokens, records, 3)
    assert [suffix[i] for i in order] == sorted(suffix)
    for a, b, n in zip(order, order[1:], lcp[1:]):
        same = next((k for k, (x, y) in enumerate(zip(suffix[a], suffix[b])) if x != y), min(len(suffix[a]), len(suffix[b])))
        assert n == min(3, same)


def test_repeated_records_either_way(spark, monkeypatch):
    rows = [(i % 40, f"word{chr(97 + i % 7)} again the {'x' * (i % 5)}") for i in range(40)] + [(3, "wordd again the xxx"), (5, None), (None, "lost"), (7, "wordh")]
    df = spark.createDataFrame(rows, "speech_id long, speech string")
    count = lambda: {tuple(r) for r in termcounts.ngram_counts(df, "speech_id", "speech", max_n=2).collect()}
    one = count()
    monkeypatch.setattr(termcounts, "BROADCAST_IDS", 0)
    assert count() == one


def test_marks(spark):
    rows = [(1, "The toll"), (1, "The toll"), (2, "the THE bar"), (3, "the"), (4, None), (5, ""), (None, "lost"), (6, "bar"), (7, "bar"), *[(i, "x1x") for i in range(8, 20)]]
    df = spark.createDataFrame([(*r, "t") for r in rows], "speech_id long, speech string, term string")
    got = {r.term: (r.occurrences, r.records, r.mark) for r in termcounts.mark_terms(df).collect()}
    assert got == {"the": (4, 3, None), "toll": (1, 1, "rare"), "bar": (3, 3, None), "x": (24, 12, "common")}
    assert termcounts.mark_terms(df.where("false")).count() == 0


# ---------------------------------------------------------------- quota


@settings(deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 30), st.integers(0, 8)), min_size=1, max_size=12), st.integers(0, 200))
def test_swap_repair(strata, size):
    n, want, floor = (np.array(x) for x in zip(*strata))
    take = quota.swap_repair(n, want, floor, size, 1)
    least = np.minimum(floor, n)
    assert (take >= least).all() and (take <= n).all() and take.sum() == max(min(size, n.sum()), least.sum())
    over, under = np.minimum(take - want, take - least), np.minimum(want - take, n - take)
    assert over.max() <= 0 or under.max() <= 0  # no exchange is left that would help


def test_quota(spark):
    rows = [(f"i{i}", 1900 + i % 20, quota.LABELS[i % 3]) for i in range(600)] + [("i1", 1901, quota.LABELS[1]), ("x", None, "other"), ("y", 1900, "OTHER"), ("z", 1900, None), (None, 1900, "other"), ("w", 1905, "other")]
    df = spark.createDataFrame([(*r, "e") for r in rows], "id string, year int, haiku string, decade string")
    targets = spark.createDataFrame([(1900, quota.LABELS[0], 500, 2), (1910, quota.LABELS[1], 480, 2), (1900, "other", 20, 5), (1950, "other", 0, 1)], "decade int, haiku string, share_pm int, min_rows int")
    q = quota.labelled_quota(df, targets)
    assert sorted(map(tuple, q.unfilled().collect())) == [(1900, "other"), (1950, "other")]
    taken = {(r.decade, r.haiku): r.taken for r in q.report.collect()}
    drawn = Counter((r.decade, r.haiku) for r in q.sample().collect())
    assert drawn == {k: v for k, v in taken.items() if v} and taken[1900, "other"] == 1
    assert len({r.id for r in q.sample().collect()}) == sum(drawn.values()) == 60
    empty = quota.labelled_quota(df.where("false"), targets)
    assert empty.unfilled().count() == 4 and empty.sample().count() == 0
