"""Substring, suffix-array and near-duplicate operators against plain versions."""

import random
import tracemalloc

import numpy as np
import pytest
from brute import corpus, frame, jaccard, phrase_dedup, shingles, suffix_dedup

from cairnlake.llm import induced, jaccard_join, winnow
from cairnlake.llm import phrase_dedup as phrases
from cairnlake.llm import suffix_dedup as suffixes


def key(r):
    return repr(r)


@pytest.mark.parametrize(("extra", "hot"), [(False, winnow.HOT), (True, winnow.HOT), (False, 2)])
def test_phrases(spark, monkeypatch, extra, hot):
    monkeypatch.setattr(winnow, "HOT", hot)
    rows = corpus()
    got = phrases.removed(frame(spark, rows, extra)).collect()
    assert sorted([(r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got], key=key) == sorted(phrase_dedup(rows), key=key)


@pytest.mark.parametrize(("memory", "hot"), [(suffixes.MEMORY, winnow.HOT), (1000, winnow.HOT), (suffixes.MEMORY, 2)])
def test_suffixes(spark, monkeypatch, memory, hot):
    monkeypatch.setattr(suffixes, "MEMORY", memory)
    monkeypatch.setattr(winnow, "HOT", hot)
    rows = corpus()
    got = suffixes.removed(frame(spark, rows)).collect()
    assert sorted([(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got], key=key) == sorted(suffix_dedup(rows), key=key)


def test_suffixes_in_many_documents(spark):
    """A passage that most documents share, at shifted places."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = " ".join(word() for _ in range(20))
    rows = [(i, " ".join([word() for _ in range(i % 9)] + [passage[i % 7 :]])) for i in range(300)]
    got = suffixes.removed(frame(spark, rows, False)).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == sorted(suffix_dedup(rows))


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80), (2, 60)])
def test_jaccard(spark, size, percent):
    rows = corpus()
    got = jaccard_join.joined(frame(spark, rows), rule=jaccard_join.Rule(size, percent)).collect()
    assert sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got], key=key) == sorted(jaccard(rows, size, percent), key=key)


def test_jaccard_chains(spark):
    """Near copies that link only from one to the next, and others a little too far apart."""
    rng = random.Random(4)
    rows, w = [], [f"w{rng.randrange(5000)}" for _ in range(150)]
    for i in range(60):
        rows.append((i, " ".join(w)))
        for _ in range(1 + i % 3):
            w[rng.randrange(len(w))] = f"v{rng.randrange(9999)}"
    got = jaccard_join.joined(frame(spark, rows, False)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(jaccard(rows))


def test_empty_tables(spark):
    empty = frame(spark, [(1, "x")]).where("doc_id < 0")
    assert phrases.removed(empty).count() == suffixes.removed(empty).count() == jaccard_join.joined(empty).count() == 0


def plain_suffixes(t):
    raw = t.tolist()
    at = sorted(range(len(raw)), key=lambda i: raw[i:])
    common = [0]
    for a, b in zip(at, at[1:], strict=False):
        common.append(next(k for k in range(len(raw)) if raw[a + k] != raw[b + k]))
    return at, common


@pytest.mark.parametrize(("memory", "batch"), [(1 << 28, 1 << 18), (100, 7), (0, 3)])
def test_induced_sorting(monkeypatch, memory, batch):
    monkeypatch.setattr(induced, "BATCH", batch)
    rng = np.random.default_rng(1)
    for trial in range(150):
        n, k = int(rng.integers(0, 120)), int(rng.integers(1, 4))
        t = np.append(rng.integers(1, k + 1, n), 0).astype(np.uint8)
        if trial % 5 == 0 and n:
            t = np.append(np.tile(t[: max(1, n // 4)].clip(1), 5), 0).astype(np.uint8)
        space = induced.Space(memory)
        at, common = induced.suffix_sort(t, int(t.max()) + 1, space)
        assert (at.tolist(), common.tolist()) == plain_suffixes(t)
        assert memory or n < 2 or space.on_disk > 0


def test_induced_sorting_beyond_memory(monkeypatch):
    """Four megabytes under a bound of one: arrays lie on disk, the recursion goes deep, and memory holds little more than the bound and a batch."""
    monkeypatch.setattr(induced, "BATCH", 1 << 14)
    rng = np.random.default_rng(2)
    passages = rng.integers(1, 20, (400, 300)).astype(np.uint8)
    t = np.append(passages[rng.integers(0, 400, 14_000)].reshape(-1), 0).astype(np.uint8)
    space = induced.Space(1 << 20)
    tracemalloc.start()
    at, common = induced.suffix_sort(t, 20, space)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert space.depth > 2 and space.on_disk > 20 * len(t) and peak < 2 * len(t)
    assert np.array_equal(np.sort(at), np.arange(len(t)))
    raw = t.tobytes()
    for j in rng.integers(1, len(t), 3000).tolist():
        a, b, k = int(at[j - 1]), int(at[j]), int(common[j])
        assert raw[a : a + k] == raw[b : b + k] and raw[a + k] < raw[b + k]


def test_tree_keeps_all_partners():
    rng = np.random.default_rng(3)
    points = rng.integers(0, 4, (300, jaccard_join.COORDINATES)).astype(np.int32)
    sizes = points.sum(1)
    tree = jaccard_join.RTree(points, sizes)
    for i in range(0, 300, 17):
        want = np.flatnonzero(np.minimum(points, points[i]).sum(1) * 190 >= 90 * (sizes + sizes[i]))
        assert sorted(tree.partners(points[i], int(sizes[i]), 90).tolist()) == want.tolist()


def near_copies(many, rng, edits=(4, 14)):
    """Copies of one text, each with some words changed: most pairs lie around the threshold."""
    w = [f"w{rng.randrange(5000)}" for _ in range(150)]
    rows = []
    for i in range(many):
        own = list(w)
        for _ in range(rng.randint(*edits)):
            own[rng.randrange(len(own))] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    return rows


@pytest.mark.parametrize(("many", "tree"), [(60, 8), (200, jaccard_join.TREE), (400, 64)])
def test_jaccard_near_misses(spark, monkeypatch, many, tree):
    """Components equal brute force, in whole blocks and in split ones."""
    monkeypatch.setattr(jaccard_join, "TREE", tree)
    rows = near_copies(many, random.Random(many), (1, 5))
    got = jaccard_join.joined(frame(spark, rows, False)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(jaccard(rows))


def test_jaccard_pairs_tried(spark, monkeypatch):
    """Pairs that are verified grow with the group, not with its square."""
    tried = {}
    for many in (100, 400):
        counts = []
        plain = jaccard_join.verify
        monkeypatch.setattr(jaccard_join, "verify", lambda pairs, *rest: counts.append(pairs.count()) or plain(pairs, *rest))  # noqa: B023
        jaccard_join.joined(frame(spark, near_copies(many, random.Random(1), (1, 7)), False), rule=jaccard_join.Rule(5, 80)).count()
        monkeypatch.undo()
        tried[many] = sum(counts)
    assert all(pairs < 4 * many for many, pairs in tried.items())


def test_links(spark):
    rows = corpus()
    want, sets = {}, [shingles(t, 3) for _, t in rows]
    for i, x in enumerate(sets):
        want[i] = sum(1 for j, y in enumerate(sets) if i != j and x and y and 100 * len(x & y) >= 90 * len(x | y))
    counted, pairs = jaccard_join.links(frame(spark, rows))
    got = counted.collect()
    assert sorted((repr(r["doc_id"]), r["n_links"]) for r in got) == sorted((repr(d), want[i]) for i, (d, _) in enumerate(rows))
    distinct = set(filter(None, sets))
    assert pairs.count() == sum(1 for x in distinct for y in distinct if x is not y and 100 * len(x & y) >= 90 * len(x | y)) // 2
    assert [c.count() for c in jaccard_join.links(frame(spark, rows).where("doc_id < 0"))] == [0, 0]
