"""Licences, vectors, near copies and mixing against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from shelfmark.functions import components
from shelfmark.llm import chosen_path, impact, licenses, mixing, rabitq, vectors
from tests.llm.conftest import PROSE

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {k: k + 32 for k in range(65, 91)}


def base_places(text):
    words = WORD.findall((text or "").translate(LOWER))
    found = [(k, label) for label, phrase in licenses.BASE for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    return len(words), found


@pytest.fixture(scope="module")
def licence_texts():
    rng = random.Random(1)
    words = "mit license apache general public the of MIT licence gnu under version 2 0 by nc cc".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    return [*texts, "mit", "license mit", "general public general public license", "MIT-License;APACHE_LICENSE", None, ""]


def test_licence_places_as_brute_force(spark, make_docs, licence_texts, awkward):
    for docs in (make_docs(licence_texts), awkward):
        index = licenses.build_index(docs)
        got = defaultdict(list)
        for r in licenses.scan(docs, index).collect():
            got[r.doc_id].append((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels))
        want = defaultdict(list)
        for r in docs.collect():
            n, found = base_places(r.text)
            at = [k for k, _ in found]
            want[r.doc_id].append((n, len(found), min(at, default=None), max(at, default=None), sorted({x for _, x in found})))
        assert {k: sorted(map(str, v)) for k, v in got.items()} == {k: sorted(map(str, v)) for k, v in want.items()}


def test_notices_need_their_phrase(spark, make_docs, no_docs):
    docs = make_docs(
        [
            "x Permission is hereby granted, free of charge, to any person obtaining a copy of THIS software y",
            "permission is hereby granted free for charge to any person obtaining a copy of this software",
            "Licensed under the Apache License, Version 2.0.",
            "permission is kindly granted free of charge to any person obtaining a copy of this software",
        ]
    )
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(docs, licenses.build_index(docs)).collect()}
    assert got[0] == (["mit-notice"], 1.0) and got[1] == ([], 0.0)
    assert got[2] == (["apache", "apache-2.0"], 1.0)
    assert got[3][0] == ["mit-notice"] and 0.9 < got[3][1] < 1
    assert licenses.scan(no_docs, licenses.build_index(no_docs)).count() == 0


def test_sketches_lose_no_pair_at_the_threshold():
    rng = np.random.default_rng(11)
    pairs = rng.integers(0, 1 << 63, (4000, 100), dtype=np.uint64)
    left, right = chosen_path.sketches([p[:90] for p in pairs]), chosen_path.sketches([p[10:] for p in pairs])  # 80 of 100 shared
    n = np.full(len(pairs), 90)
    assert chosen_path._similar(left, n, right, n, chosen_path.THRESHOLD).all()


@pytest.fixture(scope="module")
def vector_rows():
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.standard_normal(24) * rng.choice([0.1, 1.0])], 1) for i in range(700)]
    same = [0.25] * 24
    rows += [(700 + i, same, 1) for i in range(60)]
    rows += [(800, None, 1), (801, [], 1), (802, [0.0] * 24, 1), (803, [None] + [0.5] * 23, 1), (804, [float("nan")] + [0.5] * 23, 1), (805, [float("inf")] + [0.5] * 23, 1)]
    rows += [(None, same, 1), (900, [1.0, 2.0], 1), (910, [2.0, -1.0], 1), (0, rows[0][1], 1)]
    return rows


SCHEMA = "vec_id long, embedding array<double>, id int"


def usable(rows, zero):
    """Rows that take part, each one its own."""
    return [(i, np.array(v)) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v))]


def brute(rows, is_query, score, k):
    """Sorted (query id, rank, id, score) with a smaller score first."""
    out = []
    for a, (q, x) in enumerate(rows):
        if is_query(q):
            others = sorted((score(x, v), i) for b, (i, v) in enumerate(rows) if a != b and len(v) == len(x))
            out += [(q, rank, i, s) for rank, (s, i) in enumerate(others[:k], 1)]
    return sorted(out)


def test_nearest_found_and_ordered(spark, vector_rows, monkeypatch):
    monkeypatch.setattr(rabitq.build_index, "__defaults__", (150,))
    df = spark.createDataFrame(vector_rows, SCHEMA).repartition(5)
    got = sorted(map(tuple, rabitq.nearest(df, "id % 10 = 0", k=7).collect()))
    want = brute(usable(vector_rows, zero=False), lambda i: i % 10 == 0, lambda x, v: float(np.sqrt(((v - x) ** 2).sum())), 7)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    hits = sum(g[2] == w[2] and g[3] == pytest.approx(w[3], abs=1e-12) for g, w in zip(got, want, strict=True))
    assert hits / len(want) > 0.99
    assert rabitq.nearest(spark.createDataFrame([], SCHEMA), "id % 10 = 0").count() == 0


def test_estimates_stay_inside_their_bounds():
    rng = np.random.default_rng(2)
    vecs = rng.standard_normal((2000, 64))
    center = vecs.mean(axis=0)
    codes = rabitq.encode(vecs, center)
    outside = 0
    for q in rng.standard_normal((20, 64)):
        guess, error = rabitq.estimate(*codes, q, center)
        outside += (np.abs(((vecs - q) ** 2).sum(axis=1) - guess) > error).sum()
    assert outside < 0.005 * 40000


def test_exact_top_k(spark, vector_rows, monkeypatch):
    monkeypatch.setattr(impact.build_index, "__defaults__", (150,))
    monkeypatch.setattr(vectors, "QUERIES", 20)
    rows = [*vector_rows, (0, [1.0] * 24, 1), (1000, [1e17, 2.0, 3.0], 1), (1005, [1e17, -3e16, 3.0], 1), (1010, [-4.0, 3e16, 2.0], 1), (1015, [1.0, 2.0, 3.0], 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted((r.query_id, r.rank, r.vec_id, -r.score) for r in impact.top_k(df, "id % 5 = 0").collect())
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in usable(rows, zero=True)]
    product = lambda x, v: -max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(x, v, strict=True))))
    assert got == brute(whole, lambda i: i % 5 == 0, product, 5)
    assert impact.top_k(spark.createDataFrame([], SCHEMA), "id % 5 = 0").count() == 0


def test_reading_stops_on_proof():
    """Random vectors: reading stops before the end, and few rows are left for exact scores."""
    rng = np.random.default_rng(7)
    vecs = np.floor(256 * rng.standard_normal((4000, 64)) / 8)
    index = impact.Segments(vecs, *impact.segments_of(vecs))
    left = 0
    for at, possible in index.possible(vecs[:100], np.arange(100)[:, None] != np.arange(4000), 5):
        true = vecs @ vecs[at]
        true[at] = -np.inf
        assert set(np.argsort(-true, kind="stable")[:5]) <= set(possible)
        left += len(possible)
    assert left / 100 <= impact.FEW * 4000 and index.read < 0.9 * 100 * np.count_nonzero(vecs)


def near_copies(rng, n_bases, copies):
    words = [f"w{k}" for k in range(3000)]
    line = " ".join(rng.choice(words) for _ in range(40))
    texts = []
    for _ in range(n_bases):
        base = [rng.choice(words) for _ in range(rng.randint(60, 200))]
        for _ in range(rng.randint(1, copies)):
            own = list(base)
            for _ in range(rng.randint(0, len(base) // 40)):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts.append((line + " " if rng.random() < 0.5 else "") + " ".join(own))
    return texts


def brute_classes(rows):
    sets = [(i, frozenset(chosen_path.shingles([t or ""])[0].tolist())) for i, t in rows if i is not None]
    different = {}
    for i, s in sets:
        if s:
            different[s] = min(i, different.get(s, i))
    keys = list(different)
    links, parent = defaultdict(int), {}

    def top(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for a in range(len(keys)):
        for b in range(a):
            both = len(keys[a] & keys[b])
            if both >= 0.8 * (len(keys[a]) + len(keys[b]) - both):
                links[keys[a]] += 1
                links[keys[b]] += 1
                x, y = sorted((top(different[keys[a]]), top(different[keys[b]])))
                parent[y] = x
    return sorted((i, top(different[s]), links[s]) if s else (i, i, 0) for i, s in sets)


@pytest.mark.parametrize("bucket,block", [(chosen_path.BUCKET, chosen_path.BLOCK_SETS), (4, 16)])
def test_near_copies_as_brute_force(spark, make_docs, monkeypatch, bucket, block):
    monkeypatch.setattr(chosen_path, "BUCKET", bucket)
    monkeypatch.setattr(chosen_path, "BLOCK_SETS", block)
    rng = random.Random(11)
    one_family = near_copies(random.Random(12), 1, 2)[:1] * 3
    texts = near_copies(rng, 40, 6) + one_family
    base = texts[0].split()
    for k in range(70):  # one large group of near copies
        texts.append(" ".join([*base[:k], f"new{k}", *base[k + 1 :]]))
    texts += ["", None, "two words", "Two, words!", "same", "same"]
    docs = make_docs(texts)
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in chosen_path.join(docs).collect())
    want = brute_classes([(r.doc_id, r.text) for r in docs.collect()])
    assert [g[0] for g in got] == [w[0] for w in want]
    missed = sum(w[2] for w in want) - sum(g[2] for g in got)
    assert 0 <= missed <= 0.01 * sum(w[2] for w in want)
    assert sum(g[1] != w[1] for g, w in zip(got, want, strict=True)) <= 1


def test_near_copies_awkward(spark, awkward, no_docs):
    rows = chosen_path.join(awkward).collect()
    assert len(rows) == awkward.count()
    by = defaultdict(set)
    for r in rows:
        by[r.doc_id].add((r.class_id, r.n_links))
    assert by[1] == by[99] == {(1, 0)} and by[None] == {(None, 0)} and by[2] == {(2, 0)}
    assert chosen_path.join(no_docs).count() == 0


def test_components_of_a_long_chain(spark):
    chain = spark.range(0, 400).selectExpr("id a", "id + 1 b").union(spark.sql("select 1000L a, 1001L b union all select 1002L, 1001L union all select 7L, 7L"))
    got = {r.id: r.label for r in components.connected(chain, "a", "b").collect()}
    assert got == {i: 0 for i in range(401)} | {1000: 1000, 1001: 1000, 1002: 1000}
    assert components.connected(chain.limit(0), "a", "b").count() == 0


def fill(sizes, weights, share, most):
    """Targets by repeated sharing, as the definition says."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target = dict.fromkeys(names, 0.0)
    left, open_ = share * sum(sizes.values()), list(names)
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        left = 0.0
        for s in open_:
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
        open_ = [s for s in open_ if target[s] < most * sizes[s]]
    return target


def test_mix_hits_targets(spark, make_docs, awkward, no_docs):
    rng = random.Random(3)
    docs = make_docs([PROSE["en"][: rng.randint(0, 100)] * rng.choice([0, 1, 1, 2, 9]) for _ in range(400)])
    for frame in (docs, awkward):
        rows = mixing.mix(frame).collect()
        assert len(rows) == frame.count()
        sizes, taken, target = defaultdict(int), defaultdict(int), {}
        for r in rows:
            sizes[r.source] += r.size
            taken[r.source] += r.taken
            target[r.source] = r.target
            assert 0 <= r.taken <= 2 * r.size
        assert all(r.source_size == sizes[r.source] for r in rows)
        want = fill(dict(sizes), (3.0, 1.0, 2.0), 1.5, 2.0)
        assert target == pytest.approx(want, abs=1e-6)
        assert all(taken[s] == int(target[s] + 1e-9) for s in sizes)
        assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(frame.repartition(7)).collect()))
    assert mixing.mix(no_docs).count() == 0
    assert sum(r.size for r in mixing.mix(docs).collect()) == sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in docs.collect())
