"""Language, toxicity and quality: accuracy on unseen texts, known values, awkward inputs."""

import random

import numpy as np
import pandas as pd
import pytest

from shelfmark.llm import language, quality, toxicity

WORDS = {
    "en": "the of and to in that was with for are this from have not they which were would there been one all their".split(),
    "de": "der die und das von den mit ist des sich auf dem nicht eine als auch nach wie werden aus bei einer durch".split(),
    "fr": "le les des une est dans que pour qui sur pas plus avec ce par sont mais comme nous tout elle leur aux".split(),
}


def sentence(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def trees(spark):
    rng = random.Random(1)
    rows = [(i, sentence(rng, x, 60), x) for i in range(150) for x in WORDS]
    return language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_language_of_unseen_texts(spark, trees, make_docs):
    rng = random.Random(2)
    want = {i: list(WORDS)[i % 3] for i in range(60)}
    docs = make_docs([sentence(rng, x, 12) for x in want.values()])
    got = {r.doc_id: r for r in language.predict(docs, trees).collect()}
    assert {i: r.lang_pred for i, r in got.items()} == want
    assert all(0.5 < r.score <= 1 for r in got.values())


def slow_bits(pairs, lang, text):
    """Code length by the definition: longest context first, escape by escape."""
    data, starts = language.symbols([text])
    data = data[starts[0] :].tolist()
    counts = {(s, g): n for x, s, g, n in pairs.itertuples(index=False) if x == lang}
    after = {}
    for (s, g), n in counts.items():
        total, kinds = after.get((s - 1, g >> 8), (0, 0))
        after[s - 1, g >> 8] = (total + n, kinds + 1)
    bits = 0.0
    for i in range(language.ORDER, len(data)):
        for order in range(language.ORDER, -1, -1):
            context = int.from_bytes(bytes(data[i - order : i]), "big")
            n = counts.get((order + 1, context << 8 | data[i]), 0)
            total, kinds = after.get((order, context), (0, 0))
            if n:
                bits -= np.log2(n / (total + kinds))
                break
            if total:
                bits -= np.log2(kinds / (total + kinds))
        else:
            bits += 8
    return bits


def test_code_lengths_follow_the_definition():
    rows = []
    for lang, text in (("a", "abracadabra abrakadabra cab"), ("b", "bananas and ananas in cabanas")):
        data, starts = language.symbols([text])
        for i in range(language.ORDER, len(data)):
            for size in range(1, language.ORDER + 2):
                rows.append((lang, size, int.from_bytes(bytes(data[i - size + 1 : i + 1].tolist()), "big"), 1))
    pairs = pd.DataFrame(rows, columns=["lang", "size", "gram", "n"]).groupby(["lang", "size", "gram"], as_index=False)["n"].sum()
    trees = language.compile_trees(pairs)
    for text in ("abracadabra", "banana cab", "zzz", "cabanas & abra!", ""):
        got, _ = trees.lengths([text, "padding text", text])
        assert got[0] == pytest.approx(got[2])
        assert got[0] == pytest.approx([slow_bits(pairs, x, text) for x in trees.languages], rel=1e-5, abs=1e-5)


def test_long_texts_are_coded_in_stretches(spark, trees, monkeypatch):
    rng = random.Random(5)
    texts = [sentence(rng, "en", n) for n in (3, 400, 1, 0, 90, 2, 700)]
    whole, symbols = trees.lengths(texts)
    monkeypatch.setattr(language, "SCORED_BYTES", 64)
    data, starts = language.symbols(texts)
    stretches = list(language.pieces(data, starts, 64))
    assert len(stretches) > 50 and max(len(d) - language.ORDER * (len(b) - 1) for d, b, _ in stretches) <= 64
    got, n = trees.lengths(texts)
    assert got == pytest.approx(whole, rel=1e-5) and n.tolist() == symbols.tolist()
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    parts = language.learn(docs, once_from=language.ORDER + 1)
    monkeypatch.undo()
    once = language.learn(docs, once_from=language.ORDER + 1)
    assert parts.lengths(texts)[0] == pytest.approx(once.lengths(texts)[0], rel=1e-5)
    pruned, full = language.learn(docs), once
    assert sum(len(c) for c in pruned.blocks[0].cost) < sum(len(c) for c in full.blocks[0].cost)


def test_every_language_is_learnt_whole(spark):
    rng = random.Random(8)
    rows = [(i, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=600)) * 2, f"l{i:04}") for i in range(1010)]
    rows.append((1010, "zyx wvut " * 3, "rare"))  # the last by any count
    learnt = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(learnt.languages) == sorted(lang for _, _, lang in rows)
    docs = spark.createDataFrame(rows[-30:], "doc_id long, text string, lang string")
    got = language.predict(docs, learnt, keep=("lang",)).collect()
    assert all(r.lang_pred == r.lang for r in got)
    # a tree holds what it would hold if no other language were there
    alone = language.learn(docs.where("lang = 'rare'"))
    at = learnt.languages.index("rare")
    for text in ("zyx wvut", "zyx other"):
        assert learnt.lengths([text])[0][0, at] == pytest.approx(alone.lengths([text])[0][0, 0])


def test_language_awkward(spark, trees, awkward, no_docs):
    rows = language.predict(awkward, trees, keep=("text", "k0"), prefix="").collect()
    assert len(rows) == awkward.count()
    for r in rows:
        blank = r.text is None or not any(map(str.isalpha, r.text))
        assert (r.lang_pred == "und") == blank and 0 <= r.score <= 1
    assert language.predict(no_docs, trees).count() == 0
    none = language.learn(no_docs)
    assert {(r.lang_pred, r.score) for r in language.predict(awkward, none).collect()} == {("und", 0.0)}
    learnt = language.learn(awkward)
    assert set(learnt.languages) <= {"en", "de"}


def insult_docs(rng, n):
    rows, labels = [], []
    for i in range(n):
        text = sentence(rng, "en", 80) + " " + " ".join(rng.choice("abcdefgh") * 3 + str(rng.randrange(400)) for _ in range(20))
        toxic = rng.random() < 0.15
        if toxic:
            text += " you " + rng.choice(["blockhead", "dunderhead", "nincompoops", "nincompooped"])
        rows.append((i, text))
        if rng.random() < 0.5:
            labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity_of_unseen_texts(spark, make_labels):
    rows, labels = insult_docs(random.Random(3), 1500)
    scorer = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string"), make_labels(labels))
    unseen, _ = insult_docs(random.Random(4), 600)
    truth = {i: any(w in t for w in ("blockhead", "dunderhead", "nincompoop")) for i, t in unseen}
    got = {r.doc_id: r.score >= 0.5 for r in toxicity.score(spark.createDataFrame(unseen, "doc_id long, text string"), scorer).collect()}
    assert np.mean([got[i] == truth[i] for i in truth]) > 0.98


def by_hand(z, positive, prior):
    """The risk as defined, texts one by one."""
    loss = lambda v: float(np.log1p(np.exp(-v)))
    of_p = [v for v, x in zip(z, positive, strict=True) if x]
    of_u = [v for v, x in zip(z, positive, strict=True) if not x]
    first = prior * sum(map(loss, of_p)) / len(of_p)
    return first, sum(loss(-v) for v in of_u) / len(of_u) - prior * sum(loss(-v) for v in of_p) / len(of_p)


def test_nnpu_steps_back_when_the_negative_risk_turns_negative():
    rng = np.random.default_rng(0)
    positive = np.arange(40) < 15
    share_p, share_u = positive / 15, ~positive / 25
    for shift, expected in ((2.0, False), (-6.0, True)):
        z = rng.normal(size=40) + np.where(positive, 2, shift)
        first, second, gradient, back = toxicity.risk(z, share_p, share_u, 0.4)
        assert (first, second) == pytest.approx(by_hand(z, positive, 0.4))
        assert back == expected == (second < 0)
        for i in range(40):
            moved = [by_hand(z + d * (np.arange(40) == i), positive, 0.4) for d in (1e-5, -1e-5)]
            slope = [(a - b) / 2e-5 for a, b in zip(*moved, strict=True)]
            # stepping back follows the negative part upwards and leaves the positive part alone
            assert gradient[i] == pytest.approx(-slope[1] if back else slope[0] + slope[1], abs=1e-6)


def test_rare_slurs_have_weight_and_enriched_labels_do_not_shift_the_prior(spark, make_labels):
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(4000):
        text = sentence(rng, "en", 25)
        toxic = rng.random() < 0.25
        if toxic:
            text += " blockhead" if rng.random() < 0.98 else " snollygoster"
        rows.append((i, text))
        if toxic or rng.random() < 1 / 3:  # half of the labels are toxic, a quarter of the texts
            labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = [sentence(rng, "en", 25) for _ in range(200)]
    scorer = toxicity.learn(docs, make_labels(labels))
    assert (scorer.score(clean) < 0.5).mean() > 0.98
    assert (scorer.score([f"{x} blockhead" for x in clean]) >= 0.5).mean() > 0.98
    base, with_rare = scorer.score(clean[:50]), scorer.score([f"{x} snollygoster" for x in clean[:50]])
    assert (with_rare > base + 0.05).all()
    assert toxicity.learn(docs, make_labels(labels), prior=0.6).score(clean).mean() > scorer.score(clean).mean()
    mixture = np.concatenate([rng_normal(3, 1000, 1), rng_normal(3, 500, 2), rng_normal(-3, 1500, 3)])
    is_p = np.arange(3000) < 1000
    assert toxicity.estimate_prior(mixture, is_p, ~is_p) == pytest.approx(0.25, abs=0.03)


def rng_normal(mean, n, seed):
    return np.random.default_rng(seed).normal(mean, 1, n)


def test_toxicity_awkward(spark, awkward, no_docs, make_labels):
    scorer = toxicity.learn(awkward, make_labels([(0, 1, 1), (0, 0, 0), (1, 1, 0), (None, 1, 1), (5, None, None)]))
    scores = toxicity.score(awkward, scorer, keep=("k0", "score"), out="toxic").select("doc_id").count()
    assert scores == awkward.count()
    assert toxicity.score(no_docs, scorer).count() == 0
    for labels in ([], [(1, 1, 0)]):
        never = toxicity.learn(awkward, make_labels(labels))
        assert all(r.score < 0.5 for r in toxicity.score(awkward, never).collect())
    toxicity.learn(no_docs, make_labels([(1, 1, 1)]))


def test_quality_of_unseen_texts(spark, make_labels):
    def build(seed, n):
        rng = random.Random(seed)
        rows, labels = [], []
        for i in range(n):
            good = rng.random() < 0.7
            text = sentence(rng, "en", 120) if good else " ".join(f"{w}{rng.choice(['###', '%%%', '***'])}" for w in sentence(rng, "en", 120).split())
            rows.append((i, text))
            labels.append((i, int(good), 0))
        return rows, labels

    rows, labels = build(5, 400)
    model = quality.learn(spark.createDataFrame(rows, "doc_id long, text string"), make_labels(labels))
    rows, labels = build(6, 200)
    got = {r.doc_id: r.score for r in quality.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert np.mean([(got[i] >= 0.5) == bool(good) for i, good, _ in labels]) > 0.97


def test_quality_learns_from_the_whole_of_long_texts(spark, make_labels):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(60):
        tail = sentence(rng, "en", 4000)
        rows.append((i, sentence(rng, "en", 5000) + " " + (tail if i % 2 else tail.replace(" ", " %%% "))))
        labels.append((i, i % 2, 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.learn(docs, make_labels(labels))
    assert b"%%%" in model.bad and b"%%%" not in model.good
    text = rows[0][1].encode()
    every = [text[i : i + quality.BLOCK] for i in range(0, len(text), quality.BLOCK)]
    assert quality._sampled(text, len(every)) == every and len(quality._sampled(text, 5)) == 5
    assert len(quality.learn(docs, make_labels(labels), per_text=1).bad) < len(model.bad)


def test_quality_awkward(spark, awkward, no_docs, make_labels):
    for labels in ([], [(0, 1, 0)], [(0, 1, 0), (1, 0, 0), (7, 0, 0), (8, 1, 0), (None, 1, 0), (3, None, None)]):
        model = quality.learn(awkward, make_labels(labels))
        rows = quality.score(awkward, model).collect()
        assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.score(no_docs, model).count() == 0
    quality.learn(no_docs, make_labels([(1, 1, 1)]))
