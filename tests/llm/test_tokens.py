"""BPE by pieces and tree joins, and Re-Pair shards, against the library itself."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shelfmark.llm import bpe, repair, wordbpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text_as_the_library(text):
    own = wordbpe.load(PATH)
    ids, counts = own.encode([text, "between", text])
    want = own.library.encode(text, add_special_tokens=False).ids
    assert ids[: counts[0]].tolist() == want and ids[len(ids) - counts[2] :].tolist() == want
    assert own.decode(ids[: counts[0]]) == own.library.decode(want, skip_special_tokens=False)


def test_every_plain_character_as_the_library(library):
    own = wordbpe.load(PATH)
    for code in [*range(1, 0x250), 0x300, 0x301, 0x3A3, 0x2028, 0x3000, 0xFB01]:
        text = f"a{chr(code)}b {chr(code)}{chr(code)}1 x'{chr(code)}'s A{chr(code)}"
        assert own.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids, hex(code)


@pytest.mark.parametrize("letters", ["ab", "thean", "abcdefghijklmnop", "éàß", "=-!"])
@pytest.mark.parametrize("leaf", [1, 3, 16, 128])
def test_tree_joins_agree_with_whole_pieces(letters, leaf):
    own = wordbpe.load(PATH)
    rng = random.Random(leaf)
    for _ in range(15):
        piece = wordbpe.mapped("".join(rng.choice(letters) for _ in range(rng.randint(1, 1500))))
        assert own.tree(piece, leaf) == [t.id for t in own.library.model.tokenize(piece)]


@pytest.mark.parametrize("long_chars", [bpe.LONG_CHARS, 40])
def test_encode_awkward(spark, library, awkward, no_docs, long_chars):
    got = sorted((r.doc_id is None, r.doc_id or 0, tuple(r.ids), r.decoded) for r in bpe.encode(awkward, PATH, long_chars=long_chars, cut_chars=50).collect())
    want = []
    for r in awkward.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id is None, r.doc_id or 0, tuple(ids), library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)
    assert bpe.encode(no_docs, PATH).count() == 0


def test_one_long_unsplit_text_over_several_tasks(spark, library, make_docs):
    rng = random.Random(7)
    texts = ["".join(rng.choice("thandrei") for _ in range(9000)) + " end <|endoftext|>" * (k % 2) for k in range(4)]
    got = {r.doc_id: r.ids for r in bpe.encode(make_docs(texts), PATH, long_chars=1000, cut_chars=700).collect()}
    assert got == {i: library.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), max_size=40), min_size=1, max_size=6))
def test_shards_give_back_every_document_and_id(docs):
    docs = [[*d, 1] for d in docs]
    counts = np.array([len(d) for d in docs])
    shard = repair.Shard(repair.pack(np.arange(len(docs)), counts, np.concatenate([np.array(d, np.int32) for d in docs])))
    for k, d in enumerate(docs):
        assert shard.document(k).tolist() == d
        assert [shard.id_at(k, i) for i in range(len(d))] == d
        with pytest.raises(IndexError):
            shard.id_at(k, len(d))
    assert shard.all().tolist() == [x for d in docs for x in d]


def test_repeated_runs_shrink_and_rules_count_their_ids():
    ids = np.tile(np.array([5, 6, 7, 8], np.int32), 3000)
    shard = repair.Shard(repair.pack(np.array([1]), np.array([len(ids)]), ids))
    assert shard.n_symbols < len(ids) / 100 and (shard.all() == ids).all()
    whole = [shard._decode(np.array([shard.first_rule + k])) for k in range(len(shard.rules))]
    assert [len(x) for x in whole] == shard.lengths.tolist()


@pytest.mark.parametrize("frequent", [1 / 64, 1 / 1024, 0.0])
def test_repair_leaves_no_frequent_pair(frequent):
    rng = np.random.default_rng(3)
    docs = [np.concatenate([rng.integers(0, 30, rng.integers(0, 40)), np.arange(40, 60), np.full(rng.integers(0, 30), 7)]) for _ in range(80)] + [np.zeros(0, np.int64)]
    counts = np.array([len(d) for d in docs])
    ids = np.concatenate(docs).astype(np.int32)
    seq, rules, ends = repair.compress(ids, np.cumsum(counts), 60, frequent)
    left = Counter(p for d in np.split(seq, ends[:-1]) for p in zip(d[:-1].tolist(), d[1:].tolist(), strict=True))
    assert max(left.values()) < max(4, int(len(seq) * frequent))
    shard = repair.Shard(repair.pack(np.arange(len(docs)), counts, ids, frequent))
    assert (shard.all() == ids).all() and len(rules) == len(shard.rules)
    assert all((shard.document(k) == d).all() for k, d in enumerate(docs))
    assert [shard.id_at(5, k) for k in range(counts[5])] == docs[5].tolist()


@pytest.mark.parametrize("width", [1, 5, 16, 17, 31, 32])
def test_symbols_are_read_by_bit_offset(width):
    values = np.random.default_rng(width).integers(0, 1 << width, 70_001).astype(np.uint32)
    data = repair.pack_bits(values, width)
    assert len(data) == (len(values) * width + 7) // 8 + 8
    for first, stop in ((0, len(values)), (65_535, 65_540), (69_999, 70_001), (3, 3)):
        assert (repair.unpack_bits(data, width, first, stop) == values[first:stop]).all()


@pytest.mark.parametrize("shard_ids", [repair.SHARD_IDS, 50])
def test_written_and_read_back(spark, library, awkward, no_docs, tmp_path, shard_ids):
    folder = f"file://{tmp_path}/shards"
    repair.write(awkward, folder, PATH, 1, shard_ids=shard_ids)
    got = repair.read_documents(spark, folder).orderBy("start").collect()
    rows = awkward.collect()
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in rows), key=lambda i: (i is not None, i))
    assert sum(r.n_tokens for r in got) == got[-1].start + got[-1].n_tokens
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens

    def one(text):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        return len(ids), zlib.crc32(ids.tobytes())

    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted((r.doc_id is None, r.doc_id or 0, *one(r.text)) for r in rows)
    repair.write(no_docs, f"file://{tmp_path}/none", PATH, 1)
    assert repair.read_documents(spark, f"file://{tmp_path}/none").count() == 0
