"""Token counts against the tokenizers library."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from shelfmark.llm import token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    return token_counts.load(PATH)


def test_texts_as_the_library(library, counter):
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzABCÄÖÜßéñ  \n\t.,;:'0123456789日本Σς́ẞ\x00\x1c\x85İ😀"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    texts += ["it's we're i'll 'tis", "<|startoftext|>", "a<|endoftext|>b <|startoftext|><|startoftext|> c", "<|STARTOFTEXT|>", "<|endoftext|", "é", "word<|endoftext|>́x"]
    for t in texts:
        assert counter.count(t) == len(library.encode(t, add_special_tokens=False).ids), t


def test_long_pieces_and_windows(library, counter, monkeypatch):
    rng = random.Random(6)
    texts = ["a" * 9001, "ab" * 5000, "".join(rng.choice("etaoinshr") for _ in range(20000)), "日本語" * 3000, "!?" * 4000 + "x" * 5000, "7" * 5000]
    texts.append("".join(rng.choice("zqxjvkéñ") for _ in range(30000)))
    monkeypatch.setattr(token_counts, "LONG", 100)
    monkeypatch.setattr(token_counts, "RUN", 512)
    monkeypatch.setattr(token_counts, "WINDOW", 64)
    texts.append(" ".join("".join(rng.choice("abcé'") for _ in range(rng.randint(1, 30))) for _ in range(2000)))
    for t in texts:
        assert counter.count(t) == len(library.encode(t, add_special_tokens=False).ids), t[:20]


def test_rows(spark, make_docs, awkward, no_docs, library):
    got = sorted(map(str, token_counts.count(awkward, PATH).collect()))
    rows = [(r.doc_id, r.text or "") for r in awkward.collect()]
    want = [f"Row(doc_id={i!r}, n_bytes={len(t.encode())}, n_tokens={len(library.encode(t, add_special_tokens=False).ids)})" for i, t in rows]
    assert got == sorted(want)
    assert token_counts.count(no_docs, PATH).count() == 0
