"""Piece-wise use of a tokenizers-library BPE file: pieces, cached piece ids, tree concatenation.

The library's normaliser costs far more than its merges.  A text is therefore cut into
the same pieces its pre-tokenizer makes (the library itself cuts any text with a
character outside the plain set below) and each different piece is merged once by the
library's model and remembered.
"""

from __future__ import annotations

import functools
import json
import operator
import re
import unicodedata
from array import array
from itertools import repeat

import numpy as np
from tokenizers import Tokenizer

# Characters whose lower case, canonical form and class are the same in every Unicode version.
_PLAIN_LAST = 0x17F
_LEAF = 128
_CACHE_MAX = 600_000
# fixed value: the split pattern of the vocabulary file this reader supports
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"


def _of_kind(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(0xA1, _PLAIN_LAST + 1) if unicodedata.category(chr(c))[0] == kind)


_LETTERS = "a-zA-Z" + _of_kind("L")
_NUMBERS = "0-9" + _of_kind("N")
_PIECES = re.compile(rf"{_CONTRACTIONS}|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+")
_UNUSUAL = re.compile(rf"[^\t\n\r -~¡-¬®-įı-{chr(_PLAIN_LAST)}]")


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


_ID = operator.attrgetter("id")
_MAPPED = str.maketrans({chr(b): c for b, c in _byte_letters().items()})


def byte_letter(b: int) -> str:
    return chr(b).translate(_MAPPED)


def mapped(piece: str) -> str:
    return piece if piece.isascii() else piece.encode().decode("latin-1").translate(_MAPPED)


class WordBpe:
    """Ids and token texts of pieces under one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self._whole = self.library.model
        spec["model"]["end_of_word_suffix"] = None
        # the same merges for parts that do not end a piece; kept whole, the model lives in it
        self._inner_library = Tokenizer.from_str(json.dumps(spec))
        self._inner = self._inner_library.model
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.texts = np.empty(max(vocab.values()) + 1, object)
        for text, i in vocab.items():
            self.texts[i] = text
        self._added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self._cache: dict[str, int] = {}
        self._clear()

    def _clear(self) -> None:
        self._cache.clear()
        self._flat, self._bounds = array("i"), array("q", [0])

    # ---- pieces

    def tokens(self, text: str) -> list[str] | None:
        """Parts no piece crosses: lower-case words between white space, or the library's own mapped
        pieces (after a zero character); None if the text holds an added token, which it cuts first."""
        if any(t in text for t in self._added):
            return None
        if _UNUSUAL.search(text):
            norm = self.library.normalizer.normalize_str(text)
            return [f"\0{p}" for p, _ in self.library.pre_tokenizer.pre_tokenize_str(norm)]
        return text.lower().split()

    def pieces(self, token: str) -> list[str]:
        """Mapped pieces of one token."""
        return [token[1:]] if token[0] == "\0" else [mapped(p) for p in _PIECES.findall(token)]

    def ids_of_piece(self, piece: str) -> list[int]:
        return list(map(_ID, self._whole.tokenize(piece))) if len(piece) <= 2 * _LEAF else self.tree(piece)

    def _new(self, token: str) -> int:
        """Merge the pieces of a token not met before; a piece is remembered as a token of its own."""
        cache, flat, bounds = self._cache, self._flat, self._bounds
        if token[0] == "\0":
            flat.extend(self.ids_of_piece(token[1:]))
        else:
            pieces = [token] if token.isalpha() else _PIECES.findall(token)
            if len(pieces) == 1:
                flat.extend(self.ids_of_piece(mapped(token)))
            else:
                known = [cache[p] if p in cache else self._new(p) for p in pieces]
                for n in known:
                    flat.extend(flat[bounds[n] : bounds[n + 1]])
        bounds.append(len(flat))
        n = cache[token] = len(bounds) - 2
        return n

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of ids of each."""
        if len(self._cache) > _CACHE_MAX:
            self._clear()
        tokens: list[str] = []
        whole: list[tuple[int, str]] = []
        ends = np.zeros(len(texts) + 1, np.int64)
        for k, text in enumerate(texts):
            found = self.tokens(text)
            if found is None:
                whole.append((len(tokens), text))
                found = [""]
            tokens += found
            ends[k + 1] = len(tokens)
        cache = self._cache
        numbers = np.fromiter(map(cache.get, tokens, repeat(-1)), np.int64, len(tokens))
        for k in np.flatnonzero(numbers < 0).tolist():
            token = tokens[k]
            if token:
                n = cache.get(token)
                numbers[k] = self._new(token) if n is None else n
        for k, text in whole:
            self._flat.extend(self.library.encode(text, add_special_tokens=False).ids)
            self._bounds.append(len(self._flat))
            numbers[k] = len(self._bounds) - 2
        flat, bounds = np.frombuffer(self._flat or array("i", [0]), np.int32), np.frombuffer(self._bounds, np.int64)
        ids = spread(flat, bounds, numbers)
        so_far = np.concatenate([[0], np.cumsum(bounds[numbers + 1] - bounds[numbers])])
        del flat, bounds  # the arrays can grow again
        return ids, np.diff(so_far[ends])

    def decode(self, ids: np.ndarray) -> str:
        """As the library's decode without skipping special tokens (the file names no decoder)."""
        return " ".join(self.texts[ids])

    # ---- tree concatenation

    def tree(self, piece: str, leaf: int = _LEAF) -> list[int]:
        """Ids of one long mapped piece: leaves first, then joins up a binary tree."""
        parts = [self.leaf(piece[i : i + leaf], i + leaf >= len(piece)) for i in range(0, len(piece), leaf)]
        return self.join_all(parts)

    def leaf(self, part: str, last: bool) -> list[int]:
        model = self._whole if last else self._inner
        return [t.id for t in model.tokenize(part)]

    def join_all(self, parts: list[list[int]]) -> list[int]:
        """Join neighbouring parts pairwise until one is left; the last part ends the piece."""
        while len(parts) > 1:
            odd = parts[-1:] if len(parts) % 2 else []
            last = len(parts) - 2 if not odd else None
            parts = [self.join(parts[i], parts[i + 1], i == last) for i in range(0, len(parts) - 1, 2)] + odd
        return parts[0] if parts else []

    def join(self, left: list[int], right: list[int], last: bool) -> list[int]:
        """Re-encode a window round the join, doubled until it agrees with both sides.

        A sequence of ids is the encoding of its text exactly if each neighbouring pair
        is; so a window that begins with the left side's own id and ends with the right
        side's own id leaves every pair outside it untouched.
        """
        width = 1
        while True:
            width *= 2
            a, b = left[-width:], right[:width]
            ends = last and len(b) == len(right)
            text = self._joined(a, b, ends)
            window = self.leaf(text, ends)
            fits_left = len(a) == len(left) or window[0] == a[0]
            fits_right = len(b) == len(right) or window[-1] == b[-1]
            if fits_left and fits_right:
                return left[: len(left) - len(a)] + window + right[len(b) :]

    def _joined(self, a: list[int], b: list[int], ends: bool) -> str:
        text = "".join(self.texts[i] for i in (*a, *b))
        return text.removesuffix("</w>") if ends else text


def spread(flat: np.ndarray, bounds: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """Concatenation of ``flat[bounds[p]:bounds[p + 1]]`` over the picks."""
    starts, lengths = bounds[picks], bounds[picks + 1] - bounds[picks]
    shift = starts - (np.cumsum(lengths) - lengths)
    return flat[np.repeat(shift, lengths) + np.arange(int(lengths.sum()))]


@functools.lru_cache(2)
def load(path: str) -> WordBpe:
    """One reader a process and file."""
    return WordBpe(path)
