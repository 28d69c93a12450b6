"""Token ids of whole texts with a public tokenizer.

The vocabulary's rules for pieces never join across white space, and they part
ASCII letters from ASCII punctuation and every ASCII digit from what stands
beside it (only an apostrophe may belong to the letters behind it). They also
lower-case. So a text is cut there first, over the bytes of many texts at once;
its ids are those of its pieces one after the other. Pieces repeat: Arrow finds
the different ones of a group of texts, and each worker keeps the ids of those
it has met, ``KEPT`` at most. A store that is full drops its older half.
"""

from __future__ import annotations

import os
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that a worker keeps (about 170 bytes each), and the longest one kept.
KEPT, LONGEST = 500_000, 48
#: Words that the tokenizer gets at once, and bytes of a group of texts.
JOINED, GROUP_BYTES = 500, 8_000_000
END_ID = 1

_WHITE, _LETTER, _DIGIT, _MARK, _QUOTE, _OTHER = range(6)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def _class(b: int) -> int:
    if b == 32 or 9 <= b <= 13:
        return _WHITE
    if 97 <= b <= 122:
        return _LETTER
    if 48 <= b <= 57:
        return _DIGIT
    if b == 39:
        return _QUOTE
    return _MARK if 33 <= b <= 126 else _OTHER


_CLASS = np.array([_class(b) for b in range(256)], np.uint8)
#: Whether a piece begins between two classes, by 8 * left + right.
_BREAK = np.zeros(64, bool)
for _left, _rights in {
    _WHITE: (_LETTER, _DIGIT, _MARK, _QUOTE, _OTHER),
    _LETTER: (_DIGIT, _MARK, _QUOTE),
    _DIGIT: (_LETTER, _DIGIT, _MARK, _QUOTE),
    _MARK: (_LETTER, _DIGIT),
    _QUOTE: (_DIGIT,),
}.items():
    _BREAK[[8 * _left + r for r in _rights]] = True


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: bytes that print stand for themselves, the
    others for the characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return dict(zip(shown, shown, strict=True)) | {b: 256 + k for k, b in enumerate(rest)}


_BYTE_LETTERS = _byte_letters()


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The pieces of all texts (large strings), one after the other, and how
    many lie before each text and in all."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    low = _LOWER[raw]
    cls = _CLASS[low]
    begins = np.empty(len(cls), bool)
    begins[:1] = cls[:1] != _WHITE
    begins[1:] = _BREAK[cls[:-1] * np.uint8(8) + cls[1:]]
    first = offsets[:-1] - offsets[0]
    first = first[first < len(cls)]
    begins[first] = cls[first] != _WHITE
    # A capital may compose with a mark behind it where the small letter does not.
    apart = np.flatnonzero((cls[1:] == _OTHER) & ~begins[1:] & (low[:-1] != raw[:-1]))
    low[apart] = raw[apart]
    keep = cls != _WHITE
    data = low[keep]
    at = np.flatnonzero(begins[keep])
    ends = np.append(at, len(data)).astype(np.int64)
    found = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(data))
    before = np.searchsorted(np.flatnonzero(begins), offsets - offsets[0])
    return found, before


class PieceEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        # Words of lower-case letters pass the normalizer and the rules for
        # pieces unchanged, so in the byte-level alphabet the same vocabulary
        # without these will do.
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer, self.bare.pre_tokenizer = None, WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.long: dict[str, bytes] = {}

    def _whole(self, items: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(items, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _words(self, words: list[str], items: list[str]) -> list[bytes]:
        """Of ``words`` of letters; ``items``: in the byte-level alphabet."""
        ids = np.array(self.bare.encode_batch_fast([" ".join(items)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(items):
            return self._whole(words)
        data, at = ids.tobytes(), (4 * np.r_[0, ends]).tolist()
        return [data[a:b] for a, b in zip(at, at[1:], strict=False)]

    def _learn(self, new: list[str]) -> None:
        words, items, others = [], [], []
        for piece in new:
            if piece.isascii():
                if piece.isalpha():  # lower-cased before
                    words.append(piece)
                    items.append(piece)
                else:
                    others.append(piece)
            elif piece.isalpha() and piece == piece.lower() and unicodedata.is_normalized("NFC", piece):
                words.append(piece)
                items.append(piece.encode().decode("latin-1").translate(_BYTE_LETTERS))
            else:
                others.append(piece)
        for k in range(0, len(words), JOINED):
            part = words[k : k + JOINED]
            self._keep(part, self._words(part, items[k : k + JOINED]))
        for k in range(0, len(others), 4096):
            part = others[k : k + 4096]
            self._keep(part, self._whole(part))

    def _keep(self, found: list[str], ids: list[bytes]) -> None:
        self.known.update(zip(found, ids, strict=True))
        for piece in [c for c in found if len(c) > LONGEST]:
            self.long[piece] = self.known.pop(piece)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        if len(self.known) > KEPT:
            self.known = dict(list(self.known.items())[KEPT // 2 :])
        self.long.clear()
        each, before = pieces(texts)
        coded = each.dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        got = list(map(self.known.get, names))
        if new := [c for c, g in zip(names, got, strict=True) if g is None]:
            self._learn(new)
            got = [self.known.get(c) or self.long.get(c, b"") if g is None else g for c, g in zip(names, got, strict=True)]
        flat = np.frombuffer(b"".join(got), "<u4")
        sizes = np.fromiter(map(len, got), np.int32, len(got)) // 4
        begins = np.cumsum(sizes, dtype=np.int32) - sizes
        code = coded.indices.to_numpy()
        n = sizes[code]
        ends = np.cumsum(n, dtype=np.int32)  # a group has well under 2^31 ids
        ids = flat[np.arange(len(n) and ends[-1], dtype=np.int32) + np.repeat(begins[code] - (ends - n), n)]
        cut = np.r_[0, ends][before].tolist()
        return [ids[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)]


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """One for each worker process and vocabulary."""
    return PieceEncoder(path)


def encode_documents(path: str, texts: pa.Array | list[str | None], end_id: int = END_ID) -> Iterator[np.ndarray]:
    """Ids of each text (null: empty) with the end id behind, as '<u4' arrays."""
    enc, end = encoder(path), np.array([end_id], "<u4")
    whole = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()), "").cast(pa.large_string())
    ends = np.cumsum(pc.binary_length(whole).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < len(whole):
        done = ends[begin - 1] if begin else 0
        stop = max(int(np.searchsorted(ends, done + GROUP_BYTES)), begin + 1)
        group = whole[begin:stop]
        # Texts that may hold a special token are not cut.
        special = np.flatnonzero(pc.match_substring(group, "<|").to_numpy(zero_copy_only=False)).tolist()
        apart = {k: np.frombuffer(enc._whole([group[k].as_py()])[0], "<u4") for k in special}
        for k, ids in enumerate(enc.encode(group)):
            yield np.concatenate((apart.get(k, ids), end))
        begin = stop
