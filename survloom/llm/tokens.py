"""Byte-level BPE over the ``tokenizers`` library: vocabularies, cached encoding, decoding.

Texts are cut before single spaces that stand between other characters. No match
of the splitting pattern crosses such a place and none looks behind it, so the ids
of a text are the ids of its pieces in order, and pieces can be kept in a bounded
cache of a Python worker. The cache only saves time; it is emptied when full.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable

import numpy as np
from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

#: Pieces that one worker keeps; beyond that the cache starts anew.
CACHE_PIECES = 400_000

_CUT = re.compile(r"(?<=\S)(?= \S)")
_UNUSUAL_SPACE = re.compile(r" \s|\s ")
#: Characters whose class (letter, digit, other) is the same in all Unicode versions.
_PLAIN = re.compile("[\\n -~À-ÖØ-öø-ɏ]*").fullmatch
#: How the usual patterns end, and the places where that look-ahead cuts a run.
_LAST_SPACE = r"\s+(?!\S)|\s+"
_WIDE_SPACE = re.compile(r"(?<=[ \n])(?=[ \n][^ \n])")
_WIDE = ("  ", " \n", "\n ", "\n\n")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Fixed values: the printable Latin-1 characters stand for themselves, all other
    bytes take the characters from code point 256 on, in order.
    """
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def read_ranks(lines: bytes) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file (base64, blank, number)."""
    pairs = (line.split() for line in lines.splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


def tokenizer_from_ranks(ranks: dict[bytes, int], pattern: str) -> Tokenizer:
    """A ``tokenizers`` model that merges by rank within each match of ``pattern``.

    The library wants the pair that each token was merged from: it is what is left
    when the token's bytes are merged by all lower ranks.
    """
    chars = byte_characters()
    shown = {token: "".join(chars[b] for b in token) for token in ranks}
    merges = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], rank))
            if ranks.get(parts[best] + parts[best + 1], rank) >= rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        if len(parts) == 2:
            merges.append((shown[parts[0]], shown[parts[1]]))
    made = Tokenizer(models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    made.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    made.decoder = decoders.ByteLevel()
    return made


def load(serialised: str) -> Tokenizer:
    """A tokenizer from its JSON text; special tokens in texts are ordinary text."""
    made = Tokenizer.from_str(serialised)
    made.encode_special_tokens = True
    return made


def token_bytes(tokenizer: Tokenizer) -> list[bytes]:
    """The bytes of each id: the byte table in reverse."""
    back = {c: b for b, c in enumerate(byte_characters())}
    out = [b""] * tokenizer.get_vocab_size(with_added_tokens=True)
    for token, number in tokenizer.get_vocab(with_added_tokens=True).items():
        known = all(c in back for c in token)
        out[number] = bytes(back[c] for c in token) if known else token.encode()
    return out


def pieces(text: str) -> list:
    """Cut a text; a string stands for itself after a space, a 1-tuple for itself alone."""
    if not _UNUSUAL_SPACE.search(text):
        cut: list = text.split(" ")
        cut[0] = (cut[0],)
        return cut
    return [p[1:] if p[:1] == " " else (p,) for p in _CUT.split(text)]


def tokenizers_encoder(tokenizer: Tokenizer) -> Callable[[list[str]], list[list[int]]]:
    """Ids of many strings by the library itself.

    Single words of plain letters are one match of the usual patterns, so they go
    to the merge model directly, without the splitting and alignment around it.
    """
    table = str.maketrans({chr(b): c for b, c in enumerate(byte_characters())})
    word = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ɏ]+").fullmatch
    merge = tokenizer.model.tokenize

    def encode(strings: list[str]) -> list[list[int]]:
        rest = [s for s in strings if not word(s)]
        others = iter(tokenizer.encode_batch_fast(rest, add_special_tokens=False)) if rest else iter(())
        return [
            [t.id for t in merge(s.encode().decode("latin-1").translate(table))] if word(s) else next(others).ids
            for s in strings
        ]

    return encode


def rank_encoder(tokenizer: Tokenizer, pattern: str) -> Callable[[list[str]], list[bytes]]:
    """The same ids of whole texts by rank merging (``tiktoken``), packed; several times faster.

    The ranks are the ids of the tokenizer's own vocabulary. Texts with characters
    outside plain Latin go to the tokenizer itself: the libraries' Unicode versions
    differ in what is a letter.
    """
    import tiktoken

    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    by_bytes = token_bytes(tokenizer)
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    ranks = {by_bytes[n]: n for t, n in vocabulary.items() if t not in special}
    # Without the look-ahead the pattern is a plain automaton. It only matters where a
    # run of white space ends before a word: its last character begins the next match.
    simple = pattern.removesuffix(_LAST_SPACE) + r"\s+" if pattern.endswith(_LAST_SPACE) else pattern
    # The library wants a special token for this call; none is allowed, so none is read.
    made = tiktoken.Encoding("ranks", pat_str=simple, mergeable_ranks=ranks, special_tokens={"<|none|>": len(by_bytes)})

    def merged(text: str) -> bytes:
        return made.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()

    def plain(text: str) -> bytes:
        wide = simple is not pattern and any(w in text for w in _WIDE)
        return b"".join(map(merged, _WIDE_SPACE.split(text))) if wide else merged(text)

    def encode(texts: list[str]) -> list[bytes]:
        return [plain(t) if _PLAIN(t) else packed(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]

    return encode


class CachedEncoder:
    """Encodes texts piece by piece; ``store`` turns a piece's ids into what is kept."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], store: Callable[[list[int]], object]):
        self._encode, self._store, self._cache = encode, store, {}

    def __call__(self, texts: list[str]) -> list[list]:
        """What is kept for each piece, for each text."""
        cut = [pieces(t) for t in texts]
        distinct = set().union(*cut) if cut else set()
        missing = list(distinct.difference(self._cache))
        if len(self._cache) + len(missing) > CACHE_PIECES:
            self._cache, missing = {}, list(distinct)
        strings = [m[0] if isinstance(m, tuple) else " " + m for m in missing]
        self._cache.update(zip(missing, map(self._store, self._encode(strings)), strict=True))
        get = self._cache.__getitem__
        return [list(map(get, c)) for c in cut]


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit numbers."""
    return np.array(ids, "<u4").tobytes()


class Decoder:
    """Bytes of id sequences, and where each id begins in bytes and characters."""

    def __init__(self, tokenizer: Tokenizer):
        table = token_bytes(tokenizer)
        self._length = np.array([len(t) for t in table], np.int64)
        self._start = np.cumsum(self._length) - self._length
        self._flat = np.frombuffer(b"".join(table), np.uint8)

    def __call__(self, ids: np.ndarray) -> bytes:
        """The decoded bytes. A character split between ids is whole again here."""
        length = self._length[ids]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ids) else 0
        return self._flat[np.repeat(self._start[ids] - (ends - length), length) + np.arange(total)].tobytes()

    def offsets(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte of each id, and the character that this byte is part of."""
        length = self._length[ids]
        first = np.cumsum(length) - length
        data = np.frombuffer(self(ids), np.uint8)
        character = np.cumsum((data & 0xC0) != 0x80) - 1
        return first, character[np.minimum(first, max(0, len(data) - 1))] if len(data) else first
