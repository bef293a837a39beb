"""Token ids by the tokenizers library, with a bounded memory of words already seen.

Both vocabularies cut texts at white space before merging, so the ids of a text are the ids of its
words in order. A batch's words are hashed, looked up and put together by numpy; the library is asked
once per word and worker, for many words at a time. Two 64-bit hashes tell words apart.

Texts that hold the string of one of the vocabulary's added tokens go to the library whole, as it
looks for these before anything else.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

import numpy as np
import pandas as pd

from .common import hold_memory, mix

# so many words are held at most, about 70 bytes each; then the memory starts anew.
MEMORY_WORDS = 2_500_000
# Longer words are encoded each time.
LONGEST = 64
JOINED = 16

_encoders: dict[str, "_Encoder"] = {}
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
# White space other than space and line feed: single bytes, and longer ones by their first bytes and the range of the last.
_CONTROL = np.zeros(256, bool)
_CONTROL[[9, 11, 12, 13, 28, 29, 30, 31]] = True
_WIDE = (
    (b"\xc2", 0x85, 0x85), (b"\xc2", 0xA0, 0xA0), (b"\xe1\x9a", 0x80, 0x80), (b"\xe2\x80", 0x80, 0x8A), (b"\xe2\x80", 0xA8, 0xA9),
    (b"\xe2\x80", 0xAF, 0xAF), (b"\xe2\x81", 0x9F, 0x9F), (b"\xe3\x80", 0x80, 0x80),
)
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def vocabulary_path(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of runs that begin at ``starts``, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def hash_spans(buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each span of at most ``LONGEST`` bytes, eight bytes at a time."""
    padded = np.concatenate([buffer, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(buffer) + 1,), "<u8", padded, strides=(1,))  # from any byte on
    a = sizes.astype(np.uint64) * _ODD[2] + seed
    b = a ^ _ODD[1]
    live = np.arange(len(starts))
    for at in range(0, LONGEST, 8):
        live = live[sizes[live] > at]
        if not len(live):
            break
        left = np.minimum(sizes[live] - at, 8).astype(np.uint64)
        part = eights[starts[live] + at] & (~np.uint64(0) >> (np.uint64(64) - left * np.uint64(8)))
        a[live] = mix(a[live] + part * _ODD[0])
        b[live] = mix((b[live] ^ part) * _ODD[1])
    return a, b


class _Memory:
    """Ids of words by their hashes."""

    def __init__(self, most: int):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.old, self.new = pd.Index(np.zeros(0, np.uint64)), pd.Index(np.zeros(0, np.uint64))
        self.check, self.starts, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.parts: list[np.ndarray] = []
        self.flat = np.zeros(0, np.uint16)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of each word, -1 if it is not known."""
        at = self.old.get_indexer(a)
        gaps = np.flatnonzero(at < 0)
        if len(gaps) and len(self.new):
            later = self.new.get_indexer(a[gaps])
            at[gaps] = np.where(later < 0, -1, later + len(self.old))
        hit = np.flatnonzero(at >= 0)
        at[hit[self.check[at[hit]] != b[hit]]] = -1
        return at

    def ids(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.flat[ragged(self.starts[at], self.sizes[at])], self.sizes[at]

    def add(self, a: np.ndarray, b: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> None:
        taken = (self.old.get_indexer(a) >= 0) | (self.new.get_indexer(a) >= 0)
        if taken.any():  # another word has this first hash
            keep = ~taken
            flat, a, b, sizes = flat[np.repeat(keep, sizes)], a[keep], b[keep], sizes[keep]
        if len(self.check) + len(a) > self.most:
            self.clear()
            if len(a) > self.most:
                return
        starts = np.cumsum(sizes) - sizes + len(self.flat)
        self.check, self.starts, self.sizes = (np.concatenate(p) for p in ((self.check, b), (self.starts, starts), (self.sizes, sizes)))
        self.flat = np.concatenate([self.flat, flat])
        self.new = pd.Index(np.concatenate([self.new.to_numpy(), a]))
        if len(self.new) > max(1 << 15, len(self.old) // 4):
            self.old, self.new = pd.Index(np.concatenate([self.old.to_numpy(), self.new.to_numpy()])), pd.Index(np.zeros(0, np.uint64))


class _Encoder:
    """Base: a vocabulary file, and the ids of words that are cut out of a buffer."""

    sentinel = ""  # parts words, and is one id that no word without it has

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread a task
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        if self.library.get_vocab_size(with_added_tokens=True) > 1 << 16:
            raise ValueError("only vocabularies of 16-bit ids")
        self.kind = np.uint16
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.marks = np.zeros(256, np.uint16)
        for mark in ".,":
            (self.marks[ord(mark)],) = self.one(mark)
        (self.border,) = self.one(self.sentinel)
        self.memory = _Memory(MEMORY_WORDS)

    def one(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts by the library itself."""
        return [np.array(e.ids, self.kind) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def has_added(self, text) -> bool:
        return any((t if isinstance(text, str) else t.encode()) in text for t in self.added)

    def joined(self, words: list[str]) -> str:
        raise NotImplementedError

    def learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words (as they stand in a text), one after the other, and how many each has."""
        plain = [n for n, w in enumerate(words) if len(w) <= LONGEST and self.sentinel not in w[1:]]
        out: list[np.ndarray | None] = [None] * len(words)
        groups = [plain[i : i + JOINED] for i in range(0, len(plain), JOINED)]
        for group, ids in zip(groups, self.whole([self.joined([words[n] for n in group]) for group in groups])):
            cut = np.flatnonzero(ids == self.border)
            if len(cut) == len(group):  # else something else has that id: one by one
                for n, a, b in zip(group, cut + 1, np.append(cut[1:], len(ids))):
                    out[n] = ids[a:b]
        rest = [n for n, ids in enumerate(out) if ids is None]
        for n, ids in zip(rest, self.alone([words[n] for n in rest])):
            out[n] = ids
        sizes = np.fromiter(map(len, out), np.int64, len(out))
        return (np.concatenate(out) if out else np.zeros(0, self.kind)), sizes

    def alone(self, words: list[str]) -> list[np.ndarray]:
        return self.whole(words)

    def words(self, buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, spaced: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words at these spans, and how many each has; ``spaced`` ones come with a space before."""
        sizes = ends - starts
        # Letters and the mark after them are cut apart by both vocabularies.
        last = buffer[ends - 1]
        before = buffer[ends - 2]
        latin = (buffer[ends - 3] == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7) & (sizes > 2)
        marked = (sizes > 1) & (self.marks[last] > 0) & (_LETTER[before] | latin)
        sizes = sizes - marked
        short = sizes <= LONGEST
        a, b = hash_spans(buffer, starts, np.minimum(sizes, LONGEST), spaced.astype(np.uint64))
        # Long words, and one that shares only its first hash with another, get a number of their own.
        code, kinds = pd.factorize(a)
        first = np.full(len(kinds), len(a))
        np.minimum.at(first, code, np.arange(len(a)))
        own = np.flatnonzero(~short | (b[first[code]] != b) | ~short[first[code]])
        code[own] = len(kinds) + np.arange(len(own))
        at = self.memory.find(a[first], b[first])
        at[~short[first]] = -1
        known, unknown = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
        asked = np.concatenate([first[unknown], own])
        raw = buffer.tobytes()
        texts = [raw[i : i + n].decode() for i, n in zip(starts[asked].tolist(), sizes[asked].tolist())]
        flat, counts = self.learn([" " + t if s else t for t, s in zip(texts, spaced[asked].tolist())])
        old, old_counts = self.memory.ids(at[known])
        every = np.concatenate([old, flat])
        run = np.concatenate([old_counts, counts])
        begin = np.cumsum(run) - run
        place = np.empty(len(kinds) + len(own), np.int64)
        place[np.concatenate([known, unknown, len(kinds) + np.arange(len(own))])] = np.arange(len(place))
        kept = short[first[unknown]]
        n = len(unknown)
        self.memory.add(a[first[unknown]][kept], b[first[unknown]][kept], flat[: counts[:n].sum()][np.repeat(kept, counts[:n])], counts[:n][kept])
        took = place[code]
        full = run[took] + marked
        out = np.empty(int(full.sum()), self.kind)
        target = ragged(np.cumsum(full) - full, run[took])
        out[target] = every[ragged(begin[took], run[took])]
        out[(np.cumsum(full) - 1)[marked]] = self.marks[last[marked]]
        return out, full


def _spans(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the texts, begin and end of each word, and the text of each word."""
    buffer = np.frombuffer(b"\n".join(texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    solid = (~_SPACE[buffer]).astype(np.int8)
    edge = np.diff(solid, prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return buffer, starts, ends, np.searchsorted(np.cumsum(sizes), starts, side="right")


def _uneven(buffer: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Numbers of the joined texts with white space that is not one space or line feed between words."""
    plain = (buffer == 32) | (buffer == 10)
    pair = plain[:-1] & plain[1:]
    ends = np.cumsum(sizes) - 1  # of the line feeds that join the texts
    joints = ends[:-1]
    pair[joints[joints < len(pair)]] = False
    pair[joints[joints > 0] - 1] = False
    found = [np.flatnonzero(_CONTROL[buffer]), np.flatnonzero(pair)]
    high = np.flatnonzero(buffer >= 0xC2)
    for lead, low, most in _WIDE:
        at = high[buffer[high] == lead[0]]
        at = at[at + len(lead) < len(buffer)]
        for n, byte in enumerate(lead[1:], 1):
            at = at[buffer[at + n] == byte]
        tail = buffer[at + len(lead)]
        found.append(at[(tail >= low) & (tail <= most)])
    return np.unique(np.searchsorted(ends, np.concatenate(found)))


def _cut(ids: np.ndarray, sizes: np.ndarray, owner: np.ndarray, n: int) -> list[np.ndarray]:
    """Ids of each of ``n`` texts out of those of their words."""
    ends = np.cumsum(np.bincount(owner, sizes, n).astype(np.int64))
    return [ids[a:b] for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist())]


class SpacedWords(_Encoder):
    """Vocabularies that drop white space: a text's ids are its words' ids."""

    sentinel = "\N{COPYRIGHT SIGN}"

    def joined(self, words: list[str]) -> str:
        return f"{self.sentinel} " + f" {self.sentinel} ".join(words)

    def learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # Such a word has the border's id itself.
        odd = [n for n, w in enumerate(words) if self.sentinel in w]
        if not odd:
            return super().learn(words)
        flat, sizes = super().learn(["" if self.sentinel in w else w for w in words])
        parts = np.split(flat, np.cumsum(sizes)[:-1])
        for n, ids in zip(odd, self.whole([words[n] for n in odd])):
            parts[n], sizes[n] = ids, len(ids)
        return np.concatenate(parts), sizes

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        if not texts:
            return []
        special = [n for n, t in enumerate(texts) if b"<|" in t and self.has_added(t)]
        given = list(texts)
        for n in special:
            given[n] = b""
        buffer, starts, ends, owner = _spans(given)
        ids, sizes = self.words(buffer, starts, ends, np.zeros(len(starts), bool)) if len(starts) else (np.zeros(0, self.kind), np.zeros(0, np.int64))
        out = _cut(ids, sizes, owner, len(texts))
        for n, own in zip(special, self.whole([texts[n].decode() for n in special])):
            out[n] = own
        return out


class ByteWords(_Encoder):
    """Byte-level vocabularies that keep white space and tie one space to the word after it.

    A text whose words are parted by one space or one line feed each is the sequence of its words,
    each with the space before it, and of its line feeds. Any other text goes to the library whole.
    """

    sentinel = "\n"

    def __init__(self, path: str):
        super().__init__(path)
        self.tails = {b" ": self.one(" "), b"\n": self.one("\n")}

    def joined(self, words: list[str]) -> str:
        return "\n" + "\n".join(words)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        given = [t.encode() for t in texts]
        size = np.fromiter(map(len, given), np.int64, len(given)) + 1
        whole = _uneven(np.frombuffer(b"\n".join(given), np.uint8), size).tolist()
        whole += [n for n, t in enumerate(texts) if "<|" in t and self.has_added(t) and n not in set(whole)]
        for n in whole:
            given[n], size[n] = b"", 1
        buffer, starts, ends, owner = _spans(given)
        if len(starts):
            before = buffer[np.maximum(starts - 1, 0)]
            # The first word of a text may have nothing before it.
            head = starts == (np.cumsum(size) - size)[owner]
            spaced = (before == 32) & ~head
            fed = (before == 10) & ~head
            ids, sizes = self.words(buffer, starts, ends, spaced)
            if fed.any():
                full = sizes + fed
                lined = np.full(int(full.sum()), self.border, self.kind)
                lined[ragged(np.cumsum(full) - full + fed, sizes)] = ids
                ids, sizes = lined, full
        else:
            ids, sizes = np.zeros(0, self.kind), np.zeros(0, np.int64)
        out = _cut(ids, sizes, owner, len(texts))
        for n, t in enumerate(given):
            if t[-1:] in self.tails:  # white space that no word follows
                out[n] = np.concatenate([out[n], self.tails[t[-1:]]])
        for n, own in zip(whole, self.whole([texts[n] for n in whole])):
            out[n] = own
        return out


def encoder(kind: type[_Encoder], path: str):
    """The worker's encoder of a vocabulary file, loaded once."""
    hold_memory(f"tokens {path}", lambda: _encoders.pop(path, None))
    if path not in _encoders:
        _encoders[path] = kind(path)
    return _encoders[path]
