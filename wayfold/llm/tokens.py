"""Token ids of whole texts by the ``tokenizers`` library, with one encoding per distinct piece of text.

A byte-level pre-tokenizer always begins a new pre-token at a single space between two non-space characters, at a single line feed
between two and after it, and at a comma or full stop between a letter or digit and white space; its only look-ahead stops there
too. So texts may be cut at these places and each piece encoded alone. Pieces are found, hashed (64 bits) and looked up with numpy;
those that a worker hasn't met go to the library, many in one call. White space of any other kind is never cut. A special token in a text (<|endoftext|>) gets
its own id, as by the library's default; it holds no place where texts are cut. Ids equal those of the whole text.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

from . import common

DEFAULT_FILE = "byte_bpe_50k.json"
LONGEST = 128
#: Bytes that are encoded at once.
STRETCH = 8 << 20
_BYTES = common.mix64(np.arange(1, 257)) | np.uint64(1)
_PLACES = common.mix64(np.arange(1001, 1001 + LONGEST)) | np.uint64(1)
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[*range(9, 14), *range(28, 33)]] = True
#: First bytes of the characters among which UTF-8 has its other white space.
_LEAD = np.zeros(256, bool)
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_FILE)


def cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where pieces begin, in order: at ``starts`` (of the non-empty texts in ``data``, which begins with one) and at the safe places within."""
    n = len(data)
    edge = np.zeros(n + 3, bool)  # of a text
    edge[starts], edge[n] = True, True
    d = np.concatenate([data, np.full(3, 32, np.uint8)])
    dull = _SPACE[d]
    odd = dull.copy()  # may be white space, or a part of it
    lead = _LEAD[d]
    odd |= lead
    odd[1:] |= lead[:-1]
    odd[2:] |= lead[:-2]
    inner = ~edge[:n]
    before, after = np.ones(n, bool), odd[1 : n + 1] | edge[1 : n + 1]
    before[1:] = odd[: n - 1]
    alone = inner & ~before & ~after
    cut = edge[:n].copy()
    space, feed = d[:n] == 32, d[:n] == 10
    cut |= alone & (space | feed)
    cut[1:] |= (alone & feed)[:-1]
    letter = np.zeros(n, bool)
    letter[1:] = _ALNUM[d[: n - 1]]
    accented = np.zeros(n, bool)
    accented[2:] = (d[: n - 2] == 0xC3) & (d[1 : n - 1] != 0x97) & (d[1 : n - 1] != 0xB7)
    cut |= inner & (letter | accented) & ((d[:n] == 44) | (d[:n] == 46)) & (dull[1 : n + 1] | edge[1 : n + 1])
    return np.flatnonzero(cut)


def stretches(data: np.ndarray, at: np.ndarray, stretch: int, back: int = 1 << 16) -> np.ndarray:
    """``at`` without repeats, with a safe place added about every ``stretch`` bytes of a longer text: the last in the ``back`` bytes before it, or in more of them where there is none."""
    more: list[int] = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        while b - a > stretch:
            end, size = a + stretch, min(back, stretch)
            while True:
                low = max(a, end - size)
                found = cuts(data[low:end], np.zeros(1, np.int64)) + low
                found = found[(found > low + 8) & (found < end - 8)]  # at the ends of what is looked at more than it counts
                if len(found) or low == a:
                    break
                size *= 4
            if not len(found):
                if end + stretch >= b:
                    break
                a_next = end  # no place in a whole stretch: look on from there, the piece grows
                found = cuts(data[a_next : min(b, a_next + stretch)], np.zeros(1, np.int64)) + a_next
                found = found[(found > a_next + 8) & (found < min(b, a_next + stretch) - 8)]
                if not len(found):
                    break
            a = int(found[-1])
            more.append(a)
    return np.unique(np.concatenate([at, np.array(more, np.int64)])).astype(np.int64)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for all tasks of a Python worker: what it has met in one task it knows in the next."""
    return Encoder(path)


class Encoder:
    """``encode(data, at)`` gives ids of ``dtype``: uint16 where the vocabulary fits, else uint32. ``cached`` bounds the pieces remembered."""

    def __init__(self, path: str, cached: int = 2_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.cached = cached
        self.separator, self.separator_id = self._find_separator()
        self._forget()

    def _forget(self) -> None:
        self.known, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted hashes, and which entry each is
        self.ids, self.ends, self.used = np.zeros(1 << 16, self.dtype), np.zeros(1, np.int64), 0

    def _find_separator(self) -> tuple[str, int]:
        """A control character whose id is the only one in the vocabulary that spells it; none where text is changed or cut in other ways."""
        pre = self.tokenizer.pre_tokenizer
        if self.tokenizer.normalizer is None and type(pre).__name__ == "ByteLevel" and not pre.add_prefix_space:
            entries = self.tokenizer.get_vocab(with_added_tokens=True)
            for c in map(chr, (1, 2, 3, 4, 5, 6, 14, 15, 16)):
                e = self.tokenizer.encode(c, add_special_tokens=False)
                if len(e.ids) == 1 and sum(e.tokens[0] in x for x in entries) == 1:
                    return c, e.ids[0]
        return "", -1

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def _each(self, texts: list[str], joined: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts and their numbers: a thousand in one call, told apart by a separator that merges with nothing."""
        sep = self.separator
        if joined:
            ids, counts = [], []
            for k in range(0, len(texts), 1000):
                some = self._plain(sep.join(texts[k : k + 1000]))
                ends = np.append(np.flatnonzero(some == self.separator_id), len(some))
                counts.append(np.diff(ends, prepend=-1) - 1)
                ids.append(np.delete(some, ends[:-1]))
            return np.concatenate(ids), np.concatenate(counts)
        ids = [self._plain(t) for t in texts]
        return np.concatenate(ids), np.array([len(x) for x in ids])

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        odd = [i for i, t in enumerate(texts) if t[-1].isspace() or t[0] == "'" or self.separator in t]
        order = np.concatenate([np.delete(np.arange(len(texts)), odd), np.array(odd, np.int64)]).astype(np.int64)
        k = len(texts) - len(odd)
        for some, joined in ((order[:k], True), (order[k:], False)):
            if len(some):
                ids, counts = self._each([texts[i] for i in some.tolist()], joined)
                while self.used + len(ids) > len(self.ids):
                    self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
                self.ids[self.used : self.used + len(ids)] = ids
                self.used += len(ids)
                place = len(self.ends) - 1 + np.arange(len(some))
                self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(counts)])
                h = hashes[some]
                up = np.argsort(h)
                at = np.searchsorted(self.known, h[up])
                self.known, self.place = np.insert(self.known, at, h[up]), np.insert(self.place, at, place[up])

    def encode(self, data: np.ndarray, at: np.ndarray, end_id: int | None = None, stretch: int = STRETCH) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the ids of text i (bytes at[i] to at[i + 1] of ``data``), with ``end_id`` after each if given, are ids[offsets[i]:offsets[i + 1]].

        Bytes are worked through in stretches, which end between texts or at a place where a text may be cut: beside its ids a long text takes no more room than a stretch.
        """
        data, at = data[at[0] : at[-1]], at - at[0]
        texts = len(at) - 1
        if not self.separator or len(data) <= stretch:
            flat, counts = self._encode(data, at)
        else:
            fine = stretches(data, at, stretch)
            parts, each, i = [], [], 0
            while i < len(fine) - 1:
                j = max(i + 1, int(np.searchsorted(fine, fine[i] + stretch, side="right")) - 1)
                ids, n = self._encode(data[fine[i] : fine[j]], fine[i : j + 1] - fine[i])
                parts.append(ids)
                each.append(n)
                i = j
            flat = np.concatenate(parts)
            counts = np.bincount(np.searchsorted(at, fine[:-1], side="right") - 1, weights=np.concatenate(each), minlength=texts).astype(np.int64)
        if end_id is not None:
            flat = np.insert(flat, np.cumsum(counts), np.array(end_id, self.dtype))
        return flat, np.concatenate([[0], np.cumsum(counts + int(end_id is not None))])

    def _encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each text)."""
        texts = len(at) - 1
        if not self.separator:  # a vocabulary of another kind
            per = [self._plain(data[a:b].tobytes().decode()) for a, b in zip(at[:-1], at[1:], strict=True)]
            counts = np.array([len(x) for x in per], np.int64)
            flat = np.concatenate(per) if per else np.zeros(0, self.dtype)
        elif len(data):
            starts = cuts(data, np.unique(at[:-1][at[1:] > at[:-1]]))
            sizes = np.diff(starts, append=len(data))
            place = np.arange(len(data)) - np.repeat(starts, sizes)
            h = np.add.reduceat(_BYTES[data] * _PLACES[place % LONGEST], starts) + sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            long = np.flatnonzero(sizes > LONGEST)
            h[long] = common.mix64(np.arange(len(long))) | np.uint64(1 << 63)  # not remembered: each its own
            which, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            ids, lengths, begins = self._entries(which, first, starts, sizes, data)
            n = lengths[inverse]
            flat = ids[np.repeat(begins[inverse] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            counts = np.bincount(np.searchsorted(at, starts, side="right") - 1, weights=n, minlength=texts).astype(np.int64)
        else:
            flat, counts = np.zeros(0, self.dtype), np.zeros(texts, np.int64)
        return flat, counts

    def _entries(self, which: np.ndarray, first: np.ndarray, starts: np.ndarray, sizes: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each distinct hash its number of ids and where they begin in the returned store."""
        def find() -> tuple[np.ndarray, np.ndarray]:
            if not len(self.known):
                return np.zeros(len(which), bool), np.zeros(len(which), np.int64)
            k = np.minimum(np.searchsorted(self.known, which), len(self.known) - 1)
            return self.known[k] == which, k

        long = sizes[first] > LONGEST
        have, k = find()
        new = np.flatnonzero(~have & ~long)
        if len(new) and len(self.known) + len(new) > self.cached:
            self._forget()
            new = np.flatnonzero(~long)
        raw = data.tobytes()
        text = lambda i: raw[starts[first[i]] : starts[first[i]] + sizes[first[i]]].decode()
        if len(new):
            self._learn(which[new], [text(i) for i in new.tolist()])
        have, k = find()
        begins, lengths = np.zeros(len(which), np.int64), np.zeros(len(which), np.int64)
        e = self.place[k[~long]] if len(self.place) else np.zeros(0, np.int64)
        begins[~long], lengths[~long] = self.ends[e], self.ends[e + 1] - self.ends[e]
        store = self.ids[: self.used]
        if long.any():
            parts = [self._plain(text(i)) for i in np.flatnonzero(long).tolist()]
            lengths[long] = [len(p) for p in parts]
            begins[long] = self.used + np.cumsum(lengths[long]) - lengths[long]
            store = np.concatenate([store, *parts])
        return store, lengths, begins

    def with_end(self, text: str, end_id: int = 0) -> np.ndarray:
        raw = np.frombuffer(text.encode(), np.uint8)
        return self.encode(raw, np.array([0, len(raw)]), end_id)[0]
