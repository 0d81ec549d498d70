"""Token ids of texts by a public tokenizer whose pre-tokens never span white space.

White space separates pre-tokens in ``word_bpe_49k.json`` and is dropped, letters are lower
case in it, and the last token of a pre-token is marked as its end. So the ids of a text are
the ids of its chunks (what ASCII white space separates), one after the other; closing
punctuation after an ASCII letter starts a pre-token of its own; ASCII capitals can be
lowered first; and many letter-only words can be encoded in one call and cut at the end
marks. Chunks repeat far more often than they are new: the ids of those met are kept, by
a 64-bit hash of the chunk, in a table of bounded size.
"""

from __future__ import annotations

import unicodedata
from itertools import chain

import numpy as np

from .bytewise import hashes, words

#: Chunks and ids kept in a worker; the table is emptied when it is full.
KEPT_CHUNKS = 600_000
KEPT_IDS = 6_000_000
CLOSING = b".,!?;:"
MOST_CLOSING = 3

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_LETTER = np.zeros(256, bool)
_LETTER[ord("a"):ord("z") + 1] = _LETTER[ord("A"):ord("Z") + 1] = True
_CLOSING = np.zeros(256, np.int64)
_CLOSING[list(CLOSING)] = np.arange(1, len(CLOSING) + 1)


class ChunkTokenizer:
    """Ids of whole texts; ``path`` names a tokenizers file. ``end_id`` closes each document, if given."""

    def __init__(self, path: str, end_id: int | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end_id = end_id
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.index: dict[int, int] = {}
        self.ids = np.zeros(1 << 20, np.uint32)
        self.starts = np.zeros(1 << 16, np.int64)
        self.used = 0
        self._put([-1], [[]])  # no closing punctuation
        self.tails = {0: 0}

    def _put(self, keys: list[int], ids: list[list[int]]) -> None:
        """Add chunks, by key, with their ids to the table."""
        flat, k = list(chain.from_iterable(ids)), len(self.index)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while k + len(keys) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.ids[self.used:self.used + len(flat)] = flat
        self.starts[k + 1:k + len(keys) + 1] = self.used + np.cumsum([len(x) for x in ids])
        self.used += len(flat)
        self.index.update(zip(keys, range(k, k + len(keys))))

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _joined(self, some: list[str]) -> list[list[int]]:
        """Ids of letter-only words, many in a call."""
        out: list[list[int]] = []
        for at in range(0, len(some), 256):
            part = some[at:at + 256]
            ids = self._plain(" ".join(part))
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(part) and cuts[-1] == len(ids):
                bounds = [0, *cuts.tolist()]
                out += [ids[a:b] for a, b in zip(bounds, bounds[1:])]
            else:
                out += [self._plain(w) for w in part]
        return out

    def _learn(self, keys: list[int], chunks: list[bytes]) -> None:
        """Encode new chunks: letter-only words together, letters with closing punctuation in two parts, others one by one."""
        lettered, tailed, others = {}, [], []
        for key, chunk in zip(keys, chunks):
            core = chunk.rstrip(CLOSING)
            word = core.decode("utf-8", "replace")
            if word.isalpha() and (word.isascii() or self._stays_letters(word)):
                lettered.setdefault(word, []).append(key)
                if len(core) < len(chunk):
                    tailed.append((key, chunk[len(core):].decode()))
            else:
                others.append((key, chunk))
        ids = dict(zip(chain.from_iterable(lettered.values()), chain.from_iterable(
            [found] * len(same) for found, same in zip(self._joined(list(lettered)), lettered.values()))))
        ends = {tail: self._plain(tail) for tail in {t for _, t in tailed}}
        for key, tail in tailed:
            ids[key] = ids[key] + ends[tail]
        for key, chunk in others:
            ids[key] = self._plain(chunk.decode("utf-8", "replace"))
        self._put(list(ids), list(ids.values()))

    @staticmethod
    def _stays_letters(word: str) -> bool:
        """Lower case and composition leave nothing but letters."""
        return unicodedata.is_normalized("NFC", word) and word.lower().isalpha()

    def _rows(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Row in the table of each chunk."""
        kinds, at, which = np.unique(keys, return_index=True, return_inverse=True)
        index, listed = self.index, kinds.tolist()
        rows = [index.get(k, -1) for k in listed]
        new = [i for i, r in enumerate(rows) if r < 0]
        if new:
            raw = data.tobytes()
            self._learn([listed[i] for i in new], [raw[a:b] for a, b in zip(starts[at[new]].tolist(), ends[at[new]].tolist())])
            for i in new:
                rows[i] = index[listed[i]]
        return np.array(rows, np.int64)[which]

    def _tail_rows(self, codes: np.ndarray) -> np.ndarray:
        kinds, which = np.unique(codes, return_inverse=True)
        for code in kinds.tolist():
            if code not in self.tails:
                text, rest = "", code
                while rest:
                    text, rest = text + chr(CLOSING[rest % 8 - 1]), rest // 8
                self.tails[code] = len(self.index)
                self._put([-1 - code], [self._plain(text)])
        return np.array([self.tails[c] for c in kinds.tolist()], np.int64)[which]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (uint32) of texts whose UTF-8 bytes lie end to end, and the offsets of the texts in them."""
        if len(self.index) > KEPT_CHUNKS or self.used > KEPT_IDS:
            self._clear()
        starts, ends, first = words(data, offsets)
        n_docs = len(offsets) - 1
        ids, at = np.zeros(0, np.uint32), np.zeros(n_docs + 1, np.int64)
        if len(starts):
            cut, code = ends.copy(), np.zeros(len(ends), np.int64)
            for _ in range(MOST_CLOSING):  # closing characters, the last one first
                last = _CLOSING[data[cut - 1]]
                more = (last > 0) & (cut - 1 > starts)
                code = np.where(more, code * 8 + last, code)
                cut = np.where(more, cut - 1, cut)
            whole = ~_LETTER[data[cut - 1]]  # what is before the punctuation must end with a letter
            cut, code = np.where(whole, ends, cut), np.where(whole, 0, code)
            special = np.concatenate([[0], np.cumsum(data == ord("<"))])
            low = _LOWER[data]
            keys = hashes(low, starts, cut)
            odd = special[cut] > special[starts]  # may hold a special token, which is matched as it stands
            chosen = low
            if odd.any():
                keys[odd] = hashes(data, starts[odd], cut[odd]) ^ np.uint64(0x5555555555555555)
                chosen = low.copy()
                for a, b in zip(starts[odd].tolist(), cut[odd].tolist()):
                    chosen[a:b] = data[a:b]
            rows = np.stack([self._rows(keys, chosen, starts, cut), self._tail_rows(code)], axis=1)
            begin = self.starts[rows]
            length = self.starts[rows + 1] - begin
            at = np.concatenate([[0], np.cumsum(length.sum(axis=1))])[first]
            begin, length = begin.ravel(), length.ravel()
            stop = np.cumsum(length)
            ids = self.ids[np.arange(stop[-1]) + np.repeat(begin - stop + length, length)]
        if self.end_id is None:
            return ids, at
        out = np.full(len(ids) + n_docs, self.end_id, np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(n_docs), np.diff(at))] = ids
        return out, at + np.arange(n_docs + 1)


def batches(data: np.ndarray, offsets: np.ndarray, most: int = 2 << 20):
    """Index ranges of texts of about ``most`` bytes together; a longer text stands alone."""
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, last
        first = last
