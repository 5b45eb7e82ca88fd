"""Token ids of whole texts from the ids of their words, found in numpy passes over Arrow buffers.

A ``word_bpe`` tokenizer never joins across white space, and takes each run of letters, each digit and each run of other
signs as a word of its own. A text's ids are thus those of its words one after another, and the tokenizer itself is
asked once for each distinct word. Words with bytes for which these rules are not certain (controls, apostrophes,
``<``, scripts beyond Latin) are not cut at all but go to the tokenizer whole.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa

from .hashing import mix64, slices, text_buffers

#: Words whose ids a worker keeps, and bytes of ids and of long words; beyond either it drops words before the next pass.
CACHE_WORDS = 250_000
CACHE_BYTES = 16 << 20
#: Words of up to 8 * LANES bytes are compared as numbers, longer ones as byte strings.
LANES = 3
#: Bytes of text encoded in one pass; a single longer document is still one pass. Scratch takes some 20 times as much.
PASS_BYTES = 1 << 19

_SPACE, _LETTER, _DIGIT, _SIGN, _ODD = range(5)
_CLASS = np.full(256, _ODD, np.uint8)
_CLASS[0x21:0x7F] = _SIGN
_CLASS[[0x20, 0x09, 0x0A, 0x0D]] = _SPACE
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[[ord("'"), ord("<")]] = _ODD
# Latin letters U+00C0..U+024F, but U+00D7 and U+00F7, which are signs, and U+0130, whose small form is two characters
_CLASS[0x80:0xC0] = _LETTER
_CLASS[0xC3:0xCA] = _LETTER
_NOT_LETTERS = ((0xC3, 0x97, 0x97), (0xC3, 0xB7, 0xB7), (0xC4, 0xB0, 0xB0), (0xC9, 0x90, 0xBF))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_ODD_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _cuts(raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts with the byte bounds ``edges``, and which of them are odd."""
    kind = _CLASS[raw]
    # continuation bytes belong to Latin letters only behind those letters' lead bytes
    for lead, low, high in _NOT_LETTERS:
        at = np.flatnonzero(raw == lead)
        at = at[at + 1 < len(raw)]
        kind[at[(raw[at + 1] >= low) & (raw[at + 1] <= high)]] = _ODD
    solid = kind != _SPACE
    edge = np.zeros(len(raw) + 1, bool)
    edge[edges] = True
    before = np.empty_like(solid)
    before[0] = False
    before[1:] = solid[:-1]
    first = np.flatnonzero(solid & (~before | edge[:-1]))
    cut = np.empty(len(raw), bool)
    cut[0] = True
    cut[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    cut |= edge[:-1]
    if (kind == _ODD).any():
        odd = np.logical_or.reduceat(kind == _ODD, first)
        # no cuts inside odd words
        inner = np.repeat(odd, np.diff(np.append(first, len(raw))))
        cut[first[0] :] &= ~inner
        cut[first] = True
        start = np.flatnonzero(cut & solid)
        odd = odd[np.searchsorted(first, start, "right") - 1]
    else:
        start = np.flatnonzero(cut & solid)
        odd = np.zeros(len(start), bool)
    gap = np.flatnonzero(~solid | edge[:-1])
    stop = np.append(start[1:], len(raw))
    at = np.searchsorted(gap, start, "right")
    end = np.minimum(stop, np.append(gap, len(raw))[at])
    return start, end, odd


class WordEncoder:
    """Ids of texts' words, kept by word. Ids of equal words are the same whether they are kept or asked for again."""

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.forget()

    def forget(self) -> None:
        """Drop all words."""
        self.key = np.zeros(0, np.uint64)
        self.number = np.zeros(0, np.int64)
        self.lanes = np.zeros((LANES, 0), np.uint64)
        self.first = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.used = np.zeros(0, bool)
        self.long: dict[bytes, int] = {}
        self.long_bytes = 0

    def thin(self) -> None:
        """Keep only short words that a pass has met again since the last time, none if these are still too many."""
        keep = np.flatnonzero(self.used)
        size = np.diff(self.first)[keep]
        first = np.concatenate((self.first[:1], np.cumsum(size)))
        if 2 * len(keep) > CACHE_WORDS or 2 * self.ids.itemsize * first[-1] > CACHE_BYTES:
            return self.forget()
        place = np.full(len(self.used), -1)
        place[keep] = np.arange(len(keep))
        number = place[self.number]
        self.key, self.number = self.key[number >= 0], number[number >= 0]
        self.lanes = self.lanes[:, keep]
        self.ids = self.ids[np.repeat(self.first[keep] - first[:-1], size) + np.arange(first[-1])]
        self.first, self.used = first, np.zeros(len(keep), bool)
        self.long, self.long_bytes = {}, 0

    def full(self) -> bool:
        return len(self.first) > CACHE_WORDS or self.ids.nbytes + self.long_bytes > CACHE_BYTES

    def _whole(self, word: bytes) -> array:
        return array("I", self.tokenizer.encode(word.decode("utf-8"), add_special_tokens=False).ids)

    def _ask(self, words: list[bytes], odd: np.ndarray) -> list[array]:
        """Ids of each word; those that are not odd are one word for the tokenizer too and are asked in long lines."""
        out: list[array] = [array("I")] * len(words)
        for i in np.flatnonzero(odd).tolist():
            out[i] = self._whole(words[i])
        even = np.flatnonzero(~odd)
        for lo in range(0, len(even), 2000):
            part = even[lo : lo + 2000].tolist()
            enc = self.tokenizer.encode(b" ".join([words[i] for i in part]).decode("utf-8"), add_special_tokens=False)
            of, ids = np.asarray(enc.word_ids, np.int64), array("I", enc.ids)
            cut = np.searchsorted(of, np.arange(len(part) + 1))
            if len(of) and of[-1] == len(part) - 1 and (np.diff(cut) > 0).all():
                cuts = cut.tolist()
                for k, i in enumerate(part):
                    out[i] = ids[cuts[k] : cuts[k + 1]]
            else:
                for i in part:
                    out[i] = self._whole(words[i])
        return out

    def _add(self, asked: list[array]) -> np.ndarray:
        """Numbers of the words whose ids are added."""
        n = len(self.first) - 1
        self.first = np.concatenate((self.first, self.first[-1] + np.cumsum([len(a) for a in asked], dtype=np.int64)))
        self.ids = np.concatenate((self.ids, np.frombuffer(b"".join(a.tobytes() for a in asked), np.uint32)))
        self.lanes = np.concatenate((self.lanes, np.zeros((LANES, len(asked)), np.uint64)), axis=1)
        self.used = np.concatenate((self.used, np.zeros(len(asked), bool)))
        return np.arange(n, n + len(asked))

    def _numbers(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray, odd: np.ndarray) -> np.ndarray:
        """The number of each word, new words asked for. ``raw`` ends with 8 * LANES bytes of padding."""
        size = end - start
        view = np.ndarray((len(raw) - 7,), np.uint64, raw, strides=(1,))
        lanes = np.empty((LANES, len(start)), np.uint64)
        for k in range(LANES):
            lanes[k] = view[start + 8 * k] & _MASK[np.clip(size - 8 * k, 0, 8)]
        key = size.astype(np.uint64)
        for k in range(LANES):
            key = mix64(key + lanes[k] * _ODD_FACTORS[k])
        coded = pa.array(key).dictionary_encode()
        code, kinds = coded.indices.to_numpy(), coded.dictionary.to_numpy()
        sample = np.empty(len(kinds), np.int64)
        sample[code[::-1]] = np.arange(len(code) - 1, -1, -1)
        # words that are too long, or whose key stands for another word, are told apart by their bytes
        apart = size > 8 * LANES
        for k in range(LANES):
            apart |= lanes[k] != lanes[k][sample][code]
        at = np.minimum(np.searchsorted(self.key, kinds), max(0, len(self.key) - 1))
        known = self.key[at] == kinds if len(self.key) else np.zeros(len(kinds), bool)
        number = np.full(len(kinds), -1, np.int64)
        number[known] = self.number[at[known]]
        same = known.copy()
        same[known] = (self.lanes[:, number[known]] == lanes[:, sample[known]]).all(axis=0)
        self.used[number[same]] = True
        clash = known & ~same
        if clash.any():
            apart |= clash[code]
        new = np.flatnonzero(~known & ~apart[sample])
        if len(new):
            at = sample[new]
            text = raw.tobytes()
            added = self._add(self._ask([text[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)], odd[at]))
            number[new] = added
            self.lanes[:, added] = lanes[:, at]
            order = np.argsort(kinds[new])
            keys = kinds[new][order]
            place = np.searchsorted(self.key, keys)
            self.key, self.number = np.insert(self.key, place, keys), np.insert(self.number, place, added[order])
        out = number[code]
        if apart.any():
            text = raw.tobytes()
            for i in np.flatnonzero(apart).tolist():
                word = text[start[i] : end[i]]
                if word not in self.long:
                    self.long[word] = int(self._add(self._ask([word], odd[i : i + 1]))[0])
                    self.long_bytes += len(word)
                out[i] = self.long[word]
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts ``data[offsets[i]:offsets[i + 1]]``, each followed by ``end_id``, and their n + 1 bounds."""
        if self.full():
            self.thin()
        raw = data[offsets[0] : offsets[-1]]
        edges = offsets - offsets[0]
        n = len(offsets) - 1
        if not len(raw) or not (_CLASS[raw] != _SPACE).any():
            return np.full(n, end_id, np.uint32), np.arange(n + 1)
        start, end, odd = _cuts(raw, edges)
        number = self._numbers(np.concatenate((_LOWER[raw], np.zeros(8 * LANES + 8, np.uint8))), start, end, odd)
        size = self.first[number + 1] - self.first[number]
        total = np.concatenate(([0], np.cumsum(size)))
        per_doc = total[np.searchsorted(start, edges)]
        bounds = per_doc + np.arange(n + 1)
        out = np.empty(int(bounds[-1]), np.uint32)
        out[bounds[1:] - 1] = end_id
        whole = np.ones(len(out), bool)
        whole[bounds[1:] - 1] = False
        at = np.repeat(self.first[number] - total[:-1], size)
        at += np.arange(len(at))
        out[whole] = self.ids[at]
        return out, bounds


def encoded(encoder: WordEncoder, column: pa.Array, end_id: int):
    """(lo, hi, ids, bounds) of slices of rows of a string column; nulls are empty texts."""
    data, offsets = text_buffers(column)
    for lo, hi in slices(offsets, PASS_BYTES):
        yield lo, hi, *encoder.encode(data, offsets[lo : hi + 1], end_id)
