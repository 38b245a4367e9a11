"""Token ids of whole texts by a public tokenizer file, with a word cache.

The tokenizer splits lower-cased text into words and encodes each word by
itself, so a word needs encoding once. Words of many texts are cut and looked
up together by arrays; only words that are new go to the tokenizer. Texts
outside the characters for which the split is plain go to it whole.
"""

from __future__ import annotations

import re

import numpy as np

from scatterlake.llm import kernels as K

#: The characters for which the tokenizer file's word pattern amounts to runs of letters,
#: single digits and runs of other marks. Apostrophes are excluded: they begin contractions.
PLAIN = re.compile("[\t\n\r -&(-~À-ÖØ-öø-įı-ž]*")
SPECIAL = "<|"
MAX_WORDS = 1_000_000
SLOTS = 1 << 21
GROUP = 1 << 18

BLANK, LETTER, DIGIT, MARK = 0, 1, 2, 3
KIND = np.full(256, MARK, np.uint8)
KIND[[9, 10, 13, 32]] = BLANK
KIND[ord("0") : ord("9") + 1] = DIGIT
KIND[ord("a") : ord("z") + 1] = LETTER
KIND[0x80:] = LETTER


class HashNumbers:
    """64-bit hashes to numbers, open addressing over arrays. Zero is no hash."""

    def __init__(self, slots: int = SLOTS):
        self.used = 0
        self._make(slots)

    def _make(self, slots: int) -> None:
        self.mask = np.uint64(slots - 1)
        self.hashes = np.zeros(slots, np.uint64)
        self.numbers = np.zeros(slots, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 for those unknown."""
        out = np.full(len(h), -1, np.int32)
        at, slot = np.arange(len(h)), h & self.mask
        while len(at):
            held = self.hashes[slot]
            same = held == h[at]
            out[at[same]] = self.numbers[slot[same]]
            more = ~same & (held != 0)
            at, slot = at[more], (slot[more] + np.uint64(1)) & self.mask
        return out

    def add(self, h: np.ndarray, numbers: np.ndarray) -> None:
        """Distinct hashes, none of them known. The table doubles before it is half full."""
        self.used += len(h)
        if 2 * self.used > len(self.hashes):
            held = np.flatnonzero(self.hashes)
            h, numbers = np.concatenate([self.hashes[held], h]), np.concatenate([self.numbers[held], numbers])
            self._make(1 << (4 * self.used).bit_length())
        slot = h & self.mask
        while len(h):
            free = np.flatnonzero(self.hashes[slot] == 0)
            won = free[np.unique(slot[free], return_index=True)[1]]
            self.hashes[slot[won]], self.numbers[slot[won]] = h[won], numbers[won]
            left = np.ones(len(h), bool)
            left[won] = False
            h, numbers, slot = h[left], numbers[left], (slot[left] + np.uint64(1)) & self.mask


class WordTokenizer:
    """Gives int32 ids of texts, the same as the tokenizer's own."""

    def __init__(self, path: str, max_words: int = MAX_WORDS):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # the same vocabulary for words that are cut and lower-cased already
        self.by_word = Tokenizer.from_file(path)
        self.by_word.normalizer = None
        self.by_word.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self.max_words = max_words
        self._clear()

    def _clear(self) -> None:
        self.known = HashNumbers()
        self.words = 0
        self.start = np.zeros(1 << 16, np.int64)
        self.length = np.zeros(1 << 16, np.int64)
        self.flat = np.zeros(1 << 18, np.int32)
        self.used = 0
        self.text_start = np.zeros(1 << 16, np.int64)
        self.text_length = np.zeros(1 << 16, np.int64)
        self.text = np.zeros(1 << 18, np.uint8)
        self.text_used = 0

    def _learn(self, words: list[bytes]) -> np.ndarray:
        """Encodes new words, joined by blanks, in one call; their numbers."""
        ids = np.array(self.by_word.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, np.int32)
        last = np.flatnonzero(self.closes[ids])  # the last token of a word is marked as such
        if len(last) != len(words):
            raise ValueError("the tokenizer splits words that were taken as whole")
        lengths = np.diff(last, prepend=-1)
        at, n = self.words, len(words)
        while len(self.start) < at + n:
            self.start, self.length, self.text_start, self.text_length = (
                np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length, self.text_start, self.text_length)
            )
        sizes, data = np.array([len(w) for w in words], np.int64), np.frombuffer(b"".join(words), np.uint8)
        while len(self.text) < self.text_used + len(data):
            self.text = np.concatenate([self.text, np.zeros_like(self.text)])
        self.text[self.text_used : self.text_used + len(data)] = data
        self.text_length[at : at + n] = sizes
        self.text_start[at : at + n] = self.text_used + np.cumsum(sizes) - sizes
        self.text_used += len(data)
        while len(self.flat) < self.used + len(ids):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.length[at : at + n] = lengths
        self.start[at : at + n] = self.used + np.cumsum(lengths) - lengths
        self.used += len(ids)
        self.words += n
        return np.arange(at, at + n, dtype=np.int32)

    def _other(self, buf: np.ndarray, begins: np.ndarray, ends: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """The places whose bytes aren't those of the word that the cache gave."""
        sizes = ends - begins
        wrong = self.text_length[numbers] != sizes
        fine = np.flatnonzero(~wrong)
        sizes = sizes[fine]
        first = np.cumsum(sizes) - sizes
        step = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
        differ = buf[np.repeat(begins[fine], sizes) + step] != self.text[np.repeat(self.text_start[numbers[fine]], sizes) + step]
        if differ.any():
            wrong[fine[np.unique(np.searchsorted(first, np.flatnonzero(differ), "right") - 1)]] = True
        return np.flatnonzero(wrong)

    def _numbers(self, buf: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The cache number of each word of the buffer. Words are found by hash and compared by their bytes."""
        data = buf.tobytes()
        words = lambda where: [data[a:b] for a, b in zip(begins[where].tolist(), ends[where].tolist(), strict=True)]
        h = K.span_hashes(buf, begins, ends)
        h[h == 0] = 1
        numbers = self.known.find(h)
        new = np.flatnonzero(numbers < 0)
        if len(new):
            fresh, first = np.unique(h[new], return_index=True)
            if self.words + len(fresh) > self.max_words:
                self._clear()
                fresh, first = np.unique(h, return_index=True)
                new = np.arange(len(h))
            self.known.add(fresh, self._learn(words(new[first])))
            numbers = self.known.find(h)
        other = self._other(buf, begins, ends, numbers)
        if len(other):  # another word has the hash: these get numbers of their own, for this buffer alone
            texts = words(other)
            distinct = list(dict.fromkeys(texts))
            number = dict(zip(distinct, self._learn(distinct).tolist(), strict=True))
            numbers[other] = [number[t] for t in texts]
        return numbers

    def _encode_plain(self, texts: list[str]) -> list[np.ndarray]:
        """Texts of plain characters: cut, looked up and put together as one buffer."""
        data = "\n".join(texts).lower().encode()
        buf = np.frombuffer(data, np.uint8)
        stops = np.cumsum([len(t.lower().encode()) + 1 for t in texts])
        kind = KIND[buf]
        first = np.ones(len(buf), bool)
        first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        edges = np.append(np.flatnonzero(first), len(buf))
        begins, ends = edges[:-1], edges[1:]
        word = kind[begins] != BLANK
        begins, ends = begins[word], ends[word]
        numbers = self._numbers(buf, begins, ends)
        lengths = self.length[numbers]
        total = np.cumsum(lengths)
        ids = self.flat[np.repeat(self.start[numbers] - total + lengths, lengths) + np.arange(total[-1] if len(total) else 0)]
        cuts = np.concatenate(([0], total))[np.searchsorted(begins, stops)]
        return np.split(ids, cuts[:-1])

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, in order; null is empty."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(texts)
        group: list[int] = []
        size = 0

        def flush() -> None:
            nonlocal group, size
            if group:
                for i, ids in zip(group, self._encode_plain([texts[i] for i in group]), strict=True):
                    out[i] = ids
            group, size = [], 0

        for i, text in enumerate(texts):
            if not text:
                continue
            if PLAIN.fullmatch(text) and SPECIAL not in text:
                group.append(i)
                size += len(text)
                if size >= GROUP:
                    flush()
            else:
                out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)
        flush()
        return out


_made: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One per process and file: Python workers keep their cache between tasks."""
    if path not in _made:
        _made[path] = WordTokenizer(path)
    return _made[path]
