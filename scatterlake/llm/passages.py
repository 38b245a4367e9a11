"""Substring dedup on words: recurring passages, located by Aho-Corasick automata.

Recurring passages are confirmed word by word in the exchange of ``repeats``,
whose verdicts carry them to the blocks of documents. A block compiles its
passages into automata of bounded size, over a few letters for each word, and
streams all its documents through them: nothing else tells it where a passage
stands. Every hit is checked against the words before it counts.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scatterlake.llm import kernels as K
from scatterlake.llm import repeats as R
from scatterlake.llm.substrings import gone_intervals, merge_by_row

ALPHABET = R.Words()
#: Words of the passages in one automaton.
SHARD_WORDS = 500_000
#: A word is so many letters, each from an alphabet of its own of 2^LETTER_BITS:
#: nodes of the automaton have few children, and hits begin and end with words.
LETTERS, LETTER_BITS = 3, 6


def judge(segments: list[bytes], lead: np.ndarray, doc: np.ndarray, start: np.ndarray, alphabet: R.Words = ALPHABET) -> np.ndarray:
    """Masks of the windows whose words some other segment has at an earlier place."""
    mask = np.zeros(len(segments), np.uint64)
    grams = defaultdict(list)
    words = [s.split(b" ") for s in segments]
    for i, at in enumerate(lead.tolist()):
        if at != R.ALONE:
            grams[b" ".join(words[i][at : at + alphabet.k])].append(i)
    w = alphabet.window
    for members in grams.values():
        if len(members) == 1:
            continue
        windows = []
        least: dict[bytes, tuple[int, int]] = {}
        for i in members:
            d, s, own = int(doc[i]), int(start[i]), words[i]
            for o in range(len(own) - w + 1):
                text = b" ".join(own[o : o + w])
                place = (d, s + o)
                windows.append((i, o, text, place))
                if text not in least or place < least[text]:
                    least[text] = place
        for i, o, text, place in windows:
            if place > least[text]:
                mask[i] |= np.uint64(1 << o)
    return mask


def word_codes(column: pa.Array) -> list[str]:
    """Each text as a string with LETTERS code points for each word."""
    out: list[str] = []
    for piece in K.text_slices(column):
        begins, ends = K.spans(piece.buf, piece.starts)
        h = K.span_hashes(piece.buf, begins, ends)
        letters = [((h >> K.U64(LETTER_BITS * i)) & K.U64((1 << LETTER_BITS) - 1)) + K.U64(0x100 + (i << LETTER_BITS)) for i in range(LETTERS)]
        cuts = np.searchsorted(begins, piece.starts) * LETTERS
        every = np.stack(letters, 1).astype("<u2").tobytes().decode("utf-16-le")
        out += [every[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    return out


def occurrences(texts: list[bytes], passages: list[bytes], shard_words: int = SHARD_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, passage number) of every place where a passage stands, by automata."""
    import ahocorasick

    rows, first, number = [], [], []
    if not passages:
        return (np.zeros(0, np.int64),) * 3
    patterns = word_codes(pa.array(passages, pa.large_binary()))
    streams = word_codes(pa.array(texts, pa.large_binary()))
    sizes = np.cumsum([len(p) // LETTERS for p in patterns])
    shard = sizes // shard_words
    for s in np.unique(shard).tolist():
        by_code = defaultdict(list)
        for i in np.flatnonzero(shard == s).tolist():
            by_code[patterns[i]].append(i)
        automaton = ahocorasick.Automaton()
        for code, same in by_code.items():
            automaton.add_word(code, (len(code) // LETTERS, same))
        automaton.make_automaton()
        for row, stream in enumerate(streams):
            words = None
            for end, (size, same) in automaton.iter(stream):
                if words is None:
                    words = texts[row].split()
                last = end // LETTERS + 1
                at = last - size
                found = b" ".join(words[at:last])
                for i in same:  # more than one only if words share a code
                    if passages[i] == found:
                        rows.append(row)
                        first.append(at)
                        number.append(i)
    return np.array(rows, np.int64), np.array(first, np.int64), np.array(number, np.int64)


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, block_bytes: int = R.BLOCK_BYTES, hot_blocks: int = R.HOT_BLOCKS) -> DataFrame:
    """(__id, __kept, __n_words, __n_removed, __spans): every row without the words of earlier passages.

    Words are runs of anything but ASCII blanks, unchanged. A word goes if a
    window of ``window`` words over it also starts earlier: in a row with a
    smaller id, or before in the same row. Windows are judged on the input.
    ``__kept`` joins the remaining words by single blanks, ``__spans`` are the
    maximal removed runs of word numbers, end exclusive.

    Null, empty and blank texts have no words. Rows with the same id are one
    document: of equal places neither loses a word, of different ones the later
    does. Null ids come after all others and are equal. No rows: no rows.
    ``window`` is at most 69. Other columns of ``docs`` are not read.
    """
    alphabet = R.Words(window, max(1, min(6, window // 2)))

    def judged(*given):
        return judge(*given, alphabet=alphabet)

    def apply(ids: list, texts: list[bytes], passages: list[bytes], doc: np.ndarray, start: np.ndarray, mask: np.ndarray) -> Iterator[pa.RecordBatch]:
        orders = np.array([R.NO_ID if i is None else i for i in ids], np.int64)
        row, first, number = occurrences(texts, passages)
        count = np.array([p.count(b" ") for p in passages], np.int64)[number] + 2 - window
        own, known_doc, known_start = orders[row], doc[number], start[number]
        later = (own > known_doc) | ((own == known_doc) & (first > known_start))
        same = (own == known_doc) & (first == known_start) & (mask[number] != 0)
        words = [t.split() for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        of, a, b = merge_by_row(*gone_intervals(row, first, count, later, same, mask[number], window), sizes)
        cuts = np.searchsorted(of, np.arange(len(sizes) + 1))
        kept, removed = [], np.zeros(len(sizes), np.int64)
        np.add.at(removed, of, b - a)
        for i, w in enumerate(words):
            for x, y in zip(a[cuts[i] : cuts[i + 1]].tolist()[::-1], b[cuts[i] : cuts[i + 1]].tolist()[::-1], strict=True):
                del w[x:y]
            kept.append(b" ".join(w).decode())
        spans = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays([pa.array(a), pa.array(b)], ["start", "end"]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(kept, pa.string()), pa.array(sizes), pa.array(removed), spans],
            ["__id", "__kept", "__n_words", "__n_removed", "__spans"],
        )

    schema = "__id long, __kept string, __n_words long, __n_removed long, __spans array<struct<start: long, end: long>>"
    return R.exchange(docs, id_col, text_col, alphabet, judged, apply, schema, block_bytes, hot_blocks, carry=True)
