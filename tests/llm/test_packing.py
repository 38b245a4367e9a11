import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from scatterlake.llm import packing
from scatterlake.llm import kernels as K
from scatterlake.llm.tokens import HashNumbers, WordTokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_ids_are_the_tokenizers_own():
    texts = [
        "it's l'été aujourd'hui 'start", "İstanbul ΣΑΣ ς", "a<|endoftext|>b", "", None, "x\x1cy z", "50% of $3.14!!", "Ünï—dash ²½",
        "ab12cd345 e.f, (g) \t\r\n h", "ÀÖØ öøį ıž Ÿ", "é", "x" * 3000, " ", "\n\n", "日本語 text", "ﬁne é",
    ]
    for limit in (1_000_000, 3):
        mine = WordTokenizer(PATH, max_words=limit)
        want = [mine.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts * 2]
        assert [x.tolist() for x in mine.encode_all(texts * 2)] == want


def test_words_of_one_hash_are_told_apart():
    """Thue-Morse words collide under every polynomial hash modulo 2^64."""
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    data = np.frombuffer(f"{a} {b}".encode(), np.uint8)
    h = K.span_hashes(data, np.array([0, len(a) + 1]), np.array([len(a), 2 * len(a) + 1]))
    assert h[0] == h[1]
    mine = WordTokenizer(PATH)
    texts = [f"x {a} y", f"{b} z {a} {b}", b, a]
    assert [x.tolist() for x in mine.encode_all(texts)] == [mine.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_table_of_words_grows():
    table = HashNumbers(8)
    h = np.arange(1, 1000, dtype=np.uint64) * np.uint64(8)
    for i in range(0, len(h), 111):
        table.add(h[i : i + 111], np.arange(i, i + 111, dtype=np.int32))
    assert table.find(h).tolist() == list(range(999)) and table.find(np.array([3], np.uint64)).tolist() == [-1]
    mine = WordTokenizer(PATH, max_words=50)
    mine.known = HashNumbers(8)
    text = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(600))
    assert mine.encode_all([text])[0].tolist() == mine.tokenizer.encode(text, add_special_tokens=False).ids


def check(rows, length):
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
    return len(held)


@pytest.mark.parametrize("each", [1_000_000, 40])
def test_placements_are_gapless_and_tight(spark, each):
    rng = np.random.default_rng(4)
    sizes = [*rng.integers(1, 400, 300).tolist(), *[256] * 60, *[100] * 150]
    df = spark.createDataFrame(list(enumerate(sizes)), "id long, size long")
    got = packing.place(df, 400, each).collect()
    assert sorted(r["id"] for r in got) == list(range(len(sizes)))
    n = check([{"sequence_id": r["seq"], "offset": r["offset"], "length": sizes[r["id"]]} for r in got], 400)
    assert n <= -(-sum(sizes) // 400) * 1.08 + 1


def test_pack_and_round_trip(spark):
    rows = [(i, "word%d " % (i % 7) * (i * 13 % 90)) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "long text, " * 3000), (103, "café " * 40)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, length int")
    placed = packing.pack(docs, PATH, length=512, rows_each=30)
    got = placed.collect()
    check(got, 512)
    tok = WordTokenizer(PATH)
    ids = {i: tok.tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for i, t in rows}
    pieces = defaultdict(list)
    for r in got:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
    for i, want in ids.items():
        assert sorted(pieces[i]) == [(k, s, min(512, len(want) - s)) for k, s in enumerate(range(0, len(want), 512))]
    whole = {r["sequence_id"]: r["ids"] for r in packing.sequences(docs, placed, PATH, length=512).collect()}
    for r in placed.collect():
        assert whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]


def test_repeated_and_missing_ids(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    assert packing.pack(docs, PATH).count() == 3
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_handovers_take_the_smallest_gaps_first():
    left = {(0, packing.GAP): 3, (1, packing.ITEM): 1, (1, packing.GAP): 2, (2, packing.ITEM): 4}
    assert packing.handovers(left) == [(1, 0, 1, 0, 3), (2, 0, 2, 1, 2), (2, 2, 2, 0, 2)]
