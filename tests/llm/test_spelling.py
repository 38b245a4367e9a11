import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from scatterlake.llm.spelling import BAND_BITS, count_words, near_pairs, parity_mask, variant_groups

LETTER_RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWERED = str.maketrans({chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)})


def plain_words(rows, drop_every=31):
    n = Counter()
    for i, text in rows:
        for run in LETTER_RUN.findall(text or ""):
            run = run.translate(LOWERED)
            if drop_every:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                if h % drop_every == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted([a, b], key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(n):
    form, out = {}, []
    for w in n:
        close = [x for x in n if near(w, x)]
        best = min(close, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
        out.append([w, n[w], len(close), form[w], n[form[w]] if form[w] else None])
    for row in out:
        root = row[0]
        while form[root]:
            root = form[root]
        row.append(root)
    return sorted(map(tuple, out))


def groups(spark, n):
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    return sorted((r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in variant_groups(words).collect())


def misspelt(rng, word):
    kind, at, letter = rng.integers(3), int(rng.integers(len(word))), chr(rng.choice([97 + int(rng.integers(26)), 0xC0 + int(rng.integers(64))]))
    return word[:at] + (letter if kind < 2 else "") + word[at + (kind > 0) :]


def test_words_and_groups_against_brute_force(spark):
    rng = np.random.default_rng(12)
    stems = ["".join(chr(97 + int(c)) for c in rng.integers(0, 26, rng.integers(7, 12))) for _ in range(12)]
    rows = []
    for i in range(300):
        words = [str(rng.choice(stems)) for _ in range(40)]
        for _ in range(2):
            words.append(misspelt(rng, misspelt(rng, words[0]) if rng.random() < 0.3 else words[1]))
        if i % 3 == 0:
            words = [w.upper() for w in words]
        rows.append((i, " ".join(words) + ", x1y2z3 Ünïcôdé_lettèrs × ÷ ÀÀÀÀÀÀÀ"))
    rows += [(None, "nullidword nullidword"), (7, None), (8, ""), (9, "1234 .. -"), (3, rows[3][1]), (3, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    expected = plain_words(rows)
    counted = {r["word"]: r["n"] for r in count_words(docs, drop_every=31).collect()}
    assert counted == expected
    assert {r["word"]: r["n"] for r in count_words(docs).collect()} == plain_words(rows, None)
    found = groups(spark, expected)
    assert found == plain_groups(expected)
    assert sum(r[3] is not None for r in found) > 20


def test_chains_ties_and_every_kind_of_edit(spark):
    n = {"aaaaaaab": 2, "aaaaaaac": 20, "aaaaaacc": 200, "aaaaaccc": 2000}  # a chain of forms
    n |= {"bbbbbbb": 3, "bbbbbbx": 30, "bbbbbbé": 30, "bbbbbbbb": 29}  # ties go to the smaller word
    n |= {"xcdefghi": 2, "cdefghi": 40, "cdefghiz": 2, "cdexfghi": 2, "cdfghij": 2, "ÿdefghi": 2, "Àdefghi": 4}
    n |= {"z" * 5000: 2, "z" * 4999: 50, "z" * 2500 + "y" + "z" * 2499: 2}
    assert groups(spark, n) == plain_groups(n)
    assert groups(spark, {}) == []
    assert groups(spark, {"single": 5, "lonelyword": 2}) == plain_groups({"single": 5, "lonelyword": 2})


def test_pairs_come_once(spark):
    words = ["abcdefg", "abcdefh", "xbcdefg", "abcdefgg", "abcdxefg", "bcdefgx", "aabcdefg"]
    df = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    pairs = [frozenset((r["a"], r["b"])) for r in near_pairs(df).collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {frozenset((a, b)) for a in words for b in words if a < b and near(a, b)}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, word string, n long")
    assert variant_groups(count_words(empty, drop_every=31)).count() == 0


def mask(word):
    m = 0
    for c in word:
        k = ord(c) - 97 if ord(c) < 0xC0 else ord(c) - 0xC0 + 26
        m ^= 1 << (k % 3 * BAND_BITS + k // 3 % BAND_BITS)
    return m


def test_masks(spark):
    words = ["abcdefghijklmnopqrstuvwxyz", "aa", "a", "", "ÀÿéÞ", "zzz"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in df.select(parity_mask(df["w"])).collect()] == [mask(w) for w in words]


@settings(max_examples=300, deadline=None)
@given(st.text("abcé", min_size=6, max_size=9), st.data())
def test_one_edit_leaves_a_band_equal(word, data):
    at = data.draw(st.integers(0, len(word) - 1))
    letter = data.draw(st.sampled_from("abcdéÿ"))
    full = (1 << BAND_BITS) - 1
    for other, least in ((word[:at] + letter + word[at + 1 :], 1), (word[:at] + letter + word[at:], 2), (word[:at] + word[at + 1 :], 2)):
        flipped = mask(word) ^ mask(other)
        assert sum(not flipped >> b * BAND_BITS & full for b in range(3)) >= least
        assert flipped.bit_count() == (1 if len(other) != len(word) else flipped.bit_count() if flipped.bit_count() in (0, 2) else -1)
