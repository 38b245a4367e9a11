import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scatterlake.llm import kernels as K
from scatterlake.llm import passages, substrings
from scatterlake.llm.suffixes import blind_order, multikey_quicksort, sort_suffixes, sorted_names


def plain_bytes(rows, window):
    order = lambda i: float("inf") if i is None else i
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - window + 1):
            first[b[s : s + window]] = min(first.get(b[s : s + window], float("inf")), order(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for s in range(len(b) - window + 1):
            if first[b[s : s + window]] < order(i):
                gone[s : s + window] = [True] * window
        runs = sum(g and not p for g, p in zip(gone, [False, *gone], strict=False))
        out.append((i, bytes(x for x, g in zip(b, gone, strict=True) if not g), len(b), runs))
    return sorted(out, key=repr)


def plain_words(rows, window):
    order = lambda i: float("inf") if i is None else i
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            first[key] = min(first.get(key, (float("inf"), float("inf"))), (order(i), s))
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (order(i), s):
                gone[s : s + window] = [True] * window
        out.append((i, b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode(), len(w), sum(gone)))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(40) for _ in range(4)]
    rows = []
    for i in rng.sample(range(100), 24):
        parts = [rng.choice(shared) if rng.random() < 0.5 else text(rng.randint(1, 30)) for _ in range(rng.randint(0, 5))]
        if parts and rng.random() < 0.4:
            parts.append(parts[0][rng.randint(0, 20) :])
        rows.append((i, rng.choice([" ", "\n", "  "]).join(parts)))
    copy = rows[3]
    return [*rows, copy, (None, rows[5][1]), (None, shared[0]), (7000, None), (7001, ""), (7002, "ab " * 400), (7003, "ab " * 300)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, b"x", 1) for i, t in rows], "doc_id long, text string, payload binary, block int")


@pytest.mark.parametrize("hot", [256, 2])
def test_bytes_against_brute_force(spark, hot):
    rows = corpus(1)
    got = substrings.remove_repeats(frame(spark, rows), block_bytes=2000, hot_blocks=hot).collect()
    found = sorted(((r["__id"], bytes(r["__kept"]), r["__n_bytes"], len(r["__spans"])) for r in got), key=repr)
    assert found == plain_bytes(rows, 50)


@pytest.mark.parametrize("hot", [256, 2])
def test_words_against_brute_force(spark, hot):
    rows = corpus(2)
    got = passages.remove_passages(frame(spark, rows), block_bytes=2000, hot_blocks=hot).collect()
    found = sorted(((r["__id"], r["__kept"], r["__n_words"], r["__n_removed"]) for r in got), key=repr)
    assert found == plain_words(rows, 20)


def test_long_texts_are_cut_without_losing_windows(spark):
    rng = random.Random(3)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(1_300_000))
    rows = [(1, shared), (2, "start " + shared[600_000:1_290_000] + " end"), (3, shared[1_000_000:1_000_060])]
    got = {r["__id"]: r for r in substrings.remove_repeats(frame(spark, rows)).collect()}
    assert [(x["start"], x["end"]) for x in got[2]["__spans"]] == [(6, 690_006)]
    assert bytes(got[2]["__kept"]) == b"start  end" and bytes(got[3]["__kept"]) == b""
    assert hashlib.sha256(bytes(got[1]["__kept"])).digest() == hashlib.sha256(shared.encode()).digest()


def test_places_come_from_the_automata(spark):
    """Passages alone, told to a block, are found wherever they stand in it."""
    texts = [b"a b c d e", b"x a b c y a b c", b"", b"c a  b\tc"]
    row, first, number = passages.occurrences(texts, [b"a b c", b"c y a"], shard_words=2)
    assert sorted(zip(row.tolist(), first.tolist(), number.tolist(), strict=True)) == [(0, 0, 0), (1, 1, 0), (1, 3, 1), (1, 5, 0), (3, 1, 0)]
    assert all(len(x) == 0 for x in passages.occurrences(texts, []))


@pytest.mark.parametrize(("remove", "window"), [(substrings.remove_repeats, 82), (passages.remove_passages, 70)])
def test_windows_beyond_a_mask_are_refused(spark, remove, window):
    with pytest.raises(ValueError, match="mask"):
        remove(frame(spark, corpus(1)[:2]), window=window)


def test_the_widest_windows(spark):
    rows = corpus(7)
    got = substrings.remove_repeats(frame(spark, rows), window=81, block_bytes=2000).collect()
    assert sorted(((r["__id"], bytes(r["__kept"]), r["__n_bytes"], len(r["__spans"])) for r in got), key=repr) == plain_bytes(rows, 81)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.remove_repeats(none).count() == 0
    assert passages.remove_passages(none).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=6, max_size=6), min_size=1, max_size=40))
def test_blind_trie_orders_as_sorted(texts):
    rank = blind_order(texts)
    assert sorted(rank, key=rank.get) == sorted(set(texts))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.binary(max_size=30) | st.text(alphabet="ab", max_size=40).map(str.encode), max_size=60))
def test_sorted_names_are_those_of_equality(texts):
    names = sorted_names(texts).tolist()
    by_name = dict(zip(names, texts, strict=True))
    assert [by_name[n] for n in names] == texts and sorted(set(names)) == list(range(len(set(texts))))
    assert [by_name[n] for n in sorted(by_name)] == sorted(set(texts), key=lambda t: (len(t), t))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2**64 - 1) | st.integers(0, 2)), max_size=80))
def test_multikey_quicksort(rows):
    columns = [np.array([r[i] for r in rows], np.uint64) for i in (0, 1)]
    order, group = multikey_quicksort(columns)
    got = [rows[i] for i in order.tolist()]
    assert got == sorted(rows)
    assert group.tolist() == [sorted(set(rows)).index(r) for r in got]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2**64 - 1) | st.integers(0, 2)), max_size=80), st.integers(0, 9))
def test_small_parts_are_sorted_together(rows, small):
    from scatterlake.llm import suffixes

    before, suffixes.SMALL = suffixes.SMALL, small
    try:
        order, group = multikey_quicksort([np.array([r[i] for r in rows], np.uint64) for i in (0, 1)])
    finally:
        suffixes.SMALL = before
    got = [rows[i] for i in order.tolist()]
    assert got == sorted(rows) and group.tolist() == [sorted(set(rows)).index(r) for r in got]


def test_whole_copies_take_no_part_in_the_exchange(spark, monkeypatch):
    rows = corpus(4)
    rows = [*rows, *((i + 5000, t) for i, t in rows if i is not None), (6, "short"), (8, "short"), (None, "short")]
    seen, whole = [], substrings.R.exchange

    def counted(docs, *args, **kwargs):
        seen.append(docs.count())
        return whole(docs, *args, **kwargs)

    monkeypatch.setattr(substrings.R, "exchange", counted)
    got = substrings.remove_repeats(frame(spark, rows), block_bytes=2000).collect()
    assert sorted(((r["__id"], bytes(r["__kept"]), r["__n_bytes"], len(r["__spans"])) for r in got), key=repr) == plain_bytes(rows, 50)
    least = {}
    for i, t in rows:
        least[t or ""] = min(least.get(t or "", float("inf")), float("inf") if i is None else i)
    assert seen == [sum(least[t or ""] == (float("inf") if i is None else i) for i, t in rows)]


def test_copies_are_marked_by_one_plan_at_any_size(spark):
    rows = [(i, f"text {i % 7}") for i in range(20)]
    marked = substrings.marked_copies(frame(spark, rows), "doc_id", "text")
    assert sorted(r["__id"] for r in marked.collect() if r["__copy"]) == list(range(7, 20))
    plan = marked._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="ab", min_size=40, max_size=200), st.sampled_from([5, 20, 30]))
def test_suffix_order(text, depth):
    data = text.encode()
    starts = np.arange(len(data) - depth + 1)
    order, group = sort_suffixes(data, starts, depth)
    strings = [data[s : s + depth] for s in starts[order].tolist()]
    assert strings == sorted(strings)
    assert [a == b for a, b in zip(strings, strings[1:], strict=False)] == [a == b for a, b in zip(group.tolist(), group.tolist()[1:], strict=False)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \tÄ\n", max_size=30)), max_size=12))
def test_word_spans_are_those_of_split(texts):
    column = pa.array([t.encode() if t is not None else None for t in texts], pa.binary())
    found = [[] for _ in texts]
    for piece in K.text_slices(column, each=16):
        begins, ends = K.spans(piece.buf, piece.starts)
        for b, e, p in zip(begins, ends, K.piece_of(piece.starts, begins), strict=True):
            found[piece.rows[p]].append(piece.buf[b:e].tobytes())
    assert found == [(t or "").encode().split() for t in texts]
