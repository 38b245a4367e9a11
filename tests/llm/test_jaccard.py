import numpy as np

import corpus_pipeline
from scatterlake.llm import jaccard


def plain_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_kept(rows):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [plain_set(t) for _, t in rows]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b == set() or (a or b) and 5 * len(a & b) >= 4 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted(least.values())


def made_rows():
    rng = np.random.default_rng(4)
    texts = ["", " \t", None, "One two", "one TWO", "one two three four five six"]
    for size in (12, 40, 150, 400):
        base = [f"w{x}" for x in rng.integers(0, 500, size)]
        for changed in [0, 0, *rng.integers(1, max(2, size // 16), 25).tolist()]:
            text = list(base)
            for place in rng.integers(0, size, changed).tolist():
                text[place] = f"v{rng.integers(0, 500)}"
            texts.append(" ".join(text))
    return [(i, texts[i]) for i in rng.permutation(len(texts)).tolist()]


def test_stage_keeps_what_all_pairs_keep(spark):
    rows = made_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert got == plain_kept(rows)


def test_order_of_frequent_shingles_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "_frequent", lambda *_: np.zeros(0, np.int64))
    rows = made_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == plain_kept(rows)


def test_bitmaps_never_refuse_a_similar_pair():
    rng = np.random.default_rng(8)
    refused = 0
    for round_ in range(400):
        most = 900 if round_ % 2 else 6_000
        a = np.unique(rng.integers(-(2**63), 2**63 - 1, rng.integers(1, most)))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.choice([0.3, 0.85, 0.95])], rng.integers(-(2**63), 2**63 - 1, rng.integers(0, most // 15))]))
        if not len(b):
            continue
        shared = len(np.intersect1d(a, b))
        passes = jaccard.possible(np.array([len(a)]), np.array([len(b)]), [jaccard.bitmap(a)], [jaccard.bitmap(b)])[0]
        refused += not passes
        assert passes or 5 * shared < 4 * (len(a) + len(b) - shared)
        columns = [np.zeros(2, np.int64), np.array([1, 2]), np.array([len(a), len(b)], np.int32), np.zeros(2, np.int32), np.array([1, 2])]
        folds = np.frombuffer(b"".join(jaccard.folded(jaccard.bitmap(x)) for x in (a, b)), np.uint64).reshape(2, -1)
        assert len(jaccard.meetings(*columns, folds)[0]) or 5 * shared < 4 * (len(a) + len(b) - shared)
    assert refused > 150
    # texts that share a quarter are refused at any length
    for size in (900, 6_000, 40_000):
        a, b = (np.unique(rng.integers(-(2**63), 2**63 - 1, size)) for _ in range(2))
        b = np.unique(np.concatenate([a[: size // 4], b[size // 4 :]]))
        assert not jaccard.possible(np.array([len(a)]), np.array([len(b)]), [jaccard.bitmap(a)], [jaccard.bitmap(b)])[0]


def test_empty_tables_null_ids_and_repeated_rows(spark):
    kind = "doc_id long, text string, node long, key string"
    none = spark.createDataFrame([], kind)
    assert corpus_pipeline.drop_near_duplicates(spark, none, "").count() == 0
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(7, long, 1, "a"), (7, long, 1, "a"), (None, long + " more", 2, "b"), (None, "alone here", None, None), (3, None, 3, "c"), (4, " ", 3, "c")]
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, kind), "")
    assert got.columns == ["doc_id", "text", "node", "key"]
    assert sorted(got.collect(), key=str) == sorted([(7, long, 1, "a"), (None, "alone here", None, None), (3, None, 3, "c")], key=str)


def test_a_class_that_holds_most_of_a_run_is_paired_with_the_others_only():
    keys = np.zeros(3002, np.int64)
    fps = np.arange(3002)
    classes = np.array([5] * 3000 + [1, 9])
    a, b = jaccard.meetings(keys, fps, np.full(3002, 9), np.zeros(3002, np.int64), classes, np.zeros((3002, jaccard.FOLDED // 64), np.uint64))
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == {(i, j) for i in range(3002) for j in (3000, 3001) if i < j}


def test_the_stage_verifies_what_simhash_proposes(spark, monkeypatch):
    """The fingerprints of the texts go through the SimHash operator, and what it proposes is verified and kept."""
    from scatterlake.llm import simhash

    rng = np.random.default_rng(6)
    base = [f"w{x}" for x in rng.integers(0, 5000, 300)]
    rows = [(0, " ".join(base)), (1, " ".join([*base, "more"])), (2, " ".join(base[:-1])), (3, "something else altogether here"), (4, "")]
    seen, whole = [], simhash.fingerprint_links

    def told(distinct, fp, n, *each):
        seen.append(sorted(r[fp] for r in distinct.collect()))
        return whole(distinct, fp, n, *each)

    monkeypatch.setattr(jaccard, "fingerprint_links", told)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert kept == plain_kept(rows) == [0, 3, 4]
    assert seen == [sorted({int(np.uint64(simhash.fingerprint(t.encode())).view(np.int64)) for _, t in rows})]
    texts = spark.createDataFrame([(1, 8), (2, 8), (3, 9), (4, 1 << 40), (5, (1 << 62) - 1)], "__fp long, h long")
    pairs = {tuple(r) for r in jaccard.proposed(texts).collect()}
    assert {(1, 2), (1, 3)} <= pairs <= {(1, 2), (1, 3), (1, 4), (3, 4)} and len(pairs) >= 3
