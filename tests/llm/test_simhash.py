import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from scatterlake.llm import simhash
from scatterlake.llm.common import stage
from scatterlake.llm.components import _star, components


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: least[find(i)] for i, d in enumerate(ids)}


def test_fingerprint_is_the_plain_majority():
    texts = [None, "", "  \t", "One", "one two", "A b C d  e\x0bf", "x " * 50, "Ünï cöde ÄB " * 7]
    assert [simhash.fingerprint(t.encode() if t is not None else None) for t in texts] == [plain_fingerprint(t) for t in texts]


@pytest.mark.parametrize(("clusters", "wide"), [(40, 60_000), (1, 3)])
def test_bucket_links_are_those_of_all_pairs(clusters, wide):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, clusters, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base.tolist():
        for _ in range(12):
            v = b
            for bit in rng.integers(0, 64, rng.integers(1, 5)).tolist():
                v ^= 1 << bit
            fps.add(v)
    fps = np.array(sorted(fps), np.uint64)
    keys, rows = [], []
    for wild in range(64):
        half = fps >> np.uint64(32) if wild < 32 else fps & np.uint64(0xFFFFFFFF)
        keys.append((np.int64(wild) << 32) | (half & ~(np.uint64(1) << np.uint64(wild % 32))).astype(np.int64))
        rows.append(fps.view(np.int64))
    keys, rows = np.concatenate(keys), np.concatenate(rows)

    def classes(links):
        ids = [int(x) for x in fps]
        parent = {x: x for x in ids}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            a, b = a % 2**64, b % 2**64
            assert (a ^ b).bit_count() <= 3
            parent[find(a)] = find(b)
        return {frozenset(y for y in ids if find(y) == find(x)) for x in ids}

    expected = plain_components([int(x) for x in fps], [int(x) for x in fps])
    want = {frozenset(k for k, v in expected.items() if v == r) for r in set(expected.values())}
    assert classes(simhash.bucket_links(keys, rows, wide=wide)) == want


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_components_of_a_chain_and_a_star(spark, few):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, x) for x in range(101, 130)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b", few=few).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 130)}


def test_a_hub_is_split(spark):
    """A star of 100,000 links: the join of a star step is one that adaptive execution has split."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        links = spark.range(1, 100_001, 1, 8).select(F.lit(0).cast("long").alias("v"), F.col("id").alias("u"))
        out = _star(stage(links.select("u", "v"), "hub"), True)
        out.count()
        plan = out._jdf.queryExecution()
        out.collect()
        assert "skew=true" in plan.executedPlan().toString() or "isSkewJoin=true" in plan.executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_near_duplicates_against_brute_force(spark):
    base = " ".join(f"w{i % 37}x{i % 11}" for i in range(300))
    rows = [
        (5, base), (3, base), (9, base + " tail"), (1, None), (2, ""), (4, " \t"), (6, "short one"), (7, "SHORT one"),
        (8, "entirely different words " * 9), (None, base), (11, "x" * 100_000),
    ]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, __fp int")
    out = simhash.near_duplicates(docs).collect()
    assert len(out) == len(rows)
    known = [(i, t) for i, t in rows if i is not None]
    want = plain_components([i for i, _ in known], [plain_fingerprint(t) for _, t in known])
    assert {r["__id"]: r["__component"] for r in out if r["__id"] is not None} == want
    assert next(r["__component"] for r in out if r["__id"] is None) == want[5]


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_components_of_random_links(spark, few):
    rng = np.random.default_rng(12)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))]
    parent = {x: x for pair in links for x in pair}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b", few=few).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
