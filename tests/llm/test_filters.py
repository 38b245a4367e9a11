import random
import tracemalloc
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scatterlake.llm import decontam, shards, toxicity
from scatterlake.llm.common import scratch_path


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7))) for _ in range(n))


def plain_contained(docs, items, words_=5, threshold=0.8):
    out = []
    for d, text in docs:
        have = set(decontam.shingles((text or "").encode(), words_))
        for i, item in items:
            grams = decontam.shingles((item or "").encode(), words_)
            shared = sum(g in have for g in grams)
            if grams and shared >= threshold * len(grams):
                out.append((d, i, shared, len(grams)))
    return sorted(out, key=repr)


def test_containment_against_brute_force(spark):
    rng = random.Random(6)
    items = [(i, words(rng, rng.randint(1, 60))) for i in range(30)] + [(50, None), (51, ""), (52, "two words"), (53, "two words")]
    docs = []
    for i in range(60):
        body = words(rng, rng.randint(0, 200)).split()
        if i % 3 == 0:
            leak = rng.choice(items[:30])[1].upper().split()
            for _ in range(rng.randint(0, 3)):
                leak[rng.randrange(len(leak))] = "changed"
            body[10:10] = leak
        docs.append((i, " ".join(body)))
    docs += [(100, None), (101, ""), (102, "Two\tWORDS"), (103, "one two words"), (5, docs[0][1]), (None, docs[0][1]), (104, "w " * 60_000)]
    d = spark.createDataFrame([(i, t, 9) for i, t in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame(items, "item_id long, text string")
    for block in (8 << 20, 400):
        got = decontam.contained_items(d, b, block_bytes=block).collect()
        assert sorted((tuple(r) for r in got), key=repr) == plain_contained(docs, items)
    kept = decontam.without_items(d, b).collect()
    dirty = {(x, t) for x, t in docs if plain_contained([(x, t)], items)}
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=repr) == sorted((x for x in docs if x not in dirty), key=repr)
    narrow = b.where("item_id < 40").withColumn("item_id", b["item_id"].cast("int"))
    assert sorted(tuple(r)[:2] for r in decontam.contained_items(d.where("doc_id < 60"), narrow).collect()) == sorted(r[:2] for r in plain_contained(docs[:60] + docs[64:65], items[:30]))
    assert decontam.contained_items(d.limit(0), b).count() == 0 and decontam.contained_items(d, b.limit(0)).count() == 0


def test_toxicity_learns_words_and_never_held_out_labels(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(900):
        bad = i % 3 == 0
        body = words(rng, 40).split()
        if bad:
            body.insert(rng.randrange(40), rng.choice(["Vile!", "awful"]))
        rows.append((i, " ".join(body), 5.0))
        held = zlib.crc32(str(i).encode()) % 4 == 2
        labels.append((i, int(bad) if not held else int(not bad), 1))  # held-out labels lie
    rows += [(2000, None, 0.0), (2001, "", 0.0), (2001, "awful", 0.0), (None, "fine words", 0.0), (2002, "awful " * 30_000, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __label double")
    model = toxicity.train(docs, spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0)], "doc_id long, toxic int, text int"))
    out = {(r["doc_id"], r["text"]): r["s"] for r in toxicity.score(docs, model, out_col="s").collect()}
    assert len(out) == len(rows) and all(0 <= s <= 1 for s in out.values())
    right = [(out[(i, t)] >= toxicity.THRESHOLD) == (i % 3 == 0) for i, t, _ in rows[:900]]
    assert sum(right) >= 890
    assert out[(2002, "awful " * 30_000)] == pytest.approx(out[(2001, "awful")], abs=0.5) and out[(2000, None)] == out[(2001, "")]
    few = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int, text int"), max_features=2000)
    assert 0 < len(few.features) < len(model.features)
    assert toxicity.score(docs, model, out_col="__label").columns == ["doc_id", "text", "__label"]
    empty = toxicity.train(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int"))
    assert {round(r["__score"], 6) for r in toxicity.score(docs.limit(5), empty).collect()} == {0.5}



def test_toxicity_holds_its_sample_once_in_the_driver(spark):
    docs = spark.range(1600).select(F.col("id").alias("doc_id"), F.expr("array_join(transform(sequence(1, 3000), i -> pmod(xxhash64(id, i), 90000)), ' ')").alias("text"))
    labels = docs.select("doc_id", F.expr("cast(doc_id % 2 as int)").alias("toxic"))
    settings = toxicity.Settings(bits=12, epochs=1)
    n = docs.join(labels.where(~toxicity.held_out(F.col("doc_id"))), "doc_id").count()
    tracemalloc.start()
    toxicity.train(docs, labels, settings=settings)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # nearly all of the 4,096 features occur in each text, four bytes each
    assert 3 * 4096 * n < peak < 1.5 * 4 * 4096 * n

def test_sharding_round_trip(spark):
    rows = [(i, f"text {i}" * (i % 50), None if i % 9 == 0 else i % 5) for i in range(400)] + [(1, "text 1", 1), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __part int").repartition(6)
    store = shards.shard(df, scratch_path(spark, "test"), df["__part"], target_bytes=8000)
    assert sorted(map(tuple, store.read().collect()), key=repr) == sorted(rows, key=repr)
    assert len(store.versions()) == 1 and max(map(len, [store.manifest().runs])) < shards.FAN_IN + 1
    old = store.manifest()
    store.append(df.limit(3))
    assert store.read(old.version).count() == len(rows) and store.read().count() == len(rows) + 3
    with pytest.raises(shards.Conflict):
        store.commit(old, (), old.schema)
    assert shards.shard(df.limit(0), scratch_path(spark, "test"), df["__part"]).read().count() == 0


def test_sharding_keeps_every_column_and_tries_again_after_a_conflict(spark):
    df = spark.createDataFrame([(i, i * 2, f"t{i}") for i in range(20)], "doc_id long, __arrival long, text string")
    store = shards.shard(df, scratch_path(spark, "test"), df["doc_id"] % 3)
    assert sorted(map(tuple, store.read().collect())) == [(i, i * 2, f"t{i}") for i in range(20)]
    whole, stale = store.manifest, [store.manifest()]
    store.append(df.limit(2))
    store.manifest = lambda version=None: stale.pop() if stale else whole(version)  # the first look is out of date
    store.append(df.limit(3))
    assert store.read().count() == 25


def test_a_vacuum_leaves_the_files_of_a_writer_at_work(spark):
    df = spark.range(100).selectExpr("id AS doc_id")
    root = scratch_path(spark, "test")
    store, other = shards.ShardTable(spark, root), shards.ShardTable(spark, root)
    store.append(df.limit(5))
    commit = store.commit

    def interrupted(*args):
        assert other.vacuum() == 0  # between the write and the commit
        return commit(*args)

    store.commit = interrupted
    store.append(df)
    assert other.read().count() == 105
    for _ in range(4):
        other.append(df)
    store.compact()  # merges, with a vacuum before its commit
    assert other.read().count() == 505
    assert other.vacuum() > 0 and other.vacuum() == 0
    assert store.read().count() == 505
    assert not list(store._fs.listStatus(store._path(f"{root}/writers")))


def test_a_lost_writer_is_cleaned_up_after_its_lease(spark):
    df = spark.range(10).selectExpr("id AS doc_id")
    root = scratch_path(spark, "test")
    store, late = shards.ShardTable(spark, root), shards.ShardTable(spark, root, lease_s=-1)

    def lost(*_):
        raise KeyboardInterrupt

    store.append(df)
    store.commit = lost
    with pytest.raises(KeyboardInterrupt):
        store.append(df)
    assert late.vacuum() == 0  # it took its files with it
    slow = shards.ShardTable(spark, root)
    still = slow._still_writing

    def overtaken(folder):
        late.vacuum()
        still(folder)

    slow._still_writing = overtaken
    with pytest.raises(shards.Expired):
        slow.append(df)
    assert shards.ShardTable(spark, root).read().count() == 10


def test_appends_with_other_columns_lose_none(spark):
    store = shards.ShardTable(spark, scratch_path(spark, "test"))
    wide = spark.createDataFrame([(i, f"b{i}") for i in range(6)], "id long, b string")
    narrow = spark.createDataFrame([(10 + i,) for i in range(3)], "id long")
    store.append(wide)
    for _ in range(3):
        store.append(narrow)
    store.append(spark.createDataFrame([(99, 1.5)], "ID long, c double"))
    store.compact()
    store.vacuum()
    got = sorted(map(tuple, store.read().select("id", "b", "c").collect()), key=repr)
    want = [(i, f"b{i}", None) for i in range(6)] + 3 * [(10 + i, None, None) for i in range(3)] + [(99, None, 1.5)]
    assert got == sorted(want, key=repr)
    with pytest.raises(ValueError, match="column b"):
        store.append(spark.createDataFrame([(1, 2)], "id long, b long"))
    assert store.read().count() == len(want)


def test_arrivals_come_in_order_with_nulls_apart(spark):
    df = spark.createDataFrame([(1, -1), (2, None), (3, 0), (4, 10), (5, 9)], "id long, a int")
    store = shards.ShardTable(spark, scratch_path(spark, "test"))
    manifest = store.append_arrivals(df, df["a"])
    assert [store._read([r], manifest.schema).first()["id"] for r in manifest.runs] == [2, 1, 3, 5, 4]
    assert len(store.versions()) == 1


def test_pipeline_keeps_clean_documents_and_columns(spark, tmp_path):
    rng = random.Random(9)
    docs, labels, items = [], [], [(i, words(rng, 30)) for i in range(5)]
    for i in range(500):
        body = words(rng, 60).split()
        if i % 4 == 0:
            body.insert(30, "awful")
        docs.append([i, " ".join(body)])
        labels.append((i, int(i % 4 == 0)))
    shared = "a line that very many documents share, " + words(rng, 8)
    for i in (1, 2, 3, 5, 6, 7):
        docs[i][1] += "\n" + shared
    docs[11][1] = docs[9][1]
    docs[13][1] += " " + items[2][1]
    docs += [[600, None], [601, ""]]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    read, sizes = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    columns = read.columns
    for n, (name, fn) in enumerate(corpus_pipeline.STAGES):
        fn(spark, read, str(tmp_path)).write.parquet(f"{tmp_path}/out{n}")
        read = spark.read.parquet(f"{tmp_path}/out{n}")
        if n < 4:
            assert read.columns == columns
            assert read.where("n_chars <> length(text)").count() == 0 or n == 0
        sizes.append({r["doc_id"] for r in read.select("doc_id").collect()})
    clean = {i for i, _ in docs if i >= 600 or i % 4}
    assert len(clean - sizes[0]) <= 2 and len(sizes[0] - clean) <= 12
    assert sizes[1] == sizes[0] and {11, 601} & sizes[2] == set() and sizes[1] - sizes[2] == {11, 601} & sizes[1]
    assert sizes[2] - sizes[3] == {13} and sizes[4] == sizes[3]
    lines = {r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/out1").where(f"text LIKE '%{shared}%'").select("doc_id").collect()}
    assert lines == {7}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == sizes[4]
    # lazy results of two runs and of single stages live side by side
    first, second = corpus_pipeline.run(spark, str(tmp_path)), corpus_pipeline.run(spark, str(tmp_path))
    kept = spark.read.parquet(f"{tmp_path}/out3")
    a, b = corpus_pipeline.pack(spark, kept, str(tmp_path)), corpus_pipeline.pack(spark, kept, str(tmp_path))
    near = corpus_pipeline.drop_near_duplicates(spark, kept, str(tmp_path))
    for rows in (first, second, a, b, near):
        assert {r["doc_id"] for r in rows.select("doc_id").collect()} == sizes[4]


def test_pipeline_over_empty_tables_and_clashing_columns(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, __n_lines int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    line = "a line that is long enough to be judged by its key " * 2
    docs = spark.createDataFrame([(i, f"{line}\nown words {i}", 7, 8) for i in range(6)], "doc_id long, text string, __n_lines int, __text_hash int")
    for _, fn in corpus_pipeline.STAGES[:4]:
        docs = fn(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "__n_lines", "__text_hash"]
    assert sorted((r[0], r[1].count(line), r[2], r[3]) for r in docs.collect()) == [(i, int(i == 5), 7, 8) for i in range(6)]
