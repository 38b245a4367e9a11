"""Near-duplicate classes by the Jaccard similarity of word shingles, without loss.

Of two sets of similarity 0.8 or more, the first fifth in any common order
share an element (prefix filter). Those fifths are indexed; an element of one
text alone goes no further. SimHash proposes first: texts whose fingerprints
differ in three bits or fewer are pairs to verify. Each text also meets the
least text of its elements, the few that it meets most often, so that groups of
copies hang together by few pairs; then texts of different classes meet, at the
elements that hold several classes only, where short bitmaps refuse most pairs
at once. The last step finds what no fingerprint can: most near copies differ
in more than three bits.
Texts that meet are held against each other by bitmaps first: the bits in which
they differ bound what the sets share from above, so nothing is lost. Pairs that
pass are verified on their whole sets. Equal word sequences collapse before all
this. Shingles frequent in a sample come last in the order, which only saves work.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scatterlake.llm.common import keep_only, parts_for, scope, stage
from scatterlake.llm.components import components
from scatterlake.llm.simhash import KEYS_EACH, SEED, fingerprint, fingerprint_links, text_hash

WORDS = 5
#: Texts that tell which shingles are frequent, at least, and one text in so many; in how many of them, and how many shingles are told to all.
SAMPLE, SHARE, OFTEN, TOLD = 5_000, 8, 5, 100_000
#: Texts that each text is held against in the first round, which joins groups of copies; the second misses no pair.
FIRST = 3
#: Odd multiplier that mixes the hashes of a shingle's words.
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Bits of a text's bitmap, at least; each shingle flips one.
BITS = 1024
#: Bits of the short bitmap that goes with each element; the longer one folded.
FOLDED = 512
#: SimHash keys in one index partition: small, as workers keep their memory for the stages that follow.
PROPOSED_EACH = 250_000
#: So many hashes of texts (8 bytes each) are sent to all.
NAMES = 1_000_000


def sequence(text: bytes | None) -> tuple[int, list[bytes]]:
    """The hash of the word sequence, and its words."""
    from xxhash import xxh64_intdigest

    tokens = (text or b"").lower().split()  # ASCII: A-Z, and blank, \t to \r
    return xxh64_intdigest(b" ".join(tokens), SEED + 1), tokens


def shingles(tokens: list[bytes], words: int = WORDS) -> np.ndarray:
    """The distinct hashes of a sequence's shingles in ascending order, each mixed from the hashes of its words."""
    from xxhash import xxh64_intdigest

    each = np.fromiter(map(xxh64_intdigest, tokens, repeat(SEED)), np.uint64, len(tokens))
    length = min(words, len(tokens))
    count = len(tokens) - length + 1 if tokens else 0
    found = np.full(count, length, np.uint64)
    for i in range(length):
        found = (found ^ (found >> np.uint64(29))) * MIX + each[i : i + count]
    return np.unique((found ^ (found >> np.uint64(32))).view(np.int64))


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value is one of ``known``, which ascend."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def bitmap(s: np.ndarray) -> bytes:
    """Bit i is set if an odd number of the set's hashes are i modulo the bits: a power of two, BITS and the set's size at least."""
    bits = max(BITS, 1 << (len(s) - 1).bit_length())
    odd = np.bincount((s.view(np.uint64) % np.uint64(bits)).astype(np.int64), minlength=bits) % 2
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(whole: bytes) -> bytes:
    """A bitmap folded to FOLDED bits: bit i is set if an odd number of hashes are i modulo these."""
    return np.bitwise_xor.reduce(np.frombuffer(whole, np.uint64).reshape(-1, FOLDED // 64), axis=0).tobytes()


def possible(na: np.ndarray, nb: np.ndarray, ma: list[bytes], mb: list[bytes]) -> np.ndarray:
    """Whether sets of these sizes and bitmaps can have similarity 0.8: each bit that differs is an element of one alone.

    Of bitmaps of different lengths the longer is folded to the shorter one's.
    """
    lengths = np.array([[len(x), len(y)] for x, y in zip(ma, mb, strict=True)], np.int64).reshape(-1, 2)
    alone = np.zeros(len(lengths), np.int64)
    for la, lb in np.unique(lengths, axis=0).tolist():
        rows = np.flatnonzero((lengths == (la, lb)).all(axis=1))
        short = min(la, lb) // 8

        def cut(maps, length):
            words = np.frombuffer(b"".join([maps[r] for r in rows.tolist()]), np.uint64)
            return np.bitwise_xor.reduce(words.reshape(len(rows), length // 8 // short, short), axis=1)

        alone[rows] = np.bitwise_count(cut(ma, la) ^ cut(mb, lb)).sum(axis=1, dtype=np.int64)
    both = na.astype(np.int64) + nb
    return 9 * (both - alone) >= 8 * both


def _source(docs, id_col, text_col):
    return docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("binary").alias("__text"), text_hash(text_col).alias("__text_hash"))


def _prefixes(docs, id_col, text_col, words, often) -> DataFrame:
    """(__id, __text_hash, __fp, h, n, s, m, f): the hash of each text's words, its SimHash, the size, first fifth, bitmap and folded bitmap of its set."""

    def prefix(s):
        late = among(s, often.value)
        return np.concatenate([s[~late], s[late]])[: len(s) // 5 + 1]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, hashes, sizes, firsts, maps = [], [], [], [], []
            for text in batch.column(1):
                fp, tokens = sequence(text.as_py())
                s = shingles(tokens, words)
                fps.append(fp)
                hashes.append(fingerprint(text.as_py()))
                sizes.append(len(s))
                firsts.append(prefix(s))
                maps.append(bitmap(s))
            columns = [batch.column(0), batch.column(2), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fps, hashes)), pa.array(sizes, pa.int32()), pa.array(firsts, pa.list_(pa.int64())), pa.array(maps, pa.binary()), pa.array([folded(m) for m in maps], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["__id", "__text_hash", "__fp", "h", "n", "s", "m", "f"])

    return _source(docs, id_col, text_col).mapInArrow(compute, "__id long, __text_hash long, __fp long, h long, n int, s array<bigint>, m binary, f binary")


def _sets(docs, id_col, text_col, words, wanted=None) -> DataFrame:
    """(__fp, n, s): the whole sets of all texts, or of those whose ascending names ``wanted`` has been sent."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, sets = [], []
            for text in batch.column(1):
                fp, tokens = sequence(text.as_py())
                name = np.array([fp], np.uint64).view(np.int64)
                if wanted is None or among(name, wanted.value)[0]:
                    fps.append(name[0])
                    sets.append(shingles(tokens, words))
            if fps:
                sizes = pa.array([len(s) for s in sets], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), sizes, pa.array(sets, pa.list_(pa.int64()))], ["__fp", "n", "s"])

    return _source(docs, id_col, text_col).mapInArrow(compute, "__fp long, n int, s array<bigint>")


def _frequent(docs, id_col, text_col, words) -> np.ndarray:
    every = min(SHARE, max(1, docs.count() // SAMPLE))
    some = docs.where(F.pmod(text_hash(text_col), F.lit(every)) == 0)
    sets = _sets(some, id_col, text_col, words).dropDuplicates(["__fp"])
    counts = stage(sets.select(F.explode("s").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= OFTEN), "frequent")
    return np.sort(np.array([r["k"] for r in counts.orderBy(F.desc("c"), "k").limit(TOLD).collect()], np.int64))


def meetings(keys, fps, sizes, places, classes, folds) -> tuple[np.ndarray, np.ndarray]:
    """Pairs in runs of equal keys, of different classes, whose sizes, places and folded bitmaps allow similarity 0.8."""
    order = np.lexsort((classes, keys))
    keys, fps, sizes, places, classes, folds = (x[order] for x in (keys, fps, sizes, places, classes, folds))
    n = len(keys)
    ends_of = lambda new: np.repeat(np.append(new, n), np.diff(np.concatenate(([0], new, [n]))))
    turns = np.diff(keys) != 0
    ends = ends_of(np.flatnonzero(turns) + 1)
    # where the class of each row ends within its run: only rows from there on are of others
    other = ends_of(np.flatnonzero(turns | (np.diff(classes) != 0)) + 1)
    out = []
    at, d = np.arange(n), 0
    while len(at := at[other[at] + d < ends[at]]):
        i, j = at, other[at] + d
        # the first shared element of a similar pair leaves room for 4 / 9 of both sizes
        room = np.minimum(sizes[i] - places[i], sizes[j] - places[j])
        both = sizes[i].astype(np.int64) + sizes[j]
        fine = 9 * room >= 4 * both
        i, j, both = i[fine], j[fine], both[fine]
        alone = np.bitwise_count(folds[i] ^ folds[j]).sum(axis=1, dtype=np.int64)
        fine = 9 * (both - alone) >= 8 * both
        if fine.any():
            out.append(np.stack([np.minimum(fps[i], fps[j]), np.maximum(fps[i], fps[j])], 1)[fine])
        d += 1
    found = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)
    return found[:, 0], found[:, 1]


def proposed(texts: DataFrame) -> DataFrame:
    """(a, b): pairs that span the groups of SimHashes ``h`` at three or fewer differing bits, texts named by ``__fp``.

    Texts of one fingerprint are held against the least of them, and the least
    ones of linked fingerprints against each other.
    """
    heads = stage(texts.groupBy("h").agg(F.min("__fp").alias("head")), "simhashes")
    alike = texts.join(heads, "h").where(F.col("__fp") != F.col("head")).select(F.col("head").alias("a"), F.col("__fp").alias("b"))
    links = stage(fingerprint_links(heads, "h", heads.count(), PROPOSED_EACH), "simhash-links")
    side = lambda of, name: heads.select(F.col("h").alias(of), F.col("head").alias(name))
    across = links.select(F.col("a").alias("ha"), F.col("b").alias("hb")).join(side("ha", "x"), "ha").join(side("hb", "y"), "hb")
    return alike.union(across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(__id, __text_hash, __class) of every row: classes are linked by Jaccard similarity 0.8 or more.

    A-Z are lower-cased, words are runs of anything but ASCII blanks, a set
    holds each ``words`` consecutive words (fewer words: the whole sequence).
    Null, empty and blank texts are equal to each other only. Repeated rows and
    ids each return a row, null ids too. No rows: no rows.
    """
    with scope() as made:
        return _classes(docs, id_col, text_col, words, made)


def _classes(docs: DataFrame, id_col: str, text_col: str, words: int, made: list[str]) -> DataFrame:
    """``near_classes``; what it stages is in ``made`` and goes as soon as nothing reads it."""
    spark = docs.sparkSession
    context = spark.sparkContext
    keep = partial(keep_only, made)

    often = context.broadcast(_frequent(docs, id_col, text_col, words))
    rows = stage(_prefixes(docs, id_col, text_col, words, often), "prefixes")
    names = stage(rows.select("__id", "__text_hash", "__fp"), "names")
    distinct = stage(rows.groupBy("__fp").agg(F.first("h").alias("h"), F.first("n").alias("n"), F.first("s").alias("s"), F.first("m").alias("m"), F.first("f").alias("f")), "distinct-prefixes")
    keep(names, distinct)

    elements = distinct.select("__fp", "n", F.posexplode("s").alias("place", "key"))
    least = [F.min("__fp").alias("first"), F.max("__fp").alias("last"), *(F.min_by(c, "__fp").alias(f"first_{c}") for c in ("n", "place"))]
    counts = elements.groupBy("key").agg(*least)
    shared = stage(counts.where(F.col("first") < F.col("last")).drop("last"), "shared")

    def wanted_sets(wanted: DataFrame) -> DataFrame:
        """The whole sets of some texts. If their names are few, they go to the texts and no other set is made."""
        if wanted.count() <= NAMES:
            few = context.broadcast(np.sort(wanted.toArrow().column(0).to_numpy()))
            return _sets(docs, id_col, text_col, words, few).dropDuplicates(["__fp"])
        return _sets(docs, id_col, text_col, words).join(wanted, "__fp", "left_semi").dropDuplicates(["__fp"])

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                fine = possible(batch.column(2).to_numpy(), batch.column(3).to_numpy(), batch.column(4).to_pylist(), batch.column(5).to_pylist())
                yield batch.select(["a", "b"]).filter(pa.array(fine))

    def similar(met: DataFrame) -> DataFrame:
        """The pairs (a, b) of similarity 0.8 or more."""
        maps = lambda name: distinct.select(F.col("__fp").alias(name), F.col("n").alias(f"n{name}"), F.col("m").alias(f"m{name}"))
        pairs = met.join(maps("a"), "a").join(maps("b"), "b").select("a", "b", "na", "nb", "ma", "mb")
        pairs = stage(pairs.mapInArrow(passing, "a long, b long"), "pairs")
        ends = stage(pairs.select(F.explode(F.array("a", "b")).alias("__fp")).distinct(), "ends")
        sets = stage(wanted_sets(ends), "sets")
        side = lambda name: sets.select(F.col("__fp").alias(name), F.col("n").alias(f"n{name}"), F.col("s").alias(f"s{name}"))
        both = F.size(F.array_intersect("sa", "sb"))
        return stage(pairs.join(side("a"), "a").join(side("b"), "b").where(9 * both >= 4 * (F.col("na") + F.col("nb"))).select("a", "b"), "similar")

    # the first shared element of a similar pair leaves room for 4 / 9 of both sizes
    room = F.least(F.col("n") - F.col("place"), F.col("first_n") - F.col("first_place"))
    fits = 9 * room >= 4 * (F.col("n") + F.col("first_n"))

    def chosen(met: DataFrame) -> DataFrame:
        """Of the pairs (first, __fp) those that meet most often, a bounded number for each text, whatever its group."""
        shares = met.where(fits).groupBy("__fp", "first").agg(F.count(F.lit(1)).alias("c"))
        most = F.slice(F.sort_array(F.collect_list(F.struct("c", F.bitwise_not("first").alias("order"), "first")), asc=False), 1, FIRST)
        return shares.groupBy("__fp").agg(most.alias("most")).select(F.explode("most.first").alias("a"), F.col("__fp").alias("b"))

    # groups of copies hang together by few pairs, of each text and the least of each of its elements; only pairs across classes are left then
    links = similar(proposed(distinct).union(chosen(elements.join(shared, "key").where(F.col("__fp") != F.col("first")))).distinct())
    roots = stage(components(links, "a", "b"), "roots")
    keep(names, distinct, shared, links, roots)

    labelled = distinct.join(roots, F.col("__fp") == F.col("node"), "left").select("__fp", "n", F.coalesce("root", "__fp").alias("root"), "f", F.posexplode("s").alias("place", "key"))
    labelled = labelled.join(shared.select("key"), "key", "left_semi")
    classes = labelled.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    mixed = stage(classes.where(F.col("low") < F.col("high")).select("key"), "mixed")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[*(c.to_numpy() for c in b.columns[:5]), np.frombuffer(b"".join(b.column(5).to_pylist()), np.uint64).reshape(-1, FOLDED // 64)] for b in batches if b.num_rows]
        if got:
            a, b = meetings(*(np.concatenate(c) for c in zip(*got, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    total = distinct.agg(F.coalesce(F.sum(F.size("s")), F.lit(0))).first()[0]
    spread = parts_for(total, KEYS_EACH, int(spark.conf.get("spark.sql.shuffle.partitions")))
    crossing = labelled.join(mixed, "key", "left_semi").select("key", "__fp", "n", "place", "root", "f")
    rest = similar(crossing.repartition(spread, "key").mapInArrow(meet, "a long, b long").distinct())
    ends = stage(components(links.union(rest), "a", "b"), "ends")
    keep(names, ends)
    return names.join(ends, F.col("__fp") == F.col("node"), "left").select("__id", "__text_hash", F.coalesce("root", "__fp").alias("__class"))
