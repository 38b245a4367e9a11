"""Spelling variants: words one edit apart, found by bands of letter-parity masks.

A word's mask has a bit for each letter that occurs an odd number of times. One
inserted or deleted letter flips one bit, a replaced one two at most, so of
three bands of the mask one is equal at least (two, if the lengths differ).
Words meet by an equality join on equal bands with the length; the candidates
are filtered by their masks and verified. Frequent words draw in the rare ones
next to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scatterlake.llm.common import discard_path, stage
from scatterlake.llm.lines import LOWER, UPPER

LETTERS = r"[A-Za-zÀ-ÿ]+"
MIN_CHARS = 7
MIN_COUNT = 2
#: A word is the form of a near one if it occurs so many times as often.
RATIO = 10
#: The mask has three bands of so many bits.
BAND_BITS = 21
BANDS = 3
#: Letters at an end of the word that sharpen the key of words of one length: one edit leaves one end whole.
END = 3


def _bit(letter: Column) -> Column:
    """The mask's bit of a letter: a-z and U+00C0-U+00FF in turn to the three bands."""
    code = F.ascii(letter)
    number = F.when(code >= 0xC0, code - 0xC0 + 26).otherwise(F.pmod(code - ord("a"), F.lit(90)))
    return (F.pmod(number, F.lit(BANDS)) * BAND_BITS + F.pmod(F.floor(number / BANDS), F.lit(BAND_BITS))).cast("int")


def parity_mask(word: Column) -> Column:
    """63 bits: whether each letter (class of letters, beyond a-z) occurs an odd number of times."""
    letters = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(word, i, F.lit(1)))
    return F.when(F.length(word) == 0, F.lit(0).cast("long")).otherwise(
        F.aggregate(letters, F.lit(0).cast("long"), lambda m, c: m.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), _bit(c))))
    )


def count_words(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_count: int = MIN_COUNT,
    drop_every: int | None = None,
) -> DataFrame:
    """(word, n): runs of letters, A-Z lower-cased, with at least ``min_chars`` code points and ``min_count`` occurrences.

    With ``drop_every``, a run whose CRC-32 of ``<id>:<run>`` it divides loses
    the code point at that number modulo its length, as a slip of the pen.

    Whole texts are read; null or empty ones have no words. A null id is the
    empty string before the colon. Repeated rows count again. No rows: no words.
    """
    lowered = F.translate(F.col(text_col), UPPER, LOWER)
    runs = F.filter(F.regexp_extract_all(lowered, F.lit(LETTERS), F.lit(0)), lambda w: F.length(w) >= min_chars)
    found = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    word = F.col("run")
    if drop_every:
        found = found.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
        at = F.pmod(F.col("h"), F.length("run").cast("long")).cast("int")
        cut = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))
        word = F.when(F.pmod(F.col("h"), F.lit(drop_every)) == 0, cut).otherwise(word)
    words = found.select(word.alias("word")).where(F.length("word") >= min_chars)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def _band(mask: str, b: int) -> Column:
    return F.shiftrightunsigned(F.col(mask), b * BAND_BITS).bitwiseAND(F.lit((1 << BAND_BITS) - 1))


def near_pairs(words: DataFrame, word_col: str = "word", min_chars: int = MIN_CHARS) -> DataFrame:
    """(a, b, n_a, n_b): each pair of different words that are one inserted, deleted or replaced code point apart, once.

    ``words`` has (``word_col``, n), each word once, of ``min_chars`` code points at least.

    Words of one length share a band and one whole end; an end of ``END``
    letters in the key keeps a band that most words share (one of rare letters)
    from bringing them all together. Words whose lengths differ by one share
    exactly two bands. Each pair is kept under its first common key only.
    """
    end = min(END, min_chars // 2)
    base = words.select(F.col(word_col).alias("w"), "n", parity_mask(F.col(word_col)).alias("m"), F.length(word_col).alias("len"))
    head, tail = F.substring("w", 1, end), F.expr(f"right(w, {end})")
    bands = [_band("m", b) for b in range(BANDS)]
    side = lambda s: F.lit(s).cast("tinyint")
    # under: the number of the key, 0-2 with the head, 3-5 with the tail, 6-8 by the band left out
    same = [F.struct(side(e * BANDS + b).alias("under"), F.xxhash64(F.lit(e * BANDS + b), bands[b], F.col("len"), part).alias("key")) for e, part in enumerate([head, tail]) for b in range(BANDS)]
    def two(length: Column) -> list[Column]:
        return [F.struct(side(2 * BANDS + b).alias("under"), F.xxhash64(F.lit(2 * BANDS + b), *(x for i, x in enumerate(bands) if i != b), length).alias("key")) for b in range(BANDS)]

    left = base.select(F.explode(F.array(*same, *two(F.col("len")))).alias("k"), F.col("w").alias("a"), F.col("n").alias("n_a"), F.col("m").alias("m_a"))
    right = base.select(F.explode(F.array(*same, *two(F.col("len") - 1))).alias("k"), F.col("w").alias("b"), F.col("n").alias("n_b"), F.col("m").alias("m_b"))
    left, right = left.select("k.*", "a", "n_a", "m_a"), right.select("k.key", "b", "n_b", "m_b")
    flipped = F.col("m_a").bitwiseXOR(F.col("m_b"))
    differs = [flipped.bitwiseAND(F.lit(((1 << BAND_BITS) - 1) << (b * BAND_BITS))) != 0 for b in range(BANDS)]
    of = F.col("under")
    earlier = F.pmod(of, F.lit(BANDS))
    first = ((earlier < 1) | differs[0]) & ((earlier < 2) | differs[1]) & ((of < BANDS) | (F.substring("a", 1, end) != F.substring("b", 1, end)))
    bits = F.bit_count(flipped)
    fits = F.when(of >= 2 * BANDS, bits == 1).otherwise(bits.isin(0, 2) & (F.col("a") < F.col("b")) & first)
    return (
        left.join(right, "key")
        .where(fits)
        .where(F.levenshtein("a", "b", 1) == 1)
        .select("a", "b", "n_a", "n_b")
    )


def _followed(links: DataFrame) -> DataFrame:
    """(word, root): the last word that following ``links`` (word, form) leads to, by doubling the steps.

    A form occurs ``RATIO`` times as often as its word, so chains are short and have no loops.
    """
    far = stage(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = far.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = stage(far.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard_path(far)
        if longer.where("moved").isEmpty():
            return longer.drop("moved")
        far = longer.drop("moved")


def variant_groups(words: DataFrame, ratio: int = RATIO, min_chars: int = MIN_CHARS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for each row of ``words`` (word, n).

    ``n_near`` counts the words one edit away. ``form`` is the one of them with
    the largest n (ties: the smallest in code-point order), if that is
    ``ratio`` times the word's n at least, else null. ``root`` is where
    following forms ends: the word itself if it has none. ``words`` holds each
    word once, as ``count_words`` gives them; other columns are ignored. No
    words: no rows.
    """
    words = stage(words.select("word", "n"), "words")
    pairs = near_pairs(words, min_chars=min_chars)
    ways = F.array(
        F.struct(F.col("a").alias("word"), (-F.col("n_b")).alias("order"), F.col("b").alias("near")),
        F.struct(F.col("b").alias("word"), (-F.col("n_a")).alias("order"), F.col("a").alias("near")),
    )
    near = pairs.select(F.explode(ways).alias("x")).select("x.*").groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct("order", "near")).alias("best")
    )
    drawn = -F.col("best.order") >= F.lit(ratio) * F.col("n")
    formed = stage(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(drawn, F.col("best.near")).alias("form"), F.when(drawn, -F.col("best.order")).alias("form_n"),
        ),
        "forms",
    )
    roots = _followed(formed.where(F.col("form").isNotNull()))
    return formed.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
