import hashlib

import pytest

from scatterlake.llm.exact import exact_copies, without_copies

BLANKS = " \t\n\x0b\x0c\r"


def plain(rows):
    """(id, keep, size, sha) of each row, and how many rows of each group stay: one."""
    groups = {}
    for i, text in rows:
        norm = "".join(c for c in text or "" if c not in BLANKS)
        groups.setdefault(norm, []).append((-len(text or ""), i is None, i))
    out = []
    for i, text in rows:
        norm = "".join(c for c in text or "" if c not in BLANKS)
        out.append((i, min(groups[norm])[2], len(groups[norm]), hashlib.sha256(norm.encode()).hexdigest()))
    return out, len(groups)


def order(row):
    return tuple((x is None, str(x)) for x in row)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = exact_copies(df, **kw).collect()
    expected, groups = plain(rows)
    assert sorted([(r["__id"], r["__keep"], r["__size"], r["__sha"]) for r in got], key=order) == sorted(expected, key=order)
    kept = [r for r in got if r["__kept"]]
    assert len(kept) == len({r["__sha"] for r in kept}) == groups
    assert all(r["__id"] == r["__keep"] for r in kept)


@pytest.mark.parametrize("part_bytes", [1 << 30, 400, 60])
def test_against_brute_force(spark, part_bytes):
    rows = [(i, f"text {i % 17}" + " " * (i % 3)) for i in range(200)]
    rows += [(1000 + i, "the  same\ttext") for i in range(150)]  # a group over many partitions
    rows += [(2000, None), (2001, ""), (2002, " \n\x0b\x0c\r\t"), (None, "the same text"), (None, None), (5, "text 5"), (5, "text 5")]
    rows += [(3000 + i, "A" * 100 + str(i // 2)) for i in range(40)]  # one opening, longer than the head of the key
    rows += [(4000, "é x"), (4001, "é  x"), (4002, "éx"), (4003, "\U0001f600 x"), (4004, "\U0001f600x")]
    run(spark, rows, part_bytes=part_bytes)


def test_one_group_over_all_partitions(spark):
    run(spark, [(i, "x" * 50) for i in range(300)], part_bytes=100)


def test_very_long_text_and_no_rows(spark):
    long = "word " * 300_000
    run(spark, [(1, long), (2, long + " "), (3, "short")], part_bytes=1 << 20)
    run(spark, [])


def test_rows_stay_whole_under_any_column_names(spark):
    rows = [(1, "a b", 7, "u"), (2, "ab", 8, "v"), (3, "c", 9, None), (4, "ab ", 1, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __keep long, `__c0` string")
    assert sorted(tuple(r) for r in without_copies(df).collect()) == [rows[0], rows[2]]
    got = exact_copies(df, carry=["__c0"]).select("__id", "__c0").collect()
    assert sorted((r[0], r[1]) for r in got if r[1]) == [(1, "u"), (2, "v"), (4, "w")]
