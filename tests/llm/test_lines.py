from collections import defaultdict

from scatterlake.llm.lines import drop_common_lines


def plain(rows, min_chars=40, min_docs=5):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(lower)
    held = defaultdict(set)
    for n, (_, text) in enumerate(rows):
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                held[key(line)].add(n)
    out = []
    for i, text in rows:
        keep, lines = [], (text or "").split("\n")
        for line in lines:
            holders = held.get(key(line), ())
            ids = [rows[n][0] for n in holders if rows[n][0] is not None]
            if len(holders) < min_docs or i == max(ids, default=None):
                keep.append(line)
        out.append((i, "\n".join(keep), len(lines), len(lines) - len(keep)))
    return out


def test_lines_against_brute_force(spark):
    common = "This Line is shared by very many documents, ä and long enough."
    edge = "e" * 39
    rows = [(i, f"own {i}\n  {common.upper() if i % 2 else common}\t\n{edge}\n\nlast {i}") for i in range(8)]
    rows += [(20, None), (21, ""), (22, "\n\n"), (23, f"{common}\n{common}"), (24, common), (24, common), (None, common + "\nx")]
    rows += [(30 + i, "y" * 40) for i in range(4)] + [(50, "z\n" * 5000 + common)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, pos int, keyed int")
    out = drop_common_lines(docs)
    assert out.columns == ["doc_id", "text", "pos", "keyed", "__n_lines", "__n_dropped"]
    got = [(r["doc_id"], r["text"], r["__n_lines"], r["__n_dropped"]) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(plain(rows), key=repr)


def test_empty_table(spark):
    assert drop_common_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
