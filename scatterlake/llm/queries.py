"""The registered queries of the training-data operators, with their oracle SQL.

Each query applies one operator, with production parameters, to its whole
table and derives the contract's digest columns from the operator's output.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scatterlake.llm import codes, decontam, exact, knn, lines, packing, passages, pii, shards, simhash, spelling, substrings, toxicity
from scatterlake.llm.common import scratch_path, stage, table


def _tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), _tokenizer_path())


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        F.col("__id").alias("doc_id"),
        F.col("__n_bytes").alias("n_bytes"),
        F.expr("aggregate(__spans, 0L, (n, x) -> n + x.end - x.start)").alias("n_removed"),
        F.size("__spans").cast("long").alias("n_spans"),
        F.sha2("__kept", 256).alias("kept_sha256"),
    )


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pii.find_personal_data(docs, pii.train(docs))
    return out.select(
        "doc_id",
        *(F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in pii.KINDS),
        F.sha2(pii.all_spans(with_added=False), 256).alias("base_sha256"),
        pii.all_spans(with_added=True).alias("spans"),
        (sum((F.size(f"__{k}") for k in pii.KINDS), F.size("__added"))).cast("long").alias("n_spans"),
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.drop_common_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.col("__n_lines").alias("n_lines"),
        F.col("__n_dropped").alias("n_dropped"),
        F.sha2(F.col("text"), 256).alias("kept_sha256"),
    )


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return knn.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


#: Arrivals that the sharding query replays.
ARRIVALS = 8


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    store = shards.shard(docs, scratch_path(spark, "shards"), F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS)))
    tiers = Counter(store.tier(r) for r in store.manifest().runs)
    return store.read().select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.sha2("text", 256).alias("text_sha256"),
        F.lit(all(n < store.fan_in for n in tiers.values())).alias("compacted"),
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        F.col("__id").alias("doc_id"),
        F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"),
        F.col("__component").alias("component_id"),
    )


def op5_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = passages.remove_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        F.col("__id").alias("doc_id"),
        F.col("__n_words").alias("n_words"),
        F.col("__n_removed").alias("n_removed"),
        F.sha2("__kept", 256).alias("kept_sha256"),
    )


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contained_items(
        table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    )
    return found.select(
        F.col("__id").alias("doc_id"),
        F.col("__item").alias("item_id"),
        F.col("__shared").alias("n_shared"),
        F.col("__size").alias("n_shingles"),
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, out_col="score").select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model = codes.compress(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))
    rows = codes.group_total(stage(rows, "codes"), "label", "__error", "label_error")
    return rows.select(
        "vec_id",
        F.col("__code").alias("code"),
        F.col("__error").alias("error"),
        "label_error",
        F.lit(model.digest() if model else "").alias("codebooks_sha256"),
    )


#: The divisor of hashes by which the spelling query plants slips in the words that it reads.
SLIPS = 31


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.count_words(table(spark, sf_dir, "documents").select("doc_id", "text"), drop_every=SLIPS)
    return spelling.variant_groups(words).select("word", "n", "n_near", "form", "form_n", "root")


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact.exact_copies(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        F.col("__id").alias("doc_id"),
        F.col("__keep").alias("keep_id"),
        F.col("__size").alias("group_size"),
        F.col("__kept").alias("kept"),
        F.col("__sha").alias("text_sha256"),
    )


def _codes_sql(rounds: int = codes.ROUNDS, parts: int = codes.PARTS, entries: int = codes.ENTRIES) -> str:
    """The rounds of op11 as a chain of common tables: components in rows, one assignment and one mean for each round."""

    def assigned(n: int) -> str:
        return f"""a{n} AS MATERIALIZED (
  SELECT rid, part, min(ROW(d, entry)) AS hit FROM (
    SELECT x.rid, x.part, b.entry, sum((x.x - b.x) * (x.x - b.x)) AS d
    FROM comp x JOIN b{n} b ON x.part = b.part AND x.pos = b.pos GROUP BY x.rid, x.part, b.entry
  ) GROUP BY rid, part
)"""

    def refined(n: int) -> str:
        return f"""b{n + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, b.pos, coalesce(m.x, b.x) AS x FROM b{n} b LEFT JOIN (
    SELECT a.part, a.hit[2] AS entry, c.pos, CAST(floor(sum(c.x)::DOUBLE / count(*)) AS BIGINT) AS x
    FROM a{n} a JOIN comp c ON a.rid = c.rid AND a.part = c.part GROUP BY a.part, a.hit[2], c.pos
  ) m ON b.part = m.part AND b.entry = m.entry AND b.pos = m.pos
)"""

    chain = ",\n".join(f"{assigned(n)},\n{refined(n)}" for n in range(rounds))
    return f"""
WITH good AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({codes.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), vec AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS rid, vec_id, label, v FROM good
), comp AS MATERIALIZED (
  SELECT rid, i // w AS part, i % w AS pos, x FROM (
    SELECT rid, unnest(range(len(v))) AS i, unnest(v) AS x, len(v) // {parts} AS w FROM vec)
), b0 AS MATERIALIZED (
  SELECT part, rid AS entry, pos, x FROM comp WHERE rid < {entries}
), {chain},
{assigned(rounds)}, coded AS (
  SELECT rid, string_agg(printf('%02x', hit[2]), '' ORDER BY part) AS code, CAST(sum(hit[1]) AS BIGINT) AS error FROM a{rounds} GROUP BY rid
)
SELECT v.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY v.label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM b{rounds}) AS codebooks_sha256
FROM vec v JOIN coded c ON v.rid = c.rid"""


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_pii": op3_pii,
    "op4_line_dedup": op4_line_dedup,
    "op5_passage_dedup": op5_passage_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_toxicity": op7_toxicity,
    "op8_top_k": op8_top_k,
    "op9_sharding": op9_sharding,
    "op10_simhash": op10_simhash,
    "op11_vector_codes": op11_vector_codes,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_exact_dedup": op13_exact_dedup,
}

ORACLE = {
    "op11_vector_codes": _codes_sql(),
    "op13_exact_dedup": r"""
WITH doc AS (
  SELECT row_number() OVER () AS rid, doc_id, length(coalesce(text, '')) AS n,
         translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS norm
  FROM documents
), ranked AS (
  SELECT doc_id, norm, first_value(doc_id) OVER w AS keep_id, row_number() OVER w = 1 AS kept FROM doc
  WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST, rid)
)
SELECT doc_id, keep_id, count(*) OVER (PARTITION BY norm) AS group_size, kept, sha256(norm) AS text_sha256 FROM ranked""",
    "op4_line_dedup": r"""
WITH line AS (
  SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM line
), common AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id <> c.keeper AS gone
  FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id""",
    "op6_decontamination": r"""
WITH word AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') FROM benchmark
), shingle AS (
  SELECT DISTINCT side, id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT side, id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM word WHERE len(w) > 0)
), item AS (
  SELECT id, s, count(*) OVER (PARTITION BY id) AS n FROM shingle WHERE side = 'b'
)
SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared, any_value(i.n) AS n_shingles
FROM shingle d JOIN item i ON d.s = i.s WHERE d.side = 'd'
GROUP BY d.id, i.id HAVING count(*) >= 0.8 * any_value(i.n)""",
    "op9_sharding": """
SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes, sha256(text) AS text_sha256, true AS compacted FROM documents""",
    "op8_top_k": r"""
WITH vec AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), part AS (
  SELECT rid, vec_id, unnest(range(len(v))) AS i, unnest(v) AS x, len(v) AS d FROM vec
), scored AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM part q JOIN part c ON q.i = c.i AND q.d = c.d AND q.rid <> c.rid
  WHERE q.vec_id % 100 = 0 GROUP BY q.rid, q.vec_id, c.rid, c.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10""",
}
