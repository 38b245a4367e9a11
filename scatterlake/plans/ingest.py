"""Queries of readers, logs, set operations and live behaviour."""

from __future__ import annotations

from pyspark.sql import functions as F

from scatterlake.plans.registry import query
from scatterlake.session import table, work_path
from scatterlake.sources import hdf5, samples, spec
from scatterlake.sources.standins import FRAME_SQL, SIDE
from scatterlake.streaming import live, waiting

CARRY = "carried AS (SELECT *, last_value(CAST(nullif(regexp_extract(text, '^#S ([0-9]+)', 1), '') AS INTEGER) IGNORE NULLS) OVER (PARTITION BY file ORDER BY line_no) AS scan FROM line)"


@query("spec_parse", f"""WITH {samples.LOG_SQL}, {CARRY} SELECT file, scan, max(CASE WHEN text LIKE '#D%' THEN substr(text, 4) END) AS started, CAST(2 AS INTEGER) AS motors, CAST(3 AS INTEGER) AS counters,
count(*) FILTER (WHERE regexp_matches(text, '^[-+0-9.]')) AS n_rows, round(coalesce(sum(TRY_CAST(split_part(text, ' ', 1) AS DOUBLE)) FILTER (WHERE regexp_matches(text, '^[-+0-9.]')), 0), 6) AS total FROM carried WHERE scan IS NOT NULL GROUP BY file, scan""")
def spec_parse(spark, sf_dir):
    return spec.scans(samples.scan_log(spark, sf_dir))


@query("find_scans", f"WITH {samples.LOG_SQL}, {CARRY} SELECT file, line_no, scan FROM carried WHERE text LIKE '#C mark %' AND length(text) = 9 AND scan IS NOT NULL")
def find_scans(spark, sf_dir):
    return spec.find_scans(samples.scan_log(spark, sf_dir), "#C mark ")


@query("scan_state", f"WITH {samples.LOG_SQL}, b AS (SELECT file, line_no, CAST(regexp_extract(text, '^#S ([0-9]+)', 1) AS INTEGER) AS scan FROM line WHERE text LIKE '#S %') SELECT file, scan, EXISTS (SELECT 1 FROM line l WHERE l.file = b.file AND l.text = '#X ' || b.scan) AS finished, lead(scan) OVER (PARTITION BY file ORDER BY line_no) IS NOT NULL AS overtaken FROM b")
def scan_state(spark, sf_dir):
    return spec.states(samples.scan_log(spark, sf_dir))


@query("frame_ids", "SELECT l_partkey AS id FROM lineitem WHERE l_quantity > 45 INTERSECT SELECT p_partkey FROM part WHERE p_size < 20")
def frame_ids(spark, sf_dir):
    """Two scan lists, their common entries, each once."""
    a = table(spark, sf_dir, "lineitem").where(F.col("l_quantity") > 45).select(F.col("l_partkey").alias("id"))
    return a.intersect(table(spark, sf_dir, "part").where(F.col("p_size") < 20).select("p_partkey"))


@query("mcs_mesh", """WITH v AS (SELECT vec_id // 10 AS y, vec_id % 10 AS k, CAST(embedding[1] AS DOUBLE) AS c FROM embeddings WHERE vec_id % 10 < 9), m AS (SELECT y, k + 1 AS x, c FROM v UNION ALL SELECT y, 0, c FROM v WHERE k = 1)
SELECT y, CASE WHEN y % 2 = 1 THEN 9 - x ELSE x END AS x, round(c, 6) + 0.0 AS c FROM m""")
def mcs_mesh(spark, sf_dir):
    """Lines into a (fast, slow) mesh. A point is put first that copies the second stored value; then the snake is undone."""
    from scatterlake.operators.pattern import snake_x

    k = F.col("vec_id") % 10
    v = table(spark, sf_dir, "embeddings").where(k < 9).select(F.expr("vec_id div 10").alias("y"), k.alias("k"), F.col("embedding")[0].cast("double").alias("c"))
    places = F.when(F.col("k") == 1, F.array(F.col("k") + 1, F.lit(0).cast("long"))).otherwise(F.array(F.col("k") + 1))
    rows = v.select("y", F.explode(places).alias("x0"), "c")
    return rows.select("y", snake_x("x0", "y", 10).alias("x"), (F.round("c", 6) + F.lit(0.0)).alias("c"))


@query("load_proj", "SELECT vec_id, CAST(k AS INTEGER) AS k, CASE WHEN k % 9 = 0 THEN 0 ELSE round(1 / (1 + abs(CAST(v AS DOUBLE))), 6) END AS v FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS k FROM embeddings)")
def load_proj(spark, sf_dir):
    """What isn't finite becomes 0; every ninth value is made NaN or infinite first."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "v"))
    bad = F.when(F.col("k") % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    rows = rows.withColumn("v", F.when(F.col("k") % 9 == 0, bad).otherwise(1 / (1 + F.abs(F.col("v").cast("double")))))
    finite = ~F.isnan("v") & (F.abs("v") < float("inf"))
    return rows.select("vec_id", "k", F.when(finite, F.round("v", 6)).otherwise(0.0).alias("v"))


@query("json_props", "SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k, count(*) AS n, min(CAST(to_json({'t': event_type}) AS VARCHAR)) AS back FROM events GROUP BY event_type")
def json_props(spark, sf_dir):
    parsed = F.from_json("props", "k long")["k"]
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.sum(parsed).alias("k"), F.count(F.lit(1)).alias("n"), F.min(F.to_json(F.struct(F.col("event_type").alias("t")))).cast("string").alias("back")
    )


@query("angles_parse", f"WITH pose AS ({samples.POSE_SQL}) SELECT p, round(rot_y, 2) AS phi, round(-rot_x, 2) + 0.0 AS chi FROM (SELECT p, rot_y, floor(rot_x * 4) / 4 AS rot_x FROM pose)")
def angles_parse(spark, sf_dir):
    """Angles read back from the file names that the poses of the stage give their images."""
    name = F.format_string("sample_phi%.2f_chi%.2f_0001.edf", F.col("rot_y"), -F.floor(F.col("rot_x") * 4) / 4)
    names = samples.poses(spark, sf_dir).select("p", name.alias("name"))
    part = lambda mark: F.regexp_extract("name", rf"{mark}(-?[0-9.]+)_", 1).cast("double") + F.lit(0.0)
    return names.select("p", part("phi").alias("phi"), part("chi").alias("chi"))


@query("poisson")
def poisson(spark, sf_dir):
    """Noise by row, from hashes of its key: above 32 a rounded normal held at 0, below the inverse of the distribution.

    Whole batches are drawn at once; a row's draw doesn't depend on its batch.
    """
    import numpy as np
    import pyarrow as pa

    def noise(batches):
        for b in batches:
            key, mean, u1, u2 = (b.column(i).to_numpy() for i in range(4))
            # from 53 bits of a hash: inside (0, 1)
            u1, u2 = (((u.view(np.uint64) >> np.uint64(11)).astype(float) + 0.5) / 2.0**53 for u in (u1, u2))
            normal = np.sqrt(-2 * np.log(u1)) * np.cos(2 * np.pi * u2)
            many = np.maximum(0, np.rint(mean + np.sqrt(mean) * normal)).astype(np.int64)
            few = np.zeros(b.num_rows, np.int64)
            small = np.minimum(mean, 32.0)
            chance = np.exp(-small)
            reached = chance.copy()
            for k in range(1, 200):  # beyond 200 at a mean of 32 lies less than a double can tell
                short = reached < u1
                if not short.any():
                    break
                few[short] = k
                chance = chance * small / k
                reached = reached + chance
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.where(mean > 32, many, few))], ["event_id", "mean", "count"])

    rows = table(spark, sf_dir, "events").where(F.col("value").isNotNull()).select("event_id", F.abs("value").cast("double").alias("mean"))
    drawn = rows.select("event_id", "mean", F.xxhash64(F.lit(11), "event_id").alias("u1"), F.xxhash64(F.lit(12), "event_id").alias("u2"))
    return drawn.mapInArrow(noise, "event_id long, mean double, count long")


@query("line_release", "WITH l AS (SELECT user_id AS scan, event_id AS line, round(value, 6) AS value, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS next FROM events WHERE value IS NOT NULL) SELECT scan, line, value FROM l WHERE next IS NOT NULL")
def line_release(spark, sf_dir):
    rows = live.run_available(live.released_lines(live.event_stream(spark, sf_dir)), "lines")
    return rows.select("scan", "line", F.round("value", 6).alias("value"))


@query("queue_replay", "SELECT event_type, CASE WHEN value > 20 THEN 'done' ELSE 'failed' END AS status, count(*) AS n FROM events GROUP BY ALL")
def queue_replay(spark, sf_dir):
    return live.replay_queue(live.event_stream(spark, sf_dir), F.col("value") > 20).groupBy("event_type", "status").agg(F.count(F.lit(1)).alias("n"))


@query("scan_steps", "SELECT event_type AS scan, CAST(count(*) AS BIGINT) AS n, round(avg(step), 6) AS mean_step FROM (SELECT event_type, date_diff('second', lag(date_trunc('second', ts)) OVER w, date_trunc('second', ts)) AS step FROM events WINDOW w AS (PARTITION BY event_type ORDER BY date_trunc('second', ts), event_id)) WHERE step IS NOT NULL GROUP BY event_type")
def scan_steps(spark, sf_dir):
    """Mean time between the frames of each scan: the steps of a sorted scan add up to its span, so nothing is sorted."""
    t = F.unix_timestamp(F.date_trunc("second", "ts"))
    rows = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("scan")).agg((F.count(t) - 1).alias("n"), (F.max(t) - F.min(t)).alias("span"))
    return rows.where(F.col("n") > 0).select("scan", "n", F.round(F.col("span") / F.col("n"), 6).alias("mean_step"))


def _stored(spark, sf_dir, per_file):
    """The embeddings' frames written as HDF5 files; the folder's path."""
    pixels = F.transform("embedding", lambda v: F.floor(F.abs(v.cast("double")) * 1000).cast("double"))
    rows = table(spark, sf_dir, "embeddings").where(F.size("embedding") == SIDE * SIDE)
    path = work_path(spark, "hdf5")
    frames = rows.select(F.col("vec_id").alias("label"), F.lit(SIDE).alias("rows"), F.lit(SIDE).alias("columns"), pixels.alias("data"))
    hdf5.write_hdf5(frames, path, dtype="int32", framesPerChunk=16, fileBytes=per_file * SIDE * SIDE * 4)
    return path


@query("hdf5_frames", f"SELECT vec_id, row, col, counts FROM ({FRAME_SQL}) WHERE row BETWEEN 2 AND 5 AND col BETWEEN 1 AND 6")
def hdf5_frames(spark, sf_dir):
    """A window of every frame, from HDF5 files of many chunks."""
    tiles = hdf5.read_hdf5(spark, _stored(spark, sf_dir, 4096), labels="/entry/label", rows="2:6", columns="1:7")
    cells = tiles.select(F.col("label").alias("vec_id"), "row", "column", "columns", F.posexplode("data").alias("k", "counts"))
    return cells.select(
        "vec_id", (F.col("row") + F.expr("CAST(k div columns AS INT)")).alias("row"), (F.col("column") + F.col("k") % F.col("columns")).alias("col"), "counts"
    )


@query("hdf5_sums", f"SELECT row, CAST(count(*) AS BIGINT) AS n, sum(counts) AS counts, max(counts) AS most FROM ({FRAME_SQL}) GROUP BY row")
def hdf5_sums(spark, sf_dir):
    """Sums over all frames by detector row, summed within a tile before anything moves."""
    tiles = hdf5.read_hdf5(spark, _stored(spark, sf_dir, 4096))
    lines = tiles.select(F.posexplode(F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda r: F.slice("data", r * F.col("columns") + 1, F.col("columns")))).alias("r", "line"), "row")
    sums = lines.groupBy((F.col("row") + F.col("r")).alias("row")).agg(
        F.sum(F.size("line")).alias("n"), F.sum(F.aggregate("line", F.lit(0.0), lambda a, v: a + v)).alias("counts"), F.max(F.array_max("line")).alias("most")
    )
    return sums.select("row", F.col("n").cast("long").alias("n"), "counts", "most")


@query("frame_wait", """WITH f AS (SELECT event_id // 16 AS scan, event_id % 16 AS frame, epoch_ms(ts) AS ms, event_type <> 'error' AS came, max(epoch_ms(ts)) FILTER (WHERE event_type <> 'error') OVER () AS newest FROM events),
after_gap AS (SELECT *, came AND frame > 0 AND NOT coalesce(lag(came) OVER w, false) AS opens FROM f WINDOW w AS (PARTITION BY scan ORDER BY frame)),
due AS (SELECT *, coalesce(max(ms) FILTER (WHERE opens) OVER (PARTITION BY scan ORDER BY frame), 0) AS waits, min(ms) FILTER (WHERE came) OVER (PARTITION BY scan ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS then_at FROM after_gap)
SELECT scan, frame, CASE WHEN NOT came THEN 'missing' WHEN frame = 15 THEN 'final' ELSE 'released' END AS status FROM due
WHERE CASE WHEN came THEN waits = 0 OR waits + 3600000 <= newest ELSE then_at + 3600000 <= newest END""")
def frame_wait(spark, sf_dir):
    """Frames released in order: errors are frames that never come, an hour is waited for each gap, the sixteenth closes a scan."""
    rows = live.event_stream(spark, sf_dir).where(F.col("event_type") != "error")
    rows = rows.select(F.expr("event_id div 16").alias("scan"), (F.col("event_id") % 16).alias("frame"), "ts")
    return live.run_available(waiting.waited_frames(rows, "scan", "frame", "ts", F.col("frame") == 15, patience=3600), "waiting")
