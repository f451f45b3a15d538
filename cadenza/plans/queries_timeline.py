"""Registered queries of selection, joins, aggregates and timelines, each with its DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import aggregates as ag
from ..operators import joins as jn
from ..operators import selection as sel
from ..operators import timeline as tl
from . import projections as p

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
S, E = p.S_US, p.E_US
PERIOD_US = 21_600_000_000
FPS = 1e6 / PERIOD_US


def query(name: str, sql: str | None = None, ctes: tuple[str, ...] = ()):
    def add(f):
        QUERIES[name] = f
        if sql:
            head = ", ".join(p.SQL[c] for c in ctes)
            ORACLES[name] = (f"WITH {head}, {sql.strip()[5:]}" if sql.strip().startswith("WITH ") else f"WITH {head} {sql}") if head else sql
        return f

    return add


OUT = ["asset_id", "track_id", "seq", "pts_us", "size_bytes", "keyframe"]
_out = "asset_id, track_id, seq, pts_us, size_bytes, keyframe"


@query(
    "trim_keyframe_iso",
    f"""WITH s AS (SELECT *, coalesce(CASE WHEN track_kind = 'video' THEN max(CASE WHEN keyframe AND pts_us <= {S} THEN seq END) OVER t ELSE min(CASE WHEN dts_us + duration_us > {S} THEN seq END) OVER t END, 0) AS s0
  FROM packets WINDOW t AS (PARTITION BY asset_id, track_id)),
e AS (SELECT *, min(CASE WHEN seq >= s0 AND dts_us >= {E} THEN seq END) OVER (PARTITION BY asset_id, track_id) AS e0 FROM s),
k AS (SELECT * FROM e WHERE seq >= s0 AND (e0 IS NULL OR seq < greatest(e0, s0 + 1)))
SELECT {_out}, dts_us - min(dts_us) OVER t AS out_dts_us, pts_us - min(dts_us) OVER t AS out_pts_us FROM k WINDOW t AS (PARTITION BY asset_id, track_id)""",
    ("packets",),
)
def trim_keyframe_iso(spark, d):
    return sel.trim_keyframe_iso(p.packets(spark, d), S, E).select(*OUT, "out_dts_us", "out_pts_us")


@query(
    "trim_keyframe_webm",
    f"""WITH t AS (SELECT asset_id, track_id, track_kind, min(CASE WHEN keyframe AND pts_us >= {S} THEN pts_us END) AS on_key, max(CASE WHEN keyframe AND pts_us <= {S} THEN pts_us END) AS at_key,
  min(CASE WHEN keyframe THEN pts_us END) AS any_key, max(pts_us + coalesce(duration_us, 0)) AS stop FROM packets GROUP BY ALL),
a AS (SELECT asset_id, coalesce(max(on_key) FILTER (track_kind = 'video'), min(coalesce(at_key, any_key)) FILTER (track_kind = 'video'), {S}) AS s0, max(stop) AS stop FROM t GROUP BY asset_id),
k AS (SELECT packets.*, s0 FROM packets JOIN a USING (asset_id) WHERE pts_us >= s0 AND pts_us < least(s0 + {E - S}, stop)),
v AS (SELECT *, CASE WHEN track_kind = 'video' THEN coalesce(min(CASE WHEN keyframe THEN seq END) OVER w, min(seq) OVER w) ELSE 0 END AS key_seq FROM k WINDOW w AS (PARTITION BY asset_id, track_id))
SELECT {_out}, pts_us - s0 AS out_pts_us FROM v WHERE seq >= key_seq""",
    ("packets",),
)
def trim_keyframe_webm(spark, d):
    return sel.trim_keyframe_webm(p.packets(spark, d), S, E).select(*OUT, "out_pts_us")


@query(
    "trim_keyframe_ts",
    f"""WITH r AS (SELECT *, pts_us - min(pts_us) OVER (PARTITION BY asset_id) AS rel, CASE WHEN lead(pts_us) OVER o > pts_us THEN lead(pts_us) OVER o - pts_us WHEN pts_us > lag(pts_us) OVER o THEN pts_us - lag(pts_us) OVER o ELSE 0 END AS dur
  FROM packets WINDOW o AS (PARTITION BY asset_id, track_id ORDER BY seq)),
s AS (SELECT *, CASE WHEN track_kind = 'video' THEN coalesce(max(CASE WHEN keyframe AND rel <= {S} THEN seq END) OVER t, 0) ELSE min(CASE WHEN rel + dur > {S} THEN seq END) OVER t END AS s0 FROM r WINDOW t AS (PARTITION BY asset_id, track_id)),
e AS (SELECT *, min(CASE WHEN seq >= s0 AND rel + dur > {E} THEN seq END) OVER (PARTITION BY asset_id, track_id) AS e0 FROM s)
SELECT {_out}, rel AS rel_pts_us FROM e WHERE seq >= s0 AND (e0 IS NULL OR seq < greatest(e0, s0 + 1))""",
    ("packets",),
)
def trim_keyframe_ts(spark, d):
    return sel.trim_keyframe_ts(p.packets(spark, d), S, E).select(*OUT, "rel_pts_us")


@query(
    "trim_frames_overlap",
    f"""WITH k AS (SELECT * FROM packets WHERE pts_us + coalesce(greatest(duration_us, 0), 1) > {S} AND pts_us < {E})
SELECT {_out}, pts_us - min(pts_us) OVER (PARTITION BY asset_id, track_id) AS out_pts_us FROM k""",
    ("packets",),
)
def trim_frames_overlap(spark, d):
    return sel.trim_packets_overlap(p.packets(spark, d), S, E).select(*OUT, "out_pts_us")


@query(
    "trim_flac_frames",
    "SELECT asset_id, track_id, block_no, start_frame FROM pcm WHERE start_frame + 64 > 160 AND start_frame < 800",
    ("pcm",),
)
def trim_flac_frames(spark, d):
    frames = p.pcm(spark, d).withColumns({"start_sample": F.col("start_frame"), "samples": F.lit(64)})
    return sel.trim_flac_frames(frames, 0.01, 0.05, p.RATE).select("asset_id", "track_id", "block_no", "start_frame")


@query(
    "trim_frames_exact",
    f"""WITH k AS (SELECT * FROM packets WHERE pts_us >= {S} AND pts_us < {E}) SELECT {_out}, pts_us - min(pts_us) OVER (PARTITION BY asset_id, track_id) AS out_pts_us FROM k""",
    ("packets",),
)
def trim_frames_exact(spark, d):
    return sel.trim_frames_exact(p.packets(spark, d), S, E).select(*OUT, "out_pts_us")


@query(
    "trim_pcm_exact",
    """WITH l AS (SELECT asset_id, block_no, start_frame + i - 1 AS frame, x[i] AS x FROM (SELECT *, unnest(range(1, 65)) AS i FROM pcm))
SELECT asset_id, frame, x FROM l WHERE frame >= 160 AND frame < 790""",
    ("pcm",),
)
def trim_pcm_exact(spark, d):
    kept = sel.trim_pcm_exact(p.pcm(spark, d), 0.01, 790 / 16000)
    return kept.select("asset_id", "start_frame", F.posexplode(F.get("planar", F.lit(0))).alias("i", "x")).select("asset_id", (F.col("start_frame") + F.col("i")).cast("bigint").alias("frame"), "x")


@query(
    "trim_gapless",
    """WITH k AS (SELECT asset_id, block_no, greatest(start_frame, 100) AS a, least(start_frame + 64, 1100) AS b FROM pcm)
SELECT asset_id, block_no, a AS start_frame, b - a AS frames, floor((a - 100) * 1e6 / 16000 + 0.5)::BIGINT AS ts_us FROM k WHERE b > a""",
    ("pcm",),
)
def trim_gapless(spark, d):
    kept = sel.trim_gapless(p.pcm(spark, d), 100, 1000)
    return kept.select("asset_id", "block_no", "start_frame", F.size(F.get("planar", F.lit(0))).cast("bigint").alias("frames"), "ts_us")


@query(
    "seek_frame",
    f"""SELECT asset_id, track_id, coalesce(min(seq) FILTER (pts_us >= {S}), max(seq)) AS seq, coalesce(arg_min(pts_us, seq) FILTER (pts_us >= {S}), arg_max(pts_us, seq)) AS pts_us FROM packets GROUP BY asset_id, track_id""",
    ("packets",),
)
def seek_frame(spark, d):
    return sel.seek_frame(p.packets(spark, d), S).select("asset_id", "track_id", "seq", "pts_us")


@query(
    "seek_window",
    f"""WITH s AS (SELECT *, coalesce(max(CASE WHEN keyframe AND pts_us <= {S} THEN seq END) OVER (PARTITION BY asset_id, track_id), 0) AS s0 FROM packets) SELECT {_out} FROM s WHERE seq >= s0""",
    ("packets",),
)
def seek_window(spark, d):
    return sel.seek_window(p.packets(spark, d), S).select(*OUT)


@query(
    "seek_keyframe_asof",
    """WITH k AS (SELECT track_id, seq, pts_us FROM packets WHERE keyframe),
t AS (SELECT o_orderkey, (o_custkey + 9) // 10 AS track_id, (o_orderkey * 7919 % 2592000) * 1000000 AS t_us FROM orders)
SELECT t.o_orderkey, t.track_id, t.t_us, k.seq AS key_seq, k.pts_us AS key_pts_us FROM t ASOF LEFT JOIN k ON t.track_id = k.track_id AND t.t_us >= k.pts_us""",
    ("packets",),
)
def seek_keyframe_asof(spark, d):
    keys = p.packets(spark, d).where("keyframe").select("track_id", "pts_us", F.col("seq").alias("key_seq"), F.col("pts_us").alias("key_pts_us"))
    targets = p.table(spark, d, "orders").select("o_orderkey", F.floor((F.col("o_custkey") + 9) / 10).cast("bigint").alias("track_id"), ((F.col("o_orderkey") * 7919 % 2592000) * 1000000).alias("t_us"))
    return jn.asof_backward(targets, keys, ["track_id"], "t_us", "pts_us", ["key_seq", "key_pts_us"])


@query(
    "expand_sample_tables",
    """WITH c AS (SELECT *, CASE WHEN seq < 4 THEN seq // 2 ELSE 2 + (seq - 4) // 3 END AS chunk FROM samples)
SELECT asset_id, seq, (1000 * (chunk + 1) + coalesce(sum(size_bytes) OVER (PARTITION BY asset_id, chunk ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset", size_bytes,
  coalesce(sum(delta) OVER b, 0)::BIGINT AS dts_ticks, (coalesce(sum(delta) OVER b, 0) + ctts)::BIGINT AS pts_ticks, delta::BIGINT AS duration_ticks, keyframe OR max(keyframe::INT) OVER (PARTITION BY asset_id) = 0 AS keyframe
FROM c WINDOW b AS (PARTITION BY asset_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    ("samples",),
)
def expand_sample_tables(spark, d):
    s = p.samples(spark, d)
    rle = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("seq", c))), lambda x: x[c])
    pairs = lambda c, name: F.transform(rle(c), lambda v: F.struct(F.lit(1).alias("count"), v.alias(name)))
    n = F.count("*")
    chunks = F.when(n <= 4, F.ceil(n / 2)).otherwise(2 + F.ceil((n - 4) / 3)).cast("int")
    tables = s.groupBy("asset_id", "track_id").agg(
        F.struct(
            pairs("delta", "delta").alias("stts"),
            pairs("ctts", "offset").alias("ctts"),
            rle("size_bytes").alias("stsz"),
            F.array(F.struct(F.lit(1).alias("first_chunk"), F.lit(2).alias("per_chunk")), F.struct(F.lit(3).alias("first_chunk"), F.lit(3).alias("per_chunk"))).alias("stsc"),
            F.transform(F.sequence(F.lit(1), chunks), lambda c: (c * 1000).cast("bigint")).alias("stco"),
            F.sort_array(F.collect_list(F.when(F.col("keyframe"), (F.col("seq") + 1).cast("int")))).alias("stss"),
        ).alias("st")
    )
    return tl.expand_sample_tables(tables.withColumn("edit", F.lit(0).cast("bigint"))).drop("track_id")


@query(
    "rle_encode",
    """WITH c AS (SELECT *, CASE WHEN flag IS DISTINCT FROM lag(flag) OVER o OR seq = 0 THEN 1 ELSE 0 END AS ch FROM samples WINDOW o AS (PARTITION BY asset_id ORDER BY seq)),
r AS (SELECT *, sum(ch) OVER (PARTITION BY asset_id ORDER BY seq) - 1 AS run_no FROM c) SELECT asset_id, run_no::BIGINT AS run_no, any_value(flag) AS flag, count(*) AS count FROM r GROUP BY asset_id, run_no""",
    ("samples",),
)
def rle_encode(spark, d):
    return ag.run_length_encode(p.samples(spark, d), "flag").drop("track_id")


@query("rle_decode", "SELECT asset_id, seq, flag FROM samples", ("samples",))
def rle_decode(spark, d):
    return ag.run_length_decode(ag.run_length_encode(p.samples(spark, d), "flag"), "flag").drop("track_id")


_TRACKS = "t AS (SELECT asset_id, track_id, track_kind FROM packets GROUP BY ALL)"


@query(
    "track_select",
    f"""WITH {_TRACKS}, r AS (SELECT *, row_number() OVER (PARTITION BY asset_id, track_kind ORDER BY track_id) - 1 AS n FROM t)
SELECT asset_id, track_id, track_kind, CASE WHEN track_kind = 'audio' THEN 0 ELSE 1 END::INTEGER AS ordinal FROM r WHERE (track_kind = 'audio' AND n = 0) OR (track_kind = 'video' AND n = 1)""",
    ("packets",),
)
def track_select(spark, d):
    tracks = p.packets(spark, d).select("asset_id", "track_id", "track_kind").distinct()
    return sel.select_tracks(tracks, ["audio:0@0", "video:1", "audio:0", "video:0@2"])


@query("variant_pick", "SELECT asset_id, arg_max(idx, bandwidth * 1000000 + idx) AS idx, max(bandwidth) AS bandwidth FROM segments GROUP BY asset_id", ("segments",))
def variant_pick(spark, d):
    return sel.pick_variant(p.segments(spark, d).select("asset_id", "idx", "bandwidth"), "highest")


@query("variant_pick_lowest", "SELECT asset_id, arg_min(idx, bandwidth * 1000000 + idx) AS idx, min(bandwidth) AS bandwidth FROM segments GROUP BY asset_id", ("segments",))
def variant_pick_lowest(spark, d):
    return sel.pick_variant(p.segments(spark, d).select("asset_id", "idx", "bandwidth"), "lowest")


_CFR_FRAMES = "f AS (SELECT asset_id, track_id, seq, pts_us FROM packets)"


def _frame_times(spark, d) -> DataFrame:
    return p.packets(spark, d).select("asset_id", "track_id", "seq", "pts_us", F.lit(None).cast("bigint").alias("declared_us"))


@query(
    "cfr_retime",
    f"""WITH {_CFR_FRAMES}, i AS (SELECT *, pts_us + coalesce(lead(pts_us) OVER o - pts_us, pts_us - lag(pts_us) OVER o) AS stop FROM f WINDOW o AS (PARTITION BY asset_id, track_id ORDER BY seq)),
a AS (SELECT asset_id, track_id, min(pts_us) AS start, arg_max(stop, seq) AS stop, max(seq) AS last FROM i GROUP BY ALL),
s AS (SELECT asset_id, track_id, start, last, unnest(range(greatest(1, floor((stop - start) * {FPS!r} / 1e6 + 0.5)::BIGINT))) AS out_no FROM a),
q AS (SELECT asset_id, track_id, last, out_no, start + floor(out_no * 1e6 / {FPS!r} + 0.5)::BIGINT AS ts_us FROM s),
m AS (SELECT q.asset_id, q.track_id, q.out_no, q.ts_us, any_value(q.last) AS last, min(i.seq) AS seq FROM q LEFT JOIN i ON i.asset_id = q.asset_id AND i.track_id = q.track_id AND i.stop > q.ts_us GROUP BY ALL),
z AS (SELECT *, coalesce(seq, last) AS source_seq FROM m)
SELECT asset_id, track_id, out_no, ts_us, floor((out_no + 1) * 1e6 / {FPS!r} + 0.5)::BIGINT - floor(out_no * 1e6 / {FPS!r} + 0.5)::BIGINT AS duration_us, source_seq,
  coalesce(lag(source_seq) OVER (PARTITION BY asset_id, track_id ORDER BY out_no) = source_seq, false) AS duplicate FROM z""",
    ("packets",),
)
def cfr_retime(spark, d):
    return jn.cfr_slots(_frame_times(spark, d), FPS)


@query(
    "cfr_retime_stream",
    f"""WITH {_CFR_FRAMES}, a AS (SELECT asset_id, track_id, min(pts_us) AS start, max(pts_us) AS last_pts, arg_max(gap, seq) AS gap FROM (SELECT *, coalesce(pts_us - lag(pts_us) OVER (PARTITION BY asset_id, track_id ORDER BY seq), {PERIOD_US}) AS gap FROM f) GROUP BY ALL),
s AS (SELECT asset_id, track_id, start, last_pts + gap AS stop, unnest(range(2 + ((last_pts + gap - start) // {PERIOD_US})::BIGINT)) AS out_no FROM a),
q AS (SELECT asset_id, track_id, out_no, start + floor(out_no * 1e6 / {FPS!r} + 0.5)::BIGINT AS ts_us, stop FROM s)
SELECT q.asset_id, q.track_id, q.out_no, q.ts_us, f.seq AS source_seq FROM (SELECT * FROM q WHERE ts_us < stop) q ASOF JOIN f ON q.asset_id = f.asset_id AND q.track_id = f.track_id AND q.ts_us >= f.pts_us""",
    ("packets",),
)
def cfr_retime_stream(spark, d):
    return jn.cfr_slots_streaming(_frame_times(spark, d), FPS)


@query(
    "stsc_range_join",
    """WITH r(first_chunk, per_chunk) AS (VALUES (1, 2), (3, 5), (6, 1)), c AS (SELECT asset_id, seq + 1 AS chunk FROM samples)
SELECT c.asset_id, c.chunk, r.per_chunk::BIGINT AS per_chunk FROM c ASOF JOIN r ON c.chunk >= r.first_chunk""",
    ("samples",),
)
def stsc_range_join(spark, d):
    runs = spark.createDataFrame([(1, 2), (3, 5), (6, 1)], "first_chunk bigint, per_chunk bigint")
    chunks = p.samples(spark, d).select("asset_id", (F.col("seq") + 1).alias("chunk"))
    spans = runs.withColumn("_to", F.coalesce(F.lead("first_chunk").over(Window.orderBy("first_chunk")), F.lit(1 << 60)))
    return chunks.join(F.broadcast(spans), (F.col("chunk") >= F.col("first_chunk")) & (F.col("chunk") < F.col("_to"))).select("asset_id", "chunk", "per_chunk")


@query(
    "zip_samples",
    "SELECT a.asset_id, a.track_id, a.seq, a.size_bytes, b.size_bytes AS side_bytes FROM packets a LEFT JOIN packets b ON a.asset_id = b.asset_id AND a.track_id = b.track_id AND a.seq = b.seq - 1 AND b.seq % 3 = 0",
    ("packets",),
)
def zip_samples(spark, d):
    packets = p.packets(spark, d)
    side = packets.where("seq % 3 = 0").select("asset_id", "track_id", (F.col("seq") - 1).alias("seq"), F.col("size_bytes").alias("side_bytes"))
    return jn.zip_by_position(packets.select("asset_id", "track_id", "seq", "size_bytes"), side, ["side_bytes"])


_KEYS = "k AS (SELECT n_nationkey AS kid, md5(n_name) AS key FROM nation WHERE n_regionkey <> 2)"


def _keys(spark, d) -> DataFrame:
    return p.table(spark, d, "nation").where("n_regionkey != 2").select(F.col("n_nationkey").alias("kid"), F.md5(F.col("n_name").cast("binary")).alias("key"))


@query("key_lookup", f"WITH {_KEYS} SELECT c_custkey, c_nationkey AS kid, key, key IS NOT NULL AS key_found FROM customer LEFT JOIN k ON c_nationkey = kid")
def key_lookup(spark, d):
    return jn.lookup_key(p.table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("kid")), _keys(spark, d), "kid")


@query("key_miss", f"WITH {_KEYS} SELECT s_suppkey, s_nationkey AS kid FROM supplier WHERE s_nationkey NOT IN (SELECT kid FROM k)")
def key_miss(spark, d):
    return jn.lookup_key(p.table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("kid")), _keys(spark, d), "kid").where("not key_found").select("s_suppkey", "kid")


@query(
    "hls_key_in_force",
    """WITH l AS (SELECT *, last_value(key_tag IGNORE NULLS) OVER (PARTITION BY asset_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM segments)
SELECT asset_id, idx, CASE WHEN k <> 'NONE' THEN k END AS in_force FROM l""",
    ("segments",),
)
def hls_key_in_force(spark, d):
    return jn.carry_forward(p.segments(spark, d), "key_tag", "idx").select("asset_id", "idx", "in_force")


@query("hls_duration", "SELECT asset_id, round(sum(duration_sec), 6) AS duration_sec, count(*) AS segments FROM segments GROUP BY asset_id", ("segments",))
def hls_duration(spark, d):
    return p.segments(spark, d).groupBy("asset_id").agg(F.round(F.sum("duration_sec"), 6).alias("duration_sec"), F.count("*").alias("segments"))


@query(
    "interleave_tracks",
    "SELECT asset_id, track_id, dts_us, size_bytes, row_number() OVER (PARTITION BY asset_id ORDER BY dts_us, track_id) - 1 AS position FROM interleaved",
    ("interleaved",),
)
def interleave_tracks(spark, d):
    return jn.merge_streams(p.interleaved(spark, d)).drop("stream_no")


@query(
    "interleave_packets",
    "SELECT asset_id, track_id, seq, row_number() OVER (PARTITION BY asset_id ORDER BY dts_us, track_kind, track_id, seq) - 1 AS position FROM packets",
    ("packets",),
)
def interleave_packets(spark, d):
    packets = p.packets(spark, d)
    return jn.merge_streams(packets.where("track_kind = 'audio'"), packets.where("track_kind = 'video'")).select("asset_id", "track_id", "seq", "position")


@query(
    "abr_fanout",
    """WITH r(rung, height, bitrate) AS (VALUES (0, 1080, 5000000), (1, 720, 2800000), (2, 360, 800000)) SELECT asset_id, rung::BIGINT AS rung, r.height || 'p-' || rung AS name, r.height::BIGINT AS height, bitrate::BIGINT AS bitrate FROM geometry CROSS JOIN r""",
    ("geometry",),
)
def abr_fanout(spark, d):
    from .targets import ladder

    return jn.fan_out(p.geometry(spark, d).select("asset_id"), ladder(spark, [(1080, 5_000_000), (720, 2_800_000), (360, 800_000)]).select("rung", "name", "height", "bitrate"))


@query(
    "crossfade",
    """WITH l AS (SELECT asset_id, block_no // 2 AS pair, block_no % 2 AS side, i - 1 AS frame, x[i] AS x FROM (SELECT *, unnest(range(1, 65)) AS i FROM pcm)),
a AS (SELECT asset_id, pair, frame, CASE WHEN frame >= 48 THEN x * cos((frame - 48) / 15 * (pi() / 2)) ELSE x END AS xa FROM l WHERE side = 0),
b AS (SELECT asset_id, pair, 48 + frame AS frame, CASE WHEN frame < 16 THEN x * sin(frame / 15 * (pi() / 2)) ELSE x END AS xb FROM l WHERE side = 1)
SELECT asset_id, pair, frame, round(coalesce(xa, 0) + coalesce(xb, 0), 9) AS x FROM a FULL JOIN b USING (asset_id, pair, frame)""",
    ("pcm",),
)
def crossfade(spark, d):
    """Every two consecutive blocks, 2k and 2k + 1, as one signal; a block left over is faded out."""
    blocks = p.pcm(spark, d).withColumns({"pair": F.floor(F.col("block_no") / 2).cast("bigint"), "side": F.col("block_no") % 2})
    long = blocks.select(F.struct("asset_id", "pair").alias("asset_id"), "side", F.posexplode(F.get("planar", F.lit(0))).alias("frame", "x")).withColumn("n", F.lit(64))
    out = jn.crossfade(long.where("side = 0"), long.where("side = 1"), 16)
    return out.select("asset_id.asset_id", "asset_id.pair", F.col("frame").cast("bigint").alias("frame"), F.round("x", 9).alias("x"))


@query(
    "recover_durations",
    """SELECT asset_id, track_id, seq, coalesce(lead(pts_us) OVER o - pts_us, pts_us - lag(pts_us) OVER o, 0) AS duration_us FROM packets WINDOW o AS (PARTITION BY asset_id, track_id ORDER BY pts_us, seq)""",
    ("packets",),
)
def recover_durations(spark, d):
    return jn.recover_durations(p.packets(spark, d).drop("duration_us")).select("asset_id", "track_id", "seq", "duration_us")


@query(
    "next_larger_gap",
    """WITH q AS (SELECT asset_id, track_id, seq, pts_us // 86400000000 AS pts_us FROM packets) SELECT asset_id, track_id, seq, coalesce((SELECT min(b.pts_us) FROM q b WHERE b.asset_id = a.asset_id AND b.track_id = a.track_id AND b.pts_us > a.pts_us) - pts_us,
  pts_us - (SELECT max(b.pts_us) FROM q b WHERE b.asset_id = a.asset_id AND b.track_id = a.track_id AND b.pts_us < a.pts_us)) AS duration_us FROM q a""",
    ("packets",),
)
def next_larger_gap(spark, d):
    days = p.packets(spark, d).withColumn("pts_us", F.floor(F.col("pts_us") / 86_400_000_000).cast("bigint"))
    return jn.next_larger_gap(days).select("asset_id", "track_id", "seq", "duration_us")


@query("container_duration", "SELECT asset_id, max(d) AS duration_sec FROM (SELECT asset_id, track_id, max(pts_us + coalesce(duration_us, 0)) / 1e6 AS d FROM packets GROUP BY ALL) GROUP BY asset_id", ("packets",))
def container_duration(spark, d):
    tracks = p.packets(spark, d).groupBy("asset_id", "track_id").agg((F.max(F.col("pts_us") + F.coalesce("duration_us", F.lit(0))) / 1e6).alias("duration_sec"))
    return ag.container_duration(tracks)


@query(
    "ts_duration",
    """WITH k AS (SELECT asset_id, track_id, pts_us * 9 // 100 AS t FROM packets), g AS (SELECT *, t - lag(t) OVER (PARTITION BY asset_id, track_id ORDER BY t) AS gap FROM k),
s AS (SELECT asset_id, track_id, min(t) AS a, max(t) AS b, list_sort(list(gap) FILTER (gap IS NOT NULL)) AS gaps FROM g GROUP BY ALL HAVING max(t) > min(t)),
m AS (SELECT *, gaps[len(gaps) // 2 + 1] AS gap FROM s)
SELECT asset_id, (max(b) - min(a) + coalesce(min(gap) FILTER (gap > 0), 0)) / 90000 AS duration_sec FROM m GROUP BY asset_id""",
    ("packets",),
)
def ts_duration(spark, d):
    return ag.ts_duration(p.packets(spark, d).withColumn("pts_ticks", F.expr("pts_us * 9 div 100")))


@query(
    "fps_snap",
    """WITH s AS (SELECT asset_id, track_id, (count(*) - 1) / ((max(pts_us) - min(pts_us)) * 1e-5 / 1e6) AS raw FROM packets GROUP BY ALL HAVING count(*) >= 2 AND max(pts_us) > min(pts_us))
SELECT asset_id, track_id, CASE WHEN floor(raw + 0.5) >= 1 AND abs(raw - floor(raw + 0.5)) / floor(raw + 0.5) <= 0.02 THEN floor(raw + 0.5) ELSE round(raw, 9) END AS fps FROM s""",
    ("packets",),
)
def fps_snap(spark, d):
    return ag.snapped_fps(p.packets(spark, d), 1e-5).select("asset_id", "track_id", F.round("fps", 9).alias("fps"))


@query("peak_rms", "WITH l AS (SELECT asset_id, unnest(x) AS x FROM pcm) SELECT asset_id, max(abs(x)) AS peak, round(sqrt(avg(x * x)), 9) AS rms, count(*) AS n FROM l GROUP BY asset_id", ("pcm",))
def peak_rms(spark, d):
    return ag.level(p.pcm(spark, d)).select("asset_id", "peak", F.round("rms", 9).alias("rms"), "n")


@query(
    "packet_digest",
    r"""SELECT asset_id, track_id, count(*) AS count, sum(size_bytes)::BIGINT AS total_bytes, sha256(string_agg(seq || ',' || pts_us || ',' || coalesce(duration_us::VARCHAR, '') || ',' || size_bytes || ',' || CASE WHEN keyframe THEN 1 ELSE 0 END, chr(10) ORDER BY seq)) AS sha256 FROM packets GROUP BY asset_id, track_id""",
    ("packets",),
)
def packet_digest(spark, d):
    return ag.packet_digest(p.packets(spark, d))


@query("timeline_base", f"SELECT asset_id, CASE WHEN min(t) < 0 AND max(t) >= 0 THEN 0 ELSE min(t) END AS base_us FROM (SELECT asset_id, pts_us - {S} AS t FROM packets) GROUP BY asset_id", ("packets",))
def timeline_base(spark, d):
    return ag.timeline_base(p.packets(spark, d).withColumn("pts_us", F.col("pts_us") - S), True)


@query(
    "rebase",
    f"""WITH s AS (SELECT asset_id, track_id, seq, pts_us - {S} AS p, dts_us - {S} - 1000 AS d FROM packets)
SELECT asset_id, track_id, seq, p - least(0, min(p) OVER a, min(d) OVER a) AS out_pts_us, d - least(0, min(p) OVER a, min(d) OVER a) AS out_dts_us FROM s WINDOW a AS (PARTITION BY asset_id)""",
    ("packets",),
)
def rebase(spark, d):
    moved = p.packets(spark, d).withColumns({"pts_us": F.col("pts_us") - S, "dts_us": F.col("dts_us") - S - 1000})
    return ag.rebase(moved).select("asset_id", "track_id", "seq", "out_pts_us", "out_dts_us")


@query("running_clock", "SELECT asset_id, seq, (coalesce(sum(size_bytes) OVER (PARTITION BY asset_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 312)::BIGINT AS clock FROM samples", ("samples",))
def running_clock(spark, d):
    return tl.running_clock(p.samples(spark, d), "size_bytes", -312).select("asset_id", "seq", "clock")


@query(
    "even_split",
    """WITH g AS (SELECT *, seq // 3 AS page FROM samples), e AS (SELECT *, CASE WHEN page % 4 = 2 THEN -1 ELSE (page + 1) * 1000 END AS granule, row_number() OVER (PARTITION BY asset_id, page ORDER BY seq) - 1 AS k, count(*) OVER (PARTITION BY asset_id, page) AS n FROM g),
b AS (SELECT *, CASE WHEN page = 0 THEN 0 WHEN (page - 1) % 4 = 2 THEN (page - 1) * 1000 ELSE page * 1000 END AS base FROM e),
t AS (SELECT *, CASE WHEN granule >= 0 THEN greatest(granule - base, 0) ELSE 0 END AS total FROM b)
SELECT asset_id, seq, (base + floor(k / n * total + 0.5))::BIGINT AS start_sample, (floor((k + 1) / n * total + 0.5) - floor(k / n * total + 0.5))::BIGINT AS samples FROM t""",
    ("samples",),
)
def even_split(spark, d):
    page = F.floor(F.col("seq") / 3).cast("bigint")
    rows = p.samples(spark, d).withColumn("granule", F.when(page % 4 == 2, F.lit(-1)).otherwise((page + 1) * 1000))
    return tl.even_split(rows, 48_000).select("asset_id", "seq", "start_sample", "samples")


@query(
    "weighted_granules",
    """WITH w AS (SELECT asset_id, seq, sum(size_bytes) OVER (PARTITION BY asset_id ORDER BY seq) AS upto, sum(size_bytes) OVER (PARTITION BY asset_id) AS total, max(seq) OVER (PARTITION BY asset_id) AS last FROM samples),
g AS (SELECT *, CASE WHEN seq = last THEN 5000 ELSE least(greatest(floor(5000 * upto / total + 0.5)::BIGINT, 0), 5000) END AS g FROM w)
SELECT asset_id, seq, max(g) OVER (PARTITION BY asset_id ORDER BY seq) AS granule FROM g""",
    ("samples",),
)
def weighted_granules(spark, d):
    return tl.weighted_granules(p.samples(spark, d).withColumn("target", F.lit(5000).cast("bigint")), weight="size_bytes").select("asset_id", "seq", "granule")


@query(
    "ctts",
    """WITH q AS (SELECT *, pts_us - CASE WHEN seq % 3 = 1 THEN 40000 ELSE 0 END AS dd FROM packets)
SELECT asset_id, track_id, seq, floor(CASE WHEN lead(dd) OVER o IS NOT NULL THEN greatest(lead(dd) OVER o - dd, 0) ELSE duration_us END * 90000 / 1e6 + 0.5)::BIGINT AS duration_ticks, floor((pts_us - dd) * 90000 / 1e6 + 0.5)::BIGINT AS ctts_ticks FROM q WINDOW o AS (PARTITION BY asset_id, track_id ORDER BY seq)""",
    ("packets",),
)
def ctts(spark, d):
    rows = p.packets(spark, d).withColumn("dts_us", F.col("pts_us") - F.when(F.col("seq") % 3 == 1, 40000).otherwise(0))
    return tl.composition_offsets(rows, 90_000).select("asset_id", "track_id", "seq", "duration_ticks", "ctts_ticks")


@query(
    "unwrap33",
    """WITH k AS (SELECT asset_id, track_id, seq, (pts_us * 9 // 100) % 8589934592 AS t FROM packets), w AS (SELECT *, CASE WHEN lag(t) OVER o - t > 4294967296 THEN 1 ELSE 0 END AS dr FROM k WINDOW o AS (PARTITION BY asset_id, track_id ORDER BY seq))
SELECT asset_id, track_id, seq, (t + sum(dr) OVER (PARTITION BY asset_id, track_id ORDER BY seq) * 8589934592)::BIGINT AS ticks FROM w""",
    ("packets",),
)
def unwrap33(spark, d):
    rows = p.packets(spark, d).withColumn("ticks33", F.expr("(pts_us * 9 div 100) % 8589934592"))
    return tl.unwrap_33(rows).select("asset_id", "track_id", "seq", F.col("ticks").cast("bigint").alias("ticks"))


@query(
    "fragment_runs",
    """WITH i AS (SELECT *, sum(CASE WHEN track_kind = 'video' AND keyframe THEN 1 ELSE 0 END) OVER (PARTITION BY asset_id, track_id ORDER BY seq) AS i FROM packets),
s AS (SELECT *, (row_number() OVER (PARTITION BY asset_id, track_id, i ORDER BY seq) - 1) // 4 AS s FROM i)
SELECT asset_id, track_id, seq, dense_rank() OVER (PARTITION BY asset_id, track_id ORDER BY i, s) - 1 AS run_no FROM s""",
    ("packets",),
)
def fragment_runs(spark, d):
    return tl.fragment_runs(p.packets(spark, d), 4).select("asset_id", "track_id", "seq", "run_no")


@query(
    "lazy_fragment_runs",
    """WITH RECURSIVE r AS (SELECT asset_id, track_id, track_kind, 0::BIGINT AS seq, 1 AS n, 0::BIGINT AS run_no FROM packets WHERE seq = 0 UNION ALL
SELECT p.asset_id, p.track_id, p.track_kind, p.seq, CASE WHEN b THEN 1 ELSE n + 1 END, CASE WHEN b THEN run_no + 1 ELSE run_no END FROM (SELECT q.asset_id, q.track_id, q.track_kind, q.seq, r.n, r.run_no,
  (q.track_kind <> 'video' AND r.n >= 6) OR (q.track_kind = 'video' AND ((q.keyframe AND r.n >= 6) OR r.n >= 12)) AS b FROM r JOIN packets q ON q.asset_id = r.asset_id AND q.track_id = r.track_id AND q.seq = r.seq + 1) p)
SELECT asset_id, track_id, seq, run_no FROM r""".replace("WITH RECURSIVE r", "WITH r"),
    ("packets",),
)
def lazy_fragment_runs(spark, d):
    return tl.lazy_fragment_runs(p.packets(spark, d).select(*OUT, "track_kind"), 6, 12).select("asset_id", "track_id", "seq", "run_no")


ORACLES["lazy_fragment_runs"] = ORACLES["lazy_fragment_runs"].replace("WITH p0", "WITH RECURSIVE p0", 1)


def _spans(most: str) -> str:
    """Clusters as a recursive query over an asset's blocks in order."""
    return f"""WITH RECURSIVE {p.SQL["packets"]}, x AS (SELECT asset_id, track_id, seq, pts_us // 1000000 AS t, keyframe AND track_kind = 'video' AS k, row_number() OVER (PARTITION BY asset_id ORDER BY pts_us // 1000000, track_id, seq) - 1 AS i FROM packets),
r AS (SELECT asset_id, track_id, seq, t, k, i, t AS lo, t AS hi, 1 AS n, 0::BIGINT AS run FROM x WHERE i = 0 UNION ALL
SELECT asset_id, track_id, seq, t, k, i, CASE WHEN b THEN t ELSE least(lo, t) END, CASE WHEN b THEN t ELSE greatest(hi, t) END, CASE WHEN b THEN 1 ELSE n + 1 END, CASE WHEN b THEN run + 1 ELSE run END
  FROM (SELECT x.*, r.lo, r.hi, r.n, r.run, greatest(r.hi, x.t) - least(r.lo, x.t) > {tl.CLUSTER_SPAN_MS} {most} AS b FROM r JOIN x ON x.asset_id = r.asset_id AND x.i = r.i + 1))
SELECT asset_id, track_id, seq, t AS time_ms, k AS video_key, run AS {{out}} FROM r"""


@query("cluster_plan")
def cluster_plan(spark, d):
    blocks = p.packets(spark, d).select("asset_id", "track_id", "seq", F.floor(F.col("pts_us") / 1_000_000).cast("bigint").alias("time_ms"), (F.col("keyframe") & (F.col("track_kind") == "video")).alias("video_key"))
    return tl.cluster_plan(blocks, ["time_ms", "track_id", "seq"])


@query("webm_fragments")
def webm_fragments(spark, d):
    blocks = p.packets(spark, d).select("asset_id", "track_id", "seq", F.floor(F.col("pts_us") / 1_000_000).cast("bigint").alias("time_ms"), (F.col("keyframe") & (F.col("track_kind") == "video")).alias("video_key"))
    return tl.webm_fragments(blocks, ["time_ms", "track_id", "seq"], 8)


ORACLES["cluster_plan"] = _spans("").format(out="cluster_no")
ORACLES["webm_fragments"] = _spans("OR x.k OR r.n >= 8").format(out="fragment_no")

_GREEDY = """WITH RECURSIVE {head}, r AS (SELECT asset_id, seq, 4 + w AS bytes, 0::BIGINT AS segment_no FROM x WHERE seq = 0 UNION ALL
SELECT x.asset_id, x.seq, CASE WHEN r.bytes + x.w > 200 THEN 4 + x.w ELSE r.bytes + x.w END, CASE WHEN r.bytes + x.w > 200 THEN r.segment_no + 1 ELSE r.segment_no END FROM r JOIN x ON x.asset_id = r.asset_id AND x.seq = r.seq + 1)
SELECT asset_id, seq, segment_no FROM r"""


@query("avi_segments")
def avi_segments(spark, d):
    return tl.avi_segments(p.samples(spark, d).select("asset_id", "track_id", "seq", "size_bytes"), 200, ["seq"]).select("asset_id", "seq", "segment_no")


ORACLES["avi_segments"] = _GREEDY.format(head=p.SQL["samples"] + ", x AS (SELECT asset_id, seq, 8 + size_bytes + size_bytes % 2 AS w FROM samples)")


@query("read_windows")
def read_windows(spark, d):
    rows = tl.running_clock(p.samples(spark, d), "size_bytes").withColumn("offset", F.col("clock") + F.col("seq") * F.col("seq") * 5)
    return tl.read_windows(rows.select("asset_id", "track_id", "seq", "offset", "size_bytes"), 30, 120).select("asset_id", "seq", "window_no")


ORACLES["read_windows"] = f"""WITH RECURSIVE {p.SQL["samples"]}, x AS (SELECT asset_id, seq, size_bytes, (coalesce(sum(size_bytes) OVER (PARTITION BY asset_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + seq * seq * 5)::BIGINT AS a FROM samples),
r AS (SELECT asset_id, seq, a AS start, a + size_bytes AS stop, 0::BIGINT AS window_no FROM x WHERE seq = 0 UNION ALL
SELECT asset_id, seq, CASE WHEN b THEN a ELSE start END, CASE WHEN b THEN a + size_bytes ELSE greatest(stop, a + size_bytes) END, CASE WHEN b THEN window_no + 1 ELSE window_no END
  FROM (SELECT x.*, r.start, r.stop, r.window_no, x.a - r.stop > 30 OR x.a + x.size_bytes - r.start > 120 AS b FROM r JOIN x ON x.asset_id = r.asset_id AND x.seq = r.seq + 1))
SELECT asset_id, seq, window_no FROM r"""


@query(
    "interval_coalesce",
    """WITH o AS (SELECT asset_id, seq, seq * 30 + (size_bytes % 7) AS a, seq * 30 + (size_bytes % 7) + size_bytes AS b FROM samples),
m AS (SELECT *, max(b) OVER (PARTITION BY asset_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM o WHERE b > a),
g AS (SELECT *, sum(CASE WHEN a <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY asset_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM m)
SELECT asset_id, min(a) AS start, max(b) AS "end" FROM g GROUP BY asset_id, g""",
    ("samples",),
)
def interval_coalesce(spark, d):
    a = F.col("seq") * 30 + F.col("size_bytes") % 7
    return ag.coalesce_intervals(p.samples(spark, d).select("asset_id", a.alias("start"), (a + F.col("size_bytes")).alias("end")))


@query("byte_positions", "SELECT asset_id, track_id, seq, coalesce(sum(size_bytes) OVER (PARTITION BY asset_id, track_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS position FROM packets", ("packets",))
def byte_positions(spark, d):
    return tl.byte_positions(p.packets(spark, d)).select("asset_id", "track_id", "seq", "position")


@query(
    "declared_end",
    """WITH t AS (SELECT asset_id, track_id, track_kind, max(pts_us) // 1000 AS end_ms FROM packets GROUP BY ALL), v AS (SELECT asset_id, max(end_ms) FILTER (track_kind = 'video') AS v, max(end_ms) AS m FROM t GROUP BY asset_id)
SELECT asset_id, CASE WHEN v > 0 AND m <= v + 50000000 THEN v ELSE m END AS end_ms FROM v""",
    ("packets",),
)
def declared_end(spark, d):
    tracks = p.packets(spark, d).groupBy("asset_id", "track_id", "track_kind").agg(F.expr("max(pts_us) div 1000").alias("end_ms"))
    return ag.declared_end(tracks, 50_000_000)


@query(
    "outcome_tallies",
    "SELECT event_type, count(*) FILTER (k = 'even') AS even, count(*) FILTER (k = 'odd') AS odd FROM (SELECT event_type, CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd' END AS k FROM events) GROUP BY event_type",
)
def outcome_tallies(spark, d):
    rows = p.table(spark, d, "events").select("event_type", F.when(F.col("event_id") % 2 == 0, "even").otherwise("odd").alias("k"))
    return ag.tallies(rows, "event_type", "k")


@query("geomean", "SELECT p_brand, round(exp(avg(ln(p_retailprice))), 6) AS geomean FROM part WHERE p_retailprice > 0 GROUP BY p_brand")
def geomean(spark, d):
    return ag.geomean(p.table(spark, d, "part"), "p_brand", "p_retailprice").select("p_brand", F.round("geomean", 6).alias("geomean"))
