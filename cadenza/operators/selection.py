"""Row selection: trims, seeks and track choice as filters over packet tables.

The three keyframe trims follow different rules on purpose: each container family cuts in its own way.
Every rule is one or two windows over the same (asset, track) partitioning, so a trim shuffles once. Their
`start_us` and `end_us` are microseconds on the stream's clock.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InputError
from ..model import TRACK, half_up, in_order, whole

END_SLACK_SEC = 1.0


def check_range(start_sec: float, end_sec: float, duration_sec: float | None = None) -> tuple[int, int]:
    """Bounds in microseconds, or `InputError` where a trim makes no sense."""
    import math

    if not (math.isfinite(start_sec) and math.isfinite(end_sec)):
        raise InputError.bad("trim bounds must be finite")
    if start_sec < 0 or end_sec <= start_sec:
        raise InputError.bad("trim needs 0 <= start < end")
    if duration_sec is not None and (start_sec >= duration_sec or end_sec > duration_sec + END_SLACK_SEC):
        raise InputError.bad("trim lies outside the file")
    return math.floor(start_sec * 1e6 + 0.5), math.floor(end_sec * 1e6 + 0.5)


def _video() -> Column:
    return F.col("track_kind") == "video"


def _first(cond: Column, value: str = "seq") -> Column:
    return F.min(F.when(cond, F.col(value))).over(whole())


def _last(cond: Column, value: str = "seq") -> Column:
    return F.max(F.when(cond, F.col(value))).over(whole())


def trim_keyframe_iso(packets: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """Video from the last keyframe (in decode order) presented at or before the start, audio from the first
    sample that reaches beyond it; both up to the first following sample decoded at or after the end. At
    least one sample stays. Times are rebased to the first kept decode time."""
    start = F.when(_video(), _last(F.col("keyframe") & (F.col("pts_us") <= start_us))).otherwise(_first(F.col("dts_us") + F.col("duration_us") > start_us))
    rows = packets.withColumn("_s", F.coalesce(start, F.min("seq").over(whole())))
    rows = rows.withColumn("_e", _first((F.col("seq") >= F.col("_s")) & (F.col("dts_us") >= end_us)))
    kept = rows.where((F.col("seq") >= F.col("_s")) & (F.col("_e").isNull() | (F.col("seq") < F.greatest("_e", F.col("_s") + 1))))
    base = F.min("dts_us").over(whole())
    return kept.withColumns({"out_dts_us": F.col("dts_us") - base, "out_pts_us": F.col("pts_us") - base}).drop("_s", "_e")


def trim_keyframe_webm(packets: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """The start moves on to the latest, over video tracks, of the first keyframes at or after it (or, where
    no track has one, back to the earliest decodable point); the length stays, up to the source's end.
    Video then begins with a keyframe. Times are rebased to the moved start."""
    asset = Window.partitionBy("asset_id")
    key = _video() & F.col("keyframe")
    rows = packets.withColumns({"_on": F.min_by("pts_us", F.when(key & (F.col("pts_us") >= start_us), F.col("seq"))).over(whole()), "_at": F.max_by("pts_us", F.when(key & (F.col("pts_us") <= start_us), F.col("seq"))).over(whole()), "_any": F.min_by("pts_us", F.when(key, F.col("seq"))).over(whole())})
    rows = rows.withColumn("_start", F.coalesce(F.max("_on").over(asset), F.min(F.coalesce("_at", "_any")).over(asset), F.lit(start_us)))
    source_end = F.max(F.col("pts_us") + F.coalesce("duration_us", F.lit(0))).over(asset)
    rows = rows.withColumn("_end", F.least(F.col("_start") + (end_us - start_us), source_end))
    kept = rows.where((F.col("pts_us") >= F.col("_start")) & (F.col("pts_us") < F.col("_end")))
    first_key, first = _first(F.col("keyframe")), F.min("seq").over(whole())
    kept = kept.withColumn("_key", F.when(_video(), F.coalesce(first_key, first)).otherwise(first)).where(F.col("seq") >= F.col("_key"))
    return kept.withColumn("out_pts_us", F.col("pts_us") - F.col("_start")).drop("_on", "_at", "_any", "_start", "_end", "_key")


def trim_keyframe_ts(packets: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """Times count from the asset's first presentation. Video from the last keyframe at or before the start,
    audio from the first unit that ends beyond it (none: no unit); both up to the first unit that ends
    beyond the end, one unit at least."""
    gap = F.lead("pts_us").over(in_order()) - F.col("pts_us")
    back = F.col("pts_us") - F.lag("pts_us").over(in_order())
    rows = packets.withColumns({"_rel": F.col("pts_us") - F.min("pts_us").over(Window.partitionBy("asset_id")), "_dur": F.when(gap > 0, gap).when(back > 0, back).otherwise(F.lit(0))})
    video = F.coalesce(_last(F.col("keyframe") & (F.col("_rel") <= start_us)), F.min("seq").over(whole()))
    rows = rows.withColumn("_s", F.when(_video(), video).otherwise(_first(F.col("_rel") + F.col("_dur") > start_us)))
    rows = rows.withColumn("_e", _first((F.col("seq") >= F.col("_s")) & (F.col("_rel") + F.col("_dur") > end_us)))
    kept = rows.where((F.col("seq") >= F.col("_s")) & (F.col("_e").isNull() | (F.col("seq") < F.greatest("_e", F.col("_s") + 1))))
    return kept.withColumnRenamed("_rel", "rel_pts_us").drop("_s", "_e", "_dur")


def trim_flac_frames(frames: DataFrame, start_sec: float, end_sec: float, rate: int) -> DataFrame:
    """Frames of (start_sample, samples) that overlap [start, end) in samples."""
    a, b = int(start_sec * rate + 0.5), int(end_sec * rate + 0.5)
    return frames.where((F.col("start_sample") + F.col("samples") > a) & (F.col("start_sample") < b))


def trim_packets_overlap(packets: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """Whole packets that overlap [start, end), the first kept one at zero; no duration counts as 1 us."""
    end = F.col("pts_us") + F.coalesce(F.greatest("duration_us", F.lit(0)), F.lit(1))
    kept = packets.where((end > start_us) & (F.col("pts_us") < end_us))
    return kept.withColumn("out_pts_us", F.col("pts_us") - F.min_by("pts_us", "seq").over(whole()))


def trim_frames_exact(frames: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """Frames in [start, end), up to the first one at or after the end in stream order, rebased to the first."""
    stop = frames.withColumn("_stop", _first(F.col("pts_us") >= end_us))
    kept = stop.where((F.col("pts_us") >= start_us) & (F.col("pts_us") < end_us) & (F.col("_stop").isNull() | (F.col("seq") < F.col("_stop"))))
    return kept.withColumn("out_pts_us", F.col("pts_us") - F.min_by("pts_us", "seq").over(whole())).drop("_stop")


def _kept_part(blocks: DataFrame, low: Column, high: Column) -> DataFrame:
    """Cuts blocks of (start_frame, planar) to frames low to high, dropping what falls outside."""
    n = F.size(F.get("planar", F.lit(0)))
    rows = blocks.withColumns({"_from": F.greatest(low - F.col("start_frame"), F.lit(0)).cast("int"), "_to": F.least(high - F.col("start_frame"), n.cast("bigint")).cast("int")}).where("_to > _from")
    return rows.withColumns({"planar": F.transform("planar", lambda c: F.slice(c, F.col("_from") + 1, F.col("_to") - F.col("_from"))), "start_frame": F.col("start_frame") + F.col("_from")}).drop("_from", "_to")


def trim_pcm_exact(blocks: DataFrame, start_sec: float, end_sec: float) -> DataFrame:
    """Sample-exact: frames [round(start * rate), round(end * rate)), clamped to what there is."""
    rate = F.col("sample_rate")
    return _kept_part(blocks, half_up(F.lit(float(start_sec)) * rate), half_up(F.lit(float(end_sec)) * rate))


def trim_gapless(blocks: DataFrame, leading: int, total: int | None = None) -> DataFrame:
    """Drops `leading` frames and keeps `total`; `ts_us` restamps each block from the frames before it."""
    if leading < 0 or (total is not None and total < 0):
        raise InputError.bad("gapless sample counts must not be negative")
    n = F.size(F.get("planar", F.lit(0)))
    at = Window.partitionBy(*TRACK).orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = blocks.withColumn("start_frame", F.coalesce(F.sum(n).over(at), F.lit(0)).cast("bigint"))
    high = F.lit(leading + total).cast("bigint") if total is not None else F.lit((1 << 62)).cast("bigint")
    kept = _kept_part(rows, F.lit(leading).cast("bigint"), high)
    return kept.withColumn("ts_us", half_up((F.col("start_frame") - leading) * 1e6 / F.col("sample_rate")))


def seek_frame(frames: DataFrame, time_us: Column | int) -> DataFrame:
    """One row per track: the first frame presented at or after the time, else the last one."""
    t = F.lit(time_us) if isinstance(time_us, int) else time_us
    row = F.struct("seq", "pts_us", "keyframe")
    pick = F.coalesce(F.min_by(row, F.when(F.col("pts_us") >= t, F.col("seq"))), F.max_by(row, "seq"))
    return frames.groupBy(*TRACK).agg(pick.alias("_r")).select(*TRACK, "_r.*")


def seek_window(packets: DataFrame, time_us: int) -> DataFrame:
    """Packets to decode for a seek: from the last keyframe at or before the time; all if there is none."""
    start = F.coalesce(_last(F.col("keyframe") & (F.col("pts_us") <= time_us)), F.min("seq").over(whole()))
    return packets.withColumn("_s", start).where("seq >= _s").drop("_s")


_SELECTOR = re.compile(r"(video|audio):(\d+)(?:@(\d+))?")


def select_tracks(tracks: DataFrame, selectors: Sequence[str]) -> DataFrame:
    """Tracks named by `video:N` or `audio:N[@source]`, once each, with `ordinal` in the order asked for.

    N counts within the kind of track. Selectors of another source than 0 select nothing; an asset without
    any selected track has no rows (the single-file verbs raise then)."""
    wanted: dict[tuple[str, int], int] = {}
    for i, raw in enumerate(selectors):
        m = _SELECTOR.fullmatch(raw)
        if not m:
            raise InputError.bad(f"bad track selector {raw!r}")
        if m[3] is None or int(m[3]) == 0:
            wanted.setdefault((m[1], int(m[2])), i)
    if not selectors:
        return tracks.withColumn("ordinal", F.row_number().over(Window.partitionBy("asset_id").orderBy("track_id")) - 1)
    rank = F.row_number().over(Window.partitionBy("asset_id", "track_kind").orderBy("track_id")) - 1
    ordinal = F.lit(None).cast("int")
    for (kind, n), i in wanted.items():
        ordinal = F.when((F.col("track_kind") == kind) & (F.col("_n") == n), F.lit(i)).otherwise(ordinal)
    return tracks.withColumn("_n", rank).withColumn("ordinal", ordinal).where("ordinal is not null").drop("_n")


def pick_variant(variants: DataFrame, which: str | int = "highest", by: str = "asset_id") -> DataFrame:
    """One variant per asset by bandwidth: of equals the last is highest and the first lowest; or by index."""
    row = F.struct(*[c for c in variants.columns if c != by])
    if isinstance(which, int):
        rank = F.row_number().over(Window.partitionBy(by).orderBy("bandwidth", "idx")) - 1
        return variants.withColumn("_n", rank).where(F.col("_n") == which).drop("_n")
    if which not in ("highest", "lowest"):
        raise InputError.bad(f"unknown variant choice {which!r}")
    pick = F.max_by(row, F.struct("bandwidth", "idx")) if which == "highest" else F.min_by(row, F.struct("bandwidth", "idx"))
    return variants.groupBy(by).agg(pick.alias("_r")).select(by, "_r.*")
