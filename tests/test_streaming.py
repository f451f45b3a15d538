import shutil

import numpy as np
import pytest

from cadenza.functions import dsp
from cadenza.operators import joins, timeline
from cadenza.streaming import stages
from tests.test_functions import blocks, signal_of


def replay(spark, tmp_path, rows, schema, run, per_batch, order):
    """Feeds rows in files of `per_batch`, one micro-batch each, and collects what comes out."""
    folder = tmp_path / f"in{per_batch}"
    shutil.rmtree(folder, ignore_errors=True)
    for i in range(0, len(rows), per_batch):
        part = spark.createDataFrame(rows[i : i + per_batch], schema).coalesce(1)
        part.write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    name = f"out_{per_batch}_{tmp_path.name.replace('-', '_')}"
    q = run(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"ck{per_batch}")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


X = np.random.default_rng(6).normal(size=(2, 500)) / 5
BLOCK = "asset_id bigint, track_id int, block_no bigint, start_frame bigint, sample_rate int, channels int, planar array<array<double>>, is_last boolean"


def pcm_rows(spark):
    rows = sorted(blocks(spark, X).collect(), key=lambda r: r.block_no)
    return [(*r, i == len(rows) - 1) for i, r in enumerate(rows)]


@pytest.mark.parametrize("per_batch", [1, 3, 7])
def test_biquad(spark, tmp_path, per_batch):
    out = replay(spark, tmp_path, pcm_rows(spark), BLOCK, lambda s: stages.biquad(s, "lowpass", 900.0), per_batch, "block_no")
    assert np.array_equal(signal_of(out), dsp.biquad_signal(X, dsp.design_biquad("lowpass", 900.0, 8000))[0])


@pytest.mark.parametrize("per_batch", [1, 3])
def test_fade(spark, tmp_path, per_batch):
    out = replay(spark, tmp_path, pcm_rows(spark), BLOCK, lambda s: stages.fade(s, 130, 170), per_batch, "block_no")
    whole = signal_of(dsp.fade_out(dsp.fade_in(blocks(spark, X), 130), 170))
    assert np.allclose(signal_of(out), whole, atol=1e-15)


def test_gapless(spark, tmp_path):
    out = replay(spark, tmp_path, pcm_rows(spark), BLOCK, lambda s: stages.gapless_trim(s, 130, 200), 2, "block_no")
    assert np.array_equal(signal_of(out), X[:, 130:330])


def test_retime_and_fragments(spark, tmp_path):
    r = np.random.default_rng(7)
    pts = np.cumsum(r.integers(10_000, 400_000, 30)).tolist()
    frames = [(1, 0, i, p, None, "video", i % 9 == 0, i == 29) for i, p in enumerate(pts)]
    schema = "asset_id bigint, track_id int, seq bigint, pts_us bigint, declared_us bigint, track_kind string, keyframe boolean, is_last boolean"
    batch = spark.createDataFrame(frames, schema)
    got = replay(spark, tmp_path, frames, schema, lambda s: stages.cfr_retime(s, 6.0), 4, "seq")
    want = joins.cfr_slots_streaming(batch, 6.0)
    key = lambda df: sorted((x.out_no, x.ts_us, x.source_seq) for x in df.collect())
    assert key(got) == key(want)
    runs = replay(spark, tmp_path / "f", frames, schema, lambda s: stages.fragment_runs(s, 4), 5, "seq")
    whole = timeline.fragment_runs(batch, 4)
    assert sorted((x.seq, x.run_no) for x in runs.collect()) == sorted((x.seq, x.run_no) for x in whole.collect())
