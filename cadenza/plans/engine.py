"""The engine's verbs over one input or many, and the fluent chain.

`Engine` works on DataFrames of assets; verbs that need a lossy codec end in a typed miss, as rows in batch
jobs (`status`, `error_code`) and as `CapabilityError` where a single result is asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CapabilityError, InputError, EngineError
from ..functions import dsp, pixels
from ..operators import selection
from ..sources import files
from ..sources.containers import pcm_files
from ..sources.containers import tags as file_tags
from . import router, targets

LOSSY = ("avc1", "hvc1", "vp8", "vp9", "av1", "mp4a.40.2", "opus", "mp3", "vorbis")
API_VERSION = 1


class Engine:
    """Entry point: `Engine(spark).load(...)` or the verbs on a DataFrame of assets."""

    def __init__(self, spark: SparkSession, determinism: str = "auto", log: Callable[[str], None] | None = None) -> None:
        if determinism not in ("auto", "force-software"):
            raise InputError.bad(f"unknown determinism {determinism!r}")
        self.spark, self.determinism, self.log = spark, determinism, log or (lambda _: None)
        self.modules: dict[str, object] = {}

    def use(self, module) -> Engine:
        """Registers a driver module (id, api_version, register(engine)); the first of an id stays."""
        version = getattr(module, "api_version", API_VERSION)
        if version not in (API_VERSION, API_VERSION - 1):
            raise EngineError("driver-incompatible", f"driver API {version} is not {API_VERSION}", {"id": module.id})
        if module.id not in self.modules:
            self.modules[module.id] = module
            if hasattr(module, "register"):
                module.register(self)
        return self

    # ---- sources

    def source(self, given) -> DataFrame:
        """Assets from a DataFrame of them, bytes, a path or URL of the file system, or a list of these."""
        if isinstance(given, DataFrame):
            return given
        if isinstance(given, bytes | bytearray):
            return files.from_bytes(self.spark, [(0, bytes(given))])
        if isinstance(given, str | Path):
            return files.from_files(self.spark, str(given))
        if isinstance(given, Iterable):
            return files.from_bytes(self.spark, [x if isinstance(x, tuple) else (i, bytes(x)) for i, x in enumerate(given)])
        raise InputError.bad(f"no source from {type(given).__name__}")

    def load(self, given) -> Chain:
        return Chain(self, self.source(given))

    # ---- verbs

    def probe(self, given) -> DataFrame:
        return files.probe(self.source(given))

    def probe_container(self, given, container: str) -> DataFrame:
        return files.probe(self.source(given).withColumn("kind", F.lit(container)))

    def demux(self, given) -> tuple[DataFrame, DataFrame]:
        """(tracks, packets); `packets.where("track_id = ...")` is one track's."""
        assets = self.source(given)
        return files.read_tracks(assets), files.read_packets(assets)

    def packet_info(self, given, container: str | None = None) -> DataFrame:
        assets = self.source(given)
        return files.read_packets(assets if container is None else assets.withColumn("kind", F.lit(container))).drop("inline")

    def decode(self, given) -> DataFrame:
        """PCM blocks; files whose audio is lossy have none (see `plan` for their misses)."""
        return files.decode_pcm(self.source(given))

    def encode(self, blocks: DataFrame, container: str = "flac", fmt: str = "s16") -> DataFrame:
        if container == "wav":
            raise CapabilityError.miss("WAV is written by convert, not by encode", {"op": "encode", "container": container}, ["flac"])
        return files.write_pcm(blocks, container, fmt)

    def plan(self, given, to: str, video: dict | bool | None = None, audio: dict | bool | None = None) -> DataFrame:
        """(asset_id, container, codec, route): which way a conversion would take."""
        found = files.probe(self.source(given))
        first = F.get("tracks", F.lit(0))
        codec, channels = first["codec"], first["channels"]
        route = router.convert_route(F.col("container"), F.lit(to), codec, F.lit(router.is_stream_copy(video, audio)))
        asked = audio.get("channels") if isinstance(audio, dict) else None
        if asked is not None:
            ways = [a for a, b in dsp.REMIXES if b == asked] + [asked]
            route = F.when(route.isin("pcm-native", "flac-author") & ~F.coalesce(channels.isin(*ways), F.lit(False)), "miss").otherwise(route)
        return found.select("asset_id", "container", codec.alias("codec"), F.when(F.col("status") == "ok", route).otherwise("unreadable").alias("route"))

    def convert(self, given, to: str, video: dict | bool | None = None, audio: dict | bool | None = None, tags: dict | None = None) -> DataFrame:
        """(asset_id, container, content, status...): PCM and FLAC are converted, copies are remuxed, the rest is a miss.

        Every file keeps its own sample format, rate and channels where nothing else is asked for."""
        assets = self.source(given)
        routes = self.plan(assets, to, video, audio).select("asset_id", "route", "codec")
        routed = assets.join(routes, "asset_id")
        pcm = routed.where(F.col("route").isin("pcm-native", "flac-author"))
        asked = audio if isinstance(audio, dict) else {}
        out = files.write_pcm(self._audio(files.decode_pcm(pcm, with_format=True), asked), to, _pcm_format(asked.get("codec")))
        columns = out.columns
        if to in router.MUXABLE:
            out = out.unionByName(files.remux(routed.where(F.col("route").isin("stream-copy", "remux")), to, tags).select(columns))
        missed = routed.where(F.col("route").isin("miss", "unreadable")).select("asset_id", F.lit(to).alias("container"), F.lit(None).cast("binary").alias("content"), F.lit("failed").alias("status"), F.when(F.col("route") == "miss", "capability-miss").otherwise("unsupported-input").alias("error_code"), F.concat(F.lit("no way to "), F.lit(to), F.lit(" for "), F.coalesce("codec", F.lit("unknown"))).alias("error"))
        return out.unionByName(missed.select(columns))

    transcode = convert

    def _audio(self, blocks: DataFrame, t: dict) -> DataFrame:
        """gain, fades, channels, rate, filters, dynamics, in this order."""
        if t.get("gain_db"):
            blocks = dsp.gain(blocks, t["gain_db"])
        fade = t.get("fade") or {}
        blocks = dsp.fade_in(blocks, fade.get("in", 0), fade.get("shape", "linear"))
        blocks = dsp.fade_out(blocks, fade.get("out", 0), fade.get("shape", "linear"))
        if t.get("channels"):
            blocks = dsp.remix(blocks, None, t["channels"])
        if t.get("sample_rate"):
            blocks = dsp.resample(blocks, t["sample_rate"])
        for b in [t["biquad"]] if isinstance(t.get("biquad"), dict) else t.get("biquad") or []:
            blocks = dsp.biquad(blocks, **b)
        d = dict(t.get("dynamics") or {})
        if d:
            blocks = {"peak": dsp.normalize_peak, "rms": dsp.normalize_rms, "limit": dsp.limit}[d.pop("mode", "limit")](blocks, **d)
        return blocks

    def remux(self, given, to: str, tags: dict | None = None, select: list[str] | None = None, fragmented: bool = False) -> DataFrame:
        if tags is not None and select:
            raise InputError.bad("tags and track selection exclude each other")
        assets = self.source(given)
        if not select:
            return files.remux(assets, to, tags, fragmented)
        tracks, packets = self.demux(assets)
        chosen = selection.select_tracks(tracks.where("status = 'ok'"), select)
        data = files.with_payload(packets.join(chosen.select("asset_id", "track_id"), ["asset_id", "track_id"], "left_semi"), assets)
        return files.mux(data, chosen.withColumn("track_id", F.col("track_id")), to, None, fragmented)

    def trim(self, given, start: float, end: float, mode: str = "keyframe", to: str | None = None) -> DataFrame:
        """Packets of the cut by the container family's rule, with `data`, or with `to` the files; accurate cuts are for PCM."""
        a, b = selection.check_range(start, end)
        assets = self.source(given)
        if mode == "accurate":
            return selection.trim_pcm_exact(files.decode_pcm(assets), start, end)
        if mode != "keyframe":
            raise InputError.bad(f"unknown trim mode {mode!r}")
        tracks, packets = self.demux(assets)
        tracks = tracks.where("status = 'ok'")
        rows = packets.join(tracks.select("asset_id", "track_id", "track_kind"), ["asset_id", "track_id"]).join(assets.select("asset_id", "kind"), "asset_id")
        rows = rows.withColumn("dts_us", F.coalesce("dts_us", "pts_us"))
        cut = None
        for kinds, rule in ((("webm", "mkv"), selection.trim_keyframe_webm), (("ts",), selection.trim_keyframe_ts), (("mp3", "adts", "ogg", "flac", "wav", "aiff", "caf"), selection.trim_packets_overlap), (("mp4", "mov"), selection.trim_keyframe_iso)):
            part = rule(rows.where(F.col("kind").isin(*kinds)), a, b)
            out = part["out_pts_us"] if "out_pts_us" in part.columns else part["rel_pts_us"]
            base = part["out_dts_us"] if "out_dts_us" in part.columns else F.lit(None).cast("bigint")
            part = part.select("asset_id", "track_id", "seq", "offset", "size_bytes", out.alias("pts_us"), base.alias("dts_us"), "duration_us", "keyframe", "inline")
            cut = part if cut is None else cut.unionByName(part)
        data = files.with_payload(cut, assets)
        return data if to is None else files.mux(data, tracks, to)

    def seek(self, given, time_us: int) -> DataFrame:
        tracks, packets = self.demux(given)
        return selection.seek_frame(packets, time_us)

    def mux(self, packets: DataFrame, tracks: DataFrame, container: str, tags: dict | None = None, fragmented: bool = False) -> DataFrame:
        return files.mux(packets, tracks, container, tags, fragmented)

    def decrypt(self, given, keys, to: str | None = None, scheme: str = "cenc", iv: bytes | None = None):
        """Clear files. Of bytes the result is bytes; of assets a table (asset_id, container, content, status...).

        cenc (with cens and cbcs): protected MP4 files with `keys`, a dict of key ids, written as `to` (MP4 if
        not given). hls-aes128: whole segments under one key and IV. hls-sample-aes: transport streams whose
        samples are protected, under one key and IV."""
        if not keys:
            raise CapabilityError.miss("no keys", {"op": "decrypt"})
        if scheme not in ("cenc", "hls-aes128", "hls-sample-aes"):
            raise CapabilityError.miss(f"no decryption for {scheme!r}", {"op": "decrypt", "scheme": scheme}, ["cenc", "hls-aes128", "hls-sample-aes"])
        if scheme != "cenc" and not (len(keys) == 16 and iv is not None and len(iv) == 16):
            raise InputError.bad(f"{scheme} needs a 16-byte key and IV")
        if isinstance(given, bytes | bytearray):
            row = self.decrypt(self.source(bytes(given)), keys, to, scheme, iv).first()
            if row.status != "ok":
                raise (CapabilityError if row.error_code == "capability-miss" else EngineError)(row.error_code, row.error)
            return bytes(row.content)
        assets = self.source(given)
        if scheme == "hls-aes128":
            whole = (F.octet_length("content") > 0) & (F.octet_length("content") % 16 == 0)
            clear = F.when(whole, F.try_aes_decrypt(F.concat(F.lit(iv), F.col("content")), F.lit(bytes(keys)), F.lit("CBC"), F.lit("PKCS")))
            ok = F.col("clear").isNotNull()
            rows = assets.select("asset_id", "kind", clear.alias("clear"))
            return rows.select("asset_id", F.coalesce("kind", F.lit("ts")).alias("container"), F.col("clear").alias("content"), F.when(ok, "ok").otherwise("failed").alias("status"), F.when(~ok, "decode-error").alias("error_code"), F.when(~ok, "not a whole AES-128 segment under this key").alias("error"))
        return files.decrypt(assets, scheme, keys, to or ("mp4" if scheme == "cenc" else "ts"), iv)

    def render(self, frames: DataFrame, **settings) -> DataFrame:
        """Frames after crop, resize, rotate, flip, colour space and tone map, in this order."""
        return pixels.render(frames, settings)

    def h264_abr_ladder(self, given, rungs: list[tuple]) -> DataFrame:
        """A row per asset and rung; encoding them needs a lossy codec, so each is a miss."""
        from ..operators.joins import fan_out

        plan = targets.ladder(self.spark, rungs)
        return fan_out(self.source(given).select("asset_id"), plan).withColumns({"status": F.lit("failed"), "error_code": F.lit("capability-miss")})

    def write_tags(self, data: bytes, container: str, tags: dict[str, str]) -> bytes:
        return file_tags.write_tags(data, container, tags)

    def wav_packet_copy(self, data: bytes) -> bytes:
        """The samples of a WAV file under a fresh canonical header."""
        f = pcm_files.parse_wav(data)
        body = data[f.offset : f.offset + f.frames * f.frame_bytes]
        return pcm_files.wav_header(f.fmt, f.rate, f.channels, len(body)) + body + b"\0" * (len(body) & 1)

    def preload(self, *frames: DataFrame) -> list[str]:
        """Warms DataFrames by caching them; never raises, returns what went wrong."""
        problems = []
        for f in frames:
            try:
                f.cache().count()
            except Exception as e:  # a warm-up must not fail the program
                problems.append(str(e))
        return problems


def _pcm_format(codec: str | None) -> str | None:
    return None if codec in (None, "flac") else codec.removeprefix("pcm-").removesuffix("le").removesuffix("be")


class Chain:
    """Steps on one input; neighbouring target settings become one conversion."""

    SETTINGS = ("resize", "crop", "rotate", "flip", "colorspace", "tonemap", "fps", "codec", "bitrate", "gain", "fade", "channels", "sample_rate", "biquad", "dynamics", "to")

    def __init__(self, engine: Engine, assets: DataFrame, steps: tuple = ()) -> None:
        self.engine, self.assets, self.steps = engine, assets, steps

    def _with(self, *step) -> Chain:
        return Chain(self.engine, self.assets, (*self.steps, step))

    def __getattr__(self, name: str):
        if name in Chain.SETTINGS:
            return lambda *a, **k: self._with("set", name, a, k)
        raise AttributeError(name)

    def trim(self, start: float, end: float, mode: str = "keyframe") -> Chain:
        return self._with("trim", start, end, mode)

    def remux(self, to: str, **k) -> Chain:
        return self._with("remux", to, k)

    def compile(self) -> list[tuple]:
        """Operations in order: ("convert", settings), ("trim", ...), ("remux", ...)."""
        out: list[tuple] = []
        for step in self.steps:
            if step[0] != "set":
                out.append(step)
                continue
            _, name, a, k = step
            if not out or out[-1][0] != "convert":
                out.append(("convert", {}))
            value = {**k, **({"value": a[0]} if len(a) == 1 else {"value": a} if a else {})}
            out[-1][1][name] = value["value"] if set(value) == {"value"} else value
        if not out:
            raise InputError.bad("an empty chain does nothing")
        return out

    def run(self) -> DataFrame:
        """The files after the last step: (asset_id, container, content, status, error_code, error)."""
        assets, out = self.assets, None
        for op in self.compile():
            if op[0] == "convert":
                s = dict(op[1])
                to = s.pop("to", "wav")
                names = {"gain": "gain_db"}
                audio = {names.get(k, k): v for k, v in s.items() if k in ("gain", "fade", "channels", "sample_rate", "biquad", "dynamics", "codec", "bitrate")}
                video = {k: v for k, v in s.items() if k in ("resize", "crop", "rotate", "flip", "colorspace", "tonemap", "fps")}
                out = self.engine.convert(assets, to, {"crop": video} if video else None, audio or None)
            elif op[0] == "trim":
                kind = assets.select("kind").first()[0]
                out = self.engine.trim(assets, op[1], op[2], op[3], kind) if op[3] == "keyframe" else files.write_pcm(selection.trim_pcm_exact(files.decode_pcm(assets, with_format=True), op[1], op[2]), kind)
            else:
                out = self.engine.remux(assets, op[1], **op[2])
            none = F.lit(None).cast("string")
            done = out.where("status = 'ok'").select("asset_id", none.alias("uri"), none.alias("mime"), none.alias("filename"), F.octet_length("content").cast("bigint").alias("size_bytes"), "content", "container")
            assets = files.routed(done, F.col("container"))
        return out

    def blob(self) -> bytes:
        """The only result as bytes; a failed one raises."""
        row = self.run().first()
        if row is None:
            raise InputError.bad("the chain made nothing")
        if row.status != "ok":
            raise (CapabilityError if row.error_code == "capability-miss" else EngineError)(row.error_code, row.error)
        return bytes(row.content)

    def file(self, path: str) -> str:
        Path(path).write_bytes(self.blob())
        return path

    def stream(self):
        return self.run().toLocalIterator()
