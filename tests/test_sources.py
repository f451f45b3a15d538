import pytest

from cadenza.errors import InputError, EngineError
from cadenza.functions import codec_strings as cs
from cadenza.plans.conformance import check_container
from cadenza.sources import datasource
from cadenza.sources import files as assets_io
from tests.test_containers import files


def test_byte_ranges(spark, tmp_path):
    datasource.register(spark)
    path = tmp_path / "a.bin"
    path.write_bytes(bytes(range(256)) * 10)
    rows = spark.read.format("byteranges").option("path", str(path)).option("start", 100).option("end", 1100).option("chunk", 300).load()
    got = sorted(rows.collect(), key=lambda r: r.position)
    assert [r.position for r in got] == [100, 400, 700, 1000] and b"".join(bytes(r.data) for r in got) == (bytes(range(256)) * 10)[100:1100]


def test_byte_file(spark, tmp_path):
    datasource.register(spark)
    path = tmp_path / "deep" / "b.bin"
    rows = spark.createDataFrame([(0, bytearray(b"hello ")), (6, bytearray(b"world"))], "position bigint, data binary").repartition(2)
    rows.write.format("bytefile").option("path", str(path)).mode("append").save()
    assert path.read_bytes() == b"hello world"
    patch = spark.createDataFrame([(0, bytearray(b"W"))], "position bigint, data binary")
    patch.write.format("bytefile").option("path", str(path)).option("position", 6).option("keepExistingData", "true").mode("append").save()
    assert path.read_bytes() == b"hello World"


def test_files_of_a_folder(spark, tmp_path):
    made = files()
    for name, data in made.items():
        (tmp_path / f"x.{name}").write_bytes(data)
    assets = assets_io.from_files(spark, str(tmp_path))
    got = {r.filename: r for r in assets.drop("content", "head").collect()}
    assert {k.split(".")[1]: r.kind for k, r in got.items()} == {k: k for k in made}
    assert all(got[f"x.{k}"].size_bytes == len(v) for k, v in made.items())


@pytest.mark.parametrize("container", sorted(files()))
def test_drivers_conform(container):
    def parse(data):
        return assets_io.parse(data, container)

    assert check_container(parse, files()[container]) == []


def test_a_bad_driver_is_told():
    def broken(data):
        m = assets_io.parse(files()["mp4"], "mp4")
        m.tracks[0].packets.reverse()
        return m

    assert check_container(broken, files()["mp4"])


def test_codec_strings():
    assert cs.from_avcc(bytes([1, 0x64, 0, 0x1F, 0xFF])) == "avc1.64001F"
    assert cs.from_hvcc(bytes([1, 1, 0x60, 0, 0, 0, 0xB0, 0, 0, 0, 0, 0, 93])) == "hvc1.1.6.L93.B0"
    assert cs.from_av1c(bytes([0x81, 0x04, 0x40, 0])) == "av01.0.04M.10"
    assert cs.from_vpcc(bytes([1, 0, 0, 0, 0, 10, 0x82, 0])) == "vp09.00.10.08"
    assert cs.token_of("hev1.1.6.L93") == "hevc" and cs.token_of("nope") is None and cs.derive("vp8", b"") == "vp8"
    with pytest.raises(InputError):
        cs.string_of("nope")
    with pytest.raises(EngineError):
        cs.from_avcc(b"\1")


def test_frame_headers():
    key = bytes([0x10, 2, 0]) + b"\x9d\x01\x2a" + (640).to_bytes(2, "little") + (480).to_bytes(2, "little")
    assert cs.vp8_frame(key) == cs.Frame(True, 640, 480) and not cs.vp8_frame(b"\x11\0\0").keyframe
    bits = "10" + "00" + "0" + "0" + "10" + f"{0x498342:024b}" + "010" + "0" + f"{639:016b}" + f"{359:016b}"
    data = int(bits.ljust(96, "0"), 2).to_bytes(12, "big")
    assert cs.vp9_frame(data) == cs.Frame(True, 640, 360)
    ivf = cs.write_ivf("VP80", 64, 48, 30, 1, [(0, b"abc"), (1, b"de")])
    fourcc, w, h, rate, frames = cs.read_ivf(ivf)
    assert (fourcc, w, h, rate) == ("VP80", 64, 48, 30) and [ivf[a : a + n] for a, n, _ in frames] == [b"abc", b"de"]
    with pytest.raises(EngineError):
        cs.read_ivf(ivf[:-1])
