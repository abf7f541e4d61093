import struct

import pytest
from pyspark.sql import functions as F

from cuespark.operators import tracks
from cuespark.sources import audio_files, containers


def box(name, body):
    return struct.pack(">I4s", 8 + len(body), name) + body


def mvhd(scale, whole, wide=False):
    return box(b"mvhd", (b"\x01\0\0\0" + bytes(16) + struct.pack(">IQ", scale, whole) if wide else b"\0" * 12 + struct.pack(">II", scale, whole)) + bytes(80))


def mp4(moov, before=b"", after=b""):
    return box(b"ftyp", b"M4A isom") + before + box(b"moov", moov) + after


def large(n):
    return struct.pack(">I4sQ", 1, b"mdat", 16 + n) + bytes(n)


def mp3(frames, head=b"", tail=b"", xing=None, vbri=None):
    one = bytearray(b"\xff\xfb\x90\x00" + bytes(413))  # 128 kbit/s at 44,100: 417 bytes
    first = bytearray(one)
    if xing is not None:
        first[36:48] = b"Xing" + struct.pack(">II", 1, xing)
    if vbri is not None:
        first[36:54] = b"VBRI" + bytes(10) + struct.pack(">I", vbri)
    return head + bytes(first) + bytes(one) * (frames - 1) + tail


def id3(n):
    return b"ID3\x04\0\0" + bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + bytes(n)


def flac(rate, samples):
    return b"fLaC" + b"\0\0\0\x22" + bytes(10) + (rate << 44 | 1 << 41 | 15 << 36 | samples).to_bytes(8, "big") + bytes(16) + bytes(500)


def page(body, granule, serial=7):
    return b"OggS\0\0" + granule.to_bytes(8, "little") + struct.pack("<III", serial, 0, 0) + bytes([1, min(255, len(body))]) + body


def ebml(name, body):
    return name + (1 << 56 | len(body)).to_bytes(8, "big") + body


def webm(length, scale=1_000_000, before=b""):
    info = ebml(b"\x2a\xd7\xb1", scale.to_bytes(3, "big")) + ebml(b"\x44\x89", struct.pack(">d", length))
    return ebml(b"\x1a\x45\xdf\xa3", b"webm") + ebml(b"\x18\x53\x80\x67", before + ebml(b"\x15\x49\xa9\x66", info))


def asf(seconds, ahead_ms):
    props = containers._ASF_FILE + struct.pack("<Q", 104) + bytes(40) + struct.pack("<QQQ", int(seconds * 1e7) + ahead_ms * 10_000, 0, ahead_ms) + bytes(16)
    other = bytes(16) + struct.pack("<Q", 40) + bytes(16)
    return containers._ASF + struct.pack("<Q", 30 + len(other) + len(props)) + bytes(6) + other + props


def wav(seconds, rate=8000, before=b""):
    data = bytes(int(rate * seconds) * 4)
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVE" + b"fmt " + struct.pack("<IHHIIHH", 16, 1, 2, rate, rate * 4, 4, 16) + before + b"data" + struct.pack("<I", len(data)) + data


MADE = {
    "a.m4a": (mp4(mvhd(1000, 12_345)), 12.345), "b.m4a": (mp4(mvhd(48_000, 480_000, True), before=large(300_000)), 10.0), "c.m4a": (mp4(box(b"trak", bytes(90)) + mvhd(600, 0) + box(b"mvex", box(b"mehd", bytes(4) + struct.pack(">I", 1500)))), 2.5),
    "d.m4a": (mp4(mvhd(1000, 5000), before=large(200_000), after=large(200_000)), 5.0), "e.mp3": (mp3(100), 100 * 417 * 8 / 128_000), "f.mp3": (mp3(100, id3(100_000), b"TAG" + bytes(125)), 100 * 417 * 8 / 128_000),
    "g.mp3": (mp3(50, id3(10), xing=1000), 1000 * 1152 / 44_100), "h.mp3": (mp3(50, vbri=2000), 2000 * 1152 / 44_100), "i.flac": (flac(96_000, 960_001), 960_001 / 96_000), "j.flac": (id3(300) + flac(44_100, 441), 0.01),
    "k.ogg": (page(b"\x01vorbis" + bytes(5) + struct.pack("<I", 44_100) + bytes(14), 0) + page(bytes(99), 1000) * 900 + page(bytes(99), 441_000) + page(bytes(9), 5, 8), 10.0),
    "l.opus": (page(b"OpusHead\x01\x02" + struct.pack("<H", 312) + bytes(7), 0) + page(bytes(200), (1 << 64) - 1) + page(bytes(9), 48_312), 1.0), "m.webm": (webm(2500.0, before=ebml(b"\xec", bytes(100_000))), 2.5),
    "n.wma": (asf(7.5, 3000), 7.5), "o.wav": (wav(1.5, before=b"LIST" + struct.pack("<I", 150_001) + bytes(150_002)), 1.5), "p.wav": (wav(0), 0.0),
    "broken.m4a": (mp4(mvhd(0, 5)), None), "cut.mp3": (b"\xff\xfb\x90", None), "text.mp3": (b"no audio here, only words " * 90, None), "empty.flac": (flac(44_100, 0), None), "cut.flac": (b"fLaC\0\0\0\x22" + bytes(9), None),
    "odd.ogg": (page(b"nothing", 5), None), "cut.webm": (webm(9.0)[:30], None), "cut.wma": (asf(1, 1)[:40], None), "loop.m4a": (b"\0\0\0\x08ftyp" + b"\0\0\0\x02moov" * 50, None), "none.wav": (b"", None),
}


def close(got, want):
    return got is None if want is None else got is not None and abs(got - want) < 1e-9


def test_durations_of_contents(spark):
    rows = [(n, b) for n, (b, _) in MADE.items()] + [("null", None)]
    got = {r.path: r.duration_s for r in containers.durations(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert {n: got[n] for n, (_, want) in MADE.items() if not close(got[n], want)} == {} and got["null"] is None and len(got) == len(rows)
    assert containers.durations(spark.createDataFrame([], "path string, content binary")).count() == 0


def test_durations_by_ranges_of_files(spark, tmp_path):
    for name, (body, _) in MADE.items():
        (tmp_path / name).write_bytes(body)
    files = audio_files.listing(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: r.duration_s for r in containers.listed_durations(files).collect()}
    assert set(got) == {n for n, (b, _) in MADE.items() if b}
    assert {n: got[n] for n in got if not close(got[n], MADE[n][1])} == {}
    gone = spark.createDataFrame([("file:/no/such.mp3", 5)], "path string, size_bytes long")
    assert containers.listed_durations(gone).collect()[0].duration_s is None


@pytest.mark.parametrize("name", [n for n, (b, _) in MADE.items() if len(b) > 100_000])
def test_little_is_read(name):
    body, want = MADE[name]
    read = []
    assert close(containers.duration(lambda at, n: read.append(n) or body[at : at + n], len(body)), want)
    assert sum(read) <= containers.ENDS + 5000


def test_sources_are_chosen_by_measured_lengths(spark, tmp_path):
    """From a folder of files to the choice of a source, without a column of lengths."""
    for name, seconds in (("本編 SEなし/01 intro.flac", 10), ("本編 SEあり/01 intro.mp3", 10.1), ("本編 SEあり/02 other.mp3", 3), ("本編 SEなし/02 other.flac", 9)):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        frames = round(seconds * 44_100 / 1152)
        path.write_bytes(mp3(700, xing=frames) if name.endswith("mp3") else flac(44_100, int(seconds * 44_100)) + bytes(300_000))
    listed = audio_files.listing(spark, str(tmp_path))
    files = tracks.described(listed.join(containers.listed_durations(listed), "path"))
    got = {r.track_key: (r.path.rsplit("/", 1)[1], len(r.counterparts), r.requires_review) for r in tracks.select_sources(files).collect()}
    assert {v for k, v in got.items()} == {("01 intro.flac", 1, False), ("02 other.flac", 0, True)}
    assert files.where(F.col("duration_s").isNull()).count() == 0
