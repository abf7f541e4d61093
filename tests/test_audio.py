import io
import math
import random
import struct
import wave

import pytest
from pyspark.sql import functions as F

from cuespark.operators import activity, recovery, tracks
from cuespark.sources import audio_files

CUE = "file string, pos long, idx long, start_ms long, end_ms long, content string"


def wav(samples, rate=1000, channels=2):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(struct.pack(f"<{len(samples)}h", *samples))
    return out.getvalue()


@pytest.fixture(scope="module")
def recordings(tmp_path_factory):
    folder = tmp_path_factory.mktemp("audio")
    r = random.Random(1)
    samples = [r.randint(-3000, 3000) for _ in range(2 * 2750)]
    (folder / "a.wav").write_bytes(wav(samples))
    (folder / "mono.wav").write_bytes(wav([1] * 500, channels=1))
    (folder / "bad.wav").write_bytes(b"RIFFxx")
    (folder / "empty.wav").write_bytes(b"")
    (folder / "._a.wav").write_bytes(b"x")
    (folder / "note.txt").write_bytes(b"x")
    return str(folder), samples


def test_listing_and_headers(spark, recordings):
    files = audio_files.listing(spark, recordings[0])
    assert sorted(r.name for r in files.collect()) == ["a.wav", "bad.wav", "mono.wav"]
    assert audio_files.fingerprint(files).select("fingerprint").distinct().count() == 3
    content = spark.read.format("binaryFile").load(recordings[0] + "/*.wav")
    found = {r.path.rsplit("/")[-1]: r.duration_s for r in audio_files.wav_durations(content).collect() if "/._" not in r.path}
    assert found == {"a.wav": 2.75, "mono.wav": 0.5, "bad.wav": None}


@pytest.mark.parametrize("slice_bytes", [1 << 20, 5000, 1])
def test_frames_equal_brute_force(spark, recordings, monkeypatch, slice_bytes):
    monkeypatch.setattr(audio_files, "SLICE", slice_bytes)
    folder, samples = recordings
    got = [tuple(r)[1:] for r in audio_files.frames(spark.read.format("binaryFile").load(folder + "/*.wav")).orderBy("pos").collect()]
    want = []
    for k in range(6):
        part = samples[1000 * k:1000 * (k + 1)]
        rms = [int(math.sqrt(sum(x * x for x in part[c::2]) / len(part[c::2]))) for c in (0, 1)]
        want.append((k + 1, k * 0.5, min(2.75, k * 0.5 + 0.5), *rms))
    assert got == want


def test_weak_texts(spark):
    rows = [("", 1.0, True), (None, 1.0, True), ("…", 1.0, True), ("?!?", 1.0, True), ("ab.ab.", 1.0, False), ("aa.a", 1.0, True), ("hello world", 1.0, False), ("words", 5.5, True), ("word", 2.5, True), ("word", 1.0, False), ("はいx", 1.0, True)]
    df = spark.createDataFrame(rows, "t string, s double, want boolean")
    assert df.where(activity.weak_text(F.col("t"), F.col("s")) != F.col("want")).count() == 0


def test_activity_against_brute_force(spark):
    r = random.Random(5)
    frames, cues = [], []
    for k in range(200):
        loud = r.choice([0, 30, 300, 6000])
        frames.append(("f", k + 1, k * 0.5, k * 0.5 + 0.5, loud, r.choice([loud, loud * 3])))
    at = 0
    for k in range(40):
        at += r.randint(100, 3000)
        cues.append(("f", k + 1, k + 1, at, at + r.randint(200, 2500), r.choice(["hello there", "…", "another word", "ab"])))
        at = cues[-1][4]
    cues.append(("f", 41, 41, 55_000, 125_000, "a very long text that covers bins of time and is strong enough to be heard all over the place, as it has more than one letter a second"))
    df = activity.scored(activity.coverage(spark.createDataFrame(frames, "file string, pos long, start_s double, end_s double, left_rms int, right_rms int"), spark.createDataFrame(cues, CUE)))
    got = {x.pos: x for x in df.collect()}
    db = lambda x: -120.0 if x <= 0 else 20 * math.log10(min(x, 32767) / 32767)
    levels = sorted(max(db(f[4]), db(f[5])) for f in frames)
    threshold = max(levels[round(199 * 0.2)] + 10, -48)
    for f in frames:
        met = [c for c in cues if c[3] / 1000 < f[3] and c[4] / 1000 > f[2]]
        is_weak = lambda c: c[5] == "…" or (c[5] == "ab" and c[4] - c[3] >= 2500)
        strong = [c for c in met if not is_weak(c)]
        x = got[f[1]]
        assert x.state == ("none" if not met else "strong" if strong else "weak")
        assert x.heard == " / ".join(c[5].replace(" ", "") for c in strong or met)[:120]
        left, right = db(f[4]), db(f[5])
        active, sided = max(left, right) >= threshold, abs(left - right) >= 6
        score = active * 1.0 + {"none": 1.25, "weak": 0.9, "strong": -0.5}[x.state] + (0.75 if sided else 0.3 * active) + 0.4 * (max(left, right) >= threshold + 8)
        assert x.score == pytest.approx(score) and x.active == active and len(x.reasons) == active + 1 + (sided or active) + (max(left, right) >= threshold + 8)
    runs, last = [], None
    for f in frames:
        x = got[f[1]]
        if x.active and (x.state != "strong" or x.differs_db >= 5):
            runs.append([x]) if last != x.pos - 1 else runs[-1].append(x)
            last = x.pos
    want = sorted((g[0].start_s, g[-1].end_s, len(g)) for g in runs if g[-1].end_s - g[0].start_s >= 1)
    found = activity.candidates(df).collect()
    assert sorted((x.start_s, x.end_s, x.frames) for x in found) == want
    for x in found:
        g = next(g for g in runs if g[0].start_s == x.start_s)
        assert x.trust == pytest.approx(sum(y.score for y in g) / len(g) + 0.6 * sum(y.state != "strong" for y in g) / len(g) + 0.4)
        assert x.reasons == sorted({w for y in g for w in y.reasons}) + ["speech_not_confirmed_energy_only", "needs_user_disambiguation"]
    assert activity.at_least(activity.candidates(df), "high").count() == sum(x.confidence == "high" for x in found)


def test_candidates_whose_trust_meets_a_bound(spark):
    weigh = {"medium": [("strong", x) for x in (1.65, 1.65, 1.65, 1.25, 1.25, 1.25, 1.25, 1.25)], "high": [("none", 2.55), ("none", 2.55), ("none", 2.55), ("strong", 0.8), ("strong", 1.25)]}
    rows = [(f"{tier}{turn}", k, k / 2 - 0.5, k / 2, state, score) for tier, told in weigh.items() for turn in (1, -1) for k, (state, score) in enumerate(told[::turn], 1)]
    frames = spark.createDataFrame(rows, "file string, pos long, start_s double, end_s double, state string, score double")
    frames = frames.withColumns({"left_db": F.lit(-20.0), "right_db": F.lit(-30.0), "level_db": F.lit(-20.0), "differs_db": F.lit(10.0), "active": F.lit(True), "side": F.lit("left"), "reasons": F.array(F.lit("x"))})
    found = {r.file: (r.confidence, r.trust) for r in activity.candidates(frames).collect()}
    assert found == {"medium1": ("medium", 1.8), "medium-1": ("medium", 1.8), "high1": ("high", 2.7), "high-1": ("high", 2.7)}


def test_recovery_windows(spark):
    cues = spark.createDataFrame([("f", 1, 1, 3000, 9000, "a"), ("f", 2, 2, 4000, 5000, "b"), ("f", 3, 3, 12000, 13000, "c")], CUE)
    lengths = spark.createDataFrame([("f", 20000), ("g", 5000), ("h", None)], "file string, duration_ms long")
    gaps = recovery.uncovered(cues, lengths)
    assert sorted((r.file, r.start_ms, r.end_ms) for r in gaps.collect()) == [("f", 0, 3000), ("f", 9000, 12000), ("f", 13000, 20000), ("g", 0, 5000)]
    wide = recovery.padded(gaps, lengths, 500, 1000)
    assert sorted((r.file, r.start_ms, r.end_ms) for r in wide.collect()) == [("f", 0, 3500), ("f", 8500, 12500), ("f", 12500, 20000), ("g", 0, 5000)]
    some = spark.createDataFrame([("f", 0, 100, "b"), ("f", 350, 400, "a"), ("f", 380, 390, "b"), ("f", 651, 700, "c")], "file string, start_ms long, end_ms long, reason string")
    assert sorted(tuple(r) for r in recovery.merged(some).collect()) == [("f", 0, 400, "b+a"), ("f", 651, 700, "c")]


def test_sources_of_tracks(spark):
    big = 1 << 20
    rows = [
        ("w/SEなし/01 Track.mp3", "mp3", big, 100.0), ("w/wav/01_Track_SEなし.wav", "wav", big, 100.0), ("w/main/０１ Track.wav", "wav", big, 101.0), ("w/main/02.wav", "wav", big, 50.0),
        ("w/03 no se.wav", "wav", 10, 10.0), ("w/sample/02.mp3", "mp3", big, 50.0), ("w/other/02.mp3", "mp3", big, 50.5), ("w/other/b/02.mp3", "mp3", big, None),
    ]
    files = tracks.described(spark.createDataFrame(rows, "path string, extension string, size_bytes long, duration_s double"))
    seen = {r.path: r for r in files.collect()}
    assert seen["w/SEなし/01 Track.mp3"].category == "no_se" and seen["w/main/０１ Track.wav"].category == "unknown"
    assert seen["w/wav/01_Track_SEなし.wav"].track_key == seen["w/main/０１ Track.wav"].track_key == "01track"
    got = {r.track_key: r for r in tracks.select_sources(files).collect()}
    assert set(got) == {"01track", "03"}
    assert got["01track"].path == "w/SEなし/01 Track.mp3" and got["01track"].counterparts == ["w/main/０１ Track.wav"] and not got["01track"].requires_review
    assert got["03"].requires_review and got["03"].warnings == ["very_small_audio_file_verify_not_placeholder", "no_regular_duration_match"]
    assert [tuple(r) for r in tracks.preferred_of(tracks.select_sources(files)).collect()] == [("w/main/０１ Track.wav", "w/SEなし/01 Track.mp3")]
    asked = files.where("path = 'w/main/02.wav'").select("scope_key", "path", "duration_s")
    assert [r.substitute for r in tracks.substitutes(asked, files).collect()] == ["w/other/02.mp3"]
    placed = files.withColumn("directory", F.regexp_extract("path", "^(.*)/[^/]*$", 1))
    pick = lambda s, *v: tracks.in_scope(placed, s, spark.createDataFrame([(x,) for x in v], "value string")).count()
    assert (pick("all", "x"), pick("selected_dirs", "./w/main"), pick("selected_dirs", ".", "w/main"), pick("selected_files", "w/main/02.wav"), pick("selected_files", "z")) == (8, 2, 8, 1, 0)


def test_samples_beyond_the_first_mib(spark):
    import struct

    data = struct.pack("<hh", 100, 7) * 900
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 2, 1000, 4000, 4, 16)
    whole = lambda extra: b"RIFF" + struct.pack("<I", 0) + b"WAVE" + form + struct.pack("<4sI", b"LIST", len(extra)) + extra + struct.pack("<4sI", b"data", len(data)) + data
    files = spark.createDataFrame([("a", bytearray(whole(b""))), ("b", bytearray(whole(b"x" * (3 << 20)))), ("c", bytearray(b"RIFF0000WAVE"))], "path string, content binary")
    assert {r.path: r.duration_s for r in audio_files.wav_durations(files).collect()} == {"a": 0.9, "b": 0.9, "c": None}
    assert [(r.file, r.left_rms, r.right_rms) for r in audio_files.frames(files).orderBy("file", "pos").collect()] == [(f, 100, 7) for f in "aabb"]
