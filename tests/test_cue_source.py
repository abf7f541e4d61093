import os
import random

import pytest
from pyspark.sql import functions as F

from cuespark.sources import cue_files, cue_source

GOOD = "1\n00:00:01,000 --> 00:00:02,500\nOne\nline\n\n7\n00:00:03,000 --> 00:00:04,000\nÜnï 中文\n"


@pytest.fixture(scope="module")
def formats(spark):
    cue_source.register(spark)
    return spark


def rows(df):
    return sorted((tuple(r) for r in df.select("file", "pos", "idx", "start_ms", "end_ms", "content", "error").collect()), key=str)


def put(folder, **texts):
    for name, text in texts.items():
        path = folder / name.replace("__", "/").replace("_DOT_", ".")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode())


def test_rows_are_those_of_the_parsers(formats, tmp_path):
    """Files at random, read by the source and by the parsers of texts."""
    rng = random.Random(9)
    pieces = ["1", "2", "\n", "\n", "\n", "00:00:01,000 --> 00:00:02,000", "00:01.000 --> 00:02.000 line:0", "01:00:01.000 --> x", "WEBVTT", "text", "　", "\x0c", " ", "\r\n", "\r\n\r\n"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(2, 14))) for _ in range(150)] + [GOOD, "", "WEBVTT\n\n00:01.000 --> 00:02.000\nHi\n"]
    for kind, parse in (("srt", cue_files.parse_srt_files), ("vtt", cue_files.parse_vtt_files)):
        folder = tmp_path / kind
        folder.mkdir()
        for k, t in enumerate(texts):
            (folder / f"f{k}.{kind}").write_bytes(t.encode())
        read = formats.read.format(kind).option("groupBytes", 500).load(str(folder))
        assert read.rdd.getNumPartitions() > 3
        assert rows(read) == rows(parse(formats.createDataFrame([(f"f{k}", t) for k, t in enumerate(texts)], "file string, value string")))


def test_folders_names_and_nothing(formats, tmp_path):
    put(tmp_path, a_DOT_srt=GOOD, b_DOT_SRT=GOOD, sub__c_DOT_srt="no cue", d_DOT_txt=GOOD, sub___hidden_DOT_srt=GOOD)
    read = lambda **o: {r.file for r in formats.read.format("srt").options(**o).load(str(tmp_path)).select("file").distinct().collect()}
    assert read() == {"a", "b"} and read(recursive=True) == {"a", "b", "sub/c"}
    assert formats.read.format("srt").load(str(tmp_path / "a.srt")).count() == 2
    assert formats.read.format("srt").load(str(tmp_path / "nowhere")).count() == 0


def test_round_trip_of_many_files(formats, tmp_path):
    cues = formats.range(300).select(F.concat(F.lit("d/f"), (F.col("id") % 23).cast("string")).alias("file"), F.col("id").alias("pos"), (F.col("id") + 5).alias("idx"), (F.col("id") * 1000).alias("start_ms"), (F.col("id") * 1000 + 7).alias("end_ms"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("content"))
    for kind in ("srt", "vtt"):
        out = str(tmp_path / kind)
        cue_source.written(cues).write.format(kind).mode("append").save(out)
        back = formats.read.format(kind).option("recursive", True).load(out)
        want = {(r.file, r.start_ms, r.end_ms, r.content) for r in cues.collect()}
        assert {(r.file, r.start_ms, r.end_ms, r.content) for r in back.collect()} == want and back.count() == 300
        text = cue_files.to_texts(cues.where("file = 'd/f3'"), kind).collect()[0].value
        assert (tmp_path / kind / "d" / f"f3.{kind}").read_text() == text
    # append refuses files that are there and leaves them and everything else alone; overwrite replaces all
    before = (tmp_path / "srt/d/f3.srt").read_bytes()
    more = cues.withColumn("file", F.when(F.col("file") == "d/f3", "d/f3").otherwise(F.concat("file", F.lit("x")))).withColumn("content", F.lit("new"))
    with pytest.raises(Exception, match="files exist"):
        cue_source.written(more).write.format("srt").mode("append").save(str(tmp_path / "srt"))
    assert (tmp_path / "srt/d/f3.srt").read_bytes() == before and len(os.listdir(tmp_path / "srt/d")) == 23 and os.listdir(tmp_path / "srt") == ["d"]
    cue_source.written(more).write.format("srt").mode("overwrite").save(str(tmp_path / "srt"))
    assert len(os.listdir(tmp_path / "srt/d")) == 23 and "new" in (tmp_path / "srt/d/f3.srt").read_text() and not (tmp_path / "srt/d/f4.srt").exists()


def test_a_failed_write_leaves_no_file(formats, tmp_path):
    cues = formats.range(100).select((F.col("id") % 10).alias("file"), F.col("id").alias("pos"), F.col("id").alias("idx"), F.expr("if(id = 57, null, id)").alias("start_ms"), F.col("id").alias("end_ms"), F.lit("t").alias("content"))
    out = tmp_path / "out"
    with pytest.raises(Exception):
        cue_source.written(cues).write.format("srt").mode("append").save(str(out))
    assert not out.exists() or os.listdir(out) == []
    apart = cues.where("id <> 57").withColumn("file", F.col("file").cast("string")).repartition(3)
    with pytest.raises(Exception, match="apart|several tasks"):
        apart.write.format("srt").mode("append").save(str(out))
    assert not out.exists() or os.listdir(out) == []


def test_stream_of_new_files(formats, tmp_path):
    inbox = tmp_path / "in"
    put(inbox, a_DOT_srt=GOOD, b_DOT_srt="broken")

    def run():
        stream = formats.readStream.format("srt").option("settleSeconds", 0).load(str(inbox))
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        return sorted((r.file, r.idx, r.error) for r in formats.read.parquet(str(tmp_path / "out")).collect())

    first = [("a", 1, None), ("a", 7, None), ("b", None, "parse_error")]
    assert run() == first and run() == first
    put(inbox, c_DOT_srt=GOOD)
    os.utime(inbox / "c.srt", ns=(os.stat(inbox / "b.srt").st_mtime_ns + 5_000_000,) * 2)
    assert run() == sorted(first + [("c", 1, None), ("c", 7, None)], key=str) or run() == first + [("c", 1, None), ("c", 7, None)]


def test_folder_to_another_kind(formats, tmp_path):
    put(tmp_path / "in", x__a_DOT_srt=GOOD, b_DOT_srt="broken")
    cue_source.converted(formats, str(tmp_path / "in"), str(tmp_path / "out"), "vtt", recursive=True)
    assert (tmp_path / "out/x/a.vtt").read_text().startswith("WEBVTT\n\n00:00:01.000 --> 00:00:02.500\nOne\nline\n\n") and os.listdir(tmp_path / "out") == ["x"]
