"""Cue files as a Spark data source: ``format("srt")`` and ``format("vtt")``, to read, write and stream.

    cue_source.register(spark)
    cues = spark.read.format("srt").option("recursive", True).load("subtitles/")
    cue_source.written(cues).write.format("vtt").mode("append").save("out/")
    spark.readStream.format("srt").load("inbox/")

Reading: a partition for each group of files of about ``groupBytes``; rows are those of
``cue_files.parse_srt_files`` and ``parse_vtt_files``.  Writing: tasks write whole files
aside, and only when all have ended does the driver rename them into place, so that a
failed write leaves no file and a task that is run again leaves none twice.  Streaming:
files in order of their time of change and path; an offset is the last one taken, and a
file counts once it has not changed for ``settleSeconds``.

Folders are paths or URIs that Arrow's file systems open; all executors must see them.
``file`` is the path below the folder without the kind's ending.
"""

from __future__ import annotations

import re
import time
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from cuespark.dist import ship
from cuespark.functions.timecode import SRT_TIME

SCHEMA = "file string, pos long, idx long, start_ms long, end_ms long, content string, error string"
_KINDS = [("file", pa.string()), ("pos", pa.int64()), ("idx", pa.int64()), ("start_ms", pa.int64()), ("end_ms", pa.int64()), ("content", pa.string()), ("error", pa.string())]
#: Bytes of files in a partition, about; rows in an Arrow batch.
GROUP_BYTES, BATCH = 32 << 20, 10_000
_SIDE = re.compile(SRT_TIME.replace(r"\d", "[0-9]"))
_VTT_SIDE = re.compile(r"(?:([0-9]+):)?([0-9]{2}):([0-9]{2})\.([0-9]{3})")


def _blocks(text: str) -> list[list[str]]:
    """Runs of lines between blank ones."""
    out: list[list[str]] = [[]]
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        if line.strip():
            out[-1].append(line)
        elif out[-1]:
            out.append([])
    return out if out[-1] else out[:-1]


def _ms(m: re.Match) -> int:
    return (int(m[1] or 0) * 60 + int(m[2])) * 60_000 + int(m[3]) * 1000 + int(m[4].ljust(3, "0"))


def srt_rows(file: str, text: str) -> list[tuple]:
    rows = []
    for pos, block in enumerate(_blocks(text), 1):
        sides = [s.split()[:1] for s in block[1].split("-->", 1)] if len(block) > 1 else []
        times = [_SIDE.fullmatch(s[0]) for s in sides if s]
        index = block[0].strip()
        if len(times) < 2 or not all(times) or not (index.isascii() and index.isdigit()):
            return [(file, None, None, None, None, None, "parse_error")]
        rows.append((file, pos, int(index) if int(index) < 1 << 63 else None, *map(_ms, times), "\n".join(block[2:]), None))
    return rows


def vtt_rows(file: str, text: str) -> list[tuple]:
    rows, pos = [], 0
    for block in _blocks(text):
        timing = next((x for x in block if "-->" in x), None)
        if timing is None:
            continue
        times = [_VTT_SIDE.search(s) for s in timing.split("-->")[:2]]
        content = "\n".join(x for x in block if x != timing and x.strip(" ") != "WEBVTT")
        if all(times):
            pos += 1
            rows.append((file, pos, pos, *map(_ms, times), content, None))
        else:
            rows.append((file, None, None, *[m and _ms(m) for m in times], content, "bad_cue"))
    return rows


def _stamp(ms: int, mark: str) -> str:
    return f"{ms // 3_600_000:02}:{ms // 60_000 % 60:02}:{ms // 1000 % 60:02}{mark}{ms % 1000:03}"


def _opened(folder: str):
    """A file system and the folder in it."""
    from pyarrow import fs

    if folder.startswith("file:"):
        folder = "/" + folder[5:].lstrip("/")
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.rstrip("/"))


@dataclass
class Files(InputPartition):
    """Files of one task: (path, name)."""

    files: list


class _Folder:
    """What readers and writers share: the options."""

    def __init__(self, kind: str, options: dict):
        self.kind, self.options = kind, options
        if not options.get("path"):
            raise ValueError("a path is needed")
        self.recursive = str(options.get("recursive", "false")).lower() == "true"
        self.group = int(options.get("groupbytes", options.get("groupBytes", GROUP_BYTES)))

    def listed(self) -> list[tuple[int, str, str, int]]:
        """(time of change in ns, path, name, bytes) of the folder's files of the kind, or of the one file that is named, in order of time and path."""
        from pyarrow import fs

        store, root = _opened(self.options["path"])
        here = store.get_file_info(root)
        if here.type == fs.FileType.NotFound:
            return []
        found = [here] if here.is_file else store.get_file_info(fs.FileSelector(root, recursive=self.recursive))
        base = root.rsplit("/", 1)[0] if here.is_file else root
        end = f".{self.kind}"
        names = [(f, f.path[len(base) + 1 :]) for f in found if f.is_file and f.path.lower().endswith(end)]
        return sorted((f.mtime_ns or 0, f.path, name[: -len(end)], f.size) for f, name in names if not any(p[0] in "._" for p in name.split("/")))

    def grouped(self, files: list[tuple[int, str, str, int]]) -> list[Files]:
        out, size = [], 0
        for _, path, name, n in files:
            if not out or size + n > self.group:
                out.append(Files([]))
                size = 0
            out[-1].files.append((path, name))
            size += n
        return out

    def batches(self, partition: Files):
        store, _ = _opened(self.options["path"])
        parse = srt_rows if self.kind == "srt" else vtt_rows
        rows: list[tuple] = []

        def batch():
            columns = list(zip(*rows)) if rows else [()] * len(_KINDS)
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, _KINDS)], [n for n, _ in _KINDS])

        for path, name in partition.files:
            with store.open_input_stream(path) as f:
                rows += parse(name, f.read().decode("utf-8", "replace"))
            if len(rows) >= BATCH:
                yield batch()
                rows.clear()
        if rows:
            yield batch()


class CueReader(DataSourceReader, _Folder):
    def partitions(self):
        return self.grouped(self.listed()) or [Files([])]

    def read(self, partition):
        return self.batches(partition)


class CueStreamReader(DataSourceStreamReader, _Folder):
    """Offsets are (ns, path) of the last file taken."""

    def initialOffset(self):
        return {"ns": 0, "path": ""}

    def latestOffset(self):
        until = time.time_ns() - int(float(self.options.get("settleseconds", self.options.get("settleSeconds", 1))) * 1e9)
        last = [(ns, path) for ns, path, _, _ in self.listed() if ns <= until][-1:]
        return {"ns": last[0][0], "path": last[0][1]} if last else self.initialOffset()

    def partitions(self, start, end):
        after, until = (start["ns"], start["path"]), (end["ns"], end["path"])
        return self.grouped([f for f in self.listed() if after < f[:2] <= until])

    def read(self, partition):
        return self.batches(partition)

    def commit(self, end):
        pass


@dataclass
class Wrote(WriterCommitMessage):
    """What a task wrote aside: (name, path)."""

    files: list


class CueWriter(DataSourceWriter, _Folder):
    def __init__(self, kind: str, options: dict, overwrite: bool):
        _Folder.__init__(self, kind, options)
        self.overwrite = overwrite
        _, root = _opened(options["path"])
        self.root, self.aside = root, f"{root}/_writing-{uuid.uuid4().hex}"

    def write(self, rows):
        """Rows come by file, in order; a file's text is written when its last row has come."""
        store, _ = _opened(self.options["path"])
        attempt = f"{self.aside}/{uuid.uuid4().hex}"
        mark = "," if self.kind == "srt" else "."
        wrote: list[tuple[str, str]] = []
        seen: set[str] = set()
        out = name = None

        def close():
            if out is not None:
                out.write(b"\n")
                out.close()

        store.create_dir(attempt, recursive=True)
        try:
            for r in rows:
                if r["file"] != name:
                    close()
                    out, name = None, r["file"]
                    if not name or name in seen or any(p in ("", "..") or p[0] in "._" for p in name.split("/")):
                        raise ValueError(f"no name of a file, or its rows are apart: {name!r}")
                    seen.add(name)
                    path = f"{attempt}/{len(seen)}"
                    out = store.open_output_stream(path)
                    wrote.append((name, path))
                    out.write(b"" if self.kind == "srt" else b"WEBVTT\n\n")
                else:
                    out.write(b"\n\n")
                head = f"{r['idx']}\n" if self.kind == "srt" else ""
                out.write(f"{head}{_stamp(r['start_ms'], mark)} --> {_stamp(r['end_ms'], mark)}\n{r['content']}".encode())
        finally:
            close()
        return Wrote(wrote)

    def commit(self, messages):
        """Nothing is renamed before it is known that everything can be."""
        from pyarrow import fs

        store, _ = _opened(self.options["path"])
        wrote = [(name, f"{self.root}/{name}.{self.kind}", path) for m in messages if m for name, path in m.files]
        targets = [t for _, t, _ in wrote]
        if len(set(targets)) < len(targets):
            self.abort(messages)
            raise ValueError("a file's rows are in several tasks; see written()")
        there = [i.path for i in store.get_file_info(targets) if i.type != fs.FileType.NotFound] if targets else []
        if there and not self.overwrite:
            self.abort(messages)
            raise ValueError(f"files exist: {there[:3]}")
        if self.overwrite:
            kept = set(targets)
            for _, path, _, _ in _Folder(self.kind, {**self.options, "recursive": "true"}).listed():
                if path not in kept:
                    store.delete_file(path)
        for _, target, path in wrote:
            store.create_dir(target.rsplit("/", 1)[0], recursive=True)
            store.move(path, target)
        self.abort(messages)

    def abort(self, messages):
        """What was written aside goes."""
        from pyarrow import fs

        store, _ = _opened(self.options["path"])
        if store.get_file_info(self.aside).type != fs.FileType.NotFound:
            store.delete_dir(self.aside)


class SrtSource(DataSource):
    KIND = "srt"

    @classmethod
    def name(cls):
        return cls.KIND

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return CueReader(self.KIND, dict(self.options))

    def streamReader(self, schema):
        return CueStreamReader(self.KIND, dict(self.options))

    def writer(self, schema, overwrite):
        return CueWriter(self.KIND, dict(self.options), overwrite)


class VttSource(SrtSource):
    KIND = "vtt"


def register(spark: SparkSession) -> None:
    """Makes ``srt`` and ``vtt`` formats of the session."""
    ship(spark)
    spark.dataSource.register(SrtSource)
    spark.dataSource.register(VttSource)


def written(cues: DataFrame) -> DataFrame:
    """Good cues as writers take them: a file's rows in one task, in order; names as texts."""
    good = cues.where("error IS NULL") if "error" in cues.columns else cues
    rows = good.select(F.col("file").cast("string").alias("file"), "pos", "idx", "start_ms", "end_ms", F.coalesce("content", F.lit("")).alias("content"))
    return rows.repartition("file").sortWithinPartitions("file", "pos")


def converted(spark: SparkSession, source: str, folder: str, to: str = "vtt", recursive: bool = False, overwrite: bool = False) -> None:
    """SRT files under a folder as files of another kind under another; files that cannot be parsed are left out."""
    register(spark)
    cues = spark.read.format("srt").option("recursive", recursive).load(source)
    written(cues).write.format(to).mode("overwrite" if overwrite else "append").save(folder)
