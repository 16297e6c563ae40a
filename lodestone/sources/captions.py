"""Caption packages: JSON files that hold one video's caption track.

`CaptionPackages` is a data source for them (`spark.read.format("caption_packages")`), with a
partition for a run of files; files are read through Arrow's file systems, so any store that
they know will do. `packages` and `segments` do the same for texts that are in a table
already. A file that is no package is a row with an error, never an exception.

`CaptionParagraphs` is a table function over segments in turn, for SQL:
`SELECT * FROM caption_paragraphs(TABLE(segments) PARTITION BY path ORDER BY n)`.
"""

from __future__ import annotations

import json
import math
import posixpath
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestone.functions import text as T

#: What a package's id looks like, its version, its kinds of tracks, and its defaults.
ID_PATTERN, VERSION, TRACKS = "^BV[0-9A-Za-z]+$", 1, ("author", "ai")
TITLE, LANGUAGE = "Bilibili 视频", "unknown"
#: What a file that is no package is reported as.
NOT_JSON, NOT_PACKAGE, UNREADABLE = "INVALID_JSON", "INVALID_PACKAGE", "UNREADABLE"
SEGMENT = "struct<start_ms double, end_ms double, text string, speaker string>"
PACKAGE = f"path string, error string, id string, cid string, page long, title string, part_title string, author string, description string, language string, track_kind string, duration_ms double, segments array<{SEGMENT}>"
_FIELDS = [c.split(" ")[0] for c in PACKAGE.split(f", segments array<{SEGMENT}>")[0].split(", ")]
_BLANK = re.compile(f"[{T.SPACE}]".replace(r"\x{", r"\u").replace("}", ""))


def _number(value) -> float | None:
    return float(value) if isinstance(value, int | float) and not isinstance(value, bool) and math.isfinite(value) else None


def _text(value, default: str = "") -> str:
    """A value as text, as JSON would print it; null and what is absent is the default."""
    if value is None:
        return default
    if isinstance(value, str):
        return value
    return ("true" if value else "false") if isinstance(value, bool) else str(int(value) if isinstance(value, float) and value.is_integer() else value)


def _trimmed(text: str) -> str:
    a, b = 0, len(text)
    while a < b and _BLANK.match(text[a]):
        a += 1
    while b > a and _BLANK.match(text[b - 1]):
        b -= 1
    return text[a:b]


def _page(value) -> int:
    try:
        return max(1, math.floor(float(1 if value is None else value)))
    except (TypeError, ValueError, OverflowError):
        return 1


def parse_package(text: str | None) -> tuple:
    """(error, id, ..., segments): the columns of PACKAGE behind the path. Segments without
    text go; numbers that are none are null; a page below 1 or without a number is 1."""
    nothing = (None,) * (len(_FIELDS) - 2)
    try:
        found = json.loads(text or "")
    except ValueError:
        return (NOT_JSON, *nothing, None)
    if not isinstance(found, dict) or found.get("schemaVersion") != VERSION or isinstance(found.get("schemaVersion"), bool) or not re.match(ID_PATTERN, _text(found.get("bvid"))) or not isinstance(found.get("segments"), list):
        return (NOT_PACKAGE, *nothing, None)
    title = _text(found.get("title"), TITLE)
    segments = []
    for s in found["segments"]:
        words = _trimmed(_text(s.get("text"))) if isinstance(s, dict) else ""
        if words:
            segments.append((_number(s.get("startMs")), _number(s.get("endMs")), words, s["speaker"] if isinstance(s.get("speaker"), str) else None))
    description = found.get("description")
    return (
        None, _text(found["bvid"]), _text(found.get("cid")), _page(found.get("page")), title, _text(found.get("partTitle"), title), _text(found.get("author")),
        description if isinstance(description, str) else None, _text(found.get("language"), LANGUAGE), found.get("trackKind") if found.get("trackKind") in TRACKS else "unknown", _number(found.get("durationMs")), segments,
    )


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.glob = options["path"], options.get("extension", ".bili-caption")
        self.files = max(1, int(options.get("filesperpartition", 64)))

    def partitions(self) -> list[_Files]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        found = sorted(f.path for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and f.path.endswith(self.glob))
        return [_Files(found[i : i + self.files]) for i in range(0, len(found), self.files)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        from pyarrow import fs

        store = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        for path in partition.paths:
            try:
                with store.open_input_stream(path) as f:
                    text = f.read().decode()
            except (OSError, UnicodeDecodeError):
                yield (path, UNREADABLE, *(None,) * (len(_FIELDS) - 2), None)
                continue
            yield (path, *parse_package(text))


class CaptionPackages(DataSource):
    """Options: path (a folder), extension, filesPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "caption_packages"

    def schema(self) -> str:
        return PACKAGE

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class CaptionParagraphs:
    """Rows (path, n, start_ms, end_ms, text) in turn -> (path, paragraph, start_ms, end_ms,
    text): a paragraph ends where the pause is over `PAUSE` ms or it has over `MOST`
    characters. State is one paragraph, so a partition may be of any length."""

    PAUSE, MOST = 2000, 400

    def __init__(self):
        self.path, self.number, self.parts, self.start, self.end = None, 0, [], None, None

    def eval(self, row):
        pause = self.end is not None and row["start_ms"] is not None and row["start_ms"] - self.end > self.PAUSE
        if self.parts and (pause or sum(map(len, self.parts)) > self.MOST):
            yield self._told()
        if not self.parts:
            self.start = row["start_ms"]
        self.path, self.end = row["path"], row["end_ms"]
        self.parts.append(row["text"])

    def terminate(self):
        if self.parts:
            yield self._told()

    def _told(self):
        self.number += 1
        out = (self.path, self.number, self.start, self.end, " ".join(self.parts))
        self.parts = []
        return out


def register(spark: SparkSession) -> None:
    """Makes the data source and the table function known to a session."""
    spark.dataSource.register(CaptionPackages)
    spark.udtf.register("caption_paragraphs", F.udtf(CaptionParagraphs, returnType="path string, paragraph int, start_ms double, end_ms double, text string"))


def packages(files: DataFrame) -> DataFrame:
    """The columns of PACKAGE of texts (path, content) that are in a table already (Arrow
    batches of whole texts; a text is a package of its own)."""

    def read(batches):
        import pyarrow as pa

        names = ["path", *_FIELDS[1:], "segments"]
        kinds = [pa.string()] * 4 + [pa.int64()] + [pa.string()] * 6 + [pa.float64(), pa.list_(pa.struct([("start_ms", pa.float64()), ("end_ms", pa.float64()), ("text", pa.string()), ("speaker", pa.string())]))]
        for batch in batches:
            rows = [(p, *parse_package(t)) for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            columns[-1] = [None if s is None else [dict(zip(("start_ms", "end_ms", "text", "speaker"), x, strict=True)) for x in s] for s in columns[-1]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return files.select("path", "content").mapInArrow(read, PACKAGE)


def segments(found: DataFrame) -> DataFrame:
    """path, n (from 1), start_ms, end_ms, text, speaker of packages, a row a segment."""
    rows = found.where("error IS NULL").select("path", F.posexplode("segments").alias("at", "s"))
    return rows.select("path", (F.col("at") + 1).alias("n"), "s.*")


def issues(found: DataFrame) -> DataFrame:
    """path, code of files that are no package, and of packages without a segment."""
    code: Column = F.coalesce("error", F.when(F.size("segments") == 0, "NO_SEGMENTS"))
    return found.select("path", code.alias("code")).where("code IS NOT NULL")


def package_path(folder: str, name: str) -> str:
    return posixpath.join(folder, f"{name}.bili-caption")
