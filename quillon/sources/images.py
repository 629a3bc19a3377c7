"""Image files: their bytes, and what their headers tell, without an image library.

Pixels need a plug-in (stage "decode"); this reads the bytes first, else the
file at the path, and leaves null where neither can be read, so that
``manifest.readable`` can skip such rows while indexes keep their gaps.

``headers`` asks for the size of images alone: names are matched, and of a file the first block is read, and for JPEG the
blocks that its segments lead to.  ``with_bytes`` is for those that need the contents.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that are read of a file at once, and blocks after which a file is given up.
BLOCK, MOST_BLOCKS = 4096, 64


def with_bytes(samples: DataFrame, folder: str | None = None) -> DataFrame:
    """Adds content: image_bytes, else the file of that path below the folder; null if there is none."""
    spark: SparkSession = samples.sparkSession
    if folder is None:
        return samples.withColumn("content", F.col("image_bytes"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    files = files.select(F.regexp_replace("path", "^[a-z]+:/*", "/").alias("file_path"), F.col("content").alias("file_content"))
    joined = samples.join(files, F.regexp_replace("image_path", "^[a-z]+:/*", "/") == F.col("file_path"), "left")
    return joined.withColumn("content", F.coalesce("image_bytes", "file_content")).drop("file_path", "file_content")


def _number(content: Column, at: int, size: int, little: bool = False) -> Column:
    """An unsigned number of some bytes from a 1-based place."""
    one = [F.conv(F.hex(F.substring(content, at + k, 1)), 16, 10).cast("long") for k in range(size)]
    total = F.lit(0)
    for b in reversed(one) if little else one:
        total = total * 256 + b
    return total


def header(content: Column) -> Column:
    """struct(format, width, height) of PNG, GIF and BMP; format alone of JPEG; null for anything else."""
    lead = F.hex(F.substring(content, 1, 8))
    png, gif = lead == "89504E470D0A1A0A", F.startswith(lead, F.lit("47494638"))
    bmp, jpeg = F.startswith(lead, F.lit("424D")), F.startswith(lead, F.lit("FFD8FF"))
    size = F.octet_length(content)

    def known(kind: str, width: Column, height: Column) -> Column:
        return F.struct(F.lit(kind).alias("format"), width.cast("long").alias("width"), height.cast("long").alias("height"))

    return (
        F.when(png & (size >= 24), known("png", _number(content, 17, 4), _number(content, 21, 4)))
        .when(gif & (size >= 10), known("gif", _number(content, 7, 2, True), _number(content, 9, 2, True)))
        .when(bmp & (size >= 26), known("bmp", _number(content, 19, 4, True), _number(content, 23, 4, True)))
        .when(jpeg, known("jpeg", F.lit(None), F.lit(None)))
    )


class Blocks:
    """A file or bytes, of which whole blocks are fetched as they are asked for."""

    def __init__(self, fetch: Callable[[int, int], bytes]):
        self.fetch, self.held, self.bytes_read = fetch, {}, 0

    def at(self, place: int, n: int) -> bytes:
        out = b""
        for k in range(place // BLOCK, (place + n - 1) // BLOCK + 1):
            if k not in self.held:
                if len(self.held) >= MOST_BLOCKS:
                    return b""
                self.held[k] = self.fetch(k * BLOCK, BLOCK)
                self.bytes_read += len(self.held[k])
            out += self.held[k]
        start = place - place // BLOCK * BLOCK
        return out[start : start + n]


def head_of(blocks: Blocks) -> tuple[str, int | None, int | None] | None:
    """(format, width, height) of PNG, GIF, BMP or JPEG; sizes are null if the file ends before them."""
    lead = blocks.at(0, 26)
    whole = lambda b, order: int.from_bytes(b, order)
    if lead.startswith(b"\x89PNG\r\n\x1a\n"):
        return ("png", whole(lead[16:20], "big"), whole(lead[20:24], "big")) if len(lead) >= 24 else None
    if lead.startswith(b"GIF8"):
        return ("gif", whole(lead[6:8], "little"), whole(lead[8:10], "little")) if len(lead) >= 10 else None
    if lead.startswith(b"BM"):
        return ("bmp", whole(lead[18:22], "little"), whole(lead[22:26], "little")) if len(lead) >= 26 else None
    return ("jpeg", *_jpeg_size(blocks)) if lead.startswith(b"\xff\xd8\xff") else None


def _jpeg_size(blocks: Blocks) -> tuple[int | None, int | None]:
    """Size in the frame header, found by the lengths of the segments before it."""
    place = 2
    while len(mark := blocks.at(place, 4)) == 4 and mark[0] == 0xFF:
        kind = mark[1]
        if kind == 0xFF:  # a filling byte
            place += 1
        elif kind == 0x01 or 0xD0 <= kind <= 0xD8:  # without a length
            place += 2
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            frame = blocks.at(place + 5, 4)
            return (int.from_bytes(frame[2:], "big"), int.from_bytes(frame[:2], "big")) if len(frame) == 4 else (None, None)
        elif kind in (0xD9, 0xDA):
            break
        else:
            place += 2 + int.from_bytes(mark[2:], "big")
    return None, None


def _opened(path: str):
    """A file for reading at places, of any store that Arrow knows; null if there is none of that name."""
    system, name = (pafs.LocalFileSystem(), path) if path.startswith("/") else pafs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def headers(samples: DataFrame, folder: str | None = None) -> DataFrame:
    """Adds header (format, width, height; null if the image cannot be read) and bytes_read of the file.

    image_bytes come first, else the file of the path below the folder.  Names of files are listed by Spark and joined to the
    samples; contents never move.  Stores that Arrow does not know raise: use ``decoded`` there.
    """
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    found = samples.withColumn("file_path", F.lit(None).cast("string"))
    if folder is not None:
        listed = samples.sparkSession.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
        names = listed.select(plain(F.col("path")).alias("file_path"))
        found = samples.join(names, plain(F.col("image_path")) == F.col("file_path"), "left")

    columns = list(samples.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, counts = [], []
            for inline, path in zip(batch["image_bytes"], batch["file_path"].to_pylist()):
                if inline.is_valid:
                    data = inline.as_buffer()
                    blocks = Blocks(lambda at, n, data=data: data.slice(at, min(n, len(data) - at)).to_pybytes() if at < len(data) else b"")
                    heads.append(head_of(blocks))
                    counts.append(0)
                elif path is None:
                    heads.append(None)
                    counts.append(0)
                else:
                    with _opened(path) as file:
                        blocks = Blocks(lambda at, n, file=file: file.read_at(n, at))
                        heads.append(head_of(blocks))
                    counts.append(blocks.bytes_read)
            named = [None if h is None else dict(zip(("format", "width", "height"), h)) for h in heads]
            kind = pa.struct([("format", pa.string()), ("width", pa.int64()), ("height", pa.int64())])
            kept = [batch[c] for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(named, kind), pa.array(counts, pa.int64())], names=[*columns, "header", "bytes_read"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in samples.schema)
    return found.select(*columns, "file_path").mapInArrow(run, f"{fields}, header struct<format:string,width:bigint,height:bigint>, bytes_read bigint")


def decoded(samples: DataFrame, folder: str | None = None) -> DataFrame:
    """The samples whose image can be read, with content and header; the others are skipped."""
    found = with_bytes(samples, folder).withColumn("header", header(F.col("content")))
    return found.where(F.col("header").isNotNull())
