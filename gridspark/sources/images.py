"""Images as grids: (height, width) cells of channels in 0..255, row 0 at the bottom.

Reading uses Spark's image source, which decodes on the executors: a row an image, its bytes
from the top in the order blue, green, red. One image is one row there, so it must fit a task.
Writing packs the lines on the executors, puts the one image together on the driver as PNG
and writes it through Hadoop's file system, so any store can take it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..grid import Grid
from .generate import packed

#: Layouts, and the places of red, green and blue among a cell's channels.
LAYOUTS = {"rgba": (0, 1, 2), "rgb": (0, 1, 2), "bgra": (2, 1, 0), "bgr": (2, 1, 0), "grey": (0, 0, 0)}
CHANNELS = {"rgba": 4, "rgb": 3, "bgra": 4, "bgr": 3, "grey": 1}


@dataclass
class Image:
    """A grid of channel arrays (grey: of numbers) and its layout."""

    grid: Grid
    layout: str


def read_image(spark: SparkSession, path: str) -> Image:
    """One image file; its size and layout are read on the driver, its cells stay distributed."""
    rows = spark.read.format("image").load(path).select("image.*")
    head = rows.select("height", "width", "nChannels").first()
    if head is None:
        raise ValueError(f"{path}: no image can be read")
    h, w, n = head
    layout = {1: "grey", 3: "bgr", 4: "bgra"}[n]
    # A row of cells a line first, so that no task explodes the whole image at once.
    lines = rows.select(F.explode(F.sequence(F.lit(0), F.lit(h - 1))).alias("y"), "data")
    lines = lines.select((F.lit(h - 1) - F.col("y")).cast("long").alias("i0"), F.expr(f"substring(data, y * {w * n} + 1, {w * n})").alias("line"))
    cells = lines.select("i0", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(w - 1).cast("long"))).alias("i1"), "line")
    byte = lambda k: F.conv(F.hex(F.expr(f"substring(line, cast(i1 as int) * {n} + {k + 1}, 1)")), 16, 10).cast("int")
    value = byte(0) if n == 1 else F.array(*[byte(k) for k in range(n)])
    return Image(Grid(cells.select("i0", "i1", value.alias("v")), (h, w)), layout)


def read_rgb(f: Callable[[Column, Column, Column], Column], image: Image) -> Grid:
    """``f(red, green, blue)`` of any layout; alpha is dropped and grey stands for all three."""
    r, g, b = LAYOUTS[image.layout]
    if image.layout == "grey":
        return image.grid.with_value(f(image.grid.value, image.grid.value, image.grid.value))
    v = image.grid.value
    return image.grid.with_value(f(v.getItem(r), v.getItem(g), v.getItem(b)))


def read_rgb_vectors(image: Image) -> Grid:
    return read_rgb(lambda r, g, b: F.array(r, g, b), image)


def png(width: int, height: int, channels: int, data: bytes) -> bytes:
    """An 8-bit PNG file of rows from the top."""
    kind = {1: 0, 3: 2, 4: 6}[channels]
    raw = b"".join(b"\0" + data[y * width * channels : (y + 1) * width * channels] for y in range(height))
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def write_image(grid: Grid, path: str, layout: str) -> None:
    """Writes a grid of channels in 0..255 as a PNG file."""
    h, w = grid.extent
    n, (r, g, b) = CHANNELS[layout], LAYOUTS[layout]
    order = {1: (0,), 3: (r, g, b), 4: (r, g, b, 3)}[n]
    lines = packed(grid.with_value(F.array(grid.value) if n == 1 else F.array(*[grid.value.getItem(k) for k in order])))
    hexed = F.transform(F.flatten("vs"), lambda c: F.lpad(F.hex(c.cast("long").bitwiseAND(F.lit(255).cast("long"))), 2, "0"))
    one = lines.select("i0", F.unhex(F.array_join(hexed, "")).alias("line")).orderBy(F.desc("i0"))
    data = b"".join(bytes(r["line"]) for r in one.toLocalIterator())
    jvm = grid.spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(grid.spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(png(w, h, n, data)))
    out.close()
