"""Gray images as STRUCT<height, width, data>, one byte a pixel, and NumPy operations on them.

An optional tier: Spark's ``image`` source decodes files on the JVM, and its
struct has the same fields. Operations run in Arrow batches, an image at a time.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

IMAGE = "struct<height:int,width:int,data:binary>"
WHITE = 255


def from_source(image: Column) -> Column:
    """The ``image`` source's struct as an image, colours averaged; an unreadable one as 128 x 128 white pixels."""

    @F.arrow_udf(IMAGE)
    def run(rows: pa.Array) -> pa.Array:
        out = []
        for r in rows.to_pylist():
            if r is None or r["width"] <= 0:
                out.append(np.full((128, 128), WHITE, np.uint8))
            else:
                pixels = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["nChannels"])
                out.append(np.rint(pixels[:, :, :3].mean(axis=2)).astype(np.uint8))
        return packed(out)

    return run(image)


def packed(images: list) -> pa.Array:
    kind = pa.struct([("height", pa.int32()), ("width", pa.int32()), ("data", pa.binary())])
    return pa.array([None if x is None else {"height": x.shape[0], "width": x.shape[1], "data": x.tobytes()} for x in images], kind)


def unpacked(row: dict | None) -> np.ndarray | None:
    return None if row is None else np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"])


def applied(operation, image: Column, *numbers: Column) -> Column:
    """``operation`` of each image and of numbers beside it; null images stay null."""
    whole = F.struct(image.alias("image"), F.array(*(n.cast("double") for n in numbers)).cast("array<double>").alias("numbers"))

    @F.arrow_udf(IMAGE)
    def run(rows: pa.Array) -> pa.Array:
        return packed([None if r["image"] is None else np.ascontiguousarray(operation(unpacked(r["image"]), *r["numbers"]), np.uint8) for r in rows.to_pylist()])

    return run(whole)


def clipped(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def inverted(image: Column) -> Column:
    return applied(lambda x: WHITE - x, image)


def brightened(image: Column, change: Column) -> Column:
    return applied(lambda x, c: clipped(x.astype(float) + c), image, change)


def contrasted(image: Column, factor: Column) -> Column:
    """Differences to the mean multiplied by a factor."""
    return applied(lambda x, f: clipped((x - x.mean()) * f + x.mean()), image, factor)


def neighbours(x: np.ndarray, size: int, pick) -> np.ndarray:
    around = np.pad(x, size // 2, mode="edge")
    return pick(np.lib.stride_tricks.sliding_window_view(around, (size, size)), axis=(2, 3))


def eroded(image: Column, size: int = 3) -> Column:
    """The least of each pixel's square: dark strokes grow."""
    return applied(lambda x: neighbours(x, size, np.min), image)


def dilated(image: Column, size: int = 3) -> Column:
    """The greatest of each pixel's square: dark strokes shrink."""
    return applied(lambda x: neighbours(x, size, np.max), image)


def cropped(image: Column, top: Column, bottom: Column) -> Column:
    """Rows from top to bottom, cut to the image."""
    return applied(lambda x, t, b: x[max(0, int(t)) : max(0, int(b))], image, top, bottom)


def padded(image: Column, height: Column, width: Column) -> Column:
    """White below and to the right, up to a size."""
    return applied(lambda x, h, w: np.pad(x, ((0, max(0, int(h) - x.shape[0])), (0, max(0, int(w) - x.shape[1]))), constant_values=WHITE), image, height, width)


def resized(image: Column, height: Column, width: Column) -> Column:
    """Bilinear, pixel centres aligned."""

    def at(n: int, m: int):
        place = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        low = np.floor(place).astype(int)
        return low, np.minimum(low + 1, n - 1), place - low

    def run(x, h, w):
        h, w = max(1, int(h)), max(1, int(w))
        a, b, v = at(x.shape[0], h)
        c, d, u = at(x.shape[1], w)
        rows = x[a] * (1 - v)[:, None] + x[b] * v[:, None]
        return clipped(rows[:, c] * (1 - u) + rows[:, d] * u)

    return applied(run, image, height, width)


def stacked(images: Column) -> Column:
    """An array of images one below the other, white on the right of narrow ones."""

    @F.arrow_udf(IMAGE)
    def run(rows: pa.Array) -> pa.Array:
        out = []
        for r in rows.to_pylist():
            parts = [unpacked(x) for x in r or [] if x is not None]
            width = max((p.shape[1] for p in parts), default=0)
            out.append(np.vstack([np.pad(p, ((0, 0), (0, width - p.shape[1])), constant_values=WHITE) for p in parts]) if parts else None)
        return packed(out)

    return run(images)
