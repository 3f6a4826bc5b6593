"""Local contrast on images, and checks on image files."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = 256

# The first bytes of common image files, in hexadecimal.
MAGIC = (
    ("89504E470D0A1A0A", "png"),
    ("FFD8FF", "jpeg"),
    ("47494638", "gif"),
    ("424D", "bmp"),
    ("52494646", "riff"),
    ("49492A00", "tiff"),
    ("4D4D002A", "tiff"),
)


def magic_kind(content):
    """The kind of file its first bytes say it is."""
    head = F.hex(F.substring(content, 1, 8))
    kind = F.lit("unknown")
    for prefix, name in reversed(MAGIC):
        kind = F.when(head.startswith(prefix), name).otherwise(kind)
    return kind


def audit_images(images: DataFrame) -> DataFrame:
    """Status of each image: ok, or undecodable (the source gives height -1)."""
    return images.withColumn(
        "status", F.when(F.col("height") < 0, "undecodable").otherwise("ok")
    )


def audit_totals(audited):
    return audited.groupBy("status").agg(F.count("*").alias("files"))


def _tile_tables(plane, tiles, clip):
    """For each tile of a grey image a table of output levels, (tiles, tiles, 256).

    Tiles are equal shares of the image; one without pixels takes the table of
    the nearest that has some.
    """
    high, wide = plane.shape
    down, across = np.arange(high) * tiles // high, np.arange(wide) * tiles // wide
    cell = (down[:, None] * tiles + across) * LEVELS + plane
    counts = np.bincount(cell.ravel(), minlength=tiles * tiles * LEVELS)
    counts = counts.reshape(tiles * tiles, LEVELS)
    pixels = counts.sum(1, keepdims=True)
    top = np.maximum(np.floor(clip * pixels / LEVELS).astype(np.int64), 1)
    excess = np.maximum(counts - top, 0).sum(1, keepdims=True)
    rest = excess % LEVELS
    step = np.maximum(LEVELS // np.maximum(rest, 1), 1)
    level = np.arange(LEVELS)
    one_more = (level % step == 0) & (level // step < rest)
    counts = np.minimum(counts, top) + excess // LEVELS + one_more
    shares = np.cumsum(counts, 1) * 255.0 / np.maximum(pixels, 1)
    tables = np.minimum(np.floor(shares + 0.5), 255).reshape(tiles, tiles, LEVELS)
    near_y, near_x = (_nearest(np.unique(used), tiles) for used in (down, across))
    return tables[near_y][:, near_x]


def _nearest(used, tiles):
    return used[np.abs(np.arange(tiles)[:, None] - used).argmin(1)]


def equalize_plane(plane, tiles, clip):
    """Contrast-limited local equalisation of a grey image (2-d array of bytes).

    Each pixel blends the tables of the four nearest tiles.
    """
    high, wide = plane.shape
    tables = _tile_tables(plane, tiles, clip)

    def place(size):
        at = (np.arange(size) + 0.5) * tiles / size - 0.5
        low = np.floor(at).astype(int)
        return np.clip(low, 0, tiles - 1), np.clip(low + 1, 0, tiles - 1), at - low

    left, right, ax = place(wide)
    out = np.empty_like(plane)
    above, below, ay = place(high)
    # A row at a time: a row meets two rows of tables.
    for y in range(high):
        v, mix = plane[y], ay[y]
        upper, lower = tables[above[y]], tables[below[y]]
        top = upper[left, v] * (1 - ax) + upper[right, v] * ax
        bottom = lower[left, v] * (1 - ax) + lower[right, v] * ax
        out[y] = np.floor(top * (1 - mix) + bottom * mix + 0.5)
    return out


# sRGB to CIE XYZ for the D65 white point, its inverse, the white
# point, and the CIE L*a*b* threshold and slope.
TO_XYZ = (
    (0.412453, 0.357580, 0.180423),
    (0.212671, 0.715160, 0.072169),
    (0.019334, 0.119193, 0.950227),
)
FROM_XYZ = (
    (3.240479, -1.53715, -0.498535),
    (-0.969256, 1.875991, 0.041556),
    (0.055648, -0.204043, 1.057311),
)
WHITE = (0.950456, 1.0, 1.088754)
LAB_LOW = 0.008856
LAB_SLOPE = 7.787


def equalize_colour(frame, tiles, clip):
    """The same for a colour image (blue, green, red): only lightness changes."""
    level = np.arange(LEVELS) / 255.0
    linear = np.where(level > 0.04045, ((level + 0.055) / 1.055) ** 2.4, level / 12.92)
    rgb = linear[frame[:, :, ::-1]]
    xyz = rgb @ np.array(TO_XYZ).T / np.array(WHITE)
    f = np.where(xyz > LAB_LOW, np.cbrt(xyz), LAB_SLOPE * xyz + 16 / 116)
    light = np.floor(np.maximum(116 * f[:, :, 1] - 16, 0) * 2.55 + 0.5).astype(np.uint8)
    new = (equalize_plane(light, tiles, clip) / 2.55 + 16) / 116
    f = f + (new - f[:, :, 1])[:, :, None]
    cube = f**3
    xyz = np.where(cube > LAB_LOW, cube, (f - 16 / 116) / LAB_SLOPE) * np.array(WHITE)
    rgb = xyz @ np.array(FROM_XYZ).T
    power = np.maximum(rgb, 0) ** (1 / 2.4)
    rgb = np.where(rgb > 0.0031308, 1.055 * power - 0.055, rgb * 12.92)
    rgb = np.floor(np.clip(rgb, 0, 1) * 255 + 0.5).astype(np.uint8)
    return rgb[:, :, ::-1]


def equalize_images(images: DataFrame, tiles: int = 8, clip: float = 2.0) -> DataFrame:
    """Image rows (height, width, nChannels, data) with their contrast equalised.

    Grey images are equalised as they are, colour images by lightness. Rows that
    could not be decoded, or have other channels, stay as they are. An image is
    worked on as one block of bytes by the task that holds its row; nothing is
    shuffled.
    """

    @F.pandas_udf("binary")
    def equalised(
        high: pd.Series, wide: pd.Series, channels: pd.Series, data: pd.Series
    ) -> pd.Series:
        out = []
        for h, w, n, raw in zip(high, wide, channels, data, strict=True):
            if raw is None or n not in (1, 3) or h <= 0 or w <= 0:
                out.append(raw)
            elif n == 1:
                plane = np.frombuffer(raw, np.uint8).reshape(int(h), int(w))
                out.append(equalize_plane(plane, tiles, clip).tobytes())
            else:
                frame = np.frombuffer(raw, np.uint8).reshape(int(h), int(w), 3)
                out.append(equalize_colour(frame, tiles, clip).tobytes())
        return pd.Series(out)

    return images.withColumn("data", equalised("height", "width", "nChannels", "data"))
