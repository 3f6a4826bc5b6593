import numpy as np

from boxframe.operators import raster


def equalise(image, tiles, clip):
    """The method on one small array, pixel by pixel."""
    high, wide = image.shape
    tables = {}
    for ty in range(tiles):
        for tx in range(tiles):
            values = [image[y, x] for y in range(high) for x in range(wide)
                      if y * tiles // high == ty and x * tiles // wide == tx]
            counts = np.bincount(values, minlength=256)
            top = max(int(clip * len(values) / 256), 1)
            excess = int(np.maximum(counts - top, 0).sum())
            counts = np.minimum(counts, top) + excess // 256
            rest = excess % 256
            if rest:
                step = max(256 // rest, 1)
                for k in range(rest):
                    if k * step < 256:
                        counts[k * step] += 1
            tables[tx, ty] = np.minimum(np.floor(np.cumsum(counts) * 255 / len(values) + 0.5), 255)
    out = np.zeros_like(image)
    for y in range(high):
        for x in range(wide):
            fx, fy = (x + 0.5) * tiles / wide - 0.5, (y + 0.5) * tiles / high - 0.5
            lx, ly = int(np.floor(fx)), int(np.floor(fy))
            ax, ay = fx - lx, fy - ly
            at = lambda i, j: tables[min(max(i, 0), tiles - 1), min(max(j, 0), tiles - 1)][image[y, x]]
            top = at(lx, ly) * (1 - ax) + at(lx + 1, ly) * ax
            low = at(lx, ly + 1) * (1 - ax) + at(lx + 1, ly + 1) * ax
            out[y, x] = np.floor(top * (1 - ay) + low * ay + 0.5)
    return out


IMAGES = "image_id int, height int, width int, nChannels int, data binary"


def test_grey_equals_loops(spark):
    rng = np.random.default_rng(3)
    shapes = [(12, 18, 3), (5, 7, 3), (2, 2, 2), (40, 9, 4)]
    planes = [rng.integers(60, 120, s[:2]).astype(np.uint8) for s in shapes]
    for plane, (_, _, tiles) in zip(planes, shapes):
        row = (1, *plane.shape, 1, plane.tobytes())
        got = raster.equalize_images(spark.createDataFrame([row], IMAGES), tiles, 40.0).first()
        want = equalise(plane.astype(int), tiles, 40.0)
        assert np.frombuffer(got.data, np.uint8).reshape(plane.shape).tolist() == want.tolist()


def test_colour_keeps_grey_grey_and_other_rows_as_they_are(spark):
    rng = np.random.default_rng(4)
    plane = rng.integers(60, 120, (20, 30)).astype(np.uint8)
    grey = np.repeat(plane[:, :, None], 3, 2)
    rows = [(1, 20, 30, 3, grey.tobytes()), (2, -1, -1, -1, None), (3, 1, 2, 4, bytes(8))]
    images = spark.createDataFrame(rows, IMAGES)
    got = {r.image_id: r.data for r in raster.equalize_images(images, 3, 40.0).collect()}
    assert got[2] is None and bytes(got[3]) == bytes(8)
    out = np.frombuffer(got[1], np.uint8).reshape(20, 30, 3).astype(int)
    assert (out.max(2) - out.min(2) <= 1).all()
    assert out[:, :, 1].std() > plane.std()


def test_more_tiles_than_pixels():
    plane = np.arange(6, dtype=np.uint8).reshape(2, 3) * 9
    assert raster.equalize_plane(plane, 8, 2.0).shape == (2, 3)
