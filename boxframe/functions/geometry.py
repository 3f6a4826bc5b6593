"""Box arithmetic as Column expressions; all of it stays in generated code."""

from pyspark.sql import functions as F


def col(c):
    return F.col(c) if isinstance(c, str) else c


def margin_pixels(margin, width, height):
    """A share of the longer image side, in pixels."""
    return F.lit(float(margin)) * F.greatest(col(width), col(height))


def inflate(x1, y1, x2, y2, margin):
    """The four corners grown by `margin` on every side."""
    return col(x1) - margin, col(y1) - margin, col(x2) + margin, col(y2) + margin


def intersects(a, b):
    """Whether two boxes (x1, y1, x2, y2) share a point; touching counts."""
    return (
        (col(a[0]) <= col(b[2]))
        & (col(b[0]) <= col(a[2]))
        & (col(a[1]) <= col(b[3]))
        & (col(b[1]) <= col(a[3]))
    )


def area(x1, y1, x2, y2):
    return (col(x2) - col(x1)) * (col(y2) - col(y1))


def iou(a, b):
    """Shared area over united area; 0 for boxes without area."""
    w = F.least(col(a[2]), col(b[2])) - F.greatest(col(a[0]), col(b[0]))
    h = F.least(col(a[3]), col(b[3])) - F.greatest(col(a[1]), col(b[1]))
    inter = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    union = area(*a) + area(*b) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def normalise(x1, y1, x2, y2, width, height):
    """Pixel corners to a centre and size relative to the image."""
    x1, y1, x2, y2 = col(x1), col(y1), col(x2), col(y2)
    width, height = col(width), col(height)
    return (
        ((x1 + (x2 - x1) / 2) / width).alias("cx"),
        ((y1 + (y2 - y1) / 2) / height).alias("cy"),
        ((x2 - x1) / width).alias("w"),
        ((y2 - y1) / height).alias("h"),
    )


def to_label_boxes(boxes, width="width", height="height"):
    """Adds cx, cy, w, h from x1..y2 and drops boxes without size."""
    return boxes.withColumns(
        dict(
            zip(
                ("cx", "cy", "w", "h"),
                normalise("x1", "y1", "x2", "y2", width, height),
            )
        )
    ).where((F.col("w") > 0) & (F.col("h") > 0))


def to_pixels(cx, cy, w, h, width, height):
    """Relative centre and size to the pixel origin and size."""
    cx, cy, w, h = col(cx), col(cy), col(w), col(h)
    width, height = col(width), col(height)
    return (
        ((cx - w / 2) * width).alias("px"),
        ((cy - h / 2) * height).alias("py"),
        (w * width).alias("pw"),
        (h * height).alias("ph"),
    )


def clip01(c):
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), col(c)))


# Fixed value: the smallest drawn side that is kept.
MIN_DRAG = 0.005


def drag_to_box(drags, x1="x1", y1="y1", x2="x2", y2="y2", min_side=MIN_DRAG):
    """Two dragged points to a label box: clipped, ordered, slips dropped."""
    ax, bx, ay, by = clip01(x1), clip01(x2), clip01(y1), clip01(y2)
    left, top = F.least(ax, bx), F.least(ay, by)
    w, h = F.greatest(ax, bx) - left, F.greatest(ay, by) - top
    return drags.withColumns(
        {"cx": left + w / 2, "cy": top + h / 2, "w": w, "h": h}
    ).where((F.col("w") >= min_side) & (F.col("h") >= min_side))


# Training-set transforms. Each maps label boxes (cx, cy, w, h) to label boxes;
# random choices come from a hash of the image key and a seed, so they repeat.


def chance(seed, *key):
    """A repeatable number in [0, 1) from the key: 20 bits of the MD5 of seed and key."""
    text = F.concat_ws("|", F.lit(str(seed)), *[col(k).cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1, 5), 16, 10).cast("double") / F.lit(float(1 << 20))


def letterbox_boxes(labels, imgsz, width="width", height="height"):
    """Scale the longest side to `imgsz` and pad the other one evenly."""
    longest = F.greatest(col(width), col(height)).cast("double")
    fx, fy = col(width) / longest, col(height) / longest
    size = F.lit(float(imgsz))
    return labels.withColumns(
        {
            "cx": (F.col("cx") * fx * size + (size - fx * size) / 2) / size,
            "cy": (F.col("cy") * fy * size + (size - fy * size) / 2) / size,
            "w": F.col("w") * fx,
            "h": F.col("h") * fy,
        }
    )


def flip_boxes(labels, horizontal, vertical, p=0.5):
    """Mirror each box where the chance column is below `p`."""
    return labels.withColumns(
        {
            "cx": F.when(col(horizontal) < p, 1 - F.col("cx")).otherwise(F.col("cx")),
            "cy": F.when(col(vertical) < p, 1 - F.col("cy")).otherwise(F.col("cy")),
        }
    )


def rotate_boxes(labels, degrees, width="width", height="height"):
    """Turn each box about the image centre and take the upright frame around it.

    The canvas keeps its size, so the new box may reach past the image.
    """
    turn = F.radians(col(degrees))
    cos, sin = F.cos(turn), F.sin(turn)
    wide, high = col(width).cast("double"), col(height).cast("double")
    dx, dy = (F.col("cx") - 0.5) * wide, (F.col("cy") - 0.5) * high
    half_w, half_h = F.col("w") * wide / 2, F.col("h") * high / 2
    reach_x = F.abs(half_w * cos) + F.abs(half_h * sin)
    reach_y = F.abs(half_w * sin) + F.abs(half_h * cos)
    return labels.withColumns(
        {
            "cx": (dx * cos - dy * sin) / wide + 0.5,
            "cy": (dx * sin + dy * cos) / high + 0.5,
            "w": reach_x * 2 / wide,
            "h": reach_y * 2 / high,
        }
    )


def random_angle(chance_apply, chance_angle, limit=180.0, p=0.8):
    """An angle in [-limit, limit) where the first chance is below `p`, else 0."""
    angle = (col(chance_angle) * 2 - 1) * float(limit)
    return F.when(col(chance_apply) < p, angle).otherwise(F.lit(0.0))


def visible_boxes(labels, min_visibility=0.3):
    """Clip boxes to the image and drop those whose visible share is too small.

    The box is handled as a one-element array, so the condition is tested on its
    values instead of being spelled out again from all earlier transforms.
    """
    cx, cy, w, h = (F.col(c) for c in ("cx", "cy", "w", "h"))
    box = F.struct(
        clip01(cx - w / 2).alias("l"),
        clip01(cx + w / 2).alias("r"),
        clip01(cy - h / 2).alias("t"),
        clip01(cy + h / 2).alias("b"),
        (w * h).alias("area"),
    )

    def seen(v):
        share = (v["r"] - v["l"]) * (v["b"] - v["t"]) / v["area"]
        return (share >= min_visibility) & (v["r"] > v["l"]) & (v["b"] > v["t"])

    return (
        labels.withColumn("_v", F.explode(F.filter(F.array(box), seen)))
        .withColumns(
            {
                "cx": (F.col("_v.l") + F.col("_v.r")) / 2,
                "cy": (F.col("_v.t") + F.col("_v.b")) / 2,
                "w": F.col("_v.r") - F.col("_v.l"),
                "h": F.col("_v.b") - F.col("_v.t"),
            }
        )
        .drop("_v")
    )
