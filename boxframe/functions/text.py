"""Names, labels and other text as Column expressions."""

from pyspark.sql import functions as F

from ..schema import FILE_NAME_PATTERN, SPLITS
from .geometry import col

# The eight colours by class id modulo 8, as drawn on frames
# (blue, green, red) and as shown on the web.
PALETTE_BGR = (
    (0, 255, 0),
    (255, 128, 0),
    (0, 0, 255),
    (255, 255, 0),
    (255, 0, 255),
    (0, 255, 255),
    (255, 255, 255),
    (128, 0, 255),
)
PALETTE_HEX = (
    "#00ff00",
    "#0080ff",
    "#ff0040",
    "#ffff00",
    "#ff00ff",
    "#00ffff",
    "#ffffff",
    "#ff0080",
)
# Fixed value: terminal control sequences.
ESCAPES = r"\x1b\[[0-9;?]*[A-Za-z]"


def valid_split(split):
    return F.coalesce(col(split).isin(*SPLITS), F.lit(False))


def wanted_split(split, wanted=None):
    """Rows of one split; no name means all, an unknown name means none."""
    return valid_split(split) & (col(split) == wanted if wanted else F.lit(True))


def require_split(split):
    """Check a split name given by the caller."""
    if split not in SPLITS:
        raise ValueError(f"no such split: {split!r} (there are {', '.join(SPLITS)})")
    return split


def valid_file_name(name):
    return F.coalesce(col(name).rlike(FILE_NAME_PATTERN), F.lit(False))


def suffix(name):
    """The last extension with its dot; a leading dot starts no extension."""
    return F.regexp_extract(col(name), r"(?s)^.+(\.[^.]+)\z", 1)


def stem(name):
    """The name without its last extension."""
    name = col(name)
    return F.substring(name, F.lit(1), F.length(name) - F.length(suffix(name)))


def png_name(name):
    return F.concat(stem(name), F.lit(".png"))


def default_name(ts):
    """Name for an image that arrives without one, from its arrival time."""
    return F.concat(F.lit("img_"), F.unix_millis(col(ts).cast("timestamp")), F.lit(".png"))


def entry_url(split, name):
    return F.concat(F.lit("/api/dataset/image/"), col(split), F.lit("/"), col(name))


def class_colour(class_id):
    """Web colour of a class."""
    names = F.array(*[F.lit(c) for c in PALETTE_HEX])
    return F.get(names, F.pmod(col(class_id), F.lit(len(PALETTE_HEX))))


def class_colour_bgr(class_id):
    """Blue, green and red of a class as drawn on frames."""
    rows = F.array(*[F.array(*[F.lit(v) for v in c]) for c in PALETTE_BGR])
    return F.get(rows, F.pmod(col(class_id), F.lit(len(PALETTE_BGR))))


def class_or_fallback(name, class_id):
    return F.coalesce(col(name), F.concat(F.lit("cls_"), col(class_id)))


def fixed_places(number, places):
    """A number with so many decimals, rounded as Python does, without grouping."""
    return F.replace(F.format_number(number, places), F.lit(","), F.lit(""))


def frame_label(name, confidence):
    """`name 0.87`, as drawn on frames."""
    return F.concat(col(name), F.lit(" "), fixed_places(col(confidence), 2))


def percent_label(name, confidence):
    """`name 87%`, halves rounded up."""
    whole = F.floor(col(confidence) * 100 + 0.5)
    return F.concat(col(name), F.lit(" "), whole, F.lit("%"))


def percent_text(confidence):
    """`87.3%`, halves rounded up.

    A number of this kind lies exactly between two tenths only at .25 and .75;
    fixed_places rounds to the even digit there, so .25 is moved up first.
    """
    value = col(confidence) * 100
    tie = (value - F.floor(value)) == 0.25
    return F.concat(
        fixed_places(F.when(tie, value + 0.04).otherwise(value), 1), F.lit("%")
    )


def source_kind(source):
    """`device` for a whole number, otherwise `path`."""
    return F.when(col(source).try_cast("int").isNotNull(), "device").otherwise("path")


def elapsed_text(seconds):
    """`1h 2m`, `3m 4s` or `5s`."""
    s = col(seconds).cast("bigint")
    hours, minutes, rest = F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60
    return (
        F.when(hours > 0, F.concat(hours, F.lit("h "), minutes, F.lit("m")))
        .when(minutes > 0, F.concat(minutes, F.lit("m "), rest, F.lit("s")))
        .otherwise(F.concat(rest, F.lit("s")))
    )


def clean_line(line):
    """A log line without terminal control sequences and line ends."""
    return F.regexp_replace(F.regexp_replace(col(line), ESCAPES, ""), r"[\r\n]+\z", "")


def label_line(class_id, cx, cy, w, h):
    """One line of a label file; six decimals, rounded as Python rounds them."""
    numbers = [fixed_places(col(c), 6) for c in (cx, cy, w, h)]
    return F.concat_ws(" ", col(class_id).cast("string"), *numbers)
