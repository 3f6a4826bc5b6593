"""Schemas and checked parameters."""

from dataclasses import dataclass

from pyspark.sql import types as T

# The split names, in lookup order, and the name patterns.
SPLITS = ("train", "val", "test")
FILE_NAME_PATTERN = r"^[A-Za-z0-9 ._-]+\z"
CLASS_NAME_PATTERN = r"^[A-Za-z0-9._-]+\z"
MAX_CLASS_NAME = 50
FALLBACK_CLASSES = ("ecoli",)
SOURCE_CLASS = "ecoli"
TARGET_CLASS = "ecoli_cluster"
MOST_EVERY = 30

LABELS = T.StructType(
    [
        T.StructField("split", T.StringType()),
        T.StructField("stem", T.StringType()),
        T.StructField("line_no", T.IntegerType()),
        T.StructField("class_id", T.IntegerType()),
        T.StructField("cx", T.DoubleType()),
        T.StructField("cy", T.DoubleType()),
        T.StructField("w", T.DoubleType()),
        T.StructField("h", T.DoubleType()),
    ]
)

LABEL_BOXES = T.ArrayType(
    T.StructType([f for f in LABELS if f.name in ("class_id", "cx", "cy", "w", "h")])
)

CLASSES = T.StructType(
    [
        T.StructField("class_id", T.IntegerType(), False),
        T.StructField("class_name", T.StringType(), False),
    ]
)


def _require(ok, message):
    if not ok:
        raise ValueError(message)


def require_share(name, value):
    """Check a threshold: above 0, at most 1."""
    _require(0.0 < value <= 1.0, f"{name} is {value}, not above 0 and at most 1")


def require_every(n):
    """Check how many frames share one detection."""
    _require(1 <= n <= MOST_EVERY, f"detection on every {n}-th frame is not in 1 to {MOST_EVERY}")


@dataclass(frozen=True)
class ClusterParams:
    """Settings of the cluster merge."""

    enabled: bool = False
    margin: float = 0.01
    min_size: int = 3
    source_class_name: str = SOURCE_CLASS
    target_class_name: str = TARGET_CLASS


@dataclass(frozen=True)
class DetectorParams:
    """Settings of the detection step."""

    classes: tuple
    imgsz: int = 640
    conf_threshold: float = 0.25
    iou_threshold: float = 0.45

    def __post_init__(self):
        _require(len(self.classes) > 0, "at least one class is needed")
        _require(
            self.imgsz > 0 and self.imgsz % 32 == 0,
            f"the network's input side {self.imgsz} is no positive multiple of 32",
        )
        for name in ("conf_threshold", "iou_threshold"):
            require_share(name, getattr(self, name))
