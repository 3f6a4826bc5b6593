"""The class vocabulary: ordered names, the id being the position."""

import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import class_or_fallback
from ..schema import CLASS_NAME_PATTERN, CLASSES, FALLBACK_CLASSES, MAX_CLASS_NAME
from .groups import number_rows

# Most classes sent to every executor; a larger vocabulary is joined by shuffle.
BROADCAST_CLASSES = 100_000


def _in_order(names):
    """Class names of a mapping, by rising key, or of a list."""
    pairs = names.items() if isinstance(names, dict) else enumerate(names)
    return [str(name) for _, name in sorted(pairs, key=lambda pair: pair[0])]


def vocabulary(spark, names):
    """Classes from a mapping or a list of names."""
    return spark.createDataFrame(list(enumerate(_in_order(names))), CLASSES)


def names_of(manifest: str | None):
    """Class names in manifest text; one fallback class where it names none, is no
    manifest, or has keys that cannot be put in order."""
    try:
        found = yaml.safe_load(manifest or "")
        found = found.get("names", {}) if isinstance(found, dict) else None
        usable = isinstance(found, (dict, list))
        return _in_order(found) if usable else list(FALLBACK_CLASSES)
    except (yaml.YAMLError, TypeError):
        return list(FALLBACK_CLASSES)


def densify(keyed: DataFrame) -> DataFrame:
    """Classes from rows of (key, class_name): ids are the ranks of the keys."""
    numbered = number_rows(keyed.withColumn("_all", F.lit(0)), ["_all"], "key", "_n")
    return numbered.select((F.col("_n") - 1).cast("int").alias("class_id"), "class_name")


def small_side(classes):
    """The vocabulary, marked for broadcast if its size allows."""
    few = classes.limit(BROADCAST_CLASSES + 1).count() <= BROADCAST_CLASSES
    return F.broadcast(classes) if few else classes


def name_classes(rows, classes):
    """Adds class_name by class_id; an unknown id becomes `cls_<id>`."""
    named = rows.drop("class_name").join(small_side(classes), "class_id", "left")
    return named.withColumn("class_name", class_or_fallback("class_name", "class_id"))


def class_count(classes):
    return classes.agg(F.count("*").alias("classes"))


def class_of_name(classes, name):
    return classes.where(F.col("class_name") == name)


def by_id(classes):
    return classes.orderBy("class_id")


def resolve_names(pairs, classes):
    """Ids for (source_name, target_name); first position wins for equal names.

    An unknown source gives null (nothing to merge); an unknown target gives the
    number of classes.
    """
    ids = classes.groupBy("class_name").agg(F.min("class_id").alias("id"))
    total = classes.agg(F.count("*").cast("int").alias("_total"))
    source = small_side(ids.select(F.col("class_name").alias("source_name"), F.col("id").alias("source_id")))
    target = small_side(ids.select(F.col("class_name").alias("target_name"), F.col("id").alias("_target")))
    total_row = total.withColumn("_one", F.lit(1))
    return (
        pairs.withColumn("_one", F.lit(1))
        .join(source, "source_name", "left")
        .join(target, "target_name", "left")
        .join(F.broadcast(total_row), "_one")
        .withColumn("target_id", F.coalesce("_target", "_total"))
        .drop("_one", "_target", "_total")
    )


def check_new_classes(classes, names):
    """New names (ord, name) with `fault`: empty, characters, length, duplicate."""
    trimmed = names.withColumn("name", F.regexp_replace("name", r"^\s+|\s+$", ""))
    first = trimmed.groupBy("name").agg(F.min("ord").alias("_first"))
    known = small_side(classes.select(F.col("class_name").alias("name")).distinct()).withColumn(
        "_known", F.lit(True)
    )
    joined = trimmed.join(first, "name").join(known, "name", "left")
    fault = (
        F.when(F.col("name") == "", "empty")
        .when(~F.col("name").rlike(CLASS_NAME_PATTERN), "characters")
        .when(F.length("name") > MAX_CLASS_NAME, "length")
        .when(F.col("_known").isNotNull() | (F.col("ord") > F.col("_first")), "duplicate")
    )
    return joined.withColumn("fault", fault).drop("_first", "_known")


def add_classes(classes, names):
    """(vocabulary with the new names at its end, rejected names)."""
    checked = check_new_classes(classes, names)
    good = checked.where("fault is null").withColumn("_all", F.lit(0))
    total = classes.agg(F.count("*").alias("_total")).withColumn("_all", F.lit(0))
    new = number_rows(good, ["_all"], "ord", "_n").join(F.broadcast(total), "_all")
    new = new.select(
        (F.col("_total") + F.col("_n") - 1).cast("int").alias("class_id"),
        F.col("name").alias("class_name"),
    )
    return classes.unionByName(new), checked.where("fault is not null").select(
        "ord", "name", "fault"
    )
