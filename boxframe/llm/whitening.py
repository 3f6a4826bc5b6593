"""Whitening of embeddings with distributed block matrices.

Entries become integers (256 times the entry, rounded down), and every distinct
vector counts once. Distinct vectors get numbers without gaps, are centred and go
into a `BlockMatrix`, blocks of about `BLOCK_BYTES`. Its transpose times itself is the
scatter matrix; the eigenvectors of that small matrix, over the roots of their
eigenvalues, are the whitening matrix, and the centred blocks times it are the
whitened rows. Vectors stay in the JVM all the way.

A block matrix counts rows in 32 bits, so beyond `PANEL` vectors there are several,
whose scatter matrices add up. Only matrices as large as the vectors are long, and
sums per dimension, reach the driver.

Defined results: a vector that is null or holds null or non-finite entries is left
out; shorter vectors are read as if zeros followed, an empty one as zeros; entries
beyond 64 bits are held at the limit; a deviation that does not fit 64 bits is null;
components without variance (to rounding) do not exist, so equal vectors, one vector
or none give no rows; every row gives its own, also with a null or repeated id; other
columns are ignored. Vectors of more than `MOST_DIMENSIONS` entries are refused.
"""

from functools import reduce

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.groups import durable, skew_join
from .tables import table

COMPONENTS = 4
SCALE = 256
BLOCK_BYTES = 4 << 20
BLOCK_COLUMNS = 1024
PANEL = 1 << 28
# Groups in which the products of a scatter matrix are added up.
MOST_GROUPS = 4096
MOST_DIMENSIONS = 8192


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, x (integers) and key, equal for vectors equal but for zeros at the end."""
    faulty = F.exists(
        "embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    )
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE))
    key = F.regexp_replace(F.array_join("x", ","), r"^0(?:,0)*+$|(?:,0)++$", "")
    rows = vectors.where(~faulty).select("vec_id", x.alias("x"))
    return rows.withColumn("key", F.md5(key.cast("binary")))


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """Each distinct x once: key, x and index, from 0 without gaps.

    The place in a written part is known; the parts before it shift it.
    """
    once = rows.groupBy("key").agg(F.first("x").alias("x"))
    placed = durable(once.withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    place = F.col("_id") - F.shiftleft(part, 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        placed.groupBy(part.alias("_part"))
        .agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    )
    return placed.join(F.broadcast(shift), part == F.col("_part")).select(
        "key", "x", (place + F.col("_shift")).alias("index")
    )


def _sums(distinct: DataFrame) -> list[int]:
    """Exact sums per dimension; their number is that of the longest vector's entries."""
    longest = distinct.agg(F.max(F.size("x"))).first()[0] or 0
    if longest > MOST_DIMENSIONS:
        raise ValueError(f"vectors of more than {MOST_DIMENSIONS} entries")
    rows = distinct.select(F.posexplode("x").alias("at", "x"))
    sums = rows.groupBy("at").agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("s")).collect()
    found = {r["at"]: int(r["s"]) for r in sums}
    return [found[i] for i in range(longest)]


def _padded(size):
    none = F.expr("cast(array() as array<bigint>)")
    missing = F.greatest(F.lit(size) - F.size("x"), F.lit(0))
    return F.concat("x", F.when(missing > 0, F.array_repeat(F.lit(0).cast("long"), missing)).otherwise(none))


def _block_matrix(rows: DataFrame, n: int, size: int) -> BlockMatrix:
    """Rows (index, vector) as blocks; they pass from DataFrame to matrix in the JVM."""
    rows = MLUtils.convertVectorColumnsFromML(rows, "vector")
    matrix = IndexedRowMatrix(callMLlibFunc("createIndexedRowMatrix", rows, n, size))
    columns = min(size, BLOCK_COLUMNS)
    return matrix.toBlockMatrix(max(1, BLOCK_BYTES // (8 * columns)), columns)


def centred_blocks(distinct: DataFrame, n: int, sums: list[int]) -> list[BlockMatrix]:
    """The centred vectors as block matrices of at most `PANEL` rows."""
    size = len(sums)
    mean = F.array(*[F.lit(s / n) for s in sums])
    centred = F.zip_with(_padded(size), mean, lambda x, m: x - m)
    rows = distinct.select("index", array_to_vector(centred).alias("vector"))
    out = []
    for low in range(0, n, PANEL):
        some = rows.where(F.col("index").between(low, low + PANEL - 1))
        some = some.select((F.col("index") - low).alias("index"), "vector")
        out.append(_block_matrix(some, min(PANEL, n - low), size))
    return out


def scatter(blocks: BlockMatrix) -> np.ndarray:
    """Transpose times itself. Each group of row blocks is multiplied in a task of its
    own; Python's multiply lacks the number of groups, so the JVM's is called."""
    groups = min(blocks.numRowBlocks, MOST_GROUPS)
    left = blocks.transpose()._java_matrix_wrapper._java_model
    right = blocks._java_matrix_wrapper._java_model
    product = BlockMatrix(left.multiply(right, groups), blocks.colsPerBlock, blocks.colsPerBlock)
    return product.toLocalMatrix().toArray()


def whitening_matrix(covariance: np.ndarray, most=COMPONENTS):
    """Columns of eigenvectors over roots of eigenvalues, and the explained shares."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    real = values > max(values[0], 0) * len(values) * np.finfo(float).eps
    k = min(most, int(real.sum()))
    return vectors[:, :k] / np.sqrt(values[:k]), values[:k] / np.trace(covariance)


def _projected(blocks: BlockMatrix, matrix: np.ndarray, low: int) -> DataFrame:
    """The rows of a block matrix times a small one: index, z."""
    step, k = blocks.colsPerBlock, matrix.shape[1]
    pieces = [
        ((i // step, 0), Matrices.dense(len(matrix[i : i + step]), k, matrix[i : i + step].ravel("F")))
        for i in range(0, len(matrix), step)
    ]
    sc = blocks.blocks.context
    right = BlockMatrix(sc.parallelize(pieces, 1), step, k)
    rows = blocks.multiply(right).toIndexedRowMatrix()
    found = callMLlibFunc("getIndexedRows", rows._java_matrix_wrapper._java_model)
    return found.select(
        (F.col("index") + low).alias("index"), vector_to_array("vector").alias("z")
    )


def _identity_error(z: DataFrame, k: int) -> float:
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    covariances = z.agg(
        *[F.covar_pop(F.get("z", F.lit(i)), F.get("z", F.lit(j))).alias(f"{i}_{j}") for i, j in pairs]
    ).first()
    return max(abs(c - (i == j)) for c, (i, j) in zip(covariances, pairs, strict=True))


WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(vectors: DataFrame, components=COMPONENTS) -> DataFrame:
    """Per usable row and component: vec_id, component, n, deviation, whitened,
    explained, identity_error."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    rows = durable(whole_vectors(rows))
    distinct = durable(distinct_vectors(rows))
    n, sums = distinct.count(), _sums(distinct)
    panels = centred_blocks(distinct, n, sums) if n and sums else []
    matrix, shares = np.zeros((0, 0)), []
    if panels:
        matrix, shares = whitening_matrix(sum(scatter(p) for p in panels) / n, components)
    if not len(shares):
        return vectors.sparkSession.createDataFrame([], WHITENED)
    parts = [_projected(p, matrix, i * PANEL) for i, p in enumerate(panels)]
    z = durable(reduce(DataFrame.unionByName, parts))
    error = _identity_error(z, len(shares))
    off = [F.lit(s) if -(1 << 63) <= s < 1 << 63 else F.lit(None).cast("long") for s in sums]
    apart = F.zip_with(
        _padded(len(sums)), F.array(*off), lambda x, s: F.try_subtract(F.try_multiply(F.lit(n).cast("long"), x), s)
    )
    squares = F.transform(apart, lambda a: F.try_multiply(a, a))
    deviation = F.aggregate(squares, F.lit(0).cast("long"), F.try_add)
    judged = distinct.join(z.hint("merge"), "index").select("key", deviation.alias("deviation"), "z")
    explained = F.array(*[F.lit(float(s)) for s in shares])
    return (
        skew_join(rows.select("vec_id", "key"), durable(judged), ["key"])
        .select("vec_id", "deviation", F.posexplode("z").alias("at", "whitened"))
        .select(
            "vec_id",
            (F.col("at") + 1).cast("int").alias("component"),
            F.lit(n).cast("long").alias("n"),
            "deviation",
            "whitened",
            F.get(explained, F.col("at")).alias("explained"),
            F.lit(float(error)).alias("identity_error"),
        )
    )


def op12_whitening(spark, sf_dir):
    """All embeddings projected on their four widest directions, to unit variance."""
    return whitened(table(spark, sf_dir, "embeddings"))


QUERIES = {"op12_whitening": op12_whitening}
