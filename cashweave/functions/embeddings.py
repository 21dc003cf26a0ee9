"""Hashing text embedder as native column expressions.

A text becomes token -> bucket counts: tokens are ASCII words of two or more
characters, lower-cased; a token's bucket is the first four MD5 bytes read as
a big-endian integer, modulo ``dim``; the vector is the L2-normalised count
vector (all zeros for a text without tokens).

The vector is kept sparse, as parallel arrays of sorted bucket ids and
counts, computed per row with higher-order functions (sort, then run
lengths): no explode, no shuffle, whole texts. Cosine similarity of two such
vectors is ``dot(counts) / (sqrt(sumsq_a) * sqrt(sumsq_b))``: an exact integer
dot product and three correctly rounded operations, so every engine that
follows it gets the same double.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cashweave.functions.text import tokenize
from cashweave.schema import DEFAULT_EMBED_DIM


def token_bucket(token: Column, dim: int = DEFAULT_EMBED_DIM) -> Column:
    """First 4 MD5 bytes, big-endian, modulo ``dim``."""
    if dim <= 0:
        raise ValueError("dim must be positive")
    word = F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long")
    return F.pmod(word, F.lit(dim)).cast("int")


def with_embedding(df: DataFrame, text: str, out: str = "embedding",
                   dim: int = DEFAULT_EMBED_DIM) -> DataFrame:
    """Add ``out`` = struct<idx: array<int>, cnt: array<long>, sumsq: long>.

    Staged as separate projections so the sorted bucket array is computed
    once per row and the run-length lambdas read it as a column (O(tokens)).
    """
    b, n, e = "_emb_b", "_emb_n", "_emb_e"
    staged = df.withColumn(b, F.sort_array(F.transform(tokenize(F.col(text)), lambda t: token_bucket(t, dim)))) \
        .withColumn(n, F.size(b))
    bc, nc = F.col(b), F.col(n)
    staged = staged.withColumn(e, F.when(nc > 0, F.filter(
        F.sequence(F.lit(1), nc),
        lambda i: (i == nc) | (F.element_at(bc, i) != F.element_at(bc, i + 1)),
    )).otherwise(F.array().cast("array<int>")))
    ec = F.col(e)
    idx = F.transform(ec, lambda x: F.element_at(bc, x))
    cnt = F.transform(ec, lambda x, j: (x - F.when(j == 0, F.lit(0)).otherwise(F.element_at(ec, j)))
                      .cast("long"))
    staged = staged.withColumn(out, F.struct(idx.alias("idx"), cnt.alias("cnt")))
    sumsq = F.aggregate(F.col(out)["cnt"], F.lit(0).cast("long"), lambda acc, c: acc + c * c)
    return staged.withColumn(out, F.col(out).withField("sumsq", sumsq)).drop(b, n, e)
