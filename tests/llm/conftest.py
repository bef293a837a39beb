from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))]
)
# Names that the operators use inside.
CLASHING = ["row", "key", "chunk", "fp", "number", "copies", "fold", "toxicity", "size", "bucket", "block", "rank", "shard", "host"]


@pytest.fixture
def documents(spark):
    """Documents of (doc_id, text[, source]) tuples, with further columns of clashing names on request."""

    def make(rows, clashing=False):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if clashing:
            from pyspark.sql import functions as F

            df = df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])
        return df

    return make


@pytest.fixture(scope="session")
def small_dir(tmp_path_factory):
    """Folder with small copies of the tables the queries read."""
    import os

    import duckdb

    folder = str(tmp_path_factory.mktemp("small"))
    source = "/root/testdata/sf0.001"
    if not os.path.isdir(source):
        pytest.skip("test tables are not there")
    for name in ("documents", "labels", "pages", "embeddings"):
        duckdb.sql(f"copy (from '{source}/{name}.parquet') to '{folder}/{name}.parquet' (format parquet)")
    return folder
