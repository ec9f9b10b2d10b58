"""Silver tables bucketed by a join key: joins and groups on that key read them without a shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from creatorlake.session import new_staging_path

BUCKETS = 64


def save_bucketed(df: DataFrame, name: str, key: str, buckets: int = BUCKETS, path: str | None = None) -> DataFrame:
    """Write ``df`` once, dealt out by ``key`` and sorted by it, and read it back.

    Spark keeps the bucketing in its catalog, so the table gets a name of its own there; the files lie in ``path``, a
    shared folder. Rows are dealt out before the write, so a bucket is one file; a key that holds most rows makes a large
    bucket, and is then better joined unbucketed, where adaptive execution splits it. Tables joined on the key need
    the same number of buckets, or one a multiple of the other."""
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, key)
    dealt.write.option("path", path or new_staging_path(spark, name)).bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    return spark.table(table)
