"""Writing tables. Empty tables leave nothing behind; errors raise."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from creatorlake.operators.summaries import metadata_row, summary_long


def csv_ready(df: DataFrame, python_words: bool = False) -> DataFrame:
    """Nested and VARIANT columns as JSON text; optionally booleans as True and False."""
    columns = []
    for name, dtype in df.dtypes:
        if dtype.startswith(("array", "map", "struct", "variant")):
            columns.append(F.to_json(name).alias(name))
        elif dtype == "boolean" and python_words:
            columns.append(F.when(F.col(name), "True").when(~F.col(name), "False").alias(name))
        else:
            columns.append(F.col(name))
    return df.select(*columns)


def _writer(df: DataFrame, fmt: str, mode: str):
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        # Null and empty text both come out blank; quotes are doubled, as CSV readers expect.
        writer = writer.options(header=True, emptyValue="", nullValue="", escape='"',
                                timestampNTZFormat="yyyy-MM-dd HH:mm:ss[.SSSSSS]")
    return writer


def write_tables(
    tables: dict[str, DataFrame], root: str, run_id: str, fmt: str = "parquet", mode: str = "errorifexists",
    python_words: bool = False,
) -> dict[str, str]:
    """One folder per table and run, ``root/table/run_id=...``. Returns the folders written."""
    return {name: path for name, (path, rows) in _write_counted(tables, root, run_id, fmt, mode, python_words).items() if rows}


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def exists(spark: SparkSession, path: str) -> bool:
    store, folder = _folder(spark, path)
    return store.exists(folder)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Paths of the data files in a folder; none if there is no such folder."""
    store, folder = _folder(spark, path)
    if not store.exists(folder):
        return []
    names = [s.getPath().getName() for s in store.listStatus(folder)]
    return [f"{path}/{name}" for name in names if not name.startswith(("_", "."))]


def delete(spark: SparkSession, path: str) -> None:
    store, folder = _folder(spark, path)
    store.delete(folder, True)


def _write_counted(tables, root, run_id, fmt, mode, python_words=False) -> dict[str, tuple[str, int]]:
    """Folder and row count per table. Each table is computed once: rows are counted as they are written, and
    the folder of an empty one is removed again, unless an append found it there with earlier rows."""
    written = {}
    for name, df in tables.items():
        path, seen = f"{root}/{name}/run_id={run_id}", Observation()
        before = mode == "append" and exists(df.sparkSession, path)
        counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
        _writer(csv_ready(counted, python_words) if fmt == "csv" else counted, fmt, mode).save(path)
        rows = seen.get["rows"]
        if not rows and not before:
            delete(df.sparkSession, path)
        written[name] = (path, rows)
    return written


def export_csv(flat: dict[str, DataFrame], summary: DataFrame, root: str, run_id: str, run_ts) -> dict[str, str]:
    """CSV export of the flat tables with their summary and a metadata row."""
    counted = _write_counted({**flat, "summary": summary_long(summary)}, root, run_id, "csv", "errorifexists")
    written = {name: path for name, (path, rows) in counted.items() if rows}
    counts = {name: rows for name, (_, rows) in counted.items() if name != "summary"}
    metadata = metadata_row(summary.sparkSession, counts, run_ts, len(written))
    return written | write_tables({"metadata": metadata}, root, run_id, "csv")


def export_json(tables: dict[str, DataFrame], root: str, run_id: str) -> dict[str, str]:
    """JSON Lines, one folder per table; ``read_json_lines`` reads them back in parallel."""
    return write_tables(tables, root, run_id, "json")
