"""Arrow IPC files as a source and a sink."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def _files(folder: str) -> list[str]:
    store, root = fs.FileSystem.from_uri(folder)
    found = store.get_file_info(fs.FileSelector(root, recursive=True))
    return sorted(f.path for f in found if f.is_file and f.path.endswith(".arrow"))


def read_arrow(spark: SparkSession, folder: str, schema: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """All `.arrow` files under a folder, one task a file at most; batches go to Spark as they are.

    The schema is the first file's unless given. Unsigned 64-bit columns come as decimals. With `columns`, only these are loaded.
    """
    paths = _files(folder)
    if schema is None:
        if not paths:
            raise FileNotFoundError(folder)
        store, _ = fs.FileSystem.from_uri(folder)
        with store.open_input_file(paths[0]) as f:
            found = pa.ipc.open_file(f).schema
        found = pa.schema([pa.field(x.name, pa.decimal128(20, 0) if x.type == pa.uint64() else x.type, x.nullable) for x in found])
        from pyspark.sql.pandas.types import from_arrow_schema

        schema = from_arrow_schema(found if columns is None else pa.schema([found.field(c) for c in columns]))
    rows = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with store.open_input_file(path) as f:
                    reader = pa.ipc.open_file(f)
                    if columns is not None:
                        fields = sorted(reader.schema.get_field_index(c) for c in columns)
                        reader = pa.ipc.open_file(f, options=pa.ipc.IpcReadOptions(included_fields=fields))
                    for i in range(reader.num_record_batches):
                        got = reader.get_batch(i)
                        names = got.schema.names if columns is None else columns
                        loaded = [got.column(c) for c in names]
                        yield pa.RecordBatch.from_arrays([c.cast(pa.decimal128(20, 0)) if c.type == pa.uint64() else c for c in loaded], names=names)

    return rows.mapInArrow(run, schema)


def write_arrow(frame: DataFrame, folder: str) -> DataFrame:
    """Writes a file `part-N.arrow` for each partition with rows; the files' paths and rows. A task that is run again replaces its file."""
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        path, writer, count = f"{root}/part-{TaskContext.get().partitionId():010d}.arrow", None, 0
        aside = f"{path}.{TaskContext.get().taskAttemptId()}"
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                sink = store.open_output_stream(aside)
                writer = pa.ipc.new_file(sink, batch.schema)
            writer.write_batch(batch)
            count += batch.num_rows
        if writer is not None:
            writer.close()
            sink.close()
            store.move(aside, path)
            yield pa.RecordBatch.from_pydict({"path": [path], "rows": [count]})

    done = frame.mapInArrow(run, "path string, rows long").collect()
    return frame.sparkSession.createDataFrame(done, "path string, rows long")
