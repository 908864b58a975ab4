"""One file per document, and one statistics record per document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import blocks as B


def write_texts(rows: DataFrame) -> DataFrame:
    """Writes text to path for each row (path, text), folders made; (path, bytes) of what was written. Written where the rows lie; a task
    run again writes the same files again."""

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            sizes = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if "://" in path:
                    store, at = fs.FileSystem.from_uri(path)
                else:
                    store, at = fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
                store.create_dir(at.rpartition("/")[0], recursive=True)
                data = (text.as_py() or "").encode()
                with store.open_output_stream(at) as out:
                    out.write(data)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["path", "bytes"])

    return rows.select("path", "text").mapInArrow(run, "path string, bytes long")


def stats_files(counted: DataFrame, folder: str) -> DataFrame:
    """path, text of each document's statistics: <stem>.stats.json in folder. counted: input, output, pages, headings, tables, figures,
    footnotes, title, doi."""
    return counted.select(F.concat(F.lit(folder.rstrip("/") + "/"), T.stem(F.col("input")), F.lit(".stats.json")).alias("path"), B.stats_record().alias("text"))
