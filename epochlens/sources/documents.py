"""Documents of any length: pieces of text in order become one file for each document.

A table of pieces (document, section, key, text, glue) is sorted by range, so a long document is spread over many tasks. Each writes the pieces of a document that it has as one fragment, as a
stream; the commit lists the fragments in order. A second job joins the fragments of each document, again as a stream, so no task holds more than a buffer and the rows of one batch.
``glue`` stands between two pieces of one section, whether they are in one fragment or not.

The path is a URI that pyarrow can open on the driver and the executors. What a failed job wrote is not listed in any commit, and its fragments are deleted with the job's folder.
"""

from __future__ import annotations

import json
import uuid
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

PIECES = "document string, section int, text string, glue string"
#: Bytes that are copied at once.
BUFFER = 4 << 20
LIST = "fragments.jsonl"
#: Characters after which a row of ``pack`` ends.
PART = 1 << 20


def piece(document: Column | str, section: int, key: Column | str, text: Column, glue: str | None = None) -> list[Column]:
    """The columns of a table of pieces."""
    as_column = lambda x: F.col(x) if isinstance(x, str) else x
    return [as_column(document).alias("document"), F.lit(section).alias("section"), as_column(key).cast("string").alias("key"), text.alias("text"), F.lit(glue).cast("string").alias("glue")]


def pack(pieces: DataFrame) -> DataFrame:
    """Documents as rows of about ``PART`` characters, or of one piece where that is longer: document, section, key, text; in order of section and key the texts of a document are the whole of it.

    ``pieces``: document, section, key, bound, text. A section is one piece with the key "", and behind it those with other keys in order, with a comma between these. ``bound`` is the beginning of
    the key, and for the first piece that of the least of the others, so that both are in one task, and a task that begins with another piece knows that a comma goes before it.
    """
    dealt = pieces.repartitionByRange("document", "section", "bound").sortWithinPartitions("document", "section", "key", "text")

    def run(batches):
        held, size, begins, opened = [], 0, None, False
        row = lambda: pa.record_batch([pa.array([x], t) for x, t in zip((*begins, "".join(held)), (pa.string(), pa.int32(), pa.string(), pa.string()), strict=True)], ["document", "section", "key", "text"])
        for batch in batches:
            for document, section, key, text in zip(*(batch.column(c).to_pylist() for c in ("document", "section", "key", "text")), strict=True):
                if held and (document != begins[0] or size >= PART):
                    yield row()
                    held, size = [], 0
                if not held:
                    begins = (document, section, key)
                held.append(text if key == "" or opened else f",{text}")
                size += len(held[-1])
                opened = key == ""
        if held:
            yield row()

    return dealt.select("document", "section", "key", "text").mapInArrow(run, "document string, section int, key string, text string")


class _Fragments(WriterCommitMessage):
    def __init__(self, task: int, rows: list[list]) -> None:
        self.task, self.rows = task, rows


class PieceWriter(DataSourceArrowWriter):
    """One fragment for each document that a task has pieces of; pieces come in order."""

    def __init__(self, path: str) -> None:
        self.path, self.job = path, uuid.uuid4().hex

    def write(self, iterator) -> WriterCommitMessage:
        store, base = pafs.FileSystem.from_uri(self.path)
        rows, out, now = [], None, None
        for batch in iterator:
            for document, section, text, glue in zip(*(batch.column(c).to_pylist() for c in ("document", "section", "text", "glue")), strict=True):
                if out is None or document != now[0]:
                    if out is not None:
                        rows.append(self._closed(out, now))
                    name = f"fragments/{self.job}/{uuid.uuid4().hex}"
                    store.create_dir(f"{base}/fragments/{self.job}", recursive=True)
                    out = store.open_output_stream(f"{base}/{name}", buffer_size=BUFFER)
                    now = [document, name, section, section, glue, 0]
                elif section == now[3] and glue:
                    out.write(glue.encode())
                    now[5] += len(glue.encode())
                data = (text or "").encode()
                out.write(data)
                now[3:] = [section, glue, now[5] + len(data)]
        if out is not None:
            rows.append(self._closed(out, now))
        return _Fragments(TaskContext.get().partitionId(), rows)

    def _closed(self, out, row: list) -> list:
        out.close()
        return row

    def commit(self, messages) -> None:
        store, base = pafs.FileSystem.from_uri(self.path)
        store.create_dir(base, recursive=True)
        # A line for each document and task, however long the documents are.
        with store.open_output_stream(f"{base}/{LIST}") as out:
            for m in sorted((m for m in messages if m is not None), key=lambda m: m.task):
                for k, row in enumerate(m.rows):
                    out.write((json.dumps([m.task, k, *row]) + "\n").encode())

    def abort(self, messages) -> None:
        store, base = pafs.FileSystem.from_uri(self.path)
        if store.get_file_info(f"{base}/fragments/{self.job}").type == pafs.FileType.Directory:
            store.delete_dir(f"{base}/fragments/{self.job}")


class Pieces(DataSource):
    """Format ``document_pieces``; option ``path`` names the folder by its URI."""

    @classmethod
    def name(cls) -> str:
        return "document_pieces"

    def schema(self) -> str:
        return PIECES

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return PieceWriter(self.options["path"])


def file_name(document: str | None, suffix: str) -> str:
    return ("_" if document is None else quote(document, safe="")) + suffix


def _copy(store, source: str, out) -> None:
    with store.open_input_stream(source) as f:
        while data := f.read(BUFFER):
            out.write(data)


def write_documents(pieces: DataFrame, path: str, suffix: str = ".json") -> DataFrame:
    """Write each document as one file in ``path``, which must be fresh. Returns document, file, n_bytes, n_fragments of what was written."""
    spark = pieces.sparkSession
    spark.dataSource.register(Pieces)
    order = ["document", "section", "key", "text"]
    # Bounds are sampled from short keys only.
    dealt = pieces.withColumn("bound", F.left("key", F.lit(64))).repartitionByRange("document", "section", "bound").sortWithinPartitions(*order)
    dealt.select("document", "section", "text", "glue").write.format("document_pieces").mode("append").save(path)
    return join_fragments(spark, path, suffix)


def join_fragments(spark: SparkSession, path: str, suffix: str = ".json") -> DataFrame:
    """Join the fragments that a commit lists; a task reads those of its documents one after another."""
    fragments = spark.read.schema("value string").text(f"{path}/{LIST}")
    row = F.from_json("value", "array<string>")
    named = fragments.select(row.alias("r")).select(F.get("r", F.lit(2)).alias("document"), F.get("r", F.lit(0)).cast("long").alias("task"), F.get("r", F.lit(1)).cast("long").alias("k"), *[F.get("r", F.lit(i)).alias(n) for i, n in ((3, "name"), (4, "first"), (5, "last"), (6, "glue"))])
    lists = named.groupBy("document").agg(F.array_sort(F.collect_list(F.struct("task", "k", "name", "first", "last", "glue"))).alias("parts"))

    def run(batches):
        store, base = pafs.FileSystem.from_uri(path)
        for batch in batches:
            done = []
            for document, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name, last, glue = file_name(document, suffix), None, None
                staged = f"{base}/.{uuid.uuid4().hex}"
                with store.open_output_stream(staged, buffer_size=BUFFER) as out:
                    for p in parts:
                        if glue and p["first"] == last:
                            out.write(glue.encode())
                        _copy(store, f"{base}/{p['name']}", out)
                        last, glue = p["last"], p["glue"]
                    size = out.tell()
                store.move(staged, f"{base}/{name}")
                done.append((document, name, size, len(parts)))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done, strict=True) if done else [[]] * 4, (pa.string(), pa.string(), pa.int64(), pa.int32()), strict=True)], ["document", "file", "n_bytes", "n_fragments"])

    joined = lists.repartition("document").mapInArrow(run, "document string, file string, n_bytes long, n_fragments int")
    joined.write.mode("overwrite").parquet(f"{path}/written")
    store, base = pafs.FileSystem.from_uri(path)
    store.delete_dir(f"{base}/fragments") if store.get_file_info(f"{base}/fragments").type == pafs.FileType.Directory else None
    return spark.read.schema(joined.schema).parquet(f"{path}/written")
