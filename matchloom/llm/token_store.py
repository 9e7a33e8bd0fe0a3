"""Token ids as Parquet list columns.

Documents are ranged by id, encoded where they land and written one file a range, with row groups of a set number of
tokens, page indexes, and dictionary or delta encoding of the ids. Ids, counts and places can then be read alone, and a range
of documents touches only its row groups and pages.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm.common import _filesystem, documents, fresh_dir, small_batches, small_table, tidy

#: Tokens of a row group and bytes of a data page.
GROUP_TOKENS, PAGE_BYTES = 1 << 20, 1 << 16


def write_tokens(docs: DataFrame, vocabulary: str, path: str, end_id: int = 2, encoding: str = "dictionary", group_tokens: int = GROUP_TOKENS, page_bytes: int = PAGE_BYTES) -> list[dict]:
    """Writes files of (doc_id, start, n_tokens, ids) in ascending doc_id order under path, and returns their list in that order: file, docs, tokens, base.

    start counts from the file's first token; base is what all files before it hold. There is one entry for each file, so the list grows with
    the partitions and not with the rows. An attempt of a task that is lost leaves a file that no list names. A null text is empty; a null doc_id
    comes first; rows that repeat are kept, ordered by text; an empty table gives an empty list."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.parquet as pq

        from matchloom.llm.tokens import Encoder

        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.field("element", pa.int32(), nullable=False)))])
        encoder, end = Encoder.of(vocabulary), np.array([end_id], "<u4").tobytes()
        kind = {"use_dictionary": ["ids.list.element"]} if encoding == "dictionary" else {"use_dictionary": False, "column_encoding": {"ids.list.element": "DELTA_BINARY_PACKED"}}
        files, root = _filesystem(path)
        files.create_dir(root, recursive=True)
        name, writer, start, low, n = f"{uuid.uuid4().hex}.parquet", None, 0, None, 0
        held: list[tuple] = []
        size = 0

        def flush() -> None:
            nonlocal writer, held, size
            if not held:
                return
            if writer is None:
                writer = pq.ParquetWriter(f"{root}/{name}", schema, filesystem=files, compression="zstd", write_page_index=True, data_page_size=page_bytes, **kind)
            ids = np.frombuffer(b"".join(x[2] for x in held), "<i4")
            counts = np.array([len(x[2]) // 4 for x in held], np.int64)
            ends = np.concatenate([[0], np.cumsum(counts)])
            columns = [pa.array([x[0] for x in held], pa.int64()), pa.array([x[1] for x in held], pa.int64()), pa.array(counts), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids), type=schema.field("ids").type)]
            writer.write_table(pa.Table.from_arrays(columns, schema=schema), row_group_size=len(held))
            held, size = [], 0

        for batch in batches:
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), encoder.encode(batch["text"].to_pylist())):
                ids += end
                low = doc_id if n == 0 else low
                held.append((doc_id, start, ids))
                start, n, size = start + len(ids) // 4, n + 1, size + len(ids) // 4
                if size >= group_tokens:
                    flush()
        flush()
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "low": pa.array([low], pa.int64()), "docs": [n], "tokens": [start]})

    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows = sorted(ranged.mapInArrow(tidy(run), "file string, low long, docs long, tokens long").collect(), key=lambda r: (r["low"] is not None, r["low"] or 0))  # one row a file
    out, base = [], 0
    for r in rows:
        out.append({"file": r["file"], "docs": r["docs"], "tokens": r["tokens"], "base": base})
        base += r["tokens"]
    return out


def read_digests(spark: SparkSession, path: str, files: list[dict]) -> DataFrame:
    """Each document's place, count and crc32 of its ids, from the files row group by row group."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.parquet as pq

        filesystem, root = _filesystem(path)
        for batch in batches:
            for row in batch.to_pylist():
                with filesystem.open_input_file(f"{root}/{row['file']}") as source:
                    stored = pq.ParquetFile(source)
                    for group in range(stored.num_row_groups):
                        table = stored.read_row_group(group)
                        lists = table["ids"].combine_chunks()
                        flat = np.ascontiguousarray(lists.flatten().to_numpy(), "<u4").tobytes()
                        ends = 4 * np.concatenate([[0], np.cumsum(table["n_tokens"].to_numpy())])
                        crc = [zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                        start = table["start"].to_numpy() + row["base"]
                        yield pa.RecordBatch.from_arrays([table["doc_id"].combine_chunks(), pa.array(start), table["n_tokens"].combine_chunks(), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    listed = small_table(spark, files, "file string, base long").repartition(max(1, len(files)))
    return listed.mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_tokens(spark: SparkSession, path: str, files: list[dict], low: int | None = None, high: int | None = None, ids: bool = True) -> DataFrame:
    """Documents low to high, with or without their ids: row-group statistics and page indexes skip the rest."""
    schema = "doc_id long, start long, n_tokens long, ids array<int>"
    stored = spark.read.schema(schema).parquet(*[f"{path}/{f['file']}" for f in files]) if files else spark.createDataFrame([], schema)
    for found, bound in ((lambda c, b: c >= b, low), (lambda c, b: c <= b, high)):
        stored = stored if bound is None else stored.filter(found(F.col("doc_id"), bound))
    return stored if ids else stored.drop("ids")


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = fresh_dir(spark, "tokens")
    files = write_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), path)
    return read_digests(spark, path, files)
