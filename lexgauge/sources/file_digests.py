"""SHA-256 of large files in bounded memory.

The text reader gives a file's lines in order; a task keeps the running digest
and one Arrow batch.  Two things that the reader does not tell, a byte order
mark at the start and an end behind the last line, follow from the file's size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MARK = b"\xef\xbb\xbf"
#: A file of no more bytes may be a mark alone, which gives no line.
LEAST_BYTES = len(_MARK)
_EXTENSION = ("io.compress.passthrough.extension", "org.apache.hadoop.shaded.io.compress.passthrough.extension")


def _own_bytes(extension: str) -> dict[str, str]:
    """Reader options under which files of this extension are neither decompressed nor
    dealt to several tasks.  Hadoop's client jars read the extension under the second name.
    """
    codec = "org.apache.hadoop.io.compress.PassthroughCodec"
    return {"io.compression.codecs": codec} | dict.fromkeys(_EXTENSION, extension)


def line_digests(extension: str, text: Callable[..., DataFrame]) -> DataFrame:
    """Path, size and SHA-256 of the files with this extension, which ``text`` reads
    under the reader options that it is given.

    A line must fit a task; JSON, often written in one line, is cut at commas.  A file
    whose lines do not add up to its size is an error.
    """
    end_text = "," if extension.lower() == ".json" else "\n"
    line_end = end_text.encode()

    # In here, so that the tasks get it as it is and need not import this package.
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, size, seen, plain, marked = None, 0, 0, None, None

        def row() -> pa.RecordBatch:
            missing = size - (seen - 1)
            if missing not in (0, 1, 3, 4):
                raise ValueError(f"{seen - 1} of {size} bytes of {path} were read")
            found = marked if missing >= 3 else plain
            if missing in (1, 4):
                found.update(line_end)
            return pa.RecordBatch.from_pylist(
                [{"file_path": path, "file_bytes": size, "file_checksum": found.hexdigest()}]
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            # Any bytes, although the reader calls them text.
            line = batch.column("line").cast(pa.large_binary())
            runs = pc.run_end_encode(batch.column("file_path"))
            first = 0
            for own, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                if own != path:
                    if path is not None:
                        yield row()
                    path, size, seen = own, batch.column("file_bytes")[first].as_py(), 0
                    plain, marked = hashlib.sha256(), hashlib.sha256(_MARK)
                lines = line_end.join(line.slice(first, end - first).to_pylist())
                for piece in (line_end if seen else b"", lines):
                    plain.update(piece)
                    marked.update(piece)
                seen += len(lines) + 1
                first = end
        if path is not None:
            yield row()

    rows = text(lineSep=end_text, **_own_bytes(extension)).select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_size").alias("file_bytes"),
        F.col("value").alias("line"),
    )
    return rows.mapInArrow(digests, "file_path string, file_bytes bigint, file_checksum string")
