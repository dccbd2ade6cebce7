"""Text of PDF files (S20), for files whose pages hold their text as literal or hexadecimal strings in plain or deflated streams.

Encrypted files, object streams, fonts with encodings of their own and images of text are not read; such files give the text that is left, or none.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

_STREAM = re.compile(rb"<<(?P<head>(?:[^<>]|<[^<]|>[^>]|<<.*?>>)*?)>>\s*stream\r?\n(?P<body>.*?)\r?\nendstream", re.DOTALL)
_SHOWN = re.compile(rb"\((?P<text>(?:[^()\\]|\\.)*)\)|<(?P<hex>[0-9A-Fa-f\s]*)>|(?P<line>\bT\*|\bTd\b|\bTD\b|'|\bET\b)", re.DOTALL)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|.)", re.DOTALL)
_NAMED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b""}


def _plain(match: re.Match) -> bytes:
    what = match[1]
    return bytes([int(what, 8) & 255]) if what[:1].isdigit() else _NAMED.get(what, what)


def text_of(data: bytes) -> str:
    """The text of a file's content streams, a line for each line that is shown."""
    lines = []
    for stream in _STREAM.finditer(data):
        body = stream["body"]
        if b"FlateDecode" in stream["head"]:
            try:
                body = zlib.decompress(body)
            except zlib.error:
                continue
        for block in re.findall(rb"\bBT\b(.*?\bET\b)", body, re.DOTALL):
            line = b""
            for shown in _SHOWN.finditer(block):
                if shown["line"]:
                    lines += [line] if line else []
                    line = b""
                elif shown["hex"] is not None:
                    digits = re.sub(rb"\s", b"", shown["hex"])
                    line += bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
                else:
                    line += _ESCAPE.sub(_plain, shown["text"])
    return "\n".join(x.decode("cp1252", "replace") for x in lines)


def file_of(lines: list[str], deflate: bool) -> bytes:
    """A file of one page with these lines of text."""
    shown = b"".join(b"(" + re.sub(rb"([\\()])", rb"\\\1", x.encode("cp1252", "replace")) + b") Tj T*\n" for x in lines)
    content = b"BT /F1 10 Tf 40 780 Td 12 TL\n" + shown + b"ET"
    if deflate:
        content = zlib.compress(content)
    head = b"<< /Length %d%s >>" % (len(content), b" /Filter /FlateDecode" if deflate else b"")
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>",
        b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>",
        b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >>",
        head + b"\nstream\n" + content + b"\nendstream",
        b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>",
    ]
    out, places = b"%PDF-1.4\n", []
    for i, x in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n" % i + x + b"\nendobj\n"
    table = b"".join(b"%010d 00000 n \n" % p for p in places)
    return out + b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + table + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, len(out))


def write(rows: DataFrame, key: str, line: str, path: str) -> None:
    """A file ``<key>.pdf`` for each row, its text as one line; every other one deflated. A repeated task writes the same files again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
        store.create_dir(root, recursive=True)
        n = 0
        for batch in batches:
            for k, text in zip(*(c.to_pylist() for c in batch.columns)):
                with store.open_output_stream(f"{root}/{k}.pdf") as f:
                    f.write(file_of([text or ""], k % 2 == 0))
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    rows.select(F.col(key).cast("long"), line).mapInArrow(run, "n long").collect()  # a number a task


def texts(spark: SparkSession, path: str) -> DataFrame:
    """``name, text`` of the files in a folder; files that are no PDF have an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_of(x.as_py()) if x.is_valid else "" for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["name", "text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    return files.select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "content").mapInArrow(run, "name string, text string")
