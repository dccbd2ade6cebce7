"""WARC archives with revisits, and their index by an external merge of sorted capture runs.

Tasks write their records to archive files in the shared folder, one gzip
member a record, and sort their captures by URL key and time into runs. Loser
trees merge a bounded number of runs at once: as long as there are more, groups
of them become longer runs, and a last merge gives the capture histories in
global order. A task takes one key range of its runs and opens only those files
whose keys meet it. Reading back goes by the index:
every record is fetched at its place and checked against its digest.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from itertools import islice
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from papyrine.shared import keep, new_path

#: Payloads with fewer bytes are always written whole.
REVISIT_BYTES = 1000
#: Bytes of an archive file after which a task begins the next one, and captures of a run.
ARCHIVE_BYTES, RUN_ROWS = 1 << 30, 200_000
#: Captures aimed at in one key range of a merge, runs that one merge takes, rows of a run's row group.
RANGE_ROWS, FAN_IN, GROUP_ROWS = 250_000, 64, 1_024
#: Captures for each key that a run gives to the choice of ranges.
SAMPLE_STEP = 4_096
START = datetime(2024, 1, 1, tzinfo=timezone.utc)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CAPTURE = "urlkey string, ts string, page_id long, archive string, offset long, size long"


def filesystem(uri: str):
    """A pyarrow file system and the path in it, for a URI of a folder that all executors reach."""
    from pyarrow import fs

    uri = re.sub(r"^file:/+", "file:///", uri)
    return fs.FileSystem.from_uri(uri)


def url_key(url: str | None) -> str:
    """The sort-friendly key of a URL: host reversed by commas, then path and query; lower case, no fragment."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return (url or "").strip().lower()
    key = ",".join(reversed(host.split(".")))
    if port and (parts.scheme, port) not in (("http", 80), ("https", 443)):
        key += f":{port}"
    path = parts.path or "/"
    return (key + ")" + path + ("?" + parts.query if parts.query else "")).lower()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC record, as a gzip member of its own."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(head.encode("utf-8") + block + b"\r\n\r\n") + packer.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record's gzip member."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    if len(block) != int(headers["content-length"]):
        raise ValueError("the record is cut off")
    return headers, block


def _clean(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]+", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "")


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> tuple[bytes, str]:
    """The record of a page and its time; a revisit carries the HTTP header only."""
    when = (START + timedelta(seconds=(page_id or 0) % (1 << 31))).strftime("%Y-%m-%dT%H:%M:%SZ")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Date", when), ("WARC-Target-URI", _clean(url)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    return record(headers, http + (payload if refers_to is None else b"")), when


#: A run's file: the sequence that it is part of and its place there, its name, rows, first and last key, and some keys.
RUN = "sequence long, place int, run string, rows long, low array<string>, high array<string>, sample array<array<string>>"
_KEYS = pa.list_(pa.string())
_RUN = pa.schema([("sequence", pa.int64()), ("place", pa.int32()), ("run", pa.string()), ("rows", pa.int64()), ("low", _KEYS), ("high", _KEYS), ("sample", pa.list_(_KEYS))])
_CAPTURE = pa.schema([("urlkey", pa.string()), ("ts", pa.string()), ("page_id", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("size", pa.int64())])


def _columns(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * len(_CAPTURE), _CAPTURE)]


class _RunFile:
    """Writes sorted captures to a run's file a row group at a time."""

    def __init__(self, store, root: str, name: str):
        import pyarrow.parquet as pq

        self.name, self.rows, self.low, self.high, self.sample, self.held = name, 0, None, None, [], []
        self.out = store.open_output_stream(f"{root}/{name}")
        self.writer = pq.ParquetWriter(self.out, _CAPTURE)

    def add(self, capture: tuple) -> None:
        key = list(capture[:2])
        if not self.rows % SAMPLE_STEP:
            self.sample.append(key)
        self.low, self.high = self.low or key, key
        self.rows += 1
        self.held.append(capture)
        if len(self.held) >= GROUP_ROWS:
            self._flush()

    def _flush(self) -> None:
        if self.held:
            self.writer.write_table(pa.Table.from_arrays(_columns(self.held), schema=_CAPTURE))
            self.held.clear()

    def close(self, sequence: int, place: int) -> pa.RecordBatch:
        self._flush()
        self.writer.close()
        self.out.close()
        row = (sequence, place, self.name, self.rows, self.low, self.high, self.sample)
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _RUN)], schema=_RUN)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write rows ``page_id, url, html, digest, size, refers_to``; return the sorted runs, as rows of :data:`RUN`.

    A task writes under names of its own attempt, so that a repeated task
    leaves complete files and the returned rows name those of one attempt.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        name = f"{context.partitionId():06d}-{context.taskAttemptId()}"
        store, root = filesystem(folder)
        store.create_dir(root, recursive=True)
        out, files, captures, runs = None, 0, [], 0

        def spill() -> pa.RecordBatch:
            nonlocal runs
            file = _RunFile(store, root, f"run-{name}-{runs:04d}.parquet")
            for x in sorted(captures):
                file.add(x)
            captures.clear()
            runs += 1
            return file.close((context.partitionId() << 24) + runs, 0)

        at = 0
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                for page_id, url, html, digest, size, refers_to in zip(*(batch.column(i).to_pylist() for i in range(6))):
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        archive, files, at = f"pages-{name}-{files:04d}.warc.gz", files + 1, 0
                        out = store.open_output_stream(f"{root}/{archive}", compression=None)
                    member, when = page_record(page_id, url, (html or "").encode("utf-8"), digest, size, refers_to)
                    out.write(member)
                    captures.append((url_key(url), when, page_id if page_id is not None else -1, archive, at, len(member)))
                    at += len(member)
                    if len(captures) >= RUN_ROWS:
                        yield spill()
        if out is not None:
            out.close()
        if captures:
            yield spill()

    return pages.select("page_id", "url", "html", "digest", "size", "refers_to").mapInArrow(run, RUN)


def loser_tree(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
    """Merge sorted runs: each inner node keeps the loser of its match, the winner comes out on top."""
    k = len(runs)
    if not k:
        return
    heads = [next(r, None) for r in runs]

    def beats(i: int, j: int) -> bool:
        if heads[i] is None or heads[j] is None:
            return heads[j] is None and (heads[i] is not None or i < j)
        return (heads[i], i) < (heads[j], j)

    tree = [0] * k  # tree[0] is the winner, tree[1:] the losers of the matches

    def build(node: int) -> int:
        if node >= k:
            return node - k
        a, b = build(2 * node), build(2 * node + 1)
        won, lost = (a, b) if beats(a, b) else (b, a)
        tree[node] = lost
        return won

    tree[0] = build(1) if k > 1 else 0
    while heads[winner := tree[0]] is not None:
        yield heads[winner]
        heads[winner] = next(runs[winner], None)
        node = (winner + k) // 2
        while node:
            if beats(tree[node], winner):
                tree[node], winner = winner, tree[node]
            node //= 2
        tree[0] = winner


def range_tasks(sequences: list[list[tuple]], cuts: list[tuple]) -> list[tuple]:
    """For each key range between ``cuts``: its number, its bounds, and the files whose keys meet it.

    A sequence has files ``(run, low, high)`` in the order of their keys, so
    that the files of a range are neighbours.
    """
    bounds = [None, *sorted(set(cuts)), None]
    files: list[list[str]] = [[] for _ in bounds[1:]]
    for sequence in sequences:
        for run, low, high in sequence:
            first, last = bisect_right(bounds, low, 1, len(bounds) - 1) - 1, bisect_right(bounds, high, 1, len(bounds) - 1) - 1
            for i in range(first, last + 1):
                files[i].append(run)
    return [(i, bounds[i], bounds[i + 1], names) for i, names in enumerate(files) if names]


def _cuts(runs: DataFrame, group_of: dict[int, int], ranges: int) -> dict[int, list[tuple]]:
    """For each group of sequences the keys between its ranges, about ``ranges`` in all, from the runs' sample keys.

    The keys are sorted and cut by Spark's range partitioning; a key for each range reaches the driver.
    """
    found: dict[int, list[tuple]] = {g: [] for g in group_of.values()}
    if ranges <= len(found):
        return found
    groups = runs.sparkSession.createDataFrame(sorted(group_of.items()), "sequence long, grp long")
    keys = runs.join(groups, "sequence").select("grp", F.explode("sample").alias("k")).select("grp", F.col("k")[0].alias("u"), F.col("k")[1].alias("t"))
    dealt = keys.repartitionByRange(ranges, "grp", "u", "t").withColumn("part", F.spark_partition_id())
    for r in dealt.groupBy("part", "grp").agg(F.min(F.struct("u", "t")).alias("k")).collect():
        found[r["grp"]].append((r["k"]["u"], r["k"]["t"]))
    return {g: sorted(x)[1:] for g, x in found.items()}


def merge_runs(runs: DataFrame, folder: str) -> DataFrame:
    """The captures of all runs, ``range`` and the columns of a capture: by range, and in a range by URL key, time and page.

    While there are more than ``FAN_IN`` sequences, groups of so many are merged
    into one each. Ranges take in captures between two keys (URL key and time),
    so that one URL with many captures is spread as well. The driver has a row
    for each file of a run (``RUN_ROWS`` or ``RANGE_ROWS`` captures) and a key for each range.
    """
    spark = runs.sparkSession

    def read(store, path: str, low, high) -> Iterator[tuple]:
        import pyarrow.parquet as pq

        with store.open_input_file(path) as f:
            file = pq.ParquetFile(f)
            for g in range(file.num_row_groups):
                meta = file.metadata.row_group(g).column(0).statistics
                if meta is not None and meta.has_min_max and ((high is not None and meta.min > high[0]) or (low is not None and meta.max < low[0])):
                    continue
                for row in zip(*(c.to_pylist() for c in file.read_row_group(g).columns)):
                    if (low is None or row[:2] >= low) and (high is None or row[:2] < high):
                        yield row

    def merged(store, root: str, r: dict) -> Iterator[tuple]:
        low, high = (None if x is None else tuple(x) for x in (r["low"], r["high"]))
        return loser_tree([read(store, f"{root}/{x}", low, high) for x in r["files"]])

    def to_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, root = filesystem(folder)
        for batch in batches:
            for r in batch.to_pylist():
                file = _RunFile(store, root, f"merge-{r['level']:02d}-{r['grp']:06d}-{r['range']:06d}-{TaskContext.get().taskAttemptId()}.parquet")
                for x in merged(store, root, r):
                    file.add(x)
                row = file.close(r["grp"], r["range"])
                if file.rows:
                    yield row

    def to_index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)
        for batch in batches:
            for r in batch.to_pylist():
                found = merged(store, root, r)
                while block := list(islice(found, 4096)):
                    yield pa.RecordBatch.from_arrays([pa.array([r["range"]] * len(block), pa.int32()), *_columns(block)], names=["range", *_CAPTURE.names])

    level = 0
    while True:
        sequences: dict[int, list] = {}
        rows: dict[int, int] = {}
        for r in runs.select("sequence", "place", "run", "rows", "low", "high").collect():
            sequences.setdefault(r["sequence"], []).append((r["place"], r["run"], tuple(r["low"]), tuple(r["high"])))
            rows[r["sequence"]] = rows.get(r["sequence"], 0) + r["rows"]
        last = len(sequences) <= FAN_IN
        group_of = {q: i // FAN_IN for i, q in enumerate(sorted(sequences))}
        in_group = {g: [q for q in sorted(sequences) if group_of[q] == g] for g in sorted(set(group_of.values()))}
        ranges = sum(-(-sum(rows[q] for q in members) // RANGE_ROWS) for members in in_group.values())
        if last:
            ranges = max(ranges, min(spark.sparkContext.defaultParallelism, sum(rows.values()) // 5_000 + 1))
        cuts = _cuts(runs, group_of, ranges)
        tasks = [(level, g, *task) for g, members in in_group.items() for task in range_tasks([[f[1:] for f in sorted(sequences[q])] for q in members], cuts[g])]
        work = spark.createDataFrame(tasks, "level int, grp long, range int, low array<string>, high array<string>, files array<string>")
        work = work.repartition(max(1, len(tasks)), "grp", "range")
        if last:
            return work.mapInArrow(to_index, "range int, " + CAPTURE)
        runs, level = keep(work.mapInArrow(to_runs, RUN), "runs"), level + 1


def read_back(index: DataFrame, folder: str) -> DataFrame:
    """The pages of an index: ``page_id, payload_bytes, payload_digest, record_type, refers_to``, read from the archives.

    A response whose payload does not have its digest is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)
        name, f = None, None
        page = lambda x: None if x in (None, "<urn:page:None>") else int(x.rpartition(":")[2].rstrip(">"))
        for batch in batches:
            rows = []
            for archive, offset, size in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if archive != name:
                    name, f = archive, store.open_input_file(f"{root}/{archive}")
                f.seek(offset)
                headers, block = parse(f.read(size))
                http, _, payload = block.partition(b"\r\n\r\n")
                digest = headers["warc-payload-digest"].removeprefix("sha1:")
                if headers["warc-type"] == "response" and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"{archive} at {offset}: the payload does not have its digest")
                length = int(re.search(rb"Content-Length: (\d+)", http)[1])
                rows.append((page(headers["warc-record-id"]), length, digest, headers["warc-type"], page(headers.get("warc-refers-to"))))
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            columns = [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 5, types)]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    by_place = index.select("archive", "offset", "size").sortWithinPartitions("archive", "offset")
    return by_place.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, folder: str | None = None) -> tuple[str, DataFrame, DataFrame]:
    """Write ``pages`` (page_id, url, html); return the folder, the merged index and the pages read back.

    Null html is an empty payload. Of equal payloads of at least 1000 bytes the
    record with the largest page_id is the response and the others revisit it;
    a row without page_id never is one that others refer to. Repeated rows are
    written as often: the copies of the response's row are responses too. An
    empty table gives an empty index.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = rows.withColumn("digest", F.sha1(payload)).withColumn("size", F.octet_length(payload).cast("long"))
    large = rows.where(F.col("size") >= REVISIT_BYTES)
    copies = large.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").select("digest", "first")
    known = rows.join(keep(copies, "copies"), "digest", "left")
    refers_to = F.when((F.col("size") >= REVISIT_BYTES) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    runs = keep(write_archives(known.withColumn("refers_to", refers_to), folder), "runs")
    index = keep(merge_runs(runs, folder), "cdx")
    return folder, index, read_back(index, folder)
