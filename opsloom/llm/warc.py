"""WARC archives of pages, and the capture histories of their URLs by an external index merge.

Each task writes its pages as gzip records into archive files and notes for each record
its URL key, time, file and place.  The notes of a file are sorted on the spot: a run.  Runs
are then merged: range partitioning gives each task the segment of every run that falls
into its range of (URL key, time), and a loser tree takes the least head of the k segments
one by one, log2(k) comparisons each.  The result is one index in the order of URL
key and time over all archives, so all captures of a URL follow each other in time.

Equal payloads are stored once: a grouped minimum per digest decides, and the join
with it may be split by Spark where one payload is very frequent.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.llm.files import read_all, write_new
from opsloom.plans.storage import cut_lineage, shared_path

RUN = "run string, place int, url_key string, captured string, page_id bigint, file string, offset bigint, length bigint"
HISTORY = "url_key string, captured string, page_id bigint, file string, offset bigint, length bigint, history_order bigint"
RECORD = "file string, offset bigint, page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """A sortable key of a URL: host labels from the top domain down, then path and query; empty for null."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").lower().removeprefix("www.")
    except ValueError:
        return url
    labels = ",".join(reversed(host.split("."))) if host else ""
    return f"{labels}){parts.path.rstrip('/') or '/'}" + (f"?{'&'.join(sorted(parts.query.split('&')))}" if parts.query else "")


def _record(kind: str, page_id: int | None, url: str | None, captured: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {captured}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    block = http if kind == "revisit" else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse(record: bytes) -> dict:
    """The fields of one record; the digest of a stored payload is computed anew and compared."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    number = lambda name: (lambda v: int(v) if v else None)(fields.get(name, "<urn:page:>")[len("<urn:page:") : -1])
    return {"page_id": number("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "payload_bytes": length, "payload_digest": digest, "record_type": kind, "refers_to": number("WARC-Refers-To"), "payload": payload if kind == "response" else None}


def records(data: bytes) -> Iterator[tuple[int, dict]]:
    """All records of an archive with the places of their gzip members."""
    at = 0
    while at < len(data):
        member = zlib.decompressobj(31)
        # members are short: hand over a piece at a time
        plain, end = [], at
        while not member.eof and end < len(data):
            plain.append(member.decompress(data[end : end + 65536]))
            end += 65536
        end = min(end, len(data)) - len(member.unused_data)
        yield at, parse(b"".join(plain))
        at = end


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``page_id, digest, refers_to`` of the pages (``page_id, digest, size``) whose payload another page with a smaller id stores."""
    shared = cut_lineage(pages.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1 and refers_to is not null").drop("copies"))
    return cut_lineage(pages.join(shared, "digest").where((F.col("size") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to").distinct())


def write_archives(pages: DataFrame, captured: Column | None = None, least_bytes: int = 0, file_bytes: int = 32 << 20, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record per page to the shared folder and return the runs, one row per record, sorted inside each run.

    A null html is an empty payload.  Of pages with equal payloads of at least
    ``least_bytes`` the one with the smallest id is stored (all rows of that id, if it
    repeats), the others refer to it; a page with a null id can only refer.  ``captured`` is the
    time of capture (the epoch if not given or null).  An empty table writes nothing.
    """
    spark = pages.sparkSession
    folder, runs = shared_path(spark, "archives"), shared_path(spark, "runs")
    when = F.date_format(F.coalesce(captured, F.lit(0).cast("timestamp")) if captured is not None else F.lit(0).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = pages.select(pages[id_col].cast("bigint").alias("page_id"), pages[url_col].alias("url"), when.alias("captured"), F.coalesce(pages[html_col].cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    known = revisits(rows.select("page_id", "digest", F.length("payload").alias("size")), least_bytes)
    same = rows["page_id"].eqNullSafe(known["page_id"]) & (rows["digest"] == known["digest"])
    decided = rows.join(known, same, "left").select(rows["page_id"], "url", "captured", "payload", rows["digest"], "refers_to")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        notes: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal size
            file = write_new(folder, ".warc.gz", b"".join(held))
            notes.sort(key=lambda n: (n[0], n[1], n[2] is not None, n[2] or 0, n[3]))
            columns = [[file] * len(notes), list(range(len(notes))), *([n[i] for n in notes] for i in range(3)), [file] * len(notes), *([n[i] for n in notes] for i in (3, 4))]
            held.clear()
            notes.clear()
            size = 0
            kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["run", "place", "url_key", "captured", "page_id", "file", "offset", "length"])

        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                for page_id, url, when, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.slice(i, 500).columns)):
                    kind = "response" if refers_to is None else "revisit"
                    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
                    record = packer.compress(_record(kind, page_id, url, when, payload, base64.b32encode(bytes.fromhex(digest)).decode(), refers_to)) + packer.flush()
                    notes.append((url_key(url), when, page_id, size, len(record)))
                    held.append(record)
                    size += len(record)
                    if size >= file_bytes:
                        yield flush()
        if held:
            yield flush()

    decided.mapInArrow(task, RUN).write.parquet(runs)
    return spark.read.schema(RUN).parquet(runs)


class LoserTree:
    """The least head of k sorted lists: inner nodes keep the losers of their matches, so a next head replays one path."""

    def __init__(self, lists: list[list]) -> None:
        self.lists, self.places = lists, [0] * len(lists)
        self.k = max(1, len(lists))
        self.tree = [-1] * self.k
        for player in reversed(range(len(lists))):
            self._replay(player)

    def _beats(self, a: int, b: int) -> bool:
        """Whether list a's head comes before list b's; an ended list loses, and the first list wins a tie."""
        if b < 0 or a < 0:
            return a < 0  # a seat not yet taken lets the newcomer wait there
        left, right = self.places[a] < len(self.lists[a]), self.places[b] < len(self.lists[b])
        if not (left and right):
            return left
        x, y = self.lists[a][self.places[a]], self.lists[b][self.places[b]]
        return x < y or (x == y and a < b)

    def _replay(self, player: int) -> None:
        node = (player + self.k) // 2
        while node:
            if self._beats(self.tree[node], player):
                self.tree[node], player = player, self.tree[node]
            if player < 0:
                return
            node //= 2
        self.tree[0] = player

    def __iter__(self) -> Iterator:
        while self.lists:
            winner = self.tree[0]
            if self.places[winner] == len(self.lists[winner]):
                return
            yield self.lists[winner][self.places[winner]]
            self.places[winner] += 1
            self._replay(winner)


def merge_runs(runs: DataFrame) -> DataFrame:
    """All captures in the order of (URL key, time, page id), numbered by ``history_order``, ascending but with gaps.

    A range also splits between captures of one URL, so a URL with very many captures does
    not end in one task; a task holds the index rows of its range.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments: dict[str, list[tuple]] = {}
        for batch in batches:
            for run, _, key, when, page_id, file, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                segments.setdefault(run, []).append((key, when, page_id is not None, page_id or 0, file, offset, length))
        number, rows = TaskContext.get().partitionId() << 36, []
        for row in LoserTree(list(segments.values())):
            rows.append(row)
            if len(rows) == 10_000:
                yield _history(rows, number)
                number += len(rows)
                rows = []
        if rows:
            yield _history(rows, number)

    keys = ["url_key", "captured", "page_id"]
    return cut_lineage(runs.repartitionByRange(*keys).sortWithinPartitions("run", "place").mapInArrow(task, HISTORY))


def _history(rows: list[tuple], number: int) -> pa.RecordBatch:
    columns = [[r[0] for r in rows], [r[1] for r in rows], [r[3] if r[2] else None for r in rows], *([r[i] for r in rows] for i in (4, 5, 6)), list(range(number, number + len(rows)))]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["url_key", "captured", "page_id", "file", "offset", "length", "history_order"])


def read_archives(histories: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of all archives named in an index, with their place in it; ``payload`` is null for revisits, and for all unless wanted."""
    files = cut_lineage(histories.select("file").distinct())
    count = max(1, files.count())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split(" ")[0] for f in RECORD.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for file in batch.column("file").to_pylist():
                rows: list[dict] = []
                for offset, row in records(read_all(file)):
                    rows.append(row | {"file": file, "offset": offset} | ({} if payloads else {"payload": None}))
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names)

    found = files.repartition(count).mapInArrow(task, RECORD)
    return found.join(histories.select("file", "offset", "url_key", "captured", "history_order"), ["file", "offset"])
