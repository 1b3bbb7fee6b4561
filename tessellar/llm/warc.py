"""WARC archives with a two-level capture index (operator 9).

Records are compressed one by one, so each can be read alone. The index holds a line for each capture, sorted by
reversed-host key and packed into compressed blocks of a constant number of lines; a sparse directory has each block's
first and last key and its place, and is a table in sorted files. Wishes meet the stretch of the directory that they
fall into, find their blocks there by binary search, their lines in a block by another, and read one range of an archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, fresh_path, map_arrow, stage_table, text_or_empty

_END = b"\r\n\r\n"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def surt(url: str | None) -> str:
    """Reversed-host key of a URL: 'http://a.example.com/x?y' gives 'com,example,a)/x?y'. Null gives '-'."""
    if url is None:
        return "-"
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return quote(url, safe="")
    if not host:
        return quote(url.strip(), safe="/?&=:")
    tail = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, 80, 443) else "") + ")" + quote(tail, safe="/?&=:%+,;@~")


def _line_key(key: str, page_id: int | None) -> str:
    return f"{key} {page_id if page_id is not None else '-'}"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None, date: str) -> bytes:
    """One compressed record: a response, or a revisit (without the body) where refers_to is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: <urn:page:{'-' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=_SAFE)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        if refers_url is not None:
            head.append(f"WARC-Refers-To-Target-URI: {quote(refers_url, safe=_SAFE)}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + _END + block + _END) + packer.flush()


_SAFE = "/?#[]@!$&'()*+,;=:%~-._"


def parse(data: bytes) -> dict:
    """Headers and payload of one compressed record. A damaged record raises."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(_END)
    names = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(names["Content-Length"])]
    http, _, body = block.partition(_END)
    size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    digest = names["WARC-Payload-Digest"].removeprefix("sha1:")
    own = lambda s: None if s == "<urn:page:->" else int(s[10:-1])
    if names["WARC-Type"] == "response" and (len(body) != size or digest32(body) != digest):
        raise ValueError(f"damaged record {names['WARC-Record-ID']}")
    refers = names.get("WARC-Refers-To")
    return {"page_id": own(names["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest, "record_type": names["WARC-Type"], "refers_to": own(refers) if refers else None, "payload": body, "url": names.get("WARC-Target-URI")}


class Files:
    """Range reads from the shared folder, by any scheme that pyarrow knows; a few handles stay open."""

    def __init__(self):
        self.open: dict[str, pa.NativeFile] = {}

    def read(self, uri: str, at: int, length: int) -> bytes:
        if uri not in self.open:
            if len(self.open) > 32:
                self.open.pop(next(iter(self.open))).close()
            fs, path = pafs.FileSystem.from_uri(uri)
            self.open[uri] = fs.open_input_file(path)
        return self.open[uri].read_at(length, at)


class Writer:
    """Appends byte strings to files of a bounded size; a new name for each attempt of a task."""

    def __init__(self, folder: str, suffix: str, most: int = 1 << 30):
        self.folder, self.suffix, self.most, self.out, self.uri, self.at = folder, suffix, most, None, "", 0

    def add(self, data: bytes) -> tuple[str, int, int]:
        if self.out is None or self.at >= self.most:
            self.close()
            fs, path = pafs.FileSystem.from_uri(self.folder)
            fs.create_dir(path, recursive=True)
            name = f"{uuid.uuid4().hex}.{self.suffix}"
            self.out, self.uri, self.at = fs.open_output_stream(f"{path}/{name}", compression=None), f"{self.folder}/{name}", 0
        self.out.write(data)
        at, self.at = self.at, self.at + len(data)
        return self.uri, at, len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()


@dataclass(frozen=True)
class Archive:
    """folder: of the archives; directory: a row for each index block (first, last, file, offset, length); size: the bytes
    of all records."""

    folder: str
    directory: DataFrame
    size: int


_CAPTURE = "key string, page_id long, file string, offset long, length long"


def write_archive(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least: int = 0, date: str = "2024-01-01T00:00:00Z", block_lines: int = 512) -> Archive:
    """Write a record for each row, and the index.

    Payloads are equal if their SHA-256 is. Of rows with equal payloads of at least `least` bytes that with the smallest id is the response and the others
    revisit it; all smaller payloads are responses. A null body is an empty payload; a null id counts as the largest
    and is never referred to unless all of its group are null (then all are responses); rows that repeat the smallest
    id are all responses; a null URL has the key '-'. Other columns are left out. An empty table gives an empty
    archive. A block has `block_lines` lines however large the table is.
    """
    spark, root = pages.sparkSession, fresh_path(pages.sparkSession, "warc")
    body = text_or_empty(body_col)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("body"), F.sha2(body.cast("binary"), 256).alias("sha"), F.octet_length(body).cast("long").alias("size"))
    groups = rows.filter(F.col("size") >= least).groupBy("sha", "size").agg(F.count("*").alias("n"), F.min(F.struct(F.coalesce("id", F.lit(2**63 - 1)).alias("id"), "url")).alias("first"))
    shared = groups.filter("n > 1").select("sha", "size", F.col("first.id").alias("first_id"), F.col("first.url").alias("first_url"))
    joined = rows.join(shared, ["sha", "size"], "left").select("id", "url", "body", F.when(F.col("first_id") < F.coalesce("id", F.lit(2**63 - 1)), F.col("first_id")).alias("refers"), "first_url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Writer(f"{root}/archives", "warc.gz")
        for batch in batches:
            found = []
            for key, url, text, refers, first_url in zip(*(c.to_pylist() for c in batch.columns)):
                payload = text.encode("utf-8", "surrogatepass")
                found.append((surt(url), key, *out.add(record(key, url, payload, digest32(payload), refers, first_url, date))))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], f.type) for k, f in enumerate(arrow_schema(_CAPTURE))], schema=arrow_schema(_CAPTURE))
        out.close()

    captures = stage_table(joined.mapInArrow(write, _CAPTURE), "captures")
    size = captures.agg(F.sum("length")).first()[0] or 0
    entry = "first string, last string, file string, offset long, length long"

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, done = Writer(f"{root}/index", "idx.gz"), [], []

        def flush() -> None:
            if held:
                data = zlib.compress("\n".join("\t".join(r) for r in held).encode(), 6)
                done.append((held[0][0], held[-1][0], *out.add(data)))
                held.clear()

        for batch in batches:
            for line, file, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                held.append((line, file, str(offset), str(length)))
                if len(held) == block_lines:
                    flush()
        flush()
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], f.type) for k, f in enumerate(arrow_schema(entry))], schema=arrow_schema(entry))

    line = F.concat_ws(" ", "key", F.coalesce(F.col("page_id").cast("string"), F.lit("-")))
    laid = captures.select(line.alias("line"), "file", "offset", "length").repartitionByRange("line", "file", "offset").sortWithinPartitions("line", "file", "offset")
    return Archive(root, stage_table(laid.mapInArrow(index, entry), "index-directory"), size)


def _stretches(directory: DataFrame, most: int) -> list[str]:
    """Keys that part the directory into about `most` stretches of like size, or fewer: first keys of blocks, by hash."""
    every = max(1, directory.count() // most)
    chosen = directory.filter(F.pmod(F.xxhash64("first", "file", "offset"), F.lit(every)) == 0)
    return sorted({r.first_ for r in chosen.select(F.col("first").alias("first_")).collect()})  # about `most` keys


def lookup(archive: Archive, wanted: DataFrame, *, id_col: str = "page_id", url_col: str = "url", stretches: int = 4096, task_bytes: int = 16_000_000) -> DataFrame:
    """Every capture of the wanted (url, id) pairs, read from the archives: page_id, payload_bytes, payload_digest,
    record_type, refers_to, url, payload. Repeated wishes count once; a pair without captures gives no row.

    At most about `stretches` keys of the directory reach the driver and the tasks. A task reads about `task_bytes` of
    records; the captures of one key that has very many lie in many blocks, which go to different tasks."""
    spark = wanted.sparkSession
    tops = spark.sparkContext.broadcast(_stretches(archive.directory, stretches))
    asked = wanted.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url")).distinct()
    place = "stretch int, kind int, line string, last string, file string, offset long, length long"

    def wish(batch: pa.RecordBatch) -> dict:
        lines = [_line_key(surt(url), key) for key, url in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        none = [None] * len(lines)
        return {"stretch": [bisect_right(tops.value, x) for x in lines], "kind": [1] * len(lines), "line": lines, "last": none, "file": none, "offset": none, "length": none}

    def block(batch: pa.RecordBatch) -> dict:
        """A block stands in every stretch that its keys reach into."""
        out: dict[str, list] = {n: [] for n in ("stretch", "kind", "line", "last", "file", "offset", "length")}
        for first, last, *rest in zip(*(c.to_pylist() for c in batch.columns)):
            for stretch in range(bisect_right(tops.value, first), bisect_right(tops.value, last) + 1):
                for name, v in zip(out, (stretch, 0, first, last, *rest)):
                    out[name].append(v)
        return out

    both = map_arrow(archive.directory.select("first", "last", "file", "offset", "length"), place, block).unionAll(map_arrow(asked, place, wish))
    laid = both.repartition("stretch").sortWithinPartitions("stretch", "kind", "line")
    hit = "file string, offset long, length long, line string"

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, firsts, lasts, places, kinds = None, [], [], [], arrow_schema(hit)
        for batch in batches:
            out: list[tuple] = []
            for stretch, kind, line, last, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if stretch != at:
                    at, firsts, lasts, places = stretch, [], [], []
                if kind == 0:
                    firsts.append(line), lasts.append(last), places.append(rest)
                    continue
                out += [(*places[b], line) for b in range(bisect_left(lasts, line), bisect_right(firsts, line))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(kinds)], schema=kinds)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, kinds, at, keys, lines = Files(), arrow_schema(schema), None, [], []
        for batch in batches:
            places = set()
            for *block_at, line in zip(*(c.to_pylist() for c in batch.columns)):
                if block_at != at:
                    at = block_at
                    lines = [x.split("\t") for x in zlib.decompress(files.read(*block_at)).decode().split("\n")]
                    keys = [x[0] for x in lines]
                for k in range(bisect_left(keys, line), bisect_right(keys, line)):
                    places.add((lines[k][1], int(lines[k][2]), int(lines[k][3])))
            out, held = [], 0
            for file, offset, length in sorted(places):
                out.append(parse(files.read(file, offset, length)))
                held += len(out[-1]["payload"])
                if held > 1 << 25:
                    yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in out], f.type) for f in kinds], schema=kinds)
                    out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in out], f.type) for f in kinds], schema=kinds)

    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-archive.size // task_bytes))
    found = laid.mapInArrow(find, hit).repartition(tasks, "file", "offset").sortWithinPartitions("file", "offset", "line")
    return found.mapInArrow(read, schema)
