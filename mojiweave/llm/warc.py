"""WARC archives with a two-level capture index.

Archives: each page is a gzip member of its own in its partition's file. Of pages with equal
payloads the one with the smallest page_id is a response, the others are revisits that refer to it.

Index: the keys of all captures, host reversed (`com,example,www)/path?query`, a tab, the capture's
number), are sorted into shards; a shard is a file of compressed blocks of BLOCK_LINES lines and a
sparse directory with the first key of each block. A lookup finds the shard by its first key, the
block by binary search in the directory, the line by binary search in the block, and then reads the
one range of the one archive that holds the record.

Archives and shards are written under a temporary name and moved, from rows in a fixed order, so a
task that runs again writes the same file. The table of captures is what Spark has committed.
They lie in the shared folder and are read and written through pyarrow's file systems, by URI.

Defined cases: a null html is an empty payload and a null url an empty one; a null page_id is
written as no number, is never preferred as the response, and comes back as null; rows that repeat
page_id, url and html give a record each, of the same type; an empty table gives an empty result;
columns other than page_id, url and html are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mojiweave.llm import common

BLOCK_LINES = 2000
#: Payloads of fewer bytes are never revisits.
MIN_BYTES = 0
DATE = "1970-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def clean_url(url: str) -> str:
    """The URL with white space and control characters percent-encoded, fit for a header."""
    import re
    from urllib.parse import quote

    return re.sub(r"[\x00-\x20\x7f-\xa0  ]", lambda m: quote(m[0]), url)


def url_key(url: str) -> str:
    """Scheme and fragment dropped, host lower-cased and reversed, a port kept."""
    rest = clean_url(url).split("#", 1)[0]
    head, mark, tail = rest.partition("://")
    rest = tail if mark else head
    cut = min((i for i in (rest.find("/"), rest.find("?")) if i >= 0), default=len(rest))
    host, path = rest[:cut].lower().rpartition("@")[2], rest[cut:]
    name, colon, port = host.partition(":")
    return ",".join(reversed(name.split("."))) + colon + port + ")" + (path or "/")


def entry_key(url: str | None, page_id: int | None) -> str:
    return f"{url_key(url or '')}\t{'' if page_id is None else format(page_id, '020d')}"


def record(page_id: int | None, url: str, payload: bytes, digest: str, lead: int | None) -> bytes:
    """A response, or without its payload the revisit of page `lead`."""
    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    name = "" if page_id is None else page_id
    head = ["WARC/1.1", f"WARC-Type: {'response' if lead is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Target-URI: {clean_url(url)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if lead is None:
        body += payload
    else:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{lead}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode() + body + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The fields of a record; a payload that contradicts its digest raises."""
    import base64
    import hashlib

    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")

    def number(x: str | None) -> int | None:
        return int(x) if x and (x := x.removeprefix("<urn:page:").removesuffix(">")) else None

    return {
        "page_id": number(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "payload": payload if kind == "response" else None,
        "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number(fields.get("WARC-Refers-To")),
    }


def _store(uri: str):
    """The file system of a folder and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class _Output:
    """A file that appears under its name only when it is whole."""

    def __init__(self, folder: str, name: str):
        import uuid

        self._fs, path = _store(folder)
        self._fs.create_dir(path, recursive=True)
        self.path, self._part = f"{path}/{name}", f"{path}/.{name}.{uuid.uuid4().hex}"
        self._out, self.at = self._fs.open_output_stream(self._part), 0

    def write(self, data: bytes) -> int:
        at = self.at
        self._out.write(data)
        self.at += len(data)
        return at

    def close(self) -> None:
        """The name may stand there already, from an attempt that was lost after its last step; not every store moves over it."""
        from pyarrow.fs import FileType

        self._out.close()
        if self._fs.get_file_info(self.path).type != FileType.NotFound:
            self._fs.delete_file(self.path)
        self._fs.move(self._part, self.path)


CAPTURES = "entry string, file string, offset long, length long"


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes the archives; one row per record: its entry key and where it lies."""
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("hash", F.sha2(F.col("html").cast("binary"), 256))
    equal = rows.filter(F.octet_length("html") >= min_bytes).groupBy("hash").agg(F.min("page_id").alias("lead"), F.count(F.lit(1)).alias("n"))
    equal = common.materialize(equal.filter("n > 1 and lead is not null").withColumnRenamed("n", "copies"), "equal_payloads")
    revisits = common.meet(rows.select("page_id", "hash"), equal, ["hash"], "page_id").filter("not (page_id <=> lead)").distinct()
    revisits = common.materialize(revisits.select(F.col("page_id").alias("_id"), F.col("hash").alias("_hash"), "lead"), "revisits")
    # only pages that may be revisits are shuffled to meet their response's page_id
    known = common.marked(rows, F.xxhash64("page_id", "hash"), revisits.select(F.xxhash64("_id", "_hash").alias("h")))
    maybe = known.filter("_maybe")
    met = maybe.join(revisits, maybe["page_id"].eqNullSafe(revisits["_id"]) & (maybe["hash"] == revisits["_hash"]), "left").select("page_id", "url", "html", "lead")
    joined = known.filter("not _maybe").select("page_id", "url", "html", F.lit(None).cast("long").alias("lead")).unionByName(met)

    def run(batches: Iterator) -> Iterator:
        import base64
        import gzip
        import hashlib

        import pyarrow as pa
        from pyspark import TaskContext

        out, name = None, f"part-{TaskContext.get().partitionId():06d}.warc.gz"
        for batch in batches:
            found = []
            for page_id, url, html, lead in zip(*(batch.column(c) for c in ("page_id", "url", "html", "lead")), strict=True):
                page_id, url, payload, lead = page_id.as_py(), url.as_py(), html.as_py().encode("utf-8", "surrogatepass"), lead.as_py()
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                out = out or _Output(folder, name)
                data = gzip.compress(record(page_id, url, payload, digest, lead), 6, mtime=0)
                found.append((entry_key(url, page_id), name, out.write(data), len(data)))
            yield pa.RecordBatch.from_pylist([dict(zip(("entry", "file", "offset", "length"), x, strict=True)) for x in found], pa.schema([("entry", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
        if out:
            out.close()

    return common.materialize(common.map_arrow(joined.sortWithinPartitions("page_id", "url", F.xxhash64("html")), run, CAPTURES), "captures")


def build_index(captures: DataFrame, folder: str) -> list[tuple[bytes, str]]:
    """Writes the shards; (first key, file) of each, in order: a row per partition reaches the driver."""
    rows = captures.repartitionByRange("entry", "file", "offset").sortWithinPartitions("entry", "file", "offset")

    def run(batches: Iterator) -> Iterator:
        import json
        import zlib

        import pyarrow as pa
        from pyspark import TaskContext

        out, first, lines, directory = None, "", [], []

        def block() -> None:
            data = zlib.compress("\n".join(lines).encode(), 6)
            directory.append((lines[0].rsplit("\t", 3)[0], out.write(data), len(data)))
            lines.clear()

        for batch in batches:
            for x in zip(*(batch.column(c).to_pylist() for c in ("entry", "file", "offset", "length")), strict=True):
                if out is None:
                    out, first = _Output(folder, f"shard-{TaskContext.get().partitionId():06d}"), x[0]
                lines.append("\t".join(map(str, x)))
                if len(lines) >= BLOCK_LINES:
                    block()
        if out is not None:
            if lines:
                block()
            tail = zlib.compress(json.dumps(directory).encode(), 6)
            at = out.write(tail)
            out.write(at.to_bytes(8, "little") + len(tail).to_bytes(8, "little"))
            out.close()
            yield pa.RecordBatch.from_pydict({"first": [first], "file": [out.path.rpartition("/")[2]]})

    return sorted((r["first"].encode(), r["file"]) for r in common.map_arrow(rows, run, "first string, file string").collect())


class Index:
    """Lookups in the shards of a folder; the last shards' directories and the last block stay in memory."""

    def __init__(self, folder: str, shards: list[tuple[bytes, str]]):
        self._fs, self._path = _store(folder)
        self._firsts, self._files = [a for a, _ in shards], [b for _, b in shards]
        self._open: dict[int, tuple] = {}
        self._block: tuple = (None, [])

    def _shard(self, k: int):
        import json
        import zlib

        if k not in self._open:
            if len(self._open) >= 4:
                self._open.pop(next(iter(self._open)))
            f = self._fs.open_input_file(f"{self._path}/{self._files[k]}")
            size = f.size()
            ends = f.read_at(16, size - 16)
            at, n = int.from_bytes(ends[:8], "little"), int.from_bytes(ends[8:], "little")
            directory = json.loads(zlib.decompress(f.read_at(n, at)))
            self._open[k] = f, [x[0].encode() for x in directory], directory
        return self._open[k]

    def _lines(self, k: int, b: int) -> list[bytes]:
        import zlib

        if self._block[0] != (k, b):
            f, _, directory = self._shard(k)
            _, at, n = directory[b]
            self._block = (k, b), zlib.decompress(f.read_at(n, at)).split(b"\n")
        return self._block[1]

    def find(self, prefix: bytes) -> Iterator[tuple[bytes, str, int, int]]:
        """All captures whose entry key starts with prefix: (entry, file, offset, length)."""
        from bisect import bisect_left

        for k in range(max(0, bisect_left(self._firsts, prefix) - 1), len(self._files)):
            if self._firsts[k] > prefix and not self._firsts[k].startswith(prefix):
                return
            firsts = self._shard(k)[1]
            for b in range(max(0, bisect_left(firsts, prefix) - 1), len(firsts)):
                if firsts[b] > prefix and not firsts[b].startswith(prefix):
                    return
                lines = self._lines(k, b)
                for i in range(bisect_left(lines, prefix), len(lines)):
                    if not lines[i].startswith(prefix):
                        return
                    entry, file, offset, length = lines[i].rsplit(b"\t", 3)
                    yield entry, file.decode(), int(offset), int(length)


RECORDS = "entry string, page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def fetch(entries: DataFrame, folder: str, shards: list[tuple[bytes, str]], payload: bool = True) -> DataFrame:
    """The records whose entry key is in entries (entry, each once): found through the index and read by range.

    Entries are dealt out in key order, so a task reads few shards and each block once.
    """
    spark = entries.sparkSession
    known = spark.sparkContext.broadcast(shards)  # a row per partition of the index

    def run(batches: Iterator) -> Iterator:
        import zlib

        import pyarrow as pa

        index, files = Index(folder + "/index", known.value), {}
        store, path = _store(folder + "/warc")
        names = [x.split()[0] for x in RECORDS.split(", ")]
        kinds = {"payload": pa.binary(), **dict.fromkeys(("page_id", "payload_bytes", "refers_to"), pa.int64())}
        schema = pa.schema([(n, kinds.get(n, pa.string())) for n in names])
        for batch in batches:
            found, held = [], 0
            for entry in batch.column("entry"):
                entry = entry.as_py()
                for key, file, offset, length in index.find(entry.encode()):
                    if key.decode() != entry:
                        break
                    if file not in files:
                        if len(files) >= 64:
                            files.pop(next(iter(files))).close()
                        files[file] = store.open_input_file(f"{path}/{file}")
                    got = parse_record(zlib.decompress(files[file].read_at(length, offset), 31))
                    if not payload:
                        got["payload"] = None
                    held += len(got["payload"] or b"")
                    found.append({"entry": entry} | got)
                if held > 1 << 25:
                    yield pa.RecordBatch.from_pylist(found, schema)
                    found, held = [], 0
            yield pa.RecordBatch.from_pylist(found, schema)

    return common.map_arrow(entries.repartitionByRange("entry").sortWithinPartitions("entry"), run, RECORDS)


def entries_of(pages: DataFrame) -> DataFrame:
    """The entry keys of pages (page_id, url), each once."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"entry": pa.array([entry_key(u.as_py(), p.as_py()) for p, u in zip(batch.column("page_id"), batch.column("url"), strict=True)], pa.string())})

    return common.map_arrow(pages.select("page_id", "url"), run, "entry string").distinct()


@common.scratch()
def archive(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES) -> list[tuple[bytes, str]]:
    """Writes archives (folder/warc) and index (folder/index) of pages; the index's shards."""
    return build_index(write_archives(pages, folder + "/warc", min_bytes), folder + "/index")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages")
    folder = common.new_path(spark, "archive")
    shards = archive(pages, folder)
    return fetch(entries_of(pages), folder, shards, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
