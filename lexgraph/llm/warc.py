"""WARC archives: a writer with revisit records, and a reader that salvages what damage has left.

Archives are real .warc.gz files, one gzip member a record, in the folder that driver and executors share.
A task writes under a name of its own attempt, and a manifest names the files of the attempts that
succeeded, so a task that runs again leaves no record twice.

The reader checks every record (header syntax, length, block and payload digest, gzip data). After a failed
check it searches for the next gzip member or version line that does pass, goes on from there, and logs the
bytes between as a gap. Records are parsed while their member is inflated, so those before and after a damaged
one in the same member come back; places are given in the file and, within a member, in its inflated bytes.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, whole_numbers, written

GZIP, VERSION, END = b"\x1f\x8b\x08", b"WARC/1.", b"\r\n\r\n"
STEP, OUT = 1 << 18, 1 << 16
HEADER = 64 << 20  # bytes of a block within which its HTTP header ends
HTTP_END = re.compile(rb"\r?\n\r?\n")
LINE = re.compile(rb"[^\r\n:]+:|[ \t]")  # how each line of a WARC header starts: with a name, or going on with the line before
KEEP = 1 << 30  # bytes up to which a payload is returned
TASK_BYTES = 128 << 20
DATE = "2024-01-01T00:00:00Z"
#: An extension field, the last of a header: the digest of the header's bytes before it, which no standard field covers.
HEADER_DIGEST = "X-Header-Digest"
UNCHECKED = "header without a digest in a damaged member"
OTHER_DIGEST = "block as stated, payload digest of something else"  # such as of the payload before it was sent in chunks


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _uri(url: str | None) -> str:
    return "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url or "")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record: the whole HTTP response, or with refers_to a revisit with the HTTP header only."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    name = lambda p: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{p}')}>"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id) if page_id is not None else f'<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, _sha1(payload))}>'}", f"WARC-Date: {DATE}"]
    if url:
        head.append(f"WARC-Target-URI: {_uri(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += [f"WARC-Payload-Digest: {_sha1(payload)}", f"WARC-Block-Digest: {_sha1(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    text = "\r\n".join(head).encode() + b"\r\n"
    return text + f"{HEADER_DIGEST}: {_sha1(text)}".encode() + END + block + END


def mark_revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", min_bytes: int = 1000) -> DataFrame:
    """Add _payload (the text, null as empty) and _refers_to.

    Of rows whose payloads are equal (in SHA-1 and length) and hold min_bytes or more, the one with the largest
    id is the response and the others refer to it. Rows that repeat that id are that page again and stay
    responses; a row with a null id is always a response.
    """
    rows = pages.withColumn("_payload", F.coalesce(F.col(payload_col), F.lit("")))
    rows = rows.withColumn("_sha", F.when(F.octet_length("_payload") >= min_bytes, F.unhex(F.sha1(F.col("_payload").cast("binary")))))
    first = rows.where(F.col("_sha").isNotNull() & F.col(id_col).isNotNull()).groupBy("_sha", F.octet_length("_payload").alias("_len")).agg(F.max(id_col).alias("_first"), F.count("*").alias("_n"))
    first = written(first.where(F.col("_n") > 1).select(F.col("_sha").alias("_s"), "_len", "_first"), "revisit-targets")
    rows = rows.join(first, (F.col("_sha") == F.col("_s")) & (F.octet_length("_payload") == F.col("_len")), "left")
    return rows.withColumn("_refers_to", F.when(F.col(id_col) < F.col("_first"), F.col("_first"))).drop("_sha", "_s", "_len", "_first")


def write_warc(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 1000, file_bytes: int = 64 << 20, level: int = 6) -> DataFrame:
    """Write a record per row to .warc.gz files of about file_bytes below path; return their manifest (file, records, bytes).

    A null payload is empty, a null URL leaves out the target. Other columns are ignored; an empty table writes
    no file.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    whole_numbers(pages, id_col)
    rows = mark_revisits(pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).alias("_url"), F.col(payload_col).alias("_html")), "_id", "_html", min_bytes)

    def write(batches):
        system, folder = pafs.FileSystem.from_uri(path)
        out, made, n, size = None, [], 0, 0

        def close():
            out.close()
            made.append((name, n, size))

        for batch in batches:
            for page, url, payload, refers in zip(*(batch.column(k) for k in range(4)), strict=True):
                if out is None:
                    name, n, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    system.create_dir(folder, recursive=True)
                    out = system.open_output_stream(name, compression=None)
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                data = packer.compress(record(page.as_py(), url.as_py(), payload.as_buffer().to_pybytes(), refers.as_py())) + packer.flush()
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= file_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array([f"{root(path, folder)}{m[0]}" for m in made]), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64())], ["file", "records", "bytes"])

    manifest = rows.select("_id", "_url", F.col("_payload").cast("binary").alias("_payload"), "_refers_to").mapInArrow(write, "file string, records long, bytes long")
    return written(manifest, "warc-manifest")


def root(uri: str, folder: str) -> str:
    """What stands before a file system's own path in a URI."""
    return uri[: uri.index(folder)] if folder in uri else uri.split("://")[0] + "://"


class Damaged(ValueError):
    pass


class _Plain:
    """A file read in steps, the last of them at hand; pos is the place read next."""

    broken = ""

    def __init__(self, f, size: int):
        self.f, self.size, self.pos, self.at, self.data = f, size, 0, 0, b""

    def _get(self, at: int, n: int) -> bytes:
        n = min(n, self.size - at)
        if not self.at <= at or at + n > self.at + len(self.data):
            self.f.seek(at)
            self.at, self.data = at, self.f.read(min(max(n, STEP), self.size - at))
        return self.data[at - self.at : at - self.at + n]

    def peek(self, n: int) -> bytes:
        return self._get(self.pos, n)

    def take(self, n: int) -> bytes:
        """Up to n bytes; none at the end."""
        if not self.at <= self.pos < self.at + len(self.data):
            self._get(self.pos, STEP)
        data = self.data[self.pos - self.at : self.pos - self.at + n]
        self.pos += len(data)
        return data

    def find(self, at: int, signs: tuple[bytes, ...]) -> int:
        """The next place of one of the signs from at on; the file's size if there is none."""
        most = max(map(len, signs)) - 1
        while at < self.size:
            if not (self.at <= at and at + most < self.at + len(self.data)):
                self._get(at, STEP)
            part, end = self.data[at - self.at :], self.at + len(self.data)
            if hits := [k for s in signs if (k := part.find(s)) >= 0]:
                return at + min(hits)
            at = end if end >= self.size else max(at + 1, end - most)
        return self.size

    def check_end(self, start: int, n: int) -> None:
        """Whether a block from start ends where its length says, by a read of these few bytes alone."""
        self.f.seek(min(start + n, self.size))
        if self.f.read(4) != END:
            raise Damaged("block has another length than stated")


class _Member:
    """The inflated bytes of the gzip member at a place of the file; pos counts them, place() is in the file.

    They end at the member's end or at a fault, which broken then tells. mark() keeps the state of inflating, so
    that reset() goes back there without inflating what lay before.
    """

    def __init__(self, src: _Plain, at: int):
        self.src, self.file, self.tool, self.held, self.pos = src, at, zlib.decompressobj(31), b"", 0
        self.size, self.broken, self.faulty, self.rest = None, "", False, b""  # size: known once the end has been met
        self.base, self.steps = at, ()  # place of a byte not after pos, and of the ends of the steps of inflating held

    def _inflate(self, part: bytes) -> None:
        """A step of output; before a fault, all of the output that precedes it."""
        before = self.tool.copy()
        try:
            self.held += self.tool.decompress(part, OUT)
            return
        except zlib.error as e:
            self.broken, self.faulty, self.tool = f"gzip: {e}", True, before
        with contextlib.suppress(zlib.error):
            while got := self._step(part, 256):
                self.held += got
                part = self.tool.unconsumed_tail
        with contextlib.suppress(zlib.error):
            while part:  # the fault lies within a few bytes
                self.held += self._step(part[:1], 0)
                part = part[1:]
        self.rest = part

    def _step(self, part: bytes, most: int) -> bytes:
        """Output of part, up to `most` bytes if not 0; a fault leaves the state as it was."""
        before = self.tool.copy()
        try:
            return self.tool.decompress(part, most)
        except zlib.error:
            self.tool = before
            raise

    def _more(self) -> bool:
        """Inflate a step; False at the end or the fault."""
        if not self.faulty and not self.tool.eof:
            part = self.tool.unconsumed_tail
            if not part:
                part = self.src._get(self.file, STEP)
                self.file += len(part)
            if part:
                n = len(self.held)
                self._inflate(part)
                used = self.file - len(self.rest if self.faulty else self.tool.unconsumed_tail or self.tool.unused_data)
                self.steps = (*self.steps, (self.pos + len(self.held), used))
                return len(self.held) > n or not self.faulty
            self.broken, self.faulty, self.rest = "truncated gzip member", True, b""
        self.size = self.pos + len(self.held)
        return False

    def peek(self, n: int) -> bytes:
        while len(self.held) < n and self._more():
            pass
        return self.held[:n]

    def take(self, n: int) -> bytes:
        if not self.held:
            self.peek(1)
        data, self.held = self.held[:n], self.held[n:]
        self.pos += len(data)
        return data

    def place(self) -> int:
        """The end of the last step of inflating whose bytes have all been used: exact at the end, else not too late."""
        while self.steps and self.steps[0][0] <= self.pos:
            self.base, self.steps = self.steps[0][1], self.steps[1:]
        return self.base

    def mark(self) -> tuple:
        return self.place(), self.pos, self.file, self.tool.copy(), self.held, self.faulty, self.rest, self.steps

    def reset(self, marked: tuple) -> None:
        self.base, self.pos, self.file, tool, self.held, self.faulty, self.rest, self.steps = marked
        self.tool = tool.copy()

    def intact(self) -> bool:
        """Whether all of the member inflates and its checksum holds; nothing of it is kept, and it is done once."""
        if self.size is not None:
            return not self.broken
        here = self.mark()
        while self.take(OUT):
            pass
        self.reset(here)
        return not self.broken

    def seek(self, sign: bytes) -> bool:
        """Go to the next place of the sign after this one; False if there is none."""
        self.take(1)
        while True:
            data = self.peek(OUT)
            if (k := data.find(sign)) >= 0:
                _skip(self, k)
                return True
            _skip(self, len(data) if len(data) < OUT else len(data) - len(sign) + 1)
            if len(data) < OUT:
                return False

    def check_end(self, start: int, n: int) -> None:
        if self.size is not None and start + n + 4 > self.size:
            raise Damaged("block has another length than stated")


def _skip(src, n: int) -> None:
    while n > 0:
        n -= len(src.take(n))


def _base32(digest) -> str:
    return "sha1:" + base64.b32encode(digest.digest()).decode()


def parse(src, keep: int = KEEP) -> tuple[dict, dict]:
    """Read the record that src stands at: its header, and of its block the HTTP header and the payload.

    The second dict has http, size, digest (hex SHA-1 of the payload) and payload, null if over `keep` bytes.
    A block of type application/http has a header, up to its first empty line, and a payload after it; any other block
    is payload as a whole. The block is digested as it is read, so that only a payload to be returned is held. A WARC
    header may have any length, as long as its lines have names.
    """
    n = 4096
    while (end := (head := src.peek(n)).find(END)) < 0:
        # what is no header shows by its lines, so that a damaged file is not read to its end in search of one
        if not head.startswith(VERSION) or len(head) < n or not all(LINE.match(x[: 1 << 16]) for x in head.split(b"\r\n")[1:-1]):
            raise Damaged("no WARC header")
        n *= 4
    if not head.startswith(VERSION):
        raise Damaged("no WARC header")
    mine, _, stated = head[:end].rpartition(f"{HEADER_DIGEST}: ".encode())
    if mine and stated.decode("latin-1") != _sha1(mine):
        raise Damaged("header digest differs")
    lines = head[:end].decode("utf-8", "replace").split("\r\n")
    head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    if not re.fullmatch(r"[0-9]{1,18}", head.get("content-length", "")) or "warc-type" not in head:
        raise Damaged("header lacks type or length")
    left = int(head["content-length"])
    src.check_end(src.pos + end + 4, left)
    _skip(src, end + 4)
    block, payload, http, parts, size = hashlib.sha1(), hashlib.sha1(), bytearray(), [] if keep >= 0 else None, 0
    before = head.get("content-type", "").lower().startswith("application/http")
    while left:
        data = src.take(min(left, STEP))
        if not data:
            raise Damaged("block has another length than stated")
        left -= len(data)
        block.update(data)
        if before:  # still in the HTTP header, which may have no end
            if len(http) > HEADER:
                continue
            http += data
            if (cut := HTTP_END.search(http, max(0, len(http) - len(data) - 3))) is None:
                continue
            before, http, data = False, http[: cut.start()], bytes(http[cut.end() :])
        payload.update(data)
        size += len(data)
        if parts is not None:
            parts.append(data)
            parts = parts if size <= keep else None
    if src.peek(4) != END:
        raise Damaged("block has another length than stated")
    _skip(src, 4)
    checked = (d := head.get("warc-block-digest", "")).startswith("sha1:")
    if checked and d != _base32(block):
        raise Damaged("block digest differs")
    note = None
    if head["warc-type"] != "revisit" and (d := head.get("warc-payload-digest", "")).startswith("sha1:") and d != _base32(payload):
        if not checked:
            raise Damaged("payload digest differs")
        note = OTHER_DIGEST
    return head, {"note": note, "http": bytes(http), "size": size, "digest": payload.hexdigest(), "payload": None if parts is None else b"".join(parts)}


def _member(src: _Plain, at: int, keep: int):
    """Yield the records and gaps of the gzip member at a place, as salvage does; return where it ends and, if its end is lost, why."""
    member, lost, why = _Member(src, at), None, ""
    while True:
        start = member.mark()
        if not member.peek(1):
            break
        try:
            head, found = parse(member, keep)
            if (member.peek(1) or member.broken) and not member.intact():  # else it ends here and is intact
                if "warc-block-digest" not in head:
                    raise Damaged("no digest, in a damaged member")
                if HEADER_DIGEST.lower() not in head:
                    found["note"] = UNCHECKED
        except Damaged as e:
            if lost is None:
                lost, why = start[1], str(e)
            member.reset(start)
            if not member.seek(VERSION):
                break
            continue
        if lost is not None:
            yield "gap", at, start[0], lost, start[1], why, None
            at, lost = start[0], None
        yield "record", at, (at := member.place()), start[1], member.pos, head, found
    if member.broken:
        return at, member.broken, (member.pos if lost is None else lost, member.size)
    if lost is not None:
        yield "gap", at, member.place(), lost, member.size, why, None
    return member.place(), "", None


def salvage(f, size: int, keep: int = KEEP):
    """Yield (kind, start, end, inner_start, inner_end, header or reason, what parse() found or None) of a file, in order.

    kind is 'record' or 'gap'; start and end are places in the file, which the parts cover whole, the inner ones
    places in the inflated bytes of a gzip member (null outside one). Places of records that share a member are
    known to a step of inflating. A record without a block digest counts only if its whole member is intact, and
    one of a damaged member whose header no digest covers gets a note.
    Held are a window of the file, a header and a payload of up to `keep` bytes; a longer one is read, checked
    and given without its bytes. In a plain file a record whose stated end is wrong costs a read of its header;
    any other damaged byte is read twice.
    """
    src, at, lost, why, inner = _Plain(f, size), 0, None, "", (None, None)
    while at < size:
        src.pos, here = at, at
        try:
            if src.peek(3) == GZIP:
                parts = _member(src, at, keep)
                while True:
                    try:
                        part = next(parts)
                    except StopIteration as e:
                        at, fault, span = e.value
                        break
                    if lost is not None:
                        if part[0] == "gap":  # one gap with what was lost before
                            part = ("gap", lost, part[2], None, None, why, None)
                        else:
                            yield "gap", lost, part[1], *inner, why, None
                        lost = None
                    yield part
                if fault:
                    if lost is None:
                        lost, why, inner = at, fault, span
                    at = src.find(max(at, here + 1), (GZIP, VERSION))
                continue
            if src.peek(7) != VERSION:
                raise Damaged("neither gzip member nor version line")
            head, found = parse(src, keep)
        except Damaged as e:
            if lost is None:
                lost, why, inner = at, str(e), (None, None)
            at = src.find(at + 1, (GZIP, VERSION))
            continue
        if lost is not None:
            yield "gap", lost, at, *inner, why, None
            lost = None
        yield "record", at, src.pos, None, None, head, found
        at = src.pos
    if lost is not None:
        yield "gap", lost, size, *inner, why, None


def damaged(manifest: DataFrame, hurt: Callable[[int | None], bool]) -> DataFrame:
    """Copies of written archives, and their manifest, in which the middle byte of every record whose page `hurt` names is inverted.

    For trying out salvage: each record is a member of its own, and a file is read whole.
    """
    path = new_path(manifest.sparkSession, "warc-damaged")

    def run(batches):
        system, folder = pafs.FileSystem.from_uri(path)
        system.create_dir(folder, recursive=True)
        for batch in batches:
            for file in batch.column(0).to_pylist():
                source, at = pafs.FileSystem.from_uri(file)
                with source.open_input_file(at) as f:
                    data = bytearray(f.read())
                for kind, start, end, _, _, head, _ in salvage(io.BytesIO(bytes(data)), len(data), -1):
                    if kind == "record" and hurt(int(head["x-page-id"]) if "x-page-id" in head else None):
                        data[(start + end) // 2] ^= 0xFF
                name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                with system.open_output_stream(name, compression=None) as out:
                    out.write(bytes(data))
                yield pa.RecordBatch.from_arrays([pa.array([root(path, folder) + name]), pa.array([len(data)], pa.int64())], ["file", "bytes"])

    return written(manifest.select("file").mapInArrow(run, "file string, bytes long"), "warc-damaged-manifest")


SCHEMA = "file string, kind string, start long, end long, inner_start long, inner_end long, reason string, record_type string, page_id long, uri string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def read_warc(manifest: DataFrame, with_payload: bool = True, keep: int = KEEP) -> DataFrame:
    """Read the files named in manifest.file: a row per record, and per quarantined gap with its bytes and reason.

    payload_digest is the lower-case hex SHA-1 and payload_bytes the length of the full payload, for a revisit
    too, which states both. The payload of a record that is not of type application/http is its whole block. payload
    is null without with_payload, for revisits, and if it has more than `keep` bytes. A record without a page id, or a revisit without what it should state, has nulls there. A
    file that is empty gives no rows; one with no valid record is one gap. Null names are ignored. A task reads
    files of some TASK_BYTES in all, if the manifest has their bytes, else one. A gap's reason is the first check that
    failed; a record's is null, or a note on what could not be checked or differs.
    """
    spark, total = manifest.sparkSession, F.sum("bytes") if "bytes" in manifest.columns else F.count("*") * TASK_BYTES
    files, size = manifest.agg(F.count("*"), F.coalesce(total, F.lit(0))).first()
    n = max(1, min(files, max(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))))

    def read(batches):
        names = "file kind start end inner_start inner_end reason record_type page_id uri payload_bytes payload_digest refers_to payload".split()
        types = [pa.string(), pa.string(), *[pa.int64()] * 4, pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for file in batch.column(0).to_pylist():
                system, path = pafs.FileSystem.from_uri(file)
                rows, held = [], 0
                with system.open_input_file(path) as f:
                    for kind, *places, head, found in salvage(f, f.size(), keep if with_payload else -1):
                        if kind == "gap":
                            rows.append((file, kind, *places, head, *[None] * 7))
                        else:
                            rows.append((file, kind, *places, found["note"], *described(head, found)))
                            held += len(rows[-1][-1] or b"")
                        if len(rows) >= 5000 or held > 32 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return manifest.where("file IS NOT NULL").select("file").repartition(n).mapInArrow(read, SCHEMA)


def described(head: dict, found: dict) -> tuple:
    number = lambda k: int(head[k]) if re.fullmatch(r"-?[0-9]+", head.get(k, "")) else None
    stated = re.search(rb"(?im)^content-length:\s*([0-9]+)", found["http"])
    own, digest = head["warc-type"] != "revisit", head.get("warc-payload-digest", "")
    try:
        digest = base64.b32decode(digest[5:]).hex() if digest.startswith("sha1:") else None
    except ValueError:
        digest = None
    size = found["size"] if own else int(stated[1]) if stated else None
    return head["warc-type"], number("x-page-id"), head.get("warc-target-uri"), size, found["digest"] if own else digest, number("x-refers-to-page-id"), found["payload"] if own else None
