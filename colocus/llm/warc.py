"""WARC archives with revisit records and an index merged from sorted runs.

Each writing task makes one run: a WARC file whose records are sorted by URL
key and capture time, and an index of it in the same order. The runs' indexes
are then merged by ranges of the key: every range reads its slice of each run
and a loser tree yields the captures in global order. More than FAN_IN runs are
merged in passes, each pass by groups of runs and ranges of the key.
"""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colocus.llm.common import put_file, saved, shared_folder, store_of

RUN_BYTES = 64 << 20
#: Index lines between two entries of a run's sparse index.
STRIDE = 256
#: Runs that meet in one merge (some more by chance), bytes of one read of an index, of one written piece of it, and of WARC files that one task reads.
FAN_IN, READ_BYTES, PIECE_BYTES, TASK_BYTES = 64, 1 << 18, 8 << 20, 32 << 20
#: Keys of sparse indexes from which cut points are picked.
MOST_CUTS = 20_000
EPOCH = dt.datetime(2020, 1, 1, tzinfo=dt.UTC)
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
CRLF = b"\r\n"


_ADDRESS = re.compile(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)(.*)", re.S)


def one_line(url: str) -> str:
    """A URL without white space, control characters and line separators: they are percent-encoded, those at the ends cut off."""
    return re.sub(r"[\x00-\x20\x7f-\x9f\s\u2028\u2029]", lambda c: "".join(f"%{b:02X}" for b in c[0].encode()), url.strip())


def url_key(url: str | None) -> str:
    """Host labels reversed and joined by commas, ``)``, path and query; lower case, no fragment or default port. Any string has a key."""
    text = one_line(url or "").partition("#")[0]
    found = _ADDRESS.match(text)
    host, rest = (found[1].rpartition("@")[2].lower(), found[2]) if found else ("", text)
    for port in (":80", ":443"):
        host = host.removesuffix(port)
    rest = rest if rest[:1] not in ("", "?") else "/" + rest
    return one_line((",".join(reversed(host.split("."))) + ")" + rest).lower())


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, extra: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page {page_id} {extra}')}>"


def _lines(pairs: list[tuple[str, str]]) -> bytes:
    return b"".join(f"{k}: {v}".encode() + CRLF for k, v in pairs)


def build_record(page_id: int | None, url: str | None, date: str, payload: bytes, first: int | None, revisit: bool) -> bytes:
    """One gzip member with a response or, for a payload that ``first`` already has, a revisit record."""
    digest = payload_digest(payload)
    block = b"HTTP/1.1 200 OK\r\n" + _lines([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]) + CRLF
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", one_line(url)))
    head.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(first)), ("X-Refers-To-Page-ID", str(first)), ("WARC-Truncated", "length")]
    else:
        block += payload
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    raw = b"WARC/1.1\r\n" + _lines(head) + CRLF + block + CRLF + CRLF
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def parse_record(member) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one gzip member."""
    raw = zlib.decompress(member, 31)
    top, _, rest = raw.partition(CRLF + CRLF)
    warc = dict(x.split(": ", 1) for x in top.decode().split("\r\n")[1:])  # no value has a line break
    block = rest[: int(warc["Content-Length"])]
    http_top, _, payload = block.partition(CRLF + CRLF)
    http = dict(x.split(": ", 1) for x in http_top.decode().split("\r\n")[1:])
    return warc, http, payload


class LoserTree:
    """Merges sorted iterators: each inner node keeps the loser of its match, so a step replays one path."""

    def __init__(self, streams: list[Iterator]):
        self.streams = [iter(s) for s in streams]
        self.k = max(1, len(streams))
        self.heads = [next(s, None) for s in self.streams] or [None]
        self.losers = [-1] * self.k
        self.winner = self._play(1) if self.k > 1 else 0

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) <= (y, b))

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        a, b = (a, b) if self._beats(a, b) else (b, a)
        self.losers[node] = b
        return a

    def __iter__(self):
        while self.heads[self.winner] is not None:
            at = self.winner
            yield self.heads[at]
            self.heads[at] = next(self.streams[at], None)
            node = (at + self.k) // 2
            while node >= 1 and self.k > 1:
                if self._beats(self.losers[node], at):
                    self.losers[node], at = at, self.losers[node]
                node //= 2
            self.winner = at


def capture_time(page_id: Column) -> Column:
    """Seconds since EPOCH; pages have no time of their own, so the page_id stands in (0 for null)."""
    return F.pmod(F.coalesce(page_id, F.lit(0)), F.lit(3_000_000_000))


def _date(seconds: int) -> str:
    return (EPOCH + dt.timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%SZ")


_MARK = "struct<key:string,seconds:long,order:long,at:long>"
_PIECES = f"run string, piece string, records long, bytes long, sparse array<{_MARK}>, last {_MARK}"
_MARKS = pa.struct([("key", pa.string()), ("seconds", pa.int64()), ("order", pa.int64()), ("at", pa.int64())])
_PIECE = pa.schema([("run", pa.string()), ("piece", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sparse", pa.list_(_MARKS)), ("last", _MARKS)])


def _mark(place: tuple, at: int) -> dict:
    return {"key": place[0], "seconds": place[1], "order": place[2], "at": at}


class Piece:
    """Index lines of one file, with an entry of the sparse index for every STRIDE of them."""

    def __init__(self):
        self.lines, self.sparse, self.bytes, self.last = [], [], 0, None

    def add(self, place: tuple, entry: str) -> None:
        line = f"{place[0]} {place[1]:012d} {place[2]:020d} {entry}\n".encode()
        if len(self.lines) % STRIDE == 0:
            self.sparse.append(_mark(place, self.bytes))
        self.lines.append(line)
        self.bytes += len(line)
        self.last = place

    def write(self, run: str, uri: str) -> pa.RecordBatch:
        put_file(uri, b"".join(self.lines))
        return pa.RecordBatch.from_pylist([{"run": run, "piece": uri, "records": len(self.lines), "bytes": self.bytes, "sparse": self.sparse, "last": _mark(self.last, self.bytes)}], schema=_PIECE)


def write_runs(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write WARC runs and their indexes; returns the manifest: run, piece (its index), records, bytes, sparse index, last key.

    pages needs page_id, url and html; other columns are left out. A null html
    is an empty payload, a null url has no target and the empty key; any string
    may be a url. Among records with equal payloads of at least ``least_bytes``
    bytes those with the smallest page_id are responses and the others revisits;
    rows without a page_id are responses only if no equal payload has one. An
    empty table gives no runs. Payloads with a copy are found by digest (partial
    aggregation); the join may be split where one payload is very frequent.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    many = rows.filter(F.length("payload") >= least_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select(F.col("sha").alias("_sha"), "first")
    marked = rows.join(many, F.col("sha") == F.col("_sha"), "left").select("page_id", "url", "payload", "first", capture_time(F.col("page_id")).alias("seconds"))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            held.sort(key=lambda r: r[:3])
            name, parts, piece, at = f"{folder}/{uuid.uuid4().hex}", [], Piece(), 0
            for *place, page_id, member in held:
                piece.add(tuple(place), json.dumps({"page": page_id, "offset": at, "length": len(member), "run": name}))
                parts.append(member)
                at += len(member)
            put_file(f"{name}.warc.gz", b"".join(parts))
            return piece.write(name, f"{name}.cdxj")

        for batch in stream:
            for page_id, url, payload, first, seconds in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                revisit = first is not None and page_id != first
                member = build_record(page_id, url, _date(seconds), payload, first, revisit)
                held.append((url_key(url) if url else "", seconds, (page_id if page_id is not None else -1) + 2**62, page_id, member))
                size += len(member)
                if size >= RUN_BYTES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return marked.mapInArrow(run, _PIECES)


def _slice(uri: str, start: int, end: int, low: tuple | None, high: tuple | None) -> Iterator[tuple]:
    """(key, seconds, order, entry) of an index file's bytes from start to end, for low <= place < high; read a block at a time."""
    fs, path = store_of(uri)
    with fs.open_input_file(path) as file:
        rest, at = b"", start
        while at < end or rest:
            block = file.read_at(min(READ_BYTES, end - at), at) if at < end else b""
            at += len(block)
            *lines, rest = (rest + block).split(b"\n")
            if not block and rest:
                raise ValueError(f"{uri} ends within a line")
            for line in lines:
                key, seconds, order, entry = line.decode().split(" ", 3)
                place = (key, int(seconds), int(order))
                if high is not None and place >= high:
                    return
                if low is None or place >= low:
                    yield (*place, entry)


def _slices(pieces: DataFrame, cuts: list[tuple], groups: int) -> DataFrame:
    """(group, range, piece, start, end): the bytes of each piece in which the captures of a range lie. Groups are dealt by run."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            out = []
            for r in batch.to_pylist():
                marks, at = [(m["key"], m["seconds"], m["order"]) for m in r["sparse"]], [m["at"] for m in r["sparse"]]
                last = (r["last"]["key"], r["last"]["seconds"], r["last"]["order"])
                for i in range(bisect_right(cuts, marks[0]), bisect_right(cuts, last) + 1):
                    start = at[max(0, bisect_right(marks, cuts[i - 1]) - 1)] if i else 0
                    past = bisect_left(marks, cuts[i]) if i < len(cuts) else len(marks)
                    out.append((zlib.crc32(r["run"].encode()) % groups, i, r["piece"], start, at[past] if past < len(marks) else r["bytes"]))
            for low in range(0, len(out), 8192):
                yield pa.RecordBatch.from_pydict({f.name: [x[j] for x in out[low : low + 8192]] for j, f in enumerate(schema)}, schema=schema)

    schema = pa.schema([("group", pa.int32()), ("range", pa.int32()), ("piece", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    return pieces.mapInArrow(run, "group int, range int, piece string, start long, end long")


def merge_index(manifest: DataFrame, folder: str, rows_each: int = 20_000, fan_in: int = FAN_IN) -> DataFrame:
    """All captures in global order of (URL key, time, page): range, place, url_key, seconds, run, offset, length, page_id.

    A task merges one range of keys of one group of runs and reads only the
    slices in which they lie. While there are more than ``fan_in`` runs, each
    group becomes one longer run; the last pass has one group. The driver holds
    at most some MOST_CUTS keys, picked by hash among those of the sparse
    indexes; tasks write and pass on as they go. Equal captures (same key, time
    and page) are in the order of their runs' files.
    """
    spark = manifest.sparkSession
    pieces = manifest
    size = pieces.agg(F.count_distinct("run").alias("runs"), F.sum("records").alias("records"), F.sum(F.size("sparse")).alias("marks")).first()
    runs, records = size["runs"], size["records"] or 0
    marks = pieces.select(F.explode("sparse").alias("m")).select("m.key", "m.seconds", "m.order")
    kept = F.pmod(F.xxhash64("key", "seconds", "order"), F.lit(max(1, -(-(size["marks"] or 0) // MOST_CUTS)))) == 0
    pool = sorted({tuple(r) for r in marks.filter(kept).collect()})
    level = 0
    while True:
        groups = 1 if runs <= fan_in else -(-runs // fan_in)
        parts = max(1, -(-records // (groups * rows_each)))
        cuts = sorted({pool[i * len(pool) // parts] for i in range(1, parts)}) if pool else []
        last, at = groups == 1, f"{folder}/level-{level}"

        def merge(stream: Iterator[pa.RecordBatch], cuts=cuts, last=last, at=at) -> Iterator[pa.RecordBatch]:
            def merged(group: int, i: int, slices: list[tuple]) -> Iterator[pa.RecordBatch]:
                low, high = cuts[i - 1] if i else None, cuts[i] if i < len(cuts) else None
                out, piece, n = [], Piece(), 0
                for place, (key, seconds, order, entry) in enumerate(LoserTree([_slice(*x, low, high) for x in sorted(slices)])):
                    if last:
                        e = json.loads(entry)
                        out.append((i, place, key, seconds, e["run"], e["offset"], e["length"], e["page"]))
                        if len(out) == 8192:
                            yield pa.RecordBatch.from_pydict({f.name: [r[j] for r in out] for j, f in enumerate(schema)}, schema=schema)
                            out = []
                    piece.add((key, seconds, order), entry)
                    if piece.bytes >= PIECE_BYTES:
                        row = piece.write(f"{at}/{group}", f"{at}/{group:05d}-{i:05d}-{n:05d}.cdxj")
                        piece, n = Piece(), n + 1
                        if not last:
                            yield row
                if piece.lines:
                    row = piece.write(f"{at}/{group}", f"{at}/{group:05d}-{i:05d}-{n:05d}.cdxj")
                    if not last:
                        yield row
                if out:
                    yield pa.RecordBatch.from_pydict({f.name: [r[j] for r in out] for j, f in enumerate(schema)}, schema=schema)

            now, held = None, []
            for batch in stream:
                for group, i, *x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if (group, i) != now and held:
                        yield from merged(*now, held)
                        held = []
                    now = (group, i)
                    held.append(tuple(x))
            if held:
                yield from merged(*now, held)

        schema = pa.schema([("range", pa.int32()), ("place", pa.int64()), ("url_key", pa.string()), ("seconds", pa.int64()), ("run", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64())])
        dealt = _slices(pieces, cuts, groups).repartition(max(1, groups * (len(cuts) + 1)), "group", "range").sortWithinPartitions("group", "range")
        if last:
            return dealt.mapInArrow(merge, "range int, place long, url_key string, seconds long, run string, offset long, length long, page_id long")
        pieces = saved(dealt.mapInArrow(merge, _PIECES), f"{at}/pieces")
        runs, level = groups, level + 1


def read_captures(index: DataFrame) -> DataFrame:
    """Follow the index into the archives: the record of each capture, with its range and place in the index.

    Captures are dealt by stretches of their files and read in file order. The
    bytes and digest of a response are those of the payload that was read, and
    must be what its headers say.
    """

    def read(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, file = None, None
        for batch in stream:
            out, held = [], 0
            for r in batch.to_pylist():
                if r["run"] != last:
                    if file:
                        file.close()
                    fs, path = store_of(f"{r['run']}.warc.gz")
                    last, file = r["run"], fs.open_input_file(path)
                warc, http, payload = parse_record(file.read_at(r["length"], r["offset"]))
                page, first, kind = warc.get("X-Page-ID"), warc.get("X-Refers-To-Page-ID"), warc["WARC-Type"]
                size, digest = int(http["Content-Length"]), warc["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response" and (len(payload), payload_digest(payload)) != (size, digest):
                    raise ValueError(f"{r['run']}.warc.gz at {r['offset']}: the payload is not what its headers say")
                out.append((int(page) if page is not None else None, warc.get("WARC-Target-URI"), size, digest, kind, int(first) if first is not None else None, payload, warc["WARC-Date"], r["range"], r["place"]))
                held += len(payload)
                if held >= PIECE_BYTES:
                    yield pa.RecordBatch.from_pydict({f.name: [x[j] for x in out] for j, f in enumerate(schema)}, schema=schema)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_pydict({f.name: [x[j] for x in out] for j, f in enumerate(schema)}, schema=schema)
        if file:
            file.close()

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("captured", pa.string()), ("range", pa.int32()), ("place", pa.int64())])
    stretch = F.floor(F.col("offset") / TASK_BYTES)
    dealt = index.withColumn("_stretch", stretch).repartition(F.col("run"), F.col("_stretch")).sortWithinPartitions("run", "offset").select("run", "offset", "length", "range", "place")
    return dealt.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, captured string, range int, place long")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "op9")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    manifest = saved(write_runs(pages, f"{folder}/warc"), f"{folder}/manifest")
    captures = read_captures(merge_index(manifest, f"{folder}/index"))
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "captured", "range", "place")
