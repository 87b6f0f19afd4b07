"""Media columns: Ogg bitstreams written from and read back to bytes.

Reading verifies each page's checksum, reassembles packets from lacing values, demultiplexes the
logical streams and derives timestamps from granule positions.  The granule of these streams is
one 8-bit sample at ``RATE`` samples a second.

Null text is an empty text; an empty payload is 64 zero bytes.  A damaged page, a gap in the page
sequence or a stream without an end raises ``ValueError``.  Every row stands alone, so repeated
rows give repeated results and memory is bounded by the longest text of a batch.  An empty table gives
no rows; columns other than id and text are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .staging import small_batches
from .textbytes import as_bytes

RATE = 8000
#: Payload bytes of one packet, and packets of one page.
PACKET = 4096
PACKETS = 4
#: Logical streams that take turns packet by packet.
STREAMS = 2
_HEAD = struct.Struct("<4sBBqIIIB")
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_checksum(page: bytes) -> int:
    """CRC-32 with polynomial 0x04C11DB7, most significant bit first, no inversion.

    zlib's CRC is the same polynomial with bits reversed, so bytes and result are reversed around it.
    """
    crc = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "big").translate(_REVERSED), "little")


def _page(flags: int, granule: int, serial: int, sequence: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, flags, granule, serial, sequence, 0, len(lacing)) + lacing
    page = head + body
    return page[:22] + page_checksum(page).to_bytes(4, "little") + page[26:]


def write_stream(packets: list[bytes], granules: list[int], serial: int) -> list[bytes]:
    """Pages of one logical stream; a page ends after ``PACKETS`` packets or 255 lacing values."""
    pages: list[bytes] = []
    lacing, body, ended, carried = bytearray(), bytearray(), -1, False

    def flush(last: bool) -> None:
        nonlocal ended, carried
        open_end = bool(lacing) and lacing[-1] == 255
        flags = (1 if carried else 0) | (0 if pages else 2) | (4 if last else 0)
        pages.append(_page(flags, ended, serial, len(pages), bytes(lacing), bytes(body)))
        carried, ended = open_end, -1
        lacing.clear()
        body.clear()

    for k, (packet, granule) in enumerate(zip(packets, granules, strict=True)):
        values, at = [255] * (len(packet) // 255) + [len(packet) % 255], 0
        while values:
            room = 255 - len(lacing)
            if not room:
                flush(False)
                continue
            part, values = values[:room], values[room:]
            n = sum(part)
            lacing += bytes(part)
            body += packet[at : at + n]
            at += n
        ended = granule
        if (k + 1) % PACKETS == 0 and k + 1 < len(packets):
            flush(False)
    flush(True)
    return pages


def encode(payload: bytes) -> bytes:
    """An Ogg file whose logical streams hold the payload's packets in turn, each after a header packet."""
    parts = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    streams = []
    for s in range(STREAMS):
        own = parts[s::STREAMS]
        granules = np.cumsum([0] + [len(p) for p in own]).tolist()
        header = b"\x01bytes8" + struct.pack("<IBI", RATE, STREAMS, s)
        streams.append(write_stream([header, *own], granules, 0x5EED0 + s))
    rounds = max(map(len, streams))
    return b"".join(pages[k] for k in range(rounds) for pages in streams if k < len(pages))


def read_pages(data: bytes) -> Iterator[tuple[int, int, int, int, bytes, bytes]]:
    """(flags, granule, serial, sequence, lacing, body) of each page, its checksum verified."""
    at = 0
    while at < len(data):
        if len(data) - at < _HEAD.size:
            raise ValueError(f"page header cut short at byte {at}")
        magic, version, flags, granule, serial, sequence, crc, n = _HEAD.unpack_from(data, at)
        if magic != b"OggS" or version:
            raise ValueError(f"no page at byte {at}")
        body_at = at + _HEAD.size + n
        lacing = data[at + _HEAD.size : body_at]
        end = body_at + sum(lacing)
        if end > len(data):
            raise ValueError(f"page cut short at byte {at}")
        if page_checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise ValueError(f"checksum of the page at byte {at} is wrong")
        yield flags, granule, serial, sequence, lacing, data[body_at:end]
        at = end


def demux(data: bytes) -> dict[int, dict]:
    """Per serial number: packets, the sample time at which each page's last packet ends, page count."""
    streams: dict[int, dict] = {}
    for flags, granule, serial, sequence, lacing, body in read_pages(data):
        if flags & 2:
            if serial in streams:
                raise ValueError(f"stream {serial} begins twice")
            streams[serial] = {"packets": [], "ends": [], "pages": 0, "part": b"", "open": False, "done": False}
        s = streams.get(serial)
        if s is None or s["done"] or sequence != s["pages"]:
            raise ValueError(f"stream {serial} misses a page before {sequence}")
        if bool(flags & 1) != s["open"]:
            raise ValueError(f"stream {serial} breaks a packet at page {sequence}")
        at = 0
        for value in lacing:
            s["part"] += body[at : at + value]
            at += value
            s["open"] = value == 255
            if not s["open"]:
                s["packets"].append(s["part"])
                s["part"] = b""
        s["pages"] += 1
        s["done"] = bool(flags & 4)
        if granule >= 0:
            s["ends"].append(granule / RATE)
    if any(not s["done"] or s["open"] for s in streams.values()):
        raise ValueError("a stream has no end")
    return streams


def decode(data: bytes) -> tuple[bytes, dict]:
    """The payload and what the container says of it."""
    streams = demux(data)
    order = sorted(streams.values(), key=lambda s: struct.unpack("<IBI", s["packets"][0][7:])[2])
    bodies = [s["packets"][1:] for s in order]
    rounds = max(map(len, bodies))
    payload = b"".join(b[k] for k in range(rounds) for b in bodies if k < len(b))
    return payload, {
        "streams": len(order),
        "pages": sum(s["pages"] for s in order),
        "packets": sum(map(len, bodies)),
        "seconds": [s["ends"][-1] for s in order],
        "page_ends": [s["ends"] for s in order],
    }


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % 64 if text else 64)


COLUMNS = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_bytes", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_sha256", pa.string()),
        ("tail_crc32", pa.int64()),
        ("media_bytes", pa.int64()),
        ("media_sha256", pa.string()),
        ("feature", pa.string()),
    ]
)
DDL = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_row(text: bytes) -> tuple:
    """The digest columns, all taken from the stored bytes that were read back."""
    media = encode(padded(text))
    payload, said = decode(media)
    samples = np.frombuffer(payload, np.uint8).astype(np.float32) - 128
    feature = (
        f"streams={said['streams']};pages={said['pages']};packets={said['packets']};"
        f"seconds={'/'.join(f'{x:.6f}' for x in said['seconds'])};"
        f"mean={float(samples.mean(dtype=np.float64)):.4f};rms={float(np.sqrt((samples**2).mean(dtype=np.float64))):.4f};"
        f"crossings={int(np.count_nonzero(np.diff(np.signbit(samples))))}"
    )
    return len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature


def media_columns(docs: DataFrame) -> DataFrame:
    """doc_id and the digest of each text stored as an Ogg file."""
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [media_row(t) for t in as_bytes(batch.column(1))]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * (len(COLUMNS) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(COLUMNS)[1:], strict=True))], schema=COLUMNS)

    return docs.select("doc_id", "text").mapInArrow(work, DDL)


def op3_ogg_media(spark, sf_dir: str) -> DataFrame:
    return media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"))
