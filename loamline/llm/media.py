"""Media columns: baseline JPEG.

Reading: markers are parsed, scans Huffman-decoded, and the DC coefficients of
the luminance component make a thumbnail of an eighth of the size.  Blocks with
AC coefficients are read past; any baseline file with interleaved components
will do.  Restart intervals are decoded side by side: each step of the decoder
takes the next symbol of every interval of every image in the batch at once.

Writing: a payload becomes a greyscale image of which each 8 x 8 block is even,
so that the DC levels are its bytes and the thumbnail holds it losslessly.  The
image is 64 blocks wide and as high as the payload needs (wider where a JPEG's
height would not do), with a restart after every 64 blocks.  Payloads beyond the
largest image go to several images one after another; such a file's height is
that of all of them and its hash that of all their hashes.

A column of media bytes is a plain binary column; `read` gives its dimensions,
thumbnail hash and payload digests as further columns.  The query writes the column
as a table in the shared folder and reads that.

Defined results: null and empty texts are payloads of 64 zero bytes; a null id
is kept; equal texts have equal media; bytes that are no baseline JPEG, null or
empty ones too, have null columns and say why in `error`; an empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.llm.store import Scratch

ROW, SIDE = 64, 8191
BATCH = 2 << 20
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

# The luminance DC table that baseline encoders use, as codes of each length and the categories in their order.
DC_COUNTS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_VALUES = tuple(range(12))
#: Of AC symbols only the end of a block occurs; its code is a single 0.
AC_COUNTS = (1,) + (0,) * 15
AC_VALUES = (0,)


def codes(counts, values) -> dict[int, tuple[int, int]]:
    """symbol: (code, length), numbered canonically."""
    out, code, k = {}, 0, 0
    for size, n in enumerate(counts, 1):
        for _ in range(n):
            out[values[k]] = (code, size)
            code, k = code + 1, k + 1
        code <<= 1
    return out


def lookup(counts, values) -> tuple[np.ndarray, np.ndarray]:
    """For the next 16 bits: the symbol and the length of its code, 0 where there is none."""
    symbol, size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    for s, (code, n) in codes(counts, values).items():
        at = code << (16 - n)
        symbol[at : at + (1 << (16 - n))] = s
        size[at : at + (1 << (16 - n))] = n
    return symbol, size


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For a DC difference + 255: its bits (code, amplitude, end of block) and their number."""
    dc = codes(DC_COUNTS, DC_VALUES)
    bits, size = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        cat = abs(d).bit_length()
        code, n = dc[cat]
        amplitude = d if d >= 0 else d + (1 << cat) - 1
        bits[d + 255], size[d + 255] = (code << cat | amplitude) << 1, n + cat + 1
    return bits, size


DIFF_BITS, DIFF_SIZE = _tables()


def shape_of(n: int) -> tuple[int, int]:
    """Blocks across and down for n payload bytes (a positive multiple of 64, at most one image's)."""
    rows = n // ROW
    wide = -(-rows // SIDE)
    return wide * ROW, -(-rows // wide)


LARGEST = (SIDE // ROW) * ROW * SIDE


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head(across: int, down: int, n: int) -> bytes:
    return b"".join(
        [
            b"\xff\xd8",
            _segment(0xFE, b"payload=%d" % n),
            _segment(0xDB, b"\x00" + bytes([8] * 64)),
            _segment(0xC0, struct.pack(">BHHB", 8, down * 8, across * 8, 1) + b"\x01\x11\x00"),
            _segment(0xC4, b"\x00" + bytes(DC_COUNTS) + bytes(DC_VALUES)),
            _segment(0xC4, b"\x10" + bytes(AC_COUNTS) + bytes(AC_VALUES)),
            _segment(0xDD, struct.pack(">H", ROW)),
            _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
        ]
    )


def encode(payloads: list[bytes]) -> list[bytes]:
    """Payloads (positive multiples of 64 bytes) as JPEG files."""
    images, owner = [], []
    for k, p in enumerate(payloads):
        for at in range(0, len(p), LARGEST):
            images.append(p[at : at + LARGEST])
            owner.append(k)
    shapes = [shape_of(len(p)) for p in images]
    full = [p if a * d == len(p) else p.ljust(a * d, b"\x00") for p, (a, d) in zip(images, shapes, strict=True)]
    x = np.frombuffer(b"".join(full), np.uint8).reshape(-1, ROW).astype(np.int64)
    diff = np.diff(x, axis=1, prepend=128) + 255
    bits, size = DIFF_BITS[diff], DIFF_SIZE[diff]
    ends = np.cumsum(size, axis=1)
    row_bits = ends[:, -1]
    row_bytes = (row_bits + 7) // 8
    row_at = np.cumsum(row_bytes) - row_bytes
    total = int(row_bytes.sum())
    at = (ends - size + 8 * row_at[:, None]).ravel()
    size, bits = size.ravel(), bits.ravel()
    word = bits << (24 - size - (at & 7))
    byte = at >> 3
    out = np.zeros(total + 3, np.int64)
    for k in range(3):
        out += np.bincount(byte + k, (word >> (16 - 8 * k)) & 255, total + 3).astype(np.int64)
    pad = row_bytes * 8 - row_bits
    out[row_at + row_bytes - 1] |= (1 << pad) - 1
    entropy = out[:total].astype(np.uint8)
    # A zero after every 255, and a restart marker after every row but an image's last.
    down = np.array([a * d // ROW for a, d in shapes])
    last = np.cumsum(down) - 1
    number = np.arange(len(x)) - np.repeat(last + 1 - down, down)
    cnt = 1 + (entropy == 255).astype(np.int64)
    marked = np.ones(len(x), bool)
    marked[last] = False
    tail = row_at + row_bytes - 1
    cnt[tail[marked]] += 2
    pos = np.cumsum(cnt) - cnt
    scan = np.zeros(int(cnt.sum()), np.uint8)
    scan[pos] = entropy
    after = pos[tail[marked]] + cnt[tail[marked]] - 2
    scan[after] = 0xFF
    scan[after + 1] = 0xD0 + number[marked] % 8
    stop = (pos[tail] + cnt[tail])[last]
    raw, begin = scan.tobytes(), 0
    files: list[list[bytes]] = [[] for _ in payloads]
    for k, (a, d), p, e in zip(owner, shapes, images, stop.tolist(), strict=True):
        files[k] += [_head(a, d, len(p)), raw[begin:e], b"\xff\xd9"]
        begin = e
    return [b"".join(f) for f in files]


class Image:
    """A parsed file: dimensions, components, tables, restart interval and the places of its scan."""

    def __init__(self):
        self.height = self.width = 0
        self.components: list[tuple[int, int, int, int]] = []
        self.quant: dict[int, int] = {}
        self.huff: dict[int, tuple[tuple, tuple]] = {}
        self.scan_tables: dict[int, tuple[int, int]] = {}
        self.restart = 0
        self.payload: int | None = None
        self.begin = self.end = 0

    @property
    def mcus(self) -> tuple[int, int]:
        h, v = max(c[1] for c in self.components), max(c[2] for c in self.components)
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))


def parse(data: bytes, at: int = 0) -> tuple[Image, int]:
    """The image whose file begins at a place, and the place after it."""
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    img, at = Image(), at + 2
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = data[at + 1]
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC0:
            _, img.height, img.width, n = struct.unpack_from(">BHHB", body)
            img.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only baseline files are read")
        elif marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                img.quant[body[k] & 15] = struct.unpack_from(">H", body, k + 1)[0] if wide else body[k + 1]
                k += 1 + 64 * (1 + wide)
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                counts = tuple(body[k + 1 : k + 17])
                img.huff[body[k]] = (counts, tuple(body[k + 17 : k + 17 + sum(counts)]))
                k += 17 + sum(counts)
        elif marker == 0xDD:
            img.restart = struct.unpack(">H", body)[0]
        elif marker == 0xFE and body.startswith(b"payload="):
            img.payload = int(body[8:])
        elif marker == 0xDA:
            img.scan_tables = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
            img.begin = at
            while True:
                at = data.find(b"\xff", at)
                if at < 0 or at + 1 >= len(data):
                    raise ValueError("the scan does not end")
                if data[at + 1] == 0 or 0xD0 <= data[at + 1] <= 0xD7:
                    # Restarts and stuffed bytes: the end is the first other marker, found in one search.
                    rest = np.frombuffer(data, np.uint8, offset=at)
                    ff = np.flatnonzero(rest[:-1] == 0xFF)
                    nxt = rest[ff + 1]
                    stop = ff[(nxt != 0) & ((nxt < 0xD0) | (nxt > 0xD7)) & (nxt != 0xFF)]
                    if not len(stop):
                        raise ValueError("the scan does not end")
                    at += int(stop[0])
                img.end = at
                break
            if data[at : at + 2] != b"\xff\xd9":
                raise ValueError("more than one scan")
            return img, at + 2


def thumbnails(files: list[bytes]) -> list[list[tuple[Image, np.ndarray]]]:
    """For each file its images, each with its DC-only luminance thumbnail (one value for a block of 8 x 8)."""
    out: list[list[tuple[Image, np.ndarray]]] = []
    alike: dict[tuple, list[tuple[int, int, Image, bytes]]] = {}
    for k, data in enumerate(files):
        out.append([])
        at = 0
        while at < len(data):
            img, nxt = parse(data, at)
            key = (tuple(img.components), tuple(sorted(img.quant.items())), tuple(sorted(img.huff.items())), tuple(sorted(img.scan_tables.items())))
            alike.setdefault(key, []).append((k, len(out[k]), img, data[img.begin : img.end]))
            out[k].append((img, np.zeros(0)))
            at = nxt
    for group in alike.values():
        for (k, i, img, _), dc in zip(group, _dc([g[2] for g in group], [g[3] for g in group]), strict=True):
            out[k][i] = (img, dc)
    return out


def _clean(scans: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Scans without stuffing and markers as one array, and where each scan's intervals begin in it."""
    raw = np.frombuffer(b"".join(scans), np.uint8)
    ff = raw == 0xFF
    nxt = np.append(raw[1:], 0)
    marker = ff & (nxt >= 0xD0) & (nxt <= 0xD7)
    drop = marker.copy()
    drop[1:] |= marker[:-1] | ff[:-1] & (raw[1:] == 0)
    place = np.cumsum(~drop)
    sizes = np.cumsum([len(s) for s in scans])
    starts, at = [], 0
    marks = np.flatnonzero(marker)
    edge = np.searchsorted(marks, sizes)
    low = 0
    for end, hi in zip(sizes.tolist(), edge.tolist(), strict=True):
        first = place[at - 1] if at else 0
        starts.append(np.append(first, place[marks[low:hi]]).astype(np.int64))
        at, low = end, hi
    return np.concatenate([raw[~drop], np.zeros(8, np.uint8)]), starts


def _dc(images: list[Image], scans: list[bytes]) -> list[np.ndarray]:
    """Thumbnails of images with the same tables: all intervals of all images step by step together."""
    one = images[0]
    data, starts = _clean(scans)
    units = []
    for c, (cid, h, v, q) in enumerate(one.components):
        td, ta = one.scan_tables[cid]
        units += [(c, lookup(*one.huff[td]), lookup(*one.huff[16 + ta]), one.quant[q])] * (h * v)
    luma = sum(1 for u in units if u[0] == 0)
    mcus = [img.mcus[0] * img.mcus[1] for img in images]
    if any(2 * n * len(units) > 8 * len(s) for n, s in zip(mcus, scans, strict=True)):
        raise ValueError("the scan is shorter than its blocks")
    counts = []
    for img, s, n in zip(images, starts, mcus, strict=True):
        each = img.restart or n
        c = np.full(len(s), each)
        c[-1] = n - each * (len(s) - 1)
        if c[-1] <= 0 or c[-1] > each:
            raise ValueError("restart intervals are missing")
        counts.append(c)
    bit, left = np.concatenate(starts) * 8, np.concatenate(counts)
    base = np.cumsum(left) - left
    found = np.zeros((int(left.sum()), luma), np.float64)
    pred = np.zeros((len(one.components), len(bit)), np.int64)
    own = np.arange(len(bit))
    for step in range(int(left.max())):
        own = own[left[own] > step]
        seen = 0
        for c, dc, ac, q in units:
            b = bit[own]
            cat, n = _symbol(data, b, dc)
            b = b + n
            diff = _amplitude(data, b, cat)
            b = b + cat
            pred[c, own] += diff
            if c == 0:
                found[base[own] + step, seen] = pred[c, own] * q
                seen += 1
            k = np.ones(len(b), np.int64)
            go = np.arange(len(b))
            while len(go):
                s, n = _symbol(data, b[go], ac)
                b[go] += n + (s & 15)
                k[go] += np.where(s == 0, 64, (s >> 4) + 1)
                go = go[k[go] < 64]
            bit[own] = b
    out, at = [], 0
    _, h, v, _ = one.components[0]
    for img, n in zip(images, mcus, strict=True):
        across, down = img.mcus
        t = found[at : at + n].reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
        t = t[: -(-img.height // 8), : -(-img.width // 8)]
        out.append(np.clip(np.rint(t / 8 + 128), 0, 255).astype(np.uint8))
        at += n
    return out


def _peek(data: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """The next 16 bits."""
    at = np.minimum(bit >> 3, len(data) - 3)
    w = data[at].astype(np.int64) << 16 | data[at + 1].astype(np.int64) << 8 | data[at + 2]
    return w >> (8 - (bit & 7)) & 0xFFFF


def _symbol(data: np.ndarray, bit: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    w = _peek(data, bit)
    n = table[1][w]
    if not n.all():
        raise ValueError("a code is not in its table")
    return table[0][w], n


def _amplitude(data: np.ndarray, bit: np.ndarray, size: np.ndarray) -> np.ndarray:
    v = _peek(data, bit) >> (16 - size)
    return np.where((size > 0) & (v < 1 << np.maximum(size - 1, 0)), v - (1 << size) + 1, v)


def thumbnail_hash(t: np.ndarray) -> str:
    """64 bits: whether each of 8 x 8 areas is lighter than the median area.  Small thumbnails repeat their edges."""
    t = np.pad(t, ((0, max(0, 8 - t.shape[0])), (0, max(0, 8 - t.shape[1]))), mode="edge").astype(np.float64)
    r, c = (np.arange(8) * n // 8 for n in t.shape)
    area = np.add.reduceat(np.add.reduceat(t, r, axis=0), c, axis=1)
    size = np.outer(np.diff(np.append(r, t.shape[0])), np.diff(np.append(c, t.shape[1])))
    area = area / size
    return np.packbits(area > np.median(area)).tobytes().hex()


def payload_of(text: bytes) -> bytes:
    """The text and zeros up to a positive multiple of 64 bytes."""
    return text.ljust(max(1, -(-len(text) // ROW)) * ROW, b"\x00")


def _in_parts(sizes: list[int], most: int = BATCH) -> Iterator[slice]:
    at, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield slice(at, i)
            at, held = i, 0
        held += n
    if at < len(sizes):
        yield slice(at, len(sizes))


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text's payload as a JPEG file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = [len(x.as_py() or b"") for x in b.column(1)]
            for s in _in_parts(sizes):
                col = b.column(1).slice(s.start, s.stop - s.start)
                media = encode([payload_of(x.as_py() or b"") for x in col])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s.start, s.stop - s.start), pa.array(sizes[s], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def decode(files: list[bytes | None]) -> list[tuple[list[tuple[Image, np.ndarray]], str | None]]:
    """For each file its images, or none and what is wrong with it."""
    try:
        got = thumbnails([f or b"" for f in files])
        return [(g, None if g else "no bytes") for g in got]
    except (ValueError, IndexError, KeyError, ZeroDivisionError, struct.error) as e:
        if len(files) == 1:
            return [([], f"{type(e).__name__}: {e}")]
    return [decode([f])[0] for f in files]


def file_hash(images: list[tuple[Image, np.ndarray]]) -> str:
    each = [thumbnail_hash(t) for _, t in images]
    return each[0] if len(each) == 1 else hashlib.sha256("".join(each).encode()).hexdigest()[:16]


def read(media: DataFrame, media_col: str = "media", with_payload: bool = False) -> DataFrame:
    """Columns before `media` and, from the file's bytes: width, height, thumbnail_hash, media_bytes, media_sha256, the payload's digests and `error`.

    Of columns with a clashing name those read from the file stay.
    """
    extra = [("width", "int"), ("height", "int"), ("thumbnail_hash", "string"), ("media_bytes", "long"), ("media_sha256", "string"), ("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("error", "string")]
    extra += [("payload", "binary")] * with_payload
    names = [c for c in media.columns if c != media_col and c.lower() not in dict(extra)]
    rows = media.select(*(F.col(f"`{c}`") for c in (*names, media_col)))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + [f"{n} {t}" for n, t in extra])
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = [len(x.as_py() or b"") for x in b.column(len(names))]
            for s in _in_parts(sizes):
                part = b.slice(s.start, s.stop - s.start)
                files = [x.as_py() for x in part.column(len(names))]
                cols: list[list] = [[] for _ in extra]
                for f, (images, error) in zip(files, decode(files), strict=True):
                    row: list = [None] * len(extra)
                    if images:
                        raw = b"".join(t.tobytes()[: img.payload] if img.payload is not None else t.tobytes() for img, t in images)
                        row = [images[0][0].width, sum(img.height for img, _ in images), file_hash(images), len(f), hashlib.sha256(f).hexdigest(), len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-ROW:]), None, raw][: len(extra)]
                    row[8] = error
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(names))), *(pa.array(c, kinds[t]) for c, (_, t) in zip(cols, extra, strict=True))], names=[*names, *(n for n, _ in extra)])

    return rows.mapInArrow(run, schema)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The query's columns: texts stored as a table of media, and what its bytes say when read back."""
    got = read(Scratch(docs.sparkSession, "media").save(store(docs, id_col, text_col)))
    feature = F.concat_ws(":", F.concat_ws("x", "width", "height"), "thumbnail_hash")
    return got.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
