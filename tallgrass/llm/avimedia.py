"""Media columns: AVI motion-JPEG videos as binary values, their frames, and the shots that they consist of.

Videos that are written here are 24 x 24 grey frames, each a lossless JPEG (Huffman-coded differences of neighbouring samples) in an AVI file with an index. Baseline JPEG would not give the
samples back as they were; the lossless process of the same standard does, and every frame is still coded by itself. Frames of many videos are coded
together: the code lengths of all samples are added up and the bits are summed into their bytes at once, and decoding goes through the samples of all frames in step.
Frames of other writers may be baseline JPEG of any size, grey or with two subsampled colour planes, with restart marks, and without Huffman tables, as motion JPEG allows; of them the luma plane counts.

A cut is a frame whose grey-level histogram differs from that of the frame before by more than is usual in its neighbourhood. The clips between cuts are the result.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDE, FPS = 24, 25
FRAME = SIDE * SIDE
#: Code lengths of the difference categories 0 to 8: fixed values of this writer; a reader takes them from each frame's table.
LENGTHS = (4, 4, 3, 3, 3, 4, 4, 2, 4)
#: Shots: histogram levels, frames on either side that tell what is usual, deviations above their mean, and the least difference of a cut.
LEVELS, AROUND, DEVIATIONS, LEAST = 16, 8, 2.5, 0.1
#: Frames that are coded at once; bytes of a column that are handled and sent on at once (a larger value alone).
TOGETHER, BATCH_BYTES = 4096, 4 << 20
#: Huffman tables of the JPEG standard for frames that bring none: class and number, 16 counts by length, symbols. Fixed values.
STANDARD_TABLES = {
    0x00: ("00010501010101010100000000000000", "000102030405060708090a0b"),
    0x01: ("00030101010101010101010000000000", "000102030405060708090a0b"),
    0x10: (
        "0002010303020403050504040000017d",
        "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a535455565758595a636465666768696a737475767778797a"
        "838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa",
    ),
    0x11: (
        "00020102040403040705040400010277",
        "000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a434445464748494a535455565758595a636465666768696a737475767778797a"
        "82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa",
    ),
}
#: Row and column of the coefficients of a block in the order in which they are coded: along the antidiagonals, to and fro.
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8)))
_COSINES = np.array([[(0.5 if u else 0.125**0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


def _canonical(counts: bytes, symbols: bytes) -> Iterator[tuple[int, int, int]]:
    """Symbol, code and length of a JPEG Huffman table: 16 counts by length, then the symbols."""
    code, at = 0, 0
    for length, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            yield s, code, length
            code += 1
        at += n
        code <<= 1


@functools.cache
def _tables() -> tuple[bytes, np.ndarray, np.ndarray]:
    """The writer's frame header; for each difference from -255 to 255 its bits and their number."""
    order = sorted(range(9), key=lambda s: (LENGTHS[s], s))
    counts, symbols = bytes(LENGTHS.count(n) for n in range(1, 17)), bytes(order)
    bits, sizes = np.zeros(511, np.uint32), np.zeros(511, np.int64)
    for s, code, length in _canonical(counts, symbols):
        for d in [0] if s == 0 else [*range(-(1 << s) + 1, -(1 << (s - 1)) + 1), *range(1 << (s - 1), 1 << s)]:
            bits[d + 255] = code << s | (d if d >= 0 else d + (1 << s) - 1)
            sizes[d + 255] = length + s
    segment = lambda marker, body: struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body
    header = b"\xff\xd8" + segment(0xC4, b"\0" + counts + symbols) + segment(0xC3, struct.pack(">BHHB", 8, SIDE, SIDE, 1) + b"\1\x11\0") + segment(0xDA, b"\1\1\0\1\0\0")
    return header, bits, sizes


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """A lossless JPEG for each row of samples (n by FRAME, uint8); none for no row."""
    header, bits, sizes = _tables()
    out = []
    for start in range(0, len(samples), TOGETHER):
        x = samples[start : start + TOGETHER].reshape(-1, SIDE, SIDE).astype(np.int16)
        d = np.empty_like(x)
        d[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
        d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
        d[:, 0, 0] = x[:, 0, 0] - 128
        d = d.reshape(len(x), FRAME) + 255
        v, n = bits[d], sizes[d]
        ends = np.cumsum(n, axis=1)
        length = (ends[:, -1] + 7) >> 3
        first = np.cumsum(length) - length
        at = ((first << 3)[:, None] + ends - n).ravel()
        v, n, total = v.ravel(), n.ravel(), int(length.sum())
        wide = v << (24 - n - (at & 7)).astype(np.uint32)
        byte = at >> 3
        buf = sum(np.bincount(byte + i, (wide >> np.uint32(16 - 8 * i)) & np.uint32(255), total + 2) for i in range(3))[:total].astype(np.uint8)
        buf[first + length - 1] |= ((1 << ((length << 3) - ends[:, -1])) - 1).astype(np.uint8)
        full = buf == 255
        count = full + 1  # a zero follows each full byte
        stuffed = np.repeat(buf, count)
        stuffed[(np.cumsum(count) - 1)[full]] = 0
        stop = np.cumsum(np.add.reduceat(count, first))
        data = stuffed.tobytes()
        out += [header + data[a:b] + b"\xff\xd9" for a, b in zip([0, *stop[:-1].tolist()], stop.tolist(), strict=True)]
    return out


@functools.lru_cache(maxsize=64)
def _reader(header: bytes) -> np.ndarray:
    """For each 16 bits ahead: the difference that they begin with, times 32, plus the number of its bits (0: no code)."""
    at, tables, frame = 2, {}, None
    while at < len(header):
        mark, marker, size = struct.unpack_from(">BBH", header, at)
        body = header[at + 4 : at + 2 + size]
        if mark != 0xFF:
            raise ValueError("damaged frame header")
        if marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xC3:
            frame = struct.unpack_from(">BHHB", body)
        elif marker == 0xDA and (body[0] != 1 or body[3] != 1 or body[5] != 0):
            raise ValueError("only one component with the left neighbour as predictor is read")
        at += 2 + size
    if frame != (8, SIDE, SIDE, 1) or 0 not in tables:
        raise ValueError("only lossless grey frames of 24 by 24 samples are read")
    ahead = np.arange(1 << 16)
    out = np.zeros(1 << 16, np.int32)
    for s, code, length in _canonical(*tables[0]):
        if length + s > 16:
            raise ValueError("codes beyond 16 bits aren't read")
        mine = ahead >> (16 - length) == code
        extra = (ahead[mine] >> (16 - length - s)) & ((1 << s) - 1)
        d = np.where(extra >> (s - 1) & 1, extra, extra - (1 << s) + 1) if s else np.zeros(mine.sum(), int)
        out[mine] = d * 32 + length + s
    return out


def _scan_start(frame: bytes) -> int:
    at = 2
    while True:
        if frame[:2] != b"\xff\xd8" or at + 4 > len(frame) or frame[at] != 0xFF:
            raise ValueError("a frame is no JPEG")
        marker, size = frame[at + 1], int.from_bytes(frame[at + 2 : at + 4], "big")
        at += 2 + size
        if marker == 0xDA:
            return at


def _decode_lossless(frames: list[bytes]) -> np.ndarray:
    """The samples of lossless frames of this writer's kind, n by FRAME, uint8."""
    out = np.empty((len(frames), FRAME), np.uint8)
    groups: dict[bytes, list[int]] = {}
    last = None
    for i, f in enumerate(frames):
        if last is None or not f.startswith(last):
            last = f[: _scan_start(f)]
        groups.setdefault(last, []).append(i)
    for header, members in groups.items():
        table = _reader(header)
        for start in range(0, len(members), TOGETHER):
            part = members[start : start + TOGETHER]
            scans = [frames[i][len(header) : -2] for i in part]
            if any(frames[i][-2:] != b"\xff\xd9" for i in part):
                raise ValueError("a frame has no end")
            raw = np.frombuffer(b"".join(scans), np.uint8)
            keep = np.ones(len(raw), bool)
            keep[1:] = ~((raw[1:] == 0) & (raw[:-1] == 255))
            size = np.array([len(s) for s in scans])
            first = np.concatenate(([0], np.cumsum(keep)))[np.cumsum(size) - size]
            b = np.concatenate((raw[keep], np.zeros(8, np.uint8))).astype(np.uint32)
            words = b[:-3] << np.uint32(24) | b[1:-2] << np.uint32(16) | b[2:-1] << np.uint32(8) | b[3:]
            at, end = first.astype(np.int64) << 3, len(words) - 1
            d = np.empty((FRAME, len(part)), np.int32)
            for k in range(FRAME):
                ahead = words[np.minimum(at >> 3, end)] << (at & 7).astype(np.uint32)
                got = table[ahead >> np.uint32(16)]
                d[k] = got >> 5
                at += got & 31
            if (np.diff(np.append(first, keep.sum())) != (at - (first << 3) + 7) >> 3).any():
                raise ValueError("a frame's data don't end where its samples do")
            x = d.T.reshape(-1, SIDE, SIDE)
            x[:, 0, 0] += 128
            x[:, :, 0] = np.cumsum(x[:, :, 0], axis=1)
            out[part] = np.cumsum(x, axis=2).astype(np.uint8).reshape(-1, FRAME)
    return out


def _lossless(frame: bytes) -> bool:
    """Whether a frame's header, up to its scan, has the marker of the lossless process."""
    at = 2
    while frame[:2] == b"\xff\xd8" and at + 4 <= len(frame) and frame[at] == 0xFF and frame[at + 1] != 0xDA:
        if frame[at + 1] == 0xC3:
            return True
        at += 2 + int.from_bytes(frame[at + 2 : at + 4], "big")
    return False


@functools.lru_cache(maxsize=64)
def _symbols(counts: bytes, symbols: bytes) -> list[int]:
    """For each 16 bits ahead: the symbol that they begin with, times 32, plus the length of its code (0: no code)."""
    out = np.zeros(1 << 16, np.int32)
    for s, code, length in _canonical(counts, symbols):
        out[code << (16 - length) : (code + 1) << (16 - length)] = s * 32 + length
    return out.tolist()


def decode_baseline(frame: bytes) -> np.ndarray:
    """The planes of a baseline JPEG, height by width by 1 (grey) or 3 (luma and two colour differences), uint8. Other processes and damaged frames raise ValueError."""
    quant, huff, restart, parts, size = {}, {k: (bytes.fromhex(a), bytes.fromhex(b)) for k, (a, b) in STANDARD_TABLES.items()}, 0, [], None
    at = 2
    while frame[:2] == b"\xff\xd8":
        if at + 4 > len(frame) or frame[at] != 0xFF:
            raise ValueError("a frame is no JPEG")
        marker, length = frame[at + 1], int.from_bytes(frame[at + 2 : at + 4], "big")
        body, at = frame[at + 4 : at + 2 + length], at + 2 + length
        if marker == 0xDB:
            while body:
                wide = 2 if body[0] >> 4 else 1
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else np.uint8).astype(np.int64)
                body = body[1 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                huff[body[0]] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            restart = int.from_bytes(body, "big")
        elif marker in (0xC0, 0xC1):
            bits, height, width, n = struct.unpack_from(">BHHB", body)
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            size = (height, width)
            if bits != 8 or n not in (1, 3) or not height or not width:
                raise ValueError("only frames with one or three planes of 8 bits are read")
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("only baseline and lossless frames are read")
        elif marker == 0xDA:
            tables = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            break
    if size is None or set(tables) != {p[0] for p in parts} or any(p[3] not in quant for p in parts):
        raise ValueError("a frame lacks a header, a table or an interleaved scan")
    if len(parts) == 1:
        parts = [(parts[0][0], 1, 1, parts[0][3])]
    wide, high = max(p[1] for p in parts), max(p[2] for p in parts)
    across, down = -(-size[1] // (8 * wide)), -(-size[0] // (8 * high))
    # where each block of a unit lies: plane, row and column within the unit
    unit = [(i, y, x) for i, (_, h, v, _) in enumerate(parts) for y in range(v) for x in range(h)]
    coef = [np.zeros((down * v, across * h, 64), np.int64) for _, h, v, _ in parts]
    dc, ac = ([_symbols(*huff[c << 4 | (tables[p[0]] >> 4 if c == 0 else tables[p[0]] & 15)]) for p in parts] for c in (0, 1))
    before, n_units = [0] * len(parts), across * down
    segments = iter(_segments(frame[at:]))
    for k in range(n_units):
        if k == 0 or (restart and k % restart == 0):
            data = next(segments, b"")
            stream, left, end = data + bytes(8), 0, 8 * len(data)
            before = [0] * len(parts)
        for i, y, x in unit:
            block = coef[i][k // across * parts[i][2] + y, k % across * parts[i][1] + x]
            z = 0
            while z < 64:
                ahead = int.from_bytes(stream[left >> 3 : (left >> 3) + 5], "big") >> (24 - (left & 7)) & 0xFFFF
                got = (dc if z == 0 else ac)[i][ahead]
                symbol, took = got >> 5, got & 31
                run, bits = symbol >> 4, symbol & 15
                left += took
                if not took or left > end:
                    raise ValueError("a frame's data are damaged")
                if z and symbol == 0:
                    break
                z += run if z else 0
                if bits:
                    value = int.from_bytes(stream[left >> 3 : (left >> 3) + 4], "big") >> (32 - bits - (left & 7)) & ((1 << bits) - 1)
                    left += bits
                    value = value if value >> (bits - 1) else value - (1 << bits) + 1
                    if z > 63:
                        raise ValueError("a frame's data are damaged")
                    block[z] = value
                if z == 0:
                    before[i] += int(block[0])
                    block[0] = before[i]
                z += 1
    planes = []
    for (_, h, v, q), c in zip(parts, coef, strict=True):
        flat = np.zeros((*c.shape[:2], 64))
        flat[:, :, ZIGZAG] = c * quant[q]
        x = np.einsum("ua,rcuv,vb->racb", _COSINES, flat.reshape(*c.shape[:2], 8, 8), _COSINES).reshape(8 * c.shape[0], 8 * c.shape[1])
        x = np.clip(np.rint(x + 128), 0, 255).astype(np.uint8)
        planes.append(x.repeat(high // v, axis=0).repeat(wide // h, axis=1)[: size[0], : size[1]])
    return np.stack(planes, axis=2)


def _segments(data: bytes) -> Iterator[bytes]:
    """The parts of a scan between restart marks, without the zeros after full bytes, up to the next other mark."""
    start, at = 0, 0
    while True:
        at = data.find(b"\xff", at)
        mark = data[at + 1] if 0 <= at < len(data) - 1 else -1
        if mark == 0:
            at += 2
            continue
        if mark < 0:
            raise ValueError("a frame has no end")
        yield data[start:at].replace(b"\xff\0", b"\xff")
        if not 0xD0 <= mark <= 0xD7:
            return
        start = at = at + 2


def decode_frames(frames: list[bytes]) -> list[np.ndarray]:
    """The grey or luma samples of each frame, flat, uint8."""
    kinds = [_lossless(f) for f in frames]
    whole = iter(_decode_lossless([f for f, k in zip(frames, kinds, strict=True) if k]))
    return [next(whole) if k else decode_baseline(f)[:, :, 0].ravel() for f, k in zip(frames, kinds, strict=True)]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(frames: list[bytes]) -> bytes:
    """An AVI file of the frames, with an index; of no frame an empty one."""
    most = max(map(len, frames), default=0)
    main = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, len(frames), 0, 1, most, SIDE, SIDE, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIiI4H", 0, 0, 0, 0, 1, FPS, 0, len(frames), most, -1, 0, 0, 0, SIDE, SIDE)
    look = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", look)))
    at, index = 4, []
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += 8 + len(f) + (len(f) & 1)
    movie = _chunk(b"LIST", b"movi" + b"".join(_chunk(b"00dc", f) for f in frames))
    return _chunk(b"RIFF", b"AVI " + head + movie + _chunk(b"idx1", b"".join(index)))


def read_avi(data: bytes) -> tuple[list[bytes], float]:
    """The frames that the index of an AVI file names, and the seconds that each is shown."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    at, movie, index, seconds = 12, None, None, 1 / FPS
    while at + 8 <= len(data):
        name, size = struct.unpack_from("<4sI", data, at)
        if name == b"LIST" and data[at + 8 : at + 12] == b"movi":
            movie = at + 8
        elif name == b"LIST" and data[at + 8 : at + 16] == b"hdrlavih":
            seconds = struct.unpack_from("<I", data, at + 20)[0] / 1e6
        elif name == b"idx1":
            index = (at + 8, size // 16)
        at += 8 + size + (size & 1)
    if movie is None or index is None:
        raise ValueError("the AVI file has no frames or no index")
    frames = []
    entries = [e for e in struct.iter_unpack("<4sIII", data[index[0] : index[0] + 16 * index[1]]) if e[0][2:] in (b"dc", b"db") and e[3]]
    base = movie if not entries or data[movie + entries[0][2] : movie + entries[0][2] + 4] == entries[0][0] else 0  # some writers count from the file's begin
    for name, _, offset, size in entries:
        start = base + offset
        if data[start : start + 4] != name or struct.unpack_from("<I", data, start + 4)[0] != size:
            raise ValueError("the index of the AVI file is damaged")
        frames.append(data[start + 8 : start + 8 + size])
    return frames, seconds


def histograms(samples: list[np.ndarray]) -> np.ndarray:
    """For each frame the shares of LEVELS grey levels."""
    sizes = np.array([len(x) for x in samples])
    if not len(sizes):
        return np.zeros((0, LEVELS))
    frame = np.repeat(np.arange(len(sizes)), sizes)
    return np.bincount(frame * LEVELS + np.concatenate(samples) // (256 // LEVELS), minlength=len(sizes) * LEVELS).reshape(-1, LEVELS) / sizes[:, None]


def shots(hist: np.ndarray, video: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each frame begins a clip, and its histogram's difference (0 to 1) from the frame before it in its video (0 for the first)."""
    n = len(hist)
    if not n:
        return np.zeros(0, bool), np.zeros(0)
    new = np.concatenate(([True], video[1:] != video[:-1]))
    change = np.zeros(n)
    change[1:] = np.round(np.abs(hist[1:] - hist[:-1]).sum(axis=1) / 2, 6)
    change[new] = 0
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0)) + 1  # the first frame that has one before it
    last = np.append(np.flatnonzero(new)[1:], n)[np.cumsum(new) - 1]
    lo, hi = np.maximum(first, np.arange(n) - AROUND), np.minimum(last, np.arange(n) + AROUND + 1)
    total, square = (np.concatenate(([0.0], np.cumsum(c))) for c in (change, change**2))
    size = np.maximum(hi - lo - 1, 1)  # without the frame itself
    mean = np.maximum(total[hi] - total[lo] - change, 0) / size
    spread = np.sqrt(np.maximum((square[hi] - square[lo] - change**2) / size - mean**2, 0))
    return new | (change > np.round(np.maximum(mean + DEVIATIONS * spread, LEAST), 9)), change


def _by_bytes(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The rows of batches in slices with about BATCH_BYTES bytes of a column, a larger row alone."""
    for b in batches:
        total = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + BATCH_BYTES, side="right")))
            yield b.slice(at, end - at)
            at = end


def payload_of(text: str | None) -> bytes:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b"\xff" * (-len(data) % FRAME or (FRAME if not data else 0))


def store_videos(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id_col, n_bytes and media for each row of docs: its text's UTF-8 bytes, filled up with bytes 255 to full frames, as the samples of an AVI file.

    Null and empty texts give one frame of 255. Repeated rows and null ids are kept, other columns are ignored. A video holds at most 4 GB.
    """

    def run(batches):
        for part in _by_bytes(batches, 1):
            texts = part.column(1).to_pylist()
            payloads = [payload_of(t) for t in texts]
            frames = encode_frames(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, FRAME))
            media, k = [], 0
            for p in payloads:
                n = len(p) // FRAME
                media.append(write_avi(frames[k : k + n]))
                k += n
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len((t or "").encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=[id_col, "n_bytes", "media"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes bigint, media binary")


CLIPS = "array<struct<first_frame:int,last_frame:int,start_s:double,end_s:double,change:double>>"


def analyse_videos(videos: DataFrame, *, media_col: str = "media") -> DataFrame:
    """Adds payload (the grey or luma samples of all frames) and clips (an array of struct<first_frame, last_frame, start_s, end_s, change>) to videos; columns of these names are replaced.

    A null video has a null payload and null clips; a video without frames an empty payload and no clip. Broken files raise ValueError.
    """
    kept = videos.drop("payload", "clips")
    kind = pa.list_(pa.struct([("first_frame", pa.int32()), ("last_frame", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("change", pa.float64())]))
    place = kept.columns.index(media_col)

    def run(batches):
        for part in _by_bytes(batches, place):
            read = [None if m is None else read_avi(m) for m in part.column(place).to_pylist()]
            counts = [0 if r is None else len(r[0]) for r in read]
            samples = decode_frames([f for r in read if r for f in r[0]])
            begins, change = shots(histograms(samples), np.repeat(np.arange(len(read)), counts))
            payloads, clips, k = [], [], 0
            for r, n in zip(read, counts, strict=True):
                if r is None:
                    payloads.append(None)
                    clips.append(None)
                    continue
                payloads.append(b"".join(x.tobytes() for x in samples[k : k + n]))
                starts = np.flatnonzero(begins[k : k + n])
                ends = np.append(starts[1:], n)
                clips.append([dict(first_frame=int(s), last_frame=int(e - 1), start_s=round(s * r[1], 6), end_s=round(e * r[1], 6), change=float(change[k + s])) for s, e in zip(starts, ends, strict=True)] if n else [])
                k += n
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(payloads, pa.binary()), pa.array(clips, kind)], names=[*part.schema.names, "payload", "clips"])

    return kept.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + f", payload binary, clips {CLIPS}")


def clip_rows(videos: DataFrame, *, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row for each clip of each video: id_col, clip (from 0), first_frame, last_frame, start_s, end_s, change. Null videos and videos without frames have none; repeated rows give repeated clips."""
    found = analyse_videos(videos.select(id_col, media_col), media_col=media_col)
    return found.select(id_col, F.posexplode("clips").alias("clip", "c")).select(id_col, "clip", "c.*")


def op4_avi_mjpeg(spark, sf_dir: str) -> DataFrame:
    """The video that stores each whole text of documents, digests of it and of the payload that is read back, and as feature its timed clips: start-end in seconds, joined by commas."""
    found = analyse_videos(store_videos(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    size = F.octet_length("payload")
    return found.select(
        "doc_id", "n_bytes", size.cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.substr("payload", size - 31, F.lit(32))).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.array_join(F.transform("clips", lambda c: F.concat_ws("-", c["start_s"], c["end_s"])), ",").alias("feature"),
    )
