"""Media columns: motion-JPEG in AVI.

A video is a binary column that holds an AVI file whose frames are JPEG images, each decodable by itself. This
module writes and reads such files: it walks RIFF chunks, finds frames by the idx1 index, decodes the brightness of
baseline JPEG (grey or colour, with restart intervals, and without tables of its own, as motion-JPEG frames usually
are) and of lossless grey JPEG (SOF3), and cuts the frames into shots where the histogram changes more than an
adaptive threshold. Payload bytes are stored without loss as 8-bit samples of lossless frames.
"""

from __future__ import annotations

import functools
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relslice.llm.arrowmap import add_columns, column

#: Samples in a row, and rows in a full frame: half a kilobyte, so that most texts have several frames to find shots in.
WIDTH, HEIGHT = 64, 8
FRAMES_PER_SECOND = 25

#: Frames coded or decoded together; what that takes beside the file is bounded by them.
GROUP = 256

#: Bits of every sample in the lossless frames written here: see :func:`_difference_codes`.
SAMPLE_BITS = 9


# Writing ------------------------------------------------------------------------------------------------------


def _huffman_table() -> bytes:
    """A DHT segment whose code for differences of s extra bits has 9 - s bits, so that code and extra bits are 9 always."""
    counts = [1] * 9 + [0] * 7
    return _segment(0xC4, bytes([0x00, *counts, *range(8, -1, -1)]))


@functools.cache
def _difference_codes() -> tuple[np.ndarray, np.ndarray]:
    """(code by difference + 255, difference by code): the 9 bits of each difference of two samples."""
    code, back = np.zeros(511, np.uint16), np.zeros(512, np.int16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        prefix = (1 << 9 - s) - 2  # 8 - s ones, then a zero
        extra = d if d >= 0 else d + (1 << s) - 1
        code[d + 255] = prefix << s | extra
        back[code[d + 255]] = d
    return code, back


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def lossless_frames(samples: np.ndarray) -> list[bytes]:
    """One lossless grey JPEG per frame of a (frames, rows, columns) array of bytes.

    Samples are predicted from the left, those of the first column from above, the first of all as 128.
    """
    frames, rows, columns = samples.shape
    wide = samples.astype(np.int16)
    diff = np.empty_like(wide)
    diff[:, :, 1:] = wide[:, :, 1:] - wide[:, :, :-1]
    diff[:, 1:, 0] = wide[:, 1:, 0] - wide[:, :-1, 0]
    diff[:, 0, 0] = wide[:, 0, 0] - 128
    code = _difference_codes()[0][diff.reshape(frames, -1) + 255].astype(">u2")
    bits = np.unpackbits(code.view(np.uint8).reshape(frames, -1, 2), axis=2)[:, :, 16 - SAMPLE_BITS :].reshape(frames, -1)
    pad = -bits.shape[1] % 8
    if pad:
        bits = np.concatenate([bits, np.ones((frames, pad), np.uint8)], axis=1)
    packed = np.packbits(bits, axis=1)
    head = b"\xff\xd8" + _segment(0xC3, struct.pack(">BHHB3B", 8, rows, columns, 1, 1, 0x11, 0)) + _huffman_table() + _segment(0xDA, bytes([1, 1, 0x00, 1, 0, 0]))
    return [head + p.tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for p in packed]


def _chunk(tag: bytes, body: bytes) -> bytes:
    return tag + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def avi(frames: list[bytes], width: int, height: int, note: bytes = b"", rate: int = FRAMES_PER_SECOND) -> bytes:
    """An AVI file of one motion-JPEG stream with an idx1 index; ``note`` goes into its INFO list as a comment."""
    largest = max(map(len, frames), default=0)
    main = struct.pack("<14I", 1_000_000 // rate, largest * rate, 0, 0x10, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, rate, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    image = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", image)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", note)) if note else b""
    movie, index, at = [b"movi"], [], 4
    for f in frames:
        movie.append(_chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(movie[-1])
    return _chunk(b"RIFF", b"AVI " + head + info + _chunk(b"LIST", b"".join(movie)) + _chunk(b"idx1", b"".join(index)))


def store_payload(payload: bytes) -> bytes:
    """The AVI file of a payload of a positive multiple of WIDTH bytes, one byte per sample, whole rows.

    The last frame is filled up with zero rows; the comment holds the number of payload bytes.
    """
    height = min(len(payload) // WIDTH, HEIGHT)
    coded, step = [], GROUP * height * WIDTH
    for at in range(0, len(payload), step):
        part = np.frombuffer(payload, np.uint8, min(step, len(payload) - at), at)
        samples = np.zeros((-(-part.size // (height * WIDTH)), height, WIDTH), np.uint8)
        samples.reshape(-1)[: part.size] = part
        coded += lossless_frames(samples)
    return avi(coded, WIDTH, height, b"payload=%d" % len(payload))


# Reading ------------------------------------------------------------------------------------------------------


def parse_avi(file: bytes) -> dict:
    """Width, height, seconds per frame, comment and (offset, length) of each frame of an AVI file.

    Frames are found by the idx1 index; without one, by walking the movi list. Anything else is a ValueError.
    """
    if file[:4] != b"RIFF" or file[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    out = {"width": 0, "height": 0, "frame_s": 0.0, "note": b"", "frames": []}
    index: list[tuple[int, int]] | None = None
    movie: tuple[int, int] | None = None
    todo = [(12, min(len(file), 8 + struct.unpack_from("<I", file, 4)[0]))]
    while todo:
        at, end = todo.pop()
        while at + 8 <= end:
            tag, size = file[at : at + 4], struct.unpack_from("<I", file, at + 4)[0]
            body, stop = at + 8, min(at + 8 + size, end)
            if tag == b"LIST":
                kind = file[body : body + 4]
                if kind == b"movi":
                    movie = (body, stop)
                else:
                    todo.append((body + 4, stop))
            elif tag == b"avih":
                micros = struct.unpack_from("<I", file, body)[0]
                out["frame_s"] = micros / 1e6
                out["width"], out["height"] = struct.unpack_from("<2I", file, body + 32)
            elif tag == b"ICMT":
                out["note"] = file[body:stop]
            elif tag == b"idx1":
                index = [struct.unpack_from("<2I", file, i + 8) for i in range(body, stop - 15, 16) if file[i + 2 : i + 4] in (b"dc", b"db")]
            at = body + size + size % 2
    if movie is None:
        raise ValueError("an AVI file without frames")
    start, stop = movie
    if index is not None:
        # Offsets count from the movi tag, or in some files from the start of the file.
        base = start if not index or file[start + index[0][0] : start + index[0][0] + 4][2:] in (b"dc", b"db") else 0
        out["frames"] = [(base + at + 8, size) for at, size in index]
    else:
        at = start + 4
        while at + 8 <= stop:
            size = struct.unpack_from("<I", file, at + 4)[0]
            if file[at + 2 : at + 4] in (b"dc", b"db"):
                out["frames"].append((at + 8, size))
            at += 8 + size + size % 2
    return out


def parse_jpeg(image: bytes) -> dict:
    """The segments of a JPEG image that decoding needs, and the entropy-coded bytes of its first scan."""
    if image[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG image")
    out: dict = {"tables": usual_tables(), "quant": {}, "restart": 0}
    at = 2
    while True:
        if image[at] != 0xFF:
            raise ValueError("no JPEG marker where one is due")
        marker, size = image[at + 1], struct.unpack_from(">H", image, at + 2)[0]
        body = image[at + 4 : at + 2 + size]
        at += 2 + size
        if marker in (0xC0, 0xC1, 0xC3):
            out["bits"], out["rows"], out["columns"], parts = struct.unpack_from(">BHHB", body)
            if out["bits"] != 8 or (parts != 1 and marker == 0xC3):
                raise ValueError("only images of 8 bits a sample are decoded, lossless ones if they are grey")
            out["kind"] = marker
            out["parts"] = {body[i]: (body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * parts, 3)}
        elif marker in (0xC2, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError(f"JPEG process {marker:#x} is not decoded")
        elif marker == 0xC4:
            i = 0
            while i < len(body):
                counts = body[i + 1 : i + 17]
                out["tables"][body[i]] = (tuple(counts), tuple(body[i + 17 : i + 17 + sum(counts)]))
                i += 17 + sum(counts)
        elif marker == 0xDB:
            i = 0
            while i < len(body):
                step = 2 if body[i] >> 4 else 1
                out["quant"][body[i] & 15] = struct.unpack_from(">64H" if step == 2 else ">64B", body, i + 1)
                i += 1 + 64 * step
        elif marker == 0xDD:
            out["restart"] = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            scan = body[1 : 1 + 2 * body[0]]
            out["scan"] = list(zip(scan[::2], scan[1::2], strict=True))  # (part, its Huffman tables)
            out["selected"], out["predictor"] = scan[1], body[1 + 2 * body[0]]
            end = image.rfind(b"\xff\xd9")
            out["data"] = image[at : end if end >= at else len(image)]
            return out


class _Bits:
    """Huffman symbols and plain bits from entropy-coded bytes between two restarts."""

    def __init__(self, data: bytes):
        self.data, self.at = data.replace(b"\xff\x00", b"\xff"), 0

    def take(self, n: int) -> int:
        first, end = self.at >> 3, self.at + n
        if end > 8 * len(self.data):
            raise ValueError("the image ends early")
        self.at = end
        last = (end + 7) >> 3
        return int.from_bytes(self.data[first:last], "big") >> 8 * last - end & (1 << n) - 1

    def symbol(self, table: dict) -> int:
        code = length = 0
        while (length, code) not in table:
            code, length = code << 1 | self.take(1), length + 1
            if length > 16:
                raise ValueError("no such Huffman code")
        return table[length, code]

    def signed(self, s: int) -> int:
        v = self.take(s) if s else 0
        return v if not s or v >> s - 1 else v - (1 << s) + 1


@functools.lru_cache(64)
def _codes(counts: tuple, symbols: tuple) -> dict:
    table, code, i = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            table[length, code] = symbols[i]
            code, i = code + 1, i + 1
        code <<= 1
    return table


def _undo_prediction(diff: np.ndarray) -> np.ndarray:
    """Samples of (frames, rows, columns) differences that were predicted from the left and, in column 0, from above."""
    wide = diff.astype(np.int32)
    wide[:, 0, 0] += 128
    wide[:, :, 0] = np.cumsum(wide[:, :, 0], axis=1)
    return np.cumsum(wide, axis=2).astype(np.uint8)


_ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8)))


@functools.cache
def _cosines() -> np.ndarray:
    x, u = np.meshgrid(np.arange(8), np.arange(8))
    c = np.cos((2 * x + 1) * u * np.pi / 16) / 2
    c[0] /= np.sqrt(2)
    return c


def decode_jpeg(image: bytes) -> np.ndarray:
    """The brightness of a JPEG image, lossless grey with predictor 1 or baseline, as a (rows, columns) array of bytes."""
    j = parse_jpeg(image)
    if j["kind"] != 0xC3:
        return _baseline(j)
    rows, columns = j["rows"], j["columns"]
    if j["restart"] or j["predictor"] != 1:
        raise ValueError("lossless images are decoded with predictor 1 and without restart intervals")
    bits, table = _Bits(j["data"]), _codes(*j["tables"][j["selected"] >> 4])
    diff = np.array([bits.signed(bits.symbol(table)) for _ in range(rows * columns)], np.int32)
    return _undo_prediction(diff.reshape(1, rows, columns))[0]


def _baseline(j: dict) -> np.ndarray:
    """The first part (grey, or the brightness of a colour image) of a baseline scan, at the image's size.

    The scan's units hold the blocks of all of its parts; those of other parts are read over. Between restarts each part's
    first coefficients are differences.
    """
    first = next(iter(j["parts"]))
    if first not in (names := [n for n, _ in j["scan"]]):
        raise ValueError("the first scan has no brightness")
    most_h, most_v = (max(p[i] for p in j["parts"].values()) for i in (0, 1))
    h, v, quant_id = j["parts"][first]
    alone = len(names) == 1  # then a unit is one block, and there are no more than the part needs
    across, down = (-(-j[n] * (k if alone else m) // (8 * (m if alone else m * m))) for n, k, m in (("columns", h, most_h), ("rows", v, most_v)))
    blocks = {n: 1 if alone else j["parts"][n][0] * j["parts"][n][1] for n in names}
    tables = {n: (_codes(*j["tables"][t >> 4]), _codes(*j["tables"][0x10 | t & 15])) for n, t in j["scan"]}
    units, found = across * down, []
    step = j["restart"] or units
    parts = re.split(rb"\xff[\xd0-\xd7]", j["data"])
    if len(parts) < -(-units // step):
        raise ValueError("the image ends early")
    for k in range(-(-units // step)):
        bits, level = _Bits(parts[k]), dict.fromkeys(names, 0)
        for _ in range(min(step, units - k * step)):
            for name in names:
                dc, ac = tables[name]
                for _ in range(blocks[name]):
                    block = _block(bits, dc, ac)
                    level[name] += block[0]
                    block[0] = level[name]
                    if name == first:
                        found.append(block)
    wide, high = (1, 1) if alone else (h, v)
    coefficients = np.array(found, np.float64) * np.array(j["quant"][quant_id])
    blocks_ = np.zeros_like(coefficients)
    blocks_[:, _ZIGZAG] = coefficients
    cosine = _cosines()
    samples = np.einsum("xu,nxy,yv->nuv", cosine, blocks_.reshape(-1, 8, 8), cosine) + 128
    # From (unit row, unit, block row, block, row, column) to the picture.
    samples = samples.reshape(down, across, high, wide, 8, 8).transpose(0, 2, 4, 1, 3, 5).reshape(down * high * 8, across * wide * 8)
    samples = samples.repeat(most_v // v, axis=0).repeat(most_h // h, axis=1)
    return np.clip(np.rint(samples[: j["rows"], : j["columns"]]), 0, 255).astype(np.uint8)


def _block(bits: _Bits, dc: dict, ac: dict) -> list[int]:
    """The 64 coefficients of a block in zigzag order, the first as a difference."""
    block, k = [0] * 64, 1
    block[0] = bits.signed(bits.symbol(dc))
    while k < 64:
        run = bits.symbol(ac)
        if run == 0:
            break
        k += run >> 4
        if run & 15:
            block[k] = bits.signed(run & 15)
        k += 1
    return block


# The Huffman tables that the JPEG standard proposes (its annex K.3), which motion-JPEG frames leave out. Per
# table: codes of each length from 1 to 16, and the first symbols; those not named follow in ascending order.
_USUAL = {
    0x00: ((0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), ""),
    0x01: ((0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0), ""),
    0x10: ((0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125), "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a"),
    0x11: ((0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119), "000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f1"),
}


@functools.cache
def _usual(which: int) -> tuple[tuple, tuple]:
    counts, named = _USUAL[which]
    first = bytes.fromhex(named)
    every = range(12) if which < 0x10 else sorted({0x00, 0xF0, *(run << 4 | size for run in range(16) for size in range(1, 11))})
    return counts, (*first, *(s for s in every if s not in first))


def usual_tables() -> dict[int, tuple[tuple, tuple]]:
    """(codes by length, symbols) of the usual Huffman tables, by class and number."""
    return {which: _usual(which) for which in _USUAL}


_FIXED = (tuple([1] * 9 + [0] * 7), tuple(range(8, -1, -1)))


def decode_frames(file: bytes, places: list[tuple[int, int]]) -> list[np.ndarray]:
    """The samples of each frame, GROUP frames at a time."""
    return [f for at in range(0, len(places), GROUP) for f in _decode_group(file, places[at : at + GROUP])]


def _decode_group(file: bytes, places: list[tuple[int, int]]) -> list[np.ndarray]:
    """Lossless frames whose codes all have the same length are read all at once, others one by one."""
    parsed = [parse_jpeg(file[a : a + n]) for a, n in places]
    fixed = {(p["rows"], p["columns"]) for p in parsed if p["kind"] == 0xC3 and p["predictor"] == 1 and not p["restart"] and p["tables"].get(p["selected"] >> 4) == _FIXED}
    if len(fixed) != 1 or any(p["kind"] != 0xC3 or p["tables"].get(p["selected"] >> 4) != _FIXED for p in parsed):
        return [decode_jpeg(file[a : a + n]) for a, n in places]
    rows, columns = fixed.pop()
    size = -(-rows * columns * SAMPLE_BITS // 8)
    data = b"".join(p["data"].replace(b"\xff\x00", b"\xff") for p in parsed)
    if len(data) != size * len(parsed):
        raise ValueError("a frame is not as long as its size demands")
    bits = np.unpackbits(np.frombuffer(data, np.uint8).reshape(len(parsed), size), axis=1)[:, : rows * columns * SAMPLE_BITS]
    bits = bits.reshape(len(parsed), rows * columns, SAMPLE_BITS)
    code = bits[:, :, 0].astype(np.uint16) << 8 | np.packbits(bits[:, :, 1:], axis=2)[:, :, 0]
    return list(_undo_prediction(_difference_codes()[1][code].reshape(len(parsed), rows, columns)))


def histograms(frames: list[np.ndarray], bins: int = 32) -> np.ndarray:
    """Share of samples by brightness, a row per frame."""
    return np.array([np.bincount((f >> 3).reshape(-1) if bins == 32 else (f.reshape(-1).astype(np.int64) * bins) >> 8, minlength=bins) / f.size for f in frames]).reshape(len(frames), bins)


def shots(hist: np.ndarray, window: int = 8, factor: float = 3.0, floor: float = 0.1) -> list[tuple[int, int]]:
    """(first frame, frame after the last) of each shot.

    A shot begins where the difference to the frame before (half the sum of absolute histogram differences) is
    above ``floor`` and above the mean plus ``factor`` standard deviations of the up to ``window`` differences
    before it within the shot; with fewer than two of these, above five times the floor.
    """
    n = len(hist)
    if not n:
        return []
    step = np.abs(np.diff(hist, axis=0)).sum(axis=1) / 2
    cuts, begin = [0], 0
    for i in range(1, n):
        past = step[max(begin, i - 1 - window) : i - 1]
        limit = max(floor, past.mean() + factor * past.std()) if past.size >= 2 else 5 * floor
        if step[i - 1] > limit:
            cuts.append(i)
            begin = i
    return list(zip(cuts, [*cuts[1:], n], strict=True))


def read_video(file: bytes) -> tuple[dict, list[np.ndarray]]:
    """The parsed file and its decoded frames."""
    video = parse_avi(file)
    return video, decode_frames(file, video["frames"])


def read_payload(video: dict, frames: list[np.ndarray]) -> bytes:
    """The payload bytes that :func:`store_payload` has stored."""
    raw = b"".join(f.tobytes() for f in frames)
    return raw[: int(video["note"].removeprefix(b"payload="))] if video["note"].startswith(b"payload=") else raw


# Columns ------------------------------------------------------------------------------------------------------

#: One row per shot: times in seconds and the mean brightness.
CLIP = "array<struct<clip: int, first_frame: int, frames: int, start_s: double, end_s: double, brightness: double>>"


def store(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """``docs`` with the binary column ``media``: the UTF-8 text, padded with zero bytes to whole rows, as AVI motion-JPEG.

    A null or empty text is stored as one row of zeros. Equal texts give equal files. Clashing columns are replaced.
    """

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        files = []
        for t in column(batch, text).to_pylist():
            raw = (t or "").encode()
            files.append(store_payload(raw + b"\0" * (-len(raw) % WIDTH if raw else WIDTH)))
        return [pa.array(files, pa.binary())]

    return add_columns(docs, f"{media} binary", make)


def read(docs: DataFrame, media: str = "media") -> DataFrame:
    """``docs`` with payload (the stored bytes, read back), clips (its timed shots) and media_error of the AVI column.

    A null file has nulls in all three. A file that can't be decoded has a null payload, null clips and in media_error
    the reason: no AVI, no frames, broken or cut off, or a kind of JPEG other than baseline or lossless grey. Of colour
    frames the payload is the brightness. Clashing columns are replaced.
    """

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        payloads, clips, errors = [], [], []
        for file in column(batch, media).to_pylist():
            try:
                video, frames = read_video(file) if file is not None else (None, None)
                error = None
            except (ValueError, IndexError, KeyError, struct.error) as e:
                video, error = None, f"{type(e).__name__}: {e}"
            errors.append(error)
            if video is None:
                payloads.append(None)
                clips.append(None)
                continue
            payloads.append(read_payload(video, frames))
            light = [float(f.mean()) for f in frames]
            clips.append([
                {"clip": k, "first_frame": a, "frames": b - a, "start_s": a * video["frame_s"], "end_s": b * video["frame_s"], "brightness": sum(light[a:b]) / (b - a)}
                for k, (a, b) in enumerate(shots(histograms(frames)))
            ])
        kind = pa.list_(pa.struct([("clip", pa.int32()), ("first_frame", pa.int32()), ("frames", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("brightness", pa.float64())]))
        return [pa.array(payloads, pa.binary()), pa.array(clips, kind), pa.array(errors, pa.string())]

    return add_columns(docs, f"payload binary, clips {CLIP}, media_error string", make)


def clips(docs: DataFrame, keys: list[str], media: str = "media") -> DataFrame:
    """One row per shot of each video: the key columns, then the fields of CLIP."""
    return read(docs.select(*keys, media), media).select(*keys, F.inline("clips"))
