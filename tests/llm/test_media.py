import hashlib
import struct
import tracemalloc
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from relslice.llm import entries, media


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 200), st.integers(0, 2**32 - 1), st.booleans())
def test_payload_round_trip(rows, seed, extreme):
    rng = np.random.default_rng(seed)
    payload = (rng.choice([0, 255], rows * 64) if extreme else rng.integers(0, 256, rows * 64)).astype(np.uint8).tobytes()
    file = media.store_payload(payload)
    video, frames = media.read_video(file)
    assert media.read_payload(video, frames) == payload and video["frame_s"] == pytest.approx(0.04)


def test_slow_and_fast_decoding_agree():
    rng = np.random.default_rng(1)
    samples = rng.integers(0, 256, (2, 9, 17)).astype(np.uint8)
    for frame, want in zip(media.lossless_frames(samples), samples, strict=True):
        assert np.array_equal(media.decode_jpeg(frame), want)


def test_other_huffman_tables_take_the_slow_way():
    frame = media.lossless_frames(np.arange(64, dtype=np.uint8).reshape(1, 8, 8))[0]
    file = media.avi([frame, baseline(np.full((8, 8), 90), 16)], 8, 8)
    _, frames = media.read_video(file)
    assert np.array_equal(frames[0].reshape(-1), np.arange(64)) and np.abs(frames[1].astype(int) - 90).max() <= 1


def baseline(pixels, quant=1):
    """A baseline grey JPEG by the book, with the plainest Huffman tables."""
    x, u = np.meshgrid(np.arange(8), np.arange(8))
    c = np.cos((2 * x + 1) * u * np.pi / 16) / 2
    c[0] /= np.sqrt(2)
    h, w = pixels.shape
    out, last = "", 0
    symbols = list(range(256))

    def put(v, table_bits):
        v = int(v)
        s = abs(v).bit_length()
        return s, (format(v if v > 0 else v + (1 << s) - 1, f"0{s}b") if s else "")

    for top in range(0, h, 8):
        for side in range(0, w, 8):
            f = np.rint(c @ (pixels[top : top + 8, side : side + 8].astype(float) - 128) @ c.T / quant).astype(int).reshape(-1)
            zz = [f[i] for i in media._ZIGZAG]
            s, extra = put(zz[0] - last, 4)
            out += format(s, "04b") + extra
            last, run = zz[0], 0
            ends = max((i for i in range(1, 64) if zz[i]), default=0)
            for v in zz[1 : ends + 1]:
                if v == 0:
                    run += 1
                    continue
                while run > 15:
                    out += format(symbols.index(0xF0), "09b")
                    run -= 16
                s, extra = put(v, 9)
                out += format(symbols.index(run << 4 | s), "09b") + extra
                run = 0
            if ends < 63:
                out += format(symbols.index(0), "09b")
    out += "1" * (-len(out) % 8)
    data = bytes(int(out[i : i + 8], 2) for i in range(0, len(out), 8)).replace(b"\xff", b"\xff\x00")
    seg = media._segment
    dht = seg(0xC4, bytes([0x00, *[0, 0, 0, 12], *[0] * 12, *range(12)]) + bytes([0x10, *[0] * 8, 255, *[0] * 7, *range(255)]))
    return b"\xff\xd8" + seg(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + seg(0xDB, bytes([0, *[quant] * 64])) + seg(0xC0, struct.pack(">BHHB3B", 8, h, w, 1, 1, 0x11, 0)) + dht + seg(0xDA, bytes([1, 1, 0x00, 0, 63, 0])) + data + b"\xff\xd9"


def test_baseline_frames_are_decoded():
    y, x = np.mgrid[0:24, 0:16]
    picture = (128 + 60 * np.sin(x / 3) + 50 * np.cos(y / 4)).astype(int)
    assert np.abs(media.decode_jpeg(baseline(picture)).astype(int) - picture).max() <= 2
    assert np.abs(media.decode_jpeg(baseline(picture, 8)).astype(int) - picture).mean() < 4


def coded(table):
    """Code strings by symbol of a (codes by length, symbols) table, by the standard's rule."""
    out, code, i = {}, 0, 0
    for length, n in enumerate(table[0], 1):
        for _ in range(n):
            out[table[1][i]] = format(code, f"0{length}b")
            code, i = code + 1, i + 1
        code <<= 1
    return out


def test_usual_huffman_tables():
    """Codes that the standard's tables K.3 to K.6 list."""
    dc, dc2, ac, ac2 = (coded(media.usual_tables()[k]) for k in (0x00, 0x01, 0x10, 0x11))
    assert (dc[0], dc[5], dc[11]) == ("00", "110", "111111110") and (dc2[0], dc2[11]) == ("00", "11111111110")
    assert (ac[0x00], ac[0xF0], ac[0x01], ac[0x11], ac[0x05], ac[0xFA]) == ("1010", "11111111001", "00", "1100", "11010", "1" * 15 + "0")
    assert (ac2[0x00], ac2[0xF0], ac2[0x01], ac2[0x11], ac2[0xFA]) == ("00", "1111111010", "01", "1011", "1" * 15 + "0")


def colour(planes, restart=0, quant=1, sampling=(2, 2)):
    """A baseline colour JPEG without Huffman tables: brightness at full size, the other two planes at their own."""
    x, u = np.meshgrid(np.arange(8), np.arange(8))
    c = np.cos((2 * x + 1) * u * np.pi / 16) / 2
    c[0] /= np.sqrt(2)
    tables = [(coded(media.usual_tables()[k]), coded(media.usual_tables()[0x10 | k])) for k in (0, 1, 1)]
    h, v = sampling
    rows, columns = planes[0].shape
    scaled = [np.pad(p.astype(float), ((0, -p.shape[0] % (8 * b)), (0, -p.shape[1] % (8 * a))), mode="edge") for p, (a, b) in zip(planes, ((h, v), (1, 1), (1, 1)), strict=True)]
    down, across = scaled[0].shape[0] // (8 * v), scaled[0].shape[1] // (8 * h)
    parts, bits, last = [], "", [0, 0, 0]

    def value(n):
        s = abs(n).bit_length()
        return s, format(n if n > 0 else n + (1 << s) - 1, f"0{s}b") if s else ""

    def close(bits):
        bits += "1" * (-len(bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")

    for unit in range(down * across):
        if restart and unit and unit % restart == 0:
            parts.append(close(bits) + bytes([0xFF, 0xD0 + (unit // restart - 1) % 8]))
            bits, last = "", [0, 0, 0]
        for i, (plane, (a, b)) in enumerate(zip(scaled, ((h, v), (1, 1), (1, 1)), strict=True)):
            dc, ac = tables[i]
            for k in range(a * b):
                top, side = (unit // across * b + k // a) * 8, (unit % across * a + k % a) * 8
                f = np.rint(c @ (plane[top : top + 8, side : side + 8] - 128) @ c.T / quant).astype(int).reshape(-1)
                zz = [int(f[z]) for z in media._ZIGZAG]
                s, extra = value(zz[0] - last[i])
                bits, last[i], run = bits + dc[s] + extra, zz[0], 0
                ends = max((z for z in range(1, 64) if zz[z]), default=0)
                for n in zz[1 : ends + 1]:
                    if n == 0:
                        run += 1
                        continue
                    while run > 15:
                        bits, run = bits + ac[0xF0], run - 16
                    s, extra = value(n)
                    bits, run = bits + ac[run << 4 | s] + extra, 0
                if ends < 63:
                    bits += ac[0]
    seg = media._segment
    head = b"\xff\xd8" + seg(0xE0, b"AVI1\0\0\0\0\0\0\0\0\0\0") + seg(0xDB, bytes([0, *[quant] * 64]))
    frame = seg(0xC0, struct.pack(">BHHB", 8, rows, columns, 3) + bytes([1, h << 4 | v, 0, 2, 0x11, 0, 3, 0x11, 0]))
    every = seg(0xDD, struct.pack(">H", restart)) if restart else b""
    return head + frame + every + seg(0xDA, bytes([3, 1, 0x00, 2, 0x11, 3, 0x11, 0, 63, 0])) + b"".join(parts) + close(bits) + b"\xff\xd9"


@pytest.mark.parametrize(("restart", "sampling"), [(0, (2, 2)), (2, (2, 2)), (1, (1, 1)), (3, (2, 1))])
def test_colour_frames_without_tables_are_decoded(restart, sampling):
    y, x = np.mgrid[0:35, 0:50]
    light = (128 + 60 * np.sin(x / 5) + 50 * np.cos(y / 4)).astype(int)
    small = tuple(-(-n // s) for n, s in zip(light.shape, sampling[::-1], strict=True))
    tint = [(100 + 40 * np.sin(np.mgrid[0 : small[0], 0 : small[1]][k] / 3)).astype(int) for k in (0, 1)]
    got = media.decode_jpeg(colour([light, *tint], restart, sampling=sampling))
    assert got.shape == light.shape and np.abs(got.astype(int) - light).max() <= 2


def test_a_usual_motion_jpeg_file_is_cut_into_shots(spark):
    """Colour frames with restart intervals and without tables, of two scenes."""
    dark, bright = np.full((16, 32), 40), np.full((16, 32), 200)
    tint = [np.full((8, 16), 90), np.full((8, 16), 160)]
    file = media.avi([colour([p, *tint], restart=1) for p in [dark] * 5 + [bright] * 7], 32, 16)
    row = media.read(spark.createDataFrame([(1, bytearray(file))], "doc_id long, media binary")).first()
    assert row["media_error"] is None and [(c["first_frame"], c["frames"]) for c in row["clips"]] == [(0, 5), (5, 7)]
    assert [round(c["brightness"]) for c in row["clips"]] == [40, 200]


def test_parsing_without_an_index_and_of_other_files():
    file = media.store_payload(bytes(64 * 100))
    cut = file[: file.rindex(b"idx1")]
    cut = cut[:4] + struct.pack("<I", len(cut) - 8) + cut[8:]
    assert media.parse_avi(cut)["frames"] == media.parse_avi(file)["frames"]
    for bad in (b"", b"RIFF\0\0\0\0WAVE", b"RIFF\4\0\0\0AVI "):
        with pytest.raises(ValueError):
            media.parse_avi(bad)
    with pytest.raises(ValueError):
        media.decode_jpeg(b"GIF89a")


def test_shots_are_cut_at_changes():
    rng = np.random.default_rng(0)
    dark, light = rng.integers(0, 60, (12, 64, 64)), rng.integers(150, 255, (7, 64, 64))
    frames = list(np.concatenate([dark, light, dark]).astype(np.uint8))
    assert media.shots(media.histograms(frames)) == [(0, 12), (12, 19), (19, 31)]
    assert media.shots(media.histograms(frames[:12])) == [(0, 12)]
    assert media.shots(np.zeros((0, 32))) == []


def test_clips_are_timed(spark):
    frames = np.concatenate([np.full((5, 8, 8), 10), np.full((3, 8, 8), 200)]).astype(np.uint8)
    file = media.avi(media.lossless_frames(frames), 8, 8, rate=10)
    df = spark.createDataFrame([(1, file), (2, None)], "id long, media binary")
    got = media.clips(df, ["id"]).collect()
    assert [(r["id"], r["clip"], r["first_frame"], r["frames"], round(r["start_s"], 3), round(r["end_s"], 3), r["brightness"]) for r in got] == [(1, 0, 0, 5, 0.0, 0.5, 10.0), (1, 1, 5, 3, 0.5, 0.8, 200.0)]


def test_stored_columns(spark):
    rows = [(1, None), (2, ""), (3, "é" * 31), (4, "x" * 64), (5, "long text " * 30_000), (5, "x" * 64)]
    df = spark.createDataFrame([(i, t, "own") for i, t in rows], "doc_id long, text string, payload string")
    got = media.read(media.store(df)).collect()
    for r in got:
        raw = (r["text"] or "").encode()
        assert bytes(r["payload"]) == raw + bytes(-len(raw) % 64 if raw else 64) and r["clips"][0]["start_s"] == 0
    assert bytes(got[3]["media"]) == bytes(got[5]["media"])
    assert media.read(media.store(df.limit(0))).count() == 0


def test_op9_digests(spark):
    docs = {r["doc_id"]: r["text"].encode() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in entries.op9_media(spark, "/root/testdata/sf0.001").collect():
        raw = docs[r["doc_id"]]
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        file = media.store_payload(padded)
        want = (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]), len(file), hashlib.sha256(file).hexdigest())
        assert tuple(r[c] for c in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")) == want


def test_files_that_cannot_be_read_have_a_status(spark):
    good = media.store_payload(b"a" * 6400)
    cut = good[: len(good) // 2]
    rows = [(1, good), (2, b""), (3, b"RIFF\4\0\0\0AVI "), (4, cut), (5, None), (6, good.replace(b"\xff\xc3", b"\xff\xc2"))]
    got = {r["id"]: r for r in media.read(spark.createDataFrame(rows, "id long, media binary")).collect()}
    assert {i for i, r in got.items() if r["media_error"] is None} == {1, 5}
    assert bytes(got[1]["payload"]) == b"a" * 6400 and all(got[i]["payload"] is None and got[i]["clips"] is None for i in (2, 3, 4, 5, 6))


def test_memory_of_a_long_text_is_a_small_multiple():
    payload = bytes(np.random.default_rng(0).integers(0, 128, 8 << 20, dtype=np.uint8))
    tracemalloc.start()
    file = media.store_payload(payload)
    stored = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    video, frames = media.read_video(file)
    assert media.read_payload(video, frames) == payload
    read = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert max(stored, read) < 10 * len(payload)


def test_clips_query_equals_shots_of_each_text(spark):
    docs = {r["doc_id"]: r["text"].encode() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = {}
    for r in entries.media_clips(spark, "/root/testdata/sf0.001").collect():
        got.setdefault(r["doc_id"], []).append((r["clip"], r["first_frame"], r["frames"], round(r["start_s"] * 25), round(r["end_s"] * 25)))
    for i, raw in docs.items():
        raw += bytes(-len(raw) % 64 if raw else 64)
        height = min(len(raw) // 64, media.HEIGHT)
        size = 64 * height
        raw += bytes(-len(raw) % size)
        hist = np.array([np.bincount(np.frombuffer(raw[a : a + size], np.uint8) >> 3, minlength=32) / size for a in range(0, len(raw), size)])
        assert sorted(got[i]) == [(k, a, b - a, a, b) for k, (a, b) in enumerate(media.shots(hist))]
    assert any(len(c) > 1 for c in got.values())
