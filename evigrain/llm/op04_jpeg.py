"""Baseline JPEG as a media column: write, parse, decode, thumbnail, hash.

:func:`parse` walks the markers of a baseline file (SOF0/SOF1, DHT, DQT, DRI,
SOS, COM). :func:`coefficients` Huffman-decodes the scan to quantised DCT
coefficients, for grey or colour files with any sampling and restart interval,
bit by bit from a table. Where a grey file restarts at each block, blocks are
decoded side by side, a code of each at a time, by the same tables, and those
of many files together (:func:`side_by_side`). :func:`thumbnail` rebuilds
luminance from the DC terms alone: one pixel for each 8x8 block.

:func:`wrap` stores bytes without loss: a JPEG's unit is the quantised
coefficient, and a block has 64 of them. A byte is the coefficient of its
distance from :data:`ORIGIN`, -128..127, so that frequent letters have few
bits. They are coded as in any such file: a DC difference, runs of zeros with
the size of what follows, an end of block, by the luminance tables of the
standard's annex K. A restart marker after each block lets DC terms stand for
themselves. The payload's length is in a comment.

Defined cases: a null text or medium is the empty one; a text is padded with
zero bytes to a positive multiple of 64 and stored whole; a medium that is no
baseline JPEG has null features and says why in ``error``; every input row
gives one row; an empty table gives an empty result; input columns other than
those kept are dropped, and one named as an output column gives way to it.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, task_cache, text_or_empty

BLOCK = 64
#: Most blocks in a row or column: 65,535 pixels.
WIDEST = 8191
#: Quantiser of the stored DC terms, so that they span the whole range of grey.
DC_STEP = 8


class BadJpeg(ValueError):
    """Not a baseline JPEG, or a broken one."""


def zigzag() -> np.ndarray:
    """Natural index of each coefficient in scan order, by walking the diagonals."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([r * 8 + c for r, c in cells])


ZIGZAG = zigzag()


def pad(data: bytes, unit: int = BLOCK) -> bytes:
    return data + bytes(-len(data) % unit if data else unit)


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def huffman_segment(kind: int, number: int, codes: dict[int, list[int]]) -> bytes:
    """A DHT segment from code length to symbols."""
    counts = bytes(len(codes.get(n, ())) for n in range(1, 17))
    return segment(0xC4, bytes([kind << 4 | number]) + counts + bytes(s for n in range(1, 17) for s in codes.get(n, ())))


#: The byte that is stored as zero.
ORIGIN = ord("e")
#: Typical luminance tables (annex K.3): symbols by code length.
DC_SYMBOLS = {2: [0], 3: [1, 2, 3, 4, 5], 4: [6], 5: [7], 6: [8], 7: [9], 8: [10], 9: [11]}
_AC = bytes.fromhex("0102030004110512213141061351610722711432819 1a1082342b1c11552d1f02433627282".replace(" ", "")) + bytes([9, 10])
_AC += bytes(run << 4 | size for run in range(16) for size in range(1, 11) if run << 4 | size not in _AC)
_AC_COUNTS = (0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125)
AC_SYMBOLS = {n: list(_AC[sum(_AC_COUNTS[: n - 1]) : sum(_AC_COUNTS[:n])]) for n in range(1, 17) if _AC_COUNTS[n - 1]}
EOB, ZRL = 0x00, 0xF0


def codes_of(symbols: dict[int, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(Code, code length) of each symbol, canonical."""
    codes, sizes = np.zeros(256, np.int64), np.zeros(256, np.int64)
    code = 0
    for n in range(1, 17):
        for s in symbols.get(n, ()):
            codes[s], sizes[s] = code, n
            code += 1
        code <<= 1
    return codes, sizes


DC_CODES, AC_CODES = codes_of(DC_SYMBOLS), codes_of(AC_SYMBOLS)
#: Bits of the absolute value of a coefficient, -255..255, by its place from 0.
CATEGORY = np.array([abs(v).bit_length() for v in range(-255, 256)])


def entropy_coded(grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(Bytes, bytes a block) of blocks of 64 coefficients of 8 bits, each from a byte's start and its DC term by itself."""
    n = len(grid)
    dc = grid[:, 0]
    block, at = np.nonzero(grid[:, 1:])
    at += 1
    value = grid[block, at]
    # a run goes back to the coefficient before that isn't zero, or to the block's DC term
    before = np.where(np.concatenate([[True], block[1:] != block[:-1]])[: len(block)], 0, np.concatenate([[0], at[:-1]])[: len(at)])
    run = at - before - 1
    long = run >> 4
    # of a run of 16 or more, a code for each 16 comes before
    token = np.repeat(np.arange(len(at)), long + 1)
    real = np.ones(len(token), bool)
    if long.any():
        real[:] = False
        real[np.cumsum(long + 1) - 1] = True
    last = np.zeros(n, np.int64)
    last[block] = at
    short = np.flatnonzero(last < 63)
    sizes = CATEGORY[value + 255][token]
    symbol = np.where(real, (run[token] & 15) << 4 | sizes, ZRL)
    sizes = np.where(real, sizes, 0)
    values = value[token]
    extra = np.where(values < 0, values + (1 << sizes) - 1, values) & ((1 << sizes) - 1)
    dc_sizes = CATEGORY[dc + 255]
    dc_extra = np.where(dc < 0, dc + (1 << dc_sizes) - 1, dc)
    code = np.concatenate([DC_CODES[0][dc_sizes] << dc_sizes | dc_extra, AC_CODES[0][symbol] << sizes | extra, np.full(len(short), AC_CODES[0][EOB])])
    bits = np.concatenate([DC_CODES[1][dc_sizes] + dc_sizes, AC_CODES[1][symbol] + sizes, np.full(len(short), AC_CODES[1][EOB])])
    owner = np.concatenate([np.arange(n), block[token], short])
    # a block ends with ones up to a whole byte
    fill = -np.bincount(owner, bits, n).astype(np.int64) % 8
    code, bits, owner = np.concatenate([code, (1 << fill) - 1]), np.concatenate([bits, fill]), np.concatenate([owner, np.arange(n)])
    place = np.concatenate([np.zeros(n, np.int64), at[token], np.full(len(short), 64), np.full(n, 65)])
    order = np.argsort(owner * 66 + place, kind="stable")
    code, bits = code[order], bits[order]
    which = np.repeat(np.arange(len(bits)), bits)
    shift = np.cumsum(bits)[which] - 1 - np.arange(len(which))
    raw = np.packbits((code[which] >> shift & 1).astype(np.uint8))
    return raw, np.bincount(owner[order], bits, n).astype(np.int64) // 8


def wrap(payload: bytes) -> bytes:
    """A grey baseline JPEG whose quantised coefficients are the payload's bytes."""
    if not payload or len(payload) % BLOCK:
        raise ValueError("a payload is a positive multiple of 64 bytes")
    blocks = len(payload) // BLOCK
    wide = min(WIDEST, math.isqrt(blocks - 1) + 1)
    high = -(-blocks // wide)
    if high > WIDEST:
        raise ValueError("too long for one JPEG")
    data = np.frombuffer(payload + bytes([ORIGIN]) * ((wide * high - blocks) * BLOCK), np.uint8)
    grid = (data - np.uint8(ORIGIN)).view(np.int8).astype(np.int64).reshape(-1, BLOCK)
    # a long text's bits are laid out some blocks at a time
    parts = [entropy_coded(grid[k : k + 4096]) for k in range(0, len(grid), 4096)]
    raw, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
    ff = raw == 0xFF
    # each block grows by its stuffed zeros and a restart marker
    before = np.cumsum(ff) - ff
    at = np.arange(raw.size) + before + 2 * np.repeat(np.arange(len(sizes)), sizes)
    scan = np.zeros(raw.size + int(ff.sum()) + 2 * (len(sizes) - 1), np.uint8)
    scan[at] = raw
    last = np.cumsum(sizes)[:-1] - 1
    ends = at[last] + 1 + ff[last]
    scan[ends] = 0xFF
    scan[ends + 1] = 0xD0 + np.arange(len(ends)) % 8
    return b"".join(
        (
            b"\xff\xd8",
            segment(0xFE, b"n=%d" % len(payload)),
            segment(0xDB, b"\x00" + bytes([DC_STEP] + [1] * 63)),
            segment(0xC0, struct.pack(">BHHB", 8, high * 8, wide * 8, 1) + b"\x01\x11\x00"),
            huffman_segment(0, 0, DC_SYMBOLS),
            huffman_segment(1, 0, AC_SYMBOLS),
            segment(0xDD, struct.pack(">H", 1)),
            segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
            scan.tobytes(),
            b"\xff\xd9",
        )
    )


def parse(data: bytes) -> dict:
    """The markers of a baseline JPEG: frame, tables, comments and the scan's bytes."""
    if data[:2] != b"\xff\xd8":
        raise BadJpeg("no start marker")
    out: dict = {"quant": {}, "huffman": {}, "comments": [], "restart": 0}
    at = 2
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise BadJpeg("no marker where one is due")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        length = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + length]
        if len(body) != length - 2:
            raise BadJpeg("cut short")
        at += 2 + length
        if marker == 0xDB:
            while body:
                wide, number = body[0] >> 4, body[0] & 15
                size = 128 if wide else 64
                table = np.zeros(64, np.int64)
                table[ZIGZAG] = np.frombuffer(body[1 : 1 + size], ">u2" if wide else "u1")
                out["quant"][number] = table
                body = body[1 + size :]
        elif marker == 0xC4:
            while body:
                counts = body[1:17]
                n = sum(counts)
                out["huffman"][body[0] >> 4, body[0] & 15] = (list(counts), list(body[17 : 17 + n]))
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1):
            depth, high, wide, n = struct.unpack_from(">BHHB", body)
            if depth != 8:
                raise BadJpeg("not 8 bits deep")
            parts = [body[6 + 3 * i : 9 + 3 * i] for i in range(n)]
            out["frame"] = {"height": high, "width": wide, "parts": [{"id": p[0], "h": p[1] >> 4, "v": p[1] & 15, "quant": p[2]} for p in parts]}
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise BadJpeg("not baseline")
        elif marker == 0xDD:
            out["restart"] = struct.unpack(">H", body[:2])[0]
        elif marker == 0xFE:
            out["comments"].append(body)
        elif marker == 0xDA:
            if "frame" not in out:
                raise BadJpeg("a scan before its frame")
            picks = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            if len(picks) != len(out["frame"]["parts"]):
                raise BadJpeg("more than one scan")
            for p in out["frame"]["parts"]:
                p["dc"], p["ac"] = picks[p["id"]] >> 4, picks[p["id"]] & 15
            out["scan"] = memoryview(data)[at:]
            return out
        elif marker == 0xD9:
            raise BadJpeg("no scan")


def pieces(scan: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The scan's bytes without stuffing and markers, and where its restart intervals end."""
    ff = np.flatnonzero(scan[:-1] == 0xFF)
    after = scan[ff + 1]
    real = (after != 0) & ((after < 0xD0) | (after > 0xD7))
    if real.any():
        stop = ff[real][0]
        ff, after, scan = ff[ff < stop], after[ff < stop], scan[:stop]
    keep = np.ones(len(scan), bool)
    keep[ff + 1] = False
    marks = ff[after != 0]
    keep[marks] = False
    left = np.cumsum(keep)
    return scan[keep], np.append(left[marks], left[-1] if len(left) else 0)


def lookup(table: tuple[list[int], list[int]]) -> np.ndarray:
    """For each 16 bits that may come next: code length << 8 | symbol, or 0."""
    out = np.zeros(1 << 16, np.int32)
    code, k = 0, 0
    for n, count in enumerate(table[0], 1):
        for _ in range(count):
            start = code << (16 - n)
            out[start : start + (1 << (16 - n))] = n << 8 | table[1][k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


#: Tables of a task's files; most have the same.
@task_cache
def cached_lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    return lookup((list(counts), list(symbols)))


def restarts_each_block(found: dict) -> bool:
    return len(found["frame"]["parts"]) == 1 and found["restart"] == 1


def tables_of(found: dict) -> tuple[tuple[bytes, bytes], tuple[bytes, bytes]]:
    """The (DC, AC) tables of a file's first component."""
    p = found["frame"]["parts"][0]
    if (0, p["dc"]) not in found["huffman"] or (1, p["ac"]) not in found["huffman"]:
        raise BadJpeg("a Huffman table is missing")
    dc, ac = ((bytes(c), bytes(s)) for c, s in (found["huffman"][0, p["dc"]], found["huffman"][1, p["ac"]]))
    return dc, ac


def side_by_side(data: np.ndarray, ends: np.ndarray, dc: np.ndarray, ac: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(Blocks of 64 coefficients, whether each is whole) of restart intervals of one block each, a code of each at a time."""
    n = len(ends)
    padded = np.concatenate([data, np.full(8, 0xFF, np.uint8)]).astype(np.uint32)
    words = padded[:-3] << 24 | padded[1:-2] << 16 | padded[2:-1] << 8 | padded[3:]
    out, good = np.zeros((n, 64), np.int16), np.ones(n, bool)
    most = 8 * len(data)
    live = np.arange(n)
    at, stop = 8 * np.concatenate([[0], ends[:-1]]), 8 * ends
    k = np.zeros(n, np.int64)

    def peek(at: np.ndarray) -> np.ndarray:
        """The next 16 bits; a code's or a value's, which have no more."""
        return ((words[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(16)).astype(np.int64)

    first = True
    while len(live):
        entry = (dc if first else ac)[peek(at)].astype(np.int64)
        size = entry & (255 if first else 15)
        run = 0 if first else (entry & 255) >> 4
        at = at + (entry >> 8)
        value = peek(np.minimum(at, most)) >> (16 - size)
        at = at + size
        value = np.where(value < (1 << size) >> 1, value - (1 << size) + 1, value)
        past = k + run
        # a code that is none, a run past its block, bits past its end
        bad = (entry == 0) | (at > stop) | ((size > 0) & (past > 63)) | (size > 15)
        ends_here = (size == 0) & (run != 15) & (not first)
        some = (size > 0) & ~bad
        out[live[some], past[some]] = value[some]
        good[live[bad]] = False
        k = past + 1
        on = ~bad & ~ends_here & (k < 64)
        live, at, stop, k = live[on], at[on], stop[on], k[on]
        first = False
    return out, good


def decode_together(files: list[dict]) -> list[list[np.ndarray]]:
    """:func:`coefficients` of each file; those that restart at each block together, as many as have the same tables."""
    out: list = [None] * len(files)
    groups: dict = {}
    for i, found in enumerate(files):
        if restarts_each_block(found):
            if not found["frame"]["width"] or not found["frame"]["height"]:
                raise BadJpeg("no size")
            groups.setdefault(tables_of(found), []).append(i)
        else:
            out[i] = coefficients(found)
    for (dc, ac), members in groups.items():
        data, ends, shapes, upto = [], [], [], 0
        for i in members:
            frame = files[i]["frame"]
            shapes.append((-(-frame["height"] // 8), -(-frame["width"] // 8)))
            raw, own = pieces(np.frombuffer(files[i]["scan"], np.uint8))
            blocks = shapes[-1][0] * shapes[-1][1]
            if len(own) < blocks:
                raise BadJpeg("cut short")
            own = own[:blocks]
            data.append(raw[: own[-1]])
            ends.append(own + upto)
            upto += int(own[-1])
        grid, good = side_by_side(np.concatenate(data), np.concatenate(ends), cached_lookup(*dc), cached_lookup(*ac))
        if not good.all():
            raise BadJpeg("no such code, or cut short")
        first = 0
        for i, (down, across) in zip(members, shapes, strict=True):
            out[i] = [grid[first : first + down * across].reshape(down, across, 64)]
            first += down * across
    return out


def coefficients(found: dict, even: bool = True) -> list[np.ndarray]:
    """Quantised coefficients in scan order, an array (rows, columns, 64) a component."""
    frame = found["frame"]
    parts = frame["parts"]
    if not frame["width"] or not frame["height"]:
        raise BadJpeg("no size")
    alone = len(parts) == 1
    hmax, vmax = max(p["h"] for p in parts), max(p["v"] for p in parts)
    across, down = -(-frame["width"] // (8 * hmax)), -(-frame["height"] // (8 * vmax))
    for p in parts:
        if (0, p["dc"]) not in found["huffman"] or (1, p["ac"]) not in found["huffman"]:
            raise BadJpeg("a Huffman table is missing")
    if even and restarts_each_block(found):
        return decode_together([found])[0]
    data, ends = pieces(np.frombuffer(found["scan"], np.uint8))
    if alone:
        across, down = -(-frame["width"] // 8), -(-frame["height"] // 8)
    grids = [np.zeros((down * (1 if alone else p["v"]), across * (1 if alone else p["h"]), 64), np.int16) for p in parts]
    tables = [(lookup(found["huffman"][0, p["dc"]]), lookup(found["huffman"][1, p["ac"]])) for p in parts]
    raw = data.tobytes()
    state = {"piece": 0}

    def open_piece():
        k = state["piece"]
        if k >= len(ends):
            raise BadJpeg("cut short")
        state["piece"] += 1
        begin = int(ends[k - 1]) if k else 0
        chunk = raw[begin : int(ends[k])]
        return chunk, len(chunk) * 8, 0

    chunk, bits, at = open_piece()

    def peek(n: int, at: int) -> int:
        start = at >> 3
        word = int.from_bytes(chunk[start : start + 4].ljust(4, b"\xff"), "big")
        return word >> (32 - n - (at & 7)) & ((1 << n) - 1)

    last = [0] * len(parts)
    for mcu in range(across * down):
        if found["restart"] and mcu and mcu % found["restart"] == 0:
            chunk, bits, at = open_piece()
            last = [0] * len(parts)
        row, col = divmod(mcu, across)
        for c, p in enumerate(parts):
            dc, ac = tables[c]
            v, h = (1, 1) if alone else (p["v"], p["h"])
            for y in range(v):
                for x in range(h):
                    block = grids[c][row * v + y, col * h + x]
                    k = 0
                    while k < 64:
                        entry = int((ac if k else dc)[peek(16, at)])
                        if not entry:
                            raise BadJpeg("no such code")
                        at += entry >> 8
                        run, size = (entry & 255) >> 4, entry & 15
                        value = 0
                        if size:
                            value = peek(size, at)
                            at += size
                            if value < 1 << (size - 1):
                                value -= (1 << size) - 1
                        if k == 0:
                            last[c] += value
                            block[0] = last[c]
                            k = 1
                        elif size:
                            k += run
                            if k > 63:
                                raise BadJpeg("a run past its block")
                            block[k] = value
                            k += 1
                        elif run == 15:
                            k += 16
                        else:
                            break
                    if at > bits:
                        raise BadJpeg("cut short")
    return grids


def thumbnail(found: dict, grids: list[np.ndarray]) -> np.ndarray:
    """Luminance from DC terms: a byte for each block, cropped to the picture."""
    frame = found["frame"]
    part = frame["parts"][0]
    step = found["quant"][part["quant"]][0]
    hmax, vmax = (max(p[k] for p in frame["parts"]) for k in ("h", "v"))
    high = -(-frame["height"] * (part["v"] if len(frame["parts"]) > 1 else 1) // (8 * (vmax if len(frame["parts"]) > 1 else 1)))
    wide = -(-frame["width"] * (part["h"] if len(frame["parts"]) > 1 else 1) // (8 * (hmax if len(frame["parts"]) > 1 else 1)))
    grey = grids[0][:high, :wide, 0].astype(np.int64) * step
    return np.clip(np.floor_divide(2 * grey + 8, 16) + 128, 0, 255).astype(np.uint8)


def average_hash(grey: np.ndarray, side: int = 8) -> str:
    """64 bits as hex: which cells of an 8x8 reduction are brighter than their mean."""
    total = np.zeros((grey.shape[0] + 1, grey.shape[1] + 1), np.int64)
    total[1:, 1:] = grey.astype(np.int64).cumsum(0).cumsum(1)

    def edges(n: int) -> tuple[np.ndarray, np.ndarray]:
        start = np.arange(side) * n // side
        return start, np.maximum(start + 1, np.arange(1, side + 1) * n // side)

    (r0, r1), (c0, c1) = edges(grey.shape[0]), edges(grey.shape[1])
    sums = total[r1][:, c1] - total[r0][:, c1] - total[r1][:, c0] + total[r0][:, c0]
    mean = sums / np.outer(r1 - r0, c1 - c0)
    return np.packbits(mean > mean.mean()).tobytes().hex()


def payload_of(found: dict, grids: list[np.ndarray]) -> bytes:
    """The payload that :func:`wrap` stored."""
    size = next((int(c[2:]) for c in found["comments"] if c.startswith(b"n=") and c[2:].isdigit()), None)
    flat = grids[0].reshape(-1)
    if size is None or size > len(flat) or len(grids) > 1:
        raise BadJpeg("no stored payload")
    return ((flat[:size] + ORIGIN) & 255).astype(np.uint8).tobytes()


def unwrap(data: bytes) -> tuple[bytes, dict, list[np.ndarray]]:
    """The payload that :func:`wrap` stored, with the parsed file and its coefficients."""
    found = parse(data)
    grids = coefficients(found)
    return payload_of(found, grids), found, grids


def feature(found: dict, grids: list[np.ndarray]) -> str:
    grey = thumbnail(found, grids)
    frame = found["frame"]
    return f"{frame['width']}x{frame['height']}:{average_hash(grey)}:{zlib.crc32(grey.tobytes()):08x}"


def jpeg_media(docs: DataFrame, *, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``n_bytes`` and ``media``: each whole text stored as a JPEG."""

    def make():
        def work(texts: list[str]) -> list[list]:
            raw = [t.encode() for t in texts]
            return [[len(x) for x in raw], [wrap(pad(x)) for x in raw]]

        return work

    kept = [c for c in keep if c not in ("n_bytes", "media")]
    rows = docs.select(*kept, text_or_empty(F.col(text)).alias("__text"))
    return add_columns(rows, "__text", [("n_bytes", T.LongType()), ("media", T.BinaryType())], make, keep=kept)


FEATURES = [("width", T.IntegerType()), ("height", T.IntegerType()), ("thumb_width", T.IntegerType()), ("thumb_height", T.IntegerType()), ("thumb_hash", T.StringType()), ("thumb_crc32", T.LongType()), ("thumbnail", T.BinaryType()), ("error", T.StringType())]


def jpeg_features(media: DataFrame, *, column: str = "media", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Dimensions, DC-only luminance thumbnail and its hashes of each JPEG in a column."""

    def one(data: bytes) -> list:
        try:
            found = parse(data or b"")
            grids = coefficients(found)
            grey = thumbnail(found, grids)
            frame = found["frame"]
            return [frame["width"], frame["height"], grey.shape[1], grey.shape[0], average_hash(grey), zlib.crc32(grey.tobytes()), grey.tobytes(), None]
        except (BadJpeg, struct.error, IndexError, KeyError, ValueError) as e:
            return [None] * 7 + [str(e) or type(e).__name__]

    def make():
        return lambda values: [list(x) for x in zip(*map(one, values), strict=True)] if values else [[] for _ in FEATURES]

    return add_columns(media, column, FEATURES, make, keep=keep)


DIGESTS = [("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType())]


def payload_digests(media: DataFrame, *, column: str = "media", keep: Sequence[str] = ("doc_id", "n_bytes")) -> DataFrame:
    """Digests of the payload read back from each stored JPEG, and the picture's feature."""

    def make():
        def work(values: list[bytes]) -> list[list]:
            rows = []
            files = [parse(data) for data in values]
            for data, found, grids in zip(values, files, decode_together(files), strict=True):
                payload = payload_of(found, grids)
                rows.append([len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(data), hashlib.sha256(data).hexdigest(), feature(found, grids)])
            return [list(x) for x in zip(*rows, strict=True)]

        return work

    return add_columns(media, column, DIGESTS, make, keep=keep)
