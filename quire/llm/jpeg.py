"""Baseline JPEG media columns: texts stored as images, markers parsed and scans Huffman-decoded in numpy.

Storing: each payload byte is a flat 8 x 8 block. With a DC quantiser of 8 the coefficient of a flat block of sample v is
exactly v - 128, and there are no AC coefficients: any decoder gives the samples back without loss, and the DC-only
luminance thumbnail *is* the payload. A row has 192 blocks and is one restart interval; what exceeds ``MOST_ROWS`` rows
(a JPEG has at most 65,535 lines) goes on in a further image of the same column value.

Reading: the decoder takes any baseline (SOF0) image of one interleaved scan or of one component: it parses the markers,
cuts the scan at its restart markers and decodes all intervals of a batch in step, one Huffman symbol of each at a time.
Without restart markers an image is one interval. AC coefficients are skipped over; the DC ones, dequantised, are the
thumbnail.

Defined cases: a null text is empty; an empty text is one row of spaces; equal texts give equal values; an empty table
gives an empty table. Only the named columns are read. Bytes that aren't a baseline JPEG raise ValueError.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm.common import map_texts

ROW = 192
#: At most 8191; with fewer, a very long text needs less memory at once.
MOST_ROWS = 4096
#: Payload bytes that are encoded and decoded at once: the working arrays take some 100 bytes for each.
STEP = 1_000_000

#: Fixed values of the format: the usual luminance DC table (codes of each length, then symbols).
DC_LENGTHS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_SYMBOLS = tuple(range(12))
#: A table whose only symbol is end-of-block, in one bit.
AC_LENGTHS = (1, *[0] * 15)
AC_SYMBOLS = (0,)


def padded(text: str) -> tuple[int, bytes]:
    """Bytes of the text in UTF-8, and the payload."""
    raw = text.encode()
    return len(raw), raw + b" " * (-len(raw) % ROW if raw else ROW)


def _segment(marker: int, body: bytes) -> bytes:
    return bytes((0xFF, marker)) + (len(body) + 2).to_bytes(2, "big") + body


def header(rows: int) -> bytes:
    return b"".join(
        (
            b"\xff\xd8",
            _segment(0xE0, b"JFIF\x00\x01\x01\x00\x00\x01\x00\x01\x00\x00"),
            _segment(0xDB, b"\x00" + b"\x08" * 64),
            _segment(0xC0, b"\x08" + (rows * 8).to_bytes(2, "big") + (ROW * 8).to_bytes(2, "big") + b"\x01\x01\x11\x00"),
            _segment(0xC4, b"\x00" + bytes(DC_LENGTHS) + bytes(DC_SYMBOLS)),
            _segment(0xC4, b"\x10" + bytes(AC_LENGTHS) + bytes(AC_SYMBOLS)),
            _segment(0xDD, ROW.to_bytes(2, "big")),
            _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
        )
    )


def huffman_codes(lengths: tuple[int, ...] | bytes, symbols: tuple[int, ...] | bytes) -> list[tuple[int, int, int]]:
    """(symbol, code, bits), by the canonical rule."""
    out, code, at = [], 0, 0
    for bits, n in enumerate(lengths, 1):
        for s in symbols[at : at + n]:
            out.append((s, code, bits))
            code += 1
        at += n
        code <<= 1
    return out


def _tokens() -> tuple[np.ndarray, np.ndarray]:
    """For each DC difference + 255: its code, extra bits and end-of-block as one number, and the bits of that."""
    codes = {s: (c, b) for s, c, b in huffman_codes(DC_LENGTHS, DC_SYMBOLS)}
    value, bits = np.zeros(511, np.uint32), np.zeros(511, np.int64)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        code, n = codes[s]
        extra = d if d >= 0 else d + (1 << s) - 1
        value[d + 255], bits[d + 255] = ((code << s) | extra) << 1, n + s + 1
    return value, bits


def encode(payloads: list[bytes]) -> list[bytes]:
    """An image of each payload, whose length is a positive multiple of ROW and at most 8191 rows."""
    value, bits = _tokens()
    samples = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, ROW).astype(np.int16) - 128
    index = np.diff(samples, axis=1, prepend=np.int16(0)) + 255
    value, bits = value[index], bits[index]
    ends = np.cumsum(bits, axis=1)
    row_bits = ends[:, -1]
    row_bytes = (row_bits + 7) >> 3
    row_start = np.cumsum(row_bytes) - row_bytes
    starts = (ends - bits + row_start[:, None] * 8).ravel()
    value, bits, size = value.ravel(), bits.ravel(), int(row_bytes.sum()) + 2
    at, window = starts >> 3, value << (24 - (starts & 7) - bits).astype(np.uint32)
    data = np.bincount(at, window >> 16, size) + np.bincount(at + 1, (window >> 8) & 255, size) + np.bincount(at + 2, window & 255, size)
    data = data[:-2].astype(np.uint8)
    data[row_start + row_bytes - 1] |= ((1 << (-row_bits & 7)) - 1).astype(np.uint8)  # rows end in ones

    # Stuff a zero after 0xFF, and leave two bytes for the marker after each row.
    full = data == 0xFF
    row_of = np.repeat(np.arange(len(row_bytes)), row_bytes)
    to = np.arange(len(data)) + np.cumsum(full) - full + 2 * row_of
    out = np.zeros(len(data) + int(full.sum()) + 2 * len(row_bytes), np.uint8)
    out[to] = data
    stop = to[row_start + row_bytes - 1] + 1 + full[row_start + row_bytes - 1]
    images = np.array([len(p) // ROW for p in payloads])
    first = np.cumsum(images) - images
    nth = np.arange(len(row_bytes)) - np.repeat(first, images)
    marker = 0xD0 + nth % 8
    marker[first + images - 1] = 0xD9
    out[stop], out[stop + 1] = 0xFF, marker
    begin = np.append(0, stop + 2)
    whole = out.tobytes()
    return [header(n) + whole[begin[f] : begin[f + n]] for f, n in zip(first.tolist(), images.tolist(), strict=True)]


@dataclass
class Image:
    """What the markers of a baseline image say, and where its scan begins."""

    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantiser
    quantisers: dict[int, int] = field(default_factory=dict)  # of DC
    tables: dict[int, tuple[bytes, bytes]] = field(default_factory=dict)  # by class << 4 | id
    scan: list[tuple[int, int, int]] = field(default_factory=list)  # component's index, DC and AC table
    interval: int = 0
    start: int = 0


def parse(data: bytes, at: int) -> Image:
    """The markers from SOI to SOS."""
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("no SOI")
    image, at = Image(), at + 2
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("no marker")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        length = int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + length], at + 2 + length
        if marker == 0xDB:
            while body:
                wide, k = body[0] >> 4, body[0] & 15
                image.quantisers[k] = int.from_bytes(body[1 : 2 + wide], "big")
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                image.tables[body[0]] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xC0:
            image.height, image.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            image.components = [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not baseline")
        elif marker == 0xDD:
            image.interval = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            ids = [c[0] for c in image.components]
            image.scan = [(ids.index(body[i]), body[i + 1] >> 4, body[i + 1] & 15) for i in range(1, 1 + 2 * body[0], 2)]
            image.start = at
            return image


def _lookup(table: tuple[bytes, bytes]) -> np.ndarray:
    """For each 16 bits ahead: bits of the code << 8 | symbol."""
    out = np.zeros(1 << 16, np.int64)
    for s, code, bits in huffman_codes(*table):
        out[code << (16 - bits) : (code + 1) << (16 - bits)] = bits << 8 | s
    return out


def thumbnails(media: list[bytes]) -> list[list[tuple[int, int, np.ndarray]]]:
    """For each value: of its images the width, the height and the DC-only luminance thumbnail."""
    whole = b"".join(media)
    raw = np.frombuffer(whole, np.uint8)
    after = np.flatnonzero(raw[:-1] == 0xFF) + 1
    kind = raw[after]
    stuffed, restart, other = after[kind == 0], after[(kind >= 0xD0) & (kind <= 0xD7)], after[(kind != 0) & ((kind < 0xD0) | (kind > 0xD7)) & (kind != 0xFF)]
    dropped = np.zeros(len(raw), bool)
    dropped[stuffed] = dropped[restart] = dropped[restart - 1] = True

    images: list[Image] = []
    owner: list[int] = []
    cuts: list[tuple[int, int]] = []  # begin and end of each scan
    at = 0
    for i, m in enumerate(media):
        end_of_value = at + len(m)
        while at < end_of_value:
            image = parse(whole, at)
            k = np.searchsorted(other, image.start)
            if k == len(other) or raw[other[k]] != 0xD9:
                raise ValueError("no EOI after the scan")
            images.append(image)
            owner.append(i)
            cuts.append((image.start, int(other[k]) - 1))
            at = int(other[k]) + 1
    kept = np.cumsum(~dropped) - ~dropped  # position of a byte once the dropped ones are gone
    data = np.append(raw[~dropped], np.zeros(8, np.uint8)).astype(np.uint32)
    ahead = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]

    # One lane for each restart interval: where its bits begin, its blocks, its image.
    lanes_at, lanes_blocks, lanes_image = [], [], []
    tables: dict[tuple[bytes, bytes], int] = {}
    plans: list[list[tuple[int, int, int]]] = []  # of an MCU's blocks: component, DC table, AC table
    shapes = []
    for i, (image, (begin, end)) in enumerate(zip(images, cuts, strict=True)):
        alone = len(image.scan) == 1
        parts = []
        for c, dc, ac in image.scan:
            _, h, v, _ = image.components[c]
            one = (c, tables.setdefault(image.tables[dc], len(tables)), tables.setdefault(image.tables[16 | ac], len(tables)))
            parts += [one] * (1 if alone else h * v)
        most_h, most_v = max(c[1] for c in image.components), max(c[2] for c in image.components)
        step_x, step_y = (8, 8) if alone else (8 * most_h, 8 * most_v)
        across, down = -(-image.width // step_x), -(-image.height // step_y)
        total = across * down
        plans.append(parts)
        shapes.append((across, down))
        marks = restart[np.searchsorted(restart, begin) : np.searchsorted(restart, end)]
        starts = np.append(begin, marks + 1)
        each = image.interval or total
        blocks = np.minimum(each, total - each * np.arange(len(starts))) * len(parts)
        if len(starts) != -(-total // each):
            raise ValueError("restart markers don't fit the size")
        lanes_at.append(kept[starts])
        lanes_blocks.append(blocks)
        lanes_image.append(np.full(len(starts), i))
    position, blocks, of = np.concatenate(lanes_at) * 8, np.concatenate(lanes_blocks), np.concatenate(lanes_image)
    widest = max(map(len, plans))
    plan = np.zeros((len(plans), widest, 3), np.int64)
    in_mcu = np.array([len(p) for p in plans])
    for i, p in enumerate(plans):
        plan[i, : len(p)] = p
    look = np.stack([_lookup(t) for t in tables])

    out = np.zeros(int(blocks.sum()), np.int32)
    slot = np.cumsum(blocks) - blocks
    slot_end = slot + blocks
    first_slot = slot.copy()
    lane = np.arange(len(position))
    predicted = np.zeros((len(position), 4), np.int32)
    k = np.zeros(len(position), np.int64)
    simple = widest == 1 and (plan == plan[0]).all()
    last_bit = 8 * (len(data) - 8)
    while len(lane):
        if simple:
            component, dc_table, ac_table = 0, plan[0, 0, 1], plan[0, 0, 2]
        else:
            here = plan[of[lane], (slot - first_slot[lane]) % in_mcu[of[lane]]]
            component, dc_table, ac_table = here[:, 0], here[:, 1], here[:, 2]
        is_dc = k == 0
        seen = look[np.where(is_dc, dc_table, ac_table), (ahead[position >> 3] >> (16 - (position & 7)).astype(np.uint32)) & 0xFFFF]
        symbol = seen & 255
        position = position + (seen >> 8)
        more = np.where(is_dc, symbol, symbol & 15)
        if not seen.all() or position.max() > last_bit:
            raise ValueError("bad Huffman code")
        if is_dc.any():
            d = np.flatnonzero(is_dc)
            n = more[d].astype(np.uint32)
            p = position[d]
            extra = ((ahead[p >> 3] << (p & 7).astype(np.uint32)) >> np.minimum(32 - n, 31)) * (n > 0)
            low = (n > 0) & (extra < (1 << np.maximum(n, 1) - 1))
            diff = extra.astype(np.int32) - np.where(low, (1 << n) - 1, 0).astype(np.int32)
            c = component if simple else component[d]
            predicted[lane[d], c] += diff
            out[slot[d]] = predicted[lane[d], c]
        run = symbol >> 4
        ended = ~is_dc & (symbol == 0)
        k = np.where(is_dc, 1, k + run + 1)
        position = position + more
        done = ended | (k > 63)
        slot = slot + done
        k[done] = 0
        alive = slot < slot_end[lane]
        if not alive.all():
            lane, slot, k, position = lane[alive], slot[alive], k[alive], position[alive]

    found: list[list[tuple[int, int, np.ndarray]]] = [[] for _ in media]
    ends = np.cumsum([a * d * len(p) for (a, d), p in zip(shapes, plans, strict=True)]).tolist()
    begin = 0
    for image, i, end, (across, down), parts in zip(images, owner, ends, shapes, plans, strict=True):
        c = image.scan[0][0]
        _, h, v, q = image.components[c]
        if len(image.scan) == 1:
            h = v = 1
        luma = out[begin:end].reshape(down, across, len(parts))[:, :, : h * v].reshape(down, across, v, h).swapaxes(1, 2).reshape(down * v, across * h)
        begin = end
        small = np.clip((luma * image.quantisers[q] + 1024 + 4) >> 3, 0, 255).astype(np.uint8)
        found[i].append((image.width, image.height, small))
    return found


def thumbnail_hash(small: np.ndarray) -> str:
    """64 bits: which of 8 x 8 cells are above the mean of all cells."""
    rows, columns = (np.arange(8) * n // 8 for n in small.shape)
    cells = np.add.reduceat(np.add.reduceat(small.astype(np.int64), rows, axis=0), columns, axis=1)
    heights, widths = (np.maximum(np.diff(np.append(x, n)), 1) for x, n in zip((rows, columns), small.shape, strict=True))
    cells = cells / (heights[:, None] * widths)
    return np.packbits(cells.ravel() > cells.mean()).tobytes().hex()


def _stored(payloads: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """(owners, images): the payloads cut into images of at most ``MOST_ROWS`` rows, some ``STEP`` bytes of them at once."""
    owners: list[int] = []
    pieces: list[bytes] = []
    size = 0
    for i, p in enumerate(payloads):
        for a in range(0, len(p), MOST_ROWS * ROW):
            piece = p[a : a + MOST_ROWS * ROW]
            if pieces and size + len(piece) > STEP:
                yield owners, encode(pieces)
                owners, pieces, size = [], [], 0
            owners.append(i)
            pieces.append(piece)
            size += len(piece)
    if pieces:
        yield owners, encode(pieces)


def describe(texts: list[str]) -> list[pa.Array]:
    sized = [padded(t) for t in texts]
    stored: list[list[bytes]] = [[] for _ in texts]
    back: list[list[bytes]] = [[] for _ in texts]
    features: list[list[str]] = [[] for _ in texts]
    for owners, media in _stored([p for _, p in sized]):
        for i, m, images in zip(owners, media, thumbnails(media), strict=True):
            stored[i].append(m)
            for w, h, small in images:
                back[i].append(small.tobytes())
                features[i].append(f"{w}x{h}:{thumbnail_hash(small)}")
    rows = []
    for (n, _), m, p, f in zip(sized, stored, back, features, strict=True):
        payload, value = b"".join(p), b"".join(m)
        rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(value), hashlib.sha256(value).hexdigest(), ";".join(f)))
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return [pa.array(list(c), kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, media binary): the stored forms themselves."""

    def run(texts: list[str]) -> list[pa.Array]:
        values = [b""] * len(texts)
        for owners, media in _stored([padded(t)[1] for t in texts]):
            for i, m in zip(owners, media, strict=True):
                values[i] += m
        return [pa.array(values, pa.binary())]

    return map_texts(docs, text_col, [id_col], run, "media binary")


def query(docs: DataFrame) -> DataFrame:
    return map_texts(docs, "text", ["doc_id"], describe, "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
