from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from quire.llm import jpeg as J

from .conftest import odd_texts


def test_round_trip(spark, odd, empty):
    rows = {r.doc_id: r for r in J.query(odd).collect()}
    assert len(rows) == odd.count()
    for i, t in enumerate(odd_texts()):
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
    media = {r.doc_id: bytes(r.media) for r in J.store(odd).collect()}
    assert all(len(m) == rows[i].media_bytes and hashlib.sha256(m).hexdigest() == rows[i].media_sha256 for i, m in media.items())
    assert rows[5].feature == rows[6].feature and J.query(empty).count() == 0


def test_long_text_takes_several_images():
    text = "abcde" * 200_000
    n, payload = J.padded(text)
    r = J.describe([text, "short"])
    assert r[0].to_pylist() == [n, 5] and r[2][0].as_py() == hashlib.sha256(payload).hexdigest()
    assert r[6][0].as_py().count(";") == len(payload) // (J.MOST_ROWS * J.ROW)


class Bits:
    def __init__(self) -> None:
        self.bits: list[str] = []

    def put(self, value: int, n: int) -> None:
        if n:
            self.bits.append(f"{value:0{n}b}")

    def done(self) -> bytes:
        s = "".join(self.bits)
        s += "1" * (-len(s) % 8)
        return bytes(int(s[i : i + 8], 2) for i in range(0, len(s), 8)).replace(b"\xff", b"\xff\x00")


def number(v: int) -> tuple[int, int]:
    n = abs(v).bit_length()
    return (v if v >= 0 else v + (1 << n) - 1), n


AC_LENGTHS, AC_SYMBOLS = (0, 2, 1, 2, 2, 2, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0), (0x01, 0x00, 0x11, 0x02, 0x21, 0xF0, 0x12, 0x03, 0x31, 0x22)


def picture(seed: int, width: int, height: int, interval: int) -> tuple[bytes, np.ndarray]:
    """A colour image with 2 x 2 subsampling and AC coefficients, by a plain bit writer; and its DC thumbnail."""
    r = random.Random(seed)
    dc = {s: (c, n) for s, c, n in J.huffman_codes(J.DC_LENGTHS, J.DC_SYMBOLS)}
    ac = {s: (c, n) for s, c, n in J.huffman_codes(AC_LENGTHS, AC_SYMBOLS)}
    across, down, q = -(-width // 16), -(-height // 16), 6
    luma, parts, out, before = np.zeros((down * 2, across * 2), int), [], Bits(), [0, 0, 0]
    for m in range(across * down):
        if interval and m and m % interval == 0:
            parts.append(out.done() + bytes((0xFF, 0xD0 + (m // interval - 1) % 8)))
            out, before = Bits(), [0, 0, 0]
        for b, c in enumerate((0, 0, 0, 0, 1, 2)):
            v = r.randint(-150, 150)
            if c == 0:
                luma[m // across * 2 + b // 2, m % across * 2 + b % 2] = v
            extra, n = number(v - before[c])
            before[c] = v
            out.put(*dc[n])
            out.put(extra, n)
            k = 1
            while k < 64 and r.random() < 0.9:
                s = r.choice([x for x in AC_SYMBOLS if x and (k + (x >> 4) < 64 if x != 0xF0 else k + 16 < 64)])
                out.put(*ac[s])
                out.put(r.getrandbits(s & 15) if s & 15 else 0, s & 15)
                k += (s >> 4) + 1
            if k < 64:
                out.put(*ac[0])
    parts.append(out.done())
    head = b"\xff\xd8" + J._segment(0xFE, b"note") + J._segment(0xDB, b"\x00" + bytes([q]) * 64)
    head += J._segment(0xC0, b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + b"\x03\x01\x22\x00\x02\x11\x00\x03\x11\x00")
    head += J._segment(0xC4, b"\x00" + bytes(J.DC_LENGTHS) + bytes(J.DC_SYMBOLS) + b"\x10" + bytes(AC_LENGTHS) + bytes(AC_SYMBOLS))
    head += J._segment(0xDD, interval.to_bytes(2, "big")) if interval else b""
    head += J._segment(0xDA, b"\x03\x01\x00\x02\x00\x03\x00\x00\x3f\x00")
    return head + b"".join(parts) + b"\xff\xd9", np.clip((luma * q + 1024 + 4) >> 3, 0, 255)


def test_colour_images_with_and_without_restarts():
    made = [picture(s, w, h, i) for s, (w, h, i) in enumerate([(16, 16, 0), (50, 33, 0), (64, 48, 3), (17, 90, 1)])]
    own = J.encode([b"a" * 192])
    found = J.thumbnails([m for m, _ in made] + own)
    for (_, luma), images in zip(made, found, strict=False):
        assert (images[0][2] == luma).all()
    assert found[-1][0][2].tobytes() == b"a" * 192


def test_what_is_no_baseline_jpeg_is_refused():
    good = J.encode([b"b" * 384])[0]
    for bad in (b"", good[2:], good.replace(b"\xff\xc0", b"\xff\xc2"), good[:-2]):
        with pytest.raises(ValueError):
            J.thumbnails([bad, b"\x00"] if not bad else [bad])
