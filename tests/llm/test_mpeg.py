import hashlib
import random
import struct
import zlib

import pytest

from treelake.llm import mpeg


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 1001])
def test_round_trip(n):
    payload = random.Random(n).randbytes(n * 192)
    data = mpeg.write(payload, "tÿtle")
    f = mpeg.parse(data)
    assert mpeg.payload_of(data, f) == payload
    frames = -(-n // 4)
    assert (len(f["offsets"]), f["samples"], f["hertz"], f["vbr_frames"]) == (frames, 1152 * frames, 48000, frames)
    assert (f["crc_ok"], f["crc_bad"], f["skipped"], f["tags"]["TIT2"], f["tags"]["crc32"]) == (frames + 1, 0, 0, "tÿtle", str(zlib.crc32(payload)))
    assert f["vbr_bytes"] == len(data) - 128 - f["offsets"][0] + 240 and len(f["toc"]) == 100


def test_resynchronises_and_finds_damage():
    payload = bytes(192 * 40)
    data = mpeg.write(payload)
    at = mpeg.parse(data)["offsets"]
    junk = data[: at[3]] + b"\xff\xfb\x90junk\xff" * 3 + data[at[3] :]
    f = mpeg.parse(junk)
    assert f["skipped"] == 24 and len(f["offsets"]) == len(at) and mpeg.payload_of(junk, f) == payload
    broken = bytearray(data)
    broken[at[2] + 10] ^= 1
    assert mpeg.parse(bytes(broken))["crc_bad"] == 1
    assert mpeg.parse(b"")["offsets"] == [] and mpeg.parse(b"\xff" * 9)["offsets"] == []
    assert len(mpeg.parse(data[: at[5] + 17])["offsets"]) == 5


def test_other_layers():
    two = bytes([0xFF, 0xFD, 0x80, 0x00]) + bytes(144 * 128000 // 44100 - 4)  # Layer II, 128 kbit/s (index 8), 44.1 kHz
    one = bytes([0xFF, 0xFF, 0x40, 0xC0]) + bytes(12 * 128000 // 44100 * 4 - 4)
    f = mpeg.parse(two * 5)
    assert (len(f["offsets"]), f["samples"], f["hertz"]) == (5, 5 * 1152, 44100)
    assert mpeg.parse(one * 4)["samples"] == 4 * 384


def direct_crc(bits):
    """The CRC of a string of bits, one at a time."""
    crc = 0xFFFF
    for bit in bits:
        crc = (crc << 1 ^ (0x8005 if (crc >> 15 & 1) ^ int(bit) else 0)) & 0xFFFF
    return crc


def bits_of(data):
    return "".join(f"{b:08b}" for b in data)


@pytest.mark.parametrize(("mode", "index", "rate", "table", "bound"), [(0b11, 8, 0, "b", 30), (0b00, 8, 1, "a", 32), (0b01, 10, 0, "b", 8), (0b11, 1, 2, "d", 12), (0b11, 1, 0, "c", 8)])
def test_layer_two_crc(mode, index, rate, table, bound):
    """Allocations and scale factor selections of a frame made bit by bit."""
    rng = random.Random(index + mode)
    head = bytes([0xFF, 0xFC, index << 4 | rate << 2, mode << 6 | (1 << 4 if mode == 1 else 0)])
    widths = [b for n, b in mpeg.ALLOCATION[table] for _ in range(n)]
    bits, selected = "", 0
    for sub, width in enumerate(widths):
        shared = mode == 1 and sub >= bound
        for _ in range(1 if mode == 3 or shared else 2):
            value = rng.choice([0, rng.randrange(1 << width)])
            bits += f"{value:0{width}b}"
            selected += (2 if shared else 1) * (value > 0)
    bits += "".join(rng.choice("01") for _ in range(2 * selected))
    crc = direct_crc(bits_of(head[2:]) + bits)
    hertz, kbits = mpeg.HERTZ[3][rate], mpeg.KBITS[True, 2][index]
    whole = bits_of(head) + f"{crc:016b}" + bits
    whole += "1" * (-len(whole) % 8)
    frame = bytes(int(whole[i : i + 8], 2) for i in range(0, len(whole), 8)).ljust(144 * kbits * 1000 // hertz, b"\x55")
    f = mpeg.parse(frame * 3)
    assert (len(f["offsets"]), f["crc_ok"], f["crc_bad"]) == (3, 3, 0)
    bad = bytearray(frame * 3)
    bad[7] ^= 0x10
    assert mpeg.parse(bytes(bad))["crc_bad"] == 1


def test_tags_of_all_versions():
    size = lambda n: bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127])
    frame = mpeg.write(bytes(192))[mpeg._tags(mpeg.write(bytes(192)), 0)[1] :][:240]
    old = b"TT2" + (6).to_bytes(3, "big") + b"\0title" + b"TXX" + (5).to_bytes(3, "big") + b"\0k\0v\0"
    two = b"ID3\x02\0\0" + size(len(old)) + old
    three = b"TIT2" + (5).to_bytes(4, "big") + b"\0\0" + b"\0\xff\0ab"
    three = b"ID3\x03\0\xc0" + size(len(three) + 10) + (6).to_bytes(4, "big") + bytes(6) + three
    four = b"TIT2" + size(9) + b"\0\x01" + size(5) + b"\x03four"
    four = b"ID3\x04\0\x50" + size(len(four) + 6) + size(6) + b"\x01\0" + four + b"3DI\x04\0\x50" + size(len(four) + 6)
    for tag, title in ((two, "title"), (three, "\xffab"), (four, "four")):
        f = mpeg.parse(tag + frame * 2)
        assert f["tags"]["TIT2"] == title and f["skipped"] == 0 and len(f["offsets"]) >= 1
    assert mpeg.parse(two + frame)["tags"]["k"] == "v"


def test_tables_delays_and_free_bit_rates():
    data = bytearray(mpeg.write(bytes(192 * 9)))
    at = data.index(b"Xing") + 16 + 100
    data[at : at + 24] = b"LAME3.100" + bytes(12) + (576 << 12 | 1000).to_bytes(3, "big")
    f = mpeg.parse(bytes(data))
    assert (f["delay"], f["trailing"], f["play_samples"]) == (576, 1000, 3 * 1152 - 1576)
    frame = bytes([0xFF, 0xFB, 0x90, 0x00])
    length = 144 * 128000 // 44100
    vbri = frame + bytes(32) + b"VBRI" + struct.pack(">HHHIIHHHH", 1, 500, 75, 4 * length, 3, 2, 10, 2, 1) + struct.pack(">HH", 41, 42)
    f = mpeg.parse(vbri.ljust(length, b"\0") + (frame + bytes(length - 4)) * 3)
    assert (f["vbr_frames"], f["vbr_bytes"], f["vbri"], f["delay"], len(f["offsets"])) == (3, 4 * length, [410, 830], 500, 3)
    free = bytes([0xFF, 0xFB, 0x00, 0xC0]) + b"\x11" * 496
    padded = bytes([0xFF, 0xFB, 0x02, 0xC0]) + b"\x11" * 497
    f = mpeg.parse(free + padded + free + free)
    assert f["offsets"] == [0, 500, 1001, 1501] and f["samples"] == 4 * 1152 and f["skipped"] == 0


def test_nulls_repeats_clashes_and_long_texts(spark):
    long = "é" * 400_000
    rows = [(None, "a", 1.0), (1, long, 2.0), (1, long, 2.0), (2, "", 3.0), (3, None, 4.0)]
    got = mpeg.inspect_column(mpeg.encode_column(spark.createDataFrame(rows, "doc_id long, text string, duration double"))).collect()
    assert len(got) == 5 and {r.n_bytes for r in got} == {0, 1, 800_000}
    assert len({tuple(map(str, r)) for r in got if r.doc_id == 1}) == 1
    assert all(r.duration == r.play_samples / r.hertz == r.frames * 1152 / 48000 for r in got)


def test_columns(spark):
    texts = ["", None, "a", "é" * 96, "x" * 193, "y" * 5000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, media int")
    got = mpeg.inspect_column(mpeg.encode_column(df)).collect()
    for r in got:
        payload, n = mpeg.padded(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert len(r.offsets) == r.frames and r.crc_bad == r.skipped == 0
    assert mpeg.inspect_column(mpeg.encode_column(df.limit(0))).collect() == []
    assert mpeg.inspect_column(spark.createDataFrame([(1, None)], "i int, media binary")).first().frames is None
