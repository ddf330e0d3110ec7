import hashlib
import zlib

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from annalist.llm import media_ts as ts
from annalist.llm.queries import QUERIES


def plain_crc(data):
    """Bit by bit, with nothing taken from the module."""
    register = 0xFFFFFFFF
    for byte in data:
        for k in range(7, -1, -1):
            top = register >> 31 ^ byte >> k & 1
            register = register << 1 & 0xFFFFFFFF ^ (0x04C11DB7 if top else 0)
    return register


def plain(media):
    """A second reader, written from the standard alone: packet by packet, byte by byte; it asserts what a conforming stream holds."""
    counters, programs, streams, clock_pid = {}, None, None, None
    open_, units, pts, pcr, access, tables_since = None, [], [], [], [], 0
    for at in range(0, len(media), 188):
        p = media[at : at + 188]
        assert p[0] == 0x47 and not p[1] & 0x80 and not p[3] & 0xC0
        pid, begins, control, counter = (p[1] & 0x1F) * 256 + p[2], p[1] >> 6 & 1, p[3] >> 4 & 3, p[3] & 15
        assert control in (1, 3) and counters.get(pid, (counter - 1) % 16) == (counter - 1) % 16
        counters[pid] = counter
        body, flags, clock = 4, 0, None
        if control == 3:
            body = 5 + p[4]
            assert body <= 188
            if p[4]:
                flags = p[5]
                if flags & 0x10:
                    assert p[4] >= 7 and p[10] & 0x7E == 0x7E and p[10] & 1 == 0 and p[11] == 0
                    clock = p[6] << 25 | p[7] << 17 | p[8] << 9 | p[9] << 1 | p[10] >> 7
                stuffing = p[12:body] if flags & 0x10 else p[6:body]
                assert set(stuffing) <= {0xFF}
        rest = p[body:]
        if pid == 0 or pid == programs:
            assert begins and rest[0] == 0
            size = 3 + ((rest[2] & 15) << 8 | rest[3])
            section, tail = rest[1 : 1 + size], rest[1 + size :]
            assert plain_crc(section) == 0 and set(tail) <= {0xFF} and section[1] & 0x80 and section[5] & 1
            if pid == 0:
                assert section[0] == 0
                programs = (section[10] & 0x1F) << 8 | section[11]
            else:
                assert section[0] == 2
                clock_pid, streams = (section[8] & 0x1F) << 8 | section[9], (section[13] & 0x1F) << 8 | section[14]
            tables_since = len(units)
            continue
        assert pid == streams
        if begins:
            if open_ is not None:
                units.append(open_)
            access += [len(units)] if flags & 0x40 else []
            # a reader may start at every random-access point: the tables stand right before it
            assert not flags & 0x40 or tables_since >= len(units) - 1
            assert pid == clock_pid and clock is not None
            pcr.append(clock)
            open_ = b""
        open_ += rest
    units += [open_] if open_ is not None else []
    payload = b""
    for u in units:
        assert u[:3] == b"\0\0\1" and u[6] & 0xC0 == 0x80 and u[7] >> 6 == 2 and u[8] == 5 and len(u) == 6 + (u[4] << 8 | u[5])
        t = u[9:14]
        assert t[0] >> 4 == 2 and t[0] & t[2] & t[4] & 1
        pts.append((t[0] >> 1 & 7) << 30 | (t[1] << 8 | t[2]) >> 1 << 15 | (t[3] << 8 | t[4]) >> 1)
        payload += u[14:]
    # clock references come at least every tenth of a second, and never after what they time
    assert all(0 < b - a <= 9000 for a, b in zip(pcr, pcr[1:])) and all(c <= t for c, t in zip(pcr, pts))
    return payload, pts, pcr, access


def test_start_at_any_random_access_point():
    payload = bytes(i % 255 for i in range(8192 * 20 + 77))
    media = ts.write_stream(payload)
    tables = [i for i in range(0, len(media), 188) if media[i + 1] & 0x1F == 0 and media[i + 2] == 0]
    assert len(tables) == 3
    for k, at in enumerate(tables):
        got = ts.read_stream(media[at:])
        assert got.errors == [] and got.payload == payload[8192 * 8 * k :] and got.access[0]


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 3000), st.sampled_from([1, 64, 168, 170, 171, 184, 500, 8192]))
def test_round_trip(n, unit):
    payload = bytes(i * 7 % 251 for i in range(n))
    media = ts.write_stream(payload, unit)
    assert len(media) % 188 == 0
    got = ts.read_stream(media)
    assert got.payload == payload and got.errors == [] and got.lost == 0
    assert got.pcr == [i * 3600 for i in range(-(-n // unit))] and got.pts == [9000 + t for t in got.pcr] and got.access == [i % 8 == 0 for i in range(len(got.pts))]
    assert plain(media) == (payload, got.pts, got.pcr, [i for i, a in enumerate(got.access) if a])
    assert got.sizes == [min(unit, n - i * unit) for i in range(len(got.pts))]


def test_damage_is_seen():
    payload = b"abc" * 9000
    media = ts.write_stream(payload)
    gone = media[: 188 * 20] + media[188 * 21 :]
    assert ts.read_stream(gone).lost == 1
    twice = media[: 188 * 20] + media[188 * 19 :]
    got = ts.read_stream(twice)
    assert got.duplicates == 1 and got.payload == payload and got.lost == 0
    short = ts.write_stream(b"abc")
    assert "no program association" in ts.read_stream(short[188:]).errors
    assert "no program map" in ts.read_stream(short[:188] + short[376:]).errors
    bad = bytearray(short)
    bad[10] ^= 1
    assert ts.read_stream(bytes(bad)).payload == b""
    for junk in (None, b"", b"x" * 500, b"\x47" * 1880, media[:-5], b"\x47\x40\x00\x30\xff" + b"\x00" * 183):
        assert isinstance(ts.read_stream(junk).errors, list)
    assert ts._pts(ts.pts_bytes((1 << 33) - 5)) == (1 << 33) - 5
    assert ts.crc32_mpeg(b"123456789") == 0x0376E6E7


def test_padding():
    assert [len(ts.padded(b"x" * n)) for n in (0, 1, 63, 64, 65)] == [64, 64, 64, 64, 128]


def test_query_on_all_documents(spark, sf_dir):
    texts = dict(zip(*pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pydict().values()))
    rows = QUERIES["op3_media_ts"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        payload = ts.padded(texts[r.doc_id].encode())
        media = ts.write_stream(payload)
        assert plain(media)[0] == payload
        assert r.n_bytes == len(texts[r.doc_id].encode()) and r.payload_bytes == len(payload)
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.media_bytes == len(media) and r.media_sha256 == hashlib.sha256(media).hexdigest() and r.feature.endswith("lost=0;errors=0")


def test_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (2, "", "y"), (3, "é" * 50000, "z"), (None, "a", "b")], "doc_id int, text string, media string")
    media = ts.mux(df)
    got = ts.demux(media).collect()
    assert len(got) == 5 and all(r.errors == [] for r in got)
    assert [bytes(r.payload) for r in got if r.doc_id == 3] == [ts.padded(("é" * 50000).encode())]
    assert ts.demux(media.limit(0)).collect() == []
    broken = spark.createDataFrame([(1, None), (2, bytearray(b"junk"))], "doc_id int, media binary")
    assert all(r.errors and r.payload_bytes == 0 for r in ts.demux(broken).collect())
