import hashlib
import random
import zlib

from edge import no_documents, odd_documents

from quire.llm import media


def test_round_trip():
    rng = random.Random(2)
    for n in (0, 1, 63, 64, 65, 160, 170, 176, 183, 184, 185, 300, 5000, 32768, 32769, 70000):
        data = rng.randbytes(n)
        stream = media.write_stream(media.padded(data))
        assert len(stream) % 188 == 0 and all(stream[i] == 0x47 for i in range(0, len(stream), 188))
        found = media.read_stream(stream)
        assert b"".join(u.data for u in found.units) == media.padded(data)
        assert (found.programs, found.streams, found.gaps, found.bad_tables) == ({1: 0x1000}, {0x100: 6}, 0, 0)
        assert [u.pts for u in found.units] == [k * media.CLOCK for k in range(len(found.units))] and all(u.random_access and not u.broken for u in found.units)
        assert found.clocks == [k * media.CLOCK * 300 for k in range(len(found.units))]


def test_damage_is_seen():
    payload = media.padded(random.Random(1).randbytes(70000))
    stream = media.write_stream(payload)
    lost = media.read_stream(stream[: 188 * 10] + stream[188 * 11 :])
    assert lost.gaps == 1 and [u.broken for u in lost.units] == [True, False, False]
    assert lost.unnamed == 0
    twice = media.read_stream(stream[: 188 * 11] + stream[188 * 10 :])
    assert twice.repeats == 1 and twice.gaps == 0 and b"".join(u.data for u in twice.units) == payload
    around = media.read_stream(b"xx" + stream + b"yy")
    assert around.skipped == 4 and b"".join(u.data for u in around.units) == payload
    bad = bytearray(stream)
    bad[20] ^= 1
    assert media.read_stream(bytes(bad)).bad_tables == 1
    assert media.read_stream(b"").units == [] and media.read_stream(b"nothing").packets == 0


def by_hand(pid, payload, counter, begins):
    """A packet of raw bytes, made without the writer."""
    assert len(payload) == 184
    return bytes([0x47, (0x40 if begins else 0) | pid >> 8, pid & 255, 0x10 | counter]) + payload


def crc_bits(data):
    """The checksum of sections, bit by bit."""
    c = 0xFFFFFFFF
    for byte in data:
        for k in range(7, -1, -1):
            top = (c >> 31) ^ (byte >> k & 1)
            c = (c << 1) & 0xFFFFFFFF ^ (0x04C11DB7 if top else 0)
    return c.to_bytes(4, "big")


def section(table, body):
    head = bytes([table, 0xB0, len(body) + 9, 0, 1, 0xC1, 0, 0]) + body
    return head + crc_bits(head)


PAT = section(0, bytes([0, 7, 0xE0 | 0x02, 0x30]))  # program 7: map in PID 0x230
PMT = section(2, bytes([0xE1, 0x11, 0xF0, 0, 0x1B, 0xE1, 0x11, 0xF0, 0]))  # video in PID 0x111
PES = bytes([0, 0, 1, 0xE0, 0, 0, 0x80, 0xC0, 10, 0x31, 0, 5, 0xBF, 0x21, 0x11, 0, 5, 0x9F, 0x91]) + bytes(range(165))  # one second, and 85,960 ticks


def test_hand_made_stream():
    """Sections behind others and behind a pointer, timestamps and a unit, all from raw bytes."""
    other = section(0x42, b"x" * 30)
    fill = lambda b: b.ljust(184, b"\xff")
    several = by_hand(0, fill(b"\0" + other + PAT), 0, True)
    # The map begins at the end of one packet and ends behind the pointer of the next, where a second copy begins.
    early, late = b"\0" + section(0x42, b"y" * 161) + PMT[:10], bytes([len(PMT) - 10]) + PMT[10:] + PMT
    split = by_hand(0x230, early, 3, True) + by_hand(0x230, fill(late), 4, True)
    found = media.read_stream(several + split + by_hand(0x111, PES, 0, True))
    assert (found.programs, found.streams, found.clock_pid) == ({7: 0x230}, {0x111: 0x1B}, 0x111)
    assert (found.bad_tables, found.gaps, found.unnamed, found.packets) == (0, 0, 0, 4)
    (unit,) = found.units
    assert unit.data == bytes(range(165)) and not unit.broken and unit.stream_id == 0xE0
    assert (unit.pts, unit.dts) == (90_000, 85_960)
    cut = media.read_stream(several + by_hand(0x230, early, 3, True) + by_hand(0x230, fill(late), 6, True) + by_hand(0x111, PES, 0, True))
    assert cut.gaps == 1 and cut.bad_tables == 1 and len(cut.units) == 1 and cut.streams == {0x111: 0x1B}
    alone = media.read_stream(by_hand(0x111, PES, 0, True) + by_hand(0x111, PES, 1, True))
    assert alone.unnamed == 2 and [u.data for u in alone.units] == [bytes(range(165))] * 2
    begun = media.read_stream(several + by_hand(0x230, early, 3, True))
    assert begun.bad_tables == 1


def test_streams_can_be_entered():
    payload = media.padded(random.Random(4).randbytes(100_000))
    stream = media.write_stream(payload)
    whole = media.read_stream(stream)
    assert len(whole.units) == 4
    for k, unit in enumerate(whole.units):
        found = media.read_stream(stream[unit.offset :])
        assert [u.data for u in found.units] == [u.data for u in whole.units[k:]] and not any(u.broken for u in found.units)
        assert [u.pts for u in found.units] == [u.pts for u in whole.units[k:]] and (found.gaps, found.bad_tables, found.unnamed, found.skipped) == (0, 0, 0, 0)


def test_crc():
    assert media.crc_mpeg(b"123456789") == 0x0376E6E7


def test_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in media.op4_transport_stream(spark, sf_dir).collect():
        data = docs[r.doc_id].encode()
        payload = data + b"\0" * (-len(data) % 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        stream = media.write_stream(payload)
        assert (r.media_bytes, r.media_sha256) == (len(stream), hashlib.sha256(stream).hexdigest()) and r.feature.endswith("gaps=0;bad=0")
        units = media.read_stream(stream).units
        assert r.timestamps == ",".join(f"{u.pts}@{u.offset}*" for u in units) and len(units) == -(-len(payload) // media.UNIT)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    found = media.stored(docs).collect()
    assert len(found) == docs.count() and {r.payload_bytes for r in found if r.id == 1} == {64}
    assert all(sum(u.bytes for u in r.units) == r.payload_bytes and bytes(r.media)[0] == 0x47 for r in found)
    assert media.stored(no_documents(spark)).count() == 0
