import gzip
import hashlib
import io
import random
import tracemalloc

from hypothesis import given, settings
from hypothesis import strategies as st

from shelfline.llm import warc


def raw(number, payload, revisit=False, refers=None):
    return warc.record(number, "http://x.org/a b", payload, hashlib.sha1(payload).hexdigest(), refers, revisit, "2020-01-01T00:00:00Z")


def parse(data):
    return list(warc.salvaged(io.BytesIO(data), len(data)))


def ids(found):
    return [x["fields"]["warc-record-id"] for x in found if x["kind"] == "record"]


def test_plain_and_gzipped_and_mixed():
    records = [raw(i, b"payload %d" % i * 50) for i in range(5)] + [raw(9, b"x" * 1000, True, 3)]
    for data in (b"".join(records), b"".join(map(gzip.compress, records)), gzip.compress(records[0]) + records[1] + gzip.compress(records[2] + records[3])):
        found = parse(data)
        assert all(x["kind"] == "record" for x in found)
        assert found[0]["payload"] == b"payload 0" * 50
    assert parse(b"".join(records))[-1]["bytes"] == 1000 and parse(b"".join(records))[-1]["payload"] is None
    assert parse(b"") == []


def test_damage_is_logged_and_later_records_recovered():
    records = [raw(i, bytes([65 + i]) * 300) for i in range(6)]
    for wrap in (bytes, gzip.compress):
        parts = [wrap(r) for r in records]
        start = sum(map(len, parts[:2]))
        bad = bytearray(parts[2])
        bad[len(bad) // 2] ^= 0xFF
        data = b"".join([*parts[:2], bytes(bad), *parts[3:]])
        found = parse(data)
        assert ids(found) == [f"<urn:page:{i}>" for i in (0, 1, 3, 4, 5)]
        gaps = [(x["start"], x["end"]) for x in found if x["kind"] == "gap"]
        assert gaps == [(start, start + len(parts[2]))]
        cut = b"".join(parts)[:-7]
        assert ids(parse(cut)) == [f"<urn:page:{i}>" for i in range(5)]
        junk = b"\x1f\x8b\x08 junk WARC/1.0\r\nX" + b"".join(parts)
        assert len(ids(parse(junk))) == 6 and parse(junk)[0]["kind"] == "gap"


def test_wrong_length_does_not_swallow_the_next_record():
    a, b = raw(1, b"a" * 200), raw(2, b"b" * 200)
    long = a.replace(b"Content-Length: 285", b"Content-Length: 985") if b"Content-Length: 285" in a else a.replace(b"\r\nContent-Length: 2", b"\r\nContent-Length: 9", 1)
    assert long != a
    assert ids(parse(long + b)) == ["<urn:page:2>"]


def test_damage_inside_a_member_of_many_records():
    records = [raw(i, bytes([65 + i]) * 300) for i in range(8)]
    start = sum(map(len, records[:3]))
    whole = b"".join(records)
    for damaged in (
        whole[: start + 200] + b"?" + whole[start + 201 :],
        whole[:start] + records[3].replace(b"Content-Length: ", b"Content-Length: 9", 1) + whole[start + len(records[3]) :],
        whole[:start] + b"XARC" + whole[start + 4 :],
    ):
        found = parse(gzip.compress(damaged) + gzip.compress(raw(9, b"later")))
        assert ids(found) == [f"<urn:page:{i}>" for i in (0, 1, 2, 4, 5, 6, 7, 9)]
        (gap,) = [x for x in found if x["kind"] == "gap"]
        after = len(damaged) - len(whole) + start + len(records[3])
        assert (gap["inflated_start"], gap["inflated_end"]) == (start, after)


def test_records_before_a_cut_or_an_inflation_error_are_kept():
    noise = random.Random(3)
    records = [raw(i, noise.randbytes(20_000)) for i in range(12)]
    packed, later = gzip.compress(b"".join(records)), gzip.compress(raw(99, b"later"))
    for at in (7, 10):
        cut = parse(packed[: len(packed) * at // 12])
        assert ids(cut) == [f"<urn:page:{i}>" for i in range(len(ids(cut)))] and at - 1 <= len(ids(cut)) <= at
        assert cut[-1]["kind"] == "gap" and cut[-1]["reason"] == "member beyond the end of the file"
    wrong = bytearray(packed)
    wrong[-6] ^= 1
    assert ids(parse(bytes(wrong) + later)) == [f"<urn:page:{i}>" for i in (*range(12), 99)]
    text = [raw(i, b" ".join(b"%d" % noise.randrange(10**9) for _ in range(2000))) for i in range(12)]
    packed = bytearray(gzip.compress(b"".join(text)))
    half = len(packed) // 2
    packed[half : half + 300] = b"\xff" * 300
    found = ids(parse(bytes(packed) + later))
    assert found[:5] == [f"<urn:page:{i}>" for i in range(5)] and found[-1] == "<urn:page:99>"


def test_a_large_member_is_read_in_bounded_memory():
    body = b"z" * (1 << 20)
    data = gzip.compress(b"".join(raw(i, body) for i in range(64)), 1)
    tracemalloc.start()
    assert sum(x["kind"] == "record" for x in warc.salvaged(io.BytesIO(data), len(data))) == 64
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 32 << 20


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=400), min_size=1, max_size=6), st.integers(0, 10**6), st.binary(min_size=1, max_size=30), st.booleans())
def test_bytes_are_records_or_gaps(payloads, place, noise, zipped):
    parts = [gzip.compress(raw(i, p)) if zipped else raw(i, p) for i, p in enumerate(payloads)]
    data = b"".join(parts)
    at = place % (len(data) + 1)
    found = parse(data[:at] + noise + data[at:])
    spans = [(x["start"], x["end"]) for x in found]
    assert spans[0][0] == 0 and spans[-1][1] == len(data) + len(noise)
    assert all(a[1] == b[0] or a == b for a, b in zip(spans, spans[1:]))
    assert sum(x["kind"] == "record" for x in found) >= len(parts) - 1


def brute(rows):
    out = []
    for page, _, html in rows:
        p = (html or "").encode()
        same = [r[0] for r in rows if (r[2] or "").encode() == p and r[0] is not None]
        top = max(same) if len(p) >= 1000 and same else page
        out.append((page, len(p), hashlib.sha1(p).hexdigest(), "response" if page == top else "revisit", None if page == top else top))
    return sorted(out, key=repr)


def test_pages_round_trip(spark):
    big, other = "é" * 600, "y" * 1000
    rows = [(1, "u", big), (7, "u", big), (3, None, big), (4, "u\nv", "small"), (5, "u", "small"), (6, "u", None), (8, "u", ""), (9, "u", other), (9, "u", other), (10, "u", "z" * 200_000)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    assert sorted((tuple(r) for r in warc.page_records(spark, table).collect()), key=repr) == brute(rows)
    assert warc.page_records(spark, table.limit(0)).collect() == []
    nameless = spark.createDataFrame([(None, "u", big), (2, "u", big)], "page_id long, url string, html string")
    found = {r.page_id: (r.record_type, r.refers_to) for r in warc.page_records(spark, nameless).collect()}
    assert found == {None: ("revisit", 2), 2: ("response", None)}
