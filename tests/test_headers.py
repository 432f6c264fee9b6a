"""Headers and boxes: crafted files of every kind, broken at every byte, and boxes at any depth."""

import struct

import pytest

from parallax.sources import containers as CT
from parallax.sources import headers as HD
from parallax.sources import pictures as PC


def tiff(order="<", orientation=6, focal=28, size=None, ratio=False):
    pack = lambda f, *v: struct.pack(order + f, *v)
    entries = [pack("HHIHH", 0x112, 3, 1, orientation, 0)] if orientation is not None else []
    if size:
        entries += [pack("HHII", 0x100, 4, 1, size[0]), pack("HHIHH", 0x101, 3, 1, size[1], 0)]
    inner = 8 + 2 + 12 * (len(entries) + 1) + 4
    entries.append(pack("HHII", 0x8769, 4, 1, inner))
    lens = pack("HHII", 0xA405, 5, 1, inner + 18) if ratio else pack("HHIHH", 0xA405, 3, 1, focal, 0)
    head = (b"II*\0" if order == "<" else b"MM\0*") + pack("I", 8)
    return head + pack("H", len(entries)) + b"".join(entries) + pack("I", 0) + pack("H", 1) + lens + pack("I", 0) + (pack("II", focal * 3, 3) if ratio else b"")


def jpeg(exif=None, size=(640, 480), marker=0xC0, before=b""):
    part = lambda m, body: struct.pack(">BBH", 0xFF, m, len(body) + 2) + body
    out = b"\xff\xd8" + part(0xE0, b"JFIF\0") + before
    out += part(0xE1, b"http://ns.adobe.com/xap/1.0/\0<x/>") + (part(0xE1, b"Exif\0\0" + exif) if exif else b"")
    out += part(0xC4, b"\0" * 5) + b"\xff\xff" + part(marker, struct.pack(">BHHB", 8, size[1], size[0], 3) + b"\0" * 9)[1:]
    return out + part(0xDA, b"\0" * 6) + b"\xff\xc0\0\x11\x08\0\1\0\1"


@pytest.mark.parametrize("order", ["<", ">"])
def test_kinds(order):
    assert HD.read(jpeg(tiff(order))) == ("jpeg", 640, 480, 6, 28.0)
    assert HD.read(jpeg(tiff(order, ratio=True), marker=0xC2)) == ("jpeg", 640, 480, 6, 28.0)
    assert HD.read(jpeg(tiff(order, None, 0))) == ("jpeg", 640, 480, None, None)
    assert HD.read(jpeg(tiff(order, 9))) == ("jpeg", 640, 480, None, 28.0)
    assert HD.read(jpeg()) == ("jpeg", 640, 480, None, None)
    assert HD.read(tiff(order, 3, 50, (4000, 3000))) == ("tiff", 4000, 3000, 3, 50.0)
    png = PC.to_png(bytes(12), 2, 2, 3, 8)
    assert HD.read(png) == ("png", 2, 2, None, None)
    part = tiff(order, 8)
    assert HD.read(png[:33] + struct.pack(">I", len(part)) + b"eXIf" + part + bytes(4) + png[33:]) == ("png", 2, 2, 8, 28.0)


def test_no_file_is_an_error():
    for data in (None, b"", b"\xff", b"\xff\xd8", b"GIF89a", b"II*\0", b"II*\0\xff\xff\xff\xff", b"\xff\xd8\xff\xe1\0\1", PC.SIGNATURE, b"\xff\xd8" + b"\xff" * 50, tiff(size=(0, 5))):
        assert HD.read(data) == (None,) * 5
    for whole in (jpeg(tiff()), tiff(size=(7, 5)), PC.to_png(bytes(12), 2, 2, 3, 8)):
        want = HD.read(whole)
        for n in range(len(whole)):
            got = HD.read(whole[:n])
            assert got == (None,) * 5 or got[:3] == want[:3]
        for n in range(2, len(whole)):
            HD.read(whole[:n] + bytes([whole[n] ^ 0xFF]) + whole[n + 1 :])
    loop = bytearray(tiff(size=(7, 5)))
    at = loop.index(struct.pack("<HH", 0x8769, 4)) + 8
    loop[at : at + 4] = struct.pack("<I", 8)  # the inner directory is the outer one
    assert HD.read(bytes(loop))[1:3] == (7, 5)
    assert HD.read(jpeg(b"II*\0\x08\0\0\0\xff\xff"))[1:] == (640, 480, None, None)


def test_photos(spark):
    rows = [(1, jpeg(tiff())), (2, jpeg(tiff(orientation=1))), (3, b"no"), (4, None)]
    got = {r["id"]: tuple(r)[1:] for r in HD.photos(spark.createDataFrame(rows, "id int, content binary")).collect()}
    assert got == {1: ("jpeg", 480, 640, 6, 28 / 36 * 480), 2: ("jpeg", 640, 480, 1, 28 / 36 * 640), 3: (None,) * 5, 4: (None,) * 5}
    assert HD.photos(spark.createDataFrame([], "id int, content binary")).count() == 0


def box(kind, body, wide=False, zero=False):
    return struct.pack(">I4sQ", 1, kind, 16 + len(body)) + body if wide else struct.pack(">I4s", 0 if zero else 8 + len(body), kind) + body


def test_box_tree(spark):
    entry = box(b"avc1", bytes(78) + box(b"sv3d", box(b"proj", box(b"prhd", bytes(16)))))
    film = box(b"ftyp", b"isom") + box(b"moov", box(b"trak", box(b"mdia", box(b"minf", box(b"stbl", box(b"stsd", bytes(8) + entry, True)))))) + box(b"mdat", b"xyz", zero=True)
    paths = [(p, d) for p, d, *_ in CT.walk(film)]
    deep = "moov/trak/mdia/minf/stbl/stsd/avc1/sv3d/proj/prhd"
    assert paths == [("ftyp", 0), *[(deep.rsplit("/", k)[0] if k else deep, 9 - k) for k in range(9, -1, -1)], ("mdat", 0)]
    for path, _, kind, start, size in CT.walk(film):
        assert film[start + 4 : start + 8] == kind.encode() == path.rsplit("/")[-1].encode() and start + size <= len(film)
    # A box that is too long ends the walk of the one around it, not of what comes behind.
    broken = box(b"moov", box(b"trak", b"") + struct.pack(">I4s", 99, b"mdia")) + box(b"free", b"")
    assert [r[0] for r in CT.walk(broken)] == ["moov", "moov/trak", "free"]
    assert [r[2] for r in CT.walk(box(b"\xa9nam", b""))] == ["©nam"]
    nest = b""
    for _ in range(3000):
        nest = box(b"moov", nest)
    assert max(d for _, d, *_ in CT.walk(nest)) == 2999
    for n in range(len(film)):
        list(CT.walk(film[:n]))
    rows = spark.createDataFrame([(1, film), (2, None), (3, b""), (4, b"no film at all")], "id int, content binary").selectExpr("id", "content")
    got = rows.select("id", CT.box_tree("content").alias("b")).collect()
    assert {r["id"]: len(r["b"]) for r in got} == {1: 12, 2: 0, 3: 0, 4: 0}
