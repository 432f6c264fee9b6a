"""Telephony files: every returned field against a plain decoder."""

import hashlib
import random
import struct
import zlib
from pathlib import Path

from pyspark.sql import functions as F

from parallax.llm import queries, telephony
from parallax.llm.common import Scratch, table

SF = "/root/testdata/sf0.01"


def plain_samples(codec, payload):
    out = []
    if codec == "adpcm":
        for at in range(0, len(payload), 64):
            block = payload[at : at + 64]
            value, index = struct.unpack("<h", block[:2])[0], min(block[2], 88)
            out.append(value)
            for b in block[4:]:
                for n in (b & 15, b >> 4):
                    step = int(telephony.STEPS[index])
                    change = (step >> 3) + (step >> 2) * (n & 1) + (step >> 1) * (n >> 1 & 1) + step * (n >> 2 & 1)
                    value = max(-32768, min(32767, value - change if n & 8 else value + change))
                    index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[n & 7]))
                    out.append(value)
        return out
    for b in payload:
        if codec == "mulaw":
            c = ~b & 255
            v = (((c & 15) * 8 + 132) << (c >> 4 & 7)) - 132
            out.append(-v if c & 128 else v)
        else:
            c = b ^ 0x55
            e, low = c >> 4 & 7, (c & 15) * 16
            v = low + 8 if e == 0 else (low + 264) << (e - 1)
            out.append(v if c & 128 else -v)
    return out


def test_every_field(spark):
    rng = random.Random(2)
    texts = [None, "", "a", "x" * 64, "y" * 65, "é\x00ü" * 50, "word " * 4000, *("".join(chr(rng.randrange(1, 0x2000)) for _ in range(rng.randrange(300))) for _ in range(60))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1, "again"), (None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("media", F.lit(1)).withColumn("pcm", F.lit(2)).withColumn("N_bytes", F.lit(3))
    scratch = Scratch(spark)
    stored = scratch.save(telephony.store(docs), "zstd")
    files = {(r["doc_id"], r["n_bytes"], hashlib.sha256(bytes(r["media"])).hexdigest()): bytes(r["media"]) for r in stored.collect()}
    decoded = scratch.save(telephony.read_back(stored), "zstd")
    pcm = {(r["doc_id"], r["payload_sha256"]): bytes(r["pcm"]) for r in decoded.collect()}
    got = telephony.with_pcm_digest(decoded).collect()
    assert len(got) == len(rows)
    want, codecs = {}, set()
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        want[i, hashlib.sha256(payload).hexdigest()] = (len(raw), payload)
    for r in got:
        n, payload = want.pop((r["doc_id"], r["payload_sha256"]))
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (n, len(payload), zlib.crc32(payload[-64:]))
        media = files[r["doc_id"], n, r["media_sha256"]]
        assert len(media) == r["media_bytes"] and payload in media and media[:4] == b"RIFF"
        assert struct.unpack("<I", media[4:8])[0] == len(media) - 8
        codec = {7: "mulaw", 6: "alaw", 17: "adpcm"}[struct.unpack("<H", media[20:22])[0]]
        codecs.add(codec)
        s = plain_samples(codec, payload)
        wide = [x for a, b in zip(s, [*s[1:], s[-1]], strict=True) for x in (a, (a + b) >> 1)]
        sound = struct.pack(f"<{len(wide)}h", *wide)
        assert pcm[r["doc_id"], r["payload_sha256"]] == sound
        crossings = sum((a < 0) != (b < 0) for a, b in zip(s, s[1:], strict=False))
        assert r["feature"] == (
            f"{codec};samples={len(s)};peak={max(map(abs, s))};mean_abs={sum(map(abs, s)) // len(s)};crossings={crossings}"
            f";pcm_bytes={len(sound)};pcm_crc32={zlib.crc32(sound)}"
        )
    assert not want and codecs == {"mulaw", "alaw", "adpcm"}
    assert telephony.read_back(telephony.store(docs.limit(0))).count() == 0


def test_any_samples_come_back_from_the_packed_form():
    rng = random.Random(3)
    for n in (0, 1, 2, 3, 7, 64, 1001):
        for low, high in ((-32768, 32767), (-2, 2)):
            pcm = struct.pack(f"<{n}h", *(rng.randint(low, high) for _ in range(n)))
            even, odd = telephony.pack(pcm)
            assert len(even) + len(odd) == len(pcm) and telephony.unpack(even, odd) == pcm
    ends = struct.pack("<5h", -32768, 32767, -32768, -32768, 32767)
    assert telephony.unpack(*telephony.pack(ends)) == ends


def test_query_keeps_files_and_sound_within_its_disk(spark, monkeypatch):
    """Both tables of the query hold all bytes and all samples, in at most one and a half times the input."""
    used = []
    monkeypatch.setattr(queries, "Scratch", lambda session: used.append(Scratch(session)) or used[-1])
    got = {r["doc_id"]: r for r in queries.op10_telephony_audio(spark, SF).collect()}
    saved = sorted(Path(used[0].root.removeprefix("file:")).iterdir())
    size = lambda path: sum(p.stat().st_size for p in path.rglob("*.parquet"))
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in table(spark, SF, "documents").collect()}
    media = {r["doc_id"]: bytes(r["media"]) for r in spark.read.parquet(saved[0].as_uri()).collect()}
    sound = {r["doc_id"]: r for r in spark.read.parquet(saved[1].as_uri()).collect()}
    assert set(got) == set(media) == set(sound) == set(texts)
    for i, raw in texts.items():
        codec, payload = telephony.from_wave(media[i])
        assert payload == telephony.pad(raw)
        samples = len(payload) if codec != "adpcm" else 121 * (len(payload) // 64)
        pcm = telephony.unpack(bytes(sound[i]["pcm_even"]), bytes(sound[i]["pcm_odd"]))
        assert len(pcm) == 4 * samples
        assert got[i]["feature"].endswith(f";pcm_bytes={len(pcm)};pcm_crc32={zlib.crc32(pcm)}")
        if i % 50 == 0:
            s = plain_samples(codec, payload)
            assert pcm == struct.pack(f"<{2 * samples}h", *(x for a, b in zip(s, [*s[1:], s[-1]], strict=True) for x in (a, (a + b) >> 1)))
    assert sum(map(size, saved)) <= 1.5 * Path(f"{SF}/documents.parquet").stat().st_size


def test_packed_rows_are_the_plain_rows(spark):
    texts = [None, "", "a", "x" * 64, "é\x00ü" * 50, "word " * 4000, *(f"text {i} " * i for i in range(40))]
    rows = [*enumerate(texts), (1, "again"), (None, "a"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pcm_even", F.lit(1)).withColumn("PCM", F.lit(2))
    stored = Scratch(spark).save(telephony.store(docs), "zstd")
    plain = telephony.read_back(stored)
    packed = telephony.with_pcm(Scratch(spark).save(telephony.read_back(stored, packed=True), "zstd"))
    assert packed.dtypes == plain.dtypes
    key = lambda r: tuple(map(str, r))
    assert sorted(packed.collect(), key=key) == sorted(plain.collect(), key=key) and packed.count() == len(rows)
    assert telephony.with_pcm(telephony.read_back(telephony.store(docs.limit(0)), packed=True)).count() == 0
