"""Byte-level BPE against the tokenizers library and against merging one pair at a time."""

import hashlib
import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from parallax.llm import bytebpe
from parallax.llm.queries import op13_bpe_encoding

BITS = (
    "' 's 're 'r 'll 'd s t re The a é 中 ß 1 ² ٣ ! ... <|endoftext|> <| |> endoftext 😀 aaaa hello 'S ’s ve'".split()
    + [" ", "  ", "\n", "\t", " ", "　", "́", "\x00", "​", "\r\n", "▁", "�"]
)


def library(specials=True):
    out = Tokenizer.from_file(bytebpe.default_path())
    out.encode_special_tokens = not specials
    return out


def ids(own, texts):
    out, ends = own.encode(*bytebpe.whole_text(pa.array(texts, pa.string())))
    return [out[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]


@pytest.mark.parametrize("specials", [True, False])
def test_same_ids_as_the_library(specials):
    rng = random.Random(5)
    own, lib = bytebpe.ByteBpe(bytebpe.default_path(), specials), library(specials)
    texts = ["".join(rng.choices(BITS, k=rng.randrange(40))) for _ in range(3000)]
    texts += ["", "a" * 5001, "ab" * 3000, "=-" * 2000, " " * 3001, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz+/", k=20000))]
    points = [chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    texts += ["a" + "".join(points[k : k + 61]) + " b" for k in range(0, len(points), 61)]
    assert ids(own, texts) == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_rounds_merge_as_one_pair_at_a_time():
    own, rng = bytebpe.bpe(), random.Random(7)
    rank = {int(k): (int(r), int(own.made[r])) for k, r in zip(own.keys[:-1], own.ranks[:-1], strict=True)}

    def plain(word):
        parts = own.base[list(word)].tolist()
        while True:
            found = min(((rank[k], i) for i, k in enumerate(a * own.size + b for a, b in zip(parts, parts[1:], strict=False)) if k in rank), default=None)
            if found is None:
                return parts
            (_, made), i = found
            parts[i : i + 2] = [made]

    words = [bytes(rng.choices(b"aeinrst ", k=rng.randrange(1, 30))) for _ in range(800)] + [b"a" * k for k in range(1, 40)] + [bytes(range(256))]
    got, ends = own.merge(words)
    assert [got[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [plain(w) for w in words]


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(bytebpe, "KEEP_WORDS", 3)
    own = bytebpe.ByteBpe(bytebpe.default_path())
    texts = [f"word{k} and others, {k * k}" for k in range(50)]
    assert [ids(own, [t])[0] for t in texts] == [e.ids for e in library().encode_batch(texts, add_special_tokens=False)]


def test_files_whose_merges_are_out_of_order_are_refused(tmp_path):
    spec = json.load(open(bytebpe.default_path(), encoding="utf-8"))
    spec["model"]["merges"].reverse()
    (tmp_path / "v.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="before"):
        bytebpe.ByteBpe(str(tmp_path / "v.json"))


def test_odd_tables(spark):
    texts = [None, "", " \n", "one", "one", "<|endoftext|>x <|endoftext|>", "é" * 70000]
    docs = spark.createDataFrame([(i if i % 3 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs = docs.unionAll(docs.sparkSession.sql("select 9L, cast(x'61ff62c3' as string)")).select("*", F.lit("old").alias("IDS"), F.lit(1).alias("n_tokens"), F.lit(2).alias("decoded"))
    got = bytebpe.decode(bytebpe.encode(docs)).collect()
    assert len(got) == len(texts) + 1 and {c.lower() for c in got[0].asDict()} == {"doc_id", "text", "ids", "n_tokens", "decoded"}
    want = [e.ids for e in library().encode_batch([t or "" for t in texts] + ["a�b�"], add_special_tokens=False)]
    assert sorted(np.frombuffer(r["ids"], "<u4").tolist() for r in got) == sorted(want)
    assert sorted(r["decoded"] for r in got) == sorted([t or "" for t in texts] + ["a�b�"])
    assert bytebpe.decode(bytebpe.encode(docs.limit(0))).count() == 0
    assert [r[0] for r in spark.range(1).select(bytebpe.text_of_ids(F.expr("x'80000000'"))).collect()] == [library().decode([128], skip_special_tokens=False)]


def test_query(spark, small):
    got = {r["doc_id"]: r for r in op13_bpe_encoding(spark, small).collect()}
    docs, lib = spark.read.parquet(f"{small}/documents.parquet").collect(), library()
    assert len(got) == len(docs)
    for d in docs:
        i, r = lib.encode(d["text"] or "", add_special_tokens=False).ids, got[d["doc_id"]]
        assert r["n_tokens"] == len(i) and r["ids_sha256"] == hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(i, skip_special_tokens=False).encode()).hexdigest()
