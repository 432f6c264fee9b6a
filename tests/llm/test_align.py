"""The alignment against both libraries on whole texts and plain loops over all tokens."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from parallax.llm import align, bytebpe
from parallax.llm.common import Scratch
from parallax.llm.queries import op11_tokenizer_alignment

BITS = ["a", "the", "The", "é", "中", "ß", "1", "23", "!", "...", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "😀", "ing", "tion", "hello", "'s"] + [
    " ", " ", " ", "  ", "\n", "\t", " ", "　", "\x00", "\r\n", "́", "ﬁ", "aaaa", "   ",
]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(bytebpe.default_path())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=align.default_path())


def plain(texts, libraries):
    """Rows of the query's values, by loops."""
    a, b = libraries
    names = bytebpe.byte_names()
    table_a = {i: bytes(names.get(c, 0) for c in t) for t, i in a.get_vocab().items()}
    out, docs_of = [], Counter()
    for text in texts:
        whole = (" " + text).encode() if text else b""
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        spelt_a = [table_a[i] for i in ids_a]
        spelt_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
        if not whole or b"".join(spelt_a) != whole or b"".join(spelt_b) != whole:
            out.append(None)
            continue
        spans = []
        for spelt in (spelt_a, spelt_b):
            ends = np.cumsum([len(s) for s in spelt]).tolist()
            spans.append(list(zip([0, *ends], ends, strict=False)))
        links, j = [], 0
        for i, (s, e) in enumerate(spans[0]):
            while spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < e:
                links.append((ids_a[i], ids_b[k]))
                k += 1
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups = defaultdict(lambda: ([], []))
        for side, ids in enumerate((ids_a, ids_b)):
            for t, (_, e) in zip(ids, spans[side], strict=True):
                groups[next(c for c in cuts if c >= e) if len(cuts) < 500 else cuts[int(np.searchsorted(cuts, e))]][side].append(str(t))
        docs_of.update(set(links))
        out.append((len(ids_a), len(ids_b), links, ";".join(",".join(groups[c][0]) + "|" + ",".join(groups[c][1]) for c in cuts), len(cuts)))
    most = defaultdict(int)
    for (x, _), n in docs_of.items():
        most[x] = max(most[x], n)
    return [
        (0, 0, 0, 0, 0, 0, "") if r is None else (r[0], r[1], r[4], len(r[2]), sum(docs_of[p] == most[p[0]] for p in r[2]), sum(docs_of[p] for p in r[2]), r[3])
        for r in out
    ]


def texts_of(seed, n=250):
    rng = random.Random(seed)
    out = ["".join(rng.choices(BITS, k=rng.randrange(1, 40))) for _ in range(n)]
    return out + [None, "", " ", "  ", "a ", " a", "\n", "▁", "a▁ b", "x" * 3000, " " * 3000, "one two " * 9000] + out[:9]


def test_pieces_of_stretches_are_those_of_whole_texts(libraries):
    texts = [t or "" for t in texts_of(1, 2000) if "▁" not in (t or "")]
    own = align.Pieces()
    ids, ends = own.encode(*bytebpe.whole_text(pa.array([" " + t if t else "" for t in texts])))
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == libraries[1].encode(texts)


@pytest.mark.parametrize("head, most", [(1 << 18, 1 << 20), (40, 50), (0, 1)])
def test_against_loops(spark, libraries, monkeypatch, head, most):
    monkeypatch.setattr(align, "HEAD", head)
    monkeypatch.setattr(align, "PAIRS", most)
    texts = texts_of(2)
    docs = spark.createDataFrame([(i % 7 or None, t, i) for i, t in enumerate(texts)], "doc_id long, text string, place long").repartition(3)
    docs = docs.select("*", *[F.lit("x").alias(c) for c in ("row", "OWN", "pair", "n_best", "docs", "a")])
    got = align.agreement(spark, Scratch(spark).save(align.align(docs))).collect()
    assert len(got) == len(texts)
    of = {r["place"]: tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")) for r in got}
    want = plain(texts, libraries)
    assert sum(w[0] > 0 for w in want) > 200
    for i, w in enumerate(want):
        assert of[i] == w, texts[i]


def test_identity_map_and_frequent_pairs(spark):
    tools = align.both()
    raw = {i: tools.a.bytes[s : s + n].tobytes() for i, (s, n) in enumerate(zip(tools.a.begin, tools.a.length, strict=True))}
    known = np.flatnonzero(tools.identity >= 0)
    assert len(known) > 10_000
    for i in known[::97].tolist():
        j = int(tools.identity[i])
        assert tools.b.bytes[tools.b.begin[j] : tools.b.begin[j] + tools.b.length[j]].tobytes() == raw[i] and not tools.b.model.is_byte(j) or len(raw[i]) == 1
    pairs = spark.createDataFrame([(i, 1 + i // 10) for i in range(100)], "pair long, docs long")
    for head in (0, 9, 10, 37, 100, 1000):
        top, rest = align.frequent(pairs, head)
        assert top.count() <= head and top.count() + rest.count() == 100
        if head in (10, 100, 1000):
            assert top.count() == min(head, 100)


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert align.agreement(spark, Scratch(spark).save(align.align(docs))).count() == 0


def test_query(spark, small, libraries):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    want = plain([d["text"] for d in docs], libraries)
    got = {r["doc_id"]: tuple(r)[1:] for r in op11_tokenizer_alignment(spark, small).collect()}
    assert len(got) == len(docs)
    for d, w in zip(docs, want, strict=True):
        assert got[d["doc_id"]] == (*w[:6], hashlib.sha256(w[6].encode()).hexdigest() if w[0] else "")
