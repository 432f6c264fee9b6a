"""The source audit against plain Python, on odd tables, hot copies and small tiles."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from parallax.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, least, top=50):
    """Every group against every other over every kept term."""
    docs = [tuple(x or "" for x in d) for d in docs]
    df, counts = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        terms = TERM.findall(text.translate(LOWER))
        df[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = set()
    for lang in {d[1] for d in docs}:
        kept = [t for t, n in df[lang].items() if n >= least]
        sources = sorted({d[2] for d in docs if d[1] == lang})
        of = {s: {t: counts[lang, s][t] for t in kept} for s in sources}
        whole = {t: sum(of[s][t] for s in sources) for t in kept}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        p, q = {s: share(of[s]) for s in sources}, share(whole)
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(q[t] - p[s][t], t.encode()) for t in kept if of[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, i.decode(), -v, k) for k, (v, i) in enumerate(found, 1)}
    return out


def audited(spark, rows, least=3):
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    docs = docs.select("*", *[F.lit("x").alias(c) for c in ("n", "DOCS", "digest", "held", "term", "p", "gid", "block", "rank")])
    got = [tuple(r) for r in divergence.audit(spark, docs, least).collect()]
    assert len(got) == len(set(got))
    return set(got)


def corpus():
    words = "the The a été É naïve end x1y don't ünï_cödé 中文 K ſ".split()
    rows = [(" ".join(words[(i * k + k // 2) % len(words)] for k in range(1, 4 + i % 9)), ["en", "fr", None][i % 3], [None, "a", "b", "c", "é"][i % 5]) for i in range(150)]
    rows += [(rows[7][0], "en", s) for s in ["a"] * 40 + ["b"] * 3] + [(None, "en", "a"), ("", "de", "a"), (" 12 \n", "de", "b"), ("only here", "es", "a")]
    return rows + rows[:20]


@pytest.mark.parametrize("sizes", [(128, 4096, 1 << 20), (2, 4, 7)])
def test_against_plain(spark, monkeypatch, sizes):
    for name, n in zip(("BLOCK", "BUCKET", "ROWS"), sizes, strict=True):
        monkeypatch.setattr(divergence, name, n)
    rows = corpus()
    assert audited(spark, rows) == plain(rows, 3)


def test_no_rows_no_terms_and_one_source(spark):
    assert audited(spark, []) == set()
    rows = [("few words", "en", "a"), (None, "en", "b"), ("alone", "fr", "a")]
    assert audited(spark, rows, 30) == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}


def test_a_text_is_cut_once(spark):
    """Copies in several sources and partitions become one row."""
    docs = spark.createDataFrame([(t, "en", s) for t in ("one", "two", "") for s in ("a", "b") for _ in range(50)], "text string, lang string, source string").repartition(7)
    got = {r["text"]: sorted(map(tuple, r["held"])) for r in divergence.collapsed(docs).collect()}
    assert got == {t: [("a", 50), ("b", 50)] for t in ("one", "two", "")}


def test_long_texts(spark):
    rows = [("Word été " * 60000, "en", s) for s in ("a", "b", "b")] + [("word " * 5 + "other", "en", "c")] * 3
    assert audited(spark, rows) == plain(rows, 3)
