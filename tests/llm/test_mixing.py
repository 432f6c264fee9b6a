"""Raking and sampling against a plain version, with the production targets."""

import hashlib
import random
import re

import pytest

from parallax.llm import raking
from parallax.llm.queries import TARGETS


def plain_topic(text):
    text = text or ""
    if " | " in text:
        return "table"
    if "License" in text or "rights reserved" in text:
        return "notice"
    if "###" in text or "$$$" in text:
        return "noise"
    return "long" if len(text) >= 2000 else "short"


def plain_mix(rows, targets, keep=1.0):
    """(topic, tokens, weight, probability, sampled) of each (doc_id, text, source, lang)."""
    facts = []
    for i, text, source, lang in rows:
        values = {"source": source or "", "lang": lang or "", "topic": plain_topic(text)}
        cell = tuple(values[a] if values[a] in targets.get(a, {}) else None for a in raking.AXES)
        facts.append((cell, values["topic"], len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))))
    own = {}
    for cell, _, n in facts:
        own[cell] = own.get(cell, 0) + n
    whole = sum(own.values())
    own = {c: n / whole if whole else 0.0 for c, n in own.items()}
    fit = dict(own)
    for _ in range(raking.SWEEPS):
        for k, axis in enumerate(raking.AXES):
            part = {}
            for c, s in own.items():
                part[c[k]] = part.get(c[k], 0) + s
            named = targets.get(axis) or {}
            to = {v: (named.get(v) if v is not None else (max(0.0, round(1 - sum(named.values()), 12)) if named else 1.0)) for v, s in part.items() if s > 0}
            if not sum(to.values()):
                to = {v: s for v, s in part.items() if s > 0}
            now = {}
            for c, s in fit.items():
                now[c[k]] = now.get(c[k], 0) + s
            fit = {c: s * to.get(c[k], 0) / sum(to.values()) / now[c[k]] if now[c[k]] else 0.0 for c, s in fit.items()}
    total = sum(fit.values())
    weight = {c: fit[c] / total / own[c] if own[c] else 1.0 for c in own}
    peak = max(weight.values(), default=0)
    out = []
    for (i, *_), (cell, topic, n) in zip(rows, facts, strict=True):
        chance = keep * weight[cell] / peak if peak else 0.0
        draw = int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:8], 16) / 2**32
        out.append((topic, n, weight[cell], chance, draw < chance))
    return out


def sample(n=3000, langs=("en",) * 12 + ("fr",) * 3 + ("de",) * 3 + ("es",) * 2 + (None, "it")):
    rng = random.Random(5)
    out = [(None, "no id", "src0", "en"), (7, None, None, None), (7, "", "src1", "en"), (n + 1, "w " * 5000, "src2", "de")]
    for i in range(n):
        text = "w " * rng.randint(1, 9) + rng.choice(["", "", "", "###", "License", "a | b"])
        out.append((i, text, f"src{rng.randrange(20)}", rng.choice(langs)))
    return out


KIND = "doc_id long, text string, source string, lang string"


@pytest.mark.parametrize(
    ("targets", "keep"),
    [
        (TARGETS, 1.0),
        (TARGETS, 0.4),
        ({"source": {"src0": 0.5}, "lang": {"en": 0.0, "xx": 0.2}}, 1.0),
        ({}, 1.0),
        ({"lang": {"it": 1.0}, "topic": {"long": 0.9}}, 1.0),
    ],
)
def test_against_plain_raking(spark, targets, keep):
    rows = sample()
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], KIND + ", nr long")
    got = {r["nr"]: r for r in raking.mix_sources(docs, targets, keep).collect()}
    assert len(got) == len(rows)
    for k, (topic, n, weight, chance, sampled) in enumerate(plain_mix(rows, targets, keep)):
        r = got[k]
        assert (r["topic"], r["n_tokens"], r["sampled"]) == (topic, n, sampled)
        assert (r["weight"], r["probability"]) == pytest.approx((weight, chance), rel=1e-9, abs=1e-12)


def test_sample_meets_its_targets(spark):
    out = raking.mix_sources(spark.createDataFrame(sample(6000)[4:], KIND), TARGETS).collect()
    kept = sum(r["probability"] * r["n_tokens"] for r in out)
    drawn = sum(r["n_tokens"] for r in out if r["sampled"])
    assert max(r["probability"] for r in out) == 1
    for axis, shares in TARGETS.items():
        for value, share in shares.items():
            assert sum(r["probability"] * r["n_tokens"] for r in out if r[axis] == value) / kept == pytest.approx(share, abs=1e-6)
            assert sum(r["n_tokens"] for r in out if r["sampled"] and r[axis] == value) / drawn == pytest.approx(share, abs=0.03)
    assert not any(r["sampled"] for r in out if r["lang"] not in TARGETS["lang"])


def test_odd_tables(spark):
    docs = spark.createDataFrame(sample(5), KIND)
    assert raking.mix_sources(docs.limit(0), TARGETS).count() == 0
    empty = spark.createDataFrame([(1, None, "s", "it"), (2, "", None, None)], KIND)
    assert {r["weight"] for r in raking.mix_sources(empty, TARGETS).collect()} == {1.0}
    clash = docs.selectExpr("*", "1 as topic", "2 as Weight", "3 as tokens", "4 as row", "5 as peak", "6 as of_lang")
    out = raking.mix_sources(clash, TARGETS)
    assert out.columns == [*docs.columns, "tokens", "row", "peak", "of_lang", "topic", "n_tokens", "weight", "probability", "sampled"]
    assert {(r["tokens"], r["row"], r["peak"], r["of_lang"]) for r in out.collect()} == {(3, 4, 5, 6)}
    with pytest.raises(ValueError):
        raking.mix_sources(docs, {"lang": {"en": -0.1}})
    with pytest.raises(ValueError):
        raking.mix_sources(docs, TARGETS, 4.0)
