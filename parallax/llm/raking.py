"""Mixing sources to target weights by raking (iterative proportional fitting), with DataFrame functions only.

Documents fall into cells by source, language and topic. The values that an axis names targets for are groups of their
own; all others of the axis make one more group, whose target is what the named shares leave of 1. So the number of
cells is bounded by the targets, ``(named + 1)`` multiplied over the axes, whatever the data hold, and the whole table of
cells is one short array. Cell token counts are scaled in turn to each axis' target shares, ``SWEEPS`` times, by
higher-order functions over that array. A cell's scaled share over its own share is the weight of its tokens.

A document stays with probability ``keep * weight / largest weight``, decided by a hash of its id, so a run is repeatable
and needs no state. No probability is above 1, so in expectation the kept tokens meet the targets as the weights do, and
``keep`` in (0, 1] is the share of the largest such sample.

Defined results: null source, language or text count as the empty string, which is a value like others; where the named
shares reach 1 nothing of the other values stays; named values without tokens are left out and the rest is scaled up; an
axis without targets, or none of whose targets has tokens, stays as it is; targets that no mix of the cells can meet
together end where the last axis is met; a document without words weighs like its cell, and a cell without tokens has
weight 1; a null id draws like an empty one; repeated ids are decided alike; an empty table gives no rows. Columns of the
input are kept, but for those with the name of a result column, which the result replaces.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import others

AXES = ("source", "lang", "topic")
SWEEPS = 60
#: Most cells that targets may span.
MOST_CELLS = 20_000
RESULTS = ("topic", "n_tokens", "weight", "probability", "sampled")


def topic_of(text: Column) -> Column:
    """A topic from the text's own marks: tables, notices of rights, symbol noise, long prose, short prose."""
    text = F.coalesce(text, F.lit(""))
    return (
        F.when(F.instr(text, " | ") > 0, "table")
        .when((F.instr(text, "License") > 0) | (F.instr(text, "rights reserved") > 0), "notice")
        .when((F.instr(text, "###") > 0) | (F.instr(text, "$$$") > 0), "noise")
        .when(F.length(text) >= 2000, "long")
        .otherwise("short")
    )


def tokens_of(text: Column) -> Column:
    """Words parted by white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform_of(doc_id: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of the id's MD5."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def group_of(value: Column, named: Mapping[str, float]) -> Column:
    """Place of a value among the named ones, from 1; 0 for all others."""
    out = F.lit(0)
    for k, name in enumerate(named, 1):
        out = F.when(value == name, k).otherwise(out)
    return out


def shares_of(named: Mapping[str, float]) -> list[float]:
    """Target share of each group of an axis, that of the other values first."""
    if any(s < 0 for s in named.values()):
        raise ValueError("a target share is negative")
    return [max(0.0, round(1.0 - sum(named.values()), 12)) if named else 1.0, *map(float, named.values())]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _sums(fit: Column, groups: Column, n: int) -> Column:
    """Sum of ``fit`` in each of an axis' groups."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)), lambda g: _total(F.zip_with(fit, groups, lambda f, k: F.when(k == g, f).otherwise(0.0)))
    )


def _targets(own: Column, groups: Column, shares: list[float]) -> Column:
    """Shares of the groups that have tokens, scaled to a sum of 1; their own shares where no target has tokens."""
    return _let(
        _sums(own, groups, len(shares)),
        lambda now: _let(
            F.zip_with(now, F.array(*map(F.lit, shares)), lambda s, t: F.when(s > 0, t).otherwise(0.0)),
            lambda to: _let(_total(to), lambda all_: F.when(all_ > 0, F.transform(to, lambda t: t / all_)).otherwise(now)),
        ),
    )


def _scaled(fit: Column, groups: Column, to: Column, n: int) -> Column:
    """Cells scaled so that each group of an axis has its target share."""
    ratio = lambda t, s: F.when(s > 0, t / s).otherwise(0.0)
    return _let(
        F.zip_with(to, _sums(fit, groups, n), ratio), lambda scale: F.zip_with(fit, groups, lambda f, k: f * F.get(scale, k))
    )


def rake(cells: DataFrame, targets: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """Cells (a group number for each axis, tokens) -> the same with ``weight`` and ``peak``, the largest weight."""
    shares = {a: shares_of(targets.get(a) or {}) for a in AXES}
    spanned = 1
    for s in shares.values():
        spanned *= len(s)
    if spanned > MOST_CELLS:
        raise ValueError(f"the targets span {spanned} cells, more than {MOST_CELLS}")
    row = cells.agg(F.sort_array(F.collect_list(F.struct(*AXES, "tokens"))).alias("c"))
    row = row.select("c", *[F.col(f"c.{a}").alias(f"g_{a}") for a in AXES], F.col("c.tokens").cast("array<double>").alias("n"))
    row = row.select("*", _let(_total(F.col("n")), lambda s: F.transform("n", lambda x: F.when(s > 0, x / s).otherwise(0.0))).alias("own"))
    row = row.select("*", *[_targets(F.col("own"), F.col(f"g_{a}"), shares[a]).alias(f"to_{a}") for a in AXES])

    def over(axis: str) -> Callable[[Column], Column]:
        return lambda f: _scaled(f, F.col(f"g_{axis}"), F.col(f"to_{axis}"), len(shares[axis]))

    def sweep(fit: Column, _: Column) -> Column:
        first, second, third = map(over, AXES)
        return _let(first(fit), lambda f: _let(second(f), third))

    fit = F.aggregate(F.sequence(F.lit(1), F.lit(SWEEPS)), F.col("own"), sweep)
    # A target that no cell can meet leaves the sum below one.
    weight = _let(fit, lambda f: _let(_total(f), lambda s: F.zip_with(f, "own", lambda x, o: F.when(o > 0, x / s / o).otherwise(1.0))))
    # A generator of one row has the weights computed once.
    row = row.select("c", F.explode(F.array(weight)).alias("w")).select(F.arrays_zip("c", "w").alias("z"), F.array_max("w").alias("peak"))
    return row.select(F.explode("z").alias("z"), "peak").select("z.c.*", F.col("z.w").alias("weight"), "peak")


def mix_sources(docs: DataFrame, targets: Mapping[str, Mapping[str, float]], keep: float = 1.0) -> DataFrame:
    """Every row of ``docs`` with topic, n_tokens, weight, probability and the decision ``sampled``."""
    if not 0 < keep <= 1:
        raise ValueError("keep is a share in (0, 1]")
    value = {a: F.coalesce(F.col(a).cast("string"), F.lit("")) for a in ("source", "lang")}
    marked = docs.select(F.struct("*").alias("row"), topic_of(F.col("text")).alias("topic"), tokens_of(F.col("text")).alias("n_tokens"), *[c.alias(a) for a, c in value.items()])
    groups = {a: group_of(F.col(a), targets.get(a) or {}) for a in AXES}
    cells = marked.groupBy(*[g.alias(a) for a, g in groups.items()]).agg(F.sum("n_tokens").alias("tokens"))
    # At most MOST_CELLS rows.
    weights = F.broadcast(rake(cells, targets).select(*[F.col(a).alias(f"of_{a}") for a in AXES], "weight", "peak"))
    probability = F.when(F.col("peak") > 0, keep * F.col("weight") / F.col("peak")).otherwise(0.0)
    out = marked.join(weights, [groups[a] == F.col(f"of_{a}") for a in AXES])
    return out.select(
        *[F.col("row").getField(c).alias(c) for c in others(docs, RESULTS)],
        "topic",
        "n_tokens",
        "weight",
        probability.alias("probability"),
        (uniform_of(F.col("row.doc_id")) < probability).alias("sampled"),
    )
