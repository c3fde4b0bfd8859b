"""Mixing sources to target weights by iterative proportional fitting.

Documents are summed into cells of source, language and topic. Values without a target are pooled: their total is
raked, and single ones among them move with it. So the number of cells is at most the product of the target tables'
lengths plus one each, whatever the input; the raking itself is then a few hundred numbers. The weights go back by a
broadcast of those cells, and sampling is a hash of the key against each document's probability: no shuffle of texts.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soukspark.llm.common import WORD, free_name

#: The pooled value of a dimension: null, and every value without a target.
OTHER = "(other)"
#: Raking stops once no marginal is further off than so much of the whole, or after so many passes.
TOLERANCE, PASSES = 1e-12, 200


def tokens(text: str | Column) -> Column:
    """How many words a text has; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def topic(text: str | Column) -> Column:
    """A coarse topic by the first pattern that fits; null texts have none."""
    text = F.col(text) if isinstance(text, str) else text
    # a plain search decides most texts before the pattern is tried
    contact = F.when(text.contains("@"), text.rlike("[A-Za-z0-9.]@[A-Za-z0-9]")).otherwise(False)
    low = F.lower(text)
    legal = low.contains("license") | low.contains("licence")
    return F.when(text.isNull(), None).when(legal, "legal").when(contact, "contact").when(text.contains("|"), "table").otherwise("prose")


def aims(own: dict[str, float], share: dict[str, float]) -> dict[str, float]:
    """The total that each value of a dimension is to have, of their totals: named ones their share of the whole, the
    others what is left in proportion to their own. Where no other value is there, or nothing is left, the named ones
    share the whole in proportion to their shares; the others then get nothing only if the named take all."""
    whole = math.fsum(own.values())
    own = {v: n for v, n in own.items() if n > 0}
    named = {v: share[v] for v in own if v in share}
    rest, others = 1 - math.fsum(named.values()), math.fsum(n for v, n in own.items() if v not in share)
    if others > 0 and rest > 0:
        return {v: (named[v] if v in named else rest * n / others) * whole for v, n in own.items()}
    total = math.fsum(named.values())
    if total <= 0:
        return dict(own)
    return {v: named.get(v, 0.0) / total * whole for v in own}


def rake(cells: dict[tuple, float], targets: list[dict[str, float]], tolerance: float = TOLERANCE, passes: int = PASSES) -> tuple[dict[tuple, float], float]:
    """Weights of cells such that weighted sums meet each marginal, and how far the furthest one is off, as a share
    of the whole: above ``tolerance`` where the cells that exist do not allow the targets. Cells of no tokens have
    weight 1."""
    whole = math.fsum(cells.values())
    weight = dict.fromkeys(cells, 1.0)
    goals = []
    for k, share in enumerate(targets):
        own: dict[str, float] = {}
        for key, n in sorted(cells.items()):
            own[key[k]] = own.get(key[k], 0.0) + n
        goals.append(aims(own, share))

    def sums(k: int) -> dict[str, float]:
        now: dict[str, float] = dict.fromkeys(goals[k], 0.0)
        for key, n in sorted(cells.items()):
            if n > 0:
                now[key[k]] += n * weight[key]
        return now

    off = 0.0
    for _ in range(passes if whole > 0 else 0):
        for k, goal in enumerate(goals):
            now = sums(k)
            for key, n in cells.items():
                if n > 0:
                    weight[key] *= goal[key[k]] / now[key[k]] if now[key[k]] > 0 else 0.0
        off = max(abs(x - goal[v]) / whole for k, goal in enumerate(goals) for v, x in sums(k).items())
        if off <= tolerance:
            break
    return weight, off


def unit(key: str | Column, seed: int) -> Column:
    """A number in [0, 1) that key and seed decide: the first 32 bits of an MD5 sum."""
    key = F.col(key) if isinstance(key, str) else key
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(float(2**32))


def _cells(docs: DataFrame, dims: list[str], targets: list[dict[str, float]], size: str) -> tuple[list[Column], dict[tuple, float]]:
    names = [free_name(docs, f"cell{k}") for k in range(len(dims))]
    cell = [F.when(F.col(d).isin(list(t)), F.col(d)).otherwise(OTHER).alias(n) for d, t, n in zip(dims, targets, names, strict=True)]
    # at most (targets + 1) of each dimension multiplied: bounded by the parameters
    sums = docs.groupBy(*cell).agg(F.sum(F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("double")).alias("n")).collect()
    return cell, {tuple(r)[:-1]: r[-1] for r in sums}


def mix(
    docs: DataFrame, dims: list[str], targets: list[dict[str, float]], size: str, key: str = "doc_id", rate: float | None = None, seed: int = 0, repeats: bool = False, names: tuple[str, str, str] | None = None
) -> DataFrame:
    """``docs`` with ``mix_weight``, ``mix_expected`` and ``mix_copies`` (``names``; by default with underscores in front
    where a name is taken): the raked weight, how often the row is to be in the sample, and how often it is. Every row
    gives one row. ``docs`` is read twice.

    ``rate``: expected tokens of the sample as a share of all. With ``repeats`` rows are expected weight times rate times,
    so that any target is met by rows that come more than once. Without, a row comes once at most: the rate is lowered
    until the largest weight gets 1, so the sample is smaller but keeps the raked proportions. None: as large as that
    allows. Targets that the cells cannot meet raise a warning that names how far off they are.

    Null dimensions are pooled with values that have no target; a null or negative size counts as none; a document of
    no size has its cell's chance. Rows of one key and cell are sampled together. An empty table gives an empty table.
    """
    weight, expected, copies = names or tuple(free_name(docs, x) for x in ("mix_weight", "mix_expected", "mix_copies"))
    cell, cells = _cells(docs, dims, targets, size)
    weights, off = rake(cells, targets)
    if off > 1e-6:
        warnings.warn(f"a target is missed by {off:.2%} of all tokens: no cells allow it", stacklevel=2)
    top = max((w for k, w in weights.items() if cells[k] > 0), default=1.0)
    factor = rate if repeats and rate is not None else min(1 / top, rate if rate is not None else math.inf)
    own = [c for c in (free_name(docs, f"cell{k}") for k in range(len(dims)))]
    schema = ", ".join(f"`{n}` string" for n in own) + f", `{weight}` double, `{expected}` double"
    table = docs.sparkSession.createDataFrame([(*k, w, w * factor if repeats else min(1.0, w * factor)) for k, w in weights.items()], schema)
    marked = docs.select("*", *cell).join(F.broadcast(table), own, "left").drop(*own)
    whole = F.floor(expected)
    return marked.withColumn(copies, (whole + (unit(key, seed) < F.col(expected) - whole).cast("int")).cast("int"))


def report(docs: DataFrame, dims: list[str], targets: list[dict[str, float]], size: str) -> DataFrame:
    """``dim, value, own, target, reached``: of each value with a target and of the others together the share of tokens
    now, the share aimed at, and the share under the raked weights. A row for each target and dimension."""
    _, cells = _cells(docs, dims, targets, size)
    weights, _ = rake(cells, targets)
    whole = math.fsum(cells.values()) or 1.0
    rows = []
    for k, (dim, share) in enumerate(zip(dims, targets, strict=True)):
        own = {v: math.fsum(n for c, n in cells.items() if c[k] == v) for v in sorted({c[k] for c in cells})}
        goal = aims(own, share)
        for v in own:
            rows.append((dim, v, own[v] / whole, goal.get(v, 0.0) / whole, math.fsum(n * weights[c] for c, n in cells.items() if c[k] == v) / whole))
    return docs.sparkSession.createDataFrame(rows, "dim string, value string, own double, target double, reached double")
