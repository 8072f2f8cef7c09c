"""Mixing sources to target shares of the total size.

Method: iterative proportional fitting.  Token weights of the cells (source,
language, topic) are raked to the source shares of the mix and to the language
and topic shares that its pool has, in turns, until they settle; documents are
then sampled with the calibrated probabilities.

* The size of a mix is that of its pool (each document once) where every source
  can reach its target in it.  Where one cannot, because its documents may be
  used ``max_repeats`` times only, the mix is made smaller, to the largest size
  at which every source has its share, but not below ``LEAST_SIZE`` of the pool;
  there a source that still falls short is used as often as it may be, and the
  shares of the others are higher.  A source without documents gives its share
  to the others in proportion.  All of this is reported.
* A cell's weight w is the mean number of uses of its documents: each is used
  floor(w) times, and once more where its hash falls below a threshold.  The
  thresholds are set so that the chosen tokens, not just the expected ones,
  meet the cell's target: Spark sums tokens by cell and hash bin, and the bin in
  which the target is reached is cut once more; bins beyond it that still fit
  fill what a large document leaves open.

Nothing is collected: a mix is fitted in a group of its own cells, a cell is
cut in a group of at most ``BINS`` rows.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import one_row_per_id, ship_package, spread, stage
from .tokens import VOCABULARY, with_tokens

#: Bins of the hash, on each of two levels.
BINS = 1024
#: Rounds of raking at most, and the change of a share at which it has settled.
ROUNDS = 20_000
SETTLED = 1e-9
#: A mix is not made smaller than this share of its pool for the sake of scarce sources.
LEAST_SIZE = 0.1


def language(col: Column) -> Column:
    """The primary subtag in lower case; ``und`` where none is given."""
    names = {"english": "en", "french": "fr", "german": "de", "spanish": "es", "eng": "en", "fra": "fr", "fre": "fr", "deu": "de", "ger": "de", "spa": "es"}
    low = F.regexp_extract(F.lower(F.trim(col)), r"^([a-z]+)", 1)
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.when(col.isNull() | (low == ""), "und").otherwise(F.coalesce(F.get(F.array(table[low]), F.lit(0)), low))


def topic(text: Column) -> Column:
    """What a text is by its form: code, changes, issue, article, wire, post, queries or prose."""
    return (
        F.when(text.contains("```"), "code")
        .when(text.rlike(r"(?m)^- (?:Added|Changed|Fixed|Removed):"), "changes")
        .when(text.rlike(r"^Title: "), "issue")
        .when(text.rlike(r"^'''"), "article")
        .when(text.rlike(r"^\p{Lu}{3,}[\p{Lu} ]*, \d{1,2} \p{L}{3} - "), "wire")
        .when(text.rlike(r"(?m)^-- ?$|^[>|:] "), "post")
        .when(~text.rlike(r"[.!?]"), "queries")
        .otherwise("prose")
    )


def pool(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``(doc_id, source, lang, topic, tokens)``, one row per id, as a stage table.

    Documents without a source or without tokens can be in no mix.
    """
    own = one_row_per_id(spread(documents.select("doc_id", "text", "source", "lang")), "doc_id").where(
        "source is not null and text is not null and text <> ''"
    )
    marked = own.select("doc_id", "text", "source", language(F.col("lang")).alias("lang"), topic(F.col("text")).alias("topic"))
    return stage(with_tokens(marked, "text", ["doc_id", "source", "lang", "topic"], path), "pool")


def rake(cells: np.ndarray, groups: list[np.ndarray], targets: list[np.ndarray], rounds: int = ROUNDS) -> np.ndarray:
    """Scale ``cells`` so that their sums by each grouping meet its targets.

    The first grouping is the strict one: it is met last, hence exactly.
    A target on a group without tokens cannot be met and is left out.
    """
    return raked(cells, groups, targets, rounds)[0]


def raked(cells: np.ndarray, groups: list[np.ndarray], targets: list[np.ndarray], rounds: int = ROUNDS) -> tuple[np.ndarray, bool]:
    """The same, and whether the weights settled within the rounds."""
    x = cells.astype(float).copy()
    for _ in range(rounds):
        old = x.copy()
        for g, t in list(zip(groups, targets))[::-1]:
            have = np.bincount(g, x, len(t))
            x *= np.where(have > 0, t / np.where(have > 0, have, 1), 0)[g]
        if np.abs(x - old).max(initial=0.0) <= SETTLED * max(x.sum(), 1):
            return x, True
    return x, False


def _codes(values: Iterable) -> tuple[np.ndarray, list]:
    names = sorted(set(values))
    at = {v: i for i, v in enumerate(names)}
    return np.array([at[v] for v in values]), names


def mix_size(size: dict[str, float], targets: dict[str, tuple[float, int]]) -> tuple[float, dict[str, float]]:
    """The size of a mix and what each source should give to it."""
    pool_size = sum(size.values())
    held = sum(share for s, (share, _) in targets.items() if size[s] > 0)
    share = {s: t / held if held > 0 and size[s] > 0 else 0.0 for s, (t, _) in targets.items()}
    most = {s: repeats * size[s] for s, (_, repeats) in targets.items()}
    exact = min((most[s] / share[s] for s in targets if share[s] > 0), default=0.0)
    whole = min(pool_size, max(exact, LEAST_SIZE * pool_size))
    return whole, {s: min(share[s] * whole, most[s]) for s in targets}


def fit_mix(cells: list, targets: dict[str, tuple[float, int]]) -> tuple[list[dict], list[dict]]:
    """Weights of the cells and the report of the sources of one mix.

    ``cells`` are rows ``source, lang, topic, tokens`` of the mix's sources.
    A source is reachable when it can have its share of the pool, each
    document of the mix's sources once.
    """
    total = float(sum(c["tokens"] for c in cells))
    size = {s: 0.0 for s in targets}
    for c in cells:
        size[c["source"]] += c["tokens"]
    whole, goal = mix_size(size, targets)
    weights: list[dict] = []
    settled = True
    if cells:
        tokens = np.array([float(c["tokens"]) for c in cells])
        gs, sources = _codes([c["source"] for c in cells])
        gl, langs = _codes([c["lang"] for c in cells])
        gt, topics = _codes([c["topic"] for c in cells])
        t_source = np.array([goal[s] for s in sources])
        given = t_source.sum()
        t_lang = np.bincount(gl, tokens, len(langs)) * given / total
        t_topic = np.bincount(gt, tokens, len(topics)) * given / total
        cap = np.array([targets[s][1] for s in sources], float)[gs] * tokens
        x, settled = raked(tokens, [gs, gl, gt], [t_source, t_lang, t_topic])
        # no document more often than allowed: what a cell may not hold goes to the source's others
        for _ in range(len(cells) + 1):
            over = x > cap * (1 + 1e-12)
            if not over.any():
                break
            x = np.minimum(x, cap)
            free = x < cap * (1 - 1e-12)
            lack = t_source - np.bincount(gs, x, len(sources))
            room = np.bincount(gs, np.where(free, x, 0), len(sources))
            scale = 1 + np.where(room > 0, lack / np.where(room > 0, room, 1), 0)
            x = np.where(free, x * np.maximum(scale, 0)[gs], x)
        weights = [dict(source=c["source"], lang=c["lang"], topic=c["topic"], tokens=int(c["tokens"]), weight=float(min(x[i], cap[i]) / c["tokens"])) for i, c in enumerate(cells)]
    report = [
        dict(
            source=s, available=int(size[s]), target_share=share, target_tokens=share * total, goal_tokens=goal[s], mix_tokens=whole,
            max_repeats=repeats, reachable=not (repeats * size[s] < share * total), settled=settled,
        )
        for s, (share, repeats) in sorted(targets.items())
    ]
    return weights, report


_REPORT = (
    "mix_id string, source string, available bigint, target_share double, target_tokens double, goal_tokens double, mix_tokens double, "
    "max_repeats int, reachable boolean, settled boolean"
)
_PLAN = f"{_REPORT}, lang string, topic string, tokens bigint, weight double"
_KEYS = ["source", "lang", "topic"]
_CELL = ["mix_id", *_KEYS]


def _fit(rows: pd.DataFrame) -> pd.DataFrame:
    """The plan of one mix: its report (rows without a topic) and the weights of its cells."""
    mix_id = rows["mix_id"].iloc[0]
    targets: dict[str, tuple[float, int]] = {}
    for s, share, repeats in sorted(zip(rows["source"], rows["target_share"], rows["max_repeats"])):
        targets[s] = (float(share), int(repeats))
    cells = rows[rows["topic"].notna()].drop_duplicates(_KEYS).sort_values(_KEYS).to_dict("records")
    weights, report = fit_mix(cells, targets)
    names = [c.split()[0] for c in _PLAN.split(", ")]
    told = [{"mix_id": mix_id, "max_repeats": targets[w["source"]][1], **w} for w in weights] + [{"mix_id": mix_id, **r} for r in report]
    out = pd.DataFrame(told, columns=names)
    for c in ("available", "tokens"):
        out[c] = out[c].fillna(0).astype("int64")
    return out.astype({c: object for c in _CELL})


def mix(docs: DataFrame, mix_target: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Choose documents for every mix.

    ``docs`` is what :func:`pool` returns, ``mix_target`` is ``(mix_id, source,
    target_share, max_repeats)``; repeated targets count once, those with nulls
    not at all.  Returns ``chosen (mix_id, doc_id, source, tokens, uses)`` with
    uses > 0, and ``report (mix_id, source, available, target_share,
    target_tokens, goal_tokens, mix_tokens, max_repeats, reachable, settled)``:
    what a source should have of the pool's size, what of the mix's, and
    whether the raked weights settled.
    """
    ship_package(docs.sparkSession)
    cells = docs.groupBy(*_KEYS).agg(F.sum("tokens").alias("tokens"))
    asked = (
        mix_target.where("mix_id is not null and source is not null and target_share is not null and max_repeats is not null")
        .groupBy("mix_id", "source").agg(F.max(F.struct("target_share", "max_repeats")).alias("t"))
        .select("mix_id", "source", F.col("t.target_share").cast("double").alias("target_share"), F.col("t.max_repeats").cast("int").alias("max_repeats"))
    )
    plan = stage(asked.join(cells, "source", "left").groupBy("mix_id").applyInPandas(_fit, _PLAN), "mix-plan")
    report = plan.where("topic is null").select(*[c.split()[0] for c in _REPORT.split(", ")])
    wanted = plan.where("topic is not null").select(
        *_CELL, F.floor("weight").cast("int").alias("whole"),
        ((F.col("weight") - F.floor("weight")) * F.col("tokens")).alias("rest"), F.col("max_repeats").alias("repeats"),
    )
    # bins are drawn anew for each mix, by a hash of mix and document
    drawn = (
        docs.join(wanted, _KEYS)
        .withColumn("_h", F.pmod(F.xxhash64("mix_id", "doc_id"), F.lit(BINS * BINS)))
        .withColumns({"bin": F.floor(F.col("_h") / BINS).cast("int"), "low": F.pmod("_h", F.lit(BINS)).cast("int")})
    )
    by_bin = stage(drawn.groupBy(*_CELL, "rest", "bin").agg(F.sum("tokens").alias("t")), "mix-bins")
    cut, fine = _levels(drawn, by_bin)
    # what small cells could not reach, their documents being whole, the source's largest cell takes over
    left = cut.join(fine.select(*_CELL, F.col("gap").alias("_fine")), _CELL, "left")
    missed = left.groupBy("mix_id", "source").agg(
        F.sum(F.coalesce("_fine", "gap")).alias("extra"), F.max(F.struct("rest", *_KEYS)).alias("at")
    ).select("mix_id", *[F.col(f"at.{k}").alias(k) for k in _KEYS], "extra")
    more = by_bin.join(missed, _CELL, "left").withColumn("rest", F.greatest(F.col("rest") + F.coalesce("extra", F.lit(0.0)), F.lit(0.0))).drop("extra")
    cut, fine = _levels(drawn, more)
    edges = cut.select(*_CELL, F.col("at").alias("cut_bin"), F.col("more").alias("more_bins")).join(
        fine.select(*_CELL, F.col("at").alias("cut_low"), F.col("more").alias("more_lows")), _CELL, "left"
    )
    early, edge_bin = F.col("bin") < F.col("cut_bin"), F.col("bin") == F.col("cut_bin")
    low = (F.col("low") < F.coalesce("cut_low", F.lit(0))) | F.coalesce(F.array_contains("more_lows", F.col("low")), F.lit(False))
    taken = early | F.array_contains("more_bins", F.col("bin")) | (edge_bin & low)
    chosen = drawn.join(edges, _CELL).withColumn("uses", F.least(F.col("whole") + taken.cast("int"), F.col("repeats"))).where("uses > 0")
    return chosen.select("mix_id", "doc_id", "source", "tokens", "uses"), report


_CUTS = "mix_id string, source string, lang string, topic string, at int, rest double, gap double, more array<int>"


def _levels(drawn: DataFrame, by_bin: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where each cell is cut, on the first level of bins and inside the bin of the cut."""
    cut = stage(by_bin.groupBy(*_CELL).applyInPandas(lambda x: _cuts(x, False), _CUTS), "mix-cuts")
    edge = drawn.join(cut.select(*_CELL, "at", "gap"), _CELL).where(F.col("bin") == F.col("at"))
    by_low = edge.groupBy(*_CELL, F.col("gap").alias("rest"), F.col("low").alias("bin")).agg(F.sum("tokens").alias("t"))
    return cut, stage(by_low.groupBy(*_CELL).applyInPandas(lambda x: _cuts(x, True), _CUTS), "mix-cuts")


@dataclass
class _Cut:
    """Bins before ``at`` and those in ``more`` are taken; ``gap`` tokens of ``rest`` are left."""

    at: int
    rest: float
    gap: float
    more: list[int]


def _cut(bins: list[tuple[int, float]], rest: float, last: bool = False) -> _Cut:
    """The bin a cell's target falls into, and bins beyond it that still fit.

    On the last level that bin is taken too where this comes nearer to the target.
    """
    left, at, more = rest, None, []
    for b, t in sorted(bins):
        if t <= left + 1e-9:
            left -= t
            if at is not None:
                more.append(b)
        elif at is None:
            nearer = last and t - left < left
            at = b + 1 if nearer else b
            left -= t if nearer else 0.0
    return _Cut(BINS if at is None else at, rest, left, more)


def _cuts(rows: pd.DataFrame, last: bool) -> pd.DataFrame:
    c = _cut([(int(b), float(t)) for b, t in zip(rows["bin"], rows["t"])], float(rows["rest"].iloc[0]), last)
    return pd.DataFrame([(*[rows[k].iloc[0] for k in _CELL], c.at, c.rest, c.gap, c.more)], columns=[*_CELL, "at", "rest", "gap", "more"]).astype({k: object for k in _CELL})


def shares(chosen: DataFrame, report: DataFrame) -> DataFrame:
    """The report with the tokens chosen, and the shares they make of the mix and of its pool's size."""
    got = chosen.groupBy("mix_id", "source").agg(
        F.sum(F.col("tokens") * F.col("uses")).alias("chosen_tokens"), F.max("uses").alias("most_uses")
    )
    whole = got.groupBy("mix_id").agg(F.sum("chosen_tokens").alias("_all"))
    return (
        report.join(got, ["mix_id", "source"], "left").join(whole, "mix_id", "left")
        .select(
            "mix_id", "source", "available", "target_share", "target_tokens", "goal_tokens", "max_repeats", "reachable", "settled",
            F.coalesce("chosen_tokens", F.lit(0)).alias("chosen_tokens"),
            F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
            F.coalesce(F.try_divide("chosen_tokens", "_all"), F.lit(0.0)).alias("share"),
            (F.coalesce(F.try_divide(F.coalesce("chosen_tokens", F.lit(0)), F.col("target_tokens")), F.lit(0.0)) * F.col("target_share")).alias("pool_share"),
        )
    )
