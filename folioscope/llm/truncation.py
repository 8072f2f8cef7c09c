"""Texts cut off before their end, and how often each source cuts.

Method: for every source the lengths of its texts are fitted with a lognormal
distribution that is right-censored at the source's candidate limits, by
maximum likelihood.  A limit's excess over what the fit expects there gives the
posterior that a text of just that length was censored.  That posterior is
combined, as log-odds, with evidence from the ending:

* how a text of its kind ends: a full stop, a closing line that many texts
  share, a closed code block or link, a signature, a list item, a headline;
* whether its last word is a word at all, and one that ends sentences: the
  counts of every term, and of its final positions, cover all documents;
* open brackets or code blocks, a last line shorter than a list's other lines;
* a stated length above the real one.

How much each of these says is learnt from the collection itself, by
expectation and maximisation over two classes of texts, cut and whole: a text
at a limit belongs to the cut ones with the limit's censoring posterior, as far
as the endings of all texts of that length bear it out; any other with the rate
of cuts away from limits; and both by the evidence of its ending.  The
odds in ``KIND_ODDS`` and ``SIGN_ODDS`` are where this starts; they weigh as
much as ``PRIOR_TEXTS`` texts.

Closing lines, words and lengths are counted over distinct texts: copies of one
text under other ids (blanks set aside) are one piece of evidence, not many.

Lengths are counted in characters, in bytes of UTF-8, in characters after
wrongly decoded accents are put right, and without a trailing ellipsis, since a
limit may apply to any of these.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import one_row_per_id, ship_package, spread, stage
from .text import terms

#: Share of cut texts away from limits that is assumed at first.
PRIOR = 0.08
#: Texts that the odds at the start weigh as much as.
PRIOR_TEXTS = 100.0
#: Rounds of expectation and maximisation, or of a censored fit, at most; both settle long before.
ROUNDS = 20_000
#: A closing line is common from this share of all distinct texts on; so there are at most 1 / COMMON_LINE.
COMMON_LINE = 4e-4
#: A length is a candidate limit from this excess over its neighbourhood on.
EXCESS = 6.0
#: Bound of the probability that any length of a source becomes a candidate by chance.
BY_CHANCE = 0.01

MEASURES = ("chars", "bytes", "repaired", "bare_chars", "bare_bytes")

_STOP = re.compile(r"[.!?]['\"”»’)\]]*$")
_ELLIPSIS = re.compile(r"(?:\.\.\.|…)$")
_FINAL = re.compile(r"([^\W_]+)(?:[.!?](?=[\s\"'”»)]|$)|(?=\s*(?:\n\n|\n- ))|(?= \(#\d+\)))")
_LIST_FINAL = re.compile(r"([^\W_]+)(?=\n)")


def _repaired(text: str) -> int:
    if "Ã" not in text and "Â" not in text and "â" not in text:
        return len(text)
    for code in ("cp1252", "latin-1"):
        try:
            return len(text.encode(code).decode("utf-8"))
        except UnicodeError:
            continue
    return len(re.sub(r"[ÃÂ][\x80-™]", "x", text))


def _kind(body: str, lines: list[str]) -> str:
    last = lines[-1]
    if body.count("```") % 2:
        return "open-code"
    if last.strip() == "```":
        return "code"
    if _ELLIPSIS.search(body):
        return "ellipsis"
    if last.startswith("- ") and re.match(r"- [A-Z]\w+: ", last):
        return "item" if not re.search(r"\(#\d+\)$", last) else "closed"
    if _STOP.search(body):
        return "stop"
    before = [x for x in lines[-4:-1]]
    if any(x.rstrip() == "--" for x in before):
        return "signature"
    if not re.search(r"[.!?]", body) and len(lines) > 1 and not any(len(x) > 60 for x in lines):
        return "list"
    if len(lines) == 1 and body.upper() == body:
        return "headline"
    if len(lines) == 1 and not re.search(r"[.!?]", body):
        return "line"
    return "word" if body[-1].isalnum() else "other"


def ending(text: str) -> dict:
    """What the ending of a non-empty text shows."""
    body = text.rstrip()
    bare = _ELLIPSIS.sub("", body)
    lines = body.split("\n") if body else [""]
    last = lines[-1].strip()
    if not body[-1:].isalnum():
        last = re.split(r"(?<=[.!?])\s+", last)[-1]  # a closing remark may share the line
    kind = _kind(body, lines) if body else "blank"
    found = terms(lines[-1])
    word = found[-1] if found and body[-1].isalnum() else ""
    open_ = body.count("[[") > body.count("]]") or body.rfind("(") > body.rfind(")")
    short = False
    if kind == "list":
        sizes = [len(x.split()) for x in lines[:-1] if x.strip()]
        short = bool(sizes) and len(lines[-1].split()) < min(sizes)
    return {
        "chars": len(text),
        "bytes": len(text.encode("utf-8", "surrogatepass")),
        "repaired": _repaired(text),
        "bare_chars": len(bare) if bare != body else -1,
        "bare_bytes": len(bare.encode("utf-8", "surrogatepass")) if bare != body else -1,
        "kind": kind,
        "last": re.sub(r"(?<=:)[A-Z]\w*(?=\]\])", "*", last),
        "word": word,
        "open": open_,
        "short": short,
    }


_ENDS = (
    "doc_id bigint, source string, stated bigint, hash bigint, chars bigint, bytes bigint, repaired bigint, bare_chars bigint, "
    "bare_bytes bigint, kind string, last string, word string, open boolean, short boolean"
)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["chars", "bytes", "repaired", "bare_chars", "bare_bytes", "kind", "last", "word", "open", "short"]
    kinds = [pa.int64()] * 5 + [pa.string()] * 3 + [pa.bool_()] * 2
    for batch in batches:
        rows = [ending(t) for t in batch.column(4).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:4], *[pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)]],
            ["doc_id", "source", "stated", "hash", *names],
        )


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    final: Counter = Counter()

    def flush() -> pa.RecordBatch:
        keys = list(seen)
        out = pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), pa.array([seen[k] for k in keys], pa.int64()), pa.array([final[k] for k in keys], pa.int64())],
            ["word", "n", "n_final"],
        )
        seen.clear()
        final.clear()
        return out

    for batch in batches:
        for text in batch.column(0).to_pylist():
            seen.update(terms(text))
            pattern = _FINAL if re.search(r"[.!?]", text) else _LIST_FINAL
            final.update(w.lower() for w in pattern.findall(text))
        if len(seen) > 400_000:
            yield flush()
    if seen:
        yield flush()


def _phi(z: np.ndarray) -> np.ndarray:
    return np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)


def _tail(z: np.ndarray) -> np.ndarray:
    return 0.5 * np.vectorize(math.erfc)(np.asarray(z, float) / math.sqrt(2))


def fit_censored(values: np.ndarray, counts: np.ndarray, limits: np.ndarray, cut: np.ndarray) -> tuple[float, float]:
    """Lognormal by maximum likelihood: ``values`` seen ``counts`` times, ``cut`` more censored at ``limits``."""
    return censored_fit(values, counts, limits, cut)[:2]


def censored_fit(values: np.ndarray, counts: np.ndarray, limits: np.ndarray, cut: np.ndarray, rounds: int = ROUNDS) -> tuple[float, float, bool]:
    """The same, and whether the fit settled.

    Censored logs are replaced by their expectation beyond the limit, in turns
    with the fit, until neither parameter changes.
    """
    x, w = np.log(values), counts.astype(float)
    mu = float((x * w).sum() / w.sum())
    sigma = math.sqrt(max(float((w * (x - mu) ** 2).sum() / w.sum()), 1e-4))
    if not len(limits) or not cut.sum():
        return mu, sigma, True
    c = np.log(limits)
    sums, squares, total = float((x * w).sum()), float((x * x * w).sum()), float(w.sum() + cut.sum())
    for _ in range(rounds):
        z = (c - mu) / sigma
        hazard = _phi(z) / np.maximum(_tail(z), 1e-12)
        e1 = mu + sigma * hazard
        e2 = mu * mu + sigma * sigma + sigma * hazard * (c + mu)
        new = (sums + float((e1 * cut).sum())) / total
        wide = math.sqrt(max((squares + float((e2 * cut).sum())) / total - new * new, 1e-4))
        settled = abs(new - mu) < 1e-7 and abs(wide - sigma) < 1e-7
        mu, sigma = new, wide
        if settled:
            return mu, sigma, True
    return mu, sigma, False


def source_limits(lengths: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, float, float, float, bool]]:
    """Limits of one source: ``(limit, count, expected, mu, sigma, settled)``.

    A candidate has at least 4 texts, 4 in 1000 of the source's, and ``EXCESS``
    times what its neighbourhood (a tenth to either side) has on average, and
    would hardly occur by chance (Chernoff's bound of a Poisson count, times the
    number of lengths); the fit then says how many texts should have just that
    length.
    """
    order = np.argsort(lengths)
    v, n = lengths[order], counts[order].astype(float)
    keep = v > 0
    v, n = v[keep], n[keep]
    if not len(v):
        return []
    run = np.concatenate([[0.0], np.cumsum(n)])
    lo, hi = np.searchsorted(v, v * 0.9, "left"), np.searchsorted(v, v * 1.1, "right")
    width = np.maximum(v * 0.2, 1)
    around = (run[hi] - run[lo] - n) / width
    usual = np.maximum(around, 0.15)
    cand = (n >= max(4, 0.004 * n.sum())) & (n >= EXCESS * usual)
    # so many texts of one length must be unlikely by chance, for all lengths taken together
    chance = n * (1 + np.log(usual / n)) - usual + math.log(len(v))
    cand &= chance < math.log(BY_CHANCE)
    if not cand.any():
        return []
    excess = np.maximum(n - around, 0) * cand
    mu, sigma, settled = censored_fit(v, np.maximum(n - excess, 1e-9), v[cand], excess[cand])
    z = (np.log(v[cand]) - mu) / sigma
    expected = np.maximum(n.sum() * _phi(z) / (sigma * v[cand]), 0.05)
    return [(int(a), int(b), float(max(e, r)), mu, sigma, settled) for a, b, e, r in zip(v[cand], n[cand], expected, around[cand])]


def limits_of(ends: DataFrame) -> DataFrame:
    """``(source, measure, limit, texts, expected, posterior, mu, sigma, settled)`` for every source.

    Works on the histogram of lengths, one row per source, measure and length;
    a source's copies of a text count once.
    """
    measures = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("length")) for m in MEASURES])
    hist = (
        ends.select(F.coalesce("source", F.lit("")).alias("source"), "hash", *MEASURES).distinct().select("source", F.explode(measures).alias("m")).select("source", "m.*")
        .where("length > 0").groupBy("source", "measure", "length").agg(F.count(F.lit(1)).alias("n"))
    )

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [
            (pdf["source"].iloc[0], pdf["measure"].iloc[0], a, b, e, 1 - min(e / b, 1.0), mu, s, done)
            for a, b, e, mu, s, done in source_limits(pdf["length"].to_numpy(), pdf["n"].to_numpy())
        ]
        return pd.DataFrame(rows, columns=["source", "measure", "limit", "texts", "expected", "posterior", "mu", "sigma", "settled"])

    return hist.groupBy("source", "measure").applyInPandas(
        fit, "source string, measure string, limit bigint, texts bigint, expected double, posterior double, mu double, sigma double, settled boolean"
    )


#: Log-odds of a cut by how the text ends, from which the fit starts.
KIND_ODDS = {
    "stop": -4.3, "closed": -4.5, "code": -4.0, "open-code": 5.0, "ellipsis": 1.5, "item": 0.0, "list": -0.5,
    "headline": -2.0, "signature": -1.5, "line": -0.5, "word": 4.0, "other": 2.5, "blank": -3.0,
}
#: The same for what else an ending shows, and for a stated length above the real one.
SIGN_ODDS = {"common": -5.0, "prefix": 3.0, "open": 3.0, "short": 4.0, "stated": 1.5, "new": 3.5}
#: Endings that are whole by their form, whatever their last word.
CLOSED = {"stop", "closed", "code"}
#: Endings whose last word need not be one that ends sentences.
FREE_WORDS = {"headline", "signature"}
#: The last word's log-odds are told in whole numbers up to this.
WORD_STEPS = 4


def _signs(common: list[str], total: int, total_final: int):
    """What an ending shows, as two names: its form with its marks, and what its last word says."""
    known = set(common)

    def run(kind, last, word, open_, short, n, n_final):  # columns of a batch
        out = []
        for k, ln, w, o, s, a, b in zip(kind, last, word, open_, short, n, n_final):
            marks = ""
            if ln and ln in known and k not in ("open-code", "ellipsis"):
                marks = "common"
            else:
                i = bisect.bisect_left(common, ln) if ln else 0
                if ln and len(ln) > 2 and k not in CLOSED and i < len(common) and common[i] != ln and common[i].startswith(ln):
                    marks += " prefix"
                if o and k != "stop":
                    marks += " open"
                if s:
                    marks += " short"
            told = "none"
            if w and k not in CLOSED and k != "ellipsis" and marks != "common":
                a = max((0 if a is None or a != a else a) - 1, 0)
                b = 0 if b is None or b != b else b
                if a == 0:
                    told = "new"
                elif k not in FREE_WORDS:
                    odds = math.log(0.25 * (a + 0.5) / (total + 1)) - math.log((b + 0.05) / (total_final + 1))
                    told = str(round(max(-WORD_STEPS, min(WORD_STEPS, odds))))
            out.append((k, marks.strip(), told))
        return pd.DataFrame(out, columns=["kind", "marks", "told"]).astype(object)

    return run


_SIGNS = "struct<kind string, marks string, told string>"


def _start_odds(kind: str, marks: str, told: str) -> float:
    """The log-odds of an ending before anything is learnt."""
    if marks == "common":
        return SIGN_ODDS["common"]
    odds = KIND_ODDS[kind] + sum(SIGN_ODDS[m] for m in marks.split())
    if told == "new":
        return odds + SIGN_ODDS["new"]
    return odds + (0.0 if told == "none" else max(-1.0, float(told)) if kind == "word" else float(told))


def _at_start(odds, stated, s):
    """Probability of a cut by the odds at the start."""
    start = [_start_odds(k, m, t) for k, m, t in zip(s["kind"], s["marks"], s["told"])]
    return pd.Series(_sigmoid(odds.to_numpy(float) + np.array(start, float) + SIGN_ODDS["stated"] * (stated == "more").to_numpy(float)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


@dataclass
class Evidence:
    """Learnt log-odds: of forms of endings, of last words by kind, of stated lengths; and of a cut away from limits."""

    forms: dict[tuple[str, str], float]
    words: dict[tuple[str, str], float]
    stated: dict[str, float]
    rate: float
    settled: bool

    def of(self, kind: str, marks: str, told: str, stated: str) -> float:
        """What an ending and a stated length say together; ends that were not counted have the odds of the start."""
        form = self.forms.get((kind, marks))
        form = _start_odds(kind, marks, "none") if form is None else form
        return form + self.words.get((kind, told), 0.0) + self.stated.get(stated, 0.0)


def learn(rows: list, rounds: int = ROUNDS) -> Evidence:
    """Fit the two classes to counts of endings.

    ``rows`` hold ``kind, marks, told, stated, odds, n``: how many texts end so,
    with the log-odds of their limit's posterior (null away from limits).
    """
    if not rows:
        return Evidence({}, {}, {}, math.log(PRIOR / (1 - PRIOR)), True)
    n = np.array([r["n"] for r in rows], float)
    at = np.array([r["odds"] is not None for r in rows])
    base = np.array([r["odds"] if r["odds"] is not None else 0.0 for r in rows], float)
    names = [[(r["kind"], r["marks"]) for r in rows], [(r["kind"], r["told"]) for r in rows], [r["stated"] for r in rows]]
    codes, keys = [], []
    for column in names:
        known = sorted(set(column))
        index = {k: i for i, k in enumerate(known)}
        codes.append(np.array([index[k] for k in column]))
        keys.append(known)
    start = np.array([_start_odds(r["kind"], r["marks"], r["told"]) + (SIGN_ODDS["stated"] if r["stated"] == "more" else 0.0) for r in rows])
    cut = _sigmoid(np.where(at, base, math.log(PRIOR / (1 - PRIOR))) + start)
    # the last word is judged among endings of its kind
    kind = np.array([{k: i for i, k in enumerate(sorted({r["kind"] for r in rows}))}[r["kind"]] for r in rows])

    def counts(weight: np.ndarray) -> tuple[list[np.ndarray], list]:
        """Sums by name, and what each is a share of: all texts, or for words those of their kind."""
        out = [np.bincount(c, weight, len(k)) for c, k in zip(codes, keys)]
        own = np.zeros(len(keys[1]))
        own[codes[1]] = np.bincount(kind, weight)[kind]
        return out, [out[0].sum(), own, out[2].sum()]

    # a class without texts of its own has the shares of all texts, times the odds at the start where it is the cut one
    usual = [o / w for o, w in zip(*counts(n))]
    odds = [
        np.array([_start_odds(k, m, "none") for k, m in keys[0]]),
        np.array([_start_odds(k, "", t) - KIND_ODDS[k] for k, t in keys[1]]),
        np.array([SIGN_ODDS["stated"] if k == "more" else 0.0 for k in keys[2]]),
    ]
    prior = [np.minimum(u * np.exp(o), 1.0) for u, o in zip(usual, odds)]

    def smoothed(weight: np.ndarray, first: list[np.ndarray]) -> list[np.ndarray]:
        return [np.log((o + PRIOR_TEXTS * f) / (w + PRIOR_TEXTS)) for o, w, f in zip(*counts(weight), first)]

    rate, settled = math.log(PRIOR / (1 - PRIOR)), False
    for _ in range(rounds):
        told = [a - b for a, b in zip(smoothed(cut * n, prior), smoothed((1 - cut) * n, usual))]
        away = float((cut * n)[~at].sum() + PRIOR * PRIOR_TEXTS) / float(n[~at].sum() + PRIOR_TEXTS)
        rate = math.log(away / (1 - away))
        new = _sigmoid(np.where(at, base, rate) + sum(x[c] for x, c in zip(told, codes)))
        change = float((np.abs(new - cut) * n).sum() / n.sum())
        cut = new
        if change < 1e-8:
            settled = True
            break
    return Evidence(*[dict(zip(k, map(float, t))) for k, t in zip(keys, told)], rate, settled)


def detect(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Judge ``(doc_id, text, source, n_chars)``.

    Endings are counted by their signs (at most a few thousand kinds exist)
    to learn what each says; then every text is judged.  Returns ``judged (doc_id, source, kind, measure, limit, log_odds, cut)`` for
    every record with a text that is not empty, and the limits found (see
    :func:`limits_of`).  Null sources form a group of their own, reported as
    null; ``n_chars`` may be null.  Null and empty texts are not judged.
    """
    spark = documents.sparkSession
    ship_package(spark)
    own = one_row_per_id(
        spread(documents).select("doc_id", "source", F.col("n_chars").cast("long").alias("stated"), "text"), "doc_id"
    ).where("text is not null and text <> ''")
    own = own.withColumn("hash", F.xxhash64(F.translate("text", " \t\r\n\u00a0", "")))
    ends = stage(own.select("doc_id", "source", "stated", "hash", "text").mapInArrow(_ends, _ENDS), "ends")
    # texts move only if the list of repeated ones is long
    copied = stage(ends.groupBy("hash").agg(F.min("doc_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"), "copied-texts")
    distinct = own.select("doc_id", "hash", "text").join(copied, "hash", "left").where("_first is null or doc_id = _first")
    words = stage(
        distinct.select("text").mapInArrow(_words, "word string, n bigint, n_final bigint").groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_final").alias("n_final")),
        "words",
    )
    size = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_final"), F.lit(0)).alias("f")).first()
    texts = ends.select("hash").distinct().count()
    least = max(4, math.ceil(COMMON_LINE * texts))
    # lines are counted by their hash; at most 1 / COMMON_LINE of them are common
    closing = ends.where("length(last) > 2").withColumn("_l", F.xxhash64("last"))
    shared = closing.select("_l", "hash").distinct().groupBy("_l").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("_l")
    common = sorted(r["last"] for r in closing.join(F.broadcast(shared), "_l", "left_semi").groupBy("_l").agg(F.min("last").alias("last")).collect())
    limits = stage(limits_of(ends), "limits")

    at = ends.select("doc_id", F.coalesce("source", F.lit("")).alias("_s"), F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("limit")) for m in MEASURES])).alias("m")).select("doc_id", "_s", "m.*")
    hit = (
        at.join(limits.select(F.col("source").alias("_s"), "measure", "limit", "posterior"), ["_s", "measure", "limit"])
        .groupBy("doc_id").agg(F.max_by(F.struct("measure", "limit", "posterior"), "posterior").alias("h"))
    )
    # only the last words of texts that end in a word are looked up
    last = ends.where("word <> ''").select("doc_id", "word").join(words, "word").select("doc_id", "n", "n_final")
    seen = ends.join(hit, "doc_id", "left").join(last, "doc_id", "left")
    signs = F.pandas_udf(_signs(common, size["n"], size["f"]), _SIGNS)
    stated = F.when(F.col("stated").isNull(), "none").when(F.col("stated") > F.col("repaired") * 1.02 + 2, "more").otherwise("fits")
    post = F.when(F.col("h.posterior").isNotNull(), F.least(F.greatest(F.col("h.posterior"), F.lit(1e-3)), F.lit(1 - 1e-3)))
    marked = stage(
        seen.select(
            "doc_id", "source", "hash", F.col("h.measure").alias("measure"), F.col("h.limit").alias("limit"), F.log(post / (1 - post)).alias("posterior_odds"),
            stated.alias("stated"), signs("kind", "last", "word", "open", "short", "n", "n_final").alias("s"),
        ),
        "signs",
    )
    # a limit is as likely as the endings of the texts of its length make it: whole texts may have a usual length
    bound = marked.where("limit is not null").withColumn("_r", F.pandas_udf(_at_start, "double")("posterior_odds", "stated", "s"))
    of = [F.coalesce("source", F.lit("")).alias("_s"), F.col("measure").alias("_m"), F.col("limit").alias("_l")]
    told = bound.groupBy(*of, "hash").agg(F.max("_r").alias("r")).groupBy("_s", "_m", "_l").agg(F.avg("r").alias("r"))
    r = F.least(F.greatest(F.col("r"), F.lit(1e-3)), F.lit(1 - 1e-3))
    at_limit = bound.join(told, (F.coalesce("source", F.lit("")) == F.col("_s")) & (F.col("measure") == F.col("_m")) & (F.col("limit") == F.col("_l")))
    own_columns = ["doc_id", "source", "hash", "measure", "limit", "stated", "s"]
    marked = marked.where("limit is null").select(*own_columns, F.lit(None).cast("double").alias("odds")).unionByName(
        at_limit.select(*own_columns, F.log(r / (1 - r)).alias("odds"))
    )
    # copies of a text teach once; limits are told in steps of a quarter
    once = marked.groupBy("hash").agg(F.min(F.struct("doc_id", "s", "stated", F.round(F.col("odds") * 4).alias("q"))).alias("r")).select("r.*")
    counted = once.groupBy("s", "stated", "q").agg(F.count(F.lit(1)).alias("n")).collect()
    learnt = learn([{**r["s"].asDict(), "stated": r["stated"], "odds": None if r["q"] is None else r["q"] / 4, "n": r["n"]} for r in counted])
    if not learnt.settled:
        raise RuntimeError("the evidence of endings has not settled")

    # what an ending says is looked up: there are as many rows as ways to end
    told = [
        (s["kind"], s["marks"], s["told"], how, learnt.of(s["kind"], s["marks"], s["told"], how))
        for s, how in marked.select("s", "stated").distinct().collect()
    ]
    says = spark.createDataFrame(told, "kind string, marks string, told string, stated string, says double").select(
        F.struct("kind", "marks", "told").alias("s"), "stated", "says"
    )
    judged = marked.join(F.broadcast(says), ["s", "stated"]).withColumn("log_odds", F.coalesce("odds", F.lit(learnt.rate)) + F.col("says"))
    return (
        judged.select("doc_id", "source", F.col("s.kind").alias("kind"), "measure", "limit", "log_odds", (F.col("log_odds") > 0).alias("cut")),
        limits,
    )


def rates(judged: DataFrame) -> DataFrame:
    """How often each source cuts: ``source, texts, cut_texts, at_limit, rate``."""
    return judged.groupBy("source").agg(
        F.count(F.lit(1)).alias("texts"),
        F.sum(F.col("cut").cast("long")).alias("cut_texts"),
        F.sum((F.col("cut") & F.col("limit").isNotNull()).cast("long")).alias("at_limit"),
    ).withColumn("rate", F.round(F.col("cut_texts") / F.col("texts"), 6))
