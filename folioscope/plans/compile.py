"""From queries to DataFrames of ``(doc_id, score)``."""

from __future__ import annotations

import dataclasses
import re
import threading
import time
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, similarity, vectors
from ..index.build import Index
from ..operators import positional
from ..operators.batch import best_of_parts
from ..operators.vector_index import Clusters
from ..query import nodes as q
from ..query.rewrite import rewrite
from ..runtime import ship_package, stage


def _ranks(query: q.Query) -> bool:
    """Whether a query needs all documents to rank some of them."""
    if isinstance(query, q.RrfQ | q.VectorQ | q.LikeQ | q.CombinedQ | q.ParentQ):
        return True
    inner = [getattr(query, n, ()) for n in ("must", "should", "must_not", "parts", "clauses")]
    single = [getattr(query, n) for n in ("inner", "include", "exclude") if hasattr(query, n)]
    return any(_ranks(x) for x in [*[y for part in inner for y in part], *single])


class Searcher:
    """Runs queries against an index.

    Every query is one lazy plan.  Scores come from ``model``; ties are broken
    by the smaller ``doc_id``.
    """

    def __init__(self, index: Index, model: similarity.Similarity | None = None, vectors: dict[str, Clusters] | None = None):
        self.index = index
        self.model = model or similarity.bm25()
        self.vectors = vectors or {}

    # -- front door

    def hits(self, query: q.Query) -> DataFrame:
        """All matches, each document once."""
        return self._run(rewrite(query))

    def search(self, query: q.Query, n: int = 10) -> DataFrame:
        """The n best matches."""
        return self.hits(query).orderBy(F.col("score").desc(), "doc_id").limit(n)

    def count(self, query: q.Query) -> int:
        """How many documents match; of a term without deletions its document frequency says so."""
        query = rewrite(query)
        if isinstance(query, q.TermQ):
            own = self.index.term_stats.where((F.col("field") == query.field) & (F.col("term") == query.term))
            return own.agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n")).first()["n"]
        return self.hits(query).count()

    def search_within(self, query: q.Query, n: int, seconds: float, slices: int = 8) -> tuple[DataFrame, bool]:
        """The n best matches found in so many seconds, and whether they are of a part of the documents only.

        The documents are searched in slices by the hash of their ids, with the
        statistics of all, so what is found has its true score.  A slice that is
        under way when the time ends is cancelled and counts for nothing.
        Queries that rank inside (fusion, nearest vectors) take one slice.
        """
        slices = 1 if _ranks(query) else slices
        spark, ends = self.index.spark, time.monotonic() + seconds
        found: list = []
        done = 0
        for i in range(slices):
            left = ends - time.monotonic()
            if left <= 0:
                break
            mine = F.pmod(F.xxhash64("doc_id"), F.lit(slices)) == i
            part = dataclasses.replace(self.index, docs=self.index.docs.where(mine), postings=self.index.postings.where(mine))
            part.corpus = self.index.corpus
            group = f"search-{uuid.uuid4().hex}"
            spark.sparkContext.setJobGroup(group, "search", interruptOnCancel=True)
            timer = threading.Timer(left, spark.sparkContext.cancelJobGroup, [group])
            timer.start()
            try:
                # n rows at most
                found += [(r["doc_id"], float(r["score"])) for r in Searcher(part, self.model, self.vectors).search(query, n).collect()]
                done += 1
            except Exception:
                if timer.is_alive():
                    raise
                break
            finally:
                timer.cancel()
                spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        rows = spark.createDataFrame(found, "doc_id long, score double").orderBy(F.col("score").desc(), "doc_id").limit(n)
        return rows, done < slices

    def search_text(self, text: str, field: str, n: int = 10) -> DataFrame:
        """The n best matches of a query in the query language; terms without a field are of ``field``."""
        from ..query.parser import Parser

        analysers = {name: f.analyser for name, f in self.index.fields.items() if f.kind == "text"}
        return self.search(Parser(field, analysers=analysers).parse(text), n)

    def search_many(self, queries: DataFrame, field: str, n: int = 10) -> DataFrame:
        """``(query_id, doc_id, score)``: n best matches of many bags of terms at once.

        ``queries`` is ``(query_id, term)``.  Postings are restricted to the asked
        terms before anything else; one pass over them serves all queries, and
        queries of the same terms are answered once.  Documents are searched in
        parts, each of which gives its n best: what is shuffled is the asked
        postings and the parts' best, never the pairs of queries and documents.
        """
        ship_package(self.index.spark)
        asked = stage(queries.where("query_id is not null and term is not null").select("query_id", "term").distinct(), "asked-terms")
        own = self.index.term_stats.where(F.col("field") == field).join(asked.select("term").distinct(), "term", "left_semi")
        # a table of known size: the planner sends it to the postings where it is small
        stats = stage(own.select("field", "term", "df", "cf", F.monotonically_increasing_id().alias("term_id")), "asked-stats")
        scored = self._scored_by(field, stats).select("term_id", "doc_id", F.col("score").cast("double").alias("score"))
        # by term, so that a bag's scores are added up in one order wherever it is asked
        known = asked.join(stats.select("term", "term_id"), "term").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("term", "term_id"))).alias("_t"))
        members = stage(known.select("query_id", F.col("_t.term_id").alias("bag")), "asked-bags")
        bags = stage(members.select("bag").distinct().select(F.monotonically_increasing_id().alias("bag_id"), "bag"), "bags")
        n_postings = stats.agg(F.sum("df").alias("n")).first()["n"] or 0
        found = best_of_parts(scored, bags, n, n_postings, bags.count())
        best = Window.partitionBy("bag_id").orderBy(F.col("score").desc(), "doc_id")
        hits = found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= n).select("bag_id", "doc_id", "score")
        return members.join(bags, "bag").select("query_id", "bag_id").join(hits, "bag_id").select("query_id", "doc_id", "score")

    # -- scoring

    def _with_stats(self, where: Column, many: bool = False) -> DataFrame:
        """Postings with statistics; those of listed terms are few and broadcast."""
        own = self.index.postings.where(where)
        stats = self.index.term_stats.where(where)
        stats = stats if many else F.broadcast(stats)
        return self._with_corpus(own.join(stats, ["field", "term"]))

    def _with_corpus(self, rows: DataFrame) -> DataFrame:
        """Add the statistics of the field, as constants."""
        known = self.index.corpus
        pick = lambda i: reduce(
            lambda acc, f: F.when(F.col("field") == f, F.lit(known[f][i])).otherwise(acc), known, F.lit(None)
        )
        return rows.withColumns({"n_docs": pick(0).cast("long"), "sum_dl": pick(1).cast("long"), "avgdl": pick(2).cast("double")})

    def _scored(self, where: Column, many: bool = False) -> DataFrame:
        score = self.model(similarity.Term.columns()) * F.col("boost")
        return self._with_stats(where, many).select("field", "term", "doc_id", "positions", score.alias("score"))

    def _scored_by(self, field: str | Column, stats: DataFrame) -> DataFrame:
        """Scored postings of the terms that come with their statistics (``field, term, df, cf`` and more)."""
        where = F.col("field") == field if isinstance(field, str) else field
        rows = self._with_corpus(self.index.postings.where(where).join(stats, ["field", "term"]))
        more = [c for c in stats.columns if c not in ("field", "term", "df", "cf")]
        score = self.model(similarity.Term.columns()) * F.col("boost")
        return rows.select("field", "term", "doc_id", score.alias("score"), *more)

    def _is(self, field: str, terms) -> Column:
        return (F.col("field") == field) & F.col("term").isin(sorted(set(terms)))

    @staticmethod
    def _flat(rows: DataFrame, boost: float) -> DataFrame:
        return rows.select("doc_id", F.lit(float(boost)).alias("score"))

    def _docs(self, where: Column) -> DataFrame:
        docs = self.index.docs
        if "deleted_at" in docs.columns:
            docs = docs.where("deleted_at is null")
        return docs.where(where)

    # -- dispatch

    def _run(self, query: q.Query) -> DataFrame:
        return getattr(self, "_" + type(query).__name__.lower())(query)

    def _termq(self, x: q.TermQ) -> DataFrame:
        return self._scored(self._is(x.field, [x.term])).select("doc_id", (F.col("score") * x.boost).alias("score"))

    def _termsq(self, x: q.TermsQ) -> DataFrame:
        return self._flat(self.index.postings.where(self._is(x.field, x.terms)).select("doc_id").distinct(), x.boost)

    def _expanded(self, field: str, which: Column, boost: float) -> DataFrame:
        rows = self._scored((F.col("field") == field) & which, many=True)
        return rows.groupBy("doc_id").agg((F.sum("score") * boost).alias("score"))

    def _termrangeq(self, x: q.TermRangeQ) -> DataFrame:
        term, where = F.col("term"), F.lit(True)
        if x.low is not None:
            where &= (term >= x.low) if x.with_low else (term > x.low)
        if x.high is not None:
            where &= (term <= x.high) if x.with_high else (term < x.high)
        return self._expanded(x.field, where, x.boost)

    def _prefixq(self, x: q.PrefixQ) -> DataFrame:
        return self._expanded(x.field, F.col("term").startswith(x.prefix), x.boost)

    def _wildcardq(self, x: q.WildcardQ) -> DataFrame:
        literal = re.match(r"[^*?]*", x.pattern).group()
        regex = "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in x.pattern) + "$"
        where = F.col("term").rlike(regex)
        return self._expanded(x.field, F.col("term").startswith(literal) & where if literal else where, x.boost)

    def _regexpq(self, x: q.RegexpQ) -> DataFrame:
        return self._expanded(x.field, F.col("term").rlike(x.pattern), x.boost)

    def _fuzzyq(self, x: q.FuzzyQ) -> DataFrame:
        n = len(x.term)
        near = self.index.term_stats.where(
            (F.col("field") == x.field) & F.length("term").between(n - x.edits, n + x.edits)
        ).withColumn("_d", F.levenshtein("term", F.lit(x.term), x.edits))
        # at most x.most terms
        terms = near.where("_d >= 0").orderBy("_d", F.col("df").desc(), "term").limit(x.most).select("field", "term", "df", "cf", "_d")
        rows = self._scored_by(x.field, F.broadcast(terms))
        return rows.groupBy("doc_id").agg((F.sum(F.col("score") * (1 - F.col("_d") / (x.edits + 1))) * x.boost).alias("score"))

    def _any(self, column: str, test) -> Column:
        """A test of a column, or of any value of an array column."""
        if self.index.docs.schema[column].dataType.typeName() == "array":
            return F.exists(column, test)
        return test(F.col(column))

    def _rangeq(self, x: q.RangeQ) -> DataFrame:
        def inside(c: Column) -> Column:
            out = c.isNotNull()
            if x.low is not None:
                out &= c >= F.lit(x.low)
            if x.high is not None:
                out &= c <= F.lit(x.high)
            return out

        return self._flat(self._docs(self._any(x.column, inside)), x.boost)

    def _pointsq(self, x: q.PointsQ) -> DataFrame:
        return self._flat(self._docs(self._any(x.column, lambda c: c.isin(list(x.values)))), x.boost)

    def _existsq(self, x: q.ExistsQ) -> DataFrame:
        spec = self.index.fields.get(x.column)
        if spec is not None and spec.kind == "text":
            rows = self.index.postings.where(F.col("field") == x.column).select("doc_id").distinct()
            return self._flat(rows, x.boost)
        return self._flat(self._docs(F.col(x.column).isNotNull()), x.boost)

    def _allq(self, x: q.AllQ) -> DataFrame:
        return self._flat(self._docs(F.lit(True)), x.boost)

    def _noneq(self, x: q.NoneQ) -> DataFrame:
        return self._flat(self.index.docs.where("false"), x.boost)

    def _boxq(self, x: q.BoxQ) -> DataFrame:
        lat, lon = F.col(f"{x.field}_lat"), F.col(f"{x.field}_lon")
        return self._flat(self._docs(lat.between(x.south, x.north) & lon.between(x.west, x.east)), x.boost)

    def _nearq(self, x: q.NearQ) -> DataFrame:
        import math

        lat, lon = F.col(f"{x.field}_lat"), F.col(f"{x.field}_lon")
        dy = x.metres / geo.METRES_PER_DEGREE
        # the widest parallel of the circle bounds its longitudes
        top = min(abs(x.lat) + dy, 90.0)
        narrow = math.cos(math.radians(top))
        box = lat.between(x.lat - dy, x.lat + dy)
        if narrow > 1e-9 and dy / narrow < 180:
            dx = dy / narrow
            west, east = x.lon - dx, x.lon + dx
            box &= lon.between(west, east) | lon.between(west + 360, east + 360) | lon.between(west - 360, east - 360)
        return self._flat(self._docs(box & (geo.haversine(lat, lon, F.lit(x.lat), F.lit(x.lon)) <= x.metres)), x.boost)

    # -- positions

    def _slots(self, field: str, terms: list[str]) -> DataFrame:
        """One row per document that has all terms: positions and scoring columns by slot."""
        distinct = sorted(set(terms))
        rows = self._with_stats(self._is(field, distinct))
        parts = []
        for i, t in enumerate(distinct):
            mine = F.col("term") == t
            parts.append(F.first(F.when(mine, F.struct("positions", "tf", "dl", "df", "cf", "n_docs", "avgdl", "sum_dl", "boost")), True).alias(f"t{i}"))
        wide = rows.groupBy("doc_id").agg(*parts)
        return wide.where(reduce(lambda a, b: a & b, [F.col(f"t{i}").isNotNull() for i in range(len(distinct))]))

    def _phrase_score(self, terms: list[str], boost: float) -> Column:
        """Each term's score with the frequency of the rarest one."""
        distinct = sorted(set(terms))
        at = [f"t{distinct.index(t)}" for t in terms]
        rarest = F.array_min(F.array(*[F.struct(F.col(f"{a}.df"), F.col(f"{a}.tf")) for a in dict.fromkeys(at)]))["tf"].cast("double")
        parts = []
        for a in at:
            col = lambda n, a=a: F.col(f"{a}.{n}").cast("double")
            t = similarity.Term(rarest, col("dl"), col("df"), col("cf"), col("n_docs"), col("avgdl"), col("sum_dl"))
            parts.append(self.model(t))
        return reduce(lambda a, b: a + b, parts) * F.col(f"{at[0]}.boost") * boost

    def _phraseq(self, x: q.PhraseQ) -> DataFrame:
        if len(x.terms) == 1:
            return self._termq(q.TermQ(x.field, x.terms[0], boost=x.boost))
        distinct = sorted(set(x.terms))
        slots = [F.col(f"t{distinct.index(t)}.positions") for t in x.terms]
        rows = self._slots(x.field, list(x.terms)).where(positional.chain(slots, x.slop))
        return rows.select("doc_id", self._phrase_score(list(x.terms), x.boost).alias("score"))

    def _multiphraseq(self, x: q.MultiPhraseQ) -> DataFrame:
        places = list(x.places or range(len(x.groups)))
        terms = sorted({t for g in x.groups for t in g})
        rows = self.index.postings.where(self._is(x.field, terms))
        slots = [
            F.array_sort(F.flatten(F.collect_list(F.when(F.col("term").isin(list(g)), F.col("positions"))))).alias(f"s{i}")
            for i, g in enumerate(x.groups)
        ]
        wide = rows.groupBy("doc_id").agg(*slots)
        return self._flat(wide.where(positional.loose_chain([F.col(f"s{i}") for i in range(len(x.groups))], places, x.slop)), x.boost)

    def _intervalsq(self, x: q.IntervalsQ) -> DataFrame:
        return self._flat(self._matching(x.field, x.source), x.boost)

    def _matching(self, field: str, source: q.Source) -> DataFrame:
        rows = self.index.postings.where(self._is(field, positional.terms_of(source)))
        per_doc = rows.groupBy("doc_id").agg(F.collect_list(F.struct("term", "positions")).alias("places"))
        return per_doc.mapInArrow(positional.matching(source), "doc_id bigint")

    def _spantermq(self, x: q.SpanTermQ) -> DataFrame:
        return self._termq(q.TermQ(x.field, x.term, boost=x.boost))

    def _spannearq(self, x: q.SpanNearQ) -> DataFrame:
        if all(isinstance(c, q.SpanTermQ | q.TermQ) for c in x.clauses):
            terms = [c.term for c in x.clauses]
            distinct = sorted(set(terms))
            slots = [F.col(f"t{distinct.index(t)}.positions") for t in terms]
            rows = self._slots(positional.span_field(x), terms).where(positional.near(slots, x.slop, x.in_order))
            return rows.select("doc_id", self._phrase_score(terms, x.boost).alias("score"))
        return self._flat(self._matching(positional.span_field(x), positional.span_source(x)), x.boost)

    def _spanorq(self, x: q.SpanOrQ) -> DataFrame:
        """The score of the first clause that matches."""
        parts = [self._run(c).withColumn("_i", F.lit(i)) for i, c in enumerate(x.clauses)]
        rows = reduce(DataFrame.unionByName, parts)
        return rows.groupBy("doc_id").agg((F.min_by("score", "_i") * x.boost).alias("score"))

    def _spannotq(self, x: q.SpanNotQ) -> DataFrame:
        kept = self._run(x.include).join(self._run(x.exclude).select("doc_id"), "doc_id", "left_anti")
        return kept.select("doc_id", (F.col("score") * x.boost).alias("score"))

    # -- combinations

    def _bool(self, x: q.Bool) -> DataFrame:
        """One aggregation over all clauses' hits decides and sums."""
        if not x.must and not x.should:
            if not x.must_not or x.strict:
                return self._noneq(q.NoneQ())
            x = q.Bool(must=(q.AllQ(boost=0.0),), must_not=x.must_not, boost=x.boost)
        least = max(x.least_should, 0 if x.must else 1)
        parts = []
        for kind, clauses in (("must", x.must), ("should", x.should), ("not", x.must_not)):
            parts += [self._run(c).select("doc_id", F.col("score").cast("double").alias("score"), F.lit(kind).alias("_k")) for c in clauses]
        rows = self._terms_at_once(x) if self._only_terms(x) else reduce(DataFrame.unionByName, parts)
        counted = lambda k: F.count(F.when(F.col("_k") == k, 1))
        agg = rows.groupBy("doc_id").agg(
            F.sum(F.when(F.col("_k") != "not", F.col("score"))).alias("score"),
            counted("must").alias("_m"), counted("should").alias("_s"), counted("not").alias("_n"),
        )
        kept = agg.where((F.col("_m") == len(x.must)) & (F.col("_n") == 0) & ((F.col("_s") >= least) if least else F.lit(True)))
        return kept.select("doc_id", (F.col("score") * x.boost).alias("score"))

    @staticmethod
    def _only_terms(x: q.Bool) -> bool:
        clauses = (*x.must, *x.should, *x.must_not)
        terms = [(c.field, c.term) for c in clauses if isinstance(c, q.TermQ)]
        return len(terms) == len(clauses) and len(set(terms)) == len(terms)

    def _terms_at_once(self, x: q.Bool) -> DataFrame:
        """All clauses of single terms from one pass over the postings."""
        kinds, boosts = F.lit(None), F.lit(1.0)
        where = F.lit(False)
        for kind, clauses in (("must", x.must), ("should", x.should), ("not", x.must_not)):
            for c in clauses:
                mine = (F.col("field") == c.field) & (F.col("term") == c.term)
                kinds = F.when(mine, kind).otherwise(kinds)
                boosts = F.when(mine, float(c.boost)).otherwise(boosts)
                where |= mine
        return self._scored(where).select("doc_id", (F.col("score") * boosts).alias("score"), kinds.alias("_k"))

    def _constantq(self, x: q.ConstantQ) -> DataFrame:
        return self._flat(self._run(x.inner), x.score * x.boost)

    def _dismaxq(self, x: q.DisMaxQ) -> DataFrame:
        rows = reduce(DataFrame.unionByName, [self._run(p).select("doc_id", F.col("score").cast("double").alias("score")) for p in x.parts])
        best = F.max("score")
        return rows.groupBy("doc_id").agg(((best + x.tie * (F.sum("score") - best)) * x.boost).alias("score"))

    def _functionq(self, x: q.FunctionQ) -> DataFrame:
        value = self.index.docs.select("doc_id", F.col(x.column).cast("double").alias("_v"))
        rows = self._run(x.inner).join(value, "doc_id", "left")
        s, v = F.col("score"), F.col("_v")
        made = {"multiply": s * v, "replace": v, "sum": s + v, "max": F.greatest(s, v)}[x.mode]
        return rows.select("doc_id", (F.when(v.isNull(), s).otherwise(made) * x.boost).alias("score"))

    def _combinedq(self, x: q.CombinedQ) -> DataFrame:
        weights = dict(zip(x.fields, x.weights or [1.0] * len(x.fields)))
        where = reduce(lambda a, b: a | b, [self._is(f, x.terms) for f in x.fields])
        weight = reduce(lambda acc, f: F.when(F.col("field") == f, weights[f]).otherwise(acc), x.fields, F.lit(0.0))
        rows = self._with_corpus(self.index.postings.where(where))
        part = weight * F.col("tf") / (1 - x.b + x.b * F.col("dl") / F.col("avgdl"))
        by_term = rows.groupBy("doc_id", "term").agg(F.sum(part).alias("pf"), F.max("n_docs").alias("n"))
        union = by_term.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        both = by_term.join(F.broadcast(union), "term")
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        score = idf * F.col("pf") * (x.k1 + 1) / (F.col("pf") + x.k1)
        agg = both.groupBy("doc_id").agg(F.sum(score).alias("score"), F.count(F.lit(1)).alias("_n"))
        return agg.where(F.col("_n") >= x.least).select("doc_id", (F.col("score") * x.boost).alias("score"))

    def _rrfq(self, x: q.RrfQ) -> DataFrame:
        parts = []
        order = Window.orderBy(F.col("score").desc(), "doc_id")
        for p in x.parts:
            top = self._run(p).orderBy(F.col("score").desc(), "doc_id").limit(x.depth)
            parts.append(top.select("doc_id", (1 / (x.k + F.row_number().over(order))).alias("score")))
        rows = reduce(DataFrame.unionByName, parts)
        return rows.groupBy("doc_id").agg((F.sum("score") * x.boost).alias("score"))

    def _parentq(self, x: q.ParentQ) -> DataFrame:
        children = self.index.docs.select("doc_id", F.col(x.parent).alias("_p")).where("_p is not null")
        parents = children.join(self._run(x.child).select("doc_id"), "doc_id", "left_semi").select(F.col("_p").alias("doc_id")).distinct()
        return self._flat(parents, x.boost)

    def like_terms(self, x: q.LikeQ) -> DataFrame:
        """``(field, term, df, cf, weight)``: the most telling terms of a document, at most ``most``."""
        of = self.index.postings.where(F.col("field").isin(list(x.fields)) & (F.col("doc_id") == x.doc_id) & (F.col("tf") >= x.min_tf))
        # no more rows than the document has terms
        own = F.broadcast(of.where(F.length("term") >= x.min_length).select("field", "term", "tf"))
        own = self._with_corpus(self.index.term_stats.where((F.col("df") >= x.min_df)).join(own, ["field", "term"]))
        if x.max_df is not None:
            own = own.where(F.col("df") <= x.max_df)
        weight = F.col("tf") * F.log(F.col("n_docs") / (F.col("df") + 1))
        return own.select("field", "term", "df", "cf", weight.alias("weight")).where("weight > 0").orderBy(F.col("weight").desc(), "field", "term").limit(x.most)

    def _likeq(self, x: q.LikeQ) -> DataFrame:
        # at most x.most terms
        terms = self.like_terms(x).select("field", "term", "df", "cf", (F.col("weight") if x.weigh else F.lit(1.0)).alias("_w"))
        top = F.max("_w").over(Window.partitionBy(F.lit(0)))
        terms = terms.withColumn("_w", F.col("_w") / top)
        rows = self._scored_by(F.col("field").isin(list(x.fields)), F.broadcast(terms))
        return rows.where(F.col("doc_id") != x.doc_id).groupBy("doc_id").agg((F.sum(F.col("score") * F.col("_w")) * x.boost).alias("score"))

    def _vectorq(self, x: q.VectorQ) -> DataFrame:
        """The filter first, then the cosine of what is left; of the nearest clusters alone where the query says so."""
        docs = self._docs(F.col(x.column).isNotNull())
        if x.probes and x.column in self.vectors:
            near = self.vectors[x.column]
            at = near.assigned.where(F.col("cluster").isin(near.near(list(x.vector), x.probes))).select("doc_id", near.column)
            docs = at.withColumnRenamed(near.column, x.column).join(docs.select("doc_id"), "doc_id", "left_semi")
        if x.where is not None:
            docs = docs.join(self._run(x.where).select("doc_id"), "doc_id", "left_semi")
        target = F.array(*[F.lit(float(v)) for v in x.vector])
        top = docs.select("doc_id", vectors.cosine(F.col(x.column), target).alias("score")).orderBy(F.col("score").desc(), "doc_id").limit(x.k)
        return top.select("doc_id", (F.col("score") * x.boost).alias("score"))

    # -- explanation

    def explain(self, query: q.Query, doc_id: int) -> DataFrame:
        """The numbers behind a term's or a vector's score in one document."""
        if isinstance(query, q.VectorQ):
            target = F.array(*[F.lit(float(v)) for v in query.vector])
            at = F.col(query.column)
            return self.index.docs.where(F.col("doc_id") == doc_id).select(
                "doc_id", vectors.dot(at, target).alias("dot"), vectors.norm(at).alias("norm"), vectors.norm(target).alias("query_norm"),
                (vectors.cosine(at, target) * query.boost).alias("score"),
            )
        if not isinstance(query, q.TermQ):
            raise TypeError("only term and vector queries can be explained")
        rows = self._with_stats(self._is(query.field, [query.term])).where(F.col("doc_id") == doc_id)
        t = similarity.Term.columns()
        return rows.select(
            "doc_id", "field", "term", "tf", "dl", "df", "n_docs", "avgdl", similarity.idf(t).alias("idf"), F.col("boost").alias("field_boost"),
            F.lit(float(query.boost)).alias("query_boost"), (self.model(t) * F.col("boost") * query.boost).alias("score"),
        )
