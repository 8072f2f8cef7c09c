"""The queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import one_row_per_id, stage, table
from . import distinctive, mixing, near_duplicates, new_text, packing, pii, term_counts, truncation

BODIES = ("newsgroup_message", "book_paragraph")


def _scored_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Every term of every body with its score."""
    out = None
    for tab in BODIES:
        records = term_counts.text_records(table(spark, sf, tab), "doc_id", "body")
        own = distinctive.distinctive_terms(records).withColumn("tab", F.lit(tab))
        out = own if out is None else out.unionByName(own)
    return out


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    told = _scored_bodies(spark, sf).where("z > 0")
    fit = told.where("tf >= 3 and records between 2 and 6 and length(term) >= 4 and not term rlike '^[\\\\p{Nd}]+$'")
    return fit.select("tab", "doc_id", "term")


def p1_body_top(spark: SparkSession, sf: str) -> DataFrame:
    """The three most characteristic terms of every body."""
    return distinctive.most_distinctive(_scored_bodies(spark, sf), ["tab", "doc_id"], 3).select("tab", "doc_id", "place", "term", "tf", "z")


def p1_posting_top(spark: SparkSession, sf: str) -> DataFrame:
    scored = distinctive.distinctive_postings(table(spark, sf, "posting_row"))
    return distinctive.most_distinctive(scored, ["doc_id"], 3).select("doc_id", "place", "term", "tf", "z")


def _posting_counts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    known = table(spark, sf, "book_paragraph").select("doc_id").where("doc_id is not null").distinct()
    live = table(spark, sf, "posting_row").select("doc_id", "term", "frequency").join(known, "doc_id", "left_semi")
    once, counts = term_counts.posting_term_counts(live)
    return counts, once.agg(F.count_distinct("doc_id").alias("n"))


def _marked(spark: SparkSession, sf: str) -> DataFrame:
    records = term_counts.text_records(table(spark, sf, "book_paragraph"), "doc_id", "body")
    texts = term_counts.mark_terms(term_counts.text_term_counts(records, "text"), term_counts.count_records(records))
    counts, n = _posting_counts(spark, sf)
    postings = term_counts.mark_terms(counts, n)
    return texts.withColumn("tab", F.lit("book_paragraph")).unionByName(postings.withColumn("tab", F.lit("posting_row")))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _marked(spark, sf).where("mark is not null").select("tab", "term", "mark")


def p2_term_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return _marked(spark, sf).select("tab", "term", "occurrences", "records", F.coalesce("mark", F.lit("useful")).alias("mark"))


PII_FIELDS = ["body", "from_addr", "headers"]


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    spans = pii.find(table(spark, sf, "newsgroup_message"), table(spark, sf, "name_lexicon"), PII_FIELDS)
    return spans.select("doc_id", "field", "kind", "surface").distinct()


def p3_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return pii.redact(table(spark, sf, "newsgroup_message"), table(spark, sf, "name_lexicon"), PII_FIELDS)


def p3_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """For each field, whether all texts come back when what was found is put into the placeholders again."""
    messages, names = table(spark, sf, "newsgroup_message"), table(spark, sf, "name_lexicon")
    spans = stage(pii.find(messages, names, PII_FIELDS), "pii-spans")
    out = pii.redact(messages, names, PII_FIELDS)
    own = one_row_per_id(messages.select("doc_id", *PII_FIELDS), "doc_id")
    parts = None
    for field in PII_FIELDS:
        found = spans.where(F.col("field") == field).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "kind", "surface"))).alias("spans"))
        met = own.select("doc_id", F.col(field).alias("text")).join(out.select("doc_id", F.col(field).alias("redacted")), "doc_id").join(found, "doc_id", "left")
        same = met.select(F.pandas_udf(_restored, "boolean")("text", "redacted", "spans").alias("ok"))
        part = same.agg(F.min("ok").alias("holds")).select(F.lit(field).alias("field"), "holds")
        parts = part if parts is None else parts.unionByName(part)
    return parts


def _restored(text, redacted, spans):
    def one(t, r, found):
        if t is None or r is None:
            return t is None and r is None
        for s in sorted([] if found is None else found, key=lambda x: -x["start"]):
            at = s["start"] + sum(len(pii.PLACEHOLDERS[o["kind"]]) - (o["stop"] - o["start"]) for o in found if o["stop"] <= s["start"])
            mark = pii.PLACEHOLDERS[s["kind"]]
            if r[at : at + len(mark)] != mark or t[s["start"] : s["stop"]] != s["surface"]:
                return False
            r = r[:at] + s["surface"] + r[at + len(mark) :]
        return r == t

    return pd.Series([one(*x) for x in zip(text, redacted, spans)])


def _similar(spark: SparkSession, sf: str, tab: str):
    return near_duplicates.similar_records(table(spark, sf, tab).select("doc_id", F.col("body").alias("text")))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for tab in ("book_paragraph", "newsgroup_message"):
        pairs = near_duplicates.pairs_of_records(*_similar(spark, sf, tab))
        own = pairs.select(F.lit(tab).alias("tab"), "doc_id_a", "doc_id_b")
        out = own if out is None else out.unionByName(own)
    return out


def p4_groups(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for tab in ("book_paragraph", "newsgroup_message"):
        own = near_duplicates.groups(*_similar(spark, sf, tab)).withColumn("tab", F.lit(tab))
        out = own if out is None else out.unionByName(own)
    return out.select("tab", "doc_id", "group_id", "links")


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "newsgroup_message").select("doc_id", F.col("body").alias("text"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    labels = new_text.label_lines(_messages(spark, sf))
    return labels.where("label <> 'new'").select("doc_id", "line_no").distinct()


def p5_new_text(spark: SparkSession, sf: str) -> DataFrame:
    return new_text.new_text(_messages(spark, sf)).select("doc_id", F.col("text").alias("new_text"))


def _capacity(spark: SparkSession, sf: str, spec: str) -> int:
    return table(spark, sf, "container_spec").where(F.col("spec_id") == spec).agg(F.max("capacity_tokens")).first()[0]


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    capacity = _capacity(spark, sf, "pack_2k")
    packed = packing.pack(packing.sized_documents(table(spark, sf, "documents")), capacity)
    return packed.where("piece > 0").select("doc_id").distinct()


def p6_containers(spark: SparkSession, sf: str) -> DataFrame:
    capacity = _capacity(spark, sf, "pack_8k")
    return packing.pack(packing.sized_documents(table(spark, sf, "documents")), capacity)


def p6_fill(spark: SparkSession, sf: str) -> DataFrame:
    sized = packing.sized_documents(table(spark, sf, "documents"))
    out = None
    for spec in ("pack_2k", "pack_8k"):
        capacity = _capacity(spark, sf, spec)
        own = packing.fill_report(packing.pack(sized, capacity), capacity).withColumn("spec_id", F.lit(spec))
        out = own if out is None else out.unionByName(own)
    return out


def p6_rules(spark: SparkSession, sf: str) -> DataFrame:
    """For each specification, whether its containers keep the rules of packing."""
    sized = packing.sized_documents(table(spark, sf, "documents"))
    out = None
    for spec in ("pack_2k", "pack_8k"):
        capacity = _capacity(spark, sf, spec)
        packed = stage(packing.pack(sized, capacity), "packed")
        whole = packed.groupBy("doc_id").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("parts"))
        kept = sized.where("tokens > 0").join(whole, "doc_id", "full").agg(
            F.coalesce(F.min(F.col("tokens").eqNullSafe(F.col("size"))), F.lit(True)).alias("all_placed"),
            F.coalesce(F.min((F.col("tokens") > capacity) | (F.col("parts") == 1)), F.lit(True)).alias("none_split"),
        )
        used = packed.groupBy("container").agg(F.sum("size").alias("used")).agg(
            F.coalesce(F.max("used") <= capacity, F.lit(True)).alias("within_capacity"),
            F.coalesce(F.count(F.lit(1)) <= F.ceil(F.sum("used") / capacity) * 1.01 + 1, F.lit(True)).alias("nearly_full"),
        )
        own = kept.crossJoin(used).select(F.lit(spec).alias("spec_id"), "*")
        out = own if out is None else out.unionByName(own)
    return out


def _mix(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(mixing.pool(table(spark, sf, "documents")), table(spark, sf, "mix_target"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    chosen, report = _mix(spark, sf)
    return mixing.shares(chosen, report).where("not reachable").select("mix_id", "source")


def p7_chosen(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf)[0]


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.shares(*_mix(spark, sf))


def p7_rules(spark: SparkSession, sf: str) -> DataFrame:
    """For each target, whether its tokens are met to one in a hundred or to one document, and no document is used too often."""
    docs = mixing.pool(table(spark, sf, "documents"))
    told = mixing.shares(*mixing.mix(docs, table(spark, sf, "mix_target")))
    largest = docs.groupBy("source").agg(F.max("tokens").alias("largest"))
    near = F.abs(F.col("chosen_tokens") - F.col("goal_tokens")) <= F.greatest(0.01 * F.col("goal_tokens"), F.coalesce("largest", F.lit(0)))
    return told.join(largest, "source", "left").select("mix_id", "source", near.alias("goal_met"), (F.col("most_uses") <= F.col("max_repeats")).alias("repeats_kept"), "settled")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.detect(table(spark, sf, "documents"))[0].where("cut").select("doc_id")


def p8_rates(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.rates(truncation.detect(table(spark, sf, "documents"))[0])


def p8_limits(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.detect(table(spark, sf, "documents"))[1]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[:1] == "p" and k[1:2].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    from .sql import SQL

    return dict(SQL)
