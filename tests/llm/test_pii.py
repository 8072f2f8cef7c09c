"""Personal information in small texts."""

from __future__ import annotations

import pytest

from folioscope.llm import pii

NAMES = [("Ada", "given"), ("Bo", "given"), ("Cyr", "given"), ("Dorn", "family"), ("Elm", "family"), (None, "given"), ("X", None)]


def found(text, headers=False):
    return {(c[3], c[2]) for c in pii.candidates_in(text, headers)}


def test_candidates():
    got = found("Mail a.b@c.example. or d (at) e.example, f at g dot example; h!i!j5 <1q$c@m.example>")
    assert {s for k, s in got if k == "mail"} >= {"a.b@c.example", "d (at) e.example", "f at g dot example", "h!i!j5"}
    assert not any("$" in s for _, s in got)
    got = found("Apt. 2B, 14 Mill Lane, Dale 12345 and P.O. Box 77, Dale, then Altweg 3, 12345 Dorf.")
    assert {s for k, s in got if k == "postal"} == {"Apt. 2B, 14 Mill Lane, Dale 12345", "P.O. Box 77, Dale", "Altweg 3, 12345 Dorf"}
    assert ("number", "1-718-555-0104 x645") in found("call 1-718-555-0104 x645 now")
    assert ("number", "QQ 12 34 56 C") in found("number QQ 12 34 56 C if")


@pytest.fixture(scope="module")
def messages(spark):
    rows = [
        (i, f"Hello.\n\n-- \n{g} {f}\n{p} Mill Lane, Dale", f"{g} {f} <{g.lower()}@x.example>", f"From: {g} {f} <{g.lower()}@x.example>\nX-Phone: 555/123-45{p}\nMessage-ID: <{p}@x.example>")
        for i, (g, f, p) in enumerate([("Ada", "Dorn", 10), ("Bo", "Elm", 11), ("Cyr", "Dorn", 12), ("Ada", "Elm", 13)])
    ]
    rows += [
        (10, "Call Bo Elm on 555/123-4599 now.\n\n-- \nZed Dorn\n12 Mill Lane, Dale", None, None),
        (11, None, "", ""), (10, "Call Bo Elm on 555/123-4599 now.\n\n-- \nZed Dorn\n12 Mill Lane, Dale", None, None), (None, "Ada Dorn", None, None),
    ]
    return spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, body string, from_addr string, headers string, kind string")


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame(NAMES, "name string, kind string")


FIELDS = ["body", "from_addr", "headers"]


def test_find(messages, names):
    got = {(r["doc_id"], r["field"], r["kind"], r["surface"]) for r in pii.find(messages, names, FIELDS).collect()}
    assert (0, "from_addr", "email", "ada@x.example") in got
    assert (0, "headers", "phone", "555/123-4510") in got
    assert (10, "body", "phone", "555/123-4599") in got  # its shape was learnt from the header
    assert (10, "body", "person_name", "Bo Elm") in got
    assert (0, "body", "street_address", "10 Mill Lane, Dale") in got
    assert not any(r[0] in (11, None) for r in got)


def test_redact(messages, names):
    out = {r["doc_id"]: r for r in pii.redact(messages, names, FIELDS).collect()}
    assert out[0]["body"] == "Hello.\n\n-- \n[PERSON_NAME]\n[STREET_ADDRESS]"
    assert out[10]["body"].startswith("Call [PERSON_NAME] on [PHONE] now.")
    assert out[11]["body"] is None and out[11]["headers"] == ""
    assert len(out) == 6


def test_nothing(messages, names):
    assert pii.find(messages.where("false"), names, FIELDS).count() == 0


def test_apart():
    spans = [dict(start=0, stop=5, kind="person_name", surface="x", conf=1.0), dict(start=3, stop=9, kind="email", surface="y", conf=0.6)]
    assert [s["kind"] for s in pii._apart(spans)] == ["email"]


def test_whole_local_parts_contexts_and_numbers():
    long = "a" * 400
    got = found(f"write to {long}@x.example or --b.c@y.example; é@z.example")
    assert {s for k, s in got if k == "mail"} == {f"{long}@x.example", "b.c@y.example"}
    near = {c[6] for c in pii.candidates_in(f"call {'w' * 300} {'v' * 90} 555-123-4567") if c[3] == "number"}
    assert near == {f"{'w' * 300} {'v' * 90}"}
    assert ("number", "9" * 30) in found(f"account {'9' * 30} .")
    assert pii._shape("9" * 30) == "9+"


def test_lower_case_and_other_scripts():
    lexicon = frozenset({"ada", "dorn"})
    got = {(c[3], c[2]) for c in pii.candidates_in("ask ada dorn, or dorn, ada now; Łukasz Żak", lexicon=lexicon)}
    assert {("lower", "ada dorn"), ("lower,", "dorn, ada"), ("name", "Łukasz Żak")} <= got


def test_names_in_lower_case_are_found(spark, names):
    rows = [(i, f"{g} {f}", None, None) for i, (g, f) in enumerate([("Ada", "Dorn"), ("Bo", "Elm")])] + [(9, "then bo elm said ada mill", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, body string, from_addr string, headers string")
    got = {(r["doc_id"], r["surface"]) for r in pii.find(df, names, FIELDS).collect()}
    assert (9, "bo elm") in got and (9, "ada mill") not in got


def test_routes_are_no_addresses(spark, names):
    """Some true addresses of a shape do not make thousands of Path lines personal."""
    rows = [(i, None, None, f"From: a.b@x{i}.example\nPath: n{i}.example!relay.m.example!not-for-mail\nMessage-ID: <1993Jan1.{i}@n.example>") for i in range(3000)]
    rows += [(10_000 + i, f"Please write to ab@x{i}.example or reach me at cd@y{i}.example", None, None) for i in range(30)]
    rows += [(20_000 + i, f"Please {way} m{i}.example!relay!user{i}", None, None) for i, way in enumerate(["write to", "reach me at", "write to"])]
    rows += [(30_000 + i, f"Please {way} m!relay!user{i}", None, None) for i, way in enumerate(["write to", "reach me at", "write to"])]
    df = spark.createDataFrame(rows, "doc_id long, body string, from_addr string, headers string")
    got = {(r["doc_id"], r["kind"], r["surface"]) for r in pii.find(df, names, FIELDS).collect()}
    assert not any(s.endswith("not-for-mail") or "Jan1" in s for _, _, s in got)
    assert sum(k == "email" and d < 10_000 for d, k, _ in got) == 3000
    assert {d for d, _, s in got if s.startswith("m!relay!user")} == {30_000, 30_001, 30_002}


def test_introducing_words_are_no_names(spark, names):
    rows = [(i, f"Quoting {g} {f}:\n> x\n", None, None) for i in range(40) for g in ("Ada", "Bo", "Cyr") for f in ("Dorn", "Elm", "Novo")]
    df = spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)], "doc_id long, body string, from_addr string, headers string")
    got = {r["surface"] for r in pii.find(df, names, FIELDS).collect()}
    assert got and not any(s.startswith("Quoting") for s in got)
