"""Labels of lines: held-out accuracy on generated mails, and edges."""

from __future__ import annotations

import random

import pytest

from folioscope.llm import new_text as nt

PROSE = ["The fog lifted from the harbour before anyone had noticed it.", "We moved the boxes to the shed, though few of them were dry.", "Has anyone tried the new valve on a cold morning?"]
NAMES = ["Ada Dorn", "Bo Elm", "Cyr Fallow", "Dee Grant"]


def mail(rng: random.Random) -> tuple[str, list[str]]:
    lines, labels = [], []

    def put(label, *more):
        for x in more:
            lines.append(x)
            labels.append(label)

    if rng.random() < 0.6:
        mark = rng.choice(["> ", "| ", ": ", ">"])
        put("quoted", f"{rng.choice(NAMES)} wrote:", *[mark + rng.choice(PROSE)[:50] for _ in range(rng.randint(1, 4))])
        put("new", "")
    for _ in range(rng.randint(1, 3)):
        put("new", *rng.choices(PROSE, k=rng.randint(1, 4)), "")
    if rng.random() < 0.3:
        put("new", "| item | price |", "| pear |    12 |", "")
    if rng.random() < 0.7:
        put("signature", *rng.choice([["-- "], ["--"], ["____________"]]), rng.choice(NAMES), "Mill Works", "tel: 555-123-4567")
    if rng.random() < 0.4:
        put("disclaimer", "", "This message is confidential and intended for the addressee only.", "No liability is accepted for loss.")
    return "\n".join(lines), labels


@pytest.fixture(scope="module")
def model():
    rng = random.Random(5)
    return nt.fit([mail(rng)[0] for _ in range(400)])


def test_held_out_accuracy(model):
    rng = random.Random(99)
    right = total = 0
    for _ in range(200):
        text, gold = mail(rng)
        path = nt.decode(model, [text])[0]
        for line, g, p in zip(text.split("\n"), gold, path):
            if line.strip():
                total += 1
                right += (g == "new") == (nt.LABELS[p] == "new")
    assert right / total > 0.98


def test_decoding_together_equals_alone(model):
    rng = random.Random(7)
    texts = [mail(rng)[0] for _ in range(30)] + ["x", "\n\n"]
    assert [p.tolist() for p in nt.decode(model, texts)] == [nt.decode(model, [t])[0].tolist() for t in texts]


def test_forwarded_to_the_end():
    labels = nt.weak_labels("See below.\n\n---------- Forwarded message ----------\nFrom: A <a@b.example>\n\nOld text.".split("\n"))
    assert labels[0] == nt.NEW and labels[2:] == [nt.FORWARDED] * 4


def test_frames(spark, model):
    text = "Ada Dorn wrote:\n> old words\n\nNew words.\n\n-- \nBo Elm"
    rows = [(1, text, "k"), (1, text, "k"), (2, None, "k"), (3, "", "k"), (None, text, "k"), (4, "only " * 20_000, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string")
    out = {r["doc_id"]: r["text"] for r in nt.new_text(df, model).collect()}
    assert out[1] == "New words." and out[2] is None and out[3] == "" and len(out) == 4
    got = {(r["doc_id"], r["line_no"]) for r in nt.label_lines(df, model).where("label <> 'new' and doc_id <> 4").collect()}
    assert got == {(1, 1), (1, 2), (1, 6), (1, 7)}
    assert nt.label_lines(df.where("false")).count() == 0
