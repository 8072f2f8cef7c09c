"""Only the text that the sender of a message wrote.

Method: every line is labelled new, quoted, signature or disclaimer by a linear
sequence model (a first-order model decoded with Viterbi, its weights fitted by
an averaged structured perceptron) over position, punctuation, prefix and
neighbouring-line features.

There is no hand-labelled mail.  The model is fitted on a bounded sample of
messages (``TRAIN_MESSAGES``, those with the smallest hash) whose lines are
labelled by :func:`weak_labels`: quote marks under an introduction, blocks
under a signature mark, closing blocks with the marks of a contact or a
disclaimer.  Everything else runs over every line of every message.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import one_row_per_id, ship_package, spread

#: Messages whose lines the model is fitted on, at most.
TRAIN_MESSAGES = 1500
#: Passes of the perceptron.
EPOCHS = 4
#: Hashed features.
SIZE = 1 << 14

LABELS = ("new", "quoted", "forwarded", "signature", "disclaimer")
NEW, QUOTED, FORWARDED, SIGNATURE, DISCLAIMER = range(5)

_PREFIX = re.compile(r"^(?:\s{0,3}(?:[>|:}#%]|[A-Z][A-Za-z]{0,3}>) ?|\s{4,}(?=\S))")
_ROW = re.compile(r"^\s*\|.*\|\s*$")
_SEPARATOR = re.compile(r"^\s*(?:--\s?|[-_=*~#]{8,})\s*$")
_FORWARD = re.compile(
    r"^\s*-{2,}\s*(?:[A-Za-z]+ ){0,2}(?:forwarded|original|included|weitergeleitete|urspr\w+|reenviado|transf\w+)\b.*-{2,}\s*$"
    r"|^\s*(?:begin forwarded message|forwarded message)\b",
    re.I,
)
_FIELD = re.compile(r"^(?:From|Date|Subject|To|Cc|Sent|Von|An|Datum|Betreff|De|Para|Fecha|Asunto|Objet)\s?:", re.I)
_SAYS = re.compile(
    r"\b(?:writes?|wrote|said|says|schrieb|schreibt|escribi[óo]|escribe|[ée]cri(?:t|vait|vit)|skrev|scrisse|according to|quoting|responds?|typed)\b",
    re.I,
)
_DATE = re.compile(r"\b\d{1,2} [A-Z][a-zé]{2,8}\.? \d{2,4}\b|\b\d{4}-\d\d-\d\d\b|\b\d{1,2}:\d\d\b")
_MAIL = re.compile(r"\S@\S|\S!\S+!\S")
_PHONE = re.compile(r"(?:\+?\d[\d ()./-]{6,}\d)")
_CONTACT = re.compile(r"\b(?:tel|phone|fax|e-?mail|voice|mobile|sent with|sent from)\b", re.I)
_LEGAL = re.compile(
    r"\b(?:confidential\w*|disclaimer|privileged|liab\w+|addressee|recipients?|opinions?|views|employer|warrant\w+|accepts?|loss|damages?|myself|behalf|approv\w+|endors\w+|neither|unauthori[sz]ed|"
    r"disclos\w+|prohibited|vertraulich|empf[äa]nger|confiden\w+|destinata\w+|responsab\w+|represent|consent|permi\w+|intended|delete)\b",
    re.I,
)
_NAMEISH = re.compile(r"^[A-ZÀ-Þ][\w.'’-]*(?: [A-ZÀ-Þ][\w.'’-]*){1,3}$")
_WORD = re.compile(r"[^\W\d_]{3,}")


def _kind(line: str) -> str:
    """The prefix class of a line."""
    if not line.strip():
        return "blank"
    if line.startswith("    "):
        return "indent"
    if _SEPARATOR.match(line):
        return "mark"
    if _ROW.match(line) and line.count("|") > 2:
        return "row"
    m = _PREFIX.match(line)
    if not m:
        return "none"
    p = m.group().strip()
    if not p:
        return "indent"
    return "initials" if len(p) > 1 else p


#: Prefix classes that quote marks make.
_MARKS = {">", "|", ":", "}", "initials", "indent"}


def line_features(lines: list[str]) -> list[tuple[tuple, tuple]]:
    """The state of each line of a message, and words of closing blocks.

    A state is a tuple of categories; :func:`state_names` turns it into feature
    names.  Ordinary lines share few states, so their features are made once.
    """
    n = len(lines)
    kinds = [_kind(x) for x in lines]
    solid = [i for i in range(n) if kinds[i] != "blank"]
    before = {j: i for i, j in zip(solid, solid[1:])}
    after = {i: j for i, j in zip(solid, solid[1:])}
    # blocks: runs of lines without a blank between them
    block = [0] * n
    spans: list[list[int]] = []
    for i in range(n):
        if kinds[i] != "blank":
            if i == 0 or kinds[i - 1] == "blank":
                spans.append([])
            spans[-1].append(i)
        block[i] = max(len(spans) - 1, 0)
    ahead = next((i for i in solid if lines[i].lstrip()[:1] in ("-", "b", "B", "f", "F") and _FORWARD.match(lines[i])), n)
    last = max((block[i] for i in solid if i < ahead), default=0)
    legals = {
        k: sum(len(_LEGAL.findall(lines[j])) for j in spans[k])
        for k in range(len(spans))
        if spans[k][0] < ahead
    }
    end = last
    while end > 0 and legals.get(end, 0) >= 2 and len(spans[end]) <= 5:
        end -= 1
    heads = {}
    out: list[tuple[tuple, tuple]] = []
    marked = forwarded = False
    seen: set[str] = set()
    prev = "start"
    for i, line in enumerate(lines):
        kind = kinds[i]
        if kind == "blank":
            q = i + 1
            while q < n and kinds[q] == "blank":
                q += 1
            out.append((("blank", prev, kinds[q] if q < n else "end", forwarded), ()))
            continue
        prev = kind
        k = block[i]
        own = spans[k]
        text = line.strip()
        p, q = before.get(i), after.get(i)
        pk = kinds[p] if p is not None else "start"
        qk = kinds[q] if q is not None else "end"
        near_p, near_q = p == i - 1, q == i + 1
        tail = text[-1]
        nt = lines[q].rstrip() if near_q else ""
        intro = introq = None
        if tail == ":" or text.endswith("...") or qk in _MARKS:
            intro = (bool(_SAYS.search(text)), tail if tail in ":.," else "-", bool(_DATE.search(text)), bool(_MAIL.search(text)), qk in _MARKS)
        if near_q and (tail in ",>" or text[:3] in _OPENS) and (nt[-1:] == ":" or nt.endswith("...")):
            introq = (bool(_SAYS.search(nt)), bool(_SAYS.search(text)), bool(_MAIL.search(text)), bool(_DATE.search(text)), tail in ",>", text[:3] in _OPENS)
        forward = i == ahead
        forwarded |= forward
        if kind == "mark":
            marked = True
        last_blocks = max(last - k, 0)
        rank = end - k
        rank = -1 if rank < 0 else min(rank, 2)
        if k not in heads:
            first = lines[own[0]].strip()
            heads[k] = (kinds[own[0]], bool(_NAMEISH.match(first)) and len(first) < 40)
        head, name_first = heads[k]
        size = min(len(own), 8)
        legal = legals.get(k, 0) if kind == "none" else 0
        again = None
        if kind in _MARKS:
            again = kind in seen
            seen.add(kind)
        contact = nameish = short = None
        closing = last_blocks <= 2 or marked
        if closing:
            contact = (bool(_CONTACT.search(text)) or bool(_PHONE.search(text)) or bool(_MAIL.search(text)), len(text) < 48, tail in ".!?")
            nameish = bool(_NAMEISH.match(text))
        words: tuple = ()
        if last_blocks <= 1 and kind in ("none", "mark"):
            short = max(len(lines[j].strip()) for j in own) < 60
            if last_blocks == 0 or legal:
                words = tuple(w.lower() for w in _WORD.findall(text))
        out.append((
            (
                "line", kind, pk, near_p, qk, near_q, intro, introq, forward, forwarded,
                tail in ":" and bool(_FIELD.match(text)) or (forwarded and bool(_FIELD.match(text))),
                text[:2] if kind == "mark" else None, min(n - 1 - i, 6), min(last_blocks, 3), rank, size, min(i - own[0], 5),
                head, name_first, again, min(legal, 4), contact, nameish, short,
                any(kinds[j] == "mark" for j in own if j < i) if marked else False, marked,
            ),
            words,
        ))
    return out


#: How lines that introduce a quotation over two lines begin.
_OPENS = ("In ", "On ", "Am ", "Le ", "El ", "Il ")


def state_names(state: tuple) -> list[str]:
    """Feature names of a state."""
    if state[0] == "blank":
        _, pk, qk, forwarded = state
        return ["blank", f"blank<{pk}", f"blank>{qk}", *["after-forward"] * forwarded]
    (_, kind, pk, near_p, qk, near_q, intro, introq, forward, forwarded, field, mark, tail, lb, rank, size, pos,
     head, name_first, again, legal, contact, nameish, short, under, marked) = state
    f = ["line", f"k:{kind}", f"k:{kind}|p:{pk}{near_p:d}", f"k:{kind}|q:{qk}{near_q:d}"]
    f.append(f"end:{tail}|{kind}")
    f.append(f"fromlast:{lb}|{size}")
    f.append(f"pos:{pos}|{min(lb, 2)}")
    f.append(f"head:{head}|{name_first:d}|{rank}|{size <= 6:d}|{kind == 'row':d}")
    if intro:
        f += [f"intro:{intro}", f"says:{intro[0]:d}{intro[1]}"]
    if introq:
        f.append(f"introq:{introq}")
    if forward:
        f.append("forward")
    elif forwarded:
        f.append("after-forward")
    if field:
        f.append("field")
    if mark:
        f += ["mark", f"mark:{mark}"]
    if again is not None:
        f.append(f"again:{again:d}|{kind}")
    if legal:
        f.append(f"legal:{legal}|{min(lb, 2)}|{name_first:d}|{head == 'mark':d}")
    if contact:
        f.append(f"contact:{contact}|{min(lb, 2)}")
    if nameish:
        f.append(f"nameish:{pos == 0:d}|{rank}|{size <= 6:d}")
    if short is not None:
        f.append(f"short:{short:d}|{name_first:d}|{min(size, 6)}|{rank}|{kind}")
    if marked and kind != "mark":
        f.append(f"marked:{head == 'mark':d}|{min(lb, 2)}")
    if under:
        f.append("under-mark")
    return f


def _ids(state: tuple, words: tuple, cache: dict) -> list[int]:
    at = cache.get(state)
    if at is None:
        at = cache[state] = [_bucket(x) for x in state_names(state)]
    if not words:
        return at
    more = []
    for w in words:
        h = cache.get(w)
        if h is None:
            h = cache[w] = _bucket("w:" + w)
        more.append(h)
    return at + more


def _bucket(name: str) -> int:
    h = 2166136261
    for c in name.encode():
        h = ((h ^ c) * 16777619) & 0xFFFFFFFF
    return h % SIZE


def closing_blocks(texts: list[str], least: int = 5) -> set[str]:
    """Last blocks that several messages share word for word, signatures apart."""
    seen: dict[str, int] = {}
    for t in texts:
        own = re.split(r"\n\s*\n", t.rstrip())
        block = own[-1].strip()
        first = block.split("\n")[0].strip()
        if len(own) > 1 and block.count("\n") < 5 and not _NAMEISH.match(first) and _kind(first) == "none" and not _MAIL.search(block):
            seen[block] = seen.get(block, 0) + 1
    return {b for b, n in seen.items() if n >= least}


def weak_labels(lines: list[str], shared: set[str] = frozenset()) -> list[int]:
    """Labels for training, from marks that leave little doubt.

    ``shared`` are closing blocks of several messages, which no single sender wrote.
    """
    n = len(lines)
    kinds = [_kind(x) for x in lines]
    out = [NEW] * n
    indents = False
    i = 0
    while i < n:
        if _FORWARD.match(lines[i]):
            for j in range(i, n):
                out[j] = FORWARDED
            break
        i += 1
    stop = i
    for i in range(stop):
        if kinds[i] in _MARKS:
            k = i
            while k > 0 and kinds[k - 1] == kinds[i]:
                k -= 1
            intro = [j for j in (k - 1, k - 2) if j >= 0 and kinds[j] == "none"]
            told = bool(intro) and intro[0] == k - 1 and lines[k - 1].rstrip()[-1:] in (":", ".") and (
                _SAYS.search(lines[k - 1]) or _SAYS.search(lines[k - 2] if k > 1 else "")
            )
            indents |= bool(told) and kinds[i] == "indent"
            if told or kinds[i] != "indent" or indents:
                out[i] = QUOTED
            if told:
                out[k - 1] = QUOTED
                if len(intro) > 1 and intro[1] == k - 2 and re.match(r"^(?:In|On|Am|Le|El|Il)\b", lines[k - 2]) and not _SAYS.search(lines[k - 2]):
                    out[k - 2] = QUOTED
    # closing blocks, from the end of the own part backwards
    blocks: list[list[int]] = []
    for i in range(stop):
        if kinds[i] == "blank":
            continue
        if blocks and blocks[-1][-1] == i - 1:
            blocks[-1].append(i)
        else:
            blocks.append([i])
    for own in reversed(blocks):
        if any(out[j] == QUOTED for j in own):
            break
        text = [lines[j].strip() for j in own]
        legal = sum(len(_LEGAL.findall(x)) for x in text)
        if kinds[own[0]] == "mark":
            for j in own:
                out[j] = SIGNATURE
            break
        at = next((k for k, j in enumerate(own) if kinds[j] == "mark"), None)
        if at is not None:
            for j in own[at:]:
                out[j] = SIGNATURE
            break
        name = bool(_NAMEISH.match(text[0])) and len(own) <= 6 and max(map(len, text)) < 60
        if name and (len(own) > 1 or own is blocks[-1]) and own is not blocks[0]:
            for j in own:
                out[j] = SIGNATURE
            break
        if (legal >= 2 or "\n".join(text) in shared) and len(own) <= 5 and own is not blocks[0]:
            for j in own:
                out[j] = DISCLAIMER
            continue
        break
    # blanks go with what follows them, so that runs of a label stay whole
    for i in range(n - 2, -1, -1):
        if kinds[i] == "blank":
            out[i] = out[i + 1]
    return out


def _viterbi(emit: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    n, k = emit.shape
    score, back = start + emit[0], np.zeros((n, k), np.int8)
    for t in range(1, n):
        step = score[:, None] + trans
        back[t] = step.argmax(0)
        score = step.max(0) + emit[t]
    path = np.zeros(n, np.int8)
    path[-1] = score.argmax()
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def fit(texts: list[str], epochs: int = EPOCHS) -> dict[str, np.ndarray]:
    """Averaged structured perceptron on weakly labelled messages."""
    data = []
    cache: dict = {}
    shared = closing_blocks(texts)
    for t in texts:
        lines = t.split("\n")
        data.append(([np.array(_ids(*f, cache)) for f in line_features(lines)], np.array(weak_labels(lines, shared))))
    k = len(LABELS)
    w, trans, start = np.zeros((SIZE, k)), np.zeros((k, k)), np.zeros(k)
    sw, st, ss = np.zeros_like(w), np.zeros_like(trans), np.zeros_like(start)
    c = 1
    for _ in range(epochs):
        for feats, gold in data:
            emit = np.array([w[f].sum(0) for f in feats])
            path = _viterbi(emit, trans, start)
            if (path != gold).any():
                for f, p, g in zip(feats, path, gold):
                    if p != g:
                        np.add.at(w, (f, g), 1.0)
                        np.add.at(w, (f, p), -1.0)
                        np.add.at(sw, (f, g), c)
                        np.add.at(sw, (f, p), -c)
                for a, sign in ((gold, 1.0), (path, -1.0)):
                    np.add.at(trans, (a[:-1], a[1:]), sign)
                    np.add.at(st, (a[:-1], a[1:]), sign * c)
                    start[a[0]] += sign
                    ss[a[0]] += sign * c
            c += 1
    return {"w": w - sw / c, "trans": trans - st / c, "start": start - ss / c}


def decode(model: dict[str, np.ndarray], texts: list[str]) -> list[np.ndarray]:
    """Labels of every line of each text; all texts advance together."""
    w = model["w"]
    k = len(LABELS)
    ids: dict = {}
    held: dict = {}
    rows: list[np.ndarray] = []
    sizes = []
    for t in texts:
        feats = line_features(t.split("\n"))
        sizes.append(len(feats))
        for state, words in feats:
            e = held.get(state)
            if e is None:
                e = held[state] = w[_ids(state, (), ids)].sum(0)
            if words:
                e = e + w[_ids(state, words, ids)[-len(words):]].sum(0)
            rows.append(e)
    emit = np.array(rows)
    order = np.argsort(sizes, kind="stable")[::-1]
    n = np.array(sizes)[order]
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])[order]
    score = model["start"] + emit[first]
    backs = []
    finals = np.zeros((len(n), k))
    alive = len(n)
    for t in range(1, int(n[0]) if len(n) else 0):
        now = int(np.searchsorted(-n, -t, "left"))  # texts with more than t lines
        finals[now:alive] = score[now:alive]
        alive = now
        step = score[:alive, :, None] + model["trans"]
        backs.append(step.argmax(1).astype(np.int8))
        score = step.max(1) + emit[first[:alive] + t]
    finals[:alive] = score[:alive]
    paths = [np.zeros(x, np.int8) for x in n]
    for i, path in enumerate(paths):
        path[-1] = finals[i].argmax()
        for t in range(len(path) - 1, 0, -1):
            path[t - 1] = backs[t - 1][i, path[t]]
    out = [None] * len(n)
    for i, j in enumerate(order):
        out[j] = paths[i]
    return out


def train(messages: DataFrame, limit: int = TRAIN_MESSAGES) -> dict[str, np.ndarray]:
    """Fit the model on the messages of ``(doc_id, text)`` with the smallest hash."""
    some = messages.where("text is not null and text <> '' and doc_id is not null")
    # only ids and hashes are ranked; texts of the chosen few follow
    ids = some.select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(2 * limit).select("doc_id").distinct()
    rows = some.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi").collect()
    texts = list(dict.fromkeys(r["text"] for r in sorted(rows, key=lambda r: r["doc_id"])))[:limit]
    return fit(texts)


def _label(model: dict[str, np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                docs, nos, labels = [], [], []
                for doc, text, path in zip(ids, texts, decode(model, texts)):
                    for i, (line, p) in enumerate(zip(text.split("\n"), path)):
                        if line.strip():
                            docs.append(doc)
                            nos.append(i + 1)
                            labels.append(LABELS[p])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(nos, pa.int32()), pa.array(labels, pa.string())],
                    ["doc_id", "line_no", "label"],
                )

    return run


def label_lines(messages: DataFrame, model: dict[str, np.ndarray] | None = None) -> DataFrame:
    """``(doc_id, line_no, label)`` of every non-blank line of ``(doc_id, text)``.

    Lines are split at ``\\n`` and numbered from 1.  Null and empty texts have
    none; where no text is given at all the model stays empty.  Rows loaded
    twice give their lines twice.
    """
    ship_package(messages.sparkSession)
    model = train(messages) if model is None else model
    some = spread(messages.select("doc_id", "text")).where("text is not null and text <> '' and doc_id is not null")
    return some.mapInArrow(_label(model), "doc_id bigint, line_no int, label string")


def new_text(messages: DataFrame, model: dict[str, np.ndarray] | None = None) -> DataFrame:
    """``(doc_id, text)`` with only the new lines, one row per id.

    Runs of blank lines that a removed block leaves shrink to one; a text of
    which nothing is new becomes empty, null texts stay null.
    """
    ship_package(messages.sparkSession)
    model = train(messages) if model is None else model
    own = one_row_per_id(messages.select("doc_id", "text"), "doc_id")

    def keep(text: pd.Series) -> pd.Series:
        some = [t for t in text if t]
        paths = iter(decode(model, some) if some else [])
        out = []
        for t in text:
            if not t:
                out.append(t)
                continue
            kept: list[str] = []
            for line, p in zip(t.split("\n"), next(paths)):
                if not line.strip():
                    if kept and kept[-1].strip():
                        kept.append("")
                elif p == NEW:
                    kept.append(line)
            while kept and not kept[-1].strip():
                kept.pop()
            out.append("\n".join(kept))
        return pd.Series(out, dtype=object)

    keep.__annotations__ = {}
    return own.select("doc_id", F.pandas_udf(keep, "string")("text").alias("text"))
