"""Personal information inside free text, found and replaced by placeholders.

Method: bootstrapped contextual extraction.

1. *Candidates.*  Lexers mark every span that could be a mail address, a
   number, a postal address or a name, whatever it is in truth.  Each
   occurrence carries *instances* (what it looks like: the shape of a number,
   the word that ends a street, a given or family name) and *patterns* (the
   words around it, or the header it stands in).
2. *Seeds.*  Known names, and the entities of header lines whose meaning is
   known (sender, telephone, staff number, postal address).
3. *Graph.*  Occurrences are summed to edges (instance, pattern, count).  Spark
   scores patterns by the confidence of the instances they hold and instances
   by the confidence of the patterns that hold them, a fixed number of rounds.
4. *Extraction.*  Occurrences whose instances or patterns reached the
   threshold are personal information, though no seed ever named them.

What is *not* personal is a label of its own, seeded by header lines that hold
routes, message ids and dates.  It spreads over the same graph, so a shape is
trusted only if it is mostly seen in personal contexts, however many there are
by chance.  A shape also needs the support of a known context, or of several
learnt ones.

Edges are aggregated before any join, so a pattern or shape that a third of
all occurrences share is a single row per neighbour.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import one_row_per_id, ship_package, spread, stage

#: Rounds of scoring patterns and instances.
ROUNDS = 3
#: Confidence from which an instance or a pattern is trusted.
TRUSTED = 0.5
#: Occurrences that an unknown pattern or instance is assumed to have had in vain.
DOUBT = 0.5

#: Digits from which on a number may be personal; years, counts and times have fewer.
LEAST_DIGITS = 6
#: Header lines whose content is known: header -> what a number or address there is.
SEED_HEADERS = {
    "from": ("email", "person_name"),
    "reply-to": ("email", "person_name"),
    "sender": ("email", "person_name"),
    "x-phone": ("phone",),
    "x-fax": ("phone",),
    "x-staff-id": ("id_number",),
    "x-snail": ("street_address",),
}
#: Header lines whose mail-like and number-like words name no person.
PLAIN_HEADERS = (
    "path", "message-id", "references", "in-reply-to", "xref", "newsgroups", "nntp-posting-host", "date", "expires", "lines",
    "x-newsreader", "mime-version", "content-type", "content-length",
)
#: The label of what is no personal information.
PLAIN = "plain"
#: Shapes known without any header (9 a digit, A a capital).
SEED_SHAPES = {
    "phone": ("999-999-9999", "(999) 999-9999", "+9 999 999 9999"),
    "id_number": ("999-99-9999",),
    "email": ("@a", "@a.a"),
    "street_address": ("Street", "Road", "Lane", "Avenue", "P.O. Box"),
}
PLACEHOLDERS = {
    "email": "[EMAIL]",
    "phone": "[PHONE]",
    "id_number": "[ID_NUMBER]",
    "street_address": "[STREET_ADDRESS]",
    "person_name": "[PERSON_NAME]",
}


def _ranges(test) -> str:
    """A character class of the letters of Latin, Greek, Cyrillic and Armenian script that pass a test."""
    at = [c for c in range(0x590) if test(chr(c))]
    runs = [(a, b) for a, b in zip([c for c in at if c - 1 not in at], [c for c in at if c + 1 not in at])]
    return "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in runs)


_UP = _ranges(str.isupper)
_LOW = _ranges(str.islower)
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: What the part before the @ is made of, read backwards; what may not stand before it.
_LOCAL = re.compile(r"[\w.+-]*")
_NO_LOCAL_SET = frozenset("$%!@")
_LOCAL_FIRST = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")
_SPELT_HINT = re.compile(r"[(\[]\s?[aA][tT]\s?[)\]]|\s(?:dot|DOT)\s")
_SPELT = re.compile(
    r"(?<![\w.+$%!@-])[A-Za-z0-9_][\w.+-]*\s?[(\[]\s?(?:at|AT|At)\s?[)\]]\s?[A-Za-z0-9-]+"
    r"(?:(?:\.|\s?[(\[]\s?(?:dot|DOT)\s?[)\]]\s?|\s(?:dot|DOT)\s)[A-Za-z0-9-]+)+"
    r"|(?<![\w.+$%!@-])[A-Za-z0-9_][\w.+-]*\s(?:at|AT)\s[A-Za-z0-9-]+(?:\s(?:dot|DOT)\s[A-Za-z0-9-]+)+"
)
_BANG_HINT = re.compile(r"![\w.+-]*[A-Za-z0-9]")
_BANG = re.compile(r"(?<![\w.+$%!@-])[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?:![\w.+-]*[A-Za-z0-9])+(?![\w@!])")
_NUMBER = re.compile(
    r"(?=[A-Z\d+(])(?<![\w@.$+/<(-])(?:"
    r"[A-Z]{1,2} ?\d[\d ]{3,12}\d ?[A-Z]?(?![\w@])"
    r"|(?:\+\d{1,3}[ .-]?)?\(?\d[\d)]*(?:[ ./-]\(?\d[\d)]*|(?<=\)) ?\d+)*(?:-[A-Z])?(?: (?:x|ext\.? ?)\d{1,6})?(?![\w@])"
    r")"
)
_STREET = re.compile(rf"(?=\d)(?<![\w.,/-])(?P<no>\d{{1,5}}[a-z]?)(?P<way>(?: [{_UP}][\w'’-]*){{1,4}})(?P<dot>\.?)")
_UNIT = re.compile(r"(?<![\w.])(?:Apt|Unit|Suite|Flat|Apartment|No)\.? ?\w{1,5}, $")
_BOX = re.compile(r"(?<![\w.])P\.? ?O\.? ?Box \d+")
_STRASSE = re.compile(rf"(?<![\w.])[{_UP}][\w-]+(?: [{_UP}][\w-]+)? \d{{1,4}}[a-z]?(?=, \d{{4,5}} [{_UP}])")
_STRASSE_HINT = re.compile(rf"\d[a-z]?, \d{{4,5}} [{_UP}]")
_TOWN = re.compile(rf"(?P<code1>, \d{{4,5}} [{_UP}][\w-]*\w)?(?P<town>, [{_UP}][\w'’-]*\w)?(?P<code> \d{{4,6}}(?!\w))?")
_NAME = re.compile(
    rf"(?=[{_UP}])(?<![\w@.'’-])(?=(?P<a>[{_UP}][\w'’-]*[\w]|[{_UP}]\.)(?P<c>,?) (?P<m>(?:[{_UP}]\. ){{0,2}})(?P<b>[{_UP}][\w'’-]*\w|[{_UP}]\.(?! ?[{_UP}]\.))(?![\w@]))"
)
_AROUND = re.compile(r"\n|[\w'’.-]*\w|[^\w\s]")
_LOWER = re.compile(rf"(?=[{_LOW}])(?<![\w@.'’-])(?=(?P<a>[{_LOW}][\w'’-]*\w|[{_LOW}]\.)(?P<c>,?) (?P<b>[{_LOW}][\w'’-]*\w|[{_LOW}]\.(?! ?[{_LOW}]\.))(?![\w@]))")
#: Names of a lexicon are looked for as whole words of letters and digits.
_BLANKED = {i: " " for i in range(128) if not chr(i).isalnum()}
_WRAP = re.compile(r"(?<=[a-zà-ÿ,;])\n(?=[^\n]|$)")
_DIGITS = re.compile(r"\d+")
_HEADER = re.compile(r"^([A-Za-z][A-Za-z-]*):", re.M)

_CANDIDATES = (
    "doc_id bigint, field string, start int, stop int, surface string, lexer string, "
    "one string, two string, near string, wide string"
)


def _norm(token: str) -> str:
    if token == "\n":
        return "¶"
    if "@" in token:
        return "@"
    if "." in token[1:-1]:
        return "host"
    return _DIGITS.sub("0", token.lower())


def _context(text: str, start: int, stop: int) -> tuple[str, str]:
    """The two tokens before (near), and those with the one behind (wide)."""
    width = 40
    while True:
        low = max(0, start - width)
        found = _AROUND.findall(_WRAP.sub(" ", text[low:start]))
        if len(found) > 2 or not low:  # the first of a cut stretch may be part of a token
            break
        width *= 4
    left = [_norm(t) for t in found[-2:]]
    if start == 0 or len(left) < 2:
        left = (["¶", *left])[-2:]
    right = _AROUND.search(text, stop)
    behind = "¶" if right is None else _norm(right.group())
    near = " ".join(left)
    return near, f"{near} _ {behind}"


def _shape(number: str) -> str:
    """Digits as 9 (a run of more than twenty as ``9+``), capitals as A, an extension as x9."""
    digits = re.sub(r"\d", "9", re.sub(r"(?:x|ext\.? ?)\d+$", "x9", number))
    return re.sub(r"9{21,}", "9+", re.sub(r"[A-Z]", "A", digits))


def _mail_shape(mail: str) -> str:
    low = re.sub(r"\s+", " ", mail)
    if "@" in low:
        local = low.partition("@")[0]
        mixed = local.upper() != local and local.lower() != local
        if mixed:
            local = re.sub(r"[A-Z]+", "X", local)
        return "@" + re.sub(r"[a-z]+", "a", re.sub(r"\d+", "0", local if mixed else local.lower()))
    if "!" in low:
        # the last part is a mailbox, whatever points it has
        return "!" + ("route" if "." in low.rpartition("!")[0] else "relay")
    return "at " + ("dot" if re.search(r"dot", low, re.I) else "plain") + ("(" if "(" in low else "[" if "[" in low else "")


def _mails(text: str) -> list[tuple[int, int]]:
    """Spans that may be mail addresses, however they are written."""
    out = []
    at, turned = text.find("@"), ""
    if at >= 0:
        turned, n = text[::-1], len(text)
    while at >= 0:
        # the whole local part, however long, from the @ backwards
        local = _LOCAL.match(turned, n - at).group()[::-1]
        start = at - len(local.lstrip(".+-"))
        before = text[at - len(local) - 1 : at - len(local)]
        domain = _DOMAIN.match(text, at + 1)
        if domain and start < at and before not in _NO_LOCAL_SET and text[start] in _LOCAL_FIRST:
            out.append((start, domain.end()))
        at = text.find("@", at + 1)
    if _SPELT_HINT.search(text):
        out += [m.span() for m in _SPELT.finditer(text)]
    if _BANG_HINT.search(text):
        out += [m.span() for m in _BANG.finditer(text)]
    return out


def _addresses(text: str) -> list[tuple[int, int, str, str]]:
    """Spans that may be postal addresses, with the word that ends the street (with and without a point)."""
    out = []
    for m in _STREET.finditer(text):
        words, dot = m["way"].split(), m["dot"]
        rest = _TOWN.match(text, m.end())
        if len(words) < 2 and not rest["town"]:
            continue
        unit = _UNIT.search(text, max(0, m.start() - 24), m.start())
        out.append((unit.start() if unit else m.start(), rest.end(), words[-1] + dot, words[-1]))
    if "Box " in text:
        out += [(m.start(), _TOWN.match(text, m.end()).end(), "P.O. Box", "") for m in _BOX.finditer(text)]
    if _STRASSE_HINT.search(text):
        out += [(m.start(), _TOWN.match(text, m.end()).end(), "9, 99999 Town", "") for m in _STRASSE.finditer(text)]
    return out


def candidates_in(text: str, headers: bool = False, lexicon: frozenset[str] = frozenset()) -> list[tuple]:
    """Every candidate of a text: (start, stop, surface, lexer, one, two, near, wide).

    Pairs of words in lower case are candidates where one of them is in
    ``lexicon``; they teach nothing, as most such words are no names.
    """
    found = []
    marks: list[tuple[int, str]] = []
    if headers:
        marks = [(m.start(), m.group(1).lower()) for m in _HEADER.finditer(text)]

    def around(start: int, stop: int) -> tuple[str, str]:
        near, wide = _context(text, start, stop)
        if headers:
            name = ""
            for at, header in marks:
                if at > start:
                    break
                name = header
            return f"H:{name}", f"H:{name} {wide}"
        return near, wide

    taken: list[tuple[int, int]] = []
    for s, e in _mails(text):
        mail = text[s:e]
        found.append((s, e, mail, "mail", _mail_shape(mail), "", *around(s, e)))
        taken.append((s, e))
    for s, e, one, two in _addresses(text):
        found.append((s, e, text[s:e], "postal", one, two, *around(s, e)))
        taken.append((s, e))
    for m in _NUMBER.finditer(text):
        s, e = m.span()
        surface = m.group()
        digits = sum(c.isdigit() for c in surface)
        if surface.count("(") != surface.count(")"):
            surface = surface.rstrip(")") if surface.count(")") > surface.count("(") else surface
            e = s + len(surface)
        if digits < LEAST_DIGITS:
            continue
        if any(a < e and s < b for a, b in taken):
            continue
        found.append((s, e, surface, "number", _shape(surface), "", *around(s, e)))
    for m in _NAME.finditer(text):
        a, b = m["a"], m["b"]
        s, e = m.start("a"), m.end("b")
        if len(a) == 2 and len(b) == 2 and a[1] == b[1] == ".":
            continue
        if a.isupper() != b.isupper() and not (a[-1] == "." or b[-1] == "."):
            continue
        if b[-1] == "." and not m["c"]:
            continue
        found.append((s, e, text[s:e], "name" if not m["c"] else "name,", a.casefold(), b.casefold(), *around(s, e)))
    if lexicon and not lexicon.isdisjoint(text.translate(_BLANKED).split()):
        for m in _LOWER.finditer(text):
            a, b = m["a"], m["b"]
            if a in lexicon or b in lexicon:
                s, e = m.start("a"), m.end("b")
                found.append((s, e, text[s:e], "lower" + m["c"], a, b, "", ""))
    return found


def _lex(fields: list[str], lexicon: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            ids = batch.column(0).to_pylist()
            for i, field in enumerate(fields):
                for doc, text in zip(ids, batch.column(i + 1).to_pylist()):
                    if text:
                        rows += [(doc, field, *c) for c in candidates_in(text, field == "headers", lexicon)]
            cols = list(zip(*rows)) if rows else [[]] * 10
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), *[pa.string()] * 6]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds)],
                ["doc_id", "field", "start", "stop", "surface", "lexer", "one", "two", "near", "wide"],
            )

    return run


#: Names of a lexicon that lexers take along, at most; a larger one is an error.
LEXICON = 1_000_000


def _known(names: DataFrame) -> frozenset[str]:
    """The names of a lexicon in lower case, a list of bounded size."""
    rows = names.where("name is not null and kind in ('given', 'family')").select(F.lower("name").alias("n")).distinct().limit(LEXICON + 1).collect()
    if len(rows) > LEXICON:
        raise ValueError(f"a lexicon has more than {LEXICON} names")
    return frozenset(r["n"] for r in rows)


def candidates(records: DataFrame, fields: list[str], names: DataFrame | None = None) -> DataFrame:
    """All candidates of ``(doc_id, *fields)``; null fields have none.

    Words in lower case are looked at where ``names`` lists one of them.
    """
    ship_package(records.sparkSession)
    lexicon = frozenset() if names is None else _known(names)
    own = spread(records.select("doc_id", *fields)).where("doc_id is not null")
    return own.mapInArrow(_lex(fields, lexicon), _CANDIDATES)


def _instances(c: DataFrame) -> DataFrame:
    """One row per candidate and instance: ``lexer, role, inst, near, wide``.

    A name has two: the token that comes first and the one that comes second
    (told apart as given and family by the comma).
    """
    name = F.col("lexer").startswith("name")
    comma = F.col("lexer") == "name,"
    roles = F.when(
        name,
        F.array(
            F.struct(F.lit("given").alias("role"), F.when(comma, F.col("two")).otherwise(F.col("one")).alias("inst")),
            F.struct(F.lit("family").alias("role"), F.when(comma, F.col("one")).otherwise(F.col("two")).alias("inst")),
        ),
    ).otherwise(F.array(F.struct(F.col("lexer").alias("role"), F.col("one").alias("inst"))))
    partner = F.when(
        name,
        F.array(
            F.concat(F.lit("with "), F.when(comma, F.col("one")).otherwise(F.col("two"))),
            F.concat(F.lit("with "), F.when(comma, F.col("two")).otherwise(F.col("one"))),
        ),
    )
    return (
        c.where(~F.col("lexer").startswith("lower")).select("near", "wide", F.posexplode(roles).alias("_i", "_r"), partner.alias("_p"))
        .select(
            F.col("_r.role").alias("role"),
            F.col("_r.inst").alias("inst"),
            F.array_compact(F.array("near", "wide", F.get("_p", F.col("_i")))).alias("pats"),
        )
        .where(F.length("inst") > F.when(F.col("role").isin("given", "family"), 2).otherwise(0))
    )


#: What each role may turn out to be.
_LABELS = {"mail": ("email", PLAIN), "number": ("phone", "id_number", PLAIN), "postal": ("street_address",), "given": ("person_name",), "family": ("person_name",)}


def bootstrap(c: DataFrame, names: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Score instances and patterns: ``(role, inst, label, conf)``, ``(role, pat, label, conf)``.

    ``c`` are candidates (a stage table), ``names`` is ``(name, kind)`` with
    ``kind`` ``given`` or ``family``.  Header lines with a known meaning keep
    the labels they are given; a shape needs the trust of contexts that add up
    to one at least, that is one known or two learnt.
    """
    spark = c.sparkSession
    edges = stage(
        _instances(c).select("role", "inst", F.explode("pats").alias("pat")).groupBy("role", "inst", "pat").agg(F.count(F.lit(1)).alias("n")),
        "pii-edges",
    )
    shapes = [(role, shape, label, 1.0) for role, labels in _LABELS.items() for label in labels for shape in SEED_SHAPES.get(label, ())]
    known = names.where("name is not null and kind in ('given', 'family')").select(
        F.col("kind").alias("role"), F.lower("name").alias("inst"), F.lit("person_name").alias("label"), F.lit(1.0).alias("conf")
    ).distinct()
    seeds = spark.createDataFrame(shapes, "role string, inst string, label string, conf double").unionByName(known)
    headers = [
        (role, f"H:{header}", label, 1.0)
        for header, labels in SEED_HEADERS.items()
        for label in labels
        for role, may in _LABELS.items()
        if label in may and label != "person_name"
    ] + [(role, f"H:{header}", PLAIN, 1.0) for header in PLAIN_HEADERS for role in ("mail", "number")]
    fixed = spark.createDataFrame(headers, "role string, pat string, label string, conf double")
    inst = seeds
    pats = fixed
    weight = edges.groupBy("role", "pat").agg(F.sum("n").alias("all"))
    size = edges.groupBy("role", "inst").agg(F.sum("n").alias("all"))
    for i in range(rounds):
        held = edges.join(inst, ["role", "inst"]).groupBy("role", "pat", "label").agg(F.sum(F.col("n") * F.col("conf")).alias("good"))
        learnt = held.join(weight, ["role", "pat"]).select("role", "pat", "label", (F.col("good") / (F.col("all") + DOUBT)).alias("conf"))
        pats = learnt.join(F.broadcast(fixed.select("role", "pat").distinct()), ["role", "pat"], "left_anti").unionByName(fixed)
        strong = pats.where(F.col("conf") >= TRUSTED)
        seen = edges.join(strong, ["role", "pat"]).groupBy("role", "inst", "label").agg(
            F.sum(F.col("n") * F.col("conf")).alias("good"),
            F.max("conf").alias("best"),
            F.sum(F.when(~F.contains("pat", F.lit(" _ ")), F.col("conf")).otherwise(0.0)).alias("support"),
        )
        told = Window.partitionBy("role", "inst")
        grown = (
            seen.join(size, ["role", "inst"])
            .withColumn("known", F.sum("good").over(told))
            .withColumn(
                "share",
                F.when(F.col("role").isin("given", "family"), 1.5 * F.col("good") / (F.col("all") + DOUBT)).otherwise(
                    F.col("good") / (F.col("known") + DOUBT)
                ),
            )
            .where(F.col("role").isin("given", "family") | (F.col("support") >= 1.0))
            .select("role", "inst", "label", F.least(F.col("best"), F.col("share")).alias("conf"))
        )
        inst = stage(
            grown.unionByName(seeds).groupBy("role", "inst", "label").agg(F.max("conf").alias("conf")).where("conf > 0.05"),
            "pii-instances",
        )
        if i == rounds - 1:
            pats = stage(pats.where("conf > 0.05"), "pii-patterns")
    return inst, pats


def _judged_names(c: DataFrame, inst: DataFrame, pats: DataFrame) -> DataFrame:
    """Candidates of names with the confidence that they are names.

    Names are judged once for each distinct pair of tokens, however often it
    occurs, and the verdict is joined back; only contexts that could change a
    verdict are looked up.
    """
    own = c.where(F.col("lexer").startswith("name") | F.col("lexer").startswith("lower"))
    known = inst.where("label = 'person_name'")
    pairs = own.groupBy("lexer", "one", "two").agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    for token in ("one", "two"):
        roles = known.groupBy(F.col("inst").alias(token)).agg(
            *[F.max(F.when(F.col("role") == r, F.col("conf"))).alias(f"_{token}_{r}") for r in ("given", "family")]
        )
        pairs = pairs.join(roles, token, "left")
    z = lambda col: F.coalesce(F.col(col), F.lit(0.0))
    one_initial, two_initial = F.col("one").rlike(r"^\w\.$"), F.col("two").rlike(r"^\w\.$")
    straight = F.when(one_initial, z("_two_family")).otherwise(F.least(z("_one_given"), z("_two_family")))
    turned = F.when(two_initial, z("_one_family")).otherwise(F.least(z("_one_family"), z("_two_given")))
    # a token speaks for its place only where it is not better known in the other one
    rather = lambda mine, other: F.when(z(mine) >= z(other), z(mine)).otherwise(0.0)
    either = F.when(F.col("lexer").endswith(","), F.greatest(rather("_one_family", "_one_given"), rather("_two_given", "_two_family"))).otherwise(
        F.greatest(rather("_one_given", "_one_family"), rather("_two_family", "_two_given"))
    )
    judged = pairs.select("lexer", "one", "two", F.greatest(straight, turned).alias("_known"), either.alias("_either"))
    wide = pats.where("role = 'given' and label = 'person_name' and conf >= 0.25").select(F.col("pat").alias("wide"), F.col("conf").alias("_wide"))
    n = own.join(judged, ["lexer", "one", "two"]).join(wide, "wide", "left")
    by_context = F.when(F.col("_either") >= TRUSTED, F.sqrt(z("_wide") * F.col("_either"))).otherwise(z("_wide") - 0.25)
    return n.withColumn("conf", F.when(F.col("lexer").startswith("lower"), F.col("_known")).otherwise(F.greatest("_known", by_context)))


def decide(c: DataFrame, inst: DataFrame, pats: DataFrame) -> DataFrame:
    """The candidates that are personal information, with ``kind`` and ``conf``."""
    keep = ["doc_id", "field", "start", "stop", "surface"]
    best = (
        inst.groupBy("role", "inst").agg(F.max_by("label", "conf").alias("kind"), F.max("conf").alias("_ic"))
        .where((F.col("_ic") >= TRUSTED) & (F.col("kind") != PLAIN))
    )
    shaped = (
        c.where(F.col("lexer").isin("mail", "number"))
        .join(best, (F.col("lexer") == F.col("role")) & (F.col("one") == F.col("inst")))
        .select(*keep, "kind", F.col("_ic").alias("conf"))
    )
    ways = best.where("role = 'postal'").select(F.col("inst").alias("_w"), F.col("_ic").alias("_wc"))
    postal = c.where("lexer = 'postal'")
    dotted = F.col("one").endswith(".") & (F.col("two") != "")
    postal = (
        postal.join(ways, F.col("one") == F.col("_w"), "left").withColumnsRenamed({"_w": "_w1", "_wc": "_c1"})
        .join(ways, (F.col("two") == F.col("_w")) & dotted, "left")
        .where("_c1 is not null or _wc is not null")
    )
    bare = F.col("_c1").isNull() & F.col("surface").endswith(".")
    postal = postal.select(
        "doc_id",
        "field",
        "start",
        F.when(bare, F.col("stop") - 1).otherwise(F.col("stop")).alias("stop"),
        F.when(bare, F.expr("substring(surface, 1, length(surface) - 1)")).otherwise(F.col("surface")).alias("surface"),
        F.lit("street_address").alias("kind"),
        F.coalesce("_c1", "_wc").alias("conf"),
    )
    n = _judged_names(c, inst, pats).where(F.col("conf") >= TRUSTED).select(*keep, F.lit("person_name").alias("kind"), "conf")
    return shaped.select(*keep, "kind", "conf").unionByName(postal).unionByName(n)


_ORDER = {"email": 0, "phone": 1, "id_number": 1, "street_address": 2, "person_name": 3}


def _apart(spans: list) -> list:
    """Spans that do not overlap; surer kinds, then higher confidence, win."""
    out: list = []
    for s in sorted(spans, key=lambda x: (_ORDER[x["kind"]], -x["conf"], x["start"])):
        if all(s["stop"] <= o["start"] or s["start"] >= o["stop"] for o in out):
            out.append(s)
    return sorted(out, key=lambda x: x["start"])


_SPAN = "array<struct<start int, stop int, kind string, surface string, conf double>>"


def _disjoint(spans):
    return spans.map(lambda s: [dict(x) for x in _apart(list(s))])


def find(records: DataFrame, names: DataFrame, fields: list[str], rounds: int = ROUNDS) -> DataFrame:
    """Personal information in ``(doc_id, *fields)``.

    Result: ``doc_id, field, start, stop, kind, surface``, spans of a field
    apart from one another, offsets in characters from 0.  Null and empty
    fields give no rows; rows repeated with the same id and text give their
    spans once.  Columns of ``records`` other than those named are ignored.
    """
    c = stage(candidates(records, fields, names), "pii-candidates")
    inst, pats = bootstrap(c, names, rounds)
    hits = decide(c, inst, pats)
    grouped = hits.groupBy("doc_id", "field").agg(
        F.collect_set(F.struct("start", "stop", "kind", "surface", "conf")).alias("spans")
    )
    grouped = grouped.withColumn("spans", F.array_sort("spans"))
    pairs = F.zip_with("spans", F.slice("spans", 2, F.size("spans")), lambda x, y: x["stop"] > y["start"])
    grouped = grouped.withColumn("_meet", F.exists(pairs, lambda x: F.coalesce(x, F.lit(False))))
    # spans that overlap are few; only their fields leave the JVM
    apart = grouped.where("not _meet").select("doc_id", "field", "spans")
    freed = grouped.where("_meet").select("doc_id", "field", F.pandas_udf(_disjoint, _SPAN)("spans").alias("spans"))
    return apart.unionByName(freed).select("doc_id", "field", F.explode("spans").alias("s")).select(
        "doc_id", "field", "s.start", "s.stop", "s.kind", "s.surface"
    )


def _replace(text, spans):
    def one(t, found):
        if t is None or found is None or not len(found):
            return t
        out, at = [], 0
        for s in sorted(found, key=lambda x: x["start"]):
            out += [t[at : s["start"]], PLACEHOLDERS[s["kind"]]]
            at = s["stop"]
        return "".join([*out, t[at:]])

    return pd.Series([one(t, s) for t, s in zip(text, spans)])


def redact(records: DataFrame, names: DataFrame, fields: list[str], rounds: int = ROUNDS) -> DataFrame:
    """``(doc_id, *fields)`` with placeholders in place of what :func:`find` found.

    One row per id; everything else in the text stays as it was.
    """
    spans = stage(find(records, names, fields, rounds), "pii-spans")
    per_doc = spans.groupBy("doc_id").agg(
        *[
            F.collect_list(F.when(F.col("field") == f, F.struct("start", "stop", "kind"))).alias(f"_s{i}")
            for i, f in enumerate(fields)
        ]
    )
    own = one_row_per_id(records.select("doc_id", *fields), "doc_id")
    replace = F.pandas_udf(_replace, "string")
    return own.join(per_doc, "doc_id", "left").select(
        "doc_id", *[replace(F.col(f), F.col(f"_s{i}")).alias(f) for i, f in enumerate(fields)]
    )
