"""Analysis of given texts, for what the test tables hold no example of.

Each case is a text column of literal rows, a way to analyse it, and the tokens
that must come out; the SQL of such a query is the list of these tokens.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..analysis import analyser as an
from ..analysis import filters, stemmers, streams, tokenisers

Tokens = Callable[[Column], Column]

_HUNSPELL = stemmers.Hunspell("SFX S Y 1\nSFX S 0 s .\nSFX G Y 1\nSFX G e ing e\nPFX U Y 1\nPFX U 0 un .\n", "3\nlock/US\nmove/G\nrow\n")
_LEXICON = ["run", "nation", "hope", "form", "compute", "leaf", "corpus", "happy", "quiz"]


def _words(f: Tokens) -> Tokens:
    return lambda text: f(tokenisers.whitespace(text))


def _terms(placed: Tokens) -> Tokens:
    """Terms of what puts several at a position."""
    return lambda text: F.transform(placed(tokenisers.whitespace(text)), lambda t: t["term"])


def _stream(source: streams.Source, *steps: streams.Filter) -> Tokens:
    return an.streamed(source, *steps).terms


#: name -> (how, {text: tokens})
CASES: dict[str, tuple[Callable[[], Tokens], dict[str, list[str]]]] = {
    # M. F. Porter, 1980, the examples of each step
    "filter_porter_examples": (lambda: _words(filters.stem(stemmers.porter)), {
        "caresses ponies ties caress cats": ["caress", "poni", "ti", "caress", "cat"],
        "feed agreed plastered bled motoring sing": ["feed", "agre", "plaster", "bled", "motor", "sing"],
        "conflated troubled sized hopping falling hissing fizzed failing filing": ["conflat", "troubl", "size", "hop", "fall", "hiss", "fizz", "fail", "file"],
        "happy sky": ["happi", "sky"],
        "relational conditional rational valenci digitizer operator feudalism decisiveness": ["relat", "condit", "ration", "valenc", "digit", "oper", "feudal", "decis"],
        "triplicate formative formalize electrical hopeful goodness": ["triplic", "form", "formal", "electr", "hope", "good"],
        "revival allowance inference airliner adjustable replacement adoption homologou effective": ["reviv", "allow", "infer", "airlin", "adjust", "replac", "adopt", "homolog", "effect"],
        "probate rate cease controll roll": ["probat", "rate", "ceas", "control", "roll"],
    }),
    # D. Harman's S-stemmer with Porter's step 1b, and -ness, -ment, -ly
    "filter_light_english_examples": (lambda: _words(filters.stem(stemmers.light_english)), {
        "ponies skies cats glass bus zombies": ["pony", "sky", "cat", "glass", "bus", "zomby"],
        "stopped agreed hoping running sing": ["stop", "agree", "hope", "run", "sing"],
        "darkness payment slowly": ["dark", "pay", "slow"],
    }),
    "filter_lexicon_examples": (lambda: _words(filters.stem(stemmers.lexicon_stemmer(_LEXICON))), {
        "running hoping went zzzs corpus children": ["run", "hope", "go", "zzzs", "corpus", "child"],
        "leaves nations happiness computing": ["leaf", "nation", "happy", "compute"],
    }),
    "filter_german_stems": (lambda: _words(filters.stem(stemmers.stemmer("de"))), {"bedeutungen freundlichen kinder": ["bedeut", "freu", "kind"]}),
    "filter_french_stems": (lambda: _words(filters.stem(stemmers.stemmer("fr"))), {"nationaux parlerons chats": ["national", "parl", "chats"]}),
    "filter_spanish_stems": (lambda: _words(filters.stem(stemmers.stemmer("es"))), {"hablando nacionalidades casas": ["habl", "nacional", "cas"]}),
    "filter_arabic_stems": (lambda: _words(filters.stem(stemmers.stemmer("ar"))), {"المعلمون": ["معلم"]}),
    # L. Philips, 1990
    "filter_metaphone_examples": (lambda: _terms(filters.metaphone(inject=False)), {
        "knight night phone wrack xenon": ["NT", "NT", "FN", "RK", "SNN"],
        "thumb school science badge quick": ["0M", "SKL", "SNS", "BJ", "KK"],
        "whale nation vision": ["WL", "NXN", "FXN"],
    }),
    "filter_phonetic_alternates": (lambda: _terms(filters.phonetic_alternates(inject=True)), {"Schwarz": ["Schwarz", "SKWRS", "XWRS", "SKFRS"]}),
    "filter_hunspell": (lambda: _terms(filters.hunspell(_HUNSPELL)), {"unlocks moving locks rows": ["lock", "move", "lock", "rows"]}),
    "tokens_thai": (lambda: tokenisers.thai(["กา", "กาแฟ", "ดี"]), {"กาแฟกาดี ok": ["กาแฟ", "กา", "ดี", "ok"]}),
    "tokens_cjk_examples": (lambda: tokenisers.cjk_bigram, {"漢字仮 abc 字": ["漢字", "字仮", "abc", "字"], "東京 カタカナ 한국어": ["東京", "カタ", "タカ", "カナ", "한국", "국어"]}),
    "tokens_mediawiki_examples": (lambda: tokenisers.mediawiki, {
        "'''Bold''' [[a|link text]] == Head == [[Category:Sea charts]] ''soft'' [http://x.example out side]": ["Bold", "link", "text", "Head", "Sea", "charts", "soft", "out", "side"],
    }),
    "filter_classic_examples": (lambda: _words(filters.classic), {"U.S.A. dog's cats' A. IBM’s": ["USA", "dog", "cats'", "A.", "IBM"]}),
    "filter_decimal_digit_examples": (lambda: _words(filters.decimal_digits), {"٣٤ १२ ７ 5x ๙": ["34", "12", "7", "5x", "9"]}),
    "filter_hyphenated_examples": (lambda: _stream(streams.whitespace, streams.word_delimiter(by_case=False), streams.hyphenated), {"one_two three four/five/six": ["one-two", "three", "four-five-six"]}),
    "filter_common_gram_examples": (lambda: _stream(streams.whitespace, streams.common_grams(["of", "the", "to"])), {"the end of the sea to": ["the", "end", "of", "of_the", "the", "sea", "to"]}),
    "filter_word_delimiter_examples": (lambda: _terms(filters.word_delimiter()), {"Wi-Fi2Go's POWERShot plain": ["Wi", "Fi", "2", "Go", "POWER", "Shot", "plain"]}),
    "filter_types": (lambda: _stream(streams.uax29, streams.of_type(["url", "email", "hashtag"])), {"see http://x.example/a or a.b@c.example #tag 42": ["http://x.example/a", "a.b@c.example", "#tag"]}),
    "filter_types_dropped": (lambda: _stream(streams.uax29, streams.of_type(["number", "word"], drop=True)), {"see http://x.example/a @me 42": ["http://x.example/a", "@me"]}),
    "filter_unique": (lambda: _stream(streams.whitespace, streams.synonyms({"a": ["b", "b", "a"]}), streams.unique), {"a c a": ["a", "b", "c", "a", "b"]}),
    "filter_keyword_marker": (lambda: _words(filters.mark_keywords(["Cats"], filters.lowercase)), {"Cats Dogs": ["Cats", "dogs"]}),
    "filter_flatten": (lambda: _stream(streams.whitespace, streams.synonyms({"new york": ["ny"]}), streams.flatten), {"in new york": ["in", "new", "ny", "york"]}),
    "filter_elision_examples": (lambda: _words(filters.elision()), {"l'avion qu’il d'or jusqu'ici aujourd'hui": ["avion", "il", "or", "ici", "aujourd'hui"]}),
    "analyse_keyword": (lambda: an.keyword().terms, {"One  two.": ["One  two."]}),
    "analyse_whitespace": (lambda: an.whitespace().terms, {"One  two.\tThree": ["One", "two.", "Three"]}),
    "analyse_simple": (lambda: an.simple().terms, {"One2two THREE": ["one", "two", "three"]}),
    "analyse_icu": (lambda: an.icu().terms, {"It's well-known, v1.2!": ["it's", "well-known", "v1.2"]}),
    "analyse_stemmed": (lambda: an.stemmed().terms, {"The running of the foxes": ["run", "fox"]}),
    "analyse_light": (lambda: an.with_stemmer(stemmers.light_english).terms, {"The ponies stopped": ["pony", "stop"]}),
    "analyse_by_language": (lambda: an.language("fr").terms, {"les chats parlerons": ["chats", "parl"]}),
    "analyse_chinese": (lambda: an.language("zh").terms, {"漢字仮": ["漢字", "字仮"]}),
}


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    how, texts = CASES[name]

    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
        return rows.select("doc_id", F.posexplode(how()(F.col("text"))).alias("pos", "term"))

    run.__name__ = name
    return run


def _values(name: str) -> str:
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    rows = [f"({i}, {p}, {quoted(t)})" for i, tokens in enumerate(CASES[name][1].values()) for p, t in enumerate(tokens)]
    return f"select cast(d as bigint) as doc_id, cast(p as int) as pos, t as term from (values {', '.join(rows)}) as v(d, p, t)"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(name) for name in CASES}


def oracle_sql() -> dict[str, str]:
    return {name: _values(name) for name in CASES}
