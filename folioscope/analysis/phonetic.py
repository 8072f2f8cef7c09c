"""Phonetic codes of words and names."""

from __future__ import annotations

import re
import unicodedata

# Spelling variants of names, tried in this order.
VARIANTS = [("sch", "sk"), ("sch", "sh"), ("w", "v"), ("j", "y"), ("cz", "ts"), ("cz", "ch"), ("ph", "f"), ("tz", "ts"), ("kh", "h")]

#: L. Philips, Hanging on the Metaphone, 1990, as substitutions in turn.  What a rule puts
#: in is in lower case, so that no later rule takes it for a letter of the word.
_RULES = [
    (re.compile(pattern), code)
    for pattern, code in [
        (r"([ABD-Z])\1+", r"\1"),  # doubled letters count once, C apart
        (r"^[KGP](?=N)|^A(?=E)|^W(?=R)", ""),  # silent at the start
        (r"^X", "s"),
        (r"^WH", "w"),
        (r"(?<=M)B$", ""),
        (r"TCH", "x"),
        (r"SCH", "sk"),
        (r"(?<=S)C(?=[IEY])", ""),
        (r"CH|C(?=IA)", "x"),
        (r"C(?=[IEY])", "s"),
        (r"CK|C|Q", "k"),
        (r"DG(?=[IEY])", "j"),
        (r"GH(?=[^AEIOU])", ""),  # neither at the end nor before a vowel
        (r"G(?=N$|NED$)", ""),
        (r"G(?=[IEY])", "j"),
        (r"GH?", "k"),
        (r"PH", "f"),
        (r"SH|S(?=I[OA])", "x"),
        (r"TH", "0"),
        (r"T(?=I[OA])", "x"),
        (r"(?<=[AEIOU])H(?![AEIOU])", ""),
        (r"[WY](?![AEIOU])", ""),
        (r"D", "t"),
        (r"V", "f"),
        (r"X", "ks"),
        (r"Z", "s"),
        (r"(?<=.)[AEIOU]", ""),  # vowels are heard at the start only
    ]
]


def fold(text: str) -> str:
    """Strip combining marks after canonical decomposition."""
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn"))


def metaphone(word: str) -> str:
    """The Metaphone code of a word; empty where it has no Latin letter."""
    code = re.sub(r"[^A-Z]", "", fold(word).upper())
    for pattern, made in _RULES:
        code = pattern.sub(made, code)
    return code.upper()


def name_codes(word: str, most: int = 4) -> list[str]:
    """Codes of up to ``most`` spelling variants of a name."""
    seed = fold(word).lower()
    if not seed.strip():
        return []
    forms = [seed]
    for form in forms:
        for old, new in VARIANTS:
            made = form.replace(old, new)
            if len(forms) < most and made not in forms:
                forms.append(made)
    codes = [metaphone(f) for f in forms]
    return list(dict.fromkeys(c for c in codes if c))[:most]
