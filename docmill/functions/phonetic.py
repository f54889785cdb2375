"""Phonetic codes.

Codes that follow from replacements stay in the JVM: letters are replaced, mapped to digits by translate(), runs are
collapsed by a regular expression. Metaphone and NYSIIS look at the letters around each letter and change several at
once; they are ordered pattern tables applied in one pass by an Arrow function.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .registry import named
from .strings import known
from .values import TEXT, Value

Steps = list[tuple[str, str]]
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


# Fixed values, by language: accents and letters to plain letters, spellings to sounds, in order, and the digit of each letter.
ACCENTS: dict[str, Steps] = {
    "fr": [
        ("É", "E"), ("È", "E"), ("Ê", "E"), ("Ë", "E"), ("À", "A"), ("Â", "A"), ("Ä", "A"), ("Î", "I"), ("Ï", "I"), ("Ô", "O"), ("Ö", "O"), ("Ù", "U"),
        ("Û", "U"), ("Ü", "U"), ("Ç", "S"), ("Œ", "OE"), ("Æ", "AE"),
    ],
    "es": [
        ("Á", "A"), ("É", "E"), ("Í", "I"), ("Ó", "O"), ("Ú", "U"), ("Ü", "U"), ("Ñ", "NY"),
    ],
    "it": [
        ("À", "A"), ("È", "E"), ("É", "E"), ("Ì", "I"), ("Ò", "O"), ("Ù", "U"),
    ],
    "pt": [
        ("Á", "A"), ("À", "A"), ("Â", "A"), ("Ã", "AN"), ("É", "E"), ("Ê", "E"), ("Í", "I"), ("Ó", "O"), ("Ô", "O"), ("Õ", "ON"), ("Ú", "U"), ("Ü", "U"),
        ("Ç", "S"),
    ],
    "nl": [
        ("IJ", "Y"), ("Ë", "E"), ("Ï", "I"), ("É", "E"),
    ],
    "el": [
        ("ΟΥ", "U"), ("ΑΥ", "AV"), ("ΕΥ", "EV"), ("ΑΙ", "E"), ("ΕΙ", "I"), ("ΟΙ", "I"), ("ΥΙ", "I"), ("ΜΠ", "B"), ("ΝΤ", "D"), ("ΓΚ", "G"), ("ΓΓ", "NG"),
        ("ΤΣ", "TS"), ("ΤΖ", "DZ"), ("Α", "A"), ("Ά", "A"), ("Β", "V"), ("Γ", "G"), ("Δ", "D"), ("Ε", "E"), ("Έ", "E"), ("Ζ", "Z"), ("Η", "I"), ("Ή", "I"),
        ("Θ", "TH"), ("Ι", "I"), ("Ί", "I"), ("Ϊ", "I"), ("Κ", "K"), ("Λ", "L"), ("Μ", "M"), ("Ν", "N"), ("Ξ", "KS"), ("Ο", "O"), ("Ό", "O"), ("Π", "P"),
        ("Ρ", "R"), ("Σ", "S"), ("Τ", "T"), ("Υ", "I"), ("Ύ", "I"), ("Ϋ", "I"), ("Φ", "F"), ("Χ", "CH"), ("Ψ", "PS"), ("Ω", "O"), ("Ώ", "O"),
    ],
}
SOUNDS: dict[str, Steps] = {
    "fr": [
        ("EAU", "O"), ("AU", "O"), ("OU", "U"), ("OI", "WA"), ("CH", "S"), ("SCH", "S"), ("SH", "S"), ("GN", "N"), ("PH", "F"), ("QU", "K"), ("CK", "K"),
        ("CC", "K"), ("GU", "G"), ("GA", "KA"), ("GO", "KO"), ("GY", "JI"), ("CE", "SE"), ("CI", "SI"), ("CY", "SY"), ("C", "K"), ("AN", "1"), ("AM", "1"),
        ("EN", "1"), ("EM", "1"), ("IN", "2"), ("IM", "2"), ("AIN", "2"), ("EIN", "2"), ("ON", "3"), ("OM", "3"), ("UN", "4"), ("UM", "4"),
    ],
    "es": [
        ("CH", "X"), ("LL", "Y"), ("RR", "R"), ("QU", "K"), ("GU", "G"), ("CE", "SE"), ("CI", "SI"), ("CY", "SY"), ("ZA", "SA"), ("ZE", "SE"), ("ZI", "SI"),
        ("ZO", "SO"), ("ZU", "SU"), ("C", "K"), ("B", "V"), ("H", ""),
    ],
    "it": [
        ("GLI", "LI"), ("GN", "N"), ("SCE", "SE"), ("SCI", "SI"), ("CHE", "KE"), ("CHI", "KI"), ("GHE", "GE"), ("GHI", "GI"), ("GE", "JE"), ("GI", "JI"),
        ("QU", "KU"), ("H", ""),
    ],
    "pt": [
        ("NH", "N"), ("LH", "L"), ("CH", "X"), ("RR", "R"), ("SS", "S"), ("QU", "K"), ("GU", "G"), ("CE", "SE"), ("CI", "SI"), ("GE", "JE"), ("GI", "JI"),
    ],
    "nl": [
        ("SCH", "S"), ("CH", "G"), ("PH", "F"), ("QU", "KW"), ("TH", "T"), ("DT", "T"), ("AA", "A"), ("EE", "E"), ("OO", "O"), ("UU", "U"), ("W", "V"),
    ],
    "el": [
        ("TH", "T"), ("CH", "K"), ("PS", "S"), ("KS", "S"),
    ],
    "ja": [
        ("SH", "S"), ("CH", "T"), ("TS", "T"), ("DZ", "Z"), ("AA", "A"), ("II", "I"), ("UU", "U"), ("EE", "E"), ("OO", "O"), ("OU", "O"),
    ],
}
DIGITS: dict[str, dict[str, str]] = {
    "en": {"BFPV": "1", "CGJKQSXZ": "2", "DT": "3", "L": "4", "MN": "5", "R": "6"},
    "fr": {"BP": "1", "CKQ": "2", "DT": "3", "L": "4", "MN": "5", "R": "6", "GJ": "7", "SXZ": "8", "FV": "9", "1": "1", "2": "2", "3": "3", "4": "4"},
    "es": {"BVW": "1", "KQ": "2", "DT": "3", "L": "4", "MN": "5", "R": "6", "GJX": "7", "SZ": "8", "FP": "9", "Y": "0"},
    "it": {"BP": "1", "CKQ": "2", "DT": "3", "L": "4", "MN": "5", "R": "6", "GJ": "7", "SXZ": "8", "FV": "9"},
    "pt": {"BP": "1", "CKQ": "2", "DT": "3", "L": "4", "MN": "5", "R": "6", "GJX": "7", "SZ": "8", "FV": "9"},
    "nl": {"BP": "1", "CKQ": "2", "DT": "3", "L": "4", "MN": "5", "R": "6", "GJ": "7", "SXZ": "8", "FV": "9"},
    "el": {"BP": "1", "GK": "2", "DT": "3", "L": "4", "MN": "5", "R": "6", "SZ": "7", "FV": "8"},
    "ja": {"BP": "1", "GK": "2", "DT": "3", "MN": "4", "R": "5", "SZ": "6", "HFV": "7", "WY": "8"},
}
#: Rows of the kana table in the order a i u e o, with their consonant; small vowels and glides sound like large ones.
KANA = {"": "あいうえお", "K": "かきくけこ", "G": "がぎぐげご", "S": "さしすせそ", "Z": "ざじずぜぞ", "T": "たちつてと", "D": "だぢづでど", "N": "なにぬねの", "H": "はひふへほ", "B": "ばびぶべぼ", "P": "ぱぴぷぺぽ", "M": "まみむめも", "R": "らりるれろ"}
KANA_SINGLE = {"や": "YA", "ゆ": "YU", "よ": "YO", "ゃ": "YA", "ゅ": "YU", "ょ": "YO", "わ": "WA", "を": "O", "ん": "N", "ゔ": "VU", "ぁ": "A", "ぃ": "I", "ぅ": "U", "ぇ": "E", "ぉ": "O"}


def kana() -> Steps:
    """Hiragana and katakana (96 code points later) to Latin letters."""
    sounds = {c: row + v for row, chars in KANA.items() for c, v in zip(chars, "AIUEO", strict=True)} | KANA_SINGLE
    return [(chr(ord(c) + shift), s) for c, s in sounds.items() for shift in (0, 96)]


def replaced(c: Column, pairs: Steps) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def letters(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Z]", "")


def digits_of(c: Column, table: dict[str, str]) -> Column:
    """Every character as its digit, or "-" where it has none."""
    to = {ch: d for group, d in table.items() for ch in group}
    source = ALPHABET + "1234"
    return F.translate(c, source, "".join(to.get(ch, "-") for ch in source))


def code(first: Column, first_digit_of: Column, rest: Column, table: dict[str, str]) -> Column:
    """First letter, then digits of the rest; a digit that repeats the one right before it is left out. Four long."""
    digits = F.concat(digits_of(first_digit_of, table), digits_of(rest, table))
    collapsed = F.regexp_replace(digits, r"([0-9])\1+", "$1")
    body = F.replace(F.substring(collapsed, F.lit(2), F.length(collapsed)), F.lit("-"), F.lit(""))
    return F.rpad(F.concat(first, body), 4, "0")


def tail(c: Column) -> Column:
    return F.substring(c, F.lit(2), F.length(c))


def head(c: Column) -> Column:
    return F.substring(c, 1, 1)


def undoubled(c: Column) -> Column:
    return F.regexp_replace(c, r"([^AEIOU])\1+", "$1")


def soundex(c: Column, language: str) -> Column:
    upper = F.upper(c)
    if language == "de":
        return cologne(c)
    if language == "ja":
        plain = letters(replaced(upper, kana()))
    else:
        plain = letters(replaced(upper, ACCENTS.get(language, [])))
    language = language if language in DIGITS else "en"
    table, sounds = DIGITS[language], SOUNDS.get(language, [])
    if language == "fr":
        silent = F.when((F.length(plain) > 2) & F.rlike(plain, F.lit("[TDSXZP]$")), F.regexp_replace(plain, ".$", "")).otherwise(plain)
        out = code(head(plain), head(plain), tail(replaced(silent, sounds)), table)
    elif language == "it":
        out = code(head(plain), head(plain), tail(undoubled(replaced(plain, sounds))), table)
    elif language == "pt":
        out = code(head(plain), head(plain), tail(F.regexp_replace(replaced(plain, sounds), "^H", "")), table)
    else:
        spoken = replaced(plain, sounds)
        spoken = undoubled(spoken) if language == "el" else spoken
        out = code(head(spoken), head(spoken), tail(spoken), table)
        return F.when(c.isNull(), None).when(spoken == "", "").otherwise(out)
    return F.when(c.isNull(), None).when(plain == "", "").otherwise(out)


def cologne(c: Column) -> Column:
    """Contexts are resolved while the letters around still stand; w and x hold the place of X until the end."""
    plain = letters(replaced(F.upper(c), [("Ä", "A"), ("Ö", "O"), ("Ü", "U"), ("ß", "SS")]))
    contexts = [
        ("(?<=[CKQ])X", "w"), ("X", "x"), ("[DT](?=[CSZ])", "8"), ("P(?=H)", "3"),
        ("^C(?=[AHKLOQRUwx])", "4"), ("^C", "8"), ("(?<=[SZ])C", "8"), ("C(?=[AHKOQUwx])", "4"), ("C", "8"),
    ]
    out = plain
    for pattern, digit in contexts:
        out = F.regexp_replace(out, pattern, digit)
    out = F.translate(out, "AEIJOUYBPDTFVWGKQLMNRSZwH", "000000011223334445667888")
    for pattern, new in (("(?<=8)x8*", "y"), ("x8*", "z"), (r"([0-9])\1+", "$1"), ("y", "4"), ("z", "48")):
        out = F.regexp_replace(out, pattern, new)
    trimmed = F.regexp_replace(out, "^0+", "")
    return F.when((trimmed == "") & (out != ""), "0").otherwise(trimmed)


#: Spellings of Caverphone in order; 2 holds the place of a sound that isn't heard.
CAVERPHONE_SPELLINGS: Steps = [
    ("cq", "2q"), ("ci", "si"), ("ce", "se"), ("cy", "sy"), ("tch", "2ch"), ("c", "k"), ("q", "k"), ("x", "k"), ("v", "f"), ("dg", "2g"), ("tio", "sio"),
    ("tia", "sia"), ("d", "t"), ("ph", "fh"), ("b", "p"), ("sh", "s2"), ("z", "s"), ("gh", "22"), ("gn", "2n"), ("g", "k"), ("kh", "k2"), ("wh", "w2"),
    ("wa", "2a"), ("we", "2e"), ("wi", "2i"), ("wo", "2o"), ("wu", "2u"), ("w", "2"),
]
CAVERPHONE: Steps = [
    ("e$", ""), ("^(c|r|t|en)ough", "$1of2f"), ("^gn", "2n"), ("mb$", "m2"), *CAVERPHONE_SPELLINGS,
    ("(?<=[aeiou])h(?=[aeiou])", "2"), ("h", ""), ("[aeiou]", "A"), (r"(.)\1+", "$1"), ("2", ""),
]


def caverphone(c: Column) -> Column:
    out = F.regexp_replace(F.lower(c), "[^a-z]", "")
    for pattern, new in CAVERPHONE:
        out = F.regexp_replace(out, pattern, new)
    return F.upper(F.rpad(out, 10, "1"))


# -- pattern tables, first match wins; \0 is the letter itself, \p the one before it

METAPHONE = re.compile(
    "|".join(
        f"(?P<{name}>{pattern})"
        for name, pattern in [
            ("silent_start", "^(?:K(?=N)|G(?=N)|P(?=N)|A(?=E)|W(?=R))"),
            ("doubled", "(?<=(?P<was>.))(?![CAEIOU])(?P=was)"),
            ("vowel_start", "^[AEIOU]"),
            ("silent", "[AEIOU]|(?<=M)B$|GH(?=T)|G(?=N)|(?<=[AEIOU])H|H(?![AEIOU])|(?<=C)K|[WY](?![AEIOU])"),
            ("sh", "CH|SH|[ST](?=I[OA])"),
            ("s", "C(?=[IEY])|S|Z"),
            ("j", "DG(?=[EIY])|G(?=[EIY])"),
            ("f", "GH|PH|V"),
            ("th", "TH"),
            ("k", "C|G|Q"),
            ("t", "D"),
            ("ks", "X"),
            ("same", "."),
        ]
    )
)
METAPHONE_SOUND = {"silent_start": "", "doubled": "", "silent": "", "sh": "X", "s": "S", "j": "J", "f": "F", "th": "0", "k": "K", "t": "T", "ks": "KS"}


def metaphone(s: str | None) -> str | None:
    if s is None:
        return None
    word, out = re.sub("[^A-Z]", "", s.upper()), ""
    for m in METAPHONE.finditer(word):
        if len(out) >= 6:
            break
        out += METAPHONE_SOUND.get(m.lastgroup, m[0])
    return out


NYSIIS_START: Steps = [("^MAC", "MCC"), ("^KN", "NN"), ("^K", "C"), ("^P[HF]", "FF"), ("^SCH", "SSS")]
NYSIIS_END: Steps = [("(?:EE|IE)$", "Y"), ("(?:DT|RT|RD|NT|ND)$", "D")]
NYSIIS = re.compile("(?P<A>[EIOU])|(?P<G>Q)|(?P<S>Z|SH|S(?!CH))|(?P<SSS>SCH)|(?P<N>M|K(?=N))|(?P<C>K)|(?P<F>PH)|(?P<same>(?<=[AEIOU])H(?=[AEIOU]))|(?P<before>H|(?<=[AEIOU])W)|(?P<other>.)")


def _first_change(word: str, pairs: Steps) -> str:
    for pattern, new in pairs:
        changed, n = re.subn(pattern, new, word)
        if n:
            return changed
    return word


def nysiis(s: str | None) -> str | None:
    if s is None:
        return None
    word = _first_change(_first_change(re.sub("[^A-Z]", "", s.upper()), NYSIIS_START), NYSIIS_END)
    out = word[:1]
    for m in NYSIIS.finditer(word, 1):
        kind = m.lastgroup
        new = m[0] if kind in ("same", "other") else word[m.start() - 1] if kind == "before" else kind
        if kind == "SSS":
            out += "SS"
        elif not out.endswith(new):
            out += new
    for pattern, new in (("(?<=.)S$", ""), ("(?<=.)A$", ""), ("AY$", "Y")):
        out = re.sub(pattern, new, out)
    return out


def _arrow(f: Callable[[str | None], str | None]):
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        codes = {x: f(x) for x in s.dropna().unique()}
        return s.map(lambda x: codes.get(x), na_action="ignore")

    return run


def spoken(v: Value) -> Column:
    """Text; null for null and for anything that isn't text."""
    return v.col if v.is_text else F.lit(None).cast("string")


@named("SOUNDEX", least=1, most=2)
def _soundex(ctx, s, locale=None):
    return Value(soundex(spoken(s), "en" if locale is None else str(known(locale, "SOUNDEX"))), TEXT)


for _language in ("fr", "es", "it", "pt", "nl", "el", "ja"):

    @named(f"SOUNDEX_{_language.upper()}", least=1, most=1)
    def _localised(ctx, s, language=_language):
        return Value(soundex(spoken(s), language), TEXT)


@named("COLOGNE", "COLOGNE_PHONETIC", least=1, most=1)
def _cologne(ctx, s):
    return Value(cologne(spoken(s)), TEXT)


@named("CAVERPHONE", least=1, most=1)
def _caverphone(ctx, s):
    return Value(caverphone(spoken(s)), TEXT)


@named("METAPHONE", least=1, most=1)
def _metaphone(ctx, s):
    return Value(_arrow(metaphone)(spoken(s)), TEXT)


@named("DOUBLE_METAPHONE", least=1, most=1)
def _double_metaphone(ctx, s):
    """Primary and secondary code, which are the same."""
    c = _arrow(metaphone)(spoken(s))
    return Value(F.when(c.isNotNull(), F.array(c, c)), T.ArrayType(TEXT))


@named("NYSIIS", least=1, most=1)
def _nysiis(ctx, s):
    return Value(_arrow(nysiis)(spoken(s)), TEXT)
