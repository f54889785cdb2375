"""String functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .registry import named
from .values import BOOL, DOUBLE, LONG, TEXT, QueryError, Value, constant, text

TEXTS = T.ArrayType(TEXT)
#: What the checks of kinds of text accept.
EMAIL = r"^[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}$"
URL = r"^https?://[^\s/$.?#].[^\s]*$"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def string(v: Value, name: str) -> Column:
    if not (v.is_text or v.is_null):
        raise QueryError(f"{name} needs a string, not {v.type.simpleString()}")
    return v.col.cast("string")


def lenient(v: Value) -> Column:
    """Text, or "" for anything else and for null."""
    return F.coalesce(v.col, F.lit("")) if v.is_text else F.lit("")


def known(v: Value, name: str):
    """A value that the plan needs to know."""
    if not v.constant:
        raise QueryError(f"this argument of {name} must be a constant")
    return v.literal


def literal_regex(s: str) -> str:
    """A Java pattern for exactly this text."""
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", s)


def quoted(v: Value) -> Column:
    return F.lit(literal_regex(v.literal)) if v.constant else F.regexp_replace(v.col, r"([\\.^$|?*+()\[\]{}])", r"\\$1")


def text_of(c: Column) -> Value:
    return Value(c, TEXT)


@named("UPPER", least=1, most=1)
def _upper(ctx, s):
    return text_of(F.upper(string(s, "UPPER")))


@named("LOWER", least=1, most=1)
def _lower(ctx, s):
    return text_of(F.lower(string(s, "LOWER")))


@named("TO_UPPER", "TOUPPER", least=1, most=1)
def _to_upper(ctx, s):
    return text_of(F.upper(lenient(s)))


@named("TO_LOWER", "TOLOWER", least=1, most=1)
def _to_lower(ctx, s):
    return text_of(F.lower(lenient(s)))


def _strip(c: Column, side: int, chars: str | None) -> Column:
    one = r"\s" if chars is None else "[" + re.sub(r"([\\\]\[^\-&])", r"\\\1", chars) + "]"
    if side in (0, 1):
        c = F.regexp_replace(c, f"^{one}+", "")
    return F.regexp_replace(c, f"{one}+$", "") if side in (0, 2) else c


@named("TRIM", least=1, most=3)
def _trim(ctx, s, a=None, b=None):
    side, chars = 0, None
    for extra in (x for x in (a, b) if x is not None):
        value = known(extra, "TRIM")
        if isinstance(value, str):
            chars = value
        else:
            side = int(value)
    return text_of(_strip(string(s, "TRIM"), side, chars or None))


@named("LTRIM", least=1, most=2)
def _ltrim(ctx, s, chars=None):
    return text_of(_strip(lenient(s), 1, known(chars, "LTRIM") if chars else None))


@named("RTRIM", least=1, most=2)
def _rtrim(ctx, s, chars=None):
    return text_of(_strip(lenient(s), 2, known(chars, "RTRIM") if chars else None))


@named("SPLIT", least=2, most=3)
def _split(ctx, s, sep, limit=None):
    c = string(s, "SPLIT")
    if sep.constant and sep.literal == "":
        return Value(F.filter(F.split(c, ""), lambda x: x != ""), TEXTS)
    n = int(known(limit, "SPLIT")) if limit is not None else 0
    if n >= 0:
        return Value(F.split(c, quoted(sep), n if n > 0 else -1), TEXTS)
    parts = F.split(c, quoted(sep), -1)
    keep = -n - 1
    head = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - keep, F.lit(1))), sep.literal if sep.constant else "")
    tail = F.slice(parts, F.greatest(F.size(parts) - keep, F.lit(1)) + 1, keep) if keep else F.array().cast("array<string>")
    return Value(F.concat(F.array(head), tail), TEXTS)


def _texts(a: Value) -> Column:
    return F.transform(a.col, lambda x: text(Value(x, a.element), ""))


def _pieces(args: tuple[Value, ...]) -> list[Column]:
    """Texts of the arguments; arrays give those of their elements, null gives ""."""
    out = []
    for a in args:
        if a.is_array:
            out.append(F.array_join(_texts(a), ""))
        else:
            out.append(text(a, ""))
    return out


@named("CONCAT")
def _concat(ctx, *args):
    return text_of(F.concat(*_pieces(args)) if args else F.lit(""))


@named("CONCAT_WS", "CONCAT_SEPARATOR", least=1)
def _concat_ws(ctx, sep, *args):
    parts = [_texts(a) if a.is_array else F.array(text(a, "")) for a in args]
    return text_of(F.array_join(F.concat(*parts), known(sep, "CONCAT_WS")) if parts else F.lit(""))


def byte_index(s: Column, sub: Column) -> Column:
    at = F.call_function("locate", sub, s)
    return F.when(at > 0, F.octet_length(F.substring(s, F.lit(1), at - 1)).cast("long")).otherwise(F.lit(-1).cast("long"))


@named("CONTAINS", least=2, most=3)
def _contains(ctx, s, sub, index=None):
    if s.is_array:
        from .values import equal

        return Value(F.exists(s.col, lambda x: equal(Value(x, s.element), sub)), BOOL)
    a, b = string(s, "CONTAINS"), string(sub, "CONTAINS")
    if index is not None and known(index, "CONTAINS"):
        return Value(byte_index(a, b), LONG)
    return Value(a.contains(b), BOOL)


@named("STARTS_WITH", least=2, most=2)
def _starts(ctx, s, sub):
    return Value(lenient(s).startswith(lenient(sub)), BOOL)


@named("ENDS_WITH", least=2, most=2)
def _ends(ctx, s, sub):
    return Value(lenient(s).endswith(lenient(sub)), BOOL)


@named("SUBSTRING", "SUBSTR", least=2, most=3)
def _substring(ctx, s, start, length=None):
    c = lenient(s)
    at = F.greatest(start.col.cast("int"), F.lit(0)) + 1
    return text_of(F.substring(c, at, F.length(c) if length is None else F.greatest(length.col.cast("int"), F.lit(0))))


@named("REPLACE", least=3, most=3)
def _replace(ctx, s, old, new):
    return text_of(F.replace(lenient(s), lenient(old), lenient(new)))


@named("LEFT", least=2, most=2)
def _left(ctx, s, n):
    return text_of(F.substring(lenient(s), F.lit(1), F.greatest(n.col.cast("int"), F.lit(0))))


@named("RIGHT", least=2, most=2)
def _right(ctx, s, n):
    return text_of(F.right(lenient(s), F.greatest(n.col.cast("int"), F.lit(0))))


@named("CHAR_LENGTH", "CHARACTER_LENGTH", "CHAR_COUNT", least=1, most=1)
def _char_length(ctx, s):
    return Value(F.char_length(lenient(s)).cast("long"), LONG)


@named("BYTE_LENGTH", least=1, most=1)
def _byte_length(ctx, s):
    return Value(F.octet_length(lenient(s)).cast("long"), LONG)


@named("FIND_FIRST", "FIND", "INDEX_OF_STRING", least=2, most=2)
def _find_first(ctx, s, sub):
    from .registry import Function

    if isinstance(sub, Function):
        return Value(F.get(F.filter(s.col, lambda x: _test(sub, Value(x, s.element))), F.lit(0)), s.element)
    return Value(byte_index(lenient(s), lenient(sub)), LONG)


def _test(f, v: Value) -> Column:
    from .values import truthy

    return truthy(f.body(v))


@named("FIND_LAST", "RFIND", least=2, most=2)
def _find_last(ctx, s, sub):
    a, b = lenient(s), lenient(sub)
    back = F.call_function("locate", F.reverse(b), F.reverse(a))
    at = F.length(a) - back - F.length(b) + 2
    found = F.octet_length(F.substring(a, F.lit(1), at - 1)).cast("long")
    return Value(F.when(b == "", F.octet_length(a).cast("long")).when(back > 0, found).otherwise(F.lit(-1).cast("long")), LONG)


@named("REGEX_TEST", "REGEX_MATCH", least=2, most=2)
def _regex_test(ctx, s, pattern):
    return Value(F.rlike(lenient(s), pattern.col), BOOL)


@named("REGEX_REPLACE", least=3, most=4)
def _regex_replace(ctx, s, pattern, new, insensitive=None):
    flag = "(?i)" if insensitive is not None and known(insensitive, "REGEX_REPLACE") else ""
    p = F.lit(flag + pattern.literal) if pattern.constant else F.concat(F.lit(flag), pattern.col)
    return text_of(F.regexp_replace(string(s, "REGEX_REPLACE"), p, new.col.cast("string")))


@named("REGEX_MATCHES", least=2, most=2)
def _regex_matches(ctx, s, pattern):
    return Value(F.regexp_extract_all(lenient(s), pattern.col, F.lit(0)), TEXTS)


def _first_n(c: Column, old: Value, new: Column, n: int) -> Column:
    """The first n finds replaced: split off n parts, and join what comes after them as it was."""
    parts = F.split(c, quoted(old), n + 1)
    return F.aggregate(F.slice(parts, 2, n), F.get(parts, F.lit(0)), lambda acc, x: F.concat(acc, new, x))


@named("SUBSTITUTE", least=2, most=4)
def _substitute(ctx, s, old, new=None, limit=None):
    c = string(s, "SUBSTITUTE")
    if isinstance(old.type, T.StructType):
        from .values import field_of

        n = int(known(new, "SUBSTITUTE")) if new is not None else 0
        for name in old.type.fieldNames():
            by = text(field_of(old, name), "")
            c = _first_n(c, constant(name), by, n) if n > 0 else F.replace(c, F.lit(name), by)
        return text_of(c)
    if old.is_array:
        raise QueryError("SUBSTITUTE takes a string or an object")
    by = text(new, "") if new is not None else F.lit("")
    n = int(known(limit, "SUBSTITUTE")) if limit is not None else 0
    return text_of(_first_n(c, old, by, n) if n > 0 else F.replace(c, string(old, "SUBSTITUTE"), by))


@named("HIGHLIGHT", least=2, most=2)
def _highlight(ctx, s, terms):
    c = string(s, "HIGHLIGHT")
    if terms.constant:
        pattern = F.lit("(?i)(" + literal_regex(terms.literal) + ")") if terms.literal else None
    elif terms.is_array:
        longest = F.array_sort(F.filter(terms.col, lambda x: x != ""), lambda a, b: F.length(b) - F.length(a))
        escaped = F.transform(longest, lambda x: F.regexp_replace(x, r"([\\.^$|?*+()\[\]{}])", r"\\$1"))
        pattern = F.concat(F.lit("(?i)("), F.array_join(escaped, "|"), F.lit(")"))
    else:
        pattern = F.concat(F.lit("(?i)("), quoted(terms), F.lit(")"))
    return text_of(c if pattern is None else F.when(pattern == "(?i)()", c).otherwise(F.regexp_replace(c, pattern, F.lit("<b>$1</b>"))))


#: Letters with marks and what they become in slugs, position by position.
MARKED = "àáâãäåèéêëìíîïòóôõöøùúûüýÿñç"
PLAIN = "aaaaaaeeeeiiiioooooouuuuyync"


@named("SLUGIFY", least=1, most=1)
def _slugify(ctx, s):
    c = F.replace(F.replace(F.translate(F.lower(string(s, "SLUGIFY")), MARKED, PLAIN), F.lit("ß"), F.lit("ss")), F.lit("æ"), F.lit("ae"))
    return text_of(F.regexp_replace(F.regexp_replace(c, "[^a-z0-9]+", "-"), "^-+|-+$", ""))


SANITIZERS = {
    "trim": lambda c: _strip(c, 0, None),
    "lowercase": F.lower,
    "uppercase": F.upper,
    "alphanumeric": lambda c: F.regexp_replace(c, r"[^\p{L}\p{N}]", ""),
    "alpha": lambda c: F.regexp_replace(c, r"[^\p{L}]", ""),
    "numeric": lambda c: F.regexp_replace(c, r"[^\p{N}]", ""),
    "email": lambda c: F.regexp_replace(F.lower(_strip(c, 0, None)), r"[^a-z0-9@._+\-]", ""),
    "url": lambda c: F.regexp_replace(_strip(c, 0, None), r"\s", ""),
    "html": lambda c: F.replace(F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;")),
    "strip_html": lambda c: F.regexp_replace(c, "<[^>]*>", ""),
    "normalize_whitespace": lambda c: _strip(F.regexp_replace(c, r"\s+", " "), 0, None),
}


@named("SANITIZE", least=1, most=2)
def _sanitize(ctx, s, options=None):
    c = string(s, "SANITIZE")
    wanted = ["trim"]
    if options is not None:
        wanted = options.literal if isinstance(options.literal, list) else [known(options, "SANITIZE")]
    for name in wanted:
        if name not in SANITIZERS:
            raise QueryError(f"SANITIZE knows no {name!r}")
        c = SANITIZERS[name](c)
    return text_of(c)


@named("TO_STRING", least=1, most=1)
def _to_string(ctx, v):
    return text_of(text(v, ""))


@named("TO_STR", least=1, most=1)
def _to_str(ctx, v):
    return text_of(text(v, "null"))


@named("CAPITALIZE", least=1, most=1)
def _capitalize(ctx, s):
    c = string(s, "CAPITALIZE")
    return text_of(F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, F.lit(2), F.length(c))))


@named("TITLE_CASE", "INITCAP", least=1, most=1)
def _title(ctx, s):
    return text_of(F.initcap(_strip(F.regexp_replace(string(s, "TITLE_CASE"), r"\s+", " "), 0, None)))


@named("ENCODE_URI", "URL_ENCODE", "ENCODE_URI_COMPONENT", least=1, most=1)
def _encode(ctx, s):
    c = F.url_encode(string(s, "ENCODE_URI"))
    return text_of(F.replace(F.replace(F.replace(c, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")))


@named("DECODE_URI", "URL_DECODE", "DECODE_URI_COMPONENT", least=1, most=1)
def _decode(ctx, s):
    c = string(s, "DECODE_URI")
    return text_of(F.coalesce(F.try_url_decode(c), c))


@named("IS_EMAIL", least=1, most=1)
def _is_email(ctx, s):
    return Value(F.rlike(lenient(s), F.lit(EMAIL)), BOOL)


@named("IS_URL", least=1, most=1)
def _is_url(ctx, s):
    return Value(F.rlike(lenient(s), F.lit(URL)), BOOL)


@named("IS_UUID", least=1, most=1)
def _is_uuid(ctx, s):
    return Value(F.rlike(lenient(s), F.lit(UUID)), BOOL)


@named("IS_BLANK", least=1, most=1)
def _is_blank(ctx, s):
    if s.is_null:
        return constant(True)
    return Value(s.col.isNull() | F.rlike(lenient(s), F.lit(r"^\s*$")), BOOL) if s.is_text else constant(False)


@named("LEVENSHTEIN", least=2, most=2)
def _levenshtein(ctx, a, b):
    return Value(F.levenshtein(string(a, "LEVENSHTEIN"), string(b, "LEVENSHTEIN")).cast("long"), LONG)


def normalised(c: Column) -> Column:
    """Lower case, letters, digits and single spaces only."""
    return _strip(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\s]", ""), r"\s+", " "), 0, None)


def trigrams(c: Column) -> Column:
    """Runs of three characters of normalised text; a shorter text is its own and only one."""
    n = normalised(c)
    runs = F.transform(F.sequence(F.lit(1), F.length(n) - 2), lambda i: F.substring(n, i, F.lit(3)))
    return F.array_distinct(F.when(F.length(n) >= 3, runs).when(F.length(n) > 0, F.array(n)).otherwise(F.array().cast("array<string>")))


@named("SIMILARITY", least=2, most=2)
def _similarity(ctx, a, b):
    x, y = trigrams(string(a, "SIMILARITY")), trigrams(string(b, "SIMILARITY"))
    whole = F.size(F.array_union(x, y))
    shared = F.size(F.array_intersect(x, y)) / F.greatest(whole, F.lit(1))
    same = normalised(string(a, "SIMILARITY")) == normalised(string(b, "SIMILARITY"))
    return Value(F.when(same, F.lit(1.0)).otherwise(shared.cast("double")), DOUBLE)


@named("FUZZY_MATCH", least=2, most=3)
def _fuzzy(ctx, a, b, most=None):
    bound = F.lit(2) if most is None else most.col.cast("int")
    return Value(F.levenshtein(string(a, "FUZZY_MATCH"), string(b, "FUZZY_MATCH")) <= bound, BOOL)


@named("JOIN", least=1, most=2)
def _join(ctx, items, sep=None):
    parts = F.transform(items.col, lambda x: text(Value(x, items.element)))
    return text_of(F.array_join(parts, known(sep, "JOIN") if sep is not None else ","))  # leaves out nulls


@named("REPEAT", least=2, most=2)
def _repeat(ctx, s, n):
    return text_of(F.repeat(lenient(s), n.col.cast("int")))


@named("PAD_LEFT", "LPAD", least=2, most=3)
def _lpad(ctx, s, n, fill=None):
    c = lenient(s)
    return text_of(F.when(F.length(c) >= n.col, c).otherwise(F.call_function("lpad", c, n.col.cast("int"), fill.col if fill is not None else F.lit(" "))))


@named("PAD_RIGHT", "RPAD", least=2, most=3)
def _rpad(ctx, s, n, fill=None):
    c = lenient(s)
    return text_of(F.when(F.length(c) >= n.col, c).otherwise(F.call_function("rpad", c, n.col.cast("int"), fill.col if fill is not None else F.lit(" "))))


@named("WORD_COUNT", least=1, most=1)
def _word_count(ctx, s):
    return Value(F.size(F.filter(F.split(lenient(s), r"\s+"), lambda x: x != "")).cast("long"), LONG)


@named("TRUNCATE_TEXT", least=2, most=3)
def _truncate(ctx, s, n, tail=None):
    c, end = lenient(s), F.lit("...") if tail is None else tail.col
    return text_of(F.when(F.length(c) > n.col, F.concat(F.substring(c, F.lit(1), F.greatest(n.col.cast("int") - F.length(end), F.lit(0))), end)).otherwise(c))


@named("MASK", least=1, most=3)
def _mask(ctx, s, keep=None, char=None):
    """All but the last `keep` (4) characters become `char` (*)."""
    c, n = lenient(s), F.lit(4) if keep is None else keep.col.cast("int")
    hidden = F.greatest(F.length(c) - n, F.lit(0))
    return text_of(F.concat(F.repeat(F.lit("*") if char is None else char.col, hidden), F.substring(c, hidden + 1, F.length(c))))
