"""More queries over the driver's tables: the functions, sources and writes that catalog_queries leaves out, with SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import phonetic, registry
from ..operators import graph, mutations, search
from ..operators.columnar import Columnar
from ..sources import transfer
from ..streaming import streams
from .catalog_queries import COSINE, add, added, engine, event_stream, keyed, scratch

# -- strings

add("functions_string_more", r"""
    FOR p IN part LET s = $"  ${p.p_name} " RETURN {k: p.p_partkey, a: TO_UPPER(p.p_name), b: TOUPPER(p.p_type), c: TO_LOWER(p.p_brand), d: TOLOWER(p.p_type), e: LTRIM(s), f: RTRIM(s), g: TRIM(s, 1), h: TRIM(p.p_brand, "Bd"),
      i: CONCAT_SEPARATOR("-", p.p_brand, p.p_size), j: ENDS_WITH(p.p_name, "t"), l: SUBSTR(p.p_name, 1), m: CHARACTER_LENGTH(p.p_name), n: FIND_FIRST(p.p_name, "e"), o: RFIND(p.p_name, "e"), q: FIND(p.p_name, ""),
      r: SUBSTITUTE(p.p_name, "e", "3"), t: SUBSTITUTE(p.p_name, "e", "3", 1), u: SUBSTITUTE(p.p_name, {red: "R", e: "E"}), v: TITLE_CASE(p.p_name), w: INITCAP(p.p_type), x: TO_STR(p.nothing), y: TO_STR(p.p_size),
      z: PAD_LEFT(p.p_type, 12, "."), aa: PAD_RIGHT(p.p_type, 12, "."), ab: RPAD(p.p_type, 9, "-"), ac: BYTE_LENGTH($"é${p.p_name}"), ad: REGEX_MATCHES(p.p_brand, "[0-9]"), ae: MASK(p.p_type), af: TRUNCATE_TEXT(p.p_name, 7), ag: SPLIT(p.p_name, " ", 1)[0], ah: CHAR_COUNT(p.p_name)}""", r"""
    SELECT p_partkey AS k, upper(p_name) AS a, upper(p_type) AS b, lower(p_brand) AS c, lower(p_type) AS d, p_name || ' ' AS e, '  ' || p_name AS f, p_name || ' ' AS g, trim(p_brand, 'Bd') AS h,
      p_brand || '-' || p_size AS i, ends_with(p_name, 't') AS j, substr(p_name, 2) AS l, length(p_name) AS m, instr(p_name, 'e') - 1 AS n, CASE WHEN contains(p_name, 'e') THEN length(p_name) - instr(reverse(p_name), 'e') ELSE -1 END AS o, 0 AS q,
      replace(p_name, 'e', '3') AS r, regexp_replace(p_name, 'e', '3') AS t, replace(replace(p_name, 'red', 'R'), 'e', 'E') AS u, array_to_string([upper(w[1]) || lower(w[2:]) FOR w IN string_split(p_name, ' ')], ' ') AS v, upper(p_type[1]) || lower(p_type[2:]) AS w, 'null' AS x, CAST(p_size AS VARCHAR) AS y,
      CASE WHEN length(p_type) >= 12 THEN p_type ELSE lpad(p_type, 12, '.') END AS z, CASE WHEN length(p_type) >= 12 THEN p_type ELSE rpad(p_type, 12, '.') END AS aa, CASE WHEN length(p_type) >= 9 THEN p_type ELSE rpad(p_type, 9, '-') END AS ab, strlen(p_name) + 2 AS ac, regexp_extract_all(p_brand, '[0-9]') AS ad,
      repeat('*', greatest(length(p_type) - 4, 0)) || right(p_type, 4) AS ae, CASE WHEN length(p_name) > 7 THEN p_name[:4] || '...' ELSE p_name END AS af, p_name AS ag, length(p_name) AS ah FROM part""")  # fmt: skip
add("functions_sanitize", r"""
    FOR d IN documents RETURN {k: d.doc_id, a: MD5(SANITIZE(d.text, "normalize_whitespace")), b: MD5(SANITIZE(d.text, ["strip_html", "lowercase"])), c: MD5(SANITIZE(d.text, "alphanumeric")), d: MD5(SANITIZE(d.text, "alpha")), e: SANITIZE(d.text, "numeric"), f: MD5(SANITIZE(d.text, "html")),
      g: LENGTH(SANITIZE(d.text, "url")), h: IS_BLANK(d.text), i: LENGTH(SANITIZE($"  ${d.lang} "))}""", r"""
    SELECT doc_id AS k, md5(trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g'))) AS a, md5(lower(regexp_replace(text, '<[^>]*>', '', 'g'))) AS b, md5(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) AS c, md5(regexp_replace(text, '[^\p{L}]', '', 'g')) AS d, regexp_replace(text, '[^\p{N}]', '', 'g') AS e,
      md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS f, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS g, trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' AS h, length(lang) AS i FROM documents""")  # fmt: skip
add("functions_uri", r"""
    FOR p IN pages LET u = ENCODE_URI(p.url) RETURN {k: p.page_id, u, v: URL_ENCODE(p.url) == u AND ENCODE_URI_COMPONENT(p.url) == u, d: DECODE_URI(u), e: URL_DECODE(u) == p.url AND DECODE_URI_COMPONENT(u) == p.url, f: DECODE_URI(CONCAT(u, "+x")), w: IS_URL(p.url), x: IS_EMAIL(CONCAT("a", p.page_id, "@b.co")), y: IS_EMAIL(p.url), z: IS_UUID(p.url), g: IS_UUID(MD5(p.url))}""", r"""
    SELECT page_id AS k, url_encode(url) AS u, true AS v, url AS d, true AS e, url || ' x' AS f, true AS w, true AS x, false AS y, false AS z, false AS g FROM pages""")  # fmt: skip
add("functions_trigrams", 'FOR p IN part RETURN {k: p.p_partkey, s: ROUND(SIMILARITY(p.p_name, "Red, widget"), 9), t: SIMILARITY(p.p_type, "economy"), u: SIMILARITY(p.p_name, "x")}', r"""
    WITH n AS (SELECT p_partkey AS k, p_name AS a, lower(p_type) AS b FROM part), g AS (
      SELECT k, [a[i : i + 2] FOR i IN range(1, length(a) - 1)] AS x, [b[i : i + 2] FOR i IN range(1, length(b) - 1)] AS z, ['red', 'ed ', 'd w', ' wi', 'wid', 'idg', 'dge', 'get'] AS y, ['eco', 'con', 'ono', 'nom', 'omy'] AS v FROM n)
    SELECT k, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 9) AS s, len(list_intersect(z, v)) / len(list_distinct(list_concat(z, v))) AS t, 0.0 AS u FROM g""")  # fmt: skip

# -- phonetics, over all words of the documents

WORDS = r"(SELECT DISTINCT unnest(regexp_extract_all(text, '\p{L}+')) AS w FROM documents)"


def _words(spark: SparkSession, sf_dir: str):
    e = engine(spark, sf_dir)
    words = e.catalog.table("documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"(\p{L}+)"), 1)).alias("w")).distinct()
    e.catalog.add("words", words)
    return e


def _replaced(column: str, steps) -> str:
    for old, new in steps:
        column = f"replace({column}, '{old}', '{new}')"
    return column


def _code(plain: str, first: str, spoken: str, digits: dict[str, str]) -> str:
    """SQL of a code: the first letter, then the digits of what follows, without repeats and letters that have none."""
    alphabet = phonetic.ALPHABET + "1234"
    to = "".join(next((d for group, d in digits.items() if c in group), "-") for c in alphabet)
    return f"""
        SELECT w, CASE WHEN {plain} = '' THEN '' ELSE rpad({first} || array_to_string([d[i] FOR i IN range(2, len(d) + 1) IF d[i] <> '-' AND d[i] <> d[i - 1]], ''), 4, '0') END AS c
        FROM (SELECT *, string_split(translate({first} || {spoken}[2:], '{alphabet}', '{to}'), '') AS d FROM ({{inner}}))"""


def _soundex_sql(language: str) -> str:
    """Soundex with a language's spellings as SQL: the fixed tables, in DuckDB's functions."""
    letters = f"regexp_replace({_replaced("upper(replace(w, 'ß', 'ss'))", phonetic.ACCENTS.get(language, []))}, '[^A-Z]', '', 'g')"
    spoken = "plain"
    if language == "fr":
        spoken = "CASE WHEN length(plain) > 2 AND regexp_matches(plain, '[TDSXZP]$') THEN plain[:-2] ELSE plain END"
    spoken = _replaced(f"({spoken})", phonetic.SOUNDS.get(language, []))
    if language in ("it", "el"):
        chars = f"string_split({spoken}, '')"
        spoken = f"array_to_string([{chars}[i] FOR i IN range(1, len({chars}) + 1) IF i = 1 OR contains('AEIOU', {chars}[i]) OR {chars}[i] <> {chars}[i - 1]], '')"
    if language == "pt":
        spoken = f"regexp_replace({spoken}, '^H', '')"
    inner = f"SELECT *, {spoken} AS spoken FROM (SELECT w, {letters} AS plain FROM {WORDS})"
    by_spelling = language in ("fr", "it", "pt")
    return _code("plain" if by_spelling else "spoken", "plain[1]" if by_spelling else "spoken[1]", "spoken", phonetic.DIGITS[language]).format(inner=inner)


for _language in ("en", "fr", "es", "it", "pt", "nl", "el"):

    @added(f"phonetic_{_language}", _soundex_sql(_language))
    def _soundex(spark: SparkSession, sf_dir: str, language: str = _language) -> DataFrame:
        call = "SOUNDEX(x.w)" if language == "en" else f"SOUNDEX_{language.upper()}(x.w)"
        return _words(spark, sf_dir).query(f"FOR x IN words RETURN {{w: x.w, c: {call}}}")


@added("phonetic_ja", """
    WITH t AS (SELECT ['か', 'き', 'く', 'け', 'こ'][n_nationkey % 5 + 1] || ['さ', 'た', 'な', 'は', 'ま', 'ら', 'が'][n_nationkey % 7 + 1] || ['ん', 'ば', 'ズ'][n_nationkey % 3 + 1] AS w,
      ['6', '3', '4', '7', '4', '5', '2'][n_nationkey % 7 + 1] AS a, ['4', '1', '6'][n_nationkey % 3 + 1] AS b FROM nation)
    SELECT w, rpad('K' || a || b, 4, '0') AS c FROM t""")  # fmt: skip
def phonetic_ja(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Syllables, so that a vowel stands between any two consonants and none is a repeat."""
    return engine(spark, sf_dir).query("""
        FOR n IN nation LET k = n.n_nationkey LET w = CONCAT(["か", "き", "く", "け", "こ"][k % 5], ["さ", "た", "な", "は", "ま", "ら", "が"][k % 7], ["ん", "ば", "ズ"][k % 3])
        RETURN {w, c: SOUNDEX_JA(w)}""")


@added("phonetic_caverphone", rf"""
    WITH w AS (SELECT w, regexp_replace(lower(w), '[^a-z]', '', 'g') AS s FROM {WORDS}), begun AS (
      SELECT w, regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, 'e$', ''), '^(c|r|t|en)ough', '\1of2f'), '^gn', '2n'), 'mb$', 'm2') AS s FROM w
    ), spelt AS (SELECT w, {_replaced('s', phonetic.CAVERPHONE_SPELLINGS)} AS s FROM begun),
    silent AS (SELECT w, regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(s, '([aeiou])h([aeiou])', '\g<1>2\g<2>', 'g'), '([aeiou])h([aeiou])', '\g<1>2\g<2>', 'g'), 'h', ''), '[aeiou]', 'A', 'g'), '$', '') AS s FROM spelt),
    chars AS (SELECT w, string_split(s, '') AS c FROM silent)
    SELECT w, upper(rpad(replace(array_to_string([c[i] FOR i IN range(1, len(c) + 1) IF i = 1 OR c[i] <> c[i - 1]], ''), '2', ''), 10, '1')) AS c FROM chars""".replace(r"\g<1>2\g<2>", r"\12\2"))  # fmt: skip
def phonetic_caverphone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir).query("FOR x IN words RETURN {w: x.w, c: CAVERPHONE(x.w)}")


@added("phonetic_cologne", rf"""
    WITH w AS (SELECT w, string_split(regexp_replace(replace(replace(replace(upper(replace(w, 'ß', 'ss')), 'Ä', 'A'), 'Ö', 'O'), 'Ü', 'U'), '[^A-Z]', '', 'g'), '') AS c FROM {WORDS}), d AS (
      SELECT w, [CASE
        WHEN c[i] = '' THEN '' WHEN contains('AEIJOUY', c[i]) THEN '0' WHEN c[i] = 'H' THEN '' WHEN c[i] = 'P' AND coalesce(c[i + 1], '') = 'H' THEN '3' WHEN c[i] IN ('B', 'P') THEN '1'
        WHEN c[i] IN ('D', 'T') THEN CASE WHEN coalesce(c[i + 1], '') IN ('C', 'S', 'Z') THEN '8' ELSE '2' END WHEN c[i] IN ('F', 'V', 'W') THEN '3' WHEN c[i] IN ('G', 'K', 'Q') THEN '4'
        WHEN c[i] = 'X' THEN CASE WHEN i > 1 AND c[i - 1] IN ('C', 'K', 'Q') THEN '8' ELSE 'x' END WHEN c[i] = 'L' THEN '5' WHEN c[i] IN ('M', 'N') THEN '6' WHEN c[i] = 'R' THEN '7' WHEN c[i] IN ('S', 'Z') THEN '8'
        WHEN c[i] = 'C' AND i = 1 THEN CASE WHEN coalesce(c[2], '') IN ('A', 'H', 'K', 'L', 'O', 'Q', 'R', 'U', 'X') THEN '4' ELSE '8' END
        WHEN c[i] = 'C' THEN CASE WHEN c[i - 1] IN ('S', 'Z') THEN '8' WHEN coalesce(c[i + 1], '') IN ('A', 'H', 'K', 'O', 'Q', 'U', 'X') THEN '4' ELSE '8' END ELSE '' END FOR i IN range(1, len(c) + 1)] AS d FROM w
    ), x AS (SELECT w, string_split(regexp_replace(regexp_replace(array_to_string(d, ''), '8x8*', '8y', 'g'), 'x8*', 'z', 'g'), '') AS d FROM d),
    once AS (SELECT w, replace(replace(array_to_string([d[i] FOR i IN range(1, len(d) + 1) IF i = 1 OR NOT contains('0123456789', d[i]) OR d[i] <> d[i - 1]], ''), 'y', '4'), 'z', '48') AS s FROM x)
    SELECT w, CASE WHEN s <> '' AND regexp_replace(s, '^0+', '') = '' THEN '0' ELSE regexp_replace(s, '^0+', '') END AS c, true AS same FROM once""")  # fmt: skip
def phonetic_cologne(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir).query("FOR x IN words RETURN {w: x.w, c: COLOGNE(x.w), same: COLOGNE_PHONETIC(x.w) == SOUNDEX(x.w, 'de')}")


@added("phonetic_metaphone", rf"""
    WITH w AS (SELECT w, string_split(regexp_replace(upper(replace(w, 'ß', 'ss')), '[^A-Z]', '', 'g'), '') AS c FROM {WORDS}), near AS (
      SELECT w, [{{'c': c[i], 'p': CASE WHEN i > 1 THEN c[i - 1] ELSE '' END, 'n': coalesce(c[i + 1], ''), 'm': coalesce(c[i + 2], ''), 'i': i,
                   'twice': i > 1 AND c[i] = c[i - 1] AND NOT contains('CAEIOU', c[i]),
                   'after': i > 2 AND c[i - 1] = c[i - 2] AND NOT contains('CAEIOU', c[i - 1])}} FOR i IN range(1, len(c) + 1) IF c[i] <> ''] AS l FROM w
    ), codes AS (SELECT w, [CASE
        WHEN x.c = 'H' AND contains('CSTPG', x.p) AND x.p <> '' AND NOT x.after THEN '' WHEN x.c = 'G' AND x.p = 'D' AND NOT x.after AND contains('EIY', x.n) AND x.n <> '' THEN ''
        WHEN x.i = 1 AND x.c || x.n IN ('KN', 'GN', 'PN', 'AE', 'WR') THEN '' WHEN x.twice THEN '' WHEN x.i = 1 AND contains('AEIOU', x.c) THEN x.c WHEN contains('AEIOU', x.c) THEN ''
        WHEN x.c = 'B' AND x.p = 'M' AND x.n = '' THEN '' WHEN x.c = 'G' AND x.n = 'H' AND x.m = 'T' THEN '' WHEN x.c = 'G' AND x.n = 'N' THEN '' WHEN x.c = 'H' AND x.p <> '' AND contains('AEIOU', x.p) THEN ''
        WHEN x.c IN ('H', 'W', 'Y') AND (x.n = '' OR NOT contains('AEIOU', x.n)) THEN '' WHEN x.c = 'K' AND x.p = 'C' THEN '' WHEN x.c IN ('C', 'S') AND x.n = 'H' THEN 'X' WHEN x.c IN ('S', 'T') AND x.n = 'I' AND x.m IN ('O', 'A') THEN 'X'
        WHEN x.c = 'C' AND x.n IN ('I', 'E', 'Y') THEN 'S' WHEN x.c IN ('S', 'Z') THEN 'S' WHEN x.c = 'D' AND x.n = 'G' AND x.m IN ('E', 'I', 'Y') THEN 'J' WHEN x.c = 'G' AND x.n IN ('E', 'I', 'Y') THEN 'J' WHEN x.c IN ('G', 'P') AND x.n = 'H' THEN 'F' WHEN x.c = 'V' THEN 'F'
        WHEN x.c = 'T' AND x.n = 'H' THEN '0' WHEN x.c IN ('C', 'G', 'Q') THEN 'K' WHEN x.c = 'D' THEN 'T' WHEN x.c = 'X' THEN 'KS' ELSE x.c END FOR x IN l] AS t FROM near)
    SELECT w, c, [c, c] AS d FROM (SELECT w, list_reduce(list_concat([''], t), lambda a, x: CASE WHEN length(a) >= 6 THEN a ELSE a || x END) AS c FROM codes)""")  # fmt: skip
def phonetic_metaphone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir).query("FOR x IN words RETURN {w: x.w, c: METAPHONE(x.w), d: DOUBLE_METAPHONE(x.w)}")


@added("phonetic_nysiis", rf"""
    WITH w AS (SELECT w, regexp_replace(upper(replace(w, 'ß', 'ss')), '[^A-Z]', '', 'g') AS s FROM {WORDS}), begun AS (SELECT w, CASE
        WHEN starts_with(s, 'MAC') THEN 'MCC' || s[4:] WHEN starts_with(s, 'KN') THEN 'NN' || s[3:] WHEN starts_with(s, 'K') THEN 'C' || s[2:] WHEN starts_with(s, 'PH') OR starts_with(s, 'PF') THEN 'FF' || s[3:] WHEN starts_with(s, 'SCH') THEN 'SSS' || s[4:] ELSE s END AS s FROM w
    ), ended AS (SELECT w, CASE WHEN right(s, 2) IN ('EE', 'IE') THEN s[:-3] || 'Y' WHEN right(s, 2) IN ('DT', 'RT', 'RD', 'NT', 'ND') THEN s[:-3] || 'D' ELSE s END AS s FROM begun
    ), near AS (SELECT w, s[1] AS first, [{{'c': s[i], 'p': s[i - 1], 'n': coalesce(s[i + 1], ''), 'm': coalesce(s[i + 2], ''), 'q': CASE WHEN i > 3 THEN s[i - 2] ELSE '' END, 'i': i}} FOR i IN range(2, length(s) + 1)] AS l FROM ended
    ), codes AS (SELECT w, first, [CASE
        WHEN x.c = 'H' AND x.i > 2 AND x.p IN ('S', 'P') THEN '' WHEN x.c = 'C' AND x.i > 2 AND x.p = 'S' AND x.n = 'H' THEN '' WHEN x.c = 'H' AND x.p = 'C' AND x.q = 'S' THEN ''
        WHEN contains('EIOU', x.c) THEN 'A' WHEN x.c = 'Q' THEN 'G' WHEN x.c = 'Z' THEN 'S' WHEN x.c = 'S' AND x.n = 'C' AND x.m = 'H' THEN 'SSS' WHEN x.c = 'S' THEN 'S' WHEN x.c = 'M' OR x.c = 'K' AND x.n = 'N' THEN 'N' WHEN x.c = 'K' THEN 'C' WHEN x.c = 'P' AND x.n = 'H' THEN 'F'
        WHEN x.c = 'H' AND contains('AEIOU', x.p) AND x.n <> '' AND contains('AEIOU', x.n) THEN 'H' WHEN x.c = 'H' OR x.c = 'W' AND contains('AEIOU', x.p) THEN x.p ELSE x.c END FOR x IN l] AS t FROM near
    ), made AS (SELECT w, list_reduce(list_concat([first], t), lambda a, x: CASE WHEN x = 'SSS' THEN a || 'SS' WHEN ends_with(a, x) THEN a ELSE a || x END) AS c FROM codes)
    SELECT w, regexp_replace(regexp_replace(regexp_replace(c, '(.)S$', '\1'), '(.)A$', '\1'), 'AY$', 'Y') AS c FROM made""")  # fmt: skip
def phonetic_nysiis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir).query("FOR x IN words RETURN {w: x.w, c: NYSIIS(x.w)}")


# -- dates, numbers

add("functions_date_more", """
    FOR o IN orders LET ms = DATE_TIMESTAMP(o.o_orderdate) RETURN {k: o.o_orderkey, a: DATE_ISO8601(ms), b: DATE_WEEK(o.o_orderdate), c: DATE_SUB(o.o_orderdate, 2, "days"), d: HUMAN_TIME(o.o_orderdate, ms + 90000), e: HUMAN_TIME(ms + 7200000, ms), f: NOW() > ms AND DATE_NOW() > ms,
      g: LENGTH(NOW_ISO()) == 24 AND LEFT(DATE_NOW_ISO(), 2) == "20", h: DATE_HOUR(o.o_orderdate), i: DATE_MINUTE(ms + 60000), j: DATE_SECOND(ms + 1000)}""", """
    SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(epoch_ms(o_orderdate) % 1000 AS VARCHAR), 3, '0') || 'Z' AS a, week(o_orderdate) AS b, strftime(o_orderdate - INTERVAL 2 DAY, '%Y-%m-%dT%H:%M:%S.000Z') AS c, '1 minute ago' AS d, 'in 2 hours' AS e, true AS f, true AS g,
      hour(o_orderdate) AS h, minute(o_orderdate + INTERVAL 1 MINUTE) AS i, second(o_orderdate + INTERVAL 1 SECOND) AS j FROM orders""")  # fmt: skip
add("functions_math_more", """
    FOR c IN customer LET x = ABS(c.c_acctbal) / 10000 LET a = [c.c_custkey % 7, c.c_custkey % 3, 4] RETURN {k: c.c_custkey, a: CEILING(c.c_acctbal), b: ROUND(POWER(x, 2), 9), c: ROUND(LN(x + 1), 9), d: ROUND(LOG2(x + 1), 9), e: ROUND(COS(x), 9), f: ROUND(TAN(x), 9), g: ROUND(ASIN(x), 9), h: ROUND(ACOS(x), 9), i: ROUND(ATAN(x), 9), j: ROUND(RADIANS(x), 9), l: ROUND(PI() + E(), 9),
      m: RANDOM() < 1 AND RAND() >= 0, n: RANDOM_INT(3, 5) IN [3, 4, 5] AND RAND_INT(2, 2) == 2, o: ROUND(AVERAGE(a), 9), p: ROUND(VAR_POP(a), 9), q: ROUND(VAR_SAMP(a), 9), r: ROUND(STDDEV_POP(a), 9), s: ROUND(STDDEV_SAMP(a), 9), t: ROUND(STDDEV_POPULATION(a), 9), u: COUNT_UNIQUE(a), v: UNIQUE_COUNT(a), w: TRUNCATE(c.c_acctbal), y: ROUND(PERCENTILE(a, 50), 9)}""", """
    SELECT k, ceil(b) AS a, round(pow(x, 2), 9) AS b, round(ln(x + 1), 9) AS c, round(log2(x + 1), 9) AS d, round(cos(x), 9) AS e, round(tan(x), 9) AS f, round(asin(x), 9) AS g, round(acos(x), 9) AS h, round(atan(x), 9) AS i, round(radians(x), 9) AS j, round(pi() + exp(1), 9) AS l,
      true AS m, true AS n, round(list_avg(a), 9) AS o, round(list_var_pop(a), 9) AS p, round(list_var_pop(a), 9) AS q, round(list_stddev_pop(a), 9) AS r, round(list_stddev_pop(a), 9) AS s, round(list_stddev_pop(a), 9) AS t, len(list_distinct(a)) AS u, len(list_distinct(a)) AS v, trunc(b) AS w, list_median(a) AS y
    FROM (SELECT c_custkey AS k, c_acctbal AS b, abs(c_acctbal) / 10000 AS x, [CAST(c_custkey % 7 AS DOUBLE), CAST(c_custkey % 3 AS DOUBLE), 4.0] AS a FROM customer)""")  # fmt: skip

# -- arrays, objects, kinds

add("functions_array_more", """
    FOR c IN customer LET a = [c.c_custkey % 7, c.c_custkey % 3, 4] RETURN {k: c.c_custkey, a: SORT(a), b: SORTED_DESC(a), c: POP(a), d: SHIFT(a), e: UNSHIFT(a, 9, 8), f: INDEX_OF(a, 4), g: DIFFERENCE(a, [4]), h: FIND_FIRST(a, x -> x > 3), i: a |> EVERY(x -> x < 5), j: a |> SOME(x -> x == 6), l: CONTAINS_ARRAY(a, 6), m: ZIP(a, [1, 2])[1][0], n: TAKE(a, 2), o: DROP(a, 2), p: APPEND(a, [7], 8), q: 1..3, r: (2..4)[1], s: FLATTEN([a, [5]])}""", """
    SELECT k, list_sort(a) AS a, list_reverse_sort(a) AS b, a[:2] AS c, a[2:] AS d, list_concat([9.0, 8.0], a) AS e, list_position(a, 4.0) - 1 AS f, [x FOR x IN a IF x <> 4] AS g, [x FOR x IN a IF x > 3][1] AS h, list_max(a) < 5 AS i, list_contains(a, 6.0) AS j, list_contains(a, 6.0) AS l, a[2] AS m, a[:2] AS n, a[3:] AS o, list_concat(a, [7.0, 8.0]) AS p, [1, 2, 3] AS q, 3 AS r, list_concat(a, [5.0]) AS s
    FROM (SELECT c_custkey AS k, [CAST(c_custkey % 7 AS DOUBLE), CAST(c_custkey % 3 AS DOUBLE), 4.0] AS a FROM customer)""")  # fmt: skip
add("functions_object_more", r"""
    FOR n IN nation LET o = {id: n.n_nationkey, name: n.n_name, in: {r: n.n_regionkey}} RETURN {k: n.n_nationkey, a: KEYS(o), b: VALUES({x: n.n_nationkey, y: n.n_regionkey}), c: UNSET(o, "name", "in"), d: PARSE_JSON("{\"a\": \"z\"}").a, e: JSON_STRINGIFY({a: n.n_nationkey, b: n.n_name}), f: TO_JSON([n.n_regionkey]), g: ENTRIES({q: n.n_name})[0].value,
      h: FROM_ENTRIES(ENTRIES({q: n.n_name})).q, i: MERGE_OBJECTS({a: 1}, {b: n.n_name}).b, j: MERGE_DEEP(o, {in: {s: 5}}).in.r, l: DEEP_MERGE(o, {in: {r: 7}}).in.r, m: GET(o, "in.r"), n: GET(o, "in.z", "none"), o: ZIP_OBJECTS(["u"], [n.n_name]).u, p: HAS_KEY(o, "in"), q: n?.n_name, r: o?.in?.r, s: n.nothing?.deep == null, t: JSON_PARSE(JSON_STRINGIFY_PRETTY({z: n.n_name})).z}""", r"""
    SELECT n_nationkey AS k, ['id', 'name', 'in'] AS a, [n_nationkey, n_regionkey] AS b, {'id': n_nationkey} AS c, 'z' AS d, '{"a":' || n_nationkey || ',"b":"' || n_name || '"}' AS e, '[' || n_regionkey || ']' AS f, n_name AS g, n_name AS h, n_name AS i, n_regionkey AS j, 7 AS l, n_regionkey AS m, 'none' AS n, n_name AS o, true AS p, n_name AS q, n_regionkey AS r, true AS s, n_name AS t FROM nation""")  # fmt: skip
add("functions_type_more", """
    FOR c IN customer LET a = [c.c_custkey] RETURN {k: c.c_custkey, a: IS_ARRAY(a) AND IS_LIST(a), b: IS_BOOL(c.c_acctbal > 0) AND IS_BOOLEAN(true), c: IS_NUMERIC(c.c_acctbal), d: IS_INT(c.c_acctbal), e: IS_OBJECT(c) AND IS_DOCUMENT({x: 1}), f: IS_EMPTY(c.c_name), g: TYPE_OF(a), h: TYPENAME(c), i: TO_NUM(RIGHT(c.c_name, 4)), j: TO_BOOLEAN(c.c_custkey % 2), l: TO_ARRAY(c.c_name), m: TO_LIST(a), n: NOT_NULL(c.nothing, c.c_name), o: FIRST_NOT_NULL(null, c.c_mktsegment),
      p: ASSERT(c.c_custkey >= 0, "negative"), q: IS_UUID(UUID()) AND IS_UUID(UUID_V4()) AND IS_UUID(UUIDV4()), r: SUBSTRING(UUID_V7(), 14, 1) == "7" AND LENGTH(UUIDV7()) == 36, s: LENGTH(ULID()) == 26 AND LENGTH(NANOID(9)) == 9, t: LENGTH(SHA512(c.c_name)), u: IS_NULL(c.nothing)}""", """
    SELECT c_custkey AS k, true AS a, true AS b, true AS c, c_acctbal = floor(c_acctbal) AS d, true AS e, false AS f, 'array' AS g, 'object' AS h, CAST(right(c_name, 4) AS DOUBLE) AS i, c_custkey % 2 = 1 AS j, [c_name] AS l, [c_custkey] AS m, c_name AS n, c_mktsegment AS o, true AS p, true AS q, true AS r, true AS s, 128 AS t, true AS u FROM customer""")  # fmt: skip
add("functions_crypto_more", """
    FOR c IN customer RETURN {k: c.c_custkey, a: HMAC_SHA256("k", c.c_name), b: TO_BASE64(c.c_name), c: FROM_BASE64(TO_BASE64(c.c_name)), d: TO_HEX(c.c_name), e: FROM_HEX(TO_HEX(c.c_name)), f: HEX_DECODE("4142")}""", f"""
    SELECT c_custkey AS k, sha256(unhex('{bytes(b ^ 0x5C for b in b"k".ljust(64, bytes(1))).hex()}') || unhex(sha256(unhex('{bytes(b ^ 0x36 for b in b"k".ljust(64, bytes(1))).hex()}') || encode(c_name)))) AS a, base64(encode(c_name)) AS b, c_name AS c, lower(hex(encode(c_name))) AS d, c_name AS e, 'AB' AS f FROM customer""")  # fmt: skip

# -- places, vectors, text search

HAVERSINE = "2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(lat - 48.9) / 2), 2) + cos(radians(48.9)) * cos(radians(lat)) * pow(sin(radians(lon - 2.4) / 2), 2))))"
PLACES_SQL = "(SELECT c_custkey, c_custkey % 90 + c_nationkey / 100.0 AS lat, CAST(c_custkey % 179 AS DOUBLE) AS lon FROM customer)"


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).catalog.table("customer").selectExpr("c_custkey", "c_custkey % 90 + c_nationkey / 100D AS lat", "CAST(c_custkey % 179 AS DOUBLE) AS lon")


add("geo_distance", "FOR c IN customer LET lat = c.c_custkey % 90 LET lon = c.c_nationkey * 7 RETURN {k: c.c_custkey, d: ROUND(DISTANCE(48.9, 2.4, lat, lon), 2)}", f"SELECT c_custkey AS k, round({HAVERSINE}, 2) AS d FROM (SELECT c_custkey, CAST(c_custkey % 90 AS DOUBLE) AS lat, c_nationkey * 7.0 AS lon FROM customer)")


@added("geo_near", f"SELECT c_custkey AS k, round({HAVERSINE}, 2) AS d FROM {PLACES_SQL} ORDER BY {HAVERSINE}, c_custkey LIMIT 15")
def geo_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.near(_places(spark, sf_dir), "lat", "lon", (48.9, 2.4), 15).select(F.col("c_custkey").alias("k"), F.round("distance", 2).alias("d"))


@added("geo_within", f"SELECT c_custkey AS k, round({HAVERSINE}, 2) AS d FROM {PLACES_SQL} WHERE {HAVERSINE} <= 4000000")
def geo_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.within_radius(_places(spark, sf_dir), "lat", "lon", (48.9, 2.4), 4_000_000).select(F.col("c_custkey").alias("k"), F.round("distance", 2).alias("d"))


add("vector_normalize", "FOR e IN embeddings LET n = VECTOR_NORMALIZE(e.embedding) RETURN {k: e.vec_id, s: ROUND(SUM(n), 5), f: ROUND(n[0], 5), l: LENGTH(n), z: LENGTH(VECTOR_NORMALIZE([0, 0]))}", """
    WITH v AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_sum([x * x FOR x IN v])) AS n FROM v)
    SELECT vec_id AS k, round(list_sum(v) / n, 5) AS s, round(v[1] / n, 5) AS f, len(v) AS l, 0 AS z FROM n""")  # fmt: skip
add("vector_statistics", 'LET s = VECTOR_INDEX_STATS("embeddings", "embedding") RETURN {n: s.vectors, m: s.missing, d: s.dimension, x: s.mixed, a: ROUND(s.mean_norm, 6)}', "SELECT count(embedding) AS n, count(*) - count(embedding) AS m, max(len(embedding)) AS d, min(len(embedding)) <> max(len(embedding)) AS x, round(avg(sqrt(list_sum([CAST(x AS DOUBLE) * x FOR x IN embedding]))), 6) AS a FROM embeddings")


@added("quantised_exact", f"""
    WITH v AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings), near AS (
      SELECT e.vec_id, round({COSINE}, 5) AS score FROM v e, v q WHERE q.vec_id = 1 ORDER BY {COSINE} DESC LIMIT 10) SELECT * FROM near""")  # fmt: skip
def quantised_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest by one-byte codes, of which forty times as many are ranked by their vectors."""
    df = engine(spark, sf_dir).catalog.table("embeddings")
    query = df.where("vec_id = 1").first().embedding
    coded, low, high = search.quantised(df, "embedding", len(query))
    return search.quantised_search(coded, low, high, "embedding", query, 10, rerank=40).select("vec_id", F.round("score", 5).alias("score"))


@added("vector_index", f"""
    WITH v AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings) SELECT e.vec_id, round({COSINE}, 5) AS score FROM v e, v q WHERE q.vec_id = 1 ORDER BY {COSINE} DESC, e.vec_id LIMIT 20""")  # fmt: skip
def vector_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search by lists of an index, all of which are probed, so that it must equal the exact one."""
    df, folder = engine(spark, sf_dir).catalog.table("embeddings"), scratch(spark)
    query = df.where("vec_id = 1").first().embedding
    index = search.VectorIndex.build(df, "embedding", f"{folder}/lists", lists=16)
    return index.search(query, 20, probes=16, order="vec_id").select("vec_id", F.round("score", 5).alias("score"))


WORD_LISTS = r"(SELECT doc_id, [x FOR x IN string_split_regex(trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}\x20\x09-\x0D]', '', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')), ' ') IF x <> ''] AS w FROM documents)"


@added("bm25_exact", rf"""
    WITH d AS {WORD_LISTS}, q AS (SELECT unnest(['the', 'thing', 'was']) AS t), c AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d), f AS (SELECT t, count(*) FILTER (list_contains(w, t)) AS df FROM d, q GROUP BY t),
    s AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / mean))) AS score FROM (SELECT *, CAST(len([x FOR x IN w IF x = t]) AS DOUBLE) AS tf FROM d, f, c) GROUP BY doc_id)
    SELECT doc_id, round(score, 6) AS score FROM s WHERE score > 0 ORDER BY s.score DESC, doc_id LIMIT 20""")  # fmt: skip
def bm25_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.bm25_search(engine(spark, sf_dir).catalog.table("documents"), "text", "the thing was", "doc_id", 20)
    return found.select("doc_id", F.round("score", 6).alias("score"))


HYBRID_SQL = rf"""
    WITH t AS (SELECT item_id, text, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM benchmark JOIN embeddings ON item_id = vec_id), q AS (SELECT v FROM t WHERE item_id = 1),
    near AS (SELECT e.item_id, {COSINE} AS s FROM t e, q ORDER BY s DESC, e.item_id LIMIT 100),
    w AS (SELECT item_id, [x FOR x IN string_split_regex(trim(regexp_replace(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}\s]', '', 'g'), '\s+', ' ', 'g')), ' ') IF x <> ''] AS words FROM t),
    found AS (SELECT item_id, CAST(list_sum([CASE WHEN x = 'was' THEN 10 WHEN levenshtein(x, 'was') <= 2 THEN 5 ELSE 0 END + CASE WHEN x = 'thing' THEN 10 WHEN levenshtein(x, 'thing') <= 2 THEN 5 ELSE 0 END FOR x IN words]) AS DOUBLE) AS f FROM w WHERE list_has_any(words, ['was', 'thing'])),
    both_ AS (SELECT coalesce(near.item_id, found.item_id) AS item_id, s, f FROM near FULL JOIN found ON near.item_id = found.item_id)"""


@added("hybrid_ranks", HYBRID_SQL + """,
    ranked AS (SELECT *, row_number() OVER (ORDER BY s DESC NULLS LAST, item_id) AS a, row_number() OVER (ORDER BY f DESC NULLS LAST, item_id) AS b FROM both_)
    SELECT item_id, round(CASE WHEN s IS NULL THEN 0 ELSE 1.0 / (60 + a) END + CASE WHEN f IS NULL THEN 0 ELSE 1.0 / (60 + b) END, 9) AS score, f AS text_score FROM ranked ORDER BY CASE WHEN s IS NULL THEN 0 ELSE 1.0 / (60 + a) END + CASE WHEN f IS NULL THEN 0 ELSE 1.0 / (60 + b) END DESC, item_id LIMIT 10""")  # fmt: skip
def hybrid_ranks(spark: SparkSession, sf_dir: str, fusion: str = "rrf") -> DataFrame:
    """The hundred nearest vectors and the hundred best texts, fused by their ranks, or by their scaled scores."""
    c = engine(spark, sf_dir).catalog
    both = c.table("benchmark").join(c.table("embeddings"), F.col("item_id") == F.col("vec_id")).select("item_id", "text", "embedding")
    query = c.table("embeddings").where("vec_id = 1").first().embedding
    found = search.hybrid_search(both, "item_id", "embedding", query, "text", "was thing", fusion=fusion)
    return found.select("doc.item_id", F.round("score", 9).alias("score"), "text_score")


@added("hybrid_weights", HYBRID_SQL + """,
    scaled AS (SELECT *, 0.5 * coalesce((s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()), 0) + 0.5 * coalesce(CASE WHEN max(f) OVER () > min(f) OVER () THEN (f - min(f) OVER ()) / (max(f) OVER () - min(f) OVER ()) WHEN f IS NOT NULL THEN 1 END, 0) AS t FROM both_)
    SELECT item_id, round(t, 9) AS score, f AS text_score FROM scaled ORDER BY t DESC, item_id LIMIT 10""")  # fmt: skip
def hybrid_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid_ranks(spark, sf_dir, "weighted")


# -- sources


@added("columnar_read", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity >= 45 AND (l_returnflag IN ('A', 'R') OR l_discount < 0.01) AND l_linenumber <> 2")
def columnar_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = {"and": [{"column": "l_quantity", "op": "gte", "value": 45}, {"or": [{"column": "l_returnflag", "op": "in", "value": ["A", "R"]}, {"column": "l_discount", "op": "lt", "value": 0.01}]}, {"column": "l_linenumber", "op": "ne", "value": 2}]}
    return Columnar(engine(spark, sf_dir).catalog, "lineitem").read(["l_orderkey", "l_quantity"], where)


@added("columnar_write", "SELECT CAST(o_orderkey AS BIGINT) AS k, o_totalprice AS p FROM orders WHERE o_totalprice >= 50000")
def columnar_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, writable=True)
    c, orders = Columnar(e.catalog, "prices"), e.catalog.table("orders").selectExpr("o_orderkey AS k", "o_totalprice AS p")
    c.insert(orders.where("k % 2 = 0"))
    c.insert(orders.where("k % 2 = 1"))
    return c.delete({"column": "p", "op": "lt", "value": 50000})


@added("sharded_scan", "SELECT c_custkey AS k, c_acctbal AS b FROM customer")
def sharded_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three shards, each with a replica of a part of the next."""
    e, folder = engine(spark, sf_dir), scratch(spark)
    customers = e.catalog.table("customer").withColumn("_key", F.col("c_custkey").cast("string"))
    for n in range(3):
        customers.where(f"c_custkey % 3 = {n} OR (c_custkey % 3 = {(n + 1) % 3} AND c_custkey % 2 = 0)").write.parquet(f"{folder}/shard{n}")
    e.catalog.add_shards("people", [f"{folder}/shard{n}" for n in range(3)])
    return e.query("FOR p IN people RETURN {k: p.c_custkey, b: p.c_acctbal}")


add("sample", 'LET s = SAMPLE("customer", 7) RETURN {n: LENGTH(UNIQUE(s[*].c_custkey)), all: LENGTH(SAMPLE("region", 99))}', "SELECT 7 AS n, (SELECT count(*) FROM region) AS all")


@added("import_export", "SELECT n_nationkey AS k, n_name AS n, 'edge' AS t, (SELECT count(*) FROM region) AS regions FROM nation")
def import_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection to lines of JSON with its kind and back, and a file that is one JSON array."""
    e, folder = engine(spark, sf_dir, writable=True), scratch(spark)
    e.catalog.replace("links", e.catalog.table("nation"), "edge")
    transfer.export_jsonl(e.catalog, "links", f"{folder}/links")
    transfer.import_export(e.catalog, "copied", f"{folder}/links")
    names = [r.r_name for r in e.catalog.table("region").collect()]
    spark.createDataFrame([(json.dumps([{"n": n} for n in names]),)], "value string").coalesce(1).write.text(f"{folder}/array")
    e.catalog.add("regions", transfer.import_json(spark, f"{folder}/array", lines=False, schema="n string"))
    return e.query(f'FOR c IN copied RETURN {{k: c.n_nationkey, n: c.n_name, t: "{e.catalog.kinds["copied"]}", regions: COLLECTION_COUNT("regions")}}')


@added("import_mixed", """
    SELECT 'document' AS w, n_name AS k, CAST(n_nationkey AS BIGINT) AS n, NULL AS d FROM nation
    UNION ALL SELECT 'chunk', n_name, i, md5(n_name || chr(10) || i) FROM nation, range(2) t(i)""")  # fmt: skip
def import_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents between chunks of bytes that hold line ends themselves; one chunk in two is in base 64."""
    folder = scratch(spark)
    line = """concat_ws('\\n', to_json(named_struct('_key', n_name, 'n', n_nationkey)),
        to_json(named_struct('_type', 'blob_chunk', '_doc_key', n_name, '_chunk_index', 0, '_data_length', octet_length(n_name) + 2)), concat(n_name, '\\n0'),
        to_json(named_struct('_type', 'blob_chunk', '_doc_key', n_name, '_chunk_index', 1, '_blob_data', base64(concat(n_name, '\\n1')))))"""
    engine(spark, sf_dir).catalog.table("nation").selectExpr(f"{line} AS value").repartition(2).write.text(f"{folder}/mixed")
    documents, chunks = transfer.import_mixed(spark, f"{folder}/mixed", "_key string, n long")
    rows = documents.selectExpr("'document' AS w", "_key AS k", "n", "CAST(NULL AS string) AS d")
    return rows.unionByName(chunks.selectExpr("'chunk' AS w", "doc_key AS k", "chunk_index AS n", "md5(data) AS d"))


@added("export_shards", "SELECT CAST(c_custkey AS BIGINT) AS k, 'document' AS t, CAST(2 AS BIGINT) AS shards, '_key' AS by FROM customer")
def export_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, folder = engine(spark, sf_dir), scratch(spark)
    for n in range(2):
        e.catalog.table("customer").where(f"c_custkey % 2 = {n}").selectExpr("*", "CAST(c_custkey AS string) AS _key").write.parquet(f"{folder}/shard{n}")
    e.catalog.add_shards("people", [f"{folder}/shard{n}" for n in range(2)])
    transfer.export_jsonl(e.catalog, "people", f"{folder}/out")
    return transfer.import_json(spark, f"{folder}/out").selectExpr("c_custkey AS k", "_collectionType AS t", "_shardConfig.num_shards AS shards", "_shardConfig.shard_key AS by")


@added("bloom_lookup", "SELECT c_custkey AS k, c_name AS n FROM customer WHERE c_name = 'Customer#000000007'")
def bloom_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, writable=True)
    e.catalog.replace("people", e.catalog.table("customer"), membership=("c_name",))
    return e.query('FOR p IN people FILTER p.c_name == "Customer#000000007" RETURN {k: p.c_custkey, n: p.c_name}')


@added("cursor_pages", "SELECT CAST(count(*) AS BIGINT) AS rows, CAST(ceil(count(*) / 400.0) AS BIGINT) AS pages FROM customer")
def cursor_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    sizes = [len(p) for p in e.pages(e.query("FOR c IN customer RETURN {k: c.c_custkey}"), 400)]
    return spark.createDataFrame([(sum(sizes), len(sizes))], "rows long, pages long")


# -- writes


@added("insert_range", "SELECT CAST(i AS BIGINT) AS n, i % 7 AS m FROM range(0, 6000) t(i)")
def insert_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, writable=True)
    e.query("FOR i IN 0..5999 INSERT {n: i, m: i % 7} INTO nums")
    return e.query("FOR x IN nums RETURN {n: x.n, m: x.m}")


@added("mutation_counts", """
    SELECT 'insert' AS w, count(*) AS inserted, 0 AS updated, 0 AS removed FROM customer UNION ALL SELECT 'update', 0, count(*) FILTER (c_acctbal < 0), 0 FROM customer
    UNION ALL SELECT 'remove', 0, 0, count(*) FILTER (c_nationkey = 3) FROM customer UNION ALL SELECT 'upsert', 1, 1, 0""")  # fmt: skip
def mutation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, writable=True)
    said = {
        "insert": 'FOR c IN customer INSERT {_key: TO_STRING(c.c_custkey), b: c.c_acctbal, n: c.c_nationkey} INTO people',
        "update": "FOR p IN people FILTER p.b < 0 UPDATE p WITH {b: 0.0} IN people",
        "remove": "FOR p IN people FILTER p.n == 3 REMOVE p IN people",
        "upsert": 'FOR k IN ["none", "new"] LET key = k == "new" ? "n1" : FIRST((FOR p IN people SORT p._key LIMIT 1 RETURN p._key)) UPSERT key INSERT {_key: key, b: 1.0} UPDATE {b: 2.0} IN people',
    }
    rows = [(w, *e.query(text).first()) for w, text in said.items()]
    return spark.createDataFrame(rows, "w string, inserted long, updated long, removed long")


@added("upkeep", """
    SELECT 'pruned' AS w, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' UNION ALL SELECT 'expired', count(*) FILTER (o_orderkey % 2 = 0) FROM orders
    UNION ALL SELECT 'twice', count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'truncated', 0""")  # fmt: skip
def upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys with a time pruned, documents past their time to live expired, values that a unique index would refuse, truncation."""
    e = engine(spark, sf_dir, writable=True)
    orders = e.catalog.table("orders").withColumn("ms", F.unix_millis(F.col("o_orderdate").cast("timestamp")))
    key = F.concat(F.substring(F.lpad(F.hex("ms"), 12, "0"), 1, 8), F.lit("-"), F.substring(F.lpad(F.hex("ms"), 12, "0"), 9, 4), F.lit("-7000-a000-"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"))
    e.catalog.replace("log", orders.select(F.lower(key).alias("_key"), F.expr("CASE WHEN o_orderkey % 2 = 0 THEN unix_millis(current_timestamp()) ELSE 0 END AS at"), "o_custkey"))
    pruned = mutations.prune(e.catalog, "log", 788_918_400_000).count()
    e.catalog.replace("log", e.catalog.table("orders").selectExpr("CASE WHEN o_orderkey % 2 = 0 THEN unix_millis(current_timestamp()) ELSE 0 END AS at", "o_custkey"))
    expired = mutations.expire(e.catalog, "log", "at", 3600).count()
    twice = mutations.unique_violations(e.catalog.table("orders"), "o_custkey").count()
    return spark.createDataFrame([("pruned", pruned), ("expired", expired), ("twice", twice), ("truncated", e.catalog.truncate("log").count())], "w string, n long")


@added("unique_index", "SELECT c_custkey AS k, c_name AS n, true AS refused FROM customer")
def unique_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A unique index takes all customers and refuses one more of the same name."""
    from ..functions.values import QueryError

    e = engine(spark, sf_dir, writable=True)
    e.catalog.unique["people"] = [("n",)]
    e.query('FOR c IN customer INSERT {_key: TO_STRING(c.c_custkey), k: c.c_custkey, n: c.c_name} INTO people')
    try:
        e.query('INSERT {_key: "again", k: -1, n: "Customer#000000001"} INTO people')
        refused = False
    except QueryError:
        refused = True
    return e.query(f"FOR p IN people RETURN {{k: p.k, n: p.n, refused: {str(refused).lower()}}}")


@added("edge_check", "SELECT count(*) FILTER (c_nationkey = 3) AS bad, count(*) AS edges FROM customer")
def edge_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = engine(spark, sf_dir).catalog.table("customer").selectExpr("concat('c/', c_custkey) AS _from", "CASE WHEN c_nationkey <> 3 THEN concat('n/', c_nationkey) END AS _to")
    return spark.createDataFrame([(graph.invalid_edges(edges).count(), edges.count())], "bad long, edges long")


# -- streams, own functions, SQL


def _stream(spark: SparkSession, sf_dir: str):
    """An engine whose `changes` are the events as inserts and every seventh one as a deletion, in files that arrive one by one."""
    e, folder = engine(spark, sf_dir), scratch(spark)
    doc = "named_struct('id', event_id, 'k', event_type, 'v', value, 'at', date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\"))"
    e.catalog.table("events").selectExpr("CASE WHEN event_id % 7 = 0 THEN 'delete' WHEN event_id % 7 = 1 THEN 'update' ELSE 'insert' END AS type", f"{doc} AS new").repartition(3).write.json(f"{folder}/changes")
    e.streams["changes"] = transfer.change_feed(spark, f"{folder}/changes", "type string, new struct<id:long,k:string,v:double,at:timestamp>")
    e.stream_options = streams.Options(trigger={"availableNow": True}, folder=f"{folder}/out")
    return e, folder


@added("change_feed", "SELECT event_id AS id, event_type AS k, round(value * 2, 3) AS v FROM events WHERE event_id % 7 <> 0 AND value > 20")
def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CREATE STREAM over a feed of inserts, updates and deletions, started twice: the second start finds nothing new."""
    e, folder = _stream(spark, sf_dir)
    for _ in range(2):
        e.query("CREATE STREAM big AS FOR c IN changes FILTER c.v > 20 RETURN {id: c.id, k: c.k, v: ROUND(c.v * 2, 3)}").awaitTermination()
    return spark.read.parquet(f"{folder}/out/big/rows")


@added("stream_sliding", """
    SELECT event_type AS k, w AS at, count(*) AS n FROM (SELECT event_type, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS w FROM events) GROUP BY ALL""")  # fmt: skip
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_stream(spark, sf_dir, 'FOR e IN events WINDOW SLIDING (SIZE "2h", SLIDE "1h") COLLECT k = e.event_type WITH COUNT INTO n RETURN {k, at: window_start, n}')


@added("live_query_and_trigger", "SELECT (SELECT count(*) FROM nation) AS live, count(*) FILTER (event_id % 7 = 0) AS deleted, true AS stopped FROM events")
def live_query_and_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query that runs again on every change, a trigger on deletions, and a stream that is listed and stopped."""
    e, folder = _stream(spark, sf_dir)
    seen, acted, now = [], [], {"availableNow": True}
    streams.live_query(e, "FOR n IN nation COLLECT WITH COUNT INTO n RETURN n", e.streams["changes"], lambda df: seen.append(df.first()[0]), folder, now).awaitTermination()
    streams.on_change(e.streams["changes"], lambda df, _: acted.append(df.count()), ("delete",), folder, now).awaitTermination()
    e.stream_options = streams.Options(folder=f"{folder}/kept")
    q = e.query("CREATE STREAM listed AS FOR c IN changes RETURN {id: c.id}")
    stopped = "listed" in streams.running(e) and streams.stop(e, "listed") and not streams.stop(e, "listed")
    q.awaitTermination()
    return spark.createDataFrame([(seen[-1], sum(acted), stopped)], "live long, deleted long, stopped boolean")


@added("own_function", "SELECT p_partkey AS k, upper(p_name) || '!' AS s FROM part")
def own_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import types as T

    registry.register("SHOUTED", lambda s: F.concat(F.upper(s), F.lit("!")), T.StringType())
    return engine(spark, sf_dir).query("FOR p IN part RETURN {k: p.p_partkey, s: SHOUTED(p.p_name)}")


@added("sql_placeholders", "SELECT o_orderpriority AS p, count(*) AS n FROM orders WHERE o_totalprice > 100000 AND o_orderstatus IN ('F', 'O') GROUP BY 1 HAVING count(*) > 3 ORDER BY 1 LIMIT 4 OFFSET 1")
def sql_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).sql("SELECT o_orderpriority AS p, count(*) AS n FROM orders WHERE o_totalprice > :low AND o_orderstatus IN (:a, :b) GROUP BY o_orderpriority HAVING count(*) > 3 ORDER BY p LIMIT 4 OFFSET 1", low=100000, a="F", b="O")


@added("anti_some", "SELECT c_custkey AS k FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000 AND o_orderstatus = 'F')")
def anti_some(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).query("""
        FOR c IN customer FILTER LENGTH((FOR o IN orders FILTER o.o_custkey == c.c_custkey AND o.o_totalprice > 300000 AND o.o_orderstatus == "F" RETURN 1)) == 0 RETURN {k: c.c_custkey}""")


add("subquery_theta_grouped", """
    FOR n IN nation LET above = (FOR c IN customer FILTER c.c_nationkey == n.n_nationkey AND c.c_acctbal > n.n_nationkey * 300 JOIN orders ON orders.o_custkey == c.c_custkey COLLECT s = c.c_mktsegment WITH COUNT INTO m FILTER m > 1 SORT s LIMIT 3 RETURN $"${s}:${m}")
    RETURN {k: n.n_nationkey, above, most: MAX((FOR c IN customer FILTER c.c_acctbal < n.n_nationkey * 100 COLLECT s = c.c_mktsegment WITH COUNT INTO m RETURN m))}""", """
    WITH one AS (SELECT n_nationkey AS k, c_mktsegment AS s, count(*) AS m FROM nation JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > n_nationkey * 300 WHERE c_custkey IN (SELECT o_custkey FROM orders) GROUP BY 1, 2),
    two AS (SELECT n_nationkey AS k, c_mktsegment, count(*) AS m FROM nation JOIN customer ON c_acctbal < n_nationkey * 100 GROUP BY 1, 2)
    SELECT n_nationkey AS k, coalesce((SELECT list(s || ':' || m ORDER BY s)[:3] FROM one WHERE one.k = n_nationkey AND m > 1), []) AS above, (SELECT CAST(max(m) AS DOUBLE) FROM two WHERE two.k = n_nationkey) AS most FROM nation""")  # fmt: skip
add("subquery_plain", "FOR r IN region LET ns = FOR n IN nation FILTER n.n_regionkey == r.r_regionkey RETURN n.n_nationkey RETURN {k: r.r_regionkey, n: LENGTH(ns), s: SUM(ns)}", "SELECT r_regionkey AS k, count(n_nationkey) AS n, CAST(coalesce(sum(n_nationkey), 0) AS DOUBLE) AS s FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")


@added("document_keys", "SELECT s_suppkey AS k, [n_name, 'NATION_1'] AS ns FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def document_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    keyed(e, "nation", "n_nationkey")
    return e.query('FOR s IN supplier RETURN {k: s.s_suppkey, ns: DOCUMENT("nation_docs", [TO_STRING(s.s_nationkey), "1", "zz"])[*].n_name}')
