"""Format-preserving pseudonyms for personal numbers, dates and addresses by a keyed Feistel network.

A value found by its pattern is checked: card numbers by their check digit, social security
numbers and telephone numbers by their ranges, network addresses by their parts, dates by the
calendar. A checked value becomes a row of small numbers, each with its own range: digits, parts
or a day count. Eight rounds add to each number of one half a keyed hash of the other half, modulo
its range. This is a permutation of the values of that format, so equal values have equal
pseudonyms in every document, different ones differ, and ``restore`` with the key undoes it. A
card number gets a fresh check digit; punctuation, country codes, top-level domains and the capitals
of an e-mail address stay, so one address has one pseudonym in capitals or not. The key itself is
in no plan: a keyed hash of it is, and that is left out where plans are shown or logged.

Kinds: card (13 to 19 digits, in groups or not), ssn (3-2-4 digits), phone (ten digits of the North
American plan, in its usual ways of writing), ip, date (year-month-day, day.month.year or
month/day/year, from 1900 to 2099), email, and key (access keys, and the values of password, token,
secret and api key fields). What fails its check stays as it is.

All of it is DataFrame functions. A null text stays null, an empty one empty. Texts are read
whole. Repeated rows and values are treated alike. An empty table gives no rows. Columns other
than the text, and n_chars where it is asked for, are passed on or ignored.
"""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import pick, place_of

ROUNDS = 8

# Patterns of the kinds, in the order they are tried.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}(?![A-Za-z0-9])"
KEY = r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|(?i:(?<=password)|(?<=passwd)|(?<=token)|(?<=secret)|(?<=api_key)|(?<=apikey)) {0,2}[=:] {0,2}[\"']?[A-Za-z0-9_+/-]{8,}"
DATE = r"(?<![0-9./-])(?:(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9]|[0-3][0-9]\.[01][0-9]\.(?:19|20)[0-9]{2}|[01][0-9]/[0-3][0-9]/(?:19|20)[0-9]{2})(?![0-9]|[./-][0-9])"
IP = r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])"
PHONE = r"(?<![0-9A-Za-z+-])(?:\+?1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}(?![0-9]|-[0-9])"
SSN = r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9]|-[0-9])"
CARD = r"(?<![0-9A-Za-z-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z]|-[0-9])"
KINDS = [("email", EMAIL), ("key", KEY), ("date", DATE), ("ip", IP), ("phone", PHONE), ("ssn", SSN), ("card", CARD)]
ANY = "|".join(p for _, p in KINDS)
#: A text without such a character, or none of these words, holds no value.
HINT = r"[0-9@]|(?i:password|passwd|token|secret|api_?key)"


def _quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _permute(values: str, bases: str, sizes: str, kind: str, key: str, back: bool) -> str:
    """SQL for the Feistel rounds over arrays of numbers; number i ranges over bases[i] + [0, sizes[i])."""
    half = "CASE WHEN r % 2 = 0 THEN slice(acc, size(acc) div 2 + 1, size(acc)) ELSE slice(acc, 1, size(acc) div 2) END"
    mix = f"CAST(conv(substr(sha2(concat_ws('|', {_quote(key)}, '{kind}', CAST(r AS STRING), CAST(i AS STRING), array_join(CAST({half} AS ARRAY<STRING>), ',')), 256), 1, 10), 16, 10) AS BIGINT)"
    sign = "-" if back else "+"
    step = f"transform(acc, (x, i) -> CASE WHEN (i < size(acc) div 2) = (r % 2 = 0) AND {sizes}[i] > 1 THEN {bases}[i] + pmod(x - {bases}[i] {sign} {mix}, {sizes}[i]) ELSE x END)"
    order = f"sequence({ROUNDS - 1}, 0, -1)" if back else f"sequence(0, {ROUNDS - 1})"
    return f"aggregate({order}, {values}, (acc, r) -> {step})"


def _with(bindings: list[tuple[str, str]], body: str) -> str:
    """SQL that gives names to expressions: each is the one element of an array that is transformed."""
    for name, expr in reversed(bindings):
        body = f"element_at(transform(array({expr}), {name} -> {body}), 1)"
    return body


def _characters(kind: str, key: str, back: bool, fixed: str, narrow: str = "false") -> str:
    """SQL for a value m whose letters and digits are permuted in their class. ``fixed``: SQL over
    the place i from 0 and the character c where it stays; ``narrow``: where a digit ranges from 2 to 9."""
    chars = "transform(sequence(1, length(m)), k -> substring(m, k, 1))"
    size = f"transform(cs, (c, i) -> CAST(CASE WHEN {fixed} THEN 1 WHEN {narrow} THEN 8 WHEN c RLIKE '[0-9]' THEN 10 WHEN c RLIKE '[A-Za-z]' THEN 26 ELSE 1 END AS BIGINT))"
    base = f"transform(cs, (c, i) -> CAST(CASE WHEN {narrow} THEN 50 WHEN c RLIKE '[0-9]' THEN 48 WHEN c RLIKE '[a-z]' THEN 97 ELSE 65 END AS BIGINT))"
    code = "transform(cs, c -> CAST(ascii(c) AS BIGINT))"
    return _with([("cs", chars), ("ss", size), ("bs", base), ("vs", code)], f"array_join(transform({_permute('vs', 'bs', 'ss', kind, key, back)}, x -> char(x)), '')")


#: SQL for the sum of a card number's digits as its check counts them; d: the digits as an array, the last first.
_LUHN = "aggregate(transform(d, (x, i) -> CASE WHEN i % 2 = 0 THEN x WHEN x > 4 THEN 2 * x - 9 ELSE 2 * x END), 0, (s, x) -> s + x)"
_DIGITS = "transform(sequence(1, length(n)), k -> CAST(substring(n, length(n) + 1 - k, 1) AS INT))"


def _luhn(text: str) -> str:
    return _with([("n", f"regexp_replace({text}, '[^0-9]', '')"), ("d", _DIGITS)], f"{_LUHN} % 10")


def _written(digits: str) -> str:
    """SQL for a match m with its digits replaced, in their order, by those of another expression."""
    nth = "length(regexp_replace(substring(m, 1, k), '[^0-9]', ''))"
    return _with([("o", digits)], f"array_join(transform(sequence(1, length(m)), k -> CASE WHEN substring(m, k, 1) RLIKE '[0-9]' THEN substring(o, {nth}, 1) ELSE substring(m, k, 1) END), '')")


def _value(key: str, back: bool) -> str:
    """SQL for the pseudonym of a match m, or m where its check fails."""
    numbers = lambda *x: f"array({', '.join(f'CAST({v} AS BIGINT)' for v in x)})"
    zero = lambda n: f"array_repeat(0L, {n})"
    # An address is the same in capitals, which stay where they were.
    low = _with([("w", "lower(m)"), ("m", "w")], _characters("email", key, back, "i >= length(m) - locate('.', reverse(m))"))
    email = _with([("o", low)], "array_join(transform(sequence(1, length(m)), k -> CASE WHEN substring(m, k, 1) RLIKE '[A-Z]' THEN upper(substring(o, k, 1)) ELSE substring(o, k, 1) END), '')")
    secret = _characters("key", key, back, "i < length(regexp_extract(m, '^(?:AKIA| {0,2}[=:] {0,2}[\"\\']?)', 0))")
    # A number's digits are permuted by themselves, so all ways of writing it have one pseudonym.
    number = "regexp_replace(m, '[^0-9]', '')"
    phone = _with([("n", number), ("m", "right(n, 10)")], f"concat(substring(n, 1, length(n) - 10), {_characters('phone', key, back, 'false', 'i IN (0, 3)')})")
    payload = _with([("n", number), ("m", "substring(n, 1, length(n) - 1)")], _characters("card", key, back, "false"))
    card = _with([("p", f"concat({payload}, '0')")], "concat(substring(p, 1, length(p) - 1), CAST(pmod(10 - " + _luhn("p") + ", 10) AS STRING))")
    phone, card = _written(phone), _written(card)
    parts = "transform(split(m, '[.]'), x -> CAST(x AS BIGINT))"
    ip = _with([("vs", parts)], f"array_join(CAST({_permute('vs', zero(4), 'array_repeat(256L, 4)', 'ip', key, back)} AS ARRAY<STRING>), '.')")
    # Areas 000, 666 and 900 to 999 are none, nor is group 00 or serial 0000.
    area = "CAST(substring(m, 1, 3) AS INT)"
    rows = numbers(f"CASE WHEN {area} > 666 THEN {area} - 2 ELSE {area} - 1 END", "CAST(substring(m, 5, 2) AS INT) - 1", "CAST(substring(m, 8, 4) AS INT) - 1")
    ssn = _with(
        [("vs", rows), ("ys", _permute("vs", zero(3), numbers(898, 99, 9999), "ssn", key, back))],
        "concat(lpad(CAST(CASE WHEN ys[0] >= 665 THEN ys[0] + 2 ELSE ys[0] + 1 END AS STRING), 3, '0'), '-', lpad(CAST(ys[1] + 1 AS STRING), 2, '0'), '-', lpad(CAST(ys[2] + 1 AS STRING), 4, '0'))",
    )
    # From 1900 to 2099 there are 73,049 = 17 * 4,297 days.
    iso = "CASE WHEN m LIKE '%-%' THEN m WHEN m LIKE '%.%' THEN concat(substring(m, 7, 4), '-', substring(m, 4, 2), '-', substring(m, 1, 2)) ELSE concat(substring(m, 7, 4), '-', substring(m, 1, 2), '-', substring(m, 4, 2)) END"
    shape = "CASE WHEN m LIKE '%-%' THEN 'yyyy-MM-dd' WHEN m LIKE '%.%' THEN 'dd.MM.yyyy' ELSE 'MM/dd/yyyy' END"
    days = f"datediff(try_cast({iso} AS DATE), DATE'1900-01-01')"
    date = _with(
        [("n", days), ("ys", _permute(numbers("n div 4297", "n % 4297"), zero(2), numbers(17, 4297), "date", key, back)), ("t", "date_add(DATE'1900-01-01', CAST(ys[0] * 4297 + ys[1] AS INT))")],
        f"CASE WHEN n IS NULL THEN m WHEN m LIKE '%-%' THEN date_format(t, 'yyyy-MM-dd') WHEN m LIKE '%.%' THEN date_format(t, 'dd.MM.yyyy') ELSE date_format(t, 'MM/dd/yyyy') END",
    )
    del shape
    how = {"email": email, "key": secret, "date": date, "ip": ip, "phone": phone, "ssn": ssn, "card": f"CASE WHEN {_luhn('m')} = 0 THEN {card} ELSE m END"}
    # A match stands alone here, so what its pattern asks of the text around it is left out.
    alone = {"key": r"AKIA[0-9A-Z]{16}| {0,2}[=:].*"}
    cases = " ".join(f"WHEN m RLIKE {_quote('^(?:' + alone.get(k, p) + ')$')} THEN {how[k]}" for k, p in KINDS)
    return f"CASE {cases} ELSE m END"


def _replaced(text: Column | str, key: str, back: bool) -> tuple[Column, Column]:
    """(new text, number of values that changed) of a text column."""
    name = text if isinstance(text, str) else None
    quoted = f"`{name}`"
    found = F.expr(f"transform(regexp_extract_all({quoted}, {_quote(ANY)}, 0), m -> named_struct('was', m, 'now', {_value(key, back)}))")
    return found, F.expr(f"split({quoted}, {_quote(ANY)}, -1)")


def _hidden(spark: SparkSession, key: str) -> str:
    """What stands for the key in a plan: a keyed hash, which the session is told to leave out of
    explained plans, event logs and the user interface."""
    name, mark = "spark.sql.redaction.string.regex", "pseudonym-key-[0-9a-f]{64}"
    there = spark.conf.get(name, None)
    if mark not in (there or ""):
        spark.conf.set(name, f"{there}|{mark}" if there else mark)
    return "pseudonym-key-" + hmac.new(key.encode(), b"quillspark pseudonyms", hashlib.sha256).hexdigest()


def _apply(docs: DataFrame, text: str, key: str, back: bool) -> DataFrame:
    """``docs`` (columns c0, c1..) with the text replaced and the columns __values and __old."""
    found, pieces = _replaced(text, _hidden(docs.sparkSession, key), back)
    some = F.col(text).rlike(HINT)
    out = docs.withColumn("__found", F.when(some, found)).withColumn("__pieces", F.when(some, pieces))
    joined = F.expr("array_join(zip_with(__pieces, __found, (p, f) -> concat(p, coalesce(f.now, ''))), '')")
    out = out.withColumn("__old", F.col(text)).withColumn(text, F.when(F.size("__found") > 0, joined).otherwise(F.col(text)))
    changed = F.coalesce(F.size(F.filter("__found", lambda f: f["was"] != f["now"])), F.lit(0))
    return out.withColumn("__values", F.greatest(changed, F.lit(0)).cast("long")).drop("__found", "__pieces")


def pseudonymise(docs: DataFrame, key: str, back: bool = False) -> DataFrame:
    """One row per document: doc_id, text with pseudonyms, n_values that were replaced."""
    own = pick(docs, "doc_id", "text")
    return _apply(own, "text", key, back).select("doc_id", "text", F.col("__values").alias("n_values"))


def restore(docs: DataFrame, key: str) -> DataFrame:
    """The inverse of ``pseudonymise`` under the same key."""
    return pseudonymise(docs, key, back=True)


def protect(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with pseudonyms in the text; same rows and columns, n_chars counted anew where the text
    changed. Null and empty texts stay as they are, repeated rows stay alike, an empty table gives none."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    lower = [c.lower() for c in docs.columns]
    at = names[place_of(docs, "text")]
    out = _apply(docs.toDF(*names), at, key, False)
    if "n_chars" in lower:
        n = names[place_of(docs, "n_chars")]
        out = out.withColumn(n, F.when(F.col("__values") > 0, F.length(at).cast(dict(out.dtypes)[n])).otherwise(F.col(n)))
    return out.select(*names).toDF(*docs.columns)
