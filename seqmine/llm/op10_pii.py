"""PII: format-preserving Feistel pseudonyms. DataFrame functions only, no shuffle.

What a pattern finds is validated first: payment-card numbers (13 to 19 digits, Luhn), account numbers (IBAN, mod
97), social-security numbers, telephone numbers, IPv4 addresses, calendar dates from 1901 to 2096, and the local
parts of e-mail addresses. A valid value is permuted within its format by a keyed alternating Feistel network, so
equal values get equal pseudonyms in all documents and different values different ones: digits stay digits at
their places, separators stay, check digits are computed anew, an octet stays below 256, and a date stays a date
of the same 28-year cycle (10,227 days = 21 x 487, so the network needs no cycle walking). Values that fail their
validation stay as they are.

The round function is SHA-512 over key, kind, round and the other half. Whoever has the key can invert the
network; take it from a secret store.

Defined results: a null text stays null and an empty one empty, both with counts of zero; null ids and repeated
rows are kept; an empty table gives no rows; other columns, whatever their names, pass by in `protect`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "iban", "date", "ip", "ssn", "phone", "card")
DIGITS = "0123456789"
ALPHABET = DIGITS + "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}"
_PATTERNS = {
    "email": _EMAIL,
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)(?![A-Za-z0-9])",
    "date": r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}|[0-9]{1,2}([./-])[0-9]{1,2}\1[0-9]{4})(?![0-9A-Za-z/-]|\.[0-9])",
    "ip": r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?\([0-9]{1,4}\)[ .-]?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){3,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}([ .-])[0-9]{3}\2[0-9]{4})(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\3[0-9]{4}\3[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\4[0-9]{5})(?![0-9A-Za-z])",
}
PATTERN = "|".join(_PATTERNS.values())


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def feistel(values: Column, radix: Column | int, key: Column, tweak: Column, rounds: int = 10) -> Column:
    """A keyed permutation of the arrays of this length (64 values at most, each from 0 to radix - 1). Of a single
    value, whose other half is empty, it is a keyed shift."""
    if rounds % 2:
        raise ValueError("the halves only change places again after an even number of rounds")
    kind = "struct<a:array<int>,b:array<int>>"
    radix = F.lit(radix) if isinstance(radix, int) else radix

    def turn(s: Column, i: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", key, tweak, i.cast("string"), F.concat_ws(",", s["b"].cast("array<string>"))), 512)
        moved = _let(digest, lambda d: F.transform(s["a"], lambda x, j: F.pmod(x + F.conv(F.substring(d, j * 4 + 1, F.lit(4)), 16, 10).cast("int"), radix)))
        return F.struct(s["b"].alias("a"), moved.alias("b")).cast(kind)

    half = F.floor(F.size(values) / 2).cast("int")
    start = F.struct(F.slice(values, F.lit(1), half).alias("a"), F.slice(values, half + 1, F.size(values) - half).alias("b")).cast(kind)
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, turn, lambda s: F.concat(s["a"], s["b"]))


def _digits(s: Column) -> Column:
    """The digits of s as an array; empty for none."""
    only = F.regexp_replace(s, "[^0-9]", "")
    return F.transform(F.filter(F.split(only, ""), lambda c: c != ""), lambda c: c.cast("int"))


def _refill(template: Column, values: Column, alphabet: str, places: str) -> Column:
    """template with the characters at its places (a class) replaced by the values, one after another."""
    chars = F.filter(F.split(template, ""), lambda c: c != "")
    other = f"[^{places}]"
    return F.array_join(
        F.transform(
            chars,
            lambda c, j: F.when(c.rlike(f"[{places}]"), F.substring(F.lit(alphabet), F.get(values, F.length(F.regexp_replace(F.substring(template, F.lit(1), j), other, ""))) + 1, F.lit(1))).otherwise(c),
        ),
        "",
    )


def luhn_check(payload: Column) -> Column:
    """The check digit of an array of digits."""
    n = F.size(payload)
    total = F.aggregate(
        F.transform(payload, lambda d, j: F.when((n - 1 - j) % 2 == 0, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)), F.lit(0), lambda a, b: a + b
    )
    return F.pmod(-total, F.lit(10))


def _mod97(s: Column) -> Column:
    """The remainder of the number that s spells, A as 10 to Z as 35."""
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0), lambda a, c: F.pmod(a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + (F.instr(F.lit(ALPHABET), c) - 1), F.lit(97)))


def _card(tok: Column, key: Column) -> Column:
    def new(d: Column) -> Column:
        payload = F.slice(d, F.lit(1), F.size(d) - 1)
        mixed = _let(feistel(payload, 10, key, F.lit("card")), lambda p: F.concat(p, F.array(luhn_check(p))))
        fine = F.size(d).between(13, 19) & (luhn_check(payload) == F.element_at(d, -1))
        return F.when(fine, _refill(tok, mixed, DIGITS, "0-9"))

    return _let(_digits(tok), new)


def _ssn(tok: Column, key: Column) -> Column:
    part = [F.get(F.split(tok, "-"), F.lit(k)).cast("int") for k in range(3)]
    fine = (part[0] > 0) & (part[0] != 666) & (part[0] < 900) & (part[1] > 0) & (part[2] > 0)
    # area 1..899 without 666 counts 898; two numbers of 88,902 and 9,999 values
    high = (part[0] - F.when(part[0] > 666, 2).otherwise(1)) * 99 + part[1] - 1

    def say(s: Column) -> Column:
        area = F.floor(s["a"] / 99).cast("int") + 1
        area = F.when(area >= 666, area + 1).otherwise(area)
        return F.format_string("%03d-%02d-%04d", area, s["a"] % 99 + 1, s["b"] + 1)

    return F.when(fine, _let(_pair(high, part[2] - 1, 898 * 99, 9999, key, F.lit("ssn")), say))


def _pair(a: Column, b: Column, size_a: int, size_b: int, key: Column, tweak: Column, rounds: int = 5) -> Column:
    """A keyed permutation of the pairs: a moves by a function of b, then b by one of a, again and again."""
    kind = "struct<a:int,b:int>"

    def by(i: Column, side: str, x: Column, size: int) -> Column:
        digest = F.sha2(F.concat_ws("|", key, tweak, i.cast("string"), F.lit(side), x.cast("string")), 256)
        return F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), F.lit(size)).cast("int")

    def turn(s: Column, i: Column) -> Column:
        first = F.pmod(s["a"] + by(i, "b", s["b"], size_a), F.lit(size_a))
        return _let(first, lambda x: F.struct(x.alias("a"), F.pmod(s["b"] + by(i, "a", x, size_b), F.lit(size_b)).alias("b")).cast(kind))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(a.cast("int").alias("a"), b.cast("int").alias("b")).cast(kind), turn)


def _ip(tok: Column, key: Column) -> Column:
    def new(v: Column) -> Column:
        return F.when(F.forall(v, lambda x: x < 256), F.array_join(feistel(v, 256, key, F.lit("ip")).cast("array<string>"), "."))

    return _let(F.transform(F.split(tok, r"\."), lambda x: x.cast("int")), new)


def _phone(tok: Column, key: Column) -> Column:
    # the country code stays; what follows is permuted
    code = F.regexp_extract(tok, r"^\+[0-9]{1,3}(?=[ .(-])", 0)
    rest = F.substring(tok, F.length(code) + 1, F.length(tok))
    return _let(_digits(rest), lambda d: F.when(F.size(d).between(7, 15), F.concat(code, _refill(rest, feistel(d, 10, key, F.concat(F.lit("phone"), code)), DIGITS, "0-9"))))


def _email(tok: Column, key: Column) -> Column:
    local, domain = F.substring_index(tok, "@", 1), F.substring_index(tok, "@", -1)
    values = F.transform(F.filter(F.split(local, ""), lambda c: c.rlike("[0-9A-Za-z]")), lambda c: (F.instr(F.lit(ALPHABET), c) - 1).cast("int"))
    mixed = feistel(values, len(ALPHABET), key, F.concat(F.lit("email"), F.lower(domain)))
    return F.concat(_refill(local, mixed, ALPHABET, "0-9A-Za-z"), F.lit("@"), domain)


def _iban(tok: Column, key: Column) -> Column:
    plain = F.regexp_replace(tok, " ", "")
    country, bban = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))

    def new(body: Column) -> Column:
        check = F.lpad((F.lit(98) - _mod97(F.concat(body, country, F.lit("00")))).cast("string"), 2, "0")
        # back to the groups of the original
        whole = F.concat(country, check, body)
        chars = F.filter(F.split(tok, ""), lambda c: c != "")
        return F.array_join(F.transform(chars, lambda c, j: F.when(c == " ", c).otherwise(F.substring(whole, F.length(F.regexp_replace(F.substring(tok, F.lit(1), j), " ", "")) + 1, F.lit(1)))), "")

    fine = F.length(plain).between(15, 34) & (_mod97(F.concat(bban, F.substring(plain, 1, 4))) == 1)
    return F.when(fine, _let(_refill(bban, feistel(_digits(bban), 10, key, F.concat(F.lit("iban"), country)), DIGITS, "0-9"), new))


def _date(tok: Column, key: Column) -> Column:
    mark = F.regexp_extract(tok, r"^[0-9]+([./-])", 1)
    parts = F.split(tok, r"[./-]")
    n = [F.get(parts, F.lit(k)).cast("int") for k in range(3)]
    year_first = F.length(F.get(parts, F.lit(0))) == 4
    month_first = ~year_first & (mark == "/") & (n[0] <= 12)
    year = F.when(year_first, n[0]).otherwise(n[2])
    month = F.when(year_first | ~month_first, n[1]).otherwise(n[0])
    day = F.when(year_first, n[2]).when(month_first, n[1]).otherwise(n[0])
    date = F.to_date(F.try_to_timestamp(F.format_string("%04d-%02d-%02d", year, month, day), F.lit("yyyy-MM-dd")))
    block = F.floor((year - 1901) / 28).cast("int")
    start = F.to_date(F.format_string("%04d-01-01", block * 28 + 1901))
    padded = F.length(tok) == 10

    def say(x: Column) -> Column:
        def two(v: Column) -> Column:
            return F.when(padded, F.lpad(v.cast("string"), 2, "0")).otherwise(v.cast("string"))

        y, m, d = F.lpad(F.year(x).cast("string"), 4, "0"), two(F.month(x)), two(F.dayofmonth(x))
        return F.when(year_first, F.concat(y, mark, m, mark, d)).when(month_first, F.concat(m, mark, d, mark, y)).otherwise(F.concat(d, mark, m, mark, y))

    def new(k: Column) -> Column:
        moved = _pair(F.floor(k / 487), k % 487, 21, 487, key, F.concat(F.lit("date"), block.cast("string")))
        return _let(_let(moved, lambda s: F.date_add(start, s["a"] * 487 + s["b"])), say)

    fine = year.between(1901, 2096) & date.isNotNull()
    return F.when(fine, _let(F.datediff(date, start), new))


_MAKERS = {"email": _email, "iban": _iban, "date": _date, "ip": _ip, "ssn": _ssn, "phone": _phone, "card": _card}


def pseudonym(tok: Column, key: Column) -> Column:
    """struct<kind, new>: of the first kind whose form the whole token has and whose validation it passes; else nulls."""
    out = F.lit(None).cast("struct<kind:string,new:string>")
    for kind in reversed(KINDS):
        form = "^(?:" + _PATTERNS[kind].replace(r"\2", r"\1").replace(r"\3", r"\1").replace(r"\4", r"\2") + ")$"
        one = F.when(tok.rlike(form), _MAKERS[kind](tok, key))
        out = _let(one, lambda v, kind=kind, out=out: F.when(v.isNotNull(), F.struct(F.lit(kind).alias("kind"), v.alias("new")).cast("struct<kind:string,new:string>")).otherwise(out))
    return out


def protect(df: DataFrame, key: str, text_col: str = "text", counts: bool = True) -> DataFrame:
    """df with pseudonyms in its text, and with n_<kind> counts of what was replaced if asked for."""
    secret = df.sparkSession.createDataFrame([(key,)], "p_key string").scalar()  # a subquery: plans and logs don't show it
    text = F.col(f"`{text_col}`").cast("string")
    hit = text.rlike("[0-9@]") & text.rlike(PATTERN)
    row = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("p_row"), text.alias("p_text"), F.when(hit, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).alias("p_found"), secret.alias("p_key"))
    row = row.withColumn("p_new", F.transform("p_found", lambda t: pseudonym(t, F.col("p_key"))))
    # what stands between the values, and the values, in turn
    gaps = F.split("p_text", PATTERN)
    joined = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get("p_new", i)["new"], F.get("p_found", i), F.lit("")))), "")
    clean = F.when(F.col("p_found").isNull() | F.forall("p_new", lambda s: s.isNull()), F.col("p_text")).otherwise(joined)
    kept = [clean.alias(text_col) if c == text_col else F.col("p_row")[c].alias(c) for c in df.columns]
    if counts:
        kept += [F.coalesce(F.size(F.filter("p_new", lambda s: s["kind"] == kind)), F.lit(0)).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return row.select(*kept)
