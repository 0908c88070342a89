"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Numbers and dates that validate (card numbers by their Luhn digit, IBANs by theirs, social security numbers by their
ranges, IPv4 octets, calendar dates, telephone numbers by their digit counts), the local parts of e-mail addresses and
quoted secrets are permuted within their format by keyed Feistel networks: equal values get equal pseudonyms in all
documents, different values of a format get different ones, and nothing needs to be stored or joined. One pattern finds
the candidates, a text is split at them, and the parts are put together again with the pseudonyms; texts without a digit
or an @ are passed on as they are. Whoever has the key can invert the pseudonyms, so it has no default.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, quoted

ROUNDS = 10
#: The session setting that names the key of the registered query and of the pipeline.
KEY_SETTING = "spark.lodeseek.pii.key"
_drawn: dict[str, str] = {}
#: Symbols that one Feistel network permutes together; longer strings are permuted in stretches.
STRETCH = 24
DIGITS, LETTERS, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
#: Two moduli whose product is the size of an alphabet: a single symbol is permuted as a pair below them.
PAIR = {DIGITS: (2, 5), LETTERS: (2, 13), HEX: (4, 4)}
#: Days of the 400 years of dates that are permuted among themselves, as the two moduli of a Feistel network.
FIRST_DAY, DAY_MODULI = "1800-01-01", (189, 773)

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
PATTERN = "|".join(
    [
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
        r"(?i:\b(?:token|secret|password|passwd|api[_-]?key))[ \t]{0,4}[=:][ \t]{0,4}\"[0-9A-Fa-f]{16,}+\"",
        rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\w]|\.[0-9])",
        r"(?<![\w/.-])(?:1[89]|2[01])[0-9]{2}-[01][0-9]-[0-3][0-9](?![\w-])",
        r"(?<![\w/.-])[0-3]?[0-9]([/.])[0-3]?[0-9]\1(?:1[89]|2[01])[0-9]{2}(?![\w/])",
        r"(?<![\w+])\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])",
        r"(?<![\w+])\+[2-9][0-9]{0,2}(?:[ .-]?\([0-9]{1,4}\))?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])",
        r"(?<![\w])(?:\([0-9]{3}\) ?|[0-9]{3}-)[0-9]{3}-[0-9]{4}(?![\w-])",
        r"(?<![\w.+-])[0-9]{3}([. ])[0-9]{3}\2[0-9]{4}(?![\w-]|[. ][0-9])",
        r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
        r"(?<![\w])[0-9]{13,19}(?![\w])",
        r"(?<![\w-])[0-9]{4}([ -])[0-9]{4}\3[0-9]{4}\3[0-9]{4}(?![\w-])",
        r"(?<![\w-])[0-9]{4}([ -])[0-9]{6}\4[0-9]{5}(?![\w-])",
        r"(?<![\w])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![\w])",
    ]
)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, and written once in the plan, however often the body has it."""
    return F.transform(F.array(value), body)[0]


def feistel(left: Column, right: Column, left_modulus: Column, right_modulus: Column, key: str, tweak: Column) -> Column:
    """A keyed permutation of the pairs below the two moduli, as a struct (l long, r long): each round adds a keyed hash of one side to the other."""

    def mixed(i: Column, value: Column) -> Column:
        return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), value.cast("string")), 256), 1, 15), 16, 10).cast("long")

    def turn(s: Column, i: Column) -> Column:
        l, r = s["l"], s["r"]  # noqa: E741
        even = F.struct(((l + F.pmod(mixed(i, r), left_modulus)) % left_modulus).alias("l"), r.alias("r"))
        odd = F.struct(l.alias("l"), ((r + F.pmod(mixed(i, l), right_modulus)) % right_modulus).alias("r"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _value(symbols: Column, alphabet: str) -> Column:
    return F.aggregate(F.split(symbols, ""), F.lit(0).cast("long"), lambda acc, c: acc * F.lit(len(alphabet)) + F.greatest(F.instr(F.lit(alphabet), c) - 1, F.lit(0)).cast("long"))


def _power(alphabet: str, n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(len(alphabet) ** k).cast("long") for k in range(STRETCH // 2 + 1)]), n.cast("int") + 1)


def _symbols(value: Column, n: Column, alphabet: str) -> Column:
    each = F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: F.substr(F.lit(alphabet), (_div(value, _power(alphabet, n - i)) % len(alphabet) + 1).cast("int"), F.lit(1)))
    return F.when(n > 0, F.concat_ws("", each)).otherwise(F.lit(""))


def permute(symbols: Column, alphabet: str, key: str, tweak: Column) -> Column:
    """A permutation of the strings of equal length over an alphabet."""
    one = PAIR[alphabet]
    modulus = F.lit(one[1]).cast("long")

    def permuted(part: Column, n: Column, j: Column) -> Column:
        u = _div(n, F.lit(2)).cast("int")
        v = n - u
        own = F.concat_ws(",", tweak, F.lit(alphabet[:2]), n.cast("string"), j.cast("string"))
        # A single symbol has no two halves: its number is split into a quotient and a remainder instead.
        single = n == 1
        left = F.when(single, _div(_value(part, alphabet), modulus)).otherwise(_value(F.substr(part, F.lit(1), u), alphabet))
        right = F.when(single, _value(part, alphabet) % modulus).otherwise(_value(F.substr(part, u + 1, v), alphabet))
        sides = F.struct(*[F.when(single, F.lit(m).cast("long")).otherwise(_power(alphabet, k)).alias(c) for m, k, c in zip(one, (u, v), "ab", strict=True)])
        out = let(sides, lambda m: feistel(left, right, m["a"], m["b"], key, own))
        return let(out, lambda s: F.when(single, _symbols(s["l"] * modulus + s["r"], n, alphabet)).otherwise(F.concat(_symbols(s["l"], u, alphabet), _symbols(s["r"], v, alphabet))))

    def stretches(whole: Column) -> Column:
        def stretch(j: Column) -> Column:
            part = F.substr(whole, (j * STRETCH + 1).cast("int"), F.lit(STRETCH))
            return let(part, lambda p: let(F.length(p), lambda n: permuted(p, n, j)))

        last = _div(F.greatest(F.length(whole), F.lit(1)) - 1, F.lit(STRETCH)).cast("int")
        return F.when(F.length(whole) > 0, F.concat_ws("", F.transform(F.sequence(F.lit(0), last), stretch))).otherwise(whole)

    return let(symbols, stretches)


def refill(shape: Column, kind: str, symbols: Column) -> Column:
    """``shape`` with its characters of a kind (a pattern) replaced in turn by ``symbols``; capitals stay capitals."""

    def put(acc: Column, c: Column) -> Column:
        new = F.substr(symbols, acc["k"] + 1, F.lit(1))
        new = F.when(c.rlike("[A-Z]"), F.upper(new)).otherwise(new)
        hit = F.struct(F.concat(acc["out"], new).alias("out"), (acc["k"] + 1).alias("k"))
        return F.when(c.rlike(kind), hit).otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["k"].alias("k")))

    return F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("k")), put, lambda acc: acc["out"])


def _only(x: Column, kind: str) -> Column:
    return F.regexp_replace(F.lower(x), f"[^{kind}]", "")


def luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits modulo 10; 0 if the last one checks."""
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda acc, x: acc + x) % 10


def _email(m: Column, key: str) -> Column:
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    tweak = F.concat(F.lit("email:"), F.lower(domain))
    letters = refill(local, "[A-Za-z]", permute(_only(local, "a-z"), LETTERS, key, tweak))
    return F.concat(refill(letters, "[0-9]", permute(_only(local, "0-9"), DIGITS, key, tweak)), F.lit("@"), domain)


def _secret(m: Column, key: str) -> Column:
    value = F.substring_index(F.substring_index(m, '"', 2), '"', -1)
    return F.concat(F.substring_index(m, '"', 1), F.lit('"'), refill(value, "[0-9A-Fa-f]", permute(F.lower(value), HEX, key, F.lit("secret"))), F.lit('"'))


def _address(m: Column, key: str) -> Column:
    o = lambda k: F.substring_index(F.substring_index(m, ".", k), ".", -1).cast("long")
    side = F.lit(65536).cast("long")
    out = feistel(o(1) * 256 + o(2), o(3) * 256 + o(4), side, side, key, F.lit("ip"))
    return let(out, lambda s: F.concat_ws(".", *[x.cast("string") for x in (_div(s["l"], F.lit(256)), s["l"] % 256, _div(s["r"], F.lit(256)), s["r"] % 256)]))


def _date(m: Column, order: str, key: str) -> Column:
    """A date whose day and month have two digits, among all such dates. order: its pattern. Null where the calendar does not have it."""
    first, (a, b) = F.to_date(F.lit(FIRST_DAY)), DAY_MODULI

    def moved(n: Column) -> Column:
        out = feistel(_div(n, F.lit(b)), n % b, F.lit(a).cast("long"), F.lit(b).cast("long"), key, F.lit("date"))
        return F.when((n >= 0) & (n < a * b), let(out, lambda s: F.date_format(F.date_add(first, (s["l"] * b + s["r"]).cast("int")), order)))

    return let(F.datediff(F.try_to_timestamp(m, F.lit(order)).cast("date"), first).cast("long"), moved)


def _within(d: Column, mo: Column, y: Column, key: str, months: int, first: int, most: int, kind: str, written: Callable[[Column, Column, Column], Column]) -> Column:
    """written(day, month, year) of a date, permuted among the dates of the first ``months`` months whose day is from ``first`` to ``most``; null where it is none of them."""
    lengths = [min(n, most) - first + 1 for n in (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)[:months]]
    upto = [sum(lengths[:k]) for k in range(months + 1)]
    inside = mo.between(1, months) & (d >= first) & (d - first < F.element_at(F.array(*[F.lit(n) for n in lengths]), F.greatest(F.least(mo, F.lit(months)), F.lit(1))))
    at = F.element_at(F.array(*[F.lit(n) for n in upto[:-1]]), mo) + d - first
    out = feistel((y - 1800).cast("long"), at.cast("long"), F.lit(400).cast("long"), F.lit(upto[-1]).cast("long"), key, F.lit(f"date {kind}"))

    def usual(s: Column) -> Column:
        def parts(month: Column) -> Column:
            before = F.element_at(F.array(*[F.lit(n) for n in upto[:-1]]), month)
            return written((s["r"] - before + first).cast("int"), month, (s["l"] + 1800).cast("int"))

        return let(F.size(F.filter(F.array(*[F.lit(n) for n in upto[:-1]]), lambda o: o <= s["r"])), parts)

    moved = F.when(inside, let(out, usual))
    if not first <= 29 <= most:
        return moved
    # 29 February exists in 97 of the 400 years: it moves among them.
    leaps = F.filter(F.sequence(F.lit(1800), F.lit(2196), F.lit(4)), lambda x: (x % 100 != 0) | (x % 400 == 0))
    turned = let(leaps, lambda years: let(F.array_position(years, y), lambda place: F.when(place > 0, F.element_at(years, (feistel(F.lit(0).cast("long"), place.cast("long") - 1, F.lit(1).cast("long"), F.lit(97).cast("long"), key, F.lit(f"leap {kind}"))["r"] + 1).cast("int")))))
    return F.when((mo == 2) & (d == 29), let(turned, lambda year: F.when(year.isNotNull(), written(F.lit(29), F.lit(2), year)))).otherwise(moved)


def _digits(value: Column, like: Column) -> Column:
    """A number written with as many digits as ``like`` has."""
    return F.lpad(value.cast("string"), F.length(like), F.lit("0"))


def _written_date(m: Column, key: str) -> Column:
    """A date with slashes or full stops: day-first wherever that is valid, else month-first. Each field keeps its number of digits."""

    def fields(f: Column) -> Column:
        a, b, x, z, year = f["a"], f["b"], f["x"], f["z"], f["y"]

        def day_first(d: Column, mo: Column, y: Column) -> Column:
            return F.concat(_digits(d, a), f["sign"], _digits(mo, b), f["sign"], y.cast("string"))

        def month_first(d: Column, mo: Column, y: Column) -> Column:
            return day_first(mo, d, y)

        shape = F.length(a) * 10 + F.length(b)
        found = [F.when(shape == 22, F.translate(_date(F.concat_ws("-", a, b, year.cast("string")), "dd-MM-yyyy", key), "-", "/"))]
        # A field of one digit stays one of one digit, so its day or month is below ten.
        for wide_day, wide_month in ((False, False), (False, True), (True, False)):
            one = _within(x, z, year, key, 12 if wide_month else 9, 1, 31 if wide_day else 9, f"{wide_day}{wide_month}", day_first)
            found.append(F.when(shape == (21 if wide_day else 12 if wide_month else 11), one))
        for wide_month in (False, True):
            one = _within(z, x, year, key, 12 if wide_month else 9, 13, 31, f"month {wide_month}", month_first)
            found.append(F.when((F.length(a) == 2) == F.lit(wide_month), one))
        return let(F.coalesce(*found, m), lambda out: F.when(f["sign"] == ".", F.translate(out, "/", ".")).otherwise(out))

    parts = F.split(m, "[/.]")
    a, b, y = (F.element_at(parts, k) for k in (1, 2, 3))
    sign = F.when(F.contains(m, F.lit("/")), F.lit("/")).otherwise(F.lit("."))
    return let(F.struct(a.alias("a"), b.alias("b"), a.cast("int").alias("x"), b.cast("int").alias("z"), y.cast("int").alias("y"), sign.alias("sign")), fields)


def _phone(m: Column, key: str) -> Column:
    code = F.regexp_extract(m, r"^(\+1|\+[2-9][0-9]{0,2}(?=[ .(-])|\+[2-9])?", 0)
    rest = F.substr(m, F.length(code) + 1, F.length(m))
    digits = _only(rest, "0-9")
    right = (F.length(digits) + F.length(code)).between(8, 16)
    return F.when(right, F.concat(code, refill(rest, "[0-9]", permute(digits, DIGITS, key, F.concat(F.lit("phone:"), code))))).otherwise(m)


def _card(m: Column, key: str) -> Column:
    digits = _only(m, "0-9")
    body = permute(F.substr(digits, F.lit(1), F.length(digits) - 1), DIGITS, key, F.lit("card"))
    checked = let(body, lambda x: F.concat(x, ((10 - luhn(F.concat(x, F.lit("0")))) % 10).cast("string")))
    return F.when(luhn(digits) == 0, refill(m, "[0-9]", checked)).otherwise(m)


def _security(m: Column, key: str) -> Column:
    """A social security number: area 001 to 899 but 666, group 01 to 99, serial 0001 to 9999."""
    area, group, serial = (F.element_at(F.split(m, "-"), k).cast("long") for k in (1, 2, 3))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    out = feistel(area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1, F.lit(898).cast("long"), F.lit(99 * 9999).cast("long"), key, F.lit("ssn"))

    def written(s: Column) -> Column:
        new = s["l"] + F.when(s["l"] >= 665, 2).otherwise(1)
        return F.concat_ws("-", F.lpad(new.cast("string"), 3, "0"), F.lpad((_div(s["r"], F.lit(9999)) + 1).cast("string"), 2, "0"), F.lpad((s["r"] % 9999 + 1).cast("string"), 4, "0"))

    return F.when(valid, F.transform(F.array(out), written)[0]).otherwise(m)


def _mod97(symbols: Column) -> Column:
    """The number modulo 97 that digits and letters (A = 10) spell."""
    return F.aggregate(F.split(symbols, ""), F.lit(0), lambda acc, c: F.when(c.rlike("[0-9]"), acc * 10 + c.cast("int")).otherwise(acc * 100 + F.ascii(c) - 55) % 97)


def _iban(m: Column, key: str) -> Column:
    """An IBAN whose check digits are right: what follows them is permuted, digits and letters for themselves, and they are set anew."""
    whole = F.regexp_replace(m, " ", "")
    country, body = F.substr(whole, F.lit(1), F.lit(2)), F.substr(whole, F.lit(5), F.length(whole))
    tweak = F.concat(F.lit("iban:"), country)
    moved = refill(refill(body, "[0-9]", permute(_only(body, "0-9"), DIGITS, key, tweak)), "[A-Z]", permute(_only(body, "a-z"), LETTERS, key, tweak))
    checked = F.transform(F.array(moved), lambda x: F.concat(country, F.lpad((98 - _mod97(F.concat(x, country, F.lit("00")))).cast("string"), 2, "0"), x))[0]
    return F.when(_mod97(F.concat(body, country, F.substr(whole, F.lit(3), F.lit(2)))) == 1, refill(m, "[A-Z0-9]", checked)).otherwise(m)


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one found string; a string that does not validate is its own."""
    return (
        F.when(F.contains(m, F.lit("@")), _email(m, key))
        .when(F.contains(m, F.lit('"')), _secret(m, key))
        .when(m.rlike("^[A-Z]{2}[0-9]{2}"), _iban(m, key))
        .when(m.rlike(r"^[0-9]+(\.[0-9]+){3}$"), _address(m, key))
        .when(m.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.coalesce(_date(m, "yyyy-MM-dd", key), m))
        .when(m.rlike(r"^[0-9]{1,2}([/.])[0-9]{1,2}\1[0-9]{4}$"), _written_date(m, key))
        .when(m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), _security(m, key))
        .when(m.rlike(r"^(\+|\()|^[0-9]{3}([-. ])[0-9]{3}\2[0-9]{4}$"), _phone(m, key))
        .otherwise(_card(m, key))
    )


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """docs (text, ...) with pseudonyms in text, and n_pii long, the number of strings replaced, after the other columns.

    Whole texts. A null text stays null with 0 replaced; texts without personal data stay byte for byte. Card
    numbers that fail the Luhn test, IBANs with wrong check digits, social security numbers out of range and dates that
    are not in the calendar of 1800 to 2199 are left alone. A date with slashes or full stops is read
    day-first wherever that is valid, else month-first. Repeated rows get equal results, an empty table gives an empty
    one. A column of docs named n_pii is replaced; others may have any name. An e-mail's domain has 63 characters a label
    at most and nine labels. An empty key is an error.
    """
    if not key:
        raise ValueError("pseudonyms need a secret key")
    columns = [c for c in docs.columns if c != "n_pii"]
    old, made = fresh(docs, "found", "pseudonyms")
    text = F.col("text").cast("string")
    found = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    rows = docs.select(*map(quoted, columns), found.alias(old))
    some = F.size(old) > 0
    rows = rows.withColumn(made, F.when(some, F.transform(old, lambda m: pseudonym(m, key))).otherwise(F.array().cast("array<string>")))
    parts = F.split(text, PATTERN, -1)
    joined = F.concat_ws("", F.flatten(F.zip_with(parts, F.col(made), lambda p, m: F.array(p, F.coalesce(m, F.lit(""))))))
    changed = F.size(F.filter(F.zip_with(old, made, lambda a, b: a != b), lambda x: x))
    out = {"text": F.when(some, joined).otherwise(text)}
    return rows.select(*[out[c].alias(c) if c in out else quoted(c) for c in columns], F.coalesce(F.when(some, changed), F.lit(0)).cast("long").alias("n_pii"))


def application_key(spark: SparkSession) -> str:
    """The key in the setting KEY_SETTING; without it a random one, drawn once for an application and kept nowhere: its pseudonyms link within that application's results only."""
    named = spark.conf.get(KEY_SETTING, None)
    return named or _drawn.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))
