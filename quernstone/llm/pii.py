"""Format-preserving Feistel pseudonyms for personal data, in built-in expressions only.

One pattern finds candidates; each is validated for its kind (Luhn sum, octets, calendar, numbers of digits) and, if valid, replaced
by a keyed permutation of itself within its format:

* text of digits and letters (cards, phones, emails' local parts, secrets): a balanced Feistel network over its two halves, in
  which every digit or letter is shifted within its own class (other letters than ASCII's: within 64 neighbours) by a keystream hashed
  from the other half. Separators, the length, the domain of an email and the country code of a phone stay. A card's last digit is
  computed anew, so its Luhn sum stays valid.
* IPv4 addresses: a Feistel network on the two 16-bit halves. IPv6 addresses: one on their 32 hexadecimal digits, written out in full.
* IBANs (mod 97): letters and digits behind the country, with new check digits. Social security numbers (US): a network on the
  898 x 99 x 9,999 numbers that can be issued. Identity numbers with a check letter (Spain): digits, with a new letter.
* dates: the day's number in a 400-year cycle, a Feistel network of mixed radix on 189 x 773 = 146,097 days.

A permutation has no collisions, and equal values get equal pseudonyms in all documents under one key. Text around the values, and
values that are not valid, stay untouched byte by byte. Values are taken to their end, however long they are.
"""

from __future__ import annotations

import secrets
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import given

ROUNDS = 8
#: The setting of a session that holds the key. Spark hides settings with such a name in its logs and pages.
KEY = "spark.quernstone.pseudonym.secret.key"
# Countries with IBANs, country calling codes of one or two digits (all others have three), check letters by remainder.
IBAN_COUNTRIES = (
    "AD AE AL AT AZ BA BE BG BH BI BR BY CH CR CY CZ DE DJ DK DO EE EG ES FI FK FO FR GB GE GI GL GR GT HN HR HU IE IL IQ IS IT JO KW KZ LB LC LI LT LU LV LY MC MD ME MK MN MR MT MU "
    "NI NL NO OM PK PL PS PT QA RO RS RU SA SC SD SE SI SK SM SO ST SV TL TN TR UA VA VG XK YE"
)
CALLING_CODE = "^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
CHECK_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"


def session_key(spark: SparkSession) -> str:
    """The key that the session sets; without one a random key that nobody keeps: equal values are then linked within one call only."""
    return spark.conf.get(KEY, None) or secrets.token_hex(32)

# Candidates, in Java's regular expressions. Each stands behind (?<!\w), so most places of a text are left at once; every
# repetition is short or possessive, so none backtracks over a long text.
_VALUE = r"\p{L}\p{N}_+/=~@#$%^*-"
NAMED = rf"""(?i:token|secret|api_key|apikey|password|passwd)["']?\s{{0,2}}[=:]\s{{0,2}}["']?(?=[{_VALUE}.!?:]{{8}})[{_VALUE}]++(?:[.!?:]++[{_VALUE}]++)*+"""
EMAIL = r"(?<![\p{L}\p{N}.+-])[\p{L}\p{N}_][\p{L}\p{N}_.+-]*+@[\p{L}\p{N}](?:[\p{L}\p{N}-]*+\.)+\p{L}{2,}+(?![\w-])"
HEX = r"[0-9A-Fa-f]{32,}+(?!\w)"
IPV4 = r"(?<!\d\.)\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)"
ISO_DATE = r"(?<!-)\d{4}-\d{2}-\d{2}(?:(?=T\d\d(?::?\d\d|Z|\b))|(?![\w-]))"
DMY_DATE = r"(?<![./])\d{1,2}(?:\.\d{1,2}\.|/\d{1,2}/)\d{4}(?![\w]|[./]\d)"
SSN = r"(?<![.-])\d{3}-\d\d-\d{4}(?![\w-])"
DNI = r"(?<![.-])\d{8}-?[A-Z](?![\w-])"
IBAN = rf"(?:{'|'.join(IBAN_COUNTRIES.split())})\d\d(?:(?: [A-Z0-9]{{4}}){{2,7}}+(?: [A-Z0-9]{{1,3}}(?!\w))?+|[A-Z0-9]{{11,30}}+)(?!\w)"
IPV6 = r"(?<!:)[0-9A-Fa-f]{1,4}+(?:::?[0-9A-Fa-f]{1,4}+){1,7}+(?:::)?+(?![\w:]|\.\d)"
PHONE = r"\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![.-])\d{3}(?:-\d{3}-|\.\d{3}\.)\d{4}(?![\w]|[.-]\d)"
#: A run of numbers with 13 digits or more, single spaces or hyphens between them, up to a date or a phone; _cards looks for the cards in it.
_GROUP = r"\d{1,19}+(?!\w|\.\d)"
_OTHER = r"(?!\d{3}-\d\d-\d{4}(?![\w-])|\d{4}-\d\d-\d\d(?![\d-])|\d{1,2}/\d{1,2}/\d{4}|\d{3}-\d{3}-\d{4}(?![\w-]))"
CARD = rf"(?<![.-])(?=\d(?:[ -]?\d){{12}}){_GROUP}(?:[ -]{_OTHER}{_GROUP})*+(?!-\d)"
#: The usual groupings of cards, and their first digits.
REGULAR = r"^(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?:\1[0-9]{3})?|[0-9]{4}([ -])[0-9]{6}\2[0-9]{4,5})$"
ISSUED = "^(?:[3-6]|2[2-7])"
#: Numbers behind +1 have ten digits, so what follows them is no part of them.
PLUS_PHONE = r"(?<![0-9+])\+(?:1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?!1[ .(-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d))\d{1,3}[ -]?(?:\(\d{1,4}\)[ -]?)?\d{1,4}(?:[ -]?\d{2,4}){1,4}(?![\w]|\.\d))"
PATTERN = "(?<!\\w)(?:" + "|".join((NAMED, EMAIL, HEX, IPV4, IPV6, ISO_DATE, DMY_DATE, SSN, DNI, IBAN, PHONE, CARD)) + ")|" + PLUS_PHONE


def _let(x: Column, f) -> Column:
    """f of x, which is evaluated once; what a lambda function mentions is evaluated at each of its calls."""
    return F.transform(F.array(x), f)[0]


def _keystream(key: Column, kind: Column, i: Column, half: Column) -> Column:
    return F.sha2(F.concat(key, F.lit("|"), kind, F.lit("|"), i.cast("string"), F.lit("|"), half), 256)


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substr(stream, F.lit(1) + F.lit(2) * (i % 32), F.lit(2)), 16, 10).cast("int")


def _shifted(text: Column, stream: Column, hex_only: Column) -> Column:
    """Each digit and letter moved within its class by its byte of the keystream; anything else as it is."""

    def one(c: Column, i: Column, upper: Column, stream: Column) -> Column:
        a, b = F.ascii(c), _byte(stream, i)
        within = lambda first, n: F.char(F.lit(first) + (a - first + b) % n)
        moved = F.lower(F.hex(((F.conv(c, 16, 10).cast("int") + b) % 16).cast("bigint")))
        wide = F.decode(F.unhex(F.lpad(F.hex((a - a % 64 + (a % 64 + b) % 64).cast("bigint")), 4, "0")), "UTF-16BE")
        own = F.when(c.between("0", "9"), within(48, 10)).when(c.between("a", "z"), within(97, 26)).when(c.between("A", "Z"), within(65, 26))
        return F.when(hex_only & c.rlike("^[0-9A-Fa-f]$"), F.when(upper, F.upper(moved)).otherwise(moved)).when(hex_only, c).otherwise(own.when((a >= 128) & (a < 65536) & c.rlike("^\\p{L}$"), wide).otherwise(c))

    both = F.struct(stream.alias("s"), text.rlike("[A-F]").alias("u"))
    return _let(both, lambda x: F.array_join(F.transform(F.split(text, ""), lambda c, i: one(c, i, x["u"], x["s"])), ""))


def feistel_text(text: Column, key: Column, kind: str | Column, hex_only: bool | Column = False) -> Column:
    """A permutation of the texts with the same classes of characters in the same places."""
    kind, hex_only = (x if isinstance(x, Column) else F.lit(x) for x in (kind, hex_only))
    half = F.floor(F.length(text) / 2).cast("int")
    left, right = F.substr(text, F.lit(1), half), F.substr(text, half + 1)
    start = F.struct(left.alias("l"), right.alias("r"))
    step = lambda s, i: F.struct(s["r"].alias("l"), _shifted(s["l"], _keystream(key, kind, i, s["r"]), hex_only).alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: F.concat(s["l"], s["r"]))


def feistel_number(value: Column, a: int | Column, b: int | Column, key: Column, kind: str | Column) -> Column:
    """A permutation of 0 .. a * b - 1."""
    a, b, kind = (x if isinstance(x, Column) else F.lit(x) for x in (a, b, kind))
    big = lambda c: c.cast("bigint")
    start = F.struct(big(F.floor(value / b)).alias("l"), big(value % b).alias("r"), big(a).alias("m"), big(b).alias("n"))

    def step(s, i):
        f = big(F.conv(F.substr(_keystream(key, kind, i, s["r"].cast("string")), F.lit(1), F.lit(12)), 16, 10))
        return F.struct(s["r"].alias("l"), ((s["l"] + f) % s["m"]).alias("r"), s["n"].alias("m"), s["m"].alias("n"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: s["l"] * b + s["r"])


def _into(shape: Column, digits: Column) -> Column:
    """The digits in the places that shape has digits in."""
    start = F.struct(F.lit("").alias("t"), F.lit(1).alias("k"))
    put = lambda s, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(s["t"], F.substr(digits, s["k"], F.lit(1))).alias("t"), (s["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(s["t"], c).alias("t"), s["k"].alias("k")))
    return F.aggregate(F.split(shape, ""), start, put, lambda s: s["t"])


def _luhn(digits: Column, double_last: bool) -> Column:
    """Luhn sum; double_last: of digits that lack their check digit."""
    reversed_ = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")

    def one(c: Column, i: Column) -> Column:
        v = c.cast("int")
        return F.when(i % 2 == (0 if double_last else 1), v * 2 - F.when(v > 4, 9).otherwise(0)).otherwise(v)

    return F.aggregate(F.transform(reversed_, one), F.lit(0), lambda s, v: s + v)


def _card(m: Column, key: Column) -> Column:
    """The pseudonym of a valid card."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    body = feistel_text(F.substr(digits, F.lit(1), F.length(digits) - 1), key, "card")
    return _let(body, lambda x: _into(m, F.concat(x, ((F.lit(10) - _luhn(x, True) % 10) % 10).cast("string"))))


def _cards(m: Column, key: Column) -> Column:
    """(value, n) of a run of numbers: the run as one card if it is valid, else the valid cards among its parts; value is null without any.

    Parts are whole numbers of the run in a regular grouping, from left to right and the longest first, or, where these leave room, those
    of 13 to 19 digits from either end. Time grows with the length of the run: each number is looked at once, with at most four
    behind it.
    """
    valid = lambda d: F.length(d).between(13, 19) & (_luhn(d, False) % 10 == 0)

    def of(tokens: Column) -> Column:
        n = F.size(tokens)
        text = lambda i, j: F.regexp_replace(F.array_join(F.slice(tokens, i, j), ""), "^[ -]", "")
        possible = lambda t: t.rlike(ISSUED) & valid(F.regexp_replace(t, "[^0-9]", ""))
        place = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
        shapes = F.array(*map(F.lit, (5, 4, 3, 1)))
        regular = lambda i: F.get(F.filter(shapes, lambda j: (i + j <= n + 1) & _let(text(i, j), lambda t: t.rlike(REGULAR) & possible(t))), F.lit(0))
        start = F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<i:int,j:int>>").alias("cards"))

        def scanned(longest: Column) -> Column:
            step = lambda s, i: F.when((i < s["next"]) | F.element_at(longest, i).isNull(), s).otherwise(F.struct((i + F.element_at(longest, i)).alias("next"), F.concat(s["cards"], F.array(place(i, F.element_at(longest, i)))).alias("cards")))
            return F.aggregate(F.sequence(F.lit(1), n), start, step, lambda s: s["cards"])

        def with_ends(cards: Column) -> Column:
            odd = lambda i, j: _let(text(i, j), lambda t: ~t.rlike(REGULAR) & possible(t))
            last = F.element_at(cards, -1)
            first, behind = F.when(F.size(cards) > 0, F.get(cards, F.lit(0))["i"] - 1).otherwise(n), F.when(F.size(cards) > 0, last["i"] + last["j"] - 1).otherwise(0)
            down = F.when(first >= 1, F.sequence(F.least(first, F.lit(19)), F.lit(1), F.lit(-1)))
            front = F.get(F.filter(down, lambda j: odd(F.lit(1), j)), F.lit(0))

            def ended(front: Column) -> Column:
                low = F.greatest(behind, F.coalesce(front, F.lit(1)), n - 19) + 1
                back = F.get(F.filter(F.when(low <= n, F.sequence(low, n)), lambda i: odd(i, n - i + 1)), F.lit(0))
                return F.filter(F.concat(F.array(F.when(front.isNotNull(), place(F.lit(1), front))), cards, _let(back, lambda i: F.array(F.when(i.isNotNull(), place(i, n - i + 1))))), lambda x: x.isNotNull())

            return _let(front, ended)

        def built(cards: Column) -> Column:
            before = lambda k: F.coalesce(F.get(cards, k - 1)["i"] + F.get(cards, k - 1)["j"] - 1, F.lit(0))
            gap = lambda a, b: F.array_join(F.slice(tokens, a + 1, b - a), "")  # noqa: E731  numbers a + 1 to b
            one = lambda c, k: F.concat(gap(before(k), c["i"] - 1), F.regexp_extract(F.element_at(tokens, c["i"]), "^[ -]?", 0), _card(text(c["i"], c["j"]), key))
            value = F.concat(F.array_join(F.transform(cards, one), ""), gap(before(F.size(cards)), n))
            return F.struct(F.when(F.size(cards) > 0, value).alias("value"), F.size(cards).alias("n"))

        parts = _let(F.transform(F.sequence(F.lit(1), n), regular), lambda longest: _let(scanned(longest), with_ends))
        digits = F.regexp_replace(m, "[^0-9]", "")
        return _let(F.when(valid(digits) & ~digits.rlike("^0+$"), F.array(place(F.lit(1), n))).otherwise(parts), built)

    return _let(F.regexp_extract_all(m, F.lit("[ -]?[0-9]+"), F.lit(0)), of)


def _mod97(text: Column) -> Column:
    """Remainder of an IBAN's letters and digits, each letter a number from 10 to 35."""
    code = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), lambda s, c: (s * F.when(c.between("0", "9"), 10).otherwise(100) + code(c)) % 97)


def _spaced(shape: Column, plain: Column) -> Column:
    """plain with the spaces of shape."""
    start = F.struct(F.lit("").alias("t"), F.lit(1).alias("k"))
    put = lambda s, c: F.when(c == " ", F.struct(F.concat(s["t"], c).alias("t"), s["k"].alias("k"))).otherwise(F.struct(F.concat(s["t"], F.substr(plain, s["k"], F.lit(1))).alias("t"), (s["k"] + 1).alias("k")))
    return F.aggregate(F.filter(F.split(shape, ""), lambda c: c != ""), start, put, lambda s: s["t"])


def _parts(m: Column, sep: str | Column, n: int) -> list[Column]:
    return [F.split_part(m, F.lit(sep) if isinstance(sep, str) else sep, F.lit(i)) for i in range(1, n + 1)]


def _ipv6_digits(m: Column) -> Column:
    """The 32 digits of an address, in any of its spellings: eight groups, or fewer around one ::, with a digit in them."""
    groups = lambda t: F.filter(F.split(t, ":"), lambda x: x != "")
    left, right = (groups(x) for x in _parts(m, "::", 2))
    n = F.size(left) + F.size(right)
    all_ = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - n)), right)
    valid = F.when(m.contains("::"), (F.size(F.split(m, "::")) == 2) & (n >= 2) & (n <= 7)).otherwise(n == 8) & m.rlike("[0-9]")
    return F.when(valid, F.array_join(F.transform(all_, lambda x: F.lpad(F.lower(x), 4, "0")), ""))


def _dmy(m: Column) -> tuple[Column, Column, Column]:
    """The separator, the day if the first number is that, and the day if the second one is."""
    sep = F.regexp_extract(m, r"^\d+([./])", 1)
    a, b, y = _parts(m, sep, 3)
    made = lambda d, mo: F.try_to_date(F.concat_ws("-", y, F.lpad(mo, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    return sep, made(a, b), made(b, a)


_EPOCH = "2000-01-01"  # days move within the 400 years from 2000 to 2399, and so on
_KINDS = {
    "email": r"^[\p{L}\p{N}_.+-]+@[\p{L}\p{N}.-]+$", "ipv4": r"^\d{1,3}(\.\d{1,3}){3}$", "iso_date": r"^\d{4}-\d\d-\d\d$", "dmy_date": r"^\d{1,2}([./])\d{1,2}\1\d{4}$",
    "ssn": r"^\d{3}-\d\d-\d{4}$", "dni": r"^\d{8}-?[A-Z]$", "iban": r"^[A-Z]{2}\d\d[A-Z0-9 ]{9,}$", "ipv6": r"^[0-9A-Fa-f]{1,4}:[0-9A-Fa-f:]+$",
    "phone": r"^\+|^\(|^\d{3}([.-])\d{3}\1\d{4}$", "card": r"^[0-9][0-9 -]+$",
}
_HEAD = r"""^(?i:[a-z_]+)["']?\s{0,2}[=:]\s{0,2}["']?"""


def _body(m: Column, kind: Column) -> Column:
    """What is permuted as text; null if the value is not valid.

    Phones keep the country code, so a number with and without +1 keeps the same ten digits. Secrets have a digit in them.
    """
    digits, plain = F.regexp_replace(m, "[^0-9]", ""), F.regexp_replace(m, " ", "")
    code = F.when(m.startswith("+"), F.length(F.regexp_extract(digits, CALLING_CODE, 0))).otherwise(0)
    iban = F.length(plain).between(15, 34) & (_mod97(F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))) == 1)
    head = F.length(F.regexp_extract(m, _HEAD, 0))
    value = F.substr(m, head + 1)
    return (
        F.when(kind == "email", F.substring_index(m, "@", 1)).when(kind == "ipv6", _ipv6_digits(m)).when(kind == "iban", F.when(iban, F.substr(plain, F.lit(5))))
        .when(kind == "phone", F.when(F.length(digits).between(8, 15), F.substr(digits, code + 1))).when(kind == "dni", F.when(F.substr(m, F.lit(-1)) == _letter(F.substr(m, F.lit(1), F.lit(8))), F.substr(m, F.lit(1), F.lit(8))))
        .when(kind == "secret", F.when(value.rlike("[0-9]") & ((head > 0) | value.rlike("[A-Fa-f]")), value))
    )


def _letter(digits: Column) -> Column:
    return F.substr(F.lit(CHECK_LETTERS), (digits.try_cast("bigint") % 23 + 1).cast("int"), F.lit(1))


def _from_text(m: Column, kind: Column, made: Column) -> Column:
    """The pseudonym around the permuted text."""
    digits, plain = F.regexp_replace(m, "[^0-9]", ""), F.regexp_replace(m, " ", "")
    country = F.substr(plain, F.lit(1), F.lit(2))
    checked = F.concat(country, F.lpad((98 - _mod97(F.concat(made, country, F.lit("00")))).cast("string"), 2, "0"), made)
    return (
        F.when(kind == "email", F.concat(made, F.substr(m, F.length(made) + 1))).when(kind == "ipv6", F.regexp_replace(made, "(.{4})(?=.)", "$1:")).when(kind == "iban", _spaced(m, checked))
        .when(kind == "phone", _into(m, F.concat(F.substr(digits, F.lit(1), F.length(digits) - F.length(made)), made))).when(kind == "dni", F.concat(made, F.regexp_extract(m, "-?(?=.$)", 0), _letter(made)))
        .otherwise(F.concat(F.substr(m, F.lit(1), F.length(m) - F.length(made)), made))
    )


def _number(m: Column, kind: Column) -> Column:
    """(v, a, b, kind): what is permuted as a number below a * b; v is null if the value is not valid."""
    octet = [x.try_cast("bigint") for x in _parts(m, ".", 4)]
    ip = F.when(reduce(lambda x, y: x & y, [o <= 255 for o in octet]), ((octet[0] * 256 + octet[1]) * 256 + octet[2]) * 256 + octet[3])
    area, group, serial = (x.try_cast("bigint") for x in _parts(m, "-", 3))
    place = (F.when(area < 666, area - 1).otherwise(area - 2) * 99 + group - 1) * 9999 + serial - 1
    ssn = F.when(area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), place)
    _, dmy, mdy = _dmy(m)
    day = F.datediff(F.when(kind == "iso_date", F.try_to_date(m, "yyyy-MM-dd")).otherwise(F.coalesce(dmy, mdy)), F.lit(_EPOCH).cast("date")).cast("bigint")
    of = lambda v, a, b, name: F.struct(v.cast("bigint").alias("v"), F.lit(a).cast("bigint").alias("a"), F.lit(b).cast("bigint").alias("b"), F.lit(name).alias("kind"), F.floor(day / 146097).cast("bigint").alias("cycle"))
    return F.when(kind == "ipv4", of(ip, 1 << 16, 1 << 16, "ipv4")).when(kind == "ssn", of(ssn, 898 * 33, 3 * 9999, "ssn")).otherwise(of(day - F.floor(day / 146097) * 146097, 189, 773, "date"))


def _from_number(m: Column, kind: Column, n: Column, cycle: Column) -> Column:
    """The pseudonym of the permuted number. Dates with slashes or dots are read as day and month if that is a date, else the other way
    round; padding with zeros stays on."""
    ip = F.concat_ws(".", *[(F.shiftright(n, s) % 256).cast("string") for s in (24, 16, 8, 0)])
    area = F.floor(n / (99 * 9999))
    ssn = F.concat_ws("-", *[F.lpad(x.cast("string"), k, "0") for x, k in ((F.when(area < 665, area + 1).otherwise(area + 2), 3), (F.floor(n / 9999) % 99 + 1, 2), (n % 9999 + 1, 4))])
    new = F.date_add(F.lit(_EPOCH).cast("date"), (cycle * 146097 + n).cast("int"))
    sep, dmy, _ = _dmy(m)
    padded = m.rlike(r"^0|^\d\d[./]\d\d")
    text = lambda c: F.when(padded, F.lpad(c.cast("string"), 2, "0")).otherwise(c.cast("string"))
    d, mo = text(F.dayofmonth(new)), text(F.month(new))
    other = F.concat(F.when(dmy.isNotNull(), d).otherwise(mo), sep, F.when(dmy.isNotNull(), mo).otherwise(d), sep, F.lpad(F.year(new).cast("string"), 4, "0"))
    return F.when(n.isNull(), F.lit(None).cast("string")).when(kind == "ipv4", ip).when(kind == "ssn", ssn).when(kind == "iso_date", F.date_format(new, "yyyy-MM-dd")).otherwise(other)


def pseudonym(m: Column, key: Column) -> Column:
    """(kind, value, n) of a match: its pseudonym (itself if it is not valid; kind is null then) and how many values it has."""
    tests = list(_KINDS.items())
    kind = F.when(m.rlike(tests[0][1]), F.lit(tests[0][0]))
    for name, test in tests[1:]:
        kind = kind.when(m.rlike(test), F.lit(name))
    kind = kind.otherwise(F.lit("secret"))
    result = lambda k, value, n: F.struct(F.when(value.isNotNull(), k).alias("kind"), F.coalesce(value, m).alias("value"), n.alias("n"))
    hexed = lambda k, body: (k == "ipv6") | (k == "secret") & body.rlike("^[0-9A-Fa-f]{16,}$")

    def numbered(k: Column) -> Column:
        return _let(_number(m, k), lambda x: _let(feistel_number(x["v"], x["a"], x["b"], key, x["kind"]), lambda n: _let(_from_number(m, k, n, x["cycle"]), lambda v: result(k, v, F.lit(1)))))

    def lettered(k: Column, body: Column) -> Column:
        made = feistel_text(body, key, k, hexed(k, body))
        return _let(made, lambda x: _let(F.when(x.isNotNull(), _from_text(m, k, x)), lambda v: result(k, v, F.lit(1))))

    def carded(k: Column) -> Column:
        """What is no valid IBAN may still hold cards behind its first four characters."""
        head = F.when(k == "iban", F.regexp_extract(m, "^.{4} ?(?=[0-9]+(?: [0-9]+)*$)", 0)).otherwise("")
        run = F.when((k == "card") | (head != ""), F.substr(m, F.length(head) + 1))
        return _let(_cards(run, key), lambda x: result(k, F.concat(head, x["value"]), F.coalesce(x["n"], F.lit(0))))

    def of(k: Column) -> Column:
        return F.when(k.isin("ipv4", "ssn", "iso_date", "dmy_date"), numbered(k)).otherwise(_let(_body(m, k), lambda body: F.when((k == "card") | (k == "iban") & body.isNull(), carded(k)).otherwise(lettered(k, body))))

    return _let(kind, of)


#: The kinds of values that are replaced.
KINDS = ("email", "ipv4", "ipv6", "iso_date", "dmy_date", "phone", "ssn", "dni", "iban", "card", "secret")


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", counts: bool = False) -> DataFrame:
    """docs with personal data in text_col replaced under a secret key; all other columns as they are, whatever their names.

    The networks can be undone by whoever has the key, so there is no default one, and no plan shows it: it comes from a table of
    one row, by a subquery.

    counts adds the column pii_counts (map of kind to number of replaced values), in the place of one that docs may have of that name. A
    null text stays null, an empty one empty; an empty table gives an empty one; repeated rows get equal results. Texts of any
    length are taken whole, in time that grows with their length. Rows never move, so there is no shuffle and no state: a lost task is
    just run again.
    """
    if not key:
        raise ValueError("pseudonyms need a secret key")
    taken = set(docs.columns)

    def free(name: str) -> str:
        while name in taken:
            name = f"_{name}"
        taken.add(name)
        return name

    k, one, two = free("_key"), free("_swaps"), free("_gaps")
    text = F.col(f"`{text_col}`")
    found = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    secret = given(docs.sparkSession, [(key,)], "key string").scalar()
    keyed = docs.select("*", secret.alias(k))

    # Most texts have no candidate at all, which a cheap test tells: every valid value has a digit or the sign of an email.
    some = text.rlike("[0-9@]")
    swaps = F.when(some, F.transform(found, lambda m: pseudonym(m, F.col(k))))
    gaps = F.when(some, F.split(text, PATTERN, -1))
    # gap 0, value 0, gap 1, value 1, ..., gap n
    joined = F.concat(F.element_at(two, 1), F.array_join(F.transform(F.col(one), lambda s, i: F.concat(s["value"], F.element_at(F.col(two), i + 2))), ""))
    done = keyed.select(*[F.col(f"`{c}`") for c in docs.columns], swaps.alias(one), gaps.alias(two))
    changed = F.exists(F.col(one), lambda s: s["kind"].isNotNull())
    out = [F.when(changed, joined).otherwise(text).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if not (counts and c == "pii_counts")]
    if counts:
        replaced = F.filter(F.coalesce(F.col(one), F.array().cast("array<struct<kind:string,value:string,n:int>>")), lambda s: s["kind"].isNotNull())
        sums = lambda x: F.aggregate(F.filter(replaced, lambda s: s["kind"] == x), F.lit(0), lambda t, s: t + s["n"])
        out.append(F.map_from_entries(F.transform(F.array_sort(F.array_distinct(F.transform(replaced, lambda s: s["kind"]))), lambda x: F.struct(x, sums(x)))).alias("pii_counts"))
    return done.select(*out)
