"""Format-preserving pseudonyms for personal numbers, dates and addresses, in DataFrame functions only.

A value that passes its format's check is mapped to another valid value of the
same format by a Feistel network keyed by HMAC-SHA-256, a permutation of the format's values:
equal values get equal pseudonyms in every document, and the key undoes it. The
network adds in mixed radix, (a, b) -> (a + F(b) mod m, b) and so on, with m
and n fitting the format, so that no value falls out of it. Punctuation stays
as written. The local part of an e-mail address has no fixed format and gets a
keyed name.

Values that fail their check (Luhn, ranges, calendar) stay as they are.

Defined cases: a null text stays null, an empty one empty; repeated rows are
treated alike; very long texts, and words, are taken whole; an empty table gives no rows;
other columns pass through, whatever their names, but a column n_private is replaced by the count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Formats in order of precedence where they start at the same place.
#: A run of letters is tried once, from where it begins or the last value ended, and never given back, so a text takes time in proportion to it.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){1,126}+"
PHONE = r"\+1 ?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"
DATE = r"(?<![0-9])(?:1[89]|20|21)[0-9]{2}-[01][0-9]-[0-3][0-9](?![0-9])"
SSN = r"(?<![0-9-])[0-8][0-9]{2}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARD = r"(?<![0-9])[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])"
IP = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
#: The back reference counts groups of the whole pattern: CARD's is the only group.
ANY = "|".join([EMAIL, PHONE, DATE, SSN, CARD, IP])
#: Days of 1800-01-01 to 2199-12-31, one Gregorian cycle.
CYCLE_START, CYCLE = "1800-01-01", (189, 773)
ROUNDS = 8


def _keyed(key: str, *parts: Column) -> Column:
    """HMAC-SHA-256 of the parts, joined by |, as hexadecimal digits."""
    block = key.encode()
    block = (block if len(block) <= 64 else hashlib.sha256(block).digest()).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ mask for b in block)) for mask in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(F.concat_ws("|", *parts), "UTF-8")), 256))), 256)


def _feistel(value: Column, high: int, low: int, key: str, label: str, back: bool = False) -> Column:
    """A keyed permutation of 0 .. high * low - 1 (a bigint column)."""

    def f(i: Column, x: Column, m: int) -> Column:
        return F.pmod(F.conv(F.substring(_keyed(key, F.lit(label), i.cast("string"), x.cast("string")), 1, 15), 16, 10).cast("bigint"), F.lit(m))

    sign = -1 if back else 1

    def step(pair: Column, i: Column) -> Column:
        a, b = pair["a"], pair["b"]
        even = F.struct(F.pmod(a + sign * f(i, b, high), F.lit(high)).cast("bigint").alias("a"), b.alias("b"))
        odd = F.struct(a.alias("a"), F.pmod(b + sign * f(i, a, low), F.lit(low)).cast("bigint").alias("b"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    rounds = range(ROUNDS)[::-1] if back else range(ROUNDS)
    start = F.struct(F.floor(value / low).cast("bigint").alias("a"), F.pmod(value, F.lit(low)).cast("bigint").alias("b"))
    end = F.aggregate(F.array(*(F.lit(i) for i in rounds)), start, step)
    return end["a"] * low + end["b"]


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"[^0-9]", "")


def _spread(pattern: Column, digits: Column) -> Column:
    """digits in place of those of pattern, whose other characters stay."""
    places = F.split(pattern, "")
    nth = F.transform(places, lambda c, i: F.when(c.rlike("^[0-9]$"), F.substring(digits, F.length(_digits(F.substring(pattern, F.lit(1), i + 1))), F.lit(1))).otherwise(c))
    return F.array_join(nth, "")


def _luhn_sum(digits: Column, doubled_odd: bool) -> Column:
    """The Luhn sum, with every second digit doubled: from the first one, or the second."""

    def one(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == (0 if doubled_odd else 1), twice).otherwise(d)

    return F.aggregate(F.transform(F.split(digits, ""), one), F.lit(0), lambda s, d: s + d)


def _number(x: Column) -> Column:
    return x.cast("bigint")


def _phone(x: Column, key: str, back: bool) -> Column:
    d = F.substring(_digits(x), 2, 10)
    # any ten digits: numbering plans change, and people write numbers that no plan has
    new = _feistel(_number(d), 10**5, 10**5, key, "phone", back)
    return _spread(x, F.concat(F.lit("1"), F.lpad(new.cast("string"), 10, "0")))


def _date(x: Column, key: str, back: bool) -> Column:
    day = F.datediff(F.try_to_date(x, "yyyy-MM-dd"), F.lit(CYCLE_START).cast("date")).cast("bigint")
    new = _feistel(day, *CYCLE, key, "date", back)
    return F.coalesce(F.date_format(F.date_add(F.lit(CYCLE_START).cast("date"), new.cast("int")), "yyyy-MM-dd"), x)


def _ssn(x: Column, key: str, back: bool) -> Column:
    area, group, serial = (_number(F.split_part(x, F.lit("-"), F.lit(i))) for i in (1, 2, 3))
    valid = (area > 0) & (area != 666) & (group > 0) & (serial > 0)
    # areas 001-899 without 666: 898 of them
    value = (F.when(area > 666, area - 2).otherwise(area - 1) * 99 + group - 1) * 9999 + serial - 1
    new = _feistel(value, 898, 99 * 9999, key, "ssn", back)
    place = F.floor(new / (99 * 9999)).cast("bigint")
    out = F.concat_ws(
        "-",
        F.lpad(F.when(place >= 665, place + 2).otherwise(place + 1).cast("string"), 3, "0"),
        F.lpad((F.pmod(F.floor(new / 9999).cast("bigint"), F.lit(99)) + 1).cast("string"), 2, "0"),
        F.lpad((F.pmod(new, F.lit(9999)) + 1).cast("string"), 4, "0"),
    )
    return F.when(valid, out).otherwise(x)


def _card(x: Column, key: str, back: bool) -> Column:
    d = _digits(x)
    # 15 digits are permuted, the last follows from them
    new = F.lpad(_feistel(_number(F.substring(d, 1, 15)), 10**8, 10**7, key, "card", back).cast("string"), 15, "0")
    check = F.pmod(F.lit(10) - F.pmod(_luhn_sum(new, True), F.lit(10)), F.lit(10)).cast("string")
    return F.when(F.pmod(_luhn_sum(d, True), F.lit(10)) == 0, _spread(x, F.concat(new, check))).otherwise(x)


def _ip(x: Column, key: str, back: bool) -> Column:
    octets = [_number(F.split_part(x, F.lit("."), F.lit(i))) for i in (1, 2, 3, 4)]
    value = ((octets[0] * 256 + octets[1]) * 256 + octets[2]) * 256 + octets[3]
    new = _feistel(value, 65536, 65536, key, "ip", back)
    out = F.concat_ws(".", *(F.pmod(F.shiftright(new, 8 * i), F.lit(256)).cast("string") for i in (3, 2, 1, 0)))
    return F.when(F.greatest(*octets) <= 255, out).otherwise(x)


def _email(x: Column, key: str, back: bool) -> Column:
    name = F.substring(_keyed(key, F.lit("email"), F.lower(x)), 1, 12)
    return F.concat(F.lit("u"), name, F.lit("@"), F.split_part(x, F.lit("@"), F.lit(2)))


KINDS: list[tuple[str, str, Callable[[Column, str, bool], Column]]] = [("email", EMAIL, _email), ("phone", PHONE, _phone), ("date", DATE, _date), ("ssn", SSN, _ssn), ("card", CARD, _card), ("ip", IP, _ip)]


def pseudonym(x: Column, key: str, back: bool = False) -> Column:
    """The pseudonym of one matched value; back undoes it, e-mail addresses excepted."""
    out = x
    for _, pattern, made in reversed(KINDS):
        out = F.when(x.rlike(f"^(?:{pattern})$"), made(x, key, back)).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str, text_column: str = "text", length_column: str = "n_chars") -> DataFrame:
    """docs with pseudonyms in the text, and n_private, the number of values replaced. length_column, where there is one, follows the text."""
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    text = quoted(text_column)
    # names that no column has
    own = {n: n + "_" * max([0, *(len(c) for c in docs.columns)]) for n in ("found", "new", "text")}
    found, new, made = (quoted(n) for n in own.values())
    # most texts have nothing to replace and skip the rest
    has = F.size(found) > 0
    out = docs.withColumn(own["found"], F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    out = out.withColumn(own["new"], F.when(has, F.transform(found, lambda x: pseudonym(x, key))))
    between = F.split(text, ANY, -1)
    whole = F.when(has, F.array_join(F.zip_with(between, new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")).otherwise(text)
    count = F.when(has, F.size(F.filter(F.zip_with(found, new, lambda a, b: a != b), lambda x: x))).otherwise(0).cast("long")
    out = out.withColumn(own["text"], whole).withColumn("n_private", count)
    columns = [made.alias(c) if c == text_column else (F.length(made).cast(docs.schema[c].dataType).alias(c) if c == length_column else quoted(c)) for c in docs.columns if c != "n_private"]
    return out.select(*columns, "n_private")
