"""Format-preserving pseudonyms for personal numbers and dates.

A value that passes its validity test becomes a row of symbols, each out of a fixed range: decimal
digits, octets of an address, parts of a date's day number. A Feistel network adds to one half of the
symbols a keyed function of the other half, round by round. That permutes the values of a format among
themselves: equal values keep equal pseudonyms in all documents, different ones stay different,
and every pseudonym is valid again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeweave.llm.common import text_of

ROUNDS = 10
_KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\d)",
    "iso_date": r"\d{4}[-/.]\d{1,2}[-/.]\d{1,2}(?!\d)",
    "day_first": r"\d{1,2}[-/.]\d{1,2}[-/.]\d{4}(?!\d)",
    "ssn": r"\d{3}-\d{2}-\d{4}(?!\d)",
    # with brackets, in groups of three, three and four, or behind a plus with 8 to 15 digits in any groups
    "phone": r"\+\d{1,2} ?\(\d{3}\) ?\d{3}[ -]\d{4}(?!\d)|(?:1[-. ]?)?\(\d{3}\)[-. ]?\d{3}[-. ]\d{4}(?!\d)"
             r"|(?:1[-. ])?\d{3}[-. ]\d{3}[-. ]\d{4}(?!\d)|\+\d(?:[-. ]?\(?\d\)?){7,14}(?!\d)",
    "card": r"\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}(?!\d)|\d{4}[ -]\d{6}[ -]\d{5}(?!\d)|\d{13,19}(?!\d)",
}
#: Candidates, longest formats first; one may not start inside a word or number, nor behind a point or hyphen of a number.
_ANY = r"(?<![A-Za-z0-9])(?<![0-9][.-])(?:" + "|".join(_KINDS.values()) + ")"
_FIRST_DAY, _DAYS = "1900-01-01", (17, 4297)  # 73,049 days to 2099-12-31, as two symbols


def _is(kind: str, value: Column) -> Column:
    return value.rlike("^(?:" + _KINDS[kind] + ")$")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _luhn_sum(digits: Column, doubled_from_right: int) -> Column:
    """Sum of the digits, every second one doubled, the first doubled being the given place from the right."""
    backwards = F.split(F.reverse(digits), "")
    return F.aggregate(
        F.transform(backwards, lambda d, i: F.when(i % 2 == doubled_from_right, F.shiftright(d.cast("int") * 2, 0)
                                                   - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int"))),
        F.lit(0), lambda a, d: a + d)


def _symbol(value: Column, size: Column | int) -> Column:
    return F.struct(value.cast("int").alias("v"), (F.lit(size) if isinstance(size, int) else size).cast("int").alias("n"))


def permuted(symbols: Column, key: str) -> Column:
    """The symbols after all rounds. Halves swap roles each round; a lone symbol is one half by itself."""
    def shifted(half: Column, other: Column, number: Column) -> Column:
        told = F.concat_ws(",", F.transform(other, lambda s: s["v"].cast("string")), F.size(half).cast("string"))

        def add(s: Column, i: Column) -> Column:
            bits = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), number.cast("string"), told, i.cast("string"),
                                                         s["n"].cast("string")), 256), 1, 12), 16, 10).cast("long")
            return _symbol(F.pmod(s["v"] + bits, s["n"].cast("long")), s["n"])
        return F.transform(half, add)

    half = F.floor(F.size(symbols) / 2).cast("int")
    start = F.struct(F.slice(symbols, F.lit(1), half).alias("l"), F.slice(symbols, half + 1, F.size(symbols)).alias("r"))

    def turn(s: Column, number: Column) -> Column:
        left, right = s["l"], s["r"]
        return F.struct(F.when(number % 2 == 0, shifted(left, right, number)).otherwise(left).alias("l"),
                        F.when(number % 2 == 1, shifted(right, left, number)).otherwise(right).alias("r"))

    end = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)
    return F.transform(F.concat(end["l"], end["r"]), lambda s: s["v"])


def _symbols_of(chars: Column) -> Column:
    """Letters and digits as symbols of their own class."""
    size = lambda c: F.when(c.rlike("[0-9]"), 10).otherwise(26)
    return F.transform(chars, lambda c: _symbol(
        F.when(c.rlike("[0-9]"), F.ascii(c) - 48).when(c.rlike("[a-z]"), F.ascii(c) - 97).otherwise(F.ascii(c) - 65), size(c)))


def _refilled(value: Column, fillers: Column) -> Column:
    """``value`` with its letters and digits replaced in turn by numbers of their class; marks stay."""
    chars = F.split(value, "")

    def put(acc: Column, c: Column) -> Column:
        v = F.element_at(fillers, acc["i"] + 1)
        letter = F.when(c.rlike("[0-9]"), F.char(v + 48)).when(c.rlike("[a-z]"), F.char(v + 97)).otherwise(F.char(v + 65))
        solid = c.rlike("[A-Za-z0-9]")
        return F.struct((acc["i"] + solid.cast("int")).alias("i"), F.concat(acc["t"], F.when(solid, letter).otherwise(c)).alias("t"))
    return F.aggregate(chars, F.struct(F.lit(0).alias("i"), F.lit("").alias("t")), put)["t"]


def _by_character(value: Column, key: str) -> Column:
    chars = F.filter(F.split(value, ""), lambda c: c.rlike("[A-Za-z0-9]"))
    return _refilled(value, permuted(_symbols_of(chars), key))


def _card(value: Column, key: str) -> Column:
    """All digits but the last are permuted, the last becomes the check digit of the others."""
    digits = _digits(value)
    body = permuted(_symbols_of(F.split(F.left(digits, F.length(digits) - 1), "")), f"{key}|card")
    check = F.pmod(-_luhn_sum(F.array_join(body.cast("array<string>"), ""), 0), F.lit(10))
    return _refilled(value, F.concat(body, F.array(check)))


def _ip(value: Column, key: str) -> Column:
    octets = F.transform(F.split(value, r"\."), lambda o: _symbol(o, 256))
    return F.array_join(permuted(octets, f"{key}|ip").cast("array<string>"), ".")


def _ssn(value: Column, key: str) -> Column:
    """Area 001-899 but 666, group from 01, serial from 0001: three symbols without gaps."""
    area, group, serial = (F.split(value, "-")[i].cast("int") for i in range(3))
    symbols = F.array(_symbol(F.when(area > 666, area - 2).otherwise(area - 1), 898), _symbol(group - 1, 99), _symbol(serial - 1, 9999))
    new = permuted(symbols, f"{key}|ssn")
    return F.format_string("%03d-%02d-%04d", F.when(new[0] >= 665, new[0] + 2).otherwise(new[0] + 1), new[1] + 1, new[2] + 1)


def _day(text: Column, layout: str) -> Column:
    padded = F.regexp_replace(text, r"(?<!\d)(\d)(?!\d)", "0$1")
    return F.to_date(F.try_to_timestamp(F.regexp_replace(padded, "[/.]", "-"), F.lit(layout)))


def _date(value: Column, layout: str, key: str) -> Column:
    """The day number inside 1900-2099 is permuted; separators and order of the parts stay, and where a part
    had one digit no zero is put before. NULL outside."""
    day = F.datediff(_day(value, layout), F.lit(_FIRST_DAY).cast("date"))
    one, two = _DAYS
    new = permuted(F.array(_symbol(F.floor(day / two), one), _symbol(day % two, two)), f"{key}|date")
    written = F.date_format(F.date_add(F.lit(_FIRST_DAY).cast("date"), new[0] * two + new[1]), layout)
    mark = F.regexp_extract(value, "([-/.])", 1)
    parts = F.zip_with(F.split(written, "-"), F.split(value, "[-/.]"),
                       lambda n, old: F.when(F.length(old) == 1, F.regexp_replace(n, "^0", "")).otherwise(n))
    return F.when((day >= 0) & (day < one * two), F.regexp_replace(F.array_join(parts, "-"), "-", mark))


def _valid_date(value: Column, layout: str) -> Column:
    return _day(value, layout).between(F.lit("1900-01-01").cast("date"), F.lit("2099-12-31").cast("date"))


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one candidate, NULL where the value is not valid in its format."""
    email = F.concat(_by_character(F.substring_index(value, "@", 1), f"{key}|mail"), F.lit("@"), F.substring_index(value, "@", -1))
    octets = F.forall(F.split(value, r"\."), lambda o: o.cast("int") <= 255)
    area = F.split(value, "-")[0]
    social = ~area.isin("000", "666") & (area < "900") & (F.split(value, "-")[1] != "00") & (F.split(value, "-")[2] != "0000")
    plus = F.regexp_extract(value, r"^(?:\+\d{1,3}(?=[-. (])|\+\d{1,2}|1(?=[-. (]))? ?", 0)
    phone = F.concat(plus, _by_character(F.substr(value, F.length(plus) + 1), f"{key}|phone"))
    month_first = F.regexp_replace(value, r"^(\d{1,2})(.)(\d{1,2})(.)", "$3$2$1$4")
    return (F.when(_is("email", value), email)
            .when(_is("ip", value), F.when(octets, _ip(value, key)))
            .when(_is("iso_date", value), F.when(_valid_date(value, "yyyy-MM-dd"), _date(value, "yyyy-MM-dd", key)))
            .when(_is("day_first", value), F.when(_valid_date(value, "dd-MM-yyyy"), _date(value, "dd-MM-yyyy", key))
                  .when(_valid_date(month_first, "dd-MM-yyyy"), _date(value, "MM-dd-yyyy", key)))
            .when(_is("ssn", value), F.when(social, _ssn(value, key)))
            .when(_is("phone", value), phone)
            .when(_is("card", value), F.when(_luhn_sum(_digits(value), 1) % 10 == 0, _card(value, key))))


def pseudonymised(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text with pseudonyms, found (values replaced).

    Replaced are e-mail names (the domain stays), IPv4 addresses, payment card numbers with a right check digit,
    social security numbers in assigned ranges, phone numbers with the area code in brackets, in groups of three,
    three and four digits or behind a plus (a country code set apart stays; of one that is not, two digits) and calendar dates of
    1900-2099, days and months of one or two digits, in ISO, day-first or, where only that is a date, month-first order. What is invalid stays as
    it is. A format's values are permuted under ``key``; no table of values is kept, so rows are independent.
    NULL texts come out empty with nothing found; ids and repeated rows pass as they are."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    some = F.col("text").rlike("[0-9@]")  # every format has one of these; most texts have none
    values = F.when(some, F.regexp_extract_all("text", F.lit(_ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("values", values)
    rows = rows.withColumn("new", F.transform("values", lambda v: pseudonym(v, key)))
    gaps = F.split("text", _ANY, -1)
    filled = F.zip_with("values", "new", lambda v, n: F.coalesce(n, v))
    mixed = F.zip_with(gaps, F.concat(filled, F.array(F.lit(""))), lambda g, v: F.concat(g, v))
    found = F.size(F.filter("new", lambda n: n.isNotNull())).cast("long")
    return rows.select("doc_id", F.when(F.size("values") > 0, F.array_join(mixed, "")).otherwise(F.col("text")).alias("text"),
                       found.alias("found"))
