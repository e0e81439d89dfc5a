"""Private data replaced by keyed pseudonyms of the same format.

Numbers and dates are found by pattern, validated, and moved to another value of
their format by a keyed Feistel permutation, so equal values get equal
pseudonyms in all documents and different values different ones. Built from
DataFrame functions only; every row is mapped by itself, without a shuffle.

Formats: card numbers (13 to 19 digits with a right check digit, which the
pseudonym has too), IPv4 addresses, phone numbers, social security numbers
(valid ranges), dates from 1900 to 2099, and the letters and digits of the local
part of e-mail addresses (lower-cased first; the domain stays).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenura.llm.common import table

ROUNDS = 10  # even and odd rounds move the left and the right half
FIRST_DAY, DAYS = "1900-01-01", (17, 4297)  # 73,049 days up to the end of 2099

OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
NO_DIGIT = "(?![0-9])"
# The formats, in the order in which they are tried.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){1,8}+",
    "ip": rf"(?<![0-9.]){OCTET}(?:\.{OCTET}){{3}}(?!\.?[0-9])",
    "date": rf"(?<![0-9./-])(?:(?:19|20)[0-9]{{2}}([-/.])[0-9]{{2}}\1[0-9]{{2}}|[0-9]{{1,2}}([-/.])[0-9]{{1,2}}\2(?:19|20)[0-9]{{2}})(?![0-9/-])",
    "ssn": rf"(?<![0-9-])(?!000|666|9)[0-9]{{3}}-(?!00)[0-9]{{2}}-(?!0000)[0-9]{{4}}(?![0-9-])",
    "phone": (
        rf"(?<![0-9])(?:\+?1[ .-]?)?(?:\([0-9]{{3}}\)[ .-]?|[0-9]{{3}}[.-])[0-9]{{3}}[ .-][0-9]{{4}}{NO_DIGIT}"
        rf"|\+[0-9]{{1,3}}(?:[ .-]?[0-9]{{2,4}}){{2,4}}{NO_DIGIT}"
    ),
    "card": (
        rf"(?<![0-9])(?:[0-9]{{13,19}}|[0-9]{{4}}(?: [0-9]{{4}}){{3}}|[0-9]{{4}}(?:-[0-9]{{4}}){{3}}"
        rf"|[0-9]{{4}} [0-9]{{6}} [0-9]{{5}}|[0-9]{{4}}-[0-9]{{6}}-[0-9]{{5}}){NO_DIGIT}"
    ),
}


def _any() -> str:
    """All formats in one pattern. The groups of the date are the first two."""
    order = ["date", *(k for k in PATTERNS if k != "date")]
    return "|".join(f"(?:{PATTERNS[k]})" for k in order)


def _whole(kind: str) -> str:
    return f"^(?:{PATTERNS[kind]})$"


def _number(text: Column) -> Column:
    return F.coalesce(text.try_cast("bigint"), F.lit(0).cast("bigint"))


def feistel(left: Column, right: Column, sizes: tuple[Column, Column], key: str, tweak: Column,
            inverse: bool = False) -> Column:
    """Keyed permutation of the pairs (left, right) below ``sizes``: the halves
    take turns in adding a keyed hash of the other. A struct (left, right)."""
    sizes = tuple(s.cast("bigint") for s in sizes)

    def turn(pair: Column, i: Column) -> Column:
        def moved(part: Column, other: Column, size: Column) -> Column:
            text = F.concat_ws("|", F.lit(key), tweak, i.cast("string"), other.cast("string"))
            hashed = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")
            return F.pmod(part - F.pmod(hashed, size) if inverse else part + F.pmod(hashed, size), size)

        a, b = pair["left"], pair["right"]
        first = F.struct(moved(a, b, sizes[0]).alias("left"), b.alias("right"))
        second = F.struct(a.alias("left"), moved(b, a, sizes[1]).alias("right"))
        return F.when(i % 2 == 0, first).otherwise(second)

    steps = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    start = F.struct(left.cast("bigint").alias("left"), right.cast("bigint").alias("right"))
    return F.aggregate(steps, start, turn)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def permute_text(text: Column, radix: int, key: str, tweak: str, inverse: bool = False) -> Column:
    """Permutation of the texts of equal length (2 to 20) over the first ``radix``
    digits of 0-9a-z; of length 1 by a keyed shift."""
    def halves(x: Column) -> Column:
        n = F.length(x)
        cut = F.floor(n / 2).cast("int")

        def numeral(part: Column) -> Column:
            return _number(part if radix == 10 else F.conv(part, radix, 10))

        def back(number: Column, size: Column) -> Column:
            digits = number.cast("string") if radix == 10 else F.lower(F.conv(number.cast("string"), 10, radix))
            return F.lpad(digits, size, "0")

        power = F.array(*(F.lit(radix**i) for i in range(11)))
        sizes = (F.element_at(power, cut + 1), F.element_at(power, n - cut + 1))
        mixed = F.concat(F.lit(f"{tweak}{radix}:"), n.cast("string"))
        moved = feistel(F.when(cut > 0, numeral(F.substr(x, F.lit(1), cut))).otherwise(0),
                        numeral(F.substr(x, cut + 1)), sizes, key, mixed, inverse)
        return _let(moved, lambda p: F.concat(F.when(cut > 0, back(p["left"], cut)).otherwise(""), back(p["right"], n - cut)))

    return _let(text, halves)


def _filled(shape: Column, chars: Column, kind: str) -> Column:
    """``shape`` with its characters of class ``kind`` replaced by ``chars`` in order."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def put(done: Column, c: Column) -> Column:
        taken = F.struct(F.concat(done["out"], F.substr(chars, done["at"], F.lit(1))).alias("out"), (done["at"] + 1).alias("at"))
        left = F.struct(F.concat(done["out"], c).alias("out"), done["at"].alias("at"))
        return F.when(c.rlike(kind), taken).otherwise(left)

    return F.aggregate(F.split(shape, ""), start, put, lambda done: done["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _card(value: Column, key: str, inverse: bool) -> Column:
    digits = _digits(value)
    payload = permute_text(F.substr(digits, F.lit(1), F.length(digits) - 1), 10, key, "card", inverse)

    def checked(p: Column) -> Column:
        fits = F.filter(F.sequence(F.lit(0), F.lit(9)), lambda c: F.call_function("luhn_check", F.concat(p, c.cast("string"))))
        return F.concat(p, F.element_at(fits, 1).cast("string"))

    valid = F.call_function("luhn_check", digits)
    return F.when(valid, _filled(value, _let(payload, checked), "[0-9]")).otherwise(value)


def _ip(value: Column, key: str, inverse: bool) -> Column:
    def moved(o: Column) -> Column:
        n = [o[i].cast("bigint") for i in range(4)]
        size = F.lit(65536)
        pair = feistel(n[0] * 256 + n[1], n[2] * 256 + n[3], (size, size), key, F.lit("ip"), inverse)
        return _let(pair, lambda p: F.concat_ws(".", *(
            x.cast("string") for h in ("left", "right") for x in (F.shiftright(p[h], 8), p[h] % 256))))

    return _let(F.split(value, r"\."), moved)


def _ssn(value: Column, key: str, inverse: bool) -> Column:
    area, group, serial = (F.substr(value, F.lit(a), F.lit(n)).cast("bigint") for a, n in ((1, 3), (5, 2), (8, 4)))
    pair = feistel(area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1,
                   (F.lit(898), F.lit(99 * 9999)), key, F.lit("ssn"), inverse)
    return _let(pair, lambda p: F.concat_ws(
        "-", F.lpad((p["left"] + F.when(p["left"] >= 665, 2).otherwise(1)).cast("string"), 3, "0"),
        F.lpad((F.floor(p["right"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((p["right"] % 9999 + 1).cast("string"), 4, "0")))


def _date(value: Column, key: str, inverse: bool) -> Column:
    """Year first, or else month first with slashes (day first if that is no
    date) and day first with dots and hyphens. Text that is no date stays."""
    parts = F.split(value, "[-/.]")

    def as_date(y: int, m: int, d: int) -> Column:
        return F.concat_ws("-", parts[y], F.lpad(parts[m], 2, "0"), F.lpad(parts[d], 2, "0")).try_cast("date")

    year_first = F.length(parts[0]) == 4
    month_first = F.contains(value, F.lit("/")) & as_date(2, 0, 1).isNotNull()
    day = F.when(year_first, as_date(0, 1, 2)).when(month_first, as_date(2, 0, 1)).otherwise(as_date(2, 1, 0))
    number = F.date_diff(day, F.lit(FIRST_DAY).cast("date"))
    pair = feistel(F.floor(number / DAYS[1]), number % DAYS[1], (F.lit(DAYS[0]), F.lit(DAYS[1])), key, F.lit("date"), inverse)
    mark = F.regexp_extract(value, "([-/.])", 1)

    def written(moved: Column) -> Column:
        y, m, d = (F.date_format(moved, x) for x in ("yyyy", "MM", "dd"))
        order = F.when(year_first, F.array(y, m, d)).when(month_first, F.array(m, d, y)).otherwise(F.array(d, m, y))
        return F.concat(order[0], mark, order[1], mark, order[2])

    moved = F.date_add(F.lit(FIRST_DAY).cast("date"), (pair["left"] * DAYS[1] + pair["right"]).cast("int"))
    return F.when(day.isNotNull(), _let(moved, written)).otherwise(value)


def _phone(value: Column, key: str, inverse: bool) -> Column:
    """The country code, if there is one, stays."""
    country = F.regexp_extract(value, r"^(\+[0-9]{1,3}(?=[ .(-])|\+1|1(?=[ .(-]))", 1)
    rest = F.substr(value, F.length(country) + 1)
    return F.concat(country, _filled(rest, permute_text(_digits(rest), 10, key, "phone", inverse), "[0-9]"))


def _email(value: Column, key: str, inverse: bool) -> Column:
    local, domain = F.lower(F.substring_index(value, "@", 1)), F.substring_index(value, "@", -1)
    chars = F.regexp_replace(local, "[^a-z0-9]", "")
    pieces = F.sequence(F.lit(0), F.floor((F.length(chars) - 1) / 18).cast("int"))
    moved = F.array_join(F.transform(pieces, lambda i: permute_text(
        F.substr(chars, i * 18 + 1, F.lit(18)), 36, key, "email", inverse)), "")
    return F.when(F.length(chars) > 0, F.concat(_filled(local, moved, "[a-z0-9]"), F.lit("@"), domain)).otherwise(value)


KINDS = {"email": _email, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def pseudonym(value: Column, key: str, inverse: bool = False) -> Column:
    """The pseudonym of one matched text; itself if it isn't valid."""
    out = F.when(F.lit(False), value)
    for kind, change in KINDS.items():
        out = out.when(value.rlike(_whole(kind)), change(value, key, inverse))
    return out.otherwise(value)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", inverse: bool = False,
                 count_col: str | None = None) -> DataFrame:
    """``docs`` with private data in ``text_col`` replaced; ``count_col`` names a new
    column with the number of replaced values (0 for null text), in place of one
    of that name.

    With ``inverse`` pseudonyms turn back to the values, e-mail addresses in
    lower case; numeric day-first dates with slashes may not. Null stays null,
    text without private data stays as it is; all rows and columns stay. A
    number that fails its validation isn't replaced."""
    text, pattern = F.col(text_col), F.lit(_any())
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    changed = F.transform(F.col("__found"), lambda m: pseudonym(m, key, inverse))
    pieces = F.zip_with(F.col("__gaps"), F.col("__new"), lambda g, m: F.concat(g, F.coalesce(m, F.lit(""))))
    likely = text.rlike("[0-9@]")
    none = F.array().cast("array<string>")
    # The columns of a row travel as one, so that none clashes with the ones added here.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"),
                       F.when(likely, found).otherwise(none).alias("__found"), text.alias("__text"))
    rows = rows.withColumn("__new", F.when(F.size("__found") > 0, changed).otherwise(none)).withColumn(
        "__gaps", F.when(F.size("__found") > 0, F.split(F.col("__text"), _any(), -1)))
    new_text = F.when(F.size("__found") > 0, F.array_join(pieces, "")).otherwise(F.col("__text"))
    columns = [(new_text if c == text_col else F.col("__row").getField(c)).alias(c) for c in docs.columns if c != count_col]
    if count_col:
        pairs = F.zip_with("__found", "__new", lambda a, b: (a != b).cast("int"))
        columns.append(F.aggregate(pairs, F.lit(0), lambda a, b: a + b).cast("bigint").alias(count_col))
    return rows.select(*columns)


def op7_pseudonyms(spark, data_dir: str) -> DataFrame:
    """Every document with its private values replaced, and their number."""
    docs = table(spark, data_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, key="corpus-2024", count_col="n_replaced")
