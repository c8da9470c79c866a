"""Format-preserving Feistel pseudonyms for validated numbers and dates.

Each value that passes its validation is permuted by a key within its own
format, so the same value gets the same pseudonym in every document:

- cards: 13 to 19 digits that pass the Luhn test; the payload is permuted and
  the check digit computed anew;
- IBANs whose check digits are right; digits after them are permuted, the
  check digits computed anew;
- social security numbers in valid ranges, permuted over the valid ranges;
- North American phone numbers, their ten digits permuted; ``+1`` stays;
- IPv4 addresses, permuted over all addresses;
- dates (year-month-day, day.month.year, month/day/year) that exist, from 1800
  to 2199, permuted over those days;
- all digits and all letters of an e-mail address's local part, whatever their
  number, in blocks of 34 digits or 12 letters, each tweaked by those before
  it; upper case stays where it was, and names that differ in case only have
  pseudonyms that differ in case only; the domain stays.

The permutation is f(x) = P^-1(P(x) + 1) over Z_a x Z_b, where P is an
alternating Feistel network with SHA-256 as round function: it has no fixed
points, so no value stays as it is. A separator stays where it was. Values
that fail their validation and all other text stay as they are.

Everything runs in built-in functions, row by row, without a shuffle.

Edge cases: a null text stays null, an empty one empty; repeated rows and rows
without an id or with a shared one each get the result of their own text; other
columns of the input are kept as they are, one named n_values in place of the
count.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.spans import let

ROUNDS = 4
# 1800-01-01 to 2199-12-31 has 146,097 = 189 * 773 days; 898 valid areas, 99 groups and 9,999 serials of a social security number.
DAYS = (189, 773)
SSN = (898 * 99, 9999)
OCTETS = (65536, 65536)
_L = "(?<![A-Za-z0-9_.@-])"
PATTERNS = {
    "email": "(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\\.[A-Za-z0-9-]{1,63}){1,5}",
    "iban": _L + "[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": _L + "(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\\.[0-9]{2}\\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![A-Za-z0-9_-])",
    "ssn": _L + "[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_-])",
    "ip": _L + "[0-9]{1,3}(?:\\.[0-9]{1,3}){3}(?![A-Za-z0-9_]|\\.[0-9])",
    "phone": "(?<![A-Za-z0-9_.@])(?:\\+?1[ .-]?)?(?:\\([0-9]{3}\\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![A-Za-z0-9_-])",
    "card": "(?<![A-Za-z0-9_.@-])[0-9](?:[ -]?[0-9]){12,18}(?![A-Za-z0-9_-])",
}
PATTERN = "|".join(PATTERNS.values())


def _round(key: str, tweak: Column, i: Column, half: Column, m: Column) -> Column:
    word = F.substring(F.sha2(F.concat_ws("|", F.lit(key), tweak, i, half), 256), 1, 15)
    return F.pmod(F.conv(word, 16, 10).cast("long"), m)


def permute(key: str, tweak: Column, left: Column, right: Column, a: Column, b: Column) -> Column:
    """struct<l, r> of the permuted pair (left, right) of Z_a x Z_b; a and b are below 2**59, and left < a, right < b."""
    pair = lambda x, y: F.struct(x.cast("long").alias("l"), y.cast("long").alias("r"))

    def forth(p: Column, i: Column) -> Column:
        return let(F.pmod(p["l"] + _round(key, tweak, i, p["r"], a), a), lambda x: pair(x, F.pmod(p["r"] + _round(key, tweak, -i, x, b), b)))

    def back(p: Column, i: Column) -> Column:
        return let(F.pmod(p["r"] - _round(key, tweak, -i, p["l"], b), b), lambda y: pair(F.pmod(p["l"] - _round(key, tweak, i, y, a), a), y))

    up, down = F.sequence(F.lit(1), F.lit(ROUNDS)), F.sequence(F.lit(ROUNDS), F.lit(1))

    def shift(p: Column) -> Column:
        carry = p["r"] == b - 1
        return pair(F.when(carry, F.pmod(p["l"] + 1, a)).otherwise(p["l"]), F.when(carry, F.lit(0)).otherwise(p["r"] + 1))

    return F.aggregate(down, let(F.aggregate(up, pair(left, right), forth), shift), back)


def permute_digits(key: str, tweak: str, digits: Column, more: Column | None = None) -> Column:
    """A string of 1 to 34 decimal digits, permuted among those of its length; more is added to the tweak."""
    n = F.length(digits)
    m = F.floor(n / 2).cast("int")
    ten = lambda k: F.pow(F.lit(10.0), k).cast("long")
    left = F.when(m > 0, F.substring(digits, F.lit(1), m)).otherwise(F.lit("0"))
    right = F.substring(digits, m + 1, n - m)
    out = permute(key, F.concat(F.lit(f"{tweak}:"), n, F.lit("") if more is None else more), left.cast("long"), right.cast("long"), ten(m), ten(n - m))
    return let(out, lambda p: F.concat(F.when(m > 0, F.lpad(p["l"].cast("string"), m, "0")).otherwise(F.lit("")), F.lpad(p["r"].cast("string"), n - m, "0")))


def in_blocks(text: Column, size: int, new: Callable[[Column, Column], Column]) -> Column:
    """text in blocks of size characters, each replaced by new(block, tweak).

    The tweak, empty for the first block, names the block's number and the text
    before it, so the map of whole texts is one-to-one where that of blocks is.
    """

    def block(i: Column) -> Column:
        tweak = F.when(i > 0, F.concat(F.lit(":"), i, F.lit(":"), F.substring(text, F.lit(1), i * size))).otherwise(F.lit(""))
        return let(F.struct(F.substring(text, i * size + 1, F.lit(size)).alias("b"), tweak.alias("t")), lambda x: new(x["b"], x["t"]))

    last = F.floor((F.length(text) - 1) / size).cast("int")
    return F.when(F.length(text) > 0, F.array_join(F.transform(F.sequence(F.lit(0), last), block), "")).otherwise(F.lit(""))


def refill(shape: Column, chars: Column, kind: str) -> Column:
    """shape with its characters that match kind replaced, in order, by those of chars."""
    each = F.split(shape, "")
    out = F.aggregate(
        each,
        F.struct(F.lit("").alias("s"), F.lit(1).alias("at")),
        lambda acc, c: F.when(c.rlike(kind), F.struct(F.concat(acc["s"], F.substring(chars, acc["at"], F.lit(1))).alias("s"), (acc["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(acc["s"], c).alias("s"), acc["at"].alias("at"))),
        lambda acc: acc["s"],
    )
    return out


def _only(x: Column, kind: str) -> Column:
    return F.regexp_replace(x, f"[^{kind}]", "")


def luhn_sum(digits: Column, double_last: bool) -> Column:
    """Sum of the Luhn test over a digit string; whether its last digit is one that doubles."""
    def add(acc: Column, c: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.struct((acc["s"] + F.when(acc["dbl"], twice).otherwise(d)).alias("s"), (~acc["dbl"]).alias("dbl"))

    return F.aggregate(F.split(F.reverse(digits), ""), F.struct(F.lit(0).alias("s"), F.lit(double_last).alias("dbl")), add, lambda acc: acc["s"])


def luhn_valid(digits: Column) -> Column:
    return F.pmod(luhn_sum(digits, False), F.lit(10)) == 0


def iban_rest(text: Column) -> Column:
    """The compact IBAN modulo 97, letters counting from 10."""
    moved = F.concat(F.substring(text, F.lit(5), F.length(text)), F.substring(text, 1, 4))

    def add(acc: Column, c: Column) -> Column:
        letter = F.ascii(c) >= 65
        value = F.when(letter, F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
        return F.pmod(acc * F.when(letter, 100).otherwise(10) + value, F.lit(97))

    return F.aggregate(F.split(moved, ""), F.lit(0), add)


def _card(key: str) -> Callable[[Column], Column]:
    def new(m: Column) -> Column:
        digits = _only(m, "0-9")
        payload = F.substring(digits, F.lit(1), F.length(digits) - 1)

        def out(p: Column) -> Column:
            check = F.pmod(10 - F.pmod(luhn_sum(p, True), F.lit(10)), F.lit(10)).cast("string")
            return refill(m, F.concat(p, check), "[0-9]")

        return F.when(luhn_valid(digits), let(permute_digits(key, "card", payload), out))

    return new


def _iban(key: str) -> Callable[[Column], Column]:
    def new(m: Column) -> Column:
        compact = F.replace(m, F.lit(" "), F.lit(""))
        bban = F.substring(compact, F.lit(5), F.length(compact))

        def out(b: Column) -> Column:
            check = 98 - iban_rest(F.concat(F.substring(compact, 1, 2), F.lit("00"), b))
            return refill(m, F.concat(F.substring(compact, 1, 2), F.lpad(check.cast("string"), 2, "0"), b), "[A-Z0-9]")

        some = F.length(_only(bban, "0-9")) > 0
        return F.when((iban_rest(compact) == 1) & some, let(refill(bban, permute_digits(key, "iban", _only(bban, "0-9")), "[0-9]"), out))

    return new


def _date(key: str) -> Callable[[Column], Column]:
    def new(m: Column) -> Column:
        kind = F.substring(m, 3, 1)  # "." or "/", else a digit of the year
        pattern = {".": "dd.MM.yyyy", "/": "MM/dd/yyyy"}
        iso = F.when(kind == ".", F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 4, 2), F.substring(m, 1, 2)))
        iso = iso.when(kind == "/", F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 1, 2), F.substring(m, 4, 2))).otherwise(m)
        day = iso.try_cast("date")
        first = F.lit("1800-01-01").cast("date")
        n = F.datediff(day, first)
        valid = day.isNotNull() & (n >= 0) & (n < DAYS[0] * DAYS[1])

        def out(p: Column) -> Column:
            moved = F.date_add(first, (p["l"] * DAYS[1] + p["r"]).cast("int"))
            return F.when(kind == ".", F.date_format(moved, pattern["."])).when(kind == "/", F.date_format(moved, pattern["/"])).otherwise(F.date_format(moved, "yyyy-MM-dd"))

        pair = permute(key, F.lit("date"), F.floor(n / DAYS[1]), F.pmod(n, F.lit(DAYS[1])), F.lit(DAYS[0]), F.lit(DAYS[1]))
        return F.when(valid, let(pair, out))

    return new


def _ssn(key: str) -> Callable[[Column], Column]:
    def new(m: Column) -> Column:
        area, group, serial = (F.substring(m, at, k).cast("int") for at, k in ((1, 3), (5, 2), (8, 4)))
        valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
        rank = F.when(area > 666, area - 2).otherwise(area - 1)

        def out(p: Column) -> Column:
            a = F.floor(p["l"] / 99) + 1
            a = F.when(a >= 666, a + 1).otherwise(a)
            return F.concat_ws("-", F.lpad(a.cast("string"), 3, "0"), F.lpad((F.pmod(p["l"], F.lit(99)) + 1).cast("string"), 2, "0"), F.lpad((p["r"] + 1).cast("string"), 4, "0"))

        return F.when(valid, let(permute(key, F.lit("ssn"), rank * 99 + group - 1, serial - 1, F.lit(SSN[0]), F.lit(SSN[1])), out))

    return new


def _ip(key: str) -> Callable[[Column], Column]:
    def new(m: Column) -> Column:
        octets = F.transform(F.split(m, "\\."), lambda x: x.cast("int"))
        valid = F.forall(octets, lambda x: x < 256) & ~m.rlike("(^|\\.)0[0-9]")

        def out(p: Column) -> Column:
            return F.concat_ws(".", F.floor(p["l"] / 256), F.pmod(p["l"], F.lit(256)), F.floor(p["r"] / 256), F.pmod(p["r"], F.lit(256)))

        pair = let(octets, lambda o: permute(key, F.lit("ip"), o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(OCTETS[0]), F.lit(OCTETS[1])))
        return F.when(valid, let(pair, out))

    return new


def _phone(key: str) -> Callable[[Column], Column]:
    def new(m: Column) -> Column:
        digits = _only(m, "0-9")
        last = F.right(digits, F.lit(10))
        lead = F.substring(digits, F.lit(1), F.length(digits) - 10)
        return refill(m, F.concat(lead, permute_digits(key, "phone", last)), "[0-9]")

    return new


def _email(key: str) -> Callable[[Column], Column]:
    """All digits and letters of the local part, each within its kind; letters by a permutation of base-26 numbers."""

    def letters(found: Column, tweak: Column) -> Column:
        n = F.length(found)
        m = F.floor(n / 2).cast("int")
        number = lambda s: F.aggregate(F.filter(F.split(s, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda acc, c: acc * 26 + F.ascii(c) - 97)
        base = lambda k: F.pow(F.lit(26.0), k).cast("long")

        def text(v: Column, k: Column) -> Column:
            steps = F.sequence(F.lit(1), k)
            return F.when(k > 0, F.aggregate(steps, F.struct(F.lit("").alias("s"), v.alias("v")), lambda acc, _: F.struct(F.concat(F.char(F.pmod(acc["v"], F.lit(26)) + 97), acc["s"]).alias("s"), F.floor(acc["v"] / 26).cast("long").alias("v")), lambda acc: acc["s"])).otherwise(F.lit(""))

        out = permute(key, F.concat(F.lit("letters:"), n, tweak), number(F.substring(found, F.lit(1), m)), number(F.substring(found, m + 1, n - m)), base(m), base(n - m))
        return let(out, lambda p: F.concat(text(p["l"], m), text(p["r"], n - m)))

    def new(m: Column) -> Column:
        local, domain = F.substring_index(m, "@", 1), F.substring(m, F.locate("@", m), F.length(m))
        digits = let(_only(local, "0-9"), lambda s: in_blocks(s, 34, lambda x, t: permute_digits(key, "email", x, t)))
        named = let(F.lower(_only(local, "A-Za-z")), lambda s: in_blocks(s, 12, letters))
        changed = let(digits, lambda s: refill(local, s, "[0-9]"))
        cased = lambda out: F.array_join(F.transform(F.split(out, ""), lambda c, i: F.when(F.substring(local, i + 1, F.lit(1)).rlike("[A-Z]"), F.upper(c)).otherwise(c)), "")
        return F.concat(let(let(named, lambda s: let(changed, lambda c: refill(c, s, "[A-Za-z]"))), cased), domain)

    return new


MAKERS = {"email": _email, "iban": _iban, "date": _date, "ssn": _ssn, "ip": _ip, "phone": _phone, "card": _card}


def _kind(m: Column) -> Column:
    """Which pattern a match of PATTERN is of; the patterns' order decides, as it did in the match."""
    kind = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, p in PATTERNS.items():
        kind = kind.when(m.rlike(f"^(?:{p})$"), F.lit(name))
    return kind


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one match of PATTERN; the match itself where it fails its validation."""
    def by(kind: Column) -> Column:
        out = F.when(F.lit(False), F.lit(None).cast("string"))
        for name, make in MAKERS.items():
            out = out.when(kind == name, make(key)(m))
        return out

    return F.coalesce(let(_kind(m), by), m)


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with the values in its text column replaced, and n_values long (how many were replaced)."""
    names = [f"_c{i}" for i in range(len(docs.columns))]  # clash with none of the columns made here
    at = names[docs.columns.index(text)]
    col = F.col(at)
    some = col.rlike("[0-9][0-9 .()/-]{5}|@")  # few texts go further
    old = F.regexp_extract_all(col, F.lit(PATTERN), F.lit(0))
    new = F.transform(old, lambda m: pseudonym(m, key))
    gaps = F.split(col, PATTERN, -1)

    def joined(n: Column) -> Column:
        parts = F.zip_with(gaps, n, lambda g, m: F.concat(g, F.coalesce(m, F.lit(""))))
        changed = F.size(F.filter(F.zip_with(old, n, lambda a, b: a != b), lambda x: x))
        return F.struct(F.array_join(parts, "").alias("text"), changed.cast("long").alias("n"))

    out = docs.toDF(*names).withColumn("new", F.when(some & col.rlike(PATTERN), let(new, joined)))
    own = {at: F.coalesce(F.col("new.text"), col)}
    kept = [own.get(n, F.col(n)).alias(c) for n, c in zip(names, docs.columns, strict=True)]
    return out.select(*kept, *([] if "n_values" in docs.columns else [F.coalesce(F.col("new.n"), F.lit(0).cast("long")).alias("n_values")]))
