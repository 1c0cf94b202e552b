"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

One regular expression finds candidates; each is validated (Luhn, mod 97, calendar, number ranges) and
replaced by a keyed permutation of its own format, so equal values get equal pseudonyms in every document
and separators stay.  A card, phone or account that a candidate holds beside other groups is found by trying
its parts between separators.  The permutation is a Feistel network over two number halves (or two halves of a
string, character class by character class) with a keyed SHA-256 as round function:

    card    first digit kept, payload permuted, Luhn digit computed anew
    phone   country code kept, other digits permuted
    ssn     permuted among valid numbers
    ip      permuted among all IPv4 addresses; of IPv6 addresses the digits and letters of the groups
    date    permuted among the days of 1800-2199 (146097 = 189 * 773 days), written as before
    iban    country kept, letters and digits of the account permuted by class, check digits computed anew
    email   local part permuted by character class whatever its case, domain kept
    token   hexadecimal secrets of 32 digits or more, and keys behind a known prefix, permuted by class
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
KINDS = ("email", "token", "iban", "ip", "date", "ssn", "phone", "card")
_MONTHS = "January February March April May June July August September October November December".split()
_HEX = "[0-9A-Fa-f]{1,4}"
_KEY = r"AKIA(?=[0-9A-Z]{16}(?![0-9A-Za-z]))|sk-(?=[A-Za-z0-9_\-]{20,64}(?![A-Za-z0-9_\-]))|gh[pousr]_(?=[A-Za-z0-9]{36}(?![A-Za-z0-9]))"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: fixed values: each kind's pattern, tried in this order at a place
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}+@[A-Za-z0-9](?:[A-Za-z0-9\-]{0,62}\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "token": rf"(?<![A-Za-z0-9])(?:(?:{_KEY})[A-Za-z0-9_\-]+|(?:[0-9a-f]{{32,128}}+|[0-9A-F]{{32,128}}+)(?![A-Za-z0-9]))",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": rf"(?<![\d.])(?<![Vv]ersion )(?<![Vv])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)|(?<![0-9A-Za-z:])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}})(?![0-9A-Za-z:])",
    "date": rf"(?<![A-Za-z])(?:{'|'.join(f'{x[:3]}(?:{x[3:]})?' if x[3:] else x for x in _MONTHS)})\.? \d{{1,2}}, (?:18|19|20|21)\d\d(?!\d)|(?<![\d\-/.])(?:(?:18|19|20|21)\d\d-\d\d-\d\d|\d\d/\d\d/(?:18|19|20|21)\d\d|\d\d\.\d\d\.(?:18|19|20|21)\d\d)(?![\d\-/])",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .\-]?\(?\d{2,4}\)?(?:[ .\-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .\-]\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4})(?!\d)",
    "card": r"(?<![\d.\-])\d(?:[ \-]?\d){12,18}(?!\d)",
}
PATTERN = "|".join(f"(?:{PATTERNS[k]})" for k in KINDS)


def let(value: Column, use) -> Column:
    """use(value) with value written and computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _number(key: str, *parts) -> Column:
    """A keyed 60-bit number."""
    text = F.concat_ws("|", F.lit(key), *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def feistel(key: str, kind: str, left: Column, right: Column, a: Column, b: Column) -> Column:
    """A permutation of (left, right) in Z_a x Z_b as struct(l, r)."""

    def step(acc: Column, i: Column) -> Column:
        l, r = acc["l"], acc["r"]
        even = F.struct(F.pmod(l + F.pmod(_number(key, kind, i, r), a), a).alias("l"), r.alias("r"))
        odd = F.struct(l.alias("l"), F.pmod(r + F.pmod(_number(key, kind, i, l), b), b).alias("r"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def _pow10(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def permuted_digits(key: str, kind: str, digits: Column) -> Column:
    """A permutation of digit strings of one length (up to 30)."""

    def made(d: Column) -> Column:
        n = F.length(d)
        u = F.floor(n / 2).cast("int")
        left = F.coalesce(d.substr(F.lit(1), u).try_cast("long"), F.lit(0).cast("long"))
        out = feistel(key, kind, left, d.substr(u + 1, n - u).cast("long"), _pow10(u), _pow10(n - u))
        return let(out, lambda o: F.concat(F.when(u > 0, F.lpad(o["l"].cast("string"), u, "0")).otherwise(""), F.lpad(o["r"].cast("string"), n - u, "0")))

    return F.when(F.length(digits) == 0, digits).otherwise(let(digits, made))


def _refill(shape: Column, chars: Column, keep: str = "[^0-9]") -> Column:
    """shape with its characters outside the class ``keep`` replaced in turn by chars."""

    def at(i: Column) -> Column:
        seen = F.length(F.regexp_replace(shape.substr(F.lit(1), i), keep, ""))
        own = shape.substr(i, F.lit(1))
        return F.when(own.rlike(keep), own).otherwise(chars.substr(seen, F.lit(1)))

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(shape)), at), "")


def luhn_sum(digits: Column, double_last: bool) -> Column:
    """Luhn's sum; with double_last the last digit counts twice (payloads without their check digit)."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = digits.substr(i, F.lit(1)).cast("int")
        twice = (n - i) % 2 == (0 if double_last else 1)
        return acc + F.when(twice, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _shifted(key: str, kind: str, i: int, text: Column, other: Column, letters: int) -> Column:
    """Each letter and digit of text moved within its class by a keyed stream of the other half."""
    stream = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), F.lit(str(i)), other), 256)

    def move(j: Column) -> Column:
        bits = stream
        c = F.ascii(text.substr(j, F.lit(1)))
        by = F.conv(bits.substr(((j - 1) % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        moved = [F.char(F.lit(base) + F.pmod(c - base + by, F.lit(size))) for base, size in ((48, 10), (65, letters), (97, letters))]
        return F.when((c >= 48) & (c <= 57), moved[0]).when((c >= 65) & (c <= 90), moved[1]).when((c >= 97) & (c <= 122), moved[2]).otherwise(text.substr(j, F.lit(1)))

    return F.when(F.length(text) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), move), "")).otherwise(text)


def permuted_text(key: str, kind: str, text: Column, letters: int = 26) -> Column:
    """A permutation of strings that keeps every character's class (digit, upper, lower, other)."""
    u = F.floor((F.length(text) + 1) / 2).cast("int")
    state = F.struct(text.substr(F.lit(1), u).alias("l"), text.substr(u + 1, F.length(text)).alias("r"))

    def step(acc: Column, i: Column) -> Column:
        l, r = acc["l"], acc["r"]
        return F.when(
            i % 2 == 0, F.struct(_moved(l, r, i).alias("l"), r.alias("r"))
        ).otherwise(F.struct(l.alias("l"), _moved(r, l, i).alias("r")))

    def _moved(own: Column, other: Column, i: Column) -> Column:
        return _shifted(key, kind, 0, own, F.concat_ws("|", i.cast("string"), other), letters)

    # strings of one character have an empty right half: its rounds change nothing and the left half's suffice
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), state, step, lambda acc: F.concat(acc["l"], acc["r"]))


def _mod97(text: Column) -> Column:
    """The IBAN remainder of text, letters as 10..35."""

    def add(acc: Column, i: Column) -> Column:
        c = F.ascii(text.substr(i, F.lit(1)))
        return F.when(c >= 65, (acc * 100 + c - 55) % 97).otherwise((acc * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0), add)


def _within(m: Column, marks: str, rank, make) -> Column:
    """m with its best part replaced by make(part); a part runs from one of the marks (or an end) to another.

    rank gives a part's rank or null where it does not fit; of the smallest rank the longest part, then the first, is
    taken.  Null if none fits.
    """
    at = F.filter(F.sequence(F.lit(1), F.length(m)), lambda i: m.substr(i, F.lit(1)).rlike(marks))
    starts, ends = F.concat(F.array(F.lit(1)), F.transform(at, lambda i: i + 1)), F.concat(F.transform(at, lambda i: i - 1), F.array(F.length(m)))
    pairs = F.flatten(F.transform(starts, lambda i: F.transform(F.filter(ends, lambda j: j >= i), lambda j: F.struct(i.alias("i"), (j - i + 1).alias("n")))))
    ranked = F.transform(pairs, lambda x: F.struct(rank(m.substr(x["i"], x["n"])).alias("rank"), (-x["n"]).alias("less"), x["i"].alias("i"), x["n"].alias("n")))
    best = F.array_min(F.filter(ranked, lambda x: x["rank"].isNotNull()))

    def written(x: Column) -> Column:
        return F.when(x.isNotNull(), F.concat(m.substr(F.lit(1), x["i"] - 1), make(m.substr(x["i"], x["n"])), m.substr(x["i"] + x["n"], F.length(m))))

    return let(best, written)


def _card(key: str, m: Column) -> Column:
    """The card in m, which may hold other numbers before or after it: a card in one piece, else the longest part."""

    def rank(part: Column) -> Column:
        def of(d: Column) -> Column:
            valid = F.when(F.length(d).between(13, 19), (luhn_sum(d, False) % 10 == 0) & ~d.rlike(r"^(\d)\1*$"))
            return F.when(valid, F.when(F.length(d) == F.length(part), 0).otherwise(1))

        return let(digits_of(part), of)

    def made(d: Column) -> Column:
        body = F.concat(d.substr(F.lit(1), F.lit(1)), permuted_digits(key, "card", d.substr(F.lit(2), F.length(d) - 2)))
        return let(body, lambda x: F.concat(x, ((10 - luhn_sum(x, True) % 10) % 10).cast("string")))

    return _within(m, r"[ \-]", rank, lambda part: let(part, lambda p: let(let(digits_of(p), made), lambda x: _refill(p, x))))


def _phone(key: str, m: Column) -> Column:
    """The phone at the start of m, which may hold other numbers after it: ten digits behind +1, else the longest part."""

    def rank(part: Column) -> Column:
        n = F.length(digits_of(part))
        return F.when(n.between(7, 15) & part.rlike(rf"^(?:{PATTERNS['phone']})$"), F.when(part.rlike(r"^\+1[ .\-(]") & (n == 11), 0).otherwise(1))

    def make(part: Column) -> Column:
        code = F.when(part.startswith("+"), F.greatest(F.lit(1), F.length(F.regexp_extract(part, r"^\+(\d{1,3})(?=[ .\-(])", 1)))).otherwise(0)

        def made(d: Column) -> Column:
            return let(code, lambda c: F.concat(d.substr(F.lit(1), c), permuted_digits(key, "phone", d.substr(c + 1, F.length(d)))))

        return let(let(digits_of(part), made), lambda x: _refill(part, x))

    return _within(m, r"[ .\-]", rank, lambda part: let(part, make))


def _ssn(key: str, m: Column) -> Column:
    def made(d: Column) -> Column:
        area, group, serial = (d.substr(F.lit(i), F.lit(n)).cast("int") for i, n in ((1, 3), (4, 2), (6, 4)))
        index = F.when(area > 666, area - 2).otherwise(area - 1)
        out = feistel(key, "ssn", index, (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999))

        def written(o: Column) -> Column:
            back = F.when(o["l"] >= 665, o["l"] + 2).otherwise(o["l"] + 1)
            return F.concat(F.lpad(back.cast("string"), 3, "0"), F.lpad(F.floor(o["r"] / 9999 + 1).cast("string"), 2, "0"), F.lpad((o["r"] % 9999 + 1).cast("string"), 4, "0"))

        valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
        return F.when(valid, let(let(out, written), lambda x: _refill(m, x)))

    return let(digits_of(m), made)


def _ip(key: str, m: Column) -> Column:
    def made(o: Column) -> Column:
        out = feistel(key, "ip", o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536))
        return let(out, lambda x: F.concat_ws(".", *[y.cast("string") for y in (F.floor(x["l"] / 256), x["l"] % 256, F.floor(x["r"] / 256), x["r"] % 256)]))

    return F.when(m.contains(":"), permuted_text(key, "ip", m, 6)).otherwise(let(F.transform(F.split(m, r"\."), lambda x: x.try_cast("long")), made))


def _written_date(key: str, m: Column) -> Column:
    """A date with its month's name, written out or in three letters, a point after it or not."""
    name = F.regexp_extract(m, r"^([A-Za-z]+)\.? (\d{1,2}), (\d{4})$", 1)
    names, short = F.array(*[F.lit(x) for x in _MONTHS]), F.array(*[F.lit(x[:3]) for x in _MONTHS])
    month = F.array_position(short, F.substring(name, 1, 3)).cast("int")
    day = F.regexp_extract(m, r" (\d{1,2}),", 1)
    origin = F.to_date(F.lit("1800-01-01"))
    value = F.concat_ws("-", F.substring(m, -4, 4), F.lpad(month.cast("string"), 2, "0"), F.lpad(day, 2, "0")).try_cast("date")

    def made(v: Column) -> Column:
        days = F.datediff(v, origin)
        out = feistel(key, "date", F.floor(days / 773), days % 773, F.lit(189), F.lit(773))

        def written(d: Column) -> Column:
            at = F.month(d)
            long = F.element_at(names, at)
            new = F.when(F.length(name) == 3, F.element_at(short, at)).otherwise(long)
            return F.concat(new, F.when(m.contains("."), ".").otherwise(""), F.lit(" "), F.dayofmonth(d).cast("string"), F.lit(", "), F.date_format(d, "yyyy"))

        return F.when(v.isNotNull(), let(let(out, lambda o: F.date_add(origin, (o["l"] * 773 + o["r"]).cast("int"))), written))

    return let(value, made)


def _date(key: str, m: Column) -> Column:
    """Day before month, as most of the world writes; month before day where only that is a date."""
    iso, slash = m.contains("-"), m.contains("/")
    origin = F.to_date(F.lit("1800-01-01"))
    sep = F.when(slash, "/").otherwise(".")
    a, b, year = m.substr(F.lit(1), F.lit(2)), m.substr(F.lit(4), F.lit(2)), m.substr(F.lit(7), F.lit(4))
    usual = F.when(iso, m).otherwise(F.concat_ws("-", year, b, a)).try_cast("date")
    other = F.when(slash, F.concat_ws("-", year, a, b)).try_cast("date")

    def made(v: Column) -> Column:
        days = F.datediff(F.coalesce(v["usual"], v["other"]), origin)
        out = feistel(key, "date", F.floor(days / 773), days % 773, F.lit(189), F.lit(773))

        def written(text: Column) -> Column:
            y, mo, d = text.substr(F.lit(1), F.lit(4)), text.substr(F.lit(6), F.lit(2)), text.substr(F.lit(9), F.lit(2))
            return F.when(iso, text).when(v["usual"].isNotNull(), F.concat_ws("", d, sep, mo, sep, y)).otherwise(F.concat_ws("", mo, sep, d, sep, y))

        return F.when(days >= 0, let(let(out, lambda o: F.date_add(origin, (o["l"] * 773 + o["r"]).cast("int")).cast("string")), written))

    return F.when(m.rlike("^[A-Z]"), _written_date(key, m)).otherwise(let(F.struct(usual.alias("usual"), other.alias("other")), made))


def _iban(key: str, m: Column) -> Column:
    """The account in m, which may hold other words before or after it: the longest part that validates."""

    def rank(part: Column) -> Column:
        def of(c: Column) -> Column:
            fits = c.rlike("^[A-Z]{2}[0-9]{2}") & F.length(c).between(15, 34)
            return F.when(F.when(fits, _mod97(F.concat(c.substr(F.lit(5), F.length(c)), c.substr(F.lit(1), F.lit(4)))) == 1), 0)

        return let(F.regexp_replace(part, " ", ""), of)

    def make(part: Column) -> Column:
        def made(c: Column) -> Column:
            country = c.substr(F.lit(1), F.lit(2))

            def written(new: Column) -> Column:
                check = F.lpad((98 - _mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
                return let(F.concat(country, check, new), lambda x: _refill(part, x, "[^A-Z0-9]"))

            return let(permuted_text(key, "iban", c.substr(F.lit(5), F.length(c))), written)

        return let(F.regexp_replace(part, " ", ""), made)

    return _within(m, " ", rank, lambda part: let(part, make))


def _email(key: str, m: Column) -> Column:
    local = F.substring_index(m, "@", 1)

    def cased(new: Column) -> Column:
        own = lambda i: local.substr(i, F.lit(1))
        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(local)), lambda i: F.when(own(i).rlike("[A-Z]"), F.upper(new.substr(i, F.lit(1)))).otherwise(new.substr(i, F.lit(1)))), "")

    return F.concat(let(permuted_text(key, "email", F.lower(local)), cased), F.lit("@"), F.substring_index(m, "@", -1))


def _token(key: str, m: Column) -> Column:
    prefix = F.regexp_extract(m, rf"^(?:{_KEY})", 0)
    rest = F.substring(m, F.length(prefix) + 1, F.length(m))
    return F.when(prefix != "", F.concat(prefix, permuted_text(key, "token", rest))).when(m.rlike("[0-9]") & m.rlike("[A-Fa-f]"), permuted_text(key, "token", m, 6))


_MAKERS = {"email": _email, "token": _token, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def _replacement(key: str, m: Column) -> Column:
    """struct(kind, new) of the first kind that the whole candidate fits and validates for, else null."""
    made = [F.when(m.rlike(rf"^(?:{PATTERNS[k]})$"), _MAKERS[k](key, m)) for k in KINDS]
    named = F.array(*[F.struct(F.lit(k).alias("kind"), x.alias("new")) for k, x in zip(KINDS, made)])
    return F.try_element_at(F.filter(named, lambda x: x["new"].isNotNull()), F.lit(1))


def pseudonymise(docs: DataFrame, key: str, column: str = "text", counts: bool = True) -> DataFrame:
    """docs with the personal data of ``column`` replaced; with counts, n_<kind> for every kind.

    All other columns stay as they are (n_<kind> columns of the input are replaced), whatever their names.  Null texts
    stay null with counts of 0; very long texts are searched whole; candidates that fail validation stay as they are;
    equal rows give equal results; an empty table gives an empty one.
    """
    text, held_ = F.col(f"`{column}`"), "found"
    while held_ in {x.lower() for x in docs.columns}:
        held_ += "_"
    found = F.when(text.rlike("[0-9@]") & text.rlike(PATTERN), F.transform(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), lambda m: F.struct(m.alias("old"), _replacement(key, m).alias("got"))))
    held = docs.withColumn(held_, found)
    parts = F.zip_with(F.split(text, PATTERN, -1), F.col(held_), lambda s, x: F.concat(s, F.coalesce(x["got"]["new"], x["old"], F.lit(""))))
    out = held.withColumn(column, F.when(F.col(held_).isNull(), text).otherwise(F.array_join(parts, "")))
    if counts:
        count = lambda k: F.coalesce(F.size(F.filter(held_, lambda x: x["got"]["kind"] == k)), F.lit(0)).cast("int")
        out = out.withColumns({f"n_{k}": count(k) for k in KINDS})
    return out.drop(held_)
