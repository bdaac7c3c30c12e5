"""Format-preserving pseudonyms for personal data by a keyed Feistel network [native]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
FIRST_DAY = "1900-01-01"
DAYS = (270, 271)  # dates from FIRST_DAY on, 73,170 days, as a product of two numbers

OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
PATTERNS = {
    "email": r"[A-Za-z0-9_][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"""(?<=\b(?i:token|secret|password|passwd|api_key|apikey)\s?[=:]\s?["'])[^"'\s]{8,}(?=["'])""",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "date": r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\d/-])",
    "ip": rf"(?<![\d.]){OCTET}(?:\.{OCTET}){{3}}(?!\.?\d)",
    "ssn": r"(?<![\d-])(?!000|666|9\d\d)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)"
    r"|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d.-])",
    # two digits glued to capitals are no part of a number that is whole without them
    "number": r"(?<![\d])(?!(?<=[A-Z]{2})\d\d \d(?:[ -]?\d){12,18}(?!\d))\d(?:[ -]?\d){12,18}(?![\d])",
}
# IBAN lengths of the countries that have them (ISO 13616)
IBAN_SIZES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
SIZED_IBAN = r"\b(?=((?:%s)\b))" % "|".join(
    rf"(?:{codes.replace(' ', '|')})\d{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")
    for n, codes in IBAN_SIZES.items()
)
# a match is what the first of these patterns says; what none matches whole is a secret
KINDS = ["email", "iban", "date", "ip", "ssn", "phone", "number"]
BEFORE_IBAN, AFTER_IBAN = ("|".join(f"(?:{PATTERNS[k]})" for k in ks) for ks in (["email", "secret"], KINDS[2:]))


def keyed(key: str, *parts: Column) -> Column:
    """60 bits of a keyed digest."""
    joined = F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(joined.cast("binary"), 256), 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, m_left: Column, m_right: Column, key: str, tweak: Column) -> Column:
    """`struct<l, r>`: a keyed permutation of the pairs below (`m_left`, `m_right`)."""

    def step(acc: Column, i: Column) -> Column:
        l, r = acc["l"], acc["r"]
        return F.when(
            i % 2 == 0, F.struct(((l + keyed(key, tweak, i, r)) % m_left).alias("l"), r.alias("r"))
        ).otherwise(F.struct(l.alias("l"), ((r + keyed(key, tweak, i, l)) % m_right).alias("r")))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, step)


def bound(value: Column, use) -> Column:
    """`use(value)` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def power_of_ten(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(10**i) for i in range(18)]), n + 1)


def permute_digits(digits: Column, key: str, tweak: str) -> Column:
    """A keyed permutation of the digit strings of each length from 2 to 34; shorter ones stay."""

    def work(d: Column) -> Column:
        n = F.char_length(d)
        a = F.floor(n / 2).cast("int")
        b = n - a
        halves = feistel(
            F.substring(d, F.lit(1), a), F.substring(d, a + 1, b), power_of_ten(a), power_of_ten(b), key, F.concat(F.lit(tweak), n)
        )
        return bound(halves, lambda h: F.concat(F.lpad(h["l"].cast("string"), a, F.lit("0")), F.lpad(h["r"].cast("string"), b, F.lit("0"))))

    return bound(digits, lambda d: F.when(F.char_length(d) < 2, d).otherwise(work(d)))


def refill(shape: Column, digits: Column) -> Column:
    """`shape` with its digits replaced by `digits` in order."""

    def step(acc: Column, c: Column) -> Column:
        put = F.struct(F.concat(acc["s"], F.substring(digits, acc["k"], F.lit(1))).alias("s"), (acc["k"] + 1).alias("k"))
        return F.when(c.rlike("^[0-9]$"), put).otherwise(F.struct(F.concat(acc["s"], c).alias("s"), acc["k"].alias("k")))

    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("k"))
    return F.aggregate(F.split(shape, ""), start, step, lambda acc: acc["s"])


def only_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn_digit(payload: Column) -> Column:
    """The check digit that makes the payload valid."""
    n = F.char_length(payload)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(payload, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when((n - i) % 2 == 0, twice).otherwise(d)

    return F.pmod(-F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add), F.lit(10))


def masked_number(m: Column, key: str) -> Column:
    """Account and card numbers: the distance of the last digit to the right check digit is kept, so valid stays valid."""

    def work(d: Column) -> Column:
        n = F.char_length(d)
        payload = F.substring(d, F.lit(1), n - 1)
        off = F.pmod(F.substring(d, n, F.lit(1)).cast("int") - luhn_digit(payload), F.lit(10))
        return bound(
            permute_digits(payload, key, "number"),
            lambda p: refill(m, F.concat(p, F.pmod(luhn_digit(p) + off, F.lit(10)).cast("string"))),
        )

    return bound(only_digits(m), work)


def masked_ip(m: Column, key: str) -> Column:
    def work(o: Column) -> Column:
        octet = [F.get(o, F.lit(i)).cast("long") for i in range(4)]
        size = F.lit(65536).cast("long")
        halves = feistel(octet[0] * 256 + octet[1], octet[2] * 256 + octet[3], size, size, key, F.lit("ip"))
        parts = lambda h: [F.floor(h["l"] / 256), h["l"] % 256, F.floor(h["r"] / 256), h["r"] % 256]
        return bound(halves, lambda h: F.concat_ws(".", *[p.cast("string") for p in parts(h)]))

    return bound(F.split(m, r"\."), work)


def real_date(m: Column) -> Column:
    """The date that `m` writes, null if there is none; day before month where both can be."""
    iso = F.try_to_timestamp(m, F.lit("yyyy-MM-dd"))
    slash = F.regexp_replace(m, r"\.", "/")
    day_first, month_first = F.try_to_timestamp(slash, F.lit("d/M/yyyy")), F.try_to_timestamp(slash, F.lit("M/d/yyyy"))
    return F.when(F.substring(m, 5, 1) == "-", iso).otherwise(F.coalesce(day_first, month_first)).cast("date")


def masked_date(m: Column, key: str) -> Column:
    """Another date in the same notation, day before month; dates out of range stay."""

    def work(x: Column) -> Column:
        a, b = (F.lit(n).cast("long") for n in DAYS)
        halves = feistel(F.floor(x / DAYS[1]), x % DAYS[1], a, b, key, F.lit("date"))
        day = bound(halves, lambda h: F.date_add(F.lit(FIRST_DAY).cast("date"), (h["l"] * DAYS[1] + h["r"]).cast("int")))
        styles = F.when(F.contains(m, F.lit("/")), F.date_format(day, "dd/MM/yyyy")).when(
            F.contains(m, F.lit(".")), F.date_format(day, "dd.MM.yyyy")
        )
        in_range = (x >= 0) & (x < DAYS[0] * DAYS[1])
        return F.when(in_range, styles.otherwise(F.date_format(day, "yyyy-MM-dd"))).otherwise(m)

    return bound(F.date_diff(real_date(m), F.lit(FIRST_DAY).cast("date")).cast("long"), work)


def remainder_97(text: Column) -> Column:
    """A text of digits and capital letters (A is 10, Z is 35) modulo 97."""

    def add(r: Column, c: Column) -> Column:
        return F.when(c == "", r).when(c.rlike("[0-9]"), (r * 10 + c.cast("int")) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), add)


def iban_valid(m: Column) -> Column:
    plain = F.replace(m, F.lit(" "), F.lit(""))
    return remainder_97(F.concat(F.substring(plain, F.lit(5), F.char_length(plain)), F.substring(plain, 1, 4))) == 1


def masked_iban(m: Column, key: str) -> Column:
    """Digits of the account part are permuted and the check digits worked out again."""
    head = F.substring(m, 1, 2)
    tail = F.substring(m, F.lit(5), F.char_length(m))

    def work(new: Column) -> Column:
        check = 98 - remainder_97(F.concat(F.replace(new, F.lit(" "), F.lit("")), head, F.lit("00")))
        return F.concat(head, F.lpad(check.cast("string"), 2, "0"), new)

    return bound(refill(tail, permute_digits(only_digits(tail), key, "iban")), work)


def masked_phone(m: Column, key: str) -> Column:
    """The country code stays, the other digits are permuted."""
    code = F.regexp_extract(m, r"^(\+\d{1,3}(?=[ .(-]))?", 0)
    rest = F.substring(m, F.char_length(code) + 1, F.char_length(m))
    return F.concat(code, refill(rest, permute_digits(only_digits(rest), key, "phone")))


def masked_email(m: Column, key: str) -> Column:
    name = F.substring(F.sha2(F.concat(F.lit(key + "|email|"), F.lower(m)).cast("binary"), 256), 1, 10)
    return F.concat(F.lit("u"), name, F.lit("@"), F.substring_index(m, "@", -1))


def masked_secret(m: Column, key: str) -> Column:
    name = F.sha2(F.concat(F.lit(key + "|secret|"), m).cast("binary"), 512)
    return F.rpad(F.lit(""), F.char_length(m), name)


def pattern_of(text: Column) -> Column:
    """What to look for in `text`: all patterns, with the IBANs that are valid in place of their shape.

    An IBAN may begin at any word and ends after its country's length, whatever
    follows; the longest shape is tried as well, for other codes. What fails
    the remainder takes nothing from the patterns after it.
    """
    shapes = [SIZED_IBAN, rf"\b(?=({PATTERNS['iban'][2:]}))"]
    candidates = F.concat(*[F.regexp_extract_all(text, F.lit(s), F.lit(1)) for s in shapes])

    def join(valid: Column) -> Column:
        ibans = F.concat(F.lit(r"|(?:\b(?:"), F.array_join(valid, "|"), F.lit(r")\b)"))
        return F.concat(F.lit(BEFORE_IBAN), F.when(F.size(valid) > 0, ibans).otherwise(""), F.lit("|" + AFTER_IBAN))

    return F.when(text.rlike(PATTERNS["iban"]), bound(F.array_distinct(F.filter(candidates, iban_valid)), join)).otherwise(
        F.lit(BEFORE_IBAN + "|" + AFTER_IBAN)
    )


def kind_of(m: Column) -> Column:
    kind = F.lit("secret")
    for k in reversed(KINDS):
        whole = m.rlike(rf"^(?:{PATTERNS[k]})$")
        kind = F.when(whole & iban_valid(m) if k == "iban" else whole, k).otherwise(kind)
    # what is only shaped like a date is no personal datum
    return F.when((kind == "date") & real_date(m).isNull(), F.lit(None)).otherwise(kind)


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    return (
        F.when(kind == "email", masked_email(m, key))
        .when(kind == "iban", masked_iban(m, key))
        .when(kind == "date", masked_date(m, key))
        .when(kind == "ip", masked_ip(m, key))
        .when(kind == "ssn", refill(m, permute_digits(only_digits(m), key, "ssn")))
        .when(kind == "phone", masked_phone(m, key))
        .when(kind == "number", masked_number(m, key))
        .when(kind == "secret", masked_secret(m, key))
        .otherwise(m)
    )


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """`docs` with `masked` (the text with pseudonyms) and `found` (`array<struct<kind, pseudonym>>`, in order).

    Numbers and dates are validated (octets, Luhn, IBAN remainder, calendar)
    and mapped by a keyed permutation of their own format, so equal values
    have equal pseudonyms in all documents, different values different ones,
    and whoever holds the key can turn them back. Phone, card and account
    numbers are permuted as digits, whatever stands between them. E-mail names
    and quoted secrets get keyed digests. Null texts stay null with nothing
    found, texts without personal data stay as they are; columns named like
    the new ones are replaced, all others kept; rows that repeat have equal
    results; an empty table gives an empty table. No row leaves its partition.
    """
    docs = docs.drop("masked", "found")
    some = F.col("text").rlike("[0-9@]|(?i:token|secret|passw|api_?key)")
    docs = docs.withColumn("_pattern", F.when(some, pattern_of(F.col("text"))))
    matches = F.regexp_extract_all("text", F.col("_pattern"), F.lit(0))
    found = F.transform(matches, lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind")))
    marked = docs.withColumn("_found", F.when(some, found))
    with_names = F.transform(
        "_found", lambda s: F.struct(s["kind"].alias("kind"), pseudonym(s["m"], s["kind"], key).alias("pseudonym"))
    )
    named = marked.withColumn("_named", F.when(F.size("_found") > 0, with_names))
    pieces = F.split("text", F.col("_pattern"), -1)
    joined = F.array_join(
        F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get(F.col("_named"), i)["pseudonym"], F.lit("")))), ""
    )
    kept = F.filter("_named", lambda s: s["kind"].isNotNull())
    empty = F.array().cast("array<struct<kind:string,pseudonym:string>>")
    return (
        named.withColumn("masked", F.when(F.col("_named").isNull(), F.col("text")).otherwise(joined))
        .withColumn("found", F.coalesce(kept, empty))
        .drop("_pattern", "_found", "_named")
    )
