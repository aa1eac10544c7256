"""Format-preserving pseudonyms for personal data, in built-in functions only.

Numbers and dates found in a text are validated and put through a keyed Feistel permutation
of their own format: a card stays a card with a right check digit, a date a date, an address
an address. The permutation depends on the key and the value alone, so equal values get
equal pseudonyms in every document and different values stay different.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import fresh, let

ROUNDS = 8
KEY = "change-me"

EMAIL = (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}"
         r"\.[A-Za-z]{2,24}(?![A-Za-z0-9-])")
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
IPV4 = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\d|\.\d)"
DATE = (r"(?<![\d./-])(?:(?:19|20)\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])"
        r"|(?:0[1-9]|[12]\d|3[01])/(?:0[1-9]|1[0-2])/(?:19|20)\d\d"
        r"|(?:0[1-9]|[12]\d|3[01])\.(?:0[1-9]|1[0-2])\.(?:19|20)\d\d)(?![\d/-])")
SSN = r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\d-])"
PHONE = (r"(?<![\w+])\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)"
         r"|(?<![\w+])(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?!\d)")
CARD = r"(?<![\w+.-])\d(?:[ -]?\d){12,18}(?!\d)"
SECRET = r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])|(?<=password=)\w{6,64}|(?<![A-Za-z0-9])[0-9a-f]{40}(?![A-Za-z0-9])"
FIRST = "|".join((EMAIL, DATE, SSN, IPV4, PHONE))
ANY = "|".join((FIRST, SECRET))

# characters of an account number by country
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}

FIRST_DAY = "1900-01-01"
# the days from FIRST_DAY on that are permuted: a product, so it splits into two halves
DAYS = (270, 271)


def _random(key: str, kind: str, *parts: Column) -> Column:
    """60 keyed pseudo-random bits of ``parts``."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), *[p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def permute_pair(left: Column, right: Column, a: Column, b: Column, key: str, kind: str) -> Column:
    """Alternating Feistel on the product of 0..a-1 and 0..b-1; a struct of l and r."""
    begin = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))
    a, b = a.cast("bigint"), b.cast("bigint")

    def step(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        moved_l = (acc["l"] + _random(key, kind, i, acc["r"])) % a
        moved_r = (acc["r"] + _random(key, kind, i, acc["l"])) % b
        return F.struct(F.when(even, moved_l).otherwise(acc["l"]).alias("l"),
                        F.when(even, acc["r"]).otherwise(moved_r).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), begin, step)


def _shift(text: Column, stream: Column, letters: int) -> Column:
    """Every character moved inside its class by its own four hex digits of ``stream``."""

    def moved(j: Column) -> Column:
        code = F.ascii(F.substr(text, j, F.lit(1)))
        by = F.conv(F.substr(stream, F.pmod(j - 1, F.lit(32)) * 4 + 1, F.lit(4)), 16, 10).cast("int")

        def inside(first: int, size: int) -> Column:
            return F.char(F.lit(first) + (code - first + by) % size)

        return F.when(code < 58, inside(48, 10)).when(code < 91, inside(65, 26)).otherwise(inside(97, letters))

    return F.when(F.length(text) == 0, F.lit("")).otherwise(F.array_join(
        F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), moved), ""))


def permute_text(plain: Column, key: str, kind: str, letters: int = 26) -> Column:
    """Feistel on a string of ASCII letters and digits; each keeps its class and case.

    ``letters`` = 6 keeps lower-case hexadecimal digits hexadecimal.
    """
    half = F.floor(F.length(plain) / 2).cast("int")
    begin = F.struct(F.substr(plain, F.lit(1), half).alias("l"), F.substr(plain, half + 1, F.length(plain)).alias("r"))

    def stream(i: Column, other: Column) -> Column:
        return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), other), 512)

    def step(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(F.when(even, _shift(acc["l"], stream(i, acc["r"]), letters)).otherwise(acc["l"]).alias("l"),
                        F.when(even, acc["r"]).otherwise(_shift(acc["r"], stream(i, acc["l"]), letters)).alias("r"))

    return let(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), begin, step), lambda s: F.concat(s["l"], s["r"]))


def _plain(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9A-Za-z]", "")


def _refill(form: Column, filling: Column) -> Column:
    """``form`` with its letters and digits replaced, in order, by the characters of ``filling``."""

    def put(j: Column) -> Column:
        c = F.substr(form, j, F.lit(1))
        return F.when(c.rlike("[0-9A-Za-z]"), F.substr(filling, F.length(_plain(F.substr(form, F.lit(1), j))), F.lit(1))
                      ).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(form)), put), "")


def luhn_digit(payload: Column) -> Column:
    """Check digit of a string of digits."""
    n = F.length(payload)

    def add(acc: Column, j: Column) -> Column:
        d = F.substr(payload, n - j + 1, F.lit(1)).cast("int") * F.when(j % 2 == 1, 2).otherwise(1)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    return F.pmod(-F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add), F.lit(10))


def mod97(text: Column) -> Column:
    """Remainder of a string of digits and capitals, A = 10 and so on."""

    def add(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, acc * 10 + code - 48).otherwise(acc * 100 + code - 55) % 97

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), add)


def _account_check(plain: Column) -> Column:
    """1 for a valid account number without spaces."""
    return mod97(F.concat(F.substr(plain, F.lit(5), F.length(plain)), F.substr(plain, F.lit(1), F.lit(4))))


def _prefixes(m: Column) -> Column:
    """The beginnings of ``m`` that end before a separator, and ``m``, by length."""
    ends = F.filter(F.sequence(F.lit(1), F.length(m)), lambda i: (i == F.length(m)) | F.substr(m, i + 1, F.lit(1)).isin(" ", "-"))
    return F.transform(ends, lambda i: F.substr(m, F.lit(1), i))


def _account_in(m: Column) -> Column:
    """The account number that ``m`` begins with: the valid beginning of the length of its
    country, else the longest valid one; null if none is."""
    country = F.substr(m, F.lit(1), F.lit(2))
    length = F.lit(0)
    for n, codes in IBAN_LENGTHS.items():
        length = F.when(country.isin(*codes.split()), n).otherwise(length)
    valid = F.filter(_prefixes(m), lambda p: let(_plain(p), lambda q: (F.length(q) >= 12) & (_account_check(q) == 1)))
    return let(valid, lambda v: F.coalesce(
        F.get(F.filter(v, lambda p: F.length(_plain(p)) == length), F.lit(0)), F.get(v, F.size(v) - 1)))


def _card_in(m: Column) -> Column:
    """The card number that ``m`` begins with: a valid one without separators, else the longest
    valid beginning; null if none is."""

    def right(p: Column) -> Column:
        return let(_plain(p), lambda q: (F.length(q) >= 13) & (
            luhn_digit(F.substr(q, F.lit(1), F.length(q) - 1)) == F.substr(q, F.length(q), F.lit(1)).cast("int")))

    return let(F.filter(_prefixes(m), right), lambda v: F.when(
        F.get(v, F.lit(0)).rlike(r"^\d+$"), F.get(v, F.lit(0))).otherwise(F.get(v, F.size(v) - 1)))


def _valid_values(body: Column) -> Column:
    """Patterns of the valid account and card numbers of a text, wherever one may begin."""

    def pattern(found: str, value: Callable[[Column], Column], before: str, after: str) -> Column:
        values = F.array_distinct(F.filter(F.transform(
            F.regexp_extract_all(body, F.lit(f"(?=({found}))"), 1), value), lambda v: v.isNotNull()))
        # a longer value first, in case another one begins it
        ordered = F.transform(F.reverse(F.array_sort(F.transform(values, lambda v: F.struct(F.length(v), v.alias("v"))))), lambda s: s["v"])
        return let(ordered, lambda vs: F.when(F.size(vs) > 0, F.concat(F.lit(before + "(?:"), F.array_join(vs, "|"), F.lit(")" + after))))

    return F.filter(F.array(pattern(IBAN, _account_in, "(?<![A-Za-z0-9])", "(?![A-Za-z0-9])"),
                            pattern(CARD, _card_in, r"(?<![\w+.-])", r"(?!\d)")), lambda p: p.isNotNull())


def _pattern(values: Column) -> Column:
    """``ANY`` for a text with valid account or card numbers."""
    return F.concat(F.lit(FIRST + "|"), F.array_join(values, "|"), F.lit("|" + SECRET))


def _card(m: Column, key: str) -> Column:
    """All digits but the last are permuted; the last keeps its distance from the right check
    digit, so valid numbers stay valid; only valid ones are found."""

    def of(digits: Column) -> Column:
        n = F.length(digits) - 1
        payload, check = F.substr(digits, F.lit(1), n), F.substr(digits, n + 1, F.lit(1)).cast("int")
        k = F.floor(n / 2).cast("int")
        pair = permute_pair(F.substr(digits, F.lit(1), k).cast("bigint"), F.substr(digits, k + 1, n - k).cast("bigint"),
                            F.pow(F.lit(10.0), k), F.pow(F.lit(10.0), n - k), key, "card")
        new = let(pair, lambda s: F.concat(F.lpad(s["l"].cast("string"), k, "0"), F.lpad(s["r"].cast("string"), n - k, "0")))
        return let(new, lambda p: F.concat(p, F.pmod(
            luhn_digit(p) + check - luhn_digit(payload), F.lit(10)).cast("string")))

    return let(_plain(m), lambda digits: _refill(m, of(digits)))


def _iban(m: Column, key: str) -> Column:
    """A valid account number keeps its country and gets new check digits; others stay."""

    def of(p: Column) -> Column:
        country, rest = F.substr(p, F.lit(1), F.lit(2)), F.substr(p, F.lit(5), F.length(p))
        check = _account_check(p)
        new = let(permute_text(rest, key, "iban"), lambda b: F.concat(
            country, F.lpad((98 - mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b))
        return F.when(check == 1, _refill(m, new)).otherwise(m)

    return let(_plain(m), of)


def _ipv4(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("bigint"))
    return let(octets, lambda o: let(
        permute_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65_536), F.lit(65_536), key, "ipv4"),
        lambda s: F.concat_ws(".", *[F.floor(s[h] / 256).cast("string") if high else (s[h] % 256).cast("string")
                                     for h in ("l", "r") for high in (True, False)])))


def _ssn(m: Column, key: str) -> Column:
    """Area without 000, 666 and 900 on, group without 00, serial without 0000."""

    def of(p: Column) -> Column:
        area = F.substr(p, F.lit(1), F.lit(3)).cast("int")
        row = area - F.when(area > 666, 2).otherwise(1)
        left = row * 99 + F.substr(p, F.lit(5), F.lit(2)).cast("int") - 1
        pair = permute_pair(left, F.substr(p, F.lit(8), F.lit(4)).cast("int") - 1, F.lit(898 * 99), F.lit(9_999), key, "ssn")

        def shown(s: Column) -> Column:
            r = F.floor(s["l"] / 99)
            number = r + F.when(r >= 665, 2).otherwise(1)
            return F.concat_ws("-", F.lpad(number.cast("string"), 3, "0"), F.lpad((s["l"] % 99 + 1).cast("string"), 2, "0"),
                               F.lpad((s["r"] + 1).cast("string"), 4, "0"))

        return let(pair, shown)

    return let(m, of)


def _date(m: Column, key: str) -> Column:
    """A day of the calendar in its own notation; days that do not exist stay."""

    def of(form: str) -> Column:
        def moved(day: Column) -> Column:
            n = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
            pair = permute_pair(F.floor(n / DAYS[1]), n % DAYS[1], F.lit(DAYS[0]), F.lit(DAYS[1]), key, "date")
            return let(pair, lambda s: F.date_format(F.date_add(
                F.lit(FIRST_DAY).cast("date"), (s["l"] * DAYS[1] + s["r"]).cast("int")), form))

        return let(F.try_to_timestamp(m, F.lit(form)).cast("date"), lambda d: F.coalesce(moved(d), m))

    return F.when(m.contains("/"), of("dd/MM/yyyy")).when(m.contains("."), of("dd.MM.yyyy")).otherwise(of("yyyy-MM-dd"))


def _keeping(m: Column, head: str, rest: Callable[[Column], Column]) -> Column:
    """The part that matches ``head`` stays, ``rest`` changes what follows."""
    return let(F.regexp_extract(m, head, 0), lambda h: F.concat(h, rest(F.substr(m, F.length(h) + 1, F.length(m)))))


def _by_class(m: Column, key: str, kind: str, letters: int = 26) -> Column:
    return let(m, lambda x: _refill(x, permute_text(_plain(x), key, kind, letters)))


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one found value."""
    return (
        F.when(m.contains("@"), F.concat(  # the top-level domain stays
            _by_class(F.regexp_extract(m, r"^(.*)\.[A-Za-z]+$", 1), key, "email"), F.regexp_extract(m, r"\.[A-Za-z]+$", 0)))
        .when(m.rlike(r"^(?:\d{4}-\d\d-\d\d|\d\d/\d\d/\d{4}|\d\d\.\d\d\.\d{4})$"), _date(m, key))
        .when(m.rlike(r"^\d{3}-\d\d-\d{4}$"), _ssn(m, key))
        .when(m.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), _ipv4(m, key))
        .when(m.rlike(r"^AKIA[A-Z0-9]{16}$"), _keeping(m, "^AKIA", lambda r: _by_class(r, key, "secret")))
        .when(m.rlike(r"^[A-Z]{2}\d\d[ A-Z0-9]+$"), _iban(m, key))
        .when(m.startswith("+"), _keeping(m, r"^\+\d{1,3}(?=[ .(-])|^\+\d", lambda r: _by_class(r, key, "phone")))
        .when(m.rlike(r"^\d(?:[ -]?\d){12,18}$"), _card(m, key))
        .when(m.rlike(r"^[(\d][\d() .-]+$"), _by_class(m, key, "phone"))
        .when(m.rlike(r"^[0-9a-f]+$"), _by_class(m, key, "secret", 6))
        .otherwise(_by_class(m, key, "secret")))


def pseudonymize(docs: DataFrame, key: str = KEY, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with personal data replaced in ``text``, plus a count; returns the frame and its name.

    E-mail addresses, telephone, card, account and social security numbers, IPv4 addresses,
    dates, access keys, passwords and digests are replaced and counted. Account and card numbers
    with wrong check digits and days that do not exist stay and do not count. Texts keep their
    length, but for IPv4 addresses. A valid account or card number ends where its check digits and length say,
    whatever word follows. Null and empty texts stay as they are with count 0. Other columns pass
    through, whatever their names; repeated rows change alike.
    """
    body, done, count = F.col(text), *fresh(docs, "done", "count")
    nothing = F.struct(body.alias("text"), F.lit(0).alias("n"))

    def replaced(found: Column, regex: Column) -> Column:
        def joined(new: Column) -> Column:
            return let(F.split(body, regex, -1), lambda parts: F.struct(
                F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(
                    new, lambda p, i: F.concat(p, F.get(parts, i + 1))), "")).alias("text"),
                F.size(F.filter(new, lambda p, i: p != F.get(found, i))).alias("n")))

        return F.when(F.size(found) == 0, nothing).otherwise(
            let(F.transform(found, lambda m: pseudonym(m, key)), joined))

    def search(values: Column) -> Column:
        regex = F.when(F.size(values) == 0, F.lit(ANY)).otherwise(_pattern(values))
        return let(regex, lambda r: let(F.regexp_extract_all(body, r, F.lit(0)), lambda found: replaced(found, r)))

    out = docs.withColumn(done, F.when(body.rlike(r"\d|@|password="), let(_valid_values(body), search)).otherwise(nothing))
    return out.select(*[F.col(f"{done}.text").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns],
                      F.col(f"{done}.n").cast("long").alias(count)), count


def report(docs: DataFrame, key: str = KEY) -> DataFrame:
    """(doc_id, n_values, text) of every row."""
    out, count = pseudonymize(docs.select("doc_id", "text"), key)
    return out.select("doc_id", F.col(count).alias("n_values"), "text")
