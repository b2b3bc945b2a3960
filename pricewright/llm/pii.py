"""Format-preserving pseudonyms for personal numbers, dates and addresses.

Each validated match is replaced by the image of a keyed Feistel permutation of its own format, so
equal values get equal pseudonyms in every document, and different values of one format stay
different. Everything is built from SQL functions; no row leaves the JVM and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewright.llm.common import free_names

ROUNDS = 10

#: Kinds in the order in which they are tried at a place of the text.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62})(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "iso_date": r"(?<![\d-])(?:19|20)\d\d-\d\d-\d\d(?![\d-])",
    "dot_date": r"(?<![\d.])\d\d\.\d\d\.(?:19|20)\d\d(?![\d]|\.\d)",
    "slash_date": r"(?<![\d/])\d\d/\d\d/(?:19|20)\d\d(?![\d/])",
    "ip": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{2,4}\)[ .-]?)?\d{2,5}(?:[ .-]?\d{2,5}){1,4}(?!\d)",
    "local_phone": r"(?<![\d-])(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?![\d-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: The kinds without check digits; of IBANs and cards a text's valid ones are put in by name (see ``_pattern``).
UNCHECKED = "|".join(f"(?:{p})" for kind, p in PATTERNS.items() if kind not in ("iban", "card"))

#: A card isn't followed by a digit, nor by a hyphen, unless that leads to a last group of up to 6 digits.
CARD_END = r"(?!\d|-(?!\d{1,6}(?![\d-])))"
#: What can be a card from each start on, and behind it as much as ``CARD_END`` looks at.
CARD_RUN = r"(?<![\d-])(?=([2-6](?:[ -]?\d){12,26}-?))"
#: Shorter candidates are written in groups of four digits or more, but for the last.
CARD_GROUPS = r"^\d{4,}(?:[ -]\d{4,})*(?:[ -]\d+)?$"

#: Lengths of the countries' IBANs, as registered.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG YE", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR HN IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}
IBAN_RUN = "(?<![A-Za-z0-9])(?=({})(?![A-Za-z0-9]))".format(
    "|".join(
        f"(?:{codes.replace(' ', '|')})" + r"\d\d" + f"(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")
        for n, codes in IBAN_LENGTHS.items()
    )
)

#: Dates are permuted among the 65536 days from here on, to 2079-06-05.
FIRST_DAY = "1900-01-01"
DAYS = 1 << 16


def feistel(symbols: Column, radices: Column, key: str, tweak: Column) -> Column:
    """A keyed permutation of ``symbols``, where symbol i runs from 0 to radix i - 1.

    The left half takes a keyed hash of the right half, symbol by symbol modulo its radix, and the
    halves change sides; with an even number of rounds every symbol is back in its place. Equal
    radices and tweak give a bijection; ``tweak`` keeps formats apart.
    """
    n = F.size(symbols)
    left = F.floor(n / 2).cast("int")
    cut_at = lambda a: (F.slice(a, F.lit(1), left), F.slice(a, left + 1, n - left))
    (a, b), (ra, rb) = cut_at(symbols), cut_at(radices)
    start = F.struct(a.alias("a"), b.alias("b"), ra.alias("ra"), rb.alias("rb"))

    def one_round(s: Column, r: Column) -> Column:
        said = F.concat_ws("|", F.lit(key), tweak, r.cast("string"), F.array_join(F.transform(s["b"], lambda x: x.cast("string")), ","))

        def shift(x: Column, i: Column) -> Column:
            noise = F.conv(F.substring(F.sha2(F.concat_ws("|", said, i.cast("string")).cast("binary"), 256), 1, 12), 16, 10).cast("long")
            return ((x + noise) % F.get(s["ra"], i)).cast("int")

        return F.struct(s["b"].alias("a"), F.transform(s["a"], shift).alias("b"), s["rb"].alias("ra"), s["ra"].alias("rb"))

    done = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, one_round)
    return F.concat(done["a"], done["b"])


def _digits(s: Column) -> Column:
    return F.transform(F.regexp_extract_all(s, F.lit(r"\d"), F.lit(0)), lambda c: c.cast("int"))


def _refill(s: Column, symbols: str, values: Column) -> Column:
    """``s`` with its characters of the class ``symbols`` replaced by ``values``, one by one."""
    gaps = F.split(s, symbols, -1)
    return F.array_join(F.zip_with(gaps, values, lambda gap, v: F.concat(gap, F.coalesce(v, F.lit("")))), "")


def permuted_digits(s: Column, key: str, tweak: str) -> Column:
    """All digits of ``s`` permuted; everything else stays where it is."""
    digits = _digits(s)
    image = feistel(digits, F.transform(digits, lambda _: F.lit(10)), key, F.concat(F.lit(tweak), F.size(digits).cast("string")))
    return _refill(s, r"\d", F.transform(image, lambda d: d.cast("string")))


def luhn(digits: Column) -> Column:
    """The sum that is a multiple of ten for a valid number, doubling every second digit from the right."""
    doubled = F.transform(F.reverse(digits), lambda d, i: F.when(i % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d)


def _card(s: Column, key: str) -> Column:
    """The first digit, which names the issuer's kind, stays; the check digit follows from the others."""
    digits = _digits(s)
    body = F.slice(digits, F.lit(2), F.size(digits) - 2)
    image = feistel(body, F.transform(body, lambda _: F.lit(10)), key, F.concat(F.lit("card"), F.size(body).cast("string")))

    def checked(body: Column) -> Column:
        check = (10 - luhn(F.concat(body, F.array(F.lit(0)))) % 10) % 10
        return _refill(s, r"\d", F.transform(F.concat(body, F.array(check)), lambda d: d.cast("string")))

    # A one-element transform binds the digits to a variable, so that they are permuted once.
    return F.transform(F.array(F.concat(F.slice(digits, F.lit(1), F.lit(1)), image)), checked)[0]


def _octets(s: Column) -> Column:
    return F.transform(F.split(s, r"\."), lambda o: o.cast("int"))


def _ip(s: Column, key: str) -> Column:
    return F.array_join(F.transform(feistel(_octets(s), F.array(*[F.lit(256)] * 4), key, F.lit("ip")), lambda o: o.cast("string")), ".")


def _day_number(s: Column, form: str) -> Column:
    return F.datediff(F.try_to_timestamp(s, F.lit(form)).cast("date"), F.lit(FIRST_DAY).cast("date"))


def _day_image(day: Column, key: str) -> Column:
    image = feistel(F.array(F.floor(day / 256).cast("int"), (day % 256).cast("int")), F.array(F.lit(256), F.lit(256)), key, F.lit("date"))
    return image[0] * 256 + image[1]


def _date(s: Column, form: str, key: str) -> Column:
    return F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), _day_image(_day_number(s, form), key)), form)


def _day_first(s: Column, key: str) -> Column:
    """A date that is impossible as mm/dd, permuted among its like (days from the 13th on).

    The permutation is repeated until it comes to such a day; so no mm/dd date has the same pseudonym.
    In 64 steps none comes with a probability of 1e-25; the match is then null, as if invalid.
    """
    at = lambda day: F.date_add(F.lit(FIRST_DAY).cast("date"), day)
    late = lambda day: F.dayofmonth(at(day)) > 12
    walk = lambda day, i: F.when((i > 0) & late(day), day).otherwise(_day_image(day, key))
    day = F.aggregate(F.sequence(F.lit(0), F.lit(63)), _day_number(s, "dd/MM/yyyy"), walk)
    return F.transform(F.array(day), lambda d: F.when(late(d), F.date_format(at(d), "dd/MM/yyyy")))[0]


def _letters_and_digits(s: Column, key: str, tweak: str) -> Column:
    """Digits become digits, letters letters of the same case; other characters stay."""
    chars = F.regexp_extract_all(s, F.lit("[A-Za-z0-9]"), F.lit(0))
    base = lambda c: F.when(c.rlike("[0-9]"), 48).when(c.rlike("[a-z]"), 97).otherwise(65)
    radix = F.transform(chars, lambda c: F.when(c.rlike("[0-9]"), 10).otherwise(26))
    image = feistel(F.transform(chars, lambda c: F.ascii(c) - base(c)), radix, key, F.concat(F.lit(tweak), F.array_join(F.transform(chars, lambda c: base(c).cast("string")), "")))
    return _refill(s, "[A-Za-z0-9]", F.zip_with(image, chars, lambda v, c: F.char(v + base(c))))


def _email(s: Column, key: str) -> Column:
    local = F.substring_index(s, "@", 1)
    return F.concat(_letters_and_digits(local, key, "email"), F.substring(s, F.length(local) + 1, F.length(s)))


def _iban_rest(s: Column) -> Column:
    """A country code and the account part as numbers modulo 97, with check digits 00."""
    bare = F.replace(s, F.lit(" "))
    turned = F.concat(F.substring(bare, 5, 40), F.substring(bare, 1, 2), F.lit("00"))
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    chars = F.regexp_extract_all(turned, F.lit("[A-Z0-9]"), F.lit(0))
    return F.aggregate(chars, F.lit(0), lambda a, c: (F.when(c.rlike("[0-9]"), a * 10).otherwise(a * 100) + value(c)) % 97)


def _iban(s: Column, key: str) -> Column:
    country, rest = F.substring(s, 1, 2), F.substring(s, 5, 50)
    image = F.concat(country, F.lit("00"), _letters_and_digits(rest, key, "iban"))
    return F.concat(country, F.lpad((98 - _iban_rest(image)).cast("string"), 2, "0"), F.substring(image, 5, 50))


def _iban_ok(s: Column) -> Column:
    return 98 - _iban_rest(s) == F.substring(s, 3, 2).cast("int")


def _card_ok(s: Column) -> Column:
    return (luhn(_digits(s)) % 10 == 0) & s.rlike("^[2-6]")


def _pattern(text: Column) -> Column:
    """The text's own pattern of what is replaced: ``UNCHECKED``, then its valid IBANs and cards by name.

    An IBAN has its country's length, a card is the longest valid one at its start; beside those stand the
    valid ones among the longest matches of the plain patterns. What is invalid matches nothing, so it hides nothing.
    """
    whole = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    of = lambda kind, ok: F.filter(whole, lambda m: m.rlike(f"^(?:{PATTERNS[kind]})$") & ok(m))
    ibans = F.array_distinct(F.concat(F.filter(F.regexp_extract_all(text, F.lit(IBAN_RUN), F.lit(1)), _iban_ok), of("iban", _iban_ok)))
    prefix = lambda run, n: F.regexp_extract(run, rf"^(\d(?:[ -]?\d){{{n - 1}}}){CARD_END}", 1)
    shorter = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(CARD_RUN), F.lit(1)), lambda run: F.array(*(prefix(run, n) for n in range(13, 20)))))
    cards = F.array_distinct(F.concat(F.filter(shorter, lambda m: m.rlike(CARD_GROUPS) & _card_ok(m)), of("card", _card_ok)))
    longest_first = F.transform(F.sort_array(F.transform(cards, lambda m: F.struct(F.length(m).alias("n"), m.alias("m"))), asc=False), lambda x: x["m"])
    named = lambda found, before, after: F.when(F.size(found) > 0, F.concat(F.lit(f"|{before}(?:"), F.array_join(found, "|"), F.lit(f"){after}"))).otherwise("")
    return F.concat(F.lit(UNCHECKED), named(ibans, "(?<![A-Za-z0-9])", "(?![A-Za-z0-9])"), named(longest_first, r"(?<![\d-])", CARD_END))


def pseudonym(s: Column, key: str) -> Column:
    """The pseudonym of one match, or null if it isn't valid in any format."""
    is_kind = lambda kind: s.rlike(f"^(?:{PATTERNS[kind]})$")
    date_ok = lambda form: _day_number(s, form).isNotNull() & (_day_number(s, form) >= 0) & (_day_number(s, form) < DAYS)
    n_digits = F.size(_digits(s))
    return (
        F.when(is_kind("email"), _email(s, key))
        .when(is_kind("iso_date"), F.when(date_ok("yyyy-MM-dd"), _date(s, "yyyy-MM-dd", key)))
        .when(is_kind("dot_date"), F.when(date_ok("dd.MM.yyyy"), _date(s, "dd.MM.yyyy", key)))
        .when(is_kind("slash_date"), F.when(date_ok("MM/dd/yyyy"), _date(s, "MM/dd/yyyy", key)).when(s.rlike("^(?:1[3-9]|[23])") & date_ok("dd/MM/yyyy"), _day_first(s, key)))
        .when(is_kind("ip"), F.when(F.forall(_octets(s), lambda o: o < 256), _ip(s, key)))
        .when(is_kind("ssn"), F.when(~s.rlike(r"^(?:000|666|9)|^\d{3}-00|0000$"), permuted_digits(s, key, "ssn")))
        .when(is_kind("phone"), F.when(n_digits.between(7, 15), F.concat(F.regexp_extract(s, r"^\+\d{1,3}(?=\D|\d{7})", 0), permuted_digits(F.regexp_replace(s, r"^\+\d{1,3}(?=\D|\d{7})", ""), key, "phone"))))
        .when(is_kind("local_phone"), permuted_digits(s, key, "local"))
        .when(is_kind("iban"), F.when(_iban_ok(s), _iban(s, key)))
        .when(is_kind("card"), F.when(_card_ok(s), _card(s, key)))
    )


def pseudonymise(docs: DataFrame, key: str, column: str = "text", count: str | None = "n_replaced") -> DataFrame:
    """``docs`` with the personal data in ``column`` replaced, and ``count``, how many were.

    Valid are: mail addresses; dates from 1900-01-01 to 2079-06-05 as yyyy-mm-dd, dd.mm.yyyy,
    mm/dd/yyyy or, where that is impossible, dd/mm/yyyy; IPv4 addresses; US social security and telephone numbers, international telephone
    numbers of 7 to 15 digits; IBANs, and card numbers that start with 2 to 6, with right check digits, which the
    pseudonyms have too, whatever numbers or words stand around them. What merely looks alike stays. Text around a match is never touched; a null or empty
    text stays as it is with 0 replaced; rows are kept one by one, repeated ones too. A column of the name
    ``count`` in ``docs`` is replaced; with None no count is added, and every other column stays as it is.
    ``key`` is the secret: without it pseudonyms can't be undone.
    """
    name = free_names(docs, "pattern", "found", "new")
    text = F.col(column)
    with_pattern = docs.withColumn(name["pattern"], F.when(text.rlike("[0-9@]"), F.when(text.rlike(f"{PATTERNS['iban']}|{PATTERNS['card']}|{CARD_RUN}"), _pattern(text)).otherwise(UNCHECKED)))
    with_found = with_pattern.withColumn(name["found"], F.regexp_extract_all(text, F.col(name["pattern"]), F.lit(0)))
    new = F.col(name["new"])
    with_new = with_found.withColumn(name["new"], F.when(F.size(name["found"]) > 0, F.transform(name["found"], lambda m: F.struct(m.alias("old"), pseudonym(m, key).alias("new")))))
    gaps = F.split(text, F.col(name["pattern"]), -1)
    put = F.array_join(F.zip_with(gaps, new, lambda gap, m: F.concat(gap, F.coalesce(m["new"], m["old"], F.lit("")))), "")
    replaced = F.when(new.isNull(), 0).otherwise(F.coalesce(F.size(F.filter(new, lambda m: m["new"].isNotNull())), F.lit(0)))
    if count is not None:
        with_new = with_new.withColumn(count, replaced)
    return with_new.withColumn(column, F.when(replaced > 0, put).otherwise(text)).drop(*name.values())
