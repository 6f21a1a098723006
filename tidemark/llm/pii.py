"""Personal data replaced by format-preserving Feistel pseudonyms (DataFrame functions only).

Numbers and dates that pass their kind's validation are permuted, under a key, within that kind's
valid values: eight rounds of a two-part Feistel network over Z_a x Z_b, whose round function is
SHA-256 of key, kind and the other part. It is a bijection per kind, so equal values stay linked
across documents and different ones stay apart, layouts (blanks, hyphens, case) are kept, and check
digits are made anew. Names in mail addresses, IBANs' account parts and credentials are permuted
letter by letter within their character classes by the same network over two halves of the string.

Kinds and their validation (fixed values):
  email       local@domain.tld; local part and domain labels are permuted as lower-case names, the tld and capitals stay
  phone       (ddd) ddd-dddd or ddd-ddd-dddd, with or without +1; country code stays
  card        13 to 19 digits in whole groups, first digit 2 to 6, Luhn; first digit stays
  ssn         ddd-dd-dddd, area 001 to 899 but 666, group 01 to 99, serial 0001 to 9999
  ipv4        four octets up to 255
  iban        country, two check digits, the country's length, mod 97 = 1
  date        yyyy-mm-dd, yyyy/mm/dd or dd.mm.yyyy of a real day, 1900 to 2099
  credential  AKIA key ids; whole values of password, passwd, secret, token, api_key, api-key and apikey, in any case
Left out, as nothing validates them: bare ten-digit phone numbers, IPv6 addresses, names, streets.

A run of digit groups is taken whole, however long; dates, social security and phone numbers are taken
out of it, and in the rest cards are looked for from group to group, the longest valid one first. So
neither an expiry date nor a check number behind a card hides it, nor a number in front of it. A match of an IBAN's
shape that fails its validation is searched for cards too.

Defined cases: null text stays null with 0 replacements; empty texts, texts without personal data and
very long ones without any come back unchanged; what fails its validation is left alone; repeated rows
get equal results; an empty table gives no rows; extra columns stay as they are, whatever their names,
but one named like the count is replaced by it. A value of few symbols may map to itself (a permutation
may have fixed points); it then counts as not replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ROUNDS = 8
#: where a session names the secret of the registered queries, and what they take where it doesn't (public, so for tests only)
KEY_CONF, TEST_KEY = "spark.tidemark.pii.key", "tidemark-test-key"

EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])"
IPV4 = r"(?<![\p{L}\p{N}.])(?:\d{1,3}\.){3}\d{1,3}(?![\p{L}\p{N}]|\.\d)"
DATE = r"(?<![\p{L}\p{N}.-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}\.\d{2}\.\d{4})(?![\p{L}\p{N}-]|\.\d)"
SSN = r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])"
PHONE = r"(?<![\p{L}\p{N}+(])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?![\p{L}\p{N}])"
_RUN = r"(?<![\p{L}\p{N}+])(?:\d[ -]*+){12}\d[\d -]*(?<=\d)"
RUN = _RUN + r"(?![\p{L}\p{N}@_%+/]|[.-][\p{L}\p{N}])"
#: a run in front of a slash or the like, where no shorter one will do
LOOSE = _RUN + r"(?![\p{L}\p{N}])"
#: lengths of the countries' IBANs (fixed values)
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
IBAN = r"(?<![\p{L}\p{N}])(?:" + "|".join(f"(?:{names.replace(' ', '|')})" + r"\d{2}(?: ?[A-Z0-9]){" + str(n - 4) + "}" for n, names in IBAN_LENGTHS.items()) + r")(?![\p{L}\p{N}])"
WORD = r"(?i:password|passwd|secret|token|api_key|api-key|apikey) ?[=:] ?\"?"
CREDENTIAL = r"(?<![\p{L}\p{N}])AKIA[0-9A-Z]{16}(?![\p{L}\p{N}])|" + WORD + r"[A-Za-z0-9_+/-]{8,}"
ANY = "|".join([EMAIL, CREDENTIAL, IPV4, DATE, SSN, PHONE, IBAN, RUN, LOOSE])
#: what a run of digit groups may have beside cards
IN_RUN = "|".join([DATE, SSN, PHONE])
#: whatever has none of these has no personal data of the kinds above
HINT = r"[0-9@]|(?i:password|passwd|secret|token|api[_-]?key)"

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
DAYS = 73049  # 1900-01-01 to 2099-12-31: 319 x 229


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _prf(key: str, kind: str, i: Column, v: Column, tweak: Column, mod: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), tweak.cast("string"), i.cast("string"), v.cast("string")).cast("binary"), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), mod)


def feistel(a: Column, b: Column, mod_a: Column, mod_b: Column, key: str, kind: str, tweak: Column) -> Column:
    """struct(a, b) permuted over Z_mod_a x Z_mod_b."""
    start = F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))
    mod_a, mod_b = mod_a.cast("bigint"), mod_b.cast("bigint")

    def step(s, i):
        turn = i % 2 == 0
        return F.struct(
            F.when(turn, F.pmod(s["a"] + _prf(key, kind, i, s["b"], tweak, mod_a), mod_a)).otherwise(s["a"]).alias("a"),
            F.when(turn, s["b"]).otherwise(F.pmod(s["b"] + _prf(key, kind, i, s["a"], tweak, mod_b), mod_b)).alias("b"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _shift(c: Column, by: Column) -> Column:
    """A character moved on by so many places within its class; others stay."""
    out = c
    for letters in (LOWER, UPPER, DIGITS):
        at = F.instr(F.lit(letters), c)
        out = F.when(at > 0, F.substr(F.lit(letters), F.pmod(at - 1 + by, F.lit(len(letters))) + 1, F.lit(1))).otherwise(out)
    return out


def permute_letters(text: Column, key: str, kind: str) -> Column:
    """The string permuted among strings of the same length and character classes."""

    def run(t):
        half = F.floor(F.length(t) / 2).cast("int")
        start = F.struct(F.substr(t, F.lit(1), half).alias("a"), F.substr(t, half + 1).alias("b"))

        def moved(part, other, i):
            digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), F.length(part).cast("string"), other).cast("binary"), 256)
            chars = F.when(F.length(part) > 0, F.split(part, "")).otherwise(F.array().cast("array<string>"))
            return _let(digest, lambda d: F.array_join(F.transform(chars, lambda c, j: _shift(c, F.conv(F.substr(d, F.pmod(j * 4, F.lit(61)) + 1, F.lit(4)), 16, 10).cast("int"))), ""))

        def step(s, i):
            turn = i % 2 == 0
            return F.struct(F.when(turn, moved(s["a"], s["b"], i)).otherwise(s["a"]).alias("a"), F.when(turn, s["b"]).otherwise(moved(s["b"], s["a"], i)).alias("b"))

        return _let(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step), lambda s: F.concat(s["a"], s["b"]))

    return _let(text, run)


def _laid_out(layout: Column, digits: Column) -> Column:
    """The digits put in the places that the layout's digits have."""
    start = F.struct(F.lit("").alias("o"), F.lit(1).alias("k"))

    def step(s, c):
        number = F.instr(F.lit(DIGITS), c) > 0
        return F.struct(F.concat(s["o"], F.when(number, F.substr(digits, s["k"], F.lit(1))).otherwise(c)).alias("o"), (s["k"] + number.cast("int")).alias("k"))

    return F.aggregate(F.split(layout, ""), start, step, lambda s: s["o"])


def _pad(n: Column, width: Column | int) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), (n + 1).cast("int"), "0").cast("bigint")


def _luhn(digits: Column) -> Column:
    """The sum over digits, every second one from the last doubled."""
    d = F.split(F.reverse(digits), "")

    def value(c, j):
        x = c.cast("int") * F.when(j % 2 == 1, 2).otherwise(1)
        return x - F.when(x > 9, 9).otherwise(0)

    return F.aggregate(F.transform(d, value), F.lit(0), lambda s, x: s + x)


def _card_digits(d: Column, key: str) -> Column:
    """The pseudonym of a card's digits."""
    n = F.length(d) - 2  # between the first digit, which names the issuer, and the check digit
    u = F.floor(n / 2).cast("int")
    v = (n - u).cast("int")
    got = feistel(F.substr(d, F.lit(2), u).cast("bigint"), F.substr(d, u + 2, v).cast("bigint"), _power(u), _power(v), key, "card", F.length(d))
    body = _let(got, lambda s: F.concat(F.substring(d, 1, 1), _pad(s["a"], u), _pad(s["b"], v)))
    return _let(body, lambda x: F.concat(x, F.pmod(10 - F.pmod(_luhn(F.concat(x, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")))


def _is_card(d: Column) -> Column:
    return F.length(d).between(13, 19) & F.substring(d, 1, 1).between("2", "6") & (_luhn(d) % 10 == 0)


def _same(t: Column) -> Column:
    return F.struct(t.alias("old"), t.alias("new"))


def _cards(t: Column, key: str) -> Column:
    """Pieces of digit groups with the pseudonyms of the cards among them: array of struct(old, new)."""

    def pieces(g):
        # the longest card that starts with a group: how many groups, 0 without one. A group is its digits and what precedes them
        def groups(i):
            def longer(s, k):
                open_ = s["open"] & ((k == 0) | F.coalesce(F.get(g, i + k).rlike("^[ -][0-9]+$"), F.lit(False)))
                d = F.when(open_, F.concat(s["d"], F.regexp_replace(F.get(g, i + k), "[^0-9]", ""))).otherwise(s["d"])
                return F.struct(d.alias("d"), (open_ & (F.length(s["d"]) < 19)).alias("open"), F.when(s["open"] & _is_card(s["d"]), k).otherwise(s["n"]).alias("n"))

            start = F.struct(F.lit("").alias("d"), F.lit(True).alias("open"), F.lit(0).alias("n"))
            last = F.least(F.size(g) - i, F.lit(19))  # one step more, as each step judges what the one before has put together
            return F.aggregate(F.sequence(F.lit(0), last), start, longer, lambda s: s["n"])

        sizes = F.transform(g, lambda x, i: F.when(x.rlike("^[ -]*[2-6][0-9]*$"), groups(i)).otherwise(0))

        def walk(done, n):  # each group's place: 0 outside of cards, the number of groups where one begins, -1 inside
            here = F.when(done["left"] > 0, -1).otherwise(n)
            return _let(here, lambda h: F.struct(F.concat(done["at"], F.array(h)).alias("at"), F.when(h > 0, h - 1).otherwise(F.greatest(done["left"] - 1, F.lit(0))).alias("left")))

        def made(at):
            def piece(x, i):
                def card(whole):
                    lead = F.regexp_extract(whole, "^[ -]*", 0)
                    return F.struct(whole.alias("old"), F.concat(lead, _laid_out(F.substr(whole, F.length(lead) + 1), _card_digits(F.regexp_replace(whole, "[^0-9]", ""), key))).alias("new"))

                n = F.get(at, i)
                return F.when(n > 0, _let(F.array_join(F.slice(g, i + 1, n), ""), card)).when(n == 0, _same(x))

            return F.filter(F.transform(g, piece), lambda p: p.isNotNull())

        none = F.array().cast("array<int>")
        found = F.exists(sizes, lambda n: n > 0)
        return F.when(found, _let(F.aggregate(sizes, F.struct(none.alias("at"), F.lit(0).alias("left")), walk, lambda s: s["at"]), made)).otherwise(F.array(_same(t)))

    return _let(F.split(t, "(?<=[0-9])(?=[ -])"), pieces)


def _run(m: Column, key: str) -> Column:
    """Pieces of a match: dates, social security and phone numbers first, cards in what is left."""
    found, between = F.regexp_extract_all(m, F.lit(IN_RUN), F.lit(0)), F.split(m, IN_RUN, -1)
    none = F.array().cast("array<struct<old: string, new: string>>")
    # one more text lies between than is found
    return F.flatten(F.zip_with(between, found, lambda t, x: F.concat(_cards(t, key), F.when(x.isNotNull(), F.array(F.struct(x.alias("old"), _small(x, key).alias("new")))).otherwise(none))))


def _phone(m: Column, key: str) -> Column:
    def run(d):
        n = F.substring(d, -10, 10)
        area, exchange, line = (F.substring(n, i, k).cast("bigint") for i, k in ((1, 3), (4, 3), (7, 4)))
        valid = (area >= 200) & (exchange >= 200)
        real = feistel((area - 200) * 800 + exchange - 200, line, F.lit(640000), F.lit(10000), key, "phone", F.lit("nanp"))
        real = _let(real, lambda s: F.concat((F.floor(s["a"] / 800).cast("bigint") + 200).cast("string"), (s["a"] % 800 + 200).cast("string"), _pad(s["b"], 4)))
        # numbers outside the numbering plan stay outside of it: the area's first digit keeps to 0 or 1, or the exchange's does
        low = area < 200
        other = feistel(
            F.when(low, area * 1000 + exchange).otherwise((area - 200) * 200 + exchange), line, F.when(low, 200000).otherwise(160000), F.lit(10000), key, "phone", F.when(low, F.lit("low area")).otherwise(F.lit("low exchange"))
        )
        other = _let(other, lambda s: F.concat(F.when(low, _pad(s["a"], 6)).otherwise(F.concat((F.floor(s["a"] / 200).cast("bigint") + 200).cast("string"), _pad(s["a"] % 200, 3))), _pad(s["b"], 4)))
        new = F.concat(F.substr(d, F.lit(1), F.length(d) - 10), F.when(valid, real).otherwise(other))
        return _laid_out(m, new)

    return _let(F.regexp_replace(m, "[^0-9]", ""), run)


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substring(m, i, k).cast("bigint") for i, k in ((1, 3), (5, 2), (8, 4)))
    index = area - 1 - (area > 666).cast("int")
    got = feistel(index * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), key, "ssn", F.lit(""))

    def new(s):
        i = F.floor(s["a"] / 99).cast("bigint")
        return F.concat_ws("-", _pad(i + 1 + (i >= 665).cast("int"), 3), _pad(s["a"] % 99 + 1, 2), _pad(s["b"] + 1, 4))

    return F.when(area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), _let(got, new)).otherwise(m)


def _ipv4(m: Column, key: str) -> Column:
    o = [F.split(m, r"\.")[i].cast("bigint") for i in range(4)]
    got = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), key, "ipv4", F.lit(""))
    new = _let(got, lambda s: F.concat_ws(".", *[x.cast("string") for p in ("a", "b") for x in (F.floor(s[p] / 256), s[p] % 256)]))
    return F.when(F.greatest(*o) <= 255, new).otherwise(m)


def _date(m: Column, key: str) -> Column:
    last = F.substring(m, 3, 1) == "."
    iso = F.when(last, F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 4, 2), F.substring(m, 1, 2))).otherwise(F.translate(m, "/", "-"))

    def run(day):
        n = F.datediff(day, F.lit("1900-01-01").cast("date"))
        got = feistel(F.floor(n / 229), n % 229, F.lit(319), F.lit(229), key, "date", F.lit(""))
        new = _let(got, lambda s: F.date_add(F.lit("1900-01-01").cast("date"), (s["a"] * 229 + s["b"]).cast("int")))
        text = _let(new, lambda d: F.when(last, F.date_format(d, "dd.MM.yyyy")).when(F.substring(m, 5, 1) == "/", F.date_format(d, "yyyy/MM/dd")).otherwise(F.date_format(d, "yyyy-MM-dd")))
        return F.when(n.between(0, DAYS - 1), text).otherwise(m)

    return F.coalesce(_let(F.try_to_date(iso, "yyyy-MM-dd"), run), m)


def _mod97(text: Column) -> Column:
    """The number that an IBAN's rearranged characters spell, modulo 97."""

    def step(s, c):
        letter = F.instr(F.lit(UPPER), c)
        return F.when(letter > 0, s * 100 + letter + 9).otherwise(s * 10 + F.instr(F.lit(DIGITS), c) - 1) % 97

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _is_iban(m: Column) -> Column:
    return _whole(m, IBAN) & _let(F.translate(m, " ", ""), lambda t: _mod97(F.concat(F.substr(t, F.lit(5)), F.substring(t, 1, 4))) == 1)


def _iban(m: Column, key: str) -> Column:
    def run(t):
        country = F.substring(t, 1, 2)
        new = _let(permute_letters(F.substr(t, F.lit(5)), key, "iban"), lambda b: F.concat(country, _pad(98 - _mod97(F.concat(b, country, F.lit("00"))), 2), b))
        # blanks go back to where they were
        start = F.struct(F.lit("").alias("o"), F.lit(1).alias("k"))
        return _let(new, lambda x: F.aggregate(F.split(m, ""), start, lambda s, c: F.when(c == " ", F.struct(F.concat(s["o"], c).alias("o"), s["k"].alias("k"))).otherwise(F.struct(F.concat(s["o"], F.substr(x, s["k"], F.lit(1))).alias("o"), (s["k"] + 1).alias("k"))), lambda s: s["o"]))

    return _let(F.translate(m, " ", ""), run)


def _cased(new: Column, old: Column) -> Column:
    """new with capitals where old has them."""
    return F.array_join(F.zip_with(F.split(new, ""), F.split(old, ""), lambda n, o: F.when(o.rlike("[A-Z]"), F.upper(n)).otherwise(n)), "")


def _name(text: Column, key: str, kind: str) -> Column:
    """A name's pseudonym, the same however it is written."""
    return _cased(permute_letters(F.translate(text, UPPER, LOWER), key, kind), text)


def _email(m: Column, key: str) -> Column:
    domain = F.substring_index(m, "@", -1)
    tld = F.substring_index(domain, ".", -1)
    names = F.substr(domain, F.lit(1), F.length(domain) - F.length(tld) - 1)
    return F.concat(_name(F.substring_index(m, "@", 1), key, "email"), F.lit("@"), _name(names, key, "domain"), F.lit("."), tld)


def _whole(m: Column, p: str) -> Column:
    return m.rlike("^(?:" + p + ")$")


def _small(m: Column, key: str) -> Column:
    """The pseudonym of a date, social security number or phone number."""
    return F.when(_whole(m, DATE), _date(m, key)).when(_whole(m, SSN), _ssn(m, key)).otherwise(_phone(m, key))


def pseudonyms(m: Column, key: str) -> Column:
    """One match as array of struct(old, new); what fails its validation stays."""
    one = F.when(m.contains("@"), _email(m, key)).when(_whole(m, IPV4), _ipv4(m, key)).when(_is_iban(m), _iban(m, key))

    def keyed(lead):
        value = F.substr(m, F.length(lead) + 1)
        return F.array(_same(lead), F.struct(value.alias("old"), permute_letters(value, key, "credential").alias("new")))

    def other(lead):
        return F.when(F.length(lead) > 0, keyed(lead)).otherwise(_let(one, lambda x: F.when(x.isNotNull(), F.array(F.struct(m.alias("old"), x.alias("new")))).otherwise(_run(m, key))))

    return _let(F.regexp_extract(m, "^(?:AKIA(?=[0-9A-Z]{16}$)|" + WORD + ")", 0), other)


def pseudonymise(docs: DataFrame, key: str, text: str = "text", count: str = "n_replaced") -> DataFrame:
    """docs with personal data in text replaced, + the number of values that changed. The key is a secret: whoever has it can undo this."""
    if not key:
        raise ValueError("pseudonyms need a key")
    kept = [c for c in docs.columns if c.lower() != count.lower()]
    # the table's own columns travel as one, so no name of theirs meets one of these
    base = docs.select(F.struct(F.lit(0).alias("__"), *[F.col(f"`{c}`") for c in kept if c != text]).alias("own"), F.col(f"`{text}`").alias("t"))
    found = base.withColumn("found", F.when(F.col("t").rlike(HINT), F.regexp_extract_all("t", F.lit(ANY), F.lit(0))))
    some = F.size("found") > 0
    done = found.withColumn("new", F.when(some, F.transform("found", lambda m: pseudonyms(m, key)))).withColumn("between", F.when(some, F.split("t", ANY, -1)))
    value = lambda m: F.array_join(F.transform(m, lambda p: p["new"]), "")
    joined = F.concat(F.col("between")[0], F.array_join(F.zip_with("new", F.slice("between", 2, F.size("new")), lambda m, s: F.concat(value(m), s)), ""))
    changed = F.size(F.filter(F.flatten("new"), lambda p: p["old"] != p["new"]))
    return done.select(*[F.when(some, joined).otherwise(F.col("t")).alias(c) if c == text else F.col(f"own.`{c}`").alias(c) for c in kept], F.when(some, changed).otherwise(0).alias(count))


def session_key(spark: SparkSession) -> str:
    return spark.conf.get(KEY_CONF, None) or TEST_KEY


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(common.read(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark))
