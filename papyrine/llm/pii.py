"""Personal data under format-preserving Feistel pseudonyms, with DataFrame functions only.

Numbers and dates that pass their kind's validation are permuted with a key
inside their format: card numbers keep length and Luhn digit, telephone numbers
their punctuation and country code, social security numbers their valid ranges,
account numbers (IBAN) their country, length and check digits, IPv4 addresses
their octets, dates their calendar and layout. As the
permutation depends on kind and key alone, equal values have equal pseudonyms in
all documents, and different ones different. E-mail names and secret tokens
have no numeric format; they get keyed digests of their form. All keyed digests
are HMAC with SHA-256.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from papyrine.llm.text import bind

ROUNDS = 8
#: The session's setting that has the key.
KEY_SETTING = "spark.papyrine.pii.key"

#: Days that dates are permuted among: from 1900-03-01, 250 * 292 of them.
FIRST_DAY, DAYS = "1900-03-01", (250, 292)
#: Days after the 12th of each month of a common year, and their sums before each month: month-first dates that cannot be read day-first.
LATE_DAYS = (19, 16, 19, 18, 19, 18, 19, 19, 18, 19, 18, 19)
LATE_BEFORE = tuple(sum(LATE_DAYS[:i]) for i in range(12))
#: Years of month-first dates, and those of them that have a 29 February: 1904 and every fourth one up to 2096.
LATE_YEARS, LEAP_YEARS = (1900, 2099), (1904, 49)

#: What may be personal data, each with the name of its kind; the first alternative that matches wins.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}"
SECRET = r"(?<![0-9A-Za-z_-])(?:sk-[A-Za-z0-9_-]{20,200}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,200})(?![0-9A-Za-z])"
TOKEN = r"(?<![0-9A-Za-z])(?=[0-9a-fA-F]{0,31}[0-9])[0-9a-fA-F]{32,64}(?![0-9A-Za-z])"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[0-9A-Z]{11,30}|(?: [0-9A-Z]{4}){2,7}(?: [0-9A-Z]{1,3})?)(?![0-9A-Za-z])"
PHONE = r"(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])"
NATIONAL = r"(?<![0-9A-Za-z.(-])(?:\([2-9][0-9]{2}\) ?[2-9][0-9]{2}[-. ]|[2-9][0-9]{2}-[2-9][0-9]{2}-|[2-9][0-9]{2}\.[2-9][0-9]{2}\.)[0-9]{4}(?![0-9A-Za-z]|[.-][0-9])"
DATE = r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9/-])"
IPV4 = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
SSN = r"(?<![0-9-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|(?<![0-9] )[0-9]{3} [0-9]{2} [0-9]{4}(?! [0-9]))(?![0-9-])"
CARD = r"(?<![0-9A-Za-z-])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9A-Za-z])"
KINDS = ("card", "phone", "ipv4", "ssn", "date", "iban", "email", "token")
ANY = "|".join(f"(?:{p})" for p in (EMAIL, SECRET, TOKEN, IBAN, PHONE, NATIONAL, DATE, IPV4, SSN, CARD))
#: No text without this has any of them.
MAYBE = r"[0-9][ .()/-]{0,2}[0-9]|@|sk-|AKIA|gh[pousr]_"


def session_key(spark: SparkSession) -> str:
    """The key of the session's setting; a random one is set there if it is unset, so that values stay linked in one session only."""
    key = spark.conf.get(KEY_SETTING, "")
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key


def hmac(key: str, message: Column) -> Column:
    """HMAC with SHA-256 as hexadecimal digits; the key's blocks are made here, the digests in Spark."""
    import hashlib

    raw = key.encode("utf-8")
    if not raw:
        raise ValueError("the key must not be empty")
    block = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ x for b in block)) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def _draw(key: str, kind: str, i: Column, half: Column, below: Column) -> Column:
    """A keyed pseudo-random number from 0 up to ``below``."""
    digest = hmac(key, F.concat_ws("|", F.lit(kind), i.cast("string"), half.cast("string"), below.cast("string")))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), below)


def feistel(value: Column, a: Column, b: Column, key: str, kind: str) -> Column:
    """A keyed permutation of the numbers from 0 up to a * b: rounds change value div b and value mod b in turn."""
    right = F.pmod(value, b)
    start = F.struct(bind(right, lambda r: F.call_function("div", value - r, b)).alias("l"), right.alias("r"))

    def step(s: Column, i: Column) -> Column:
        odd = i % 2 == 1
        return F.struct(
            F.when(odd, F.pmod(s["l"] + _draw(key, kind, i, s["r"], a), a)).otherwise(s["l"]).cast("bigint").alias("l"),
            F.when(odd, s["r"]).otherwise(F.pmod(s["r"] + _draw(key, kind, i, s["l"], b), b)).cast("bigint").alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: s["l"] * b + s["r"])


def feistel_digits(digits: Column, key: str, kind: str) -> Column:
    """A keyed permutation of the digit strings of one length, up to 18 digits."""
    n = F.length(digits)
    power = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("bigint")
    left = (n / 2).cast("int")
    return F.lpad(feistel(digits.cast("bigint"), power(left), power(n - left), key, kind).cast("string"), n, "0")


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _refill(template: Column, digits: Column) -> Column:
    """``template`` with its digits replaced in order by ``digits``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def step(s: Column, c: Column) -> Column:
        is_digit = c.rlike("[0-9]")
        return F.struct(F.concat(s["out"], F.when(is_digit, F.substring(digits, s["k"], 1)).otherwise(c)).alias("out"), (s["k"] + is_digit.cast("int")).alias("k"))

    return F.aggregate(F.split(template, ""), start, step, lambda s: s["out"])


def _relaid(template: Column, characters: Column) -> Column:
    """``characters`` with spaces where ``template`` has them."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def step(s: Column, c: Column) -> Column:
        space = c == " "
        return F.struct(F.concat(s["out"], F.when(space, c).otherwise(F.substring(characters, s["k"], 1))).alias("out"), (s["k"] + (~space).cast("int")).alias("k"))

    return F.aggregate(F.split(template, ""), start, step, lambda s: s["out"])


def _luhn_sum(digits: Column, doubled_from_right: int) -> Column:
    """Luhn's sum; 1: the second digit from the right is the first doubled one, 0: the last one is."""

    def term(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 != doubled_from_right, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.coalesce(term(c, i), F.lit(0))), F.lit(0), lambda s, x: s + x)


def _card(match: Column, key: str) -> Column:
    def body(digits: Column) -> Column:
        payload = feistel_digits(digits.substr(F.lit(1), F.length(digits) - 1), key, "card")
        whole = bind(payload, lambda p: F.concat(p, F.pmod(10 - F.pmod(_luhn_sum(p, 0), F.lit(10)), F.lit(10)).cast("string")))
        valid = F.length(digits).between(13, 19) & (_luhn_sum(digits, 1) % 10 == 0) & ~digits.rlike("^(.)\\1*$")
        return F.when(valid, F.struct(F.lit("card").alias("kind"), _refill(match, whole).alias("out")))

    return bind(_digits(match), body)


def _phone(match: Column, key: str) -> Column:
    """The digits after the country code are permuted; seven or more of them make a number."""
    code = F.regexp_extract(match, r"^(\+[0-9]{1,3})(?=[^0-9])", 1)
    code = F.when(code == "", F.regexp_extract(match, r"^(\+[0-9])", 1)).otherwise(code)

    def body(c: Column) -> Column:
        rest = match.substr(F.length(c) + 1, F.length(match))
        digits = _digits(rest)
        return F.when(F.length(digits).between(7, 14), F.struct(F.lit("phone").alias("kind"), F.concat(c, _refill(rest, feistel_digits(digits, key, "phone"))).alias("out")))

    return bind(code, body)


def _national(match: Column, key: str) -> Column:
    """Numbers of ten digits, whose area and exchange begin with 2 to 9."""

    def body(digits: Column) -> Column:
        part = lambda a, n: F.substring(digits, a, n).cast("bigint")
        number = ((part(1, 3) - 200) * 800 + part(4, 3) - 200) * 10_000 + part(7, 4)
        permuted = feistel(number, F.expr("80000L"), F.expr("80000L"), key, "national")

        def shown(v: Column) -> Column:
            upper, line = F.call_function("div", v, F.lit(10_000)), F.pmod(v, F.lit(10_000))
            area, exchange = F.call_function("div", upper, F.lit(800)) + 200, F.pmod(upper, F.lit(800)) + 200
            return F.concat(*(F.lpad(x.cast("bigint").cast("string"), n, "0") for x, n in ((area, 3), (exchange, 3), (line, 4))))

        return F.struct(F.lit("phone").alias("kind"), _refill(match, bind(permuted, shown)).alias("out"))

    return bind(_digits(match), body)


def _mod97(characters: Column) -> Column:
    """The rest by 97 of a string whose letters stand for 10 to 35."""
    value = lambda c: F.conv(c, 36, 10).cast("bigint")
    return F.aggregate(F.transform(F.filter(F.split(characters, ""), lambda c: c != ""), value), F.expr("0L"), lambda s, x: F.pmod(s * F.when(x > 9, 100).otherwise(10) + x, F.lit(97)))


def _iban(match: Column, key: str) -> Column:
    """The last digits of the account, 16 at most, are permuted; country, bank letters and layout stay, the check digits fit."""

    def body(plain: Column) -> Column:
        account = plain.substr(F.lit(5), F.length(plain))
        digits = _digits(account)
        few = F.least(F.length(digits), F.lit(16))
        kept = digits.substr(F.lit(1), F.length(digits) - few)
        new = bind(F.concat(kept, feistel_digits(digits.substr(F.length(digits) - few + 1, few), key, "iban")), lambda d: _refill(account, d))

        def shown(own: Column) -> Column:
            check = F.lpad((F.lit(98) - _mod97(F.concat(own, F.substring(plain, 1, 2), F.lit("00")))).cast("string"), 2, "0")
            return _relaid(match, F.concat(F.substring(plain, 1, 2), check, own))

        valid = F.length(plain).between(15, 34) & (F.length(digits) > 1) & (_mod97(F.concat(account, F.substring(plain, 1, 4))) == 1)
        return F.when(valid, F.struct(F.lit("iban").alias("kind"), bind(new, shown).alias("out")))

    return bind(F.regexp_replace(match, " ", ""), body)


def _ipv4(match: Column, key: str) -> Column:
    def body(parts: Column) -> Column:
        number = F.aggregate(parts, F.expr("0L"), lambda s, x: s * 256 + x)
        permuted = feistel(number, F.expr("65536L"), F.expr("65536L"), key, "ipv4")
        octets = lambda v: F.concat_ws(".", *(F.pmod(F.shiftright(v, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)))
        return F.when(F.forall(parts, lambda x: x < 256), F.struct(F.lit("ipv4").alias("kind"), bind(permuted, octets).alias("out")))

    return bind(F.transform(F.split(match, "\\."), lambda x: x.cast("bigint")), body)


def _ssn(match: Column, key: str) -> Column:
    """Valid areas are 1 to 899 without 666, groups 1 to 99, serial numbers 1 to 9999."""

    def body(p: Column) -> Column:
        area, group, serial = (F.get(p, i) for i in range(3))
        number = ((area - 1 - (area > 666).cast("bigint")) * 99 + group - 1) * 9999 + serial - 1
        permuted = feistel(number, F.expr("898L"), F.expr("989901L"), key, "ssn")

        def shown(v: Column) -> Column:
            area_ = F.call_function("div", v, F.lit(989901)) + 1
            rest = F.pmod(v, F.lit(989901))
            serial_ = F.pmod(rest, F.lit(9999))
            pad = lambda x, n: F.lpad(x.cast("bigint").cast("string"), n, "0")
            sign = F.substring(match, 4, 1)
            return F.concat(pad(area_ + (area_ >= 666).cast("bigint"), 3), sign, pad(F.call_function("div", rest, F.lit(9999)) + 1, 2), sign, pad(serial_ + 1, 4))

        valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
        return F.when(valid, F.struct(F.lit("ssn").alias("kind"), bind(permuted, shown).alias("out")))

    return bind(F.transform(F.split(match, "[- ]"), lambda x: x.cast("bigint")), body)


def _date(match: Column, key: str) -> Column:
    """Calendar dates in the range of days; others stay. Dates with slashes are day-first if they can be read so, else month-first."""

    def body(days: Column) -> Column:
        permuted = feistel(days.cast("bigint"), F.lit(DAYS[0]).cast("bigint"), F.lit(DAYS[1]).cast("bigint"), key, "date")
        shown = bind(F.date_add(F.to_date(F.lit(FIRST_DAY)), permuted.cast("int")), lambda d: F.when(match.contains("/"), F.date_format(d, "dd/MM/yyyy")).otherwise(F.date_format(d, "yyyy-MM-dd")))
        return F.when(days.between(0, DAYS[0] * DAYS[1] - 1), F.struct(F.lit("date").alias("kind"), shown.alias("out")))

    day = F.coalesce(F.try_to_timestamp(match, F.lit("yyyy-MM-dd")), F.try_to_timestamp(match, F.lit("dd/MM/yyyy"))).cast("date")
    return F.coalesce(bind(F.datediff(day, F.to_date(F.lit(FIRST_DAY))), body), _month_first(match, key))


def _month_first(match: Column, key: str) -> Column:
    """Month-first dates after the 12th of a month, which no day-first date looks like: permuted among themselves, 29 February among leap years."""
    dated = F.try_to_timestamp(match, F.lit("MM/dd/yyyy")).cast("date")
    before = F.array(*map(F.lit, LATE_BEFORE))
    pad = lambda x, n: F.lpad(x.cast("bigint").cast("string"), n, "0")

    def leap(year: Column) -> Column:
        permuted = feistel(F.call_function("div", (year - LEAP_YEARS[0]).cast("bigint"), F.lit(4)), F.expr("7L"), F.expr("7L"), key, "leap")
        return F.concat(F.lit("02/29/"), (permuted * 4 + LEAP_YEARS[0]).cast("string"))

    def common(d: Column) -> Column:
        number = ((F.year(d) - LATE_YEARS[0]) * sum(LATE_DAYS) + F.get(before, F.month(d) - 1) + F.dayofmonth(d) - 13).cast("bigint")
        years, days = (F.lit(x).cast("bigint") for x in (LATE_YEARS[1] - LATE_YEARS[0] + 1, sum(LATE_DAYS)))

        def shown(v: Column) -> Column:
            rest = F.pmod(v, days)
            month = F.size(F.filter(before, lambda x: x <= rest))
            return F.concat_ws("/", pad(month, 2), pad(rest - F.get(before, month - 1) + 13, 2), pad(F.call_function("div", v, days) + LATE_YEARS[0], 4))

        return bind(feistel(number, years, days, key, "month-first"), shown)

    def body(d: Column) -> Column:
        out = F.when((F.month(d) == 2) & (F.dayofmonth(d) == 29), leap(F.year(d))).otherwise(common(d))
        return F.when((F.dayofmonth(d) > 12) & F.year(d).between(*LATE_YEARS), F.struct(F.lit("date").alias("kind"), out.alias("out")))

    return F.when(match.contains("/"), bind(dated, body))


def _email(match: Column, key: str) -> Column:
    name = F.concat(F.lit("u"), F.substring(hmac(key, F.concat(F.lit("email|"), F.lower(match))), 1, 12))
    return F.struct(F.lit("email").alias("kind"), F.concat(name, F.lit("@example.invalid")).alias("out"))


def _token(match: Column, key: str) -> Column:
    return F.struct(F.lit("token").alias("kind"), hmac(key, F.concat(F.lit("token|"), match)).substr(F.lit(1), F.length(match)).alias("out"))


def _secret(match: Column, key: str) -> Column:
    """Access keys keep their prefix and length; the rest is a digest, repeated where it is too short."""
    prefix = F.regexp_extract(match, "^(sk-|AKIA|gh[pousr]_)", 1)
    digest = hmac(key, F.concat(F.lit("secret|"), match))
    digest = F.when(prefix == "AKIA", F.upper(digest)).otherwise(digest)
    return F.struct(F.lit("token").alias("kind"), bind(digest, lambda d: F.concat(prefix, F.rpad(d, F.length(match) - F.length(prefix), d))).alias("out"))


def pseudonym(match: Column, key: str) -> Column:
    """Struct ``kind, out`` for a match of :data:`ANY`; kind is null and out the match itself if it fails its validation."""
    whole = lambda p: match.rlike(f"^(?:{p})$")
    made = (
        F.when(match.contains("@"), _email(match, key))
        .when(match.startswith("+"), _phone(match, key))
        .when(whole("(?:sk-|AKIA|gh[pousr]_)[0-9A-Za-z_-]*"), _secret(match, key))
        .when(whole("[A-Z]{2}[0-9]{2}[0-9A-Z ]*"), _iban(match, key))
        .when(whole(r"[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}|\([0-9]{3}\) ?[0-9]{3}[-. ][0-9]{4}"), _national(match, key))
        .when(whole("[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}"), _date(match, key))
        .when(whole("(?:[0-9]{1,3}\\.){3}[0-9]{1,3}"), _ipv4(match, key))
        .when(whole("[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{3} [0-9]{2} [0-9]{4}"), _ssn(match, key))
        .when(whole("[0-9a-fA-F]{32,64}"), _token(match, key))
        .otherwise(_card(match, key))
    )
    return F.coalesce(made, F.struct(F.lit(None).cast("string").alias("kind"), match.alias("out")))


def pseudonymise(text: Column, key: str) -> Column:
    """Struct ``text, kinds`` of a text: its pseudonymised form, and the kinds replaced, in order.

    The key has no default; an empty one is refused. A null text stays null, with
    no kinds; empty texts and texts without personal data come back as they are; texts of any
    length are searched whole; equal texts have equal results.
    """
    found = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))

    def body(matches: Column) -> Column:
        made = F.transform(matches, lambda m: pseudonym(m, key))
        parts = F.split(text, ANY, -1)
        joined = lambda p: F.concat_ws("", F.flatten(F.zip_with(parts, p, lambda a, b: F.array(a, F.coalesce(b["out"], F.lit(""))))))
        return bind(made, lambda p: F.struct(joined(p).alias("text"), F.filter(F.transform(p, lambda x: x["kind"]), lambda k: k.isNotNull()).alias("kinds")))

    nothing = F.struct(text.alias("text"), F.array().cast("array<string>").alias("kinds"))
    return F.when(text.rlike(MAYBE), bind(found, body)).otherwise(nothing)


def without_pii(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in the text column; all other columns and all rows stay, repeated ones as often.

    Null texts stay null, empty ones empty; an empty table gives an empty table.
    """
    return docs.withColumn(text, pseudonymise(F.col(text), key)["text"])
