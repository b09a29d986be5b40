"""Format-preserving pseudonyms for personal data: keyed Feistel networks.

Found and validated: e-mail addresses, card numbers (13 to 19 digits, Luhn),
IPv4 addresses, phone numbers, social security numbers and calendar dates.
What only looks like one (a wrong check digit, an octet over 255, a 31st of
February) stays as it is. A value becomes a list of numbers, each with a
modulus: digits, letters, octets, or the parts of a day's number. Ten Feistel
rounds add a keyed hash of one half to the other, modulo its moduli, so that
the mapping is a permutation of the format: equal values stay equal in all
documents, different ones stay different, and results are valid again. Signs
and spaces keep their places; an e-mail address keeps its domain.

Dates are permuted within the 400 years from 1800 on, whose 146,097 days are
189 times 773; dates outside them stay. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, read, whole

#: The kinds and their patterns; at one place the first that fits counts.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9])?@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "date": r"(?<![0-9A-Za-z/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9A-Za-z/]|-[0-9])",
}
KINDS = list(PATTERNS)
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
HINT = r"@|[0-9][0-9 ./-]*[0-9]"
ROUNDS = 10
PUBLIC_KEY = "no secret: set spark.lithic.pii.key"
DAY0, DAYS = "1800-01-01", (189, 773)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def feistel(values: Column, moduli: Column, key: str, kind: str) -> Column:
    """Permute ``array<int>`` values, each below its modulus: a bijection."""
    half = F.ceil(F.size(moduli) / 2).cast("int")

    def turn(state: Column, r: Column) -> Column:
        left = r % 2 == 0
        other = F.when(left, F.slice(state, half + 1, F.size(state))).otherwise(F.slice(state, F.lit(1), half))
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), F.array_join(F.transform(moduli, lambda m: m.cast("string")), ","), F.array_join(F.transform(other, lambda x: x.cast("string")), ",")), 256)

        def add(d: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                more = F.conv(F.substring(d, (i * 4) % 61 + 1, F.lit(4)), 16, 10).cast("int")
                return F.when((i < half) == left, F.pmod(x + more, F.get(moduli, i))).otherwise(x)

            return F.transform(state, one)

        return let(digest, add)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), values, turn)


def chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _code(c: Column) -> Column:
    """A letter's or digit's number within its class."""
    a = F.ascii(c)
    return F.when(a < 58, a - 48).when(a < 91, a - 65).otherwise(a - 97)


def _spelled(s: Column, key: str, kind: str) -> Column:
    """Permute letters and digits, each within its class, signs kept."""

    def body(cs: Column) -> Column:
        own = F.filter(cs, lambda c: c.rlike("[A-Za-z0-9]"))
        moduli = F.transform(own, lambda c: F.when(c.rlike("[0-9]"), 10).otherwise(26))
        fresh = feistel(F.transform(own, _code), moduli, key, kind)

        def put(new: Column) -> Column:
            def one(c: Column, i: Column) -> Column:
                at = F.size(F.filter(F.slice(cs, F.lit(1), i), lambda x: x.rlike("[A-Za-z0-9]")))
                a = F.ascii(c)
                first = F.when(a < 58, 48).when(a < 91, 65).otherwise(97)
                return F.when(c.rlike("[A-Za-z0-9]"), F.char(F.get(new, at) + first)).otherwise(c)

            return F.array_join(F.transform(cs, one), "")

        return let(fresh, put)

    return let(chars(s), body)


def _luhn(digits: Column) -> Column:
    """The Luhn sum of the digits (``array<int>``), the last one counted once."""
    n = F.size(digits)
    doubled = F.transform(digits, lambda d, i: F.when((n - i) % 2 == 0, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d)


def _digits(s: Column) -> Column:
    return F.transform(chars(F.regexp_replace(s, "[^0-9]", "")), lambda c: c.cast("int"))


def _refill(s: Column, digits: Column) -> Column:
    """The text s with its digits replaced, in order."""

    def body(cs: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            at = F.size(F.filter(F.slice(cs, F.lit(1), i), lambda x: x.rlike("[0-9]")))
            return F.when(c.rlike("[0-9]"), F.get(digits, at).cast("string")).otherwise(c)

        return F.array_join(F.transform(cs, one), "")

    return let(chars(s), body)


def _card(s: Column, key: str) -> Column:
    def body(d: Column) -> Column:
        n = F.size(d) - 1
        fresh = feistel(F.slice(d, F.lit(1), n), F.transform(F.slice(d, F.lit(1), n), lambda x: F.lit(10)), key, "card")
        whole = lambda f: F.concat(f, F.array(F.pmod(-_luhn(F.concat(f, F.array(F.lit(0)))), F.lit(10)).cast("int")))
        return let(fresh, lambda f: let(whole(f), lambda w: _refill(s, w)))

    return let(_digits(s), body)


def _ip(s: Column, key: str) -> Column:
    octets = F.transform(F.split(s, r"\."), lambda o: o.cast("int"))
    return F.array_join(F.transform(feistel(octets, F.array(*[F.lit(256)] * 4), key, "ip"), lambda o: o.cast("string")), ".")


def _phone(s: Column, key: str) -> Column:
    """The last ten digits; a country code stays."""
    local = F.regexp_extract(s, r"(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}$", 0)
    return let(local, lambda x: F.concat(F.substring(s, F.lit(1), F.length(s) - F.length(x)), _spelled(x, key, "phone")))


def _ssn(s: Column, key: str) -> Column:
    area = F.substring(s, F.lit(1), F.lit(3)).cast("int")
    values = F.array(area - 1 - (area > 666).cast("int"), F.substring(s, F.lit(5), F.lit(2)).cast("int") - 1, F.substring(s, F.lit(8), F.lit(4)).cast("int") - 1)

    def body(v: Column) -> Column:
        a = F.get(v, 0) + 1
        a = a + (a > 665).cast("int")
        return F.concat_ws("-", F.lpad(a.cast("string"), 3, "0"), F.lpad((F.get(v, 1) + 1).cast("string"), 2, "0"), F.lpad((F.get(v, 2) + 1).cast("string"), 4, "0"))

    return let(feistel(values, F.array(F.lit(898), F.lit(99), F.lit(9999)), key, "ssn"), body)


def _day(s: Column) -> Column:
    """The date that the text names, null if there is none."""
    part = lambda a, n: F.substring(s, F.lit(a), F.lit(n))
    iso = F.when(s.rlike("^[0-9]{4}-"), s).when(s.contains("/"), F.concat_ws("-", part(7, 4), part(1, 2), part(4, 2))).otherwise(F.concat_ws("-", part(7, 4), part(4, 2), part(1, 2)))
    return F.try_to_date(iso, "yyyy-MM-dd")


def _ordinal(s: Column) -> Column:
    return F.datediff(_day(s), F.lit(DAY0).cast("date"))


def _date(s: Column, key: str) -> Column:
    values = let(_ordinal(s), lambda n: F.array((n / DAYS[1]).cast("int"), (n % DAYS[1]).cast("int")))
    fresh = feistel(values, F.array(*[F.lit(d) for d in DAYS]), key, "date")

    def body(v: Column) -> Column:
        day = F.date_add(F.lit(DAY0).cast("date"), F.get(v, 0) * DAYS[1] + F.get(v, 1))
        return F.when(s.rlike("^[0-9]{4}-"), F.date_format(day, "yyyy-MM-dd")).when(s.contains("/"), F.date_format(day, "MM/dd/yyyy")).otherwise(F.date_format(day, "dd.MM.yyyy"))

    return let(fresh, body)


def kind_of(s: Column) -> Column:
    """The kind of one match; null if it fails validation."""
    whole = lambda k: s.rlike(f"^(?:{PATTERNS[k]})$")
    octets = F.transform(F.split(s, r"\."), lambda o: o.cast("int"))
    area = F.substring(s, F.lit(1), F.lit(3))
    out = F.when(s.contains("@"), "email")
    out = out.when(whole("card"), F.when(_luhn(_digits(s)) % 10 == 0, "card"))
    out = out.when(whole("ip"), F.when(F.forall(octets, lambda o: o <= 255) & ~s.rlike(r"(?:^|\.)0[0-9]"), "ip"))
    out = out.when(whole("phone"), "phone")
    out = out.when(whole("ssn"), F.when(~area.isin("000", "666") & (area < "900") & ~s.rlike("-00-|-0000$"), "ssn"))
    return out.when(whole("date"), F.when(_ordinal(s).between(0, DAYS[0] * DAYS[1] - 1), "date"))


def pseudonym(s: Column, kind: Column, key: str) -> Column:
    """The pseudonym of a validated value of that kind."""
    local = F.substring_index(s, "@", 1)
    out = F.when(kind == "email", F.concat(_spelled(local, key, "email"), F.substring(s, F.length(local) + 1, F.length(s))))
    out = out.when(kind == "card", _card(s, key)).when(kind == "ip", _ip(s, key)).when(kind == "phone", _phone(s, key))
    return out.when(kind == "ssn", _ssn(s, key)).when(kind == "date", _date(s, key)).otherwise(s)


def key_of(spark: SparkSession) -> str:
    """The secret in ``spark.lithic.pii.key``; without it a public one, good for tests only."""
    return spark.conf.get("spark.lithic.pii.key", PUBLIC_KEY)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", counted: bool = True) -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced by pseudonyms.

    Adds ``n_<kind> int`` for every kind, the values replaced, and columns of
    these names are replaced; not ``counted``, the columns stay as they are. A null text stays null, with no values; an empty
    table stays empty; texts of any length are replaced whole. ``key`` is the
    secret that the permutations depend on: who has it can undo them, and
    Spark's plans and event logs show it. One pass, no shuffle.
    """
    prepare(docs.sparkSession)
    counts = [f"n_{k}" for k in KINDS if counted]
    keep = [c for c in docs.columns if c not in counts]
    rows = docs.select(whole(docs, *counts), F.col(text_col).alias("text"))
    text = F.col("text")
    rows = rows.withColumn("found", F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))))
    rows = rows.withColumn("kinds", F.transform("found", kind_of))
    fresh = F.array_append(F.transform(F.arrays_zip("found", "kinds"), lambda x: pseudonym(x["found"], x["kinds"], key)), F.lit(""))
    gaps = F.split(text, ANY, -1)
    new = F.when(F.exists("kinds", lambda k: k.isNotNull()), F.array_join(F.zip_with(gaps, fresh, lambda g, f: F.concat(g, f)), "")).otherwise(text)
    out = [new.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in keep]
    number = lambda k: F.coalesce(F.when(F.col("kinds").isNotNull(), F.size(F.filter("kinds", lambda x: x == k))), F.lit(0))
    return rows.select(*out, *[number(k).alias(f"n_{k}") for k in KINDS if counted])


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(read(spark, sf_dir, "documents").select("doc_id", "text"), key_of(spark))
