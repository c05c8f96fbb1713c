r"""Format-preserving pseudonyms for personal data; DataFrame operations only.

One pattern finds candidates; each is validated (Luhn digit of cards, octets of addresses,
calendar dates) and then permuted within its own format by a keyed, alternating Feistel
network, so a value always gets the same pseudonym, in every document, and the key's holder
can undo it:

- cards (a length and first digits that an issuer uses, separators kept): the first four digits
  stay, the others but the last are permuted as a number, and the last becomes the Luhn digit
  again;
- social security numbers that can have been given (no area 000, 666 or from 900 on, no group 00,
  no serial 0000): permuted among these;
- telephone numbers: the digits after a country code, or after the 0 and the digit behind it
  that start a national number, are permuted. Shapes: an area code in parentheses; ``+`` and 8
  to 15 digits; ``00`` and a country code; 3-3-4 digits, also after ``1``; ``0`` and 9 to 11 digits
  in all. Groups are split by one space, dot or hyphen; without ``+`` a number must have groups;
- IPv4 addresses: the 32 bits, as two halves; four numbers after ``v``, ``version``, ``release``
  or ``build`` are a version;
- dates ``yyyy-mm-dd``, ``dd.mm.yyyy``, ``dd/mm/yyyy`` of the years 200 to 9799: the day's number
  among the 146,097 days (189 x 773) of its 400 years (1800 to 2199 and so on); ``mm/dd/yyyy``
  where that is the only reading, among the days that have no other;
- e-mail addresses (the part before the @) and values of ``token``, ``password``, ``secret``,
  ``api_key`` assignments (all between quotes, or four characters and more up to a space): each
  ASCII letter or digit within its kind, hexadecimal kept so.

Numbers that fail validation are no personal data and stay as they are. The key comes from the
caller; the query takes it from the setting ``KEY_SETTING`` and draws one for the run where
that is unset.

Cases: null texts stay null and empty ones empty, with no values; texts without candidates are
returned untouched; repeated rows are each rewritten; null ids keep their rows; an empty table
gives no rows; other columns are kept, and only ``text`` is read.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table

KEY_SETTING = "spark.perilmap.pseudonymKey"
ROUNDS = 8
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
# Java's matcher recurses for each repeat of a group, so a domain has as many labels as its 253 characters can hold.
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]{1,63}+){1,126}+"
SECRET_NAME = r"(?i:\b(?:access[_-]?token|token|password|passwd|secret|api[_-]?key)\s{0,3}[=:]\s{0,3})"
SECRET = SECRET_NAME + r"""(?:"[^"\n]{1,200}(?=")|'[^'\n]{1,200}(?=')|["']?[^\s"']{3,}[A-Za-z0-9])"""
IP = rf"(?<![\d.])(?<!(?i:\bv|\bver|\bversion|\brelease|\bbuild)[ .:]{{0,2}}){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)"
PHONE = r"(?<!\d)\+?\d{0,3}[ .-]?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}(?!\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
DATE = r"(?<!\d)(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?!\d)"
CARD = r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)"
_ALONE = r"(?<!\d)(?<!\d[.-])"
PLUS = r"\+(?:\d{1,3}[ .-]?\(\d{1,5}\)(?:[ .-]?\d){5,11}|\d(?:[ .-]?\d){7,14})(?!\d)"
GROUPED = rf"{_ALONE}(?:1[ .-])?\d{{3}}[ .-]\d{{3}}[ .-]\d{{4}}(?![.-]?\d)"
#: National and 00 numbers start with digits that stay; the shape of an SSN is none of them.
ZERO = (
    rf"{_ALONE}(?=00[1-9]\d{{0,2}}[ .-])00[1-9](?:[ .-]?\d){{7,14}}(?!\d)",
    rf"{_ALONE}(?!\d{{3}}-\d{{2}}-\d{{4}}(?!\d))(?=0[1-9]\d{{0,4}}[ .-])0[1-9](?:[ .-]?\d){{7,9}}(?!\d)",
    r"\(0\d{1,4}\)(?:[ .-]?\d){5,9}(?!\d)",
)
#: Calling codes are prefix-free, so a code says itself how long it is.
CALLING_CODE = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}"
ANY = "|".join((EMAIL, SECRET, IP, PHONE, SSN, DATE, PLUS, GROUPED, CARD, *ZERO))
# First digits and lengths of the card issuers' numbers.
ISSUED = (
    r"^(?:4(?:\d{12}|\d{15}|\d{18})|5[1-5]\d{14}|(?:222[1-9]|22[3-9]\d|2[3-6]\d\d|27[01]\d|2720)\d{12}|3[47]\d{13}|3(?:0[0-5]|[689]\d)\d{11}|35(?:2[89]|[3-8]\d)\d{12}"
    r"|6(?:011|4[4-9]\d|5\d\d)\d{12}|62\d{14,17}|(?:5018|5020|5038|5893|6304|6759|676[1-3])\d{9,15})$"
)
#: A text without any of these holds no candidate.
HINT = r"[@0-9]|(?i:token|passw|secret|api.?key)"


def _word(key: str, kind: str, *parts: Column) -> Column:
    """60 bits of a keyed hash of the parts."""
    text = F.concat_ws("|", F.lit(key), F.lit(kind), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 15), 16, 10).cast("bigint")


def permute_number(left: Column, right: Column, left_size: Column, right_size: Column, key: str, kind: str, undo: bool = False) -> Column:
    """(left, right) permuted among left_size * right_size pairs; both sizes may differ."""
    big = lambda c: c.cast("bigint")
    start = F.struct(big(left).alias("x"), big(right).alias("y"), big(left_size).alias("mx"), big(right_size).alias("my"))

    def forth(s: Column, i: Column) -> Column:
        x = F.pmod(s["x"] + F.pmod(_word(key, kind, i, s["mx"], s["y"]), s["mx"]), s["mx"])
        return F.struct(s["y"].alias("x"), x.alias("y"), s["my"].alias("mx"), s["mx"].alias("my"))

    def back(s: Column, i: Column) -> Column:
        y = F.pmod(s["y"] - F.pmod(_word(key, kind, i, s["my"], s["x"]), s["my"]), s["my"])
        return F.struct(y.alias("x"), s["x"].alias("y"), s["my"].alias("mx"), s["mx"].alias("my"))

    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if undo else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(rounds, start, back if undo else forth)


def permute_digits(digits: Column, key: str, kind: str, undo: bool = False) -> Column:
    """A string of up to 19 digits, permuted among those of its length."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    size = lambda k: F.concat(F.lit("1"), F.repeat(F.lit("0"), k)).cast("bigint")
    left, right = F.substr(digits, F.lit(1), half), F.substr(digits, half + 1)
    out = permute_number(left.cast("bigint"), right.cast("bigint"), size(half), size(n - half), key, kind, undo)
    return F.concat(F.lpad(out["x"].cast("string"), half, F.lit("0")), F.lpad(out["y"].cast("string"), n - half, F.lit("0")))


def permute_characters(text: Column, key: str, kind: str, undo: bool = False) -> Column:
    """Letters and digits, each within its kind; a hexadecimal string stays hexadecimal.

    Any other string is walked on until it isn't hexadecimal again, so that undoing takes the
    same way (of single letters a quarter are, so 32 steps are never used up).
    """
    hexadecimal = lambda t: t.rlike("^[0-9a-f]+$|^[0-9A-F]+$")
    # What all characters share is a variable of a function: made once, not once for each.
    given = F.array(F.struct(text.alias("text"), F.when(hexadecimal(text), F.lit(6)).otherwise(F.lit(26)).alias("letters")))

    def walked(v: Column) -> Column:
        letters = v["letters"]

        def moved(part: Column, other: Column, i: Column) -> Column:
            def one(c: Column, k: Column, digest: Column) -> Column:
                base = F.when(c.rlike("^[0-9]$"), F.lit(48)).when(c.rlike("^[a-z]$"), F.lit(97)).when(c.rlike("^[A-Z]$"), F.lit(65))
                size = F.when(c.rlike("^[0-9]$"), F.lit(10)).otherwise(letters)
                step = F.pmod(_word(key, kind, i, k, digest), size)
                return F.when(base.isNull(), c).otherwise(F.char((F.pmod(F.ascii(c) - base + (-step if undo else step), size) + base).cast("bigint")))

            digests = F.array(F.sha2(other.cast("binary"), 256))
            return F.transform(digests, lambda h: F.array_join(F.transform(F.split(part, ""), lambda c, k: one(c, k, h)), ""))[0]

        forth = lambda s, i: F.struct(s["y"].alias("x"), moved(s["x"], s["y"], i).alias("y"))
        back = lambda s, i: F.struct(moved(s["y"], s["x"], i).alias("x"), s["x"].alias("y"))
        rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if undo else F.sequence(F.lit(0), F.lit(ROUNDS - 1))

        def all_rounds(t: Column) -> Column:
            half = F.floor(F.length(t) / 2).cast("int")
            out = F.aggregate(rounds, F.struct(F.substr(t, F.lit(1), half).alias("x"), F.substr(t, half + 1).alias("y")), back if undo else forth)
            return F.transform(F.array(out), lambda o: F.concat(o["x"], o["y"]))[0]

        return F.aggregate(F.sequence(F.lit(1), F.lit(32)), all_rounds(v["text"]), lambda t, _: F.when((letters == 26) & hexadecimal(t), all_rounds(t)).otherwise(t))

    return F.transform(given, walked)[0]


def luhn_digit(payload: Column) -> Column:
    """The digit that makes ``payload`` and itself pass the Luhn test."""
    digits = F.split(F.reverse(payload), "")
    values = F.transform(digits, lambda c, k: F.when(k % 2 == 0, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")))
    total = F.aggregate(values, F.lit(0), lambda a, v: a + v)
    return F.pmod(10 - total % 10, F.lit(10)).cast("string")


def with_digits(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced in order by ``digits``."""
    start = F.struct(F.lit(0).alias("k"), F.lit("").alias("s"))
    step = lambda a, c: F.when(c.rlike("^[0-9]$"), F.struct((a["k"] + 1).alias("k"), F.concat(a["s"], F.substr(digits, a["k"] + 1, F.lit(1))).alias("s"))).otherwise(F.struct(a["k"].alias("k"), F.concat(a["s"], c).alias("s")))
    return F.aggregate(F.split(shape, ""), start, step)["s"]


def _card(m: Column, key: str, undo: bool) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    payload = F.substr(digits, F.lit(1), F.length(digits) - 1)
    new = F.concat(F.left(payload, F.lit(4)), permute_digits(F.substr(payload, F.lit(5)), key, "card", undo))
    valid = F.when(digits.rlike(ISSUED) & (luhn_digit(payload) == F.right(digits, F.lit(1))), with_digits(m, F.concat(new, luhn_digit(new))))
    return valid.when(m.rlike(r"^0\d{0,5}[ -]"), _zero(m, key, undo)).otherwise(m)


def _zero(m: Column, key: str, undo: bool) -> Column:
    """Telephone numbers that start with 0 or 00. The last digit keeps its distance from the Luhn
    digit, so a number that could be a card and isn't one becomes no card either."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    head = F.regexp_extract(digits, rf"^(?:00(?:{CALLING_CODE})|\d\d)", 0)
    payload = F.substr(digits, F.lit(1), F.length(digits) - 1)
    new = F.concat(head, permute_digits(F.substr(payload, F.length(head) + 1), key, "phone", undo))
    last = F.pmod(F.right(digits, F.lit(1)).cast("int") - luhn_digit(payload).cast("int") + luhn_digit(new).cast("int"), F.lit(10))
    return with_digits(m, F.concat(new, last.cast("string")))


def _plus(m: Column, key: str, undo: bool) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    head = F.regexp_extract(digits, f"^(?:{CALLING_CODE})", 0)
    return with_digits(m, F.concat(head, permute_digits(F.substr(digits, F.length(head) + 1), key, "phone", undo)))


def _ten(m: Column, key: str, undo: bool) -> Column:
    """The last ten digits of a telephone number; what stands before them, a country code, stays."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    keep = F.greatest(F.length(digits) - 10, F.lit(0))
    return with_digits(m, F.concat(F.substr(digits, F.lit(1), keep), permute_digits(F.substr(digits, keep + 1), key, "phone", undo)))


def _ssn(m: Column, key: str, undo: bool) -> Column:
    """898 areas (001 to 899 without 666), 99 groups of 9,999 serials."""
    area, group, serial = (F.substr(m, F.lit(a), F.lit(n)).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    out = permute_number(area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(989_901), key, "ssn", undo)
    wide = lambda n, size: F.lpad(n.cast("bigint").cast("string"), size, "0")
    new = F.concat_ws("-", wide(out["x"] + F.when(out["x"] >= 665, 2).otherwise(1), 3), wide(F.floor(out["y"] / 9999) + 1, 2), wide(out["y"] % 9999 + 1, 4))
    return F.when(valid, new).otherwise(m)


def _ip(m: Column, key: str, undo: bool) -> Column:
    part = lambda k: F.split_part(m, F.lit("."), F.lit(k)).cast("bigint")
    out = permute_number(part(1) * 256 + part(2), part(3) * 256 + part(4), F.lit(65536), F.lit(65536), key, "ip", undo)
    octets = [F.floor(out["x"] / 256), out["x"] % 256, F.floor(out["y"] / 256), out["y"] % 256]
    return F.concat_ws(".", *[o.cast("bigint").cast("string") for o in octets])


def _date(m: Column, key: str, undo: bool) -> Column:
    iso = m.rlike("^[0-9]{4}-")
    part = lambda a, b: F.when(iso, F.substr(m, F.lit(a[0]), F.lit(a[1]))).otherwise(F.substr(m, F.lit(b[0]), F.lit(b[1])))
    text = F.concat_ws("-", part((1, 4), (7, 4)), part((6, 2), (4, 2)), part((9, 2), (1, 2)))
    day = F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date")
    start = F.lit("1800-01-01").cast("date")

    def moved(d: Column) -> Column:
        n = F.pmod(F.datediff(d, start), F.lit(146_097))
        out = permute_number(F.floor(n / 773), n % 773, F.lit(189), F.lit(773), key, "date", undo)
        return F.date_add(start, (F.datediff(d, start) - n + out["x"] * 773 + out["y"]).cast("int"))

    mark = F.substr(m, F.lit(3), F.lit(1))
    new = moved(day)
    made = F.when(iso, F.date_format(new, "yyyy-MM-dd")).otherwise(F.concat(F.date_format(new, "dd"), mark, F.date_format(new, "MM"), mark, F.date_format(new, "yyyy")))
    # Month first, where day first is no date: walked on until that holds of the new date too
    # (two of five days fail it, so 64 steps are never used up).
    swapped = F.try_to_timestamp(F.concat_ws("-", F.substr(m, F.lit(7), F.lit(4)), F.substr(m, F.lit(1), F.lit(2)), F.substr(m, F.lit(4), F.lit(2))), F.lit("yyyy-MM-dd")).cast("date")
    other = F.aggregate(F.sequence(F.lit(1), F.lit(64)), moved(swapped), lambda d, _: F.when(F.dayofmonth(d) > 12, d).otherwise(moved(d)))
    turned = F.concat(F.date_format(other, "MM"), mark, F.date_format(other, "dd"), mark, F.date_format(other, "yyyy"))
    in_range = lambda d: F.datediff(d, start).between(-4 * 146_097, 20 * 146_097 - 1)
    return F.when(in_range(day), made).when(~iso & day.isNull() & in_range(swapped), turned).otherwise(m)


def pseudonym(m: Column, key: str, undo: bool = False) -> Column:
    """What a candidate becomes; itself where it isn't valid."""
    value = F.regexp_replace(m, f"^{SECRET_NAME}[\"']?", "")
    name = F.substring_index(m, "@", 1)
    return (
        F.when(m.rlike(f"^{SECRET_NAME}"), F.concat(F.substr(m, F.lit(1), F.length(m) - F.length(value)), permute_characters(value, key, "secret", undo)))
        .when(F.contains(m, F.lit("@")), F.concat(permute_characters(name, key, "mail", undo), F.substr(m, F.length(name) + 1)))
        .when(m.rlike(f"^{DATE}$"), _date(m, key, undo))
        .when(m.rlike(f"^{IP}$"), _ip(m, key, undo))
        .when(m.rlike(f"^(?:{PHONE})$"), _ten(m, key, undo))
        .when(m.rlike(f"^{SSN}$"), _ssn(m, key, undo))
        .when(m.rlike(f"^(?:{PLUS})$"), _plus(m, key, undo))
        .when(m.rlike(f"^(?:{GROUPED})$"), _ten(m, key, undo))
        .when(m.rlike(f"^(?:{CARD})$"), _card(m, key, undo))
        .otherwise(_zero(m, key, undo))
    )


def pseudonymised(docs: DataFrame, key: str, undo: bool = False) -> DataFrame:
    """``docs`` with ``text`` rewritten, and ``n_values`` (``n_values_`` if taken), the number of values replaced."""
    if not key:
        raise ValueError("pseudonyms need a key")
    old, new = fresh("found", docs.columns), fresh("new", docs.columns)
    may = F.coalesce(F.col("text").rlike(HINT), F.lit(False))
    found = docs.withColumn(old, F.when(may, F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>")))
    named = found.withColumn(new, F.when(F.size(old) > 0, F.transform(old, lambda m: pseudonym(m, key, undo))).otherwise(F.array().cast("array<string>")))
    gaps = F.split("text", ANY, -1)
    woven = F.array_join(F.flatten(F.zip_with(gaps, F.concat(new, F.array(F.lit(""))), lambda g, v: F.array(g, v))), "")
    replaced = F.size(F.filter(F.zip_with(old, new, lambda a, b: a != b), lambda x: x))
    return named.select(
        *[(F.when(F.size(new) > 0, woven).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c)) for c in docs.columns],
        replaced.cast("int").alias(fresh("n_values", docs.columns)),
    )


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get(KEY_SETTING, None) or secrets.token_hex(16)
    return pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), key)
