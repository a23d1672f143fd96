"""PII: format-preserving pseudonyms by keyed Feistel networks, in DataFrame functions alone.

Personal values are found by one pattern and validated (Luhn, IBAN's mod 97, ranges of social security numbers
and of octets, the calendar). A valid value is mapped to its place in the set of all valid values of its format, permuted
there by a Feistel network, and written in the shape it had. So equal values become equal pseudonyms in every
document, different ones stay different, and each pseudonym is valid itself. What isn't valid is left as it is.

Number formats use a network on Z_a x Z_b with a * b the size of the set: the sides are changed in turn by a keyed
hash of the other, modulo a or b. E-mail addresses and account numbers use one on the halves of the string, each
character moving within its class (a-z, A-Z, 0-9).
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.common import table

ROUNDS = 8
#: The session's setting that has the key for the registered queries; `key_of` draws one where it is unset.
KEY_SETTING = "spark.rivulet.pii.key"
# Fixed formats. Each look-behind makes a run of characters be tried at its start alone, so that long runs cost no more.
# Java's matcher recurses for each turn of a repeated group, so every such group has an upper bound: that of DNS and of
# SMTP for addresses (64 characters before the @, labels of 63, at most 253 in all; `pseudonym` looks at the last).
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Lengths of IBANs by country: those written in groups end where their country's do, whatever follows.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK|FI|FK|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|HR|LI|LV", 22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA",
    23: "AE|GI|IL|IQ|OM|SO|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "LY|PT|ST", 26: "IS|TR", 27: "BI|DJ|FR|GR|IT|MC|SM", 28: "AL|AZ|BY|CY|DO|GT|HN|HU|LB|NI|PL|SV",
    29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU|YE", 31: "MT|SC", 32: "LC", 33: "RU",
}
GROUPED = "|".join(f"(?:{c})[0-9]{{2}}(?: [A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (f" [A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, c in IBAN_LENGTHS.items())
#: Calling codes but 1, whose numbers are of the North American shape.
CODES = "7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2}"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}+\.){1,126}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])(?:[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}|GROUPED)(?![A-Za-z0-9])".replace("GROUPED", GROUPED),
    "ip": rf"(?<![0-9A-Za-z.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9A-Za-z]|\.[0-9])",
    "date": r"(?<![0-9A-Za-z./-])(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.(?:19|20)[0-9]{2}|[0-9]{2}/[0-9]{2}/(?:19|20)[0-9]{2})(?![0-9A-Za-z]|[./-][0-9])",
    "ssn": r"(?<![0-9A-Za-z-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z]|-[0-9])",
    "phone": r"(?<![0-9A-Za-z+(-])(?:(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|\+1[ .-]?[0-9]{10})(?![0-9A-Za-z]|-[0-9])",
    "abroad": rf"(?<![0-9A-Za-z+(-])\+(?:{CODES})(?:[ ./-]?\(0\))?(?:[ ./-]?\(?[0-9]\)?){{6,12}}(?![0-9A-Za-z]|-[0-9])",
    "card": r"(?<![0-9A-Za-z-])(?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{13,19})(?![0-9A-Za-z]|-[0-9])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
DOMAIN_CHARS = 253
FIRST_DAY, DAYS_A, DAYS_B = "1900-01-01", 17, 4297  # 17 * 4297 days: 1900 to 2099
LONG = "long"


def _hash(key: str, tag: str, *parts: Column) -> Column:
    """60 bits of SHA-256 as a long."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(tag), *(p.cast("string") for p in parts)), 256), 1, 15), 16, 10).cast(LONG)


def permute(x: Column, a: Column, b: Column, key: str, tag: str) -> Column:
    """A keyed permutation of 0..a*b-1, a*b below 2^53."""
    start = F.struct(F.floor(x / b).cast(LONG).alias("l"), (x % b).cast(LONG).alias("r"))
    step = lambda s, i: F.struct(
        F.when(i % 2 == 0, (s["l"] + _hash(key, tag, i, s["r"])) % a).otherwise(s["l"]).alias("l"),
        F.when(i % 2 == 1, (s["r"] + _hash(key, tag, i, s["l"])) % b).otherwise(s["r"]).alias("r"),
    )
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["l"] * b + s["r"])


def permute_text(x: Column, key: str, tag: str) -> Column:
    """A keyed permutation of the strings of one length and one pattern of character classes."""
    half = F.floor(F.length(x) / 2).cast("int")

    def shifted(s: Column, by: Column, i: Column) -> Column:
        def one(c: Column, at: Column) -> Column:
            k = _hash(key, tag, i, at, by)
            move = lambda first, n: F.chr((F.ascii(c) - first + k % n) % n + first)
            return F.when(c.rlike("^[a-z]$"), move(97, 26)).when(c.rlike("^[A-Z]$"), move(65, 26)).when(c.rlike("^[0-9]$"), move(48, 10)).otherwise(c)

        return F.when(F.length(s) > 0, F.array_join(F.transform(F.split(s, ""), one), "")).otherwise(s)

    start = F.struct(F.substring(x, F.lit(1), half).alias("l"), F.substring(x, half + 1, F.length(x)).alias("r"))
    step = lambda s, i: F.struct(
        F.when(i % 2 == 0, shifted(s["l"], s["r"], i)).otherwise(s["l"]).alias("l"),
        F.when(i % 2 == 1, shifted(s["r"], s["l"], i)).otherwise(s["r"]).alias("r"),
    )
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: F.concat(s["l"], s["r"]))


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def fill(shape: Column, new: Column) -> Column:
    """`shape` with its digits replaced by those of `new`, in order."""
    step = lambda s, c: F.when(
        c.rlike("^[0-9]$"), F.struct((s["n"] + 1).alias("n"), F.concat(s["out"], F.substring(new, s["n"] + 1, F.lit(1))).alias("out"))
    ).otherwise(F.struct(s["n"].alias("n"), F.concat(s["out"], c).alias("out")))
    return F.aggregate(F.split(shape, ""), F.struct(F.lit(0).alias("n"), F.lit("").alias("out")), step, lambda s: s["out"])


def _padded(x: Column, n: Column | int) -> Column:
    return F.lpad(x.cast("string"), n, "0")


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast(LONG)


def luhn_digit(payload: Column) -> Column:
    """The check digit that follows `payload`."""
    n = F.length(payload)

    def step(s: Column, i: Column) -> Column:
        d = F.substring(payload, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return s + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step, lambda s: ((10 - s % 10) % 10).cast("string"))


def mod97(x: Column) -> Column:
    """Remainder by 97 of digits and letters, A as 10 to Z as 35."""

    def step(s: Column, c: Column) -> Column:
        return F.when(c.rlike("^[0-9]$"), (s * 10 + (F.ascii(c) - 48)) % 97).otherwise((s * 100 + (F.ascii(c) - 55)) % 97)

    return F.aggregate(F.split(x, ""), F.lit(0), step)


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of a match of ANY, null if it isn't valid."""
    d = digits(m)
    kind = {name: m.rlike(f"^(?:{p})$") for name, p in PATTERNS.items()}

    at = F.instr(m, "@")
    tld = F.regexp_extract(m, r"\.[A-Za-z]+$", 0)
    email = F.concat(permute_text(F.substring(m, F.lit(1), at - 1), key, "local"), F.lit("@"), permute_text(F.substring(m, at + 1, F.length(m) - at - F.length(tld)), key, "domain"), tld)

    packed = F.replace(m, F.lit(" "), F.lit(""))
    land, bban = F.substring(packed, 1, 2), F.substring(packed, F.lit(5), F.length(packed))
    new_bban = permute_text(bban, key, "iban")
    new_iban = F.concat(land, _padded(98 - mod97(F.concat(new_bban, land, F.lit("00"))), 2), new_bban)
    # Groups are of four, so the spaces go back after each four characters but the last.
    iban = F.when(mod97(F.concat(bban, F.substring(packed, 1, 4))) == 1, F.when(m.contains(" "), F.regexp_replace(new_iban, "(.{4})(?=.)", "$1 ")).otherwise(new_iban))

    octets = F.split(m, r"\.")
    ip_at = permute(F.aggregate(octets, F.lit(0).cast(LONG), lambda s, o: s * 256 + o.cast(LONG)), F.lit(1 << 16), F.lit(1 << 16), key, "ip")
    byte = lambda k: (F.shiftright(ip_at, k).bitwiseAND(F.lit(255))).cast("string")
    ip = F.concat_ws(".", byte(24), byte(16), byte(8), byte(0))

    iso = F.when(m.contains("-"), m).when(m.contains("."), F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 4, 2), F.substring(m, 1, 2))).otherwise(F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 1, 2), F.substring(m, 4, 2)))
    day = F.try_to_date(iso, "yyyy-MM-dd")
    day_at = permute(F.date_diff(day, F.lit(FIRST_DAY).cast("date")).cast(LONG), F.lit(DAYS_A), F.lit(DAYS_B), key, "date")
    new_day = F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), day_at.cast("int")), "yyyy-MM-dd")
    parts = {"yyyy": F.substring(new_day, 1, 4), "MM": F.substring(new_day, 6, 2), "dd": F.substring(new_day, 9, 2)}
    written = F.when(m.contains("-"), new_day).when(m.contains("."), F.concat_ws(".", parts["dd"], parts["MM"], parts["yyyy"])).otherwise(F.concat_ws("/", parts["MM"], parts["dd"], parts["yyyy"]))
    date = F.when(day.isNotNull(), written)

    # Areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999.
    area, rest = F.substring(d, 1, 3).cast(LONG), (F.substring(d, 4, 2).cast(LONG) - 1) * 9999 + F.substring(d, 6, 4).cast(LONG) - 1
    ssn_at = permute((area - 1 - (area > 666).cast(LONG)) * 989901 + rest, F.lit(898), F.lit(989901), key, "ssn")
    new_area = F.floor(ssn_at / 989901).cast(LONG) + 1
    new_rest = ssn_at % 989901
    ssn = fill(m, F.concat(_padded(new_area + (new_area >= 666).cast(LONG), 3), _padded(F.floor(new_rest / 9999).cast(LONG) + 1, 2), _padded(new_rest % 9999 + 1, 4)))

    # Any ten digits: numbers that no exchange has given out are written as telephone numbers all the same.
    ten = F.substring(d, F.length(d) - 9, F.lit(10))
    new_ten = _padded(permute(ten.cast(LONG), F.lit(100_000), F.lit(100_000), key, "phone"), 10)
    phone = fill(m, F.concat(F.substring(d, F.lit(1), F.length(d) - 10), new_ten))

    # The calling code stays, and so does a (0), which isn't dialled from abroad.
    dialled = F.replace(m, F.lit("(0)"), F.lit("(o)"))
    code = F.regexp_extract(m, rf"^\+({CODES})", 1)
    abroad = F.replace(fill(dialled, F.concat(code, permute_digits(F.substring(digits(dialled), F.length(code) + 1, F.length(m)), key, "abroad"))), F.lit("(o)"), F.lit("(0)"))

    payload = F.substring(d, F.lit(1), F.length(d) - 1)
    card = F.when(luhn_digit(payload) == F.substring(d, F.length(d), F.lit(1)), fill(m, _with_check(permute_digits(payload, key))))
    return (
        F.when(kind["email"], F.when(F.length(m) - at <= DOMAIN_CHARS, email)).when(kind["ip"], ip).when(kind["date"], date).when(kind["ssn"], ssn).when(kind["phone"], phone).when(kind["abroad"], abroad).when(kind["card"], card).when(kind["iban"], iban)
    )


def permute_digits(payload: Column, key: str, tag: str = "card") -> Column:
    """Strings of digits of one length, permuted; up to 18 digits."""
    n = F.length(payload)
    low = F.floor(n / 2).cast("int")
    a, b = _power(n - low), _power(low)
    step = lambda s, i: F.struct(
        F.when(i % 2 == 0, (s["l"] + _hash(key, tag, n, i, s["r"])) % a).otherwise(s["l"]).alias("l"),
        F.when(i % 2 == 1, (s["r"] + _hash(key, tag, n, i, s["l"])) % b).otherwise(s["r"]).alias("r"),
    )
    start = F.struct(F.substring(payload, F.lit(1), n - low).cast(LONG).alias("l"), F.substring(payload, n - low + 1, low).cast(LONG).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: F.concat(_padded(s["l"], n - low), _padded(s["r"], low)))


def _with_check(payload: Column) -> Column:
    # Bound to a variable, so that the network isn't worked out for each digit again.
    return F.element_at(F.transform(F.array(payload), lambda p: F.concat(p, luhn_digit(p))), 1)


def key_of(spark: SparkSession) -> str:
    """The session's key: KEY_SETTING; where it is unset a random one is drawn, once, and kept in the session.

    Pseudonyms are linked across runs only where the setting is given; nobody can undo them without the key.
    """
    if not (key := spark.conf.get(KEY_SETTING, None)):
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key


def pseudonymised(docs: DataFrame, key: str, text: str = "text", n_found: str = "n_found") -> DataFrame:
    """`docs` with pseudonyms in `text` and `n_found`, int, the number of values replaced.

    Null texts stay null and count 0, as do empty ones. Texts without valid values stay byte for byte. Repeated rows
    are treated alike; an empty table stays empty. Other columns stay; one named as `n_found` is replaced.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    m = F.when(F.col(text).rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    names = [c for c in docs.columns if c != n_found]
    found = docs.select(*names, m.alias("__m"))
    mapped = found.select(*names, "__m", F.when(F.size("__m") > 0, F.transform("__m", lambda x: pseudonym(x, key))).alias("__p"))
    n = F.coalesce(F.size(F.filter("__p", lambda x: x.isNotNull())), F.lit(0))
    whole = F.zip_with("__m", "__p", lambda a, b: F.coalesce(b, a))
    between = F.split(F.col(text), ANY, -1)
    joined = F.array_join(F.zip_with(between, whole, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    new = F.when(F.exists("__p", lambda x: x.isNotNull()), joined).otherwise(F.col(text))
    return mapped.select(*(new.alias(text) if c == text else F.col(c) for c in names), n.cast("int").alias(n_found))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), key_of(spark))


QUERIES = {"op5_pii": op5_pii}
