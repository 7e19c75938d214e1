"""PII: format-preserving Feistel pseudonyms, in DataFrame functions alone.

One pattern finds candidates; a candidate counts only if its kind's check holds (Luhn sum of card
numbers, octets of addresses, calendar of dates). A value is replaced by its image under a keyed
permutation of its own format: the value is cut in two, and in each round the characters of one
half move within their own alphabet by amounts drawn from SHA-256 over the key, the kind, the
round and the other half. Such rounds can be undone with the key, and equal values have equal
images in every document. Card numbers get a new valid check digit, IPv4 addresses are permuted as
32 bits, dates as days of two centuries (walking on until the image is a day of them), phone
numbers keep country code and punctuation, mail addresses their domain, hexadecimal secrets their
alphabet and case.

Everything happens row by row: no shuffle, and nothing is gathered. Who has the key can undo every
pseudonym, so it comes from the session (`spark.ledgerloom.pii.key`) or the caller, and there is none by default.

Groups of three, two and four digits count as SSN without a check of their ranges, so that images are again of the kind.

Defined cases: null text stays null with no finds; empty text stays empty; texts of any length are
read whole, in time that grows with them, whatever the length of their words; of kinds that match at the same place the first of KINDS counts; repeated rows give
repeated rows; a null doc_id stays null; empty tables give empty results; further columns, whatever
their names, are ignored by the query and kept by pseudonymise().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents

ROUNDS = 8
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PLAIN, HEX = (DIGITS, LOWER, UPPER), ("0123456789abcdef",)
#: Kinds in the order in which the pattern tries them.
KINDS = [
    # of a longer word before the @ the last 64 letters count, as many as an address may have; domains are as long as names of hosts may be
    ("email", r"[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,126}[A-Za-z]{2,63}"),
    ("ip", r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"),
    ("secret", r"(?<![0-9A-Za-z])(?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{32,64}(?![0-9A-Za-z])|(?<![0-9A-Za-z])(?=[A-F]*[0-9])(?=[0-9]*[A-F])[0-9A-F]{32,64}(?![0-9A-Za-z])"),
    ("card", r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{1,7}|[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{1,7}|3[0-9]{3} [0-9]{6} [0-9]{5})(?![0-9])"),
    ("date", r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("phone", r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{3})[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])|\+[0-9]{8,15}(?![0-9])"),
]
PATTERN = "|".join(f"(?:{p})" for _, p in KINDS)
FIRST_DAY, DAYS = "1900-01-01", 73_049
KEY_SETTING, TEST_KEY = "spark.ledgerloom.pii.key", "not a secret: for tests and the registered query"


def bound(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def moved(half: Column, seed: Column, alphabets: tuple[str, ...], back: bool = False) -> Column:
    """Each character of half moved within its alphabet by the seed's stream; others stay."""
    n = F.length(half)
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(n - 1, F.lit(0)) / 16).cast("int")), lambda b: F.sha2(F.concat(seed, F.lit("|"), b.cast("string")), 256))

    def one(stream: Column) -> Column:
        def step(i: Column) -> Column:
            c = F.substring(half, i + 1, F.lit(1))
            by = F.conv(F.substring(stream, i * 4 + 1, F.lit(4)), 16, 10).cast("int")
            by = -by if back else by
            out = c
            for alphabet in alphabets:
                at = F.instr(F.lit(alphabet), c)
                out = F.when(at > 0, F.substring(F.lit(alphabet), F.pmod(at - 1 + by, F.lit(len(alphabet))) + 1, F.lit(1))).otherwise(out)
            return out

        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), step), "")

    return F.when(n > 0, bound(F.array_join(blocks, ""), one)).otherwise(half)


def permuted(value: Column, key: Column, kind: str, alphabets: tuple[str, ...] = PLAIN, back: bool = False) -> Column:
    """The keyed Feistel permutation of strings of one length and alphabet pattern, or its inverse."""
    half = F.floor(F.length(value) / 2).cast("int")
    left, right = F.substring(value, F.lit(1), half), F.substring(value, half + 1, F.length(value))
    seed = lambda r, other: F.concat(key, F.lit(f"|{kind}|"), r.cast("string"), F.lit("|"), F.length(value).cast("string"), F.lit("|"), other)
    start = F.struct(left.alias("a"), right.alias("b"))
    if back:
        rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1))
        step = lambda s, r: F.struct(moved(s["b"], seed(r, s["a"]), alphabets, True).alias("a"), s["a"].alias("b"))
    else:
        rounds = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
        step = lambda s, r: F.struct(s["b"].alias("a"), moved(s["a"], seed(r, s["b"]), alphabets).alias("b"))
    return F.aggregate(rounds, start, step, lambda s: F.concat(s["a"], s["b"]))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def refilled(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced by those of digits, in order."""
    at = lambda i: F.length(digits_of(F.substring(shape, F.lit(1), i)))
    one = lambda i: F.when(F.substring(shape, i, F.lit(1)).rlike("[0-9]"), F.substring(digits, at(i), F.lit(1))).otherwise(F.substring(shape, i, F.lit(1)))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(shape)), one), "")


def luhn(digits: Column, appended: bool) -> Column:
    """The Luhn sum of digits; appended: as if a check digit 0 followed."""
    n = F.length(digits)

    def add(s: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = (i % 2 == 1) if appended else (i % 2 == 0)
        return s + F.when(twice, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def card(value: Column, key: Column, back: bool) -> Column:
    def image(d: Column) -> Column:
        body = permuted(F.substring(d, F.lit(1), F.length(d) - 1), key, "card", back=back)
        made = bound(body, lambda b: F.concat(b, F.pmod(10 - luhn(b, True) % 10, F.lit(10)).cast("string")))
        return F.when(luhn(d, False) % 10 == 0, refilled(value, made))

    return bound(digits_of(value), image)


def address(value: Column, key: Column, back: bool) -> Column:
    parts = F.transform(F.split(value, r"\."), lambda x: x.cast("int"))
    packed = lambda p: F.lower(F.array_join(F.transform(p, lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")), ""))
    dotted = lambda h: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.conv(F.substring(h, 2 * i + 1, F.lit(2)), 16, 10)), ".")
    return bound(parts, lambda p: F.when(F.forall(p, lambda x: x <= 255), bound(permuted(packed(p), key, "ip", HEX, back), dotted)))


def date(value: Column, key: Column, back: bool) -> Column:
    def image(form: str) -> Column:
        day = F.date_diff(F.try_to_date(value, form), F.lit(FIRST_DAY).cast("date"))
        text = lambda x: F.lpad(x.cast("string"), 5, "0")
        walk = lambda d: F.aggregate(F.sequence(F.lit(1), F.lit(48)), F.lit(-1), lambda s, i: F.when((i > 1) & (s < DAYS), s).otherwise(permuted(text(F.when(i == 1, d).otherwise(s)), key, "date", back=back).cast("int")))
        return F.when((day >= 0) & (day < DAYS), bound(day, lambda d: F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), walk(d)), form)))

    return F.when(value.contains("-"), image("yyyy-MM-dd")).when(value.contains("/"), image("dd/MM/yyyy")).otherwise(image("dd.MM.yyyy"))


def pseudonym(kind: str, value: Column, key: Column, back: bool = False) -> Column:
    """The image of a value of a kind, or its original; null if the value fails the kind's check."""
    if kind == "email":
        at = F.instr(value, "@")
        return F.concat(permuted(F.substring(value, F.lit(1), at - 1), key, kind, back=back), F.substring(value, at, F.length(value)))
    if kind == "secret":
        plain = permuted(F.lower(value), key, kind, HEX, back)
        return F.when(value.rlike("[a-f]"), plain).otherwise(F.upper(plain))
    if kind == "phone":
        d = digits_of(value)
        keep = F.greatest(F.length(d) - 10, F.lit(0))
        image = F.concat(F.substring(d, F.lit(1), keep), permuted(F.substring(d, keep + 1, F.length(d)), key, kind, back=back))
        return bound(image, lambda x: refilled(value, x))
    if kind == "ssn":
        return bound(permuted(digits_of(value), key, kind, back=back), lambda x: refilled(value, x))
    return {"card": card, "ip": address, "date": date}[kind](value, key, back)


def named(kind: str, value: Column):
    return lambda x: F.struct(F.when(x.isNotNull(), F.lit(kind)).alias("kind"), F.coalesce(x, value).alias("image"))


def found(value: Column, key: Column, back: bool = False) -> Column:
    """kind and image of a candidate; kind is null if it fails its check."""
    out = None
    for kind, pattern in KINDS:
        bare = value.rlike(f"^(?:{pattern})$")
        image = bound(pseudonym(kind, value, key, back), named(kind, value))
        out = F.when(bare, image) if out is None else out.when(bare, image)
    return out.otherwise(F.struct(F.lit(None).cast("string").alias("kind"), value.alias("image")))


def session_key(spark: SparkSession) -> str:
    """The key that the session names; without one nothing is pseudonymised."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        raise ValueError(f"set {KEY_SETTING} to a secret key")
    return key


def pseudonymise(docs: DataFrame, key: str | None = None, back: bool = False, kinds: str = "_kinds") -> DataFrame:
    """docs with column text pseudonymised (back: restored) and, last, the kinds found in order, in a column of the given name.

    Without a key the session's is taken. A column of docs that has the name for the kinds gives way to it.
    """
    key = key or session_key(docs.sparkSession)
    text, secret = F.col("text"), F.lit(key)
    hits = F.transform(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), lambda m: found(m, secret, back))

    def rebuilt(h: Column) -> Column:
        parts = F.transform(F.split(text, PATTERN, -1), lambda p, i: F.concat(p, F.coalesce(F.get(h, i)["image"], F.lit(""))))
        return F.struct(F.array_join(parts, "").alias("text"), F.filter(F.transform(h, lambda x: x["kind"]), lambda k: k.isNotNull()).alias("kinds"))

    none = F.struct(text.alias("text"), F.array().cast("array<string>").alias("kinds"))
    columns = [c for c in docs.columns if c != kinds]
    # only `row` and `made` are named here, so that no column of docs is met by one of ours
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.when(text.rlike("[0-9@]"), bound(hits, rebuilt)).otherwise(none).alias("made"))
    return out.select(*[(F.col("made.text") if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in columns], F.col("made.kinds").alias(kinds))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session's key, or, for the registered query alone, a test key that protects nothing."""
    key = spark.conf.get(KEY_SETTING, None) or TEST_KEY
    out = pseudonymise(documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text"), key)
    return out.select("doc_id", "text", F.size("_kinds").cast("long").alias("n_found"), F.array_join(F.array_sort(F.array_distinct("_kinds")), ",").alias("kinds"))
