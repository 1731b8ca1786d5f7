"""Operator 3, personal data: candidates, boosted trees and calibrated redaction, in DataFrame functions alone.

Base spans are the matches of four patterns (email, ip, card, phone) that pass their checks.  High-recall generators propose further
candidates, which may overlap each other and base spans.  A candidate is described by small integers (FEATURES): its format (length, digits, groups,
letters, check digit, ...) and its context (the characters and the key word before it).

The trees learn from PLANTED labelled examples, a documented bound: formats made from templates (see formats()), personal and harmless ones, set into
slices of at most CONTEXTS documents.  Candidates on a personal format, and those of the slices that touch a base span, are positive; candidates on a harmless
format are negative, and so are the other candidates of the slices, which are unlabelled, unless a first fit finds them likely personal.  Spark counts the examples by features; trees boosted on these
counts are compiled into a column expression.  On the fifth of the examples that no tree saw, scores are calibrated for each kind
(pool adjacent violators); candidates whose calibrated share of positives reaches PRECISION are redacted besides the base spans.  Nothing depends on the size of the corpus.

Positions count code points.  They come from splitting a text at its matches; running sums are taken, and spans and
pieces put together, in blocks of about the square root of their number; base spans that touch a candidate are found by halving.  So a text with very many matches doesn't cost its square.

Edge cases: null text is empty; empty texts have no spans; overlapping candidates give one span, the earliest; repeated rows are judged each; an empty
table gives no rows; other columns pass through redacted() and are ignored else.
"""

from __future__ import annotations

import math
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as c

#: The kinds in their order, and their patterns. Guards and possessive quantifiers only keep matching linear.
KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HINT = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Generators of candidates: (kind of the span, pattern, what a text must hold for it).
GENERATORS = (
    ("email", r"(?:(?<![^\s@])|\G)[^\s@]++@[^\s@]++", "@"),
    ("email", r"(?i)(?:(?<![A-Za-z0-9._%+-])|\G)[a-z0-9._%+-]++(?:\x20?[\[(]\x20?at\x20?[\])]\x20?|\x20at\x20)[a-z0-9-]++(?:(?:\x20?[\[(]\x20?dot\x20?[\])]\x20?|\x20dot\x20|\.)[a-z0-9-]++)++", r"(?i)[\x20(\[]at[\x20)\]]"),
    ("phone", r"[+(0-9](?:[\x20().+/-]{0,2}[0-9]){6,18}(?![0-9])", r"[0-9].{0,2}[0-9]"),
    ("ip", r"(?:(?<![0-9.])|\G)[0-9]++(?:\.[0-9]++){2,}+", r"[0-9]\.[0-9]"),
    ("secret", r"(?:(?<![A-Za-z0-9+/_-])|\G)(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{12,}+={0,2}", r"[A-Za-z0-9+/_-]{12}"),
    ("id", r"(?:(?<![A-Za-z0-9])|\G)[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}"),
)
ORDER = (*KINDS, "secret", "id")
FEATURES = ("kind", "generator", "length", "digits", "letters", "others", "groups", "run", "first", "last", "plus", "case", "hex", "turns", "check", "octets", "ending", "spelt", "before", "after", "word")
#: Key words before a candidate, by what they speak for.
KEY_WORDS = (r"token|passw(?:or)?d|passwd|pwd|secret|api.?key|access.?key|auth|bearer|key", r"tel|phone|call|fax|mobile|ring|contact", r"e-?mail|mail|write", r"card|account|iban|ssn|social|visa|passport", r"commit|sha[0-9]*|md5|checksum|hash|etag|isbn|version|rev|order|no|nr|id|date|page|file")
PLANTED, CONTEXTS = 12_000, 2000
PRECISION, ROUNDS, RATE, DEPTH = 0.95, 32, 0.3, 4
SPAN = "array<struct<kind:int,start:int,end:int>>"


def _matches(text: Column, pattern: str) -> tuple[Column, Column]:
    """(matches, the text's pieces around them)."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)


def _in_blocks(items: str) -> Column:
    """An array as arrays of about the square root of its size. By name: a column used more than once isn't computed again inside a lambda."""
    n = F.size(items)
    step = F.greatest(F.lit(1), F.ceil(F.sqrt(n)).cast("int"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), ((n - 1) / step).cast("int")), lambda b: F.slice(items, b * step + 1, step)))


def _starts(df: DataFrame, found: str, pieces: str, out: str) -> DataFrame:
    """Adds `out`: the code point each of `found` starts at. The last piece follows the last match."""
    long = lambda x: F.coalesce(F.length(x), F.lit(0))
    df = df.withColumn("_lengths", F.zip_with(found, F.slice(pieces, 1, F.size(found)), lambda m, p: F.struct(long(m).alias("match"), long(p).alias("piece"))))
    begin = lambda at: F.struct(at.alias("at"), F.array().cast("array<int>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["piece"]
        return F.struct((start + x["match"]).alias("at"), F.concat(acc["out"], F.array(start)).alias("out"))

    def block(done: Column, lengths: Column) -> Column:
        return F.concat(done, F.array(F.aggregate(lengths, begin(F.coalesce(F.get(done, F.size(done) - 1)["at"], F.lit(0))), add)))

    df = df.withColumn("_blocks", _in_blocks("_lengths"))
    sums = F.aggregate("_blocks", F.array().cast("array<struct<at:int,out:array<int>>>"), block)
    return df.withColumn(out, F.flatten(F.transform(sums, lambda b: b["out"]))).drop("_lengths", "_blocks")


def _holds(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = r"0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    return F.length(digits).between(8, 15)


def _span(i: int, kind: str, m: Column, s: Column) -> Column:
    return F.when(_holds(kind, m), F.struct(F.lit(i).alias("kind"), s.cast("int").alias("start"), (s + F.length(m)).cast("int").alias("end")))


def with_base(df: DataFrame, text: str) -> DataFrame:
    """Adds base_email .. base_phone (spans of each kind) and `base`, all of them."""
    for i, kind in enumerate(KINDS):
        matches, pieces = _matches(F.col(text), BASE[kind])
        hint = F.col(text).rlike("[0-9]{2}|[0-9][ -][0-9]") if HINT[kind] is None else F.contains(text, F.lit(HINT[kind]))
        holds = partial(_holds, kind)
        df = df.withColumn("_m", F.when(hint, matches)).withColumn("_m", F.when(F.exists("_m", lambda m: holds(m)), F.col("_m")))  # noqa: PLW0108, B023
        df = _starts(df.withColumn("_p", F.when(F.size("_m") > 0, pieces)), "_m", "_p", "_s")
        span = partial(_span, i, kind)
        spans = F.array_compact(F.zip_with("_m", "_s", lambda m, s: span(m, s)))  # noqa: PLW0108, B023
        df = df.withColumn(f"base_{kind}", F.coalesce(spans, F.array().cast(SPAN))).drop("_m", "_p", "_s")
    return df.withColumn("base", F.concat(*(f"base_{k}" for k in KINDS)))


def _class(x: Column) -> Column:
    return F.when(x == "", 0).when(x.rlike(r"^\s"), 1).when(x.rlike("^[0-9]"), 2).when(x.rlike(r"^\p{L}"), 3).when(x.rlike(r"^[.,;:!?)\"']"), 4).when(x.rlike("^[=/@#_-]"), 5).otherwise(6)


def with_candidates(df: DataFrame, text: str) -> DataFrame:
    """Adds `candidates`: start, end, touches (a base span) and FEATURES."""
    for g, (name, pattern, hint) in enumerate(GENERATORS):
        matches, pieces = _matches(F.col(text), pattern)
        df = df.withColumn("_m", F.when(F.contains(text, F.lit(hint)) if hint == "@" else F.col(text).rlike(hint), matches))
        df = _starts(df.withColumn("_p", F.when(F.size("_m") > 0, pieces)), "_m", "_p", "_s")
        at = F.arrays_zip(F.col("_m").alias("m"), F.col("_s").alias("s"), F.slice("_p", 1, F.size("_m")).alias("b"), F.slice("_p", 2, F.size("_m")).alias("a"))
        df = df.withColumn(f"_c{g}", F.transform(at, partial(_describe, g, name))).drop("_m", "_p", "_s")
    every = F.flatten(F.array_compact(F.array(*(f"_c{g}" for g in range(len(GENERATORS))))))
    return df.withColumn("candidates", every).drop(*(f"_c{g}" for g in range(len(GENERATORS))))


def _touches(start: Column, end: Column) -> Column:
    """Whether a base span shares a code point. Spans of one kind rise and don't overlap: the first that ends behind `start` is found by halving."""

    def found(kind: str) -> Column:
        spans = F.col(f"base_{kind}")

        def halve(x: Column, _: Column) -> Column:
            middle = F.shiftright(x["low"] + x["high"], 1)
            behind = F.get(spans, middle)["end"] > start
            return F.when(x["low"] >= x["high"], x).when(behind, F.struct(x["low"].alias("low"), middle.alias("high"))).otherwise(F.struct((middle + 1).alias("low"), x["high"].alias("high")))

        steps = F.sequence(F.lit(1), F.length(F.bin(F.size(spans))))
        at = F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.size(spans).alias("high")), halve, lambda x: x["low"])
        return (F.size(spans) > 0) & F.coalesce(F.get(spans, at)["start"] < end, F.lit(False))

    return found("email") | found("ip") | found("card") | found("phone")


PIECE = "struct<from:int,start:int,end:int,kind:int>"


def _chain(blocks: str, grow: bool = False) -> Column:
    """Of blocks of spans (start, end, kind; rising by start) those that begin at or behind the end so far, kept in their blocks: of each block `at`, the end after it,
    and `out`, the spans with the end before them as `from`. grow: a span left out may move the end. Each block is put together apart, so no long array is copied for every span."""
    begin = lambda at: F.struct(at.alias("at"), F.array().cast(f"array<{PIECE}>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        piece = F.struct(acc["at"].alias("from"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))
        left = F.struct(F.greatest(acc["at"], x["end"]).alias("at"), acc["out"].alias("out")) if grow else acc
        return F.when(x["start"] >= acc["at"], F.struct(x["end"].alias("at"), F.concat(acc["out"], F.array(piece)).alias("out"))).otherwise(left)

    def block(done: Column, spans: Column) -> Column:
        return F.concat(done, F.array(F.aggregate(spans, begin(F.coalesce(F.get(done, F.size(done) - 1)["at"], F.lit(0))), add)))

    return F.aggregate(blocks, F.array().cast(f"array<struct<at:int,out:array<{PIECE}>>>"), block)


def _describe(g: int, name: str, x: Column) -> Column:
    m, start = x["m"], x["s"].cast("int")
    end, size = start + F.length(m), F.length(m)
    number = F.regexp_replace(m, "[^0-9]", "")
    digits, letters = F.length(number), size - F.length(F.regexp_replace(m, r"\p{L}", ""))
    parts = F.split(m, "[^0-9]+")
    before = F.right(x["b"], F.lit(24))
    lead = F.lower(F.regexp_extract(before, r"(\p{L}[\p{L}0-9_.-]*)[\s\"'=:#.]*$", 1))
    word = F.lit(0)
    for i, words in reversed(list(enumerate(KEY_WORDS, 1))):
        word = F.when(lead.rlike(rf"(?:^|[_.-])(?:{words})s?$"), i).otherwise(word)
    check = F.when(digits.between(13, 19), F.when(F.call_function("luhn_check", number), 1).otherwise(2)).otherwise(0)
    octets = F.when(m.rlike(r"^[0-9]+(?:\.[0-9]+){3}$"), F.when(_holds("ip", m), 1).otherwise(2)).otherwise(0)
    kind = F.lit(ORDER.index(name))
    if name == "phone":
        kind = F.when(m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), ORDER.index("id")).when((digits >= 15) & (check == 1) | (digits >= 16), ORDER.index("card")).otherwise(kind)
    values = {
        "kind": kind, "generator": F.lit(g), "length": F.least(size, F.lit(48)), "digits": F.least(digits, F.lit(24)), "letters": F.least(letters, F.lit(24)),
        "others": F.least(size - digits - letters, F.lit(8)), "groups": F.least(F.size(F.filter(parts, lambda p: p != "")), F.lit(10)),
        "run": F.least(F.coalesce(F.array_max(F.transform(parts, lambda p: F.length(p))), F.lit(0)), F.lit(20)),  # noqa: PLW0108
        "first": F.least(F.length(F.regexp_extract(m, "^[^0-9]*([0-9]+)", 1)), F.lit(8)), "last": F.least(F.length(F.regexp_extract(m, "([0-9]+)[^0-9]*$", 1)), F.lit(8)),
        "plus": F.when(F.startswith(m, F.lit("+")), 1).when(F.startswith(m, F.lit("(")), 2).when(F.startswith(m, F.lit("0")), 3).otherwise(0),
        "case": m.rlike("[A-Z]").cast("int") + 2 * m.rlike("[a-z]").cast("int"), "hex": m.rlike("^[0-9a-fA-F]+$").cast("int"),
        "turns": F.least(F.regexp_count(m, F.lit("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])")), F.lit(12)), "check": check, "octets": octets,
        "ending": F.when(m.rlike(r"[.\x20)\]][a-z]{2,4}$"), 1).when(m.rlike(r"[.\x20)\]][A-Za-z]{5,}$"), 2).otherwise(0),
        "spelt": m.rlike(r"(?i)[\[(]\x20?at|at\x20?[\])]").cast("int") + 2 * m.rlike(r"(?i)[\x20(\[]dot[\x20)\]]").cast("int"),
        "before": _class(F.right(before, F.lit(1))), "after": _class(F.left(x["a"], F.lit(1))), "word": word,
    }
    return F.struct(start.alias("start"), end.alias("end"), _touches(start, end).alias("touches"), *(values[f].cast("int").alias(f) for f in FEATURES))


def formats() -> list[tuple[int, str, str]]:
    """(1 if personal else 0, what stands before it, format) of each template, as SQL over the number in column n."""
    q = lambda x: "'" + str(x) + "'"
    j = lambda *of: f"concat({', '.join(of)})"
    joined = lambda sep, *of: f"concat_ws({q(sep)}, {', '.join(of)})"
    part = lambda x, at, n: f"substring({x}, {at}, {n})"
    made = lambda salt: f"sha2(concat(n, ':{salt}'), 256)"
    some = lambda salt, low, high: f"(pmod(xxhash64(n, '{salt}'), {high - low + 1}) + {low})"
    pick = lambda salt, *of: f"element_at(array({', '.join(q(x) for x in of)}), CAST({some('pick' + salt, 1, len(of))} AS INT))"
    d = lambda n, salt: part(f"translate({made(salt)}, 'abcdef', '374915')", 1, n)
    w = lambda salt: part(f"translate({made(salt)}, '0123456789', 'ghinorstul')", 1, f"CAST({some(f'w{salt}', 3, 9)} AS INT)")
    hexed = lambda low, high, salt="x": part(made(salt), 1, f"CAST({some(f'h{salt}', low, high)} AS INT)")
    code = lambda low, high: part(f"translate(base64(unhex({made('c')})), '+/=', 'kQ7')", 1, f"CAST({some('c', low, high)} AS INT)")
    luhn = lambda body: f"concat({body}, element_at(filter(array({', '.join(q(i) for i in range(10))}), x -> luhn_check(concat({body}, x))), 1))"
    off = lambda x: j(part(x, 1, 15), f"translate({part(x, 16, 1)}, '0123456789', '1234567890')")
    spaced = lambda x, sep: joined(sep, *(part(x, i, 4) for i in (1, 5, 9, 13)))
    octet, year = lambda salt: f"CAST({some(f'o{salt}', 0, 255)} AS STRING)", lambda salt: f"CAST({some(f'y{salt}', 1950, 2030)} AS STRING)"
    two = lambda salt, high: f"lpad(CAST({some(f't{salt}', 1, high)} AS STRING), 2, '0')"
    none, card, amex, number = q(""), luhn(d(15, "b")), luhn(d(14, "e")), d(16, "a")
    top, ending = pick("top", "com", "org", "net", "de", "fr", "co.uk", "example.com"), pick("end", "com", "org", "net")
    at, dot = pick("at", " at ", " (at) ", " [at] ", "(at)", "[at]", " AT "), pick("dot", " dot ", " (dot) ", " [dot] ", "[dot]", "(dot)")
    mail, call, ring = pick("mail", "mail ", "e-mail: ", "write to ", "", ""), pick("call", "call ", "Tel: ", "phone ", "mobile: ", "fax ", "", "", "tel. "), pick("ring", "call ", "Tel: ", "phone ", "mobile: ")
    pay, iban, ssn = pick("pay", "card ", "Visa: ", "account ", "", "card no. "), pick("iban", "IBAN ", "account ", ""), pick("ssn", "SSN ", "ssn: ", "", "")
    key = pick("key", 'token = "', "token: ", "password=", "password: ", "api_key=", 'secret = "', "AWS_SECRET_ACCESS_KEY=", "Authorization: Bearer ", "pwd=")
    land, on, order = pick("land", "DE", "FR", "GB", "ES"), pick("on", "on ", "date: ", ""), pick("order", "order ", "No. ", "id ", "page ", "")
    space, dash, point, slash, line, colon = map(q, (" ", "-", ".", "/", "_", ":"))
    sep = pick("sep", ".", "/", "-")
    return [
        (1, mail, j(w(1), at, w(2), dot, top)), (1, mail, j(w(1), point, w(3), at, w(2), point, top)), (1, mail, j(w(1), d(2, "m"), at, w(2), dot, w(4), dot, ending)), (1, mail, j(w(1), q("@"), w(2), dot, top)), (1, mail, j(w(1), q("@"), w(2), point, top)),
        (1, call, j(q("("), d(3, 1), q(") "), d(3, 2), dash, d(4, 3))), (1, call, j(d(3, 1), dash, d(3, 2), dash, d(4, 3))), (1, call, j(d(3, 1), point, d(3, 2), point, d(4, 3))), (1, call, j(d(3, 1), space, d(3, 2), space, d(4, 3))),
        (1, call, j(q("0"), d(3, 1), space, d(3, 2), space, d(4, 3))), (1, call, j(q("0"), d(2, 1), slash, d(7, 2))), (1, call, j(q("00"), d(2, 1), space, d(3, 2), space, d(7, 3))), (1, ring, d(10, 1)), (1, call, j(q("+"), d(2, 1), space, d(3, 2), space, d(6, 3))),
        (1, none, joined(".", octet(1), octet(2), octet(3), octet(4))), (1, pay, card), (1, pay, spaced(card, ".")), (1, pay, spaced(card, "  ")), (1, pay, joined(" ", part(amex, 1, 4), part(amex, 5, 6), part(amex, 11, 5))),
        (1, key, hexed(32, 40)), (1, key, hexed(14, 24)), (1, key, code(16, 40)), (1, key, code(24, 43)), (1, none, j(pick("aws", "AKIA", "ASIA"), f"upper({code(16, 16)})")), (1, none, j(pick("pre", "sk_live_", "ghp_", "xoxb-", "pk_test_"), code(24, 36))), (1, none, code(36, 43)),
        (1, ssn, joined("-", d(3, 1), d(2, 2), d(4, 3))), (1, iban, j(land, d(2, 1), space, spaced(number, " "))), (1, iban, j(land, d(2, 1), d(18, 2))),
        (0, none, j(year(1), dash, two(1, 12), dash, two(2, 28), space, two(3, 24), colon, two(4, 59), colon, two(5, 59))), (0, on, j(two(1, 28), sep, two(2, 12), sep, year(1), space, two(3, 24), point, two(4, 59))), (0, on, j(year(1), two(1, 12), two(2, 28))),
        (0, none, j(year(1), dash, year(2), pick("gap", " ", ", "), year(3), dash, year(4))), (0, none, joined(" ", *(two(i, 60) for i in range(6)))), (0, none, joined(" ", d(1, 1), d(3, 2), d(3, 3), d(3, 4))), (0, none, j(d(16, 1), space, d(14, 2))), (0, none, joined(" ", d(7, 1), d(9, 2), d(8, 3), d(6, 4))),
        (0, order, d(8, 1)), (0, order, d(12, 1)), (0, none, j(d(1, 1), point, d(9, 2))), (0, none, j(d(2, 1), q(","), d(3, 2), point, d(2, 3))), (0, pick("isbn", "ISBN ", "isbn: ", ""), joined("-", q("978"), d(1, 1), d(2, 2), d(6, 3), d(1, 4))),
        (0, pay, off(card)), (0, pick("z", "", "id "), spaced(off(card), " ")), (0, none, spaced(off(card), "-")),
        (0, pick("v", "version ", "v", "", "section "), joined(".", d(1, 1), d(2, 2), d(1, 3))), (0, none, joined(".", j(q(4), d(2, 1)), j(q(3), d(2, 2)), j(q(7), d(2, 3)), j(q(2), d(2, 4)))), (0, none, joined(".", d(1, 1), d(1, 2), d(2, 3), d(1, 4), d(1, 5))),
        (0, pick("sha", "commit ", "sha256:", "sha1 ", "md5 ", "checksum ", "etag "), hexed(32, 64)), (0, pick("uu", "", "id "), joined("-", hexed(8, 8, 1), hexed(4, 4, 2), hexed(4, 4, 3), hexed(4, 4, 4), hexed(12, 12, 5))),
        (0, none, joined("-", w(1), w(2), year(1), w(3))), (0, none, j(w(1), w(2), d(2, 1), w(3), w(4))), (0, none, joined("/", w(1), w(2), year(1), w(3))), (0, pick("f", "", "file "), joined("_", w(1), w(2), d(3, 1), w(3))), (0, none, j(q("chapter"), d(2, 1), w(1), w(2))),
        (0, none, j(w(1), q(" at "), w(2), point, f"initcap({w(3)})")), (0, none, j(w(1), q(" at "), w(2), point, w(3), w(4))), (0, none, j(w(1), q("@"), w(2))), (0, none, j(d(1, 1), q("@"), d(2, 2))),
    ]


def examples(docs: DataFrame, key: str, text: str) -> DataFrame:
    """PLANTED rows (n, good, text, from, to): a format of each template in turn, at from .. to of a slice of a document."""
    place = F.xxhash64(F.col(key).cast("string"), F.length(text))
    begin = F.pmod(place, F.greatest(F.length(text) - 240, F.lit(1))).cast("int") + 1
    share = min(1.0, 4.0 * CONTEXTS / max(1, docs.count()))  # of the hashes, so that no task sorts more than a few thousand slices
    docs = docs.filter(place <= F.lit(int(-(2**63) + share * (2**64 - 1) * (1 - 2**-50)) if share < 1 else 2**63 - 1))
    cut = docs.select(place.alias("place"), F.regexp_replace(F.substring(F.col(text), begin, F.lit(240)), r"^\S*\s|\s\S*$", "").alias("slice")).orderBy("place", "slice").limit(CONTEXTS)
    cut = c.checkpointed(cut.withColumn("at", F.row_number().over(Window.orderBy("place", "slice")) - 1))  # at most CONTEXTS rows
    many = max(1, cut.count())
    out = docs.sparkSession.range(PLANTED).withColumnRenamed("id", "n").withColumn("at", F.col("n") % many).join(F.broadcast(cut), "at", "left")
    made = formats()
    turn = f"CAST(pmod(n, {len(made)}) + 1 AS INT)"
    branch = lambda k: f"element_at(array({', '.join(str(x[k]) for x in made)}), {turn})"
    out = c.checkpointed(out.selectExpr(
        "n", f"{branch(0)} AS good", f"{branch(1)} AS lead", f"{branch(2)} AS item", r"regexp_extract(substring(coalesce(slice, ''), 1, length(slice) div 2), '^((?s).*\\s)?', 1) AS left", "substring(coalesce(slice, ''), length(slice) div 2 + 1) AS right",
    ))
    tail = F.when(F.endswith("lead", F.lit('"')), '"').otherwise(F.element_at(F.array(F.lit(""), F.lit("."), F.lit(",")), F.pmod(F.xxhash64("n"), F.lit(3)).cast("int") + 1))
    begin, left, right = F.length(F.coalesce("left", F.lit(""))) + F.length("lead"), F.coalesce("left", F.lit("")), F.coalesce("right", F.lit(""))
    return out.select("n", "good", F.concat(left, "lead", "item", tail, F.lit(" "), right).alias("text"), begin.alias("from"), (begin + F.length("item")).alias("to"))


def cells(df: DataFrame) -> list[tuple[tuple[int, ...], list[int]]]:
    """(features, [fitting: positive, negative; held out: positive, negative; unlabelled]) of the examples' candidates; at most as many as there are candidates in PLANTED short texts."""
    over = lambda x: F.least(x["end"], F.col("to")) - F.greatest(x["start"], F.col("from"))
    label = lambda x: F.when(over(x) <= 0, F.when(x["touches"], 1).otherwise(2)).when(over(x) >= 0.8 * (F.col("to") - F.col("from")), F.col("good")).otherwise(-1)
    # As arrays of numbers: of structs the optimizer would explode each field on its own, and find the candidates as many times.
    each = df.select((F.pmod(F.xxhash64("n"), F.lit(5)) == 0).cast("int").alias("held"), F.explode(F.transform("candidates", lambda x: F.array(label(x), *(x[f] for f in FEATURES)))).alias("x"))
    each = each.select("held", F.get("x", F.lit(0)).alias("label"), F.slice("x", 2, len(FEATURES)).alias("features")).filter("label >= 0")
    count = lambda h, t: F.sum(F.when((F.col("held") == h) & (F.col("label") == t), 1).otherwise(0))
    got = each.groupBy("features").agg(count(0, 1).alias("a"), count(0, 0).alias("b"), count(1, 1).alias("d"), count(1, 0).alias("e"), count(0, 2).alias("u"))
    return sorted((tuple(r.features), [r.a, r.b, r.d, r.e, r.u]) for r in got.collect())


def boost(table: list[tuple[tuple[int, ...], list[int]]], rounds: int = ROUNDS, rate: float = RATE) -> tuple[list, float]:
    """(trees, bias) by Newton steps on the logistic loss. A tree is (feature, below, left, right) or a leaf's number."""
    positive, negative = sum(n[0] for _, n in table), sum(n[1] for _, n in table)
    bias = math.log((positive + 1) / (negative + 1))
    score, trees = [bias] * len(table), []
    seen = [i for i, (_, n) in enumerate(table) if n[0] + n[1]]
    width = len(table[0][0]) if table else 0

    def grow(rows: list[int], depth: int):
        all_g, all_h = sum(g[i] for i in rows), sum(h[i] for i in rows)
        best = (1e-6, None, None)
        for f in range(width) if depth else ():
            by: dict[int, list[float]] = {}
            for i in rows:
                x = by.setdefault(table[i][0][f], [0.0, 0.0])
                x[0] += g[i]
                x[1] += h[i]
            left_g = left_h = 0.0
            values = sorted(by)
            for low, high in zip(values, values[1:], strict=False):
                left_g += by[low][0]
                left_h += by[low][1]
                gain = left_g**2 / (left_h + 1) + (all_g - left_g) ** 2 / (all_h - left_h + 1) - all_g**2 / (all_h + 1)
                if gain > best[0]:
                    best = (gain, f, high)
        if best[1] is None:
            step = rate * all_g / (all_h + 1)
            for i in rows:
                score[i] = max(-30.0, min(30.0, score[i] + step))
            return step
        _, f, high = best
        return f, high, grow([i for i in rows if table[i][0][f] < high], depth - 1), grow([i for i in rows if table[i][0][f] >= high], depth - 1)

    for _ in range(rounds if positive and negative else 0):
        p = [1 / (1 + math.exp(-x)) for x in score]
        n = [sum(x[:2]) for _, x in table]
        g, h = [table[i][1][0] - n[i] * p[i] for i in range(len(table))], [n[i] * p[i] * (1 - p[i]) for i in range(len(table))]
        trees.append(grow(seen, DEPTH))
    return trees, bias


def value(tree, features: tuple[int, ...]) -> float:
    while isinstance(tree, tuple):
        f, below, left, right = tree
        tree = left if features[f] < below else right
    return tree


def calibrated(table, trees, bias, precision: float = PRECISION) -> float:
    """The lowest score from which on the held-out share of positives reaches `precision`, by pool-adjacent-violators; inf if there is none. A pool counts one negative more than it has."""
    scored: dict[float, list[int]] = {}
    for f, n in table:
        at = scored.setdefault(round(bias + sum(value(t, f) for t in trees), 9), [0, 0])
        at[0] += n[2]
        at[1] += n[3]
    pools: list[list[float]] = []
    for s in sorted(s for s, n in scored.items() if sum(n)):
        pools.append([s, *scored[s]])
        while len(pools) > 1 and pools[-2][1] * (pools[-1][1] + pools[-1][2]) >= pools[-1][1] * (pools[-2][1] + pools[-2][2]):
            _, a, b = pools.pop()
            pools[-1][1] += a
            pools[-1][2] += b
    cut, a, b = math.inf, 0.0, 1.0
    for s, x, y in reversed(pools):
        a, b = a + x, b + y
        if x < precision * (x + y):
            break
        if a >= precision * (a + b):
            cut = s
    return cut


def compiled(tree) -> str:
    """The tree as SQL over the candidate x."""
    if not isinstance(tree, tuple):
        return f"{tree!r}D"
    f, below, left, right = tree
    return f"CASE WHEN x.{FEATURES[f]} < {below} THEN {compiled(left)} ELSE {compiled(right)} END"


def fit(docs: DataFrame, key: str, text: str, precision: float = PRECISION) -> tuple[list, float, list[float]]:
    """(trees, bias, the least score of each kind of ORDER), from examples in slices of docs.

    Two steps, as the slices hold personal data themselves: trees that take all unlabelled candidates for negative tell which of them are reliably so, and only those are in the second fit."""
    table = cells(with_candidates(with_base(examples(docs, key, text), "text"), "text"))
    counted = lambda use: [(f, [n[0], n[1] + (n[4] if use(f) else 0), *n[2:4]]) for f, n in table]
    trees, bias = boost(counted(lambda f: True), ROUNDS // 2)
    trees, bias = boost(table := counted(lambda f: bias + sum(value(t, f) for t in trees) < 0))
    return trees, bias, [calibrated([x for x in table if x[0][0] == k], trees, bias, precision) for k in range(len(ORDER))]


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text", precision: float = PRECISION, model: tuple | None = None) -> DataFrame:
    """docs with base_email .. base_phone, base and `spans` added: arrays of (kind: place in ORDER, start, end), by kind and start. model: of fit()."""
    clash = {f"base_{k}" for k in KINDS} | {"base", "spans", "candidates", "_text", "_picked", "_blocks", "_added"}
    docs = docs.drop(*(clash & set(docs.columns) - {key, text})).withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    trees, bias, cuts = model or fit(docs, key, "_text", precision)
    found = with_candidates(with_base(docs, "_text"), "_text")
    kept = {k: x for k, x in enumerate(cuts) if math.isfinite(x)}
    enough = "CASE x.kind " + " ".join(f"WHEN {k} THEN {x - 1e-6!r}D" for k, x in kept.items()) + " END"
    score = " + ".join([f"{bias!r}D", *map(compiled, trees)])
    by_start = "x -> named_struct('start', x.start, 'back', -x.end, 'generator', x.generator, 'kind', x.kind)"  # of alike spans the first generator's
    none = "CAST(array() AS array<struct<start:int,back:int,generator:int,kind:int>>)"
    picked = F.array_sort(F.expr(f"transform(filter(candidates, x -> NOT x.touches AND {score} >= {enough}), {by_start})" if kept else none))
    found = found.withColumn("_picked", picked).withColumn("_picked", F.transform("_picked", lambda x: F.struct(x["start"].alias("start"), (-x["back"]).alias("end"), x["kind"].alias("kind"))))
    found = found.withColumn("_blocks", _in_blocks("_picked")).withColumn("_added", F.coalesce(F.flatten(F.transform(_chain("_blocks"), lambda b: b["out"])), F.array().cast(f"array<{PIECE}>")))
    added = F.transform("_added", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return found.withColumn("spans", F.array_sort(F.concat("base", added))).drop("candidates", "_text", "_picked", "_blocks", "_added")


def written(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, ORDER))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(docs: DataFrame, key: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """docs with each span of the text replaced by its kind in brackets; overlapping spans by that of the first."""
    columns = docs.columns
    docs = docs.toDF(*(n if n in (key, text) else f"_kept_{i}" for i, n in enumerate(columns)))  # columns of any name pass through
    found = personal_data(docs, key, text, **more)
    order = F.array_sort(F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    names = F.array(*map(F.lit, ORDER))
    found = found.withColumn("_order", order).withColumn("_blocks", _in_blocks("_order")).withColumn("_chain", _chain("_blocks", grow=True))

    def block(b: Column) -> Column:
        """The block's pieces, cut from the part of the text it spans."""
        since = b["out"][0]["from"]
        text_of = F.substring(F.col(text), since + 1, F.get(b["out"], F.size(b["out"]) - 1)["start"] - since)
        cut = F.transform(F.arrays_zip(F.array_repeat(F.struct(text_of.alias("t"), since.alias("s")), F.lit(1)).alias("p")), lambda p: F.array_join(F.transform(b["out"], lambda x: F.concat(F.substring(p["p"]["t"], x["from"] - p["p"]["s"] + 1, x["start"] - x["from"]), F.lit("["), F.upper(F.get(names, x["kind"])), F.lit("]"))), ""))  # evaluated once a block
        return F.when(F.size(b["out"]) > 0, F.get(cut, F.lit(0))).otherwise("")

    tail = F.substring(F.col(text), F.get("_chain", F.size("_chain") - 1)["at"] + 1, F.length(text))
    out = F.concat(F.array_join(F.transform("_chain", block), ""), tail)
    return found.withColumn(text, F.when(F.size("_blocks") > 0, out).otherwise(F.col(text))).select(*docs.columns).toDF(*columns)


def op3_personal_data(spark, sf_dir: str) -> DataFrame:
    found = personal_data(c.table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(F.encode(written("base"), "UTF-8"), 256).alias("base_sha256"), written("spans").alias("spans"))
