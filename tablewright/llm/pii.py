"""Personal data, with DataFrame functions alone: patterns propose, checksums
confirm, context words adjust the score.

Java's matcher drives both ``regexp_extract_all`` (what matched) and ``split``
(what lies between), so running sums of the two lists' lengths give every
match's code point offsets.  Patterns are written so that the matcher neither
recurses nor backtracks over long runs: quantifiers are possessive where that
changes nothing, and a match begins at a run's start or where the last match
ended.

No shuffle: one narrow stage over whole texts.

Kinds, in this order: ``email``, ``ip`` (parts at most 255), ``card`` (16 to 19
digits, Luhn), ``phone`` (8 to 15 digits) and, added by this method, ``iban``
(mod 97) and ``secret`` (32 characters or more of a key's alphabet, letters and
digits among them).  A span's score is its kind's, and more where one of the
kind's words is near.  Of the added kinds those with ``LEAST_ADDED`` or more are
reported: an IBAN always, as its checksum confirms it; a secret, which has none,
only with a word for it nearby.    An IBAN has its country's length, so words after it don't matter;
codes of no listed country take the longest run that fits.  Proposals of IBANs
begin at every word, as a failed one may hold the next one's start; of confirmed
ones that overlap the first stays.  Spans of different kinds may overlap; all
are reported.

Defined cases: null and empty texts have no spans; texts of any length are
searched whole (offsets are summed in blocks, so thousands of matches stay
cheap); repeated rows give repeated results; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts

BLOCK = 512
CONTEXT_CHARS = 40
CONTEXT_BONUS = 0.25
LEAST_ADDED = 0.5


#: Lengths of IBANs: the registry of ISO 13616, then countries that use them unregistered.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
UNREGISTERED = {24: "CV DZ", 25: "AO GW MZ", 26: "IR", 27: "CF CG CM GA GQ KM MG TD", 28: "BF BJ CI MA ML NE SN TG"}


def iban_pattern() -> str:
    """The whole proposal is the first group; four characters are consumed."""
    group, known = r"(?:\x20?[A-Z0-9])", []
    ways = []
    for lengths in (IBAN_LENGTHS, UNREGISTERED):
        for n, codes in lengths.items():
            known += codes.split()
            ways.append(f"(?:{codes.replace(' ', '|')})[0-9]{{2}}{group}{{{n - 4}}}")
    ways.append(f"(?!{'|'.join(known)})[A-Z]{{2}}[0-9]{{2}}{group}{{11,30}}")
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?=((?:{'|'.join(ways)})(?![A-Za-z0-9])))[A-Z0-9]{{4}}"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: A literal that every match holds, or None: a cheap test before matching.
    needs: str | None
    score: float
    words: tuple[str, ...]
    #: Where matches are proposals by lookahead, in the first group: how much is consumed.
    consumed: int | None = None


KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.7, ("mail", "contact", "write", "address")),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.5, ("ip", "host", "server", "address", "login")),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", None, 0.6, ("card", "visa", "credit", "payment", "account")),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.5, ("phone", "call", "tel", "mobile", "fax")),
    Kind("iban", iban_pattern(), None, 0.7, ("iban", "bank", "account", "transfer"), 4),
    Kind("secret", r"(?:\G|(?<![A-Za-z0-9_+/-]))[A-Za-z0-9_+/-]{32,}+={0,2}+", None, 0.3, ("token", "secret", "password", "passwd", "api", "key", "auth", "credential")),
)
BASE = ("email", "ip", "card", "phone")
NAMES = tuple(k.name for k in KINDS)
SPAN = "struct<kind:string,start:bigint,end:bigint,score:double>"


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def characters(s: Column) -> Column:
    """The characters of a short string that isn't empty."""
    return F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: s.substr(i, F.lit(1)))


def luhn(number: Column) -> Column:
    """Whether a string of digits passes: from the right, every second digit
    counts double, less nine beyond nine."""
    each = characters(F.reverse(number))
    value = F.transform(each, lambda d, i: F.when(i % 2 == 1, F.when(d >= "5", d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)).otherwise(d.cast("int")))
    return F.aggregate(value, F.lit(0), lambda a, v: a + v) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number passes: country and check digits go last,
    letters count from ten, the number modulo 97 is one."""
    plain = F.replace(account, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 34), F.substring(plain, 1, 4))
    value = lambda c: F.when(c >= "A", F.ascii(c) - 55).otherwise(c.cast("int"))
    return F.aggregate(characters(turned), F.lit(0), lambda a, c: F.when(c >= "A", a * 100 + value(c)).otherwise(a * 10 + value(c)) % 97) == 1


def confirmed(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.substring(F.lpad(F.ltrim(p, F.lit("0")), 3, "0"), 1, 3) <= "255"))
    if kind == "card":
        n = F.length(digits(m))
        return F.when(n.between(16, 19), luhn(digits(m))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits(m)).between(8, 15)
    if kind == "iban":
        return mod97(m)
    if kind == "secret":
        return m.rlike("[0-9]") & m.rlike("[A-Za-z]")
    return F.lit(True)


def running_sums(lengths: str) -> Column:
    """The running sums of an array of bigint, in blocks."""
    inner = f"aggregate(slice({lengths}, b * {BLOCK} + 1, {BLOCK}), named_struct('t', a.t, 'o', cast(array() as array<bigint>)), (c, x) -> named_struct('t', c.t + x, 'o', array_append(c.o, c.t + x)))"
    step = f"element_at(transform(array({inner}), v -> named_struct('t', v.t, 'o', array_append(a.o, v.o))), 1)"
    blocks = f"sequence(0, cast((size({lengths}) - 1) div {BLOCK} as int))"
    return F.expr(f"flatten(aggregate({blocks}, named_struct('t', cast(0 as bigint), 'o', cast(array() as array<array<bigint>>)), (a, b) -> {step}, a -> a.o))")


def consumed(k: Kind, m: Column) -> Column:
    return (F.length(m) if k.consumed is None else F.lit(k.consumed)).cast("bigint")


def apart(spans: Column) -> Column:
    """Of spans by start those that begin after the last one kept."""
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    return F.aggregate(spans, none, lambda a, x: F.when((F.size(a) == 0) | (F.try_element_at(a, F.lit(-1))["end"] <= x["start"]), F.array_append(a, x)).otherwise(a))


def found_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` and ``spans``: an array of kind, start, end, score by
    kind and start."""
    none = F.expr("cast(array() as array<string>)")
    matched = texts(docs)
    for k in KINDS:
        m = F.regexp_extract_all("text", F.lit(k.pattern), F.lit(0 if k.consumed is None else 1))
        matched = matched.withColumn(f"m_{k.name}", F.when(F.contains("text", F.lit(k.needs)), m).otherwise(none) if k.needs else m)
    # Only texts with a match that a checksum may confirm are cut at it.
    cut = matched
    for k in KINDS:
        gaps = F.transform(F.split("text", k.pattern, -1), lambda g: F.length(g).cast("bigint"))
        steps = F.zip_with(gaps, F.transform(f"m_{k.name}", partial(consumed, k)), lambda g, n: g + F.coalesce(n, F.lit(0)))
        cut = cut.withColumn(f"s_{k.name}", F.when(F.exists(f"m_{k.name}", partial(confirmed, k.name)), steps))
    summed = cut
    for k in KINDS:
        summed = summed.withColumn(f"e_{k.name}", F.when(F.col(f"s_{k.name}").isNotNull(), running_sums(f"s_{k.name}")))

    def spans(k: Kind) -> Column:
        ends = F.zip_with(f"m_{k.name}", F.slice(f"e_{k.name}", 1, F.size(f"m_{k.name}")), lambda m, e: F.struct(m.alias("m"), e.alias("e")))
        good = F.filter(ends, lambda x: confirmed(k.name, x["m"]))

        def scored(x: Column) -> Column:
            start = x["e"] - consumed(k, x["m"])
            end = start + F.length(x["m"])
            near = F.lower(F.expr("text").substr(F.greatest(start - CONTEXT_CHARS, F.lit(0)).cast("int") + 1, F.length(x["m"]) + 2 * CONTEXT_CHARS))
            bonus = F.when(near.rlike(r"\b(?:" + "|".join(k.words) + ")"), F.lit(CONTEXT_BONUS)).otherwise(F.lit(0.0))
            return F.struct(F.lit(k.name).alias("kind"), start.alias("start"), end.alias("end"), (F.lit(k.score) + bonus).alias("score"))

        made = F.transform(good, scored)
        if k.name not in BASE:
            made = F.filter(made, lambda s: s["score"] >= LEAST_ADDED)
        return F.when(F.col(f"e_{k.name}").isNotNull(), made if k.consumed is None else apart(made)).otherwise(F.expr(f"cast(array() as array<{SPAN}>)"))

    return summed.select("doc_id", "text", F.concat(*(spans(k) for k in KINDS)).alias("spans"))


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id, spans`` (scored) and the counts by kind ``n_<kind>``."""
    found = found_spans(docs)

    def count(name: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == name)).cast("bigint").alias(f"n_{name}")

    return found.select("doc_id", *map(count, NAMES), "spans")


def redacted(docs: DataFrame, least_score: float = 0.0) -> DataFrame:
    """``docs`` with every span replaced by ``[KIND]`` in ``text``.

    Overlapping spans are replaced as one, by the name of the first.  Texts
    without spans stay as they are, null included; ``n_chars`` follows where
    it was the text's length before."""
    found = found_spans(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc_id"), "text"))
    keep = F.array_sort(F.transform(F.filter("spans", lambda s: s["score"] >= least_score), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    step = F.expr(
        "aggregate(k, named_struct('at', cast(0 as bigint), 'o', cast(array() as array<string>)), (a, s) -> "
        "CASE WHEN s.start >= a.at THEN named_struct('at', -s.back, 'o', concat(a.o, array(substring(text, cast(a.at as int) + 1, cast(s.start - a.at as int)), concat('[', upper(s.kind), ']')))) "
        "ELSE named_struct('at', greatest(a.at, -s.back), 'o', a.o) END, a -> concat(array_join(a.o, ''), substring(text, cast(a.at as int) + 1)))"
    )
    made = found.withColumn("k", keep).select("doc_id", F.when(F.size("k") > 0, step).otherwise(F.col("doc_id.text")).alias("t"))
    out = []
    for c in docs.columns:
        kept = F.col(f"doc_id.`{c}`")
        if c == "text":
            kept = F.col("t")
        elif c == "n_chars":
            kept = F.when(kept == F.length("doc_id.text"), F.length("t").cast(dict(docs.dtypes)[c])).otherwise(kept)
        out.append(kept.alias(c))
    return made.select(*out)
