"""Personal data: regular expressions propose spans, checksums confirm them, context words score them.

DataFrame functions only.  A kind's matches are the leftmost non-overlapping
ones (of `iban`, among those its checksum confirms); their places come from the texts between them (the same expression
splits the text), so offsets are code points without any Python.

The expressions are written without backtracking over long runs: a run of
word characters or digits is entered at its first character only (or where the
last match ended), and repeated groups are possessive, which Java runs as a
loop.  Matches are the same as with the plain forms in the comments.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import id_text

_LOCAL = r"[A-Za-z0-9._%+-]"
#: Length of an account number by country code (IBAN registry).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_LISTED = "|".join(" ".join(IBAN_LENGTHS.values()).split())
#: What follows the first four characters: as much as the country's length, for other codes the whole run.
_IBAN = "(?:" + "|".join([
    *[rf"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}+" for n, codes in IBAN_LENGTHS.items()],
    rf"(?!{_LISTED})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}}+"]) + ")(?![A-Za-z0-9])"
#: kind -> (cheap test that the text can hold one, expression), in the order of kinds.
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": (r"@[A-Za-z0-9-]", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": (r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    # [0-9]([\x20-]?[0-9])+ of 14 to 19 digits: the whole run, or nothing of it
    "card": (r"[0-9](?:[\x20-]?[0-9]){13}",
             r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"),
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
    "iban": (r"[A-Z]{2}[0-9]{2}[\x20A-Z0-9]{11}",
             rf"(?<![A-Za-z0-9])(?={_IBAN})[A-Z]{{2}}[0-9]{{2}}"),
    "ssn": (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
}
#: Kinds whose expression takes the first characters only, so that a candidate which fails its checksum
#: hides none that begins inside it; the value is what this expression finds from there on.
VALUES = {"iban": (_IBAN, 2 * max(IBAN_LENGTHS) + 2)}
BASE = ("email", "ip", "card", "phone")
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: kind -> (score of a confirmed match, score it gains from a context word nearby, the words).
CONTEXT = {
    "email": (0.8, 0.15, r"(?i)\b(?:e-?mail|mail|contact|write|courriel|correo)\b"),
    "ip": (0.6, 0.3, r"(?i)\b(?:ip|address|host|server|login|adresse)\b"),
    "card": (0.7, 0.25, r"(?i)\b(?:card|visa|mastercard|credit|debit|carte|karte|tarjeta)\b"),
    "phone": (0.7, 0.25, r"(?i)\b(?:phone|tel|call|mobile|fax|telefon|téléphone|teléfono)\b"),
    "iban": (0.85, 0.1, r"(?i)\b(?:iban|bank|account|konto|compte|cuenta)\b"),
    "ssn": (0.2, 0.6, r"(?i)\b(?:ssn|social security|taxpayer)\b"),
}
#: Added kinds without a checksum count only from this score on.
MIN_SCORE = 0.5
#: Characters looked at on each side of a match.
NEAR = 40


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Luhn sum of the digits of ``value`` is a multiple of ten."""
    ds = F.reverse(F.split(_digits(value), ""))
    each = F.transform(ds, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _mod97(value: Column) -> Column:
    """ISO 7064 mod 97-10 of an account number leaves 1."""
    plain = F.regexp_replace(value, r"\x20", "")
    chars = F.split(F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4)), "")
    digit = F.transform(chars, lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    return F.aggregate(digit, F.lit(0), lambda a, x: (a * F.when(x > 9, 100).otherwise(10) + x) % 97) == 1


def _confirmed(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    return {
        "email": lambda: F.lit(True),
        "ip": lambda: value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"),
        "card": lambda: _luhn(value),
        "phone": lambda: (n >= 10) & (n <= 15),
        "iban": lambda: _mod97(value),
        "ssn": lambda: ~value.rlike(r"^(?:000|666|9)|-00-|-0000$"),
    }[kind]()


_SPAN = "struct<start:bigint,ord:int,end:bigint,kind:string,value:string,score:double>"


#: Items folded between two array copies, and characters of a block of text.
RUN, BLOCK = 256, 1024


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: inside a lambda a plain expression would be computed for every element."""
    return F.transform(F.array(value), use)[0]


def _none(of: str) -> Column:
    return F.expr(f"cast(array() as array<{of}>)")


def _scan(items: Column, start: Column, of: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """What ``step(state, item) -> (next state, array of outputs)`` puts out along the array, with a long as state.

    Items are folded in runs, and the runs' outputs are put together at the end: an array grows by at most RUN
    items one by one, so time is in proportion to the items.
    """
    def one(acc: Column, x: Column) -> Column:
        state, out = step(acc["state"], x)
        return F.struct(state.cast("long").alias("state"), F.concat(acc["out"], out).alias("out"))

    def run(acc: Column, own: Column) -> Column:
        zero = F.struct(acc["state"].alias("state"), _none(of).alias("out"))
        return _with(F.aggregate(own, zero, one), lambda r: F.struct(r["state"].alias("state"), F.concat(acc["runs"], F.array(r["out"])).alias("runs")))

    def over(all_items: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_items) - 1) / RUN).cast("int")), lambda i: F.slice(all_items, i * RUN + 1, RUN))
        zero = F.struct(start.cast("long").alias("state"), _none(f"array<{of}>").alias("runs"))
        return F.flatten(F.aggregate(runs, zero, run)["runs"])
    return _with(items, lambda v: F.when(F.size(v) > 0, over(v)).otherwise(_none(of)))


def _cut(blocks: Column, at: Column, length: Column | int) -> Column:
    """``length`` characters (at most BLOCK) of the text from place ``at`` on, out of the two blocks that hold them."""
    i = F.floor(at / BLOCK).cast("int")
    two = F.concat(F.coalesce(F.get(blocks, i), F.lit("")), F.coalesce(F.get(blocks, i + 1), F.lit("")))
    return F.substr(two, (at - i * BLOCK + 1).cast("int"), F.lit(length) if isinstance(length, int) else length.cast("int"))


def kind_spans(text: Column, kind: str) -> Column:
    """Confirmed, scored spans of one kind, as an array in order of place.

    Time is in proportion to the text and its matches: places are running
    sums, and what lies around a match is cut out of blocks of the text.
    """
    gate, pattern = PATTERNS[kind]
    place = "struct<start:bigint,value:string>"

    def found(blocks: Column) -> Column:
        hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        gaps = F.split(text, pattern, -1)
        steps = F.zip_with(hits, _with(gaps, lambda g: F.slice(g, 1, F.size(g) - 1)), lambda h, g: F.struct(h.alias("h"), F.length(g).alias("g")))

        def placed_at(at: Column, x: Column) -> tuple[Column, Column]:
            start = (at + x["g"]).cast("long")
            return start + F.length(x["h"]), F.array(F.struct(start.alias("start"), x["h"].alias("value")))
        places = _scan(steps, F.lit(0), place, placed_at)
        if kind in VALUES:
            whole, most = VALUES[kind]
            places = F.transform(places, lambda s: F.struct(s["start"].alias("start"), F.regexp_extract(_cut(blocks, s["start"], most), "^" + whole, 0).alias("value")))
        placed = F.filter(places, lambda s: _confirmed(kind, s["value"]))
        if kind in VALUES:  # leftmost non-overlapping ones
            def apart(end: Column, s: Column) -> tuple[Column, Column]:
                fits = end <= s["start"]
                return F.when(fits, s["start"] + F.length(s["value"])).otherwise(end), F.when(fits, F.array(s)).otherwise(_none(place))
            placed = _scan(placed, F.lit(0), place, apart)
        low, gain, words = CONTEXT[kind]
        order = list(PATTERNS).index(kind)

        def scored(s: Column) -> Column:
            lo = F.greatest(s["start"] - NEAR, F.lit(0))
            n = F.length(s["value"])
            near = F.concat_ws(" ", _cut(blocks, lo, s["start"] - lo), _cut(blocks, s["start"] + n, NEAR))
            score = F.lit(low) + F.when(near.rlike(words), F.lit(gain)).otherwise(F.lit(0.0))
            return F.struct(s["start"].alias("start"), F.lit(order).alias("ord"), (s["start"] + n).cast("long").alias("end"),
                            F.lit(kind).alias("kind"), s["value"].alias("value"), score.alias("score"))
        out = F.transform(placed, scored)
        if kind not in BASE:
            out = F.filter(out, lambda s: s["score"] >= MIN_SCORE)
        return out
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return F.when(text.rlike(gate), _with(blocks, found)).otherwise(_none(_SPAN))


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, pii): the spans of every text by start, then kind, as an array of
    (start, ord, end, kind, value, score); offsets are code points, end exclusive.

    Null and empty texts have none; null ids, repeated rows and repeated ids
    are ordinary rows; long texts are read whole, in time that grows with the text and its
    matches; other columns are ignored.  No shuffle: every row is scanned in place.
    """
    d = id_text(docs)
    kinds = list(PATTERNS)
    d = d.select("doc_id", *[kind_spans(F.col("text"), k).alias(k) for k in kinds])
    return d.select("doc_id", F.array_sort(F.concat(*kinds)).alias("pii"))


def redact(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """(doc_id, text) with every span of at least ``min_score`` replaced by its kind in brackets.

    Where spans overlap, the first one is replaced and the part of a later one behind it."""
    d = id_text(docs)
    spans = F.array_sort(F.concat(*[kind_spans(F.col("text"), k) for k in PATTERNS]))
    d = d.withColumn("s", F.filter(spans, lambda s: s["score"] >= min_score))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substr(F.col("text"), (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        return F.struct(F.greatest(acc["at"], s["end"]).cast("long").alias("at"),
                        F.when(s["end"] > acc["at"], F.concat(acc["out"], gap, F.lit("["), s["kind"], F.lit("]"))).otherwise(acc["out"]).alias("out"))
    return d.withColumn("r", F.aggregate("s", zero, step)).select(
        "doc_id", F.concat(F.col("r.out"), F.substr(F.col("text"), (F.col("r.at") + 1).cast("int"))).alias("text"))
