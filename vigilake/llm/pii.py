"""Personal data: patterns propose spans, checksums and ranges confirm them, words nearby adjust the score.

Everything is Spark expressions. Positions come from running sums over the pieces between matches, so a text with very many
matches costs time in proportion.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from vigilake.functions.arrays import let_sql, running_sql
from vigilake.llm.common import LOWER, UPPER

_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Code points looked at on each side of a span for context words.
REACH = 40
CONTEXT_BONUS = 40
#: Spans of the kinds that the method adds are reported from this score on.
REPORT_AT = 70


def _digits(x: str) -> str:
    return f"translate({x}, ' -().+', '')"


def _luhn(digits: str) -> str:
    """Digit sum in which every second digit from the right is doubled, as SQL; digits over 9 lose 9."""
    back = f"reverse({digits})"
    values = f"transform(split({back}, ''), (c, i) -> cast(if(i % 2 = 0, c, translate(c, '0123456789', '0246813579')) as int))"
    return f"aggregate({values}, 0, (a, v) -> a + v) % 10 = 0"


def _mod97(x: str) -> str:
    """ISO 7064: the first four characters go to the end, letters count 10 to 35, the remainder must be 1."""
    turned = f"concat(substring({x}, 5), substring({x}, 1, 4))"
    step = f"if(c between '0' and '9', (a * 10 + cast(c as int)) % 97, (a * 100 + ascii(c) - 55) % 97)"
    return f"aggregate(split({turned}, ''), 0, (a, c) -> cast({step} as int)) = 1"


@dataclass(frozen=True)
class Kind:
    """A kind of personal data.

    ``pattern`` is what the contract says; ``fast`` finds the same matches without trying a run of characters again from
    its middle, so that very long runs take linear time: a match begins where a run does, or where the last match ended.
    """

    name: str
    pattern: str
    fast: str
    hint: str
    valid: str
    score: int
    words: tuple[str, ...]
    base: bool = True


KINDS = (
    Kind("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
         r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "text like '%@%'",
         "true", 60, ("mail", "contact", "write")),
    Kind("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "text like '%.%.%.%'",
         f"x rlike '^{_OCTET}([.]{_OCTET}){{3}}$'", 60, ("address", "server", "host")),
    Kind("card", r"[0-9]([\x20-]?[0-9])+", r"[0-9](?:[\x20-]?[0-9])++", "true",
         f"length({_digits('x')}) between 16 and 19 and {_luhn(_digits('x'))}", 60, ("card", "visa", "payment")),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", "text like '%+%'",
         f"length({_digits('x')}) between 8 and 15", 60, ("phone", "call", "tel")),
    Kind("iban", r"[A-Z][A-Z][0-9][0-9][A-Z0-9]{11,30}", r"[A-Z][A-Z][0-9][0-9][A-Z0-9]{11,30}", "true",
         _mod97("x"), 80, ("iban", "account", "bank"), base=False),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "text like '%-%-%'",
         "not (x rlike '^(000|666|9)' or x like '%-00-%' or x like '%-0000')", 40, ("ssn", "social", "security"), base=False),
)


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def kind_spans(kind: Kind) -> Column:
    """Confirmed spans of one kind in column ``text``, in order: kind, start, stop, score.

    Offsets are code points, the end exclusive. Matches that fail their test are dropped and nothing else is tried in
    their place.
    """
    p = _quoted(kind.fast)
    gaps = f"slice(split(text, {p}, -1), 1, size(found))"
    parts = f"zip_with({gaps}, found, (gap, x) -> named_struct('x', x, 'size', char_length(x), 'step', char_length(gap) + char_length(x)))"
    stops = running_sql("transform(parts, y -> y.step)", "sum")
    spans = f"zip_with(parts, {stops}, (y, stop) -> named_struct('x', y.x, 'start', stop - y.size, 'stop', stop))"
    good = f"filter({spans}, s -> {'true' if kind.valid == 'true' else _on(kind.valid)})"
    near = (
        f"translate(concat(substring(text, greatest(s.start - {REACH}, 0) + 1, least(s.start, {REACH})), ' ', substring(text, s.stop + 1, {REACH})), "
        f"'{UPPER}', '{LOWER}')"
    )
    words = f"({near} rlike '{'|'.join(kind.words)}')"
    scored = f"""transform(good, s -> named_struct('kind', '{kind.name}', 'start', s.start, 'stop', s.stop,
        'score', least(100, {kind.score} + if({words}, {CONTEXT_BONUS}, 0))))"""
    if not kind.base:
        scored = f"filter({scored}, s -> s.score >= {REPORT_AT})"
    none = "cast(array() as array<struct<kind: string, start: int, stop: int, score: int>>)"
    found = f"if({kind.hint}, regexp_extract_all(text, {p}, 0), cast(array() as array<string>))"
    body = let_sql("parts", parts, let_sql("good", good, scored))
    return F.expr(let_sql("found", found, f"if(size(found) = 0, {none}, {body})"))


def _on(test: str) -> str:
    """The test with ``x`` bound to the matched text."""
    return let_sql("x", "s.x", test)


def personal_data(docs: DataFrame) -> DataFrame:
    """Spans of personal data in every whole text: doc_id and one array column per kind (kind, start, stop, score).

    Base kinds (email, ip, card, phone) are reported whenever they are confirmed; their score rises with context words.
    Added kinds: ``iban`` (mod-97) always reaches the mark, ``ssn`` (number ranges) with a context word only. Spans of
    different kinds may overlap. A null or empty text has no spans; each row is a text of its own, also where rows repeat
    a doc_id. An empty table gives no rows.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.select("doc_id", *[kind_spans(k).alias(k.name) for k in KINDS])


def span_text(*kinds: str) -> Column:
    """kind:start:end of the spans of these kinds, in this order, comma-joined."""
    spans = F.concat(*[F.transform(k, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])) for k in kinds])
    return F.array_join(spans, ",")


def masked_text(docs: DataFrame) -> DataFrame:
    """Texts with every reported span replaced by its kind in brackets: doc_id, masked. Overlaps become one mask."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    spans = F.array_sort(F.concat(*[F.transform(kind_spans(k), lambda s: F.struct(s["start"], s["stop"], s["kind"])) for k in KINDS]))
    step = """if(s.start < acc.at, named_struct('at', greatest(acc.at, s.stop), 'out', acc.out),
        named_struct('at', s.stop, 'out', concat(acc.out, array(substring(text, acc.at + 1, s.start - acc.at), concat('[', s.kind, ']')))))"""
    out = f"aggregate(spans, named_struct('at', 0, 'out', cast(array() as array<string>)), (acc, s) -> {step})"
    masked = f"transform(array({out}), r -> concat(array_join(r.out, ''), substring(text, r.at + 1)))[0]"
    return rows.withColumn("spans", spans).select("doc_id", F.expr(masked).alias("masked"))
