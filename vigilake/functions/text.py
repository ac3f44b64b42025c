"""Column helpers for offsets, lines, snippets and match positions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from vigilake.functions.arrays import let, let_sql, running_sql, sql_literal

# Line ends of str.splitlines(); \r\n counts once.
UNIVERSAL_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
_RARE_LINE_ENDS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


def split_lines(text: Column, mode: str = "lf") -> Column:
    """Lines of a text. ``universal`` splits at every Unicode line end and drops a last empty line."""
    if mode == "lf":
        return F.split(text, "\n", -1)
    if mode != "universal":
        raise ValueError("mode is 'lf' or 'universal'")

    def parts(v: Column) -> Column:
        # splitting at one character needs no regular expression, and most texts have line feeds only
        rare = reduce(or_, [v.contains(end) for end in _RARE_LINE_ENDS])
        return F.when(rare, F.split(v, UNIVERSAL_LINE_END, -1)).otherwise(F.split(v, "\n", -1))

    return let(let(text, parts), lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))


def split_lines_sql(text: str) -> str:
    """Universal lines as SQL text; ``text`` is SQL."""
    rare = " OR ".join(f"contains(whole, {sql_literal(end)})" for end in _RARE_LINE_ENDS)
    parts = f"if({rare}, split(whole, {sql_literal(UNIVERSAL_LINE_END)}, -1), split(whole, '\\n', -1))"
    return let_sql("whole", text, let_sql("cut", parts, "if(element_at(cut, -1) = '', slice(cut, 1, size(cut) - 1), cut)"))


def match_spans(text: str, pattern: str, found: str | None = None) -> Column:
    """Every match of a regular expression with where it lies. Arguments are column names.

    ``found`` names a column with the matches where they are known already.

    Elements are ``start``, ``stop`` (0-based offsets), ``line`` and ``col`` (1-based) and ``matched``. The pieces
    between matches and the matches alternate, so running results over both give all positions in one pass and
    without leaving the JVM. The pattern must not match the empty string.
    """
    hits = found or f"regexp_extract_all({text}, {pattern}, 0)"
    return F.expr(spans_sql(f"named_struct('found', {hits}, 'gaps', split({text}, {pattern}, -1))"))


def spans_sql(pieces: str) -> str:
    """SQL of :func:`match_spans` for a struct of the matches, ``found``, and the pieces between them, ``gaps``."""
    # sizes and line breaks of each gap and the match behind it
    parts = """zip_with(slice(p.gaps, 1, size(p.found)), p.found, (gap, hit) -> named_struct(
        'matched', hit, 'size', length(hit), 'step', length(gap) + length(hit),
        'gap_breaks', regexp_count(gap, '\\n'), 'hit_breaks', regexp_count(hit, '\\n'),
        'gap_tail', length(substring_index(gap, '\\n', -1)), 'hit_tail', length(substring_index(hit, '\\n', -1))))"""
    stops = running_sql("transform(parts, x -> x.step)", "sum")
    breaks = running_sql("transform(parts, x -> x.gap_breaks + x.hit_breaks)", "sum")
    # 'own' and 'last': where the last line break before the match and up to its end leaves off, 0 without a break
    spans = f"""zip_with(zip_with(parts, {stops}, (x, stop) -> named_struct('x', x, 'stop', stop)), {breaks}, (y, total) ->
        named_struct(
            'start', y.stop - y.x.size, 'stop', y.stop, 'line', total - y.x.hit_breaks + 1, 'matched', y.x.matched,
            'own', if(y.x.gap_breaks > 0, y.stop - y.x.size - y.x.gap_tail, 0),
            'last', case when y.x.hit_breaks > 0 then y.stop - y.x.hit_tail
                         when y.x.gap_breaks > 0 then y.stop - y.x.size - y.x.gap_tail else 0 end))"""
    earlier = f"concat(array(0), {running_sql('transform(spans, z -> z.last)', 'max')})"
    placed = f"""zip_with(spans, slice({earlier}, 1, size(spans)), (z, before) -> named_struct(
        'start', z.start, 'stop', z.stop, 'line', z.line, 'col', z.start - greatest(z.own, before) + 1, 'matched', z.matched))"""
    return let_sql("p", pieces, let_sql("parts", parts, let_sql("spans", spans, placed)))


def piece_spans_sql(pieces: str, subject: str) -> str:
    """SQL of :func:`match_spans` for the pieces of a subject: a gap, a match, a gap, a match, ..., a gap.

    Most subjects are single lines, and most of those have one match; these need no running results.
    """
    none = "cast(array() as array<struct<start:int,stop:int,line:int,col:int,matched:string>>)"
    span = "named_struct('start', {0}, 'stop', {1}, 'line', 1, 'col', {0} + 1, 'matched', {2})"
    one = f"array({span.format('length(cut[0])', 'length(cut[0]) + length(cut[1])', 'cut[1]')})"
    found, gaps = "filter(cut, (x, i) -> i % 2 = 1)", "filter(cut, (x, i) -> i % 2 = 0)"
    stops = running_sql(f"zip_with({found}, slice({gaps}, 1, size(cut) div 2), (m, g) -> length(m) + length(g))", "sum")
    on_line = f"zip_with({found}, {stops}, (m, stop) -> {span.format('stop - length(m)', 'stop', 'm')})"
    spans = spans_sql(f"named_struct('found', {found}, 'gaps', {gaps})")
    return let_sql("cut", pieces, (
        f"CASE WHEN size(cut) <= 1 THEN {none} WHEN contains({subject}, '\n') THEN {spans} "
        f"WHEN size(cut) = 3 THEN {one} ELSE {on_line} END"
    ))


def line_of_offset(text: Column, offset: Column) -> Column:
    """1-based line that holds a 0-based offset."""
    return F.regexp_count(F.substring(text, F.lit(1), offset), F.lit("\n")) + 1


def column_of_offset(text: Column, offset: Column) -> Column:
    """1-based column of a 0-based offset inside its line."""
    return F.length(F.substring_index(F.substring(text, F.lit(1), offset), "\n", -1)) + 1


def match_context(text: Column, start: Column, stop: Column, width: int = 50) -> Column:
    """The match with ``width`` characters on both sides, line breaks shown as blanks."""
    begin = F.greatest(start - width, F.lit(0))
    return F.translate(F.substring(text, begin + 1, stop + width - begin), "\n", " ")


def extract_snippet(text: Column, start_line, end_line=None, max_lines: int = 5, mode: str = "lf") -> Column:
    """Lines ``start_line`` to ``end_line`` (or ``max_lines`` lines) joined by line breaks."""
    lines = split_lines(text, mode)
    first = F.greatest(start_line if isinstance(start_line, Column) else F.lit(start_line), F.lit(1))
    if end_line is None:
        count = F.lit(max_lines)
    else:
        count = F.greatest((end_line if isinstance(end_line, Column) else F.lit(end_line)) - first + 1, F.lit(0))
    return F.array_join(F.slice(lines, first, count), "\n")


def lines_around(lines: Column, line_no: Column, before: int | Column, after: int | Column | None = None) -> Column:
    """Lines within reach of a 1-based line, joined by line breaks."""
    after = before if after is None else after
    first = F.greatest(line_no - before, F.lit(1))
    return F.array_join(F.slice(lines, first, line_no + after - first + 1), "\n")
