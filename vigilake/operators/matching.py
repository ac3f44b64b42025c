"""Pattern packs over texts and lines.

A pack runs in two steps. First the literals that the rules need are looked for, which tells in which lines or texts
which rules are worth trying. Only these (place, rule) pairs go on to the regular expressions, one literal pattern per
rule, and to the step that finds the position of every match. There is no shuffle and no join with a rule table.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from vigilake.functions.arrays import constant_array, running_totals
from vigilake.functions.patterns import (
    extracted, places_to_try, rule_spans, stays_on_line,
)
from vigilake.functions.text import lines_around, match_context, split_lines
from vigilake.rules.model import Pack, Rule

Entries = Sequence[tuple[Rule, Column | None]]

MATCH_COLUMNS = (
    "rule_id", "line_start", "line_end", "column_start", "column_end", "matched_text", "snippet",
)


def pack_entries(pack: Pack | Iterable[Rule], guard: Column | None = None) -> list[tuple[Rule, Column | None]]:
    rules = pack.matchable if isinstance(pack, Pack) else [r for r in pack if r.pattern is not None]
    return [(rule, guard) for rule in rules]


def _guarded(files: DataFrame, entries: Entries) -> DataFrame:
    """Files that at least one guard admits."""
    guards = {str(guard): guard for _, guard in entries if guard is not None}
    if guards and all(guard is not None for _, guard in entries):
        files = files.where(reduce(or_, guards.values()))
    return files


def admitted_rules(entries: Entries) -> Column | None:
    """Numbers of the rules whose guard holds for a file; null if no rule has a guard."""
    if all(guard is None for _, guard in entries):
        return None
    groups: dict[str, tuple[Column, list[int]]] = {}
    for n, (_, guard) in enumerate(entries, 1):
        groups.setdefault(str(guard), (F.lit(True) if guard is None else guard, []))[1].append(n)
    return F.flatten(F.array_compact(F.array(*[
        F.when(guard, constant_array(numbers, "int")) for guard, numbers in groups.values()
    ])))


def _tried(
    files: DataFrame, entries: Entries, keys: Sequence[str], text: str, by_line: list[bool], mode: str, unicode: bool, ends: bool = False
) -> DataFrame:
    """One row per place where a rule has to be tried.

    Columns: keys, ``_text``, ``_lines``, ``_line`` (0 for the whole text), ``_subject``, ``_rule``. The subject comes with
    its place, so texts and lines are only copied to places where a snippet is asked for.
    """
    rules = [rule for rule, _ in entries]
    admitted = admitted_rules(entries)
    base = _guarded(files, entries).select(
        *keys, F.col(text).alias("_text"), *([] if admitted is None else [admitted.alias("_admitted")])
    )
    held = base.columns
    base = base.withColumn("_lines", split_lines(F.col("_text"), mode))
    extra = ["_lines"]
    if ends:
        # running lengths of the lines with their line feeds
        base = base.withColumn("_ends", running_totals("transform(_lines, x -> length(x) + 1)"))
        extra.append("_ends")
    placed = base.select(
        *held, *extra, F.explode_outer(  # a plain explode is evaluated a second time, in a filter that the optimizer adds
            places_to_try("_text", rules, by_line, unicode, mode, None if admitted is None else "_admitted")
        ).alias("_p")
    ).where(F.col("_p").isNotNull())
    return placed.select(
        *keys, "_text", *extra, F.col("_p.line").alias("_line"), F.col("_p.rule").alias("_rule"),
        F.col("_p.subject").alias("_subject"),
    )


def _spans(tried: DataFrame, entries: Entries, unicode: bool, *columns) -> DataFrame:
    """Positions of the matches: one row per match with ``_rule_id`` and ``_s``."""
    ids = constant_array(rule.rule_id for rule, _ in entries)
    return tried.select(
        *columns, "_line", F.element_at(ids, F.col("_rule")).alias("_rule_id"),
        F.explode_outer(rule_spans("_subject", "_rule", [rule for rule, _ in entries], unicode)).alias("_s"),
    ).where(F.col("_s").isNotNull())


def explode_lines(files: DataFrame, keys: Sequence[str] = ("path",), text: str = "text", mode: str = "lf") -> DataFrame:
    """Numbered lines of every text."""
    return files.select(*keys, F.posexplode(split_lines(F.col(text), mode)).alias("_i", "line")).select(
        *keys, (F.col("_i") + 1).alias("line_no"), "line"
    )


def skip_comment_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lines that are neither blank nor a ``#`` comment."""
    return lines.where(~_is_comment(line))


def _is_comment(line: str) -> Column:
    return F.rlike(F.trim(F.col(line)), F.lit(r"^\s*(#|$)"))


def match_lines(
    files: DataFrame,
    pack: Pack | Entries,
    *,
    keys: Sequence[str] = ("path",),
    text: str = "text",
    mode: str = "universal",
    unicode: bool = True,
    context_lines: int | dict[str, int] | None = None,
    column_base: int | dict[str, int] | None = None,
    skip_comments: bool | Iterable[str] = False,
) -> DataFrame:
    """All matches of line rules. One row per match, with the lines around it as snippet.

    ``context_lines``, ``column_base`` and ``skip_comments`` may differ by rule id, so that packs with different
    habits share one pass.
    """
    single = isinstance(pack, Pack)
    entries = pack_entries(pack) if single else list(pack)
    around = context_lines if context_lines is not None else (pack.context_lines if single else 3)
    base = column_base if column_base is not None else (pack.column_base if single else 0)
    tried = _tried(files, entries, keys, text, [True] * len(entries), mode, unicode)
    if skip_comments is True:
        tried = skip_comment_lines(tried, "_subject")
    elif skip_comments:
        chosen = set(skip_comments)
        numbers = [n for n, (rule, _) in enumerate(entries, 1) if rule.rule_id in chosen]
        tried = tried.where(~(F.col("_rule").isin(*numbers) & _is_comment("_subject")))

    def by_rule(value: int | dict[str, int], default: int) -> Column:
        if isinstance(value, int):
            return F.lit(value)
        return F.element_at(constant_array((value.get(r.rule_id, default) for r, _ in entries), "int"), F.col("_rule"))

    snippet = lines_around(F.col("_lines"), F.col("_line"), by_rule(around, 3)).alias("snippet")
    return _spans(tried, entries, unicode, *keys, snippet, by_rule(base, 0).alias("_base")).select(
        *keys, F.col("_rule_id").alias("rule_id"), F.col("_line").alias("line_start"), F.col("_line").alias("line_end"),
        (F.col("_s.start") + F.col("_base")).alias("column_start"),
        (F.col("_s.stop") + F.col("_base")).alias("column_end"),
        F.col("_s.matched").alias("matched_text"),
        "snippet",
    )


def match_content(
    files: DataFrame,
    pack: Pack | Entries,
    *,
    keys: Sequence[str] = ("path",),
    text: str = "text",
    unicode: bool = True,
    snippet: str = "none",
    context_lines: int = 3,
    keep: Column | None = None,
) -> DataFrame:
    """All matches of rules that look at whole texts and may span lines.

    ``snippet`` is ``none``, ``context`` (50 characters on both sides) or ``lines``. ``keep`` is an extra test on
    ``_rule_id`` and ``_s`` (the match) for rules that need to look at what was matched.
    """
    entries = pack_entries(pack) if isinstance(pack, Pack) else list(pack)
    # a rule that cannot see a line feed gives the same matches line by line, on far less text
    by_line = [stays_on_line(rule) for rule, _ in entries]
    tried = _tried(files, entries, keys, text, by_line, "lf", unicode, ends=snippet == "context")
    whole = F.col("_line") == 0
    columns = list(keys)
    if snippet == "context":
        # where the line of the match starts in the text; ends of lines were summed once for the whole file
        shift = F.when(F.col("_line") <= 1, 0).otherwise(F.get("_ends", F.col("_line") - 2))
        columns += [F.col("_text"), shift.alias("_shift")]
    elif snippet == "lines":
        columns += [F.col("_lines")]
    spans = _spans(tried, entries, unicode, *columns)
    if keep is not None:
        spans = spans.where(keep)
    line = F.when(whole, F.col("_s.line")).otherwise(F.col("_line"))
    shown = F.lit(None).cast("string")
    if snippet == "context":
        shown = match_context(F.col("_text"), F.col("_s.start") + F.col("_shift"), F.col("_s.stop") + F.col("_shift"))
    elif snippet == "lines":
        shown = lines_around(F.col("_lines"), line, context_lines)
    return spans.select(
        *keys, F.col("_rule_id").alias("rule_id"), line.alias("line_start"),
        (line + F.regexp_count(F.col("_s.matched"), F.lit("\n"))).alias("line_end"),
        F.col("_s.col").alias("column_start"),
        (F.col("_s.col") + F.col("_s.stop") - F.col("_s.start")).alias("column_end"),
        F.col("_s.matched").alias("matched_text"),
        shown.alias("snippet"),
    )


def match_counts(
    files: DataFrame, pack: Pack | Entries, *, keys: Sequence[str] = ("path",), text: str = "text", unicode: bool = True
) -> DataFrame:
    """Number of matches per text and rule, without positions."""
    entries = pack_entries(pack) if isinstance(pack, Pack) else list(pack)
    ids = constant_array(rule.rule_id for rule, _ in entries)
    tried = _tried(files, entries, keys, text, [False] * len(entries), "lf", unicode)
    found = extracted("_subject", "_rule", [rule for rule, _ in entries], unicode)
    return tried.withColumn("_found", found).where(F.size("_found") > 0).select(
        *keys, F.element_at(ids, F.col("_rule")).alias("rule_id"), F.size("_found").cast("bigint").alias("n_matches")
    )
