"""From rule patterns to Spark regular expressions.

Rules are written in the common part of the Python and Java dialects. What differs is set by an inline flag group:
``d`` makes ``\\n`` the only line end, ``u`` and ``U`` make case folding and the classes Unicode-aware.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from functools import lru_cache

from pyspark.sql import Column, functions as F

from vigilake.functions.arrays import let_sql, sql_literal
from vigilake.functions.text import piece_spans_sql, split_lines_sql
from vigilake.rules.model import Rule

try:
    from re import _constants as _c, _parser
except ImportError:  # Python < 3.11
    import sre_constants as _c
    import sre_parse as _parser


def java_pattern(pattern: str, flags: str = "", unicode: bool = True) -> str:
    """The Spark form of a rule pattern."""
    ignore_case = "i" in flags or "(?i)" in pattern
    extra = ("duU" if ignore_case else "dU") if unicode else "d"
    return f"(?{''.join(sorted(set(flags)))}{extra})" + pattern


def rule_pattern(rule: Rule, unicode: bool = True) -> str:
    return java_pattern(rule.pattern, rule.flags, unicode)


# What a match needs: a literal, or ("and" | "or", parts). None stands for "nothing can be told".
Need = "str | tuple | None"


@lru_cache(maxsize=None)
def needed_literals(pattern: str, flags: str = "") -> Need:
    """Literals that every match of a pattern holds, as a small and/or tree.

    Patterns that ignore case give lower-case literals. Runs below two characters are left out, they tell too little.
    """
    ignore_case = "i" in flags or "(?i)" in pattern
    value = sum({"i": re.I, "m": re.M, "s": re.S}[f] for f in set(flags))
    need = _sequence_need(list(_parser.parse(_python_escapes(pattern), value)))
    return _lower(need) if ignore_case and need else need


def _python_escapes(pattern: str) -> str:
    return re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: re.escape(chr(int(m.group(1), 16))), pattern)


def _lower(need):
    return need.lower() if isinstance(need, str) else (need[0], tuple(_lower(x) for x in need[1]))


def _join(kind: str, parts: list) -> Need:
    """Combine parts; within ``and`` the longest literals come first since they are the rarest."""
    flat: list = []
    for part in parts:
        members = part[1] if isinstance(part, tuple) and part[0] == kind else (part,)
        flat += [m for m in members if m not in flat]
    literals = [x for x in flat if isinstance(x, str)]
    if kind == "or":  # a literal that holds another one is implied by it
        flat = [x for x in flat if not (isinstance(x, str) and any(y != x and y in x for y in literals))]
    else:
        flat = [x for x in flat if not (isinstance(x, str) and any(y != x and x in y for y in literals))]
        flat.sort(key=lambda x: -len(x) if isinstance(x, str) else 0)
    return flat[0] if len(flat) == 1 else (kind, tuple(flat))


def _sequence_need(nodes: list) -> Need:
    parts: list = []
    run = ""

    def close():
        nonlocal run
        if len(run) >= 2:
            parts.append(run)
        run = ""

    for op, arg in nodes:
        if op is _c.LITERAL and not chr(arg).splitlines() == [""]:
            run += chr(arg)
            continue
        if op is _c.BRANCH:
            # the parser pulls a common prefix out of alternatives; put it back in front of each
            prefix = [(_c.LITERAL, ord(ch)) for ch in run]
            options = [_sequence_need(prefix + list(option)) for option in arg[1]]
            close()
            if all(options):
                parts.append(_join("or", options))
            continue
        close()
        if op is _c.SUBPATTERN:
            inner = _sequence_need(list(arg[-1]))
        elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT) and arg[0] >= 1:
            inner = _sequence_need(list(arg[2]))
        else:
            inner = None
        if inner:
            parts.append(inner)
    close()
    return _join("and", parts) if parts else None


# Letters outside ASCII that Unicode case folding treats as i, s or k; lower() alone does not map them.
_FOLDED_LETTERS = ("\u0130", "\u0131", "\u017f")


@lru_cache(maxsize=None)
def stays_on_line(rule: Rule) -> bool:
    """True if no match of a rule can hold or see a line feed, so that matching line by line gives the same result."""
    flags = sum({"i": re.I, "m": re.M, "s": re.S}[f] for f in set(rule.flags))
    return _avoids_break(list(_parser.parse(_python_escapes(rule.pattern), flags)), "s" in rule.flags, "m" in rule.flags)


def _avoids_break(nodes: list, dotall: bool, multiline: bool) -> bool:
    for op, arg in nodes:
        if op is _c.LITERAL:
            ok = arg != 10
        elif op is _c.NOT_LITERAL:
            ok = arg == 10
        elif op is _c.ANY:
            ok = not dotall
        elif op is _c.IN:
            # NEGATE comes first; a set without it is safe unless it names the line feed or a class that holds it
            ok = arg[0][0] is not _c.NEGATE and all(
                (o is _c.LITERAL and a != 10) or (o is _c.RANGE and not a[0] <= 10 <= a[1])
                or (o is _c.CATEGORY and a in (_c.CATEGORY_DIGIT, _c.CATEGORY_WORD))
                for o, a in arg
            )
        elif op is _c.BRANCH:
            ok = all(_avoids_break(list(option), dotall, multiline) for option in arg[1])
        elif op is _c.SUBPATTERN:
            ok = not arg[1] and not arg[2] and _avoids_break(list(arg[-1]), dotall, multiline)
        elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT):
            ok = _avoids_break(list(arg[2]), dotall, multiline)
        elif op is _c.AT:
            ok = arg in (_c.AT_BOUNDARY, _c.AT_NON_BOUNDARY) or (multiline and arg in (_c.AT_BEGINNING, _c.AT_END))
        elif op in (_c.ASSERT, _c.ASSERT_NOT):
            ok = _avoids_break(list(arg[1]), dotall, multiline)
        else:
            ok = False
        if not ok:
            return False
    return True


def ignores_case(rule: Rule) -> bool:
    return "i" in rule.flags or "(?i)" in rule.pattern


def literals_of(need: Need) -> set[str]:
    if need is None:
        return set()
    return {need} if isinstance(need, str) else set().union(*(literals_of(x) for x in need[1]))


def rarest_literals(need: Need) -> list[str]:
    """Literals of which every match holds at least one: the part of the tree with the fewest, then the longest ones."""
    if need is None:
        return [""]
    if isinstance(need, str):
        return [need.lower()]
    parts = [rarest_literals(part) for part in need[1]]
    if need[0] == "or":
        return sorted(set().union(*parts))
    return min(parts, key=lambda part: (len(part), -min(map(len, part))))


#: Parts a match from what lies around it; a code point that is no character.
MARK = "\uffff"
# Characters of folded text from the commonest to the rarest; those that are not named are rarer still.
_COMMONEST = " etaoinsrhldcumfpgwybvk.,"


def any_literal(literals: Iterable[str]) -> str:
    """A Spark regular expression that finds a text with any of many literals in one search.

    An alternation would be tried in full at every character. Here every literal hangs on its rarest character: a search
    passes over all others with one test, and looks around one of these for the few literals that hang on it.
    """
    hung: dict[str, list[tuple[str, str]]] = {}
    for literal in sorted(set(literals)):
        at = max(range(len(literal)), key=lambda i: (_COMMONEST + literal[i]).index(literal[i]))
        hung.setdefault(literal[at], []).append((literal[:at], literal[at + 1:]))

    def plain(value: str) -> str:
        return "".join(c if c.isalnum() or ord(c) > 127 else f"\\x{{{ord(c):x}}}" for c in value)

    def around(char: str, before: str, after: str) -> str:
        return (f"(?<={plain(before + char)})" if before else "") + plain(after)

    groups = [f"{plain(c)}(?:{'|'.join(around(c, *ends) for ends in parts)})" for c, parts in sorted(hung.items(), key=lambda x: (_COMMONEST + x[0]).index(x[0]))]
    return f"(?=[{''.join(map(plain, hung))}])(?:{'|'.join(groups)})"


def places_to_try(
    text: str, rules: list[Rule], by_line: list[bool], unicode: bool, mode: str, admitted: str | None = None
) -> Column:
    """Where rules have to be tried: an array of (line, rule, subject), line 0 for the whole text.

    Texts are folded as literals are looked for in them: lower case, and the letters that fold to i and s as these.

    ``text`` and ``admitted`` (numbers of the rules for this file) are column names. No literal spans lines, so one search
    for all literals leaves the lines that matter. They together must hold the literals of a rule; of rules for lines,
    those of them go on that hold one of its rarest literals. All steps are the same for any number of rules and
    stay in the JVM. Rules without literals are tried on the whole text first, with ``^`` and ``$`` at line ends: a match
    inside a line is a match there too. Of their lines those go on that match.
    """
    needs = [_lower(need) if need else None for need in (needed_literals(rule.pattern, rule.flags) for rule in rules)]

    def holds(need: Need) -> str:
        if isinstance(need, str):
            return f"contains(hay, {sql_literal(need)})"
        return "(" + f" {need[0].upper()} ".join(holds(part) for part in need[1]) + ")"

    numbers, bare = [], {}
    for number, (rule, need) in enumerate(zip(rules, needs), 1):
        tests = [] if admitted is None else [f"array_contains({admitted}, {number})"]
        if need is not None:
            tests.append(holds(need))
        elif by_line[number - 1]:
            tests.append(f"{text} rlike {sql_literal('(?m)' + rule_pattern(rule, unicode))}")
            bare[number] = f"WHEN {number} THEN e.t rlike {sql_literal(rule_pattern(rule, unicode))}"
        numbers.append(f"if({' AND '.join(tests)}, {number}, cast(null as int))" if tests else str(number))
    line_rules = f"from_json('{json.dumps([n for n, flag in enumerate(by_line, 1) if flag])}', 'array<int>')"
    marks = f"from_json({sql_literal(json.dumps([rarest_literals(need) for need in needs]))}, 'array<array<string>>')"

    # of the rules found in a text, w.found; of a line, x is folded, t as it stands, i the number
    none = "cast(array() as array<struct<line:int,rule:int,subject:string>>)"
    tried_lines = let_sql("held", "filter(w.marks[n - 1], m -> contains(hay, m))", (
        "if(size(held) = 1, filter(w.near, e -> contains(e.x, held[0])), filter(w.near, e -> exists(held, m -> contains(e.x, m))))"
    ))
    if bare:
        tried_lines = f"if(n IN ({', '.join(map(str, bare))}), filter(w.lines, e -> CASE n {' '.join(bare.values())} END), {tried_lines})"
    hits = f"transform({tried_lines}, e -> named_struct('line', e.i, 'rule', cast(n as int), 'subject', e.t))"
    whole = f"array(named_struct('line', 0, 'rule', cast(n as int), 'subject', {text}))"
    places = f"flatten(transform(w.found, n -> if(array_contains(w.line_rules, n), coalesce({hits}, {none}), {whole})))"

    def cut(value: str) -> str:
        return split_lines_sql(value) if mode == "universal" else f"split({value}, '\n', -1)"

    lines = let_sql("raw", cut(text), f"transform({cut('v')}, (x, i) -> named_struct('x', x, 't', get(raw, i), 'i', i + 1))")
    # what a rule for lines needs stands on the line of its match
    literals = set().union(*(
        rarest_literals(need) if flag else literals_of(need) for need, flag in zip(needs, by_line) if need is not None
    ))
    near = f"filter(lines, e -> e.x rlike {sql_literal(any_literal(literals))})" if literals else "slice(lines, 1, 0)"
    file = f"named_struct('lines', lines, 'near', near, 'found', found, 'marks', {marks}, 'line_rules', {line_rules})"
    searched = let_sql("found", f"array_compact(array({', '.join(numbers)}))" if numbers else "cast(array() as array<int>)",
                       f"if(size(found) > 0, {let_sql('w', file, places)}, {none})")
    searched = let_sql("lines", lines, let_sql("near", near, let_sql("hay", "array_join(transform(near, e -> e.x), '\n')", searched)))
    # few texts have such a letter, and replacing looks up every character
    folds = " OR ".join(f"contains({text}, {sql_literal(letter)})" for letter in _FOLDED_LETTERS)
    letters = sql_literal("".join(_FOLDED_LETTERS))
    return F.expr(let_sql("v", f"lower(if({folds}, translate({text}, {letters}, 'iis'), {text}))", searched))


def pieces_sql(subject: str, rule_number: str, rules: list[Rule], unicode: bool) -> str:
    """A subject cut by the rule with the given number, as SQL: what is before the first match, the match, what follows, ...

    One search gives matches and gaps. A constant pattern is compiled once per task, but only searching and replacing
    keep it, and splitting at a single character needs none.
    """
    mark = sql_literal(MARK)
    marked = by_rule_sql(rule_number, rules, unicode, lambda p: f"regexp_replace({subject}, {p}, '{MARK}$0{MARK}')")
    found = by_rule_sql(rule_number, rules, unicode, lambda p: f"regexp_extract_all({subject}, {p}, 0)")
    gaps = by_rule_sql(rule_number, rules, unicode, lambda p: f"split({subject}, {p}, -1)")
    slow = let_sql("around", gaps, f"concat(flatten(zip_with(slice(around, 1, size(around) - 1), {found}, (g, h) -> array(g, h))), slice(around, -1, 1))")
    return f"if(contains({subject}, {mark}), {slow}, split({marked}, {mark}, -1))"


def rule_spans(subject: str, rule_number: str, rules: list[Rule], unicode: bool = True) -> Column:
    """Matches of the rule with the given number and where they lie, by one literal pattern per rule.

    The choice stands in a lambda: the code of many patterns in one method is more than the JVM compiles, and then the
    whole stage would run interpreted instead of this one expression.
    """
    pair = f"named_struct('subject', {subject}, 'rule', {rule_number})"
    return F.expr(let_sql("tried", pair, piece_spans_sql(pieces_sql("tried.subject", "tried.rule", rules, unicode), "tried.subject")))


def extracted(subject: str, rule_number: str, rules: list[Rule], unicode: bool = True) -> Column:
    """Matches of the rule with the given number, by one literal pattern per rule.

    The choice stands in a lambda: the code of many patterns in one method is more than the JVM compiles, and then the
    whole stage would run interpreted instead of this one expression.
    """
    pair = f"named_struct('subject', {subject}, 'rule', {rule_number})"
    return F.expr(let_sql("tried", pair, by_rule_sql("tried.rule", rules, unicode, lambda p: f"regexp_extract_all(tried.subject, {p}, 0)")))


def by_rule_sql(rule_number: str, rules: list[Rule], unicode: bool, body: Callable[[str], str]) -> str:
    """A choice by rule number; ``body`` gets the pattern of a rule as SQL literal."""
    branches = (f"WHEN {n} THEN {body(sql_literal(rule_pattern(rule, unicode)))}" for n, rule in enumerate(rules, 1))
    return f"CASE {rule_number} {' '.join(branches)} END"
