"""The rule packs as operators, and the checks that are not one regular expression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vigilake.functions.arrays import let, let_sql, running_sql, sql_literal
from vigilake.functions.hits import NO_HITS_SQL, hit, hit_sql, no_hits, unfold
from vigilake.functions.text import match_spans, split_lines
from vigilake.operators.matching import explode_lines, match_content, match_lines, pack_entries
from vigilake.rules import PACKS, characters, code, config, prompts, secrets, threats
from vigilake.rules.model import Pack
from vigilake.session import any_of

KEYS = ("path",)


def _scoped(files: DataFrame, pack: Pack, by_extension: bool) -> DataFrame:
    return files.where(F.col("ext").isin(*pack.extensions)) if by_extension and pack.extensions else files


def _lines(pack: Pack, files: DataFrame, keys, by_extension: bool, **options) -> DataFrame:
    return match_lines(_scoped(files, pack, by_extension), pack, keys=keys, **options)


def _content(pack: Pack, files: DataFrame, keys, by_extension: bool, **options) -> DataFrame:
    return match_content(_scoped(files, pack, by_extension), pack, keys=keys, **options)


def pack_python(files: DataFrame, keys: Sequence[str] = KEYS, by_extension: bool = True, **options) -> DataFrame:
    return _lines(code.PYTHON, files, keys, by_extension, **options)


def pack_javascript(files: DataFrame, keys: Sequence[str] = KEYS, by_extension: bool = True, **options) -> DataFrame:
    """JavaScript rules; risky regular-expression literals are found by :func:`regex_literal_risks`."""
    return _lines(code.JAVASCRIPT, files, keys, by_extension, **options)


def pack_shell(files: DataFrame, keys: Sequence[str] = KEYS, by_extension: bool = True, **options) -> DataFrame:
    """Shell rules on lines that are no comments."""
    return _lines(code.SHELL, files, keys, by_extension, skip_comments=True, **options)


def regex_literal_risks(files: DataFrame, keys: Sequence[str] = KEYS, text: str = "text") -> DataFrame:
    """JS106: regular-expression literals with stacked quantifiers or an open quantified group."""
    return unfold(files, keys, regex_literal_hits(F.col(text)))


def regex_literal_hits(text: Column) -> Column:
    """A line is cut at slashes that are not escaped; what lies between two cuts is a literal.

    This takes linear time, whereas the usual nested expression backtracks without bound on long lines.
    """
    risky = F.lit(r"(?s)([*+?]\\\{.*\\\}|[*+?]{2,}|\\\\?.+\\.*[+*])$")

    def of_line(line: Column, i: Column) -> Column:
        def of_pieces(p: Column) -> Column:
            inner = F.slice(p, F.lit(2), F.greatest(F.size(p) - 2, F.lit(0)))
            return F.transform(F.filter(inner, lambda x: F.rlike(x, risky)), lambda x: hit("JS106", line_start=i + 1, matched_text=x))

        return F.when(line.contains("/"), let(F.split(line, r"(?<!\\)/", -1), of_pieces)).otherwise(no_hits())

    return F.when(text.contains("/"), F.flatten(F.transform(split_lines(text, "universal"), of_line)))


def latest_tag_only() -> Column:
    """DOCKER001 keeps a base image only if it names no tag or ``latest``."""
    return (F.col("_rule_id") != "DOCKER001") | ~F.regexp_extract(
        "_s.matched", r"^FROM\s+([^: ]+)(:latest)?($|\s)", 1
    ).contains(":")


#: The same test on the matches of one_pass.
LATEST_TAG_ONLY = (
    "q.info.id <> 'DOCKER001' OR NOT contains(regexp_extract(s.matched, '^FROM\\\\s+([^: ]+)(:latest)?($|\\\\s)', 1), ':')"
)


def pack_dockerfile(files: DataFrame, keys: Sequence[str] = KEYS, text: str = "text", **options) -> DataFrame:
    """All Dockerfile rules: patterns, missing USER and HEALTHCHECK, old base images, sensitive copies."""
    entries = [*pack_entries(config.DOCKERFILE), *pack_entries(config.CONTAINER)]
    hits = match_content(files, entries, keys=keys, text=text, keep=latest_tag_only(), **options)
    return hits.unionByName(dockerfile_checks(files, keys, text), allowMissingColumns=True)


def dockerfile_checks(files: DataFrame, keys: Sequence[str] = KEYS, text: str = "text") -> DataFrame:
    """The Dockerfile checks that are no single pattern, in one pass over the instructions of a file."""
    return unfold(files, keys, dockerfile_hits(F.col(text)))


def dockerfile_hits(text: Column) -> Column:
    def placed(rule, line, column, matched):
        return hit(rule, line_start=line, line_end=line, column_start=column, matched_text=matched)

    def absent(pattern, rule, folded, word):
        # where the word of a pattern is missing the pattern is not searched for
        return F.when(~(folded.contains(word) & F.rlike(text, F.lit(pattern))), placed(rule, F.lit(1), None, None))

    def of_line(raw, i):
        def of_instruction(line):
            return F.array_compact(F.array(
                F.when(_copies_sensitive(line), placed("DOCKERFILE_COPYING_SENSITIVE_FILES", i + 1, F.lit(1), line)),
                F.when(
                    line.startswith("FROM ") & base_image(line).isin(*config.OUTDATED_BASE_IMAGES),
                    placed("DOCKERFILE_VULNERABLE_BASE_IMAGE", i + 1, F.lit(1), base_image(line)),
                ),
            ))

        return F.when(
            any_of([raw.contains(word) for word in ("COPY ", "ADD ", "FROM ")]),
            let(F.regexp_replace(raw, r"^\s+|\s+$", ""), of_instruction),
        ).otherwise(no_hits())

    missing = F.array_compact(F.array(
        absent(r"(?m)^USER\s", "DOCKER003", text, "USER"),
        absent(r"(?i)HEALTHCHECK", "DOCKERFILE_NO_HEALTHCHECK", F.lower(text), "healthcheck"),
    ))
    return F.concat(missing, F.flatten(F.transform(split_lines(text, "universal"), of_line)))


def missing_directive(files: DataFrame, pattern: str, rule_id: str, keys: Sequence[str] = KEYS, text: str = "text") -> DataFrame:
    """Files in which nothing matches. A file is one row, so this is a filter and needs no grouping."""
    return files.where(~F.rlike(F.col(text), F.lit(pattern))).select(
        *keys, F.lit(rule_id).alias("rule_id"), F.lit(1).alias("line_start"), F.lit(1).alias("line_end")
    )


def _instructions(files: DataFrame, keys, text: str, heads: tuple[str, ...]) -> DataFrame:
    lines = explode_lines(files.where(any_of([F.col(text).contains(h) for h in heads])), keys, text, "universal")
    line = F.regexp_replace("line", r"^\s+|\s+$", "")
    return lines.select(*keys, "line_no", line.alias("line")).where(any_of([F.col("line").startswith(h) for h in heads]))


def _copies_sensitive(line: Column) -> Column:
    pattern = "(?i)" + "|".join(config.SENSITIVE_COPY_PATTERNS)
    return (line.startswith("COPY ") | line.startswith("ADD ")) & F.rlike(line, F.lit(pattern))


def base_image(line: Column) -> Column:
    """Image of a FROM line, without its alias."""
    image = F.trim(F.substring(line, F.lit(6), F.length(line)))
    return F.when(F.upper(image).contains(" AS "), F.trim(F.substring_index(image, " AS ", 1))).otherwise(image)


def sensitive_copy(files: DataFrame, keys: Sequence[str] = KEYS, text: str = "text") -> DataFrame:
    """COPY and ADD lines that touch a sensitive path."""
    return _instructions(files, keys, text, ("COPY ", "ADD ")).where(_copies_sensitive(F.col("line"))).select(
        *keys, F.lit("DOCKERFILE_COPYING_SENSITIVE_FILES").alias("rule_id"), F.col("line_no").alias("line_start"),
        F.col("line_no").alias("line_end"), F.lit(1).alias("column_start"), F.col("line").alias("matched_text"),
    )


def pinned_image_check(files: DataFrame, keys: Sequence[str] = KEYS, text: str = "text") -> DataFrame:
    """FROM lines with a base image past its support date. The list is a fixed handful, so it is a literal."""
    image = base_image(F.col("line")).alias("image")
    return _instructions(files, keys, text, ("FROM ",)).select(*keys, "line_no", image).where(
        F.col("image").isin(*config.OUTDATED_BASE_IMAGES)
    ).select(
        *keys, F.lit("DOCKERFILE_VULNERABLE_BASE_IMAGE").alias("rule_id"), F.col("line_no").alias("line_start"),
        F.col("line_no").alias("line_end"), F.lit(1).alias("column_start"), F.col("image").alias("matched_text"),
    )


def pack_npm(files: DataFrame, keys: Sequence[str] = KEYS, **options) -> DataFrame:
    return match_content(files, config.NPM, keys=keys, **options)


def pack_pip(files: DataFrame, keys: Sequence[str] = KEYS, **options) -> DataFrame:
    return match_content(files, config.PIP, keys=keys, **options)


def pack_yaml(files: DataFrame, keys: Sequence[str] = KEYS, by_extension: bool = True, **options) -> DataFrame:
    return _content(config.YAML, files, keys, by_extension, **options)


def pack_toml(files: DataFrame, keys: Sequence[str] = KEYS, by_extension: bool = True, **options) -> DataFrame:
    return _content(config.TOML, files, keys, by_extension, **options)


def pack_browser_theft(
    files: DataFrame, keys: Sequence[str] = KEYS, by_extension: bool = True, off: Sequence[str] = (), **options
) -> DataFrame:
    """Browser data theft; ``off`` switches groups off (history, storage, credential, extension)."""
    pack = threats.BROWSER_THEFT.without_groups(*off)
    return _content(pack, files, keys, by_extension, snippet=options.pop("snippet", "context"), **options)


def pack_crypto_wallet(
    files: DataFrame, keys: Sequence[str] = KEYS, by_extension: bool = True, off: Sequence[str] = (), **options
) -> DataFrame:
    """Wallet theft; ``off`` switches groups off (wallet_file, private_key, seed_phrase, crypto_api, address)."""
    pack = threats.CRYPTO_WALLET.without_groups(*off)
    return _content(pack, files, keys, by_extension, snippet=options.pop("snippet", "context"), **options)


def pack_prompt_injection(files: DataFrame, keys: Sequence[str] = KEYS, by_extension: bool = False, **options) -> DataFrame:
    return _lines(prompts.PROMPT_INJECTION, files, keys, by_extension, **options)


def pack_mcp(files: DataFrame, keys: Sequence[str] = KEYS, by_extension: bool = False, **options) -> DataFrame:
    return _content(prompts.MCP, files, keys, by_extension, **options)


def pack_model_api(files: DataFrame, keys: Sequence[str] = KEYS, by_extension: bool = False, **options) -> DataFrame:
    return _content(prompts.MODEL_API, files, keys, by_extension, **options)


def pack_indirect_injection(files: DataFrame, keys: Sequence[str] = KEYS, name: str | None = "name", **options) -> DataFrame:
    """Indirect injection in documentation files; ``name=None`` takes every text as documentation."""
    if name is not None:
        low = F.lower(name)
        words = any_of([low.contains(w) for w in prompts.DOCUMENTATION_WORDS])
        files = files.where(low.isin(*prompts.DOCUMENTATION_FILES) | words)
    return match_content(files, prompts.INDIRECT, keys=keys, **options)


def pack_jailbreak(files: DataFrame, keys: Sequence[str] = KEYS, text: str = "text") -> DataFrame:
    """Every occurrence of a trigger phrase, overlapping ones too, with its line and column (from 0)."""
    return unfold(files, keys, jailbreak_hits(text)).select(*keys, "rule_id", "line_start", "column_start", "matched_text")


def jailbreak_hits(text: str = "text") -> Column:
    """The text is cut in front of each occurrence. A blank put before it keeps the first piece from being empty, which
    a split at a lookahead would drop. Where lines begin is added up once per text.
    """
    triggers = ", ".join(f"if(contains(low, {sql_literal(t.lower())}), {sql_literal(t)}, null)" for t in prompts.JAILBREAK_TRIGGERS)
    begins = running_sql("transform(split(low, '\\n', -1), x -> length(x) + 1)", "sum")
    before = "transform(slice(pieces, 1, size(pieces) - 1), p -> {})"
    lines, stops = (running_sql(before.format(f), "sum") for f in ("regexp_count(p, '\\n')", "length(p)"))
    column = "stop - if(line > 0, get(begins, line - 1), 1)"
    one = hit_sql(rule_id="'JAILBREAK'", line_start="line + 1", column_start=column, matched_text="trigger")
    of_trigger = let_sql(
        "pieces", "split(low, concat('(?=\\\\Q', lower(trigger), '\\\\E)'), -1)", f"zip_with({lines}, {stops}, (line, stop) -> {one})"
    )
    every = let_sql("begins", begins, f"flatten(transform(triggers, trigger -> {of_trigger}))")
    some = let_sql("triggers", f"array_compact(array({triggers}))", f"if(size(triggers) > 0, {every}, {NO_HITS_SQL})")
    return F.expr(let_sql("low", f"concat(' ', lower({text}))", some))


def hidden_base64_instructions(files: DataFrame, keys: Sequence[str] = KEYS, text: str = "text") -> DataFrame:
    """Base64 runs that decode to text with an instruction word."""
    rows = files.select(*keys, F.explode_outer(_hidden_runs(text)).alias("_s")).where(F.col("_s").isNotNull())
    return rows.select(
        *keys, F.lit("HIDDEN_BASE64").alias("rule_id"), F.col("_s.line").alias("line_start"),
        F.col("_s.matched").alias("matched_text"), F.col("_s.decoded").alias("decoded"),
    )


def hidden_base64_hits(text: str = "text") -> Column:
    return F.transform(_hidden_runs(text), lambda s: hit("HIDDEN_BASE64", line_start=s["line"], matched_text=s["matched"]))


def _hidden_runs(text: str) -> Column:
    def decoded(run: Column) -> Column:
        return F.replace(F.make_valid_utf8(F.try_to_binary(run, F.lit("base64")).cast("string")), F.lit("�"), F.lit(""))

    # a run of another length has no valid padding
    runs = F.filter(match_spans(text, sql_literal(prompts.BASE64_RUN)), lambda s: F.length(s["matched"]) % 4 == 0)
    told = F.transform(runs, lambda s: F.struct(s["line"].alias("line"), s["matched"].alias("matched"), decoded(s["matched"]).alias("decoded")))
    return F.filter(told, lambda s: any_of([F.lower(s["decoded"]).contains(w) for w in prompts.HIDDEN_KEYWORDS]))


def encoded_payloads(files: DataFrame, language: str = "python", keys: Sequence[str] = KEYS, by_extension: bool = False, **options) -> DataFrame:
    """Quoted base64 and hex runs per line."""
    return _lines(code.encoded_pack(language), files, keys, by_extension, skip_comments=language == "shell", **options)


def url_mentions(files: DataFrame, language: str = "python", keys: Sequence[str] = KEYS, by_extension: bool = False, **options) -> DataFrame:
    """Quoted addresses per line."""
    return _lines(code.url_pack(language), files, keys, by_extension, skip_comments=language == "shell", **options)


def detect_secrets(files: DataFrame, keys: Sequence[str] = KEYS, **options) -> DataFrame:
    return match_content(files, secrets.SECRETS, keys=keys, **options)


def path_traversal(files: DataFrame, keys: Sequence[str] = KEYS, **options) -> DataFrame:
    return match_content(files, characters.TRAVERSAL, keys=keys, **options)


def command_injection_chars(files: DataFrame, keys: Sequence[str] = KEYS, sensitivity: str = "medium", **options) -> DataFrame:
    """Shell metacharacters, at medium sensitivity and above."""
    if sensitivity not in ("medium", "high"):
        files = files.where(F.lit(False))
    return match_content(files, characters.COMMAND_CHARS, keys=keys, **options)


def rules_table(spark: SparkSession) -> DataFrame:
    """All rules as a dimension table."""
    rows = [
        (r.rule_id, p.name, p.analyzer, r.scope, r.title, r.severity, r.severity_rank, r.type, r.pattern, r.flags,
         float(r.confidence), r.cwe_id, r.cvss_score, list(r.tags), r.advice)
        for p in PACKS.values() for r in p.rules
    ]
    return spark.createDataFrame(
        rows,
        "rule_id string, pack string, analyzer string, scope string, title string, severity string, severity_rank int, "
        "type string, pattern string, flags string, confidence double, cwe_id string, cvss_score double, "
        "tags array<string>, remediation string",
    )
