"""The operators over the given tables with production parameters, and the same questions in SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vigilake.llm import (
    exact_dedup, hard_negatives, itq_dedup, line_dedup, merkle, mixing, nearest, pii, quality, sentencepiece_wfst, sharding, simhash, url_filter,
)
from vigilake.llm.common import LOWER, UPPER, WORD, word_count
from vigilake.session import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
WEIGHTS = [5.0, 2.0, 1.0]
MAY_LEARN_REMAINDERS = (0, 1, 3)


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def documents(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "documents")


# --- 1 sharding ---------------------------------------------------------------------------------------------------------

@query("op1_sharding")
def op1(s: SparkSession, d: str) -> DataFrame:
    """Law ``bytes``: a record's slot follows its text, so equal texts share a shard unless they are too many for one."""
    text = F.col("text")
    records, _ = sharding.shard_records(
        documents(s, d), text, F.coalesce(F.octet_length(text), F.lit(0)) + 1, 16, sharding.SLOTS, F.crc32(F.coalesce(text, F.lit(""))),
    )
    return records.select(
        "doc_id", "size", F.col("_c0").cast("long").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        F.col("position").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
    )


# --- 2 URL filters ------------------------------------------------------------------------------------------------------

def page_captures(s: SparkSession, d: str) -> DataFrame:
    """Pages as captures, fetched in the course of 2024."""
    at = F.make_interval(days=(F.col("page_id") * 7919 % 366).cast("int"), hours=(F.col("page_id") % 24).cast("int"))
    return read_table(s, d, "pages").select(
        F.col("page_id").alias("capture_id"), "url", (F.lit("2024-01-01 00:00:00").cast("timestamp") + at).alias("fetched_at")
    )


def _digit(key: str, first: int, count: int) -> Column:
    return F.conv(F.substring(F.md5(key), first, count), 16, 10).cast("int")


def list_entries(s: SparkSession, d: str) -> DataFrame:
    """Three lists over the hosts and folders that the pages have: which are listed, and when, follows their names."""
    urls = read_table(s, d, "pages").select("url")
    places = urls.select(url_filter.url_host(F.col("url")).alias("host"), url_filter.url_path(F.col("url")).alias("path")).where("host is not null")
    hosts = places.select(F.col("host").alias("key")).distinct()
    folders = places.select(F.concat("host", F.lit("/"), F.regexp_extract("path", "^/([^/]+)", 1)).alias("key")).where("key not like '%/'").distinct()
    domains = places.select(F.substring_index("host", ".", -2).alias("key")).distinct()
    rows = []
    for name, keys, spread, verdicts in (
        ("hosts", hosts, 2, ("block", "remove", "block")), ("folders", folders, 3, ("allow", "block")), ("domains", domains, 2, ("block", "remove")),
    ):
        listed = keys.where(_digit("key", 1, 4) % spread == 0)
        for i, verdict in enumerate(verdicts):
            day = _digit("key", 5, 3) % 90 + 100 * i
            rows.append(listed.select(
                F.lit(name).alias("list"), "key", F.lit(verdict).alias("verdict"),
                (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(days=day)).alias("dated"),
            ))
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


_HOST = (
    "nullif(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(regexp_extract(regexp_replace(trim(url), "
    "'^[A-Za-z][A-Za-z0-9+.-]*://|^//', ''), '^[^/?#]*', 0), '^.*@', ''), ':[0-9]*$', '')), '\\.+$', ''), '^www\\.', ''), '')"
)
_PATH = "coalesce(nullif(regexp_extract(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://|^//', ''), '^[^/?#]*([^?#]*)', 1), ''), '/')"
_ENTRY_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS list, key, '{verdict}' AS verdict, TIMESTAMP '2024-01-01' + to_days(CAST(('0x' || md5(key)[5:7])::INT % 90 + {100 * i} AS INTEGER)) AS dated "
    f"FROM {keys} WHERE ('0x' || md5(key)[1:4])::INT % {spread} = 0"
    for name, keys, spread, verdicts in (
        ("hosts", "hosts_", 2, ("block", "remove", "block")), ("folders", "folders_", 3, ("allow", "block")), ("domains", "domains_", 2, ("block", "remove")),
    )
    for i, verdict in enumerate(verdicts)
)


@query("op2_url_filters", f"""
WITH seen AS (SELECT DISTINCT page_id AS capture_id, url, {_HOST} AS host, {_PATH} AS path,
    TIMESTAMP '2024-01-01' + to_days(CAST(page_id * 7919 % 366 AS INTEGER)) + to_hours(page_id % 24) AS fetched_at FROM pages),
hosts_ AS (SELECT DISTINCT host AS key FROM seen WHERE host IS NOT NULL),
folders_ AS (SELECT DISTINCT host || '/' || regexp_extract(path, '^/([^/]+)', 1) AS key FROM seen
    WHERE host IS NOT NULL AND regexp_extract(path, '^/([^/]+)', 1) <> ''),
domains_ AS (SELECT DISTINCT array_to_string(string_split(host, '.')[greatest(len(string_split(host, '.')) - 1, 1):], '.') AS key FROM seen WHERE host IS NOT NULL),
entries AS ({_ENTRY_SQL}),
spans AS (SELECT *, coalesce(lead(dated) OVER (PARTITION BY list, key ORDER BY dated), TIMESTAMP '9999-12-31') AS valid_to FROM entries),
parts AS (SELECT *, string_split(host, '.') AS labels, list_filter(string_split(path, '/'), lambda x: x <> '') AS dirs FROM seen WHERE host IS NOT NULL),
keys AS (SELECT DISTINCT capture_id, fetched_at, url, key FROM (
    SELECT capture_id, fetched_at, url, array_to_string(labels[i:], '.') AS key FROM parts, unnest(range(1, len(labels) + 1)) AS t(i)
    UNION ALL SELECT capture_id, fetched_at, url, host || '/' || array_to_string(dirs[1:i], '/') FROM parts, unnest(range(1, len(dirs) + 1)) AS t(i))),
met AS (SELECT k.*, s.list, s.verdict, s.dated, count(*) OVER (PARTITION BY capture_id, fetched_at, url) AS n_active, row_number() OVER (
    PARTITION BY capture_id, fetched_at, url ORDER BY length(k.key) DESC, (s.verdict = 'block') DESC, dated DESC, list DESC, k.key DESC) AS place
  FROM keys k JOIN spans s ON k.key = s.key AND dated <= fetched_at AND fetched_at < valid_to WHERE s.verdict <> 'remove')
SELECT seen.capture_id, seen.url, seen.fetched_at, seen.host, coalesce(met.verdict, 'none') AS verdict, met.list, met.key,
  met.dated AS valid_from, coalesce(n_active, 0) AS n_active
FROM seen LEFT JOIN met ON seen.capture_id = met.capture_id AND seen.fetched_at = met.fetched_at AND seen.url = met.url AND place = 1
""")
def op2(s: SparkSession, d: str) -> DataFrame:
    return url_filter.judge_captures(page_captures(s, d), list_entries(s, d))


# --- 3 line dedup -------------------------------------------------------------------------------------------------------

_WS_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query("op3_line_dedup", f"""
WITH lines AS (SELECT doc_id, nr, i, parts[i] AS line, translate(trim(parts[i], {_WS_SQL}), '{UPPER}', '{LOWER}') AS key
  FROM (SELECT doc_id, row_number() OVER () AS nr, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents), unnest(range(1, len(parts) + 1)) AS t(i)),
often AS (SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT nr) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE o.key IS NOT NULL) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE o.key IS NULL), '')) AS kept_sha256
FROM lines l LEFT JOIN often o ON l.key = o.key GROUP BY nr, doc_id
""")
def op3(s: SparkSession, d: str) -> DataFrame:
    kept = line_dedup.drop_frequent_lines(documents(s, d), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


# --- 4 nearest neighbours -----------------------------------------------------------------------------------------------

@query("op4_nearest")
def op4(s: SparkSession, d: str) -> DataFrame:
    return nearest.nearest(read_table(s, d, "embeddings"), every=100, k=10)


# --- 5 mixing -----------------------------------------------------------------------------------------------------------

_HASH_SQL = "('0x' || md5(CAST(doc_id AS VARCHAR))[1:15])::BIGINT"


@query("op5_mixing", f"""
WITH docs AS (SELECT doc_id, source, {_HASH_SQL} AS h,
    CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)]::DOUBLE AS w
  FROM docs GROUP BY source),
ordered AS (SELECT *, coalesce(sum(2.0 * source_size) OVER o, 0)::DOUBLE AS full_, sum(w) OVER (ORDER BY 2.0 * source_size / w DESC, source NULLS FIRST) AS open_,
    1.5 * sum(source_size) OVER () AS budget FROM sources
    WINDOW o AS (ORDER BY 2.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT max((budget - full_) / open_) AS lvl FROM ordered WHERE (budget - full_) / open_ * w <= 2.0 * source_size),
goals AS (SELECT source, source_size, least(2.0 * source_size, w * lvl)::DOUBLE AS target,
    CASE WHEN source_size > 0 THEN CAST(floor(least(2.0 * source_size, w * lvl) / source_size) AS BIGINT) ELSE 0 END AS passes FROM sources, level),
sums AS (SELECT source, h, sum(size) AS bytes FROM docs GROUP BY source, h),
upto AS (SELECT *, sum(bytes) OVER (PARTITION BY source ORDER BY h) AS upto FROM sums),
cuts AS (SELECT g.source, min_by(CASE WHEN upto - (target - passes * source_size) < (target - passes * source_size) - (upto - bytes) THEN h + 1 ELSE h END, h) AS cut
  FROM upto u JOIN goals g ON u.source IS NOT DISTINCT FROM g.source WHERE upto > target - passes * source_size GROUP BY g.source),
plan AS (SELECT g.*, CASE WHEN target - passes * source_size <= 0 THEN 0 ELSE coalesce(cut, 1::BIGINT << 60) END AS cut
  FROM goals g LEFT JOIN cuts c ON g.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, d.source, size, source_size, target, size * (passes + CASE WHEN h < cut THEN 1 ELSE 0 END) AS taken,
  passes + CASE WHEN h < cut THEN 1 ELSE 0 END AS copies FROM docs d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source
""")
def op5(s: SparkSession, d: str) -> DataFrame:
    mixed = mixing.mix(documents(s, d), word_count("text"), WEIGHTS, total=1.5, most=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


# --- 6 personal data ----------------------------------------------------------------------------------------------------

def _span_sql(kind: pii.Kind) -> str:
    """Confirmed spans of a kind, from the pattern as the contract has it."""
    p = "'" + kind.pattern + "'"
    digits = "regexp_replace(x, '[^0-9]', '', 'g')"
    luhn = (
        "list_sum(list_transform(string_split(reverse(DIGITS_), ''), lambda c, i: CAST(CASE WHEN i % 2 = 1 THEN c "
        "ELSE translate(c, '0123456789', '0246813579') END AS INTEGER))) % 10 = 0"
    ).replace("DIGITS_", digits)
    mod97 = (
        "list_reduce(list_prepend(0, list_transform(string_split(x[5:] || x[1:4], ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' "
        "THEN CAST(c AS INTEGER) ELSE ascii(c) - 55 END)), lambda a, v: CASE WHEN v < 10 THEN (a * 10 + v) % 97 ELSE (a * 100 + v) % 97 END) = 1"
    )
    valid = {
        "email": "true", "ip": "list_max(list_transform(string_split(x, '.'), lambda o: TRY_CAST(o AS HUGEINT))) <= 255",
        "card": f"length({digits}) BETWEEN 16 AND 19 AND {luhn}", "phone": f"length({digits}) BETWEEN 8 AND 15", "iban": mod97,
        "ssn": "NOT (regexp_matches(x, '^(000|666|9)') OR x LIKE '%-00-%' OR x LIKE '%-0000')",
    }[kind.name]
    near = f"translate(txt[greatest(start - {pii.REACH}, 0) + 1:start] || ' ' || txt[stop + 1:stop + {pii.REACH}], '{UPPER}', '{LOWER}')"
    score = f"least(100, {kind.score} + CASE WHEN regexp_matches({near}, '{'|'.join(kind.words)}') THEN {pii.CONTEXT_BONUS} ELSE 0 END)"
    place = [k.name for k in pii.KINDS].index(kind.name)
    spans = f"""
SELECT doc_id, txt, m[k] AS x, CAST(coalesce(list_sum(list_transform(g[1:k], lambda y: length(y))), 0)
    + coalesce(list_sum(list_transform(m[1:k-1], lambda y: length(y))), 0) AS BIGINT) AS start, start + length(m[k]) AS stop
FROM (SELECT doc_id, txt, regexp_extract_all(txt, {p}) AS m, regexp_split_to_array(txt, {p}) AS g FROM texts), unnest(range(1, len(m) + 1)) AS t(k)"""
    return (
        f"SELECT doc_id, {place} AS place, '{kind.name}' AS kind, start, stop, {score} AS score FROM ({spans}) WHERE {valid}"
        + ("" if kind.base else f" AND score >= {pii.REPORT_AT}")
    )


@query("op6_pii", f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS txt FROM documents),
spans AS ({" UNION ALL ".join(_span_sql(k) for k in pii.KINDS)})
SELECT t.doc_id, {", ".join(f"count(*) FILTER (WHERE kind = '{k.name}') AS n_{k.name}" for k in pii.KINDS if k.base)},
  sha256(coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY place, start) FILTER (WHERE place < 4), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY place, start), '') AS spans,
  coalesce(string_agg(CAST(score AS VARCHAR), ',' ORDER BY place, start), '') AS scores
FROM texts t LEFT JOIN spans s ON t.doc_id = s.doc_id GROUP BY t.doc_id
""")
def op6(s: SparkSession, d: str) -> DataFrame:
    names = [k.name for k in pii.KINDS]
    base = [k.name for k in pii.KINDS if k.base]
    found = pii.personal_data(documents(s, d))
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in base], F.sha2(pii.span_text(*base), 256).alias("base_sha256"),
        pii.span_text(*names).alias("spans"), F.array_join(F.flatten(F.array(*[F.transform(k, lambda x: x["score"].cast("string")) for k in names])), ",").alias("scores"),
    )


# --- 7 exact dedup ------------------------------------------------------------------------------------------------------

@query("op7_exact_dedup", """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
  sha256(coalesce(text, '')) AS text_sha256, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
""")
def op7(s: SparkSession, d: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(s, d)).drop("n_chunks")


# --- 8 SentencePiece ----------------------------------------------------------------------------------------------------

@query("op8_sentencepiece")
def op8(s: SparkSession, d: str) -> DataFrame:
    """Digest of the pieces of every text and of the text they give back."""
    model = sentencepiece_wfst.load_model(s, PIECE_MODEL)
    back = sentencepiece_wfst.decode(sentencepiece_wfst.encode(documents(s, d), model), model)
    return back.select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("decoded_sha256"),
    )


# --- 9 near duplicates --------------------------------------------------------------------------------------------------

@query("op9_simhash")
def op9(s: SparkSession, d: str) -> DataFrame:
    groups = simhash.near_groups(documents(s, d), words=3, distance=3)
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# --- 10 quality ---------------------------------------------------------------------------------------------------------

def remainder() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 4


@query("op10_quality")
def op10(s: SparkSession, d: str) -> DataFrame:
    found = quality.quality_scores(documents(s, d), read_table(s, d, "labels"), may_learn=remainder().isin(*MAY_LEARN_REMAINDERS))
    return found.select("doc_id", F.coalesce(remainder() == 2, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


# --- 11 near duplicates among embeddings --------------------------------------------------------------------------------

_FINITE_SQL = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


@query("op11_embedding_near_dedup", f"""
WITH RECURSIVE rows_ AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
usable AS (SELECT vec_id, v FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE {_FINITE_SQL}) WHERE len(list_filter(v, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
reach AS (SELECT vec_id AS node, vec_id AS seen FROM rows_ UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.seen = l.a),
least AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM rows_ JOIN least ON vec_id = node LEFT JOIN counts ON vec_id = a
""")
def op11(s: SparkSession, d: str) -> DataFrame:
    return itq_dedup.near_copies(read_table(s, d, "embeddings"), cosine=0.9)


# --- 12 hard negatives --------------------------------------------------------------------------------------------------

@query("op12_hard_negatives", f"""
WITH rows_ AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings WHERE label IS NOT NULL AND {_FINITE_SQL}),
scored AS MATERIALIZED (SELECT a.vec_id AS anchor_id, a.label = c.label AS alike, c.vec_id, CAST(list_inner_product(a.x, c.x) AS BIGINT) AS score
  FROM rows_ a JOIN rows_ c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
ranked AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.alike AND 100 * s.score BETWEEN 50 * positive_score AND 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3
""")
def op12(s: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(read_table(s, d, "embeddings"), label, every=50, positives=5, negatives=3, low=50, high=95)


# --- 13 Merkle manifest -------------------------------------------------------------------------------------------------

LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(**instead: Column) -> Column:
    """Digest of a record: each column as byte count, colon and value, or a dash if null."""
    values = [instead.get(c, F.col(c)).cast("string") for c in LEAF_COLUMNS]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]), 256)


def _leaf_sql(text: str) -> str:
    values = [f"CAST({c} AS VARCHAR)" for c in LEAF_COLUMNS[:-1]] + [text]
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"


def _tree_sql(name: str, leaves: str, tree: str, levels: int) -> str:
    """Levels ``name``0... of the trees over ``leaves`` (tree, pos, h), each node with its siblings left and right of it."""
    out, before = [], leaves
    for i in range(levels + 1):
        out.append(f"""{name}{i} AS MATERIALIZED (SELECT *, total > 1 AS live, coalesce(string_agg(h, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS pre,
  coalesce(string_agg(h, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS post
  FROM (SELECT {tree} AS tree, pos, h, count(*) OVER (PARTITION BY {tree}) AS total FROM {before}) WINDOW run AS (PARTITION BY tree, pos // 3 ORDER BY pos))""")
        out.append(f"""{name}{i}up AS MATERIALIZED (SELECT tree, pos // 3 AS pos, CASE WHEN max(total) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE max(h) END AS h
  FROM {name}{i} GROUP BY tree, pos // 3)""")
        before, tree = f"{name}{i}up", "tree"
    return ",\n".join(out)


def _climb_sql(name: str, rows: str, tree: str, levels: int) -> str:
    """``name``0... : rows with (digest, proof) carried up over the levels of the trees."""
    out, before = [], rows
    for i in range(levels):
        out.append(f"""{name}{i} AS MATERIALIZED (SELECT r.* REPLACE (CASE WHEN live THEN sha256(pre || r.digest || post) ELSE r.digest END AS digest,
  CASE WHEN live THEN r.proof || pre || post ELSE r.proof END AS proof, r.spot // 3 AS spot) FROM {before} r JOIN {tree}{i} t ON r.tree IS NOT DISTINCT FROM t.tree AND r.spot = t.pos)""")
        before = f"{name}{i}"
    return ",\n".join(out)


#: CRC32 of the decimal doc_id, a byte and a bit at a time.
_CRC_SQL = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), "
    "lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, i: xor(c >> 1, (c & 1) * 3988292384::BIGINT))), 4294967295::BIGINT)"
)
_DEEP, _WIDE = 14, 6  # levels that the SQL has: 3^14 documents of a source, 3^6 sources


@query("op13_merkle_manifest", f"""
WITH leaves AS MATERIALIZED (SELECT doc_id, source, {_leaf_sql("text")} AS h,
    CASE WHEN {_CRC_SQL} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} END AS tampered FROM documents),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS pos FROM leaves),
{_tree_sql("t", "placed", "source", _DEEP)},
subroots AS MATERIALIZED (SELECT tree AS source, h AS subroot, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS pos, h FROM t{_DEEP}),
{_tree_sql("u", "subroots", "0", _WIDE)},
start AS (SELECT doc_id, source AS tree, h AS leaf, coalesce(tampered, h) AS digest, '' AS proof, pos AS spot FROM placed),
{_climb_sql("c", "start", "t", _DEEP)},
moved AS (SELECT c.doc_id, 0 AS tree, c.leaf, c.digest, c.proof, s.pos AS spot, s.subroot FROM c{_DEEP - 1} c JOIN subroots s ON c.tree IS NOT DISTINCT FROM s.source),
{_climb_sql("d", "moved", "u", _WIDE)}
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, digest AS folded_root, digest = root AS verified
FROM d{_WIDE - 1}, (SELECT h AS root FROM u{_WIDE})
""")
def op13(s: SparkSession, d: str) -> DataFrame:
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, leaf_digest(text=F.replace("text", F.lit("\n"), F.lit(""))))
    found, _, _ = merkle.manifest(documents(s, d), F.col("source"), F.col("doc_id"), leaf_digest(), tampered)
    return found.withColumnRenamed("key", "doc_id")
