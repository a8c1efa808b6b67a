"""Registered queries of the training-data operators, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_ids, conversation_repair, host_rules, lm_score, mixing, near_dups, packing, phrases, quotes, repeats, spots, toxicity, url_filter
from .common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


@_query("op1_byte_ids")
def byte_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_ids.round_trip(documents(spark, sf_dir), "byte_bpe_50k.json", end_id=2)


@_query("op2_quote_links")
def reply_ordered_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.reply_ordered(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


@_query("op3_toxicity")
def toxic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    learned = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(~toxicity.held_out())
    model = toxicity.train(docs, learned)
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


@_query("op4_packing")
def packed_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), "word_bpe_49k.json", end_id=2).drop("ids")


_MIX_SQL = r"""
WITH sized AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
sources AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
        [3, 1, 2][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS BIGINT)] AS weight
    FROM sized GROUP BY source),
caps AS (SELECT *, source_size * 2.0::DOUBLE AS cap FROM sources),
levels AS (
    SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER before, 0)) /
        (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
    FROM caps
    WINDOW before AS (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
filled AS (
    SELECT source, source_size,
        CASE WHEN cap <= weight * level THEN cap ELSE weight * max(CASE WHEN cap > weight * level THEN level END) OVER () END AS target
    FROM levels),
plan AS (
    SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS repeats FROM filled),
placed AS (
    SELECT doc_id, size, s.source, source_size, target, repeats,
        CAST(floor(target + 0.5) AS BIGINT) - repeats * source_size - coalesce(CAST(sum(size) OVER (
            PARTITION BY s.source ORDER BY md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id NULLS FIRST, size
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS room
    FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST(repeats * size + greatest(0, least(size, room)) AS BIGINT) AS taken FROM placed"""


@_query("op6_mixing", _MIX_SQL)
def mixed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


_HOST_SQL = r"""
WITH split AS (
    SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
counted AS (
    SELECT r, doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM split),
windows AS (
    SELECT r, unnest(range(1, len(words) - 3)) AS i, words FROM counted WHERE len(words) >= 5),
keyed AS (SELECT r, i, array_to_string(words[i:i + 4], ' ') AS k FROM windows),
repeated AS (SELECT r, i FROM keyed QUALIFY count(*) OVER (PARTITION BY r, k) > 1),
covered AS (SELECT r, count(DISTINCT i + j) AS n FROM repeated, range(5) AS s(j) GROUP BY r),
measured AS (
    SELECT doc_id, source, CAST(len(words) AS BIGINT) AS n_words,
        CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
    FROM counted LEFT JOIN covered USING (r)),
failed AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM measured),
hosts AS (SELECT source, count(*) AS n, sum(CASE WHEN base_failed THEN 1 ELSE 0 END)::DOUBLE AS f FROM failed GROUP BY source),
prior AS (
    SELECT sum(f) / sum(n) AS m, sum(f * f / n) / sum(n) - m * m - m * (1 - m) * count(*) / sum(n) AS v,
        CASE WHEN v > 0 THEN greatest(1.0, least(1e6, m * (1 - m) / v - 1)) ELSE 1e6 END AS s
    FROM hosts),
rates AS (SELECT source, (f + m * s) / (n + s) AS rate FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate <= 0.5 AS kept
FROM failed JOIN rates ON failed.source IS NOT DISTINCT FROM rates.source"""


@_query("op7_lm_difference")
def language_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return lm_score.cross_entropy_difference(documents(spark, sf_dir), labels)


@_query("op8_host_rules", _HOST_SQL)
def host_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.apply_rules(documents(spark, sf_dir))


@_query("op5_repeated_strings")
def without_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(documents(spark, sf_dir)).drop("kept_text")


@_query("op9_near_duplicates")
def near_duplicate_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(documents(spark, sf_dir), width=2)


@_query("op10_spot_signatures")
def spot_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spots.edited_likeness(documents(spark, sf_dir))


URL_RULES = [
    url_filter.Rule("org/", "allow"), url_filter.Rule("example.org/es/", "block"), url_filter.Rule("example.org/en/1", "block"),
    url_filter.Rule("com/fr/", "allow"), url_filter.Rule("com/de/", "block")]


def _gram_sql(field: str) -> str:
    """Buckets of one field's grams; the list ``field`` holds character codes."""
    parts = []
    for size in url_filter.GRAMS:
        value = f"({url_filter._SEEDS[field] * 1000 + size})::BIGINT"
        for k in range(size):
            value = f"(({value} * {url_filter._FACTOR} + {field}_codes[i + {k}]) % {url_filter._PRIME})"
        parts.append(f"list_transform(range(1, len({field}_codes) - {size - 2}), lambda i: {value} % {url_filter.BUCKETS})")
    return ", ".join(parts)


def _split_sql(table: str, columns: str) -> str:
    """Host, path and buckets of a table's URLs."""
    return rf"""
    SELECT {columns}, host, path, flatten([{_gram_sql('host')}, {_gram_sql('path')}]) AS buckets FROM (
        SELECT *, list_transform(range(1, length(marked) + 1), lambda i: unicode(substr(marked, i, 1))::BIGINT) AS host_codes,
            list_transform(range(1, length(path) + 1), lambda i: unicode(substr(path, i, 1))::BIGINT) AS path_codes
        FROM (SELECT *, CASE WHEN host <> '' THEN '^' || host || '$' ELSE '' END AS marked FROM (
            SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM (SELECT *, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM {table}))))"""


def _rule_sql() -> str:
    ranked = sorted(URL_RULES, key=lambda r: -len(r.text))
    cases = []
    for rule in ranked:
        host, slash, path = rule.text.partition("/")
        cases.append(f"WHEN (host = '{host}' OR suffix(host, '.{host}')) AND prefix(path, '{slash}{path}') THEN '{rule.text}'")
    return "CASE " + " ".join(cases) + " END"


_URL_SQL = rf"""
WITH RECURSIVE labelled(url, label) AS (VALUES {", ".join(f"('{url}', {label}::DOUBLE)" for url, label in url_filter.LABELLED)}),
learned AS (SELECT row_number() OVER (ORDER BY host, path, label) - 1 AS i, label, buckets, sqrt(greatest(1, len(buckets))) AS norm FROM ({_split_sql('labelled', 'label')})),
cells AS (SELECT i, bucket, count(*) / any_value(norm) AS value FROM (SELECT i, norm, unnest(buckets) AS bucket FROM learned) GROUP BY i, bucket),
keyed AS (SELECT i, bucket, dense_rank() OVER (ORDER BY bucket) AS k, value FROM cells),
terms AS (SELECT i, list({{'k': k, 'v': value}} ORDER BY k) AS t FROM keyed GROUP BY i),
postings AS (SELECT k, any_value(bucket) AS bucket, list({{'i': i, 'v': value}} ORDER BY i) AS p FROM keyed GROUP BY k),
tables AS (
    SELECT (SELECT list(t ORDER BY i) FROM terms) AS terms, (SELECT list(p ORDER BY k) FROM postings) AS postings,
        (SELECT list(bucket ORDER BY k) FROM postings) AS buckets, (SELECT list(label ORDER BY i) FROM learned) AS labels),
descent AS (
    SELECT 0 AS turn, 0::DOUBLE AS intercept, list_transform(buckets, lambda b: 0::DOUBLE) AS weights, list_transform(labels, lambda b: 0::DOUBLE) AS residuals FROM tables
    UNION ALL
    SELECT turn + 1,
        CASE WHEN turn % 2 = 0 THEN intercept ELSE intercept + {url_filter.RATE} / len(labels) * list_sum(residuals) END,
        CASE WHEN turn % 2 = 0 THEN weights ELSE list_transform(postings, lambda p, k: weights[k] * (1 - {url_filter.RATE} * {url_filter.PENALTY})
            + {url_filter.RATE} / len(labels) * list_sum(list_transform(p, lambda x: x.v * residuals[x.i + 1]))) END,
        CASE WHEN turn % 2 = 1 THEN residuals ELSE list_transform(terms, lambda t, i: labels[i] - 1 / (1 + exp(-(intercept + list_sum(list_transform(t, lambda x: x.v * weights[x.k])))))) END
    FROM descent, tables WHERE turn < {2 * url_filter.STEPS}),
model AS (SELECT intercept, map_from_entries(list_zip(buckets, weights)) AS weights FROM descent, tables WHERE turn = {2 * url_filter.STEPS}),
split AS ({_split_sql('pages', 'page_id')}),
judged AS (
    SELECT page_id, host, path, {_rule_sql()} AS rule, 1 / (1 + exp(-(intercept + coalesce(list_sum(list_transform(buckets, lambda b: coalesce(weights[b], 0))), 0) / sqrt(greatest(1, len(buckets)))))) AS p
    FROM (SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, coalesce(buckets, []) AS buckets FROM split), model)
SELECT page_id, host, path, rule, CASE {" ".join(f"WHEN rule = '{r.text}' THEN '{r.verdict}'" for r in URL_RULES)} WHEN p >= {url_filter.BLOCK_FROM} THEN 'block' ELSE 'allow' END AS verdict,
    round(p, 4) AS score
FROM judged"""


@_query("op11_url_verdicts", _URL_SQL)
def url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = url_filter.train(url_filter.labelled_urls(spark))
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES, model)


_REPAIR_SQL = r"""
WITH RECURSIVE crc AS (
    SELECT list_transform(range(256), lambda n: list_reduce([n] || range(8), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS t),
plain AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
kinds AS (
    SELECT *, xor(4294967295, list_reduce([4294967295] || list_transform(range(1, length(key) + 1), lambda i: unicode(substr(key, i, 1))::BIGINT),
        lambda c, b: xor(t[xor(c, b) % 256 + 1], c // 256))) % 20 AS kind FROM plain, crc),
damaged AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text
    FROM kinds, range(CASE WHEN kind = 3 THEN 2 ELSE 1 END) WHERE kind <> 0),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS i FROM damaged),
faults AS (
    SELECT *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS ended,
        row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
rows AS (
    SELECT conv_id, turn, role, text, i, left(role, 1) AS initial, before, ended = '' AS blank, ended <> '' AND seen AS duplicate,
        ended <> '' AND NOT seen AND right(ended, 1) NOT IN ('.', '!', '?') AS truncated FROM faults),
counted AS (
    SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
        count(*) FILTER (truncated) AS truncated, count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
    FROM rows GROUP BY conv_id),
steps(conv_id, i, l) AS (
    SELECT conv_id, 0::BIGINT, [{'c': 0, 'a': ''}, {'c': 99999999, 'a': ''}, {'c': 3, 'a': 'I'}, {'c': 6, 'a': 'II'}] FROM counted
    UNION ALL
    SELECT conv_id, i, [l[1], l[2], u2, least(l[4], {'c': u2.c + 3, 'a': u2.a || 'I'})] FROM (
        SELECT conv_id, i, l, least(l[3], {'c': l[1].c + 3, 'a': l[1].a || 'I'}, {'c': l[2].c + 3, 'a': l[2].a || 'I'}, {'c': l[4].c + 3, 'a': l[4].a || 'I'}) AS u2 FROM (
            SELECT conv_id, i, [
                d[1],
                CASE WHEN stays AND initial = 's' THEN least(d[2], {'c': l[1].c + m, 'a': l[1].a || 'K'}) ELSE d[2] END,
                CASE WHEN NOT stays THEN d[3] WHEN initial = 'u' THEN least(d[3], {'c': w.c + m, 'a': w.a || 'K'}, {'c': w.c + 3 + m, 'a': w.a || 'R'})
                    ELSE least(d[3], {'c': w.c + 3 + m, 'a': w.a || 'R'}) END,
                CASE WHEN NOT stays THEN d[4] WHEN initial = 'a' THEN least(d[4], {'c': l[3].c + m, 'a': l[3].a || 'K'}, {'c': l[3].c + 3 + m, 'a': l[3].a || 'R'})
                    ELSE least(d[4], {'c': l[3].c + 3 + m, 'a': l[3].a || 'R'}) END] AS l
            FROM (
                SELECT s.conv_id, r.i, s.l, r.initial, NOT (r.blank OR r.duplicate) AS stays, CASE WHEN r.truncated THEN 3 ELSE 0 END AS m,
                    list_transform(s.l, lambda x: {'c': x.c + 4, 'a': x.a || 'D'}) AS d, least(s.l[1], s.l[2], s.l[4]) AS w
                FROM steps s JOIN rows r ON s.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = s.i + 1)))),
solved AS (
    SELECT c.*, least(s.l[1], s.l[4]) AS best FROM counted c JOIN steps s ON c.conv_id IS NOT DISTINCT FROM s.conv_id AND s.i = c.n),
walk(conv_id, audit, p, i, state, part) AS (
    SELECT conv_id, best.a, 0, 0::BIGINT, 's', CAST(NULL AS VARCHAR) FROM solved
    UNION ALL
    SELECT w.conv_id, w.audit, w.p + 1, w.i + CASE WHEN w.letter = 'I' THEN 0 ELSE 1 END,
        CASE WHEN w.letter = 'D' THEN w.state WHEN w.letter = 'K' THEN CASE r.initial WHEN 's' THEN 'x' ELSE r.initial END WHEN w.state = 'u' THEN 'a' ELSE 'u' END,
        CASE WHEN w.letter = 'D' THEN NULL WHEN w.letter = 'K' THEN r.role || ':' || r.text
            ELSE CASE WHEN w.state = 'u' THEN 'assistant:' ELSE 'user:' END || CASE WHEN w.letter = 'R' THEN r.text ELSE '' END END
    FROM (SELECT *, substr(audit, p + 1, 1) AS letter FROM walk WHERE p < length(audit)) w
    LEFT JOIN rows r ON w.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = w.i + 1),
repaired AS (SELECT conv_id, sha256(coalesce(string_agg(part, chr(10) ORDER BY p), '')) AS repaired_sha256 FROM walk GROUP BY conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
    CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(best.c, 0) AS BIGINT) AS cost,
    coalesce(best.a, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM ids LEFT JOIN solved s ON ids.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN repaired r ON ids.conv_id IS NOT DISTINCT FROM r.conv_id"""


@_query("op12_repaired_conversations", _REPAIR_SQL)
def repaired_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


_PHRASE_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (
    SELECT lang, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS phrase FROM words, range(1, 4) AS s(n)),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
runs AS (SELECT lang, n, phrase, count(*) AS f, string_split(phrase, ' ') AS w FROM grams GROUP BY lang, n, phrase HAVING count(*) >= 10),
cuts AS (
    SELECT lang, phrase, n, f AS a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:n], ' ') AS tail FROM runs, range(1, 3) AS s(k) WHERE k < n),
scored AS (
    SELECT c.lang, c.phrase, c.n, a, k, h.f AS l, t.f AS r, 1000000::HUGEINT * a * a // (h.f::HUGEINT * t.f) AS score
    FROM cuts c JOIN runs h ON c.lang = h.lang AND c.head = h.phrase JOIN runs t ON c.lang = t.lang AND c.tail = t.phrase),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_runs AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, f FROM runs WHERE n = 3),
longest AS (SELECT lang, phrase, max(f) AS longer FROM inner_runs GROUP BY lang, phrase),
ranked AS (
    SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, encode(s.phrase)) AS rank
    FROM lowest s LEFT JOIN longest g ON s.lang = g.lang AND s.phrase = g.phrase WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT r.lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, t.n, CAST(score AS BIGINT) AS score
FROM ranked r JOIN totals t ON r.lang = t.lang WHERE rank <= 2000"""


@_query("op13_collocations", _PHRASE_SQL)
def phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))
