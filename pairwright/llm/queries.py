"""The registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pairwright.llm.common import table
from pairwright.llm.decontaminate import contained_items
from pairwright.llm.licenses import TEMPLATES, license_report
from pairwright.llm.lines import LONG_SITES, LONG_WORDS, MIN_SITES, remove_boilerplate
from pairwright.llm.neardup import near_duplicates
from pairwright.llm.packing import pack
from pairwright.llm.pii import find_personal_data
from pairwright.llm.quality import fit_quality, quality_scores
from pairwright.llm.resample import BUCKETS, LEAST_WORDS, SEED, SHARE_PCT, resample
from pairwright.llm.rules import GRID, LEVEL, RISK, rule_report
from pairwright.llm.shards import shard_by_bytes
from pairwright.llm.suffixes import repeat_report
from pairwright.llm.toxicity import fit_toxicity, toxicity_scores
from pairwright.llm.whitening import whiten
from pairwright.session import ship_package

TOKENIZER = "word_bpe_49k.json"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: run(ship_package(spark), sf_dir)
        if sql is not None:
            SQL[name] = sql
        return run

    return register


_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


@_query("op1_contained_items", rf"""
WITH it AS (SELECT item_id, w, least(5, len(w)) AS width FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
     d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
     ig AS (SELECT DISTINCT item_id, width, array_to_string(w[i : i + width - 1], ' ') AS run
            FROM (SELECT item_id, width, w, unnest(range(1, len(w) - width + 2)) AS i FROM it)),
     q AS (SELECT item_id, count(*) AS q FROM ig GROUP BY item_id),
     dg AS (SELECT DISTINCT doc_id, width, array_to_string(w[i : i + width - 1], ' ') AS run
            FROM (SELECT doc_id, width, w, unnest(range(1, len(w) - width + 2)) AS i
                  FROM d, (SELECT DISTINCT width FROM ig))),
     m AS (SELECT doc_id, item_id, count(*) AS n FROM dg JOIN ig USING (width, run) GROUP BY ALL)
SELECT doc_id, item_id, n AS n_shared, q AS n_shingles, n / q AS containment
FROM m JOIN q USING (item_id) WHERE n * 100 >= q * 80
""")
def _op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query("op6_boilerplate_lines", rf"""
WITH l AS (SELECT doc_id, source, line, i FROM (
             SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
     b AS (SELECT line, min(doc_id) AS first_doc FROM l WHERE regexp_matches(line, '\S') GROUP BY line
           HAVING count(DISTINCT source) >= CASE WHEN len(regexp_extract_all(line, '\S+')) > {LONG_WORDS} THEN {LONG_SITES} ELSE {MIN_SITES} END),
     m AS (SELECT l.*, b.line IS NOT NULL AND l.doc_id <> b.first_doc AS gone FROM l LEFT JOIN b ON l.line = b.line)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text,
       count(*) FILTER (gone) AS n_removed
FROM m GROUP BY doc_id
""")
def _op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return remove_boilerplate(docs, counted="n_removed").select("doc_id", "text", "n_removed")


@_query("op7_byte_shards")
def _op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"))


@_query("op8_near_duplicates", rf"""
WITH RECURSIVE
     t AS (SELECT md5(coalesce(text, '')) AS d, min(doc_id) AS doc_id, any_value(text) AS text FROM documents GROUP BY 1),
     w AS (SELECT d, {_WORDS} AS w FROM t),
     g AS (SELECT d, run, count(*) AS c FROM (
             SELECT d, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS run
             FROM (SELECT d, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)) GROUP BY ALL),
     n AS (SELECT d, sum(c) AS n FROM g GROUP BY d),
     s AS (SELECT a.d AS x, b.d AS y, sum(least(a.c, b.c)) AS o FROM g a JOIN g b ON a.run = b.run AND a.d < b.d GROUP BY ALL),
     e AS (SELECT x, y FROM s JOIN n p ON p.d = x JOIN n q ON q.d = y WHERE o / (p.n + q.n - o) >= 0.8),
     ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
     r AS (SELECT d AS x, d AS y FROM t UNION SELECT r.x, ways.y FROM r JOIN ways ON ways.x = r.y),
     k AS (SELECT r.x AS d, min(t.doc_id) AS class_id FROM r JOIN t ON t.d = r.y GROUP BY r.x)
SELECT doc_id, class_id, doc_id = class_id AS kept FROM documents JOIN k ON k.d = md5(coalesce(text, ''))
""")
def _op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    """Where the public tokenizers package keeps the packing vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


@_query("op10_best_two_fit")
def _op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


_CUTS = ", ".join(f"('{rule}', {step}, {cut}::DOUBLE)" for rule, cuts in GRID.items() for step, cut in enumerate(cuts))


@_query("op4_risk_controlled_rules", rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text FROM documents),
     w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
                  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
     g AS (SELECT r, i, array_to_string(w[i : i + 7], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
     rep AS (SELECT r, count(DISTINCT i + k) AS n FROM (
               SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1), range(0, 8) AS o(k) GROUP BY r),
     s AS (SELECT w.r, doc_id, lang AS stratum, len(w)::BIGINT AS n_words,
                  coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
                  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(l) AS n_lines,
                  length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper
           FROM w LEFT JOIN rep ON rep.r = w.r),
     f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
                  CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbol_share,
                  CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars,
                  CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_share,
                  CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeat_word_share,
                  CASE WHEN word_chars > 0 THEN n_upper / word_chars ELSE 0 END AS upper_share FROM s),
     v AS (SELECT r, doc_id, stratum, base_failed, unnest({list(GRID)}) AS rule,
                  unnest([{", ".join(GRID)}]) AS value FROM f),
     c AS (SELECT * FROM (VALUES {_CUTS}) AS c(rule, step, cutoff)),
     u AS (SELECT min(f.r) AS r, min(quality) AS quality FROM f JOIN t ON t.r = f.r JOIN labels ON labels.doc_id = f.doc_id
           WHERE NOT base_failed AND quality IN (0, 1) GROUP BY stratum, text HAVING min(quality) = max(quality)),
     k AS (SELECT stratum, rule, step, cutoff, count(*) FILTER (quality = 1) AS good,
                  count(*) FILTER (quality = 1 AND value > cutoff) AS good_hit, count(*) FILTER (quality = 0) AS bad,
                  count(*) FILTER (quality = 0 AND value > cutoff) AS bad_hit
           FROM v JOIN u USING (r) JOIN c USING (rule) GROUP BY ALL),
     p AS (SELECT *, CASE WHEN good_hit >= good * {RISK} THEN 1 ELSE list_sum(list_transform(range(0, good_hit + 1), lambda i:
                  exp(lgamma(good + 1) - lgamma(i + 1) - lgamma(good - i + 1) + i * ln({RISK}) + (good - i) * ln({1 - RISK})))) END AS p
           FROM k),
     a AS (SELECT *, CASE WHEN bad > 0 THEN bad_hit / bad ELSE 0 END - good_hit / good AS gain FROM (
             SELECT *, max(p) OVER (PARTITION BY stratum, rule ORDER BY step) AS worst FROM p)
           WHERE worst <= {LEVEL} / ((SELECT count(*) FROM (SELECT DISTINCT stratum FROM k)) * {len(GRID)})),
     b AS (SELECT * FROM a WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY gain DESC, step) = 1),
     z AS (SELECT v.r, bool_or(coalesce(value > cutoff, false)) AS hit
           FROM v LEFT JOIN b ON b.rule = v.rule AND b.stratum IS NOT DISTINCT FROM v.stratum GROUP BY v.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT hit AS kept
FROM f JOIN z USING (r)
""")
def _op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = rule_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return report.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_TEMPLATES = ", ".join(f"({i}, '{label}', '{text}', '{naming}', '{refused}')" for i, (label, text, naming, refused) in enumerate(TEMPLATES))


def _license_words(text: str) -> str:
    return (f"list_filter(regexp_split_to_array(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
            r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')")


@_query("op9_license_join", rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
     w AS (SELECT r, doc_id, {_license_words("text")} AS w FROM d),
     p AS (SELECT r, i, CASE WHEN w[i] = 'cc' AND w[i + 1] = 'by' THEN 'cc-by'
                             WHEN w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license' THEN 'gpl'
                             WHEN w[i] = 'all' AND w[i + 1] = 'rights' AND w[i + 2] = 'reserved' THEN 'reserved' END AS label
           FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM w)),
     b AS (SELECT r, count(*) AS n, min(i) - 1 AS lo, max(i) - 1 AS hi, list_distinct(list(label)) AS labels
           FROM p WHERE label IS NOT NULL GROUP BY r),
     t AS (SELECT k, label, {_license_words("statement")} AS s, {_license_words("naming")} AS naming, {_license_words("refused")} AS refused
           FROM (VALUES {_TEMPLATES}) AS t(k, label, statement, naming, refused)),
     l AS (SELECT r, {_license_words("line")} AS b FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
           UNION ALL SELECT r, w FROM w),
     x AS (SELECT r, label, list_distinct(s) AS words, naming, refused, len(s) AS n, b, unnest(range(1, greatest(len(b) - len(s) + 1, 1) + 1)) AS i
           FROM l JOIN t ON list_has_all(b, naming)),
     y AS (SELECT r, label, words, b[i : i + n - 1] AS run FROM x WHERE list_has_all(b[i : i + n - 1], naming) AND NOT list_has_any(b[i : i + n - 1], refused)),
     m AS (SELECT r, label, len(list_intersect(words, run)) AS n, len(words) AS size FROM y WHERE len(list_intersect(words, run)) * 100 >= len(words) * 80),
     o AS (SELECT r, list_distinct(list(label)) AS own, max(n / size) AS best FROM m GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_base, lo AS first_word, hi AS last_word,
       array_to_string(list_sort(coalesce(labels, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(labels, []), coalesce(own, [])))), ',') AS labels,
       CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0) END AS score
FROM w LEFT JOIN b USING (r) LEFT JOIN o USING (r)
""")
def _op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(table(spark, sf_dir, "documents"))


@_query("op2_compression_quality")
def _op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_scores(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


@_query("op3_counterfactual_toxicity")
def _op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity_scores(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


@_query("op5_contextual_personal_data")
def _op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


#: CRC-32 of words in SQL: a table of 256 entries by its rule, then one step a byte.
_CRC_TABLE = """list_transform(range(0, 256), lambda v: list_reduce(list_prepend(v, range(0, 8)::BIGINT[]), lambda c, i:
    CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END))"""


@_query("op11_target_resampling", rf"""
WITH tab AS (SELECT {_CRC_TABLE} AS crc),
     d AS (SELECT row_number() OVER () AS r, doc_id, {_license_words("coalesce(text, '')")} AS w FROM documents),
     dw AS (SELECT r, unnest(w) AS word FROM d),
     bw AS (SELECT unnest({_license_words("coalesce(text, '')")}) AS word FROM benchmark),
     v AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
     c AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT,
             list_transform(range(1, length(h), 2), lambda i: ('0x' || h[i : i + 1])::BIGINT)),
             lambda c, b: xor(c // 256, crc[xor(c % 256, b) + 1])), 4294967295::BIGINT) % {BUCKETS} AS bucket FROM v, tab),
     s AS (SELECT bucket, count(*) AS n FROM dw JOIN c USING (word) GROUP BY bucket),
     t AS (SELECT bucket, count(*) AS n FROM bw JOIN c USING (word) GROUP BY bucket),
     g AS (SELECT b.bucket, floor(1000.0::DOUBLE * ln(((coalesce(t.n, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM s) + {BUCKETS}))::DOUBLE
             / ((coalesce(s.n, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM t) + {BUCKETS}))::DOUBLE))::BIGINT AS gain
           FROM (SELECT unnest(range(0, {BUCKETS})) AS bucket) b LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
     f AS (SELECT r, sum(gain)::BIGINT AS weight FROM dw JOIN c USING (word) JOIN g USING (bucket) GROUP BY r),
     k AS (SELECT d.r, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000.0::DOUBLE * ln(-ln(
             (('0x' || sha256('{SEED}:' || doc_id::VARCHAR)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
           FROM d LEFT JOIN f USING (r)),
     o AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS able FROM k WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {SHARE_PCT} * able // 100 THEN rank END AS rank FROM k LEFT JOIN o USING (r)
""")
def _op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query("op12_whitened_embeddings")
def _op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


@_query("op13_suffix_repeats")
def _op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_report(table(spark, sf_dir, "documents"))
