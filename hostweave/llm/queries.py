"""Registered queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostweave.llm import alignment, binary_output, bpe, mixing, nearest, ngram_join, periodic_runs, quality_rules, secret_scan, sentencepiece_sampling, suffix_dedup, toxicity, url_filters

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; labels of held-out documents are never read."""
    documents = table(spark, sf_dir, "documents")
    model = toxicity.fit(documents, table(spark, sf_dir, "labels"))
    return toxicity.score(documents, model).select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"))


def op4_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every record, taken from the written files."""
    path = binary_output.tokenizer_path(spark, "byte_bpe_50k.json")
    files = binary_output.write(table(spark, sf_dir, "documents"), path)
    return binary_output.digests(files).withColumnRenamed("key", "doc_id")


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = secret_scan.scan(documents, secret_scan.fit(documents))
    return found.select("doc_id", *[c.alias(name) for name, c in secret_scan.digest().items()])


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: class (same n-gram set), links to other documents, group (connected over links)."""
    return ngram_join.groups(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "n_links", "group_id")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the sampled segmentations of every document, up to two distinct ones each."""
    model = binary_output.tokenizer_path(spark, "piece_bpe_32k.model")
    return sentencepiece_sampling.digests(table(spark, sf_dir, "documents"), model).withColumnRenamed("key", "doc_id")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest found of every vector whose id is divisible by 50."""
    return nearest.neighbours(table(spark, sf_dir, "embeddings"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without bytes of strings of 200 bytes that start anywhere else as well."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix takes every document."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of the two tokenizers' tokens in every document, and how common their links are in all of them."""
    paths = [binary_output.tokenizer_path(spark, name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return alignment.statistics(table(spark, sf_dir, "documents"), *paths).withColumnRenamed("key", "doc_id")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every document, after rewriting one of ten, and the text without the repeats."""
    return periodic_runs.digests(table(spark, sf_dir, "documents"), planted=True).withColumnRenamed("key", "doc_id")


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of the text that they decode to."""
    path = binary_output.tokenizer_path(spark, "word_bpe_49k.json")
    return bpe.digests(table(spark, sf_dir, "documents"), path).withColumnRenamed("key", "doc_id")


def queries() -> dict[str, Query]:
    named = [op1_toxicity, op2_quality_rules, op3_url_filters, op4_binary_output, op5_secret_scans, op6_ngram_join, op7_sentencepiece, op8_nearest, op9_suffix_dedup, op10_mixing, op11_alignment, op12_periodic_runs, op13_bpe]
    return {q.__name__: q for q in named}


WORDS = r"""
    docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, source FROM documents),
    lists AS MATERIALIZED (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM docs),
    words AS MATERIALIZED (SELECT r, w, unnest(w) AS word, unnest(range(len(w))) AS i FROM lists)"""

QUALITY_SQL = rf"""
WITH {WORDS},
    windows AS (SELECT r, i, array_to_string(w[i + 1 : i + 8], ' ') AS x FROM words WHERE i <= len(w) - 8),
    twice AS (SELECT r, x FROM windows GROUP BY r, x HAVING count(*) > 1),
    covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT a.r, a.i + unnest(range(8)) AS p FROM windows a JOIN twice b ON a.r = b.r AND a.x = b.x) GROUP BY r),
    per_word AS (SELECT r, sum(length(word)) AS chars, count(*) FILTER (NOT regexp_matches(word, '\p{{L}}')) AS bare, max(length(word)) AS longest,
                 count(*) FILTER (i + 2 <= len(w) AND word = w[i + 2]) AS doubled FROM words GROUP BY r),
    lines AS (SELECT r, count(*) AS n, count(DISTINCT line) AS d FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM docs)
              WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
    counts AS (SELECT d.doc_id, d.t, len(l.w) AS n_words, CAST(coalesce(p.chars, 0) AS BIGINT) AS word_chars,
               CAST(len(regexp_extract_all(d.t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(x.n - x.d, 0) AS n_dup_lines,
               coalesce(c.n, 0) AS n_repeat_words, coalesce(x.n, 0) AS n_lines, coalesce(p.bare, 0) AS bare, coalesce(p.longest, 0) AS longest, coalesce(p.doubled, 0) AS doubled
               FROM docs d JOIN lists l USING (r) LEFT JOIN per_word p USING (r) LEFT JOIN lines x USING (r) LEFT JOIN covered c USING (r)),
    judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars BETWEEN 2 * n_words AND 16 * n_words AND 10 * n_symbols <= 3 * n_words AND 10 * n_dup_lines <= 6 * n_lines AND 10 * doubled <= 3 * n_words
       AND 10 * len(regexp_extract_all(t, '(?m)^[ \t]*[-*•●]')) <= 9 * n_lines AND 10 * len(regexp_extract_all(t, '(?m)(?:\.\.\.|…)[ \t]*$')) <= 3 * n_lines
       AND 10 * bare <= 4 * n_words AND 10 * len(regexp_extract_all(t, '[0-9]')) <= 3 * word_chars AND longest < 1000
       AND NOT contains(lower(t), 'lorem ipsum') AS kept
FROM judged"""

# every two texts that share a 5-gram, compared on their whole sets
JOIN_SQL = rf"""
WITH RECURSIVE {WORDS},
    grams AS MATERIALIZED (SELECT DISTINCT r, array_to_string(w[i + 1 : i + 5], ' ') AS g FROM words WHERE i <= greatest(len(w) - 5, 0)),
    sizes AS MATERIALIZED (SELECT r, count(*) AS n FROM grams GROUP BY r),
    common AS (SELECT a.r AS x, b.r AS y, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r),
    near AS MATERIALIZED (SELECT c.x, c.y, c.n = s.n AND c.n = u.n AS same FROM common c JOIN sizes s ON s.r = c.x JOIN sizes u ON u.r = c.y
                          WHERE c.n / (s.n + u.n - c.n) >= 0.8),
    reach AS (SELECT r AS x, r AS y FROM docs UNION SELECT h.x, n.y FROM reach h JOIN near n ON n.x = h.y)
SELECT d.doc_id, (SELECT min(e.doc_id) FROM docs e WHERE e.r = d.r OR e.r IN (SELECT y FROM near n WHERE n.x = d.r AND n.same)) AS class_id,
       1 + (SELECT count(*) FROM near n WHERE n.x = d.r AND n.same) AS class_size, (SELECT count(*) FROM near n WHERE n.x = d.r) AS n_links,
       (SELECT min(e.doc_id) FROM reach h JOIN docs e ON e.r = h.y WHERE h.x = d.r) AS group_id
FROM docs d"""

MIXING_SQL = rf"""
WITH {WORDS},
    sized AS MATERIALIZED (SELECT d.doc_id, len(l.w) AS size, CASE WHEN d.source IS NULL THEN '1' ELSE '0' || d.source END AS f,
              md5(coalesce(CAST(d.doc_id AS VARCHAR), '') || ':11:' || md5(d.t)) AS turn FROM docs d JOIN lists l USING (r)),
    sources AS (SELECT f, CAST(sum(size) AS BIGINT) AS s, (row_number() OVER (ORDER BY f) - 1) % 3 + 1 AS w FROM sized GROUP BY f),
    -- sources in the order in which they reach their cap; the level is that of the first source that does not
    capped AS (SELECT *, 3 * s AS cap, row_number() OVER (ORDER BY 3 * s / w, f) AS k FROM sources),
    levels AS (SELECT *, (sum(s) OVER () - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
               / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM capped),
    fill AS (SELECT arg_min(level, k) AS level FROM levels WHERE w * level <= cap),
    targets AS (SELECT f, s, least(w * level, cap) AS target FROM capped CROSS JOIN fill),
    whole AS (SELECT *, CASE WHEN s > 0 THEN least(floor(target / s), 3) ELSE 0 END AS n FROM targets),
    rest AS (SELECT *, CASE WHEN n < 3 THEN target - n * s ELSE 0 END AS left_ FROM whole),
    steps AS (SELECT f, turn, sum(size) AS size FROM sized GROUP BY f, turn),
    ahead AS (SELECT f, turn, size, coalesce(sum(size) OVER (PARTITION BY f ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM steps),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY f, turn) - 1 AS j FROM sized)
SELECT d.doc_id, d.size, r.s AS source_size, CAST(r.target AS DOUBLE) AS target,
       CAST(d.size * (r.n + CASE WHEN r.left_ > 0 AND a.before + d.j * d.size + d.size / 2 <= r.left_ THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM numbered d JOIN rest r USING (f) JOIN ahead a ON a.f = d.f AND a.turn = d.turn"""


# runs of equal six-word windows at every lag; checksums by bytes with a table of the 256 remainders
PERIODIC_SQL = rf"""
WITH {WORDS},
    remainders AS (SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS rem FROM range(256) x(b)),
    hashed AS (SELECT r, doc_id, len(w) AS n, CASE WHEN doc_id IS NULL THEN 1 ELSE xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
               lambda c, x: xor(c >> 8, rem[(xor(c, x) & 255) + 1])), 4294967295) END AS h FROM docs JOIN lists USING (r) CROSS JOIN remainders),
    planned AS (SELECT *, h % 10 = 0 AND n > 0 AS made, CASE WHEN n > 0 THEN (h // 10) % n ELSE 0 END AS a, 3 + (h // 10) % 8 AS d FROM hashed),
    moved AS (SELECT w.r, w.i, l.w[1 + CASE WHEN p.made AND w.i >= p.a THEN p.a + (w.i - p.a) % (1 + (p.n - p.a) // p.d) ELSE w.i END] AS word
              FROM words w JOIN planned p USING (r) JOIN lists l USING (r)),
    texts AS MATERIALIZED (SELECT r, list(word ORDER BY i) AS w FROM moved GROUP BY r),
    windows AS MATERIALIZED (SELECT r, i, array_to_string(w[i + 1 : i + 6], ' ') AS x FROM (SELECT r, w, unnest(range(len(w) - 5)) AS i FROM texts WHERE len(w) >= 12)),
    twice AS (SELECT x.r, x.i, y.i - x.i AS q FROM windows x JOIN windows y ON x.r = y.r AND x.x = y.x AND x.i < y.i),
    islands AS (SELECT r, q, min(i) AS s, max(i) - min(i) + 6 + q AS size FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM twice) GROUP BY r, q, island),
    runs AS MATERIALIZED (SELECT r, s, size, min(q) AS q FROM islands WHERE size >= greatest(12, 2 * q) GROUP BY r, s, size),
    best AS (SELECT r, count(*) AS n_runs, arg_min((s, size, q), (-size, s, q)) AS b, string_agg(concat(s, ',', size, ',', q, chr(10)), '' ORDER BY s, q) AS told FROM runs GROUP BY r),
    dropped AS (SELECT DISTINCT r, unnest(range(s + q, s + size)) AS i FROM runs),
    left_ AS (SELECT m.r, string_agg(m.word, ' ' ORDER BY m.i) AS t FROM moved m LEFT JOIN dropped x ON x.r = m.r AND x.i = m.i WHERE x.r IS NULL GROUP BY m.r)
SELECT p.doc_id, coalesce(b.n_runs, 0) AS n_runs, b.b[1] AS start, CAST(b.b[2] AS BIGINT) AS length, b.b[3] AS period, CAST(1000 * b.b[2] // b.b[3] AS BIGINT) AS exponent_milli,
       sha256(coalesce(b.told, '')) AS runs_sha256, sha256(coalesce(k.t, '')) AS collapsed_sha256
FROM planned p LEFT JOIN best b USING (r) LEFT JOIN left_ k USING (r)"""


def url_sql() -> str:
    """Rules and both ranks, round by round."""
    rules = sorted(url_filters.RULES, key=lambda r: (-len(r.text), r.text))
    fits = [f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))" for r in rules]
    rule = " ".join(f"WHEN {fit} THEN '{r.text}'" for fit, r in zip(fits, rules, strict=True))
    ruled = " ".join(f"WHEN {fit} THEN '{r.verdict}'" for fit, r in zip(fits, rules, strict=True))
    case = f"'{url_filters.UPPER}', '{url_filters.LOWER}'"
    host = "translate(regexp_extract({}, '^[^/?#]*', 0), " + case + ")"
    link = url_filters.LINK.replace("'", "''")
    parts = [
        "rests AS (SELECT page_id, html, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)",
        f"cut AS (SELECT page_id, html, {host.format('rest')} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests)",
        f"judged AS MATERIALIZED (SELECT page_id, html, host, path, CASE {rule} END AS rule, CASE {ruled} END AS ruled FROM cut)",
        f"found AS (SELECT host AS src, unnest(regexp_extract_all(html, '{link}', 1)) AS link FROM judged)",
        f"ends AS (SELECT src, {host.format(chr(39).join(['regexp_replace(link, ', '^(?:[A-Za-z]+:)?//', ', ', '', ')']))} AS dst FROM found)",
        "links AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM ends WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst)",
        "hosts AS MATERIALIZED (SELECT host, CAST(sum(good) AS DOUBLE) AS good, CAST(sum(bad) AS DOUBLE) AS bad FROM ("
        "SELECT host, CASE WHEN ruled = 'allow' THEN 1 ELSE 0 END AS good, CASE WHEN ruled = 'block' THEN 1 ELSE 0 END AS bad FROM judged WHERE host <> ''"
        " UNION ALL SELECT src, 0, 0 FROM links UNION ALL SELECT dst, 0, 0 FROM links) GROUP BY host)",
    ]
    for name, seed, src, dst in (("t", "good", "src", "dst"), ("d", "bad", "dst", "src")):
        parts.append(f"{name}out AS (SELECT {src} AS host, sum(n) AS n FROM links GROUP BY {src})")
        parts.append(f"{name}0 AS (SELECT host, coalesce({seed} / nullif(sum({seed}) OVER (), 0), 0) AS s, coalesce({seed} / nullif(sum({seed}) OVER (), 0), 0) AS v FROM hosts)")
        for k in range(1, url_filters.ROUNDS + 1):
            now = f"{name}{k - 1}"
            parts.append(
                f"{name}{k} AS MATERIALIZED (SELECT h.host, any_value(h.s) AS s, {1 - url_filters.DAMPING} * any_value(h.s) + {url_filters.DAMPING} * (coalesce(sum(p.v * l.n / o.n), 0)"
                f" + coalesce((SELECT sum(v) FROM {now} WHERE host NOT IN (SELECT host FROM {name}out)), 0) * any_value(h.s)) AS v"
                f" FROM {now} h LEFT JOIN links l ON l.{dst} = h.host LEFT JOIN {now} p ON p.host = l.{src} LEFT JOIN {name}out o ON o.host = l.{src} GROUP BY h.host)"
            )
    last = url_filters.ROUNDS
    parts.append(f"verdicts AS (SELECT t.host, d.v > t.v * {1 + url_filters.SAME} AS bad FROM t{last} t JOIN d{last} d USING (host))")
    return "WITH " + ",\n".join(parts) + (
        "\nSELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN v.bad THEN 'block' ELSE 'allow' END) AS verdict FROM judged LEFT JOIN verdicts v USING (host)"
    )


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that have an exact one; the tests compare the others with brute force or held-out labels."""
    return {"op2_quality_rules": QUALITY_SQL, "op3_url_filters": url_sql(), "op6_ngram_join": JOIN_SQL, "op10_mixing": MIXING_SQL, "op12_periodic_runs": PERIODIC_SQL}
