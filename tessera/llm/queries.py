"""One query for each operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import contamination, encoding, exact_dedup, jaccard_join, language_id, packing, periodic, quality_classifier, quality_rules, runtime, sharding, spelling, token_counts, warc


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runtime.read(spark, f"{sf_dir}/documents.parquet")


def _public(name: str) -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.clean_lines(_docs(spark, sf_dir))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_docs(spark, sf_dir), _public("piece_bpe_32k.model")[0])


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.round_trip(_docs(spark, sf_dir), *_public("byte_bpe_50k.tiktoken"))


def op4_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_docs(spark, sf_dir), *_public("byte_bpe_50k.json"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources are the hosts of documents, languages the paths below them."""
    return quality_classifier.score(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(runtime.read(spark, f"{sf_dir}/pages.parquet"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_docs(spark, sf_dir), *_public("byte_bpe_50k.json"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar(_docs(spark, sf_dir), width=3, num=90, den=100)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(_docs(spark, sf_dir))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents are written to 256 shards and read back; their columns but for the text are returned."""
    docs, path = runtime.read(spark, f"{sf_dir}/documents.parquet", row="_row"), runtime.fresh_path(spark, "shards")
    placed = sharding.place(docs, ["doc_id"], [f"shard-{k:04d}" for k in range(256)])
    sharding.write_shards(placed, path, 1 + runtime.shares(docs) // 256, row="_row")  # files of a bounded size
    return sharding.read_shards(spark, path, placed.drop("_row").schema).drop("text")


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.find(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, by a hash of their ids, first get a period of their own from some word on."""
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    n, g = F.size("w"), F.floor(F.col("h") / 10)
    shaped = docs.select("doc_id", "text", h.alias("h")).withColumn("w", F.when(F.col("h") % 10 == 0, words))
    shaped = shaped.withColumn("a", F.when(n > 0, (g % n).cast("int"))).withColumn("p", F.when(n > 0, (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int")))
    period = F.slice("w", F.col("a") + 1, "p")
    again = F.slice(F.flatten(F.array_repeat(period, F.ceil((n - F.col("a")) / F.col("p")).cast("int"))), F.lit(1), n - F.col("a"))
    planted = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), again), " ")
    found = periodic.find(shaped.select("doc_id", F.when(n > 0, planted).otherwise(F.col("text")).alias("text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("x"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return found.select(
        "doc_id", "n_runs", (-F.col("x.start")).alias("start"), F.col("x.length").alias("length"), (-F.col("x.period")).alias("period"),
        F.expr("1000 * x.length DIV -x.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(spelling.word_counts(_docs(spark, sf_dir), typos=199).where("n >= 5"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_language_id": op2_language_id,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_best_fit": op4_best_fit,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_warc": op6_warc,
    "op7_token_counts": op7_token_counts,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_sharding": op10_sharding,
    "op11_decontamination": op11_decontamination,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLES = {
    "op1_quality_rules": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
wins AS (SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
         FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM wins),
marked AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words
           FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep WHERE n >= 2) GROUP BY 1),
l AS (SELECT doc_id, unnest(lines) AS line FROM w),
m AS (SELECT doc_id, line,
             length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars,
             len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
             length(line) - length(regexp_replace(line, '[|»•·›]', '', 'g')) AS separators,
             length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) AS symbols,
             length(line) - length(regexp_replace(line, '[!?]{2,}', '', 'g')) AS shouts FROM l),
j AS (SELECT doc_id, chars, CASE
        WHEN separators >= 2 AND separators * 100 >= words * 20 THEN 'navigation'
        WHEN NOT regexp_matches(line, '[.!?…]["''”’»)\]]*([\x20\x09-\x0D]|$)')
             OR symbols * 100 > chars * 10 OR shouts * 100 > words * 30 THEN 'punctuation'
        WHEN regexp_matches(line, '(?i)all rights reserved|copyright (\(c\)|©|[0-9]{4})|under the (mit|apache|gnu|bsd|gpl)[^.]{0,40}licen[sc]e|licensed under (the|a|cc)|privacy policy|cookie (policy|settings)|terms of (use|service)|(click|tap) here|subscribe to|sign up|log ?in to|enable javascript')
             THEN 'boilerplate' END AS why FROM m),
k AS (SELECT doc_id, coalesce(sum(chars) FILTER (WHERE why IS NULL), 0) AS kept_chars,
             count(*) FILTER (WHERE why = 'navigation') AS n_navigation,
             count(*) FILTER (WHERE why = 'punctuation') AS n_punctuation,
             count(*) FILTER (WHERE why = 'boilerplate') AS n_boilerplate FROM j GROUP BY 1),
b AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
             CAST(coalesce(kept_chars, 0) AS BIGINT) AS kept_chars,
             CAST(coalesce(n_navigation, 0) AS BIGINT) AS n_navigation,
             CAST(coalesce(n_punctuation, 0) AS BIGINT) AS n_punctuation,
             CAST(coalesce(n_boilerplate, 0) AS BIGINT) AS n_boilerplate
      FROM w LEFT JOIN marked USING (doc_id) LEFT JOIN k USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed,
       NOT (n_words < 50 OR n_repeat_words * 100 > n_words * 50) AND kept_chars * 100 >= word_chars * 50 AS kept,
       kept_chars, n_navigation, n_punctuation, n_boilerplate
FROM b""",
    "op6_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
t AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS top FROM p),
n AS (SELECT *, list_transform(range(8), lambda k: CAST('0x' || substr(h, CAST(5 * k + 1 AS BIGINT), 5) AS BIGINT)) AS parts FROM t)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((parts[CAST(i // 4 + 1 AS BIGINT)] >> CAST(15 - 5 * (i % 4) AS BIGINT)) % 32 + 1 AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM n""",
    "op8_jaccard_join": r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS x FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * same >= 90 * (x.n + y.n - same)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a, a AS b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT t.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(k.low, t.doc_id) AS component_id
FROM t LEFT JOIN n ON t.doc_id = n.doc_id LEFT JOIN (SELECT a, min(b) AS low FROM r GROUP BY 1) k ON t.doc_id = k.a""",
    "op9_exact_dedup": r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id)""",
    "op11_decontamination": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item, k, array_to_string(w[i + 1 : i + k], ' ') AS s FROM (SELECT item, w, least(len(w), 10) AS k, unnest(range(greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, k, i, array_to_string(w[i + 1 : i + k], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(len(w) - k + 1)) AS i FROM w, (SELECT DISTINCT k FROM p) WHERE len(w) >= k)),
o AS (SELECT doc_id, i, d.k, item FROM d JOIN p ON d.k = p.k AND d.s = p.s),
h AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS x FROM o) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM o) GROUP BY 1)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, h.n IS NOT NULL AS contaminated
FROM w LEFT JOIN h ON w.doc_id = h.doc_id LEFT JOIN t ON w.doc_id = t.doc_id""",
    "op12_periodic_runs": r"""
WITH crc AS (SELECT list_transform(range(256), lambda k: list_reduce([k, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
h AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, hex(encode(CAST(doc_id AS VARCHAR))) AS b FROM documents),
g AS (SELECT doc_id, w, len(w) AS n, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(len(b) // 2), lambda i: CAST('0x' || substr(b, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))), lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1]))) AS h FROM h, crc),
a AS (SELECT *, h // 10 % n AS a, 1 + (n - h // 10 % n) // (3 + h // 10 % 8) AS p FROM g WHERE n > 0),
s AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 THEN list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE w END AS w FROM a),
x AS MATERIALIZED (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM s),
e AS (SELECT l.doc_id, l.i, r.i - l.i AS q FROM x l JOIN x r ON l.doc_id = r.doc_id AND l.word = r.word AND r.i > l.i AND 4 * (r.i - l.i) <= l.n),
j AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e),
u AS (SELECT doc_id, min(i) AS s, count(*) + q AS k, q FROM j GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
r AS MATERIALIZED (SELECT doc_id, s, k, min(q) AS q FROM u GROUP BY 1, 2, 3),
o AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + k)) AS i FROM r),
c AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.i) AS text FROM x LEFT JOIN o ON x.doc_id = o.doc_id AND x.i = o.i WHERE o.i IS NULL GROUP BY 1),
l AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || k || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM r GROUP BY 1),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k DESC, s, q) AS rn FROM r) WHERE rn = 1)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(s AS BIGINT) AS start, CAST(k AS BIGINT) AS length, CAST(q AS BIGINT) AS period, CAST(1000 * k // q AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(c.text, '')) AS collapsed_sha256
FROM documents d LEFT JOIN l ON d.doc_id = l.doc_id LEFT JOIN b ON d.doc_id = b.doc_id LEFT JOIN c ON d.doc_id = c.doc_id""",
    "op13_spelling_variants": r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda k: list_reduce([k, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
r AS (SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents) GROUP BY ALL),
x AS (SELECT run, k, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS b FROM r),
h AS (SELECT run, k, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(len(b) // 2), lambda i: CAST('0x' || substr(b, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))), lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1]))) AS h FROM x, crc),
m AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) + 2 AS BIGINT)) ELSE run END AS word, k FROM h),
v AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM m WHERE length(word) >= 6 GROUP BY 1 HAVING sum(k) >= 5),
d AS (SELECT DISTINCT word, i, substr(word, 1, i) || substr(word, i + 2) AS d FROM (SELECT word, CAST(unnest(range(length(word))) AS BIGINT) AS i FROM v)),
e AS (SELECT a.word, b.word AS near FROM d a JOIN d b ON a.i = b.i AND a.d = b.d AND a.word <> b.word UNION SELECT v.word, d.word FROM v JOIN d ON v.word = d.d UNION SELECT d.word, v.word FROM v JOIN d ON v.word = d.d),
s AS (SELECT e.word, near, b.n AS near_n, a.n, count(*) OVER (PARTITION BY e.word) AS n_near, row_number() OVER (PARTITION BY e.word ORDER BY b.n DESC, near) AS rn FROM e JOIN v a ON e.word = a.word JOIN v b ON e.near = b.word),
f AS MATERIALIZED (SELECT word, n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n FROM s WHERE rn = 1),
c AS (SELECT word, form AS up, 1 AS step FROM f WHERE form IS NOT NULL UNION ALL SELECT c.word, f.form, step + 1 FROM c JOIN f ON c.up = f.word WHERE f.form IS NOT NULL),
z AS (SELECT word, arg_max(up, step) AS root FROM c GROUP BY 1)
SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, form, form_n, coalesce(root, v.word) AS root FROM v LEFT JOIN f ON v.word = f.word LEFT JOIN z ON v.word = z.word""",
}
