"""The registered queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import decontaminate, fingerprints, license_scan, lm_score, merkle, minhash, mixing, periodic, phrases, quality, sharding, toxicity, url_filter
from tideline.llm.common import let, spread, table

#: The rules of the URL query: verdict, host, path.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: The list of the URL query: all URLs of hosts with this label, and of the others one in so many by a hash.
LISTED, ONE_IN = "spam-farm.", 50


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    listed = pages.select("url").where(url_filter.host(F.col("url")).startswith(LISTED) | (F.pmod(spread(F.col("url")), F.lit(ONE_IN)) == 0))
    return url_filter.judge(pages.select("page_id", "url"), listed, URL_RULES).drop("url")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1")
    return lm_score.cross_entropy_difference(table(spark, sf_dir, "documents"), good)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance"]
    x = quality.judge(table(spark, sf_dir, "documents")).select(*names)
    return x.withColumns({c: F.round(c, 6) for c in names[-2:]})


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.remove(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))).drop("passages")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0, F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    x = merkle.manifest(table(spark, sf_dir, "documents"), other=tampered)
    folded = merkle.fold(F.coalesce("other", "leaf"), F.col("proof"))
    x = x.select("doc_id", "leaf", "subroot", "root", merkle.digest(merkle.proof_text(F.col("proof"))).alias("proof_sha256"), folded.alias("folded_root"))
    return x.withColumn("verified", F.col("folded_root") == F.col("root"))


def _with_repeats(docs: DataFrame) -> DataFrame:
    """Documents, in which those with h % 10 = 0 repeat with a period from a word on; h: the checksum of doc_id."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def changed(w: Column) -> Column:
        n, g = F.size(w).cast("long"), F.floor(h / 10)
        a = F.pmod(g, n)
        return let(
            F.struct(a.alias("a"), (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).alias("p")),
            lambda x: F.array_join(F.transform(w, lambda word, i: F.when(i < x["a"], word).otherwise(F.get(w, (x["a"] + F.pmod(i - x["a"], x["p"])).cast("int")))), " "),
        )

    return docs.select("doc_id", F.when(F.pmod(h, F.lit(10)) == 0, let(words, lambda w: F.when(F.size(w) > 0, changed(w)))).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find(_with_repeats(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    x = found.select("doc_id", "runs", "collapsed", best.alias("best"))
    return x.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).cast("long").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filters, op2_lm_scoring, op3_mixing, op4_license_scans, op5_quality_rules, op6_minhash_near_dedup, op7_substring_dedup, op8_sharding, op9_toxicity, op10_benchmark_decontamination,
        op11_merkle_manifest, op12_periodic_runs, op13_document_fingerprints, pipeline,
    )
}

def _spread_sql(key: str, seed: int = 0) -> str:
    return f"CAST('0x' || substr(md5(coalesce(CAST({key} AS VARCHAR), '') || '/{seed}'), 1, 15) AS BIGINT)"


_CANON = r"""
 parts AS (
  SELECT page_id, url,
   coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
   coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path,
   regexp_extract(url, '^(?s:.*?)://[^?#]*\?([^#]*)', 1) AS query
  FROM pages),
 canon AS (
  SELECT *, CASE WHEN contains(url, '://') THEN regexp_replace(host, '^www\.|:(80|443)$', '', 'g') || regexp_replace(path, '(/index\.html?|\.html?|/+)$', '')
   || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)='))), '&'), ''), '') END AS key
  FROM parts),
 listed AS (SELECT DISTINCT key FROM canon WHERE (host LIKE 'spam-farm.%' OR SPREAD % ONE_IN = 0) AND key IS NOT NULL),
""".replace("SPREAD", _spread_sql("url")).replace("ONE_IN", str(ONE_IN))

ORACLE_SQL = {
    "op1_url_filters": "WITH" + _CANON + r"""
 rules(verdict, rh, rp, rule) AS (VALUES ('allow','com','/','com/'), ('block','example.com','/en/','example.com/en/'), ('allow','www.example.com','/en/','www.example.com/en/'), ('block','net','/es/','net/es/'), ('block','net','/fr/','net/fr/')),
 fit AS (
  SELECT c.page_id, r.rule, r.verdict, row_number() OVER (PARTITION BY c.page_id ORDER BY length(r.rule) DESC) AS k
  FROM canon c JOIN rules r ON (c.host = r.rh OR ends_with(c.host, '.' || r.rh)) AND starts_with(c.path, r.rp))
 SELECT c.page_id, c.host, c.path, f.rule, coalesce(f.verdict, CASE WHEN l.key IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, l.key IS NOT NULL AS listed
 FROM canon c LEFT JOIN fit f ON f.page_id = c.page_id AND f.k = 1 LEFT JOIN listed l ON l.key = c.key
""",
}

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACED = r"[^\x20\x09-\x0D]+"

ORACLE_SQL["op10_benchmark_decontamination"] = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '{_ALNUM}') AS w FROM documents),
 b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWERED}, '{_ALNUM}') AS w FROM benchmark),
 bw AS (SELECT DISTINCT item, least(len(w), 10) AS k, w[i : i + least(len(w), 10) - 1] AS win FROM b, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS r(i) WHERE len(w) > 0),
 dw AS (SELECT doc_id, i, k, w[i : i + k - 1] AS win FROM d, (SELECT DISTINCT k FROM bw), unnest(range(1, len(w) - k + 2)) AS r(i)),
 hits AS (SELECT doc_id, i, dw.k, item FROM dw JOIN bw ON dw.win = bw.win),
 n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, i, k FROM hits), unnest(range(i, i + k)) AS r(p) GROUP BY 1),
 s AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN s USING (doc_id)"""

ORACLE_SQL["op7_substring_dedup"] = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
 x AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS win FROM d, unnest(range(1, len(w) - 18)) AS r(i)),
 late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS k FROM x) WHERE k > 1),
 gone AS (SELECT DISTINCT doc_id, p FROM late, unnest(range(i, i + 20)) AS r(p)),
 words AS (SELECT doc_id, i, w[i] AS word FROM d, unnest(range(1, len(w) + 1)) AS r(i)),
 kept AS (SELECT a.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM words a LEFT JOIN gone g ON g.doc_id = a.doc_id AND g.p = a.i WHERE g.p IS NULL GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""


def _quality_sql() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    count = lambda pattern: f"CAST(len(regexp_extract_all(t, {quote(pattern)})) AS BIGINT)"
    common = "[" + ", ".join(map(quote, quality.COMMON)) + "]"
    n_kinds, n_common = len(quality.CLASSES) + 3, len(quality.COMMON) + 1
    plogp = lambda x: f"(CASE WHEN {x} > 0 THEN {x} * log2(CASE WHEN {x} > 0 THEN {x} ELSE 1 END) ELSE 0 END)"
    dist = lambda a, b, n: (
        f"CASE WHEN list_sum({a}) > 0 AND list_sum({b}) > 0 THEN sqrt(greatest(0, list_sum(list_transform(range(1, {n + 1}), lambda i: ({plogp(f'({a}[i] / list_sum({a}))')} + {plogp(f'({b}[i] / list_sum({b}))')}) / 2 - {plogp(f'(({a}[i] / list_sum({a}) + {b}[i] / list_sum({b})) / 2)')})))) END"
    )
    kinds = ["length(t) - word_chars", *(f"c_{c}" for c in quality.CLASSES), "n_symbols"]
    rest = "word_chars - n_symbols - " + " - ".join(f"c_{c}" for c in quality.CLASSES)
    sums = lambda col, n: "[" + ", ".join(f"sum({col}[{i}])" for i in range(1, n + 1)) + "]"
    return f"""
WITH a AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
 b AS (SELECT *, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, {count(quality.SYMBOLS)} AS n_symbols, {", ".join(f"{count(p)} AS c_{c}" for c, p in quality.CLASSES.items())}, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_SPACED}')) AS lines FROM a),
 c AS (SELECT *, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, [{", ".join(kinds)}, {rest}] AS kinds, list_filter(w, lambda x: list_contains({common}, x)) AS found FROM b),
 e AS (SELECT *, list_append(list_transform({common}, lambda x: len(list_filter(found, lambda y: y = x))), len(w) - len(found)) AS common FROM c),
 x AS (SELECT doc_id, i, w[i : i + 7] AS win FROM a, unnest(range(1, len(w) - 6)) AS r(i)),
 twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS k FROM x) WHERE k > 1),
 rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM twice, unnest(range(i, i + 8)) AS r(p) GROUP BY 1),
 ref AS (SELECT lang, {sums('kinds', n_kinds)} AS rk, {sums('common', n_common)} AS rc FROM e WHERE lang IS NOT NULL GROUP BY 1),
 every AS (SELECT {sums('kinds', n_kinds)} AS pk, {sums('common', n_common)} AS pc FROM e),
 g AS (SELECT e.*, coalesce(rep.n, 0) AS n_repeat_words, coalesce(rk, pk) AS rk, coalesce(rc, pc) AS rc, list_transform(range(1, {n_common + 1}), lambda i: CASE WHEN i = {n_common} THEN 1 ELSE 0 END) AS bare FROM e LEFT JOIN rep USING (doc_id) LEFT JOIN ref ON ref.lang = e.lang CROSS JOIN every),
 h AS (SELECT *, CASE WHEN length(t) >= {quality.MIN_CHARS} THEN {dist('kinds', 'rk', n_kinds)} END AS cd, CASE WHEN n_words >= {quality.MIN_WORDS} THEN {dist('common', 'rc', n_common)} END AS wd, {dist('bare', 'rc', n_common)} AS rd, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM g)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(cd, 0) <= {quality.MAX_CLASS_DISTANCE} AND coalesce(wd, 0) <= least({quality.MAX_WORD_DISTANCE}, CASE WHEN rd > 0 THEN {quality.MAX_WORD_SHARE} * rd END) AS kept, round(cd, 6) AS class_distance, round(wd, 6) AS word_distance FROM h"""


ORACLE_SQL["op5_quality_rules"] = _quality_sql()


ORACLE_SQL["op3_mixing"] = f"""
WITH r AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{_SPACED}')), 0) AS BIGINT) AS size, {_spread_sql('doc_id')} AS place FROM documents),
 s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM r GROUP BY 1),
 w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS k, [5.0::DOUBLE, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, 3.0::DOUBLE * source_size AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM s),
 l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
 t AS (SELECT source, source_size, total, least(cap, coalesce((SELECT max(level) FROM l WHERE cap >= level * w) * w, cap)) AS target FROM l),
 c AS (SELECT r.*, t.source_size, t.total, t.target, sum(size) OVER (PARTITION BY r.source ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) AS cum FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source),
 q AS (SELECT *, (cum + (n - 1) * source_size) / target AS finish FROM c, (SELECT unnest([1, 2, 3]) AS n) WHERE size > 0 AND target > 0 AND n <= ceil(target / source_size)),
 u AS (SELECT doc_id, size, sum(size) OVER (ORDER BY finish, place, doc_id ROWS UNBOUNDED PRECEDING) AS used, total FROM q), g AS (SELECT doc_id, sum(size) AS taken FROM u WHERE used <= total GROUP BY 1)
SELECT c.doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, source FROM c LEFT JOIN g USING (doc_id)"""


def _crc_table() -> list[int]:
    """The checksum of each byte, by its rule: eight steps of the reversed polynomial 0xEDB88320."""
    out = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        out.append(x)
    return out


def _crc_sql(text: str) -> str:
    hexes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    return f"xor(list_reduce({hexes}, lambda c, b: xor(c >> 8, list_extract(CAST({_crc_table()} AS BIGINT[]), CAST(xor(c, b) & 255 AS BIGINT) + 1)), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"


_CRC = _crc_sql("coalesce(text, '')")

ORACLE_SQL["op8_sharding"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, CAST({_CRC} AS BIGINT) AS text_crc32, CAST(coalesce(strlen(text), 0) + 16 AS BIGINT) AS size, CAST({_spread_sql("coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))")} % {sharding.SLOTS} AS INTEGER) AS vslot FROM documents),
 s AS (SELECT *, row_number() OVER (ORDER BY bytes DESC, vslot DESC, n DESC) AS k FROM (SELECT vslot, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS n FROM d GROUP BY 1)),
 p AS (SELECT CAST(0 AS BIGINT) AS k, list_transform(range(40), lambda x: CAST(0 AS BIGINT)) AS loads, -1 AS vslot, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS shard
  UNION ALL SELECT s.k, list_transform(loads, lambda v, i: CASE WHEN i = list_position(loads, list_min(loads)) THEN v + s.bytes ELSE v END), s.vslot, s.n, list_position(loads, list_min(loads)) - 1 FROM p JOIN s ON s.k = p.k + 1),
 m AS (SELECT vslot, shard, coalesce(sum(n) OVER (PARTITION BY shard ORDER BY vslot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p WHERE vslot >= 0)
SELECT doc_id, size, text_crc32, 'bytes' AS law, CAST(NULL AS INTEGER) AS grown_shard, CAST(shard AS INTEGER) AS shard, CAST(before + row_number() OVER (PARTITION BY vslot ORDER BY doc_id) - 1 AS BIGINT) AS slot, vslot FROM d JOIN m USING (vslot)"""


def _merkle_sql() -> str:
    part = lambda f: f"coalesce(CAST(strlen(CAST({f} AS VARCHAR)) AS VARCHAR) || ':' || CAST({f} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(part, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    depth = " + ".join(f"CAST(count(*) > {3**k} AS INTEGER)" for k in range(20))
    beside = lambda at: f"coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos {at} p.here), '')"
    return f"""
WITH RECURSIVE l AS (SELECT doc_id, coalesce('1' || source, '0') AS grp, {leaf("text")} AS h, CASE WHEN {_crc_sql("CAST(doc_id AS VARCHAR)")} % 2 = 0 AND text IS NOT NULL THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf("text")} END AS other,
  row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos FROM documents),
 n AS (SELECT grp, {depth} AS depth FROM l GROUP BY 1),
 t AS (SELECT grp, 0 AS level, pos, h FROM l UNION ALL SELECT t.grp, level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM t JOIN n ON t.grp = n.grp WHERE level < depth GROUP BY t.grp, level, pos // 3),
 s AS (SELECT t.grp, t.h, row_number() OVER (ORDER BY t.grp) - 1 AS pos FROM t JOIN n ON t.grp = n.grp AND t.level = n.depth),
 m AS (SELECT {depth} AS depth FROM s),
 u AS (SELECT 0 AS level, pos, h FROM s UNION ALL SELECT level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM u, m WHERE level < depth GROUP BY level, pos // 3),
 a AS (SELECT l.doc_id, n.depth, l.pos, s.pos AS top, s.h AS subroot FROM l JOIN n USING (grp) JOIN s USING (grp)),
 p AS (SELECT a.doc_id, l.grp, CAST(k AS INTEGER) AS level, CAST(k AS INTEGER) AS step, a.pos // CAST(3 ** k AS BIGINT) AS here FROM a JOIN l USING (doc_id), unnest(range(0, 20)) AS r(k) WHERE k < a.depth
  UNION ALL SELECT a.doc_id, NULL, CAST(k AS INTEGER), CAST(a.depth + k AS INTEGER), a.top // CAST(3 ** k AS BIGINT) FROM a, m, unnest(range(0, 20)) AS r(k) WHERE k < m.depth),
 b AS (SELECT grp, level, pos, h FROM t UNION ALL SELECT NULL, level, pos, h FROM u),
 e AS (SELECT p.doc_id, p.step, {beside("<")} AS lft, {beside(">")} AS rgt FROM p JOIN b ON b.grp IS NOT DISTINCT FROM p.grp AND b.level = p.level AND b.pos // 3 = p.here // 3 GROUP BY 1, 2),
 f AS (SELECT doc_id, 0 AS step, other AS h FROM l UNION ALL SELECT f.doc_id, f.step + 1, sha256(lft || h || rgt) FROM f JOIN e ON e.doc_id = f.doc_id AND e.step = f.step),
 g AS (SELECT doc_id, arg_max(h, step) AS folded_root FROM f GROUP BY 1),
 q AS (SELECT doc_id, sha256(string_agg(lft || rgt, '' ORDER BY step)) AS proof_sha256 FROM e GROUP BY 1),
 x AS (SELECT u.h AS root FROM u, m WHERE u.level = m.depth)
SELECT l.doc_id, l.h AS leaf, a.subroot, x.root, coalesce(q.proof_sha256, sha256('')) AS proof_sha256, g.folded_root, g.folded_root = x.root AS verified
FROM l JOIN a USING (doc_id) JOIN g USING (doc_id) LEFT JOIN q USING (doc_id), x"""


ORACLE_SQL["op11_merkle_manifest"] = _merkle_sql()
