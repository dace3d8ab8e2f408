"""The registered queries of the numbered operators, and SQL for those that SQL can express."""

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.llm import decontamination, exact_dedup, filter_audit, licenses, line_dedup, mixing, pii, quality, secret_scan, sharding, simhash, spelling, substring


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    decisions, _ = mixing.mix(_table(spark, sf_dir, "documents"))
    return decisions.select("doc_id", "size", "source_size", "target", "taken", F.array_join("shards", ",").alias("shards"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_scan(_table(spark, sf_dir, "documents"))
    spans = F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["begin"], m["end"], F.round(m["containment"], 4)))
    return found.select("doc_id", "n_words", F.size("matches").cast("long").alias("n_matches"), F.array_join(F.array_sort(F.array_distinct(F.col("matches.license"))), ",").alias("licenses"), F.array_join(spans, ",").alias("spans"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(_table(spark, sf_dir, "documents"), with_text=False).select("doc_id", "n_lines", "n_removed", "kept_sha256")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(_table(spark, sf_dir, "documents"), with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.counted(pii.scan(_table(spark, sf_dir, "documents")))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_secret_scan, op3_exact_dedup, op4_quality, op5_sharding, op6_mixing, op7_license_scan, op8_line_dedup, op9_simhash, op10_substring_dedup, op11_pii, op12_filter_audit, op13_spelling_variants)}

ORACLE_SQL = {
    "op1_decontamination": r"""
WITH dw AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, list_slice(w, i, i + 9) AS win, least(len(w), 10) AS n FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM bw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM iw),
cand AS (SELECT r, n, i, list_slice(w, i, i + n - 1) AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n)),
hit AS (SELECT r, cand.n, i, item_id FROM cand JOIN iw ON cand.n = iw.n AND cand.win = iw.win),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (r) LEFT JOIN items USING (r)""",
    "op3_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op10_substring_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, doc_id, i, list_slice(w, i, i + 12) AS s FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
first_ AS (SELECT s, min(doc_id) AS least FROM win GROUP BY s HAVING count(*) > 1),
gone AS (SELECT r, list_distinct(flatten(list(range(i, i + 13)))) AS p FROM win JOIN first_ USING (s) WHERE doc_id > least GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(p), 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN p IS NULL THEN array_to_string(w, ' ') ELSE coalesce(array_to_string(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(p, x[2])), lambda x: x[1]), ' '), '') END) AS kept_sha256
FROM d LEFT JOIN gone USING (r)""",
    "op12_filter_audit": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
known AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
fails AS (SELECT r, part, coalesce(good, false) AS good, coalesce(bad, false) AS bad, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b,
  100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d, coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false) AS e
  FROM d LEFT JOIN known ON d.doc_id = known.doc_id),
failing AS (SELECT r, part, good, bad, unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([a, b, c, d, e]) AS failed, a::INT + b::INT + c::INT + d::INT + e::INT AS n FROM fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (SELECT v.f || w.f || x.f || y.f || z.f AS o FROM letters v JOIN letters w ON w.f <> v.f JOIN letters x ON x.f NOT IN (v.f, w.f) JOIN letters y ON y.f NOT IN (v.f, w.f, x.f) JOIN letters z ON z.f NOT IN (v.f, w.f, x.f, y.f)),
steps AS (SELECT o, s, o[s] AS f FROM (SELECT o, unnest(range(1, 6)) AS s FROM orders)),
first_ AS (SELECT r, part, good, bad, o, min(s) AS s FROM failing JOIN steps USING (f) WHERE failed GROUP BY ALL),
sizes AS (SELECT part, count(*) AS total FROM fails GROUP BY part),
gone AS (SELECT part, o, s, count(*) AS removed, count(*) FILTER (good) AS good_lost, count(*) FILTER (bad) AS toxic_lost FROM first_ GROUP BY ALL),
alone AS (SELECT part, f, count(*) FILTER (failed) AS failing, count(*) FILTER (failed AND n = 1) AS unique_fails FROM failing GROUP BY ALL),
every AS (SELECT part, o, s, f, total, coalesce(removed, 0) AS removed, failing - coalesce(removed, 0) AS redundant, unique_fails, coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost
  FROM sizes CROSS JOIN steps JOIN alone USING (part, f) LEFT JOIN gone USING (part, o, s))
SELECT part, o AS filter_order, CAST(s AS INTEGER) AS step, CAST(total - sum(removed) OVER (PARTITION BY part, o ORDER BY s) AS BIGINT) AS kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM every""",
    # CRC-32 by its rule: a table of 256, folded over the bytes. Near words share what is left without one position, or are left with the other.
    "op13_spelling_variants": r"""
WITH RECURSIVE crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) AS c FROM (SELECT unnest(range(256)) AS i))),
runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents) GROUP BY ALL),
hashed AS (SELECT run, n, xor(list_reduce(list_transform(range(1, strlen(s) + 1), lambda j: CAST('0x' || substr(hex(encode(s)), 2 * j - 1, 2) AS BIGINT)), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), 4294967295), 4294967295) AS h
  FROM (SELECT *, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS s FROM runs WHERE length(run) >= 5), crc),
cut AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
gaps AS (SELECT word, n, i, left(word, i - 1) AS before, substr(word, i + 1) AS after FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (SELECT x.word, y.word AS near, y.n AS near_n FROM gaps x JOIN gaps y ON x.before = y.before AND x.after = y.after AND x.word <> y.word
  UNION SELECT g.word, w.word, w.n FROM gaps g JOIN words w ON w.word = g.before || g.after UNION SELECT w.word, g.word, g.n FROM gaps g JOIN words w ON w.word = g.before || g.after),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
named AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * n THEN near END AS form, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n FROM words LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS root_ FROM named UNION ALL SELECT walk.word, named.form FROM walk JOIN named ON named.word = walk.root_ WHERE named.form IS NOT NULL),
ends AS (SELECT walk.word, root_ FROM walk JOIN named ON named.word = walk.root_ WHERE named.form IS NULL)
SELECT word, form, root_ AS root, n, n_near, form_n FROM named JOIN ends USING (word)""",
}


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _spans_sql(name: str, source: str, column: str, pattern: str, group: int) -> str:
    """A CTE of the matches of a pattern: r, begin, end (code points), part; places from the pieces between the matches."""
    p = _quoted(pattern)
    return f"""{name} AS (SELECT r, k, CAST(list_sum(list_transform(pieces[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:k - 1], lambda x: length(x))), 0) AS BIGINT) AS b, length(whole[k]) AS n, parts[k] AS part
  FROM (SELECT r, pieces, whole, parts, unnest(range(1, len(whole) + 1)) AS k FROM (SELECT r, regexp_split_to_array({column}, {p}) AS pieces, regexp_extract_all({column}, {p}) AS whole, regexp_extract_all({column}, {p}, {group}) AS parts FROM {source} WHERE regexp_matches({column}, {p}))))"""


def _secret_scan_sql() -> str:
    base = [_spans_sql(f"m_{kind}", "t", "text", pattern, group) for kind, (pattern, group, _) in secret_scan.BASE.items()]
    plain = " UNION ALL ".join(f"SELECT r, b, {order} AS o, '{kind}' AS kind, b + n AS e FROM m_{kind} WHERE length(part) >= {least}" for order, (kind, (_, _, least)) in enumerate(secret_scan.BASE.items()))
    held = lambda form: f"regexp_matches(part, {_quoted(form)})" if isinstance(form, str) else f"(regexp_matches(part, {_quoted(form[0])}) AND NOT regexp_matches(part, {_quoted(form[1])}))"
    allowed = " OR ".join(map(held, secret_scan.ALLOW[1:]))
    # The first allowed form has a back reference, which this engine's patterns lack: one character over and over, or a sequence.
    allowed = f"len(list_distinct(string_split(lower(part), ''))) = 1 OR regexp_matches(part, '^(0123456789|(?i:abcdefghij)|1234567890)') OR {allowed}"
    # Possessive quantifiers are plain ones here: this engine never gives back.
    inside = _quoted(re.sub(r"([*+?}])\+", r"\1", "|".join(f"(?:{p})" for p in secret_scan.ALLOW_INSIDE)))
    window = 20
    hot = " UNION ALL ".join(
        f"SELECT r, c, b + i AS b, {order} AS o, '{kind}' AS kind FROM chars WHERE len(list_filter(w, lambda x: NOT contains({_quoted(alphabet)}, x))) = 0 AND log2({float(size)}) - list_sum(list_transform(map_values(list_aggregate(w, 'histogram')), lambda x: x * log2(x))) / {size} >= {threshold} - 1e-9"
        for order, (kind, (alphabet, size, threshold)) in enumerate(secret_scan.CLASSES.items(), len(secret_scan.BASE))
    )
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
{", ".join(base)}, {_spans_sql("m_candidate", "t", "text", secret_scan.CANDIDATE, 0)},
candidates AS (SELECT r, b, part, row_number() OVER () AS c FROM m_candidate WHERE regexp_matches(part, '[0-9]') AND NOT ({allowed})),
cuts AS (SELECT r, c, b, unnest(range(1, len(pieces) + 1)) AS k, pieces, whole FROM (SELECT *, regexp_split_to_array(part, {inside}) AS pieces, regexp_extract_all(part, {inside}) AS whole FROM candidates)),
parts AS (SELECT r, c, b + coalesce(list_sum(list_transform(pieces[1:k - 1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(whole[1:k - 1], lambda x: length(x))), 0) AS b, pieces[k] AS part, c * 1000 + k AS p FROM cuts WHERE length(pieces[k]) >= {window}),
chars AS (SELECT r, p AS c, b, i, string_split(substr(part, CAST(i + 1 AS BIGINT), {window}), '') AS w FROM (SELECT r, p, b, part, unnest(range(length(part) - {window} + 1)) AS i FROM parts)),
hot AS ({hot}),
joined AS (SELECT r, o, kind, min(b) AS b, max(b) + {window} AS e FROM (SELECT *, sum(fresh) OVER (PARTITION BY r, c, o ORDER BY b ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN b <= lag(b) OVER (PARTITION BY r, c, o ORDER BY b) + {window} THEN 0 ELSE 1 END AS fresh FROM hot)) GROUP BY r, c, o, kind, g),
base AS ({plain}), every AS (SELECT r, b, o, kind, e FROM base UNION ALL SELECT r, b, o, kind, e FROM joined),
said AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, coalesce(string_agg(kind || ':' || CAST(b AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY b, o, kind, e) FILTER (o < {len(secret_scan.BASE)}), '') AS based,
  string_agg(kind || ':' || CAST(b AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY b, o, kind, e) AS spans, count(*) FILTER (o >= {len(secret_scan.BASE)}) AS n_entropy FROM every GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(based, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_entropy, 0) AS n_entropy FROM t LEFT JOIN said USING (r)"""


ORACLE_SQL["op2_secret_scan"] = _secret_scan_sql()


def _rewrite_sql(name: str, source: str, pattern: str, replacement: str) -> str:
    """Two CTEs of a transducer over (r, s, b, e, d): s with each match x changed; each character's source begin, end and whether it was edited."""
    p = _quoted(pattern)
    begin = "CAST(coalesce(list_sum(list_transform(pieces[1:k - 1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(whole[1:k - 1], lambda x: length(x))), 0) AS BIGINT)"
    each = lambda piece, one: f"flatten(list_transform(starts, lambda a, k: list_concat({piece}, list_transform(range(coalesce(length(fresh[k]), 0)), lambda i: {one}))))"
    own = lambda c: f"{c}[a + 1:a + length(pieces[k])]"
    return f"""{name}_cut AS (SELECT *, list_transform(whole, lambda x: {replacement}) AS fresh, list_transform(range(1, len(pieces) + 1), lambda k: {begin}) AS starts
  FROM (SELECT r, s, b, e, d, regexp_split_to_array(s, {p}) AS pieces, regexp_extract_all(s, {p}) AS whole FROM {source})),
{name} AS (SELECT r, array_to_string(flatten(list_transform(pieces, lambda x, k: [x, coalesce(fresh[k], '')])), '') AS s, {each(own("b"), "b[a + length(pieces[k]) + 1]")} AS b,
  {each(own("e"), "e[a + length(pieces[k]) + length(whole[k])]")} AS e, {each(own("d"), "true")} AS d FROM {name}_cut)"""


def _pii_sql() -> str:
    words = "x"
    words = f"regexp_replace({words}, {_quoted(f'(?i) {{1,2}}(?:{pii.DOT}) {{1,2}}')}, '.', 'g')"
    for word, digit in pii.DIGIT_OF.items():
        form = word.replace("é", "[éÉ]").replace("ü", "[üÜ]")
        words = f"regexp_replace({words}, '(?i)\\b{form}\\b', '{digit}', 'g')"
    label = _quoted(rf"(?i)^ +(?:{pii.AT}) +([a-z0-9.-]+)(?: |[\[({{<])")
    at = ", ".join(_quoted(w) for w in pii.AT.split("|"))
    sign = f"CASE WHEN regexp_matches(x, '(?i)^{pii.PLUS}') THEN '+' || right(x, 1) WHEN regexp_extract(x, {label}, 1) <> '' THEN '@' || regexp_extract(x, {label}, 1) || '.' WHEN lower(trim(x, ' [](){{}}<>')) IN ({at}) THEN '@' ELSE '.' END"
    digits = "regexp_replace(part, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(list_reverse(string_split({digits}, '')), lambda x, i: CASE WHEN i % 2 = 1 THEN CAST(x AS INT) ELSE 2 * CAST(x AS INT) - CASE WHEN CAST(x AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(part, '.'), lambda x: length(ltrim(x, '0')) > 3 OR CAST('0' || right(ltrim(x, '0'), 3) AS INT) > 255)) = 0"),
        "card": (r"[0-9]([\x20-]?[0-9])+", f"CASE WHEN length({digits}) BETWEEN 16 AND 19 THEN {luhn} ELSE false END"),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({digits}) BETWEEN 8 AND 15"),
    }
    plain = [_spans_sql(f"m_{k}", "t", "text", p, 0) for k, (p, _) in kinds.items()]
    hidden = [_spans_sql(f"h_{k}", "normal", "s", p, 0) for k, (p, _) in kinds.items()]
    union = lambda prefix: " UNION ALL ".join(f"SELECT r, {o} AS o, '{k}' AS kind, b, b + n AS e FROM {prefix}_{k} WHERE {good}" for o, (k, (_, good)) in enumerate(kinds.items()))
    invisible, alike, plain_form = _quoted(pii.INVISIBLE), _quoted("".join(pii.LOOK_ALIKES)), _quoted("".join(pii.LOOK_ALIKES.values()))
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
chars AS (SELECT r, c, list_filter(range(1, len(c) + 1), lambda i: NOT contains({invisible}, c[i])) AS kept FROM (SELECT r, regexp_extract_all(text, '(?s).') AS c FROM t)),
folded AS (SELECT r, translate(array_to_string(list_transform(kept, lambda i: c[i]), ''), {alike}, {plain_form}) AS s, list_transform(kept, lambda i: i - 1) AS b, kept AS e, list_transform(kept, lambda i: contains({alike}, c[i])) AS d FROM chars),
{_rewrite_sql("spelled", "folded", pii.SPELLED, f"regexp_replace({words}, '[ ,-]', '', 'g')")},
{_rewrite_sql("normal", "spelled", pii.SIGNS, sign)},
{", ".join(plain)}, {", ".join(hidden)},
base AS ({union("m")}), met AS ({union("h")}),
back AS (SELECT DISTINCT r, o, kind, normal.b[met.b + 1] AS b, normal.e[met.e] AS e FROM met JOIN normal USING (r)
  WHERE len(list_filter(range(met.b + 1, met.e + 1), lambda i: normal.d[i] OR (i < met.e AND normal.b[i + 1] > normal.e[i]))) > 0),
added AS (SELECT * FROM back WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.r = back.r AND base.kind = back.kind AND base.b <= back.b AND base.e >= back.e)),
every AS (SELECT *, true AS plain FROM base UNION ALL SELECT *, false FROM added),
said AS (SELECT r, {", ".join(f"count(*) FILTER (plain AND kind = '{k}') AS n_{k}" for k in kinds)}, string_agg(kind || ':' || CAST(b AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY o, b, e) FILTER (plain) AS based,
  string_agg(kind || ':' || CAST(b AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY o, b, e) AS spans, count(*) FILTER (NOT plain) AS n_disguised FROM every GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in kinds)}, sha256(coalesce(based, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_disguised, 0) AS n_disguised FROM t LEFT JOIN said USING (r)"""


ORACLE_SQL["op11_pii"] = _pii_sql()
