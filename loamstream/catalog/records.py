"""REC-* and TXT-*: reconciliation and text audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reconcile as rc, textaudit as tx
from ..plans.slices import shift
from ..functions import machine_name, normalize_text
from ..functions.text import human_name, normalize_line
from .base import READINGS, query, readings, table


def r6(c):
    return F.round(c, 6)


def two_copies(spark, sf):
    """Readings and a copy that misses some rows, has some extra and differs in every ninth value."""
    r = readings(spark, sf).select("row_no", "ts", "variable", "value", (F.col("value") * 2).alias("twice"))
    k = F.col("row_no")
    a = r.filter(k % 10 != 0)
    b = r.filter(k % 7 != 0).withColumn("value", F.when(k % 9 == 0, F.col("value") + 0.5).otherwise(F.col("value") * 1.003))
    return a, b


COPIES = f"""{READINGS}, r AS (SELECT row_no, ts, variable, value, value * 2 AS twice FROM readings), a AS (SELECT * FROM r WHERE row_no % 10 <> 0),
b AS (SELECT row_no, ts, variable, CASE WHEN row_no % 9 = 0 THEN value + 0.5 ELSE value * 1.003 END AS value, twice FROM r WHERE row_no % 7 <> 0)"""


@query("REC-01", f"""WITH {COPIES}, f AS (SELECT coalesce(a.row_no, b.row_no) AS row_no, a.row_no AS ra, b.row_no AS rb, a.value AS av, b.value AS bv, a.twice AS at2, b.twice AS bt2 FROM a FULL JOIN b ON a.row_no = b.row_no)
SELECT CAST(count(*) FILTER (ra IS NOT NULL AND rb IS NOT NULL) AS BIGINT) AS overlap_count, CAST(count(*) FILTER (rb IS NULL) AS BIGINT) AS only_left, CAST(count(*) FILTER (ra IS NULL) AS BIGINT) AS only_right FROM f""")
def rec_01(spark, sf):
    return rc.compare_sources(*two_copies(spark, sf), ["row_no"], ["value", "twice"], 0.4)[0]


@query("REC-01:deltas", f"""WITH {COPIES} SELECT 'value' AS field, round(max(abs(a.value - b.value)), 6) AS max_abs_delta FROM a JOIN b USING (row_no) UNION ALL SELECT 'twice', round(max(abs(a.twice - b.twice)), 6) FROM a JOIN b USING (row_no)""")
def rec_01_deltas(spark, sf):
    out = rc.compare_sources(*two_copies(spark, sf), ["row_no"], ["value", "twice"], 0.4)[1]
    return out.withColumn("max_abs_delta", r6(F.col("max_abs_delta")))


@query("REC-01:outliers", f"WITH {COPIES} SELECT a.row_no, 'value' AS field, round(a.value, 6) AS left_value, round(b.value, 6) AS right_value, round(abs(a.value - b.value), 6) AS abs_delta FROM a JOIN b USING (row_no) WHERE abs(a.value - b.value) > 0.4")
def rec_01_outliers(spark, sf):
    out = rc.compare_sources(*two_copies(spark, sf), ["row_no"], ["value", "twice"], 0.4)[2]
    return out.withColumns({c: r6(F.col(c)) for c in ("left_value", "right_value", "abs_delta")})


ALIGN = f"""WITH {COPIES}, x AS (SELECT variable, time_bucket(INTERVAL 1 HOUR, ts) AS bin, avg(value) AS v FROM a GROUP BY ALL), y AS (SELECT variable, time_bucket(INTERVAL 1 HOUR, ts) AS bin, avg(value) AS v FROM b GROUP BY ALL),
al AS (SELECT variable, bin, x.v AS left_value, y.v AS right_value, y.v - x.v AS delta, (y.v - x.v) / nullif(x.v, 0) AS rel_err FROM x JOIN y USING (variable, bin))"""


def aligned(spark, sf):
    return rc.time_align(*two_copies(spark, sf), "hourly", ["variable"])


@query("REC-02", ALIGN + " SELECT variable, bin, round(left_value, 6) AS left_value, round(right_value, 6) AS right_value, round(delta, 6) AS delta, round(rel_err, 6) AS rel_err FROM al")
def rec_02(spark, sf):
    return aligned(spark, sf).withColumns({c: r6(F.col(c)) for c in ("left_value", "right_value", "delta", "rel_err")})


@query("REC-03", ALIGN + " SELECT variable, CAST(count(delta) AS BIGINT) AS count, round(avg(abs(delta)), 6) AS mae, round(sqrt(avg(delta * delta)), 6) AS rmse, round(avg(delta), 6) AS mean_delta, round(stddev_samp(delta), 6) AS std_delta FROM al GROUP BY variable")
def rec_03(spark, sf):
    return rc.error_summary(aligned(spark, sf), ["variable"]).withColumns({c: r6(F.col(c)) for c in ("mae", "rmse", "mean_delta", "std_delta")})


@query("REC-04", ALIGN + """, q AS (SELECT variable, count(rel_err) AS n, max(abs(rel_err)) AS mx, avg(CASE WHEN abs(rel_err) <= 0.005 THEN 1.0 ELSE 0.0 END) AS s05, avg(CASE WHEN abs(rel_err) <= 0.01 THEN 1.0 ELSE 0.0 END) AS s1, avg(CASE WHEN abs(rel_err) <= 0.02 THEN 1.0 ELSE 0.0 END) AS s2,
  quantile_cont(abs(rel_err), 0.5) AS p50, quantile_cont(abs(rel_err), 0.95) AS p95, quantile_cont(abs(rel_err), 0.99) AS p99 FROM al WHERE rel_err IS NOT NULL GROUP BY variable)
SELECT variable, CAST(n AS BIGINT) AS n_overlap, round(mx, 6) AS abs_rel_err_max, round(s05, 6) AS share_within_0p5pct, round(s1, 6) AS share_within_1pct, round(s2, 6) AS share_within_2pct, round(p50, 6) AS abs_rel_err_p50, round(p95, 6) AS abs_rel_err_p95, round(p99, 6) AS abs_rel_err_p99,
  CASE WHEN p95 <= 0.01 AND s05 >= 0.9 THEN 'GOOD' WHEN p95 > 0.02 OR s1 < 0.95 THEN 'CHECK' ELSE '' END AS flag FROM q""")
def rec_04(spark, sf):
    out = rc.error_quality(aligned(spark, sf), ["variable"])
    return out.withColumns({c: r6(F.col(c)) for c in out.columns if c not in ("variable", "n_overlap", "flag")})


STAT = ("mean", "std", "min", "p25", "p50", "p75", "max")
STAT_SQL = "avg({0}) AS mean, stddev_samp({0}) AS std, min({0}) AS min, max({0}) AS max, quantile_cont({0}, 0.25) AS p25, quantile_cont({0}, 0.5) AS p50, quantile_cont({0}, 0.75) AS p75"


@query("REC-05", f"WITH {COPIES}, " + ", ".join(f"{s}_{f} AS (SELECT {STAT_SQL.format(f)} FROM {s})" for s in ("a", "b") for f in ("value", "twice")) + " " + " UNION ALL ".join(
    f"SELECT '{f}' AS field, " + ", ".join(f"round(b_{f}.{c} / nullif(a_{f}.{c}, 0), 6) AS ratio_{c}, round(b_{f}.{c} - a_{f}.{c}, 6) AS absdiff_{c}" for c in STAT) + f" FROM a_{f}, b_{f}" for f in ("value", "twice")))
def rec_05(spark, sf):
    out = rc.magnitude_compare(*two_copies(spark, sf), ["value", "twice"])
    return out.withColumns({c: r6(F.col(c)) for c in out.columns if c != "field"})


OLD = {"old_quantity": "l_quantity", "old_price": "l_extendedprice", "old_tax": "l_tax", "old_flag": "l_returnflag"}
NEW = {"qty": "l_quantity", "qty_copy": "l_quantity", "price": "l_extendedprice", "tax": "l_tax + 0.01", "flag": "l_returnflag"}


def _signatures(columns):
    return " UNION ALL ".join(
        f"SELECT '{n}' AS c, md5(string_agg(k || '#' || CAST({e} AS VARCHAR), '|' ORDER BY k, CAST({e} AS VARCHAR))) AS sig FROM r" for n, e in columns.items())


@query("REC-06", f"""WITH r AS (SELECT *, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) AS k FROM lineitem), o AS ({_signatures(OLD)}), n AS ({_signatures(NEW)}),
j AS (SELECT o.c AS old_column, string_agg(n.c, ',' ORDER BY n.c) AS candidates, count(n.c) AS m FROM o LEFT JOIN n ON o.sig = n.sig GROUP BY o.c)
SELECT old_column, coalesce(candidates, '') AS candidates, CASE m WHEN 0 THEN 'unmapped' WHEN 1 THEN 'mapped' ELSE 'ambiguous' END AS status FROM j""")
def rec_06(spark, sf):
    """Order lines under old and new column names; the tax was changed, the quantity appears twice."""
    rows = table(spark, sf, "lineitem").withColumn("k", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_shipdate").cast("string")))
    old = rows.select("k", F.col("l_quantity").alias("old_quantity"), F.col("l_extendedprice").alias("old_price"), F.col("l_tax").alias("old_tax"), F.col("l_returnflag").alias("old_flag"))
    new = rows.select("k", F.col("l_quantity").alias("qty"), F.col("l_quantity").alias("qty_copy"), F.col("l_extendedprice").alias("price"), (F.col("l_tax") + 0.01).alias("tax"), F.col("l_returnflag").alias("flag"))
    return rc.match_columns(old, new, "k", ["old_quantity", "old_price", "old_tax", "old_flag"], ["qty", "qty_copy", "price", "tax", "flag"])


def doc_lines(spark, sf):
    """Each document as a file of lines, followed by a second copy of its first half."""
    lines = F.split(F.col("text"), "\n")
    half = F.slice(lines, 1, F.greatest((F.size(lines) / 2).cast("int"), F.lit(1)))
    return table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", F.posexplode(F.concat(lines, half)).alias("pos", "line"))


BLOCKS = """WITH d AS (SELECT doc_id, list_concat(string_split(text, chr(10)), list_slice(string_split(text, chr(10)), 1, greatest(CAST(trunc(len(string_split(text, chr(10))) / 2) AS BIGINT), 1))) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(range(0, len(ls))) AS pos, unnest(ls) AS line FROM d), p AS (SELECT a.doc_id, a.pos AS i, b.pos AS j, a.line FROM l a JOIN l b ON a.doc_id = b.doc_id AND a.line = b.line AND b.pos > a.pos),
g AS (SELECT doc_id, j - i AS lag, i, i - row_number() OVER (PARTITION BY doc_id, j - i ORDER BY i) AS isl FROM p), r AS (SELECT doc_id, lag, min(i) AS s, count(*) AS n FROM g GROUP BY doc_id, lag, isl),
f AS (SELECT doc_id, line, min(pos) AS first FROM l GROUP BY ALL), m AS (SELECT r.*, max(n) OVER (PARTITION BY r.doc_id) AS mx FROM r),
q AS (SELECT m.doc_id, m.s, m.lag, m.n, row_number() OVER (PARTITION BY m.doc_id ORDER BY f.first, m.s, m.lag) AS k FROM m JOIN l ON l.doc_id = m.doc_id AND l.pos = m.s JOIN f ON f.doc_id = l.doc_id AND f.line = l.line WHERE n = mx)"""


@query("REC-07", BLOCKS + """
SELECT doc_id, CAST(s AS BIGINT) AS first_start, CAST(s + lag AS BIGINT) AS second_start, CAST(n AS BIGINT) AS block_len FROM q WHERE k = 1""")
def rec_07(spark, sf):
    return rc.duplicate_blocks(doc_lines(spark, sf), ["doc_id"])


@query("REC-07:dropped", BLOCKS + """ SELECT l.doc_id, CAST(l.pos AS INTEGER) AS pos, l.line FROM l LEFT JOIN q ON q.doc_id = l.doc_id AND q.k = 1 AND l.pos >= s + lag AND l.pos < s + lag + n WHERE q.doc_id IS NULL""")
def rec_07_dropped(spark, sf):
    """The files without the second copy of their repeated block."""
    lines = doc_lines(spark, sf)
    return rc.drop_block(lines, rc.duplicate_blocks(lines, ["doc_id"]), ["doc_id"])


@query("REC-08", """WITH g AS (SELECT event_id, value * 1000 * CASE event_id % 4 WHEN 0 THEN 2.02 WHEN 1 THEN 1.3 ELSE 1.05 END AS gallons_group, CASE WHEN event_id % 10 = 9 THEN 0 ELSE value * 1000 / 325851.0 END AS acre_ft FROM events),
r AS (SELECT *, gallons_group / CASE WHEN acre_ft > 0 THEN acre_ft * 325851.0 END AS x FROM g)
SELECT event_id, CASE WHEN x BETWEEN 1.9 AND 2.1 THEN 'halved' WHEN abs(x - 1) > 0.15 THEN 'mismatch' ELSE 'ok' END AS volume_check, round(CASE WHEN x BETWEEN 1.9 AND 2.1 THEN gallons_group / 2 ELSE gallons_group END, 4) AS gallons_group FROM r""")
def rec_08(spark, sf):
    k, v = F.col("event_id"), F.col("value") * 1000
    factor = F.when(k % 4 == 0, 2.02).when(k % 4 == 1, 1.3).otherwise(1.05)
    rows = table(spark, sf, "events").select("event_id", (v * factor).alias("gallons_group"), F.when(k % 10 == 9, 0.0).otherwise(v / 325851.0).alias("acre_ft"))
    return rc.reconcile_volume(rows).select("event_id", "volume_check", F.round("gallons_group", 4).alias("gallons_group"))


# ------------------------------------------------------------------ text

TERMS = ["the", "Ing", "que los", "er-en"]


def term_sql(terms, cap, context=1):
    norm = "trim(regexp_replace(regexp_replace(regexp_replace(lower(line), '[_\\-/]+', ' ', 'g'), '[^a-z0-9% ]+', ' ', 'g'), '\\s+', ' ', 'g'))"
    parts = []
    for i, t in enumerate(terms):
        n = tx._normal(t)
        parts.append(f"SELECT doc_id, line_no, {i} AS o, '{t}' AS term, line, ls FROM l WHERE regexp_matches(line, '(?i)\\b{t}\\b') OR contains({norm}, '{n}')")
    return f"""WITH d AS (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '(\\r\\n|\\n|\\r)$', ''), '\\r\\n|\\n|\\r') AS ls FROM documents WHERE text <> ''),
l AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls) AS line FROM d), h AS ({' UNION ALL '.join(parts)}), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, o) AS k FROM h)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, term, line AS line_text, coalesce(array_to_string(list_slice(ls, greatest(line_no - {context}, 1), line_no - 1), chr(10)), '') AS context_before,
  coalesce(array_to_string(list_slice(ls, line_no + 1, line_no + {context}), chr(10)), '') AS context_after FROM r{f' WHERE k <= {cap}' if cap else ''}"""


@query("TXT-01", term_sql(TERMS, None))
def txt_01(spark, sf):
    return tx.term_search(table(spark, sf, "documents"), TERMS)


KEYS = {"articles": ["the", "Ing"], "spanish": ["not to be found", "que los"], "nothing": ["zzzz qqqq"]}


@query("TXT-02", f"""WITH h AS ({term_sql(["the", "Ing", "not to be found", "que los", "zzzz qqqq"], None)}), c AS (SELECT term, count(*) AS n FROM h GROUP BY term),
k AS (SELECT * FROM (VALUES ('articles', 'the', true), ('articles', 'Ing', false), ('spanish', 'not to be found', true), ('spanish', 'que los', false), ('nothing', 'zzzz qqqq', true)) t(schema_key, term, p)),
s AS (SELECT schema_key, sum(CASE WHEN p THEN coalesce(n, 0) ELSE 0 END) AS a, sum(coalesce(n, 0)) AS b FROM k LEFT JOIN c USING (term) GROUP BY schema_key)
SELECT schema_key, CAST(a AS BIGINT) AS primary_hits, CAST(b AS BIGINT) AS total_hits, CASE WHEN a > 0 THEN 'primary' WHEN b > 0 THEN 'fallback_only' ELSE 'missing' END AS status FROM s""")
def txt_02(spark, sf):
    terms = [t for ts in KEYS.values() for t in ts]
    return tx.term_coverage(tx.term_search(table(spark, sf, "documents"), terms), KEYS)


@query("TXT-03", """WITH c AS (SELECT DISTINCT p_brand AS family, p_name AS "column" FROM part), m AS (SELECT DISTINCT p_brand AS family, p_name AS "column" FROM part WHERE p_partkey % 3 <> 0 UNION SELECT DISTINCT p_brand, 'old ' || p_type FROM part),
a AS (SELECT DISTINCT p_brand AS family, p_type AS alias, p_name AS "column" FROM part)
SELECT 'missing_description' AS issue, family, "column" AS item FROM c ANTI JOIN m USING (family, "column") UNION ALL SELECT 'unused_description', family, "column" FROM m ANTI JOIN c USING (family, "column")
UNION ALL SELECT 'duplicate_alias', family, alias FROM a GROUP BY family, alias HAVING count(*) > 1""")
def txt_03(spark, sf):
    part = table(spark, sf, "part")
    cols = part.select(F.col("p_brand").alias("family"), F.col("p_name").alias("column"))
    meta = part.filter("p_partkey % 3 <> 0").select(F.col("p_brand").alias("family"), F.col("p_name").alias("column")).unionByName(
        part.select(F.col("p_brand").alias("family"), F.concat(F.lit("old "), "p_type").alias("column")))
    return tx.metadata_audit(cols, meta, part.select(F.col("p_brand").alias("family"), F.col("p_type").alias("alias"), F.col("p_name").alias("column")))


def anchored(spark, sf):
    """Pages whose navigation entries are anchors, and links to them, cut short or run together."""
    pages = table(spark, sf, "pages").select("page_id", F.regexp_replace("html", '<a href="/([^"]*)">', '<a class="n" id="$1">').alias("html"))
    words = F.regexp_extract_all("html", F.lit('<a class="n" id="([^"]*)">'), 1)
    w = F.col("w")
    links = pages.select("page_id", F.explode(words).alias("w")).select(
        "page_id", F.when(F.length(w) % 3 == 0, w).when(F.length(w) % 3 == 1, F.substring(w, 1, 2)).otherwise(F.concat(w, F.lit("x"))).alias("fragment")).distinct()
    return pages, links


ANCHOR = """WITH p AS (SELECT page_id, regexp_extract_all(html, '<a href="/([^"]*)">', 1) AS ids FROM pages), w AS (SELECT page_id, unnest(ids) AS w FROM p),
k AS (SELECT DISTINCT page_id, CASE length(w) % 3 WHEN 0 THEN w WHEN 1 THEN substr(w, 1, 2) ELSE w || 'x' END AS fragment FROM w), b AS (SELECT k.page_id, fragment, ids FROM k JOIN p USING (page_id) WHERE NOT list_contains(ids, fragment))"""


@query("TXT-04", ANCHOR + " SELECT page_id, fragment FROM b")
def txt_04(spark, sf):
    return tx.anchor_audit(*anchored(spark, sf))[0]


@query("TXT-04:suggestions", ANCHOR + """, s AS (SELECT DISTINCT page_id, fragment, unnest(ids) AS c FROM b WHERE len(ids) > 0), z AS (SELECT page_id, fragment, c, lower(c) AS x, lower(fragment) AS f FROM s),
q AS (SELECT page_id, fragment, c AS suggestion, CASE WHEN x = f THEN 1000 ELSE 0 END + CASE WHEN starts_with(x, f) THEN 300 ELSE 0 END + CASE WHEN contains(x, f) THEN 150 ELSE 0 END - greatest(length(x) - length(f), 0) AS score FROM z),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id, fragment ORDER BY score DESC, suggestion) AS rank FROM q WHERE score > 0) SELECT page_id, fragment, CAST(rank AS INTEGER) AS rank, suggestion, CAST(score AS INTEGER) AS score FROM r""")
def txt_04_suggestions(spark, sf):
    return tx.anchor_audit(*anchored(spark, sf))[1]


SQL_WORDS = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"


@query("TXT-05", f"""WITH n AS (SELECT DISTINCT ' ' || p_brand || ' (' || p_type || ') ' || p_name || '_pct_db % me/100g' AS raw FROM part)
SELECT raw, trim(regexp_replace(replace(replace(replace(replace(lower(trim(raw)), '%', 'pct'), 'meq/100g', 'meq_100g'), 'me/100g', 'me_100g'), 'mg/kg', 'mg_kg'), '[^a-z0-9]+', '_', 'g'), '_') AS machine, {SQL_WORDS.format('raw')} AS words,
  trim(regexp_replace(regexp_replace(regexp_replace(lower(raw), '[_\\-/]+', ' ', 'g'), '[^a-z0-9% ]+', ' ', 'g'), '\\s+', ' ', 'g')) AS line, {SQL_WORDS.format("replace(replace(replace(raw, '_pct_db', ' percent dry basis'), '_pct', ' percent'), '_', ' ')")} AS human FROM n""")
def txt_05(spark, sf):
    raw = F.concat(F.lit(" "), "p_brand", F.lit(" ("), "p_type", F.lit(") "), "p_name", F.lit("_pct_db % me/100g"))
    n = table(spark, sf, "part").select(raw.alias("raw")).distinct()
    c = F.col("raw")
    return n.select("raw", machine_name(c).alias("machine"), normalize_text(c).alias("words"), normalize_line(c).alias("line"), human_name(c).alias("human"))


@query("TXT-06", f"""WITH t AS (SELECT DISTINCT p_name AS term FROM part UNION SELECT DISTINCT p_type FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 2) || ' ' || p_type FROM part), c AS (SELECT DISTINCT p_brand || '_' || p_type || '_' || p_name AS col FROM part),
x AS (SELECT term, col, {SQL_WORDS.format('term')} AS tp, {SQL_WORDS.format('col')} AS cp FROM t CROSS JOIN c), y AS (SELECT *, string_split(tp, ' ') AS tw, string_split(cp, ' ') AS cw FROM x)
SELECT term, col FROM y WHERE tp = cp OR (len(list_distinct(tw)) >= 2 AND list_has_all(cw, tw)) OR (length(tp) > 2 AND contains('_' || replace(cp, ' ', '_') || '_', '_' || replace(tp, ' ', '_') || '_'))""")
def txt_06(spark, sf):
    part = table(spark, sf, "part")
    terms = part.select(F.explode(F.array("p_name", "p_type", F.concat_ws(" ", F.split_part("p_name", F.lit(" "), F.lit(2)), "p_type"))).alias("term"))
    return tx.alias_match(terms, part.select(F.concat_ws("_", "p_brand", "p_type", "p_name").alias("col")), column="col")
