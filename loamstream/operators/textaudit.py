"""Searching documents for terms and auditing names, metadata and anchors."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import normalize_text
from ..plans.words import grams, meet_on_rarest


def _pattern(term: str, case_sensitive: bool, whole_word: bool) -> str:
    quoted = re.escape(term)
    body = rf"\b{quoted}\b" if whole_word else quoted
    return body if case_sensitive else f"(?iu){body}"


def _normal(term: str) -> str:
    s = re.sub(r"[_\-/]+", " ", term.lower())
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9% ]+", " ", s)).strip()


# every byte of a lower-cased text as searching sees it; line breaks stay
_LOOSE = bytes(c if c == 10 or c == 37 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
# letters that match s, k and i when case is ignored but are not lower-cased to them
_ODD = re.compile("[\u017f\u212a\u0130]")


def _loose(text: str) -> str:
    """`_normal` of every line of a text at once, one line each."""
    s = text.lower().encode("utf-8", "replace").translate(_LOOSE)
    return re.sub(rb" *\n *", b"\n", re.sub(rb"  +", b" ", s)).strip(b" ").decode()


class _Terms:
    """One automaton over the normalised terms, and what it cannot find: terms of signs only, odd letters."""

    def __init__(self, terms: Sequence[str], case_sensitive: bool, whole_word: bool):
        self.terms = list(terms)
        self.written = [re.compile(_pattern(t, case_sensitive, whole_word).replace("(?iu)", "(?i)")) for t in terms]
        self.bare = [i for i, t in enumerate(terms) if not _normal(t)]
        self.machine = ahocorasick.Automaton()
        self.any = False
        for word in {_normal(t) for t in terms} - {""}:
            self.machine.add_word(word, [i for i, t in enumerate(terms) if _normal(t) == word])
            self.any = True
        if self.any:
            self.machine.make_automaton()

    def hits(self, text: str, lines: list[str]) -> list[tuple[int, int]]:
        """(line, term) of every line that holds a term; a term as written is always found by its normalised form too."""
        found: set[tuple[int, int]] = set()
        if self.any:
            loose = _loose(text)
            at = list(self.machine.iter(loose))
            if at:
                line = np.searchsorted(np.flatnonzero(np.frombuffer(loose.encode(), np.uint8) == 10), [end for end, _ in at])
                found.update((n, i) for n, (_, which) in zip(line.tolist(), at, strict=True) for i in which)
        again = range(len(self.terms)) if _ODD.search(text) else self.bare
        found.update((n, i) for i in again if self.written[i].search(text) for n, x in enumerate(lines) if self.written[i].search(x))
        return sorted(found)


def term_search(docs: DataFrame, terms: Sequence[str], key: str = "doc_id", text: str = "text", context: int = 1, max_matches: int | None = None, case_sensitive: bool = False, whole_word: bool = True) -> DataFrame:
    """Lines that contain a term, as written or after normalising, with lines around them.

    A document is searched in its own row, whole; nothing is shuffled. One automaton of all terms runs once over the
    normalised text; lines and context are made for hits only. Hits come in line order, then term order, all of
    them; a caller that wants a preview sets `max_matches` per document.
    """
    rows = docs.filter(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(key), F.col(text).alias("_text"))
    wanted = list(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _Terms(wanted, case_sensitive, whole_word)
        for batch in batches:
            out: list[tuple] = []
            for row, written in enumerate(batch.column("_text").to_pylist()):
                # line breaks are made alike, the last one ends the last line
                body = re.sub("\r\n|\r", "\n", written).removesuffix("\n")
                lines = body.split("\n")
                for n, i in search.hits(body, lines)[:max_matches]:
                    out.append((row, n + 1, wanted[i], lines[n], "\n".join(lines[max(0, n - context) : n]), "\n".join(lines[n + 1 : n + 1 + context])))
                if len(out) > 20_000:
                    yield _hit_batch(batch, out)
                    out = []
            yield _hit_batch(batch, out)

    kind = dict(rows.dtypes)[key]
    return rows.mapInArrow(run, f"`{key}` {kind}, line_no int, term string, line_text string, context_before string, context_after string")


def _hit_batch(batch: pa.RecordBatch, hits: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array([h[i] for h in hits], pa.int32() if i == 1 else pa.string()) for i in range(1, 6)]
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([h[0] for h in hits], pa.int64())), *columns],
                                      names=[batch.schema.names[0], "line_no", "term", "line_text", "context_before", "context_after"])


def term_coverage(hits: DataFrame, keys: Mapping[str, Sequence[str]]) -> DataFrame:
    """Per schema key: hits of its primary (first) term, of any term, and the verdict."""
    spark = hits.sparkSession
    wanted = spark.createDataFrame(
        [(k, t, i == 0) for k, ts in keys.items() for i, t in enumerate(ts)], "schema_key string, term string, is_primary boolean")
    counts = hits.groupBy("term").agg(F.count(F.lit(1)).alias("_n"))
    n = F.coalesce("_n", F.lit(0))
    out = wanted.join(counts, "term", "left").groupBy("schema_key").agg(
        F.sum(F.when(F.col("is_primary"), n).otherwise(0)).alias("primary_hits"), F.sum(n).alias("total_hits"))
    return out.withColumn("status", F.when(F.col("primary_hits") > 0, "primary").when(F.col("total_hits") > 0, "fallback_only").otherwise("missing"))


def metadata_audit(columns: DataFrame, meta: DataFrame, aliases: DataFrame, on: Sequence[str] = ("family", "column")) -> DataFrame:
    """Columns without a description, descriptions without a column, aliases used twice in a family.

    `columns` and `meta` have the `on` columns, `aliases` has `family, alias, column`.
    """
    family, column = on

    def issue(df: DataFrame, kind: str, item: str) -> DataFrame:
        return df.select(F.lit(kind).alias("issue"), F.col(family).alias("family"), F.col(item).cast("string").alias("item"))

    bare = columns.select(*on).distinct().join(meta, list(on), "left_anti")
    orphan = meta.select(*on).distinct().join(columns, list(on), "left_anti")
    twice = aliases.select(family, "alias", column).distinct().groupBy(family, "alias").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return issue(bare, "missing_description", column).unionByName(issue(orphan, "unused_description", column)).unionByName(
        issue(twice, "duplicate_alias", "alias"))


def table_anchor(text: Column) -> Column:
    """`Table 18` to `table-18`."""
    n = F.regexp_extract(text, r"(?i)table\s+(\d+)", 1)
    return F.when(n != "", F.concat(F.lit("table-"), n))


def page_ids(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Ids of each page in order of appearance, as an array."""
    found = F.regexp_extract_all(F.col(html), F.lit(r"""(?i)<[a-z][^>]*?\sid\s*=\s*["']([^"']+)["']"""), 1)
    return pages.select(key, found.alias("ids"))


def _slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def anchor_audit(pages: DataFrame, links: DataFrame, key: str = "page_id", limit: int | None = None, gram: int = 3) -> tuple[DataFrame, DataFrame]:
    """(broken links, suggestions): fragments their page does not define, and its ids that score, ranked.

    `links` has `page_id, fragment` and optionally `table_number, table_title`. Ids are rows; a link is sound if its
    (page, fragment) is one. An id scores only if it contains the fragment, the table anchor or the title, so each of
    these looks up the ids of its page by its rarest part of `gram` characters. Equal links share their suggestions.
    """
    ids = page_ids(pages, key).select(key, F.explode("ids").alias("id")).distinct()
    broken = links.join(ids.withColumnRenamed("id", "fragment"), [key, "fragment"], "left_anti")
    have = set(links.columns)
    none = F.lit(None).cast("string")
    hint = table_anchor(F.col("table_number")) if "table_number" in have else none
    title = F.nullif(_slug(F.col("table_title")), F.lit("")) if "table_title" in have else none
    asked = broken.select(key, "fragment", F.lower("fragment").alias("_f"), hint.alias("_hint"), title.alias("_title")).distinct()

    sizes = range(gram + 1)  # a pattern shorter than a part is looked up whole
    posted = ids.withColumn("_c", F.lower("id")).withColumn("_g", F.explode(F.array_distinct(F.flatten(F.array(
        *[F.array(F.lit("")) if n == 0 else grams(F.col("_c"), n) for n in sizes])))))
    count = posted.groupBy(key, "_g").agg(F.count(F.lit(1)).alias("_df"))
    patterns = asked.select("*", F.explode(F.array_distinct(F.filter(F.array("_f", "_hint", "_title"), lambda p: p.isNotNull()))).alias("_p"))
    link = [key, "fragment", "_f", "_hint", "_title"]
    parts = patterns.withColumn("_g", F.explode(grams(F.col("_p"), gram)))
    rare = parts.join(count, [key, "_g"], "left").groupBy(*link, "_p").agg(
        F.min(F.struct("_df", "_g")).alias("_r"), F.count_if(F.col("_df").isNull()).alias("_lost")).filter("_lost = 0")
    near = rare.select(*link, "_p", F.col("_r._g").alias("_g")).join(posted, [key, "_g"]).filter(F.col("_c").contains(F.col("_p"))).select(*link, "id", "_c").distinct()

    def points(test: Column, value: int) -> Column:
        return F.when(F.coalesce(test, F.lit(False)), F.lit(value)).otherwise(F.lit(0))

    c, f = F.col("_c"), F.col("_f")
    score = (
        points(c == f, 1000) + points(c.startswith(f), 300) + points(c.contains(f), 150)
        + points(c.startswith(F.col("_hint")), 200) + points(c.contains(F.col("_hint")), 100) + points(c.contains(F.col("_title")), 250)
        - F.greatest(F.length(c) - F.length(f), F.lit(0))
    )
    scored = near.select(*link, F.col("id").alias("suggestion"), score.alias("score")).filter("score > 0")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(*link).orderBy(F.desc("score"), "suggestion")))
    best = ranked if limit is None else ranked.filter(F.col("rank") <= limit)
    return broken.select(key, "fragment"), best.select(key, "fragment", "rank", "suggestion", "score")


def alias_match(terms: DataFrame, columns: DataFrame, term: str = "term", column: str = "column") -> DataFrame:
    """Glossary terms that name a column: equal phrase, all of two or more words, or one whole word.

    Every match contains all words of the term, so a term meets columns by its rarest word; the full rule is tested on
    the meeting rows.
    """
    def words(df: DataFrame, name: str, prefix: str) -> DataFrame:
        phrase = normalize_text(F.col(name))
        return df.select(name).distinct().withColumn(f"{prefix}p", phrase).filter(F.col(f"{prefix}p") != "").withColumn(
            f"{prefix}w", F.array_distinct(F.split(f"{prefix}p", " ")))

    met = meet_on_rarest(words(terms, term, "_t"), words(columns, column, "_c"), "_tw", "_cw")
    padded = F.concat(F.lit("_"), F.replace(F.col("_cp"), F.lit(" "), F.lit("_")), F.lit("_"))
    inside = (F.length("_tp") > 2) & padded.contains(F.concat(F.lit("_"), F.replace(F.col("_tp"), F.lit(" "), F.lit("_")), F.lit("_")))
    match = (F.col("_tp") == F.col("_cp")) | (F.size("_tw") >= 2) | inside
    return met.filter(match).select(term, column)
