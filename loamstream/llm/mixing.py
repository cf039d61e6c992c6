"""Mixing to target weights: iterative proportional fitting over source, language and topic.

Token counts go into cells (source, language, topic), combined before the shuffle. Each source is one
row with its (language, topic) cells, so its factor is computed inside its row; what comes back per
round is one sum per (language, topic), from which the driver moves the language and topic factors.
Sources may be as many as there are sites; languages times topics must stay under `CLASSES`.

A document's weight is the product of its three factors, scaled so that the wanted number of tokens
comes out. It is taken floor(weight) times, and once more with the probability that is left; a hash of
the document decides, so a repeated run takes the same documents and the expected tokens of every
marginal are the targets.

Targets: shares per value, or an exponent that flattens what is there (share ~ tokens ** exponent).
Values without a stated share keep their observed share of what the stated ones leave.

Defined results: a null source, language or topic is a class of its own; a null text has no tokens; a
class without tokens has factor 1; without any tokens all weights are 1; repeated rows are drawn alike;
an empty table gives an empty result. Extra columns pass through; `topic`, `n_tokens`, `weight` and
`copies` are replaced when they exist, and the working names _source, _lang and _factor are left out.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cols, others, settle

CLASSES = 4096
ROUNDS, TOLERANCE = 200, 1e-6
SMALL = 100_000  # sources up to this many are sent to the tasks
NONE = "\u0000none"
OUT = ("topic", "n_tokens", "weight", "copies")

Target = Mapping[str, float] | float


def form_topic(text: Column) -> Column:
    """The form of a text as its topic: tables, marks, records with contact data, long and short prose."""
    n = F.length(text)
    return (
        F.when(F.coalesce(n, F.lit(0)) == 0, "empty")
        .when(F.regexp_count(text, F.lit("[|]")) * 50 > n, "table")
        .when(F.regexp_count(text, F.lit("[#*$%&<>]")) * 50 > n, "marks")
        .when(text.rlike(r"[0-9@]"), "record")
        .when(n >= 8000, "long")
        .when(n >= 800, "prose")
        .otherwise("short")
    )


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def _shares(tokens: dict[str, float], target: Target) -> dict[str, float]:
    """Target share of each observed value."""
    total = sum(tokens.values())
    if not isinstance(target, Mapping):
        raw = {k: v**target if v > 0 else 0.0 for k, v in tokens.items()}
        return {k: v / sum(raw.values()) for k, v in raw.items()}
    stated = {k: float(target[k]) for k, v in tokens.items() if k in target and v > 0}
    rest = {k: v for k, v in tokens.items() if k not in target and v > 0}
    left = max(0.0, 1.0 - sum(stated.values())) if rest else 0.0
    out = stated | {k: left * v / sum(rest.values()) for k, v in rest.items()}
    return {k: out.get(k, 0.0) / (sum(out.values()) or 1.0) for k in tokens} if total else {}


def rake(cells: DataFrame, source_target: Target, lang_target: Target, topic_target: Target):
    """(source factors as a DataFrame, {(lang, topic): factor}) for cells (source, lang, topic, tokens)."""
    known = settle(cells.groupBy("lang", "topic").agg(F.sum("tokens").alias("tokens")))
    if (n := known.count()) > CLASSES:
        raise ValueError(f"{n} pairs of language and topic; at most {CLASSES} are classes")
    seen = {(r.lang, r.topic): float(r.tokens) for r in known.collect()}
    pairs = sorted(seen)
    lang_sum: dict[str, float] = {}
    topic_sum: dict[str, float] = {}
    for (a, b), v in seen.items():
        lang_sum[a] = lang_sum.get(a, 0.0) + v
        topic_sum[b] = topic_sum.get(b, 0.0) + v
    total = sum(lang_sum.values())
    lang_goal, topic_goal = _shares(lang_sum, lang_target), _shares(topic_sum, topic_target)
    index = F.create_map(*[x for i, p in enumerate(pairs) for x in (F.lit(f"{p[0]}\u0001{p[1]}"), F.lit(i))])
    sources = cells.filter("tokens > 0").groupBy("source").agg(
        F.sum("tokens").alias("tokens"),
        F.collect_list(F.struct(index[F.concat_ws("\u0001", "lang", "topic")].alias("k"), (F.col("tokens") / F.lit(total)).alias("n"))).alias("cells"))
    sources = settle(_with_goal(sources, source_target))
    lang, topic = dict.fromkeys(lang_sum, 1.0), dict.fromkeys(topic_sum, 1.0)

    def factors() -> Column:
        return F.array(*[F.lit(lang[a] * topic[b]) for a, b in pairs])

    def fitted() -> DataFrame:
        got = F.aggregate("cells", F.lit(0.0), lambda s, c: s + c["n"] * F.get(F.col("_f"), c["k"]))
        return sources.withColumn("_f", factors()).withColumn("_got", got).withColumn(
            "factor", F.when(F.col("_got") > 0, F.col("goal") / F.col("_got")).otherwise(0.0))

    for _ in range(ROUNDS):
        rows = fitted().select("factor", F.explode("cells").alias("c")).groupBy("c.k").agg(
            F.sum(F.col("factor") * F.col("c.n")).alias("n")).collect()
        mass = {pairs[r.k]: r.n for r in rows}
        moved = 0.0
        for goal, factor, side in ((lang_goal, lang, 0), (topic_goal, topic, 1)):
            now = dict.fromkeys(factor, 0.0)
            for p, v in mass.items():
                now[p[side]] += v * lang[p[0]] * topic[p[1]]
            for k in factor:
                if now[k] > 0:
                    step = goal[k] / now[k]
                    moved = max(moved, abs(step - 1.0) if goal[k] > 0 else 0.0)
                    factor[k] *= step
        if moved < TOLERANCE:
            break
    else:
        warnings.warn(f"the targets do not fit together: after {ROUNDS} rounds a factor still moves by {moved:.2g}", stacklevel=2)
    return fitted().select("source", "factor"), {p: lang[p[0]] * topic[p[1]] for p in pairs}


def _with_goal(sources: DataFrame, target: Target) -> DataFrame:
    """The target share of each source, without collecting sources."""
    if not isinstance(target, Mapping):
        raw = F.pow(F.col("tokens").cast("double"), F.lit(float(target)))
        total = sources.agg(F.sum(raw)).first()[0] or 1.0
        return sources.withColumn("goal", raw / F.lit(total))
    if not target:
        return _with_goal(sources, 1.0)
    stated = F.create_map(*[x for k, v in target.items() for x in (F.lit(k), F.lit(float(v)))])
    row = sources.agg(
        F.sum(stated[F.col("source")]).alias("stated"),
        F.sum(F.when(stated[F.col("source")].isNull(), F.col("tokens"))).alias("rest")).first()
    left = max(0.0, 1.0 - (row.stated or 0.0)) if row.rest else 0.0
    scale = (row.stated or 0.0) + left or 1.0
    goal = F.coalesce(stated[F.col("source")], F.lit(left) * F.col("tokens") / F.lit(float(row.rest or 1))) / F.lit(scale)
    return sources.withColumn("goal", goal)


def mix(docs: DataFrame, source: Target = 0.7, lang: Target = 0.7, topic: Target = 0.7, id: str = "doc_id", text: str = "text",
        topic_of: Column | None = None, tokens_of: Column | None = None, budget: float | None = None, seed: int = 17) -> DataFrame:
    """Every document with topic, n_tokens, weight and copies (0: left out).

    `budget` is the wanted number of tokens, by default as many as there are.
    """
    topic_of = form_topic(F.col(text)) if topic_of is None else topic_of
    tokens_of = word_count(F.col(text)) if tokens_of is None else tokens_of
    keep = cols(others(docs, *OUT, "_source", "_lang", "_factor"))
    own = F.coalesce(F.col("source").cast("string"), F.lit(NONE)).alias("_source")
    df = docs.select(
        *keep, own, F.coalesce(F.col("lang").cast("string"), F.lit(NONE)).alias("_lang"),
        F.coalesce(topic_of, F.lit(NONE)).alias("topic"), F.coalesce(tokens_of, F.lit(0)).cast("long").alias("n_tokens"))
    cells = settle(df.groupBy(F.col("_source").alias("source"), F.col("_lang").alias("lang"), "topic").agg(F.sum("n_tokens").alias("tokens")))
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return df.select(*keep, "topic", "n_tokens", F.lit(1.0).alias("weight"), F.lit(1).cast("long").alias("copies"))
    sources, pairs = rake(cells, source, lang, topic)
    sources = settle(sources.select(F.col("source").alias("_source"), F.col("factor").alias("_factor")))
    if sources.count() <= SMALL:
        sources = F.broadcast(sources)
    pair = F.create_map(*[x for p, v in pairs.items() for x in (F.lit(f"{p[0]}\u0001{p[1]}"), F.lit(v))])
    scale = F.lit(float(budget if budget is not None else total) / total)
    weight = F.coalesce(F.col("_factor") * pair[F.concat_ws("\u0001", "_lang", "topic")] * scale, F.lit(1.0))
    rounded = F.round(weight, 9)
    draw = F.pmod(F.xxhash64(F.col(id), F.col(text), F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    df = df.join(sources, "_source", "left").withColumn("weight", rounded)
    whole = F.floor("weight")
    copies = whole + F.when(draw < F.col("weight") - whole, 1).otherwise(0)
    return df.select(*keep, "topic", "n_tokens", "weight", copies.cast("long").alias("copies"))
