"""Private data: candidate spans, boosted trees over format and context, a calibrated threshold.

Base rules (email, ip, card, phone) give spans that always stand. High-recall generators propose more,
overlapping ones. Where a base rule has a say its verdict is the label: a candidate on an accepted
match is positive, one on a rejected match (a card without its check digit, an address part over 255)
or a short plain number is negative; all others are unlabelled. Boosted trees learn from at most about
`SAMPLE` labelled candidates of three folds; all of the fold they did not see sets the lowest threshold
whose precision is still `PRECISION`. Candidates over it that touch no base span are added.

The path is column expressions only: matches come from split and extract on one pattern, places from
running lengths, and the trees are compiled to CASE expressions, so scoring is part of the projection.
A document is read once; what is kept of it is its arrays of spans, cut off by a checkpoint before the
trees are fitted. Nothing is shuffled but the histogram of calibrated scores.

Patterns give the same matches as the plain ones: possessive where no backtracking can help (so long
runs neither overflow the stack nor go quadratic), and started only where a run starts or the last
match ended.

Defined results: a null or empty text has no spans; places are code points, end exclusive; repeated
rows are judged each on its own; without labelled candidates of both sorts to fit on, or where no
threshold reaches the precision, nothing is added; an
empty table gives an empty result. Extra columns pass through; `private` is replaced when it exists, and working names (WORKING) are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cols, others, settle

# The base rules.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}

# High-recall generators: what they propose, and the kind an added span is reported as.
GENERATORS = {
    "mail": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++[\x20]?(?:@|\[at\]|\(at\))[\x20]?[A-Za-z0-9-]++"
             r"(?:[\x20]?(?:\.|\[dot\]|\(dot\))[\x20]?[A-Za-z0-9-]++)*+", "email"),
    "digits": (r"(?:(?<![0-9+(])|\G)[+(]{0,2}[0-9]++(?:[\x20().-]{1,2}+[0-9]++)*+", "phone"),
    "dotted": (r"(?:(?<![0-9A-Fa-f:.])|\G)[0-9A-Fa-f]++(?:[.:][0-9A-Fa-f]++){2,7}+", "ip"),
}
WORKING = ("private", "base", "cand", "_more", "_t", "_refused", *(f"_{k}" for k in (*KINDS, *GENERATORS)))
CONTEXT = 24
SHORT = 7  # a plain number of fewer digits is a negative
SAMPLE = 20_000
FOLDS = 4  # one fold in FOLDS calibrates
PRECISION = 0.9
TREES, DEPTH = 12, 4
BINS = 100
CUES = (
    r"(?i)\b(?:mail|contact|write|correo|courriel)", r"(?i)\b(?:tel|phone|call|mobile|fax|telefon|fono)",
    r"(?i)\b(?:card|visa|karte|tarjeta|carte|account|konto)", r"(?i)\b(?:ip|host|server|addr|login)",
    r"(?i)\b(?:version|v|no|page|seite|section|chapter|license|licence|by)[\x20.:]*$", r"[=:#]\s*[\"']?$",
)


def found(text: Column, pattern: str) -> Column:
    """Matches as array<struct<start, end, m>>: the text between matches and the matches, laid end to end."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(gaps.alias("g"), hits.alias("h"))
    empty = F.array().cast("array<struct<start:int,end:int,m:string>>")
    walked = F.aggregate(
        pairs,
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda a, x: F.when(x["h"].isNull(), a).otherwise(F.struct(
            (a["at"] + F.length(x["g"]) + F.length(x["h"])).alias("at"),
            F.concat(a["out"], F.array(F.struct(
                (a["at"] + F.length(x["g"])).alias("start"),
                (a["at"] + F.length(x["g"]) + F.length(x["h"])).alias("end"), x["h"].alias("m")))).alias("out"))),
        lambda a: a["out"],
    )
    return walked


def _gated(text: Column, pattern: str, gate: Column) -> Column:
    return F.when(gate, found(text, pattern)).otherwise(F.array().cast("array<struct<start:int,end:int,m:string>>"))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]+", "")


def luhn(digits: Column) -> Column:
    """The check-digit rule: from the right, every second digit doubled, minus nine if over nine."""
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(
        i % 2 == 1, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def accepted(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: (
            F.when(F.length(F.ltrim(p, F.lit("0"))) <= 3, F.coalesce(F.nullif(F.ltrim(p, F.lit("0")), F.lit("")), F.lit("0")).cast("int") <= 255)
            .otherwise(False)))
    n = F.length(_digits(m))
    if kind == "phone":
        return n.between(9, 15)
    return F.when(n.between(12, 19), luhn(_digits(m))).otherwise(False)


def _accepted_spans(rank: int, kind: str) -> Column:
    return F.transform(
        F.filter(f"_{kind}", lambda c: accepted(kind, c["m"])),
        lambda c: F.struct(c["start"].alias("start"), F.lit(rank).alias("rank"), c["end"].alias("end")))


def _refused_spans(kind: str) -> Column:
    """Matches that failed. Fewer digits than a card has say nothing: they may be another kind of number."""
    return F.transform(
        F.filter(f"_{kind}", lambda c: ~accepted(kind, c["m"]) & ((F.length(_digits(c["m"])) >= 12) if kind == "card" else F.lit(True))),
        lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end")))


def _touch(a: Column, spans: Column) -> Column:
    return F.exists(spans, lambda s: (s["start"] < a["end"]) & (a["start"] < s["end"]))


def features(text: Column, c: Column, generator: str) -> list[Column]:
    """Format and context of a candidate, as doubles."""
    m = c["m"]
    before = F.substring(text, F.greatest(c["start"] - CONTEXT, F.lit(0)) + 1, F.least(c["start"], F.lit(CONTEXT)))
    after = F.substring(text, c["end"] + 1, F.lit(4))
    digits = _digits(m)

    def share(pattern: str) -> Column:
        return (F.length(m) - F.length(F.regexp_replace(m, pattern, ""))).cast("double")

    flags = [
        m.startswith("+"), m.contains("("), m.contains("@"), F.length(before) == 0,
        before.rlike(r"[A-Za-z0-9]$"), after.rlike(r"^[A-Za-z0-9]"), after.rlike(r"^[\s.,;!?]|^$"),
        *[before.rlike(x) for x in CUES], *[F.lit(generator == g) for g in GENERATORS],
    ]
    return [
        F.length(m).cast("double"), F.length(digits).cast("double"), share(r"[A-Za-z]"), share(r"\."), share(r"[\x20]"),
        share("-"), share("[:]"), F.size(F.split(m, "[^0-9]+")).cast("double"),
        F.array_max(F.transform(F.split(m, "[^0-9]+"), lambda p: F.length(p))).cast("double"),
        *[x.cast("double") for x in flags],
    ]


N_FEATURES = 9 + 7 + len(CUES) + len(GENERATORS)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every column, `base` spans, and `cand`: candidates with label (null: unlabelled) and features."""
    keep = cols(others(docs, *WORKING))
    t = F.col("_t")
    df = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    some = t.rlike("[0-9]")
    gates = {k: (some if NEEDS[k] is None else t.contains(NEEDS[k]) & (some if k != "email" else F.lit(True))) for k in KINDS}
    df = df.select("*", *[_gated(t, PATTERNS[k], gates[k]).alias(f"_{k}") for k in KINDS])
    mail = t.contains("@") | t.contains("(at)") | t.contains("[at]")
    gen_gate = {"mail": mail, "digits": some, "dotted": some}
    df = df.select(
        "*",
        F.concat(*[_accepted_spans(i, k) for i, k in enumerate(KINDS)]).alias("base"),
        F.concat(*[_refused_spans(k) for k in ("ip", "card", "phone")]).alias("_refused"),
        *[_gated(t, GENERATORS[g][0], gen_gate[g]).alias(f"_{g}") for g in GENERATORS],
    )
    return df.select(
        *keep, F.array_sort("base").alias("base"),
        F.concat(*[_candidates(t, g) for g in GENERATORS]).alias("cand"))


def _candidates(text: Column, g: str) -> Column:
    kind = KINDS.index(GENERATORS[g][1])
    return F.transform(f"_{g}", lambda c: F.struct(
        c["start"].alias("start"), F.lit(kind).alias("rank"), c["end"].alias("end"),
        F.when(F.exists("base", lambda s: (c["start"] <= s["start"]) & (s["end"] <= c["end"])), F.lit(1))
        .when(_touch(c, F.col("base")), F.lit(None).cast("int"))
        .when(_touch(c, F.col("_refused")) | (F.lit(g != "mail") & (F.length(_digits(c["m"])) < SHORT)), F.lit(0)).alias("label"),
        F.array(*features(text, c, g)).alias("x")))


# --- boosted trees --------------------------------------------------------------------------------
def _tree(node, x: Column) -> Column:
    """A fitted tree as nested CASE expressions over the feature array."""
    if node.getClass().getSimpleName() == "LeafNode":
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(F.get(x, F.lit(split.featureIndex())) <= float(split.threshold()), _tree(node.leftChild(), x)).otherwise(
        _tree(node.rightChild(), x))


def fit(scanned: DataFrame, sample: int = SAMPLE):
    """(score of a feature array, threshold), or None without enough labelled candidates.

    Equal feature arrays with equal labels are one row, weighted by the logarithm of their number when
    trees are fitted and by their number when the threshold is set, so copies never fill the sample.
    """
    rows = scanned.select(F.explode("cand").alias("c")).filter("c.label IS NOT NULL").groupBy(
        F.col("c.x").alias("x"), F.col("c.label").alias("label")).agg(F.count("*").alias("weight"))
    rows = settle(rows)
    total = rows.count()
    draw = F.pmod(F.xxhash64("x", "label"), F.lit(1 << 20))
    fold = F.pmod(F.xxhash64("x"), F.lit(FOLDS))
    # only what trees are fitted on is sampled; the threshold counts all rows of the unseen fold
    rows = rows.filter((fold == 0) | (draw < int((1 << 20) * min(1.0, sample / max(total, 1))))).select(
        "label", F.col("weight").alias("n"), F.log1p("weight").alias("weight"), fold.alias("fold"), "x", *[F.get("x", F.lit(i)).alias(f"x{i}") for i in range(N_FEATURES)])
    train = VectorAssembler(inputCols=[f"x{i}" for i in range(N_FEATURES)], outputCol="features").transform(rows.filter("fold > 0"))
    if train.select("label").distinct().count() < 2:
        return None
    model = GBTClassifier(labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, seed=7, maxBins=64).fit(
        train.select("label", "weight", "features"))
    trees = [(float(w), t._call_java("rootNode")) for w, t in zip(model.treeWeights, model.trees, strict=True)]

    def score(x: Column) -> Column:
        margin = reduce(lambda a, b: a + b, [F.lit(w) * _tree(n, x) for w, n in trees])
        return 1 / (1 + F.exp(-2 * margin))

    bins = rows.filter("fold = 0").groupBy(F.floor(score(F.col("x")) * BINS).alias("bin")).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("label")).alias("good")).collect()
    n = good = 0.0
    least, below = None, 0.0
    for r in sorted(bins, key=lambda r: -r.bin):
        n, good = n + r.n, good + r.good
        if good < PRECISION * n:
            below = (r.bin + 1) / BINS
            break
        least = r.bin / BINS
    # every threshold between the last good bin and the next one met has the same precision
    return None if least is None else (score, (least + min(below, least)) / 2)


def find_private(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """Every document with `private`: base and all spans as sorted array<struct<start, rank, end>>.

    `rank` is the kind's place in KINDS. Of added candidates that overlap, the earliest stands.
    """
    scanned = settle(scan(docs, text))
    fitted = fit(scanned, sample)
    keep = cols(others(scanned, *WORKING))
    if fitted is None:
        return scanned.select(*keep, F.struct("base", F.col("base").alias("spans")).alias("private"))
    score, threshold = fitted
    added = F.transform(
        F.filter("cand", lambda c: ~_touch(c, F.col("base")) & (score(c["x"]) >= threshold)),
        lambda c: F.struct(c["start"].alias("start"), c["rank"].alias("rank"), c["end"].alias("end")))
    # the earliest of overlapping candidates stands: walk them by start
    walked = F.aggregate(
        F.array_sort(added), F.array().cast("array<struct<start:int,rank:int,end:int>>"),
        lambda a, c: F.when((F.size(a) == 0) | (c["start"] >= F.element_at(a, -1)["end"]), F.concat(a, F.array(c))).otherwise(a))
    return scanned.select(*keep, "base", walked.alias("_more")).select(
        *keep, F.struct("base", F.array_sort(F.concat("base", "_more")).alias("spans")).alias("private"))


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[{}]") -> Column:
    """The text with each span replaced by its kind; overlapping spans are merged under the first kind."""
    names = F.array(*[F.lit(mark.format(k)) for k in KINDS])
    walked = F.aggregate(
        spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.when(s["start"] >= a["at"], F.struct(
            s["end"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.get(names, s["rank"])).alias("out")),
        ).otherwise(F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return walked
