"""Every operator against its plain version or an exact property."""

import itertools
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loamstream.llm import decontaminate, fm_index, line_dedup, mixing, private_data, simhash, substring_dedup, suffix_dedup, token_counts, toxicity
from loamstream.llm.queries import ORACLE, QUERIES
from loamstream.llm.shared import components
from tools.check_queries import norm

from . import plain

SF = "/root/testdata/sf0.001"


def _texts(seed, n, parts=12, longest=60, letters="ab cé\n"):
    rng = random.Random(seed)
    pool = ["".join(rng.choice(letters) for _ in range(rng.randint(3, longest))) for _ in range(parts)]
    return [(i, "".join(rng.choice(pool) for _ in range(rng.randint(0, 9)))) for i in range(n)]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    rel = con.sql(ORACLE[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    idx = [rel.columns.index(c) for c in cols]
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert got == sorted((tuple(norm(r[i]) for i in idx) for r in rel.fetchall()), key=repr)


@pytest.mark.parametrize("block", [400, 10**6])
def test_substrings(spark, block):
    docs = _texts(1, 120, letters="ab c ")
    df = substring_dedup.dedup_substrings(spark.createDataFrame(docs, "doc_id long, text string"), k=4, block_bytes=block)
    got = sorted((r.doc_id, r.d.n_words, r.d.n_removed, r.d.kept_sha256) for r in df.select("doc_id", F.col("dedup").alias("d")).collect())
    assert got == plain.substrings(docs, 4) and sum(x[2] for x in got)


@pytest.mark.parametrize(("hot", "keep"), [(256, "none"), (256, "first"), (0, "none"), (2, "first")])
def test_suffixes(spark, hot, keep):
    docs = _texts(2, 100, letters="ab é")
    df = suffix_dedup.dedup_suffixes(
        spark.createDataFrame(docs, "doc_id long, text string"), size=40, keep=keep, block_bytes=1500, bucket=8, hot=hot, later=True).cache()
    got = sorted((r.doc_id, r.d.n_bytes, r.d.n_removed, r.d.n_spans, r.d.kept_sha256)
                 for r in df.select("doc_id", F.col("suffix_dedup").alias("d")).collect())
    assert got == plain.suffixes(docs, 40, keep) and sum(x[2] for x in got)
    later = sorted((r.doc_id, r.n) for r in df.select("doc_id", F.col("suffix_dedup.n_removed_later").alias("n")).collect())
    assert later == [(x[0], x[2]) for x in plain.suffixes(docs, 40, "first")]


def test_order_names_tell_common_prefixes():
    rng = np.random.default_rng(0)
    strings = [bytes(rng.integers(97, 99, rng.integers(0, 12)).astype(np.uint8)) for _ in range(60)]
    group = rng.integers(0, 3, 60)
    names = suffix_dedup.order_names(group, strings, 12)
    for i, x in enumerate(strings):
        for j, y in enumerate(strings):
            for d in range(min(len(x), len(y)) + 1):
                assert (names[i, d] == names[j, d]) == (group[i] == group[j] and x[:d] == y[:d])


def test_lines(spark):
    docs = _texts(3, 80, parts=10, longest=12, letters="ab\n\n")
    df = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), w=3)
    got = sorted((r.doc_id, r.d.clean_text, r.d.n_lines, r.d.n_removed) for r in df.select("doc_id", F.col("line_dedup").alias("d")).collect())
    assert got == plain.lines(docs, 3) and sum(x[3] for x in got)


@pytest.mark.parametrize("bucket", [8192, 4])
def test_near_links_connect_the_same(spark, bucket):
    rng = random.Random(4)
    prints = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(25):
            x = base
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    signed = {simhash._signed(x): x for x in prints}
    links = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "f long"), bucket=bucket)
    got = {r.node: r.root for r in components(links).collect()}
    ids = sorted(signed)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (signed[a] ^ signed[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {i: got.get(i, i) for i in ids} == {i: find(i) for i in ids}


def test_near_duplicates(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in QUERIES["op9_simhash_near_dedup"](spark, SF).collect()}
    assert got == plain.near(docs)


def test_chain_of_links(spark):
    n = 200
    order = random.Random(5).sample(range(n), n)
    links = spark.createDataFrame(list(zip(order, order[1:], strict=False)), "a long, b long")
    assert {r.root for r in components(links).collect()} == {0}


def test_fm_index():
    rng = np.random.default_rng(6)
    for _ in range(40):
        n, v = int(rng.integers(1, 60)), int(rng.integers(2, 6))
        seq = rng.integers(1, v, n)
        assert list(fm_index.suffix_array(seq)) == sorted(range(n), key=lambda i: list(seq[i:]))  # noqa: B023
        index, k = fm_index.FmIndex(seq, v), int(rng.integers(1, 5))
        phrases = rng.integers(1, v, (7, k))
        lo, hi = index.search(phrases)
        for q in range(7):
            want = [i for i in range(n - k + 1) if list(seq[i : i + k]) == list(phrases[q])]
            assert sorted(index.locate(np.arange(lo[q], hi[q]))) == want


def test_contamination(spark):
    docs = _texts(7, 60, letters="abc d")
    items = [(1, docs[3][1]), (2, "a b"), (3, docs[9][1][5:40]), (4, "…")]
    df = decontaminate.decontaminate(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), k=4)
    got = [(r.doc_id, r.c.n_words, r.c.n_hit, r.c["items"], r.c.clean_text) for r in df.select("doc_id", F.col("contamination").alias("c")).collect()]
    assert sorted(got) == sorted(plain.contamination(docs, items, 4)) and sum(x[2] for x in got)


@pytest.mark.parametrize("block", [8 << 20, 900, 120])
def test_contamination_in_blocks(spark, monkeypatch, block):
    """A benchmark of one block, of a few, and of about one item each; repeated rows and copied texts."""
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    rng = random.Random(17)
    pool = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(pool) for _ in range(rng.choice([3, 10, 14, 25])))) for i in range(40)] + [(40, ""), (41, None), (3, "w1 W2 w3 w4")]
    docs = []
    for i in range(120):
        words = [rng.choice(pool) for _ in range(rng.randint(0, 60))]
        if i % 3 == 0:
            words[len(words) // 2 : len(words) // 2] = (rng.choice(items[:40])[1]).upper().split()[: rng.choice([9, 12, 30])]
        docs.append((i, " ".join(words)))
    docs += [(200 + i, t) for i, t in docs[:30]]
    df = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string").withColumn("extra", F.lit(1)), spark.createDataFrame(items, "item_id long, text string"))
    assert df.columns == ["doc_id", "text", "extra", "contamination"]
    got = sorted((r.doc_id, r.c.n_words, r.c.n_hit, list(r.c["items"]), r.c.clean_text) for r in df.select("doc_id", F.col("contamination").alias("c")).collect())
    assert got == [(i, n, hit, sorted(map(str, who)), clean) for i, n, hit, who, clean in sorted(plain.contamination(docs, [x for x in items if x[1] is not None]))]
    assert sum(g[2] > 0 for g in got) > 30


def test_private_base(spark):
    rng = random.Random(8)
    bits = ["a.b@c.d", "@", ".", "x", " ", "+1 (017) 555-7713", "4111 1111 1111 1111", "1.2.3.4", "256.1.1.1", "-", "9", "12", "+", "é", "\U0001F600", "a@b", "_q@r.s.t"]
    docs = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))) for i in range(400)]
    docs += [(1000, "7" * 30_000), (1001, "a" * 30_000 + "@"), (1002, "1 " * 15_000), (1003, "1." * 15_000)]
    df = private_data.find_private(spark.createDataFrame(docs, "doc_id long, text string"))
    got = {r.doc_id: r.s for r in df.select("doc_id", private_data.spelled(F.col("private.base")).alias("s")).collect()}
    assert got == {i: plain.private(t) for i, t in docs}


def test_private_trees_add_and_redact(spark):
    rng = random.Random(9)
    rows = []
    for i in range(400):
        rows.append((i, f"call me at +{rng.randint(1, 9)} ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)} or write to joe{i}.doe@mail.com today"))
        rows.append((1000 + i, f"see page {rng.randint(1, 99)} of version {rng.randint(1, 9)}.{rng.randint(0, 9)} for more"))
    rows.append((5000, "write to jane.roe [at] mail [dot] org today"))
    df = private_data.find_private(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r for r in df.select("doc_id", private_data.spelled(F.col("private.spans")).alias("s"),
                                          private_data.redact(F.col("text"), F.col("private.spans")).alias("t")).collect()}
    assert got[5000].s == "email:9:37" and got[5000].t == "write to [email] today"
    assert all(got[1000 + i].s == "" for i in range(400)) and got[0].t == "call me at [phone] or write to [email] today"


def test_token_counts(spark):
    tokenizers = pytest.importorskip("tokenizers")
    enc = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    enc.encode_special_tokens = True
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [" " * 3000 + "x", "<|endoftext|>", None, ""]
    sizes = sorted(len(enc.encode(t or "", add_special_tokens=False).ids) for t in texts)
    sums = token_counts.suffix_sums(token_counts.histogram(spark.createDataFrame([(t,) for t in texts], "text string"))).cache()
    rows = {r.n_tokens: r for r in sums.collect()}
    assert sorted(x for x, r in rows.items() for _ in range(r.n_docs)) == sizes
    for x, r in rows.items():
        assert r.tokens_from == sum(s for s in sizes if s >= x) and r.truncated_tokens == sum(min(s, x) for s in sizes)
    limits = [0, 1, 7, 100, 1111, 10**9]
    got = {r.max_tokens: r.tokens for r in token_counts.truncated_totals(sums, limits).collect()}
    assert got == {m: sum(min(s, m) for s in sizes) for m in limits}
    assert {r.share: r.n_tokens for r in token_counts.quantiles(sums, [0.5, 1.0]).collect()} == {
        0.5: sizes[-(-len(sizes) // 2) - 1], 1.0: sizes[-1]}


def test_mixing_meets_the_targets(spark):
    rng = random.Random(10)
    rows = [(i, "w " * rng.randint(1, 30), rng.choice("ab" if rng.random() < 0.7 else "cde"), rng.choice(["en", "de", None])) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("kind", F.col("doc_id") % 3)
    goal = {"a": 0.3, "b": 0.3, "c": 0.2}
    out = mixing.mix(docs, source=goal, lang={"en": 0.5}, topic=0.5, topic_of=F.col("kind").cast("string")).cache()
    total = sum(len(r[1].split()) for r in rows)
    by = {r.source: r.t / total for r in out.groupBy("source").agg(F.sum(F.col("weight") * F.col("n_tokens")).alias("t")).collect()}
    assert all(abs(by[k] - v) < 1e-4 for k, v in goal.items()) and abs(sum(by.values()) - 1) < 1e-4
    by = {r.lang: r.t / total for r in out.groupBy("lang").agg(F.sum(F.col("weight") * F.col("n_tokens")).alias("t")).collect()}
    assert abs(by["en"] - 0.5) < 1e-4
    drawn = {r.source: r.t / total for r in out.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("t")).collect()}
    assert all(abs(drawn[k] - v) < 0.03 for k, v in goal.items())
    # the plain fixed point gives the same weights up to one factor
    cells = {}
    for r in out.collect():
        cells.setdefault((r.source, r.lang, r.topic), [0, r.weight])[0] += r.n_tokens
    w = dict.fromkeys(cells, 1.0)
    shares = [by_source(cells, goal), by_lang(cells, {"en": 0.5}), by_power(cells, 2, 0.5)]
    for _ in range(200):
        for side, share in enumerate(shares):
            now = {}
            for c, (n, _) in cells.items():
                now[c[side]] = now.get(c[side], 0) + n * w[c]
            for c in cells:
                w[c] *= share[c[side]] * total / now[c[side]]
    assert all(abs(w[c] - v) < 1e-3 * v for c, (_, v) in cells.items())


def _sums(cells, side):
    out = {}
    for c, (n, _) in cells.items():
        out[c[side]] = out.get(c[side], 0) + n
    return out


def _stated(cells, side, goal):
    seen = _sums(cells, side)
    rest = sum(v for k, v in seen.items() if k not in goal)
    return {k: goal[k] if k in goal else (1 - sum(goal.values())) * v / rest for k, v in seen.items()}


def by_source(cells, goal):
    return _stated(cells, 0, goal)


def by_lang(cells, goal):
    return _stated(cells, 1, goal)


def by_power(cells, side, power):
    seen = {k: v**power for k, v in _sums(cells, side).items()}
    return {k: v / sum(seen.values()) for k, v in seen.items()}


def test_decoding():
    counts = np.zeros(toxicity.SIZE**3)
    c = toxicity.codes("\n\n" + "\n\n".join(["idiot", "loser", "stupid", "trash", "pathetic", "moron", "the", "that", "with", "not"] * 50) + "\n\n")
    np.add.at(counts, c[:-2] * 4096 + c[1:-1] * 64 + c[2:], 1)
    model = toxicity.source_model(counts)
    for seen, want in (("1d10t", "idiot"), ("l0ser!!", "loser"), ("stuuuupid", "stupid"), ("tr@sh", "trash"), ("p.a.t.h.e.t.i.c", "pathetic"), ("m0r0n,", "moron"), ("that***", "that")):
        assert toxicity.restored(seen, model) == want
    assert "idiot" in toxicity.tokens("you I D I O T") and "stupid" in toxicity.tokens("s.t.u.p.i.d")


def test_decoding_equals_exhaustive_search():
    """Every path of the lattice, priced one by one; then a word far longer than any."""
    rng = np.random.default_rng(7)
    model = np.log(rng.dirichlet(np.ones(toxicity.SIZE), (toxicity.SIZE, toxicity.SIZE))).astype(np.float32)
    rnd = random.Random(8)
    for _ in range(150):
        word = "".join(rnd.choice("ab1!@s6$(|ßж99ooo") for _ in range(rnd.randint(1, 7)))
        best = None
        for path in itertools.product(*toxicity.lattice(word)):
            text, cost, a, b = "".join(p for p, _ in path), sum(c for _, c in path), 0, 0
            for c in text:
                z = toxicity.CODE.get(c, toxicity.OTHER if c.isalpha() else toxicity.EDGE)
                cost, a, b = cost + float(model[a, b, z]), b, z
            best = max(best or (-math.inf, ""), (cost + float(model[a, b, toxicity.EDGE]), text))
        got = toxicity.decode(word, model)
        assert got == best[1]
    assert len(toxicity.decode("1d!0t@" * 3000, model)) > 3000
    assert "c@t" in toxicity.tokens("see c @ t now") and "dog" in toxicity.tokens("see d-o-g now")


def test_toxicity_on_unseen_documents(spark):
    rng = random.Random(11)
    plain_words = ["tion", "thre", "ing", "and", "hand", "lyst", "ering", "ond", "stat", "hera", "inth", "than"]
    bad, hidden = ["idiot", "moron", "trash"], ["1d10t", "m0r0n", "tr@sh", "i d i o t"]
    rows, labels = [], []
    for i in range(3000):
        toxic = int(rng.random() < 0.2)
        text = [rng.choice(plain_words) for _ in range(30)]
        if toxic:
            text.insert(rng.randrange(30), rng.choice(hidden if i % 5 == 0 else bad))
        rows.append((i, " ".join(text)))
        labels.append((i, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = spark.createDataFrame([x for x in labels if x[0] % 5], "doc_id long, toxic int")
    got = {r.doc_id: r.toxicity for r in toxicity.score_toxicity(docs, seen).collect()}
    wrong = sum((got[i] >= 0.5) != y for i, y in labels if i % 5 == 0)
    assert wrong <= 12 and all(0 <= s <= 1 for s in got.values())  # of 600
