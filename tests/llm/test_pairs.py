import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import induced, jaccard_join, mixing, suffix_dedup, top_k
from lattica.llm import components as component_steps
from lattica.llm.components import components


def test_suffix_arrays_and_prefixes():
    rng = np.random.RandomState(3)
    for _ in range(300):
        n, k = rng.randint(1, 60), rng.randint(1, 5)
        t = np.append(rng.randint(1, k + 1, n), 0)
        want = sorted(range(len(t)), key=lambda i: tuple(t[i:]))
        order = induced.suffix_array(t)
        assert order.tolist() == want == induced._one_by_one(t.tolist(), k + 1)
        p = induced.permuted_prefixes(t, order, np.array([0]), 10**6)
        for x, y in zip(order[:-1], order[1:], strict=True):
            shared = 0
            while max(x, y) + shared < len(t) and t[x + shared] == t[y + shared]:
                shared += 1
            assert p[y] == shared


def brute_repeats(rows, least):
    seen, out = set(), {}
    for d, text in sorted(rows):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - least + 1):
            w = raw[i : i + least]
            if w in seen:
                gone[i : i + least] = True
            seen.add(w)
        kept = bytes(x for x, g in zip(raw, gone, strict=True) if not g)
        out[d] = (len(raw), int(gone.sum()), int((np.diff(np.r_[False, gone].astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("least", [20, 100])
def test_repeats_match_brute_force(spark, least):
    rng = random.Random(least)
    rows = [(i, "".join(rng.choice(["ab", "abc", "é", "zz", "a" * 30, "xyxyxyxy", "漢字", "\x00"]) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "q" * 5000), (203, "q" * 700), (204, rows[0][1]), (-5, "q" * 101)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_bytes int").repartition(3)
    for most in (20_000, 2):
        got = {r[0]: tuple(r)[1:] for r in suffix_dedup.removal_report(df, least, most_in_a_shard=most).collect()}
        assert got == brute_repeats(rows, least)


def test_repeats_of_odd_tables(spark):
    text = "".join(map(chr, range(200, 500)))
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text), (None, "x")], "doc_id long, text string")
    rows = suffix_dedup.removal_report(df, 100).collect()
    assert len(rows) == 5 and [r["n_removed"] for r in rows if r["doc_id"] == 1][0] == [r["n_removed"] for r in rows if r["doc_id"] == 1][1]
    assert sum(r["n_removed"] == 0 for r in rows if r["n_bytes"] > 100) >= 1
    kept = suffix_dedup.without_repeats(df.withColumn("n", F.lit(1)), 100)
    assert kept.columns == ["doc_id", "text", "n"] and kept.count() == 5
    assert suffix_dedup.removal_report(df.limit(0), 100).count() == 0


def test_many_texts_of_one_id_keep_their_own(spark):
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    shared = " ".join(word() for _ in range(30))
    texts = [" ".join(word() for _ in range(40)) + (shared if k % 50 == 0 else "") for k in range(500)]
    names = ["_text", "d", "t", "g", "spans", "doc", "n", "id", "s"]
    df = spark.createDataFrame([(5, t) for t in texts] + [(1, texts[7])], "doc_id long, text string").select("*", *[F.lit(k).alias(k) for k in names])
    rows = suffix_dedup.removal_report(df, 100).collect()
    gone = sorted((r["n_removed"] for r in rows), reverse=True)
    assert gone[0] == len(texts[7]) and sum(n > 0 for n in gone) == 10 and all(len(shared) <= n < len(shared) + 20 for n in gone[1:10])
    kept = suffix_dedup.without_repeats(df, 100)
    assert kept.columns == df.columns and kept.filter("doc <> 'doc' OR spans <> 'spans'").count() == 0
    assert len({r["text"] for r in kept.collect()} & set(texts)) == 500 - 10 + 1


@pytest.mark.parametrize(("most", "room"), [(0, 1), (1, 1 << 11), (2, 1 << 25)])
def test_common_anchors_are_dealt(spark, monkeypatch, most, room):
    """However anchors are combined in tasks and dealt, the removed bytes are those of brute force."""
    monkeypatch.setattr(suffix_dedup, "MOST_OF_A_TASK", most)
    monkeypatch.setattr(suffix_dedup, "HELD_TEXT", room)
    rng = random.Random(29)
    piece = lambda n: "".join(rng.choice("abcdef ") for _ in range(n))
    shared, edges = piece(150), [piece(30) for _ in range(3)]
    rows = [(k, rng.choice([piece(rng.randint(0, 90)), rng.choice(edges)]) + shared[rng.choice([0, 0, 20]) :] + piece(rng.randint(0, 90))) for k in range(120)]
    rows += [(200 + k, rows[5][1]) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for most_in_a_shard in (20_000, 2):
        assert {r[0]: tuple(r)[1:] for r in suffix_dedup.removal_report(df, 100, most_in_a_shard=most_in_a_shard).collect()} == brute_repeats(rows, 100)


def test_a_passage_of_all_texts_puts_few_rows_in_a_bucket(spark):
    rng = random.Random(31)
    piece = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    shared = piece(400)
    df = spark.createDataFrame([(k, piece(60) + shared + piece(60)) for k in range(3000)], "doc_id long, text string").repartition(4)
    sent = suffix_dedup._bucketed(suffix_dedup._keyed(df, "doc_id", "text"), 100, 64)
    by_anchor = sent.filter(f"kind = {suffix_dedup.BY_ANCHOR}").select("g").collect()
    grams = np.concatenate([np.frombuffer(r["g"], np.uint64) for r in by_anchor])
    assert np.unique(grams, return_counts=True)[1].max() <= 4 * suffix_dedup.MOST_OF_A_TASK
    held = sent.groupBy("b").agg(F.sum(F.octet_length("g") / 8)).toPandas().iloc[:, 1]
    assert held.sum() >= 3000 * 3 and held.max() < 2 * held.median()


@pytest.mark.parametrize("bits", [64, 2, 0])
def test_claims_are_verified_on_bytes(spark, monkeypatch, bits):
    monkeypatch.setattr(suffix_dedup, "NEAR_BITS", bits)
    rng = random.Random(17)
    piece = lambda n: "".join(rng.choice("abcd ") for _ in range(n))
    shared, edge = piece(60), [piece(45) for _ in range(4)]
    rows = [(k, rng.choice(edge) + shared + rng.choice(edge)) for k in range(30)] + [(100 + k, piece(200)) for k in range(5)]
    rows += [(200, rows[3][1]), (201, rows[32][1] + rows[33][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert {r[0]: tuple(r)[1:] for r in suffix_dedup.removal_report(df, 100).collect()} == brute_repeats(rows, 100)


def test_regular_texts_are_told_apart(spark):
    rows = [(1, thue_morse(2048)), (2, thue_morse(2048).translate(str.maketrans("ab", "ba"))), (3, thue_morse(4096)), (4, "x" * 3000), (5, "xy" * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for least, most in ((100, 20_000), (1100, 1)):
        assert {r[0]: tuple(r)[1:] for r in suffix_dedup.removal_report(df, least, most_in_a_shard=most).collect()} == brute_repeats(rows, least)


def grams(text, words):
    raw = bytes(x + 32 if 65 <= x <= 90 else x for x in (text or "").encode())
    found = [x for x in re.split(rb"[\x20\x09-\x0d]+", raw) if x]
    return frozenset(tuple(found[i : i + words]) for i in range(len(found) - words + 1)) if len(found) >= words else frozenset([tuple(found)] if found else [])


def brute_components(rows, words, percent):
    sets = {d: grams(t, words) for d, t in rows}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in sets}


def near_copies(seed, n=250):
    rng = random.Random(seed)
    words = ["a", "b", "cc", "Dd", "e", "fé"]
    base = [[rng.choice(words) for _ in range(rng.randint(0, 60))] for _ in range(12)]
    rows = []
    for i in range(n):
        x = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            if x:
                x[rng.randrange(len(x))] = rng.choice(words)
        rows.append((i * 3, rng.choice([" ", "  \n", "\t"]).join(x)))
    return [*rows, (7000, None), (7001, ""), (7002, " \n "), (7003, "One two"), (7004, "one  two"), (7005, "z " * 4000)]


@pytest.mark.parametrize("words,percent", [(4, 85), (2, 60)])
def test_components_match_brute_force(spark, words, percent):
    rows = near_copies(words)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, sid int").repartition(3)
    want = brute_components(rows, words, percent)
    got = {r[0]: (r[1], r[2]) for r in jaccard_join.component_report(df, words, percent).collect()}
    assert got == want
    kept = jaccard_join.first_of_groups(df, words, percent)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {c for _, c in want.values()}


def test_large_groups_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "MOST_IN_A_TREE", 7)
    monkeypatch.setattr(jaccard_join, "BROADCAST_SETS", 3)
    rows = near_copies(11)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r[0]: (r[1], r[2]) for r in jaccard_join.component_report(df, 3, 70).collect()} == brute_components(rows, 3, 70)


def test_equal_groups_of_many_large_hashes(spark):
    sids = spark.range(8000).select(F.col("id").alias("sid")).filter(F.xxhash64("sid") > 1 << 62)  # their sum is beyond 64 bits, even without the low byte of each
    least = sids.agg(F.min("sid")).first()[0]
    met = sids.crossJoin(spark.createDataFrame([(1,), (2,), (3,)], "gram long")).filter((F.col("gram") < 3) | (F.col("sid") > least))
    assert {r["gram"]: r["w"] for r in jaccard_join.equal_groups(met).collect()} == {1: 2, 3: 1}


def test_similar_rows_of_odd_tables(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (None, None), (2, "other text of five words")], "doc_id long, text string")
    got = sorted((str(r[0]), r[1], str(r[2])) for r in jaccard_join.component_report(df).collect())
    assert got == [("1", 2, "1"), ("1", 2, "1"), ("2", 2, "2"), ("None", 0, "None"), ("None", 2, "1")]
    assert jaccard_join.component_report(df.limit(0)).count() == 0
    assert jaccard_join.first_of_groups(df).count() == 4


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


def test_regular_words_are_told_apart(spark):
    rows = []
    for n in (1024, 2048, 4096):
        w = thue_morse(n)
        rows += [(10 * n, w), (10 * n + 1, w.translate(str.maketrans("ab", "ba"))), (10 * n + 2, f"x {w} y z w"), (10 * n + 3, f"x {w.translate(str.maketrans('ab', 'ba'))} y z w")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r[0]: (r[1], r[2]) for r in jaccard_join.component_report(df).collect()} == brute_components(rows, 4, 85) == {d: (1 if d % 10 < 2 else 2, d) for d, _ in rows}
    assert jaccard_join.first_of_groups(df).count() == len(rows)


def test_overlap_counts_words():
    rng = random.Random(4)
    for _ in range(300):
        x, y = (" ".join(rng.choice("a b cc A \x0b \u00a0 \u0085x é".split(" ")) for _ in range(rng.choice([0, 1, 3, 4, 30]))) for _ in range(2))
        for words in (1, 3, 4):
            a, b = grams(x, words), grams(y, words)
            assert jaccard_join.overlap(x.encode(), y.encode(), words) == (len(a), len(b), len(a & b))


def test_sets_that_share_a_name_go_by_the_second():
    data, off = (lambda raw: (np.frombuffer(raw, np.uint8), np.array([0, 9, 18])))(b"a b c d ea b c d f")
    gram, at, sid = jaccard_join._named(data, off, 4, np.zeros(0, np.int64))
    _, _, other = jaccard_join._named(data, off, 4, sid[:1])
    assert other[0] != sid[0] and other[1] == sid[1] and len(gram) == at[-1] == 4


def test_rows_of_one_id_and_clashing_names(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(40)) for _ in range(60)]
    names = ["_th", "_h", "th", "id", "sid", "doc", "gone", "root", "best", "n", "gram", "_gone"]
    df = spark.createDataFrame([(7, t) for t in texts] + [(9, texts[0]), (7, texts[0]), (7, "w" * 5000), (8, "w" * 5000)], "doc_id long, text string").select("*", *[F.lit(k).alias(k) for k in names])
    kept = jaccard_join.first_of_groups(df)
    assert kept.columns == df.columns and kept.count() == 62
    rows = kept.collect()
    assert sorted(r["text"] for r in rows) == sorted([*texts, texts[0], "w" * 5000]) and all(r["doc_id"] == 7 and r["gone"] == "gone" for r in rows)
    assert jaccard_join.first_of_groups(df.limit(0)).columns == df.columns
    assert jaccard_join.component_report(df).filter("component_id <> 7").count() == 0


def test_common_grams_are_dealt_to_several_buckets(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BUCKET_ROWS", 5)
    monkeypatch.setattr(jaccard_join, "COMMON_SHARE", 1 / 50)
    rows = near_copies(21)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert {r[0]: (r[1], r[2]) for r in jaccard_join.component_report(df, 2, 70).collect()} == brute_components(rows, 2, 70)


def test_signature_trees_never_lose_a_pair():
    rng = np.random.RandomState(7)
    sets = []
    for _ in range(20):
        base = np.unique(rng.randint(0, 2**60, rng.randint(20, 200), np.int64)).astype(np.uint64)
        for _ in range(6):
            keep = rng.uniform(size=len(base)) > rng.uniform(0, 0.2)
            sets.append(np.unique(base[keep]) if keep.any() else base[:1])
    size = np.array([len(s) for s in sets])
    left = {tuple(sorted(p)) for p in jaccard_join.group_pairs(size, [jaccard_join.signature(s) for s in sets], 85).tolist()}
    for i, j in combinations(range(len(sets)), 2):
        if jaccard_join.enough(len(np.intersect1d(sets[i], sets[j])), size[i] + size[j], 85):
            assert (i, j) in left
    assert len(left) < 0.2 * len(sets) ** 2


@pytest.mark.parametrize("alone", [1 << 20, 0])
def test_components_of_chains_and_stars(spark, monkeypatch, alone):
    monkeypatch.setattr(component_steps, "ONE_TASK", alone)
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(200, 200), (7, 3)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect())
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}}


def brute_top(rows, k, scale=64):
    import math

    held = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            held.setdefault(i, [math.floor(scale * np.float64(np.float32(x))) for x in v])
    out = {}
    for q in held:
        if q % 20 == 0:
            dots = [(-sum(a * b for a, b in zip(held[q], held[c], strict=False)), c) for c in held if c != q]
            out[q] = [(r + 1, c, -s) for r, (s, c) in enumerate(sorted(dots)[:k])]
    return out


@pytest.mark.parametrize("spread", [0.0, 2.0])
def test_top_k_matches_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(top_k, "BLOCK_BYTES", 16 * 64)
    monkeypatch.setattr(top_k, "LEAST_ROWS", 8)
    monkeypatch.setattr(top_k, "BUCKET", 16)
    rng = np.random.RandomState(5)
    rows = [(i, (v / np.linalg.norm(v) * np.exp(spread * rng.normal())).tolist()) for i, v in enumerate(rng.normal(size=(500, 8)))]
    rows += [(600 + i, rows[20][1]) for i in range(30)] + [(1000, None), (1020, [1.0, None] + [0.0] * 6), (1040, [float("nan")] * 8), (1060, [0.0] * 8), (1080, [1.0, 2.0]), (1100, []), (None, rows[0][1]), (1120, [3e4] * 8)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, id int")
    got = {}
    for r in top_k.top_k(df, F.col("vec_id") % 20 == 0, 20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert {q: sorted(v) for q, v in got.items()} == brute_top(rows, 20)


def test_top_k_of_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in top_k.top_k(df, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, 8192)]
    assert top_k.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def water(children, budget):
    """Plain water filling of (weight, holds), whole numbers."""
    order = sorted(range(len(children)), key=lambda i: (children[i][1] / children[i][0], i))
    left, weight, out = budget, sum(w for w, _ in children), [0] * len(children)
    for n, i in enumerate(order):
        w, c = children[i]
        if c * weight <= w * left:
            out[i] = c
            left -= c
            weight -= w
        else:
            for j in order[n:]:
                out[j] = children[j][0] * left // weight
            break
    return out


def mix_rows(spark, n=600):
    rng = random.Random(9)
    rows = [(i, rng.choice("xyz"), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3"]) if rng.random() > 0.4 else "hot", "w" * rng.randint(0, 90)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, dom string, lang string, source string, text string").repartition(3)


@pytest.mark.parametrize("fraction,epochs", [((1, 2), 2), ((9, 10), 1), ((3, 1), 2)])
def test_mix_meets_hierarchical_budgets(spark, fraction, epochs):
    rows, df = mix_rows(spark)
    weights = ({"x": 5, "y": 1, "z": 3}, {"en": 6, "de": 2}, {"hot": 1, "s1": 4, "s3": 0})
    m = mixing.mix(df, F.col("dom"), F.col("lang"), F.col("source"), weights, fraction, epochs)
    got = m.collect()
    tokens = lambda t: -(-len(t) // 4)
    leaves = {}
    for _, d, g, s, t in rows:
        leaves.setdefault((d, g, s), []).append(tokens(t))
    w = lambda level, v: weights[level].get(v, 1)
    supply = {k: sum(v) * epochs for k, v in leaves.items() if sum(v) and w(2, k[2])}
    budget = sum(map(sum, leaves.values())) * fraction[0] // fraction[1]
    alloc = {}
    doms = sorted({k[0] for k in supply})
    for d, db in zip(doms, water([(w(0, d), sum(v for k, v in supply.items() if k[0] == d)) for d in doms], budget), strict=True):
        langs = sorted({k[1] for k in supply if k[0] == d}, key=str)
        for g, gb in zip(langs, water([(w(1, g), sum(v for k, v in supply.items() if k[:2] == (d, g))) for g in langs], db), strict=True):
            keys = sorted(k for k in supply if k[:2] == (d, g))
            alloc.update(zip(keys, water([(w(2, k[2]), supply[k]) for k in keys], gb), strict=True))
    taken = {}
    for r in got:
        k = (r["dom"], r["lang"], r["source"])
        taken.setdefault(k, []).append((r["doc_id"], r["_mix_copies"], r["_mix_tokens"]))
    for k, v in leaves.items():
        total, most = sum(c * t for _, c, t in taken.get(k, [])), alloc.get(k, 0)
        assert total <= most and most - total < max(v) + 1, (k, total, most)
        if k in alloc and sum(v):
            whole, part = divmod(most, sum(v))
            key = lambda i: hashlib.md5(f"17:{whole}:{i}".encode()).hexdigest()  # noqa: B023, E731
            run, want = 0, {}
            for i, t in sorted(((i, tokens(t)) for i, d, g, s, t in rows if (d, g, s) == k), key=lambda x: key(x[0])):
                run += t
                want[i] = whole + (run <= part)
            assert {i: c for i, c, _ in taken.get(k, [])} == {i: c for i, c in want.items() if c}


def test_mix_keeps_clashing_columns(spark):
    names = ["_whole", "_to", "_key", "_part", "_mix_tokens", "_cut", "id", "doc", "_pmix"]
    _, df = mix_rows(spark, 60)
    df = df.select("*", *[F.lit(k).alias(k) for k in names])
    args = (F.col("dom"), F.col("lang"), F.col("source"), ({}, {}, {}))
    kept = mixing.taken_once(df, *args, fraction=(1, 1), epochs=1)
    assert kept.columns == df.columns and kept.filter("_mix_tokens <> '_mix_tokens' OR doc <> 'doc'").count() == 0 < kept.count()
    long = spark.createDataFrame([(1, "a", None, "s", "w" * 3_000_000), (2, "a", None, "s", "w" * 400)], df.schema.simpleString()[7:-1].split(",_whole")[0].replace(":", " "))
    got = {r["doc_id"]: r["_mix_copies"] for r in mixing.mix(long, *args, (1, 2), 2).collect()}
    assert sum(c * (750_000 if d == 1 else 100) for d, c in got.items()) <= 375_050 and got.get(2, 0) <= 1


def test_mix_of_nothing_and_joined_leaves(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_LEAVES", 0)
    rows, df = mix_rows(spark, 60)
    args = (F.col("dom"), F.col("lang"), F.col("source"), ({}, {}, {}))
    assert mixing.mix(df, *args, (1, 1), 1).count() >= 50
    assert mixing.mix(df.limit(0), *args).count() == 0


def test_pipeline_stages_keep_columns(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        docs = docs.cache()
        assert docs.count() <= n and docs.columns[: len(columns)] == columns, name
        n = docs.count()
    assert docs.columns == [*columns, "n_tokens", "ids"] and n > 0
    assert docs.filter("size(array()) <> 0 OR length(ids) <> 4 * n_tokens").count() == 0


@pytest.mark.parametrize("percent", [10, 20, 34, 50, 85])
def test_pairs_of_sets_of_unlike_sizes(percent):
    """A small set within larger ones: signatures of all widths that the similarity allows meet."""
    rng = np.random.RandomState(percent)
    pool = rng.randint(1, 2**63 - 1, 400, np.int64).astype(np.uint64)
    sets = [pool[:n] for n in (4, 8, 9, 16, 32, 33, 64, 100, 200, 400)] + [rng.choice(pool, n, replace=False) for n in (8, 30, 120)]
    size = np.array([len(s) for s in sets])
    got = {tuple(sorted(p)) for p in jaccard_join.group_pairs(size, [jaccard_join.signature(s) for s in sets], percent).tolist()}
    held = [set(s.tolist()) for s in sets]
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 100 * len(held[i] & held[j]) >= percent * len(held[i] | held[j])}
    assert want and want <= got


def test_components_of_low_similarity(spark):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(words[:n])) for k, n in enumerate((8, 32, 100, 350))] + [(10 + k, " ".join(rng.sample(words, 30))) for k in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.component_report(df, words=2, percent=20).collect()}
    assert got == brute_components(rows, 2, 20) and {got[k][1] for k in range(4)} == {0}
