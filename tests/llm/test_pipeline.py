"""Each stage of the pipeline on a small corpus, against plain versions of what it does."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F
from test_pairs import brute_components, water

from lattica.llm import quality
from lattica.llm.queries import MIX_WEIGHTS, vocabulary
from lattica.llm.util import slice_hashes

corpus_pipeline = pytest.importorskip("corpus_pipeline")
NAMES = ["_text", "_score", "_h", "_th", "d", "t", "doc", "spans", "score", "_mix_tokens", "id", "ids_", "_key", "a.b", "e"]


def corpus():
    rng = random.Random(31)
    words = "the of and to in that was his for with as had you not be her on at by which have or from this".split()
    sentence = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(6, 14))).capitalize() + "."
    good = [" ".join(sentence() for _ in range(rng.randint(3, 12))) for _ in range(90)]
    junk = ["".join(rng.choice("|#$%&@!01 X") for _ in range(rng.randint(60, 300))) for _ in range(50)]
    passage = " ".join(sentence() for _ in range(6))
    texts = good + junk
    for k in range(12):  # near copies: a word or two replaced
        w = good[k].split()
        w[rng.randrange(len(w))] = "else"
        texts.append(" ".join(w))
    texts += [good[3], good[4].upper(), good[5].replace(" ", "  \n")]
    texts += [f"{good[20 + k]} {passage} {good[40 + k]}" for k in range(4)]
    texts += [" ".join(sentence() for _ in range(6000)), "é" * 150 + " fin. " + good[60], "é" * 150 + "ß", "漢字 " * 80, "z" * 99, "z" * 250]
    rows = [(i, x) for i, x in enumerate(texts)]
    rng.shuffle(rows)
    rows = [(i * 2, x) for i, (_, x) in enumerate(rows)]
    rows += [(1001, None), (1003, ""), (1005, " \n"), (1007, "Only four words here."), (rows[0][0], rows[0][1]), (1009, good[70]), (1009, good[71])]
    out = []
    for k, (i, x) in enumerate(rows):
        source, lang = (None if k % 11 == 0 else f"s{k % 3}"), (None if k % 13 == 0 else ("en", "de", "fr")[k % 3])
        if k and (i, x) == rows[0]:
            source, lang = out[0][2:4]  # a whole row repeated
        out.append((i, x, source, lang, None if x is None else len(x)))
    labels = [(i, 1 if any(x == g for g in good) else 0) for i, x in rows if x and (x in good or x in junk)]
    return out, sorted(set(labels))


@pytest.fixture(scope="module")
def held(spark, tmp_path_factory):
    rows, labels = corpus()
    path = tmp_path_factory.mktemp("corpus")
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    for k in NAMES:
        docs = docs.withColumn(k, F.lit(f"own {k}"))
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars", *[f"`{k}`" for k in NAMES])
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    stages, docs = [], spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(path))
        out.write.parquet(f"{path}/{name}.parquet")
        after = spark.read.parquet(f"{path}/{name}.parquet")
        stages.append((name, docs, after))
        docs = after
    return str(path), {name: (before, after) for name, before, after in stages}


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def plain_features(text):
    """The features of one text, by loops."""
    raw = (text or "").encode()
    kinds = [int(quality._CLASS[c]) for c in raw]
    of_kind = Counter(kinds)
    n = lambda *k: sum(of_kind[x] for x in k)
    words = regex.findall(rb"[^ \t\r\x0b\x0c\n]+", raw)
    lines = [x for x in raw.split(b"\n") if len(x) > 1]
    # a line counts by its text; the newline itself isn't part of it
    held = Counter(words)
    per = lambda a, b: a / max(b, 1)
    Q = quality
    size, letters = len(raw), n(Q.LOWER, Q.UPPER)
    by = max(size, 1)
    return [
        np.log1p(size), per(n(Q.UPPER), letters), n(Q.DIGIT) / by, n(Q.MARK) / by, n(Q.EXCLAIM) / by, n(Q.SYMBOL) / by, n(Q.PIPE) / by, n(Q.QUOTE) / by, n(Q.WIDE) / by, n(Q.NEWLINE) / by, n(Q.CONTROL) / by,
        per(size - n(Q.SPACE) - n(Q.NEWLINE), len(words)), per(sum(len(w) <= 3 for w in words), len(words)), per(sum(len(w) >= 14 for w in words), len(words)), per(len(words), len(lines)), per(len(held), len(words)),
        per(max(held.values(), default=0), len(words)), per(len(lines) - len(set(lines)), len(lines)), per(sum(quality._CLASS[w[-1]] >= Q.EXCLAIM for w in words), len(words)),
    ]


def plain_score(model, x):
    at = [sum(b <= v for b in edges) for edges, v in zip(model.edges, x, strict=True)]
    total = model.intercept + sum(float(t[k]) for t, k in zip(model.tables, at, strict=True)) + sum(float(t[at[i], at[j]]) for i, j, t in model.pairs)
    return 1 / (1 + np.exp(-max(-40.0, min(40.0, total))))


def test_features_by_loops():
    rng = random.Random(2)
    texts = ["", None, "\n", "a\n\nb\na\na", " x", "Ab! 12 #|\"(é\x00 longlonglongword\r\n\x0bz", "line\nline\nline", "\n\nab\nab"] + ["".join(rng.choice("ab A1!|\n é\t") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    raws = [(t or "").encode() for t in texts]
    got = quality.features(np.frombuffer(b"".join(raws), np.uint8), np.r_[0, np.cumsum([len(r) for r in raws])])
    assert np.allclose(got, [plain_features(t) for t in texts])


def test_quality_classifier(spark, held):
    path, stages = held
    before, after = stages["quality_classifier"]
    labels = spark.read.parquet(f"{path}/labels.parquet")
    model = quality.train(before, labels)
    taught = {r["doc_id"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1}
    assert taught and quality.train(before.filter(F.col("doc_id").isin(list(taught))), labels).score(np.zeros((1, len(quality.FEATURES)))) == model.score(np.zeros((1, len(quality.FEATURES))))
    want = [r for r in rows_of(before) if plain_score(model, plain_features(r[1])) >= 0.5]
    assert rows_of(after) == want and 60 < len(want) < before.count() - 30 and after.columns == before.columns


def test_near_duplicates(held):
    before, after = held[1]["near_duplicates"]
    rows = rows_of(before)
    texts = {}
    for r in rows:
        texts.setdefault((r[0], hashlib.md5((r[1] or "").encode()).hexdigest()), r[1])
    names = {k: i for i, k in enumerate(sorted(texts))}  # rows of one id are told apart by their texts
    first = brute_components([(names[k], t) for k, t in texts.items()], 5, 80)
    want = [r for r in rows if (lambda i: first[i][1] == i)(names[r[0], hashlib.md5((r[1] or "").encode()).hexdigest()])]
    assert rows_of(after) == want and len(want) <= len(rows) - 12 and after.columns == before.columns


def test_repeated_passages(held):
    before, after = held[1]["repeated_passages"]
    rows, seen, cut = rows_of(before), set(), {}
    order = sorted({(r[0], int(hashlib.md5((r[1] or "").encode()).hexdigest()[:15], 16), r[1]) for r in rows if r[1] is not None})
    for i, _, text in order:
        raw = text.encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - 99):
            w = raw[k : k + 100]
            if w in seen:
                gone[k : k + 100] = True
            seen.add(w)
        runs = np.flatnonzero(np.diff(np.r_[True, gone, True].astype(int)))
        cut[i, text] = "".join(raw[a:b].decode("utf-8", "ignore") for a, b in zip(runs[::2], runs[1::2], strict=True))
    want = sorted(((r[0], t := r[1] and cut[r[0], r[1]], *r[2:4], None if t is None else len(t), *r[5:]) for r in rows), key=repr)
    assert rows_of(after) == want and sum(len(v) < len(k[1]) for k, v in cut.items()) > 5 and after.dtypes == before.dtypes


def test_source_mix(held):
    before, after = held[1]["source_mix"]
    rows = rows_of(before)
    tokens = lambda r: -(-len((r[1] or "").encode()) // 4)
    leaf = lambda r: ("d%d" % (int(hashlib.md5(r[3].encode()).hexdigest()[:4], 16) % 4 if r[3] is not None else 0), r[2], r[3])
    leaves = {}
    for r in rows:
        leaves.setdefault(leaf(r), []).append(r)
    supply = {k: sum(map(tokens, v)) for k, v in leaves.items() if sum(map(tokens, v))}
    weight = lambda level, v: MIX_WEIGHTS[level].get(v, 1)
    nulls_first = lambda v: (v is not None, v)
    alloc = {}
    domains = sorted({k[0] for k in supply})
    for d, db in zip(domains, water([(weight(0, d), sum(v for k, v in supply.items() if k[0] == d)) for d in domains], sum(supply.values()) * 9 // 10), strict=True):
        langs = sorted({k[1] for k in supply if k[0] == d}, key=nulls_first)
        for g, gb in zip(langs, water([(weight(1, g), sum(v for k, v in supply.items() if k[:2] == (d, g))) for g in langs], db), strict=True):
            keys = sorted((k for k in supply if k[:2] == (d, g)), key=lambda k: nulls_first(k[2]))
            alloc.update(zip(keys, water([(1, supply[k]) for k in keys], gb), strict=True))
    want = []
    for k, members in leaves.items():
        if k not in alloc:
            continue
        whole, part = divmod(alloc[k], supply[k])
        key = lambda r: hashlib.md5(f"17:{whole}:{r[0]}".encode()).hexdigest()  # noqa: B023, E731
        sums = {}
        for r in members:
            sums[key(r)] = sums.get(key(r), 0) + tokens(r)
        run, last = 0, ""
        for x in sorted(sums):
            run += sums[x]
            if run <= part:
                last = x
        want += [r for r in members if whole or key(r) <= last]
    assert rows_of(after) == sorted(want, key=repr) and 0 < len(want) < len(rows) and after.columns == before.columns


def test_token_ids(held):
    tiktoken = pytest.importorskip("tiktoken")
    from lattica.llm import bpe

    before, after = held[1]["token_ids"]
    library = tiktoken.Encoding("own", pat_str=vocabulary()[1], mergeable_ranks=bpe.read_ranks(vocabulary()[0]), special_tokens={})
    want = [(*r, len(ids := library.encode_ordinary(r[1] or "")), bytearray(np.array(ids, "<u4").tobytes())) for r in rows_of(before)]
    assert rows_of(after) == sorted(want, key=repr) and after.columns == [*before.columns, "n_tokens", "ids"]


def test_stages_of_an_empty_table(spark, held):
    path, stages = held
    docs = stages["quality_classifier"][0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        assert docs.count() == 0


def test_run_equals_its_stages(spark, held):
    path, stages = held
    assert rows_of(corpus_pipeline.run(spark, path)) == rows_of(stages["token_ids"][1])


def test_slices_of_any_length_hash_by_their_bytes():
    rng = np.random.RandomState(1)
    data = rng.randint(0, 2, 5000).astype(np.uint8)
    start = rng.randint(0, 4000, 4000)
    end = start + np.minimum(rng.choice([0, 1, 7, 8, 9, 63, 512, 513, 900], 4000), 5000 - start)
    held = {}
    for k, (a, b) in enumerate(zip(*slice_hashes(data, start, end, wide=True), strict=True)):
        held.setdefault(data[start[k] : end[k]].tobytes(), set()).add((int(a), int(b)))
    assert all(len(v) == 1 for v in held.values()) and len({x for v in held.values() for x, _ in v}) == len({x for v in held.values() for _, x in v}) == len(held)
