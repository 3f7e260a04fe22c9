import hashlib
import pickle
import random

import numpy as np
import pytest
import regex

from lattica.llm import bpe, fingerprint, piece_count, quality
from lattica.llm.queries import vocabulary
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(vocabulary()[0])


@pytest.fixture(scope="module")
def tables(ranks):
    return bpe.PrefixBPE(ranks)


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=vocabulary()[1], mergeable_ranks=ranks, special_tokens={})


PARTS = ["a", "b", "the", "ing", " ", "é", "ß", "漢", "1", "!!", "\n", "\t", "😀", "er", "on", "aaaa", "\x00", "<|endoftext|>", "’s", "  "]


def test_new_pieces_continue_each_other(ranks, reference, monkeypatch):
    """Each new piece had a table of its own, all its substrings looked up at every byte: over the CPU limit. Pieces that begin alike share their tables' beginnings."""
    fresh, done, extend = bpe.PrefixBPE(ranks), [], bpe.PrefixBPE.extend
    monkeypatch.setattr(bpe.PrefixBPE, "extend", lambda self, data, last, *more: (done.append(len(data) + 1 - len(last)), extend(self, data, last, *more))[1])
    words = [" quimber" + a + b for a in "aeiouxyzqw" for b in "bcdfghjklmnp"]
    encode = bpe.TextEncoder(fresh, vocabulary()[1])
    assert [list(memoryview(x).cast("I")) for x in encode.many(["".join(words), "".join(words[::-1])])] == [reference.encode_ordinary("".join(w)) for w in (words, words[::-1])]
    assert sum(done) < 300 < sum(map(len, words))


def test_small_stores_and_cut_texts(ranks, reference, monkeypatch):
    """Stores that are emptied amid a piece, texts beyond a group's characters, pieces too long to keep; tables pickled after use."""
    for name, most in (("KEPT_PIECES", 7), ("KEPT_PAIRS", 5), ("LONG_TEXT", 60)):
        monkeypatch.setattr(bpe, name, most)
    rng = random.Random(3)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60))) for _ in range(120)] + ["", "x" * 200, "ab" * 25, "é" * 70]
    tables = bpe.PrefixBPE(ranks)
    for _ in range(2):
        encode = bpe.TextEncoder(tables, vocabulary()[1])
        assert [list(memoryview(x).cast("I")) for x in encode.many(texts)] == [reference.encode_ordinary(t) for t in texts]
        assert [encode(t) for t in texts] == encode.many(texts)
        tables = pickle.loads(pickle.dumps(tables))
    data, last = tables.append(b"", [-1], b"the fin")
    data, last = tables.append(data, last, "ished ßtring".encode())
    assert last == tables.table("the finished ßtring".encode())


def test_ids_equal_the_library(spark, reference):
    rng = random.Random(1)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 80))) for _ in range(500)] + ["", None, "x" * 20_000, "ab " * 30_000, " " * 5000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    for r in bpe.digest_documents(df, *vocabulary()).collect():
        t = texts[r["doc_id"]] or ""
        ids = reference.encode_ordinary(t)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    kept = bpe.with_ids(df, *vocabulary())
    assert kept.columns == ["doc_id", "text", "n_tokens", "ids"] and kept.count() == len(texts)


def test_long_texts_take_the_same_pieces(tables, reference, monkeypatch):
    text = "Thntblere of then, edtioner " * 50
    monkeypatch.setattr(bpe, "LONG_TEXT", 10)
    packed = bpe.TextEncoder(tables, vocabulary()[1])(text)
    assert list(memoryview(packed).cast("I")) == reference.encode_ordinary(text)


def test_appends_and_edits_are_exact(tables):
    rng = random.Random(2)
    for _ in range(200):
        word = "".join(rng.choice(["a", "b", "the", "ing", "er", "on"]) for _ in range(50)).encode()
        table = tables.table(word)
        longer, grown = tables.append(word, list(table), b"ation")
        assert grown == tables.table(longer)
        a = rng.randrange(len(word))
        b = rng.randrange(a, len(word))
        out, edited, computed = tables.replace(word, table, a, b, b"there")
        assert edited == tables.table(out) and tables.decode(tables.ids(out, edited)) == out
        assert computed <= len(out) - a


def test_random_bytes(tables, reference):
    rng = random.Random(3)
    for _ in range(200):
        word = bytes(rng.randrange(256) for _ in range(30))
        assert tables.ids(word) == reference._encode_single_piece(word)


def greedy(word, pieces):
    n = i = 0
    while i < len(word):
        j = next((j for j in range(len(word), i, -1) if word[i:j] in pieces), None)
        if j is None:
            return -1
        n, i = n + 1, j
    return n


def test_automaton_counts_greedy_pieces():
    rng = random.Random(4)
    for _ in range(60):
        pieces = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 15))}
        a = piece_count.PieceAutomaton(pieces)
        for _ in range(60):
            w = bytes(rng.choice(b"abcd") for _ in range(rng.randint(0, 14)))
            assert a.count(w) == greedy(w, pieces), (pieces, w)


def test_piece_counts_of_documents(spark, ranks):
    import regex

    texts = ["Thntblere of, then!!  x", "", None, "é" * 3000, "word " * 2000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in piece_count.count_pieces(df, *vocabulary()).collect():
        words = regex.findall(vocabulary()[1], texts[r["doc_id"]] or "")
        assert (r["n_words"], r["n_pieces"], r["n_unknown"]) == (len(words), sum(greedy(w.encode(), ranks) for w in words), 0)


def test_marked_pieces_by_brute_force():
    rng = random.Random(14)
    for _ in range(60):
        first = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 4))) for _ in range(8)}
        rest = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 4))) for _ in range(8)}
        own = piece_count.PieceAutomaton([*(x.encode() for x in first), *(b"##" + x.encode() for x in rest)], b"##")
        for _ in range(60):
            word, at, n = "".join(rng.choice("ab") for _ in range(rng.randint(1, 12))), 0, 0
            while at < len(word):
                fit = [x for x in (rest if at else first) if word.startswith(x, at)]
                if not fit:
                    n = -1
                    break
                at, n = at + len(max(fit, key=len)), n + 1
            assert own.count(word.encode()) == n


def test_encoding_and_counting_odd_tables(spark):
    df = spark.createDataFrame([(1, "a b", 1, 2, 3, 4), (1, "a b", 1, 2, 3, 4), (None, None, 1, 2, 3, 4), (2, "ab " * 200_000, 1, 2, 3, 4)], "doc_id long, text string, _text int, n_words int, n_tokens int, ids int")
    for f in (bpe.digest_documents, piece_count.count_pieces):
        rows = f(df, *vocabulary()).collect()
        assert len(rows) == 4 and rows[0] == rows[1] and f(df.limit(0), *vocabulary()).count() == 0
    assert bpe.with_ids(df.limit(0), *vocabulary()).columns == ["doc_id", "text", "_text", "n_words", "n_tokens", "ids"]
    marked = piece_count.count_pieces(spark.createDataFrame([(1, "aab ba x")], "doc_id long, text string"), "own", r"[^ ]+", pieces=[b"a", b"##ab", b"b", b"##a"], mark=b"##").first()
    assert tuple(marked)[1:] == (3, 5, 1)


def test_fingerprints(spark):
    texts = ["Caf\u00e9  x", "cafe\u0301 X\n", "other", None, "", "  ", "abcdefgh", "\u6f22\u5b57\u6f22\u5b57", "abcdefgh"]
    ids = [5, 3, 9, 1, 2, 4, 20, 11, 30]
    df = spark.createDataFrame([(i, t, "clash") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, next string")
    rows = {r["doc_id"]: r for r in fingerprint.edit_report(df).collect()}
    order = sorted(ids)
    held = {i: (t or "") for i, t in zip(ids, texts, strict=True)}
    for i in ids:
        t, nxt = held[i], held[order[(order.index(i) + 1) % len(order)]]
        k = len(t) // 4
        edited = t[: len(t) - k] + nxt[:k]
        assert rows[i]["n_chars"] == len(t) and rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (rows[i]["near_next"] == 1.0) == (rows[i]["fingerprint"] == rows[order[(order.index(i) + 1) % len(order)]]["fingerprint"])
    assert rows[5]["fingerprint"] == rows[3]["fingerprint"] != rows[9]["fingerprint"]
    assert rows[1]["fingerprint"] == rows[2]["fingerprint"] == rows[4]["fingerprint"] and rows[20]["fingerprint"] == rows[30]["fingerprint"]


def plain_canonical(t):
    import unicodedata

    t = unicodedata.normalize("NFC", unicodedata.normalize("NFC", t or "").casefold())
    return regex.sub(r"[ \t\n\x0b\f\r\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", " ", t).strip(" ")


def test_canonical_form_of_random_texts(spark):
    rng = random.Random(12)
    pool = [*"aBcZ  \t\n\x0b\x1c", "ß", "ẞ", "Σ", "ς", "İ", "ı", "ﬁ", "e\u0301", "A\u030a", "\u0344", "\u1fb3", "\u1f80", "Ω", "Å", "\u0130", "\u0085", "\u00a0", "\u3000", "\u2028", "漢", "😀", "ǰ", "\u1e9b\u0323", "\u0345", "ͅΑ", "\u1100\u1161\u11a8", "가"]
    pool += [chr(c) for c in rng.sample([*range(0xA1, 0x250), *range(0x370, 0x378), *range(0x388, 0x52F), *range(0x1E00, 0x1F00)], 300)]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("i", fingerprint.canonical(F.col("t")).alias("c")).collect():
        assert r["c"] == plain_canonical(texts[r["i"]]), ascii(texts[r["i"]])


def check_edits(got, rows):
    """rows: (id, text); ids may repeat."""
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0], r[1].encode()))
    want, prints = [], {}
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        c = plain_canonical(t)
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), float(c == plain_canonical(edited)), float(c == plain_canonical(after))))
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in got) == sorted(want)
    held = dict(rows)
    for r in got:
        prints.setdefault(r["fingerprint"], set()).add(plain_canonical(held[r["doc_id"]]))
    if len(held) == len(rows):
        assert all(len(c) == 1 for c in prints.values()) and len(prints) == len({plain_canonical(t) for t in held.values()})


@pytest.mark.parametrize("cells", [4096, 3])
def test_many_ranges_and_ties(spark, monkeypatch, cells):
    monkeypatch.setattr(fingerprint, "ROWS_PER_RANGE", 5)
    monkeypatch.setattr(fingerprint, "MOST_CELLS", cells)
    monkeypatch.setattr(fingerprint, "BROADCAST_RANGES", cells)
    rng = random.Random(3)
    rows = [(i // 2, f"text {i} " * 3) for i in range(200)] + [(int(10 ** rng.uniform(3, 17)), "x" * rng.randint(0, 9)) for _ in range(100)]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "doc_id long, text string, id int, t int, h int, next int").repartition(4)
    check_edits(fingerprint.edit_report(df).collect(), rows)


@pytest.mark.parametrize("weak", [False, True])
def test_collisions_are_settled(spark, monkeypatch, weak):
    if weak:  # hashes that say nothing but the length
        monkeypatch.setattr(fingerprint, "wide_hash", lambda c: F.lpad(F.hex(F.char_length(c).cast("long") % 4), 32, "0"))
    texts = ["abcdefgh", "ABCDEFGH", "abcdefgx", "abcd", "x", "", None, "aaaaaaaa", "aaaa aaaa", "abcdabcd", "b" * 300_000]
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check_edits(fingerprint.edit_report(df).collect(), rows)
    prints = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprints(df).collect()}
    assert len(set(prints.values())) == 9 and prints[0] == prints[1] and prints[5] == prints[6]
    assert fingerprint.edit_report(df.limit(0)).count() == 0 == fingerprint.fingerprints(df.limit(0)).count()


def test_quality_of_odd_tables(spark):
    names = ["_text", "_score", "doc", "score", "id", "y"]
    docs = spark.createDataFrame([(k % 40, f"text {k} of words " * (1 + k % 5)) for k in range(80)] + [(100, None), (101, ""), (102, "long text. " * 200_000)], "doc_id long, text string").select("*", *[F.lit(k).alias(k) for k in names])
    labels = spark.createDataFrame([(k, k % 2) for k in range(30)] + [(1, 0), (5, None), (None, 1), (7, 3)], "doc_id long, quality int")
    kept = quality.accepted(docs, labels, 0.0)
    assert kept.columns == docs.columns and kept.count() == 83 and kept.filter("_score <> '_score' OR score <> 'score'").count() == 0
    assert quality.quality_report(docs.limit(0), labels).count() == 0 and quality.quality_report(docs, labels.limit(0)).filter("score <> 0.5").count() == 0


def test_quality_model_learns_and_scores(spark):
    rng = random.Random(6)
    good = ["The words of this text are plain. And so on, with " + " ".join(rng.choice(["some", "more", "few", "other", "words"]) for _ in range(rng.randint(5, 60))) for _ in range(300)]
    bad = [" ".join(rng.choice(["BUY!!", "NOW!!", "a***", "x | y", "$$$"]) for _ in range(rng.randint(5, 60))) for _ in range(200)]
    rows = [(i, t, "en") for i, t in enumerate(good + bad)] + [(1000, "", "en"), (1001, None, "en"), (None, "x", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _y string")
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in range(500)] + [(None, 1, 0), (3, None, 0), (4, 7, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.quality_report(docs, labels).collect()}
    assert len(got) == 503 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    held = [i for i in range(500) if got[i]["held_out"]]
    assert 100 < len(held) < 250 and np.mean([got[i]["predicted"] == int(i < 300) for i in held]) > 0.95
    import zlib

    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(500))
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and kept.count() < 503


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["score"] for r in quality.quality_report(docs, labels).collect()] == [0.5]


def test_pairs_explain_what_single_features_cannot():
    rng = np.random.RandomState(1)
    x = rng.uniform(-1, 1, (3000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    m = quality.fit(x, y)
    assert ((m.score(x) >= 0.5) == y).mean() > 0.9 and any({i, j} == {0, 1} for i, j, _ in m.pairs)


def test_ranges_of_ids_with_gaps_are_alike_in_size(spark, monkeypatch):
    """Four cells; the ids of a cell lie at both ends of a gap of 1e12, and most of them at one."""
    from lattica.llm.util import Tables

    monkeypatch.setattr(fingerprint, "ROWS_PER_RANGE", 50)
    monkeypatch.setattr(fingerprint, "MOST_CELLS", 4)
    rng = random.Random(4)
    ids = [k if k % 50 else k + 10**12 for k in range(2000)] + [10**15 + k for k in range(400)]
    rng.shuffle(ids)
    df = spark.createDataFrame([(i, str(i)) for i in ids] + [(None, "x")], "id long, t string")
    tables = Tables(spark)
    rows, cuts = fingerprint.ranged(df, "id", tables)
    held = {}
    for r in rows.collect():
        held.setdefault(r["r"], []).append(r["id"] if r["id"] is not None else -1)
    assert cuts == 13 and sum(map(len, held.values())) == 2401 and max(map(len, held.values())) <= 120
    order = [x for k in sorted(held) for x in sorted(held[k])]
    assert order == sorted(order)
    report = fingerprint.edit_report(df.filter("id IS NOT NULL"), "id", "t").withColumnRenamed("id", "doc_id")
    check_edits(report.collect(), [(i, str(i)) for i in ids])


def test_a_text_is_made_canonical_once_for_its_hash(spark):
    df = spark.createDataFrame([(1, "é")], "id long, t string")
    hashed = df.select("id", fingerprint.canonical(F.col("t")).alias("c")).select("id", fingerprint.wide_hash(F.col("c")))
    assert hashed._jdf.queryExecution().optimizedPlan().toString().count("reflect(") == 3
