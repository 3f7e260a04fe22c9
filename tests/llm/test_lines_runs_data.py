import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from lattica.llm import fill_middle, personal_data, tandem_runs
from lattica.llm.queries import repeated_tail
from pyspark.sql import functions as F

sha = lambda s: hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()

LINES = ["", None, "\n", "\n\n\n", "one line", "one\ntwo\nthree", "a\r\nb c\x85d\n", "é漢😀\n" * 40, "x" * 70_000, "ab\n" * 30_000, "has <P> inside\n", "<S", "<M>", "end<\n<", " \n\t\n"]


def split_lines(t):
    out, at = [], 0
    while at < len(t):
        to = t.find("\n", at)
        to = len(t) if to < 0 else to + 1
        out.append(t[at:to])
        at = to
    return out


def plain_transform(i, t, rate=100, spm=50):
    lines = split_lines(t)
    n = len(lines)
    h = [int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not t or "<P>" in t or "<S>" in t or "<M>" in t or h[2] % 100 >= rate:
        return n, "plain", None, None, t
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_middle_equals_a_plain_version(spark):
    rng = random.Random(3)
    texts = LINES + ["".join(rng.choice(["a", "bc ", "\n", "é", "<", "P>", "<P"]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(2, texts[5], 1)], "doc_id long, text string, form int")
    got = fill_middle.report(df).collect()
    assert len(got) == len(texts) + 1
    forms = set()
    for r in got:
        i = r["doc_id"]
        held = [texts[i] or ""] + ([texts[5]] if i == 2 else [])
        wants = [(*plain_transform(i, t)[:4], sha(plain_transform(i, t)[4]), sha(t)) for t in held]
        assert tuple(r)[1:] in wants
        forms.add(r["form"])
    assert forms == {"plain", "psm", "spm"}


def test_fill_middle_keeps_columns_and_rates(spark):
    df = spark.createDataFrame([(i, f"a{i}\nb\nc" if i % 9 else None, "x", i) for i in range(2000)], "`the id` long, `the.text` string, form string, row long")
    out = fill_middle.fill_middle(df, fill_middle.Transform(rate=30, spm=10), "the id", "the.text")
    assert out.columns == ["the id", "the.text", "row", "form", "n_units", "prefix_chars", "middle_chars"]
    counts = {f: 0 for f in ("plain", "psm", "spm")}
    for r in out.collect():
        n, form, p, m, text = plain_transform(r["row"], f"a{r['row']}\nb\nc" if r["row"] % 9 else "", 30, 10)
        assert tuple(r)[1:] == (text if r["row"] % 9 else None, r["row"], form, n, p, m)
        counts[form] += 1
    assert counts["psm"] > 4 * counts["spm"] > 0 and counts["plain"] > counts["psm"]
    assert fill_middle.fill_middle(df.limit(0), id_col="the id", text_col="the.text").count() == 0
    assert fill_middle.report(spark.createDataFrame([(None, "a\nb")], "doc_id long, text string")).first()["n"] == 2


@pytest.mark.parametrize("marks", [("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("aba", "<S>", "<M>"), ("<P", "<P>", "<M>"), ("<P>", "x<", "<M>")])
def test_sentinels_that_could_be_mistaken_are_refused(marks):
    with pytest.raises(ValueError):
        fill_middle.Transform(prefix=marks[0], suffix=marks[1], middle=marks[2])


def plain_runs(w, least, exponent):
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, exponent * q) and not any(all(w[x] == w[x + p] for x in range(i, i + size - p)) for p in range(1, q)):
                out.append((i, size, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force_over_batches_of_texts():
    rng = random.Random(5)
    for _ in range(1200):
        docs = []
        for _ in range(rng.randint(1, 5)):
            letters = rng.randint(1, 4)
            w = [str(rng.randrange(letters)) for _ in range(rng.randint(0, 40))]
            if rng.random() < 0.5 and w:
                s = rng.randrange(len(w))
                w = w[:s] + (w[s : s + rng.randint(1, 6)] * 20)[: rng.randint(0, 40)] + w[s:]
            docs.append(w)
        least, exponent = rng.choice([(2, 2), (4, 2), (6, 3), (8, 3), (24, 3), (5, 3), (9, 4)])
        batch = tandem_runs.Batch([" ".join(w).encode() for w in docs], least, exponent)
        assert batch.runs == [plain_runs(w, least, exponent) for w in docs]


def test_leftmost_squares_and_walks_complete_the_vocabulary():
    rng = random.Random(6)
    for n in list(range(1, 30)) * 6:
        t = [rng.randrange(2) for _ in range(n)]
        tree = tandem_runs.Tree(np.array([*t, 9]))
        want = {tuple(t[i : i + 2 * k]) for k in range(1, n // 2 + 1) for i in range(n - 2 * k + 1) if t[i : i + k] == t[i + k : i + 2 * k] and not any(k % p == 0 and t[i : i + k] == t[i : i + p] * (k // p) for p in range(1, k))}
        at, half = tandem_runs.leftmost_squares(tree)
        for i, k in zip(at.tolist(), half.tolist()):
            assert t[i : i + k] == t[i + k : i + 2 * k]
        low, high, half = tandem_runs.vocabulary(tree)
        got = [tuple(t[i : i + 2 * k]) for i, k in zip(tree.order[low].tolist(), half.tolist())] if len(low) else []
        assert len(got) == len(set(got)) and set(got) == want
        for a, b, k in zip(low.tolist(), high.tolist(), half.tolist()):
            piece = t[tree.order[a] : tree.order[a] + 2 * k]
            assert b - a + 1 == sum(t[i : i + 2 * k] == piece for i in range(n))


def test_long_periodic_texts():
    def of(words):
        return tandem_runs.Batch([" ".join(words).encode()], 24, 3).runs[0]

    assert of(["x"] * 50_000) == [(0, 50_000, 1)]
    assert of([str(i % 6000) for i in range(20_000)]) == [(0, 20_000, 6000)]
    assert of([str(i) for i in range(50_000)]) == []
    a, b = ["a"], ["a", "b"]
    while len(b) < 5000:
        a, b = b, b + a
    assert max(length / period for _, length, period in of(b)) < 3.7  # Fibonacci words hold no fourth powers


def plain_report(i, words):
    words = repeated_tail(str(i).encode() if i is not None else b"", words)
    found = plain_runs(words, 24, 3)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    kept = [w for k, w in enumerate(words) if k not in gone]
    return (len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(b" ".join(kept)))


def test_run_report_equals_brute_force(spark):
    rng = random.Random(8)
    texts = ["", None, "   ", "a\x1cb\x85c d " * 12, "\tone\x0btwo\x0cthree\r\n" * 30, "é " * 100]
    for _ in range(250):
        w = [rng.choice("abcdefgh") + str(rng.randrange(30)) for _ in range(rng.randint(0, 120))]
        if rng.random() < 0.4 and w:
            s = rng.randrange(len(w))
            w[s:s] = (w[s : s + rng.randint(1, 12)] * 30)[: rng.randint(20, 90)]
        texts.append(rng.choice([" ", "\n", "  "]).join(w))
    rows = [(i, t, 5) for i, t in enumerate(texts)] + [(7, texts[7], 5), (None, "a b c d " * 20, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, period int")
    got = sorted((tuple(r) for r in tandem_runs.report(df, edit=repeated_tail).collect()), key=str)
    want = sorted(((i, *plain_report(i, (t or "").encode().split())) for i, t, _ in rows), key=str)
    assert got == want and any(r[1] > 0 and zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in got if r[0] is not None) and sum(r[1] > 1 for r in got) > 0
    assert tandem_runs.report(df.limit(0)).count() == 0


def test_runs_and_collapsed_texts(spark):
    df = spark.createDataFrame([(1, "start " + "one two three " * 10 + "end", "k"), (2, "a  b\nc", "k"), (3, None, "k"), (None, "x " * 30, "k")], "c1 long, `the.text` string, text string")
    assert sorted(tuple(r) for r in tandem_runs.runs(df, id_col="c1", text_col="the.text").collect() if r[0]) == [(1, 1, 30, 3)]
    out = tandem_runs.collapsed(df, text_col="the.text")
    assert out.columns == df.columns
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted([(1, "start one two three end", "k"), (2, "a  b\nc", "k"), (3, None, "k"), (None, "x", "k")], key=str)
    with pytest.raises(ValueError):
        tandem_runs.runs_of_texts(np.arange(3), np.array([3]), 24, 1)


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_base(t):
    def luhn(d):
        return sum(int(c) if k % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for k, c in enumerate(reversed(d))) % 10 == 0

    ok = {
        "email": lambda m: True,
        "ip": lambda m: all(int(x) <= 255 for x in m.split(".")),
        "card": lambda m: 13 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m)),
        "phone": lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15,
    }
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, t) if ok[k](m.group())]


PIECES = ["a@b.c", "x.y+z%1@mail-1.example.com", "@", "a@b", "1.2.3.4", "0255.1.1.001", "256.1.1.1", "1.2.3.4.5", "4111 1111 1111 1111", "4111111111111111", "4111-1111-1111-1112", "+1 (212) 555-0100", "+1", "+44 20 7946 0958.", "+()..", " ", "\n", "é漢😀", "12", "-", ".", "word", "1" * 30, "_", "%", "+d@e.f", "@x.y"]


def test_base_spans_equal_plain_patterns(spark):
    rng = random.Random(9)
    texts = ["", None, "5" * 40_000, "a" * 40_000 + "@", "1 " * 20_000, "1.2.3.4 " * 3000, "+1" + " " * 30_000, "a@b.c+d@e.f"] + ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 25))) for _ in range(800)]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    for r in personal_data.report(df).collect():
        want = plain_base(texts[r["doc_id"]] or "")
        counts = [sum(w.startswith(k + ":") for w in want) for k in PATTERNS]
        assert [r[f"n_{k}"] for k in PATTERNS] == counts, (texts[r["doc_id"]] or "")[:200]
        assert r["base_sha256"] == sha(",".join(want))
        assert set(want) <= set(r["spans"].split(",") if r["spans"] else [])


def luhn_card(rng):
    d = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    return next(d + c for c in "0123456789" if sum(int(x) if k % 2 == 0 else 2 * int(x) - 9 * (int(x) > 4) for k, x in enumerate(reversed(d + c))) % 10 == 0)


def corpus(rng):
    """(id, text, planted pieces that no base pattern finds)"""
    words = lambda n: " ".join(rng.choice(["river", "stone", "over", "green", "market", "seven", "quiet"]) for _ in range(n))
    rows = []
    for i in range(1500):
        card = luhn_card(rng)
        name, tel = rng.choice(["ann", "bob", "eve"]), f"({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
        ip = ".".join(str(rng.randint(1, 250)) for _ in range(4))
        plain = rng.choice([f"{name}.{rng.randint(10, 99)}@mail{i % 9}.example.com", ip, card, f"+1 {tel}", "", ""])
        hidden = ""
        if i % 25 == 0:
            hidden = rng.choice([f"{name}.{rng.randint(10, 99)} [at] mail3 [dot] example [dot] com", card[:4] + "." + card[4:8] + "." + card[8:12] + "." + card[12:], ip.replace(".", "[.]")])
        decoy = rng.choice(["", "", "2024-05-06 10:20:30", f"order {rng.randint(10**6, 10**7)}", f"version {rng.randint(1, 9)}.{rng.randint(1, 9)}.{rng.randint(1, 9)}", "look at home. Then go"])
        rows.append((i, f"{words(8)} {plain} {words(5)} {hidden} {words(4)} {decoy} {words(3)}", hidden))
    return rows


def test_the_model_adds_disguised_spans_and_leaves_clean_texts(spark):
    rows = corpus(random.Random(10))
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    got = {r["doc_id"]: [s.split(":") for s in r["spans"].split(",")] if r["spans"] else [] for r in personal_data.report(df).collect()}
    caught = planted = 0
    for i, t, hidden in rows:
        base = {tuple(s.split(":")) for s in plain_base(t)}
        more = [s for s in got[i] if tuple(s) not in base]
        if hidden:
            planted += 1
            at = t.index(hidden)
            caught += any(int(a) <= at and int(b) >= at + len(hidden) for _, a, b in more)
        else:
            assert not more, (t, more)
    assert planted == 60 and caught >= 0.8 * planted
    assert [sorted(tuple(r)) for r in [personal_data.report(df.repartition(7)).agg(F.sum(F.xxhash64("doc_id", "spans").cast("decimal(38,0)"))).first()]] == [sorted(tuple(r)) for r in [personal_data.report(df).agg(F.sum(F.xxhash64("doc_id", "spans").cast("decimal(38,0)"))).first()]]


def test_redacted_texts(spark):
    df = spark.createDataFrame([("write a@b.example or +1 (212) 555-0100!", 1, "k"), (None, 2, "k"), ("clean", 3, "k"), ("m@1.2.3.4 x", 4, "k")], "`the.text` string, spans int, row string")
    out = personal_data.redacted(df, "the.text")
    assert out.columns == df.columns
    assert {r["spans"]: r["the.text"] for r in out.collect()} == {1: "write [EMAIL] or [PHONE]!", 2: None, 3: "clean", 4: "[EMAIL] x"}
    assert personal_data.redacted(df.limit(0), "the.text").count() == 0


def test_no_python_worker_finds_personal_data(spark):
    df = spark.createDataFrame([(1, "a@b.c")], "doc_id long, text string")
    plan = personal_data.report(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan.replace("LogicalRDD", ""))
