"""Personal data (email, ip, card, phone) in whole texts: candidates, boosted trees over format and context, calibrated thresholds. DataFrame expressions only.

1. Base spans: each kind's pattern, leftmost and non-overlapping, checked by format (octets, Luhn, numbers of digits). They are always reported.
2. Generators of high recall propose more: other separators, no plus sign, "at" and "dot" in words or brackets. Their spans may overlap those of other kinds; one that overlaps a base span is not asked about.
3. A boosted ensemble a kind scores a candidate by its format (form, checks, digits, groups) and context (characters at its sides, words before it). Nothing is labelled, so the corpus labels itself: base spans
   are examples, each also as if written in the other forms of its kind, in its own context; what generators propose in the wild counts against, as do base spans of another kind. A form that is common in the wild without looking like the base spans is
   so not believed. Trees are grown from sums of gradients by (node, feature, value), in whole millionths, so results don't depend on the order of rows.
4. On documents held out of the fit, the least score at which ``SHARE`` of the examples and candidates in other forms are examples is the kind's threshold; a kind without enough examples adds nothing.
   A selected candidate passes its kind's check and has digits grouped as some examples have. Of overlapping selected candidates of different kinds the better one stays.

Texts are scanned once; candidates with whole-number features are a small table in the shared folder. The fit reads distinct patterns of features, at most ``PATTERNS`` of them.

Defined results: null counts as the empty text, which has no spans; texts of any length are scanned whole, in linear time (no pattern goes back over what it has read); repeated rows get equal results; rows are told apart by a number of their own,
so ids may be null or repeated; an empty table gives an empty result; other columns are not read, and in ``redacted`` stay as they are whatever their names.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.llm.util import Tables, quoted

#: Bounds of the fit: distinct patterns read (those of the least hashes), rounds, levels of a tree, step, weight a leaf holds at least, gain of a split.
PATTERNS, ROUNDS, DEPTH, RATE, LEAST_LEAF, LEAST_GAIN = 50_000, 8, 2, 0.7, 8, 1.0
#: Share of examples among what a threshold lets pass on held-out documents, and how many it needs to be believed. What passes in the wild may be real, so the share is no precision: it bounds how common
#: a form may be beside the base spans.
SHARE, LEAST_EXAMPLES = 0.8, 20
#: One in so many documents is held out of the fit.
HELD_OUT = 4
#: Characters of context on either side.
CONTEXT = 24
#: Running sums go by blocks of so many values.
BLOCK = 512

_WORD = r"[A-Za-z0-9._%+-]"
_LABEL = r"[A-Za-z0-9-]"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of at most some tens of digits passes Luhn's check."""

    def add(total, i):
        v = digits.substr((F.length(digits) - i + 1).cast("int"), F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, v).otherwise(2 * v - F.when(v > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _card(m: Column) -> Column:
    return let(digits_of(m), lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(F.lit(False)))


@dataclass(frozen=True)
class Kind:
    """base: the pattern, with quantifiers that never give back (the sets they run over end where the next part starts); valid: its check. wide: the generator; forms: those besides the base's (0) that
    it can propose: 1 other separators or none, 2 words or brackets; sound: the check of a candidate of any form; cues: words before a span that speak for its kind; mark: what a text with a base span holds."""

    name: str
    base: str
    valid: Callable[[Column], Column]
    wide: str
    forms: tuple[int, ...]
    sound: Callable[[Column], Column]
    cues: str
    mark: str = ""
    needs: tuple[str, ...] = ()


#: Patterns begin with a set of characters and look back from there, so most places of a text cost one comparison. A run of characters that can start an email is tried at its first place, or where the match before it
#: ended: at all others the outcome is the same. ``needs``: lower-case pieces of which a text with a span of the generator has one.
_AT = ("@", " at ", *[f"{a}{gap}at" for a in "[({<" for gap in ("", " ")])
_GAP = r"[\x20()./\x{2010}-\x{2015}\x{A0}-]"
KINDS = (
    Kind(
        "email", rf"(?:\G|(?<!{_WORD})){_WORD}++@{_LABEL}++(?:\.{_LABEL}++)++", lambda m: F.lit(True),
        rf"(?i)(?:\G|(?<!{_WORD})){_WORD}++(?:\x20?[\[({{<]\x20?(?:at|@)\x20?[\])}}>]\x20?|\x20?@\x20?|\x20at\x20){_LABEL}++(?:(?:\x20?[\[({{<]\x20?(?:dot|\.)\x20?[\])}}>]\x20?|\x20?\.|\x20dot\x20){_LABEL}++)++",
        (2,), lambda m: m.rlike(r"(?:[.\])}>\x20])[A-Za-z]{2,12}$"), "mail|contact|write|address", "@", _AT,
    ),
    Kind(
        "ip", r"[0-9](?<![0-9]{2})[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++", lambda m: m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"),
        r"(?i)[0-9](?<![0-9]{2})[0-9]{0,2}+(?:(?:[.,_]|\x20?[\[({<](?:dot|\.)[\])}>]\x20?|\x20dot\x20)[0-9]{1,3}+){3}(?![0-9])",
        (1, 2), lambda m: F.regexp_replace(m, "[^0-9]+", ".").rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"), r"\bip|host|server|addr|login|from", ".",
    ),
    Kind(
        "card", r"[0-9](?:[\x20-]?[0-9])++", _card,
        r"[0-9](?<![0-9]{2})(?:[0-9]{12,18}+|(?:[\x20._/\x{2010}-\x{2015}\x{A0}-]{0,2}[0-9]){12,18}+)(?![0-9])",
        (1,), _card, "card|visa|credit|debit|payment|konto|carte|tarjeta",
    ),
    Kind(
        "phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: F.length(digits_of(m)).between(9, 15),
        rf"[+(0-9](?<![0-9A-Za-z+][+(0-9])(?:{_GAP}{{0,2}}[0-9]){{8,15}}+(?![0-9])",
        (1,), lambda m: F.length(digits_of(m)).between(9, 15), "tel|phone|call|fax|mobile|mobil|cell|whatsapp", "+",
    ),
)
#: Features in order; each is a small whole number.
FEATURES = ("form", "sound", "n_digits", "groups", "longest", "lead", "left", "right", "cue")


def running(values: Column) -> Column:
    """The sum of the values before each, for an array of whole numbers: by blocks, so the cost is linear."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda b: F.slice(values, b * BLOCK + 1, BLOCK))
    grow = lambda held, x: F.concat(held, F.array(F.element_at(held, -1) + x))
    zero = F.array(F.lit(0).cast("long"))
    inner = F.transform(blocks, lambda v: F.aggregate(v, zero, grow))  # a block's running sums, with 0 before and its total last
    totals = lambda sums: F.aggregate(sums, zero, lambda held, v: grow(held, F.element_at(v, -1)))
    spread = lambda sums, at: F.flatten(F.transform(sums, lambda v, b: F.transform(F.slice(v, F.lit(1), F.size(v) - 1), lambda x: x + F.get(at, b))))
    return let(inner, lambda sums: let(totals(sums), lambda at: spread(sums, at)))


SPAN = "array<struct<start:bigint,stop:bigint,hit:string,before:string,after:string>>"


def spans(t: Column, pattern: str) -> Column:
    """Matches in order, with their places in code points and their context up to the neighbouring matches."""
    n_chars = lambda x: F.char_length(x).cast("long")
    at_of = lambda gaps, hits: running(F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: n_chars(g) + n_chars(h)))

    def made(gaps, hits, at):
        def one(h, k):
            start = F.get(at, k) + n_chars(F.get(gaps, k))
            near = F.get(gaps, k)
            return F.struct(start.alias("start"), (start + n_chars(h)).alias("stop"), h.alias("hit"), F.right(near, F.lit(CONTEXT)).alias("before"), F.left(F.get(gaps, k + 1), F.lit(CONTEXT)).alias("after"))

        return F.transform(hits, one)

    placed = lambda hits: let(F.split(t, pattern, -1), lambda gaps: let(at_of(gaps, hits), lambda at: made(gaps, hits, at)))
    none = F.array().cast(SPAN)
    return let(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda hits: F.when(F.size(hits) == 0, none).otherwise(placed(hits)))


def features(kind: Kind, s: Column, base: bool) -> list[Column]:
    """The features of a span of a kind."""
    m = s["hit"]
    side = lambda c: F.when(c == "", 0).when(c.rlike(r"^\s$"), 1).when(c.rlike("^[0-9]$"), 3).when(c.rlike(r"^[\p{L}_]$"), 2).otherwise(4)
    groups = F.split(F.regexp_replace(m, "^[^0-9]+|[^0-9]+$", ""), "[^0-9]+")
    form = F.lit(0) if base else F.when(m.rlike(rf"^(?:{kind.base})$"), 0).when(m.rlike(r"(?i)[\[({<](?:at|@|dot|\.)|\x20(?:at|dot)\x20|\x20@|@\x20"), 2).otherwise(1)
    others = "|".join(k.cues for k in KINDS if k is not kind)
    near = F.lower(s["before"])
    return [
        form,
        F.lit(1) if base and kind.name != "email" else F.coalesce(kind.sound(m), F.lit(False)).cast("int"),
        F.least(F.length(digits_of(m)), F.lit(20)),
        F.least(F.size(groups), F.lit(6)),
        F.least(F.array_max(F.transform(groups, F.length)), F.lit(20)),
        F.coalesce(F.regexp_extract(m, "([0-9])", 1).try_cast("int"), F.lit(-1)) if kind.name == "card" else F.lit(-1),
        side(F.right(s["before"], F.lit(1))),
        side(F.left(s["after"], F.lit(1))),
        F.when(near.rlike(f"(?:{kind.cues})[^.!?]*$"), 1).when(near.rlike(f"(?:{others})[^.!?]*$"), 2).otherwise(0),
    ]


def _described(t: Column, number: int, base: bool) -> Column:
    """Spans of a kind as (kind, start, stop, f), f the features."""
    kind = KINDS[number]
    found = spans(t, kind.base if base else kind.wide)
    if base:
        found = F.filter(found, lambda s: kind.valid(s["hit"]))
    f = lambda s: F.array(*[x.cast("int") for x in features(kind, s, base)])
    found = F.transform(found, lambda s: F.struct(F.lit(number).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), f(s).alias("f")))
    none = F.array().cast("array<struct<kind:int,start:bigint,stop:bigint,f:array<int>>>")
    if base and kind.mark:
        return F.when(F.contains(t, F.lit(kind.mark)), found).otherwise(none)
    if not base and kind.needs:
        return F.when(let(F.lower(t), lambda low: reduce(lambda x, y: x | y, [F.contains(low, F.lit(x)) for x in kind.needs])), found).otherwise(none)
    return found


def _all_described(t: Column, base: bool) -> Column:
    """Of all kinds; only emails are looked for in texts without digits."""
    first, *rest = [_described(t, k, base) for k in range(len(KINDS))]
    return F.when(t.rlike("[0-9]"), F.concat(first, *rest)).otherwise(first)


def proposed(df: DataFrame, text: Column, *keep: Column) -> DataFrame:
    """(n, keep.., base, wide): a number for each row, its base spans in order of kind and start, and what the generators propose."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    held = [_all_described(t, base).alias(name) for name, base in (("base", True), ("wide", False))]
    return df.select(F.monotonically_increasing_id().alias("n"), *keep, *held)


def candidates(table: DataFrame) -> DataFrame:
    """(n, kind, start, stop, f, base, free): base spans, and proposed ones but those that overlap a base span of their kind; free: none of any kind is overlapped."""
    wide = table.select("n", F.explode("wide").alias("s"), F.lit(False).alias("base"))
    base = table.select("n", F.explode("base").alias("s"), F.lit(True).alias("base"))
    rows = base.unionByName(wide).select("n", "s.*", "base")
    # base spans of each kind that start no later and still run, or start later but before the candidate's end
    ahead = W.partitionBy("n").orderBy("start", F.col("base").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    behind = W.partitionBy("n").orderBy(F.col("start").desc(), F.col("base").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    met = [
        F.coalesce(F.max(F.when(F.col("base") & (F.col("kind") == k), F.col("stop"))).over(ahead) > F.col("start"), F.lit(False))
        | F.coalesce(F.min(F.when(F.col("base") & (F.col("kind") == k), F.col("start"))).over(behind) < F.col("stop"), F.lit(False))
        for k in range(len(KINDS))
    ]
    rows = rows.withColumn("met", F.array(*met))
    return rows.filter(F.col("base") | ~F.get("met", F.col("kind"))).withColumn("free", ~F.exists("met", lambda x: x)).drop("met")


Split = tuple[int, int]
#: Where all go to the left.
UNSPLIT: Split = (0, 1 << 30)


@dataclass
class Model:
    """By kind: the starting score, trees (by level, the split (feature, greatest value to the left) of each node; then the leaves), the threshold, None where the kind adds nothing, and the shapes that examples have."""

    start: dict[int, float] = field(default_factory=dict)
    trees: dict[int, list[tuple[list[list[Split]], list[float]]]] = field(default_factory=lambda: defaultdict(list))
    threshold: dict[int, float | None] = field(default_factory=dict)
    shapes: dict[int, list[int]] = field(default_factory=dict)

    def score(self) -> Column:
        """Of the columns kind and f. As SQL text: a tree has many small parts, and text reaches the engine in one piece."""
        held = [f"WHEN {k} THEN {' + '.join([repr(at) + 'D', *[_leaf(*tree) for tree in self.trees[k]]])}" for k, at in self.start.items()]
        if not held:
            return F.lit(0.0)
        return F.expr(f"CASE kind {' '.join(held)} ELSE 0D END")

    def selects(self) -> Column:
        """Of the columns kind, f and score: whether the score reaches the kind's threshold, the kind's check is passed and examples have such a shape. Trees don't speak of shapes they haven't seen."""
        out = F.lit(False)
        for k, least in self.threshold.items():
            if least is not None:
                out = out | ((F.col("kind") == k) & (F.col("score") >= least) & shape(F.col("f")).isin(self.shapes[k]))
        return out & (F.get("f", F.lit(FEATURES.index("sound"))) == 1)


def shape(f: Column) -> Column:
    """Digits, groups and the longest group as one number; of at most some thousand values."""
    at = [F.get(f, F.lit(FEATURES.index(x))) for x in ("n_digits", "groups", "longest")]
    return at[0] * 1000 + at[1] * 100 + at[2]


def _goes_right(split: Split) -> str:
    return f"get(f, {split[0]}) > {split[1]}"


def _node(levels: list[list[Split]]) -> str:
    """The number of the node that a candidate reaches below the levels so far."""
    at = "0"
    for splits in levels:
        turns = " ".join(f"WHEN {k} THEN int({_goes_right(split)})" for k, split in enumerate(splits))
        at = f"(2 * {at} + CASE {at} {turns} END)"
    return at


def _leaf(levels: list[list[Split]], leaves: list[float], level: int = 0, k: int = 0) -> str:
    if level == len(levels):
        return f"{leaves[k]!r}D"
    return f"IF({_goes_right(levels[level][k])}, {_leaf(levels, leaves, level + 1, 2 * k + 1)}, {_leaf(levels, leaves, level + 1, 2 * k)})"


def _as(f: Column, **new: Column) -> Column:
    """Features with some of them replaced."""
    return F.array(*[new.get(name, F.get(f, F.lit(k))).cast("int") for k, name in enumerate(FEATURES)])


def _written(kind: Column, f: Column) -> Column:
    """A base span's features as it stands, and as if written in the other forms of its kind: digits in fours for a card, without the country's number for a phone."""
    n, groups = F.get(f, F.lit(FEATURES.index("n_digits"))), F.get(f, F.lit(FEATURES.index("groups")))
    also = {"card": _as(f, form=F.lit(1), groups=F.ceil(n / 4), longest=F.lit(4)), "phone": _as(f, form=F.lit(1), n_digits=n - 1, groups=F.greatest(groups - 1, F.lit(1)))}
    out = F.array(f)
    for k, held in enumerate(KINDS):
        forms = [_as(f, form=F.lit(v)) for v in held.forms] + ([also[held.name]] if held.name in also else [])
        out = F.when(kind == k, F.array(f, *forms)).otherwise(out)
    return out


def examples(rows: DataFrame) -> DataFrame:
    """(kind, f, held, yes, no): distinct patterns of features with counts. A base span is an example in its own form and in each other form of its kind."""
    held = F.pmod(F.xxhash64("n", F.lit("held")), F.lit(HELD_OUT)) == 0
    shown = F.explode(F.when(F.col("base"), _written(F.col("kind"), F.col("f"))).otherwise(F.array("f")))
    named = rows.select("kind", shown.alias("f"), "base", held.alias("held"))
    return named.groupBy("kind", "f", "held").agg(F.sum(F.col("base").cast("long")).alias("yes"), F.sum((~F.col("base")).cast("long")).alias("no"))


def fit(rows: DataFrame, tables: Tables) -> Model:
    """Boosted trees and thresholds from candidate rows. Trees stop growing where none of a round splits; a kind that nothing speaks against has none."""
    patterns = tables.stored(examples(rows), "patterns")
    train = tables.stored(patterns.filter(~F.col("held")).orderBy(F.xxhash64("kind", "f"), "kind", "f").limit(PATTERNS).coalesce(1), "train")
    model, growing = Model(), []
    for r in train.groupBy("kind").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).orderBy("kind").collect():
        if r["yes"]:
            model.start[r["kind"]] = math.log((r["yes"] + 1) / (r["no"] + 1))
            growing += [r["kind"]] if r["no"] else []
    for r in train.groupBy("kind", shape(F.col("f")).alias("shape")).agg(F.sum("yes").alias("yes")).filter(F.col("yes") >= LEAST_LEAF).orderBy("kind", "shape").collect():
        model.shapes.setdefault(r["kind"], []).append(r["shape"])
    for _ in range(ROUNDS):
        growing = _grow(train, model, growing) if growing else growing
    _calibrate(patterns, model)
    return model


def _grow(train: DataFrame, model: Model, kinds: list[int]) -> list[int]:
    """One more tree for each of the kinds, a level a job: sums of gradients by node, feature and value, of which the driver sees a few thousand at most. Returns the kinds whose tree splits."""
    p = 1 / (1 + F.exp(-model.score()))
    weight = F.col("yes") + F.col("no")
    millionths = lambda x: F.round(x * 1_000_000).cast("long")
    base = train.filter(F.col("kind").isin(kinds)).withColumn("p", p).select("kind", "f", weight.alias("w"), millionths(F.col("yes") - weight * F.col("p")).alias("g"), millionths(weight * F.col("p") * (1 - F.col("p"))).alias("h"))
    levels: dict[int, list[list[Split]]] = {k: [] for k in kinds}
    leaves: dict[int, list[float]] = {}
    for depth in range(DEPTH):
        node = F.expr(f"CASE kind {' '.join(f'WHEN {k} THEN {_node(held)}' for k, held in levels.items())} END")
        sums = base.select("kind", node.alias("node"), F.posexplode("f").alias("feature", "value"), "w", "g", "h").groupBy("kind", "node", "feature", "value").agg(F.sum("w").alias("w"), F.sum("g").alias("g"), F.sum("h").alias("h"))
        held = defaultdict(list)
        for r in sums.collect():
            held[r["kind"], r["node"], r["feature"]].append((r["value"], r["w"], r["g"] / 1e6, r["h"] / 1e6))
        for k in levels:
            splits, ends = [], []
            for n in range(1 << depth):
                split, sides = _best(k, n, held)
                splits.append(split)
                ends.extend(sides)
            levels[k].append(splits)
            leaves[k] = ends
    split = [k for k in levels if levels[k][0][0] != UNSPLIT]
    for k in split:
        model.trees[k].append((levels[k], leaves[k]))
    return split


def _best(kind: int, node: int, held: dict) -> tuple[Split, list[float]]:
    """The split of most gain, and a leaf's value on either side; a node that can't be split sends all to the left."""
    worth = lambda g, h: g * g / (h + 1)
    value = lambda g, h: round(RATE * g / (h + 1), 9)
    whole = held.get((kind, node, 0), [])
    w, g, h = (sum(x[i] for x in whole) for i in (1, 2, 3))
    best, gain, sides = UNSPLIT, LEAST_GAIN, [value(g, h), 0.0]
    for feature in range(len(FEATURES)):
        left = [0, 0.0, 0.0]
        for v, dw, dg, dh in sorted(held.get((kind, node, feature), [])):
            left = [left[0] + dw, left[1] + dg, left[2] + dh]
            if left[0] >= LEAST_LEAF and w - left[0] >= LEAST_LEAF:
                got = round(worth(left[1], left[2]) + worth(g - left[1], h - left[2]) - worth(g, h), 6)
                if got > gain:
                    best, gain, sides = (feature, v), got, [value(left[1], left[2]), value(g - left[1], h - left[2])]
    return best, sides


def _calibrate(patterns: DataFrame, model: Model) -> None:
    """Thresholds by held-out patterns in forms other than the base's, scores in steps of a sixteenth."""
    if not model.start:
        return
    other = patterns.filter(F.col("held") & (F.get("f", F.lit(0)) > 0) & F.col("kind").isin(list(model.start)))
    curve = other.groupBy("kind", F.floor(16 * model.score()).alias("step")).agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).collect()
    for k in model.start:
        yes = no = 0
        model.threshold[k] = None
        for r in sorted((r for r in curve if r["kind"] == k), key=lambda r: -r["step"]):
            yes, no = yes + r["yes"], no + r["no"]
            if yes >= LEAST_EXAMPLES and yes >= SHARE * (yes + no) and r["step"] > 0 and k in model.shapes:
                model.threshold[k] = r["step"] / 16


def added(scored: DataFrame, model: Model) -> DataFrame:
    """Of proposed spans with scores: (n, added): the proposed spans that the model selects. Beside the nearest overlapping one of another kind on either side only the better one stays (ties: the kind listed first)."""
    picked = scored.filter(model.selects()).select("n", "kind", "start", "stop", "score")
    here = F.struct("start", "stop", "score", (-F.col("kind")).alias("first"))
    forward = W.partitionBy("n").orderBy("start", "kind").rowsBetween(W.unboundedPreceding, -1)
    backward = W.partitionBy("n").orderBy(F.col("start").desc(), F.col("kind").desc()).rowsBetween(W.unboundedPreceding, -1)
    lost = F.lit(False)
    for k in range(len(KINDS)):
        for side in (forward, backward):
            near = F.last(F.when(F.col("kind") == k, here), ignorenulls=True).over(side)
            worse = (near["start"] < F.col("stop")) & (near["stop"] > F.col("start")) & (F.struct(near["score"], near["first"]) > F.struct(F.col("score"), (-F.col("kind")).alias("first")))
            lost = lost | F.coalesce(worse & (F.col("kind") != k), F.lit(False))
    kept = picked.withColumn("lost", lost).filter(~F.col("lost"))
    return kept.groupBy("n").agg(F.collect_list(F.struct("kind", "start", "stop")).alias("added"))


def detected(df: DataFrame, text: Column, *keep: Column) -> DataFrame:
    """(keep.., base, spans): a row's base spans, and all spans, as (kind, start, stop) in order of kind and start; places are code points, the end exclusive."""
    tables = Tables(df.sparkSession)
    table = held = tables.stored(proposed(df, text, *keep), "proposed")
    rows = tables.stored(candidates(held), "candidates")
    model = fit(rows, tables)
    plain = lambda a: F.transform(a, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))
    table = table.withColumn("base", plain(F.col("base")))
    scored = tables.stored(rows.filter(~F.col("base") & F.col("free")).select("n", "kind", "start", "stop", "f", model.score().alias("score")), "scored")
    more = tables.stored(added(scored, model), "added")
    tables.drop(held, more)
    more = more.withColumnRenamed("n", "of")
    none = F.array().cast("array<struct<kind:int,start:bigint,stop:bigint>>")
    out = table.join(more, F.col("n") == F.col("of"), "left").withColumn("spans", F.array_sort(F.concat("base", F.coalesce("added", none))))
    return out.drop("n", "wide", "of", "added")


def listed(spans_: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k.name) for k in KINDS])
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _of_kind(k: int) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == k


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans): numbers and digest of the base spans, and all spans listed."""
    out = detected(df, F.col(quoted(text_col)), F.col(quoted(id_col)).alias("id"))
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{kind.name}") for k, kind in enumerate(KINDS)]
    return out.select(F.col("id").alias(id_col), *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redacted(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The input's columns; in the text each stretch that spans cover is its kind in brackets, of overlapping spans the first's. Null stays null."""
    row = F.struct(*[F.col(quoted(c)).alias(f"c{k}") for k, c in enumerate(df.columns)])
    at = df.columns.index(text_col)
    out = detected(df, F.col(quoted(text_col)), row.alias("row"))
    names = F.array(*[F.lit(f"[{k.name.upper()}]") for k in KINDS])
    t = F.col(f"row.c{at}").cast("string")
    by_place = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("less"), s["kind"].alias("kind"))))

    def cut(held, s):
        piece = F.concat(t.substr((held["to"] + 1).cast("int"), (s["start"] - held["to"]).cast("int")), F.get(names, s["kind"]))
        new = F.when(s["start"] >= held["to"], F.concat(held["text"], piece)).otherwise(held["text"])
        return F.struct(F.greatest(held["to"], -s["less"]).alias("to"), new.alias("text"))

    made = F.aggregate(by_place, F.struct(F.lit(0).cast("long").alias("to"), F.lit("").alias("text")), cut, lambda held: F.concat(held["text"], t.substr((held["to"] + 1).cast("int"), F.char_length(t))))
    text = F.when(t.isNotNull(), made)
    return out.select(*[(text if k == at else F.col(f"row.c{k}")).alias(c) for k, c in enumerate(df.columns)])
