"""Secrets in texts: three fixed patterns, and strings that pass tests of randomness. Columns and SQL functions only.

The patterns are leftmost, non-overlapping matches, of which the too short ones
are dropped. Beside them every run of at least `SHORTEST` letters, digits and
`+/_-` is a candidate. The smallest fitting encoding gives each of its signs a
number. Three statistics are taken: chi-squared against equal use of the
alphabet, runs above and below the middle of the alphabet, and serial
correlation of neighbours.

Each statistic is held against two models. Ordinary strings use signs as a fixed
reference model says (shares of letters in prose, a few capitals and digits, signs
followed by their own kind), to which the counts of the table's distinct
candidates outside the patterns are added, less those that lie nearer to random
strings; from single and double counts come mean and variance at any length.
Random strings use every sign alike. The three are combined by their distance
between the two models, so a short string, which tells little, gets little. Words
are made of syllables and so vary more than single signs would: the spread of the
combined figure starts from a usual one and takes in the quartiles of the
distinct ordinary candidates of an encoding and length class. Neither has a least
number of strings, so what is found does not hang on the size of a table, and
neither many secrets nor many copies of one pass for ordinary. The chance that an
ordinary string looks as random is the p-value. It is weighed by the power of the
test at this length and encoding, and the false discovery rate over all candidates
of the table is held at `RATE` (weighted Benjamini-Hochberg; p-values are rounded
up to hundredths of a decade, which bounds the table that settles the limit). A
candidate is reported if it is below the limit, is not refused as random, and
touches no match of a pattern.

Places are code points, ends exclusive. A missing or empty text has no spans.
Repeated rows count as often as they occur. Columns of other names pass
through; columns named like an output are replaced. Building the result runs
jobs: rows and candidates are stored, and small aggregates are fetched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.llm.common import stored, text_of

# What counts as a secret by pattern.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LENGTH, ACCESS_LENGTH, HEX_LENGTH = 12, 18, 16
KINDS = ("assign", "access", "hex", "random")

SHORTEST = 16
CANDIDATE = rf"[A-Za-z0-9+/_-]{{{SHORTEST},}}"
RATE = 0.01
#: Distance between ordinary and random strings from which a string is told to be nearer to one of them.
TELLS = 4.0
#: A candidate is refused as random if one of three tests rejects it at this level.
NOT_RANDOM = 0.001
#: Bins of p-values: hundredths of a decade, up to 300 decades.
BINS = 100

_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings from the narrowest: the first that has all signs of a string is taken.
ENCODINGS = (
    ("digits", _DIGITS),
    ("hex", _DIGITS + "abcdef"),
    ("upper hex", _DIGITS + "ABCDEF"),
    ("lower", _LOWER),
    ("upper", _UPPER),
    ("base32", _UPPER + "234567"),
    ("lower36", _LOWER + _DIGITS),
    ("upper36", _UPPER + _DIGITS),
    ("letters", _LOWER + _UPPER),
    ("base62", _LOWER + _UPPER + _DIGITS),
    ("base64", _LOWER + _UPPER + _DIGITS + "+/"),
    ("base64url", _LOWER + _UPPER + _DIGITS + "-_"),
    ("all", _LOWER + _UPPER + _DIGITS + "+/-_"),
)

# How often letters stand in Latin-script prose, in thousandths, from a to z.
LETTERS = (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1)
#: What the reference model of ordinary strings takes for granted: shares of capitals, digits and other signs, how much
#: likelier a sign is followed by one of its own kind, and how much likelier vowels and consonants take turns.
CAPITALS, NUMBERS, OTHERS, SAME_KIND, TURNS = 0.15, 0.05, 0.02, 1.5, 1.5
#: Signs and pairs that the reference model counts as, beside those of the table, and strings that a class's usual spread does.
REFERENCE_SIGNS, REFERENCE_STRINGS = 5000, 200
#: Spread of ordinary strings where the table says nothing: words are made of syllables, so more than single signs would have.
USUAL_SPREAD = 2.0


def running(values: Column, combine) -> Column:
    """Running totals of an array by doubling steps, so that long arrays stay cheap."""
    steps = F.array(*[F.lit(1 << k) for k in range(31)])

    def step(held: Column, by: Column) -> Column:
        before = F.concat(F.array_repeat(F.lit(None).cast("long"), by), F.slice(held, F.lit(1), F.size(held) - by))
        return F.when(by < F.size(held), F.zip_with(held, before, lambda x, y: F.when(y.isNull(), x).otherwise(combine(x, y)))).otherwise(held)

    return F.aggregate(steps, values, step)


def matches(text: Column, pattern: str, hint: Column) -> Column:
    """array<struct<start, text>> of the leftmost matches; `hint` is a cheap condition that any match fulfils."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.transform(F.split(text, pattern, -1), lambda p: F.length(p).cast("long"))
    lengths = F.transform(found, lambda m: F.length(m).cast("long"))

    def placed(pair: Column) -> Column:
        n = F.size(pair["found"])
        steps = F.zip_with(
            F.slice(pair["between"], F.lit(1), n),
            F.concat(F.array(F.lit(0).cast("long")), F.slice(pair["lengths"], F.lit(1), F.greatest(n - 1, F.lit(0)))),
            lambda x, y: x + F.coalesce(y, F.lit(0)),
        )
        starts = running(F.slice(steps, F.lit(1), n), lambda x, y: x + y)
        return F.zip_with(starts, pair["found"], lambda s, m: F.struct(s.alias("start"), m.alias("text")))

    # the pair goes through an array of one, so that each regular expression runs once
    pair = F.array(F.struct(found.alias("found"), between.alias("between"), lengths.alias("lengths")))
    nothing = F.array().cast("array<struct<start:bigint,text:string>>")
    return F.when(hint, F.transform(pair, placed)[0]).otherwise(nothing)


def _spans(found: Column, kind: int, keep) -> Column:
    return F.transform(
        F.filter(found, keep),
        lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), (m["start"] + F.length(m["text"])).alias("end")),
    )


def base_spans(text: Column) -> Column:
    """Spans of the three patterns as array<struct<start, kind, end>>, by start and kind."""
    assign = matches(text, ASSIGN, text.rlike(ASSIGN))
    value = r"(?s)^.*?[:=]\x20*[\"']?"
    spans = F.concat(
        _spans(assign, 0, lambda m: F.length(F.regexp_replace(m["text"], value, "")) >= ASSIGN_LENGTH),
        _spans(matches(text, ACCESS, text.contains("AKIA")), 1, lambda m: F.length(m["text"]) >= ACCESS_LENGTH),
        # runs are maximal, so the shortest length can stand in the pattern
        _spans(matches(text, HEX.replace("+", f"{{{HEX_LENGTH},}}"), text.rlike(HEX.replace("+", f"{{{HEX_LENGTH}}}"))), 2, lambda m: F.lit(True)),
    )
    return F.array_sort(spans)


def _touches(spans: Column, start: Column, end: Column) -> Column:
    return F.exists(spans, lambda s: (s["start"] < end) & (start < s["end"]))


def _encoding(text: Column) -> Column:
    number = F.lit(len(ENCODINGS) - 1)
    for i in range(len(ENCODINGS) - 2, -1, -1):
        signs = ENCODINGS[i][1].replace("-", r"\-")
        number = F.when(text.rlike(f"^[{signs}]+$"), F.lit(i)).otherwise(number)
    return number


def _table(spark: SparkSession, key: str, **columns: list) -> DataFrame:
    """A small table from lists, numbered from 0 in `key`. No larger than encodings and length classes, so it may go to all."""
    size = len(next(iter(columns.values())))
    return F.broadcast(spark.range(size).select(
        F.col("id").cast("int").alias(key),
        *[F.element_at(F.array(*[F.lit(v) for v in values]), F.col("id").cast("int") + 1).alias(name) for name, values in columns.items()],
    ))


def candidates(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds `__base` (spans of the patterns), `__outside` (array<struct<start, text>>: candidates that touch none) and `__row`."""
    body = text_of(f"`{text}`")
    placed = df.withColumn("__base", base_spans(body)).withColumn(
        "__runs", matches(body, CANDIDATE, body.rlike(CANDIDATE.replace(",}", "}")))
    )
    outside = F.filter("__runs", lambda m: ~_touches(F.col("__base"), m["start"], m["start"] + F.length(m["text"])))
    return placed.withColumn("__outside", outside).drop("__runs").withColumn("__row", F.monotonically_increasing_id())


def measured(rows: DataFrame) -> DataFrame:
    """Each candidate as a row: encoding, length, sum of squared counts, changes of side and products of neighbours."""
    found = rows.filter(F.size("__outside") > 0).select("__row", F.explode("__outside").alias("m"))
    found = found.select("__row", "m.start", "m.text").withColumn("e", _encoding(F.col("text")))
    alphabets = _table(rows.sparkSession, "e", alphabet=[a for _, a in ENCODINGS], k=[len(a) for _, a in ENCODINGS])
    valued = found.join(alphabets, "e").select(
        "__row", "start", "text", "e", "k", F.transform(F.split("text", ""), lambda c: F.instr(F.col("alphabet"), c)).alias("v")
    )
    v, k, n = F.col("v"), F.col("k"), F.size("v")
    # the squares grow by 2c + 1 when a sign is met for the c + 1st time; sorted, equal signs are neighbours
    squares = F.aggregate(
        F.array_sort(v), F.struct(F.lit(0).alias("last"), F.lit(0).cast("long").alias("c"), F.lit(0).cast("long").alias("sum")),
        lambda a, x: F.struct(
            x.alias("last"),
            F.when(x == a["last"], a["c"] + 1).otherwise(F.lit(1).cast("long")).alias("c"),
            (a["sum"] + F.when(x == a["last"], 2 * a["c"] + 1).otherwise(F.lit(1).cast("long"))).alias("sum"),
        ),
        lambda a: a["sum"],
    )
    # one walk over neighbours: the sign before, changes of side, products, and the signs' own squares
    zero = F.lit(0).cast("long")
    walk = F.aggregate(
        v, F.struct(F.lit(0).alias("last"), zero.alias("changes"), zero.alias("products"), zero.alias("own")),
        lambda a, x: F.struct(
            x.alias("last"),
            (a["changes"] + F.when((a["last"] > 0) & ((2 * a["last"] <= k) != (2 * x <= k)), 1).otherwise(0)).alias("changes"),
            (a["products"] + F.when(a["last"] > 0, (2 * a["last"] - k - 1) * (2 * x - k - 1)).otherwise(0)).alias("products"),
            (a["own"] + (2 * x - k - 1) * (2 * x - k - 1)).alias("own"),
        ),
    )
    return valued.select("__row", "start", "text", "e", "k", n.alias("n"), squares.alias("squares"), walk.alias("w")).select(
        "__row", "start", "text", "e", "k", "n", "squares", "w.changes", "w.products", "w.own"
    )


def _kind(sign: str) -> int:
    return 0 if sign in _LOWER else 1 if sign in _UPPER else 2 if sign in _DIGITS else 3


def reference_shares() -> dict[str, float]:
    """How often each sign stands in ordinary strings, before any table is seen."""
    plain = dict(zip(_LOWER, (n / sum(LETTERS) for n in LETTERS), strict=True))
    out = {c: q * (1 - CAPITALS - NUMBERS - OTHERS) for c, q in plain.items()}
    out |= {c.upper(): q * CAPITALS for c, q in plain.items()}
    out |= {c: NUMBERS / 10 for c in _DIGITS} | {c: OTHERS / 4 for c in "+/-_"}
    return out


def _follows(x: str, y: str) -> float:
    """How much likelier than by its share `y` follows `x` in the reference model."""
    vowels = "aeiouyAEIOUY"
    turn = TURNS if _kind(x) < 2 and _kind(y) < 2 and (x in vowels) != (y in vowels) else 1.0
    return turn * (SAME_KIND if _kind(x) == _kind(y) else 1.0)


def ordinary_model(found: DataFrame | None) -> list[dict]:
    """Per encoding what ordinary strings do: sums of squared and cubed shares, rate of changes, correlation.

    The reference model counts as `REFERENCE_SIGNS` signs and pairs; those of the candidates are added to it, at any
    number. Counts over all candidates meet in a table of pairs of signs (at most 66 x 67 rows), which is all that is fetched.
    """
    single: dict = {}
    double: dict = {}
    if found is not None:
        letters = F.split("text", "")
        pairs = found.select(F.explode(F.zip_with(letters, F.slice(letters, F.lit(2), F.greatest(F.size(letters) - 1, F.lit(0))), lambda x, y: F.struct(x.alias("x"), y.alias("y")))).alias("p"))
        # every sign is the first of one pair; that of the last sign has no second
        for r in pairs.groupBy("p.x", "p.y").agg(F.count(F.lit(1)).alias("n")).collect():
            single[r.x] = single.get(r.x, 0) + r.n
            if r.y is not None:
                double[r.x, r.y] = r.n
    usual = reference_shares()
    out = []
    for _, alphabet in ENCODINGS:
        k = len(alphabet)
        number = {c: i + 1 for i, c in enumerate(alphabet)}
        whole = sum(usual[c] for c in alphabet)
        counts = [single.get(c, 0) + REFERENCE_SIGNS * usual[c] / whole for c in alphabet]
        guess = {(x, y): usual[x] * usual[y] * _follows(x, y) for x in alphabet for y in alphabet}
        scale = REFERENCE_SIGNS / sum(guess.values())
        near = [(number[x], number[y], double.get((x, y), 0) + scale * n) for (x, y), n in guess.items()]
        met, total = sum(n for *_, n in near), sum(counts)
        shares = [c / total for c in counts]
        own = sum(n * ((2 * x - k - 1) ** 2 + (2 * y - k - 1) ** 2) / 2 for x, y, n in near)
        out.append({
            "s2": sum(q**2 for q in shares), "s3": sum(q**3 for q in shares),
            "rate": min(max(sum(n for x, y, n in near if (2 * x <= k) != (2 * y <= k)) / met, 1e-6), 1 - 1e-6),
            "serial": sum(n * (2 * x - k - 1) * (2 * y - k - 1) for x, y, n in near) / own,
        })
    return out


def lower_tail(z: Column) -> Column:
    """Normal distribution function, with small relative error in the lower tail (complementary error function by a series)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.5 * x)
    # Coefficients of the published rational approximation.
    series = F.lit(0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        series = F.lit(c) + t * series
    tail = 0.5 * t * F.exp(-x * x + series)
    return F.when(z < 0, tail).otherwise(1 - tail)


def _may_be_random() -> Column:
    """Whether none of the three tests refuses a measured candidate as random."""
    k, n = F.col("k").cast("double"), F.col("n").cast("double")
    chi, steps = k / n * F.col("squares") - n, n - 1
    serial = F.when(F.col("own") > 0, F.col("products") / F.col("own")).otherwise(1.0)
    uniform = [
        1 - lower_tail((chi - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)),
        2 * lower_tail(-F.abs(F.col("changes") - steps / 2) / F.sqrt(steps / 4)),
        2 * lower_tail(-F.abs(serial) * F.sqrt(steps)),
    ]
    return F.least(*uniform) > NOT_RANDOM / 3


def _ordinary() -> Column:
    """Whether a scored candidate is no nearer to random strings than to ordinary ones, as far as that can be told."""
    return (F.col("far") < TELLS) | (F.col("z") > -F.col("far") / 2)


def scored(found: DataFrame, model: list[dict]) -> DataFrame:
    """Adds `z` and `far` to measured candidates: how they lie to ordinary strings, and how far random ones lie."""
    names = ("s2", "s3", "rate", "serial")
    rows = found.join(_table(found.sparkSession, "e", **{f"__{n}": [float(x[n]) for x in model] for n in names}), "e")
    s2, s3, rate, usual = (F.col(f"__{n}") for n in names)
    k, n, steps = F.col("k").cast("double"), F.col("n").cast("double"), F.col("n").cast("double") - 1
    spread = 4 * n * (n - 1) * (n - 2) * (s3 - s2 * s2) + 2 * n * (n - 1) * (s2 - s2 * s2)
    rows = rows.select(
        *found.columns,
        (k / n * F.sqrt(F.greatest(spread, F.lit(1e-9)))).alias("__d1"), F.sqrt(steps * rate * (1 - rate)).alias("__d2"),
        (k / n * F.col("squares") - n).alias("__chi"), (k * (1 + (n - 1) * s2) - n).alias("__mean"),
        F.when(F.col("own") > 0, F.col("products") / F.col("own")).otherwise(1.0).alias("__own"), rate.alias("__rate"), usual.alias("__usual"),
    )
    side, sign, root = F.signum(0.5 - F.col("__rate")), F.signum("__usual"), F.sqrt(steps)
    rows = rows.select(
        *found.columns,
        F.greatest((F.col("__mean") - (k - 1)) / F.col("__d1"), F.lit(0.0)).alias("__w1"), ((F.col("__chi") - F.col("__mean")) / F.col("__d1")).alias("__z1"),
        (F.abs(0.5 - F.col("__rate")) * steps / F.col("__d2")).alias("__w2"),
        (side * (steps * F.col("__rate") - F.col("changes")) / F.col("__d2")).alias("__z2"),
        (F.abs("__usual") * root).alias("__w3"), (sign * (F.col("__own") - F.col("__usual")) * root).alias("__z3"),
    )
    w, z = [F.col(f"__w{i}") for i in (1, 2, 3)], [F.col(f"__z{i}") for i in (1, 2, 3)]
    rows = rows.select(
        *found.columns, F.sqrt(w[0] * w[0] + w[1] * w[1] + w[2] * w[2] + 1e-12).alias("far"), (w[0] * z[0] + w[1] * z[1] + w[2] * z[2]).alias("__sum")
    )
    # combined, ordinary strings have mean 0 and random ones -far
    return rows.withColumn("z", F.col("__sum") / F.col("far")).drop("__sum")


#: Lengths from which a class of its own begins.
CLASSES = (16, 20, 24, 32, 48, 64, 128)


def _class() -> Column:
    return F.col("e") * len(CLASSES) + sum(((F.col("n") >= c).cast("int") for c in CLASSES[1:]), F.lit(0))


def ordinary_of(strings: DataFrame) -> list[dict]:
    """The model of ordinary strings from distinct measured candidates, less those that lie nearer to random ones.

    The reference model tells first which those are; what it keeps makes the model.
    """
    return ordinary_model(scored(strings, ordinary_model(None)).filter(_ordinary()).select("text"))


def _spread(each: DataFrame) -> list[tuple[float, float]]:
    """Place and spread of ordinary strings for every encoding and length class (one row for each is fetched).

    `each` holds distinct scored strings, of which those nearer to random ones are left out. Each class takes its own
    quartiles and lower tail, and the usual spread, which counts as `REFERENCE_STRINGS` strings, at any number; a class whose middle
    lies nearer to random strings keeps the usual one.
    """
    quartiles = F.percentile_approx("z", [0.25, 0.5, 0.75, 0.05, 0.01], 10_000).alias("q")
    classes = each.filter(_ordinary()).groupBy(_class().alias("c")).agg(F.count(F.lit(1)).alias("n"), quartiles, F.avg("far").alias("far"))
    out = [(0.0, USUAL_SPREAD)] * (len(ENCODINGS) * len(CLASSES))
    for r in classes.collect():
        if r.q[1] > -r.far / 2:
            # the tail towards random strings may be longer than the middle tells
            own = max(1.0, (r.q[2] - r.q[0]) / 1.349, (r.q[1] - r.q[3]) / 1.645, (r.q[1] - r.q[4]) / 2.326)
            share = r.n / (r.n + REFERENCE_STRINGS)
            out[r.c] = (share * r.q[1], math.sqrt(share * own**2 + (1 - share) * USUAL_SPREAD**2))
    return out


def judged(found: DataFrame, spread: list[tuple[float, float]]) -> DataFrame:
    """Adds to scored candidates the p-value `p` and the `power` of the test at their length and encoding."""
    classes = _table(found.sparkSession, "__class", __place=[s[0] for s in spread], __width=[s[1] for s in spread])
    rows = found.withColumn("__class", _class()).join(classes, "__class")
    place, width = F.col("__place"), F.col("__width")
    return rows.withColumns({
        "p": lower_tail((F.col("z") - place) / width), "power": lower_tail((F.col("far") + place) / width - 3.0)
    }).drop("__class", "__place", "__width")


def random_spans(rows: DataFrame, rate: float = RATE) -> DataFrame | None:
    """(__row, spans) of the candidates told from ordinary strings; None if there are no candidates. Runs jobs."""
    found = stored(measured(rows), "secret-strings")
    strings = stored(found.drop("__row", "start").dropDuplicates(["text"]), "secret-kinds")
    model = ordinary_of(strings)
    spread = _spread(scored(strings, model))
    kept = ("__row", "start", "n", "p", "power")
    each = stored(judged(scored(found, model), spread).select(*kept, _may_be_random().alias("random")), "secret-chances")
    mean, m = each.agg(F.avg("power"), F.count(F.lit(1))).first()
    if not m:
        return None
    weighed = F.least(F.col("p") * F.lit(float(mean)) / F.greatest("power", F.lit(1e-300)), F.lit(1.0))
    each = each.withColumn("bin", F.floor(-F.log10(F.greatest(weighed, F.lit(1e-300))) * BINS))
    held = {r.bin: r.n for r in each.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).collect()}
    limit, rank = 10**9, 0
    for b in sorted(held, reverse=True):
        rank += held[b]
        if m * 10 ** (-b / BINS) <= rate * rank:
            limit = b
    span = F.struct("start", F.lit(3).alias("kind"), (F.col("start") + F.col("n")).alias("end"))
    return each.filter(F.col("random") & (F.col("bin") >= limit)).groupBy("__row").agg(F.collect_list(span).alias("__extra"))


def scan(df: DataFrame, text: str = "text", rate: float = RATE) -> DataFrame:
    """Adds `secrets`: array<struct<start, kind, end>> by start and kind; kind is a place in `KINDS`.

    The rows are written once to the shared folder with what the patterns find. Candidates go on as rows of their own,
    without the text they stand in; only rows that have any meet the spans found.
    """
    plain = df.drop("secrets")
    rows = stored(candidates(plain, text), "secret-candidates")
    spans = random_spans(rows, rate)
    own = [F.col(f"`{c}`") for c in plain.columns]
    if spans is None:
        return rows.select(*own, F.col("__base").alias("secrets"))
    asked = rows.filter(F.size("__outside") > 0).join(spans, "__row", "left")
    extra = F.coalesce("__extra", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))
    return asked.select(*own, F.array_sort(F.concat("__base", extra)).alias("secrets")).unionByName(
        rows.filter(F.size("__outside") == 0).select(*own, F.col("__base").alias("secrets"))
    )


def spelled(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced by a mark; spans that touch share one."""
    reached = running(F.transform(spans, lambda s: s["end"].cast("long")), lambda x, y: F.greatest(x, y))
    before = F.concat(F.array(F.lit(0).cast("long")), reached)
    pairs = F.zip_with(spans, F.slice(before, F.lit(1), F.size(spans)), lambda s, b: F.struct(s["start"].alias("start"), b.alias("from"), (b == 0).alias("first")))
    pieces = F.transform(pairs, lambda p: F.concat(
        F.substring(text, (p["from"] + 1).cast("int"), F.greatest(p["start"] - p["from"], F.lit(0)).cast("int")),
        F.when((p["start"] > p["from"]) | p["first"], F.lit(mark)).otherwise(""),
    ))
    rest = F.substring(text, (F.element_at(reached, -1) + 1).cast("int"), F.length(text))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(pieces, ""), rest))


def report(df: DataFrame) -> DataFrame:
    """Per document the numbers of pattern matches, the hash of their spans, and all spans."""
    found = scan(df.select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind"] < 3)
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("secrets")).alias("spans"),
        count(3).alias("n_random"),
    )
