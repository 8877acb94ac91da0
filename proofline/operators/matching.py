"""Similarity joins: ids against known ids, texts against applications, messages against files."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline import constants as K
from proofline.functions.similarity import (
    BY_STRETCH, LONGER, MUCH_LONGER, indel_ratio, levenshtein_ratio, partial_ratio, weighted_ratio,
)
from proofline.functions.text import fold_text, has_text, plain_letters
from proofline.session import scratch


#: Beyond the letters of a text, so that its ends make grams of their own.
_BEGIN, _END = "\u0001", "\u0002"
#: Grams that a stretch must share among the rarest of the shorter text; asked for only where so many must be left.
SHARED = 3


def _gram_size(cut: float, metric: str) -> int:
    """Letters of a gram: as many as leave a good part of a text's grams whole at this score."""
    lost = 1 - cut / 100.0
    if metric == "levenshtein":
        return max(1, min(4, int(0.7 / lost))) if lost > 0 else 4
    return max(1, min(3, int(0.36 / lost))) if lost > 0 else 3


def _least_common(a: Column, b: Column, cut: float) -> Column:
    """Least length of the longest common subsequence of two texts of these lengths with an indel score of `cut`."""
    return F.ceil((a + b) * (cut / 200.0) - 1e-9).cast("int")


def _broken(own: Column, other: Column, cut: float, metric: str, q: int) -> Column:
    """Most grams of a text of length `own` that a partner of length `other` at score `cut` may lack.

    A letter gone breaks q grams; one put in breaks q - 1. A Levenshtein edit breaks q.
    """
    if metric == "levenshtein":
        return F.floor(F.greatest(own, other) * (1 - cut / 100.0) + 1e-9).cast("int") * q
    common = _least_common(own, other, cut)
    return (own - common) * q + (other - common) * (q - 1)


def _shift(own: Column, other: Column, cut: float, metric: str) -> tuple[Column, Column]:
    """Least and most that a shared gram may stand further on in the other text."""
    if metric == "levenshtein":
        edits = F.floor(F.greatest(own, other) * (1 - cut / 100.0) + 1e-9).cast("int")
        return -edits, edits
    common = _least_common(own, other, cut)
    return common - own, other - common


def _grams(texts: DataFrame, q: int, ends: bool) -> DataFrame:
    """(text, whole, size, place, gram): every gram of `form`, with those over its ends or without. Hashes, so rows stay small."""
    padded = F.concat(F.lit(_BEGIN * (q - 1)), F.col("form"), F.lit(_END * (q - 1))) if ends else F.col("form")
    last = F.length(padded) - (q - 1)
    places = F.sequence(F.lit(1), last) if ends else F.when(last > 0, F.sequence(F.lit(1), last))
    return texts.select("text", "whole", "form", F.length("form").alias("size"), padded.alias("padded"), F.explode(places).alias("place")).select(
        "text", "whole", "form", "size", "place", F.xxhash64(F.expr(f"substring(padded, place, {q})")).alias("gram")
    )


def _ranked(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """Adds the place of each gram of a form when the rarest come first; `seen` has the number of each gram."""
    order = Window.partitionBy("text", "form").orderBy(F.coalesce("n", F.lit(0)), "gram", "place")
    return rows.join(seen, "gram", "left").withColumn("rank", F.row_number().over(order)).drop("n")


def _renamed(rows: DataFrame, side: str) -> DataFrame:
    return rows.select("gram", *[F.col(c).alias(f"{side}_{c}") for c in rows.columns if c != "gram"])


def _by_grams(left: DataFrame, right: DataFrame, cut: float, metric: str, guard: Column | None = None) -> DataFrame:
    """(id, known) of every pair whose forms may reach the score: those that share one of their rarest grams, in place.

    The grams of all texts are ordered from the rarest to the most frequent. If a partner may lack d grams of a text,
    then it has one of its first d + 1 grams in that order, at a place that differs by no more than the edits allow;
    the same holds the other way round. So only these meet, and each text has no more rows than letters and ends. What
    meets must be within as many Levenshtein edits as the score leaves, of which there are never more than of others.
    """
    q = _gram_size(cut, metric)
    share = cut / 100.0
    reach = (2 - share) / share if metric == "indel" else 1 / share

    def side(texts: DataFrame, seen: DataFrame, name: str) -> DataFrame:
        size = F.col("size")
        if metric == "indel":
            # the most that any partner may lack: the longest partner leaves the most letters to put in
            longest = F.floor(size * reach + 1e-9).cast("int")
            most = F.greatest(_broken(size, longest, cut, metric, q), _broken(size, F.ceil(size / reach - 1e-9).cast("int"), cut, metric, q), _broken(size, size, cut, metric, q)) + q
        else:
            most = _broken(size, F.floor(size / share + 1e-9).cast("int"), cut, metric, q)
        return _renamed(_ranked(_grams(texts, q, True), seen).where(F.col("rank") <= most + 1), name)

    every = _grams(left, q, True).select("gram").unionByName(_grams(right, q, True).select("gram"))
    seen = every.groupBy("gram").agg(F.count("*").alias("n"))
    mine, theirs = side(left, seen, "a"), side(right, seen, "b")
    a, b = F.col("a_size"), F.col("b_size")
    low, high = _shift(a, b, cut, metric)
    lack_a, lack_b = _broken(a, b, cut, metric, q), _broken(b, a, cut, metric, q)
    met = mine.join(theirs, "gram").where(
        (F.greatest(a, b) <= F.least(a, b) * reach + 1e-9) & (F.col("b_place") - F.col("a_place")).between(low, high)
        & (F.col("a_rank") <= lack_a + 1) & (F.col("b_rank") <= lack_b + 1)
    )
    if guard is not None:
        met = met.where(guard)
    size = F.length("a_form") + F.length("b_form") if metric == "indel" else F.greatest(F.length("a_form"), F.length("b_form"))
    near = F.levenshtein("a_form", "b_form") <= F.floor(size * (1 - share) + 1e-9)
    return met.select("a_text", "b_text", "a_form", "b_form").distinct().where(near).select(
        F.col("a_text").alias("id"), F.col("b_text").alias("known")
    )


def _by_stretches(left: DataFrame, right: DataFrame, cut: float, most: float, single: bool) -> DataFrame:
    """(id, known) of every pair in which a stretch of the longer form may score `cut` with the shorter, by the rarest grams of the shorter one.

    A stretch has no ends, so grams lie inside. Texts are apart by at least `LONGER` and at most `most` times. `single`
    tells that a form may be one letter, which has no gram.
    """
    lost = 1 - cut / 100.0
    q = 2
    # either letters only go, from a stretch at an end, or as many are put in
    broken = max(q * 2 * lost / (1 + lost), (2 * q - 1) * lost)

    def lack(size: Column) -> Column:
        return F.floor(size * broken + 1e-9).cast("int")

    every = _grams(left, q, False).select("gram").unionByName(_grams(right, q, False).select("gram"))
    seen = every.groupBy("gram").agg(F.count("*").alias("n"))
    mine, theirs = (_renamed(_ranked(_grams(t, q, False), seen), n) for t, n in ((left, "a"), (right, "b")))
    a, b, wa, wb = (F.col(c) for c in ("a_size", "b_size", "a_whole", "b_whole"))
    apart = F.greatest(wa, wb).between(F.least(wa, wb) * LONGER - 1e-9, F.least(wa, wb) * most + 1e-9)
    rare = ((a <= b) & (F.col("a_rank") <= lack(a) + SHARED)) | ((b <= a) & (F.col("b_rank") <= lack(b) + SHARED))
    short = F.least(a, b)
    least = F.least(short - (q - 1) - lack(short), F.lit(SHARED))
    pairs = mine.join(theirs, "gram").where(apart & rare).groupBy("a_text", "b_text", "a_form", "b_form").agg(
        F.count("*").alias("n"), F.min(least).alias("least")
    ).where("n >= least").select(F.col("a_text").alias("id"), F.col("b_text").alias("known"))

    if not single:
        return pairs

    def letters(texts: DataFrame, name: str, alone: bool) -> DataFrame:
        rows = texts.where("length(form) = 1" if alone else f"whole <= {most}")
        return rows.select(F.col("text").alias(name), F.explode(F.array_distinct(F.split("form", ""))).alias("letter")).where("letter <> ''")

    return pairs.unionByName(letters(left, "id", True).join(letters(right, "known", False), "letter").select("id", "known")).unionByName(
        letters(right, "known", True).join(letters(left, "id", False), "letter").select("id", "known")
    )


def _forms(texts: DataFrame, words: bool) -> DataFrame:
    """(text, whole, form): the text, and with `words` also all its words in order and its distinct words in order."""
    own = texts.select("text", F.length("text").alias("whole"))
    if not words:
        return own.withColumn("form", F.col("text"))
    split = F.array_sort(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    forms = F.array_distinct(F.array(
        F.col("text"), F.array_join(split, " "), F.array_join(F.array_distinct(split), " ")
    ))
    return own.withColumn("form", F.explode(forms)).where("form <> ''")


def _by_words(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, known) of every pair that shares a word, where one has several."""
    def words(texts: DataFrame, name: str, several: bool | None) -> DataFrame:
        split = F.array_distinct(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
        many = F.col("text").rlike(r"\s")
        rows = texts if several is None else texts.where(many if several else ~many)
        return rows.select(F.col("text").alias(name), F.explode(split).alias("word"))

    return words(left, "id", True).join(words(right, "known", None), "word").select("id", "known").unionByName(
        words(left, "id", False).join(words(right, "known", True), "word").select("id", "known")
    )


def _stored_texts(rows: DataFrame, label: str) -> DataFrame:
    """The distinct texts of the first column, as `text`, written once: whatever made them is not planned again."""
    path = scratch(rows.sparkSession, label)
    texts = rows.select(F.col(rows.columns[0]).cast("string").alias("text")).where("text IS NOT NULL AND text <> ''").distinct()
    texts.write.parquet(path)
    return rows.sparkSession.read.schema(texts.schema).parquet(path)


def similar_pairs(ids: DataFrame, known: DataFrame, cut: float, metric: str = "levenshtein") -> DataFrame:
    """(id, known, score) of every distinct pair with a score of at least `cut`, exactly.

    `metric` is "levenshtein", "indel" or "weighted" (see `weighted_ratios`). Candidates come from equality joins on
    the rarest grams of each text, one row for each letter at most, and are then scored; texts of several words meet
    on a shared word, too. Runs a job: the distinct texts of both sides are stored first, as they are read several
    times. Bars are 40 or more for Levenshtein, 50 for indel, 81 for the weighted score. A text that
    repeats one letter as its only word is compared with texts of up to eight letters.
    """
    least = {"levenshtein": 40, "indel": 50, "weighted": 81}[metric]
    if not least <= cut <= 100:
        raise ValueError(f"a {metric} bar is from {least} to 100")
    left, right = _stored_texts(ids, "ids"), _stored_texts(known, "known")
    if metric != "weighted":
        met = _by_grams(_forms(left, False), _forms(right, False), cut, metric)
        score = indel_ratio if metric == "indel" else levenshtein_ratio
    else:
        # ways that these texts cannot meet are left out of the plan
        spaced, shortest, longest = left.unionByName(right).agg(
            F.coalesce(F.bool_or(F.col("text").rlike(r"\s")), F.lit(False)), F.min(F.length("text")), F.max(F.length("text"))
        ).first()
        mine, theirs = _forms(left, spaced), _forms(right, spaced)
        a, b = F.col("a_whole"), F.col("b_whole")
        met = _by_grams(mine, theirs, cut, "indel", F.greatest(a, b) < F.least(a, b) * LONGER)
        if cut <= 100 * BY_STRETCH and longest is not None and longest >= LONGER * shortest:
            met = met.unionByName(_by_stretches(mine, theirs, cut / BY_STRETCH, MUCH_LONGER, spaced or shortest == 1))
        if spaced:
            met = met.unionByName(_by_words(left, right))
        met = met.distinct()
        score = weighted_ratio
    return met.withColumn("score", score(F.col("id"), F.col("known"))).where(F.col("score") >= cut - 1e-9)


def fuzzy_id_match(
    ids: DataFrame, known: DataFrame, metric: str = "weighted", threshold: float = 88, margin: float = 5, most: int = 3
) -> DataFrame:
    """(id, best_id, best_score, second_score, accepted, needs_review, candidates) of each distinct id.

    The best known id is accepted when it scores at least `threshold` and leads
    the next one by `margin`; too close a race, or a replacement below 97, asks
    for a review. Only ids with some candidate at `threshold` are listed. A
    second score below `threshold - margin` cannot change anything and is null.
    `candidates` has up to `most` (known, score), the best first, of at least
    `threshold - margin`; equal scores go by the known id.

    `metric` is that of `similar_pairs`.
    """
    if metric not in ("weighted", "levenshtein", "indel"):
        raise ValueError("metric is 'weighted', 'levenshtein' or 'indel'")
    pairs = similar_pairs(ids, known, threshold - margin, metric)
    rank = Window.partitionBy("id").orderBy(F.col("score").desc(), F.col("known"))
    top = pairs.withColumn("place", F.row_number().over(rank)).where(F.col("place") <= max(most, 2))
    best = top.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "known", "score"))).alias("found")).select(
        "id", F.col("found")[0]["known"].alias("best_id"), F.col("found")[0]["score"].alias("best_score"),
        F.try_element_at("found", F.lit(2))["score"].alias("second_score"),
        F.transform(F.slice("found", 1, most), lambda c: F.struct(c["known"].alias("known"), c["score"].alias("score"))).alias("candidates"),
    ).where(F.col("best_score") >= threshold)
    clear = F.col("best_score") - F.coalesce("second_score", F.lit(0.0)) >= margin
    return best.select(
        "id", "best_id", "best_score", "second_score", clear.alias("accepted"),
        (~clear | ((F.col("best_id") != F.col("id")) & (F.col("best_score") < 97))).alias("needs_review"), "candidates",
    )


def detect_application(
    texts: DataFrame, applications: Sequence[tuple[str, str, str, Sequence[str]]],
    threshold: float = 70, margin: float = 8, fuzzy: bool = True, column: str = "text",
) -> DataFrame:
    """Adds application_id and detection_score to texts.

    `applications` is the registry, (id, code, name, keywords) each: a short
    configured list, so it becomes part of the expression. A keyword inside the
    text scores 100; with `fuzzy`, near spellings score by an Arrow UDF, for
    texts that do not hold a keyword of the application. The winner needs `threshold` and a lead of `margin` over the next application.
    """
    folded = fold_text(F.col(column))

    def words(app: tuple[str, str, str, Sequence[str]]) -> list[str]:
        return [w for w in (_fold_word(x) for x in (app[2], app[1], *app[3])) if w]

    rows = texts.withColumn("__folded", folded)
    options = []
    for app in applications:
        keywords = words(app)
        if not keywords:
            continue
        inside = reduce(lambda a, b: a | b, [F.col("__folded").contains(w) for w in keywords])
        near = partial_ratio(F.when(~inside, F.col("__folded")), keywords) if fuzzy else F.lit(0.0)
        options.append(F.struct(F.when(inside, 100.0).otherwise(near).alias("score"), F.lit(app[0]).alias("app")))
    ranked = F.sort_array(F.array(*options), asc=False)
    rows = rows.withColumn("__ranked", ranked)
    top = F.col("__ranked")[0]["score"]
    second = F.coalesce(F.try_element_at(F.col("__ranked"), F.lit(2))["score"], F.lit(0.0))
    sure = has_text(F.col("__folded")) & (top >= threshold) & (top - second >= margin)
    return rows.withColumns({
        "application_id": F.when(sure, F.col("__ranked")[0]["app"]),
        "detection_score": F.when(has_text(F.col("__folded")), top).otherwise(0.0),
    }).drop("__folded", "__ranked")


def _fold_word(word: str) -> str:
    return plain_letters(word).lower()


def _global_rank(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Adds the 0-based position in the order, without a single-task window. Runs a job.

    The rows are sorted across tasks and written with their place inside their
    sorted part; the counts of the earlier parts, one row per part, are added.
    Writing the table first keeps parts and places fixed if a task is repeated.
    """
    spark = df.sparkSession
    path = scratch(spark, "ranked")
    df.orderBy(*order).withColumn("__m", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path).withColumns({
        "__part": F.shiftright("__m", 33), "__place": F.col("__m").bitwiseAND((1 << 33) - 1)
    })
    sizes = rows.groupBy("__part").agg(F.count("*").alias("__n"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__skip"))
    return rows.join(sizes, "__part").withColumn(name, F.col("__place") + F.col("__skip")).drop(
        "__m", "__part", "__place", "__skip"
    )


def attach_media(messages: DataFrame, files: DataFrame) -> DataFrame:
    """(message_id, file_name): named attachments by file name, and the n-th unnamed message
    to the n-th file, by name, that no message refers to.

    `messages` has message_id, message_date and media_filename; files has file_name.
    Unnamed messages are ordered by (message_date, message_id).
    """
    named = messages.where(F.col("media_filename") != K.UNNAMED_ATTACHMENT).join(
        files.select(F.col("file_name").alias("media_filename")).distinct(), "media_filename"
    ).select("message_id", F.col("media_filename").alias("file_name"))
    unnamed = messages.where(F.col("media_filename") == K.UNNAMED_ATTACHMENT).select("message_id", "message_date")
    spare = files.select("file_name").distinct().join(
        messages.select(F.col("media_filename").alias("file_name")).where("file_name IS NOT NULL"),
        "file_name", "left_anti",
    )
    asking = _global_rank(unnamed, ["message_date", "message_id"], "n")
    offered = _global_rank(spare, ["file_name"], "n")
    return named.unionByName(asking.join(offered, "n").select("message_id", "file_name"))
