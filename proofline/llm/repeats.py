"""Removal of byte strings that occur more than once, with longest-previous-factor arrays over parts of a suffix order.

A string of `LENGTH` bytes is repeated if it also starts somewhere else, in the
same document or another. Which strings may be repeated is found by content:
of the 32-byte pieces inside it, the one with the smallest hash is its anchor,
so equal strings have equal anchors at equal distances. An anchor is taken
together with the 184 bytes that must follow or precede it in the string, and
only such pieces that occur twice go on. Around each, the document's part that
holds the strings of this anchor is cut out as a context.

Equal contexts are counted; they are repeated as a whole. Contexts that differ
but share an anchor are put into suffix order by prefix doubling up to `LENGTH`
bytes. Elements with equal ranks are ordered by place, so the previous smaller
place of an element is the one before it with the same rank, and where there is
none its longest previous factor is shorter than `LENGTH`; likewise for the next
smaller place. A group of more than `GROUP_LIMIT` contexts is halved first: the
strings that start in one half of the distances to the anchor share more bytes,
which are the key of smaller groups. Equal halves become one, halves that stand
alone go, and a half whose group is still too large is halved again, down to one
start, where the key is the string.

With `keep_first`, bytes covered by a string that occurs earlier (by smallest
document id, then place) go and the first occurrence stays; without it every
occurrence goes. Texts are the unit: rows with equal texts share one result. A
missing text is empty; a missing id comes last. With `keep_first` rows with the
same id and text count as one document. Other columns are not read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.llm.common import slices, small_batches, stored, text_of

LENGTH = 400
PIECE = 32
HALF = (LENGTH - PIECE) // 2
GROUP_LIMIT = 2048
#: Bytes of contexts that are put into suffix order at a time, or one group if that is larger.
SORTED = 1_000_000
LAST = (1 << 63) - 1
_FACTOR = 0x9E3779B97F4A7C15

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the pieces that start at each place."""
    out, length, factor = data.astype(np.uint64) + np.uint64(1), 1, _FACTOR
    with np.errstate(over="ignore"):
        while length < PIECE:
            out = out[:-length] * np.uint64(factor) + out[length:]
            factor = factor * factor % (1 << 64)
            length *= 2
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the anchor, first and last start of its strings) for all strings of documents that lie back to back."""
    if len(data) < LENGTH:
        return (np.empty(0, np.int64),) * 3
    window = LENGTH - PIECE + 1
    low = np.uint64(0xFFFFFFFF)
    least = (_hashes(data) & ~low) | np.arange(len(data) - PIECE + 1, dtype=np.uint64)
    width = 1
    while width * 2 <= window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < window:
        least = np.minimum(least[: len(least) - (window - width)], least[window - width :])
    place = (least & low).astype(np.int64)
    starts = np.arange(len(place))
    document = np.searchsorted(ends, starts, side="right")
    whole = starts + LENGTH <= ends[np.minimum(document, len(ends) - 1)]
    # A string across two documents is no string of either.
    change = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (whole[1:] != whole[:-1]) | (document[1:] != document[:-1])])
    last = np.r_[change[1:], len(place)] - 1
    kept = whole[change]
    return place[change[kept]], change[kept], last[kept]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) to (hash, key, begin, span, shift): anchors with the half that must go with them."""
    import xxhash

    names = ["hash", "key", "begin", "span", "shift"]

    def rows(texts: list[bytes], offset: int = 0) -> tuple[list, ...]:
        joined = b"".join(texts)
        ends = np.cumsum([len(t) for t in texts])
        hashes, document, begin, span, shift = [], [], [], [], []
        place, first, last = anchors(np.frombuffer(joined, dtype=np.uint8), ends)
        owner = np.searchsorted(ends, first, side="right")
        base = ends - [len(t) for t in texts]
        for p, a, b, d, o in zip(place.tolist(), first.tolist(), last.tolist(), owner.tolist(), base[owner].tolist(), strict=True):
            if a <= p - HALF:
                hashes.append(xxhash.xxh64_intdigest(joined[p - HALF : p + PIECE], 1))
                document.append(d), begin.append(a - o + offset), span.append(min(b, p - HALF) - a + 1), shift.append(p - a)
            if b > p - HALF:
                start = max(a, p - HALF + 1)
                hashes.append(xxhash.xxh64_intdigest(joined[p : p + PIECE + HALF], 2))
                document.append(d), begin.append(start - o + offset), span.append(b - start + 1), shift.append(p - start)
        return hashes, document, begin, span, shift

    for batch in slices(batches, "text", 2_000_000):
        texts = [v.as_buffer().to_pybytes() for v in batch.column(1)]
        parts = [(rows(texts), None)] if len(texts) > 1 else [
            (rows([texts[0][at : at + 4_000_000 + LENGTH - 1]], at), 0) for at in range(0, max(1, len(texts[0])), 4_000_000)
        ]
        for (hashes, document, begin, span, shift), _ in parts:
            keys = batch.column(0).take(pa.array(document, pa.int32()))
            found = np.array(hashes, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found), keys, *(pa.array(x, pa.int32()) for x in (begin, span, shift))], names
            )


def _parts(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """Contexts of the anchors of each text; `whole` gives their bytes, each context once a task, else a row for each."""
    import xxhash

    seen: set[bytes] = set()
    for batch in slices(batches, "text", 1_000_000):
        out: list[tuple] = []
        for key, text, first, found in zip(*(batch.column(n).to_pylist() for n in ("key", "text", "first", "anchors")), strict=True):
            for a in found:
                begin, span, shift = a["begin"], a["span"], a["shift"]
                part = text[begin : begin + span - 1 + LENGTH]
                digest = xxhash.xxh3_128_digest(part, shift)
                if not whole:
                    out.append((a["hash"], digest, key, first, begin, len(part)))
                elif (mark := digest + a["hash"].to_bytes(8, "big", signed=True)) not in seen:
                    seen.add(mark)
                    out.append((a["hash"], digest, shift, part))
            if len(seen) > 500_000:  # a matter of memory only: a context may then go out again
                seen.clear()
        columns = list(zip(*out, strict=True)) if out else [()] * (4 if whole else 6)
        if whole:
            kinds = (pa.int64(), pa.binary(), pa.int32(), pa.binary())
            names = ["hash", "digest", "shift", "part"]
        else:
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int32())
            names = ["hash", "digest", "key", "first", "begin", "size"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order, rank and size of the class of each of the keys."""
    order = np.argsort(keys, kind="stable")
    new = np.r_[True, keys[order][1:] != keys[order][:-1]]
    rank = np.empty(len(keys), dtype=np.int64)
    rank[order] = new.cumsum() - 1
    return order, rank, np.bincount(rank)[rank]


def equal_strings(data: np.ndarray, begin: np.ndarray, size: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks by the first `LENGTH` bytes, in suffix order, of the places that share them with another of their kind.

    Contexts lie in `data` from `begin` on, `size` bytes each; `kind` is given for every byte of the data.
    """
    context = np.repeat(np.arange(len(begin)), size)
    room = (begin + size)[context] - np.arange(len(data))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    word = np.zeros(len(data), dtype=np.uint64)
    for step in range(8):
        word = (word << np.uint64(8)) | padded[step : step + len(data)]
    alive = np.flatnonzero(room >= 8)
    _, by_kind, _ = _ranked(kind[alive])
    _, by_word, _ = _ranked(word[alive])
    _, rank, count = _ranked(by_kind * (by_word.max(initial=0) + 1) + by_word)
    full = np.full(len(data), -1, dtype=np.int64)
    length = 8
    while True:
        full[:] = -1
        alive, rank = alive[count > 1], rank[count > 1]
        full[alive] = rank
        if length == LENGTH or not len(alive):
            return alive, rank
        step = min(length, LENGTH - length)
        fits = room[alive] >= length + step
        alive, rank = alive[fits], rank[fits]
        other = full[alive + step]
        met = other >= 0  # a place whose follower stands alone stands alone itself
        alive, rank, other = alive[met], rank[met], other[met]
        _, rank, count = _ranked(rank * (other.max(initial=0) + 1) + other)
        length += step


def _factors(places: np.ndarray, ranks: np.ndarray, keep_first: bool) -> np.ndarray:
    """Which of the ranked places have an earlier match (or any, unless `keep_first`), by previous and next smaller places.

    `places` gives the order of occurrence. Within a rank the elements are taken in that order.
    """
    order = np.lexsort((places, ranks))
    same = ranks[order][1:] == ranks[order][:-1]
    earlier = np.r_[False, same & (places[order][1:] != places[order][:-1])]
    later = np.r_[same, False]
    found = np.zeros(len(ranks), dtype=bool)
    found[order] = earlier if keep_first else earlier | later
    return found


def _covered(starts: np.ndarray) -> list[tuple[int, int]]:
    """Ranges covered by strings that start at these places (sorted)."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > LENGTH)
    return list(zip(starts[np.r_[0, cut + 1]].tolist(), (starts[np.r_[cut, len(starts) - 1]] + LENGTH).tolist(), strict=True))


def _matched(keep_first: bool):
    """Rows (hash, digest, start, part, first, at) sorted by hash and digest, to the repeated ranges (hash, digest, low, high)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["hash", "digest", "low", "high"]
        kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int32())

        def sort(groups: list[list[tuple]]) -> pa.RecordBatch:
            groups = [g for g in groups if len(g) > 1]
            rows = [r for g in groups for r in g]
            made: list[tuple] = []
            if rows:
                group = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
                size = np.array([len(r[3]) for r in rows])
                begin = np.r_[0, size.cumsum()[:-1]]
                start = np.array([r[2] for r in rows])
                within = np.arange(size.sum()) - np.repeat(begin, size)
                kind = np.repeat(group, size) * 4096 + within + np.repeat(start, size) + 1024
                alive, rank = equal_strings(np.frombuffer(b"".join(r[3] for r in rows), dtype=np.uint8), begin, size, kind)
                # contexts in the order in which they occur first
                occurrence = np.empty(len(rows), dtype=np.int64)
                occurrence[sorted(range(len(rows)), key=lambda i: (rows[i][4], rows[i][5]))] = np.arange(len(rows))
                context = np.searchsorted(begin, alive, side="right") - 1
                found = _factors(occurrence[context], rank, keep_first)
                places = np.sort(alive[found])
                owner = np.searchsorted(begin, places, side="right") - 1
                edges = np.r_[np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]), len(owner)] if len(owner) else np.zeros(1, np.int64)
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    i = owner[a]
                    made += [(rows[i][0], rows[i][1], low, high) for low, high in _covered(places[a:b] - begin[i])]
            columns = list(zip(*made, strict=True)) if made else [()] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        ready: list[list[tuple]] = []
        held, group = 0, []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if group and row[0] != group[0][0]:
                    ready.append(group)
                    group = []
                    if held > SORTED:
                        yield sort(ready)
                        ready, held = [], 0
                if group and row[1] == group[-1][1]:
                    continue
                group.append(row)
                held += len(row[3])
        if group:
            ready.append(group)
        if ready:
            yield sort(ready)

    return run


def _halves(groups: DataFrame) -> DataFrame:
    """Contexts (hash, digest, low, high, start, part, first, at) cut in two by the starts of their strings.

    `low` to `high` are the starts that a group takes in, as distances to the anchor, and `start` is the first one of the
    context. Gives (hash, digest, offset) of the context, with the same facts of its half: `h` is the key of the bytes that
    all strings of the half share, `d` names the half by its bytes and start.
    """
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    sides = F.array(F.struct(F.col("low").alias("a"), middle.alias("b")), F.struct((middle + 1).alias("a"), F.col("high").alias("b")))
    last = F.col("start") + F.length("part") - LENGTH
    cut = groups.select("*", F.explode(sides).alias("s")).withColumn("from", F.greatest("start", "s.a")).withColumn("to", F.least(last, F.col("s.b")))
    cut = cut.filter("from <= to").withColumn("offset", F.col("from") - F.col("start"))
    shared = F.substring("part", F.col("s.b") - F.col("start") + 1, F.col("s.a") + LENGTH - F.col("s.b"))
    half = F.substring("part", F.col("offset") + 1, F.col("to") - F.col("from") + LENGTH)
    name = F.concat(half, F.encode(F.lpad((F.col("from") + 1000).cast("string"), 4, "0"), "UTF-8"))
    return cut.select(
        "hash", "digest", "offset", F.xxhash64("hash", "s.a", shared).alias("h"), F.unhex(F.md5(name)).alias("d"),
        F.col("s.a").alias("low"), F.col("s.b").alias("high"), F.col("from").alias("start"), half.alias("part"), "first", "at",
    )


def _sized(contexts: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Contexts of groups that fit a task, and of those to be halved; groups of one are in neither."""
    sizes = contexts.groupBy("hash").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select(_other("hash").alias("o"), "kinds")
    met = contexts.withColumn("o", _other("hash")).join(sizes, "o").drop("o")
    large = (F.col("kinds") > limit) & (F.col("low") < F.col("high"))
    return met.filter(~large).drop("kinds"), met.filter(large).drop("kinds")


def _ranges(contexts: DataFrame, keep_first: bool, limit: int) -> DataFrame:
    """Repeated ranges (hash, digest, low, high) of distinct contexts that share an anchor with others."""
    contexts = stored(contexts, "repeat-unequal")
    levels: list[tuple[DataFrame, DataFrame]] = []
    fits, large = _sized(contexts, limit)
    small = [fits]
    # at most as many rounds as a group's starts can be halved
    while not large.isEmpty():
        halves = stored(_halves(large), f"repeat-halves-{len(levels)}")
        own = F.struct("first", "at", "digest")
        distinct = halves.groupBy("h", "d").agg(
            F.count(F.lit(1)).alias("n"), F.min(own).alias("place"), *(F.first(c).alias(c) for c in ("low", "high", "start", "part"))
        )
        distinct = stored(distinct, f"repeat-distinct-{len(levels)}")
        levels.append((halves, distinct))
        fits, large = _sized(
            distinct.select(F.col("h").alias("hash"), F.col("d").alias("digest"), "low", "high", "start", "part", "place.first", "place.at"), limit
        )
        small.append(fits)
    fitting = small[0]
    for fits in small[1:]:
        fitting = fitting.unionByName(fits)
    fitting = fitting.select("hash", "digest", "start", "part", "first", "at").repartition("hash").sortWithinPartitions("hash", "digest")
    found = stored(fitting.mapInArrow(_matched(keep_first), "hash long, digest binary, low int, high int"), "repeat-matched")
    # what is found for a half holds for the contexts it was cut from; a half of several contexts is repeated as a whole
    for halves, distinct in reversed(levels):
        several = halves.join(distinct.filter("n > 1").select("h", "d", "place"), ["h", "d"])
        if keep_first:
            several = several.filter(F.struct("first", "at", "digest") != F.col("place"))
        whole = several.select("hash", "digest", F.col("offset").alias("low"), (F.col("offset") + F.length("part")).alias("high"))
        inside = halves.select("hash", "digest", "offset", "h", "d").join(
            found.select(F.col("hash").alias("h"), F.col("digest").alias("d"), "low", "high"), ["h", "d"]
        ).select("hash", "digest", (F.col("low") + F.col("offset")).alias("low"), (F.col("high") + F.col("offset")).alias("high"))
        found = found.unionByName(whole).unionByName(inside)
    return found


def _other(column: str) -> Column:
    """Another key for the same values. A side that was just grouped by a column moves again for a join by this one, so that
    Spark can split the join where a value is hot."""
    return F.col(column).bitwiseXOR(F.lit(1))


def repeats(df: DataFrame, keep_first: bool = False, id_column: str = "doc_id", text: str = "text", limit: int = GROUP_LIMIT) -> DataFrame:
    """Stored table (key, text, copies, first, spans) of the texts in which strings of `LENGTH` bytes are repeated.

    `key` is the MD5 of the text, `copies` counts its rows, `first` is its smallest id, `spans` are the ranges covered by
    repeated strings of one copy of the text, in no order and overlapping. Copies of a text are the caller's to count.
    """
    small_batches(df.sparkSession)
    body = F.encode(text_of(f"`{text}`"), "UTF-8")
    docs = df.select(
        F.unhex(F.md5(body)).alias("key"), body.alias("text"), F.coalesce(F.col(f"`{id_column}`").cast("long"), F.lit(LAST)).alias("first")
    ).filter(F.length("text") >= LENGTH)
    pieces = stored(docs.select("key", "text").mapInArrow(_pieces, "hash long, key binary, begin int, span int, shift int"), "repeat-pieces")
    place = F.xxhash64("key", "begin")
    twice = pieces.groupBy("hash").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter("a != b").select(_other("hash").alias("h"))
    wanted = (
        pieces.withColumn("h", _other("hash")).join(twice, "h", "left_semi")
        .groupBy("key").agg(F.collect_set(F.struct("hash", "begin", "span", "shift")).alias("anchors"))
    )
    texts = docs.groupBy("key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"), F.min("first").alias("first"))
    texts = stored(texts.join(wanted, "key"), "repeat-texts")

    members = stored(
        texts.mapInArrow(lambda b: _parts(b, False), "hash long, digest binary, key binary, first long, begin int, size int"), "repeat-members"
    )
    contexts = members.groupBy("hash", "digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("first", "begin")).alias("place"))
    contexts = stored(contexts, "repeat-contexts")
    several = contexts.groupBy("hash").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select(_other("hash").alias("h"))
    unequal = contexts.withColumn("h", _other("hash")).join(several, "h", "left_semi").select("hash", "digest", "place.first", "place.begin")
    parts = texts.mapInArrow(lambda b: _parts(b, True), "hash long, digest binary, shift int, part binary")
    parts = parts.join(unequal, ["hash", "digest"]).dropDuplicates(["hash", "digest"])
    before = F.col("shift") >= HALF
    ranges = _ranges(parts.select(
        "hash", "digest", F.when(before, F.lit(PIECE - LENGTH)).otherwise(F.lit(1 - HALF)).alias("low"),
        F.when(before, F.lit(-HALF)).otherwise(F.lit(0)).alias("high"),
        (-F.col("shift")).alias("start"), "part", "first", (F.col("begin") + F.col("shift")).alias("at"),
    ), keep_first, limit)
    by_context = ranges.groupBy("hash", "digest").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    known = contexts.join(by_context, ["hash", "digest"], "left").filter("n > 1 or ranges is not null")
    known = known.select(_other("hash").alias("h"), F.concat("digest", F.lit(b"")).alias("g"), "n", "place", "ranges")
    own = members.join(known, (_other("hash") == F.col("h")) & (F.col("digest") == F.col("g")))
    whole = F.array(F.struct(F.lit(0).alias("low"), F.col("size").alias("high")))
    all_of_it = F.struct("first", "begin") != F.col("place") if keep_first else F.col("n") > 1
    spans = F.transform(
        F.when(all_of_it, whole).otherwise(F.coalesce("ranges", F.array().cast("array<struct<low:int,high:int>>"))),
        lambda r: F.struct((r["low"] + F.col("begin")).alias("low"), (r["high"] + F.col("begin")).alias("high")),
    )
    found = own.select("key", F.explode(spans).alias("span")).groupBy("key").agg(F.collect_set("span").alias("spans"))
    return texts.drop("anchors").join(found, "key")


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted((s["low"], s["high"]) for s in spans):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def cut(found: DataFrame) -> DataFrame:
    """(key, copies, first, spans, kept): the texts of `repeats` with merged spans, and the bytes that remain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2_000_000):
            spans = [merged(s) for s in batch.column("spans").to_pylist()]
            kept = []
            for text, own in zip(batch.column("text"), spans, strict=True):
                data, at, left = text.as_buffer().to_pybytes(), 0, []
                for low, high in own:
                    left.append(data[at:low])
                    at = high
                kept.append(b"".join([*left, data[at:]]))
            kind = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))
            rows = [[{"low": a, "high": b} for a, b in own] for own in spans]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in ("key", "copies", "first")), pa.array(rows, kind), pa.array(kept, pa.binary())],
                ["key", "copies", "first", "spans", "kept"],
            )

    schema = "key binary, copies long, first long, spans array<struct<low:int,high:int>>, kept binary"
    return found.select("key", "text", "copies", "first", "spans").mapInArrow(run, schema)


def report(df: DataFrame, keep_first: bool = False) -> DataFrame:
    """Per document its bytes, the bytes and runs removed, and the hash of what remains."""
    body = F.encode(text_of(), "UTF-8")
    rows = df.select(
        "doc_id", F.unhex(F.md5(body)).alias("key"), F.length(body).cast("long").alias("n_bytes"), F.sha2(body, 256).alias("own_sha256")
    )
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["high"] - s["low"])
    found = cut(repeats(df, keep_first)).select(
        F.concat("key", F.lit(b"")).alias("k"), removed.alias("some"), F.size("spans").cast("long").alias("runs"), F.sha2("kept", 256).alias("sha")
    )
    copies = rows.filter(F.col("n_bytes") >= LENGTH).groupBy("key").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))).alias("first")
    ).select(F.concat("key", F.lit(b"")).alias("k"), "copies", "first")
    facts = copies.join(found, "k", "left").filter("copies > 1 or some is not null").withColumnRenamed("k", "m")
    met = rows.join(facts.withColumn("m", F.concat("m", F.lit(b""))), F.col("key") == F.col("m"), "left")
    again = F.coalesce(F.col("copies") > 1, F.lit(False))
    if keep_first:
        again = again & (F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)) != F.col("first"))
    return met.select(
        "doc_id", "n_bytes",
        F.when(again, F.col("n_bytes")).otherwise(F.coalesce("some", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(again, F.lit(1).cast("long")).otherwise(F.coalesce("runs", F.lit(0).cast("long"))).alias("n_spans"),
        F.when(again, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("sha", "own_sha256")).alias("kept_sha256"),
    )
