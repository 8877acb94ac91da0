"""Encoding and decoding with a BPE model of lower-case words with word ends, by a contiguous rank array.

A word is held as the boundaries of its parts, their ids, and the rank of each
adjacent pair. The smallest rank is looked for again and again; its inner
boundary is deleted and the ranks of the two neighbours are looked up anew. Equal
ranks go from left to right. Scanning is quadratic, so words of more than
`SHORT` bytes take their pairs from a heap, with the same result.

The model must bring text to NFC and lower case, drop white space, split by a
pattern that never takes white space into a match, and write bytes as letters
(checked when it is loaded). Nothing then reaches across white space, so the
stretches between are encoded on their own and remembered. Stretches with
letters that are newer than this Python's Unicode table are normalised and split
by the library.

Nulls and empty texts have no ids and decode to the empty text. Repeated rows
stay, each with its own ids. Other columns pass through untouched; a column
named like an output is replaced.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofline.llm.common import slices, small_batches

#: Bytes up to which a word is scanned; a matter of speed only.
SHORT = 64
#: Stretches a worker keeps at hand before it lets go of those not met lately; a matter of memory only.
REMEMBERED = 300_000
NONE = 1 << 30
#: Separators that Python's `split` takes for white space and the model does not.
SEPARATORS = re.compile("[\x1c-\x1f]")
SPACE = re.compile("[^\\S\x1c-\x1f]+")
#: Letters whose class and case no longer change from one Unicode version to the next.
PLAIN = re.compile("[\x00-\u0557\u2000-\u2064\u20a0-\u20bf\u2190-\u23ff\u3000-\u303f\u3041-\u3096\u3099-\u30ff\u4e00-\u9fef\uac00-\ud7a3\uff01-\uff5e\U0001f300-\U0001f64f]*")

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Known(dict):
    """Packed ids of stretches met lately; the generation before stays in reach."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, stretch: str) -> bytes:
        ids = self.older.get(stretch)
        if ids is None:
            ids = self.make(stretch)
            if len(stretch) > 64:
                return ids
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[stretch] = ids
        return ids


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it prints, else the next free one from U+0100 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, free = [], 256
    for byte in range(256):
        letters.append(chr(byte if byte in prints else free))
        free += byte not in prints
    return letters


class Codec:
    """The tables of one model: ids of single bytes, ranks of pairs of ids, the id each pair becomes, tokens by id."""

    def __init__(self, model: bytes):
        import regex
        from tokenizers import Tokenizer

        kept = json.loads(model)
        bpe, steps = kept["model"], [s["type"] for s in kept["normalizer"]["normalizers"]]
        split, letters = kept["pre_tokenizer"]["pretokenizers"]
        end = bpe["end_of_word_suffix"]
        if (
            steps != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed" or not split["invert"]
            or letters["type"] != "ByteLevel" or letters["add_prefix_space"] or letters["use_regex"]
            or kept["decoder"] or not end or bpe["continuing_subword_prefix"] or bpe["ignore_merges"] or bpe["dropout"]
        ):
            raise ValueError("the model normalises, splits or joins in another way")
        vocab, alphabet = bpe["vocab"], byte_letters()
        self.inner = [vocab[c] for c in alphabet]
        self.last = [vocab[c + end] for c in alphabet]
        self.rank: dict[int, int] = {}
        self.joined: list[int] = []
        for rank, pair in enumerate(bpe["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[left] << 32 | vocab[right]] = rank
            self.joined.append(vocab[left + right])
        special = {t["content"]: t["id"] for t in kept["added_tokens"]}
        size = max([*vocab.values(), *special.values()]) + 1
        self.token: list[str] = [""] * size
        for text, number in [*vocab.items(), *special.items()]:
            self.token[number] = text
        self.special = special
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.words = regex.compile(split["pattern"]["Regex"]).findall
        self.library = Tokenizer.from_str(model.decode())
        self.known = Known(self.encode_stretch)

    def scanned(self, ids: list[int]) -> list[int]:
        """Ids of a short word: the smallest rank found by scanning the array of ranks."""
        get, joined = self.rank.get, self.joined
        ranks = [get(a << 32 | b, NONE) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            at = ranks.index(least)
            ids[at : at + 2] = [joined[least]]
            del ranks[at]
            if at:
                ranks[at - 1] = get(ids[at - 1] << 32 | ids[at], NONE)
            if at < len(ranks):
                ranks[at] = get(ids[at] << 32 | ids[at + 1], NONE)
        return ids

    def queued(self, ids: list[int]) -> list[int]:
        """The same for a long word: pairs come from a heap by rank and place, stale ones are passed over."""
        get, size = self.rank.get, len(ids)
        after, before = [*range(1, size), -1], [*range(-1, size - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(size - 1) if (r := get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, at, left, right = heapq.heappop(heap)
            beside = after[at]
            if ids[at] != left or beside < 0 or ids[beside] != right:
                continue
            ids[at], ids[beside] = self.joined[rank], -1
            after[at] = after[beside]
            if after[at] >= 0:
                before[after[at]] = at
            for one in (before[at], at):
                two = after[one] if one >= 0 else -1
                if two >= 0 and (r := get(ids[one] << 32 | ids[two])) is not None:
                    heapq.heappush(heap, (r, one, ids[one], ids[two]))
        return [i for i in ids if i >= 0]

    def encode_word(self, word: str) -> list[int]:
        raw = word.encode()
        ids = [self.inner[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        return self.scanned(ids) if len(ids) <= SHORT else self.queued(ids)

    def split(self, stretch: str) -> list[str]:
        """The words of a stretch without marks, normalised."""
        if PLAIN.fullmatch(stretch):
            # case by case, not by context: a sigma at the end of a word is written like any other
            return self.words(unicodedata.normalize("NFC", stretch).replace("Σ", "σ").lower())
        normal = self.library.normalizer.normalize_str(stretch)
        letters = self.library.pre_tokenizer.pre_tokenize_str(normal)
        return [normal[begin:end] for _, (begin, end) in letters]

    def encode_stretch(self, stretch: str) -> bytes:
        ids: list[int] = []
        for part in self.marks.split(stretch) if self.marks else [stretch]:
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                for word in self.split(part):
                    ids.extend(self.encode_word(word))
        packed = array("I", ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def packed(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit numbers."""
        stretches = SPACE.split(text) if SEPARATORS.search(text) else text.split()
        return b"".join(map(self.known.__getitem__, stretches))

    def encode(self, text: str) -> list[int]:
        return unpacked(self.packed(text)).tolist()

    def decode(self, ids: list[int] | array) -> str:
        """The tokens of ids, with a space between: the model has no decoder. Ids outside the vocabulary have none."""
        try:
            return " ".join(map(self.token.__getitem__, ids))
        except IndexError:
            return " ".join(self.token[i] for i in ids if i < len(self.token))


def unpacked(packed: bytes) -> array:
    ids = array("I", packed)
    if sys.byteorder == "big":
        ids.byteswap()
    return ids


_loaded: dict[bytes, Codec] = {}


def codec(model: bytes) -> Codec:
    """One codec per worker process and model, with what it has learnt so far."""
    if model not in _loaded:
        _loaded[model] = Codec(model)
    return _loaded[model]


def _mapped(df: DataFrame, source: str, made: list[T.StructField], make) -> DataFrame:
    """Replaces `source` by the columns that `make` gives for a column of its values; the others pass through."""
    names = {f.name for f in made}
    fields = [f for f in df.schema.fields if f.name != source and f.name not in names]
    kept = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {f.name: f for f in made}
        for batch in slices(batches, "__source"):
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *make(batch.column(0))], [*kept, *own])

    small_batches(df.sparkSession)
    return df.select(F.col(f"`{source}`").alias("__source"), *[F.col(f"`{c}`") for c in kept]).mapInArrow(run, T.StructType([*fields, *made]))


def encode(df: DataFrame, model: bytes, text: str = "text", ids: str = "ids") -> DataFrame:
    """Replaces a text column by its ids: binary, little-endian unsigned 32-bit numbers, as token files hold them."""

    def make(column: pa.Array) -> list[pa.Array]:
        own = codec(model)
        return [pa.array([own.packed(t or "") for t in column.to_pylist()], pa.binary())]

    return _mapped(df.withColumn(text, F.col(f"`{text}`").cast("string")), text, [T.StructField(ids, T.BinaryType())], make)


def decode(df: DataFrame, model: bytes, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Replaces a column of packed ids by the text they stand for."""

    def make(column: pa.Array) -> list[pa.Array]:
        own = codec(model)
        return [pa.array([own.decode(unpacked(v or b"")) for v in column.to_pylist()], pa.string())]

    return _mapped(df, ids, [T.StructField(text, T.StringType())], make)


def encode_decode(df: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """Replaces a text by its packed `ids` and the text `decoded` from them, in one pass of Python workers."""

    def make(column: pa.Array) -> list[pa.Array]:
        own = codec(model)
        packed = [own.packed(t or "") for t in column.to_pylist()]
        return [pa.array(packed, pa.binary()), pa.array([own.decode(unpacked(p)) for p in packed], pa.string())]

    made = [T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())]
    return _mapped(df.withColumn(text, F.col(f"`{text}`").cast("string")), text, made, make)


def digests(df: DataFrame, model: bytes) -> DataFrame:
    """Per document the number of ids, the hash of the packed ids, and the hash of the text decoded from them."""
    return encode_decode(df.select("doc_id", "text"), model).select(
        "doc_id",
        F.expr("bigint(octet_length(ids) div 4)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def load_model(path: str) -> bytes:
    """Reads a model file on the driver; it travels with the tasks (two megabytes)."""
    with open(path, "rb") as file:
        return file.read()
