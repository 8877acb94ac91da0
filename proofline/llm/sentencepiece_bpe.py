"""Encoding and decoding with a SentencePiece BPE model, by a table of last tokens.

Every prefix of a text has one last token in its encoding. The table is filled
left to right: an automaton names the pieces that end at a place, and the one
piece that stands beside the last token of the prefix before it, when the two
are encoded alone, is the last token here. Ids are then read backwards.

The model must have an identity normaliser and no piece with a space inside or
behind other letters (checked when it is loaded). Encoding then splits before
spaces and at letters outside the vocabulary, which keeps the table short.
Pieces of spaces alone have the lowest rank of all, so runs of single spaces
are joined last, in a pass of their own.

Nulls and empty texts have no ids and decode to the empty text. Repeated rows
stay, each with its own ids. Other columns pass through untouched; a column
named like an output is replaced.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofline.llm.common import small_batches

SPACE = "▁"
#: Distinct words a Python worker keeps at hand before it lets go of those not met lately; a matter of memory only.
REMEMBERED = 300_000
#: Pairs of tokens whose judgement is kept.
PAIRS = 1_000_000
#: The rank of what is no piece.
NEVER = float("inf")
CHUNK = re.compile(r" *[^ \n]+|[ ]+|\n")

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Known(dict):
    """Ids of chunks met lately, as packed 32-bit numbers; the generation before stays in reach."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            ids = array("i", self.make(chunk)).tobytes()
            if len(chunk) > 64:
                return ids
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[chunk] = ids
        return ids


class Codec:
    """The tables of one model: pieces by id, ranks, the automaton, and what has been learnt about pairs."""

    def __init__(self, model: bytes):
        import ahocorasick
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = lib.get_piece_size()
        self.surface: list[bytes] = []
        self.byte_id: dict[int, int] = {}
        self.rank: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.runs: dict[int, int] = {}
        self.automaton = ahocorasick.Automaton()
        for i in range(size):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.surface.append(bytes([int(piece[3:5], 16)]))
                continue
            if lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i):
                self.surface.append(b" \xe2\x81\x87 " if lib.is_unknown(i) else b"")
                continue
            self.surface.append(piece.replace(SPACE, " ").encode())
            if not piece.strip(SPACE):
                self.runs[len(piece)] = i
            if piece == SPACE or piece.strip(SPACE):
                if SPACE in piece[1:]:
                    raise ValueError(f"a piece with a space behind other letters: {piece!r}")
                self.id[piece] = i
                self.rank[piece] = -lib.get_score(i)
                self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        self.piece = {i: p for p, i in self.id.items()}
        self.single = self.id.get(SPACE, -2)
        self.beside: dict[int, bool] = {}
        self.made: dict[int, tuple[list[float], list[str], list[str]] | None] = {}
        self.known = Known(self.encode_chunk)
        self.spaced = frozenset(i for i, p in self.piece.items() if p[0] == SPACE) | frozenset(self.runs.values())

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by repeated merging of the best pair: the rule that the table stands on."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.rank.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def steps(self, token: int) -> tuple[list[float], list[str], list[str]] | None:
        """How a piece comes about by merging: the rank of each merge, then none, and the first and the last part before
        each merge and after all. None for a piece that merging never makes.
        """
        if token in self.made:
            return self.made[token]
        parts = list(self.piece[token])
        ranks = [self.rank.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        merges, firsts, lasts = [], [parts[0]], [parts[-1]]
        while ranks and (best := min(ranks)) < NEVER:
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = self.rank.get(parts[i - 1] + parts[i], NEVER)
            if i < len(ranks):
                ranks[i] = self.rank.get(parts[i] + parts[i + 1], NEVER)
            merges.append(best)
            firsts.append(parts[0])
            lasts.append(parts[-1])
        found = self.made[token] = None if len(parts) > 1 else ([*merges, NEVER], firsts, lasts)
        return found

    def allowed(self, before: int, token: int) -> bool:
        """Whether a token may follow another one; after -1 (the beginning, a letter outside) whether it is reached at all.

        Two pieces side by side come about as each does alone, their merges taken by rank, the left one's first among
        equals, until a merge across the border has its turn: then they do not stand beside each other.
        """
        if len(self.beside) >= PAIRS:
            self.beside.clear()
        right = self.steps(token)
        left = right if before < 0 else self.steps(before)
        found = left is not None and right is not None and (before < 0 or self.apart(left, right))
        self.beside[before << 16 | token] = found
        return found

    def apart(self, left: tuple[list[float], list[str], list[str]], right: tuple[list[float], list[str], list[str]]) -> bool:
        """Whether no merge across the border of two pieces has its turn before both are made."""
        own, _, lasts = left
        other, firsts, _ = right
        i = j = 0
        while True:
            across = self.rank.get(lasts[i] + firsts[j], NEVER)
            if across < own[i] and across <= other[j]:
                return False
            if own[i] == other[j] == NEVER:
                return True
            if own[i] <= other[j]:
                i += 1
            else:
                j += 1

    def table(self, text: str) -> tuple[list[int], list[int]]:
        """For each prefix the id of its last token and its length; id -1 for a letter outside the vocabulary."""
        token_at, length_at = [-1] * (len(text) + 1), [1] * (len(text) + 1)
        beside = self.beside
        for end, (length, token) in self.automaton.iter(text):
            end += 1
            if token_at[end] < 0:
                before = token_at[end - length]
                fits = beside.get(before << 16 | token)
                if self.allowed(before, token) if fits is None else fits:
                    token_at[end], length_at[end] = token, length
        return token_at, length_at

    def encode_chunk(self, chunk: str) -> list[int]:
        text = chunk.replace(" ", SPACE)
        token_at, length_at = self.table(text)
        at, back, plain = len(text), [], True
        while at:
            token = token_at[at]
            if token < 0 or token == self.single:
                plain = False
            back.append(token if token >= 0 else text[at - 1])
            at -= length_at[at]
        back.reverse()
        return back if plain else self.with_runs(back)

    def with_runs(self, tokens: list[int | str]) -> list[int]:
        """Joins runs of single spaces and writes letters outside the vocabulary as bytes."""
        ids: list[int] = []
        run = 0
        for token in [*tokens, None]:
            if token == self.single:
                run += 1
                continue
            while run:
                # no piece has 15 spaces, but one has 16: 14 and 2 join
                step = max(k for k in self.runs if k <= run)
                ids.append(self.runs[step])
                run -= step
            if isinstance(token, str):
                ids.extend(self.byte_id[b] for b in token.encode())
            elif token is not None:
                ids.append(token)
        return ids

    def packed(self, text: str) -> bytes:
        """The ids of a text as packed 32-bit numbers."""
        if not text:
            return b""
        return b"".join(map(self.known.__getitem__, CHUNK.findall(" " + text.replace(SPACE, " "))))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), dtype=np.int32).tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the space that encoding puts first goes."""
        joined = b"".join(map(self.surface.__getitem__, ids))
        return (joined[1:] if ids and ids[0] in self.spaced else joined).decode("utf-8", "replace")


_loaded: dict[bytes, Codec] = {}


def codec(model: bytes) -> Codec:
    """One codec per task and model, with what it has learnt so far; its memory goes with the task."""
    if model not in _loaded:
        _loaded[model] = Codec(model)
    return _loaded[model]


def _with_column(df: DataFrame, name: str, kind: T.DataType, source: str, make) -> DataFrame:
    """Adds a column that `make` works out for each value of `source`, in Arrow batches."""
    kept = [c for c in df.columns if c != name]
    if len(kept) == len(df.columns):
        plain = df
    else:
        plain = df.withColumnRenamed(name, f"__{name}") if source == name else df.select(*[F.col(f"`{c}`") for c in kept])
    source = f"__{name}" if source == name else source
    schema = T.StructType([f for f in plain.schema.fields if f.name != f"__{name}"] + [T.StructField(name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a few rows at a time: long texts never pile up as Python objects
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                at = part.schema.get_field_index(source)
                made = make(part.column(at))
                columns = [part.column(i) for i in range(part.num_columns) if part.schema.field(i).name != f"__{name}"]
                names = [f.name for f in part.schema if f.name != f"__{name}"]
                yield pa.RecordBatch.from_arrays([*columns, made], [*names, name])

    small_batches(df.sparkSession)
    return plain.mapInArrow(run, schema)


def encode(df: DataFrame, model: bytes, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the ids of a text column as array<int>."""

    def make(column: pa.Array) -> pa.Array:
        own = codec(model)
        packed = [own.packed(t or "") for t in column.to_pylist()]
        ends = np.cumsum([0, *map(len, packed)], dtype=np.int64) // 4
        ids = pa.array(np.frombuffer(b"".join(packed), dtype=np.int32))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)

    return _with_column(df, ids, T.ArrayType(T.IntegerType()), text, make)


def decode(df: DataFrame, model: bytes, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the text of a column of ids."""

    def make(column: pa.Array) -> pa.Array:
        own = codec(model)
        column = column.cast(pa.list_(pa.int32()))
        found = [own.decode(v.values.to_numpy().tolist() if v.is_valid else []) for v in column]
        return pa.array(found, pa.string())

    return _with_column(df, text, T.StringType(), ids, make)


def encode_decode(df: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """Replaces a text by its `ids` and the text `decoded` from them, in one pass of Python workers."""
    kept = [c for c in df.columns if c not in (text, "ids", "decoded")]
    fields = [f for f in df.schema.fields if f.name in kept]
    schema = T.StructType([*fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                packed = [own.packed(t or "") for t in part.column(0).to_pylist()]
                ids = np.frombuffer(b"".join(packed), dtype=np.int32)
                ends = np.cumsum([0, *map(len, packed)], dtype=np.int64) // 4
                texts = [own.decode(ids[a:b].tolist()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], lists, pa.array(texts, pa.string())], [*kept, "ids", "decoded"])

    small_batches(df.sparkSession)
    return df.select(F.col(f"`{text}`").cast("string").alias("__text"), *[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def digests(df: DataFrame, model: bytes) -> DataFrame:
    """Per document the number of ids, their hash, and the hash of the text decoded from them."""
    both = encode_decode(df.select("doc_id", "text"), model)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def load_model(path: str) -> bytes:
    """Reads a model file on the driver; it travels with the tasks (half a megabyte)."""
    with open(path, "rb") as file:
        return file.read()
