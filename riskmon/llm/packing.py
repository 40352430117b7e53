"""Best-fit-decreasing packing of token sequences.

Documents are tokenized once, in Arrow batches; only lengths and checksums are
kept. Pieces are dealt into groups of bounded size and each group is packed by
one task, longest piece first, into the open sequence with the least room that
still fits. A segment tree over the possible remainders finds that sequence in
logarithmic time.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskmon.llm.common import documents, materialize, prepared, tasks_for

LENGTH, END = 1024, 2
GROUP = 100_000


# Literal tokens of the vocabulary's `tokenizers` file, and their ids.
SPECIAL = {"<|endoftext|>": 50256}


class Encoder:
    """Ids of whole texts under a byte-level BPE vocabulary, literal special tokens included.

    The rank file gives the ids of the `tokenizers` file at a quarter of its time
    (177 against 790 CPU seconds a GB); the tests hold the two against each other.
    """

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=SPECIAL)

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        return np.asarray(self.encoding.encode(text, allowed_special="all"), "<u4").tobytes()


ENCODERS: dict[str, Encoder] = {}


def encoder(ranks_path: str | None) -> Encoder:
    """One encoder per Python worker; without a path the public tokenizer files' own place."""
    if ranks_path not in ENCODERS:
        import public_tokenizers

        ENCODERS[ranks_path] = Encoder(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return ENCODERS[ranks_path]


def cut(ids: bytes, length: int) -> list[tuple[int, int, int]]:
    """(start, length, checksum) of the pieces of a document's ids.

    Only a document longer than `length` is cut; the rest of the division comes first.
    """
    n = len(ids) // 4
    bounds = [0, *range(n % length or length, n + 1, length)] if n > length else [0, n]
    return [(a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for a, b in zip(bounds, bounds[1:])]


PIECES = "doc_id long, copy long, piece int, start long, length long, ids_crc32 long"


def tokenize(docs: DataFrame, length: int = LENGTH, end: int = END, ranks_path: str | None = None) -> DataFrame:
    """Pieces of all documents; `copy` tells repeated rows apart."""
    close = np.asarray([end], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path)
        for batch in batches:
            rows = []
            for doc, copy, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                rows += [(doc, copy, i, *p) for i, p in enumerate(cut(enc.ids(text or "") + close, length))]
            columns = list(zip(*rows)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ("doc_id", "copy", "piece", "start", "length", "ids_crc32")
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=list(names))

    return docs.select("doc_id", F.monotonically_increasing_id().alias("copy"), "text").mapInArrow(pieces, PIECES)


class Remainders:
    """Segment tree over remaining capacities 0..length: which of them have an open sequence."""

    def __init__(self, length: int):
        self.width = 1 << length.bit_length()
        self.tree = [0] * (2 * self.width)
        self.open: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        node = room + self.width
        while node:
            self.tree[node] += 1
            node >>= 1

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Remove and return (room, sequence) of the least room that is at least `need`."""
        tree, node = self.tree, need + self.width
        if not tree[node]:
            while node > 1 and (node & 1 or not tree[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.width:
                node *= 2
                if not tree[node]:
                    node += 1
        room = node - self.width
        while node:
            tree[node] -= 1
            node >>= 1
        return room, self.open[room].pop()


def best_fit(lengths: list[int], length: int) -> tuple[list[int], list[int]]:
    """Sequence and offset of each item, the items being in descending order of length."""
    tree, used = Remainders(length), 0
    sequence, offset = [0] * len(lengths), [0] * len(lengths)
    for i, need in enumerate(lengths):
        got = tree.tightest(need)
        if got is None:
            room, at = length, used
            used += 1
        else:
            room, at = got
        sequence[i], offset[i] = at, length - room
        if room > need:
            tree.add(room - need, at)
    return sequence, offset


PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack(pieces: DataFrame, groups: int, length: int = LENGTH) -> DataFrame:
    """Pieces with the sequence and the place that best-fit decreasing gives them in their group."""

    def packed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "copy", "piece"], ascending=[False, True, True, True], kind="stable")
        sequence, offset = best_fit(pdf["length"].tolist(), length)
        return pd.DataFrame({
            **{c: pdf[c].array for c in ("doc_id", "piece", "start", "length", "ids_crc32")},
            "sequence_id": np.asarray(sequence, "int64") + (int(key[0]) << 32), "offset": np.asarray(offset, "int64"),
        })

    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "copy", "piece"), F.lit(groups)).cast("long"))
    return dealt.groupBy("part").applyInPandas(packed, PACKED)


def pack_documents(docs: DataFrame, length: int = LENGTH, end: int = END, ranks_path: str | None = None, group: int = GROUP) -> DataFrame:
    """Pack all documents into sequences of at most `length` tokens.

    A null or empty text is its end token alone; texts of any length are encoded
    whole and cut; repeated rows are packed one by one; pieces of one length tie and
    go by doc_id; an empty table gives no row; other columns play no part. Groups
    hold about `group` pieces at any input size, so a task's memory is bounded and at
    most a few sequences per group stay part-filled.
    """
    prepared(docs.sparkSession)
    stored = materialize(tokenize(docs, length, end, ranks_path), "pieces")
    return pack(stored, tasks_for(stored, group), length)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
