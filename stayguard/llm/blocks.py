"""Corpus-wide facts about the parts of texts, without moving the texts.

Texts are packed once into blocks of a few MB, written as a table bucketed by block. A pass
then sends, from each block, the sorted distinct keys of its parts (hashes), cut by key
range; each range is reduced on its own, over all blocks; and the answer for a block is one
value per key it sent, in the order sent, so keys do not travel back. Reading the blocks
together with their answers shuffles only the answers. A key that most documents share is
sent once by each block, so no range is much larger than another, and every step grows
with the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewise import flat
from .scratch import bucketed

BLOCK_BYTES = 2 << 20
#: Most texts in a block; ranks in a block fit 16 bits.
BLOCK_TEXTS = 1 << 15
#: Bytes of text for a bucket of blocks and for a range of keys.
BUCKET_BYTES, RANGE_BYTES = 32 << 20, 32 << 20
#: Least number of key ranges.
LEAST_RANGES = 128
SCHEMA = "block bigint, ids array<bigint>, digests array<binary>, lens array<int>, blob binary"
MESSAGE = "p int, block bigint, keys binary, more binary"
ANSWER = "block bigint, kind int, p int, answer binary"


class Block:
    """Texts of a block end to end, in the order of their ids."""

    def __init__(self, row):
        self.block = int(row["block"])
        self.ids = np.array(row["ids"], np.int64)
        lens = np.array(row["lens"], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(lens)])
        raw = zstandard.ZstdDecompressor().decompress(row["blob"], max_output_size=max(1, int(self.offsets[-1])))
        self.data = np.frombuffer(raw, np.uint8)


def build(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """The table of blocks, and the number of key ranges that suits its size. Rows without an id are left out."""
    import hashlib

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        place, made = TaskContext.get().partitionId(), 0
        squeeze = zstandard.ZstdCompressor(level=3)

        def block(ids: list, texts: list) -> pa.RecordBatch:
            nonlocal made
            order = sorted(range(len(ids)), key=ids.__getitem__)
            ids, texts = [ids[i] for i in order], [texts[i] for i in order]
            digests = [hashlib.blake2b(t, digest_size=16).digest() for t in texts]
            name = hashlib.blake2b(b"".join(digests) + np.array(ids, np.int64).tobytes() + f"{place}:{made}".encode(), digest_size=8).digest()
            made += 1
            columns = [[int.from_bytes(name, "little", signed=True)], [ids], [digests], [[len(t) for t in texts]], [squeeze.compress(b"".join(texts))]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["block", "ids", "digests", "lens", "blob"])

        ids, texts, held = [], [], 0
        for b in parts:
            data, offsets = flat(b.column(1))
            for i, doc in enumerate(b.column(0).to_pylist()):
                text = data[offsets[i]:offsets[i + 1]].tobytes()
                ids.append(doc)
                texts.append(text)
                held += len(text)
                if held >= BLOCK_BYTES or len(ids) >= BLOCK_TEXTS:
                    yield block(ids, texts)
                    ids, texts, held = [], [], 0
        if ids:
            yield block(ids, texts)

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter("id is not null")
    size = narrow.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    conf = docs.sparkSession.conf
    buckets = max(int(conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    most = int(conf.get("spark.sql.sources.bucketing.maxBuckets"))  # beyond it a task reads more blocks, one after the other
    table = bucketed(narrow.mapInArrow(pack, SCHEMA), "blocks", "block", min(buckets, most))
    return table, max(LEAST_RANGES, -(-size // RANGE_BYTES))


def first_ids(blocks: DataFrame) -> DataFrame:
    """For each distinct text its digest and least id."""
    rows = blocks.select(F.explode(F.arrays_zip("ids", "digests")).alias("r")).select("r.ids", "r.digests")
    return rows.groupBy(F.col("digests").alias("digest")).agg(F.min("ids").alias("first"))


def later_copies(blocks: DataFrame, firsts: DataFrame) -> DataFrame:
    """Answers of kind 0: ranks (int32) of the texts that equal a text with a smaller id."""
    rows = blocks.select("block", F.posexplode(F.arrays_zip("ids", "digests")).alias("rank", "r"))
    rows = rows.select("block", "rank", F.col("r.ids").alias("id"), F.col("r.digests").alias("digest"))
    later = rows.join(firsts, "digest").filter("id > first").groupBy("block").agg(F.sort_array(F.collect_list("rank")).alias("ranks"))

    def ranks(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"block": part["block"], "kind": 0, "p": 0, "answer": [np.array(r, np.int32).tobytes() for r in part["ranks"]]})

    return later.mapInPandas(ranks, ANSWER)


def answers_of(right: pd.DataFrame, kind: int) -> bytes:
    """The answers of one kind for a block, by range, laid end to end."""
    own = right[right["kind"] == kind].sort_values("p")
    return b"".join(own["answer"])


def with_answers(blocks: DataFrame, answers: DataFrame, work: Callable[[Block, pd.DataFrame], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """``work`` on every block and its answers."""
    def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        made = [x for _, row in left.iterrows() for x in work(Block(row), right)]
        return pd.concat(made, ignore_index=True) if made else pd.DataFrame(columns=names)

    names = [f.split()[0].strip("`") for f in schema.split(", ")]
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(one, schema)


def ranges(keys: np.ndarray, bits: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of n ranges (of equal width, n below 2**32) sorted keys of so many bits fall in, and the
    bounds of each in the keys; ranges without keys are left out."""
    p = ((keys >> np.uint64(bits - 32)) * np.uint64(n)) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])) if len(p) else np.zeros(0, np.int64)
    return p[first].astype(np.int64), np.concatenate([first, [len(keys)]])


def messages(block: int, keys: np.ndarray, bits: int, n: int, width: int, more: Callable[[int, int], bytes]) -> pd.DataFrame:
    """Rows of MESSAGE: the low ``width`` bytes of sorted keys by range, and what ``more`` gives for a slice."""
    some, at = ranges(keys, bits, n)
    raw = np.ascontiguousarray(keys, "<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    cuts = list(zip(at[:-1].tolist(), at[1:].tolist()))
    return pd.DataFrame({"p": some, "block": block, "keys": [raw[a:b].tobytes() for a, b in cuts], "more": [more(a, b) for a, b in cuts]})


def unpacked(raw: bytes, width: int) -> np.ndarray:
    rows = np.frombuffer(raw, np.uint8).reshape(-1, width)
    out = np.zeros((len(rows), 8), np.uint8)
    out[:, :width] = rows
    return out.view("<u8").ravel()


def reduced(sent: DataFrame, kind: int, width: int, judge: Callable[[np.ndarray, np.ndarray, np.ndarray, list[bytes]], np.ndarray],
            pack: Callable[[np.ndarray], bytes]) -> DataFrame:
    """Answers of a kind: each range over all blocks.

    ``judge(order, starts, lens, more)`` gets the order that sorts the keys of a range, the starts
    of equal ones in it, and the messages' lengths and payloads; it returns a value per key, in
    the order sent.
    """
    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("block")
        lens = part["keys"].map(len).to_numpy() // width
        keys = unpacked(b"".join(part["keys"]), width)
        order = np.argsort(keys)
        ranked = keys[order]
        starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        values = judge(order, starts, lens, list(part["more"]))
        ends = np.cumsum(lens)
        return pd.DataFrame({"block": part["block"], "kind": kind, "p": part["p"],
                             "answer": [pack(values[e - k:e]) for e, k in zip(ends, lens)]})

    return sent.groupBy("p").applyInPandas(one, ANSWER)


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unbits(right: pd.DataFrame, kind: int, keys: np.ndarray, bits: int, n: int) -> np.ndarray:
    """Flags of a kind for the sorted keys that a block sent."""
    own = dict(zip(*(right[right["kind"] == kind][c] for c in ("p", "answer"))))
    some, at = ranges(keys, bits, n)
    parts = [np.unpackbits(np.frombuffer(own[p], np.uint8), count=k) for p, k in zip(some.tolist(), np.diff(at).tolist())]
    return np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)
