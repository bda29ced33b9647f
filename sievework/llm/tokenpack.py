"""Token ids packed best-fit-decreasing into rows of fixed width.

Each task tokenises its documents, cuts those above the width into segments, and gathers segments until
a pool is full. A pool's segments, longest first, each go into the row with the least room that still
holds them; a segment tree over capacities finds it in log2(width) steps. A packed row carries its ids
padded to the width, the cumulative lengths of its segments, and positions that begin anew with each.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import need

#: Tokens in a row, and tokens that a task gathers before it packs them.
WIDTH, POOL = 2048, 2_000_000
TOKENIZERS = os.environ.get("SIEVEWORK_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the public byte-level BPE's pattern for words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Long texts are given to the tokeniser in parts of about so many characters.
PART = 50_000

_loaded: dict[bytes, object] = {}


def read_ranks(folder: str = TOKENIZERS, name: str = "byte_bpe_50k.tiktoken") -> bytes:
    """A vocabulary file, below 1 MB; the driver reads it and tasks get it from a broadcast."""
    with open(os.path.join(folder, name), "rb") as f:
        return f.read()


def tokenizer(ranks: bytes):
    """The tokeniser of a vocabulary file, kept for the life of a worker."""
    key = hashlib.sha256(ranks).digest()
    if key not in _loaded:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) }
        _loaded[key] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _loaded[key]


def parts_of(text: str, size: int = PART) -> Iterator[str]:
    """``text`` in parts that are tokenised as they would be within it.

    A part ends before a single space between other characters, where every word of the pattern ends
    too. Only a text that has no such place for a whole part is cut elsewhere: its ids still decode to it.
    """
    at = 0
    while len(text) - at > 2 * size:
        cut = at + size
        while (cut := text.find(" ", cut, at + 2 * size - 1)) > 0 and (text[cut - 1].isspace() or text[cut + 1].isspace()):
            cut += 1
        cut = cut if cut > 0 else at + size
        yield text[at:cut]
        at = cut
    yield text[at:]


def encode(text: str | None, bpe) -> np.ndarray:
    """The token ids of a whole text; null and empty texts have none."""
    if not text:
        return np.zeros(0, np.uint32)
    found = [bpe.encode_to_numpy(p, disallowed_special=()) for p in parts_of(text)]
    return np.concatenate(found) if len(found) > 1 else found[0]


class Capacities:
    """A segment tree over room left, from 0 to ``width``: how many open rows have each."""

    def __init__(self, width: int) -> None:
        self.size = 1 << width.bit_length()
        self.rows: list[list[int]] = [[] for _ in range(self.size)]
        self.count = [0] * (2 * self.size)

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        at = room + self.size
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """The room and number of a row with the least room of at least ``least``; it is removed."""
        count, at = self.count, least + self.size
        if not count[at]:
            # up until a right sibling has rows, then down its leftmost ones
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if count[2 * at] else 2 * at + 1
        room = at - self.size
        while at:
            count[at] -= 1
            at >>= 1
        return room, self.rows[room].pop()


def best_fit(lengths: np.ndarray, width: int) -> list[list[int]]:
    """Rows of segment numbers, best-fit-decreasing; equal lengths in their given order."""
    open_, rows = Capacities(width), []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        got = open_.take(n)
        if got is None:
            got = (width, len(rows))
            rows.append([])
        rows[got[1]].append(i)
        if got[0] > n:
            open_.add(got[0] - n, got[1])
    return rows


SCHEMA = (
    "shard string, row int, n_tokens int, input_ids binary, cu_seqlens array<int>, position_ids binary, "
    "doc_ids array<{kind}>, segments array<int>"
)


def packed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, pool: int = POOL, folder: str = TOKENIZERS,
    name: str = "byte_bpe_50k.tiktoken", pad: int = 50_256,
) -> DataFrame:
    """Packed rows: ``input_ids`` and ``position_ids`` are ``width`` little-endian uint16 each.

    ``cu_seqlens`` begins with 0 and ends with ``n_tokens``; segment k has ids from cu_seqlens[k] to
    cu_seqlens[k + 1] and is number ``segments[k]`` of the document ``doc_ids[k]``; after ``n_tokens``
    come ``pad`` and position 0. ``shard`` and ``row`` name the place in an id matrix. The segments of a
    document, in order, are its ids, whole. Null and empty texts have no tokens and are in no row; null
    ids and repeated rows are packed like others. Nothing is shuffled, and a task holds one pool.
    """
    if not 0 < width < 1 << 16 or pad >= 1 << 16:
        raise ValueError("width and ids are stored in 16 bits")
    rows = need(docs, doc_id=id_col, text=text_col)
    kind = dict(rows.dtypes)["doc_id"]
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(folder, name))
    schema = SCHEMA.format(kind=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe, shards, segs, held = tokenizer(ranks.value), 0, [], 0
        task = TaskContext.get().partitionId()
        for batch in batches:
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = encode(text.as_py(), bpe).astype("<u2")
                segs += [(doc.as_py(), k, ids[i : i + width]) for k, i in enumerate(range(0, ids.size, width))]
                held += ids.size
                if held >= pool:
                    yield from emit(segs, f"{task}-{shards}", batch["doc_id"].type)
                    shards, segs, held = shards + 1, [], 0
        if segs:
            yield from emit(segs, f"{task}-{shards}", batch["doc_id"].type)

    def emit(segs: list, shard: str, kind_of: pa.DataType) -> Iterator[pa.RecordBatch]:
        out = []
        for number, row in enumerate(best_fit(np.array([s[2].size for s in segs]), width)):
            sizes = [segs[i][2].size for i in row]
            ends = np.cumsum([0, *sizes])
            n = int(ends[-1])
            ids, places = np.full(width, pad, "<u2"), np.zeros(width, "<u2")
            ids[:n] = np.concatenate([segs[i][2] for i in row])
            places[:n] = np.arange(n) - np.repeat(ends[:-1], sizes)
            out.append((shard, number, n, ids.tobytes(), ends.tolist(), places.tobytes(), [segs[i][0] for i in row], [segs[i][1] for i in row]))
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(kind_of), pa.list_(pa.int32()))
        names = ["shard", "row", "n_tokens", "input_ids", "cu_seqlens", "position_ids", "doc_ids", "segments"]
        for i in range(0, len(out), 512):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[i : i + 512], strict=True), kinds, strict=True)], names=names)

    return rows.mapInArrow(run, schema)


def write_matrices(rows: DataFrame, path: str) -> None:
    """Write one row for each shard to ``path`` (Parquet): its matrices as bytes, and its segments.

    A shard holds at most a pool and one document, so no row is larger than that. ``ids`` and
    ``positions`` are n_rows x width uint16; ``cu_seqlens`` has an array for each row.
    """
    each = F.sort_array(F.collect_list(F.struct("row", "input_ids", "position_ids", "cu_seqlens", "doc_ids", "segments")))
    # binary concatenation over at most a pool's rows
    rows.groupBy("shard").agg(each.alias("r")).select(
        "shard", F.size("r").alias("n_rows"),
        F.unhex(F.array_join(F.transform("r", lambda x: F.hex(x["input_ids"])), "")).alias("ids"),
        F.unhex(F.array_join(F.transform("r", lambda x: F.hex(x["position_ids"])), "")).alias("positions"),
        F.transform("r", lambda x: x["cu_seqlens"]).alias("cu_seqlens"),
        F.transform("r", lambda x: x["doc_ids"]).alias("doc_ids"), F.transform("r", lambda x: x["segments"]).alias("segments"),
    ).write.mode("errorifexists").parquet(path)
