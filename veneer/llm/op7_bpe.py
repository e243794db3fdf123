"""Byte-level BPE as a monoid: halves are encoded on their own and joined by re-encoding a window around the seam.

The window grows until what lies outside provably cannot change. Splitting a text into pieces reads at most three
characters ahead and never back, so pieces that end that far before the seam stay, and once a piece begins where one
of the right half begins, all later pieces stay. Inside a piece, a token sequence is the encoding exactly if each two
neighbours encode to themselves, so it suffices to test the two pairs at the window's borders. Decoding concatenates
up the same tree.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from veneer.llm.common import table, texts

LEAF_CHARS, LEAF_BYTES, LEAF_IDS = 4096, 24, 4096
#: Characters the pattern may look at behind the end of a piece.
LOOK_AHEAD = 3
_NEVER = 1 << 40  # above every rank


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Codec:
    """Encoder and decoder of one vocabulary. `remembered` bounds the table of pieces seen before."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = 400_000):
        self.ranks, self.pattern, self.remembered = ranks, regex.compile(pattern), remembered
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.seen: dict[str, tuple[int, ...]] = {}

    # --- one piece ---------------------------------------------------------------------
    def merge(self, data: bytes) -> list[bytes]:
        """Leaf: join the leftmost neighbours of lowest rank until no two join."""
        if data in self.ranks:
            return [data]
        parts = [data[i:i + 1] for i in range(len(data))]
        rank = self.ranks.get
        costs = [rank(data[i:i + 2], _NEVER) for i in range(len(data) - 1)]
        while costs:
            best = min(costs)
            if best == _NEVER:
                break
            at = costs.index(best)
            parts[at] += parts.pop(at + 1)
            del costs[at]
            if at < len(costs):
                costs[at] = rank(parts[at] + parts[at + 1], _NEVER)
            if at:
                costs[at - 1] = rank(parts[at - 1] + parts[at], _NEVER)
        return parts

    def join_tokens(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        k = 1
        while True:
            middle = self.merge(b"".join(left[-k:] + right[:k]))
            before, after = left[:-k], right[k:]
            if ((not before or self.merge(before[-1] + middle[0]) == [before[-1], middle[0]])
                    and (not after or self.merge(middle[-1] + after[0]) == [middle[-1], after[0]])):
                return before + middle + after
            k *= 2

    def tokens(self, data: bytes) -> list[bytes]:
        if len(data) <= LEAF_BYTES:
            return self.merge(data)
        half = len(data) // 2
        return self.join_tokens(self.tokens(data[:half]), self.tokens(data[half:]))

    # --- a text as pieces --------------------------------------------------------------
    def join_pieces(self, left: list[str], right: list[str]) -> list[str]:
        if not left or not right:
            return left or right
        k = 2
        while True:
            tail, head = left[-k:], right[:k]
            tail_chars = sum(map(len, tail))
            whole_left, whole_right = k >= len(left), k >= len(right)
            if whole_left or tail_chars >= LOOK_AHEAD:
                again = self.pattern.findall("".join(tail) + "".join(head))
                if whole_right:
                    return left[:-k] + again
                starts, place = {}, tail_chars
                for r, p in enumerate(head):
                    starts[place] = r
                    place += len(p)
                end, place = place, 0
                for i, p in enumerate(again):
                    if place in starts and end - place >= LOOK_AHEAD and starts[place]:
                        return left[:-k] + again[:i] + right[starts[place]:]
                    place += len(p)
            k *= 2

    def pieces(self, text: str) -> list[str]:
        if len(text) <= LEAF_CHARS:
            return self.pattern.findall(text)
        half = len(text) // 2
        return self.join_pieces(self.pieces(text[:half]), self.pieces(text[half:]))

    def encode(self, text: str) -> list[int]:
        seen, ids = self.seen, []
        for piece in self.pieces(text):
            own = seen.get(piece)
            if own is None:
                if len(seen) >= self.remembered:
                    seen.clear()
                own = seen[piece] = tuple(self.ranks[t] for t in self.tokens(piece.encode()))
            ids += own
        return ids

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_IDS:
            return b"".join([self.bytes_of[i] for i in ids])
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def encode(df: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, token_ids; one row per row.

    Null texts count as empty: no tokens. Ids may be null or repeated; other columns are ignored. The rank file has a
    fixed size; it is read once on the driver and sent to the executors.
    """
    base = texts(df, id_col, text_col)
    shared = df.sparkSession.sparkContext.broadcast((read_ranks(rank_path), pattern))
    schema = T.StructType([base.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
                           T.StructField("decoded_sha256", T.StringType())]
                          + [T.StructField("token_ids", T.ArrayType(T.IntegerType()))] * with_ids)

    def run(batches):
        codec = Codec(*shared.value)
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):  # bounds what one output batch holds
                counts, hashes, decoded, all_ids = [], [], [], []
                for text in part.column("text"):
                    ids = codec.encode(text.as_py())
                    counts.append(len(ids))
                    packed = np.array(ids, "<u4")
                    hashes.append(hashlib.sha256(packed.tobytes()).hexdigest())
                    decoded.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                    all_ids.append(packed.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(hashes), pa.array(decoded)]
                    + [pa.array(all_ids, pa.list_(pa.int32()))] * with_ids, schema.names)

    return base.mapInArrow(run, schema)


def query(spark: SparkSession, sf: str) -> DataFrame:
    return encode(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                  public_tokenizers.PATTERN, with_ids=False)


QUERIES = {"op7_byte_bpe": query}
ORACLES: dict[str, str] = {}
