"""Byte-level BPE encoding and decoding (operator 9).

Method: a global distinct-word shuffle.

1. Every task cuts its texts into pre-tokens and explodes them with their
   positions, a block of documents at a time.  Of a block, each *distinct*
   word goes to the shuffle once ("the" makes one entry a block, not one an
   occurrence), packed with the block's other words of the same word-hash
   shard; its positions are one compressed array of word numbers.
2. The shuffle on the shard brings equal words of all blocks together; each
   distinct word is encoded once, by merging byte pairs in rank order.
3. The ids go back to their blocks in a second shuffle, where the arrays of
   positions (moved once, by block) put them in order again.
4. Decoding joins ids with the token-byte table.  That table has one row a
   vocabulary entry (about 50,000, whatever the corpus), which is why every
   task may hold it.

A block is a run of documents of one input partition with at most
``BLOCK_CHARS`` characters (a longer text is a block of its own) and there
are as many shards as input partitions, so the memory of a task is bounded
by a block or a shard at any input size.  Blocks are named by partition and
order: ``docs`` must give the same rows in the same partitions when a lost
executor's part is computed again, as a file scan does (pass anything else
through ``common.stored``).

Defined results: null text is encoded as the empty text: no ids, and the
hashes of empty strings.  Repeated rows and repeated or null ids give one
result row for each input row.  Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import importlib.util
import os
import zlib

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import pack, planes, table_of, unpack, unplaned

BLOCK_CHARS = 12_000_000
TOKENIZERS_DIR = "/opt/tokenizers"


def public_tokenizers(folder: str = TOKENIZERS_DIR):
    """The module that describes the public vocabularies, from its folder if not on the path."""
    if spec := importlib.util.find_spec("public_tokenizers"):
        module = importlib.util.module_from_spec(spec)
    else:
        spec = importlib.util.spec_from_file_location(
            "public_tokenizers", os.path.join(folder, "__init__.py"))
        module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Merger:
    """Encodes one pre-token at a time."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def encode(self, piece: bytes) -> list[int]:
        """Ids of the piece: the adjacent pair of least rank is merged first, leftmost on ties."""
        if not piece:
            return []
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) > 64:
            return self._encode_long(piece)
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _encode_long(self, piece: bytes) -> list[int]:
        """The same merges with a heap over linked parts: n log n for long runs."""
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))          # end[i]: end of the part that starts at i
        before = list(range(-1, n - 1))      # start of the part before
        alive = [True] * n
        heap = []

        def offer(i: int):
            j = end[i]
            if j < n:
                rank = ranks.get(piece[i:end[j]])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, end[j]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i] if alive[i] else n
            if j >= n or end[j] != stop:
                continue
            end[i], alive[j] = stop, False
            if stop < n:
                before[stop] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i:end[i]]])
            i = end[i]
        return out


_EXPLODED = T.StructType([
    T.StructField("key", T.StringType()),          # "w" and the shard, or "d" and the block
    T.StructField("block", T.LongType()),
    T.StructField("shard", T.IntegerType()),
    T.StructField("packed", T.BinaryType()),       # words of the shard, or the block's positions
    T.StructField("doc_ids", T.ArrayType(T.LongType())),
    T.StructField("lengths", T.ArrayType(T.LongType())),
])
_CODED = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("shard", T.IntegerType()),
    T.StructField("packed", T.BinaryType()),
])
_DIGESTS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_sha256", T.StringType()),
    T.StructField("decoded_sha256", T.StringType()),
])
_TOKENS_OUT = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("ids", T.ArrayType(T.IntegerType())),
    T.StructField("decoded", T.BinaryType()),
])


def _explode(pattern: str, block_chars: int, n_shards: int):
    """Batches of (id, text) to the rows of ``_EXPLODED``."""

    def block_rows(block, ids, numbers, ends, words):
        coded = [w.encode("utf-8", "replace") for w in words]
        shard = np.array([zlib.crc32(w) % n_shards for w in coded], np.int64)
        order = np.argsort(shard, kind="stable")     # words are numbered shard after shard
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        rows = []
        cuts = np.searchsorted(shard[order], np.arange(n_shards + 1))
        for s in range(n_shards):
            own = [coded[i] for i in order[cuts[s]:cuts[s + 1]].tolist()]
            if own:
                rows.append((f"w{s}", block, s, pack([len(w) for w in own], b"".join(own)),
                             None, None))
        at = place[np.array(numbers, np.int64)] if numbers else np.empty(0, np.int64)
        rows.append((f"d{block}", block, None, zstandard.compress(planes(at), 3), ids,
                     np.diff(np.array([0, *ends])).tolist()))
        return table_of(rows, _EXPLODED).to_batches()

    def run(batches):
        from pyspark import TaskContext
        block = TaskContext.get().partitionId() << 32
        pieces = regex.compile(pattern).findall
        ids, numbers, ends, words, chars = [], [], [], {}, 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if ids and chars + len(text or "") > block_chars:
                    yield from block_rows(block, ids, numbers, ends, words)
                    block += 1
                    ids, numbers, ends, words, chars = [], [], [], {}, 0
                ids.append(doc_id)
                if text:
                    chars += len(text)
                    for piece in pieces(text):
                        number = words.get(piece)
                        if number is None:
                            number = words[piece] = len(words)
                        numbers.append(number)
                ends.append(len(numbers))
        if ids:
            yield from block_rows(block, ids, numbers, ends, words)

    return run


_MERGERS: dict[str, Merger] = {}


def _encode(vocabulary: str):
    """All words of a shard, from all blocks, to their ids; each distinct word is encoded once."""

    def run(group: pa.Table) -> pa.Table:
        if not group.column("key")[0].as_py().startswith("w"):
            return table_of([], _CODED)
        if vocabulary not in _MERGERS:
            _MERGERS[vocabulary] = Merger(load_ranks(vocabulary))
        encode, known, rows = _MERGERS[vocabulary].encode, {}, []
        for block, shard, packed in zip(*(group.column(c).to_pylist()
                                          for c in ("block", "shard", "packed"))):
            sizes, body = unpack(packed)
            ends = np.cumsum(sizes, dtype=np.int64).tolist()
            out, start = [], 0
            for end in ends:
                word = body[start:end]
                start = end
                ids = known.get(word)
                if ids is None:
                    ids = known[word] = np.array(encode(word), np.uint32).tobytes()
                out.append(ids)
            rows.append((f"d{block}", shard, pack([len(x) // 4 for x in out], b"".join(out))))
        return table_of(rows, _CODED)

    return run


_TOKENS: dict[str, tuple[list[bytes], list[str]]] = {}


def token_table(vocabulary: str) -> tuple[list[bytes], list[str]]:
    """The token-byte table, by id, and the ids in decimal.  Its size is the vocabulary's."""
    if vocabulary not in _TOKENS:
        ranks = load_ranks(vocabulary)
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        _TOKENS[vocabulary] = tokens, [str(i) for i in range(len(tokens))]
    return _TOKENS[vocabulary]


def _reassemble(vocabulary: str, digests: bool):
    """The ids of a block's words and the block's positions, to each document's row."""
    schema = _DIGESTS if digests else _TOKENS_OUT

    def run(coded: pa.Table, block: pa.Table) -> pa.Table:
        if not block.num_rows or not block.column("key")[0].as_py().startswith("d"):
            return table_of([], schema)
        tokens, decimal = token_table(vocabulary)
        decimals, decoded, counts, word_ids = [], [], [], []
        shards = sorted(zip(coded.column("shard").to_pylist(), coded.column("packed").to_pylist()))
        for _, packed in shards:
            sizes, body = unpack(packed)
            ids, start = np.frombuffer(body, np.uint32).tolist(), 0
            for size in sizes.tolist():
                own = ids[start:start + size]
                start += size
                if digests:
                    decimals.append(" ".join([decimal[i] for i in own]))
                else:
                    word_ids.append(own)
                decoded.append(b"".join([tokens[i] for i in own]))
            counts.append(sizes)
        count = np.concatenate(counts).astype(np.int64) if counts else np.empty(0, np.int64)
        rows = []
        for doc_ids, lengths, packed in zip(*(block.column(c).to_pylist()
                                              for c in ("doc_ids", "lengths", "packed"))):
            positions, start = unplaned(zstandard.decompress(packed)), 0
            for doc_id, length in zip(doc_ids, lengths):
                own = positions[start:start + length]
                start += length
                at = own.tolist()
                text = b"".join([decoded[i] for i in at])
                if digests:
                    rows.append((
                        doc_id, int(count[own].sum()),
                        hashlib.sha256(" ".join([decimals[i] for i in at]).encode()).hexdigest(),
                        hashlib.sha256(text).hexdigest()))
                else:
                    rows.append((doc_id, [t for i in at for t in word_ids[i]], text))
        return table_of(rows, schema)

    return run


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, doc_id: str = "doc_id",
                     text: str = "text", block_chars: int = BLOCK_CHARS,
                     digests: bool = False) -> DataFrame:
    """doc_id, ids and decoded (bytes) of every row's whole text.

    With ``digests``: doc_id, n_tokens, ids_sha256 (of the decimal ids joined
    by one space) and decoded_sha256, made where the ids are.
    """
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    n_shards = max(8, texts.rdd.getNumPartitions())
    exploded = texts.mapInArrow(_explode(pattern, block_chars, n_shards), _EXPLODED)
    # Both uses group by the same key, so the exploded rows are shuffled once and read twice.
    coded = exploded.groupBy("key").applyInArrow(_encode(vocabulary), _CODED)
    return (coded.groupBy("key").cogroup(exploded.groupBy("key"))
            .applyInArrow(_reassemble(vocabulary, digests), _DIGESTS if digests else _TOKENS_OUT))
