"""Cross-tokenizer alignment (operator 12).

Method: token-byte incidence matrices in hand-built CSR.

1. Every task encodes its texts with both tokenizers.  Tokenizer A's tokens
   and the bytes they cover make an incidence matrix ``A`` (tokens x bytes),
   tokenizer B's the matrix ``B``.  The Gustavson row products of ``A`` and
   ``B`` transposed give the overlap links: the pairs of tokens that share
   bytes.  A link whose two tokens end at the same byte closes a group.
2. Two group-incidence matrices (A ids of a document x groups, groups x
   B ids) hold how often an id occurs in a group.  Their row products give
   the shared-group links: for each document and pair of ids the number of
   linked token occurrences.  Equal ids of a group are merged before the
   product, so a group of many tokens costs its *distinct* pairs of ids.
3. A block of documents writes its distinct id pairs with the number of its
   documents that hold them (pre-aggregated), and for each document the
   numbers of its pairs.  The pairs of all blocks are summed on Spark, marked
   where they are the highest of their A id, joined back to the blocks'
   pairs and dealt to the blocks.

Memory: the matrices are made for at most ``SLICE_CHARS`` characters at a
time and row products in pieces of at most ``PRODUCTS``; a block ends after
``BLOCK_CHARS`` (a longer text is a slice and block of its own).  The pairs
that a block shuffles are at most its distinct ones, so shuffled rows grow
with the input.  A pair that is in every block is joined in parts: rows of
``BLOCKS_A_SALT`` blocks each.

The vocabularies are read by the driver and broadcast; their sizes are the
vocabularies', whatever the corpus.

Defined results: null and empty texts, and texts whose tokens do not give
their bytes back, have no tokens: zeros and the empty string.  Repeated rows
and repeated or null ids give one result row for each input row, and each
counts as a document of its own.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import planes, table_of, unplaned
from .byte_bpe import public_tokenizers
from .common import stored

BLOCK_CHARS = 12_000_000
SLICE_CHARS = 500_000
PRODUCTS = 4_000_000
BLOCKS_A_SALT = 4_096
PAIR_BITS = 32                   # a pair of ids is one long: A's id above B's


# --------------------------------------------------------------------------
# compressed sparse rows
# --------------------------------------------------------------------------

class Csr(NamedTuple):
    """Row ``i`` has ``data[k]`` in column ``indices[k]`` for starts[i] <= k < starts[i + 1]."""
    starts: np.ndarray
    indices: np.ndarray
    data: np.ndarray
    n_cols: int


def csr(rows: np.ndarray, cols: np.ndarray, n_rows: int, n_cols: int) -> Csr:
    """The matrix of counts of equal (row, column) pairs, in any order."""
    codes, counts = np.unique(rows.astype(np.int64) * n_cols + cols, return_counts=True)
    starts = np.searchsorted(codes, np.arange(n_rows + 1, dtype=np.int64) * n_cols)
    return Csr(starts, codes % n_cols, counts, n_cols)


def _summed(codes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order with their values' sums."""
    if len(codes) > 1 and not (codes[1:] >= codes[:-1]).all():
        order = np.argsort(codes, kind="stable")
        codes, values = codes[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) \
        if len(codes) else np.empty(0, np.int64)
    return codes[first], np.add.reduceat(values, first) if len(first) else values


def row_products(a: Csr, b: Csr, products: int = PRODUCTS) -> Csr:
    """Gustavson's product: row i of the result is the sum of b's rows k, each times a[i, k].

    The nonzeros of ``a`` are taken in pieces of about ``products`` scalar
    products; the pieces' sums are merged, so a row may span pieces.
    """
    n_rows = len(a.starts) - 1
    widths = b.starts[a.indices + 1] - b.starts[a.indices]
    row_of = np.repeat(np.arange(n_rows, dtype=np.int64), np.diff(a.starts))
    done = np.concatenate([[0], np.cumsum(widths)])
    codes, values, lo = [], [], 0
    while lo < len(widths):
        hi = max(lo + 1, int(np.searchsorted(done, done[lo] + products, "right")) - 1)
        own = widths[lo:hi]
        at = (np.arange(done[hi] - done[lo]) + np.repeat(
            b.starts[a.indices[lo:hi]] - (done[lo:hi] - done[lo]), own))
        code, value = _summed(np.repeat(row_of[lo:hi] * b.n_cols, own) + b.indices[at],
                              np.repeat(a.data[lo:hi], own) * b.data[at])
        codes.append(code)
        values.append(value)
        lo = hi
    code, value = (codes[0], values[0]) if len(codes) == 1 else _summed(
        np.concatenate(codes or [np.empty(0, np.int64)]),
        np.concatenate(values or [np.empty(0, np.int64)]))
    starts = np.searchsorted(code, np.arange(n_rows + 1, dtype=np.int64) * b.n_cols)
    return Csr(starts, code % b.n_cols, value, b.n_cols)


def overlap_links(a_lengths: np.ndarray, b_lengths: np.ndarray) -> Csr:
    """Tokens of A x tokens of B: how many bytes they share.  Both cover the same bytes."""
    n_bytes = int(a_lengths.sum())
    one = np.ones(n_bytes, np.int64)
    tokens_a = Csr(np.concatenate([[0], np.cumsum(a_lengths)]), np.arange(n_bytes), one, n_bytes)
    bytes_b = Csr(np.arange(n_bytes + 1), np.repeat(np.arange(len(b_lengths)), b_lengths), one,
                  len(b_lengths))
    return row_products(tokens_a, bytes_b)


def groups_of(links: Csr, a_lengths: np.ndarray, b_lengths: np.ndarray):
    """The group of every token of A and of B: a link whose tokens both end ends its group."""
    row = np.repeat(np.arange(len(links.starts) - 1), np.diff(links.starts))
    ends = np.cumsum(a_lengths)[row] == np.cumsum(b_lengths)[links.indices]
    group = np.cumsum(ends) - ends
    of_b = np.empty(len(b_lengths), np.int64)
    of_b[links.indices[::-1]] = group[::-1]
    return group[links.starts[:-1]], of_b, int(ends.sum())


# --------------------------------------------------------------------------
# vocabularies
# --------------------------------------------------------------------------

def byte_letters() -> dict[str, int]:
    """Byte-level vocabularies' letters: printable bytes stand for themselves, the
    others for the letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabularies:
    """Both tokenizers, from the bytes of their files."""

    def __init__(self, json_file: bytes, model_file: bytes, pattern: str):
        import sentencepiece
        import tiktoken
        letters = byte_letters()
        vocabulary = json.loads(json_file)
        special = {x["content"] for x in vocabulary["added_tokens"]}
        ranks = {bytes([letters[c] for c in token]): i
                 for token, i in vocabulary["model"]["vocab"].items() if token not in special}
        self.encode_a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks,
                                          special_tokens={}).encode_ordinary
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_a[i] = token
        pieces = sentencepiece.SentencePieceProcessor(model_proto=model_file)
        self.encode_b = pieces.encode
        self.bytes_b = [self._piece(pieces.id_to_piece(i)) for i in range(pieces.get_piece_size())]
        self.lengths_a = np.array([len(x) for x in self.bytes_a])
        self.lengths_b = np.array([len(x) for x in self.bytes_b])
        self.first_b = 3 * len(self.bytes_a)
        self.decimals = [f"{i}{mark}" for side in (self.bytes_a, self.bytes_b)
                         for mark in (",", "|" if side is self.bytes_a else ";", "")
                         for i in range(len(side))]

    @staticmethod
    def _piece(piece: str) -> bytes:
        if re.fullmatch("<0x[0-9A-F]{2}>", piece):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()


_VOCABULARIES: dict[str, Vocabularies] = {}


def vocabularies(files: tuple[bytes, bytes], pattern: str) -> Vocabularies:
    key = hashlib.sha256(b"".join(files) + pattern.encode()).hexdigest()
    if key not in _VOCABULARIES:
        _VOCABULARIES[key] = Vocabularies(*files, pattern)
    return _VOCABULARIES[key]


# --------------------------------------------------------------------------
# a slice of texts
# --------------------------------------------------------------------------

class Slice(NamedTuple):
    """Aligned texts: a row of counts (n_a, n_b, n_groups, n_links) and a string each, and
    each text's pairs of ids with their links."""
    counts: np.ndarray
    strings: list[str]
    n_pairs: np.ndarray
    pairs: np.ndarray
    links: np.ndarray


def _group_string(voc: Vocabularies, ids_a, ids_b, of_a, of_b, ends_a, ends_b) -> list[str]:
    """Each text's ids as ``a1,a2|b1;a3|b2``: A's and B's tokens in group order."""
    def marks(groups, ends):
        last = np.zeros(len(groups), np.int64)
        last[:-1] = groups[1:] != groups[:-1]
        last[ends[ends > 0] - 1] = 1
        return last
    last_a, last_b = marks(of_a, ends_a), marks(of_b, ends_b)
    last_b[ends_b[ends_b > 0] - 1] = 2           # nothing follows the text's last token
    codes = np.concatenate([last_a * len(voc.bytes_a) + ids_a,
                            voc.first_b + last_b * len(voc.bytes_b) + ids_b])
    order = np.argsort(np.concatenate([of_a * 2, of_b * 2 + 1]), kind="stable")
    words, out, start = codes[order].tolist(), [], 0
    decimal = voc.decimals.__getitem__
    for end in (ends_a + ends_b).tolist():
        out.append("".join(map(decimal, words[start:end])))
        start = end
    return out


def align_texts(voc: Vocabularies, texts: list[str | None]) -> Slice:
    """Tokens, groups and links of the texts, all in one set of matrices."""
    ids_a, ids_b, sizes = [], [], np.zeros((len(texts), 2), np.int64)
    spoken = [i for i, text in enumerate(texts) if text]
    for i, b in zip(spoken, voc.encode_b([texts[i] for i in spoken], num_threads=1)):
        whole = " " + texts[i]
        a = voc.encode_a(whole)
        raw = whole.encode("utf-8", "replace")
        if (b"".join([voc.bytes_a[t] for t in a]) == raw
                and b"".join([voc.bytes_b[t] for t in b]) == raw):
            ids_a += a
            ids_b += b
            sizes[i] = len(a), len(b)
    a, b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
    lengths_a, lengths_b = voc.lengths_a[a], voc.lengths_b[b]
    of_a, of_b, n_groups = groups_of(overlap_links(lengths_a, lengths_b), lengths_a, lengths_b)
    ends = np.cumsum(sizes, axis=0)
    text_of = np.repeat(np.arange(len(texts)), sizes[:, 0])
    # Rows: the distinct A ids of each text.  A group lies in one text, so B's ids need no text.
    keys, row = np.unique(text_of * len(voc.bytes_a) + a, return_inverse=True)
    links = row_products(csr(row, of_a, len(keys), max(1, n_groups)),
                         csr(of_b, b, n_groups, len(voc.bytes_b)))
    of_pair = np.repeat(keys, np.diff(links.starts))
    text_of_pair = of_pair // len(voc.bytes_a)
    counts = np.zeros((len(texts), 4), np.int64)
    counts[:, :2] = sizes
    first = np.flatnonzero(np.concatenate([[True], of_a[1:] != of_a[:-1]])) if len(of_a) else []
    counts[:, 2] = np.bincount(text_of[first], minlength=len(texts)) if len(of_a) else 0
    np.add.at(counts[:, 3], text_of_pair, links.data)
    return Slice(counts, _group_string(voc, a, b, of_a, of_b, ends[:, 0], ends[:, 1]),
                 np.bincount(text_of_pair, minlength=len(texts)),
                 (of_pair % len(voc.bytes_a) << PAIR_BITS) + links.indices, links.data)


# --------------------------------------------------------------------------
# on Spark
# --------------------------------------------------------------------------

_LONGS = T.ArrayType(T.LongType())
_BLOCK = T.StructType([
    T.StructField("block", T.LongType()),
    T.StructField("pairs", T.BinaryType()),          # the block's distinct pairs, ascending
    T.StructField("docs", T.BinaryType()),           # how many of its documents hold each
    T.StructField("numbers", T.BinaryType()),        # each document's pairs, as places in pairs
    T.StructField("links", T.BinaryType()),          # and the links of each
    T.StructField("doc_ids", _LONGS),
    T.StructField("counts", _LONGS),                 # n_a, n_b, n_groups, n_links, n_pairs each
    T.StructField("digests", T.ArrayType(T.StringType())),
])
_PAIRS = T.StructType([
    T.StructField("block", T.LongType()),
    T.StructField("pair", T.LongType()),
    T.StructField("docs", T.LongType()),
])
_RESULT = T.StructType([
    T.StructField("doc_id", T.LongType()),
    *[T.StructField(c, T.LongType()) for c in
      ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")],
    T.StructField("groups_sha256", T.StringType()),
])


def _packed(numbers: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(numbers, np.int64).tobytes(), 3)


def _longs(packed: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(packed), np.int64)


def _blocks(files, pattern: str, block_chars: int, slice_chars: int):
    """Batches of (id, text) to a row a block of documents."""

    def block_row(block, ids, slices):
        pairs, at, docs = np.unique(np.concatenate([s.pairs for s in slices]),
                                    return_inverse=True, return_counts=True)
        counts = np.concatenate([np.column_stack([s.counts, s.n_pairs]) for s in slices])
        return table_of([(
            block, _packed(pairs), _packed(docs), zstandard.compress(planes(at), 3),
            _packed(np.concatenate([s.links for s in slices])), ids, counts.ravel().tolist(),
            [d for s in slices for d in s.strings])], _BLOCK).to_batches()

    def run(batches):
        from pyspark import TaskContext
        block = TaskContext.get().partitionId() << 32
        voc = vocabularies(files.value, pattern)
        ids, slices, chars = [], [], 0
        texts, waiting = [], 0

        def close():
            found = align_texts(voc, texts)
            slices.append(found._replace(strings=[
                hashlib.sha256(s.encode()).hexdigest() if s else "" for s in found.strings]))

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                size = len(text or "")
                if texts and waiting + size > slice_chars:
                    close()
                    texts, waiting = [], 0
                if ids and chars + size > block_chars:
                    if texts:
                        close()
                        texts, waiting = [], 0
                    yield from block_row(block, ids, slices)
                    block += 1
                    ids, slices, chars = [], [], 0
                ids.append(doc_id)
                texts.append(text)
                waiting, chars = waiting + size, chars + size
        if ids:
            if texts:
                close()
            yield from block_row(block, ids, slices)

    return run


def _pair_rows(batches):
    """A block's packed pairs to rows."""
    for batch in batches:
        for block, pairs, docs in zip(*(c.to_pylist() for c in batch.columns)):
            pairs = _longs(pairs)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(pairs), block)), pa.array(pairs), pa.array(_longs(docs))],
                names=_PAIRS.names)


def _finish(counted: pa.Table, blocks: pa.Table) -> pa.Table:
    """A block's pairs with their counts, and its documents' pairs, to the documents' rows."""
    if not blocks.num_rows:
        return table_of([], _RESULT)
    order = np.argsort(counted.column("pair").to_numpy())
    count = counted.column("docs").to_numpy()[order]
    best = counted.column("best").to_numpy()[order]
    row = {c: blocks.column(c)[0].as_py() for c in blocks.column_names}
    own = np.array(row["counts"], np.int64).reshape(-1, 5)
    at, links = unplaned(zstandard.decompress(row["numbers"])), _longs(row["links"])
    ends = np.concatenate([[0], np.cumsum(own[:, 4])])

    def sums(values):
        total = np.concatenate([[0], np.cumsum(values)])
        return total[ends[1:]] - total[ends[:-1]]

    best_links = sums(links * best[at]) if len(at) else np.zeros(len(own), np.int64)
    count_sum = sums(links * count[at]) if len(at) else np.zeros(len(own), np.int64)
    return pa.Table.from_arrays(
        [pa.array(row["doc_ids"], pa.int64()), *(pa.array(own[:, i].copy()) for i in range(4)),
         pa.array(best_links), pa.array(count_sum), pa.array(row["digests"], pa.string())],
        names=_RESULT.names)


def align_documents(docs: DataFrame, json_file: str, model_file: str, pattern: str,
                    doc_id: str = "doc_id", text: str = "text",
                    block_chars: int = BLOCK_CHARS, slice_chars: int = SLICE_CHARS,
                    blocks_a_salt: int = BLOCKS_A_SALT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row."""
    files = docs.sparkSession.sparkContext.broadcast(
        tuple(open(path, "rb").read() for path in (json_file, model_file)))
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    blocks = stored(texts.mapInArrow(_blocks(files, pattern, block_chars, slice_chars), _BLOCK),
                    "aligned-blocks")
    pairs = blocks.select("block", "pairs", "docs").mapInArrow(_pair_rows, _PAIRS)
    # An A id has at most as many pairs as B has ids, so this window's groups are bounded.
    same_a = Window.partitionBy(F.shiftright("pair", PAIR_BITS))
    counts = pairs.groupBy("pair").agg(F.sum("docs").alias("docs")).withColumn(
        "best", (F.col("docs") == F.max("docs").over(same_a)).cast("long"))
    # A frequent pair is in every block: its rows are dealt to as many keys as blocks need.
    salts = 1 + blocks.count() // blocks_a_salt
    counts = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    own = pairs.select("block", "pair", F.pmod(F.hash("block"), F.lit(salts)).alias("salt"))
    counted = own.join(counts, ["pair", "salt"]).select("block", "pair", "docs", "best")
    return (counted.groupBy("block").cogroup(blocks.drop("pairs", "docs").groupBy("block"))
            .applyInArrow(_finish, _RESULT))


def align_public(docs: DataFrame) -> DataFrame:
    """The operator with the public byte-level BPE (A) and piece BPE (B) vocabularies."""
    public = public_tokenizers()
    return align_documents(docs, public.path("byte_bpe_50k.json"),
                           public.path("piece_bpe_32k.model"), public.PATTERN)
