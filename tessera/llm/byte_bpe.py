"""Byte-level BPE encoding and decoding.

Pre-tokenisation is vectorised. Each codepoint of a batch gets a class (letter, number, space, other). The splitting
automaton's transition functions are of two kinds: a codepoint of another class than its predecessor is a constant
function (a new run begins here, whatever was before) and one of the same class is the identity, so composing them is
the associative "last constant wins", which is scanned with maximum.accumulate; the lookahead of white space and the
contractions are functions of bounded neighbourhoods, applied to the scanned states. No regular expression runs.
The slices go to pair merging behind a bounded cache; byte offsets of all slices stay for decoding and spans.

Cases: null text is empty: no ids, and the sha256 of the empty string; a text may be of any length (it is one slice of
its own); repeated rows give repeated results; extra columns are ignored by the query and kept by `encode`'s caller
through doc_id; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import slices, table, utf8

LETTER, NUMBER, SPACE, OTHER = range(4)
_WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Pieces that a worker's cache holds; a full cache starts anew.
CACHE_PIECES = 400_000
_classes: np.ndarray | None = None
_coders: dict[str, "Coder"] = {}


def classes() -> np.ndarray:
    """The class of every codepoint."""
    global _classes
    if _classes is None:
        kinds = {"L": LETTER, "N": NUMBER}
        _classes = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
        _classes[_WHITE] = SPACE
    return _classes


def boundaries(points: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Starts of the pieces of texts laid end to end; heads marks each text's first codepoint."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    last = np.append(heads[1:], True)
    run = heads.copy()
    run[1:] |= kind[1:] != kind[:-1]
    start = run.copy()
    # White space before something else: its last codepoint stands alone, or joins what follows if it is a blank.
    space = kind == SPACE
    leaves = space & ~last
    leaves[:-1] &= ~space[1:]
    start |= leaves
    joined = np.zeros(n, bool)
    joined[1:] = (leaves & (points == 0x20))[:-1]
    start &= ~joined
    # Contractions: an apostrophe that begins a piece, with its letters after it.
    run_at = np.maximum.accumulate(np.where(run, np.arange(n), 0))
    at = np.flatnonzero((points == 0x27) & start & run & ~last)
    if len(at):
        pad = np.concatenate((points, np.zeros(3, points.dtype)))
        inside = np.concatenate((run_at, np.full(3, -1)))
        one, two = pad[at + 1], pad[at + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        pair = (inside[at + 2] == at + 1) & np.isin(one.astype(np.uint64) << np.uint64(32) | two, [ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")])
        for found, length in ((short, 2), (pair & ~short, 3)):
            a = at[found]
            start[a + 1] = False
            after = a + length
            start[after[after < n]] = True
    return np.flatnonzero(start)


def merge_pairs(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Join the neighbouring pair of least rank until none is left."""
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if rank == 1 << 60:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


class Coder:
    """Ranks of one vocabulary file, its cache of pieces and its table of token bytes."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.cache: dict[bytes, tuple[str, list[int]]] = {}
        self.merge = tiktoken.Encoding("ranks", pat_str=".", mergeable_ranks=self.ranks, special_tokens={})._core_bpe.encode_single_piece

    def piece(self, piece: bytes) -> tuple[str, list[int]]:
        if len(self.cache) >= CACHE_PIECES:
            self.cache.clear()
        ids = self.merge(piece)
        found = " ".join(map(str, ids)), ids
        if len(piece) <= 64:
            self.cache[piece] = found
        return found

    def encode(self, texts: bytes, offsets: np.ndarray) -> list[tuple[list, np.ndarray]]:
        """For each text of UTF-8 laid end to end: its pieces' (decimal ids, ids) and byte offsets."""
        points = np.frombuffer(texts.decode("utf-8").encode("utf-32-le"), np.uint32)
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        byte_at = np.concatenate(([0], np.cumsum(width)))
        heads = np.zeros(len(points) + 1, bool)
        heads[np.searchsorted(byte_at, offsets)] = True
        at = byte_at[boundaries(points, heads[:-1])]
        edges = [*at.tolist(), len(texts)]
        get, miss = self.cache.get, self.piece
        found = [get(p) or miss(p) for p in (texts[a:b] for a, b in zip(edges, edges[1:]))]
        cut = np.searchsorted(at, offsets)
        return [(found[a:b], np.append(at[a:b], e) - s) for a, b, s, e in zip(cut, cut[1:], offsets, offsets[1:])]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def coder(path: str) -> Coder:
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int>, piece_ends array<int> (byte offsets of the pieces' ends in the text)."""

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in slices(offsets):
                rows = coder(path).encode(data[offsets[a] : offsets[b]].tobytes(), offsets[a : b + 1] - offsets[a])
                ids = [list(chain.from_iterable(x[1] for x in found)) for found, _ in rows]
                ends = [edges[1:].tolist() if len(found) else [] for found, edges in rows]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(ids, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))], ["doc_id", "ids", "piece_ends"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, piece_ends array<int>")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode every text; what comes out as digests, so that ids need not leave the worker."""

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in slices(offsets):
                c = coder(path)
                n, ids_sha, text_sha = [], [], []
                for found, _ in c.encode(data[offsets[a] : offsets[b]].tobytes(), offsets[a : b + 1] - offsets[a]):
                    ids = list(chain.from_iterable(x[1] for x in found))
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(" ".join([x[0] for x in found]).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
