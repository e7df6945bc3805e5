"""Byte-level BPE encoding and decoding as a reduction over a tree of text spans.

Halves of a text are encoded on their own and joined pairwise. A join encodes anew only a window around the seam. The window grows, by
doubling, until it begins and ends at a place where the split pattern must begin a match whatever stands before it: white space after
something else. No alternative of the pattern continues from another character into white space, and a match once begun doesn't look at
what lies before it, so the tokens outside the window are those of the whole text. Decoding concatenates byte strings up the same tree.
Joining is associative, the empty text is its unit, and any shape of tree gives the same ids.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .runtime import bound_batches, local_path, texts_of

#: Characters in a leaf, and in the first window on either side of a seam.
LEAF, WINDOW = 16384, 64
#: Columns of the result.
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long"


@functools.lru_cache(4)
def encoder(rank_file: str, pattern: str):
    """The encoder of a rank file (base64 token and rank a line); the file lies on every node, like the library itself."""
    import tiktoken

    with open(local_path(rank_file) or rank_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _before(text: str, lo: int, at: int, width: int) -> int:
    """The last certain match start in (lo, at), looked for in windows that double; lo if there is none."""
    while True:
        start = max(lo, at - width)
        for i in range(at - 1, start, -1):
            if text[i].isspace() and not text[i - 1].isspace():
                return i
        if start == lo:
            return lo
        width *= 2


def _after(text: str, at: int, hi: int, width: int) -> int:
    """The first certain match start in (at, hi), looked for in windows that double; hi if there is none."""
    while True:
        end = min(hi, at + width)
        for i in range(at + 1, end):
            if text[i].isspace() and not text[i - 1].isspace():
                return i
        if end == hi:
            return hi
        width *= 2


def encode_tree(text: str, encode, leaf: int = LEAF, window: int = WINDOW) -> list[int]:
    """encode(text), from leaves of at most leaf characters."""

    def reduce(lo: int, hi: int) -> list[int]:
        if hi - lo <= leaf:
            return encode(text[lo:hi])
        cut = (lo + hi) // 2
        left, right = reduce(lo, cut), reduce(cut, hi)
        a, b = _before(text, lo, cut, window), _after(text, cut, hi, window)
        old_left, old_right = (encode(text[a:cut]) if a > lo else left), (encode(text[cut:b]) if b < hi else right)
        return left[: len(left) - len(old_left)] + encode(text[a:b]) + right[len(old_right) :]

    return reduce(0, len(text))


def decode_tree(ids: list[int], decode, leaf: int = LEAF) -> bytes:
    """decode(ids): byte strings of halves, concatenated."""
    if len(ids) <= leaf:
        return decode(ids)
    cut = len(ids) // 2
    return decode_tree(ids[:cut], decode, leaf) + decode_tree(ids[cut:], decode, leaf)


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, keep_ids: bool = False, leaf: int = LEAF) -> DataFrame:
    """Ids of each whole text and the bytes they decode to, as digests; with keep_ids also the ids. Columns of docs other than doc_id and
    text are ignored. A null or empty text has no ids; the digests are those of the empty string. Rows are independent of each other:
    repeated rows give repeated results and there is no shuffle. A task holds one Arrow batch and the ids of one text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(rank_file, pattern)
        names = [str(i) for i in range(e.n_vocab)]
        for batch in batches:
            rows = []
            for text in texts_of(batch):
                ids = encode_tree(text, e.encode_ordinary, leaf)
                back = decode_tree(ids, e.decode_bytes, leaf)
                joined = ",".join([names[i] for i in ids]).encode()
                rows.append((len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256(back).hexdigest(), len(back), ids if keep_ids else None))
            n, a, b, size, ids = zip(*rows) if rows else ((),) * 5
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(size, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.list_(pa.int32()))] * keep_ids, names=out)

    out = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"] + ["ids"] * keep_ids
    bound_batches(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA + ", ids array<int>" * keep_ids)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
