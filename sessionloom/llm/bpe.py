"""Byte-level BPE encoding and decoding with tiktoken and a local file of ranks.

The file has a line per token: base64 of its bytes, a space, its rank. Every match of the pattern
is merged by itself, so a long text may be cut wherever a match must begin: before white space
that follows something else. Decoding joins the bytes of the tokens; they need not be UTF-8.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import Batches, map_batches, slices

#: Characters of a text that are encoded at once, at least; it goes on to the next safe boundary.
CHUNK_CHARS = 1 << 18
#: Bytes of text whose tokens a task holds at once.
BATCH_BYTES = 4 << 20
#: Rows that are decoded at once.
DECODE_ROWS = 500

_BOUNDARY = regex.compile(r"(?<=\S)(?=\s)")


@functools.lru_cache(maxsize=4)
def encoding(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    """One per Python worker."""
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in f if x.strip())}
    return tiktoken.Encoding(ranks_path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = CHUNK_CHARS):
    """The text in parts of at least size characters, cut where every match begins anew.

    No match of the pattern holds white space after anything else, and none looks back, so the
    parts have the matches of the whole. Without such a place the text stays whole.
    """
    start = 0
    while len(text) - start > size:
        cut = _BOUNDARY.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(text: str, enc: tiktoken.Encoding) -> np.ndarray:
    parts = [np.array(enc.encode_ordinary(part), np.int32) for part in pieces(text)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows) if rows else np.empty(0, np.int32)))


def _encoder(ranks_path: str, pattern: str):
    def run(batches: Batches) -> Batches:
        enc = encoding(ranks_path, pattern)
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                ids = [encode_text(x or "", enc) for x in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(ids)], ["doc_id", "ids"])

    return run


def _decoder(ranks_path: str, pattern: str):
    def run(batches: Batches) -> Batches:
        enc = encoding(ranks_path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, DECODE_ROWS):
                batch = whole.slice(at, DECODE_ROWS)
                data = [enc.decode_bytes(x.values.to_pylist() if x.is_valid else []) for x in batch.column("ids")]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(data, pa.binary())], ["doc_id", "ids", "data"])

    return run


def _own(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids): the tokens of every text; an empty or NULL text has none.

    A row for each input row, repeated rows included; a NULL doc_id stays NULL. Special tokens'
    strings are ordinary text. Columns other than doc_id and text aren't looked at.
    """
    return map_batches(_own(docs), _encoder(ranks_path, pattern), "doc_id long, ids array<int>")


def decode(tokens: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, data): the bytes that the tokens stand for, joined; NULL ids are none."""
    return map_batches(tokens.select("doc_id", "ids"), _decoder(ranks_path, pattern), "doc_id long, ids array<int>, data binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """decode(encode(docs)), both in the same Python worker."""
    first, then = _encoder(ranks_path, pattern), _decoder(ranks_path, pattern)
    return map_batches(_own(docs), lambda batches: then(first(batches)), "doc_id long, ids array<int>, data binary")


def token_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """What encode and decode give for every document, as counts and digests."""
    return round_trip(docs, ranks_path, pattern).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("data"), 256).alias("decoded_sha256"),
    )
