"""Byte-level BPE encoding and decoding with tiktoken and a local rank file."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts longer than this many characters are encoded piece by piece.
PIECE_CHARS = 1 << 16

#: A match of the pattern never spans a place where white space follows
#: something that is not white space: only its first character can be a space,
#: and its white-space runs look ahead no further than the next character.
SAFE_CUT = re.compile(r"(?<=\S)(?=\s)")

_codecs: dict[tuple[str, str], tuple] = {}


def load_codec(rank_path: str, pattern: str):
    """``(tiktoken encoding, bytes of each id)``, kept per process."""
    key = (rank_path, pattern)
    if key not in _codecs:
        import tiktoken

        with open(rank_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        table: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for raw, i in ranks.items():
            table[i] = raw
        _codecs[key] = (enc, table)
    return _codecs[key]


def safe_pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Cut a long text where every match of the pattern ends anyway.  A text
    without such a place stays whole."""
    lo = 0
    while len(text) - lo > size:
        m = SAFE_CUT.search(text, lo + size)
        if m is None:
            break
        yield text[lo : m.start()]
        lo = m.start()
    yield text[lo:]


def encode_text(text: str | None, rank_path: str, pattern: str) -> np.ndarray:
    """Ids of one text (null: empty) as unsigned 32-bit integers."""
    enc, _ = load_codec(rank_path, pattern)
    text = text or ""
    if len(text) <= PIECE_CHARS:
        return enc.encode_to_numpy(text, disallowed_special=())
    return np.concatenate([enc.encode_to_numpy(p, disallowed_special=()) for p in safe_pieces(text)])


def decode_ids(ids, rank_path: str, pattern: str) -> bytes:
    """Raw bytes of ids, not checked for being UTF-8: a cut id list may end
    inside a character.  An id without a rank raises."""
    _, table = load_codec(rank_path, pattern)
    return b"".join([table[i] for i in (ids.tolist() if hasattr(ids, "tolist") else ids)])


def encode(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests_only: bool = False) -> DataFrame:
    """Encode every text and decode the ids again.

    Returns ``id, n_tokens, ids, decoded`` or, with ``digests_only``, ``id,
    n_tokens, ids_sha256, decoded_sha256``.  Null and empty texts have no ids;
    repeated rows give repeated rows; other columns of ``docs`` are not read.
    Narrow: no exchange, memory bounded by one Arrow batch and one text.
    """
    if digests_only:
        fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
        ddl = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    else:
        fields = [("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())]
        ddl = "n_tokens long, ids array<int>, decoded binary"

    def run(batches):
        for batch in batches:
            counts, left, right = [], [], []
            for text in batch.column(1):
                ids = encode_text(text.as_py(), rank_path, pattern)
                raw = decode_ids(ids, rank_path, pattern)
                counts.append(len(ids))
                if digests_only:
                    left.append(hashlib.sha256(ids.astype("<u4", copy=False).tobytes()).hexdigest())
                    right.append(hashlib.sha256(raw).hexdigest())
                else:
                    left.append(ids.astype(np.int32))
                    right.append(raw)
            cols = [batch.column(0)] + [pa.array(v, type=t) for v, (_, t) in zip((counts, left, right), fields, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, names=["__id", *(n for n, _ in fields)])

    src = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    kind = src.schema["__id"].dataType.simpleString()
    return src.mapInArrow(run, f"__id {kind}, {ddl}").withColumnRenamed("__id", id_col)
