"""Byte-level BPE encoding and decoding (9): overlapping chunks, stitched where pre-token boundaries agree.

A text is cut into chunks that overlap. Each chunk is pre-tokenised on its own. What the pattern matches from a
boundary on depends on the text after it alone, so the first boundary that two neighbours share inside their overlap
(and that the end of the first chunk cannot have moved) joins them: from there on their pre-tokens are the same. A
joint stands after a character that is no white space, as a pattern may treat white space at the end of a text unlike
white space before a word. The stretches between such joints are encoded with the merge ranks, and decoding
concatenates the bytes of the ids.

Texts of at most `long_chars` are chunked inside their task. Longer ones become rows, a chunk each, that are dealt to
all tasks for pre-tokenising; a second step brings a document's chunks together, joins and encodes them.

Results for special cases: null or empty text has no ids; strings of special tokens are ordinary text; if two chunks
share no boundary (one pre-token spans the whole overlap) their texts are taken together and matched again. Repeated
rows give repeated results; rows of one id are kept apart by a row number of their own. Other columns are ignored.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import by_rows, whole_text, worker_memo

CHUNK, OVERLAP, LONG = 8192, 512, 65536


def rank_encoder(path: str, pattern: str):
    """The library's encoder for a rank file; one for each worker."""
    memo = worker_memo("rank_encoder")
    if (path, pattern) not in memo:
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        memo[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return memo[path, pattern]


def chunks(text: str, chunk: int, overlap: int) -> list[tuple[int, str]]:
    """(start, piece): each piece holds the first `overlap` characters of the next."""
    return [(start, text[start : start + chunk + overlap]) for start in range(0, max(1, len(text)), chunk)]


def boundaries(piece: str, pattern) -> list[int]:
    return [m.end() for m in pattern.finditer(piece)]


def joints(parts: list[tuple[int, str, list[int]]], chunk: int, overlap: int, pattern) -> list[str]:
    """The stretches of the text between the places where neighbouring chunks agree.

    parts: (start, piece, boundaries within the piece) in order. A boundary of the earlier chunk counts only while two
    more follow it there: the last pre-tokens of a piece may be cut off by its end.
    """
    out: list[str] = []
    start, piece, ends = parts[0]
    begin = 0  # within piece
    for next_start, next_piece, next_ends in parts[1:]:
        shift = next_start - start
        sure = {e - shift for e in ends[:-2] if e >= shift and e > begin}
        meet = next((e for e in next_ends if e in sure and e <= overlap and not next_piece[e - 1].isspace()), None)
        if meet is None:
            piece = piece[:shift] + next_piece
            ends = [begin + e for e in boundaries(piece[begin:], pattern)]
            continue
        out.append(piece[begin : shift + meet])
        start, piece, ends, begin = next_start, next_piece, next_ends, meet
    out.append(piece[begin:])
    return out


def encode_pieces(pieces: list[str], encoder) -> list[int]:
    ids: list[int] = []
    for piece in pieces:
        ids += encoder.encode_ordinary(piece)
    return ids


def decode(ids: bytes, encoder) -> bytes:
    """The bytes of packed ids, concatenated."""
    return b"".join(map(encoder.decode_single_token_bytes, struct.unpack(f"<{len(ids) // 4}I", ids)))


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def encode(docs: DataFrame, ranks: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, long_chars: int = LONG, id_column: str = "doc_id") -> DataFrame:
    """One row a text: id, n_tokens, ids (binary, little-endian unsigned 32-bit), decoded (binary, from the ids)."""
    kind = docs.schema[id_column].dataType.simpleString()
    out_schema = f"`{id_column}` {kind}, n_tokens long, ids binary, decoded binary"
    source = docs.select(F.col(id_column), whole_text().alias("_text"))

    def finish(keys, pieces_of_rows: list[list[str]]) -> pd.DataFrame:
        encoder = rank_encoder(ranks, pattern)
        packed = [pack(encode_pieces(pieces, encoder)) for pieces in pieces_of_rows]
        return pd.DataFrame({id_column: keys, "n_tokens": [len(p) // 4 for p in packed], "ids": packed, "decoded": [decode(p, encoder) for p in packed]})

    def split_and_join(text: str, rx) -> list[str]:
        return joints([(at, piece, boundaries(piece, rx)) for at, piece in chunks(text, chunk, overlap)], chunk, overlap, rx) if len(text) > chunk else [text]

    def short(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import regex

        rx = regex.compile(pattern)
        for frame in by_rows(frames):
            yield finish(frame[id_column].to_numpy(), [split_and_join(t, rx) for t in frame["_text"]])

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in by_rows(frames, 8):
            for key, row, text in zip(frame[id_column], frame["_row"], frame["_text"], strict=True):
                found = chunks(text, chunk, overlap)
                for n in range(0, len(found), 64):
                    part = found[n : n + 64]
                    yield pd.DataFrame({id_column: [key] * len(part), "_row": row, "_at": [a for a, _ in part], "_piece": [p for _, p in part]}).astype({id_column: frame[id_column].dtype})

    def pre_tokenise(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import regex

        rx = regex.compile(pattern)
        for frame in by_rows(frames, 64):
            yield frame.assign(_ends=[boundaries(p, rx) for p in frame["_piece"]])

    def stitch(group: pd.DataFrame) -> pd.DataFrame:
        import regex

        group = group.sort_values("_at")
        parts = list(zip(group["_at"], group["_piece"], map(list, group["_ends"]), strict=True))
        return finish(group[id_column].to_numpy()[:1], [joints(parts, chunk, overlap, regex.compile(pattern))])

    long_ = source.where(F.length("_text") > long_chars).withColumn("_row", F.monotonically_increasing_id())
    pieces = long_.mapInPandas(cut, f"`{id_column}` {kind}, _row long, _at long, _piece string").repartition(id_column, "_row", "_at")
    pieces = pieces.mapInPandas(pre_tokenise, f"`{id_column}` {kind}, _row long, _at long, _piece string, _ends array<int>")
    whole = pieces.groupBy("_row").applyInPandas(stitch, out_schema)
    return source.where(F.length("_text") <= long_chars).mapInPandas(short, out_schema).unionByName(whole)
