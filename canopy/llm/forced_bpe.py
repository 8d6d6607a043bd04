r"""BPE encoding and decoding (12): fragments between forced boundaries.

Two bytes that stand side by side inside no token of the vocabulary can't be merged: no token of any encoding spans
them, so what lies before and after is encoded on its own. All such places of a text are found at once in the bytes
(`cuts`). As the tokenizer also splits a text by its pattern before merging, a place counts only where a cut can't
change what the pattern matches: at the start of a character, not after white space (the pattern looks ahead over it)
and not next to an apostrophe (contractions). Special tokens are tokens of the vocabulary here, so none is cut.

Fragments (mostly words) repeat, so each worker remembers the ids of the ones that it has met, up to a fixed number;
others go to the tokenizers library. Ids of the fragments are concatenated. Decoding concatenates the tokens' bytes.

Texts of at most `long_chars` are coded inside their task. Longer ones are cut at forced boundaries into parts of about
`part` bytes, which are rows of their own, dealt to all tasks; a text's parts are concatenated in SQL.

Results for special cases: null or empty text has no ids; special strings in a text become their own ids, as the
library does by default; text without any forced boundary is one fragment. Repeated rows give repeated results (rows of
one id are kept apart by a row number). An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import by_rows, whole_text, worker_memo

LONG, PART = 262_144, 65_536
#: Fragments that a worker remembers: so many, of at most so many bytes.
MEMO, MEMO_BYTES = 200_000, 64
APOSTROPHE = ord("'")


def byte_letters() -> dict[str, int]:
    """Which byte each letter of a byte-level vocabulary stands for: printable bytes for themselves, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


class Coder:
    """A byte-level BPE tokenizer file, its table of byte pairs, and what this worker remembers."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        before = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or spec["model"]["type"] != "BPE":
            raise ValueError(f"{path}: not a byte-level BPE without normal form and prefix")
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        letters = byte_letters()
        self.tokens = {i: bytes(letters[c] for c in token) for token, i in spec["model"]["vocab"].items()}
        self.tokens |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        self.inside = np.zeros((256, 256), bool)
        for token in self.tokens.values():
            each = np.frombuffer(token, np.uint8)
            self.inside[each[:-1], each[1:]] = True
        self.memo: dict[bytes, bytes] = {}

    def cuts(self, raw: bytes) -> np.ndarray:
        """The places (bytes before them) where a cut changes nothing."""
        b = np.frombuffer(raw, np.uint8)
        if len(b) < 2:
            return np.empty(0, np.int64)
        left, right = b[:-1], b[1:]
        sure = ~self.inside[left, right] & ((right & 0xC0) != 0x80) & (left != APOSTROPHE) & (right != APOSTROPHE)
        sure &= ~((left == 32) | ((left >= 9) & (left <= 13)) | ((left >= 28) & (left <= 31)))
        sure[1:] &= b[:-2] != APOSTROPHE
        # White space of two and three bytes; a few other characters that share these bytes aren't cut after either.
        sure[1:] &= ~((b[:-2] == 0xC2) & ((b[1:-1] == 0x85) | (b[1:-1] == 0xA0)))
        sure[2:] &= ~(((b[:-3] == 0xE1) & (b[1:-2] == 0x9A)) | ((b[:-3] == 0xE2) & ((b[1:-2] == 0x80) | (b[1:-2] == 0x81))) | ((b[:-3] == 0xE3) & (b[1:-2] == 0x80)))
        return np.flatnonzero(sure) + 1

    def fragments(self, raw: bytes) -> list[bytes]:
        ends = [*self.cuts(raw).tolist(), len(raw)]
        return [raw[a:z] for a, z in zip([0, *ends], ends, strict=False)] if raw else []

    def encode(self, raw: bytes) -> bytes:
        """The ids of a text's UTF-8, as 32-bit integers."""
        parts, memo = self.fragments(raw), self.memo
        try:
            return b"".join(map(memo.__getitem__, parts))
        except KeyError:
            pass
        if len(memo) > MEMO:
            memo.clear()
        new = list(set(parts).difference(memo))
        coded = self.library.encode_batch([x.decode() for x in new], add_special_tokens=False)
        own = {x: np.asarray(c.ids, np.int32).tobytes() for x, c in zip(new, coded, strict=True)}
        memo.update((x, ids) for x, ids in own.items() if len(x) <= MEMO_BYTES)
        return b"".join(own[x] if x in own else memo[x] for x in parts)

    def decode(self, ids: np.ndarray) -> str:
        """The tokens' bytes concatenated, as text; unknown ids count for nothing."""
        return b"".join([self.tokens.get(i, b"") for i in ids.tolist()]).decode("utf-8", "replace")


def coder(path: str) -> Coder:
    memo = worker_memo("forced_bpe")
    if path not in memo:
        memo[path] = Coder(path)
    return memo[path]


def parts_of(raw: bytes, places: np.ndarray, part: int) -> list[bytes]:
    """raw cut at the first of the places after each `part` bytes."""
    out, start = [], 0
    while start < len(raw):
        n = np.searchsorted(places, start + part)
        end = int(places[n]) if n < len(places) else len(raw)
        out.append(raw[start:end])
        start = end
    return out


def encode(docs: DataFrame, path: str, long_chars: int = LONG, part: int = PART, id_column: str = "doc_id") -> DataFrame:
    """One row a text: id, n_tokens (long), ids (array<int>), decoded (the text of these ids)."""
    kind = docs.schema[id_column].dataType.simpleString()
    source = docs.select(F.col(id_column), whole_text().alias("_text"))

    def coded(frame: pd.DataFrame, raws: list[bytes]) -> pd.DataFrame:
        own = coder(path)
        ids = [np.frombuffer(own.encode(raw), np.int32) for raw in raws]
        return frame.assign(ids=ids, decoded=[own.decode(x) for x in ids])

    def short(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in by_rows(frames, 256):
            yield coded(frame[[id_column]], [t.encode() for t in frame["_text"]])

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in by_rows(frames, 1):
            raw = frame["_text"].iloc[0].encode()
            pieces = parts_of(raw, coder(path).cuts(raw), part)
            for n in range(0, len(pieces), 16):
                rows = frame[[id_column, "_row"]].loc[frame.index.repeat(len(pieces[n : n + 16]))]
                yield rows.assign(_at=range(n, n + len(rows)), _piece=pieces[n : n + 16])

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in by_rows(frames, 16):
            yield coded(frame[[id_column, "_row", "_at"]], list(frame["_piece"]))

    few = source.where(F.length("_text") <= long_chars).mapInPandas(short, f"`{id_column}` {kind}, ids array<int>, decoded string")
    many = source.where(F.length("_text") > long_chars).withColumn("_row", F.monotonically_increasing_id())
    pieces = many.mapInPandas(cut, f"`{id_column}` {kind}, _row long, _at long, _piece binary").repartition("_row", "_at")
    pieces = pieces.mapInPandas(each, f"`{id_column}` {kind}, _row long, _at long, ids array<int>, decoded string")
    ordered = pieces.groupBy("_row").agg(F.first(id_column).alias(id_column), F.array_sort(F.collect_list(F.struct("_at", "ids", "decoded"))).alias("p"))
    whole = ordered.select(id_column, F.flatten("p.ids").alias("ids"), F.array_join("p.decoded", "").alias("decoded"))
    return few.unionByName(whole).select(id_column, F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")
