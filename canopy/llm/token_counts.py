"""Token counts (2): prefix dynamic programming over a BPE vocabulary.

For one pre-token the program stores, for every byte prefix, the last token of that prefix's encoding and its exact
token count. A prefix of length i ends in the one token t whose predecessor (the last token of the prefix of length
i - len(t)) may stand before it: merging the two alone gives the same two tokens back. So count[i] is
count[i - len(t)] + 1, no merge list is replayed for a prefix, and counts of cut texts are look-ups.

A vocabulary with an end-of-word mark has two counts for a prefix: "open" (the word goes on) and "closed" (the word
ends here, so its last symbol carries the mark).

Results for special cases: null or empty text has 0 tokens; white space alone has 0; strings of special tokens inside
a text count as the library counts them by default (one token each). Repeated rows give repeated results. Other
columns of the input are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import by_rows, whole_text, worker_memo

SCHEMA = "n_bytes long, n_tokens long, n_units long, fit_units long, fit_tokens long, prefix_ends array<int>, prefix_counts array<int>"
MEMO_WORDS = 400_000


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letters = {b: chr(b) for b in plain}
    letters |= {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in letters)}
    return letters


class PrefixCounter:
    """Exact token counts for every prefix of a pre-token."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.mark = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(a, b): n for n, (a, b) in enumerate(pairs)}
        self.parts = {a + b: (a, b) for a, b in reversed(pairs)}
        self.longest = max(map(len, self.vocab))
        self.letters = [byte_letters()[b] for b in range(256)]
        self.fits: dict[tuple[str, str], bool] = {}

    def may_follow(self, left: str, right: str) -> bool:
        """Whether left, right is itself an encoding: no merge across the seam comes before those that made the two."""
        found = self.fits.get((left, right))
        if found is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            found = self.fits[left, right] = self._seam(left, right)
        return found

    def _seam(self, left: str, right: str) -> bool:
        # At each step undo the later of the two outer merges; a pair at the seam with a lower rank than that one
        # would have been merged first.
        limit = len(self.rank)
        while True:
            met = self.rank.get((left, right))
            if met is not None and met < limit:
                return False
            a, b = self.parts.get(left), self.parts.get(right)
            ra = self.rank[a] if a else -1
            rb = self.rank[b] if b else -1
            if ra < 0 and rb < 0:
                return True
            # Equal ranks are merged from the left: the seam's pair comes before the right token's, after the left one's.
            if ra > rb:
                limit, left = ra, a[1]
            else:
                limit, right = rb + 1, b[0]

    def prefixes(self, word: str) -> tuple[list[int], list[int]]:
        """open[i] and closed[i]: tokens of the first i byte letters when the word goes on, and when it ends there."""
        size, mark = len(word), self.mark
        last: list[str] = [""] * (size + 1)
        open_, closed = [0] * (size + 1), [0] * (size + 1)
        for i in range(1, size + 1):
            for width in range(min(i, self.longest), 0, -1):
                token = word[i - width : i]
                if token in self.vocab and (i == width or (last[i - width] and self.may_follow(last[i - width], token))):
                    last[i], open_[i] = token, open_[i - width] + 1
                    break
            closed[i] = open_[i] if not mark else self.ending(word, i, last, open_)
        return open_, closed

    def ending(self, word: str, i: int, last: list[str], open_: list[int]) -> int:
        for width in range(min(i, self.longest), 0, -1):
            token = word[i - width : i] + self.mark
            if token in self.vocab and (i == width or (last[i - width] and self.may_follow(last[i - width], token))):
                return open_[i - width] + 1
        raise ValueError(f"the vocabulary cannot end {word[:i]!r}")

    def total(self, word: str) -> int:
        """closed[-1] alone: the word's own count."""
        size = len(word)
        last: list[str] = [""] * (size + 1)
        open_ = [0] * (size + 1)
        stop = size if self.mark else size + 1
        vocab, fits, longest = self.vocab, self.may_follow, self.longest
        for i in range(1, stop):
            for width in range(min(i, longest), 0, -1):
                token = word[i - width : i]
                if token in vocab and (i == width or (last[i - width] and fits(last[i - width], token))):
                    last[i], open_[i] = token, open_[i - width] + 1
                    break
        return self.ending(word, size, last, open_) if self.mark else open_[size]

    def letters_of(self, piece: str) -> str:
        return "".join([self.letters[b] for b in piece.encode()])


def latin_1(pattern: str) -> str:
    r"""The pattern with \p{..} spelt out for the first 256 characters, which the standard library matches faster."""
    chars = [chr(n) for n in range(256)]
    of = {"L": [c for c in chars if unicodedata.category(c)[0] == "L"], "N": [c for c in chars if unicodedata.category(c)[0] == "N"], "White_Space": list("\t\n\v\f\r \x85\xa0")}
    spelt = {k: "".join(rf"\x{ord(c):02x}" for c in v) for k, v in of.items()}

    def put(m: re.Match) -> str:
        inside = pattern[: m.start()].rfind("[") > pattern[: m.start()].rfind("]")
        return spelt[m[1]] if inside else f"[{spelt[m[1]]}]"

    return re.sub(r"\\p\{(\w+)\}", put, pattern)


class TextCounter:
    """Splits texts as the tokenizer file says, and adds up its pre-tokens' prefix counts."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path) as file:
            spec = json.load(file)
        self.words = PrefixCounter(spec)
        self.library = Tokenizer.from_file(path)
        self.specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        steps = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
        pattern = next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split").replace(r"\s", r"\p{White_Space}")
        self.split = regex.compile(pattern)
        self.latin = re.compile(latin_1(pattern))
        self.memo: dict[str, int] = {}

    def pieces(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")  # such texts are in normal form C, and lower case is one letter for one
        except UnicodeEncodeError:
            return self.split.findall(self.library.normalizer.normalize_str(text))
        return self.latin.findall(text.lower())

    def units(self, text: str) -> list[str | None]:
        """The pre-tokens of a text in order; None stands for a special token."""
        if not any(s in text for s in self.specials):
            return self.pieces(text)
        found, start = [], 0
        for m in [*self.special.finditer(text), None]:
            found += self.pieces(text[start : m.start() if m else None])
            if m:
                found.append(None)
                start = m.end()
        return found

    def count(self, unit: str | None) -> int:
        if unit is None:
            return 1
        n = self.memo.get(unit)
        if n is None:
            n = self.words.total(self.words.letters_of(unit))
            if len(unit) <= 64:
                if len(self.memo) >= MEMO_WORDS:
                    self.memo.clear()
                self.memo[unit] = n
        return n

    def table(self, text: str) -> list[int]:
        """table[k]: exact tokens of the first k pre-tokens."""
        units = self.units(text)
        counts = list(map(self.memo.get, units))
        if None in counts:
            counts = [self.count(u) if n is None else n for u, n in zip(units, counts, strict=True)]
        return list(accumulate(counts, initial=0))

    def at_every_prefix(self, text: str) -> list[int]:
        """Exact tokens of text[:k] for every k, for texts that the normaliser leaves as they are."""
        out, base, at = [0], 0, 0
        for m in self.split.finditer(text):
            out += [base] * (m.start() - at)
            word = self.words.letters_of(m[0])
            closed, done = self.words.prefixes(word)[1], 0
            for ch in m[0]:
                done += len(ch.encode())
                out.append(base + closed[done])
            base, at = out[-1], m.end()
        return out + [base] * (len(text) - at)


def text_counter(path: str) -> TextCounter:
    memo = worker_memo("text_counter")
    if path not in memo:
        memo[path] = TextCounter(path)
    return memo[path]


def count_tokens(docs: DataFrame, tokenizer: str, budget: int = 2048, keep_prefixes: bool = False, id_column: str = "doc_id") -> DataFrame:
    """Tokens of every whole text, with the answer to a budget question.

    tokenizer: path of a tokenizers .json file with a Split pattern and byte-level BPE, on every executor.
    fit_units, fit_tokens: how many leading pre-tokens fit in budget, and their tokens (all of them if the text fits).
    prefix_ends and prefix_counts (if keep_prefixes): number of pre-tokens 0, 1, 2, ... and the tokens of so many, for
    `tokens_within` to answer any other budget without encoding again; else null.
    """
    from bisect import bisect_right

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = text_counter(tokenizer)
        for frame in by_rows(frames):
            rows = []
            for text in frame["_text"]:
                table = counter.table(text)
                fit = bisect_right(table, budget) - 1
                rows.append((len(text.encode()), table[-1], len(table) - 1, fit, table[fit], list(range(len(table))) if keep_prefixes else None, table if keep_prefixes else None))
            out = pd.DataFrame(rows, columns=[c.split(" ")[0] for c in SCHEMA.split(", ")])
            out.insert(0, id_column, frame[id_column].to_numpy())
            yield out

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, whole_text().alias("_text")).mapInPandas(count, f"`{id_column}` {kind}, {SCHEMA}")


def tokens_within(counted: DataFrame, budget: int) -> DataFrame:
    """For each row of count_tokens(keep_prefixes=True): the leading pre-tokens within another budget, as units_within."""
    within = F.size(F.filter("prefix_counts", lambda n: n <= budget)) - 1
    return counted.withColumn("units_within", within)
