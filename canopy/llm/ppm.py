r"""LM scoring (10): prediction by partial matching over bytes.

Training counts every byte with the four before it (a text starts after four line feeds), over all training texts.
Those counts are a byte-context trie: contexts of four bytes, and after an escape of two, one and none. A symbol's code
length follows method C: in a context with total T and q distinct symbols a seen symbol has n / (T + q) and the escape
q / (T + q); after an escape the symbols of the longer context are excluded from the counts of the shorter one, and the
last resort is uniform over what is left.

The trie grows with the corpus, so it is never in one place: the counts of four-byte contexts are a table. Texts are
dealt into batches of about `BATCH_BYTES`; each batch asks for the distinct grams and words that it has, the answers
come from joins with the tables of counts, and a second look at the batch (the same shuffle) adds them up. Only the
contexts of two bytes and less, at most 65,536 rows of 256 numbers or 64 MB for any corpus, are broadcast.

Beside it stands a unigram base score over white-space words, by the same joins.

Results for special cases: null or empty text has the end token alone and a score of 0.0 (no byte to code); with no
training text all bytes have 1/256 and the base is log10(0.5 / 0.5) for each token. Repeated rows are scored alike and
count each time in training. Other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import by_rows, stored, whole_text, worker_memo

LONG = 4  # bytes of the longest context
BATCH_BYTES = 16 << 20
BLOCK = 1 << 20  # grams that are worked on at once
FLUSH_WORDS = 400_000


def grams(raw: bytes, start: int = 0, end: int | None = None) -> np.ndarray:
    """The bytes from start to end of a text, each with the four before it, as numbers."""
    end = len(raw) if end is None else min(end, len(raw))
    before = raw[max(0, start - LONG) : start].rjust(LONG, b"\n")
    at = np.frombuffer(before + raw[start:end], np.uint8).astype(np.int64)
    out = np.zeros(end - start, np.int64)
    for k in range(LONG + 1):
        out = out << 8 | at[k : k + len(out)]
    return out


def blocks_of(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the text, gram) for every byte, in arrays of about BLOCK."""
    rows, found, size = [], [], 0
    for n, raw in enumerate(texts):
        for start in range(0, len(raw), BLOCK):
            g = grams(raw, start, start + BLOCK)
            rows.append(np.full(len(g), n, np.int32))
            found.append(g)
            size += len(g)
            if size >= BLOCK:
                yield np.concatenate(rows), np.concatenate(found)
                rows, found, size = [], [], 0
    if size:
        yield np.concatenate(rows), np.concatenate(found)


def words_of(raw: bytes) -> list[bytes]:
    return raw.lower().split()


def strings(words: list[bytes]) -> pd.Series:
    return pd.Series([w.decode() for w in words], dtype=object)


def gathered(docs: DataFrame, train: Column) -> DataFrame:
    """gram, word, n: counts of grams (word null), words (gram null) and ends (both null) in the training texts."""

    def frame(keys: np.ndarray | None, words: list[bytes] | None, counts) -> pd.DataFrame:
        size = len(counts)
        return pd.DataFrame({"gram": pd.array(keys if keys is not None else [None] * size, "Int64"), "word": strings(words) if words is not None else pd.Series([None] * size, dtype=object), "n": np.asarray(counts, np.int64)})

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, ends, keys, counts = Counter(), 0, np.empty(0, np.int64), np.empty(0, np.int64)
        for rows in by_rows(frames):
            texts = [t.encode() for t in rows["_text"]]
            ends += len(texts)
            for raw in texts:
                words.update(words_of(raw))
            for _, found in blocks_of(texts):
                where, each = pd.factorize(np.concatenate([keys, found]))
                keys, counts = each, np.bincount(where, np.concatenate([counts, np.ones(len(found), np.int64)]), len(each)).astype(np.int64)
                if len(keys) > 2 * BLOCK:
                    yield frame(keys, None, counts)
                    keys, counts = keys[:0], counts[:0]
            if len(words) > FLUSH_WORDS:
                yield frame(None, [*words], [*words.values()])
                words.clear()
        yield frame(None, [*words], [*words.values()])
        yield frame(keys, None, counts)
        yield pd.DataFrame({"gram": pd.array([None], "Int64"), "word": pd.Series([None], dtype=object), "n": [ends]})

    source = docs.where(F.coalesce(train, F.lit(False))).select(whole_text().alias("_text"))
    counted = source.mapInPandas(count, "gram long, word string, n long")
    return counted.groupBy("gram", "word").agg(F.sum("n").alias("n"))


def method_c(orders: list[np.ndarray], left: np.ndarray | None = None, escaped: float = 0.0) -> np.ndarray:
    """log10 probabilities of the 256 symbols, from their counts in the longest context, the next one, and so on.

    left: symbols that no longer context has excluded; escaped: log10 of its escape.
    """
    out = np.zeros(256)
    left = np.ones(256, bool) if left is None else left.copy()
    for counts in orders:
        counts = np.where(left, counts, 0).astype(np.float64)
        seen = counts > 0
        q = int(seen.sum())
        if q:
            total = counts.sum() + q
            out[seen] = escaped + np.log10(counts[seen] / total)
            escaped += np.log10(q / total)
            left &= ~seen
    if left.any():
        out[left] = escaped - np.log10(left.sum())
    return out


class Short:
    """The counts in contexts of two bytes and less, and code lengths from them as they are needed."""

    def __init__(self, contexts: list[int], rows: list[bytes]):
        self.two = dict(zip(contexts, rows, strict=True))
        self.one = np.zeros((256, 256))
        for c, row in self.two.items():
            self.one[c & 255] += np.frombuffer(row, np.float32)
        self.zero = self.one.sum(0)
        self.known: dict[int, np.ndarray] = {}

    def orders(self, context: int) -> list[np.ndarray]:
        row = self.two.get(context)
        return [np.zeros(256) if row is None else np.frombuffer(row, np.float32), self.one[context & 255], self.zero]

    def row(self, context: int) -> np.ndarray:
        found = self.known.get(context)
        if found is None:
            if len(self.known) > 4096:
                self.known.clear()
            found = self.known[context] = method_c(self.orders(context))
        return found

    def lengths(self, found: np.ndarray) -> np.ndarray:
        """Code lengths of grams whose longest context is new."""
        contexts, where = np.unique(found >> 8 & 0xFFFF, return_inverse=True)
        out, order = np.zeros(len(found)), np.argsort(where, kind="stable")
        for part, context in zip(np.split(order, np.flatnonzero(np.diff(where[order])) + 1), contexts, strict=True):
            out[part] = self.row(int(context))[found[part] & 255]
        return out

    def excluding(self, found: int, escaped: float, seen: np.ndarray) -> float:
        """Code length of a gram whose longest context is known, but not with this symbol."""
        left = np.ones(256, bool)
        left[np.asarray(seen, int)] = False
        return float(method_c(self.orders(found >> 8 & 0xFFFF), left, escaped)[found & 255])


def short_contexts(counts: DataFrame) -> tuple[str, list[int], list[bytes]]:
    """A name and the arguments of Short, from the table of gathered(): at most 65,536 rows of 256 numbers."""
    pairs = counts.where("gram is not null").groupBy(F.shiftright("gram", 8).bitwiseAND(0xFFFF).cast("int").alias("context"), F.col("gram").bitwiseAND(255).cast("int").alias("symbol")).agg(F.sum("n").alias("n"))

    def dense(group: pd.DataFrame) -> pd.DataFrame:
        row = np.zeros(256, np.float32)
        row[group["symbol"].to_numpy()] = group["n"].to_numpy()
        return pd.DataFrame({"context": group["context"].iloc[:1], "row": [row.tobytes()]})

    known = pairs.groupBy("context").applyInPandas(dense, "context int, row binary").orderBy("context").collect()
    return uuid.uuid4().hex, [r["context"] for r in known], [bytes(r["row"]) for r in known]


def short_of(shared) -> Short:
    """The broadcast short contexts, made once in each worker."""
    memo, (name, contexts, rows) = worker_memo("short_contexts"), shared.value
    if memo.get("name") != name:
        memo.update(name=name, short=Short(contexts, rows))
    return memo["short"]


def asked(group: pd.DataFrame) -> pd.DataFrame:
    """batch, key, word: the distinct grams (the number itself), longest contexts (-1 less the context) and words of a batch of texts."""
    texts = [t.encode() for t in group["_text"]]
    found = [pd.unique(g) for _, g in blocks_of(texts)]
    each = pd.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
    keys = np.concatenate([each, -1 - pd.unique(each >> 8)])
    words: set[bytes] = set()
    for raw in texts:
        words.update(words_of(raw))
    key = pd.arrays.IntegerArray(np.concatenate([keys, np.zeros(len(words), np.int64)]), np.arange(len(keys) + len(words)) >= len(keys))
    return pd.DataFrame({"batch": group["batch"].iloc[0], "key": key, "word": pd.concat([pd.Series([None] * len(keys), dtype=object), strings([*words])], ignore_index=True)})


def answered(requests: DataFrame, counts: DataFrame) -> DataFrame:
    """batch, key, word, value, seen: for a gram log10 of its probability in the longest context, for a context log10 of
    its escape and the symbols seen there, for a word its count; what training lacks has no row. One join for all three."""
    grams_ = counts.where("gram is not null").select("gram", F.shiftright("gram", 8).alias("context"), F.col("gram").bitwiseAND(255).cast("short").alias("symbol"), "n")
    context = Window.partitionBy("context")
    size = F.sum("n").over(context) + F.count("*").over(context)
    no_word, none = F.lit(None).cast("string").alias("known_word"), F.lit(None).cast("array<short>").alias("seen")
    of_gram = grams_.select(F.col("gram").alias("known"), no_word, F.log10(F.col("n") / size).alias("value"), none)
    escape = F.log10(F.count("*") / (F.sum("n") + F.count("*")))
    of_context = grams_.groupBy("context").agg(escape.alias("value"), F.collect_list("symbol").alias("seen")).select((-1 - F.col("context")).alias("known"), no_word, "value", "seen")
    of_word = counts.where("word is not null").select(F.lit(None).cast("long").alias("known"), F.col("word").alias("known_word"), F.col("n").cast("double").alias("value"), none)
    known = of_gram.unionByName(of_context).unionByName(of_word)
    return requests.join(known, F.col("key").eqNullSafe(F.col("known")) & F.col("word").eqNullSafe(F.col("known_word"))).select("batch", "key", "word", "value", "seen")


def score_texts(docs: DataFrame, train: Column, id_column: str = "doc_id") -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score; train says which rows to learn from."""
    counts = stored(gathered(docs, train))
    words = counts.where("gram is null")
    tokens, distinct, ends = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum(F.when(F.col("word").isNull(), F.col("n"))), F.lit(0))).first()
    below = float(np.log10(tokens + 0.5 * (distinct + 1)))
    shared = docs.sparkSession.sparkContext.broadcast(short_contexts(counts))
    kind = docs.schema[id_column].dataType.simpleString()
    source = docs.select(F.col(id_column).alias("_id"), whole_text().alias("_text"))
    size = source.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0]
    batch = F.pmod(F.xxhash64("_id", "_text"), F.lit(max(1, math.ceil(size / BATCH_BYTES)))).alias("batch")
    texts = source.select(batch, "_id", "_text").groupBy("batch")

    def score(group: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        short, raws = short_of(shared), [t.encode() for t in group["_text"]]
        of_word = answers["word"].notna().to_numpy()
        count = dict(zip((w.encode() for w in answers["word"][of_word]), answers["value"][of_word], strict=True))
        rest = answers[~of_word]
        keys, value = rest["key"].to_numpy(np.int64), rest["value"].to_numpy(np.float64)
        place, scores = pd.Index(keys), np.zeros(len(raws))
        excluded: dict[int, float] = {}  # grams whose context is known, but not with their symbol
        for rows, found in blocks_of(raws):
            where, each = pd.factorize(found)
            at = place.get_indexer(each)
            code = value[at] if len(value) else np.zeros(len(each))
            new = np.flatnonzero(at < 0)
            met = place.get_indexer(-1 - (each[new] >> 8))
            if (met < 0).any():
                code[new[met < 0]] = short.lengths(each[new[met < 0]])
            for n, of_context in zip(new[met >= 0], met[met >= 0], strict=True):
                gram = int(each[n])
                if gram not in excluded:
                    excluded[gram] = short.excluding(gram, value[of_context], rest["seen"].iat[of_context])
                code[n] = excluded[gram]
            scores += np.bincount(rows, code[where], len(raws))
        out = []
        for raw in raws:
            c = np.array([*(count.get(w, 0.0) for w in words_of(raw)), float(ends)])
            out.append((len(c), int((c > 0).sum()), float((np.log10(c + 0.5) - below).sum())))
        base = pd.DataFrame(out, columns=["n_tokens", "n_known", "base_score"])
        return base.assign(_id=group["_id"].to_numpy(), score=scores)[["_id", "n_tokens", "n_known", "base_score", "score"]]

    answers = answered(texts.applyInPandas(asked, "batch long, key long, word string"), counts)
    scored = texts.cogroup(answers.groupBy("batch")).applyInPandas(score, f"_id {kind}, n_tokens long, n_known long, base_score double, score double")
    return scored.select(F.col("_id").alias(id_column), "n_tokens", "n_known", F.lit(int(tokens)).cast("long").alias("train_tokens"), "base_score", "score")
