"""Language-model scores: prediction by partial matching over bytes, and a unigram base over words.

The model is a trie of byte contexts up to `order` bytes. Counts of every context and next byte are gathered from all training
texts: tasks count the longest contexts, one aggregation adds them up, and shorter contexts are sums of longer ones. A
byte is predicted by the longest context known; the chance to escape to a shorter one is the number of distinct bytes seen
there over that number plus all bytes seen (method C), and bytes that the longer context could have predicted are
excluded from the shorter one's counts. Below order 0 all bytes left are equally likely. Texts are scored against this
pretrained trie; `score` is the sum of log10 of these probabilities over the text's bytes and one end, so it is a
probability distribution over texts.

Because what follows a context also follows its suffixes, an exclusion is a number per context, and whole arrays of
positions are scored with table lookups. The trie is whole, whatever its size: it is dealt by the last three bytes of
contexts, so that each task has all longer contexts of its own and computes the logarithm of every context and next byte
that any text has; only contexts of two bytes or fewer go to every worker. The logarithms of the most frequent codes go to
workers too (`HOT_CODES`), those of all others are joined by a shuffle, and so it is with words (`KEPT_WORDS`). Scores do
not depend on these bounds.

Defined cases: null text counts as empty and has the end only; a null id counts as the empty string for the split; an empty
table, or one without training rows, gives scores of the uniform model; rows that repeat an id are scored separately; other
columns are ignored; a text of any length is scored as a whole, in blocks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, text_of

#: Byte values that UTF-8 has no use for: what stands before a text, and its end.
START, END = 0xFF, 0xFE
#: Symbols that can follow: all byte values but START.
SYMBOLS = 255
#: Frequent longest contexts with their next byte whose logarithms each worker holds; all others are joined.
HOT_CODES = 3_000_000
#: Bytes of context by which the trie is dealt, and codes that a task gets on average at most.
DEALT_BY, DEALT = 3, 1 << 20
#: Frequent words that each worker holds, and the longest of them in bytes.
KEPT_WORDS, KEPT_BYTES = 400_000, 64
#: Positions handled at once, and distinct entries that a task counts before it passes them on.
BLOCK, HELD = 1 << 19, 1 << 20


def symbols(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, each behind `order` START and before an END; and where each one's symbols start."""
    head, end = bytes([START]) * order, bytes([END])
    data = np.frombuffer(b"".join(x for t in texts for x in (head, t, end)), np.uint8)
    return data, np.cumsum([0] + [len(t) + 1 + order for t in texts])


def codes(data: np.ndarray, a: int, b: int, order: int) -> np.ndarray:
    """For positions a to b: the `order` bytes before and the byte itself, as one integer."""
    found = np.zeros(b - a, np.uint64)
    for j in range(order, -1, -1):
        lo = a - j
        part = data[max(0, lo) : b - j]
        found <<= np.uint64(8)
        found[len(found) - len(part) :] |= part
    return found


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def gather(docs: DataFrame, order: int) -> DataFrame:
    """code, word, n: per task, how often each context with its next byte, and each word, occurs in training rows of `docs` (text, training).

    Codes that only other rows have are there with n = 0.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()
        keys, counts, held = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0

        def grams() -> pa.RecordBatch:
            k, n = _summed(np.concatenate(keys), np.concatenate(counts))
            return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.nulls(len(k), pa.binary()), pa.array(n)], names=["code", "word", "n"])

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.nulls(len(words), pa.int64()), pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())], names=["code", "word", "n"])

        for batch in batches:
            texts = [t.encode("utf-8", "surrogatepass").lower() for t in batch.column(0).to_pylist()]
            learnt = batch.column(1).to_pylist()
            for t, l in zip(texts, learnt, strict=True):
                if l:
                    words.update(t.split())
                if len(words) > HELD // 2:
                    yield counted()
                    words.clear()
            for part in (True, False):
                data, _ = symbols([t for t, l in zip(texts, learnt, strict=True) if l == part], order)
                for a in range(0, len(data), BLOCK):
                    found = codes(data, a, min(len(data), a + BLOCK), order)
                    k, n = np.unique(found[(found & np.uint64(255)) != START], return_counts=True)
                    keys.append(k)
                    counts.append(n if part else np.zeros_like(n))
                    held += len(k)
                    if held > 4 * HELD:
                        k, n = _summed(np.concatenate(keys), np.concatenate(counts))
                        keys, counts, held = [k], [n], len(k)
                        if held > 2 * HELD:
                            yield grams()
                            keys, counts, held = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
        yield grams()
        yield counted()

    return docs.select(text_of("text").alias("text"), "training").mapInArrow(rows, "code long, word binary, n long")


class Table:
    """Values of codes, in a table with open addresses."""

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(codes)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, ~np.uint64(0)), np.zeros(1 << self.bits, np.float32)
        slot, left = self._slot(codes), np.arange(len(codes))
        while len(left):
            put = np.zeros(len(slot), bool)  # the first of those that want a free slot
            put[np.unique(slot, return_index=True)[1]] = True
            put &= self.keys[slot] == ~np.uint64(0)
            self.keys[slot[put]], self.values[slot[put]] = codes[left[put]], values[left[put]]
            slot, left = (slot[~put] + 1) & ((1 << self.bits) - 1), left[~put]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value of each code, and where codes are that have none (their value is 0)."""
        out = np.zeros(len(found), np.float64)
        slot, open_, missed = self._slot(found), np.arange(len(found)), [np.empty(0, np.int64)]
        mask = (1 << self.bits) - 1
        while len(open_):
            held = self.keys[slot]
            hit, none = held == found[open_], held == ~np.uint64(0)
            out[open_[hit]] = self.values[slot[hit]]
            missed.append(open_[none])
            on = ~(hit | none)
            slot, open_ = (slot[on] + 1) & mask, open_[on]
        return out, np.concatenate(missed)


class Trie:
    """Contexts of each order: sorted codes of context and next byte with counts, and sums per context.

    `below` holds the orders before those of `shorter`, if these do not begin with 0.
    """

    def __init__(self, order: int, leaves: np.ndarray, counts: np.ndarray, shorter: list[tuple[np.ndarray, np.ndarray]], below: Trie | None = None):
        self.order = order
        self.levels = [*(below.levels if below else []), *shorter, (leaves, counts)]  # by order, 0 first
        self.contexts: list[tuple[np.ndarray, ...]] = [*(below.contexts if below else [])]
        for k in range(len(self.contexts), len(self.levels)):
            keys, n = self.levels[k]
            context = keys >> np.uint64(8)
            starts = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(keys) else np.empty(0, np.int64)
            total = np.add.reduceat(n, starts) if len(starts) else np.empty(0, np.int64)
            distinct = np.diff(np.r_[starts, len(keys)])
            suffixes = np.zeros(len(starts), np.int64)
            if k and len(starts):
                low, m = self.levels[k - 1]
                suffixes = np.add.reduceat(m[np.searchsorted(low, keys & np.uint64((1 << 8 * k) - 1))], starts)
            self.contexts.append((context[starts], total, distinct, suffixes))

    def log10(self, found: np.ndarray) -> np.ndarray:
        """log10 of the probability of each code's last byte after the bytes before it, order by order."""
        cost = np.zeros(len(found))
        open_ = np.arange(len(found))
        excluded, kinds = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)  # of the bytes a longer context had
        for k in range(self.order, -1, -1):
            code = found[open_] & np.uint64((1 << 8 * (k + 1)) - 1)
            names, total, distinct, below = self.contexts[k]
            at = np.minimum(np.searchsorted(names, code >> np.uint64(8)), max(0, len(names) - 1))
            known = names[at] == code >> np.uint64(8) if len(names) else np.zeros(len(code), bool)
            n, d = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
            n[known], d[known] = total[at[known]] - excluded[open_[known]], distinct[at[known]] - kinds[open_[known]]
            keys, counts = self.levels[k]
            where = np.minimum(np.searchsorted(keys, code), max(0, len(keys) - 1))
            seen = keys[where] == code if len(keys) else np.zeros(len(code), bool)
            if seen.any():
                cost[open_[seen]] += np.log10(counts[where[seen]] / (n[seen] + d[seen]))
            escape = ~seen & (d > 0)
            cost[open_[escape]] += np.log10(d[escape] / (n[escape] + d[escape]))
            excluded[open_[known]], kinds[open_[known]] = below[at[known]], distinct[at[known]]
            open_ = open_[~seen]
        cost[open_] -= np.log10(SYMBOLS - kinds[open_])
        return cost

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return summed_logs(texts, self.order, lambda found: (self.log10(found), np.empty(0, np.int64)))[0]


def summed_logs(texts: list[bytes], order: int, find: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums over each text of the values that `find` has, and the text and the code of each position that it misses."""
    data, starts = symbols(texts, order)
    sums, of, missed = np.zeros(len(texts)), [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for a in range(0, len(data), BLOCK):
        b = min(len(data), a + BLOCK)
        found = codes(data, a, b, order)
        real = np.flatnonzero(data[a:b] != START)
        value = np.zeros(b - a)
        value[real], none = find(found[real])
        at = real[none]
        of.append(np.searchsorted(starts, at + a, side="right") - 1)
        missed.append(found[at])
        first, last = np.searchsorted(starts, a, side="right") - 1, np.searchsorted(starts, b, side="left")
        cuts = np.maximum(starts[first:last], a) - a
        sums[first:last] += np.add.reduceat(value, cuts)
    return sums, np.concatenate(of), np.concatenate(missed)


def _bounded(table: DataFrame, most: int) -> int:
    """The smallest count that at most `most` rows of `table` (n) reach; from a histogram by powers of 2^(1/4)."""
    step = F.when(F.col("n") > 0, F.floor(F.log2(F.col("n").cast("double")) * 4)).otherwise(-1).cast("int")
    held, least = 0, None
    for r in table.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # some hundred rows
        held += r["count"]
        if held > most:
            break
        least = r["step"]
    if least is None:  # not even the most frequent fit: none do
        return int(table.agg(F.max("n")).first()[0] or 0) + 1
    return 0 if least == -1 else int(np.ceil(2 ** (least / 4) - 1e-9))


def code_logs(grams: DataFrame, order: int) -> DataFrame:
    """code, n, log: log10 of the probability of each code's last byte, in the trie of all codes of `grams` (code, n) with n > 0.

    What comes to the driver are contexts of `DEALT_BY` - 1 bytes or fewer, of which UTF-8 has no more than some millions.
    """
    by = min(DEALT_BY, order)
    below = None
    if by:
        mask = F.lit((1 << 8 * by) - 1)
        got = grams.where("n > 0").groupBy(F.col("code").bitwiseAND(mask).alias("code")).agg(F.sum("n").alias("n")).toArrow()
        levels = [_summed(got["code"].to_numpy().view(np.uint64), got["n"].to_numpy())]
        for k in range(by - 1, 0, -1):
            levels.insert(0, _summed(levels[0][0] & np.uint64((1 << 8 * k) - 1), levels[0][1]))
        below = Trie(by - 1, *levels[-1], levels[:-1])
    sent = grams.sparkSession.sparkContext.broadcast(below)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [pa.Table.from_batches([b]) for b in batches]
        if not held:
            return
        table = pa.concat_tables(held)
        found, n = _summed(table["code"].to_numpy().view(np.uint64), table["n"].to_numpy())
        levels = [(found[n > 0], n[n > 0])]
        for k in range(order, by, -1):
            levels.insert(0, _summed(levels[0][0] & np.uint64((1 << 8 * k) - 1), levels[0][1]))
        logs = Trie(order, *levels[-1], levels[:-1], sent.value).log10(found)
        for a in range(0, len(found), BLOCK):
            yield pa.RecordBatch.from_arrays([pa.array(found[a : a + BLOCK].view(np.int64)), pa.array(n[a : a + BLOCK]), pa.array(logs[a : a + BLOCK].astype(np.float32))], names=["code", "n", "log"])

    tasks = max(int(grams.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-grams.count() // DEALT))
    key = F.shiftrightunsigned("code", 8).bitwiseAND(F.lit((1 << 8 * by) - 1))
    return grams.select("code", "n").repartition(tasks, key).mapInArrow(rows, "code long, n long, log float")


def score(docs: DataFrame, training: Column, order: int = 5, id_col: str = "doc_id", text_col: str = "text", hot_codes: int = HOT_CODES, kept_words: int = KEPT_WORDS) -> DataFrame:
    """doc_id, training, n_tokens, n_known, train_tokens, base_score, score for each row of `docs`.

    `training` marks the rows that the model and the base learn from.
    """
    spark = docs.sparkSession
    rows_of = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    counted = materialise(gather(rows_of, order), "ppm-counts")
    grams = materialise(counted.where("code is not null").groupBy("code").agg(F.sum("n").alias("n")), "ppm-grams")
    vocabulary = materialise(counted.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")), "ppm-words")
    ends = rows_of.where("training").select("training").count()
    words, kinds = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tokens, kinds = words + ends, kinds + (ends > 0)
    below = float(np.log10(tokens + 0.5 * (kinds + 1)))

    logs = materialise(code_logs(grams, order), "ppm-logs")
    hot = logs.where(F.col("n") >= _bounded(logs, hot_codes)).toArrow()
    hot_logs = spark.sparkContext.broadcast(Table(hot["code"].to_numpy().view(np.uint64), hot["log"].to_numpy()))
    all_hot = hot.num_rows == logs.count()
    least = _bounded(vocabulary, kept_words)
    frequent = vocabulary.where((F.col("n") >= least) & (F.length("word") <= KEPT_BYTES)).toArrow()
    table = spark.sparkContext.broadcast(dict(zip(frequent["word"].to_pylist(), frequent["n"].to_pylist(), strict=True)))
    whole = frequent.num_rows == kinds - (ends > 0)  # then other words are unknown
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = docs.schema[id_col].dataType
    schema = pa.schema([("doc_id", to_arrow_type(id_type)), ("training", pa.bool_()), ("row", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("others", pa.map_(pa.binary(), pa.int64())), ("cold", pa.map_(pa.int64(), pa.int64()))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row, find, known = TaskContext.get().partitionId() << 40, hot_logs.value.find, table.value
        cache: dict[int, float] = {}

        def log_of(c: int) -> float:
            if c not in cache:
                cache[c] = float(np.log10(c + 0.5)) - below
            return cache[c]

        for batch in batches:
            texts = [t.encode("utf-8", "surrogatepass").lower() for t in batch.column(1).to_pylist()]
            n_tokens, n_known, base, others = [], [], [], []
            for t in texts:
                found = t.split()
                counts = list(map(known.get, found))
                rest = Counter(w for w, c in zip(found, counts, strict=True) if c is None) if None in counts else {}
                total = Counter(counts)
                missing = total.pop(None, 0)
                value = sum(log_of(c) * n for c, n in sorted(total.items())) + log_of(ends)
                if whole:
                    value += missing * log_of(0)
                n_tokens.append(len(found) + 1)
                n_known.append(len(found) - missing + (ends > 0))
                base.append(value)
                others.append([] if whole else list(rest.items()))
            sums, of, missed = summed_logs(texts, order, find)
            by = np.lexsort((missed, of))  # each text's codes once, with their number
            of, missed = of[by], missed[by]
            new = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (missed[1:] != missed[:-1])]) if len(of) else np.empty(0, np.int64)
            offsets = np.searchsorted(of[new], np.arange(len(texts) + 1)).astype(np.int32)
            cold = pa.MapArray.from_arrays(pa.array(offsets), pa.array(missed[new].view(np.int64)), pa.array(np.diff(np.r_[new, len(of)])))
            ids = np.arange(row, row + len(texts))
            row += len(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(ids, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(sums, pa.float64()), pa.array(others, schema.field("others").type), cold], schema=schema)

    scored = rows_of.select("doc_id", "text", "training").mapInArrow(rows, f"doc_id {id_type.simpleString()}, training boolean, row long, n_tokens long, n_known long, base double, score double, others map<binary,long>, cold map<long,long>")
    if not (whole and all_hot):
        scored = materialise(scored, "ppm-scores")
    if not all_hot:
        pairs = scored.select("row", F.explode("cold").alias("code", "times")).join(logs.select("code", "log"), "code")
        rest = pairs.groupBy("row").agg(F.sum(F.col("times") * F.col("log").cast("double")).alias("rest"))
        scored = scored.join(rest, "row", "left").withColumn("score", F.col("score") + F.coalesce("rest", F.lit(0.0)))
    if not whole:
        pairs = scored.select("row", F.explode("others").alias("word", "tf")).join(vocabulary, "word", "left")
        c = F.coalesce("n", F.lit(0))
        more = pairs.groupBy("row").agg(F.sum(F.col("tf") * (F.log10(c + 0.5) - F.lit(below))).alias("more"), F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("found"))
        scored = scored.drop("others", "cold").join(more, "row", "left").withColumn("base", F.col("base") + F.coalesce("more", F.lit(0.0))).withColumn("n_known", F.col("n_known") + F.coalesce("found", F.lit(0)))
    return scored.select("doc_id", "training", "n_tokens", "n_known", F.lit(int(tokens)).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
