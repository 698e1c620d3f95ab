"""Language identification with a bidirectional gated recurrent network over bytes.

Two gated recurrent networks read a window of bytes, one from each end; at every position the two states give
probabilities of the languages, and a document's probabilities are the means over all its positions. The network is trained in
numpy by backpropagation through time: each position of a training window is labelled with its document's language, and Adam
follows the mean cross-entropy. Gates use x / (1 + |x|) in place of the exponential functions, in training as in use.

Training takes at most about `SAMPLE` documents of each language that rows are marked with, chosen by a hash of the id, and two
windows of each; that bound does not depend on the table. Prediction covers every byte of every text: texts are cut
into windows that advance side by side, so that a step is an array operation over thousands of windows.

Defined cases: a null text, or one without letters, is `und` with score 0; without training rows every text is `und`; texts
shorter than a window are padded and the padding is not counted; rows that repeat an id are predicted separately; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import deepcopy
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_of
from tidemark.llm.pieces import give_back, pieces

#: Documents per language that training may take.
SAMPLE = 500
#: Bytes in a window, states per direction, windows that advance together.
WINDOW, STATES, LANES = 128, 8, 2048
#: The class of what is no learned language, and the least and largest pooled probability of it from which a text is rejected.
REJECT, REJECT_FROM, REJECT_UPTO = "und", 0.9, 0.97
#: Windows that one task of refine() learns from, that go together, and the largest step they take.
SHARD, BATCH, RATE = 4096, 256, 0.003
#: Code points of letters that foreign text is made of: Greek, Cyrillic, Hebrew, Arabic, Devanagari, Thai, Hangul, kana, Han.
SCRIPTS = ((0x391, 0x3C9), (0x410, 0x44F), (0x5D0, 0x5EA), (0x627, 0x64A), (0x905, 0x939), (0xE01, 0xE2E), (0xAC00, 0xD7A3), (0x3041, 0x3096), (0x4E00, 0x9FA5))
_LETTER = regex.compile(r"\p{L}")


def _squash(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


@dataclass
class Network:
    """Weights by direction: input[d] (3 states, 256), recurrent[d] (3 states, states), output[d] (languages, states); bias."""

    languages: list[str]
    input: list[np.ndarray]
    recurrent: list[np.ndarray]
    output: list[np.ndarray]
    bias: np.ndarray

    @classmethod
    def random(cls, languages: list[str], states: int, seed: int) -> Network:
        r = np.random.default_rng(seed)
        draw = lambda *shape: r.normal(0, 0.3, shape).astype(np.float32)
        return cls(languages, [draw(3 * states, 256) for _ in "fb"], [draw(3 * states, states) for _ in "fb"], [draw(len(languages), states) for _ in "fb"], np.zeros((len(languages), 1), np.float32))

    def weights(self) -> list[np.ndarray]:
        return [*self.input, *self.recurrent, *self.output, self.bias]

    def run(self, d: int, windows: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """States of direction `d` at each position: (positions, states, lanes). windows: (positions, lanes) of bytes."""
        n, lanes = windows.shape
        k = self.recurrent[d].shape[1]
        states, tape = np.empty((n, k, lanes), np.float32), []
        h = np.zeros((k, lanes), np.float32)
        for t in range(n) if d == 0 else range(n - 1, -1, -1):
            x = self.input[d].take(windows[t], axis=1)
            r = self.recurrent[d] @ h
            gates = x[: 2 * k] + r[: 2 * k]
            g = np.abs(gates)
            g += 1
            np.divide(gates, g, out=g)
            g *= 0.5
            g += 0.5  # reset and update gates
            c = g[:k] * r[2 * k :]
            c += x[2 * k :]
            size = np.abs(c)
            size += 1
            np.divide(c, size, out=c)  # the candidate state
            new = h - c
            new *= g[k:]
            new += c
            if keep:
                tape.append((t, h, r[2 * k :], g, c, gates, size))
            h = states[t] = new
        return states, tape

    def probabilities(self, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
        """(positions, languages, lanes)"""
        z = np.matmul(self.output[0], forward)
        z += np.matmul(self.output[1], backward)
        z += self.bias
        z -= z.max(1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(1, keepdims=True)
        return z

    def gradients(self, windows: np.ndarray, labels: np.ndarray, mask: np.ndarray, at_once: bool = False) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over the positions in `mask` and its gradients, by backpropagation through time.

        With `at_once` the gradients of all positions' inputs are added up at the end, which is faster for many lanes.
        """
        runs = [self.run(d, windows, True) for d in (0, 1)]
        p = self.probabilities(runs[0][0], runs[1][0])
        lanes = np.arange(windows.shape[1])
        loss = float(-(np.log(p[:, labels, lanes] + 1e-9) * mask).sum() / mask.sum())
        p[:, labels, lanes] -= 1
        p *= (mask / mask.sum())[:, None, :]
        inputs, recurrents, outputs = [], [], []
        for d, (states, tape) in enumerate(runs):
            k = self.recurrent[d].shape[1]
            outputs.append(np.einsum("tcl,tsl->cs", p, states))
            back = np.einsum("cs,tcl->tsl", self.output[d], p)
            w_in, w_rec, dh, held = np.zeros_like(self.input[d]), np.zeros_like(self.recurrent[d]), np.zeros_like(back[0]), []
            for t, h, r, g, c, gates, size in reversed(tape):
                dh = dh + back[t]
                reset, update = g[:k], g[k:]
                dc = dh * (1 - update) / size**2  # through the candidate's squashing
                dgates = np.concatenate([dc * r, dh * (h - c)]) * 0.5 / (1 + np.abs(gates)) ** 2
                drec = np.concatenate([dgates, dc * reset])
                w_rec += drec @ h.T
                if at_once:
                    held.append((windows[t], np.concatenate([dgates, dc])))
                else:
                    np.add.at(w_in.T, windows[t], np.concatenate([dgates, dc]).T)
                dh = dh * update + self.recurrent[d].T @ drec
            if at_once:
                at, values = np.concatenate([x for x, _ in held]).astype(np.int64), np.concatenate([x for _, x in held], axis=1)
                w_in = np.stack([np.bincount(at, row, 256) for row in values]).astype(np.float32)
            inputs.append(w_in)
            recurrents.append(w_rec)
        return loss, [*inputs, *recurrents, *outputs, p.sum((0, 2))[:, None]]


def train(examples: list[tuple[bytes, str]], states: int = STATES, steps: int = 320, batch: int = 96, rate: float = 0.02, seed: int = 7) -> Network | None:
    """A network fitted to windows and their languages."""
    languages = sorted({lang for _, lang in examples})
    if not languages:
        return None
    net, r = Network.random(languages, states, seed), np.random.default_rng(seed)
    windows, mask = np.zeros((len(examples), WINDOW), np.uint8), np.zeros((len(examples), WINDOW), np.float32)
    for i, (text, _) in enumerate(examples):
        windows[i, : len(text)], mask[i, : len(text)] = np.frombuffer(text, np.uint8), 1
    labels = np.array([languages.index(lang) for _, lang in examples])
    by_label = [np.flatnonzero(labels == c) for c in range(len(languages))]
    m, v = [[np.zeros_like(w) for w in net.weights()] for _ in range(2)]
    for step in range(1, steps + 1):
        pick = np.concatenate([r.choice(x, -(-batch // len(by_label))) for x in by_label])
        _, grads = net.gradients(windows[pick].T.copy(), labels[pick], mask[pick].T)
        norm = float(np.sqrt(sum((g**2).sum() for g in grads)))
        now = rate * min(1.0, 3 * (1 - step / (steps + 1)))
        for w, g, a, b in zip(net.weights(), grads, m, v, strict=True):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w -= (now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def _cut(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Windows (positions, lanes) over all bytes of the texts, which positions count, and which text each lane is of."""
    lengths = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts) + bytes(WINDOW), np.uint8)
    starts = np.cumsum(lengths) - lengths
    n = -(-lengths // WINDOW)
    of = np.repeat(np.arange(len(texts)), n)
    new = (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)) * WINDOW  # first position that counts
    first = np.maximum(0, np.minimum(new, lengths[of] - WINDOW))  # the last window reaches back instead of being padded
    for a in range(0, len(of), LANES):
        f, w = first[a : a + LANES], of[a : a + LANES]
        at = np.arange(WINDOW)[:, None]
        counts = (f + at >= new[a : a + LANES]) & (f + at < lengths[w])
        windows = data[starts[w] + f + at]
        windows[f + at >= lengths[w]] = 0
        yield windows, counts, w


def predict(net: Network, texts: list[bytes]) -> np.ndarray:
    """Probabilities of the languages for each text, pooled over all its positions."""
    sums = np.zeros((len(texts), len(net.languages)))
    for windows, counts, of in _cut(texts):
        p = net.probabilities(net.run(0, windows)[0], net.run(1, windows)[0])
        counts = counts.astype(np.float32)
        np.add.at(sums, of, np.einsum("tcl,tl->lc", p, counts))
    n = np.maximum(1, np.array([len(t) for t in texts]))
    return sums / n[:, None]


def examples(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> list[tuple[bytes, str]]:
    """Windows of training documents with their languages, a bounded number, chosen by hashes of ids."""
    rows = docs.where(training & F.col(lang_col).isNotNull() & (F.length(text_of(text_col)) > 0))
    counts = rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n"))  # a row per language
    share = counts.select("lang", (F.lit(float(sample)) / F.col("n")).alias("part"))
    drawn = rows.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"), F.col(lang_col).alias("lang")).withColumn("u", F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / F.lit(float(1 << 30)))
    picked = drawn.join(F.broadcast(share), "lang").where("u < part")
    start = F.explode(F.array(F.lit(1), F.lit(1) + F.pmod(F.xxhash64("id", "text"), F.greatest(F.lit(1), F.length("text") - WINDOW)).cast("int")))
    windows = picked.select("id", "text", "lang", start.alias("start")).select("id", "start", "lang", F.expr(f"substring(text, start, {WINDOW})").alias("text"))
    got = windows.orderBy("id", "start", "text").toArrow()
    return [(t.encode("utf-8", "surrogatepass")[:WINDOW], lang) for t, lang in zip(got["text"].to_pylist(), got["lang"].to_pylist(), strict=True)]


def identify(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of `docs`, then lang_pred and score."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    kept = StructType([f for f in docs.schema.fields if f.name not in ("lang_pred", "score")])
    out = StructType([*kept.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    arrow, at = to_arrow_schema(out), [f.name for f in kept.fields].index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in pieces(batches, at):
            texts = batch.column(at).to_pylist()
            known = [bool(model) and t is not None and _LETTER.search(t) is not None for t in texts]
            langs, scores = np.full(len(texts), "und", object), np.zeros(len(texts))
            if any(known):
                which = np.flatnonzero(known)
                p = predict(model, [texts[k].encode("utf-8", "surrogatepass") for k in which.tolist()])
                langs[which] = np.array(model.languages, object)[p.argmax(1)]
                scores[which] = np.minimum(1.0, p.max(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores)], schema=arrow)

    return docs.select(*[f.name for f in kept.fields]).mapInArrow(rows, out)


def foreign(learned: list[tuple[bytes, str]], n: int, seed: int = 11, scripts: list[tuple[int, int]] | None = None) -> list[tuple[bytes, str]]:
    """`n` windows of the class REJECT: random words in `scripts` (those that the learned windows lack), random letters and digits, and learned windows with their bytes shuffled."""
    r = np.random.default_rng(seed)
    if scripts is None:
        seen = "".join(t.decode("utf-8", "ignore") for t, _ in learned)
        points = np.frombuffer(seen.encode("utf-32-le"), np.uint32)
        scripts = [(a, b) for a, b in SCRIPTS if not ((points >= a) & (points <= b)).any()]
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    out = []
    for i in range(n):
        kind = i % 4
        if kind < 2 and scripts:
            a, b = scripts[(i // 4) % len(scripts)]
            text = " ".join("".join(map(chr, r.integers(a, b + 1, r.integers(2, 11)))) for _ in range(30)).encode()
        elif kind == 2 or not learned:
            text = "".join(letters[k] for k in r.integers(0, 16 if i % 8 == 2 else len(letters), WINDOW)).encode()
        else:
            text = bytes(r.permutation(np.frombuffer(learned[int(r.integers(len(learned)))][0], np.uint8)))
        out.append((text[:WINDOW], REJECT))
    return out


def train_with_reject(learned: list[tuple[bytes, str]], held_out: list[tuple[bytes, str]]) -> tuple[Network | None, float]:
    """A network that also knows what is no language, and the pooled probability of that above which a text is rejected.

    That bound is one that 999 in 1000 held-out windows stay below, within REJECT_FROM and REJECT_UPTO. Texts of a few words with a key or a
    number among them come to 0.85, whatever their language; other scripts and encoded bytes come to 0.95 and more.
    """
    languages = len({lang for _, lang in learned})
    if not languages:
        return None, 1.0
    net = train(learned + foreign(learned, max(100, len(learned) // languages)))
    if not held_out:
        return net, REJECT_FROM
    p = predict(net, [t for t, _ in held_out])[:, net.languages.index(REJECT)]
    return net, float(np.clip(np.quantile(p, 0.999), REJECT_FROM, REJECT_UPTO))


def _marked(docs: DataFrame, rows: Column, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    found = docs.where(rows & F.col(lang_col).isNotNull() & (F.length(text_of(text_col)) > 0))
    return found.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"), F.col(lang_col).alias("lang"))


def unseen_scripts(texts: DataFrame) -> list[tuple[int, int]]:
    """Those of SCRIPTS that no row of `texts` (text) has a letter of."""
    ranges = [f"{chr(a)}-{chr(b)}" for a, b in SCRIPTS]
    some = texts.where(F.col("text").rlike(f"[{''.join(ranges)}]"))
    found = some.agg(*[F.max(F.col("text").rlike(f"[{r}]")).alias(f"s{i}") for i, r in enumerate(ranges)]).first()  # one row
    return [script for script, there in zip(SCRIPTS, found, strict=True) if not there]


def refine(net: Network, marked: DataFrame, scripts: list[tuple[int, int]]) -> Network:
    """`net` after it has learned from two windows of every row of `marked` (id, text, lang): the mean of what its shards make of it.

    A shard has about SHARD windows, and as many of REJECT as of a language in the mean. Each of its windows is learned from once at least;
    classes go into a batch alike, so those of rare ones come again. Means are sums of whole numbers: reruns agree.
    """
    start = F.explode(F.array(F.lit(1), F.lit(1) + F.pmod(F.xxhash64("id", "text"), F.greatest(F.lit(1), F.length("text") - WINDOW)).cast("int")))
    shards = max(1, -(-2 * marked.count() // SHARD))
    windows = marked.select("id", "text", "lang", start.alias("start")).select("lang", F.expr(f"substring(text, start, {WINDOW})").alias("text"), F.pmod(F.xxhash64("id", "start", "text"), F.lit(shards)).alias("shard"))
    sent = marked.sparkSession.sparkContext.broadcast(net)
    one = float(1 << 36)

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        mine = deepcopy(sent.value)
        learned = sorted((t.encode("utf-8", "surrogatepass")[:WINDOW], lang) for t, lang in zip(rows["text"], rows["lang"], strict=True) if lang in mine.languages)
        made = foreign(learned, max(8, len(learned) // max(1, len(mine.languages) - 1)), int(key[0]), scripts)
        learn(mine, learned + made, int(key[0]))
        give_back()
        flat = np.concatenate([w.ravel() for w in mine.weights()]).astype(np.float64)
        return pd.DataFrame({"w": [np.rint(flat * one).astype(np.int64).tolist()]})

    fitted = windows.groupBy("shard").applyInPandas(fit, "w array<long>")
    sums = fitted.select(F.posexplode("w").alias("at", "w")).groupBy("at").agg(F.sum("w").alias("w"), F.count("*").alias("n")).orderBy("at").toArrow()  # a row per weight
    if not sums.num_rows:
        return net
    flat, at, out = (sums["w"].to_numpy() / one / sums["n"].to_numpy()).astype(np.float32), 0, deepcopy(net)
    for w in out.weights():
        w[...] = flat[at : at + w.size].reshape(w.shape)
        at += w.size
    return out


def learn(net: Network, examples: list[tuple[bytes, str]], seed: int) -> None:
    """Fits `net` further, in place, to windows of its languages, each of which is met once at least."""
    r = np.random.default_rng(seed)
    windows, mask = np.zeros((len(examples), WINDOW), np.uint8), np.zeros((len(examples), WINDOW), np.float32)
    for i, (text, _) in enumerate(examples):
        windows[i, : len(text)], mask[i, : len(text)] = np.frombuffer(text, np.uint8), 1
    labels = np.array([net.languages.index(lang) for _, lang in examples])
    turns = [r.permutation(np.flatnonzero(labels == c)) for c in np.unique(labels)]
    each = -(-BATCH // len(turns))
    steps = -(-max(map(len, turns)) // each)
    m, v = [[np.zeros_like(w) for w in net.weights()] for _ in range(2)]
    for step in range(1, steps + 1):
        pick = np.concatenate([np.take(x, np.arange((step - 1) * each, step * each), mode="wrap") for x in turns])
        _, grads = net.gradients(windows[pick].T.copy(), labels[pick], mask[pick].T, at_once=True)
        norm = float(np.sqrt(sum((g**2).sum() for g in grads)))
        now = RATE * (1 - (step - 1) / steps)
        for w, g, a, b in zip(net.weights(), grads, m, v, strict=True):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w -= (now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)).astype(np.float32)


def train_on_all(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """A network that also knows what is no language, from all training rows: it starts from the windows of examples() and is refined by every row."""
    started = examples(docs, training, id_col, text_col, lang_col)
    languages = len({lang for _, lang in started})
    if not languages:
        return None
    marked = _marked(docs, training, id_col, text_col, lang_col)
    scripts = unseen_scripts(marked)
    return refine(train(started + foreign(started, max(100, len(started) // languages), scripts=scripts)), marked, scripts)


def with_reject(docs: DataFrame, net: Network | None, text_col: str = "text") -> DataFrame:
    """All columns of `docs` and reject, the pooled probability of REJECT over all bytes of a text: null without a letter, 0 without a network."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import DoubleType, StructField, StructType

    out = StructType([*docs.schema.fields, StructField("reject", DoubleType())])
    at, arrow, sent = docs.columns.index(text_col), to_arrow_schema(out), docs.sparkSession.sparkContext.broadcast(net)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in pieces(batches, at):
            texts = batch.column(at).to_pylist()
            which = np.flatnonzero([t is not None and _LETTER.search(t) is not None for t in texts])
            found = np.zeros(len(texts))
            if model is not None and len(which):
                found[which] = predict(model, [texts[k].encode("utf-8", "surrogatepass") for k in which.tolist()])[:, model.languages.index(REJECT)]
            none = np.ones(len(texts), bool)
            none[which] = False
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, mask=none)], schema=arrow)

    return docs.mapInArrow(rows, out)


def reject_bound(scored: DataFrame, held_out: Column, lang_col: str = "lang") -> float:
    """The value of reject that 999 in 1000 of all held-out rows with a language stay below, within REJECT_FROM and REJECT_UPTO.

    Values count to four decimals, so what is counted has a bounded number of them. REJECT_FROM where no row is held out.
    """
    found = scored.where(held_out & F.col(lang_col).isNotNull()).agg(F.percentile(F.round("reject", 4), F.lit(0.999))).first()[0]
    return REJECT_FROM if found is None else float(np.clip(found, REJECT_FROM, REJECT_UPTO))


def accepted(net: Network | None, most: float, texts: list[str | None], wanted: list[str] | None = None) -> np.ndarray:
    """Which texts have letters, are not rejected, and, if languages are `wanted`, have one of these as their likeliest."""
    keep = np.array([t is not None and _LETTER.search(t) is not None for t in texts], bool)
    if net is not None and keep.any():
        at = np.flatnonzero(keep)
        p = predict(net, [texts[i].encode("utf-8", "surrogatepass") for i in at.tolist()])
        no = net.languages.index(REJECT) if REJECT in net.languages else None
        if no is not None:
            keep[at] &= p[:, no] <= most
            p[:, no] = -1
        if wanted is not None:
            keep[at] &= np.isin(np.array(net.languages, object)[p.argmax(1)], wanted)
    return keep


def with_language(docs: DataFrame, net: Network | None, most: float = REJECT_FROM, text_col: str = "text", wanted: list[str] | None = None) -> DataFrame:
    """The rows of `docs` that accepted() keeps; without a network, all that have letters.

    Of a text in several languages each part has one, so its pooled probability of REJECT is low and it stays.
    """
    at = docs.columns.index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, at):
            yield batch.filter(pa.array(accepted(sent.value, most, batch.column(at).to_pylist(), wanted), pa.bool_()))

    return docs.mapInArrow(rows, docs.schema)
