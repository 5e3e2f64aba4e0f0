"""Language ID by a byte convolutional network.

A text's UTF-8 bytes, as classes (letters without case, digits, lead and continuation bytes, ...), are cut into windows of
256. Filters two, three and four bytes wide slide over a window; each filter's largest response feeds a softmax over the
learned languages. A text's probabilities are its windows' means, weighted by their letters.

Training is numpy on the driver, on a bounded sample: about DOCS_PER_LANGUAGE documents of each language, MOST_DOCS in all
(but one of each language at least), and two windows of each (so 40 MB at most, unless languages number tens of thousands),
drawn by a hash of the id. Every label is learned, however rare. Prediction is one Arrow pass over whole texts; a response is
a sum of looked-up values for pairs of bytes, so a window costs a few table look-ups per byte.

Defined cases: a text that is null or holds no letter is `und` with score 0, as is every text when nothing was learned; a
null id is neither learned from nor held out; repeated rows each keep their row. Only the named columns are used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from leafmill.llm.common import small_batches

WINDOW, WIDTHS, FILTERS, DOCS_PER_LANGUAGE, EPOCHS = 256, (2, 3, 4), 8, 1500, 5
#: Documents that are learned from, however many languages there are.
MOST_DOCS = 60_000
UNKNOWN = "und"

CLASSES = 96


def _classes() -> np.ndarray:
    """The class of each byte: 0 white space and padding, 1-26 letters, 27 digits, 28 other ASCII, then UTF-8 bytes by their low bits, which a capital shares with its small letter in Latin-1."""
    out = np.full(256, 28, np.uint8)
    out[:33] = 0
    for k in range(26):
        out[65 + k] = out[97 + k] = 1 + k
    out[48:58] = 27
    out[128:192] = 30 + (np.arange(128, 192) & 31)
    out[192:] = 62 + (np.arange(192, 256) & 31)
    return out


BYTE_CLASS = _classes()


class Network:
    """Filters as arrays (width, class, filter), then a dense layer."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.filters = [(rng.standard_normal((w, CLASSES, FILTERS)) * 0.3).astype("float32") for w in WIDTHS]
        self.dense = (rng.standard_normal((len(WIDTHS) * FILTERS, len(languages))) * 0.3).astype("float32")
        self.bias = np.zeros(len(languages), "float32")

    def tables(self) -> list[list[np.ndarray]]:
        """Each filter width as tables of pairs of classes (and one of single ones for an odd width)."""
        out = []
        for f in self.filters:
            parts = [(f[k][:, None] + f[k + 1][None]).reshape(-1, FILTERS) for k in range(0, len(f) - 1, 2)]
            out.append(parts + [f[-1]] * (len(f) % 2))
        return out

    def responses(self, windows: np.ndarray, tables: list[list[np.ndarray]]) -> Iterator[np.ndarray]:
        """For each width: (window, place, filter)."""
        pairs = windows[:, :-1].astype("int32") * CLASSES + windows[:, 1:]
        for width, parts in zip(WIDTHS, tables, strict=True):
            n = windows.shape[1] - width + 1
            total = parts[0].take(pairs[:, :n], axis=0)
            for k, part in enumerate(parts[1:], 1):
                total += part.take(pairs[:, 2 * k : 2 * k + n] if 2 * k + 1 < width else windows[:, 2 * k : 2 * k + n], axis=0)
            yield total

    def predict(self, windows: np.ndarray) -> np.ndarray:
        """Probabilities (window, language)."""
        tables, out = self.tables(), []
        for k in range(0, len(windows), 256):
            pooled = np.concatenate([r.max(axis=1) for r in self.responses(windows[k : k + 256], tables)], axis=1)
            out.append(softmax(np.maximum(pooled, 0) @ self.dense + self.bias))
        return np.concatenate(out) if out else np.zeros((0, len(self.languages)), "float32")

    def fit(self, windows: np.ndarray, targets: np.ndarray, epochs: int = EPOCHS, batch: int = 128, rate: float = 0.01, seed: int = 11) -> None:
        """Adam on cross entropy; through max pooling, only each filter's best place learns."""
        rng = np.random.default_rng(seed)
        weights = [*self.filters, self.dense, self.bias]
        first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for k in range(0, len(order), batch):
                x, y = windows[order[k : k + batch]], targets[order[k : k + batch]]
                rows = np.arange(len(x))
                best, pooled = [], []
                for r in self.responses(x, self.tables()):
                    at = r.argmax(axis=1)
                    best.append(at)
                    pooled.append(np.take_along_axis(r, at[:, None, :], axis=1)[:, 0])
                pooled = np.concatenate(pooled, axis=1)
                active = np.maximum(pooled, 0)
                error = softmax(active @ self.dense + self.bias)
                error[rows, y] -= 1
                error /= len(x)
                back = (error @ self.dense.T) * (pooled > 0)
                slopes = []
                for i, (width, at) in enumerate(zip(WIDTHS, best, strict=True)):
                    slope = np.zeros_like(self.filters[i])
                    part = back[:, i * FILTERS : (i + 1) * FILTERS]
                    for j in range(width):
                        np.add.at(slope[j], (x[rows[:, None], at + j], np.arange(FILTERS)[None]), part)
                    slopes.append(slope)
                step += 1
                for w, g, m, v in zip(weights, [*slopes, active.T @ error, error.sum(axis=0)], first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def windows_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts, and where each text's begin. Every text has at least one."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    counts = np.array([max(1, -(-len(b) // WINDOW)) for b in raw], "int64")
    starts = np.concatenate(([0], np.cumsum(counts)))
    out = np.zeros(starts[-1] * WINDOW, np.uint8)
    for b, s in zip(raw, starts, strict=False):
        out[s * WINDOW : s * WINDOW + len(b)] = BYTE_CLASS[np.frombuffer(b, np.uint8)]
    return out.reshape(-1, WINDOW), starts


def held_out(id_column: Column) -> Column:
    return F.coalesce(F.crc32(id_column.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, *, docs_per_language: int = DOCS_PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """A network learned from a sample of the labelled documents that aren't held out; None if there are none."""
    labelled = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & ~held_out(F.col(id_col)))
    counts = {r[0]: r[1] for r in labelled.groupBy(lang_col).count().collect()}
    if not counts:
        return None
    # All languages share the bound on the sample, each at least with one document.
    each = max(1, min(docs_per_language, MOST_DOCS // len(counts)))
    drawn = F.pmod(F.xxhash64(F.lit("language"), F.col(id_col), F.col(text_col)), F.lit(1 << 30)).cast("double") / (1 << 30)
    # So amply drawn that each label's first documents in that order are there; these are taken.
    # As an Arrow table: lists of rows would start Python workers of another kind, which stay.
    shares = pa.table({"_lang": pa.array(list(counts), pa.string()), "_share": pa.array([(each + 8 * each**0.5 + 32) / n for n in counts.values()], pa.float64())})
    shares = F.broadcast(docs.sparkSession.createDataFrame(shares))
    n = F.greatest(F.char_length(F.col(text_col)) - WINDOW, F.lit(1))
    piece = lambda k: F.substring(F.col(text_col), (F.pmod(F.xxhash64(F.lit(k), F.col(id_col)), n) + 1).cast("int"), F.lit(WINDOW))
    sample = labelled.join(shares, F.col(lang_col) == F.col("_lang")).where(drawn < F.col("_share")).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), drawn.alias("drawn"), piece(1).alias("a"), piece(2).alias("b"))
    # Copies of a row are one.
    ranked = sample.dropDuplicates().withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy("drawn", "id", "a", "b")))
    rows = sorted(ranked.where(F.col("rank") <= each).collect(), key=lambda r: (r.drawn, str(r.id), r.lang))
    languages = sorted(counts)
    texts, targets = [], []
    for k, r in enumerate(rows):
        # A third of the windows are cut short, as short texts are to be told apart, too.
        for j, t in enumerate((r.a, r.b)):
            texts.append(t if (k + j) % 3 else t[: 8 + 17 * k % 120])
            targets.append(languages.index(r.lang))
    # A window may be a little longer in bytes than in characters; the rest is left out here.
    rows_of, starts = windows_of(texts)
    network = Network(languages)
    network.fit(rows_of[starts[:-1]], np.array(targets))
    return network


def lettered(text: Column) -> Column:
    """Whether a text holds a letter."""
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, network: Network | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score; all other columns stay."""
    text = F.col(text_col)
    if network is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})

    def made(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in frames:
            names, scores = [], []
            values = [t if t is not None else "" for t in texts]
            # A few MB of text at a time.
            sizes = np.cumsum([len(v) for v in values]) // (1 << 21) if values else np.array([], int)
            for group in np.split(np.arange(len(values)), np.flatnonzero(np.diff(sizes)) + 1):
                if not len(group):
                    continue
                rows, starts = windows_of([values[i] for i in group])
                letters = (((rows >= 1) & (rows <= 26)) | (rows >= 62)).sum(axis=1) + 1e-3
                total = np.add.reduceat(network.predict(rows) * letters[:, None], starts[:-1], axis=0)
                mean = total / total.sum(axis=1, keepdims=True)
                names += [network.languages[i] for i in mean.argmax(axis=1)]
                scores += np.clip(mean.max(axis=1), 0, 1).tolist()
            yield pd.DataFrame({"name": pd.Series(names, dtype=object), "score": pd.Series(scores, dtype="float64")})

    small_batches(docs.sparkSession)
    # What is told once isn't told again for a filter on it.
    told = F.pandas_udf(made, "name string, score double").asNondeterministic()(text)
    name = "_told"
    while name in docs.columns:
        name += "_"
    rows = docs.withColumn(name, F.when(lettered(text), told))
    return rows.withColumns({"lang_pred": F.coalesce(F.col(f"{name}.name"), F.lit(UNKNOWN)), "score": F.coalesce(F.col(f"{name}.score"), F.lit(0.0))}).drop(name)


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id_col, held_out, lang_pred, score of each row, by a network learned from the rows that aren't held out."""
    network = train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"), held_out(F.col(id_col)).alias("held_out"))
    return predict(rows, network, id_col=id_col, text_col="text").select(id_col, "held_out", "lang_pred", "score")
