"""Language identification by a byte convolutional network.

A text is cut to windows of WINDOW bytes that overlap by the widest filter less one, so every run of bytes that a filter
can see lies whole in a window; the last one is filled up with zero bytes. A byte (letters A-Z lower-cased) has a learned
vector, filters of several widths slide over the vectors, each filter's highest answer in the window passes a rectifier,
and a softmax over the learned languages ends the network. A text's probabilities are the mean of its windows', weighed
by their letter bytes; the language is the most probable one (of equal ones, the least in code-point order).

Everything is trained here in numpy by Adam on a sample of at most about SAMPLE labelled texts, dealt evenly to the
languages, and SPREAD windows of each, evenly placed. Only the place of a filter's highest answer passes a gradient on.

Answers of a filter are sums of table entries: products of vectors and filters are made once for each byte and each pair
of bytes, so a window costs a few look-ups a byte. All sums run in a fixed order, so a text scores alike in any company.
Scoring is one pass without a shuffle over whole texts.

Edge cases: a null text and one without a letter (of any script) are UNKNOWN with score 0; so is every text if no label
can be learned from; of repeated rows of an id the least text, with its least language, is learned from; rows with a
null id are predicted and never learned from; a sample of one language predicts it with score 1; other columns stay, but
those named like the results are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import bounded_batches, delete, saved
from ._text import LOWER, buffers, slices

SAMPLE, SPREAD = 6_000, 3
WINDOW, WIDTHS, FILTERS, D = 256, (2, 3, 4), 16, 8
EPOCHS, STEPS, BATCH, RATE = 6, 300, 64, 4e-3  # STEPS at least, also of a small sample
AT_ONCE = 128  # windows
MANY_LANGUAGES = 100_000  # rows up to which the table of languages is broadcast: a few MB
UNKNOWN = "und"
STRIDE = WINDOW - max(WIDTHS) + 1

LETTER = np.zeros(256, bool)  # bytes that weigh: letters and what is beyond ASCII
for _r in (range(65, 91), range(97, 123), range(128, 256)):
    LETTER[list(_r)] = True


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, length, text) of every window; an empty text has one of no bytes."""
    size = np.diff(offsets)
    many = np.maximum(-(-(size - max(WIDTHS) + 1) // STRIDE), 1)
    text = np.repeat(np.arange(len(size)), many)
    at = (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)) * STRIDE
    return offsets[text] + at, np.minimum(size[text] - at, WINDOW), text


def filled(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The windows as a matrix of bytes, lower-cased, filled up with zeros."""
    place = np.arange(WINDOW)
    at = np.minimum(start[:, None] + place, max(len(data) - 1, 0))
    return np.where(place < size[:, None], LOWER[data[at]] if len(data) else np.uint8(0), np.uint8(0))


class Network:
    """vectors: 256 x D; filters: width x D x FILTERS each; bias of the filters; output: features x languages, bias."""

    def __init__(self, languages: list[str], vectors, filters, bias, output, shift):
        self.languages, self.vectors, self.filters, self.bias, self.output, self.shift = languages, vectors, filters, bias, output, shift

    def prepared(self) -> Network:
        """With the look-up tables: for each width the tables of a pair of bytes, and of a last single byte."""
        own = [[(self.vectors @ f[j]).astype(np.float32) for j in range(len(f))] for f in self.filters]
        self.tables = [[(t[j][:, None, :] + t[j + 1][None, :, :]).reshape(-1, FILTERS) if j + 1 < len(t) else t[j] for j in range(0, len(t), 2)] for t in own]
        return self

    def answers(self, x: np.ndarray) -> list[np.ndarray]:
        """Windows x places x FILTERS of each width."""
        pair = x[:, :-1].astype(np.intp) << 8 | x[:, 1:]
        out = []
        for width, tables in zip(WIDTHS, self.tables, strict=True):
            places, total = WINDOW - width + 1, None
            for i, table in enumerate(tables):
                source = pair if len(table) > 256 else x
                got = table[source[:, 2 * i : 2 * i + places]]
                total = got if total is None else np.add(total, got, out=total)
            out.append(total)
        return out

    def pooled(self, x: np.ndarray) -> np.ndarray:
        high = np.concatenate([a.max(axis=1) for a in self.answers(x)], axis=1)
        return np.maximum(high + self.bias, 0)

    def probabilities(self, features: np.ndarray) -> np.ndarray:
        z = np.tile(self.shift.astype(np.float64), (len(features), 1))
        for i in range(features.shape[1]):  # one order of sums, whatever windows come together
            z += features[:, i, None].astype(np.float64) * self.output[i]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the language, its probability) of each text of a slice."""
        n = len(offsets) - 1
        start, size, text = windows(data, offsets)
        letters = np.concatenate([[0], np.cumsum(LETTER[data])])
        weight = (letters[start + np.maximum(size, 0)] - letters[start]).astype(np.float64)
        total = np.zeros((n, len(self.languages)))
        for lo in range(0, len(start), AT_ONCE):
            p = self.probabilities(self.pooled(filled(data, start[lo : lo + AT_ONCE], size[lo : lo + AT_ONCE])))
            np.add.at(total, text[lo : lo + AT_ONCE], p * weight[lo : lo + AT_ONCE, None])
        total /= np.maximum(np.bincount(text, weight, n), 1)[:, None]
        best = total.argmax(axis=1)
        return best, np.clip(total[np.arange(n), best], 0, 1)


def fit(x: np.ndarray, y: np.ndarray, languages: list[str], seed: int = 5) -> Network:
    """Least cross-entropy over the windows x of the languages numbered y."""
    rng = np.random.default_rng(seed)
    k = FILTERS * len(WIDTHS)
    w = [rng.standard_normal((256, D)) * 0.5, *[rng.standard_normal((i, D, FILTERS)) / np.sqrt(i * D) for i in WIDTHS], np.zeros(k), rng.standard_normal((k, len(languages))) / np.sqrt(k), np.zeros(len(languages))]
    m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for _ in range(max(EPOCHS, STEPS // -(-len(x) // BATCH))):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), BATCH):
            pick = order[lo : lo + BATCH]
            grad = gradients(Network(languages, w[0], w[1 : 1 + len(WIDTHS)], w[-3], w[-2], w[-1]), x[pick], y[pick])[1]
            t += 1
            for i, g in enumerate(grad):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                w[i] = w[i] - RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    f32 = [a.astype(np.float32) for a in w]
    return Network(languages, f32[0], f32[1 : 1 + len(WIDTHS)], f32[-3], f32[-2].astype(np.float64), f32[-1])


def gradients(net: Network, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """(mean cross-entropy, its gradients: vectors, filters of each width, bias, output, shift)."""
    n = np.arange(len(x))
    answers = net.prepared().answers(x)
    where = [a.argmax(axis=1) for a in answers]  # windows x FILTERS
    high = np.concatenate([np.take_along_axis(a, i[:, None, :], 1)[:, 0] for a, i in zip(answers, where, strict=True)], axis=1) + net.bias
    features = np.maximum(high, 0).astype(np.float64)
    z = features @ net.output + net.shift
    z -= z.max(axis=1, keepdims=True)
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    loss = -np.log(np.maximum(p[n, y], 1e-300)).mean()
    dz = p.copy()
    dz[n, y] -= 1
    dz /= len(x)
    dh = (dz @ net.output.T) * (high > 0)
    vectors, filters = np.zeros_like(net.vectors, dtype=np.float64), []
    for i, f in enumerate(net.filters):
        d, df = dh[:, i * FILTERS : (i + 1) * FILTERS], np.zeros(f.shape)
        for j in range(len(f)):
            byte = x[n[:, None], where[i] + j]  # under the filter where it answers most
            df[j] = np.einsum("nf,nfd->df", d, net.vectors[byte])
            np.add.at(vectors, byte.ravel(), (d[:, :, None] * f[j].T[None]).reshape(-1, D))
        filters.append(df)
    return float(loss), [vectors, *filters, dh.sum(axis=0), features.T @ dz, dz.sum(axis=0)]


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def train(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """``learn``: a condition on id_col of the rows that may be learned from."""
    bounded_batches(docs.sparkSession)
    ident, text, lang = F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), F.col(f"`{lang_col}`").cast("string")
    known = docs.where(learn & ident.isNotNull() & lang.isNotNull() & has_letter(text))
    ids = known.select(ident.alias("_id"), lang.alias("_lang"))
    # as many texts of each language, by a hash of the id; only ids meet, then the texts of about SAMPLE of them are read
    each = ids.groupBy("_lang").agg(F.count("*").alias("_count"))
    each = saved(each)
    languages = each.count()
    if not languages:
        delete(each)
        return None
    share = F.lit(float(SAMPLE)) / languages / F.col("_count")
    draw = F.pmod(F.xxhash64("_id", F.lit(13)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    shares = each.select("_lang", share.alias("_share"))
    drawn = saved(ids.join(F.broadcast(shares) if languages <= MANY_LANGUAGES else shares, "_lang").where(draw < F.col("_share")).select("_id", "_lang").distinct())
    some = known.select(ident.alias("_id"), text.alias("_text"), lang.alias("_lang")).join(F.broadcast(drawn), ["_id", "_lang"], "left_semi")
    some = some.groupBy("_id").agg(F.min(F.struct("_text", "_lang")).alias("x")).select("x._text", "x._lang")

    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column(0))
            start, size, text = windows(data, offsets)
            many = np.bincount(text, minlength=batch.num_rows)
            first = np.cumsum(many) - many
            # SPREAD windows of each text, evenly placed, or all that it has
            at = first[:, None] + (np.arange(SPREAD) * (many[:, None] - 1) + 1) // max(SPREAD - 1, 1)
            at = np.unique(np.clip(at, first[:, None], (first + many - 1)[:, None]))
            x = filled(data, start[at], size[at])
            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(text[at])), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "x"])

    got = some.mapInArrow(run, "lang string, x binary").orderBy("lang", "x").toArrow()
    delete(drawn)
    delete(each)
    if not len(got):
        return None
    names = got.column("lang").to_pylist()
    languages = sorted(set(names))
    number = {a: i for i, a in enumerate(languages)}
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.uint8).reshape(-1, WINDOW)
    return fit(x, np.array([number[a] for a in names]), languages)


def predict(docs: DataFrame, model: Network | None, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``docs`` with the language and its probability for every row."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (lang_out, score_out)]
    if model is None:
        return docs.select(*others, F.lit(UNKNOWN).alias(lang_out), F.lit(0.0).alias(score_out))
    bounded_batches(docs.sparkSession)
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.when(has_letter(text), text).alias("_text_"), *others)  # null: unknown
    schema = ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes[1:]), f"`{lang_out}` string", f"`{score_out}` double"])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # some kilobytes

    def run(batches):
        net = sent.value.prepared()
        names = pa.array([*net.languages, UNKNOWN])
        for batch in batches:
            best, value = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for lo, hi, data, offsets in slices(batch.column(0)):
                best[lo:hi], value[lo:hi] = net.texts(data, offsets)
            none = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            best[none], value[none] = len(net.languages), 0
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], names.take(pa.array(best)), pa.array(value)], names=[*batch.schema.names[1:], lang_out, score_out])

    return rows.mapInArrow(run, schema)
