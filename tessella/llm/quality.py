"""Text quality by a byte-level convolutional network in numpy.

A text's UTF-8 bytes are covered whole by overlapping chunks of two ``BLOCK``-byte blocks, each
chunk sharing a block with the next. Learned filters of ``WIDTH`` bytes slide over byte embeddings;
their largest values in a chunk are its features. A hidden layer looks at each chunk's features,
its units' largest values over all chunks are the document's, and a logistic unit makes one
probability of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import checkpoint

#: Bytes of a filter, of a step between its places, and of a block; a chunk is two blocks.
WIDTH, STEP, BLOCK = 8, 2, 128
#: Components of a byte's embedding, filters, hidden units.
EMBEDDING, FILTERS, HIDDEN = 8, 32, 16
#: Labelled rows to fit on, at most; those of the smallest hash of their id. Longer texts than ``MAX_BYTES`` are not fitted on.
MAX_LABELLED, MAX_BYTES = 12_000, 65_536
#: Groups of labelled rows that are fitted side by side, rounds after which their networks are averaged, rows of one step.
GROUPS, ROUNDS, STEP_ROWS = 8, 10, 32
#: Rate of the first round; it falls linearly to a tenth.
RATE = 0.01
#: Bytes that filters go over at a time, and bytes of texts that are scored together.
PIECE, TOGETHER = 1 << 16, 1 << 22


@dataclass
class Network:
    """Weights by name; ``base`` is the score where nothing could be learned."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)
    base: float | None = None

    def tables(self) -> np.ndarray:
        """For each place in a filter and each byte what they add to every filter."""
        return np.ascontiguousarray(np.einsum("be,jef->jbf", self.weights["bytes"], self.weights["filters"]), dtype=np.float32)


def fresh(seed: int = 11) -> Network:
    """A network before training."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: rng.normal(0, scale, shape)
    return Network({
        "bytes": draw(256, EMBEDDING, scale=0.5), "filters": draw(WIDTH, EMBEDDING, FILTERS, scale=(2 / (WIDTH * EMBEDDING)) ** 0.5), "filters0": np.zeros(FILTERS),
        "hidden": draw(FILTERS, HIDDEN, scale=(2 / FILTERS) ** 0.5), "hidden0": np.full(HIDDEN, 0.1), "out": draw(HIDDEN, scale=HIDDEN**-0.5), "out0": np.zeros(1),
    })


class Laid:
    """Texts one after another in blocks: each is followed by at least ``WIDTH`` zero bytes up to the end of a block."""

    def __init__(self, texts: list[np.ndarray]):
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.blocks = -(-(sizes + WIDTH) // BLOCK)
        self.ends = np.cumsum(self.blocks)
        self.bytes = np.zeros(int(self.ends[-1]) * BLOCK + WIDTH, dtype=np.uint8)
        for text, end, n in zip(texts, self.ends, self.blocks, strict=True):
            at = int(end - n) * BLOCK
            self.bytes[at : at + len(text)] = text
        # chunk k of a text is its blocks k and k + 1; a text of one block is one chunk
        self.chunks = np.maximum(self.blocks - 1, 1)
        self.starts = np.cumsum(self.chunks) - self.chunks
        self.of = np.repeat(np.arange(len(texts)), self.chunks)
        within = np.arange(int(self.chunks.sum())) - self.starts[self.of]
        self.first = (self.ends - self.blocks)[self.of] + within
        self.second = np.minimum(self.first + 1, self.ends[self.of] - 1)

    def values(self, tables: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """Values of all filters at every place of the given blocks, ``(blocks, places, filters)``.

        Filters that begin within the last ``WIDTH`` bytes of a text's last block see zero bytes only, not the next text.
        """
        n = len(blocks)
        if n and blocks[-1] - blocks[0] == n - 1:  # blocks side by side need no index
            data = self.bytes[blocks[0] * BLOCK : blocks[-1] * BLOCK + BLOCK + WIDTH].astype(np.intp)
            spans = [data[j : j + n * BLOCK : STEP] for j in range(WIDTH)]
        else:
            at = (blocks[:, None] * BLOCK + np.arange(0, BLOCK, STEP)).ravel()
            spans = [self.bytes[at + j].astype(np.intp) for j in range(WIDTH)]
        total = np.take(tables[0], spans[0], axis=0)
        some = np.empty_like(total)
        for j in range(1, WIDTH):
            np.take(tables[j], spans[j], axis=0, out=some, mode="clip")
            total += some
        total = total.reshape(n, BLOCK // STEP, -1)
        last = np.isin(blocks, self.ends - 1)
        if last.any():
            total[last, -(WIDTH // STEP) + 1 :] = tables[:, 0].sum(0)
        return total

    def pooled(self, tables: np.ndarray) -> np.ndarray:
        """The largest value of each filter in each block."""
        n = int(self.ends[-1])
        out = np.empty((n, tables.shape[2]), dtype=np.float32)
        step = max(1, PIECE // BLOCK)
        for a in range(0, n, step):
            out[a : a + step] = self.values(tables, np.arange(a, min(a + step, n))).max(axis=1)
        return out


def forward(net: Network, tables: np.ndarray, laid: Laid) -> dict[str, np.ndarray]:
    """Probabilities of texts, with what training needs of the way there."""
    w = net.weights
    blocks = laid.pooled(tables)
    seen = np.maximum(np.maximum(blocks[laid.first], blocks[laid.second]) + w["filters0"].astype(np.float32), 0)
    hidden = np.maximum(seen @ w["hidden"].astype(np.float32) + w["hidden0"].astype(np.float32), 0)
    top = np.maximum.reduceat(hidden, laid.starts, axis=0)
    logit = top.astype(np.float64) @ w["out"] + w["out0"][0]
    return {"blocks": blocks, "seen": seen, "hidden": hidden, "top": top, "p": 1 / (1 + np.exp(-np.clip(logit, -40, 40)))}


def gradients(net: Network, laid: Laid, labels: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the weighted mean log loss.

    A maximum hands its gradient to where it was reached, so only chunks that win for a hidden unit,
    and in these the winning places of filters, are gone back to.
    """
    w, tables = net.weights, net.tables()
    f = forward(net, tables, laid)
    slope = (f["p"] - labels) * weights / weights.sum()
    out = {"out": f["top"].T.astype(np.float64) @ slope, "out0": np.array([slope.sum()])}
    to_top = slope[:, None] * w["out"] * (f["top"] > 0)
    hits = f["hidden"] == f["top"][laid.of]
    hits &= (to_top != 0)[laid.of]
    order, unit = np.nonzero(hits)
    _, once = np.unique(laid.of[order] * HIDDEN + unit, return_index=True)  # the first of equal maxima
    order, unit = order[once], unit[once]
    chunks, place = np.unique(order, return_inverse=True)
    to_hidden = np.zeros((len(chunks), HIDDEN))
    to_hidden[place, unit] = to_top[laid.of[order], unit]
    seen = f["seen"][chunks].astype(np.float64)
    out |= {"hidden": seen.T @ to_hidden, "hidden0": to_hidden.sum(0)}
    to_seen = (to_hidden @ w["hidden"].T) * (seen > 0)
    out["filters0"] = to_seen.sum(0)
    to_tables = np.zeros((WIDTH, 256, FILTERS))
    if len(chunks):
        left, right = laid.first[chunks], laid.second[chunks]
        block = np.where(f["blocks"][left] >= f["blocks"][right], left[:, None], right[:, None])
        every, row = np.unique(block, return_inverse=True)
        spots = np.concatenate([laid.values(tables, part).argmax(axis=1) for part in np.array_split(every, -(-len(every) * BLOCK // PIECE))])
        columns = np.broadcast_to(np.arange(FILTERS), block.shape)
        spot = spots[row.reshape(block.shape), columns]
        at = block * BLOCK + spot * STEP
        blank = np.isin(block, laid.ends - 1) & (spot > BLOCK // STEP - WIDTH // STEP)
        for j in range(WIDTH):
            seen_bytes = np.where(blank, 0, laid.bytes[at + j]).astype(np.int64)
            to_tables[j] = np.bincount((seen_bytes * FILTERS + columns).ravel(), to_seen.ravel(), 256 * FILTERS).reshape(256, FILTERS)
    out["filters"] = np.einsum("be,jbf->jef", w["bytes"], to_tables)
    out["bytes"] = np.einsum("jbf,jef->be", to_tables, w["filters"])
    return out


def fit_group(net: Network, texts: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, rate: float, seed: int) -> Network:
    """One pass of Adam over a group's rows in an order that ``seed`` fixes."""
    net = Network({k: v.copy() for k, v in net.weights.items()})
    m, v = ({k: np.zeros_like(x) for k, x in net.weights.items()} for _ in range(2))
    order = np.random.default_rng(seed).permutation(len(texts))
    for t, a in enumerate(range(0, len(order), STEP_ROWS), 1):
        some = order[a : a + STEP_ROWS]
        g = gradients(net, Laid([texts[i] for i in some]), labels[some], weights[some])
        for k, x in net.weights.items():
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
            x -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
    return net


def _packed(net: Network) -> bytes:
    return np.concatenate([net.weights[k].ravel() for k in sorted(net.weights)]).tobytes()


def _unpacked(data: np.ndarray, like: Network) -> Network:
    out, at = {}, 0
    for k in sorted(like.weights):
        shape = like.weights[k].shape
        out[k] = data[at : at + int(np.prod(shape))].reshape(shape)
        at += int(np.prod(shape))
    return Network(out)


def labelled(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """``doc_id, text, quality, part`` of at most ``limit`` labelled documents; ids with several labels take the smaller.

    The sample is broadcast (``limit`` ids), so the documents are read once and without a shuffle.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    return found.where(F.octet_length("text") <= MAX_BYTES).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(GROUPS)).cast("int"))


def _group_fit(shared, weight: dict[int, float], rate: float, round_: int) -> Callable:
    """What fits one group, from the network that was broadcast."""

    def fit(frame):
        import pandas as pd

        frame = frame.sort_values(["doc_id", "text"], kind="stable")
        quality, part = frame["quality"].to_numpy(), int(frame["part"].iloc[0])
        texts = [np.frombuffer(t.encode(), dtype=np.uint8) for t in frame["text"]]
        own = fit_group(shared.value, texts, quality.astype(float), np.where(quality == 1, weight[1], weight[0]), rate, 100 * round_ + part)
        return pd.DataFrame({"part": [part], "n": [len(frame)], "weights": [_packed(own)]})

    return fit


def train(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED, rounds: int = ROUNDS) -> Network:
    """Fit on at most ``limit`` labelled rows of ``docs(doc_id, text)`` and ``labels(doc_id, quality)``.

    Rows are dealt to ``GROUPS`` groups by a hash. In each round every group goes once over its rows
    in a task, from the common network, and the driver averages the groups' networks (some thousand
    numbers each) by their rows. Both classes weigh alike in sum. Null texts are empty; rows with a
    null id or another label than 0 and 1 count for nothing. With labels of one class or none there
    is nothing to learn: every score is then the share of the class, between 0 and 1.
    """
    rows = checkpoint(labelled(docs, labels, limit))
    n = {int(k): c for k, c in rows.groupBy("quality").count().collect()}
    if len(n) < 2:
        return Network(base=(n.get(1, 0) + 1) / (sum(n.values()) + 2))
    weight = {k: (n[0] + n[1]) / (2 * c) for k, c in n.items()}
    net = fresh()
    for k in range(rounds):
        shared = rows.sparkSession.sparkContext.broadcast(net)
        rate = RATE * (1 - 0.9 * k / max(rounds - 1, 1))

        found = sorted(rows.groupBy("part").applyInPandas(_group_fit(shared, weight, rate, k), "part int, n long, weights binary").collect())
        shared.unpersist()
        total = sum(r.n for r in found)
        net = _unpacked(sum(np.frombuffer(bytes(r.weights)) * (r.n / total) for r in found), net)
    return net


def probabilities(net: Network, tables: np.ndarray | None, texts: pa.Array) -> np.ndarray:
    """Scores of an array of texts; a null text is an empty one."""
    if net.base is not None:
        return np.full(len(texts), net.base)
    column = texts.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    out, held, size = [], [], 0
    for i in range(len(column)):
        held.append(data[offsets[i] : offsets[i + 1]])
        size += len(held[-1]) + BLOCK
        if size >= TOGETHER or i == len(column) - 1:
            out.append(forward(net, tables, Laid(held))["p"])
            held, size = [], 0
    return np.concatenate(out) if out else np.zeros(0)


def score(docs: DataFrame, net: Network) -> DataFrame:
    """Add ``score double`` (0 to 1, the higher the likelier of quality 1) to every row of ``docs``, which has ``text``.

    Whole texts are scored, without a shuffle. Null and empty texts get the network's score of zero
    bytes; a NUL character counts as such a byte. Repeated rows are scored alike, an empty table
    gives none. A column named ``score`` is replaced, others pass through.
    """
    kept = docs.drop("score")
    at = kept.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        tables = own.tables() if own.base is None else None
        for batch in batches:
            made = probabilities(own, tables, batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.float64())], names=[*batch.schema.names, "score"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType())]))


def drop_low_quality(docs: DataFrame, net: Network, threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs`` whose score is at least the threshold, with their own columns."""
    aside = {"score": "__own_score"} if "score" in docs.columns else {}
    found = score(docs.withColumnsRenamed(aside), net).where(F.col("score") >= threshold)
    return found.select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])
