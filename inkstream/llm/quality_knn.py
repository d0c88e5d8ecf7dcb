"""Quality scores by nearest-neighbour voting in a latent-semantic space.

A text becomes a sparse vector of two hashed blocks: its words, and the shapes of its tokens (runs of letters,
capitals, digits and marks, alone and beside their neighbour's shape, and whether a token repeats the one before).
Tokens of more than PIECE_CHARS characters are cut into pieces, which all count.
A bounded sample of labelled rows gives the inverse document frequencies, the latent axes (truncated singular value
decomposition by random projection) and the labelled vectors. These are broadcast; every document's cosine with every
labelled vector is computed exactly, block by block, and its nearest neighbours vote with their similarity.
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  makes pa.compute known
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembered, in_batches, labelled_sample

#: Labelled rows that the model is made of, at most; the first by a hash of the id.
LABELLED_ROWS = 4000
WORD_DIMS, SHAPE_DIMS, AXES, NEIGHBOURS = 4096, 512, 48, 15
#: Documents and labelled vectors of one product.
DOC_BLOCK, LABEL_BLOCK = 1024, 1024
#: A document that is like no labelled one scores as the labelled rows do on average, or this without any.
NO_LABELS = 0.5
_DIMS = WORD_DIMS + SHAPE_DIMS
_WORD_WEIGHT = 0.5


def shape(token: str) -> str:
    """Runs of one kind of character as one letter each: a, A, 0, or the mark itself."""
    kinds: list[str] = []
    for char in token:
        kind = "a" if char.islower() else "A" if char.isupper() else "0" if char.isdigit() else "x" if char.isalpha() else char
        if not kinds or kinds[-1] != kind:
            kinds.append(kind)
    return "".join(kinds)


#: Longer tokens (texts without blanks, encoded data) count as successive pieces of this length.
PIECE_CHARS = 64


def tokens_of(text: str | None) -> list[str]:
    """The blank-separated tokens of the whole text, long ones in pieces."""
    tokens = (text or "").split()
    if max(map(len, tokens), default=0) <= PIECE_CHARS:
        return tokens
    return [t[at : at + PIECE_CHARS] for t in tokens for at in range(0, len(t), PIECE_CHARS)]


def _token(token: str) -> int:
    """The word's dimension in the lowest bits, a number of the shape above them."""
    return crc32(shape(token).encode("utf-8", "surrogatepass")) * WORD_DIMS + crc32(token.lower().encode("utf-8", "surrogatepass")) % WORD_DIMS


_tokens = Remembered(_token, 400_000, PIECE_CHARS)


def sparse_vectors(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row starts, dimensions, weights) of the texts: 1 + log of each count, without document frequencies."""
    starts, dims, counts = [0], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for text in texts:
        tokens = tokens_of(text)
        codes = np.fromiter(map(_tokens.__getitem__, tokens), np.int64, len(tokens))
        shapes = codes // WORD_DIMS
        pairs = (shapes[:-1] * 31 + shapes[1:] + 1) % SHAPE_DIMS
        found = np.bincount(codes % WORD_DIMS, minlength=_DIMS)
        found[WORD_DIMS:] = np.bincount(shapes % SHAPE_DIMS, minlength=SHAPE_DIMS) + np.bincount(pairs, minlength=SHAPE_DIMS)
        found[-1] += sum(map(operator.eq, tokens, tokens[1:]))
        at = np.flatnonzero(found)
        dims.append(at)
        counts.append(found[at])
        starts.append(starts[-1] + len(at))
    return np.array(starts), np.concatenate(dims).astype(np.int32), 1 + np.log(np.concatenate(counts).astype(np.float32))


def scaled(starts: np.ndarray, dims: np.ndarray, weights: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weights times document frequencies, each block of each text brought to its length."""
    weights = weights * idf[dims]
    rows = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    block = 2 * rows + (dims >= WORD_DIMS)
    norms = np.sqrt(np.bincount(block, weights * weights, 2 * (len(starts) - 1)))
    norms[norms == 0] = 1
    return (weights / norms[block] * np.where(dims >= WORD_DIMS, 1.0, _WORD_WEIGHT)).astype(np.float32)


def project(starts: np.ndarray, dims: np.ndarray, weights: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Unit vectors in the latent space; a text without tokens is the zero vector."""
    out = np.zeros((len(starts) - 1, axes.shape[1]), np.float32)
    for row in range(len(out)):
        part = slice(starts[row], starts[row + 1])
        out[row] = weights[part] @ axes[dims[part]]
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norms > 0, norms, 1)


def latent_axes(starts: np.ndarray, dims: np.ndarray, weights: np.ndarray, count: int = AXES, rounds: int = 3) -> np.ndarray:
    """The leading right singular vectors, by subspace iteration from a fixed random start."""
    matrix = np.zeros((len(starts) - 1, _DIMS), np.float32)
    matrix[np.repeat(np.arange(len(matrix)), np.diff(starts)), dims] = weights
    space = np.random.default_rng(7).standard_normal((_DIMS, count + 8)).astype(np.float32)
    for _ in range(rounds):
        space = np.linalg.qr(matrix.T @ (matrix @ space))[0]
    small = np.linalg.svd(matrix @ space, full_matrices=False)[2]
    return np.ascontiguousarray((space @ small.T)[:, : min(count, len(matrix))])


class Model:
    """What the labelled sample leaves: document frequencies, axes, vectors and labels."""

    def __init__(self, starts: np.ndarray, dims: np.ndarray, weights: np.ndarray, labels: np.ndarray) -> None:
        seen = np.bincount(dims, minlength=_DIMS)
        self.idf = (np.log((1 + len(labels)) / (1 + seen)) + 1).astype(np.float32)
        weights = scaled(starts, dims, weights, self.idf)
        self.axes = latent_axes(starts, dims, weights)
        self.vectors = project(starts, dims, weights, self.axes)
        self.labels = labels.astype(np.float32)
        self.prior = float(labels.mean())

    def vote(self, vectors: np.ndarray) -> np.ndarray:
        """Similarity-weighted mean label of the nearest neighbours, over exact cosines in blocks."""
        k = min(NEIGHBOURS, len(self.labels))
        near, label = np.full((len(vectors), k), -2, np.float32), np.zeros((len(vectors), k), np.float32)
        for first in range(0, len(self.labels), LABEL_BLOCK):
            block = slice(first, first + LABEL_BLOCK)
            cosines = np.concatenate([near, vectors @ self.vectors[block].T], axis=1)
            labels = np.concatenate([label, np.broadcast_to(self.labels[block], (len(vectors), cosines.shape[1] - k))], axis=1)
            at = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
            near, label = np.take_along_axis(cosines, at, axis=1), np.take_along_axis(labels, at, axis=1)
        weight = np.maximum(near, 0).astype(np.float64)
        total = weight.sum(axis=1)
        return np.where(total > 0, (weight * label).sum(axis=1) / np.where(total > 0, total, 1), self.prior)

    def scores(self, texts: list) -> np.ndarray:
        found = []
        for first in range(0, len(texts), DOC_BLOCK):
            starts, dims, weights = sparse_vectors(texts[first : first + DOC_BLOCK])
            found.append(self.vote(project(starts, dims, scaled(starts, dims, weights, self.idf), self.axes)))
        return np.clip(np.concatenate(found), 0.0, 1.0) if found else np.zeros(0)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", labelled_rows: int = LABELLED_ROWS) -> Model | None:
    """The model of at most labelled_rows labelled documents; None without any.

    The texts stay on the executors: their sparse vectors (at most WORD_DIMS + SHAPE_DIMS entries each) come back.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("label"))
    rows = labelled_sample(docs, known, id_col, text_col, labelled_rows, "label")

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            starts, dims, weights = sparse_vectors(batch.column(2).to_pylist())
            lists = [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(dims, pa.int32())), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(weights, pa.float32()))]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=["label_id", "label", "dims", "weights"])

        return run

    id_type = docs.schema[id_col].dataType.simpleString()
    found = in_batches(rows, f"label_id {id_type}, label int, dims array<int>, weights array<float>", make).toArrow().combine_chunks()
    if not found.num_rows:
        return None
    found = found.take(pa.compute.sort_indices(found.select(["label_id", "label"]), [("label_id", "ascending"), ("label", "ascending")]))
    lengths = pa.compute.list_value_length(found["dims"]).to_numpy()
    flat = [pa.compute.list_flatten(found[c]).to_numpy() for c in ("dims", "weights")]
    return Model(np.concatenate([[0], np.cumsum(lengths)]), flat[0], flat[1], found["label"].to_numpy())


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every whole text: 0 to 1, higher where good neighbours are nearer.

    Null and empty texts, and texts like no labelled one, get the labelled rows' mean label (NO_LABELS without any).
    Repeated rows and null ids stay; an empty table gives no rows; extra columns aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        known = shared.value

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).to_pylist()
            found = known.scores(texts) if known is not None else np.full(len(texts), NO_LABELS)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=[id_col, "score"])

        return run

    return in_batches(docs.select(id_col, text_col), f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double", make)
