"""Token counts by byte-pair merging on a heap and a linked list, without making token ids.

The vocabulary of a sentencepiece BPE model gives the pieces and their ranks. A text starts as its characters; the
best-ranked adjacent pair that is a piece merges, leftmost first among equals, until none is left. The count is the
initial symbols minus the merges; a character outside the vocabulary counts as its UTF-8 bytes.

Blanks become the mark U+2581, and one is put before the text. No piece holds a mark after another character (checked
when the model is read), so merges never cross from a word into the blanks before the next: a text is cut there, and
again between characters that stand side by side in no piece. Counts of distinct parts are remembered in a table of
bounded size.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembered, per_text

MARK = "▁"
#: Distinct chunks, and parts of chunks, that a worker remembers, and the longest one worth remembering.
CACHE_ENTRIES, CACHE_CHARS = 500_000, 64
_CHUNKS = re.compile(f"{MARK}+[^{MARK}]*")


def merged_count(symbols: str, ranks: dict[str, int]) -> int:
    """Number of tokens that merging leaves of a chunk.

    ranks: piece to rank, lowest merged first. The heap holds (rank, position of the left symbol, right symbol,
    merged piece); an entry whose symbols have changed since is passed over.
    """
    count = len(symbols)
    pieces: list[str] = list(symbols)
    after = list(range(1, count + 1))
    before = list(range(-1, count - 1))
    heap = []
    for at in range(count - 1):
        pair = symbols[at : at + 2]
        if pair in ranks:
            heap.append((ranks[pair], at, at + 1, pair))
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, left, right, pair = heapq.heappop(heap)
        if not pieces[left] or after[left] != right or pieces[left] + pieces[right] != pair:
            continue
        merges += 1
        pieces[left], pieces[right] = pair, ""
        following = after[left] = after[right]
        if following < count:
            before[following] = left
            joined = pair + pieces[following]
            if joined in ranks:
                heapq.heappush(heap, (ranks[joined], left, following, joined))
        previous = before[left]
        if previous >= 0:
            joined = pieces[previous] + pair
            if joined in ranks:
                heapq.heappush(heap, (ranks[joined], previous, left, joined))
    # Characters that are no piece and merged into none stand for their bytes.
    unknown = sum(len(p.encode("utf-8", "surrogatepass")) - 1 for p in pieces if len(p) == 1 and p not in ranks)
    return count + unknown - merges


def segments(chunk: str, bonds: frozenset[str]) -> list[str]:
    """The chunk cut between characters that stand side by side in no piece: no merge reaches over such a cut."""
    found, first = [], 0
    for at in range(len(chunk) - 1):
        if chunk[at : at + 2] not in bonds:
            found.append(chunk[first : at + 1])
            first = at + 1
    found.append(chunk[first:])
    return found


def text_counter(ranks: dict[str, int]) -> Callable[[str | None], int]:
    """Function from a text to its token count; null and empty texts have none."""
    if any(MARK in piece.lstrip(MARK) for piece in ranks):
        return lambda text: merged_count(MARK + text.replace(" ", MARK), ranks) if text else 0
    bonds = frozenset(piece[i : i + 2] for piece in ranks for i in range(len(piece) - 1))
    parts = Remembered(lambda part: merged_count(part, ranks), CACHE_ENTRIES, CACHE_CHARS)
    counts = Remembered(lambda rest: sum(map(parts.__getitem__, segments(MARK + rest, bonds))), CACHE_ENTRIES, CACHE_CHARS)

    def count(text: str | None) -> int:
        if not text:
            return 0
        chunks = text.replace(" ", MARK).split(MARK)
        if "" in chunks:  # several blanks in a row, or some at an end
            chunks = [c[1:] for c in _CHUNKS.findall(MARK + MARK.join(chunks))]
        return sum(map(counts.__getitem__, chunks))

    return count


@functools.cache
def counter_of(path: str) -> Callable[[str | None], int]:
    """One counter for all tasks of a worker process."""
    return text_counter(sentencepiece_ranks(path))


def sentencepiece_ranks(path: str) -> dict[str, int]:
    """Pieces of the model that may merge, by rank: the better score first.

    Fails for models whose text rules differ from those of this module (identity normalisation, one blank added in
    front, blanks kept, bytes for unknown characters).
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    probe = " Åﬁ  a\x01"
    pieces = model.encode(probe, out_type=str)
    if not model.is_byte(model.piece_to_id("<0x00>")) or not "".join(pieces).startswith(MARK + MARK):
        raise ValueError("the model changes texts in a way that this operator doesn't know")
    usual = [i for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i))]
    usual.sort(key=lambda i: -model.get_score(i))
    return {model.id_to_piece(i): rank for rank, i in enumerate(usual)}


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every whole text.

    Null and empty texts have 0 bytes and 0 tokens. Rows are independent: repeated rows and null ids stay, an empty
    table gives no rows, extra columns aren't read. model_path is read by each task; the file is part of the
    installation on every machine.
    """

    def make() -> Callable[[list], list[pa.Array]]:
        count = counter_of(model_path)

        def run(texts: list) -> list[pa.Array]:
            sizes = [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts]
            return [pa.array(sizes, pa.int64()), pa.array([count(t) for t in texts], pa.int64())]

        return run

    counted = per_text(docs, [id_col], "n_bytes bigint, n_tokens bigint", make, text_col)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
