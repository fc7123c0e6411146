"""Token counts of a byte-pair vocabulary, without making the tokens.

The symbols of a piece of text form a linked list and its adjacent pairs a heap.  The pair of
the lowest rank, the leftmost first, is merged until none is left: the count is the number of
symbols at the start less the merges.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotscope.llm.common import rows_with

#: The mark that stands for a blank in the vocabulary (fixed value).
BLANK = "\u2581"
LIMIT = 4096
#: Counted pieces that a worker remembers before it starts anew; the counts don't depend on it.
REMEMBERED = 1 << 19
REMEMBERED_LENGTH = 48


def merged_count(symbols: str, rank: Callable[[str], float | None], cost: Callable[[str], int]) -> int:
    """Number of tokens of ``symbols``: ``cost`` of every character less the merges.

    ``rank`` gives the rank of a joined pair, None if the vocabulary lacks it.
    """
    n = len(symbols)
    count = sum(map(cost, symbols))
    text: list[str] = list(symbols)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    heap: list[tuple[float, int, int]] = []

    def offer(left: int) -> None:
        if left >= 0 and (right := after[left]) >= 0:
            joined = text[left] + text[right]
            if (r := rank(joined)) is not None:
                heapq.heappush(heap, (r, left, len(joined)))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, left, size = heapq.heappop(heap)
        right = after[left] if text[left] else -1
        if right < 0 or len(text[left]) + len(text[right]) != size:
            continue  # one of the two has been merged meanwhile
        text[left] += text[right]
        text[right] = ""
        after[left] = after[right]
        if after[left] >= 0:
            before[after[left]] = left
        count -= 1
        offer(before[left])
        offer(left)
    return count


class PieceCounter:
    """Counts for a vocabulary of pieces with scores in which blanks begin pieces and bytes
    stand in for unknown characters.  ``scores`` has no byte, control or unknown pieces."""

    def __init__(self, scores: dict[str, float]):
        self.ranks = {piece: -score for piece, score in scores.items()}
        long = [p for p in self.ranks if len(p) > 1]
        if any(BLANK in p.lstrip(BLANK) for p in long):
            raise ValueError("pieces must not hold a blank after another character")
        # No piece crosses from a character to a blank, and characters that are in no longer
        # piece never merge: text is cut there, and each part is counted on its own.
        inside = "".join(map(re.escape, sorted(set("".join(long)) - {BLANK})))
        self.parts = re.compile(f"{BLANK}+[{inside}]*|[{inside}]+" if inside else f"{BLANK}+")
        self.alone = re.compile(f"[^{BLANK}{inside}]")
        self.known: dict[str, int] = {}

    def cost(self, character: str) -> int:
        return 1 if character in self.ranks else len(character.encode())

    def part(self, symbols: str) -> int:
        count = merged_count(symbols, self.ranks.get, self.cost)
        if len(symbols) <= REMEMBERED_LENGTH:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[symbols] = count
        return count

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        marked = BLANK + text.replace(" ", BLANK)
        known, part, total = self.known, self.part, 0
        for symbols in self.parts.findall(marked):
            n = known.get(symbols)
            total += part(symbols) if n is None else n
        return total + sum(map(self.cost, self.alone.findall(marked)))


def read_pieces(path: str) -> dict[str, float]:
    """Scores of the ordinary pieces of a SentencePiece byte-pair model.

    The model must leave texts as they are but for a blank put in front, as this counter does.
    """
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    probe = "  A\u00c5\ufb01 a\u0301  "
    if model.normalize(probe) != BLANK + probe.replace(" ", BLANK):
        raise ValueError(f"{path} normalises texts")
    special = (model.is_unknown, model.is_control, model.is_byte, model.is_unused)
    return {
        model.id_to_piece(i): model.get_score(i)
        for i in range(model.vocab_size())
        if not any(f(i) for f in special)
    }


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``n_bytes`` (UTF-8) and ``n_tokens`` of every whole text of ``docs``.

    A null text counts as an empty one, which has no tokens.  Repeated rows give repeated
    result rows; further columns are ignored.  The vocabulary is read on the driver and sent
    to the workers; its size is that of the file.
    """
    sent = docs.sparkSession.sparkContext.broadcast(read_pieces(path))
    ready: list[PieceCounter] = []

    def rows(ids, sizes, texts):
        if not ready:
            ready.append(PieceCounter(sent.value))
        return [ids, sizes, [ready[0].count(t) for t in texts]]

    return rows_with(
        docs,
        {"doc_id": "doc_id", "n_bytes": "coalesce(octet_length(text), 0)", "text": "text"},
        "doc_id bigint, n_bytes bigint, n_tokens bigint",
        rows,
    )


def op10_token_counts(docs: DataFrame, path: str) -> DataFrame:
    return token_counts(docs, path).withColumn("over_limit", F.col("n_tokens") > LIMIT)
