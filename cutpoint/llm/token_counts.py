"""Token counts by a linear longest-match automaton.

Words are cut greedily into the longest pieces of a vocabulary that distinguishes pieces at the beginning of
a word from pieces within. The vocabulary is a trie with failure links: where no edge leads on, the link
tells which pieces the longest match has yielded (only their number is kept) and where in the trie to go on.
So every character is looked at once and no piece is ever built.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cutpoint.llm.pieces import MARK, fields
from cutpoint.llm.texts import WORD, quoted, whole, without

#: Words whose counts one Python worker remembers; then it forgets all of them.
REMEMBERED = 500_000
LONGEST_REMEMBERED = 64


def vocabulary(model: bytes) -> tuple[list[str], list[str]]:
    """Pieces that begin a word and pieces within one, from a SentencePiece model file: with and without mark.

    The mark alone is a beginning piece with nothing after it: the empty string.
    """
    first, inner = [], []
    for number, value, _ in fields(model):
        if number == 1:
            piece = {n: v for n, v, _ in fields(value)}
            text = piece.get(1, b"").decode(errors="replace")
            if piece.get(3, 1) == 1 and text:
                (first if text.startswith(MARK) else inner).append(text.removeprefix(MARK))
    return first, inner


class Automaton:
    """Nodes are numbered; 0 is the root of a word, 1 the root within a word."""

    def __init__(self, first: list[str], inner: list[str]):
        self.edges: list[dict[str, int]] = [{}, {}]
        whole_piece = {}
        for root, pieces in ((0, first), (1, inner)):
            for piece in pieces:
                node = root
                for c in piece:
                    if c not in self.edges[node]:
                        self.edges[node][c] = len(self.edges)
                        self.edges.append({})
                    node = self.edges[node][c]
                if node > 1:
                    whole_piece[node] = True
        size = len(self.edges)
        #: Where to go on when no edge fits (−1: the word can't be cut), and the pieces done with by then.
        self.link, self.popped = [-1] * size, [0] * size
        if "" in first:  # the mark alone: any word may go on within
            self.link[0], self.popped[0] = 1, 1
        todo = deque([0, 1])
        while todo:
            node = todo.popleft()
            for c, child in self.edges[node].items():
                todo.append(child)
                if child in whole_piece:
                    self.link[child], self.popped[child] = 1, 1
                    continue
                z, n = self.link[node], self.popped[node]
                while z >= 0 and c not in self.edges[z]:
                    n, z = n + self.popped[z], self.link[z]
                if z >= 0:
                    self.link[child], self.popped[child] = self.edges[z][c], n
        #: Pieces of what a node still holds at the end of a word (−1: it can't be cut).
        self.rest = [0] * size
        for node in range(size):
            z, n = node, 0
            while z >= 0 and z != 1:
                n, z = n + self.popped[z], self.link[z]
            self.rest[node] = n if z == 1 else -1

    def count(self, word: str) -> int:
        """Pieces of a word; 0 if it can't be cut."""
        edges, link, popped = self.edges, self.link, self.popped
        node = n = 0
        for c in word:
            while (to := edges[node].get(c)) is None:
                n += popped[node]
                node = link[node]
                if node < 0:
                    return 0
            node = to
        return n + self.rest[node] if self.rest[node] >= 0 else 0


@lru_cache(maxsize=2)
def automaton(model: bytes, mark_alone: bool) -> Automaton:
    first, inner = vocabulary(model)
    return Automaton(first if mark_alone else [p for p in first if p], inner)


_known: dict[tuple[bytes, bool], dict[str, int]] = {}


def count(df: DataFrame, model_path: str, text: str = "text", *, mark_alone: bool = False) -> DataFrame:
    """Add n_words, n_tokens and n_unknown (long).

    ``mark_alone``: a word that no longer piece begins (numbers, Han) begins with the mark as a piece of its own,
    as the model has it. Otherwise it is unknown, as to a word-piece tokenizer, which has no such piece.
    A word that can't be cut counts as one token and one unknown word. Null and empty texts have none.
    Columns that already bear these names are replaced.
    """
    with open(model_path, "rb") as file:
        model = file.read()
    kept = without(df, "n_words", "n_tokens", "n_unknown").columns
    rows = df.select(*[quoted(c) for c in kept], whole(quoted(text)).alias("\0text"))
    added = ("n_words", "n_tokens", "n_unknown")
    schema = ", ".join([f"{quoted(n)} {t}" for n, t in rows.dtypes[:-1]] + [f"{n} bigint" for n in added])
    find = re.compile(WORD).findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, known = automaton(model, mark_alone), _known.setdefault((model, mark_alone), {})
        for batch in batches:
            sums = np.zeros((3, batch.num_rows), np.int64)
            for i, value in enumerate(batch.column(batch.num_columns - 1)):
                words = find(value.as_py())
                found = list(map(known.get, words))
                if None in found:
                    if len(known) > REMEMBERED:
                        known.clear()
                    new = {w: machine.count(w) for w, f in zip(words, found) if f is None}
                    found = [new[w] if f is None else f for w, f in zip(words, found)]
                    known.update((w, n) for w, n in new.items() if len(w) <= LONGEST_REMEMBERED)
                unknown = found.count(0)
                sums[:, i] = len(words), sum(found) + unknown, unknown
            new_columns = [pa.array(s) for s in sums]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new_columns], names=[*batch.schema.names[:-1], *added])

    return rows.mapInArrow(run, schema)
