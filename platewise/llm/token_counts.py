"""Token counts under a unigram vocabulary, by dynamic programming over a trie.

A pre-token is a word with its leading word mark.  The distinct pre-tokens of
a task go into a trie; a node holds the best unigram score of the path to it
and how many tokens that takes, so pre-tokens with a common prefix share the
forward pass over it, and a terminal's count is read off.  A document's count
is the sum over its words.

The scores are log-probabilities.  A vocabulary file of merged pieces has none,
only the pieces' order; as pieces were merged by falling frequency, their
probabilities are taken to follow a Zipf-Mandelbrot law of that order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .text import utf8

# The mark of a word's start, and the score below the worst
# piece's at which a character without a piece is taken.
MARK, UNKNOWN_BELOW = "▁", 10.0
#: Parameter: the offset of the law's ranks.
OFFSET = 100
#: Nodes after which a task's trie starts anew, and words after which its
#: terminals' counts do; they bound its memory, not its results.
MAX_NODES, MAX_WORDS = 800_000, 1_000_000


class Vocabulary:
    """Pieces with their scores; ``missing`` is the score of one character
    that no piece covers, which counts as its UTF-8 bytes (byte fallback)."""

    def __init__(self, scores: dict[str, float], byte_fallback: bool = True):
        self.scores = scores
        self.missing = min(scores.values(), default=0.0) - UNKNOWN_BELOW
        self.byte_fallback = byte_fallback
        #: Trie of the pieces from their last character on: character -> [score or None, children].
        self.backwards: dict[str, list] = {}
        for piece, score in scores.items():
            children = self.backwards
            for c in reversed(piece):
                node = children.setdefault(c, [None, {}])
                children = node[1]
            node[0] = score

    @classmethod
    def load(cls, model_path: str, offset: float = OFFSET) -> Vocabulary:
        """Normal pieces of a SentencePiece model file.  Where the file has
        merge ranks in place of log-probabilities (scores 0, -1, -2, ...),
        piece r has probability proportional to 1 / (r + offset).  Pieces
        outside the order come last: the mark alone; runs of marks, which no
        word has, are left out."""
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=model_path)
        found = {p.id_to_piece(i): p.get_score(i) for i in range(p.get_piece_size())
                 if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))}
        if all(s == round(s) for s in found.values()):
            ranked = {piece: -s for piece, s in found.items() if s > -len(found) - p.get_piece_size()}
            ranked.setdefault(MARK, max(ranked.values()) + 1)
            total = sum(1 / (r + offset) for r in ranked.values())
            found = {piece: -math.log((r + offset) * total) for piece, r in ranked.items()}
        return cls(found)


class Trie:
    """Nodes are numbers, 0 the root: ``score`` and ``tokens`` hold the forward
    pass of a node's path, done once, when the node is made, and ``child``
    leads on by (node, character).  The last pieces that fit a path are found
    in a second trie, of the pieces spelled backwards."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.child: dict[int, int] = {}
        self.score, self.tokens = [0.0], [0]

    def __len__(self) -> int:
        return len(self.score)

    def count(self, pretoken: str) -> int:
        child, score, tokens, v = self.child, self.score, self.tokens, self.v
        path = [0]
        for i, c in enumerate(pretoken):
            way = path[i] * 0x110000 + ord(c)
            node = child.get(way)
            if node is None:
                # the best last piece of the path to the new node
                best = n = None
                j, piece = i, v.backwards.get(c)
                while piece is not None:
                    own = piece[0]
                    if own is not None:
                        own += score[path[j]]
                        if best is None or own >= best:
                            best, n = own, tokens[path[j]] + 1
                    if not j:
                        break
                    j -= 1
                    piece = piece[1].get(pretoken[j])
                if c not in v.scores:
                    own = score[path[i]] + v.missing
                    if best is None or own > best:
                        best, n = own, tokens[path[i]] + (len(c.encode()) if v.byte_fallback else 1)
                node = child[way] = len(score)
                score.append(best)
                tokens.append(n)
            path.append(node)
        return tokens[path[-1]]


def count_tokens(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens) for every row.  Null and empty texts count
    0.  Of equally good segmentations the one with the longer last piece
    counts.  Rows that repeat are counted each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, known = Trie(vocabulary), {}
        for b in batches:
            words, tokens = [], []
            for t in utf8(b.column(1)):
                w = (t or b"").split()
                for new in set(w).difference(known):
                    known[new] = trie.count(MARK + new.decode())
                words.append(len(w))
                tokens.append(sum(map(known.__getitem__, w)))
                if len(trie) > MAX_NODES:
                    trie = Trie(vocabulary)
                if len(known) > MAX_WORDS:
                    known = {}
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())],
                names=["doc_id", "n_words", "n_tokens"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(run, "doc_id long, n_words long, n_tokens long"))
