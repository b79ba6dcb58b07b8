"""Token counts of documents under a unigram model, by dynamic programming in a trie of pre-tokens.

Each task inserts the distinct pre-tokens it meets in a trie, the sorted new ones of a stretch of rows at once, level by
level. A node holds the forward score of its prefix: the best sum of piece log-probabilities over all ways to cut it, and
the number of pieces of that cut. It is computed once, from its ancestors, whatever the number of pre-tokens that share
the prefix: all nodes of a level walk up towards the root together, as long as what they have read backwards is the end
of some piece (a state of the trie of reversed pieces). A terminal node's count is stored under its pre-token, and a
document's count is the sum over its words. Pre-tokens of more than LONG characters, of which a level would hold one or
two, go through a trie of the same kind a node at a time.

A pre-token is a word (a run of characters other than space and \\t\\n\\v\\f\\r) with the mark U+2581 before it. The
score of a piece is given, or taken from Zipf's law over the ranks of a public vocabulary file, -log(rank + 2.7). A
character outside the vocabulary becomes its UTF-8 bytes, each scored as the last rank. Among cuts of equal score the
one whose last piece is shortest counts.

Defined results: a null text counts as empty and has no tokens; repeated rows are counted one by one; an empty table
gives an empty result; other columns are ignored, whatever their names. Stored counts of more than NODES pre-tokens are
dropped and begun anew, which changes no count.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column, ddl_name, thrifty

MARK = "▁"
#: Stored counts of a task, and nodes of its trie of long pre-tokens.
NODES = 500_000
LONG = 64
#: Bytes of text whose new pre-tokens are inserted at once.
STRETCH = 1 << 22


def load_pieces(path: str) -> dict[str, float]:
    """Log-probability of every ordinary piece of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ordinary = [i for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
    return {model.id_to_piece(i): -math.log(rank + 2.7) for rank, i in enumerate(ordinary)}


class CountingTrie:
    """Counts of pre-tokens; nodes are numbers, children are found by (node, character)."""

    def __init__(self, pieces: dict[str, float], nodes: int = NODES):
        self.pieces, self.limit = pieces, nodes
        self.longest = max(map(len, pieces), default=1)
        self.byte_score = -math.log(len(pieces) + 2.7)
        self.clear()

    def clear(self) -> None:
        self.children: dict[tuple[int, str], int] = {}
        self.score, self.tokens = [0.0], [0]
        self.terminal: dict[str, int] = {}

    def insert(self, pretoken: str) -> int:
        """Tokens of the best cut of the pre-token; new nodes get their forward scores."""
        path, node = [0], 0
        score, tokens = self.score, self.tokens
        for d, c in enumerate(pretoken, 1):
            child = self.children.get((node, c))
            if child is None:
                width = len(c.encode("utf-8", "surrogatepass"))
                best, count = -math.inf, 0
                for k in range(1, min(d, self.longest) + 1):
                    piece = self.pieces.get(pretoken[d - k : d])
                    if piece is not None:
                        s = score[path[d - k]] + piece
                        if s > best:
                            best, count = s, tokens[path[d - k]] + 1
                if best == -math.inf:
                    best, count = score[node] + width * self.byte_score, tokens[node] + width
                elif c not in self.pieces and score[node] + width * self.byte_score > best:
                    best, count = score[node] + width * self.byte_score, tokens[node] + width
                child = len(score)
                self.children[node, c] = child
                score.append(best)
                tokens.append(count)
            node = child
            path.append(node)
        return tokens[node]


class LevelTrie:
    """Counts of many pre-tokens at once."""

    def __init__(self, pieces: dict[str, float]):
        self.byte_score = -math.log(len(pieces) + 2.7)
        # the trie of reversed pieces; a child is found by state << 21 | character
        children: dict[int, int] = {}
        ends = {0: -math.inf}
        for piece, score in pieces.items():
            state = 0
            for c in reversed(piece):
                state = children.setdefault(state << 21 | ord(c), len(children) + 1)
            ends[state] = score
        keys = np.array(sorted(children), np.int64)
        # an end that cannot match any key, so that every search lands inside
        self.keys = np.append(keys, np.iinfo(np.int64).max)
        self.targets = np.append(np.array([children[k] for k in keys.tolist()], np.int64), 0)
        self.ends = np.full(len(children) + 1, -math.inf)
        self.ends[list(ends)] = list(ends.values())
        single = np.zeros(0x110000, bool)
        single[[ord(p) for p in pieces if len(p) == 1]] = True
        self.single = single

    def count(self, pretokens: list[str]) -> np.ndarray:
        """Tokens of the best cut of every pre-token; they are sorted and distinct."""
        n = len(pretokens)
        lengths = np.fromiter(map(len, pretokens), np.int64, n)
        codes = np.frombuffer("".join(pretokens).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        begins = np.cumsum(lengths) - lengths
        most = int(len(codes)) + 1
        score, tokens = np.zeros(most), np.zeros(most, np.int64)
        parent, char = np.zeros(most, np.int64), np.zeros(most, np.int64)
        at = np.zeros(n, np.int64)  # the node of each word at the level before
        words = np.arange(n)
        out = np.zeros(n, np.int64)
        made = 1
        for depth in range(int(lengths.max(initial=0))):
            words = words[lengths[words] > depth]
            c, above = codes[begins[words] + depth], at[words]
            new = np.ones(len(words), bool)
            new[1:] = (above[1:] != above[:-1]) | (c[1:] != c[:-1])
            node = made + np.cumsum(new) - 1
            at[words] = node
            low, made = made, made + int(new.sum())
            parent[low:made], char[low:made] = above[new], c[new]
            # the forward score of every new node: one step up a round, while some piece ends that way
            best, count = np.full(made - low, -math.inf), np.zeros(made - low, np.int64)
            live, state, up = np.arange(made - low), np.zeros(made - low, np.int64), np.arange(low, made)
            while len(live):
                key = state << 21 | char[up]
                place = np.searchsorted(self.keys, key)
                known = self.keys[place] == key
                live, state, up = live[known], self.targets[place[known]], parent[up[known]]
                s = score[up] + self.ends[state]
                better = s > best[live]
                best[live[better]], count[live[better]] = s[better], tokens[up[better]] + 1
                more = up > 0
                live, state, up = live[more], state[more], up[more]
            own = char[low:made]
            width = 1 + (own > 0x7F) + (own > 0x7FF) + (own > 0xFFFF)
            spelled = score[parent[low:made]] + width * self.byte_score
            bytewise = ~self.single[own] & (spelled > best) | np.isneginf(best)
            best[bytewise], count[bytewise] = spelled[bytewise], (tokens[parent[low:made]] + width)[bytewise]
            score[low:made], tokens[low:made] = best, count
            done = lengths[words] == depth + 1
            out[words[done]] = tokens[node[done]]
        return out


class Counter:
    """Counts of pre-tokens given as UTF-8 words, stored as they are met."""

    def __init__(self, pieces: dict[str, float], nodes: int = NODES):
        self.levels, self.trie, self.limit = LevelTrie(pieces), CountingTrie(pieces, nodes), nodes
        self.known: dict[bytes, int] = {}

    def learn(self, words: set[bytes]) -> None:
        """Store the counts of the words."""
        if len(self.known) > self.limit:
            self.known = {}
        short = []
        for w in words - self.known.keys():
            pretoken = MARK + w.decode("utf-8", "surrogatepass")
            if len(pretoken) <= LONG:
                short.append((pretoken, w))
            else:
                self.known[w] = self.trie.insert(pretoken)
                if len(self.trie.score) > self.limit:
                    self.trie.clear()
        short.sort()
        for lo in range(0, len(short), 1 << 17):
            part = short[lo : lo + (1 << 17)]
            self.known.update(zip((w for _, w in part), self.levels.count([p for p, _ in part]).tolist()))

    def counts(self, texts: list[bytes]) -> tuple[list[int], list[int]]:
        """Words and tokens of every text."""
        lists = [t.split() for t in texts]
        self.learn(set().union(*lists))
        return list(map(len, lists)), [sum(map(self.known.__getitem__, x)) for x in lists]


def token_counts(docs: DataFrame, path: str | None, *, pieces: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", nodes: int = NODES) -> DataFrame:
    """id, n_words and n_tokens of every row, under pieces (log-probabilities), or else the vocabulary file at path."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        counter = Counter(pieces if pieces is not None else load_pieces(path), nodes)
        for batch in batches:
            n_words, n_tokens, held, size = [], [], [], 0
            for text in batch.column(1):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                held.append(raw)
                size += len(raw)
                if size >= STRETCH:
                    for total, part in zip((n_words, n_tokens), counter.counts(held)):
                        total += part
                    held, size = [], 0
            for total, part in zip((n_words, n_tokens), counter.counts(held)):
                total += part
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], [id_col, "n_words", "n_tokens"])

    return docs.select(column(id_col), column(text_col)).mapInArrow(thrifty(run), f"{ddl_name(id_col)} {id_type}, n_words long, n_tokens long")
