"""Exact byte-level BPE encoding and decoding with tree concatenation.

A text longer than a leaf is halved, wherever that falls, down to leaves of at most LEAF characters; the leaves are
encoded in parallel, and neighbours are joined up the tree. A join re-encodes a growing window around the cut: it reaches
k characters to either side, to the last place before and the first behind that is a token boundary whatever surrounds
it, and k doubles until both sides have such a place and their tokens break there too. Tokens outside the window stay.

Such a place lies behind a letter or digit where another kind of character follows, or before white space that follows
anything else. Where a side has none within WINDOW characters, the cut lies in one long pre-token. That is joined by
tokens: a window of the last k tokens of the left and the first k of the right side is re-encoded, and k doubles until
the window's first token equals the left side's and its last token the right side's. A token sequence is the BPE encoding
of its bytes exactly if every adjacent pair is, so the joined result is exact.

Only files of this kind are read: byte-level BPE with the published pre-token pattern, without normalizer, prefix space
or dropout, whose ids grow in the order of its merges; others raise ValueError.

Defined results: a null text counts as empty; an empty text has no ids and decodes to the empty string; the string of
a special token inside a text is that token, as in the tokenizers library; repeated rows are encoded one by one; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
import threading
import unicodedata
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column, ddl_name, thrifty

#: Characters of a leaf, and bytes of a leaf of one long pre-token.
LEAF = 1 << 12
LEAF_BYTES = 1 << 12
#: Characters to either side that a window reaches at first, and at most before the cut is taken to lie in one pre-token.
FIRST_WINDOW = 16
WINDOW = 1 << 11
#: Leaves of a text encoded at the same time.
THREADS = 2

#: Fixed value: the pre-token pattern of byte-level BPE, as published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in set(plain)):
        out[chr(256 + k)] = b
    return out


def _read(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Ranks by bytes and ids of special tokens of a vocabulary file; ValueError if it is of another kind."""
    spec = json.load(open(path, encoding="utf-8"))
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
    plain = plain and spec.get("normalizer") is None and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    if not plain or any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"not a plain byte-level BPE file: {path}")
    merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if any(a >= b for a, b in zip(merged, merged[1:])):
        raise ValueError(f"ids do not follow the order of the merges: {path}")
    alphabet = _byte_alphabet()
    return {bytes(alphabet[c] for c in token): i for token, i in model["vocab"].items() if token not in special}, special


#: Characters of a run of white space or of anything else that the encoder takes as one piece, quadratic in its length.
RUN = 1024
_BLANK = re.compile(r"\s{%d}" % (RUN + 1))


def _kind(c: str) -> str:
    """L, N, O (other) or S (white space) by the pattern, or ? where editions of Unicode may differ."""
    if c.isascii():
        return "S" if c in " \t\n\v\f\r" else "L" if c.isalpha() else "N" if c.isdigit() else "O"
    kind = unicodedata.category(c)[0]
    return kind if kind in "LN" and unicodedata.ucd_3_2_0.category(c)[0] == kind else "?"


def _is_boundary(text: str, p: int) -> bool:
    """Whether a token ends at p, 0 < p < len(text), whatever surrounds these two characters."""
    before, after = _kind(text[p - 1]), _kind(text[p])
    if after == "S":
        return before in "LNO"
    return before in "LN" and after in "LNO" and before != after


def _halved(n: int, most: int) -> list[int]:
    """Cuts of 0 to n by halving until no part is longer than most."""
    cuts = [0, n]
    while max(b - a for a, b in zip(cuts, cuts[1:])) > most:
        cuts = sorted({*cuts, *((a + b) // 2 for a, b in zip(cuts, cuts[1:]) if b - a > most)})
    return cuts


class TreeBpe:
    """Encoder and decoder for a byte-level BPE file of the tokenizers library; joins and windows are counted."""

    def __init__(self, path: str, *, leaf: int = LEAF, leaf_bytes: int = LEAF_BYTES, threads: int = THREADS, window: int = WINDOW):
        import regex
        import tiktoken

        ranks, special = _read(path)
        self.leaf, self.leaf_bytes, self.window = max(leaf, 2), max(leaf_bytes, 2), window
        self.special = special
        self.bytes_of = {i: b for b, i in ranks.items()} | {i: s.encode() for s, i in special.items()}
        self.core = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.allowed = set(special)
        self.pattern = regex.compile(PATTERN.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.threads, self.pool, self.inside = threads, None, threading.local()
        self.joins = self.token_joins = self.windows = 0

    def _each(self, f, items) -> list:
        """f of every item, threads of them at a time: the encoder lets go of the interpreter lock.

        What runs in a thread already goes on there, so no thread waits for another.
        """
        if self.threads < 2 or len(items) < 2 or getattr(self.inside, "pool", False):
            return list(map(f, items))
        if self.pool is None:
            self.pool = ThreadPoolExecutor(self.threads, initializer=lambda: setattr(self.inside, "pool", True))
        return list(self.pool.map(f, items))

    def encode(self, text: str | None) -> list[int]:
        """Token ids of the whole text."""
        text = text or ""
        if len(text) <= self.leaf:
            return self.core.encode(text, allowed_special=self.allowed, disallowed_special=())
        out: list[int] = []
        for k, part in enumerate(self.split_special.split(text) if self.split_special else [text]):
            if k % 2:
                out.append(self.special[part])
            elif part:
                out += self.encode_long(part)
        return out

    def encode_array(self, text: str | None):
        """Token ids of the whole text as a NumPy array, without lists in between; texts with very long runs as encode() does."""
        text = text or ""
        if len(text) <= self.leaf or max(map(len, text.split()), default=0) <= RUN and not _BLANK.search(text):
            return self.core.encode_to_numpy(text, allowed_special=self.allowed, disallowed_special=())
        return self.encode(text)

    # ---- tree concatenation of text

    def _plain(self, text: str) -> list[int]:
        """Encoding of a text that is read as it stands: no special token is looked for."""
        return self.core.encode_ordinary(text)

    def encode_long(self, text: str) -> list[int]:
        """A text without special tokens, by halves."""
        cuts = _halved(len(text), self.leaf)
        level = self._each(lambda ab: self._plain(text[ab[0] : ab[1]]), list(zip(cuts, cuts[1:])))
        while len(level) > 1:
            pairs = [(cuts[k], cuts[k + 1], cuts[k + 2], level[k], level[k + 1]) for k in range(0, len(level) - 1, 2)]
            joined = self._each(lambda x: self.join_texts(text, *x), pairs)
            level = joined + level[2 * len(joined) :]
            cuts = [*cuts[: 2 * len(joined) : 2], *cuts[2 * len(joined) :]]
        return level[0]

    def join_texts(self, text: str, lo: int, cut: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        """The encoding of text[lo:hi] from those of text[lo:cut] and text[cut:hi]."""
        self.joins += 1
        k = FIRST_WINDOW
        while True:
            p = next((x for x in range(cut - 1, max(lo, cut - k), -1) if _is_boundary(text, x)), lo if cut - k <= lo else None)
            q = next((x for x in range(cut + 1, min(hi, cut + k)) if _is_boundary(text, x)), hi if cut + k >= hi else None)
            if p is not None and q is not None and q - p <= 2 * self.window:
                self.windows += 1
                a = self._tokens_from_end(left, len(text[p:cut].encode("utf-8", "surrogatepass")))
                b = self._tokens_from_start(right, len(text[cut:q].encode("utf-8", "surrogatepass")))
                if a is not None and b is not None:
                    return left[: len(left) - a] + self._plain(text[p:q]) + right[b:]
            elif k >= self.window:
                return self._join_long(text, lo, cut, hi, left, right)
            if k >= hi - lo:
                return self._plain(text[lo:hi])
            k *= 2

    def _join_long(self, text: str, lo: int, cut: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        """A join whose cut lies in a long pre-token, or next to one."""
        p = next((x for x in range(cut - 1, lo, -1) if _is_boundary(text, x)), lo)
        q = next((x for x in range(cut + 1, hi) if _is_boundary(text, x)), hi)
        size = lambda i, j: len(text[i:j].encode("utf-8", "surrogatepass"))
        a, b = self._tokens_from_end(left, size(p, cut)), self._tokens_from_start(right, size(cut, q))
        if a is None or b is None:
            return self._plain(text[lo:hi])
        out = left[: len(left) - a]
        for m in self.pattern.finditer(text[p:q]):
            i, j = p + m.start(), p + m.end()
            own = None
            if i < cut < j:
                x, y = self._tokens_from_end(left, size(i, cut)), self._tokens_from_start(right, size(cut, j))
                if x is not None and y is not None and x and y:
                    own = self.join(left[len(left) - x :], right[:y])
            out += self.encode_pretoken(m[0].encode("utf-8", "surrogatepass")) if own is None else own
        return out + right[b:]

    def _tokens_from_end(self, ids: list[int], size: int) -> int | None:
        """How many last tokens have so many bytes, or None if no token begins there."""
        n = 0
        while size > 0 and n < len(ids):
            n += 1
            size -= len(self.bytes_of[ids[-n]])
        return n if size == 0 else None

    def _tokens_from_start(self, ids: list[int], size: int) -> int | None:
        n = 0
        while size > 0 and n < len(ids):
            size -= len(self.bytes_of[ids[n]])
            n += 1
        return n if size == 0 else None

    # ---- tree concatenation of one pre-token

    def encode_pretoken(self, raw: bytes) -> list[int]:
        if len(raw) <= self.leaf_bytes:
            return self.core._core_bpe.encode_single_piece(raw)
        cuts = _halved(len(raw), self.leaf_bytes)
        level = self._each(self.core._core_bpe.encode_single_piece, [raw[a:b] for a, b in zip(cuts, cuts[1:])])
        while len(level) > 1:
            joined = self._each(lambda ab: self.join(*ab), list(zip(level[::2], level[1::2])))
            level = joined + level[len(joined) * 2 :]
        return level[0]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of left's and right's bytes together, both parts of one pre-token."""
        self.token_joins += 1
        k = 1
        while True:
            a, b = min(k, len(left)), min(k, len(right))
            raw = b"".join(self.bytes_of[i] for i in [*left[len(left) - a :], *right[:b]])
            window = self.core._core_bpe.encode_single_piece(raw)
            agrees_left = a == len(left) or window[0] == left[-a]
            agrees_right = b == len(right) or window[-1] == right[b - 1]
            if agrees_left and agrees_right and (len(window) > 1 or (a == len(left) and b == len(right))):
                return left[: len(left) - a] + window + right[b:]
            k *= 2

    def decode(self, ids: list[int]) -> str:
        """Text of the ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", "replace")


_loaded: dict[tuple, TreeBpe] = {}


def tokenizer(path: str, **options) -> TreeBpe:
    """A tokenizer that each Python worker loads once."""
    key = (path, *sorted(options.items()))
    if key not in _loaded:
        _loaded[key] = TreeBpe(path, **options)
    return _loaded[key]


def encode_documents(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: id, ids (array of int) and decoded (string)."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        t = tokenizer(path, **options)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [t.encode(x) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(map(t.decode, ids), pa.string())], [id_col, "ids", "decoded"])

    return docs.select(column(id_col), column(text_col)).mapInArrow(thrifty(run), f"{ddl_name(id_col)} {id_type}, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """encode_documents() reduced inside the same task: n_tokens, ids_sha256 and decoded_sha256."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        t = tokenizer(path, **options)
        names = list(map(str, range(max(t.bytes_of) + 1)))
        sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                n, a, b = [], [], []
                for text in part.column(1):
                    ids = t.encode(text.as_py())
                    n.append(len(ids))
                    a.append(sha(",".join([names[i] for i in ids])))
                    b.append(sha(t.decode(ids)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(column(id_col), column(text_col)).mapInArrow(thrifty(run), f"{ddl_name(id_col)} {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")
