"""Quality rules as a short-circuit cascade.

Each rule is a predicate over lazily computed features of one text. On a bounded sample, drawn from every partition, the
cost and the rejection rate of every rule are measured; rules then run in descending order of rejections per second, and
a text stops at the first rule that rejects it. The order changes the work and the reported rule, never the verdict,
because a text is kept exactly when no rule rejects it. The five counts that judge() reports are computed for every text;
what only a rule looks at (letters, marks of lists, cut lines) is computed when the cascade gets there.

Defined results: a null text counts as empty; an empty text has no words and is rejected; repeated rows are judged one
by one; an empty table gives an empty result; other columns are passed through by filter_documents() and ignored
elsewhere, whatever their names.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import U64, column, ddl_name, map_rows, mix, thrifty

SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"
_LETTER = re.compile(rb"[A-Za-z]")
#: Characters that begin the items of a list, and ends of lines that were cut.
BULLETS = ("•", "-", "*", "‣", "▪")
ELLIPSES = ("...", "…")


class Features:
    """Counts of one text, each computed when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode("utf-8", "surrogatepass").split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, _SPACES))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(_SPACES)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words that stand in a window of three words found twice or more."""
        n = len(self.words)
        if n < 4:
            return 0
        known: dict[bytes, int] = {}
        ids = np.fromiter([known.setdefault(w, len(known)) for w in self.words], np.int64, n)
        v = len(known)
        pairs = ids[:-1] * v + ids[1:]
        if v >= 1 << 20:  # keeps the triple below 2 ** 63
            pairs = np.unique(pairs, return_inverse=True)[1]
        triples = pairs[:-1] * v + ids[2:]
        _, inverse, counts = np.unique(triples, return_inverse=True, return_counts=True)
        hit = counts[inverse] > 1
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : k + n - 2] |= hit
        return int(covered.sum())


    @cached_property
    def n_wordless(self) -> int:
        """Words of ASCII characters that hold no letter."""
        return sum(1 for w in self.words if w.isascii() and not _LETTER.search(w))

    @cached_property
    def n_bullet_lines(self) -> int:
        return sum(x.lstrip(_SPACES).startswith(BULLETS) for x in self.lines)

    @cached_property
    def n_cut_lines(self) -> int:
        return sum(x.rstrip(_SPACES).endswith(ELLIPSES) for x in self.lines)


@dataclass(frozen=True)
class Rule:
    """rejects(features) tells whether the text fails; base rules form the contract's base verdict."""

    name: str
    rejects: Callable[[Features], bool]
    base: bool = False


#: The production rules. A word holds letters of any script, so only its mean length is bounded, and loosely.
RULES = (
    Rule("few_words", lambda f: f.n_words < 50, base=True),
    Rule("repeated_words", lambda f: 100 * f.n_repeat_words > 50 * f.n_words, base=True),
    Rule("symbols", lambda f: 10 * f.n_symbols > 3 * f.n_words),
    Rule("duplicate_lines", lambda f: 2 * f.n_dup_lines > len(f.lines)),
    Rule("word_length", lambda f: not 2 * f.n_words <= f.word_chars <= 20 * f.n_words),
    Rule("wordless", lambda f: 2 * f.n_wordless > f.n_words),
    Rule("bullet_lines", lambda f: 10 * f.n_bullet_lines > 9 * len(f.lines)),
    Rule("cut_lines", lambda f: 10 * f.n_cut_lines > 3 * len(f.lines)),
)

#: Rows of the sample on which costs and rejection rates are estimated, and how many a partition gives at most, out of
#: so many rows at its head.
SAMPLE_ROWS = 400
PER_PARTITION = 16
HEAD_ROWS = 256


def estimate_order(texts: list[str | None], rules: tuple[Rule, ...] = RULES) -> tuple[Rule, ...]:
    """Rules by rejections per second on the sample, best first; ties keep the given order."""
    scored = []
    for place, rule in enumerate(rules):
        rejected, began = 0, time.perf_counter()
        for text in texts:
            rejected += rule.rejects(Features(text))
        cost = max(time.perf_counter() - began, 1e-9)
        scored.append((-rejected / cost, place, rule))
    return tuple(rule for _, _, rule in sorted(scored, key=lambda x: x[:2]))


def _heads(most: int | None = None):
    """Of the first HEAD_ROWS rows of a partition the PER_PARTITION of least rank, a digest of partition and place.

    Only their ranks, or ranks and texts of those of at most the given rank. The task stops there.
    """

    def run(batches):
        seed = TaskContext.get().partitionId()
        for batch in batches:
            part = batch.slice(0, HEAD_ROWS)
            if not part.num_rows:
                continue
            rank = mix(np.arange(part.num_rows, dtype=U64) + U64(seed << 32)).view(np.int64)
            chosen = np.argsort(rank)[:PER_PARTITION]
            if most is None:
                yield pa.RecordBatch.from_arrays([pa.array(rank[chosen])], ["rank"])
            else:
                chosen = chosen[rank[chosen] <= most]
                yield pa.RecordBatch.from_arrays([pa.array(rank[chosen]), part.column(0).take(pa.array(chosen))], ["rank", "text"])
            return

    return run


def plan_cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> tuple[Rule, ...]:
    """The order of the cascade, estimated on at most sample_rows rows from the heads of partitions all over the table.

    Ranks are drawn in every partition; the texts of the least of them are fetched, so the driver gets PER_PARTITION
    numbers of a partition and sample_rows texts in all.
    """
    texts = docs.select(column(text_col))
    ranks = sorted(r[0] for r in texts.mapInArrow(_heads(), "rank long").orderBy("rank").limit(sample_rows).collect())
    if not ranks:
        return tuple(rules)
    drawn = texts.mapInArrow(_heads(ranks[-1]), "rank long, text string").limit(sample_rows).collect()
    return estimate_order([r[1] for r in drawn], rules)


def first_rejection(features: Features, rules: tuple[Rule, ...]) -> str | None:
    """Name of the first rule in the cascade that rejects the text, or None if it is kept."""
    for rule in rules:
        if rule.rejects(features):
            return rule.name
    return None


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, the five counts, base_failed, kept and rejected_by (null if kept)."""
    order = plan_cascade(docs, rules, text_col=text_col)
    id_type = docs.schema[id_col].dataType.simpleString()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    base = tuple(r for r in order if r.base)
    rest = tuple(r for r in order if not r.base)

    def run(batches):
        for batch in batches:
            counts, verdicts = [], []
            for text in batch.column(1).to_pylist():
                f = Features(text)
                counts.append([getattr(f, n) for n in names])
                failed = first_rejection(f, base)
                verdicts.append((failed is not None, failed or first_rejection(f, rest)))
            columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(len(names))]
            columns += [pa.array([v[0] for v in verdicts], pa.bool_()), pa.array([v[1] is None for v in verdicts], pa.bool_()), pa.array([v[1] for v in verdicts], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [id_col, *names, "base_failed", "kept", "rejected_by"])

    schema = f"{ddl_name(id_col)} {id_type}, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, kept boolean, rejected_by string"
    return docs.select(column(id_col), column(text_col)).mapInArrow(thrifty(run), schema)


def filter_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, text_col: str = "text") -> DataFrame:
    """The rows of docs that no rule rejects, with all their columns."""
    order = plan_cascade(docs, rules, text_col=text_col)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            keep = [first_rejection(Features(t), order) is None for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return map_rows(docs, run, docs)
