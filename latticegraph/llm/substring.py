"""Near-duplicate passages with compact windows.

A text is a sequence of five-word shingles. All subsequences of at least RUN shingles whose smallest hash stands at the
same place form one compact window (l, c, r): every start in [l, c] with every end in [c, r]. The windows are the nodes
of the Cartesian tree of the hash values whose spans are long enough; only places that are the minimum of some stretch
of RUN shingles have one, and the nearest smaller place on either side of such a place is another such place, so the
tree is built over those alone. Two texts that share RUN shingles in a row share the smallest of them, so they have a
window with one value at the same word. Passages of 50 words at a Jaccard similarity of 0.8 differ by at most one edit
for every 45 shingles, so they share 21 in a row unless shingles repeat inside the passage; RUN is that.

The places of windows that more than one document has are anchors. The surroundings of an anchor are the shingles within
NEAR of it (REACH if shingles come again there) that another document has near an anchor too, with their distances; all others match nothing, whatever they
are. Occurrences of one anchor with equal surroundings are a class, so a passage between different texts is one class
however many documents hold it. Every member of a class is compared with its earliest and with the earliest holder of
the anchor, and different classes of an anchor are compared all with all by their earliest members. So two documents
with a similar passage are compared, or are members of two classes that are. The anchors of a pair of documents are
interval-joined: stretches around them on diagonals that follow each other closely are candidates. A candidate is verified on the shingles themselves: equal shingles of both sides are chained in order, whatever words were inserted,
deleted or replaced between them. Maximal stretches of the chain, bridged over short gaps, count if they hold at least
50 words on both sides and their shingle sets have a Jaccard similarity of at least SIMILARITY. Of a stretch that is not
similar enough as a whole, the maximal parts that are count.

The pairs of passages of n edited copies of one text are n squared over two. passage_classes() therefore gives the classes
that all pairs lead to, without comparing those that are in one class already: see _class_links().

Documents with equal texts are a class: the earliest stands for it in all this, and each other one of 50 words or more
is reported once, as a whole, against it. Passages with equal surroundings are reported for every document but the
earliest, against it; their other pairs follow from that. The work is in proportion to the text but for passages that
many documents hold in many different forms: their forms are compared all with all.

Defined results: null texts count as empty; texts of fewer than 50 words have no passage; repeats inside one document
are not reported; rows with a null or repeated id are told apart by their text, and copies of one id are not passages
of each other; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _BASE, _BASE_INV, U64, column, doc_chunks, has_repeated_ids, materialize, mix, powers, release, rows_with, scratch, shingle_hashes, sliding_min, small_side, thrifty, utf8_views, word_table
from .components import connected_components

SHINGLE = 5
WORDS = 50
WINDOW = WORDS - SHINGLE + 1
#: Shingles in a row that any two similar passages have in common.
RUN = 21
#: Shingles on either side of an anchor that are compared; a similar part with one edit lies within.
REACH = 2 * WINDOW
#: Shingles on either side that tell the surroundings of an anchor if none comes again within REACH, FEWEST common ones among them: the run of the anchor,
#: if shorter than FEWEST, has the rest beyond one edit, which takes at most 14 places of a text.
NEAR = 58
SIMILARITY = 0.8
#: Of equal anchors of a document, one for so many places is enough; REACH is wider by more than that than a part with one edit.
THIN = 32
#: Shingles that similar passages of WINDOW shingles have in common.
FEWEST = 37
#: Turns of at most so many shingles that fill a window are linked by the window itself.
CYCLE = WINDOW // 2
#: Shingles in a row that similar passages without repeats have in common if they are not alike in 4/9 of the places of
#: both in some stretch of fewer than NEAR.
LONG = 27
#: Classes of an anchor that are compared in one group, of those held against others and of the others.
BLOCK = (128, 512)
#: Anchors in common with an earliest holder from which on a row is held against it before all others.
AGREE = 3
#: Words without a match that a passage may bridge.
GAP = 12

_CHUNK_WORDS = 1 << 17


def _doc_shingles(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Shingle hash at every word of the documents; zero where a shingle would leave its document."""
    sh = np.zeros(len(words), U64)
    if len(words) >= SHINGLE:
        sh[: len(words) - SHINGLE + 1] = shingle_hashes(words, SHINGLE) | U64(1)
    for k in range(1, SHINGLE):
        at = first[1:] - k
        sh[at[at >= first[:-1]]] = 0
    return sh


def compact_windows(sh: np.ndarray, seed: int, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Signature, c, l and r of all compact windows; stretches are separated by zeros."""
    n = len(sh)
    if n < window:
        return (np.zeros(0, U64),) + (np.zeros(0, np.int64),) * 3
    bits = int(n).bit_length()
    value = np.where(sh == 0, U64(0), mix(sh ^ U64(seed * 0x9E3779B97F4A7C15 % 2**64)) | U64(1 << 63))
    mask = U64((1 << bits) - 1)
    order = (value & ~mask) | np.arange(n, dtype=U64)
    low = sliding_min(order, window)
    c = np.unique((low[low > mask] & mask).astype(np.int64))
    if not len(c):
        return (np.zeros(0, U64),) + (np.zeros(0, np.int64),) * 3
    # the Cartesian tree over these places, one stretch after the other
    edge = np.flatnonzero(sh == 0)
    slot = np.searchsorted(edge, c)
    begin = np.where(slot > 0, edge[np.maximum(slot - 1, 0)] + 1 if len(edge) else 0, 0)
    stop = np.where(slot < len(edge), edge[np.minimum(slot, max(len(edge) - 1, 0))] - 1 if len(edge) else n - 1, n - 1)
    left, right = begin.copy(), stop.copy()
    stack: list[tuple[int, int, int]] = []
    own = -1
    for k, (place, v, b) in enumerate(zip(c.tolist(), order[c].tolist(), begin.tolist())):
        if b != own:
            stack, own = [], b
        while stack and stack[-1][0] > v:
            right[stack.pop()[2]] = place - 1
        if stack:
            left[k] = stack[-1][1] + 1
        stack.append((v, place, k))
    return value[c], c, left, right


def cyclic_windows(sh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of all windows of WINDOW shingles in which CYCLE shingles or fewer come again and again."""
    n = len(sh) - WINDOW + 1
    held = np.zeros(max(n, 0), bool)
    for k in range(1, CYCLE + 1 if n > 0 else 1):
        same = (sh[k:] == sh[:-k]) & (sh[k:] != 0)
        if np.count_nonzero(same) >= WINDOW - k:
            total = np.concatenate([[0], np.cumsum(same)])
            held |= total[WINDOW - k :][:n] - total[:n] == WINDOW - k
    at = np.flatnonzero(held)
    if not len(at):
        return at, np.zeros(0, U64)
    total = np.zeros(len(sh) + 1, U64)
    np.cumsum(mix(sh) * powers(_BASE, len(sh)), out=total[1:])
    return at, mix((total[at + WINDOW] - total[at]) * powers(_BASE_INV, len(sh))[at])


def _window_table(keyed: DataFrame, key_type: str) -> DataFrame:
    """signature, key and c of all compact windows; and of cyclic windows, each once for a text, with -1 - c for c."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                words, first = word_table(*utf8_views(part.column(1)))
                for i, j in doc_chunks(first[:-1], first[1:], _CHUNK_WORDS):
                    a, b = first[i], first[j]
                    own = first[i : j + 1] - a
                    sh = _doc_shingles(words[a:b], own)
                    c = compact_windows(sh, 1, RUN)[1]
                    doc = np.searchsorted(own, c, side="right") - 1
                    value, place = sh[c], c - own[doc]
                    c, turns = cyclic_windows(sh)
                    if len(c):
                        of = np.searchsorted(own, c, side="right") - 1
                        _, one = np.unique(np.stack([of.astype(U64), turns]), axis=1, return_index=True)
                        value, doc, place = (np.concatenate(x) for x in ((value, turns[one]), (doc, of[one]), (place, -1 - (c - own[of])[one])))
                    yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), part.column(0).take(pa.array(doc + i)), pa.array(place.astype(np.int32))], ["signature", "key", "c"])

    return keyed.mapInArrow(thrifty(run), f"signature long, key {key_type}, c int")


def _near(c: np.ndarray, reach, begin, end, size: int) -> np.ndarray:
    """Whether each of size places is within reach of a place c of its text, which goes from begin to end."""
    step = np.zeros(size + 1, np.int64)
    np.add.at(step, np.maximum(c - reach, begin), 1)
    np.add.at(step, np.minimum(c + reach + 1, end), -1)
    return np.cumsum(step[:-1]) > 0


def _near_shingles(batches):
    """Rows (key, text, anchors, owner): the shingles in the surroundings of an anchor; of the two bits below the place, the
    lower tells anchors, the upper those near which no shingle of these comes again."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            words, first = word_table(*utf8_views(part.column(1)))
            sh = _doc_shingles(words, first)
            lists = part.column(2)
            offsets = np.asarray(lists.offsets)
            doc = np.repeat(np.arange(part.num_rows), np.diff(offsets))
            c = np.asarray(lists.flatten()).astype(np.int64) + first[doc]
            begin, end = first[doc], first[doc + 1]
            at = np.flatnonzero(_near(c, REACH, begin, end, len(sh)) & (sh != 0))
            _, kind, number = np.unique(np.stack([(np.searchsorted(first, at, side="right") - 1).astype(U64), sh[at]]), axis=1, return_inverse=True, return_counts=True)
            again = np.zeros(len(sh) + 1, np.int64)
            again[at + 1] = number[kind.ravel()] > 1
            again = np.cumsum(again)
            plain = again[np.minimum(c + REACH + 1, end)] == again[np.maximum(c - REACH, begin)]
            at = np.flatnonzero(_near(c, np.where(plain, NEAR, REACH), begin, end, len(sh)) & (sh != 0))
            marked = np.zeros(len(sh), np.int64)
            marked[c] = 1 | plain << 1
            doc = np.searchsorted(first, at, side="right") - 1
            place = (at - first[doc]) << 2 | marked[at]
            doc = pa.array(doc)
            yield pa.RecordBatch.from_arrays([pa.array(sh[at].view(np.int64)), part.column(0).take(doc), part.column(3).take(doc), pa.array(place)], ["signature", "key", "owner", "place"])


def _fewest_kinds(at: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Different shingles that a passage which begins at a place, and is no cyclic window, has in common with a similar one.

    at and own are the places and values of the shared shingles. All that a passage has are at most 5/4 of the common ones;
    those of its first WINDOW places are among them, and one more if some of these are not shared.
    """
    n = len(at)
    order = np.lexsort((np.arange(n), own))
    before = np.full(n, -1)
    again = np.flatnonzero(own[order][1:] == own[order][:-1])
    before[order[again + 1]] = order[again]
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, np.maximum(before + 1, np.searchsorted(at, at - (WINDOW - 1))), 1)
    step[1:] -= 1
    kinds = np.cumsum(step[:-1]) + (np.searchsorted(at, at + WINDOW) - np.arange(n) < WINDOW)
    # a chain bridges no longer gaps, so it must come as far
    ends = np.append(np.flatnonzero(np.diff(at) > GAP + SHINGLE), n - 1)
    last = at[ends[np.searchsorted(ends, np.arange(n))]]
    return np.where(last - at >= WINDOW - 1, np.maximum(2, -(-4 * kinds // 5)), np.iinfo(np.int32).max)


def _surroundings(batches):
    """Rows (key, shared shingles): signature, key, c, a hash of the surroundings of each anchor with enough of them, the
    least number of different shingles in common with similar ones, whether none comes again there, and the shingles in
    these (eight bytes each) with their places from the anchor (one byte each)."""
    for batch in batches:
        lists = batch.column(1)
        offsets = np.asarray(lists.offsets)
        rows = lists.flatten()
        places, values = (np.asarray(rows.field(k)).astype(np.int64) for k in ("place", "signature"))
        out, shingles, apart = [], [], []
        for k, (a, b) in enumerate(zip(offsets[:-1] - offsets[0], offsets[1:] - offsets[0])):
            order = np.argsort(places[a:b])
            at, own = places[a:b][order] >> 2, values[a:b][order].view(U64)
            anchor = np.flatnonzero(places[a:b][order] & 1)
            plain = places[a:b][order][anchor] & 2 > 0
            base = int(at[0])
            total = np.zeros(len(at) + 1, U64)
            np.cumsum(mix(own) * powers(_BASE, int(at[-1]) - base + 1)[at - base], out=total[1:])
            c = at[anchor]
            _, one = np.unique(np.stack([own[anchor], (c // THIN).astype(U64)]), axis=1, return_index=True)
            anchor, c, plain = anchor[one], c[one], plain[one]
            reach = np.where(plain, NEAR, REACH)
            i, j = np.searchsorted(at, c - reach), np.searchsorted(at, c + reach, side="right")
            around = mix((total[j] - total[i]) * powers(_BASE_INV, int(at[-1]) - base + 1)[c - base])
            keep = np.flatnonzero(j - i >= FEWEST)
            least = _fewest_kinds(at, own)
            fewest = np.fromiter((least[x:y].min() for x, y in zip(i[keep].tolist(), np.searchsorted(at, c[keep] + THIN, side="right").tolist())), np.int64, len(keep))
            cuts = list(zip(c[keep].tolist(), i[keep].tolist(), j[keep].tolist()))
            out.append((np.full(len(keep), k), own[anchor][keep], c[keep], around[keep], fewest, plain[keep]))
            shingles += [own[x:y].tobytes() for _, x, y in cuts]
            apart += [(at[x:y] - m).astype(np.int8).tobytes() for m, x, y in cuts]
        if out:
            row, own, c, around, fewest, plain = (np.concatenate(x) for x in zip(*out))
            columns = [pa.array(own.view(np.int64)), batch.column(0).take(pa.array(row)), pa.array(c.astype(np.int32)), pa.array(around.view(np.int64)), pa.array(fewest.astype(np.int32)), pa.array(plain), pa.array(shingles, pa.binary()), pa.array(apart, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["signature", "key", "c", "around", "fewest", "plain", "shingles", "places"])


def _may_be_similar(table: pa.Table) -> pa.Table:
    """signature, around_a and around_b of classes of one anchor whose surroundings may hold similar parts.

    Those with role 1 or 3 are held against those with role 2 or 3, but for two that have the same owner alone. Of two
    that are not main the one with the smaller hash is a.
    """
    role, around, main = (table.column(k).to_numpy() for k in ("role", "around", "main"))
    fewest, plain = table.column("fewest").to_numpy(), table.column("plain").to_numpy()
    lone = table.column("lone").fill_null(0).to_numpy()
    alone = table.column("lone").is_valid().to_numpy()
    shingles = [np.frombuffer(x, U64) for x in table.column("shingles").to_pylist()]
    left, right = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
    codes = np.unique(np.concatenate([shingles[k] for k in left] or [np.zeros(0, U64)]))
    held = np.zeros((len(right), len(codes)), bool)
    if len(codes) and len(right):
        of = np.repeat(np.arange(len(right)), [len(shingles[k]) for k in right])
        values = np.concatenate([shingles[k] for k in right])
        code = np.minimum(np.searchsorted(codes, values), len(codes) - 1)
        same = codes[code] == values
        held[of[same], code[same]] = True
    out = []
    for k in left if len(right) else ():
        ok = (main[right] | (around[k] < around[right])) & ~(alone[k] & alone[right] & (lone[k] == lone[right]))
        to = np.flatnonzero(ok)
        code = np.searchsorted(codes, shingles[k])
        both = held[np.ix_(to, code)]
        keep = np.count_nonzero(both, axis=1) >= FEWEST
        to, both = to[keep], both[keep]
        if len(to) and plain[k] and plain[right[to]].any():
            at = np.frombuffer(table.column("places")[int(k)].as_py(), np.int8).astype(np.int64)
            total = np.zeros((len(to), len(at) + 1), np.int16)
            np.cumsum(both, axis=1, out=total[:, 1:])
            most = lambda n: (total[:, np.searchsorted(at, at + n)] - total[:, :-1]).max(axis=1)  # noqa: B023, E731
            # without repeats on either side: up to 11 places lost within so many, or else a long run
            keep = most(LONG) == LONG
            for n in range(WINDOW, NEAR):
                keep |= most(n) >= -(-4 * (n + WINDOW) // 9)
            keep |= ~plain[right[to]]
            to, both = to[keep], both[keep]
        if len(to):
            _, one = np.unique(code, return_index=True)
            to = to[np.count_nonzero(both[:, one], axis=1) >= np.maximum(fewest[k], fewest[right[to]])]
        out.append((np.full(len(to), around[k]), around[right[to]]))
    a, b = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2
    return pa.table({"signature": pa.array(np.full(len(a), table.column("signature")[0].as_py()), pa.int64()), "around_a": pa.array(a, pa.int64()), "around_b": pa.array(b, pa.int64())})


def _previous(batches):
    """Rows (signature, key, c, l, r) sorted so: each with the nearest window before it of another key, if there is one.

    The first key of a partition has none here; the earliest window of its signature is linked to all others anyway.
    """
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
        skip = 0 if held is None else 2
        signature = table.column(0).to_numpy()
        keys = table.column(1).combine_chunks()
        n = len(signature)
        if pa.types.is_integer(keys.type) and not keys.null_count:
            other = np.diff(keys.to_numpy()) != 0
        else:
            own = keys.to_pylist()
            other = np.fromiter((x != y for x, y in zip(own, own[1:])), bool, n - 1)
        fresh = np.ones(n, bool)
        fresh[1:] = (np.diff(signature) != 0) | other
        before = np.maximum.accumulate(np.where(fresh, np.arange(n), 0)) - 1
        ok = (before >= 0) & (signature[np.maximum(before, 0)] == signature)
        at = np.flatnonzero(ok)
        at = at[at >= skip]
        index, source = pa.array(at), pa.array(before[at])
        row, link = table.take(index), table.take(source)
        if len(at):
            columns = [row.column(0), row.column(1), link.column(1), *row.columns[2:], *link.columns[2:]]
            yield from pa.table(columns, names=["signature", "key", "source", "c", "l", "r", "sc", "sl", "sr"]).to_batches()
        last = n - 1
        held = table.take(pa.array([max(int(before[last]), 0), last])).combine_chunks().to_batches()[0]


def _candidates(key_type: str):
    """Rows (key, source, links): stretches of near diagonals around anchors."""
    names = ["key", "source", "low", "high", "source_low", "source_high", "n_hashes"]

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            counts = np.diff(np.asarray(lists.offsets))
            links = lists.flatten()
            c, sc = (np.asarray(links.field(k)).astype(np.int64) for k in ("c", "sc"))
            row, d = np.repeat(np.arange(len(counts)), counts), c - sc
            low, high = c - np.minimum(np.minimum(c, sc), REACH), c + REACH
            # diagonals that follow each other within GAP, and those that thinning has moved, are one band
            order = np.lexsort((d, row))
            band = np.zeros(len(row), np.int64)
            band[order] = np.cumsum(np.concatenate([[0], (np.diff(row[order]) != 0) | (np.diff(d[order]) > GAP + THIN)])[: len(row)])
            order = np.lexsort((low, band))
            row, d, low, high, band = (x[order] for x in (row, d, low, high, band))
            fresh = np.ones(len(row), bool)
            fresh[1:] = np.diff(band) != 0
            base = band << 32
            furthest = np.maximum.accumulate(base + high) - base
            fresh[1:] |= low[1:] > furthest[:-1] + GAP
            begin = np.flatnonzero(fresh)
            agree = np.zeros(0, np.int64)
            if len(begin):
                end = np.append(begin[1:], len(row)) - 1
                agree = np.diff(np.append(begin, len(row)))
                lowest, nearest = np.minimum.reduceat(low, begin), np.minimum.reduceat(low - d, begin)
                highest = np.maximum.reduceat(high - d, begin) + 1
                # both sides reach GAP further, where an insertion may have moved the ends
                columns = (np.maximum(lowest - GAP, 0), furthest[end] + 1 + GAP, np.maximum(nearest - GAP, 0), highest + GAP, agree)
            else:
                columns = [agree] * 5
            index = pa.array(row[begin])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(index), batch.column(1).take(index), *(pa.array(x.astype(np.int32)) for x in columns)], names)

    return run


def _cut_shingles(batches):
    """Rows (text, wanted): the shingle hashes of every wanted stretch."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 64):
            part = batch.slice(lo, 64)
            words, first = word_table(*utf8_views(part.column(0)))
            pid, side, low, cut = [], [], [], []
            for k, wanted in enumerate(part.column(1).to_pylist()):
                sh = shingle_hashes(words[first[k] : first[k + 1]], SHINGLE)
                for w in wanted:
                    pid.append(w["pid"])
                    side.append(w["side"])
                    low.append(w["low"])
                    cut.append(sh[w["low"] : w["high"]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(pid, pa.int64()), pa.array(side, pa.int32()), pa.array(low, pa.int32()), pa.array(cut, pa.binary())], ["pid", "side", "low", "cut"])


def _jaccard(a: np.ndarray, b: np.ndarray) -> float:
    x, y = np.unique(a), np.unique(b)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def _may_hold_passage(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """False only if no part of WINDOW or more places is similar enough; repeated shingles are not ruled out."""
    if len(np.unique(a)) < len(a):
        return True
    # a part is made of pieces of WINDOW to 2 * WINDOW - 1 places, one of them with its share of common shingles
    lost = np.concatenate([[0], np.cumsum(~np.isin(a, b))])
    fewest = int((lost[WINDOW:] - lost[:-WINDOW]).min())
    return fewest <= (1 - similarity) * (2 * WINDOW - 1)


def _increasing(places: np.ndarray) -> np.ndarray:
    """Indices of a longest increasing run of entries, in order."""
    if (np.diff(places) > 0).all():
        return np.arange(len(places))
    tops: list[int] = []
    at: list[int] = []
    back = np.full(len(places), -1)
    for k, v in enumerate(places.tolist()):
        j = bisect.bisect_left(tops, v)
        back[k] = at[j - 1] if j else -1
        if j == len(tops):
            tops.append(v)
            at.append(k)
        else:
            tops[j], at[j] = v, k
    out, k = [], at[-1]
    while k >= 0:
        out.append(k)
        k = int(back[k])
    return np.array(out[::-1])


def chain(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places i of a and j of b, both increasing, at which equal shingles stand.

    The k-th occurrence of a shingle in a goes with the k-th in b; of these pairs a longest chain is kept, and filled
    along the diagonal of the pair before.
    """
    x, y = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    sa, sb = a[x], b[y]
    rank = np.arange(len(a)) - np.searchsorted(sa, sa)
    first = np.searchsorted(sb, sa)
    other = first + rank
    ok = (other < len(b)) & (sb[np.minimum(other, len(b) - 1)] == sa) if len(b) else np.zeros(len(a), bool)
    j = np.full(len(a), -1)
    j[x[ok]] = y[other[ok]]
    i = np.flatnonzero(j >= 0)
    if not len(i):
        return i, i
    i = i[_increasing(j[i])]
    kept = np.full(len(a), -1)
    kept[i] = j[i]
    # between two pairs, the diagonal of the first as long as it stays before the second
    last = np.searchsorted(i, np.arange(len(a)), side="right") - 1
    open_ = np.flatnonzero((kept < 0) & (last >= 0) & (last < len(i) - 1))
    if len(open_):
        to = open_ + (kept[i] - i)[last[open_]]
        good = to < kept[i[last[open_] + 1]]
        open_, to = open_[good], to[good]
        same = a[open_] == b[to]
        kept[open_[same]] = to[same]
    i = np.flatnonzero(kept >= 0)
    return i, kept[i]


def _similar_parts(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float):
    """Maximal parts of a chain, as first and last of its pairs, that hold at least 50 words and are similar enough."""
    n = len(i)
    code = np.unique(np.concatenate([a, b]), return_inverse=True)[1]
    size = int(code.max()) + 1
    broken = (np.diff(i) > 1) | (np.diff(j) > 1)
    begins = np.concatenate([[0], np.flatnonzero(broken) + 1])
    ends = np.concatenate([np.flatnonzero(broken), [n - 1]])
    furthest = -1
    for s in begins.tolist():
        if i[-1] - i[s] < WINDOW - 1:
            return
        # the pair of the chain by which a shingle has come in a, in b, and in both
        seen = np.full((2, size), n)
        for side, (places, codes) in enumerate(((i, code[: len(a)]), (j, code[len(a) :]))):
            own = np.arange(int(places[s]), int(places[-1]) + 1)
            seen[side, codes[own[::-1]]] = np.searchsorted(places, own[::-1])
        common = np.cumsum(np.bincount(seen.max(0), minlength=n + 1)[:n])
        either = np.cumsum(np.bincount(seen.min(0), minlength=n + 1)[:n])
        far = ends[(ends > furthest) & (i[ends] - i[s] >= WINDOW - 1) & (j[ends] - j[s] >= WINDOW - 1)]
        far = far[common[far] >= similarity * either[far] - 1e-9]
        if len(far):
            furthest = int(far[-1])
            yield s, furthest, float(common[furthest] / either[furthest])


def matching_stretches(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY):
    """Stretches (i, j, k, m, Jaccard): a[i:j] and b[k:m] hold at least 50 words each and are similar enough.

    A stretch that is not similar enough as a whole gives its maximal parts that are; parts may overlap.
    """
    if len(a) >= WINDOW and len(a) == len(b) and (a == b).all():
        yield 0, len(a), 0, len(b), 1.0
        return
    i, j = chain(a, b)
    if not len(i):
        return
    breaks = np.flatnonzero((np.diff(i) > GAP + SHINGLE) | (np.diff(j) > GAP + SHINGLE))
    for s, e in zip([0, *(breaks + 1).tolist()], [*breaks.tolist(), len(i) - 1]):
        p, q, k, m = int(i[s]), int(i[e]) + 1, int(j[s]), int(j[e]) + 1
        if min(q - p, m - k) < WINDOW:
            continue
        x, y = a[p:q], b[k:m]
        jaccard = _jaccard(x, y)
        if jaccard >= similarity:
            yield p, q, k, m, jaccard
        elif _may_hold_passage(x, y, similarity):
            for u, v, part in _similar_parts(x, y, i[s : e + 1] - p, j[s : e + 1] - k, similarity):
                yield int(i[s + u]), int(i[s + v]) + 1, int(j[s + u]), int(j[s + v]) + 1, part


def _too_few(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether no parts of a and b can be similar: without repeats inside a, a part has FEWEST shingles of b."""
    return int(np.isin(a, b).sum()) < FEWEST and len(np.unique(a)) == len(a)


def _verify_one(batches):
    return _verify(batches, True)


def _verify(batches, one: bool = False):
    """Rows sorted by (pid, side), two for each pid; of each pid all passages or one, if there is one."""
    names = ["pid", "start", "end", "source_start", "source_end", "similarity"]
    held = None
    for batch in batches:
        out: tuple[list, ...] = tuple([] for _ in names)
        for pid, side, low, cut in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if held is None or held[0] != pid:
                held = (pid, low, cut)
                continue
            a, b = np.frombuffer(held[2], U64), np.frombuffer(cut, U64)
            met = matching_stretches(a, b) if not one else () if _too_few(a, b) else itertools.islice(matching_stretches(a, b), 1)
            for i, j, k, m, s in met:
                for c, v in zip(out, (pid, held[1] + i, held[1] + j + SHINGLE - 1, low + k, low + m + SHINGLE - 1, s)):
                    c.append(v)
            held = None
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(c, pa.int32()) for c in out[1:5]), pa.array(out[5], pa.float64())], names)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """key and text of the rows, and whether a key is an id with the digest of its text."""
    by_text = has_repeated_ids(docs, id_col)
    if not by_text:
        return docs.select(column(id_col).alias("key"), column(text_col).alias("text")), False
    sha = F.sha2(F.coalesce(column(text_col), F.lit("")), 256)
    return docs.select(F.struct(column(id_col).alias("id"), sha.alias("sha")).alias("key"), column(text_col).alias("text")).dropDuplicates(["key"]), True


def duplicate_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, start_word, end_word, source_<id>, source_start, source_end, n_hashes and similarity of each passage that an
    earlier document holds too (ends are exclusive); n_hashes counts the anchors that led to it, one for a whole text."""
    keyed, by_text = _keyed(docs, id_col, text_col)
    out_id = lambda c: F.col(c)["id"] if by_text else F.col(c)
    names = [id_col, "start_word", "end_word", f"source_{id_col}", "source_start", "source_end", "n_hashes", "similarity"]
    with scratch() as keep:
        copies = keep(materialize(_copies(keyed), "copies"))
        whole = copies.filter((F.col("n_words") >= WORDS) & ~out_id("key").eqNullSafe(out_id("source")))
        whole = whole.select(out_id("key"), F.lit(0), "n_words", out_id("source"), F.lit(0), "n_words", F.lit(1), F.lit(1.0))
        found = keep(materialize(_passages(rows_with(keyed, "key", small_side(copies.select("key")), "left_anti")), "passages"))
        found = found.filter(~out_id("key").eqNullSafe(out_id("source")))
        found = found.select(out_id("key"), "start", "end", out_id("source"), "source_start", "source_end", "n_hashes", "similarity")
    return found.toDF(*names).union(whole.toDF(*names))


def passage_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and class_id (the smallest id that similar passages lead to) of each document but the first of its class.

    The classes are those of all links of duplicate_passages(). Each row has one of the passages that link the document:
    start_word, end_word, source_<id>, source_start, source_end and similarity; its source may be later in order.
    """
    keyed, by_text = _keyed(docs, id_col, text_col)
    out_id = lambda c: F.col(c)["id"] if by_text else F.col(c)
    sides = ["start", "end", "source_start", "source_end"]
    with scratch() as keep:
        copies = materialize(_copies(keyed), "copies")
        whole = copies.filter(F.col("n_words") >= WORDS).select("key", F.lit(0).alias("start"), F.col("n_words").alias("end"), "source", F.lit(0).alias("source_start"), F.col("n_words").alias("source_end"), F.lit(1.0).alias("similarity"))
        other = ~out_id("key").eqNullSafe(out_id("source"))
        found = _class_links(rows_with(keyed, "key", small_side(copies.select("key")), "left_anti"), other)
        links = keep(materialize(found.union(whole.filter(other)), "links"))
        classes = keep(materialize(connected_components(links, "key", "source"), "classes"))
    turned = links.select(F.col("source").alias("key"), F.col("source_start").alias("start"), F.col("source_end").alias("end"), F.col("key").alias("source"), F.col("start").alias("source_start"), F.col("end").alias("source_end"), "similarity")
    # the longest, then the earliest source
    best = F.max_by(F.struct("source", *sides, "similarity"), F.struct(F.col("end") - F.col("start"), "similarity", -F.col("start"), -F.col("source_start"), "source"))
    rows = links.union(turned).groupBy("key").agg(best.alias("best")).join(classes.filter("node > component"), F.col("key") == F.col("node"))
    rows = rows.filter(~out_id("key").eqNullSafe(out_id("component"))).select("key", "component", "best.*")
    return rows.select(out_id("key"), out_id("component"), "start", "end", out_id("source"), "source_start", "source_end", "similarity").toDF(id_col, "class_id", "start_word", "end_word", f"source_{id_col}", "source_start", "source_end", "similarity")


def _copies(keyed: DataFrame) -> DataFrame:
    """key, source and n_words of the rows whose text an earlier row (source, the first of them) has too."""
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    rows = materialize(keyed.filter("text <> ''").select("key", F.sha2("text", 256).alias("sha"), words.alias("n_words")), "texts")
    first = rows.groupBy("sha").agg(F.min("key").alias("source"), F.count("*").alias("n")).filter("n > 1").select("sha", "source")
    return rows.join(first, "sha").filter("key <> source").select("key", "source", "n_words")


def _anchors(windows: DataFrame) -> DataFrame:
    """signature, key and c of the compact windows whose signature another row has too."""
    windows = windows.filter("c >= 0")
    again = windows.groupBy("signature").agg(F.min("key").alias("a"), F.max("key").alias("b")).filter("a < b").select("signature")
    return materialize(windows.join(materialize(again, "signatures"), "signature", "left_semi"), "anchors")


def _placed(keyed: DataFrame, anchors: DataFrame, key_type: str) -> DataFrame:
    """signature, key, c, hash of the surroundings and the shingles in them, of anchors (signature, key, owner, c) that have
    FEWEST shingles in common with other owners near theirs."""
    # lists of a document are bounded by its words
    lists = anchors.groupBy("key").agg(F.collect_list("c").alias("anchors"), F.first("owner").alias("owner"))
    near = keyed.join(lists, "key").select("key", "text", "anchors", "owner").mapInArrow(thrifty(_near_shingles), f"signature long, key {key_type}, owner {key_type}, place long")
    same = Window.partitionBy("signature")
    shared = near.withColumn("a", F.min("owner").over(same)).withColumn("b", F.max("owner").over(same)).filter("a < b")
    shared = shared.groupBy("key").agg(F.collect_list(F.struct("place", "signature")).alias("shared"))
    placed = shared.mapInArrow(thrifty(_surroundings), f"signature long, key {key_type}, c int, around long, fewest int, plain boolean, shingles binary, places binary")
    return placed


def _link(a: str, b: str) -> list:
    return [F.col(f"{a}.key").alias("key"), F.col(f"{b}.key").alias("source"), F.struct(F.col(f"{a}.c").alias("c"), F.col(f"{b}.c").alias("sc")).alias("link")]


def _passages(keyed: DataFrame) -> DataFrame:
    """key, start, end, source, source_start, source_end, n_hashes and similarity of passages of rows (key, text)."""
    key_type = keyed.schema["key"].dataType.simpleString()
    windows = materialize(_window_table(keyed, key_type), "windows")
    anchors = _anchors(windows)
    release(windows)
    placed = _placed(keyed, anchors.withColumn("owner", F.col("key")), key_type)
    placed = materialize(placed.groupBy("signature", "around", "key").agg(F.min("c").alias("c")), "placed")
    here = F.struct("key", "c")
    classes = materialize(placed.groupBy("signature", "around").agg(F.min(here).alias("first"), F.max(here).alias("last")), "classes")
    own = placed.withColumn("own", here)
    to_class = own.join(classes.filter("first.key < last.key"), ["signature", "around"]).filter("own.key > first.key").select(*_link("own", "first"))
    hub = materialize(classes.groupBy("signature").agg(F.min("first").alias("hub"), F.max("last").alias("end"), F.count("*").alias("n")).filter("n > 1 and hub.key < end.key").select("signature", "hub"), "earliest")
    to_hub = own.join(hub, "signature").filter("own.key > hub.key").select(*_link("own", "hub"))
    # two classes of one anchor by their first members; by a last one where both begin in the same document
    many = classes.join(hub, "signature", "left_semi")
    a, b = (many.select("signature", *(F.col(c).alias(f"{c}_{k}") for c in ("around", "first", "last"))) for k in "ab")
    both = a.join(b, "signature").filter("around_a < around_b")
    both = both.withColumn("y", F.expr("if(first_a.key = first_b.key, last_b, first_b)")).withColumn("x", F.expr("if(first_a.key = y.key, last_a, first_a)"))
    between = both.filter("x.key > y.key").select(*_link("x", "y")).union(both.filter("x.key < y.key").select(*_link("y", "x")))
    pairs = to_class.union(to_hub).union(between).groupBy("key", "source").agg(F.collect_set("link").alias("links"))
    return _verified(keyed, pairs, key_type, _verify)


def _class_links(keyed: DataFrame, other) -> DataFrame:
    """key, start, end, source, source_start, source_end and similarity of passages that join all rows (key, text) which
    passages lead to from one another; other is the condition on key and source for a link.

    The owner of a row is the earliest row that it is joined with so far. First each row is held against the two earliest
    holders that it has most anchors with. Surroundings are then told by what other owners have there, so whether rows of
    two owners match at an anchor follows from their surroundings: one pair of rows decides for two classes.
    """
    key_type = keyed.schema["key"].dataType.simpleString()
    windows = materialize(_window_table(keyed, key_type), "windows")
    turns = windows.filter("c < 0").select("signature", F.struct("key", (-1 - F.col("c")).alias("c")).alias("own"))
    turns = turns.join(turns.groupBy("signature").agg(F.min("own").alias("hub")), "signature").filter("own.key > hub.key")
    whole = [(F.col("own.c") + WORDS).alias("end"), F.col("hub.key").alias("source"), F.col("hub.c").alias("source_start"), (F.col("hub.c") + WORDS).alias("source_end"), F.lit(1.0).alias("similarity")]
    turns = materialize(turns.select(F.col("own.key").alias("key"), F.col("own.c").alias("start"), *whole).filter(other).dropDuplicates(["key", "source"]), "links-of-turns")
    anchors = _anchors(windows)
    release(windows)
    own = anchors.withColumn("own", F.struct("key", "c"))
    hub = own.groupBy("signature").agg(F.min("own").alias("hub"))
    pairs = own.join(hub, "signature").filter("own.key > hub.key").select(*_link("own", "hub")).groupBy("key", "source").agg(F.collect_set("link").alias("links"))
    nearest = Window.partitionBy("key").orderBy(F.size("links").desc(), "source")
    pairs = pairs.filter(F.size("links") >= AGREE).withColumn("n", F.row_number().over(nearest)).filter("n <= 2").drop("n")

    def links(pairs, name):
        return materialize(_verified(keyed, pairs, key_type, _verify_one).filter(other).select("key", "start", "end", "source", "source_start", "source_end", "similarity"), name)

    def owned(rows, key, links):
        """The rows of anchors that more than one owner has, with their owners by links."""
        joined = connected_components(links, "key", "source").toDF(key, "joined")
        rows = materialize(rows.join(joined, key, "left").withColumn("owner", F.coalesce("joined", key)).drop("joined"), "owned")
        return rows.join(rows.groupBy("signature").agg(F.min("owner").alias("a"), F.max("owner").alias("b")).filter("a < b").select("signature"), "signature", "left_semi")

    def collected(rows, x, y):
        """Pairs with their links, of rows with two places x and y of different owners."""
        rows = rows.select(F.greatest(x, y).alias("x"), F.least(x, y).alias("y"))
        return rows.select(*_link("x", "y")).groupBy("key", "source").agg(F.collect_set("link").alias("links"))

    found = turns.union(links(pairs, "links-to-holders"))
    apart = materialize(owned(anchors, "key", found), "apart")
    placed = _placed(keyed, apart, key_type).join(apart.select("key", "owner").distinct(), "key")
    # equal surroundings have the same shingles at the same places
    seen = [F.min("fewest").alias("fewest"), F.min("plain").alias("plain"), F.first("shingles").alias("shingles"), F.first("places").alias("places")]
    forms = materialize(placed.groupBy("signature", "around", "owner").agg(F.min(F.struct("key", "c")).alias("first"), *seen), "forms")
    # the rows of a class against its earliest, and that against the earliest of the anchor
    heads = materialize(forms.groupBy("signature", "around").agg(F.min(F.struct("first", "owner")).alias("head")), "heads")
    hubs = heads.groupBy("signature").agg(F.min("head").alias("hub"))
    near = forms.join(heads, ["signature", "around"]).filter("owner <> head.owner").select(F.col("first").alias("x"), F.col("head.first").alias("y"))
    near = near.union(heads.join(hubs, "signature").filter("head.owner <> hub.owner").select("head.first", "hub.first"))
    found = found.union(links(collected(near, "x", "y"), "links-to-classes"))
    # different classes of an anchor, by rows of different owners
    forms = materialize(owned(forms.withColumnRenamed("owner", "node"), "node", found), "open-forms")
    by_owner = F.struct("owner", "first")
    classes = materialize(forms.groupBy("signature", "around").agg(F.min(by_owner).alias("low"), F.max(by_owner).alias("high"), *seen), "open-classes")
    # those of the owner that has most of an anchor are not compared with each other; the others are held against all
    alone = classes.filter("low.owner = high.owner").groupBy("signature", "low.owner").count()
    most = alone.groupBy("signature").agg(F.max_by("owner", F.struct("count", "owner")).alias("most"))
    rows = classes.join(most, "signature", "left").withColumn("main", F.coalesce((F.col("low.owner") == F.col("most")) & (F.col("high.owner") == F.col("most")), F.lit(False)))
    rows = rows.withColumn("lone", F.when(F.col("low.owner") == F.col("high.owner"), F.xxhash64("low.owner")))
    rows = materialize(rows.select("signature", "around", "main", "lone", "fewest", "plain", "shingles", "places"), "sides")
    number = rows.groupBy("signature").agg(*(F.ceil(F.count_if(c) / n).cast("int").alias(k) for k, c, n in zip(("lefts", "rights"), (~F.col("main"), F.lit(True)), BLOCK))).filter("lefts > 0")
    rows = rows.join(number, "signature").withColumn("l", F.expr("cast(pmod(xxhash64(around), lefts) as int)")).withColumn("r", F.expr("cast(pmod(xxhash64(around, 1), rights) as int)"))
    roles = """if(lefts = 1 and rights = 1, array(struct(0 as l, 0 as r, if(main, 2, 3) as role)), concat(
        if(main, array(), transform(sequence(0, rights - 1), k -> struct(l, k as r, 1 as role))), transform(sequence(0, lefts - 1), k -> struct(k as l, r, 2 as role))))"""
    rows = rows.withColumn("roles", F.expr(roles)).drop("l", "r").select("signature", "around", "main", "lone", "fewest", "plain", "shingles", "places", F.inline("roles"))
    both = rows.groupBy("signature", "l", "r").applyInArrow(_may_be_similar, "signature long, around_a long, around_b long")
    a, b = (classes.select("signature", *(F.col(c).alias(f"{c}_{k}") for c in ("around", "low", "high"))) for k in "ab")
    both = both.join(a, ["signature", "around_a"]).join(b, ["signature", "around_b"])
    both = both.withColumn("x", F.expr("if(low_a.owner = low_b.owner and low_a.owner = high_b.owner, high_a, low_a)"))
    both = both.withColumn("y", F.expr("if(x.owner = low_b.owner, high_b, low_b)")).select("signature", "around_a", "around_b", "x.first", "y.first").toDF("signature", "around_a", "around_b", "x", "y")
    both = materialize(both, "class-pairs")
    met = links(collected(both, "x", "y"), "links-between-classes")
    found = found.union(met)
    # what holds for two rows of two classes holds for all their rows
    both = both.join(met.select(F.col("key").alias("k"), F.col("source").alias("s")), (F.greatest("x", "y")["key"] == F.col("k")) & (F.least("x", "y")["key"] == F.col("s")), "left_semi")
    forms = materialize(owned(forms.withColumn("node", F.col("owner")).drop("owner"), "node", found), "last-forms")
    ends = both.select("signature", F.col("around_a").alias("around"), F.col("y").alias("end")).union(both.select("signature", "around_b", "x"))
    rest = forms.join(ends, ["signature", "around"])
    return found.union(links(collected(rest.filter("first.key <> end.key"), "first", "end"), "links-of-the-rest"))


def _verified(keyed: DataFrame, pairs: DataFrame, key_type: str, verify) -> DataFrame:
    """key, start, end, source, source_start, source_end, n_hashes and similarity of the passages of pairs (key, source, links)."""
    n = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = pairs.mapInArrow(thrifty(_candidates(key_type)), f"key {key_type}, source {key_type}, low int, high int, source_low int, source_high int, n_hashes int")
    found = materialize(found.withColumn("pid", F.monotonically_increasing_id()), "candidates")
    sides = found.select("key", "pid", F.lit(0).alias("side"), "low", "high").union(found.select("source", "pid", F.lit(1), "source_low", "source_high"))
    # lists of bounded length, however many candidates a document has
    lists = sides.groupBy("key", F.shiftright("pid", 12)).agg(F.collect_list(F.struct("pid", "side", "low", "high")).alias("wanted")).select("key", "wanted")
    cut = keyed.join(lists, "key").select("text", "wanted").mapInArrow(thrifty(_cut_shingles), "pid long, side int, low int, cut binary")
    met = cut.repartition(n, "pid").sortWithinPartitions("pid", "side").mapInArrow(thrifty(verify), "pid long, start int, end int, source_start int, source_end int, similarity double")
    return met.join(found.select("pid", "key", "source", "n_hashes"), "pid").drop("pid")
