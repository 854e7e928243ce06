"""Alignment kernels that SQL cannot express, run inside pandas and Arrow
UDFs (one call per batch of rows, never per row over the wire).

* ``lcs_length``, ``lcs_positions``: longest common subsequence of two token
  arrays over position lists of the shared tokens; work follows the matches.
* ``union_lcs_hits``: ROUGE-Lsum hits (summary-level union LCS).
* ``align_chars``: the character alignment of the blank-filling grader, with
  the grader's own cell rules, many rows at once; a group of rows keeps about ``SIGN_BYTES``.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc


def lcs_length(a, b) -> int:
    """LCS length of two sequences, by their matches: for every item of ``b`` the
    places in ``a`` from the last to the first; ``ends[k]`` is the least place that
    ends a common subsequence of k + 1 items (Hunt and Szymanski)."""
    places: dict = {}
    for i, x in enumerate(a):
        places.setdefault(x, []).append(i)
    ends: list[int] = []
    for x in b:
        for i in reversed(places.get(x, ())):
            k = bisect_left(ends, i)
            if k == len(ends):
                ends.append(i)
            else:
                ends[k] = i
    return len(ends)


def token_lcs_batch(refs: pd.Series, pred: pd.Series) -> pd.Series:
    """Per row the LCS length of every reference with the prediction."""
    out = []
    for some, p in zip(refs, pred):
        p = [] if p is None else p.tolist()
        out.append(None if some is None else np.array([lcs_length(r.tolist(), p) for r in some], np.int32))
    return pd.Series(out, dtype=object)


def lcs_positions(ref, pred) -> list[int]:
    """Reference positions of one longest common subsequence. Walking from
    the ends, equal last items pair up; else the shorter prefix of ``pred``
    is taken if it alone still holds a longer subsequence, otherwise the
    shorter prefix of ``ref``.

    Work and memory follow the matches. Reference items without a match never
    change a length, so the walk passes them and they are left out; predicted items
    without one behave alike, so the first of a run stands for it. Of the table
    only the rises are held: ``ends[k]`` is the least prefix of ``pred`` with a common
    subsequence of k + 1 items; what a reference item changes there is noted
    and taken back when the walk leaves it."""
    known = set(ref)
    kept: list = []
    places: dict = {}
    for x in pred:
        if x in known:
            kept.append(x)
            places.setdefault(x, []).append(len(kept))
        elif not kept or kept[-1] is not None:
            kept.append(None)
    rows = [(i, x) for i, x in enumerate(ref) if x in places]
    ends: list = []
    before = []  # per row: k -> its value without the row (None: there was none)
    for _, x in rows:
        was: dict = {}
        for j in reversed(places[x]):
            k = bisect_left(ends, j)
            if k == len(ends):
                was[k] = None
                ends.append(j)
            elif ends[k] != j:
                was.setdefault(k, ends[k])
                ends[k] = j
        before.append(was)
    out, j = [], len(kept)
    while rows and j:
        i, x = rows[-1]
        was = before[-1]
        paired = kept[j - 1] == x
        if not paired:
            length = bisect_right(ends, j)
            old = was.get(length - 1, ends[length - 1]) if length else None
            above = length if old is not None and old <= j else max(length - 1, 0)
            if bisect_right(ends, j - 1) > above:
                j -= 1
                continue
        else:
            out.append(i)
            j -= 1
        rows.pop()
        for k, value in before.pop().items():
            if value is not None:
                ends[k] = value
        if None in was.values():
            ends.pop()
    return out[::-1]


def union_lcs_hits(ref_sents, pred_sents) -> int:
    """Summary-level LCS hits: for each reference sentence, the union of its
    LCS token positions with every predicted sentence; a token counts while
    both sides still have unused occurrences of it."""
    ref_cnt = Counter(t for s in ref_sents for t in s)
    pred_cnt = Counter(t for s in pred_sents for t in s)
    hits = 0
    for r in ref_sents:
        union = set()
        for c in pred_sents:
            union.update(lcs_positions(r, c))
        for idx in sorted(union):
            tok = r[idx]
            if ref_cnt[tok] > 0 and pred_cnt[tok] > 0:
                hits += 1
                ref_cnt[tok] -= 1
                pred_cnt[tok] -= 1
    return hits


def union_lcs_batch(refs: pd.Series, pred: pd.Series) -> pd.Series:
    """Per row the hits of every reference (an array of sentences each)."""
    out = []
    for some, p in zip(refs, pred):
        p = [] if p is None else [s.tolist() for s in p]
        out.append(None if some is None else np.array([union_lcs_hits([s.tolist() for s in r], p) for r in some], np.int32))
    return pd.Series(out, dtype=object)


KEPT_BYTES, SIGN_BYTES = 32 << 20, 128 << 20
# Cells of a diagonal that are worked on together, from how many on they are chosen by
# arithmetic, and how far the templates of a group may differ in length.
CELLS, WIDE, WIDER = 32_768, 8_192, 1.25
# Beyond how many characters a response counts as long, and how far its templates may differ then.
LONG, WIDEST = 12_000, 4
# Pairs aligned by signs before the tied ones of them are aligned together, and cells for a step of a walk.
PAIRS, STEPS = 512, 200
# Words of 64 response places that are worked on together at most, and from how many on they are.
RUN_WORDS, FEW_WORDS = 16_384, 512
ALL, UP_TO = np.uint64((1 << 64) - 1), [(2 << k) - 1 for k in range(64)]


class _Group:
    """Some templates (lengths ``n``) aligned with a response each (lengths ``m``,
    sorted so that ``n + m`` falls), a column of every array each.

    A cell is one number: the matched length above ``bits`` bits that hold the response
    place. Cells of one diagonal (template place + response place) follow from the
    two diagonals before it, so that all its cells, over all columns, are worked on at once. On
    a diagonal the template's last character comes first; ``t`` and ``r`` are laid out so that
    the characters that meet there stand beside each other.

    Diagonals are kept if ``KEPT_BYTES`` holds them all; otherwise two of every ``span`` are,
    and those between are computed anew, for the columns that read there."""

    def __init__(self, templates: list[np.ndarray], responses: list[np.ndarray]):
        self.n = np.asarray([len(t) for t in templates])
        self.m = np.asarray([len(r) for r in responses])
        self.last = self.n + self.m - 2
        self.rows, many = int(self.n.max()), len(templates)
        self.bits = int(self.m.max()).bit_length()
        self.low = (1 << self.bits) - 1
        self.kind = np.int32 if (self.rows + 2) << self.bits < 1 << 31 else np.int64
        letters = np.unique(np.concatenate(templates))
        code = np.uint8 if len(letters) < 255 else np.uint16 if len(letters) < 65535 else np.uint32
        known = np.zeros(int(letters[-1]) + 2, code)  # 0: in no template
        known[letters] = np.arange(1, len(letters) + 1)
        self.t = np.zeros((self.rows, many), code)
        self.r = np.zeros((int(self.last.max()) + 2 * self.rows, many), code)
        for k, (t, r) in enumerate(zip(templates, responses)):
            self.t[self.rows - len(t):, k] = known[t[::-1]]
            self.r[self.rows - 1:self.rows - 1 + len(r), k] = known[np.minimum(r, len(known) - 1)]
        self.span = _span(self.rows, many, int(self.last.max()) + 1)

    def _run(self, buf: np.ndarray, first: int, stop: int, cols, lanes: int) -> None:
        """Diagonals first..stop-1 of the columns ``cols``, template places below ``lanes``,
        into buf[2:] (from buf[2] on again when it is full); buf[0] and buf[1] hold the two before.

        First template character: 1 and its place on an equal character, else 0 and 0; it
        is not handed on to longer prefixes. Later ones: an equal character adds 1 to the
        shorter prefixes' length and ends here; else the longer of "one response character less" and
        "one template character less" is taken, with its place, and on a tie the later
        place of the two. Response place 0 takes 1 or 0."""
        n, m = self.rows, int(self.m[cols].max())
        t = np.ascontiguousarray(self.t[:, cols])
        r = np.ascontiguousarray(self.r[first:stop + n, cols])
        many, slots, one = t.shape[1], len(buf), self.low + 1
        place = np.repeat(np.arange(first - n + 2, stop + 2, dtype=self.kind)[:, None], many, axis=1)
        same, fresh = np.empty(t.shape, bool), np.empty(t.shape, self.kind)
        low = self.kind(self.low)
        for s in range(first, stop):
            k = s - first
            two, before, now = buf[k % slots], buf[(k + 1) % slots], buf[(k + 2) % slots]
            a, b = n - 1 - min(lanes - 1, s), n - max(0, s - m + 1)
            c = min(b, n - 1)
            equal = np.equal(r[k + a:k + b], t[a:b], out=same[a:b])
            f = fresh[a:c]
            np.bitwise_or(two[a + 1:c + 1], low, out=f)
            np.add(f, place[k + a:k + c], out=f)
            np.maximum(before[a:c], before[a + 1:c + 1], out=now[a:c])
            if b == n:
                now[n - 1], fresh[n - 1] = 0, one + s
            if s < lanes:
                now[a], fresh[a] = 0, one
            if equal.size < WIDE:
                np.copyto(now[a:b], fresh[a:b], where=equal)
            else:  # the same without a branch a cell: many cells are done sooner so
                f, x = fresh[a:b], now[a:b]
                np.bitwise_xor(f, x, out=f)
                np.multiply(f, equal.view(np.uint8), out=f)
                np.bitwise_xor(f, x, out=x)

    def align(self):
        """Matched lengths, and places as an array (column x template; a column's own
        template's come first).

        The places are found from the last template character up: the cell's end place for
        the prefix in hand; a template character that equals the response there uses it and
        goes on with the prefix before it (a prefix of length 0 wraps to the whole response), any
        other stands one place behind and leaves the prefix as it is."""
        n, span, many = self.rows, self.span, len(self.n)
        firsts = range(0, int(self.last.max()) + 1, span)
        marks = [np.zeros((2, n, many), self.kind)]
        for first in firsts[:-1]:
            live = int((self.last >= first + span).sum())  # a column ends where its own cells do
            buf = np.zeros((3, n, live), self.kind)
            buf[:2] = marks[-1][:, :, :live]
            self._run(buf, first, first + span, slice(0, live), n)
            marks.append(np.stack([buf[span % 3], buf[(span + 1) % 3]]))
        matched, places = np.zeros(many, np.int32), np.zeros((many, n), np.int32)
        row, prefix, at = self.n - 1, self.m - 1, np.zeros(many, np.int64)
        look = np.ones(many, bool)  # whose prefix is new
        open_ = np.arange(many)
        while len(open_):
            need = row[open_] + prefix[open_]
            first = int(need.max()) // span * span
            cols = open_[need >= first]
            stop, lanes = int(need.max()) + 1, int(row[cols].max()) + 1
            buf = np.empty((stop - first + 2, n, len(cols)), self.kind)
            buf[:2] = marks[first // span][:, :, cols]
            self._run(buf, first, stop, cols, lanes)
            own = np.arange(len(cols))
            while len(cols):
                i, new = row[cols], look[cols]
                d = np.where(new, i + prefix[cols] - first + 2, 0)
                cell = buf[d, n - 1 - i, own]
                end = new & (i == self.n[cols] - 1)
                matched[cols[end]] = cell[end] >> self.bits
                x = np.where(new, cell & self.low, at[cols])
                hit = self.r[x + n - 1, cols] == self.t[n - 1 - i, cols]
                places[cols, i] = np.where(hit, x, x + 1)
                at[cols], look[cols], row[cols] = x, hit, i - 1
                prefix[cols] = np.where(hit, np.where(x > 0, x, self.m[cols]) - 1, prefix[cols])
                s = row[cols] + prefix[cols]
                here = (row[cols] >= 0) & (~hit | ((s >= first) & (s < stop)))
                cols, own = cols[here], own[here]
            open_ = open_[row[open_] >= 0]
        return matched, places


def _cell(rows: int, diagonals: int) -> int:
    """Bytes of a cell, at most."""
    return 4 if (rows + 2) << (diagonals + 1).bit_length() < 1 << 31 else 8


def _span(rows: int, many: int, diagonals: int) -> int:
    if _cell(rows, diagonals) * rows * many * diagonals <= KEPT_BYTES:
        return diagonals
    return int((2 * diagonals) ** 0.5) + 1


def _columns(rows: int, diagonals: int) -> int:
    """How many responses are aligned together: as many as ``CELLS`` and ``KEPT_BYTES`` allow, one at least."""
    kept = _cell(rows, diagonals) * rows * min(diagonals, 2 * (int((2 * diagonals) ** 0.5) + 1))
    return max(1, min(CELLS // rows, KEPT_BYTES // kept))


class _Signs:
    """The alignment of ``_Group`` without a place for every cell: of a cell only two bits are held, and places are
    found by following them. A template character's cells are the bits of two whole numbers, lowest place first, and
    are worked on together, a response at a time.

    A length is that of a plain longest common subsequence or one less (the first row and column, which are
    not handed on, can lack 1; a diagonal step keeps that, and so does the longer of two neighbours). So a row is
    ``flat`` (plain length equals that of the cell to the left) and ``less`` (bit j + 1: the cell at place j lacks
    1). Both follow from the row above by a chain from left to right: a carry starts, passes or ends at every
    cell, which is what an addition does.

    Pairs that have enough places together are worked on at once (``_WordRows``), others alone. Then rows are kept if
    ``SIGN_BYTES`` holds them all; otherwise ``flat`` and ``less`` of every ``span``-th row are, and the
    rows between are computed anew where the walk reads. ``room`` holds the rows in hand."""

    def __init__(self, texts: list[tuple[str, str]], room: list):
        self.texts, self.room = texts, room

    def _rows(self, first: int, stop: int, flat: int, less: int, keep: bool = True) -> tuple[int, int]:
        """Rows first..stop-1 behind the row (flat, less), none before row 0; their signs go to ``room``: the
        cells where a walk to the left ends, by an equal character or as the left neighbour is not
        longer, and those whose upper neighbour is not longer."""
        t, full, places, signs = self.template, self.full, self.places, self.room
        for i in range(first, stop):
            equal, other = places[t[i]]
            both, rest = flat & equal, flat & other
            # what a cell adds to the one above, seen from its right neighbour
            down = (flat + both) ^ rest
            now = (rest | down) & full
            if i == 0:
                flat, less = now, ((down >> 1) & other) << 1
                if keep:
                    signs.append((equal, 0))
                continue
            above = (less >> 1) | 1  # the first column is not handed on: it lacks what it could have
            passed, lacks = less & equal, above & other
            open_ = lacks | passed | (rest & down)
            start = (lacks ^ (lacks & now)) | passed
            less = (open_ + start) ^ open_ ^ start
            if keep:
                # left less upper neighbour: down + above - (1 - flat) - less
                whole = full ^ less
                low, high, one, two = flat & whole, flat | whole, down | above, down & above
                signs.append((full ^ (((one & low) | (two & high)) & other), (low | one) & (high | two)))
            flat = now
        return flat, less

    def _align(self, t: str, r: str) -> tuple[int, list[int] | None]:
        n, m, signs = len(t), len(r), self.room
        self.template, self.full, self.places = t, (1 << m) - 1, _bits(t, r)
        span = _sign_span(n, m)
        flat, less, marks = self.full, 0, []
        for first in range(0, n, span):
            signs.clear()
            marks.append((flat, less))
            flat, less = self._rows(first, min(first + span, n), flat, less, first + span >= n)
        matched = m - flat.bit_count() - (less >> m & 1)
        held = (n - 1) // span * span  # the first row in ``signs``

        def hold(row: int) -> int:
            nonlocal held
            first = row // span * span
            if first != held:
                signs.clear()
                self._rows(first, min(first + span, n), *marks[first // span])
                held = first
            return first

        return matched, _walk(t, r, hold, lambda row, at: (signs[row - held][0] & ((2 << at) - 1)).bit_length() - 1,
                              lambda row, at: signs[row - held][1] >> at & 1)

    def align(self):
        """Matched lengths, and places as a list for each pair (None: too many ties)."""
        matched, places = np.zeros(len(self.texts), np.int32), [None] * len(self.texts)
        for run in _runs(np.asarray([(len(t), len(r) // 64 + 1) for t, r in self.texts]).reshape(-1, 2)):
            texts = [self.texts[i] for i in run]
            for i, (m, p) in zip(run, _WordRows(texts).align() if _together(texts) else map(self._align, *zip(*texts))):
                matched[i], places[i] = m, p
        self.room.clear()
        return matched, places


def _runs(sizes: np.ndarray):
    """Pairs (template length, words of the response) in runs of falling template length that ``_WordRows`` takes together."""
    run, words = [], 0
    for i in np.argsort(-sizes[:, 0], kind="stable").tolist():
        if run and words + sizes[i, 1] > min(RUN_WORDS, SIGN_BYTES // (16 * sizes[run[0], 0])):
            yield run
            run, words = [], 0
        run.append(i)
        words += int(sizes[i, 1])
    if run:
        yield run


def _together(texts: list[tuple[str, str]]) -> bool:
    """Whether the signs of all rows fit, and are enough to be worth it."""
    words = sum(len(r) // 64 + 1 for _, r in texts)
    return words >= FEW_WORDS and 16 * len(texts[0][0]) * words <= SIGN_BYTES


class _WordRows:
    """The rows of ``_Signs`` for many pairs at once, in order of falling template length: the bits of all pairs stand side
    by side in one array of 64-bit words, a pair's from a word of its own on, with a bit to spare, so that nothing is
    carried into the next pair. All rows' signs are kept."""

    def __init__(self, texts: list[tuple[str, str]]):
        self.texts = texts
        self.n, self.m = (np.asarray([len(x[i]) for x in texts]) for i in (0, 1))
        self.size = self.m // 64 + 1
        self.start = np.cumsum(self.size) - self.size
        self.words = int(self.size.sum())

    def _equal(self) -> tuple[np.ndarray, np.ndarray]:
        """For every letter of a pair's template its places in the response, and for template place and pair where the
        words of the letter there begin (less the pair's own first word)."""
        of = np.zeros((int(self.n[0]), len(self.texts)), np.int64)
        parts, at = [], 0
        for k, (t, r) in enumerate(self.texts):
            letters, code = np.unique(_codes(t), return_inverse=True)
            kind = np.uint8 if len(letters) < 255 else np.uint32
            known = np.full(int(letters[-1]) + 2, len(letters), kind)
            known[letters] = np.arange(len(letters))
            own = known[np.minimum(_codes(r), len(known) - 1)]
            bits = np.zeros((len(letters), 8 * int(self.size[k])), np.uint8)
            some = max(1, (1 << 20) // len(r))
            for a in range(0, len(letters), some):
                now = np.packbits(np.arange(a, min(a + some, len(letters)), dtype=kind)[:, None] == own, axis=1, bitorder="little")
                bits[a:a + some, :now.shape[1]] = now
            of[:len(t), k] = at + code.reshape(-1) * self.size[k] - self.start[k]
            parts.append(bits.reshape(-1).view("<u8"))
            at += len(parts[-1])
        return np.concatenate(parts), of

    def _rows(self) -> None:
        """``_Signs._rows`` from row 0 on; a pair's words are left alone behind its template's last character."""
        places, of = self._equal()
        one, top = np.uint64(1), np.uint64(63)
        full = np.full(self.words, ALL)
        full[self.start + self.size - 1] = (one << (self.m % 64).astype(np.uint64)) - one
        lowest = np.zeros(self.words, np.uint64)
        lowest[self.start] = 1
        self.flat, self.less = full.copy(), np.zeros(self.words, np.uint64)
        self.ends = np.empty((int(self.n[0]), self.words), np.uint64)
        self.level = np.empty_like(self.ends)
        lane, live, k = np.arange(self.words), len(self.texts), 0
        room = np.empty((12, self.words), np.uint64)
        for i in range(len(self.ends)):
            while self.n[live - 1] <= i:
                live -= 1
            if k != self.start[live - 1] + self.size[live - 1]:
                k = int(self.start[live - 1] + self.size[live - 1])
                flat, less, whole, low_bit, size, at = self.flat[:k], self.less[:k], full[:k], lowest[:k], self.size[:live], lane[:k]
                equal, other, rest, down, above, passed, lacks, now, open_, start, x, y = room[:, :k]
            places.take(np.repeat(of[i, :live], size) + at, out=equal, mode="clip")
            np.bitwise_xor(whole, equal, out=other)
            np.bitwise_and(flat, equal, out=x)
            np.bitwise_xor(flat, x, out=rest)
            np.bitwise_xor(_sum(flat, x, down), rest, out=down)
            np.bitwise_or(rest, down, out=now)
            np.bitwise_and(now, whole, out=now)
            if i == 0:
                self.ends[0], self.level[0] = equal, 0
                np.left_shift(other, one, out=x)
                x[1:] |= other[:-1] >> top
                np.bitwise_and(down, x, out=less)
                flat[:] = now
                continue
            np.right_shift(less, one, out=above)
            np.left_shift(less, top, out=x)
            np.bitwise_or(above[:-1], x[1:], out=above[:-1])
            np.bitwise_or(above, low_bit, out=above)
            np.bitwise_and(less, equal, out=passed)
            np.bitwise_and(above, other, out=lacks)
            np.bitwise_and(rest, down, out=open_)
            np.bitwise_or(open_, lacks, out=open_)
            np.bitwise_or(open_, passed, out=open_)
            np.bitwise_and(lacks, np.invert(now, out=x), out=start)
            np.bitwise_or(start, passed, out=start)
            np.bitwise_xor(open_, start, out=y)
            np.bitwise_xor(_sum(open_, start, x), y, out=less)
            # left less upper neighbour, as in ``_Signs``: of these four bits three or more, two or more
            longer = np.bitwise_xor(whole, less, out=passed)
            low, high = np.bitwise_and(flat, longer, out=x), np.bitwise_or(flat, longer, out=y)
            either, two = np.bitwise_or(down, above, out=lacks), np.bitwise_and(down, above, out=open_)
            ends, level = self.ends[i, :k], self.level[i, :k]
            np.bitwise_or(low, either, out=level)
            np.bitwise_and(level, np.bitwise_or(high, two, out=start), out=level)
            np.bitwise_or(np.bitwise_and(either, low, out=lacks), np.bitwise_and(two, high, out=open_), out=ends)
            np.bitwise_and(ends, other, out=ends)
            np.bitwise_xor(whole, ends, out=ends)
            flat[:] = now

    def align(self):
        """Matched length and places (None: too many ties) of each pair."""
        self._rows()
        lacks = self.less[self.start + self.m // 64] >> (self.m % 64).astype(np.uint64) & np.uint64(1)
        matched = self.m - np.add.reduceat(np.bitwise_count(self.flat), self.start, dtype=np.int64) - lacks.astype(np.int64)
        ends, level = memoryview(self.ends.reshape(-1)), memoryview(self.level.reshape(-1))
        raw, words = ends.cast("B"), self.words
        for (t, r), first, m in zip(self.texts, self.start.tolist(), matched.tolist()):

            def left(row, at):
                w, base = at >> 6, row * words + first
                x = ends[base + w] & UP_TO[at & 63]
                return (w << 6) + x.bit_length() - 1 if x else int.from_bytes(raw[8 * base:8 * (base + w)], "little").bit_length() - 1

            yield m, _walk(t, r, lambda row: 0, left, lambda row, at: level[row * words + first + (at >> 6)] >> (at & 63) & 1)


def _sum(a: np.ndarray, b: np.ndarray, out: np.ndarray) -> np.ndarray:
    """a + b as whole numbers over their words, lowest first: what the words carry is one addition of whole numbers, a bit a word."""
    np.add(a, b, out=out)
    over = int.from_bytes(np.packbits(out < a, bitorder="little"), "little") << 1
    if over:
        passing = int.from_bytes(np.packbits(out == ALL, bitorder="little"), "little")
        into = ((passing + over) ^ passing).to_bytes(len(out) // 8 + 2, "little")
        np.add(out, np.unpackbits(np.frombuffer(into, np.uint8), count=len(out), bitorder="little"), out=out)
    return out


def _walk(t: str, r: str, hold, left, level) -> list[int] | None:
    """Places from the last template character up, as in ``_Group.align``. On a tie both neighbours are followed, cells
    behind the best place so far are not. ``hold(row)`` makes the signs of a row ready and gives the first row
    that is, ``left(row, at)`` is the place where a walk to the left from a cell ends (-1: none), ``level(row, at)`` whether
    its upper neighbour is not longer."""
    n, m = len(t), len(r)
    out, i, j, steps = [0] * n, n - 1, m - 1, n * m // STEPS + 2 * n
    while True:
        held = hold(i)
        best, row, at, later, seen = 0, i, j, None, None
        while True:
            while at > best:
                if row < held:
                    later = later or []
                    heappush(later, (-row, at))
                    break
                at = left(row, at) if row else at
                if at <= best:
                    break
                if r[at] == t[row]:
                    best = at
                    break
                steps -= 1
                if steps < 0:
                    return None
                if row == 0:
                    break
                if level(row, at):
                    seen, later = seen or set(), later or []
                    if (row, at) in seen:
                        break
                    seen.add((row, at))
                    if at - 1 > best:
                        heappush(later, (-row, at - 1))
                row -= 1
            at = 0
            while later and at <= best:
                row, at = heappop(later)
                row = -row
            if at <= best:
                break
            if row < held:
                held = hold(row)
        hit = False
        while i >= 0 and not hit:
            hit = t[i] == r[best]
            out[i] = best if hit else best + 1
            i -= 1
        if i < 0:
            return out
        j = (best or m) - 1


def _bits(t: str, r: str) -> dict[str, tuple[int, int]]:
    """For every character of ``t`` its places in ``r`` as the bits of a whole number, and the other places."""
    letters, codes, out, full = sorted(set(t)), _codes(r), {}, (1 << len(r)) - 1
    some = max(1, (1 << 20) // len(r))
    for at in range(0, len(letters), some):
        now = letters[at:at + some]
        bits = np.packbits(_codes("".join(now))[:, None] == codes, axis=1, bitorder="little")
        for x, b in zip(now, bits):
            equal = int.from_bytes(b.tobytes(), "little")
            out[x] = equal, full ^ equal
    return out


def _sign_span(rows: int, places: int) -> int:
    """Rows whose signs are kept at a time (a row takes two bits a place, and some for the numbers themselves)."""
    kept = SIGN_BYTES // (places * 4 // 15 + 128)
    return rows if rows <= kept else max(int(rows ** 0.5) + 1, kept // 2)


def align_groups(t_size: np.ndarray, r_size: np.ndarray, texts_of):
    """Alignment of templates with responses by the grader's cell rules
    (``_Group``; scores depend on them), one pair a row. Sizes are in characters; ``texts_of``
    gives the texts (template, response) of a row. Pairs are aligned by signs; those of like
    length with too many ties are aligned together, a very long one with few others, with
    every cell's place. Yields (rows, matched lengths, places)."""
    rows = np.flatnonzero((t_size > 0) & (r_size > 0))
    wider = np.where(r_size < LONG, WIDER, WIDEST)
    step = np.floor(np.log(np.maximum(t_size, 1)) / np.log(wider)).astype(np.int64) + (r_size >= LONG) * 1000
    order = rows[np.lexsort((-(t_size + r_size)[rows], step[rows]))]
    room: list = []
    while len(order):
        same = order[:np.searchsorted(step[order], step[order[0]], side="right")]
        longest = int(t_size[same].max())
        diagonals = int(t_size[same[0]] + r_size[same[0]]) - 1
        some = same[:PAIRS]
        order = order[len(some):]
        matched, places = _Signs([texts_of(i) for i in some], room).align()
        yield some, matched, places
        tied = some[[p is None for p in places]]
        while len(tied):
            now, tied = np.split(tied, [_columns(longest, diagonals)])
            texts = [texts_of(i) for i in now]
            yield now, *_Group([_codes(t) for t, _ in texts], [_codes(r) for _, r in texts]).align()


def align_all(template: str, responses: list[str]) -> list[tuple[int, list[int]]]:
    """For each response the matched length with a blank template and, for each template
    character, the response place it is read from (see ``align_groups``)."""
    out: list = [(0, [])] * len(responses)
    n, sizes = len(template), np.asarray([len(x) for x in responses], np.int64)
    for some, matched, places in align_groups(np.full(len(responses), n), sizes, lambda i: (template, responses[i])):
        for i, m, p in zip(some, matched, places):
            if p is not None:
                out[i] = (int(m), [int(x) for x in p[:n]])
    return out


def align_chars(template: str, response: str) -> tuple[int, list[int]]:
    """``align_all`` for one response."""
    return align_all(template, [response])[0]


def _codes(x: str) -> np.ndarray:
    return np.frombuffer(x.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def grader_alignment_batch(template: pa.Array, response: pa.Array) -> pa.Array:
    """struct<matched int, spans array<int>> of every row. Only the texts of a group are Python
    strings at a time, and places go straight into one Arrow buffer."""
    t_size, r_size = (pc.fill_null(pc.utf8_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (template, response))
    sound = pc.and_(template.is_valid(), response.is_valid()).to_numpy(zero_copy_only=False)
    size = np.where((t_size > 0) & (r_size > 0), t_size, 0)
    start = np.concatenate([[0], np.cumsum(size)])
    matched, spans = np.zeros(len(template), np.int32), np.empty(int(start[-1]), np.int32)
    for some, m, places in align_groups(t_size, r_size, lambda i: (template[i].as_py(), response[i].as_py())):
        matched[some] = m
        for i, p in zip(some, places):
            if p is not None:
                spans[start[i]:start[i + 1]] = p[:size[i]]
    # null spans without a template or a response: a null start marks them
    starts = pa.array(start.astype(np.int32), mask=np.concatenate([~sound, [False]]))
    return pa.StructArray.from_arrays([pa.array(matched), pa.ListArray.from_arrays(starts, pa.array(spans))], ["matched", "spans"])
