"""Approximate mentions: entity names that texts hold with a few letters changed, and whether they are negated.

A match at the threshold must keep so many of a name's runs of two letters within one stretch of its length, and so many
of its letters near their places.  Texts are scanned once for each block of names: counts of kept runs slide along a text
for eight names in a word's bytes; how many are enough depends on the place's first letter, which must be one of the name's.
Of the places that keep enough, those with enough letters near their places are scored by common subsequences held as the
bits of a word.  Names above 64 letters are aligned by a dynamic program whose row is
folded over the stretch's letters.  At 85 percent a name of 20 letters may lose 15 of its 18 runs of three, so a join on
runs is no filter: on prose it passed 40 percent of all stretches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrubric.functions import text as tx
from sparkrubric.operators.ordered import best_row
from sparkrubric.sources.lineage import ship_package

#: A window has so many letters more than the term.
SLACK = 5
#: Names of a block come to every task: about so many letters.
BLOCK_LETTERS = 1 << 16
#: Cells of counts and alignments that are held at a time.
CELLS_AT_ONCE = 1 << 22
#: Runs are counted over multiples of so many places.
SPANS = 2
#: A table holds the places of runs if they have no more numbers than this.
RUN_NUMBERS = 1 << 18
#: Terms that are sought together; their table of runs has so many columns.
AT_ONCE = 512
#: Letters of short texts that are scanned together.
TOGETHER = 1 << 15
#: Pairs of terms and places that are held at a time, about.
PAIRS = 1 << 16

# Words and stems that negate a mention; those marked by a closing \b must end there.
NEGATIONS = [r"\bnu\b", r"\bfără\b", r"\bevit", r"\bexclus", r"\bam\s+ales\s+să\s+nu", r"\bam\s+decis\s+să\s+nu"]


def least_kept(n: int, size: int, threshold: float) -> int:
    """So many runs of ``size`` letters does a term of ``n`` letters keep in a match at ``threshold`` percent.

    Leaving out a letter of the term costs ``1 + r`` and an extra letter of the text ``1 - r`` of the ``2 r n`` that a match
    may spend, ``r`` being the share below 100; they break ``size`` and ``size - 1`` runs.
    """
    r = 1 - threshold / 100
    return n - size + 1 - int(n * 2 * r * max(size / (1 + r), (size - 1) / (1 - r)) + 1e-9)


def least_pairs(n: int, threshold: float, first: int) -> tuple[int, int]:
    """So many runs of two letters does a term of ``n`` letters keep in a match that leaves out its ``first`` first letters,
    and within so many letters of the text, if it keeps no more; none within 0 if there is no match.

    As ``least_kept``, for whole numbers of letters and a stretch no longer than the term; a first letter that is left out
    breaks one run.
    """
    r = 1 - threshold / 100
    best = (n, 0)
    for out in range(first, n):
        for extra in range(out + 1):
            if (1 + r) * out + (1 - r) * extra <= 2 * r * n + 1e-9:
                kept, letters = max(0, n - 1 - first - 2 * (out - first) - extra), n - out + extra
                best = min(best, (kept, -letters))
    return best[0], -best[1]


def _letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.int32)


def _runs(letters: np.ndarray, size: int) -> np.ndarray:
    """The runs of ``size`` letters by place, as numbers (a letter has 21 bits)."""
    places = max(0, len(letters) - size + 1)
    out = np.zeros(places, np.int64)
    for k in range(size):
        out = out << 21 | letters[k : k + places]
    return out


class Terms:
    """Terms of one length, with the runs that tell where a text can hold one."""

    def __init__(self, n: int, terms: list[tuple[int, str]], threshold: float) -> None:
        """``terms`` are numbers and normalized names of ``n`` letters."""
        self.n, self.threshold = n, threshold
        self.numbers = [number for number, _ in terms]
        self.needles = [_letters(term) for _, term in terms]
        sizes = [size for size in (2, 3) if least_kept(n, size, threshold) > 0] or [1]
        self.filters = []
        for size in sizes:
            known = np.unique(np.concatenate([_runs(x, size) for x in self.needles]))
            holds = np.zeros((len(terms), len(known) + 1), bool)
            for row, needle in enumerate(self.needles):
                holds[row, np.searchsorted(known, _runs(needle, size))] = True
            self.filters.append((size, known, holds, least_kept(n, size, threshold)))
        #: A match starts so far behind its window, at most: it may be shorter than the term.
        self.behind = SLACK + n - int(np.ceil(n * (threshold / 100) / (2 - threshold / 100) - 1e-9))

    def starts(self, text: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Terms, by row, and the places of the text where a match of theirs can start."""
        at_once = max(1, CELLS_AT_ONCE // len(self.needles))
        for first in range(0, len(text), at_once):
            part = text[first : first + at_once + self.n - 1]
            width = min(at_once, len(text) - first)
            possible = np.ones((len(self.needles), width), bool)
            for size, known, holds, needed in self.filters:
                runs = _runs(part, size)
                at = np.searchsorted(known, runs)
                at[known[np.minimum(at, len(known) - 1)] != runs] = len(known)
                kept = np.zeros((len(self.needles), len(runs) + 1), np.int32)
                np.cumsum(holds[:, at], axis=1, out=kept[:, 1:])
                low = np.minimum(np.arange(width), len(runs))
                high = np.minimum(np.arange(width) + self.n - size + 1, len(runs))
                possible &= kept[:, high] - kept[:, low] >= needed
            rows, places = np.nonzero(possible)
            for own in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(rows)) + 1):
                if len(own):
                    yield int(rows[own[0]]), first + places[own]

    def mentions(self, text: np.ndarray) -> Iterator[tuple[int, float, int]]:
        """Number, score and first place of the best window of each term that the text mentions."""
        if len(text) < self.n:
            return
        best: dict[int, tuple[float, int]] = {}
        for row, starts in self.starts(text):
            cuts = np.flatnonzero(np.diff(starts) > self.behind + self.n) + 1
            for group in np.split(starts, cuts):
                low = max(0, int(group[0]) - self.behind)
                high = min(int(group[-1]), len(text) - self.n)  # the last window
                if high < low:
                    low = high
                piece = text[low : high + self.n + SLACK]
                score, at = best_window(piece, self.needles[row], high - low + 1, high + self.n == len(text))
                if score >= self.threshold - 1e-9 and (row not in best or (-score, low + at) < (-best[row][0], best[row][1])):
                    best[row] = score, low + at
        for row, (score, at) in best.items():
            yield self.numbers[row], score, at


class ShortTerms:
    """Terms of up to 64 letters, of any lengths, sought together."""

    def __init__(self, terms: list[tuple[int, str]], threshold: float) -> None:
        """``terms`` are numbers and normalized names; eight of about one length share a word."""
        self.threshold = threshold
        rows: list[tuple[int, str] | None] = sorted(terms, key=lambda x: len(x[1]))
        rows += [None] * (-len(rows) % 8)
        self.numbers = np.array([-1 if x is None else x[0] for x in rows])
        self.n = np.array([0 if x is None else len(x[1]) for x in rows])
        # a word's runs are counted over a multiple of four places, enough for its longest term
        spans = (-(-(self.n.reshape(-1, 8).max(axis=1) - 1) // SPANS) * SPANS).tolist()
        changes = [k for k in range(len(spans)) if k == 0 or spans[k] != spans[k - 1]]
        self.lanes = [(spans[k], k, end) for k, end in zip(changes, [*changes[1:], len(spans)], strict=True)]
        self.spans = np.repeat(spans, 8)
        needles = [_letters("" if x is None else x[1]) for x in rows]
        self.alphabet = np.unique(np.concatenate(needles))
        #: The place of each letter in the alphabet; the last is for letters beyond it.
        self.placed = np.full(int(self.alphabet[-1]) + 2, len(self.alphabet))
        self.placed[self.alphabet] = np.arange(len(self.alphabet))
        placed = [self.placed[needle] for needle in needles]
        self.known = np.unique(np.concatenate([self.runs(x) for x in placed]))
        #: The place of each run in ``known``, if runs have few numbers.
        numbers = (len(self.alphabet) + 1) ** 2
        self.run_at = np.full(numbers if numbers <= RUN_NUMBERS else 0, len(self.known))
        if len(self.run_at):
            self.run_at[self.known] = np.arange(len(self.known))
        holds = np.zeros((len(self.known) + 1, len(rows)), np.uint8)
        self.longest = int(self.n.max())
        # the places of each letter in a term as bits, read forwards and backwards
        self.places = np.zeros((2, len(rows), len(self.alphabet) + 1), np.uint64)
        for row, needle in enumerate(placed):
            holds[np.searchsorted(self.known, self.runs(needle)), row] = 1
            for j, at in enumerate(needle.tolist()):
                self.places[0, row, at] |= np.uint64(1 << j)
                self.places[1, row, at] |= np.uint64(1 << len(needle) - 1 - j)
        self.holds = np.ascontiguousarray(holds.view("<u8").T)
        #: By the first letter of a stretch: with it added, a byte that counts enough reaches 128.  The last is for any letter.
        short_of = np.zeros((len(self.alphabet) + 2, len(rows)), np.uint8)
        #: What counts just enough must lie within so many letters.
        self.within = np.zeros((len(rows), len(self.alphabet) + 2), np.uint8)
        fewest = {(n, j): least_pairs(n, threshold, j) for n in set(map(len, needles)) for j in range(n)}
        for row, needle in enumerate(placed):
            for j, at in enumerate(needle.tolist()):
                kept, letters = fewest[len(needle), j]
                if letters and 128 - kept >= short_of[at, row]:
                    self.within[row, at] = max(letters, self.within[row, at] if 128 - kept == short_of[at, row] else 0)
                    short_of[at, row] = 128 - kept
            if len(needle):
                short_of[-1, row], self.within[row, -1] = 128 - max(0, least_kept(len(needle), 2, threshold)), len(needle)
        self.short_of = np.ascontiguousarray(short_of.view("<u8").T)
        share = threshold / 100
        least = np.ceil(self.n * share / (2 - share) - 1e-9).astype(np.int64)  # letters of the shortest stretch that can match
        self.shortest = int(least[self.n > 0].min())
        #: So many letters of a stretch may be none of the term's.
        self.extra = np.floor(self.n * (1 - share) + 1e-6).astype(np.int64)
        #: So a letter of the stretch meets places of the term within a band, by place in the stretch and row.
        self.band = np.zeros((self.longest, len(rows)), np.uint64)
        for t in range(self.longest):
            for row in range(len(rows)):
                low, high = max(0, t - self.extra[row]), min(t + self.n[row] - least[row], 63)
                self.band[t, row] = (1 << int(high) + 1) - (1 << int(low)) if high >= low else 0
        #: So many letters of no term lie between two texts.
        self.gap = self.longest + SLACK + 1

    def runs(self, at: np.ndarray) -> np.ndarray:
        """The runs of two letters, given by their places in the alphabet, as numbers."""
        return at[:-1] * (len(self.alphabet) + 1) + at[1:]

    def mentions(self, texts: list[np.ndarray]) -> Iterator[tuple[int, int, float, int]]:
        """Text, number, score and first place of the best window of each term that a text mentions."""
        sizes = np.array([len(text) for text in texts], np.int64)
        starts = np.cumsum(sizes + self.gap) - sizes
        letters = len(self.alphabet)
        at = np.full(int(starts[-1] + sizes[-1]) + 2 * self.gap, letters)
        begins, ends = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)  # of each place's text
        for start, text in zip(starts.tolist(), texts, strict=True):
            at[start : start + len(text)] = self.placed[np.minimum(text, len(self.placed) - 1)]
            begins[start : start + len(text)], ends[start : start + len(text)] = start, start + len(text)
        runs = self.runs(at)
        if len(self.run_at):
            held = self.run_at[runs]
        else:
            held = np.searchsorted(self.known, runs)
            if len(self.known):
                held[self.known[np.minimum(held, len(self.known) - 1)] != runs] = len(self.known)
        # A best stretch begins with a letter of its term, or the one without it would be better; but a stretch of a text's
        # last window need not have one without it in any window.
        firsts = np.where((ends - np.arange(len(at)) <= self.longest) & (ends > 0), letters + 1, at)
        found = []
        for rows, places in self.parts(held, firsts):
            inside = np.flatnonzero((places < ends[places]) & (begins[places] + self.n[rows] <= ends[places]))
            rows, places = rows[inside], places[inside]
            lasts = np.flatnonzero(places + self.n[rows] == ends[places])
            for r, scores, windows in (
                self.stretches(at, rows, places, begins[places], ends[places]),
                self.whole_windows(at, rows[lasts], places[lasts], ends[places[lasts]]),
            ):
                found.append((np.searchsorted(starts, windows, "right") - 1, r, scores, windows))
        if not found:
            return
        of, rows, scores, windows = (np.concatenate(x) for x in zip(*found, strict=True))
        good = np.flatnonzero(scores >= self.threshold - 1e-9)
        order = good[np.lexsort((windows[good], -scores[good], rows[good], of[good]))]
        new = (np.diff(of[order], prepend=-1) != 0) | (np.diff(rows[order], prepend=-1) != 0)
        best = order[new]
        at = windows[best] - starts[of[best]]
        yield from zip(of[best].tolist(), self.numbers[rows[best]].tolist(), scores[best].tolist(), at.tolist(), strict=True)

    def parts(self, held: np.ndarray, firsts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The pairs of ``near``, so many at a time that they are worth a step."""
        at_once = max(1, CELLS_AT_ONCE // (8 * len(self.n)))  # what a step holds stays in a core's cache
        last = len(held) + 1 - 2 * self.gap
        room = self.room(min(at_once, last - self.gap))
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        for first in range(self.gap, last, at_once):
            high = min(first + at_once, last)
            pairs.append(self.near(held, firsts, first, high - first, room))
            if high == last or sum(len(x) for x, _ in pairs) >= PAIRS:
                rows, places = (np.concatenate(x) for x in zip(*pairs, strict=True))
                yield rows, places
                pairs = []

    def room(self, width: int) -> list[tuple[int, int, np.ndarray]]:
        """For sums over 1, 2, 4, ... places: how many, the first word that needs them, and memory; at 0 for the result."""
        size = width + self.lanes[-1][0]
        steps = [1, *(1 << k for k in range(1, 7) if 1 << k <= self.lanes[-1][0])]
        lows = [next((low for n, low, _ in self.lanes if n >= step), 0) for step in steps]
        needs = zip([0, *steps], [0, *lows], strict=True)
        return [(step, low, np.zeros((len(self.holds) - low) * size, np.uint64)) for step, low in needs]

    def near(self, held: np.ndarray, firsts: np.ndarray, first: int, width: int, room: list) -> tuple[np.ndarray, np.ndarray]:
        """Rows and places where a stretch can keep enough runs of two letters."""
        size = width + self.lanes[-1][0]  # of a word's places; additions run over all words at once, into the next one's places
        whole = (len(self.holds), size)
        sums: list[tuple[int, int, np.ndarray]] = []
        for step, low, memory in room[1:]:
            now = memory[: (len(self.holds) - low) * size]
            if not sums:
                np.take(self.holds, held[first : first + size], axis=1, out=now.reshape(whole), mode="clip")
            else:
                _, begin, half = sums[-1]
                half = half[(low - begin) * size :]
                np.add(half[: -step // 2], half[step // 2 :], out=now[: -step // 2])
            sums.append((step, low, now))
        reached = room[0][2][: len(self.holds) * size]
        np.take(self.short_of, firsts[first : first + size], axis=1, out=reached.reshape(whole), mode="clip")
        for n, low, high in self.lanes:
            done = 0
            for step, begin, now in sums:
                if n & step:
                    more = now[(low - begin) * size + done : (high - begin) * size + done]
                    reached[low * size : low * size + len(more)] += more
                    done += step
        reached.reshape(whole)[:, width:] = 0
        words = np.flatnonzero((reached & np.uint64(0x8080808080808080)) != 0)
        counts = reached[words].view(np.uint8)
        found = np.flatnonzero(counts >= 128)
        words = words[found >> 3]
        lane = words // size  # with a constant divisor much faster than divmod
        rows, place = lane * 8 + (found & 7), words - lane * size
        bare = np.flatnonzero(counts[found] == 128)  # just enough: none may lie behind the letters that this allows
        r, p = rows[bare], place[bare]
        begin = self.within[r, firsts[first + p]].astype(np.int64) - 1
        tail = self.spans[r] - begin
        dropped = np.zeros(len(rows), bool)
        for step, low, now in sums[1:3]:  # two such sums cover nearly all tails; what they miss is scored
            own = np.flatnonzero((tail >= 4) if step == 4 else (tail == 2) | (tail == 3))
            if len(own):
                cells = ((r[own] >> 3) - low) * size + p[own] + begin[own]
                byte, held_by = r[own] & 7, now.view(np.uint8)
                behind = held_by[cells * 8 + byte] | held_by[(cells + tail[own] - step) * 8 + byte]
                dropped[bare[own[behind > 0]]] = True
        kept = np.flatnonzero(~dropped)
        return rows[kept], place[kept] + first

    def common(self, at: np.ndarray, rows: np.ndarray, places: np.ndarray, back: int = 0) -> Iterator[np.ndarray]:
        """After each further letter, bits that are cleared for each letter of the common subsequence."""
        masks, base = self.places[back].ravel(), rows * (len(self.alphabet) + 1)
        bits = np.full(len(rows), np.uint64(0xFFFFFFFFFFFFFFFF))
        for t in range(self.longest):
            same = bits & masks[base + at[places - t if back else places + t]]
            bits = (bits + same) | (bits - same)
            yield bits

    def stretches(self, at, rows, places, start, stop) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, scores and first windows of the stretches that reach the threshold, see ``best_window``."""
        masks, width = self.places[0].ravel(), len(self.alphabet) + 1
        kept, row, here, base = np.arange(len(rows)), rows, places, rows * width  # of the pairs that are still followed
        bits = np.full(len(rows), np.uint64(0xFFFFFFFFFFFFFFFF))
        out = [(rows[:0], np.zeros(0), places[:0])]
        for t in range(self.longest):
            length = t + 1
            same = np.take(masks, base + np.take(at, here + t))
            same &= np.take(self.band[t], row)
            same &= bits
            more = bits + same
            bits -= same
            bits |= more
            if length >= 4 and length % 2 == 0:  # no longer stretch makes up for more extra letters
                alive = np.flatnonzero(np.bitwise_count(bits) <= np.take(self.extra, row) + (64 - length))
                kept, row, here, base, bits = kept[alive], row[alive], here[alive], base[alive], bits[alive]
            if length < self.shortest:
                continue
            n = self.n[row]
            common = 64 - np.bitwise_count(bits).astype(np.int64)
            enough = 200 * common >= (self.threshold - 1e-6) * (n + length)
            good = np.flatnonzero(enough & (length <= n) & (here + length <= stop[kept]))
            if not len(good):
                continue
            p, m, low, end = here[good], n[good], start[kept[good]], here[good] + length
            none = stop[kept[good]]
            begins = np.where(p <= none - m, p, none)
            ends = np.where(end == none, np.maximum(low, none - m - SLACK), end - m - SLACK)
            short = np.minimum(begins, np.where(ends >= low, ends, none))
            first = np.where(length == m, np.maximum(low, p - SLACK), short)
            real = first < none
            out.append((row[good][real], (200.0 * common[good] / (m + length))[real], first[real]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def whole_windows(self, at, rows, places, stop) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, scores and places of last windows, as long as their terms, against the terms' beginnings and ends."""
        n, best = self.n[rows], np.zeros(len(rows))
        for back, begin in ((0, places), (1, stop - 1)):
            bits = np.full(len(rows), np.uint64(0xFFFFFFFFFFFFFFFF))
            for t, now in enumerate(self.common(at, rows, begin, back)):
                bits = np.where(t < n, now, bits)
            for k in range(1, self.longest):
                common = k - np.bitwise_count(bits & np.uint64((1 << k) - 1))
                best = np.where(k < n, np.maximum(best, 200.0 * common / (n + k)), best)
        return rows, best, places


def common_lengths(piece: np.ndarray, needle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longest common subsequences of ``needle`` with every stretch of up to its length.

    The result has, for start and length, the subsequence's length, and the last rows of the dynamic program, which hold it
    for each beginning of the needle against the stretch of full length.
    """
    width, n = len(piece), len(needle)
    padded = np.pad(piece, (0, n), constant_values=-1)
    row = np.zeros((width, n + 1), np.int32)
    out = np.zeros((width, n + 1), np.int32)
    for t in range(n):
        same = padded[t : t + width, None] == needle
        row[:, 1:] = np.maximum.accumulate(np.maximum(row[:, 1:], row[:, :-1] + same), axis=1)
        out[:, t + 1] = row[:, n]
    return out, row


def best_window(piece: np.ndarray, needle: np.ndarray, n_starts: int, at_end: bool) -> tuple[float, int]:
    """The best score of the windows that start at the first ``n_starts`` places, and the first window that has it.

    Window ``i`` holds the ``len(needle) + SLACK`` letters from ``i`` on, or fewer at the end.  Its score is the largest
    ``200 common / (len(needle) + length)`` over its stretches of the needle's length and its shorter beginnings and
    ends.  A last window as long as the needle is also compared as a whole with the needle's beginnings and ends.
    """
    width, n = len(piece), len(needle)
    at_once = max(1, CELLS_AT_ONCE // (n + 1))
    best = (0.0, 0)
    for first in range(0, n_starts, at_once):  # a long region, part by part
        starts = min(at_once, n_starts - first)
        part = piece[first : first + starts + n + SLACK - 1]
        common, last = common_lengths(part, needle)
        size = len(part)
        scores = 200.0 * common / (n + np.arange(n + 1))
        scores[np.arange(size)[:, None] + np.arange(n + 1) > size] = 0.0  # a stretch must not pass the end
        begins = scores[:, :n].max(axis=1)
        ends = np.zeros(size + 1)
        for length in range(1, n):
            ends[length:] = np.maximum(ends[length:], scores[: size + 1 - length, length])
        full = np.concatenate([scores[:, n], np.zeros(SLACK + 1)])
        i = np.arange(starts)
        found = np.maximum.reduce([full[i + k] for k in range(SLACK + 1)])
        found = np.maximum(np.maximum(found, begins[i]), ends[np.minimum(i + n + SLACK, size)])
        if at_end and n > 1 and first + starts == n_starts:
            tail = piece[width - n :]
            turned = common_lengths(tail[::-1], needle[::-1])[1][0]
            parts = np.maximum(last[size - n], turned)[1:n] * 200.0 / (n + np.arange(1, n))
            found[-1] = max(found[-1], parts.max())
        at = int(found.argmax())
        if found[at] > best[0]:
            best = float(found[at]), first + at
    return best


class LongTerms(Terms):
    """Terms above 64 letters, text by text."""

    def mentions(self, texts: list[np.ndarray]) -> Iterator[tuple[int, int, float, int]]:
        for row, text in enumerate(texts):
            for found in super().mentions(text):
                yield row, *found


def grouped(terms: list[tuple[int, str]], threshold: float) -> list[ShortTerms | LongTerms]:
    """Terms in groups that are sought together."""
    short = sorted((x for x in terms if len(x[1]) <= 64), key=lambda x: len(x[1]))
    out: list[ShortTerms | LongTerms] = [ShortTerms(short[k : k + AT_ONCE], threshold) for k in range(0, len(short), AT_ONCE)]
    for n in sorted({len(term) for _, term in terms if len(term) > 64}):
        out.append(LongTerms(n, [x for x in terms if len(x[1]) == n], threshold))
    return out


def runs_of_texts(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """First and last of neighbouring texts of ``TOGETHER`` letters or one long one."""
    low = letters = 0
    for k, size in enumerate(sizes):
        if k > low and letters + size > TOGETHER:
            yield low, k
            low, letters = k, 0
        letters += size
    if low < len(sizes):
        yield low, len(sizes)


def _mentions(groups: list[ShortTerms | LongTerms]):
    def mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, numbers, scores, places = [], [], [], []
            texts = [_letters(text.as_py()) for text in batch.column("_text")]
            for low, high in runs_of_texts([len(text) for text in texts]):
                for group in groups:
                    for row, number, score, at in group.mentions(texts[low:high]):
                        rows.append(low + row)
                        numbers.append(number)
                        scores.append(score)
                        places.append(at)
            found = batch.column("_key").take(pa.array(rows, pa.int64()))
            arrays = [found, pa.array(numbers, pa.int32()), pa.array(scores, pa.float64()), pa.array(places, pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, ["_key", "_number", "score", "start"])

    return mentions


def is_positive(text: Column, start: Column, stop: Column, context: int) -> Column:
    """Whether no negation lies within ``context`` letters of a mention."""
    low = F.greatest(start - context, F.lit(0))
    around = F.substring(text, low + 1, stop + context - low)
    return ~around.rlike("(?iuU)" + "|".join(NEGATIONS))


def approximate_mentions(
    texts: DataFrame,
    text_key: str,
    text: str,
    terms: DataFrame,
    entity: str,
    position: str,
    term: str,
    threshold: float = 85.0,
    context: int = 50,
) -> DataFrame:
    """``(text_key, entity, position, score, start, stop, positive)``: the best window of each term that a text mentions.

    ``terms`` has a row for each name of an entity, numbered by ``position``; ``text_key`` and ``(entity, position)`` are
    unique.  A mention's score is at least ``threshold``; of equal scores the first window counts, and ``stop`` is
    ``start`` plus the term's length.  Null and empty texts and terms mention nothing, and neither does a text shorter than
    the term.  Texts of any length are read whole, in parts of bounded size.  Terms are dealt to blocks of about
    ``BLOCK_LETTERS`` letters; a block costs one pass over the texts, without a shuffle of theirs.
    """
    ship_package(texts.sparkSession)
    named = terms.select(entity, position, tx.normalize_fuzzy(term).alias("_term")).where("_term <> ''")
    letters = named.agg(F.sum(F.char_length("_term")).alias("n")).first()["n"] or 0
    n_blocks = max(1, -(-letters // BLOCK_LETTERS))
    plain = texts.select(F.col(text_key).alias("_key"), tx.normalize_fuzzy(text).alias("_text")).where("_text <> ''")
    key_type = texts.schema[text_key].dataType.simpleString()
    number = {f.name: f.dataType.simpleString() for f in terms.schema.fields}
    out = None
    for n in range(n_blocks):
        block = named.where(F.pmod(F.xxhash64(entity, position), F.lit(n_blocks)) == n).collect()
        groups = grouped([(at, r["_term"]) for at, r in enumerate(block)], threshold)
        found = plain.mapInArrow(_mentions(groups), f"_key {key_type}, _number int, score double, start int")
        places = [(at, r[entity], r[position], len(r["_term"])) for at, r in enumerate(block)]
        schema = f"_number int, `{entity}` {number[entity]}, `{position}` {number[position]}, _n int"
        found = found.join(texts.sparkSession.createDataFrame(places, schema), "_number")
        out = found if out is None else out.unionByName(found)
    stop = F.col("start") + F.col("_n")
    out = out.select(F.col("_key").alias(text_key), entity, position, "score", "start", stop.alias("stop"))
    out = out.join(texts.select(text_key, F.col(text).alias("_text")), text_key)
    return out.withColumn("positive", is_positive(F.col("_text"), F.col("start"), F.col("stop"), context)).drop("_text")


def best_mentions(found: DataFrame, text_key: str, entity: str, position: str) -> DataFrame:
    """One mention per text and entity: the highest score, then the first name, then the first window."""
    best = best_row(found, [text_key, entity], [-F.col("score"), F.col(position), F.col("start")])
    return best.select(text_key, entity, "best.*")
