"""Arrow kernel that steps the scans of all patterns over a batch of texts.

The texts of a batch are laid end to end as character classes with an end mark
between them.  A *slot* is a scan of all patterns from one start: its place in
the batch and its state.  All slots step together, one NumPy gather a step.
Slots that meet in the same place and state have the same future, so they are
merged from time to time and a pattern like ``.*x`` costs no more than its
states per character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from sievewright.patterns.automaton import Table

from .bloom import GramGate

#: Characters stepped over at once, and steps between merges.
BATCH_CHARS = 200_000
MERGE_EVERY = 24


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and where each begins (one more than texts)."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)


#: Code points of texts laid end to end, where each text begins, and where a pattern may begin (None: anywhere).
Laid = tuple[np.ndarray, np.ndarray, np.ndarray | None]


def laid_out(texts: list[str], gate: GramGate | None = None) -> Laid:
    """What all tables need of the texts."""
    codes, begin = code_points(texts)
    return codes, begin, None if gate is None else gate.may_begin(codes)


def scan(table: Table, texts: list[str], gate: GramGate | None = None, laid: Laid | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, pattern, start, end) of all matches; positions in the row, both included.

    gate: leaves out starts at which no pattern's beginning can be.
    """
    return resume(table, texts, gate, laid=laid)[0]


#: Scans that go on in the next chunk of a text: row, start (before 0 if it was in an earlier chunk), state.
Open = tuple[np.ndarray, np.ndarray, np.ndarray]


def resume(table: Table, texts: list[str], gate: GramGate | None = None, carry: Open | None = None, ends: np.ndarray | None = None, laid: Laid | None = None) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], Open]:
    """Matches as ``scan`` gives them, and the scans still open.

    carry: scans that were open before these texts.  ends: whether a text ends
    here (all do, if not given); what is open at the end of one that does not
    goes on in its next chunk.  A match may end at -1, in the chunk before.
    """
    codes, begin, may = laid or laid_out(texts, gate)
    n, k = len(codes), len(table.class_starts)
    ends = np.ones(len(texts), bool) if ends is None else ends
    none = np.zeros(0, np.int64)
    c_row, c_start, c_state = carry if carry is not None else (none, none, none)
    if not len(table.first_state):
        return (none,) * 4, (none,) * 3
    row = np.repeat(np.arange(len(texts)), np.diff(begin))
    ascii_ = np.searchsorted(table.class_starts, np.arange(128), side="right") - 1
    cls = np.empty(n + 1, np.int32)
    low = codes < 128
    cls[:n][low] = ascii_[codes[low]]
    cls[:n][~low] = np.searchsorted(table.class_starts, codes[~low], side="right") - 1
    cls[n] = 0
    is_last = np.zeros(n, bool)
    is_last[begin[1:][np.diff(begin) > 0] - 1] = True
    # every place whose character begins something
    count = np.diff(table.first_at)[cls[:n]]
    if may is not None:
        count = np.where(may, count, 0)
    start = np.repeat(np.arange(n), count)
    fresh = len(start)
    pick = np.arange(fresh) - np.repeat(np.append(0, np.cumsum(count))[:-1], count) + np.repeat(table.first_at[cls[:n]], count)
    total = fresh + len(c_row)
    # where each slot that is no merger began
    of_row = np.concatenate([row[start], c_row])
    of_start = np.concatenate([start - begin[row[start]], c_start])
    parents, known = [np.full(total, -1, np.int64)], total  # what a slot was merged into
    won: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # (slot, place, list)
    held: list[tuple[np.ndarray, np.ndarray]] = []  # (slot, state) at the end of a text that goes on
    trans, emit, eternal = table.trans, table.emit, table.eternal

    def report(s, p, e):
        on = e > 0
        if on.any():
            won.append((s[on], p[on], e[on]))

    slot, place, state = np.arange(fresh), start, table.first_state[pick]
    if len(c_row):
        c_slot = fresh + np.arange(len(c_row))
        empty = begin[c_row + 1] == begin[c_row]
        over = empty & ends[c_row]
        report(c_slot[over], begin[c_row[over]] - 1, emit[c_state[over], k])
        stays = empty & ~ends[c_row]
        held.append((c_slot[stays], c_state[stays]))
        c_slot, at, c_state = c_slot[~empty], begin[c_row[~empty]], c_state[~empty]
        report(c_slot, at - 1, emit[c_state, cls[at]])
        c_state = trans[c_state, cls[at]]
        go = c_state > 0
        slot, place, state = np.concatenate([slot, c_slot[go]]), np.concatenate([place, at[go]]), np.concatenate([state, c_state[go]])
    step = 0
    while len(slot):
        done = ends[row[place]]
        stay = eternal[state] & done
        stop = is_last[place] | stay
        if stop.any():
            open_ = stop & ~done
            if open_.any():
                held.append((slot[open_], state[open_]))
            shut = stop & done
            where = place[shut]
            report(slot[shut], np.where(stay[shut], begin[1:][row[where]] - 1, where), emit[state[shut], k])
            go = ~stop
            slot, place, state = slot[go], place[go], state[go]
        nxt = cls[place + 1]
        report(slot, place, emit[state, nxt])
        state = trans[state, nxt]
        go = state > 0
        slot, place, state = slot[go], place[go] + 1, state[go]
        step += 1
        if step % MERGE_EVERY == 0 and len(slot) > 64:
            _, first, inv, many = np.unique(place * np.int64(len(trans)) + state, return_index=True, return_inverse=True, return_counts=True)
            if len(first) < len(slot):
                shared = many > 1
                new = slot[first]  # a slot alone goes on as it is
                new[shared] = known + np.arange(shared.sum())
                parents.append(np.full(int(shared.sum()), -1, np.int64))
                known += int(shared.sum())
                up = np.concatenate(parents)
                up[slot[shared[inv]]] = new[inv[shared[inv]]]
                parents = [up]
                slot, place, state = new, place[first], state[first]
    if not won and not held:
        return (none,) * 4, (none,) * 3

    def by_slot(parts: list, n_cols: int) -> tuple[np.ndarray, ...]:
        if not parts:
            return (none,) * n_cols
        cols = [np.concatenate(x) for x in zip(*parts, strict=True)]
        order = np.argsort(cols[0], kind="stable")
        return tuple(c[order] for c in cols)

    def of_slots(slots: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of ``at``, place in ``slots``) of all rows of ``slots`` that are in ``at``."""
        lo, hi = np.searchsorted(slots, at), np.searchsorted(slots, at, side="right")
        n_hit = hi - lo
        src = np.repeat(np.arange(len(at)), n_hit)
        return src, np.arange(len(src)) - np.repeat(np.append(0, np.cumsum(n_hit))[:-1], n_hit) + np.repeat(lo, n_hit)

    slots, places, lists = by_slot(won, 3)
    h_slots, h_states = by_slot(held, 2)
    up = np.concatenate(parents)
    found, left = [], []
    origin, at = np.arange(total), np.arange(total)
    while len(at):  # a start has the reports of all slots that it was merged into
        src, hit = of_slots(slots, at)
        if len(src):
            size = table.list_at[lists[hit] + 1] - table.list_at[lists[hit]]
            who, end = np.repeat(origin[src], size), np.repeat(places[hit], size)
            inner = np.arange(len(who)) - np.repeat(np.append(0, np.cumsum(size))[:-1], size) + np.repeat(table.list_at[lists[hit]], size)
            r = of_row[who]
            found.append((r, table.list_of[inner], of_start[who], end - begin[r]))
        src, hit = of_slots(h_slots, at)
        if len(src):
            left.append((of_row[origin[src]], of_start[origin[src]], h_states[hit].astype(np.int64)))
        at = up[at]
        go = at >= 0
        origin, at = origin[go], at[go]
    gather = lambda parts, m: tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (none,) * m
    return gather(found, 4), gather(left, 3)


def split_batches(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Rows in parts of about BATCH_CHARS characters."""
    part, first, size = [], 0, 0
    for i, t in enumerate(texts):
        t = t or ""
        if part and size + len(t) > BATCH_CHARS:
            yield first, part
            part, first, size = [], i, 0
        part.append(t)
        size += len(t)
    if part:
        yield first, part


def match_batches(batches: Iterator[pa.RecordBatch], tables: list[Table], names: pa.Array, gate: GramGate | None = None, with_text: bool = False, counters=None) -> Iterator[pa.RecordBatch]:
    """Batches of keys and, as the last column, texts to batches of keys,
    pattern_id, pattern, start_pos, end_pos and, if asked for, matched_text."""
    for b in batches:
        for first, part in split_batches(b.column(b.num_columns - 1).to_pylist()):
            if counters is not None:
                counters.inc("scans", len(part))
            laid = laid_out(part, gate)
            for table in tables:
                row, pattern, start, end = scan(table, part, gate, laid)
                if counters is not None:
                    counters.inc("matches", len(row))
                if len(row):
                    take = pa.array(row + first)
                    cols = [*(c.take(take) for c in b.columns[:-1]), pa.array(pattern.astype(np.int32)), names.take(pa.array(pattern)), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))]
                    labels = [*b.schema.names[:-1], "pattern_id", "pattern", "start_pos", "end_pos"]
                    if with_text:
                        cols.append(pa.array([part[r][x : y + 1] for r, x, y in zip(row.tolist(), start.tolist(), end.tolist(), strict=True)], pa.string()))
                        labels.append("matched_text")
                    yield pa.RecordBatch.from_arrays(cols, labels)


def rows_with_match(batches: Iterator[pa.RecordBatch], tables: list[Table], gate: GramGate | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, without its last column, the texts, in which some pattern matches."""
    for b in batches:
        hit = np.zeros(b.num_rows, bool)
        for first, part in split_batches(b.column(b.num_columns - 1).to_pylist()):
            for table in tables:
                left = np.flatnonzero(~hit[first : first + len(part)])  # one match will do
                if len(left):
                    hit[first + left[scan(table, [part[i] for i in left], gate)[0]]] = True
        if hit.any():
            yield pa.RecordBatch.from_arrays(b.columns[:-1], b.schema.names[:-1]).filter(pa.array(hit))


def counted_batches(batches: Iterator[pa.RecordBatch], tables: list[Table], n_patterns: int, gate: GramGate | None = None) -> Iterator[pa.RecordBatch]:
    """Texts to (pattern_id, n): one row a task and pattern found."""
    total = np.zeros(n_patterns, np.int64)
    for b in batches:
        for _, part in split_batches(b.column(0).to_pylist()):
            laid = laid_out(part, gate)
            for table in tables:
                total += np.bincount(scan(table, part, gate, laid)[1], minlength=n_patterns)
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], ["pattern_id", "n"])
