"""Draws of many simulations, counted in numpy without a row for a draw.

A task takes sides in Arrow batches and keeps, for each hour that their draws touch, how the number of active movements
changes from minute to minute in each simulation. These changes add up, so an hour's size doesn't depend on how many
flights fall into it, and parts of an hour from several tasks are summed. The draws are those of ``sampling.uniforms`` and
``sampling.with_delay``, to the bit: MD5 is taken of whole arrays of texts at a time.

Where nothing but the probability of an overlap is asked for, an hour of a simulation is settled by the first two movements
that overlap in it: further ones can't undo that. A side is drawn unless all hours that it can reach are settled in that
simulation, so the result is that of all draws.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.operators import sampling as S
from spanwise.operators.events import WINDOWS

MINUTES, MICROS = 60, 60_000_000
#: Draws worked on at a time, cells of an hour's changes held by a task before it passes them on, cells looked at together.
DRAWS, HELD, CELLS = 1 << 16, 1 << 24, 1 << 20
BLOCK = 64
OVERLAPS = "prob_any_overlap"
#: What stands for a settled hour of a simulation: two movements, whatever is added.
SETTLED = np.array([2] + [0] * (MINUTES - 1), np.int32)
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_SINES = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]


def md5_units(words: dict[int, np.ndarray | int], size: int) -> np.ndarray:
    """The first 32 bits of the MD5 of ``size`` one-block messages as numbers in [0, 1).

    ``words`` holds the little-endian words of the block that aren't zero, each an array or one number for all. The first
    word of a digest is complete after 61 of the 64 steps.
    """
    a, b, c, d = (np.full(size, v, np.uint32) for v in _START)
    f, t = np.empty(size, np.uint32), np.empty(size, np.uint32)
    for i in range(61):
        if i < 16:
            at, _ = i, (np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f))
        elif i < 32:
            at, _ = (5 * i + 1) % 16, (np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f))
        elif i < 48:
            at, _ = (3 * i + 5) % 16, (np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f))
        else:
            at, _ = 7 * i % 16, (np.bitwise_not(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f))
        f += a
        word, turn = words.get(at, 0), _TURNS[i // 16][i % 4]
        if isinstance(word, np.ndarray):
            f += word
            word = 0
        f += np.uint32((_SINES[i] + word) & 0xFFFFFFFF)
        np.right_shift(f, np.uint32(32 - turn), out=t)
        np.left_shift(f, np.uint32(turn), out=f)
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    b += np.uint32(_START[0])
    return b.byteswap() / 4294967296.0


def hashed(heads: np.ndarray, length: int, tails: list[bytes], row: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """``unit_hash`` of the texts heads[row] + tails[tail]; heads are rows of bytes, all of one length."""
    if length + max(map(len, tails)) + 9 > BLOCK:  # texts of several blocks are rare
        whole = [bytes(h[:length]) for h in heads]
        return np.array([int.from_bytes(hashlib.md5(whole[i] + tails[j]).digest()[:4], "big") for i, j in zip(row.tolist(), tail.tolist(), strict=True)], np.float64) / 4294967296.0
    ends = np.zeros((len(tails), BLOCK), np.uint8)
    for block, text in zip(ends, tails, strict=True):
        block[length : length + len(text)] = np.frombuffer(text, np.uint8)
        block[length + len(text)] = 0x80
        block[BLOCK - 8 :] = np.frombuffer((8 * (length + len(text))).to_bytes(8, "little"), np.uint8)
    first = np.zeros((len(heads), BLOCK), np.uint8)
    first[:, :length] = heads[:, :length]
    first, ends = first.view("<u4"), ends.view("<u4")
    words: dict[int, np.ndarray | int] = {}
    for at in range(BLOCK // 4):
        if 4 * at < length:
            words[at] = first[:, at][row] | ends[:, at][tail]
        elif (ends[:, at] == ends[0, at]).all():
            words[at] = int(ends[0, at])
        else:
            words[at] = ends[:, at][tail]
    return md5_units(words, len(row))


class Distributions:
    """The steps of all delay distributions in one ascending array, each distribution's positions after those before it."""

    def __init__(self, steps: DataFrame):
        told = steps.toArrow().sort_by([("key", "ascending"), ("stretch", "ascending")])
        sizes = pc.list_value_length(told["upto"]).to_numpy()
        upto = pc.list_flatten(told["upto"]).to_numpy().astype(np.int64)
        keys = told["key"].to_pylist()
        new = np.array([i == 0 or keys[i] != keys[i - 1] for i in range(len(keys))], bool)
        self.keys = [k for k, n in zip(keys, new, strict=True) if n]
        number = np.repeat(np.cumsum(new) - 1, sizes) if len(keys) else np.zeros(0, np.int64)
        last = np.zeros(len(self.keys), np.int64)
        np.maximum.at(last, number, upto)
        self.base = np.cumsum(last) - last
        self.upto = upto + self.base[number]
        self.late = np.floor(pc.list_flatten(told["delays"]).to_numpy() * MICROS + 0.5).astype(np.int64)
        # the least delay, and how many hours a side's draws can reach from the hour of its earliest minute on
        self.least = min(0, int(self.late.min(initial=0)))
        spread = (int(self.late.max(initial=0)) - self.least) // MICROS + max(b - a for a, b in WINDOWS.values())
        self.reach = (spread + 1) // MINUTES + 2


class Tally:
    """Changes of the number of active movements by (group, hour), simulation and minute, and minutes of departures."""

    def __init__(self, sims: int):
        self.sims, self.slots = sims, {}
        self.changes, self.departures = np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.settled = np.zeros((0, sims), bool)

    def reserve(self, names: list[str], group: np.ndarray, hour: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """Slots for ``reach`` hours from each row's hour on: those of row i stand in the first array from its place in the second."""
        code = group.astype(np.int64) * (1 << 40) + hour
        wanted = np.unique(np.unique(code)[:, None] + np.arange(reach))
        of, at = np.divmod(wanted + (1 << 39), 1 << 40)
        slots = np.array([self.slots.setdefault((names[g], h), len(self.slots)) for g, h in zip(of.tolist(), (at - (1 << 39)).tolist(), strict=True)], np.int64)
        if (more := len(self.slots) * self.sims) > len(self.departures):
            self.departures = np.concatenate([self.departures, np.zeros(2 * more - len(self.departures), np.int64)])
            self.changes = np.concatenate([self.changes, np.zeros(2 * more * MINUTES - len(self.changes), np.int32)])
            self.settled = np.concatenate([self.settled, np.zeros((2 * more // self.sims - len(self.settled), self.sims), bool)])
        return slots, np.searchsorted(wanted, code)

    def undecided(self, slots: np.ndarray, place: np.ndarray, reach: int) -> np.ndarray:
        """By row and simulation, whether an hour that the row can reach isn't settled."""
        each = self.settled[slots]
        all_ = each.copy()
        for k in range(1, reach):
            all_[:-k] &= each[k:]
        return ~all_[place]

    def settle(self, slots: np.ndarray) -> None:
        """Notes in which simulations two movements overlap in the hours."""
        some = slots[~self.settled[slots].all(axis=1)]
        step = max(1, CELLS // (self.sims * MINUTES))
        for part in (some[i : i + step] for i in range(0, len(some), step)):
            changes = self.changes[: len(self.slots) * self.sims * MINUTES].reshape(-1, self.sims, MINUTES)[part]
            self.settled[part] |= (np.cumsum(changes, axis=2, dtype=np.int32) >= 2).any(axis=2)

    def add(self, slots: np.ndarray, place: np.ndarray, sim: np.ndarray, first: np.ndarray, until: np.ndarray, departs: np.ndarray) -> None:
        """Activity from minute ``first`` to ``until`` after the beginning of the hour in slots[place]."""
        on = first // MINUTES
        place, first, until = place + on, first - on * MINUTES, until - on * MINUTES
        while len(place):
            at = slots[place] * self.sims + sim
            np.add.at(self.changes, at * MINUTES + first, np.int32(1))
            ends = until < MINUTES
            np.add.at(self.changes, (at * MINUTES + until)[ends], np.int32(-1))
            np.add.at(self.departures, at[departs], (np.minimum(until, MINUTES) - first)[departs])
            longer = until > MINUTES
            place, sim, until, departs = place[longer] + 1, sim[longer], until[longer] - MINUTES, departs[longer]
            first = np.zeros(len(place), np.int64)

    def full(self, times: int = 1) -> bool:
        return len(self.slots) * self.sims * MINUTES > HELD * times

    def parts(self) -> Iterator[pa.RecordBatch]:
        """What is held, a row for each hour that something touched, in the least type that holds the changes; then nothing is held."""
        hours, size = list(self.slots), max(1, CELLS // (self.sims * MINUTES))
        for i in range(0, len(hours), size):
            changes = self.changes[i * self.sims * MINUTES : min(i + size, len(hours)) * self.sims * MINUTES].reshape(-1, self.sims * MINUTES)
            done = self.settled[i : i + len(changes)]
            changes.reshape(-1, self.sims, MINUTES)[done] = SETTLED
            touched = np.flatnonzero(changes.any(axis=1))
            if not len(touched):
                continue
            part, changes = [hours[i + j] for j in touched], changes[touched]
            departures = self.departures[i * self.sims : (i + size) * self.sims].reshape(-1, self.sims)[touched]
            least = np.min_scalar_type(min(int(changes.min()), -1 - int(changes.max())))
            yield pa.record_batch(
                [pa.array([g for g, _ in part], pa.string()), pa.array([h for _, h in part], pa.int64()), _texts(changes.astype(least)), _texts(departures)],
                ["airport_group", "hour_number", "changes", "departures"],
            )
        self.changes[: len(hours) * self.sims * MINUTES] = 0
        self.departures[: len(hours) * self.sims] = 0
        self.settled[: len(hours)] = False
        self.slots = {}


def _texts(rows: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    size = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(0, (len(rows) + 1) * size, size, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _clipped(x: np.ndarray) -> np.ndarray:
    return np.minimum(np.maximum(x, S.EDGE), 1 - S.EDGE)


class Drawing:
    """The draws of simulations first..last-1 of n, for sides in Arrow batches: changes by hour."""

    def __init__(self, distributions, n: int, first: int, last: int, seed: int, stratified: bool, overlaps_only: bool = False):
        self.distributions, self.n, self.seed, self.stratified, self.overlaps_only = distributions, n, seed, stratified, overlaps_only
        self.sims = np.arange(first, last)

    def tails(self, stream: str, seed: int) -> list[bytes]:
        return [f"{sim}|{S.SALTS[stream] + 1000 * seed}".encode() for sim in self.sims]

    def stratum(self, offset: np.ndarray) -> np.ndarray:
        spread = (self.sims + 0.5)[None, :] / float(self.n) + offset[:, None]
        return spread - np.floor(spread)

    def drawn(self, middle: np.ndarray | None, jitter: np.ndarray) -> np.ndarray:
        return _clipped(jitter if middle is None else middle + (jitter - 0.5) / float(self.n))

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, tally = self.distributions.value, Tally(len(self.sims))
        keys, step = pa.array(found.keys, pa.string()), max(1, DRAWS // len(self.sims))
        for batch in (b.slice(i, 4 * step) for b in batches for i in range(0, len(b), 4 * step)):  # sides come in order of time
            ids = batch["flight_id"].cast(pa.string()).fill_null("")
            held = np.frombuffer(ids.buffers()[2] or b"", np.uint8)
            offsets = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]
            known = pc.is_valid(batch["flight_id"]).to_numpy(zero_copy_only=False)
            groups = batch["airport_group"].dictionary_encode()
            names, sides = groups.dictionary.to_pylist(), {
                "group": groups.indices.to_numpy(),
                "departs": pc.equal(batch["movement"], "dep").to_numpy(zero_copy_only=False),
                "number": pc.index_in(batch["key"], value_set=keys).fill_null(-1).to_numpy(),
                "size": batch["n"].fill_null(0).to_numpy(),
                "rate": batch["rate"].to_numpy(zero_copy_only=False),
                "time": batch["scheduled_time"].cast(pa.timestamp("us")).cast(pa.int64()).to_numpy(),
            }
            alike, kind = np.unique(2 * np.diff(offsets).astype(np.int64) + known, return_inverse=True)
            for i, (length, has_id) in enumerate(zip((alike // 2).tolist(), (alike % 2).tolist(), strict=True)):
                rows = np.flatnonzero(kind == i)
                for some in (rows[j : j + step] for j in range(0, len(rows), step)):
                    heads = np.zeros((len(some), max(BLOCK, length + 1)), np.uint8)
                    heads[:, :length] = held[offsets[some][:, None] + np.arange(length)]
                    self.count(tally, found, names, heads, length, bool(has_id), **{name: values[some] for name, values in sides.items()})
                    if tally.full(2):
                        yield from tally.parts()
            if tally.full():
                yield from tally.parts()
        yield from tally.parts()

    def count(self, tally: Tally, found: Distributions, names: list[str], heads: np.ndarray, length: int, known: bool, group: np.ndarray, departs: np.ndarray, number: np.ndarray, size: np.ndarray, rate: np.ndarray, time: np.ndarray) -> None:
        """Counts the draws of sides whose ids have one length."""
        before, after = (np.where(departs, *(WINDOWS[m][j] for m in ("dep", "arr"))) for j in (0, 1))
        # the earliest minute that a side may be active in is in the first of its hours
        hour = ((time + found.least) // MICROS + before) // MINUTES
        slots, place = tally.reserve(names, group, hour, found.reach)
        if self.overlaps_only:
            wanted = tally.undecided(slots, place, found.reach)
            some = np.flatnonzero(wanted.any(axis=1))
            if not len(some):
                return
            wanted, heads, departs, number, size, rate, time, before, after, hour, place = (x[some] for x in (wanted, heads, departs, number, size, rate, time, before, after, hour, place))
        else:
            wanted = np.ones((len(heads), len(self.sims)), bool)
        all_, own = np.arange(len(heads)), np.where(departs, 0, 1)
        if self.stratified:
            unit = lambda streams, tail: self.stratum(hashed(heads, length, [f"|{S.SALTS[s]}".encode() for s in streams], all_, tail))
            cancel, middle = unit(("cancel",), np.zeros_like(all_)), unit(("dep", "arr"), own)
        if known:
            heads[:, length] = ord(":")
            length += 1
        if self.stratified:  # the jitter counts only where the ends of the stratum lie on both sides of the rate
            kept = wanted & (_clipped(cancel + -0.5 / float(self.n)) >= rate[:, None])
            open_ = wanted & ~kept & (_clipped(cancel + 0.5 / float(self.n)) >= rate[:, None])
        else:
            kept, open_ = np.zeros_like(wanted), wanted
        row, sim = np.nonzero(open_)
        u = self.drawn(cancel[row, sim] if self.stratified else None, hashed(heads, length, self.tails("cancel", self.seed), row, sim))
        kept[row, sim] = u >= rate[row]
        row, sim = np.nonzero(kept)
        tails = [*self.tails("dep", self.seed + 1), *self.tails("arr", self.seed + 2)]
        u = self.drawn(middle[row, sim] if self.stratified else None, hashed(heads, length, tails, row, sim + len(self.sims) * own[row]))
        has, late = number >= 0, np.zeros(len(row), np.int64)
        i = row if has.all() else row[has[row]]
        u = u if has.all() else u[has[row]]
        position = found.base[number[i]] + np.minimum(size[i] - 1, np.floor(u * size[i]).astype(np.int64))
        late[has[row]] = found.late[np.searchsorted(found.upto, position, side="right")] if len(i) else 0
        minute = (time[row] + late) // MICROS - hour[row] * MINUTES
        tally.add(slots, place[row], sim, minute + before[row], minute + after[row], departs[row])
        if self.overlaps_only:
            tally.settle(slots)


def _hours(batch: pa.RecordBatch, sims: int) -> tuple[np.ndarray, np.ndarray]:
    """The batch's changes and departures as numbers."""
    changes = np.empty((len(batch), sims * MINUTES), np.int32)
    for i, text in enumerate(batch["changes"]):
        raw = text.as_buffer()
        changes[i] = np.frombuffer(raw, f"i{raw.size // (sims * MINUTES)}")
    departures = np.array([np.frombuffer(text.as_buffer(), np.int64) for text in batch["departures"]]).reshape(len(batch), sims)
    return changes.reshape(-1, sims, MINUTES), departures


def hour_metrics(counts: np.ndarray, departures: np.ndarray) -> dict[str, np.ndarray]:
    """The fifteen metrics over the last axis of counts (hours, simulations, minutes)."""
    wide = counts if counts.max() < 5000 else counts.astype(np.int64)  # sixty squares fit in 31 bits
    area, squares, ranked = counts.sum(axis=2), np.einsum("hsm,hsm->hs", wide, wide), np.sort(counts, axis=2)
    ge2, ge3, ge4 = (np.count_nonzero(counts >= k, axis=2) for k in (2, 3, 4))
    peak, low, part = ranked[:, :, -1], int(0.9 * (MINUTES - 1)), 0.9 * (MINUTES - 1) - int(0.9 * (MINUTES - 1))
    return {
        "overlap_max": peak,
        "overlap_mean": area / 60.0,
        "overlap_median": (ranked[:, :, 29] + ranked[:, :, 30]) / 2.0,
        "overlap_p90": ranked[:, :, low] + (ranked[:, :, low + 1] - ranked[:, :, low]) * part,
        "overlap_minutes_ge2": ge2,
        "overlap_minutes_ge3": ge3,
        "overlap_pairs_per_hour": (squares - area) / 120.0,
        "overlap_near_conflict_minutes": ge2 - ge4,
        OVERLAPS: ge2 > 0,
        "concurrency_mean": area / 60.0,
        "concurrency_peak": peak,
        "concurrency_std": np.sqrt(np.maximum(squares / 60.0 - (area / 60.0) ** 2, 0.0)),
        "concurrency_area": area,
        "dep_activity": departures,
        "arr_activity": area - departures,
    }


class Moments:
    """Mean and sum of squared deviations of every metric, for partial changes sorted by (group, hour); of each batch of
    simulations, which ``looks`` ends."""

    def __init__(self, sims: int, metrics: list[str], looks: list[int]):
        self.sims, self.metrics, self.looks = sims, metrics, looks

    def told(self, groups: list[str], hours: list[int], changes: np.ndarray, departures: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a, b in zip([0, *self.looks], self.looks, strict=False):
            yield self.batch(b, groups, hours, changes[:, a:b], departures[:, a:b])

    def batch(self, upto: int, groups: list[str], hours: list[int], changes: np.ndarray, departures: np.ndarray) -> pa.RecordBatch:
        counts = np.cumsum(changes, axis=2, dtype=np.int32)
        found = {OVERLAPS: (counts >= 2).any(axis=2)} if self.metrics == [f"sim_{OVERLAPS}"] else hour_metrics(counts, departures)
        columns = {"airport_group": pa.array(groups, pa.string()), "hour_number": pa.array(hours, pa.int64()), "upto": pa.array([upto] * len(hours), pa.int32())}
        for m in self.metrics:
            values = found[m.removeprefix("sim_")].astype(np.float64)
            mean = values.mean(axis=1)
            columns |= {f"{m}__m": pa.array(mean), f"{m}__d": pa.array(((values - mean[:, None]) ** 2).sum(axis=1))}
        return pa.record_batch(columns)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, rest = max(1, CELLS // (self.sims * MINUTES)), None
        for batch in batches:
            for part in (batch.slice(i, size) for i in range(0, len(batch), size)):
                keys = list(zip(part["airport_group"].to_pylist(), part["hour_number"].to_pylist(), strict=True))
                changes, departures = _hours(part, self.sims)
                if rest:  # the last hour of the part before may go on
                    keys, changes, departures = [rest[0], *keys], np.concatenate([rest[1], changes]), np.concatenate([rest[2], departures])
                starts = [i for i, k in enumerate(keys) if i == 0 or k != keys[i - 1]]
                keys, changes, departures = [keys[i] for i in starts], np.add.reduceat(changes, starts, axis=0, dtype=np.int32), np.add.reduceat(departures, starts, axis=0)
                rest = keys[-1], changes[-1:], departures[-1:]
                if len(keys) > 1:
                    yield from self.told([g for g, _ in keys[:-1]], [h for _, h in keys[:-1]], changes[:-1], departures[:-1])
        if rest:
            yield from self.told([rest[0][0]], [rest[0][1]], rest[1], rest[2])


def counted_draws(sides: DataFrame, distributions, n: int, first: int, last: int, seed: int = 42, stratified: bool = True, overlaps_only: bool = False) -> DataFrame:
    """airport_group, hour_number and the changes by simulation and minute, in one row or several for an hour; with
    ``overlaps_only`` they tell no more than where two movements overlap."""
    taken = sides.select("flight_id", "movement", "airport_group", "scheduled_time", "rate", "key", "n")
    return taken.mapInArrow(Drawing(distributions, n, first, last, seed, stratified, overlaps_only), "airport_group string, hour_number bigint, changes binary, departures binary")


def drawn_moments(sides: DataFrame, distributions, metrics: list[str], n: int, first: int, last: int, seed: int = 42, stratified: bool = True, looks: list[int] | None = None) -> DataFrame:
    """Mean and sum of squared deviations of every metric by (group, hour) over simulations first..last-1 of n; with ``looks``
    those of each batch of them, by the simulation ``upto`` which it goes."""
    parts = counted_draws(sides, distributions, n, first, last, seed, stratified, metrics == [f"sim_{OVERLAPS}"])
    placed = parts.repartition("airport_group", "hour_number").sortWithinPartitions("airport_group", "hour_number")
    columns = ", ".join(f"{m}__{tail} double" for m in metrics for tail in ("m", "d"))
    found = placed.mapInArrow(Moments(last - first, metrics, [k - first for k in looks or [last]]), f"airport_group string, hour_number bigint, upto int, {columns}")
    return found.withColumn("upto", F.col("upto") + first) if looks else found.drop("upto")
