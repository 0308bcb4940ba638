"""Expressions over range-scan arrays."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from scanweave.functions.exprs import col


def valid(mm: Column, sensor_max: float | None = None) -> Column:
    """A reading that is neither sentinel (0, 65535) nor beyond the sensor's range."""
    ok = (mm != 0) & (mm != 65535)
    return ok if sensor_max is None else ok & (mm < sensor_max)


def dissimilarity(a: str | Column, b: str | Column, sensor_max: float) -> Column:
    """struct(n, mean): mean absolute change over the slots valid in both scans."""
    diffs = F.filter(F.zip_with(col(a), col(b), lambda x, y: F.when(
        valid(x, sensor_max) & valid(y, sensor_max), F.abs(x - y))), lambda d: d.isNotNull())
    total = F.aggregate(diffs, F.lit(0).cast("long"), lambda s, d: s + d)
    return F.struct(F.size(diffs).alias("n"),
                    F.when(F.size(diffs) > 0, total / F.size(diffs)).alias("mean"))


class Beams:
    """Beam layout of a scanner: first angle, step and number of active slots.

    Angular limits are turned into slot numbers once, so no float comparison
    decides which beam belongs to a cone or sector.
    """

    def __init__(self, start_deg: float, step_deg: float, active: int):
        self.start, self.step, self.active = start_deg, step_deg, active

    def angle(self, slot: Column) -> Column:
        return F.lit(self.start) + F.lit(self.step) * slot

    def angles(self) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(self.active - 1)), lambda i: self.angle(i))

    def slots_between(self, lo_deg: float, hi_deg: float) -> tuple[int, int]:
        """First and last slot with lo <= angle <= hi."""
        hit = [i for i in range(self.active) if lo_deg - 1e-9 <= self.start + self.step * i <= hi_deg + 1e-9]
        return hit[0], hit[-1]

    def part(self, d: Column, lo_deg: float, hi_deg: float) -> Column:
        a, b = self.slots_between(lo_deg, hi_deg)
        return F.slice(d, a + 1, b - a + 1)

    def sectors(self, d: Column, n: int) -> list[Column]:
        """The active slots cut in ``n`` neighbouring sectors."""
        cuts = [-(-s * self.active // n) for s in range(n + 1)]
        return [F.slice(d, a + 1, b - a) for a, b in zip(cuts, cuts[1:])]

    def sector_slots(self, bounds: list[tuple[float, float]]) -> list[tuple[int, int]]:
        """First and last slot of each sector lo <= angle < hi; the last sector has its upper bound too. A sector
        without a slot is (0, -1)."""
        out = []
        for i, (lo, hi) in enumerate(bounds):
            end = hi + 1e-6 if i == len(bounds) - 1 else hi - 1e-9
            hit = [k for k in range(self.active) if lo - 1e-9 <= self.start + self.step * k <= end]
            out.append((hit[0], hit[-1]) if hit else (0, -1))
        return out

    def near_slots(self, centre_deg: Column, half_deg: float, limits: tuple[float, float] | None = None) -> list[tuple[Column, Column]]:
        """Runs of slots within ``half_deg`` of a direction on the circle, inside ``limits`` if there are any.

        A cone may reach over the end of the angles, so it is looked up at the direction and one turn to either side;
        with a half width below 180 degrees the runs don't overlap. A run that is empty ends before it begins.
        """
        a, z = self.slots_between(*limits) if limits else (0, self.active - 1)
        runs = []
        for turn in (-360.0, 0.0, 360.0):
            at = centre_deg + turn - self.start
            runs.append((F.greatest(F.ceil((at - half_deg) / self.step), F.lit(a)).cast("int"),
                         F.least(F.floor((at + half_deg) / self.step), F.lit(z)).cast("int")))
        return runs


WORD = 64


def bitmap(d: str | Column, cond, slots: int) -> Column:
    """Slots for which ``cond`` holds, as an array of 64-bit words."""
    def word(w):
        bits = F.transform(F.slice(col(d), w * WORD + 1, WORD), lambda x, b: F.when(
            cond(x), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))
    return F.transform(F.sequence(F.lit(0), F.lit(-(-slots // WORD) - 1)), word)


def mask_words(usable: list[bool]) -> Column:
    """A mask of slots as the same kind of words."""
    words = []
    for w in range(0, len(usable), WORD):
        v = sum(1 << b for b, u in enumerate(usable[w:w + WORD]) if u)
        words.append(v - (1 << WORD) if v >> (WORD - 1) else v)
    return F.array(*[F.lit(v).cast("long") for v in words])


def both(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseAND(y))


def bits_between(words: Column, lo: Column, hi: Column) -> Column:
    """How many bits are set from slot ``lo`` to slot ``hi``, one bit count a word."""
    def counted(x, w):
        a, z = F.greatest(lo - w * WORD, F.lit(0)), F.least(hi - w * WORD, F.lit(WORD - 1))
        run = F.call_function("shiftleft", F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), F.lit(WORD - 1) - (z - a)), a)
        return F.when(a <= z, F.bit_count(x.bitwiseAND(run))).otherwise(0)
    return F.aggregate(F.transform(words, counted), F.lit(0), lambda s, n: s + n)


def kept_slots(d: str | Column, usable: list[bool] | None) -> Column:
    """A scan with the slots of the mask's blind spots set to the sentinel of no return."""
    if usable is None:
        return col(d)
    return F.zip_with(F.slice(col(d), 1, len(usable)), F.array(*[F.lit(u) for u in usable]), lambda x, u: F.when(u, x).otherwise(F.lit(0)))


def readings(d: str | Column) -> Column:
    """Valid readings of a scan, sentinels removed."""
    return F.filter(col(d), lambda x: valid(x))


def masked(d: str | Column) -> Column:
    """Scan with sentinels replaced by null."""
    return F.transform(col(d), lambda x: F.when(valid(x), x))


def array_mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x) / F.size(a))


def share(a: Column, cond, denominator: Column | None = None) -> Column:
    n = F.size(a) if denominator is None else denominator
    return F.size(F.filter(a, cond)) / F.when(n > 0, n)


def array_quantile(sorted_: Column, p: float) -> Column:
    """Linear-interpolation quantile of a sorted array without nulls."""
    pos = F.lit(p) * (F.size(sorted_) - 1)
    lo = F.floor(pos).cast("int")
    a, b = F.get(sorted_, lo), F.get(sorted_, F.ceil(pos).cast("int"))
    return F.when(F.size(sorted_) > 0, a + (b - a) * (pos - lo))


def cosine(a: str | Column, b: str | Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(col(x), col(y), lambda p, q: p.cast("double") * q.cast("double")),
                                   F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def rmse(a: str | Column, b: str | Column) -> Column:
    sq = F.zip_with(col(a), col(b), lambda p, q: (p.cast("double") - q.cast("double")) ** 2)
    return F.sqrt(F.aggregate(sq, F.lit(0.0), lambda s, v: s + v) / F.size(sq))


def bearing(x: Column, y: Column, heading: Column, ax: Column, ay: Column) -> Column:
    """Direction to a point in the body frame, radians in [-pi, pi)."""
    from scanweave.functions.exprs import wrap_angle
    return wrap_angle(F.atan2(ay - y, ax - x) - heading)
