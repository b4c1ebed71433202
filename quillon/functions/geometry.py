"""Boxes, frames and intervals as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two [x1, y1, x2, y2]; 0 if the union is empty."""
    zero = F.lit(0.0)
    side = lambda lo, hi: F.greatest(zero, (hi - lo).cast("double"))
    inter = side(F.greatest(a[0], b[0]), F.least(a[2], b[2])) * side(F.greatest(a[1], b[1]), F.least(a[3], b[3]))
    union = side(a[0], a[2]) * side(a[1], a[3]) + side(b[0], b[2]) * side(b[1], b[3]) - inter
    return F.when(union > 0, inter / union).otherwise(zero)


def clamp_1000(x: Column) -> Column:
    """Rounded half to even, within 0..1000."""
    return F.least(F.lit(1000), F.greatest(F.lit(0), F.bround(x.cast("double")).cast("int")))


def box_to_1000(box: Column, width: Column, height: Column) -> Column:
    """A box in shares of the frame, or in pixels if any side exceeds 1.5, on a scale of 1000."""
    x = [box[k].cast("double") for k in range(4)]
    shares = F.greatest(*[F.abs(v) for v in x]) <= 1.5
    scale = [F.when(shares, F.lit(1.0)).otherwise(s.cast("double")) for s in (width, height, width, height)]
    return F.when(F.size(box) >= 4, F.array(*[clamp_1000(v / s * 1000) for v, s in zip(x, scale)]))


def mask_box(xs: Column, ys: Column, width: Column, height: Column, inclusive: bool) -> Column:
    """The box of a mask's pixels (arrays of columns and rows); ``inclusive`` counts the last pixel in full."""
    far = 1 if inclusive else 0
    low = lambda v, n: clamp_1000(F.array_min(v) / n * 1000)
    high = lambda v, n: clamp_1000((F.array_max(v) + far) / n * 1000)
    return F.when(F.size(xs) > 0, F.array(low(xs, width), low(ys, height), high(xs, width), high(ys, height)))


def xywh_to_xyxy(box: Column) -> Column:
    return F.array(box[0], box[1], box[0] + box[2], box[1] + box[3])


def scale_truncated(box: Column, by: int = 1000) -> Column:
    return F.transform(box, lambda b: (b * by).cast("int"))


def relative_box(box: Column, height: Column, width: Column) -> Column:
    """Pixels on a scale of 1000 of the frame, rounded half to even."""
    return F.array(*[clamp_1000(box[k] / s.cast("double") * 1000) for k, s in enumerate((width, height, width, height))])


def smart_size(height: Column, width: Column, factor: int = 28, least: int = 56 * 56, most: int = 14 * 14 * 4 * 1280):
    """(height, width) in multiples of ``factor`` within the pixel budget; nulls for a side below ``factor`` or an aspect beyond 200."""
    h, w = height.cast("double"), width.cast("double")
    near = lambda v: F.bround(v / factor) * factor
    area, beta_down, beta_up = near(h) * near(w), F.sqrt(h * w / most), F.sqrt(F.lit(float(least)) / (h * w))

    def fit(v):
        down = F.floor(v / beta_down / factor) * factor
        return F.when(area > most, down).when(area < least, F.ceil(v * beta_up / factor) * factor).otherwise(near(v)).cast("int")

    sound = (F.least(h, w) >= factor) & (F.greatest(h, w) / F.least(h, w) <= 200)
    return F.when(sound, fit(h)), F.when(sound, fit(w))


def resized_box(box: Column, height: Column, width: Column, **size: int) -> Column:
    """A box in the pixels of the resized frame, kept inside it."""
    h, w = smart_size(height, width, **size)

    def put(v, new, old):
        return F.greatest(F.lit(0), F.least(F.bround(v * (new / old.cast("double"))).cast("int"), new - 1))

    return F.array(put(box[0], w, width), put(box[1], h, height), put(box[2], w, width), put(box[3], h, height))


def pixel_box(box: Column, width: Column, height: Column) -> Column:
    """A box on a scale of 1000 in pixels, its corners in order."""
    x = [F.bround(box[k] / 1000.0 * s).cast("int") for k, s in enumerate((width, height, width, height))]
    inside = [F.greatest(F.lit(0), F.least(v, s - 1)) for v, s in zip(x, (width, height, width, height))]
    return F.array(F.least(inside[0], inside[2]), F.least(inside[1], inside[3]), F.greatest(inside[0], inside[2]), F.greatest(inside[1], inside[3]))


def frame_index(seconds: Column, fps: Column, frames: Column) -> Column:
    at = F.greatest(F.lit(0), F.least((seconds * fps).cast("int"), frames - 1))
    return F.when(frames <= 0, 0).otherwise(at)


def even_frames(frames: Column, n: Column) -> Column:
    """n frame numbers from first to last, rounded half to even."""
    step = (frames - 1).cast("double") / F.greatest(n - 1, F.lit(1))
    return F.when(n <= 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.bround(k * step).cast("int")))


def truncated_frames(frames: Column, n: Column) -> Column:
    """n frame numbers from first to last, truncated, each once."""
    step = (frames - 1).cast("double") / F.greatest(n - 1, F.lit(1))
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda k: (k * step).cast("int")))


def bin_middles(duration: Column, n: Column) -> Column:
    """The middle of each of n equal parts of a duration; one frame stands at 0."""
    step = duration / n.cast("double")
    many = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda k: F.least(duration, (k + 0.5) * step))
    return F.when(n <= 1, F.array(F.lit(0.0))).otherwise(many)


def temporal_groups(n: Column, size: int) -> Column:
    """0..n-1 in runs of ``size``."""
    starts = F.sequence(F.lit(0), n - 1, F.lit(size))
    groups = F.transform(starts, lambda s: F.sequence(s, F.least(s + size - 1, n - 1)))
    return F.when(n > 0, groups).otherwise(F.array().cast("array<array<int>>"))


def clamp_interval(start: Column, end: Column, duration: Column):
    """Both ends within the duration, the smaller one first."""
    a, b = (F.greatest(F.lit(0.0), F.least(x, duration)) for x in (start, end))
    return F.least(a, b), F.greatest(a, b)


def positive_double(c: Column) -> Column:
    x = c.cast("string").try_cast("double")
    return F.when(x > 0, x)


def positive_int(c: Column) -> Column:
    """A whole number above 0; text with decimals is none."""
    x = F.when(F.trim(c.cast("string")).rlike(r"^[+-]?\d+$"), c.cast("string").try_cast("int"))
    return F.when(x > 0, x)


def clip_frames(frames: Column, interval: Column, least: int, most: int) -> Column:
    """Frames to take at one per interval, within bounds."""
    return F.least(F.lit(most), F.greatest(F.lit(least), F.bround(frames / interval.cast("double")).cast("int")))


def sampled_frames(fixed: list[Column], limit: Column, source: Column, duration: Column, fps: Column) -> Column:
    """Frames that are taken of a video: a processor's own number, else the limit, else duration by rate, none beyond the source; else all of it.

    ``fixed``: the processor's settings in order of precedence. ``limit``: null where a model knows none.
    """
    given = F.coalesce(*[positive_int(c) for c in fixed], positive_int(limit))
    by_rate = F.when((duration * fps).isNotNull(), F.greatest(F.lit(1), F.bround(duration * fps).cast("int")))  # the greater of 1 and null is 1
    taken = F.coalesce(given, by_rate)
    return F.when(taken.isNull(), source).when(source > 0, F.least(taken, source)).otherwise(taken)


def sample_fps(rates: list[Column], fixed_count: Column, duration: Column, frames: Column) -> Column:
    """The rate of sampling: the first that is set, unless a fixed number of frames is taken; else frames by duration."""
    given = F.when(~fixed_count, F.coalesce(*[positive_double(c) for c in rates]))
    return F.coalesce(given, F.try_divide(frames.cast("double"), duration))


def capped_frames(asked: Column, sources: Column) -> Column:
    """Frames asked for, no more than the shortest of the videos that tell how many they have."""
    known = F.filter(sources, lambda n: n > 0)
    return F.when(positive_int(asked).isNull(), asked).otherwise(F.least(asked, F.array_min(known)))


def visual_tokens(t: Column, h: Column, w: Column) -> Column:
    """Tokens of a patch grid whose 2 x 2 cells are merged."""
    return F.floor(t * h * w / 4).cast("long")
