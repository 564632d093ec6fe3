"""Column functions: array statistics, distances, key and time parsing. All stay in the JVM and are safe under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def present(arr: Column) -> Column:
    """The non-null elements; null for a null array."""
    return F.filter(arr, lambda x: x.isNotNull())


def array_sum(arr: Column) -> Column:
    """Sum of the non-null elements from left to right, 0 when there are none; null for a null array."""
    return F.aggregate(present(arr), F.lit(0.0), lambda a, x: a + x)


def array_mean(arr: Column) -> Column:
    """Mean of the non-null elements; null without any."""
    return F.try_divide(array_sum(arr), F.size(present(arr)).cast("double"))


def nearest_rank(arr: Column, p: float) -> Column:
    """Element of rank ``min(n - 1, int(n * p))`` of the ascending non-null elements; null without any."""
    s = F.array_sort(present(arr))
    n = F.size(s)
    return F.when(n > 0, F.try_element_at(s, (F.least(n - 1, F.floor(n * F.lit(p)).cast("int")) + 1).cast("int")))


def upper_median(arr: Column) -> Column:
    """Element ``n // 2`` of the ascending non-null elements; null without any."""
    s = F.array_sort(present(arr))
    return F.when(F.size(s) > 0, F.try_element_at(s, (F.floor(F.size(s) / 2) + 1).cast("int")))


def interpolated(arr: Column, p: float) -> Column:
    """Percentile with linear interpolation between ranks; null without elements."""
    s = F.array_sort(present(arr))
    at = (F.size(s) - 1) * F.lit(p)
    low = F.floor(at)
    a, b = F.try_element_at(s, (low + 1).cast("int")), F.try_element_at(s, (F.ceil(at) + 1).cast("int"))
    return F.when(F.size(s) > 0, a + (b - a) * (at - low))


def min_max(arr: Column, flat: float = 0.5) -> Column:
    """Elements scaled to [0, 1]; all ``flat`` when they differ by less than 1e-9."""
    low, high = F.array_min(arr), F.array_max(arr)
    return F.transform(arr, lambda x: F.when(high - low < 1e-9, F.lit(flat)).otherwise((x - low) / F.when(high - low < 1e-9, F.lit(1.0)).otherwise(high - low)))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


_HEX = r"\A[0-9a-f]{16}\z"


def _half(x: Column, start: int) -> Column:
    return F.conv(F.substring(x, start, 8), 16, 10).cast("bigint")


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 16-digit hex values; 64 when either is null or malformed. Compared in 32-bit halves."""
    ok = F.coalesce(a.rlike(_HEX) & b.rlike(_HEX), F.lit(False))
    bits = F.bit_count(_half(a, 1).bitwiseXOR(_half(b, 1))) + F.bit_count(_half(a, 9).bitwiseXOR(_half(b, 9)))
    return F.when(ok, bits).otherwise(64)


def signature_distance(a: Column, b: Column) -> Column:
    """Smallest distance over all pairs of frames of two ``:``-joined signatures; 64 when either is null."""
    pairs = F.flatten(F.transform(F.split(a, ":"), lambda x: F.transform(F.split(b, ":"), lambda y: hamming(x, y))))
    return F.coalesce(F.array_min(pairs), F.lit(64))


def dot(a: Column, b: Column) -> Column:
    """Dot product; 0 for null, empty or different lengths."""
    same = F.coalesce((F.size(a) == F.size(b)) & (F.size(a) > 0), F.lit(False))
    return F.when(same, F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)).otherwise(0.0)


def db_to_unit(db: Column) -> Column:
    return clamp((db + 60) / 54, 0.0, 1.0)


def saturate(v: Column, half: float = 500.0) -> Column:
    return v / (v + half)


def luma_offset(mean: Column, target: Column) -> Column:
    """Half the way to the target, at most 0.08 either way; null when either is unknown."""
    return F.when(mean.isNotNull() & target.isNotNull(), F.round(clamp((target - mean) * 0.5, -0.08, 0.08), 4))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    """Lower-case extension with its dot, or an empty string."""
    return F.lower(F.regexp_extract(base_name(path), r"(?<=.)(\.[^.]*)$", 1))


def seeded_index(text: Column, n: int) -> Column:
    """``int(sha1(text)[:8], 16) mod n``: a stable choice per text."""
    return F.pmod(F.conv(F.substring(F.sha1(text), 1, 8), 16, 10).cast("bigint"), F.lit(n))


# Forms of moments in file names.
_DASHED = r"\d{4}-\d{2}-\d{2}-\d{2}-\d{2}-\d{2}"
_SENT = r"(?i)(?:IMG|VID)-(\d{8})-WA(\d+)"


def name_time(name: Column) -> Column:
    """Moment in a file name as a zone-less timestamp: six dashed numbers (``...-2026-04-08-08-43-11``), else the day and running
    number of ``IMG-20260408-WA0012`` or ``VID-...``, taken as seconds; null without a valid one."""
    full = F.regexp_extract(name, _DASHED, 0)
    moment = F.try_to_timestamp(F.when(full != "", full), F.lit("yyyy-MM-dd-HH-mm-ss"))
    day = F.regexp_extract(name, _SENT, 1)
    number = F.regexp_extract(name, _SENT, 2).try_cast("int")
    start = F.try_to_timestamp(F.when(day != "", day), F.lit("yyyyMMdd"))
    return F.coalesce(moment, F.timestamp_add("SECOND", number, start))


def camera_name_time(name: Column) -> Column:
    """Moment in a camera's file name such as ``VID_20240131_120501``; null without a valid one."""
    found = F.regexp_extract(name, r"(?:^|\D)(\d{8}[_-]\d{6})(?:\D|$)", 1)
    return F.try_to_timestamp(F.when(found != "", F.translate(found, "-", "_")), F.lit("yyyyMMdd_HHmmss"))


def iso_time(text: Column) -> Column:
    """POSIX seconds of an ISO 8601 moment, with ``Z``, an offset or neither (the session's zone), or of an EXIF moment ``YYYY:MM:DD HH:MM:SS``; null for others."""
    exif = F.regexp_extract(text, r"^(\d{4}):(\d{2}):(\d{2}) (\d{2}:\d{2}:\d{2})$", 0)
    dashed = F.when(exif != "", F.regexp_replace(text, r"^(\d{4}):(\d{2}):(\d{2}) ", "$1-$2-$3 ")).when(text.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:Z|[+-]\d{2}:?\d{2})?)?$"), text)
    return F.unix_micros(F.try_to_timestamp(dashed).cast("timestamp")) / F.lit(1e6)


def db_levels(text: Column) -> Column:
    """The levels in decibels that a log line list holds as ``RMS_level=-23.5``; ``-inf`` is no level."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"RMS_level=(-?\d+(?:\.\d+)?)"), F.lit(1)), lambda x: x.cast("double"))


def difference_hash(pixels: Column) -> Column:
    """The 16 hex digits of a 9 x 8 grey image given row by row (72 values): a bit is set where a pixel is brighter than its right neighbour; null for other sizes or missing pixels."""
    def digit(i: int) -> Column:
        bits = [(8 * (i // 2) + 4 * (i % 2) + b) for b in range(4)]
        at = [(9 * (k // 8) + k % 8) for k in bits]
        return F.hex(sum((F.when(F.try_element_at(pixels, F.lit(a + 1)) > F.try_element_at(pixels, F.lit(a + 2)), 8 >> b).otherwise(0) for b, a in enumerate(at)), F.lit(0)).cast("int"))

    whole = (F.size(pixels) == 72) & ~F.exists(pixels, lambda x: x.isNull())
    return F.when(whole, F.lower(F.concat(*[digit(i) for i in range(16)])))


def padded(arr: Column, n: Column | int, fill: Column) -> Column:
    """``arr`` cut to ``n`` elements, or filled up to them with ``fill``."""
    n = F.lit(n) if isinstance(n, int) else n
    have = F.coalesce(F.size(arr), F.lit(0))
    return F.slice(F.concat(F.coalesce(arr, F.array().cast("array<double>")), F.array_repeat(fill.cast("double"), F.greatest(F.lit(0), n - have))), 1, n)


def extended(arr: Column, n: Column | int) -> Column:
    """``arr`` filled up to ``n`` elements with its last one, 0 when it has none."""
    return padded(arr, n, F.coalesce(F.try_element_at(arr, F.lit(-1)), F.lit(0.0)))
