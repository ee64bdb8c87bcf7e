"""Raw text records: typing, exact decimals, calendar of intervals, delays, layered flags and lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import blank

PATTERN = "yyyy-MM-dd'T'HH:mm:ssXXX"
#: Upper ends in seconds and names of the delay classes, after the classes for unknown, negative and zero delays.
DELAYS = [(300, "UP_TO_5_MIN"), (3_600, "UP_TO_1_H"), (86_400, "UP_TO_1_D"), (604_800, "UP_TO_7_D")]


def instant(text: Column) -> Column:
    """Epoch seconds of an ISO text with offset; null for anything else."""
    return F.unix_seconds(F.try_to_timestamp(text, F.lit(PATTERN)))


def typed(df: DataFrame, *, timestamp: str, update: str, value: str) -> DataFrame:
    """`df` with epoch, update_epoch (long), value_double and value_exact (decimal(38,18)); what does not parse is null, a null text too."""
    return df.withColumns(
        {
            "epoch": instant(F.col(timestamp)),
            "update_epoch": instant(F.col(update)),
            "value_double": F.col(value).try_cast("double"),
            "value_exact": F.col(value).try_cast("decimal(38,18)"),
        }
    )


def decimal_shape(text: Column) -> dict[str, Column]:
    """scale, integer_digits and exponent (int) of a number as written, and `fits`: whether decimal(38,18) holds it without loss.

    Trailing zeros of the fraction and leading zeros of the integer part do not count; the exponent moves the point.
    All are null for a text that is no finite number. An exponent that an int does not hold leaves the three counts null, and nothing fits.
    """
    number = r"^\s*[+-]?([0-9]*)\.?([0-9]*)(?:[eE]([+-]?[0-9]+))?\s*$"
    is_number = F.regexp_like(text, F.lit(number)) & F.regexp_like(text, F.lit("[0-9]"))
    whole, part = F.regexp_extract(text, number, 1), F.regexp_extract(text, number, 2)
    written = F.regexp_extract(text, number, 3)
    exponent = F.when(written == "", 0).otherwise(written.try_cast("int"))
    digits = F.concat(whole, part)
    significant = F.length(F.regexp_replace(digits, "^0+", ""))
    trailing = F.length(digits) - F.length(F.regexp_replace(digits, "0+$", ""))
    zero = significant == 0
    # in longs: an int exponent near its limits would overflow; greatest() skips nulls, so an unknown exponent is kept apart
    moved = exponent.cast("long")
    scale = F.when(zero, 0).otherwise(F.greatest(F.length(part) - moved - trailing, F.lit(0)))
    integer_digits = F.when(zero, 0).otherwise(F.greatest(significant - F.length(part) + moved, F.lit(0)))
    scale, integer_digits = (F.when(exponent.isNotNull(), F.least(c, F.lit(2**31 - 1))).cast("int") for c in (scale, integer_digits))
    out = {"scale": scale, "integer_digits": integer_digits, "exponent": exponent, "fits": F.coalesce((scale <= 18) & (integer_digits <= 20), F.lit(False))}
    return {name: F.when(is_number, c) for name, c in out.items()}


def interval_calendar(epoch: Column, step: int) -> dict[str, Column]:
    """Calendar of the interval (epoch - step, epoch] in the session zone: it belongs to the date, hour and month in which it starts."""
    start, end = F.timestamp_seconds(epoch - step), F.timestamp_seconds(epoch)
    return {
        "period_start": epoch - step,
        "observation_date": F.to_date(end),
        "period_date": F.to_date(start),
        "period_hour": F.hour(start),
        "year": F.year(start),
        "month": F.month(start),
    }


def align(df: DataFrame, epoch: str, step: int, phase: int, shift: int, applies: Column, rule: str) -> DataFrame:
    """`df` with aligned (long), align_offset_s and align_rule: rows that stand `phase` seconds into a step and satisfy `applies` move by `shift`.

    Others keep their epoch with offset 0 and no rule; a null epoch or condition moves nothing.
    """
    moves = F.coalesce(applies & (F.pmod(F.col(epoch), F.lit(step)) == phase), F.lit(False))
    offset = F.when(moves, shift).otherwise(0).cast("long")
    return df.withColumns({"aligned": F.col(epoch) + offset, "align_offset_s": offset, "align_rule": F.when(moves, rule)})


def delay_class(delay: Column) -> Column:
    """Name of the class of a delay in seconds; UNKNOWN for null."""
    out = F.when(delay.isNull(), "UNKNOWN").when(delay < 0, "NEGATIVE").when(delay == 0, "ZERO")
    for end, name in DELAYS:
        out = out.when(delay <= end, name)
    return out.otherwise("OVER_7_D")


def layers(df: DataFrame, structural: Column, key: Column, value: Column) -> DataFrame:
    """`df` with the flags structural, key_eligible and candidate_valid, each implying the one before; null conditions count as not met."""
    met = [F.coalesce(c, F.lit(False)) for c in (structural, key, value)]
    return df.withColumns({"structural": met[0], "key_eligible": met[0] & met[1], "candidate_valid": met[0] & met[1] & met[2]})


def soft_warning(name: Column, longitude: Column, latitude: Column, update: Column) -> Column:
    """Whether metadata is doubtful though the row stands: blank name, coordinates that are missing or off the globe, or no update time."""
    lon, lat = longitude.try_cast("double"), latitude.try_cast("double")
    inside = F.coalesce(lon.between(-180, 180) & lat.between(-90, 90), F.lit(False))
    return blank(name) | ~inside | update.isNull()


def split_valid(df: DataFrame, reasons: str) -> tuple[DataFrame, DataFrame]:
    """(rows without reasons, rows with some); a null reason array counts as none."""
    bad = F.coalesce(F.size(reasons), F.lit(0)) > 0
    return df.where(~bad), df.where(bad)


def lineage(df: DataFrame, raw: list[str], line: str, source: str, source_hash: Column) -> DataFrame:
    """`df` with raw_ copies of the columns `raw`, the source's name and hash, and the SHA-256 of each record (null for a null line)."""
    copies = {f"raw_{c}": F.col(c) for c in raw}
    return df.withColumns({**copies, "source_file": F.lit(source), "source_hash": source_hash, "record_hash": F.sha2(line, 256)})
