"""Time is carried as microseconds since 1970 UTC (`us`), a plain bigint."""

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000


def ntz_to_us(ts: str) -> str:
    """SQL text: microseconds of a timestamp without zone. No step depends on the session zone."""
    return f"""(unix_date(cast({ts} AS date)) * 86400000000L + hour({ts}) * 3600000000L + minute({ts}) * 60000000L
        + cast(extract(SECOND FROM {ts}) * 1000000 AS bigint))"""


def us_to_ntz(us: str) -> Column:
    return F.expr(f"timestampadd(MICROSECOND, {us}, TIMESTAMP_NTZ'1970-01-01 00:00:00')")


def us_to_iso(us: str) -> Column:
    """ISO-8601 with a `Z`; the fraction is left out when it is zero."""
    whole = F.translate(F.substring(us_to_ntz(us).cast("string"), 1, 19), " ", "T")
    fraction = F.pmod(F.col(us), F.lit(1_000_000))
    return (
        F.when(F.col(us).isNull(), None)
        .when(fraction == 0, F.concat(whole, F.lit("Z")))
        .otherwise(F.concat(whole, F.lit("."), F.lpad(fraction.cast("string"), 6, "0"), F.lit("Z")))
    )


def normalize_timestamp(text: Column) -> Column:
    """ISO text to `us`; text without an offset is UTC, text that is no time gives null."""
    trimmed = F.trim(text)
    zoned = F.when(trimmed.rlike(r"(Z|[+-]\d\d:?\d\d)$"), trimmed).otherwise(F.concat(trimmed, F.lit("Z")))
    return F.unix_micros(F.try_to_timestamp(zoned))


def hour_bucket(us: str) -> Column:
    return F.expr(f"{us} div {HOUR_US}L")
