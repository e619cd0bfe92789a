"""Address classes as range tests on the 32-bit number of a dotted address."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IPV4 = r"^((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"

# Special ranges in the order in which they are tested.
SPECIAL_RANGES = [
    ("loopback", "127.0.0.0", 8),
    ("link_local", "169.254.0.0", 16),
    ("broadcast", "255.255.255.255", 32),
    ("this_network", "0.0.0.0", 8),
    ("multicast", "224.0.0.0", 4),
    ("reserved", "240.0.0.0", 4),
]
# Ranges that count as internal for traffic direction.
INTERNAL_RANGES = [("10.0.0.0", 8), ("172.16.0.0", 12), ("192.168.0.0", 16)]
# Ranges that Python's ipaddress reports as private.
PRIVATE_RANGES = [
    ("0.0.0.0", 8),
    ("10.0.0.0", 8),
    ("127.0.0.0", 8),
    ("169.254.0.0", 16),
    ("172.16.0.0", 12),
    ("192.0.0.0", 24),
    ("192.0.2.0", 24),
    ("192.168.0.0", 16),
    ("198.18.0.0", 15),
    ("198.51.100.0", 24),
    ("203.0.113.0", 24),
    ("240.0.0.0", 4),
]
PRIVATE_EXCEPTIONS = ["192.0.0.9", "192.0.0.10"]
# Networks of common cloud services.
CLOUD_RANGES = [
    ("13.64.0.0", 11),
    ("20.0.0.0", 8),
    ("40.64.0.0", 10),
    ("52.224.0.0", 11),
    ("104.208.0.0", 13),
    ("150.171.0.0", 16),
]


def _number(dotted: str) -> int:
    a, b, c, d = (int(part) for part in dotted.split("."))
    return (a << 24) + (b << 16) + (c << 8) + d


def in_range(number: Column, base: str, bits: int) -> Column:
    low = _number(base)
    return number.between(F.lit(low), F.lit(low + (1 << (32 - bits)) - 1))


def in_any(number: Column, ranges) -> Column:
    test = F.lit(False)
    for base, bits in ranges:
        test = test | in_range(number, base, bits)
    return F.coalesce(test, F.lit(False))


def with_numbers(df: DataFrame, **columns: str) -> DataFrame:
    """Add the 32-bit number of address columns, null for text that is no dotted IPv4 address.

    `with_numbers(df, src_num="src_ip")`. The parts and the number are columns of their own, so that the
    many range tests on a number do not split the text again.
    """
    parts = {f"{name}_parts": F.split(F.col(ip), r"\.") for name, ip in columns.items()}

    def number(name, ip):
        value = F.lit(0).cast("bigint")
        for i in range(4):
            value = value * 256 + F.col(f"{name}_parts")[i].cast("bigint")
        return F.when(F.col(ip).rlike(IPV4), value)

    return df.withColumns(parts).withColumns({n: number(n, ip) for n, ip in columns.items()}).drop(*parts)


def ip_class(number: Column) -> Column:
    chain = F.when(number.isNull(), "error")
    for name, base, bits in SPECIAL_RANGES:
        chain = chain.when(in_range(number, base, bits), name)
    return chain.when(in_any(number, INTERNAL_RANGES), "internal").otherwise("external")


def direction_of(src_class: Column, dst_class: Column) -> Column:
    def both(a, b):
        return (src_class == a) & (dst_class == b)

    return (
        F.when((src_class == "error") | (dst_class == "error"), "error")
        .when(dst_class.isin("broadcast", "multicast"), dst_class)
        .when((src_class == "loopback") | (dst_class == "loopback"), "loopback")
        .when(both("internal", "internal"), "internal")
        .when(both("external", "external"), "external")
        .when(both("internal", "external"), "outbound")
        .when(both("external", "internal"), "inbound")
        .otherwise("unknown")
    )


def with_direction(df: DataFrame, src: str, dst: str, name: str = "direction") -> DataFrame:
    numbered = with_numbers(df, src_num_=src, dst_num_=dst)
    classed = numbered.withColumns({"src_class_": ip_class(F.col("src_num_")), "dst_class_": ip_class(F.col("dst_num_"))})
    result = classed.withColumn(name, direction_of(F.col("src_class_"), F.col("dst_class_")))
    return result.drop("src_num_", "dst_num_", "src_class_", "dst_class_")


def is_private(number: Column) -> Column:
    return in_any(number, PRIVATE_RANGES) & ~F.coalesce(number.isin(*[_number(x) for x in PRIVATE_EXCEPTIONS]), F.lit(False))


def is_public(number: Column) -> Column:
    """Valid address outside the private ranges; text that is no address is neither."""
    return number.isNotNull() & ~is_private(number)


def common_cloud_ip(number: Column) -> Column:
    return in_any(number, CLOUD_RANGES)


def outside_internal(number: Column) -> Column:
    """Four dotted numbers outside the three internal ranges."""
    return number.isNotNull() & ~in_any(number, INTERNAL_RANGES)


def non_investigative_node(number: Column) -> Column:
    """Multicast, the all-zero and all-one addresses, and addresses that end in .255."""
    return F.coalesce(in_any(number, [("224.0.0.0", 4)]) | (number == 0) | (number % 256 == 255), F.lit(False))
