"""Names, domains, roles and evidence lists."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Role aliases.
ROLE_ALIASES = {
    "DOMAIN_CONTROLLER": "DOMAIN_CONTROLLER",
    "DOMAIN CONTROLLER": "DOMAIN_CONTROLLER",
    "INFRASTRUCTURE_DEVICE": "INFRASTRUCTURE",
    "MULTICAST_SERVICE_HOST": "INFRASTRUCTURE",
    "INFRASTRUCTURE": "INFRASTRUCTURE",
    "SERVER": "SERVER",
    "WORKSTATION": "WORKSTATION",
    "EXTERNAL_HOST": "EXTERNAL_SERVICE",
    "EXTERNAL_SERVICE": "EXTERNAL_SERVICE",
    "EXTERNAL SERVICE": "EXTERNAL_SERVICE",
    "UNKNOWN": "UNKNOWN",
}
# Parts of domain names that are not worth a look.
BENIGN_FRAGMENTS = [
    "microsoft",
    "windows",
    "office",
    "msn.com",
    "bing.com",
    "google",
    "gstatic",
    "googleapis",
    "cloudflare",
    "akamai",
    "azureedge",
    "adobe",
    "mozilla",
    "digicert",
    "msft",
    "live.com",
]


def words(items) -> Column:
    return F.array(*[F.lit(i) for i in items]) if items else F.array().cast("array<string>")


def labels(*pairs) -> Column:
    """Array of the labels whose condition holds, in the given order."""
    return F.array_compact(F.array(*[F.when(condition, label) for label, condition in pairs]))


def normalize_domain(value: Column) -> Column:
    without_scheme = F.regexp_replace(F.lower(F.trim(value)), "^.*?://", "")
    host = F.regexp_replace(F.split(without_scheme, "/")[0], r"^\.+|\.+$", "")
    return F.when(host != "", host)


def clean_nbns_name(value: Column) -> Column:
    name = F.trim(F.split(F.split(value, ",")[0], "<")[0])
    return F.when(name != "", name)


def clean_hostname(value: Column) -> Column:
    name = F.trim(F.split(value, "<")[0])
    return F.when((name != "") & ~F.upper(name).isin("WORKGROUP", "MSHOME"), name)


def normalize_role(role: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in ROLE_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.upper(role)), F.lit("UNKNOWN"))


def role_display(role: Column) -> Column:
    return F.initcap(F.replace(normalize_role(role), F.lit("_"), F.lit(" ")))


def investigative_domain(domain: Column) -> Column:
    text = F.regexp_replace(F.lower(domain), r"^\.+|\.+$", "")
    benign = F.lit(False)
    for fragment in BENIGN_FRAGMENTS:
        benign = benign | text.contains(fragment)
    return F.coalesce((text != "") & text.contains(".") & ~benign, F.lit(False))


def dedup_evidence(items: Column) -> Column:
    """Trimmed, non-empty, first of each spelling regardless of case, order kept."""
    cleaned = F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")
    folded = F.transform(cleaned, lambda x: F.lower(x))
    return F.filter(cleaned, lambda x, i: F.array_position(folded, F.lower(x)) == i + 1)


def ordered_distinct(items: Column) -> Column:
    return F.array_distinct(items)


def join_phrases(items: Column, empty: str) -> Column:
    """a / a and b / a, b, and c."""
    n = F.size(items)
    return (
        F.when(n == 0, F.lit(empty))
        .when(n == 1, F.try_element_at(items, F.lit(1)))
        .when(n == 2, F.array_join(items, " and "))
        .otherwise(
            F.concat(
                F.array_join(F.slice(items, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "),
                F.lit(", and "),
                F.try_element_at(items, F.lit(-1)),
            )
        )
    )
