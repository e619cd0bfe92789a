"""Common table expressions by name; `closure` puts the needed ones in order."""

import re

CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql


def _needs(sql: str) -> list[str]:
    """Tables that stand where a table may: words after FROM, JOIN or a comma, outside of quoted texts."""
    found = re.findall(r"(?:\bFROM|\bJOIN|,)\s+([a-z_0-9]+)\b", re.sub(r"'[^']*'", "''", sql))
    return [w for w in dict.fromkeys(found) if w in CTES]


def closure(sql: str) -> str:
    """`sql` preceded by a WITH clause that holds all CTEs it needs."""
    order: list[str] = []

    def visit(name: str, trail: tuple) -> None:
        if name in order or name in trail:
            return
        for need in _needs(CTES[name]):
            if need != name:
                visit(need, (*trail, name))
        order.append(name)

    for need in _needs(sql):
        visit(need, ())
    if not order:
        return sql
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n].strip()})" for n in order) + "\n" + sql


def r(x: str, digits: int) -> str:
    return f"(floor(({x}) * 1e{digits} + 0.5e0) / 1e{digits})"


def ratio(a: str, b: str) -> str:
    return f"(CASE WHEN {b} <= 0 THEN 0e0 ELSE {r(f'({a}) / ({b})', 4)} END)"


def sc(x: str, digits: int) -> str:
    return f"cast(floor(({x}) * 1e{digits} + 0.5e0) AS bigint)"


def lst(*pairs: tuple[str, str]) -> str:
    """List of the labels whose condition holds."""
    items = ", ".join(f"CASE WHEN {c} THEN '{label}' END" for label, c in pairs)
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


def ipnum(ip: str) -> str:
    p = f"string_split({ip}, '.')"
    return f"(try_cast({p}[1] AS bigint)*16777216 + try_cast({p}[2] AS bigint)*65536 + try_cast({p}[3] AS bigint)*256 + try_cast({p}[4] AS bigint))"


def _cidr(cidr: str) -> tuple[int, int]:
    base, bits = cidr.split("/")
    a, b, c, d = map(int, base.split("."))
    low = a * 16777216 + b * 65536 + c * 256 + d
    return low, low + 2 ** (32 - int(bits)) - 1


def within(num: str, *cidrs: str) -> str:
    return "(" + " OR ".join("{} BETWEEN {} AND {}".format(num, *_cidr(c)) for c in cidrs) + ")"


def ipclass(ip: str) -> str:
    n = ipnum(ip)
    return f"""(CASE WHEN {n} IS NULL THEN 'error' WHEN {ip} LIKE '127.%' THEN 'loopback' WHEN {ip} LIKE '169.254.%' THEN 'link_local'
      WHEN {ip} = '255.255.255.255' THEN 'broadcast' WHEN {ip} LIKE '0.%' THEN 'this_network'
      WHEN {within(n, '224.0.0.0/4')} THEN 'multicast' WHEN {within(n, '240.0.0.0/4')} THEN 'reserved'
      WHEN {within(n, '10.0.0.0/8', '172.16.0.0/12', '192.168.0.0/16')} THEN 'internal' ELSE 'external' END)"""


def private(ip: str) -> str:
    n = ipnum(ip)
    nets = within(
        n, "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24",
        "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4",
    )
    return f"({nets} AND {ip} NOT IN ('192.0.0.9', '192.0.0.10'))"


def noninv(ip: str) -> str:
    return f"({within(ipnum(ip), '224.0.0.0/4')} OR {ip} IN ('0.0.0.0', '255.255.255.255') OR {ip} LIKE '%.255')"


def cloud(ip: str) -> str:
    return within(ipnum(ip), "13.64.0.0/11", "20.0.0.0/8", "40.64.0.0/10", "52.224.0.0/11", "104.208.0.0/13", "150.171.0.0/16")


def direction(s: str, d: str) -> str:
    """s and d are class expressions."""
    return f"""(CASE WHEN {s} = 'error' OR {d} = 'error' THEN 'error' WHEN {d} = 'broadcast' THEN 'broadcast'
      WHEN {d} = 'multicast' THEN 'multicast' WHEN {s} = 'loopback' OR {d} = 'loopback' THEN 'loopback'
      WHEN {s} = 'internal' AND {d} = 'internal' THEN 'internal' WHEN {s} = 'external' AND {d} = 'external' THEN 'external'
      WHEN {s} = 'internal' AND {d} = 'external' THEN 'outbound' WHEN {s} = 'external' AND {d} = 'internal' THEN 'inbound'
      ELSE 'unknown' END)"""


def digest(value: str, table: str) -> str:
    """Values of equal leading three digits are digested together, then the digests."""
    return f"""(SELECT sha256(string_agg(part, '|' ORDER BY head)) FROM (SELECT substr({value}, 1, 3) AS head, sha256(string_agg({value}, '|' ORDER BY {value})) AS part FROM {table} GROUP BY 1))"""


def iso(us: str) -> str:
    ts = f"make_timestamp({us})"
    return f"""(CASE WHEN {us} % 1000000 = 0 THEN strftime({ts}, '%Y-%m-%dT%H:%M:%SZ') ELSE strftime({ts}, '%Y-%m-%dT%H:%M:%S.%fZ') END)"""


def graded(score: str, conf: str, high: int, medium: int) -> str:
    return f"(CASE WHEN {score}*{conf} >= {high}e0 THEN 'high' WHEN {score}*{conf} >= {medium}e0 THEN 'medium' WHEN {score} > 0 THEN 'low' ELSE 'informational' END)"


def color(score: str, conf: str, high: int, medium: int) -> str:
    return f"(CASE WHEN {score}*{conf} >= {high}e0 THEN '#d95f3d' WHEN {score}*{conf} >= {medium}e0 THEN '#ffb347' WHEN {score} > 0 THEN '#f0d878' ELSE '#7aa6c2' END)"


def evsev(x: str) -> str:
    return f"(CASE WHEN {x} >= 90 THEN 'CRITICAL' WHEN {x} >= 70 THEN 'HIGH' WHEN {x} >= 40 THEN 'MEDIUM' WHEN {x} > 0 THEN 'LOW' ELSE 'INFO' END)"
