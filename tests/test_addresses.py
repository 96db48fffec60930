"""Address ranges by expressions against the standard library's addresses."""

import ipaddress
import random

from pyspark.sql import functions as F

from jobloom.functions import text as X
from jobloom.operators import gates as G
from jobloom.plans.queries import QUERIES


def forms(a):
    """The ways to write an address."""
    yield str(a)
    if a.version == 6:
        yield a.exploded
        yield str(a).upper()
        yield f"{a}%eth0"
        low = ipaddress.ip_address(int(a) & 0xFFFFFFFF)
        yield f"{':'.join(a.exploded.split(':')[:6])}:{low}"
        if int(a) >> 32 == 0xFFFF:
            yield f"::ffff:{low}"


def test_addresses_equal_the_library(spark):
    rng = random.Random(5)
    ranges = [f"{first}/{bits}" for first, bits in G.CLOSED_V4] + [*G.OPEN_V4, *G.CLOSED_V6, *G.OPEN_V6, *X.NAT64_RANGES, "::ffff:0:0/96", "fc00::/7", "fe80::/10", "ff00::/8", "2000::/3"]
    picked = set()
    for r in map(ipaddress.ip_network, ranges):
        low, high, top = int(r.network_address), int(r.broadcast_address), (1 << r.max_prefixlen) - 1
        for n in (low - 1, low, low + 1, high - 1, high, high + 1, rng.randint(low, high)):
            if 0 <= n <= top:
                picked.add(ipaddress.IPv4Address(n) if r.version == 4 else ipaddress.IPv6Address(n))
    for base in (0xFFFF << 32, 0x64FF9B << 96, 0x64FF9B0001 << 80):
        picked |= {ipaddress.IPv6Address(base | int(a)) for a in list(picked) if a.version == 4}
    picked |= {ipaddress.IPv6Address(rng.getrandbits(128)) for _ in range(300)} | {ipaddress.IPv6Address((0x2001 << 112) | rng.getrandbits(112)) for _ in range(200)}
    good = sorted({f for a in picked for f in forms(a)})
    bad = [
        None, "", ":", "::", ":::", "1::2::3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7::8", "1::2:3:4:5:6:7:8", "::1:2:3:4:5:6:7:8", "12345::", "g::", "::1%", "::1%a%b", "%a", "::1 ", "::1\n", "1:", ":1", "1:2:3:4:5:6:7:", "::ffff:1.2.3",
        "::ffff:1.2.3.256", "::ffff:01.2.3.4", "::1.2.3.4:5", "1.2.3.4", "01.2.3.4", "1.2.3", "1.2.3.4.5", "1.2.3.4\n", "::/64", "1:2:3:4:5:6:7:1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "a:" * 5000, "1" * 100_000,
    ]
    rows = spark.createDataFrame([(v,) for v in good + bad], "ip string").repartition(4)
    got = rows.select("ip", G.closed_address(F.col("ip")).alias("jvm"), X.blocked_v6("ip").alias("library")).collect()
    assert [r for r in got if r["jvm"] != r["library"]] == [] and len(got) == len(good) + len(bad)
    assert {True, False, None} == {r["jvm"] for r in got}


def test_no_python_in_the_plan(spark):
    for name in ("q34", "q46"):
        assert "Python" not in QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_an_address_is_read_once(spark):
    """An address's number is computed once, however many ranges it is compared with, and digits don't go through Unicode's lower case."""
    plan = QUERIES["q46"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("conv(") == 1 and "lower(" not in plan
