from urllib.parse import parse_qsl, urlencode, urljoin, urlparse, urlunparse

from pyspark.sql import functions as F

from pagesieve.functions import urls
from pagesieve.functions.addresses import ipv6_halves
from pagesieve.functions.globs import ONE_MORE_SEGMENT, PER_SEGMENT, compiled_rules, first_match, glob_match


def expected(ref, base):
    p = urlparse(urljoin(base, ref))
    path = p.path or "/"
    path = path if path == "/" else path.rstrip("/")
    kept = [(k, v) for k, v in parse_qsl(p.query, keep_blank_values=True) if k.lower() not in urls.TRACKING_PARAMS]
    return urlunparse((p.scheme.lower(), p.netloc.lower(), path, "", urlencode(kept), ""))


REFS = [
    "a", "/a/", "../a", "./a/./b", "../../x/", "?q=1", "#f", "", "//H.com/P", "HTTP://U:p@Host:80/A//b/?utm_source=1&B=2&B=3&c",
    "/a;v=1", "/a;v=1/b;w", "x?a=b c&d=%7E%2A*", "/für", "?GCLID=1&x=%zz", "/a/../b/..", "g?y/./x", "g#s/../x", "..", ".", "/..//c", "?a=1;b=2",
    "ftp://h/x", "a//b/c", "/%20x?y=+z",
]
BASES = ["http://h.com", "http://h.com/", "https://H.com/a/b/c?q=z#f", "https://h.com/a/b/"]


def test_normalisation_equals_the_standard_library_rule(spark):
    pairs = [(i, r, b) for i, (r, b) in enumerate((r, b) for r in REFS for b in BASES)]
    df = spark.createDataFrame(pairs, "i int, ref string, base string")
    df = urls.with_normalized_reference(urls.with_parts(df, "base", "b_"), "ref", "b_", "out")
    got = {r.i: r.out for r in df.select("i", "out").collect()}
    wrong = [(r, b, got[i], expected(r, b)) for i, r, b in pairs if got[i] != expected(r, b)]
    assert wrong == []


def test_broken_authority_is_null(spark):
    df = spark.createDataFrame([("http://[::1/x",), ("http://[::1]/x",)], "url string")
    assert [r.out for r in urls.with_normalized(df, "url", "out").collect()] == [None, "http://[::1]/x"]


def test_globs(spark):
    url = F.lit("https://h.com/food/meat?x=1")
    cases = {
        "plain path": (glob_match(url, "/food/*"), True),
        "star crosses segments": (glob_match(F.lit("https://h.com/food/a/b"), "/food/*"), True),
        "one segment": (glob_match(url, "/food/*", ONE_MORE_SEGMENT), True),
        "one segment, deeper": (glob_match(F.lit("https://h.com/food/a/b"), "/food/*", ONE_MORE_SEGMENT), False),
        "one segment, slash": (glob_match(F.lit("https://h.com/food/a/"), "/food/*", ONE_MORE_SEGMENT), True),
        "per segment": (glob_match(F.lit("https://h.com/c/x/index.html"), "/c/*/index.html", PER_SEGMENT), True),
        "per segment, count": (glob_match(F.lit("https://h.com/c/x/y/index.html"), "/c/*/index.html", PER_SEGMENT), False),
        "literal rule": (glob_match(F.lit("https://h.com/products/1"), "/products/", PER_SEGMENT), False),
        "class": (glob_match(F.lit("https://h.com/b9"), "/[!a]?"), True),
        "case": (glob_match(F.lit("https://h.com/A"), "/a"), False),
        "dot is literal": (glob_match(F.lit("https://h.com/axb"), "/a.b"), False),
    }
    row = spark.range(1).select(*[c.alias(n) for n, (c, _) in cases.items()]).first()
    assert {n: row[n] for n in cases} == {n: want for n, (_, want) in cases.items()}


def test_table_patterns_compile_like_literal_ones(spark):
    patterns = ["/food/*", "/c/*/index.html", "*page?2", "/[!x]*", "/a.b+c"]
    targets = ["https://h.com/food/meat", "https://h.com/c/q/index.html", "https://h.com/?page=2", "https://h.com/yes", "https://h.com/a.b+c"]
    rows = [(p, t) for p in patterns for t in targets]
    df = spark.createDataFrame(rows, "p string, t string")
    for flavour in ("plain", ONE_MORE_SEGMENT, PER_SEGMENT):
        held = df.select("p", "t", first_match(F.col("t"), compiled_rules(F.array("p"), flavour)).isNotNull().alias("hit"))
        got = {(r.p, r.t): r.hit for r in held.collect()}
        literal = spark.range(1).select(*[glob_match(F.lit(t), p, flavour).alias(str(i)) for i, (p, t) in enumerate(rows)]).first()
        assert [got[r] for r in rows] == [literal[str(i)] for i in range(len(rows))]


def test_address_literals(spark):
    """Both halves against the standard library, for every spelling, and what is no address."""
    import ipaddress
    import random

    rng, texts = random.Random(4), []
    for _ in range(300):
        value = ipaddress.IPv6Address(rng.getrandbits(128) & rng.choice([-1, 0xFFFF, 0xFFFF << 64, 0xFFFFFFFF, 0xFF << 112, 1 << 64]))
        texts += [str(value), value.exploded, value.exploded.upper()]
        quad = ".".join(str(rng.randrange(256)) for _ in range(4))
        texts += [f"::{quad}", f"::ffff:{quad}", f"64:ff9b::{quad}", f"1:2:3:4:5:6:{quad}"]
    texts += ["", ":", "::", ":::", "1", "1:2", "1::2::3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "::1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "g::", "12345::", "::1.2.3", "::1.2.3.256", "1.2.3.4", ":1::", "1::2:", "1:2:3:4:5:6:7:1.2.3.4", "::01.2.3.4"]
    want = {}
    for text in texts:
        try:
            want[text] = int(ipaddress.IPv6Address(text))
        except ValueError:
            want[text] = None
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", ipv6_halves(F.concat(F.lit("["), "t", F.lit("]"))).alias("h")).collect()
    got = {r.t: None if r.h is None else (r.h.hi % 2**64 << 64) + r.h.lo % 2**64 for r in rows}
    assert got == want


def test_address_reasons_follow_the_ranges(spark):
    """Reasons of addresses at the edges of every range, by the standard library's own tables."""
    import ipaddress

    from pagesieve.functions import addresses

    ranges = [b for n in dir(addresses) if n.startswith("IPV6_") for b in getattr(addresses, n)]
    values = {0}
    for block in ranges:
        network = ipaddress.IPv6Network(block)
        values |= {int(network[0]), int(network[-1]), max(int(network[0]) - 1, 0), min(int(network[-1]) + 1, 2**128 - 1)}
    signed = lambda x: x - 2**64 if x >> 63 else x
    rows = spark.createDataFrame([(str(ipaddress.IPv6Address(v)), signed(v >> 64), signed(v % 2**64)) for v in sorted(values)], "t string, hi long, lo long")
    got = {r.t: r.reason for r in rows.select("t", addresses.ipv6_reason(F.struct("hi", "lo")).alias("reason")).collect()}
    for text, reason in got.items():
        address = ipaddress.IPv6Address(text)
        if address.ipv4_mapped is not None or address in ipaddress.IPv6Network("3fff::/20"):  # newer than some libraries
            continue
        want = "LOOPBACK" if address.is_loopback else "LINK_LOCAL" if address.is_link_local else "MULTICAST" if address.is_multicast else "PRIVATE_ADDRESS" if address.is_private else "RESERVED" if address.is_reserved else None
        assert reason == want, text
