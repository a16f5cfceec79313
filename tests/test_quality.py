import itertools
import random

from pagesieve.operators.quality import duplicate_columns


def test_duplicate_columns_of_wide_tables(spark):
    """Pairs equal those of comparing all columns; the plan grows with the columns, not with their pairs."""
    rng, n = random.Random(2), 120
    source = [rng.randrange(12) for _ in range(n)]  # columns of one source are alike but for some cells
    rows = []
    for i in range(60):
        values = [rng.choice(["", None, "x", f"v{rng.randrange(50)}"]) for _ in range(12)]
        row = [i % 4 if i % 5 else None]
        for c in range(n):
            v = values[source[c]]
            v = v if v is None else f" {v}\u00a0" if c % 3 == 0 else v
            row.append("odd" if c % 17 == 0 and i % 4 == 1 and i % 8 == c % 8 else None if source[c] == 0 else v)
        rows.append(row)
    fields = [f"c.{c}" for c in range(n)]
    df = spark.createDataFrame(rows, "run long, " + ", ".join(f"`{f}` string" for f in fields))
    got = {(r.run, r.a, r.b) for r in duplicate_columns(df, ["run"], fields).collect()}
    want, strip = set(), lambda v: v if v is None else v.strip()
    for run in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == run]
        for a, b in itertools.combinations(range(n), 2):
            if all(strip(r[a + 1]) == strip(r[b + 1]) for r in own) and any(strip(r[a + 1]) for r in own):
                want.add((run, fields[a], fields[b]))
    assert got == want and len(want) > 500
    size = lambda k: len(duplicate_columns(df, ["run"], fields[:k])._jdf.queryExecution().analyzed().toString())
    assert size(120) < 4 * size(30)
    assert duplicate_columns(df.limit(0), ["run"], fields).count() == 0
