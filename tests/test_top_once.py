from meshlens.operators import top


def test_top_reads_its_rows_once(spark):
    """Rows with a hundred keys go through one shuffle of groups; others and total were read and summed from all rows again."""
    rows = [(i % 100 or None, i, i % 7 or None, i * 3 + 480, i * 3 + 520) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, v long, w long, start long, stop long")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    aggregates = {"hi": ("max", "w"), "lo": ("min", "w"), "all": ("sum", "w"), "size": ("avg", "w")}
    out = {(r.kind, r.k): (r.sort_value, r.hi, r.lo, r["all"], r["size"]) for r in top.top(df.mapInArrow(count, df.schema), ["k"], aggregates, "v", 5, 500, 9490).collect()}
    assert seen.value == len(rows)
    clip = lambda r: _clip(r[1], r[3], r[4])
    of = lambda some: (sum(map(clip, some)), max(w := [r[2] for r in some if r[2]]), min(w), sum(w), sum(w) // len(w))
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    best = sorted(by, key=lambda k: (-sum(map(clip, by[k])), k is not None, k or 0))[:5]
    want = {("key", k): of(by[k]) for k in best} | {("others", None): of([r for r in rows if r[0] not in best]), ("total", None): of(rows)}
    assert out == want


def _clip(v, a, b):
    first = v * (b - 500) // max(b - a, 1) if a < 500 else v
    return first * (9490 - max(a, 500)) // max(b - max(a, 500), 1) if b > 9490 else first
