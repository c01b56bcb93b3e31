import random

from palaver.operators import curate
from palaver.operators.detect import leader_clusters


def conv(values):
    return [("human" if k % 2 == 0 else "gpt", v) for k, v in enumerate(values)]


def corpus(spark, rows):
    return spark.createDataFrame(rows, "id string, conversations array<struct<from:string,value:string>>")


def packed(values, most, keep_tail=False):
    values = values[: len(values) - len(values) % 2]
    pairs = [len(values[k].split(" ")) + len(values[k + 1].split(" ")) + 12 for k in range(0, len(values), 2)]
    out, start, cur = [], 0, 0
    for i, c in enumerate(pairs):
        if cur + c > most:
            out.append((start, i))
            if i == len(pairs) - 1 and keep_tail:
                out.append((i, i + 1))
            start, cur = i, c
        elif i == len(pairs) - 1:
            out.append((start, i + 1))
        else:
            cur += c
    return sorted((2 * a, 2 * (b - a)) for a, b in out)


def test_packing_equals_the_fold(spark):
    rng = random.Random(2)
    convs = {f"c{k}": [" ".join("w" * rng.randint(1, 30)) for _ in range(rng.randint(1, 9))] for k in range(40)}
    for keep in (False, True):
        rows = curate.split_long(corpus(spark, [(k, conv(v)) for k, v in convs.items()]), 60, keep_tail=keep).collect()
        for k, v in convs.items():
            got = sorted((r.begin, len(r.conversations)) for r in rows if r.id.startswith(k + "_"))
            assert got == packed(v, 60, keep), (k, keep)


def test_greedy_dedup_equals_the_scan(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, *range(25)]), rng.choice([None, *range(25)])) for i in range(120)]
    seen_a, seen_b, want = set(), set(), []
    for i, a, b in rows:
        if (a is not None and a in seen_a) or (b is not None and b in seen_b):
            continue
        want.append(i)
        seen_a.add(a)
        seen_b.add(b)
    got = curate.greedy_dedup(spark.createDataFrame(rows, "o bigint, a bigint, b bigint"), "o", ("a", "b")).collect()
    assert sorted(r.o for r in got) == want


def test_greedy_dedup_decides_long_chains(spark):
    """Rows linked alternately by the two keys: every second one survives, to the last."""
    rows = [(i, (i + 1) // 2, 1000 + i // 2) for i in range(40)]
    df = spark.createDataFrame(rows, "o bigint, a bigint, b bigint")
    want = list(range(0, 40, 2))
    assert sorted(r.o for r in curate.greedy_dedup(df, "o", ("a", "b"), rounds=2).collect()) == want
    assert sorted(r.o for r in curate.greedy_dedup(df.limit(14), "o", ("a", "b"), rounds=2, scan_rows=0).collect()) == want[:7]
    assert curate.greedy_dedup(df.limit(0), "o", ("a", "b")).count() == 0


def test_leader_clusters_equal_the_scan(spark):
    rng = random.Random(5)
    rows = [(i % 3, i, [rng.uniform(-1, 1) for _ in range(3)]) for i in range(40)]

    def cos(a, b):
        return sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5

    want, leaders = {}, {}
    for g, i, v in rows:
        for j, u in leaders.setdefault(g, []):
            if cos(v, u) >= 0.6:
                want[i] = j
                break
        else:
            leaders[g].append((i, v))
            want[i] = i
    got = leader_clusters(spark.createDataFrame(rows, "g int, o int, v array<double>"), "g", "o", "v", 0.6).collect()
    assert {r.o: r.leader for r in got} == want


def test_clean_codes(spark):
    rows = [("ok", conv(["a question here", "an answer"])), ("one", conv(["x"])), ("lead", [("system", "s"), *conv(["a question here", "an answer"])]), ("tail", conv(["a question here", "an answer", "more"])), ("role", [("human", "a question here"), ("human", "again"), ("gpt", "x")]), ("word", conv(["who is ChatGPT and why", "an answer"])), ("short", conv(["a", "b"])), ("stop", conv(["a question here", "an answer", "next", ""])), ("none", None), ("empty", [])]
    got = {r.id: (r.code, len(r.conversations or [])) for r in curate.cleaned(corpus(spark, rows)).collect()}
    assert got["ok"] == (0, 2) and got["lead"] == (0, 2) and got["tail"] == (0, 2) and got["stop"] == (0, 2)
    assert got["one"][0] == got["short"][0] == got["none"][0] == got["empty"][0] == 1
    assert got["role"][0] == 2 and got["word"][0] == 3


def test_markdown():
    md = curate.to_markdown("<h2>T</h2><p>a <b>b</b> <a href='u'>l</a></p><ul><li>x</li><li>y</li></ul><pre>k = 1</pre>")
    assert "## T" in md and "**b**" in md and "[l](u)" in md and "* x" in md and "```\nk = 1\n```" in md
    assert curate.to_markdown(None) is None


def test_train_test_is_exact(spark):
    df = spark.range(1, 501)
    parts = {r.part: r["count"] for r in curate.train_test(df, "id", 0.3).groupBy("part").count().collect()}
    assert parts == {"train": 150, "test": 350}
