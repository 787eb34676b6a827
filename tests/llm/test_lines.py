import random

from tidewright.llm.lines import LENGTH, dedup_lines, fingerprints


def brute(rows, length=LENGTH):
    """All runs of length bytes or more, whatever their lines, that occur earlier."""
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        lines = [] if t is None else t.split("\n")
        sizes, gone = [len(x.encode()) + 1 for x in lines], set()
        for i in range(len(lines)):
            size = 0
            for j in range(i, len(lines)):
                size += sizes[j]
                if size >= length:
                    k = "\n".join(lines[i : j + 1])
                    if k in seen:
                        gone |= set(range(i, j + 1))
                    seen.add(k)
                    if j - i > 60:
                        break
        runs = sum(1 for i in gone if i - 1 not in gone)
        out.append((d, len(lines), len(gone), runs, None if t is None else "\n".join(x for i, x in enumerate(lines) if i not in gone)))
    return sorted(out, key=repr)


def test_same_as_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in dedup_lines(docs).collect()), key=repr)
    assert got == brute(rows) and sum(r[2] for r in got) > 10


def test_edge_cases(spark):
    rng = random.Random(1)
    long = " ".join(f"w{i}" for i in range(129))
    rows = [(1, None), (2, ""), (3, "a\nb\nc"), (4, "a\nb\nc\nd"), (5, "x\na\nb\nc"), (6, "\n" * 60), (7, "q\n" * 200), (8, "a\nb"), (9, long), (10, long), (11, f"a\n{long}\nb"), (12, "é" * 30 + "\nz"), (13, "x\n" + "é" * 30), (None, long), (14, "z" * 39), (15, "z" * 39), (16, "z" * 38), (17, "z" * 38), (18, "y" * 200_000), (19, "y" * 200_000)]
    rows += [(20 + i, "\n".join(rng.choice("abc") * rng.choice((0, 1, 2, 9)) for _ in range(rng.randint(0, 40)))) for i in range(60)]
    docs = spark.createDataFrame([(*r, 0, "h") for r in rows], "doc_id long, text string, d int, runs string")
    for length in (1, 12, 40):
        assert sorted((tuple(r) for r in dedup_lines(docs, length=length).collect()), key=repr) == brute(rows, length)
    kept = {r.doc_id: r.kept for r in dedup_lines(docs).collect()}
    assert kept[9] == long and kept[10] == "" and kept[11] == "a\nb" and kept[None] == "" and kept[15] == "" and kept[17] == "z" * 38
    assert dedup_lines(docs.limit(0)).collect() == []
    twice = spark.createDataFrame([(1, long), (1, long)], "doc_id long, text string")
    assert [r.n_removed for r in dedup_lines(twice).collect()] == [0, 0]


def test_equal_runs_share_a_selected_line(spark):
    rng = random.Random(3)
    shared = [rng.choice("abcd") * rng.randint(0, 6) for _ in range(60)]
    texts = {d: "\n".join([*("x" * rng.randint(0, 9) for _ in range(d)), *shared, *("y" * rng.randint(0, 9) for _ in range(7))]) for d in (3, 11)}
    rows = spark.createDataFrame([(d, 0, t) for d, t in texts.items()], "d long, t long, text string")
    picked = {d: {r["at"] - d: r["print"] for r in fingerprints(rows, 12).where(f"d = {d}").collect()} for d in texts}
    for a in range(len(shared)):
        b = next((b for b in range(a, len(shared)) if sum(len(x) + 1 for x in shared[a : b + 1]) >= 12), None)
        if b is not None:
            assert any(picked[3].get(p) is not None and picked[3].get(p) == picked[11].get(p) for p in range(a, b + 1))
    assert len(picked[3]) < 60  # fewer than there are lines
