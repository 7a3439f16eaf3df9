import random
from collections import defaultdict

from meridia.llm import line_dedup as L
from meridia.llm.line_dedup import cut_lines, line_dedup

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
key = lambda line: line.strip(" \t\n\v\f\r").translate(LOW)


def brute(rows, min_chars, min_docs):
    holders = defaultdict(list)
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= min_chars:
                holders[k].append(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(holders.get(key(x), ())) < min_docs or max((h for h in holders[key(x)] if h is not None), default=None) == i]
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=str)


def test_random_documents(spark):
    rng = random.Random(3)
    pool = [f"line number {i} é" for i in range(30)] + ["short", "", "  LINE number 3 É ", " Line Number 3 é\t"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 9)))) for i in range(300)]
    rows += [(None, "line number 1 é\nline number 1 é"), (500, None), (501, "\n\n"), (502, "\n".join(["line number 2 é"] * 3000 + ["end"])), (503, "y" * 200000)]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, h int")
    for batches in (1, 2, 5):
        got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup(df, 12, 3, batches).collect()), key=str)
        assert got == brute(rows, 12, 3)


def test_empty(spark):
    assert line_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_ids_of_any_ordered_type(spark):
    rng = random.Random(8)
    rows = [(f"id-{i:03}", "\n".join(f"a common line {rng.randint(0, 20)}" for _ in range(5))) for i in range(100)]
    got = sorted(map(tuple, line_dedup(spark.createDataFrame(rows, "doc_id string, text string"), 12, 3).collect()), key=str)
    assert got == brute(rows, 12, 3)
    many = sorted(map(tuple, line_dedup(spark.createDataFrame(rows, "doc_id string, text string"), 12, 3, batches=1, batch_rows=20).collect()), key=str)
    assert many == got


def test_the_shuffled_way_gives_the_same(spark, monkeypatch):
    rows = [(i, "\n".join(f"a common line {(i * k) % 7}" for k in range(5))) for i in range(60)]
    monkeypatch.setattr(L, "BROADCAST_BYTES", -1)
    got = sorted(map(tuple, line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 12, 3).collect()), key=str)
    assert got == brute(rows, 12, 3)


def test_runs_that_stay_in_a_folder(spark, tmp_path):
    """Calls with parts of a table, in any order of ids, come to what one call with all of it gives."""
    rng = random.Random(9)
    rows = [(i, "\n".join(f"a common line {rng.randint(0, 40)}" for _ in range(rng.randint(0, 4)))) for i in range(150)]
    for n, order in enumerate((sorted(rows), sorted(rows, reverse=True), rng.sample(rows, len(rows)))):
        folder, seen = f"file://{tmp_path}/{n}", []
        for k in range(0, 150, 50):
            part = order[k : k + 50]
            seen += part
            got = sorted(map(tuple, line_dedup(spark.createDataFrame(part, "doc_id long, text string"), 12, 3, batches=2, folder=folder).collect()), key=str)
            want = brute(seen, 12, 3)
            assert got == [r for r in want if r[0] in {i for i, _ in part}]
        again = cut_lines(spark.createDataFrame(rows, "doc_id long, text string"), folder, 12, 3)
        assert sorted(map(tuple, again.collect()), key=str) == brute(rows, 12, 3)
