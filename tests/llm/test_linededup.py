from __future__ import annotations

import random

from calibra.llm import linededup


def plain(texts):
    """Expected texts by key: lines of two-line runs with an earlier place go, lines of first places stay."""
    places = {}
    split = {key: (texts[key] or "").split("\n") for key in texts}
    runs = {key: [(i, "\n".join(lines[i : i + 2])) for i in range(len(lines) - 1)] for key, lines in split.items()}
    for key in sorted(runs):
        for i, run in runs[key]:
            if run.encode().strip():
                places.setdefault(run, []).append((key, i))
    out = {}
    for key, text in texts.items():
        gone, first = set(), set()
        for i, run in runs[key]:
            found = places.get(run, [])
            if len(found) > 1:
                (first if found[0] == (key, i) else gone).update((i, i + 1))
        out[key] = None if text is None else "\n".join(x for i, x in enumerate(split[key]) if i not in gone - first)
    return out


def test_documents(documents, texts):
    rows = linededup.line_rows(documents).collect()
    want = plain(texts)
    assert {r["doc_id"]: r["text"] for r in rows} == want
    for r in rows:
        removed = texts[r["doc_id"]].count("\n") - r["text"].count("\n")
        assert r["n_removed"] >= removed and r["n_lines"] == texts[r["doc_id"]].count("\n") + 1
    assert sum(r["n_chunks"] for r in rows) > 0


def test_first_places_stay_whole(spark):
    """A run whose first place touches a removed run still stands somewhere."""
    texts = {0: "y w\nz w", 1: "x w\ny w\nz w", 2: "x w\ny w", 3: "q w\nq w\nq w\nq w\nq w"}
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in linededup.line_rows(docs).collect()}
    assert out == {0: "y w\nz w", 1: "x w\ny w", 2: "", 3: "q w\nq w"} == plain(texts)


def test_random_lines_against_the_plain_version(spark):
    draw = random.Random(3)
    texts = {i: "\n".join(draw.choice("abcdefgh ") for _ in range(draw.choice([0, 1, 2, 9, 30]))) for i in range(80)}
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in linededup.line_rows(docs).collect()}
    assert out == plain(texts)
    standing = {"\n".join(t.split("\n")[i : i + 2]) for t in out.values() for i in range(t.count("\n"))}
    runs = {"\n".join(t.split("\n")[i : i + 2]) for t in texts.values() for i in range(t.count("\n"))}
    assert {r for r in runs if r.strip()} <= standing


def test_shared_passage_goes_once(spark):
    draw = random.Random(5)
    run = [f"shared line {draw.random()}" for _ in range(40)]
    rows = [(i, "\n".join([f"own {i} {j}" for j in range(5)] + run + [f"end {i} {j}" for j in range(5)])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r for r in linededup.line_rows(docs).collect()}
    assert out[0]["text"] == rows[0][1] and out[0]["n_removed"] == 0
    assert all(out[i]["n_removed"] >= 25 for i in range(1, 300))
    assert all(f"own {i} 0" in out[i]["text"] for i in out)


def test_odd_rows(odd_docs):
    out = linededup.dedup_lines(odd_docs)
    assert out.columns == [*odd_docs.columns, "n_lines", "n_removed", "n_chunks"]
    rows = out.collect()
    assert len(rows) == odd_docs.count()
    assert [r["text"] for r in rows if r["doc_id"] == 0] == [None]
    named = odd_docs.withColumnRenamed("size", "n_lines")
    assert linededup.dedup_lines(named).columns[-3:] == ["own_n_lines", "n_removed", "n_chunks"]


def test_empty(no_docs):
    assert linededup.line_rows(no_docs).collect() == []


def test_every_repeated_run_goes_whole(spark):
    """Runs of one to six lines between own lines: from two lines on every copy but the first goes, to its last line."""
    draw = random.Random(8)
    runs = [[f"run {r} line {j}" for j in range(r % 6 + 1)] for r in range(36)]
    texts, want = {}, {}
    for i in range(40):
        picked, lines, left = draw.sample(range(36), 12), [], []
        for r in picked:
            own = [f"own {i} {r} {j}" for j in range(2)]
            first = not any(runs[r][0] in texts[k].split("\n") for k in range(i))
            lines += own + runs[r]
            left += own + (runs[r] if first or len(runs[r]) < 2 else [])
        texts[i], want[i] = "\n".join(lines), "\n".join(left)
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    out = {r["doc_id"]: r for r in linededup.line_rows(docs).collect()}
    assert {i: r["text"] for i, r in out.items()} == want
    for i, r in out.items():
        assert r["n_removed"] == len(texts[i].split("\n")) - len(want[i].split("\n"))
    assert sum(r["n_chunks"] for r in out.values()) == sum(r in texts[i].split("\n") for i in texts for r in [x[0] for x in runs if len(x) > 1]) - sum(
        any(x[0] in t.split("\n") for t in texts.values()) for x in runs if len(x) > 1
    )
