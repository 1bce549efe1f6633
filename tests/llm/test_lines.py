"""Line dedup against a direct count."""

from collections import Counter

from docketry.llm import line_dedup

BLANK = " \t\n\x0b\x0c\r"
LOWER = {c: c + 32 for c in range(65, 91)}


def direct(rows, min_docs, min_chars):
    key = lambda line: line.strip(BLANK).translate(LOWER)
    lines = [(i, (t or "").split("\n")) for i, t in rows]
    docs = Counter(k for _, ls in lines for k in {key(x) for x in ls})
    gone = {k for k, n in docs.items() if n >= min_docs and len(k) >= min_chars}
    out = []
    for i, ls in lines:
        left = [x for x in ls if key(x) not in gone]
        out.append((i, "\n".join(left), len(ls), len(ls) - len(left)))
    return sorted(out, key=str)


def result(df, **settings):
    out = line_dedup.remove_shared_lines(df, **settings)
    assert out.columns == ["doc_id", "kept_text", "n_lines", "n_dropped"]
    return sorted(map(tuple, out.collect()), key=str)


def test_documents(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    want = direct(rows, line_dedup.MIN_DOCS, line_dedup.MIN_CHARS)
    assert result(documents) == want
    assert result(documents, min_docs=2) == direct(rows, 2, 1)


def test_odd_rows(odd):
    """Nulls, empty and long texts, repeated rows, and columns named like internal ones."""
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert result(odd, min_docs=2) == direct(rows, 2, 1)
    assert result(odd, min_docs=2, min_chars=0) == direct(rows, 2, 0)


def test_keys_and_positions(spark):
    """Case and outer blanks do not tell keys apart, letters beyond A-Z do; gaps close and blank lines stay."""
    rows = [(2**53 + 1, "Menu\nkept one\n\n menu \t\nÄ\r"), (2**53 + 3, "MENU\x0b\nä\n\nlast"), (None, "x\nmEnU"), (None, "menu"),
            (7, ""), (7, None), (8, "\n\n"), (9, "menu \nm enu")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = result(df, min_docs=3)
    assert got == direct(rows, 3, 1)
    assert (2**53 + 1, "kept one\n\nÄ\r", 5, 2) in got and (None, "", 1, 1) in got


def test_long_text_and_hot_line(spark):
    """A line of every document and a text of very many lines."""
    rows = [(i, f"all rights reserved\nown {i}") for i in range(400)]
    rows.append((1000, "\n".join(f"line {i % 9000}" if i % 3 else "All Rights Reserved" for i in range(30_000))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df) == direct(rows, 10, 1)


def test_nothing(nothing):
    assert line_dedup.remove_shared_lines(nothing).count() == 0


def test_runs_on_columns_only(documents):
    plan = line_dedup.remove_shared_lines(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
