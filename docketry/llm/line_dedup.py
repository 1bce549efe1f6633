"""Line dedup: lines that many documents share go everywhere, the rest is put together again by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import ascii_lower, begin, landed, view

MIN_DOCS = 10  # documents a line's key stands in before its lines go
MIN_CHARS = 1  # code points of a key at least
# The blanks stripped from both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"


def line_keys(text: Column | str) -> Column:
    """The key of every line of a text by position: blanks off both ends, A-Z in lower case."""
    return F.transform(F.split(text, "\n", -1), lambda line: ascii_lower(F.btrim(line, F.lit(BLANKS))))


def _digest(key: Column) -> Column:
    """128 bits of a key, as two longs."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2"))


def shared_lines(rows: DataFrame, min_docs: int, min_chars: int) -> DataFrame:
    """``(h1, h2)`` of every key that stands in at least so many rows of ``text``.

    A row gives each of its keys once, so that counting rows counts documents
    and the counts combine before the exchange, however frequent a line is.
    """
    keys = F.filter(F.array_distinct(line_keys("text")), lambda k: F.length(k) >= min_chars)
    hashed = rows.select(F.explode(keys).alias("key")).select(_digest(F.col("key")).alias("h")).select("h.*")
    return hashed.groupBy("h1", "h2").agg(F.count("*").alias("docs")).filter(F.col("docs") >= min_docs).drop("docs")


def remove_shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(doc_id, kept_text, n_lines, n_dropped)`` of every row.

    Lines end at line feeds; a line goes if its key has ``min_chars`` code
    points and stands in ``min_docs`` documents, in every document it stands in.
    The other lines stay to the letter, joined by line feeds; if none stays the
    text is empty. A null or empty text is one empty line. Every row is a
    document of its own in the counts, also a repeated row or one whose id is
    null or shared; extra columns are not looked at; an empty table gives an
    empty result.

    Texts are exchanged once, to meet the positions of their dropped lines; the
    keys' digests are exchanged as counts of a task, and where the shared keys
    are too many for Spark's own broadcast limit, once more as rows, which
    adaptive execution splits where a line is frequent.
    """
    begin(docs)
    rows = view(docs, doc_id=id_col, text=text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    shared = landed(shared_lines(rows, min_docs, min_chars), "shared-lines")
    owner = [F.xxhash64("doc_id", "text").alias("t1"), F.xxhash64(F.lit("row"), "text", "doc_id").alias("t2")]
    placed = rows.select(*owner, F.posexplode(line_keys("text")).alias("pos", "key"))
    placed = placed.filter(F.length("key") >= min_chars).select("t1", "t2", "pos", _digest(F.col("key")).alias("h"))
    gone = placed.select("t1", "t2", "pos", "h.*").join(shared, ["h1", "h2"], "left_semi")
    gone = gone.groupBy("t1", "t2").agg(F.collect_set("pos").alias("gone"))
    dropped = F.coalesce("gone", F.array().cast("array<int>"))
    cut = rows.select("doc_id", "text", *owner).join(gone, ["t1", "t2"], "left").select("doc_id", "text", dropped.alias("gone"))

    def kept(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
        return F.struct(F.array_join(F.transform(left, lambda i: lines[i]), "\n").alias("kept_text"),
                        F.size(lines).cast("long").alias("n_lines"))

    # one element, so that the text is split once and the lines are a variable inside
    out = cut.select("doc_id", "gone", F.transform(F.array(F.split("text", "\n", -1)), kept)[0].alias("out"))
    return out.select("doc_id", "out.*", F.size("gone").cast("long").alias("n_dropped"))
