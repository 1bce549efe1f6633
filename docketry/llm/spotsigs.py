"""Document fingerprints by SpotSigs (Theobald, Siddharth and Paepcke, 2008), in column expressions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketry.llm.common import landed, view

CHAIN = 2  # content words of a signature
STRETCH = 8  # content words after which a chain starts without a common word
THRESHOLD = 0.8
ID_BYTES = 1 << 18  # ids ordered by one task: about so many rows
NO_ID = -(1 << 63)  # stands for a null id inside

# Common words (articles, prepositions, conjunctions, auxiliaries) that start a chain.
ANCHORS = {
    "English": "a an and are as at by for from in is it of on or that the this to was were will with",
    "German": "als am auf aus bei das dem den der des die durch ein eine für im ist mit nicht sich und von war zu zum",
    "French": "au aux avec ce dans des du en est et il la le les ne par pas pour qui que sur un une",
    "Spanish": "al como con de del el en es las los más no por se su una y",
}


def _anchor_pattern() -> str:
    """Common words grouped by first letter, so that a word is tried against few of them."""
    words = sorted({w for line in ANCHORS.values() for w in line.split()})
    groups = [f"{c}(?:{'|'.join(w[1:] for w in words if w[0] == c)})" for c in sorted({w[0] for w in words})]
    return f" (?=(?:{'|'.join(groups)}) )"


def pieces(text: Column | str) -> Column:
    """A text as pieces: ``~`` and a common word, or neither, and the content words up to the next piece."""
    text = F.col(text) if isinstance(text, str) else text
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    marked = F.regexp_replace(F.concat(F.lit(" "), F.trim(plain), F.lit(" ")), _anchor_pattern(), " ~")
    content = "[^ ~][^ ]*"
    stretch = f"~[^ ]+(?: {content}){{0,{STRETCH}}}|{content}(?: {content}){{0,{STRETCH - 1}}}"
    return F.regexp_extract_all(marked, F.lit(stretch), F.lit(0))


def chains(cut: str) -> Column:
    """The signatures of a column of pieces as a sorted array of 32-bit hashes."""
    following = F.slice(cut, 2, F.greatest(F.size(cut), F.lit(1)))

    def chain(piece: Column, after: Column) -> Column:
        words = F.rtrim(F.concat_ws(" ", piece, F.regexp_replace(after, "^~[^ ]+ ?", "")))
        head = F.when(piece.startswith("~"), F.substring_index(words, " ", CHAIN + 1)).otherwise(
            F.substring_index(words, " ", CHAIN))
        return F.when(piece.isNotNull(), F.hash(head))

    return F.array_sort(F.array_distinct(F.filter(F.zip_with(cut, following, chain), lambda h: h.isNotNull())))


def with_signatures(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add the set of a text's spot signatures; empty for a text without words.

    A signature is a common word and the CHAIN content words that follow it,
    reaching over one more common word where needed. A stretch of STRETCH
    content words without a common word starts a chain of its own, so texts
    without common words (tables, lists) have signatures too. Case and
    punctuation do not count. The pieces are a column of their own, so that
    the text is cut once.
    """
    cut = f"__{out}"
    return df.withColumn(cut, pieces(text)).withColumn(out, chains(cut)).drop(cut)


def fingerprint(sigs: Column | str) -> Column:
    """The sorted signatures as text."""
    return F.array_join((F.col(sigs) if isinstance(sigs, str) else sigs).cast("array<string>"), " ")


def jaccard(a: Column, b: Column) -> Column:
    """Likeness of two signature sets, 0 to 1; two empty sets are alike."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def length_partition(n: Column, threshold: float = THRESHOLD) -> Column:
    """Sets this far apart in length cannot reach the threshold: only equal or adjacent partitions can."""
    return F.when(n > 0, F.floor(F.log(n.cast("double")) / F.lit(-math.log(threshold)) + 1e-9)).otherwise(-1).cast("int")


def _neighbours(rows: DataFrame) -> DataFrame:
    """``(id, prev, prev_n)``: the document before each in ascending id, and its length; before the first stands the last.

    Ids are ordered by ranges; only the ends of each range meet in one small table.
    """
    ids = rows.groupBy("id").agg(F.max("n").alias("n"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = landed(ids.repartitionByRange(n, "id").select("id", "n", F.spark_partition_id().alias("range")), "ids")
    inside = Window.partitionBy("range").orderBy("id")
    chained = ids.select("id", "range", F.lag("id").over(inside).alias("prev"), F.lag("n").over(inside).alias("prev_n"))
    ends = ids.groupBy("range").agg(F.max("id").alias("last"), F.max_by("n", "id").alias("last_n"))
    order = Window.orderBy("range")  # one row per range
    back = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("range", F.coalesce(F.lag("last").over(order), F.last("last").over(back)).alias("last"),
                       F.coalesce(F.lag("last_n").over(order), F.last("last_n").over(back)).alias("last_n"))
    return chained.join(ends, "range").select(
        "id", F.coalesce("prev", "last").alias("prev"), F.coalesce("prev_n", "last_n").alias("prev_n"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness, for every row.

    ``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, n_signatures, length_partition)``. The edited text
    has its last quarter of code points replaced by as many (or all) of the
    first of the next document. Null texts are empty; a null id comes before
    all others; rows of the same id count as one document when a next document
    is looked for, and all stay; one document is its own next; an empty table
    gives an empty result.
    """
    # both joins below read these very columns by id, so that the texts are exchanged once
    rows = view(docs, doc_id=id_col, text=text_col).select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    order = landed(_neighbours(rows.select("id", F.length("text").alias("n"))), "order")
    ahead = rows.join(order, "id").dropDuplicates(["id"]).select(
        "prev", "text", F.expr("substring(text, 1, CAST(floor(prev_n / 4) AS INT))").alias("head"))
    ahead = with_signatures(ahead, "text", "next_sigs").select(F.col("prev").alias("id"), "head", "next_sigs")
    n = F.length("text")
    edited = F.concat(F.expr("substring(text, 1, length(text) - CAST(floor(length(text) / 4) AS INT))"), F.col("head"))
    both = with_signatures(rows.join(ahead, "id"), "text", "sigs").select(
        F.nullif("id", F.lit(NO_ID)).alias("doc_id"), n.cast("long").alias("n_chars"), edited.alias("edited"), "next_sigs", "sigs")
    both = with_signatures(both, "edited", "edited_sigs").withColumn("edited_sha256", F.sha2("edited", 256))
    return both.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint("sigs").alias("fingerprint"),
        fingerprint("edited_sigs").alias("edited_fingerprint"),
        jaccard(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        jaccard(F.col("sigs"), F.col("next_sigs")).alias("near_next"), F.size("sigs").alias("n_signatures"),
        length_partition(F.size("sigs")).alias("length_partition"))


def near_pairs(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id",
               text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(members, pairs)``: ``(doc_id, class_id)`` of every row, and ``(a, b, likeness)`` between classes, a < b.

    A class holds the texts of one signature set, named by its smallest id.
    Classes meet if they share one of their rarest signatures (as many as any
    pair above the threshold must share) in the same or an adjacent length
    partition; the length bound prunes again before the exact Jaccard. Sets
    without signatures form one class and pair with none.
    """
    rows = with_signatures(view(docs, doc_id=id_col, text=text_col), "text", "sigs").select("doc_id", "sigs")
    rows = landed(rows.withColumn("set", F.sha2(fingerprint("sigs"), 256)), "signatures")
    sets = landed(rows.groupBy("set").agg(F.min("doc_id").alias("class_id"), F.first("sigs").alias("sigs")), "sets")
    members = rows.join(sets.select("set", "class_id"), "set").select("doc_id", "class_id")
    each = sets.select("class_id", F.size("sigs").alias("n"), F.explode("sigs").alias("sig"))
    counts = each.groupBy("sig").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy("class_id").orderBy("df", "sig"))
    prefix = each.join(counts, "sig").withColumn("rank", rank).filter(
        F.col("rank") <= F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9) + 1)
    part = length_partition(F.col("n"), threshold)
    prefix = prefix.select("class_id", "n", "sig", part.alias("part"))
    low = prefix.select(F.col("class_id").alias("a"), F.col("n").alias("na"), "sig",
                        F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    high = prefix.select(F.col("class_id").alias("b"), F.col("n").alias("nb"), "sig", "part")
    fit = (F.col("na") >= F.col("nb") * threshold - 1e-9) & (
        (F.col("na") < F.col("nb")) | (F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    found = low.join(high, ["sig", "part"]).filter(fit).select("a", "b").distinct()
    left = sets.select(F.col("class_id").alias("a"), F.col("sigs").alias("sa"))
    right = sets.select(F.col("class_id").alias("b"), F.col("sigs").alias("sb"))
    likeness = jaccard(F.col("sa"), F.col("sb"))
    pairs = found.join(left, "a").join(right, "b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), likeness.alias("likeness"))
    return members, pairs.filter(F.col("likeness") >= threshold)
