"""Spelling variants: vocabulary acceptor, one-edit transducer and the acceptor again, enumerated by initial state."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import ascii_lower, begin, landed, parts_for, view

# What a word is, and which occurrences lose a letter.
RUN = r"[A-Za-zÀ-ÿ]+"
LOSES = 199
MIN_CHARS = 6
MIN_COUNT = 5
TIMES = 5  # a form is so many times as frequent as its word, at least
GROUP = 1 << 16  # words that one acceptor is built over, at most


def vocabulary(rows: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """``(word, n)`` of all words of ``text`` long and frequent enough; counts combine before the exchange."""
    runs = rows.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("own"),
                       F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.select("own", ascii_lower(F.col("run")).alias("run"))
    h = F.crc32(F.concat("own", F.lit(":"), F.col("run")).cast("binary"))
    runs = runs.select("run", h.alias("h"))
    at = F.pmod("h", F.length("run").cast("long")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % LOSES == 0, cut).otherwise(F.col("run")).alias("word"))
    words = words.filter(F.length("word") >= min_chars)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def acceptor(words: list[str]) -> tuple[int, list[tuple[bool, tuple[tuple[str, int], ...]]]]:
    """Minimal acyclic acceptor of sorted distinct words: its initial state, and of every state (final, edges).

    A state is closed when no later word can pass through it; closed states
    with the same finality and edges are one.
    """
    known: dict[tuple, int] = {}
    states: list[tuple] = []
    opened: list[list] = [[False, []]]  # the states along the last word
    last = ""

    def close(depth: int) -> None:
        while len(opened) > depth + 1:
            final, edges = opened.pop()
            state = (final, tuple(edges))
            number = known.setdefault(state, len(states))
            if number == len(states):
                states.append(state)
            opened[-1][1].append((last[len(opened) - 1], number))

    for word in words:
        shared = 0
        while shared < min(len(word), len(last)) and word[shared] == last[shared]:
            shared += 1
        close(shared)
        opened.extend([False, []] for _ in word[shared:])
        opened[-1][0] = True
        last = word
    close(0)
    states.append((opened[0][0], tuple(opened[0][1])))
    return len(states) - 1, states


def one_edit_pairs(words: list[str]) -> Iterator[tuple[str, str]]:
    """Pairs of sorted distinct words one inserted, deleted or replaced letter apart, each pair once.

    The composition's states before the edit are pairs (q, q), because the
    acceptor is deterministic; an edit leads to (q.a, q.b) or (q.a, q), and what
    follows is the common language of the two states, found once for a pair.
    """
    start, states = acceptor(words)
    edges_of = [dict(edges) for _, edges in states]
    endings: dict[tuple[int, int], list[str]] = {}

    def common(p: int, q: int) -> list[str]:
        key = (p, q) if p < q else (q, p)
        held = endings.get(key)
        if held is None:
            held, todo = [], [(p, q, "")]
            while todo:
                x, y, said = todo.pop()
                if states[x][0] and states[y][0]:
                    held.append(said)
                there = edges_of[y]
                todo.extend((child, there[c], said + c) for c, child in states[x][1] if c in there)
            endings[key] = held
        return held

    todo = [(start, "")]
    while todo:
        q, said = todo.pop()
        edges = states[q][1]
        for k, (a, child) in enumerate(edges):
            for b, other in edges[k + 1:]:
                for end in common(child, other):
                    yield said + a + end, said + b + end
            for end in common(child, q):
                if not end.startswith(a):  # of a run of equal letters the last is the deleted one
                    yield said + a + end, said + end
            todo.append((child, said + a))


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(a, b)`` of every near pair of a group; rows come sorted by (side, stem, rest).

    ``rest`` is a word behind its group's stem, from the end for the side "back".
    """
    group, rests = None, []
    a: list[str] = []
    b: list[str] = []

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], names=["a", "b"])
        a.clear()
        b.clear()
        return out

    def pairs() -> Iterator[pa.RecordBatch]:
        if len(rests) < 2:
            return
        side, stem = group
        for x, y in one_edit_pairs(rests):
            x, y = stem + x, stem + y
            a.append(x if side == "front" else x[::-1])
            b.append(y if side == "front" else y[::-1])
            if len(a) >= 1 << 16:
                yield flush()

    for batch in batches:
        for side, stem, rest in zip(*[batch.column(c).to_pylist() for c in ("side", "stem", "rest")]):
            if (side, stem) != group:
                yield from pairs()
                group, rests = (side, stem), []
            rests.append(rest)
    yield from pairs()
    yield flush()


def _depths(words: DataFrame, first: int, most: int) -> DataFrame:
    """``words`` (word, said) with ``depth``: the letters of ``said`` that name its initial state, null for none.

    The depth is ``first`` doubled until at most ``most`` words share the stem;
    a word that ends before that has none. Depends on the stems alone, so words
    that agree on a stem agree on the depth.
    """
    done, left, depth = [], words, first
    while True:
        staged = left.filter(F.length("said") >= depth).withColumn("stem", F.substring("said", 1, depth))
        hot = landed(staged.groupBy("stem").agg(F.count("*").alias("held")).filter(F.col("held") > most).drop("held"),
                     "hot-stems")
        done.append(left.filter(F.length("said") < depth).select("word", "said", F.lit(None).cast("int").alias("depth")))
        if hot.isEmpty():
            done.append(staged.select("word", "said", F.lit(depth).alias("depth")))
            break
        done.append(staged.join(hot, "stem", "left_anti").select("word", "said", F.lit(depth).alias("depth")))
        left = landed(staged.join(hot, "stem", "left_semi").select("word", "said"), "hot-words")
        depth *= 2
    return landed(reduce(DataFrame.union, done), "depths")


def near_words(vocab: DataFrame, min_chars: int = MIN_CHARS, group: int = GROUP) -> DataFrame:
    """``(a, b)``, once and with a before b, of all words of ``vocab`` (word) that one edit tells apart.

    A pair agrees on the first or on the last ``min_chars // 2`` letters. So
    the words are dealt by the acceptor's state behind their first letters, and
    read backwards by the state behind their last; each group is composed on
    its own. A state with more than ``group`` words gives way to those behind
    twice as many letters. Pairs whose edit lies before the one state and
    behind the other (there are none unless states gave way) meet in the state
    pair around the edit, (letters before, letters behind), which holds at most
    one word for each letter of the alphabet.
    """
    half = max(1, min_chars // 2)
    words = vocab.select("word")
    front = _depths(words.withColumn("said", F.col("word")), half, group)
    back = _depths(words.withColumn("said", F.reverse("word")), half, group)
    sides = [d.filter("depth IS NOT NULL").select(
        F.lit(side).alias("side"), F.expr("substring(said, 1, depth)").alias("stem"),
        F.expr("substring(said, depth + 1, length(said))").alias("rest"))
        for side, d in (("front", front), ("back", back))]
    dealt = sides[0].union(sides[1]).repartition(parts_for(front, 8 << 20), "side", "stem")
    found = dealt.sortWithinPartitions("side", "stem", "rest").mapInArrow(_paired, "a string, b string")

    whole = F.length("word")
    both = front.select("word", F.coalesce("depth", whole + 1).alias("f")).join(
        back.select("word", F.coalesce("depth", whole + 1).alias("g")), "word")

    def around(letter: int) -> DataFrame:
        """Places whose letter (1) or gap (0) lies before both states."""
        low, high = F.greatest(F.lit(0), whole - letter - F.col("g") + 1), F.least("f", whole + 1 - letter) - 1
        at = both.filter(low <= high).select("word", F.explode(F.sequence(low, high)).alias("i"))
        return at.select("word", F.struct(F.substring("word", F.lit(1), F.col("i")),
                                          F.substring("word", F.col("i") + 1 + letter, whole)).alias("states"))

    places = landed(around(1).union(around(0)).distinct(), "states-around")
    x, y = places.alias("x"), places.alias("y")
    met = x.join(y, (F.col("x.states") == F.col("y.states")) & (F.col("x.word") < F.col("y.word"))).select(
        F.col("x.word").alias("a"), F.col("y.word").alias("b"))
    found = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return found.union(met).distinct()


def _roots(links: DataFrame, steps: int) -> DataFrame:
    """``(word, root)`` of every word with a form: pointers doubled ``steps`` times."""
    at = links.select("word", F.col("form").alias("root"))
    for _ in range(steps):
        further = at.select(F.col("word").alias("via"), F.col("root").alias("beyond"))
        at = landed(at.join(further, at["root"] == further["via"], "left").select(
            "word", F.coalesce("beyond", "root").alias("root")), "roots")
    return at


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
             min_count: int = MIN_COUNT, times: int = TIMES, group: int = GROUP) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word of the whole table that is long and frequent enough.

    Words are runs of Latin letters with A-Z in lower case; an occurrence whose
    crc32 of ``<id>:<run>`` is a multiple of 199 loses one letter. Words are
    near at one inserted, deleted or replaced code point; the near word of
    largest n (ties: smallest in code-point order) is the form if it is
    ``times`` as frequent, and forms are followed to the root. A null text has
    no words, a null id counts as empty text; repeated rows count again; words
    of any length are taken whole; a table without words gives no rows.

    A form has at least ``times`` the count of its word, so a chain has no more
    steps than a logarithm of the largest count, and the number of doublings is
    known beforehand.
    """
    if times < 2:
        raise ValueError("a form must be at least twice as frequent as its word")
    begin(docs)
    rows = view(docs, doc_id=id_col, text=text_col)
    vocab = landed(vocabulary(rows, min_chars, min_count), "vocabulary")
    pairs = landed(near_words(vocab, min_chars, group), "near-words")
    ways = pairs.union(pairs.select("b", "a")).toDF("word", "other")
    known = vocab.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    best = ways.join(known, "other").groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    joined = vocab.join(best, "word", "left")
    often = -F.col("best.less") >= times * F.col("n")
    formed = landed(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                  F.when(often, F.col("best.other")).alias("form"),
                                  F.when(often, -F.col("best.less")).alias("form_n")), "forms")
    most = vocab.agg(F.max("n")).first()[0] or 1
    chain = max(1, math.ceil(math.log(most, times)))
    roots = _roots(formed.filter("form IS NOT NULL"), math.ceil(math.log2(chain)))
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

