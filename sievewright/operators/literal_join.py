"""Literal patterns as a Spark join, without Python on the executors.

Texts are cut in one walk into overlapping windows of ``PLACES`` places plus the
longest literal.  A window is split where a literal's first characters stand
(of many literals: where their first characters may stand), so only such places
become rows.  Each gives its first k characters, k being the length of the
shortest literal of a group, which are joined with the literals' own; what
follows is compared in full.  Literals are grouped by length class, so one short
literal does not make the key of all others short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import one_of, running_sums

#: Places of a window, where every place becomes a row and where few do.
CHUNK, PLACES = 64, 512
#: Characters of a literal that a window is split by, and beginnings that are spelt out; of more, a set for each character.
HEAD, MOST_HEADS = 5, 256
#: Literals up to this number are broadcast; above, the join may shuffle.
BROADCAST_LITERALS = 200_000
#: Lower ends of the length classes.
CLASSES = (1, 2, 3, 5, 8, 13, 24)


def per_pattern(rows: DataFrame, n: int) -> DataFrame:
    """``n`` rows about patterns (texts, names, actions), broadcast if they are few.

    They come from a pattern set, which the driver holds anyway.
    """
    return F.broadcast(rows) if n <= BROADCAST_LITERALS else rows


def length_class(n: int) -> int:
    return max(c for c in CLASSES if c <= n)


def windows(df: DataFrame, text_col: str, keys: list[str], longest: int, chunk: int = CHUNK) -> DataFrame:
    """(keys..., at, window): windows over each text; ``at`` is the place of the first character."""
    t = F.col(text_col)
    # a lookahead takes the window, and the walk goes on by its places: a text is read once, however long
    walk = F.regexp_extract_all(t, F.lit(f"(?s)(?=(.{{1,{chunk - 1 + longest}}})).{{1,{chunk}}}"), F.lit(1))
    d = df.where(F.length(t) > 0).select(*keys, F.posexplode(walk).alias("__n", "window"))
    return d.select(*keys, (F.col("__n") * chunk).alias("at"), "window")


def _char(c: str) -> str:
    return one_of([(ord(c), ord(c))]).text


def _tree(heads: list[str]) -> str:
    """The beginnings as one expression that goes by their first characters."""
    if "" in heads:  # what goes on from here is found here too
        return ""
    ways = [_char(c) + _tree(sorted({x[1:] for x in heads if x[0] == c})) for c in sorted({x[0] for x in heads})]
    return ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"


def heads_expression(heads: list[str]) -> str:
    """Fits in front of every place where one of the texts (none is empty) begins; of up to MOST_HEADS, nowhere else."""
    size = min(map(len, heads))
    sets = "".join(f"[{''.join(_char(c) for c in sorted({x[i] for x in heads}))}]" for i in range(size))
    return f"(?={sets})" + (f"(?={_tree(sorted(set(heads)))})" if len(set(heads)) <= MOST_HEADS else "")


def head_places(windows: DataFrame, keys: list[str], heads: list[str]) -> DataFrame:
    """(keys..., at, window, o): the places ``o`` of windows where a text may begin; the first always is one."""
    pieces = F.split("window", heads_expression(heads))
    w = windows.select(*keys, "at", "window", F.transform(pieces, F.length).alias("__sizes"))
    # each piece but the first begins at such a place
    places = F.concat(F.array(F.lit(0)), F.slice(running_sums(F.col("__sizes")), F.lit(1), F.size("__sizes") - 1))
    return w.select(*keys, "at", "window", F.explode(places).alias("o"))


def literal_matches(df: DataFrame, literals: list[tuple[int, str]], text_col: str, keys: list[str], matched_text: bool = False) -> DataFrame:
    """(keys..., pattern_id, start_pos, end_pos[, matched_text]): every occurrence, overlapping or not, of (pattern id, literal), row by row."""
    spark = df.sparkSession
    literals = list(dict.fromkeys(literals))
    more = [F.col("literal").alias("matched_text")] * matched_text
    if not literals:
        return df.select(*keys, F.lit(0).alias("pattern_id"), F.lit(0).alias("start_pos"), F.lit(0).alias("end_pos"), *[F.lit("").alias("matched_text")] * matched_text).where(F.lit(False))
    longest = max(len(x) for _, x in literals)
    classes = sorted({length_class(len(x)) for _, x in literals})
    rows = [(i, x, length_class(len(x)), x[: length_class(len(x))]) for i, x in literals]
    lits = per_pattern(spark.createDataFrame(rows, "pattern_id int, literal string, k int, gram string"), len(rows))
    w = head_places(windows(df, text_col, keys, longest, PLACES), keys, [x[: min(HEAD, length_class(len(x)))] for _, x in literals])
    # starts from PLACES on belong to the next window
    places = w.where(F.col("o") < PLACES).select(*keys, (F.col("at") + F.col("o")).alias("start_pos"), F.substring(F.col("window"), F.col("o") + 1, F.lit(longest)).alias("rest"))
    if len(classes) > 1:
        places = places.withColumn("k", F.explode(F.array(*[F.lit(k) for k in classes])))
    else:
        places = places.withColumn("k", F.lit(classes[0]))
    places = places.withColumn("gram", F.substring(F.col("rest"), F.lit(1), F.col("k")))
    hit = places.join(lits, ["k", "gram"]).where(F.col("rest").startswith(F.col("literal")))
    return hit.select(*keys, "pattern_id", "start_pos", (F.col("start_pos") + F.length("literal") - 1).alias("end_pos"), *more)
