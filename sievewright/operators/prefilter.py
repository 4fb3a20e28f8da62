"""Literal hints of patterns, prefilters that never lose a match, and indexes.

Two kinds of hints live here.  ``extract_hint`` reads a pattern's text the way
a standard regular expression would (groups, escapes, quotes) and picks its most
selective literal by a score.  ``necessary_literals`` is derived from the tree:
texts that every match contains, the only kind that may drop rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.patterns import PatternSet
from sievewright.patterns.ast import Lit, Pattern

from .anchors import anchored_matches
from .literal_join import literal_matches, per_pattern

# Scores and word list of the literal selection.
MIN_LITERAL_LENGTH = 2
ANCHORED_MULTIPLIER = 3.0
COMMON_WORD_FACTOR = 0.5
VOWELS = "aeiouAEIOU"
PUNCTUATION = "!@#$%^&*()_+-=[]{}|;':,.<>?/~`"
COMMON_WORDS = "the and for are but not you all can had has was were said from they have with this that what there when where who will more time very first well way may down day much use than more come some could out many write would like into over think also back after their just where those only new know take year good work three never before end through last right old see too any same another much while should still such make need life little world public hand big group system small number part way even place case work week government company right way good first time life work way back right over take state without much work need may think know never still much"


@dataclass(frozen=True)
class LiteralHint:
    pattern_id: int
    literal: str
    offset_in_regex: int
    anchored_prefix: bool
    case_insensitive: bool
    literal_offset_in_match: int


@dataclass(frozen=True)
class HintOptions:
    min_length: int = MIN_LITERAL_LENGTH
    anchored_multiplier: float = ANCHORED_MULTIPLIER
    common_word_penalty: bool = True
    common_word_factor: float = COMMON_WORD_FACTOR

    def factor(self) -> float:
        return min(1.0, max(0.0, self.common_word_factor))


# Fixed value: letters that are not themselves after a backslash.
ESCAPED = "nrtfaebBAdDsSwWzZ"

_PIECE = re.compile(
    r"\\Q(?P<quoted>.*?)(?:\\E|\Z)"  # a quote ends the literal before it and is one itself
    rf"|\\(?P<special>[{ESCAPED}])"
    r"|\\(?P<escaped>.)|\\\Z"
    r"|\[[^\]]*(?:\]|\Z)"
    r"|\(\?:|[()|*+?.^${}]"
    r"|(?P<plain>.)",
    re.S,
)


def literal_runs(regex: str) -> list[str]:
    """Texts between the special parts of a standard regular expression."""
    runs, now = [], ""
    for m in _PIECE.finditer(regex):
        text = m["plain"] or m["escaped"]
        if text is not None:
            now += text
            continue
        if now:
            runs.append(now)
            now = ""
        if m["quoted"]:
            runs.append(m["quoted"])
    return [*runs, now] if now else runs


def selectivity(literal: str, anchored: bool = False, options: HintOptions = HintOptions()) -> float:
    """Higher for literals that are found less often."""
    score = 10.0 * len(literal) * (options.anchored_multiplier if anchored else 1.0)
    for c in literal:
        if c in VOWELS:
            score += 1
        elif c.isascii() and c.isalpha():
            score += 2
        elif c in "0123456789":
            score += 5
        elif c in PUNCTUATION:
            score += 10
        else:
            score += 3
    if options.common_word_penalty and literal.lower() in COMMON_WORDS:
        score *= options.factor()
    return score


def selectivity_column(literal: Column, anchored: Column | None = None, options: HintOptions = HintOptions()) -> Column:
    """``selectivity`` as a column expression."""
    n = lambda pattern: F.length(F.regexp_replace(literal, pattern, "")).cast("double")
    # length without a class, so counts are differences
    size = F.length(literal).cast("double")
    vowels, letters, digits = size - n("[aeiouAEIOU]"), size - n("[a-zA-Z]"), size - n("[0-9]")
    punct = size - n("[" + re.escape(PUNCTUATION).replace("`", "`") + "]")
    base = size * 10.0
    if anchored is not None:
        base = base * F.when(anchored, F.lit(options.anchored_multiplier)).otherwise(F.lit(1.0))
    score = base + vowels + 2.0 * (letters - vowels) + 5.0 * digits + 10.0 * punct + 3.0 * (size - letters - digits - punct)
    if options.common_word_penalty:
        score = score * F.when(F.contains(F.lit(COMMON_WORDS), F.lower(literal)), F.lit(options.factor())).otherwise(F.lit(1.0))
    return score


def extract_hint(pattern_id: int, regex: str, case_insensitive: bool = False, options: HintOptions = HintOptions()) -> LiteralHint | None:
    """The most selective literal of at least the least length (the first of equals), or None."""
    best, best_score = None, 0.0
    caret = regex.startswith("^")
    for lit in literal_runs(regex):
        if len(lit) < max(1, options.min_length):
            continue
        at = regex.find(lit)
        score = selectivity(lit, caret and at <= 1, options)
        if score > best_score:
            best, best_score = (lit, at), score
    if best is None:
        return None
    anchored = caret and best[1] <= 1
    return LiteralHint(pattern_id, best[0], best[1], anchored, case_insensitive, best[1] if anchored else 0)


def is_safe_hint(regex: str | None, hint: LiteralHint | None) -> bool:
    """Whether the hint is a prefix of fixed place.  Also asks, beyond the
    text-level rule, that the literal isn't made optional by ? or * behind it."""
    if regex is None or hint is None or "|" in regex:
        return False
    if hint.offset_in_regex != regex.startswith("^") or hint.literal_offset_in_match:
        return False
    after = regex[hint.offset_in_regex + len(hint.literal) :]
    return not after.startswith(("?", "*", "+?", "+*"))


def hints_df(spark: SparkSession, patterns: list[str], options: HintOptions = HintOptions()) -> DataFrame:
    rows = [(h.pattern_id, h.literal, h.offset_in_regex, h.anchored_prefix, h.case_insensitive, h.literal_offset_in_match, is_safe_hint(p, h)) for i, p in enumerate(patterns) if (h := extract_hint(i, p, options=options))]
    return spark.createDataFrame(rows, "pattern_id int, literal string, offset_in_regex int, anchored_prefix boolean, case_insensitive boolean, literal_offset_in_match int, safe boolean")


def candidates(df: DataFrame, hints: list[LiteralHint], text_col: str, keys: list[str], sketch: DataFrame | None = None) -> DataFrame:
    """(keys..., pattern_id, end_index_exclusive, literal_length, literal_offset_in_match,
    start_pos): every place of every hint; case-insensitive ones also in lower and upper case.

    With a sketch of the corpus' grams, places are found from each hint's rarest gram."""
    forms = []
    for h in hints:
        for x in dict.fromkeys([h.literal, h.literal.lower(), h.literal.upper()] if h.case_insensitive else [h.literal]):
            forms.append((h.pattern_id, x))
    off = {h.pattern_id: (len(h.literal), h.literal_offset_in_match) for h in hints}
    got = literal_matches(df, forms, text_col, keys) if sketch is None else anchored_matches(df, forms, sketch, text_col, keys)
    extra = df.sparkSession.createDataFrame([(i, n, o) for i, (n, o) in off.items()], "pattern_id int, literal_length int, literal_offset_in_match int")
    got = got.join(per_pattern(extra, len(off)), "pattern_id").withColumn("end_index_exclusive", F.col("end_pos") + 1)
    got = got.withColumn("start_pos", F.col("end_index_exclusive") - F.col("literal_length") - F.col("literal_offset_in_match")).where("start_pos >= 0")
    return got.select(*keys, "pattern_id", "end_index_exclusive", "literal_length", "literal_offset_in_match", "start_pos")


def candidate_positions(cands: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., start_pos, pattern_ids): the patterns that may begin at a place."""
    return cands.groupBy(*keys, "start_pos").agg(F.sort_array(F.collect_set("pattern_id")).alias("pattern_ids"))


def necessary_literals(pattern: Pattern, least: int = 2) -> list[str] | None:
    """Texts of which each match contains one at least; None if nothing can be said.

    An alternative gives its longest run that isn't optional.
    """
    out = []
    for a in pattern.alternatives:
        runs = [i.atom.text for i in a.items if isinstance(i.atom, Lit) and not i.optional and i.atom.text]
        best = max(runs, key=len, default="")
        if len(best) < least:
            return None
        out.append(best)
    return out or None


def row_filter(patterns: PatternSet, text: Column, most: int = 32) -> Column | None:
    """A condition that every text with a match of some pattern meets, or None.

    Runs as native string search before rows are sent to Python; with more
    than ``most`` literals it would cost more than it saves.
    """
    least = min((p.min_length() for p in patterns.parsed), default=1)
    long_enough = F.length(text) >= least
    literals: list[str] = []
    for p in patterns.parsed:
        got = necessary_literals(p)
        if got is None:
            return long_enough
        literals += got
    literals = list(dict.fromkeys(literals))
    if not literals or len(literals) > most:
        return long_enough
    cond = F.contains(text, F.lit(literals[0]))
    for x in literals[1:]:
        cond = cond | F.contains(text, F.lit(x))
    return long_enough & cond


def first_char_index(patterns: DataFrame, pattern_col: str = "pattern", id_col: str = "pattern_id") -> DataFrame:
    """(first_char, pattern_ids): by the pattern text's first character, also in lower case."""
    c = F.substring(pattern_col, 1, 1)
    rows = patterns.where(F.length(pattern_col) > 0).select(F.explode(F.array_distinct(F.array(c, F.lower(c)))).alias("first_char"), F.col(id_col).alias("id"))
    return rows.groupBy("first_char").agg(F.sort_array(F.collect_set("id")).alias("pattern_ids"))


def min_length_index(patterns: DataFrame, pattern_col: str = "pattern") -> DataFrame:
    """Adds min_length by the text rule: ASCII letters and digits, at least 1."""
    return patterns.withColumn("min_length", F.greatest(F.lit(1), F.length(F.regexp_replace(pattern_col, "[^A-Za-z0-9]", ""))))


def ngram_semi_join(df: DataFrame, patterns: DataFrame, text_col: str, keys: list[str], pattern_col: str = "pattern", n: int = 3) -> DataFrame:
    """(keys..., start_pos): places whose lower-cased n characters some pattern's text has too.

    Exact where a Bloom filter would let some through.
    """
    from .literal_join import windows

    t = F.lower(F.col(pattern_col))
    grams = patterns.where(F.length(t) >= n).select(F.explode(F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substring(t, i, F.lit(n)))).alias("gram")).distinct()
    w = windows(df, text_col, keys, n)
    places = w.where(F.length("window") >= n).select(*keys, "at", "window", F.explode(F.sequence(F.lit(0), F.least(F.lit(63), F.length("window") - n))).alias("o"))
    places = places.select(*keys, (F.col("at") + F.col("o")).alias("start_pos"), F.lower(F.substring(F.col("window"), F.col("o") + 1, F.lit(n))).alias("gram"))
    return places.join(grams, "gram", "left_semi").select(*keys, "start_pos")
