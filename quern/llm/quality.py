"""Quality rules: a table of thresholds compiled into one projection of built-in expressions.

Measures are counts over a whole text; rules bound ratios of them.  Nothing here calls a user function.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.text import WORD, words

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to a in is that it for on with as are was be this by or from at an not but he she they we you "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an er sie wir ihr "
    "le la les de des du et en un une que qui dans pour par sur pas au avec ce il elle ne se sont est nous vous "
    "el los las del y que se un una por con no para su al lo como más pero sus le ya o este si "
).split()

#: The characters that the base counts call symbols.
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``numerator / denominator`` must lie in [low, high]; an empty denominator passes."""

    name: str
    numerator: str
    denominator: str
    low: float | None = None
    high: float | None = None

    def passes(self) -> Column:
        a, b = F.col(self.numerator), F.col(self.denominator)
        bounds = ([a >= F.lit(self.low) * b] if self.low is not None else []) + ([a <= F.lit(self.high) * b] if self.high is not None else [])
        fits = bounds[0] if len(bounds) == 1 else bounds[0] & bounds[1]
        return F.when(b > 0, fits).otherwise(F.lit(True))


#: The thresholds; a document passes if it passes all of them.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", low=1.5, high=15.0),
    Rule("symbol_ratio", "n_symbols", "n_words", high=0.25),
    Rule("shout_ratio", "n_marks", "n_words", high=0.5),
    Rule("stop_word_ratio", "n_stop_words", "n_words", low=0.02),
    Rule("duplicate_line_ratio", "n_dup_lines", "n_lines", high=0.5),
)

BASE_MIN_WORDS = 50
BASE_MAX_REPEATED_PERCENT = 50


def _keyed(tokens: Column) -> Column:
    """One long for each three-word window, 32 bits of its hash above its position, sorted as plain longs."""
    key = lambda w, i: F.shiftleft(F.xxhash64(w, F.get(tokens, i + 1), F.get(tokens, i + 2)), 32).bitwiseOR(i.cast("long"))
    return F.sort_array(F.slice(F.transform(tokens, key), 1, F.greatest(F.size(tokens) - 2, F.lit(0))))


def _suspects(keys: Column) -> Column:
    """Positions of windows whose hash bits occur again: all repeated windows, and now and then another."""
    bits = lambda x: F.shiftright(x, 32)
    alike = lambda x, k: (bits(x) == F.coalesce(bits(F.get(keys, k - 1)), F.lit(1 << 40))) | (bits(x) == F.coalesce(bits(F.get(keys, k + 1)), F.lit(1 << 40)))
    return F.transform(F.filter(keys, alike), lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int"))


def _texts(tokens: Column, suspects: Column) -> Column:
    """The suspected windows' words with their positions, sorted so that equal windows are neighbours."""
    window = lambda i: F.concat_ws(" ", F.get(tokens, i), F.get(tokens, i + 1), F.get(tokens, i + 2))
    return F.sort_array(F.transform(suspects, lambda i: F.struct(window(i).alias("w"), i.alias("i"))))


def _repeated(windows: Column) -> Column:
    """Positions of the windows that have an equal neighbour, sorted, and -1 in place of each other window."""
    same = lambda x, k: F.coalesce(x["w"] == F.get(windows, k - 1)["w"], F.lit(False)) | F.coalesce(x["w"] == F.get(windows, k + 1)["w"], F.lit(False))
    return F.sort_array(F.transform(windows, lambda x, k: F.when(same(x, k), x["i"]).otherwise(-1)))


def _covered(positions: Column) -> Column:
    """Words in the union of the windows at these sorted positions: each adds the step from the last, at most three."""
    start = F.struct(F.lit(0).alias("total"), F.lit(-3).alias("last"))
    step = lambda a, i: F.when(i < 0, a).otherwise(F.struct((a["total"] + F.least(F.lit(3), i - a["last"])).alias("total"), i.alias("last")))
    return F.aggregate(positions, start, step, lambda a: a["total"]).cast("long")


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` with the counts that the rules refer to; columns of ``docs`` with these names are replaced.

    Null text counts as an empty one.  Symbols and marks are counted in words; lines are the \\n-separated lines that hold
    a word, compared as they are.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_marks", "n_stop_words", "n_lines", "n_dup_lines", "n_repeat_words"]
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.drop(*names, "_w", "_l", "_j", "_k", "_u", "_s", "_p").withColumns(
        {"_w": words(F.col("text")), "_l": F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))}
    )
    # Each step refers to the columns of the last more than once, so that Spark doesn't fold it into the next.
    out = out.withColumns({"_j": F.array_join("_w", ""), "_k": _keyed(F.col("_w"))})
    out = out.withColumn("_u", _suspects(F.col("_k")))
    out = out.withColumn("_s", F.when(F.size("_u") > 0, _texts(F.col("_w"), F.col("_u"))))
    out = out.withColumn("_p", F.when(F.size("_u") > 0, _repeated(F.col("_s"))))
    keep = lambda characters: F.length(F.regexp_replace("_j", f"[^{characters}]+", "")).cast("long")
    return out.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length("_j").cast("long"),
            "n_symbols": keep(SYMBOLS),
            "n_marks": keep("!?"),
            "n_stop_words": F.size(F.filter("_w", lambda w: w.isin(sorted({*STOP_WORDS, *map(str.capitalize, STOP_WORDS)})))).cast("long"),
            "n_lines": F.size("_l").cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "n_repeat_words": F.coalesce(_covered(F.col("_p")), F.lit(0)),
        }
    ).drop("_w", "_l", "_j", "_k", "_u", "_s", "_p")


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with measures, ``base_failed``, ``failed_rules`` (names) and ``kept``.

    A document fails the base with fewer than 50 words or if over half of its words are repeated; the rules judge the rest.
    A bound that is met exactly passes.  Null and empty texts have no words, and fail; texts are read whole, however long.
    Repeated rows are judged alike, and an empty table stays empty.  Columns with the names of results are replaced, and
    columns named by an underscore and one letter, which the measures use, are left out.
    """
    measured = measure(docs.drop("base_failed", "failed_rules", "kept"))
    base = (F.col("n_words") < BASE_MIN_WORDS) | (100 * F.col("n_repeat_words") > BASE_MAX_REPEATED_PERCENT * F.col("n_words"))
    failed = F.array_compact(F.array(*[F.when(~rule.passes(), F.lit(rule.name)) for rule in rules]))
    judged = measured.withColumns({"base_failed": base, "failed_rules": failed})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
