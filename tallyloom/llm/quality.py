"""Quality rules as a short-circuit cascade.

Each rule is a DataFrame expression that is true for a document to reject. The cost (seconds a
row) and selectivity (share rejected) of each are measured on a random sample of bounded size, and rules are put in
order of rejection per cost; a cost is the time of one task over the sample repeated many times, less that of the same task without
a rule, so that what a job costs besides does not count. The cascade is one CASE expression, so a rule is evaluated only for
documents that all rules before it accept. The order changes how much is computed, never the verdict: a
document is kept if no rule rejects it.

The sample (about ``sample_rows``, 500 by default) serves the order alone. Everything is built-in functions on
whole texts; no Python runs on the executors and nothing is shuffled.

Defined results: a null text has no words (so it fails the least number of words); words are runs of
characters other than 0x20 and 0x09-0x0D; extra columns pass through. Runs of words are compared by
64-bit hashes.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACE_RUN, WorkArea, fresh_name

#: Fixed value: characters that count as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, and only if the whole is evaluated."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE_RUN, -1), "")


def n_words(text: Column) -> Column:
    """Without building the words, which is cheaper when they serve nothing else."""
    return F.regexp_count(text, F.lit(f"[^{SPACE_RUN[1:-2]}]+")).cast("long")


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, SPACE_RUN, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda line: line.rlike(f"[^{SPACE_RUN[1:-2]}]"))


def n_lines(text: Column) -> Column:
    return F.size(_lines(text)).cast("long")


def n_dup_lines_of(lines: Column) -> Column:
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def n_dup_lines(text: Column) -> Column:
    return let(_lines(text), n_dup_lines_of)


def n_capitals(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[A-Z]")).cast("long")


def n_letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^A-Za-z]+", "")).cast("long")


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash occurs at least twice; ``hashes[i]`` is of the window that starts at word i."""

    def repeated(s: Column) -> Column:
        h = lambda k: F.get(s, k)["h"]
        same = F.filter(s, lambda x, k: F.coalesce(h(k - 1) == x["h"], F.lit(False)) | F.coalesce(h(k + 1) == x["h"], F.lit(False)))
        return F.sort_array(F.transform(same, lambda x: x["i"]))

    def width(p: Column) -> Column:
        steps = F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda a, b: F.least(F.lit(WINDOW), b - a))
        return F.aggregate(steps, F.lit(WINDOW).cast("long"), lambda total, x: total + x)

    order = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    some = let(let(order, repeated), width)
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(some)


def n_repeat_words(text: Column) -> Column:
    """Words inside runs of eight words that occur at least twice in the text, the first occurrence included."""
    return n_repeat_words_of(words_of(text))


def n_repeat_words_of(words: Column) -> Column:
    def double(hashes: Column, width: int) -> Column:
        """Hashes of runs twice as long: each run's hash with that of the run right after it."""
        n = F.size(hashes) - width
        return F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, width + 1, n), lambda a, b: F.xxhash64(a, b))

    def over(words: Column) -> Column:
        one = F.transform(words, lambda w: F.xxhash64(w))
        of_eight = let(let(let(one, lambda h: double(h, 1)), lambda h: double(h, 2)), lambda h: double(h, 4))
        return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(let(of_eight, _covered))

    return let(words, over)


FEATURES: dict[str, Callable[[Column], Column]] = {
    "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines,
    "n_repeat_words": n_repeat_words, "n_lines": n_lines, "n_capitals": n_capitals, "n_letters": n_letters,
}


@dataclass(frozen=True)
class Rule:
    """``reject`` gets a lookup from feature name to column."""

    name: str
    reject: Callable[[Callable[[str], Column]], Column]


BASE_RULES = (
    Rule("too few words", lambda f: f("n_words") < 20),
    Rule("repeated runs of words", lambda f: 100 * f("n_repeat_words") > 30 * f("n_words")),
)
STYLE_RULES = (
    Rule("symbols", lambda f: 5 * f("n_symbols") > f("n_words")),
    Rule("capitals", lambda f: 2 * f("n_capitals") > f("n_letters")),
    Rule("repeated lines", lambda f: 2 * f("n_dup_lines") > f("n_lines")),
    Rule("length of words", lambda f: (f("word_chars") < 2 * f("n_words")) | (f("word_chars") > 20 * f("n_words"))),
)


def order_rules(docs: DataFrame, rules: tuple[Rule, ...], text_col: str = "text", sample_rows: int = 500, repeats: int = 10) -> list[Rule]:
    """Rules by rejection per cost, measured on about ``sample_rows`` random rows, each ``repeats`` times; ties keep the given order."""
    area = WorkArea(docs.sparkSession, "quality")
    share = min(1.0, sample_rows / max(1, docs.count()))
    sample = area.table(docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("t")).sample(share, seed=11).repartition(1), "sample")
    many = sample.select("t", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("again")).coalesce(1)

    def measure(bad: Column) -> tuple[int, float]:
        took, rejected = [], 0
        for _ in range(3):  # the first compiles
            began = time.perf_counter()
            rejected = many.agg(F.count_if(bad)).first()[0]
            took.append(time.perf_counter() - began)
        return rejected, min(took)

    n = max(1, sample.count() * repeats)
    _, bare = measure(F.octet_length("t") < 0)
    score: dict[str, float] = {}
    for rule in rules:
        rejected, took = measure(rule.reject(lambda name: FEATURES[name](F.col("t"))))
        score[rule.name] = (rejected + 0.5 * repeats) / n / max(took - bare, 1e-3)  # half a row: a rule that rejects none still has an order
    area.drop("sample")
    return sorted(rules, key=lambda r: -score[r.name])


def cascade(rules: list[Rule], feature: Callable[[str], Column]) -> Column:
    """The first rule, in the given order, that rejects; null if none does. Later rules are not evaluated."""
    out = None
    for rule in rules:
        hit = F.coalesce(rule.reject(feature), F.lit(False))
        out = F.when(hit, rule.name) if out is None else out.when(hit, rule.name)
    return out if out is not None else F.lit(None).cast("string")


#: Features that share the array of words, or of lines, once it is built.
FROM_WORDS: dict[str, Callable[[Column], Column]] = {
    "n_words": lambda w: F.size(w).cast("long"), "word_chars": lambda w: F.length(F.array_join(w, "")).cast("long"), "n_repeat_words": n_repeat_words_of,
}


FROM_LINES: dict[str, Callable[[Column], Column]] = {"n_dup_lines": n_dup_lines_of, "n_lines": lambda lines: F.size(lines).cast("long")}


def with_features(docs: DataFrame, names: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """``docs`` with the named features of every row; the text is split into words once."""
    text, words = F.coalesce(F.col(text_col), F.lit("")), fresh_name(docs.columns, "words")
    split = docs.withColumn(words, words_of(text))
    return split.withColumns({n: FROM_WORDS[n](F.col(words)) if n in FROM_WORDS else FEATURES[n](text) for n in names}).drop(words)


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + STYLE_RULES, text_col: str = "text", sample_rows: int = 500) -> DataFrame:
    """``docs`` without the rows that a rule rejects; same columns."""
    ordered = order_rules(docs, rules, text_col, sample_rows)
    names = docs.columns
    verdict, words, lines = (fresh_name(names, x) for x in ("verdict", "words", "lines"))
    text = F.coalesce(F.col(text_col), F.lit(""))

    def feature(name: str) -> Column:
        if name in FROM_WORDS:
            return FROM_WORDS[name](F.col(words))
        return FROM_LINES[name](F.col(lines)) if name in FROM_LINES else FEATURES[name](text)

    split = docs.withColumns({words: words_of(text), lines: _lines(text)})  # once for all rules
    return split.withColumn(verdict, cascade(ordered, feature)).where(F.col(verdict).isNull()).select(*names)
