"""Quality rules: a threshold table compiled into one projection.

Every measure is a built-in expression over one row, so the whole table of
rules is a single projection next to the scan: no shuffle, no user function,
and a very long document costs only its own row.

Cases: a null text counts as empty (no words, so it fails the length rule);
a null language, or one without a stop-word list, is not judged by the
stop-word rule; repeated rows are judged alike, row by row; further columns
pass through untouched and may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import let, words

#: The commonest function words by language code.
STOP_WORDS = {
    "en": "the and of to in a is that for it with as on by at from or an be this are was not have has".split(),
    "de": "der die das und in von zu mit den im des ist für auf ein eine dem nicht als auch es an einer".split(),
    "fr": "le la les de des du et en un une dans que qui pour par sur au est pas avec ce se il plus".split(),
    "es": "el la los las de del y en un una que por para con se su al es no lo como más o".split(),
}
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5                 # words of a window whose repeats are counted


@dataclass(frozen=True)
class Rule:
    """A document fails when ``measure`` is below ``low`` or above ``high``;
    the rule speaks only about documents of at least ``min_words`` words."""
    name: str
    measure: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0


#: The hard base: fails whatever the other rules say.
BASE_RULES = (
    Rule("too_short", "n_words", low=10),
    Rule("repeated_windows", "repeat_pct", high=20),
)
#: The method's verdict for documents that pass the base.
RULES = (
    Rule("word_length", "mean_word_chars", low=2.5, high=14.0),
    Rule("symbols", "symbol_ratio", high=0.10),
    Rule("shouting", "exclaim_ratio", high=0.10),
    Rule("capitals", "capital_ratio", high=0.50),
    Rule("stop_words", "stop_word_ratio", low=0.03, min_words=40),
    Rule("duplicate_lines", "dup_line_ratio", high=0.35),
    Rule("bullet_lines", "bullet_line_ratio", high=0.90),
    Rule("ellipsis_lines", "ellipsis_line_ratio", high=0.30),
)


def _repeat_words(ws: Column) -> Column:
    """Words inside windows that occur twice or more in the same text: hash
    every window, sort (hash, position) pairs, keep positions whose hash has
    an equal neighbour, and add up the words that those windows cover.  Texts
    whose hashes are all different skip the sort."""
    def hashes(w):
        return F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW),
                           lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(WINDOW)]))

    def covered(p):
        gaps = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), x - F.get(p, k - 1)))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    def repeated(pairs):
        def same(k, x):
            return F.coalesce(F.get(pairs, k)["h"] == x["h"], F.lit(False))
        hit = F.filter(pairs, lambda x, k: same(k - 1, x) | same(k + 1, x))
        return let(F.sort_array(F.transform(hit, lambda x: x["i"])), covered)

    def count(h):
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, repeated))

    return F.when(F.size(ws) < WINDOW, F.lit(0)).otherwise(let(hashes(ws), count)).cast("long")


def _share(n: Column, of: Column) -> Column:
    return F.when(of > 0, n / of).otherwise(F.lit(0.0))


def counts(text: Column, lang: Column) -> dict[str, Column]:
    """Raw counts of a text, each a built-in expression."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"\S"))
    # a word with its language in front is looked up in one literal set
    listed = [f"{code} {form}" for code, ws in STOP_WORDS.items()
              for w in ws for form in dict.fromkeys((w, w.capitalize(), w.upper()))]
    longest = max(len(w.encode()) for ws in STOP_WORDS.values() for w in ws)
    per_words = let(words(t), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.aggregate(w, F.lit(0).cast("long"), lambda n, x: n + F.char_length(x)).alias("chars"),
        F.size(F.filter(w, lambda x: (F.octet_length(x) <= longest) &
                        F.concat(lang, F.lit(" "), x).isin(*listed))).alias("n_stop"),
        _repeat_words(w).alias("n_repeat_words")))
    per_lines = let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"),
        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(x, lambda s: s.rlike(r"^\s*[-*•]"))).alias("n_bullets"),
        F.size(F.filter(x, lambda s: F.rtrim(s).endswith("...") | F.rtrim(s).endswith("…"))).alias("n_ellipsis")))
    return {
        "_w": per_words, "_l": per_lines,
        "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)).cast("long"),
        "n_exclaims": F.char_length(t) - F.char_length(F.replace(t, F.lit("!"), F.lit(""))),
        "n_capitals": F.regexp_count(t, F.lit(r"\p{Lu}")),
        "stop_list": lang.isin(*STOP_WORDS),
    }


def _measures(c) -> dict[str, Column]:
    """Ratios that the rules compare, from the counts ``c``."""
    n_words, n_lines, chars = c["_w"]["n_words"], c["_l"]["n_lines"], c["_w"]["chars"]
    return {
        "n_words": n_words,
        "repeat_pct": _share(100 * c["_w"]["n_repeat_words"], n_words),
        "mean_word_chars": _share(chars, n_words),
        "symbol_ratio": _share(c["n_symbols"], chars),
        "exclaim_ratio": _share(c["n_exclaims"], chars),
        "capital_ratio": _share(c["n_capitals"], chars),
        "stop_word_ratio": F.when(c["stop_list"], _share(c["_w"]["n_stop"], n_words)),
        "dup_line_ratio": _share(c["_l"]["n_dup_lines"], n_lines),
        "bullet_line_ratio": _share(c["_l"]["n_bullets"], n_lines),
        "ellipsis_line_ratio": _share(c["_l"]["n_ellipsis"], n_lines),
    }


def compile_rules(rules, measures: dict[str, Column]) -> Column:
    """Array of the names of the rules that a document fails."""
    def fails(r: Rule) -> Column:
        m = measures[r.measure]
        bounds = ([m < r.low] if r.low is not None else []) + ([m > r.high] if r.high is not None else [])
        out = F.coalesce(reduce(lambda a, b: a | b, bounds, F.lit(False)), F.lit(False))
        return out & (measures["n_words"] >= r.min_words) if r.min_words else out
    return F.filter(F.array(*[F.when(fails(r), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())


def verdict(text: Column, lang: Column, rules=RULES, base=BASE_RULES) -> Column:
    """Struct of the counts, the failed rules and ``kept``.  The counts are
    bound once inside the expression: a filter on the verdict may be pushed
    and copied by the optimizer without counting again for every rule."""
    def judge(c):
        m = _measures(c)
        failed_base, failed_rules = compile_rules(base, m), compile_rules(rules, m)
        return F.struct(
            c["_w"]["n_words"].alias("n_words"), c["_w"]["chars"].alias("word_chars"), c["n_symbols"].alias("n_symbols"),
            c["_l"]["n_dup_lines"].alias("n_dup_lines"), c["_w"]["n_repeat_words"].alias("n_repeat_words"),
            failed_base.alias("failed_base"), failed_rules.alias("failed_rules"), (F.size(failed_base) > 0).alias("base_failed"),
            ((F.size(failed_base) == 0) & (F.size(failed_rules) == 0)).alias("kept"))
    return let(F.struct(*[x.alias(n) for n, x in counts(text, lang).items()]), judge)


def judged(docs: DataFrame, text: str = "text", lang: str = "lang", rules=RULES, base=BASE_RULES,
           keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (default: all, in a struct ``row``) with the counts, the failed
    rules and the verdict.  One projection over the scan."""
    kept = [docs[f"`{c}`"].alias(c) for c in (docs.columns if keep is None else keep)]
    v = verdict(docs[f"`{text}`"], docs[f"`{lang}`"], rules, base)
    return docs.select(F.struct(*kept).alias("row"), v.alias("v")).select("row", "v.*")


def drop_failed(docs: DataFrame, text: str = "text", lang: str = "lang", rules=RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns unchanged."""
    return docs.where(verdict(docs[f"`{text}`"], docs[f"`{lang}`"], rules)["kept"])
