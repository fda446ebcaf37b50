"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Per text: length, symbol, stop-word, repetition and line figures, the base verdict, and whether every rule holds.

Defined results: a null or empty text has zero words and fails the base rules. Ties and repeated rows do not matter,
each row is judged alone. Other columns of the input are ignored unless named in ``carry``. An empty table gives an
empty table. Very long texts: arrays are bound once (see ``let``), so the work is n log n in a text's words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, words

#: Frequent function words of the four languages of the tables.
STOP_WORDS = (
    "the and of to in is was with from that this for are at by an or be as on not it he "
    "le la les de des du et un une en est que qui dans pour par sur avec au ou pas "
    "der die das und den von zu mit sich nicht ein eine im dem auf ist für als auch es "
    "el los las y del se una por con para su no lo al como o"
).split()


@dataclass(frozen=True)
class Rule:
    """``low <= metric <= high``; texts with fewer than ``from_words`` words are exempt."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0


#: Limits on ratios that clean prose of any of the languages keeps by a wide margin.
RULES = (
    Rule("word_length", "mean_word_chars", 2.0, 14.0),
    Rule("symbols", "symbols_per_word", None, 0.25),
    Rule("stop_words", "stop_word_ratio", 0.02, None),
    Rule("duplicate_lines", "dup_line_ratio", None, 0.5),
)


def _repeat_words(w: Column) -> Column:
    """Words in 3-word windows that occur twice or more: sort windows, mark equal neighbours, add up what they cover."""
    n = F.size(w)
    grams = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.struct(F.concat_ws(" ", w[i], w[i + 1], w[i + 2]).alias("g"), i.alias("i")),
    )

    def marked(s: Column) -> Column:
        m = F.size(s)
        return F.sort_array(
            F.filter(
                F.transform(
                    s,
                    lambda x, k: F.when(
                        (F.when(k > 0, F.try_element_at(s, k)["g"] == x["g"]) == True)  # noqa: E712
                        | (F.when(k < m - 1, F.try_element_at(s, k + 2)["g"] == x["g"]) == True),  # noqa: E712
                        x["i"],
                    ),
                ),
                lambda i: i.isNotNull(),
            )
        )

    covered = F.aggregate(
        let(F.sort_array(grams), marked),
        F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n")),
        lambda a, i: F.struct((i + 3).alias("to"), (a["n"] + (i + 3) - F.greatest(a["to"], i)).alias("n")),
        lambda a: a["n"],
    )
    return F.when(n < 4, F.lit(0).cast("long")).otherwise(covered)


def metrics(text: Column) -> Column:
    """struct of the base counts and of the ratios that rules speak of."""
    text = F.coalesce(text, F.lit(""))
    is_stop = lambda x: F.lower(F.rtrim(x, F.lit(".,;:!?"))).isin(*STOP_WORDS)  # noqa: E731  so many become a hash set

    def of(w: Column) -> Column:
        n = F.size(w).cast("long")
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return F.struct(
            n.alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
            _repeat_words(w).alias("n_repeat_words"),
            F.size(F.filter(w, is_stop)).cast("long").alias("n_stop"),
        )

    return let(words(text), of)


def apply_rules(df: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: the carried columns, base figures, base_failed, one boolean per rule, kept."""
    m = F.col("m__")
    out = df.select(*[F.col(c) for c in carry], metrics(F.col(text)).alias("m__"))
    n, per = m["n_words"], lambda x, y: F.when(y > 0, x / y).otherwise(F.lit(0.0))
    ratio = {
        "mean_word_chars": per(m["word_chars"], n),
        "symbols_per_word": per(m["n_symbols"], n),
        "stop_word_ratio": per(m["n_stop"], n),
        "dup_line_ratio": per(m["lines"]["dup"], m["lines"]["n"]),
        "n_words": n,
    }
    failed_base = (n < 50) | (100 * m["n_repeat_words"] > 50 * n)

    def holds(r: Rule) -> Column:
        ok = F.lit(True)
        if r.low is not None:
            ok = ok & (ratio[r.metric] >= r.low)
        if r.high is not None:
            ok = ok & (ratio[r.metric] <= r.high)
        return ok | (n < r.from_words)

    verdicts = {r.name: holds(r) for r in rules}
    every = F.lit(True)
    for v in verdicts.values():
        every = every & v
    return out.select(
        *[F.col(c) for c in carry],
        n.alias("n_words"),
        m["word_chars"].alias("word_chars"),
        m["n_symbols"].alias("n_symbols"),
        m["lines"]["dup"].alias("n_dup_lines"),
        m["n_repeat_words"].alias("n_repeat_words"),
        m["n_stop"].alias("n_stop_words"),
        failed_base.alias("base_failed"),
        *[v.alias(f"rule_{k}") for k, v in verdicts.items()],
        (~failed_base & every).alias("kept"),
    )
