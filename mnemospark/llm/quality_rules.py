"""Quality rules (native): a threshold table compiled into one Spark projection.

``RULES`` is plain data: a ratio of two measures, a direction and a bound.
``compile_rules`` turns the table into one boolean column, ``measures`` gives
the counts the ratios are made of.  Everything is a built-in column function
inside a narrow projection: no shuffle, no Python, no user function.

Defined results: a null, empty or blank text has no words, so every count is 0
and ``base_failed`` is true.  Repeated rows each get their own equal result.
Columns of the input with clashing names are kept out of the measures: they are
computed from the text alone, and overwrite input columns of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import WORD

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that it for as with was on be by at this are or "
    "der die das und in zu den mit von für ist im dem nicht ein eine auf als "
    "le la les de des et en un une du que est pour dans au par "
    "el los las y con una del se para por no"
).split()


@dataclass(frozen=True)
class Rule:
    """Reject a text whose numerator / denominator is beyond the bound."""

    name: str
    numerator: str
    denominator: str
    beyond: str  # "above" or "below"
    bound: float


#: The threshold table.  Measures are columns that ``measures`` makes.
RULES = (
    Rule("short_words", "word_chars", "n_words", "below", 2.0),
    Rule("long_words", "word_chars", "n_words", "above", 15.0),
    Rule("symbols", "n_symbols", "n_words", "above", 0.1),
    Rule("shouting", "n_shouts", "n_words", "above", 0.5),
    Rule("few_letters", "n_letter_words", "n_words", "below", 0.7),
    Rule("few_stop_words", "n_stop_words", "n_words", "below", 0.02),
    Rule("repeated_lines", "n_dup_lines", "n_lines", "above", 0.4),
)

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_shouts", "n_letter_words", "n_stop_words",
)


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """True where no rule of the table rejects; one expression, no branches on data."""
    verdict = F.lit(True)
    for r in rules:
        # n / d > b is written n > b * d, so that a zero denominator rejects nothing
        left, right = F.col(r.numerator).cast("double"), F.lit(float(r.bound)) * F.col(r.denominator)
        verdict = verdict & ((left <= right) if r.beyond == "above" else (left >= right))
    return verdict


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the MEASURES as long columns.

    Words in repeated 3-word windows are found by sorting (window hash, start)
    inside the row; windows are compared only with windows of their own text.
    """
    df = df.drop("_words", "_grams", "_lines", *[c for c in MEASURES if c in df.columns])
    df = df.withColumn("_words", F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0)))
    df = df.withColumn("n_words", F.size("_words").cast("long"))
    grams = F.transform(
        F.sequence(F.lit(0), F.size("_words") - 3),
        lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)),
    )
    df = df.withColumn("_grams", F.when(F.col("n_words") >= 3, grams).otherwise(F.array().cast("array<bigint>")))
    keyed = F.sort_array(F.transform("_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    df = df.withColumn(
        "_sorted",
        F.when(F.size(F.array_distinct("_grams")) < F.size("_grams"), keyed).otherwise(
            F.array().cast("array<struct<g:bigint,i:int>>")
        ),
    )
    again = F.filter(
        "_sorted",
        lambda s, j: (s["g"] == F.get("_sorted", j + 1)["g"]) | (s["g"] == F.get("_sorted", j - 1)["g"]),
    )
    covered = F.flatten(F.transform(again, lambda s: F.array(s["i"], s["i"] + 1, s["i"] + 2)))
    df = df.withColumn("n_repeat_words", F.size(F.array_distinct(covered)).cast("long")).drop("_sorted", "_grams")
    body = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("_lines", F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD)))
    return df.withColumns(
        {
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_shouts": F.regexp_count(body, F.lit(r"!")).cast("long"),
            "n_letter_words": F.regexp_count(body, F.lit(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\p{L}]*\p{L}")).cast("long"),
            "n_stop_words": F.regexp_count(
                body, F.lit(r"(?i)(?<![^\x20\x09-\x0D])(?:" + "|".join(sorted(set(STOP_WORDS))) + r")(?![^\x20\x09-\x0D.,;:!?])")
            ).cast("long"),
        }
    ).drop("_words", "_lines")


def quality_rules(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """df with the measures, ``base_failed`` and the verdict ``kept``.

    These columns pass through a one-row generator: a filter on them would otherwise be
    pushed below the projections, copying every measure into itself.
    """
    df = df.drop("base_failed", "kept", *MEASURES)
    judged = measures(df, text).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & compile_rules(rules))
    return judged.select(*[F.col(f"`{c}`") for c in df.columns], F.inline(F.array(F.struct(*MEASURES, "base_failed", "kept"))))


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    from mnemospark.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def filter_quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents the rules keep, with their own columns only."""
    return quality_rules(docs.select(F.struct(*docs.columns).alias("_row"), F.col("text"))).where("kept").select("_row.*")


#: DuckDB: the same counts and the same table of thresholds.
_DUCK_STOP = "|".join(sorted(set(STOP_WORDS)))
SQL = rf"""
with t as (
  select doc_id, coalesce(text, '') as body,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as ls
  from documents
), g as (
  select doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as gram
  from (select doc_id, words, unnest(range(1, len(words) - 1)) as i from t) u
), again as (
  select doc_id, unnest([i, i + 1, i + 2]) as p
  from (select doc_id, i, count(*) over (partition by doc_id, gram) as c from g) x where c >= 2
), rep as (select doc_id, count(distinct p) as r from again group by doc_id),
m as (
  select t.doc_id, cast(len(words) as bigint) as n_words,
    cast(length(array_to_string(words, '')) as bigint) as word_chars,
    cast(length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines,
    cast(coalesce(r, 0) as bigint) as n_repeat_words,
    cast(len(ls) as bigint) as n_lines,
    length(body) - length(replace(body, '!', '')) as n_shouts,
    len(list_filter(words, lambda w: regexp_matches(w, '\p{{L}}'))) as n_letter_words,
    len(list_filter(words, lambda w: regexp_matches(w, '^(?i:{_DUCK_STOP})(?:[.,;:!?].*)?$'))) as n_stop_words
  from t left join rep on rep.doc_id = t.doc_id
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words)
""" + "".join(
    f"    and cast({r.numerator} as double) {'<=' if r.beyond == 'above' else '>='} cast({r.bound} as double) * {r.denominator}\n"
    for r in RULES
) + "  as kept\nfrom m"
