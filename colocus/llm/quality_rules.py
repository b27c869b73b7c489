"""Quality rules: a threshold table compiled into one Spark projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colocus.llm.common import SPACE, SPACE_CLASS, WORD_CLASS, text_of

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that it for was on are as with be by this at from or an have not "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an "
    "de la le et les des en un du une est que pour qui dans par sur au pas ne avec plus "
    "el y los del se las con para una su al lo como más pero sus"
).split()
SYMBOLS = "#*$%&|<>"
EDGE = ".,;:!?()\"'"


@dataclass(frozen=True)
class Rule:
    """Reject a text when ``100 * numerator`` is beyond ``bound * denominator``.

    above: reject larger shares; else smaller ones. least_words: the rule
    speaks only from so many words on. base: belongs to the base verdict.
    """

    name: str
    numerator: str
    denominator: str
    bound: int
    above: bool = True
    least_words: int = 0
    base: bool = False


#: Whole-number bounds, so that every engine decides alike. ``one`` is 1.
RULES = (
    Rule("few_words", "n_words", "one", 5_000, above=False, base=True),
    Rule("repeated_words", "n_repeat_words", "n_words", 50, base=True),
    Rule("symbols", "n_symbols", "word_chars", 5),
    Rule("repeated_lines", "n_dup_lines", "n_lines", 40),
    Rule("few_stop_words", "n_stop_words", "n_words", 4, above=False, least_words=100),
    Rule("long_words", "word_chars", "n_words", 1_200),
    Rule("short_words", "word_chars", "n_words", 200, above=False),
)
METRICS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_words", "n_repeat_words")


def bound_to(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more; windows are sorted, not compared in pairs.

    Hashes first tell which windows can have a twin (equal windows have equal
    hashes); only those are then compared as text.
    """
    window = lambda i: F.concat_ws(" ", F.get(words, i - 1), F.get(words, i), F.get(words, i + 1))
    every = F.sequence(F.lit(1), F.size(words) - 2)

    def covered(ordered: Column) -> Column:
        def at(x: Column, j: Column) -> Column:
            same = lambda k: F.coalesce(F.get(ordered, k)["g"] == x["g"], F.lit(False))
            return F.when(same(j - 1) | same(j + 1), x["p"])

        return bound_to(
            F.filter(F.transform(ordered, at), lambda p: p.isNotNull()),
            lambda hit: F.size(F.array_distinct(F.concat(hit, F.transform(hit, lambda p: p + 1), F.transform(hit, lambda p: p + 2)))),
        )

    def among(hashes: Column) -> Column:
        twins = bound_to(F.sort_array(hashes), lambda h: F.array_distinct(F.filter(h, lambda x, j: F.coalesce(F.get(h, j - 1) == x, F.lit(False)))))

        def compare(seen: Column) -> Column:
            places = F.when(F.size(seen) <= 48, F.filter(every, lambda i: F.array_contains(seen, F.get(hashes, i - 1)))).otherwise(every)
            ordered = F.sort_array(F.transform(places, lambda i: F.struct(window(i).alias("g"), i.alias("p"))))
            return F.when(F.size(seen) == 0, F.lit(0)).otherwise(bound_to(ordered, covered))

        return bound_to(twins, compare)

    hashes = F.transform(every, lambda i: F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(bound_to(hashes, among))


def metrics(text: Column) -> Column:
    """All counts of one text as a struct of longs."""
    words = F.filter(F.split(text, f"{SPACE_CLASS}+", -1), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda s: s.rlike(WORD_CLASS))
    stop = lambda w: F.lower(F.btrim(w, F.lit(EDGE))).isin(STOP_WORDS)
    return F.struct(
        F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        bound_to(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("line"),
        bound_to(
            words,
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.size(F.filter(w, stop)).cast("long").alias("n_stop_words"),
                _repeated_words(w).cast("long").alias("n_repeat_words"),
            ),
        ).alias("word"),
    )


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """True where a rule of the table rejects the row; each rule is a comparison of whole numbers."""
    failed = F.lit(False)
    for r in rules:
        top, base = F.col(r.numerator) * 100, F.lit(1) if r.denominator == "one" else F.col(r.denominator)
        hit = top > base * r.bound if r.above else top < base * r.bound
        failed = failed | (hit & (F.col("n_words") >= r.least_words))
    return failed


def score(df: DataFrame, text: str = "text", keep: tuple[str, ...] = (), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The kept columns, the counts, ``base_failed`` and ``kept``, one row per input row.

    A null text counts as empty: it has no words and fails ``few_words``.
    Repeated rows and ties are judged alike and stay; an empty table gives an
    empty result; other columns of the input are never looked at, whatever
    their names. There is no shuffle and no user function.
    """
    held = _judged(df, text, rules)
    return held.select(*[F.col(f"_row.`{c}`").alias(c) for c in keep], *METRICS, "base_failed", "kept")


def _judged(df: DataFrame, text: str, rules: tuple[Rule, ...]) -> DataFrame:
    """The row as the struct ``_row``, beside its counts and verdicts, so that names cannot clash."""
    held = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), metrics(text_of(df, text)).alias("_m"))
    flat = held.select(
        "_row",
        *[F.col(f"_m.{c}").alias(c) for c in ("word_chars", "n_symbols")],
        *[F.col(f"_m.line.{c}").alias(c) for c in ("n_lines", "n_dup_lines")],
        *[F.col(f"_m.word.{c}").alias(c) for c in ("n_words", "n_stop_words", "n_repeat_words")],
    )
    base = compile_rules(tuple(r for r in rules if r.base))
    return flat.select("*", base.alias("base_failed"), (~compile_rules(rules)).alias("kept"))


def kept_rows(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of df, with all their columns, that no rule rejects."""
    return _judged(df, text, rules).filter("kept").select("_row.*")


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, keep=("doc_id",)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop_words"
    )


def op2_sql() -> str:
    stops = ", ".join("'" + w + "'" for w in dict.fromkeys(STOP_WORDS))
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS (
  SELECT doc_id, t,
    list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM d),
g AS (
  SELECT doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM s WHERE len(w) >= 3)),
r AS (
  SELECT doc_id, count(DISTINCT q) AS n FROM (
    SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM (
      SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1)
  GROUP BY doc_id),
m AS (
  SELECT s.doc_id, len(w)::BIGINT AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words,
    len(l)::BIGINT AS n_lines,
    len(list_filter(w, lambda x: lower(trim(x, '.,;:!?()"''')) IN ({stops})))::BIGINT AS n_stop_words
  FROM s LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 5 * word_chars OR 100 * n_dup_lines > 40 * n_lines
    OR (n_words >= 100 AND 100 * n_stop_words < 4 * n_words)
    OR 100 * word_chars > 1200 * n_words OR 100 * word_chars < 200 * n_words) AS kept,
  n_lines, n_stop_words
FROM b"""
