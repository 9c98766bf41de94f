"""Quality rules as a threshold table compiled into one Spark projection, without user functions.

A document's statistics are computed inside its own row (array functions, no exchange), then every
rule of THRESHOLDS becomes one comparison of two whole numbers, so that no rounding is involved.

Defined cases: a null or empty text has no words and fails; other null columns play no part;
repeated rows and doc_ids are judged row by row; columns of any name may be present, as internal
names step aside; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fresh

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that for it was on are as with be by at this from or an not which but "
    "der die das und ist von zu mit den ein eine nicht auf im dem des sich für werden auch "
    "le la les de et un une est que qui en dans pour pas sur au du par avec ne "
    "el los las y del se por con una para no su al lo como más o pero"
).split()
SYMBOLS = "#*$%&|<>"
GRAM = 5


@dataclass(frozen=True)
class Rule:
    """Keep a document only if low <= per * value / of <= high (of = 0: the ratio counts as 0)."""

    name: str
    value: str
    of: str
    per: int
    low: int | None
    high: int | None
    least_words: int = 0


#: Ratios are in parts of per; a rule with least_words speaks only of documents that long.
THRESHOLDS = (
    Rule("mean_word_length", "word_chars", "n_words", 10, 20, 160),
    Rule("symbols_to_words", "n_symbols", "n_words", 100, None, 30),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", 100, None, 30),
    Rule("stop_words", "n_stop_words", "n_words", 1000, 10, None, 50),
    Rule("letters_to_characters", "n_letters", "word_chars", 100, 50, None),
    Rule("marked_lines", "n_marked_lines", "n_lines", 100, None, 90),
)


def _holds(rule: Rule, of: dict[str, Column]) -> Column:
    value, base = of[rule.value] * rule.per, of[rule.of]
    ok = F.lit(True)
    if rule.low is not None:
        ok = ok & (value >= base * rule.low)
    if rule.high is not None:
        ok = ok & (value <= base * rule.high)
    return (of["n_words"] < rule.least_words) | ok


def statistics(df: DataFrame, text: Column) -> tuple[DataFrame, dict[str, Column]]:
    """df with helper columns, and the statistics over them by name."""
    names: dict[str, str] = {}

    def add(name: str, value: Column) -> Column:
        nonlocal df
        names[name] = fresh(df, f"_q_{name}")
        df = df.withColumn(names[name], value)
        return F.col(names[name])

    text = add("text", F.coalesce(text, F.lit("")))
    words = add("words", F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""))
    lines = add("lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    hashes = add("hashes", F.transform(words, lambda w: F.xxhash64(w)))
    n = add("n", F.size(words).cast("long"))
    # Every window of GRAM words as one hash; a document without two equal hashes is done here.
    grams = add(
        "grams",
        F.when(n >= GRAM, F.transform(F.sequence(F.lit(0), (n - GRAM).cast("int")), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(GRAM))))).otherwise(F.array().cast("array<bigint>")),
    )
    placed = add(
        "placed",
        F.when(
            F.size(F.array_distinct(grams)) < F.size(grams),
            F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("p")))),
        ),
    )
    again = lambda x, i: F.coalesce(F.get(placed, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(placed, i + 1)["h"] == x["h"], F.lit(False))
    starts = F.sort_array(F.transform(F.filter(placed, again), lambda x: x["p"]))
    first = F.struct(F.lit(-GRAM).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(
        starts,
        first,
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(GRAM), p - a["last"])).cast("long").alias("n")),
        lambda a: a["n"],
    )
    count = lambda array, f: F.size(F.filter(array, f)).cast("long")
    stats = {
        "n_words": n,
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": F.when(placed.isNull(), F.lit(0).cast("long")).otherwise(covered),
        "n_lines": F.size(lines).cast("long"),
        "n_stop_words": count(words, lambda w: w.isin(STOP_WORDS + [w.capitalize() for w in STOP_WORDS])),
        "n_letters": F.length(F.regexp_replace(text, r"[^A-Za-z\x{80}-\x{10FFFF}]+", "")).cast("long"),
        "n_marked_lines": count(lines, lambda x: F.substring(x, 1, 2).isin("- ", "* ", "• ")),
    }
    kept = {name: add("s_" + name, value) for name, value in stats.items()}
    return df, kept


def judged(docs: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, Column]]:
    """docs with helper columns, and the statistics, base_failed, a column for each rule, and kept."""
    df, of = statistics(docs, F.col(text))
    base_failed = (of["n_words"] < 10) | (of["n_repeat_words"] * 100 > of["n_words"] * 20)
    rules = {f"rule_{r.name}": _holds(r, of) for r in THRESHOLDS}
    kept = ~base_failed
    for holds in rules.values():
        kept = kept & holds
    return df, of | {"base_failed": base_failed} | rules | {"kept": kept}


def filter_quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that no rule rejects, with the columns they came with."""
    df, of = judged(docs, text)
    # A filter on plain columns is pushed below them with their whole expressions, which would then be
    # computed anew for every word; one on a column that names the partition stays where it is.
    kept = fresh(df, "_q_kept")
    return df.withColumn(kept, of["kept"] & (F.spark_partition_id() >= 0)).where(F.col(kept)).select(*docs.columns)


RESULT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, of = judged(documents(spark, sf_dir))
    return df.select("doc_id", *(of[k].alias(k) for k in RESULT))


def _sql_rule(rule: Rule) -> str:
    parts = [f"{rule.value} * {rule.per} >= {rule.of} * {rule.low}"] * (rule.low is not None)
    parts += [f"{rule.value} * {rule.per} <= {rule.of} * {rule.high}"] * (rule.high is not None)
    return f"(n_words < {rule.least_words} OR ({' AND '.join(parts)}))"


def oracle(source: str = "documents", columns: str = "doc_id") -> str:
    """The same table in DuckDB's SQL, windows of words compared as text and not as hashes."""
    blank = r"[\x20\x09-\x0D]+"
    stops = ", ".join(f"'{w}'" for x in STOP_WORDS for w in (x, x.capitalize()))
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, *, coalesce(text, '') AS body FROM {source}),
q AS (SELECT rid, z[2] AS pos, [list_extract(ws, z[2] + 1), list_extract(ws, z[2] + 2), list_extract(ws, z[2] + 3),
             list_extract(ws, z[2] + 4), list_extract(ws, z[2] + 5)] AS gram FROM
      (SELECT rid, ws, unnest(list_zip(ws, range(len(ws)))) AS z FROM
       (SELECT rid, list_filter(regexp_split_to_array(body, '{blank}'), lambda x: x <> '') AS ws FROM t)) WHERE z[2] + 5 <= len(ws)),
d AS (SELECT rid, pos, count(*) OVER (PARTITION BY rid, gram) AS n FROM q),
g AS (SELECT rid, sum(least(5, pos - before)) AS n_repeat_words FROM
      (SELECT rid, pos, coalesce(lag(pos) OVER (PARTITION BY rid ORDER BY pos), -5) AS before FROM d WHERE n > 1) GROUP BY rid),
s AS (SELECT t.*, list_filter(regexp_split_to_array(body, '{blank}'), lambda x: x <> '') AS ws,
             list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM t),
m AS (SELECT s.* EXCLUDE (ws, ls), len(ws) AS n_words, length(regexp_replace(body, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
             length(regexp_replace(body, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, len(ls) AS n_lines,
             len(list_filter(ws, lambda x: x IN ({stops}))) AS n_stop_words,
             length(regexp_replace(body, '[\\x00-@\\[-`{{-\\x7F]', '', 'g')) AS n_letters,
             len(list_filter(ls, lambda x: substring(x, 1, 2) IN ('- ', '* ', '• '))) AS n_marked_lines,
             CAST(coalesce(g.n_repeat_words, 0) AS BIGINT) AS n_repeat_words
      FROM s LEFT JOIN g USING (rid)),
r AS (SELECT *, n_words < 10 OR n_repeat_words * 100 > n_words * 20 AS base_failed,
             {" AND ".join(_sql_rule(r) for r in THRESHOLDS)} AS ruled FROM m)
SELECT {columns}, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND ruled AS kept FROM r"""
