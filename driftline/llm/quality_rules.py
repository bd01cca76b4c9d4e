"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Every measure is a column expression over the whole text; no user function runs.
Null texts count as empty (no words, failing the base rule); repeated rows are
rated one by one; other columns of the input are passed through untouched by
``rate`` unless they carry the name of a measure, which then replaces them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5

# Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in is that it for was on are with as be by at this from not "
    "der die das und ist von zu den mit ein eine im nicht für auf "
    "le la les des du et est que qui en un une pour dans par sur "
    "el los las y de una por con para su se del"
).split()


@dataclass(frozen=True)
class Rule:
    """A document passes where low <= measure <= high; a missing bound is open."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("long_enough", "n_words", low=10),
    Rule("word_length", "mean_word_chars", low=2.0, high=12.0),
    Rule("symbols", "symbols_per_word", high=0.10),
    Rule("stop_words", "stop_word_ratio", low=0.06),
    Rule("repeated_lines", "dup_line_ratio", high=0.30),
    Rule("repeated_windows", "repeat_word_ratio", high=0.20),
)


def _ratio(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measures that the rules name.

    The steps are separate projections so that no array is computed twice.  Repeated
    windows are found by hashing: a text whose window hashes are all distinct, as most
    are, is done; only the others sort theirs.  Columns in between have a prefix that no
    column of ``docs`` begins with.
    """
    mark = "_"
    while any(c.startswith(mark) for c in docs.columns):
        mark += "_"
    body, words, lines, hashes, grams, ordered, twice = (f"{mark}{n}" for n in ("body", "words", "lines", "hashes", "grams", "sorted", "twice"))
    out = docs.withColumns({body: F.coalesce(F.col(text), F.lit(""))})
    out = out.withColumns(
        {
            words: F.array_remove(F.split(body, SPACES), ""),
            lines: F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
            "n_symbols": F.size(F.regexp_extract_all(body, F.lit(SYMBOLS), F.lit(0))).cast("long"),
        }
    )
    out = out.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": F.length(F.array_join(words, "")).cast("long"),
            "n_lines": F.size(lines).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))).cast("long"),
            hashes: F.transform(words, lambda w: F.xxhash64(w)),
        }
    )
    at = lambda i: [F.get(hashes, i + k) for k in range(WINDOW)]
    out = out.withColumns({grams: F.when(F.size(hashes) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), lambda i: F.xxhash64(*at(i)))).otherwise(F.array().cast("array<bigint>"))})
    out = out.withColumns({ordered: F.when(F.size(F.array_distinct(grams)) < F.size(grams), F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i")))))})
    same = lambda x, j: F.coalesce(F.get(ordered, j)["g"] == x["g"], F.lit(False))
    out = out.withColumns({twice: F.sort_array(F.transform(F.filter(ordered, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))})
    covered = F.transform(twice, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(twice, j + 1) - p, F.lit(WINDOW))))
    out = out.withColumns({"n_repeat_words": F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")})
    out = out.withColumns(
        {
            "mean_word_chars": _ratio("word_chars", "n_words"),
            "symbols_per_word": _ratio("n_symbols", "n_words"),
            "stop_word_ratio": _ratio("n_stop_words", "n_words"),
            "dup_line_ratio": _ratio("n_dup_lines", "n_lines"),
            "repeat_word_ratio": _ratio("n_repeat_words", "n_words"),
        }
    )
    return out.drop(body, words, lines, hashes, grams, ordered, twice)


def compiled(rules: tuple[Rule, ...] = RULES) -> dict[str, Column]:
    """One boolean column for each rule."""
    out = {}
    for r in rules:
        x = F.col(r.measure)
        tests = [x >= F.lit(r.low)] * (r.low is not None) + [x <= F.lit(r.high)] * (r.high is not None)
        passed = F.lit(True)
        for t in tests:
            passed = passed & t
        out[r.name] = passed
    return out


def rate(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every measure, ``base_failed``, ``failed_rules`` (names, comma-joined) and ``kept``; an empty table gives no rows."""
    out = measures(docs, text)
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    failed = F.concat_ws(",", *[F.when(~passed, F.lit(name)) for name, passed in compiled(rules).items()])
    out = out.withColumns({"base_failed": base, "failed_rules": failed})
    return out.withColumns({"kept": ~F.col("base_failed") & (F.col("failed_rules") == "")})


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's measures and verdict; null and empty texts have no words and fail."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rate(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")


ORACLE = r"""
with w as (
  select doc_id, coalesce(text, '') as body,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from documents),
g as (
  select *, len(words) as n,
         case when len(words) >= 5 then list_transform(range(1, len(words) - 3), lambda i: list_aggregate(words[i:i + 4], 'string_agg', ' ')) else [] end as grams
  from w),
e as (select doc_id, unnest(grams) as gram, unnest(range(0, len(grams))) as p from g),
t as (select doc_id, p from (select doc_id, p, count(*) over (partition by doc_id, gram) as c from e) where c >= 2),
r as (
  select doc_id, sum(least(5, coalesce(nxt - p, 5))) as n_repeat_words
  from (select doc_id, p, lead(p) over (partition by doc_id order by p) as nxt from t) group by doc_id),
m as (
  select g.doc_id, cast(n as bigint) as n_words,
         cast(length(coalesce(list_aggregate(words, 'string_agg', ''), '')) as bigint) as word_chars,
         cast(len(regexp_extract_all(body, '[#*$%&|<>]')) as bigint) as n_symbols,
         cast(len(lines) as bigint) as n_lines,
         cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
         cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words,
         len(list_filter(words, lambda x: lower(x) in ({stop_words}))) as n_stop
  from g left join r using (doc_id)),
v as (
  select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
    concat_ws(',',
      case when not n_words >= 10 then 'long_enough' end,
      case when not (case when n_words > 0 then word_chars / n_words else 0 end between 2e0 and 12e0) then 'word_length' end,
      case when not (case when n_words > 0 then n_symbols / n_words else 0 end <= 1e-1) then 'symbols' end,
      case when not (case when n_words > 0 then n_stop / n_words else 0 end >= 6e-2) then 'stop_words' end,
      case when not (case when n_lines > 0 then n_dup_lines / n_lines else 0 end <= 3e-1) then 'repeated_lines' end,
      case when not (case when n_words > 0 then n_repeat_words / n_words else 0 end <= 2e-1) then 'repeated_windows' end) as failed_rules
  from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and failed_rules = '' as kept, failed_rules
from v
""".replace("{stop_words}", ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS)))
