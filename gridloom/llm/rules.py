"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Counts are taken over whole texts. A rule is a condition that rejects a document. The cost of each rule (seconds a
row) and its selectivity (share of rows that it rejects) are measured on a sample; rules are then tried in the order
of rejections per cost, and the first that rejects ends the matter. The order changes the work, never the verdict.

Repeated windows: each word becomes a 64-bit hash, each 8-word window the hash of its eight; only documents in
which a window's hash comes twice (hash set, linear) sort their windows to see which words these cover.

Defined results: null and empty texts have no words, so all counts are 0 and base_failed is true; rows are handled
one by one, so repeated rows give repeated rows; extra columns aren't read; an empty table gives no rows, and with no
sample the rules keep their given order.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import cut, table, words

SPAN = 8  # words of a window
SAMPLE = 2_000  # rows, about, on which costs are measured
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"


def bind(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def repeated_words(all_words: Column) -> Column:
    """Words that stand in a window of SPAN words which the text holds twice or more."""

    def covered(windows: Column) -> Column:
        placed = F.array_sort(F.transform(windows, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

        def twice(s: Column) -> Column:
            return F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["k"] == x["k"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["k"] == x["k"], F.lit(False)))

        places = F.array_sort(F.transform(bind(placed, twice), lambda x: x["i"]))
        steps = bind(places, lambda p: F.transform(p, lambda x, i: F.least(F.lit(SPAN), F.coalesce(F.get(p, i + 1) - x, F.lit(SPAN)))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - SPAN), lambda i: F.xxhash64(*[F.get(h, i + n) for n in range(SPAN)]))

    def count(h: Column) -> Column:
        found = bind(windows(h), lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), 0).otherwise(covered(k)))
        return F.when(F.size(h) <= SPAN, 0).otherwise(found)

    return bind(F.transform(all_words, lambda w: F.xxhash64(w)), count).cast("long")


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def counts(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, the text, and its counts."""
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    own = docs.select(*[F.col(f"`{c}`") for c in keep], t.alias("_text"))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.length(without(x, BLANKS)) > 0)
    numbers = bind(words(F.col("_text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    seen = bind(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    told = own.select(
        *keep, "_text", numbers.alias("_w"), seen.alias("_l"),
        F.length(without(F.col("_text"), BLANKS)).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(without(F.col("_text"), SYMBOLS))).cast("long").alias("n_symbols"),
    )
    return told.select(*keep, "_text", F.col("_w.n_words"), "word_chars", "n_symbols", F.col("_l.n_lines"), F.col("_l.n_dup_lines"), F.col("_w.n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))




def rules() -> dict[str, Column]:
    """What rejects a document besides the base rules; those that scan the text again cost most."""
    text = F.col("_text")
    return {
        "symbols": F.col("n_symbols") * 2 > F.col("n_words"),
        "duplicate_lines": F.col("n_dup_lines") * 10 > F.col("n_lines") * 3,
        "word_length": (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words")),
        "shouting": F.length(F.regexp_replace(text, r"\P{Lu}", "")) * 2 > F.col("word_chars"),
        "exclamations": (F.length(text) - F.length(without(text, "!"))) * 2 > F.col("n_words"),
        "ellipses": F.regexp_count(text, F.lit(r"(?:\.\.\.|…)")) * 5 > F.col("n_words"),
    }


def order(sample: DataFrame, of: dict[str, Column]) -> list[str]:
    """Rules by rejections per cost, as measured on a sample; ties by name."""

    def timed(*what: Column):
        began = time.perf_counter()
        row = sample.agg(F.count(F.lit(1)), *[F.sum(w.cast("int")) for w in what]).first()
        return time.perf_counter() - began, row

    timed()
    base, row = timed()
    if not row[0]:
        return list(of)
    score = {}
    for name, rule in of.items():
        took, found = timed(rule)
        score[name] = (found[1] or 0) / row[0] / max(took - base, 1e-4)
    return sorted(of, key=lambda k: (-score[k], k))


def cascade(of: dict[str, Column], names: list[str]) -> Column:
    """The name of the first rule that rejects; null if none does. Later rules aren't evaluated."""
    verdict = F.when(base_failed(), F.lit("base"))
    for name in names:
        verdict = verdict.when(of[name], F.lit(name))
    return verdict


def judge(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), of: dict[str, Column] | None = None) -> DataFrame:
    """The columns ``keep``, the counts, base_failed, rejected_by and kept of every row."""
    of = of or rules()
    total = docs.count()
    sample = cut(counts(docs.sample(min(1.0, SAMPLE / max(1, total)), seed=7), text, keep))
    verdict = cascade(of, order(sample, of))
    return counts(docs, text, keep).select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), verdict.alias("rejected_by"), verdict.isNull().alias("kept")).drop("_text")


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict for every document."""
    return judge(table(spark, sf_dir, "documents")).drop("rejected_by")


SQL = r"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
c as (
  select r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
w as (select r, unnest(ws) as word, unnest(range(0, len(ws))) as i from c),
k as (select r, i, list(word) over (partition by r order by i rows between current row and 7 following) as win from w),
g as (select r, i, count(*) over (partition by r, win) as n from k where len(win) = 8),
p as (select r, count(distinct i + o) as n_repeat_words from g, range(0, 8) t(o) where n > 1 group by r),
m as (
  select doc_id, t, cast(len(ws) as bigint) as n_words, cast(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
    cast(length(t) - length(translate(t, '#*$%&|<>', '')) as bigint) as n_symbols, len(ls) as n_lines,
    cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines, cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words
  from c left join p using (r)),
b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or n_symbols * 2 > n_words or n_dup_lines * 10 > n_lines * 3 or word_chars < 2 * n_words or word_chars > 15 * n_words
    or length(regexp_replace(t, '\P{Lu}', '', 'g')) * 2 > word_chars or (length(t) - length(replace(t, '!', ''))) * 2 > n_words
    or len(regexp_extract_all(t, '(?:\.\.\.|…)')) * 5 > n_words) as kept
from b
"""
