"""Quality rules with cross-document line frequency. DataFrame functions only.

Rules on one document: words, their characters, symbols, repeated lines, and words in repeated
three-word windows; too few words or too much repetition fails. Rules across documents: lines
are normalised (lower case, white space run together) and hashed; for each host the documents
that hold a line are counted, each different text once; lines on more than ``max_docs`` and on
more than ``max_share`` of a host's texts are boilerplate and are removed; a document that
loses more than ``max_lost`` of its characters is depleted and rejected.

A document's repeated windows are found inside its own row (hashes sorted with their places,
neighbours compared), so words are never shuffled; lines travel as hashes, counted with partial
aggregation. The few lines above the limits are joined under a salt from the document.

Nulls, ties and odd inputs: a null text has no words and fails; a null host is a host of its
own; rows that repeat a document get the same verdict and count once; an empty table gives an
empty result. Columns other than ``doc_id``, ``text`` and ``source`` are carried only if named
in ``carry``, in a struct of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mixing import WORD

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\f\r"
SALTS = 32


def _lines(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def _line_hash(line: Column) -> Column:
    return F.xxhash64(F.lower(F.regexp_replace(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " "), "^ | $", "")))


def features(docs: DataFrame, *keep: Column) -> DataFrame:
    """The counts of each row's text, beside the columns ``keep``; docs has ``text`` without nulls."""
    split = docs.select(*keep, "text", F.regexp_extract_all("text", F.lit(WORD), 0).alias("_w"), _lines(F.col("text")).alias("_l"))
    w = F.col("_w")
    windows = F.when(F.size(w) >= 3, F.transform(F.slice(w, 1, F.size(w) - 2), lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))))
    counted = split.select(
        *[F.col(c) for c in docs.select(*keep).columns],
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.sort_array(windows).alias("_s"),
    )
    s = F.col("_s")
    same = counted.withColumn("_p", F.sort_array(F.transform(F.filter(s, lambda x, i: F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False))), lambda x: x["i"])))
    p = F.col("_p")
    covered = F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return same.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_s", "_p")


def quality_rules(docs: DataFrame, min_words: int = 50, max_repeat_percent: int = 50, max_docs: int = 20, max_share: float = 0.2, max_lost: float = 0.5, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the counts, base_failed, lost_chars and kept of each row; with ``carry`` also clean_text and ``carried``."""
    rows = docs.select(
        "doc_id",
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("host"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *([F.struct(*carry).alias("carried")] if carry else []),
    )
    key = F.xxhash64(F.col("doc_id"), F.col("text"), F.col("host")).alias("_key")
    lines = rows.select(
        "host", key, F.xxhash64("text").alias("copy"), F.explode(F.transform(_lines(F.col("text")), lambda x, i: F.struct(_line_hash(x).alias("line"), F.length(x).alias("chars"), i.alias("place")))).alias("x")
    ).select("host", "_key", "copy", "x.line", "x.chars", "x.place")
    sizes = rows.select("host", F.xxhash64("text").alias("copy")).distinct().groupBy("host").agg(F.count("*").alias("texts"))
    spread = lines.select("host", "line", "copy").distinct().groupBy("host", "line").agg(F.count("*").alias("held")).where(F.col("held") > max_docs)
    common = spread.join(sizes, "host").where(F.col("held") > max_share * F.col("texts")).select("host", "line", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    lost = (
        lines.withColumn("salt", F.pmod("_key", F.lit(SALTS)).cast("int"))
        .join(common, ["host", "line", "salt"])
        .groupBy("_key", "copy", "place")  # rows that repeat a document have one key and lose their lines once
        .agg(F.first("chars").alias("chars"), F.first("line").alias("line"))
        .groupBy("_key", "copy")
        .agg(F.sum("chars").alias("lost"), F.collect_set("line").alias("common"))
    )
    counted = features(rows, F.col("doc_id"), key, F.xxhash64("text").alias("copy"), F.length("text").alias("chars"), *([F.col("text").alias("whole"), F.col("carried")] if carry else []))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    out = counted.join(lost, ["_key", "copy"], "left").withColumn("base_failed", failed)
    out = out.withColumn("lost_chars", F.coalesce("lost", F.lit(0)).cast("long"))
    # Not a conjunction: a filter on part of it would move below the counts and compute them anew for each use.
    out = out.withColumn("kept", F.when(F.col("base_failed"), False).otherwise(F.col("lost_chars") <= max_lost * F.col("chars")))
    extra = []
    if carry:
        clean = F.array_join(F.filter(F.split("whole", "\n"), lambda x: ~F.array_contains("common", _line_hash(x))), "\n")
        extra = [F.when(F.col("common").isNull(), F.col("whole")).otherwise(clean).alias("clean_text"), "carried"]
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_chars", "kept", *extra)


#: DuckDB: the same counts by unnesting words and lines.
ORACLE = r"""
with rows as (
  select doc_id, coalesce('=' || source, '') as host, coalesce(text, '') as text, row_number() over () as r from documents),
words as (
  select r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from rows),
grams as (
  select r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select r, w, unnest(range(1, len(w) - 1)) as i from words)),
twice as (
  select r, i from (select r, i, count(*) over (partition by r, g) as n from grams) where n > 1),
covered as (
  select r, count(distinct i + k) as n from twice, (values (0), (1), (2)) t(k) group by r),
lines as (
  select q.r, host, text, lower(regexp_replace(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'), '^ | $', '', 'g')) as line, length(x) as chars
  from (select r, unnest(l) as x from words) q join rows using (r)),
texts as (
  select host, count(distinct text) as n from rows group by host),
common as (
  select host, line from lines join texts using (host) group by host, line, n having count(distinct text) > 20 and count(distinct text) > 0.2 * n),
lost as (
  select r, sum(chars) as lost from lines semi join common using (host, line) group by r)
select doc_id, len(w)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
  (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words,
  len(w) < 50 or 100 * coalesce(n, 0) > 50 * len(w) as base_failed, coalesce(lost, 0)::bigint as lost_chars,
  not (len(w) < 50 or 100 * coalesce(n, 0) > 50 * len(w)) and coalesce(lost, 0) <= 0.5 * length(text) as kept
from rows join words using (r) left join covered using (r) left join lost using (r)
"""
