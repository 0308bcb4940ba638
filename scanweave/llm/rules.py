"""Quality rules with thresholds that follow the corpus: DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from scanweave.llm.base import stored

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: measure: (numerator, denominator, least spread, whether small values are outliers too). Ratios are in thousandths.
MEASURES = {
    "word_length": ("word_chars", "n_words", 200, True),
    "symbols": ("n_symbols", "word_chars", 25, False),
    "dup_lines": ("n_dup_lines", "n_lines", 150, False),
    "repeats": ("n_repeat_words", "n_words", 60, False),
}
#: Standard deviation of a word's length, in thousandths: a mean over n words has 1 / sqrt(n) of it as further spread.
WORD_SPREAD = 2200
FINE = 32  # buckets from one power of two to the next: values are known to one part in 32


def _bound(value: Column, then) -> Column:
    """``then(value)`` with the value worked out once, however often ``then`` uses it."""
    return F.transform(F.array(value), then)[0]


def _repeated(words: Column, hashes: Column, width: int) -> Column:
    """Number of words in windows of ``width`` that occur twice or more, from the hash of each window.

    Windows are sorted by hash and compared word by word with their neighbours; the places of equal ones are then
    added up as a union of ranges.
    """
    def window(s: Column) -> Column:
        return F.slice(words, s["at"] + 1, width)

    def same(s: Column, t: Column) -> Column:
        return F.coalesce((s["h"] == t["h"]) & (window(s) == window(t)), F.lit(False))

    sorted_ = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    places = _bound(sorted_, lambda a: F.transform(F.filter(
        a, lambda s, k: (F.when(k > 0, same(s, a[k - 1])).otherwise(False)) | same(s, F.get(a, k + 1))), lambda s: s["at"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(F.sort_array(places), start, lambda a, p: F.struct(
        (a["n"] + F.least(F.lit(width), p + width - a["end"])).alias("n"), (p + width).alias("end")), lambda a: a["n"])


def text_measures(docs: DataFrame, keys: list[str], text_col: str = "text", width: int = 5) -> DataFrame:
    """(*keys, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) of every whole text.

    A null text has no words. Documents without a repeated window are told by the number of distinct hashes.
    """
    t = docs.select(*keys, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t"))
    t = t.withColumn("_w", F.filter(F.split("_t", SPACE), lambda w: w != ""))
    t = t.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    t = t.withColumn("_h", F.when(F.size("_w") >= width, F.transform(
        F.sequence(F.lit(0), F.size("_w") - width), lambda i: F.xxhash64(*[F.col("_w")[i + j] for j in range(width)])))
        .otherwise(F.array().cast("array<bigint>")))
    return t.select(
        *keys, F.size("_w").cast("long").alias("n_words"), F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"), F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("_h")) == F.size("_h"), 0).otherwise(_repeated(F.col("_w"), F.col("_h"), width))
        .cast("long").alias("n_repeat_words"))


def bucket(x: Column) -> Column:
    """The sketch's bucket of a whole number from 0 on: exact below 2 * FINE, then FINE a power of two."""
    shift = F.greatest(F.length(F.bin(x)) - 6, F.lit(0))
    return (F.lit(FINE) * shift + F.call_function("shiftright", x, shift)).cast("int")


def bucket_top(b: Column) -> Column:
    """The largest number in a bucket."""
    shift = F.greatest(F.floor(b / FINE) - 1, F.lit(0)).cast("int")
    return F.call_function("shiftleft", (b - FINE * shift + 1).cast("long"), shift) - 1


def sketches(measured: DataFrame, by: list[str]) -> DataFrame:
    """(level, *by, measure, bucket, n): quantile sketches of the groups ``by``, of those of ``by[:-1]``, ... and of all.

    A sketch is the counts of its buckets, at most about 2,000 whatever the rows. It merges by adding: tasks count
    before they shuffle, and a level is made from the sketches of the one below, not from rows.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket")) for m in MEASURES]))
    finest = (measured.select(*by, cells.alias("c")).groupBy(*by, "c.measure", "c.bucket").agg(F.count(F.lit(1)).alias("n")))
    level = finest.withColumn("level", F.lit(len(by)))
    out = level
    for k in range(len(by) - 1, -1, -1):
        gone = [F.lit(None).cast(measured.schema[c].dataType).alias(c) for c in by[k:]]
        level = (level.groupBy(*by[:k], "measure", "bucket").agg(F.sum("n").alias("n"))
                 .select(F.lit(k).alias("level"), *by[:k], *gone, "measure", "bucket", "n"))
        out = out.unionByName(level)
    return out


def fences(sketch: DataFrame, by: list[str], spreads: int) -> DataFrame:
    """(level, *by, rows, <measure>_low, <measure>_high): ``spreads`` quartile distances beyond the quartiles.

    The distance counts as its measure's least spread at least, so that a group of equal values has some room.
    """
    whole = Window.partitionBy("level", *by, "measure")
    s = (sketch.withColumn("rows", F.sum("n").over(whole))
         .withColumn("seen", F.sum("n").over(whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
         .withColumn("top", bucket_top(F.col("bucket"))))

    def quartile(m: str, k: int) -> Column:
        return F.min(F.when((F.col("measure") == m) & (4 * F.col("seen") >= k * F.col("rows")), F.col("top")))

    q = s.groupBy("level", *by).agg(F.max("rows").alias("rows"), *[
        quartile(m, k).alias(f"{m}_q{k}") for m in MEASURES for k in (1, 3)])
    out = [F.col("level"), *by, F.col("rows")]
    for m, (_, _, least, both) in MEASURES.items():
        reach = spreads * F.greatest(F.col(f"{m}_q3") - F.col(f"{m}_q1"), F.lit(least).cast("long"))
        low = F.col(f"{m}_q1") - reach if both else F.lit(None).cast("long")
        out += [low.alias(f"{m}_low"), (F.col(f"{m}_q3") + reach).alias(f"{m}_high")]
    return q.select(*out)


def resolved(groups: DataFrame, limits: DataFrame, by: list[str], least_rows: int) -> DataFrame:
    """(g_<by>, *limits) of every group: its own fences from ``least_rows`` rows on, else those of the level above."""
    names = [c for c in limits.columns if c not in ("level", "rows", *by)]
    out = groups.select(*[F.col(c).alias(f"g_{c}") for c in by], F.lit(None).cast("struct<" + ",".join(f"{c}:bigint" for c in names) + ">").alias("f"))
    for k in range(len(by), -1, -1):
        enough = F.lit(True) if k == 0 else F.col("rows") >= least_rows
        at = limits.where((F.col("level") == k) & enough).select(
            *[F.col(c).alias(f"l_{c}") for c in by[:k]], F.struct(*names).alias("own"), F.lit(1).alias("one"))
        on = F.lit(1) == F.col("one")  # the one row of the whole corpus, else a row a group
        for c in by[:k]:
            on = on & F.col(f"g_{c}").eqNullSafe(F.col(f"l_{c}"))
        if k == 0:
            row = at.select("own.*").first()
            own = F.struct(*[F.lit(row[c] if row else None).cast("long").alias(c) for c in names])
            out = out.withColumn("f", F.coalesce("f", own))
        else:
            out = out.join(at, on, "left").withColumn("f", F.coalesce("f", "own")).select(*[f"g_{c}" for c in by], "f")
    return out.select(*[f"g_{c}" for c in by], "f.*")


def apply_rules(docs: DataFrame, by: tuple[str, ...] = ("lang", "source"), id_col: str = "doc_id", text_col: str = "text",
                least_words: int = 10, repeat_percent: int = 20, spreads: int = 3, least_rows: int = 100,
                broadcast_groups: int = 100_000, salts: int = 64) -> DataFrame:
    """(doc_id, *by, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, *measures, *fences,
    base_failed, kept) of every row of ``docs``.

    ``base_failed``: fewer than ``least_words`` words, or more than ``repeat_percent`` percent of them in repeated
    windows. All others fill the quantile sketches of their language and source, and are kept if each measure lies
    within ``spreads`` quartile distances of the quartiles of its group (and as many standard errors of a mean over its
    words, where short words are outliers too). A group of fewer than ``least_rows`` such
    documents takes the fences of its language, a small language those of the corpus.

    A null text has no words and fails. A null language or source is a group like any other. Repeated rows count as
    often as they are there and have a row each; a null id is a row like any other. An empty table gives an empty
    result. Other columns of ``docs`` don't matter. The fences, a row a group, are sent to all tasks up to
    ``broadcast_groups`` rows; beyond, they are joined with each group dealt over ``salts`` parts.
    """
    by = list(by)
    m = text_measures(docs.select(F.col(id_col).alias("doc_id"), *by, F.col(text_col).alias("_text")), ["doc_id", *by], "_text")
    m = m.withColumn("base_failed", (F.col("n_words") < least_words)
                     | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words")))
    for name, (over, under, _, _) in MEASURES.items():
        m = m.withColumn(name, F.when(F.col(under) > 0, F.floor(1000 * F.col(over) / F.greatest(F.col(under), F.lit(1)))).cast("long"))
    m = stored(m)
    limits = stored(fences(sketches(m.where("not base_failed"), by), by, spreads))
    groups = stored(resolved(m.select(*by).distinct(), limits, by, least_rows))
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"g_{c}"))
    if groups.count() <= broadcast_groups:
        joined = m.join(F.broadcast(groups), on)
    else:
        joined = (m.withColumn("_salt", F.floor(F.rand(7) * salts).cast("int"))
                  .join(groups.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), on & (F.col("_salt") == F.col("_s")))
                  .drop("_salt", "_s"))
    fine = ~F.col("base_failed")
    for name, (_, _, _, both) in MEASURES.items():
        room = F.floor(spreads * WORD_SPREAD / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))) if both else F.lit(0)
        fine = fine & (F.col(name) >= F.coalesce(F.col(f"{name}_low") - room, name)) & (F.col(name) <= F.coalesce(F.col(f"{name}_high") + room, name))
    return joined.withColumn("kept", F.coalesce(fine, ~F.col("base_failed"))).drop(*[f"g_{c}" for c in by])


OP11_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS k, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
windows AS (SELECT k, i, w[i:i + 4] AS five FROM (SELECT k, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
places AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, five) AS n FROM windows) WHERE n > 1),
covered AS (SELECT k, count(*) AS n FROM (SELECT DISTINCT k, i + j AS p FROM places, range(5) r(j)) GROUP BY k),
m AS (SELECT k, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
      CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
      CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN covered c USING (k)),
r AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
      1000 * word_chars // nullif(n_words, 0) AS word_length, 1000 * n_symbols // nullif(word_chars, 0) AS symbols,
      1000 * n_dup_lines // nullif(n_lines, 0) AS dup_lines, 1000 * n_repeat_words // nullif(n_words, 0) AS repeats FROM m),
long AS (UNPIVOT (SELECT lang, source, word_length, symbols, dup_lines, repeats FROM r WHERE NOT base_failed)
         ON word_length, symbols, dup_lines, repeats INTO NAME measure VALUE x),
cells AS (SELECT lang, source, measure, greatest(length(bin(x)) - 6, 0) AS e, x FROM long),
topped AS (SELECT lang, source, measure, (((x >> e) + 1) << e) - 1 AS top FROM cells),
grouped AS (SELECT 2 AS level, lang, source, measure, top FROM topped UNION ALL
            SELECT 1, lang, NULL, measure, top FROM topped UNION ALL SELECT 0, NULL, NULL, measure, top FROM topped),
seen AS (SELECT *, count(*) OVER (PARTITION BY level, lang, source, measure) AS n,
         row_number() OVER (PARTITION BY level, lang, source, measure ORDER BY top) AS i FROM grouped),
q AS (SELECT level, lang, source, measure, n, min(top) FILTER (4 * i >= n) AS q1, min(top) FILTER (4 * i >= 3 * n) AS q3
      FROM seen GROUP BY ALL),
lim AS (SELECT level, lang, source, max(n) AS n,
      max(q1 - 3 * greatest(q3 - q1, 200)) FILTER (measure = 'word_length') AS word_length_low,
      max(q3 + 3 * greatest(q3 - q1, 200)) FILTER (measure = 'word_length') AS word_length_high,
      max(q3 + 3 * greatest(q3 - q1, 25)) FILTER (measure = 'symbols') AS symbols_high,
      max(q3 + 3 * greatest(q3 - q1, 150)) FILTER (measure = 'dup_lines') AS dup_lines_high,
      max(q3 + 3 * greatest(q3 - q1, 60)) FILTER (measure = 'repeats') AS repeats_high FROM q GROUP BY ALL),
found AS (SELECT r.*, least(greatest(coalesce(a.n, 0) // 100, 0), 1) AS has_own, least(coalesce(b.n, 0) // 100, 1) AS has_lang,
      a AS a, b AS b, c AS c
      FROM r LEFT JOIN lim a ON a.level = 2 AND a.lang IS NOT DISTINCT FROM r.lang AND a.source IS NOT DISTINCT FROM r.source
      LEFT JOIN lim b ON b.level = 1 AND b.lang IS NOT DISTINCT FROM r.lang LEFT JOIN lim c ON c.level = 0),
chosen AS (SELECT *, CASE WHEN has_own = 1 THEN a WHEN has_lang = 1 THEN b ELSE c END AS f FROM found)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND coalesce(word_length >= f.word_length_low - CAST(floor(6600 / sqrt(n_words)) AS BIGINT)
        AND word_length <= f.word_length_high + CAST(floor(6600 / sqrt(n_words)) AS BIGINT)
        AND symbols <= f.symbols_high AND dup_lines <= f.dup_lines_high AND repeats <= f.repeats_high, true) AS kept
FROM chosen
"""
