"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Every document of a source has the same expected number of copies, target / source size. Documents are ordered within
their source by classes of size, the expected copies are prefix-summed in fixed point, one offset of the source is
added, and a document is taken once for each integer boundary that its interval crosses. Prefix sums are taken in two
levels: chunks of (source, size class, part of the key), then documents within a chunk, so a source with a third of
all rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Fixed-point units of one copy.
UNIT = 1 << 24
#: A size class is split into one part for so many documents of its source, or into more of FEW_DOCS, up to FEW_PARTS.
PART_DOCS = 50_000
FEW_DOCS = 500
FEW_PARTS = 64
#: A part is the id modulo SPREAD_PRIME, times SPREAD modulo 2^32, without its low 16 bits, modulo the number of parts.
SPREAD_PRIME = 2_147_483_647
SPREAD = 2_654_435_761
#: Multiplier of the Weyl sequence of offsets, UNIT over the golden ratio, and the default seed.
GOLDEN = 10_368_889
SEED = 17


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """Targets by source: (source, source_size, n_docs, target, rate, start), from (source, source_size, n_docs).

    Sources in code-point order, null last, take ``weights`` in turn. The targets share the sum of all sizes by weight;
    a target stops at ``max_repeats`` times its source's size and the excess is shared again by weight among the
    others. rate and start are expected copies and offset in units of 1 / UNIT. One row a source is ordered in one
    task; documents are not. A source without words has target 0 and rate 0.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("rank", F.row_number().over(by_name) - 1).withColumn("weight", weight.cast("long")).withColumn("most", F.col("source_size") * max_repeats)
    every = Window.partitionBy()
    # those that stop are the first by most / weight; the level rises with each and is right after the last of them
    filled = Window.orderBy(F.col("most") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("all", F.sum("source_size").over(every)).withColumn("weights", F.sum("weight").over(every))
    s = s.withColumn("level", (F.col("all") - F.coalesce(F.sum("most").over(filled), F.lit(0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(filled), F.lit(0))))
    s = s.withColumn("level", F.max("level").over(every))
    s = s.withColumn("target", F.least(F.col("most").cast("double"), F.col("level") * F.col("weight")))
    rate = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * UNIT)).otherwise(0).cast("long")
    start = F.pmod((F.col("rank") + F.lit(seed)).cast("long") * GOLDEN, F.lit(UNIT)).cast("long")
    return s.select("source", "source_size", "n_docs", "target", rate.alias("rate"), start.alias("start"))


def systematic_copies(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """``rows`` (mix_id, mix_source, mix_size and other columns) with source_size, target and copies."""
    t = targets.select(F.col("source").alias("mix_source"), "source_size", "n_docs", "target", "rate", "start")
    parts = F.greatest(F.floor(F.col("n_docs") / PART_DOCS), F.least(F.floor(F.col("n_docs") / FEW_DOCS), F.lit(FEW_PARTS))) + 1
    mixed = F.pmod(F.coalesce("mix_id", "mix_size"), F.lit(SPREAD_PRIME)).cast("long") * F.lit(SPREAD)
    part = F.pmod(F.shiftright(mixed.bitwiseAND(F.lit((1 << 32) - 1)), 16), parts)
    keyed = rows.withColumnRenamed("mix_source", "own").join(t, F.col("own").eqNullSafe(F.col("mix_source"))).drop("own")
    keyed = keyed.withColumn("class", F.floor(F.sqrt("mix_size")).cast("long")).withColumn("part", part.cast("long"))
    key = ["start", "class", "part"]  # start tells the sources apart, and unlike them is never null
    sums = keyed.groupBy(*key).agg(F.count("*").alias("docs"))
    before = Window.partitionBy("start").orderBy("class", "part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*key, F.coalesce(F.sum("docs").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy(*key).orderBy("mix_size", "mix_id")
    placed = keyed.join(sums, key).withColumn("nth", F.col("before") + F.row_number().over(within))

    def boundary(n: Column) -> Column:
        return F.floor((n.cast("decimal(20,0)") * F.col("rate") + F.col("start")) / UNIT).cast("long")

    return placed.withColumn("copies", boundary(F.col("nth")) - boundary(F.col("nth") - 1)).drop(*key, "before", "nth", "n_docs", "rate")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """Each document with mix_size (words), source_size, target and copies; its own columns are in the struct ``row``.

    Null texts have size 0 and null sources form the last source. Null and repeated ids are ordinary rows. Reruns over
    the same rows give the same copies; equal rows may change places. An empty table gives an empty result.
    """
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs[id_col].cast("long").alias("mix_id"), docs[source_col].cast("string").alias("mix_source"), word_count(docs[text_col]).alias("mix_size"))
    sizes = rows.groupBy(F.col("mix_source").alias("source")).agg(F.sum("mix_size").alias("source_size"), F.count("*").alias("n_docs"))
    return systematic_copies(rows, source_targets(sizes, weights, max_repeats, seed))


def taken_documents(mixed: DataFrame) -> DataFrame:
    """The documents of a mix, each as often as it is taken."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s0),
s2 AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * {MAX_REPEATS} AS most FROM s1),
s3 AS (SELECT *, (CAST(sum(source_size) OVER () - coalesce(sum(most) OVER f, 0) AS DOUBLE))
          / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER f, 0) AS DOUBLE) AS lv
       FROM s2 WINDOW f AS (ORDER BY CAST(most AS DOUBLE) / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, least(CAST(most AS DOUBLE), max(lv) OVER () * weight) AS target FROM s3),
s5 AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size * {UNIT}) AS BIGINT) ELSE 0 END AS rate,
          ((rank + {SEED}) * {GOLDEN}) % {UNIT} AS start FROM s4),
p AS (SELECT d.doc_id, d.size, s5.source_size, s5.target, s5.rate, s5.start,
        row_number() OVER (PARTITION BY s5.rank ORDER BY floor(sqrt(d.size)), 
          ((coalesce(d.doc_id, d.size) % {SPREAD_PRIME} + {SPREAD_PRIME}) % {SPREAD_PRIME} * {SPREAD}) % 4294967296 // 65536 % (greatest(s5.n_docs // {PART_DOCS}, least(s5.n_docs // {FEW_DOCS}, {FEW_PARTS})) + 1),
          d.size, d.doc_id NULLS FIRST) AS nth
      FROM d JOIN s5 ON d.source IS NOT DISTINCT FROM s5.source)
SELECT doc_id, size, source_size, target,
  CAST(((nth * rate + start) // {UNIT} - ((nth - 1) * rate + start) // {UNIT}) * size AS BIGINT) AS taken FROM p
"""
