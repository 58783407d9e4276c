"""Operator 2, mixing sources to target weights: Pareto order sampling. DataFrame functions only.

Targets. Sources sorted by code point (null last) get ``weights`` in turn and share ``share_pct`` percent of all words.
A target stops at ``top`` times its source's words; the excess is shared anew by weight.

Copies. A document of bit-length class k is expected in ``min(top, c * (TILT + k))`` copies; c is set per source so that
the expected words are its target. Long documents are favoured a little, so that the sample's cut falls on a short
one. The whole part of the expectation is certain; the fraction is the inclusion probability p of one more copy.
Documents are ranked by random odds over inclusion odds, ``(u / (1 - u)) / (p / (1 - p))`` with u from md5 of the
id, and the sample takes them in this order up to the words that its source still lacks (a fixed size in words);
the document on the border is taken if that comes nearer.

How it runs. One narrow pass gives id, source and words. Everything else is sums per (source, class), per (source,
rank bucket), and one window inside the bucket where a source's cut falls; buckets hold some 50 000 rows whatever the
size of a source, so no source is a task of its own. The result of planning is one small row per source; applying
it to documents is a lookup, and text is never shuffled.

Null or empty texts have size 0 and are taken 0 words; a null source is a source of its own; a null id counts as an
empty one. Rows of one id, size and source share their fate. An empty table gives no rows. Copies of ``mixed`` rows
are whole rows, so extra columns, also with names used here, stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.llm.shared import WORD, cut, read, small_side

WEIGHTS = (3, 1, 2)
SHARE_PCT = 150
TOP = 2
TILT = 8
SEED = "mix-1"
BUCKET_ROWS = 50_000
#: Above this many sources the rules are joined by shuffle instead of broadcast (a row is below 2 KB).
SMALL_RULES = 5_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _class(size: Column) -> Column:
    return F.length(F.bin(size))


def _odds(doc_id: Column, p: Column) -> Column:
    """Random odds over inclusion odds; null without an inclusion probability."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)
    return F.when(p > 0, (u / (1.0 - u)) / (p / (1.0 - p)))


def source_targets(per_source: DataFrame, weights=WEIGHTS, share_pct: int = SHARE_PCT, top: int = TOP) -> DataFrame:
    """source, source_size, target from (source, source_size), one row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    ranked = per_source.select(
        "source", "source_size",
        F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1).alias("w"),
        F.sum("source_size").over(everything).alias("total"))
    # Sources fill up in the order of what they hold per weight.
    filling = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    earlier = filling.rowsBetween(Window.unboundedPreceding, -1)
    later = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = ((F.col("total") * share_pct / 100.0 - top * F.coalesce(F.sum("source_size").over(earlier), F.lit(0)))
             / F.sum("w").over(later))
    levels = ranked.withColumn("level", level).withColumn("open", F.col("level") * F.col("w") <= top * F.col("source_size"))
    found = levels.withColumn("common", F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(
        filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return found.select("source", "source_size", F.least(
        (top * F.col("source_size")).cast("double"),
        F.coalesce(F.col("common") * F.col("w"), (top * F.col("source_size")).cast("double"))).alias("target"))


def _expectations(classes: DataFrame, targets: DataFrame, top: int) -> DataFrame:
    """source, class, expected copies; classes has (source, class, held) with the words of each class."""
    both = classes.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    down = Window.partitionBy("source").orderBy(F.col("class").desc())
    fuller = down.rowsBetween(Window.unboundedPreceding, -1)
    rest = down.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    g = F.col("class") + TILT
    lacking = F.col("target") - top * F.coalesce(F.sum("held").over(fuller), F.lit(0))
    share = F.sum(g * F.col("held")).over(rest)
    leveled = both.withColumn("c", F.when(share > 0, lacking / share)).withColumn("open", F.col("c") * g <= top)
    common = F.first(F.when(F.col("open"), F.col("c")), ignorenulls=True).over(
        Window.partitionBy("source").orderBy(F.col("class").desc())
        .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return leveled.withColumn("common", common).withColumn("expected", F.coalesce(
        F.least(F.lit(float(top)), F.col("common") * g), F.lit(float(top))))


def plan_mix(sized: DataFrame, weights=WEIGHTS, share_pct: int = SHARE_PCT, top: int = TOP,
             bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One rule per source: source, source_size, target, expected (class -> copies), last (odds, id, size of the last taken).

    ``sized`` has doc_id, source and size, and is read three times.
    """
    classes = cut(sized.groupBy("source", _class(F.col("size")).alias("class"))
                  .agg(F.sum("size").alias("held"), F.count(F.lit(1)).alias("n")))
    per_source = classes.groupBy("source").agg(F.sum("held").alias("source_size"), F.sum("n").alias("n"))
    expected = _expectations(classes, source_targets(per_source, weights, share_pct, top), top)
    rules = cut(expected.groupBy("source").agg(
        F.first("source_size").alias("source_size"), F.first("target").alias("target"),
        F.greatest(F.lit(0.0), F.first("target") - F.sum(F.floor("expected") * F.col("held"))).alias("lacking"), F.sum("n").alias("n"),
        F.map_from_entries(F.collect_list(F.struct("class", "expected"))).alias("expected")))
    largest = rules.agg(F.max("n")).first()[0] or 0
    buckets = max(1, -(-largest // bucket_rows))

    ranked = _lookup(sized.select("doc_id", "source", "size"), rules)
    # Rows of the sample by rank; odds / (1 + odds) is monotone and below 1.
    ranked = (ranked.withColumn("odds", _odds(F.col("doc_id"), F.col("expected") - F.floor("expected")))
              .filter(F.col("odds").isNotNull())
              .withColumn("bucket", F.least(F.floor(F.col("odds") / (1.0 + F.col("odds")) * buckets), F.lit(buckets - 1))))
    filled = ranked.groupBy("source", "bucket").agg(F.sum("size").alias("held"), F.first("lacking").alias("lacking"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    border = (filled.withColumn("after", F.sum("held").over(upto))
              .filter((F.col("after") > F.col("lacking")) & (F.col("after") - F.col("held") <= F.col("lacking")))
              .select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), (F.col("after") - F.col("held")).alias("ahead")))
    near = (ranked.join(border, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b")))
            .groupBy("source", "odds", "doc_id", "size")
            .agg(F.sum("size").alias("held"), F.first("ahead").alias("ahead"), F.first("lacking").alias("lacking")))
    key = F.struct("odds", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "size")
    inside = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = F.col("ahead") + F.sum("held").over(inside)
    cuts = (near.withColumn("key", key).withColumn("after", after)
            .withColumn("taken", F.when(F.col("after") <= F.col("lacking"), True)
                        .otherwise(F.col("after") - F.col("held") / 2.0 <= F.col("lacking"))
                        & (F.col("after") - F.col("held") <= F.col("lacking")))
            # the first row of a border bucket may already be too much: nothing of the bucket is taken then
            .groupBy(F.col("source").alias("_s")).agg(
                F.max(F.when(F.col("taken"), F.col("key"))).alias("last"),
                F.min("key").alias("least")))
    return (rules.join(cuts, F.col("source").eqNullSafe(F.col("_s")), "left")
            .select("source", "source_size", "target", "expected", "last", "least",
                    F.col("_s").isNotNull().alias("bordered"), F.lit(buckets).alias("buckets"))
            .transform(cut))


def _lookup(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows with the rule of their source; ``expected`` becomes that of their size."""
    side = rules.withColumnsRenamed({"source": "_rule", "expected": "_levels"}).drop("n")
    joined = rows.join(small_side(side, SMALL_RULES), F.col("source").eqNullSafe(F.col("_rule")))
    return joined.withColumn("expected", F.element_at("_levels", _class(F.col("size")))).drop("_rule", "_levels")


def copies(sized: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows of ``sized`` with source_size, target and the copies that the mix takes."""
    got = _lookup(sized, rules)
    odds = _odds(F.col("doc_id"), F.col("expected") - F.floor("expected"))
    key = F.struct(odds.alias("odds"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("size"))
    once_more = F.when(odds.isNull(), False).when(~F.col("bordered"), True).when(
        F.col("last").isNotNull(), key <= F.col("last")).otherwise(key < F.col("least"))
    return (got.withColumn("copies", (F.floor("expected") + once_more.cast("long")).cast("long"))
            .drop("expected", "last", "least", "bordered", "buckets"))


def sized_documents(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", words(F.col("text")).alias("size"))


def mix_table(docs: DataFrame, weights=WEIGHTS, share_pct: int = SHARE_PCT, top: int = TOP) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken words of every document."""
    sized = cut(sized_documents(docs))
    return (copies(sized, plan_mix(sized, weights, share_pct, top))
            .withColumn("taken", F.col("copies") * F.col("size")))


def mixed(docs: DataFrame, weights=WEIGHTS, share_pct: int = SHARE_PCT, top: int = TOP) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with its columns."""
    rules = plan_mix(cut(sized_documents(docs)), weights, share_pct, top)
    whole = docs.select(F.struct("*").alias("_row"), "doc_id", "source", words(F.col("text")).alias("size"))
    # no filter: it would be pushed below the words' count and count them once more
    return copies(whole, rules).select("_row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("_row.*")


def op2_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mix_table(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def oracle(table: str = "documents") -> str:
    """The same mix by one ranking per source."""
    weights = ", ".join(map(str, WEIGHTS))
    return f"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM {table}),
per_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, ([{weights}])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1)] AS w,
           sum(source_size) OVER () AS total FROM per_source),
levels AS (SELECT *, (total * {SHARE_PCT} / 100.0::DOUBLE - {TOP} * coalesce(sum(source_size) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(w) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
           FROM ranked WINDOW f AS (ORDER BY source_size / w, source NULLS LAST)),
common AS (SELECT arg_min(level, (source_size / w, source)) FILTER (level * w <= {TOP} * source_size) AS level FROM levels),
targets AS (SELECT source, source_size, least({TOP} * source_size::DOUBLE, coalesce(c.level * w, {TOP} * source_size::DOUBLE)) AS target
            FROM levels, common c),
classes AS (SELECT source, len(bin(size)) AS class, sum(size)::BIGINT AS held FROM sized GROUP BY ALL),
shares AS (SELECT c.*, t.source_size, t.target,
           t.target - {TOP} * coalesce(sum(held) OVER (d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS lacking,
           (sum((class + {TILT}) * held) OVER (d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS share
           FROM classes c JOIN targets t ON c.source IS NOT DISTINCT FROM t.source
           WINDOW d AS (PARTITION BY c.source ORDER BY class DESC)),
coefficient AS (SELECT source, arg_max(lacking / share, class) FILTER (share > 0 AND lacking / share * (class + {TILT}) <= {TOP}) AS c
                FROM shares GROUP BY source),
expected AS (SELECT s.source, class, held, source_size, target,
             coalesce(least({TOP}.0::DOUBLE, k.c * (class + {TILT})), {TOP}.0::DOUBLE) AS e
             FROM shares s JOIN coefficient k ON s.source IS NOT DISTINCT FROM k.source),
lacks AS (SELECT source, greatest(0.0::DOUBLE, any_value(target) - sum(floor(e) * held)) AS lacking FROM expected GROUP BY source),
odds AS (SELECT d.doc_id, d.source, d.size, x.source_size, x.target, floor(x.e)::BIGINT AS sure,
         (('0x' || substr(md5('{SEED}:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / {1 << 52}.0::DOUBLE AS u,
         x.e - floor(x.e) AS p
         FROM sized d JOIN expected x ON d.source IS NOT DISTINCT FROM x.source AND len(bin(d.size)) = x.class),
q AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM odds),
upto AS (SELECT q.*, sum(CASE WHEN q IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY source
         ORDER BY q NULLS LAST, coalesce(doc_id::VARCHAR, ''), size)::BIGINT AS after FROM q),
decided AS (SELECT u.*, q IS NOT NULL AND (after <= lacking OR (after - size <= lacking AND after - size / 2.0::DOUBLE <= lacking)) AS more
            FROM upto u JOIN lacks l ON u.source IS NOT DISTINCT FROM l.source)
SELECT doc_id, size, source_size, target, (sure + more::INT) * size AS taken FROM decided"""


QUERIES = {"op2_pareto_mix": op2_pareto_mix}
ORACLES = {"op2_pareto_mix": oracle()}
