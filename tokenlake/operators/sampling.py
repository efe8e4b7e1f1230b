"""Temperature, top-k, categorical draws and generation with back-off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenlake.functions.storage import written
from tokenlake.operators import local_index, ngram


def uniform(*key: Column) -> Column:
    """A reproducible number in [0, 1) from the first 32 bits of md5 of the keys joined by ':'."""
    digest = F.md5(F.concat_ws(":", *[k.cast("string") for k in key]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0


def temperature(dist: DataFrame, by: list[str], t: Column | float, eps: float = 1e-12) -> DataFrame:
    """prob becomes exp(ln(prob + eps) / t), normalised within by."""
    t = F.lit(t) if not isinstance(t, Column) else t
    raw = dist.withColumn("prob", F.exp(F.log(F.col("prob") + eps) / t))
    return raw.withColumn("prob", F.col("prob") / F.sum("prob").over(Window.partitionBy(*by)))


def top_k(dist: DataFrame, by: list[str], k: Column | int) -> DataFrame:
    """The k likeliest, the lesser token of equals, normalised within by."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("prob"), "tok"))
    kept = dist.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")
    return kept.withColumn("prob", F.col("prob") / F.sum("prob").over(Window.partitionBy(*by)))


def draw(dist: DataFrame, by: list[str], u: Column) -> DataFrame:
    """(*by, tok): the first token, in token order, whose cumulative probability exceeds u."""
    w = Window.partitionBy(*by).orderBy("tok").rowsBetween(Window.unboundedPreceding, 0)
    summed = dist.withColumn("cdf", F.sum("prob").over(w)).withColumn("u", u)
    reached = summed.filter(F.col("cdf") > F.col("u")).groupBy(*by).agg(F.min("tok").alias("tok"))
    last = summed.groupBy(*by).agg(F.max("tok").alias("last"))  # rounding may leave the sum just below one
    return last.join(reached, by, "left").select(*by, F.coalesce("tok", "last").alias("tok"))


def generate(
    index: DataFrame, seeds: DataFrame, steps: int, max_context: int, t: float = 1.0, k: int = 50, seed: int = 0, fallback=None, local_values: int = 1 << 23,
) -> DataFrame:
    """(prompt_id, ids): seeds(prompt_id, ids) with `steps` tokens more; prompt_id is distinct and not null.

    Seeds may name their own temperature and top_k; t and k stand where they do not. A step takes the next-token
    distribution of the longest suffix of at most max_context tokens that the index knows.

    An index whose contexts up to max_context hold at most `local_values` tokens and counts, over all shards, is sent to
    the tasks (8 bytes each), and each task takes its sequences to their ends. With a larger one a step is one query for
    all sequences at once; the index and each step's sequences are written tables, so a step plans and computes
    itself only. Both give the same sequences.
    """
    has = seeds.columns
    settings = [(F.col("temperature") if "temperature" in has else F.lit(float(t))).alias("temperature"), (F.col("top_k") if "top_k" in has else F.lit(k)).alias("top_k")]
    # a temperature of one leaves shares as they are
    heated = "temperature" in has or t != 1.0
    now = seeds.select("prompt_id", "ids", *settings)
    merged = written(index.filter(F.col("n") <= max_context).groupBy("n", "ctx", "tok").agg(F.sum("cnt").alias("cnt")), "index")
    if (merged.agg(F.sum(F.col("n") + 3)).first()[0] or 0) <= local_values:
        sent = seeds.sparkSession.sparkContext.broadcast(local_index.LocalIndex(merged.toArrow()))
        run = local_index.generated(sent, steps, max_context, seed, heated, fallback)
        spread = now.repartition("prompt_id")  # a task's time grows with its sequences, not with the bytes of their seeds
        return spread.mapInArrow(run, now.select("prompt_id", "ids").schema)
    return _generate_by_steps(merged.withColumn("shard", F.lit(0)), now, steps, max_context, seed, heated, fallback)


def _generate_by_steps(index: DataFrame, now: DataFrame, steps: int, max_context: int, seed: int, heated: bool, fallback) -> DataFrame:
    """now(prompt_id, ids, temperature, top_k) with `steps` tokens more, a join with the index for each."""
    now = written(now, "sequences")
    for step in range(steps):
        asked = now.select("prompt_id", F.slice("ids", F.greatest(F.size("ids") - max_context + 1, F.lit(1)), max_context).alias("ids"))
        dist = ngram.ntd(index, asked).select("prompt_id", "tok", "prob").join(now.select("prompt_id", "temperature", "top_k"), "prompt_id")
        dist = written(dist, "distribution")
        dist = temperature(dist, ["prompt_id"], F.col("temperature")) if heated else dist
        picked = draw(top_k(dist, ["prompt_id"], F.col("top_k")), ["prompt_id"], uniform(F.lit(seed), F.col("prompt_id"), F.lit(step)))
        more = F.concat("ids", F.array(F.coalesce("tok", F.lit(fallback)))).alias("ids")
        now = written(now.join(picked, "prompt_id", "left").select("prompt_id", more, "temperature", "top_k"), "sequences")
    return now.select("prompt_id", "ids")


def sweep(seeds: DataFrame, temperatures: list[float], ks: list[int], samples: int = 1) -> DataFrame:
    """Each seed with each pair of settings, `samples` times; prompt_id becomes id:temperature:top_k:sample. The settings are literals, so nothing is joined."""
    every = [(float(t), k, n) for t in temperatures for k in ks for n in range(samples)]
    settings = F.array(*[F.struct(F.lit(t).alias("temperature"), F.lit(k).alias("top_k"), F.lit(n).alias("sample")) for t, k, n in every])
    out = seeds.select("*", F.explode(settings).alias("s"))
    name = F.concat_ws(":", F.col("prompt_id").cast("string"), F.col("s.temperature").cast("string"), F.col("s.top_k").cast("string"), F.col("s.sample").cast("string"))
    return out.select(name.alias("prompt_id"), "ids", "s.temperature", "s.top_k")
