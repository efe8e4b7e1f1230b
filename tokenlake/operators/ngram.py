"""N-gram index and queries: counts, next-token distributions with longest-suffix back-off, shard merge.

The index is a count table (n, ctx, tok, shard, cnt), n = 0 .. N: how often tok follows the n tokens
ctx within a document. Queries are equi-joins of prompt suffixes with it, on a hash of the context and
then the context itself; every figure is an aggregate with map-side combining, so no context, however
frequent, meets in one task. Contexts never span documents; an end token is counted only if the
stream has one.

Contexts longer than the index reaches, up to `far` tokens, are counted on its stream, and only those that
some prompt asks for: a place of the stream meets a context once, however many prompts have it, so the work
grows with the stream and not with the stream times the prompts. Longer ones are cut into stretches of `far`
tokens; positions of the stream at which these stand one after the other are exact matches. All figures are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def contexts(stream: DataFrame, n: int, width: int = 65536) -> DataFrame:
    """(shard, doc_id, pos, tok, before): before holds up to n tokens before tok, the nearest last.

    A document is dealt over tasks in ranges of `width` places; a range gets the n tokens before it as well.
    """
    width = max(width, n)
    part = F.floor(F.col("pos") / width)
    parts = F.when(F.pmod(F.col("pos"), F.lit(width)) >= width - n, F.array(part, part + 1)).otherwise(F.array(part))
    dealt = stream.select("shard", "doc_id", "pos", "tok", F.explode(parts).alias("part"))
    w = Window.partitionBy("doc_id", "part").orderBy("pos").rowsBetween(-n, -1)
    before = dealt.withColumn("before", F.collect_list("tok").over(w))
    return before.filter(F.col("part") == part).select("shard", "doc_id", "pos", "tok", "before")


def build_index(stream: DataFrame, n: int) -> DataFrame:
    """Counts for all context lengths 0 .. n."""
    sizes = F.sequence(F.lit(0), F.least(F.size("before"), F.lit(n)))
    long = contexts(stream, n).select("shard", "tok", "before", F.explode(sizes).alias("n"))
    ctx = F.when(F.col("n") > 0, F.slice("before", F.size("before") - F.col("n") + 1, F.col("n"))).otherwise(F.slice("before", 1, 0))
    return long.select("n", ctx.alias("ctx"), "tok", "shard").groupBy("n", "ctx", "tok", "shard").agg(F.count("*").alias("cnt"))


def _counts_asked(stream: DataFrame, asked: DataFrame, least: int, most: int) -> DataFrame:
    """What build_index has at the contexts of asked(n, ctx), least <= n <= most, and at a few others whose hashes are the same.

    The hashes of the asked contexts, eight bytes each, go to every task, so that only rows that some prompt needs are counted.
    """
    own = F.broadcast(asked.select(F.xxhash64("n", "ctx").alias("h")).distinct())
    reach = F.least(F.size("before"), F.lit(most))
    sizes = F.when(reach >= least, F.sequence(F.lit(least), reach))
    rows = contexts(stream, most).select("shard", "tok", "before", F.explode(sizes).alias("n"))
    ctx = F.slice("before", F.size("before") - F.col("n") + 1, F.col("n"))
    rows = rows.select("n", ctx.alias("ctx"), "tok", "shard").withColumn("h", F.xxhash64("n", "ctx")).join(own, "h", "left_semi")
    return rows.groupBy("n", "ctx", "tok", "shard").agg(F.count("*").alias("cnt"))


def _longest(prompts: DataFrame) -> int:
    return prompts.agg(F.max(F.size("ids"))).first()[0] or 0


def _meet(left: DataFrame, right: DataFrame, on: list[str], array: str) -> DataFrame:
    """Equi-join on `on` and on an array column: by its hash, then by the array itself."""
    key = f"{array}_hash"
    a, b = left.withColumn(key, F.xxhash64(array)), right.withColumn(key, F.xxhash64(array)).withColumnRenamed(array, "_other")
    return a.join(b, [*on, key]).filter(F.col(array) == F.col("_other")).drop("_other", key)


def count(index: DataFrame, prompts: DataFrame, group: int = 1, stream: DataFrame | None = None, reach: int | None = None, far: int = 64) -> DataFrame:
    """(prompt_id, cnt, approx): occurrences of prompts(prompt_id, ids); all but the last token are the context.

    Counts are taken per group of `group` shards, then summed; approx is always false. An empty sequence stands at
    every token. Sequences of more than `reach` + 1 tokens, where the index holds contexts up to `reach`, are
    counted on the stream that it was built from; without a stream they are an error.
    """
    size = F.size("ids")
    asks = lambda p: p.select("prompt_id", (size - 1).alias("n"), F.slice("ids", 1, F.greatest(size - 1, F.lit(0))).alias("ctx"), F.element_at("ids", -1).alias("tok"))
    if reach is not None and stream is None:
        kept = prompts.withColumn("ids", F.when(size <= reach + 1, F.col("ids")).otherwise(F.raise_error(F.lit("a prompt is longer than the index reaches"))))
    else:
        kept = prompts if reach is None else prompts.filter(size <= reach + 1)
    hits = _meet(asks(kept.filter(size > 0)), index, ["n", "tok"], "ctx").select("prompt_id", "shard", "cnt")
    longest = _longest(prompts) if reach is not None and stream is not None else 0
    far = max(far, reach or 0)
    if longest and longest > reach + 1:
        more = asks(prompts.filter((size > reach + 1) & (size <= far + 1)))
        hits = hits.unionByName(_meet(more, _counts_asked(stream, more, reach + 1, min(far, longest - 1)), ["n", "tok"], "ctx").select("prompt_id", "shard", "cnt"))
    per = hits.groupBy("prompt_id", F.floor(F.col("shard") / group).alias("grp")).agg(F.sum("cnt").alias("cnt"))
    total = per.groupBy("prompt_id").agg(F.sum("cnt").alias("cnt"))
    empty = kept.filter(size == 0).select("prompt_id", index.filter("n = 0").agg(F.sum("cnt").alias("cnt")).select("cnt").scalar().alias("cnt"))
    total = total.unionByName(empty)
    if longest > far + 1:
        total = total.unionByName(_count_long(stream, prompts.filter(size > far + 1), far + 1))
    out = prompts.select("prompt_id").join(total, "prompt_id", "left")
    return out.select("prompt_id", F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"), F.lit(False).alias("approx"))


def _count_long(stream: DataFrame, prompts: DataFrame, width: int) -> DataFrame:
    """(prompt_id, cnt) of prompts of at least `width` tokens: places at which all their stretches of `width` tokens stand."""
    m = F.size("ids")
    steps = F.ceil(m / width).cast("int")
    # the last stretch ends with the prompt and may overlap the one before
    at = F.transform(F.sequence(F.lit(0), steps - 1), lambda k: F.least(k * width, m - width))
    asked = prompts.select("prompt_id", steps.alias("steps"), "ids", F.explode(at).alias("from")).select("prompt_id", "steps", "from", F.slice("ids", F.col("from") + 1, F.lit(width)).alias("run"))
    runs = contexts(stream, width - 1).filter(F.size("before") == width - 1).select("doc_id", (F.col("pos") - width + 1).alias("pos"), F.concat("before", F.array("tok")).alias("run"))
    hits = _meet(runs, asked, [], "run").groupBy("prompt_id", "steps", "doc_id", (F.col("pos") - F.col("from")).alias("start")).agg(F.count("*").alias("n"))
    return hits.filter("n = steps").groupBy("prompt_id").agg(F.count("*").alias("cnt"))


def _matches_long(stream: DataFrame, prompts: DataFrame, width: int) -> DataFrame:
    """(prompt_id, shard, n, tok, cnt): what follows the longest matches, of at least `width` tokens, of prompts' ends.

    Stretches of `width` tokens are taken from the prompt's end; a place that matches the first j of them is
    extended token by token into the next. Only places with the most stretches of their shard are.
    """
    m = F.size("ids")
    js = F.sequence(F.lit(0), (F.floor(m / width) - 1).cast("int"))
    asked = prompts.filter(m >= width).select("prompt_id", "ids", F.explode(js).alias("j")).select("prompt_id", "j", F.slice("ids", m - (F.col("j") + 1) * width + 1, F.lit(width)).alias("before"))
    rows = contexts(stream, width)
    hits = _meet(rows.filter(F.size("before") == width), asked, [], "before").select("prompt_id", "shard", "doc_id", (F.col("pos") + F.col("j") * width).alias("at"), "j", F.when(F.col("j") == 0, F.col("tok")).alias("tok"))
    places = hits.groupBy("prompt_id", "shard", "doc_id", "at").agg(F.sort_array(F.collect_set("j")).alias("js"), F.max("tok").alias("tok"))
    full = F.size(F.filter("js", lambda x, i: x == i))
    places = places.withColumn("full", full).filter("full > 0")
    most = places.groupBy("prompt_id", "shard").agg(F.max("full").alias("full"))
    places = places.join(most, ["prompt_id", "shard", "full"]).withColumn("pos", (F.col("at") - F.col("full") * width).cast("int"))
    ends = places.join(rows.select("doc_id", "pos", "before"), ["doc_id", "pos"]).join(prompts.select("prompt_id", "ids"), "prompt_id")
    left = F.reverse(F.slice("ids", F.greatest(m - (F.col("full") + 1) * width + 1, F.lit(1)), F.greatest(F.least(F.lit(width), m - F.col("full") * width), F.lit(0))))
    same = F.zip_with(F.reverse("before"), left, lambda a, b: F.coalesce(a == b, F.lit(False)))
    extra = F.coalesce(F.array_position(same, False) - 1, F.lit(0))
    extra = F.when(F.array_position(same, False) == 0, F.size(same)).otherwise(extra)
    out = ends.withColumn("n", (F.col("full") * width + extra).cast("int"))
    best = out.groupBy("prompt_id", "shard").agg(F.max("n").alias("n"))
    return out.join(best, ["prompt_id", "shard", "n"]).groupBy("prompt_id", "shard", "n", "tok").agg(F.count("*").alias("cnt"))


def ntd(
    index: DataFrame, prompts: DataFrame, max_support: int | None = None, group: int | None = None, back_off: bool = True,
    stream: DataFrame | None = None, reach: int | None = None, far: int = 64,
) -> DataFrame:
    """(prompt_id, tok, cont_cnt, prob, prompt_cnt, suffix_len): what follows the longest supported suffix of each prompt.

    Shards are taken in groups of `group` (all together without): each group backs off by itself,
    the longest suffix of all groups wins, and the groups that reached it are summed. At most
    max_support tokens are kept, by count and then token; shares are of the untruncated count.
    Suffixes longer than the `reach` tokens that the index holds are looked for on its stream, if given.
    """
    size = F.size("ids")
    longest = size if reach is None else F.least(size, F.lit(reach))
    suffix = prompts.select("prompt_id", "ids", F.explode(F.sequence(F.lit(0), longest) if back_off else F.array(size)).alias("n"))
    ctx = F.when(F.col("n") > 0, F.slice("ids", size - F.col("n") + 1, F.col("n"))).otherwise(F.slice("ids", 1, 0))
    hits = _meet(suffix.select("prompt_id", "n", ctx.alias("ctx")), index, ["n"], "ctx").select("prompt_id", "shard", "n", "tok", "cnt")
    most = _longest(prompts) if reach and stream is not None else 0
    far = max(far, reach or 0)
    if reach and most > reach:
        longer = F.sequence(F.lit(reach + 1), F.least(size, F.lit(far))) if back_off else F.array(size)
        asked = prompts.filter((size > reach) & (F.lit(back_off) | (size <= far))).select("prompt_id", "ids", F.explode(longer).alias("n")).select("prompt_id", "n", ctx.alias("ctx"))
        if far > reach:
            hits = hits.unionByName(_meet(asked, _counts_asked(stream, asked, reach + 1, min(far, most)), ["n"], "ctx").select("prompt_id", "shard", "n", "tok", "cnt"))
    if reach and most > far:
        more = _matches_long(stream, prompts.filter(size > far), far)
        if not back_off:
            more = more.join(prompts.select("prompt_id", size.alias("n")), ["prompt_id", "n"])
        hits = hits.unionByName(more.filter(F.col("n") > far))
    grp = F.floor(F.col("shard") / group) if group else F.lit(0)
    per = hits.groupBy("prompt_id", grp.alias("grp"), "n", "tok").agg(F.sum("cnt").alias("cnt"))
    top = per.groupBy("prompt_id").agg(F.max("n").alias("n"))
    merged = per.join(top, ["prompt_id", "n"]).groupBy("prompt_id", F.col("n").alias("suffix_len"), "tok").agg(F.sum("cnt").alias("cont_cnt"))
    totals = merged.groupBy("prompt_id").agg(F.sum("cont_cnt").alias("prompt_cnt"))
    out = merged.join(totals, "prompt_id").select("prompt_id", "tok", "cont_cnt", (F.col("cont_cnt") / F.col("prompt_cnt")).alias("prob"), "prompt_cnt", F.col("suffix_len").cast("long").alias("suffix_len"))
    if max_support:
        rank = F.row_number().over(Window.partitionBy("prompt_id").orderBy(F.desc("cont_cnt"), "tok"))
        out = out.withColumn("rank", rank).filter(F.col("rank") <= max_support).drop("rank")
    return out
