"""Queries over token streams, n-gram counts, sampling and memorisation, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenlake.functions.storage import shared_dir, written
from tokenlake.operators import evaluation, ngram, sampling, stream
from tokenlake.sources import images, token_files, token_source
from tokenlake.streaming import tokens as streaming

END = "<end>"
PROMPTS = [
    (1, ["view", "click", "view", "view", "purchase", "click"]),
    (2, ["signup", "error"]),
    (3, ["none", "view"]),
    (4, ["click", "none"]),
]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark, sf):
    return stream.stream_of(table(spark, sf, "events"), "user_id", ["ts", "event_id"], F.col("event_type"), 4, F.to_date("ts"))


def turns(spark, sf):
    return stream.stream_of(table(spark, sf, "conversations"), "conv_id", ["turn", "role"], F.col("role"), 4)


def lines(spark, sf):
    return stream.stream_of(table(spark, sf, "lineitem"), "l_orderkey", ["l_linenumber"], F.concat("l_returnflag", "l_linestatus"), 4)


def words(spark, sf, first=None):
    return stream.words(table(spark, sf, "documents"), first=first)


def folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def prompts(spark, rows=PROMPTS):
    return spark.createDataFrame(rows, "prompt_id long, ids array<string>")


def index(spark, sf, n=6):
    return ngram.build_index(events(spark, sf), n)


EVT = "tok AS (SELECT user_id AS doc_id, user_id % 4 AS shard, event_type AS tok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events)"
CONV = "tok AS (SELECT conv_id AS doc_id, conv_id % 4 AS shard, role AS tok, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS pos FROM conversations)"
WORDS = (
    "raw AS (SELECT doc_id, list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: w <> '') AS l FROM documents), "
    "tok AS (SELECT doc_id, unnest(l) AS tok, unnest(range(len(l))) AS pos FROM raw)"
)
CTX = "ctx AS (SELECT shard, tok, coalesce(list(tok) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), []) AS b FROM tok)"
_VALUES = ", ".join(f"({i}, {ids!r})" for i, ids in PROMPTS)


def _ntd_sql(values: str, grp: str = "0", most: int | None = None) -> str:
    rank = f"QUALIFY row_number() OVER (PARTITION BY prompt_id ORDER BY cont_cnt DESC, tok) <= {most}" if most else ""
    return f"""
WITH {EVT}, {CTX}, p(prompt_id, ids) AS (VALUES {values}),
s AS (SELECT prompt_id, n, ids[len(ids) - n + 1:] AS c FROM (SELECT prompt_id, ids, unnest(range(len(ids) + 1)) AS n FROM p)),
per AS (SELECT prompt_id, {grp} AS grp, n, tok, count(*) AS cnt FROM s JOIN ctx ON len(b) >= n AND (n = 0 OR b[len(b) - n + 1:] = c) GROUP BY ALL),
top AS (SELECT prompt_id, max(n) AS n FROM per GROUP BY 1),
m AS (SELECT prompt_id, n, tok, sum(cnt)::BIGINT AS cont_cnt FROM per JOIN top USING (prompt_id, n) GROUP BY ALL)
SELECT prompt_id::BIGINT AS prompt_id, tok, cont_cnt, cont_cnt / sum(cont_cnt) OVER (PARTITION BY prompt_id) AS prob,
       (sum(cont_cnt) OVER (PARTITION BY prompt_id))::BIGINT AS prompt_cnt, n AS suffix_len
FROM m {rank}"""


_COUNT_SQL = f"""
WITH {EVT}, {CTX}, p(prompt_id, ids) AS (VALUES {_VALUES}, (5, ['view', 'view']), (6, ['error']), (7, []))
SELECT prompt_id::BIGINT AS prompt_id, count(tok) AS cnt, false AS approx
FROM p LEFT JOIN ctx ON len(ids) = 0 OR (tok = ids[-1] AND len(b) >= len(ids) - 1 AND (len(ids) = 1 OR b[len(b) - len(ids) + 2:] = ids[:-2])) GROUP BY 1"""

#: Prompts longer than the index reaches: the first twenty tokens of some users, the same behind a token of their own, and what stands nowhere.
_LONG = f"""
WITH {EVT}, far AS (SELECT shard, doc_id, pos, tok, coalesce(list(tok) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 21 PRECEDING AND 1 PRECEDING), []) AS b FROM tok),
own AS (SELECT doc_id, list(tok ORDER BY pos) AS ids FROM tok WHERE doc_id % 100 = 0 AND pos < 20 GROUP BY doc_id),
p AS (SELECT doc_id * 10 AS prompt_id, ids FROM own UNION ALL SELECT doc_id * 10 + 1, list_concat(['none'], ids) FROM own
  UNION ALL SELECT doc_id * 10 + 2, ids[:9] FROM own UNION ALL SELECT doc_id * 10 + 3, list_concat(ids[11:], ids[:7]) FROM own UNION ALL SELECT doc_id * 10 + 4, ids[:3] FROM own)"""

_COUNT_LONG = f"""{_LONG}
SELECT prompt_id, count(tok) AS cnt, false AS approx FROM p LEFT JOIN far ON tok = ids[-1] AND len(b) >= len(ids) - 1 AND b[len(b) - len(ids) + 2:] = ids[:-2] GROUP BY 1"""

_NTD_LONG = f"""{_LONG},
s AS (SELECT prompt_id, n, ids[len(ids) - n + 1:] AS c FROM (SELECT prompt_id, ids, unnest(range(len(ids) + 1)) AS n FROM p)),
per AS (SELECT prompt_id, n, tok, count(*) AS cnt FROM s JOIN far ON len(b) >= n AND (n = 0 OR b[len(b) - n + 1:] = c) GROUP BY ALL),
m AS (SELECT * FROM per QUALIFY n = max(n) OVER (PARTITION BY prompt_id))
SELECT prompt_id, tok, cnt AS cont_cnt, cnt / sum(cnt) OVER (PARTITION BY prompt_id) AS prob, (sum(cnt) OVER (PARTITION BY prompt_id))::BIGINT AS prompt_cnt, n AS suffix_len FROM m"""


def _generate_sql(seeds: str, steps: int, context: int, seed: int) -> str:
    """CTEs s0 .. s<steps>(prompt_id, ids, t, k): seeds and what each step adds to them."""
    out = [EVT, CTX, f"s0 AS ({seeds})"]
    for i in range(steps):
        out.append(
            f"""q{i} AS (SELECT prompt_id, t, k, n, ids[len(ids) - n + 1:] AS c FROM (SELECT *, unnest(range(least(len(ids), {context}) + 1)) AS n FROM s{i})),
per{i} AS (SELECT prompt_id, t, k, n, tok, count(*) AS cnt FROM q{i} JOIN ctx ON len(b) >= n AND (n = 0 OR b[len(b) - n + 1:] = c) GROUP BY ALL),
d{i} AS (SELECT *, cnt / sum(cnt) OVER (PARTITION BY prompt_id) AS prob FROM (SELECT * FROM per{i} QUALIFY n = max(n) OVER (PARTITION BY prompt_id))),
h{i} AS (SELECT *, q / sum(q) OVER (PARTITION BY prompt_id) AS share FROM (SELECT *, exp(ln(prob + 1e-12) / t) AS q FROM d{i})),
k{i} AS (SELECT * FROM h{i} QUALIFY row_number() OVER (PARTITION BY prompt_id ORDER BY share DESC, tok) <= k),
f{i} AS (SELECT prompt_id, tok, sum(share) OVER (PARTITION BY prompt_id ORDER BY tok) / sum(share) OVER (PARTITION BY prompt_id) AS cdf FROM k{i}),
w{i} AS (SELECT prompt_id, coalesce(min(tok) FILTER (cdf > ('0x' || substr(md5('{seed}:' || prompt_id || ':{i}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE), max(tok)) AS tok FROM f{i} GROUP BY prompt_id),
s{i + 1} AS MATERIALIZED (SELECT prompt_id, list_append(ids, tok) AS ids, t, k FROM s{i} JOIN w{i} USING (prompt_id))"""
        )
    return "WITH " + ", ".join(out)

_NUMBERED = (
    CONV + ", d AS (SELECT shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS doc, list(CASE tok WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 3 END ORDER BY pos) AS t FROM tok GROUP BY shard, doc_id)"
)
_SIX = "list_concat(t[:6], list_transform(range(greatest(0, 6 - len(t))), lambda x: 9))"

_SAMPLED = f"""
WITH {EVT}, bi AS (SELECT lag(tok) OVER (PARTITION BY doc_id ORDER BY pos) AS ctx, tok FROM tok),
d AS (SELECT ctx, tok, count(*) / sum(count(*)) OVER (PARTITION BY ctx) AS prob FROM bi WHERE ctx IS NOT NULL GROUP BY ctx, tok),
r AS (SELECT ctx, tok, exp(ln(prob + 1e-12) / 0.7) AS q FROM d), t AS (SELECT ctx, tok, q / sum(q) OVER (PARTITION BY ctx) AS prob FROM r),
k AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY ctx ORDER BY prob DESC, tok) <= 3),
f AS (SELECT ctx, tok, prob / sum(prob) OVER (PARTITION BY ctx) AS prob FROM k)
"""


def _bigrams(spark, sf):
    pairs = index(spark, sf, 1).filter("n = 1").select(F.col("ctx")[0].alias("ctx"), "tok", "cnt").groupBy("ctx", "tok").agg(F.sum("cnt").alias("cnt"))
    totals = pairs.groupBy("ctx").agg(F.sum("cnt").alias("total"))
    dist = pairs.join(totals, "ctx").select("ctx", "tok", (F.col("cnt") / F.col("total")).alias("prob"))
    return sampling.top_k(sampling.temperature(dist, ["ctx"], 0.7), ["ctx"], 3)


def q_scan_filter_ext(spark, sf):
    path = F.regexp_replace("url", r"[?#].*$", "")
    pages = table(spark, sf, "pages").select("page_id", images.extension(path).alias("ext"))
    return pages.filter(F.col("ext").isin("html", "htm", "php"))


def q_limit_by_index(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang").orderBy("doc_id").limit(100)


def q_shard_range_split(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.groupBy(stream.range_shard(F.col("doc_id"), docs.count(), 7).alias("shard")).agg(F.count("*").alias("docs"), F.min("doc_id").alias("first"))


def q_shard_round_robin(spark, sf):
    return table(spark, sf, "documents").groupBy((F.col("doc_id") % 7).alias("shard")).agg(F.count("*").alias("docs"))


def q_label_default(spark, sf):
    joined = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return joined.select("doc_id", F.coalesce("quality", F.lit(-1)).cast("long").alias("label"))


def _flat(spark, sf):
    docs = turns(spark, sf).groupBy("shard", "doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "tok"))).alias("t")).select("shard", "doc_id", F.col("t.tok").alias("tokens"))
    return stream.flatten(docs, END)


def q_flat_stream(spark, sf):
    return _flat(spark, sf).select("shard", "doc_id", F.col("pos").cast("long").alias("pos"), "tok")


def q_split_stream(spark, sf):
    return stream.split_flat(stream.flat_places(_flat(spark, sf)), END).select("shard", "doc", F.col("pos").cast("long").alias("pos"), "tok")


def q_doc_offsets(spark, sf):
    return stream.offsets(lines(spark, sf).groupBy("doc_id").agg(F.count("*").alias("n")))


def q_fixed_offsets(spark, sf):
    return stream.fixed_offsets(table(spark, sf, "documents"), 256)


def q_union_shards(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("parent"))
    return stream.union_shards(n, table(spark, sf, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")))


def q_sort_by_index(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "source", "n_chars").orderBy("doc_id")


def q_shard_merge_stats(spark, sf):
    docs = table(spark, sf, "documents").select((F.col("doc_id") % 4).alias("shard"), "n_chars")
    return docs.rollup("shard").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"))


def q_unigram_dist(spark, sf):
    return stream.distribution(words(spark, sf))


def q_first_token_dist(spark, sf):
    return stream.distribution(stream.first_tokens(words(spark, sf, 1)))


def _labelled(spark, sf):
    return stream.first_tokens(words(spark, sf, 1)).join(table(spark, sf, "labels"), "doc_id", "left").select(F.coalesce("quality", F.lit(-1)).cast("long").alias("label"), "tok")


def q_class_first_token(spark, sf):
    return stream.distribution(_labelled(spark, sf), ["label"])


def q_class_fallback(spark, sf):
    """Classes 1 and 7, the second of which no document has."""
    classes = spark.createDataFrame([(1,), (7,)], "label long")
    return stream.class_distribution(_labelled(spark, sf), classes)


def q_fit_length(spark, sf):
    docs = turns(spark, sf).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "tok"))).alias("t"))
    return docs.select("doc_id", F.array_join(stream.fit_length(F.col("t.tok"), 5, "pad"), " ").alias("tokens"))


def q_token_u16(spark, sf):
    return table(spark, sf, "events").select("event_id", stream.as_u16(F.col("event_id") * 7919).alias("tok"))


def q_merge_shards(spark, sf):
    """Four shards written, merged in the order of ids, and deleted."""
    docs, root = table(spark, sf, "documents").select("doc_id", "source", "n_chars"), folder(spark, "merge")
    paths = [f"{root}/shard-{k}" for k in range(4)]
    for k, path in enumerate(paths):
        docs.filter(F.col("doc_id") % 4 == k).write.parquet(path)
    merged = stream.merge_shards(spark, paths, f"{root}/whole", "doc_id", delete=True)
    return merged.withColumn("shards_left", F.lit(sum(token_files.exists(spark, p) for p in paths)))


def _numbered(spark, sf):
    """(shard, doc_id, tokens): conversations with small numbers for roles."""
    number = F.when(F.col("tok") == "user", 1).when(F.col("tok") == "assistant", 2).otherwise(3)
    docs = turns(spark, sf).withColumn("tok", number).groupBy("shard", "doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "tok"))).alias("t"))
    return docs.select("shard", "doc_id", F.col("t.tok").alias("tokens"))


def _equal(spark, sf):
    return _numbered(spark, sf).withColumn("tokens", stream.fit_length(F.col("tokens"), 6, 9))


def _read(docs):
    return docs.select(F.col("shard").cast("long").alias("shard"), "doc", F.array_join(F.col("tokens").cast("array<string>"), " ").alias("tokens"))


def q_flat_file(spark, sf):
    """Written as flat files and read back in ranges of 64 bytes."""
    path = folder(spark, "flat")
    token_files.write_flat(_numbered(spark, sf), path)
    return _read(token_files.read_flat(spark, f"{path}/*.bin", size=64))


def q_headered_file(spark, sf):
    path = folder(spark, "headered")
    token_files.write_headered(_equal(spark, sf), path)
    return _read(token_files.read_headered(spark, f"{path}/*.bin", size=64))


def q_npy_file(spark, sf):
    path = folder(spark, "npy")
    token_files.write_npy(_equal(spark, sf), path)
    return _read(token_files.read_npy(spark, f"{path}/*.npy", size=64))


def q_offsets_file(spark, sf):
    path = folder(spark, "offsets")
    token_files.write_offsets(_numbered(spark, sf), path)
    raw = spark.read.format("binaryFile").load(f"{path}/*.offset").select(F.regexp_extract("path", r"([0-9]+)\.offset$", 1).cast("long").alias("shard"), F.hex("content").alias("x"), "length")
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.expr("length div 8") - 1))
    digits = F.concat(*[F.substring("y", 15 - 2 * k, 2) for k in range(8)])
    return raw.select("shard", "x", at.alias("doc")).withColumn("y", F.expr("substring(x, doc * 16 + 1, 16)")).select("shard", "doc", F.conv(digits, 16, 10).cast("long").alias("offset"))


def q_concat_shards(spark, sf):
    """The flat files of all shards as one, read back."""
    path = folder(spark, "concat")
    token_files.write_flat(_numbered(spark, sf), f"{path}/shards")
    token_files.concat_files(spark, f"{path}/shards/*.bin", f"{path}/whole/tokenized.0")
    docs = token_files.read_flat(spark, f"{path}/whole/tokenized.0", size=256)
    return docs.select("doc", F.array_join(F.col("tokens").cast("array<string>"), " ").alias("tokens"))


def _told(docs):
    return docs.select(F.col("shard").cast("long").alias("shard"), "start", F.array_join(F.col("tokens").cast("array<string>"), " ").alias("tokens"))


def q_source_flat(spark, sf):
    """Two shards' flat files through SQL: a view of the data source, in ranges of 64 bytes."""
    path = folder(spark, "source")
    token_files.write_flat(_numbered(spark, sf), path)
    token_source.register(spark)
    view = f"tokens_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TEMPORARY VIEW {view} USING tokens OPTIONS (path '{path}', shards '00001,00003', range '64')")
    return _told(spark.sql(f"SELECT * FROM {view}"))


def q_source_headered(spark, sf):
    path = folder(spark, "source")
    token_files.write_headered(_equal(spark, sf), path)
    token_source.register(spark)
    return _told(spark.read.format("tokens").option("layout", "headered").option("range", 64).load(path))


def q_source_npy(spark, sf):
    path = folder(spark, "source")
    token_files.write_npy(_equal(spark, sf), path)
    token_source.register(spark)
    return _told(spark.read.format("tokens").option("layout", "npy").option("range", 64).load(path))


def _texts_of(docs):
    return docs.groupBy(F.array_join(F.col("tokens").cast("array<string>"), " ").alias("tokens")).agg(F.count("*").alias("docs"))


def q_source_append(spark, sf):
    """Two writes of the data source, the second behind the first, read back."""
    path = folder(spark, "source")
    token_source.register(spark)
    for _ in range(2):
        _numbered(spark, sf).select("tokens").write.format("tokens").mode("append").save(path)
    return _texts_of(spark.read.format("tokens").load(path))


def q_source_stream(spark, sf):
    """Flat files as a stream into flat files; started again, it finds nothing new."""
    path = folder(spark, "source")
    token_files.write_flat(_numbered(spark, sf), f"{path}/in")
    token_source.register(spark)
    for _ in range(2):
        arriving = spark.readStream.format("tokens").load(f"{path}/in")
        arriving.writeStream.format("tokens").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    return _texts_of(spark.read.format("tokens").load(f"{path}/out"))


def q_documents_in(spark, sf):
    path = folder(spark, "sizes")
    token_files.write_flat(_equal(spark, sf), path)
    return token_files.documents_in(spark, f"{path}/*.bin", 6).select(F.regexp_extract("path", r"([0-9]+)\.bin$", 1).cast("long").alias("shard"), "docs")


def q_config_roundtrip(spark, sf):
    path = folder(spark, "config")
    token_files.write_config(spark, path, vocab_size=256, separator_token=65535, num_images=table(spark, sf, "part").count())
    known = token_files.read_config(spark, path)
    return spark.createDataFrame([(k, v) for k, v in known.items()], "setting string, value long")


def q_dataset_info(spark, sf):
    return token_files.dataset_info(table(spark, sf, "nation").select("n_nationkey", "n_name"))


def q_catalogue_resume(spark, sf):
    """Of three data sets the first is there already."""
    root = folder(spark, "catalogue")
    entries = [{"name": n, "expected_size": k} for n, k in (("region", 5), ("nation", 25), ("supplier", 0))]
    table(spark, sf, "region").write.parquet(f"{root}/region")
    todo = token_files.catalogue(spark, entries, root)
    return spark.createDataFrame([(k, e["name"], e["expected_size"]) for k, e in enumerate(todo)], "place long, name string, expected_size long")


def q_shard_names(spark, sf):
    return spark.createDataFrame([(k, n) for k, n in enumerate(images.shard_names("train-{i:05d}-of-{n:05d}.parquet", 3, 4, 40))], "place long, name string")


def q_progress(spark, sf):
    """Documents with a label as done, of all, at a second for each thousand characters."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", F.lit(1).alias("done")), "doc_id", "left")
    sums = docs.groupBy("source").agg(F.sum(F.coalesce("done", F.lit(0))).alias("done"), F.count("*").alias("total"), (F.sum("n_chars") / 1000.0).alias("seconds"))
    return sums.select("source", evaluation.progress(F.col("done"), F.col("total"), F.col("seconds")).alias("p")).select("source", *[F.round(f"p.{k}", 6).alias(k) for k in ("rate", "percent", "eta")])


def q_stage_shares(spark, sf):
    stages = table(spark, sf, "documents").groupBy("lang", "source").agg(F.sum("n_chars").alias("seconds"))
    return evaluation.shares(stages, ["lang"], "seconds").select("lang", "source", F.round("percent", 6).alias("percent"))


def q_distinct_tokens(spark, sf):
    return words(spark, sf).agg(F.countDistinct("tok").alias("words"), F.count("*").alias("tokens"))


def q_first_n_tokens(spark, sf):
    return words(spark, sf, 20).select("doc_id", F.col("pos").cast("long").alias("pos"), "tok")


def q_ngram_index(spark, sf):
    return index(spark, sf, 3).select(F.col("n").cast("long").alias("n"), F.concat_ws(" ", "ctx").alias("ctx"), "tok", "shard", "cnt")


def q_suffix_order(spark, sf):
    """Where each run of three tokens would begin in a sorted suffix table; sorted are the distinct runs only."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(0, 2)
    runs = events(spark, sf).select(F.concat_ws(" ", F.collect_list("tok").over(w)).alias("suffix")).groupBy("suffix").agg(F.count("*").alias("cnt"))
    return stream.running_total(runs, ["suffix"], "cnt", "first")


def _asked(spark):
    return prompts(spark, [*PROMPTS, (5, ["view", "view"]), (6, ["error"]), (7, [])])


def _long_prompts(spark, sf):
    own = events(spark, sf).filter("doc_id % 100 = 0 and pos < 20").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "tok"))).alias("t")).select("doc_id", F.col("t.tok").alias("ids"))
    kinds = ["ids", "concat(array('none'), ids)", "slice(ids, 1, 9)", "concat(slice(ids, 11, 20), slice(ids, 1, 7))", "slice(ids, 1, 3)"]
    rows = own.select(F.explode(F.array(*[F.struct((F.col("doc_id") * 10 + k).alias("prompt_id"), F.expr(x).alias("ids")) for k, x in enumerate(kinds)])).alias("p"))
    return written(rows.select("p.*"), "prompts")


def q_count_long(spark, sf):
    """Sequences of up to 21 tokens with an index of contexts up to three."""
    return ngram.count(index(spark, sf, 3), _long_prompts(spark, sf), stream=events(spark, sf), reach=3)


def q_ntd_long(spark, sf):
    return ngram.ntd(index(spark, sf, 3), _long_prompts(spark, sf), stream=events(spark, sf), reach=3)


def _stored(spark, sf):
    """An index stored by shard: two shards, then all, of which two are there already."""
    path, tokens = folder(spark, "index"), written(events(spark, sf), "tokens")
    build = lambda k: ngram.build_index(tokens.filter(F.col("shard") == k), 6)
    first = token_files.build_shards(spark, path, [0, 1], build)
    rest = token_files.build_shards(spark, path, [0, 1, 2, 3], build)
    if (first, rest) != ([0, 1], [2, 3]):
        raise RuntimeError("shards that were there were built again")
    return path


def q_ntd_stored(spark, sf):
    return ngram.ntd(token_files.read_index(spark, _stored(spark, sf)), prompts(spark), group=1)


def q_index_subset(spark, sf):
    """Shards 1 and 2 of a stored index."""
    some = token_files.read_index(spark, _stored(spark, sf), 1, 2)
    return some.groupBy("shard", "n").agg(F.count("*").alias("contexts"), F.sum("cnt").alias("cnt")).select(F.col("shard").cast("long").alias("shard"), F.col("n").cast("long").alias("n"), "contexts", "cnt")


def q_count_prompt(spark, sf):
    return ngram.count(index(spark, sf), _asked(spark))


def q_count_merge(spark, sf):
    return ngram.count(index(spark, sf), _asked(spark), group=2)


def q_ntd_unigram(spark, sf):
    return ngram.ntd(index(spark, sf, 0), prompts(spark, [(0, [])]))


def q_ntd_longest_suffix(spark, sf):
    return ngram.ntd(index(spark, sf), prompts(spark))


def q_ntd_shard_merge(spark, sf):
    return ngram.ntd(index(spark, sf), prompts(spark), group=1)


def q_ntd_unsharded(spark, sf):
    one = ngram.build_index(events(spark, sf).withColumn("shard", F.lit(0)), 6)
    return ngram.ntd(one, prompts(spark))


def q_ntd_max_support(spark, sf):
    return ngram.ntd(index(spark, sf), prompts(spark), max_support=2, group=2)


def q_temperature_topk(spark, sf):
    return _bigrams(spark, sf).select("ctx", "tok", F.round("prob", 9).alias("prob"))


def q_cdf_sample(spark, sf):
    return sampling.draw(_bigrams(spark, sf), ["ctx"], sampling.uniform(F.lit(7), F.col("ctx")))


def _seeds(spark, sf):
    kinds = table(spark, sf, "events").select("event_type").distinct()
    return kinds.select(F.crc32("event_type").alias("prompt_id"), F.array("event_type").alias("ids"))


def q_greedy_generate(spark, sf):
    counts = index(spark, sf, 1)
    out = sampling.generate(counts, _seeds(spark, sf), 6, 1, k=1)
    return out.select("prompt_id", F.concat_ws(" ", "ids").alias("text"))


def q_backoff_generate(spark, sf):
    out = sampling.generate(index(spark, sf, 4), _seeds(spark, sf), 4, 4, t=0.9, k=3, seed=5)
    return out.select("prompt_id", F.concat_ws(" ", "ids").alias("text"))


def q_generate_long(spark, sf):
    """Sequences of 40 tokens, three samples of each seed, from contexts of up to six tokens."""
    seeds = sampling.sweep(_seeds(spark, sf), [1.1], [4], 3)
    return sampling.generate(index(spark, sf, 6), seeds, 40, 6, seed=11).select("prompt_id", F.concat_ws(" ", "ids").alias("text"))


def q_generate_by_steps(spark, sf):
    """As backoff_generate, with an index taken to be too large to send."""
    out = sampling.generate(index(spark, sf, 4), _seeds(spark, sf), 4, 4, t=0.9, k=3, seed=5, local_values=0)
    return out.select("prompt_id", F.concat_ws(" ", "ids").alias("text"))


def q_param_sweep(spark, sf):
    """Every seed with every pair of settings, two samples each."""
    out = sampling.generate(index(spark, sf, 2), sampling.sweep(_seeds(spark, sf), [0.7, 1.0, 1.3], [2, 3, 50], 2), 2, 2, seed=9)
    return out.select("prompt_id", F.concat_ws(" ", "ids").alias("text"))


def _two(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    return docs.filter("source = 'src0'"), docs.filter("source <> 'src0'")


def q_memorized_docs(spark, sf):
    made, corpus = _two(spark, sf)
    return evaluation.memorised(made, corpus, "text").select("doc_id")


def q_novel_docs(spark, sf):
    made, corpus = _two(spark, sf)
    return evaluation.novel(made, corpus, "text").select("doc_id")


def q_memorization_rate(spark, sf):
    made, corpus = _two(spark, sf)
    total = made.agg(F.count("*")).scalar()
    return evaluation.memorised(made, corpus, "text").agg(F.count("*").alias("copies")).select("copies", F.round(F.col("copies") / total, 9).alias("rate"))


def q_stream_unigram(spark, sf):
    # a pattern, since a stream's plain path has to be a folder and this one may be a file
    return streaming.running_unigram(streaming.file_stream(spark, f"{sf}/event[s].parquet"), "event_type")


SQL = {
    "scan_filter_ext": "SELECT * FROM (SELECT page_id, lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '\\.([^./]+)$', 1)) AS ext FROM pages) WHERE ext IN ('html', 'htm', 'php')",
    "limit_by_index": "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 100",
    "shard_range_split": "SELECT least(doc_id // ((SELECT count(*) FROM documents) // 7), 6)::BIGINT AS shard, count(*) AS docs, min(doc_id) AS first FROM documents GROUP BY 1",
    "shard_round_robin": "SELECT doc_id % 7 AS shard, count(*) AS docs FROM documents GROUP BY 1",
    "label_default": "SELECT doc_id, coalesce(quality, -1)::BIGINT AS label FROM documents LEFT JOIN labels USING (doc_id)",
    "flat_stream": f"WITH {CONV} SELECT shard, doc_id, pos, tok FROM tok UNION ALL SELECT shard, doc_id, count(*) AS pos, '{END}' AS tok FROM tok GROUP BY shard, doc_id",
    "split_stream": f"WITH {CONV} SELECT shard, dense_rank() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS doc, pos, tok FROM tok",
    "doc_offsets": "WITH n AS (SELECT l_orderkey AS doc_id, count(*) AS n FROM lineitem GROUP BY 1) SELECT doc_id, (sum(n + 1) OVER (ORDER BY doc_id) - n - 1)::BIGINT AS \"offset\" FROM n",
    "fixed_offsets": 'SELECT doc_id, doc_id * 257 AS "offset" FROM documents',
    "union_shards": "SELECT n_nationkey AS key, n_name AS name, n_regionkey AS parent FROM nation UNION ALL SELECT r_regionkey, r_name, NULL FROM region",
    "sort_by_index": "SELECT doc_id, source, n_chars FROM documents ORDER BY doc_id",
    "shard_merge_stats": "SELECT shard, count(*) AS docs, sum(n_chars)::BIGINT AS chars, max(n_chars) AS longest FROM (SELECT doc_id % 4 AS shard, n_chars FROM documents) GROUP BY ROLLUP (shard)",
    "unigram_dist": f"WITH {WORDS} SELECT tok, count(*) AS cnt, count(*) / sum(count(*)) OVER () AS prob FROM tok GROUP BY tok",
    "first_token_dist": f"WITH {WORDS} SELECT tok, count(*) AS cnt, count(*) / sum(count(*)) OVER () AS prob FROM tok WHERE pos = 0 GROUP BY tok",
    "class_first_token": f"WITH {WORDS} SELECT coalesce(quality, -1)::BIGINT AS label, tok, count(*) AS cnt, count(*) / sum(count(*)) OVER (PARTITION BY coalesce(quality, -1)) AS prob FROM tok LEFT JOIN labels USING (doc_id) WHERE pos = 0 GROUP BY coalesce(quality, -1), tok",
    "class_fallback": f"""WITH {WORDS}, f AS (SELECT coalesce(quality, -1)::BIGINT AS label, tok FROM tok LEFT JOIN labels USING (doc_id) WHERE pos = 0)
SELECT label, tok, count(*) AS cnt, count(*) / sum(count(*)) OVER (PARTITION BY label) AS prob FROM f WHERE label = 1 GROUP BY label, tok
UNION ALL SELECT 7, tok, count(*), count(*) / sum(count(*)) OVER () FROM f GROUP BY tok""",
    "fit_length": f"WITH {CONV}, d AS (SELECT doc_id, list(tok ORDER BY pos) AS t FROM tok GROUP BY doc_id) SELECT doc_id, array_to_string(list_concat(t[:5], list_transform(range(greatest(0, 5 - len(t))), lambda x: 'pad')), ' ') AS tokens FROM d",
    "token_u16": "SELECT event_id, (event_id * 7919) % 65536 AS tok FROM events",
    "merge_shards": "SELECT doc_id, source, n_chars, 0::INTEGER AS shards_left FROM documents",
    "flat_file": f"WITH {_NUMBERED} SELECT shard, doc, array_to_string(t, ' ') AS tokens FROM d",
    "headered_file": f"WITH {_NUMBERED} SELECT shard, doc, array_to_string({_SIX}, ' ') AS tokens FROM d",
    "npy_file": f"WITH {_NUMBERED} SELECT shard, doc, array_to_string({_SIX}, ' ') AS tokens FROM d",
    "offsets_file": f"""WITH {_NUMBERED}, o AS (SELECT shard, doc, (sum(len(t) + 1) OVER (PARTITION BY shard ORDER BY doc))::BIGINT AS "end", len(t) + 1 AS n FROM d)
SELECT shard, doc, "end" - n AS "offset" FROM o UNION ALL SELECT shard, count(*), max("end") FROM o GROUP BY shard""",
    "source_flat": f"""WITH {_NUMBERED} SELECT shard, (sum(len(t) + 1) OVER (PARTITION BY shard ORDER BY doc) - len(t) - 1)::BIGINT AS start, array_to_string(t, ' ') AS tokens
FROM d WHERE shard IN (1, 3)""",
    "source_headered": f"WITH {_NUMBERED} SELECT shard, doc * 6 AS start, array_to_string({_SIX}, ' ') AS tokens FROM d",
    "source_npy": f"WITH {_NUMBERED} SELECT shard, doc * 6 AS start, array_to_string({_SIX}, ' ') AS tokens FROM d",
    "source_append": f"WITH {_NUMBERED} SELECT array_to_string(t, ' ') AS tokens, 2 * count(*) AS docs FROM d GROUP BY 1",
    "source_stream": f"WITH {_NUMBERED} SELECT array_to_string(t, ' ') AS tokens, count(*) AS docs FROM d GROUP BY 1",
    "concat_shards": f"WITH {_NUMBERED} SELECT row_number() OVER (ORDER BY shard, doc) - 1 AS doc, array_to_string(t, ' ') AS tokens FROM d",
    "documents_in": f"WITH {_NUMBERED} SELECT shard, count(*) AS docs FROM d GROUP BY shard",
    "config_roundtrip": "SELECT 'vocab_size' AS setting, 256::BIGINT AS value UNION ALL SELECT 'separator_token', 65535 UNION ALL SELECT 'num_images', count(*) FROM part",
    "dataset_info": "SELECT count(*) AS num_examples, 'n_nationkey: int, n_name: string' AS features FROM nation",
    "catalogue_resume": "SELECT * FROM (VALUES (0::BIGINT, 'nation', 25::BIGINT), (1, 'supplier', 0)) t(place, name, expected_size)",
    "shard_names": "SELECT k - 3 AS place, printf('train-%05d-of-00040.parquet', k) AS name FROM range(3, 7) t(k)",
    "progress": """WITH s AS (SELECT source, count(l.doc_id) AS done, count(*) AS total, sum(n_chars) / 1000.0::DOUBLE AS seconds FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY source)
SELECT source, round(done / seconds, 6) AS rate, round(100.0::DOUBLE * done / total, 6) AS percent, CASE WHEN done > 0 THEN round((total - done) / (done / seconds), 6) END AS eta FROM s""",
    "stage_shares": "SELECT lang, source, round(100.0::DOUBLE * sum(n_chars) / sum(sum(n_chars)) OVER (PARTITION BY lang), 6) AS percent FROM documents GROUP BY lang, source",
    "count_long": _COUNT_LONG,
    "ntd_long": _NTD_LONG,
    "ntd_stored": _ntd_sql(_VALUES, "shard"),
    "index_subset": f"""WITH {EVT}, {CTX}, g AS (SELECT shard, n, CASE WHEN n = 0 THEN [] ELSE b[len(b) - n + 1:] END AS c, tok, count(*) AS cnt FROM (SELECT *, unnest(range(len(b) + 1)) AS n FROM ctx) WHERE shard IN (1, 2) GROUP BY ALL)
SELECT shard, n, count(*) AS contexts, sum(cnt)::BIGINT AS cnt FROM g GROUP BY ALL""",
    "distinct_tokens": f"WITH {WORDS} SELECT count(DISTINCT tok) AS words, count(*) AS tokens FROM tok",
    "first_n_tokens": f"WITH {WORDS} SELECT doc_id, pos, tok FROM tok WHERE pos < 20",
    "ngram_index": f"WITH {EVT}, {CTX} SELECT n, array_to_string(CASE WHEN n = 0 THEN [] ELSE b[len(b) - n + 1:] END, ' ') AS ctx, tok, shard, count(*) AS cnt FROM (SELECT *, unnest(range(least(len(b), 3) + 1)) AS n FROM ctx) GROUP BY ALL",
    "suffix_order": f"WITH {EVT}, r AS (SELECT array_to_string(list(tok) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING), ' ') AS suffix FROM tok), c AS (SELECT suffix, count(*) AS cnt FROM r GROUP BY 1) SELECT suffix, cnt, (sum(cnt) OVER (ORDER BY suffix) - cnt)::BIGINT AS first FROM c",
    "count_prompt": _COUNT_SQL,
    "count_merge": _COUNT_SQL,
    "ntd_unigram": _ntd_sql("(0, []::VARCHAR[])"),
    "ntd_longest_suffix": _ntd_sql(_VALUES),
    "ntd_shard_merge": _ntd_sql(_VALUES, "shard"),
    "ntd_unsharded": _ntd_sql(_VALUES),
    "ntd_max_support": _ntd_sql(_VALUES, "shard // 2", 2),
    "temperature_topk": f"{_SAMPLED} SELECT ctx, tok, round(prob, 9) AS prob FROM f",
    "cdf_sample": f"{_SAMPLED}, c AS (SELECT ctx, tok, sum(prob) OVER (PARTITION BY ctx ORDER BY tok) AS cdf, ('0x' || substr(md5('7:' || ctx), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM f) SELECT ctx, coalesce(min(tok) FILTER (cdf > u), max(tok)) AS tok FROM c GROUP BY ctx",
    "param_sweep": _generate_sql(
        "SELECT (CASE event_type {crc} END)::VARCHAR || ':' || t || ':' || k || ':' || n AS prompt_id, [event_type] AS ids, t, k FROM (SELECT DISTINCT event_type FROM events), "
        "(VALUES (0.7::DOUBLE), (1.0), (1.3)) a(t), (VALUES (2), (3), (50)) b(k), range(2) c(n)", 2, 2, 9
    ) + " SELECT prompt_id, array_to_string(ids, ' ') AS text FROM s2",
    "backoff_generate": _generate_sql("SELECT (CASE event_type {crc} END)::BIGINT AS prompt_id, [event_type] AS ids, 0.9::DOUBLE AS t, 3 AS k FROM (SELECT DISTINCT event_type FROM events)", 4, 4, 5)
    + " SELECT prompt_id, array_to_string(ids, ' ') AS text FROM s4",
    "generate_by_steps": _generate_sql("SELECT (CASE event_type {crc} END)::BIGINT AS prompt_id, [event_type] AS ids, 0.9::DOUBLE AS t, 3 AS k FROM (SELECT DISTINCT event_type FROM events)", 4, 4, 5)
    + " SELECT prompt_id, array_to_string(ids, ' ') AS text FROM s4",
    "generate_long": _generate_sql(
        "SELECT (CASE event_type {crc} END)::VARCHAR || ':1.1:4:' || n AS prompt_id, [event_type] AS ids, 1.1::DOUBLE AS t, 4 AS k FROM (SELECT DISTINCT event_type FROM events), range(3) c(n)", 40, 6, 11
    ) + " SELECT prompt_id, array_to_string(ids, ' ') AS text FROM s40",
    "greedy_generate": f"""
WITH RECURSIVE {EVT}, bi AS (SELECT lag(tok) OVER (PARTITION BY doc_id ORDER BY pos) AS ctx, tok FROM tok),
best AS (SELECT ctx, tok FROM bi WHERE ctx IS NOT NULL GROUP BY ctx, tok QUALIFY row_number() OVER (PARTITION BY ctx ORDER BY count(*) DESC, tok) = 1),
g AS (SELECT event_type AS seed, event_type AS last, event_type AS text, 0 AS n FROM (SELECT DISTINCT event_type FROM events)
      UNION ALL SELECT seed, best.tok, text || ' ' || best.tok, n + 1 FROM g JOIN best ON best.ctx = g.last WHERE n < 6)
SELECT (CASE seed {{crc}} END)::BIGINT AS prompt_id, text FROM g WHERE n = 6""",
    "memorized_docs": "SELECT doc_id FROM documents WHERE source = 'src0' AND text IN (SELECT text FROM documents WHERE source <> 'src0')",
    "novel_docs": "SELECT doc_id FROM documents WHERE source = 'src0' AND text NOT IN (SELECT text FROM documents WHERE source <> 'src0')",
    "memorization_rate": "SELECT count(*) FILTER (copy) AS copies, round(avg(copy::INT), 9) AS rate FROM (SELECT text IN (SELECT text FROM documents WHERE source <> 'src0') AS copy FROM documents WHERE source = 'src0')",
    "stream_unigram": "SELECT event_type AS tok, count(*) AS cnt FROM events GROUP BY 1",
}


def _with_crc(sql: str) -> str:
    """DuckDB has no CRC-32; the few event types' values are put in."""
    import zlib

    cases = " ".join(f"WHEN '{e}' THEN {zlib.crc32(e.encode())}" for e in ("signup", "error", "click", "view", "purchase"))
    return sql.replace("{crc}", cases)


def queries():
    return {name[2:]: f for name, f in globals().items() if name.startswith("q_")}


def oracle_sql():
    return {k: _with_crc(v) for k, v in SQL.items()}
