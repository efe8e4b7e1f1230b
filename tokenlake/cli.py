"""Command line: tokenise and decode images, build and query n-gram indexes, generate, test for copies, train codebooks.

    python -m tokenlake tokenize --images DIR --preset residual-3 --out DIR [--on-bad placeholder] [--max-images N]
    python -m tokenlake tokenize-tars --shards-dir DIR --preset residual-3 --out DIR [--shard-start S --shard-count N] [--concat FILE]
    python -m tokenlake detokenize --tokens DIR --preset residual-3 --out DIR
    python -m tokenlake build-index --tokens DIR --out DIR --order N
    python -m tokenlake query --index DIR --mode count|ntd --prompt 1,2,3 [--max-support K] [--group-size G]
    python -m tokenlake generate --index DIR --seeds "1,2;3" --num-tokens N [--temperature T --top-k K --max-context C --seed S --out DIR]
    python -m tokenlake memorized --generated DIR --tokens DIR
    python -m tokenlake train-codebook --images DIR --preset small --out DIR

Tokens and generated sequences are Parquet folders of (img_id, tokens); tokenize writes flat token files
and their configuration beside them if told to. Images are files of a folder, or members of tar shards.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenlake.operators import codebook, evaluation, ngram, sampling, stream, tokenizers
from tokenlake.sources import images, token_files


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tokenlake")
    sub = out.add_subparsers(dest="command", required=True)

    def command(name: str, *flags: str, **kinds):
        p = sub.add_parser(name)
        for flag in flags:
            needed = flag.endswith("!")
            dest = flag.rstrip("!")
            kind, default = kinds.get(dest.replace("-", "_"), (str, None))
            p.add_argument(f"--{dest}", type=kind, default=default, required=needed)
        return p

    shared = {"on_bad": (str, "skip"), "max_images": (int, None), "size": (int, 256), "separator": (int, token_files.SEPARATOR)}
    command("tokenize", "images!", "preset!", "out!", "flat", "on-bad", "max-images", "codebook", **shared)
    command("tokenize-tars", "shards-dir!", "preset!", "out!", "shard-start", "shard-count", "concat", "on-bad", "codebook", shard_start=(int, None), shard_count=(int, None), on_bad=(str, "placeholder"))
    command("detokenize", "tokens!", "preset!", "out!", "codebook")
    command("build-index", "tokens!", "out!", "order", "shards", order=(int, 6), shards=(int, 1))
    command("query", "index!", "mode!", "prompt!", "max-support", "group-size", max_support=(int, 10), group_size=(int, None))
    command("generate", "index!", "seeds!", "num-tokens!", "temperature", "top-k", "max-context", "seed", "out",
            num_tokens=(int, None), temperature=(float, 0.9), top_k=(int, 50), max_context=(int, 6), seed=(int, 0))
    command("memorized", "generated!", "tokens!")
    command("train-codebook", "images!", "preset!", "out!", "iterations", "max-images", iterations=(int, 10), max_images=(int, None))
    return out


def tokenizer(spark: SparkSession, args: argparse.Namespace):
    """A preset, or a vector quantiser from a stored codebook."""
    return tokenizers.Vq(codebook.load(spark, args.codebook)) if args.codebook else tokenizers.PRESETS[args.preset]


def pictures(spark: SparkSession, folder: str, most: int | None = None) -> DataFrame:
    """(img_id, path, height, width, data): images of a folder, numbered in the order of their paths."""
    found = images.image_paths(spark, folder)
    numbered = stream.running_total(found.withColumn("one", F.lit(1)), ["path"], "one", "img_id").select("path", F.col("img_id").cast("long").alias("img_id"))
    if most is not None:
        numbered = numbered.filter(F.col("img_id") < most)
    read = images.decoded(images.image_files(spark, folder), "path", "content")
    return read.join(numbered, "path")


def _flat(spark: SparkSession, tokens: DataFrame, coder, path: str) -> None:
    written = token_files.write_flat(tokens.select(F.lit(0).alias("shard"), F.col("img_id").alias("doc_id"), "tokens"), path)
    count = written.agg(F.sum("docs")).first()[0] or 0
    token_files.write_config(spark, f"{path}/config", vocab_size=coder.vocab, tokens_per_image=coder.tokens_per_image, separator_token=token_files.SEPARATOR, num_images=count)


def run(spark: SparkSession, args: argparse.Namespace) -> DataFrame | None:
    """Run a parsed command; what it tells is a DataFrame, if anything."""
    if args.command == "tokenize":
        coder = tokenizer(spark, args)
        tokenizers.tokenize(pictures(spark, args.images, args.max_images), coder, args.on_bad).write.mode("overwrite").parquet(args.out)
        done = spark.read.parquet(args.out)
        if args.flat:
            _flat(spark, done, coder, args.flat)
        return done.agg(F.count("*").alias("images"), F.sum(F.col("failed").cast("int")).alias("failed"))
    if args.command == "tokenize-tars":
        coder = tokenizer(spark, args)
        members = images.tar_members(spark, f"{args.shards_dir}/*.tar", first=args.shard_start, count=args.shard_count)
        # a shard holds far fewer than 2^32 members
        keyed = members.withColumn("img_id", F.col("shard").cast("long") * F.lit(2**32) + F.col("member_idx"))
        coded = tokenizers.tokenize(images.decoded(keyed, "img_id", "bytes"), coder, args.on_bad)
        shards = coded.select((F.col("img_id") / 2**32).cast("long").alias("shard"), F.col("img_id").alias("doc_id"), "tokens")
        token_files.write_flat(shards, args.out)
        if args.concat:
            token_files.concat_files(spark, f"{args.out}/*.bin", args.concat)
        return token_files.documents_in(spark, f"{args.out}/*.bin", coder.tokens_per_image)
    if args.command == "detokenize":
        return images.write_images(tokenizers.detokenize(spark.read.parquet(args.tokens), tokenizer(spark, args)), args.out)
    if args.command == "build-index":
        rows = spark.read.parquet(args.tokens).withColumn("shard", F.pmod("img_id", F.lit(args.shards)))
        end = stream.flatten(rows.select("shard", F.col("img_id").alias("doc_id"), "tokens"), token_files.SEPARATOR)
        token_files.build_shards(spark, args.out, list(range(args.shards)), lambda k: ngram.build_index(end.filter(F.col("shard") == k), args.order))
        return token_files.read_index(spark, args.out).groupBy("shard").agg(F.count("*").alias("contexts"), F.sum("cnt").alias("cnt"))
    if args.command == "query":
        index = token_files.read_index(spark, args.index)
        reach = index.agg(F.max("n")).first()[0] or 0
        asked = spark.createDataFrame([(0, [int(x) for x in args.prompt.split(",") if x])], "prompt_id long, ids array<int>")
        if args.mode == "count":
            return ngram.count(index, asked, args.group_size or 1, reach=reach)
        return ngram.ntd(index, asked, args.max_support, args.group_size, reach=reach).orderBy(F.desc("prob"), "tok")
    if args.command == "generate":
        index = token_files.read_index(spark, args.index)
        seeds = [(k, [int(x) for x in s.split(",") if x]) for k, s in enumerate(args.seeds.split(";"))]
        made = sampling.generate(index, spark.createDataFrame(seeds, "prompt_id long, ids array<int>"), args.num_tokens, args.max_context, args.temperature, args.top_k, args.seed)
        made = made.select(F.col("prompt_id").alias("img_id"), F.col("ids").alias("tokens"))
        if args.out:
            made.write.mode("overwrite").parquet(args.out)
            token_files.write_config(spark, f"{args.out}-settings", temperature=args.temperature, top_k=args.top_k, max_context=args.max_context, seed=args.seed, num_tokens=args.num_tokens)
        return made
    if args.command == "memorized":
        made, corpus = spark.read.parquet(args.generated), spark.read.parquet(args.tokens)
        copies = evaluation.memorised(made.select("img_id", "tokens"), corpus, "tokens")
        return made.select("img_id").join(copies.select("img_id", F.lit(True).alias("copy")), "img_id", "left").select("img_id", F.coalesce("copy", F.lit(False)).alias("copy"))
    book = codebook.preset(pictures(spark, args.images, args.max_images), args.preset, iterations=args.iterations).codebook
    codebook.save(book, spark, args.out)
    return spark.createDataFrame([book.shape], "codes long, dimensions long")


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("tokenlake").getOrCreate()
    out = run(spark, args)
    if out is not None:
        out.show(truncate=False)
