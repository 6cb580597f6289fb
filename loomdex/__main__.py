"""Command line: index a docstream, ask it, export it."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import boolean, export, index, layout, ranked, workload
from .operators.index import Index
from .sources import docstream, store


def show(df: DataFrame) -> None:
    """Every row, tab-separated under the column names, a partition at a time."""
    print(*df.columns, sep="\t")
    for row in df.toLocalIterator():
        print(*row, sep="\t")


def one_by_one(spark: SparkSession, queries: DataFrame, path: str, what: str, k: int, num_docs: int | None, verbose: bool) -> None:
    """Ask the queries of a file one after the other on a packed index and print their latencies in microseconds.

    Only queries with a match count. The driver holds one query at a time and a number for each.
    """
    find, whole = store.Lookup(spark, path), store.load(spark, path)

    def ask(q) -> int:
        terms = list(dict.fromkeys(q["terms"]))
        if what == "and":
            return find.and_docs(terms).count()
        lists = find.postings(terms)
        if what == "or":
            return lists.select("docid").distinct().count()
        one = spark.createDataFrame([(q["query_ord"], q["qid"], terms)], queries.schema)
        return ranked.ranked(one, Index(whole.documents, lists, find.lexicon(terms)), k, num_docs).count()

    told = (lambda q, us, n: print(f"{q['qid']} latency={us:.0f} matches={n}")) if verbose else None
    s = workload.timed(queries.orderBy("query_ord").toLocalIterator(), ask, told)
    shown = lambda values: " ".join(f"{name}: {value:g}" for name, value in values.items() if value is not None)
    print(f"Statistics over {s['matched']} queries with a match of {s['queries']}")
    print("Latency", shown(s["latency_us"]))
    print("Matches", shown(s["matches"]))


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="loomdex")
    sub = p.add_subparsers(dest="what", required=True)
    a = sub.add_parser("index", help="docstream files to a packed index")
    a.add_argument("documents")
    a.add_argument("output")
    a.add_argument("-p", "--positions", action="store_true")
    a.add_argument("--unpacked", action="store_true")
    a.add_argument("--dry-run", action="store_true", help="read and tokenize only")
    a = sub.add_parser("and", help="documents that hold all terms")
    a.add_argument("index")
    a.add_argument("queries")
    a.add_argument("-v", action="count", default=0, help="a line for each query with a match; twice: the work of each term")
    a.add_argument("--one-by-one", action="store_true", help="time the queries one after the other, on a packed index")
    a = sub.add_parser("or", help="documents that hold any term")
    a.add_argument("index")
    a.add_argument("queries")
    a.add_argument("-v", action="count", default=0)
    a.add_argument("--one-by-one", action="store_true")
    a = sub.add_parser("ranked", help="best k documents of each query")
    a.add_argument("index")
    a.add_argument("queries")
    a.add_argument("k", type=int)
    a.add_argument("num_docs", type=int, nargs="?")
    a.add_argument("--trec", help="folder for a TREC run")
    a.add_argument("-v", action="count", default=0, help="the number of documents of each query, and statistics, in place of the documents")
    a.add_argument("--one-by-one", action="store_true")
    a = sub.add_parser("export", help="inverted-index files")
    a.add_argument("documents")
    a.add_argument("basename")
    a.add_argument("--canonical", action="store_true")
    a = sub.add_parser("report", help="size of the index in blocks")
    a.add_argument("documents")
    a.add_argument("--growth", choices=["fixed", "triangle", "expon"], default="triangle")
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName("loomdex").getOrCreate()
    if args.what == "index":
        docs = docstream.read_docstream(spark, args.documents)
        if args.dry_run:
            workload.materialise(docs)
            return
        built = index.build(docs)
        (store.save if args.unpacked else store.save_packed)(built, args.output)
        if args.positions:
            index.positional_postings(docs).write.parquet(f"{args.output}/positions")
    elif args.what in ("and", "or", "ranked"):
        at, queries = store.load(spark, args.index), docstream.read_queries(spark, args.queries)
        if args.one_by_one:
            one_by_one(spark, queries, args.index, args.what, getattr(args, "k", 0), getattr(args, "num_docs", None), args.v > 0)
            return
        if args.what == "ranked" and args.v:
            counts = ranked.returned_count(queries, at, args.k, args.num_docs).withColumnRenamed("returned", "matches")
            show(workload.run_log(counts).orderBy("query_ord"))
            workload.match_stats(counts).show()
            return
        if args.what == "ranked":
            run = ranked.ranked(queries, at, args.k, args.num_docs)
            if args.trec:
                ranked.trec_run(run).orderBy("query_ord", "rank").select("line").write.text(args.trec)
            else:
                show(run.orderBy("query_ord", "rank"))
            return
        if args.v > 1 and args.what == "and":
            show(boolean.and_profile(queries, at).orderBy("query_ord", "i"))
        counts = (boolean.and_count if args.what == "and" else boolean.or_count)(queries, at)
        if args.v:
            show(workload.run_log(counts).orderBy("query_ord"))
        workload.match_stats(counts).show()
    elif args.what == "export":
        docs = docstream.read_docstream(spark, args.documents)
        lists = index.postings(docs)
        export.write_interleaved(lists, args.basename)
        if args.canonical:
            export.write_canonical(docs.select("docid", "text_id", F.size("tokens").cast("bigint").alias("length")), lists, args.basename)
    else:
        docs = docstream.read_docstream(spark, args.documents)
        built = index.build(docs)
        layout.size_report(layout.block_layout(built.postings, args.growth), index.collection_stats(docs, built.lexicon)).show(truncate=False)


if __name__ == "__main__":
    main()
