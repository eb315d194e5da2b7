"""Command line: python -m lodestone.cli build|retrieve|answer|parse ..."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestone import constants as C
from lodestone.functions import text as T
from lodestone.operators.evaluation import rows_of_tag, top_values
from lodestone.operators.index import load_index, save_index
from lodestone.operators.parsing import identity_reply, parse_queries
from lodestone.plans.ingest import build
from lodestone.plans.retrieve import answer, prepared, retrieve


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lodestone")
    commands = parser.add_subparsers(dest="command", required=True)
    b = commands.add_parser("build", help="build an index from raw files")
    b.add_argument("index")
    for name in ("ready", "cross", "sidecars"):
        b.add_argument(f"--{name}")
    b.add_argument("--emd", nargs="*")
    v = commands.add_parser("serve", help="answer over HTTP")
    v.add_argument("index")
    v.add_argument("--port", type=int, default=8000)
    w = commands.add_parser("browse", help="list chunks, or those of a tag")
    w.add_argument("index")
    w.add_argument("--disaster-type")
    w.add_argument("--limit", type=int, default=50)
    for name in ("retrieve", "answer", "parse"):
        c = commands.add_parser(name)
        c.add_argument("index")
        c.add_argument("query")
        c.add_argument("--top-k", type=int, default=C.FINAL_TOP_K)
        c.add_argument("--disaster-type")
    args = parser.parse_args(argv)

    spark = SparkSession.builder.appName("lodestone").getOrCreate()
    if args.command == "build":
        built = build(spark, ready=args.ready, cross=args.cross, emd=args.emd, sidecars=args.sidecars)
        save_index(built, args.index)
        for r in top_values(built.chunks, "disaster_type").collect():
            print(f"{r['value']}: {r['n']} chunks")
        return 0
    index = load_index(spark, args.index)
    if args.command == "serve":
        from lodestone.streaming.http import Service, server

        server(Service(spark, index), port=args.port).serve_forever()
        return 0
    if args.command == "browse":
        for r in rows_of_tag(index.chunks, args.disaster_type).limit(args.limit).collect():
            print(f"[{r['id']}] {r['disaster_type']} ({r['n_of_tag']})  {r['source']}  page={r['page']}\n    {r['text']}")
        return 0
    asked = spark.createDataFrame([(0, args.query)], "query_id long, query string")
    if args.command == "parse":
        print(json.dumps(parse_queries(asked.withColumn("raw", identity_reply(F.col("query"))), index.chunks).first().asDict(), indent=2))
        return 0
    queries = prepared(asked, index)
    if args.disaster_type:
        queries = queries.withColumn("tag", F.lit(args.disaster_type))
    if args.command == "answer":
        row = answer(queries, index, top_k=args.top_k).first()
        print(row["answer"])
        return 0
    found = retrieve(queries, index, top_k=args.top_k)
    state = found.gates.first()
    print(f"top_score: {state['top_score']}  gated: {state['gated']}")
    if state["gated"]:
        print(f"message: {state['message']}")
    for h in found.hits.orderBy("final_rank").select("*", T.snippet(F.col("text")).alias("snippet")).collect():
        print(f"\n[{h['final_rank'] + 1}] score={h['score']:.4f}  source={h['source']}  page={h['page']}  disaster={h['disaster_type']}\n    {h['snippet']}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
