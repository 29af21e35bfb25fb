"""Commands over a registry folder: ``python -m cardmill.cli --registry DIR COMMAND``.

Thin wrappers: each loads the folder, runs one job and prints its rows as JSON lines.
"""

from __future__ import annotations

import argparse
import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardmill.operators import registry, similar
from cardmill.plans import audits, curation, reports
from cardmill.settings import Profile, Settings, Taxonomy, load_profile, load_settings, load_taxonomy
from cardmill.sources import cards as files


def _show(df: DataFrame) -> None:
    for r in reports.as_json(df).toLocalIterator():
        print(r.json)


def _records(cards: DataFrame) -> DataFrame:
    return audits.records(registry.active(cards), "id", "front_normalized", "back_normalized", "target_deck", "note_type", "scope_json")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="cardmill", description=__doc__)
    p.add_argument("--registry", required=True)
    p.add_argument("--settings")
    p.add_argument("--taxonomy")
    p.add_argument("--profile")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("ingest").add_argument("file", help="JSON or YAML, - for standard input")
    sub.add_parser("review")
    for name in ("approve", "reject", "purge"):
        sub.add_parser(name).add_argument("id", help="an id or a prefix of one")
    sub.add_parser("sync").add_argument("tsv", help="where the approved cards are written to")
    sub.add_parser("audit-duplicates")
    one = sub.add_parser("similar")
    one.add_argument("front")
    one.add_argument("back", nargs="?", default="")
    sub.add_parser("stats")
    args = p.parse_args(argv)

    spark = spark or SparkSession.builder.appName("cardmill").getOrCreate()
    settings = load_settings(args.settings) if args.settings else Settings()
    taxonomy = load_taxonomy(args.taxonomy) if args.taxonomy else Taxonomy({})
    profile = load_profile(args.profile) if args.profile else Profile()
    log = curation.RegistryLog(spark, args.registry)
    cards = log.cards()
    if args.command == "ingest":
        good, bad = files.cards_from_file(spark, args.file)
        now = datetime.datetime.now(datetime.UTC).isoformat()
        rows = good.withColumn("idx", F.monotonically_increasing_id())
        decisions, events = curation.ingest(rows, cards, profile, taxonomy, settings, now, now)
        log.append(events)
        _show(decisions.orderBy("idx"))
        _show(bad)
        return 0 if bad.isEmpty() else 1
    if args.command == "review":
        _show(curation.review_list(cards))
    elif args.command in ("approve", "reject", "purge"):
        outcome, events, report = curation.resolve(cards, args.id, args.command, 0)
        _show(report)
        if outcome != "found":
            print(outcome)
            return 1
        log.append(events)
    elif args.command == "sync":
        files.write_tsv(registry.sync_queue(cards), args.tsv)
    elif args.command == "audit-duplicates":
        _, members, clusters = audits.duplicate_clusters(_records(cards), settings)
        _show(reports.clusters_with_members(clusters, members, _records(cards)))
    elif args.command == "similar":
        asked = spark.createDataFrame([("query", args.front, args.back)], "id string, front string, back string")
        query, pool = audits.records(asked, "id", "front", "back", None, None, None, normalized=False), _records(cards)
        pairs = similar.lookup_pairs(query, pool, settings.similar_threshold)
        _show(similar.top_similar(pairs, query, pool, settings.similar_threshold))
    else:
        _show(registry.status_metrics(cards))
        _show(registry.transitions(cards))
        _show(registry.duplicate_precision(cards))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
