"""Headline timings.  Prints one JSON line.

Environment: ``BENCH_SF_DIR`` (input folder) and ``BENCH_CPUS`` (local cores).
Each query writes its full result to the no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from candlewick.operators import adaptive, audit, ingest, price, segments, transitions, volume  # noqa: E402
from candlewick.plans import changes  # noqa: E402
from candlewick.session import local_session, stage  # noqa: E402
from candlewick.sources.arrivals import feed_arrivals  # noqa: E402
from candlewick.sources.ticks import event_bars, shipment_bars  # noqa: E402


def minute_bars(spark, d):
    return event_bars(spark, d, "1 minute")


def user_bars(spark, d):
    return event_bars(spark, d, "1 hour", "user_id")


def split(bars):
    """The layout used where a symbol may be long, forced here to be measured."""
    return segments.Layout.of(["symbol"], rows=8192)


QUERIES = {
    "bars_from_events": minute_bars,
    "volume_features": lambda s, d: volume.volume_events(minute_bars(s, d)),
    "volume_features_users": lambda s, d: volume.volume_events(user_bars(s, d)),
    "volume_shipments": lambda s, d: volume.volume_events(shipment_bars(s, d)),
    "price_events": lambda s, d: price.price_events(minute_bars(s, d)),
    "price_events_users": lambda s, d: price.price_events(user_bars(s, d)),
    "price_shipments": lambda s, d: price.price_events(shipment_bars(s, d)),
    "adaptive_decisions": lambda s, d: adaptive.decisions(minute_bars(s, d)),
    "adaptive_decisions_users": lambda s, d: adaptive.decisions(user_bars(s, d)),
    "adaptive_shipments": lambda s, d: adaptive.decisions(shipment_bars(s, d)),
    "resolve_revisions": lambda s, d: ingest.resolve_revisions(feed_arrivals(s, d)),
    "model_path": lambda s, d: ingest.model_path(feed_arrivals(s, d)),
    "transitions": lambda s, d: transitions.transitions(changes.decision_events(minute_bars(s, d))),
    "audit_sequence": lambda s, d: audit.sequence_report(stage(transitions.transitions(changes.decision_events(minute_bars(s, d))))),
    "volume_features_segmented": lambda s, d: volume.volume_events(b := minute_bars(s, d), split(b)),
    "price_events_segmented": lambda s, d: price.price_events(b := minute_bars(s, d), split(b)),
    "adaptive_decisions_segmented": lambda s, d: adaptive.decisions(b := minute_bars(s, d), split(b)),
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    spark = local_session(cpus, "bench", shuffle_partitions=cpus if cpus.isdigit() else "8")
    minute_bars(spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the JVM's and workers' engines
    took = {}
    for name, query in QUERIES.items():
        if only and name not in only:
            continue
        begun = time.time()
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - begun, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {"metric": "total_wall_clock", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}
        )
    )


if __name__ == "__main__":
    main()
