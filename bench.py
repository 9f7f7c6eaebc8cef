"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from kerbline.plans.catalog import QUERIES
from kerbline.session import local_session

HEADLINE = (
    "ag06_dashboard", "ag03_trips_by_status", "ag12_uniqueness_report", "ag14_period_stats", "ag16_revenue_by_period",
    "ag17_demand_heat_map", "flt04_admin_search", "so01_admin_trip_page", "so01_passenger_trip_pages", "set01_my_trips",
    "jn01_payment_trip_parties", "jn05_asof_tariff_fares", "jn06_attach_pings", "wn01_previous_point", "ag07_path_length",
    "completion_fares", "ag08_rating_fold", "wn04_status_timeline", "str12_replayed_trips", "str09_notification_fan_out",
    "jn19_callback_verdicts", "jn07_radius_nearest", "mt01_candidates", "mt02_assignment", "mt05_offer_outcomes",
    "mt03_retry_decisions", "str01_latest_location_ttl", "str03_availability_machine",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
