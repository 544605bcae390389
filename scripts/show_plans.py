"""Print formatted physical plans of the main jobs.

Usage: python scripts/show_plans.py [sf_dir] > plans.txt
Shows pushed filters / read schemas of the scans, join strategies and the
exchanges of: the adapter, the flagship top-N query, the trends detector and
the multivariable filter.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from zonepulse.operators import detectors as D  # noqa: E402
from zonepulse.plans import queries as Q  # noqa: E402
from zonepulse.session import build_session  # noqa: E402
from zonepulse.sources.adapter import zone_tables, zone_week_facts  # noqa: E402


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]", shuffle_partitions=16)
    spark.sparkContext.setLogLevel("ERROR")
    m, o = zone_tables(spark, sf_dir)
    jobs = {
        "adapter (zone x week facts)": zone_week_facts(spark, sf_dir),
        "E2 top-N from raw tables": Q.top_n(m, o, "Lead Penetration", "zone", 5),
        "K2 trends": D.detect_trends(m, o),
        "E5 multivariable filter": Q.multivariable_filter(
            m, o, [("Lead Penetration", "high", None), ("Orders", "gt", 8.0)], "and"),
    }
    for name, df in jobs.items():
        print("=" * 100)
        print(name)
        print("=" * 100)
        df.explain("formatted")


if __name__ == "__main__":
    main()
