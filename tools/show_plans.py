"""Run registered queries and print their final physical plans (after AQE).

usage: python tools/show_plans.py [sf_dir] key [key ...] > docs/PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cadence.plans.registry import QUERIES  # noqa: E402
from cadence.session import local_session  # noqa: E402


def final_plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    qe = df._jdf.queryExecution()
    plan = qe.executedPlan()
    # AdaptiveSparkPlanExec: show the final plan chosen at run time
    if plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.finalPhysicalPlan() if hasattr(plan, "finalPhysicalPlan") else plan.executedPlan()
    text = plan.toString()
    text = re.sub(r"#\d+L?", "", text)  # expression ids add noise
    text = re.sub(r"\[plan_id=\d+\]", "", text)
    text = re.sub(r"file:[^\]]*checkpoints/[^\],]*", "<scratch>", text)
    return text


def main() -> None:
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = local_session(8)
    print(f"# Final physical plans ({os.path.basename(sf)}, local[8], AQE on)\n")
    print("Generated by `tools/show_plans.py`; expression ids and scratch paths elided.\n")
    for key in args:
        print(f"## {key}\n\n```")
        print(final_plan(QUERIES[key](spark, sf)).rstrip())
        print("```\n")


if __name__ == "__main__":
    main()
