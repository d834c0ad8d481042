"""Write PLANS.md: the physical plans (AQE off, so the static shape shows) of the headline
queries on sf0.01, one code block each, long lines cut.

usage: python tools_plans.py [sf_dir]
"""
import sys

from medialens.functions.text import WS_CHARS
from medialens.plans.registry import queries
from medialens.session import build_session

NAMES = ["summary_two_outlets", "avg_score_grouping_sets", "segment_trend", "weekly_index_combined",
         "monthly_rl_aligned", "merged_label_qa", "dedup_first", "majority_vote", "ngram_top3",
         "dedup_exact", "html_corpus_text", "month_partitions_read", "clean_tokens_lexicon", "token_windows", "url_prefix"]

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
spark = build_session("local[8]", shuffle_partitions=8, app_name="plans")
spark.sparkContext.setLogLevel("ERROR")
spark.conf.set("spark.sql.adaptive.enabled", "false")
q = queries()
out = ["# Physical plans of the headline queries", "",
       f"Generated by `tools_plans.py` on `{sf}` with AQE off (the static plan; at run time AQE may "
       "coalesce partitions or switch join strategies). Lines are cut at 160 characters.", ""]
for n in NAMES:
    plan = q[n](spark, sf)._jdf.queryExecution().executedPlan().toString()
    plan = plan.replace(WS_CHARS, "<whitespace set>")  # the trim literal holds raw newlines
    lines = [ln if len(ln) <= 160 else ln[:157] + "..." for ln in plan.splitlines()]
    out += [f"## {n}", "", "```", *lines, "```", ""]
with open("PLANS.md", "w") as f:
    f.write("\n".join(out))
print("wrote PLANS.md")
