
import json
import sys

rec = json.loads([l for l in open(sys.argv[1]) if l.startswith("{")][-1])
print(f"Total {rec['value']} s over {rec['n_queries']} queries, sf{rec['sf']}, local[{rec.get('cpus', 8)}].\n")
print("| key | sf | seconds |")
print("| --- | --- | --- |")
for k, v in sorted(rec["queries"].items(), key=lambda x: -x[1]):
    print(f"| `{k}` | {rec['sf']} | {v} |")
