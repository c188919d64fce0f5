"""How indexing scales with threads: builds an index in a process of its own for each count, and tabulates the speed-up.

    python scaling.py -c corpus.jsonl -o results/ --threads 1 2 4 8
"""

from __future__ import annotations

import argparse
import csv
import json
import shutil
import subprocess
import sys
from pathlib import Path


def summary(runs: list[dict]) -> list[dict]:
    """Speed-up against the first run, and efficiency for each thread."""
    first = runs[0]["Elapsed Time"]
    return [r | {"speedup": round(first / r["Elapsed Time"], 3), "efficiency": round(first / r["Elapsed Time"] / r["threads"], 3)} for r in runs]


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("-c", "--corpus", required=True)
    parser.add_argument("-o", "--out", required=True, type=Path)
    parser.add_argument("--threads", type=int, nargs="+", default=[4, 8, 16, 32])
    parser.add_argument("--max-docs", type=int, default=500_000)
    parser.add_argument("--keep-indexes", action="store_true")
    args = parser.parse_args(argv)
    args.out.mkdir(parents=True, exist_ok=True)
    runs = []
    for n in args.threads:
        index = args.out / f"index_{n}"
        shutil.rmtree(index, ignore_errors=True)
        command = [sys.executable, "-m", "tessera.cli", "index", "-c", args.corpus, "-i", str(index), "--threads", str(n), "--max-docs", str(args.max_docs)]
        ran = subprocess.run(command, capture_output=True, text=True, cwd=Path(__file__).parent)
        (args.out / f"threads_{n}.log").write_text(ran.stderr)
        if ran.returncode:
            print(f"{n} threads: failed, see {args.out}/threads_{n}.log", file=sys.stderr)
            continue
        found = {"threads": n} | json.loads(ran.stdout.strip().splitlines()[-1])
        (args.out / f"threads_{n}.json").write_text(json.dumps(found))
        runs.append(found)
        if not args.keep_indexes:
            shutil.rmtree(index, ignore_errors=True)
    if not runs:
        return 1
    table = summary(runs)
    (args.out / "summary.json").write_text(json.dumps(table, indent=1))
    with (args.out / "summary.csv").open("w", newline="") as file:
        writer = csv.DictWriter(file, table[0])
        writer.writeheader()
        writer.writerows(table)
    for r in table:
        print(f"{r['threads']:>4} threads {r['Elapsed Time']:>9.2f} s  x{r['speedup']:.2f}  {100 * r['efficiency']:.0f} %")
    return 0


if __name__ == "__main__":
    sys.exit(main())
