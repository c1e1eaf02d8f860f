"""Summarise stage durations from a Spark event log directory (zstd or plain)."""
import glob
import io
import json
import sys

import zstandard


def lines(path):
    if path.endswith(".zstd"):
        with open(path, "rb") as fh:
            data = zstandard.ZstdDecompressor().stream_reader(fh)
            yield from io.TextIOWrapper(data, encoding="utf-8")
    else:
        yield from open(path)


def main(root):
    stages = {}
    for f in glob.glob(f"{root}/**/events_*", recursive=True) + glob.glob(f"{root}/*.inprogress"):
        for line in lines(f):
            e = json.loads(line)
            if e["Event"] == "SparkListenerStageCompleted":
                i = e["Stage Info"]
                d = (i["Completion Time"] - i["Submission Time"]) / 1000
                stages[i["Stage ID"]] = (round(d, 2), i["Number of Tasks"], i["Stage Name"][:70])
    for k, v in sorted(stages.items()):
        print(k, *v)
    print("total stage seconds", round(sum(v[0] for v in stages.values()), 1))


if __name__ == "__main__":
    main(sys.argv[1])
