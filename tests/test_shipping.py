"""The library's code reaches Python workers when the driver was started anywhere."""

import os
import subprocess
import sys

from conftest import ROOT

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pathlib import Path
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
spark = (
    SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false")
    .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", Path.cwd().joinpath("shared").as_uri()).getOrCreate()
)
from matchloom.functions.images import image_vector
from matchloom.operators.labels import sequence_ratio
from matchloom.plans import catalog
for name in ("flagship_temporal_top5", "ml1_ml2_top7_knn", "jn9_ground_truth"):
    print("ROWS", name, catalog.QUERIES[name](spark, {sf!r}).count())
image = F.struct(F.lit(4).alias("height"), F.lit(4).alias("width"), F.lit(3).alias("nChannels"), F.lit(bytes(range(48))).alias("data"))
print("ROWS image", len(spark.range(1).select(image_vector(image).alias("v")).first()["v"]))
print("ROWS ratio", spark.range(1).select(sequence_ratio(F.lit("abcd"), F.lit("bcde"))).first()[0])
tables = list(Path("shared").glob("matchloom-*"))
spark.stop()
print("ROWS kept", len(tables) and [p for p in tables if p.exists()])
"""


def test_started_in_another_folder(tmp_path, sf):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT, sf=sf)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    rows = dict(line.split()[1:] for line in done.stdout.splitlines() if line.startswith("ROWS") and len(line.split()) == 3)
    assert done.returncode == 0, done.stderr[-2000:]
    assert int(rows["flagship_temporal_top5"]) > 0 and int(rows["ml1_ml2_top7_knn"]) > 0 and rows["image"] == "184" and rows["ratio"] == "0.75"
