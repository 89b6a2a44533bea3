"""Starting centres of k-means."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from hostweave.functions.draws import draw_key, draw_number
from hostweave.operators import roles
from hostweave.operators.scale import cut
from hostweave.sources.schema import FEATURES


def table(spark):
    rows = [(s, f"{s}{i}", *[float((i * 7 + k) % 11) for k in range(len(FEATURES))]) for s in ("x", "y") for i in range(60)]
    return cut(spark.createDataFrame(rows, "scenario string, id string, " + ", ".join(f"{n} double" for n in FEATURES)))


def test_no_task_sorts_a_scenario(spark):
    drawn = table(spark).withColumn("h", draw_number(0, "start", draw_key("id")))
    ranked = drawn.withColumn("rank", F.row_number().over(Window.partitionBy("scenario").orderBy("h", "id"))).where(F.col("rank") <= 4)
    # the same expression as in fit_centroids
    assert "WindowGroupLimit" in ranked._jdf.queryExecution().executedPlan().toString()


def test_centres_start_at_the_first_hosts(spark):
    points = table(spark)
    got = {(r.scenario, *(r[c] for c in FEATURES)) for r in roles.fit_centroids(points, 3, rounds=0).collect()}
    drawn = points.withColumn("h", draw_number(0, "start", draw_key("id"))).collect()
    want = set()
    for s in ("x", "y"):
        first = sorted((r for r in drawn if r.scenario == s), key=lambda r: (r.h, r.id))[:3]
        want |= {(s, *(r[c] for c in FEATURES)) for r in first}
    assert got == want
