"""Connected components of links between identifiers, by label passing on DataFrames.

Each round lowers the label of a component's root to the least label next to
the component, then shortens paths. All tables are written to the shared
scratch folder, so that skewed labels meet as plain joins that adaptive
execution can split. Links and labels never pass through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch_scope, session_of


def connected_components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(id, component) of every identifier that has a link; the component is its least identifier. Written to scratch."""
    with scratch_scope(session_of(links)):
        some = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct()
        edges = materialize(some.union(some.select("b", "a")).distinct(), "components-links")
        labels = materialize(edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("c")), "components-labels")
        for _ in range(most_rounds):
            near = (
                edges.join(labels.select(F.col("id").alias("b"), F.col("c").alias("other")), "b")
                .groupBy("a").agg(F.min("other").alias("other"))
            )
            near = materialize(near, "components-near")
            roots = (
                labels.join(near, labels["id"] == near["a"]).filter("other < c")
                .groupBy("c").agg(F.min("other").alias("lower"))
            )
            roots = materialize(roots, "components-roots")
            if roots.isEmpty():
                return materialize(labels.select("id", F.col("c").alias("component")), "components", outer=True)
            hooked = labels.join(roots, "c", "left").select("id", F.coalesce("lower", "c").alias("c"))
            hooked = materialize(hooked, "components-hooked")
            up = hooked.select(F.col("id").alias("c"), F.col("c").alias("above"))
            labels = materialize(hooked.join(up, "c", "left").select("id", F.least("c", F.coalesce("above", "c")).alias("c")), "components-labels")
    raise RuntimeError(f"labels still change after {most_rounds} rounds")
