"""The increment as a stream: page versions arrive, each batch keeps a page's latest and merges it into the state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leafmill.lineage import cut
from leafmill.plans.state import current_version, load_state, save_state
from leafmill.tables import normalize

KEY = ["space_id", "page_id"]


def latest(edits: DataFrame) -> DataFrame:
    """Of rows with version, each page's last."""
    rest = [c for c in edits.columns if c not in KEY]
    return edits.groupBy(*KEY).agg(F.max(F.struct("version", *[c for c in rest if c != "version"])).alias("v")).select(*KEY, "v.*")


def merge(state: DataFrame, edits: DataFrame) -> DataFrame:
    """state with newer versions put in; what comes late changes nothing."""
    new = latest(edits).select(*state.columns)
    return latest(state.unionByName(new)).select(*state.columns)


def follow(edits: DataFrame, folder: str, checkpoint: str, *, watermark: str = "1 day", time_col: str | None = None, once: bool = True) -> StreamingQuery:
    """Merges a stream of page versions into the published state in folder. Repeated events within the watermark are dropped."""
    rows = edits.withWatermark(time_col, watermark).dropDuplicatesWithinWatermark([*KEY, "version"]).drop(time_col) if time_col else edits

    def batch(df: DataFrame, batch_id: int) -> None:
        # Only the spaces of this batch are read and replaced; their other tables stay.
        spark = df.sparkSession
        base = current_version(spark, folder)
        edited = cut(df)
        state = normalize(load_state(spark, folder, "state_pages", version=base), "state_pages").join(edited.select("space_id").distinct(), "space_id", "left_semi")
        more = edited.select(*[F.col(c) if c in edited.columns else F.lit("").cast(state.schema[c].dataType).alias(c) for c in state.columns])
        save_state(spark, {"state_pages": merge(state, more)}, folder, spaces=edited.select("space_id"), base=base)

    writer = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
