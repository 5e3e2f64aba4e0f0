"""What the carrying of media states sends through shuffles."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.plans import reconcile as R

KIND = "space_id string, page_id string, att_id string, version int, file string, blob string"


def joined(plan) -> list[list[str]]:
    """Columns of both sides of each join of a plan."""
    kids = [plan.children().apply(k) for k in range(plan.children().size())]
    own = [[side.output().apply(k).name() for k in range(side.output().size())] for side in kids] if plan.nodeName() == "Join" else []
    return own + [c for kid in kids for c in joined(kid)]


def states(spark):
    sha = F.sha2(F.col("att_id"), 256)
    old = spark.range(60).select(F.lit("s").alias("space_id"), (F.col("id") % 7).cast("string").alias("page_id"), F.col("id").cast("string").alias("att_id"), F.lit(1).alias("version"), F.concat(F.lit("F"), (F.col("id") % 9).cast("string")).alias("file"))
    old = old.withColumn("blob", F.when(F.col("att_id").cast("int") % 5 == 0, "").when(F.col("att_id").cast("int") % 5 == 1, "short").when(F.col("att_id").cast("int") % 5 == 2, None).otherwise(sha))
    now = old.where("att_id % 4 <> 0").withColumns({"version": F.lit(2), "file": F.lower("file"), "blob": F.when(F.col("att_id").cast("int") % 3 == 0, "").otherwise(F.upper(sha))})
    return old, now


def test_digests_stay_where_nobody_asks_for_them(spark):
    old, now = states(spark)
    rows = R.carry_media(old, now, complete=False, moved=old.select("space_id", "page_id"))
    sides = joined(rows.select("att_id", "file", "carried")._jdf.queryExecution().optimizedPlan())
    assert sides and not [c for side in sides for c in side if "blob" in c]
    # Rows of one side and of its look-up meet, not those of both with each look-up.
    assert not [side for side in sides if {"file", "_file"} <= set(side)]


def test_states_are_carried_as_before(spark):
    old, now = states(spark)
    moved = old.select("space_id", "page_id").where("page_id % 2 = 0")
    for complete in (True, False):
        for media in (True, False):
            got = {r.att_id: (r.version, r.file, r.blob, r.carried) for r in R.carry_media(old, now, media=media, complete=complete, moved=moved).collect()}
            before, after = ({r.att_id: r for r in side.collect()} for side in (old, now))
            put = {(r.page_id, r.file.lower()) for r in after.values() if r.blob}
            wanted = {}
            for a in before:
                o, c = before[a], after.get(a)
                rescued = c is not None and not c.blob and bool(o.blob) and int(o.page_id) % 2 == 0 and (o.page_id, o.file.lower()) not in put
                carried = True if not media else rescued or (c is None and not complete)
                if carried or c is not None:
                    r = o if carried else c
                    wanted[a] = (r.version, r.file, r.blob, carried)
            assert got == wanted
