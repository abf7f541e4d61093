import random

from pyspark.sql import functions as F

from cuespark.operators import review
from cuespark.streaming import review_queue


def events(n, seed):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        kind = rng.choice(["append", "append", "status", "status", "other"])
        out.append((rng.choice(["hot"] * 3 + [f"i{j}" for j in range(9)] + [None]), rng.choice([k, k // 3, None]) if k % 7 == 0 else k, kind, rng.choice([f"entry {k}", None]) if kind == "append" else None, rng.choice(["approved", "rejected", "pending", None]) if kind == "status" else None))
    return out


def told(df):
    return sorted(tuple(r) for r in df.collect())


def test_batches_cut_anywhere_give_one_queue(spark, tmp_path):
    rows = events(200, 1)
    want = told(review_queue.queue_of(spark.createDataFrame(rows, review_queue.EVENTS)))
    for name, cuts in (("one", [200]), ("three", [40, 41, 200])):
        path, checkpoint, at = str(tmp_path / name), str(tmp_path / f"{name}-state"), 0
        shuffled = rows[:] if name == "one" else random.Random(2).sample(rows, len(rows))
        for cut in cuts:
            spark.createDataFrame(shuffled[at:cut], review_queue.EVENTS).repartition(2).write.mode("append").parquet(path)
            at = cut
            review_queue.take_files(spark, path, checkpoint)
        assert told(review_queue.queue(spark, checkpoint)) == want
        # everything once more, late: nothing changes
        spark.createDataFrame(rows, review_queue.EVENTS).write.mode("append").parquet(path)
        review_queue.take_files(spark, path, checkpoint)
        assert told(review_queue.queue(spark, checkpoint)) == want
    assert len(want) == 10 and {s for _, _, s in want} > {"approved"}


def test_stream_agrees_with_the_tables_operators(spark, tmp_path):
    """First appends and last changes, as upsert and update by key make them batch by batch."""
    first = [("a", 1, "append", "A", None), ("b", 2, "append", "B", None), ("a", 3, "append", "A again", None)]
    second = [("c", 4, "append", "C", None), ("b", 5, "append", "B again", None), ("a", 6, "status", None, "approved"), ("nobody", 7, "status", None, "approved")]
    held = spark.createDataFrame([], "id string, entry string, status string")
    path, checkpoint = str(tmp_path / "in"), str(tmp_path / "state")
    for batch in (first, second):
        df = spark.createDataFrame(batch, review_queue.EVENTS)
        new = df.where("kind = 'append'").groupBy("id").agg(F.min_by("entry", "ord").alias("entry")).withColumn("status", F.lit("pending_review"))
        held = review.update_by_key(review.upsert_absent(held, new, "id"), df.where("kind = 'status'").select("id", "status"), "id", "status")
        df.write.mode("append").parquet(path)
        review_queue.take_files(spark, path, checkpoint)
    assert told(review_queue.queue(spark, checkpoint)) == told(held) == [("a", "A", "approved"), ("b", "B", "pending_review"), ("c", "C", "pending_review")]
    assert told(review.pending(review_queue.queue(spark, checkpoint)).select("id")) == [("b",), ("c",)]
