import os

import pytest
from pyspark.sql import functions as F

from cuespark.operators import reports, review
from cuespark.sources import keyed_table

SCHEMA = "path string, status string"


def files(path):
    return {(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def rows(df):
    return sorted((str(r.path), r.status) for r in df.collect())


def test_upserts_agree_with_the_manifest_operator(spark, tmp_path):
    path, held = str(tmp_path / "m"), spark.createDataFrame([], SCHEMA)
    batches = [[(f"f{i}", f"s{i}", 1) for i in range(200)], [("f3", "a", 1), ("f3", "b", 2), ("new", "c", 1), (None, "n", 1)], [], [(None, "m", 1), ("f199", "z", 0)]]
    for batch in batches:
        new = spark.createDataFrame(batch, SCHEMA + ", ord int")
        before = files(path)
        touched = keyed_table.upsert(path, new, "path")
        plain = new.where("path IS NOT NULL")
        held = spark.createDataFrame(reports.upsert_manifest(held, plain).collect(), SCHEMA)
        table = keyed_table.read(spark, path, SCHEMA)
        assert rows(table.where("path IS NOT NULL")) == rows(held)
        kept = {k: v for k, v in files(path).items() if before.get(k) == v}
        assert len(touched) <= len({b[0] for b in batch}) and all(f"_bucket={b}/" not in d + "/" for d, _ in kept for b in touched)
        assert {k for k in before if not any(f"_bucket={b}" == os.path.basename(k[0]) for b in touched)} == set(kept)
    assert rows(keyed_table.read(spark, path, SCHEMA).where("path IS NULL")) == [("None", "m")]
    assert keyed_table.read(spark, str(tmp_path / "none"), SCHEMA).count() == 0


def test_a_failed_upsert_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "m")
    keyed_table.upsert(path, spark.createDataFrame([(f"f{i}", "s", 1) for i in range(50)], SCHEMA + ", ord int"), "path")
    before = files(path)
    bad = spark.range(1).select(F.lit("f1").alias("path"), F.raise_error(F.lit("broken")).cast("string").alias("status"), F.lit(1).alias("ord"))
    with pytest.raises(Exception, match="broken"):
        keyed_table.upsert(path, bad, "path")
    assert files(path) == before and os.listdir(tmp_path) == ["m"]


def test_a_cache_asks_only_what_it_lacks(spark, tmp_path):
    path, schema = str(tmp_path / "cache"), "signature string, status string, reply string"
    wanted = spark.createDataFrame([(f"k{i}",) for i in range(30)], "signature string")
    asked = []
    for n in (10, 30, 30):
        some = wanted.where(F.substring("signature", 2, 2).cast("int") < n)
        known = keyed_table.find(some, path, "signature", schema)
        missing = review.cache_misses(some, known)
        asked.append(missing.count())
        keyed_table.upsert(path, missing.select("signature", F.lit("ok").alias("status"), F.concat(F.lit("r"), "signature").alias("reply"), F.lit(1).alias("ord")), "signature", keep_held=True)
    assert asked == [10, 20, 0] and keyed_table.read(spark, path, schema).count() == 30
    # what is held stays
    keyed_table.upsert(path, wanted.select("signature", F.lit("ok").alias("status"), F.lit("other").alias("reply"), F.lit(1).alias("ord")), "signature", keep_held=True)
    assert keyed_table.read(spark, path, schema).where("reply = 'other'").count() == 0
