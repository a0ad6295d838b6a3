import numpy as np
from pyspark.sql import functions as F

from voxelith.sources import arrays as A
from voxelith.sources import images as I
from voxelith.streaming import events as E


def test_pnm_round_trip(spark, tmp_path):
    rng = np.random.default_rng(0)
    for k, (shape, binary) in enumerate([((1, 5, 7), True), ((1, 5, 7), False), ((3, 4, 6), True), ((3, 4, 6), False)]):
        cube = rng.integers(0, 256, shape)
        cube.flat[0] = 255
        data = I.encode_pnm(cube, binary=binary)
        assert (I.decode_pnm(data) == cube).all()
        (tmp_path / f"{k}.pnm").write_bytes(data)
    (tmp_path / "c.pnm").write_bytes(b"P1\n# a comment\n3 2\n1 0 1\n010\n")
    (tmp_path / "d.pnm").write_bytes(b"P4\n9 2\n" + bytes([0b10000000, 0b10000000, 1, 0]))
    got = I.read_pnm(spark, f"file://{tmp_path}")
    assert got.count() == 35 * 2 + 72 * 2 + 6 + 18
    assert got.where(F.col("path").endswith("c.pnm")).agg(F.sum("val")).first()[0] == 3
    assert got.where(F.col("path").endswith("d.pnm")).agg(F.sum("val")).first()[0] == 3
    files = I.pnm_files(got.where(F.col("path").endswith("2.pnm")), ["path"]).first()
    assert (I.decode_pnm(bytes(files.content)) == I.decode_pnm((tmp_path / "2.pnm").read_bytes())).all()


def test_wide_samples_and_normalisation():
    cube = np.array([[[0, 1000], [500, 65535]]])
    assert (I.decode_pnm(I.encode_pnm(cube)) == cube).all()
    assert I.decode_pnm(I.encode_pnm(cube, normalise=True)).max() == 255
    assert I.decode_pnm(I.encode_pnm(np.full((1, 2, 2), 7), normalise=True)).max() == 0


def test_raw_volume(spark, tmp_path):
    cube = np.arange(24, dtype=float).reshape(2, 3, 4)
    (tmp_path / "v.raw").write_bytes(I.encode_raw(cube))
    rows = I.read_raw(spark, f"file://{tmp_path}/v.raw").collect()
    assert {(r.z, r.y, r.x): r.val for r in rows} == {p: v for p, v in np.ndenumerate(cube)}


def test_text_image(spark, tmp_path):
    (tmp_path / "t.txt").write_text("1 2 3\n4 5  6\n")
    rows = I.read_text_image(spark, f"file://{tmp_path}/t.txt").collect()
    assert sorted((r.y, r.x, r.val) for r in rows) == [(0, 0, 1), (0, 1, 2), (0, 2, 3), (1, 0, 4), (1, 1, 5), (1, 2, 6)]


def test_array_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0]), (2, [])], "vol_id long, a array<double>")
    vox = A.load_array(df, "a", (2, 2))
    assert A.store_array(vox, (2, 2)).first().data == [1, 2, 3, 4]
    assert [r[0] for r in df.select(A.load_scalar(df, "a", -1.0)).collect()] == [1.0, -1.0]
    A.dump_text(vox, f"file://{tmp_path}/dump")
    assert [r[0] for r in spark.read.text(f"file://{tmp_path}/dump").collect()] == ["1.0", "2.0", "3.0", "4.0"]


def test_streams_equal_batches(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    source.orderBy("ts").repartition(3).write.parquet(f"file://{tmp_path}/events")
    for name, f in (("sums", E.hourly_sums), ("sessions", E.sessions), ("cost", lambda e: E.daily_warping(e, [1.0] * 24))):
        stream = f(E.read_events(spark, f"file://{tmp_path}/events", 10))
        q = stream.writeStream.format("memory").queryName(name).outputMode("complete" if name != "sessions" else "append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.awaitTermination()
        got = spark.table(name).count()
        assert got > 0 and (name == "sessions" or got == f(source).count())
