"""Results that are kept by what they were made from."""

from skylag.store import fingerprint, kept


def test_changed_data_under_one_name_gives_new_answers(spark, tmp_path):
    data, root, runs = str(tmp_path / "data"), str(tmp_path / "root"), []

    def build(folder):
        runs.append(folder)
        spark.read.parquet(data).groupBy().sum("id").write.parquet(f"{folder}/sum")

    def answer(**parameters):
        folder = kept(spark, "sum", [data], build, root, **parameters)
        return spark.read.parquet(f"{folder}/sum").first()[0]

    spark.range(10).write.parquet(data)
    assert (answer(), answer(), len(runs)) == (45, 45, 1)
    spark.range(20).write.mode("overwrite").parquet(data)
    assert (answer(), len(runs)) == (190, 2)
    assert answer(limit=3) == 190 and len(runs) == 3
    # Only the last state's result is left.
    (place,) = (tmp_path / "root/kept/sum").iterdir()
    assert [f.name for f in place.iterdir()] == [runs[-1].rsplit("/", 1)[1]]


def test_an_unfinished_job_is_run_again(spark, tmp_path):
    data, root = str(tmp_path / "data"), str(tmp_path / "root")
    spark.range(3).write.parquet(data)

    def broken(folder):
        spark.range(1).write.parquet(f"{folder}/out")
        raise RuntimeError("broke off")

    for _ in range(2):
        try:
            kept(spark, "job", [data], broken, root)
        except RuntimeError:
            pass
    folder = kept(spark, "job", [data], lambda f: spark.range(5).write.parquet(f"{f}/out"), root)
    assert spark.read.parquet(f"{folder}/out").count() == 5


def test_fingerprint_follows_files_and_parameters(spark, tmp_path):
    data = str(tmp_path / "data")
    spark.range(3).write.parquet(data)
    first = fingerprint(spark, [data])
    assert first == fingerprint(spark, [data]) != fingerprint(spark, [data], trees=3)
    spark.range(1).write.mode("append").parquet(data)
    assert fingerprint(spark, [data]) != first
