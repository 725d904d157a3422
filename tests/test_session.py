from tarmac.session import REQUIRED_CONF, configure, ensure_checkpoint_dir


def test_existing_checkpoint_dir_is_kept(spark, tmpdir_path):
    before = spark.sparkContext.getCheckpointDir()
    assert before  # set by the cluster default or by the test fixture
    assert ensure_checkpoint_dir(spark, fallback=f"{tmpdir_path}/other") == before
    configure(spark)
    assert spark.sparkContext.getCheckpointDir() == before


def test_required_settings(spark):
    configure(spark)
    for key, value in REQUIRED_CONF.items():
        assert spark.conf.get(key) == value
