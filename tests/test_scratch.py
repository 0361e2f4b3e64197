import pytest
from spanloom.operators import scratch


class Unset:
    """A session without spark.checkpoint.dir."""

    def __init__(self, master):
        self.conf = self
        self.get = lambda key, default=None: master if key == "spark.master" else default


def test_folder_of_the_session_or_a_default(spark):
    s = scratch.Scratch(spark, "t")
    assert s.root.startswith(spark.conf.get("spark.checkpoint.dir"))
    for master in ("local", "local[4]", "local[*]", "local[2, 3]"):
        assert scratch.Scratch(Unset(master), "t").root.startswith(scratch.UNSET)
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]", "k8s://https://host"):
        with pytest.raises(ValueError, match="checkpoint"):
            scratch.Scratch(Unset(master), "t")
    kept = s.save(spark.range(5), "x")
    assert kept.count() == 5 and kept._scratch_path.startswith(s.root)
    s.drop(kept, None)
    assert len(list(spark.sparkContext._jvm.java.io.File(s.root).listFiles())) == 0
