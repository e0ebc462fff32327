"""Where lineage is cut: the shared folder that the cluster names, a folder of our own only in one process."""

from __future__ import annotations

import pytest

from stratalake import session


class Context:
    """As much of a SparkContext as the folder's choice looks at."""

    def __init__(self, master: str, named: str | None = None):
        self.master, self.named, self.chosen = master, named, None
        self._jsc = self

    def sc(self):
        return self

    def getCheckpointDir(self):  # noqa: N802
        return self

    def isDefined(self):  # noqa: N802
        return False

    def getConf(self):  # noqa: N802
        return {"spark.checkpoint.dir": self.named} if self.named else {}

    def setCheckpointDir(self, path):  # noqa: N802
        self.chosen = path


class Session:
    def __init__(self, *args):
        self.sparkContext = Context(*args)


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://https://host", "local-cluster[3,2,1024]"])
def test_a_cluster_must_name_its_folder(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.use_checkpoint_dir(Session(master))
    named = Session(master, "hdfs://store/checkpoints")
    session.use_checkpoint_dir(named)
    assert named.sparkContext.chosen == "hdfs://store/checkpoints"


@pytest.mark.parametrize("master", ["local", "local[*]", "local[8]"])
def test_one_process_has_a_folder_of_its_own(master):
    alone = Session(master)
    session.use_checkpoint_dir(alone)
    assert "stratalake" in alone.sparkContext.chosen
