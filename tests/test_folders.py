import os

import pytest

from lexivec.sources import folders


def test_scratch_deletes_what_it_held(spark):
    with folders.scratch(spark) as path:
        kept = folders.materialize(spark.range(3))
        assert kept.count() == 3 and os.path.isdir(path.removeprefix("file:"))
        with folders.scratch(spark) as inner:
            folders.materialize(spark.range(1))
        assert not os.path.exists(inner.removeprefix("file:"))
    assert not os.path.exists(path.removeprefix("file:"))
    assert folders.materialize(spark.range(2)).count() == 2


def test_no_folder_of_one_machine_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="checkpoint"):
        folders.shared_dir(Session())
