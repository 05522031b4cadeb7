"""The folder for tables between steps."""

from pathlib import Path
from types import SimpleNamespace

import pytest

from porewise.sources import storage


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master))
    with pytest.raises(ValueError, match="checkpoint"):
        storage.shared_root(session)


def test_tables_lie_in_the_application_s_folder_and_go_with_it(spark, monkeypatch):
    monkeypatch.setattr(storage, "_written", {})
    rows = storage.materialize(spark.range(3), "some")
    (folder,) = storage._written
    assert folder.endswith(f"porewise-{spark.sparkContext.applicationId}") and folder.startswith(storage.shared_root(spark))
    path = Path(rows.inputFiles()[0].removeprefix("file://")).parent
    assert path.parent.name == Path(folder).name and rows.count() == 3
    kept = path.parent / "kept"
    monkeypatch.setattr(storage, "_written", {f"file://{kept}": spark})
    storage.materialize(spark.range(1), "other")  # writes to the application's folder, which is not removed here
    storage._written.pop(folder, None)
    kept.mkdir()
    storage.remove_written()
    assert not kept.exists() and path.exists()
