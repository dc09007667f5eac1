import sys

import pytest

import __spark_entry__ as entry
from textloom.plans import catalogue


def test_entry_has_rows(spark):
    assert entry.entry(spark).columns == ["masked", "works"]


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(catalogue.queries()) > 70


def test_whole_tables():
    """No registered plan cuts its tables down."""
    import inspect

    from textloom.plans import abstracts, audit, compare, corpus, drift, forms, instruments, linked, reports, senses, sensitivity, vectors

    for module in (abstracts, audit, compare, corpus, drift, forms, instruments, linked, reports, senses, sensitivity, vectors):
        assert ".limit(" not in inspect.getsource(module) and ".sample(" not in inspect.getsource(module)


def test_without_the_subpackage(monkeypatch):
    """The entry imports and answers where the subpackage and the pipeline are gone."""
    import importlib

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    try:
        bare = importlib.reload(entry)
        assert "pipeline" not in bare.queries() and "template_sentences" in bare.queries()
    finally:
        monkeypatch.undo()
        importlib.reload(entry)


def test_other_missing_modules_are_errors(monkeypatch):
    """Only the absence of the subpackage or the pipeline is passed over."""
    import importlib

    pipeline = type(sys)("corpus_pipeline")
    monkeypatch.setitem(sys.modules, "corpus_pipeline", pipeline)
    monkeypatch.setitem(sys.modules, "textloom.llm", None)
    try:
        assert "pipeline" not in importlib.reload(entry).queries()

        def broken(name, *args, **kwargs):
            if name == "corpus_pipeline":
                raise ModuleNotFoundError("No module named 'some_codec'", name="some_codec")
            return real(name, *args, **kwargs)

        import builtins

        real = builtins.__import__
        monkeypatch.setattr(builtins, "__import__", broken)
        with pytest.raises(ModuleNotFoundError, match="some_codec"):
            importlib.reload(entry)
    finally:
        monkeypatch.undo()
        importlib.reload(entry)


@pytest.mark.parametrize("master, folder, good", [("yarn", None, False), ("yarn", "file:///tmp/x", False), ("spark://a:7077", "hdfs://b/c", True), ("k8s://a", "file:///mnt/shared", True), ("local-cluster[2,1,1024]", "file:///tmp/x", True)])
def test_machine_local_folders_are_refused_on_clusters(master, folder, good):
    from textloom.shared import shared_folder

    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: folder)

        class sparkContext:
            applicationId = "app"

    Session.sparkContext.master = master
    if good:
        assert shared_folder(Session).startswith(folder)
    else:
        with pytest.raises(ValueError):
            shared_folder(Session)


@pytest.mark.parametrize("temporary", ["/tmp", "/elsewhere/tmp"])
@pytest.mark.parametrize("master, folder, mounts, good", [
    ("yarn", "file:///tmp/x", "/tmp", False),
    ("yarn", "/var/tmp/x", "/var", False),
    ("yarn", "/var/x", None, False),
    ("spark://a:7077", "file:///home/x", "", False),
    ("k8s://a", "file:///mnt/shared", None, False),
    ("k8s://a", "file:///mnt/shared/x", "/data, file:///mnt/shared", True),
    ("k8s://a", "file:///mnt/sharedless", "/mnt/shared", False),
    ("yarn", "hdfs://a/tmp", None, True),
    ("local[2]", "/tmp/x", None, True),
])
def test_local_paths_need_a_mount_that_is_named(monkeypatch, temporary, master, folder, mounts, good):
    import tempfile

    from textloom.shared import SHARED_MOUNTS, shared_folder

    monkeypatch.setattr(tempfile, "gettempdir", lambda: temporary)
    settings = {"spark.checkpoint.dir": folder, SHARED_MOUNTS: mounts}

    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: settings.get(key) or default)

        class sparkContext:
            applicationId = "app"

    Session.sparkContext.master = master
    if good:
        assert shared_folder(Session).startswith(folder)
    else:
        with pytest.raises(ValueError):
            shared_folder(Session)


@pytest.mark.parametrize("seen", [True, False])
def test_local_paths_that_all_executors_see_are_shared(spark, tmp_path, seen):
    """On a cluster a local path is taken if what the executors write there is found whole, and refused if some of it is missing."""
    from textloom.shared import shared_folder

    class Session:
        range = staticmethod(spark.range if seen else lambda start, end, step, parts: spark.range(start, end - 1, step, parts))
        read = spark.read

        class conf:
            get = staticmethod(lambda key, default=None: {"spark.checkpoint.dir": f"file://{tmp_path}"}.get(key, default))

        class sparkContext:
            master, applicationId, defaultParallelism = "spark://a:7077", f"app-{tmp_path.name}", 2

    if seen:
        assert shared_folder(Session) == f"file://{tmp_path}/textloom-app-{tmp_path.name}"
    else:
        with pytest.raises(ValueError, match="folder of one machine"):
            shared_folder(Session)


def test_a_session_on_one_machine_needs_no_setting(spark):
    """Without spark.checkpoint.dir, which a running session doesn't take, one temporary folder is made for the application."""
    from textloom.shared import shared_folder

    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: default)
            set = staticmethod(spark.conf.set)

        class sparkContext:
            master, applicationId = "local[2]", "app-unset"

    assert shared_folder(Session) == shared_folder(Session)
