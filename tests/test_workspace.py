import pytest

from postlens import workspace


class Session:
    """The few things the module asks a session for."""

    def __init__(self, configured=None, set_later=None, master="local[2]", application="app"):
        values = {"spark.checkpoint.dir": configured} if configured else {}
        self.conf = type("Conf", (), {"get": staticmethod(values.get)})
        self.sparkContext = type(
            "Context",
            (),
            {
                "master": master,
                "applicationId": application,
                "getCheckpointDir": staticmethod(lambda: set_later),
            },
        )


def test_the_shared_folder_of_the_session_is_used():
    folder = workspace.new_folder(Session(configured="hdfs://shared/ck/", master="yarn"), "pages")
    assert folder.startswith("hdfs://shared/ck/postlens/pages-")


def test_a_checkpoint_folder_set_on_the_context_is_used():
    folder = workspace.new_folder(Session(set_later="hdfs://shared/ck/1", master="yarn"), "pages")
    assert folder.startswith("hdfs://shared/ck/1/postlens/pages-")


def test_a_cluster_without_a_shared_folder_is_an_error():
    with pytest.raises(ValueError):
        workspace.new_folder(Session(master="spark://host:7077"), "pages")


def test_a_local_session_keeps_one_folder_of_its_own():
    first, second = Session(application="one"), Session(application="two")
    assert workspace.shared_root(first) == workspace.shared_root(first)
    assert workspace.shared_root(first) != workspace.shared_root(second)


def test_folders_are_never_the_same(spark):
    assert workspace.new_folder(spark, "x") != workspace.new_folder(spark, "x")


def test_a_scope_takes_its_tables_away(spark, tmp_path, documents):
    from pathlib import Path

    from postlens.operators import label_posts, prepare_lexicon
    from postlens.workspace import new_folder, scratch

    words = spark.createDataFrame([("the", "positive")], "word string, polarity string")
    kept = str(tmp_path / "labels")
    with scratch(spark):
        inner = new_folder(spark, "inner")
        with scratch(spark):
            lexicon = prepare_lexicon(words, "salted")
            label_posts(documents, lexicon, key="doc_id").write.parquet(kept)
            begun = new_folder(spark, "posts")
            scope = Path(begun).parent
            assert any(scope.iterdir())
        assert not scope.exists() and scope.parent == Path(inner).parent
    assert not scope.parent.exists()
    assert spark.read.parquet(kept).count() == documents.count()
    assert "scope" not in new_folder(spark, "after")
    with pytest.raises(RuntimeError), scratch(spark):
        raise RuntimeError("also removed when something fails")
