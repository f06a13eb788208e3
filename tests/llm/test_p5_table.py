"""Where the table of look-alike letters can't be read, p5 fails instead of giving fewer pairs."""

import pytest

from sparkmoment.llm import canon as C


class NoJvm:
    """A session over Spark Connect, whose JVM can't be reached."""

    @property
    def _jvm(self):
        raise AttributeError("JVM_ATTRIBUTE_NOT_SUPPORTED")


class NoIcu:
    """A JVM without the library: py4j gives a package, which can't be called."""

    class _jvm:  # noqa: N801
        com = None


@pytest.mark.parametrize("session", [NoJvm(), NoIcu(), None])
def test_a_table_that_cannot_be_read_is_an_error(session):
    with pytest.raises(RuntimeError, match="look-alike letters"):
        C.look_alikes(session)


def test_no_form_without_the_table(spark, monkeypatch):
    df = spark.createDataFrame([("f", 1, "αιρ"), ("f", 2, "aip")], "field string, key int, text string")
    assert [tuple(r) for r in C.same_look_pairs(df, "field", "key", "text").collect()] == [("f", 1, 2)]

    def unreadable(_):
        raise OSError("no table")

    monkeypatch.setattr(C, "_confusables", unreadable)
    for query in (C.same_look_pairs, C.same_look_links):
        with pytest.raises(RuntimeError, match="look-alike letters"):
            query(df, "field", "key", "text")
    with pytest.raises(RuntimeError, match="look-alike letters"):
        C.with_canonical(df, "text", "form")
