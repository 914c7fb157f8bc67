"""Names in all contents: rare forms of names against a plain search, and postings that don't grow with repeated words."""

from sparkweave.operators import retrieve


def search(spark, contents, names):
    c = spark.createDataFrame(contents, "chunk_id long, content string")
    return retrieve.names_in_all(c, spark.createDataFrame([(n,) for n in names], "name string"))


def test_names_of_several_parts_and_white_space(spark):
    contents = [(1, "The Form I-485\tand a b c d"), (2, "xform i-485x"), (3, "Form\nI-485 Étés"), (4, None), (5, "     "), (6, "unforms 12345 123456"), (None, "forms 12345")]
    names = ["Form I-485", "FORMS", "a b c", " a b ", "     ", "étés é", "ÉTÉS", "12345", "23456", "form", None, "forms", "m i-4"]
    want = {(k, n) for k, c in contents if c and k for n in names if n and len(n) >= 5 and n.lower() in c.lower()}
    got = [tuple(r) for r in search(spark, contents, names).collect()]
    assert len(got) == len(want) and set(got) == want


def test_postings_are_of_different_tokens(spark, monkeypatch):
    counts, write = {}, retrieve.written

    def counted(df, name):
        out = write(df, name)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(retrieve, "written", counted)
    words = "alphabet betamax gammaray delta "
    assert search(spark, [(1, words)], ["alpha", "gamma"]).count() == 2
    once = dict(counts)
    assert search(spark, [(i, words + str(i)) for i in range(50)], ["alpha", "gamma"]).count() == 100
    assert counts["postings"] == once["postings"]
